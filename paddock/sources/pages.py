"""Raw result pages. A small table function turns markup into rows of cells; everything after that is column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

from ..functions.names import canonical_name, race_code, truthy
from ..functions.parsing import CAREER_MARK, RESULT_MARK, iso_date, leading_int, lenient_number, links, local_number, parents, placed_time, placement, quoted_time, sex_country_age, url_value


#: An attribute: its name, and its value in quotes or up to a blank.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_RAW_END = {name: re.compile(f"</{name}\\b", re.IGNORECASE) for name in ("script", "style")}


def _attributes(html: str, at: int, known: dict[str, str]) -> tuple[int, int, bool]:
    """Adds the attributes from ``at`` on to ``known``; where they end, where the tag ends, and whether it is closed in itself."""
    while (found := _ATTRIBUTE.match(html, at)) is not None:
        value = found.group(2) or ""
        known.setdefault(found.group(1).lower(), unescape(value[1:-1] if value[:1] in ("'", '"') and value[:1] == value[-1:] and len(value) > 1 else value))
        at = found.end()
    end = html.find(">", at)
    return at, end, end >= 0 and html[end - 1] == "/"


def _tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Of markup, in one pass: ``("text", text, {})``, ``("start", name, attributes)`` and ``("end", name, {})``.

    As in a browser, comments, declarations and tags that are never closed end with the page, and a ``<`` that begins none of these is text.
    """
    at, text, size = 0, [], len(html)
    while at < size:
        begin = html.find("<", at)
        text.append(html[at : begin if begin >= 0 else size])
        if begin < 0:
            break
        more = html[begin + 1 : begin + 2]
        if more in ("!", "?") or more == "/" and not html[begin + 2 : begin + 3].isalpha():
            if any(text):
                yield "text", unescape("".join(text)), {}
            text, comment = [], html.startswith("<!--", begin)
            end = html.find("-->" if comment else ">", begin + (2 if comment else 1))
            at = end + (3 if comment else 1) if end >= 0 else size
            continue
        close = more == "/"
        named = _NAME.match(html, begin + 1 + close)
        if not named:
            text.append("<")
            at = begin + 1
            continue
        name, at, known = named.group().lower(), named.end(), {}
        if html.startswith(">", at):  # no attributes, as most tags
            end, alone = at, False
        else:
            at, end, alone = _attributes(html, at, known)
        if end < 0:
            break
        at = end + 1
        if any(text):
            yield "text", unescape("".join(text)), {}
        text = []
        yield "end" if close else "start", name, known
        if alone and not close:
            yield "end", name, {}
        elif name in _RAW_END and not close:
            after = _RAW_END[name].search(html, at)
            at = after.start() if after else size
    if any(text):
        yield "text", unescape("".join(text)), {}


class _Rows:
    """Rows of cells as they close: (section, table id, table, row in it, cells, their classes, which are td, first link in the first td); links: (id, target, label)."""

    def __init__(self, html: str) -> None:
        self.found: list[tuple] = []
        self.section, self.table, self.number, self.depth, self.row = 0, "", 0, 0, 0
        self.links: list[list[str]] = []
        self.linked = False
        self.cells: list[list[str]] | None = None
        self.classes: list[list[str]] = []
        self.data: list[bool] = []
        self.link = ""
        self.open = False
        take = {"start": self._start, "end": self._end, "text": self._text}
        for kind, value, known in _tokens(html):
            take[kind](value, known)
        self._close()

    def _start(self, tag: str, known: dict[str, str]) -> None:
        if tag == "div" and known.get("id") == "dati_corsa":
            self.section += 1
        elif tag == "table":
            self.table = known.get("id") or ""
            if not self.depth:
                self.number, self.row = self.number + 1, 0
            self.depth += 1
        elif tag == "tr":
            self._close()
            self.cells, self.classes, self.data, self.link = [], [], [], ""
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append([])
            self.classes.append(known.get("class", "").split())
            self.data.append(tag == "td")
            self.open = True
        elif tag == "a":
            if self.open and self.data[-1:] == [True] and sum(self.data) == 1 and not self.link:
                self.link = known.get("href") or ""
            if "href" in known:
                self.links.append([known.get("id") or "", known["href"] or "", ""])
                self.linked = True

    def _end(self, tag: str, _: dict[str, str]) -> None:
        if tag in ("td", "th"):
            self.open = False
        elif tag in ("tr", "table"):
            self._close()
            self.depth -= tag == "table" and self.depth > 0
        elif tag == "a":
            self.linked = False

    def _text(self, data: str, _: dict[str, str]) -> None:
        if self.open and self.cells:
            self.cells[-1].append(data.strip())
        if self.linked:
            self.links[-1][2] += data.strip()

    def _close(self) -> None:
        if self.cells:
            self.found.append((self.section, self.table, self.number, self.row, ["".join(c) for c in self.cells], self.classes, self.data, self.link))
            self.row += 1
        self.cells, self.open = None, False


@udtf(returnType="section int, table_id string, table int, row int, head array<string>, cells array<string>, classes array<array<string>>, data array<boolean>, link string")
class TableRows:
    def eval(self, html: str) -> Iterator[tuple]:
        if html:
            head: dict[int, list[str]] = {}
            for section, name, table, row, cells, classes, data, link in _Rows(html).found:
                yield section, name, table, row, head.setdefault(table, cells), cells, classes, data, link


@udtf(returnType="at int, element string, href string, label string")
class Links:
    def eval(self, html: str) -> Iterator[tuple]:
        if html:
            for at, (element, href, label) in enumerate(_Rows(html).links):
                yield at, element, href, label


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with a row for each table row in ``html``, ``head`` being the first row of its table; pages without any fall out."""
    return pages.lateralJoin(TableRows(F.col(html).outer()))


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with a row for each link in ``html``: its place, element id, target and label."""
    return pages.lateralJoin(Links(F.col(html).outer()))


def page_text(html: Column) -> Column:
    """The text without tags. What follows the last ``>`` holds none, so no ``<`` is followed to the end of the page in vain."""
    rest = F.substring_index(html, ">", -1)
    tagged = F.left(html, F.length(html) - F.length(rest))
    return F.trim(F.regexp_replace(F.concat(F.regexp_replace(tagged, r"(?s)<[^>]*>", " "), rest), r"\s+", " "))


def _cell(k: int) -> Column:
    return F.coalesce(F.get("cells", F.lit(k)), F.lit(""))


def _data_cell(k: int) -> Column:
    """The text of the k-th td; th cells don't count."""
    return F.coalesce(F.get("__data", F.lit(k)), F.lit(""))


def career_profiles(pages: DataFrame, as_of: Column) -> DataFrame:
    """``name, sex, country, birth_year, sire, dam`` of career pages (name, html)."""
    texts = pages.select(canonical_name(F.col("name")).alias("name"), page_text(F.col("html")).alias("__text"))
    read = texts.select("name", sex_country_age(F.col("__text")).alias("m"), parents(F.col("__text")).alias("p"))
    return read.select("name", "m.sex", "m.country", (F.year(as_of) - F.col("m.age")).alias("birth_year"), "p.sire", "p.dam")


def career_races(pages: DataFrame) -> DataFrame:
    """Races of career pages (name, html): rows of six td or more whose first links to a dated race."""
    kept = F.transform(F.filter(F.arrays_zip("cells", "data"), lambda x: x["data"]), lambda x: x["cells"])
    rows = table_rows(pages).withColumn("__data", kept).filter((F.size("__data") >= 6) & F.col("link").rlike(r"data=\d{4}-\d{2}-\d{2}"))
    day = F.regexp_extract("link", r"data=(\d{4}-\d{2}-\d{2})", 1)
    track = F.upper(F.regexp_extract("link", r"ippod=([A-Za-z]{2,4})", 1))
    prize = F.when(_data_cell(6).isin("---", ""), 0.0).otherwise(lenient_number(_data_cell(6)))
    return rows.select(
        canonical_name(F.col("name")).alias("horse_name"),
        day.try_cast("date").alias("race_date"),
        track.alias("track"),
        placement(_data_cell(2), CAREER_MARK).alias("placement"),
        _data_cell(2).alias("placement_raw"),
        quoted_time(_data_cell(4)).alias("time_km"),
        leading_int(_data_cell(3)).alias("distance"),
        F.lit("").alias("driver"),
        prize.alias("prize_net"),
        prize.alias("prize_gross"),
        race_code(day, F.regexp_extract("link", r"codice=(\d+)", 1), track, F.regexp_extract("link", r"n_corsa=(\d+)", 1)).alias("race_code"),
    )


#: Class names of the cells of result pages, with prizes and without.
CLASSES = {"name": ("nome_cav_u", "nome_cav"), "place": ("piaz_u", "piaz"), "time": ("tempo_u", "tempo"), "distance": ("dist_cav_u", "dist_cav"), "driver": ("driver_u", "driver"), "prize": ("premio_u",)}


def result_rows(pages: DataFrame) -> DataFrame:
    """Runners of result pages (race_date, track, sigla, html): td cells are known by any of their classes, with or without prizes."""
    rows = table_rows(pages).filter("section > 0 and table_id = 'tabella_risultati'")

    def named(field: str) -> Column:
        cells = F.arrays_zip("cells", "classes", "data")
        first = lambda c: F.get(F.filter(cells, lambda x: x["data"] & F.array_contains(x["classes"], c)), F.lit(0))["cells"]
        return F.coalesce(truthy(*map(first, CLASSES[field])), F.lit(""))

    name = canonical_name(named("name"))
    place = named("place")
    return rows.filter(F.length(name) >= 2).select(
        name.alias("name"),
        placement(place, RESULT_MARK).alias("placement"),
        placed_time(named("time")).alias("time_km"),
        leading_int(named("distance")).alias("distance"),
        named("driver").alias("driver"),
        local_number(named("prize")).alias("prize"),
        F.concat_ws("_", "race_date", "sigla", F.concat(F.lit("R"), F.col("section"))).alias("race_code"),
        "race_date",
        "track",
    )


#: Header names of each field, the preferred first.
HEADERS = {
    "race_date": ("data", "date"), "track": ("ippodromo", "pista", "track"), "placement_raw": ("pos", "piazzamento", "placement"), "time_km": ("tempo", "t/km", "time"),
    "distance": ("dist", "distanza", "distance"), "driver": ("driver", "guidatore"), "prize": ("montepremi", "premio", "prize"), "race_code": ("codice", "code", "id"),
}


def header_races(pages: DataFrame) -> DataFrame:
    """Races of pages (name, html) whose first table names its columns; other tables are not read."""
    body = table_rows(pages).filter("table = 1 and row > 0 and size(cells) >= 3").withColumn("__head", F.transform("head", lambda c: F.lower(c)))

    def field(n: str) -> Column:
        return F.coalesce(truthy(*(F.when(F.array_contains("__head", h), F.get("cells", (F.array_position(F.col("__head"), h) - 1).cast("int"))) for h in HEADERS[n])), F.lit(""))

    day = iso_date(truthy(field("race_date"), _cell(0)))
    prize = lenient_number(field("prize"))
    return body.filter(day.isNotNull()).select(
        F.upper("name").alias("horse_name"), day.alias("race_date"), field("track").alias("track"), leading_int(field("placement_raw")).alias("placement"), field("placement_raw").alias("placement_raw"),
        field("time_km").alias("time_km"), leading_int(field("distance")).alias("distance"), field("driver").alias("driver"), prize.alias("prize_net"), prize.alias("prize_gross"), field("race_code").alias("race_code"),
    )


#: Labels of a detail page, the words that tell a sex, and the labels that end a parent's name.
LABELS = {"birth_year": ("Nato nel", "Natoa nel", "Anno di nascita"), "country": ("Paese", "Nazionalità", "Nazionalita"), "sire": ("Padre",), "dam": ("Madre",), "record_career": ("Record",)}
MALE, FEMALE = ("maschio", "stallone", "geldone"), ("femmina", "fattrice", "puledra")
ENDS = {"sire": ("Madre", "Anno"), "dam": ("Padre", "Anno")}


def _first_sound(text: Column, field: str, value: Callable[[Column], Column]) -> Column:
    """The first ``value`` that is not null of what follows the field's labels, wherever they stand in the text; a label goes on with a colon or a blank."""
    after = F.split(text, "(?:" + "|".join(LABELS[field]) + ")(?=[: ])", -1)
    values = F.transform(F.slice(after, 2, F.greatest(F.size(after), F.lit(1))), lambda x: value(F.ltrim(x, F.lit(": "))))
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def detail_profile(pages: DataFrame) -> DataFrame:
    """Profile of a detail page (name, html): of each field the first sound value after one of its labels."""
    text = page_text(F.col("html"))
    words = F.split(F.lower(text), r"[^\p{L}]+")
    told = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    leading = lambda pattern: lambda x: F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))

    def name(field: str) -> Column:
        def value(x: Column) -> Column:
            parts = F.split(x, " (?=" + "|".join(ENDS[field]) + ")", 2)
            head = F.trim(F.get(parts, F.lit(0)))
            return F.when((F.size(parts) == 2) & (head != "") & (F.translate(head, "ABCDEFGHIJKLMNOPQRSTUVWXYZ' ", "") == ""), head)

        return _first_sound(text, field, value)

    return pages.select(
        "name",
        _first_sound(text, "birth_year", leading("^[0-9]{4}")).cast("int").alias("birth_year"),
        F.when(told(MALE), "M").when(told(FEMALE), "F").alias("sex"),
        _first_sound(text, "country", leading("^[A-Z]{2,3}")).alias("country"),
        name("sire").alias("sire"),
        name("dam").alias("dam"),
        _first_sound(text, "record_career", leading("^[0-9]+'[0-9]+\"[0-9]+")).alias("record_career"),
    )


def page_links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """``<id>, position, link``: all link targets, in order."""
    return pages.select(id_col, F.posexplode(links(F.col(html))).alias("position", "link"))


#: The id of links to result pages, and the page that they lead to.
RESULT_LINK, RESULT_PAGE = "link_risultati", "hRis.php?"


def meetings(pages: DataFrame, base: str) -> DataFrame:
    """Meetings that a home page (html) links to: ``data, sigla, ippodromo, note_giorno, url``, addresses going on from ``base``."""
    found = anchors(pages).filter((F.col("element") == RESULT_LINK) & F.regexp_extract("href", r"data=(\d{4}-\d{2}-\d{2})", 1).try_cast("date").isNotNull())
    value = lambda k: F.coalesce(url_value(F.col("href"), k), F.lit(""))
    query = F.get(F.split("href", r"\?", 2), F.lit(1))
    url = F.concat(F.lit(base), F.coalesce(F.concat(F.lit(RESULT_PAGE), query), F.col("href")))
    return found.select(F.substring(value("data"), 1, 10).alias("data"), value("sigla").alias("sigla"), value("ippodromo").alias("ippodromo"), value("note_giorno").alias("note_giorno"), url.alias("url"))


def horse_links(pages: DataFrame, base: str, id_col: str = "page_id") -> DataFrame:
    """``name, birth_year, url_detail``: horses that home pages link to, each (name, year) once; relative addresses go on from ``base``."""
    found = anchors(pages).withColumn("name", F.upper("label"))
    found = found.filter((F.contains(F.lower("href"), F.lit("cavallo")) | F.contains("href", F.lit("horse.php"))) & (F.length("name") >= 2))
    bracketed = F.substring_index(F.get(F.split(F.translate("name", "[]", "()"), r"\(", 2), F.lit(1)), ")", 1)
    four = lambda c: F.when(c.rlike("^[0-9]{4}$"), c).try_cast("int")
    year = F.coalesce(*(four(F.substring(url_value(F.col("href"), k), 1, 4)) for k in ("anno", "birth_year")), four(bracketed))
    url = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim("href", F.lit("/"))))
    return found.groupBy("name", year.alias("birth_year")).agg(F.min_by(url, F.struct(id_col, "at")).alias("url_detail"))


PEDIGREE = "array<map<string,struct<nome:string>>>"
#: Keys of the pedigree document and the columns they fill.
PEDIGREE_KEYS = {"p": "sire", "m": "dam", "pp": "sire_sire", "mp": "sire_dam", "pm": "dam_sire", "mm": "dam_dam"}


#: What precedes the data in the page, and the function that it is given to.
SCRIPT, CALL = "data:text/javascript;base64,", "populateTableWithJSON"


def pedigree_pages(pages: DataFrame) -> DataFrame:
    """``name`` and six ancestors from pedigree pages (name, html), whose data is a script in Base64."""
    scripts = F.slice(F.split("html", SCRIPT), 2, 1 << 20)
    decoded = F.transform(scripts, lambda s: F.decode(F.try_to_binary(F.substring_index(s, '"', 1), F.lit("base64")), "UTF-8"))
    call = F.get(F.filter(decoded, lambda s: F.contains(s, F.lit(CALL))), F.lit(0))
    # the first argument: what stands between the call and its second argument, without the comma between them
    first = F.get(F.split(F.get(F.split(call, CALL + r"\(", 2), F.lit(1)), "['\"]cavallo['\"]", 2), F.lit(0))
    document = F.from_json(F.trim(F.regexp_replace(first, ",\\s*$", "")), PEDIGREE)
    named = lambda k: canonical_name(F.get(F.filter(F.transform("__d", lambda m: F.try_element_at(m, F.lit(k))["nome"]), lambda x: x.isNotNull()), F.lit(0)))
    return pages.select("name", document.alias("__d")).select("name", *(named(k).alias(c) for k, c in PEDIGREE_KEYS.items()))


def best_codes(hits: DataFrame) -> DataFrame:
    """``name, codice``: of search hits (name, position, nome, codice) the one of the same canonical name, else the first."""
    exact = canonical_name(F.col("nome")) == canonical_name(F.col("name"))
    return hits.groupBy("name").agg(F.min_by("codice", F.struct(F.when(exact, 0).otherwise(1), "position")).alias("codice"))
