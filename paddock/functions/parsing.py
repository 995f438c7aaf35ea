"""Text fields of result pages as typed columns. Anything unreadable becomes null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: The finish markers of the career pages (degree sign) and of the result pages (ordinal indicator).
CAREER_MARK, RESULT_MARK = "°", "º"
#: Codes of runners without a placing.
UNPLACED = ("r.p.", "r.c.", "r.a.", "rit.", "tnc", "cad.", "disq.")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def iso_date(c: Column) -> Column:
    """``D/M/Y``, ``D-M-Y``, ``Y-M-D`` or ``Y/M/D`` at the start, as ISO text; the calendar is not checked."""
    t = F.trim(c)
    day_first, year_first = r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", r"^(\d{4})[/\-](\d{1,2})[/\-](\d{1,2})"

    def part(pattern: str, k: int, wide: int) -> Column:
        return F.lpad(F.regexp_extract(t, pattern, k), wide, "0")

    return F.when(t.rlike(day_first), F.concat_ws("-", part(day_first, 3, 4), part(day_first, 2, 2), part(day_first, 1, 2))).when(
        t.rlike(year_first), F.concat_ws("-", part(year_first, 1, 4), part(year_first, 2, 2), part(year_first, 3, 2))
    )


def lenient_number(c: Column) -> Column:
    """Digits, commas and points alone, commas as points; 0 if that is no number. Thousands points are not understood."""
    return F.coalesce(F.replace(F.regexp_replace(c, r"[^\d,.]", ""), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def local_number(c: Column) -> Column:
    """``2.150,50`` as 2150.5; 0 if that is no number."""
    return F.coalesce(F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def is_money(c: Column) -> Column:
    """Text of two or more digits, points and commas, the first a digit."""
    return F.coalesce(F.trim(c).rlike(r"^\d[\d.,]+$"), F.lit(False))


def leading_int(c: Column) -> Column:
    return _int(F.regexp_extract(c, r"^(\d+)", 1))


def placement(c: Column, mark: str = CAREER_MARK) -> Column:
    """The leading number, only where the finish marker stands in the text."""
    return F.when(F.contains(c, F.lit(mark)), leading_int(c))


def km_seconds(c: Column) -> Column:
    """Seconds a kilometre from ``1'14"6``, ``1.14.6`` or ``14.6`` (the minute goes without saying)."""
    t = F.trim(c.cast("string"))
    quoted, dotted, bare = r"^(\d+)'(\d+)\"(\d+)", r"^(\d+)\.(\d+)\.(\d+)$", r"^\d+(\.\d+)?$"

    def timed(p: str) -> Column:
        return F.regexp_extract(t, p, 1).try_cast("double") * 60 + F.regexp_extract(t, p, 2).try_cast("double") + F.regexp_extract(t, p, 3).try_cast("double") / 10

    return F.when(t.rlike(quoted), timed(quoted)).when(t.rlike(dotted), timed(dotted)).when(t.rlike(bare), t.try_cast("double") + 60.0)


def quoted_time(c: Column) -> Column:
    """``1.14.6`` as ``1'14"6``."""
    p = r"^(\d+)\.(\d+)\.(\d+)"
    return F.when(c.rlike(p), F.concat(F.regexp_extract(c, p, 1), F.lit("'"), F.regexp_extract(c, p, 2), F.lit('"'), F.regexp_extract(c, p, 3)))


def placed_time(c: Column) -> Column:
    """A time as it stands, unless it is a code of an unplaced runner or begins with no digit."""
    return F.when(c.rlike(r"^\d") & ~c.isin(*UNPLACED), c)


#: What the letters of a marker such as ``m.i.5`` stand for.
SEXES, ORIGINS = {"m": "M", "f": "F"}, {"i": "ITA", "e": "EST"}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it: in functions over arrays it would be anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _letters(table: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def _marker(word: Column) -> Column:
    """The three parts of a word that is a marker, whatever signs are around it; null for any other."""
    sound = lambda p: (F.size(p) == 3) & F.get(p, F.lit(0)).isin(*SEXES) & F.get(p, F.lit(1)).isin(*ORIGINS) & F.get(p, F.lit(2)).rlike("^[0-9]{1,2}$")
    return once(F.split(F.regexp_replace(word, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""), r"\."), lambda p: F.when(sound(p), p))


def _first(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def sex_country_age(text: Column) -> Column:
    """struct(sex, country, age) from the first marker such as ``m.i.5``."""

    def told(found: Column) -> Column:
        return F.struct(_letters(SEXES, F.get(found, F.lit(0))).alias("sex"), _letters(ORIGINS, F.get(found, F.lit(1))).alias("country"), _int(F.get(found, F.lit(2))).alias("age"))

    return once(_first(F.transform(_words(text), _marker)), told)


def birth_year(as_of: Column, age: Column) -> Column:
    return F.year(as_of) - age


#: So many characters after the marker can hold the parents.
NEAR = 200


def _name_before_prose(text: Column) -> Column:
    """The words before the first that begins in lower case, if there is one."""

    def before(words: Column) -> Column:
        prose = F.array_position(F.transform(words, lambda w: w.rlike(r"^\p{Ll}")), True)
        return once(prose, lambda p: F.when(p > 1, F.array_join(F.slice(words, F.lit(1), (p - 1).cast("int")), " ")))

    return once(_words(text), before)


def _name(text: Column) -> Column:
    """Text that begins with a capital, without blanks at its ends; null otherwise."""
    return once(F.trim(text), lambda bare: F.when(bare.rlike("^[A-Z]"), bare))


def parents(text: Column) -> Column:
    """struct(sire, dam): ``SIRE / DAM`` and then prose soon after the sex and age marker, else ``SIRE / code / DAM`` anywhere.

    In the second form the sire is the words in capitals that end at the code, the dam those that follow it.
    """

    def near(words: Column, at: Column) -> Column:
        tail = F.substring(F.array_join(F.slice(words, at + 1, F.size(words)), " "), 1, NEAR)
        both = lambda halves: F.struct(_name(F.get(halves, F.lit(0))).alias("sire"), _name(_name_before_prose(F.get(halves, F.lit(1)))).alias("dam"))
        return F.when(at > 0, once(F.split(tail, "/", 2), lambda halves: F.when(F.size(halves) == 2, both(halves))))

    def shouted(c: Column, last: bool) -> Column:
        """The run of words without small letters at the end, or at the beginning."""

        def run(w: Column) -> Column:
            small = F.array_position(F.transform(w, lambda x: x.rlike(r"\p{Ll}") | (x == "")), True)
            kept = once(small, lambda n: F.when(n > 0, F.slice(w, F.lit(1), (n - 1).cast("int"))).otherwise(w))
            return F.nullif(F.array_join(F.reverse(kept) if last else kept, " "), F.lit(""))

        w = F.split(F.trim(c), r"\s+")
        return once(F.reverse(w) if last else w, run)

    def triple(parts: Column) -> Column:
        code = lambda k: F.trim(F.get(parts, k)).rlike("^[A-Za-z][0-9]*$")
        each = F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1)))
        return _first(F.transform(each, lambda k: F.when(code(k), F.struct(shouted(F.get(parts, k - 1), True).alias("sire"), shouted(F.get(parts, k + 1), False).alias("dam")))))

    def chosen(found: Column) -> Column:
        other = once(once(F.split(text, "/"), triple), lambda t: F.struct(t["sire"].alias("sire"), t["dam"].alias("dam")))
        return F.when(found["sire"].isNotNull() & found["dam"].isNotNull(), found).otherwise(other)

    placed = lambda words: once(F.array_position(F.transform(words, lambda w: _marker(w).isNotNull()), True).cast("int"), lambda at: near(words, at))
    return once(once(_words(text), placed), chosen)


def url_value(url: Column, key: str) -> Column:
    """A query parameter of an address, decoded."""
    return F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1), F.lit("")))


def links(html: Column) -> Column:
    """The targets of all links of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def result_row(row: Column) -> Column:
    """One pipe-delimited result row: struct(name, placement, time_km, distance, driver, prize, is_classified), null if it
    is a rule, too short or without a name. Placed runners have eight cells; others lack the first, and name the driver
    sixth where prizes are given, seventh where the sex is."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(row), r"^\|+|[|\s]+$", ""), r"\|"), lambda x: F.trim(x))
    at = lambda k: F.coalesce(F.get(cells, F.lit(k)), F.lit(""))
    placed = F.contains(at(0), F.lit(RESULT_MARK))
    pick = lambda a, b: F.when(placed, at(a)).otherwise(at(b))
    name = F.upper(F.trim(pick(3, 2)))
    driver = F.when(placed, at(7)).when((at(5) != "") & ~at(5).rlike("^(A|F|P|AP|M)$"), at(5)).otherwise(at(6))
    return F.when(
        (F.size(cells) >= 4) & ~at(0).startswith("--") & (F.length(name) >= 2),
        F.struct(
            name.alias("name"),
            F.when(placed, leading_int(at(0))).alias("placement"),
            placed_time(pick(4, 3)).alias("time_km"),
            leading_int(pick(5, 4)).alias("distance"),
            driver.alias("driver"),
            F.when(placed & is_money(at(6)), local_number(at(6))).otherwise(0.0).alias("prize"),
            placed.alias("is_classified"),
        ),
    )
