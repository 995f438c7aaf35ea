"""Canonical names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Invisible characters that scraped names hold (zero-width characters, marks, byte-order mark, soft hyphen).
INVISIBLE = "[\\u200B\\u200C\\u200D\\u200E\\u200F\\uFEFF\\u2060\\u00AD]"


def canonical_name(c: Column) -> Column:
    """Upper case, invisible characters as blanks, runs of any white space as one blank, none at the ends. Null and empty stay."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, INVISIBLE, " "), r"(?U)\s+", " ")))


def plain_key(c: Column) -> Column:
    """Upper case without blanks at the ends."""
    return F.upper(F.trim(c))


def first_letter(c: Column) -> Column:
    return F.substring(c, 1, 1)


def truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def race_code(day: Column, code: Column, track: Column, number: Column) -> Column:
    """``day_code``, or ``day_track_number`` where there is no code."""
    return F.when(F.coalesce(code, F.lit("")) != "", F.concat_ws("_", day, code)).otherwise(F.concat_ws("_", day, F.coalesce(track, F.lit("")), F.coalesce(number, F.lit(""))))


#: Country codes of results and of registers, with their two-letter codes.
COUNTRIES = {
    "ITA": "IT", "FRA": "FR", "USA": "US", "SWE": "SE", "NOR": "NO", "DEN": "DK", "FIN": "FI", "GER": "DE", "AUS": "AU", "NZL": "NZ", "CAN": "CA", "NED": "NL", "BEL": "BE", "SUI": "CH", "AUT": "AT",
    "RUS": "RU", "UKR": "UA", "HUN": "HU", "POL": "PL", "CZE": "CZ", "SLO": "SI", "CRO": "HR", "SER": "RS", "ROM": "RO", "GBR": "GB", "IRE": "IE", "ESP": "ES", "POR": "PT",
    "I": "IT", "F": "FR", "A": "US", "S": "SE", "N": "NO", "D": "DK", "SF": "FI", "G": "DE",
}
#: Names of countries, by code.
COUNTRY_NAMES = {
    "ITA": "Italia", "FRA": "Francia", "USA": "USA", "SWE": "Svezia", "NOR": "Norvegia", "DEN": "Danimarca", "FIN": "Finlandia", "GER": "Germania", "AUS": "Australia", "NZL": "Nuova Zelanda", "CAN": "Canada",
    "NED": "Paesi Bassi", "BEL": "Belgio", "GBR": "Gran Bretagna", "IRE": "Irlanda", "I": "Italia", "F": "Francia", "A": "USA", "S": "Svezia", "N": "Norvegia", "D": "Danimarca", "SF": "Finlandia", "G": "Germania",
}
#: Nationalities of well-known sires, for rows that have none.
KNOWN_SIRES = {
    "VARENNE": "ITA", "FACE TIME BOURBON": "FRA", "MAHARAJAH": "SWE", "NAD AL SHEBA": "SWE", "LOVE YOU": "FRA", "READY CASH": "FRA", "MUSCLE HILL": "USA", "MUSCLE MASS": "USA", "VIKING KRONOS": "ITA", "TIMOKO": "FRA",
    "COKTAIL JET": "FRA", "CONWAY HALL": "USA", "OROPURO BAR": "ITA", "FILIPP ROC": "ITA", "WISHING STONE": "USA", "PINE CHIP": "USA", "DONATO HANOVER": "USA", "FATHER PATRICK": "USA", "SJ'S PHOTO": "USA", "GANYMEDE": "ITA",
    "INDY DE VIVE": "FRA", "AMERICAN WINNER": "USA", "SPEEDY SOMOLLI": "USA", "WAIKIKI BEACH": "USA", "MUSCLES YANKEE": "USA", "QUOUKY WILLIAMS": "FRA", "GARLAND LOBELL": "USA", "SUPER BOWL": "USA", "GIANT CHILL": "SWE",
    "WINDSONG'S LEGACY": "USA", "AND ARIFANT": "FRA", "IMOKO": "FRA", "EXTREME DREAM": "FRA", "GIS DELL'OLMO": "ITA", "INCREDIBLE RUN": "ITA",
}


def _looked_up(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def nationality(given: Column, name: Column, default: str = "ITA") -> Column:
    """A given nationality in upper case, else that of a well-known sire of the name, else the default."""
    return F.coalesce(F.upper(truthy(given)), _looked_up(KNOWN_SIRES, F.upper(name)), F.lit(default))


def flag(given: Column, name: Column) -> Column:
    """The flag of the nationality, two regional indicator letters; empty for a code that is not known."""
    two = _looked_up(COUNTRIES, nationality(given, name))
    letters = {chr(65 + i): chr(0x1F1E6 + i) for i in range(26)}
    return F.coalesce(F.concat(*(_looked_up(letters, F.substring(two, k, 1)) for k in (1, 2))), F.lit(""))


def country_name(code: Column) -> Column:
    """The country's name, or the code where that is not known."""
    return F.coalesce(_looked_up(COUNTRY_NAMES, F.upper(code)), code)
