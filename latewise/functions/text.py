"""Station names, tokens and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Single-character foldings, then the word rewrite, then separators to blank.
FOLD_CHARS_FROM = "üöäéèêáà"
FOLD_CHARS_TO = "uoaeeeaa"
FOLD_MULTI = [("ß", "ss"), ("hauptbahnhof", "hbf")]
FOLD_SEPARATORS = "-.,"


def fold_name(name) -> Column:
    """Diacritic- and separator-insensitive form of a station name: lower case, umlauts
    and accents plain, 'hauptbahnhof' -> 'hbf', '-', '.', ',' -> blank, blanks squeezed."""
    s = F.lower(_c(name))
    s = F.translate(s, FOLD_CHARS_FROM, FOLD_CHARS_TO)
    for a, b in FOLD_MULTI:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.translate(s, FOLD_SEPARATORS, " " * len(FOLD_SEPARATORS))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def name_tokens(name) -> Column:
    """Distinct tokens of at least 4 letters (letters a-z and umlauts) of a name."""
    toks = F.split(F.lower(_c(name)), "[^a-zäöüß]+")
    return F.array_distinct(F.filter(toks, lambda t: F.length(t) >= 4))


def names_overlap(a, b) -> Column:
    return F.arrays_overlap(name_tokens(a), name_tokens(b))


def coordinates_from_lid(lid) -> Column:
    """struct(lat, lon) from ``@X=<lon micro-deg>@Y=<lat micro-deg>@``; NULL if absent."""
    m = _c(lid)
    x = F.regexp_extract(m, r"@X=(-?\d+)@Y=(-?\d+)@", 1)
    y = F.regexp_extract(m, r"@X=(-?\d+)@Y=(-?\d+)@", 2)
    return F.when(x != "", F.struct((y.cast("long") / 1e6).alias("lat"), (x.cast("long") / 1e6).alias("lon")))


def geo_distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance in km (fine at the ~2 km scale it is used for)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dx = (lon2 - lon1) * 111.32 * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * 111.32
    return F.sqrt(dx * dx + dy * dy)
