"""Schemas of pair files, gazetteer dumps and frequent-term lists, and the pair id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = "s1 string, s2 string, res string, c1 string, c2 string, a1 string, a2 string, cc1 string, cc2 string"
#: The columns of a GeoNames dump.
GAZETTEER = ", ".join(
    f"{c} string"
    for c in (
        "geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class", "feature_code", "country_code", "cc2",
        "admin1_code", "admin2_code", "admin3_code", "admin4_code", "population", "elevation", "dem", "timezone", "modification_date",
    )
)
TERMS = "term string, no long"
GROUP = "struct<a: array<string>, b: array<string>, len: int, char_len: int>"
SPLIT = f"struct<base: {GROUP}, mismatch: {GROUP}, special: {GROUP}>"


def label(res: Column) -> Column:
    """1.0 for TRUE in any case, else 0.0."""
    return F.when(F.upper(res) == "TRUE", 1.0).otherwise(0.0)


def pair_id(*columns: str) -> Column:
    """An id that depends on a pair's values alone."""
    return F.xxhash64(*columns)
