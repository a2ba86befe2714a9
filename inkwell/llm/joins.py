"""Joins whose strategy does not rest on guessed sizes.

The optimizer takes an array for one element, so its guess of a table of arrays can be far below the truth; what it would broadcast
then does not fit. Sides that grow with the data are joined by sorting (split by the adaptive plan where keys are skewed);
a side is broadcast only after its rows have been counted up to a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may be broadcast: so many rows with so many bytes of text and arrays.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4 << 20


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join by sorting both sides."""
    return left.join(right.hint("merge"), on, how)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table (read from where it was written) may be broadcast; no more rows than may be are looked at."""
    wide = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            wide = wide + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array<"):
            wide = wide + 8 * F.coalesce(F.size(name), F.lit(0))
    many, much = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(wide), F.lit(0))).first()
    return many <= rows and much <= size


def spread_join(entries: DataFrame, found: DataFrame, key: list[str], by: list[str], salts: int = 16) -> DataFrame:
    """entries with the columns of found, null where there is none. found has a row per key, in a table; where it is not small, entries of one key go to several tasks by a salt of the columns by."""
    if small(found):
        return entries.join(F.broadcast(found), key, "left")
    salted = found.withColumn("__salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return merged(entries.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")), salted, [*key, "__salt"], "left").drop("__salt")
