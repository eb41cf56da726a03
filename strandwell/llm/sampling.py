"""Samples of bounded size that are the same at every partitioning, chosen by a hash of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def hash_sample(rows: DataFrame, key: str, n: int, stratum: str | None = None) -> DataFrame:
    """About n rows (of each value of stratum, of which there are few), those whose key has the least hashes; all where there are fewer.

    The hash's limit comes from counts, so a row is taken or left where it is read: nothing is sorted and nothing leaves the executors.
    """
    counts = rows.groupBy(F.lit("all").alias("s") if stratum is None else F.col(stratum).alias("s")).count().collect()
    hash_ = F.pmod(F.xxhash64(key), F.lit(_RANGE))
    taken = F.lit(False)
    for r in counts:
        part = hash_ < min(_RANGE, -(-_RANGE * n // r["count"]))
        taken = taken | (part if stratum is None else F.col(stratum).eqNullSafe(F.lit(r.s)) & part)
    return rows.where(taken)
