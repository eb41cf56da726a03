"""The record view of a node table.

A record is a distinct canonical_id with at least four `::` parts; its snapshot is the second part and its key
everything after it. Rows with a null, empty or shorter id are refused. The other identifying columns are not trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_parts(canonical_id: str | Column = "canonical_id") -> Column:
    return F.split(canonical_id, "::")


def valid_rows(nodes: DataFrame) -> DataFrame:
    """Rows of nodes that belong to a record."""
    return nodes.where(F.size(id_parts()) >= 4)


def snapshot_of(canonical_id: str | Column = "canonical_id") -> Column:
    return F.element_at(id_parts(canonical_id), 2)


def key_of(canonical_id: str | Column = "canonical_id") -> Column:
    """The id without repo and snapshot; the local id may itself hold `::`."""
    parts = id_parts(canonical_id)
    return F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "::")


def trimmed(col: str | Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(F.regexp_replace(col, r"(?U)^\s+", ""), r"(?U)(?<!\s)\s+$", "")


def instant(col: str | Column) -> Column:
    """An instant from ISO text with or without zone (UTC), epoch seconds or milliseconds, or an RFC 1123 date; else null."""
    c = trimmed(F.col(col) if isinstance(col, str) else col)
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
    zoned = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|z|UTC|GMT|[+-]\d{2}:?\d{2})$"
    rfc = r"^(?:[A-Za-z]{3}, )?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC|Z|[+-]0000)$"
    plus = F.regexp_replace(F.regexp_replace(c, r"\s*(z|UTC|GMT)$", "Z"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return (
        F.when(c.rlike(iso), F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00Z"))).otherwise(F.concat(c, F.lit("Z"))).try_cast("timestamp"))
        .when(c.rlike(zoned), plus.try_cast("timestamp"))
        .when(c.rlike(r"^\d{12,14}$"), F.timestamp_millis(c.try_cast("long")))
        .when(c.rlike(r"^\d{9,11}$"), F.timestamp_seconds(c.try_cast("long")))
        .when(c.rlike(rfc), F.try_to_timestamp(F.concat(F.regexp_extract(c, rfc, 1), F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z")))
    )
