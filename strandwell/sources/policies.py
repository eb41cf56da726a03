"""Access policies from tables, a database or a JSON file, as one table (group_name, users, acl, labels, pipelines, level, owner)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.operators.security import assembled_policies

TABLES = ("groups", "users", "acl", "labels", "pipelines", "limits")


def policies_from(tables: dict[str, DataFrame]) -> DataFrame:
    """The six tables as policies; a table that is not there is an error."""
    missing = [t for t in TABLES if t not in tables]
    if missing:
        raise ValueError(f"missing policy tables: {', '.join(missing)}")
    return assembled_policies(**{t: tables[t] for t in TABLES})


def read_policy_tables(spark: SparkSession, root: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """From a folder of parquet tables, or a database's tables of the same names."""
    if (root is None) == (jdbc is None):
        raise ValueError("either a folder or a database is given")
    load = (lambda t: spark.read.parquet(f"{root}/{t}.parquet")) if root is not None else (lambda t: spark.read.format("jdbc").options(**jdbc, dbtable=t).load())
    return policies_from({t: load(t) for t in TABLES})


_LISTS = ("users", "acl", "labels", "pipelines")
_POLICY = "struct<" + ",".join(f"{c}:array<string>" for c in _LISTS) + ",level:int,owner:string>"


def read_policy_file(spark: SparkSession, path: str) -> DataFrame:
    """From a JSON object of group name to policy; fields that are not there are empty, unknown ones are ignored. A settings file."""
    whole = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"map<string,{_POLICY}>")).alias("group_name", "p"))
    empty = F.array().cast("array<string>")
    lists = [F.array_sort(F.array_distinct(F.coalesce(F.col(f"p.{c}"), empty))).alias(c) for c in _LISTS]
    return whole.where("trim(group_name) <> ''").select("group_name", *lists, F.col("p.level").alias("level"), F.nullif(F.trim("p.owner"), F.lit("")).alias("owner"))
