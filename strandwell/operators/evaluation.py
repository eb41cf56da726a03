"""Evaluating batches: confusion and accuracy, summaries by category, worst cases, scores read from reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) of every pair that occurs; nulls are a class of their own."""
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, n, n_right, accuracy) of each class; a null prediction is wrong."""
    right = F.count_if(F.coalesce(F.col(actual) == F.col(predicted), F.lit(False)))
    return rows.groupBy(F.col(actual).alias("actual")).agg(F.count("*").alias("n"), right.alias("n_right")).withColumn("accuracy", F.round(F.col("n_right") / F.col("n"), 6))


def category_summary(rows: DataFrame, category: str, score: str) -> DataFrame:
    """(category, n, mean, least, most) of a score."""
    return rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.min(score).alias("least"), F.max(score).alias("most"))


def worst(rows: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n rows of the least scores, null scores first, later keys first among equals: a report."""
    return rows.orderBy(score, F.desc(key)).limit(n)


def score_of(report: str | Column) -> Column:
    """0 to 10 from a report: a JSON object's `score`, else `n/10`, else 0."""
    c = F.col(report) if isinstance(report, str) else report
    given = F.regexp_extract(c, r'(?s)\{.*?"score"\s*:\s*"?(-?\d+)', 1)
    ratio = F.regexp_extract(c, r"\b(\d{1,2})\s*/\s*10\b", 1)
    score = F.coalesce(given.try_cast("int"), ratio.try_cast("int"), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(10), score))


def score_bucket(score: str | Column) -> Column:
    """The folder of a score: 0, 01 to 09, 10."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c <= 0, "0").when(c >= 10, "10").otherwise(F.lpad(c.cast("string"), 2, "0"))


def assessed(rows: DataFrame, report: str = "report") -> DataFrame:
    """rows with score and bucket read from their reports."""
    return rows.withColumn("score", score_of(report)).withColumn("bucket", score_bucket("score"))
