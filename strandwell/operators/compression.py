"""Retrieved chunks as one text under a token budget: headers, or headers with cleaned code.

Code is only left out whole, never cut: the fold of a request stops at the first header or block that no longer fits.
A request's chunks are its top-k, cut to max_chunks before anything is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.functions.code_text import cleaned_code
from strandwell.operators.context import approx_tokens, chunk_order
from strandwell.records import trimmed

MODES = ("metadata", "snippets", "two_stage")


def snippet(content: str | Column, hits: str | Column, window: int = 18, gap: int = 3) -> Column:
    """The lines within `window` of a hit line, windows that nearly touch as one; all lines where there are no hits."""
    c = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    h = F.col(hits) if isinstance(hits, str) else hits
    lines = F.split(c, "\r\n|\r|\n")
    last = F.size(lines)
    places = F.array_sort(F.transform(h, lambda x: F.greatest(F.lit(1), F.least(last, x)).cast("int")))
    # A line is shown if a hit is near, or if it lies in a gap between two windows that is no wider than `gap` lines.
    near = lambda i: F.exists(places, lambda x: F.abs(x - i) <= window)
    between = lambda i: F.exists(places, lambda x: (i > x + window) & (i < x + window + gap) & F.exists(places, lambda y: (y > x) & (i < y - window) & (y - window <= x + window + gap)))
    shown = F.filter(F.transform(lines, lambda line, i: F.struct(line.alias("line"), (i + 1).alias("n"))), lambda r: near(r["n"]) | between(r["n"]))
    return F.when(F.coalesce(F.size(h), F.lit(0)) <= 0, c).otherwise(F.array_join(F.transform(shown, lambda r: r["line"]), "\n"))


def header(prefix: str = "- ") -> Column:
    """path : namespace.class.member (Lfrom-to)."""
    name = F.concat_ws(".", F.when(F.col("class") != "", F.nullif(F.col("namespace"), F.lit(""))), F.nullif("class", F.lit("")), F.nullif("member", F.lit("")))
    span = F.when((F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")), F.concat(F.lit(" (L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit(prefix), F.coalesce(F.nullif("path", F.lit("")), F.lit("<unknown>")), F.lit(" : "), F.coalesce(F.nullif(name, F.lit("")), F.lit("<symbol>")), span)


def compressed(chunks: DataFrame, mode: str = "metadata", budget: int = 1200, window: int = 18, max_chunks: int = 8, language: str = "cs", request: str = "request") -> DataFrame:
    """(request, context) of chunks (request, path, namespace, class, member, start_line, end_line, rank, distance, content, hit_lines).

    Chunks come in the order of chunk_order; metadata and two_stage keep the first of each path, snippets of each path and member.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    with_code = mode == "snippets"
    part = F.coalesce(F.nullif("member", F.lit("")), F.nullif("class", F.lit("")), F.concat_ws("-", "start_line", "end_line")) if with_code else F.lit("")
    order = [*chunk_order(), F.col("path").asc_nulls_first(), F.col("start_line").asc_nulls_first()]
    first = chunks.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(request, "path", "_part").orderBy(*order))).where("_n = 1")
    few = first.withColumn("_n", F.row_number().over(Window.partitionBy(request).orderBy(*order))).where(F.col("_n") <= max(1, max_chunks))
    code = trimmed(cleaned_code(snippet("content", "hit_lines", window), language)) if with_code else F.lit("")
    fence = "```csharp\n" if language == "cs" else "```\n"
    few = few.withColumn("_code", code).withColumns({"_head": header(), "_block": F.when(F.col("_code") != "", F.concat(F.lit(fence), F.col("_code"), F.lit("\n```")))})
    few = few.withColumns({"_hc": approx_tokens(F.concat("_head", F.lit("\n"))), "_bc": approx_tokens(F.concat("_block", F.lit("\n")))})
    items = few.groupBy(request).agg(F.sort_array(F.collect_list(F.struct("_n", "_head", "_block", "_hc", "_bc", F.sha1("_code").alias("_dup")))).alias("xs"))
    texts = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), texts.alias("lines"), texts.alias("seen"))

    def step(a: Column, x: Column) -> Column:
        over = a["used"] + x["_hc"] > budget
        new = x["_block"].isNotNull() & ~F.array_contains(a["seen"], x["_dup"])
        fits = a["used"] + x["_hc"] + x["_bc"] <= budget
        headed = F.concat(a["lines"], F.array(x["_head"]))
        only_head = F.struct((a["used"] + x["_hc"]).alias("used"), (new & ~fits).alias("full"), headed.alias("lines"), a["seen"].alias("seen"))
        both = F.struct((a["used"] + x["_hc"] + x["_bc"]).alias("used"), F.lit(False).alias("full"), F.concat(headed, F.array(x["_block"])).alias("lines"), F.concat(a["seen"], F.array(x["_dup"])).alias("seen"))
        stop = F.struct(a["used"].alias("used"), F.lit(True).alias("full"), a["lines"].alias("lines"), a["seen"].alias("seen"))
        return F.when(a["full"], a).when(over, stop).when(new & fits, both).otherwise(only_head)

    folded = F.aggregate("xs", start, step)
    return items.select(request, F.concat(F.array_join(folded["lines"], "\n"), F.lit("\n")).alias("context"))
