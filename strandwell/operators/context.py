"""Materializing texts under budgets, and the orders they are taken in.

Token counts are approximate (four characters a token, at least one for any text) unless a counter is given. A budget
fold takes items in order and skips what does not fit; later, smaller items may still fit. Folds run within a request's
own candidates (its top-k), never over a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIG = 10000  # fixed value: the place of what has none


def chunk_order() -> list[Column]:
    """By rank, then distance, each last where there is none, then the shorter path."""
    return [F.coalesce(F.col("rank"), F.lit(BIG)), F.coalesce(F.col("distance"), F.lit(float(BIG))), F.length(F.coalesce("path", F.lit("")))]


def dialog_tokens(turns: DataFrame, session: str, question: str, answer: str) -> DataFrame:
    """(session, tokens) of whole dialogs."""
    return turns.groupBy(session).agg(F.sum(approx_tokens(question) + approx_tokens(answer)).alias("tokens"))


def union_in_order(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct keys of first, then those of second that first has not: (key, part)."""
    a = first.select(key).distinct().withColumn("part", F.lit(0))
    return a.unionByName(second.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("part", F.lit(1)))


def compaction_rule(rules: list[dict], language: str) -> dict | None:
    """The first rule whose language is the text's, or any (`*` or none)."""
    return next((r for r in rules if str(r.get("language") or "*").lower() in ("*", language.lower())), None)


def approx_tokens(text: str | Column) -> Column:
    n = F.length(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def budget_tokens(max_chars: int | None = None, budget: int | None = None, max_context: int | None = None) -> int:
    """max_chars or budget, not both; else seven tenths of the context."""
    if max_chars and budget:
        raise ValueError("max_chars and budget_tokens exclude each other")
    if max_chars:
        return max(1, max_chars // 4)
    if budget:
        return budget
    if not max_context:
        raise ValueError("no budget is given")
    return int(0.7 * max_context)


def greedy_fit(items: DataFrame, key: str, order: str, size: str, capacity: int) -> DataFrame:
    """Of each key's items in order, those a skipping budget takes; an aggregate fold over the ordered array of one request."""
    packed = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"), F.struct(*[c for c in items.columns if c != key]).alias("row")))).alias("xs"))
    kind = packed.schema["xs"].dataType.elementType
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind.simpleString()}>").alias("kept"))
    fold = F.aggregate("xs", start, lambda a, x: F.when(a.used + x.s <= capacity, F.struct((a.used + x.s).alias("used"), F.concat(a.kept, F.array(x)).alias("kept"))).otherwise(a))
    return packed.select(key, F.explode(fold.kept).alias("k")).select(key, "k.row.*")


def newest_that_fit(turns: DataFrame, key: str, order: list[Column], size: Column, capacity: int) -> DataFrame:
    """The newest rows whose running size stays within capacity: oldest are dropped first."""
    run = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("running", run).where(F.col("running") <= capacity)


def interleaved(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a's first, b's first, a's second ...; both have a rank within key."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank", "side"))
    return both.withColumn("place", place)


def seeds_then_rest(seeds: DataFrame, graph: DataFrame, key: str, node: str) -> DataFrame:
    """Seeds in rank order, then graph nodes that are no seed by (depth, node)."""
    rest = graph.join(seeds.select(key, node), [key, node], "left_anti")
    both = seeds.select(key, node, F.lit(0).alias("part"), F.col("rank").alias("a")).unionByName(rest.select(key, node, F.lit(1).alias("part"), F.col("depth").alias("a")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("part", "a", node)))


def rest_then_seeds(seeds: DataFrame, graph: DataFrame, key: str, node: str) -> DataFrame:
    """Graph nodes that are no seed by (depth, node), then seeds in rank order."""
    rest = graph.join(seeds.select(key, node), [key, node], "left_anti")
    both = rest.select(key, node, F.lit(0).alias("part"), F.col("depth").alias("a")).unionByName(seeds.select(key, node, F.lit(1).alias("part"), F.col("rank").alias("a")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("part", "a", node)))


def balanced(seeds: DataFrame, graph: DataFrame, key: str, node: str) -> DataFrame:
    """A seed, a graph node, a seed ...: seeds by rank, graph nodes that are no seed by (depth, node)."""
    rest = graph.join(seeds.select(key, node), [key, node], "left_anti")
    ranked = rest.select(key, node, F.row_number().over(Window.partitionBy(key).orderBy("depth", node)).alias("rank"))
    return interleaved(seeds.select(key, node, "rank"), ranked, key)


def node_block(title: str = "NODE") -> Column:
    """The fixed text of a node in a context."""
    line = lambda label, c: F.when(F.length(F.col(c)) > 0, F.concat(F.lit(f"{label}: "), F.col(c)))
    return F.concat_ws("\n", F.lit(f"--- {title} ---"), line("id", "canonical_id"), line("path", "repo_relative_path"), line("class", "class_name"), line("member", "member_name"), F.coalesce(F.col("text"), F.lit("")), F.lit(f"--- END {title} ---"))


def with_divider(new_blocks: str | Column, divider: str) -> Column:
    """A divider before new blocks that have none."""
    c = F.col(new_blocks) if isinstance(new_blocks, str) else new_blocks
    return F.when(c.startswith(divider), c).otherwise(F.concat(F.lit(divider + "\n"), c))


def without_divider(block: str | Column, divider: str) -> Column:
    c = F.col(block) if isinstance(block, str) else block
    return F.when(c.startswith(divider + "\n"), F.substring(c, F.lit(len(divider) + 2), F.length(c))).otherwise(c)


def transactional_append(existing: list[str], incoming: list[str], budget: int, count) -> tuple[list[str], str]:
    """All incoming blocks or none: (blocks, `ok` or `over`). Incoming that alone exceeds the budget is an error."""
    size = sum(count(b) for b in incoming)
    if size > budget:
        raise ValueError("the incoming blocks never fit the budget")
    if sum(count(b) for b in existing) + size > budget:
        return existing, "over"
    return [*existing, *incoming], "ok"


def needs_compaction(mode: str, used: int, budget: int, threshold: float = 1.0, demanded: bool = False) -> bool:
    if mode == "always":
        return True
    if mode == "demand":
        return demanded
    if mode == "threshold":
        if not 0 < threshold <= 1:
            raise ValueError("a threshold is above 0 and at most 1")
        return used > threshold * budget
    return False


def budget_contract(n_ctx: int, fixed: int, history: int, context: int, output: int, margin: int = 128, policy: str = "fail_fast") -> dict[str, int]:
    """fixed + history + context + output + margin within n_ctx; auto_clamp lowers context, then history, then output."""
    over = fixed + history + context + output + margin - n_ctx
    if over > 0 and policy != "auto_clamp":
        raise ValueError(f"the budget exceeds the context by {over} tokens")
    parts = {"context": context, "history": history, "output": output}
    for name in parts:
        cut = min(parts[name], max(0, over))
        parts[name] -= cut
        over -= cut
    if over > 0:
        raise ValueError("the fixed part alone exceeds the context")
    return {"fixed": fixed, "margin": margin, **parts}
