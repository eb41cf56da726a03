"""Mixing sources to target weights (problem 9), by hierarchical budgets and seeded epochs.

A mix is a tree: its domains, in each domain the sources with their target shares, and below each source its languages in
proportion to what they hold. The total is passed down by weight. A leaf holds at most its tokens times max_repeats; what
it can't take goes to its siblings that still can, by weight, and only what a whole source, then a whole domain, can't
take goes to the others. Without a given total, the total is the largest at which no source falls short, so all shares
are met; with "held" it is all tokens the mix's sources hold, at which short sources are made up for by others.

A leaf's budget is spent on whole epochs of its texts and on a prefix of one more, in an order seeded by mix, epoch and
text. The prefix is found without gathering a leaf anywhere: tokens are summed by 1024 ranges of the order's hash,
the ranges (leaves x 1024 rows) are accumulated, and only the range the budget ends in is accumulated by text.

Exact copies are one text, kept under its least doc_id and that row's source. Defined cases: texts without tokens, a
source or a doc_id are not used; a null language is a leaf of its own; shares are taken relative to their sum over the
sources that hold anything; a source named twice in a mix counts with its summed share and least max_repeats; sources
that hold nothing get nothing and are reported with a share of zero; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwell.llm.tokens import TOKENIZERS, with_tokens
from strandwell.records import trimmed
from strandwell.session import materialize

RANGE_BITS = 10
SEED = 11
#: The domain of each source; a source without one is a domain of its own. A parameter of all functions here.
DOMAINS = {"answers": "dialog", "tickets": "dialog", "wiki": "docs", "runbooks": "docs", "glossary": "docs", "release_notes": "docs", "code_review": "code", "sql_summaries": "code", "decisions": "code"}


def spread(total: float, weights: list[float], limits: list[float]) -> list[float]:
    """total by weight under limits; what one can't take goes to the others that still can."""
    out = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    left = total
    while open_ and left > 1e-9:
        share = sum(weights[i] for i in open_)
        full = [i for i in open_ if out[i] + left * weights[i] / share >= limits[i] - 1e-9]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / share
            return out
        for i in full:
            left -= limits[i] - out[i]
            out[i] = limits[i]
        open_ = [i for i in open_ if i not in full]
    return out


def budgets(targets: dict[str, tuple[float, int]], held: dict[tuple[str, str], int], total: float | str | None = None, domains: dict[str, str] = DOMAINS) -> dict[tuple[str, str], float]:
    """Tokens of each (source, language) leaf; targets: source to (share, max_repeats), held: tokens of each leaf; total: a number, "held" or none."""
    names = sorted(s for s in targets if any(k[0] == s and n > 0 for k, n in held.items()))
    weight = {s: max(0.0, targets[s][0]) for s in names}
    leaves = {s: sorted(k for k in held if k[0] == s) for s in names}
    limit = {s: float(sum(held[k] for k in leaves[s]) * max(0, targets[s][1])) for s in names}
    whole = sum(weight.values())
    if not whole:
        return {}
    if total is None:
        total = min(limit[s] * whole / weight[s] for s in names if weight[s] > 0)
    elif total == "held":
        total = float(sum(held[k] for s in names for k in leaves[s]))
    groups: dict[str, list[str]] = {}
    for s in names:
        groups.setdefault(domains.get(s, s), []).append(s)
    out: dict[tuple[str, str], float] = {}
    # What one source can't take goes to the others of its domain, and only what a domain can't take to other domains.
    for group, tokens in zip(groups.values(), spread(total, [sum(weight[s] for s in g) for g in groups.values()], [sum(limit[s] for s in g if weight[s] > 0) for g in groups.values()])):
        for s, part in zip(group, spread(tokens, [weight[s] for s in group], [limit[s] for s in group])):
            out |= dict(zip(leaves[s], spread(part, [float(held[k]) for k in leaves[s]], [float(held[k] * targets[s][1]) for k in leaves[s]])))
    return out


def texts_by_leaf(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, lang, tokens) of every distinct text, written once."""
    rows = documents.where((F.length("text") > 0) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.lower(trimmed("source")).alias("source"), F.coalesce(F.nullif(F.regexp_replace(F.lower(trimmed("lang")), r"[-_].*$", ""), F.lit("")), F.lit("?")).alias("lang"), F.md5("text").alias("digest"), "text"
    )
    first = rows.groupBy("digest").agg(F.min_by(F.struct("doc_id", "source", "lang", "text"), "doc_id").alias("r")).select("r.*").where(F.length("source") > 0)
    counted = with_tokens(first.select(F.struct("doc_id", "source", "lang").alias("key"), "text"), tokenizers)
    return materialize(counted.select("key.*", "tokens").where("tokens > 0"), "leaf-texts")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, tokenizers: str = TOKENIZERS, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """(mix_name, source, lang, doc_id, tokens, times) of every text used, times at most max_repeats."""
    texts = texts_by_leaf(documents, tokenizers)
    held = {(r.source, r.lang): r.tokens for r in texts.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()}  # one row a leaf
    wanted = targets.groupBy("mix_name", F.lower(trimmed("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats")).collect()  # a settings table
    rows = []
    for name in sorted({r.mix_name for r in wanted if r.mix_name}):
        mine = {r.source: (r.share or 0.0, r.repeats if r.repeats is not None else 1) for r in wanted if r.mix_name == name and r.source}
        for (source, lang), tokens in budgets(mine, held, total_tokens, domains).items():
            size = held[source, lang]
            epochs = int((tokens + 1e-6) // size)
            rows.append((name, source, lang, epochs, float(tokens - epochs * size) if epochs < mine[source][1] else 0.0))
    spark = documents.sparkSession
    plan = spark.createDataFrame(rows, "mix_name string, source string, lang string, epochs int, rest double")
    used = texts.join(plan, ["source", "lang"]).withColumn("h", F.xxhash64(F.lit(SEED), "mix_name", "epochs", "doc_id"))
    used = used.withColumn("rng", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    leaf = ["mix_name", "source", "lang"]
    sums = used.where("rest > 0").groupBy(*leaf, "rng").agg(F.sum("tokens").alias("t"), F.first("rest").alias("limit"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*leaf).orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.select(*leaf, "rng", before.alias("before"), (F.col("limit") - before).alias("room"), "t").where("room > 0")
    last = ranges.where("t > room").select(*leaf, "rng", "room")
    whole = used.join(ranges.where("t <= room").select(*leaf, "rng"), [*leaf, "rng"], "left_semi").select(*leaf, "doc_id")
    run = F.sum("tokens").over(Window.partitionBy(*leaf, "rng").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # The text the budget ends in is taken if that leaves the smaller error.
    edge = used.join(last, [*leaf, "rng"]).withColumn("run", run).where("run - tokens < room and run - room <= room - (run - tokens)").select(*leaf, "doc_id")
    extra = whole.unionByName(edge).withColumn("extra", F.lit(1))
    return used.join(extra, [*leaf, "doc_id"], "left").withColumn("times", F.col("epochs") + F.coalesce("extra", F.lit(0))).where("times > 0").select(*leaf, "doc_id", "tokens", "times")


def mix_shares(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, tokenizers: str = TOKENIZERS, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, moved_tokens, texts, most_times) of every source of every mix.

    moved_tokens: what the source got beyond its share of the mix's total, or, below zero, fell short of it by.
    """
    taken = mix(documents, targets, total_tokens, tokenizers, domains).groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count("*").alias("texts"), F.max("times").alias("most_times"))
    of_mix = Window.partitionBy("mix_name")
    total = F.sum("tokens").over(of_mix)
    wanted = targets.groupBy("mix_name", F.lower(trimmed("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    got = wanted.join(taken, ["mix_name", "source"], "left").na.fill(0, ["tokens", "texts", "most_times"])
    moved = F.round(F.col("tokens") - total * F.col("target_share") / F.sum("target_share").over(of_mix)).cast("bigint")
    return got.select("mix_name", "source", "target_share", F.round(F.coalesce(F.col("tokens") / total, F.lit(0.0)), 6).alias("actual_share"), "tokens", moved.alias("moved_tokens"), "texts", "most_times")
