"""Near-duplicate records by pigeonhole blocks over set fingerprints (problem 4).

A text's fingerprint is the set of 64-bit hashes of its runs of three tokens, and the Hamming distance of two texts is
the number of shingles only one of them has. Similarity >= t is the same as distance <= (1-t)/(1+t) * (|A|+|B|), and
a text A of n shingles can lose at most d = n - ceil(t*n) of them against any partner. So split A's fingerprint, in an
order common to all texts, into its first d+s elements and the rest: by the pigeonhole principle s of the first d+s survive
in every partner, and both sides of a close pair share at least s such blocks (SHARED; fewer only where the smaller text
has fewer). Texts are joined on blocks, pairs that share s are candidates, and the distance of each candidate is verified
exactly, so no pair is lost and none is invented.

The common order is rarest first, by a counting sketch of fixed size over the fingerprints of all texts: blocks made
of boilerplate come last and are hardly ever joined on. The order decides only how many candidates there are.

Each distinct text is handled once however many records and snapshots hold it. It bears a 64-bit signature of its
snapshots, and texts whose signatures share no bit are no candidates; whether they do share a snapshot is checked at the
end, where copies are put back. Blocks that very many texts hold are split into cells in which each pair meets once.
A 64-bit SimHash was not used: at a Jaccard similarity of 0.7 the angle of two texts lets about 12 of 64 bits differ, and
blocks that tolerate this are three bits wide.

Defined cases: null, empty and shorter texts have no shingles and are like nothing; repeated rows are one record;
records of incomplete snapshots count; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwell.records import snapshot_of, valid_rows
from strandwell.session import materialize

SHINGLE = 3  # tokens in a run
SIMILARITY = (7, 10)  # the threshold as a fraction
SKETCH_BITS = 18  # 2**18 counters whatever the data's size
SLICE_BYTES = 1 << 19  # text bytes hashed at a time
SHARED = 4  # blocks that a close pair shares at least
HOT = 2048  # texts of a block that are compared in one cell
_SHINGLED = r"\A[^a-z0-9_]*+(?:[a-z0-9_]++[^a-z0-9_]++){%d}[a-z0-9_]" % (SHINGLE - 1)
_MASK = np.uint64((1 << SKETCH_BITS) - 1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[[*range(48, 58), *range(97, 123), 95]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray, offsets: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), sorted and distinct, of the texts data[offsets[i]:offsets[i+1]] (lower-cased UTF-8)."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(data)
    if not n:
        return empty
    word = _IS_TOKEN[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(word & (first[:n] | np.concatenate(([True], ~word[:-1]))))
    if not len(starts):
        return empty
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(word & (last | np.concatenate((~word[1:], [True])))) + 1
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _P, np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
    inverse = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _P_INV, np.uint64))))
    token = _mixed((total[ends] - total[starts]) * inverse[starts])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    if len(token) < run:
        return empty
    shingle = np.zeros(len(token) - run + 1, np.uint64)
    for k in range(run):
        shingle = _mixed(shingle * np.uint64(0x2545F4914F6CDD1D) + token[k : len(token) - run + 1 + k])
    whole = owner[: len(shingle)] == owner[run - 1 :]
    shingle, owner = shingle[whole], owner[: len(whole)][whole]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    if len(shingle):
        new = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])))
        shingle, owner = shingle[new], owner[new]
    return owner, shingle


def shingle_sets(texts: pa.Array, run: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, sizes, hashes) of slices of lower-cased texts; hashes are sorted within each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
        owner, shingle = _hashed(data[at[i] : at[j]], at[i : j + 1] - at[i], run)
        yield i, j, np.bincount(owner, minlength=j - i), shingle
        i = j


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(text_no, digest, sig, text) of every distinct text with a shingle, written once; sig has a bit for each snapshot that holds it, by hash."""
    bit = F.expr("shiftleft(1L, int(pmod(xxhash64(snapshot), 64)))")
    each = rows.where(F.lower("text").rlike(_SHINGLED)).select(F.md5("text").alias("digest"), snapshot_of().alias("snapshot"), "text").withColumn("sig", bit)
    texts = each.groupBy("digest").agg(F.bit_or("sig").alias("sig"), F.first("text").alias("text"))
    return materialize(texts.select(F.monotonically_increasing_id().alias("text_no"), "digest", "sig", "text"), "texts")


def _low(texts: DataFrame) -> DataFrame:
    return texts.select("text_no", "sig", F.lower("text").alias("low"))


def fingerprints(texts: DataFrame) -> DataFrame:
    """(text_no, size, shingles) of every text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sizes, hashes in shingle_sets(b.column("low")):
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("text_no").slice(i, j - i), pa.array(sizes.astype(np.int32)), lists], names=["text_no", "size", "shingles"])

    return _low(texts).mapInArrow(hashed, "text_no bigint, size int, shingles array<bigint>").where("size > 0")


def shingle_weights(texts: DataFrame) -> np.ndarray:
    """How many texts' shingles fall on each of 2**SKETCH_BITS counters: over all texts, of one size whatever theirs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for _, _, _, hashes in shingle_sets(b.column("low")):
                total += np.bincount((hashes & _MASK).astype(np.int64), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = _low(texts).mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    weights = np.zeros(1 << SKETCH_BITS, np.int64)
    weights[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return weights


def blocks(texts: DataFrame, similarity: tuple[int, int] = SIMILARITY, hot: int = HOT) -> DataFrame:
    """(block, side, text_no, sig, size, position): of each text the d+SHARED rarest shingles, SHARED of which every partner shares.

    A block that more than `hot` texts may hold is split: its texts are hashed to s groups, and a text of group g goes to the s cells
    {g, h}. Each pair of texts meets in one cell, which holds about 2 * hot texts; side is the text's group in a cell of two, else -1.
    """
    found = shingle_weights(texts)
    noise = float(found.mean())  # what a counter holds by chance of other shingles
    weights = texts.sparkSession.sparkContext.broadcast(np.minimum(found, 0xFFFFFFFF).astype(np.uint32))  # 1 MB, fixed
    num, den = similarity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, sigs = (b.column(c).to_numpy(zero_copy_only=False) for c in ("text_no", "sig"))
            for i, _, sizes, hashes in shingle_sets(b.column("low")):
                owner = np.repeat(np.arange(len(sizes)), sizes)
                weight = weights.value[(hashes & _MASK).astype(np.int64)]
                order = np.lexsort((hashes, weight, owner))
                position = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = position < np.repeat(sizes - (num * sizes + den - 1) // den + SHARED, sizes)
                key, weight, at, position = hashes[order][keep], weight[order][keep], owner[keep], position[keep]
                side = np.full(len(key), -1, np.int32)
                parts = np.maximum(1, np.ceil((weight - noise) / hot)).astype(np.int64)
                if (parts > 1).any():
                    key, side, at, position = _cells(key, parts, numbers[i + at], at, position)
                for k in range(0, len(key), 1 << 15):
                    part = slice(k, k + (1 << 15))
                    own = at[part]
                    columns = [key[part].view(np.int64), side[part], numbers[i + own], sigs[i + own], sizes[own].astype(np.int32), position[part].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "side", "text_no", "sig", "size", "position"])

    return _low(texts).mapInArrow(cut, "block bigint, side int, text_no bigint, sig bigint, size int, position int")


def _cells(key: np.ndarray, parts: np.ndarray, numbers: np.ndarray, at: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of split blocks once for each cell they belong to."""
    group = (_mixed(numbers.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(len(key)), parts)
    other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    mine, split = group[row], parts[row] > 1
    cell = np.minimum(mine, other) * parts[row] + np.maximum(mine, other) + 1
    key = np.where(split, _mixed(key[row] ^ _mixed(cell.astype(np.uint64))), key[row])
    return key, np.where(split & (mine != other), mine, -1).astype(np.int32), at[row], position[row]


def similar_texts(texts: DataFrame, similarity: tuple[int, int] = SIMILARITY, hot: int = HOT) -> DataFrame:
    """(a, b, common), a < b: pairs of distinct texts at least that similar that may share a snapshot."""
    num, den = similarity
    x = blocks(texts, similarity, hot).repartition("block")  # one shuffle that both sides of the join read
    y = x.select("block", *[F.col(c).alias(f"{c}_b") for c in ("side", "text_no", "sig", "size", "position")])
    # What may be common at most where one of the first SHARED common elements has these positions, against what must be.
    may = F.least(F.col("size") - F.col("position"), F.col("size_b") - F.col("position_b")) + (SHARED - 1)
    need = F.least(F.lit(SHARED), F.ceil(F.greatest("size", "size_b") * num / den))
    pairs = materialize(
        x.join(y, "block")
        .where((F.col("text_no") < F.col("text_no_b")) & (F.col("sig").bitwiseAND(F.col("sig_b")) != 0) & ((F.col("side") < 0) | (F.col("side") != F.col("side_b"))))
        .where((F.col("size") * num <= F.col("size_b") * den) & (F.col("size_b") * num <= F.col("size") * den))
        .where(may * (num + den) >= (F.col("size") + F.col("size_b")) * num)
        .groupBy(F.col("text_no").alias("a"), F.col("text_no_b").alias("b"))
        .agg(F.count("*").alias("shared"), F.max(need).alias("need"))
        .where("shared >= need")
        .select("a", "b"),
        "candidates",
    )
    # Only texts of candidates are fingerprinted again for the exact check.
    asked = pairs.select(F.col("a").alias("text_no")).unionByName(pairs.select(F.col("b").alias("text_no"))).distinct()
    prints = fingerprints(texts.join(asked, "text_no", "left_semi"))
    pa_, pb = prints.select(F.col("text_no").alias("a"), F.col("shingles").alias("sa"), F.col("size").alias("na")), prints.select(F.col("text_no").alias("b"), F.col("shingles").alias("sb"), F.col("size").alias("nb"))
    common = F.size(F.array_intersect("sa", "sb"))
    # Hamming distance na + nb - 2 common <= (den - num) / (den + num) * (na + nb)
    return (
        pairs.join(pa_, "a").join(pb, "b")
        .select("a", "b", "na", "nb", common.alias("common"))
        .where((F.col("na") + F.col("nb") - 2 * F.col("common")) * (den + num) <= (den - num) * (F.col("na") + F.col("nb")))
        .select("a", "b", "common")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component; edges (a, b) of comparable ids, nodes without any are not listed.

    Alternating large and small stars: each round hangs nodes on the least neighbour they know, so the number of rounds grows
    with the logarithm of a component's size. Only minima are aggregated; no neighbourhood is ever gathered.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small, "stars")
        if not new.exceptAll(e).limit(1).count() and not e.exceptAll(new).limit(1).count():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        e = new


def _texts_and_records(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct texts, and records (canonical_id, snapshot, text_no)."""
    rows = valid_rows(nodes)
    texts = distinct_texts(rows)
    ids = rows.where(F.length("text") > 0).select("canonical_id", snapshot_of().alias("snapshot"), F.md5("text").alias("digest")).distinct()
    return texts, materialize(ids.join(texts.select("digest", "text_no"), "digest").select("canonical_id", "snapshot", "text_no"), "records")


def near_duplicate_groups(nodes: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(canonical_id, snapshot_id, class_id, group_id, n_links) of every record with shingles: its class of equal texts, its
    group of classes linked within the snapshot, and the number of other classes its own is linked to. One row a record."""
    texts, records = _texts_and_records(nodes)
    members = records.select("text_no", F.col("snapshot").alias("bucket")).distinct()
    pairs = materialize(similar_texts(texts, similarity).select("a", "b"), "similar")
    m = members.select("bucket", F.col("text_no").alias("a")), members.select("bucket", F.col("text_no").alias("b"))
    links = pairs.join(m[0], "a").join(m[1], ["b", "bucket"])
    vertex = lambda c: F.concat_ws("/", "bucket", F.lpad(F.col(c).cast("string"), 20, "0"))
    roots = components(links.select(vertex("a").alias("a"), vertex("b").alias("b")))
    both = links.select("bucket", "a").unionByName(links.select("bucket", F.col("b").alias("a")))
    degree = both.groupBy("bucket", "a").agg(F.count("*").alias("n_links")).select(vertex("a").alias("node"), "n_links")
    out = records.withColumn("node", F.concat_ws("/", "snapshot", F.lpad(F.col("text_no").cast("string"), 20, "0")))
    return out.join(roots, "node", "left").join(degree, "node", "left").select(
        "canonical_id", F.col("snapshot").alias("snapshot_id"), F.col("node").alias("class_id"), F.coalesce("root", "node").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def near_duplicate_pairs(nodes: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(canonical_id_a, canonical_id_b), a < b: all record pairs of one snapshot at least that similar."""
    texts, records = _texts_and_records(nodes)
    pairs = similar_texts(texts, similarity)
    a = records.select(F.col("canonical_id").alias("ida"), "snapshot", F.col("text_no").alias("a"))
    b = records.select(F.col("canonical_id").alias("idb"), "snapshot", F.col("text_no").alias("b"))
    near = pairs.select("a", "b").join(a, "a").join(b, ["b", "snapshot"]).select("ida", "idb")
    same = a.join(b, (a.a == b.b) & (a.snapshot == b.snapshot) & (F.col("ida") < F.col("idb"))).select("ida", "idb")
    return near.unionByName(same).select(F.least("ida", "idb").alias("canonical_id_a"), F.greatest("ida", "idb").alias("canonical_id_b"))
