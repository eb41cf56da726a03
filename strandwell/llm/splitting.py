"""Cutting oversized texts at natural boundaries (problem 6), by lexical-cohesion segmentation.

Blocks of lines before and after each line end are compared by the cosine of their hashed term counts. Valleys of that
similarity mark topic boundaries; each cut goes to the deepest valley among the line ends within the size window, and
the next piece starts the given overlap before the cut. A window without any line end lies inside one long line and is
cut after the last blank, separator or bracket in it, or at its end if it has none.

Pieces are text[start:end] of the text as stored, in code points: each is at most max_chars long, two neighbours share
exactly `overlap` characters, and the pieces without their overlaps put together are the text again. No cut parts a CR
from its LF.

Defined cases: null, empty and short enough texts give no pieces; an overlap of half the limit or more is reduced to
less than half, as pieces could not advance otherwise; a limit under two characters is refused; file types are compared
without case and leading dot, one not listed or null takes the row `*`, and without such a row the record is left out.
Repeated rows of a record are cut once. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwell.records import trimmed, valid_rows

BLOCK_LINES = 6  # lines on each side of a boundary that are compared
TERM_BUCKETS = 64
PART_LINES = 16_384  # lines whose terms are held at once
LEAST_FILL = 0.5  # a piece is at least this part of the limit unless the text ends
_TERM = re.compile(r"[A-Za-z]{2,}")
_SOFT = re.compile(r"[\s,;:.(){}\[\]<>|&]+")
_CUT = "digest string, max_chars int, overlap_chars int, cut_kind string, chunk_part int, chunk_total int, start_char int, end_char int, text string"


def _line_ends(text: str) -> list[int]:
    ends, i = [], text.find("\n")
    while i >= 0:
        ends.append(i + 1)
        i = text.find("\n", i + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def boundary_depths(text: str, ends: list[int]) -> np.ndarray:
    """How deep the similarity valley at each line end is; blank lines and lower indents deepen it a little.

    A text of very many lines is measured part by part, each with the lines around it that its boundaries are compared with.
    """
    n, near = len(ends), 2 * BLOCK_LINES + 1
    parts = []
    for a in range(0, n, PART_LINES):
        b = min(n, a + PART_LINES)
        lo, hi = max(0, a - near), min(n, b + near)
        parts.append(_depths(text, ends[lo - 1] if lo else 0, ends[lo:hi])[a - lo : b - lo])
    return np.concatenate(parts)


def _depths(text: str, begin: int, ends: list[int]) -> np.ndarray:
    n = len(ends)
    indent = np.zeros(n, np.float32)
    blank = np.zeros(n + 1, bool)
    known: dict[str, int] = {}
    cells: list[int] = []
    for k, end in enumerate(ends):
        line = text[begin:end]
        bare = line.strip()
        blank[k] = not bare
        indent[k] = line.index(bare[0]) if bare else 99
        row = (k + 1) * TERM_BUCKETS
        for term in _TERM.findall(bare):
            at = known.get(term)
            if at is None:
                at = known[term] = zlib.crc32(term.lower().encode()) % TERM_BUCKETS
            cells.append(row + at)
        begin = end
    counts = np.bincount(np.array(cells, np.int64), minlength=(n + 1) * TERM_BUCKETS).reshape(n + 1, TERM_BUCKETS).astype(np.float32)
    total = np.cumsum(counts, axis=0)
    at = np.arange(1, n)
    left = total[at] - total[np.maximum(at - BLOCK_LINES, 0)]
    right = total[np.minimum(at + BLOCK_LINES, n)] - total[at]
    norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
    like = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0.0)
    # Depth: how far similarity rises from the boundary to the peaks within a block on either side.
    pad = np.pad(like, BLOCK_LINES, mode="edge") if len(like) else like
    peak_l = np.max([pad[BLOCK_LINES - k : len(pad) - BLOCK_LINES - k] for k in range(BLOCK_LINES + 1)], axis=0) if len(like) else like
    peak_r = np.max([pad[BLOCK_LINES + k : len(pad) - BLOCK_LINES + k] for k in range(BLOCK_LINES + 1)], axis=0) if len(like) else like
    depth = (peak_l - like) + (peak_r - like) + 0.3 * blank[:-1][: n - 1] + 0.1 * (indent[1:] <= np.minimum(indent[:-1], 4))
    return np.concatenate((depth, [9.0]))  # the end of the text is always natural


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most limit characters that cover text, neighbours sharing overlap characters."""
    overlap = max(0, min(overlap, (limit - 1) // 2))
    ends = _line_ends(text)
    depth = boundary_depths(text, ends)
    at = np.array(ends)
    spans, start, last = [], 0, 0
    while len(text) - start > limit:
        least = max(start + overlap, last) + 1  # every piece reaches beyond the one before
        i, j = np.searchsorted(at, max(least, start + int(limit * LEAST_FILL))), np.searchsorted(at, start + limit, side="right")
        if i >= j:  # no line end in the window proper: any one that gets on will do
            i = np.searchsorted(at, least)
        if i < j:
            end = int(at[i + int(np.argmax(depth[i:j]))])
        else:
            end = start + limit
            found = [m.end() for m in _SOFT.finditer(text, least - 1, end) if least <= m.end() <= end]
            if found:
                end = found[-1]
            if text[end - 1] == "\r" and text[end : end + 1] == "\n" and end - 1 >= least:
                end -= 1
        spans.append((start, end))
        before, start, last = start, end - overlap, end
        if text[start - 1] == "\r" and text[start : start + 1] == "\n" and start - 1 > before and end - start + 2 < limit:
            start -= 1  # the overlap takes the whole CRLF
    spans.append((start, len(text)))
    return spans


def _is_inside(text: str, limit: int) -> bool:
    return any(len(line[:-1] if line.endswith("\r") else line) > limit for line in text.split("\n"))


def _cutter(with_text: bool):
    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "max_chars", "overlap_chars", "cut_kind", "chunk_part", "chunk_total", "start_char", "end_char", "text"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("digest", "max_chars", "overlap_chars"))))
            rows: list[tuple] = []
            for i, (key, scalar) in enumerate(zip(keys, b.column("text"))):
                text = scalar.as_py()
                spans = cut(text, key[1], key[2])
                kind = "inside" if _is_inside(text, key[1]) else "line"
                rows += [(*key, kind, k, len(spans), s, e, text[s:e] if with_text else None) for k, (s, e) in enumerate(spans, 1)]
                if len(rows) > 500 or i + 1 == len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []

    return cut_all


def clean_type(file_type: str | Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(file_type)), r"^\.", "")


def oversized(nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """(canonical_id, digest, text, max_chars, overlap_chars) of the rows that are too long for their file type."""
    own = limits.select(clean_type("file_type").alias("kind"), "max_chars", "overlap_chars").where(F.col("max_chars") >= 2)
    rest = own.where(F.col("kind") == "*").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("m")).select("m.*").first()  # a settings table
    rows = valid_rows(nodes).select("canonical_id", "text", clean_type("file_type").alias("kind"))
    limited = rows.join(own.where(F.col("kind") != "*").dropDuplicates(["kind"]), "kind", "left")
    other = [F.lit(v).cast("int") for v in (rest.max_chars, rest.overlap_chars)]
    limited = limited.withColumns({"max_chars": F.coalesce("max_chars", other[0]), "overlap_chars": F.coalesce("overlap_chars", other[1], F.lit(0))})
    return limited.where(F.length("text") > F.col("max_chars")).select("canonical_id", F.md5("text").alias("digest"), "text", "max_chars", "overlap_chars")


def split_oversized(nodes: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of every oversized record, chunk_part from 1 to chunk_total; each distinct text is cut once."""
    rows = oversized(nodes, limits)
    case = ["digest", "max_chars", "overlap_chars"]
    # A record whose rows disagree in file type takes the smallest limit.
    records = rows.groupBy("canonical_id", "digest").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("m")).select("canonical_id", "digest", "m.*")
    texts = rows.groupBy(*case).agg(F.first("text").alias("text"))
    pieces = texts.mapInArrow(_cutter(with_text), _CUT)
    return records.join(pieces, case).select("canonical_id", "cut_kind", "chunk_part", "chunk_total", "start_char", "end_char", "text")


def oversized_found(nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """(canonical_id, cut_kind) of every record that is cut."""
    return split_oversized(nodes, limits, with_text=False).where(F.col("chunk_part") == 1).select("canonical_id", "cut_kind").distinct()
