"""Garbled text from wrong character encoding (problem 10), by a hidden Markov model over characters.

One state is clean text, one is text whose characters are lost, and there is one for each pair of a right and a wrong
encoding (and for text that went wrong twice). A state's emissions are those of the clean character-pair model on what
its characters become when the pair is undone: a sequence of characters that stands for one is emitted with its first,
the others come free, and characters that can't be undone nearly rule the state out. ASCII is the same in all states, so
it only carries a state on, and labels are decided for all other characters, each on its own: clean quotation marks around
a garbled word stay as they are. A change of state costs SWITCH nats.

Emissions depend on a cluster of such characters and its neighbours only, so they are computed once for each that is met.
A document in which no state gains SWITCH on any stretch has a clean best path and needs no decoding; the others are
decoded together, step by step, by Viterbi. Each stretch of one label gets its state's inverse transform; where
characters are lost for good, U+FFFD stays in their place.

The clean model counts the character pairs of all documents, whole, on the executors; further counts leave out the documents
that the model so far finds damaged. Only counts reach the driver.

Defined cases: null, empty and ASCII texts are clean; entities, decomposed letters, signs and box drawings are clean;
repeated rows give one row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PASSES = 3  # counts; from the second on, documents found damaged are left out
ALPHABET = 1500  # characters that the model tells apart
RARE_CHARS = 4_200_000  # in so many characters a pair must be met more than once, or it counts as unseen
SWITCH = 7.0
NEVER = -45.0
LOST = -22.0  # nats of a sequence that is broken
LOST_GAIN = 12.0  # of a lost character in the state of lost text
LEAST_GAIN = 5.0  # nats a document's labels must gain over clean in all
RARE_COST = 1.0  # nats of each character in a state that is seldom met
TWICE_COST = 1.0  # and in one of text that went wrong twice
MIXED_COST = 10.0  # of an unseen pair of letters of two scripts
BATCH_CHARS = 1 << 20  # characters labelled together
CACHE = 50_000  # clusters whose emissions are kept

#: (wrong encodings the text was read with, last first; right encoding)
PAIRS: list[tuple[tuple[str, ...], str]] = [
    *[((w,), "utf-8") for w in ("cp1252", "latin-1", "cp1250", "iso8859-2", "mac-roman", "cp437", "cp850", "cp852", "cp1251", "koi8-u", "cp866", "cp1254")],
    *[((w,), "cp1250") for w in ("cp1252", "latin-1", "iso8859-2", "cp1251", "cp852", "mac-roman")],
    *[((w,), "iso8859-2") for w in ("cp1252", "latin-1", "cp1250", "cp1251")],
    *[((w,), "cp1251") for w in ("cp1252", "latin-1", "koi8-u", "cp866", "mac-roman", "cp1250")],
    *[((w,), "koi8-u") for w in ("cp1251", "cp1252", "latin-1", "cp866")],
    *[((w,), "cp1252") for w in ("cp1250", "iso8859-2", "cp1251", "mac-roman", "cp437", "cp850", "koi8-u")],
    *[((w,), "cp852") for w in ("cp1250", "cp1252", "latin-1")],
    *[((w,), "cp850") for w in ("cp1252", "latin-1")],
    *[((w,), "mac-roman") for w in ("cp1252", "latin-1")],
    *[((w,), "cp866") for w in ("cp1251", "cp1252")],
    *[((w, v), "utf-8") for w in ("cp1252", "latin-1") for v in ("cp1252", "latin-1", "cp1250")],
    (("cp1250", "cp1250"), "utf-8"),
]
USUAL = [((w,), "utf-8") for w in ("cp1252", "latin-1", "cp1250", "mac-roman", "cp437", "cp850", "cp1251")] + [(("cp1252",), "cp1250"), (("cp1252",), "iso8859-2"), (("cp1252",), "cp1251"), (("cp1251",), "koi8-u"), (("mac-roman",), "cp1252"), (("cp1250",), "cp1252"), (("cp1252", "cp1252"), "utf-8")]
STATES = ["clean", "lost", *[f"{right} as {' as '.join(reversed(wrong))}" for wrong, right in PAIRS]]


def _bytes(text: str, encoding: str) -> bytes | None:
    """text's bytes in encoding; bytes it doesn't define come as the control characters of the same number."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        out = bytearray()
        for c in text:
            try:
                out += c.encode(encoding)
            except UnicodeEncodeError:
                if not "\x80" <= c <= "\x9f":
                    return None
                out.append(ord(c))
        return bytes(out)


def undone(run: str, wrong: tuple[str, ...], right: str) -> str | None:
    """run as it was before it was read wrongly; None if it can't have been."""
    text = run
    for k, w in enumerate(wrong):
        data = _bytes(text, w)
        if data is None:
            return None
        last = k == len(wrong) - 1
        try:
            text = data.decode("utf-8" if not last else right)
        except UnicodeDecodeError:
            if right != "utf-8":
                return None
            text = data.decode("utf-8", "replace")
            if text.count("�") * 2 > sum(c > "\x7f" for c in text):
                return None
    return text if text != run else None


_REPLACEMENT = 0xFFFD
_NO_CHAR = 0xFFFF


def _byte_table(encoding: str) -> np.ndarray:
    """The byte of each character; -1 for characters without one. Bytes that are not defined are the control characters of the same number."""
    table = np.full(1 << 16, -1, np.int16)
    for b in range(256):
        try:
            c = ord(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            continue
        table[c] = b
    for b in range(0x80, 0xA0):
        if table[b] < 0:
            table[b] = b
    return table


def _char_table(wrong: str, right: str) -> np.ndarray:
    """What each character becomes in the right single-byte encoding; _NO_CHAR where that is nothing."""
    data = _byte_table(wrong)
    chars = np.full(257, _NO_CHAR, np.uint16)
    for b in range(256):
        try:
            chars[b] = ord(bytes([b]).decode(right))
        except UnicodeDecodeError:
            pass
    return chars[data]


def _sequences(c: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, character, byte) at each place: the UTF-8 sequence whose bytes the characters from there on stand for; length 0 where none begins."""
    b = np.concatenate((table[c], np.full(3, -1, np.int16))).astype(np.int64)
    b0, b1, b2, b3 = b[:-3], b[1:-2], b[2:-1], b[3:]
    follows = [(x & 0xC0 == 0x80) & (x >= 0) for x in (b1, b2, b3)]
    two = (b0 >= 0xC2) & (b0 <= 0xDF) & follows[0]
    three = (b0 >= 0xE0) & (b0 <= 0xEF) & follows[0] & follows[1]
    four = (b0 >= 0xF0) & (b0 <= 0xF4) & follows[0] & follows[1] & follows[2]
    code = np.where(two, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(three, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, _NO_CHAR))
    three &= (code >= 0x800) & ~((code >= 0xD800) & (code < 0xE000))
    return np.where(two, 2, np.where(three, 3, np.where(four, 4, 0))), np.minimum(code, _NO_CHAR), b0


class Model:
    """Log-likelihoods of clean text by character pairs, and what the states make of a text's characters."""

    def __init__(self, codes: np.ndarray, n: np.ndarray) -> None:
        # Thresholds and smoothing are those of RARE_CHARS characters: damage that repeats in a large corpus stays rare.
        n = n * min(1.0, RARE_CHARS / max(1.0, n.sum()))
        before, after = codes >> 16, codes & 0xFFFF
        singles = np.bincount(after, weights=n, minlength=1 << 16)
        total = singles.sum() + 1
        known = np.argsort(-singles, kind="stable")[:ALPHABET]
        known = np.union1d(np.arange(128), known[singles[known] > 1])
        capitals = [ord(u) for c in known if c > 127 and not 0xD800 <= c < 0xE000 and len(u := chr(c).upper()) == 1 and ord(u) < _NO_CHAR]
        known = np.union1d(known, np.array(capitals, np.int64))
        self.ids = np.zeros(1 << 16, np.int32)
        self.ids[known] = np.arange(1, len(known) + 1)
        single = np.full(len(known) + 1, -16.0, np.float32)
        often = singles[known] > 1
        single[1:][often] = np.log(singles[known][often] / total)
        small = [ord(c) if len(c := chr(k).lower()) == 1 and ord(c) < _NO_CHAR and not 0xD800 <= k < 0xE000 else k for k in known]
        single = np.maximum(single, np.where(np.array([0, *small]) != np.array([0, *known]), single[[0, *self.ids[small]]] - 4.0, single)).astype(np.float32)
        table = np.broadcast_to(single - 2.0, (len(single), len(single))).copy()
        letters = [chr(c) if c < 0xD800 or c > 0xDFFF else "" for c in known]
        script = np.array([0, *(1 if c.isalpha() and ord(c) < 0x250 else 2 if c.isalpha() and 0x400 <= ord(c) < 0x500 else 0 for c in letters)])
        table[(script[:, None] * script[None, :]) == 2] -= MIXED_COST
        keep = (n > 1) & (self.ids[before] > 0) & (self.ids[after] > 0)
        seen = np.zeros(table.shape, bool)
        i, j = self.ids[before[keep]], self.ids[after[keep]]
        table[i, j] = np.log((n[keep] + 0.1) / (singles[before[keep]] + 30.0))
        seen[i, j] = True
        # Capitals, of which there are few, as their small letters.
        small = np.array([0, *self.ids[small]])
        lower = np.array([False, *(c.islower() for c in letters)])
        upper = np.flatnonzero([False, *(c.isupper() for c in letters)])
        for j in upper:
            can = ~lower & ~seen[:, j] & seen[small, small[j]]
            table[can, j] = table[small[can], small[j]] - 2.0
        self.table = table
        self.seen: dict[str, np.ndarray] = {}
        self.most: dict[str, float] = {}
        self.bytes_of = {w: _byte_table(w) for wrong, _ in PAIRS for w in wrong}
        self.chars_of = {(wrong[0], right): _char_table(wrong[0], right) for wrong, right in PAIRS if right != "utf-8"}

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.table[self.ids[a], self.ids[b]]

    def _emitted(self, c: np.ndarray, at: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Nats at the places `at`, where chars stand for lengths characters of c each; every ASCII character is a place."""
        after = np.append(at[1:], len(c))
        plain = c[np.minimum(after, len(c) - 1)] < 128
        before = np.concatenate(([10], chars[:-1]))
        return self._pairs(before, chars) + np.where(plain, self._pairs(chars, c[np.minimum(at + lengths, len(c) - 1)]), 0.0)

    def _undone_utf8(self, c: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Nats at each place of c when read back through UTF-8, once or twice."""
        at, chars, lengths = np.arange(len(c)), c, np.ones(len(c), np.int64)
        broken = np.zeros(len(c), bool)
        for table in tables:
            n, code, byte = _sequences(chars, table)
            inside = np.zeros(len(chars) + 4, bool)
            for k in (1, 2, 3):
                inside[k : k + len(n)] |= n > k
            inside = inside[: len(chars)]
            first = ~inside
            bad = first & (n == 0) & (chars > 127)
            steps = np.maximum(n, 1)
            ends = np.append(at, len(c))[np.minimum(np.arange(len(chars)) + steps, len(chars))]
            lost = bad & ((byte >= 0x80) | (chars == _REPLACEMENT))
            kept = np.flatnonzero(first)
            broken = (broken | bad)[kept]
            # A broken sequence is one lost character, what has no byte at all can't be in this state.
            chars = np.where(lost, _REPLACEMENT, np.where(bad, _NO_CHAR, np.where(n > 0, code, chars)))[kept]
            lengths = (ends - at)[kept]
            at = at[kept]
        nats = self._emitted(c, at, chars, lengths)
        nats = np.where(broken, np.where(chars == _REPLACEMENT, LOST, NEVER), nats)
        out = np.zeros(len(c), np.float32)
        out[at] = nats
        return out

    def emissions(self, c: np.ndarray) -> np.ndarray:
        """Nats of each state for each character of c that is not ASCII."""
        high = np.flatnonzero(c > 127)
        every, ones = np.arange(len(c)), np.ones(len(c), np.int64)
        out = np.empty((len(high), len(STATES)), np.float32)
        out[:, 0] = self._emitted(c, every, c, ones)[high]
        out[:, 1] = np.where(c[high] == _REPLACEMENT, out[:, 0] + LOST_GAIN, NEVER)
        for s, (wrong, right) in enumerate(PAIRS, 2):
            if right == "utf-8":
                nats = self._undone_utf8(c, [self.bytes_of[w] for w in wrong])[high]
            else:
                chars = self.chars_of[wrong[0], right][c]
                nats = np.where(chars == _NO_CHAR, NEVER, self._emitted(c, every, chars, ones))[high]
            cost = RARE_COST * (PAIRS[s - 2] not in USUAL) + TWICE_COST * (len(wrong) - 1)
            out[:, s] = np.where(nats == 0, 0, nats - cost)  # 0 only within a sequence
        return out


_CLUSTER = re.compile(r"[^\x00-\x7f]+")


def _learn(model: Model, keys: list[str]) -> None:
    """Emissions of clusters that are new, each with its neighbours; with each the most that a state gains on a stretch of it."""
    chars = np.frombuffer(("\n" + "\n".join(keys) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.minimum(chars, _NO_CHAR).astype(np.int64)
    nats = model.emissions(chars)
    starts = np.cumsum([0] + [len(k) + 1 for k in keys])
    bounds = np.searchsorted(np.flatnonzero(chars > 127), starts)
    for key, i, j in zip(keys, bounds[:-1], bounds[1:]):
        model.seen[key], model.most[key] = nats[i:j].copy(), max(0.0, _most(nats[i:j, 1:] - nats[i:j, :1]))


def _most(gain: np.ndarray) -> float:
    """The largest gain of one state on one stretch: by sums up to here less the least sum before."""
    total = np.cumsum(gain, axis=0, dtype=np.float32)
    least = np.minimum.accumulate(np.vstack((np.zeros((1, gain.shape[1]), np.float32), total[:-1])), axis=0)
    return float((total - least).max())


def viterbi(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The best path of each sequence of emissions (characters x states), all sequences in step."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(parts)
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    i = 0
    while i < len(order):
        longest = len(parts[order[i]])
        part = order[i : i + max(1, BATCH_CHARS // 4 // max(1, longest))]
        i += len(part)
        lens = np.array([len(parts[k]) for k in part])
        states = parts[part[0]].shape[1]
        alive = np.searchsorted(-lens, -np.arange(longest), side="left")
        starts = np.concatenate(([0], np.cumsum(alive)))
        score = np.full((len(part), states), -SWITCH, np.float32)
        score[:, 0] = 0
        stays = np.empty((starts[-1], states), bool)
        came = np.empty(starts[-1], np.int8)
        grid = np.empty((starts[-1], states), np.float32)
        for r, k in enumerate(part):
            grid[starts[: lens[r]] + r] = parts[k]
        for t in range(longest):
            a, here = alive[t], slice(starts[t], starts[t + 1])
            s = score[:a]
            best = s.argmax(1)
            jump = s[np.arange(a), best] - SWITCH
            # A state may not be entered within a sequence: what is emitted with its first character costs nothing here.
            jump = np.where(grid[here] == 0, -np.inf, jump[:, None])
            keeps = s >= jump
            stays[here], came[here] = keeps, best
            score[:a] = np.where(keeps, s, jump) + grid[here]
        state = score.argmax(1)
        paths = [np.zeros(n, np.int8) for n in lens]
        flat = np.empty(starts[-1], np.int8)
        for t in range(longest - 1, -1, -1):
            a, base = alive[t], starts[t]
            flat[base : base + a] = state[:a]
            kept = stays[base + np.arange(a), state[:a]]
            state[:a] = np.where(kept, state[:a], came[base : base + a])
        for r, k in enumerate(part):
            paths[r] = flat[starts[: lens[r]] + r]
            out[k] = paths[r]
    return out


def labels(model: Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(from, to, state) of the stretches of each text that are not clean on its best path."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    clusters = [[m.span() for m in _CLUSTER.finditer(text)] for text in texts]
    keys = [[text[b - 1 if b else 0 : e + 1] for b, e in parts] for text, parts in zip(texts, clusters)]
    if len(model.seen) > CACHE:
        model.seen.clear()
        model.most.clear()
    new = sorted(set().union(*keys) - model.seen.keys())
    if new:
        _learn(model, new)
    suspects, nats = [], []
    for d, own in enumerate(keys):
        # No state gains more on the whole than the sum of what is gained at most on each cluster.
        if sum(map(model.most.__getitem__, own)) > SWITCH:
            each = np.concatenate([model.seen[key] for key in own])
            if _most(each[:, 1:] - each[:, :1]) > SWITCH:
                suspects.append(d)
                nats.append(each)
    for d, each, path in zip(suspects, nats, viterbi(nats)):
        if (each[np.arange(len(path)), path] - each[:, 0]).sum() < LEAST_GAIN:
            continue
        place = np.concatenate([np.arange(b, e) for b, e in clusters[d]])
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(path) != 0)) + 1
        for b, e in zip(np.concatenate(([0], cut)), np.append(cut, len(place))):
            if path[b]:
                found[d].append((int(place[b]), int(place[e - 1]) + 1, int(path[b])))
    return found


def repaired(text: str, found: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for b, e, s in found:
        out.append(text[at:b])
        run = text[b:e]
        out.append(run if s == 1 else undone(run, *PAIRS[s - 2]) or run)
        at = e
    return "".join(out) + text[at:]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in parts of about BATCH_CHARS characters, each with its first number."""
    part: list[str] = []
    size, first = 0, 0
    for n, scalar in enumerate(texts):
        part.append(scalar.as_py())
        size += len(part[-1])
        if size >= BATCH_CHARS:
            yield first, part
            part, size, first = [], 0, n + 1
    if part:
        yield first, part


def _pair_counts(model: Model | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Character pairs of the task's texts, each between line ends; ASCII pairs are counted in place, of the others each slice's."""
        ascii_pairs, others = np.zeros(1 << 14, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for b in batches:
            for _, texts in _slices(b.column("text")):
                if model is not None:
                    texts = [t for t, found in zip(texts, labels(model, texts)) if not found]
                if not texts:
                    continue
                chars = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
                chars = np.minimum(chars, _NO_CHAR).astype(np.int32)
                high = chars > 127
                high = high[:-1] | high[1:]
                ascii_pairs += np.bincount((chars[:-1] << 7 | chars[1:])[~high], minlength=1 << 14)
                others.append(np.unique(chars[:-1][high].astype(np.int64) << 16 | chars[1:][high], return_counts=True))
                if len(others) > 64:
                    others = [_summed(others)]
        at = np.flatnonzero(ascii_pairs)
        codes, n = _summed([*others, (at >> 7 << 16 | at & 127, ascii_pairs[at])])
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    return count


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in counts]), minlength=len(codes)).astype(np.int64)


def train(documents: DataFrame) -> Model:
    rows = documents.where(F.length("text") > 0).select("text")
    other = F.col("text").rlike(r"[^\x00-\x7f]")

    def counts(texts: DataFrame, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
        found = texts.mapInArrow(_pair_counts(model), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # pairs of characters that are met
        return found.column("code").to_numpy().astype(np.int64), found.column("n").to_numpy()

    plain = counts(rows.where(~other), None)  # never damaged, the same in every pass
    model = None
    for _ in range(PASSES):
        codes, n = _summed([plain, counts(rows.where(other), model)])
        model = Model(codes, n.astype(np.float64))
    return model


_OUT = "doc_id bigint, restored string, encodings string, damaged_runs int, lost_chars int"


def _repair(shared):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            docs = b.column("doc_id").to_pylist()
            for first, texts in _slices(b.column("text")):
                rows = []
                for n, (text, found) in enumerate(zip(texts, labels(model, texts)), first):
                    if found:
                        new = repaired(text, found)
                        rows.append((docs[n], new, ", ".join(sorted({STATES[s] for _, _, s in found})), len(found), new.count("\ufffd")))
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=[c.split()[0] for c in _OUT.split(", ")])

    return repair


def restored_documents(documents: DataFrame) -> DataFrame:
    """Every damaged document with its text restored, the encodings that went wrong, and what is lost. Of several rows of one doc_id one is kept."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents))  # ALPHABET squared floats
    rows = documents.where(F.col("text").rlike(r"[^\x00-\x7f]")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Repeated ids are looked for among the few rows that come out.
    return rows.mapInArrow(_repair(model), _OUT).dropDuplicates(["doc_id"])
