"""Natural language hidden inside code (problem 2), by a character-level hidden Markov model.

States are code and one per language. Emissions are character trigrams, hashed to a table of fixed size and trained here
on bounded samples: SAMPLE_DOCS labelled documents a language (each also with its diacritics folded, as comments are
often typed without) and SAMPLE_FILES files with comments and literals taken out for code. A document whose label
the first model disputes is left out of the second.

Viterbi's language states are allowed in comments and string literals only. Outside them the state is code for
certain, so the best path of the whole file is code there and, within each span, the best path from code to code; the
spans are decoded as batches of sequences, each distinct one once in a batch. A language counts for a file if one of
its sentences has WORDS words in that state.

Spans are whole: wrapped comment lines, concatenated and multi-line literals are joined, escapes and doubled quotes
read, before they are decoded.

Defined cases: null and empty texts hold no language; identifiers, names and single foreign words are fewer than
WORDS words; repeated rows are one record; without labelled documents nothing is found; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwell.llm.sampling import hash_sample
from strandwell.llm.source_files import clean_path
from strandwell.llm.splitting import clean_type
from strandwell.records import id_parts, snapshot_of, trimmed, valid_rows
from strandwell.session import materialize

LANGUAGES = ("en", "pl", "de", "fr", "es", "uk", "cs", "pt")
STATES = ("code", *LANGUAGES)
WORDS = 5
SAMPLE_DOCS = 150  # labelled documents a language, about
SAMPLE_FILES = 300  # about
BUCKETS = 1 << 16
SWITCH = 9.0  # nats a change of state costs
BATCH_CHARS = 400_000

_FOLD = str.maketrans("łŁøØđĐß", "lLoOdDs")
_GERMAN = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.translate(_FOLD)) if not unicodedata.combining(c)) if not text.isascii() else text


_NOT_PROSE = re.compile(r"```[\s\S]*?(?:```|\Z)|https?://\S+|\S*[A-Za-z]+[A-Z]\w*\S*|[^\n]*[�Â-ÃÄÅÐÑâ][\u0080-¿€-™][^\n]*|[\d|#*_`(){}\[\]<>=+/\\]+")


def codes_of(text: str) -> np.ndarray:
    """Trigram buckets of a text's characters; letters regardless of case, all digits alike."""
    raw = np.frombuffer(re.sub(r"\d", "0", text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    a = np.concatenate((np.full(2, 32, np.uint64), raw))
    h = (a[:-2] * np.uint64(0x9E3779B1) ^ a[1:-1] * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D) ^ a[2:] * np.uint64(0x27D4EB2F)
    h ^= h >> np.uint64(15)
    return ((h * np.uint64(0x2545F491) >> np.uint64(13)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _sample(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(state, kind, text): SAMPLE_DOCS labelled documents a language and SAMPLE_FILES files, written once."""
    lang = F.regexp_extract(F.lower(trimmed("lang")), r"^([a-z]{2})(?:[-_].*)?$", 1)
    docs = hash_sample(documents.select("doc_id", lang.alias("state"), "text").where(F.col("state").isin(*LANGUAGES)), "doc_id", SAMPLE_DOCS, "state")
    files = hash_sample(nodes.select("canonical_id", "text", clean_type("file_type").alias("kind")), "canonical_id", SAMPLE_FILES)
    both = docs.select("state", F.lit("").alias("kind"), "text").unionByName(files.select(F.lit("code").alias("state"), F.coalesce("kind", F.lit("")).alias("kind"), "text"))
    return materialize(both.where(F.length("text") > 0), "language-sample")


def _counted(table: np.ndarray | None):
    """Trigram counts of a sample's texts by state; with a table, of documents whose label it agrees with."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(STATES), BUCKETS), np.int64)
        for b in batches:
            for state, kind, text in zip(b.column("state").to_pylist(), b.column("kind").to_pylist(), b.column("text")):
                t, s = text.as_py(), STATES.index(state)
                if state == "code":
                    counts[s] += np.bincount(codes_of(without_spans(t, kind)), minlength=BUCKETS)
                    continue
                t = re.sub(r"\s+", " ", _NOT_PROSE.sub(" ", t))
                if table is not None and (len(t) <= 60 or 1 + int(np.argmax(table[codes_of(t)][:, 1:].sum(0))) != s):
                    continue
                if not t.isascii():
                    plain = t
                    if state == "de":
                        for x, y in _GERMAN:
                            plain = plain.replace(x, y)
                        t_plain = folded(plain)
                        counts[s] += np.bincount(codes_of(plain), minlength=BUCKETS)
                    else:
                        t_plain = folded(t)
                        counts[s] += np.bincount(codes_of(t), minlength=BUCKETS)
                    counts[s] += np.bincount(codes_of(t_plain), minlength=BUCKETS)
                else:
                    counts[s] += np.bincount(codes_of(t), minlength=BUCKETS)
        state, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(state), pa.array(bucket), pa.array(counts[state, bucket])], names=["state", "bucket", "n"])

    return count


def _table(sample: DataFrame, before: np.ndarray | None) -> np.ndarray:
    rows = sample.mapInArrow(_counted(before), "state bigint, bucket bigint, n bigint").groupBy("state", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most states x BUCKETS
    counts = np.zeros((BUCKETS, len(STATES)), np.float64)
    counts[rows.column("bucket").to_numpy(), rows.column("state").to_numpy()] = rows.column("n").to_numpy()
    total = counts.sum(0)
    table = np.log((counts + 0.02) / (total + 0.02 * BUCKETS))
    table[:, total == 0] = -30.0
    return table.astype(np.float32)


def train(documents: DataFrame, nodes: DataFrame) -> np.ndarray:
    """The emission table (BUCKETS x states), 2.3 MB whatever the data's size. Texts are counted where they are; only counts reach the driver."""
    sample = _sample(documents, nodes)
    return _table(sample, _table(sample, None))


_C_SPANS = re.compile(r"(?P<line>(?://[^\n]*\n?[ \t]*)+)|/\*(?P<block>[\s\S]*?)(?:\*/|\Z)|\$?@\$?\"(?P<verbatim>(?:\"\"|[^\"])*)(?:\"|\Z)|\"\"\"(?P<raw>[\s\S]*?)(?:\"\"\"|\Z)|\"(?P<str>(?:\\.|[^\"\\\n])*)(?:\"|\n|\Z)|`(?P<tick>(?:\\.|[^`\\])*)(?:`|\Z)|'(?P<apos>(?:\\.|[^'\\\n])*)'")
_SQL_SPANS = re.compile(r"(?P<line>(?:--[^\n]*\n?[ \t]*)+)|/\*(?P<block>[\s\S]*?)(?:\*/|\Z)|'(?P<verbatim>(?:''|[^'])*)(?:'|\Z)|\"(?P<str>[^\"\n]*)\"")
_HASH_SPANS = re.compile(r"\"\"\"(?P<raw>[\s\S]*?)(?:\"\"\"|\Z)|'''(?P<block>[\s\S]*?)(?:'''|\Z)|(?P<line>(?:(?<![\w$&])\#[^\n]*\n?[ \t]*)+)|\"(?P<str>(?:\\.|[^\"\\])*)(?:\"|\Z)|'(?P<apos>(?:\\.|[^'\\\n])*)'")
_YML_SPANS = re.compile(r"(?P<line>(?:(?<![\w$&])\#[^\n]*\n?[ \t]*)+)|\"(?P<str>(?:\\.|[^\"\\])*)(?:\"|\Z)|'(?P<verbatim>(?:''|[^'\n])*)'|(?<=: )(?P<plain>[^\"'\n#|>{\[&*!][^\n#]*)|^[ \t]+(?P<raw>[^\W\d_][^\n:#]*)$", re.M)
_XML_SPANS = re.compile(r"<!--(?P<block>[\s\S]*?)(?:-->|\Z)|\"(?P<str>[^\"<>]*)\"|'(?P<apos>[^'<>\n]*)'|>(?P<raw>[^<>]+)(?=<)")
_JSON_SPANS = re.compile(r"\"(?P<str>(?:\\.|[^\"\\\n])*)(?:\"|\n|\Z)|//(?P<plain>[^\n]*)")
_KINDS = {"sql": _SQL_SPANS, "py": _HASH_SPANS, "sh": _HASH_SPANS, "yml": _YML_SPANS, "yaml": _YML_SPANS, "config": _XML_SPANS, "xml": _XML_SPANS, "csproj": _XML_SPANS, "json": _JSON_SPANS}
_GLUED = re.compile(r"\"[ \t]*(?:\+|&|\.\.)[ \t\n]*[$@]{0,2}\"|'[ \t]*(?:\+|\|\|)[ \t\n]*N?'")
_PY_GLUED = re.compile(r"(?<=[^\s\"(,=:\[{])\"[ \t]*\\?\n[ \t]*[fr]?\"(?=[^\"])")
_LEAD = re.compile(r"(?m)^[ \t]*(?://[/!]*|--+|\#+|\*+(?!/)|!)[ \t]?")
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]*>|\$\{[^{}]*\}|\{[^{}\n]*\}|\\[nrt]")
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_SENTENCE = re.compile(r"[^.!?…\n]*(?:[.!?…](?=\w)[^.!?…\n]*)*")


def spans(text: str, kind: str) -> Iterator[str]:
    """Comments and literals of a file, cleaned and whole."""
    text = text.replace("\r\n", "\n")
    if kind in ("cs", "js", "sql", "py", "ts", ""):
        text = _GLUED.sub("", text)
        if kind == "py":
            text = _PY_GLUED.sub("", text)
    for m in _KINDS.get(kind, _C_SPANS).finditer(text):
        s = m.group(m.lastgroup) if m.lastgroup else ""
        if s.count(" ") + s.count("\n") < WORDS - 1:
            continue
        if "\\u" in s:
            s = _UNICODE.sub(lambda u: chr(int(u.group(1), 16)), s)
        if "&" in s:
            s = html.unescape(s)
        if m.lastgroup in ("line", "block", "raw"):
            s = _LEAD.sub("", s)
        if m.lastgroup == "verbatim":
            s = s.replace("''", "'").replace('""', '"')
        yield re.sub(r"[ \t]*\n[ \t]*", " ", re.sub(r"\n[ \t]*\n", "\n\n", _TAGS.sub(" ", s))).strip()


def without_spans(text: str, kind: str) -> str:
    return _KINDS.get(kind, _C_SPANS).sub(" ", text.replace("\r\n", "\n"))


def decode(table: np.ndarray, texts: list[str]) -> list[np.ndarray]:
    """Viterbi states of each text's characters, from code to code, all texts of a batch in step."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
    i = 0
    while i < len(order):
        longest = max(1, len(texts[order[i]]))
        part = order[i : i + max(1, BATCH_CHARS // longest)]
        i += len(part)
        lens = np.array([len(texts[k]) for k in part])
        n, steps, states = len(part), int(lens.max()), table.shape[1]
        if not steps:
            continue
        grid = np.zeros((n, steps), np.int32)
        for r, k in enumerate(part):
            grid[r, : lens[r]] = codes_of(texts[k])
        alive = np.searchsorted(-lens, -np.arange(steps), side="left")  # texts longer than t; they are sorted by length
        score = np.full((n, states), -SWITCH, np.float32)
        score[:, 0] = 0
        stay = np.ones((steps, n, states), bool)
        came = np.zeros((steps, n), np.int8)
        for t in range(steps):
            a = alive[t]
            s = score[:a]
            best = s.argmax(1)
            jump = s[np.arange(a), best] - SWITCH
            keeps = s >= jump[:, None]
            stay[t, :a], came[t, :a] = keeps, best
            score[:a] = np.where(keeps, s, jump[:, None]) + table[grid[:a, t]]
        score[:, 1:] -= SWITCH  # back to code
        state = score.argmax(1)
        path = np.zeros((steps, n), np.int8)
        for t in range(steps - 1, -1, -1):
            a = alive[t]
            path[t, :a] = state[:a]
            kept = stay[t, np.arange(a), state[:a]]
            state[:a] = np.where(kept, state[:a], came[t, :a])
        for r, k in enumerate(part):
            out[k] = path[: lens[r], r]
    return out


def sentences(text: str, states: np.ndarray) -> Iterator[tuple[str, str]]:
    """(language, sentence) of every sentence with WORDS words in one language state."""
    for m in _SENTENCE.finditer(text):
        words = list(_WORD.finditer(m.group()))
        if len(words) < WORDS:
            continue
        votes = np.zeros(len(STATES), np.int64)
        for w in words:
            votes[np.bincount(states[m.start() + w.start() : m.start() + w.end()], minlength=len(STATES)).argmax()] += 1
        best = int(votes.argmax())
        if best and votes[best] >= WORDS and votes[best] * 2 > len(words):
            yield STATES[best], m.group().strip()


_OUT = "digest string, kind string, lang string, sentence string"


def _labelled(shared):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            digests, kinds, texts = b.column("digest").to_pylist(), b.column("kind").to_pylist(), b.column("text")
            for i in range(0, len(digests), 500):
                found: list[tuple[int, str]] = []
                for k in range(i, min(i + 500, len(digests))):
                    found += [(k, s) for s in spans(texts[k].as_py(), kinds[k] or "") if len(_WORD.findall(s)) >= WORDS]
                distinct = list(dict.fromkeys(s for _, s in found))
                said = {s: list(sentences(s, st)) for s, st in zip(distinct, decode(table, distinct))}
                rows = [(digests[k], kinds[k], lang, sentence) for k, s in found for lang, sentence in said[s]]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=[c.split()[0] for c in _OUT.split(", ")])

    return label


def labelled_sentences(nodes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, said): the texts of each record (canonical_id, snapshot, path, digest, kind, size), and the sentences of each text (digest, kind, lang, sentence)."""
    repo = F.lower(F.element_at(id_parts(), 1))
    rows = valid_rows(nodes).where(F.length("text") > 0).select("canonical_id", snapshot_of().alias("snapshot"), F.nullif(clean_path(repo), F.lit("")).alias("path"), "text", clean_type("file_type").alias("kind"), F.md5("text").alias("digest"))
    table = nodes.sparkSession.sparkContext.broadcast(train(documents, nodes))
    texts = rows.groupBy("digest", "kind").agg(F.first("text").alias("text"))
    said = texts.select("digest", "kind", "text").mapInArrow(_labelled(table), _OUT)
    records = rows.groupBy("canonical_id", "snapshot", "digest").agg(F.max("path").alias("path"), F.max("kind").alias("kind"), F.max(F.length("text")).alias("size"))
    return records.withColumn("path", F.coalesce("path", "canonical_id")), said


def language_sentences(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(canonical_id, lang, sentence) of every sentence in each record's comments and literals, English too."""
    records, said = labelled_sentences(nodes, documents)
    on = (records.digest == said.digest) & records.kind.eqNullSafe(said.kind)
    return records.join(said, on).select("canonical_id", "lang", "sentence")


def language_shares(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(snapshot, path, lang, sentences, chars, share) of each language in each file, English too; share of the characters of all
    its chunks. A record without a path is a file of its own, under its id."""
    records, said = labelled_sentences(nodes, documents)
    # Sums by text first: a file's sentences are not sent as texts.
    sums = said.groupBy("digest", "kind", "lang").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).alias("chars"))
    sizes = records.groupBy("snapshot", "path").agg(F.sum("size").alias("size"))
    on = (records.digest == sums.digest) & records.kind.eqNullSafe(sums.kind)
    files = records.join(sums, on).groupBy("snapshot", "path", "lang").agg(F.sum("sentences").alias("sentences"), F.sum("chars").alias("chars"))
    return files.join(sizes, ["snapshot", "path"]).select("snapshot", "path", "lang", "sentences", "chars", F.round(F.least(F.col("chars") / F.col("size"), F.lit(1.0)), 6).alias("share"))


def languages_found(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(canonical_id, lang) of each language but English with a sentence in a comment or literal."""
    records, said = labelled_sentences(nodes, documents)
    langs = said.where(F.col("lang") != "en").select("digest", "kind", "lang").distinct()
    on = (records.digest == langs.digest) & records.kind.eqNullSafe(langs.kind)
    return records.join(langs, on).select("canonical_id", "lang")
