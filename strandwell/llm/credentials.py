"""Credentials embedded in code and settings (problem 7): found across the corpus and redacted in place.

1. Every literal in a place that may hold a credential is indexed over all distinct texts, whatever it looks like: values
   under telling names, in connection strings, URLs, headers and comments, and values whose form alone tells (key blocks,
   signed tokens, prefixed keys). The index has places and digests of values, not the values.
2. The owners (repositories) of each value are counted over the whole corpus, and values that many owners share are
   placeholders: MOST_OWNERS for values of some strength, FEW_OWNERS for weak ones.
3. Of the rare ones those are confirmed that are structured as a value of their place is: no reference, mask, hash, path,
   sentence or plain word, and mixed enough; a token's place asks for more than a password's.
4. Every text is scanned again with an Aho-Corasick automaton of the confirmed values, so that a secret is also found where
   nothing around it gives it away. Up to AUTOMATON_VALUES values, which are counted first, are one automaton that is
   broadcast. More of them are joined with the texts that hold their anchor (the longest pair of neighbouring runs of
   letters and digits, or the only run), and each batch of texts gets the automaton of its own values. Both are exact.

Values written in pieces (concatenated literals, character and byte arrays, key blocks over several lines) are reported
where they begin, straight from the index.

Redaction replaces each character of a value by `*`, keeping quotes, line ends and all else, so lines and columns stay.

Defined cases: null and empty texts hold nothing; repeated rows are one record; a key block without its end is not given
in full and does not count; overlapping finds are one place; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwell.records import id_parts, valid_rows
from strandwell.session import materialize

MOST_OWNERS = 6, 0.5  # a value of more repositories than this number and this share of all is a placeholder
FEW_OWNERS = 3, 0.25  # the same for weak values
CONTEXT = 1200  # characters on each side of a joined literal in which a telling word counts
AUTOMATON_VALUES = 100_000  # values that are broadcast as one automaton

_NAME = r"(?:passw(?:or)?d|passwd|passphrase|pwd|secret|api[_-]?key|apikey|access[_-]?key|account[_-]?key|shared[_-]?(?:access[_-]?)?key|signing(?:[_-]?key)?|private[_-]?key|encryption[_-]?key|validationkey|decryptionkey|token|bearer|smtppass|(?<=[_-])pass\b|(?:db|user|smtp|ftp)pass|kennwort|has[łl]o|heslo|senha|contrase[ñn]a|mot de passe|пароль|credentials?|\bauth\b)"
_QUOTED = r"(?:\"((?:\\.|[^\"\\\r\n]){4,}+)\"|'((?:\\.|''|[^'\\\r\n]){4,})'|`([^`\r\n]{4,}+)`)"
_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----((?:[^-]|-(?!----)){40,}+)-----END \1-----")
_FORM = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{50,}|glpat-[\w-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})"
)
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@'\"<>]*+:([^\s@/'\"<>]{4,}+)@[A-Za-z0-9]")
_CONN = re.compile(r"(?i)\b(?:password|pwd|accountkey|sharedaccesskey)\s*=\s*([^;'\"\s<>]{4,}+)(?=[;'\"])")
_KEYED = re.compile(r"(?i)(" + _NAME + r"[\w.-]*)['\"\])]*\s*(?:=>|:=|==?|:|,|\bvalue\s*=|\bIS\b)\s*(?:value\s*=\s*)?(?:N|@|\$@?|[fbru])?" + _QUOTED)
_PLAIN = re.compile(r"(?im)^[ \t]*(?:-[ \t]+|export[ \t]+|set[ \t]+|ENV[ \t]+)?([\w.-]*" + _NAME + r"[\w.-]*)[ \t]*[:=][ \t]*([^\s'\"`{}\[\](),;]{6,})[ \t]*(?:\#.*)?\r?$")
_XML = re.compile(r"(?i)\b(?:key|name)\s*=\s*\"([\w.:-]*" + _NAME + r"[\w.:-]*)\"\s+value\s*=\s*\"([^\"\r\n]{4,}+)\"")
_CALL = re.compile(r"(?i)\b(?:NetworkCredential|AUTH\s*=|BasicAuth|HTTPBasicAuth|Credential)\s*\(\s*['\"][^'\"\r\n]{1,80}['\"]\s*,\s*" + _QUOTED)
_HEADER = re.compile(r"(?i)\b(?:authorization|x-api-key|api-key)['\"]?\s*[:,=]\s*['\"]?(?:token|bearer|basic|apikey)?\s*([A-Za-z0-9+/=_.~-]{12,})")
_BASIC = re.compile(r"\b[Bb]asic\s+([A-Za-z0-9+/]{10,}={0,2})")
_SHELL = re.compile(r"(?:\bsshpass\s+-p\s*|\bcurl\b[^\r\n]{0,200}?\s-u\s*[\w.-]{1,60}:|\bmysql\b[^\r\n]{0,200}?\s-p|--password[= ])(?:'([^'\r\n]{4,}+)'|\"([^\"\r\n]{4,}+)\"|([^\s'\"]{4,}+))")
_NOTE = re.compile(r"(?i)(?://|\#|--|/\*|\*|<!--)[^\r\n]{0,80}?\b(?:pwd|pass|password|passwd|kennwort|has[łl]o|heslo|senha|contrase[ñn]a|mot de passe|пароль|login|credentials?)\b[^\r\n:=]{0,40}[:=]\s*(?:[\w.@-]+\s*/\s*)?([^\s,]{6,}+)")
_CHARS = re.compile(r"(?i)(?<!\w)(\w*" + _NAME + r"\w*)\s*=[^\r\n;]{0,60}\{\s*((?:'(?:\\.|[^'\\])'\s*,?\s*){6,})\}")
_BYTES = re.compile(r"(?i)(?<!\w)(\w*(?:key|secret|password|token)\w*)\s*=\s*(?:new\s+byte\[\d*\]\s*)?\{\s*((?:0x[0-9a-f]{2}\s*,?\s*){12,})\}")
_JOINED = re.compile(r"\"([^\"\\\r\n]{2,}+)\"(?:\s*[+&]\s*\"([^\"\\\r\n]{2,}+)\")+")
_TELLING = re.compile(r"(?i)" + _NAME + r"|access key")
_REFERENCE = re.compile(r"\$\{|\#\{|\$\(|\{\{|\}\}|^\{|<[^>]*>|^%[\w.]+%$|\bvault\b|^kv/|secrets?[/.]|env[.(\[]|\bgetenv|config[.\[]|^\$|^@|^arn:|process\.|os\.environ|\{\d+\}", re.I)
_HASHED = re.compile(r"(?i)^(?:sha(?:1|256|384|512)[-:]|md5[-:]|\$2[aby]\$|\$argon2|\$6\$|pbkdf2|\{ssha\}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)")
_HASH_NAME = re.compile(r"(?i)hash|sha\d|md5|digest|checksum|integrity|publickey|public[_-]key|thumbprint|salt|token(?:id|izer|type|name|url|count|length|endpoint|expiry|lifetime|path|field)|secretname|secret[_-]?id|(?:key|secret|password|token)[_-]?(?:name|path|id|file|ref|url|policy|length|hint|label)\b")
_MASK = re.compile(r"\*{3,}|x{6,}|X{6,}|\.{3}|…|•{3,}")
_CAMEL = re.compile(r"^(?:[A-Z]?[a-z]{3,}|[A-Z]{2,}(?=_|$)|_|-)+[a-z]*$")
_PATHLIKE = re.compile(r"^[A-Za-z][\w.-]*(?:/[\w.-]+)+$|^[\w.-]+\.[a-z]{2,5}$|\s")


def classes(v: str) -> int:
    return any(c.islower() for c in v) + any(c.isupper() for c in v) + any(c.isdigit() for c in v) + any(not c.isalnum() for c in v)


def is_password(v: str) -> bool:
    """Structured as a password: no reference, mask, word, path or sentence."""
    if len(v) < 6 or _REFERENCE.search(v) or _MASK.search(v) or _HASHED.match(v) or _PATHLIKE.search(v):
        return False
    if v[-1] in ":([{," or _CAMEL.match(v):
        return False
    return classes(v) >= 2 and len(set(v)) >= 5


def is_random(v: str) -> bool:
    """Structured as a token: long, mixed and not made of words."""
    if len(v) < 16 or _REFERENCE.search(v) or _MASK.search(v) or _HASHED.match(v) or re.search(r"\s", v):
        return False
    if _PATHLIKE.search(v) and not re.search(r"[A-Z].*\d|\d.*[A-Z]", v):
        return False
    return any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and len(set(v)) >= 9


def strength(v: str, place: str) -> int:
    """0 without the structure of its place, 1 weak, 2 strong. Places: password, token, either, basic, hash, told."""
    if place == "hash":
        return 0
    if place == "told":
        return 2
    if place == "basic":
        try:
            user, _, v = base64.b64decode(v, validate=True).decode().partition(":")
        except ValueError:
            return 0
        place = "password" if user else "hash"
    if place == "token":
        return 2 * is_random(v)
    if place == "either" and v.endswith("=") and is_random(v):
        return 2
    return is_password(v) * (2 if classes(v) >= 3 and any(c.isdigit() for c in v) else 1)


def _place(name: str) -> str:
    if _HASH_NAME.search(name):
        return "hash"
    return "token" if re.search(r"(?i)token|key|bearer|signing|auth", name) and not re.search(r"(?i)pass|pwd", name) else "password"


TRIGGERS = (
    "pass pwd secret token apikey api_key api-key accesskey access_key access-key access key accountkey account_key sharedkey shared_key sharedaccess signing privatekey "
    "private_key encryptionkey encryption_key validationkey decryptionkey bearer kennwort hasło haslo heslo senha contraseña contrasena пароль credential auth login ghp_ "
    "gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk_live_ rk_live_ xox akia asia aiza npm_ eyj :// sshpass curl mysql"
).replace("access key", "access~key").split() + ["basic ", "-----begin ", "mot de passe", "sg."]


@cache
def _triggers() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in TRIGGERS:
        w = w.replace("~", " ")
        a.add_word(w, len(w))
    a.make_automaton()
    return a


_VALUE = re.compile(r"[^\s'\"=:,;(){}\[\]]{6}|'.'\s*,|0x")


def indexed(text: str) -> list[tuple[int, int, str, str, str]]:
    """(from, to, value, form, place): every place that may hold a credential; value is empty where it is not one piece of text.

    Only lines with trigger words are looked at closely, each once and whole, so a value of any length is met in full.
    """
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found: set[tuple[int, int, str, str, str]] = set()
    done = -1
    for at, size in _triggers().iter(low):
        if text.startswith("-----BEGIN ", at - size + 1) and (m := _BLOCK.match(text, at - size + 1)):
            body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m.group(2))
            if len(set(body)) > 12 and "..." not in m.group(2):
                found.add((m.start(), m.end(), "", "block", "told"))
        if at < done:
            continue
        begin, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        end = len(text) if end < 0 else end
        done = end
        line = text[begin:end]
        if _VALUE.search(line):
            found.update((begin + s, begin + e, v, form, place) for s, e, v, form, place in _in_line(line))
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(from, to, value, form) of the indexed places with the structure of a credential, whoever else holds their values."""
    return sorted({(s, e, v, form) for s, e, v, form, place in indexed(text) if strength(v, place)})


def _in_line(line: str) -> Iterator[tuple[int, int, str, str, str]]:
    for m in _FORM.finditer(line):
        if not re.search(r"EXAMPLE|example", m.group()) and len(set(m.group()[8:])) >= 8:
            yield m.start(), m.end(), m.group(), "form", "told"
    if "://" in line:
        for m in _URL.finditer(line):
            yield m.start(1), m.end(1), m.group(1), "named", "password"
    for m in _CONN.finditer(line):
        yield m.start(1), m.end(1), m.group(1), "named", "either"
    for rx in (_KEYED, _PLAIN, _XML):
        for m in rx.finditer(line):
            k = m.lastindex
            if k > 1:
                name = line[max(0, m.start(1) - 20) : m.start(1)].rsplit(" ", 1)[-1] + m.group(1)
                yield m.start(k), m.end(k), m.group(k), "named", _place(name)
    for rx in (_CALL, _SHELL, _NOTE):
        for m in rx.finditer(line):
            k = m.lastindex
            v = m.group(k).rstrip("\"';)") if rx is _NOTE else m.group(k)
            if not (rx is _NOTE and "(" in v):
                yield m.start(k), m.start(k) + len(v), v, "named", "password"
    for m in _HEADER.finditer(line):
        yield m.start(1), m.end(1), m.group(1), "named", "token"
    for m in _BASIC.finditer(line):
        yield m.start(1), m.end(1), m.group(1), "named", "basic"
    if "'" in line and "{" in line:
        for m in _CHARS.finditer(line):
            if is_password("".join(re.findall(r"'(\\.|[^'\\])'", m.group(2)))):
                yield m.start(2), m.end(2), "", "pieces", "told"
    if "0x" in line:
        for m in _BYTES.finditer(line):
            if len(set(re.findall(r"0x..", m.group(2)))) >= 8 and not _HASH_NAME.search(m.group(1)):
                yield m.start(2), m.end(2), "", "pieces", "told"
    if "+" in line or "&" in line:
        for m in _JOINED.finditer(line):
            word = "".join(re.findall(r"\"([^\"\\\r\n]*)\"", m.group()))
            if _FORM.fullmatch(word) or (is_random(word) and _TELLING.search(line[max(0, m.start() - CONTEXT) : m.start()] + line[m.end() : m.end() + CONTEXT])):
                yield m.start(), m.end(), "", "pieces", "told"


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


_INDEX = "digest string, line_no int, start_char int, end_char int, form string, place string, value_id binary, strength int"
_PLACES = "digest string, line_no int, start_char int, end_char int, form string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(cols, types)], names=list(names))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for digest, text in zip(b.column("digest").to_pylist(), b.column("text")):
            text = text.as_py()
            for s, e, v, form, place in indexed(text):
                rows.append((digest, line_of(text, s), s, e, form, place, hashlib.sha256((v or text[s:e]).encode("utf-8", "surrogatepass")).digest()[:16], strength(v, place)))
        yield _batch(rows, _INDEX)


def literal_index(texts: DataFrame) -> DataFrame:
    """Every place of the distinct texts (digest, text) that may hold a credential, with its value's digest and strength; written once."""
    return materialize(texts.mapInArrow(_indexed, _INDEX), "credential-index")


def decided(index: DataFrame, owners: DataFrame) -> DataFrame:
    """The index with a column verdict: shared, unstructured or confirmed. owners: (digest, owner) of every text.

    Values are counted, not gathered: one row a value and owner, then one a value.
    """
    all_owners = owners.select("owner").distinct().count()
    held = index.where("form IN ('named', 'form')").select("digest", "value_id").distinct().join(owners, "digest").select("value_id", "owner").distinct().groupBy("value_id").agg(F.count("*").alias("n"))

    def beyond(limit: tuple[int, float]):
        return (F.col("n") > limit[0]) & (F.col("n") > all_owners * limit[1])

    # Only what more than the smallest number share can be suppressed, so only that is joined back.
    many = held.where(F.col("n") > min(MOST_OWNERS[0], FEW_OWNERS[0]))
    shared = beyond(MOST_OWNERS) | (beyond(FEW_OWNERS) & (F.col("strength") < 2))
    verdict = F.when(F.coalesce(shared, F.lit(False)), "shared").when(F.col("strength") == 0, "unstructured").otherwise("confirmed")
    return index.join(many, "value_id", "left").withColumn("verdict", verdict).drop("n")


def confirmed_values(confirmed: DataFrame, texts: DataFrame) -> DataFrame:
    """(value) of each confirmed value that is one piece of text, cut from one of its places."""
    one = confirmed.where("form IN ('named', 'form')").groupBy("value_id").agg(F.min(F.struct("digest", "start_char", "end_char")).alias("at")).select("at.*")
    cut = F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return texts.join(one, "digest").select(cut.alias("value")).distinct()


def _automaton(values: Iterable[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for v in values:
        a.add_word(v, v)
    a.make_automaton()
    return a


def _matches(a: ahocorasick.Automaton, digest: str, text: str) -> Iterator[tuple]:
    """Places of the automaton's values that no letter or digit continues."""
    for last, v in a.iter(text):
        s, e = last - len(v) + 1, last + 1
        if not ((s and text[s - 1].isalnum() and v[0].isalnum()) or (e < len(text) and text[e].isalnum() and v[-1].isalnum())):
            yield digest, line_of(text, s), s, e, "found"


def _scanned(values: list[str] | None):
    """Scans (digest, text) for values, or (digest, text, wanted) for each batch's wanted values."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(values) if values is not None else None
        for b in batches:
            mine = a
            if mine is None:
                mine = _automaton({v for vs in b.column("wanted").to_pylist() for v in vs})
            yield _batch([m for digest, text in zip(b.column("digest").to_pylist(), b.column("text")) for m in _matches(mine, digest, text.as_py())], _PLACES)

    return scan


_RUN, _GAP = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}\s]+"


def anchored(texts: DataFrame, values: DataFrame) -> DataFrame:
    """(digest, wanted): of each text the values whose anchor it holds. Runs within a value are whole runs of every text that holds it."""
    pairs = F.regexp_extract_all("value", F.lit(f"(?<![\\p{{L}}\\p{{N}}])(?=({_RUN}{_GAP}{_RUN}))"), F.lit(1))
    runs = F.regexp_extract_all("value", F.lit(_RUN), F.lit(0))
    longest = F.element_at(F.array_sort(F.when(F.size(pairs) > 0, pairs).otherwise(runs), lambda x, y: F.length(y) - F.length(x)), 1)
    wanted = values.where(F.col("value").rlike(_RUN)).select("value", longest.alias("anchor"))
    held = F.array_union(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)), F.regexp_extract_all("text", F.lit(f"(?<![\\p{{L}}\\p{{N}}])(?=({_RUN}{_GAP}{_RUN}))"), F.lit(1)))
    found = texts.select("digest", F.explode(held).alias("anchor")).join(wanted, "anchor").select("digest", "value").distinct()
    return found.groupBy("digest").agg(F.collect_set("value").alias("wanted"))  # no more values than the text has anchors


def rescanned(texts: DataFrame, values: DataFrame, most: int = AUTOMATON_VALUES) -> DataFrame:
    """All places of confirmed values."""
    if values.limit(most + 1).count() <= most:
        return texts.mapInArrow(_scanned([r.value for r in values.collect()]), _PLACES)  # at most AUTOMATON_VALUES
    return texts.join(anchored(texts, values), "digest").select("digest", "text", "wanted").mapInArrow(_scanned(None), _PLACES)


def distinct_texts(rows: DataFrame, name: str) -> DataFrame:
    """(digest, text) of each text once, written once."""
    texts = rows.where(F.length("text") > 0).select(F.md5("text").alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text"))
    return materialize(texts, name)


def judged_index(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index with verdicts, records, texts): records (canonical_id, digest), texts (digest, text)."""
    rows = valid_rows(nodes)
    texts = distinct_texts(rows, "texts")
    records = rows.where(F.length("text") > 0).select("canonical_id", F.md5("text").alias("digest"))
    owners = records.select("digest", F.lower(F.element_at(id_parts(), 1)).alias("owner")).distinct()
    return decided(literal_index(texts), owners), records.distinct(), texts


def credential_places(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, records, texts): places by text digest, records (canonical_id, digest), texts (digest, text)."""
    judged, records, texts = judged_index(nodes)
    confirmed = judged.where("verdict = 'confirmed'")
    places = [c.split()[0] for c in _PLACES.split(", ")]
    return confirmed.select(*places).unionByName(rescanned(texts, confirmed_values(confirmed, texts))), records, texts


def credential_verdicts(nodes: DataFrame) -> DataFrame:
    """(verdict, form, literals, places): how many values and places of the index each step decides."""
    return judged_index(nodes)[0].groupBy("verdict", "form").agg(F.countDistinct("value_id").alias("literals"), F.count("*").alias("places"))


def credentials_found(nodes: DataFrame) -> DataFrame:
    """(canonical_id, line_no) of each line on which a credential begins."""
    places, records, _ = credential_places(nodes)
    return places.select("digest", "line_no").distinct().join(records, "digest").select("canonical_id", "line_no")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            chars = list(text)
            for p in spans:
                for i in range(p["start_char"], p["end_char"]):
                    # In values of several pieces only what carries the secret is hidden, not quotes, signs and line ends.
                    if p["form"] not in ("block", "pieces") or chars[i].isalnum():
                        chars[i] = "*"
            out.append("".join(chars))
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(out, pa.string())], names=["digest", "redacted"])


def redacted_texts(nodes: DataFrame) -> DataFrame:
    """(canonical_id, redacted) of every record that holds a credential."""
    places, records, texts = credential_places(nodes)
    spans = places.groupBy("digest").agg(F.collect_set(F.struct("start_char", "end_char", "form")).alias("spans"))  # bounded by one text
    masked = texts.join(spans, "digest").select("digest", "text", "spans").mapInArrow(_masked, "digest string, redacted string")
    return masked.join(records, "digest").select("canonical_id", "redacted")
