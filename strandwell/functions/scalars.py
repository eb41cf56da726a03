"""Scalar text, number, map and time functions as Catalyst expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"  # fixed value: the RFC 4122 namespace of domain names


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: str | Column) -> Column:
    """Runs of white space as one blank, none at the ends; case kept."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def query_key(x: str | Column) -> Column:
    return F.lower(collapse(x))


def one_line(x: str | Column, most: int = 140) -> Column:
    """One line of at most `most` characters, cut at the last blank that fits; null as empty."""
    line = F.coalesce(collapse(x), F.lit(""))
    head = F.regexp_extract(line, rf"(?s)^(.{{0,{most - 2}}}) ", 1)
    has = line.rlike(rf"(?s)^.{{0,{most - 2}}} ")
    return F.when(F.length(line) <= most, line).when(has, F.concat(head, F.lit(" …"))).otherwise(F.concat(F.substring(line, 1, most - 2), F.lit("…")))


def without_sql_comments(x: str | Column) -> Column:
    """Without block and line comments, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(_c(x), r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "))


def tidy_space(x: str | Column) -> Column:
    """LF line ends, single blanks, no empty lines."""
    lf = F.regexp_replace(_c(x), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lf, r"[ \t]+", " "), r"\n{2,}", "\n"), r"^\s+|\s+$", "")


def plain_ident(x: str | Column) -> Column:
    """Identifier by segments: brackets off, quoted ones into brackets, blanks collapsed."""

    def segment(p: Column) -> Column:
        s = F.trim(p)
        inner = collapse(F.substring(s, F.lit(2), F.length(s) - 2))
        return F.when(s.rlike(r"(?s)^\[.*\]$"), inner).when(s.rlike("(?s)^(?:\".*\"|'.*'|`.*`)$") & (F.length(s) > 1), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(collapse(s))

    return F.array_join(F.transform(F.split(F.trim(_c(x)), r"\."), segment), ".")


def bracketed_ident(x: str | Column) -> Column:
    """schema.object as [schema].[object]; brackets and quotes that are there are taken off first."""
    parts = F.transform(F.split(F.trim(_c(x)), r"\."), lambda p: F.concat(F.lit("["), F.regexp_replace(F.trim(p), "^[\\[\"'`]|[\\]\"'`]$", ""), F.lit("]")))
    return F.array_join(parts, ".")


def bracketed_pair(x: str | Column) -> Column:
    """[schema].[object] of the first word, with or without brackets and a comma or semicolon after it; other text as it is, null as empty."""
    first = F.regexp_extract(F.regexp_replace(F.trim(_c(x)), "[,;]+$", ""), r"^(\S+)", 1)
    part = r"(?:\[([^\[\]]+)\]|([A-Za-z0-9_]+))"
    pick = lambda a, b: F.coalesce(F.nullif(F.regexp_extract(first, rf"^{part}\.{part}$", a), F.lit("")), F.regexp_extract(first, rf"^{part}\.{part}$", b))
    pair = F.concat(F.lit("["), pick(1, 2), F.lit("].["), pick(3, 4), F.lit("]"))
    return F.when(_c(x).isNull(), "").when(first.rlike(rf"^{part}\.{part}$"), pair).otherwise(first)


def sorted_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with its keys in order; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def without_hints(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), r"(?i)\bWITH\s*\((?:[^()]|\([^()]*\))*\)", "")


def clean_preview(x: str | Column) -> Column:
    """Without a BEGIN at the end and without doubled closing brackets there."""
    return F.regexp_replace(F.rtrim(F.regexp_replace(_c(x), r"(?i)\bBEGIN(\s+TRANSACTION)?\s*$", "")), r"\){2,}$", ")")


def without_fence(x: str | Column) -> Column:
    """Inside of a code fence with or without a language; other text trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(x)), r"^```[A-Za-z0-9_+-]*\s*", ""), r"\s*```$", ""))


def route_prefix(x: str | Column, prefixes: Sequence[str]) -> Column:
    """(prefix, rest) of the first configured prefix that the text begins with; prefix null if none."""
    c = F.ltrim(_c(x))
    name = F.lit(None).cast("string")
    for p in reversed(prefixes):
        name = F.when(c.startswith(p), F.lit(p)).otherwise(name)
    return F.struct(name.alias("prefix"), F.when(name.isNotNull(), F.trim(F.substring(c, F.length(name) + 1, F.length(c)))).otherwise(c).alias("rest"))


def clean_list(x: str | Column) -> Column:
    """Trimmed items without blank ones; null as the empty list."""
    return F.filter(F.transform(F.coalesce(_c(x), F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))


def to_int(x: str | Column) -> Column:
    """A whole number of text that may hold a decimal one; null for anything else."""
    return _c(x).try_cast("double").try_cast("int")


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def uuid5(name: str | Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Name-based UUID, version 5, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(_c(name), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def snapshot_uuid(repo: str | Column, head_sha: str | Column, fingerprint: str | Column) -> Column:
    """UUID of repo and head, else of repo and folder fingerprint; an error where both are missing."""
    head, finger = F.nullif(F.trim(_c(head_sha)), F.lit("")), F.nullif(F.trim(_c(fingerprint)), F.lit(""))
    mark = F.coalesce(head, finger)
    return F.when(mark.isNotNull(), uuid5(F.concat_ws(":", _c(repo), mark))).otherwise(F.raise_error(F.lit("a snapshot needs a head or a fingerprint")).cast("string"))


def short_digest(x: str | Column) -> Column:
    return F.substring(F.sha1(F.encode(_c(x), "UTF-8")), 1, 12)


def suggested_set_id(repo: str | Column, labels: str | Column) -> Column:
    """repo and up to four labels, as an id."""
    text = F.concat_ws("-", _c(repo), F.array_join(F.slice(_c(labels), 1, 4), "-"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "-"), "-{2,}", "-"), "^-+|-+$", "")


def level_of_labels(labels: str | Column, levels: Mapping[str, int]) -> Column:
    """The highest level of the labels; 0 without any."""
    table = F.create_map(*[F.lit(v) for kv in levels.items() for v in kv])
    return F.coalesce(F.array_max(F.transform(_c(labels), lambda v: F.coalesce(F.try_element_at(table, F.lower(v)), F.lit(0)))), F.lit(0))


def epoch_millis(x: str | Column) -> Column:
    from strandwell.records import instant

    return F.unix_millis(instant(x))


def iso_seconds(moment: str | Column) -> Column:
    """UTC text to seconds; the session's zone must be UTC."""
    return F.date_format(_c(moment), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_bool(x: str | Column) -> Column:
    """1, true, yes, y and on, or any number but zero."""
    c = F.lower(F.trim(_c(x)))
    return F.coalesce(c.isin("1", "true", "yes", "y", "on") | (c.try_cast("double") != 0), F.lit(False))


def human_size(x: str | Column) -> Column:
    n = _c(x).cast("double")
    out = F.format_string("%.1f TB", F.bround(n / 1024**4, 1))
    for unit, scale in (("GB", 1024**3), ("MB", 1024**2), ("KB", 1024)):
        out = F.when(n < scale * 1024, F.format_string(f"%.1f {unit}", F.bround(n / scale, 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%.1f B", n)).otherwise(out)


CONTROL = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")  # fixed values: control tokens of chat formats


def escaped_control(x: str | Column) -> Column:
    """Control tokens with a blank after their first sign, so that they are ordinary text."""
    out = _c(x)
    for token in CONTROL:
        out = F.replace(out, F.lit(token), F.lit(token[0] + " " + token[1:]))
    return out


def clipped(x: str | Column, most: int) -> Column:
    c = _c(x)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def labelled(template: str, label: str | Column) -> Column:
    """A label in a template: at {} or {name}, else after it."""
    lab = _c(label)
    t = F.lit(template)
    if "{}" in template:
        return F.replace(t, F.lit("{}"), lab)
    if "{name}" in template:
        return F.replace(t, F.lit("{name}"), lab)
    return F.concat_ws(" ", t, lab)


def repeats_itself(x: str | Column) -> Column:
    """Over 200 characters with fewer than ten different tokens."""
    return F.coalesce((F.length(_c(x)) > 200) & (F.size(F.array_distinct(F.split(F.trim(_c(x)), r"\s+"))) < 10), F.lit(False))


def uml_block(x: str | Column) -> Column:
    """The PlantUML block of a text, else the text."""
    found = F.regexp_extract(_c(x), r"(?s)(@startuml.*?@enduml)", 1)
    return F.when(found != "", found).otherwise(_c(x))


def split_lines(x: str | Column) -> Column:
    return clean_list(F.split(_c(x), r"\r?\n"))
