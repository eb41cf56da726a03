"""Scalar and text-analysis queries; SQL where the function can be said in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwell.functions import code_text as ct
from strandwell.functions import markup as mk
from strandwell.functions import scalars as x
from strandwell.functions import tsql
from strandwell.records import read

NODES, KEY = "rag_node", "canonical_id, import_id"


def _doc(expr, name="out"):
    return lambda s, d: read(s, d, "documents").select("doc_id", expr().alias(name))


def _node(expr, name="out", where="true"):
    return lambda s, d: read(s, d, NODES).where(where).select("canonical_id", "import_id", expr().alias(name))


def _sql_texts(s, d):
    kind = F.lower(F.regexp_replace("file_type", r"^\.", ""))
    return read(s, d, NODES).where((kind == "sql") & (F.length("text") > 0)).select("canonical_id", "import_id", "text")


def _summaries(s, d):
    return tsql.summaries(_sql_texts(s, d)).select("canonical_id", "import_id", "s")


# Text without comments and with empty literals, and dotted names, as SQL sees them.
CLEAN = r"c AS (SELECT row_number() OVER () AS r, canonical_id, import_id, regexp_replace(text, $$(?s)/\*.*?(?:\*/|\z)|--[^\n]*|N?'(?:''|[^'])*'?$$, ' ' || chr(39) || chr(39) || ' ', 'g') AS t FROM rag_node WHERE lower(regexp_replace(file_type, '^\.', '')) = 'sql' AND length(text) > 0)"
KEYWORDS = "'" + "','".join(sorted(tsql.STARTERS | {"ON", "WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "GROUP", "ORDER", "HAVING", "UNION", "EXCEPT", "INTERSECT", "OPTION", "FOR"})) + "'"
NAME = r"((?:\[[^\]\n]*\]|\x22[^\x22\n]*\x22|[A-Za-z_]\w*|#{1,2}\w+)(?:\s*\.\s*(?:\[[^\]\n]*\]|[A-Za-z_]\w*))*)"
_BARE = r"regexp_replace({}, '[\[\]\s]', '', 'g')"
CTE_SQL = f"WITH {CLEAN} SELECT canonical_id, import_id, unnest(list_distinct(regexp_extract_all(t, " + r"'(?i)\bWITH\s+(\w+)\s*(?:\([^()]*\)\s*)?AS\s*\(', 1))) AS ctes FROM c"
_VERB = r"(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+"
WRITE_SQL = (
    f"WITH {CLEAN}, w AS (SELECT canonical_id, import_id, unnest(regexp_extract_all(t, " + rf"'(?i)\b({_VERB}{NAME})', 1)) AS x FROM c) "
    + r"SELECT canonical_id, import_id, upper(regexp_extract(x, '^\w+')) AS op, " + _BARE.format(f"regexp_replace(x, '(?i)^{_VERB}', '')") + " AS target FROM w"
)
VARIABLE_SQL = f"WITH {CLEAN} SELECT canonical_id, import_id, unnest(list_distinct([v FOR v IN regexp_extract_all(t, " + r"'@@?\w+') IF v[2] <> '@'])) AS variables FROM c"
SOURCE_SQL = (
    f"WITH {CLEAN}, w AS (SELECT r, canonical_id, import_id, unnest(regexp_extract_all(t, " + rf"'(?i)\b(?:FROM|JOIN)\s+({NAME}(?:\s+(?:AS\s+)?[A-Za-z_]\w*)?)', 1)) AS x FROM c), "
    + "y AS (SELECT r, canonical_id, import_id, " + _BARE.format(f"regexp_extract(x, '^{NAME}', 1)") + r' AS "table", ' + r"regexp_extract(x, '(?i)\s(?:AS\s+)?([A-Za-z_]\w*)$', 1) AS a FROM w) "
    + f'SELECT canonical_id, import_id, "table", alias FROM (SELECT DISTINCT r, canonical_id, import_id, "table", CASE WHEN upper(a) IN ({KEYWORDS}) THEN \'\' ELSE a END AS alias FROM y)'
)
PARAM_SQL = (
    f"WITH {CLEAN}, h AS (SELECT r, canonical_id, import_id, regexp_extract(t, " + rf"'(?is)\bCREATE\s+(?:OR\s+ALTER\s+)?PROC(?:EDURE)?\s+{NAME}(.*?)\bAS\s+BEGIN\b', 2) AS h FROM c), "
    + r"p AS (SELECT canonical_id, import_id, unnest(regexp_extract_all(h, '(?:^|[\n,])\s*,?\s*(@\w+\s+[A-Za-z]\w*(?:\([0-9, ]+\)|\(MAX\))?)', 1)) AS p FROM h) "
    + r"SELECT canonical_id, import_id, regexp_extract(p, '^@\w+') AS name, regexp_replace(regexp_replace(p, '^@\w+\s+', ''), '\s', '', 'g') AS type, NULL::VARCHAR AS default, false AS output FROM p"
)
FLAG_SQL = (
    f"WITH {CLEAN} SELECT upper(regexp_extract(t, " + r"'(?i)\bISOLATION\s+LEVEL\s+((?:READ\s+)?\w+)', 1)) AS isolation, regexp_matches(t, '(?i)\bNOLOCK\b') AS nolock, "
    + r"CASE WHEN regexp_matches(t, '(?i)\bOFFSET\b') AND regexp_matches(t, '(?i)\b(?:FETCH|ROWS)\b') THEN 'offset' WHEN regexp_matches(t, '(?i)\bTOP\b') THEN 'top' ELSE '' END AS pagination, count(*) AS n FROM c GROUP BY 1, 2, 3"
)
TABLE_SQL = f"WITH {CLEAN} SELECT canonical_id, import_id, " + _BARE.format("regexp_extract(t, " + rf"'(?i)\bCREATE\s+TABLE\s+{NAME}\s*\(', 1)") + " AS table_name FROM c"


def _part(*cols):
    return lambda s, d: _summaries(s, d).select("canonical_id", "import_id", *[F.col(f"s.{c}").alias(c.replace(".", "_")) for c in cols])


def _exploded(col):
    return lambda s, d: _summaries(s, d).select("canonical_id", "import_id", F.explode(f"s.{col}").alias("x")).select("canonical_id", "import_id", "x.*" if col not in ("ctes", "flow", "equals", "variables", "result_columns") else F.col("x").alias(col))


LEVELS = {"public": 0, "internal": 10, "restricted": 20, "secret": 20, "critical": 30}  # fixed values
LEVEL_SQL = "CASE x WHEN 'internal' THEN 10 WHEN 'restricted' THEN 20 WHEN 'secret' THEN 20 WHEN 'critical' THEN 30 ELSE 0 END"


def _classes(s, d):
    return ct.classified(read(s, d, NODES).select("canonical_id", "import_id", "text", "file_type")).drop("text")


def _re2(pattern: str) -> str:
    """A pattern in the SQL engine's dialect, which has no possessive repeats and needs none."""
    return "'" + pattern.replace("*+", "*").replace('\\"', '"').replace("'", "''") + "'"


def _weighted_sql(text: str, table) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({text}, {_re2(p)}) THEN {base} + {each} * len(regexp_extract_all({text}, {_re2(p)})) ELSE 0 END" for p, base, each in table)


def _words_sql(words: list[str], base: float, each: float, of: str = "w") -> str:
    hits = f"[x FOR x IN {of} IF x IN ({', '.join(repr(w) for w in words)})]"
    return f"{base} * len(list_distinct({hits})) + {each} * len({hits})"


_CODE_SQL = (
    "m AS (SELECT canonical_id, import_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x01\\x02]', '', 'g'), "
    + _re2(f"(?:{ct._COMMENT})|({ct._STRING})") + r", chr(1) || '\1' || chr(2), 'g'), '\x01\x02', '', 'g'), '\x01[^\x02]+\x02', '__STR__', 'g') AS c FROM rag_node), k AS (SELECT *, upper(c) AS u, regexp_extract_all(c, '\w+') AS w, [upper(x) FOR x IN regexp_extract_all(c, '\w+')] AS v FROM m)"
)
_MIGRATION_SQL = "(" + " + ".join(f"CAST(regexp_matches(c, {_re2(p)}) AS INTEGER)" for p in ct.MIGRATION) + ")"
DOTNET_SQL = (
    f"WITH {_CODE_SQL}, g AS (SELECT *, {_MIGRATION_SQL} AS mig FROM k) SELECT canonical_id, import_id, round(0e0 + {_weighted_sql('c', ct.DOTNET)} + {' + '.join(_words_sql(ws.split(), b, e) for ws, b, e in ct.DOTNET_WORDS)}"
    + r" + CASE WHEN len(regexp_extract_all(c, ';')) >= 3 AND len(regexp_extract_all(c, '[{}]')) >= 2 THEN 2.5 ELSE 0 END + CASE WHEN len(regexp_extract_all(c, ';')) >= 15 THEN 3.0 ELSE 0 END + CASE WHEN mig >= 2 THEN 6.0 + mig ELSE 0 END + CASE WHEN regexp_matches(c, '\bmigrationBuilder\s*\.\s*Sql\s*\(') THEN 4.0 ELSE 0 END + CASE WHEN regexp_matches(c, "
    + _re2(ct.CALLSITE) + ") THEN 3.5 ELSE 0 END, 6) AS dotnet_score FROM g"
)
SQL_SQL = (
    f"WITH {_CODE_SQL} SELECT canonical_id, import_id, round(0e0 + {_words_sql(ct.SQL_WORDS, 2.2, 0.18, 'v')} + " + " + ".join(f"CASE WHEN regexp_matches(u, {_re2(p)}) THEN {w} ELSE 0 END" for p, w in ct.SQL_PATTERNS if "{0,2000}" not in p)
    + r" + CASE WHEN regexp_matches(u, '(?s)\bSELECT\b.{0,1000}?.{0,1000}?\bFROM\b') THEN 10.0 ELSE 0 END + CASE WHEN regexp_matches(u, '(?s)\bUPDATE\b.{0,1000}?.{0,1000}?\bSET\b') THEN 9.0 ELSE 0 END"
    + r" + CASE WHEN regexp_matches(u, '\bBEGIN\s+TRY\b') AND regexp_matches(u, '\bBEGIN\s+TRAN(?:SACTION)?\b') THEN 8.0 ELSE 0 END, 6) AS sql_score FROM k"
)


def _hits(s, d):
    """Lines of each text that hold `return`."""
    lines = read(s, d, NODES).where("text IS NOT NULL").select(F.md5("text").alias("doc"), "text").dropDuplicates(["doc"]).select("doc", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").contains("return"))
    return ct.hit_windows(lines.select("doc", (F.col("n") + 1).alias("line_no")), "doc")


HITS_SQL = """WITH t AS (SELECT DISTINCT md5(text) AS doc, text FROM rag_node WHERE text IS NOT NULL), l AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
h AS (SELECT doc, n, n - lag(n) OVER (PARTITION BY doc ORDER BY n) AS g FROM l WHERE contains(line, 'return')), k AS (SELECT doc, n, sum(CASE WHEN g IS NULL OR g > 39 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) AS grp FROM h)
SELECT doc, greatest(1, min(n) - 18) AS from_line, max(n) + 18 AS to_line FROM k GROUP BY doc, grp"""

QUERIES = {
    "x01_query_key": (_doc(lambda: x.query_key("title")), r"SELECT doc_id, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS out FROM documents"),
    "x02_collapse": (_doc(lambda: F.md5(x.collapse("text"))), r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), ' ')) AS out FROM documents"),
    "x03_one_line": (
        _doc(lambda: x.one_line("text")),
        r"WITH c AS (SELECT doc_id, coalesce(regexp_replace(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), '^ +| +$', '', 'g'), '') AS l FROM documents), h AS (SELECT doc_id, l, substr(l, 1, 139) AS p FROM c) "
        "SELECT doc_id, CASE WHEN length(l) <= 140 THEN l WHEN contains(p, ' ') THEN substr(p, 1, length(p) - position(' ' IN reverse(p))) || ' …' ELSE substr(l, 1, 138) || '…' END AS out FROM h",
    ),
    "x04_without_comments": (lambda s, d: _sql_texts(s, d).select("canonical_id", "import_id", F.md5(x.without_sql_comments("text")).alias("out")), r"SELECT canonical_id, import_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS out FROM rag_node WHERE lower(regexp_replace(file_type, '^\.', '')) = 'sql' AND length(text) > 0"),
    "x05_tidy_space": (_node(lambda: F.md5(x.tidy_space("text")), where="text IS NOT NULL"), r"SELECT canonical_id, import_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS out FROM rag_node WHERE text IS NOT NULL"),
    "x06_plain_ident": (_node(lambda: x.plain_ident(F.concat(F.lit("["), F.col("sql_schema"), F.lit("]."), F.col("sql_name"))), where="sql_name <> ''"), "SELECT canonical_id, import_id, sql_schema || '.' || sql_name AS out FROM rag_node WHERE sql_name <> ''"),
    "x07_bracketed": (_node(lambda: x.bracketed_ident(F.concat_ws(".", "sql_schema", "sql_name")), where="sql_name <> ''"), "SELECT canonical_id, import_id, '[' || sql_schema || '].[' || sql_name || ']' AS out FROM rag_node WHERE sql_name <> ''"),
    "x07_bracketed_pair": (
        _node(lambda: x.bracketed_pair(F.concat(F.lit(" ["), F.col("sql_schema"), F.lit("]."), F.col("sql_name"), F.lit(" AS a,"))), where="sql_name <> ''"),
        r"SELECT canonical_id, import_id, CASE WHEN regexp_matches(sql_name, '^[A-Za-z0-9_]+$') THEN '[' || sql_schema || '].[' || sql_name || ']' ELSE '[' || sql_schema || '].' || sql_name END AS out FROM rag_node WHERE sql_name <> ''",
    ),
    "x08_hints": (lambda s, d: _sql_texts(s, d).select("canonical_id", "import_id", F.md5(x.clean_preview(x.without_hints("text"))).alias("out")), None),
    "x09_fence": (_doc(lambda: F.md5(x.without_fence("text"))), r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(trim(text, ' '), '^```[A-Za-z0-9_+-]*\s*', ''), '\s*```$', ''), '^ +| +$', '', 'g')) AS out FROM documents"),
    "x10_lenient_json": (lambda s, d: read(s, d, "events").select("event_id", mk.apply(mk.lenient_json, F.regexp_replace("props", "\"", "")).alias("out")), "SELECT event_id, '{\"k\":' || CAST(CAST(props->>'$.k' AS BIGINT) AS VARCHAR) || '}' AS out FROM events"),
    "x11_payload": (lambda s, d: read(s, d, "conversation_turn").select("turn_id", mk.apply(mk.query_payload, "question_neutral").alias("out")), None),
    "x12_decision": (lambda s, d: read(s, d, "events").select("event_id", mk.apply(lambda t: mk.decision(t)[0], F.concat(F.lit("decision: "), F.col("event_type"))).alias("out")), "SELECT event_id, event_type AS out FROM events"),
    "x13_prefix": (_doc(lambda: x.route_prefix("text", ["The", "#"]).prefix), "SELECT doc_id, CASE WHEN starts_with(ltrim(text, ' '), 'The') THEN 'The' WHEN starts_with(ltrim(text, ' '), '#') THEN '#' END AS out FROM documents"),
    "x14_clean_list": (_node(lambda: F.array_join(x.clean_list("acl_allow"), ",")), "SELECT canonical_id, import_id, array_to_string([trim(v) FOR v IN coalesce(acl_allow, []) IF trim(v) <> ''], ',') AS out FROM rag_node"),
    "x15_to_int": (lambda s, d: read(s, d, "events").select("event_id", x.to_int(F.col("value").cast("string")).alias("out")), "SELECT event_id, CAST(trunc(value) AS INTEGER) AS out FROM events"),
    "x16_sigmoid": (lambda s, d: read(s, d, "events").select("event_id", F.round(x.sigmoid(F.col("value") / 100), 6).alias("out")), "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS out FROM events"),
    "x17_uuid5": (
        _node(lambda: x.snapshot_uuid("repo", "head_sha", F.lit(None).cast("string")), where="head_sha <> '' AND repo IS NOT NULL"),
        f"WITH x AS (SELECT canonical_id, import_id, sha1(from_hex('{x.DNS_NAMESPACE}') || encode(repo || ':' || trim(head_sha))) AS h FROM rag_node WHERE head_sha <> '' AND repo IS NOT NULL) "
        "SELECT canonical_id, import_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS out FROM x",
    ),
    "x18_digest": (_node(lambda: x.short_digest("text")), "SELECT canonical_id, import_id, substr(sha1(text), 1, 12) AS out FROM rag_node"),
    "x20_suggest_set_id": (_node(lambda: x.suggested_set_id("repo", "classification_labels"), where="repo IS NOT NULL AND classification_labels IS NOT NULL"), r"SELECT canonical_id, import_id, regexp_replace(regexp_replace(regexp_replace(repo || '-' || array_to_string(classification_labels[1:4], '-'), '[^A-Za-z0-9_.-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS out FROM rag_node WHERE repo IS NOT NULL AND classification_labels IS NOT NULL"),
    "x21_label_level": (_node(lambda: x.level_of_labels("classification_labels", LEVELS)), f"SELECT canonical_id, import_id, coalesce(list_max([{LEVEL_SQL} FOR x IN classification_labels]), 0) AS out FROM rag_node"),
    "x22_epoch_ms": (lambda s, d: read(s, d, "import_run").select("import_id", "snapshot_id", x.epoch_millis("finished_utc").alias("out")), "SELECT import_id, snapshot_id, epoch_ms(TRY_CAST(nullif(finished_utc, '') AS TIMESTAMPTZ)) AS out FROM import_run"),
    "x23_iso": (lambda s, d: read(s, d, "events").select("event_id", x.iso_seconds("ts").alias("out")), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS out FROM events"),
    "x24_json": (lambda s, d: read(s, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("out")), "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS out FROM events"),
    "x24_sorted_json": (lambda s, d: read(s, d, "events").select("event_id", x.sorted_json({"z": F.col("event_type"), "a": F.col("user_id"), "k": F.when(F.col("user_id") % 2 == 0, F.col("event_id"))}).alias("out")), "SELECT event_id, '{\"a\":' || user_id || CASE WHEN user_id % 2 = 0 THEN ',\"k\":' || event_id ELSE '' END || ',\"z\":\"' || event_type || '\"}' AS out FROM events"),
    "x27_split_lines": (_doc(lambda: F.size(x.split_lines("text"))), r"SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len([l FOR l IN regexp_split_to_array(text, '\r?\n') IF regexp_replace(l, '^ +| +$', '', 'g') <> '']) END AS INTEGER) AS out FROM documents"),
    "x28_to_bool": (lambda s, d: read(s, d, "snapshot_set").select("snapshot_set_id", x.to_bool(F.col("is_active").cast("string")).alias("out")), "SELECT snapshot_set_id, coalesce(is_active, false) AS out FROM snapshot_set"),
    "x29_human_size": (_doc(lambda: x.human_size(F.col("n_chars") * 1000)), "SELECT doc_id, CASE WHEN n_chars * 1000 < 1024 THEN printf('%.1f B', n_chars * 1000.0::DOUBLE) WHEN n_chars * 1000 < 1048576 THEN printf('%.1f KB', n_chars * 1000 / 1024.0::DOUBLE) ELSE printf('%.1f MB', n_chars * 1000 / 1048576.0::DOUBLE) END AS out FROM documents"),
    "x30_plantuml": (_doc(lambda: mk.apply(mk.plantuml_encoded, "title")), None),
    "x31_uml_block": (_doc(lambda: F.md5(x.uml_block("text"))), "SELECT doc_id, md5(CASE WHEN regexp_extract(text, '(?s)(@startuml.*?@enduml)', 1) <> '' THEN regexp_extract(text, '(?s)(@startuml.*?@enduml)', 1) ELSE text END) AS out FROM documents"),
    "x32_uml_model": (lambda s, d: read(s, d, "rag_edge").where("from_canonical_id <> '' AND to_canonical_id <> ''").select("from_canonical_id", "to_canonical_id", F.size(mk.apply(mk.uml_model, F.concat(F.lit('"'), F.col("from_canonical_id"), F.lit('" --> "'), F.col("to_canonical_id"), F.lit('" : calls')), mk.UML)).alias("out")), "SELECT from_canonical_id, to_canonical_id, CASE WHEN from_canonical_id = to_canonical_id THEN 2 ELSE 3 END AS out FROM rag_edge WHERE from_canonical_id <> '' AND to_canonical_id <> ''"),
    "x33_protect": (_doc(lambda: mk.apply(lambda t: None if t is None else mk.restored(*mk.protected(t)), "title")), "SELECT doc_id, title AS out FROM documents"),
    "x34_markdown": (_doc(lambda: F.md5(mk.apply(lambda t: mk.translated_markdown(t, lambda v: v), "text"))), "SELECT doc_id, md5(text) AS out FROM documents"),
    "x35_escape": (_doc(lambda: x.escaped_control(F.concat(F.lit("[INST]"), F.col("title")))), "SELECT doc_id, '[ INST]' || title AS out FROM documents"),
    "x37_first_object": (lambda s, d: read(s, d, "events").select("event_id", mk.apply(mk.first_object, F.concat(F.lit("x "), F.col("props"), F.lit(" y}"))).alias("out")), "SELECT event_id, props AS out FROM events"),
    "x38_clip": (_doc(lambda: F.md5(x.clipped("text", 400))), "SELECT doc_id, md5(CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END) AS out FROM documents"),
    "x39_label": (_doc(lambda: x.labelled("snapshot {}:", "title")), "SELECT doc_id, 'snapshot ' || title || ':' AS out FROM documents"),
    "t01_literals": (
        _node(lambda: F.size(ct.literals("text"))),
        r"SELECT canonical_id, import_id, len([l FOR l IN regexp_extract_all(coalesce(text, ''), $$(?s)/\*.*?(?:\*/|\z)|//[^\n]*|--[^\n]*|\$?\x22{3}.*?(?:\x22{3}|\z)|(?:\$@|@\$|@)\x22(?:[^\x22]|\x22\x22)*(?:\x22|\z)|\$?\x22(?:[^\x22\\]|\\.)*(?:\x22|\z)|\x27(?:[^\x27]|\x27\x27)*(?:\x27|\z)$$) IF NOT starts_with(l, '/') AND NOT starts_with(l, '-')]) AS out FROM rag_node",
    ),
    "t02_dotnet_score": (lambda s, d: _classes(s, d).select("canonical_id", "import_id", "dotnet_score"), DOTNET_SQL),
    "t03_sql_score": (lambda s, d: _classes(s, d).select("canonical_id", "import_id", "sql_score"), SQL_SQL),
    "t05_classify": (_classes, None),
    "t05_confusion": (lambda s, d: _classes(s, d).groupBy(F.lower(F.regexp_replace("file_type", r"^\.", "")).alias("file_type"), "kind").agg(F.count("*").alias("n")), None),
    "t06_language": (lambda s, d: _classes(s, d).select("canonical_id", "import_id", ct.language_of("kind").alias("language")), None),
    "t07_summary": (lambda s, d: _summaries(s, d).select("canonical_id", "import_id", tsql.compact("s").alias("summary")), None),
    "t08_params": (_exploded("params"), PARAM_SQL), "t10_selects": (_exploded("selects"), None),
    "t13_columns": (_exploded("result_columns"), None), "t15_equals": (_exploded("equals"), None), "t16_flow": (_exploded("flow"), None), "t17_purpose": (_part("object", "purpose"), None),
    "t09_ctes": (_exploded("ctes"), CTE_SQL),
    "t11_writes": (_exploded("writes"), WRITE_SQL),
    "t12_variables": (_exploded("variables"), VARIABLE_SQL),
    "t12_transactions": (lambda s, d: _summaries(s, d).groupBy("s.isolation", "s.nolock", "s.pagination").agg(F.count("*").alias("n")), FLAG_SQL),
    "t14_sources": (_exploded("sources"), SOURCE_SQL),
    "t19_tables": (_part("table_name"), TABLE_SQL),
    "t19_keys": (_part("table_name", "primary_key", "foreign_keys"), None),
    "t21_clean": (_node(lambda: F.md5(ct.cleaned_code("text")), where="text IS NOT NULL"), None),
    "t22_windows": (_hits, HITS_SQL),
    "t23_phantom": (lambda s, d: _sql_texts(s, d).select("canonical_id", "import_id", ct.claims_missing_result_set(F.lit("returns rows"), "text").alias("out")), None),
    "t24_repeats": (_doc(lambda: x.repeats_itself("text")), r"SELECT doc_id, coalesce(length(text) > 200 AND len(list_distinct(regexp_split_to_array(trim(text, ' '), '\s+'))) < 10, false) AS out FROM documents"),
    "sc11_markdown_items": (lambda s, d: read(s, d, "documents").select("doc_id", F.explode(mk.apply(mk.markdown_items, "text", mk.ITEMS)).alias("i")).select("doc_id", "i.title", F.md5("i.body").alias("body")), None),
    "sc12_markdown_tables": (lambda s, d: read(s, d, "documents").select("doc_id", F.explode(mk.apply(mk.markdown_tables, "text", mk.CELLS)).alias("c")).select("doc_id", "c.*"), None),
}
