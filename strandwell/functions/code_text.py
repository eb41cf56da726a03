"""Is a text C#, SQL, both or neither; cleaning and compressing code.

Scores are declarative: tables of patterns with a weight for being there and one for each hit, counted by the JVM's
regular expressions over text whose comments are gone and whose literals are `__STR__`. Each distinct text is scored once.
A pattern is only tried where the words it needs are there, and words are counted from one scan. Literals are rows of
their own: the few with SQL words are scored, and their scores are summed by text. Nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.functions.scalars import sigmoid

_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)|//[^\n]*+|--[^\n]*+"
# Raw, verbatim and plain literals with prefixes, and SQL literals; each runs to its closing quote, over line ends too.
_STRING = r"\$?\"\"\"(?s:.*?)(?:\"\"\"|\z)|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*+(?:\"|\z)|\$?\"(?:[^\"\\]|\\(?s:.))*+(?:\"|\z)|'(?:[^']|'')*+(?:'|\z)"

# Fixed values: (pattern, weight if present, weight of each hit) of C#.
DOTNET = [
    (r"(?m)^\s*using\s+[A-Za-z0-9_.]+\s*;\s*$", 8.0, 1.5),
    (r"(?m)^\s*namespace\s+[A-Za-z0-9_.]+\s*[{;]", 10.0, 2.0),
    ("=>", 6.0, 0.4),
    (r"(?m)^\s*\[[A-Za-z_][A-Za-z0-9_.]*.*?\]\s*$", 6.0, 0.8),
    (r"\b[A-Za-z_][A-Za-z0-9_]*\s*<\s*[A-Za-z0-9_,\s.?]+\s*>", 4.0, 0.5),
    (r"\.\s*(?:Select|Where|ToList|FirstOrDefault|Any|All|Join|GroupBy|OrderBy)\s*\(", 3.0, 0.4),
    (r"\btry\s*\{|\bcatch\s*\(|\bfinally\s*\{", 2.0, 0.4),
    (r"\bget\s*;\s*set\s*;\b", 1.5, 0.3),
]
#: Of which at least one must be in a text for each of these to be tried.
_NEEDED = [("using",), ("namespace",), ("=>",), ("[",), ("<",), ("Select", "Where", "ToList", "FirstOrDefault", "Any", "All", "Join", "GroupBy", "OrderBy"), ("try", "catch", "finally"), ("get",)]
# Fixed values: (words, weight of each that is present, weight of each hit).
DOTNET_WORDS = [("class struct record interface", 8.0, 1.0), ("async await", 3.0, 0.7), ("public private internal protected static var new", 1.5, 0.3)]
# Names that tell of a schema migration.
MIGRATION = [r"\bMigration\b", r"\bMigrationBuilder\b", r"\bmigrationBuilder\b", r"\bprotected\s+override\s+void\s+Up\s*\(", r"\bprotected\s+override\s+void\s+Down\s*\(", r"\bCreateTable\s*\(", r"\bAlterColumn\s*\(", r"\bAddColumn\s*\(", r"\bDropTable\s*\(", r"\bRenameColumn\s*\(", r"\bRenameTable\s*\(", r"\bSql\s*\(", r"\bModelSnapshot\b"]
#: A part of each of these that a text must have.
_MIGRATION_WORDS = ["Migration", "MigrationBuilder", "migrationBuilder", "override", "override", "CreateTable", "AlterColumn", "AddColumn", "DropTable", "RenameColumn", "RenameTable", "Sql", "ModelSnapshot"]
# Calls and names that run SQL.
CALLSITE = r"\b(?:FromSqlRaw|FromSqlInterpolated|ExecuteSqlRaw|ExecuteSqlRawAsync|ExecuteSqlInterpolated|ExecuteAsync|QueryAsync|ExecuteScalarAsync)\s*\(|\b(?:DbCommand|SqlCommand|CommandText|Dapper)\b"
# SQL keywords, each worth 2.2 once and 0.18 a hit, and statement patterns.
SQL_WORDS = "SELECT FROM WHERE JOIN LEFT RIGHT INNER OUTER GROUP BY ORDER HAVING UNION INSERT INTO UPDATE DELETE MERGE CREATE ALTER DROP PROCEDURE PROC DECLARE SET BEGIN END EXEC EXECUTE WITH TOP DISTINCT CASE WHEN THEN ELSE AS RETURNS TRY CATCH THROW TRAN COMMIT ROLLBACK".split()
SQL_PATTERNS = [
    (r"\bCREATE\s+TABLE\b", 12.0), (r"\bCREATE\s+(?:UNIQUE\s+)?INDEX\b", 7.0), (r"\bCREATE\s+(?:OR\s+ALTER\s+)?FUNCTION\b", 12.0), (r"\bCREATE\s+(?:OR\s+ALTER\s+)?VIEW\b", 10.0),
    (r"\bCREATE\s+(?:OR\s+ALTER\s+)?TRIGGER\b", 10.0), (r"\bCREATE\s+(?:OR\s+ALTER\s+)?PROCEDURE\b|\bCREATE\s+PROC\b", 12.0), (r"\bDECLARE\s+@\w+|\bSET\s+@\w+", 9.0), (r"(?m)^\s*GO\s*$", 6.0), (r"\bWITH\s*\(\s*NOLOCK\s*\)", 4.0),
    (r"(?s)\bSELECT\b.{0,2000}?\bFROM\b", 10.0), (r"(?s)\bUPDATE\b.{0,2000}?\bSET\b", 9.0), (r"(?s)\bINSERT\b.{0,120}?\bINTO\b", 9.0), (r"(?s)\bDELETE\b.{0,120}?\bFROM\b", 9.0),
]
# SQL in literals. Phrases and functions each worth LITERAL_WORD, parameters LITERAL_PARAM up to six, clauses with an object their weight.
LITERAL_PHRASES = [
    "select", "from", "where", "join", "group by", "order by", "having", "insert into", "update", "delete from", "merge", "create table", "create procedure", "create proc", "alter table", "drop table", "create index",
    "drop index", "create view", "create trigger", "declare", "set", "exec", "execute", "with (nolock)", "union all",
]
LITERAL_FUNCTIONS = ["isnull", "coalesce", "datediff", "dateadd", "getdate", "cast", "convert", "sysutcdatetime"]
LITERAL_WORD, LITERAL_PARAM, LITERAL_LINES, LITERAL_QUOTED = 2.1, 1.1, 2.0, 1.07
LITERAL_SHORT, LITERAL_LEAST_WORDS, LITERAL_LEAST_PARAMS, LITERAL_LEAST = 60, 4, 2, 7.0
JOINED_WORD, JOINED_PARAM, JOINED_CLAUSE, JOINED_MOST, JOINED_CHARS = 1.6, 1.0, 10.0, 22.0, 4000
_NO_OBJECT = r"(?!(?:where|join|inner|left|right|full|group|order|having|union|select|on|cross|outer)\b)"
LITERAL_CLAUSES = [
    (rf"\A(?>.*?\bselect\b.{{0,2000}}\bfrom\b\s+(?=.)){_NO_OBJECT}[\[#a-z_]", 9.0),
    (rf"\A(?>.*?\bupdate\b\s+(?=.{{1,80}}\bset\b)){_NO_OBJECT}[\[#a-z_]", 8.0),
    (rf"\A(?>.*?\binsert\b.{{0,120}}\binto\b\s+(?=.)){_NO_OBJECT}[\[#a-z_]", 8.0),
    (rf"\A(?>.*?\bdelete\b.{{0,120}}\bfrom\b\s+(?=.)){_NO_OBJECT}[\[#a-z_]", 8.0),
    (rf"\A\s*(?:exec|execute)\s+{_NO_OBJECT}[\[a-z_]", 7.0),
]
# What is strong, by size, and what is enough SQL in literals.
SMALL_WORDS, STRONG, DEEP, NEARLY, SITE_ENOUGH, LEANING = 60, (14.0, 18.0), (12.0, 14.0), 2.0, 8.5, 9.0
#: kind by level of C# (0 weak, 1 nearly strong, 2 strong) and level of SQL: (with enough SQL in literals, else).
KINDS = {
    (0, 0): ("unknown", "unknown"), (0, 1): ("sql", "sql"), (0, 2): ("sql", "sql"),
    (1, 0): ("dotnet_with_sql", "dotnet"), (1, 1): ("dotnet_with_sql", "unknown"), (1, 2): ("sql", "sql"),
    (2, 0): ("dotnet_with_sql", "dotnet"), (2, 1): ("dotnet_with_sql", "unknown"), (2, 2): ("dotnet_with_sql", "unknown"),
}


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def marked(text: str | Column) -> Column:
    """Comments as an empty mark and literals between marks, by one scan, so that quotes in comments don't matter."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[\u0001\u0002]", ""), f"(?:{_COMMENT})|({_STRING})", "\u0001$1\u0002")


def code_only(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(marked(text), "\u0001\u0002", ""), "\u0001[^\u0002]+\u0002", "__STR__")


def literals(text: str | Column) -> Column:
    return F.regexp_extract_all(marked(text), F.lit("\u0001([^\u0002]+)\u0002"), F.lit(1))


def weighted_hits(counts: str, table: list[tuple[str, float, float]]) -> Column:
    """The table's weights over an array column of its patterns' counts."""
    out = F.lit(0.0)
    for k, (_, base, each) in enumerate(table):
        n = F.col(counts)[k]
        out = out + F.when(n > 0, base + each * n).otherwise(0.0)
    return out


def word_score(words: Column, wanted: list[str], base: float, each: float) -> Column:
    """base for each wanted word that is present and each for every hit; words are an array."""
    hits = F.filter(words, lambda w: w.isin(wanted))
    return base * F.size(F.array_distinct(hits)) + each * F.size(hits)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _tried(text: Column, needed: tuple[str, ...], found: Column) -> Column:
    """found, which is only evaluated where one of the needed parts is in the text; else false."""
    return F.when(_any(text, needed), found).otherwise(F.lit(False))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _of_literal(content: Column) -> tuple[Column, Column, Column]:
    """(distinct phrases and functions, parameters, weight of clauses) of a lower-cased literal."""
    words = _sum([content.contains(p).cast("int") for p in LITERAL_PHRASES] + [_tried(content, (f,), content.rlike(rf"\b{f}\b")).cast("int") for f in LITERAL_FUNCTIONS])
    params = F.when(content.contains("@"), F.regexp_count(content, F.lit(r"@\w+"))).otherwise(0)
    needed = ["select", "update", "insert", "delete", "exec"]
    clauses = _sum([F.when(_tried(content, (n,), content.rlike(p)), w).otherwise(0.0) for n, (p, w) in zip(needed, LITERAL_CLAUSES)])
    return words, params, clauses


def literal_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, quote, lines, content) of every literal that holds more than blanks; content with single blanks, doubled quotes undone."""
    raw = texts.select(key, F.posexplode(literals(text)).alias("n", "raw"))
    verbatim = F.col("raw").rlike(r"\A(?:\$@|@)")
    inner = F.regexp_replace("raw", r"(?s)\A[$@]*(?:\"\"\"(.*?)(?:\"\"\")?|\"(.*?)\"?|'(.*?)'?)\z", "$1$2$3")
    body = F.when(F.col("raw").startswith("'"), F.replace(inner, F.lit("''"), F.lit("'"))).when(verbatim, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(inner)
    lines = verbatim | F.col("raw").rlike(r"\A\$?\"\"\"") | F.col("raw").contains("\n")
    rows = raw.select(key, "n", F.when(F.col("raw").startswith("'"), "'").otherwise('"').alias("quote"), lines.alias("lines"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("content"))
    return rows.where(F.length("content") > 0)


def embedded_scores(rows: DataFrame, key: str) -> DataFrame:
    """(key, embedded): the sum over literal_rows of those that are SQL enough by themselves."""
    low = F.lower("content")
    likely = rows.where(_any(low, ("select", "from", "where", "join", " by", "having", "into", "update", "delete", "merge", "create", "table", "declare", "set", "exec", "union", "@")))
    words, params, clauses = _of_literal(F.col("low"))
    d = likely.withColumn("low", low).withColumns({"words": words, "params": params, "clauses": clauses})
    local = LITERAL_WORD * F.col("words") + LITERAL_PARAM * F.least("params", F.lit(6)) + F.col("clauses") + F.when(F.col("lines"), LITERAL_LINES).otherwise(0.0)
    d = d.withColumn("local", F.when(F.col("quote") == '"', local * LITERAL_QUOTED).otherwise(local))
    heard = (F.col("clauses") > 0) | ((F.length("content") >= LITERAL_SHORT) & ((F.col("words") >= LITERAL_LEAST_WORDS) | (F.col("params") >= LITERAL_LEAST_PARAMS)))
    return d.where(heard & (F.col("local") >= LITERAL_LEAST)).groupBy(key).agg(F.sum("local").alias("embedded"))


def joined_scores(rows: DataFrame, key: str) -> DataFrame:
    """(key, joined): SQL that is split over several double-quoted literals of a text, its first JOINED_CHARS characters or so."""
    before = F.coalesce(F.sum(F.length("content")).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.where(F.col("quote") == '"').withColumn("before", before).where(F.col("before") < JOINED_CHARS)
    whole = parts.groupBy(key).agg(F.count("*").alias("parts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), " ").alias("content"))  # JOINED_CHARS and one literal
    words, params, clauses = _of_literal(F.col("low"))
    d = whole.where("parts > 1").withColumn("low", F.lower("content")).withColumns({"words": words, "params": params, "clauses": clauses}).where("clauses > 0")
    return d.select(key, F.least(F.lit(JOINED_MOST), JOINED_WORD * F.col("words") + JOINED_PARAM * F.least("params", F.lit(6)) + JOINED_CLAUSE).alias("joined"))


def kind_of(net: Column, sql: Column, embedded: Column, words: Column, site: Column) -> Column:
    """The kind by KINDS."""
    small = words < SMALL_WORDS
    strong, deep = F.when(small, STRONG[0]).otherwise(STRONG[1]), F.when(small, DEEP[0]).otherwise(DEEP[1])

    def level(score: Column) -> Column:
        return F.when(score >= strong, 2).when(score >= strong - NEARLY, 1).otherwise(0)

    enough = (embedded >= LEANING) | ((net >= strong) & ((embedded >= deep) | (site & (embedded >= SITE_ENOUGH))))
    table = F.create_map(*[F.lit(x) for (n, q), (rich, poor) in KINDS.items() for x in ((n * 3 + q) * 2 + 1, rich, (n * 3 + q) * 2, poor)])
    return F.element_at(table, (level(net) * 3 + level(sql)) * 2 + enough.cast("int"))


def classified(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with kind (dotnet, sql, dotnet_with_sql, unknown), confidence and the three scores. A null text is an empty one."""
    keyed = rows.withColumn("_digest", F.md5(F.coalesce(F.col(text), F.lit(""))))
    texts = keyed.groupBy("_digest").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    return keyed.join(scores(texts, "_digest", "_text"), "_digest").drop("_digest")


def scores(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, confidence, dotnet_score, sql_score, embedded_sql_score) of distinct texts."""
    code, upper = F.col("_code"), F.col("_upper")
    d = texts.withColumn("_code", code_only(text)).withColumn("_upper", F.upper("_code"))
    d = d.withColumns({"_words": F.regexp_extract_all(code, F.lit(r"\w+"), F.lit(0)), "_hits": F.array(*[F.when(_any(code, need), _count(code, p)).otherwise(0) for need, (p, _, _) in zip(_NEEDED, DOTNET)])})
    d = d.withColumns({"_sql": F.filter(F.transform("_words", F.upper), lambda w: w.isin(SQL_WORDS)), "_n": F.size("_words")})
    mig = _sum([_tried(code, (word,), code.rlike(p)).cast("int") for word, p in zip(_MIGRATION_WORDS, MIGRATION)])
    mig_sql = _tried(code, ("migrationBuilder",), code.rlike(r"\bmigrationBuilder\s*\.\s*Sql\s*\("))
    site = _tried(code, ("Sql", "Execute", "Query", "DbCommand", "CommandText", "Dapper"), code.rlike(CALLSITE))
    d = d.withColumns({"_mig": mig, "_migsql": mig_sql, "_site": site, "_kinds": F.array_distinct("_sql")})
    has = lambda *words: reduce(lambda a, b: a & b, [F.array_contains("_kinds", w) for w in words])
    gates = [*[has("CREATE")] * 6, upper.contains("@"), upper.contains("GO"), upper.contains("NOLOCK"), has("SELECT", "FROM"), has("UPDATE", "SET"), has("INSERT", "INTO"), has("DELETE", "FROM")]
    sql = 2.2 * F.size("_kinds") + 0.18 * F.size("_sql") + _sum([F.when(F.when(g, upper.rlike(p)).otherwise(False), w).otherwise(0.0) for g, (p, w) in zip(gates, SQL_PATTERNS)])
    sql = sql + F.when(F.when(has("BEGIN", "TRY"), upper.rlike(r"\bBEGIN\s+TRY\b") & upper.rlike(r"\bBEGIN\s+TRAN(?:SACTION)?\b")).otherwise(False), 8.0).otherwise(0.0)
    semis, braces = F.length(code) - F.length(F.translate(code, ";", "")), F.length(code) - F.length(F.translate(code, "{}", ""))
    net = (
        weighted_hits("_hits", DOTNET) + _sum([word_score(F.col("_words"), w.split(), base, each) for w, base, each in DOTNET_WORDS])
        + F.when((semis >= 3) & (braces >= 2), 2.5).otherwise(0.0) + F.when(semis >= 15, 3.0).otherwise(0.0)
        + F.when(F.col("_mig") >= 2, 6.0 + F.col("_mig")).otherwise(0.0) + F.when(F.col("_migsql"), 4.0).otherwise(0.0) + F.when(F.col("_site"), 3.5).otherwise(0.0)
    )
    size = F.length(text)
    settings = F.regexp_count(text, F.lit(r"(?m)^\s*[A-Za-z0-9_.-]+\s*=\s*.+$"))
    config = F.when((F.col("dotnet_score") < 16) & (F.col("sql_score") < 16), ((settings >= 1) & F.col(text).rlike(r"(?m)^\s*\[[^\]]+\]\s*$")) | ((settings >= 3) & (size < 800))).otherwise(False)
    d = d.withColumns({"dotnet_score": net, "sql_score": sql}).withColumns({"_config": config, "_size": size, "_site": F.col("_site") | F.col("_migsql"), "_forced": (F.col("_mig") >= 2) & F.col("_migsql")})
    d = d.select(key, "dotnet_score", "sql_score", "_config", "_size", "_site", "_forced", "_n")
    found = literal_rows(texts, key, text)
    d = d.join(embedded_scores(found, key), key, "left").join(joined_scores(found, key), key, "left")
    plain = ~F.col("_config") & ~F.col("_forced")
    d = d.withColumn("embedded_sql_score", F.coalesce("embedded", F.lit(0.0)) + F.when(plain & F.col("_site"), F.coalesce("joined", F.lit(0.0))).otherwise(0.0))
    net, sql, emb = F.col("dotnet_score"), F.col("sql_score"), F.col("embedded_sql_score")
    d = d.withColumn("kind", F.when(F.col("_config"), "unknown").when(F.col("_forced"), "dotnet_with_sql").otherwise(kind_of(net, sql, emb, F.col("_n"), F.col("_site"))))
    rich = F.col("kind") == "dotnet_with_sql"
    base = sigmoid((F.abs(net - sql) - 6) / 6) * sigmoid((F.greatest(net, sql, F.when(rich, emb).otherwise(0.0)) - 10) / 8)
    base = F.when(rich, F.greatest(base, sigmoid((emb - 10) / 6))).otherwise(base)
    short = F.when((F.col("_n") < 15) | (F.col("_size") < 120), 0.6).when((F.col("_n") < 30) | (F.col("_size") < 200), 0.75).otherwise(1.0)
    sure = F.when(F.col("_config"), 0.65).when(F.col("_forced"), 0.92).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.99), base * short)))
    return d.select(key, "kind", F.round(sure, 6).alias("confidence"), *[F.round(c, 6).alias(c) for c in ("dotnet_score", "sql_score", "embedded_sql_score")])


def language_of(kind: str | Column) -> Column:
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.when(c.isin("dotnet", "dotnet_with_sql"), "dotnet").when(c == "sql", "sql").otherwise("unknown")


def cleaned_code(text: str | Column, kind: str = "cs") -> Column:
    """Without comments, regions, pragmas, attributes, usings (C#) or comments and docstrings (py) and blank lines; literals stay."""
    c = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\r\n?", "\n")
    if kind == "py":
        c = F.regexp_replace(F.regexp_replace(c, r"(?m)^[ \t]*(?:\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)''')[ \t]*$", ""), r"(?m)(?<=^|\s)#[^\n\"']*$", "")
    else:
        c = F.regexp_replace(c, f"({_STRING}|https?://\\S+)|(?:{_COMMENT.replace('|--[^\n]*+', '') if kind != 'sql' else _COMMENT})", "$1")
        if kind == "cs":
            c = F.regexp_replace(c, r"(?m)^[ \t]*(?:#(?:region|endregion|pragma)[^\n]*|using\s+[\w.]+\s*;|\[[A-Z][^\n]*\])[ \t]*$", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"\n{2,}", "\n")


def hit_windows(lines: DataFrame, doc: str, around: int = 18, gap: int = 3) -> DataFrame:
    """(doc, from_line, to_line) of the windows around hit lines, windows within gap of each other merged."""
    w = Window.partitionBy(doc).orderBy("line_no")
    d = lines.select(doc, "line_no").distinct().withColumn("before", F.lag("line_no").over(w))
    d = d.withColumn("new", F.when(F.col("before").isNull() | (F.col("line_no") - F.col("before") > 2 * around + gap), 1).otherwise(0)).withColumn("grp", F.sum("new").over(w))
    return d.groupBy(doc, "grp").agg(F.greatest(F.lit(1), F.min("line_no") - around).alias("from_line"), (F.max("line_no") + around).alias("to_line")).drop("grp")


def claims_missing_result_set(summary: str | Column, sql: str | Column) -> Column:
    """The summary tells of a result set, but the SQL has no SELECT that returns rows."""
    body = code_only(sql)
    returns = body.rlike(r"(?im)^\s*SELECT\b(?!\s+@\w+\s*=)(?!(?s:.{0,2000}?)\bINTO\b)")
    return F.coalesce(F.lower(summary).rlike(r"result set|returns rows|zwraca|wynik"), F.lit(False)) & ~returns
