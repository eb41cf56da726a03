"""What a T-SQL text does: header, parameters, CTEs, queries, writes, flags, sources, predicates, flow, table definitions.

One tokenizer and one pass by statement; each part is taken on its own, so what one can't read is empty and the others
stand. `summarize` is a struct-valued Arrow UDF's body; null and other text give an empty summary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)|--[^\n]*|N?'(?:''|[^'])*'?|\[[^\]\n]*\]|\"[^\"\n]*\"|@@?\w+|\#{1,2}\w+|\d+(?:\.\d+)?|[A-Za-z_]\w*|<>|<=|>=|!=|[^\sA-Za-z0-9_]")
STARTERS = {"SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "EXEC", "EXECUTE", "IF", "ELSE", "WHILE", "BEGIN", "END", "RETURN", "DECLARE", "SET", "PRINT", "RAISERROR", "THROW", "COMMIT", "ROLLBACK", "CREATE", "ALTER", "DROP", "TRUNCATE", "WITH"}
AGGREGATES = {"SUM", "COUNT", "AVG", "MIN", "MAX", "STRING_AGG", "COUNT_BIG"}
MOST_COLUMNS = 64
MOST_PREDICATES = 24
MOST_ACTIONS = 12

SUMMARY = (
    "object string, params array<struct<name:string,type:string,default:string,output:boolean>>, ctes array<string>, "
    "selects array<struct<columns:int,tables:array<string>,has_where:boolean,has_group:boolean,has_order:boolean,has_aggregate:boolean,has_window:boolean,is_union:boolean>>, "
    "dml array<string>, writes array<struct<op:string,target:string>>, variables array<string>, pagination string, "
    "begin_tran int, commits int, rollbacks int, isolation string, nolock boolean, result_columns array<string>, "
    "sources array<struct<table:string,alias:string>>, equals array<string>, comparisons array<string>, in_lists array<string>, likes array<string>, "
    "flow array<string>, table_name string, table_columns array<struct<name:string,type:string,nullable:boolean>>, primary_key array<string>, foreign_keys array<string>, purpose string"
)
FIELDS = re.findall(r"(\w+) (?:array<|string|int|boolean)", re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "<", SUMMARY))


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql or "") if not t.startswith(("/*", "--"))]


def name_at(ts: list[str], i: int) -> tuple[str, int]:
    """A dotted name from i and where it ends, brackets off."""
    out = []
    while i < len(ts) and (re.match(r"[\[\"A-Za-z_#@]", ts[i]) or (ts[i] == "." and out)):
        if ts[i] == ".":
            i += 1
            continue
        if out and ts[i - 1] != ".":
            break
        out.append(ts[i].strip('[]"'))
        i += 1
    return ".".join(out), i


def statements(ts: list[str]) -> Iterator[list[str]]:
    """Statements at bracket depth zero; a starter opens the next one unless it belongs to the running one."""
    cur: list[str] = []
    depth = 0
    for k, t in enumerate(ts):
        u = t.upper()
        depth += (t == "(") - (t == ")")
        head = cur[0].upper() if cur else ""
        belongs = (
            (u == "SELECT" and head in ("INSERT", "WITH", "SELECT", "EXEC") and (head != "SELECT" or cur[-1].upper() in ("UNION", "ALL", "EXCEPT", "INTERSECT")))
            or (u == "SET" and head in ("UPDATE", "MERGE")) or (u in ("INSERT", "UPDATE", "DELETE") and head in ("MERGE", "WITH")) or (u in ("EXEC", "EXECUTE") and head == "INSERT") or (u == "END" and "CASE" in (x.upper() for x in cur))
            or (u == "WITH" and not (k + 2 < len(ts) and re.match(r"[\[A-Za-z_]", ts[k + 1]) and ts[k + 2].upper() in ("AS", "("))) or (u == "ELSE" and "CASE" in (x.upper() for x in cur))
        )
        if depth == 0 and (t == ";" or (u in STARTERS and not belongs and cur)):
            if cur:
                yield cur
            cur = [] if t == ";" else [t]
        else:
            cur.append(t)
    if cur:
        yield cur


def header(ts: list[str]) -> tuple[str, list[dict], int, list[str]]:
    """(object, parameters, index after AS, statements that stand among the parameters) of a procedure; an empty name if there is none."""
    up = [t.upper() for t in ts]
    for i, u in enumerate(up):
        if u in ("PROC", "PROCEDURE") and "CREATE" in up[max(0, i - 4) : i] + ["CREATE" if "ALTER" in up[max(0, i - 2) : i] else ""]:
            obj, j = name_at(ts, i + 1)
            params, depth = [], 0
            cur: list[str] = []
            strays: list[str] = []
            while j < len(ts) and not (up[j] == "AS" and depth <= 0 and not (cur and len(cur) == 1)):
                if depth <= 0 and cur and (ts[j] == ";" or (up[j] in STARTERS and up[j] != "WITH" and not (up[j] in ("EXEC", "EXECUTE") and up[j + 1 : j + 2] == ["AS"]))):
                    # A statement that got into the list ends where the list goes on, or at its end.
                    while j < len(ts) and not (depth <= 0 and ((ts[j] == "," and re.match(r"@\w+ [A-Za-z\[]", " ".join(ts[j + 1 : j + 3]))) or (up[j] == "AS" and up[j + 1 : j + 2] == ["BEGIN"]))):
                        depth += (ts[j] == "(") - (ts[j] == ")")
                        strays.append(ts[j])
                        j += 1
                    strays.append(";")
                    continue
                if ts[j].startswith("@") and depth <= 1 and len(cur) > 1 and cur[0].startswith("@") and cur[-1] != "=":  # a comma is missing
                    params.append(cur)
                    cur = []
                if ts[j] == "," and depth <= (1 if ts[i + 1 :][0:1] == ["("] else 0):
                    params.append(cur)
                    cur = []
                else:
                    depth += (ts[j] == "(") - (ts[j] == ")")
                    cur.append(ts[j])
                j += 1
            params.append(cur)
            return obj, [p for c in params if (p := _param(c))], j + 1, strays
    return "", [], 0, []


def _param(c: list[str]) -> dict | None:
    c = c[1:] if c and c[0] == "(" else c
    if not c or not c[0].startswith("@"):
        return None
    rest = c[1:]
    out = any(t.upper() in ("OUTPUT", "OUT") for t in rest)
    rest = [t for t in rest if t.upper() not in ("OUTPUT", "OUT", "READONLY", "AS")]
    eq = rest.index("=") if "=" in rest else len(rest)
    kind = re.sub(r"\s*([(),.])\s*", r"\1", " ".join(rest[:eq])).strip()
    if kind.count(")") > kind.count("("):
        kind = kind[:-1]
    return {"name": c[0], "type": kind, "default": " ".join(rest[eq + 1 :]) or None, "output": out}


def _at_depth(ts: list[str], words: set[str]) -> list[int]:
    depth, out = 0, []
    for i, t in enumerate(ts):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.upper() in words:
            out.append(i)
    return out


def _tables(st: list[str]) -> list[tuple[str, str]]:
    out = []
    for i, t in enumerate(st):
        if t.upper() in ("FROM", "JOIN") and i + 1 < len(st) and st[i + 1] != "(":
            name, j = name_at(st, i + 1)
            if not name:
                continue
            if j < len(st) and st[j].upper() == "AS":
                j += 1
            alias = st[j] if j < len(st) and re.match(r"[A-Za-z_]\w*$", st[j]) and st[j].upper() not in STARTERS | {"ON", "WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "GROUP", "ORDER", "HAVING", "UNION", "EXCEPT", "INTERSECT", "OPTION", "FOR"} else ""
            out.append((name, alias))
    return out


def _select(st: list[str]) -> dict:
    up = [t.upper() for t in st]
    at = _at_depth(st, {"FROM"})
    first = up.index("SELECT")
    cols = st[first + 1 : next((a for a in at if a > first), len(st))]
    return {
        "columns": 1 + len(_at_depth(cols, {","})) if cols else 0, "tables": list(dict.fromkeys(n for n, _ in _tables(st))), "has_where": bool(_at_depth(st, {"WHERE"})), "has_group": bool(_at_depth(st, {"GROUP"})),
        "has_order": bool(_at_depth(st, {"ORDER"})), "has_aggregate": any(u in AGGREGATES and st[i + 1 : i + 2] == ["("] for i, u in enumerate(up)), "has_window": any(u == "OVER" for u in up), "is_union": bool(_at_depth(st, {"UNION"})),
    }


def result_columns(st: list[str]) -> list[str]:
    up = [t.upper() for t in st]
    first = up.index("SELECT") + 1
    ends = [a for a in _at_depth(st, {"FROM", "WHERE", "UNION", "ORDER"}) if a > first]
    cols, cur, depth = [], [], 0
    for t in st[first : ends[0] if ends else len(st)] + [","]:
        depth += (t == "(") - (t == ")")
        if t == "," and depth == 0:
            cols.append(cur)
            cur = []
        else:
            cur.append(t)
    out = []
    for c in cols:
        c = [t for t in c if t.upper() not in ("DISTINCT",)]
        if len(c) > 2 and c[0].upper() == "TOP":
            c = c[2:] if c[1] != "(" else c[c.index(")") + 1 :]
        if not c or c[0].startswith("@"):
            continue
        ups = [t.upper() for t in c]
        if "AS" in ups and ups[-2] == "AS":
            out.append(c[-1].strip("[]\"'"))
        elif len(c) > 1 and c[1] == "=":
            out.append(c[0].strip("[]\"'"))
        else:
            out.append(c[-1].strip("[]\"'"))
    return out[:MOST_COLUMNS]


def predicates(st: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"equals": [], "comparisons": [], "in_lists": [], "likes": []}
    begin = next((i for i, t in enumerate(st) if t.upper() == "WHERE"), None)
    if begin is None:
        return out
    i = begin + 1
    while i < len(st):
        op = st[i].upper()
        left, start = "", i
        if op in ("=", "<", ">", "<=", ">=", "<>", "!=", "IN", "LIKE"):
            k = i - 1
            if st[k].upper() == "NOT":
                k -= 1
            while k > begin and (st[k] == "." or re.match(r"[\[\w@#\"]", st[k])) and st[k].upper() not in ("AND", "OR", "WHERE", "NOT"):
                left = st[k].strip('[]"') + left
                k -= 1
            right = st[i + 1] if i + 1 < len(st) else ""
            if op == "IN" and right == "(":
                end = next((j for j in range(i + 1, len(st)) if st[j] == ")"), len(st))
                right = "(" + "".join(st[i + 2 : end]) + ")"
            elif right and not right.startswith(("'", "N'", "@")) and i + 2 < len(st) and st[i + 2] == ".":
                right, _ = name_at(st, i + 1)
            where = "equals" if op == "=" else "in_lists" if op == "IN" else "likes" if op == "LIKE" else "comparisons"
            if left:
                out[where].append(f"{left} {'NOT ' if st[start - 1].upper() == 'NOT' else ''}{op} {right}")
        i += 1
    return {k: list(dict.fromkeys(v))[:MOST_PREDICATES] for k, v in out.items()}


def _flow(sts: list[list[str]]) -> list[str]:
    """One line an action, `>` deeper for each IF or BEGIN around it."""
    out, depth, blocks = [], 0, 0
    for st in sts:
        u = st[0].upper()
        if u == "BEGIN" and st[1:2] and st[1].upper() in ("TRAN", "TRANSACTION", "TRY", "CATCH"):
            continue
        if u == "BEGIN":
            blocks += 1
            continue
        if u == "END":
            blocks = max(0, blocks - 1)
            depth = min(depth, blocks)
            continue
        mark = ">" * max(depth, 0)
        if u in ("IF", "ELSE", "WHILE"):
            out.append(f"{mark}{u} {' '.join(st[1:8])}".strip())
            depth = blocks + 1
            continue
        if u in ("INSERT", "UPDATE", "DELETE", "MERGE", "EXEC", "EXECUTE", "SELECT", "RETURN", "THROW", "RAISERROR", "COMMIT", "ROLLBACK"):
            target = name_at(st, 2 if st[1:2] and st[1].upper() in ("INTO", "FROM") else 1)[0] if u != "SELECT" else ", ".join(n for n, _ in _tables(st)[:3])
            out.append(f"{mark}{'EXEC' if u == 'EXECUTE' else u} {target}".strip())
        depth = blocks
    return out[: 4 * MOST_ACTIONS]


def table_definition(ts: list[str]) -> dict:
    up = [t.upper() for t in ts]
    for i in range(len(ts) - 2):
        if up[i] == "CREATE" and up[i + 1] == "TABLE":
            name, j = name_at(ts, i + 2)
            if j >= len(ts) or ts[j] != "(":
                return {}
            depth, items, cur = 0, [], []
            for t in ts[j:]:
                depth += (t == "(") - (t == ")")
                if depth == 0:
                    break
                if t == "," and depth == 1:
                    items.append(cur)
                    cur = []
                elif not (t == "(" and depth == 1 and not cur and not items):
                    cur.append(t)
            items.append(cur)
            cols, pk, fks = [], [], []
            for c in items:
                u = [t.upper() for t in c]
                inner = [t.strip('[]"') for t in c[u.index("(") + 1 : u.index(")")] if t not in (",",) and t.upper() not in ("ASC", "DESC")] if "(" in u and ")" in u else []
                if not c:
                    continue
                if u[0] in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK"):
                    if "PRIMARY" in u:
                        pk = inner
                    if "REFERENCES" in u:
                        fks.append(f"{','.join(inner)} -> {name_at(c, u.index('REFERENCES') + 1)[0]}")
                    continue
                kind, k = name_at(c, 1)
                if k < len(c) and c[k] == "(":
                    kind += "".join(c[k : c.index(")", k) + 1])
                cols.append({"name": c[0].strip('[]"'), "type": kind, "nullable": not ("NOT" in u and "NULL" in u) and "PRIMARY" not in u})
                if "PRIMARY" in u:
                    pk = [cols[-1]["name"]]
                if "REFERENCES" in u:
                    fks.append(f"{cols[-1]['name']} -> {name_at(c, u.index('REFERENCES') + 1)[0]}")
            return {"table_name": name, "table_columns": cols, "primary_key": pk, "foreign_keys": fks}
    return {}


def _purpose(s: dict) -> str:
    if s["table_name"]:
        return f"defines {s['table_name']}"
    ops = list(dict.fromkeys(w["op"].lower() + " " + w["target"] for w in s["writes"]))[:3]
    if s["selects"] and not ops:
        return "reads " + ", ".join(dict.fromkeys(t for q in s["selects"] for t in q["tables"]))[:120]
    return "; ".join(ops)


def summarize(sql: str | None) -> dict:
    s: dict = dict.fromkeys(FIELDS)
    s |= {k: [] for k in ("params", "ctes", "selects", "dml", "writes", "variables", "result_columns", "sources", "equals", "comparisons", "in_lists", "likes", "flow", "table_columns", "primary_key", "foreign_keys")}
    s |= {"object": "", "begin_tran": 0, "commits": 0, "rollbacks": 0, "isolation": "", "nolock": False, "pagination": "", "table_name": "", "purpose": ""}
    ts = tokens(sql or "")
    if not ts:
        return s
    up = [t.upper() for t in ts]
    obj, params, body, strays = header(ts)
    sts = [*statements(strays), *statements(ts[body:])]
    ctes = [st[i + 1].strip("[]") for st in sts if st[0].upper() == "WITH" for i in [0, *_at_depth(st, {","})] if i + 2 < len(st) and st[i + 2].upper() in ("AS", "(") and re.match(r"[\[A-Za-z_]", st[i + 1])]
    ctes = list({c.lower(): c for c in ctes}.values())
    queries = [st for st in sts if "SELECT" in (t.upper() for t in st) and st[0].upper() in ("SELECT", "WITH", "INSERT")]
    writes = []
    for st in sts:
        ops = [i for i in _at_depth(st, {"INSERT", "UPDATE", "DELETE", "MERGE"})]
        if ops and st[0].upper() in ("INSERT", "UPDATE", "DELETE", "MERGE", "WITH"):
            i = ops[0]
            j = i + 2 if st[i + 1 : i + 2] and st[i + 1].upper() in ("INTO", "FROM") else i + 1
            writes.append({"op": st[i].upper(), "target": name_at(st, j)[0]})
    low = {c.lower() for c in ctes}
    sources: dict[tuple[str, str], None] = {}
    for st in sts:
        for n, a in _tables(st):
            if n.lower() not in low:
                sources.setdefault((n, a))
    preds = [predicates(st) for st in sts]
    top = [st for st in sts if st[0].upper() == "SELECT" and not (st[1:2] and st[1].startswith("@"))]
    iso = re.search(r"(?i)\bISOLATION\s+LEVEL\s+((?:READ\s+)?\w+)", sql or "")
    s |= {
        "object": obj, "params": params, "ctes": ctes, "selects": [_select(st) for st in queries], "dml": [op for op in ("INSERT", "UPDATE", "DELETE", "MERGE") if any(w["op"] == op for w in writes)], "writes": writes,
        "variables": list(dict.fromkeys([p["name"] for p in params] + [t for t in ts if re.match(r"@\w", t)])), "pagination": "offset" if "OFFSET" in up and ("FETCH" in up or "ROWS" in up) else "top" if "TOP" in up else "",
        "begin_tran": sum(up[i] == "BEGIN" and up[i + 1].startswith("TRAN") for i in range(len(up) - 1)), "commits": up.count("COMMIT"), "rollbacks": up.count("ROLLBACK"), "isolation": iso.group(1).upper() if iso else "", "nolock": "NOLOCK" in up,
        "result_columns": result_columns(top[-1]) if top else [], "sources": [{"table": n, "alias": a} for n, a in sources], "flow": _flow(sts),
    }
    for k in ("equals", "comparisons", "in_lists", "likes"):
        s[k] = list(dict.fromkeys(x for p in preds for x in p[k]))[:MOST_PREDICATES]
    s |= table_definition(ts)
    s["purpose"] = _purpose(s)
    return s


def _summaries(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([summarize(x) for x in b], columns=FIELDS)


def summary(sql: str | Column) -> Column:
    return F.pandas_udf(_summaries, SUMMARY)(F.col(sql) if isinstance(sql, str) else sql)


def summaries(rows: DataFrame, text: str = "text", out: str = "s") -> DataFrame:
    """rows with the summary of their text; each distinct text is read once. A null text has an empty summary."""
    keyed = rows.withColumn("_digest", F.md5(F.coalesce(F.col(text), F.lit(""))))
    texts = keyed.groupBy("_digest").agg(F.first(text).alias("_text")).select("_digest", summary("_text").alias(out))
    return keyed.join(texts, "_digest").drop("_digest")


def compact(s: str | Column) -> Column:
    """The summary as JSON under short keys."""
    c = F.col(s) if isinstance(s, str) else s
    return F.to_json(F.struct(c["object"].alias("obj"), c["params"].alias("params"), c["dml"].alias("dml"), F.transform(c["sources"], lambda x: x["table"]).alias("deps"), F.struct(c["begin_tran"].alias("begin"), c["commits"].alias("commit"), c["rollbacks"].alias("rollback")).alias("tx"), c["flow"].alias("flow"), c["writes"].alias("writes"), c["equals"].alias("filters")))
