"""Text formats: lenient JSON, PlantUML, Markdown, prompts. Python bodies run as Arrow UDFs through `apply`."""

from __future__ import annotations

import ast
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIXBIT = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"  # fixed value: PlantUML's alphabet


def apply(fn: Callable[[str | None], object], column: str | Column, kind: str = "string") -> Column:
    """fn over a text column, batch by batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([fn(x) for x in b], dtype=object)

    return F.pandas_udf(run, kind)(F.col(column) if isinstance(column, str) else column)


def lenient_json(text: str | None) -> str | None:
    """JSON, or what nearly is: missing braces, `=` for `:`, bare keys, trailing commas, Python literals; else null. Sorted and compact."""
    if not text or not text.strip():
        return None
    s = re.sub(r"^```\w*\s*|\s*```$", "", text.strip())
    tries = [s, s if s.startswith(("{", "[")) else "{" + s + "}"]
    fixed = re.sub(r"(?<=[{,])\s*([A-Za-z_][\w.-]*)\s*[:=]", r' "\1":', re.sub(r",\s*(?=[}\]])", "", tries[1]))
    tries += [fixed, re.sub(r":\s*([A-Za-z_][\w .-]*?)\s*(?=[,}])", lambda m: ": " + (m.group(1) if m.group(1) in ("true", "false", "null") else json.dumps(m.group(1))), fixed)]
    for t in tries:
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            continue
    for t in (tries[1], tries[0], fixed):
        try:
            return json.dumps(ast.literal_eval(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            continue
    return None


RESERVED = ("search_type", "mode", "top_k", "rrf_k", "match_operator")


def query_payload(text: str | None) -> str | None:
    """{query, reserved settings, filters} of a model's search request; plain text is a query."""
    parsed = json.loads(lenient_json(text) or "null") if text and re.search(r"[:={]", text) else None
    data = parsed if isinstance(parsed, dict) else {"query": (text or "").strip()}
    query = str(data.pop("query", data.pop("q", "")) or "")
    out: dict = {}
    if m := re.search(r"\bsearch_type\s*[:=]\s*(\w+)", query):
        out["search_type"] = m.group(1).lower()
        query = (query[: m.start()] + query[m.end() :]).strip(" ,;")
    filters = data.pop("filters", {}) or {}
    for k in RESERVED:
        if k in data:
            out["search_type" if k == "mode" else k] = data.pop(k)
    return json.dumps({"query": query, **out, "filters": {**data, **(filters if isinstance(filters, dict) else {})}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def decision(text: str | None) -> tuple[str | None, str | None]:
    """The lower-case decision, route or mode of a payload, and the payload as sorted JSON."""
    plain = lenient_json(text)
    data = json.loads(plain) if plain else None
    if not isinstance(data, dict):
        return None, None
    name = next((str(data[k]).strip().lower() for k in ("decision", "route", "mode") if data.get(k)), None)
    return name, plain


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text, brackets in strings not counted; null if there is none."""
    begin, depth, quoted, escaped = -1, 0, False, False
    for i, c in enumerate(text or ""):
        if begin >= 0 and quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"' and begin >= 0:
            quoted = True
        elif c == "{":
            begin, depth = (i if begin < 0 else begin), depth + 1
        elif c == "}" and begin >= 0:
            depth -= 1
            if not depth:
                return text[begin : i + 1]
    return None


def plantuml_encoded(text: str | None) -> str | None:
    """Raw deflate in PlantUML's six-bit alphabet."""
    if text is None:
        return None
    data = zlib.compress(text.encode(), 9)[2:-4]
    out = []
    for i in range(0, len(data), 3):
        b = data[i : i + 3]
        n = int.from_bytes(b.ljust(3, b"\0"), "big")
        out.append("".join(SIXBIT[n >> s & 63] for s in (18, 12, 6, 0)[: len(b) + 1]))  # no signs for bytes that are not there
    return "".join(out)


def plantuml_decoded(code: str) -> str:
    at = {c: i for i, c in enumerate(SIXBIT)}
    data = bytearray()
    for i in range(0, len(code), 4):
        part = code[i : i + 4]
        n = 0
        for c in part:
            n = n << 6 | at[c]
        data += (n << 6 * (4 - len(part))).to_bytes(3, "big")[: len(part) - 1]
    return zlib.decompressobj(-15).decompress(bytes(data)).decode()


_ARROW = re.compile(r'^\s*("[^"]+"|:[^:]+:|\([^)]+\)|[\w.]+)\s*([<.\-|>*o#]+(?:\w*[.\-]+)?[<.\-|>*o#]*)\s*("[^"]+"|:[^:]+:|\([^)]+\)|[\w.]+)\s*(?::\s*(.*))?$')
_DECLARED = re.compile(r'^\s*(actor|usecase|class|component|interface)\s+("[^"]+"|:[^:]+:|\([^)]+\)|[\w.]+)(?:\s+as\s+(\w+))?')


def uml_model(text: str | None) -> list[dict]:
    """Elements and relations of PlantUML text: {part, kind, name, target, label}; ends that are not declared are elements too."""
    out: list[dict] = []
    names: dict[str, str] = {}

    def element(raw: str, kind: str | None = None, alias: str | None = None) -> str:
        name = raw.strip('":()')
        kind = kind or ("actor" if raw.startswith(":") else "usecase" if raw.startswith("(") else "element")
        if raw in names or name in names:
            return names.get(raw, names.get(name, name))
        names[raw] = names[name] = name
        if alias:
            names[alias] = name
        out.append({"part": "element", "kind": kind, "name": name, "target": None, "label": None})
        return name

    for line in (text or "").splitlines():
        if m := _DECLARED.match(line):
            element(m.group(2), m.group(1), m.group(3))
        elif (m := _ARROW.match(line)) and re.search(r"[.\-]", m.group(2)):
            label = (m.group(4) or "").strip()
            kind = "include" if "include" in label else "extend" if "extend" in label else "generalization" if "|>" in m.group(2) or "<|" in m.group(2) else "association"
            a, b = element(m.group(1)), element(m.group(3))
            out.append({"part": "relation", "kind": kind, "name": a, "target": b, "label": label or None})
    return out


UML = "array<struct<part:string,kind:string,name:string,target:string,label:string>>"


def xmi_text(model: list[dict]) -> str:
    """A model as XMI 2.1 with elements on a grid."""
    from xml.sax.saxutils import quoteattr

    els = [m for m in model if m["part"] == "element"]
    ids = {m["name"]: f"E{n}" for n, m in enumerate(els, 1)}
    kinds = {"actor": "uml:Actor", "usecase": "uml:UseCase", "class": "uml:Class"}
    rows = ['<?xml version="1.0" encoding="UTF-8"?>', '<xmi:XMI xmi:version="2.1" xmlns:uml="http://schema.omg.org/spec/UML/2.1" xmlns:xmi="http://schema.omg.org/spec/XMI/2.1">', '<uml:Model xmi:type="uml:Model" name="Model">']
    rows += [f'<packagedElement xmi:type="{kinds.get(m["kind"], "uml:Component")}" xmi:id="{ids[m["name"]]}" name={quoteattr(m["name"])}/>' for m in els]
    rows += [f'<packagedElement xmi:type="uml:{m["kind"].capitalize()}" xmi:id="R{n}" client="{ids[m["name"]]}" supplier="{ids[m["target"]]}"/>' for n, m in enumerate((m for m in model if m["part"] == "relation"), 1)]
    rows += ["</uml:Model>", "<diagram>"] + [f'<element subject="{ids[m["name"]]}" geometry="Left={40 + n % 4 * 180};Top={40 + n // 4 * 110};"/>' for n, m in enumerate(els)] + ["</diagram>", "</xmi:XMI>"]
    return "\n".join(rows)


_PROTECTED = re.compile(r"`[^`\n]+`|https?://[^\s)>\]]+|(?<=\]\()[^)\s]+|\b\w+(?:\.\w+)+\(?\)?|\b[a-z]+[A-Z]\w*\b|\b\w+_\w+\b")


def protected(text: str) -> tuple[str, list[str]]:
    """Text with placeholders for what a translator must leave: inline code, links, code-like words."""
    kept: list[str] = []

    def put(m: re.Match) -> str:
        kept.append(m.group())
        return f"{len(kept) - 1}"

    return _PROTECTED.sub(put, text), kept


def restored(text: str, kept: list[str]) -> str:
    return re.sub("(\\d+)", lambda m: kept[int(m.group(1))], text)


def translated_markdown(text: str | None, translate: Callable[[str], str]) -> str | None:
    """Line by line, list and heading signs kept, fences, rules and Source lines left as they are."""
    if text is None:
        return None
    out, fence = [], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fence = not fence
            out.append(line)
            continue
        m = re.match(r"^(\s*(?:[-*+]|\d+\.|#{1,6}|>)?\s*)(.*)$", line)
        if fence or not m.group(2).strip() or re.match(r"^\s*(?:-{3,}|\*{3,}|Source:)", line):
            out.append(line)
        else:
            inner, kept = protected(m.group(2))
            out.append(m.group(1) + restored(translate(inner), kept))
    return "\n".join(out)


def markdown_items(text: str | None) -> list[dict]:
    """A corpus in Markdown: its JSON block's items, else its code blocks under the nearest heading, else its headings."""
    blocks = re.findall(r"(?ms)^```(\w*)\s*\n(.*?)^```", text or "")
    for lang, body in blocks:
        if lang == "json":
            try:
                data = json.loads(body)
            except ValueError:
                continue
            return [{"title": str(d.get("title", d.get("id", n))) if isinstance(d, dict) else str(n), "body": json.dumps(d, ensure_ascii=False, sort_keys=True)} for n, d in enumerate(data if isinstance(data, list) else [data])]
    out, heading = [], ""
    for m in re.finditer(r"(?m)^#{1,6}\s+(.*)$|^```(\w*)\s*\n([\s\S]*?)^```", text or ""):
        if m.group(1) is not None:
            heading = m.group(1).strip()
        else:
            out.append({"title": heading, "body": m.group(3)})
    return out or [{"title": h.strip(), "body": ""} for h in re.findall(r"(?m)^#{1,6}\s+(.*)$", text or "")]


ITEMS = "array<struct<title:string,body:string>>"


def markdown_tables(text: str | None) -> list[dict]:
    """Cells of Markdown tables: {heading, row, column, cell}; rows from 1 without the head."""
    out, heading, head, n = [], "", [], 0
    for line in (text or "").splitlines():
        if line.startswith("#"):
            heading, head = line.lstrip("# ").strip(), []
        elif line.strip().startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not head:
                head, n = cells, 0
            elif not all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                n += 1
                out += [{"heading": heading, "row": n, "column": h, "cell": c} for h, c in zip(head, cells)]
        else:
            head = []
    return out


CELLS = "array<struct<heading:string,row:int,column:string,cell:string>>"


def chat_prompt(system: str, turns: list[tuple[str, str]], question: str) -> str:
    """Turns in [INST] form, the system text in the first; roles must alternate from the user; control tokens are defused."""
    safe = lambda t: re.sub(r"(\[|<)(?=/?INST\]|<SYS>>|</SYS>>|/?s>)", r"\1 ", t)
    out, first = [], f"<<SYS>>\n{safe(system)}\n<</SYS>>\n\n" if system else ""
    for n, (q, a) in enumerate([*turns, (question, "")]):
        if not q:
            raise ValueError("a turn has no question")
        out.append(f"<s>[INST] {first if n == 0 else ''}{safe(q)} [/INST]" + (f" {safe(a)} </s>" if a else ""))
    return "".join(out)
