"""Scope, access and metadata predicates over nodes, as Column builders.

Nulls carry meaning: a null acl_allow is public, a null doc_level is open to every clearance. A filter whose parameter
is empty leaves the rows as they are, except where its docstring says that this is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA_TYPES = {"regular_code": "regular_code", "db_code": "sql_code", "sql_code": "sql_code"}
ACL_ALIASES = ("acl_tags_any", "permission_tags_any", "permission_tags_all")
LEVEL_ALIASES = ("user_level", "clearance_level", "doc_level_max")
LABEL_ALIASES = ("classification_labels_all", "labels_any", "classification_labels")


def strings(values: object) -> list[str]:
    """A list of trimmed, non-blank strings from nothing, one value or several."""
    if values is None:
        return []
    if isinstance(values, str) or not isinstance(values, Iterable):
        values = [values]
    return [s for v in values if v is not None and (s := str(v).strip())]


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def equals(column: str, value: str | None) -> Column:
    """Equality if value is given, else true (repo, owner, source system, data type)."""
    return F.col(column) == value if value and value.strip() else F.lit(True)


def in_snapshot(snapshot_id: str | None) -> Column:
    """The snapshot scope is mandatory, and one snapshot."""
    if isinstance(snapshot_id, (list, tuple, set)):
        raise ValueError("snapshot_id names one snapshot")
    if not snapshot_id or not str(snapshot_id).strip():
        raise ValueError("a snapshot_id is required")
    return F.col("snapshot_id") == str(snapshot_id).strip()


def acl_any(tags: Iterable[str] | None, enabled: bool = True) -> Column:
    """Shares a tag, or is public (null); a list that holds nothing but null is not public."""
    tags = strings(tags)
    if not enabled or not tags:
        return F.lit(True)
    return F.col("acl_allow").isNull() | F.coalesce(F.arrays_overlap("acl_allow", literal_array(tags)), F.lit(False))


def labels_any(labels: Iterable[str] | None, allow_unlabeled: bool = True) -> Column:
    """Shares a label; unlabeled rows pass if allowed. The cheap predicate that goes before ranking."""
    labels = strings(labels)
    if not labels:
        return F.lit(True)
    hit = F.coalesce(F.arrays_overlap("classification_labels", literal_array(labels)), F.lit(False))
    bare = F.col("classification_labels").isNull()
    return hit | bare if allow_unlabeled else hit


def labels_subset(labels: Iterable[str] | None, allow_unlabeled: bool = True) -> Column:
    """All of a row's labels are the user's; run after the top-k, so fewer rows may be left."""
    labels = strings(labels)
    if not labels:
        return F.lit(True)
    inside = F.size(F.array_except("classification_labels", literal_array(labels))) == 0
    return F.coalesce(inside, F.lit(allow_unlabeled))


def labels_within_universe(labels: Iterable[str], universe: Iterable[str]) -> Column:
    """No label of the universe that the user lacks; strict: labels outside the universe fail too."""
    allowed, known = set(strings(labels)), strings(universe)
    if not known:
        return F.lit(True)
    banned = [u for u in known if u not in allowed]
    outside = F.size(F.array_except("classification_labels", literal_array(known))) > 0
    return F.coalesce(~F.arrays_overlap("classification_labels", literal_array(banned)) & ~outside, F.lit(True))


def clearance(level: int | None) -> Column:
    """doc_level up to the user's, or none; without a user level nothing is filtered."""
    return F.lit(True) if level is None else (F.col("doc_level").isNull() | (F.col("doc_level") <= level))


def id_in(ids: Iterable[str], column: str = "canonical_id") -> Column:
    ids = strings(ids)
    if not ids:
        raise ValueError("an IN list must hold a value")
    return F.col(column).isin(ids)


def coerced_int(value: object) -> int | None:
    """True to 1, number text to its whole part, anything else to None."""
    try:
        return int(float(value)) if value is not None and str(value).strip() else None
    except (TypeError, ValueError, OverflowError):
        return None


def first_of(filters: Mapping[str, object], names: Sequence[str]) -> object:
    return next((filters[n] for n in names if filters.get(n) not in (None, "", [])), None)


def normalized(filters: Mapping[str, object]) -> dict[str, object]:
    """Known data types only, aliases folded, empty lists dropped."""
    out: dict[str, object] = {}
    for key, value in filters.items():
        if key == "data_type":
            kinds = [DATA_TYPES[v.lower()] for v in strings(value) if v.lower() in DATA_TYPES]
            if kinds:
                out[key] = kinds[0] if len(kinds) == 1 else kinds
        elif key in ACL_ALIASES or key in LABEL_ALIASES:
            if strings(value):
                out.setdefault(ACL_ALIASES[0] if key in ACL_ALIASES else LABEL_ALIASES[0], strings(value))
        elif key in LEVEL_ALIASES:
            if coerced_int(value) is not None:
                out.setdefault(LEVEL_ALIASES[0], coerced_int(value))
        elif value not in (None, "", [], {}):
            out[key] = value
    return out


def merged(parsed: Mapping[str, object], base: Mapping[str, object]) -> dict[str, object]:
    """What the query asked for, overwritten by what security demands."""
    return {**normalized(parsed), **normalized(base)}


ALLOWED_OVERRIDES = {"repo": str, "snapshot_id": str, "branch": str, "data_type": str, "file_type": str, "owner_id": str, "source_system_id": str, "user_level": int, "acl_tags_any": list, "classification_labels_all": list}


def checked_overrides(overrides: Mapping[str, object]) -> dict[str, object]:
    """Unknown keys are refused, values coerced to their type."""
    unknown = sorted(set(overrides) - set(ALLOWED_OVERRIDES))
    if unknown:
        raise ValueError(f"unknown retrieval filters: {unknown}")
    out = {}
    for key, value in overrides.items():
        kind = ALLOWED_OVERRIDES[key]
        out[key] = strings(value) if kind is list else coerced_int(value) if kind is int else str(value).strip()
    return out


def may_see(filters: Mapping[str, object], acl_enabled: bool = True, universe: Iterable[str] | None = None) -> Column:
    """The asker's access alone: a shared tag or none, no label that the asker lacks, a level within the clearance.

    With a universe of labels, rows fail on its labels that the asker lacks and on labels outside it.
    """
    f = normalized(filters)
    labels = f.get(LABEL_ALIASES[0])
    of_labels = labels_within_universe(labels or [], universe) if strings(universe) else labels_subset(labels)
    return acl_any(f.get(ACL_ALIASES[0]), acl_enabled) & of_labels & clearance(f.get(LEVEL_ALIASES[0]))


def asked_for(filters: Mapping[str, object]) -> Column:
    """The metadata predicates of a query, without snapshot and access."""
    f = normalized(filters)
    out = F.lit(True)
    for key in ("repo", "branch", "owner_id", "source_system_id", "file_type"):
        out = out & equals(key, f.get(key))
    kinds = f.get("data_type")
    return out & F.col("data_type").isin(kinds if isinstance(kinds, list) else [kinds]) if kinds else out


def scope(filters: Mapping[str, object], acl_enabled: bool = True, allow_unlabeled: bool = True) -> Column:
    """All predicates that go before ranking, in one conjunction that Catalyst pushes to the scan."""
    f = normalized(filters)
    before = in_snapshot(f.get("snapshot_id")) & asked_for(f)
    return before & acl_any(f.get(ACL_ALIASES[0]), acl_enabled) & labels_any(f.get(LABEL_ALIASES[0]), allow_unlabeled) & clearance(f.get(LEVEL_ALIASES[0]))


def ref_is(ref: str) -> Column:
    """A run of that tag, ref name or branch."""
    return F.coalesce(F.col("tag") == ref, F.lit(False)) | F.coalesce(F.col("ref_name") == ref, F.lit(False)) | F.coalesce(F.col("branch") == ref, F.lit(False))


def title_contains(q: str | None, column: str = "title") -> Column:
    return F.lower(column).contains(q.lower()) if q else F.lit(True)


def not_deleted(column: str = "deleted_at") -> Column:
    return F.col(column).isNull()


def declared_filter(lists: Mapping[str, Iterable[str]]) -> Column:
    """List filters: any of the values for plain columns, name_prefix by prefix, permission_tags_all as a whole set."""
    out = F.lit(True)
    for key, values in lists.items():
        v = strings(values)
        if not v:
            continue
        if key == "name_prefix":
            any_prefix = F.lit(False)
            for p in v:
                any_prefix = any_prefix | F.coalesce(F.col("sql_name").startswith(p), F.lit(False))
            out = out & any_prefix
        elif key == "permission_tags_all":
            out = out & (F.size(F.array_except(literal_array(v), F.coalesce("acl_allow", F.array().cast("array<string>")))) == 0)
        else:
            out = out & F.col(key).isin(v)
    return out


def gate_reasons(score: str, least: float, problems: str, categories: str, forbidden: Iterable[str]) -> Column:
    """Why a row fails the quality gates: low_score, problems, forbidden_category; an empty array passes. A null score is low."""
    low = F.coalesce(F.col(score) < least, F.lit(True))
    trouble = F.coalesce(F.size(F.col(problems)) > 0, F.lit(False))
    banned = F.coalesce(F.arrays_overlap(categories, literal_array(strings(forbidden))), F.lit(False))
    return F.array_compact(F.array(F.when(low, "low_score"), F.when(trouble, "problems"), F.when(banned, "forbidden_category")))


def admissible_servers(requests: DataFrame, servers: DataFrame) -> DataFrame:
    """(request_id, server_id) of the first server by position that may see a request: trusted, or level and sets suffice.

    servers is a settings table; its rows are replicated to the requests by an explode of one array, not a join.
    """
    each = F.struct("position", "server_id", "trusted", "max_level", "acl", "labels")
    listed = servers.agg(F.sort_array(F.collect_list(each)).alias("servers")).first()
    rows = [tuple(s) for s in (listed.servers if listed else [])]
    if not rows:
        return requests.select("request_id", F.lit(None).cast("string").alias("server_id"))
    kinds = servers.select(each.alias("s")).schema["s"].dataType
    table = F.from_json(F.lit(requests.sparkSession.createDataFrame([(rows,)], "s array<" + kinds.simpleString() + ">").select(F.to_json("s")).first()[0]), f"array<{kinds.simpleString()}>")
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    ok = F.filter(
        table,
        lambda s: F.coalesce(s.trusted, F.lit(False))
        | (
            (F.coalesce(F.col("doc_level"), F.lit(0)) <= F.coalesce(s.max_level, F.lit(0)))
            & (F.size(F.array_except(low(F.col("acl")), low(s.acl))) == 0)
            & (F.size(F.array_except(low(F.col("labels")), low(s.labels))) == 0)
        ),
    )
    return requests.select("request_id", F.try_element_at(ok, F.lit(1)).server_id.alias("server_id"))
