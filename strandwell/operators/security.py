"""Groups, policies and claims as tables.

A user's policies are merged in the order of their groups: lists as an ordered union, the highest level, the first
owner that is set. Claim names match exactly, else regardless of case and of slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_policies(rows: DataFrame, user: str = "user_id") -> DataFrame:
    """rows (user, position, acl, labels, level, owner) as one row a user."""
    empty = F.array().cast("array<string>")
    each = F.struct("position", F.coalesce("acl", empty).alias("acl"), F.coalesce("labels", empty).alias("labels"), F.nullif(F.trim("owner"), F.lit("")).alias("owner"), "level")
    g = rows.groupBy(user).agg(F.sort_array(F.collect_set(each)).alias("xs"), F.max("level").alias("level"))
    union = lambda f: F.array_distinct(F.flatten(F.transform("xs", lambda x: x[f])))
    return g.select(user, union("acl").alias("acl"), union("labels").alias("labels"), "level", F.try_element_at(F.filter(F.transform("xs", lambda x: x["owner"]), lambda o: o.isNotNull()), F.lit(1)).alias("owner"))


def groups_with_policies(groups: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """Every group with each of its policies; a group without one keeps a row."""
    return groups.join(policies, key, "left")


def assembled_policies(groups: DataFrame, users: DataFrame, acl: DataFrame, labels: DataFrame, pipelines: DataFrame, limits: DataFrame, key: str = "group_name") -> DataFrame:
    """(group_name, users, acl, labels, pipelines, level, owner) from the six policy tables; sorted lists, empty where there is nothing.

    users, acl, labels and pipelines are (group_name, value), limits (group_name, level, owner).
    """
    out = groups.select(key).distinct()
    for name, rows in (("users", users), ("acl", acl), ("labels", labels), ("pipelines", pipelines)):
        lists = rows.where("value IS NOT NULL").select(key, "value").distinct().groupBy(key).agg(F.sort_array(F.collect_list("value")).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.join(limits.groupBy(key).agg(F.max("level").alias("level"), F.max(F.nullif(F.trim("owner"), F.lit(""))).alias("owner")), key, "left")


def missing_tags(required: list[str], column: str = "acl_allow") -> Column:
    """What a row's tags lack of the required ones, sorted."""
    return F.sort_array(F.array_except(F.array(*[F.lit(t) for t in required]), column))


def visible_for(items: DataFrame, allowed: str, groups: list[str]) -> DataFrame:
    """Items that name no groups, or one of the user's, regardless of case (consultants, pipelines, templates)."""
    mine = F.array(*[F.lit(g.strip().lower()) for g in groups if g and g.strip()]).cast("array<string>")
    names = F.transform(F.coalesce(F.col(allowed), F.array().cast("array<string>")), lambda g: F.lower(F.trim(g)))
    return items.where((F.size(names) == 0) | F.arrays_overlap(names, mine))


def normalized_claim(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"^/+|/+$", "")


def groups_of_claims(claims: DataFrame, groups: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(user_id, group_name): each claim's group by exact name, else by normalized name, else by an alias (alias, group_name) of the
    claim or of one of its words."""
    exact = claims.join(groups.select("group_name"), F.col("claim") == F.col("group_name")).select("user_id", "claim", "group_name")
    rest = claims.join(exact.select("user_id", "claim"), ["user_id", "claim"], "left_anti").withColumn("k", normalized_claim("claim"))
    loose = rest.join(groups.groupBy(normalized_claim("group_name").alias("k")).agg(F.min("group_name").alias("group_name")), "k").select("user_id", "claim", "group_name")
    found = exact.unionByName(loose)
    if aliases is not None:
        left = claims.join(found.select("user_id", "claim"), ["user_id", "claim"], "left_anti")
        known = aliases.select(normalized_claim("alias").alias("k"), "group_name").where("k <> ''").distinct()
        words = F.array_union(F.array(normalized_claim("claim")), F.transform(F.split("claim", r"[\s,;/]+"), lambda w: F.regexp_replace(F.lower(F.trim(w)), r"^/+|/+$", "")))
        found = found.unionByName(left.withColumn("k", F.explode(words)).join(known, "k").select("user_id", "claim", "group_name"))
    return found.select("user_id", "group_name").distinct()


def with_entries(heads: DataFrame, entries: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """heads with a map of their entries; null where there are none."""
    maps = entries.where(F.col(name).isNotNull()).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.col(name).alias("k"), F.col(value).alias("v"))))).alias("entries"))
    return heads.join(maps, key, "left")


def claim_values(claims_json: str | Column, path: str) -> Column:
    """All values at a dotted path of JSON text, each `*` fanning out over an object's values; null if there is no text."""
    c = F.col(claims_json) if isinstance(claims_json, str) else claims_json
    found = F.when(c.isNotNull(), F.array(c))

    def field(name: str):
        return lambda v: F.get_json_object(v, f"$['{name}']")

    for part in [p for p in path.split(".") if p]:
        if part == "*":
            found = F.flatten(F.transform(found, lambda v: F.coalesce(F.map_values(F.from_json(v, "map<string,string>")), F.array().cast("array<string>"))))
        else:
            found = F.transform(found, field(part))
        found = F.array_compact(found)
    return found


def valid_at(versions: DataFrame, keys: list[str], moment: object) -> DataFrame:
    """The version of each key whose window holds moment; the newest if several do."""
    m = F.lit(moment)
    open_ = versions.where((F.col("valid_from") <= m) & (F.col("valid_to").isNull() | (F.col("valid_to") > m)))
    return open_.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("version")))).where("_n = 1").drop("_n")
