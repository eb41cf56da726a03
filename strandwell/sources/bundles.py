"""Bundles of nodes and edges: a folder or zip of JSON, JSONL and CSV, read as node and edge tables.

Field names come in several spellings; the first that is set counts. Blank lines and rows without an id are skipped;
empty lists are null; a negative level is null.
"""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.operators.snapshots import first_wins

def open_bundle(path: str, work: str | None = None) -> tuple[Path, dict]:
    """The folder that holds repo_meta.json (a zip is unpacked over what is there), and the meta data under plain names."""
    root = Path(path)
    if root.suffix == ".zip":
        target = Path(work or root.with_suffix(""))
        with zipfile.ZipFile(root) as z:
            for n in z.namelist():
                if not (target / n).resolve().is_relative_to(target.resolve()):
                    raise ValueError("the zip reaches outside of its folder")
            z.extractall(target)
        root = target
    found = sorted(root.rglob("repo_meta.json"), key=lambda p: len(p.parts))
    if not found:
        raise ValueError("no repo_meta.json in the bundle")
    raw = json.loads(found[0].read_text())
    pick = lambda *names: next((raw[n] for n in names if raw.get(n)), None)
    return found[0].parent, {"repo": pick("RepoName", "repo", "Repo"), "branch": pick("Branch", "branch") or "(unknown)", "head_sha": pick("HeadSha", "head_sha", "Head"), "fingerprint": pick("FolderFingerprint", "folder_fingerprint")}


def first_existing(root: Path, names: list[str]) -> str | None:
    return next((str(root / n) for n in names if (root / n).exists()), None)


def _any(*names: str) -> Column:
    """The first of the fields in map `m` that is set."""
    return F.coalesce(*[F.nullif(F.trim(F.col("m")[n]), F.lit("")) for n in names])


def _nodes(raw: DataFrame, data_type: str, file_type: str) -> DataFrame:
    """Rows of JSON objects (value), each parsed once into a map of its fields, as nodes."""
    m = raw.where(F.length(F.trim("value")) > 0).select(F.from_json("value", "map<string,string>").alias("m"))
    listed = lambda n: F.from_json(F.col("m")[n], "array<string>")
    none_if_empty = lambda c: F.when(F.size(c) > 0, c)
    whole = lambda *names: _any(*names).try_cast("int")
    level = whole("clearance_level", "doc_level")
    return m.select(
        _any("Id", "id", "key").alias("local_id"), _any("File", "source_file", "file").alias("source_file"), _any("RepoRelativePath", "repo_relative_path", "File", "file").alias("repo_relative_path"), _any("ProjectName", "project_name").alias("project_name"),
        _any("Class", "class").alias("class_name"), _any("Member", "member").alias("member_name"), _any("Type", "type").alias("symbol_type"), _any("Signature", "signature").alias("signature"), _any("kind").alias("sql_kind"), _any("schema").alias("sql_schema"), _any("name").alias("sql_name"),
        F.coalesce(_any("data_type"), F.lit(data_type)).alias("data_type"), F.coalesce(_any("file_type"), F.lit(file_type)).alias("file_type"), _any("domain").alias("domain"), _any("source_system_id").alias("source_system_id"), _any("owner_id").alias("owner_id"),
        F.coalesce(F.col("m")["Text"], F.col("m")["text"], F.col("m")["body"]).alias("text"), whole("ChunkPart", "chunk_part").alias("chunk_part"), whole("ChunkTotal", "chunk_total").alias("chunk_total"),
        F.when(level >= 0, level).alias("doc_level"), none_if_empty(listed("acl_allow")).alias("acl_allow"), none_if_empty(F.coalesce(listed("classification_labels_all"), listed("classification_labels"))).alias("classification_labels"),
    ).where("local_id IS NOT NULL")


def cs_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chunks."""
    whole = spark.read.option("wholetext", True).text(path)
    return _nodes(whole.select(F.explode(F.from_json("value", "array<string>")).alias("value")), "regular_code", "cs")


def sql_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line."""
    return _nodes(spark.read.text(path), "sql_code", "sql")


def legacy_sql_nodes(spark: SparkSession, csv: str, bodies: str, acl_enabled: bool = False) -> DataFrame:
    """CSV rows joined to body files by the end of their path; refused where access lists are on, as it has none."""
    if acl_enabled:
        raise ValueError("the CSV form has no access lists")
    rows = spark.read.option("header", True).csv(csv).withColumn("_row", F.monotonically_increasing_id())
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    path = F.translate("body_path", "\\", "/")
    texts = spark.read.option("wholetext", True).text(bodies).select(F.concat(F.lit("/"), F.input_file_name()).alias("_file"), name(F.input_file_name()).alias("_name"), F.col("value").alias("body"))
    both = rows.withColumns({"_name": name(path), "_end": F.concat(F.lit("/"), F.regexp_replace(path, "^(?:\\./|/)+", ""))}).join(texts, "_name", "left")
    # Of files of the same name that whose path ends as the row's does; the shortest, if several do.
    fits = F.coalesce(F.col("_file").endswith(F.col("_end")), F.lit(False))
    joined = first_wins(both.withColumn("body", F.when(fits, F.col("body"))), ["_row"], [F.when(fits, 0).otherwise(1), F.length("_file"), "_file"]).drop("_row", "_end", "_file")
    return _nodes(joined.drop("_name").select(F.to_json(F.struct("*")).alias("value")), "sql_code", "sql")


def cs_edges(spark: SparkSession, path: str) -> DataFrame:
    """{id: [ids]} as edges of type cs_dep."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("src", "ids")).select("src", F.explode("ids").alias("dst"), F.lit("cs_dep").alias("edge_type")).where("src <> '' AND dst <> ''")


def sql_edges(spark: SparkSession, path: str) -> DataFrame:
    """CSV edges under any of their column names, typed sql_<relation>; incomplete rows are skipped."""
    rows = spark.read.option("header", True).csv(path)
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    out = rows.select(pick("from", "from_id", "From").alias("src"), pick("to", "to_id", "To").alias("dst"), F.concat(F.lit("sql_"), F.coalesce(pick("relation", "type", "edge_type"), F.lit("edge"))).alias("edge_type"))
    return out.where("src IS NOT NULL AND dst IS NOT NULL")


def as_records(nodes: DataFrame, meta: dict, snapshot_id: str, import_id: str) -> DataFrame:
    """Bundle nodes as node rows of one import, the first row of an id kept."""
    kind = F.when(F.col("data_type") == "regular_code", "cs").otherwise("sql")
    ided = nodes.withColumns({
        "canonical_id": F.concat_ws("::", F.lit(meta["repo"]), F.lit(snapshot_id), kind, "local_id"), "repo": F.lit(meta["repo"]), "branch": F.lit(meta["branch"]), "head_sha": F.lit(meta["head_sha"]),
        "snapshot_id": F.lit(snapshot_id), "import_id": F.lit(import_id), "_n": F.monotonically_increasing_id(),
    })
    return first_wins(ided, ["canonical_id"], ["_n"]).drop("_n")


def markdown_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(title, body) of a Markdown corpus file."""
    from strandwell.functions import markup

    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(markup.apply(markup.markdown_items, "value", markup.ITEMS)).alias("i")).select("i.*")
