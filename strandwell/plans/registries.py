"""What a run can be given by name: query parsers, prompt builders, history backends, policy providers, model clients."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.functions import markup
from strandwell.session import new_path


class Registry:
    """Names, regardless of case, to factories; an unknown name is an error that lists the known ones, unless there is a default."""

    def __init__(self, kind: str, default: str | None = None) -> None:
        self.kind, self.default = kind, default
        self._known: dict[str, Callable[..., Any]] = {}

    def register(self, *names: str) -> Callable[[Callable], Callable]:
        def keep(factory: Callable) -> Callable:
            for n in names:
                if n.strip().lower() in self._known:
                    raise ValueError(f"two {self.kind}s are named {n}")
                self._known[n.strip().lower()] = factory
            return factory

        return keep

    def get(self, name: str | None) -> Callable[..., Any]:
        key = (name or self.default or "").strip().lower()
        if key not in self._known:
            raise ValueError(f"no {self.kind} is named {name!r}; known: {', '.join(sorted(self._known))}")
        return self._known[key]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._known))


query_parsers = Registry("query parser", "jsonish")
prompt_builders = Registry("prompt builder", "plain")


@query_parsers.register("jsonish", "jsonish_v1")
def jsonish(text: str) -> dict:
    """A JSON-like request, or the whole text as a query."""
    return json.loads(markup.query_payload(text))


@query_parsers.register("plain")
def plain_query(text: str) -> dict:
    return {"query": (text or "").strip(), "filters": {}}


@prompt_builders.register("plain")
def plain_prompt(system: str, dialog: list[tuple[str, str]], user: str) -> str:
    turns = "".join(f"User: {q}\nAssistant: {a}\n" for q, a in dialog)
    return f"{system}\n{turns}User: {user}\nAssistant:"


@prompt_builders.register("instruct", "inst")
def instruct_prompt(system: str, dialog: list[tuple[str, str]], user: str) -> str:
    return markup.chat_prompt(system, dialog, user)


class KeyValueHistory:
    """get, set and delete of JSON values by key, in a table of versions; the newest version of a key counts. A deleted or unknown key is None."""

    SCHEMA = "key string, value string, version bigint"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "key-values")
        self.spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        """(key, value, version) as they stand."""
        all_ = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = all_.groupBy("key").agg(F.max(F.struct("version", "value")).alias("m"))
        return last.select("key", "m.value", "m.version").where("value IS NOT NULL")

    def _put(self, key: str, value: str | None) -> None:
        version = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("key") == key).agg(F.max("version").alias("v")).first().v
        self.spark.createDataFrame([(key, value, (version or 0) + 1)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def get(self, key: str) -> Any:
        row = self.rows().where(F.col("key") == key).first()
        return json.loads(row.value) if row else None

    def set(self, key: str, value: Any) -> None:
        self._put(key, json.dumps(value, sort_keys=True))

    def delete(self, key: str) -> None:
        self._put(key, None)


def hybrid_model(servers: list[dict], local: Callable[[str], str], calls: dict[str, Callable[[str], str]]) -> Callable[[str, int, list[str], list[str]], tuple[str, str]]:
    """A model that asks the first server that may see the prompt's level, tags and labels, else the local one: (server or `local`, answer)."""

    def ask(prompt: str, level: int = 0, acl: list[str] = (), labels: list[str] = ()) -> tuple[str, str]:
        low = lambda xs: {str(x).lower() for x in xs or ()}
        for s in servers:
            enough = s.get("trusted") or ((level or 0) <= (s.get("max_level") or 0) and low(acl) <= low(s.get("acl")) and low(labels) <= low(s.get("labels")))
            if enough and s["id"] in calls:
                return s["id"], calls[s["id"]](prompt)
        return "local", local(prompt)

    return ask
