"""A stored corpus in hash buckets with copy-on-write versions.

A table's rows lie in folders by a hash of their key. A manifest names each bucket's folders; a version is
one manifest. A run writes only its changes: new rows of a table that never changes rows are added to
their buckets' folders, changed rows make their buckets new, and every other bucket keeps its folders. So a
run's work grows with its changes and the buckets they fall into, and readers of a version are never disturbed.

Every run writes into a folder of its own and becomes visible with its manifest, which is created only if no
run has published since this one began: of two runs in conflict one wins, and the other deletes its own folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "paper": "id long, openalex_id string, title string, abstract string, publication_year int, doi string, cited_by_count long, abstract_source string, abstract_recovered_at string",
    "author": "openalex_id string, name string",
    "topic": "slug string, openalex_id string, name string",
    "paper_author": "openalex_id string, author_id string",
    "paper_topic": "openalex_id string, slug string",
    "paper_embedding": "paper_id long, embedding array<double>",
    "ingest_state": "topic string, last_full_ingest_at string, last_incremental_at string",
    "ingest_dlq": "run_type string, topic string, openalex_id string, doi string, title string, reason string, error_detail string, attempts int, status string",
    "attempt": "key string, task string, paper_id long, run string, batch int, state string, attempts int",
}
#: The column that a table's rows are dealt by; tables whose rows are replaced by that key; others only grow.
KEYS = {"paper": "openalex_id", "author": "openalex_id", "topic": "slug", "paper_author": "openalex_id", "paper_topic": "openalex_id", "paper_embedding": "paper_id", "ingest_state": "topic", "ingest_dlq": "openalex_id", "attempt": "key"}
REPLACED = ("paper", "paper_embedding", "ingest_state", "attempt")
#: Buckets of a new store, and folders that a bucket of a growing table may have before it is written anew.
BUCKETS, FOLDERS = 64, 16


class Conflict(RuntimeError):
    """Another run published after this one began."""


class Store:
    """Versioned tables below ``folder``, which driver and executors share; ``buckets`` counts for a new store."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(x.split(".")[0]) for x in names if x.endswith(".json") and not x.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, by default the newest's; one that was cut off while it was written doesn't count."""
        for number in reversed(self._numbers()) if version is None else [version]:
            lines = self.spark.read.text(f"{self.folder}/manifests/{number:09d}.json", wholetext=True).collect()
            try:
                return json.loads("".join(r.value for r in lines)) | {"version": number}
            except ValueError:
                continue
        return {"version": 0, "buckets": self.buckets, "tables": {}, "facts": {}}

    def versions(self) -> list[int]:
        newest = self.manifest()["version"]
        return [n for n in self._numbers() if n <= newest]

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        known = self.manifest(version)
        return {name: self.read(name, known) for name in SCHEMAS}

    def read(self, name: str, known: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of a manifest, or only some of its buckets."""
        own = known["tables"].get(name, {})
        folders = [f for b in (own if buckets is None else map(str, buckets)) for f in own.get(b, ())]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def begin(self) -> Attempt:
        return Attempt(self)

    def publish(self, changes: dict[str, DataFrame], facts: dict | None = None) -> int:
        """The changes as one version; its number."""
        attempt = self.begin()
        try:
            return attempt.publish(changes, facts or {})
        except BaseException:
            attempt.abandon()
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the last ``keep`` name; how many runs' folders went. No run may be under way."""
        numbers = self.versions()
        named = {f for n in numbers[-keep:] for own in self.manifest(n)["tables"].values() for folders in own.values() for f in folders}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{n:09d}.json"), False)
        at, gone = self._path(f"{self.folder}/runs"), 0
        for x in self._fs.listStatus(at) if self._fs.exists(at) else []:
            own = f"{self.folder}/runs/{x.getPath().getName()}"
            for kind in ("new", "whole"):
                for table in SCHEMAS:
                    there = self._path(f"{own}/{kind}/{table}")
                    for bucket in self._fs.listStatus(there) if self._fs.exists(there) else []:
                        name = f"{own}/{kind}/{table}/{bucket.getPath().getName()}"
                        if bucket.isDirectory() and name not in named:
                            self._fs.delete(self._path(name), True)
            if not any(f.startswith(f"{own}/") for f in named):
                self._fs.delete(self._path(own), True)
                gone += 1
        return gone


class Attempt:
    """One run over the version that was the newest when it began."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.base = store.manifest()
        self.folder = f"{store.folder}/runs/{uuid.uuid4().hex}"

    @property
    def facts(self) -> dict:
        return self.base["facts"]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.base["buckets"])).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets of a column of keys: at most all buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0]))).distinct().collect())

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        return self.store.read(name, self.base, buckets)

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` as they are now: stored for this run, so that all that is made of them sees the same."""
        path = f"{self.folder}/kept/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _written(self, rows: DataFrame, kind: str, name: str) -> dict[str, str]:
        """Folder of each bucket that gets rows. Of rows with a column ``__new`` those are left out that have a new row of their key."""
        path, columns = f"{self.folder}/{kind}/{name}", self.spark.createDataFrame([], SCHEMAS[name]).columns
        rows = rows.withColumn("__bucket", self.bucket(F.col(KEYS[name]))).repartition("__bucket")
        if "__new" in rows.columns:  # in the buckets' tasks, so that stored rows are shuffled once
            newest = F.max("__new").over(Window.partitionBy("__bucket", KEYS[name]))
            rows = rows.withColumn("__newest", newest).where(F.col("__new") | ~F.col("__newest") | F.col(KEYS[name]).isNull())
        rows.select(*columns, "__bucket").write.partitionBy("__bucket").parquet(path)
        found = [x.getPath().getName() for x in self.store._fs.listStatus(self.store._path(path)) if x.isDirectory()]
        return {x.removeprefix("__bucket="): f"{path}/{x}" for x in found if x.startswith("__bucket=")}

    def publish(self, changes: dict[str, DataFrame], facts: dict) -> int:
        """Write the changes and make them a version; raises Conflict if another run was faster."""
        tables = {name: dict(own) for name, own in self.base["tables"].items()}
        for name, rows in changes.items():
            own = tables.setdefault(name, {})
            new = self._written(rows, "new", name)
            if name in REPLACED:
                anew = [b for b in new if own.get(b)]
                fresh = self.spark.read.schema(SCHEMAS[name]).parquet(*(new[b] for b in anew)).withColumn("__new", F.lit(True)) if anew else None
                merged = self.read(name, anew).withColumn("__new", F.lit(False)).unionByName(fresh) if anew else None
            else:
                anew = [b for b in new if len(own.get(b, ())) >= FOLDERS]
                merged = self.read(name, anew).unionByName(self.spark.read.schema(SCHEMAS[name]).parquet(*(new[b] for b in anew))) if anew else None
            whole = self._written(merged, "whole", name) if merged is not None else {}
            for b, folder in new.items():
                own[b] = [whole[b]] if b in whole else [*own.get(b, ()), folder]
        newest, numbers = self.store.manifest()["version"], self.store._numbers()
        if newest != self.base["version"]:
            raise Conflict(f"version {newest} was published by another run")
        number = (numbers or [0])[-1] + 1
        text = json.dumps({"buckets": self.base["buckets"], "tables": tables, "facts": self.facts | facts})
        try:
            out = self.store._fs.create(self.store._path(f"{self.store.folder}/manifests/{number:09d}.json"), False)
        except Py4JJavaError as error:
            raise Conflict(f"version {number} was published by another run") from error
        out.write(bytearray(text.encode()))
        out.close()
        self._drop("kept")
        return number

    def _drop(self, what: str) -> None:
        self.store._fs.delete(self.store._path(f"{self.folder}/{what}" if what else self.folder), True)

    def abandon(self) -> None:
        """Delete what this run wrote; no other run's files."""
        self._drop("")
