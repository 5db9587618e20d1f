"""Backfill of a store in keyed batches: abstracts that are missing, and vectors.

A run claims its papers once: they get places in the order of their ids, and every ``size`` of them are a batch.
A batch's answers are stored before they are used, under the run's name and the batch's number, and its changes
are published as one version together with a ledger row a paper and the run's progress. So a run that was killed
goes on where it ended when it is started again under its name: published batches are left out, and stored
answers are read instead of asked for. Each paper is asked for once a run, also where another run publishes in
between and the batch is published again over its version.

A source that fails costs its batch only: the papers are noted as failed and stay due for a later run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import runs as U
from folio.operators.store import Attempt, Conflict, Store

#: Papers of a batch and of a run, and batches without a result in a row that end it.
SIZE, LIMIT, EMPTY = 20, 1000, 2
#: Tasks that ask for a batch, and versions of others that a batch is published over.
SPREAD, CONFLICTS = 4, 8


def placed(rows: DataFrame, key: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``place`` of each row from 0 in the order of its unique key: ranges are sorted apart, the counts of those
    before give their offsets, so no task sorts all rows. ``keep`` stores the ranges, so that they stay as they are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(rows.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", before.alias("__before"))  # ``parts`` rows
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return dealt.withColumn("__at", inside).join(F.broadcast(offsets), "__part").withColumn("place", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


@dataclass(frozen=True)
class Abstracts:
    """Papers with a doi and without an abstract get what ``found`` (of id, openalex_id, doi) has: (id, abstract, abstract_source)."""

    found: Callable[[DataFrame], DataFrame]
    now: str
    provider: object = None
    name: str = "abstract"

    def due(self, tables: U.Tables) -> DataFrame:
        return tables["paper"].where("abstract is null and doi is not null").select("id", "openalex_id", "doi")

    def answers(self, part: DataFrame) -> DataFrame:
        got = self.found(part).where(F.trim("abstract") != "").select("id", "abstract", "abstract_source")
        return part.select("id", "openalex_id").join(got, "id")

    def changes(self, attempt: Attempt, answers: DataFrame) -> tuple[U.Tables, DataFrame]:
        """(changed rows, ids that got something): papers that have an abstract by now keep it."""
        papers = attempt.read("paper", attempt.buckets_of(answers.select("openalex_id")))
        still = papers.where("abstract is null").join(answers.select("id").distinct(), "id", "left_semi")
        new = attempt.keep(U.with_abstracts(still, answers, self.now).select(*papers.columns), "paper")
        out = {"paper": new}
        if self.provider is not None:
            out["paper_embedding"] = U.embedded(new, self.provider)
        return out, new.select("id")


@dataclass(frozen=True)
class Vectors:
    """Papers with text and without a vector get the provider's."""

    provider: object
    name: str = "vector"

    def due(self, tables: U.Tables) -> DataFrame:
        text = T.paper_text(F.col("title"), F.col("abstract"))
        return tables["paper"].where(text != "").join(tables["paper_embedding"].select(F.col("paper_id").alias("id")), "id", "left_anti").select("id", "openalex_id", "title", "abstract")

    def answers(self, part: DataFrame) -> DataFrame:
        return U.embedded(part, self.provider)

    def changes(self, attempt: Attempt, answers: DataFrame) -> tuple[U.Tables, DataFrame]:
        there = attempt.read("paper_embedding", attempt.buckets_of(answers.select("paper_id")))
        new = attempt.keep(answers.join(there.select("paper_id"), "paper_id", "left_anti"), "vectors")
        return {"paper_embedding": new}, new.select(F.col("paper_id").alias("id"))


class Backfill:
    """A run of ``task`` over a store, known by its name ``run``."""

    def __init__(self, store: Store, task: Abstracts | Vectors, run: str, *, size: int = SIZE, limit: int | None = LIMIT, most_attempts: int | None = None):
        self.store, self.task, self.size, self.limit, self.most_attempts = store, task, max(1, size), limit, most_attempts
        self.key, self.folder = f"{task.name}-{run}", f"{store.folder}/backfill/{task.name}-{run}"

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What was stored under ``name``, else ``make()``, which is stored now; a table that was cut off while it was written is made again."""
        path, spark = f"{self.folder}/{name}", self.store.spark
        if not self.store._fs.exists(self.store._path(f"{path}/_SUCCESS")):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def claimed(self) -> DataFrame:
        """The run's papers with ``place`` and ``batch``: the first ``limit`` by id of those due when it began. Papers that
        were attempted ``most_attempts`` times, by whatever run, are left out."""

        def make() -> DataFrame:
            tables = self.store.tables()
            rows = self.task.due(tables)
            if self.most_attempts is not None:
                tired = tables["attempt"].where((F.col("task") == self.task.name) & (F.col("attempts") >= self.most_attempts))
                rows = rows.join(tired.select(F.col("paper_id").alias("id")), "id", "left_anti")
            keep = lambda dealt: self._once("ranges", lambda: dealt)
            out = placed(rows, "id", keep)
            out = out if self.limit is None else out.where(F.col("place") < self.limit)
            return out.withColumn("batch", F.floor(F.col("place") / self.size).cast("int")).sortWithinPartitions("place")

        return self._once("due", make)

    def progress(self, attempt: Attempt) -> dict:
        return attempt.facts.get("backfill", {}).get(self.key, {"next": 0, "attempted": 0, "done": 0, "empty": 0, "failed": 0, "error": None})

    def run(self, most_empty: int | None = EMPTY, most_batches: int | None = None) -> Row:
        """Batches until none is left, ``most_empty`` in a row had no result, or ``most_batches`` were published by this call.

        (attempted, done, failed: papers of the run so far; batches: of this call; left: papers of the run not attempted;
        error: of the last batch whose source failed). A run that empty batches ended stays ended under its name.
        """
        due = self.claimed()
        sizes = {r["batch"]: r["n"] for r in due.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a batch
        batches = conflicts = 0
        while True:
            attempt = self.store.begin()
            own = self.progress(attempt)
            if own["next"] >= len(sizes) or (most_empty is not None and own["empty"] >= most_empty) or batches == most_batches:
                return Row(attempted=own["attempted"], done=own["done"], failed=own["failed"], batches=batches, left=sum(sizes.values()) - own["attempted"], error=own["error"])
            try:
                self._batch(attempt, due.where(F.col("batch") == own["next"]), own, sizes[own["next"]])
                batches, conflicts = batches + 1, 0
            except Conflict:  # the answers are stored: only their publishing is done again
                attempt.abandon()
                conflicts += 1
                if conflicts > CONFLICTS:
                    raise
            except BaseException:
                attempt.abandon()
                raise

    def _batch(self, attempt: Attempt, part: DataFrame, own: dict, size: int) -> None:
        failed, message = False, own["error"]
        try:
            answers = self._once(f"answers/{own['next']}", lambda: self.task.answers(part.repartition(SPREAD, "id")))
        except Exception as error:  # a source that fails costs this batch only
            failed, message = True, f"{type(error).__name__}: {error}"[:500]
        changes, got = ({}, part.select("id").limit(0)) if failed else self.task.changes(attempt, answers)
        state = F.lit("failed") if failed else F.when(F.col("__got"), F.lit("done")).otherwise(F.lit("none"))
        rows = part.select("id").join(got.distinct().withColumn("__got", F.lit(True)), "id", "left")
        key = F.concat(F.lit(f"{self.task.name}:"), F.col("id").cast("string"))
        rows = rows.select(key.alias("key"), F.lit(self.task.name).alias("task"), F.col("id").alias("paper_id"), F.lit(self.key).alias("run"), F.lit(own["next"]).alias("batch"), state.alias("state"))
        before = attempt.read("attempt", attempt.buckets_of(rows.select("key"))).select("key", F.col("attempts").alias("__n"))
        ledger = attempt.keep(rows.join(before, "key", "left").withColumn("attempts", F.coalesce(F.col("__n"), F.lit(0)) + 1).drop("__n"), "attempt")
        done = 0 if failed else got.count()
        after = {"next": own["next"] + 1, "attempted": own["attempted"] + size, "done": own["done"] + done, "empty": 0 if done else own["empty"] + 1, "failed": own["failed"] + (size if failed else 0), "error": message}
        attempt.publish(changes | {"attempt": ledger}, {"backfill": attempt.facts.get("backfill", {}) | {self.key: after}})


def gaps(papers: DataFrame) -> DataFrame:
    """What a dry run shows: one row an ``abstract_source`` of papers with an abstract (null: their upstream record), and one
    each for papers without, named ``missing`` and ``recoverable`` (they have a doi)."""
    has = papers.where("abstract is not null").groupBy("abstract_source").agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("kind"), "abstract_source", "n")
    none = papers.where("abstract is null").agg(F.count(F.lit(1)).alias("m"), F.count("doi").alias("r"))
    row = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("abstract_source"), F.col(n).alias("n"))
    both = none.select(F.inline(F.array(row("missing", "m"), row("recoverable", "r"))))
    return has.unionByName(both)
