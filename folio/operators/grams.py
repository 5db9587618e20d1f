"""A stored substring index: postings of runs of three characters, for case-insensitive matches anywhere in a text.

Every position of a lower-cased field begins a run, stored as one number of its three code points (two end marks
make the last ones whole). So a term of three characters or more needs the papers that have all its runs, and a
shorter one those with a run in the range of numbers that begin with it. Only the rarest runs of a term are read; a term whose rarest run most papers have is left to the exact match.
What the postings leave over is matched exactly, so a search equals a scan, also for % and _.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index, tasks that each is dealt over, runs of a term that are read at most, and the share of papers from which a run doesn't help.
FOLDERS, SPREAD, RUNS, COMMON = 16, 4, 3, 0.5
WIDTH, BITS = 3, 21  # a code point has at most 21 bits
FIELDS = ("title", "abstract")
#: Characters of text whose postings one task sorts.
CHARS = 4 << 20
#: ``head`` marks one posting of each run of a paper.
POSTING = "gram long, field int, id long, head boolean, folder int"


def runs_of(text: str, ends: int = 2) -> np.ndarray:
    """The distinct runs of a text, as numbers; ``ends``: end marks after it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.concatenate([points, np.zeros(ends, np.int64)])
    return np.unique(points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]) if len(points) >= WIDTH else np.zeros(0, np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            own, heads, sizes = [], [], []
            for texts in zip(*(part.column(f).to_pylist() for f in FIELDS), strict=True):
                runs = [runs_of(x or "") for x in texts]
                own += runs
                sizes += map(len, runs)
                heads += [~np.isin(x, np.concatenate([x[:0], *runs[:f]]), assume_unique=True) if f else np.ones(len(x), bool) for f, x in enumerate(runs)]
            at = np.repeat(np.arange(len(own)), sizes)
            row, field = np.divmod(at, len(FIELDS))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(field.astype(np.int32)), part.column("id").take(pa.array(row)), pa.array(np.concatenate(heads))], ["gram", "field", "id", "head"])


def _folder(gram: Column | int, folders: int) -> Column | int:
    """Folder of a run: neighbours of any kind are dealt apart."""
    return gram % 1_000_003 % folders


def build(papers: DataFrame, path: str, folders: int = FOLDERS, spread: int = SPREAD) -> GramIndex:
    """Index titles and abstracts of ``papers`` (unique ids) in the new folder ``path``, which driver and executors share.

    Each folder is dealt over ``spread`` tasks, or as many as let a task sort the postings of about CHARS characters.
    """
    spark = papers.sparkSession
    chars = papers.agg(F.coalesce(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in FIELDS), F.lit(0).cast("long"))), F.lit(0))).head()[0]
    spread = max(spread, -(-chars // (folders * CHARS)))
    rows = papers.select(F.col("id").cast("long").alias("id"), *(F.lower(f).alias(f) for f in FIELDS)).mapInArrow(_runs, "gram long, field int, id long, head boolean")
    # a run that most papers have is dealt over several tasks by the papers' ids
    dealt = rows.withColumn("folder", _folder(F.col("gram"), folders).cast("int"))
    dealt = dealt.repartitionById(folders * spread, (F.col("folder") * spread + F.pmod(F.xxhash64("id"), F.lit(spread))).cast("int"))
    dealt.sortWithinPartitions("folder", "gram", "field", "id").write.partitionBy("folder").option("parquet.block.size", str(4 << 20)).parquet(f"{path}/grams")
    stored = spark.read.schema(POSTING).parquet(f"{path}/grams")
    stored.where("head").groupBy("gram").agg(F.count(F.lit(1)).alias("papers")).repartitionByRange(folders, "gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    papers.agg(F.count(F.lit(1)).alias("papers")).withColumn("folders", F.lit(folders)).write.parquet(f"{path}/stats")
    return GramIndex(spark, path)


class GramIndex:
    """A finished index below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.postings = spark.read.schema(POSTING).parquet(f"{path}/grams")
        self.counts = spark.read.schema("gram long, papers long").parquet(f"{path}/counts")
        one = spark.read.schema("papers long, folders int").parquet(f"{path}/stats").head()
        if not one:
            raise ValueError(f"{path} holds no finished index")
        self.papers, self.folders = one["papers"], one["folders"]

    def chosen(self, terms: list[str]) -> dict[str, list[int]]:
        """The runs to read for each lower-cased term, rarest first; none for a term that they don't help."""
        own = {t: runs_of(t, 0).tolist() for t in terms}
        every = sorted({g for x in own.values() for g in x})
        found = {r["gram"]: r["papers"] for r in self.counts.where(F.col("gram").isin(every)).collect()} if every else {}
        return {t: sorted(x, key=lambda g: (found.get(g, 0), g))[:RUNS] if x and min(found.get(g, 0) for g in x) <= COMMON * self.papers else [] for t, x in own.items()}

    def read(self, grams: list[int]) -> DataFrame:
        folders = sorted({_folder(g, self.folders) for g in grams})
        return self.postings.where(F.col("folder").isin(folders) & F.col("gram").isin(grams))

    def beginning(self, term: str) -> Column:
        """Whether a run begins with a term of one or two characters."""
        low, left = 0, WIDTH - len(term)
        for c in term:
            low = low << BITS | ord(c)
        return F.col("gram").between(low << BITS * left, (low + 1 << BITS * left) - 1)

    def candidates(self, q: str) -> DataFrame | None:
        """(id) of the papers that may hold every term of ``q`` in a field; None if the postings don't help."""
        terms = list(dict.fromkeys(q.split()))
        lower = list(self.spark.range(1).select(*(F.lower(F.lit(t)) for t in terms)).head()) if terms else []
        parts = []
        for term, grams in self.chosen(lower).items():
            if grams:
                parts.append(self.read(grams).groupBy("id", "field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("id").distinct())
            elif len(term) < WIDTH and (self.counts.where(self.beginning(term)).agg(F.sum("papers")).head()[0] or 0) <= COMMON * self.papers:
                parts.append(self.postings.where(self.beginning(term)).select("id").distinct())
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), parts) if parts else None
