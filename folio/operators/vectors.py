"""A stored vector index: coarse cells, so that a nearest-neighbour search reads only some of the vectors.

Cells are spherical k-means centroids fitted on a bounded sample (``SAMPLE`` vectors, those with the smallest
hashes of their ids); every vector is stored in the folder of its nearest cell. For each cell the index
keeps its number of vectors and the least cosine between its centroid and a member. A search looks into the
cells nearest to the query, as many as hold a share of all vectors that is measured when the index is built: the
least share at which searches among the sample find ``TARGET`` of the nearest vectors. It is small where
vectors have structure; where they have none, no cells can make it so. The cells' k-th best similarity bounds what another cell must offer, and the angle
between query and centroid less the cell's own angle bounds what it can: with ``exact`` every cell that
could still hold a better vector is read too, so that the result is that of a full scan.

The driver holds centroids and one row a cell, whatever the number of vectors. A full cell is dealt over
as many files as its size asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T

#: Part of the nearest vectors that a search should find, searches to measure it with, and how many nearest ones count in each.
TARGET, TRIALS, NEAREST = 0.97, 64, 100
#: Vectors that the cells are fitted on, most cells, vectors that a file of a cell holds at most, and rounds of fitting.
SAMPLE, MOST_CELLS, FILE, ROUNDS = 20_000, 4096, 200_000, 12


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``cells`` unit centroids of the sample's vectors; empty ones are left out."""
    points = _unit(sample)
    means = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(rounds):
        of = (points @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, of, points)
        means = _unit(sums[np.bincount(of, minlength=len(means)) > 0])
    return means


def measured_share(sample: np.ndarray, means: np.ndarray, n: int) -> float:
    """The least share of all vectors, in twentieths and below in hundredths, that finds TARGET of a sample vector's nearest ones."""
    points = _unit(sample)
    k = min(len(points) - 1, max(5, round(NEAREST * len(points) / max(1, n))))
    own = (points @ means.T).argmax(axis=1)
    sizes = np.bincount(own, minlength=len(means))
    shares = [0.01, 0.02, 0.03, *(s / 20 for s in range(1, 21))]
    found = np.zeros(len(shares))
    trials = np.linspace(0, len(points) - 1, min(TRIALS, len(points))).astype(int)
    for t in trials:
        near = points @ points[t]
        near[t] = -2  # itself
        best = np.argpartition(-near, k - 1)[:k]
        place = np.empty(len(means), np.int64)
        order = np.argsort(-(means @ points[t]), kind="stable")
        place[order] = np.arange(len(order))
        read = np.cumsum(sizes[order])
        found += [np.mean(place[own[best]] <= (read >= s * len(points) - 1e-9).argmax()) for s in shares]
    return next((s for s, f in zip(shares, found / len(trials), strict=True) if f >= TARGET), 1.0)


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index ``vectors`` (paper_id, embedding: all of one length) in the new folder ``path``, which driver and executors share."""
    spark = vectors.sparkSession
    own = vectors.where("embedding is not null and exists(embedding, x -> x <> 0)").select(F.col("paper_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = own.count()
    rows = own.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by ``sample``
    means = fitted(np.array([r["embedding"] for r in rows]), min(MOST_CELLS, cells or max(1, round(2 * n**0.5)))) if rows else np.zeros((0, 1))
    dim = means.shape[1]
    share = measured_share(np.array([r["embedding"] for r in rows]), means, n) if len(rows) > 1 else 1.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column("embedding").flatten().to_numpy().reshape(-1, dim))
            near = x @ means.T
            of = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(of, pa.int32()), pa.array(near[np.arange(len(of)), of])], ["id", "embedding", "cell", "near"])

    dealt = own.mapInArrow(place, "id long, embedding array<double>, cell int, near double") if rows else own.select("id", "embedding", F.lit(0).alias("cell"), F.lit(1.0).alias("near"))
    # a cell gets a file for every FILE vectors that an even deal would give it, and a few more
    spread = 1 + 4 * n // (FILE * max(1, len(means)))
    dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema("id long, embedding array<double>, near double, cell int").parquet(f"{path}/vectors")
    facts = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least"))
    centroids = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(means)], "cell int, centroid array<double>")
    # written last: an index without it was never finished
    centroids.join(facts, "cell", "left").select("cell", "centroid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("least", F.lit(1.0)).alias("least"), F.lit(share).alias("share")).coalesce(1).write.parquet(f"{path}/cells")
    return VectorIndex(spark, path)


class VectorIndex:
    """A finished index below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        rows = spark.read.schema("cell int, centroid array<double>, n long, least double, share double").parquet(f"{path}/cells").orderBy("cell").collect()  # a row a cell
        self.centroids = np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 1))
        self.share = rows[0]["share"] if rows else 1.0
        self.sizes, self.least = np.array([r["n"] for r in rows], np.int64), np.array([r["least"] for r in rows])
        self.vectors = spark.read.schema("id long, embedding array<double>, near double, cell int").parquet(f"{path}/vectors").drop("near")

    def _ranked(self, vector: list[float]) -> np.ndarray:
        """Cosine of the query with each centroid."""
        return self.centroids @ _unit(np.array([vector]))[0] if len(self.centroids) else np.zeros(0)

    def bounds(self, vector: list[float]) -> np.ndarray:
        """The greatest cosine that a vector of each cell can have with the query."""
        angle = np.arccos(np.clip(self._ranked(vector), -1, 1)) - np.arccos(np.clip(self.least, -1, 1))
        return np.where(self.sizes > 0, np.cos(np.maximum(angle, 0)), -2.0)

    def first_cells(self, vector: list[float], k: int, share: float, sizes: np.ndarray) -> list[int]:
        """The nearest cells that hold the ``share`` of all vectors, and 4 * k vectors that may be returned, ``sizes`` of each cell."""
        order = np.argsort(-self._ranked(vector), kind="stable")
        enough = (np.cumsum(sizes[order]) >= min(4 * k, sizes.sum())) & (np.cumsum(self.sizes[order]) >= share * self.sizes.sum())
        return order[: int(enough.argmax()) + 1].tolist() if len(order) else []

    def near(self, cells: list[int], vector: list[float], k: int, papers: DataFrame | None, other_than: int | None = None) -> DataFrame:
        some = self.vectors.where(F.col("cell").isin(cells) if cells else F.lit(False))
        some = some.where(F.col("id") != other_than) if other_than is not None else some
        some = some if papers is None else some.join(papers.select("id"), "id", "left_semi")
        sim = F.round(T.cosine(F.col("embedding"), F.array(*map(F.lit, map(float, vector)))), 6)
        return some.select("id", sim.alias("sim")).where("sim is not null").orderBy(F.desc("sim"), "id").limit(k)

    def search(self, vector: list[float], k: int, papers: DataFrame | None = None, share: float | None = None, exact: bool = False, other_than: int | None = None) -> DataFrame:
        """(id, sim) of the ``k`` vectors nearest to ``vector``, of ``papers`` only if given: filters come first.

        Reads the nearest cells, at least a ``share`` of all vectors (by default the measured one); with ``exact`` then all that could hold better ones.
        """
        sizes = self.sizes
        if papers is not None:
            sizes = np.zeros(len(self.sizes), np.int64)
            for r in self.vectors.select("id", "cell").join(papers.select("id"), "id", "left_semi").groupBy("cell").count().collect():  # a row a cell
                sizes[r["cell"]] = r["count"]
        cells = self.first_cells(vector, k, self.share if share is None else share, sizes)
        if not exact:
            return self.near(cells, vector, k, papers, other_than)
        found = self.near(cells, vector, k, papers, other_than).collect()  # at most ``k`` rows
        worst = found[-1]["sim"] if len(found) == k else -1.0
        more = np.flatnonzero((self.bounds(vector) >= worst - 2e-6) & (sizes > 0)).tolist()
        if set(more) <= set(cells):
            return self.spark.createDataFrame(found, "id long, sim double")
        return self.near(sorted({*more, *cells}), vector, k, papers, other_than)

    def vector_of(self, paper_id: int) -> list[float] | None:
        row = self.vectors.where(F.col("id") == paper_id).select("embedding").head()
        return row["embedding"] if row else None
