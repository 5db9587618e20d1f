"""Centroid clustering in integers, with partial-distance search.

Vectors become integers once and are stored. Every round assigns all vectors and replaces the centroids by
exact floors of means. A vector's squared differences to the centroids are summed block by block over
the dimensions, those of high variance over all vectors first. The centroid that leads after the first
block is finished first; from then on a centroid is abandoned as soon as its partial sum is strictly above
the best full distance so far. Survivors finish all dimensions, so distances are exact and ties go to
the smaller number.

A round is one pass without a shuffle of vectors: each task sends a count and a sum for each centroid.
What the driver sees is bounded by centroids times dimensions, whatever the number of vectors.

Cases: vectors that are null, have another number of components, or a component that is null, NaN or
infinite are left out. Rows that repeat a vec_id are kept, each for itself; of equal hashes the smaller
vector comes first. A null vec_id hashes like an empty id. With fewer vectors than centroids every vector starts
one. A component whose integer is beyond 2 to the 26 raises an error, since its distances don't fit a long.
Other columns of any name are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

DIM, CENTROIDS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, 2
#: Greatest integer of a component, dimensions summed between two looks at the best distance, and vectors handled at a time.
REACH, BLOCK, AT_ONCE = 1 << 26, 8, 4096


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v: array of int): the vectors with exactly ``dim`` finite components, each as floor(scale * x)."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select("vec_id", doubles.alias("d")).where((F.size("d") == dim) & sound)
    small = lambda x: F.when(F.abs(x) <= REACH, x.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for integer distances")).cast("int"))
    return kept.select("vec_id", F.transform("d", lambda x: small(F.floor(x * scale))).alias("v"))


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every vector; dimensions are taken in ``order``."""
    rows, (k, dim) = len(vectors), centroids.shape
    points, means = vectors[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    head = points[:, :BLOCK]
    partial = ((head * head).sum(axis=1)[:, None] - 2 * head @ means[:, :BLOCK].T) + (means[:, :BLOCK] ** 2).sum(axis=1)
    # the leader of the first block is finished at once: its distance is what others are held against
    leader = partial.argmin(axis=1)
    rest = points[:, BLOCK:] - means[leader, BLOCK:]
    best = partial[np.arange(rows), leader] + (rest * rest).sum(axis=1)
    row, candidate = np.nonzero(partial <= best[:, None])
    total = partial[row, candidate]
    for begin in range(BLOCK, dim, BLOCK):
        step = points[row, begin : begin + BLOCK] - means[candidate, begin : begin + BLOCK]
        total = total + (step * step).sum(axis=1)
        alive = total <= best[row]
        row, candidate, total = row[alive], candidate[alive], total[alive]
    # of the survivors the least distance, then the least number; ``row`` ascends
    first = np.lexsort((candidate, total, row))
    first = first[np.r_[True, np.diff(row[first]) > 0]] if len(first) else first
    return candidate[first], total[first]


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(stored: DataFrame, dim: int, group: str, made) -> DataFrame:
    """(group, n, s0, s1, ...) of what ``made(matrix)`` gives: for the vectors of a batch their groups and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                of, terms = made(_matrix(batch.slice(k, AT_ONCE), dim))
                for g in np.unique(of).tolist():
                    own = found.setdefault(g, [0, np.zeros(terms.shape[1], terms.dtype)])
                    own[0] += int((of == g).sum())
                    own[1] = own[1] + terms[of == g].sum(axis=0)
        for g, (n, s) in found.items():
            yield pa.record_batch({group: pa.array([g], pa.int32()), "n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.float64() if s.dtype.kind == "f" else pa.int64()))})

    kind = "double" if group == "all" else "long"
    partial = stored.select("v").mapInArrow(run, f"{group} int, n long, s array<{kind}>")
    return partial.groupBy(group).agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(dim if group != "all" else 2 * dim)))


def by_variance(stored: DataFrame, dim: int = DIM) -> np.ndarray:
    """Dimensions of the stored vectors, those of greatest variance first."""

    def moments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = v.astype(np.float64)
        return np.zeros(len(v), np.int64), np.concatenate([x, x * x], axis=1)

    one = _sums(stored, dim, "all", moments).head()  # one row
    if one is None:
        return np.arange(dim)
    s = np.array([one[f"s{i}"] for i in range(2 * dim)]) / one["n"]
    return np.argsort(s[:dim] ** 2 - s[dim:], kind="stable")


def seeds(stored: DataFrame, count: int = CENTROIDS, salt: int = SALT) -> np.ndarray:
    """The vectors with the smallest sha256 of ``salt:vec_id``, in the order of these hashes."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = stored.select(key.alias("h"), "v").orderBy("h", "v").limit(count).collect()  # at most ``count`` rows
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector, stored; the final centroids)."""
    bound_batches(vectors.sparkSession)
    stored = materialize(integers(vectors, dim), "integers")
    centroids, order = seeds(stored, count), by_variance(stored, dim)
    for _ in range(rounds if len(centroids) else 0):

        def assigned(v: np.ndarray, now=centroids) -> tuple[np.ndarray, np.ndarray]:
            return nearest(v, now, order)[0], v.astype(np.int64)

        now = centroids.copy()
        for r in _sums(stored, dim, "cluster", assigned).collect():  # at most ``count`` rows
            now[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
        centroids = now

    kind = stored.schema["vec_id"].dataType.simpleString()
    last = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                of, distance = nearest(_matrix(part, dim), last, order)
                yield pa.record_batch({"vec_id": part.column("vec_id"), "cluster": pa.array(of, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return materialize(stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters"), centroids


def op11(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    assigned, centroids = cluster(vectors)
    spark = vectors.sparkSession
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    whole = sum(inertia.values())
    rows = [(k, inertia.get(k, 0), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def _oracle(count: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: int = SALT) -> str:
    """The same as DuckDB SQL, a CTE for each round."""
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{salt}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept) ORDER BY h, v LIMIT {count})",
    ]
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT u, min(struct_pack(d := list_sum(list_transform(list_zip(kept.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := m.c)) AS b FROM kept, c{k} m GROUP BY u)")
        if k < rounds:
            ctes += [
                f"s{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(v) AS x, unnest(range({dim})) AS i FROM a{k} JOIN kept USING (u)) GROUP BY c, i)",
                f"f{k} AS (SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY c)",
                f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(f.v, o.v) AS v FROM c{k} o LEFT JOIN f{k} f USING (c))",
            ]
    return (
        "WITH " + ", ".join(ctes) + f" SELECT vec_id, b.c::INTEGER AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN kept USING (u) JOIN c{rounds} m ON m.c = b.c"
    )


ORACLE = _oracle()
