"""Packing documents into training sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one rest of 1 to ``length`` - 1 ids. The rests'
histogram over at most ``CLASSES`` length classes (rounded up) is a cutting-stock problem: a linear
program over patterns (how many rests of each class share a sequence), whose columns a knapsack
dynamic program prices from the dual values. The rounded solution is laid over the rests ranked
inside their class: every rank maps to a pattern, a sequence and a place by arithmetic.

What the driver sees is the histogram (at most CLASSES rows) and the patterns (at most a few per
class); rests are ranked without collecting a class in one task.

Cases: null text is an empty text (only the end id). Null doc_ids and rows that repeat a doc_id are
packed like any others. A text of any length is cut into full sequences and one rest. Other columns
of any name are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gapless, id_and_text, materialize
from .tokens import encoded

LENGTH = 2048
CLASSES = 256


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes 1..len(values) within ``capacity``: (value, how often each size)."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    sizes = np.arange(1, len(values) + 1)
    for room in range(1, capacity + 1):
        fit = sizes[: min(room, len(sizes))]
        gain = values[fit - 1] + best[room - fit]
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], took[room] = gain[k], fit[k]
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(values), np.int64), capacity
    while room:
        if took[room]:
            counts[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchanges, without a threaded library."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def _first_basis(sizes: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """One pattern per class that together cover ``need``: fractional first-fit decreasing.

    Each pattern is used until it exhausts a class that no later one has, so the patterns are triangular.
    """
    left, n = need.copy(), len(sizes)
    basis = np.zeros((n, n))
    for k in range(n):
        room = capacity
        for j in range(n - 1, -1, -1):
            if left[j] > 0 and room >= sizes[j]:
                basis[j, k] = room // sizes[j]
                room -= basis[j, k] * sizes[j]
        used = np.flatnonzero(basis[:, k])
        if not len(used):
            break
        ratio = left[used] / basis[used, k]
        closed = used[int(ratio.argmin())]
        left[used] -= ratio.min() * basis[used, k]
        left[closed] = -1
        left[(left != -1) & (left < 1e-9)] = 1e-9
    return basis


def patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many pieces of each class 1..len(demand)) and how often each is used, covering ``demand``.

    Column generation with a revised simplex: the basis starts from first-fit decreasing; each
    round prices a new pattern by knapsack and exchanges it for the blocking one. It ends at the
    optimum, or where Farley's bound (the sum over the best price) shows that no pattern lowers the
    sum by a whole sequence. Demands are shifted by different tiny shares, so that no round leaves
    the sum as it is and none comes back. The fractional solution is rounded down; what it leaves
    open is packed first-fit by decreasing size.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    need = demand[classes] + 1e-4 * (1 + np.arange(len(classes))) / len(classes)
    basis = _first_basis(classes + 1, need, capacity)
    inverse = _inverse(basis)
    use = np.maximum((inverse * need).sum(axis=1), 0)
    for k in count():
        dual = inverse.sum(axis=0)
        values = np.zeros(len(demand))
        values[classes] = np.maximum(dual, 0)
        value, counts = knapsack(values, capacity)
        if value <= 1 + 1e-7 or np.ceil(use.sum() / value - 1e-6) >= np.ceil(use.sum() - 1e-6):
            break
        column = counts[classes].astype(float)
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        basis[:, out] = column
        inverse[out] /= step[out]
        others = np.arange(len(classes)) != out
        inverse[others] -= step[others, None] * inverse[out]
        if k % 256 == 255:
            inverse = _inverse(basis)
            use = np.maximum((inverse * need).sum(axis=1), 0)
    made: list[tuple[np.ndarray, int]] = []
    left = demand[classes].astype(np.int64)
    for k, times in enumerate(np.floor(use + 1e-9).astype(np.int64)):
        column = basis[:, k].astype(np.int64)
        if times > 0 and (column > 0).any():
            times = min(int(times), int((left[column > 0] // column[column > 0]).min()))
            if times > 0:
                left = left - times * column
                made.append((column, times))
    while left.any():  # each round closes a class or fills a sequence: no more rounds than classes and patterns
        column, room = np.zeros(len(classes), np.int64), capacity
        for j in range(len(classes) - 1, -1, -1):
            column[j] = min(left[j], room // (classes[j] + 1))
            room -= column[j] * (classes[j] + 1)
        times = int((left[column > 0] // column[column > 0]).min())
        left = left - times * column
        made.append((column, times))
    full = []
    for column, times in made:
        counts = np.zeros(len(demand), np.int64)
        counts[classes] = column
        full.append((counts, times))
    return full


def layout(chosen: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, int]:
    """Rows (class, first rank, first sequence, pieces of the class in a sequence) sorted by class and rank; sequences in all."""
    rows, first = [], 0
    ranks: dict[int, int] = {}
    for counts, times in chosen:
        for c in np.flatnonzero(counts):
            rows.append((c, ranks.get(c, 0), first, counts[c]))
            ranks[c] = ranks.get(c, 0) + int(counts[c]) * times
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4), first


def pieces(docs: DataFrame, path: str, end: int, length: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; ``uid`` tells pieces apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch, ids, bounds in encoded(batches, path, end):
            n = np.diff(bounds)
            each = -(-n // length)
            row = np.repeat(np.arange(len(n)), each)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * length
            size = np.minimum(length, n[row] - start)
            raw, at = memoryview(ids.tobytes()), (bounds[row] + start) * 4
            crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(at.tolist(), (size * 4).tolist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(row)), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n[row], pa.int64()), "uid": pa.array(uid + np.arange(len(row)), pa.int64())})
            uid += len(row)

    return id_and_text(docs).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, uid long")


def pack(docs: DataFrame, path: str, end: int = 1, length: int = LENGTH) -> DataFrame:
    """One row per piece with its sequence_id and offset; sequences hold at most ``length`` ids."""
    cut = materialize(pieces(docs, path, end, length), "pieces")
    size = F.col("length")
    # class 0 holds full pieces, class c rests of up to c * grain ids, and a sequence has room for length // grain
    # grains; longer rests than that, short of the length by less than a grain, fill a sequence each like full pieces
    grain = -(-length // CLASSES)
    top = length // grain
    cut = cut.withColumn("class", F.when((size == length) | (F.ceil(size / grain) > top), 0).otherwise(F.ceil(size / grain)).cast("int"))
    counts = np.zeros(top + 1, np.int64)
    for c, n in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect():  # at most top + 1 rows
        counts[c] = n
    table, packed = layout(patterns(counts[1:], length // grain))
    ranked = gapless(cut, "class", "uid", "rank", counts.tolist())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.searchsorted(table[:, 0], np.arange(top + 1))
        for batch in batches:
            group, rank = np.array(batch.column("class")), np.array(batch.column("rank"))
            sequence, slot = packed + rank, np.zeros(len(rank), np.int64)
            for c in np.unique(group):
                if c:
                    own = table[bounds[c - 1] : bounds[c]]
                    mine = group == c
                    entry = own[np.searchsorted(own[:, 1], rank[mine], side="right") - 1]
                    inside = rank[mine] - entry[:, 1]
                    sequence[mine] = entry[:, 2] + inside // entry[:, 3]
                    slot[mine] = c * length + inside % entry[:, 3]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(sequence, pa.int64()), pa.array(slot, pa.int64())], [*names, "sequence_id", "slot"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.select(*names, "class", "rank").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    # a sequence has at most ``length`` pieces
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
