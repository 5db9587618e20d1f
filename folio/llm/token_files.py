"""Token-id files: canonical length-limited Huffman codes over global id counts.

Layout of a folder: ``codes`` (id, bits: length of the id's code) and ``blocks``, one row per
independent block: ``part`` and ``start`` (ids of the part before the block), ``doc_ids`` and
``lengths`` (ids of each whole document in it, in ascending doc_id order), ``payload`` (the codes,
highest bit first) and ``checkpoints`` (bit offset of every STEP-th id). Codes are canonical:
ordered by (length, id), so lengths alone give them.

Cases: null text is an empty text (only the end id). Null doc_ids sort first. Rows that repeat a
doc_id are kept, ordered by text. A very long text is one block, whose codes may take up to 2 to the 31 bits
(some 150 million ids); beyond that writing fails. Other columns of any name are not read. An empty table gives an empty folder and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialize, shared_dir
from .tokens import encoded, encoder_of

#: Bits of the longest code where the ids allow it; four byte lanes hold codes of up to WIDEST bits.
MAX_BITS, WIDEST = 18, 25
BLOCK = 1 << 16
STEP = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths for positive counts by package-merge; at most ``limit`` bits, or as many as tell all ids apart."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    limit = max(limit, (n - 1).bit_length())
    assert limit <= WIDEST, "a vocabulary of more than 33 million ids"
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.float64)[order]
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, need = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:need].sum())
        lengths[:leaves] += 1
        need = 2 * (need - leaves)
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes of ``ids`` with code lengths ``bits``: arrays to encode, a table to decode."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = np.asarray(ids)[order].astype(np.uint32), np.asarray(bits)[order].astype(np.int64)
        self.top = int(self.bits.max(initial=1))
        spans = np.int64(1) << (self.top - self.bits)
        begins = np.cumsum(spans) - spans
        size = int(self.ids.max(initial=0)) + 1
        self.code = np.zeros(size, np.int64)
        self.length = np.zeros(size, np.int64)
        self.code[self.ids] = begins >> (self.top - self.bits)
        self.length[self.ids] = self.bits
        table = np.repeat(self.ids.astype(np.int64) << 8 | self.bits, spans)
        self.table = np.concatenate([table, np.ones((1 << self.top) - len(table), np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every STEP-th id)."""
        length = self.length[ids]
        ends = np.cumsum(length)
        begins = ends - length
        # a code and its shift inside the first byte fit 32 bits: four byte lanes hold it
        word = self.code[ids] << (32 - length - (begins & 7))
        first = begins >> 3
        size = (int(ends[-1]) + 7 >> 3) + 4 if len(ends) else 0
        out = np.zeros(size, np.int64)
        for lane in range(4):
            out += np.bincount(first + lane, weights=word >> (24 - 8 * lane) & 255, minlength=size)[:size].astype(np.int64)
        assert size < 1 << 28, "a document of more than 2 ** 31 bits of codes"
        return out[: size - 4 if size else 0].astype(np.uint8).tobytes(), begins[::STEP].astype(np.int32)

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """Ids of all blocks, one after the other; every stretch between checkpoints advances at once."""
        begins = np.cumsum([0, *map(len, payloads)])
        data = np.frombuffer(b"".join(payloads) + bytes(STEP * self.top // 8 + 8), np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        lanes = np.array([len(c) for c in checkpoints], np.int64)
        at = np.concatenate(checkpoints).astype(np.int64) + np.repeat(begins[:-1] * 8, lanes)
        out = np.empty((STEP, len(at)), np.uint32)
        shift, mask = 32 - self.top, (1 << self.top) - 1
        for k in range(STEP):
            entry = self.table[window[at >> 3].astype(np.int64) >> (shift - (at & 7)) & mask]
            out[k] = entry >> 8
            at += entry & 255
        nth = np.arange(len(at)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        left = np.repeat(counts, lanes) - nth * STEP
        return out.T[np.arange(STEP) < left[:, None]]


def tokenized(docs: DataFrame, path: str, end: int, unit: str) -> DataFrame:
    """(part, start, doc_id, ids: packed in ``unit``) in ascending doc_id order over ascending parts.

    ``start`` counts the ids before a row in its part. It is taken here, where one task has the whole
    part: the stored table's files may be split among tasks at any row group.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch, ids, bounds in encoded(batches, path, end):
            raw, at = ids.astype(unit).tobytes(), (bounds * np.dtype(unit).itemsize).tolist()
            yield pa.record_batch({"part": pa.array([part] * batch.num_rows, pa.int32()), "start": pa.array(before + bounds[:-1], pa.int64()), "doc_id": batch.column("doc_id"), "ids": pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())})
            before += len(ids)

    ordered = id_and_text(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, f"part int, start long, doc_id {kind}, ids binary")


def id_counts(staged: DataFrame, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) over all rows. Each task sends one row per distinct id; the driver gets at most the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                n = np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(k, 2000).to_pylist()), unit))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    rows = staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    return rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def write(docs: DataFrame, folder: str, path: str, end: int = 2) -> None:
    """Encode ``docs`` (doc_id, text) by the tokenizers file ``path``, ``end`` after each text, into ``folder``."""
    spark = docs.sparkSession
    unit = "<u2" if max(encoder_of(path).tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    staged = materialize(tokenized(docs, path, end, unit), "ids")
    ids, counts = id_counts(staged, unit)
    bits = code_lengths(counts)
    shared = spark.sparkContext.broadcast((ids, bits))  # two numbers per id of the vocabulary
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, start, id_type = Codes(*shared.value), None, 0, pa.int64()
        held: list[tuple[pa.Scalar, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            payload, checkpoints = codes.encode(np.concatenate([x for _, x in held]))
            row = {"part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()), "doc_ids": pa.array([[d for d, _ in held]], pa.list_(id_type)), "lengths": pa.array([[len(x) for _, x in held]], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary()), "checkpoints": pa.array([checkpoints.tolist()], pa.list_(pa.int32()))}
            return pa.record_batch(row)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for p, at, doc_id, raw in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                # a task may begin inside a part and go on at any other place
                if held and (p != part or at != start + size or size >= BLOCK):
                    yield block()
                    held, size = [], 0
                if not held:
                    part, start = p, at
                held.append((doc_id, np.frombuffer(raw.as_buffer(), unit)))
                size += len(held[-1][1])
        if held:
            yield block()

    spark.createDataFrame(zip(ids.tolist(), bits.tolist(), strict=True), "id long, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    blocks = staged.mapInArrow(run, f"part int, start long, doc_ids array<{kind}>, lengths array<long>, payload binary, checkpoints array<int>")
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read(spark, folder: str, each=None, schema: str = "ids binary") -> DataFrame:
    """Decode a folder: one row per document with doc_id, start (ids of all documents before it), n_tokens,
    and what ``each(ids)`` gives for it (default: the ids as packed little-endian unsigned 32-bit)."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    codes = spark.read.parquet(f"{folder}/codes").toPandas()
    shared = spark.sparkContext.broadcast((codes["id"].to_numpy(np.int64), codes["bits"].to_numpy(np.int64)))
    each = each or (lambda ids: ids.tobytes())
    name, kind = schema.split()
    id_kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codes(*shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 16):
                batch = whole.slice(k, 16)
                lengths = [np.array(x, np.int64) for x in batch.column("lengths").to_pylist()]
                counts = np.array([x.sum() for x in lengths])
                ids = code.decode([x.as_py() for x in batch.column("payload")], [np.array(x) for x in batch.column("checkpoints").to_pylist()], counts).astype("<u4")
                n = np.concatenate(lengths)
                ends = np.cumsum(n)
                base = np.repeat(np.array(batch.column("start")) - (np.cumsum(counts) - counts), [len(x) for x in lengths])
                made = [each(ids[b - m : b]) for b, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch({"part": pa.array(np.repeat(np.array(batch.column("part")), [len(x) for x in lengths]), pa.int32()), "doc_id": batch.column("doc_ids").flatten(), "start": pa.array(base + ends - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()), name: pa.array(made, pa.binary() if kind == "binary" else pa.int64())})

    documents = blocks.mapInArrow(run, f"part int, doc_id {id_kind}, start long, n_tokens long, {schema}")
    totals = blocks.groupBy("part").agg(F.max(F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row per part: as many as the writer's tasks
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return documents.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", name)


def op5(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` to token files and return doc_id, start, n_tokens, ids_crc32 as read back from them."""
    import uuid

    folder = f"{shared_dir(docs.sparkSession)}/folio-tokens-{uuid.uuid4().hex}"
    write(docs, folder, path)
    return read(docs.sparkSession, folder, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32 long")
