"""Byte-level BPE by ranks: encoding and decoding whole texts.

Each match of the split pattern is merged by itself. A segment tree over its byte positions keeps,
at every node, the smallest (rank of the pair that begins here, position), so the root is the
leftmost pair of minimum rank. A merge writes three leaves (the pair that grew, its left neighbour's
pair and the swallowed one) and their paths to the root: a logarithmic number of node updates.
Words up to ``WIDE`` bytes run the same tree in step, one numpy lane per word; longer ones alone.
A worker keeps its tables, and the ids of at most ``2 * KEEP`` words of up to WIDE characters.

Cases: null text is an empty text, with no ids. Special-token strings are ordinary text. Very long
texts and words are encoded whole. Rows that repeat a doc_id, or have none, keep a row each. Other
columns of any name are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .tokens import small

WIDE, KEEP = 64, 400_000
FREE = np.int64(1) << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to put a token together from two tokens
        self.pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(self.pairs.values()), np.int64)[order]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], FREE)

    def merge_one(self, word: bytes) -> list[int]:
        n = len(word)
        token = self.base[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wide = 1 << max(n - 1, 1).bit_length()
        none = (int(FREE), 0)
        tree = [none] * (2 * wide)
        pairs = self.pairs
        for k in range(n - 1):
            rank = pairs.get((token[k], token[k + 1]))
            tree[wide + k] = none if rank is None else (rank, k)
        for node in range(wide - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(k: int, value: tuple[int, int]) -> None:
            node = wide + k
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1][0] < FREE:
            rank, k = tree[1]
            gone = after[k]
            token[k], token[gone] = rank, -1
            right = after[k] = after[gone]
            put(gone, none)
            if right < n:
                before[right] = k
                rank = pairs.get((token[k], token[right]))
                put(k, none if rank is None else (rank, k))
            else:
                put(k, none)
            if (left := before[k]) >= 0:
                rank = pairs.get((token[left], token[k]))
                put(left, none if rank is None else (rank, left))
        return [t for t in token if t >= 0]

    def merge_many(self, words: list[bytes], wide: int) -> list[bytes]:
        """Packed ids of words of at most ``wide`` bytes, a power of two; all trees advance in step."""
        lanes = len(words)
        size = np.fromiter(map(len, words), np.int64, lanes)
        padded = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(lanes, wide)
        place = np.arange(wide)
        token = np.where(place < size[:, None], self.base[padded], -1)
        after, before = np.tile(place + 1, (lanes, 1)), np.tile(place - 1, (lanes, 1))
        tree = np.full((lanes, 2 * wide), FREE)
        live = place[1:] < size[:, None]
        rank = self._rank(np.where(live, token[:, :-1], 0), np.where(live, token[:, 1:], 0))
        tree[:, wide : 2 * wide - 1] = np.where(live & (rank < FREE), rank * wide + place[:-1], FREE)
        level = wide
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(row: np.ndarray, k: np.ndarray, value: np.ndarray) -> None:
            node = k + wide
            tree[row, node] = value
            for _ in range(wide.bit_length() - 1):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] < FREE)
        while len(row):
            root = tree[row, 1]
            k = root & (wide - 1)
            gone = after[row, k]
            token[row, k] = root // wide
            token[row, gone] = -1
            right = after[row, gone]
            after[row, k] = right
            put(row, gone, FREE)
            inside = right < size[row]
            before[row[inside], right[inside]] = k[inside]
            for at, to, there in ((k, right, inside), (before[row, k], k, before[row, k] >= 0)):
                r, a, b = row[there], at[there], to[there]
                rank = self._rank(token[r, a], token[r, b])
                put(r, a, np.where(rank < FREE, rank * wide + a, FREE))
            put(row[~inside], k[~inside], FREE)
            row = row[tree[row, 1] < FREE]
        kept = token >= 0
        raw, ends = token[kept].astype("<u4").tobytes(), (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, words: list[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((word, raw))
        for wide, members in groups.items():
            if wide <= WIDE:
                for k in range(0, len(members), 20_000):
                    some = members[k : k + 20_000]
                    self.known.update(zip((w for w, _ in some), self.merge_many([r for _, r in some], wide), strict=True))
            else:
                self.known.update((w, np.array(self.merge_one(r), "<u4").tobytes()) for w, r in members)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        found = [self.pattern.findall(text) for text in texts]
        if len(self.known) > KEEP:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = {w for w in set(chain.from_iterable(found)) if w not in known}
        again = [w for w in new if w in older]
        known.update((w, older[w]) for w in again)
        self._learn(list(new.difference(again)))
        out = [b"".join(map(known.__getitem__, words)) for words in found]
        for w in new:
            if len(w) > WIDE:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def encoder(path: str, pattern: str) -> ByteBPE:
    """One per worker process, so that its tables are made once."""
    return ByteBPE(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (packed) and decoded (bytes) of each text; with ``digests`` their SHA-256 instead."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for whole in batches:
            for batch in small(whole):
                ids = bpe.encode([x or "" for x in batch.column("text").to_pylist()])
                decoded = [bpe.decode(x) for x in ids]
                n = pa.array([len(x) >> 2 for x in ids], pa.int64())
                if digests:
                    both = [pa.array([hashlib.sha256(x).hexdigest() for x in column]) for column in (ids, decoded)]
                else:
                    both = [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *both], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = [kind, "long", *(["string"] * 2 if digests else ["binary"] * 2)]
    return id_and_text(docs).mapInArrow(run, ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids: packed)."""
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(map(bytes_of.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {kind}, text string")
