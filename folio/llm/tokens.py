"""Whole texts to ids by a public word-piece vocabulary, through the tokenizers library.

The tokenizer drops white space and never looks across it, so the ids of a text are those of its
pieces between spaces and newlines, one after the other. A piece of Latin-1 letters, with at most one
ASCII sign after it, is looked up as its letters in lower case and the sign; any other piece as it
stands. Arrow finds a batch's distinct keys and looks them up in a store of keys met before, which
holds at most ``KEEP`` keys and ``2 * LONGEST * KEEP`` bytes, whatever the data's size and however
long its pieces are. Forgetting a key costs time and changes no result.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP, LONGEST, AT_ONCE = 350_000, 64, 4096
#: Letters that lower-casing one by one brings into final form, and the ASCII signs.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Byte-level form of bytes that are no visible Latin-1 character: the n-th of them is character 256 + n.
HIDDEN = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}


def byte_level(part: str) -> str:
    return part if part.isascii() else part.encode().decode("latin-1").translate(HIDDEN)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def spans(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(every position of the spans ``begins[k] .. begins[k] + sizes[k]``, one after the other; where each span's positions end)."""
    ends = np.cumsum(sizes)
    at = np.repeat(begins - (ends - sizes), sizes)
    at += np.arange(len(at), dtype=at.dtype)
    return at, ends


class Store:
    """Ids of the keys met lately, in flat arrays: key k has ``ids[begins[k] : begins[k] + sizes[k]]``."""

    def __init__(self, unit: np.dtype):
        self.keys = pa.array([], pa.string())
        self.ids, self.begins, self.sizes = np.zeros(0, unit), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.keys) + len(keys) > KEEP:
            self._forget()
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.keys = pa.concat_arrays([self.keys, keys])
        self.met = np.concatenate([self.met, np.zeros(len(keys), bool)])

    def _forget(self) -> None:
        """Keep the keys that were met again since the last time, at most the newest half of all."""
        kept = np.flatnonzero(self.met)[-KEEP // 2 :]
        at, ends = spans(self.begins[kept], self.sizes[kept])
        self.keys = self.keys.take(pa.array(kept))
        self.ids, self.sizes = self.ids[at], self.sizes[kept]
        self.begins = ends - self.sizes
        self.met = np.zeros(len(kept), bool)


class WordEncoder:
    """``ids(texts)`` gives each text's ids; ``path`` names a tokenizers JSON file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # of the same model, for what is one word or one sign in its final form
        self.plain = Tokenizer(self.tokenizer.model)
        self.unit = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.store = Store(self.unit)
        signs, sizes = self._encoded(self.tokenizer, list(SIGNS))
        # a sign that is not one id of its own is left to its piece
        self.sign = np.full(128, -1, np.int64)
        single = np.array([ord(c) for c in SIGNS])[sizes == 1]
        self.sign[single] = signs[np.repeat(sizes == 1, sizes)]

    def _encoded(self, tokenizer, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, one after the other; how many each part has)."""
        made, sizes = [np.zeros(0, self.unit)], [np.zeros(0, np.int64)]
        for k in range(0, len(parts), AT_ONCE):  # the library's results take far more room than their ids
            ids = [e.ids for e in tokenizer.encode_batch_fast(parts[k : k + AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            made.append(np.fromiter(chain.from_iterable(ids), self.unit, int(sizes[-1].sum())))
        return np.concatenate(made), np.concatenate(sizes)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each text's ids begin, and the end of the last)."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        found, sizes = self._of_pieces(pieces.dictionary)
        which = pieces.indices.to_numpy(zero_copy_only=False)
        at, ends = spans((np.cumsum(sizes) - sizes)[which], sizes[which])
        offsets = lists.offsets.to_numpy()
        return found[at], np.concatenate([[0], ends])[offsets - offsets[0]]

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces, one after the other; how many each has)."""
        bare = pc.utf8_rtrim(pieces, SIGNS)
        tail = pc.subtract(pc.binary_length(pieces), pc.binary_length(bare)).to_numpy(zero_copy_only=False)
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset + 1 : pieces.offset + 1 + len(pieces)]
        data = np.frombuffer(pieces.buffers()[2], np.uint8) if pieces.buffers()[2] else np.zeros(0, np.uint8)
        sign = np.full(len(pieces), -1, np.int64)
        sign[tail == 1] = self.sign[data[ends[tail == 1] - 1]]
        word = (tail == 0) | (sign >= 0)
        word &= pc.match_substring_regex(bare, LETTERS).to_numpy(zero_copy_only=False)
        sign[~word] = -1
        keys = pc.if_else(pa.array(word), pc.utf8_lower(bare), pieces).dictionary_encode()
        is_word = np.zeros(len(keys.dictionary), bool)
        which = keys.indices.to_numpy(zero_copy_only=False)
        is_word[which] = word
        ids, begins, sizes = self._of_keys(keys.dictionary, is_word)
        own, signed = sizes[which], sign >= 0
        at, ends = spans(begins[which], own)
        out = np.insert(ids[at], ends[signed], sign[signed].astype(self.unit)) if signed.any() else ids[at]
        return out, own + signed

    def _of_keys(self, keys: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each key begin, how many each has)."""
        at = pc.index_in(keys, value_set=self.store.keys)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        rows = at.drop_null().to_numpy(zero_copy_only=False)
        self.store.met[rows] = True
        ids, begins, sizes = [self.store.ids], np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begins[known], sizes[known] = self.store.begins[rows], self.store.sizes[rows]
        used = len(self.store.ids)
        for chosen, tokenizer in ((~known & is_word, self.plain), (~known & ~is_word, self.tokenizer)):
            new = keys.filter(pa.array(chosen))
            parts = new.to_pylist()
            made, n = self._encoded(tokenizer, list(map(byte_level, parts)) if tokenizer is self.plain else parts)
            begins[chosen], sizes[chosen] = used + np.cumsum(n) - n, n
            ids.append(made)
            used += len(made)
            short = pc.less_equal(pc.binary_length(new), LONGEST)
            kept = short.to_numpy(zero_copy_only=False)
            self.store.add(new.filter(short), made[np.repeat(kept, n)], n[kept])
        return np.concatenate(ids), begins, sizes


def small(batch: pa.RecordBatch, column: str = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, whatever the length of its rows."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(sizes):
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + limit)))
        yield batch.slice(begin, end - begin)
        begin = end


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """One per worker process, so that later tasks profit from what earlier ones met."""
    return WordEncoder(path)


def release() -> None:
    """Free what earlier tasks of other operators left in this worker process."""
    encoder_of.cache_clear()


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For slices of Arrow batches with a column text: (slice, ids with ``end`` after each text, each text's bounds)."""
    encoder = encoder_of(path)
    for whole in batches:
        for batch in small(whole):
            ids, bounds = encoder.ids(batch.column("text"))
            yield batch, np.insert(ids, bounds[1:], end).astype("<u4"), bounds + np.arange(len(bounds))
