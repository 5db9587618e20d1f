"""Language-model scores by a probabilistic suffix tree over words.

The tree's nodes are contexts: the last 0, 1, ... ``depth`` tokens. The root's distribution is that of single
tokens with one place for unseen ones. A longer context becomes a node only if it is seen often enough (``least``) and a
divergence test finds that its next-token distribution differs from that of its longest suffix in the
tree: the mean log ratio of both over the context's occurrences, each left out of its own estimate, must reach
``gain``. A node's distribution is its counts plus its suffix's distribution times a pseudo-count that
grows with the context's count; every distribution sums to 1. A text's score is the sum over its tokens of
the log probability in the state that is the longest suffix in the tree of the tokens before.

The driver holds two totals of the corpus and nothing else; nothing is broadcast. Texts are stored in chunks
of documents that one task met in a row, as numbers into the chunk's own list of words. For each depth every
chunk sends its distinct contexts with their next tokens, packed by a cell of the context's hash; a cell
adds up the counts, tests its contexts and answers each chunk in the order in which it asked. So what moves grows
with the distinct runs of words of each chunk, and with the input. A context of more than ``wide`` occurrences is
spread over cells by its next tokens, and its parts' gains are added before the test. The number of cells
grows with the input: a cell gets about ``cell`` runs, and at most one row of each chunk.

Cases: null text counts as empty (one token, the end). A null doc_id hashes like an empty one, which decides
whether it is learnt from. Rows that repeat a doc_id are learnt from and scored one by one. A text of any
length is one document of one chunk. Without training tokens (N = V = 0) every token has probability 1 at the
root. Other columns of any name are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize
from .tokens import small

#: A row is held out if its id's checksum leaves ``HELD_OUT`` by ``FOLDS``.
FOLDS, HELD_OUT = 7, 2
#: The end of a text as a token; no word holds it.
END = "\n"
#: Constants of the SplitMix64 generator.
MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))
#: Bits by which a context's next tokens are told apart: a million of them meet with a chance of 1 in 500.
NEXT = np.uint64((1 << 48) - 1)
ASKED = "cell long, chunk long, wide long, heads int, runs int, contexts binary, fan binary, seen binary, next binary, times binary, prior binary"
ANSWER = "chunk long, depth int, cell long, wide long, counts binary, n long, gain double"


@dataclass(frozen=True)
class Rules:
    """Depth of the tree; for each depth the least occurrences of a tested context (ascending); least mean gain in
    nats a token; bytes of a chunk's texts; runs of a cell; occurrences from which a context is spread."""

    depth: int = 2
    least: tuple[int, ...] = (10, 24)
    gain: float = 0.01
    chunk: int = 8 << 20
    cell: int = 1 << 19
    wide: int = 1 << 22


def pseudo(seen: np.ndarray) -> np.ndarray:
    """Pseudo-count of the suffix's distribution at a context seen so often; it grows like the number of its next words."""
    return np.cbrt(np.asarray(seen, np.float64)) ** 2


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of 64-bit hashes."""
    x = a * MIX[0] + b
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def packed(x: np.ndarray) -> bytes:
    """An array compressed, the bytes of equal weight together."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind: type, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).reshape(-1)


# ---- chunks ----
def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(numbers of all tokens, an end after each text's words; tokens of each text; tokens by number, the end first)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    # white space at the ends of a text leaves empty words
    full = pc.not_equal(pc.binary_length(split.flatten()), 0)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)[full.to_numpy(zero_copy_only=False)]
    coded = split.flatten().filter(full).dictionary_encode()
    sizes = np.bincount(owner, minlength=len(lengths))
    # frequent words get small numbers, which take less room
    number = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(number, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    ids = np.zeros(len(owner) + len(sizes), np.int32)
    ids[np.arange(len(owner)) + owner] = rank[number]
    return ids, sizes + 1, [END, *coded.dictionary.take(pa.array(order)).to_pylist()]


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, doc_ids, trains, sizes, ids, words, tokens, learnt): documents with about ``size`` bytes of text a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def row(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        import xxhash

        whole = pa.Table.from_batches(parts).combine_chunks()
        ids, sizes, words = words_of(whole.column("text").combine_chunks())
        trains = whole.column("trains").to_numpy()
        return pa.record_batch({
            "chunk": pa.array([number], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), whole.column("doc_id").combine_chunks()),
            "trains": pa.array([trains], pa.list_(pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int64())), "ids": pa.array([packed(ids)], pa.binary()),
            "words": pa.array([np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).tobytes()], pa.binary()),
            "tokens": pa.array([len(ids)], pa.int64()), "learnt": pa.array([int(sizes[trains].sum())], pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, bytes_held = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch in small(whole):
                held.append(batch)
                bytes_held += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
                if bytes_held >= size:
                    yield row(number, held)
                    number, held, bytes_held = number + 1, [], 0
        if held:
            yield row(number, held)

    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return id_and_text(docs).withColumn("trains", remainder != HELD_OUT).mapInArrow(run, f"chunk long, doc_ids array<{kind}>, trains array<boolean>, sizes array<long>, ids binary, words binary, tokens long, learnt long")


class Chunk:
    """A chunk's tokens and what the cells said about them: ``p`` of every token, after ``depth`` rounds.

    Contexts and runs are numbered inside the chunk: a context of one token is a word's number, a longer one the
    number of the run (a context and its next token) that it is.
    """

    def __init__(self, row: dict, answers: list[dict], cells: int, totals: tuple[int, int], rules: Rules):
        self.rules, self.cells, self.totals = rules, cells, totals
        self.sizes, self.trains = np.asarray(row["sizes"], np.int64), np.asarray(row["trains"], bool)
        self.ids = unpacked(row["ids"], np.int32, int(self.sizes.sum()))
        self.words = np.frombuffer(row["words"], np.uint64)
        self.learnt = np.repeat(self.trains, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.depth = -1
        said: dict[int, dict[int, dict]] = {}
        for x in answers:
            said.setdefault(x["depth"], {})[x["cell"]] = x
        if 0 in said:
            order, cell = self.root()
            self.known = np.empty(len(order), np.int64)
            self.known[order] = self._read(said[0], cell)
            n, v = totals
            self.p = (self.known[self.ids] + 1) / (n + v + 1)
            # the token before, an end before the first
            self.context = np.roll(self.ids, 1)
            self.context[self.starts] = 0
            self.hashes, self.seen, self.depth = self.words, self.known, 0
        for depth in range(1, max(said, default=0) + 1):
            self._take(said.get(depth, {}))

    def _read(self, answers: dict[int, dict], cell: np.ndarray) -> np.ndarray:
        """The cells' numbers in the order asked: by stretches of equal ``cell``."""
        told = [unpacked(answers[c]["counts"], np.int64, b - a) + answers[c]["node"] for c, a, b in _slices(cell)]
        return np.concatenate([np.zeros(0, np.int64), *told])

    def _cell(self, hashes: np.ndarray) -> np.ndarray:
        """Cell of a hash; it ascends with the hash."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.cells) >> np.uint64(32)).astype(np.int64)

    def root(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the chunk's words in the order in which they are asked for, their cells)."""
        order = np.argsort(self.words)
        return order, self._cell(self.words[order])

    def runs(self) -> dict[str, np.ndarray]:
        """Distinct runs of the next depth whose context is seen often enough, in the order asked: ``context``, ``word``,
        ``cell``, ``wide`` and ``token`` (one of its tokens) of each; ``rows`` and ``of``: tokens and the runs they end."""
        ready = np.flatnonzero(self.seen >= self.rules.least[self.depth])
        wide = self.seen[ready] > self.rules.wide
        sort = lambda some: some[np.argsort(self.hashes[some])]
        cold, spread = sort(ready[~wide]), sort(ready[wide])
        parts = -(-self.seen[spread] // self.rules.wide)
        # places of contexts, and of the parts of wide ones after them
        owner = np.concatenate([cold, np.repeat(spread, parts)]).astype(np.int64)
        base = np.full(len(self.seen) + 1, -1, np.int64)
        base[cold] = np.arange(len(cold))
        base[spread] = len(cold) + np.cumsum(parts) - parts
        cell = self._cell(self.hashes[owner])
        part = np.arange(len(owner) - len(cold)) - (base[owner[len(cold) :]] - len(cold))
        cell[len(cold) :] = -1 - (mixed(self.hashes[owner[len(cold) :]], part.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        place = base[self.context]
        rows = np.flatnonzero(place >= 0)
        place, word = place[rows], self.ids[rows]
        if len(spread):
            split = np.ones(len(base), np.uint64)
            split[spread] = parts
            place = place + (self.words[word] % split[self.context[rows]]).astype(np.int64)
        found, of = np.unique(place * len(self.words) + word, return_inverse=True)
        token = np.empty(len(found), np.int64)
        token[of] = rows
        place, word = np.divmod(found, len(self.words))
        return {"rows": rows, "of": of, "token": token, "context": owner[place], "word": word, "cell": cell[place], "wide": place >= len(cold)}

    def _take(self, answers: dict[int, dict]) -> None:
        asked = self.runs()
        told = self._read(answers, asked["cell"])
        rows, of = asked["rows"], asked["of"]
        count, node = told >> 1, (told & 1 == 1)[of]
        run, token = of[node], rows[node]
        seen = self.seen[asked["context"]]
        more = pseudo(seen)
        self.p[token] = (count[run] + more[run] * self.p[token]) / (seen[run] + more[run])
        # a run is the context of the token after it; the last of a text is none
        context = np.full(len(self.ids), -1, np.int64)
        context[rows] = of
        self.context = np.roll(context, 1)
        self.context[self.starts] = -1
        self.hashes, self.seen, self.depth = mixed(self.hashes[asked["context"]], self.words[asked["word"]]), count, self.depth + 1


# ---- questions and answers ----
def _request(chunk: int, cell: int, wide: int | None, contexts: np.ndarray, fan: np.ndarray, seen: np.ndarray, following: np.ndarray, times: np.ndarray, prior: np.ndarray) -> tuple:
    return (cell, chunk, wide, len(contexts), len(following), packed(contexts), packed(fan), packed(seen), packed(following), packed(times), packed(prior))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _slices(cell: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(cell, begin, end) of each stretch of equal cells."""
    if not len(cell):
        return
    begins = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
    yield from zip(cell[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(cell)], strict=True)


def ask(number: int, chunk: Chunk) -> pa.Table:
    """What a chunk asks next: of its words, then of its runs of each depth."""
    none, out = np.zeros(0, np.int64), []
    if chunk.depth < 0:
        times = np.bincount(chunk.ids[chunk.learnt], minlength=len(chunk.words))
        order, cell = chunk.root()
        for c, a, b in _slices(cell):
            out.append(_request(number, c, None, none, none, none, chunk.words[order[a:b]], times[order[a:b]], none))
        return _table(out, _arrow(ASKED))
    x = chunk.runs()
    times = np.bincount(x["of"][chunk.learnt[x["rows"]]], minlength=len(x["token"]))
    for c, a, b in _slices(x["cell"]):
        begins = a + np.flatnonzero(np.r_[True, np.diff(x["context"][a:b]) != 0])
        heads = x["context"][begins]
        wide = int(chunk.hashes[heads[0]].view(np.int64)) if x["wide"][a] else None
        out.append(_request(number, c, wide, chunk.hashes[heads], np.diff(np.r_[begins, b]), chunk.seen[heads], chunk.words[x["word"][a:b]] & NEXT, times[a:b], chunk.p[x["token"][a:b]].astype(np.float32)))
    return _table(out, _arrow(ASKED))


def answered(asked: pa.Table, depth: int, rules: Rules) -> pa.Table:
    """A cell's answers: to each chunk twice the count of each run, plus 1 if its context is a node; and a row
    without a chunk: of depth 0 the number of learnt words, of a part of a wide context its gain and occurrences."""
    rows = sorted(asked.to_pylist(), key=lambda r: r["chunk"])
    read = lambda name, kind, of: np.concatenate([unpacked(r[name], kind, r[of]) for r in rows])
    following, times = read("next", np.uint64, "runs"), read("times", np.int64, "runs")
    ends, cell, wide = np.cumsum([r["runs"] for r in rows])[:-1], rows[0]["cell"], rows[0]["wide"]
    if depth:
        contexts, head = np.unique(read("contexts", np.uint64, "heads"), return_inverse=True)
        fan, occurs = read("fan", np.int64, "heads"), np.empty(len(contexts), np.int64)
        occurs[head] = read("seen", np.int64, "heads")
        head = np.repeat(head, fan)
        following = mixed(contexts[head], following)
    found, of = np.unique(following, return_inverse=True)
    n = np.bincount(of, weights=times).astype(np.int64)
    last: tuple | None = (None, depth, cell, wide, None, int((n > 0).sum()), None)
    told = n
    if depth:
        own, prior = np.empty(len(found), np.int64), np.empty(len(found))
        own[of], prior[of] = head, read("prior", np.float32, "runs")
        seen = occurs[own].astype(np.float64)
        more = pseudo(seen)
        # of each occurrence, the context's distribution without it against its suffix's
        ratio = np.log((np.maximum(n - 1, 0) + more * prior) / (seen - 1 + more) / prior)
        gain = np.bincount(own, weights=n * ratio, minlength=len(contexts))
        last = (None, depth, cell, wide, None, int(occurs[0]), float(gain[0])) if wide is not None else None
        told = 2 * n + ((gain >= rules.gain * occurs)[own] if wide is None else 0)
    out = [(r["chunk"], depth, cell, wide, packed(x), None, None) for r, x in zip(rows, np.split(told[of], ends), strict=True)]
    return _table([*out, last] if last else out, _arrow(ANSWER))


def teller(depth: int, rules: Rules) -> Callable[[pa.Table], pa.Table]:
    def run(asked: pa.Table) -> pa.Table:
        return answered(asked, depth, rules)

    return run


def scored(number: int, chunk: Chunk, doc_ids: pa.Array) -> pa.Table:
    total = lambda x: np.add.reduceat(x, chunk.starts)
    word = chunk.known[chunk.ids]
    n, v = chunk.totals
    base = np.log10((word + 1) / (n + v + 1))
    return pa.table({"doc_id": doc_ids, "held_out": pa.array(~chunk.trains), "n_tokens": pa.array(chunk.sizes), "n_known": pa.array(total((word > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(chunk.starts), n, np.int64)), "base_score": pa.array(total(base)), "score": pa.array(total(np.log10(chunk.p)))})


def scores(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    stored = materialize(chunks(docs, rules.chunk), "chunks", compression="uncompressed")
    sums = stored.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("learnt"), F.lit(0)).alias("learnt")).head()
    cells = max(1, -(-sums["tokens"] // rules.cell))
    totals = (sums["learnt"], 0)
    schema = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {schema}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def joined(answers: DataFrame, then: Callable[[int, Chunk, pa.Array], pa.Table], schema: str) -> DataFrame:
        known = totals

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            (row,) = left.select(["chunk", "trains", "sizes", "ids", "words"]).to_pylist()
            chunk = Chunk(row, right.to_pylist(), cells, known, rules)
            return then(row["chunk"], chunk, left.column("doc_ids").combine_chunks().flatten())

        return stored.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from ask(row["chunk"], Chunk(row, [], cells, (0, 0), rules)).to_batches()

    answers = None
    for depth in range(rules.depth + 1):
        asked = joined(answers, lambda number, chunk, _: ask(number, chunk), ASKED) if depth else stored.select("chunk", "trains", "sizes", "ids", "words").mapInArrow(first, ASKED)
        got = materialize(asked.groupBy("cell").applyInArrow(teller(depth, rules), ANSWER), "answers")
        plain = got.where("chunk is not null")
        if depth == 0:
            totals = (totals[0], got.where("chunk is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v")).head()["v"])
            answers = plain.select("chunk", "depth", "cell", "counts", F.lit(False).alias("node"))
            continue
        # a wide context has a row for each of its parts; contexts that wide are few
        parts = got.where("chunk is null").groupBy("wide").agg((F.sum("gain") >= rules.gain * F.max("n")).alias("node"))
        spread = plain.where("wide is not null").join(parts.hint("merge"), "wide")
        answers = answers.unionByName(plain.where("wide is null").select("chunk", "depth", "cell", "counts", F.lit(False).alias("node"))).unionByName(spread.select("chunk", "depth", "cell", "counts", "node"))
    return joined(answers, scored, result)
