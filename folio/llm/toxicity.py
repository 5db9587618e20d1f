"""Toxicity by maximum-scoring segments of token log-odds.

Training counts every word of every labelled training text. A word stands for itself and for its
beginnings of 3 to 6 letters (inflected and compounded insults share those). A feature's log-odds
between toxic and clean texts has a Dirichlet prior in proportion to its overall frequency; words
take their strongest significant feature's, any other word a small negative score. One linear scan per
text finds every maximal segment of positive total score. Each segment's chance under clean text
follows the extreme-value law 1 - exp(-K n exp(-lambda s)), with lambda and K from the clean
training texts; the segments' -log chances add up, and a logistic curve fitted on a histogram of the
training texts' sums maps the sum to a probability.

Bounds: the classifier learns from at most about ``max_texts`` labelled texts (of more, a share chosen
by the hash of the doc_id), so the features that pass ``z`` and ``least``, all of which it keeps, are
bounded too: each needs several toxic texts that have it. The driver gets these features, two sums and
a histogram whose bins grow with the sum, so it has as many as the logarithm of the longest text.

Cases: a null or empty text has no segment and the lowest score. Very long texts are scored whole, in
time linear in their words. Documents without a label, or without a doc_id, only get scored. Repeated
rows score alike. Other columns of any name are kept by ``scored``. Labels of both classes are needed;
without them nothing is toxic. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize
from .tokens import release, small

WORD = re.compile(r"[^\W\d_]+")
BEGIN = (3, 4, 5, 6)
#: Histogram bins per unit of log(1 + evidence); parts of a score that sums count.
BINS, PARTS = 40, 1_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last) of a text in which the words at ``hits``
    (position, score) score so and every other word ``other`` (negative): Ruzzo and Tompa's linear scan."""
    # candidates: sum before it, sum at its end, first, last, and the nearest earlier one with a smaller sum before it
    found: list[tuple[float, float, int, int, int]] = []
    total, at = 0.0, 0
    for position, score in hits:
        before = total + (position - at) * other
        total, at = before + score, position + 1
        if score <= 0:
            continue
        left, first, k = before, position, len(found) - 1
        while k >= 0:
            if found[k][0] >= left:
                k = found[k][4]  # those between have no smaller sum before them than it has
            elif found[k][1] >= total:
                break
            else:  # they join: what stands before the candidate is linked from it
                left, _, first, _, link = found[k]
                del found[k:]
                k = link
        found.append((left, total, first, position, k))
    return [(end - begin, a, b) for begin, end, a, b, _ in found]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.1
    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -20.0

    def word_score(self, word: str) -> float | None:
        """Score of the strongest feature the word has; None without any."""
        get = self.scores.get
        best = get(word)
        for n in BEGIN:
            if len(word) < n:
                break
            other = get(word[:n] + "*")
            if other is not None and (best is None or abs(other) > abs(best)):
                best = other
        return best

    def passages(self, text: str, known: dict[str, float | None]) -> tuple[list[tuple[float, int, int]], int]:
        """(segments, number of words) of a text; ``known`` remembers words' scores."""
        words = words_of(text)
        hits = []
        for k, word in enumerate(words):
            try:
                score = known[word]
            except KeyError:
                score = self.word_score(word)
                if len(word) <= LONGEST:
                    known[word] = score
            if score is not None:
                hits.append((k, score))
        return segments(hits, self.other), len(words)

    def evidence(self, found: list[tuple[float, int, int]], n: int) -> float:
        """Sum over segments of -log of their chance under clean text of n words."""
        total = 0.0
        for score, _, _ in found:
            expected = self.k * max(n, 1) * math.exp(-self.rate * score)
            total -= math.log(-math.expm1(-expected)) if expected > 1e-12 else math.log(self.k * max(n, 1)) - self.rate * score
        return max(total, 0.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * evidence + self.shift))))


#: Longer words are scored each time they come, so that a worker's memory is bounded in bytes.
LONGEST = 64


def _bounded(known: dict) -> dict:
    return {} if len(known) > 200_000 else known


def training(docs: DataFrame, labels: DataFrame, max_texts: int) -> DataFrame:
    """(text, toxic) of labelled texts that may be learned from, about ``max_texts`` at most. A hot doc_id's
    labels are one row; labels grow with the corpus, so they are never broadcast."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > max_texts:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_texts)
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull() & ~held_out())
    return own.join(marks.hint("merge"), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): texts that have the word. Tasks send each distinct word once for every 100,000 words they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tables: list[Counter[str]] = [Counter(), Counter()]

        def rows() -> pa.RecordBatch:
            words = list(tables[0] | tables[1])
            out = pa.record_batch({"word": pa.array(words, pa.string()), "toxic": pa.array([tables[1][w] for w in words], pa.int64()), "clean": pa.array([tables[0][w] for w in words], pa.int64())})
            for table in tables:
                table.clear()
            return out

        for whole in batches:
            for batch in small(whole):
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    tables[bool(toxic)].update(set(words_of(text)))
                if len(tables[0]) + len(tables[1]) > 100_000:
                    yield rows()
        yield rows()

    return labelled.mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(labelled: DataFrame, toxic: float, clean: float, prior: float = 20.0) -> DataFrame:
    """(feature, a, b: toxic and clean texts that have it, a beginning once for each word with it, odds: their log-odds with a Dirichlet prior, z: their significance)."""
    begins = F.array(F.col("word"), *(F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in BEGIN))
    features = word_counts(labelled).select(F.explode(begins).alias("feature"), "toxic", "clean").where("feature is not null").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    # Dirichlet prior: ``prior`` texts that have the feature as often as all texts do
    both, share = F.col("a") + F.col("b"), toxic / (toxic + clean)
    pseudo = prior * (both + 0.5) / (toxic + clean + 1)
    odds = F.log((F.col("a") + pseudo) / (toxic + prior)) - F.log((F.col("b") + pseudo) / (clean + prior))

    def surprise(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    # the root of the log-likelihood ratio against one frequency in both classes
    root = F.sqrt(F.greatest(F.lit(0.0), 2 * (surprise(F.col("a"), both * share) + surprise(F.col("b"), both * (1 - share)))))
    return features.withColumn("odds", odds).withColumn("z", root)


def fit(docs: DataFrame, labels: DataFrame, z: float = 5.0, least: float = 2.0, prior: float = 20.0, max_texts: int = 2_000_000) -> Model:
    bound_batches(docs.sparkSession)
    labelled = materialize(training(docs, labels, max_texts), "labelled")
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy((F.col("toxic") != 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = float(sizes.get(True, 0)), float(sizes.get(False, 0))
    if not toxic or not clean:
        return Model()
    kept = log_odds(labelled, toxic, clean, prior).where((F.col("z") >= z) & (F.col("odds") >= least)).select("feature", "odds").collect()
    model = Model({r["feature"]: r["odds"] for r in kept})
    spark = docs.sparkSession

    def measured(m: Model, what) -> list:
        """Rows (y: toxic, bin, n, total) of what(model, segments, words) -> (bin, value) pairs over the labelled texts; y = 2 sums words.
        Values are summed in whole parts, so that the order of tasks changes nothing."""
        shared = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, known = shared.value, {}
            n: Counter[tuple[int, int]] = Counter()
            total: Counter[tuple[int, int]] = Counter()
            for whole in batches:
                for batch in small(whole):
                    known = _bounded(known)
                    for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                        found, words = own.passages(text, known)
                        n[2, 0] += words * (not y)
                        for at, value in what(own, found, words):
                            n[int(bool(y)), at] += 1
                            total[int(bool(y)), at] += round(value * PARTS)
            keys = sorted(n)
            yield pa.record_batch({"y": pa.array([y for y, _ in keys], pa.int32()), "bin": pa.array([b for _, b in keys], pa.int32()), "n": pa.array([n[k] for k in keys], pa.int64()), "total": pa.array([total[k] for k in keys], pa.int64())})

        return labelled.mapInArrow(run, "y int, bin int, n long, total long").groupBy("y", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()

    # extreme-value law of clean segments: exponential tail of their scores, one constant per clean word
    sums = {r["y"]: r for r in measured(model, lambda m, found, n: ((0, s) for s, _, _ in found))}
    n, mean = (sums[0]["n"], sums[0]["total"] / PARTS) if 0 in sums else (0, 0.0)
    model.rate = float(min(4.0, max(0.2, (n + 1) / (mean + 1))))
    model.k = float((n + 1) / (sums[2]["n"] + 1))

    def evidence(m: Model, found: list, n: int) -> list[tuple[int, float]]:
        value = m.evidence(found, n)
        return [(int(math.log1p(value) * BINS), value)]

    bins = sorted((r["bin"], r["y"], r["n"], r["total"] / PARTS) for r in measured(model, evidence) if r["y"] < 2)
    at = {b: k for k, b in enumerate(dict.fromkeys(b for b, *_ in bins))}
    table = np.zeros((3, len(at)))
    for b, y, n, total in bins:
        table[y, at[b]] = n
        table[2, at[b]] += total
    model.slope, model.shift = logistic(table[2] / np.maximum(1, table[0] + table[1]), table[1], table[0])
    return model


def logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted logistic regression on one feature by Newton's steps, with a small ridge."""
    n, w = positive + negative, np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (positive - n * p) - ridge * w
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + ridge * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def scored(docs: DataFrame, model: Model, column: str = "__toxicity") -> DataFrame:
    """``docs`` with all its columns and a score from 0 to 1 in ``column``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the classifier's sample
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own, known = shared.value, {}
        for whole in batches:
            for batch in small(whole):
                known = _bounded(known)
                scores = [own.probability(own.evidence(*own.passages(t or "", known))) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def toxic_passages(docs: DataFrame, model: Model, chance: float = 0.01) -> DataFrame:
    """doc_id, first_word, last_word, score, chance, passage of every segment whose chance under clean text is at most ``chance``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found, n = own.passages(text or "", known)
                words = words_of(text or "") if found else []
                for s, a, b in found:
                    e = -math.expm1(-own.k * max(n, 1) * math.exp(-own.rate * s))
                    if e <= chance:
                        rows.append((doc_id, a, b, s, e, " ".join(words[a : b + 1])))
            known = _bounded(known)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "first_word", "last_word", "score", "chance", "passage"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, first_word long, last_word long, score double, chance double, passage string")


THRESHOLD = 0.3


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    own = docs.select("doc_id", "text")
    return scored(own, fit(own, labels), "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
