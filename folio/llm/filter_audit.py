"""Filter interaction audit: what five filters remove in every order, with exact duplicates by partition refinement.

Texts are split into classes by their length in code points, then by hashes of successive blocks; after each
split the classes of one row are dropped, and only the others go on. Each block is larger than all before
it, so that few splits reach the end of very long texts. Rows whose classes survive have their whole texts
compared, and every row whose text a smaller doc_id has is marked. The marks join four other failure
bits; rows are counted by part, bits and labels, and all orders are computed from these counts alone.

A text is scanned once for its bits and hashes, which are stored; the splits work on these narrow rows.
The comparison reads texts again, but only those of surviving classes: while these are few they are
broadcast, beyond ``FEW`` they are joined. Equal texts are merged in each task before any of them moves,
so no task gets a large group. A class that turns out to hold different texts is settled by the texts.

Cases: null text counts as empty, and empty texts are duplicates of each other. Null doc_ids are greater
than all others and than none of their own kind. Rows that repeat a doc_id don't make each other
duplicates and are counted one by one; of several labels of a doc_id the greatest counts. A null lang is
the part of the empty string. Very long texts are judged whole. Other columns of any name are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, held, materialize

#: Where each block of code points begins; the last goes to the end of the text.
BLOCKS = (0, 64, 1024, 16_384)
#: Surviving classes that are broadcast: two numbers each.
FEW = 1 << 19
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]


def _hashes(blocks: tuple[int, ...], digest: Callable[[Column], Column]) -> dict[str, Column]:
    """What splits texts: n, the code points, then the hash of each block."""
    out = {"n": F.length("text")}
    for k, (a, b) in enumerate(zip(blocks, [*blocks[1:], None], strict=True)):
        out[f"h{k}"] = digest(F.substring("text", F.lit(a + 1), F.lit(b - a) if b else F.greatest(F.length("text") - a, F.lit(0))))
    return out


def measured(docs: DataFrame, blocks: tuple[int, ...] = BLOCKS, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, part, text, bits of A to D, n: code points, h0, h1, ...: hash of each block) of every row."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", "text", held({"w": F.filter(F.split("text", SPACE), lambda x: x != "")}))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    made = {"words": F.size("w"), "unlike": F.size(F.array_distinct("w")), "upper": upper, "signs": F.col("text").rlike(r"[#$%&*|]"), **_hashes(blocks, digest)}
    rows = rows.select("doc_id", "part", "text", held(made))
    wide = lambda name: F.col(name).cast("long")
    fails = [F.col("words") < 200, 100 * wide("unlike") < 50 * wide("words"), 100 * wide("upper") > 3 * wide("n"), F.col("signs")]
    bits = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", "text", bits.alias("bits"), *keys_of(blocks))


def keys_of(blocks: tuple[int, ...]) -> list[str]:
    return ["n", *(f"h{k}" for k in range(len(blocks)))]


def survivors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, of all splits) of the classes that hold more than one row after every split, in ``rows`` (keys, stored)."""
    left, last = rows.select(*keys), None
    for k in range(1, len(keys) + 1):
        some = keys[:k]
        # merged at every size: nothing says how many classes there are
        shared = left.groupBy(*some).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*some)
        if k == len(keys):
            return shared
        left = materialize(left.join(shared.hint("merge"), some, "left_semi"), "refined")
        if last is not None:
            discard(last)
        last = left
    raise ValueError("no keys")


def duplicates(docs: DataFrame, rows: DataFrame, blocks: tuple[int, ...] = BLOCKS, digest: Callable[[Column], Column] = F.xxhash64, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(keys, least: classes of ``rows`` whose rows all have one text, and its least doc_id; keys, text, least: the
    texts of classes that hold several, which only hashes that agree by chance make)."""
    keys = keys_of(blocks)
    classes = materialize(survivors(rows, keys), "classes")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", held(_hashes(blocks, digest)))
    chosen = texts.join(F.broadcast(classes) if classes.count() <= few else classes.hint("merge"), keys, "left_semi")
    # equal texts are merged by each task before they move
    whole = materialize(chosen.groupBy(*keys, "text").agg(F.min("doc_id").alias("least")), "whole")
    compared = materialize(whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least")), "compared")
    mixed = compared.where("texts > 1").select(*keys)
    return compared.where("texts = 1").select(*keys, "least"), whole.join(mixed.hint("merge"), keys, "left_semi")


def masked(docs: DataFrame, blocks: tuple[int, ...] = BLOCKS, digest: Callable[[Column], Column] = F.xxhash64, few: int = FEW) -> DataFrame:
    """(doc_id, part, bits: failures of A to E) of every row."""
    keys = keys_of(blocks)
    rows = materialize(measured(docs, blocks, digest).drop("text"), "facts")
    classes, texts = duplicates(docs, rows, blocks, digest, few)
    later = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    mark = lambda joined: joined.select("doc_id", "part", (F.col("bits") + F.when(later, F.lit(1 << LETTERS.index("E"))).otherwise(F.lit(0))).alias("bits"))
    if texts.isEmpty():
        return mark(rows.join(classes.hint("merge"), keys, "left"))
    mixed = materialize(texts.select(*keys).distinct(), "mixed")
    apart = rows.join(mixed.hint("merge"), keys, "left_anti").join(classes.hint("merge"), keys, "left")
    told = measured(docs, blocks, digest).join(mixed.hint("merge"), keys, "left_semi").join(texts.hint("merge"), [*keys, "text"], "left")
    return mark(apart).union(mark(told))


def interactions(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of rows (doc_id, part, bits): part, filter_order, step and what the step's filter does there."""
    own = labels.groupBy("doc_id").agg(F.max("quality").alias("__q"), F.max("toxic").alias("__t"))
    flag = lambda name: F.coalesce(F.col(name) == 1, F.lit(False)).cast("long")
    told = rows.join(own.hint("merge"), "doc_id", "left").select("part", "bits", flag("__q").alias("good"), flag("__t").alias("bad"))
    # a part has at most 2 ** 5 rows from here on
    counts = told.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("rows"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    plans = [(o, k + 1, 1 << LETTERS.index(o[k]), sum(1 << LETTERS.index(x) for x in o[:k])) for o in ORDERS for k in range(len(LETTERS))]
    names = ("filter_order", "step", "own", "before")
    every = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, plan, strict=True))) for plan in plans))
    steps = counts.select("*", F.inline(every))
    fails = F.col("bits").bitwiseAND(F.col("own")) != 0
    gone = F.col("bits").bitwiseAND(F.col("before")) != 0
    when = lambda c, n="rows": F.sum(F.when(c, F.col(n)).otherwise(F.lit(0).cast("long")))
    sums = {"kept": when(~gone & ~fails), "removed": when(~gone & fails), "redundant": when(gone & fails), "unique_fails": when(F.col("bits") == F.col("own")), "good_lost": when(~gone & fails, "good"), "toxic_lost": when(~gone & fails, "bad")}
    # a filter is first among the j that a row fails in 1 of j of all orders
    sums["shapley"] = when(fails, "share")
    steps = steps.withColumn("share", F.when(F.col("bits") != 0, F.expr(f"rows * {len(ORDERS)} div bit_count(bits)")).otherwise(F.lit(0).cast("long")))
    return steps.groupBy("part", "filter_order", "step").agg(*(v.alias(k) for k, v in sums.items()))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    return interactions(masked(docs), labels)


_VALUES = ", ".join(f"('{o}', {k + 1}, {1 << LETTERS.index(o[k])}, {sum(1 << LETTERS.index(x) for x in o[:k])})" for o in ORDERS for k in range(len(LETTERS)))
#: The same as DuckDB SQL; the texts are compared as they are.
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
  w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
  own AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
  m AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least, least IS NOT NULL)::INT AS bits, coalesce(q = 1, false)::BIGINT AS good, coalesce(t = 1, false)::BIGINT AS bad FROM w LEFT JOIN own USING (doc_id)),
  c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
  s AS (SELECT * FROM (VALUES {_VALUES}) AS v(filter_order, step, own, before)),
  r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (bits & before = 0 AND bits & own = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bits & before = 0 AND bits & own <> 0), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (bits & before <> 0 AND bits & own <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (bits & before = 0 AND bits & own <> 0), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (bits & before = 0 AND bits & own <> 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
