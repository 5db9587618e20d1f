"""Cases of the last findings: candidates of the near-duplicate stage grow no faster than the table."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F
from test_round4 import _similar

from folio.llm import simhash


def test_frequent_runs_are_found_whatever_the_number_of_texts(spark, monkeypatch):
    """A run of so many texts counts as frequent in a table of any size, though only a part of a large one is looked through."""
    monkeypatch.setattr(simhash, "LOOKED", 400)
    rng = random.Random(7)
    plates = [" ".join(f"p{k}x{j}" for j in range(12)) for k in range(40)]
    of_plates = {r for p in plates for r in simhash._grams(p)[1].tolist()}
    for n in (400, 2400):
        # each passage is in 20 texts, so its lists would stay the same while the share of texts that have it falls
        texts = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(30)) + (f" {plates[k // 20]}" if k < 800 else "") for k in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        found = set(simhash._frequent(docs).tolist())
        here = {r for p in plates[: -(-min(n, 800) // 20)] for r in simhash._grams(p)[1].tolist() if r < 1 << 63}
        assert found <= of_plates and len(found & here) > 0.7 * len(here)
    monkeypatch.setattr(simhash, "MOST", 10)
    assert len(simhash._frequent(docs)) <= 10


def test_members_of_a_crowd_are_compared_with_a_few_first(spark, monkeypatch):
    """What the first pairs join is not compared pair by pair; what they don't is."""
    monkeypatch.setattr(simhash, "PICKS", 4)
    for n in (200, 400):
        rows = spark.range(n).selectExpr("7L AS k", "id AS node", "id AS root").unionAll(spark.range(3).selectExpr("8L AS k", "id + 1000 AS node", "id + 1000 AS root"))
        tried = []

        def settle(pairs, tried=tried, n=n):
            tried.append(pairs.distinct().count())
            return simhash.components(pairs.where(F.col("u") < n - 10))  # the last ten have no link

        whole = F.array(F.lit(0))
        got = simhash.rest_pairs(rows, ["k"], whole, lambda u, v: F.lit(True), settle=settle)
        pairs = {(r.u, r.v) for r in got.collect()}
        assert tried[0] <= 4 * n
        alone = range(n - 10, n)
        # every pair that still has two roots is there, none is left out: also those of the small list
        assert {p for p in itertools.combinations(range(n), 2) if p[1] in alone} == {(v, u) for u, v in pairs if u < 1000}
        assert {(1001, 1000), (1002, 1000), (1002, 1001)} <= pairs


def test_crowds_lose_no_link(spark, monkeypatch):
    """Texts of one family, many near the limit of similarity: the same components as all pairs."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(70)]
    texts = []
    for _ in range(90):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    real = simhash._sketch
    monkeypatch.setattr(simhash, "_sketch", lambda grams: ([], real(grams)[1]))
    got, want, links = _similar(spark, texts, monkeypatch, CROWD=4, PICKS=2)
    assert links > 100 and len(set(want.values())) > 3 and got == want
    assert np.unique(list(got.values())).size == np.unique(list(want.values())).size
