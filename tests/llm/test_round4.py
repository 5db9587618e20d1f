"""Cases of the third round's findings on the corpus operators."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from folio.llm import simhash, url_filter


def test_host_rules_have_the_words_of_the_contract(spark):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/; the longest wins."""
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.name: r.verdict for r in url_filter.HOST_RULES} == want
    # the list alone would block the second url; its host rule allows it
    urls = ["https://a.net/de/9", "https://casino.net/de/casino/f.zip", "https://x.example.net/de/81", "https://example.net/de/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow")}


def _similar(spark, texts, monkeypatch, **constants):
    """(components of the stage, those of all pairs of at least 0.8 or within 4 bits)."""
    for k, v in constants.items():
        monkeypatch.setattr(simhash, k, v)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = simhash.materialize(simhash._signatures(docs), "signatures")
    found = {r.node: r.root for r in simhash._copies(docs, own, simhash.DISTANCE, hot=constants.get("HOT", simhash.HOT)).collect()}
    nodes = {r.doc_id: r.node for r in own.collect()}
    sets = {nodes[k]: set(simhash._grams(t)[1].tolist()) for k, t in enumerate(texts)}
    fps = {nodes[k]: simhash.fingerprint(t) for k, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) or ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 4]
    root = {x: x for x in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {x: found.get(x, x) for x in sets}, root, len(links)


def test_pairs_that_share_no_band_are_linked(spark, monkeypatch):
    """Without any band, and with every key of more than three texts split: the same components as all pairs."""
    rng = random.Random(3)
    plate = [f"p{k}" for k in range(12)]
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 9, 30, 60, 200]))]
        for _ in range(6):
            cut = rng.randrange(1, 2 + len(base) // 9)
            own = base[:-cut] + [f"x{rng.randrange(10**6)}" for _ in range(cut)]
            texts.append(" ".join(own + plate * (g % 3 == 0)))
    for sketches in (lambda grams: ([], real(grams)[1]), None):
        real = simhash._sketch
        with monkeypatch.context() as m:
            if sketches:
                m.setattr(simhash, "_sketch", sketches)
            got, want, links = _similar(spark, texts, m, HOT=3, FREQUENT=3)
        assert links > 20 and got == want


def _shuffled(spark):
    """Bytes of all shuffles of this session so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    events = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(events.apply(k).shuffleWriteBytes() for k in range(events.size()))


def test_texts_and_runs_are_not_shuffled_more_than_needed(spark):
    """Each text has one posting per run of its prefix, which is dealt to its run once for counts and once for pairs; texts stay where they are."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(2000)]
    texts += [t.replace("1 ", "2 ", 2) for t in texts[:100]]
    docs = simhash.materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "texts")
    before = _shuffled(spark)
    assert simhash.deduplicated(docs).count() <= 2000
    postings = 2100 * (400 * 2 // 10 + 1)
    assert _shuffled(spark) - before < 150 * postings


def test_prefixes_rule_out_no_similar_texts(spark):
    """Every pair of a similarity of 0.8 or more passes, whatever runs are frequent; unlike ones that share a part don't."""
    rng = random.Random(6)
    pairs, frequent = [], set()
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 400))]
        other = list(words)
        for _ in range(rng.randrange(2 + len(words) // 30)):
            other[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        if k % 3 == 0:
            other = words[: len(words) // 3] + [f"y{rng.randrange(10**6)}" for _ in words[len(words) // 3 :]]
        pairs.append([simhash._grams(" ".join(w))[1] for w in (words, other)])
        frequent |= set(pairs[-1][0].tolist()[:: k % 5 + 1])
    often = np.sort(np.array(list(frequent), np.uint64))
    share = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in pairs]
    rows = [(k, *(simhash._head(g, often).tolist() for g in p), *map(len, p)) for k, p in enumerate(pairs)]
    kept = {r.k for r in spark.createDataFrame(rows, "k long, a array<int>, b array<int>, m int, n int").where(simhash.head_alike(*map(F.col, "abmn"))).collect()}
    assert sum(x >= 0.8 for x in share) > 50 and all(k in kept for k, x in enumerate(share) if x >= 0.8)
    assert sum(k in kept for k, x in enumerate(share) if x < 0.4) < 0.3 * sum(x < 0.4 for x in share)
    assert all(row[1] == sorted(row[1]) for row in rows)


def test_rows_that_may_be_chosen_hold_all_that_are(spark, monkeypatch):
    """Also with few bits; both parts together are all rows, once."""
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), F.lit("x").alias("__word"))
    chosen = rows.where("h % 7 = 0").select(F.col("h").alias("other"))
    for bits in (64, simhash.MARKS):
        monkeypatch.setattr(simhash, "MARKS", bits)
        some, rest = (simhash.maybe(rows, F.col("h"), chosen, wanted) for wanted in (True, False))
        assert some.columns == rows.columns and some.count() + rest.count() == 5000 and rest.where("h % 7 = 0").count() == 0
        assert bits == 64 or some.count() < 1.1 * chosen.count()
