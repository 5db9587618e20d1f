"""Cases of the third round's findings on the library's queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import grams as G
from folio.operators import index as X
from folio.operators import upkeep as K
from folio.operators.store import SCHEMAS, Attempt, Store
from folio.plans import queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_abstracts_are_rebuilt_inside_their_rows(spark, tmp_path):
    """No shuffle, and rows that repeat a doc_id are not mixed."""
    texts = [(1, "b a  b c a b"), (1, "a z"), (2, None), (3, ""), (4, "   "), (None, "x y x"), (5, " ".join(f"w{k % 7}" for k in range(5000)))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.QUERIES["abstract_rebuild"](spark, str(tmp_path))
    want = [(k, " ".join(x for x in (t or "").split(" ") if x) or None) for k, t in texts]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert "Exchange" not in plan(out)


def test_indexes_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    """Each folder gets as many tasks, so files, as its postings ask for; contents stay the same."""
    monkeypatch.setattr(G, "CHARS", 200)
    monkeypatch.setattr(X, "ROWS", 20)
    rows = [(k, f"alpha beta{k % 7} gamma", None if k % 5 == 0 else f"alpha word{k} gamma delta{k % 3}") for k in range(400)]
    papers = spark.createDataFrame(rows, "id long, title string, abstract string")
    files = lambda path: len({f for f in spark.read.parquet(path).inputFiles()})
    grams = G.build(papers, f"{tmp_path}/grams", folders=2, spread=1)
    assert files(f"{tmp_path}/grams/grams") > 16
    found = grams.postings.groupBy("gram").agg(F.countDistinct("id").alias("papers"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, grams.counts.collect()))
    index = X.build(papers, f"{tmp_path}/index", folders=2, spread=1)
    assert files(f"{tmp_path}/index/segment/postings") > 16
    assert index.sums["papers"] == 400 and index.postings.count() == 400 * 3 + 320 * 4


def test_texts_of_known_fixtures_are_not_kept(spark, tmp_path, monkeypatch):
    """A call that inserts nothing stores and numbers ids only; the counts stay right."""
    rows = [(f"W{k}", f"title {k}", "text " * 50, 2000, ["a"], ["t"]) for k in range(40)] + [("W3", "a title", None, None, [], []), (None, "x", None, None, [], []), ("W99", " ", None, None, [], [])]
    fixtures, store = spark.createDataFrame(rows, K.FIXTURE), Store(spark, str(tmp_path))
    kept, keep = [], Attempt.keep
    monkeypatch.setattr(Attempt, "keep", lambda self, rows, name: kept.append(set(rows.columns)) or keep(self, rows, name))
    assert K.seed(store, fixtures) == (0, 40)
    assert {r.openalex_id: r.title for r in store.tables()["paper"].collect()}["W3"] == "a title"
    kept.clear()
    assert K.seed(store, fixtures) == (40, 0) and kept and not any({"title", "abstract"} & x for x in kept)


def test_changed_rows_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Stored rows are merged in the buckets' tasks; no join deals them out a second time."""
    store = Store(spark, str(tmp_path), buckets=2)
    one = lambda k, n: (k, f"W{k}", f"t{n}", None, None, None, n, None, None)
    store.publish({"paper": spark.createDataFrame([one(k, 0) for k in range(20)] + [(99, None, "null", *[None] * 6)], SCHEMAS["paper"])})
    merged, written = [], Attempt._written
    monkeypatch.setattr(Attempt, "_written", lambda self, rows, kind, name: (kind == "whole" and merged.append(plan(rows))) or written(self, rows, kind, name))
    store.publish({"paper": spark.createDataFrame([one(k, 1) for k in range(10, 25)] + [(98, None, "null", *[None] * 6)], SCHEMAS["paper"])})
    got = [(r.openalex_id or "", r.cited_by_count) for r in store.tables()["paper"].collect()]
    assert len(got) == 27
    assert {k: n for k, n in got if k} == {f"W{k}": int(k >= 10) for k in range(25)} and [k for k, _ in got].count("") == 2
    assert merged and not any("Join" in x for x in merged)
