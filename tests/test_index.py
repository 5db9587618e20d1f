"""The stored index against BM25 over the texts."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from folio.operators import index as X
from folio.operators import search as S

PAPERS = "id long, title string, abstract string, publication_year int"
ROWS = [
    (1, "Ice sheets and ice cores", "The ice of the north; ice, ice", 2020),
    (2, "Ärzte, ÉTÉ und Eis", None, 2021),
    (3, "", "", 2022),
    (4, "...", "ice", 2022),
    (5, None, "long " * 5000 + "ice", 2023),
    (6, "cores", "no such word", 2019),
    (7, "Ice sheets and ice cores", "The ice of the north; ice, ice", 2020),
]
ASKED = {"a": "ice cores", "b": "ÉTÉ", "c": "the unknownword", "d": "?!", "e": "long"}


def scores(rows):
    return sorted((r.id, r.qid, r.score) for r in rows.collect())


def test_equals_scan(spark, tmp_path):
    papers = spark.createDataFrame(ROWS, PAPERS)
    index = X.build(papers, f"{tmp_path}/one", spread=2)
    assert scores(index.bm25_many(papers, ASKED)) == scores(S.bm25_many(papers, papers, ASKED))
    some = papers.where("publication_year < 2022")  # statistics stay those of the whole corpus
    got = scores(index.bm25_many(some, ASKED))
    assert got == scores(S.bm25_many(some, papers, ASKED)) and {i for i, q, _ in got if q == "a"} == {1, 6, 7}
    counts = {(r.id, r.field, r.term): (r.tf, r.len) for r in index.postings.collect()}
    assert counts[1, 1, "ice"] == (3, 7) and counts[5, 1, "long"] == (5000, 5001) and counts[2, 0, "été"] == (1, 4)
    assert len(counts) == index.postings.count() and not {i for i, *_ in counts} & {3}


def test_reads_only_its_terms(spark, tmp_path):
    papers = spark.createDataFrame(ROWS, PAPERS)
    index = X.build(papers, f"{tmp_path}/one", spread=2)
    plan = index.bm25_many(papers, {"a": "ice"})._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan or "folder#" in plan.split("PartitionFilters: ")[1]
    assert index.postings.where("folder is null").count() == 0


def test_refresh(spark, tmp_path):
    papers = spark.createDataFrame(ROWS, PAPERS)
    old = X.build(papers, f"{tmp_path}/old", spread=1)
    after = spark.createDataFrame([*ROWS[1:3], (4, "ice age", None, 2022), *ROWS[4:], (9, "new ice", "cores", 2024)], PAPERS)
    changed = spark.createDataFrame([(1,), (4,), (9,), (9,)], "id long")
    fresh = X.refresh(old, after, changed, f"{tmp_path}/new")
    assert sorted(map(tuple, fresh.postings.collect())) == sorted(map(tuple, X.build(after, f"{tmp_path}/whole").postings.collect()))
    assert scores(fresh.bm25_many(after, ASKED)) == scores(S.bm25_many(after, after, ASKED))
    assert scores(old.bm25_many(papers, ASKED)) == scores(S.bm25_many(papers, papers, ASKED))


@pytest.mark.parametrize("rows", [[], [(1, "ice", None, 2020), (2, None, None, 2020)], [(1, None, None, 2020)]])
def test_odd_corpora(spark, tmp_path, rows):
    """No papers, a field without tokens, no tokens at all."""
    papers = spark.createDataFrame(rows, PAPERS)
    index = X.build(papers, f"{tmp_path}/odd", spread=1)
    got = scores(index.bm25_many(papers, ASKED))
    assert got == scores(S.bm25_many(papers, papers, ASKED)) and [i for i, *_ in got] == [i for i, t, *_ in rows if t]


def test_search_uses_it(spark, tmp_path):
    papers = spark.createDataFrame(ROWS, PAPERS)
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 8)], "paper_id long, embedding array<double>")
    texts = SimpleNamespace(paper=papers, paper_embedding=vectors, index=None)
    stored = SimpleNamespace(paper=papers, paper_embedding=vectors, index=X.build(papers, f"{tmp_path}/one", spread=1))
    for mode in ("ranked", "hybrid"):
        both = [sorted(map(tuple, S.matches(c, S.Request(q="ice", mode=mode)).collect()), key=str) if mode == "ranked" else sorted(map(tuple, S.hybrid_list(c, S.Request(q="ice", mode=mode), dim=2).collect())) for c in (texts, stored)]
        assert both[0] == both[1] and both[0]


def words(k: int, version: int = 0) -> tuple:
    return (k, f"ice title {k % 7}", f"ice core {'long ' * (k % 5)}v{version} w{k % 11}" if k % 6 else None, 2020)


def test_segments_equal_scan_over_many_refreshes(spark, tmp_path):
    """New, changed, emptied, gone, returned and unknown papers; after each refresh all scores, postings and statistics equal a new index's."""
    rows = {k: words(k) for k in range(60)}
    index = X.build(spark.createDataFrame(list(rows.values()), PAPERS), f"{tmp_path}/0", folders=4, spread=1)
    asked = {"a": "ice core", "b": "long w3 title", "c": "v1 v2 v3", "d": "none"}
    steps = [{100: words(100, 1)}, {3: words(3, 1), 4: None}, {3: words(3, 2), 5: (5, None, None, 2020)}, {4: words(4, 3), 999: None}, {k: words(k, 3) for k in range(20, 45)}, {k: None for k in range(30)}]
    most = 1
    for n, step in enumerate(steps, 1):
        rows = {k: v for k, v in (rows | step).items() if v}
        papers = spark.createDataFrame(list(rows.values()), PAPERS)
        index = X.refresh(index, papers, spark.createDataFrame([(k,) for k in (*step, None)], "id long"), f"{tmp_path}/{n}", spread=1)
        most = max(most, len(index.segments))
        whole = X.build(papers, f"{tmp_path}/whole{n}", folders=4, spread=1)
        assert index.sums == whole.sums
        assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, whole.postings.collect()))
        assert scores(index.bm25_many(papers, asked)) == scores(S.bm25_many(papers, papers, asked)) != []
        assert sorted(map(tuple, index.frequencies(["ice", "v3"]).where("df > 0").collect())) == sorted(map(tuple, whole.frequencies(["ice", "v3"]).collect()))
    assert 1 < most < len(steps)


def test_one_changed_paper_writes_one_small_segment(spark, tmp_path):
    papers = spark.createDataFrame([words(k) for k in range(200)], PAPERS)
    old = X.build(papers, f"{tmp_path}/old", spread=1)
    after = papers.where("id <> 7").unionByName(spark.createDataFrame([words(7, 9)], PAPERS))
    fresh = X.refresh(old, after, spark.createDataFrame([(7,)], "id long"), f"{tmp_path}/new")
    assert fresh.segments[0] == old.segments[0] and len(fresh.segments) == 2
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/new/segment/postings").collect()} == {7}
    same = X.refresh(fresh, after, spark.createDataFrame([(5000,)], "id long"), f"{tmp_path}/same")
    assert same.segments == fresh.segments and same.sums == fresh.sums
    with pytest.raises(Exception):  # an index that was never finished
        X.Index(spark, f"{tmp_path}/new/segment")


def test_merge_policy():
    assert X._from([("a", 1000, 0), ("b", 10, 0)]) == 1
    assert X._from([("a", 1000, 0), ("b", 20, 0), ("c", 10, 0)]) == 1
    assert X._from([("a", 60, 0), ("b", 20, 0), ("c", 10, 0)]) == 0
    assert X._from([("a", 1000, 0), ("b", 0, 500)]) == 0, "papers that only go make a segment heavy too"
