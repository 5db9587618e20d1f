"""Vector and substring indexes against full scans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import grams as G
from folio.operators import search as S
from folio.operators import vectors as V
from folio.plans.corpus import Corpus

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    c = Corpus(spark, SF)
    return c, V.build(c.paper_embedding, str(tmp_path_factory.mktemp("vectors") / "index"))


def pairs(df):
    return [(r.id, r.sim) for r in df.collect()]


def test_recall_and_cells_read(vectors):
    c, index = vectors
    stored = np.array([r.embedding for r in c.paper_embedding.where("paper_id % 97 = 5").orderBy("paper_id").collect()], float)
    queries = [*stored[:6].tolist(), *(S.query_vector(q, 64) for q in ("this from", "with", "que"))]
    hits, read = [], []
    for q in queries:
        exact, got = ({i for i, _ in pairs(x)} for x in (S.dense(c.paper, c.paper_embedding, q), index.search(q, S.WINDOW)))
        hits.append(len(exact & got) / len(exact))
        read.append(index.sizes[index.first_cells(q, S.WINDOW, index.share, index.sizes)].sum() / index.sizes.sum())
    assert np.mean(hits) >= 0.95, hits
    assert max(read) < 0.95 and len(index.centroids) > 60  # these vectors point everywhere alike


def test_few_cells_are_read_where_vectors_have_structure(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + 0.15 * rng.normal(size=16)).tolist()) for k in range(6000)]
    table = spark.createDataFrame(rows, "paper_id long, embedding array<double>")
    index = V.build(table, str(tmp_path / "s"))
    x = V._unit(np.array([v for _, v in rows]))
    assert index.share <= 0.15
    for q in (7, 1234, 5999):
        best = set(np.argsort(-(x @ x[q]))[:100].tolist())
        assert len(best & {i for i, _ in pairs(index.search(rows[q][1], 100))}) >= 95
        sure = index.search(rows[q][1], 100, exact=True)
        assert {i for i, _ in pairs(sure)} == best
    worst = index.near(index.first_cells(rows[7][1], 100, index.share, index.sizes), rows[7][1], 100, None).agg(F.min("sim")).head()[0]
    assert index.sizes[index.bounds(rows[7][1]) >= worst].sum() < 3000  # the bounds rule most cells out


def test_exact_search_equals_the_scan(vectors):
    c, index = vectors
    some = c.paper.where("id % 5 = 1")
    few = c.paper.where("id % 400 = 3")
    for q in (S.query_vector("this from", 64), index.vector_of(11)):
        assert pairs(index.search(q, S.WINDOW, exact=True)) == pairs(S.dense(c.paper, c.paper_embedding, q))
        for own in (some, few, some.limit(0)):
            assert pairs(index.search(q, S.WINDOW, own, exact=True)) == pairs(S.dense(own, c.paper_embedding, q))
    assert len(pairs(index.search(S.query_vector("x", 64), S.WINDOW, few))) == few.join(c.paper_embedding, F.col("id") == F.col("paper_id")).count()


def test_only_chosen_cells_are_read(vectors):
    _, index = vectors
    plan = index.near([1, 2], S.query_vector("x", 64), 5, None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") or "cell" in plan.split("PartitionFilters")[1][:80]


def test_odd_vectors(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "paper_id long, embedding array<float>")
    index = V.build(make([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.1])]), str(tmp_path / "a"))
    assert pairs(index.search([2.0, 0.0], 2, exact=True)) == [(3, 1.0), (4, 1.0)] and index.vector_of(1) is None
    assert pairs(index.search([2.0, 0.0], 9, exact=True, other_than=3))[0] == (4, 1.0)
    nothing = V.build(make([]), str(tmp_path / "b"))
    assert pairs(nothing.search([1.0, 0.0], 3)) == [] == pairs(nothing.search([1.0, 0.0], 3, exact=True))


def test_hot_vector(spark, tmp_path):
    """A third of all vectors is one vector: its cell is dealt over files, and the search stays exact."""
    rows = spark.range(900).select(F.col("id").alias("paper_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.sin("id"), F.cos("id"))).alias("embedding"))
    index = V.build(rows, str(tmp_path / "c"), cells=9)
    scan = rows.select(F.col("paper_id").alias("id"), F.round(S.T.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(2.0))), 6).alias("sim")).orderBy(F.desc("sim"), "id").limit(400)
    assert pairs(index.search([1.0, 2.0], 400, exact=True)) == pairs(scan)


TITLES = [(1, "100% Sure_thing", None), (2, "Attention is all", "you NEED"), (3, "", None), (4, "ab", "x"), (5, "cab", "Zürich ÉTÉ"), (6, None, "abc" * 400), (7, "a%b_c", "needle"), (8, "İstanbul", "ß"), (9, "kneed", "attend")]


@pytest.fixture(scope="module")
def titles(spark, tmp_path_factory):
    papers = spark.createDataFrame(TITLES, "id long, title string, abstract string")
    return papers, G.build(papers, str(tmp_path_factory.mktemp("grams") / "index"), folders=3)


@pytest.mark.parametrize("q", ["%", "_", "100%", "e_t", "need", "NEED att", "ab", "a", "b", "AB c", "cab", "zürich", "été", "é", "bca", "nothing", "a%b", "ab ab ab", "İ", "ß", "  "])
def test_substrings_equal_the_scan(titles, q):
    papers, index = titles
    scan = {r.id for r in papers.where(S.substring_match(q)).collect()}
    found = index.candidates(q)
    assert {r.id for r in (papers if found is None else papers.join(found, "id", "left_semi")).where(S.substring_match(q)).collect()} == scan
    assert found is None or scan <= {r.id for r in found.collect()}


def test_substring_postings_narrow_the_search(titles):
    papers, index = titles
    assert {r.id for r in index.candidates("need").collect()} == {2, 7, 9}
    word = lambda g: "".join(chr(g >> G.BITS * k & (1 << G.BITS) - 1) for k in (2, 1, 0))
    assert set(map(word, index.chosen(["needle"])["needle"])) < {"nee", "eed", "edl", "dle"} and index.read(G.runs_of("edl", 0).tolist()).collect()[0].id == 7
    assert "PushedFilters: [IsNotNull(gram), GreaterThanOrEqual(gram" in index.postings.where(index.beginning("ab"))._jdf.queryExecution().executedPlan().toString()
