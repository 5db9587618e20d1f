"""A hybrid search whose nearest papers can't be found fails; it does not return the best-scored papers alone."""

from __future__ import annotations

import warnings
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folio.operators import index as X
from folio.operators import search as S
from folio.operators import vectors as V
from folio.plans import queries as Q

SF = "/root/testdata/sf0.001"
ASKED = S.Request(q="ice", mode="hybrid")
ROWS = [(k, f"ice {k}", None, 2020) for k in range(1, 8)]


def corpus(spark, tmp_path, vectors, **more):
    papers = spark.createDataFrame(ROWS, "id long, title string, abstract string, publication_year int")
    table = spark.createDataFrame(vectors, "paper_id long, embedding array<double>")
    return SimpleNamespace(spark=spark, paper=papers, paper_embedding=table, index=X.build(papers, f"{tmp_path}/index", spread=1), vectors=None, exact=True, **more)


def folder(tmp_path, tables):
    for name in tables:
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["search_indexed_hybrid", "search_hybrid", "search_hybrid_total", "rrf_fuse"])
def test_missing_vectors_are_an_error(spark, tmp_path, name):
    where = folder(tmp_path, ("documents", "supplier"))
    with pytest.raises(PySparkException, match="embeddings"):
        Q.QUERIES[name](spark, where).collect()


@pytest.mark.parametrize("name", ["search_indexed_hybrid", "search_hybrid_total"])
def test_vectors_of_another_length_are_an_error(spark, tmp_path, name):
    where = folder(tmp_path, ("documents", "supplier"))
    spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("embedding", F.slice("embedding", 1, 32)).write.parquet(f"{where}/embeddings.parquet")
    with pytest.raises(Exception, match="64 components, a stored one 32"):  # Spark wraps it if two stages fail at once
        Q.QUERIES[name](spark, where).collect()


def test_a_query_that_is_not_embedded_is_an_error(spark, monkeypatch):
    def broken(q, dim):
        raise RuntimeError("no vector")

    monkeypatch.setattr(S, "query_vector", broken)
    for name in ("search_indexed_hybrid", "search_hybrid", "search_hybrid_total", "rrf_fuse"):
        with pytest.raises(RuntimeError, match="no vector"):
            Q.QUERIES[name](spark, SF)


def test_a_failing_vector_index_is_an_error(spark, tmp_path):
    """Also with a given model: it is the stored vectors that fail, not the model."""
    c = corpus(spark, tmp_path, [(k, [float(k), 1.0]) for k in range(1, 8)])
    c.vectors = V.build(c.paper_embedding, f"{tmp_path}/vectors")
    assert all(r.dense_rank for r in S.hybrid_list(c, ASKED, dim=2).collect())
    for more in ({}, {"embed": lambda q, dim: [1.0] * dim}):
        with pytest.raises(ValueError):
            S.hybrid_list(c, ASKED, dim=3, **more)


@pytest.mark.parametrize("vector", [None, [], [1.0], [1.0, 2.0, 3.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]])
def test_a_given_model_that_fails_is_told(spark, tmp_path, vector):
    """The best-scored papers alone come with a warning."""
    c = corpus(spark, tmp_path, [(k, [float(k), 1.0]) for k in range(1, 8)])
    with pytest.warns(RuntimeWarning, match="without its nearest papers"):
        rows = S.hybrid_list(c, ASKED, dim=2, embed=lambda q, dim: vector).collect()
    assert len(rows) == 7 and all(r.dense_rank is None for r in rows)


def test_papers_without_a_vector_are_no_error(spark, tmp_path):
    """Null vectors and papers without one have no place in the dense list."""
    c = corpus(spark, tmp_path, [(1, [1.0, 1.0]), (2, None), (99, [1.0, 0.0])])
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        rows = S.hybrid_list(c, ASKED, dim=2, embed=lambda q, dim: [1.0, 0.0]).collect()
    assert {r.id: r.dense_rank for r in rows} == {k: 1 if k == 1 else None for k in range(1, 8)}
