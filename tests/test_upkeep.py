"""Seeding, catalogue, gauges, health; vectors replaced by an upsert."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folio.operators import runs as U
from folio.operators import upkeep as K
from folio.operators.store import Conflict, Store

ROWS = [
    ("E1", "first", "text", 2020, ["Ann", " Ann ", "Bo", None, " "], ["cv", "llm"]),
    ("E2", "second", None, 2021, ["Ann"], ["cv"]),
    ("E2", "another second", None, 2022, [], []),
    ("E3", "third", "x" * 100_000, None, None, None),
    (None, "no id", "a", 2020, ["Cy"], ["none"]),
    ("E4", "  ", "a", 2020, ["Cy"], ["none"]),
    ("E5", None, "a", 2020, ["Cy"], ["none"]),
]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=4)


def works(spark, *ids):
    row = "named_struct('author', named_struct('id', 'https://x/A1', 'display_name', 'Bo'))"
    return spark.createDataFrame([(i,) for i in ids], "k string").selectExpr(
        "concat('https://x/', k) id", "k display_name", "2020 publication_year", "'2020-01-01' publication_date", "'2024-01-01' updated_date",
        "cast(null as map<string,array<int>>) abstract_inverted_index", "1L cited_by_count", "cast(null as string) doi", f"array({row}) authorships", "cast(array() as array<string>) landing_pages", "'t' topic",
    )


def test_seed_inserts_what_is_missing_once(spark, store):
    fixtures = spark.createDataFrame(ROWS, K.FIXTURE)
    assert tuple(K.seed(store, fixtures)) == (0, 3) and tuple(K.seed(store, fixtures)) == (3, 0) and store.versions() == [1]
    t = store.tables()
    papers = {r.openalex_id: r for r in t["paper"].collect()}
    assert {k: papers[k].title for k in papers} == {"E1": "first", "E2": "another second", "E3": "third"}
    assert sorted(r.id for r in papers.values()) == [1, 2, 3] and len(papers["E3"].abstract) == 100_000
    names = {r.openalex_id: r.name for r in t["author"].collect()}
    assert sorted(names.values()) == ["Ann", "Bo"] and sorted((r.openalex_id, names[r.author_id]) for r in t["paper_author"].collect()) == [("E1", "Ann"), ("E1", "Bo")]
    assert sorted(map(tuple, K.catalogue(t["topic"], t["paper_topic"].union(t["paper_topic"])).collect())) == [("cv", "cv", 1), ("llm", "llm", 1)]
    more = spark.createDataFrame([("E9", "ninth", None, 2020, ["Bo", "Di"], ["cv", "new"]), ROWS[0]], K.FIXTURE)
    assert tuple(K.seed(store, more)) == (1, 1)
    t = store.tables()
    assert sorted(r.name for r in t["author"].collect()) == ["Ann", "Bo", "Di"] and sorted(r.slug for r in t["topic"].collect()) == ["cv", "llm", "new"]
    assert tuple(K.seed(store, fixtures.limit(0))) == (0, 0) and store.versions() == [1, 2]


def test_seed_and_ingest_share_ids_and_authors(spark, store):
    topics = [("t", "T1", "Topic")]
    U.run_full(store, works(spark, "W1", "W2"), topics, "2024-01-01T00:00:00", least=0, most=100)
    assert tuple(K.seed(store, spark.createDataFrame(ROWS[:1], K.FIXTURE))) == (0, 1)
    report = U.run_full(store, works(spark, "W1", "W2", "W3"), topics, "2024-01-02T00:00:00", least=0, most=100)
    t = store.tables()
    assert report.papers_in_db == 4 and sorted(r.id for r in t["paper"].collect()) == [1, 2, 3, 4]
    assert [r.openalex_id for r in t["author"].where("name = 'Bo'").collect()] == ["A1"]


def test_seed_in_conflict_leaves_the_winner(spark, store, monkeypatch):
    fixtures = spark.createDataFrame(ROWS[:1], K.FIXTURE)
    begin = store.begin

    def late():
        attempt = begin()
        Store(spark, store.folder).publish({"topic": spark.createDataFrame([("x", "X", "x")], "slug string, openalex_id string, name string")})
        return attempt

    monkeypatch.setattr(store, "begin", late)
    with pytest.raises(Conflict):
        K.seed(store, fixtures)
    assert store.tables()["paper"].count() == 0 and [r.slug for r in store.tables()["topic"].collect()] == ["x"]


def test_gauges_and_health(spark, store):
    assert K.health(store) == {"status": "ok", "store": "ok"}
    K.seed(store, spark.createDataFrame(ROWS, K.FIXTURE))
    store.publish({"paper_embedding": spark.createDataFrame([(1, [1.0])], "paper_id long, embedding array<double>")})
    row = K.gauges(store.tables()).head()
    assert row.asDict() == {"papers": 3, "no_abstract": 1, "recoverable": 0, "no_vector": 2, "authors": 2, "topics": 2, "letters": 0}
    text = K.exposition(row, 1.5)
    assert "# TYPE folio_papers_total gauge\nfolio_papers_total 3\n" in text and text.startswith("# TYPE folio_uptime_seconds gauge\nfolio_uptime_seconds 1.500\n")
    assert K.exposition(None, 2) == "# TYPE folio_uptime_seconds gauge\nfolio_uptime_seconds 2.000\n"
    assert K.health(store)["status"] == "ok"
    lost = next(f for own in store.manifest()["tables"].values() for folders in own.values() for f in folders)
    store._fs.delete(store._path(lost), True)
    assert K.health(store)["status"] == "unhealthy" and "1 folders" in K.health(store)["store"]


def test_new_vectors_replace_old_ones(spark):
    kind = "paper_id long, embedding array<double>"
    old = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, None)], kind)
    new = spark.createDataFrame([(2, [9.0]), (4, [4.0]), (3, [3.0])], kind)
    assert sorted(map(tuple, U.with_vectors(old, new).collect())) == [(1, [1.0]), (2, [9.0]), (3, [3.0]), (4, [4.0])]


def test_waits_after_failures(spark):
    rows = spark.range(1, 12).select("id", U.retry_waits(F.col("id")).alias("w")).collect()
    assert all(r.w == U.retry_wait(r.id) for r in rows)
    waits = []

    def fails():
        raise ValueError

    U.scheduled(fails, waits.append, lambda: len(waits) == 3)
    assert all(b <= w <= b + U.JITTER for b, w in zip((600, 1200, 2400), waits)) and len(set(w % 1 for w in waits)) > 1
