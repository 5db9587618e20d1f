"""Copy-on-write buckets, runs in conflict, and recovery that asks once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_library import TOPICS, WORKS, work

from folio.operators import runs as U
from folio.operators.store import SCHEMAS, Conflict, Store

OPEN = {"least": 1, "most": 999}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def works(spark, *own):
    return spark.createDataFrame(list(own), WORKS)


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "store"), buckets=8)
    U.run_full(out, works(spark, *(work(k) for k in range(40))), TOPICS, "2024-01-02T00:00:00", provider=U.HashProvider(4), **OPEN)
    return out


def test_a_small_change_rewrites_one_bucket(spark, store):
    before, old = store.manifest(), {k: rows(v) for k, v in store.tables().items()}
    report = U.run_incremental(store, works(spark, work(7, title="Other", names=("a",))), TOPICS[:1], "2024-01-08T00:00:00", provider=U.HashProvider(4))
    after = store.manifest()
    changed = {name: [b for b in after["tables"][name] if after["tables"][name][b] != before["tables"][name].get(b)] for name in SCHEMAS if name in after["tables"]}
    assert {name: len(x) for name, x in changed.items()} == {"paper": 1, "author": 0, "topic": 0, "paper_author": 0, "paper_topic": 0, "paper_embedding": 1, "ingest_state": 1, "ingest_dlq": 0}
    assert (report.papers_updated, report.papers_in_db, report.fetched) == (1, 40, {"t1": 1})
    assert {k: rows(v) for k, v in store.tables(before["version"]).items()} == old  # readers of the old version see it as it was
    new = store.tables()["paper"]
    assert new.count() == 40 and new.where("title = 'Other'").count() == 1 and new.select("id").distinct().count() == 40


def test_of_two_runs_in_conflict_the_first_stays(spark, store):
    one, two = store.begin(), store.begin()
    paper = lambda title: spark.createDataFrame([(1, "W1", title, None, 2023, None, 0, None, None)], SCHEMAS["paper"])
    assert one.publish({"paper": paper("first")}, {}) == 2
    with pytest.raises(Conflict):
        two.publish({"paper": paper("second")}, {})
    two.abandon()
    assert [r.title for r in store.tables()["paper"].where("openalex_id = 'W1'").collect()] == ["first"] and store.tables()["paper"].count() == 40
    assert store.publish({"paper": paper("third")}) == 3


def test_a_manifest_that_exists_is_never_replaced(spark, store):
    """The other run's manifest appears after this one has looked: creating it must fail."""
    late = store.begin()
    store._numbers = lambda: [1]  # what it saw
    store.publish({"topic": spark.createDataFrame([("x", "X", "x")], SCHEMAS["topic"])})
    with pytest.raises(Conflict):
        late.publish({"topic": spark.createDataFrame([("y", "Y", "y")], SCHEMAS["topic"])}, {})
    del store._numbers
    assert store.versions() == [1, 2] and store.tables()["topic"].where("slug = 'y'").count() == 0


def test_a_run_that_fails_leaves_the_version_readable(spark, store):
    old = {k: rows(v) for k, v in store.tables().items()}

    class Broken:
        def embed(self, texts):
            return texts.select("paper_id", F.raise_error(F.lit("no model")).cast("array<double>").alias("embedding"))

    with pytest.raises(Exception, match="no model"):
        U.run_incremental(store, works(spark, work(7, title="Other")), TOPICS[:1], "2024-01-08T00:00:00", provider=Broken())
    assert store.versions() == [1] and {k: rows(v) for k, v in store.tables().items()} == old
    runs = store._fs.listStatus(store._path(f"{store.folder}/runs"))
    assert len(runs) == 1  # the failed run took its files along


def test_a_cut_off_manifest_does_not_count(spark, store):
    out = store._fs.create(store._path(f"{store.folder}/manifests/{2:09d}.json"), False)
    out.write(bytearray(b'{"buckets": 8, "tab'))
    out.close()
    assert store.versions() == [1] and store.tables()["paper"].count() == 40
    assert store.publish({"topic": spark.createDataFrame([("x", "X", "x")], SCHEMAS["topic"])}) == 3 and store.versions()[-1] == 3


def test_growing_tables_are_compacted_and_old_versions_go(spark, store):
    for k in range(20):
        store.publish({"topic": spark.createDataFrame([(f"s{k % 2}{k}", "X", "x"), ("same", str(k), "y")], SCHEMAS["topic"])})
    assert max(map(len, store.manifest()["tables"]["topic"].values())) <= 16 and store.tables()["topic"].count() == 2 + 40
    whole = {k: rows(v) for k, v in store.tables().items()}
    assert store.vacuum(keep=1) > 0 and {k: rows(v) for k, v in store.tables().items()} == whole and store.versions() == [21]


def test_each_paper_is_asked_for_once(spark, tmp_path):
    store, asked = Store(spark, str(tmp_path / "store"), buckets=4), spark.sparkContext.accumulator(0)

    def found(due):
        def one(parts):
            for part in parts:
                asked.add(len(part))
                part["abstract"] = [f"found {i}" for i in part["id"]]
                part["abstract_source"] = "crossref"
                yield part[["id", "abstract", "abstract_source"]]

        return due.select("id", "doi").mapInPandas(one, "id long, abstract string, abstract_source string")

    bare = [work(k, abstract_inverted_index=None) for k in range(5)] + [work(k) for k in range(5, 9)]
    report = U.run_full(store, works(spark, *bare), TOPICS, "2024-01-02T00:00:00", provider=U.HashProvider(4), found=found, **OPEN)
    assert asked.value == 5 and (report.recovered, report.abstracts_missing) == (5, 5)
    t = store.tables()
    text = t["paper"].where("abstract_source = 'crossref'").select(F.col("id").alias("paper_id"), F.concat_ws(" ", "title", "abstract").alias("text"))
    own = U.HashProvider(4).embed(text)
    assert text.count() == 5 and own.join(t["paper_embedding"].withColumnRenamed("embedding", "e"), "paper_id").where("embedding = e").count() == 5


def test_a_failing_source_is_reported_and_the_run_published(spark, store):
    def broken(due):
        return due.select("id", F.raise_error(F.lit("source is down")).cast("string").alias("abstract"), F.lit("x").alias("abstract_source"))

    report = U.run_incremental(store, works(spark, work(50, abstract_inverted_index=None)), TOPICS[:1], "2024-01-08T00:00:00", provider=U.HashProvider(4), found=broken)
    assert report.recovered == 0 and "source is down" in report.recovery_failed and report.papers_in_db == 41 == store.tables()["paper"].count()
