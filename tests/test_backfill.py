"""Backfill in keyed batches: each paper asked for once, restarts, conflicts, failing sources, empty batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folio.operators import backfill as B
from folio.operators import runs as U
from folio.operators.store import SCHEMAS, Store

NOW = "2024-01-02T00:00:00"


def paper(k, abstract=None, doi=True):
    return (k, f"W{k}", f"Title {k}", abstract, 2020, f"https://doi.org/10.1/{k}" if doi else None, 0, None, None)


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "store"), buckets=4)
    rows = [paper(7), paper(1), paper(30), paper(12), paper(9), paper(5, "has one"), paper(6, doi=False)]
    out.publish({"paper": spark.createDataFrame(rows, SCHEMAS["paper"])}, {"last_id": 30, "papers": 7})
    return out


def source(spark, has=lambda i: True):
    asked = spark.sparkContext.accumulator(0)

    def found(part):
        def one(batches):
            for some in batches:
                asked.add(len(some))
                some["abstract"] = [f"found {i}" if has(i) else None for i in some["id"]]
                some["abstract_source"] = "crossref"
                yield some[["id", "abstract", "abstract_source"]]

        return part.select("id").mapInPandas(one, "id long, abstract string, abstract_source string")

    return found, asked


def ledger(store):
    return {r.paper_id: (r.batch, r.state, r.attempts) for r in store.tables()["attempt"].collect()}


def abstracts(store):
    return {r.id: r.abstract for r in store.tables()["paper"].collect()}


def test_places_follow_the_key(spark, tmp_path):
    def keep(rows):
        rows.write.parquet(str(tmp_path / "ranges"))
        return spark.read.parquet(str(tmp_path / "ranges"))

    rows = spark.createDataFrame([(k * 37 % 1009, "x") for k in range(1009)], "id long, v string").repartition(5)
    assert {r.id: r.place for r in B.placed(rows, "id", keep).collect()} == {k: k for k in range(1009)}


def test_each_paper_is_asked_for_once_in_the_order_of_ids(spark, store):
    found, asked = source(spark, lambda i: i != 9)
    report = B.Backfill(store, B.Abstracts(found, NOW, U.HashProvider(4)), "r", size=2).run()
    assert asked.value == 5 and (report.attempted, report.done, report.failed, report.batches, report.left) == (5, 4, 0, 3, 0)
    assert ledger(store) == {1: (0, "done", 1), 7: (0, "done", 1), 9: (1, "none", 1), 12: (1, "done", 1), 30: (2, "done", 1)}
    assert abstracts(store) == {5: "has one", 6: None, 9: None} | {k: f"found {k}" for k in (1, 7, 12, 30)}
    t = store.tables()
    assert {r.abstract_recovered_at for r in t["paper"].where("abstract_source = 'crossref'").collect()} == {NOW}
    assert sorted(r.paper_id for r in t["paper_embedding"].collect()) == [1, 7, 12, 30]
    again = B.Backfill(store, B.Abstracts(found, NOW), "r", size=3).run()  # the claim stays as it was
    assert asked.value == 5 and (again.batches, again.attempted) == (0, 5)


def test_a_restart_goes_on_where_the_run_ended(spark, store, monkeypatch):
    found, asked = source(spark)
    job = lambda: B.Backfill(store, B.Abstracts(found, NOW), "r", size=2)
    assert job().run(most_batches=1).left == 3 and asked.value == 2
    publish = B.Attempt.publish

    def killed(self, *rest):
        raise KeyboardInterrupt

    monkeypatch.setattr(B.Attempt, "publish", killed)
    with pytest.raises(KeyboardInterrupt):  # the second batch's answers are stored, its version is not
        job().run()
    monkeypatch.setattr(B.Attempt, "publish", publish)
    assert asked.value == 4 and sum(v is None for v in abstracts(store).values()) == 4
    assert job().run().done == 5 and asked.value == 5
    assert [v for v in ledger(store).values() if v[1:] != ("done", 1)] == []


def test_another_run_in_between_costs_no_second_question(spark, store, monkeypatch):
    found, asked = source(spark)
    publish, others = B.Attempt.publish, []

    def late(self, changes, facts):
        if not others:
            others.append(1)
            mine = spark.createDataFrame([paper(1, "theirs")], SCHEMAS["paper"])
            publish(store.begin(), {"paper": mine}, {})
        return publish(self, changes, facts)

    monkeypatch.setattr(B.Attempt, "publish", late)
    report = B.Backfill(store, B.Abstracts(found, NOW), "r", size=2).run()
    assert asked.value == 5 and report.done == 4 and abstracts(store)[1] == "theirs" and ledger(store)[1] == (0, "none", 1)


def test_two_empty_batches_end_a_run(spark, store):
    found, asked = source(spark, lambda i: i == 30)
    report = B.Backfill(store, B.Abstracts(found, NOW), "r", size=1).run()
    assert asked.value == 2 and (report.batches, report.done, report.left) == (2, 0, 3)
    more = B.Backfill(store, B.Abstracts(found, NOW), "s", size=2, most_attempts=1).run()  # a new run, without those two
    assert asked.value == 5 and (more.attempted, more.done) == (3, 1)
    assert B.Backfill(store, B.Abstracts(found, NOW), "t", limit=3).run().attempted == 3 and ledger(store)[1] == (0, "none", 2)


def test_a_failing_source_costs_its_batch(spark, store):
    def found(part):
        wrong = F.when(F.col("id") == 7, F.raise_error(F.lit("source is down")).cast("string"))
        return part.select("id", F.coalesce(wrong, F.lit("text")).alias("abstract"), F.lit("x").alias("abstract_source"))

    report = B.Backfill(store, B.Abstracts(found, NOW), "r", size=2).run()
    assert (report.attempted, report.done, report.failed) == (5, 3, 2) and "source is down" in report.error
    assert {k for k, v in ledger(store).items() if v[1] == "failed"} == {1, 7}
    found, asked = source(spark)
    assert B.Backfill(store, B.Abstracts(found, NOW), "s").run().done == 2 and asked.value == 2


def test_vectors_of_all_papers_with_text(spark, store):
    report = B.Backfill(store, B.Vectors(U.HashProvider(4)), "v", size=3, limit=None).run(most_empty=None)
    t = store.tables()
    assert (report.attempted, report.done, report.batches) == (7, 7, 3) and t["paper_embedding"].count() == 7
    assert B.Backfill(store, B.Vectors(U.HashProvider(4)), "w").run().attempted == 0


def test_gaps_and_an_empty_store(spark, store, tmp_path):
    got = {(r.kind, r.abstract_source): r.n for r in B.gaps(store.tables()["paper"]).collect()}
    assert got == {("source", None): 1, ("missing", None): 6, ("recoverable", None): 5}
    found, asked = source(spark)
    bare = Store(spark, str(tmp_path / "bare"))
    assert B.Backfill(bare, B.Abstracts(found, NOW), "r").run().attempted == 0 and asked.value == 0
