"""Timed operators, the works source and streaming ingest against their batch forms."""

from __future__ import annotations

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_library import TOPICS, work

from folio.operators import runs as U
from folio.operators.store import Store
from folio.sources import works as W
from folio.streaming import limits as L

RNG = np.random.default_rng(9)
EVENTS = "key string, row long, at timestamp"


@pytest.fixture
def arrivals(spark, tmp_path):
    """Events of few keys in files, out of order by less than 8 seconds, and a last file that moves the watermark on."""
    times = np.cumsum(RNG.exponential(1.7, 240)).round(3).tolist()
    rows = [(str(RNG.choice(["a", "a", "b", "c"])), k, t) for k, t in enumerate(times)]
    late = sorted(rows, key=lambda r: r[2] + RNG.uniform(0, 8))
    folder = str(tmp_path / "in")
    parts = [late[k : k + 40] for k in range(0, 240, 40)] + [[("end", 999, times[-1] + 900)], [("end", 1000, times[-1] + 2000)]]
    for n, part in enumerate(parts):
        rows_of = spark.createDataFrame(part, "key string, row long, ts double").select("key", "row", F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("at"))
        rows_of.coalesce(1).write.mode("append").json(folder)
        import time

        time.sleep(0.01 * (n + 1))
    return rows, spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(folder)


def drained(spark, df, folder, name):
    out = []
    query = df.writeStream.foreachBatch(lambda batch, n: out.extend(batch.collect())).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return out, query


def test_rate_limit_of_a_shuffled_stream_equals_the_batch(spark, arrivals, tmp_path):
    rows, stream = arrivals
    got, query = drained(spark, L.rate_limited_stream(stream.withColumnRenamed("row", "hit"), 5, window=20.0), tmp_path, "rate")
    batch = {}
    for key in "abc":
        log = []
        for _, k, ts in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            log, wait = L.admit(log, ts, 5, 20.0)
            batch[k] = (key, wait is None, None if wait is None else round(wait, 3))
    assert {r.hit: (r.key, r.admitted, None if r.retry_after is None or np.isnan(r.retry_after) else round(r.retry_after, 3)) for r in got if r.key != "end"} == batch
    assert 0 < sum(x[1] for x in batch.values()) < len(batch)
    # keys that have been idle for a window have no state left
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_debounce_of_a_shuffled_stream_equals_the_batch(spark, arrivals, tmp_path):
    rows, stream = arrivals
    got, _ = drained(spark, L.debounced_stream(stream, 2500), tmp_path, "quiet")
    table = spark.createDataFrame(rows, "key string, event_id long, ts double").withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    want = {r.event_id for r in L.debounced(table, "key", "at", 2500).collect()}
    assert {r.row for r in got if r.key != "end"} == want and 0 < len(want) < len(rows)


WORKS = [work(k, topic="", updated=f"2024-01-{1 + k % 20:02d}") | {"publication_date": f"2023-{1 + k % 12:02d}-{1 + k % 27:02d}", "cited_by_count": (k * 7) % 50} for k in range(90)]


def server():
    """The server as a closure, which tasks get by value."""

    def upstream(path, params):
        """A paged server over WORKS, which honours filters, order and cursor."""
        kind, low, high = re.search(r"from_(\w+)_date:([^,]+)(?:,to_\w+_date:(.+))?", params["filter"]).groups()
        topic = re.search(r"topics.id:([^,]+)", params["filter"])[1]
        own = [w for w in WORKS if low <= w[f"{kind}_date"] <= (high or "9999") and (topic == "T1" or int(w["id"].rsplit("W")[1]) % 2 == 0)]
        field = params["sort"].split(":")[0]
        own.sort(key=lambda w: (w[field], w["publication_date"] if field == "cited_by_count" else ""), reverse=True)
        at = 0 if params["cursor"] == "*" else int(params["cursor"])
        more = at + 7 < len(own)
        return 200, {}, json.dumps({"meta": {"next_cursor": str(at + 7) if more else None}, "results": [w | {"locations": [{"landing_page_url": "https://l"}]} for w in own[at : at + 7]]})

    return upstream


upstream = server()


@pytest.mark.parametrize("most", [5, 40, 1000])
@pytest.mark.parametrize("updated", [False, True])
def test_sliced_reading_equals_one_cursor(spark, most, updated):
    topics = [("t1", "T1"), ("t2", "T2")]
    args = ("2024-01-03", "2024-01-31") if updated else ("2023-02-10", "2023-12-31")
    got = W.read_works(spark, upstream, topics, *args, most, updated, days=4 if updated else 45, sleep=lambda s: None)
    assert got.rdd.getNumPartitions() > 0 and len(W.slices("t", *args, 45)) * 2 >= 2
    for slug, upstream_id in topics:
        one = W.records(upstream, W.Slice(slug, 0, *args), {slug: upstream_id}, most, updated, lambda s: None)
        want = [json.loads(line) for *_, line in one]
        own = sorted(got.where(F.col("topic") == slug).collect(), key=lambda r: r.ord)
        field = "updated_date" if updated else "cited_by_count"
        assert [r.ord for r in own] == list(range(len(want))) and [r[field] for r in own] == [w[field] for w in want]
        edge = want[-1][field] if want else None
        assert {r.id for r in own if r[field] != edge} == {w["id"] for w in want if w[field] != edge}
        assert all(r.landing_pages == ["https://l"] for r in own)


def test_days_are_cut_without_gap_or_overlap():
    parts = W.slices("t", "2024-02-27", "2024-03-10", 5)
    assert [(p.since, p.until) for p in parts] == [("2024-03-06", "2024-03-10"), ("2024-03-01", "2024-03-05"), ("2024-02-27", "2024-02-29")] and W.slices("t", "2024-01-02", "2024-01-01", 3) == []


def test_a_killed_stream_gives_the_store_of_one_run(spark, tmp_path):
    topics = [(slug, upstream_id) for slug, upstream_id, _ in TOPICS]
    tables = {}
    for name, days in (("whole", ["2024-01-21"]), ("killed", ["2024-01-08", "2024-01-15", "2024-01-21"])):
        store = Store(spark, str(tmp_path / name), buckets=2)
        for n, day in enumerate(days):
            stream = W.stream_works(spark, upstream, topics, "2024-01-01", lambda d=day: d, days=3, sleep=lambda s: None, name=f"works_{name}_{n}")
            publish, own = store.begin, str(tmp_path / f"{name}-checkpoint")

            def begin(publish=publish):
                attempt = publish()
                real = attempt.publish

                def and_die(*x):
                    real(*x)
                    raise RuntimeError("killed after publishing, before the batch is committed")

                attempt.publish = and_die
                attempt.abandon = lambda: None
                return attempt

            if name == "killed" and n == 1:
                store.begin = begin
                with pytest.raises(Exception, match="killed"):
                    L.ingest_into(store, stream, TOPICS, own, provider=U.HashProvider(4)).awaitTermination()
                del store.begin
            L.ingest_into(store, stream, TOPICS, own, provider=U.HashProvider(4)).awaitTermination()
        t = store.tables()
        ids = t["paper"].select(F.col("id").alias("paper_id"), F.col("openalex_id").alias("o"))
        tables[name] = [sorted(map(tuple, x.collect()), key=repr) for x in (t["paper"].drop("id"), t["author"], t["paper_author"], t["paper_topic"], t["ingest_state"], t["paper_embedding"].join(ids, "paper_id").select("o", "embedding"))]
        assert store.manifest()["facts"]["papers"] == t["paper"].count() == 90
    assert len(store.versions()) == 3 and tables["whole"] == tables["killed"]
