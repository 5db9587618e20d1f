"""Behaviour of search, ingest, readers, limits and metrics on small inputs."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as registry
from folio.functions import text as T
from folio.operators import ingest as I
from folio.operators import runs as U
from folio.operators import search as S
from folio.sources import readers as R
from folio.streaming import limits as L

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert 0 < len(rows) <= 20 and [(-r.publication_year, -r.id) for r in rows] == sorted((-r.publication_year, -r.id) for r in rows) or rows


@pytest.mark.parametrize("name", ["search_legacy", "search_combined", "filter_ids", "search_ranked", "rrf_fuse", "similar_papers", "upsert_papers", "touched_papers", "doi_resolve", "recover_waterfall", "backfill_abstracts", "dlq_replay", "abstract_rebuild", "history_mru", "date_ladder", "eval_relevance", "eval_scorecard", "eval_degrade", "ingest_full", "ingest_incremental", "rate_limit", "qrels_load", "html_abstract", "url_guard", "arxiv_id", "normalize_work", "watermark_backfill"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "supplier", "events", "pages", "region"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = registry.queries()[name](spark, SF)
    result = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert clean(frame.select(*names).collect()) == clean(result.fetchall())


def test_requests():
    assert S.parse_ids(None) is None and S.parse_ids("") == [] and S.parse_ids(" 3,x,1,3 ,") == [3, 1] and len(S.parse_ids(",".join(map(str, range(300))))) == 100
    for bad in (S.Request(mode="ranked"), S.Request(mode="hybrid", q=""), S.Request(page=0), S.Request(page_size=101), S.Request(q="x" * 201), S.Request(mode="other")):
        with pytest.raises(ValueError):
            bad.validate()
    assert T.escape_like("5%_\\") == "5\\%\\_\\\\"


def test_rate_limit(spark):
    log, waits = [], []
    for now in (0, 1, 2, 30, 60.5, 61.5):
        log, wait = L.admit(log, now, 2)
        waits.append(wait)
    assert waits == [None, None, 58, 30, None, None] and L.admit([], 5, 0) == ([], None)
    hits = spark.createDataFrame([("a", k, float(t)) for k, t in enumerate((0, 1, 2, 61))] + [("b", 9, 2.0)], "key string, hit long, ts double")
    assert sorted((r.hit, r.admitted) for r in L.rate_limited(hits, 2).collect()) == [(0, True), (1, True), (2, False), (3, True), (9, True)]


def test_readers(spark, tmp_path):
    assert R.retry_after({"Retry-After": "7"}) == 7 and R.retry_after({"retry-after": "9999"}) == 60 and R.retry_after({}) is None and R.retry_after({"Retry-After": "x"}) is None
    assert R.backoff(2, None, jitter=0) == 4 and R.backoff(0, 9, jitter=0) == 9 and R.backoff(9, 50) == 30 and 1 <= R.backoff(0, None) <= 2
    assert R.retry_after({"Retry-After": "Thu, 01 Jan 1970 00:00:30"}, now=10) == 20 and R.retryable(TimeoutError()) and not R.retryable(ValueError())
    calls, slept = [], []

    def get(path, params):
        calls.append(params["cursor"])
        if len(calls) == 1:
            return 503, {"Retry-After": "3"}, ""
        return 200, {}, '{"meta": {"next_cursor": "n"}, "results": [{"id": 1}, {"id": 2}]}'

    assert len(list(R.pages(get, "/works", {}, 3, slept.append))) == 3 and calls == ["*", "*", "n"] and 3 <= slept[0] <= 4 and slept[1] == 0.5
    with pytest.raises(ValueError):
        R.fetch(lambda p, q: (404, {}, ""), "/x", {}, slept.append)
    blocked = ["", None, "ftp://a.b/", "http://localhost/x", "http://127.0.0.1/", "https://10.0.0.8/", "http://[::1]/", "http://169.254.1.1/", "10.1/abc"]
    assert all(map(R.is_private_url, blocked)) and not any(map(R.is_private_url, ["https://doi.org/10.1/x", "http://8.8.8.8/", "http://printer.local/"]))
    long = "words " * 20
    assert R.abstract_of_html('<meta name="citation_abstract" content=" a  b ">') is None and R.abstract_of_html(f'<meta property="og:description" content=" {long}">') == long.strip()
    assert R.abstract_of_html(f'<meta name="description" content="{"x" * 99}"><section class="abstract">{"y" * 79}</section>') is None and R.abstract_of_html(f'<section class="abstract">{"y" * 80}</section>') == "y" * 80
    assert R.abstract_of_html(f'<section class="abstract">{long}</section><div class="abstract">{"z" * 50}</div><span id="Abs1-content">short</span>') == "z" * 50
    assert R.abstract_of_html(f'<div class="abstract author"><p>{long}</p></div><div>tail</div>') == long.strip()
    assert R.abstract_of_html("<p>none") is None and R.abstract_of_html(None) is None
    assert R.summary_of_feed('<feed xmlns="http://www.w3.org/2005/Atom"><entry><summary> s </summary></entry></feed>') == "s" and R.summary_of_feed("<broken") is None
    (tmp_path / "q.jsonl").write_text('{"qid": "a", "q": "x", "relevant_substrings": ["y"]}\n\nbroken\n{"qid": "b"}\n')
    assert [r.qid for r in R.read_qrels(spark, str(tmp_path / "q.jsonl")).collect()] == ["a"]


def test_text(spark):
    index = {"world": [1], "hello": [0, 2], "late": [1]}
    df = spark.createDataFrame([(index,), ({},), (None,)], "i map<string,array<int>>")
    got = [r[0] for r in df.select(T.rebuilt_abstract(df.i)).collect()]
    assert got[0] in ("hello late hello", "hello world hello") and got[1:] == [None, None]
    one = spark.createDataFrame([("  a  \n b ", "10.1007/x", ["arXiv.org/pdf/2101.00001", "arXiv.org/abs/2101.00001v2"], "https://doi.org/10.48550/ARXIV.2202.12345")], "a string, d string, u array<string>, e string")
    assert one.select(T.collapse(one.a), T.doi_source(one.d), T.arxiv_id(one.d, one.u), T.arxiv_id(one.e, one.u)).collect()[0] == ("a b", "springer", "2101.00001v2", "2202.12345")
    assert T.vector_literal([1.0, 1e-7, -0.123456789]) == "[1,1e-07,-0.1234568]"
    import hashlib

    vector = one.select(T.hash_vector(one.d, 40).alias("v")).collect()[0].v
    raw = hashlib.sha256(b"10.1007/x#0").digest() + hashlib.sha256(b"10.1007/x#1").digest()
    assert vector == pytest.approx([b / 255 * 2 - 1 for b in raw[:40]])


def test_rebuild_of_a_long_text(spark):
    """One sort a row: a text of 20,000 words takes seconds, not hours."""
    words = [f"w{k}" for k in range(20_000)]
    row = spark.createDataFrame([({w: [k] for k, w in enumerate(words)},)], "i map<string,array<int>>")
    assert row.select(T.rebuilt_abstract(row.i)).collect()[0][0] == " ".join(words)


def test_scorecard(spark):
    from folio.operators import evaluate as E

    card = spark.createDataFrame([("ranked", 0.625, 0.62, 0.53, 7), ("legacy", 0.41, 0.47, 0.29, 5)], "mode string, mrr double, ndcg double, recall double, wins int")
    assert E.markdown(card).splitlines()[2:] == ["| legacy | 0.410 | 0.470 | 0.290 | 5 |", "| ranked | 0.625 | 0.620 | 0.530 | 7 |"]
    assert E.passes(card, "mrr", 0.6) and not E.passes(card, "mrr", 0.7) and E.passes(card, "mrr", None)


def test_guard_and_idempotence(spark):
    with pytest.raises(ValueError):
        I.guard(299)
    I.guard(300)
    twice = spark.createDataFrame([("W1", "a", None, 2020, None, 1), ("W1", "b", None, 2020, None, 1)], "openalex_id string, title string, abstract string, publication_year int, doi string, cited_by_count long")
    assert [r.title for r in I.upserted(twice.limit(0), twice).collect()] == ["a"]
    assert (I.boot_action(0), I.boot_action(3)) == ("ingest", "skip")
    cols = "openalex_id string, title string, abstract string, publication_year int, doi string, cited_by_count long"
    old = spark.createDataFrame([("W1", "a", None, 2020, None, 1)], cols)
    new = spark.createDataFrame([("W1", "a", None, 2021, "d", 9), ("W2", "b", "x", 2020, None, 0)], cols)
    assert [r.openalex_id for r in I.touched(old, new).collect()] == ["W2"]
    once = I.upserted(old, new).drop("action")
    again = I.upserted(once, new)
    assert again.where("action <> 'updated'").count() == 0 and again.drop("action").exceptAll(once).count() == 0 and I.touched(once, new).count() == 0


def test_ingest_stream(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").write.json(source)
    stream = spark.readStream.schema("id long, t string").json(source)
    for _ in range(2):
        L.ingest_stream(stream, lambda batch, n: seen.extend(r.id for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [1, 2]


WORKS = "id string, topic string, display_name string, publication_year int, publication_date string, updated_date string, cited_by_count long, doi string, landing_pages array<string>, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<id:string,display_name:string>>>, ord long"
TOPICS = [("t1", "T1", "first"), ("t2", "T2", "second")]


def work(k, topic="t1", title=None, updated="2024-01-05", names=("a", "b"), **more):
    own = {"id": f"https://x/W{k}", "topic": topic, "display_name": title or f" Title {k} ", "publication_year": 2023, "publication_date": "2023-05-01", "updated_date": updated, "cited_by_count": k, "doi": f"https://doi.org/10.1/{k}", "landing_pages": [], "abstract_inverted_index": {"some": [0], f"text{k}": [1]}, "authorships": [{"author": {"id": f"https://x/A{n}" if n else "https://x/", "display_name": f" Name {n}{k}"}} for n in names], "ord": k}
    return own | more


def test_full_and_incremental_runs(spark, tmp_path):
    store = U.Store(spark, str(tmp_path / "store"))
    make = lambda rows: spark.createDataFrame(rows, WORKS)
    first = [work(k) for k in range(8)] + [work(0, "t2"), work(9, "t2", title="  "), work(10, "t2", publication_year=None, publication_date="n.d."), work(11, names=("", "a"))]
    with pytest.raises(ValueError):
        U.run_incremental(store, make(first), TOPICS, "2024-01-01T00:00:00")
    with pytest.raises(ValueError):
        U.run_full(store, make(first), TOPICS, "2024-01-02T00:00:00")
    assert store.versions() == []  # too small a corpus publishes nothing
    limits = {"least": 1, "most": 99, "provider": U.HashProvider(8)}
    status = spark.createDataFrame([("https://doi.org/10.1/3", 404), ("https://doi.org/10.1/4", 200)], "url string, status int")
    one = U.run_full(store, make(first), TOPICS, "2024-01-02T00:00:00", url_status=status, **limits)
    assert (one.papers, one.papers_new, one.papers_updated, one.embedded, one.papers_in_db, one.dois_dropped) == (8, 8, 0, 8, 8, 1)
    t = store.tables()
    assert sorted(r.id for r in t["paper"].collect()) == list(range(1, 9)) and t["paper"].where("title = 'Title 5' and abstract = 'some text5'").count() == 1
    assert sorted((r.openalex_id, r.name) for r in t["author"].collect()) == [("Aa", "Name a0"), ("Ab", "Name b0")] and one.relations == 8 + 7 + 9
    assert sorted(r.reason for r in t["ingest_dlq"].collect()) == ["normalize_skip", "normalize_skip", "unresolvable_doi"]
    assert {(r.topic, r.last_incremental_at) for r in t["ingest_state"].collect()} == {("t1", "2024-01-02T00:00:00"), ("t2", "2024-01-02T00:00:00")}
    assert U.run_full(store, make(first), TOPICS, "2024-01-03T00:00:00", only_if_empty=True).papers_in_db == 8 and store.versions() == [1]
    again = U.run_full(store, make(first), TOPICS, "2024-01-03T00:00:00", url_status=status, **limits)
    assert (again.papers_new, again.papers_updated, again.embedded, again.relations, again.papers_in_db) == (0, 8, 0, 0, 8)
    before = {r.paper_id: r.embedding for r in store.tables()["paper_embedding"].collect()}
    ids = {r.openalex_id: r.id for r in store.tables()["paper"].collect()}
    later = [work(1, title="Changed"), work(2, cited_by_count=99), work(20, updated="2024-01-03"), work(21, updated="2024-01-02")]
    none = U.run_incremental(store, make([work(5, updated="2023-12-31")]), TOPICS, "2024-01-03T12:00:00")
    assert (none.papers, none.papers_in_db) == (0, 8) and {r.last_incremental_at for r in store.tables()["ingest_state"].collect()} == {"2024-01-03T12:00:00"}
    some = U.run_incremental(store, make(later), TOPICS, "2024-01-06T00:00:00", provider=U.HashProvider(8), found=lambda due: due.select("id", "doi").where("false").selectExpr("id", "doi as abstract", "doi as abstract_source"))
    assert (some.papers, some.papers_new, some.papers_updated, some.touched, some.papers_in_db, some.recovered) == (3, 1, 2, 2, 9, 0)
    after = {r.paper_id: r.embedding for r in store.tables()["paper_embedding"].collect()}
    assert {i for i in after if after[i] != before.get(i)} == {ids["W1"], 9} and len(after) == 9
    assert U.run_incremental(store, make(later), TOPICS, "2024-01-07T00:00:00", since="2024-01-02", per_topic=1).papers == 1


def test_recovery_and_sources(spark):
    papers = spark.createDataFrame([(1, "10.1007/a", None), (2, "https://doi.org/10.48550/arXiv.2101.00001", None), (3, "10.2/c", "has"), (4, None, None), (5, "10.3/e", None)], "id long, doi string, abstract string").selectExpr("id", "doi", "abstract", "cast(null as string) abstract_source", "cast(null as string) abstract_recovered_at")

    def get(path, params):
        if path.endswith("works/10.1007/a"):
            return 200, {}, '{"message": {"abstract": "<p>From  crossref</p>"}}'
        if "2101.00001" in path:
            return 200, {}, '<feed xmlns="http://www.w3.org/2005/Atom"><entry><summary> of the feed </summary></entry></feed>'
        return (200, {}, f'<div id="abstracts">{"page " * 20}</div>') if path == "https://doi.org/10.3/e" else (404, {}, "")

    after, got = U.recover_abstracts(papers, lambda due: R.recovered_abstracts(due, get), "2024-01-01")
    rows = {r.id: r for r in after.collect()}
    assert {k: rows[k].abstract_source for k in rows} == {1: "crossref", 2: "arxiv", 3: None, 4: None, 5: "html_generic"} and rows[1].abstract == "From  crossref" and rows[3].abstract == "has"
    assert sorted(r.id for r in got.collect()) == [1, 2, 5] and rows[5].abstract_recovered_at == "2024-01-01" and rows[3].abstract_recovered_at is None
    assert {r.url: r.state for r in R.probed(spark.createDataFrame([("https://a.b/x",), ("http://10.0.0.1/",), ("https://doi.org/10.3/e",), (None,)], "url string"), get).collect()} == {"https://a.b/x": "dead", "http://10.0.0.1/": "unknown", "https://doi.org/10.3/e": "ok"}
    page = '{"meta": {}, "results": [{"id": "https://x/W1", "display_name": "t", "cited_by_count": 3, "locations": [{"landing_page_url": "https://l"}]}]}'
    found = R.works(spark, lambda path, params: (200, {}, page), "T1", "2023-01-01", 5).collect()
    assert [(r.id, r.cited_by_count, r.landing_pages, r.ord) for r in found] == [("https://x/W1", 3, ["https://l"], 0)]


def test_providers_and_schedule(spark):
    def model(texts):
        if len(texts) > 2 or "bad" in texts:
            raise ValueError("ragged")
        return [[float(len(t))] for t in texts]

    assert U.bisected(model, []) == [] and U.bisected(model, ["a", "bb", "ccc", "dddd", "e"]) == [[1.0], [2.0], [3.0], [4.0], [1.0]]
    with pytest.raises(ValueError):
        U.bisected(model, ["a", "bad", "c"])
    papers = spark.createDataFrame([(1, " a ", None), (2, "", " "), (3, None, "xyz")], "id long, title string, abstract string")
    assert sorted((r.paper_id, r.embedding) for r in U.embedded(papers, U.ModelProvider(lambda: model)).collect()) == [(1, [1.0]), (3, [3.0])]
    waits, outcomes = [], iter([1, 0, 0, 1])

    def run():
        if not next(outcomes):
            raise RuntimeError

    assert U.scheduled(run, waits.append, lambda: len(waits) == 4, jitter=lambda: 0.0) == 2 and waits == [86_400, 600, 1200, 86_400] and U.retry_wait(9) == 3600


def test_metrics_of_empty_results(spark):
    from folio.operators import evaluate as E

    qrels = (("a", "x", ("x",)), ("b", "y", ("y",)))
    judged = spark.createDataFrame([("a", "legacy", 1, 7, "x", 1)], "qid string, mode string, rank int, id long, title string, rel int")
    card = {r["mode"]: r for r in E.scorecard(E.per_query(judged, qrels)).collect()}
    assert (card["legacy"].mrr, card["legacy"].wins, card["ranked"].mrr, card["ranked"].wins) == (0.5, 2, 0.0, 1)
    assert {r.qid: r.degraded for r in E.degraded(judged, qrels).collect()} == {"a": False, "b": True}


def test_hybrid_without_a_vector(spark):
    from folio.plans.corpus import Corpus

    def broken(q, dim):
        raise RuntimeError("no model")

    c = Corpus(spark, SF)
    rows = S.hybrid_list(c, S.Request(q="with", mode="hybrid"), embed=broken).collect()
    assert rows and all(r.dense_rank is None and r["rank"] == r.sparse_rank for r in rows)
