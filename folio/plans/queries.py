"""Registered queries over the bibliographic views, each with the same result as SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import backfill as B
from folio.operators import evaluate as E
from folio.operators import grams as G
from folio.operators import index as X
from folio.operators import ingest as I
from folio.operators import runs as U
from folio.operators import search as S
from folio.operators import upkeep as K
from folio.operators import vectors as V
from folio.operators.store import Store
from folio.plans.corpus import Corpus, with_views
from folio.sources import polite as P
from folio.sources import readers as R
from folio.streaming import limits as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(corpus)`` under ``name``, with its SQL over the views."""

    def add(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- search ----
AUTHORS = "coalesce((SELECT string_agg(a.name, '|' ORDER BY a.name) FROM paper_author pa JOIN author a ON a.id = pa.author_id WHERE pa.paper_id = p.id), '') AS authors"
LIKE = "(title ILIKE '%{t}%' ESCAPE '\\' OR coalesce(abstract ILIKE '%{t}%' ESCAPE '\\', false))"
Q = "this from"
BOTH = " AND ".join(LIKE.format(t=t) for t in Q.split())


def listing(where: str, order: str = "publication_year DESC, id DESC", size: int = 20, skip: int = 0) -> str:
    return with_views(f"SELECT p.id, title, publication_year, {AUTHORS} FROM (SELECT * FROM paper WHERE {where} ORDER BY {order} LIMIT {size} OFFSET {skip}) p")


def listed(name: str, where: str, request: S.Request, skip: int = 0) -> None:
    query(name, listing(where, size=request.page_size, skip=skip))(lambda c: S.page(c, request))


BY_AUTHOR = "EXISTS (SELECT 1 FROM paper_author pa JOIN author a ON a.id = pa.author_id WHERE pa.paper_id = paper.id AND a.name ILIKE '%{}%')"
BY_TOPIC = "EXISTS (SELECT 1 FROM paper_topic t WHERE t.paper_id = paper.id AND t.slug = '{}')"
listed("search_legacy", BOTH, S.Request(q=Q))
listed("search_legacy_page2", BOTH, S.Request(q=Q, page=2), 20)
listed("filter_year", "publication_year = 2020", S.Request(year=2020))
listed("filter_topic", BY_TOPIC.format("de"), S.Request(topic="de"))
listed("filter_author", BY_AUTHOR.format("00001"), S.Request(author="00001"))
listed("filter_ids", "id IN (3, 5, 8, 40)", S.Request(ids="5, 3,x,8,3, 40 ,999999999"))
listed("search_combined", f"{LIKE.format(t='the')} AND publication_year = 2019 AND {BY_TOPIC.format('en')} AND {BY_AUTHOR.format('0')}", S.Request(q="the", year=2019, topic="en", author="0"))
query("search_total", with_views(f"SELECT count(*) AS total FROM paper WHERE {BOTH}"))(lambda c: S.total(c, S.Request(q=Q)))


@query("search_like_escape", with_views(f"SELECT '%' AS q, count(*) AS total FROM paper WHERE {LIKE.format(t=chr(92) + '%')} UNION ALL SELECT '_', count(*) FROM paper WHERE {LIKE.format(t=chr(92) + '_')}"))
def _(c):
    one = lambda q: S.total(c, S.Request(q=q)).select(F.lit(q).alias("q"), "total")
    return one("%").union(one("_"))


query("hydrate_authors", with_views(f"SELECT id, {AUTHORS} FROM paper p"))(lambda c: S.with_authors(c, c.paper.select("id")))
query("paper_detail", with_views(f"SELECT p.id, openalex_id, title, abstract, publication_year, doi, cited_by_count, {AUTHORS}, (SELECT string_agg(slug, '|' ORDER BY slug) FROM paper_topic t WHERE t.paper_id = p.id) AS topics FROM paper p WHERE id = 12"))(lambda c: S.detail(c, 12))


def bm25_ctes(q: str) -> list[str]:
    """CTEs tok, st and score: BM25 of every matching paper."""
    terms = ", ".join(f"'{t}'" for t in S.query_terms(q))
    return [
        r"tok AS (SELECT id, publication_year, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS t1, regexp_extract_all(lower(coalesce(abstract, '')), '[\p{L}\p{N}]+') AS t2 FROM paper)",
        f"term AS (SELECT unnest([{terms}]) AS w)",
        "st AS (SELECT w, count(*)::DOUBLE AS n, avg(len(t1)) AS a1, avg(len(t2)) AS a2, count(*) FILTER (list_contains(t1, w)) AS d1, count(*) FILTER (list_contains(t2, w)) AS d2 FROM tok, term GROUP BY w)",
        """part AS (SELECT id, publication_year, w, len(list_filter(t1, lambda x: x = w))::DOUBLE AS f1, len(list_filter(t2, lambda x: x = w))::DOUBLE AS f2, len(t1) AS l1, len(t2) AS l2, st.* EXCLUDE (w)
            FROM tok, st WHERE list_contains(t1, w) OR list_contains(t2, w))""",
        """score AS (SELECT id, publication_year, round(sum(ln(1 + (n - d1 + 0.5e0) / (d1 + 0.5e0)) * f1 * 2.2e0 / (f1 + 1.2e0 * (0.25e0 + 0.75e0 * l1 / a1))
            + ln(1 + (n - d2 + 0.5e0) / (d2 + 0.5e0)) * f2 * 2.2e0 / (f2 + 1.2e0 * (0.25e0 + 0.75e0 * l2 / a2))), 6) AS score FROM part GROUP BY id, publication_year)""",
    ]


RANKED, HYBRID = S.Request(q=Q, mode="ranked"), S.Request(q=Q, mode="hybrid")


@query("search_ranked", with_views("SELECT id, publication_year, score FROM score ORDER BY score DESC, publication_year DESC, id DESC LIMIT 20", *bm25_ctes(Q)))
def _(c):
    return S.matches(c, RANKED).orderBy(F.desc("score"), F.desc("publication_year"), F.desc("id")).limit(20).select("id", "publication_year", "score")


query("search_ranked_total", with_views("SELECT count(*) AS total FROM score", *bm25_ctes(Q)))(lambda c: S.total(c, RANKED))
query("search_sparse", with_views("SELECT id, score FROM score ORDER BY score DESC, id LIMIT 100", *bm25_ctes(Q)))(lambda c: S.bm25_scores(c.paper, c.paper, Q).select("id", "score").orderBy(F.desc("score"), "id").limit(S.WINDOW))
DIM = 64


def fused_ctes(q: str, where: str = "") -> list[str]:
    """CTEs up to ``near`` (dense list), ``score`` (all BM25 matches) and ``fused`` (their fusion); ``where`` filters ``paper`` before both."""
    some = f" WHERE id IN (SELECT id FROM paper WHERE {where})" if where else ""
    vector = f"(SELECT list_transform(range(0, {DIM}), lambda i: ('0x' || substr(sha256('{q}#' || (i // 32)), 1 + 2 * (i % 32)::INT, 2))::INT / 255.0e0 * 2 - 1))"
    return [
        f"probe AS MATERIALIZED (SELECT {vector} AS v)",
        "near AS (SELECT paper_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS sim FROM paper_embedding, probe" + some.replace("WHERE id", "WHERE paper_id") + " ORDER BY sim DESC, id LIMIT 100)",
        *bm25_ctes(q),
        "dl AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS dense_rank FROM near)",
        f"sl AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS sparse_rank FROM (SELECT * FROM score{some} ORDER BY score DESC, id LIMIT 100))",
        "fu AS (SELECT id, dense_rank, sparse_rank, round(coalesce(1e0 / (60 + dense_rank), 0) + coalesce(1e0 / (60 + sparse_rank), 0), 12) AS rrf FROM dl FULL JOIN sl USING (id))",
        "fused AS (SELECT id, dense_rank::INTEGER AS dense_rank, sparse_rank::INTEGER AS sparse_rank, rrf, row_number() OVER (ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank)::INTEGER AS rank FROM fu)",
    ]


FUSED = fused_ctes(Q)
DENSE = FUSED[:2]
query("search_dense", with_views("SELECT id, sim FROM near", *DENSE))(lambda c: S.dense(c.paper, c.paper_embedding, S.query_vector(Q, DIM)))
query("rrf_fuse", with_views("SELECT * FROM fused", *FUSED))(lambda c: S.hybrid_list(c, HYBRID))
for _page in (1, 2):
    query(f"search_hybrid{'_page2' if _page == 2 else ''}", with_views(f"SELECT p.id, title, publication_year, {AUTHORS} FROM paper p JOIN fused USING (id) WHERE rank BETWEEN {20 * _page - 19} AND {20 * _page}", *FUSED))(lambda c, n=_page: S.page(c, S.Request(q=Q, mode="hybrid", page=n)))
query("search_hybrid_total", with_views("SELECT count(*) AS total FROM fused", *FUSED))(lambda c: S.total(c, HYBRID))


def indexed(c: Corpus) -> Corpus:
    """The corpus with a search index, which is built here; callers that search often keep it."""
    return Corpus(c.spark, c.sf_dir, X.build(c.paper, X.new_path(c.spark)))


query("search_indexed", SQL["search_ranked"])(lambda c: S.matches(indexed(c), RANKED).orderBy(F.desc("score"), F.desc("publication_year"), F.desc("id")).limit(20).select("id", "publication_year", "score"))
query("search_indexed_hybrid", SQL["search_hybrid"])(lambda c: S.page(indexed(c), HYBRID))


def with_vectors(c: Corpus) -> Corpus:
    return Corpus(c.spark, c.sf_dir, vectors=V.build(c.paper_embedding, X.new_path(c.spark)))


def with_grams(c: Corpus) -> Corpus:
    return Corpus(c.spark, c.sf_dir, grams=G.build(c.paper, X.new_path(c.spark)))


query("search_dense_indexed", SQL["search_dense"])(lambda c: S.nearest(with_vectors(c), c.paper, S.query_vector(Q, DIM)))
query("search_grams", SQL["search_legacy"])(lambda c: S.page(with_grams(c), S.Request(q=Q)))
RARE = "gthe de"
query("search_grams_rare", listing(" AND ".join(LIKE.format(t=t) for t in RARE.split())))(lambda c: S.page(with_grams(c), S.Request(q=RARE)))
query("index_postings", with_views(" UNION ALL ".join(f"SELECT '{f}' AS field, id, w AS term, count(*) AS tf, any_value(n) AS len FROM (SELECT id, unnest({t}) AS w, len({t}) AS n FROM tok) GROUP BY id, w" for f, t in (("title", "t1"), ("abstract", "t2"))), *bm25_ctes(Q)[:1]))(
    lambda c: indexed(c).index.postings.select(F.element_at(F.array(*map(F.lit, S.FIELDS)), F.col("field") + 1).alias("field"), "id", "term", F.col("tf").cast("long").alias("tf"), F.col("len").cast("long").alias("len"))
)
query("similar_papers", with_views("""SELECT id, title, round(sim, 4) AS score FROM (SELECT o.paper_id AS id, round(list_cosine_similarity(o.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS sim
    FROM paper_embedding s JOIN paper_embedding o ON o.paper_id <> s.paper_id WHERE s.paper_id = 7 ORDER BY sim DESC, id LIMIT 5) JOIN paper USING (id) WHERE sim > 0"""))(lambda c: S.similar(c, 7))
query("similar_indexed", SQL["similar_papers"])(lambda c: S.similar(with_vectors(c), 7))
query("cosine_pairs", with_views("SELECT a.paper_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM paper_embedding a JOIN paper_embedding b ON b.paper_id = a.paper_id + 1"))(
    lambda c: c.paper_embedding.join(c.paper_embedding.select((F.col("paper_id") - 1).alias("paper_id"), F.col("embedding").alias("other")), "paper_id").select(F.col("paper_id").alias("id"), F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))
)
query("bm25_stats", with_views(" UNION ALL ".join(f"SELECT '{n}' AS field, w AS term, count(*) AS df, (SELECT round(avg(len({t})), 6) FROM tok) AS avgdl FROM (SELECT unnest(list_distinct({t})) AS w FROM tok) GROUP BY w" for n, t in (("title", "t1"), ("abstract", "t2"))), *bm25_ctes(Q)[:1]))(S.bm25_stats)
query("paper_count", with_views("SELECT count(*) AS papers FROM paper"))(lambda c: c.paper.agg(F.count(F.lit(1)).alias("papers")))
query("prefix_scan", with_views("SELECT id, title FROM paper WHERE starts_with(openalex_id, 'W1')"))(lambda c: c.paper.where(F.col("openalex_id").startswith("W1")).select("id", "title"))

# ---- sources ----
WORK = "SELECT id, topic, publication_date, cited_by_count FROM works"
for _name, _date, _order in (("src_topic_works", "2020-01-01", "cited_by_count"), ("src_updated_works", "2018-06-01", "updated_date")):
    _field = "updated_date" if _order == "updated_date" else "publication_date"
    query(_name, with_views(f"{WORK} WHERE topic = 't2' AND {_field} >= '{_date}' ORDER BY {_order} DESC NULLS LAST, id LIMIT 200"))(
        lambda c, d=_date, o=_order, f=_field: c.works.where((F.col("topic") == "t2") & (F.col(f) >= d)).orderBy(F.desc_nulls_last(o), "id").limit(200).select("id", "topic", "publication_date", "cited_by_count")
    )
_RUNG = " UNION ALL ".join(f"SELECT topic, '{r}' AS rung, count(*) FILTER (publication_date >= '{r}') AS n, {k} AS k FROM works GROUP BY topic" for k, r in enumerate(I.RUNGS))
query("date_ladder", with_views("SELECT topic, coalesce(min_by(rung, k) FILTER (n >= 200), max_by(rung, k)) AS rung, coalesce(min_by(n, k) FILTER (n >= 200), max_by(n, k)) AS n FROM r GROUP BY topic", f"r AS ({_RUNG})"))(lambda c: I.date_ladder(c.works))
query("topics_fetched", with_views("SELECT topic, count(*) AS fetched FROM works GROUP BY topic"))(lambda c: c.works.groupBy("topic").agg(F.count(F.lit(1)).alias("fetched")))

# ---- ingest ----
NORM = r"""norm AS (SELECT topic, ord, nullif(regexp_extract(id, '[^/]*$'), '') AS openalex_id, nullif(regexp_replace(display_name, '^\s+|\s+$', '', 'g'), '') AS title,
    coalesce(nullif(publication_year, 0), substr(publication_date, 1, 4)::INTEGER) AS publication_year, coalesce(cited_by_count, 0)::BIGINT AS cited_by_count, doi, abstract, authors FROM works)"""
NCOLS = ("topic", "ord", "openalex_id", "title", "publication_year", "cited_by_count", "doi", "abstract")


def author_list() -> Column:
    return F.array_join(F.transform("authors", lambda a: F.concat(a["openalex_id"], F.lit(":"), a["name"])), "|").alias("authors")


query("normalize_work", with_views(f"SELECT {', '.join(NCOLS)}, authors FROM norm WHERE title IS NOT NULL", NORM))(lambda c: I.normalized(c.works).where("skip is null").select(*NCOLS, author_list()))
DEDUP = "ded AS (SELECT openalex_id, first(title ORDER BY topic, ord) AS title, first(publication_year ORDER BY topic, ord) AS publication_year, first(cited_by_count ORDER BY topic, ord) AS cited_by_count, first(doi ORDER BY topic, ord) AS doi, first(abstract ORDER BY topic, ord) AS abstract, first(authors ORDER BY topic, ord) AS authors, string_agg(DISTINCT topic, '|' ORDER BY topic) AS topics FROM norm WHERE title IS NOT NULL GROUP BY openalex_id)"
query("dedupe_cross_topic", with_views("SELECT * FROM ded", NORM, DEDUP))(lambda c: I.deduplicated(c.works).withColumn("authors", author_list()))
query("dlq_normalize_skip", with_views("SELECT topic, ord, openalex_id, doi, 'normalize_skip' AS reason, 'missing title' AS error_detail, 1 AS attempts, 'pending' AS status FROM norm WHERE title IS NULL", NORM))(lambda c: I.dead_letters(c.works))
CAND = """cand AS (SELECT *, list_filter(list_transform(landing_pages || [doi], lambda x: trim(x)), lambda x: x IS NOT NULL AND (starts_with(x, 'http://') OR starts_with(x, 'https://'))) AS raw FROM works),
    cands AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS candidates FROM cand),
    ordd AS (SELECT *, list_filter(candidates, lambda x: contains(x, 'arxiv.org') OR contains(x, '10.48550')) || list_filter(candidates, lambda x: NOT (contains(x, 'arxiv.org') OR contains(x, '10.48550'))) AS ordered FROM cands)"""
query("landing_candidates", with_views("SELECT topic, ord, array_to_string(candidates, ' ') AS candidates, array_to_string(ordered, ' ') AS ordered FROM ordd", CAND))(
    lambda c: I.landing_candidates(c.works).select("topic", "ord", F.array_join("candidates", " ").alias("candidates"), F.array_join("ordered", " ").alias("ordered"))
)
RES = """st AS (SELECT url, CASE WHEN status = 200 THEN 'ok' WHEN status IN (404, 410) THEN 'dead' ELSE 'unknown' END AS state FROM url_status),
    res AS (SELECT o.id, o.topic, o.ord, o.doi, coalesce(s.state = 'dead', false) AS dead,
        (SELECT min_by(u, k) FROM (SELECT unnest(o.ordered) AS u, unnest(range(len(o.ordered))) AS k) x JOIN st ON st.url = u AND st.state = 'ok' WHERE u <> o.doi) AS mirror
        FROM ordd o LEFT JOIN st s ON s.url = o.doi),
    ver AS (SELECT *, CASE WHEN dead THEN mirror ELSE nullif(trim(doi), '') END AS new_doi, dead AND mirror IS NULL AS dropped, dead AND mirror IS NOT NULL AS replaced FROM res)"""
query("doi_resolve", with_views("SELECT topic, ord, new_doi, dropped, replaced FROM ver", CAND, RES))(lambda c: I.resolved(c.works, c.url_status).select("topic", "ord", "new_doi", "dropped", "replaced"))
query("verify_works", with_views("SELECT topic, ord, CASE WHEN dropped THEN doi ELSE new_doi END AS doi FROM ver WHERE id IN (SELECT id FROM ver WHERE NOT dropped)", CAND, RES))(lambda c: I.verified(c.works, c.url_status).select("topic", "ord", "doi"))
query("drop_unresolvable", with_views("SELECT DISTINCT id FROM ver WHERE NOT dropped", CAND, RES))(lambda c: I.verified(c.works, c.url_status).select("id").distinct())
query("dlq_unresolvable", with_views("SELECT topic, ord, doi, 'unresolvable_doi' AS reason, 'pending' AS status FROM ver WHERE dropped", CAND, RES))(
    lambda c: I.resolved(c.works, c.url_status).where("dropped").select("topic", "ord", "doi", F.lit("unresolvable_doi").alias("reason"), F.lit("pending").alias("status"))
)
query("doi_stats", with_views("SELECT count(*) FILTER (trim(doi) <> '') AS checked, count(*) FILTER (replaced) AS replaced, count(*) FILTER (dropped) AS dropped FROM ver", CAND, RES))(
    lambda c: I.resolved(c.works, c.url_status).agg(F.count_if(F.trim("doi") != "").alias("checked"), F.count_if("replaced").alias("replaced"), F.count_if("dropped").alias("dropped"))
)
#: Stored papers and a later batch: the batch renames some, changes citations of others and adds new ones.
OLD = "old AS (SELECT openalex_id, title, abstract, publication_year, doi, cited_by_count FROM paper WHERE id % 3 <> 0)"
NEW = "inc AS (SELECT openalex_id, CASE WHEN id % 4 = 0 THEN title || ' v2' ELSE title END AS title, CASE WHEN id % 10 = 0 THEN NULL ELSE abstract END AS abstract, publication_year, doi, cited_by_count + id % 2 AS cited_by_count FROM paper WHERE id % 2 = 0)"
PCOLS = ("openalex_id", "title", "abstract", "publication_year", "doi", "cited_by_count")


def old_and_new(c: Corpus) -> tuple[DataFrame, DataFrame]:
    new = c.paper.where("id % 2 = 0").withColumns({"title": F.when(F.col("id") % 4 == 0, F.concat("title", F.lit(" v2"))).otherwise(F.col("title")), "abstract": F.when(F.col("id") % 10 != 0, F.col("abstract")), "cited_by_count": F.col("cited_by_count") + F.col("id") % 2})
    return c.paper.where("id % 3 <> 0").select(*PCOLS), new.select(*PCOLS)


TOUCH = "tch AS (SELECT i.* FROM inc i LEFT JOIN old o USING (openalex_id) WHERE o.openalex_id IS NULL OR i.title IS DISTINCT FROM o.title OR i.abstract IS DISTINCT FROM o.abstract)"
query("upsert_papers", with_views("SELECT *, CASE WHEN openalex_id IN (SELECT openalex_id FROM old) THEN 'updated' ELSE 'new' END AS action FROM inc UNION ALL SELECT *, 'kept' FROM old WHERE openalex_id NOT IN (SELECT openalex_id FROM inc)", OLD, NEW))(lambda c: I.upserted(*old_and_new(c)))
query("touched_papers", with_views("SELECT openalex_id FROM tch", OLD, NEW, TOUCH))(lambda c: I.touched(*old_and_new(c)).select("openalex_id"))
query("new_authors", with_views("SELECT DISTINCT author_id FROM paper_author WHERE author_id NOT IN (SELECT author_id FROM paper_author WHERE paper_id % 97 = 1)"))(
    lambda c: I.missing(c.paper_author.select("author_id"), c.paper_author.where("paper_id % 97 = 1"), "author_id")
)
query("new_topics", with_views("SELECT DISTINCT slug FROM paper_topic WHERE slug NOT IN (SELECT lang FROM paper)"))(lambda c: I.missing(c.paper_topic.select("slug"), c.paper.select(F.col("lang").alias("slug")), "slug"))
query("new_relations", with_views("SELECT paper_id, author_id FROM paper_author WHERE paper_id NOT IN (SELECT paper_id FROM paper_author WHERE paper_id % 3 <> 0)"))(
    lambda c: I.missing(c.paper_author, c.paper_author.where("paper_id % 3 <> 0"), "paper_id", "author_id")
)
query("ingest_report", with_views("SELECT (SELECT count(*) FROM inc WHERE openalex_id NOT IN (SELECT openalex_id FROM old)) AS papers_new, (SELECT count(*) FROM inc WHERE openalex_id IN (SELECT openalex_id FROM old)) AS papers_updated, (SELECT count(*) FROM tch) AS touched", OLD, NEW, TOUCH))(
    lambda c: I.upserted(*old_and_new(c)).agg(F.count_if(F.col("action") == "new").alias("papers_new"), F.count_if(F.col("action") == "updated").alias("papers_updated")).join(I.touched(*old_and_new(c)).agg(F.count(F.lit(1)).alias("touched")))
)
STATE = "sta AS (SELECT 'topic' || r_regionkey AS topic, CASE WHEN r_regionkey > 1 THEN TIMESTAMP '2024-01-01' END AS last_incremental_at FROM region)"


def state(c: Corpus) -> DataFrame:
    mark = F.when(F.col("r_regionkey") > 1, F.lit("2024-01-01"))
    return c.table("region").where("r_regionkey <> 3").select(F.concat(F.lit("topic"), F.col("r_regionkey").cast("string")).alias("topic"), F.lit(None).cast("string").alias("last_full_ingest_at"), mark.alias("last_incremental_at"))


def due(c: Corpus) -> DataFrame:
    """The topics of a run: one of them has no watermark row yet."""
    return c.table("region").where("r_regionkey >= 2").select(F.concat(F.lit("topic"), F.col("r_regionkey").cast("string")).alias("topic"))


STATE = STATE.replace("TIMESTAMP '2024-01-01'", "'2024-01-01'").replace(" FROM region", ", NULL::VARCHAR AS last_full_ingest_at FROM region WHERE r_regionkey <> 3")
DUE = "due AS (SELECT 'topic' || r_regionkey AS topic FROM region WHERE r_regionkey >= 2)"
MARKS = "SELECT topic, last_full_ingest_at, {} AS last_incremental_at FROM sta"
query("watermark_seed", with_views("SELECT topic, '2024-06-01' AS last_full_ingest_at, '2024-06-01' AS last_incremental_at FROM due UNION ALL " + MARKS.format("last_incremental_at") + " WHERE topic NOT IN (SELECT topic FROM due)", STATE, DUE))(lambda c: U.seed_watermarks(state(c), due(c), "2024-06-01"))
query("watermark_backfill", with_views(MARKS.format("last_incremental_at") + " UNION ALL SELECT topic, NULL, '2024-06-01' FROM due WHERE topic NOT IN (SELECT topic FROM sta)", STATE, DUE))(lambda c: U.backfill_watermarks(state(c), due(c), "2024-06-01"))
query("watermark_advance", with_views(MARKS.format("CASE WHEN topic IN (SELECT topic FROM due) THEN '2024-06-02' ELSE last_incremental_at END"), STATE, DUE))(lambda c: U.advance_watermarks(state(c), due(c), "2024-06-02"))

#: Runs over the views: an empty corpus, then a stored one with later works.
TOPICS = [("t1", "T1", "first"), ("t2", "T2", "second")]
LADDER = f"r AS ({_RUNG}), rung AS (SELECT topic, coalesce(min_by(rung, k) FILTER (n >= 200), max_by(rung, k)) AS rung FROM r GROUP BY topic)"
FETCH = "SELECT * EXCLUDE (place, ord), place AS ord FROM (SELECT works.*, row_number() OVER (PARTITION BY topic ORDER BY {} DESC NULLS LAST, works.id) AS place FROM works {}) WHERE place <= {}"
NORMED = NORM.replace("FROM works)", "FROM fetched)")


def empty(c: Corpus) -> dict[str, DataFrame]:
    return {k: c.spark.createDataFrame([], v) for k, v in U.SCHEMAS.items()}


def stored(c: Corpus) -> dict[str, DataFrame]:
    """Every paper whose id leaves 0 or 1 by 4, its title shortened where it leaves 1."""
    papers = c.paper.where("id % 4 < 2").select("id", "openalex_id", F.when(F.col("id") % 4 == 1, F.substring("title", 1, 20)).otherwise(T.strip(F.col("title"))).alias("title"), T.collapse(F.col("title")).alias("abstract"), "publication_year", "doi", "cited_by_count", F.lit(None).cast("string").alias("abstract_source"), F.lit(None).cast("string").alias("abstract_recovered_at"))
    return empty(c) | {"paper": papers, "ingest_state": c.spark.createDataFrame([(t, None, "2023-03-01T10:00:00") for t, *_ in TOPICS], U.SCHEMAS["ingest_state"])}


query("ingest_full", with_views("SELECT openalex_id, title, abstract, publication_year, doi, cited_by_count FROM ded", LADDER, "fetched AS (" + FETCH.format("cited_by_count", "JOIN rung USING (topic) WHERE publication_date >= rung", U.PER_TOPIC) + ")", NORMED, DEDUP))(
    lambda c: U.apply(empty(c), U.fetch_full(c.works), TOPICS, "full")[0]["paper"].select("openalex_id", "title", "abstract", "publication_year", "doi", "cited_by_count")
)
query("ingest_full_links", with_views("SELECT DISTINCT openalex_id, split_part(unnest(string_split(authors, '|')), ':', 1) AS author_id FROM ded", LADDER, "fetched AS (" + FETCH.format("cited_by_count", "JOIN rung USING (topic) WHERE publication_date >= rung", U.PER_TOPIC) + ")", NORMED, DEDUP))(
    lambda c: U.apply(empty(c), U.fetch_full(c.works), TOPICS, "full")[0]["paper_author"]
)
DELTA = ["fetched AS (" + FETCH.format("updated_date", "WHERE updated_date >= '2023-03-01'", U.PER_DELTA) + ")", NORMED, DEDUP]
query("ingest_incremental", with_views("""SELECT openalex_id, title, doi, cited_by_count FROM ded UNION ALL
    SELECT openalex_id, CASE WHEN id % 4 = 1 THEN substr(title, 1, 20) ELSE regexp_replace(title, '^\\s+|\\s+$', '', 'g') END, doi, cited_by_count FROM paper WHERE id % 4 < 2 AND openalex_id NOT IN (SELECT openalex_id FROM ded)""", *DELTA))(
    lambda c: U.apply(stored(c), U.fetch_delta(c.works, stored(c)["ingest_state"]), TOPICS, "incremental")[0]["paper"].select("openalex_id", "title", "doi", "cited_by_count")
)
query("ingest_incremental_report", with_views("SELECT count(*) AS papers, count(*) FILTER (old) AS papers_updated, count(*) FILTER (NOT old) AS papers_new FROM (SELECT openalex_id IN (SELECT openalex_id FROM paper WHERE id % 4 < 2) AS old FROM ded)", *DELTA))(
    lambda c: U.apply(stored(c), U.fetch_delta(c.works, stored(c)["ingest_state"]), TOPICS, "incremental")[2].select("papers", "papers_updated", "papers_new")
)
query("since_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS since FROM events")(lambda c: c.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("since")))
DLQ = "dlq AS (SELECT event_id AS id, ts AS created_at, event_type AS topic, 1 + (event_id % 3)::INTEGER AS attempts, CASE WHEN event_id % 5 = 0 THEN 'retried' ELSE 'pending' END AS status FROM events)"


def dlq(c: Corpus) -> DataFrame:
    return c.table("events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("topic"), (1 + F.col("event_id") % 3).cast("int").alias("attempts"), F.when(F.col("event_id") % 5 == 0, "retried").otherwise("pending").alias("status"))


query("dlq_replay", with_views("SELECT id, topic, (attempts + (id IN (SELECT id FROM due))::INTEGER)::INTEGER AS attempts, CASE WHEN id IN (SELECT id FROM due) THEN 'retried' ELSE status END AS status FROM dlq", DLQ, "due AS (SELECT id FROM dlq WHERE status = 'pending' ORDER BY created_at, id LIMIT 20)"))(lambda c: I.replayed(dlq(c)).select("id", "topic", "attempts", "status"))


@query("point_fix", with_views("SELECT id, coalesce(new_doi, doi) AS doi, coalesce(new_year, publication_year) AS publication_year FROM paper LEFT JOIN fix USING (id)", "fix AS (SELECT * FROM (VALUES (1, 'https://doi.org/10.1/a', 2001), (4, 'https://doi.org/10.1/b', NULL), (13, 'https://doi.org/10.1/c', 2003)) AS f(id, new_doi, new_year))"))
def _(c):
    rows = [(1, "https://doi.org/10.1/a", 2001), (4, "https://doi.org/10.1/b", None), (13, "https://doi.org/10.1/c", 2003)]
    fix = c.spark.createDataFrame(rows, "id long, new_doi string, new_year int")
    return c.paper.join(F.broadcast(fix), "id", "left").select("id", F.coalesce("new_doi", "doi").alias("doi"), F.coalesce("new_year", "publication_year").alias("publication_year"))


query("cascade_delete", with_views("SELECT 'paper' AS tbl, count(*) AS n FROM paper WHERE id NOT IN (SELECT id FROM del) UNION ALL SELECT 'paper_author', count(*) FROM paper_author WHERE paper_id NOT IN (SELECT id FROM del) UNION ALL SELECT 'paper_embedding', count(*) FROM paper_embedding WHERE paper_id NOT IN (SELECT id FROM del)", "del AS (SELECT id FROM paper WHERE starts_with(openalex_id, 'W1'))"))(
    lambda c: _cascade(c)
)


def _cascade(c: Corpus) -> DataFrame:
    gone = c.paper.where(F.col("openalex_id").startswith("W1")).select(F.col("id").alias("paper_id"))
    count = lambda name, df: df.join(gone, "paper_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
    return count("paper", c.paper.withColumnRenamed("id", "paper_id")).union(count("paper_author", c.paper_author)).union(count("paper_embedding", c.paper_embedding))


# ---- embeddings ----
BLANK = "trim(coalesce(title, '') || ' ' || coalesce(abstract, '')) <> ''"
MISS = f"mis AS (SELECT id, title, abstract FROM paper WHERE {BLANK} AND id NOT IN (SELECT paper_id FROM paper_embedding))"
TEXT = r"array_to_string(list_filter([regexp_replace(title, '^\s+|\s+$', '', 'g'), regexp_replace(abstract, '^\s+|\s+$', '', 'g')], lambda x: coalesce(x, '') <> ''), ' ')"
FIRST = "round(('0x' || substr(sha256(t || '#0'), 1, 2))::INT / 255.0e0 * 2 - 1, 6) AS first_component"


def without_vector(c: Corpus) -> DataFrame:
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    return c.paper.where(text != "").join(c.paper_embedding.select(F.col("paper_id").alias("id")), "id", "left_anti")


def embedded(papers: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, embedding) of papers with text, by the deterministic provider."""
    return papers.withColumn("__t", T.paper_text(F.col("title"), F.col("abstract"))).where("__t <> ''").withColumn("embedding", T.hash_vector(F.col("__t"), dim)).drop("__t")


query("paper_text", with_views(f"SELECT id, {TEXT} AS text FROM paper"))(lambda c: c.paper.select("id", T.paper_text(F.col("title"), F.col("abstract")).alias("text")))
query("embedding_missing", with_views("SELECT id FROM mis", MISS))(lambda c: without_vector(c).select("id"))
query("embedding_missing_count", with_views("SELECT count(*) AS missing FROM mis", MISS))(lambda c: without_vector(c).agg(F.count(F.lit(1)).alias("missing")))
query("embedding_backfill", with_views(f"SELECT id, {FIRST} FROM (SELECT id, {TEXT} AS t FROM mis) WHERE t <> ''", MISS))(lambda c: embedded(without_vector(c)).select("id", F.round(F.get("embedding", F.lit(0)), 6).alias("first_component")))
query("embed_touched", with_views(f"SELECT openalex_id, {FIRST} FROM (SELECT openalex_id, {TEXT} AS t FROM tch) WHERE t <> ''", OLD, NEW, TOUCH))(lambda c: embedded(I.touched(*old_and_new(c))).select("openalex_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first_component")))
UPSERT = f"""ups AS (SELECT id, {FIRST} FROM (SELECT id, {TEXT} AS t FROM paper WHERE id IN (SELECT id FROM mis) OR id % 5 = 0) WHERE t <> ''),
    old AS (SELECT paper_id AS id, round(embedding[1]::DOUBLE, 6) AS first_component FROM paper_embedding WHERE paper_id NOT IN (SELECT id FROM ups))"""


@query("embedding_upsert", with_views("SELECT * FROM ups UNION ALL SELECT * FROM old", MISS, UPSERT))
def _(c):
    """Vectors of papers that have none and anew of every fifth paper, whose stored vectors they replace."""
    due = without_vector(c).select(*c.paper.columns).union(c.paper.where("id % 5 = 0")).dropDuplicates(["id"])
    new = embedded(due).select(F.col("id").alias("paper_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    old = c.paper_embedding.select("paper_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return U.with_vectors(old, new).select(F.col("paper_id").alias("id"), F.round(F.get("embedding", F.lit(0)), 6).alias("first_component"))


# ---- enrichment ----
query("classify_status", with_views("SELECT url, CASE WHEN status = 200 THEN 'ok' WHEN status IN (404, 410) THEN 'dead' ELSE 'unknown' END AS state FROM url_status"))(lambda c: c.url_status.select("url", T.classify_status(F.col("status")).alias("state")))
query("doi_audit", with_views("SELECT id, doi, status::VARCHAR AS status FROM paper JOIN url_status ON url = doi WHERE status <> 200"))(lambda c: c.paper.join(c.url_status, F.col("doi") == F.col("url")).where("status <> 200").select("id", "doi", F.col("status").cast("string").alias("status")).orderBy("status", "id"))
#: A paper's number that one of these divides has a link with that status, the first that fits.
STATUSES = ((11, 404), (19, 410), (23, 503))


def answers(url: str, params: dict) -> tuple[int, dict, str]:
    """What a host says to a doi of the views, as ``url_status`` has it."""
    number = int(url.rsplit("/", 1)[1])
    return next((status for n, status in STATUSES if number % n == 0), 200), {}, ""


AUDIT = "SELECT id, doi, status::VARCHAR AS status, CASE WHEN status IN (404, 410) THEN 'dead' ELSE 'unknown' END AS state FROM paper JOIN url_status ON url = doi WHERE status <> 200"
# one host has every doi
query("doi_audit_probed", with_views(AUDIT))(lambda c: P.audited(c.paper, P.probed(c.paper.select(F.col("doi").alias("url")), answers, P.Manners(rate=1e6))))
query("doi_bare", with_views("SELECT id, regexp_replace(doi, '^https?://doi\\.org/', '') AS bare FROM paper"))(lambda c: c.paper.select("id", T.bare_doi(F.col("doi")).alias("bare")))
query("doi_source", with_views("SELECT id, CASE WHEN contains(doi, '10.1007') THEN 'springer' WHEN contains(doi, '10.1016') THEN 'elsevier' ELSE 'html_generic' END AS source_tag FROM paper"))(lambda c: c.paper.select("id", T.doi_source(F.col("doi")).alias("source_tag")))
query("arxiv_id", with_views(f"SELECT topic, ord, list_filter(list_transform([doi] || landing_pages, lambda x: regexp_extract(coalesce(x, ''), '{T.ARXIV}', 1)), lambda x: x <> '')[1] AS arxiv FROM works"))(lambda c: c.works.select("topic", "ord", T.arxiv_id(F.col("doi"), F.col("landing_pages")).alias("arxiv")))
query("strip_markup", r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM pages")(lambda c: c.table("pages").select("page_id", T.strip_markup(F.col("html")).alias("plain")))
query("ws_collapse", r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line FROM documents")(lambda c: c.table("documents").select("doc_id", T.collapse(F.col("text")).alias("line")))
CANDIDATES = "can AS (SELECT * FROM paper WHERE abstract IS NULL AND doi IS NOT NULL)"
SOURCES = [CANDIDATES, "cr AS (SELECT regexp_replace(doi, '^https?://doi\\.org/', '') AS k, CASE WHEN id % 4 = 0 THEN 'crossref ' || id WHEN id % 4 = 1 THEN '  ' END AS f FROM paper WHERE doi IS NOT NULL)", "ax AS (SELECT regexp_replace(doi, '^https?://doi\\.org/', '') AS k, CASE WHEN id % 3 = 0 THEN 'preprint ' || id END AS f FROM paper WHERE doi IS NOT NULL)", "ht AS (SELECT regexp_replace(doi, '^https?://doi\\.org/', '') AS k, CASE WHEN id % 2 = 1 THEN 'html ' || id END AS f FROM paper WHERE doi IS NOT NULL)",
           "rec AS (SELECT id, coalesce(nullif(trim(cr.f), ''), ax.f, ht.f) AS found, CASE WHEN trim(cr.f) <> '' THEN 'crossref' WHEN ax.f IS NOT NULL THEN 'arxiv' WHEN ht.f IS NOT NULL THEN 'html' END AS found_source FROM can JOIN cr ON cr.k = regexp_replace(doi, '^https?://doi\\.org/', '') JOIN ax USING (k) JOIN ht USING (k))"]


def waterfall(c: Corpus) -> DataFrame:
    p, i = c.paper.where("doi is not null"), F.col("id")
    make = lambda found: p.select("doi", found.alias("found"))
    say = lambda name: F.concat(F.lit(name + " "), i.cast("string"))
    crossref = make(F.when(i % 4 == 0, say("crossref")).when(i % 4 == 1, F.lit("  ")))
    return I.recovered(c.paper.where("abstract is null and doi is not null"), ("crossref", crossref), ("arxiv", make(F.when(i % 3 == 0, say("preprint")))), ("html", make(F.when(i % 2 == 1, say("html")))))


query("recovery_candidates", with_views("SELECT id FROM can", CANDIDATES))(lambda c: c.paper.where("abstract is null and doi is not null").select("id"))
query("recover_waterfall", with_views("SELECT id, found, found_source FROM rec", *SOURCES))(lambda c: waterfall(c).select("id", "found", "found_source"))
query("recover_batch", with_views("SELECT id, found AS abstract, found_source AS abstract_source FROM rec WHERE found IS NOT NULL ORDER BY id LIMIT 20", *SOURCES))(lambda c: waterfall(c).where("found is not null").orderBy("id").limit(I.RECOVERY_LIMIT).select("id", F.col("found").alias("abstract"), F.col("found_source").alias("abstract_source")))


def backfilled(c: Corpus, batches: int = 4) -> DataFrame:
    """All recoverable papers through a store and a backfill run of so many batches: what each got, with its ledger row."""
    store = Store(c.spark, X.new_path(c.spark))
    none = {n: F.lit(None).cast("string").alias(n) for n in ("abstract_source", "abstract_recovered_at")}
    store.publish({"paper": c.paper.select("id", "openalex_id", "title", "abstract", "publication_year", "doi", "cited_by_count", *none.values())})
    due = c.paper.where("abstract is null and doi is not null").count()
    found = lambda part: waterfall(c).join(part.select("id"), "id", "left_semi").select("id", F.col("found").alias("abstract"), F.col("found_source").alias("abstract_source"))
    B.Backfill(store, B.Abstracts(found, "2024-01-02T00:00:00"), "all", size=-(-due // batches), limit=None).run(most_empty=None)
    t = store.tables()
    return t["attempt"].join(t["paper"].withColumnRenamed("id", "paper_id"), "paper_id").select(F.col("paper_id").alias("id"), "abstract", "abstract_source", "batch", "state", "attempts")


query("backfill_abstracts", with_views("SELECT id, found AS abstract, found_source AS abstract_source, floor((row_number() OVER (ORDER BY id) - 1) / ceil(count(*) OVER () / 4.0))::INTEGER AS batch, CASE WHEN found IS NULL THEN 'none' ELSE 'done' END AS state, 1 AS attempts FROM rec", *SOURCES))(backfilled)
query("abstracts_by_source", with_views("SELECT found_source AS abstract_source, count(*) AS n FROM rec GROUP BY found_source", *SOURCES))(lambda c: waterfall(c).groupBy(F.col("found_source").alias("abstract_source")).agg(F.count(F.lit(1)).alias("n")))
query("abstract_gap_counts", with_views("SELECT count(*) FILTER (abstract IS NULL) AS missing, count(*) FILTER (abstract IS NULL AND doi IS NOT NULL) AS recoverable FROM paper"))(lambda c: c.paper.agg(F.count_if(F.col("abstract").isNull()).alias("missing"), F.count_if(F.col("abstract").isNull() & F.col("doi").isNotNull()).alias("recoverable")))
SENTENCE = "An abstract that stands on the page number {} and is long enough to be taken for one, since it has many words."
PLACES = ('<meta name="citation_abstract" content=" {}  ">', '<meta property="og:description" content="{}"><div class="abstract author"><p>other</p></div>', '<section id="abstract"><h2>Abstract</h2><p>{}</p></section>', '<article><section class="abstract x">{}</section></article>', '<div class="c-article-section__content">{}</div>')


def with_abstracts(c: Corpus) -> DataFrame:
    """The pages with an abstract at one of several places, or at none that counts."""
    said = F.concat(*(F.lit(x) if k == 0 else F.concat(F.col("page_id").cast("string"), F.lit(x)) for k, x in enumerate(SENTENCE.split("{}"))))
    kind = F.col("page_id") % len(PLACES)
    block = F.element_at(F.array(*(F.concat(F.lit(x.split("{}")[0]), said, F.lit(x.split("{}")[1])) for x in PLACES)), (kind + 1).cast("int"))
    return c.table("pages").select("page_id", F.concat(block, "html").alias("html"))


_SAID = "replace('" + SENTENCE + "', '{}', page_id::VARCHAR)"
query("html_abstract", f"SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL WHEN 2 THEN 'Abstract ' || {_SAID} ELSE {_SAID} END AS abstract FROM pages")(lambda c: with_abstracts(c).select("page_id", R.html_abstract(F.col("html")).alias("abstract")))
HOSTS = ("http://10.0.0.8/", "http://localhost/x", "ftp://a.b/", "http://[::1]/", "http://169.254.1.1/", "http://intranet.local/", "https://8.8.8.8/")
query("url_guard", f"SELECT page_id, page_id % 8 < 5 AS blocked FROM pages")(
    lambda c: c.table("pages").select("page_id", R.private_url(F.coalesce(F.get(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % 8).cast("int")), F.col("url"))).alias("blocked"))
)
query("atom_summary", with_views("SELECT id, 'Paper ' || id AS summary FROM paper"))(lambda c: c.paper.select("id", R.feed_summary(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><summary> Paper '), F.col("id").cast("string"), F.lit(" </summary></entry></feed>"))).alias("summary")))


@query("abstract_rebuild", r"""WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents) SELECT doc_id, nullif(array_to_string(ws, ' '), '') AS abstract FROM w""")
def _(c):
    """Each text's inverted index (word to positions), built and read back inside its row."""
    words = c.table("documents").select("doc_id", T.held(ws=F.filter(F.split("text", " "), lambda x: x != "")))
    return T.inverted(words, "ws", "index").select("doc_id", T.rebuilt_abstract(F.col("index")).alias("abstract"))


# ---- upkeep ----
def seeded(c: Corpus) -> DataFrame:
    """The papers as fixtures into a store that has every third of them: the counts of two calls and the store's links after them."""
    store = Store(c.spark, X.new_path(c.spark))
    store.publish({"paper": c.paper.where("id % 3 = 0").select("id", "openalex_id", "title", "abstract", "publication_year", "doi", "cited_by_count", *(F.lit(None).cast("string").alias(n) for n in ("abstract_source", "abstract_recovered_at")))})
    fixtures = c.paper.select("openalex_id", "title", "abstract", "publication_year", F.array("source").alias("authors"), F.array("lang", "source").alias("topics"))
    calls = [(n, *K.seed(store, fixtures)) for n in (1, 2)]
    t = store.tables()
    n = lambda name: F.broadcast(t[name].agg(F.count(F.lit(1)).alias(name)))
    return c.spark.createDataFrame(calls, "call int, already long, inserted long").crossJoin(n("paper")).crossJoin(n("author")).crossJoin(n("topic")).crossJoin(n("paper_author")).crossJoin(n("paper_topic"))


_SEEDS = """fx AS (SELECT id, lang, source FROM paper WHERE trim(title) <> ''), ins AS (SELECT * FROM fx WHERE id % 3 <> 0),
    tp AS (SELECT DISTINCT id, trim(unnest([lang, source])) AS slug FROM ins)"""
query("seed_fixtures", with_views("""SELECT call::INTEGER AS call, (SELECT count(*) FROM fx) - CASE call WHEN 1 THEN (SELECT count(*) FROM ins) ELSE 0 END AS already, CASE call WHEN 1 THEN (SELECT count(*) FROM ins) ELSE 0 END AS inserted,
    (SELECT count(*) FROM paper WHERE id % 3 = 0) + (SELECT count(*) FROM ins) AS paper, (SELECT count(DISTINCT source) FROM ins) AS author, (SELECT count(DISTINCT slug) FROM tp) AS topic,
    (SELECT count(source) FROM ins) AS paper_author, (SELECT count(*) FROM tp WHERE slug <> '') AS paper_topic FROM (SELECT unnest([1, 2]) AS call)""", _SEEDS))(seeded)
query("topic_catalogue", with_views("SELECT slug, upper(slug) AS name, count(*) AS papers FROM paper_topic WHERE slug IS NOT NULL GROUP BY slug"))(
    lambda c: K.catalogue(c.paper_topic.where("slug is not null").select("slug", F.upper("slug").alias("name")).distinct(), c.paper_topic)
)
query("ops_gauges", with_views("""SELECT count(*) AS papers, count(*) FILTER (abstract IS NULL) AS no_abstract, count(*) FILTER (abstract IS NULL AND doi IS NOT NULL) AS recoverable, count(*) FILTER (id NOT IN (SELECT paper_id FROM paper_embedding)) AS no_vector,
    (SELECT count(*) FROM author) AS authors, (SELECT count(DISTINCT slug) FROM paper_topic) AS topics, (SELECT count(*) FROM works WHERE trim(display_name) = '') AS letters FROM paper"""))(
    lambda c: K.gauges({"paper": c.paper, "paper_embedding": c.paper_embedding, "author": c.author, "topic": c.paper_topic.where("slug is not null").select("slug").distinct(), "ingest_dlq": c.works.where("trim(display_name) = ''").withColumn("status", F.lit("pending"))})
)

# ---- evaluation ----
def runs_sql(qrels=E.QRELS) -> str:
    """(qid, mode, rank, id, title) of the first page of every query in every mode."""
    top = "SELECT '{}' AS qid, '{}' AS mode, row_number() OVER (ORDER BY {o})::INTEGER AS rank, id, title FROM ({}) ORDER BY {o} LIMIT " + str(E.RECALL_K)
    parts = []
    for qid, q, _, *filters in qrels:
        year, author = (*filters, None, None)[:2]
        where = " AND ".join(([f"publication_year = {year}"] if year is not None else []) + ([BY_AUTHOR.format(author)] if author else []))
        own = f" AND {where}" if where else ""
        nested = "WITH " + ", ".join(fused_ctes(q, where)) + " "
        parts += [
            top.format(qid, "legacy", "SELECT * FROM paper WHERE " + " AND ".join(LIKE.format(t=t) for t in q.split()) + own, o="publication_year DESC, id DESC"),
            top.format(qid, "ranked", nested + "SELECT id, title, score, score.publication_year FROM paper JOIN score USING (id) WHERE true" + own.replace("publication_year", "paper.publication_year"), o="score DESC, publication_year DESC, id DESC"),
            top.format(qid, "hybrid", nested + "SELECT id, title, fused.rank AS pos FROM paper JOIN fused USING (id)", o="pos"),
        ]
    return "runs AS (" + " UNION ALL ".join(f"(SELECT * FROM ({x}))" for x in parts) + ")"


def _relevant(subs: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(title), lower('{x}'))" for x in subs) + ")"


JUDGED = [
    runs_sql(),
    "judged AS (SELECT *, (CASE " + " ".join(f"WHEN qid = '{qid}' THEN {_relevant(subs)}" for qid, _, subs in E.QRELS) + " END)::INTEGER AS rel FROM runs)",
]
METRICS = [
    *JUDGED,
    "pool AS (SELECT qid, count(DISTINCT id) AS pool FROM judged WHERE rel = 1 GROUP BY qid)",
    f"""raw AS (SELECT qid, mode, coalesce(max(CASE WHEN rel = 1 THEN 1e0 / rank END), 0) AS mrr, coalesce(sum(CASE WHEN rel = 1 AND rank <= {E.NDCG_K} THEN 1e0 / log2(rank + 1) END), 0) AS dcg,
        count(*) FILTER (rel = 1 AND rank <= {E.NDCG_K}) AS n10, count(*) FILTER (rel = 1) AS found FROM judged GROUP BY qid, mode)""",
    "asked AS (SELECT unnest([" + ", ".join(f"'{q}'" for q, *_ in E.QRELS) + "]) AS qid), modes AS (SELECT unnest(['legacy', 'ranked', 'hybrid']) AS mode)",
    """per AS (SELECT qid, mode, round(coalesce(mrr, 0), 6) AS mrr, round(CASE WHEN n10 > 0 THEN dcg / list_sum(list_transform(range(1, n10 + 1), lambda i: 1e0 / log2(i + 1))) ELSE 0 END, 6) AS ndcg,
        round(coalesce(found / pool, 0), 6) AS recall FROM (SELECT qid, mode FROM asked, modes) LEFT JOIN raw USING (qid, mode) LEFT JOIN pool USING (qid))""",
    "metrics AS (SELECT *, (ndcg = max(ndcg) OVER (PARTITION BY qid))::INTEGER AS win FROM per)",
]
_res = lambda c: E.relevance(E.runs(c))
query("eval_relevance", with_views("SELECT * FROM judged", *JUDGED))(_res)
for _metric in ("mrr", "ndcg", "recall", "win"):
    query({"recall": "eval_pooled_recall", "win": "eval_wins"}.get(_metric, f"eval_{_metric}"), with_views(f"SELECT qid, mode, {_metric} FROM metrics", *METRICS))(lambda c, m=_metric: E.per_query(_res(c)).select("qid", "mode", m))
query("eval_scorecard", with_views("SELECT mode, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, sum(win)::BIGINT AS wins FROM metrics GROUP BY mode", *METRICS))(lambda c: E.scorecard(E.per_query(_res(c))))
query("eval_indexed", SQL["eval_scorecard"])(lambda c: E.scorecard(E.per_query(_res(indexed(c)))))
query("eval_degrade", with_views("SELECT qid, count(DISTINCT coalesce(ids, '')) = 1 AS degraded FROM (SELECT qid, mode FROM asked, modes) LEFT JOIN (SELECT qid, mode, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM runs GROUP BY qid, mode) USING (qid, mode) GROUP BY qid", *METRICS[:-2]))(lambda c: E.degraded(E.runs(c)))
query("qrels_load", "SELECT * FROM (VALUES ('q1', 'this from', 'this', NULL::INTEGER, NULL), ('q2', 'with', 'with|that', 2020, NULL), ('q3', 'que', 'que|para', NULL, 'Supplier')) AS t(qid, q, relevant, year, author)")(
    lambda c: R.read_qrels(c.spark, f"file://{Path(__file__).with_name('qrels.jsonl')}").select("qid", "q", F.array_join("relevant_substrings", "|").alias("relevant"), "year", "author")
)

QRELS_FILE = f"file://{Path(__file__).with_name('qrels.jsonl')}"
FILTERED = (("q1", "this from", ("this",)), ("q2", "with", ("with", "that"), 2020), ("q3", "que", ("que", "para"), None, "Supplier"))
query("eval_filtered", with_views("SELECT * FROM runs", runs_sql(FILTERED)))(lambda c: E.runs(c, E.loaded(R.read_qrels(c.spark, QRELS_FILE))))

# ---- lists, limits and page arithmetic ----
LISTS = "li AS (SELECT user_id, list(DISTINCT event_id % 50 ORDER BY event_id % 50) AS a, [3, 7, 3, 60]::BIGINT[] AS b FROM events GROUP BY user_id)"


def lists(c: Corpus) -> DataFrame:
    return c.table("events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("event_id") % 50)).alias("a")).withColumn("b", F.array(*[F.lit(x).cast("long") for x in (3, 7, 3, 60)]))


query("bookmark_merge", with_views("SELECT user_id, array_to_string(a || list_filter([3, 7, 60], lambda x: NOT list_contains(a, x)), ',') AS merged FROM li", LISTS))(lambda c: lists(c).select("user_id", F.array_join(F.concat("a", F.array_except(F.array_distinct("b"), "a")).cast("array<string>"), ",").alias("merged")))
query("bookmark_toggle", with_views("SELECT user_id, array_to_string(CASE WHEN list_contains(a, 7) THEN list_filter(a, lambda x: x <> 7) ELSE a || [7] END, ',') AS toggled FROM li", LISTS))(
    lambda c: lists(c).select("user_id", F.array_join(F.when(F.array_contains("a", F.lit(7).cast("long")), F.array_remove("a", F.lit(7).cast("long"))).otherwise(F.concat("a", F.array(F.lit(7).cast("long")))).cast("array<string>"), ",").alias("toggled"))
)
query("bookmark_import", with_views("SELECT user_id, len(list_filter([3, 7, 60], lambda x: NOT list_contains(a, x)))::INTEGER AS imported, (len(a) + len(list_filter([3, 7, 60], lambda x: NOT list_contains(a, x))))::INTEGER AS total FROM li", LISTS))(
    lambda c: lists(c).select("user_id", F.from_json(F.to_json("b"), "array<bigint>").alias("b"), "a").select("user_id", F.size(F.array_except("b", "a")).alias("imported"), (F.size("a") + F.size(F.array_except("b", "a"))).alias("total"))
)
query("history_mru", "SELECT user_id, item, rank FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY used DESC, item)::INTEGER AS rank FROM (SELECT user_id, event_id % 40 AS item, max(ts) AS used FROM events GROUP BY ALL)) WHERE rank <= 20")(
    lambda c: I.latest_first(c.table("events").select("user_id", (F.col("event_id") % 40).alias("item"), "ts"), "user_id", "item", "ts").select("user_id", "item", "rank")
)
query("debounce", "SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR (epoch_us(nxt) - epoch_us(ts)) / 1000.0 >= 300")(lambda c: L.debounced(c.table("events"), "user_id", "ts", 300).select("event_id"))
LIMIT = 2
query("rate_limit", f"""WITH RECURSIVE h AS (SELECT user_id::VARCHAR AS key, event_id AS hit, epoch_us(ts) / 1e6::DOUBLE AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT key, hit, ts, n, [ts] AS log, true AS admitted, NULL::DOUBLE AS retry_after FROM h WHERE n = 1
    UNION ALL SELECT key, hit, ts, n, CASE WHEN len(f) < {LIMIT} THEN f || [ts] ELSE f END, len(f) < {LIMIT}, CASE WHEN len(f) >= {LIMIT} THEN round(f[1] + 60 - ts, 6) END
    FROM (SELECT h.*, list_filter(r.log, lambda t: t > h.ts - 60) AS f FROM r JOIN h ON h.key = r.key AND h.n = r.n + 1))
  SELECT key, hit, ts, admitted, retry_after FROM r""")(lambda c: L.rate_limited(c.table("events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("hit"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts")), LIMIT))
query("page_math", with_views("SELECT id, greatest(1, ceil(id / 20.0))::BIGINT AS pages, lpad((id % 10000)::VARCHAR, 4, '0') AS padded, (id % 7) * 20 + 1 AS first_rank FROM paper"))(
    lambda c: c.paper.select("id", F.greatest(F.lit(1), F.ceil(F.col("id") / 20)).cast("long").alias("pages"), F.lpad((F.col("id") % 10000).cast("string"), 4, "0").alias("padded"), ((F.col("id") % 7) * 20 + 1).alias("first_rank"))
)
query("scope_latest", with_views("SELECT id, round((id * 137.508e0) % 360, 6) AS angle, round(0.3e0 + (idx * 0.16e0) % 0.62e0, 6) AS radius FROM (SELECT id, row_number() OVER (ORDER BY publication_year DESC, id DESC) - 1 AS idx FROM paper) WHERE idx < 12"))(
    lambda c: S.ranked(c.paper.orderBy(F.desc("publication_year"), F.desc("id")).limit(12), F.desc("publication_year"), F.desc("id"), name="idx").select("id", F.round((F.col("id") * 137.508) % 360, 6).alias("angle"), F.round(0.3 + ((F.col("idx") - 1) * 0.16) % 0.62, 6).alias("radius"))
)
query("backoff_schedule", with_views("SELECT topic, ord, (ord % 9)::INTEGER AS failures, least(300 * pow(2, least(ord % 9, 5)), 3600)::DOUBLE AS wait_s FROM works"))(
    lambda c: c.works.select("topic", "ord", (F.col("ord") % 9).cast("int").alias("failures")).withColumn("wait_s", U.retry_waits(F.col("failures")))
)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page(Corpus(spark, sf_dir), S.Request(q=Q))
