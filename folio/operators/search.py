"""Search over papers: substring, BM25 and hybrid retrieval with conjunctive filters and paging.

Filters always come before ranking. BM25 needs one row of statistics (documents, average field
lengths, document frequency of each query term), counted over the unfiltered corpus and broadcast;
term frequencies are counted inside each row, so scoring shuffles nothing. A corpus with a stored index (see ``index``) is
scored from the postings of the query's terms instead. Top-k lists are at most WINDOW rows. Authors are attached to a page only after its ids are ranked and cut.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.plans.corpus import Corpus

K1, B = 1.2, 0.75
RRF_K, WINDOW = 60, 100
MAX_IDS, MAX_PAGE_SIZE, MAX_QUERY = 100, 100, 200


def parse_ids(raw: str | None) -> list[int] | None:
    """Integers of a comma list, first ones first, without repeats, at most MAX_IDS; None without a list."""
    if raw is None:
        return None
    out: dict[int, None] = {}
    for part in raw.split(","):
        if len(out) == MAX_IDS:
            break
        try:
            out[int(part.strip())] = None
        except ValueError:
            continue
    return list(out)


@dataclass(frozen=True)
class Request:
    q: str | None = None
    mode: str = "legacy"
    year: int | None = None
    topic: str | None = None
    author: str | None = None
    ids: str | None = None
    page: int = 1
    page_size: int = 20

    def validate(self) -> None:
        if self.mode not in ("legacy", "ranked", "hybrid"):
            raise ValueError("mode must be legacy, ranked or hybrid")
        if self.mode != "legacy" and not self.q:
            raise ValueError(f"{self.mode} search needs a query")
        if self.page < 1 or not 1 <= self.page_size <= MAX_PAGE_SIZE or len(self.q or "") > MAX_QUERY:
            raise ValueError("page, page_size or query is out of range")


def filtered(c: Corpus, r: Request) -> DataFrame:
    """Papers that pass the year, topic, author and id filters."""
    out = c.paper
    ids = parse_ids(r.ids)
    if ids is not None:
        out = out.where(F.col("id").isin(ids) if ids else F.lit(False))
    if r.year is not None:
        out = out.where(F.col("publication_year") == r.year)
    if r.topic:
        out = out.join(c.paper_topic.where(F.col("slug") == r.topic), F.col("id") == F.col("paper_id"), "left_semi")
    if r.author:
        named = c.author.where(T.contains_any_case(F.col("name"), r.author)).select(F.col("id").alias("author_id"))
        out = out.join(c.paper_author.join(named, "author_id", "left_semi"), F.col("id") == F.col("paper_id"), "left_semi")
    return out


def substring_match(q: str) -> Column:
    """Every term of q is in the title or the abstract, whatever its case."""
    terms = [T.contains_any_case(F.col("title"), t) | F.coalesce(T.contains_any_case(F.col("abstract"), t), F.lit(False)) for t in q.split()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def query_terms(q: str) -> list[str]:
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", q.lower())))


FIELDS = ("title", "abstract")


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def with_counts(papers: DataFrame, corpus: DataFrame, terms: list[str]) -> DataFrame:
    """``papers`` with what BM25 needs: each field's length and how often it has each term, and one row of
    statistics over ``corpus``. Every text is split into tokens once, for all terms."""

    def counted(rows: DataFrame, *keep: str) -> DataFrame:
        split = rows.select(*keep, T.held(**{f"__t_{f}": T.tokens(F.col(f)) for f in FIELDS}))
        counts = {f"__len_{f}": F.size(f"__t_{f}") for f in FIELDS}
        counts |= {f"__tf_{f}_{k}": F.size(F.filter(f"__t_{f}", _equals(t))) for f in FIELDS for k, t in enumerate(terms)}
        return split.select(*keep, T.held(**counts))

    stats = [F.count(F.lit(1)).alias("__n")]
    for f in FIELDS:
        stats.append(F.avg(f"__len_{f}").alias(f"__avg_{f}"))
        stats += [F.count_if(F.col(f"__tf_{f}_{k}") > 0).alias(f"__df_{f}_{k}") for k in range(len(terms))]
    return counted(papers, *papers.columns).join(F.broadcast(counted(corpus).agg(*stats)))


def part_of_score(df: Column, docs: Column, tf: Column, length: Column, mean: Column) -> Column:
    """What a term that a field has ``tf`` times adds to a paper's BM25 score; ``mean`` is null or 0 where no paper has a token."""
    idf = F.log(1 + (docs - df + 0.5) / (df + 0.5))
    share, n = F.coalesce(F.try_divide(length, mean), F.lit(0.0)), tf.cast("double")
    return idf * n * (K1 + 1) / (n + K1 * (1 - B + B * share))


def score_of(terms: list[str], chosen: list[str]) -> Column:
    """BM25 score, rounded to 6 places, for some of the counted terms; null for a paper that has none of them."""
    score, hit = F.lit(0.0), F.lit(False)
    for f in FIELDS:
        for k in (terms.index(t) for t in chosen):
            tf = F.col(f"__tf_{f}_{k}")
            score = score + part_of_score(F.col(f"__df_{f}_{k}"), F.col("__n"), tf, F.col(f"__len_{f}"), F.col(f"__avg_{f}"))
            hit = hit | (tf > 0)
    return F.when(hit, F.round(score, 6))


def bm25_many(papers: DataFrame, corpus: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(columns of ``papers``, qid, score): the papers that match each query, in one pass over the texts."""
    chosen = {qid: query_terms(q) for qid, q in queries.items()}
    terms = list(dict.fromkeys(t for own in chosen.values() for t in own))
    return scored(with_counts(papers, corpus, terms), papers.columns, terms, chosen)


def scored(counted: DataFrame, columns: list[str], terms: list[str], chosen: dict[str, list[str]]) -> DataFrame:
    """(``columns``, qid, score) of the papers that have a term of each query, from rows with all counts of ``terms``."""
    rows = F.array(*(F.struct(F.lit(qid).alias("qid"), score_of(terms, own).alias("score")) for qid, own in chosen.items()))
    return counted.select(*columns, F.explode(rows).alias("__x")).select(*columns, "__x.*").where("score is not null")


def sparse(c: Corpus, papers: DataFrame, queries: dict[str, str]) -> DataFrame:
    """``bm25_many`` over the corpus, from its stored index where it has one."""
    return c.index.bm25_many(papers, queries) if c.index else bm25_many(papers, c.paper, queries)


def bm25_scores(papers: DataFrame, corpus: DataFrame, q: str) -> DataFrame:
    """``papers`` that match a term of q in title or abstract, with their BM25 score rounded to 6 places."""
    return bm25_many(papers, corpus, {"": q}).drop("qid")


def dense(papers: DataFrame, vectors: DataFrame, vector: list[float]) -> DataFrame:
    """(id, sim) of the WINDOW papers nearest to a vector; a stored vector of another length is an error."""
    near = vectors.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    size = F.array_size("embedding")
    wrong = F.raise_error(F.concat(F.lit(f"the query's vector has {len(vector)} components, a stored one "), size.cast("string")))
    sim = F.when(size != len(vector), wrong).otherwise(F.round(T.cosine(F.col("embedding"), F.array(*map(F.lit, vector))), 6))
    return near.select(F.col("paper_id").alias("id"), sim.alias("sim")).where("sim is not null").orderBy(F.desc("sim"), "id").limit(WINDOW)


def nearest(c: Corpus, papers: DataFrame, vector: list[float], some: bool = True) -> DataFrame:
    """``dense`` over the corpus, from its vector index where it has one; ``some``: ``papers`` are not all papers."""
    if getattr(c, "vectors", None) is None:  # a corpus may also know nothing of vector indexes
        return dense(papers, c.paper_embedding, vector)
    return c.vectors.search(vector, WINDOW, papers if some else None, exact=c.exact)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rows of a bounded list numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rrf() -> Column:
    """Reciprocal rank fusion of dense_rank and sparse_rank, rounded to 12 places."""
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    return F.round(part("dense_rank") + part("sparse_rank"), 12)


def fused_order() -> tuple[Column, ...]:
    return F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc("sparse_rank")


def fuse(dense_list: DataFrame, sparse_list: DataFrame) -> DataFrame:
    """(id, dense_rank, sparse_rank, rrf, rank) of both lists' union by reciprocal rank fusion; ties keep dense order, then sparse order."""
    both = dense_list.select("id", "dense_rank").join(sparse_list.select("id", "sparse_rank"), "id", "full_outer")
    return ranked(both.withColumn("rrf", rrf()), *fused_order())


def query_vector(q: str, dim: int) -> list[float]:
    import hashlib

    raw = b"".join(hashlib.sha256(f"{q}#{r}".encode()).digest() for r in range(-(-dim // 32)))
    return [b / 255 * 2 - 1 for b in raw[:dim]]


def comparable(vector: list[float], dim: int) -> list[float]:
    """The components of a query's vector; an error unless they are ``dim`` finite numbers and not all 0."""
    out = [float(x) for x in vector]
    if len(out) != dim or not all(map(math.isfinite, out)) or not any(out):
        raise ValueError(f"a query's vector must have {dim} finite components, not all 0")
    return out


def hybrid_list(c: Corpus, r: Request, dim: int = 64, embed: Callable[[str, int], list[float]] | None = None) -> DataFrame:
    """Fusion of the nearest and the best-scored papers. What fails is raised, so that no part of the search passes for the whole.

    One exception: a given ``embed`` is a model that may be out of order. If it fails, a RuntimeWarning says so and the
    list has the best-scored papers alone. ``page``, ``total`` and the registered queries give none.
    """
    papers = filtered(c, r)
    best = sparse(c, papers, {"": r.q or ""}).select("id", "score").orderBy(F.desc("score"), "id").limit(WINDOW)
    try:
        vector = comparable((embed or query_vector)(r.q or "", dim), dim)
    except Exception as error:
        if embed is None:
            raise
        warnings.warn(f"hybrid search without its nearest papers, as the query can't be embedded: {error!r}", RuntimeWarning, stacklevel=2)
        near = papers.sparkSession.createDataFrame([], "id long, sim double")
    else:
        near = nearest(c, papers, vector, (r.year, r.topic, r.author, r.ids) != (None,) * 4)
    return fuse(
        ranked(near, F.desc("sim"), F.asc("id"), name="dense_rank"),
        ranked(best, F.desc("score"), F.asc("id"), name="sparse_rank"),
    )


def matches(c: Corpus, r: Request) -> DataFrame:
    """All matching papers; the ordering columns are in the rows."""
    r.validate()
    if r.mode == "hybrid":
        return c.paper.join(hybrid_list(c, r).select("id", "rank", "rrf"), "id")
    papers = filtered(c, r)
    if r.mode == "ranked":
        return sparse(c, papers, {"": r.q or ""}).drop("qid")
    if not r.q:
        return papers
    found = c.grams.candidates(r.q) if c.grams else None
    return (papers if found is None else papers.join(found, "id", "left_semi")).where(substring_match(r.q))


ORDERS = {
    "legacy": (F.desc, ("publication_year", "id")),
    "ranked": (F.desc, ("score", "publication_year", "id")),
    "hybrid": (F.asc, ("rank",)),
}


def page(c: Corpus, r: Request) -> DataFrame:
    """id, title, publication_year, authors (names in order, joined by |) of the requested page."""
    way, keys = ORDERS[r.mode]
    cut = matches(c, r).orderBy(*map(way, keys)).offset((r.page - 1) * r.page_size).limit(r.page_size)
    return with_authors(c, cut.select("id", "title", "publication_year"))


def total(c: Corpus, r: Request) -> DataFrame:
    """Matches in all; for hybrid search the size of the fused window."""
    r.validate()
    rows = hybrid_list(c, r) if r.mode == "hybrid" else matches(c, r)
    return rows.agg(F.count(F.lit(1)).alias("total"))


def with_authors(c: Corpus, papers: DataFrame) -> DataFrame:
    links = c.paper_author.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    names = links.join(c.author.withColumnRenamed("id", "author_id"), "author_id").groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("authors"))
    return papers.join(names.withColumnRenamed("paper_id", "id"), "id", "left").withColumn("authors", F.coalesce("authors", F.lit("")))


def detail(c: Corpus, paper_id: int) -> DataFrame:
    one = with_authors(c, c.paper.where(F.col("id") == paper_id).select("id", "openalex_id", "title", "abstract", "publication_year", "doi", "cited_by_count"))
    topics = c.paper_topic.where(F.col("paper_id") == paper_id).groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("slug")), "|").alias("topics"))
    return one.join(topics.withColumnRenamed("paper_id", "id"), "id", "left")


def similar(c: Corpus, paper_id: int, limit: int = 5) -> DataFrame:
    """Nearest papers of one paper: top ``limit`` first, then only positive scores, rounded to 4 places; none without a vector."""
    if c.vectors is not None:
        own = c.vectors.vector_of(paper_id)
        near = c.vectors.search(own, limit, exact=c.exact, other_than=paper_id) if own else c.spark.createDataFrame([], "id long, sim double")
        return near.where("sim > 0").join(c.paper.select("id", "title"), "id").select("id", "title", F.round("sim", 4).alias("score"))
    probe = c.paper_embedding.where(F.col("paper_id") == paper_id).select(F.col("embedding").alias("probe"))  # one row
    others = c.paper_embedding.where(F.col("paper_id") != paper_id).join(F.broadcast(probe))
    sim = others.select(F.col("paper_id").alias("id"), F.round(T.cosine(F.col("embedding"), F.col("probe")), 6).alias("sim")).where("sim is not null")
    best = sim.orderBy(F.desc("sim"), "id").limit(limit).where("sim > 0")
    return best.join(c.paper.select("id", "title"), "id").select("id", "title", F.round("sim", 4).alias("score"))


def bm25_stats(c: Corpus) -> DataFrame:
    """Document frequency of every token of each field, with the field's average length."""
    parts = []
    for f in ("title", "abstract"):
        tokens = c.paper.select(T.tokens(F.col(f)).alias("t"))
        mean = tokens.agg(F.round(F.avg(F.size("t")), 6).alias("avgdl"))
        df = tokens.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        parts.append(df.join(F.broadcast(mean)).select(F.lit(f).alias("field"), "term", "df", "avgdl"))
    return parts[0].union(parts[1])
