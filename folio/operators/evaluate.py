"""Retrieval quality: MRR, NDCG, pooled recall and wins over ranked result lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import search as S
from folio.plans.corpus import Corpus

NDCG_K, RECALL_K = 10, 20
MODES = ("legacy", "ranked", "hybrid")
#: Queries and their relevant substrings over the test corpus.
QRELS = (("q1", "this from", ("this",)), ("q2", "with", ("with", "that")), ("q3", "que", ("que", "para")))


def best(rows: DataFrame, most: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of each query, numbered; each task sends at most so many of a query."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col(name) <= most)


def loaded(rows: DataFrame) -> tuple:
    """Judgements (see ``read_qrels``) as (qid, q, relevant substrings, year, author), in the order of qid; a set of queries is small."""
    return tuple((r.qid, r.q, tuple(r.relevant_substrings), r.year, r.author) for r in rows.orderBy("qid").collect())


def _parts(qrel: tuple) -> tuple:
    """(qid, q, relevant substrings, year, author) of a judgement, whose last two may be left out."""
    return (*qrel, None, None)[:5]


def accepted(qrels=QRELS) -> tuple[tuple, list[str]]:
    """The judgements that can be searched for, and a warning for each other one, which counts as an empty list."""
    fit, warnings = [], []
    for qid, q, subs, year, author in map(_parts, qrels):
        try:
            S.Request(q=q, mode="hybrid", year=year, author=author, page_size=RECALL_K).validate()
        except ValueError as error:
            warnings.append(f"{qid}: {error}, treated as empty")
        else:
            fit.append((qid, q, subs, year, author))
    return tuple(fit), warnings


def _filterable(c: Corpus, qrels: tuple) -> DataFrame:
    """Papers with ``__by``: which of the judgements' authors wrote them."""
    names = sorted({author for *_, author in qrels if author})
    if not names:
        return c.paper.withColumn("__by", F.array().cast("array<string>"))
    said = F.array_compact(F.array(*(F.when(T.contains_any_case(F.col("name"), x), F.lit(x)) for x in names)))
    people = c.author.select(F.col("id").alias("author_id"), F.explode(said).alias("__name"))
    by = c.paper_author.join(people, "author_id").groupBy(F.col("paper_id").alias("id")).agg(F.collect_set("__name").alias("__by"))
    return c.paper.join(by, "id", "left")


def _passes_filters(year: int | None, author: str | None) -> Column:
    of_year = F.lit(True) if year is None else F.col("publication_year") == year
    return F.coalesce(of_year & (F.array_contains("__by", author) if author else F.lit(True)), F.lit(False))


def runs(c: Corpus, qrels=QRELS, dim: int = 64) -> DataFrame:
    """(qid, mode, rank, id, title) of the first page of every query in every mode, in one pass over the corpus for each list.

    A judgement's year and author filter before ranking; one that can't be searched for (see ``accepted``) has no rows.
    """
    fit, _ = accepted(qrels)
    if not fit:
        return c.paper.select(F.lit("").alias("qid"), F.lit("").alias("mode"), F.lit(0).alias("rank"), "id", "title").limit(0)
    queries = {qid: q for qid, q, *_ in fit}
    some = any(year is not None or author for *_, year, author in fit)
    papers = _filterable(c, fit) if some else c.paper
    passes = {qid: _passes_filters(year, author) if some else F.lit(True) for qid, _, _, year, author in fit}
    allowed = reduce(lambda a, x: a | ((F.col("qid") == x[0]) & x[1]), passes.items(), F.lit(False))
    own = lambda rows: rows.where(allowed) if some else rows
    newest = (F.desc("publication_year"), F.desc("id"))
    said = F.explode(F.array_compact(F.array(*(F.when(S.substring_match(q) & passes[qid], F.lit(qid)) for qid, q in queries.items())))).alias("qid")
    legacy = best(papers.select("id", "title", "publication_year", said), RECALL_K, *newest)
    scores = own(S.sparse(c, papers, queries))
    ranked = best(scores, RECALL_K, F.desc("score"), *newest)
    sparse = best(scores.select("qid", "id", "score"), S.WINDOW, F.desc("score"), F.asc("id"), name="sparse_rank")
    probes = F.explode(F.array(*(F.struct(F.lit(qid).alias("qid"), F.array(*map(F.lit, S.query_vector(q, dim))).alias("v")) for qid, q in queries.items()))).alias("p")
    vectors = c.paper_embedding.withColumnRenamed("paper_id", "id")
    vectors = vectors.join(papers.select("id", "publication_year", "__by"), "id") if some else vectors
    near = own(vectors.select("*", probes).withColumn("qid", F.col("p.qid"))).select("id", "qid", F.round(T.cosine(F.col("embedding"), F.col("p.v")), 6).alias("sim")).where("sim is not null")
    dense = best(near, S.WINDOW, F.desc("sim"), F.asc("id"), name="dense_rank")
    both = dense.select("qid", "id", "dense_rank").join(sparse.select("qid", "id", "sparse_rank"), ["qid", "id"], "full_outer").withColumn("rrf", S.rrf())
    hybrid = best(both, RECALL_K, *S.fused_order()).join(c.paper.select("id", "title"), "id")  # at most RECALL_K ids a query
    shown = lambda rows, mode: rows.select("qid", F.lit(mode).alias("mode"), "rank", "id", "title")
    return shown(legacy, "legacy").union(shown(ranked, "ranked")).union(shown(hybrid, "hybrid"))


def asked(spark: SparkSession, qrels=QRELS) -> DataFrame:
    """(qid, mode) of every query in every mode, whether it finds anything or not."""
    return spark.createDataFrame([(qid, mode) for qid, *_ in qrels for mode in MODES], "qid string, mode string")


def relevance(results: DataFrame, qrels=QRELS) -> DataFrame:
    """Results with ``rel``: the title (the results hold no abstract) has a relevant substring, whatever its case."""
    subs = results.sparkSession.createDataFrame([(qid, list(s)) for qid, _, s, *_ in qrels], "qid string, subs array<string>")
    hit = F.exists("subs", lambda s: F.contains(F.lower("title"), F.lower(s)))
    return results.join(F.broadcast(subs), "qid").withColumn("rel", hit.cast("int")).drop("subs")


def markdown(card: DataFrame) -> str:
    """The scorecard, one row per mode, as a Markdown table."""
    lines = ["| mode | MRR | NDCG@10 | recall@20 | wins |", "|---|---|---|---|---|"]
    return "\n".join(lines + [f"| {r['mode']} | {r['mrr']:.3f} | {r['ndcg']:.3f} | {r['recall']:.3f} | {r['wins']} |" for r in card.orderBy("mode").collect()])


def per_query(judged: DataFrame, qrels=QRELS) -> DataFrame:
    """(qid, mode, mrr, ndcg, recall, win) of every query and mode; without results all are 0, and all modes win where the best is 0."""
    gain = 1 / F.log2(F.col("rank") + 1)
    top = F.col("rank") <= NDCG_K
    pool = judged.where("rel = 1").groupBy("qid").agg(F.countDistinct("id").alias("pool"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n10"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    base = judged.groupBy("qid", "mode").agg(
        F.coalesce(F.max(F.when(F.col("rel") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(top & (F.col("rel") == 1), gain)), F.lit(0.0)).alias("dcg"),
        F.count_if(top & (F.col("rel") == 1)).cast("int").alias("n10"),
        F.count_if(F.col("rel") == 1).alias("found"),
    )
    base = asked(judged.sparkSession, qrels).join(base, ["qid", "mode"], "left").fillna(0, ["mrr", "dcg", "n10", "found"])
    ndcg = F.when(F.col("n10") > 0, F.col("dcg") / ideal).otherwise(0.0)
    out = base.join(F.broadcast(pool), "qid", "left").withColumn("ndcg", F.round(ndcg, 6)).withColumn("recall", F.round(F.coalesce(F.col("found") / F.col("pool"), F.lit(0.0)), 6)).withColumn("mrr", F.round("mrr", 6))
    best = F.max("ndcg").over(Window.partitionBy("qid"))
    return out.withColumn("win", (F.col("ndcg") == best).cast("int")).select("qid", "mode", "mrr", "ndcg", "recall", "win")


def scorecard(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("mode").agg(F.round(F.avg("mrr"), 5).alias("mrr"), F.round(F.avg("ndcg"), 5).alias("ndcg"), F.round(F.avg("recall"), 5).alias("recall"), F.sum("win").alias("wins"))


def degraded(results: DataFrame, qrels=QRELS) -> DataFrame:
    """(qid, degraded): all modes give the same list, an empty one included, so ranking fell back to one mode."""
    lists = results.groupBy("qid", "mode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))
    every = asked(results.sparkSession, qrels).join(lists, ["qid", "mode"], "left").fillna("", ["ids"])
    return every.groupBy("qid").agg((F.countDistinct("ids") == 1).alias("degraded"))


def passes(card: DataFrame, metric: str, threshold: float | None) -> bool:
    """Whether the best mode reaches the threshold; three rows come to the driver."""
    return threshold is None or max((r[metric] for r in card.collect()), default=0.0) >= threshold
