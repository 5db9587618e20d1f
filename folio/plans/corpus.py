"""The bibliographic views over the input tables, as DataFrames and as the same CTEs in SQL."""

from __future__ import annotations

from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from folio.operators.grams import GramIndex
    from folio.operators.index import Index
    from folio.operators.vectors import VectorIndex


class Corpus:
    """Lazy views of one input folder. Every view is a plan; nothing is read before an action.

    Stored indexes, if set, are read instead of whole tables: ``index`` by BM25, ``grams`` by substring search,
    both instead of the texts of ``paper``, and ``vectors`` by vector search instead of ``paper_embedding``
    (``exact``: with the same result, else with nearly the same).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, index: Index | None = None, grams: GramIndex | None = None, vectors: VectorIndex | None = None, exact: bool = True):
        self.spark, self.sf_dir, self.index, self.grams, self.vectors, self.exact = spark, sf_dir, index, grams, vectors, exact

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def paper(self) -> DataFrame:
        doi = F.when(F.col("doc_id") % 13 != 0, F.concat(F.lit("https://doi.org/10."), (1000 + F.col("doc_id") % 20).cast("string"), F.lit("/"), F.col("doc_id").cast("string")))
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("openalex_id"),
            F.substring("text", 1, 80).alias("title"),
            F.when(F.col("doc_id") % 9 != 0, F.nullif(F.expr("substr(text, 81)"), F.lit(""))).alias("abstract"),
            (2015 + F.col("doc_id") % 11).cast("int").alias("publication_year"),
            doi.alias("doi"),
            F.col("n_chars").cast("long").alias("cited_by_count"),
            "lang",
            "source",
        )

    @cached_property
    def author(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))

    @cached_property
    def paper_author(self) -> DataFrame:
        n = self.author.agg(F.count(F.lit(1)).alias("n"))  # one row
        keys = F.explode(F.array_distinct(F.array(F.col("id") % F.col("n"), (F.col("id") * 7 + 3) % F.col("n"))))
        return self.paper.where("id % 10 <> 0").select("id").join(F.broadcast(n)).select(F.col("id").alias("paper_id"), keys.alias("author_id"))

    @cached_property
    def paper_topic(self) -> DataFrame:
        return self.paper.select(F.col("id").alias("paper_id"), F.explode(F.array_distinct(F.array("lang", "source"))).alias("slug"))

    @cached_property
    def paper_embedding(self) -> DataFrame:
        vectors = self.table("embeddings").select(F.col("vec_id").cast("long").alias("paper_id"), "embedding")
        return vectors.join(self.paper.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")

    @cached_property
    def works(self) -> DataFrame:
        """Upstream records of two topics: t1 has every paper, t2 those with an even id; ``ord`` is arrival order."""
        p = self.paper
        words = F.filter(F.split("title", " "), lambda x: x != "")
        index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
        writer = lambda n: F.struct(F.struct(F.concat(F.lit("https://works.example/A"), (p.id % n).cast("string")).alias("id"), F.concat(F.lit(" Author "), (p.id % n).cast("string")).alias("display_name")).alias("author"))
        base = p.select(
            F.concat(F.lit("https://works.example/"), "openalex_id").alias("id"),
            F.when(p.id % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("title"))).alias("display_name"),
            F.when(p.id % 7 == 0, F.lit(0)).otherwise(F.col("publication_year")).alias("publication_year"),
            F.concat((2016 + p.id % 9).cast("string"), F.lit("-0"), (1 + p.id % 9).cast("string"), F.lit("-01")).alias("publication_date"),
            F.when(p.id % 5 != 0, F.col("cited_by_count")).alias("cited_by_count"),
            "doi",
            F.when(p.id % 3 == 0, F.array(F.concat(F.lit("https://arxiv.org/abs/2101."), F.lpad((p.id % 10000).cast("string"), 5, "0"), F.when(p.id % 6 == 0, "v2").otherwise("")), "doi"))
            .when(p.id % 3 == 1, F.array(F.lit("ftp://x/y"), F.concat(F.lit("https://mirror.example/"), p.id.cast("string"))))
            .otherwise(F.array().cast("array<string>"))
            .alias("landing_pages"),
            F.concat((2017 + p.id % 8).cast("string"), F.lit("-0"), (1 + p.id % 7).cast("string"), F.lit("-15")).alias("updated_date"),
            index.alias("abstract_inverted_index"),
            F.array(writer(12), writer(7)).alias("authorships"),
            p.id.alias("ord"),
        )
        return base.withColumn("topic", F.lit("t1")).union(base.where("ord % 2 = 0").withColumn("topic", F.lit("t2")))

    @cached_property
    def url_status(self) -> DataFrame:
        """Status of every doi and mirror: a stand-in for a network probe."""
        urls = self.paper.select(F.explode(F.array("doi", F.concat(F.lit("https://mirror.example/"), F.col("id").cast("string")))).alias("url"), "id").where("url is not null")
        status = F.when(F.col("id") % 11 == 0, 404).when(F.col("id") % 19 == 0, 410).when(F.col("id") % 23 == 0, 503).otherwise(200)
        return urls.select("url", F.when(F.col("url").startswith("https://mirror") & (F.col("id") % 2 == 0), 200).otherwise(status).cast("int").alias("status"))


#: The same views in DuckDB SQL, by name and in order.
CTES = {
    "paper": """SELECT doc_id AS id, 'W' || doc_id AS openalex_id, substr(text, 1, 80) AS title,
        CASE WHEN doc_id % 9 <> 0 THEN nullif(substr(text, 81), '') END AS abstract, (2015 + doc_id % 11)::INTEGER AS publication_year,
        CASE WHEN doc_id % 13 <> 0 THEN 'https://doi.org/10.' || (1000 + doc_id % 20) || '/' || doc_id END AS doi, n_chars::BIGINT AS cited_by_count, lang, source FROM documents""",
    "author": "SELECT s_suppkey::BIGINT AS id, s_name AS name FROM supplier",
    "paper_author": "SELECT DISTINCT id AS paper_id, unnest([id % n, (id * 7 + 3) % n]) AS author_id FROM paper, (SELECT count(*) AS n FROM author) WHERE id % 10 <> 0",
    "paper_topic": "SELECT DISTINCT id AS paper_id, unnest([lang, source]) AS slug FROM paper",
    "paper_embedding": "SELECT vec_id::BIGINT AS paper_id, embedding FROM embeddings WHERE vec_id IN (SELECT id FROM paper)",
    "base": """SELECT 'https://works.example/' || openalex_id AS id, CASE WHEN id % 17 = 0 THEN '  ' ELSE ' ' || title END AS display_name,
        CASE WHEN p.id % 7 = 0 THEN 0 ELSE publication_year END AS publication_year, (2016 + p.id % 9) || '-0' || (1 + p.id % 9) || '-01' AS publication_date,
        CASE WHEN p.id % 5 <> 0 THEN cited_by_count END AS cited_by_count, doi,
        CASE WHEN p.id % 3 = 0 THEN ['https://arxiv.org/abs/2101.' || lpad((p.id % 10000)::VARCHAR, 5, '0') || CASE WHEN p.id % 6 = 0 THEN 'v2' ELSE '' END, doi]
             WHEN p.id % 3 = 1 THEN ['ftp://x/y', 'https://mirror.example/' || p.id] ELSE []::VARCHAR[] END AS landing_pages,
        (2017 + p.id % 8) || '-0' || (1 + p.id % 7) || '-15' AS updated_date, nullif(array_to_string(list_filter(string_split(title, ' '), lambda x: x <> ''), ' '), '') AS abstract,
        'A' || (p.id % 12) || ':Author ' || (p.id % 12) || '|A' || (p.id % 7) || ':Author ' || (p.id % 7) AS authors, p.id AS ord FROM paper p""",
    "works": "SELECT *, 't1' AS topic FROM base UNION ALL SELECT *, 't2' AS topic FROM base WHERE ord % 2 = 0",
    "url_status": """SELECT url, CASE WHEN starts_with(url, 'https://mirror') AND id % 2 = 0 THEN 200 WHEN id % 11 = 0 THEN 404 WHEN id % 19 = 0 THEN 410 WHEN id % 23 = 0 THEN 503 ELSE 200 END::INTEGER AS status
        FROM (SELECT unnest([doi, 'https://mirror.example/' || id]) AS url, id FROM paper) WHERE url IS NOT NULL""",
}


def with_views(sql: str, *more: str) -> str:
    """``sql`` after the views' CTEs and any further CTEs."""
    return "WITH " + ", ".join([*(f"{k} AS ({v})" for k, v in CTES.items()), *more]) + " " + sql
