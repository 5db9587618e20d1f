"""Idempotent ingest as DataFrame plans: normalise, deduplicate, verify links, upsert, dead letters, watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

CORPUS_MIN, CORPUS_MAX = 300, 500
RUNG_ENOUGH = 200
RUNGS = tuple(f"{y}-01-01" for y in range(2023, 2017, -1))
RECOVERY_LIMIT = 20


def normalized(works: DataFrame) -> DataFrame:
    """Works with title, openalex_id, abstract, year, citations, authors and ``skip``: why a work can't be kept
    (title first), else null. A year that is missing or no number can't be stored either."""
    key = F.nullif(F.element_at(F.split("id", "/"), -1), F.lit(""))
    title = F.nullif(T.strip(F.col("display_name")), F.lit(""))
    year = F.coalesce(F.nullif(F.col("publication_year"), F.lit(0)), F.expr("try_cast(substring(publication_date, 1, 4) AS int)"))
    skip = F.when(title.isNull(), "missing title").when(key.isNull(), "missing openalex_id").when(year.isNull(), "missing year")
    author = lambda a: F.struct(F.coalesce(F.element_at(F.split(a["author"]["id"], "/"), -1), F.lit("")).alias("openalex_id"), F.coalesce(T.strip(a["author"]["display_name"]), F.lit("")).alias("name"))
    authors = F.transform(F.coalesce("authorships", F.array().cast(works.schema["authorships"].dataType)), author)
    return works.select("topic", "ord", key.alias("openalex_id"), title.alias("title"), T.rebuilt_abstract(F.col("abstract_inverted_index")).alias("abstract"), authors.alias("authors"), year.alias("publication_year"), F.coalesce("cited_by_count", F.lit(0)).cast("long").alias("cited_by_count"), "doi", "landing_pages", skip.alias("skip"))


def deduplicated(works: DataFrame) -> DataFrame:
    """One row per openalex_id: its first record (topic, then arrival), and the union of its topics."""
    kept = normalized(works).where("skip is null")
    first = F.min(F.struct("topic", "ord", "title", "abstract", "publication_year", "cited_by_count", "doi", "authors")).alias("x")
    return kept.groupBy("openalex_id").agg(first, F.array_join(F.array_sort(F.collect_set("topic")), "|").alias("topics")).select("openalex_id", "x.title", "x.abstract", "x.publication_year", "x.cited_by_count", "x.doi", "x.authors", "topics")


def dead_letters(works: DataFrame) -> DataFrame:
    bad = normalized(works).where("skip is not null")
    return bad.select("topic", "ord", "openalex_id", "doi", F.lit("normalize_skip").alias("reason"), F.col("skip").alias("error_detail"), F.lit(1).alias("attempts"), F.lit("pending").alias("status"))


def landing_candidates(works: DataFrame) -> DataFrame:
    """``candidates``: stripped http(s) landing pages in order, then such a doi, without repeats; preprint servers first in ``ordered``."""
    urls = F.transform(F.concat(F.coalesce("landing_pages", F.array().cast("array<string>")), F.array("doi")), T.strip)
    every = F.array_distinct(F.filter(urls, lambda x: F.coalesce(x.startswith("http://") | x.startswith("https://"), F.lit(False))))
    first = lambda x: x.contains("arxiv.org") | x.contains("10.48550")
    return works.withColumn("candidates", every).withColumn("ordered", F.concat(F.filter("candidates", first), F.filter("candidates", lambda x: ~first(x))))


def resolved(works: DataFrame, url_status: DataFrame) -> DataFrame:
    """``new_doi`` and ``dropped``: a dead doi is replaced by its first live candidate, or the work is dropped."""
    states = url_status.select("url", T.classify_status(F.col("status")).alias("state"))
    own = landing_candidates(works).join(states.select(F.col("url").alias("doi"), F.col("state").alias("doi_state")), "doi", "left")
    dead = own.where("doi_state = 'dead'").select("topic", "ord", "doi", F.posexplode("ordered").alias("at", "url"))
    live = dead.where("url <> doi").join(states.where("state = 'ok'").select("url"), "url").groupBy("topic", "ord").agg(F.min_by("url", "at").alias("mirror"))
    out = own.join(live, ["topic", "ord"], "left")
    is_dead = F.coalesce(F.col("doi_state") == "dead", F.lit(False))
    return out.withColumn("new_doi", F.when(is_dead, F.col("mirror")).otherwise(F.nullif(T.strip(F.col("doi")), F.lit("")))).withColumn("dropped", is_dead & F.col("mirror").isNull()).withColumn("replaced", is_dead & F.col("mirror").isNotNull())


def verified(works: DataFrame, url_status: DataFrame) -> DataFrame:
    """Works kept after link checking; a dropped work stays if another copy of its id is kept."""
    r = resolved(works, url_status)
    kept = r.where(~F.col("dropped")).select("id").distinct()
    return r.join(kept, "id", "left_semi").withColumn("doi", F.when(F.col("dropped"), F.col("doi")).otherwise(F.col("new_doi")))


def upserted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All papers after an upsert by openalex_id, with ``action``: new, updated or kept. Of incoming rows that
    repeat an id the least counts, so that a paper stays one row."""
    cols = ("title", "abstract", "publication_year", "doi", "cited_by_count")
    once = incoming.groupBy("openalex_id").agg(F.min(F.struct(*cols)).alias("x")).select("openalex_id", "x.*")
    e, i = existing.alias("e"), once.alias("i")
    both = e.join(i, F.col("e.openalex_id") == F.col("i.openalex_id"), "full_outer")
    action = F.when(F.col("e.openalex_id").isNull(), "new").when(F.col("i.openalex_id").isNull(), "kept").otherwise("updated")
    picked = [F.when(F.col("i.openalex_id").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in cols]
    return both.select(F.coalesce("e.openalex_id", "i.openalex_id").alias("openalex_id"), *picked, action.alias("action"))


def touched(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming papers that are new or whose title or abstract changes; other changes don't touch."""
    e = existing.select("openalex_id", F.col("title").alias("__t"), F.col("abstract").alias("__a"), F.lit(True).alias("__old"))
    j = incoming.join(e, "openalex_id", "left")
    return j.where(F.col("__old").isNull() | ~F.col("title").eqNullSafe(F.col("__t")) | ~F.col("abstract").eqNullSafe(F.col("__a"))).drop("__t", "__a", "__old")


def missing(new: DataFrame, existing: DataFrame, *keys: str, first: str | None = None) -> DataFrame:
    """Rows of ``new`` whose keys ``existing`` lacks, one per key: the one that is least by ``first``, else by its other columns."""
    rest = [c for c in new.columns if c not in keys]
    order = [first, *(c for c in rest if c != first)] if first else rest
    once = new.groupBy(*keys).agg(F.min(F.struct(*order)).alias("x")).select(*keys, *(f"x.{c}" for c in rest)) if rest else new.distinct()
    return once.join(existing.select(*keys), list(keys), "left_anti")


def date_ladder(works: DataFrame, enough: int = RUNG_ENOUGH, rungs: tuple[str, ...] = RUNGS) -> DataFrame:
    """(topic, rung, n): the first date bound with enough works, else the last bound."""
    counts = works.groupBy("topic").agg(*[F.count_if(F.col("publication_date") >= r).alias(r) for r in rungs])
    rows = F.array(*(F.struct(F.lit(r).alias("rung"), F.col(f"`{r}`").alias("n")) for r in rungs))
    good = F.filter(rows, lambda x: x["n"] >= enough)
    best = F.coalesce(F.get(good, 0), F.get(rows, len(rungs) - 1))
    return counts.select("topic", best["rung"].alias("rung"), best["n"].alias("n"))


def replayed(dlq: DataFrame, limit: int = 20, topic: str | None = None) -> DataFrame:
    """The dead-letter table after a replay: the oldest pending rows are marked retried."""
    pending = dlq.where("status = 'pending'")
    pending = pending.where(F.col("topic") == topic) if topic else pending
    due = pending.orderBy("created_at", "id").limit(limit).select("id", F.lit(True).alias("__due"))
    out = dlq.join(F.broadcast(due), "id", "left")
    hit = F.coalesce("__due", F.lit(False))
    return out.withColumn("attempts", F.col("attempts") + hit.cast("int")).withColumn("status", F.when(hit, "retried").otherwise(F.col("status"))).drop("__due")


def guard(n: int, least: int = CORPUS_MIN, most: int = CORPUS_MAX) -> None:
    """A full ingest publishes nothing unless its corpus has a plausible size."""
    if not least <= n <= most:
        raise ValueError(f"{n} papers: expected {least} to {most}")


def boot_action(papers: int) -> str:
    return "skip" if papers else "ingest"


def recovered(papers: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """``abstract`` and ``abstract_source`` from the first source (name, (doi, found)) with text, for papers with a doi."""
    out, found, tag = papers, F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, rows) in enumerate(sources):
        text = F.nullif(T.strip(F.col("found")), F.lit(""))
        out = out.join(rows.select(T.bare_doi(F.col("doi")).alias("__key"), text.alias(f"__{k}")).withColumnRenamed("__key", f"__key{k}"), T.bare_doi(F.col("doi")) == F.col(f"__key{k}"), "left")
        tag = F.coalesce(tag, F.when(F.col(f"__{k}").isNotNull(), name))
        found = F.coalesce(found, F.col(f"__{k}"))
    out = out.withColumn("found", found).withColumn("found_source", tag)
    return out.drop(*[f"__{k}" for k in range(len(sources))], *[f"__key{k}" for k in range(len(sources))])


def latest_first(df: DataFrame, key: str, item: str, at: str, cap: int = 20) -> DataFrame:
    """Most recently used items of each key: each item once at its latest time, at most ``cap``."""
    last = df.groupBy(key, item).agg(F.max(at).alias(at))
    order = Window.partitionBy(key).orderBy(F.desc(at), F.asc(item))
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
