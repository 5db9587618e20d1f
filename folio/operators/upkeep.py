"""Upkeep of a stored corpus: seeding fixed papers, its topics, whether it can be read, and figures to watch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import runs as U
from folio.operators.store import Store

#: A paper to seed: an id of its own, names of its authors, slugs of its topics.
FIXTURE = "openalex_id string, title string, abstract string, publication_year int, authors array<string>, topics array<string>"


def seed(store: Store, fixtures: DataFrame) -> Row:
    """Publish the fixtures (see FIXTURE) that the store doesn't have yet, with links to authors and topics; (already, inserted).

    Papers that are there stay as they are, so a second call inserts none and publishes no version. Authors are found by
    name and topics by slug, and made where there is none. A fixture that is named twice is inserted once, with the
    smallest title; one without an id or title, and authors and topics that are null or blank, are left out. If
    another run publishes meanwhile, Conflict is raised and nothing is inserted. Ids come first: ``fixtures`` is read again,
    and must be as before, for the texts of those that are due.
    """
    attempt = store.begin()
    try:
        own = fixtures.where("openalex_id is not null and trim(title) <> ''")
        ids = attempt.keep(own.select("openalex_id").distinct(), "ids")
        there = attempt.read("paper", attempt.buckets_of(ids))
        due = ids.join(there.select("openalex_id"), "openalex_id", "left_anti")
        last = attempt.facts.get("last_id")
        if last is None:
            last = attempt.read("paper").agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).head()["m"]
        numbers = attempt.keep(U.numbered(due, "openalex_id", "id", last + 1), "numbers")
        total, inserted = ids.count(), numbers.count()
        if not inserted:
            attempt.abandon()
            return Row(already=total, inserted=0)
        first = F.min_by(F.struct("title", "abstract", "publication_year", "authors", "topics"), F.struct("title", "abstract", "publication_year")).alias("x")
        new = attempt.keep(own.join(numbers, "openalex_id").groupBy("openalex_id", "id").agg(first).select("openalex_id", "id", "x.*"), "seeded")
        clean = lambda names: F.array_distinct(F.filter(F.transform(names, T.strip), lambda x: x != ""))
        by = new.select("openalex_id", F.explode(clean(F.col("authors"))).alias("name"))
        about = new.select("openalex_id", F.explode(clean(F.col("topics"))).alias("slug"))
        known = attempt.read("author").join(by.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min("openalex_id").alias("known"))
        names = by.select("name").distinct().join(known, "name", "left").withColumn("author_id", F.coalesce("known", F.concat(F.lit("seed-"), F.sha2("name", 256))))
        names = attempt.keep(names, "names")
        slugs = about.select("slug").distinct().join(attempt.read("topic").select("slug"), "slug", "left_anti")
        columns = [F.col(n) if n in new.columns else F.lit(None).cast("string").alias(n) for n in ("id", "openalex_id", "title", "abstract", "publication_year", "doi")]
        rows = {
            "paper": new.select(*columns, F.lit(0).cast("long").alias("cited_by_count"), *(F.lit(None).cast("string").alias(n) for n in ("abstract_source", "abstract_recovered_at"))),
            "author": names.where("known is null").select(F.col("author_id").alias("openalex_id"), "name"),
            "topic": slugs.select("slug", F.lit(None).cast("string").alias("openalex_id"), F.col("slug").alias("name")),
            "paper_author": by.join(names, "name").select("openalex_id", "author_id"),
            "paper_topic": about.select("openalex_id", "slug"),
        }
        papers = attempt.facts.get("papers")
        papers = attempt.read("paper").count() if papers is None else papers
        attempt.publish(rows, {"last_id": last + inserted, "papers": papers + inserted})
        return Row(already=total - inserted, inserted=inserted)
    except BaseException:
        attempt.abandon()
        raise


def catalogue(topics: DataFrame, links: DataFrame) -> DataFrame:
    """(slug, name, papers) of every topic, also of those that no paper has; a link that is there twice counts once."""
    counts = links.distinct().groupBy("slug").agg(F.count(F.lit(1)).alias("papers"))
    return topics.select("slug", "name").join(counts, "slug", "left").fillna(0, ["papers"])


def gauges(t: U.Tables) -> DataFrame:
    """One row of figures to watch: papers, papers without abstract and of these with a doi, papers without vector, authors, topics, dead letters that wait."""
    missing = F.col("abstract").isNull()
    counts = t["paper"].agg(F.count(F.lit(1)).alias("papers"), F.count_if(missing).alias("no_abstract"), F.count_if(missing & F.col("doi").isNotNull()).alias("recoverable"))
    n = lambda rows, name: F.broadcast(rows.agg(F.count(F.lit(1)).alias(name)))
    without = t["paper"].join(t["paper_embedding"].select(F.col("paper_id").alias("id")), "id", "left_anti")
    for one in (n(without, "no_vector"), n(t["author"], "authors"), n(t["topic"], "topics"), n(t["ingest_dlq"].where("status = 'pending'"), "letters")):  # one row each
        counts = counts.crossJoin(one)
    return counts


def exposition(row: Row | None, seconds: float) -> str:
    """Figures as plain text for a scraper, each with its kind; without a row, when the store can't be read, only how long the process is up."""
    said = {"folio_uptime_seconds": f"{seconds:.3f}"} | {f"folio_{k}_total": str(v) for k, v in (row.asDict() if row else {}).items()}
    return "".join(f"# TYPE {name} gauge\n{name} {value}\n" for name, value in said.items())


def health(store: Store) -> dict[str, str]:
    """Whether the newest version can be read: its manifest and all folders that it names are there."""
    try:
        named = {f for own in store.manifest()["tables"].values() for folders in own.values() for f in folders}
        lost = sorted(f for f in named if not store._fs.exists(store._path(f)))
    except Exception as error:
        return {"status": "unhealthy", "store": type(error).__name__}
    return {"status": "unhealthy", "store": f"{len(lost)} folders are missing, first {lost[0]}"} if lost else {"status": "ok", "store": "ok"}
