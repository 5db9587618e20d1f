"""A stored search index: postings, terms and lengths in segments, written for a corpus and read by their terms.

``build`` splits every text into tokens once. Postings lie in folders by a checksum of their term, sorted by
term inside each file, so that a search reads the folders and row groups of its own terms and no text. A
frequent word has a posting for nearly every paper: each folder is dealt over ``spread`` tasks by the
paper's id, so no task holds all postings of one.

``refresh`` writes one small segment: the postings of the changed papers that are still there, and the ids of all
changed papers, whose rows in earlier segments are dead from then on. Statistics stay exact. Small segments
are merged into the one before them once they weigh half as much, so that there are never more than the
corpus has doublings, and a posting is written anew about so often.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import search as S

#: Folders of an index and the tasks that each is dealt over, unless a caller gives more for a large corpus.
FOLDERS, SPREAD = 16, 4
#: Postings that one task sorts, and about how many characters have one.
ROWS, CHARS = 1 << 20, 8
#: A segment is merged with the later ones if it weighs at most so many times what they do.
MERGE = 2
#: ``head`` marks one posting of each field of a paper.
POSTING = "term string, field int, id long, tf int, len int, head boolean, folder int"
TERM = "folder int, term string, field int, df long, tokens long"
#: A row with field -1 for every paper, and one for each of its fields that has tokens.
LENGTH = "id long, field int, len int"
GONE = "id long"
SEGMENT = "path string, rows long, removed long"
STATS = "papers long, " + ", ".join(f"{f} long" for f in S.FIELDS) + f", folders int, segments array<struct<{SEGMENT}>>"


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="folio-index-")


def new_path(spark: SparkSession) -> str:
    """A new folder's path in the folder that driver and executors share (``spark.checkpoint.dir``; only a local
    master may leave it unset)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own_dir(spark.sparkContext.applicationId)
    return f"{shared.rstrip('/')}/folio-index-{uuid.uuid4().hex}"


def _folder_of(term: Column, folders: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(folders)).cast("int")


def postings(papers: DataFrame) -> DataFrame:
    """(term, field, id, tf, len, head): how often each field (its place in FIELDS) of a paper has a term, and the field's tokens."""
    fields = F.array(*(F.struct(F.lit(k).alias("field"), T.tokens(F.col(f)).alias("t")) for k, f in enumerate(S.FIELDS)))
    rows = papers.select("id", F.inline(fields)).where(F.size("t") > 0)
    rows = rows.select("id", "field", T.held(s=F.array_sort("t"), len=F.size("t")))
    begins = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.select("id", "field", "s", "len", T.held(begins=begins))
    counted = F.transform("begins", lambda a, i: F.struct(F.get("s", a).alias("term"), (F.coalesce(F.get("begins", i + 1), F.col("len")) - a).alias("tf"), (i == 0).alias("head")))
    return rows.select("id", "field", "len", F.inline(counted)).select("term", "field", "id", "tf", "len", "head")


def _expected(papers: DataFrame) -> int:
    """About how many postings the texts of ``papers`` have."""
    chars = papers.agg(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in S.FIELDS), F.lit(0).cast("long")))).head()[0]
    return (chars or 0) // CHARS


def _segment(found: DataFrame, ids: DataFrame, path: str, folders: int, spread: int, expected: int) -> int:
    """Write postings and the ids of their papers (those without tokens too) as a segment; its number of postings.

    Each folder is dealt over ``spread`` tasks, or as many as let a task sort about ROWS of the postings ``expected``.
    """
    spark = found.sparkSession
    spread = max(spread, -(-expected // (folders * ROWS)))
    dealt = found.select("term", "field", "id", "tf", "len", "head", _folder_of(F.col("term"), folders).alias("folder"))
    dealt = dealt.repartitionById(folders * spread, (F.col("folder") * spread + F.pmod(F.xxhash64("id"), F.lit(spread))).cast("int"))
    dealt.sortWithinPartitions("folder", "term", "field", "id").write.partitionBy("folder").parquet(f"{path}/postings")
    stored = spark.read.schema(POSTING).parquet(f"{path}/postings")
    terms = stored.groupBy("folder", "term", "field").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tokens"))
    terms.sortWithinPartitions("folder", "term").write.parquet(f"{path}/terms")
    every = ids.select("id", F.lit(-1).alias("field"), F.lit(0).alias("len"))
    every.union(stored.where("head").select("id", "field", "len")).write.parquet(f"{path}/lengths")
    return stored.count()


def _sums(lengths: DataFrame) -> dict[str, int]:
    """Papers of a table of lengths, and the tokens of each field."""
    tokens = {f: F.coalesce(F.sum(F.when(F.col("field") == k, F.col("len"))), F.lit(0)) for k, f in enumerate(S.FIELDS)}
    return lengths.agg(F.count_if(F.col("field") == -1).alias("papers"), *(v.alias(k) for k, v in tokens.items())).head().asDict()


def _finish(spark: SparkSession, path: str, sums: dict[str, int], folders: int, segments: list[tuple[str, int, int]]) -> Index:
    # written last: an index without it was never finished
    spark.createDataFrame([(sums["papers"], *(sums[f] for f in S.FIELDS), folders, segments)], STATS).coalesce(1).write.parquet(f"{path}/stats")
    return Index(spark, path)


def build(papers: DataFrame, path: str, folders: int = FOLDERS, spread: int = SPREAD) -> Index:
    """Index the titles and abstracts of ``papers`` (unique ids) in the new folder ``path``, which driver and executors share."""
    spark = papers.sparkSession
    rows = _segment(postings(papers), papers, f"{path}/segment", folders, spread, _expected(papers))
    sums = _sums(spark.read.schema(LENGTH).parquet(f"{path}/segment/lengths"))
    return _finish(spark, path, sums, folders, [(f"{path}/segment", rows, 0)])


def _from(segments: list[tuple[str, int, int]]) -> int:
    """The place of the first segment that is to be merged with all after it; the last place if none is.

    A segment weighs its postings, or the tokens that it makes dead where these are more.
    """
    at = len(segments) - 1
    later = max(segments[at][1:])
    while at and max(segments[at - 1][1:]) <= MERGE * later:
        at -= 1
        later += max(segments[at][1:])
    return at


def refresh(old: Index, papers: DataFrame, changed: DataFrame, path: str, spread: int = SPREAD) -> Index:
    """The index of ``papers`` below the new folder ``path``: the segments of ``old`` and one of the papers whose ids
    are in ``changed`` (id: new, other or gone; others and nulls name no paper).

    Readers of ``old`` are not disturbed. The result reads the folders in its ``segments``, so these must be kept.
    Without a change in effect it has the segments of ``old``.
    """
    spark = papers.sparkSession
    ids = changed.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    ids.write.parquet(f"{path}/segment/gone")
    ids = spark.read.schema(GONE).parquet(f"{path}/segment/gone")
    now = papers.join(ids, "id", "left_semi")
    rows = _segment(postings(now), now, f"{path}/segment", old.folders, spread, _expected(now))
    dead, new = _sums(old.lengths.join(ids, "id", "left_semi")), _sums(spark.read.schema(LENGTH).parquet(f"{path}/segment/lengths"))
    sums = {k: old.sums[k] - dead[k] + new[k] for k in new}
    if not dead["papers"] and not new["papers"]:
        return _finish(spark, path, sums, old.folders, old.segments)
    segments = [*old.segments, (f"{path}/segment", rows, sum(dead[f] for f in S.FIELDS))]
    if (at := _from(segments)) < len(segments) - 1:
        some, merged = Segments(spark, segments[at:]), f"{path}/merged"
        if at:  # what the merged ones made dead before them stays dead
            some.gone.select("id").union(spark.read.schema(GONE).parquet(f"{segments[at][0]}/gone")).distinct().write.parquet(f"{merged}/gone")
        rows = _segment(some.postings.drop("folder"), some.lengths.where("field = -1"), merged, old.folders, spread, sum(x[1] for x in segments[at:]))
        segments = [*segments[:at], (merged, rows, sum(x[2] for x in segments[at:]) if at else 0)]
    return _finish(spark, path, sums, old.folders, segments)


class Segments:
    """The live rows of segments in order: a paper's rows are dead if a later segment names its id in ``gone``."""

    def __init__(self, spark: SparkSession, segments: list[tuple[str, int, int]]):
        self.spark, self.segments = spark, segments

    def _read(self, table: str, schema: str, at: slice) -> DataFrame | None:
        parts = [self.spark.read.schema(schema).parquet(f"{s[0]}/{table}").withColumn("__at", F.lit(k)) for k, s in list(enumerate(self.segments))[at]]
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    @functools.cached_property
    def gone(self) -> DataFrame | None:
        """(id, __last): the last segment that names an id, from the second on."""
        named = self._read("gone", GONE, slice(1, None))
        return named.groupBy("id").agg(F.max("__at").alias("__last")) if named else None

    def _earlier(self, table: str, schema: str, dead: bool) -> DataFrame | None:
        """The dead or the live rows of all segments but the last."""
        if self.gone is None:
            return None
        rows = self._read(table, schema, slice(0, -1)).join(self.gone, "id", "inner" if dead else "left")
        is_dead = F.coalesce(F.col("__last") > F.col("__at"), F.lit(False))
        return rows.where(is_dead if dead else ~is_dead).drop("__last")

    def _live(self, table: str, schema: str) -> DataFrame:
        last, earlier = self._read(table, schema, slice(-1, None)), self._earlier(table, schema, False)
        return (last if earlier is None else earlier.unionByName(last)).drop("__at").select(*(c.split()[0] for c in schema.split(", ")))

    @property
    def postings(self) -> DataFrame:
        return self._live("postings", POSTING)

    @property
    def lengths(self) -> DataFrame:
        return self._live("lengths", LENGTH)


class Index(Segments):
    """A finished index below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        if not (one := spark.read.schema(STATS).parquet(f"{path}/stats").head()):
            raise ValueError(f"{path} holds no finished index")
        super().__init__(spark, [tuple(s) for s in one["segments"]])
        self.folders, self.sums = one["folders"], {k: one[k] for k in ("papers", *S.FIELDS)}

    def _of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        folders = sorted({zlib.crc32(t.encode()) % self.folders for t in terms})
        return table.where(F.col("folder").isin(folders) & F.col("term").isin(terms))

    def frequencies(self, terms: list[str]) -> DataFrame:
        """(term, field, df) of live papers: what the segments counted, less their dead postings."""
        counted = self._of(self._read("terms", TERM, slice(None)), terms).select("term", "field", "df")
        if (dead := self._earlier("postings", POSTING, True)) is not None:
            counted = counted.union(self._of(dead, terms).groupBy("term", "field").agg((-F.count(F.lit(1))).alias("df")))
        return counted.groupBy("term", "field").agg(F.sum("df").alias("df"))

    def bm25_many(self, papers: DataFrame, queries: dict[str, str]) -> DataFrame:
        """As ``search.bm25_many``, and equal to it, from the postings of the queries' terms.

        Every posting becomes its part of the score of each query that has its term; a paper's parts, at most
        one for each term and field of a query, are added in the order in which the scan adds them.
        """
        asked = [(qid, term, k) for qid, q in queries.items() for k, term in enumerate(S.query_terms(q))]
        terms = list(dict.fromkeys(term for _, term, _ in asked))
        # one row for each term and field, and for each term of a query
        weights = F.broadcast(self.frequencies(terms))
        wanted = F.broadcast(self.spark.createDataFrame(asked, "qid string, term string, place int"))
        docs = F.lit(self.sums["papers"])
        mean = F.element_at(F.array(*(F.try_divide(F.lit(self.sums[f]), docs) for f in S.FIELDS)), F.col("field") + 1)
        part = S.part_of_score(F.col("df"), docs, F.col("tf"), F.col("len"), mean)
        parts = self._of(self.postings, terms).join(weights, ["term", "field"]).join(wanted, "term").select("id", "qid", F.struct("field", "place", part.alias("part")).alias("x"))
        score = F.aggregate(F.array_sort(F.collect_list("x")), F.lit(0.0), lambda a, x: a + x["part"])
        return papers.join(parts.groupBy("id", "qid").agg(F.round(score, 6).alias("score")), "id").select(*papers.columns, "qid", "score")
