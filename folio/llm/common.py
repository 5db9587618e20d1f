"""Shared helpers: tables in the cluster's shared folder, null-safe inputs, gapless numbering."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
#: Cells that ``gapless`` deals all groups over, whatever their number.
CELLS = 1 << 16


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="folio-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and driver and executors are one process (a local master, as in tests) is it a
    folder of this machine; on a cluster that is an error, since executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "zstd", **options: object) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) into the shared folder and read it back, which cuts its lineage.

    The table outlives lost executors. It stays until ``discard`` or the owner of the shared folder
    clears it (``<shared>/folio-*``), since a lazy result may still need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a ``materialize`` result of which no later plan reads."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("folio-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from every column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held(columns: dict[str, Column]) -> Column:
    """``columns`` as one generated row, for a select: each is made once a row. The optimizer can't copy what
    makes them into filters on them, or into lambdas, where it would run again for every element."""
    return F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items()))))


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let no Arrow batch that goes to Python exceed ``size`` bytes by more than a row, whatever its texts' length.

    This is a setting of the session: it bounds batches of the caller's other Python operators too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null text: empty), so that other columns can't clash."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def gapless(rows: DataFrame, group: str, uid: str, name: str, groups: int | list[int]) -> DataFrame:
    """Number the rows of each group from 0 without gaps in the new column ``name``.

    ``groups`` is their number, or the rows of each where groups are called 0, 1, ... ``uid`` tells rows
    apart; ``rows`` is a stored table, so that it stays the same when a task is repeated. A hash of it deals
    every group over many cells, as many as its share of all rows asks for where that is known, however many
    repeated keys it has. Rows are numbered inside their cell; the cells' counts, at most CELLS + 16 rows a
    group whatever the data's size, give each cell's offset, so no task ever holds a whole group.
    """
    if isinstance(groups, list):
        each = [16 + CELLS * n // max(1, sum(groups)) for n in groups]
        cells = F.get(F.array(*map(F.lit, each)), F.col(group))
    else:
        cells = F.lit(max(16, CELLS // max(1, groups)))
    cell = [group, "__cell"]
    local = rows.withColumn("__cell", F.pmod(F.xxhash64(uid), cells).cast("int"))
    counts = local.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = local.withColumn("__at", F.row_number().over(Window.partitionBy(*cell).orderBy(uid)).cast("long") - 1)
    return inside.join(offsets, cell).withColumn(name, F.col("__at") + F.col("__before")).drop("__cell", "__at", "__before")
