"""Upstream works as a data source: slices of dates are read by their own cursors, in the tasks.

One cursor leads through the pages of one question, so a reader that asks one question is one task. Here every
topic's dates are cut into slices, each with a cursor of its own; every slice gives at most ``most`` records in
the upstream's order, and the first ``most`` of a topic over all its slices are those that one cursor would
give. The streaming reader's offsets are days: a batch is what changed on the days between two offsets.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from folio.sources.readers import WORK, pages

ROW = "topic string, slice int, place long, line string"


@dataclass
class Slice(InputPartition):
    topic: str
    number: int
    since: str
    #: the last day
    until: str


def slices(topic: str, since: str, until: str, days: int) -> list[Slice]:
    """The days from ``since`` to ``until``, latest first, ``days`` a slice."""
    first, last, out = date.fromisoformat(since), date.fromisoformat(until), []
    while last >= first:
        begin = max(first, last - timedelta(days=days - 1))
        out.append(Slice(topic, len(out), begin.isoformat(), last.isoformat()))
        last = begin - timedelta(days=1)
    return out


def records(get: Callable, part: Slice, ids: dict[str, str], most: int, updated: bool, sleep: Callable[[float], None]) -> Iterator[tuple]:
    kind = "updated" if updated else "publication"
    params = {"filter": f"topics.id:{ids[part.topic]},from_{kind}_date:{part.since},to_{kind}_date:{part.until}", "sort": "updated_date:desc" if updated else "cited_by_count:desc"}
    for place, record in enumerate(pages(get, "/works", params, most, sleep)):
        yield part.topic, part.number, place, json.dumps(record)


def source(name: str, get: Callable, topics: list[tuple[str, str]], since: str, until: str, most: int, updated: bool = False, days: int = 30, today: Callable[[], str] | None = None, sleep: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """A data source called ``name`` over ``get``, for topics (slug, upstream id). As a stream it starts at ``since``
    and knows the days up to ``today()``; its batches hold the changes of whole days."""
    ids = dict(topics)

    class Reader(DataSourceReader):
        def partitions(self) -> list[Slice]:
            return [s for topic in ids for s in slices(topic, since, until, days)] or [Slice("", 0, "", "")]

        def read(self, part: Slice) -> Iterator[tuple]:
            return records(get, part, ids, most, updated, sleep) if part.topic else iter(())

    class Stream(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"before": since}

        def latestOffset(self) -> dict:
            return {"before": (today or date.today().isoformat)()}

        def partitions(self, start: dict, end: dict) -> list[Slice]:
            last = (date.fromisoformat(end["before"]) - timedelta(days=1)).isoformat()
            return [s for topic in ids for s in slices(topic, start["before"], last, days)] or [Slice("", 0, "", "")]

        def read(self, part: Slice) -> Iterator[tuple]:
            return records(get, part, ids, most, True, sleep) if part.topic else iter(())

    class Works(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ROW

        def reader(self, schema) -> DataSourceReader:
            return Reader()

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream()

    return Works


def parsed(rows: DataFrame) -> DataFrame:
    """Records of the source's rows, with ``topic``, ``slice`` and ``place``."""
    out = rows.select("topic", "slice", "place", F.from_json("line", WORK).alias("w")).select("topic", "slice", "place", "w.*")
    return out.withColumn("landing_pages", F.transform("locations", lambda x: x["landing_page_url"]))


def read_works(spark: SparkSession, get: Callable, topics: list[tuple[str, str]], since: str, until: str, most: int, updated: bool = False, days: int = 30, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Works of the topics (slug, upstream id) from ``since`` to ``until``, at most ``most`` of each, with ``topic`` and
    ``ord``, their place in the upstream's order: by change or by citations, later slices first among equals."""
    cls = source("folio_works", get, topics, since, until, most, updated, days, sleep=sleep)
    spark.dataSource.register(cls)
    rows = parsed(spark.read.format(cls.name()).load())
    order = Window.partitionBy("topic").orderBy(F.desc_nulls_last("updated_date" if updated else "cited_by_count"), "slice", "place")
    return rows.withColumn("ord", (F.row_number().over(order) - 1).cast("long")).where(F.col("ord") < most).drop("slice", "place")


def stream_works(spark: SparkSession, get: Callable, topics: list[tuple[str, str]], since: str, today: Callable[[], str], days: int = 30, most: int = 1 << 62, sleep: Callable[[float], None] = time.sleep, name: str = "folio_work_stream") -> DataFrame:
    """The works that changed from ``since`` on, as a stream whose batches end at whole days."""
    cls = source(name, get, topics, since, since, most, True, days, today, sleep)
    spark.dataSource.register(cls)
    return parsed(spark.readStream.format(name).load()).withColumn("ord", F.col("place")).drop("slice", "place")
