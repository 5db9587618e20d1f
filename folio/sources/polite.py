"""Probing links politely: every host is asked at a bounded rate, and for a bounded time in one run.

Distinct urls are dealt by host. A host with many urls is dealt over several parts, which share its rate and its
time: each part waits as many times longer as there are parts, and may ask its share of what the host's
time allows. Urls beyond it are answered ``pending``, none is left out; a later run is given what is known by
then and asks the rest. Tasks read their urls as a stream and hold one time for each of their hosts' parts.

A task that is run again, after its executor was lost, asks again, at the same rate; so does a result that is read
twice. Store a result before using it more than once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.readers import is_private_url, retry_after

#: What stands between a scheme, with an optional user, and a port or path.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
STATES = "url string, host string, status string, state string"


@dataclass(frozen=True)
class Manners:
    """``rate``: requests a second to one host, from all tasks together. ``seconds``: how long a run may ask one host
    (None: until all is asked). A host has a part for every ``hot`` urls begun, at most ``parts``."""

    rate: float = 2.0
    seconds: float | None = None
    hot: int = 1000
    parts: int = 8

    def __post_init__(self) -> None:
        if not (self.rate > 0 and self.hot > 0 and self.parts > 0 and (self.seconds is None or self.seconds >= 0)):
            raise ValueError("rate, hot and parts must be positive, seconds must not be negative")

    @property
    def most(self) -> int | None:
        """Requests to one host in a run."""
        return None if self.seconds is None else int(self.rate * self.seconds)


def dealt(urls: DataFrame, manners: Manners) -> DataFrame:
    """(url, host, part, parts, share) of the distinct urls that are not null: the part of its host that asks a url, and
    how many urls that part may ask. A host's shares add up to at most ``manners.most``, and to all its urls where these are no more."""
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    cell = F.pmod(F.xxhash64("url"), F.lit(manners.parts)).cast("int")
    rows = urls.select("url").where("url is not null").distinct().select("url", host.alias("host"), cell.alias("cell"))
    cells = rows.groupBy("host", "cell").agg(F.count(F.lit(1)).alias("n"))
    hosts = cells.groupBy("host").agg(F.sum("n").alias("all"), F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most ``parts`` cells a host
    parts = F.least(F.lit(manners.parts), F.ceil(F.col("all") / manners.hot)).cast("int")
    spread = hosts.withColumn("parts", parts).select("host", "all", "parts", "cells", F.explode("cells.cell").alias("cell")).withColumn("part", F.col("cell") % F.col("parts"))
    own = F.aggregate(F.filter("cells", lambda x: x["cell"] % F.col("parts") == F.col("part")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    share = own if manners.most is None else F.when(F.col("all") <= manners.most, own).otherwise(F.expr(f"{manners.most}L * own div all"))
    spread = spread.withColumn("own", own).withColumn("share", share)
    # by cell, so that the urls of a hot host meet its one row in as many tasks as it has cells
    return rows.join(spread.select("host", "cell", "part", "parts", "share"), ["host", "cell"]).select("url", "host", "part", "parts", "share")


def paced(rows: Iterable[tuple], get: Callable, rate: float, clock: Callable[[], float], sleep: Callable[[float], None]) -> Iterator[tuple]:
    """(url, host, status, state) of rows as ``dealt`` gives them, asked in their order, each part of a host no sooner than its turn.

    ``status`` is what came back, or the name of the failure; null for urls that were not asked: those of private
    addresses (``unknown``) and those beyond the share (``pending``). An answer that names a time to wait moves the
    part's next turn.
    """
    began, turns, left = clock(), {}, {}
    for url, host, part, parts, share in rows:
        key = (host, part)
        if is_private_url(url):
            yield url, host, None, "unknown"
            continue
        if left.setdefault(key, share) <= 0:
            yield url, host, None, "pending"
            continue
        left[key] -= 1
        turn = turns.get(key, began + part / rate)  # the parts of a host start one after another
        if (pause := turn - clock()) > 0:
            sleep(pause)
        turns[key] = max(turn, clock()) + parts / rate
        try:
            code, headers, _ = get(url, {})
        except Exception as error:
            yield url, host, f"ERR:{type(error).__name__}", "unknown"
            continue
        if code != 200 and (asked := retry_after(headers or {})):
            turns[key] = max(turns[key], clock() + asked)
        yield url, host, str(code), "ok" if code == 200 else "dead" if code in (404, 410) else "unknown"


def probed(urls: DataFrame, get: Callable, manners: Manners | None = None, known: DataFrame | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, host, status, state) of the distinct urls that are not null; ``get(url, params)`` runs in the tasks.

    ``known``: an earlier run's result; what it doesn't hold as pending is taken over and not asked again. The empty
    url and others without a host are ``unknown`` and never asked.
    """
    how = manners or Manners()
    ask, kept = urls, None
    if known is not None:
        settled = known.where("state <> 'pending'").select("url", "host", "status", "state").dropDuplicates(["url"])
        kept = settled.join(urls.select("url").distinct(), "url", "left_semi")
        ask = urls.join(settled, "url", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from batch.itertuples(index=False, name=None)

        some: list[tuple] = []
        for answer in paced(rows(), get, how.rate, clock, sleep):
            some.append(answer)
            if len(some) == 1000:
                yield pd.DataFrame(some, columns=["url", "host", "status", "state"])
                some = []
        yield pd.DataFrame(some, columns=["url", "host", "status", "state"])

    # a part of a host is in one task, where hosts take turns; a number given here keeps small tasks apart
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = dealt(ask, how).repartition(tasks, "host", "part").sortWithinPartitions(F.xxhash64("url"), "url").mapInPandas(run, STATES)
    return asked if kept is None else asked.unionByName(kept)


def audited(papers: DataFrame, states: DataFrame) -> DataFrame:
    """(id, doi, status, state) of papers (id, doi) whose link is not known to work, from ``probed`` over their dois; papers without a doi have none."""
    links = states.select(F.col("url").alias("doi"), "status", "state").where("state <> 'ok'")
    return papers.select("id", "doi").join(links, "doi").select("id", "doi", "status", "state")
