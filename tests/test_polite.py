"""Polite probing: rates, budgets, resuming; evaluation with filters; page text."""

from __future__ import annotations

import os
import time
from types import SimpleNamespace

import pytest

from folio.operators import evaluate as E
from folio.sources import polite as P
from folio.sources import readers as R


class Clock:
    def __init__(self):
        self.now = 100.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_paced_keeps_the_rate_and_takes_turns():
    clock, asked = Clock(), []

    def get(url, params):
        asked.append((url, clock.now))
        if url.endswith("wait"):
            return 429, {"Retry-After": "20"}, ""
        if url.endswith("down"):
            raise TimeoutError
        return 404 if url.endswith("gone") else 200, {}, ""

    rows = [(f"http://a.b/{x}", "a.b", 0, 2, 9) for x in ("1", "gone", "down", "wait", "5")]
    rows[1:1] = [("http://10.0.0.1/", "10.0.0.1", 0, 1, 5), ("http://c.d/1", "c.d", 1, 4, 1), ("http://c.d/2", "c.d", 1, 4, 1)]
    got = {u: (status, state) for u, _, status, state in P.paced(rows, get, 0.5, clock, clock.sleep)}
    assert got == {
        "http://a.b/1": ("200", "ok"), "http://10.0.0.1/": (None, "unknown"), "http://c.d/1": ("200", "ok"), "http://c.d/2": (None, "pending"),
        "http://a.b/gone": ("404", "dead"), "http://a.b/down": ("ERR:TimeoutError", "unknown"), "http://a.b/wait": ("429", "unknown"), "http://a.b/5": ("200", "ok"),
    }
    at = dict(asked)
    assert at["http://c.d/1"] == 102.0  # its part's turn comes after the first part's
    times = [t for u, t in asked if "a.b" in u]
    assert times[0] == 100 and all(b - a >= 4 for a, b in zip(times, times[1:])) and times[4] - times[3] == 20


def test_dealt_shares(spark):
    urls = [(f"http://hot.x:80/{k}",) for k in range(1000)] * 2 + [(f"https://u@Cold{k}.x/",) for k in range(20)] + [(None,), ("",), ("no url",)]
    frame = spark.createDataFrame(urls, "url string").repartition(5)
    for seconds, most in ((None, 1000), (50.0, 100), (1e6, 1000), (0.0, 0)):
        rows = P.dealt(frame, P.Manners(rate=2, seconds=seconds, hot=100, parts=8)).collect()
        assert len(rows) == 1022 and {r.url for r in rows} == {u for u, in urls if u is not None}
        hot = {r.part: r.share for r in rows if r.host == "hot.x"}
        assert set(hot) == set(range(8)) and most - 8 < sum(hot.values()) <= most
        assert {(r.part, r.parts) for r in rows if r.host.startswith("cold")} == {(0, 1)}
        if most == 1000:
            assert sum(hot.values()) == 1000 and all(hot[p] == sum(r.host == "hot.x" and r.part == p for r in rows) for p in hot)
    with pytest.raises(ValueError):
        P.Manners(rate=0)


def test_runs_ask_within_the_budget_and_go_on(spark, tmp_path):
    log = str(tmp_path)

    def get(url, params):
        with open(f"{log}/{os.getpid()}", "a") as f:
            f.write(f"{url} {time.time()}\n")
        return 404 if url.endswith("7") else 200, {}, ""

    def asked():
        lines = [x.split() for n in os.listdir(log) for x in open(f"{log}/{n}")]
        return {u for u, _ in lines}, len(lines), [float(t) for u, t in lines if "hot" in u]

    every = {f"http://hot.x/{k}" for k in range(100)} | {f"http://c{k}.x/" for k in range(5)} | {"http://localhost/"}
    urls = spark.createDataFrame([(u,) for u in every] * 2 + [(None,)], "url string")
    how = P.Manners(rate=20, seconds=2.0, hot=10, parts=3)
    first = spark.createDataFrame(P.probed(urls, get, how).collect(), P.STATES)
    once, n, times = asked()
    assert {r.url for r in first.collect()} == every and first.count() == len(every)
    assert n == len(once) and 37 <= len(times) <= 40
    # a host's tasks run beside each other, yet no second holds more than its rate and one request of each part
    assert all(sum(a <= t < a + 1 for t in times) <= 20 + 3 for a in times)
    known = first
    for _ in range(3):
        known = spark.createDataFrame(P.probed(urls, get, how, known).collect(), P.STATES)
    again, n, _ = asked()
    assert n == len(again) == 105, "nothing is asked twice, and nothing is left out"
    assert {r.url: r.state for r in known.collect()} == {u: "unknown" if "localhost" in u else "dead" if u.endswith("7") else "ok" for u in every}
    papers = spark.createDataFrame([(1, "http://hot.x/7"), (2, "http://hot.x/7"), (3, "http://hot.x/8"), (4, None)], "id long, doi string")
    assert sorted(map(tuple, P.audited(papers, known).collect())) == [(1, "http://hot.x/7", "404", "dead"), (2, "http://hot.x/7", "404", "dead")]
    assert P.probed(urls.limit(0), get, how).count() == 0


def test_evaluation_filters_before_it_ranks(spark):
    rows = [(k, f"ice {'core ' * (k % 3)}{k}", "ice", 2000 + k % 4) for k in range(40)]
    paper = spark.createDataFrame(rows, "id long, title string, abstract string, publication_year int")
    links = spark.createDataFrame([(k, k % 5) for k in range(40)], "paper_id long, author_id long")
    author = spark.createDataFrame([(k, f"Ann {k}") for k in range(4)] + [(4, None)], "id long, name string")
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(40)], "paper_id long, embedding array<double>")
    c = SimpleNamespace(paper=paper, author=author, paper_author=links, paper_embedding=vectors, index=None, spark=spark)
    qrels = (("a", "ice", ("core",)), ("b", "ice core", ("core",), 2001), ("c", "ice", ("core",), None, "ann 3"), ("d", "core", ("core",), 2002, "Ann 2"), ("e", "x" * 300, ("x",)))
    got = E.runs(c, qrels, dim=2).collect()
    found = lambda qid, mode: [r.id for r in sorted(got, key=lambda r: r.rank) if (r.qid, r.mode) == (qid, mode)]
    for mode in E.MODES:
        assert len(found("a", mode)) == 20 and not found("e", mode)
        assert {k % 4 for k in found("b", mode)} == {1} and {k % 5 for k in found("c", mode)} == {3}
        assert {(k % 4, k % 5) for k in found("d", mode)} == {(2, 2)}
    assert found("b", "legacy") == [k for k in range(39, -1, -1) if k % 4 == 1 and k % 3]
    assert len(found("c", "hybrid")) == 8
    alone = E.runs(c, qrels[1:2], dim=2).collect()
    assert sorted(map(tuple, alone)) == sorted(tuple(r) for r in got if r.qid == "b")
    assert len(E.accepted(qrels)[0]) == 4 and E.accepted(qrels)[1][0].startswith("e: ")
    assert E.runs(c, qrels[4:]).count() == 0
    card = {(r.qid, r.mode): r for r in E.per_query(E.relevance(E.runs(c, qrels, dim=2), qrels), qrels).collect()}
    assert len(card) == 15 and card["e", "hybrid"].mrr == 0 and card["b", "legacy"].mrr == 1


def test_page_text_leaves_out_what_is_not_shown():
    said = "words " * 20
    for tag in ("script", "style", "template"):
        assert R.abstract_of_html(f'<div class="abstract"><{tag}>var x = 1;</{tag}>{said}<p>end</p></div>') == f"{said}end"
    assert R.abstract_of_html(f'<div class="abstract"><script>{said}</script>short</div>') is None
    assert R.abstract_of_html(f'<div class="abstract">{said} &amp') == f"{said}&"
