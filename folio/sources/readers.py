"""Readers: relevance judgements, paged upstream works with retries, publisher pages, feeds, url guard."""

from __future__ import annotations

import ipaddress
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import timezone
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import ARXIV

#: An upstream record.
WORK = "id string, display_name string, publication_year int, publication_date string, updated_date string, abstract_inverted_index map<string,array<int>>, cited_by_count long, doi string, authorships array<struct<author:struct<id:string,display_name:string>>>, locations array<struct<landing_page_url:string>>"
RETRYABLE = {429, 502, 503, 504}
PAGE_SIZE, ATTEMPTS = 100, 3


class Unavailable(Exception):
    """A fetcher's temporary failure (timeout or refused connection)."""


def retry_after(headers: dict, now: float | None = None) -> float | None:
    """Seconds that a Retry-After header asks for, within 0 and 60; None if absent or invalid."""
    raw = next((str(v) for k, v in headers.items() if str(k).lower() == "retry-after"), None)
    if raw is None:
        return None
    try:
        seconds = float(int(raw.strip()))
    except ValueError:
        try:
            at = parsedate_to_datetime(raw)
            at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
            seconds = at.timestamp() - (time.time() if now is None else now)
        except (TypeError, ValueError):
            return None
    return min(60.0, max(0.0, seconds))


def backoff(attempt: int, asked: float | None, base: float = 1.0, cap: float = 30.0, jitter: float | None = None) -> float:
    """Seconds to wait before a retry, with up to a second of jitter."""
    return min(cap, max(base * 2**attempt, asked or 0.0) + (random.random() if jitter is None else jitter))


def retryable(error: BaseException) -> bool:
    """Whether a fetch may be tried again after an exception: timeouts and refused connections."""
    return isinstance(error, (Unavailable, TimeoutError, ConnectionError))


def fetch_or_none(get: Callable[[str, dict], tuple[int, dict, str]], path: str, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Body of a GET, or None after its last retry, for any other status and for any failure."""
    try:
        return fetch(get, path, {}, sleep)
    except Exception:
        return None


def probe(get: Callable[[str, dict], tuple[int, dict, str]], url: str) -> str:
    """ok, dead or unknown: the state of a link. Urls that must not be fetched and failures are unknown."""
    if is_private_url(url):
        return "unknown"
    try:
        status = get(url, {})[0]
    except Exception:
        return "unknown"
    return "ok" if status == 200 else "dead" if status in (404, 410) else "unknown"


def crossref_abstract(get, doi: str, sleep=time.sleep) -> str | None:
    """Abstract without markup that the metadata service has for a doi; none for preprint dois."""
    bare = re.sub("^https?://doi\\.org/", "", (doi or "").strip()).strip()
    if not bare or bare.startswith("10.48550"):
        return None
    try:
        raw = json.loads(fetch_or_none(get, f"https://api.crossref.org/works/{bare}", sleep) or "{}").get("message", {}).get("abstract")
        return re.sub("<[^>]+>", "", raw or "").strip() or None
    except (ValueError, AttributeError, TypeError):
        return None


def arxiv_abstract(get, doi: str, pages: list[str] | None = None, sleep=time.sleep) -> str | None:
    """Summary of the preprint that the doi or a landing page names."""
    found = (re.search(ARXIV, x or "") for x in (doi, *(pages or ())))
    number = next((m[1] for m in found if m), None)
    return summary_of_feed(fetch_or_none(get, f"https://export.arxiv.org/api/query?id_list={number}", sleep)) if number else None


def page_abstract(get, doi: str, sleep=time.sleep) -> str | None:
    """Abstract on the page that a doi leads to."""
    bare = re.sub("^https?://doi\\.org/", "", (doi or "").strip()).strip()
    return abstract_of_html(fetch_or_none(get, f"https://doi.org/{bare}", sleep)) if bare else None


def recover(get, doi: str | None, pages: list[str] | None = None, sleep=time.sleep) -> tuple[str | None, str | None]:
    """(abstract, source) from the first source that has one: metadata service, preprint server, publisher's page."""
    own = (doi or "").strip()
    if not own:
        return None, None
    low = own.lower()
    publisher = "springer" if "10.1007" in low else "elsevier" if "10.1016" in low else "html_generic"
    for name, found in (("crossref", lambda: crossref_abstract(get, own, sleep)), ("arxiv", lambda: arxiv_abstract(get, own, pages, sleep)), (publisher, lambda: page_abstract(get, own, sleep))):
        if text := found():
            return text, name
    return None, None


def recovered_abstracts(papers: DataFrame, get) -> DataFrame:
    """(id, abstract, abstract_source) of papers (id, doi) for which a source has an abstract; ``get`` runs in the tasks."""
    kind = papers.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *recover(get, doi)) for i, doi in zip(part["id"], part["doi"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["id", "abstract", "abstract_source"])

    return papers.select("id", "doi").mapInPandas(run, f"id {kind}, abstract string, abstract_source string")


def probed(urls: DataFrame, get, threads: int = 8) -> DataFrame:
    """(url, state) of the distinct urls, ``threads`` at a time in each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for part in parts:
                yield pd.DataFrame({"url": part["url"], "state": list(pool.map(lambda u: probe(get, u), part["url"]))})

    return urls.select("url").where("url is not null").distinct().mapInPandas(run, "url string, state string")


def works(spark: SparkSession, get, topic: str, since: str, most: int, updated: bool = False, sleep=time.sleep) -> DataFrame:
    """Upstream records of a topic from a date on (of publication, or of change), at most ``most``, as rows with ``ord``.

    One cursor leads through the pages, so the driver reads them; ``most`` bounds what it holds.
    """
    params = {"filter": f"topics.id:{topic},from_{'updated' if updated else 'publication'}_date:{since}", "sort": "updated_date:desc" if updated else "cited_by_count:desc"}
    lines = [(json.dumps(r), k) for k, r in enumerate(pages(get, "/works", params, most, sleep))]
    raw = spark.createDataFrame(lines, "line string, ord long")
    return raw.select(F.from_json("line", WORK).alias("w"), "ord").select("w.*", "ord").withColumn("landing_pages", F.transform("locations", lambda x: x["landing_page_url"]))


def fetch(get: Callable[[str, dict], tuple[int, dict, str]], path: str, params: dict, sleep: Callable[[float], None] = time.sleep, also: frozenset[int] = frozenset({500})) -> str:
    """Body of a GET through the injected ``get``; temporary failures are retried, at most ATTEMPTS times."""
    for attempt in range(ATTEMPTS):
        last = attempt == ATTEMPTS - 1
        try:
            status, headers, body = get(path, params)
        except Exception as error:
            if last or not retryable(error):
                raise
            sleep(backoff(attempt, None))
            continue
        if status == 200:
            return body
        if last or status not in RETRYABLE | also:
            raise ValueError(f"status {status} from {path}")
        sleep(backoff(attempt, retry_after(headers)))
    raise AssertionError


def pages(get, path: str, params: dict, most: int, sleep=time.sleep) -> Iterator[dict]:
    """Records over cursor pages, from cursor ``*`` until the cursor ends or ``most`` records came."""
    cursor, sent = "*", 0
    while cursor and sent < most:
        page = json.loads(fetch(get, path, params | {"cursor": cursor, "per-page": PAGE_SIZE}, sleep))
        for record in page.get("results", [])[: most - sent]:
            sent += 1
            yield record
        cursor = (page.get("meta") or {}).get("next_cursor")
        if cursor and sent < most:
            sleep(0.5)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Relevance judgements from JSON lines; blank, broken and incomplete rows are left out."""
    schema = "qid string, q string, relevant_substrings array<string>, year int, author string, _corrupt_record string"
    lines = spark.read.text(path).select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    rows = lines.select("x.*")
    return rows.where("_corrupt_record is null and qid is not null and q is not null and relevant_substrings is not null").drop("_corrupt_record")


def is_private_url(url: str | None) -> bool:
    """Whether a url must not be fetched: not http(s), no host, this machine's name, or a literal of a non-public address."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").strip().lower()
    except ValueError:
        return True
    if parts.scheme not in ("http", "https") or host in ("", "localhost", "0.0.0.0", "::1"):
        return True
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return False
    return address.is_private or address.is_loopback or address.is_link_local or address.is_reserved or address.is_multicast or address.is_unspecified


#: Fixed values of the extraction: meta attributes and names with the least length of their content; then
#: selectors in order, with the least length of the element's text.
METAS = (("name", "citation_abstract", 50), ("name", "dc.Description", 50), ("name", "dc.description", 50), ("property", "og:description", 50), ("name", "description", 100))
SECTIONS = (
    ("#Abs1-content", 50), ("#Abs1-section", 50), ("section#Abs1", 50), ("div#Abs1-section", 50),
    ("div.abstract.author", 50), ("section#abstract", 50), ("div#abstracts", 50), ("div.abstract", 50),
    ("section.abstract", 80), ("article section.abstract", 80),
)
#: Elements whose text a page doesn't show.
HIDDEN = {"script", "style", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _fits(selector: str, tag: str, own: dict[str, str], above: list[str]) -> bool:
    """Whether an element, below the open elements ``above``, is what ``[ancestor ]name[#id][.class...]`` selects."""
    *outer, last = selector.split(" ")
    name, *marks = re.split("(?=[#.])", last)
    return (
        all(x in above for x in outer) and name in ("", tag)
        and all(own.get("id") == m[1:] if m[0] == "#" else m[1:] in own.get("class", "").split() for m in marks)
    )


class _Page(HTMLParser):
    """The first meta tag of each name, and the text of the first element of each selector."""

    def __init__(self) -> None:
        super().__init__()
        self.metas: dict[tuple[str, str], str] = {}
        self.found: dict[str, list[str]] = {}
        self.open: list[tuple[str, list[str]]] = []
        self.done: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for key in ("name", "property"):
                self.metas.setdefault((key, own.get(key, "")), own.get("content", ""))
        if tag in VOID:
            return
        above = [t for t, _ in self.open]
        starts = [x for x, _ in SECTIONS if x not in self.found and _fits(x, tag, own, above)]
        self.found |= {x: [] for x in starts}
        self.open.append((tag, starts))

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                for _, ended in self.open[at:]:
                    self.done.update(ended)
                del self.open[at:]
                break

    def handle_data(self, data: str) -> None:
        if any(tag in HIDDEN for tag, _ in self.open):
            return
        for selector, pieces in self.found.items():
            if selector not in self.done:
                pieces.append(data)


def abstract_of_html(html: str | None) -> str | None:
    """Abstract of a publisher's page: the first meta tag, else the first section, that is long enough."""
    page = _Page()
    page.feed(html or "")
    page.close()
    clean = lambda x: " ".join(x.split())
    for key, name, least in METAS:
        if len(text := clean(page.metas.get((key, name), ""))) >= least:
            return text
    for selector, least in SECTIONS:
        if len(text := clean(" ".join(page.found.get(selector, [])))) >= least:
            return text
    return None


def summary_of_feed(xml: str | None) -> str | None:
    """Stripped summary of an Atom feed's first entry; None if absent or malformed."""
    atom = "{http://www.w3.org/2005/Atom}"
    try:
        found = ElementTree.fromstring(xml or "").find(f"{atom}entry/{atom}summary")
    except ElementTree.ParseError:
        return None
    return (found.text or "").strip() or None if found is not None else None


def _mapped(f: Callable, kind: str, column: Column) -> Column:
    """``f`` over a column in Arrow batches; nulls are passed as None."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([f(v) for v in values], dtype=bool if kind == "boolean" else object)

    return run(column)


def private_url(url: Column) -> Column:
    return _mapped(is_private_url, "boolean", url)


def html_abstract(html: Column) -> Column:
    return _mapped(abstract_of_html, "string", html)


def feed_summary(xml: Column) -> Column:
    return _mapped(summary_of_feed, "string", xml)
