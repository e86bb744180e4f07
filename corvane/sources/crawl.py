"""A bounded crawl: the frontier and the visited set are DataFrames, fetching is an injected transport.

A round fetches the queue in order on the driver (network input), parses links on the executors, and gets the next queue
by an anti join against all URLs seen. At most ``max_pages`` pages are kept and ten times as many fetches tried.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import url as U
from corvane.functions.text import text_sha256

PAGES = "source_url string, canonical_url string, content string, http_status int, content_type string, nth int"


class Response(NamedTuple):
    url: str
    status: int
    content_type: str
    body: bytes


Transport = Callable[[str], Response]


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.links: list[str] = []
        self.canonical: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        if tag == "a" and found.get("href"):
            self.links.append(found["href"])
        if tag == "link" and "canonical" in (found.get("rel") or "").split() and found.get("href") and self.canonical is None:
            self.canonical = found["href"]


_CHARSET = re.compile(r"charset=[\"']?([^;\s\"'>/]+)", re.I)


def decode_html(body: bytes, content_type: str) -> str:
    """By the header's charset, else the one that the page names at its start, else UTF-8; ``ValueError`` if that fails."""
    named = _CHARSET.search(content_type) or _CHARSET.search(body[:1024].decode("ascii", "replace"))
    charset = named[1] if named else "utf-8"
    try:
        return body.decode(charset)
    except (LookupError, UnicodeDecodeError) as e:
        raise ValueError(f"page is not readable as {charset}") from e


def _site(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}".lower()


def links_of(html: str, base: str) -> tuple[list[str], str | None]:
    """The links of a page and its canonical URL, resolved; links that are no URL are left out, and so is what comes after a
    place that the parser can't read."""
    parsed = _Links()
    with contextlib.suppress(Exception):  # a malformed declaration, for one
        parsed.feed(html)

    def resolved(link: str) -> str | None:
        try:
            return urljoin(base, link)
        except ValueError:
            return None

    return [u for link in parsed.links if (u := resolved(link)) is not None], parsed.canonical and resolved(parsed.canonical)


def robots(transport: Transport, agent: str = "*") -> Callable[[str], bool]:
    """Whether a URL may be fetched, by its site's robots.txt, which is asked for once. A site without one (404, 410) allows
    everything; one whose file can't be had, or is at another site, allows nothing."""
    rules: dict[str, RobotFileParser] = {}

    def allowed(url: str) -> bool:
        site = _site(url)
        if site not in rules:
            rules[site] = RobotFileParser()
            got = fetch(transport, f"{site}/robots.txt")
            if got is not None and got.status in (404, 410):
                lines = []
            elif got is not None and 200 <= got.status < 300 and _site(got.url) == site:
                lines = got.body.decode("utf-8", "replace").splitlines()
            else:
                lines = ["User-agent: *", "Disallow: /"]
            rules[site].parse(lines)
        return rules[site].can_fetch(agent, url)

    return allowed


def fetch(transport: Transport, url: str, retries: int = 2) -> Response | None:
    """``retries`` more tries after errors; 404 and 410 end at once."""
    for _ in range(retries + 1):
        try:
            got = transport(url)
        except OSError:
            continue
        if got.status in (404, 410) or 200 <= got.status < 300:
            return got
    return None


def crawl(spark: SparkSession, starts: list[str], transport: Transport, max_pages: int, allowed: Callable[[str], bool] = lambda url: True, pause: Callable[[], None] = lambda: None) -> DataFrame:
    """Pages in breadth-first order within the directories of the start URLs; canonical duplicates are dropped.

    ``allowed`` may be ``robots(transport)``; ``pause`` is called between fetches. A page that a redirect took out of the
    directories, or that cannot be decoded, is not kept.
    """
    first = spark.createDataFrame([(s,) for s in starts], "url string").select(U.normalised(F.col("url")).alias("url")).dropna()
    bounds = [r[0] for r in first.select(U.boundary(F.col("url"))).distinct().collect()]
    queue = [r[0] for r in first.distinct().collect()]
    queue = [u for u in dict.fromkeys(queue)]
    seen, pages, owned, tries, fetched = set(queue), [], set(), 0, False
    while queue and len(pages) < max_pages and tries < 10 * max_pages:
        found: list[tuple[str, str]] = []
        for url in queue:
            if len(pages) >= max_pages or tries >= 10 * max_pages:
                break
            tries += 1
            if not allowed(url):
                continue
            if fetched:
                pause()
            fetched, got = True, fetch(transport, url)
            if got is None or not 200 <= got.status < 300 or not any(got.url.startswith(b) for b in bounds):
                continue
            try:
                html = decode_html(got.body, got.content_type)
            except ValueError:
                continue
            links, canonical = links_of(html, got.url)
            own = canonical if canonical and any(canonical.startswith(b) for b in bounds) else got.url
            # What is no page, or another copy of one, counts for nothing and leads nowhere.
            if got.content_type.split(";")[0].strip().lower() not in U.HTML_TYPES or own in owned:
                continue
            owned.add(own)
            found += [(got.url, link) for link in links]
            pages.append((url, own, html, got.status, got.content_type, len(pages)))
        if not found:
            break
        links = spark.createDataFrame(found, "base string, link string").select(U.normalised(F.col("link")).alias("url")).dropna().distinct()
        fresh = links.where(U.in_scope(F.col("url"), bounds) & U.is_html_candidate(F.col("url"))).join(spark.createDataFrame([(u,) for u in seen], "url string"), "url", "left_anti")
        queue = [r[0] for r in fresh.orderBy("url").limit(10 * max_pages).collect()]  # no more can be tried
        seen.update(queue)
    rows = spark.createDataFrame(pages, PAGES)
    kept = rows.where(U.is_html_type(F.col("content_type")))
    own = U.normalised(F.col("canonical_url"))
    kept = kept.withColumn("canonical_url", F.when(U.in_scope(own, bounds), own).otherwise(F.col("source_url")))
    first_of = kept.groupBy("canonical_url").agg(F.min("nth").alias("nth"))
    return kept.join(first_of, ["canonical_url", "nth"], "left_semi").withColumn("logical_path", U.logical_path(F.col("canonical_url"))).withColumn("content_sha256", text_sha256(F.col("content")))


def content_duplicates(pages: DataFrame) -> DataFrame:
    """One row: pages whose content an earlier page has."""
    return pages.groupBy("content_sha256").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicate_content_count"))


def cache_mismatches(pages: DataFrame) -> DataFrame:
    """Cached pages whose content no longer has its hash: a replay may use the cache only if there is none."""
    return pages.where(text_sha256(F.col("content")) != F.col("content_sha256"))
