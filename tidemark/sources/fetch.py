"""Page fetch (S01, P05, P06): URLs to rows of fetched text, by executors, and as a batch data source of Spark.

Each URL, and each place that it redirects to, must be public (another test may be given); a body is read up to MAX_BYTES, within
TIMEOUT seconds.  What cannot be read is a row with an error, so one bad URL fails no task.
"""

from __future__ import annotations

import ipaddress
import json
import socket
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read of a body, seconds of a request, redirects that are followed, and requests at once in a task.
MAX_BYTES, TIMEOUT, REDIRECTS, AT_ONCE = 2_500_000, 10, 5, 5
SCHEMA = "requested_url string, final_url string, status int, content_type string, x_robots_tag string, html string, ms long, error string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]


def is_public(url: str) -> bool:
    """Whether all addresses of the URL's host are public."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username:
        return False
    if parts.hostname == "localhost" or parts.hostname.endswith((".localhost", ".local")):
        return False
    try:
        found = socket.getaddrinfo(parts.hostname, None)
    except OSError:
        return False
    return bool(found) and all(ipaddress.ip_address(x[4][0].split("%")[0]).is_global for x in found)


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def get(url: str, allowed: Callable[[str], bool] = is_public, most: int = MAX_BYTES, timeout: float = TIMEOUT) -> tuple:
    """A row of SCHEMA."""
    opener, current, began = urllib.request.build_opener(_Stay), url, time.monotonic()
    spent = lambda: int((time.monotonic() - began) * 1000)
    try:
        for _ in range(REDIRECTS + 1):
            if not allowed(current):
                raise ValueError("Private or local network URLs are not allowed.")
            try:
                answer = opener.open(urllib.request.Request(current, headers={"Accept": "text/html,application/xhtml+xml"}), timeout=timeout)
            except urllib.error.HTTPError as e:
                answer = e
            with answer:
                if answer.status in (301, 302, 303, 307, 308) and answer.headers.get("location"):
                    current = urljoin(current, answer.headers["location"])
                    continue
                body = answer.read(most).decode("utf-8", "replace")
                return url, current, answer.status, answer.headers.get("content-type") or "", answer.headers.get("x-robots-tag") or "", body, spent(), None
        raise ValueError("Too many redirects.")
    except Exception as e:  # a row for whatever goes wrong with one URL
        return url, current, None, None, None, None, spent(), str(e)


def _rows(urls: Iterator[str], allowed: Callable[[str], bool], most: int, timeout: float) -> Iterator[pa.RecordBatch]:
    """A batch for each page, as pages may be large; in the order of the URLs, with AT_ONCE requests on their way and no more
    pages than that in memory."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        ask = lambda url: pool.submit(get, url, allowed, most, timeout)
        ahead = deque(map(ask, islice(urls, AT_ONCE)))
        while ahead:
            row = ahead.popleft().result()
            ahead.extend(map(ask, islice(urls, 1)))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], names=_NAMES)


def fetched(urls: DataFrame, url: str = "url", allowed: Callable[[str], bool] = is_public, most: int = MAX_BYTES, timeout: float = TIMEOUT) -> DataFrame:
    """The distinct URLs of a table, fetched where their partitions are; rows of SCHEMA, which page_facts takes."""

    def run(batches):
        for batch in batches:
            yield from _rows((x for x in batch.column(0).to_pylist() if x is not None), allowed, most, timeout)

    return urls.select(url).distinct().mapInArrow(run, SCHEMA)


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.each = int(options.get("urlsPerPartition", 25))
        self.most, self.timeout = int(options.get("maxBytes", MAX_BYTES)), float(options.get("timeout", TIMEOUT))
        self.private = options.get("allowPrivate", "false") == "true"

    def partitions(self):
        return [_Part(self.urls[k : k + self.each]) for k in range(0, len(self.urls), self.each)]

    def read(self, partition):
        yield from _rows(iter(partition.urls), (lambda _: True) if self.private else is_public, self.most, self.timeout)


class Pages(DataSource):
    """spark.dataSource.register(Pages); spark.read.format("pages").option("urls", json_list).load().  Options: urlsPerPartition,
    maxBytes, timeout, allowPrivate."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
