"""Paged traffic reports (S11, S12) as a batch data source: answers of a search or an analytics service, one row for each page.

    spark.dataSource.register(Reports)
    rows = spark.read.format("report").option("url", ...).option("kind", "search").load().where("day between ... and ...")
    periods.search_rows(rows)

Filters on day and dimension become the requests, if the session has spark.sql.python.filterPushdown.enabled; without it the
options `start` and `end` set the days, and Spark filters.  A task asks for one day and dimension, page after page until one is
not full; with the option `expectedRows` each page up to that row is a task of its own, and the last of them goes on.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "day date, dimension string, start_row int, body string"
#: Metrics that an analytics request names, in order; the usual dimension; seconds of a request; rows of a page.
METRICS = ["activeUsers", "newUsers", "sessions", "engagedSessions", "engagementRate", "screenPageViews", "keyEvents", "userEngagementDuration"]
USUAL = {"search": "query", "analytics": "sessionDefaultChannelGroup"}
TIMEOUT, ROWS = 30, {"search": 25_000, "analytics": 10_000}
#: Answers that are asked for again.
AGAIN = {408, 429, 500, 502, 503, 504}


def request_body(kind: str, day: date, dimension: str, start: int, rows: int) -> dict:
    if kind == "search":
        return {"startDate": str(day), "endDate": str(day), "dimensions": [dimension], "rowLimit": rows, "startRow": start, "dataState": "final"}
    return {"dateRanges": [{"startDate": str(day), "endDate": str(day)}], "dimensions": [{"name": dimension}], "metrics": [{"name": m} for m in METRICS], "offset": str(start), "limit": str(rows), "keepEmptyRows": False}


def ask(url: str, body: dict, headers: dict[str, str], retries: int, wait: float, timeout: float) -> str:
    """The answer's text.  Failures of the network and of a busy service are tried again, each time after twice the wait; any
    other is an error with what the service said."""
    for left in range(retries, -1, -1):
        try:
            made = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
            with urllib.request.urlopen(made, timeout=timeout) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or not left:
                raise RuntimeError(_said(e)) from e
        except OSError as e:
            if not left:
                raise RuntimeError(f"Report request failed: {e}") from e
        time.sleep(wait)
        wait *= 2
    raise ValueError("retries must not be negative")


def _said(e: urllib.error.HTTPError) -> str:
    try:
        return json.loads(e.read())["error"]["message"]
    except (ValueError, KeyError, TypeError):
        return f"Report request failed: {e.code}"


class _Part(InputPartition):
    def __init__(self, day: date | None, dimension: str, start: int, goes_on: bool):
        self.day, self.dimension, self.start, self.goes_on = day, dimension, start, goes_on


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.kind = options["url"], options.get("kind", "search")
        if self.kind not in ROWS:
            raise ValueError(f"kind must be one of {', '.join(ROWS)}")
        self.headers = json.loads(options.get("headers", "{}"))
        self.rows = min(int(options.get("rowsPerPage", ROWS[self.kind])), ROWS[self.kind])
        if self.rows < 1:
            raise ValueError("rowsPerPage must be positive")
        self.expected = int(options.get("expectedRows", 0))
        self.retries, self.wait, self.timeout = int(options.get("retries", 3)), float(options.get("wait", 0.5)), float(options.get("timeout", TIMEOUT))
        self.first, self.last = [date.fromisoformat(options[o]) if o in options else None for o in ("start", "end")]
        self.days: set[date] | None = None
        own = options.get("dimensions", USUAL[self.kind])
        self.dimensions = list(dict.fromkeys(x.strip() for x in own.split(",") if x.strip()))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not (self._day(f) if getattr(f, "attribute", None) == ("day",) else self._dimension(f)):
                yield f

    def _day(self, f: Filter) -> bool:
        one = timedelta(days=1)
        if isinstance(f, EqualTo | In):
            asked = set(f.value if isinstance(f, In) else [f.value]) - {None}
            self.days = asked if self.days is None else self.days & asked
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            low = f.value + one if isinstance(f, GreaterThan) else f.value
            self.first = max(low, self.first or low)
        elif isinstance(f, LessThan | LessThanOrEqual):
            high = f.value - one if isinstance(f, LessThan) else f.value
            self.last = min(high, self.last or high)
        else:
            return isinstance(f, IsNotNull)
        return True

    def _dimension(self, f: Filter) -> bool:
        """A dimension is asked for by its name; other filters on it are left to Spark."""
        if getattr(f, "attribute", None) != ("dimension",) or not isinstance(f, EqualTo | In | IsNotNull):
            return False
        if not isinstance(f, IsNotNull):
            asked = f.value if isinstance(f, In) else [f.value]
            self.dimensions = [d for d in self.dimensions if d in asked]
        return True

    def partitions(self):
        if self.days is None:
            if self.first is None or self.last is None:
                raise ValueError("set the options start and end, or filter by day with spark.sql.python.filterPushdown.enabled")
            self.days = {self.first + timedelta(days=k) for k in range((self.last - self.first).days + 1)}
        days = sorted(d for d in self.days if (self.first is None or d >= self.first) and (self.last is None or d <= self.last))
        starts = list(range(0, max(self.expected, 1), self.rows))
        parts = [_Part(day, dimension, s, s == starts[-1]) for day in days for dimension in self.dimensions for s in starts]
        return parts or [_Part(None, "", 0, False)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        start = partition.start
        while partition.day is not None:
            text = ask(self.url, request_body(self.kind, partition.day, partition.dimension, start, self.rows), self.headers, self.retries, self.wait, self.timeout)
            n = len(json.loads(text).get("rows") or [])
            if n:
                yield partition.day, partition.dimension, start, text
            if n < self.rows or not partition.goes_on:
                return
            start += self.rows


class Reports(DataSource):
    """Options: url, kind (search or analytics), dimensions, start, end, rowsPerPage, expectedRows, headers (JSON), retries,
    wait, timeout."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
