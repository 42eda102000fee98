"""A paged interface with time windows: read at once (``fetch``), or as a stream whose offsets are pages (``paged_source``).

Both have limits on pages, time and bytes, and both refuse a page that came before in its window.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Limits of one run (fixed values): days in a window, rows in a page, pages, seconds, bytes of an answer.
WINDOW_DAYS, PAGE_ROWS, MAX_PAGES, MAX_SECONDS, MAX_BYTES = 30, 1000, 500, 600, 32 << 20
WINDOW_MS = WINDOW_DAYS * 86_400_000
#: Pages of one micro-batch.
BATCH_PAGES = 20


class PageLimit(RuntimeError):
    """The limits of a run were reached; what was read so far is no whole answer."""


def windows(start: datetime, end: datetime) -> Iterator[tuple[datetime, datetime]]:
    while start < end:
        stop = min(end, start + timedelta(days=WINDOW_DAYS))
        yield start, stop
        start = stop


def digest(events: list) -> str:
    return hashlib.sha256(json.dumps(events, sort_keys=True).encode()).hexdigest()


def answered(answer: dict, seen: set[str] | list[str]) -> tuple[list[dict], str, bool]:
    """Events of an answer, their digest, and whether another page follows; too long an answer or one that came before is an error."""
    events = answer.get("usageEvents") or []
    if len(json.dumps(events)) > MAX_BYTES:
        raise PageLimit(f"an answer of more than {MAX_BYTES} bytes")
    found = digest(events)
    if events and found in seen:
        raise PageLimit("a page came twice")
    return events, found, bool((answer.get("pagination") or {}).get("hasNextPage"))


def query(start_ms: int, end_ms: int, page: int) -> dict:
    return {"startDate": start_ms, "endDate": end_ms, "page": page, "pageSize": PAGE_ROWS}


def fetch(request: Callable[[dict], dict], start: datetime, end: datetime, clock: Callable[[], float] = time.monotonic) -> Iterator[dict]:
    """Events of a time range; ``request`` takes the query of one page and gives ``usageEvents`` and ``pagination``."""
    began, pages = clock(), 0
    for since, until in windows(start, end):
        page, seen, more = 1, set(), True
        while more:
            pages += 1
            if pages > MAX_PAGES or clock() - began > MAX_SECONDS:
                raise PageLimit(f"stopped after {pages - 1} pages")
            events, found, more = answered(request(query(int(since.timestamp() * 1000), int(until.timestamp() * 1000), page)), seen)
            seen.add(found)
            yield from events
            page += 1


class PageReader(SimpleDataSourceStreamReader):
    """Reads some pages a batch. An offset is a window's number, the page to read next, and digests of the window's pages so far."""

    def __init__(self, request: Callable[[dict], dict], start_ms: int, end_ms: int, batch_pages: int, clock: Callable[[], float] = time.monotonic):
        self.request, self.start_ms, self.end_ms, self.batch_pages, self.clock = request, start_ms, end_ms, batch_pages, clock

    def initialOffset(self) -> dict:  # noqa: N802
        return {"window": 0, "page": 1, "seen": []}

    def _pages(self, start: dict, until: dict | None = None) -> Iterator[tuple[dict, list[tuple]]]:
        """The offset after each page from ``start`` on, with the page's rows."""
        at, began, pages = dict(start), self.clock(), 0
        while True:
            since = self.start_ms + at["window"] * WINDOW_MS
            if since >= self.end_ms or (until and (at["window"], at["page"]) >= (until["window"], until["page"])):
                return
            if pages >= MAX_PAGES or self.clock() - began > MAX_SECONDS:
                raise PageLimit(f"stopped after {pages} pages")
            end = min(self.end_ms, since + WINDOW_MS)
            events, found, more = answered(self.request(query(since, end, at["page"])), at["seen"])
            pages += 1
            rows = [(since, end, int(e["timestamp"]) if str(e.get("timestamp", "")).lstrip("-").isdigit() else None, json.dumps(e, sort_keys=True)) for e in events]
            at = {"window": at["window"], "page": at["page"] + 1, "seen": [*at["seen"], found]} if more else {"window": at["window"] + 1, "page": 1, "seen": []}
            yield at, rows if more else [*rows, (since, end, None, None)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """Up to ``batch_pages`` pages; a batch ends at the end of a window, so that a window is whole once its last batch is."""
        rows: list[tuple] = []
        end = start
        for n, (after, found) in enumerate(self._pages(start), 1):
            rows += found
            end = after
            if n >= self.batch_pages:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The same pages again, after a restart in the middle of a batch."""
        return iter([row for _, rows in self._pages(start, end) for row in rows])


def paged_source(request: Callable[[dict], dict], name: str = "paged_events") -> type[DataSource]:
    """A data source over a request function, for ``spark.dataSource.register``; options: ``start_ms``, ``end_ms``, ``pages`` (a batch).

    Rows: window_start, window_end, ms, event (JSON); a row without event tells that its window was read to the end.
    """

    class PagedEvents(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "window_start long, window_end long, ms long, event string"

        def simpleStreamReader(self, schema) -> PageReader:  # noqa: N802
            o = self.options
            return PageReader(request, int(o["start_ms"]), int(o["end_ms"]), int(o.get("pages", BATCH_PAGES)))

    return PagedEvents
