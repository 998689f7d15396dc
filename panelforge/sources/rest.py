"""Paged market-data sources as a PySpark data source: one partition for each symbol.

A fetcher gets a symbol and a cursor and returns a page of records and the next cursor (None at the
end). Tasks are the concurrency; transient failures are retried within the task, and what still
fails is Spark's task retry to handle. With no records a symbol simply has no rows.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class TransientError(Exception):
    """Worth another try: a rate limit, a server error, a timeout."""

    def __init__(self, message: str = "", *, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


@dataclass(frozen=True)
class Retry:
    """Attempts, and how long to wait between them: what the server says (60 s at most), 30 s for a bare rate limit, else 2 to 10 s."""

    attempts: int = 3
    sleep: Callable[[float], None] = time.sleep

    def wait(self, attempt: int, error: TransientError) -> float:
        if error.retry_after is not None:
            return min(error.retry_after, 60.0)
        return 30.0 if error.status == 429 else min(10.0, 2.0 * 2**attempt)

    def call(self, f, *args):
        for attempt in range(self.attempts):
            try:
                return f(*args)
            except TransientError as error:
                if attempt == self.attempts - 1:
                    raise
                self.sleep(self.wait(attempt, error))


def pages(fetch, symbol: str, *, most: int = 5000, retry: Retry = Retry()) -> Iterator[dict]:
    """All records of a symbol, page by page; `most` pages at most, as a guard against endless sources."""
    cursor = None
    for _ in range(most):
        records, cursor = retry.call(fetch, symbol, cursor)
        yield from records
        if cursor is None or not records:
            return
    raise RuntimeError(f"{symbol}: more than {most} pages")


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], fetcher: str, symbols: list[str]):
        self.names, self.fetcher, self.symbols = names, fetcher, symbols

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.symbols]

    def read(self, partition: _Symbol) -> Iterator[tuple]:
        module, name = self.fetcher.split(":")
        fetch = getattr(importlib.import_module(module), name)
        for record in pages(fetch, partition.symbol):
            yield tuple(partition.symbol if n == "symbol" and n not in record else record.get(n) for n in self.names)


class PagedSource(DataSource):
    """`spark.read.format("paged").schema(...).option("fetcher", "module:function").option("symbols", "A,B")`."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> DataSourceReader:
        symbols = [s for s in self.options.get("symbols", "").split(",") if s]
        return _Reader(schema.names, self.options["fetcher"], symbols)


def window(fetch, symbol: str, first: int, last: int, *, time_of: str = "t", descending: bool = False, retry: Retry = Retry()) -> Iterator[dict]:
    """All records of a symbol from `first` to `last` (milliseconds, both included), each once.

    `fetch(symbol, first, last)` gives a page of them: the oldest, or, `descending`, the newest. The
    next request starts at the time that the page ended with, as that may have more records than the
    page had room for; what it has already given is left out.
    """
    edge: list[dict] = []  # records given at the time where the next page starts
    while first <= last:
        page = [r for r in retry.call(fetch, symbol, first, last) if first <= r[time_of] <= last]
        fresh = [r for r in page if r not in edge]
        yield from fresh
        if not fresh:
            if not page or len(page) > len(edge) or not edge:
                return
            # the page is full of one time: on to the next
            edge = []
            first, last = (first, last - 1) if descending else (first + 1, last)
            continue
        end = (min if descending else max)(r[time_of] for r in page)
        edge = [r for r in page if r[time_of] == end]
        first, last = (first, end) if descending else (end, last)


class _Window(InputPartition):
    def __init__(self, symbol: str, first: int, last: int):
        super().__init__((symbol, first, last))
        self.symbol, self.first, self.last = symbol, first, last


class _StreamReader(DataSourceStreamReader):
    """Offsets are, for each symbol, the time up to which it is read (excluded); a batch is windows of `step` at most, each a task.

    A batch that fails is read again between the same offsets, so it has the same rows.
    """

    def __init__(self, names: list[str], fetcher: str, symbols: list[str], *, start: int, until: int | None, step: int, time_of: str, descending: bool):
        self.names, self.fetcher, self.symbols = names, fetcher, symbols
        self.start, self.until, self.step, self.time_of, self.descending = start, until, step, time_of, descending

    def initialOffset(self) -> dict:
        return {s: self.start for s in self.symbols}

    def latestOffset(self) -> dict:
        now = int(time.time() * 1000) // self.step * self.step if self.until is None else self.until
        return {s: max(now, self.start) for s in self.symbols}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for symbol, to in end.items():
            at = start.get(symbol, self.start)  # a symbol that is new begins at the beginning
            out += [_Window(symbol, a, min(a + self.step, to) - 1) for a in range(at, to, self.step)]
        return out

    def read(self, partition: _Window) -> Iterator[tuple]:
        module, name = self.fetcher.split(":")
        fetch = getattr(importlib.import_module(module), name)
        for record in window(fetch, partition.symbol, partition.first, partition.last, time_of=self.time_of, descending=self.descending):
            yield tuple(partition.symbol if n == "symbol" and n not in record else record.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        """What is read is known by Spark's checkpoint alone."""


class PagedStream(DataSource):
    """`spark.readStream.format("paged_stream").schema(...)` with the options fetcher ("module:function"), symbols ("A,B"),
    start and until (milliseconds; without the latter, the last full `step` before now), step (milliseconds of a task's
    window; a day by default), time (the records' field) and order ("ascending" or "descending" pages).

    A query that stops or fails goes on, from its checkpoint, where its last whole batch ended.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_stream"

    def streamReader(self, schema) -> DataSourceStreamReader:
        get = self.options.get
        order = get("order", "ascending")
        if order not in ("ascending", "descending"):
            raise ValueError(f"order is ascending or descending, not {order}")
        return _StreamReader(
            schema.names, self.options["fetcher"], [s for s in get("symbols", "").split(",") if s], start=int(get("start", "0")),
            until=int(get("until")) if get("until") is not None else None, step=int(get("step", "86400000")), time_of=get("time", "t"), descending=order == "descending",
        )
