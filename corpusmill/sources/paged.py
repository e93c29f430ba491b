"""Paged record services.

Live: a *fetcher* maps a request to a page; ``fetch_all`` walks its pages by offset, page number or cursor inside a
Spark data source whose partitions are slices.  Pages are validated: one that is shorter than it should be is an
error, not the end of the data.

Recorded: pages saved as JSON are read by Spark itself (any file system), checked and flattened as DataFrames; a table
of finished slices says what need not be fetched again."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (slice, position) -> page; a position is an offset, a page number or a cursor.
Fetcher = Callable[[str, object], dict | None]


class TransientError(OSError):
    """A failure after which it is worth trying again; ``after`` seconds, if the service says so."""

    def __init__(self, status: int, after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.after = status, after


def checked_status(status: int, after: float | None = None) -> bool:
    """True for a page, False for 404; raises TransientError for 429 and 5xx and ValueError for what else fails."""
    if 200 <= status < 400:
        return True
    if status == 404:
        return False
    if status == 429 or status >= 500:
        raise TransientError(status, after)
    raise ValueError(f"status {status}")


@dataclass
class Politeness:
    """Least seconds between requests to a host, the waits after failures, and the longest wait that a service may ask."""

    gap: float = 0.0
    waits: tuple[float, ...] = (2.0, 4.0, 8.0)
    longest: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: dict[str, float] = field(default_factory=dict)

    def call(self, host: str, request: Callable[[], dict | None]) -> dict | None:
        for wait in (*self.waits, None):
            if host in self.last:
                self.sleep(max(0.0, self.gap - (self.clock() - self.last[host])))
            self.last[host] = self.clock()
            try:
                return request()
            except OSError as e:
                if wait is None:
                    raise
                asked = getattr(e, "after", None)
                self.sleep(wait if asked is None else min(asked, self.longest))
        return None


def fetch_all(fetch: Fetcher, slice_: str, page: int, cap: int | None = None, style: str = "offset", polite: Politeness | None = None, host: str = "") -> Iterator[dict]:
    """Items of all pages of a slice, up to ``cap``.  A page: total, items and, in style "cursor", next.  A slice that is
    not there (None) has no items."""
    polite = polite or Politeness()
    position, seen, total = {"offset": 0, "number": 1, "cursor": "*"}[style], 0, None
    while total is None or seen < min(total, total if cap is None else cap):
        got = polite.call(host, lambda at=position: fetch(slice_, at))
        if got is None:
            return
        total = got["total"]
        due, items = min(page, total - seen), got["items"]
        if len(items) < due:
            raise ValueError(f"{slice_} at {position}: {len(items)} items, {due} expected")
        room = len(items) if cap is None else max(0, cap - seen)
        yield from items[:room]
        seen += max(1, len(items))
        if style == "cursor":
            if got.get("next") in (None, position):
                return
            position = got["next"]
        else:
            position = seen if style == "offset" else position + 1


def id_batches(ids: DataFrame, known: DataFrame, key: str, size: int = 20, most: int = 10) -> DataFrame:
    """request, ids, left_over: what to ask for by id: those not known yet, ascending, ``size`` a request, ``most`` requests
    as the service allows, and how many ids are left for another time."""
    every = ids.select(key).distinct().join(known.select(key), key, "left_anti")
    left = max(0, every.count() - size * most)
    fresh = every.orderBy(key).limit(size * most)
    place = F.row_number().over(Window.orderBy(key)) - 1  # size * most rows at most
    fresh = fresh.withColumn("request", F.floor(place / size)).groupBy("request").agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return fresh.withColumn("left_over", F.lit(left).cast("long"))


def fetch_ids(fetch: Fetcher, batches: list[list], polite: Politeness | None = None) -> Iterator[dict]:
    """Items of requests by id.  A batch that comes back short is asked for one by one, so that one bad id loses no other."""
    polite = polite or Politeness()
    for batch in batches:
        got = polite.call("", lambda b=batch: fetch(",".join(map(str, b)), None))
        items = [] if got is None else got["items"]
        if len(items) < len(batch) and len(batch) > 1:
            yield from fetch_ids(fetch, [[x] for x in batch], polite)
        else:
            yield from items


def count_only(fetch: Fetcher, slice_: str, polite: Politeness | None = None) -> int:
    """What a service says it has, without its items."""
    got = (polite or Politeness()).call("", lambda: fetch(slice_, None))
    return 0 if got is None else int(got["total"])


def made(slice_: str, position: object, page: int = 100) -> dict | None:
    """A made service to try things on: slice "name:count" has the items name-0 to name-(count - 1), by offset."""
    name, _, count = slice_.partition(":")
    if not count:
        return None
    begin = int(position or 0)
    return {"total": int(count), "items": [{"id": f"{name}-{i}", "n": i} for i in range(begin, min(begin + page, int(count)))]}


class _Slice(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PagedSource(DataSource):
    """spark.read.format("paged").option("fetcher", "module:name").option("slices", "a,b").option("page", 100).load()

    The fetcher is imported where it runs.  Options: page, cap, style (offset, number or cursor), gap."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "slice string, id string, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetcher, self.slices = options.get("fetcher", f"{__name__}:made"), options["slices"].split(",")
        self.page, self.style, self.gap = int(options.get("page", 100)), options.get("style", "offset"), float(options.get("gap", 0))
        self.cap = int(options["cap"]) if options.get("cap") else None

    def partitions(self) -> list[InputPartition]:
        return [_Slice(s) for s in self.slices]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        from importlib import import_module

        module, _, name = self.fetcher.partition(":")
        held: list[dict] = []
        for item in fetch_all(getattr(import_module(module), name), partition.name, self.page, self.cap, self.style, Politeness(self.gap)):
            held.append(item)
            if len(held) == self.page:
                yield self._batch(partition.name, held)
                held = []
        if held:
            yield self._batch(partition.name, held)

    @staticmethod
    def _batch(slice_: str, items: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slice_] * len(items)), pa.array([str(x.get("id", "")) for x in items]), pa.array([json.dumps(x, ensure_ascii=False) for x in items])], ["slice", "id", "body"])


RECORDED = "slice string, position long, cursor string, next string, total long, items array<string>"


def recorded_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Saved pages, a JSON object a line: slice, position (offset or page number), cursor and next, total, items."""
    return spark.read.schema(RECORDED).json(folder)


def ordered_by_cursor(pages: DataFrame, most: int) -> DataFrame:
    """Pages of cursor services with their place: the page of cursor '*' first, then each page's next.  One join of page
    descriptions a step, at most ``most`` steps (the pages that a slice can have under its cap)."""
    links = pages.select("slice", "cursor", F.col("next").alias("following"))
    step = pages.where("cursor = '*'").select("slice", "cursor", F.lit(0).alias("place"))
    found = step
    for place in range(1, most):
        step = step.join(links, ["slice", "cursor"]).where("following IS NOT NULL AND following <> cursor").select("slice", F.col("following").alias("cursor"), F.lit(place).alias("place"))
        found = found.unionByName(step)
    return pages.join(found, ["slice", "cursor"])


def page_problems(pages: DataFrame, page: int, style: str = "offset") -> DataFrame:
    """slice, position, held, due of the pages that are shorter than their total makes them due, and of pages that are
    missing (held is null)."""
    start = F.col("position") if style == "offset" else (F.col("position") - 1) * page
    due = F.least(F.lit(page), F.col("total") - start)
    held = pages.select("slice", "position", F.size("items").cast("long").alias("held"), due.alias("due"), "total")
    # What a slice should have, from its own total: as many rows as it has pages.
    first, width = (0, page) if style == "offset" else (1, 1)
    places = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("whole") / page) - 1)
    should = pages.groupBy("slice").agg(F.max("total").alias("whole")).where("whole > 0").select("slice", F.explode(places).alias("place"))
    should = should.select("slice", (F.col("place") * width + first).alias("position"))
    return should.select("slice", "position").join(held, ["slice", "position"], "left").where("held IS NULL OR held < due").select("slice", "position", "held", "due")


def page_items(pages: DataFrame, page: int, cap: int | None = None, style: str = "offset") -> DataFrame:
    """slice, place, body of the items of recorded pages, up to ``cap`` a slice."""
    start = F.col("place") * page if style == "cursor" else F.col("position") if style == "offset" else (F.col("position") - 1) * page
    items = pages.select("slice", start.alias("start"), F.posexplode("items").alias("i", "body")).select("slice", (F.col("start") + F.col("i")).alias("place"), "body")
    return items if cap is None else items.where(F.col("place") < cap)


def slice_log(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """slice, total, fetched, pages, truncated (more is there, and the cap was reached) and done of each slice."""
    out = pages.groupBy("slice").agg(F.max("total").alias("total"), F.sum(F.size("items")).alias("held"), F.count("*").alias("pages"))
    fetched = F.col("held") if cap is None else F.least(F.col("held"), F.lit(cap))
    truncated = F.lit(False) if cap is None else (F.col("total") > fetched) & (fetched >= cap)
    return out.select("slice", "total", fetched.alias("fetched"), "pages", truncated.alias("truncated"), ((fetched >= F.col("total")) | truncated).alias("done"))


def month_slices(spark: SparkSession, categories: list[str], first: str, last: str) -> DataFrame:
    """category, slice, begin, end: a slice for each category and calendar month of a closed range of days."""
    months = F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("interval 1 month"))
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias("category"), months.alias("m")).select("category", F.explode("m").alias("m"))
    begin, end = F.greatest("m", F.lit(first).cast("date")), F.least(F.last_day("m"), F.lit(last).cast("date"))
    return rows.select("category", F.concat_ws("/", "category", F.date_format("m", "yyyy-MM")).alias("slice"), begin.alias("begin"), end.alias("end"))


def unfinished(slices: DataFrame, log: DataFrame) -> DataFrame:
    """Slices that the log doesn't mark as done."""
    return slices.join(log.where("done").select("slice"), "slice", "left_anti")


def keep_latest_pages(pages: DataFrame) -> DataFrame:
    """One page for each slice and position: a page that was fetched again replaces the older one."""
    rank = F.row_number().over(Window.partitionBy("slice", "position").orderBy(F.size("items").desc(), F.xxhash64("items")))
    return pages.withColumn("rank", rank).where("rank = 1").drop("rank")
