"""Streams: extraction, routing, redirects, job monitor, metrics, deduplication, votes and re-analysis.

Each is a batch operator applied to micro-batches or with a watermark, and gives what the batch operator gives on the
same rows. Batches are written to a folder that carries the batch's number, so a batch that runs twice replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import documents as D
from ..operators import features as A
from ..operators import frontier as R
from ..operators import html as H
from ..operators import periods as P
from ..operators import trust as T
from ..sources.index import IndexTable


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _replace(df: DataFrame, out: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def stream_extract(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Pages to paragraphs to documents to periods. A page is never split over batches. pages: page_id, url, html and, for
    the rules that hold, source_type."""

    def each(batch: DataFrame, number: int) -> None:
        _replace(P.periods_of(extracted(batch)), out, number)

    return _start(pages, each, checkpoint)


def extracted(pages: DataFrame, now: Column | None = None) -> DataFrame:
    """Documents of pages with doc_id (the page's), doc_seq, url, text and metadata; pages are media unless they have a
    source_type."""
    typed = pages if "source_type" in pages.columns else pages.withColumn("source_type", F.lit("media"))
    return D.extract_documents(typed, F.current_timestamp() if now is None else now).withColumnRenamed("page_id", "doc_id")


def stream_route(requests: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Three outputs: crawl, search and leaf. requests: is_crawl, is_search and others."""

    def each(batch: DataFrame, number: int) -> None:
        _replace(batch.withColumn("route", R.route(F.col("is_crawl"), F.col("is_search"))).repartition("route"), out, number)

    return _start(requests, each, checkpoint)


def stream_redirects(log: DataFrame, out: str, checkpoint: str, most: int = 5) -> StreamingQuery:
    """Targets of redirects become frontier rows, with a count of hops up to `most`. log: url, target, code, hops."""

    def each(batch: DataFrame, number: int) -> None:
        hops = batch.filter((F.col("code").between(300, 399)) & (F.col("code") != 304) & (F.col("hops") < most) & F.col("target").isNotNull())
        _replace(hops.select(F.col("target").alias("url"), (F.col("hops") + 1).alias("hops")).distinct(), out, number)

    return _start(log, each, checkpoint)


def frontier_with_redirects(frontier: DataFrame, redirects: DataFrame) -> DataFrame:
    """The frontier (url, hops) and the targets that stream_redirects wrote, each address once, with its fewest hops: what
    the next fetch reads, so that targets are fed back."""
    return frontier.select("url", "hops").unionByName(redirects.select("url", "hops")).groupBy("url").agg(F.min("hops").alias("hops"))


class JobMonitor(StatefulProcessor):
    """State of one job: open and committed requests; ends when nothing is open, or 24 hours after it began."""

    def __init__(self, seconds: int = 86400):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "open long, committed long, began long, status string")

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else None
        open_, committed, began, status = held if held is not None else (0, 0, None, "working")
        for pdf in rows:
            open_ += int(pdf["opened"].sum())
            committed += int(pdf["committed"].sum())
            if began is None:
                began = int(pdf["ts"].min().timestamp() * 1000)
                self.handle.registerTimer(began + self.seconds * 1000)
        if status == "working" and open_ == 0:
            status = "finished"
        self.state.update((open_, committed, began, status))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "open": [open_], "committed": [committed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        open_, committed, began, status = self.state.get()
        if status == "working":
            self.state.update((open_, committed, began, "terminated"))
            yield pd.DataFrame({"job": [key[0]], "status": ["terminated"], "open": [open_], "committed": [committed]})

    def close(self) -> None:
        pass


def stream_job_monitor(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """job, status, open, committed at each change. changes: job, ts, opened (+1 or -1), committed (0 or 1).

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass."""
    return changes.withWatermark("ts", delay).groupBy("job").transformWithStateInPandas(JobMonitor(), "job long, status string, open long, committed long", "Update", "EventTime")


SITE = (*R.COUNTED, "known", "depth")
MONITORED = f"job long, status string, started timestamp, websites int, subreddits int, is_crawl boolean, {', '.join(f'{c} long' for c in R.COUNTED)}, depth int, sites_known long"


class JobProgress(StatefulProcessor):
    """State of one job: its row, its requests as they last were, and counts by site, which a change adds to and takes from.
    A job begins as the jobs table has it, or else with its first change. It ends when nothing is open, or `seconds` after
    it began; then the requests and counts are dropped."""

    def __init__(self, seconds: int = 86400):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, started long, websites int, subreddits int, is_crawl boolean")
        self.requests = handle.getMapState("requests", "request long", "site string, kind string, is_search boolean, lead_count int, status string")
        self.sites = handle.getMapState("sites", "site string", ", ".join(f"{c} long" for c in SITE))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self._begin(row["status"], int(row["started"].timestamp() * 1000), int(row["websites"]), int(row["subreddits"]), bool(row["is_crawl"]))

    def _begin(self, status: str, started: int, websites: int, subreddits: int, is_crawl: bool) -> None:
        self.job.update((status, started, websites, subreddits, is_crawl))
        self.handle.registerTimer(started + self.seconds * 1000)

    @staticmethod
    def _counts(kind: str, is_search: bool, status: str) -> list[int]:
        """Which of SITE a request counts for, but depth."""
        open_, done, web, reddit = status in R.OPEN, status == "committed", kind == "web", kind == "reddit"
        tests = [web and is_search and done, reddit and is_search and done, web and not is_search and done, reddit and not is_search and done, web and not is_search, reddit and not is_search, web and is_search, reddit and is_search and status == "ran"]
        return [int(x) for x in (*tests, is_search and open_, not is_search and open_, not is_search and done, status == "failed", open_ or status in ("committed", "failed"))]

    def _add(self, site: str, counts: list[int], sign: int, depth: int) -> None:
        old = self.sites.getValue((site,)) if self.sites.containsKey((site,)) else (0,) * len(SITE)
        self.sites.updateValue((site,), (*(x + sign * y for x, y in zip(old, counts, strict=False)), max(old[-1], depth)))

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            if not self.job.exists():
                self._begin("working", int(pdf["ts"].min().timestamp() * 1000), pdf["site"].nunique(), 0, False)
            if self.job.get()[0] == "terminated":
                continue
            for r in pdf.sort_values("ts", kind="stable").itertuples():
                request = (int(r.request),)
                if self.requests.containsKey(request):
                    site, kind, is_search, _, status = self.requests.getValue(request)
                    self._add(site, self._counts(kind, is_search, status), -1, 0)
                now = (str(r.site), str(r.kind), bool(r.is_search), int(r.lead_count), str(r.status))
                self.requests.updateValue(request, now)
                self._add(now[0], self._counts(now[1], now[2], now[4]), 1, now[3])
        yield from self._told(key, False)

    def _told(self, key, late: bool):
        total, depth, known = [0] * len(R.COUNTED), 0, 0
        for (site,), counts in self.sites.iterator():
            total = [x + y for x, y in zip(total, counts, strict=False)]
            depth, known = max(depth, counts[-1]), known + (counts[-2] > 0 and not site.startswith("/r/"))
        status, started, *rest = self.job.get()
        if status == "working":
            open_ = total[R.COUNTED.index("searches_open")] + total[R.COUNTED.index("pages_open")]
            status = "terminated" if late else "finished" if open_ == 0 else status
            self.job.update((status, started, *rest))
        values = [key[0], status, pd.Timestamp(started, unit="ms"), *rest, *total, depth, known]
        yield pd.DataFrame({c.split()[0]: [v] for c, v in zip(MONITORED.split(", "), values, strict=True)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.job.get()[0] == "working":
            yield from self._told(key, True)
        self.requests.clear()
        self.sites.clear()

    def close(self) -> None:
        pass


def stream_job_progress(changes: DataFrame, jobs: DataFrame | None = None, delay: str = "1 hour", seconds: int = 86400, **estimates) -> DataFrame:
    """The jobs of each batch as they are after it: what progress() and job_transitions() tell of the same changes.

    changes: job, ts, request, site, kind, is_search, lead_count, status, in order of ts by request; jobs, with which the
    state begins: job, status, started, websites, subreddits, is_crawl. A job without requests tells nothing before its first
    change. Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass."""
    begin = jobs.groupBy("job") if jobs is not None else None
    rows = changes.withWatermark("ts", delay).groupBy("job").transformWithStateInPandas(JobProgress(seconds), MONITORED, "Update", "EventTime", begin)
    return R.with_progress(rows, **estimates)


def stream_index(updates: DataFrame, table: IndexTable, checkpoint: str) -> StreamingQuery:
    """Batches into a stored index, each once: a batch that runs again finds its number there."""
    return _start(updates, lambda batch, number: table.upsert(batch, number) and None, checkpoint)


def stream_metrics(log: DataFrame, late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Counters by minute; rows later than the watermark are dropped."""
    return R.fetch_metrics(log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), every)


def stream_dedupe_urls(requests: DataFrame, window: str = "12 hours") -> DataFrame:
    """The first request for each address within the window."""
    return requests.withWatermark("ts", window).dropDuplicatesWithinWatermark(["url"])


def stream_feedback(votes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Votes as they come. `folder` holds the state: batch=-1 has the links and permissions of the start (folders links and
    permissions), and each batch writes both as they are after it, from those before it. A permission that was used stays
    used, and a batch that runs again starts from the same state, so no vote counts twice."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        links, permissions = (spark.read.parquet(f"{folder}/{x}/batch={number - 1}") for x in ("links", "permissions"))
        T.apply_feedback(links, batch, permissions).write.mode("overwrite").parquet(f"{folder}/links/batch={number}")
        T.use_permissions(permissions, batch).write.mode("overwrite").parquet(f"{folder}/permissions/batch={number}")

    return _start(votes, each, checkpoint)


def stream_reanalyse(queries: DataFrame, periods: Callable[[DataFrame], DataFrame], sentences: Callable[[DataFrame], DataFrame], now: Column, out: str, checkpoint: str, least: int = 200) -> StreamingQuery:
    """Queries drive the context features of the periods that they name; all queries of a batch run together."""

    def each(batch: DataFrame, number: int) -> None:
        _replace(A.analyse_contexts(periods(batch), sentences(batch), "context_id", "doc_location", now, least), out, number)

    return _start(queries, each, checkpoint, {"processingTime": "5 seconds"})
