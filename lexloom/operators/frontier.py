"""Crawl frontier, jobs and progress: which requests run next, what is skipped, and how far a job is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import queue_key
from ..sources.io import settled

OPEN = ("waiting", "scheduled", "ran")


class _Admission:
    """What is known of the jobs of one key so far: per kind (crawl or not) whether one is open and when one was last
    finished, and when any last changed. Times are in microseconds."""

    def __init__(self, minutes: int, others: int):
        self.wait, self.longer = minutes * 60_000_000, others * 60_000_000
        self.open, self.finished, self.changed = {False: False, True: False}, {}, None

    def old(self, at: int, status: str | None, crawl: bool) -> None:
        self.changed = at
        self.open[crawl] |= status in ("waiting", "working")
        if status == "finished":
            self.finished[crawl] = at

    def asks(self, at: int, privileged: bool, crawl: bool) -> bool:
        if privileged:
            refused = self.open[crawl] or crawl in self.finished and self.finished[crawl] >= at - self.wait
        else:
            refused = self.changed is not None and self.changed >= at - self.longer
        if not refused:
            self.open[crawl], self.changed = True, at
        return not refused


def _admitted(n_keys: int, minutes: int, others: int) -> Callable:
    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, _Admission(minutes, others)
        for batch in batches:
            keep = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_at", "_new", "_status", "_privileged", "_crawl")]
            keys = zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True)
            for now, at, new, status, privileged, crawl in zip(keys, *columns, strict=True):
                if now != key:
                    key, state = now, _Admission(minutes, others)
                keep.append(bool(new) and state.asks(at, privileged, crawl))
                if not new:
                    state.old(at, status, crawl)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_row"))], names=["_row"]).filter(pa.array(keep, pa.bool_()))

    return admit


def dedupe_jobs(new: DataFrame, old: DataFrame, keys: list[str], minutes: int = 5, others: int = 30, order: str | None = None) -> DataFrame:
    """The new jobs that are admitted. new: keys, asked, and perhaps privileged (else true) and is_crawl (else false); old:
    keys, changed, status and perhaps is_crawl. Nulls in keys are alike.

    A privileged user's job is refused while one of the same keys and kind waits or works, or was finished in the last
    `minutes`; another user's while any of the same keys, of whatever status, changed in the last `others` minutes. An
    admitted job waits from when it was asked, so it stands before those asked after it. What changed at the time of asking
    is before; jobs asked at one time go by `order`.

    That is a fold in order of time with a small state, so the jobs of a key are sorted in one task and read one after
    the other; a key with many jobs takes time, but no more memory than others."""

    def flag(df: DataFrame, name: str, default: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = new.select(*keys, micros("asked").alias("_at"), F.lit(1).alias("_new"), F.lit(None).cast("string").alias("_status"), flag(new, "privileged", True).alias("_privileged"), flag(new, "is_crawl", False).alias("_crawl"), (F.col(order) if order else F.xxhash64("*")).alias("_order"), F.struct("*").alias("_row"))
    known = old.select(*keys, micros("changed").alias("_at"), F.lit(0).alias("_new"), F.col("status").cast("string").alias("_status"), F.lit(False).alias("_privileged"), flag(old, "is_crawl", False).alias("_crawl"), F.lit(None).cast(asked.schema["_order"].dataType).alias("_order"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    rows = asked.unionByName(known.filter("_at is not null")).repartition(*keys).sortWithinPartitions(*keys, "_at", "_new", "_order")
    return rows.mapInArrow(_admitted(len(keys), minutes, others), T.StructType([T.StructField("_row", asked.schema["_row"].dataType)])).select("_row.*")


def _places(sites: DataFrame, links: DataFrame, minimum: int) -> DataFrame:
    """Sites with their tags at the minimum level in `of_site`, null without any."""
    of_site = links.filter(F.col("level") >= minimum).groupBy("site").agg(F.sort_array(F.collect_set("tag")).alias("of_site"))
    return sites.join(of_site, "site", "left")


def _asked(jobs: DataFrame) -> DataFrame:
    """One row for each job with its distinct tags and sites."""
    all_of = lambda name: F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    return jobs.groupBy("job").agg(all_of("tags"), all_of("sites"))


def _tagged(asked: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of `asked` by the sites of their tags. A site with several of the tags comes by the least of them only, so
    that the rows, which are many more than jobs and sites, need no shuffle to be distinct. Jobs with the same tags stand
    together, as then the same sites follow each other again and again, which files keep in little space."""
    by_tag = places.withColumn("tag", F.explode("of_site"))
    rows = asked.sortWithinPartitions("tags").withColumn("tag", F.explode("tags")).join(by_tag, "tag")
    return rows.filter((F.size("tags") == 1) | (F.size("of_site") == 1) | (F.array_min(F.array_intersect("tags", "of_site")) == F.col("tag")))


def _named(asked: DataFrame, places: DataFrame) -> DataFrame:
    """Jobs by the sites they name, without those that have one of their tags."""
    return asked.withColumn("site", F.explode("sites")).join(places, "site").filter(~F.coalesce(F.arrays_overlap("tags", "of_site"), F.lit(False)))


def expand_job(jobs: DataFrame, sites: DataFrame, links: DataFrame, minimum: int) -> DataFrame:
    """One request for each job and site: sites named by the job, and sites of its tags at the minimum level. Jobs are few
    beside what they expand to, so the number of their parts is set and does not follow their size."""
    session = jobs.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    asked, places = _asked(jobs.repartition(parts, "job")), _places(sites, links, minimum)
    columns = ["job", *sites.columns]
    return _named(asked, places).select(*columns).unionByName(_tagged(asked, places).select(*columns))


def job_counts(jobs: DataFrame, sites: DataFrame, links: DataFrame, minimum: int) -> DataFrame:
    """job, websites and subreddits: how many sites of each kind a job has requests for; see expand_job. sites: site, kind.

    Sites are counted once for each set of tags, however many jobs have it."""
    asked, places = _asked(jobs), _places(sites, links, minimum)
    numbers = [F.count_if(F.col("kind") != "reddit").alias("websites"), F.count_if(F.col("kind") == "reddit").alias("subreddits")]
    of_tags = _tagged(asked.select("tags").distinct(), places).groupBy("tags").agg(*numbers)
    rows = _named(asked, places).groupBy("job").agg(*numbers).unionByName(asked.join(of_tags, "tags").select("job", "websites", "subreddits"))
    return rows.groupBy("job").agg(F.sum("websites").alias("websites"), F.sum("subreddits").alias("subreddits"))


def next_batch(requests: DataFrame, tags: DataFrame, n: int = 50) -> DataFrame:
    """The next waiting requests, searches first, with the tags of their sites. Only these n rows meet the tags."""
    batch = requests.filter("status = 'waiting'").orderBy(F.desc("is_search"), "id").limit(n)
    return batch.join(tags, "site", "left").groupBy("id", "site", "is_search").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def effective_tags(own: Column, of_site: Column) -> Column:
    return F.coalesce(F.when(F.size(own) > 0, own), of_site)


def route(is_crawl: Column, is_search: Column) -> Column:
    return F.when(is_crawl, "crawl").when(is_search, "search").otherwise("leaf")


def outlinks(docs: DataFrame, deepest: int = 2) -> DataFrame:
    """New requests from the links of search pages; links to further searches only below the depth."""
    kept = docs.filter(~F.col("is_search") | (F.col("lead_count") < deepest))
    return kept.withColumn("lead_count", F.when(F.col("is_search"), F.col("lead_count") + 1).otherwise(0)).withColumn("status", F.lit("waiting"))


def skip_indexed(frontier: DataFrame, index: DataFrame, now: Column, days: int = 365, hours: int = 12) -> DataFrame:
    """Without addresses that are indexed and were posted over a year ago or fetched within twelve hours."""
    settled = index.filter((F.col("date_post") < now - F.make_interval(days=F.lit(days))) | (F.col("date_retr") >= now - F.make_interval(hours=F.lit(hours))))
    return frontier.join(settled.select("url"), "url", "left_anti")


def cancel_dupes(requests: DataFrame, job: str, target: str, order: list[str]) -> DataFrame:
    """Of requests for one target in a job all but the first are cancelled."""
    k = F.row_number().over(Window.partitionBy(job, target).orderBy(*order))
    return requests.withColumn("status", F.when(k > 1, "cancelled").otherwise(F.col("status")))


def cancel_for_terminated(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    ended = jobs.filter("status = 'terminated'").select(F.col("job").alias("_j")).distinct()
    rows = requests.join(ended, F.col("job") == F.col("_j"), "left")
    return rows.withColumn("status", F.when(F.col("_j").isNotNull() & (F.col("status") != "committed"), "cancelled").otherwise(F.col("status"))).drop("_j")


def requeue(status: Column) -> Column:
    return F.when(status.isin("scheduled", "ran"), "waiting").otherwise(status)


COUNTED = ("searches_done_web", "searches_done_reddit", "pages_done_web", "pages_done_reddit", "pages_known_web", "pages_known_reddit", "searches_web", "searches_ran_reddit", "searches_open", "pages_open", "pages_done", "fails")


def counted() -> dict[str, Column]:
    """Which requests (kind, is_search, status) count for each of COUNTED."""
    search, done, open_, ran = F.col("is_search"), F.col("status") == "committed", F.col("status").isin(*OPEN), F.col("status") == "ran"
    web, reddit = F.col("kind") == "web", F.col("kind") == "reddit"
    tests = (web & search & done, reddit & search & done, web & ~search & done, reddit & ~search & done, web & ~search, reddit & ~search, web & search, reddit & search & ran, search & open_, ~search & open_, ~search & done, F.col("status") == "failed")
    return dict(zip(COUNTED, tests, strict=True))


def progress(requests: DataFrame, jobs: DataFrame | None = None, now_depth: int = 3, first_yield: float = 10.0, first_thread_yield: float = 7500.0, per_site: int = 50, factor: int = 20) -> DataFrame:
    """Counts by job in one aggregate, and from them yields, estimates of web and Reddit pages, and the proportion done.

    requests: job, site, kind ('web' or 'reddit'), is_search, status, lead_count; jobs: job, status, websites, subreddits,
    is_crawl. A web site is known while it has open requests or when all of them ended. Jobs without requests count 0.
    Without `jobs`, those of the requests are web jobs for the sites there are, finished once nothing is open."""
    for name, default in (("kind", "web"), ("lead_count", 0)):
        requests = requests if name in requests.columns else requests.withColumn(name, F.lit(default))
    if jobs is None:
        ended = F.when(F.bool_or(F.col("status").isin(*OPEN)), "working").otherwise("finished").alias("status")
        jobs = requests.groupBy("job").agg(ended, F.count_distinct("site").alias("websites"), F.lit(0).alias("subreddits"), F.lit(False).alias("is_crawl"))
    by_site = requests.groupBy("job", "site").agg(*[F.count_if(c).alias(k) for k, c in counted().items()], F.max("lead_count").alias("depth"), F.bool_or(F.col("status").isin(*OPEN, "committed", "failed")).alias("known"))
    known = F.count_if(F.col("known") & ~F.coalesce(F.substring("site", 1, 3) == "/r/", F.lit(False))).alias("sites_known")
    rows = by_site.withColumn("site", F.col("site").cast("string")).groupBy("job").agg(*[F.sum(k).alias(k) for k in COUNTED], F.max("depth").alias("depth"), known)
    rows = jobs.join(rows, "job", "left").na.fill(0, [*COUNTED, "depth", "sites_known"])
    return with_progress(rows, now_depth, first_yield, first_thread_yield, per_site, factor)


def with_progress(rows: DataFrame, now_depth: int = 3, first_yield: float = 10.0, first_thread_yield: float = 7500.0, per_site: int = 50, factor: int = 20) -> DataFrame:
    """What progress() adds to the counts of jobs (COUNTED, depth, sites_known, websites, subreddits, is_crawl, status)."""
    per = lambda pages, searches, otherwise: F.when(F.col(searches) > 0, F.col(pages) / F.col(searches)).otherwise(float(otherwise))
    rows = rows.withColumn("yield_web", per("pages_done_web", "searches_done_web", first_yield)).withColumn("yield_reddit", per("pages_done_reddit", "searches_done_reddit", first_thread_yield))
    future_web = (F.col("websites") - F.col("sites_known")) * per_site
    future_reddit = (F.col("subreddits") - F.col("searches_ran_reddit") - F.col("searches_done_reddit")) * F.col("yield_reddit")
    # A search that is open is taken to bring two more like it.
    rows = rows.withColumn("estimate_web", future_web + 3 * F.col("searches_open") * F.col("yield_web") + F.col("pages_known_web") + F.col("searches_web"))
    rows = rows.withColumn("estimate_reddit", future_reddit + F.col("searches_ran_reddit") * F.col("yield_reddit") + F.col("pages_known_reddit")).withColumn("future", future_web + future_reddit)
    estimate, all_done = F.col("estimate_web") + F.col("estimate_reddit"), F.col("searches_done_web") + F.col("searches_done_reddit") + F.col("pages_done")
    # A crawl brings `factor` times as many pages at each depth; the share of the depths seen is done.
    level = lambda d: F.pow(F.lit(float(factor + 1)), d) * factor
    seen = F.aggregate(F.sequence(F.lit(0), F.greatest(F.least("depth", F.lit(now_depth)).cast("int"), F.lit(1)) - 1), F.lit(0.0), lambda x, d: x + level(d + 1))
    crawl = F.when(F.col("depth") > 0, seen).otherwise(0.0) / float((factor + 1) ** now_depth)
    proportion = F.when(F.col("status") == "finished", 1.0).when(F.col("is_crawl"), crawl).when(estimate > 0, all_done / estimate).otherwise(0.0)
    phase = F.when(F.col("status").isin("waiting", "finished", "terminated", "rejected"), F.col("status")).otherwise("working")
    return rows.withColumn("phase", phase).withColumn("searches", F.col("searches_done_web") + F.col("searches_done_reddit") + F.col("searches_open")).withColumn("crawls", F.col("pages_done_web") + F.col("pages_done_reddit") + F.col("pages_open")).withColumn("commits", F.col("searches_done_web") + F.col("searches_done_reddit") + F.col("pages_done_web") + F.col("pages_done_reddit")).withColumn("open", F.col("searches_open") + F.col("pages_open")).withColumn("estimate", estimate).withColumn("proportion", proportion)


def sites_by_state(requests: DataFrame) -> DataFrame:
    """Sites of each job: done, with committed or failed requests and none open, or worked, with open ones."""
    rows = requests.groupBy("job", "site").agg(F.bool_or(F.col("status").isin(*OPEN)).alias("o"), F.bool_or(F.col("status").isin("committed", "failed")).alias("c")).filter("c or o")
    return rows.select("job", "site", F.when(F.col("o"), "worked").otherwise("done").alias("state"))


def sites_done(requests: DataFrame) -> DataFrame:
    return sites_by_state(requests).filter("state = 'done'").select("job", "site")


def sites_worked(requests: DataFrame) -> DataFrame:
    return sites_by_state(requests).filter("state = 'worked'").select("job", "site")


def last_targets(requests: DataFrame, n: int = 5) -> DataFrame:
    return requests.withColumn("rank", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("changed"), "id"))).filter(F.col("rank") <= n)


def job_transitions(jobs: DataFrame, requests: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Working jobs end: terminated after a day, finished when nothing is open."""
    open_ = requests.filter(F.col("status").isin(*OPEN)).groupBy("job").agg(F.count("*").alias("open"))
    rows = jobs.join(open_, "job", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    new = F.when(F.col("status") != "working", F.col("status")).when(F.col("started") < now - F.make_interval(hours=F.lit(hours)), "terminated").when(F.col("open") == 0, "finished").otherwise("working")
    return rows.withColumn("status", new)


def start_next(jobs: DataFrame, capacity: int | Column = 20) -> DataFrame:
    """The first waiting jobs, as many as the capacity exceeds the waiting and working ones, in order of rank. So none starts
    while more jobs wait and work than the capacity allows. The capacity is a number or an aggregate of the jobs; all
    waiting jobs are numbered by ranges, so it may be large."""
    used = F.count_if(F.col("status").isin("waiting", "working"))
    spare = jobs.agg(((F.lit(capacity) if isinstance(capacity, int) else capacity) - used).alias("_spare"))
    ranked = in_order(jobs.filter("status = 'waiting'"), ["asked", "job"])
    return ranked.crossJoin(F.broadcast(spare)).filter(F.col("rank") <= F.col("_spare")).drop("_spare").orderBy("rank")


def politeness_plan(frontier: DataFrame, delay: float = 1.0, longest: float = 30.0, bucket: int = 10_000) -> DataFrame:
    """Seconds after which each address may be fetched, by queue; robots delays count up to `longest`, beyond it the
    address is skipped. frontier: url, order (a number), robots_delay. A queue is ranked in buckets of `bucket` values of
    order: their sizes are summed up first, so that a hot host is spread over tasks."""
    rows = frontier.withColumn("queue", queue_key(F.col("url"))).filter(F.col("robots_delay").isNull() | (F.col("robots_delay") <= longest)).withColumn("_b", F.floor(F.col("order") / bucket))
    sizes = rows.groupBy("queue", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("queue").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select("queue", "_b", before.alias("_before")), ["queue", "_b"])
    k = F.col("_before") + F.row_number().over(Window.partitionBy("queue", "_b").orderBy("order")) - 1
    return rows.withColumn("start", k * F.greatest(F.lit(delay), F.coalesce("robots_delay", F.lit(0.0)))).drop("_b", "_before")


def in_order(rows: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """Numbers all rows from 1 in one order, without one task for all: they are dealt by ranges of `by` (which should tell
    every two rows apart) and sorted there, and the sizes of the ranges, one row a range, say where each begins."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = settled(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_at", 33).alias("_part")  # the number has the range in its upper bits, and the place in it below
    sizes = held.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return held.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")


def fetch_order(frontier: DataFrame, delay: float = 1.0, longest: float = 30.0, force: str | None = None) -> DataFrame:
    """One plan for all queues: rank, by planned start and then by queue, as a fetcher goes round the queues. Rows whose
    column `force` holds start at once, in front of all, and wait for no robots delay."""
    rows = frontier.withColumn("_force", F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False))
    planned = politeness_plan(rows.filter("not _force"), delay, longest)
    forced = rows.filter("_force").withColumn("queue", queue_key(F.col("url"))).withColumn("start", F.lit(0.0))
    return in_order(planned.unionByName(forced).withColumn("_late", (~F.col("_force")).cast("int")), ["_late", "start", "queue", "order"]).drop("_late", "_force")


def robots_filter(frontier: DataFrame, robots: DataFrame) -> DataFrame:
    """Addresses whose longest matching rule allows them, or that match none; searches pass. robots: host, prefix, allow."""
    rows = frontier.join(robots, (F.col("url_host") == F.col("host")) & F.col("path").startswith(F.col("prefix")), "left")
    verdict = F.max_by("allow", F.struct(F.length("prefix"), "allow"))
    return rows.groupBy("url", "url_host", "path", "is_search").agg(F.coalesce(verdict, F.lit(True)).alias("allowed")).filter("allowed or is_search").drop("allowed")


def sitemap_links(sitemaps: DataFrame, robots: DataFrame) -> DataFrame:
    """Addresses of site maps that robots rules allow, each once, as frontier rows. sitemaps: host, path, sitemaps (an
    array of paths on that host); robots as in robots_filter."""
    rows = sitemaps.select(F.col("host").alias("url_host"), F.explode("sitemaps").alias("path")).dropDuplicates()
    rows = rows.withColumn("url", F.concat(F.lit("https://"), "url_host", "path")).withColumn("is_search", F.lit(False))
    return robots_filter(rows, robots).withColumn("is_sitemap", F.lit(True))


def fetch_outcome(code: Column, error: Column, waited: Column, longest: float = 300.0) -> Column:
    return (
        F.when(waited > longest, "dropped").when(error == "timeout", "timeout").when(error == "unknown host", "unknown host").when(error.isNotNull(), "error")
        .when(code == 304, "not modified").when((code >= 300) & (code < 400), "redirect").when((code >= 200) & (code < 300), "fetched").otherwise("error")
    )


def fetch_metrics(log: DataFrame, every: str = "1 minute") -> DataFrame:
    """Counters by minute. With a `code` column also how often each status class (2xx to 5xx) occurs, and the rate; with
    fetch_ms and queued_ms their means, and with bytes their sum and rate."""
    has = lambda c: c in log.columns
    seconds = F.unix_timestamp(F.col("w.end").cast("timestamp")) - F.unix_timestamp(F.col("w.start").cast("timestamp"))
    sums = {"n": F.count("*"), "mean_value": F.round(F.avg("value"), 6), "sum_value": F.round(F.sum("value"), 4)}
    sums |= {f"n_{k}xx": F.count_if(F.floor(F.col("code") / 100) == k) for k in (2, 3, 4, 5)} if has("code") else {}
    means = {f"mean_{c}": F.round(F.avg(c), 6) for c in ("fetch_ms", "queued_ms") if has(c)}
    size = {"sum_bytes": F.sum("bytes").cast("long")} if has("bytes") else {}
    out = log.groupBy(F.window("ts", every).alias("w")).agg(*[v.alias(k) for k, v in (sums | means | size).items()])
    rate = lambda c, name: F.round(F.col(c) / seconds, 6).alias(name)
    return out.select(F.col("w.start").alias("start"), *sums, *([rate("n", "per_second")] if has("code") else []), *means, *size, *([rate("sum_bytes", "bytes_per_second")] if size else []))


def fetch_codes(log: DataFrame, every: str = "1 minute") -> DataFrame:
    """start, code and n: how often each status code occurs in each minute."""
    return log.groupBy(F.window("ts", every).alias("w"), F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "code", "n")


def crawl_estimate(requests: DataFrame, factor: int = 20) -> DataFrame:
    """Pages by job: 1 + factor + factor^2 + ... up to the deepest lead seen."""
    rows = requests.groupBy("job").agg(F.max("lead_count").alias("depth"))
    return rows.withColumn("estimate", F.aggregate(F.sequence(F.lit(0), F.col("depth")), F.lit(0).cast("long"), lambda s, i: s * factor + 1))


def thread_prune(comments: DataFrame, thread: str, score: str, large: int = 200) -> DataFrame:
    """Threads of `large` comments drop those that score below n div large, others those below 0."""
    sizes = comments.groupBy(thread).agg(F.count("*").alias("_n"))
    return comments.join(sizes, thread).filter(F.col(score) >= F.when(F.col("_n") >= large, F.floor(F.col("_n") / large)).otherwise(0)).drop("_n")


def lead_count(comments: DataFrame, search: str) -> DataFrame:
    """Comments that each search brought in. comments: the search's column and n_comments."""
    return comments.groupBy(search).agg(F.sum("n_comments").cast("long").alias("lead_count"))


def thread_to_docs(posts: DataFrame, comments: DataFrame, tags: DataFrame, now: Column, text: Callable[[Column], Column], root: str = "https://reddit.com") -> DataFrame:
    """Documents of submissions and their comments, with why one failed (null if it did not).

    posts: thread, permalink, text, author, created, subreddit, adult; comments: the same without subreddit and adult.
    tags: thread, own (the query's), of_site. A submission is its own page, a comment has the submission as its page. A
    submission without text is no document; a comment without text, or without any after `text`, failed."""
    site = posts.select("thread", F.col("permalink").alias("page"), F.concat(F.lit("/r/"), "subreddit").alias("site_name"), F.when(F.col("adult"), True).alias("adult_b"))
    own = posts.filter("text is not null").select("thread", "permalink", "text", "author", "created", F.lit(True).alias("is_post"))
    rows = own.unionByName(comments.select("thread", "permalink", "text", "author", "created", F.lit(False).alias("is_post"))).join(site, "thread").join(tags, "thread", "left")
    plain = text(F.col("text"))
    failed = F.when(F.col("permalink").isNull(), "no permalink").when(~F.col("is_post") & F.col("text").isNull(), "no text body").when(~F.col("is_post") & (plain == ""), "no extractable text")
    return rows.select(
        "thread", F.concat(F.lit(root), "permalink").alias("url"), F.when(F.col("is_post"), "self").otherwise(F.concat(F.lit(root), "page")).alias("real_doc"), "author", F.col("created").alias("date_post"),
        now.alias("date_retr"), "site_name", "adult_b", effective_tags(F.col("own"), F.col("of_site")).alias("tags"), plain.alias("text"), failed.alias("failure_comment"),
    )


def revisit_due(log: DataFrame, now: Column) -> DataFrame:
    """Addresses to fetch again: after a week, after a fetch error in two hours, never after a hard error."""
    last = log.groupBy("url").agg(F.max("ts").alias("ts"), F.max_by("outcome", F.struct("ts", "outcome")).alias("outcome"))
    due = F.when(F.col("outcome") == "fetched", F.col("ts") + F.expr("interval 7 days")).when(F.col("outcome") == "fetch error", F.col("ts") + F.expr("interval 2 hours"))
    return last.withColumn("due", due).filter(F.col("due") <= now)


def expired(ts: Column, now: Column, seconds: int) -> Column:
    return ts <= now - F.make_interval(secs=F.lit(float(seconds)))
