"""Streams give what the batch operators give on the same rows."""

import tempfile

from pyspark.sql import functions as F

from lexloom.operators import frontier as R
from lexloom.operators import periods as P
from lexloom.operators import trust as T
from lexloom.streaming import queries as ST


def test_extraction_equals_batch(spark, sf):
    folder = tempfile.mkdtemp()
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40)
    pages.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ST.stream_extract(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
    pages = spark.read.parquet(f"{folder}/in")
    columns = ["doc_location", "language_code", "text_en", "text_xx", "word_length_i"]
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert key(spark.read.parquet(f"{folder}/out")) == key(P.periods_of(ST.extracted(pages)))


def test_routes(spark):
    folder = tempfile.mkdtemp()
    spark.range(30).selectExpr("id", "id % 3 = 0 as is_crawl", "id % 2 = 0 as is_search").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("id long, is_crawl boolean, is_search boolean").parquet(f"{folder}/in")
    ST.stream_route(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert {r["route"]: r["count"] for r in spark.read.parquet(f"{folder}/out").groupBy("route").count().collect()} == {"crawl": 10, "search": 10, "leaf": 10}


def test_metrics_equal_batch(spark, sf):
    folder = tempfile.mkdtemp()
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    q = ST.stream_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("metrics").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("start", "n", F.round("sum_value", 2)).collect()))
    assert key(spark.table("metrics")) == key(R.fetch_metrics(events))


def test_first_request_stays(spark):
    folder = tempfile.mkdtemp()
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")], "url string, t string").selectExpr("url", "cast(t as timestamp) as ts").coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("url string, ts timestamp").parquet(f"{folder}/in")
    q = ST.stream_dedupe_urls(stream).writeStream.format("memory").queryName("urls").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["url"] for r in spark.table("urls").collect()) == ["a", "b"]


def test_redirects_are_bounded(spark):
    folder = tempfile.mkdtemp()
    spark.createDataFrame([("a", "b", 301, 0), ("c", "d", 302, 5), ("e", None, 200, 0), ("f", "g", 304, 0)], "url string, target string, code int, hops int").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("url string, target string, code int, hops int").parquet(f"{folder}/in")
    ST.stream_redirects(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert [(r["url"], r["hops"]) for r in spark.read.parquet(f"{folder}/out").collect()] == [("b", 1)]


def test_extracted_documents_are_those_of_a_plain_walk(spark):
    """A media page is one document of its good paragraphs; an independent count of what must be in it."""
    good = "It is what it was, and so they said that there is no more to it than this, which is all that was to be said of it by them."
    html = f"<html><head><title>T</title></head><body><nav><p>{good}</p></nav><p>{good} One.</p><p>{"xx yy zz " * 10}</p><p>{good} Two.</p><footer><p>{good}</p></footer></body></html>"
    got = ST.extracted(spark.createDataFrame([(1, "https://a.example/", html), (2, "https://b.example/", "<html></html>")], "page_id long, url string, html string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["url"], r["text"]) for r in got] == [(1, "https://a.example/", f"{good} One.\n\n{good} Two."), (2, "https://b.example/", "")]


def test_votes_count_once_over_batches_and_reruns(spark):
    folder = tempfile.mkdtemp()
    spark.createDataFrame([("l1", 0), ("l2", 5)], "link string, level long").write.parquet(f"{folder}/s/links/batch=-1")
    spark.createDataFrame([("ann", False), ("bob", False), ("cyd", True)], "user string, used boolean").write.parquet(f"{folder}/s/permissions/batch=-1")
    schema = "user string, link string, up boolean, at timestamp"
    first = [("ann", "l1", True), ("ann", "l2", True), ("cyd", "l1", True)]
    second = [("ann", "l1", True), ("bob", "l2", False)]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("at", F.expr(f"timestamp '2024-01-0{k + 1}'")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        ST.stream_feedback(stream, f"{folder}/s", f"{folder}/cp").awaitTermination()
    levels = lambda n: {r["link"]: r["level"] for r in spark.read.parquet(f"{folder}/s/links/batch={n}").collect()}
    assert levels(0) == {"l1": 1, "l2": 5} and levels(1) == {"l1": 1, "l2": 4}
    assert {r["user"]: r["used"] for r in spark.read.parquet(f"{folder}/s/permissions/batch=1").collect()} == {"ann": True, "bob": True, "cyd": True}
    # The second batch once more, from the same state.
    batch = spark.createDataFrame([(*r, None) for r in second], schema)
    state = [spark.read.parquet(f"{folder}/s/{x}/batch=0") for x in ("links", "permissions")]
    assert {r["link"]: r["level"] for r in T.apply_feedback(state[0], batch, state[1]).collect()} == levels(1)


def test_targets_of_redirects_are_fed_back(spark):
    frontier = spark.createDataFrame([("a", 0), ("b", 3)], "url string, hops int")
    redirects = spark.createDataFrame([("b", 1), ("c", 2), ("c", 4)], "url string, hops int")
    assert {r["url"]: r["hops"] for r in ST.frontier_with_redirects(frontier, redirects).collect()} == {"a": 0, "b": 1, "c": 2}


def test_reanalysis_of_queried_contexts(spark):
    folder = tempfile.mkdtemp()
    spark.createDataFrame([("q1",), ("q2",)], "context_id string").coalesce(1).write.parquet(f"{folder}/in")
    periods = spark.createDataFrame([("q1", "p1", "a b"), ("q1", "p2", "a"), ("q2", "p3", "x")], "context_id string, doc_location string, text string")
    sentences = periods.select("context_id", "doc_location", F.col("text").alias("sentence"))
    of = lambda df: lambda batch: df.join(batch, "context_id", "left_semi")
    q = ST.stream_reanalyse(spark.readStream.schema("context_id string").parquet(f"{folder}/in"), of(periods), of(sentences), F.expr("timestamp '2024-01-30'"), f"{folder}/out", f"{folder}/cp", least=2)
    q.processAllAvailable()
    q.stop()
    got = {r["doc_location"]: (r["word_length_i"], r["average_word_tf_idf_f"], r["sentence_length_deviation_f"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {"p1": (2, 0.75, 1.0), "p2": (1, 0.5, -1.0)}


def test_job_monitor_finishes_and_terminates(spark):
    folder = tempfile.mkdtemp()
    schema = "job long, ts timestamp, opened int, committed int"
    at = lambda hour: f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:00:00"
    parts = [[(1, at(0), 1, 0), (1, at(0), 1, 0), (2, at(0), 1, 0)], [(1, at(1), -1, 1), (1, at(1), -1, 0)], [(3, at(60), 1, 0)], [(3, at(61), 1, 0)]]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = []
        for part in parts:
            spark.createDataFrame(part, "job long, t string, opened int, committed int").selectExpr("job", "cast(t as timestamp) as ts", "opened", "committed").coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = ST.stream_job_monitor(spark.readStream.schema(schema).parquet(f"{folder}/in"))
            keep = lambda batch, number: seen.extend((r["job"], r["status"], r["open"], r["committed"]) for r in batch.collect())
            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert seen[:2] == [(1, "working", 2, 0), (2, "working", 1, 0)] or seen[:2] == [(2, "working", 1, 0), (1, "working", 2, 0)]
    assert (1, "finished", 0, 1) in seen and (2, "terminated", 1, 0) in seen and (1, "terminated", 0, 1) not in seen


def test_job_progress_equals_batch_in_batches_of_any_size(spark):
    """Changes of some jobs, the last of each job's requests committed at the end; told by stream and by progress()."""
    import random

    rng = random.Random(4)
    jobs, changes, n = [], [], 0
    for job in range(1, 7):
        jobs.append((job, "working", "2024-01-01 00:00:00", rng.randrange(1, 9), rng.randrange(3), job == 5))
        requests = [(job * 100 + k, *rng.choice([("www.a", "web"), ("www.b", "web"), ("/r/c", "reddit"), ("www.d", "web")]), rng.random() < 0.3, rng.randrange(4)) for k in range(rng.randrange(3, 25))]
        steps = [(r, s) for r in requests for s in ("waiting", "scheduled", "ran", rng.choice(["committed", "committed", "failed", "cancelled"]))][: -rng.randrange(1, 3) if job % 2 else None]
        for r, status in sorted(steps, key=lambda x: (x[1] != "waiting", x[0] == requests[-1] and x[1] not in ("waiting", "scheduled", "ran"))):
            changes.append((job, n, *r, status))
            n += 1
    last = {c[2]: c for c in changes}
    schema = "job long, second int, request long, site string, kind string, is_search boolean, lead_count int, status string"
    timed = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, second)")).drop("second")
    table = spark.createDataFrame(jobs, "job long, status string, t string, websites int, subreddits int, is_crawl boolean").withColumn("started", F.col("t").cast("timestamp")).drop("t")
    now = F.expr("timestamp '2024-01-01 12:00:00'")
    moved = R.job_transitions(table, timed(list(last.values())), now).select(*table.columns)
    columns = ["job", "status", "proportion", "estimate_web", "estimate_reddit", "searches", "crawls", "sites_known", "depth", "fails"]
    key = lambda rows: sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in rows)
    expected = key(R.progress(timed(list(last.values())), moved).collect())
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for parts in (1, 4):
            folder, seen = tempfile.mkdtemp(), {}
            size = -(-len(changes) // parts)
            for k in range(0, len(changes), size):
                timed(changes[k : k + size]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
                stream = ST.stream_job_progress(spark.readStream.schema(timed(changes[:1]).schema).parquet(f"{folder}/in"), table)
                keep = lambda batch, number, seen=seen: seen.update({r["job"]: r for r in batch.collect()})
                stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
            assert key(seen.values()) == expected
            timed([(99, 2 * 86400, 1, "www.a", "web", False, 0, "waiting")]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = ST.stream_job_progress(spark.readStream.schema(timed(changes[:1]).schema).parquet(f"{folder}/in"), table)
            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
            ended = {r["job"]: r["status"] for r in seen.values()}
            working = {e[0] for e in expected if e[1] == "working"}
            assert working and all(ended[j] == ("terminated" if j in working else "finished") for j in range(1, 7)) and ended[99] == "working"
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_stream_into_a_stored_index(spark):
    from lexloom.sources.index import IndexTable

    folder = tempfile.mkdtemp()
    schema = "key long, version long, value string"
    table = IndexTable.create(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema), f"file://{folder}/index", "key", "version", 4)
    for part in ([(1, 2, "c")], [(3, 1, "d"), (1, 1, "late")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        ST.stream_index(spark.readStream.schema(schema).parquet(f"{folder}/in"), table, f"{folder}/cp").awaitTermination()
    assert {r["key"]: r["value"] for r in table.read().collect()} == {1: "c", 2: "b", 3: "d"} and table.versions() == [0, 1, 2]
    assert table.upsert(spark.createDataFrame([(3, 9, "again")], schema), batch=1) == []
