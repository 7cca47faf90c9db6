"""Queries on made tables that the given ones do not show, against their SQL."""

import datetime
import random
from itertools import pairwise

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from lexloom import registry
from lexloom.operators import frontier as R
from lexloom.operators import periods as P

from .test_oracle import plain


def same(spark, folder, name, **tables):
    """Checks a query on made tables (pyarrow) against its SQL; gives its rows."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    rel = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    got = registry.queries()[name](spark, str(folder)).select(*names).collect()
    assert sorted((tuple(plain(v) for v in r) for r in got), key=repr) == sorted((tuple(plain(v) for v in r) for r in rel.fetchall()), key=repr)
    return got


def most_rows(df, parts=""):
    """Runs a query; the most rows that any part of its plan puts out, of the parts named so."""
    df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        inner = p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan() if kind.endswith("QueryStageExec") else None
        plans += [inner] if inner is not None else [p.children().apply(i) for i in range(p.children().size())]
        for name in ("numOutputRows", "shuffleRecordsWritten"):
            if kind.startswith(parts) and p.metrics().contains(name):
                most = max(most, p.metrics().apply(name).value())
    return most


def suppliers(n, nations=25, seed=1):
    r = random.Random(seed)
    return pa.table({"s_suppkey": pa.array(range(n), pa.int64()), "s_nationkey": pa.array([r.randrange(nations) for _ in range(n)], pa.int32()), "s_acctbal": pa.array([r.choice([-50.0, 249.9, 250.0, 1999.0, 2000.0, 9000.0]) for _ in range(n)], pa.float64())})


def test_page_meta_of_titles_with_other_references(spark, tmp_path):
    titles = ["a &amp; b &lt;i&gt;", "cut off &amp", "&quot;said&quot;", "&amp;lt; &copy &#65; & &&", "", None]
    html = [f"<!DOCTYPE html><html><head><title>{t}</title></head><body>&quot;x</body></html>" if t is not None else "<p>no title</p>" for t in titles] + [None]
    url = [f'http://a.example/{i}?a=1&b="&amp;' for i in range(len(html) - 1)] + [None]
    got = same(spark, tmp_path, "d13_page_meta", pages=pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": pa.array(url, pa.string()), "html": pa.array(html, pa.string())}))
    assert {r["page_id"]: r["title"] for r in got} == {0: "a & b <i>", 1: "cut off &amp", 2: "&quot;said&quot;", 3: "&lt; &copy &#65; & &&", 4: "", 5: "", 6: None}


def test_feedback_candidates_do_not_join_users_with_all_links(spark, tmp_path):
    r = random.Random(2)
    n, users = 12_000, 300
    kinds = [r.choice(["click", "view"]) for _ in range(n)]
    events = pa.table({"event_id": pa.array([r.randrange(10**6) for _ in range(n)], pa.int64()), "user_id": pa.array([r.choice([None, *range(users)]) for _ in range(n)], pa.int64()), "event_type": kinds})
    got = same(spark, tmp_path, "t4_feedback_candidates", events=events, supplier=suppliers(2_000))
    assert len(got) > users * 0.9
    assert most_rows(registry.queries()["t4_feedback_candidates"](spark, str(tmp_path))) <= n


def orders(n, seed=3):
    r = random.Random(seed)
    return pa.table({"o_orderkey": pa.array([r.choice([None, *range(n)]) if k % 50 == 0 else k for k in range(n)], pa.int64()), "o_custkey": pa.array([r.choice([None, *range(3 * n)]) for _ in range(n)], pa.int64())})


def test_jobs_expand_without_shuffling_their_sites(spark, tmp_path):
    got = same(spark, tmp_path, "f2_expand_job", orders=orders(200), supplier=suppliers(1_000), lineitem=pa.table({"l_orderkey": [1]}))
    assert len(got) > 3_000
    df = registry.queries()["f2_expand_job"](spark, str(tmp_path))
    assert most_rows(df, "ShuffleExchange") <= 1_000
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()  # few bytes of jobs still go to many tasks


def test_jobs_count_sites_by_sets_of_tags(spark, tmp_path):
    same(spark, tmp_path, "f2_job_counts", orders=orders(1_000), supplier=suppliers(500), lineitem=pa.table({"l_orderkey": [1]}))
    assert most_rows(registry.queries()["f2_job_counts"](spark, str(tmp_path))) <= 3_000


def test_jobs_with_several_tags_ask_each_site_once(spark):
    r = random.Random(4)
    some = lambda values, most: r.choice([None, *[r.choices(values, k=r.randrange(most)) for _ in range(9)]])
    jobs = [(r.randrange(30) or None, some([None, *range(6)], 5), some([None, *range(45)], 6)) for _ in range(60)]
    sites = [(s, "reddit" if s % 3 == 0 else "web") for s in range(40)]
    links = [(r.randrange(45), r.choice([None, *range(6)]), r.choice([10, 50, 90])) for _ in range(120)]
    want = {(j, s) for j, tags, named in jobs for s, _ in sites if s in (named or []) or any(x == s and level >= 50 and t is not None and t in (tags or []) for x, t, level in links)}
    frames = spark.createDataFrame(jobs, "job int, tags array<int>, sites array<int>"), spark.createDataFrame(sites, "site int, kind string"), spark.createDataFrame(links, "site int, tag int, level int")
    got = [(x.job, x.site) for x in R.expand_job(*frames, 50).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {x.job: (x.websites, x.subreddits) for x in R.job_counts(*frames, 50).collect()}
    assert counts == {j: (sum(a == j and s % 3 > 0 for a, s in want), sum(a == j and s % 3 == 0 for a, s in want)) for j in {a for a, _ in want}}


def test_dates_are_read_once_for_each_day(spark, tmp_path):
    r = random.Random(6)
    days = [None, *[datetime.datetime(1992, 1, 1) + datetime.timedelta(days=r.randrange(3_500)) for _ in range(15)], datetime.datetime(1996, 2, 29), datetime.datetime(2000, 2, 29)]
    rows = pa.table({"o_orderkey": pa.array([None, *range(1_000)], pa.int64()), "o_orderdate": pa.array([r.choice(days) for _ in range(1_001)], pa.timestamp("us"))})
    assert len(same(spark, tmp_path, "d8_parse_date", orders=rows)) == 15 * 1_001
    assert 13 <= most_rows(registry.queries()["d8_parse_date"](spark, str(tmp_path)), "HashAggregate") <= len(days)


def test_shared_grams_as_sets_have_them():
    r = random.Random(7)
    texts = ["".join(r.choices("ab \n😀é́", k=r.choice([0, 1, 3, 4, 5, 30]))) for _ in range(3_000)]
    for sentences in ([], [""], ["abcd"], ["", ""], ["abcd", "abcde"], texts, [*texts, "".join(map(chr, range(0x10000, 0x10000 + 150_000))), *texts[::-1]]):
        assert P.shared_grams(sentences).tolist() == [len(P.grams_of(a) & P.grams_of(b)) for a, b in pairwise(sentences)]


def test_sentences_meet_the_next_one_without_a_shuffle(spark, tmp_path):
    r = random.Random(8)
    texts = [None, "", " . ", "One. One.", *["".join(r.choices(["the ", "a", "😀", "\n", ". ", "! ", "été "], k=r.randrange(300))) for _ in range(60)]]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    assert len(same(spark, tmp_path, "p6_common_count", documents=docs)) > 1_000
    assert most_rows(registry.queries()["p6_common_count"](spark, str(tmp_path)), "ShuffleExchange") <= len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8]), pa.array([["abcd", "abcde", "bcdef"], None, ["abcd"], ["abcd", "abcd"]])], names=["doc_id", "sentences"])
    assert [row for chars in (1, 9) for out in P._shared(iter([batch]), chars) for row in out.to_pylist()] == 2 * [{"doc_id": 5, "pos": 0, "common": 1}, {"doc_id": 5, "pos": 1, "common": 1}, {"doc_id": 8, "pos": 0, "common": 1}]
