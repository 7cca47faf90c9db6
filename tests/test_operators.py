"""Small cases, and sequential models against the window forms."""

import itertools

import pytest
from pyspark.sql import functions as F

from lexloom import registry
from lexloom.functions import text as X
from lexloom.functions import urls as U
from lexloom.operators import frontier as R
from lexloom.operators import html as H
from lexloom.operators import periods as P
from lexloom.operators import search as Q
from lexloom.sources import io as S

CLASSES = ["good", "near-good", "short", "bad"]


def sequential(classes):
    """What a scan does that writes each new class where it stands: short ones first, then near-good ones."""
    out = list(classes)
    for i, c in enumerate(classes):
        if c == "short":
            before = next((x for x in reversed(out[:i]) if x != "short"), None)
            after = next((x for x in classes[i + 1 :] if x != "short"), None)
            out[i] = "good" if (before, after) in {("good", "good"), ("good", "near-good"), ("near-good", "good"), ("good", None), (None, "good")} else "bad"
    # Short paragraphs in a row have one judged neighbour on each side, as the others are not judged yet.
    final = []
    for i, c in enumerate(classes):
        if c != "short":
            final.append(c)
            continue
        before = next((x for x in reversed(classes[:i]) if x != "short"), None)
        after = next((x for x in classes[i + 1 :] if x != "short"), None)
        final.append("good" if (before, after) in {("good", "good"), ("good", "near-good"), ("near-good", "good"), ("good", None), (None, "good")} else "bad")
    now = list(final)
    for i, c in enumerate(now):
        if c == "near-good":
            pair = (now[i - 1] if i else None, now[i + 1] if i + 1 < len(now) else None)
            now[i] = "bad" if pair in {("bad", "bad"), ("bad", None), (None, "bad")} else "good"
    return now


def test_class_revision_equals_a_scan(spark):
    cases = list(itertools.chain.from_iterable(itertools.product(CLASSES, repeat=n) for n in range(1, 6)))
    rows = [(k, i, c) for k, case in enumerate(cases) for i, c in enumerate(case)]
    df = spark.createDataFrame(rows, "k long, i int, cls string")
    out = H.revise_near_good(H.revise_short(df, ["k"], "i"), ["k"], "i").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["k"], r["i"])):
        got.setdefault(r["k"], []).append(r["cls"])
    wrong = [(cases[k], got[k]) for k in got if got[k] != sequential(cases[k])]
    assert not wrong, wrong[:3]


def test_paragraphs_of_an_inline_page(spark):
    html = "<html><body>lead<section><h1>One</h1><p>First <a href='/x'>link</a><br>line</p><p></p><div>Second</div></section><script>var a = '<p>';</script><footer><p>gone</p></footer><ul><li>a<li>b</ul></body></html>"
    rows = H.segment_paragraphs(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("page_id", "para_seq").collect()
    assert [(r["text"], r["chars_in_links"], r["is_heading"]) for r in rows] == [("lead", 0, False), ("One", 0, True), ("First link\nline", 4, False), ("Second", 0, False), ("a", 0, False), ("b", 0, False)]


def test_nodes_and_pruning(spark):
    html = "<div id='a'><!-- c --><p>x<b>y</b></p><footer><p>z</p></footer><p>w</div>"
    nodes = H.html_to_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    kept = H.prune_subtrees(nodes, F.col("tag").isin("footer", "#comment"))
    assert [r["text"] for r in kept.filter("text is not null").orderBy("pre").collect()] == ["x", "y", "w"]
    assert nodes.filter("tag = 'p' and parent_attrs['id'] = 'a'").count() == 2


def test_long_pages_are_walked_to_their_end(spark):
    n = 1_300_000 // 27
    html = "<html><body>" + "".join(f"<p>paragraph {i:09d}</p>" for i in range(n)) + "<p>the end</p></body><link rel='canonical' href='/last'></html>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert len(html) > 1_240_000
    last = H.segment_paragraphs(pages).orderBy(F.desc("para_seq")).first()
    assert (last["para_seq"], last["text"]) == (n + 1, "the end")
    nodes = H.html_to_nodes(pages)
    assert nodes.filter("tag = 'p'").count() == n + 1 and nodes.filter("tag = 'link' and attrs['href'] = '/last'").count() == 1


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(("raw", "expected"), [("Sep 20th, 2019 6:35 am", "2019-09-20 06:35:00"), ("Oct 15, 2018", "2018-10-15 00:00:00"), ("2020-01-10T18:03:00Z", "2020-01-10 18:03:00"), ("nonsense", None)])
def test_dates(spark, raw, expected):
    got = one(spark, X.parse_date(F.col("s")), s=raw)
    assert (str(got) if got else None) == expected


def test_relative_dates(spark):
    now = F.lit("2020-03-31 12:00:00").cast("timestamp")
    assert str(one(spark, X.relative_date(F.col("s"), now), s="1 month ago")) == "2020-02-29 12:00:00"
    assert str(one(spark, X.relative_date(F.col("s"), now), s="3 hours ago")) == "2020-03-31 09:00:00"
    assert one(spark, X.relative_date(F.col("s"), now), s="soon") is None


def test_ngrams_leave_the_last_one_out(spark):
    assert one(spark, X.char_ngrams(F.col("s"), 2), s="cabd") == ["ab", "ca"]
    assert one(spark, X.char_ngrams(F.col("s"), 9), s="cabd") == []


@pytest.mark.parametrize(("url", "ok"), [("https://a.example/x", True), ("ftp://a.example/x", False), ("http://127.0.0.1/", False), ("https://a.example/p.JPG", False), ("https://a.example/" + "x" * 1100, False), ("https://a.example/a/b/a/c/a", False)])
def test_url_filter(spark, url, ok):
    assert one(spark, U.acceptable_url(F.col("u")), u=url) is ok


@pytest.mark.parametrize(("href", "expected"), [("/x", "https://a.example/x"), ("y?z", "https://a.example/d/y?z"), ("//b.example/q", "https://b.example/q"), ("http://c.example", "http://c.example"), ("#top", "https://a.example/d/e.html?k=1#top")])
def test_resolve(spark, href, expected):
    assert one(spark, U.resolve_url(F.col("b"), F.col("h")), b="https://a.example/d/e.html?k=1", h=href) == expected


RFC = """g:h g:h|g http://a/b/c/g|./g http://a/b/c/g|g/ http://a/b/c/g/|/g http://a/g|//g http://g|?y http://a/b/c/d;p?y|g?y http://a/b/c/g?y|#s http://a/b/c/d;p?q#s|g#s http://a/b/c/g#s|g?y#s http://a/b/c/g?y#s|;x http://a/b/c/;x|g;x http://a/b/c/g;x|g;x?y#s http://a/b/c/g;x?y#s
 http://a/b/c/d;p?q|. http://a/b/c/|./ http://a/b/c/|.. http://a/b/|../ http://a/b/|../g http://a/b/g|../.. http://a/|../../ http://a/|../../g http://a/g|../../../g http://a/g|../../../../g http://a/g|/./g http://a/g|/../g http://a/g|g. http://a/b/c/g.|.g http://a/b/c/.g|g.. http://a/b/c/g..|..g http://a/b/c/..g
./../g http://a/b/g|./g/. http://a/b/c/g/|g/./h http://a/b/c/g/h|g/../h http://a/b/c/h|g;x=1/./y http://a/b/c/g;x=1/y|g;x=1/../y http://a/b/c/y|g?y/./x http://a/b/c/g?y/./x|g?y/../x http://a/b/c/g?y/../x|g#s/./x http://a/b/c/g#s/./x|g#s/../x http://a/b/c/g#s/../x|http:g http:g"""


def test_resolve_the_examples_of_the_rfc(spark):
    cases = [x.rsplit(" ", 1) for x in RFC.replace("\n", "|").split("|")]
    assert len(cases) == 42
    rows = spark.createDataFrame([(k, h.strip(), e) for k, (h, e) in enumerate(cases)], "k int, h string, e string")
    assert [tuple(r) for r in rows.withColumn("got", U.resolve_url(F.lit("http://a/b/c/d;p?q"), F.col("h"))).filter("not (got <=> e)").collect()] == []
    assert one(spark, U.resolve_url(F.col("b"), F.col("h")), b="http://a", h="g/../h?x") == "http://a/h?x"
    assert one(spark, U.resolve_url(F.col("b"), F.col("h")), b="http://a.example/b?x=1#f", h="?y=2") == "http://a.example/b?y=2"


@pytest.mark.parametrize(("url", "expected"), [
    ("https://A.example:443/x/../y", "https://a.example/y"), ("HTTP://U:p@A.Example:80", "http://U:p@a.example/"), ("http://a.example:443/", "http://a.example:443/"), ("https://a.example&b=1", "https://a.example/?b=1"), ("https://a.example/b&c=1&d", "https://a.example/b?c=1&d"),
    ("https://a.example/%7eb%2f%c3%A9%zz%4", "https://a.example/~b%2F%C3%A9%zz%4"), ("https://a.example/?a=%41??b&&c&#d?e", "https://a.example/?a=A&b&c"), ("https://a.example/B?#", "https://a.example/B"), ("no address", None), ("https://a b/", None), ("mailto:x@y", None),
])
def test_normal_form(spark, url, expected):
    assert one(spark, U.normalize_url(F.col("u")), u=url) == expected


def test_public_suffixes_with_wildcards_and_exceptions(spark):
    rules = ["com", "jp", "ac.jp", "kyoto.jp", "ide.kyoto.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "us", "ak.us", "k12.ak.us", "com"]
    cases = {
        "com": "com", "example.com": "example.com", "b.a.example.com": "example.com", "jp": "jp", "test.jp": "test.jp", "ac.jp": "ac.jp", "www.test.ac.jp": "test.ac.jp", "kyoto.jp": "kyoto.jp", "ide.kyoto.jp": "ide.kyoto.jp", "a.b.ide.kyoto.jp": "b.ide.kyoto.jp",
        "c.kobe.jp": "c.kobe.jp", "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": "ck", "test.ck": "test.ck", "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck",
        "www.www.ck": "www.ck", "k12.ak.us": "k12.ak.us", "www.test.k12.ak.us": "test.k12.ak.us", "b.example.unlisted": "example.unlisted", "localhost": "localhost", "10.1.2.3": "10.1.2.3",
    }
    table = spark.createDataFrame([(r,) for r in rules], "rule string")
    rows = spark.createDataFrame([(f"https://{h.upper()}:80/x", h) for h in cases] * 2 + [("no host", None), (None, None)], "url string, h string")
    got = U.queue_keys(rows, table).collect()
    assert {r["h"]: r["domain_key"] for r in got if r["h"]} == cases and all(r["host_key"] == r["h"] for r in got if r["h"]) and len(got) == 2 * len(cases) + 2
    assert [r["domain_key"] for r in got if r["url"] == "no host"] == ["no host"]
    assert U.queue_keys(rows, table.limit(0)).filter("h = 'a.b.c.kobe.jp'").first()["domain_key"] == "kobe.jp"


def test_paragraphs_follow_the_paths_of_elements(spark):
    pages = {
        1: ("<div><p>one</p><span>two</span></div>", [("one", False, "div/p"), ("two", False, "div/span")]), 2: ("<div><p>one</p></div>two", [("one two", False, "div/p")]), 3: ("<h1></h1><p>text</p>", [("text", True, "p")]),
        4: ("<h1><div>inner</div></h1>", [("inner", True, "h1/div")]), 5: ("<p>a<b>b</b> c<i>d</i></p><p>e</p>", [("a b c d", False, "p"), ("e", False, "p")]), 6: ("<div>x<a href='/'>  y  z </a><p>w</p></div>", [("x y z ", False, "div"), ("w", False, "div/p")]),
    }
    rows = H.segment_paragraphs(spark.createDataFrame([(k, html) for k, (html, _) in pages.items()], "page_id long, html string")).orderBy("page_id", "para_seq").collect()
    for k, (_, expected) in pages.items():
        assert [(r["text"], r["is_heading"], r["tag_path"]) for r in rows if r["page_id"] == k] == [(t.strip(), h, p) for t, h, p in expected]
    assert next(r["chars_in_links"] for r in rows if r["page_id"] == 6) == 3


def second_walk(html):
    """Paragraphs by another way: a tree of elements and texts, visited by recursion."""
    import re
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = ("", [])
            self.stack = [self.root]

        def handle_starttag(self, tag, attrs):
            node = (tag, [])
            self.stack[-1][1].append(node)
            if tag not in H.VOID:
                self.stack.append(node)

        def handle_endtag(self, tag):
            if tag in [t for t, _ in self.stack]:
                while self.stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            self.stack[-1][1].append(data)

    tree = Tree()
    tree.feed(html or "")
    tree.close()
    tidy = lambda t: (lambda x: "" if not x.strip(" \n") else x)(re.sub("\n+", "\n", re.sub(" +", " ", t.replace("\t", " ").replace("\r", " "))))
    everything = lambda n: n if isinstance(n, str) else "".join(map(everything, n[1]))
    done, now = [], {"path": (), "parts": [], "links": 0, "heading": False}

    def whole(p):
        text = ""
        for k, t in enumerate(p["parts"]):
            gap = k and t.strip() and not p["parts"][k - 1][-1:].isspace() and not t[:1].isspace()
            text += " " * bool(gap) + t
        return tidy(text)

    def visit(node, path):
        nonlocal now
        if isinstance(node, str):
            now["parts"].append(tidy(node))
            return
        tag, below = node
        if tag in H.SKIPPED:
            return
        path = (*path, tag)
        if tag in H.BLOCKS or path[: len(now["path"])] != now["path"]:
            if whole(now):
                done.append(now)
                now = {"path": (), "parts": [], "links": 0, "heading": False}
            now["path"] = path
            now["heading"] |= any(re.fullmatch("h[1-6]", t) for t in path)
        if tag == "a":
            now["links"] += len(" ".join(everything(node).split()))
        if tag == "br":
            now["parts"].append("\n")
        for x in below:
            visit(x, path)

    for x in tree.root[1]:
        visit(x, ())
    if whole(now):
        done.append(now)
    return [(k, whole(p).strip(), p["links"], p["heading"], "/".join(p["path"])) for k, p in enumerate(done, 1)]


def test_paragraphs_equal_a_second_walk(spark, sf):
    import random

    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    rng = random.Random(2)
    tags = ["div", "p", "span", "b", "a", "h2", "ul", "li", "em", "footer", "td"]
    for k in range(300):
        parts = []
        for _ in range(rng.randrange(40)):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", f"</{tag}>", "x", " y ", "z\n", "  ", "<br>"]))
        pages.append((10**6 + k, "".join(parts)))
    got = H.segment_paragraphs(spark.createDataFrame(pages, "page_id long, html string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["page_id"], r["para_seq"])):
        by.setdefault(r["page_id"], []).append((r["para_seq"], r["text"], r["chars_in_links"], r["is_heading"], r["tag_path"]))
    for k, html in pages:
        assert by.get(k, []) == second_walk(html), html[:300]


def test_highlight_takes_terms_as_written(spark):
    for text, terms, expected in (("a thing scum b", ["thing", "scum"], "a **thing** **scum** b"), ("C++ and c, (x.", ["c++", "(x"], "**C++** and c, **(x**."), ("things thing_ Thing", ["thing"], "things thing_ **Thing**"), ("new york", ["new", "new york"], "**new york**"), ("x", [], "x"), ("a$1 b", ["a$1"], "**a$1** b")):
        assert one(spark, X.highlight(F.col("s"), terms), s=text) == expected


def test_rules_become_filters_and_boosts(spark):
    rows = spark.createDataFrame([(1, "2020-01-02 00:00:00", 5, 1.0, 2.0), (2, "2019-12-31 23:59:59", 5, 1.0, 2.0), (3, "2020-05-01 00:00:00", 6, 1.0, 2.0), (4, None, 5, 1.0, 2.0), (5, "2020-01-02 00:00:00", None, 1.0, 2.0)], "i int, d string, word_length_i int, average_word_length_f double, score double")
    rows = rows.withColumn("date_post", F.col("d").cast("timestamp"))
    got = Q.apply_rules(rows, "d,01/02/2020,*,0;wl,*,5.9,0;awl,*,*,3").collect()
    assert [(r["i"], round(r["score"], 6)) for r in got] == [(1, 2.0 * 3.001)]
    with pytest.raises(ValueError):
        Q.apply_rules(rows, "nothing,*,*,0")


def test_jobs_start_only_below_the_capacity(spark):
    jobs = lambda working, waiting: spark.createDataFrame([(i, i, "working") for i in range(working)] + [(100 + i, i, "waiting") for i in range(waiting)], "job int, asked int, status string")
    assert R.start_next(jobs(18, 5)).count() == 0
    assert [(r["job"], r["rank"]) for r in R.start_next(jobs(3, 5)).collect()] == [(100 + i, i + 1) for i in range(5)]
    assert R.start_next(jobs(12, 5)).count() == 3


def test_all_jobs_that_fit_start(spark, sf):
    rows = [(i, i * 37 % 101, "working" if i % 3 == 0 else "waiting") for i in range(900)]
    waiting = sorted((asked, i) for i, asked, s in rows if s == "waiting")
    jobs = spark.createDataFrame(rows, "job int, asked int, status string")
    for capacity in (1350, F.expr("count(*) * 3 div 2")):
        assert [(r["job"], r["rank"]) for r in R.start_next(jobs, capacity).collect()] == [(i, k) for k, (_, i) in enumerate(waiting[:450], 1)]
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    states = [r["o_orderstatus"] for r in orders.collect()]
    found = registry.queries()["f20_start_next"](spark, sf)
    assert found.count() == len(states) * 5 // 6 - states.count("P") - states.count("O") > 100


def test_search_url_with_other_numbers_of_words(spark):
    pointer = F.lit("https://a.example/?q=twenty%20cats&x=1")
    for words, expected in ((["one"], "one"), (["a", "b", "c"], "a%20b%20c")):
        assert spark.range(1).select(U.search_url(pointer, F.array(*map(F.lit, words)))).first()[0] == f"https://a.example/?q={expected}&x=1"


def test_periods_pack_and_number(spark):
    text = " ".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(9)) + " Short one."
    rows = P.periods_of(spark.createDataFrame([(1, "https://a.example/1", text)], "doc_id long, url string, text string")).orderBy("period_number_i").collect()
    assert sum(r["sent_length_i"] for r in rows) == 10 and all(r["word_length_i"] >= 30 for r in rows[:-1])
    assert [r["doc_location"] for r in rows] == [f"https://a.example/1\t{i + 1}" for i in range(len(rows))] and {r["parent_document_length_i"] for r in rows} == {len(rows)}


def test_missing_features_fail_rules_and_count_zero_in_boosts(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "k long, x double")
    assert [r["k"] for r in Q.rule_filter(df, [("x", None, None)]).collect()] == [1]
    assert [round(r[0], 3) for r in df.orderBy("k").select(Q.rule_boost(F.lit(2.0), {"x": 1.0})).collect()] == [10.002, 0.002]


def test_progress_never_falls(spark):
    steps, rows = [("waiting", "waiting"), ("committed", "waiting"), ("committed", "committed")], []
    for k, (a, b) in enumerate(steps):
        rows += [(k, "s", True, a)] + ([(k, "s", False, b)] if k else [])
    got = [r["proportion"] for r in R.progress(spark.createDataFrame(rows, "job long, site string, is_search boolean, status string")).orderBy("job").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 1


def test_charsets(spark):
    rows = [("é".encode(), None), ("é".encode("latin-1"), "text/html; charset=ISO-8859-1"), (b'<meta charset="iso-8859-1">' + "é".encode("latin-1"), "")]
    got = S.decode_content(spark.createDataFrame(rows, "content binary, header string"), header="header").collect()
    assert [r["text"][-1] for r in got] == ["é"] * 3


def test_suffix_types(spark):
    df = spark.createDataFrame([("1", "2.5", ["1", "2"], "x")], "a_i string, b_f string, c_is array<string>, d string")
    assert dict(S.cast_by_suffix(df).dtypes) == {"a_i": "int", "b_f": "float", "c_is": "array<int>", "d": "string"}


def test_rules_as_columns_equal_rules_in_the_walk(spark):
    """Every rule of every table, on nodes that hold it or nearly do."""
    from lexloom.operators import rules as U

    rules = U.GENERAL_SKIP + U.BLOG_SKIP + [r for x in U.STARTS.values() for r in x] + [r for t in (U.AUTHORS, U.DATES, U.PERMALINKS) for x in t.values() for r, _ in x] + U.IS_SEARCH + [r for r, _ in U.BURNED_AUTHORS] + [U.BURNED_DATE, U.JSON_LD]
    html = []
    for rule in rules:
        around, own, tag, text = {"parent": {}, "grandparent": {}}, {}, "b", "AM Next schema.org"
        ptag = "i"
        for place, kind, value in rule:
            whose, _, name = place.rpartition(".")
            value = {"result-+headline": "result-headline", "[Ff]ull[_-]*[Oo]verlay": "Full_overlay"}.get(value, value.replace("+", "").replace("(?i)(notice|cookie)\\S*(notice|cookie)", "Cookie-notice").replace("[pP]erma-?link", "Permalink")) if kind == "like" else value
            if name == "tag":
                tag, ptag = (tag, value) if whose else (value, ptag)
            elif name == "text":
                text = value
            else:
                (around[whose] if whose else own)[name] = f"x {value}\ty" if kind == "word" else value
        attrs = lambda d: "".join(f' {k}="{v}"' for k, v in d.items())
        for at in (own, {k: v + "z" for k, v in own.items()}, {k: v.upper() for k, v in own.items()}, {}):
            html.append(f"<u{attrs(around['grandparent'])}><{ptag}{attrs(around['parent'])}><{tag}{attrs(at)}>{text}</{tag}></{ptag}></u>")
    page = "<html><body>" + "".join(html) + "</body></html>"
    df = H.html_to_nodes(spark.createDataFrame([(1, page)], "page_id long, html string")).filter("tag not like '#%'")
    got = {r["pre"]: list(r["m"]) for r in df.select("pre", F.array(*[U.holds(r) for r in rules]).alias("m")).collect()}
    nodes = H.walked(page)
    held = 0
    for row in nodes:
        if not row[2].startswith("#"):
            node = H.as_node(nodes, row)
            expected = [U.matches(node, r) for r in rules]
            held += sum(expected)
            assert got[row[0]] == expected, (row, [rules[i] for i, (a, b) in enumerate(zip(got[row[0]], expected, strict=True)) if a != b])
    assert held > len(rules) / 2


def test_documents_of_a_thread_a_blog_and_a_search_page(spark):
    from lexloom.operators import documents as D

    forum = """<html><head><title>T</title></head><body><p>before any post</p>
      <div class="message first" data-author="isaac" id=p1><span class="dateline_timestamp">Sep 20th, 2019 6:35 am</span><a title="Permalink" href="/t#p1">#1</a>
        <p>It is what it is and that was all there was to it, as they would say of this and of that.</p><div class="modal"><p>It is not there, as this is what was to be left out of it.</p></div></div>
      <div class="message" data-author="emmy" id=p2><span class="dateline_timestamp">11 months ago</span><p>And so it was with this and with that, or so they say of what it was to be.</p><p>xx yy zz</p></div></body></html>"""
    blog = """<html><head><meta name="author" content="&lt;b&gt;Ann&lt;/b&gt; Other"><meta property="article:published_time" content="2021-03-04T05:06:07Z">
      <script type="application/ld+json">{"@context":"https://schema.org","author":"Else","datePublished":"2001-01-01T00:00:00Z"}</script></head>
      <body><div id="comments"><p>This is what was said of it by all of them, as it was for them to say so.</p></div><p>It is the first of all that there was to say, and so they said that it was this and that which was to be the one of them that was for us all to be.</p></body></html>"""
    search = '<html><body><div class="card"><a class="card__link" href="/a">A</a></div><div class="card">no link</div><div class="next"><a class="next" href="/2">Next</a></div></body></html>'
    other = "<html><body><p>It is only what it was, and there is no more to say of it than this and that.</p></body></html>"
    rows = [(1, "https://f.example/t", forum, "forums"), (2, "https://b.example/p", blog, "blog"), (3, "https://s.example/q", search, "searchpage"), (4, "https://o.example", other, None), (5, "https://n.example", None, "blog"), (6, "https://e.example", "", "forums")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, source_type string")
    now = F.lit("2024-01-30").cast("timestamp")
    got = D.extract_documents(pages, now).orderBy("page_id", "doc_seq").collect()
    short = [(r["page_id"], r["doc_seq"], r["url"], r["real_doc"], r["author"], r["date_post"] and r["date_post"].isoformat(), r["is_search"], r["text"][:12]) for r in got]
    assert short == [
        (1, 1, "/t#p1", "https://f.example/t", "isaac", "2019-09-20T06:35:00", False, "It is what i"),
        (2, 1, "https://b.example/p", "self", "Ann Other", "2021-03-04T05:06:07", False, "It is the fi"),
        (3, 1, "/a", "https://s.example/q", None, None, False, ""),
        (3, 3, "/2", "https://s.example/q", None, None, True, ""),
    ]
    assert "left out" not in got[0]["text"] and "before any" not in got[0]["text"] and "said of it" not in got[1]["text"]
    values = D.metadata(pages, now).filter("page_id = 1 and doc_seq = 2").collect()[0]
    assert values["author"] == "emmy" and values["date_post"].isoformat() == "2023-02-28T00:00:00" and values["doc_url"] is None


def test_headings_near_good_paragraphs(spark):
    rows = [(1, 1, "Title", True, "short"), (1, 2, "x" * 150, False, "bad"), (1, 3, "good text", False, "good"), (2, 1, "Title", True, "short"), (2, 2, "x" * 200, False, "bad"), (2, 3, "good text", False, "good"), (3, 1, "Title", True, "short"), (4, 1, "Title", False, "short"), (4, 2, "good", False, "good")]
    df = spark.createDataFrame(rows, "k int, i int, text string, is_heading boolean, cls string")
    got = {(r["k"], r["i"]): r["cls"] for r in H.revise_headings(df, ["k"], "i", "short").collect()}
    assert got[1, 1] == "good" and got[2, 1] == "short" and got[3, 1] == "short" and got[4, 1] == "short"


def test_a_source_type_of_ones_own(spark):
    from lexloom.operators import documents as D
    from lexloom.operators import rules as U

    U.register_rules("test", starts=[(("class", "word", "doc"),)], authors=[((("author", "there", ""),), "author")], settings={"length_low": 3.0, "length_high": 10.0, "stop_low": 0.0, "stop_high": 0.0})
    try:
        html = "<html><body>Do not mind me<div class=doc author=isaac><p>Hello there it is</p></div><div class=doc><p>and so farewell to all</p><p>that is it</p></div></body></html>"
        pages = spark.createDataFrame([(1, "u", html, "test")], "page_id long, url string, html string, source_type string")
        assert D.classified(pages).filter("doc_start").count() == 2
        texts = H.assemble_text(H.number_docs(D.classified(pages))).orderBy("doc_seq").collect()
        assert [r["text"] for r in texts] == ["Hello there it is", "and so farewell to all\n\nthat is it"]
        assert [(r["doc_seq"], r["author"]) for r in D.metadata(pages, F.current_timestamp()).orderBy("doc_seq").collect()] == [(1, "isaac"), (2, None)]
    finally:
        for table in (U.STARTS, U.AUTHORS, U.SETTINGS, U.REGISTERED):
            table.pop("test")


def plain_periods(sentences):
    """Periods from the definition, looking at all sentences each time."""
    import re

    def n_words(text):
        return len(re.findall(r"\w+", text))

    def grams(text):
        return {text[i : i + 3] for i in range(len(text) - 3)}

    periods = []
    for i, s in enumerate(sentences):
        now = " ".join(periods[-1]) if periods else ""
        is_last, short = i == len(sentences) - 1, n_words(s) < 30
        before_short_last = i == len(sentences) - 2 and n_words(sentences[-1]) < 30
        near = n_words(now) + n_words(s) < 50 and len(grams(now) & grams(s)) >= 15 and not before_short_last
        if periods and (n_words(now) < 30 or is_last and short or near):
            periods[-1].append(s)
        else:
            periods.append([s])
    return [" ".join(p) for p in periods]


def test_periods_equal_the_operators_one_by_one(spark, sf):
    """Sentences, languages and islands by the column operators, packed by the plain model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = P.language_islands(P.detect_language(P.split_sentences(docs))).orderBy("doc_id", "pos").collect()
    expected = []
    for (doc, group), part in itertools.groupby(rows, key=lambda r: (r["doc_id"], r["lang_group"])):
        part = list(part)
        expected += [(doc, group, at, part[0]["language_code"], text) for at, text in enumerate(plain_periods([r["sentence"] for r in part]))]
    got = P.pack_periods(docs.withColumn("other", F.lit("x"))).orderBy("doc_id", "period_number_i").collect()
    assert [(r["doc_id"], r["lang_group"], r["at"], r["language_code"], r["text"]) for r in got] == expected
    counts = {}
    for r in got:
        counts.setdefault(r["doc_id"], []).append(r["period_number_i"])
        assert r["other"] == "x"
    assert all(v == list(range(1, len(v) + 1)) for v in counts.values()) and all(r["parent_document_length_i"] == len(counts[r["doc_id"]]) for r in got)
    assert P.pack_periods(spark.createDataFrame([(1, None), (2, ""), (3, " . ! ")], "doc_id long, text string")).count() == 1


def test_scores_as_expression_equal_scores_by_postings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("title", F.substring("text", 1, 60))
    for fields in (("text",), ("title", "text")):
        a = {r["doc_id"]: r["score"] for r in Q.score(docs, "doc_id", ["thing", "the"], fields).collect()}
        b = {r["doc_id"]: r["score"] for r in Q.scored(docs, ["thing", "the"], fields).filter("score is not null").collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_ranked_periods_score_before_they_filter(spark, sf):
    from lexloom.plans.text_queries import ranked_periods

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").withColumn("url", F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id")))
    rows = P.periods_of(docs).filter("text_en is not null").select("doc_location", F.col("text_en").alias("text"), "word_length_i").collect()
    words = {r["doc_location"]: [w.lower() for w in __import__("re").findall(r"\w+", r["text"])] for r in rows}
    idf = {t: 1 + __import__("math").log((len(words) + 1) / (sum(t in w for w in words.values()) + 1)) for t in ("the", "of")}
    best = []
    for k, w in words.items():
        if len(w) >= 10 and all(t in w for t in idf):
            score = sum(w.count(t) ** 0.5 * idf[t] ** 2 for t in idf) / len(w) ** 0.5
            best.append((-round(score * (0.001 + sum(map(len, w)) / len(w)), 6), k))
    assert [(r["doc_location"], r["score"]) for r in ranked_periods(spark, sf).collect()] == [(k, -s) for s, k in sorted(best)[:10]]


@pytest.mark.parametrize(("word", "expected"), [("classes", "class"), ("stories", "stori"), ("miss", "miss"), ("seemingly", "seem"), ("walked", "walk"), ("sing", "sing"), ("cats", "cat"), ("as", "as")])
def test_endings(spark, word, expected):
    assert one(spark, X.stemmed(F.col("w")), w=word) == expected


def test_analysed_text_of_queries(spark):
    got = one(spark, X.analysed_text(F.col("s"), ["the"], protected=("boots",), synonyms={"coat": ["jacket"]}), s="The dog's Boots and coat, walking")
    assert list(got) == ["dog", "boots", "and", "coat", "jacket", "walk"]


def test_sentiment_turns_round_after_a_negation(spark):
    from lexloom.operators import features as A

    rows = spark.createDataFrame([(1, "good good bad it"), (2, "not a good day"), (3, "not it is now good"), (4, ""), (5, None)], "k long, text string")
    got = {r["k"]: tuple(r)[1:] for r in A.sentiment(rows, {"good": 2.0, "bad": -1.0}, ["not"], "k").collect()}
    assert got == {1: (0.5, 0.25, 0.25, round(3 / 24**0.5, 6)), 2: (0.0, 0.25, 0.75, round(-2 / 19**0.5, 6)), 3: (0.2, 0.0, 0.8, round(2 / 19**0.5, 6))}


def test_features_of_contexts(spark):
    from lexloom.operators import features as A

    periods = spark.createDataFrame([("c", "p1", "a a b", None, 9.0), ("c", "p2", "a c", 7, 9.0), ("d", "p3", "x", None, 9.0)], "context string, key string, text string, word_length_i int, average_word_tf_idf_f double")
    sentences = spark.createDataFrame([("c", "p1", "aaaa"), ("c", "p1", "bb"), ("c", "p2", "cccccc")], "context string, key string, sentence string")
    got = {r["key"]: r for r in A.analyse_contexts(periods, sentences, "context", "key", F.lit("2024-01-30").cast("timestamp"), least=2).collect()}
    assert got.keys() == {"p1", "p2"} and len(got["p1"]) == len(set(got["p1"].asDict()))
    assert (got["p1"]["word_length_i"], got["p2"]["word_length_i"]) == (3, 7)
    assert got["p1"]["average_word_tf_idf_f"] == round((1 / 3 + 1 / 3 + 1) / 3, 6) and got["p1"]["sentence_length_deviation_f"] == -1.0 and got["p2"]["sentence_length_deviation_f"] == 2.0


@pytest.mark.parametrize(("url", "ok"), [("https://a.example/x.flv", False), ("https://a.example/x.deb", False), ("https://a.example/x.pdf", True), ("https://a.example/x.jpg?w=1", False), ("https://10.example.com/", True), ("http://10.1.2.3/", False), ("mailto:a@b.example", False), ("http://172.16.0.1:80/", False), ("http://172.32.0.1/", True)])
def test_url_rules(spark, url, ok):
    assert one(spark, U.acceptable_url(F.col("u")), u=url) is ok


def test_sites_with_failures_alone_are_done_and_blocked_parts_block(spark):
    from lexloom.operators import trust as T

    requests = spark.createDataFrame([(1, "a", "failed"), (1, "b", "failed"), (1, "b", "ran"), (1, "c", "cancelled")], "job long, site string, status string")
    assert [r["site"] for r in R.sites_done(requests).collect()] == ["a"] and [r["site"] for r in R.sites_worked(requests).collect()] == ["b"]
    sites = spark.createDataFrame([("ample.com",), ("other.org",), ("",), (None,)], "site string")
    assert [r["site"] for r in T.blocked_sites(sites, spark.createDataFrame([("www.example.com",), (None,)], "address string")).collect()] == ["ample.com"]


def test_a_hot_queue_is_ranked_in_buckets(spark):
    rows = spark.range(1, 2000, 7).selectExpr("id as order", "'https://hot.example/x' as url", "cast(null as double) as robots_delay")
    got = R.politeness_plan(rows, bucket=50).orderBy("order").collect()
    assert [r["start"] for r in got] == [float(k) for k in range(len(got))]


def plain_admission(old, new, minutes=5, others=30):
    """One list of jobs, which an admitted one joins; each that asks looks through all of it."""
    jobs, out = [dict(j) for j in old], []
    for j in sorted(new, key=lambda j: (j["asked"], j["job"])):
        seen = [o for o in jobs if o["key"] == j["key"] and o["changed"] <= j["asked"]]
        if j["privileged"]:
            refused = any(o["crawl"] == j["crawl"] and (o["status"] in ("waiting", "working") or o["status"] == "finished" and o["changed"] >= j["asked"] - minutes) for o in seen)
        else:
            refused = any(o["changed"] >= j["asked"] - others for o in seen)
        if not refused:
            out.append(j["job"])
            jobs.append({"key": j["key"], "crawl": j["crawl"], "status": "waiting", "changed": j["asked"]})
    return sorted(out)


def test_jobs_are_admitted_by_both_rules(spark):
    import random

    rng = random.Random(7)
    old = [{"key": rng.choice("abc"), "crawl": rng.random() < 0.3, "status": rng.choice(["finished", "finished", "failed", "terminated", "working"] if k % 9 == 0 else ["finished", "failed"]), "changed": rng.randrange(600)} for k in range(40)]
    new = [{"job": k, "key": rng.choice(["a", "b", "c", None]), "crawl": rng.random() < 0.3, "privileged": rng.random() < 0.5, "asked": rng.randrange(600)} for k in range(250)]
    at = "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, minute)"
    olds = spark.createDataFrame([(o["key"], o["crawl"], o["status"], o["changed"]) for o in old], "key string, is_crawl boolean, status string, minute int").selectExpr("key", "is_crawl", "status", f"{at} as changed")
    news = spark.createDataFrame([(n["job"], n["key"], n["crawl"], n["privileged"], n["asked"]) for n in new], "job int, key string, is_crawl boolean, privileged boolean, minute int").selectExpr("job", "key", "is_crawl", "privileged", f"{at} as asked", "minute as _row_")
    got = sorted(r["job"] for r in R.dedupe_jobs(news, olds, ["key"], order="job").collect())
    assert got == plain_admission(old, new) and len(got) > 20
    assert R.dedupe_jobs(news, olds, ["key"], order="job").columns == news.columns
    assert R.dedupe_jobs(news.limit(0), olds, ["key"]).count() == 0
    assert R.dedupe_jobs(news.drop("privileged", "is_crawl").filter("key = 'a'"), olds.limit(0), ["key"]).count() == 1


def test_stored_index_rewrites_only_what_it_must(spark, tmp_path):
    from lexloom.sources.index import IndexTable

    rows = spark.createDataFrame([(i, 1, f"v{i}", "s1" if i % 10 else "s0") for i in range(500)] + [(3, 0, "old", "s1")], "key int, version int, value string, site string")
    table = IndexTable.create(rows, f"file://{tmp_path}/index", "key", "version", buckets=32)
    files = lambda: {str(p) for p in tmp_path.rglob("data/**/*.parquet")}
    before = files()
    held = lambda df: {r["key"]: r["value"] for r in df.collect()}
    assert len(before) == 32 and held(table.read()) == {i: f"v{i}" for i in range(500)}
    first = table.read()
    updates = spark.createDataFrame([(3, 2, "new", "s1"), (3, 2, "newer", "s1"), (4, 0, "too old", "s1"), (5, 1, "tie", "s1"), (900, 1, "more", "s1")], "key int, version int, value string, site string")
    touched = table.upsert(updates, batch=0)
    expected = {i: f"v{i}" for i in range(500)} | {3: "newer", 5: "tie", 900: "more"}
    after = files()
    assert held(table.read()) == expected and before < after and len(after - before) == len(touched) <= 4
    assert table.upsert(updates, batch=0) == [] and files() == after and table.versions() == [0, 1]
    assert held(first) == {i: f"v{i}" for i in range(500)}  # a reader of the version before
    gone = table.delete_where(F.col("site") == "s0", batch=1)
    assert held(table.read()) == {k: v for k, v in expected.items() if k >= 500 or k % 10} and len(files() - after) == len(gone)
    assert table.delete_where(F.col("site") == "s0") == [] and len(table.versions()) == 4
    IndexTable(spark, table.folder).vacuum(1)
    assert held(table.read()) == {k: v for k, v in expected.items() if k >= 500 or k % 10} and table.versions() == [3] and len(files()) < len(after)
    with pytest.raises(Exception, match="no key"):
        table.upsert(spark.createDataFrame([(None, 2, "x", "s1")], "key int, version int, value string, site string"))
    with pytest.raises(RuntimeError):
        table._commit(3, {}, -1, {})
    empty = IndexTable.create(rows.limit(0), f"file://{tmp_path}/empty", "key", "version")
    assert empty.read().count() == 0 and empty.read().schema == rows.schema
    empty.upsert(rows)
    assert empty.read().count() == 500
    empty.delete_where(F.lit(True))
    assert empty.read().count() == 0


NATURAL = {
    "Sep 20th, 2019 6:35 am": "2019-09-20 06:35:00", "20 September 2019": "2019-09-20 00:00:00", "20 Sept. 2019": "2019-09-20 00:00:00", "Tuesday": "2020-03-24 00:00:00", "yesterday": "2020-03-30 00:00:00", "Yesterday at 5pm": "2020-03-30 17:00:00", "last Friday": "2020-03-27 00:00:00",
    "Monday 14:30": "2020-03-30 14:30:00", "March 3": "2020-03-03 00:00:00", "3 March": "2020-03-03 00:00:00", "April 1": "2019-04-01 00:00:00", "Dec 25th at 6:05 p.m.": "2019-12-25 18:05:00", "March 2019": "2019-03-01 00:00:00", "2019": "2019-01-01 00:00:00", "last week": "2020-03-22 00:00:00",
    "last month": "2020-02-01 00:00:00", "last year": "2019-01-01 00:00:00", "this week": "2020-03-29 00:00:00", "3 hours ago": "2020-03-31 09:00:00", "a week ago": "2020-03-24 12:00:00", "an hour ago": "2020-03-31 11:00:00", "2 fortnights ago": "2020-03-03 12:00:00", "1 month ago": "2020-02-29 12:00:00",
    "5 mins ago": "2020-03-31 11:55:00", "11:00": "2020-03-31 11:00:00", "1:30 pm": "2020-03-30 13:30:00", "13:75": None, "1/2/2020": "2020-01-02 00:00:00", "25/12/2019": "2019-12-25 00:00:00", "12/31/99": "1999-12-31 00:00:00", "2020-01-10T18:03:00Z": "2020-01-10 18:03:00", "noon": "2020-03-31 12:00:00",
    "2019/7/4 08:09": "2019-07-04 08:09:00", "Wed, 5 Feb 2020 10:11:12 GMT": "2020-02-05 10:11:12", "Sunday noon": "2020-03-29 12:00:00", "Feb 30 2019": None, "Feb 29": "2020-02-29 00:00:00", "nonsense": None, "": None, "31-Jan-2020": "2020-01-31 00:00:00", "today": "2020-03-31 00:00:00",
    "day before yesterday": "2020-03-29 00:00:00", "September": "2019-09-01 00:00:00", "Fri Mar 27 2020 23:59": "2020-03-27 23:59:00", "Oct 15, 2018": "2018-10-15 00:00:00", "now": "2020-03-31 12:00:00", "12:00 am": "2020-03-31 00:00:00", "13 pm": None, "may the force": None, None: None,
}


def test_natural_dates_lie_in_the_past(spark):
    from lexloom.functions.dates import natural_date

    rows = spark.createDataFrame(list(enumerate(NATURAL)), "i int, s string")
    got = {r["s"]: r["d"] and str(r["d"]) for r in rows.select("s", natural_date(F.col("s"), F.lit("2020-03-31 12:00:00").cast("timestamp")).alias("d")).collect()}
    assert {k: (v, NATURAL[k]) for k, v in got.items() if v != NATURAL[k]} == {} and len(got) > 45


def test_charsets_from_bytes(spark):
    from lexloom.plans.frontier_queries import WORDS_IN

    more = [("El niño comió piñas en España, señor ¿qué más? ¡Ñandú!", "windows-1252"), ("smörgåsbord på svenska är gott, øl og brød", "windows-1252"), ("Příliš žluťoučký kůň úpěl ďábelské ódy", "iso-8859-2"), ("plain", "utf-8"), ("ñ" * 2000, "utf-8"), ("", "utf-8"), ("Die Größe der Bäume überrascht die Mädchen", "windows-1252")]
    cases = [(w, c) for c, w in WORDS_IN.items()] + more
    rows = spark.createDataFrame([(i, bytearray(t.encode(c))) for i, (t, c) in enumerate(cases)] + [(99, None)], "i int, content binary")
    got = {r["i"]: (r["text"], r["charset"]) for r in S.decode_content(rows).collect()}
    assert [got[i] for i in range(len(cases))] == cases and got[99][0] is None
    page = '<meta charset="windows-1253">Αθήνα'.encode("windows-1253")
    assert S.decode_content(spark.createDataFrame([(bytearray(page),)], "content binary")).first()["text"].endswith("Αθήνα")
    assert S.decode_content(spark.createDataFrame([(bytearray("é".encode("latin1")), "text/html; charset=ISO-8859-1")], "content binary, h string"), header="h").first()["text"] == "é"


def test_trained_languages_on_held_out_documents(spark):
    from lexloom.operators import languages as L

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train_languages(docs)
    rows = L.sentence_languages(docs.filter(L.held_out(F.col("doc_id"))), model).join(docs.select("doc_id", "lang"), "doc_id")
    by_sentence = rows.filter(F.length("sentence") >= 20).agg(F.avg((F.col("language_code") == F.col("lang")).cast("double"))).first()[0]
    top = rows.groupBy("doc_id", "lang").agg(F.mode("language_code").alias("top")).agg(F.avg((F.col("top") == F.col("lang")).cast("double")), F.count("*")).first()
    assert by_sentence > 0.97 and top[0] > 0.99 and top[1] > 200, (by_sentence, top)
    small = L.train_languages(spark.createDataFrame([(0, "aa bb", "x"), (2, "cc dd", "y"), (3, None, "y"), (None, "zz", "z"), (4, "qq", None)], "doc_id long, text string, lang string"), 64)
    assert small.langs in (["x", "y"], ["x"], ["y"]) and L.train_languages(docs.limit(0)).langs == []
    edge = spark.createDataFrame([(1, "12. aa bb. 3! dd"), (2, None), (3, ""), (4, "7. 8.")], "doc_id long, text string")
    got = [(r["doc_id"], r["pos"], r["language_code"]) for r in L.sentence_languages(edge, model, default="none").orderBy("doc_id", "pos").collect()]
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (4, 0), (4, 1)] and got[0][2] == got[4][2] == got[5][2] == "none" and got[2][2] == got[1][2] != "none"


def test_global_order_equals_a_window_over_all(spark):
    from pyspark.sql import Window

    rows = spark.range(3000).selectExpr("id as order", "concat('https://', case when id % 3 = 0 then 'hot' else concat('h', id % 50) end, '.example/', id) as url", "if(id % 7 = 0, 3.0D, null) as robots_delay", "id % 400 = 0 as forced")
    got = R.fetch_order(rows, force="forced")
    again = got.withColumn("expected", F.row_number().over(Window.orderBy(F.col("forced").desc(), "start", "queue", "order")))
    assert again.count() == 3000 and again.filter("rank != expected").count() == 0
    assert R.in_order(rows.limit(0), ["order"]).count() == 0


def plain_viterbi(words, g):
    from lexloom.operators.classes import CLASSES

    def cost(w, i):
        low = w.lower()
        if low in g.words:
            return g.words[low]
        if i and len(w) > 1 and w[0].isupper() and w[1].islower():
            return g.capital
        ends = [e for e in g.endings if low.endswith(e) and len(low) > len(e)]
        return g.endings[max(ends, key=len)] if ends else g.other

    best = {CLASSES.index(g.first): (0, [])}
    for i, w in enumerate(words):
        c, now = cost(w, i), {}
        for j in range(len(CLASSES)):
            before = min(best, key=lambda b: (-(best[b][0] + g.after[b][j]), b))
            now[j] = (best[before][0] + g.after[before][j] + c[j], [*best[before][1], j])
        best = now
    return [CLASSES[j] for j in best[min(best, key=lambda b: (-best[b][0], b))][1]]


def test_word_classes_equal_a_plain_viterbi_and_recover_a_grammar(spark):
    import random
    import re

    from lexloom.operators import classes as C

    g, rng = C.Grammar(), random.Random(3)
    pools = {"X": ["the", "of", "and", "quickly"], "NOUN": ["darkness", "cat", "houses", "nation"], "ADJ": ["famous", "good", "lovable"], "VERB": ["is", "walking", "jumped"], "PROPN": ["Anna", "Berlin"]}
    patterns = ["X ADJ NOUN VERB X NOUN", "X NOUN VERB X ADJ NOUN", "X NOUN X PROPN VERB ADJ", "X ADJ ADJ NOUN VERB X PROPN PROPN"]
    rows, truth = [], {}
    for k in range(60):
        tags, sentences = [], []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(patterns).split()
            tags += p
            sentences.append(" ".join(rng.choice(pools[t]) for t in p) + rng.choice(".!?"))
        rows.append((k, " ".join(sentences)))
        truth[k] = tags
    rows += [(100 + k, " ".join(rng.choice(["walking", "the", "Xylo", "blorps", "zzz", "GOOD", "a"]) for _ in range(rng.randrange(60)))) for k in range(60)] + [(999, None), (998, ""), (997, "...")]
    got = {r["k"]: r for r in C.word_class_proportions(spark.createDataFrame(rows, "k int, text string"), "k").collect()}
    names = {"ADJ": "adjectives", "NOUN": "nouns", "PROPN": "proper_nouns", "VERB": "verbs"}
    right = total = 0
    for k, text in rows:
        tags = [t for s in re.findall("[^.!?]+[.!?]*", text or "") for t in plain_viterbi(re.findall(r"\w+", s), g)]
        if not tags:
            assert k not in got
            continue
        for c, name in names.items():
            assert got[k][f"{name}_proportion_f"] == pytest.approx(tags.count(c) / len(tags), abs=1e-6)
        if k in truth:
            right += sum(a == b for a, b in zip(tags, truth[k], strict=True))
            total += len(tags)
    assert right > 0.95 * total > 0


def test_index_and_query_terms(spark):
    from lexloom.operators import analysis as N

    known = spark.createDataFrame([(w,) for w in ["walk", "Pony", "bake", "stop", "glass", "city", "new", "boot", "walk"]], "word string")
    rows = spark.createDataFrame([(1, "The dog's Ponies stopped baking, and Boots walked glasses zings"), (2, None), (3, ""), (4, "the THE")], "k int, text string")
    index = N.index_terms(rows, "k", ["the", "and"], known, ("boots",)).orderBy("position").collect()
    assert [(r["position"], r["term"]) for r in index] == [(2, "dog"), (3, "pony"), (4, "stop"), (5, "bake"), (7, "boots"), (8, "walk"), (9, "glass"), (10, "zings")]
    asked = spark.createDataFrame([(1, "hotels in New York City and NY"), (2, "new york"), (3, "York")], "k int, text string")
    synonyms = {"new york city": ["nyc", "big apple"], "new york": ["ny state"], "ny": ["new york"], "york": ["eboracum"]}
    got = {}
    for r in N.query_terms(asked, "k", ["in", "and", "big"], known, synonyms=synonyms).collect():
        got.setdefault(r["k"], {}).setdefault(r["position"], set()).add(r["term"])
    assert got == {1: {1: {"hotels"}, 3: {"new", "nyc"}, 4: {"york", "apple"}, 5: {"city"}, 7: {"ny", "new"}, 8: {"york"}}, 2: {1: {"new", "ny"}, 2: {"york", "state"}}, 3: {1: {"york", "eboracum"}}}
    plain = N.index_terms(rows, "k", ["the"]).filter("position = 3").first()["term"]
    assert plain == "ponies" and N.index_terms(rows.limit(0), "k", ["the"], known.limit(0)).count() == 0


def test_sentiment_equals_a_plain_count(spark):
    import random

    from lexloom.operators import features as A

    rng, valences, negations = random.Random(1), {"good": 2.0, "bad": -1.5, "Odd": 9.0}, ["not", "no"]
    rows = [(k, " ".join(rng.choice(["good", "Bad", "not", "no", "x", "GOOD", "odd"]) for _ in range(rng.randrange(1, 30)))) for k in range(80)] + [(900, None), (901, ""), (902, "?!")]
    got = {r["k"]: r for r in A.sentiment(spark.createDataFrame(rows, "k int, text string"), valences, negations, "k").collect()}
    for k, text in rows:
        words = [w.lower() for w in (text or "").split()] if k < 900 else []
        values = [valences.get(w, 0.0) * (-1 if any(x in negations for x in words[max(0, i - 3) : i]) else 1) for i, w in enumerate(words)]
        if not words:
            assert k not in got
            continue
        s = sum(values)
        expected = (sum(v > 0 for v in values) / len(values), sum(v < 0 for v in values) / len(values), sum(v == 0 for v in values) / len(values), s / (s * s + 15) ** 0.5)
        assert all(abs(got[k][c] - e) < 2e-6 for c, e in zip(("positive_polarity_f", "negative_polarity_f", "neutral_polarity_f", "compound_polarity_f"), expected, strict=True))
