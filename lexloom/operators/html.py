"""HTML pages to node and paragraph tables, and the classes of paragraphs.

`html_to_nodes` and `segment_paragraphs` walk each page in one pass inside `mapInArrow`: no shuffle, and memory for one
page at a time. Everything after that is columns and windows by page.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host
from . import rules as U

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"head", "meta", "script", "style", "iframe", "footer", "aside"}
# The tags that begin a paragraph.
BLOCKS = {
    "body", "blockquote", "caption", "center", "col", "colgroup", "dd", "div", "dl", "dt", "fieldset", "form", "legend", "optgroup", "option", "p", "pre",
    "table", "td", "textarea", "tfoot", "th", "thead", "tr", "ul", "li", "h1", "h2", "h3", "h4", "h5", "h6",
}
NODES = "page_id long, pre int, subtree_end int, tag string, depth int, attrs map<string,string>, parent_tag string, parent_attrs map<string,string>, gp_attrs map<string,string>, text string, render_text string"
PARAGRAPHS = "page_id long, para_seq int, text string, chars_in_links int, is_heading boolean, tag_path string, doc_start boolean"
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Walk(HTMLParser):
    """Nodes in document order; tags that are not closed end with the tag around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: dict[str, str], text: str | None) -> int:
        up = self.nodes[self.open[-1]] if self.open else None
        above = self.nodes[self.open[-2]] if len(self.open) > 1 else None
        self.nodes.append([len(self.nodes), len(self.nodes), tag, len(self.open), attrs, up and up[2], up and up[4], text, above and above[4]])
        return len(self.nodes) - 1

    def handle_starttag(self, tag, attrs):
        n = self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag):
        if any(self.nodes[i][2] == tag for i in self.open):
            while True:
                n = self.open.pop()
                self.nodes[n][1] = len(self.nodes) - 1
                if self.nodes[n][2] == tag:
                    break

    def handle_data(self, data):
        self._add("#text", {}, data)

    def handle_comment(self, data):
        self._add("#comment", {}, data)

    def done(self) -> list[list]:
        self.close()
        while self.open:
            self.nodes[self.open.pop()][1] = len(self.nodes) - 1
        return self.nodes


def walked(html: str | None) -> list[list]:
    walk = _Walk()
    walk.feed(html or "")
    return walk.done()


def rendered(nodes: list[list], row: list) -> str:
    """All text below a node."""
    return "".join(r[7] for r in nodes[row[0] : row[1] + 1] if r[2] == "#text" and r[7])


def as_node(nodes: list[list], row: list) -> dict:
    """A node as the rules see it."""
    return {"tag": row[2], "attrs": row[4], "parent_tag": row[5], "parent_attrs": row[6], "gp_attrs": row[8], "text": lambda: rendered(nodes, row)}


def render_text(nodes: list[list], row: list) -> str | None:
    """The text below nodes that may hold a value by the rest of some rule."""
    if row[2].startswith("#") or not (row[4] or row[2] == "a"):
        return None
    node = as_node(nodes, row)
    return rendered(nodes, row) if any(U.matches(node, tuple(t for t in rule if t[0] != "text")) for rule in U.TEXT_RULES) else None


def skips(row: list, source_type: str | None) -> bool:
    """Whether a node is left out with all below it."""
    if row[2] in SKIPPED or row[2] == "#comment":
        return True
    return row[2][0] != "#" and any(U.matches(as_node([], row), r) for r in U.skip_rules(source_type))


def cleaned(text: str) -> str:
    """As functions.text.clean_text, with tabs and returns as spaces."""
    out = re.sub("\n+", "\n", re.sub(" +", " ", re.sub(r"[\t\r]", " ", text)))
    return "" if out.strip(" \n") == "" else out


class _Paragraph:
    """What a walk gathers of one paragraph."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.links, self.heading, self.start, self.path = 0, False, False, []

    def text(self) -> str:
        """The texts in a row, with a space between two that have no white space where they meet."""
        out = ""
        for i, t in enumerate(self.texts):
            joins = i == 0 or not t.strip() or self.texts[i - 1][-1:].isspace() or t[:1].isspace()
            out += t if joins else f" {t}"
        return cleaned(out)


def paragraphs_of(nodes: list[list], source_type: str | None = "") -> tuple[list[tuple], list[int]]:
    """(text, characters in links, heading, path, document start) of each paragraph, and for each node the number of
    document starts up to it, 0 in skipped parts.

    A paragraph begins with an element that is a block tag or whose path does not go on from the paragraph's path, and at
    a document start; text alone begins none. A paragraph without text is used again with the marks that it has. It is a
    heading if a heading tag is on its path. A link's whole text counts for the paragraph in which the link begins.
    Skipped tags go with all below them. The source type '' has no rules: no starts, and no parts are skipped but those of
    SKIPPED."""
    starts = U.start_rules(source_type) if source_type != "" else []
    out: list[_Paragraph] = []
    now = _Paragraph()
    path, skip, count, docs = [], -1, 0, [0] * len(nodes)

    def begin() -> None:
        nonlocal now
        if now.text():
            out.append(now)
            now = _Paragraph()
        now.path = list(path)
        now.heading = now.heading or any(t in HEADINGS for t in path)

    for row in nodes:
        pre, end, tag, depth, text = row[0], row[1], row[2], row[3], row[7]
        if pre <= skip:
            continue
        if skips(row, source_type):
            skip = end
            continue
        del path[depth:]
        if tag[0] != "#":
            path.append(tag)
            if tag in BLOCKS or path[: len(now.path)] != now.path:
                begin()
            if not now.start and any(U.matches(as_node(nodes, row), r) for r in starts):
                begin()
                now.start = True
                count += 1
            if tag == "a":
                now.links += len(" ".join(rendered(nodes, row).split()))
            if tag == "br":
                now.texts.append("\n")
        elif text:
            now.texts.append(cleaned(text))
        docs[pre] = count
    begin()
    return [(p.text().strip(), p.links, p.heading, "/".join(p.path), p.start) for p in out], docs


def _per_page(make: Callable[..., dict[str, list]], schema: pa.Schema, least: int = 4000) -> Callable:
    own = dict(U.REGISTERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source_type, tables in own.items():
            U.register_rules(source_type, *tables)
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in schema.names}
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name, values in make(*row).items():
                    rows[name] += values
                if len(rows[schema.names[0]]) >= least:
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
                    rows = {name: [] for name in schema.names}
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


_MAP = pa.map_(pa.string(), pa.string())


def html_to_nodes(pages: DataFrame) -> DataFrame:
    schema = pa.schema([("page_id", pa.int64()), ("pre", pa.int32()), ("subtree_end", pa.int32()), ("tag", pa.string()), ("depth", pa.int32()), ("attrs", _MAP), ("parent_tag", pa.string()), ("parent_attrs", _MAP), ("gp_attrs", _MAP), ("text", pa.string()), ("render_text", pa.string())])

    def make(page: int, html: str | None) -> dict[str, list]:
        rows = walked(html)
        flat = lambda d: list(d.items()) if d is not None else None
        return {"page_id": [page] * len(rows), "pre": [r[0] for r in rows], "subtree_end": [r[1] for r in rows], "tag": [r[2] for r in rows], "depth": [r[3] for r in rows], "attrs": [flat(r[4]) for r in rows], "parent_tag": [r[5] for r in rows], "parent_attrs": [flat(r[6]) for r in rows], "gp_attrs": [flat(r[8]) for r in rows], "text": [r[7] for r in rows], "render_text": [render_text(rows, r) for r in rows]}

    return pages.select("page_id", "html").mapInArrow(_per_page(make, schema), NODES)


def segment_paragraphs(pages: DataFrame) -> DataFrame:
    """Paragraphs of pages (page_id, html and, for document starts and skipped parts by its rules, source_type)."""
    schema = pa.schema([("page_id", pa.int64()), ("para_seq", pa.int32()), ("text", pa.string()), ("chars_in_links", pa.int32()), ("is_heading", pa.bool_()), ("tag_path", pa.string()), ("doc_start", pa.bool_())])

    def make(page: int, html: str | None, source_type: str | None) -> dict[str, list]:
        rows, _ = paragraphs_of(walked(html), source_type)
        return {"page_id": [page] * len(rows), "para_seq": list(range(1, len(rows) + 1)), "text": [r[0] for r in rows], "chars_in_links": [r[1] for r in rows], "is_heading": [r[2] for r in rows], "tag_path": [r[3] for r in rows], "doc_start": [r[4] for r in rows]}

    source = F.col("source_type") if "source_type" in pages.columns else F.lit("").alias("source_type")
    out = pages.select("page_id", "html", source).mapInArrow(_per_page(make, schema), PARAGRAPHS)
    return out if "source_type" in pages.columns else out.drop("doc_start")


def prune_subtrees(nodes: DataFrame, bad: Column) -> DataFrame:
    """Without the nodes for which `bad` holds and all below them."""
    so_far = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return nodes.withColumn("_cut", F.max(F.when(bad, F.col("subtree_end"))).over(so_far)).filter(F.col("_cut").isNull() | (F.col("_cut") < F.col("pre"))).drop("_cut")


# ---- classes


def classify_basic(df: DataFrame, max_link_density=0.2, length_low=60, length_high=130, stop_low=0.3, stop_high=0.32) -> DataFrame:
    """Adds cls from link_density, stop_density, text and chars_in_links; thresholds are numbers or columns."""
    n = F.length("text")
    cls = (
        F.when(F.col("link_density") > max_link_density, "bad").when(F.col("text").contains("©"), "bad").when(n < length_low, F.when(F.col("chars_in_links") > 0, "bad").otherwise("short"))
        .when(F.col("stop_density") > stop_high, F.when(n > length_high, "good").otherwise("near-good")).when(F.col("stop_density") >= stop_low, "near-good").otherwise("bad")
    )
    return df.withColumn("cls", cls)


def revise_short(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Short paragraphs become good between good ones, or a good and a near-good one, or at an end next to a good one."""
    w = Window.partitionBy(*keys).orderBy(order)
    judged = F.when(F.col("cls") != "short", F.col("cls"))
    a = F.last(judged, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = F.first(judged, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    pair = F.concat(F.coalesce(a, F.lit("-")), F.lit(" "), F.coalesce(b, F.lit("-")))
    better = pair.isin("good good", "good near-good", "near-good good", "good -", "- good")
    return df.withColumn("cls", F.when(F.col("cls") != "short", F.col("cls")).when(better, "good").otherwise("bad"))


def revise_near_good(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Near-good paragraphs become bad between bad ones (or the ends), else good."""
    w = Window.partitionBy(*keys).orderBy(order)
    pair = F.concat(F.coalesce(F.lag("cls").over(w), F.lit("-")), F.lit(" "), F.coalesce(F.lead("cls").over(w), F.lit("-")))
    return df.withColumn("cls", F.when(F.col("cls") != "near-good", F.col("cls")).when(pair.isin("bad bad", "bad -", "- bad"), "bad").otherwise("good"))


def revise_headings(df: DataFrame, keys: list[str], order: str, cls: str, distance: int = 200) -> DataFrame:
    """Headings of class `cls` become good where less than `distance` characters stand before the next good paragraph."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_at", F.coalesce(before, F.lit(0)))
    good = F.first(F.when(F.col("cls") == "good", F.col("_at")), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("_gap", good - F.col("_at") - F.length("text"))
    near = F.col("is_heading") & (F.col("cls") == cls) & (F.col("_gap") < distance)
    return rows.withColumn("cls", F.when(near, "good").otherwise(F.col("cls"))).drop("_at", "_gap")


def number_docs(paragraphs: DataFrame) -> DataFrame:
    """doc_seq counts document starts; what stands before the first is dropped."""
    w = Window.partitionBy("page_id").orderBy("para_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return paragraphs.withColumn("doc_seq", F.sum(F.col("doc_start").cast("int")).over(w)).filter("doc_seq > 0")


def assemble_text(paragraphs: DataFrame) -> DataFrame:
    """Good paragraphs of each document joined by a blank line; '' for a document without any."""
    return paragraphs.groupBy("page_id", "doc_seq").agg(F.coalesce(F.expr("listagg(case when cls = 'good' then text end, '\n\n') within group (order by para_seq)"), F.lit("")).alias("text"))


def last_values(nodes: DataFrame, keys: list[str], order: str, rules: dict[str, Column]) -> DataFrame:
    """For each rule the last value that is not null, by document."""
    return nodes.groupBy(*keys).agg(*[F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(k) for k, v in rules.items()])


def page_meta(pages: DataFrame) -> DataFrame:
    """title, description, keywords, canonical and host of pages (page_id, url, html), null where a page has none, beside
    the columns of pages but html."""
    named = lambda name: F.when((F.col("tag") == "meta") & (F.lower(F.col("attrs")["name"]) == name), F.col("attrs")["content"])
    rules = {
        "title": F.when((F.col("parent_tag") == "title") & (F.col("tag") == "#text"), F.col("text")), "description": named("description"), "keywords": named("keywords"),
        "canonical": F.when((F.col("tag") == "link") & (F.lower(F.col("attrs")["rel"]) == "canonical"), F.col("attrs")["href"]),
    }
    rows = last_values(html_to_nodes(pages).filter(F.col("tag").isin("meta", "link") | (F.col("parent_tag") == "title")), ["page_id"], "pre", rules)
    words = F.transform(F.split("keywords", ","), lambda w: F.trim(w))
    return pages.drop("html").join(rows, "page_id", "left").withColumn("keywords", words).withColumn("host", host(F.col("url")))
