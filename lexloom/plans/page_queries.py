"""Queries from pages of a source type to documents. Threads, blogs and search pages are made of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import html as H
from ..operators import rules as U
from .base import Tables, query, ts

SOURCES = ["forums", "blog", "media", "searchpage"]
SOURCE_SQL = "case doc_id % 4 when 0 then 'forums' when 1 then 'blog' when 2 then 'media' else 'searchpage' end"
NOW = "2024-01-30"


def escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def threads(t: Tables) -> DataFrame:
    """A forum page for each conversation, a post for each turn, posted so many days after 1 September 2019."""
    day = F.date_format(F.date_add(F.lit("2019-09-01").cast("date"), F.col("turn").cast("int")), "MMM d")
    post = F.concat(
        F.lit('<li class="js message post" data-author="'), "role", F.lit(" "), F.col("turn"), F.lit('" id="p'), F.col("turn"), F.lit('"><span class="dateline_timestamp">'), day, F.lit("th, 2019 6:35 am</span><a class=permalink href=\"/t/"),
        F.col("conv_id"), F.lit("#p"), F.col("turn"), F.lit('">#</a><div class="modal">window</div><p>'), escaped(F.coalesce("text", F.lit(""))), F.lit("</p></li>"),
    )
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", post.alias("post")))).alias("posts"))
    html = F.concat(F.lit("<html><head><title>t</title></head><body><nav><a href=/>home</a></nav><p>before the first post</p><ul>"), F.array_join("posts.post", ""), F.lit("</ul><footer>end</footer></body></html>"))
    return rows.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("https://forum.example/t/"), "conv_id").alias("url"), html.alias("html"), F.lit("forums").alias("source_type"))


def blogs(t: Tables) -> DataFrame:
    """A blog page for each document: its source as author in a meta tag, its id in days as date in schema.org."""
    date = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")
    ld = F.concat(F.lit('{"@context": "https://schema.org", "author": {"name": "ld '), "source", F.lit('"}, "datePublished": "'), date, F.lit('"}'))
    meta = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<meta name="author" content="<i>'), "source", F.lit('</i>">'))).otherwise('<meta name="author" content="https://example.com/me">')
    body = F.array_join(F.transform(F.split(escaped(F.coalesce("text", F.lit(""))), "\n"), lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>"))), "")
    html = F.concat(F.lit("<html><head>"), meta, F.lit('<script type="application/ld+json">'), ld, F.lit('</script></head><body><div id="comments"><p>not this</p></div>'), body, F.lit("</body></html>"))
    return t.documents.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://blog.example/"), "doc_id").alias("url"), html.alias("html"), F.lit("blog").alias("source_type"))


def results(t: Tables) -> DataFrame:
    """A search page for each nation: a card for each supplier, and a link to the next page."""
    card = F.concat(F.lit('<div class="card"><a class="x card__link" href="/s/'), F.col("s_suppkey"), F.lit('">'), "s_name", F.lit("</a></div>"))
    rows = t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", card.alias("card")))).alias("cards"))
    html = F.concat(F.lit("<html><body>"), F.array_join("cards.card", ""), F.lit('<div class="next"><a href="/search?page=2">Next</a></div></body></html>'))
    return rows.select(F.col("s_nationkey").cast("long").alias("page_id"), F.lit("https://shop.example/search").alias("url"), html.alias("html"), F.lit("searchpage").alias("source_type"))


POSTS = "posts as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as doc_seq from conversations)"


@query("select page_id, cast(len(regexp_extract_all(html, '<nav[ >]')) as bigint) as n_skipped from pages")
def h3_general_skip(t):
    return H.html_to_nodes(t.pages).groupBy("page_id").agg(F.count_if(U.any_holds(U.GENERAL_SKIP)).alias("n_skipped"))


@query("select doc_id as page_id, cast(1 as bigint) as n_skipped from documents")
def h4_blog_skip(t):
    return H.html_to_nodes(blogs(t)).groupBy("page_id").agg(F.count_if(U.any_holds(U.BLOG_SKIP)).alias("n_skipped"))


@query(
    f"select doc_id, source_type, cast(case when source_type in ('forums', 'searchpage') then 40 else 60 end as double) as length_low, cast(case source_type when 'media' then 120 when 'blog' then 130 else 40 end as double) as length_high, "
    f"case when source_type = 'media' then 0.4 else 0.2 end::double as max_link_density, case when source_type in ('forums', 'searchpage') then 0.17 else 0.3 end::double as stop_low, case when source_type in ('forums', 'searchpage') then 0.22 else 0.32 end::double as stop_high "
    f"from (select doc_id, {SOURCE_SQL} as source_type from documents)"
)
def h13_settings_for(t):
    rows = t.documents.select("doc_id", F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("source_type"))
    return U.settings_for(rows)


@query(f"with {POSTS} select conv_id as page_id, cast(count(*) as bigint) as n_starts from posts group by conv_id")
def d1_doc_starts(t):
    return H.html_to_nodes(threads(t)).groupBy("page_id").agg(F.count_if(U.any_holds(U.start_rules("forums"))).alias("n_starts"))


@query(f"select doc_id, {SOURCE_SQL} as source_type from documents where doc_id % 4 in (1, 2) or coalesce(source, '') not in ('', 'src0')")
def d4_drop_empty_url(t):
    rows = t.documents.select("doc_id", F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("source_type"), F.when(F.col("source") != "src0", F.col("source")).alias("url"))
    return D.drop_empty_url(rows, F.col("source_type").isin("media", "blog")).select("doc_id", "source_type")


def _metadata(pages: DataFrame) -> DataFrame:
    return D.metadata(pages, ts(NOW))


@query(f"with {POSTS} select conv_id as page_id, cast(doc_seq as int) as doc_seq, role || ' ' || turn as author from posts")
def d6_author_rules(t):
    return _metadata(threads(t)).select("page_id", "doc_seq", "author")


@query(f"with {POSTS} select conv_id as page_id, cast(doc_seq as int) as doc_seq, timestamp '2019-09-01 06:35:00' + to_days(cast(turn as int)) as date_post from posts")
def d7_date_rules(t):
    return _metadata(threads(t)).select("page_id", "doc_seq", "date_post")


@query(f"with {POSTS} select conv_id as page_id, cast(doc_seq as int) as doc_seq, '/t/' || conv_id || '#p' || turn as doc_url from posts")
def d9_permalink_rules(t):
    return _metadata(threads(t)).select("page_id", "doc_seq", "doc_url")


@query("""with s as (select cast(s_nationkey as bigint) as page_id, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) as n from supplier)
    select page_id, cast(n as int) as doc_seq, '/s/' || s_suppkey as doc_url, false as is_search from s union all select page_id, cast(max(n) + 1 as int), '/search?page=2', true from s group by page_id""")
def d10_is_search_link(t):
    return _metadata(results(t)).select("page_id", "doc_seq", "doc_url", F.coalesce("is_search", F.lit(False)).alias("is_search"))


@query("select doc_id as page_id, case when doc_id % 2 = 0 then source else 'ld ' || source end as author, timestamp '2020-01-01' + to_days(cast(doc_id % 1000 as int)) as date_post from documents")
def d11_burned_meta(t):
    return _metadata(blogs(t)).select("page_id", "author", "date_post")


@query(f"""with r as (select *, 'https://site.example/' || o_orderkey as page_url, o_orderkey % 2 = 0 as whole, case when o_orderkey % 3 = 0 then '#c' || o_custkey else 'https://other.example/' || o_custkey end as doc_url from orders)
    select o_orderkey, o_orderstatus as site_name, case when whole then page_url when doc_url like '#%' then page_url || doc_url else doc_url end as url, case when whole then 'self' else page_url end as real_doc, timestamp '{NOW}' as date_retr,
    case when o_totalprice > 100000 then [o_orderpriority, 'asked'] else [o_orderstatus] end as tags from r""")
def d12_fill_site_fields(t):
    page = F.concat(F.lit("https://site.example/"), "o_orderkey")
    own = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("#c"), "o_custkey")).otherwise(F.concat(F.lit("https://other.example/"), "o_custkey"))
    docs = t.orders.select("o_orderkey", own.alias("doc_url"))
    asked = F.when(F.col("o_totalprice") > 100000, F.array("o_orderpriority", F.lit("asked"))).otherwise(F.array().cast("array<string>"))
    requests = t.orders.select(F.col("o_orderkey").alias("request"), page.alias("page_url"), F.col("o_orderstatus").alias("site_name"), (F.col("o_orderkey") % 2 == 0).alias("whole"), asked.alias("own_tags"), F.array("o_orderstatus").alias("site_tags"))
    filled = D.fill_site_fields(docs.join(requests, F.col("o_orderkey") == F.col("request")), ts(NOW), F.col("whole"))
    return filled.select("o_orderkey", "site_name", "url", "real_doc", "date_retr", "tags")


@query()
def extract_threads(t):
    return D.extract_documents(threads(t), ts(NOW))


@query()
def extract_blogs(t):
    return D.extract_documents(blogs(t), ts(NOW))
