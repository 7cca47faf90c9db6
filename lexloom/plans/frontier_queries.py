"""Crawl, job, trust and source queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import features as A
from ..operators import frontier as R
from ..operators import search as Q
from ..operators import trust as T
from ..sources import io as S
from ..sources.index import IndexTable
from .base import REQUESTS, WITH, query, ts

NOW = "1996-06-01 00:00:00"


@query("select page_id, url, html from pages")
def s1_read_pages(t):
    return S.read_pages(t.spark, f"{t.sf_dir}/pages.parquet", schema=t.pages.schema)


# Each page in a charset that its bytes alone must tell: its first words stand for the page's language.
WORDS_IN = {"windows-1252": "Voilà un été très chaud à la forêt, où les garçons français mangent des crêpes", "windows-1251": "Съешь же ещё этих мягких французских булок, да выпей чаю", "koi8-r": "Привет, как дела сегодня вечером, что нового", "iso-8859-2": "Zażółć gęślą jaźń, proszę bardzo, łódź płynie po rzece",
            "iso-8859-7": "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί", "utf-8": "Größe, ñandú, été", "utf-16le": "Größe und Maß", "utf-16be": "Größe und Maß"}
KINDS_OF_BYTES = list(WORDS_IN)


@query(f"""with k as (select page_id, url, page_id % 8 as way, ([{', '.join(map(repr, KINDS_OF_BYTES))}])[page_id % 8 + 1] as charset from pages) select page_id, charset, '<p>' || ([{', '.join(map(repr, WORDS_IN.values()))}])[way + 1] || ' ' || page_id || '</p>' as text,
    case when way % 3 = 1 then 'text/plain' when regexp_matches(url, '[.](html?|php|aspx?)$') then 'text/html' else 'text/plain' end as mime from k""")
def s2_decode_content(t):
    way = F.col("page_id") % 8
    content = None
    for k, (name, words) in enumerate(WORDS_IN.items()):
        raw = F.concat(F.lit(bytearray(f"<p>{words} ".encode(name))), F.expr("encode(concat(page_id, '</p>'), 'UTF-8')"))
        if name.startswith("utf-16"):
            raw = F.expr(f"encode(concat('<p>{words} ', page_id, '</p>'), '{name.upper()}')")
        content = F.when(way == k, raw) if content is None else content.when(way == k, raw)
    rows = S.decode_content(t.pages.select("page_id", "url", content.alias("content")))
    mime = S.mime_type(F.when(way % 3 == 1, "Text/Plain; x"), F.col("url"), F.col("content"))
    return rows.select("page_id", "charset", "text", mime.alias("mime"))


@query("select source as site_name, cast(count(*) as bigint) as n_docs, cast(sum(length(text)) as bigint) as n_chars from documents group by source")
def s3_read_json_docs(t):
    folder = S.new_folder(t.spark, "json-docs")
    t.documents.select("text", F.col("source").alias("site_name"), F.array("lang").alias("tags")).write.json(folder)
    return S.read_json_docs(t.spark, folder).groupBy("site_name").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query("select lang, source, doc_id // 1000 as part, '[' || string_agg('{\"doc_id\":' || doc_id || ',\"n_chars\":' || n_chars || '}', ',' order by doc_id) || ']' as docs from documents group by all")
def s4_docs_to_json(t):
    return S.docs_to_json(t.documents, ["lang", "source"], ["doc_id", "n_chars"], F.expr("doc_id div 1000"))


@query("""with i as (select l_orderkey * 10 + l_linenumber as key, l_shipdate as version, l_partkey as value, 0 as u from lineitem), n as (select o_orderkey * 10 + 1 as key, o_orderdate + interval 60 day as version, o_custkey as value, 1 as u from orders)
    select key, version, value from (select *, row_number() over (partition by key order by version desc, u desc, value desc) k from (select * from i union all select * from n)) where k = 1""")
def s5_upsert_index(t):
    index = t.lineitem.selectExpr("l_orderkey * 10 + l_linenumber as key", "cast(l_shipdate as timestamp) as version", "l_partkey as value")
    updates = t.orders.selectExpr("o_orderkey * 10 + 1 as key", "cast(o_orderdate + interval 60 day as timestamp) as version", "o_custkey as value")
    table = IndexTable.create(index, S.new_folder(t.spark, "index"), "key", "version", buckets=16)
    table.upsert(updates)
    return table.read()


@query("select doc_id, source from documents where not (source = 'src3')")
def s6_delete_by_query(t):
    docs = t.documents.select("doc_id", "source", F.lit(0).alias("version"))
    table = IndexTable.create(docs, S.new_folder(t.spark, "index"), "doc_id", "version", buckets=16)
    table.delete_where(F.col("source") == "src3")
    return table.read().select("doc_id", "source")


@query("select doc_id, source from documents where lang = 'en'")
def s7_select_fields(t):
    return t.documents.filter("lang = 'en'").select("doc_id", "source")


@query("""select distinct case when strpos(v, ' ') = 0 then v else split_part(v, ' ', 2) end as address from (
    select case when c_custkey % 3 = 0 then '# note' when c_custkey % 3 = 1 then 'host' || (c_custkey % 40) || '.example' else '0.0.0.0 host' || (c_custkey % 50) || '.example' end as v from customer)
    where v not like '#%' and case when strpos(v, ' ') = 0 then v else split_part(v, ' ', 2) end not in (select 'host' || s_nationkey || '.example' from supplier)""")
def s8_read_blocklist(t):
    lines = t.customer.selectExpr("case when c_custkey % 3 = 0 then '# note' when c_custkey % 3 = 1 then concat('host', c_custkey % 40, '.example') else concat('0.0.0.0 host', c_custkey % 50, '.example') end as value")
    return S.blocklist(lines, t.supplier.selectExpr("concat('host', s_nationkey, '.example') as address").distinct())


@query("select cast(o_orderkey as int) as key_i, cast(o_totalprice as double) as price_d, o_orderstatus as status_s from orders")
def s9_cast_by_suffix(t):
    return S.cast_by_suffix(t.orders.select(F.col("o_orderkey").cast("string").alias("key_i"), F.col("o_totalprice").cast("string").alias("price_d"), F.col("o_orderstatus").alias("status_s")))


ASKS = {"job": "o_orderkey", "phrase": "o_orderpriority", "tag": "o_custkey % 40", "at": "o_orderdate + make_interval(0, 0, 0, 0, 0, cast(o_orderkey % 1440 as int))", "privileged": "o_totalprice > 150000", "crawl": "o_orderkey % 5 = 0"}


@query("""with recursive o as (select o_orderkey as job, o_orderpriority as phrase, o_custkey % 40 as tag, o_orderdate + to_minutes(o_orderkey % 1440) as asked, o_totalprice > 150000 as privileged, o_orderkey % 5 = 0 as crawl, o_orderstatus from orders),
    e as (select *, row_number() over (partition by phrase, tag order by moment, new, job) as k from (select phrase, tag, asked as moment, 1 as new, privileged, crawl, job, null as status from o
        union all select phrase, tag, asked + interval 1 day, 0, false, crawl, 0, case o_orderstatus when 'O' then 'finished' when 'P' then 'working' else 'failed' end from o)),
    f as (select phrase, tag, cast(0 as bigint) as k, cast(0 as bigint) as job, false as taken, false as open0, false as open1, cast(null as timestamp) as done0, cast(null as timestamp) as done1, cast(null as timestamp) as last from (select distinct phrase, tag from o)
        union all select phrase, tag, k, job, taken, open0 or ((taken or st = 'working') and not crawl), open1 or ((taken or st = 'working') and crawl), case when st = 'finished' and not crawl then moment else done0 end, case when st = 'finished' and crawl then moment else done1 end,
            case when taken or new = 0 then moment else last end from (select e.*, coalesce(e.status, '') as st, open0, open1, done0, done1, last, new = 1 and case when privileged then not (case when crawl then open1 else open0 end) and coalesce(case when crawl then done1 else done0 end < moment - interval 5 day, true)
                else coalesce(last < moment - interval 30 day, true) end as taken from f join e on e.phrase = f.phrase and e.tag = f.tag and e.k = f.k + 1))
    select job from f where taken""")
def f1_dedupe_jobs(t):
    rows = t.orders.selectExpr(*[f"{e} as {c}" for c, e in ASKS.items()], "o_orderstatus")
    new = rows.selectExpr("job", "phrase", "tag", "at as asked", "privileged", "crawl as is_crawl")
    old = rows.selectExpr("phrase", "tag", "at + interval 1 day as changed", "case o_orderstatus when 'O' then 'finished' when 'P' then 'working' else 'failed' end as status", "crawl as is_crawl")
    return R.dedupe_jobs(new, old, ["phrase", "tag"], 5 * 1440, 30 * 1440, "job").select("job")


@query(WITH + """, j as (select o_orderkey as job, o_custkey % 25 as tag, o_custkey % (select max(s_suppkey) from supplier) + 1 as site from orders)
    select distinct job, x.site, s_nationkey as nation from (select job, site from j union all select job, l.site from j join links l on l.tag = j.tag and l.level >= 50) x join supplier on s_suppkey = x.site""")
def f2_expand_job(t):
    top = t.supplier.agg(F.max("s_suppkey").alias("m"))
    jobs = t.orders.crossJoin(F.broadcast(top)).selectExpr("o_orderkey as job", "array(cast(o_custkey % 25 as int)) as tags", "array(o_custkey % m + 1) as sites")
    return R.expand_job(jobs, t.supplier.selectExpr("s_suppkey as site", "s_nationkey as nation"), t.links, 50)


@query(WITH + """, j as (select o_orderkey as job, o_custkey % 25 as tag, o_custkey % (select max(s_suppkey) from supplier) + 1 as site from orders), x as (select job, site from j union select job, l.site from j join links l on l.tag = j.tag and l.level >= 50)
    select job, count(*) filter (where s_acctbal >= 2000) as websites, count(*) filter (where s_acctbal < 2000) as subreddits from x join supplier on s_suppkey = x.site group by job""")
def f2_job_counts(t):
    top = t.supplier.agg(F.max("s_suppkey").alias("m"))
    jobs = t.orders.crossJoin(F.broadcast(top)).selectExpr("o_orderkey as job", "array(cast(o_custkey % 25 as int)) as tags", "array(o_custkey % m + 1) as sites")
    return R.job_counts(jobs, t.supplier.selectExpr("s_suppkey as site", "case when s_acctbal < 2000 then 'reddit' when s_acctbal >= 2000 then 'web' end as kind"), t.links, 50)


@query("select conv_id, turn, 'https://' || role || '.example/find?q=' || replace(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ', '+') || '&turn=' || turn as url from conversations where regexp_matches(text, '[A-Za-z]')")
def f3_search_url(t):
    words = F.split(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")
    pointer = F.concat(F.lit("https://"), "role", F.lit(".example/find?q=twenty+cats&turn="), "turn")
    return t.conversations.filter(F.col("text").rlike("[A-Za-z]")).select("conv_id", "turn", U.search_url(pointer, words).alias("url"))


@query(WITH + ", b as (select * from requests where status = 'waiting' order by is_search desc, id limit 50) select b.id, b.site, b.is_search, list_sort(list(distinct l.tag)) as tags from b left join links l on l.site = b.site group by all")
def f4_next_batch(t):
    return R.next_batch(t.requests, t.links)


@query(WITH + "select job, case when max(case when status = 'committed' then 1 else 0 end) = 1 then list_sort(list(distinct target) filter (where status = 'committed')) else list_sort(list(distinct site)) end as tags from requests group by job")
def f5_effective_tags(t):
    rows = t.requests.groupBy("job").agg(F.array_sort(F.collect_set(F.when(F.col("status") == "committed", F.col("target")))).alias("own"), F.array_sort(F.collect_set("site")).alias("of_site"))
    return rows.select("job", R.effective_tags(F.col("own"), F.col("of_site")).alias("tags"))


@query(WITH + "select case when lead_count = 3 then 'crawl' when is_search then 'search' else 'leaf' end as route, count(*) as n from requests group by 1")
def f6_route(t):
    return t.requests.select(R.route(F.col("lead_count") == 3, F.col("is_search")).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query(WITH + "select id, case when is_search then lead_count + 1 else 0 end as lead_count, 'waiting' as status from requests where not is_search or lead_count < 2")
def f7_outlinks(t):
    return R.outlinks(t.requests.select("id", "is_search", "lead_count")).select("id", "lead_count", "status")


# `d` has page_id, n, head, path and tail: dot segments go one by one, the first that there is, until none is left.
DOTS = """dots as (select page_id, n, head, path, tail, 0 as round from d union all select page_id, n, head, case when regexp_matches(path, '/[.](/|$)') then regexp_replace(path, '/[.](/|$)', '/') when regexp_matches(path, '^/[.][.](/|$)') then regexp_replace(path, '^/[.][.](/|$)', '/')
    else regexp_replace(path, '/[^/]*/[.][.](/|$)', '/') end, tail, round + 1 from dots where regexp_matches(path, '/[.][.]?(/|$)')), flat as (select page_id, n, arg_max(head || path || tail, round) as url from dots group by page_id, n)"""
# References made of the links on a page, in the ways that pages write them.
WRITTEN = ["h", "'.' || h || '/.'", "'..' || h || '/../x'", "'../..' || h || '/'", "'?q=' || page_id", "'#x'", "'//other.example/a/..' || h", "'g;x=1/../y?a=../b'", "'/a/./b/..' || h || '#..'", "''"]


@query(f"""with recursive h as (select page_id, url, unnest(regexp_extract_all(html, 'href="(/[A-Za-z]+)"', 1)) as h from pages), w as (select page_id, regexp_extract(url, '^([a-z]+:)', 1) as scheme, regexp_extract(url, '^[a-z]+:(//[^/?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path,
    regexp_extract(url, '([?][^#]*)', 1) as asked, h, unnest([{', '.join(WRITTEN)}]) as href, unnest(generate_series(1, {len(WRITTEN)})) as way from h), k as (select *, row_number() over (partition by page_id, way order by h) as nth, regexp_extract(href, '^([^?#]*)', 1) as p, regexp_extract(href, '([?][^#]*)', 1) as q, regexp_extract(href, '(#.*)$', 1) as f from w),
    d as (select page_id, way || '-' || nth as n, scheme || case when way = 7 then '//other.example' else host end as head, case when way = 7 then regexp_replace(p, '^//other.example', '') when p = '' then path when p[1] = '/' then p else regexp_replace(path, '[^/]*$', '') || p end as path, case when p = '' and q = '' then asked else q end || f as tail from k),
    {DOTS} select page_id, n, url as link from flat""")
def f8_resolve_url(t):
    hrefs = t.pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="(/[A-Za-z]+)"'), F.lit(1))).alias("h"))
    ways = hrefs.select("page_id", "url", "h", F.posexplode(F.expr(f"array({', '.join(WRITTEN)})")).alias("way", "href"))
    nth = F.row_number().over(Window.partitionBy("page_id", "way").orderBy("h"))
    return ways.select("page_id", F.concat_ws("-", F.col("way") + 1, nth).alias("n"), U.resolve_url(F.col("url"), F.col("href")).alias("link"))


# Addresses of pages, written as they are not in normal form.
MANGLED = """case page_id % 7 when 0 then url || '?#top' when 1 then replace(replace(url, 'https://', 'HTTPS://Me@A.'), 'http://', 'HTTP://a.B') when 2 then 'http://A.example:80' when 3 then 'https://a.example:443/x/../%7ey/./%2f%c3%A9%?&&b=%41&&c=1?d=2&#f'
    when 4 then 'https://a.example:8443/a/b/../../../c/.&x=' || page_id when 5 then 'no address ' || page_id else '  ' || url || '??a=1??' end"""


@query(f"""with recursive m as (select page_id, trim({MANGLED}) as x from pages), v as (select page_id, lower(regexp_extract(x, '^([A-Za-z]+)://', 1)) as scheme, regexp_extract(x, '^[A-Za-z]+://([^/?#&]+)', 1) as site, regexp_extract(x, '^[A-Za-z]+://[^/?#&]+([^?#&]*)', 1) as path, regexp_extract(regexp_replace(x, '#.*$', ''), '([?&].*)$', 1) as asked from m where regexp_matches(x, '^[A-Za-z]+://[^ ]+$')),
    e as (select page_id, 0 as n, scheme || '://' || regexp_extract(site, '^(.*@)?', 0) || regexp_replace(lower(regexp_replace(site, '^.*@', '')), case scheme when 'http' then ':80$' else ':443$' end, '') as head, case when path = '' then '/' else path end as path, list_filter(regexp_split_to_array(asked, '[?&]+'), lambda p: p <> '') as ps from v),
    x as (select page_id, n, head, path, case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end as tail from e),
    d as (select page_id, n, head, {{0}} as path, {{1}} as tail from x), {DOTS} select pages.page_id, flat.url from pages left join flat on flat.page_id = pages.page_id""".format(*[
        f"array_to_string(list_transform(string_split({c}, '%'), lambda p, i: case when i = 1 then p when not regexp_matches(p, '^[0-9A-Fa-f]{{2}}') then '%' || p when regexp_matches(p, '^(2[dDeE]|3[0-9]|4[1-9a-fA-F]|5[0-9aAfF]|6[1-9a-fA-F]|7[0-9aAeE])') then chr(cast('0x' || p[1:2] as int)) || p[3:] else '%' || upper(p[1:2]) || p[3:] end), '')" for c in ("path", "tail")]))
def f9_normalize_url(t):
    return t.pages.select("page_id", U.normalize_url(F.expr(MANGLED)).alias("url"))


LINK = """case l_orderkey % 14 when 0 then 'https://site' || l_suppkey || '.example/' || l_partkey when 1 then 'https://a.example/' || l_partkey || '.JPG?w=1' when 2 then 'http://10.0.0.' || l_linenumber || '/x' when 3 then 'https://b.example/x/y/x/y/x'
    when 4 then 'http://c.example/?id=' || l_partkey when 5 then 'ftp://c.example/' when 6 then 'https://d.example/' || l_partkey || '.pdf' when 7 then 'https://10.example.com/a' when 8 then 'http://172.' || (l_linenumber * 6) || '.0.1:80/'
    when 9 then 'http://localhost/' when 10 then 'https://e.example/' || repeat('abc/', cast(l_quantity as int) // 20) when 11 then 'https://f.example/x.flv' when 12 then 'https://g.example/' || repeat('long', cast(l_quantity as int) * 6) else 'https://www.c.example/' || l_partkey end"""
PAGE = "case l_linenumber % 3 when 0 then 'https://c.example/' || l_partkey when 1 then 'https://a.c.example/' else 'https://www.c.example/' || l_partkey || '#top' end"


@query(
    f"""with u as (select l_orderkey, l_linenumber, {LINK} as url, {PAGE} as page from lineitem),
    v as (select *, list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda p: p <> '') as parts from u)
    select l_orderkey, l_linenumber, url from v where not regexp_matches(url, '^(file|ftp|mailto):') and not regexp_matches(url, '(?i)[.]({U.SUFFIXES})([?]|&|$)') and not regexp_matches(url, '{U.PRIVATE.replace(chr(92), chr(92))}') and length(url) <= 1024
    and len(list_filter(parts, lambda p: len(list_filter(parts, lambda q: q = p)) >= 3)) = 0 and regexp_extract(regexp_extract(url, '://([^/:?#]+)', 1), '([^.]+[.][^.]+)$', 1) = 'c.example' and url <> regexp_replace(page, '#.*$', '')"""
)
def f10_filter_urls(t):
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", f"{LINK.replace('//', 'SLASHES').replace('int) SLASHES 20', 'int) div 20').replace('SLASHES', '//')} as url", f"{PAGE} as source_url")
    return U.filter_urls(rows).select("l_orderkey", "l_linenumber", "url")


@query("""with index as (select l_suppkey % 7 || '/' || l_partkey as url, l_shipdate as date_post, l_shipdate + to_hours(cast(l_quantity as int) * 24 * 10) as date_retr from lineitem where l_returnflag = 'R')
    select distinct l_suppkey % 7 || '/' || l_partkey as url from lineitem where l_suppkey % 7 || '/' || l_partkey not in (select url from index where date_post < timestamp '1996-06-01' - interval 365 day or date_retr >= timestamp '1996-06-01' - interval 12 hour)""")
def f11_skip_indexed(t):
    url = "concat(l_suppkey % 7, '/', l_partkey) as url"
    index = t.lineitem.filter("l_returnflag = 'R'").selectExpr(url, "l_shipdate as date_post", "l_shipdate + make_interval(0, 0, 0, 0, cast(l_quantity as int) * 240) as date_retr")
    return R.skip_indexed(t.lineitem.selectExpr(url).distinct(), index, ts(NOW))


@query(WITH + "select id, case when row_number() over (partition by job, target order by id, status) > 1 then 'cancelled' else status end as status from requests")
def f12_cancel_dupes_in_job(t):
    return R.cancel_dupes(t.requests, "job", "target", ["id", "status"]).select("id", "status")


@query(WITH + "select r.id, case when j.status = 'terminated' and r.status <> 'committed' then 'cancelled' else r.status end as status from requests r left join jobs j on j.job = r.job")
def f13_cancel_for_terminated(t):
    return R.cancel_for_terminated(t.requests, t.jobs).select("id", "status")


@query(WITH + "select id, case when status in ('scheduled', 'ran') then 'waiting' else status end as status from requests")
def f14_requeue(t):
    return t.requests.select("id", R.requeue(F.col("status")).alias("status"))


KINDS = "case when l_suppkey % 4 = 0 then 'reddit' else 'web' end"
SITES = "case when l_suppkey % 4 = 0 then '/r/s' else 'www.s' end || l_suppkey"


@query(
    f"with r as (select l_orderkey as job, {SITES} as site, {KINDS} as kind, {REQUESTS['is_search']} as is_search, {REQUESTS['status']} as status, l_linenumber % 4 as lead_count from lineitem), "
    """j as (select o_orderkey as job, case o_orderstatus when 'O' then 'working' when 'F' then 'finished' else 'waiting' end as status, cast(9 as int) as websites, cast(3 as int) as subreddits, o_orderkey % 7 = 0 as is_crawl from orders),
    c as (select job, count(*) filter (where kind = 'web' and is_search and status = 'committed') sdw, count(*) filter (where kind = 'reddit' and is_search and status = 'committed') sdr, count(*) filter (where kind = 'web' and not is_search and status = 'committed') pdw,
    count(*) filter (where kind = 'reddit' and not is_search and status = 'committed') pdr, count(*) filter (where kind = 'web' and not is_search) pkw, count(*) filter (where kind = 'reddit' and not is_search) pkr, count(*) filter (where kind = 'web' and is_search) sw,
    count(*) filter (where kind = 'reddit' and is_search and status = 'ran') srr, count(*) filter (where is_search and status in ('waiting', 'scheduled', 'ran')) so, count(*) filter (where not is_search and status in ('waiting', 'scheduled', 'ran')) po,
    count(*) filter (where status = 'failed') fails, max(lead_count) as depth, count(distinct site) filter (where kind = 'web' and status in ('waiting', 'scheduled', 'ran', 'committed', 'failed')) known from r group by job),
    k as (select j.*, coalesce(sdw, 0) sdw, coalesce(sdr, 0) sdr, coalesce(pdw, 0) pdw, coalesce(pdr, 0) pdr, coalesce(pkw, 0) pkw, coalesce(pkr, 0) pkr, coalesce(sw, 0) sw, coalesce(srr, 0) srr, coalesce(so, 0) so, coalesce(po, 0) po, coalesce(fails, 0) fails, coalesce(depth, 0) depth, coalesce(known, 0) known
    from j left join c on c.job = j.job), y as (select *, case when sdw > 0 then pdw / sdw else 10.0 end yw, case when sdr > 0 then pdr / sdr else 7500.0 end yr from k),
    e as (select *, (websites - known) * 50 + 3 * so * yw + pkw + sw as ew, (subreddits - srr - sdr) * yr + srr * yr + pkr as er, (websites - known) * 50 + (subreddits - srr - sdr) * yr as future from y)
    select job, case when status = 'working' then 'working' else status end as phase, cast(sdw + sdr + so as bigint) as searches, cast(pdw + pdr + po as bigint) as crawls, cast(sdw + sdr + pdw + pdr as bigint) as commits, cast(so + po as bigint) as open, cast(fails as bigint) as fails, round(future, 6) as future,
    round(ew, 6) as estimate_web, round(er, 6) as estimate_reddit, round(case when status = 'finished' then 1.0 when is_crawl then (case when depth >= 1 then 420 else 0 end + case when depth >= 2 then 8820 else 0 end + case when depth >= 3 then 185220 else 0 end) / 9261
    when ew + er > 0 then (sdw + sdr + pdw + pdr) / (ew + er) else 0.0 end, 6) as proportion from e"""
)
def f15_progress(t):
    requests = t.lineitem.selectExpr("l_orderkey as job", f"{SITES} as site", f"{KINDS} as kind", f"{REQUESTS['is_search']} as is_search", f"{REQUESTS['status']} as status", "l_linenumber % 4 as lead_count")
    jobs = t.orders.selectExpr("o_orderkey as job", "case o_orderstatus when 'O' then 'working' when 'F' then 'finished' else 'waiting' end as status", "9 as websites", "3 as subreddits", "o_orderkey % 7 = 0 as is_crawl")
    rounded = [F.round(c, 6).alias(c) for c in ("future", "estimate_web", "estimate_reddit", "proportion")]
    return R.progress(requests, jobs).select("job", "phase", "searches", "crawls", "commits", "open", "fails", *rounded)


@query(WITH + "select job, site from requests group by job, site having bool_or(status in ('committed', 'failed')) and not bool_or(status in ('waiting', 'scheduled', 'ran'))")
def f16_sites_done(t):
    return R.sites_done(t.requests)


@query(WITH + "select distinct job, site from requests where status in ('waiting', 'scheduled', 'ran')")
def f16_sites_worked(t):
    return R.sites_worked(t.requests)


@query(WITH + "select job, id, rank from (select job, id, cast(row_number() over (partition by job order by changed desc, id) as int) as rank from requests) where rank <= 5")
def f17_last_targets(t):
    return R.last_targets(t.requests).select("job", "id", "rank")


@query(WITH + """select j.job, case when j.status <> 'working' then j.status when j.started < timestamp '1996-06-01' - interval 24 hour then 'terminated' when coalesce(n, 0) = 0 then 'finished' else 'working' end as status
    from jobs j left join (select job, count(*) n from requests where status in ('waiting', 'scheduled', 'ran') group by job) o on o.job = j.job""")
def f18_job_transitions(t):
    return R.job_transitions(t.jobs, t.requests, ts(NOW)).select("job", "status")


@query(WITH + "select id from requests where status in ('committed', 'failed') and changed > timestamp '1996-06-01' - interval 30 day")
def f19_expire(t):
    return t.requests.filter(F.col("status").isin("committed", "failed") & ~R.expired(F.col("changed"), ts(NOW), 30 * 86400)).select("id")


# Of all jobs, five in six may wait and work at once.
@query(WITH + """, w as (select job, row_number() over (order by asked, job) as rank from jobs where status = 'waiting')
    select job, rank from w where rank <= (select count(*) * 5 // 6 - count(*) filter (where status in ('waiting', 'working')) from jobs)""")
def f20_start_next(t):
    return R.start_next(t.jobs, F.expr("count(*) * 5 div 6")).select("job", "rank")


# Rules of a public suffix list, of each kind.
SUFFIX_RULES = ["com", "net", "org", "uk", "co.uk", "jp", "kyoto.jp", "ide.kyoto.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "com.au", "*.sch.uk"]
ENDS = ["", ".co.uk", ".com.au", ".ck", ".www.ck", ".kobe.jp", ".city.kobe.jp", ".ide.kyoto.jp", ".x.sch.uk", ".UK", ".unknown"]


@query(f"""with h as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || ([{', '.join(map(repr, ENDS))}])[page_id % {len(ENDS)} + 1]) as host from pages), r as (select unnest([{', '.join(map(repr, SUFFIX_RULES))}]) as rule),
    m as (select host, rule, len(string_split(ltrim(rule, '!'), '.')) - case when rule[1] = '!' then 1 else 0 end as size from (select distinct host from h), r where regexp_matches('.' || host, '[.]' || replace(replace(ltrim(rule, '!'), '.', '[.]'), '*', '[^.]+') || '$')),
    s as (select host, coalesce(max(size) filter (where rule[1] = '!'), max(size)) + 1 as take from m group by host)
    select page_id, h.host as host_key, array_to_string(list_slice(string_split(h.host, '.'), -least(coalesce(take, 2), len(string_split(h.host, '.'))), -1), '.') as domain_key from h left join s on s.host = h.host""")
def f21_queue_key(t):
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("page_id") % len(ENDS) + 1).cast("int"))
    rows = t.pages.select("page_id", F.concat(F.regexp_extract("url", "^([a-z]+://[^/:?#]+)", 1), end, F.lit("/x?y")).alias("url"))
    return U.queue_keys(rows, t.spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")).select("page_id", "host_key", "domain_key")


@query("""with p as (select id, queue, forced, case when forced then 0.0 else (row_number() over (partition by queue, forced order by id) - 1) * greatest(1.0, coalesce(d, 0.0)) end as start from (
    select l_orderkey * 10 + l_linenumber as id, 's' || l_suppkey || '.example' as queue, l_quantity = 50 as forced, case when l_suppkey % 3 = 0 then cast(l_suppkey % 40 as double) end as d from lineitem) where d is null or d <= 30 or forced)
    select id, start, row_number() over (order by forced desc, start, queue, id) as rank from p""")
def f22_politeness_plan(t):
    rows = t.lineitem.selectExpr("l_orderkey * 10 + l_linenumber as order", "concat('https://s', l_suppkey, '.example/', l_partkey) as url", "if(l_suppkey % 3 = 0, cast(l_suppkey % 40 as double), null) as robots_delay", "l_quantity = 50 as forced")
    return R.fetch_order(rows, force="forced").select(F.col("order").alias("id"), "start", "rank")


@query("""select id from (select p.id, p.is_search, coalesce(arg_max(r.allow, length(r.prefix)), true) as allowed from (select l_orderkey * 10 + l_linenumber as id, l_suppkey as host, '/' || (l_partkey % 7) || '/' || l_linenumber as path, l_linenumber = 1 as is_search from lineitem) p
    left join (select s_suppkey as host, '/' || (s_suppkey % 7) as prefix, false as allow from supplier union all select s_suppkey, '/' || (s_suppkey % 7) || '/3', true from supplier) r on r.host = p.host and starts_with(p.path, r.prefix) group by p.id, p.host, p.path, p.is_search) where allowed or is_search""")
def f23_robots_filter(t):
    rows = t.lineitem.selectExpr("l_orderkey * 10 + l_linenumber as url", "l_suppkey as url_host", "concat('/', l_partkey % 7, '/', l_linenumber) as path", "l_linenumber = 1 as is_search")
    rules = t.supplier.selectExpr("s_suppkey as host", "concat('/', s_suppkey % 7) as prefix", "false as allow").union(t.supplier.selectExpr("s_suppkey", "concat('/', s_suppkey % 7, '/3')", "true"))
    return R.robots_filter(rows, rules).select(F.col("url").alias("id"))


@query("select outcome, count(*) as n from (select case when w > 300 then 'dropped' when e = 'timeout' then 'timeout' when c = 304 then 'not modified' when c >= 300 and c < 400 then 'redirect' when c >= 200 and c < 300 then 'fetched' else 'error' end as outcome from (select value * 10 as w, case when event_id % 11 = 0 then 'timeout' end as e, 200 + (event_id % 4) * 101 + (event_id % 3) as c from events)) group by outcome")
def f24_fetch_outcome(t):
    log = t.events.selectExpr("value * 10 as w", "if(event_id % 11 = 0, 'timeout', null) as e", "200 + (event_id % 4) * 101 + (event_id % 3) as c")
    return log.select(R.fetch_outcome(F.col("c"), F.col("e"), F.col("w")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


FETCHES = {"code": "200 + (event_id % 4) * 101 + event_id % 3", "fetch_ms": "value * 10", "queued_ms": "event_id % 977", "bytes": "length(props)"}


@query(f"""with e as (select ts, value, {', '.join(f'{x} as {c}' for c, x in FETCHES.items())} from events) select date_trunc('minute', ts) as start, count(*) as n, round(avg(value), 6) as mean_value, round(sum(value), 4) as sum_value, count(*) filter (where code // 100 = 2) as n_2xx, count(*) filter (where code // 100 = 3) as n_3xx,
    count(*) filter (where code // 100 = 4) as n_4xx, count(*) filter (where code // 100 = 5) as n_5xx, round(count(*) / 60, 6) as per_second, round(avg(fetch_ms), 6) as mean_fetch_ms, round(avg(queued_ms), 6) as mean_queued_ms, cast(sum(bytes) as bigint) as sum_bytes, round(sum(bytes) / 60, 6) as bytes_per_second from e group by 1""")
def f25_fetch_metrics(t):
    return R.fetch_metrics(t.events.selectExpr("ts", "value", *[f"{x} as {c}" for c, x in FETCHES.items()]))


@query(f"select date_trunc('minute', ts) as start, cast({FETCHES['code']} as bigint) as code, count(*) as n from events group by all")
def f25_fetch_codes(t):
    return R.fetch_codes(t.events.selectExpr("ts", f"{FETCHES['code']} as code"))


@query(WITH + "select job, depth, cast(list_sum(list_transform(generate_series(0, depth), lambda d: pow(20, d))) as bigint) as estimate from (select job, max(lead_count) as depth from requests group by job)")
def f26_crawl_estimate(t):
    return R.crawl_estimate(t.requests)


@query("select conv_id, turn from (select conv_id, turn, length(text) % 7 - 3 as score, count(*) over (partition by conv_id) n from conversations) where score >= case when n >= 2 then floor(n / 2) else 0 end")
def f27_thread_prune(t):
    return R.thread_prune(t.conversations.select("conv_id", "turn", (F.length("text") % 7 - 3).alias("score")), "conv_id", "score", 2).select("conv_id", "turn")


@query("""with f as (select min(turn) as low, conv_id from conversations group by conv_id), c as (select c.*, f.low, turn = low as is_post, conv_id % 9 as sub from conversations c join f using (conv_id))
    select conv_id as thread, 'https://reddit.com/r/' || sub || '/' || conv_id || case when is_post then '' else '/' || turn end as url, case when is_post then 'self' else 'https://reddit.com/r/' || sub || '/' || conv_id end as real_doc, role as author,
    timestamp '2020-01-01' + to_days(cast(turn as int)) as date_post, '/r/s' || sub as site_name, case when sub = 0 then true end as adult_b, case when conv_id % 2 = 0 then ['own'] else ['site' || sub] end as tags,
    case when not is_post and turn % 5 = 3 then 'no text body' when not is_post and turn % 5 = 4 then 'no extractable text' end as failure_comment from c""")
def f28_thread_to_docs(t):
    rows = t.conversations.withColumn("low", F.min("turn").over(Window.partitionBy("conv_id"))).withColumn("sub", F.col("conv_id") % 9)
    rows = rows.withColumn("path", F.concat(F.lit("/r/"), "sub", F.lit("/"), "conv_id")).withColumn("created", ts("2020-01-01") + F.make_interval(days=F.col("turn").cast("int")))
    posts = rows.filter("turn = low").select(F.col("conv_id").alias("thread"), F.col("path").alias("permalink"), "text", F.col("role").alias("author"), "created", F.concat(F.lit("s"), "sub").alias("subreddit"), (F.col("sub") == 0).alias("adult"))
    said = F.when(F.col("turn") % 5 == 3, F.lit(None)).when(F.col("turn") % 5 == 4, "```x```").otherwise(F.col("text"))
    comments = rows.filter("turn > low").select(F.col("conv_id").alias("thread"), F.concat("path", F.lit("/"), "turn").alias("permalink"), said.alias("text"), F.col("role").alias("author"), "created")
    tags = rows.select(F.col("conv_id").alias("thread"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("own"))).alias("own"), F.array(F.concat(F.lit("site"), "sub")).alias("of_site")).distinct()
    return R.thread_to_docs(posts, comments, tags, ts(NOW), X.strip_markup).drop("text", "date_retr")


@query("select conv_id, turn from conversations where length(text) < 50 and length(regexp_replace(text, '[\\p{L}_]', '', 'g')) >= 0.65 * length(text)")
def f29_alpha_gate(t):
    return t.conversations.filter(X.mostly_symbols(F.col("text"))).select("conv_id", "turn")


@query("select conv_id, turn, 'T ' || turn || chr(10) || chr(10) || 'a link and bold' || chr(10) || 'quoted' || chr(10) || 'item' || chr(10) || 'img' as text from conversations")
def f30_strip_markup(t):
    marked = F.concat(F.lit("## T "), "turn", F.lit("\n\n\n\na [link](http://x.example/y) and **bold**  \n> quoted\n* item\n![img](z.png)\n```\ncode\n```"))
    return t.conversations.select("conv_id", "turn", X.strip_markup(marked).alias("text"))


@query("select source, cast(sum(n_chars % 13) as bigint) as lead_count from documents group by source")
def f31_lead_count(t):
    return R.lead_count(t.documents.select("source", (F.col("n_chars") % 13).alias("n_comments")), "source")


@query("""with r as (select s_nationkey as host, '/' || (s_suppkey % 5) as prefix, bool_or(s_acctbal > 5000) as allow from supplier group by all), m as (select distinct s_nationkey as host, '/' || i || '/map.xml' as path from supplier, (select unnest([0, 1, 2, 3, 4]) as i))
    select 'https://' || m.host || m.path as url, true as is_sitemap from m left join r on r.host = m.host and starts_with(m.path, r.prefix) group by m.host, m.path having coalesce(arg_max(r.allow, length(r.prefix)), true)""")
def f32_sitemap_links(t):
    robots = t.supplier.groupBy(F.col("s_nationkey").cast("string").alias("host"), F.concat(F.lit("/"), F.col("s_suppkey") % 5).alias("prefix")).agg(F.bool_or(F.col("s_acctbal") > 5000).alias("allow"))
    maps = t.supplier.select(F.col("s_nationkey").cast("string").alias("host"), F.array(*[F.lit(f"/{i}/map.xml") for i in range(5)]).alias("sitemaps"))
    return R.sitemap_links(maps, robots).select("url", "is_sitemap")


@query("select user_id, due from (select user_id, case o when 'fetched' then m + interval 7 day when 'fetch error' then m + interval 2 hour end as due from (select user_id, max(ts) m, arg_max(o, {'a': ts, 'b': o}) o from (select user_id, ts, case event_id % 3 when 0 then 'fetched' when 1 then 'fetch error' else 'error' end as o from events) group by user_id)) where due <= timestamp '2024-01-30'")
def f33_revisit_due(t):
    log = t.events.selectExpr("user_id as url", "ts", "case event_id % 3 when 0 then 'fetched' when 1 then 'fetch error' else 'error' end as outcome")
    return R.revisit_due(log, ts("2024-01-30")).select(F.col("url").alias("user_id"), "due")


@query(WITH + "select site, case when level >= 1000 then 'base' when level >= 50 then 'respected' when level >= 0 then 'community' else 'spam' end as label from links")
def t1_trust_label(t):
    return t.links.select("site", X.trust_label(F.col("level")).alias("label"))


@query(WITH + "select site, case when level >= 1000 then 1000 when level >= 50 then 50 when level >= 0 then 0 else -100000 end as threshold from links")
def t2_trust_threshold(t):
    return t.links.select("site", X.trust_threshold(X.trust_label(F.col("level"))).alias("threshold"))


@query(WITH + """, v as (select user_id, arg_min({'link': event_id % 20, 'up': event_type = 'click'}, {'a': ts, 'link': event_id % 20, 'up': event_type = 'click'}) as v from events where user_id % 3 <> 0 group by user_id)
    select site, cast(level + coalesce(d, 0) as bigint) as level from links left join (select v.link as link, sum(case when v.up then 1 else -1 end) as d from v group by 1) on link = site""")
def t3_apply_feedback(t):
    votes = t.events.selectExpr("user_id as user", "ts as at", "event_id % 20 as link", "event_type = 'click' as up")
    permissions = t.events.selectExpr("user_id as user", "user_id % 3 = 0 as used").distinct()
    return T.apply_feedback(t.links.select(F.col("site").alias("link"), "level"), votes, permissions).select(F.col("link").alias("site"), F.col("level").cast("long").alias("level"))


@query("select distinct user_id, true as used from events union select 100000 + c_custkey, c_custkey % 2 = 0 from customer")
def t3_use_permissions(t):
    votes = t.events.selectExpr("user_id as user", "ts as at", "event_id % 20 as link", "event_type = 'click' as up")
    permissions = t.events.selectExpr("user_id as user", "user_id % 3 = 0 as used").distinct().unionByName(t.customer.selectExpr("100000 + c_custkey as user", "c_custkey % 2 = 0 as used"))
    return T.use_permissions(permissions, votes).select(F.col("user").alias("user_id"), "used")


@query("""select user_id, site, link, level from (select user_id, site, link, level, row_number() over (partition by user_id order by site, link) k from (
    select u.user_id, s_nationkey as site, s_suppkey as link, cast(floor(s_acctbal / 5) as int) as level from (select distinct user_id, event_id % 25 as seen from events) u join supplier on s_nationkey = u.seen) l
    left join (select user_id as vu, event_id % 25 as vs, count(*) ns from events where event_type = 'click' group by 1, 2) a on vu = user_id and vs = site left join (select event_id % 40 as vl, count(*) nl from events group by 1) b on vl = link
    where level >= 50 and coalesce(ns, 0) < 2 and coalesce(nl, 0) < 300) where k = 1""")
def t4_feedback_candidates(t):
    seen = t.events.selectExpr("user_id as user", "event_id % 25 as site").distinct()
    links = t.supplier.selectExpr("cast(s_nationkey as long) as site", "s_suppkey as link", "cast(floor(s_acctbal / 5) as int) as level")
    votes = t.events.selectExpr("user_id as user", "event_id % 25 as site", "event_id % 40 as link", "event_type = 'click' as voted")
    found = T.feedback_candidates(seen, links, votes.filter("voted"), 50, all_votes=votes)
    return found.selectExpr("user as user_id", "cast(site as int) as site", "link", "level")


SUPPLIERS_AS_JOBS = "case when s_acctbal < 0 then 'waiting' when s_acctbal > 9600 then 'working' else 'done' end"


@query(f"select distinct user_id, false as used from events where user_id % 3 <> 0 and 40 - (select count(*) from supplier where {SUPPLIERS_AS_JOBS} in ('waiting', 'working')) >= 10")
def t5_guest_permissions(t):
    jobs = t.supplier.selectExpr(f"{SUPPLIERS_AS_JOBS} as status")
    return T.guest_permissions(t.events.selectExpr("user_id as user"), t.events.filter("user_id % 3 = 0").selectExpr("user_id as user").distinct(), jobs, capacity=40).withColumnRenamed("user", "user_id")


@query(WITH + "select case when level >= 1000 then 'base' when level >= 50 then 'respected' when level >= 0 then 'community' else 'spam' end as label, count(distinct site) as sites from links where tag = 3 group by 1")
def t6_sites_by_trust(t):
    return T.sites_by_trust(t.links, F.col("tag") == 3)


@query("""select c_custkey, cast((case when c_nationkey <> c_custkey % 25 then 1 else 0 end) + (case when c_mktsegment <> 'BUILDING' then 1 else 0 end) as int) as n_changed,
    case when c_nationkey = c_custkey % 9 then [] else [cast(c_nationkey as varchar)] end as added, case when c_nationkey = c_custkey % 9 then [] else [cast(c_custkey % 9 as varchar)] end as removed from customer""")
def t7_diff_suggestion(t):
    form = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    now = F.create_map(F.lit("nation"), (F.col("c_custkey") % 25).cast("string"), F.lit("segment"), F.lit("BUILDING"))
    added, removed = T.tag_changes(F.array(F.lit("all"), F.col("c_nationkey").cast("string")), F.array((F.col("c_custkey") % 9).cast("string"), F.lit("all")))
    return t.customer.select("c_custkey", F.size(T.changed_fields(form, now)).alias("n_changed"), added.alias("added"), removed.alias("removed"))


@query("""select c_custkey as suggestion, 'name' as field, c_mktsegment = 'BUILDING' as met from customer join supplier on s_suppkey = c_custkey union all
    select c_custkey, 'nation', cast(c_nationkey as varchar) = cast(s_nationkey as varchar) from customer join supplier on s_suppkey = c_custkey where c_custkey % 2 = 0""")
def t8_suggestion_relevance(t):
    s = t.customer.selectExpr("c_custkey as suggestion", "c_custkey as target", "c_mktsegment as name", "if(c_custkey % 2 = 0, cast(c_nationkey as string), null) as nation")
    return T.suggestion_relevance(s, t.supplier.selectExpr("s_suppkey as target", "'BUILDING' as name", "cast(s_nationkey as string) as nation"), ["name", "nation"])


@query(WITH + """, w as (select s_suppkey as site, s_suppkey % 25 as tag from supplier where s_acctbal > 3000)
    select cast(site as bigint) as site, cast(tag as int) as tag, level from links where site not in (select site from w) or tag = site % 25 union all select site, cast(tag as int), 50 from w where not exists (select 1 from links l where l.site = w.site and l.tag = w.tag)""")
def t9_apply_suggestion(t):
    wanted = t.supplier.filter("s_acctbal > 3000").selectExpr("s_suppkey as site", "array(cast(s_suppkey % 25 as int)) as tags")
    return T.apply_tag_suggestion(t.links, wanted)


@query("select user_id, count(*) as n from events where ts > timestamp '2024-01-20' - interval 24 hour and ts <= timestamp '2024-01-20' group by user_id having count(*) >= 2")
def t10_daily_quota(t):
    return T.over_quota(t.events, "user_id", "ts", ts("2024-01-20"), 2)


@query("select s_suppkey from supplier where exists (select 1 from customer where contains('www.s' || (c_custkey % 90 * 7) || '.example', right('s' || s_suppkey || '.example', 9 + cast(s_suppkey % 4 as int))))")
def t11_blocked_sites(t):
    sites = t.supplier.selectExpr("s_suppkey", "right(concat('s', s_suppkey, '.example'), 9 + cast(s_suppkey % 4 as int)) as site")
    return T.blocked_sites(sites, t.customer.selectExpr("concat('www.s', c_custkey % 90 * 7, '.example') as address")).select("s_suppkey")


@query("select page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www[.]', '') as site, case when page_id % 3 = 0 then 'words missing' when page_id % 3 = 1 then 'other site' end as problem from pages")
def t12_derive_site(t):
    site = T.derive_site(F.col("url"))
    pointer = F.when(F.col("page_id") % 3 == 0, "x").when(F.col("page_id") % 3 == 1, "https://other/?q=twenty+cats").otherwise(F.concat(F.lit("https://"), site, F.lit("/?q=twenty+cats")))
    return t.pages.select("page_id", site.alias("site"), T.pointer_problem(pointer, site).alias("problem"))


@query("select doc_id from documents where len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: x in ('trash', 'scum', 'stupid'))) > 0")
def t13_profanity_flag(t):
    words = t.spark.createDataFrame([("trash",), ("scum",), ("stupid",), ("the",)], "word string")
    return T.profane(t.documents, words, t.spark.createDataFrame([("the",)], "word string"), "doc_id")


@query("""select o_orderkey, o_custkey, rank, case o_orderstatus when 'O' then 'accepted' when 'F' then 'rejected' end as decision, case when o_orderstatus <> 'P' then cast(o_orderkey % 50 as varchar) end as moderator
    from (select *, cast(row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as int) as rank from orders) where rank <= 30""")
def t14_suggestion_list(t):
    rows = t.orders.selectExpr("o_orderkey as id", "o_custkey as user", "o_orderdate as changed", "map('phrase', o_orderpriority) as suggestion")
    decisions = t.orders.filter("o_orderstatus <> 'P'").selectExpr("o_orderkey as id", "if(o_orderstatus = 'O', 'accepted', 'rejected') as decision", "map('moderator', cast(o_orderkey % 50 as string)) as mod_activity")
    found = T.suggestion_list(rows, decisions, "user", 30)
    return found.select(F.col("id").alias("o_orderkey"), F.col("user").alias("o_custkey"), "rank", "decision", F.try_element_at("marks", F.lit("moderator")).alias("moderator"))


@query(WITH + "select o.job, cast(coalesce(n, 0) as bigint) as n from jobs o left join (select job, count(*) n from requests group by job) r on r.job = o.job")
def q22_page_counts(t):
    return Q.popularity(t.jobs, "job", t.requests, "job").select("job", "n")


@query("select n_nationkey, n_name, cast(coalesce(n, 0) as bigint) as n from nation left join (select s_nationkey, count(*) n from supplier group by 1) on s_nationkey = n_nationkey")
def q21_popularity_order(t):
    return Q.popularity(t.nation, "n_nationkey", t.supplier, "s_nationkey").select("n_nationkey", "n_name", "n")


@query("select distinct site from (select s_suppkey as site from supplier where s_suppkey in (1, 2, 3) union all select s_suppkey from supplier where s_nationkey in (4, 5))")
def q8_site_filter(t):
    return Q.site_filter(t.links, t.links, [1, 2, 3], [4, 5])


@query("select n_nationkey as id, n_name as name from nation where contains(n_name, '1') union all select c_custkey, c_name from customer where contains(c_name, '1') order by name, id limit 18 offset 1")
def q20_find_by_substring(t):
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    return Q.find_by_substring(names, "name", "1", 0, 18, ["name", "id"], skip=1)


@query("with e as (select user_id, event_type as phrase, event_id % 3 as level, max(ts) as last_at from events group by all) select user_id, phrase, level, case when phrase = 'view' then greatest(last_at, timestamp '2024-01-15') else last_at end as last_at from e union all select -1, 'old', 0, timestamp '2020-01-01'")
def q18_record_query(t):
    new = t.events.select("user_id", F.col("event_type").alias("phrase"), (F.col("event_id") % 3).alias("level"), F.col("ts").alias("last_at"))
    history = new.filter("phrase = 'view'").select("user_id", "phrase", "level").distinct().withColumn("last_at", ts("2024-01-15")).unionByName(t.spark.range(1).selectExpr("-1 as user_id", "'old' as phrase", "0 as level").withColumn("last_at", ts("2020-01-01")))
    return Q.record_query(history, new, ["user_id", "phrase", "level"], "last_at")


@query("select event_id, ts from events order by ts desc, event_id limit 30 offset 30")
def q19_history_page(t):
    return Q.page_of(t.events.select("event_id", "ts"), [F.desc("ts"), "event_id"], 1, 30)


@query("select o_orderkey, o_custkey from orders where o_custkey = -1 or o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def q16_visible_rules(t):
    users = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user"))
    return Q.visible_rules(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", users)


@query("select source, n from (select source, count(*) n from documents group by source order by n desc, source limit 10)")
def q14_top_terms(t):
    return Q.top_terms(t.documents, "source", 10)


@query("select source as tag, n from (select source, count(*) n from documents group by source order by n desc, source limit 1000) order by md5('s' || source) limit 1")
def a8_random_tag_context(t):
    return A.random_tag(t.documents.select(F.col("source").alias("tag")), "tag", "s")
