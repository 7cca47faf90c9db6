"""Pages to documents: paragraphs, their classes, document starts and metadata, all by the rules of the page's source type.

A page is walked twice inside its task, for paragraphs and for values; both walks number documents alike. Only values and
paragraphs are shuffled, by page.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import natural_date
from . import html as H
from . import rules as U
from .frontier import effective_tags

# The words that make a paragraph look like prose.
STOP_WORDS = """a about above across after afterwards again against all almost alone along already also although always am among amongst amount an and another any anyhow anyone anything anyway anywhere are around as at
back be became because become becomes becoming been before beforehand behind being below beside besides between beyond both bottom but by
call can cannot ca could did do does doing done down due during each eight either eleven else elsewhere empty enough even ever every everyone everything everywhere except
few fifteen fifty first five for former formerly forty four from front full further get give go had has have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred
i if in indeed into is it its itself keep last latter latterly least less just made make many may me meanwhile might mine more moreover most mostly move much must my myself
name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own
part per perhaps please put quite rather re really regarding same say see seem seemed seeming seems serious several she should show side since six sixty so some somehow someone something sometime sometimes somewhere still such
take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they third this those though three through throughout thru thus to together too top toward towards twelve twenty two
under until up unless upon us used using various very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why
will with within without would yet you your yours yourself yourselves amen course etc fortunately unfortunately got obviously overly pretty surprisingly thanks thank""".split()

VALUES = "page_id long, pre int, doc_seq int, key string, value string"


def _values_of(page: int, html: str | None, source_type: str | None) -> dict[str, list]:
    nodes = H.walked(html)
    _, docs = H.paragraphs_of(nodes, source_type)
    out: list[tuple[int, int, str, str]] = []
    burn, skipped_to, last = source_type in ("blog", "media"), -1, 0
    for row, doc in zip(nodes, docs, strict=True):
        if doc > last:  # a document is there even if it holds no value
            out.append((row[0], doc, "doc", ""))
            last = doc
        if H.skips(row, source_type) and row[0] > skipped_to:
            skipped_to = row[1]
        if row[2].startswith("#") or not last:
            continue
        node = H.as_node(nodes, row)
        if row[0] > skipped_to:
            for key, tables in (("author", U.AUTHORS), ("date", U.DATES), ("url", U.PERMALINKS)):
                got = U.found(node, tables.get(source_type, []))
                if got:
                    out.append((row[0], doc, f"{key}_iso" if got[1].startswith("iso") else key, got[0]))
            if source_type == "searchpage" and any(U.matches(node, r) for r in U.IS_SEARCH):
                out.append((row[0], doc, "is_search", "true"))
        elif burn:
            got = U.found(node, U.BURNED_AUTHORS)
            if got:
                out.append((row[0], last, "burned_span" if got[1] == "text" else "burned_meta", got[0]))
            if U.matches(node, U.BURNED_DATE) and "content" in row[4]:
                out.append((row[0], last, "burned_date", row[4]["content"]))
            if U.matches(node, U.JSON_LD):
                out.append((row[0], last, "json_ld", H.rendered(nodes, row)))
    return {"page_id": [page] * len(out), "pre": [o[0] for o in out], "doc_seq": [o[1] for o in out], "key": [o[2] for o in out], "value": [o[3] for o in out]}


def document_values(pages: DataFrame) -> DataFrame:
    """The values that nodes hold by the rules of the page's source type (page_id, html, source_type), in node order."""
    schema = pa.schema([("page_id", pa.int64()), ("pre", pa.int32()), ("doc_seq", pa.int32()), ("key", pa.string()), ("value", pa.string())])
    return pages.select("page_id", "html", "source_type").mapInArrow(H._per_page(_values_of, schema), VALUES)


def json_ld_author(script: Column) -> Column:
    """The author in a schema.org script, a name or an object with a name."""
    own = F.get_json_object(script, "$.author")
    return F.coalesce(F.get_json_object(script, "$.author.name"), F.get_json_object(script, "$.author[0].name"), F.when(~own.rlike(r"^\s*[\[{]"), own))


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]*>", ""))


def _first_date(texts: list[Column], read) -> Column:
    return F.get(F.filter(F.transform(F.array(*texts), read), lambda d: d.isNotNull()), F.lit(0))


def written_date(text: Column, now: Column) -> Column:
    """A date as people write it, counted back from `now` where it is relative; hyphens and 'Updated' are ignored."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(text, "Updated", ""), r"(AM|PM).*$", "$1"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(cleaned, "-", ""), r"\s+", " "))
    return _first_date([cleaned, bare], lambda x: F.coalesce(natural_date(x, now), X.relative_date(x, now)))


def iso_date(*texts: Column) -> Column:
    return _first_date(list(texts), lambda x: F.coalesce(x.try_cast("timestamp"), X.parse_date(x)))


def metadata(pages: DataFrame, now: Column) -> DataFrame:
    """page_id, doc_seq, author, date_post, url and is_search of each document that starts on a page. The last value
    counts; of values in skipped parts, an author span counts before a meta tag and that before schema.org, and the time
    of an article before schema.org's; they never replace a value by nothing."""
    v = F.when(F.col("value") != "", F.col("value"))
    last = {k: F.max_by(v, F.when((F.col("key") == k) & v.isNotNull(), F.col("pre"))).alias(f"v_{k}") for k in ("author", "date", "date_iso", "url", "is_search", "burned_span", "burned_meta", "burned_date", "json_ld")}
    date_at = [F.max(F.when((F.col("key") == k) & v.isNotNull(), F.col("pre"))).alias(f"at_{k}") for k in ("date", "date_iso")]
    rows = document_values(pages).groupBy("page_id", "doc_seq").agg(*last.values(), *date_at)
    meta = plain(F.col("v_burned_meta"))
    burned_author = F.coalesce(F.col("v_burned_span"), F.when(~meta.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), meta), json_ld_author(F.col("v_json_ld")))
    burned_date = iso_date(F.col("v_burned_date"), F.get_json_object("v_json_ld", "$.datePublished"))
    own = F.when(F.coalesce("at_date", F.lit(-1)) > F.coalesce("at_date_iso", F.lit(-1)), written_date(F.col("v_date"), now)).otherwise(iso_date(F.col("v_date_iso")))
    return rows.select("page_id", "doc_seq", F.trim(F.coalesce("v_author", burned_author)).alias("author"), F.coalesce(own, burned_date).alias("date_post"), F.col("v_url").alias("doc_url"), (F.col("v_is_search") == "true").alias("is_search"))


def classified(pages: DataFrame, stop_words: list[str] | None = None, headings: bool = False) -> DataFrame:
    """Paragraphs of pages with their class by the settings of the source type; headings are revised where asked for."""
    rows = H.segment_paragraphs(pages).join(pages.select("page_id", "source_type"), "page_id")
    rows = rows.withColumn("link_density", X.link_density(F.col("chars_in_links"), F.col("text"))).withColumn("stop_density", X.stopword_density(F.col("text"), stop_words or STOP_WORDS))
    rows = H.classify_basic(U.settings_for(rows), *(F.col(k) for k in U.DEFAULTS))
    if headings:
        rows = H.revise_headings(rows, ["page_id"], "para_seq", "short")
    rows = H.revise_near_good(H.revise_short(rows, ["page_id"], "para_seq"), ["page_id"], "para_seq")
    return H.revise_headings(rows, ["page_id"], "para_seq", "bad") if headings else rows


def fill_site_fields(docs: DataFrame, now: Column, whole_page: Column, page_url: str = "page_url") -> DataFrame:
    """url and real_doc: a document that is its page (media, blog) has the page's address and 'self', others have their
    own address, taken from the page where it is a fragment, and the page as real_doc; date_retr is `now`. With columns
    own_tags (of the request) and site_tags also tags: the request's if it has any, else the site's."""
    url = F.when(whole_page, F.col(page_url)).when(F.col("doc_url").startswith("#"), F.concat(F.col(page_url), "doc_url")).otherwise(F.col("doc_url"))
    filled = docs.withColumn("url", url).withColumn("real_doc", F.when(whole_page, "self").otherwise(F.col(page_url))).withColumn("date_retr", now)
    tagged = {"own_tags", "site_tags"} <= set(docs.columns)
    return filled.withColumn("tags", effective_tags(F.col("own_tags"), F.col("site_tags"))).drop("own_tags", "site_tags") if tagged else filled


def drop_empty_url(docs: DataFrame, whole_page: Column) -> DataFrame:
    """Documents without an address are left out, unless they are whole pages."""
    return docs.filter(whole_page | (F.coalesce("url", F.lit("")) != ""))


def extract_documents(pages: DataFrame, now: Column, stop_words: list[str] | None = None) -> DataFrame:
    """Documents of pages (page_id, url, html, source_type): page_id, doc_seq, source_type, url, real_doc, date_retr,
    author, date_post, is_search, text."""
    text = H.assemble_text(H.number_docs(classified(pages, stop_words)))
    docs = metadata(pages, now).join(text, ["page_id", "doc_seq"], "left").join(pages.select("page_id", F.col("url").alias("page_url"), "source_type"), "page_id")
    whole = F.coalesce(F.col("source_type").isin("media", "blog"), F.lit(False))
    docs = drop_empty_url(fill_site_fields(docs, now, whole), whole)
    return docs.select("page_id", "doc_seq", "source_type", "url", "real_doc", "date_retr", "author", "date_post", F.coalesce("is_search", F.lit(False)).alias("is_search"), F.coalesce("text", F.lit("")).alias("text"))
