"""What parts of a page mean, by source type: skipped parts, document starts, authors, dates, links and settings.

A test is (place, kind, value). Places are the tag or an attribute of a node, of its parent ("parent.class") or of the
parent's parent ("grandparent.class"). Kinds: `is` (equal, whatever the case), `word` (stands between white space or the
ends), `has` (holds the text), `like` (matches the pattern), `there` (exists). A rule holds if all its tests do; a table
holds where one of its rules does. Value rules add what to take from the node: an attribute, "#attribute" for a fragment,
or "text" for all text below it. The same tables serve as Spark columns over nodes and inside the walk of a page.

Nodes have tag, attrs, parent_tag, parent_attrs, gp_attrs and render_text. A missing attribute fails every test.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = tuple[str, str, str]
Rule = tuple[Test, ...]


def words(place: str, *values: str) -> list[Rule]:
    return [((place, "word", v),) for v in values]


# Parts that no source needs, by tag, id and class.
GENERAL_SKIP: list[Rule] = [
    (("tag", "is", "nav"),), (("id", "has", "gdpr"),), (("id", "is", "copyright"),), (("id", "is", "preFooter"),), (("id", "is", "footer"),),
    *words("class", "date-header", "bigFooter", "button", "empty-tab", "modal", "modal-container", "fashion-box", "anon-user-signature", "sitepoll", "entry-comments", "newComments", "sidebar-article"),
    (("class", "like", "related"),), (("class", "like", "[Ff]ull[_-]*[Oo]verlay"),), (("class", "like", "[Ss]ite[_-]*[Ff]eatures"),),
    *words("class", "m-list-hub", "pageNavLinkGroup", "author-box", "widget-area"), (("class", "like", r"(?i)(notice|cookie)\S*(notice|cookie)"),), *words("class", "login-signup", "bbCodeBlock-expandLink", "quoteExpand"),
]
BLOG_SKIP: list[Rule] = [(("id", "is", "comments"),)]

# Nodes that begin a document.
STARTS: dict[str | None, list[Rule]] = {
    "blog": [(("tag", "is", "html"),)],
    "media": [(("tag", "is", "html"),)],
    "forums": [
        *words("class", "message", "thread_post", "comment"), (("typeof", "word", "sioct:BoardPost"),), (("tag", "is", "div"), ("class", "word", "reply")),
        (("tag", "is", "div"), ("class", "word", "topic-author")), (("class", "word", "post"), ("parent.id", "is", "postsContainer")),
    ],
    "searchpage": [
        (("itemtype", "is", "http://schema.org/CreativeWork"),), *words("class", "next", "post"), (("class", "has", "searchItem"),), (("class", "has", "next"),), *words("class", "search-result-indiv"),
        (("class", "like", "result-+article"),), (("class", "like", "result-+gallery"),), *words("class", "card", "listingResult"), (("class", "like", "SearchThumb"),), *words("class", "search-pagination"),
    ],
    None: [(("tag", "is", "body"),)],
}

# Where authors stand.
AUTHORS: dict[str, list[tuple[Rule, str]]] = {
    "forums": [
        ((("class", "word", "message"), ("data-author", "there", "")), "data-author"), ((("class", "word", "postauthor"),), "text"), ((("tag", "is", "a"), ("class", "word", "user-name")), "text"),
        ((("itemprop", "is", "author"),), "text"), ((("tag", "is", "a"), ("data-userid", "there", ""), ("grandparent.class", "word", "post-user")), "text"),
    ],
    "media": [((("class", "word", "contributor-name"),), "text")],
    "blog": [((("class", "word", "entry-author-name"),), "text"), ((("tag", "is", "a"), ("rel", "is", "author")), "text")],
}

# Where dates stand. Sources with "iso" are read as written there, others as people write dates.
_ITEM_DATE = (("class", "word", "item"), ("text", "like", "AM|PM"), ("grandparent.class", "word", "messageUserInfo"))
_MEDIA_DATES = [
    ((("itemprop", "is", "datePublished"), ("title", "like", r"^\s*[0-9]{4}-")), "iso title"), ((("itemprop", "is", "datePublished"),), "iso datetime"), ((("tag", "is", "time"), ("class", "like", "entry-date")), "iso datetime"),
    ((("tag", "is", "time"), ("class", "like", "publish-date")), "text"), ((("tag", "is", "div"), ("class", "like", "[Pp]ublished")), "text"), ((("class", "word", "article_top_dateline"),), "text"),
]
DATES: dict[str, list[tuple[Rule, str]]] = {
    "forums": [
        ((("class", "word", "dateline_timestamp"),), "text"), ((("tag", "is", "time"), ("class", "word", "u-dt"), ("title", "there", ""), ("parent.tag", "is", "a")), "title"), (_ITEM_DATE, "text"),
        ((("class", "word", "datePermalink"),), "text"), ((("class", "word", "post-time"),), "text"), ((("tag", "is", "span"), ("class", "word", "timestamp"), ("parent.class", "word", "post-subheader")), "text"),
        ((("class", "word", "post-when"),), "text"),
    ],
    "media": _MEDIA_DATES,
    "blog": _MEDIA_DATES,
}

# Where the address of a post or of a found page stands.
_LINK = ("tag", "is", "a")
PERMALINKS: dict[str, list[tuple[Rule, str]]] = {
    "forums": [
        ((_LINK, ("title", "like", "[pP]erma-?link")), "href"), ((_LINK, ("data-xf-init", "is", "share-tooltip")), "href"), ((_LINK, ("class", "like", "[pP]erma-?link")), "href"), ((_LINK, ("parent.class", "word", "post-time")), "href"),
        ((("class", "word", "post"), ("id", "there", ""), ("parent.id", "is", "postsContainer")), "#id"), ((("itemid", "there", ""), ("itemtype", "is", "https://schema.org/Question")), "itemid"), ((("class", "word", "comment"), ("id", "there", "")), "#id"),
    ],
    "searchpage": [
        ((_LINK, ("rel", "is", "bookmark"), ("parent.tag", "is", "h2")), "href"), ((_LINK, ("parent.class", "has", "searchItem")), "href"), ((_LINK, ("parent.class", "has", "title")), "href"),
        ((_LINK, ("class", "has", "next")), "href"), ((_LINK, ("class", "has", "article-link")), "href"), ((_LINK, ("rel", "has", "next")), "href"), ((_LINK, ("parent.class", "like", "result-+headline")), "href"),
        ((_LINK, ("class", "word", "card__link")), "href"), ((_LINK, ("class", "word", "search-pagination__page-item--next")), "href"), ((_LINK, ("parent.class", "like", "SearchThumb")), "href"),
        ((_LINK, ("text", "is", "(about)")), "href"), ((_LINK, ("text", "has", "Next")), "href"),
    ],
}
IS_SEARCH: list[Rule] = [(("class", "like", "next"),), (("class", "there", ""), ("rel", "like", "next"))]

# Metadata in parts that are skipped otherwise, the first to be found counts.
BURNED_AUTHORS: list[tuple[Rule, str]] = [
    ((("tag", "is", "span"), ("class", "word", "entry-author-name")), "text"),
    *[((("tag", "is", "meta"), (a, "is", v)), "content") for a, v in (("name", "author"), ("name", "parsely-author"), ("property", "author"), ("property", "article:author"))],
]
BURNED_DATE: Rule = (("tag", "is", "meta"), ("property", "is", "article:published_time"))
JSON_LD: Rule = (("tag", "is", "script"), ("type", "is", "application/ld+json"), ("text", "has", "schema.org"))

# Thresholds of paragraph classes where they differ from the defaults.
DEFAULTS = {"max_link_density": 0.2, "length_low": 60.0, "length_high": 130.0, "stop_low": 0.3, "stop_high": 0.32}
SETTINGS: dict[str, dict[str, float]] = {
    "forums": {"length_low": 40.0, "length_high": 40.0, "stop_low": 0.17, "stop_high": 0.22},
    "searchpage": {"length_low": 40.0, "length_high": 40.0, "stop_low": 0.17, "stop_high": 0.22},
    "media": {"max_link_density": 0.4, "length_high": 120.0},
    "blog": {},
}


REGISTERED: dict[str, tuple] = {}


def register_rules(source_type: str, starts: list[Rule] | None = None, authors: list[tuple[Rule, str]] | None = None, dates: list[tuple[Rule, str]] | None = None, permalinks: list[tuple[Rule, str]] | None = None, settings: dict[str, float] | None = None) -> None:
    """Adds a source type, or replaces what is given of one. Walks of pages that are made afterwards take it to workers."""
    for table, rules in ((STARTS, starts), (AUTHORS, authors), (DATES, dates), (PERMALINKS, permalinks), (SETTINGS, settings)):
        if rules is not None:
            table[source_type] = rules
    REGISTERED[source_type] = (starts, authors, dates, permalinks, settings)


def skip_rules(source_type: str | None) -> list[Rule]:
    return {"forums": GENERAL_SKIP, "media": GENERAL_SKIP, "blog": BLOG_SKIP + GENERAL_SKIP}.get(source_type, [])


def start_rules(source_type: str | None) -> list[Rule]:
    return STARTS.get(source_type, STARTS[None])


# ---- as columns over nodes


def _place(place: str) -> Column:
    whose, _, name = place.rpartition(".")
    if name == "tag":
        return F.col("parent_tag" if whose else "tag")
    if name == "text":
        return F.col("render_text")
    return F.col({"": "attrs", "parent": "parent_attrs", "grandparent": "gp_attrs"}[whose])[name]


def _test(test: Test) -> Column:
    place, kind, value = test
    c = _place(place)
    held = {"is": lambda: F.lower(c) == value.lower(), "word": lambda: F.array_contains(F.split(c, r"\s"), value), "has": lambda: c.contains(value), "like": lambda: c.rlike(value), "there": lambda: c.isNotNull()}[kind]()
    return F.coalesce(held, F.lit(False))


def holds(rule: Rule) -> Column:
    out = _test(rule[0])
    for t in rule[1:]:
        out = out & _test(t)
    return out


def any_holds(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | holds(r)
    return out


def value_of(rules: list[tuple[Rule, str]]) -> Column:
    """The value of the first rule that holds, or null."""
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(holds(r), F.concat(F.lit("#"), _place(v[1:])) if v.startswith("#") else _place(v.removeprefix("iso "))) for r, v in rules])


def by_source(tables: dict[str, list[tuple[Rule, str]]], source_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, rules in tables.items():
        out = F.when(source_type == name, value_of(rules)).otherwise(out)
    return out


def settings_for(df, source_type: str = "source_type"):
    """Adds the thresholds of each row's source type; a type that is not known has the defaults."""
    rows = [(s, *({**DEFAULTS, **own}[k] for k in DEFAULTS)) for s, own in SETTINGS.items()]
    table = df.sparkSession.createDataFrame(rows, f"_source string, {', '.join(f'_{k} double' for k in DEFAULTS)}")  # a row a source type
    out = df.join(F.broadcast(table), F.col(source_type) == F.col("_source"), "left")
    for k, v in DEFAULTS.items():
        out = out.withColumn(k, F.coalesce(f"_{k}", F.lit(v)))
    return out.drop("_source", *(f"_{k}" for k in DEFAULTS))


# ---- inside the walk of a page


def _value(node: dict, place: str) -> str | None:
    whose, _, name = place.rpartition(".")
    if name == "tag":
        return node["parent_tag" if whose else "tag"]
    if name == "text":
        return node["text"]()
    return (node[{"": "attrs", "parent": "parent_attrs", "grandparent": "gp_attrs"}[whose]] or {}).get(name)


def matches(node: dict, rule: Rule) -> bool:
    for place, kind, value in rule:
        got = _value(node, place)
        if got is None:
            return False
        if kind == "is" and got.lower() != value.lower() or kind == "word" and value not in re.split(r"\s", got) or kind == "has" and value not in got or kind == "like" and not re.search(value, got):
            return False
    return True


def found(node: dict, rules: list[tuple[Rule, str]]) -> tuple[str, str] | None:
    """The value of the first rule that holds, and where it was taken from."""
    for rule, v in rules:
        if matches(node, rule):
            got = _value(node, v.removeprefix("iso ").removeprefix("#"))
            if got is not None:
                return ("#" + got if v.startswith("#") else got), v
    return None


TEXT_RULES: list[Rule] = [r for tables in (AUTHORS, DATES, PERMALINKS) for rules in tables.values() for r, v in rules if v == "text" or any(t[0] == "text" for t in r)] + [r for r, v in BURNED_AUTHORS if v == "text"] + [JSON_LD]
