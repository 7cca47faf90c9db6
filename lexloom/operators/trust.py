"""Trust levels, votes, permissions, suggestions and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, trust_label


def counted_votes(votes: DataFrame, permissions: DataFrame) -> DataFrame:
    """The first vote of each user who has a permission that is not used: user, link, up."""
    allowed = permissions.filter("not used").select("user").distinct()
    first = votes.groupBy("user").agg(F.min_by(F.struct("link", "up"), F.struct("at", "link", "up")).alias("v"))
    return first.join(allowed, "user", "left_semi").select("user", "v.link", "v.up")


def apply_feedback(links: DataFrame, votes: DataFrame, permissions: DataFrame) -> DataFrame:
    """Levels after the votes: +1 or -1 each, only with a permission that is not used, each used once.

    links: link, level; votes: link, user, up, at; permissions: user, used. Votes are summed by link before the join."""
    delta = counted_votes(votes, permissions).groupBy(F.col("link").alias("_l")).agg(F.sum(F.when(F.col("up"), 1).otherwise(-1)).alias("_d"))
    return links.join(delta, F.col("link") == F.col("_l"), "left").withColumn("level", F.col("level") + F.coalesce("_d", F.lit(0))).drop("_l", "_d")


def use_permissions(permissions: DataFrame, votes: DataFrame) -> DataFrame:
    """Permissions after the votes: those of voters are used."""
    voted = votes.select(F.col("user").alias("_u")).distinct()
    return permissions.join(voted, F.col("user") == F.col("_u"), "left").withColumn("used", F.col("used") | F.col("_u").isNotNull()).drop("_u")


def feedback_candidates(seen: DataFrame, links: DataFrame, votes: DataFrame, minimum: int, per_site: int = 2, per_link: int = 300, all_votes: DataFrame | None = None) -> DataFrame:
    """For each user the first link at the minimum level, of the sites seen, that is below both limits of votes: those of
    the user on the site, and those of all on the link (of `all_votes`, if given). seen: user, site; links: site, link, level.

    What bars a link holds for all users, and what bars a site for all its links, so users meet the first link of a site only."""
    by_site = votes.groupBy("user", "site").agg(F.count("*").alias("n_site"))
    by_link = (votes if all_votes is None else all_votes).groupBy("link").agg(F.count("*").alias("n_link"))
    open_links = links.filter(F.col("level") >= minimum).join(by_link, "link", "left").filter(F.coalesce("n_link", F.lit(0)) < per_link)
    first = open_links.groupBy("site").agg(F.min(F.struct("link", "level")).alias("_first"))
    open_sites = seen.join(by_site, ["user", "site"], "left").filter(F.coalesce("n_site", F.lit(0)) < per_site)
    found = open_sites.join(first, "site").groupBy("user").agg(F.min(F.struct("site", "_first.link", "_first.level")).alias("_v"))
    return found.select("user", "_v.site", "_v.link", "_v.level")


def guest_permissions(guests: DataFrame, permissions: DataFrame, jobs: DataFrame, capacity: int = 20, spare: int = 10) -> DataFrame:
    """Permissions for guests without one, while at least `spare` of the capacity is free."""
    free = jobs.agg((F.lit(capacity) - F.count_if(F.col("status").isin("waiting", "working"))).alias("free"))
    return guests.select("user").distinct().join(permissions, "user", "left_anti").crossJoin(F.broadcast(free)).filter(F.col("free") >= spare).select("user", F.lit(False).alias("used"))


def sites_by_trust(links: DataFrame, tag: Column) -> DataFrame:
    """label and how many sites of the tag have it. links: site, tag, level."""
    return links.filter(tag).groupBy(trust_label(F.col("level")).alias("label")).agg(F.count_distinct("site").alias("sites"))


def changed_fields(form: Column, current: Column) -> Column:
    """Entries of the form map that differ from the current one."""
    return F.map_filter(form, lambda k, v: ~v.eqNullSafe(F.try_element_at(current, k)))


def tag_changes(wanted: Column, present: Column) -> tuple[Column, Column]:
    return F.array_sort(F.array_except(wanted, present)), F.array_sort(F.array_except(present, wanted))


def suggestion_relevance(suggestions: DataFrame, targets: DataFrame, fields: list[str]) -> DataFrame:
    """target, field and whether the proposed value is in force already; fields not proposed (null) are left out."""
    rows = suggestions.alias("s").join(targets.alias("t"), "target")
    stack = ", ".join(f"'{f}', s.{f}, t.{f}" for f in fields)
    return rows.select("suggestion", F.expr(f"stack({len(fields)}, {stack}) as (field, proposed, present)")).filter("proposed is not null").select("suggestion", "field", F.col("proposed").eqNullSafe(F.col("present")).alias("met"))


def apply_tag_suggestion(links: DataFrame, wanted: DataFrame, level: int = 50) -> DataFrame:
    """Links after the wanted tag sets: missing added at `level`, surplus removed. wanted: site, tags."""
    want = wanted.select("site", F.explode("tags").alias("tag"))
    touched = wanted.select("site")
    kept = links.join(touched, "site", "left_anti").unionByName(links.join(want, ["site", "tag"], "left_semi"))
    return kept.unionByName(want.join(links, ["site", "tag"], "left_anti").select("site", "tag", F.lit(level).alias("level")))


def over_quota(rows: DataFrame, user: str, at: str, now: Column, most: int) -> DataFrame:
    """Users with `most` or more rows in the last 24 hours."""
    return rows.filter((F.col(at) > now - F.expr("interval 24 hours")) & (F.col(at) <= now)).groupBy(user).agg(F.count("*").alias("n")).filter(F.col("n") >= most)


def blocked_sites(sites: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Sites whose name stands anywhere in a blocked address.

    Every part of an address that is as long as some site's name is a key, so the join is on equality. Lengths of names
    are few (of hosts 253 at most); names longer than that are compared with whole addresses."""
    longest = 253
    lengths = sites.filter(F.length("site").between(1, longest)).select(F.length("site").alias("n")).distinct()
    starts = F.when(F.length("address") >= F.col("n"), F.sequence(F.lit(1), F.greatest(F.length("address") - F.col("n") + 1, F.lit(1))))
    parts = blocklist.select("address").distinct().crossJoin(F.broadcast(lengths)).select(F.explode(F.transform(starts, lambda i: F.substring(F.col("address"), i, F.col("n")))).alias("site"))
    return sites.join(parts.unionByName(blocklist.select(F.col("address").alias("site"))).distinct(), "site", "left_semi")


def derive_site(url: Column) -> Column:
    """Site name: the host without www., or /r/name for Reddit."""
    sub = F.regexp_extract(url, r"reddit\.com(/r/[A-Za-z0-9_]+)", 1)
    full = F.when(url.rlike("^[a-z]+://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.when(sub != "", sub).otherwise(F.regexp_replace(F.lower(F.regexp_extract(full, "^[a-z]+://([^/?#]+)", 1)), r"^www\.", ""))


def pointer_problem(pointer: Column, site: Column) -> Column:
    """Why a search pointer is not valid, or null."""
    return F.when(~pointer.contains("twenty") | ~pointer.contains("cats"), "words missing").when(~pointer.contains(site), "other site")


def profane(rows: DataFrame, words: DataFrame, white: DataFrame, key: str) -> DataFrame:
    """Keys of texts with a listed word that is not white-listed."""
    bad = words.join(white, "word", "left_anti")
    said = rows.select(key, F.explode(F.transform(tokens(F.col("text")), lambda t: F.lower(t))).alias("word"))
    return said.join(bad, "word", "left_semi").select(key).distinct()


def suggestion_list(suggestions: DataFrame, decisions: DataFrame, user: str, n: int) -> DataFrame:
    """The newest `n` suggestions of each user, with the decision (null while there is none) and, in `marks`, what was
    suggested and what moderators noted. suggestions: id, user, changed, suggestion; decisions: id, decision, mod_activity."""
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("changed"), "id"))
    rows = suggestions.withColumn("rank", rank).filter(F.col("rank") <= n).join(decisions, "id", "left")
    return rows.withColumn("marks", F.map_concat("suggestion", F.coalesce("mod_activity", F.create_map().cast("map<string,string>"))))
