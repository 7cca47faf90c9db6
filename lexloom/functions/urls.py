"""URL functions: search addresses, resolving, normalising, filtering, and queue keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of files that hold no text, and patterns of addresses that are not crawled.
SUFFIXES = "apk|deb|cab|iso|gif|jpg|png|svg|ico|css|sit|eps|wmf|rar|tar|jar|zip|gz|bz2|rpm|tgz|mov|exe|jpeg|jpe|bmp|js|mpg|mp3|mp4|m4a|ogv|kml|wmv|swf|flv|mkv|m4v|webm|ra|wma|wav|avi|xspf|m3u"
BYTE = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
PRIVATE = rf"^https?://(localhost|\[::1\]|(127|10)([.]{BYTE}){{3}}|192[.]168([.]{BYTE}){{2}}|172[.](1[6789]|2[0-9]|3[01])([.]{BYTE}){{2}})(:[0-9]+)?(/|$)"
# The parts of an address: scheme, authority, path, query, fragment.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"
QUERY = r"^[^#?]*\?"


def search_url(pointer: Column, words: Column) -> Column:
    """Fills the words into a pointer that shows where two words go: `...twenty<separator>cats...`; else null."""
    part = lambda k: F.regexp_extract(pointer, "^(.*?)twenty(.*?)cats(.*)$", k)
    joined = F.aggregate(words, F.lit(None).cast("string"), lambda s, w: F.coalesce(F.concat(s, part(2), w), w))
    return F.when(pointer.rlike("twenty.*cats"), F.concat(part(1), joined, part(3)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


# Second-level suffixes under which domains are registered, for registered_domain; queue_keys takes a table of rules.
PUBLIC_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "com.pl", "co.in", "co.kr", "co.za", "com.ar")


def registered_domain(url: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    """The last two labels of the host, or three where the last two are a public suffix; an IP address as it is."""
    two, three = F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host(url), r"([^.]+\.[^.]+\.[^.]+)$", 1)
    return F.when(host(url).rlike(r"^[0-9.]+$"), host(url)).when(two.isin(*suffixes) & (three != ""), three).otherwise(two)


def domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and domain, for each distinct host: the public suffix that the rules say, and one label more.

    rules: rule, as in the public suffix list: `co.uk`, `*.ck` (any label below ck) or `!www.ck` (an exception from that,
    which wins); else the longest rule counts, and `*` where none matches. Each host gives one row for each of its ends,
    which meets the rules in an equality join, so the list may be of any size. An IP address is its own domain, and so
    is a host that is a public suffix. Nulls and empty hosts have none."""
    known = hosts.select("host").filter("host is not null and host != ''").distinct()
    labels = F.split("host", r"\.")
    ends = known.filter(~F.col("host").rlike(r"^[0-9.]+$|^\[")).select("host", F.size(labels).alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))).alias("k", "end"))
    table = rules.select(F.lower(F.trim("rule")).alias("rule")).distinct().select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("end"), F.col("rule").startswith("!").alias("exception"), F.col("rule").startswith("*.").alias("any_label"))
    length = F.col("n") - F.col("k") + F.when(F.col("exception"), -1).when(F.col("any_label"), 1).otherwise(0)  # labels of the suffix
    found = ends.join(table, "end").filter(length <= F.col("n")).groupBy("host").agg(F.max(F.when(F.col("exception"), length)).alias("except"), F.max(length).alias("most"))
    rows = known.join(found, "host", "left").withColumn("take", F.coalesce("except", "most", F.lit(1)) + 1)
    whole = F.col("host").rlike(r"^[0-9.]+$|^\[") | (F.size(labels) < F.col("take"))
    return rows.select("host", F.when(whole, F.col("host")).otherwise(F.array_join(F.slice(labels, F.size(labels) - F.col("take") + 1, F.col("take")), ".")).alias("domain"))


def queue_keys(frontier: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The frontier with host_key and domain_key; what has no host is its own key. Hosts meet the rules once each."""
    rows = frontier.withColumn("_host", host(F.col(url)))
    found = domains(rows.select(F.col("_host").alias("host")), rules).select(F.col("host").alias("_host"), F.col("domain").alias("_domain"))
    key = lambda c: F.when(F.col("_host") == "", F.col(url)).otherwise(F.col(c))
    return rows.join(found, "_host", "left").withColumn("host_key", key("_host")).withColumn("domain_key", key("_domain")).drop("_host", "_domain")


def queue_key(url: Column, by: str = "host") -> Column:
    key = host(url) if by == "host" else registered_domain(url)
    return F.when(key == "", url).otherwise(key)


def without_dots(path: Column) -> Column:
    """A path without `.` and `..` segments, if it begins with a slash: a fold over its segments with a stack."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    stack = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda kept, p: F.when(p == ".", kept).when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, p)),
    )
    whole = F.when(last.isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack)
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(whole, "/"))).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """The address that a reference on a page stands for, from the page's own address (RFC 3986, section 5.2)."""
    part = lambda url, k: F.regexp_extract(url, PARTS, k)
    scheme, path = part(href, 1), part(href, 3)
    merged = F.when(base.rlike(AUTHORITY) & (part(base, 3) == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_replace(part(base, 3), "[^/]*$", ""), path))
    own = (scheme != "") | href.rlike(AUTHORITY)
    to = F.when(own, without_dots(path)).when(path == "", part(base, 3)).when(path.startswith("/"), without_dots(path)).otherwise(without_dots(merged))
    asked = F.when(own | (path != "") | href.rlike(QUERY), F.when(href.rlike(QUERY), F.concat(F.lit("?"), part(href, 4)))).when(base.rlike(QUERY), F.concat(F.lit("?"), part(base, 4)))
    at = F.when(href.rlike(AUTHORITY), F.concat(F.lit("//"), part(href, 2))).when((scheme == "") & base.rlike(AUTHORITY), F.concat(F.lit("//"), part(base, 2)))
    anchor = F.when(href.contains("#"), F.concat(F.lit("#"), part(href, 5)))
    return F.concat(F.when(scheme != "", scheme).otherwise(part(base, 1)), F.lit(":"), *[F.coalesce(x, F.lit("")) for x in (at, to, asked, anchor)])


def plain_escapes(text: Column) -> Column:
    """Percent escapes of letters, digits and -._~ as those characters, of others in capitals; % alone stays."""

    def one(p: Column) -> Column:
        code, rest = F.upper(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p))
        sign = F.chr(F.conv(code, 16, 10).cast("int"))
        return F.when(~p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), p)).when(code.rlike("^[2-7]") & sign.rlike("^[A-Za-z0-9._~-]$"), F.concat(sign, rest)).otherwise(F.concat(F.lit("%"), code, rest))

    parts = F.split(text, "%")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, without anchor, default port and dot segments, a slash for an empty path, escapes
    made plain, and the query mended: its first sign is a question mark, and no sign between values is doubled or at the
    end. Null if it is no address."""
    address = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#&\s]+)([^?#&]*)([?&][^#]*)?"
    part = lambda k: F.regexp_extract(F.trim(url), address, k)
    scheme, port = F.lower(part(1)), F.when(F.lower(part(1)) == "http", ":80$").when(F.lower(part(1)) == "https", ":443$").otherwise(":$")
    user, site = F.regexp_extract(part(2), "^(.*@)?", 0), F.lower(F.regexp_replace(part(2), "^.*@", ""))
    path = without_dots(plain_escapes(F.when(part(3) == "", "/").otherwise(part(3))))
    values = F.regexp_replace(F.regexp_replace(part(4), "^[?&]+|[?&]+$", ""), "[?&]+", "&")
    query = F.when(values != "", F.concat(F.lit("?"), values)).otherwise("")
    valid = F.trim(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+[^\s]*$")
    return F.when(valid, F.concat(scheme, F.lit("://"), user, F.regexp_replace(site, port, ""), path, plain_escapes(query)))


def acceptable_url(url: Column, longest: int = 1024, repeats: int = 3) -> Column:
    """Scheme, file suffix (before the end, a question mark or an ampersand), private ranges, length, repeated path parts."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/"), lambda p: p != "")
    repeated = F.exists(parts, lambda p: F.size(F.filter(parts, lambda q: q == p)) >= repeats)
    return ~url.rlike("^(file|ftp|mailto):") & ~url.rlike(rf"(?i)[.]({SUFFIXES})([?]|&|$)") & ~url.rlike(PRIVATE) & (F.length(url) <= longest) & ~repeated


def filter_urls(frontier: DataFrame, url: str = "url", source: str = "source_url") -> DataFrame:
    """Links that are acceptable, on the domain of the page they stand on, and not that page itself."""
    same = registered_domain(F.col(url)) == registered_domain(F.col(source))
    return frontier.filter(acceptable_url(F.col(url)) & same & (normalize_url(F.col(url)) != F.coalesce(normalize_url(F.col(source)), F.lit(""))))
