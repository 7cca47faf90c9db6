"""Boolean match, tf-idf scores, range rules, boosts, statistics and suggestions over a table of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FEATURES, quoted, tokens


def postings(rows: DataFrame, key: str, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """field, term, key, tf and the field's length in terms."""
    parts = [rows.select(F.lit(f).alias("field"), key, F.transform(tokens(F.col(f)), lambda t: F.lower(t)).alias("w")).filter(F.col("w").isNotNull()) for f in fields]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("length", F.size("w")).select("field", key, "length", F.explode("w").alias("term")).groupBy("field", "term", key, "length").agg(F.count("*").alias("tf"))


def match(rows: DataFrame, key: str, terms: list[str], every: bool = True, text: str = "text") -> DataFrame:
    """Rows with every term (or any). The terms are tested in the scan; nothing is shuffled."""
    words = F.transform(tokens(F.col(text)), lambda t: F.lower(t))
    tests = [F.array_contains(words, t.lower()) for t in terms]
    test = tests[0]
    for t in tests[1:]:
        test = test & t if every else test | t
    return rows.filter(test)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def score(rows: DataFrame, key: str, terms: list[str], fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """Classic tf-idf: sqrt(tf) * (1 + ln((N+1)/(df+1)))^2 / sqrt(length); per term the best field, summed over terms.

    Only postings of the query's terms are shuffled."""
    wanted = [t.lower() for t in terms]
    n = rows.agg(F.count("*").alias("n"))
    own = []
    for f in fields:
        words = F.transform(tokens(F.col(f)), lambda t: F.lower(t))
        counts = F.array(*[F.struct(F.lit(t).alias("term"), F.size(F.filter("w", _equals(t))).alias("tf")) for t in wanted])
        own.append(rows.select(key, words.alias("w")).select(key, F.size("w").alias("length"), F.lit(f).alias("field"), F.explode(F.filter(counts, lambda c: c["tf"] > 0)).alias("c")).select(key, "field", "length", "c.term", "c.tf"))
    hits = own[0]
    for p in own[1:]:
        hits = hits.unionByName(p)
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).withColumn("idf", 1 + F.log((F.col("n") + 1) / (F.col("df") + 1)))  # a row for each term and field
    each = hits.join(F.broadcast(idf.select("field", "term", "idf")), ["field", "term"]).withColumn("s", F.sqrt("tf") * F.col("idf") * F.col("idf") / F.sqrt("length"))
    return each.groupBy(key, "term").agg(F.max("s").alias("s")).groupBy(key).agg(F.sum("s").alias("score"))


def scored(rows: DataFrame, terms: list[str], fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """`rows` with their score over all rows (null for rows without a term); the same as score(), for few terms.

    One aggregate counts rows and terms, and its single row is broadcast; the score is then an expression, so that rows,
    with all their columns, are neither shuffled nor joined with one another."""
    wanted = [t.lower() for t in terms]
    # Words are made once a pass; one fold over them counts all terms.
    split = rows.withColumn("_w", F.array(*[F.transform(tokens(F.col(f)), lambda t: F.lower(t)) for f in fields]))
    places = F.array(*map(F.lit, wanted))
    counts = F.transform("_w", lambda ws: F.transform(places, lambda t: F.size(F.filter(ws, lambda w: w == t))))
    counted = split.withColumn("_tf", counts).withColumn("_len", F.transform("_w", lambda ws: F.size(ws))).drop("_w")
    each = [(i, j) for i in range(len(fields)) for j in range(len(wanted))]
    stats = counted.agg(F.count("*").alias("_n"), *[F.count_if(F.col("_tf")[i][j] > 0).alias(f"_df_{i}_{j}") for i, j in each])
    out = counted.crossJoin(F.broadcast(stats))  # one row
    idf = lambda i, j: 1 + F.log((F.col("_n") + 1) / (F.col(f"_df_{i}_{j}") + 1))
    one = lambda i, j: F.when(F.col("_tf")[i][j] > 0, F.sqrt(F.col("_tf")[i][j]) * idf(i, j) * idf(i, j) / F.sqrt(F.col("_len")[i]))
    best = [F.greatest(*[one(i, j) for i in range(len(fields))]) if len(fields) > 1 else one(0, j) for j in range(len(wanted))]
    some = best[0].isNotNull()
    for b in best[1:]:
        some = some | b.isNotNull()
    total = F.coalesce(best[0], F.lit(0.0))
    for b in best[1:]:
        total = total + F.coalesce(b, F.lit(0.0))
    return out.withColumn("score", F.when(some, total)).drop("_tf", "_len", "_n", *[f"_df_{i}_{j}" for i, j in each])


def rule_filter(df: DataFrame, rules: list[tuple[str, str | float | None, str | float | None]]) -> DataFrame:
    """Closed ranges with open ends (None or *); a row without the feature fails any rule on it. Bounds of dates (features
    with date in their name, or of a date type) may be month/day/year; bounds of whole-number features (_i) lose their
    fraction, towards 0."""
    kinds = dict(df.dtypes)

    def bound(feature: str, v: str | float | None) -> Column | None:
        if v is None or v == "*":
            return None
        if "date" in feature or kinds[feature] in ("date", "timestamp", "timestamp_ntz"):
            return F.coalesce(F.try_to_timestamp(F.lit(v), F.lit("MM/dd/yyyy")), F.lit(v).try_cast("timestamp")) if isinstance(v, str) else F.lit(v)
        return F.lit(int(float(v))) if feature.endswith("_i") else F.lit(float(v))

    for feature, low, high in rules:
        c, least, most = F.col(feature), bound(feature, low), bound(feature, high)
        df = df.filter(c.isNotNull())
        df = df if least is None else df.filter(c >= least)
        df = df if most is None else df.filter(c <= most)
    return df


def parsed(rules: str) -> list[tuple[str, str, str, float]]:
    """(feature, low, high, weight) of a string of rules, for rule_filter and rule_boost. An unknown code or a rule without
    four parts is an error, as what it should filter can't be told."""
    out = []
    for rule in filter(None, rules.split(";")):
        code, low, high, weight = rule.split(",")
        if code not in FEATURES:
            raise ValueError(f"no feature has the code {code}")
        try:
            out.append((FEATURES[code], low, high, float(weight)))
        except ValueError:
            out.append((FEATURES[code], low, high, 0.0))
    return out


def apply_rules(df: DataFrame, rules: str, score: str = "score") -> DataFrame:
    """Rows within the ranges of a string of rules, their score boosted by its weights."""
    each = parsed(rules)
    return rule_filter(df, [r[:3] for r in each]).withColumn(score, rule_boost(F.col(score), {f: w for f, _, _, w in each}))


def rule_boost(score_: Column, weights: dict[str, float]) -> Column:
    """Score times (0.001 + feature * weight) for each weight that is not 0; a missing feature counts 0."""
    for feature, w in weights.items():
        if w:
            score_ = score_ * (F.lit(0.001) + F.coalesce(F.col(feature), F.lit(0)) * F.lit(float(w)))
    return score_


def top_hits(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("score"), key).limit(n)


def field_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, low, high over all rows, in one aggregate; features without values are left out."""
    kinds = dict(df.dtypes)
    # Dates are written as month/day/year, numbers as they are.
    shown = lambda c, x: F.date_format(x, "MM/dd/yyyy") if kinds[c] in ("date", "timestamp", "timestamp_ntz") else x.cast("double").cast("string")
    formatted = any(kinds[c] in ("date", "timestamp", "timestamp_ntz") for c in features)
    kept = shown if formatted else (lambda c, x: x.cast("double"))
    one = df.agg(*[kept(c, f(c)).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])
    pairs = ", ".join(f"'{c}', lo_{c}, hi_{c}" for c in features)
    return one.selectExpr(f"stack({len(features)}, {pairs}) as (feature, low, high)").filter("low is not null")


def suggest_terms(posts: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    """field, term and documents of the terms that begin so, the most frequent `n` of each field."""
    counts = posts.filter(F.col("term").startswith(prefix)).groupBy("field", "term").agg(F.count("*").alias("n_docs"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n_docs"), "term"))).filter(F.col("rank") <= n)


def suggest_phrases(rows: DataFrame, words: str | list[str], following: int = 7, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Distinct phrases: the first match of a word of the query that is no stop word (of all, if all are), and up to
    `following` words after it, within punctuation."""
    asked = [words] if isinstance(words, str) else [w for w in words if w.lower() not in stop_words] or list(words)
    word = "|".join(quoted(w.lower()) for w in asked)
    found = F.regexp_extract(F.lower("text"), rf"(?:^|[^\p{{L}}])((?:{word})(?: [\p{{L}}\p{{N}}]+){{0,{following}}})", 1)
    return rows.select(found.alias("phrase")).filter("phrase != ''").distinct()


def offers_general(rows: DataFrame, phrases: list[str], text: str = "text", few: int = 10) -> DataFrame:
    """For each query (words joined by AND) its variant with OR, how many rows hold all its words, and whether the variant
    is offered: the query has several words and fewer than `few` rows hold them. One aggregate counts for all queries."""
    held = F.array_distinct(F.transform(tokens(F.col(text)), lambda t: F.lower(t)))
    tests = [F.forall(F.array(*[F.lit(w.lower()) for w in p.split(" AND ")]), lambda w: F.array_contains("_held", w)) for p in phrases]
    counts = rows.select(held.alias("_held")).agg(F.array(*[F.count_if(F.coalesce(t, F.lit(False))) for t in tests]).alias("n"))
    each = F.arrays_zip(F.array(*map(F.lit, phrases)).alias("phrase"), F.col("n"))
    out = counts.select(F.explode(each).alias("x")).select(F.col("x.phrase").alias("phrase"), F.col("x.n").alias("n"))
    return out.select("phrase", F.replace("phrase", F.lit(" AND "), F.lit(" OR ")).alias("general"), "n", (F.col("phrase").contains(" AND ") & (F.col("n") < few)).alias("offer"))


def top_terms(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def popularity(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of `left` with the number of rows of `right`, 0 included. The right side is counted before the join."""
    counts = right.groupBy(F.col(right_key).alias("_k")).agg(F.count("*").alias("_n"))
    return left.join(counts, F.col(key) == F.col("_k"), "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_k", "_n")


def page_of(df: DataFrame, order: list[Column | str], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def site_filter(sites: DataFrame, links: DataFrame, names: list[str], tags: list[str]) -> DataFrame:
    """Sites named and sites of the tags, each once. links: site, tag."""
    named = sites.filter(F.col("site").isin(names)).select("site")
    return named.union(links.filter(F.col("tag").isin(tags)).select("site")).distinct()


def find_by_substring(rows: DataFrame, name: str, part: str, page: int, size: int, order: list[str], skip: int = 0) -> DataFrame:
    """A page of rows whose name holds the part."""
    return rows.filter(F.col(name).contains(part)).orderBy(*order).offset(skip + page * size).limit(size)


def record_query(history: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The history with the latest time of each query; new ones are counted before they meet it."""
    latest = new.groupBy(*keys).agg(F.max(at).alias(at))
    return history.unionByName(latest).groupBy(*keys).agg(F.max(at).alias(at))


def visible_rules(rules: DataFrame, owner: str, users: DataFrame, public: int = -1) -> DataFrame:
    """Rules that are public or belong to one of the users (user)."""
    own = rules.join(users.select(F.col("user").alias("_u")).distinct(), F.col(owner) == F.col("_u"), "left_semi")
    return rules.filter(F.col(owner) == public).unionByName(own.filter(F.col(owner) != public))
