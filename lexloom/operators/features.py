"""Numeric features of periods, alone and within a context, and the registry of features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import average_word_length, tokens
from ..sources.io import settled

REGISTRY: dict[str, Callable[[Column], Column]] = {}
CONTEXT_REGISTRY: dict[str, Callable[[DataFrame, DataFrame, str, str], DataFrame]] = {}


def register_feature(name: str, column: Callable[[Column], Column]) -> None:
    REGISTRY[name] = column


def register_context_feature(name: str, transform: Callable[[DataFrame, DataFrame, str, str], DataFrame]) -> None:
    """`transform` gives context, key and a column `name` from periods, their sentences and the names of both columns."""
    CONTEXT_REGISTRY[name] = transform


register_feature("average_word_length_f", lambda text: average_word_length(tokens(text)))
register_feature("word_length_i", lambda text: F.size(tokens(text)))


def apply_features(df: DataFrame, text: Column) -> DataFrame:
    """Registered features; where a column of that name is there already, only its nulls are filled."""
    return df.withColumns({k: F.coalesce(F.col(k), f(text)) if k in df.columns else f(text) for k, f in REGISTRY.items()})


def sentiment(rows: DataFrame, valences: dict[str, float], negations: list[str], key: str, c: float = 15.0) -> DataFrame:
    """Shares of positive, negative and neutral tokens and the compound score s / sqrt(s*s + c). A valence turns round
    when a negation stands up to three tokens before it. Tokens are looked up in column expressions; nothing is shuffled."""
    table = F.create_map(*[x for w, v in valences.items() for x in (F.lit(w), F.lit(float(v)))])
    words = F.transform(tokens(F.col("text")), lambda t: F.lower(t))
    value = F.transform("_w", lambda t, i: F.coalesce(F.try_element_at(table, t), F.lit(0.0)) * F.when(F.exists(F.slice("_w", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda p: p.isin(negations)), -1.0).otherwise(1.0))
    rows = rows.select(key, words.alias("_w")).filter(F.size("_w") > 0).withColumn("_v", value)
    s = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    share = lambda f: F.round(F.size(F.filter("_v", f)) / F.size("_v"), 6)
    return rows.select(key, share(lambda x: x > 0).alias("positive_polarity_f"), share(lambda x: x < 0).alias("negative_polarity_f"), share(lambda x: x == 0).alias("neutral_polarity_f"), F.round(s / F.sqrt(s * s + c), 6).alias("compound_polarity_f"))


def word_rarity(rows: DataFrame, context: str, key: str) -> DataFrame:
    """average_word_tf_idf_f: mean over tokens of 1 / occurrences of the token in the context.

    Tokens are counted per row first, once, and then per context: hot tokens are summed before the shuffle, and the join
    that brings the totals back is one that adaptive execution may split."""
    words = rows.select(context, key, F.explode(tokens(F.col("text"))).alias("token")).groupBy(context, key, "token").agg(F.count("*").alias("n"))
    words = words if rows.isStreaming else settled(words, "word-counts")
    totals = words.groupBy(context, "token").agg(F.sum("n").alias("total"))
    return words.join(totals, [context, "token"]).groupBy(context, key).agg(F.round(F.sum(F.col("n") / F.col("total")) / F.sum("n"), 6).alias("average_word_tf_idf_f"))


def sentence_length_deviation(sentences: DataFrame, context: str, key: str) -> DataFrame:
    """Mean sentence length of each row's sentences, minus the mean over all sentences of its context."""
    own = sentences.groupBy(context, key).agg(F.sum(F.length("sentence")).alias("chars"), F.count("*").alias("n"))
    whole = own.groupBy(context).agg((F.sum("chars") / F.sum("n")).alias("mean"))
    return own.join(whole, context).select(context, key, F.round(F.col("chars") / F.col("n") - F.col("mean"), 6).alias("sentence_length_deviation_f"))


def select_context(hits: DataFrame, now: Column, hours: int = 72, limit: int = 800, literal: bool = False, order: str = "doc_location") -> DataFrame:
    """Hits whose features are older than `hours` or missing (literal: newer), at most `limit`."""
    border = now - F.make_interval(hours=F.lit(hours))
    wanted = F.col("date_class") >= border if literal else F.col("date_class").isNull() | (F.col("date_class") < border)
    return hits.filter(wanted).orderBy(order).limit(limit)


def context_gate(rows: DataFrame, context: str, least: int = 200) -> DataFrame:
    """Rows of contexts that have at least `least`."""
    large = rows.groupBy(context).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(context)
    return rows.join(large, context, "left_semi")


def random_tag(tags: DataFrame, tag: str, seed: str, top: int = 1000) -> DataFrame:
    """One of the `top` most frequent tags, by md5 of seed and tag."""
    frequent = tags.groupBy(tag).agg(F.count("*").alias("n")).orderBy(F.desc("n"), tag).limit(top)
    return frequent.orderBy(F.md5(F.concat(F.lit(seed), F.col(tag)).cast("binary"))).limit(1)


register_context_feature("average_word_tf_idf_f", lambda rows, sentences, context, key: word_rarity(rows, context, key))
register_context_feature("sentence_length_deviation_f", lambda rows, sentences, context, key: sentence_length_deviation(sentences, context, key))


def analyse_contexts(periods: DataFrame, sentences: DataFrame, context: str, key: str, now: Column, least: int = 200, text: str = "text") -> DataFrame:
    """Gate, the registered features of contexts, those of single periods where they are missing, and the date stamped.
    A feature of contexts that is there already is computed anew, unless a period has no new value."""
    rows = context_gate(periods, context, least)
    out = apply_features(rows, F.col(text))
    for name, feature in CONTEXT_REGISTRY.items():
        new = feature(rows, sentences, context, key).select(context, key, F.col(name).alias("_new"))
        out = out.join(new, [context, key], "left").withColumn(name, F.coalesce("_new", F.col(name)) if name in rows.columns else F.col("_new")).drop("_new")
    return out.withColumn("date_class", now)


def latest(rows: DataFrame, key: str | list[str], version: str) -> DataFrame:
    """The last version of each key."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))).filter("_k = 1").drop("_k")
