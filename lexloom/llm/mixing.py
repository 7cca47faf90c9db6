"""Operator 4: mixing sources to target weights by hierarchical budgets, in DataFrame and SQL functions alone.

Leaves are the combinations of the level columns, by default domain, language and source. The budget of tokens goes down
the tree: the children of a node share its budget by their weights. A child that has too few tokens for its share, even
repeated `max_epochs` times, gets what it has, and the shortage goes to its siblings, again by weight; only what a whole
node cannot take goes to the node's own siblings, and so on up. All of this is exact integer arithmetic over window
functions: sorted by capacity per weight, the full children come first, so that running sums find them.

A leaf's budget is so many whole epochs and a rest. Each epoch has an order of its own, by the md5 of seed, epoch and
doc_id, and the rest takes the longest prefix of the last epoch's order that fits. Running sums over a hot leaf are
split: documents fall in `buckets` by the hash, bucket totals are summed first, and windows run within buckets.

Edge cases: null levels are the value '(null)'; null texts have no tokens and belong to every epoch of their leaf's
prefix that they fit in; rows that repeat a doc_id are documents of their own, ties broken by size; weights of 0 leave a
node out; what is lost by rounding budgets down is below one token a node; an empty table gives an empty result; other
columns are kept where rows are asked for, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, tables

LEVELS = ("domain", "lang", "source")
#: Integer weights by level; values that are not named have weight 1.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def level_columns() -> list[Column]:
    """domain (sources fall in four by crc32), language and source."""
    source, lang = (F.coalesce(F.col(c), F.lit("(null)")) for c in ("source", "lang"))
    return [F.concat(F.lit("d"), (F.crc32(source.cast("binary")) % 4).cast("string")).alias("domain"), lang.alias("lang"), source.alias("source")]


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, w).otherwise(out)
    return out.cast("long")


def leaf_budgets(leaves: DataFrame, budget: Column, levels: tuple[str, ...] = LEVELS, weights: dict | None = None, max_epochs: int = 4) -> DataFrame:
    """`leaves` has the levels and tokens; adds the leaf's budget in tokens, at most max_epochs * tokens. `budget` is an
    aggregate over the leaves."""
    weights = WEIGHTS if weights is None else weights
    rows = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for k, level in enumerate(levels):
        rows = rows.withColumn(f"w{k}", _weight(level, weights))
    rows = rows.filter(" and ".join(f"w{k} > 0" for k in range(len(levels))))
    total = leaves.agg(budget.cast("long").alias("given"))
    nodes = total
    for k, level in enumerate(levels):
        parents = list(levels[:k])
        children = rows.groupBy(*parents, level).agg(F.sum("cap").alias("cap"), F.first(f"w{k}").alias("w"))
        children = children.join(nodes, parents) if parents else children.crossJoin(F.broadcast(nodes))  # one row
        full_first = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), level)
        earlier, every = full_first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parents)
        left = F.greatest(F.lit(0), F.col("given") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(earlier), F.lit(0))
        children = children.withColumn("left", left).withColumn("weight_left", weight_left)
        children = children.withColumn("short", F.col("cap") * F.col("weight_left") <= F.col("w") * F.col("left"))
        children = children.withColumn("short", F.min(F.col("short").cast("int")).over(full_first.rowsBetween(Window.unboundedPreceding, 0)) == 1)
        rest = F.max(F.when(~F.col("short"), F.col("left"))).over(every)
        rest_weight = F.max(F.when(~F.col("short"), F.col("weight_left"))).over(every)
        children = children.withColumn("rest", rest).withColumn("rest_weight", rest_weight)
        share = F.expr("(w * rest) div rest_weight")
        nodes = children.select(*parents, level, F.when(F.col("short"), F.col("cap")).otherwise(F.least(share, "cap")).alias("given"))
    return leaves.join(nodes.withColumnRenamed("given", "budget"), list(levels))


def _selected(rows: DataFrame, budgets: DataFrame, levels: tuple[str, ...], seed: int, buckets: int) -> DataFrame:
    """`rows` has the levels, doc_id and tokens and whatever else; adds how often each row is taken."""
    plan = budgets.select(*levels, F.expr("if(tokens > 0, budget div tokens, 0)").alias("whole"), F.expr("if(tokens > 0, budget % tokens, 0)").alias("rest"))
    if plan.limit(100_001).count() <= 100_000:
        plan = F.broadcast(plan)
    rows = rows.join(plan, list(levels))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "whole", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("digest", digest).withColumn("bucket", F.expr(f"cast(conv(substring(digest, 1, 6), 16, 10) as long) % {buckets}"))
    sizes = rows.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("held"))
    bases = sizes.withColumn("base", F.coalesce(F.sum("held").over(Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    within = Window.partitionBy(*levels, "bucket").orderBy("digest", "tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(bases, [*levels, "bucket"]).withColumn("run", F.col("base") + F.sum("tokens").over(within))
    return rows.withColumn("copies", F.col("whole") + (F.col("run") <= F.col("rest")).cast("long"))


def _leaves(rows: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def mixture(docs: DataFrame, budget_share: float = 1.0, levels: tuple[str, ...] = LEVELS, columns: list[Column] | None = None, weights: dict | None = None, max_epochs: int = 4, seed: int = 4, buckets: int = 4096) -> DataFrame:
    """doc_id, the levels, tokens and epoch (from 0) for each time that a document is taken. The budget is
    `budget_share` of all tokens there are."""
    rows = settled(docs.select("doc_id", *(columns or level_columns()), word_count(F.col("text")).alias("tokens")), "tokens-by-leaf")
    leaves = settled(_leaves(rows, levels), "leaves")
    budgets = settled(leaf_budgets(leaves, F.floor(F.sum("tokens") * F.lit(budget_share)), levels, weights, max_epochs), "budgets")
    taken = _selected(rows, budgets, levels, seed, buckets).filter("copies > 0")
    return taken.select("doc_id", *levels, "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))


def take_mixture(docs: DataFrame, budget_share: float = 1.0, levels: tuple[str, ...] = LEVELS, columns: list[Column] | None = None, weights: dict | None = None, max_epochs: int = 4, seed: int = 4, buckets: int = 4096) -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as it is taken."""
    rows = docs.select("doc_id", *(columns or level_columns()), word_count(F.col("text")).alias("tokens"), F.struct("*").alias("row"))
    leaves = settled(_leaves(rows, levels), "leaves")
    budgets = settled(leaf_budgets(leaves, F.floor(F.sum("tokens") * F.lit(budget_share)), levels, weights, max_epochs), "budgets")
    taken = _selected(rows, budgets, levels, seed, buckets).filter("copies > 0")
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(tables(spark, sf_dir, "documents"))
