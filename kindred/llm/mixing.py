"""Mixing sources to target weights by hierarchical budgeting.

Documents hang below a tree of column values (domain, language, source). A token budget is propagated from the root:
each node's budget goes to its children in proportion to their weights, but to none more than its subtree can supply
over all epochs. What a child can't use goes to its siblings first, in proportion again; only what the siblings can't
take either is missing at their parent, whose own siblings then get it. Both come out of one descent, because a node is
never given more than its subtree's supply: sorted by supply/weight, the children that are used up come first, and a
running sum finds where they end. Shares are whole tokens (largest remainders).

Each leaf then takes a prefix of its tokens: whole epochs first, then the documents of one more epoch in a seeded
order, the last of them in part. The running sums come from two levels (sums of hash buckets, then rows of the one
bucket where the budget ends), so a leaf that holds a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of, cut

ROWS_PER_BUCKET = 20_000
#: Small results are coalesced, so that a task has the rows of so many texts at least.
TEXTS_PER_TASK = 2_000
SEED = 2011


def words(text: str = "text") -> Column:
    """Tokens of a text: its runs of anything but white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def portions(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to rows (weight, supply, parent_budget), whole tokens that fill each parent's budget as far as
    its children's supplies go."""
    fill = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(float("inf"))
    order = Window.partitionBy(*parent).orderBy("fill", "key")
    sofar, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    rows = children.withColumn("fill", fill)
    rows = rows.withColumn("left", F.col("parent_budget") - F.coalesce(F.sum("supply").over(sofar), F.lit(0)))
    rows = rows.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(sofar), F.lit(0.0)))
    rows = rows.withColumn("used_up", (F.col("weight") > 0) & (F.col("supply") * F.col("open") <= F.col("left") * F.col("weight")))
    rows = rows.withColumn("rest", F.min(F.when(~F.col("used_up"), F.struct("fill", "key", "left", "open"))).over(whole))
    share = F.when(F.col("weight") <= 0, 0.0).when(F.col("used_up"), F.col("supply").cast("double"))
    rows = rows.withColumn("share", share.otherwise(F.greatest(F.lit(0.0), F.col("rest.left") * F.col("weight") / F.col("rest.open"))))
    rows = rows.withColumn("budget", F.least(F.floor("share"), F.col("supply")))
    total = F.least(F.col("parent_budget"), F.sum(F.when(F.col("weight") > 0, F.col("supply")).otherwise(0)).over(whole))
    rows = rows.withColumn("over", total - F.sum("budget").over(whole))
    spare = (F.col("budget") < F.col("supply")) & (F.col("weight") > 0)
    by_rest = Window.partitionBy(*parent).orderBy(F.desc(spare), F.desc(F.col("share") - F.col("budget")), "key")
    rows = rows.withColumn("budget", F.col("budget") + (spare & (F.row_number().over(by_rest) <= F.col("over"))).cast("long"))
    return rows.drop("fill", "left", "open", "used_up", "rest", "share", "over")


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: int, epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(levels..., tokens, budget) from rows (levels..., tokens), one for each leaf. A value without a weight weighs 1."""
    paths, found = [levels[: i + 1] for i in range(len(levels))], None
    for path in paths:
        level, parent = path[-1], path[:-1] or ["root"]
        given = weights.get(level, {})
        weight = F.coalesce(*[F.create_map(*[F.lit(x) for pair in given.items() for x in pair])[F.col(level)]] if given else [], F.lit(1.0)).cast("double")
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).alias("supply")).withColumns({"root": F.lit(0), "weight": weight, "key": F.col(level)})
        above = found.withColumnRenamed("budget", "parent_budget") if found is not None else None
        nodes = nodes.join(above, path[:-1]) if above is not None else nodes.withColumn("parent_budget", F.lit(budget).cast("long"))
        found = portions(nodes, parent).select(*path, "budget")
    return leaves.join(found, levels)


def mixed(docs: DataFrame, levels: list[str], budget: int | None = None, share: float = 0.8, epochs: int = 1, weights: dict[str, dict[str, float]] | None = None, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, levels, n_tokens, epochs, part) of the rows of ``docs`` that are taken: epochs is how often the text is
    taken whole, part how many of its first tokens are taken once more.

    ``budget`` is in tokens (default: ``share`` of all tokens). Null level values are a child named ``(none)``; texts
    that are null or without a token supply nothing and are never taken. Repeated rows count as often as they occur.
    Tokens are counted once; only the narrow rows are dealt out and sorted. Budgets are materialised, so that the plan of
    the descent, which the driver holds, isn't part of every plan that is made of the rows.
    """
    named = {f"_{i}": F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for i, c in enumerate(levels)}
    path = list(named)
    parts = blocks_of(docs.count(), TEXTS_PER_TASK)
    rows = cut(docs.coalesce(parts).select(key, *levels, words(text).alias("n_tokens")).withColumns(named).where("n_tokens > 0"))
    order = F.xxhash64(F.lit(seed), F.col(key), "n_tokens")
    sums = cut(rows.groupBy(*path).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    all_tokens, n = sums.agg(F.sum("tokens"), F.sum("n")).first()
    budget = int((all_tokens or 0) * share) if budget is None else budget
    buckets = blocks_of(n or 0, ROWS_PER_BUCKET)
    given = {f"_{i}": (weights or {}).get(c, {}) for i, c in enumerate(levels)}
    leaves = leaf_budgets(sums.drop("n"), path, budget, epochs, given)
    leaves = cut(leaves.select(*path, F.floor(F.col("budget") / F.col("tokens")).alias("epochs"), (F.col("budget") % F.col("tokens")).alias("last")))
    rows = rows.withColumn("_order", order).withColumn("_bucket", F.floor((F.shiftright("_order", 32) + (1 << 31)) * buckets / float(1 << 32)).cast("int"))
    in_bucket = rows.groupBy(*path, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy(*path).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = in_bucket.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(leaves, path)
    cuts = cuts.select(*path, "_bucket", "epochs", F.col("_before"), F.col("last"), F.when(F.col("_before") >= F.col("last"), 0).when(F.col("_before") + F.col("_sum") <= F.col("last"), 2).otherwise(1).alias("_case"))
    rows = rows.join(cuts, [*path, "_bucket"])
    inside = Window.partitionBy(*path, "_bucket").orderBy("_order", key).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("_case = 1").withColumn("_left", F.col("last") - F.col("_before") - F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    ends = ends.withColumn("part", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("_left")))).drop("_left")
    rest = rows.where("_case <> 1").withColumn("part", F.when(F.col("_case") == 2, F.col("n_tokens")).otherwise(0).cast("long"))
    taken = rest.coalesce(parts).unionByName(ends.coalesce(parts))
    whole = F.col("epochs") + (F.col("part") == F.col("n_tokens")).cast("long")
    taken = taken.withColumn("epochs", whole).withColumn("part", F.when(F.col("part") == F.col("n_tokens"), 0).otherwise(F.col("part")).cast("long"))
    return taken.where("epochs > 0 or part > 0").drop(*path, "_order", "_bucket", "_before", "last", "_case")
