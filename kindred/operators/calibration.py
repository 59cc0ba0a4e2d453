"""Probability calibration of scores, any number of fits at once: one for each group of the calibration rows.

Rows are counted by group and score first, which loses nothing. Platt's two parameters come from Newton steps, each of them
one aggregation of all groups together. Isotonic fits pool adjacent violators within slices of the scores and then over the
slices' blocks, which gives the same blocks as one pass over all scores would.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.checkpoints import cut

#: Steps from the best constant; a fit of one score doubles its digits each time.
NEWTON_STEPS = 8
#: Fits are broadcast up to so many groups (three numbers each).
GROUPS_BROADCAST = 100_000
#: Slices of a group's range of scores that are pooled by themselves.
SLICES = 64


def counted(cal: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """(_all, by, _x, _n, _pos): rows and positives by group and score, rows without either left out. ``_all`` is a key that
    all share, so that no group is a group, too."""
    rows = cal.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy(F.lit(0).alias("_all"), *by, F.col(score).cast("double").alias("_x"))
    return cut(rows.agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos")))


def few(fits: DataFrame) -> DataFrame:
    return F.broadcast(fits) if fits.count() <= GROUPS_BROADCAST else fits


def platt_fits(cal: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(_all, by, _w, _b) of p = 1 / (1 + exp(-(w * score + b))) by group: least log loss plus w^2 / 2. Groups whose labels
    are all alike have no fit and no row."""
    key, rows = ["_all", *by], counted(cal, list(by), score, label)
    c = F.col
    whole = rows.groupBy(*key).agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos")).where("_pos > 0 and _pos < _n")
    fits = few(cut(whole.select(*key, F.lit(0.0).alias("_w"), F.ln(c("_pos") / (c("_n") - c("_pos"))).alias("_b"))))
    for _ in range(NEWTON_STEPS):
        p, x = 1 / (1 + F.exp(-(c("_w") * c("_x") + c("_b")))), c("_x")
        each = rows.join(fits, key).select(*key, "_w", "_b", "_x", (c("_n") * p - c("_pos")).alias("_g"), (c("_n") * p * (1 - p)).alias("_h"))
        sums = each.groupBy(*key, "_w", "_b").agg(
            (F.sum(c("_g") * x) + c("_w")).alias("_gw"), F.sum("_g").alias("_gb"), (F.sum(c("_h") * x * x) + 1).alias("_ww"), F.sum(c("_h") * x).alias("_wb"), F.sum("_h").alias("_bb"),
        )
        det = c("_ww") * c("_bb") - c("_wb") * c("_wb")
        step = lambda up: F.coalesce(F.try_divide(up, det), F.lit(0.0))  # noqa: B023, E731
        fits = sums.select(*key, (c("_w") - step(c("_bb") * c("_gw") - c("_wb") * c("_gb"))).alias("_w"), (c("_b") - step(c("_ww") * c("_gb") - c("_wb") * c("_gw"))).alias("_b"))
    return cut(fits)


def platt(cal: DataFrame, rows: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """``rows`` with p by their group's fit; rows of a group without one are left out."""
    joined = rows.withColumn("_all", F.lit(0)).join(few(platt_fits(cal, by, score, label)), ["_all", *by])
    return joined.withColumn("p", 1 / (1 + F.exp(-(F.col("_w") * F.col(score) + F.col("_b"))))).drop("_all", "_w", "_b")


def pooled(table: pa.Table) -> pa.Table:
    """Blocks (_lo, _hi, _n, _pos) of one group, or of a slice of it, with neighbours merged until their rates ascend. Rates
    are compared as fractions, so the result doesn't depend on slices."""
    names = ("_lo", "_hi", "_n", "_pos")
    table = table.sort_by("_lo")
    blocks: list[list] = []
    for lo, hi, n, pos in zip(*(table[c].to_pylist() for c in names), strict=True):
        blocks.append([lo, hi, n, pos])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, n, pos = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + n, blocks[-1][3] + pos]
    kept = {c: pa.array([b[i] for b in blocks], table.schema.field(c).type) for i, c in enumerate(names)}
    return pa.table([kept[c] if c in kept else table[c].slice(0, 1).take([0] * len(blocks)) for c in table.column_names], names=table.column_names)


def isotonic_blocks(cal: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(_all, by, _lo, _hi, _n, _pos): the isotonic fit's blocks of equal rate by group, from score _lo to score _hi."""
    key, rows, c = ["_all", *by], counted(cal, list(by), score, label), F.col
    span = few(cut(rows.groupBy(*key).agg(F.min("_x").alias("_least"), F.max("_x").alias("_most"))))
    place = F.coalesce(F.try_divide(c("_x") - c("_least"), c("_most") - c("_least")), F.lit(0.0))
    rows = rows.join(span, key).select(*key, F.least(F.lit(SLICES - 1), F.floor(place * SLICES)).cast("int").alias("_slice"), c("_x").alias("_lo"), c("_x").alias("_hi"), "_n", "_pos")
    slices = rows.groupBy(*key, "_slice").applyInArrow(pooled, rows.schema).drop("_slice")
    return cut(slices.groupBy(*key).applyInArrow(pooled, slices.schema))


def stepwise(steps: Column, x: Column) -> Column:
    """A fit's value at ``x``: its first and last value beyond its ends, and between two blocks on the line from one to
    the other. ``steps`` are (lo, hi, v), in order."""
    k = F.size(F.filter(steps, lambda s: s["lo"] <= x))
    at, then = F.get(steps, F.greatest(k - 1, F.lit(0))), F.get(steps, k)
    between = at["v"] + (then["v"] - at["v"]) * (x - at["hi"]) / (then["lo"] - at["hi"])
    return F.when((k == 0) | (k == F.size(steps)) | (x <= at["hi"]), at["v"]).otherwise(between)


def isotonic(cal: DataFrame, rows: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """``rows`` with p by their group's isotonic fit. A fit of n labels has blocks in the order of n^(2/3) at most, as
    rates that ascend need ever larger denominators, so it goes as one array to the rows. Rows of a group without a fit
    are left out."""
    key = ["_all", *by]
    block = F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("_pos") / F.col("_n")).alias("v"))
    fits = few(cut(isotonic_blocks(cal, by, score, label).groupBy(*key).agg(F.sort_array(F.collect_list(block)).alias("_steps"))))
    return rows.withColumn("_all", F.lit(0)).join(fits, key).withColumn("p", stepwise(F.col("_steps"), F.col(score))).drop("_all", "_steps")


def by_size(cal: DataFrame, sizes: list[int], place: str = "place") -> DataFrame:
    """The first ``size`` of the placed rows for every size, which gives samples without replacement, each within the next."""
    return cal.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col(place) <= F.col("size"))


