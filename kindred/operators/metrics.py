"""Evaluation: errors, decisions, rankings, calibration, arms and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.checkpoints import cut
from kindred.functions.aggregates import elements
from kindred.functions.columns import share, six
from kindred.functions.references import let
from kindred.operators.similarity import MIRROR, TWIN

LIKED = 4.0
#: Slices that a unit of predictions is cut into where groups are large.
SLICES_PER_UNIT = 4_096


def errors(predictions: DataFrame, by: list[str]) -> DataFrame:
    e = F.col("pred") - F.col("actual")
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), six(F.sqrt(F.avg(e * e))).alias("rmse"), six(F.avg(F.abs(e))).alias("mae"))


def decisions(predictions: DataFrame, by: list[str], threshold: float = LIKED) -> DataFrame:
    """Base rate, accuracy, precision, recall and F1 of pred >= threshold; 0 where a denominator is empty."""
    said, true = F.col("pred") >= threshold, F.col("actual") >= threshold
    rows = predictions.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(true).alias("pos"), F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(said == true).alias("right"))
    c = F.col
    rows = rows.withColumns({"precision": share(c("tp"), c("tp") + c("fp")), "recall": share(c("tp"), c("tp") + c("fn"))})
    f1 = share(2 * c("precision") * c("recall"), c("precision") + c("recall"))
    return rows.select(*by, "n", six(share(c("pos"), c("n"))).alias("base"), six(share(c("right"), c("n"))).alias("accuracy"), six(c("precision")).alias("precision"), six(c("recall")).alias("recall"), six(f1).alias("f1"))


def precision_at(predictions: DataFrame, by: list[str], k: int, fixed: bool = False, threshold: float = LIKED) -> DataFrame:
    """Share of liked films among the k of highest prediction; the denominator is what there is, or k if ``fixed``."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("pred", 9)), *[c for c in ("user_id", "film") if c not in by])
    top = predictions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    hits = F.count_if(F.col("actual") >= threshold)
    return top.groupBy(*by).agg(six(hits / (F.lit(float(k)) if fixed else F.count("*"))).alias("precision_at_k"))


def areas(predictions: DataFrame, by: list[str], threshold: float = LIKED, large: bool = False) -> DataFrame:
    """AUC by group, ties half, from the counts of distinct predictions (never from pairs); null without both classes.
    Predictions count as equal if their first nine decimals are. ``large``: groups may be too large for one task, so
    negatives are counted by slices of predictions first and then within each slice."""
    true = F.col("actual") >= threshold
    counts = predictions.groupBy(*by, F.round("pred", 9).alias("_p")).agg(F.count_if(true).alias("_pos"), F.count_if(~true).alias("_neg"))
    inside, before = list(by), F.lit(0)
    if large:
        counts = counts.withColumn("_slice", F.floor(F.col("_p") * SLICES_PER_UNIT))
        ahead = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.groupBy(*by, "_slice").agg(F.sum("_neg").alias("_n"))
        sums = sums.select(*by, "_slice", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
        inside.append("_slice")
        counts, before = counts.join(sums, inside), F.col("_before")
    upto = F.sum("_neg").over(Window.partitionBy(*inside).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("_won", F.col("_pos") * (before + upto - F.col("_neg") / 2))
    return rows.groupBy(*by).agg(six(F.try_divide(F.sum("_won"), F.sum("_pos").cast("double") * F.sum("_neg"))).alias("auc"))


def ndcg(predictions: DataFrame, by: list[str], k: int, threshold: float = LIKED) -> DataFrame:
    """NDCG at k of binary relevance; groups of one class are left out."""
    gain = F.when(F.col("actual") >= threshold, 1.0).otherwise(0.0)
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("pred", 9)), *[c for c in ("user_id", "film") if c not in by])
    rows = predictions.withColumns({"g": gain, "place": F.row_number().over(order)})
    rows = rows.withColumn("best", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("g"), "place")))
    part = lambda place: F.sum(F.when(F.col(place) <= k, F.col("g") / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    sums = rows.groupBy(*by).agg(part("place").alias("dcg"), part("best").alias("ideal"), F.min("g").alias("low"), F.max("g").alias("high"))
    return sums.where("low < high").select(*by, six(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def ece(rows: DataFrame, by: list[str], p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins))
    each = rows.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(F.col(label).cast("double")).alias("my"))
    return each.groupBy(*by).agg(six(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def calibration(rows: DataFrame, by: list[str], p: str = "p", label: str = "label") -> DataFrame:
    """ECE, Brier score, log loss (p clipped to 1e-6) and AUC."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    y = F.col(label).cast("double")
    rows = rows.withColumn("_q", q)
    loss = -F.when(y == 1, F.ln("_q")).otherwise(F.ln(1 - F.col("_q")))
    sums = rows.groupBy(*by).agg(six(F.avg((F.col("_q") - y) ** 2)).alias("brier"), six(F.avg(loss)).alias("logloss"))
    ranks = areas(rows.select(*by, F.col("_q").alias("pred"), y.alias("actual")), by, threshold=1.0, large=True)
    return sums.join(ece(rows, by, "_q", label), by).join(ranks, by)


def arm_summary(scored: DataFrame, high: int = 15) -> DataFrame:
    """Each arm's pairs (arm, r, n_common): attempted, scorable, twins, mirrors, mean r; the median of n_common is the
    upper one; the hi_ columns keep to pairs with ``high`` common films. Pairs are read once and summed up by arm and
    n_common; all else follows from these few sums, which may be given instead (arm, and what ``similarity.pair_levels`` has)."""
    r, c = F.col("r"), F.col
    if "pairs" not in scored.columns:
        scored = scored.groupBy("arm", "n_common").agg(F.count("*").alias("pairs"), F.count("r").alias("known"), F.count_if(r >= TWIN).alias("twins"), F.count_if(r <= MIRROR).alias("mirrors"), F.sum("r").alias("r"), F.sum(F.abs("r")).alias("size"))
    names = {"pairs": "_all", "known": "_n", "twins": "_twins", "mirrors": "_mirrors", "r": "_r", "size": "_abs"}
    levels = cut(scored.select("arm", "n_common", *[c(k).alias(v) for k, v in names.items()]))
    upto = F.sum("_n").over(Window.partitionBy("arm").orderBy("n_common").rowsBetween(Window.unboundedPreceding, 0))
    levels = levels.withColumns({"_upto": upto, "_half": F.floor(F.sum("_n").over(Window.partitionBy("arm")) / 2)})
    hi = c("n_common") >= high
    mean = lambda s, n: six(F.try_divide(s, n.cast("double")))
    of = lambda name: F.coalesce(F.sum(F.when(hi, c(name))), F.lit(0))
    rows = levels.groupBy("arm").agg(
        F.sum("_all").alias("n_attempted"), F.sum("_n").alias("n"), F.sum("_twins").alias("twins"), F.sum("_mirrors").alias("mirrors"), mean(F.sum("_r"), F.sum("_n")).alias("mean_r"), mean(F.sum("_abs"), F.sum("_n")).alias("mean_abs"),
        of("_n").alias("hi_n"), of("_twins").alias("hi_twins"), mean(F.sum(F.when(hi, c("_r"))), of("_n")).alias("hi_mean_r"), F.min(F.when(c("_upto") > c("_half"), c("n_common"))).alias("median_common"),
    )
    return rows.withColumns({"scorable": six(share(c("n"), c("n_attempted"))), "twin_rate": six(share(c("twins"), c("n")))})


#: Standard deviations from the mode beyond which the tables' probabilities don't count (below 1e-30), and some more steps.
FAR, MORE_STEPS = 12, 64


def fisher(tables: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Adds p: Fisher's exact test, two-sided: all tables no likelier than the one seen (1e-12 as slack).

    Tables of the same margins are weighed from the likeliest one outwards, each by its ratio to the one before; factorials
    don't come up, so nothing is lost for large counts. The walk goes ``FAR`` standard deviations both ways, within one
    row: margins of 10^7 take some ten thousand steps and no rows of their own.
    """
    x, of = (lambda name: F.col(name).cast("double")), F.col
    rows = tables.withColumns({"_r": x(a) + x(b), "_k": x(a) + x(c), "_n": x(a) + x(b) + x(c) + x(d)})
    least, most = F.greatest(F.lit(0.0), of("_r") + of("_k") - of("_n")), F.least("_r", "_k")
    mode = F.greatest(least, F.least(most, F.floor((of("_r") + 1) * (of("_k") + 1) / (of("_n") + 2)).cast("double")))
    spread = F.sqrt(F.coalesce(F.try_divide(of("_r") * of("_k") * (of("_n") - of("_r")) * (of("_n") - of("_k")), of("_n") * of("_n") * F.greatest(of("_n") - 1, F.lit(1.0))), F.lit(0.0)))
    rows = rows.withColumns({"_mode": mode, "_least": least, "_most": most, "_steps": F.ceil(FAR * spread) + MORE_STEPS})
    other = of("_n") - of("_r") - of("_k")
    up = lambda i: (of("_r") - i) * (of("_k") - i) / ((i + 1) * (other + i + 1))
    down = lambda i: i * (other + i) / ((of("_r") - i + 1) * (of("_k") - i + 1))

    def walk(ratio, sign: int, end: str, told) -> Column:
        """Sum of ``told(i, weight)`` beyond the mode, on one side."""
        steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.least("_steps", F.abs(of(end) - of("_mode")).cast("long")), F.lit(1).cast("long")))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

        def step(state: Column, k: Column) -> Column:
            i = of("_mode") + sign * k
            w = F.when(sign * i <= sign * of(end), state["w"] * ratio(i - sign)).otherwise(0.0)
            return F.struct(w.alias("w"), (state["sum"] + told(i, w)).alias("sum"))

        return F.aggregate(steps, start, step)["sum"]

    both = lambda told: walk(up, 1, "_most", told) + walk(down, -1, "_least", told) + told(of("_mode"), F.lit(1.0))
    seen = F.struct(both(lambda i, w: w).alias("all"), both(lambda i, w: F.when(i == x(a), w).otherwise(0.0)).alias("own"))
    like = lambda s: both(lambda i, w: F.when(w <= s["own"] + 1e-12 * s["all"], w).otherwise(0.0)) / s["all"]
    return rows.select(*tables.columns, six(F.least(F.lit(1.0), let(seen, like))).alias("p"))


def cohort_rows(cf: DataFrame, split: DataFrame, near: DataFrame, least_test: int = 8, least_train: int = 20) -> DataFrame:
    """Each target's counts, coverage, usable neighbours, AUC and RMSE for neighbours, and for its mean on the same films
    (paired). ``near`` (a, b) are the targets' usable neighbours, or (user_id, n_neighbours) their numbers. Targets need ``least_test`` films in the test part and
    among the scored ones, and ``least_train`` in the other part."""
    base = split.groupBy("user_id").agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if(F.col("is_test")).alias("n_test"), F.avg(F.when(~F.col("is_test"), F.col("rating"))).alias("mu"))
    base = base.where((F.col("n_test") >= least_test) & (F.col("n_train") >= least_train))
    mean = cf.join(base.select("user_id", "mu"), "user_id").select("user_id", "film", F.col("mu").alias("pred"), "actual")
    out = base.drop("mu").join(errors(cf, ["user_id"]).select("user_id", F.col("n").alias("n_scored"), F.col("rmse").alias("rmse_cf")), "user_id")
    out = out.join(errors(mean, ["user_id"]).select("user_id", F.col("rmse").alias("rmse_user")), "user_id")
    out = out.join(areas(cf, ["user_id"]).select("user_id", F.col("auc").alias("auc_cf")), "user_id").join(areas(mean, ["user_id"]).select("user_id", F.col("auc").alias("auc_user")), "user_id")
    if "n_neighbours" not in near.columns:
        near = near.groupBy(F.col("a").alias("user_id")).agg(F.count("*").alias("n_neighbours"))
    out = out.join(near, "user_id")
    return out.where(F.col("n_scored") >= least_test).withColumn("coverage", six(share(F.col("n_scored"), F.col("n_test"))))


def cohort_distribution(rows: DataFrame) -> DataFrame:
    """(metric, n, median, lower, upper, wins, good) over targets with an AUC: quartiles are elements n//4 and 3n//4."""
    ok = rows.where("auc_cf is not null and auc_user is not null")
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("v")) for k in ("auc_cf", "auc_user", "coverage", "n_neighbours")]))
    long = ok.select(values.alias("x"), (F.col("auc_cf") > F.col("auc_user")).alias("won"), (F.col("auc_cf") > 0.7).alias("good")).select("x.metric", "x.v", "won", "good")
    sums = long.groupBy("metric").agg(F.count("*").alias("n"), six(F.median("v")).alias("median"), F.count_if(F.col("won")).alias("wins"), F.count_if(F.col("good")).alias("good"))
    return sums.join(elements(long, "metric", "v", {"lower": 0.25, "upper": 0.75}), "metric")
