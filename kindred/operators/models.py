"""Rating models: baselines, shrunk biases, neighbours, factorisation and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.checkpoints import cut
from kindred.functions.columns import clamp
from kindred.operators.calibration import isotonic, platt  # noqa: F401  (two of the calibration models)
from kindred.operators.ratings import SLICES, placed
from kindred.operators.similarity import neighbour_sums

LOW, HIGH = 0.5, 5.0
ITEM_SHRINK, USER_SHRINK = 25, 10


def baselines(split: DataFrame, crowd: DataFrame) -> DataFrame:
    """(model, user_id, film, pred, actual) of the test rows for four baselines; models with the crowd skip films that
    it doesn't know. The global mean is the unweighted mean of the films' averages."""
    mean = split.where("not is_test").groupBy("user_id").agg(F.avg("rating").alias("mu"))
    overall = crowd.agg(F.avg("lb_avg").alias("overall"))
    rows = split.where("is_test").join(mean, "user_id").join(crowd, "film", "left").crossJoin(F.broadcast(overall))
    named = {"global mean": F.col("overall"), "user mean": F.col("mu"), "crowd average": F.col("lb_avg"), "user + crowd": F.col("mu") + F.col("lb_avg") - F.col("overall")}
    models = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("pred")) for k, v in named.items()]))
    return rows.select("user_id", "film", F.col("rating").alias("actual"), models.alias("m")).select("m.model", "user_id", "film", "m.pred", "actual").where("pred is not null")


def neighbour_cf(split: DataFrame, history: DataFrame, least: int = 5, least_r: float = 0.15, least_neighbours: int = 1, near: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """(user_id, film, raw, pred, actual): mean of the target plus the weighted mean of its neighbours' deviations.
    Weights come from training films (or are given as ``near``, or their sums as ``sums``, by ``neighbour_sums``); neighbours'
    means from their whole history. ``raw`` is before clamping."""
    train, test = split.where("not is_test"), split.where("is_test")
    mean = train.groupBy(F.col("user_id").alias("a")).agg(F.avg("rating").alias("mu"))
    asked = test.select(F.col("user_id").alias("a"), "film", F.col("rating").alias("actual"))
    if near is None:
        sums = neighbour_sums(split, history, least, least_r) if sums is None else sums
        found = asked.join(sums.where("film is not null"), ["a", "film"])
    else:
        theirs = history.groupBy(F.col("user_id").alias("b")).agg(F.avg("rating").alias("nu"))
        said = history.select(F.col("user_id").alias("b"), "film", "rating").join(theirs, "b").select("b", "film", (F.col("rating") - F.col("nu")).alias("d"))
        found = asked.join(near, "a").join(said, ["b", "film"]).groupBy("a", "film", "actual").agg(F.count("*").alias("n"), F.sum(F.abs("w")).alias("norm"), F.sum(F.col("w") * F.col("d")).alias("moved"))
    found = found.where((F.col("n") >= least_neighbours) & (F.col("norm") > 0)).join(mean, "a")
    raw = F.col("mu") + F.col("moved") / F.col("norm")
    return found.select(F.col("a").alias("user_id"), "film", raw.alias("raw"), clamp(raw, LOW, HIGH).alias("pred"), "actual")


def blended(cf: DataFrame, baseline: DataFrame) -> DataFrame:
    """Half the unclamped neighbour prediction, half the baseline's, clamped."""
    base = baseline.where("model = 'user + crowd'").select("user_id", "film", F.col("pred").alias("base"))
    return cf.join(base, ["user_id", "film"]).select("user_id", "film", clamp(0.5 * F.col("base") + 0.5 * F.col("raw"), LOW, HIGH).alias("pred"), "actual")


def biases(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mu), (film, bi) and (user_id, bu): shrunk item biases, then shrunk user biases of what they leave."""
    mu = train.agg(F.avg("rating").alias("mu"))
    rows = train.crossJoin(F.broadcast(mu))
    bi = rows.groupBy("film").agg((F.sum(F.col("rating") - F.col("mu")) / (F.count("*") + ITEM_SHRINK)).alias("bi"))
    bu = rows.join(bi, "film").groupBy("user_id").agg((F.sum(F.col("rating") - F.col("mu") - F.col("bi")) / (F.count("*") + USER_SHRINK)).alias("bu"))
    return mu, bi, bu


def bias_predictions(train: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with pred = mu + bu + bi; unknown users and films add nothing."""
    mu, bi, bu = biases(train)
    rows = asked.join(bi, "film", "left").join(bu, "user_id", "left").crossJoin(F.broadcast(mu))
    return rows.withColumn("pred", F.col("mu") + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0))).drop("mu", "bu", "bi")


def indexed(rows: DataFrame, key: str) -> DataFrame:
    """(key, _n): the distinct keys, of any type, with numbers that fit an integer; by slices, so no task sees all keys."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    slice_of = F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int")
    return placed(keys, slice_of, key).select(key, F.col("place").cast("int").alias("_n"))


def factorised(train: DataFrame, asked: DataFrame, rank: int = 32, reg: float = 0.05, seed: int = 0) -> DataFrame:
    """Bias model plus alternating least squares on its residuals. Ids may be of any type and size."""
    from pyspark.ml.recommendation import ALS

    users, films = (cut(indexed(train, key)) for key in ("user_id", "film"))

    def numbered(df: DataFrame) -> DataFrame:
        return df.join(users.withColumnRenamed("_n", "_u"), "user_id", "left").join(films.withColumnRenamed("_n", "_f"), "film", "left")

    residuals = numbered(bias_predictions(train, train)).withColumn("residual", (F.col("rating") - F.col("pred")).cast("float"))
    model = ALS(rank=rank, regParam=reg, userCol="_u", itemCol="_f", ratingCol="residual", seed=seed, coldStartStrategy="nan").fit(residuals)
    rows = numbered(bias_predictions(train, asked)).fillna(-1, ["_u", "_f"])  # strangers have no factors
    out = model.setPredictionCol("factor").transform(rows)
    return out.withColumn("pred", F.col("pred") + F.coalesce(F.nanvl(F.col("factor"), F.lit(0.0)), F.lit(0.0))).drop("factor", "_u", "_f")


def temperature(cal: DataFrame, rows: DataFrame, score: str = "score", label: str = "label", middle: float = 3.5, steps: int = 400) -> DataFrame:
    """``rows`` with p = sigmoid((score - middle) / T), T the best of a logarithmic grid from 0.05 to 20 by log loss over
    the calibration rows. They are counted by score (to four decimals) and label before the grid multiplies them."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.exp(F.lit(-2.995732) + i * (5.991465 / steps)))
    counts = cal.groupBy(F.round(score, 4).alias("s"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    p = clamp(1 / (1 + F.exp(-(F.col("s") - middle) / F.col("t"))), 1e-6, 1 - 1e-6)
    loss = F.sum(-F.col("n") * F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p)))
    best = counts.select("s", "y", "n", F.explode(grid).alias("t")).groupBy("t").agg(loss.alias("loss")).agg(F.min_by("t", "loss").alias("t"))
    return rows.crossJoin(F.broadcast(best)).withColumn("p", 1 / (1 + F.exp(-(F.col(score) - middle) / F.col("t")))).drop("t")
