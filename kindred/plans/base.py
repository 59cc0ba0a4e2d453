"""The frames that the queries share, built lazily from the tables of one folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import checkpoints
from kindred.operators import metrics, models, ratings, similarity

#: BUDGET is a percentage of the eligible films' pages.
MAX_PAGES, MIN_POOL, BUDGET, SEED = 2_000, 3, 20, 7
FRIENDS = 15


class Base:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)

    @cached_property
    def feed(self) -> DataFrame:
        return ratings.feed(self.table("events"))

    @cached_property
    def ratings(self) -> DataFrame:
        return ratings.merged(self.feed)

    @cached_property
    def hist(self) -> DataFrame:
        return ratings.film_histogram(self.ratings)

    @cached_property
    def catalogue(self) -> DataFrame:
        return ratings.catalogue(self.hist)

    @cached_property
    def crowd(self) -> DataFrame:
        return ratings.crowd(self.hist)

    @cached_property
    def planned(self) -> DataFrame:
        return ratings.chosen(ratings.eligible(ratings.with_idf(self.catalogue), MAX_PAGES, MIN_POOL), percent=BUDGET)

    @cached_property
    def seeds(self) -> DataFrame:
        return self.planned.where("chosen").select("film", "idf")

    @cached_property
    def candidates(self) -> DataFrame:
        return ratings.candidates(ratings.seed_edges(self.feed, self.ratings, self.seeds))

    @cached_property
    def first_user(self) -> DataFrame:
        return self.ratings.agg(F.min("user_id").alias("user_id"))

    @cached_property
    def mine(self) -> DataFrame:
        """One member's ratings of the seeds: those of the smallest id."""
        return self.ratings.join(self.seeds, "film", "left_semi").join(self.first_user, "user_id", "left_semi").select("film", F.col("rating").alias("my_rating"))

    @cached_property
    def split(self) -> DataFrame:
        return ratings.recent_split(self.ratings, self.feed, self.seeds)

    @cached_property
    def agreement(self) -> DataFrame:
        return similarity.percentile_agreement(self.ratings, self.seeds)

    @cached_property
    def cf(self) -> DataFrame:
        return checkpoints.cut(models.neighbour_cf(self.split, self.ratings, sums=self.neighbour_sums))

    @cached_property
    def neighbour_sums(self) -> DataFrame:
        return checkpoints.cut(similarity.neighbour_sums(self.split, self.ratings))

    @cached_property
    def near(self) -> DataFrame:
        """(user_id, n_neighbours) of targets that have any."""
        return self.neighbour_sums.where("film is null").select(F.col("a").alias("user_id"), F.col("n").alias("n_neighbours"))

    @cached_property
    def baselines(self) -> DataFrame:
        return models.baselines(self.split, self.crowd)

    @cached_property
    def predictions(self) -> DataFrame:
        cf = self.cf.select(F.lit("neighbour cf").alias("model"), "user_id", "film", "pred", "actual")
        return self.baselines.unionByName(cf)

    @cached_property
    def parts(self) -> DataFrame:
        return ratings.random_split(self.ratings, {"train": 0.7, "cal": 0.85, "test": 1.0}, SEED)

    @cached_property
    def scored(self) -> DataFrame:
        """(user_id, film, part, score, label): bias predictions for the calibration and test parts."""
        rows = models.bias_predictions(self.parts.where("part = 'train'"), self.parts.where("part <> 'train'"))
        return checkpoints.cut(rows.select("user_id", "film", "part", F.col("pred").alias("score"), (F.col("rating") >= metrics.LIKED).cast("int").alias("label")))

    @cached_property
    def naive(self) -> DataFrame:
        rows = self.scored.where("part = 'test'")
        each = F.explode(F.array(F.struct(F.lit("linear").alias("model"), ((F.col("score") - 1) / 4).alias("p")), F.struct(F.lit("sigmoid").alias("model"), (1 / (1 + F.exp(-(F.col("score") - 3.5)))).alias("p"))))
        return rows.select("user_id", "film", "label", each.alias("m")).select("user_id", "film", "label", "m.model", "m.p")

    @cached_property
    def arms(self) -> DataFrame:
        """Pairs summed up by arm, which is how many rated seeds they share, and by common films."""
        rated = self.ratings.join(self.seeds.select("film", F.lit(True).alias("seed")), "film", "left")
        levels = similarity.pair_levels(rated, F.col("seed"), 3, 8)
        arm = F.when(F.col("marked") >= 3, "treatment").when(F.col("marked") == 1, "control").when(F.col("marked") == 2, "between").otherwise("none")
        return levels.withColumn("arm", arm)

    @cached_property
    def follows(self) -> DataFrame:
        """A follow graph by rule, as the tables hold none: (src, dst, place, n_films)."""
        users = self.feed.groupBy("user_id").agg(F.count_distinct("film").alias("n_films"))
        n = users.agg((F.max("user_id") + 1).alias("n"))
        edges = users.select(F.col("user_id").alias("src")).crossJoin(F.broadcast(n)).withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(FRIENDS))))
        edges = edges.select("src", F.pmod(F.col("src") * 7 + F.col("place") * 13, F.col("n")).alias("dst"), "place").where("src <> dst")
        return edges.join(users.select(F.col("user_id").alias("dst"), "n_films"), "dst").select("src", "dst", "place", "n_films")
