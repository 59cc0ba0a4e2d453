"""Users of equal histories: they are worked out once, count for all of them, and lie side by side in what is written."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import models, similarity


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def copied(spark):
    """Some histories of one to five users each; of two users with equal ratings, one has other tests."""
    rng = random.Random(12)
    rated = []
    for h in range(24):
        own = [(f, rng.randint(1, 10) / 2, rng.random() < 0.3) for f in [*rng.sample(range(12), 9), *rng.sample(range(12, 60), 4)]]
        rated += [(h + 100 * c, f, r, t if c else not t) for c in range(h % 5 + 1) for f, r, t in own]
    rated += [(u, f, f % 4 + 1.0, f == 100) for u in (5_000, 5_001, 5_002) for f in range(100, 108)]
    return spark.createDataFrame(rated, "user_id long, film int, rating double, is_test boolean")


@pytest.mark.parametrize(("limit", "block"), [(1 << 20, 512), (300, 16), (0, 7)])
def test_copies_count_for_all(spark, copied, monkeypatch, limit, block):
    for name, value in (("FILM_PAIRS", limit), ("USERS_PER_BLOCK", block), ("USERS_AT_ONCE", (5, 3))):
        monkeypatch.setattr(similarity, name, value)
    history = copied.drop("is_test")
    near = similarity.weights(copied.where("not is_test"), history, 3)
    sums = similarity.neighbour_sums(copied, history, 3)
    assert rows(sums.where("film is null").select("a", "n")) == rows(near.groupBy("a").count())
    assert rows(models.neighbour_cf(copied, history, 3, sums=sums)) == rows(models.neighbour_cf(copied, history, near=near))
    seeds = spark.createDataFrame([(0,), (13,)], "film int")
    pairs = similarity.percentile_agreement(history, seeds, 1)
    want = pairs.groupBy(similarity.verdict(F.col("r"), F.col("n_common"), 8).alias("verdict")).count()
    assert rows(similarity.verdict_counts(history, seeds, 8)) == rows(want)
    mark = F.col("is_test")
    pairs = similarity.pair_sums(copied, sums=["n", "r", "marked"], mark=mark)
    r = F.when(F.col("n") >= 4, F.col("r"))
    each = [F.count("*"), F.count(r), F.count_if(r >= 0.5), F.count_if(r <= -0.4), F.coalesce(F.sum(r), F.lit(0.0)), F.coalesce(F.sum(F.abs(r)), F.lit(0.0))]
    assert rows(similarity.pair_levels(copied, mark, 2, 4)) == rows(pairs.groupBy(F.least("marked", F.lit(2)), "n").agg(*each))


def test_copies_are_worked_out_once(spark, copied):
    cells, members = similarity.collapsed(similarity.cells_of(copied, "rating", F.lit(False)))
    assert cells.select("u").distinct().count() == 25 and cells.groupBy("u").agg(F.first("copies").alias("n")).agg(F.sum("n")).first()[0] == members.count() == 73


def test_results_of_copies_lie_side_by_side(spark, monkeypatch):
    """40 histories of 16 users each: a run of equal correlations is of 16 pairs, and not of a few by chance."""
    monkeypatch.setattr(similarity, "FILM_PAIRS", 0)
    rng = random.Random(13)
    histories = [[(f, rng.randint(1, 10) / 2) for f in range(20)] for _ in range(40)]
    frame = spark.createDataFrame([(c * 40 + h, f, r) for h, own in enumerate(histories) for c in range(16) for f, r in own], "user_id long, film int, rating double")
    found = [r["r"] for r in similarity.correlated(similarity.pair_sums(frame, sums=["n", "r"]), 1).collect()]
    assert len(found) == 640 * 639 // 2
    assert sum(x != y for x, y in zip(found, found[1:], strict=False)) < len(found) / 5


def test_only_the_ends_leave_a_tile(spark, copied, monkeypatch):
    """Of twins and mirrors only the best of each tile come out; the best of all are among them, ties included."""
    monkeypatch.setattr(similarity, "FILM_PAIRS", 0)
    pairs = [similarity.pair_sums(copied, sums=["n", "r"], least=5, far=True, ends=ends) for ends in (None, (15, 10))]
    assert pairs[1].count() < pairs[0].count() / 2
    for order in ((F.desc("r"), "a", "b"), ("r", "a", "b")):
        assert len({tuple(map(tuple, x.withColumn("r", F.round("r", 6)).orderBy(*order).limit(10).collect())) for x in pairs}) == 1
