"""Hand-computed figures, invariants and brute force for the rating operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.aggregates import elements, midrank, pearson
from kindred.functions.columns import address
from kindred.operators import metrics, models, ratings, similarity
from kindred.streaming import pages as stream


def test_midrank(spark):
    rows = spark.createDataFrame([(1, float(r)) for r in (1, 2, 2, 3)] + [(2, 5.0)], "user_id int, rating double")
    assert [r["pct"] for r in rows.withColumn("pct", midrank(["user_id"], "rating")).where("user_id = 1").orderBy("rating").collect()] == [0, 0.5, 0.5, 1]
    assert similarity.percentiles(rows).where("user_id = 2").count() == 0


def test_pearson_guards(spark):
    rows = spark.createDataFrame([("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 1.0, 2.0), ("up", 1.0, 2.0), ("up", 2.0, 4.0)], "k string, x double, y double")
    assert {r["k"]: r["r"] for r in rows.groupBy("k").agg(F.round(pearson("x", "y"), 9).alias("r")).collect()} == {"flat": None, "one": None, "up": 1.0}


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(rng.integers(0, 5)), float(rng.choice([3.0, 4.5]))) for g in range(20) for i in range(int(rng.integers(1, 12)))]
    got = {r["user_id"]: r["auc"] for r in metrics.areas(spark.createDataFrame(rows, "user_id int, film int, pred double, actual double"), ["user_id"]).collect()}
    for g in range(20):
        pos = [p for u, _, p, a in rows if u == g and a >= 4]
        neg = [p for u, _, p, a in rows if u == g and a < 4]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert got[g] == (None if want is None else pytest.approx(want, abs=1e-6))


def test_constant_predictor_has_half(spark):
    rows = spark.createDataFrame([("m", i, 3.0, 5.0 if i % 3 else 1.0) for i in range(9)], "model string, film int, pred double, actual double")
    assert metrics.areas(rows, ["model"]).first()["auc"] == 0.5


def test_fisher(spark):
    rows = spark.createDataFrame([(6, 71, 5, 72), (20, 57, 5, 72), (0, 0, 5, 5), (3, 0, 0, 3)], "a long, b long, c long, d long")
    assert {tuple(r)[:4]: r["p"] for r in metrics.fisher(rows, "a", "b", "c", "d").collect()} == {(6, 71, 5, 72): 1.0, (20, 57, 5, 72): 0.001764, (0, 0, 5, 5): 1.0, (3, 0, 0, 3): 0.1}


def test_budget_is_greedy(spark):
    rng = np.random.default_rng(8)
    for _ in range(5):
        costs = rng.integers(1, 40, 12).tolist()
        films = spark.createDataFrame([(i, c, True) for i, c in enumerate(costs)], "film int, pages_ge4 int, eligible boolean")
        got, spent, want = {r["film"] for r in ratings.chosen(films, 60).where("chosen").collect()}, 0, set()
        for c, i in sorted((c, i) for i, c in enumerate(costs)):
            if spent + c <= 60:
                want.add(i)
                spent += c
        assert got == want


def test_verdicts_and_pages(spark):
    rows = spark.createDataFrame([(0.5, 9), (-0.4, 9), (0.49, 9), (None, 9), (0.9, 2)], "r double, n int")
    assert [r[0] for r in rows.select(similarity.verdict(F.col("r"), F.col("n"), 8)).collect()] == ["twin", "mirror", "unrelated", "unrelated", "insufficient"]
    from kindred.functions.columns import pages_for

    assert [r[0] for r in spark.createDataFrame([(25,), (26,)], "n int").select(pages_for(F.col("n"), 25)).collect()] == [1, 2]


def test_merge_precedence(spark):
    rows = [(1, 7, 2.0, 1), (1, 7, 3.0, 2), (1, 7, 5.0, 30), (1, 8, 4.0, 25), (1, 8, 1.0, 28), (1, 9, None, 3)]
    entries = spark.createDataFrame(rows, "user_id int, film int, rating double, pos int").withColumn("ts", F.col("pos"))
    assert sorted((r["film"], r["rating"], r["source"]) for r in ratings.merged(entries).collect()) == [(7, 3.0, "feed"), (8, 4.0, "grid")]


def test_profile_of_nobody(spark):
    entries = spark.createDataFrame([(1, None), (2, 3.0), (2, 3.0)], "user_id int, rating double")
    rows = {r["user_id"]: r for r in ratings.profile(entries).collect()}
    assert (rows[1]["reason"], rows[1]["mean"], rows[1]["usable"]) == ("no ratings at all", None, False)
    assert rows[2]["reason"] == "sd too low; single value; few ratings"


def test_neighbours_by_hand(spark):
    history = [(1, f, r) for f, r in enumerate([1, 2, 3, 4, 5, 3])] + [(2, f, r) for f, r in enumerate([1, 2, 3, 4, 5, 5])]
    history = spark.createDataFrame([(u, f, float(r)) for u, f, r in history], "user_id int, film int, rating double")
    split = history.where("user_id = 1").withColumn("is_test", F.col("film") == 5)
    row = models.neighbour_cf(split, history).first()
    assert row["raw"] == pytest.approx(3.0 + (5 - 20 / 6)) and row["pred"] == pytest.approx(3.0 + 5 / 3)


def test_splits_cover(spark):
    rows = spark.createDataFrame([(u, f, float(f % 5), f) for u in range(30) for f in range(40)], "user_id long, film int, rating double, ts int")
    assert {r["part"]: r["count"] for r in ratings.random_split(rows, {"a": 0.33, "b": 0.5, "c": 1.0}, 3).groupBy("part").count().collect()} == {"a": 396, "b": 204, "c": 600}
    assert ratings.holdout(rows, 10, 25, 1).where("is_test").count() == 300 and ratings.holdout(rows, 10, 41, 1).where("is_test").count() == 0
    assert ratings.last_out(rows).where("is_test").select("film").distinct().collect()[0][0] == 39
    assert ratings.random_out(rows, 1).where("is_test").count() == 30


def test_temporal_split_is_exact(spark):
    times = [None, *["2024-01-01 00:00:00"] * 60, *[f"2024-01-0{d} 00:00:0{d}" for d in range(2, 9)]]
    rows = spark.createDataFrame([(u, 1, t) for u, t in enumerate(times)], "user_id long, film int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = ratings.temporal_split(rows, 0.5).where("is_test").select("user_id").collect()
    assert {r["user_id"] for r in got} == set(range(34, 68))  # ties at the cut go by user
    assert ratings.temporal_split(rows.limit(0)).count() == 0


def test_large_groups_have_the_same_areas(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(m, float(p), float(a)) for m in "ab" for p, a in zip(rng.normal(3, 2, 400).round(2), rng.choice([3.0, 4.0], 400), strict=True)], "model string, pred double, actual double")
    assert sorted(metrics.areas(rows, ["model"]).collect()) == sorted(metrics.areas(rows, ["model"], large=True).collect())


def test_elements(spark):
    rows = spark.createDataFrame([("a", x) for x in (5.0, 1.0, 3.0, 3.0, None)] + [("b", 2.0)], "k string, v double")
    assert sorted(map(tuple, elements(rows, "k", "v", {"low": 0.25, "mid": 0.5, "top": 0.9}).collect())) == [("a", 3.0, 3.0, 5.0), ("b", 2.0, 2.0, 2.0)]


def test_budget_runs_over_blocks(spark):
    rows = [(f, int(p)) for f, p in enumerate(np.random.default_rng(6).integers(1, 6, 3500))]
    films = spark.createDataFrame(rows, "film int, pages_ge4 long").withColumn("eligible", F.col("film") % 3 > 0)
    running, want = 0, {}
    for f, p in sorted((r for r in rows if r[0] % 3), key=lambda r: (r[1], r[0])):
        running += p
        want[f] = (running, running <= 700)
    assert {r["film"]: (r["running"], r["chosen"]) for r in ratings.chosen(films, 700).where("eligible").collect()} == want


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(3.5, 0.8, 300).round(2)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * (x - 3.7)))).astype(int)
    return x, y, spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "score double, label int")


def test_platt_against_newton(scores):
    x, y, rows = scores
    design, w = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1.0, 0.0]), design.T @ (p - y) + [w[0], 0.0])
    for r in models.platt(rows, rows).select("score", "p").collect():
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-(w[0] * r["score"] + w[1]))), abs=1e-3)


def test_isotonic_against_pooling(scores):
    x, y, rows = scores
    pools = []
    for v in np.unique(x):
        pools.append([y[x == v].mean(), (x == v).sum(), [v]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, n, own = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + m * n) / (pools[-1][1] + n), pools[-1][1] + n, pools[-1][2] + own]
    want = {v: m for m, _, own in pools for v in own}
    for r in models.isotonic(rows, rows).select("score", "p").collect():
        assert r["p"] == pytest.approx(want[r["score"]], abs=1e-9)


def test_factors_learn_what_biases_cannot(spark):
    """Two tastes with opposite views of two kinds of films: biases see nothing, factors do."""
    rows = spark.createDataFrame([(u, f, 4.5 if u % 2 == f % 2 else 1.5) for u in range(20) for f in range(20) if (u * 7 + f * 3) % 5], "user_id long, film int, rating double")
    asked = spark.createDataFrame([(u, f, 4.5 if u % 2 == f % 2 else 1.5) for u in range(20) for f in range(20) if (u * 7 + f * 3) % 5 == 0], "user_id long, film int, rating double")
    error = lambda df: df.agg(F.sqrt(F.avg((F.col("pred") - F.col("rating")) ** 2))).first()[0]
    assert error(models.factorised(rows, asked)) < 0.3 < 1.0 < error(models.bias_predictions(rows, asked))


def test_addresses(spark):
    parts = {"user": F.lit("ann"), "film": F.lit("alpha"), "sort": F.lit("activity"), "stars": F.lit(0.5), "page": F.lit(2)}
    got = spark.range(1).select(*[address(kind, "https://s.example", **parts).alias(kind) for kind in ("feed", "films", "rated", "histogram")], address("likes", "", film=F.lit("x"), page=F.lit(1)).alias("first")).first()
    assert tuple(got) == ("https://s.example/ann/rss/", "https://s.example/ann/films/page/2/", "https://s.example/film/alpha/members/rated/%C2%BD/page/2/", "https://s.example/csi/film/alpha/rating-histogram/", "/film/x/likes/")


def test_daily_counts_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-02 03:00:00", "b")], "ts string, event_type string")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = stream.daily_counts(source).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["event_type"], r["n"]) for r in spark.table("daily").collect()) == [("a", 2), ("b", 1)]


def test_member_pages_stream(spark, tmp_path):
    from kindred.sources.pages import PAGE

    body = '<a href="/ann/" class="name">Ann</a>'
    rows = [("https://s.example/1/", 200, body, "http", 1.0), ("https://s.example/1/", 200, body, "http", 2.0), ("https://s.example/2/", 404, body, "http", 3.0)]
    spark.createDataFrame(rows, PAGE).coalesce(1).write.json(str(tmp_path / "in"))
    query = stream.keep_members(stream.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["url"], r["username"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("https://s.example/1/", "ann")]
