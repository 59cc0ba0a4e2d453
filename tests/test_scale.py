"""Operators that must hold for hot films, hubs, wide margins and many fits at once, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import calibration, graph, metrics, models, ratings, similarity


def pearson(x, y):
    if len(x) < 2 or np.std(x) * np.std(y) < 1e-12:
        return None
    return float(np.corrcoef(x, y)[0, 1])


@pytest.fixture(scope="module")
def hot(spark):
    """One film that everybody rated, some popular ones, and many that few rated; one user gives the same stars always."""
    rng = random.Random(2)
    rated = {u: {0: rng.randint(1, 10) / 2} | {f: rng.randint(1, 10) / 2 for f in range(1, 12) if rng.random() < 0.6} | {rng.randint(12, 300): 3.5 for _ in range(6)} for u in range(70)}
    rated[5] = {f: 4.0 for f in rated[5]}
    rows = [(u, f, r) for u, own in rated.items() for f, r in own.items()]
    return rated, spark.createDataFrame(rows, "user_id long, film int, rating double")


@pytest.mark.parametrize(("limit", "block", "films"), [(4_096, 512, 1_024), (40, 16, 4), (0, 8, 1_000), (100, 1_000, 7)])
def test_pairs_with_hot_films(hot, monkeypatch, limit, block, films):
    rated, frame = hot
    for name, value in (("FILM_PAIRS", limit), ("USERS_PER_BLOCK", block), ("FILMS_AT_ONCE", films)):
        monkeypatch.setattr(similarity, name, value)
    got = {(r["a"], r["b"]): (r["n_common"], r["r"]) for r in similarity.correlated(similarity.pair_sums(frame), 1).collect()}
    want = {}
    for a in rated:
        for b in rated:
            if a < b and (common := sorted(rated[a].keys() & rated[b].keys())):
                want[a, b] = len(common), pearson([rated[a][f] for f in common], [rated[b][f] for f in common])
    assert got.keys() == want.keys()
    for pair, (n, r) in want.items():
        assert got[pair][0] == n and got[pair][1] == (None if r is None else pytest.approx(r, abs=1e-9))
    assert {tuple(r) for r in similarity.pair_counts(frame).collect()} == {(a, b, n) for (a, b), (n, _) in want.items()}
    some = frame.where("user_id % 9 = 0 and film % 2 = 0")
    both = {(r["a"], r["b"]): r["n"] for r in similarity.pair_sums(some, frame, ordered=False).collect()}
    assert both == {(a, b): n for a in rated if a % 9 == 0 for b in rated if a != b and (n := len([f for f in rated[a].keys() & rated[b].keys() if f % 2 == 0]))}


def test_pairs_of_nothing(spark):
    assert similarity.pair_sums(spark.createDataFrame([], "user_id long, film int, rating double")).count() == 0


def hops(edges):
    found = {}
    edges = set(edges)
    for a, b in edges:
        for c, d in edges:
            if b == c and a != d and (a, d) not in edges:
                found[a, d] = found.get((a, d), 0) + 1
    return found


@pytest.mark.parametrize("paths", [1 << 18, 30, 1])
def test_two_hops(spark, paths):
    rng = random.Random(4)
    edges = [(rng.randint(0, 25), rng.choice([0, rng.randint(0, 25)])) for _ in range(150)] + [(0, i) for i in range(20)]
    edges = [e for e in edges if e[0] != e[1]]
    frame = spark.createDataFrame([*edges, (3, None), (None, 4)], "src long, dst long")
    assert {(r["src"], r["dst"]): r["paths"] for r in graph.two_hops(frame, paths).collect()} == hops(edges)


def test_a_hub_is_split(spark):
    """A member with 100,000 friends and 300 followers: no group makes more than a few times the paths it may."""
    hub = spark.range(100_000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    fans = spark.range(300).select((F.col("id") + 1_000_000).alias("src"), F.lit(-1).cast("long").alias("dst"))
    into, out = graph.through(hub.unionByName(fans))
    key = ["mid", "_i", "_j"]
    most = into.groupBy(*key).agg(F.count("*").alias("n")).join(out.groupBy(*key).agg(F.count("*").alias("m")), key).agg(F.max(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m"))).first()
    assert most[1] == 300 * 100_000 and most[0] < 4 * graph.PATHS


def fisher(a, b, c, d):
    """All tables of the margins, weighed from the likeliest one; slow but plain."""
    r, k, n = a + b, a + c, a + b + c + d
    low, high = max(0, r + k - n), min(r, k)
    logs = [math.lgamma(r + 1) - math.lgamma(i + 1) - math.lgamma(r - i + 1) + math.lgamma(n - r + 1) - math.lgamma(k - i + 1) - math.lgamma(n - r - k + i + 1) for i in range(low, high + 1)]
    top = max(logs)
    w = [math.exp(x - top) for x in logs]
    return sum(x for x in w if x <= w[a - low] + 1e-12 * sum(w)) / sum(w)


def test_fisher_against_all_tables(spark):
    rng = random.Random(6)
    tables = [tuple(rng.choice([0, 1, 3, 9, 40, 400]) + rng.randint(0, 3) for _ in range(4)) for _ in range(60)] + [(0, 0, 0, 0), (1, 0, 0, 0), (0, 5, 5, 0), (6, 71, 5, 72), (20, 57, 5, 72), (3000, 2900, 3100, 3050)]
    frame = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in metrics.fisher(frame, "a", "b", "c", "d").collect():
        assert r["p"] == pytest.approx(fisher(*tuple(r)[:4]), abs=2e-6)


def test_fisher_of_wide_margins(spark):
    """Margins of ten millions: close to the normal approximation with its correction, and certain at the ends."""
    even, off = 5_000_000, 3_000
    tables = [(even, even, even, even), (even + off, even - off, even - off, even + off), (even + 200_000, even - 200_000, even, even), (10_000_000, 0, 0, 10_000_000)]
    got = [r["p"] for r in metrics.fisher(spark.createDataFrame(tables, "a long, b long, c long, d long"), "a", "b", "c", "d").collect()]
    z = (off - 0.5) / math.sqrt(even / 4)  # the variance of four equal margins
    assert got[0] == 1.0 and got[2:] == [0.0, 0.0]
    assert got[1] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def newton(x, y):
    w = np.array([0.0, 0.0])
    design = np.column_stack([x, np.ones_like(x)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1.0, 0.0]), design.T @ (p - y) + [w[0], 0.0])
    return w


def pooling(x, y):
    pools = []
    for v in np.unique(x):
        pools.append([y[x == v].mean(), (x == v).sum(), v, v])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0] - 1e-12:
            m, n, _, hi = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + m * n) / (pools[-1][1] + n), pools[-1][1] + n, pools[-1][2], hi]
    knots = [(at, m) for m, _, lo, hi in pools for at in ((lo,) if lo == hi else (lo, hi))]
    return np.array(knots).T


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_many_fits_at_once(spark, monkeypatch, slices):
    monkeypatch.setattr(calibration, "SLICES", slices)
    rng = np.random.default_rng(8)
    groups = {g: (rng.normal(3.5, 1 + g / 4, n).round(1 + g % 3), None) for g, n in enumerate((40, 300, 1_000, 5))}
    groups = {g: (x, (rng.random(len(x)) < 1 / (1 + np.exp(-(g + 0.5) * (x - 3.5)))).astype(int)) for g, (x, _) in groups.items()}
    groups[4] = (np.array([1.0, 2.0, 3.0]), np.array([1, 1, 1]))
    groups[5] = (np.array([2.0]), np.array([0]))
    cal = spark.createDataFrame([(g, float(a), int(b)) for g, (x, y) in groups.items() for a, b in zip(x, y, strict=True)] + [(0, None, 1), (0, 2.0, None)], "g int, score double, label int")
    asked = [(g, s) for g in groups for s in (-3.0, 1.05, 2.0, 3.33, 3.5, 4.7, 11.0)]
    rows = spark.createDataFrame(asked, "g int, score double")
    platt = {(r["g"], r["score"]): r["p"] for r in calibration.platt(cal, rows, ["g"]).collect()}
    stairs = {(r["g"], r["score"]): r["p"] for r in calibration.isotonic(cal, rows, ["g"]).collect()}
    for g, (x, y) in groups.items():
        knots = pooling(x, y)
        for s in (-3.0, 1.05, 2.0, 3.33, 3.5, 4.7, 11.0):
            assert stairs[g, s] == pytest.approx(np.interp(s, *knots), abs=1e-9)
            if 0 < y.mean() < 1:
                w = newton(x, y)
                assert platt[g, s] == pytest.approx(1 / (1 + np.exp(-(w[0] * s + w[1]))), abs=1e-6)
            else:
                assert (g, s) not in platt


def test_samples_grow_within_each_other(spark):
    rows = spark.range(1, 11).select(F.col("id").alias("place"))
    assert sorted(tuple(r) for r in calibration.by_size(rows, [2, 5, 50]).groupBy("size").count().collect()) == [(2, 2), (5, 5), (50, 10)]


def screen(users, want):
    out, found, spent = [], 0, 0
    for place, (fo, f, ro, r, ao, a) in users:
        if found >= want:
            break
        steps = [fo and f is not None and f >= 5, ro and r is not None and r >= 8, ao and a is not None and a >= 50]
        requests = 1 + bool(steps[0]) + bool(steps[0] and steps[1])
        spent, found = spent + requests, found + all(steps)
        out.append((place, requests, all(steps), spent, found))
    return out


def test_screening_stops_in_time(spark, monkeypatch):
    monkeypatch.setattr(ratings, "SCREENED_PER_BLOCK", 7)
    rng = random.Random(9)
    users = [(i + 1, (rng.random() < 0.9, rng.choice([None, 3, 5, 9]), rng.random() < 0.9, rng.randint(5, 15), rng.random() < 0.9, rng.randint(40, 70))) for i in range(200)]
    frame = spark.createDataFrame([(p, *v) for p, v in users], "place long, friends_ok boolean, n_friends long, recent_ok boolean, n_recent long, rated_ok boolean, n_rated long")
    for want in (0, 1, 5, 12, 500):
        got = [tuple(r) for r in ratings.prescreened(frame, want).select("place", "requests", "eligible", "spent", "found").orderBy("place").collect()]
        assert got == screen(users, want)


def test_seed_costs(spark):
    hist = spark.createDataFrame([(1, 4.0, 26), (1, 4.5, 1), (1, 2.0, 100), (2, 3.0, 10)], "film int, stars double, n long")
    got = {mode: {r["film"]: (r["total"], r["pool"], r["pages"]) for r in ratings.seed_costs(hist, mode).collect()} for mode in ("taste", "territory", "both")}
    assert got == {"taste": {1: (127, 27, 3), 2: (10, 0, 0)}, "territory": {1: (127, 127, 6), 2: (10, 10, 1)}, "both": {1: (127, 127, 9), 2: (10, 10, 1)}}


def test_cohort_guards(spark):
    split = spark.createDataFrame([(1, f, float(f % 5 + 1), f < 8) for f in range(30)] + [(2, f, 3.0, f < 7) for f in range(30)] + [(3, f, 3.0, f < 20) for f in range(30)], "user_id long, film int, rating double, is_test boolean")
    cf = split.where("is_test").select("user_id", "film", F.lit(3.0).alias("raw"), F.col("rating").alias("pred"), F.col("rating").alias("actual"))
    near = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 7)], "a long, b long")
    rows = metrics.cohort_rows(cf, split, near).collect()
    assert [(r["user_id"], r["n_test"], r["n_train"], r["n_neighbours"], r["auc_cf"]) for r in rows] == [(1, 8, 22, 2, 1.0)]
    assert models.neighbour_cf(split, split, near=near.withColumn("w", F.lit(1.0))).count() == 0


def test_elements_and_ranks_by_slices(spark, monkeypatch):
    from kindred.functions import aggregates

    rng = np.random.default_rng(11)
    rows = [(g, float(v)) for g, n in (("one", 1), ("few", 7), ("many", 500), ("same", 50)) for v in (np.full(n, 2.5) if g == "same" else rng.normal(0, 3, n).round(1))] + [("few", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    for slices in (1, 3, 4_096):
        monkeypatch.setattr(aggregates, "SLICES", slices)
        got = {r["g"]: tuple(r)[1:] for r in aggregates.elements(frame, "g", "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99}).collect()}
        for g in ("one", "few", "many", "same"):
            own = sorted(v for k, v in rows if k == g and v is not None)
            assert got[g] == tuple(own[int(s * len(own))] for s in (0.0, 0.25, 0.5, 0.99))
    ratings_ = frame.where("v is not null").select(F.col("g").alias("user_id"), F.round("v").alias("rating"))
    ranked = similarity.percentiles(ratings_).select("user_id", "rating", "pct").collect()
    plain = ratings_.withColumn("pct", aggregates.midrank(["user_id"], "rating")).where("pct is not null").collect()
    assert sorted(map(tuple, ranked)) == sorted(map(tuple, plain))
