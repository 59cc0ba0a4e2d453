"""Factorisation by blocks against plain gradient descent, on planted tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import factors, models


def planted(n_users=60, n_films=40, seed=1):
    rng = np.random.default_rng(seed)
    p, q = rng.normal(0, 0.8, (n_users, 3)), rng.normal(0, 0.8, (n_films, 3))
    rows = [(u, f, float(np.clip(3 + p[u] @ q[f] + rng.normal(0, 0.1), 0.5, 5))) for u in range(n_users) for f in range(n_films)]
    picks = rng.random(len(rows)) < 0.8
    return [r for r, k in zip(rows, picks, strict=True) if k], [r for r, k in zip(rows, picks, strict=True) if not k]


def plain(rows, rank, epochs, rate, penalty, seed):
    """One rating after the other, in the orders that one block draws."""
    rows = sorted((str(u), str(f), r) for u, f, r in rows)
    p, q = ({k: factors.first_factor(side, k, rank, seed) for k in {r[n] for r in rows}} for n, side in ((0, "u"), (1, "f")))
    order = np.random.default_rng([seed, 0, 0, 0])
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            u, f, r = rows[k]
            e = r - sum(x * y for x, y in zip(p[u], q[f], strict=True))
            p[u], q[f] = p[u] + rate * (e * q[f] - penalty * p[u]), q[f] + rate * (e * p[u] - penalty * q[f])
    return {("u", k): v for k, v in p.items()} | {("f", k): v for k, v in q.items()}


def test_one_block_is_plain_descent(spark):
    rows = [(u, f, r - 3) for u, f, r in planted(12, 9)[0]]
    frame = spark.createDataFrame(rows, "user_id long, film int, residual double").repartition(3)
    got = {(r["side"], r["key"]): r["vector"] for r in factors.sgd_factors(frame, rank=4, epochs=6, blocks=1).collect()}
    want = plain(rows, 4, 6, factors.RATE, factors.PENALTY, 0)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(list(v), abs=1e-9)


def test_blocks_learn_what_biases_cannot(spark):
    train, test = planted()
    schema = "user_id long, film string, rating double"
    far = [(3_000_000_000 + u, f"film {f}", r) for u, f, r in train]
    train, test = spark.createDataFrame(far, schema), spark.createDataFrame([(3_000_000_000 + u, f"film {f}", r) for u, f, r in test], schema)
    error = lambda df: df.agg(F.sqrt(F.avg((F.col("pred") - F.col("rating")) ** 2))).first()[0]
    biased = error(models.bias_predictions(train, test))
    found = factors.sgd_factorised(train, test, rank=6, epochs=40, rate=0.05, blocks=3)
    assert error(found) < 0.5 * biased and found.columns == [*test.columns, "pred"]
    assert error(models.factorised(train, test, rank=6)) < 0.5 * biased


def test_every_cell_descends_once_a_turn(spark, monkeypatch):
    monkeypatch.setattr(factors, "PASSES", 2)
    rows = spark.createDataFrame([(u, f, 1.0) for u in range(9) for f in range(7)], "user_id long, film int, residual double")
    got = factors.sgd_factors(rows, rank=2, epochs=4, blocks=3)
    assert sorted((r["side"], r["key"]) for r in got.collect()) == sorted([("u", str(u)) for u in range(9)] + [("f", str(f)) for f in range(7)])
    again = factors.sgd_factors(rows.repartition(5), rank=2, epochs=4, blocks=3)
    assert {(r["side"], r["key"]): tuple(r["vector"]) for r in got.collect()} == {(r["side"], r["key"]): tuple(r["vector"]) for r in again.collect()}


def test_strangers_and_nothing(spark):
    schema = "user_id long, film int, rating double"
    train, asked = spark.createDataFrame([(1, 1, 4.0), (1, 2, 3.0), (2, 1, 5.0)], schema), spark.createDataFrame([(1, 9, 3.0), (8, 1, 3.0), (1, 1, 4.0)], schema)
    biased = {(r["user_id"], r["film"]): r["pred"] for r in models.bias_predictions(train, asked).collect()}
    got = {(r["user_id"], r["film"]): r["pred"] for r in factors.sgd_factorised(train, asked, rank=2, epochs=2).collect()}
    assert got[1, 9] == biased[1, 9] and got[8, 1] == biased[8, 1] and got[1, 1] != biased[1, 1]
    assert factors.sgd_factors(train.withColumn("residual", F.lit(1.0)).limit(0)).count() == 0


def test_each_cell_has_a_task_of_its_own(spark):
    cells = spark.createDataFrame([(str(u), str(f), 1.0, u % 5, f % 5) for u in range(25) for f in range(25)], "u string, f string, r double, i int, j int")
    sides = [cells.select(F.col(b).alias("block"), F.lit(k).alias("side"), F.col(k).alias("key"), F.lit(None).cast("array<double>").alias("vector")).distinct() for b, k in (("i", "u"), ("j", "f"))]
    turn = factors.one_diagonal(cells, sides[0].unionByName(sides[1]), 2, 5, 2, 1, 0.1, 0.1, [0, 0, 2])
    plan = turn._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(cell" in plan and "hashpartitioning(cell" not in plan
    assert {len(r["vector"]) for r in turn.collect()} == {2} and turn.count() == 50
