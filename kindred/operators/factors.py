"""Matrix factorisation by stochastic gradient descent over a grid of blocks.

Users and films are dealt into blocks by hash. A diagonal of the grid (one block of films for each block of users, no block
twice) shares no user and no film between its cells, so its cells descend side by side, each in one task with the factors of
its own users and films. A round goes through all diagonals, one after the other, and every cell is passed over a few times
when its turn comes; rounds times passes are the epochs. Factors live in a table, so a lost executor only repeats its cells.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.checkpoints import cut
from kindred.operators.models import bias_predictions

RANK, EPOCHS, RATE, PENALTY, SPREAD = 32, 40, 0.007, 0.05, 0.05
#: Passes over a cell at each of its turns.
PASSES = 5
#: Ratings of a cell, as far as hashes deal them evenly; there are so many blocks a side.
RATINGS_PER_CELL = 20_000
SCHEMA = "block int, side string, key string, vector array<double>"


def first_factor(side: str, key: str, rank: int, seed: int) -> np.ndarray:
    """Where a user's or film's factor starts: normal, and the same wherever it is drawn."""
    return np.random.default_rng([seed, crc32(f"{side}{key}".encode())]).normal(0, SPREAD, rank)


def descend(users: np.ndarray, films: np.ndarray, left: np.ndarray, p: np.ndarray, q: np.ndarray, passes: int, rate: float, penalty: float, order: np.random.Generator) -> None:
    """Passes over ratings (places of user and film, what biases leave), each in a new random order; p and q change. A step
    is seven operations on rows in place."""
    of_user, of_film = list(p), list(q)
    for_user, for_film = np.empty(p.shape[1]), np.empty(q.shape[1])
    stay, multiply = np.float64(1 - rate * penalty), np.multiply
    for _ in range(passes):
        at = order.permutation(len(left))
        for u, f, x in zip(users[at].tolist(), films[at].tolist(), left[at].tolist(), strict=True):
            a, b = of_user[u], of_film[f]
            step = rate * (x - float(a.dot(b)))
            multiply(b, step, for_user)
            multiply(a, step, for_film)
            a *= stay
            a += for_user
            b *= stay
            b += for_film


def started(side: str, own: pa.Table, rank: int, seed: int) -> np.ndarray:
    """The vectors of a side's rows as one array; rows without one get their first."""
    keys, vectors = own["key"], own["vector"].combine_chunks()
    missing = vectors.is_null().to_numpy(zero_copy_only=False)
    out = np.empty((len(keys), rank))
    out[~missing] = vectors.flatten().to_numpy().reshape(-1, rank)
    for k in np.flatnonzero(missing).tolist():
        out[k] = first_factor(side, keys[k].as_py(), rank, seed)
    return out


def blocks_for(n: int) -> int:
    return max(1, round((n / RATINGS_PER_CELL) ** 0.5 + 0.5))


def sgd_factors(rows: DataFrame, user: str = "user_id", film: str = "film", left: str = "residual", rank: int = RANK, epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY, seed: int = 0, blocks: int | None = None) -> DataFrame:
    """(side ``u`` or ``f``, key, vector): factors of all users and films of ``rows``, ids as text, of any type. Rows with a
    null are left out; no rows give no factors."""
    cells = rows.select(F.col(user).cast("string").alias("u"), F.col(film).cast("string").alias("f"), F.col(left).cast("double").alias("r")).dropna()
    cells = cut(cells)
    blocks = blocks or blocks_for(cells.count())
    at = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    cells = cut(cells.withColumns({"i": at("u"), "j": at("f")}))
    none = F.lit(None).cast("array<double>").alias("vector")
    sides = [cells.select(F.col(b).alias("block"), F.lit(k).alias("side"), F.col(k).alias("key"), none).distinct() for b, k in (("i", "u"), ("j", "f"))]
    factors = sides[0].unionByName(sides[1])
    passes = PASSES if blocks > 1 else epochs
    for turn in range(-(-epochs // passes)):
        for diagonal in range(blocks):
            factors = cut(one_diagonal(cells, factors, diagonal, blocks, rank, min(passes, epochs - turn * passes), rate, penalty, [seed, turn, diagonal]))
    return factors.drop("block")


def one_diagonal(cells: DataFrame, factors: DataFrame, diagonal: int, blocks: int, rank: int, passes: int, rate: float, penalty: float, seed: list[int]) -> DataFrame:
    """All factors after the cells (i, i + diagonal) have descended; each cell is one group."""

    def run(cell: tuple, table: pa.Table) -> pa.Table:
        own = {k: table.filter(pc.equal(table["side"], k)).sort_by([("key", "ascending"), ("other", "ascending")]) for k in ("u", "f", "r")}
        vectors = {k: started(k, own[k], rank, seed[0]) for k in ("u", "f")}
        users, films = (pc.index_in(own["r"][name], value_set=own[k]["key"].combine_chunks()).to_numpy().astype(np.int64) for name, k in (("key", "u"), ("other", "f")))
        i = cell[0].as_py()
        descend(users, films, own["r"]["r"].to_numpy(), vectors["u"], vectors["f"], passes, rate, penalty, np.random.default_rng([*seed, i]))
        n_users, n_films = len(vectors["u"]), len(vectors["f"])
        at = np.repeat(np.array([i, (i + diagonal) % blocks], np.int32), [n_users, n_films])
        flat = pa.array(np.concatenate([vectors["u"], vectors["f"]]).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n_users + n_films + 1, dtype=np.int32) * rank), flat)
        side, key = pa.concat_arrays([pa.repeat("u", n_users), pa.repeat("f", n_films)]), pa.concat_arrays([c for k in ("u", "f") for c in own[k]["key"].chunks])
        return pa.table({"block": pa.array(at), "side": side, "key": key.cast(pa.string()), "vector": lists})

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    cell = F.when(F.col("side") == "u", F.col("block")).otherwise(F.pmod(F.col("block") - diagonal, F.lit(blocks))).alias("cell")
    states = factors.select(cell, "side", "key", null("string", "other"), "vector", null("double", "r"))
    ratings = cells.where(F.col("j") == (F.col("i") + diagonal) % blocks).select(F.col("i").alias("cell"), F.lit("r").alias("side"), F.col("u").alias("key"), F.col("f").alias("other"), null("array<double>", "vector"), "r")
    rows = states.unionByName(ratings)
    if blocks > 1:  # a task for each cell; by hash some tasks would have several
        rows = rows.repartitionByRange(blocks, "cell")
    return rows.groupBy("cell").applyInArrow(run, SCHEMA)


def sgd_factorised(train: DataFrame, asked: DataFrame, **settings) -> DataFrame:
    """``asked`` with pred: the bias model plus the factors' product; users or films that ``train`` lacks add nothing."""
    settled = bias_predictions(train, train).withColumn("residual", F.col("rating") - F.col("pred"))
    factors = sgd_factors(settled, **settings)
    of = lambda side, name: factors.where(F.col("side") == side).select(F.col("key").alias(f"_{side}"), F.col("vector").alias(name))
    rows = bias_predictions(train, asked).withColumns({"_u": F.col("user_id").cast("string"), "_f": F.col("film").cast("string")})
    rows = rows.join(of("u", "_p"), "_u", "left").join(of("f", "_q"), "_f", "left")
    product = F.aggregate(F.zip_with("_p", "_q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("pred", F.col("pred") + F.coalesce(product, F.lit(0.0))).drop("_u", "_f", "_p", "_q")
