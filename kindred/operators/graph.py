"""Paths over edges whose vertices have very different degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Paths through one vertex that one task may make.
PATHS = 1 << 18


def _side(vertex: str, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(vertex), buckets)


def through(edges: DataFrame, paths: int = PATHS) -> tuple[DataFrame, DataFrame]:
    """The edges into and out of every vertex that has both, as (mid, src, _i, _j) and (mid, dst, _i, _j), to be joined on
    mid, _i and _j.

    A vertex with no more than ``paths`` ways through it is one group. At others, edges of either side are dealt by hash
    over blocks of about the square root of ``paths`` edges, and every pair of blocks is a group of its own, for which a
    side's edges are copied. So no group makes many more than ``paths`` rows, whatever the degrees.
    """
    degrees = edges.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("_in")).join(edges.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("_out")), "mid")
    side = int(paths**0.5)
    blocks = lambda n, other: F.when(F.col("_in") * F.col("_out") <= paths, 1).otherwise(F.ceil(F.greatest(F.col(n) / side, F.col(n) * F.least(F.col(other), F.lit(side)) / paths)))
    degrees = degrees.select("mid", F.greatest(F.lit(1), blocks("_in", "_out")).cast("long").alias("_m"), F.greatest(F.lit(1), blocks("_out", "_in")).cast("long").alias("_n"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    into = edges.select(F.col("dst").alias("mid"), "src").join(degrees, "mid").select("mid", "src", _side("src", F.col("_m")).alias("_i"), upto("_n").alias("_j"))
    out = edges.select(F.col("src").alias("mid"), "dst").join(degrees, "mid").select("mid", "dst", _side("dst", F.col("_n")).alias("_j"), upto("_m").alias("_i"))
    return into, out


def two_hops(edges: DataFrame, paths: int = PATHS) -> DataFrame:
    """(src, dst, paths): who follows somebody that follows ``dst``, in how many ways, without direct follows and oneself.
    Repeated edges count once; edges without an end are left out. Ways are counted where they are made, before the shuffle."""
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    into, out = through(edges, paths)
    found = into.join(out, ["mid", "_i", "_j"]).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("paths"))
    return found.join(edges, ["src", "dst"], "left_anti")
