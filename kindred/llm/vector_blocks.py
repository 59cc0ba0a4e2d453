"""Vectors packed into blocks of bounded size, and the join that pairs query blocks with candidate blocks.

A block is one row: sorted ids and a matrix as bytes, of the narrowest type that holds it. Blocks are filled by a hash of
the row, so no key, source or repeated vector makes one larger than another. Pairing replicates the packed query blocks, the
stated smaller side, once for each candidate block. Candidate blocks are shuffled once (a few times, where there are fewer
of them than tasks) and stay in place, while the query blocks that meet them stream past.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of, cut

SCHEMA = "block int, rows binary, ids binary, dims int, kind string, cells binary"
PACKED = ("block", "rows", "ids", "dims", "kind", "cells")
#: Queries whose lists a task merges before it hands them on.
QUERIES_KEPT = 16_384


def finite(vector: str) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    v = F.col(vector).cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def pack(rows: DataFrame, dtype: str, blocks: int) -> DataFrame:
    """Blocks of rows (row long, id long, v array), each sorted by id and row; short vectors get zeros. Rows are dealt by
    their own numbers, so repeated ids and vectors fill no block more than others."""

    def packed(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        row, ids, v = group["row"].to_numpy(), group["id"].to_numpy(), group["v"].combine_chunks()
        lens = np.diff(v.offsets.to_numpy())
        cells = np.zeros((len(ids), int(lens.max(initial=0))), dtype)
        cells[np.arange(cells.shape[1])[None, :] < lens[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((row, ids))
        cells = narrowed(cells[order])
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int32()), "rows": [row[order].tobytes()], "ids": [ids[order].tobytes()], "dims": pa.array([cells.shape[1]], pa.int32()), "kind": [cells.dtype.str], "cells": [cells.tobytes()]})

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    return rows.withColumn("block", block).groupBy("block").applyInArrow(packed, SCHEMA)


def narrowed(cells: np.ndarray) -> np.ndarray:
    """Integers in the narrowest of 2, 4 and 8 bytes that holds them all; other types as they are."""
    if cells.dtype.kind != "i":
        return cells
    least, most = cells.min(initial=0), cells.max(initial=0)
    return cells.astype(next(t for t in ("int16", "int32", "int64") if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def unpack(batch: pa.RecordBatch, i: int, of: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and matrix of a packed block, in row ``i``, whose columns' names begin with ``of``."""
    part = {name: batch.column(of + name)[i] for name in PACKED[1:]}
    rows, ids = (np.frombuffer(part[name].as_buffer(), np.int64) for name in ("rows", "ids"))
    return rows, ids, np.frombuffer(part["cells"].as_buffer(), part["kind"].as_py()).reshape(len(ids), part["dims"].as_py()).astype(dtype, copy=False)


def tiles(queries: DataFrame, candidates: DataFrame, dtype: str, per_query_block: int, per_block: int) -> DataFrame:
    """One row for each query block and candidate block, with both matrices (the stated queries against all rows); tiles of
    one candidate block follow one another."""
    nq, nc = (blocks_of(x.count(), n) for x, n in ((queries, per_query_block), (candidates, per_block)))
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = min(nq, -(-tasks // nc))
    q = pack(queries, dtype, nq).select(*(F.col(x).alias(f"q_{x}") for x in PACKED), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("block"))
    c = pack(candidates, dtype, nc).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return q.withColumn("copy", F.col("q_block") % copies).join(c.hint("merge"), ["block", "copy"])


def places(rows: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each row number is in ``among``, in any order there; -1 for those that aren't."""
    if not len(among):
        return np.full(len(rows), -1)
    order = np.argsort(among)
    at = order[np.minimum(np.searchsorted(among, rows, sorter=order), len(among) - 1)]
    return np.where(among[at] == rows, at, -1)


def merged(kept: dict[int, list], rows: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Merge a tile's lists into each query row's best k so far, by a heap over (-score, id)."""
    if not len(rows):
        return
    order = np.lexsort((found, -scores, rows))
    rows, found, scores = rows[order], found[order], scores[order]
    starts = np.flatnonzero(np.append(True, np.diff(rows) != 0))
    for i, j in zip(starts, [*starts[1:], len(rows)], strict=True):
        new = zip((-scores[i:j]).tolist(), found[i:j].tolist(), strict=True)
        kept[int(rows[i])] = list(islice(heapq.merge(kept.get(int(rows[i]), []), new), k))


def search(rows: DataFrame, k: int, score_type: str, dtype: str, prepare: Callable, tile: Callable, per_query_block: int, per_block: int) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of each row (id, v, query) with ``query``, among all other rows.

    Rows get numbers of their own first, so rows that repeat an id are queries and candidates of their own; a query leaves
    out its own row alone. ``tile(q, c, own, prepare(c))`` returns arrays (query's place, candidate's place, score) with
    each query's best k of that tile, own being its own place or -1; the matrices may differ in width, missing components
    being 0. Each candidate block is prepared once for the tiles that follow one another. A task merges its tiles by
    heaps, for ``QUERIES_KEPT`` queries at a time; Spark merges the tasks' lists, cutting to k before the shuffle.
    """

    def told(kept: dict[int, list], names: dict[int, int]) -> pa.RecordBatch:
        found = [(row, names[row], x, -s) for row, best in kept.items() for s, x in best]
        row, q, x, s = zip(*found, strict=True) if found else ((), (), (), ())
        kept.clear()
        names.clear()
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(s, pa.int64() if score_type == "long" else pa.float64())], ["row", "query_id", "vec_id", "score"])

    def run(batches):
        kept, names, held = {}, {}, None
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block != held:
                    c_rows, c_ids, c = unpack(batch, i, "", dtype)
                    held, ready = block, prepare(c)
                q_rows, q_ids, q = unpack(batch, i, "q_", dtype)
                if len(kept) + len(q_ids) > QUERIES_KEPT:
                    yield told(kept, names)
                at, found, scores = tile(q, c, places(q_rows, c_rows), ready)
                names.update(zip(q_rows.tolist(), q_ids.tolist(), strict=True))
                merged(kept, q_rows[at], c_ids[found], scores, k)
        yield told(kept, names)

    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v", "query"))
    queries, candidates = rows.where("query").drop("query"), rows.drop("query")
    best = tiles(queries, candidates, dtype, per_query_block, per_block).mapInArrow(run, f"row long, query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
