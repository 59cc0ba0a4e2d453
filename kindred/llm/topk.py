"""Exact top-k search by exhaustive term-at-a-time accumulation over integer vectors.

Within a tile every component of the candidates is a posting list (rows and weights; a list that covers most rows is
kept dense). A query row scatters its weighted postings, one term after the other, into one dense array of scores;
partition selection takes the k best of the tile, ties to the smaller id, and Spark merges the tiles' lists.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vector_blocks import search

QUERIES_PER_BLOCK = 1024
ROWS_PER_BLOCK = 4096


def postings(cells: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term (rows, weights); rows is None if the weights are those of all rows."""
    out = []
    for column in cells.T:
        rows = np.flatnonzero(column)
        out.append((None, np.ascontiguousarray(column)) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return out


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller place, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.append(above, np.flatnonzero(scores == least)[: k - len(above)])


def tile(k: int):
    def run(q: np.ndarray, c: np.ndarray, own: np.ndarray, lists: list):
        scores, part = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        at, found, values = [], [], []
        for i, (row, mine) in enumerate(zip(q, own.tolist(), strict=True)):
            scores[:] = 0
            for term in np.flatnonzero(row[: len(lists)]):
                rows, weights = lists[term]
                if rows is None:
                    scores += np.multiply(weights, row[term], out=part)
                else:
                    scores[rows] += weights * row[term]
            if mine >= 0:
                best = select(np.delete(scores, mine), k)
                best += best >= mine
            else:
                best = select(scores, k)
            at.append(np.full(len(best), i))
            found.append(best)
            values.append(scores[best])
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, found, values)]

    return run


def exact_top_k(rows: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` other rows of largest inner product for each row (id long, v array<bigint>, query boolean) with ``query``.

    Components that are missing at the end of a short vector, or all of an empty one's, are 0. Scores are 64-bit and wrap
    round beyond. Fewer candidates than ``k`` are all returned; no candidate, no row. Rows that repeat an id are rows of
    their own: each is a candidate, and each query among them has its list. Rows with a null id or vector must have been
    removed.
    """
    return search(rows, k, "long", "int64", postings, tile(k), QUERIES_PER_BLOCK, ROWS_PER_BLOCK)
