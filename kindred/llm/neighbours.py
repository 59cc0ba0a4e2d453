"""Nearest neighbours by a block matrix join over int8 codes.

Each vector becomes int8 codes times a scale. A tile's int8 product (exact in float32, as all partial sums stay below
2^24) gives approximate inner products, and norms of the vectors and of their quantisation errors bound how far off
each can be. Pairs whose upper bound reaches the k-th best lower bound of their query survive; these are computed
again in double precision from the original vectors, and heaps merge each query's lists.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vector_blocks import search

QUERIES_PER_BLOCK = 1024
ROWS_PER_BLOCK = 8192
#: Query rows whose products are held at once.
STRIP = 64
#: Surviving pairs that are recomputed at once.
PAIRS = 100_000
#: So many components' products of two int8 codes stay exact in float32.
EXACT_DIMS = (1 << 24) // (127 * 127)
#: Slack for rounding in double precision, as a share of the norms' product.
ROUNDING = 1e-12


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, and the norm of what they miss, by row."""
    scale = np.maximum(np.abs(m).max(1, initial=0), np.finfo(float).tiny) / 127
    codes = np.rint(m / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(m - codes * scale[:, None], axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer product of int8 codes, as float64, over the components that both have."""
    out, dims = np.zeros((len(a), len(b))), min(a.shape[1], b.shape[1])
    for i in range(0, dims, EXACT_DIMS):
        some = slice(i, min(i + EXACT_DIMS, dims))
        out += a[:, some].astype(np.float32) @ b[:, some].astype(np.float32).T
    return out


def exact(q: np.ndarray, c: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components that both have."""
    out, dims = np.zeros(len(rows)), min(q.shape[1], c.shape[1])
    for i in range(0, len(rows), PAIRS):
        terms = q[rows[i : i + PAIRS], :dims] * c[columns[i : i + PAIRS], :dims]
        for column in terms.T:
            out[i : i + PAIRS] += column
    return out


def prepare(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale, norm of what they miss, and norm, by row."""
    c = c.astype(np.float64, copy=False)
    return *quantise(c), np.linalg.norm(c, axis=1)


def tile(k: int):
    def run(q: np.ndarray, c: np.ndarray, own: np.ndarray, ready: tuple):
        q, c = q.astype(np.float64, copy=False), c.astype(np.float64, copy=False)
        (qc, qs, qe, qn), (cc, cs, ce, cn) = prepare(q), ready
        at, found, values = [], [], []
        for i in range(0, len(q), STRIP):
            s = slice(i, i + STRIP)
            near = product(qc[s], cc) * qs[s, None] * cs
            off = qn[s, None] * ce + qe[s, None] * (cn + ce) + ROUNDING * qn[s, None] * cn
            mine = np.flatnonzero(own[s] >= 0)
            lower, upper = near - off, near + off
            lower[mine, own[s][mine]] = upper[mine, own[s][mine]] = -np.inf
            least = np.partition(lower, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(near), -np.inf)
            rows, columns = np.nonzero((upper >= least[:, None]) & (upper > -np.inf))
            scores = exact(q[s], c, rows, columns)
            order = np.lexsort((columns, -scores, rows))
            rows, columns, scores = rows[order], columns[order], scores[order]
            first = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - first < k
            at.append(i + rows[keep])
            found.append(columns[keep])
            values.append(scores[keep])
        return [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((at, np.int64), (found, np.int64), (values, np.float64))]

    return run


def nearest(rows: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` other rows of largest inner product, in double precision, for each row (id long, v array, query boolean)
    with ``query``.

    The error bounds make the result exact, ties going to the smaller id. Vectors are kept in their own type, floats as
    floats and others as doubles. Fewer candidates than ``k`` are all returned. Rows that repeat an id are rows of their
    own: each is a candidate, and each query among them has its list; short vectors get zeros. Rows with a null id, or a
    null, zero or non-finite vector, must have been removed.
    """
    dtype = "float32" if dict(rows.dtypes)["v"] == "array<float>" else "float64"
    return search(rows, k, "double", dtype, prepare, tile(k), QUERIES_PER_BLOCK, ROWS_PER_BLOCK)
