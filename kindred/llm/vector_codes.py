"""Vector code compression: product codebooks, with each nearest entry found by way of a VA-file.

Components become integers, so that sums, distances and ties are exact in any order of partitions. A codebook's entries are
quantised to a few bits a coordinate; a query's tables give each cell's least and largest squared difference, and adding
them up bounds its distance to every entry from below and above. Only entries whose lower bound is within the smallest upper
one are compared exactly. Tasks send sums of what they assigned, so the driver gets one codebook's worth of numbers a round.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, cut, digest
from .vector_blocks import narrowed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a cell's number in each coordinate of the VA-file.
BITS = 4
#: Vectors that are assigned at once.
STRIP = 512


@dataclass
class VaFile:
    """One part's entries (k x width), the cell of each in every pair of coordinates, and the cells' bounds."""

    entries: np.ndarray
    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> VaFile:
        """Cells split the range of the entries' coordinate evenly; each is bounded by the entries it holds."""
        k, width = entries.shape
        n = 1 << BITS
        least, most = entries.min(0, initial=np.iinfo(np.int64).max), entries.max(0, initial=np.iinfo(np.int64).min)
        span = np.maximum(most.astype(np.float64) - least, 1)
        cells = np.minimum((entries - least.astype(np.float64)) / span * n, n - 1).astype(np.int64)
        low, high = np.full((width, n), np.iinfo(np.int64).max), np.full((width, n), np.iinfo(np.int64).min)
        for d in range(width):
            np.minimum.at(low[d], cells[:, d], entries[:, d])
            np.maximum.at(high[d], cells[:, d], entries[:, d])
        empty = low > high
        low[empty], high[empty] = 0, 0
        return VaFile(entries, cells, low, high)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances from rows of ``x`` to all entries. The tables of two
        coordinates are added up before entries look into them, which halves the look-ups."""
        n, width = 1 << BITS, x.shape[1]
        kind = self.sums(x)
        lower, upper = np.zeros((len(x), len(self.entries)), kind), np.zeros((len(x), len(self.entries)), kind)
        near, far = [], []
        for d in range(width):
            below, above = (self.low[d] - x[:, d, None]).astype(kind), (x[:, d, None] - self.high[d]).astype(kind)
            near.append(np.maximum(np.maximum(below, above), 0) ** 2)
            far.append(np.maximum(np.abs(below), np.abs(above)) ** 2)
        for d in range(0, width - 1, 2):
            pair = self.cells[:, d] * n + self.cells[:, d + 1]
            for tables, total in ((near, lower), (far, upper)):
                total += (tables[d][:, :, None] + tables[d + 1][:, None, :]).reshape(len(x), n * n).take(pair, axis=1)
        if width % 2:
            lower += near[-1].take(self.cells[:, -1], axis=1)
            upper += far[-1].take(self.cells[:, -1], axis=1)
        return lower, upper

    def sums(self, x: np.ndarray) -> str:
        """The narrowest integers that hold every squared distance and bound."""
        most = max(int(abs(end)) for a in (x, self.entries) for end in (a.min(initial=0), a.max(initial=0)))
        return "int32" if 4 * most * most * x.shape[1] < 1 << 31 else "int64"

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower index, and the squared distance."""
        codes, errors = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(0, len(x), STRIP):
            some = x[i : i + STRIP]
            lower, upper = self.bounds(some)
            rows, entries = np.nonzero(lower <= upper.min(1, keepdims=True))
            apart = ((some[rows] - self.entries[entries]) ** 2).sum(1)
            starts = np.searchsorted(rows, np.arange(len(some)))
            least = np.minimum.reduceat(apart, starts)
            best = np.flatnonzero(apart == least[rows])
            codes[i : i + STRIP] = entries[best[np.searchsorted(rows[best], np.arange(len(some)))]]
            errors[i : i + STRIP] = least
        return codes, errors


def cells_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The integer vectors of a batch, in ``dims`` columns; short ones end in zeros."""
    out = np.zeros((batch.num_rows, dims), np.int64)
    for i, (kind, cells) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("cells"), strict=True)):
        x = np.frombuffer(cells.as_buffer(), kind)
        out[i, : len(x)] = x
    return out


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, label, dims, kind, cells): each component times ``scale``, rounded down, in the narrowest type that holds it."""

    def run(batches):
        for batch in batches:
            v = batch.column("_v")
            ends, flat = v.offsets.to_numpy(), v.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            rows = [narrowed(flat[i - ends[0] : j - ends[0]]) for i, j in zip(ends, ends[1:], strict=False)]
            made = [pa.array([len(x) for x in rows], pa.int32()), pa.array([x.dtype.str for x in rows], pa.string()), pa.array([x.tobytes() for x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *made], ["id", "label", "dims", "kind", "cells"])

    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    label = dict(vectors.dtypes)["label"]
    return vectors.select("id", "label", whole.alias("_v")).mapInArrow(run, f"id long, label {label}, dims int, kind string, cells binary")


def start(rows: DataFrame, parts: int, entries: int, dims: int) -> np.ndarray:
    """Codebooks (parts x entries x width) of the vectors of smallest ids; with fewer vectors there are fewer entries."""
    first = rows.orderBy("id", "cells").limit(entries).select("kind", "cells").toArrow()
    x = np.concatenate([np.zeros((0, dims), np.int64), *(cells_of(b, dims) for b in first.to_batches())])
    return np.ascontiguousarray(x.reshape(len(x), parts, dims // parts).transpose(1, 0, 2))


def assigned(x: np.ndarray, files: list[VaFile]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances summed over the parts."""
    width = x.shape[1] // len(files)
    codes, errors = zip(*(f.nearest(x[:, p * width : (p + 1) * width]) for p, f in enumerate(files)), strict=True)
    return np.stack(codes, 1), np.sum(errors, 0)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the mean, rounded down, of the parts it is nearest to. Exact."""
    parts, entries, width = books.shape

    def run(batches):
        files = [VaFile.of(b) for b in books]
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x = cells_of(batch, parts * width)
            codes, _ = assigned(x, files)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, starts, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                counts[p, used] += n
                if len(used):
                    sums[p, used] += np.add.reduceat(x[order, p * width : (p + 1) * width], starts, axis=0)
        p, e = np.nonzero(counts)
        p, e, d = (np.repeat(p, width + 1), np.repeat(e, width + 1), np.tile(np.arange(width + 1), len(p)))
        totals = np.concatenate([sums, counts[:, :, None]], axis=2)[p, e, d]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, d, totals)], ["p", "e", "d", "total"])

    found = rows.select("kind", "cells").mapInArrow(run, "p long, e long, d long, total long").groupBy("p", "e", "d").agg(F.sum("total").alias("total")).toArrow()
    totals = np.zeros((parts, entries, width + 1), np.int64)
    totals[tuple(found[c].to_numpy() for c in ("p", "e", "d"))] = found["total"].to_numpy()
    n = totals[:, :, -1:]
    return np.where(n > 0, totals[:, :, :-1] // np.maximum(n, 1), books)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): two hex digits a part (more, if there are more than 256 entries)."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))

    def run(batches):
        files = [VaFile.of(b) for b in books]
        for batch in batches:
            codes, errors = assigned(cells_of(batch, parts * width), files)
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    label = dict(rows.dtypes)["label"]
    return rows.select("id", "label", "kind", "cells").mapInArrow(run, f"id long, label {label}, code string, error long")


def codebooks_sha256(books: np.ndarray) -> str:
    """sha256 of all entries' components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) of every row (id long, label, v array), and the final codebooks.

    Vectors must be neither null nor hold null or non-finite components. Shorter ones end in zeros, up to the longest
    one's length, rounded up to a multiple of ``parts``; an empty one is all zeros. Repeated ids are rows of their own
    (the smaller cells come first among the entries to start with); with fewer rows than ``entries`` there are fewer
    entries; no rows give no rows. label_error sums up errors over equal labels, null being one. Numbers are 64-bit, so
    squared distances must stay below 2^63: components below some 10^5 in size, at 1024 and 64 of them.
    """
    rows = cut(integers(vectors.select("id", "label", "v"), scale))
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(0))).first()
    books = start(rows, parts, entries, -(-longest // parts) * parts)
    for _ in range(rounds if n else 0):
        books = improved(rows, books)
    found = cut(coded(rows, books).withColumn("_key", digest("label")))
    labels = found.groupBy("_key").agg(F.count("*").alias("_copies"), F.sum("error").alias("label_error"))
    return attached(found, cut(labels), n).select("id", "label", "code", "error", "label_error"), books
