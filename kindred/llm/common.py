"""Helpers that several corpus operators share: tables, checkpoints, folds and word hashing on Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.checkpoints import cut, shared_folder, stored  # noqa: F401  (for the operators here)

#: Bytes of text that the numpy kernels work on at once; longer single texts are still taken whole.
CHUNK_BYTES = 400_000

MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
ORDER_BASE = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker, where the session has Spark's own setting; long texts would
#: otherwise come 10,000 at a time.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a setting of its own."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, "64m") in ("64m", f"{64 << 20}b"):
        spark.conf.set(setting, str(BATCH_BYTES))


def give_back() -> None:
    """Return what is freed to the system: Python workers are reused, and one stage's memory would count for the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """A function of batches for mapInArrow that gives memory back when its partition ends."""

    def whole(batches) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        give_back()

    return whole


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for the fold that learning never sees: crc32 of the id as text, mod ``folds``, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


#: A key that holds more than one row in so many is hot. There are never more hot keys than this number.
HOT_SHARE = 1_000


def digest(value: str) -> Column:
    """A key of 32 bytes for a value of any length; nulls have one, too, which no other value shares."""
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(value).cast("string")), F.lit("")).cast("binary"), 256))


def attached(rows: DataFrame, facts: DataFrame, n: int, key: str = "_key", copies: str = "_copies") -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row for each key, with the number of rows that hold it).

    Of ``n`` rows, fewer than ``HOT_SHARE`` keys can each hold more than that share, so these are broadcast whatever the
    size of the table; every other key is too small to make a task of the join heavy.
    """
    hot = F.col(copies) * HOT_SHARE > n
    few = F.broadcast(facts.where(hot).drop(copies))
    rest = rows.join(few.select(key), key, "left_anti").join(facts.where(~hot).drop(copies), key)
    return rows.join(few, key).unionByName(rest)


def blocks_of(rows: int, per_block: int, least: int = 1) -> int:
    return max(least, -(-rows // per_block))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, WORD_BASE)]), dtype=np.uint64)
    return _powers


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each starts (one offset more than texts). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of texts that hold about ``most`` bytes together; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Runs of ASCII letters and of bytes beyond ASCII are words here.
LETTERS_ONLY = np.ones(256, bool)
LETTERS_ONLY[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of the words (runs of bytes that separate nothing, A-Z lower-cased) of all texts in order, where each
    text's words start among them, and for each length in ``prefixes`` the hashes of the longer words' first bytes
    (0 for other words)."""
    n, none = len(data), np.zeros(0, np.uint64)
    keep = ~separator[data]
    kept = np.flatnonzero(keep)
    if not len(kept):
        return none, np.zeros(len(offsets), np.int64), [none for _ in prefixes]
    before = np.empty(n, bool)
    before[0], before[1:] = False, keep[:-1]
    before[offsets[offsets < n]] = False
    starts = np.flatnonzero(keep & ~before)
    first = np.searchsorted(kept, starts)
    lens = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, lens)
    values = (_LOWER[data[kept]].astype(np.uint64) + np.uint64(1)) * _power_table(int(lens.max()) + 1)[place]
    h = mix(np.add.reduceat(values, first) ^ lens.astype(np.uint64))
    heads = []
    for p in prefixes:
        head = mix(np.add.reduceat(np.where(place < p, values, np.uint64(0)), first) ^ np.uint64(p << 32))
        heads.append(np.where(lens > p, head, np.uint64(0)))
    return h, np.searchsorted(starts, offsets), heads
