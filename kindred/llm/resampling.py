"""Importance resampling towards a target distribution, over hashed runs of words.

Identical texts are collapsed by grouping full texts, so features are counted and weighed once for each text; counts are
multiplied by the number of copies. Weights join back by a digest of the text before each document's own noise (Gumbel, so
that the largest scores are a draw without replacement in proportion to the weights) is added.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attached, bound_batches, cut, digest, giving_back, stored

BUCKETS = 10_000
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Words of one text that are hashed at once.
WORDS_AT_ONCE = 1 << 16

#: Fixed value: a run of digits, lower-case letters and bytes beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the words and of the pairs that end in them) of a text, ``WORDS_AT_ONCE`` words at a time. A
    pair's crc32 carries on from its first word's."""
    words, last = (m.group() for m in _WORD.finditer(text.lower())), None
    while some := list(islice(words, WORDS_AT_ONCE)):
        codes = list(map(crc32, some))
        firsts = codes[:-1] if last is None else [last, *codes[:-1]]
        pairs = list(map(crc32, [b" " + w for w in some[len(some) - len(firsts) :]], firsts))
        last = codes[-1]
        yield len(some), np.array(codes + pairs, np.int64) % BUCKETS


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all rows (text, copies) fall into each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, copies in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                for _, buckets in features(text.encode()):
                    total += copies * np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    found = texts.select("text", "copies").mapInArrow(giving_back(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in found:
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket speaks for the target: a smoothed log ratio, in thousandths, rounded down."""
    s, t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(_key, _copies, n_words, n_features, weight) of rows (_key, text, copies)."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n_words = n = total = 0
                for words, buckets in features(text.encode()):
                    n_words, n, total = n_words + words, n + len(buckets), total + int(gain[buckets].sum())
                rows.append((n_words, n, total // n if n else 0))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("copies"), *columns], ["_key", "_copies", "n_words", "n_features", "weight"])

    return texts.select("_key", "text", "copies").mapInArrow(giving_back(run), "_key binary, _copies long, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from sha256 of the seed and the id."""
    h = F.conv(F.substr(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (doc_id, score, n_words) with rank, from 1, of the ``percent`` of highest scores among those with
    ``LEAST_WORDS`` words; null for the others.

    Scores are thousandths of logarithms, so there are some ten thousand values at most: rows are counted by score, the
    sums before each one place it, and only rows of one score are sorted. No task sees all rows.
    """
    fit = F.col("n_words") >= LEAST_WORDS
    counts = rows.where(fit).groupBy("score").agg(F.count("*").alias("_n")).coalesce(1)
    before = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.floor(percent * F.sum("_n").over(Window.partitionBy()) / 100)
    counts = counts.select("score", before.alias("_before"), most.alias("_most")).where("_before < _most")
    placed = rows.join(F.broadcast(counts), "score", "left")
    near = fit & F.col("_before").isNotNull()
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    drawn = placed.where(near).withColumn("rank", F.col("_before") + F.row_number().over(inside))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("_most"), F.col("rank")))
    return drawn.unionByName(placed.where(~near).withColumn("rank", F.lit(None).cast("long"))).drop("_before", "_most")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Null texts have no features and weight 0; texts are taken whole. Repeated rows are rows of their own with one score,
    and a row without an id has the noise of an empty one and the last place among equal scores. An empty target or
    corpus only leaves the smoothing. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    texts = docs.select(text).groupBy("text").agg(F.count("*").alias("copies"))
    with stored(texts.withColumn("_key", digest("text"))) as folded:
        gain = gains(bucket_counts(folded), bucket_counts(target.select(text, F.lit(1).cast("long").alias("copies"))))
        facts = cut(weighed(folded, gain))
    rows = docs.select("doc_id", text).select("doc_id", digest("text").alias("_key"))
    scored = attached(rows, facts, docs.count()).withColumn("score", F.col("weight") + noise("doc_id", seed))
    return ranked(cut(scored.select("doc_id", "n_features", "weight", "score", "n_words")), percent).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
