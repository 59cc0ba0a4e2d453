"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded, seeded sample of labelled texts per language in Spark; the
log-probability matrix (languages x buckets, float32) is the only thing broadcast, and its size follows
from ``buckets`` and the number of languages alone. Scoring gathers matrix columns for the n-grams of a
whole Arrow batch in numpy and sums them per text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, give_back, giving_back, utf8_parts

#: Most labelled texts per language that training reads; a language with fewer gives all.
TRAIN_PER_LANGUAGE = 8_000
#: A power of two.
BUCKETS = 1 << 16
#: The broadcast matrix holds at most so many cells (float32).
MOST_CELLS = 1 << 25
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Evidence counts as that of so many n-grams at most, so that scores of long texts stay below 1.
EVIDENCE_NGRAMS = 40

_letters: tuple[np.ndarray, np.ndarray] | None = None


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and its lower-case code point (0: no letter)."""
    global _letters
    if _letters is None:
        chars = [chr(c) for c in range(0x110000)]
        letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        lower = np.zeros(len(chars), np.uint32)
        for c in np.flatnonzero(letter):
            s = chars[c].lower()
            lower[c] = ord(s) if len(s) == 1 else c
        _letters = letter, lower
    return _letters


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of every n-gram of the texts, and where each text's n-grams start.

    Runs of characters that are no letters act as one space. ``buckets`` is a power of two.
    """
    _, lower = _letter_tables()
    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = lower[codes]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    before = np.concatenate([[0], low[:-1]])
    head = np.zeros(len(low), bool)
    head[at[:-1][np.diff(at) > 0]] = True
    keep = (low > 0) | ((before > 0) & ~head)
    low, text = low[keep], text[keep]
    shift = np.uint32(33 - buckets.bit_length())
    whole, ends, out = text, np.arange(len(at)), []
    h = np.full(len(low), np.uint32(0x4F6CDD1D))
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            low, h, text = low[1:], h[:-1], text[:-1]
        h = (h ^ low) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            kept = whole[n - 1 :] == text if n > 1 else low > 0
            out.append((h[kept] * np.uint32(0x85EBCA77) >> shift, np.searchsorted(text[kept], ends)))
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    #: languages x buckets
    log_prob: np.ndarray

    @property
    def buckets(self) -> int:
        return self.log_prob.shape[1]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = utf8_parts(texts)
        names, scores = [], np.zeros(len(texts))
        for i, j in chunks(offsets):
            o = offsets[i : j + 1]
            total, n = np.tile(self.log_prior, (j - i, 1)), np.zeros(j - i, np.int64)
            for h, at in ngram_buckets(data[o[0] : o[-1]], o - o[0], self.buckets):
                some = np.flatnonzero(np.diff(at))
                n[some] += np.diff(at)[some]
                if len(some):
                    for k in range(len(self.languages)):
                        total[some, k] += np.add.reduceat(self.log_prob[k][h], at[some])
            best = total.argmax(1)
            scaled = (total - total.max(1, keepdims=True)) * np.minimum(1.0, EVIDENCE_NGRAMS / np.maximum(n, 1))[:, None]
            top = 1.0 / np.exp(scaled).sum(1)
            names += [self.languages[b] if m else UNDETERMINED for b, m in zip(best.tolist(), n.tolist(), strict=True)]
            scores[i:j] = np.where(n > 0, top, 0.0)
        return names, scores


def train_language_id(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE, buckets: int = BUCKETS, alpha: float = 0.1) -> LanguageModel:
    """Fit on rows with a text and a language. The sample per language is by a hash of ``key``."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    have = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(have))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((0, buckets), np.float32))
    while buckets > 1024 and buckets * len(languages) > MOST_CELLS:
        buckets //= 2
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / have[name]))])
    draw = (F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit("")), F.lit(17)).bitwiseAND(0xFFFFFF)) / float(1 << 24)
    chosen = rows.where(draw < share[F.col("l")]).select("l", "t")

    def count(batches):
        index = {name: k for k, name in enumerate(languages)}
        total = np.zeros(len(languages) * buckets, np.int64)
        for batch in batches:
            which = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            data, offsets = utf8_parts(batch.column(1))
            for i, j in chunks(offsets):
                o = offsets[i : j + 1]
                for h, at in ngram_buckets(data[o[0] : o[-1]], o - o[0], buckets):
                    total += np.bincount(np.repeat(which[i:j], np.diff(at)) * buckets + h, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    counted = chosen.mapInArrow(giving_back(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * buckets)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    counts = counts.reshape(len(languages), buckets) + alpha
    seen = np.array([have[x] for x in languages], float)
    return LanguageModel(languages, np.log(seen / seen.sum()), np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and the posterior of it, tempered to at most
    ``EVIDENCE_NGRAMS`` n-grams of evidence. Columns already so named are replaced.

    Null or letterless texts, and any text of a model without languages, give ``und`` and 0.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<p string, s double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(texts) if shared.value.languages else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
        give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["p", "s"])

    return docs.withColumn("_p", predict(F.col(text))).withColumns({out: F.col("_p.p"), score: F.col("_p.s")}).drop("_p")
