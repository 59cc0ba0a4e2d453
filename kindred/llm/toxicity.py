"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and word beginnings. All terms of the labelled examples make up the vocabulary; beside its idf, a term weighs
as much as it tells toxic examples from clean ones (the root of its log-likelihood ratio), so that what occurs anywhere
hardly counts without being left out. All labelled examples are unit vectors over it, in a block-max inverted index, whose
bounds leave out blocks without changing the neighbours found. Their votes, weighted by inverse squared distance and by how
many labelled texts each example stands for (near copies count as one example), are calibrated by isotonic regression on
leave-one-out votes of the examples themselves.

The classifier is fitted on a bounded sample (``TOXIC_EXAMPLES`` and ``CLEAN_EXAMPLES``), so index and vocabulary have
the bound of these texts and are broadcast; every document is scored from its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS_ONLY, bound_batches, chunks, give_back, giving_back, mix, utf8_parts, word_hashes

TOXIC_EXAMPLES = 1_500
CLEAN_EXAMPLES = 1_500
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
#: Weight of a term that tells nothing; above zero, so that texts of such terms have a direction.
LEAST_STRENGTH = 1e-6
#: Added to a neighbour's distance (1 - cosine), so that an equal text weighs as many times more as a far one.
LEAST_DISTANCE = 0.05
#: Examples in a block of the index, terms whose lists are dense, and queries that are searched together.
BLOCK, COMMON, TOGETHER = 256, 1024, 32
#: How far apart single-precision sums of unit vectors' products may be.
SLACK = 1e-4


def term_counts(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) for the distinct terms of each text, sorted; with a sorted vocabulary, term is a place in it."""
    words, at, heads = word_hashes(data, offsets, LETTERS_ONLY, PREFIXES)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    texts, terms = [], []
    if vocabulary is not None:
        maybe = np.zeros(1 << 16, bool)
        maybe[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    for h in (words, *heads):
        some = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)]) if vocabulary is not None else np.flatnonzero(h)
        h = h[some]
        if vocabulary is not None:
            place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[place] == h
            some, h = some[hit], place[hit]
        texts.append(text[some])
        terms.append(h)
    text, term = np.concatenate(texts), np.concatenate(terms)
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (term[1:] != term[:-1]))) if len(text) else np.zeros(0, np.int64)
    return text[new], term[new], np.diff(np.append(new, len(text)))


def signatures(texts: pa.Array) -> np.ndarray:
    """The smallest hash of three words on end (of all words, if fewer) of each text; most near copies share it."""
    data, offsets = utf8_parts(texts)
    out = np.zeros(len(texts), np.uint64)
    for i, j in chunks(offsets):
        o = offsets[i : j + 1]
        h, at, _ = word_hashes(data[o[0] : o[-1]], o - o[0])
        if len(h):
            text = np.repeat(np.arange(j - i), np.diff(at))
            for step in (1, 2):
                after = np.append(h[step:], np.zeros(min(step, len(h)), np.uint64))
                after_text = np.append(text[step:], np.full(min(step, len(h)), -1))
                h = mix(h * np.uint64(3) + np.where(after_text == text, after, np.uint64(step)))
            some = np.flatnonzero(np.diff(at))
            out[i + some] = np.minimum.reduceat(h, at[some])
    return out


@dataclass
class BlockMaxIndex:
    """Inverted lists of unit vectors (CSR by example), cut into blocks of ``BLOCK`` examples with the largest weight of
    each list in each block.

    A batch of queries adds up the lists of seldom terms first. What the common terms (``COMMON`` at most, those of the
    longest lists, kept dense) can still add is bounded for every block, and a block is only added up for the queries whose
    k-th best score so far its bound reaches. Sums are in single precision; examples that come within ``SLACK`` of the k-th
    best are summed again in double precision, so the result is exact.
    """

    terms: int
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    common: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    ends: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)
    values: np.ndarray = field(init=False)
    dense: np.ndarray = field(init=False)
    most: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n, lens = len(self.start) - 1, np.bincount(self.term, minlength=self.terms)
        self.common = np.sort(np.lexsort((np.arange(self.terms), -lens))[:COMMON])
        self.place = np.full(self.terms, -1, np.int32)
        self.place[self.common] = np.arange(len(self.common))
        example, at = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.start)), self.place[self.term]
        self.dense = np.zeros((len(self.common), -(-n // BLOCK) * BLOCK), np.float32)
        self.dense[at[at >= 0], example[at >= 0]] = self.weight[at >= 0]
        self.most = self.dense.reshape(len(self.common), -1, BLOCK).max(2)
        seldom = np.flatnonzero(at < 0)
        seldom = seldom[np.argsort(self.term[seldom], kind="stable")]
        self.ends = np.searchsorted(self.term[seldom], np.arange(self.terms + 1))
        self.own, self.values = example[seldom], self.weight[seldom].astype(np.float32)

    def search(self, start: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of the queries (CSR), but an example in ``without``, the k examples of largest positive inner product,
        ties to the smaller number, best first."""
        out = []
        for i in range(0, len(start) - 1, TOGETHER):
            s = start[i : i + TOGETHER + 1]
            own = slice(s[0], s[-1])
            out += self._batch(s - s[0], term[own], weight[own], k, None if without is None else without[i : i + TOGETHER])
        return out

    def _batch(self, start, term, weight, k, without):
        queries, n = len(start) - 1, len(self.start) - 1
        query = np.repeat(np.arange(queries), np.diff(start))
        q = np.zeros((queries, len(self.common)), np.float32)
        at = self.place[term]
        q[query[at >= 0], at[at >= 0]] = weight[at >= 0]
        rest = at < 0
        first, size = self.ends[term[rest]], self.ends[term[rest] + 1] - self.ends[term[rest]]
        before = np.cumsum(size) - size
        each = np.arange(int(size.sum())) + np.repeat(first - before, size)
        cells = np.repeat(query[rest] * self.dense.shape[1], size) + self.own[each]
        scores = np.bincount(cells, np.repeat(weight[rest].astype(np.float32), size) * self.values[each], queries * self.dense.shape[1])
        scores = scores.astype(np.float32).reshape(queries, -1)
        if without is not None:
            scores[np.arange(queries), without] = -np.inf
        blocks = scores.reshape(queries, -1, BLOCK)
        bounds = blocks.max(2) + q @ self.most
        least, done = np.zeros(queries, np.float32), np.zeros(bounds.shape, bool)
        for b in np.argsort(-bounds.sum(0), kind="stable"):
            need = np.flatnonzero(bounds[:, b] + SLACK >= least)
            if len(need):
                blocks[need, b] += q[need] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]
                done[need, b] = True
                if k <= BLOCK:
                    found = blocks[need, b]
                    least[need] = np.maximum(least[need], np.partition(found, BLOCK - k, axis=1)[:, BLOCK - k])
        blocks[~done] = -np.inf
        return [self._exact(scores[i, :n], term[start[i] : start[i + 1]], weight[start[i] : start[i + 1]], k) for i in range(queries)]

    @cached_property
    def query(self) -> np.ndarray:
        """Room for one query's weights, all zero between uses."""
        return np.zeros(self.terms)

    def _exact(self, scores: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.flatnonzero(scores > 0)
        if len(ids) > k:
            some = scores[ids]
            ids = ids[some >= np.partition(some, len(ids) - k)[len(ids) - k] - SLACK]
        if not len(ids):
            return ids, np.zeros(0)
        q = self.query
        q[term] = weight
        size = self.start[ids + 1] - self.start[ids]
        before = np.cumsum(size) - size
        each = np.arange(int(size.sum())) + np.repeat(self.start[ids] - before, size)
        exact = np.add.reduceat(q[self.term[each]] * self.weight[each], before)
        q[term] = 0
        order = np.lexsort((ids, -np.round(exact, 12)))[:k]
        order = order[exact[order] > 0]
        return ids[order], exact[order]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of y on x by pooling adjacent violators: mean x and mean y of each pool."""
    pools: list[list[float]] = []
    for v in np.unique(x):
        same = x == v
        total = float(w[same].sum())
        pools.append([total * float(v), float((w * y)[same].sum()), total])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex | None
    example_ids: np.ndarray
    toxic: np.ndarray
    stands_for: np.ndarray
    #: Score of a text without any term of the vocabulary.
    base: float
    knots: tuple[np.ndarray, np.ndarray] = (np.array([1.0]), np.array([1.0]))

    def vote(self, ids: np.ndarray, cosine: np.ndarray) -> float:
        w = self.stands_for[ids] / (1 + LEAST_DISTANCE - np.minimum(cosine, 1)) ** 2
        return float((w * self.toxic[ids]).sum() / w.sum())

    def calibrated(self, vote: float) -> float:
        """The vote on the fitted line, straight between the pools' means."""
        return float(np.interp(vote, *self.knots))

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors of texts as (start, term, weight)."""
        text, term, n = term_counts(data, offsets, self.vocabulary)
        weight = (1 + np.log(n)) * self.idf[term]
        norm = np.sqrt(np.bincount(text, weight * weight, len(offsets) - 1))
        return np.searchsorted(text, np.arange(len(offsets))), term, weight / norm[text]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Scores and the ids of the neighbours."""
        data, offsets = utf8_parts(texts)
        scores, near = np.full(len(texts), self.base), [[] for _ in range(len(texts))]
        if self.index is None:
            return scores, near
        for i, j in chunks(offsets):
            o = offsets[i : j + 1]
            for d, (ids, cosine) in enumerate(self.index.search(*self.vectors(data[o[0] : o[-1]], o - o[0]), NEIGHBOURS), i):
                if len(ids):
                    scores[d], near[d] = self.calibrated(self.vote(ids, cosine)), self.example_ids[ids].tolist()
        return scores, near


def train_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> ToxicityModel:
    """Fit on the texts of ``docs`` that ``labels`` (id, label 0/1) marks; null labels count as none, null texts are
    empty, and of several labels of one id the largest holds.

    The sample is drawn from the labels by a hash of the id, so only a bounded number of ids meets the documents.
    Without labels, or with one class only, scores are the share of toxic labels (0 if there are none).
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    have = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, most / max(1, have.get(y, 0))) for y, most in ((0, CLEAN_EXAMPLES), (1, TOXIC_EXAMPLES))}
    draw = (F.xxhash64("k", F.lit(29)).bitwiseAND(0xFFFFFF)) / float(1 << 24)
    picked = known.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    chosen = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(picked), "k")

    @F.arrow_udf("long")
    def signature(texts: pa.Array) -> pa.Array:
        return pa.array(signatures(texts).view(np.int64))

    chosen = chosen.withColumn("s", signature("t")).groupBy("y", "s").agg(F.min_by("t", "k").alias("t"), F.min("k").cast("long").alias("k"), F.count("*").alias("n")).select("k", "t", "y", "n").persist()
    try:
        return _fit(chosen, have, share)
    finally:
        chosen.unpersist()


def _fit(chosen: DataFrame, have: dict, share: dict) -> ToxicityModel:
    def count(batches):
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            y = batch.column(2).to_numpy()
            for i, j in chunks(offsets, 4_000_000):
                o = offsets[i : j + 1]
                doc, term, _ = term_counts(data[o[0] : o[-1]], o - o[0])
                terms, at = np.unique(term, return_inverse=True)
                toxic = np.bincount(at, y[i:j][doc], len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(terms)) - toxic)], ["term", "toxic", "clean"])

    sizes = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    total = max(1, have.get(0, 0) + have.get(1, 0))
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), None, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), have.get(1, 0) / total)
    if not n1 or not n0:
        return empty
    a, c = F.col("a"), F.col("c")
    expected = (a + c) * n1 / (n1 + n0)
    tie = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
    g2 = 2 * (tie(a, expected) + tie(c, a + c - expected))
    terms = chosen.mapInArrow(giving_back(count), "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("c"))
    terms = terms.withColumn("g2", g2).toArrow()
    vocabulary = terms["term"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    df = (terms["a"].to_numpy() / share[1] + terms["c"].to_numpy() / share[0])[order]
    strength = np.sqrt(np.maximum(terms["g2"].to_numpy()[order], 0)) + LEAST_STRENGTH
    model = ToxicityModel(vocabulary[order], (np.log((total + 1) / (df + 1)) + 1) * strength, None, empty.example_ids, empty.toxic, empty.stands_for, empty.base)
    if not len(vocabulary):
        return model

    def vectors(batches):
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            for i, j in chunks(offsets):
                o = offsets[i : j + 1]
                start, term, weight = model.vectors(data[o[0] : o[-1]], o - o[0])
                parts = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x)) for x in (term, weight)]
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(i, j - i) for x in (0, 2, 3)), *parts], ["k", "y", "n", "term", "weight"])

    found = chosen.mapInArrow(giving_back(vectors), "k long, y int, n long, term array<long>, weight array<double>").toArrow().sort_by("k").combine_chunks()
    start = found["term"].combine_chunks().offsets.to_numpy()
    sizes = np.diff(start)
    y, k = found["y"].to_numpy(), found["k"].fill_null(-1).to_numpy()
    stands_for = np.where(y == 1, 1 / share[1], 1 / share[0]) * found["n"].to_numpy()
    silent = sizes == 0
    model.base = float((stands_for * y)[silent].sum() / stands_for[silent].sum()) if silent.any() else 0.0
    model.example_ids, model.toxic, model.stands_for = k[~silent], y[~silent].astype(float), stands_for[~silent]
    term, weight = (found[x].combine_chunks().flatten().to_numpy() for x in ("term", "weight"))
    model.index = BlockMaxIndex(len(vocabulary), np.append(0, np.cumsum(sizes[~silent])), term, weight)
    votes, truth, w = [], [], []
    found = model.index.search(model.index.start, term, weight, NEIGHBOURS, np.arange(len(model.toxic)))
    for e, (ids, cosine) in enumerate(found):
        if len(ids):
            votes.append(model.vote(ids, cosine))
            truth.append(model.toxic[e])
            w.append(model.stands_for[e])
    if votes:
        model.knots = isotonic(np.array(votes), np.array(truth), np.array(w))
    return model


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score", evidence: str = "evidence") -> DataFrame:
    """``docs`` with a score from 0 to 1 and the ids of the labelled neighbours behind it, nearest first.

    Null and empty texts, and texts without a known term, get the rate of toxic labels among such examples and no
    evidence. Columns already so named are replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<s double, e array<long>>")
    def score(texts: pa.Array) -> pa.Array:
        scores, near = shared.value.score(texts)
        give_back()
        return pa.StructArray.from_arrays([pa.array(scores), pa.array(near, pa.list_(pa.int64()))], ["s", "e"])

    return docs.withColumn("_s", score(F.col(text))).withColumns({out: F.col("_s.s"), evidence: F.col("_s.e")}).drop("_s")
