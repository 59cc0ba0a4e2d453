"""Token ids in binary files: an adaptive context-mixing range coder over independent blocks.

A file row holds whole documents in order: their ids and lengths, and their tokens on end, cut into blocks of
``BLOCK`` ids. Each block starts from a fresh model and has a crc32 of its ids, so any block can be read alone. Within
a block, the ids seen after the same two ids (order 2) and after the same id (order 1) are predicted. Three models tell
how likely it is that the next id is the one prediction, the other, or neither: by the confidence of order 2, by that of
order 1, and by how often both ids were seen in the block at all (order 0). Their probabilities are averaged with weights
that follow how well each model did in the block, and the mixture is coded. Where neither prediction holds, the id is
coded by the block's order-0 distribution of ids: a tree of adaptive distributions of its nibbles, each under those
before it (the last under a hash of them; bits below the upper 16 evenly). All of it drives one carry-propagating range
coder with 32-bit range and 16-bit output. The arithmetic is in integers, so that every machine decodes alike.

Blocks of a row are coded side by side as lanes of numpy arrays: one step handles the next id of every block.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of

BLOCK, LANES = 4096, 1024
TEXTS_PER_PART = 8_000
#: The starts of so many file rows (of up to ``BLOCK`` * ``LANES`` ids) are broadcast at most; beyond, the ids are shuffled to them.
MOST_ROWS = 1_000_000
#: Distinct words whose ids a task remembers, in each of two generations.
WORDS_KEPT = 250_000
_SLOTS = 10
_TOTAL = 15
_RATE = 5
#: How fast the mixture's weights follow what each model earns, and the least that a model keeps of 2**15.
_WEIGHT_RATE, _LEAST_WEIGHT = 4, 512
#: For each nibble of an id: bits of its table of distributions, and their rate.
_LEVELS = ((0, 6), (4, 6), (8, 5), (9, 3))
ROW = "part int, row int, doc_ids array<long>, lengths array<long>, bits int, sizes array<int>, crcs array<long>, payload binary"


def _even(n: int, shape: tuple) -> np.ndarray:
    return np.broadcast_to((np.arange(n + 1, dtype=np.int32) << _TOTAL) // n, (*shape, n + 1)).copy()


def _towards(n: int) -> np.ndarray:
    """For each symbol, the cumulative distribution that moves all but the least share to it."""
    i, s = np.arange(n + 1), np.arange(n)[:, None]
    return np.where(i <= s, i, (1 << _TOTAL) - n + i).astype(np.int32)


class _Encoder:
    def __init__(self, lanes: int, ids: int) -> None:
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, (1 << 32) - 1, np.int64)
        self.width = 2 * ids + 16
        self.out, self.at = np.zeros(lanes * self.width, np.int32), np.arange(lanes) * self.width

    def reserve(self, words: int) -> None:
        """See that each lane has room for so many words more."""
        firsts = np.arange(len(self.low)) * self.width
        if int((self.at - firsts).max(initial=0)) + words > self.width:
            wider = np.zeros((len(self.low), 2 * self.width + words), np.int32)
            wider[:, : self.width] = self.out.reshape(-1, self.width)
            self.at += np.arange(len(self.low)) * (wider.shape[1] - self.width)
            self.out, self.width = wider.reshape(-1), wider.shape[1]

    def symbol(self, lanes: np.ndarray | None, cdf: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Code a symbol in each of ``lanes`` (None: all) by its row of cumulative shares."""
        at = np.arange(len(symbols)) * cdf.shape[1] + symbols
        flat = cdf.reshape(-1)
        start = flat.take(at)
        self._take(lanes, start, flat.take(at + 1) - start)
        return symbols

    def even(self, lanes: np.ndarray, bits: int, symbols: np.ndarray) -> np.ndarray:
        self._take(lanes, symbols << (_TOTAL - bits), 1 << (_TOTAL - bits))
        return symbols

    def _take(self, lanes: np.ndarray | None, start, share) -> None:
        left = self.range if lanes is None else self.range.take(lanes)
        part = left >> _TOTAL
        low = (self.low if lanes is None else self.low.take(lanes)) + part * start
        left = part * share
        full = np.flatnonzero(left < 1 << 16)
        if len(full):
            value = low.take(full)
            who = full if lanes is None else lanes.take(full)
            at = self.at.take(who)
            self.out[at - 1] += value >> 32
            self.out[at] = (value >> 16) & 0xFFFF
            self.at[who] = at + 1
            low[full] = (value & 0xFFFF) << 16
            left[full] <<= 16
        if lanes is None:
            self.low, self.range = low, left
        else:
            self.low[lanes], self.range[lanes] = low, left

    def finish(self) -> list[bytes]:
        self.reserve(2)
        self.out[self.at - 1] += self.low >> 32
        for shift in (16, 0):
            self.out[self.at] = (self.low >> shift) & 0xFFFF
            self.at += 1
        words = self.out.reshape(len(self.low), self.width)
        sizes = self.at - np.arange(len(self.low)) * self.width
        for i in range(int(sizes.max(initial=0)) - 1, 0, -1):  # carries run towards the start
            words[:, i - 1] += words[:, i] >> 16
        return [(row[:n] & 0xFFFF).astype("<u2").tobytes() for row, n in zip(words, sizes, strict=True)]


class _Decoder:
    def __init__(self, payloads: list[bytes], ids: int) -> None:
        width = max(len(p) // 2 for p in payloads) + 8
        words = np.zeros((len(payloads), width), np.int64)
        for row, p in zip(words, payloads, strict=True):
            row[: len(p) // 2] = np.frombuffer(p, "<u2")
        self.code = (words[:, 0] << 16) | words[:, 1]
        self.words, self.at = words.reshape(-1), np.arange(len(payloads)) * width + 2
        self.range = np.full(len(payloads), (1 << 32) - 1, np.int64)

    def reserve(self, words: int) -> None:
        """All words are there already."""

    def _slot(self, lanes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = (self.range if lanes is None else self.range.take(lanes)) >> _TOTAL
        code = self.code if lanes is None else self.code.take(lanes)
        return part, code, np.minimum(code // part, (1 << _TOTAL) - 1)

    def symbol(self, lanes: np.ndarray | None, cdf: np.ndarray, _) -> np.ndarray:
        part, code, slot = self._slot(lanes)
        symbols = np.count_nonzero(cdf[:, 1:] <= slot[:, None], axis=1)
        at = np.arange(len(symbols)) * cdf.shape[1] + symbols
        flat = cdf.reshape(-1)
        start = flat.take(at)
        self._take(lanes, code - part * start, part * (flat.take(at + 1) - start))
        return symbols

    def even(self, lanes: np.ndarray, bits: int, _) -> np.ndarray:
        part, code, slot = self._slot(lanes)
        symbols = slot >> (_TOTAL - bits)
        self._take(lanes, code - part * (symbols << (_TOTAL - bits)), part << (_TOTAL - bits))
        return symbols

    def _take(self, lanes: np.ndarray | None, code: np.ndarray, left: np.ndarray) -> None:
        low = np.flatnonzero(left < 1 << 16)
        if len(low):
            who = low if lanes is None else lanes.take(low)
            at = self.at.take(who)
            code[low] = (code.take(low) << 16) | self.words.take(at)
            left[low] <<= 16
            self.at[who] = at + 1
        if lanes is None:
            self.code, self.range = code, left
        else:
            self.code[lanes], self.range[lanes] = code, left


class _Order:
    """Predictions of the next id by a hashed context: in each slot an id, and below it a confidence from 0 to 3."""

    def __init__(self, lanes: int) -> None:
        self.slots, self.base = np.full(lanes << _SLOTS, -4, np.int32), np.arange(lanes) << _SLOTS

    def guess(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.base + (context & ((1 << _SLOTS) - 1))
        held = self.slots.take(at)
        return at, held >> 2, held & 3

    def learn(self, at: np.ndarray, guess: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> None:
        """A right guess gains confidence, a wrong one loses it, and without any the id seen takes its place."""
        held = np.where(guess == ids, (guess << 2) | np.minimum(sure + 1, 3), (guess << 2) | np.maximum(sure - 1, 0))
        self.slots[at] = np.where((guess != ids) & (sure <= 1), (ids << 2) | 1, held)


class _Mixture:
    """Three models of which prediction holds, averaged by lane with weights that each model's probabilities earn."""

    def __init__(self, lanes: int) -> None:
        self.cdfs = _even(3, (3 * lanes * 16,))
        self.base = (np.arange(3)[:, None] * lanes + np.arange(lanes)) * 16
        self.weights = np.full((3, lanes), (1 << _TOTAL) // 3, np.int32)
        self.weights[0] += (1 << _TOTAL) - self.weights.sum(axis=0)
        self.to = _towards(3)

    def open(self, contexts: np.ndarray) -> np.ndarray:
        """The mixture under a context from 0 to 15 of each model in each lane."""
        self.at = self.base + contexts
        self.each = self.cdfs.take(self.at, axis=0)
        return (self.each * self.weights[:, :, None]).sum(axis=0, dtype=np.int32) >> _TOTAL

    def learn(self, mixed: np.ndarray, hit: np.ndarray) -> None:
        self.cdfs[self.at] = self.each + ((self.to.take(hit, axis=0) - self.each) >> _RATE)
        lane, n = np.arange(len(hit)) * 4 + hit, len(hit) * 4
        lane = lane + np.arange(3)[:, None] * n
        flat, whole = self.each.reshape(-1), mixed.reshape(-1)
        own = flat.take(lane + 1) - flat.take(lane)
        earned = self.weights * own // (whole.take(lane[0] + 1) - whole.take(lane[0]))
        weights = np.clip(self.weights + ((earned - self.weights) >> _WEIGHT_RATE), _LEAST_WEIGHT, 1 << _TOTAL)
        weights = ((weights << _TOTAL) // weights.sum(axis=0)).astype(np.int32)
        weights[0] += (1 << _TOTAL) - weights.sum(axis=0, dtype=np.int32)
        self.weights = weights


class _Tree:
    """The order-0 distribution of ids: their four upper nibbles, each under a hash of those before it, and even bits."""

    def __init__(self, lanes: int, bits: int) -> None:
        self.low = max(0, bits - 16)
        self.levels = [(rate, 1 << size, _even(16, (lanes << size,))) for size, rate in _LEVELS]
        self.to = _towards(16)

    def code(self, coder, lanes: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        above = np.zeros(len(lanes), np.int64)
        for k, (rate, width, cdfs) in enumerate(self.levels):
            at = lanes * width + ((above * 0x9E3779B1) >> 7) % width
            cdf = cdfs.take(at, axis=0)
            x = coder.symbol(lanes, cdf, (ids >> (self.low + 12 - 4 * k)) & 15 if ids is not None else None)
            cdfs[at] = cdf + ((self.to.take(x, axis=0) - cdf) >> rate)
            above = (above << 4) | x
        if self.low:
            above = (above << self.low) | coder.even(lanes, self.low, ids & ((1 << self.low) - 1) if ids is not None else None)
        return above


def _run(coder, lanes: int, ids: np.ndarray | None, length: int, bits: int) -> np.ndarray:
    """Code ``length`` ids of every lane; decoding, ``ids`` is None."""
    out = np.zeros((length, lanes), np.int32) if ids is None else ids
    two, one, mixture, tree = _Order(lanes), _Order(lanes), _Mixture(lanes), _Tree(lanes, bits)
    seen, seen_base = np.zeros(lanes << _SLOTS, np.uint8), np.arange(lanes) << _SLOTS
    slot = lambda x: seen_base + (((x.astype(np.int64) * 0x9E3779B1) >> 13) & ((1 << _SLOTS) - 1))
    before, last, contexts = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros((3, lanes), np.int64)
    for t in range(length):
        if t % 64 == 0:
            coder.reserve(64 * 6)
        at2, g2, c2 = two.guess((before * 0x9E3779B1 + last * 0x85EBCA77) >> 9)
        at1, g1, c1 = one.guess((last * 0xC2B2AE3D) >> 11)
        alike = g1 == g2
        contexts[0] = c2 * 4 + alike * 2 + (c1 > 1)
        contexts[1] = c1 * 4 + alike * 2 + (c2 > 1)
        contexts[2] = seen.take(slot(g2)) * 4 + seen.take(slot(g1))
        cdf = mixture.open(contexts)
        if ids is not None:
            now = out[t]
            hit = coder.symbol(None, cdf, np.where(now == g2, 0, np.where(now == g1, 1, 2)))
        else:
            hit = coder.symbol(None, cdf, None)
            now = np.where(hit == 0, g2, g1)
        mixture.learn(cdf, hit)
        miss = np.flatnonzero(hit == 2)
        if len(miss):
            found = tree.code(coder, miss, now.take(miss).astype(np.int64) if ids is not None else None)
            if ids is None:
                now[miss] = found
        if ids is None:
            out[t] = now
        two.learn(at2, g2, c2, now)
        one.learn(at1, g1, c1, now)
        at = slot(now)
        seen[at] = np.minimum(seen.take(at) + 1, 3)
        before, last = last, now.astype(np.int64)
    return out


def encode_blocks(ids: np.ndarray, bits: int) -> tuple[list[bytes], list[int]]:
    """The coded blocks of ids (below 2**bits), and the crc32 of each block's ids."""
    if not 9 <= bits <= 8 + _TOTAL:
        raise ValueError(f"ids of {bits} bits can't be coded")
    length = min(BLOCK, max(1, len(ids)))
    lanes = max(1, -(-len(ids) // length))
    filled = np.zeros(lanes * length, np.int32)
    filled[: len(ids)] = ids
    coder = _Encoder(lanes, length)
    _run(coder, lanes, np.ascontiguousarray(filled.reshape(lanes, length).T), length, bits)
    return coder.finish(), [zlib.crc32(filled[i * length : (i + 1) * length].astype("<u4").tobytes()) for i in range(lanes)]


def decode_blocks(payloads: list[bytes], crcs: list[int], n: int, bits: int) -> np.ndarray:
    """The n ids of a row's blocks. Raises ValueError where a block's checksum doesn't hold."""
    length = min(BLOCK, max(1, n))
    out = np.ascontiguousarray(_run(_Decoder(payloads, length), len(payloads), None, length, bits).T)
    for i, (row, crc) in enumerate(zip(out, crcs, strict=True)):
        if zlib.crc32(row.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return out.ravel()[:n]


class Words:
    """Ids of texts by the tokenizers library, word by word: no token of such a vocabulary reaches over white space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.bits = max(9, (self.model.get_vocab_size() - 1).bit_length())
        self.fresh: dict[str, bytes] = {}
        self.stale: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [t.split() if t.isascii() and not _separators.search(t) else _ascii_words(t) for t in texts]
        new = list({w for own in words for w in own} - self.fresh.keys())
        for w in new:
            if w in self.stale:
                self.fresh[w] = self.stale[w]
        new = [w for w in new if w not in self.fresh]
        for w, found in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.fresh[w] = np.array(found.ids, "<u4").tobytes()
        out = [b"".join(map(self.fresh.__getitem__, own)) for own in words]
        if len(self.fresh) > WORDS_KEPT:
            self.stale, self.fresh = self.fresh if len(self.fresh) < 2 * WORDS_KEPT else {}, {}
        return out


#: str.split() cuts at these too, but the tokenizer has tokens for them.
_separators = re.compile("[\x1c-\x1f]")
_white = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def _ascii_words(text: str) -> list[str]:
    return [w for w in text.translate(_white).split(" ") if w]


@lru_cache(2)
def load(path: str) -> Words:
    return Words(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = 2) -> None:
    """Write the ids of every text, each followed by ``end``, to files under ``path`` in ascending order of ``key``.

    ``vocabulary`` is a file of the tokenizers library whose tokens never span white space, readable by every executor.
    Null and empty texts have the end id alone. Rows without a key come first, and rows that share one are in the order of
    a hash of their texts, so that a key of many rows is dealt over parts; equal rows are alike in any order. A part is a
    range of keys and is numbered by it. Other columns are ignored.
    """
    parts = blocks_of(docs.count(), TEXTS_PER_PART)

    def rows(batches):
        from pyspark import TaskContext

        part, number, model = TaskContext.get().partitionId(), 0, load(vocabulary)
        ids, lengths, held, n = [], [], [], 0

        def told():
            payloads, crcs = encode_blocks(np.concatenate(held), model.bits)
            values = (part, number, ids, lengths, model.bits, [len(p) for p in payloads], crcs, b"".join(payloads))
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split(" ")[0] for c in ROW.split(", ")])

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                piece = batch.slice(i, 500)
                for doc, found in zip(piece.column(0).to_pylist(), model.encode([t or "" for t in piece.column(1).to_pylist()]), strict=True):
                    own = np.append(np.frombuffer(found, "<u4"), np.uint32(end))
                    if n and n + len(own) > BLOCK * LANES:
                        yield told()
                        number, ids, lengths, held, n = number + 1, [], [], [], 0
                    ids.append(doc)
                    lengths.append(len(own))
                    held.append(own)
                    n += len(own)
        if n:
            yield told()

    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("order", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(parts, "key", "order").sortWithinPartitions("key", "order", "text").drop("order")
    ordered.mapInArrow(rows, ROW).write.mode("overwrite").parquet(path)


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in files read from a folder of ``write_tokens``; ids is binary,
    little-endian unsigned 32-bit. start counts the ids of all documents before."""
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = files.select("part", "row", n.alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    by_row = totals.select("part", "row", before(Window.partitionBy("part").orderBy("row")).alias("offset"))
    starts = by_row.join(by_part, "part").select("part", "row", (F.col("base") + F.col("offset")).alias("start"))

    def docs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                cuts = np.append(0, np.cumsum(row["sizes"]))
                ids = decode_blocks([row["payload"][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], row["crcs"], sum(row["lengths"]), row["bits"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                firsts = ends - row["lengths"]
                whole = [ids[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(whole), pa.int32()), pa.array([row["row"]] * len(whole), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(firsts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(whole, pa.binary())], ["part", "row", "doc_id", "first", "n_tokens", "ids"])

    found = files.mapInArrow(docs, "part int, row int, doc_id long, first long, n_tokens long, ids binary")
    few = files.count() <= MOST_ROWS
    return found.join(F.broadcast(starts) if few else starts, ["part", "row"]).select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids")
