"""SentencePiece encoding to the N best segmentations, and decoding.

The pieces and scores of a SentencePiece model span a lattice over each text (a space mark before it and for every
space; characters without a piece become their bytes). No piece continues past a space mark, so a text is a chain of
segments (marks or a line break, and the characters after them), which fall into parts between characters that no
piece joins. Each part is solved alone: a forward Viterbi pass gives the best
score up to every position, and these are exact heuristics for an A-star search backwards from the end, which yields
segmentations best first. The N best of a text combine the N - 1 smallest losses over all of its parts.

The parts of a batch of texts that are new are solved side by side, those of one length as rows of numpy arrays: one step
relaxes a position of every lattice, or takes the best state off every agenda. Long parts are solved one by one. Tasks
keep the answers to recent parts in two generations of bounded size.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, give_back, mix

MARK = "▁"
#: A character without a piece scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Scores below this are those of reserved pieces, not of worst ones.
RESERVED = -1e8
#: A generation of the cache ends with the batch in which it reaches so many parts.
GENERATION = 60_000
#: Parts up to this length are solved side by side, as many as have so many lattice cells.
SIDE_BY_SIDE, CELLS = 40, 300_000
#: Characters of texts whose new parts are solved together.
TOGETHER = 1_500_000
N_BEST = 3


#: What a normaliser would change if it did more than mark spaces: compatibility forms, case, and spaces on end.
PROBE = " \ufb01 A\u030a  \uff21x "


def only_marks(normalize) -> None:
    """Raises ValueError for models whose own normaliser does more than put a mark in front and in place of spaces."""
    if normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
        raise ValueError("the model's normaliser changes texts; only models that keep them can be decoded exactly")


class Pieces:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        only_marks(model.normalize)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        kinds = [(model.is_control(i), model.is_unknown(i), model.is_byte(i)) for i in range(len(self.names))]
        self.bytes = {int(name[1:-1], 16): i for i, name in enumerate(self.names) if kinds[i][2]}
        score = {name: ((i,), model.get_score(i)) for i, name in enumerate(self.names) if not any(kinds[i])}
        #: Pieces by name, and None for what only begins one.
        self.table = {name[:k]: None for name in score for k in range(1, len(name))} | score
        self.joined = {name[i : i + 2] for name in score for i in range(len(name) - 1)}
        self.unknown_id = model.unk_id()
        self.unknown = min((s for _, s in score.values() if s > RESERVED), default=0.0) - UNKNOWN_PENALTY
        self.raw = [b"" if c or u else bytes([int(n[1:-1], 16)]) if b else n.encode() for n, (c, u, b) in zip(self.names, kinds, strict=True)]
        self.fresh: dict[str, tuple] = {}
        self.stale: dict[str, tuple] = {}
        self.longest = max(map(len, score), default=1)
        hashed = np.concatenate([h for length in range(1, self.longest + 1) if (h := hashes(codes([x for x in score if len(x) == length], length))[-1][:, 0]).size] or [np.zeros(0, np.uint64)])
        found = [v for length in range(1, self.longest + 1) for x, v in score.items() if len(x) == length]
        order = np.argsort(hashed)
        self.hashes, self.ids, self.scores = hashed[order], np.array([v[0][0] for v in found], np.int32)[order], np.array([v[1] for v in found])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        letters = sorted({c for pair in self.joined for c in pair})
        self.kind, self.kinds = np.zeros(0x110000, np.int32), len(letters) + 1
        self.kind[codes(letters, 1)[:, 0]] = np.arange(1, self.kinds)
        pairs = self.pair_numbers(codes(sorted(self.joined), 2)).ravel()
        #: A bit for each pair of characters that a piece joins.
        self.pairs = np.zeros(self.kinds * self.kinds // 8 + 1, np.uint8)
        np.bitwise_or.at(self.pairs, pairs >> 3, (1 << (pairs & 7)).astype(np.uint8))

    def lattice(self, segment: str) -> tuple[list[list[tuple[int, tuple]]], list[float]]:
        """For each position, what ends there (start, (ids, score)), and the best score up to it (forward Viterbi)."""
        n, get = len(segment), self.table.get
        ends, best = [[] for _ in range(n + 1)], [0.0, *[-float("inf")] * n]
        for i in range(n):
            sofar, known = best[i], False
            for j in range(i + 1, n + 1):
                hit = get(segment[i:j], 0)
                if hit:
                    ends[j].append((i, hit))
                    if sofar + hit[1] > best[j]:
                        best[j] = sofar + hit[1]
                    known |= j == i + 1
                elif hit == 0:
                    break
            if not known:
                ids = tuple(self.bytes.get(b, self.unknown_id) for b in segment[i].encode("utf-8", "replace"))
                ends[i + 1].append((i, (ids, self.unknown)))
                best[i + 1] = max(best[i + 1], sofar + self.unknown)
        return ends, best

    def n_best(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """At most n segmentations, best first, as (score, ids).

        Every state on the agenda leads to a segmentation of exactly its estimate, so of m still wanted only the m best
        states are kept.
        """
        ends, best = self.lattice(segment)
        out, made = [], 0
        agenda = [(-best[-1], 0, len(segment), 0.0, None)]
        while agenda and len(out) < n:
            _, _, at, done, path = agenda.pop(0)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            wanted = n - len(out)
            limit = agenda[wanted - 1][0] if len(agenda) >= wanted else float("inf")
            for i, (ids, s) in ends[at]:
                estimate = -(done + s + best[i])
                if estimate < limit:
                    made += 1
                    agenda.append((estimate, made, i, done + s, (ids, path)))
            agenda.sort()
            del agenda[wanted:]
        return out

    def side_by_side(self, parts: list[str], n: int) -> list[tuple]:
        """The ``answer`` to what ``n_best`` finds for each of ``parts``, all of one length."""
        size, length = len(parts), len(parts[0])
        wide = min(self.longest, length)
        # cells: by part, end and start; the last ``wide`` starts before an end, in order
        score, piece = np.full((size, length + 1, wide), -np.inf), np.full((size, length + 1, wide), -1, np.int32)
        for m, h in enumerate(hashes(codes(parts, length))[:wide], 1):
            row, i = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            h = h[row, i]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            row, i, at = row[hit], i[hit], at[hit]
            score[row, i + m, wide - m], piece[row, i + m, wide - m] = self.scores[at], self.ids[at]
        row, end = np.nonzero(np.isneginf(score[:, 1:, -1]))
        score[row, end + 1, -1] = self.unknown
        best = np.full((size, length + 1), -np.inf)
        best[:, 0] = 0
        for j in range(1, length + 1):
            m = min(wide, j)
            best[:, j] = (best[:, j - m : j] + score[:, j, wide - m :]).max(1)

        who, cost, at = np.arange(size), np.full((size, n), np.inf), np.full((size, n), length)
        cost[:, 0] = -best[:, -1]
        done, node, wanted = np.zeros((size, n)), np.full((size, n), -1), np.full(size, n)
        steps, columns = np.arange(wide) - wide, np.arange(n)
        score, piece, best = score.reshape(-1, wide), piece.reshape(-1), best.reshape(-1)
        # nodes: what was taken last, and the node of what was taken before; then what is found: part, score and node
        taken, after, made, found = [], [], 0, []
        while len(who):
            ended = at[:, 0] == 0
            if ended.any():
                e = np.flatnonzero(ended)
                found.append((who[e], done[e, 0], node[e, 0]))
                wanted[e] -= 1
            cell, s0 = who * (length + 1) + at[:, 0], done[:, 0]
            start = at[:, :1] + steps
            part = score.take(cell, axis=0)
            part[ended] = -np.inf
            reached = s0[:, None] + part
            every = np.empty((len(who), n - 1 + wide))  # no score begins before a part, so those starts cost infinity
            every[:, : n - 1] = cost[:, 1:]
            np.negative(reached + best.take((who * (length + 1))[:, None] + np.maximum(start, 0)), out=every[:, n - 1 :])
            order = np.argsort(every, axis=1, kind="stable")[:, :n]
            rows = np.arange(len(who))[:, None]
            cost = every.reshape(-1).take(rows * every.shape[1] + order)
            cost[columns >= wanted[:, None]] = np.inf
            new = order >= n - 1
            old, step = rows * n + np.where(new, 0, order + 1), np.where(new, order - (n - 1), 0)
            grown = node.reshape(-1).take(old)
            r, c = np.nonzero(new & (cost < np.inf))
            taken.append(piece.take(cell[r] * wide + step[r, c]))
            after.append(node[r, 0])
            grown[r, c] = made + np.arange(len(r))
            made += len(r)
            done = np.where(new, reached.reshape(-1).take(rows * wide + step), done.reshape(-1).take(old))
            at = np.where(new, start.reshape(-1).take(rows * wide + step), at.reshape(-1).take(old))
            node = grown
            keep = cost[:, 0] < np.inf
            if not keep.all():
                who, cost, at, done, node, wanted = (x[keep] for x in (who, cost, at, done, node, wanted))
        return self._read_off(parts, found, np.concatenate(taken), np.concatenate(after))

    def _read_off(self, parts: list[str], found: list[tuple], taken: np.ndarray, after: np.ndarray) -> list[tuple]:
        """The answers for parts in order, by following nodes from the first piece of what is found to the last."""
        part, score, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(part, kind="stable")
        part, score, at = part[order], score[order], at[order]
        ids, used, left = [], np.zeros(len(at), np.int64), np.arange(len(at))
        while len(left):
            column = np.zeros(len(at), np.int32)
            column[left] = taken[at[left]]
            ids.append(column)
            used[left] += 1
            at[left] = after[at[left]]
            left = left[at[left] >= 0]
        table = np.stack(ids, axis=1)
        blob, starts = table.tobytes(), np.arange(len(at)) * (4 * len(ids))
        ways = [blob[i:j] for i, j in zip(starts.tolist(), (starts + 4 * used).tolist(), strict=True)]
        for k in np.flatnonzero((table < 0).any(axis=1)).tolist():
            ways[k] = self.with_bytes(ways[k], parts[part[k]])
        firsts = np.flatnonzero(np.diff(part, prepend=-1))
        losses, score = (np.repeat(score[firsts], np.diff(np.append(firsts, len(part)))) - score).tolist(), score.tolist()
        others = list(zip(losses, ways, strict=True))
        ends = [*firsts[1:].tolist(), len(part)]
        return [(score[i], ways[i], others[i + 1 : j], losses[i + 1] if j > i + 1 else float("inf")) for i, j in zip(firsts.tolist(), ends, strict=True)]

    def with_bytes(self, ids: bytes, part: str) -> bytes:
        """Ids in which characters without a piece (-1) become their bytes' ids."""
        out, i = [], 0
        for x in array("i", ids):
            if x >= 0:
                out.append(x)
                i += len(self.names[x])
            else:
                out += [self.bytes.get(b, self.unknown_id) for b in part[i].encode("utf-8", "replace")]
                i += 1
        return pack(out)

    def solved(self, parts: list[str], n: int) -> dict[str, tuple]:
        """Score and ids of the best, (loss, ids) of the others, and the least loss, of each part."""
        by_length: dict[int, list[str]] = {}
        for part in parts:
            by_length.setdefault(len(part), []).append(part)
        out = {}
        for length, own in by_length.items():
            most = max(1, CELLS // ((length + 1) * min(self.longest, length))) if length <= SIDE_BY_SIDE else 1
            for i in range(0, len(own), most):
                some = own[i : i + most]
                found = self.side_by_side(some, n) if length <= SIDE_BY_SIDE else [answer([(score, pack(ids)) for score, ids in self.n_best(x, n)]) for x in some]
                out.update(zip(some, found, strict=True))
        return out

    def pair_numbers(self, code: np.ndarray) -> np.ndarray:
        """For each two code points side by side, which bit of ``pairs`` is theirs."""
        kind = self.kind[code].astype(np.int64)
        return kind[..., :-1] * self.kinds + kind[..., 1:]

    def parts(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The parts of texts of marks in order, and where each text's begin among them (one place more than texts). A
        part ends with its segment, and between characters that no piece holds side by side."""
        whole, ends = "".join(texts), np.cumsum([0, *map(len, texts)])
        if not whole:
            return [], [0] * len(ends)
        code = codes([whole], len(whole))[0]
        pair, mark = self.pair_numbers(code), code == ord(MARK)
        starts = np.ones(len(code), bool)
        starts[1:] = (self.pairs[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 == 0
        starts[1:] |= mark[1:] & ~mark[:-1] | (code[1:] == ord("\n"))
        starts[ends[:-1][ends[:-1] < len(code)]] = True
        at = np.flatnonzero(starts)
        between = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in whole)
        parts = np.insert(code, at[1:], ord(between)).tobytes().decode("utf-32-le", "surrogatepass").split(between)
        return parts, np.searchsorted(at, ends).tolist()

    def learn(self, wanted: set[str], n: int) -> None:
        """See to it that ``fresh`` answers for all of the parts."""
        if len(self.fresh) >= GENERATION:
            self.stale, self.fresh = self.fresh, {}
        new = [s for s in wanted if s not in self.fresh]
        self.fresh.update((s, self.stale[s]) for s in new if s in self.stale)
        new = [s for s in new if s not in self.fresh]
        if not new:
            return
        gc.disable()  # many small tuples, none of them in a cycle
        try:
            self.fresh.update(self.solved(new, n))
        finally:
            gc.enable()

    def encode(self, text: str, n: int = N_BEST) -> tuple[list[tuple[float, bytes]], bool]:
        """At most n segmentations of a text, best first (ties go to the change of the earliest part), and whether
        all of them decode to it."""
        return next(self.encode_all([text], n))

    def encode_all(self, texts: list[str], n: int = N_BEST):
        """What ``encode`` gives, for each of the texts."""
        i = 0
        while i < len(texts):
            j, size = i + 1, len(texts[i])
            while j < len(texts) and size + len(texts[j]) <= TOGETHER:
                size += len(texts[j])
                j += 1
            marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts[i:j]]
            parts, within = self.parts(marked)
            self.learn(set(parts), n)
            found = list(map(self.fresh.__getitem__, parts))
            for k, text in enumerate(texts[i:j]):
                yield self._whole(text, found[within[k] : within[k + 1]], n) if text else ([(0.0, b"")], True)
            i = j

    def _whole(self, text: str, parts: list[tuple], n: int) -> tuple[list[tuple[float, bytes]], bool]:
        ways = combined(parts, n)
        same = all(self.raw_of(parts[k][1]) == self.raw_of(parts[k][2][r][1]) for _, _, chosen in ways for _, k, r in chosen)
        return [way[:2] for way in ways], same and self.decode(ways[0][1]) == text

    def raw_of(self, ids: bytes) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in unpack(ids)])

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes on end, marks as spaces, without the first one."""
        text = self.raw_of(ids).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def combined(parts: list[tuple], n: int) -> list[tuple[float, bytes, tuple]]:
    """The n best ways through parts on end, as (score, ids, what differs from the best: (loss, part, choice)). Only the
    n - 1 smallest losses of all parts can take part."""
    near = range(len(parts))
    if len(parts) > 16:
        least = np.fromiter(map(_least, parts), float, len(parts))
        near = np.flatnonzero(least <= (np.partition(least, n - 2)[n - 2] if n > 1 else np.inf)).tolist()
    losses = sorted([(loss, k, r) for k in near for r, (loss, _) in enumerate(parts[k][2])])[: n - 1]
    ways = [(0.0, ()), *((c[0], (c,)) for c in losses)]
    if n > 3:  # two changes never come before the second best single one
        ways += [(sum(c[0] for c in chosen), chosen) for size in range(2, n) for chosen in combinations(losses, size) if len({c[1] for c in chosen}) == size]
        ways.sort(key=lambda w: (w[0], [c[1:] for c in w[1]]))
    best, ids, out = sum(map(_best, parts)), list(map(_ids, parts)), []
    for loss, chosen in ways[:n]:
        own = ids.copy() if chosen else ids
        for _, k, r in chosen:
            own[k] = parts[k][2][r][1]
        out.append((best - loss, b"".join(own), chosen))
    return out


_best, _ids, _least = itemgetter(0), itemgetter(1), itemgetter(3)


def answer(found: list[tuple[float, bytes]]) -> tuple[float, bytes, list[tuple[float, bytes]], float]:
    """Score and ids of the best, (loss, ids) of the others, and the least loss."""
    losses = [(found[0][0] - s, ids) for s, ids in found[1:]]
    return (*found[0], losses, losses[0][0] if losses else float("inf"))


def codes(texts: list[str], length: int) -> np.ndarray:
    """Code points of texts of one length, a row for each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), length)


def hashes(code: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of all runs of 1, 2, ... code points of each row, by start."""
    code, out = code.astype(np.uint64), []
    h = np.zeros(code.shape, np.uint64)
    for m in range(1, code.shape[1] + 1):
        h = (h[:, : code.shape[1] - m + 1] + code[:, m - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append(mix(h + np.uint64(m)))
    return out


def pack(ids) -> bytes:
    return array("I", ids).tobytes()


def unpack(ids: bytes) -> array:
    return array("I", ids)


def segments(text: str) -> list[str]:
    """Marks or a line break (which no piece holds) with what follows them."""
    return re.findall(f"(?:{MARK}+|\\n)[^{MARK}\\n]*", MARK + text.replace(" ", MARK))


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def with_pieces(docs: DataFrame, path: str, text: str = "text", n: int = N_BEST) -> DataFrame:
    """``docs`` with struct column ``pieces``: ids of the best segmentation (binary, little-endian 32-bit), n_pieces,
    scores (of the n best, falling) and crcs (crc32 of each one's ids), and whether all of them decode to the text.

    ``path`` is a SentencePiece model that every executor can read. Null and empty texts have one segmentation, without
    pieces. A text that holds the space mark itself decodes to a space there, so ``exact`` is false for it.
    """

    bound_batches(docs.sparkSession)

    @F.arrow_udf("struct<ids binary, n_pieces long, scores array<double>, crcs array<long>, exact boolean>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, kinds = load(path), (pa.binary(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
        try:
            for texts in batches:
                columns = ([], [], [], [], [])
                for found, exact in model.encode_all([t or "" for t in texts.to_pylist()], n):
                    row = (found[0][1], len(found[0][1]) // 4, [s for s, _ in found], [zlib.crc32(ids) for _, ids in found], exact)
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
                out = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ids", "n_pieces", "scores", "crcs", "exact"])
                del columns, texts
                yield out
                del out
                give_back()
        finally:  # the worker goes on to other stages
            model.fresh, model.stale = {}, {}
            del model
            load.cache_clear()
            gc.collect()
            give_back()

    return docs.withColumn("pieces", encode(F.col(text)))


def with_text(rows: DataFrame, path: str, ids: str, out: str = "text") -> DataFrame:
    """``rows`` with the text that binary ``ids`` decode to (null: null)."""

    @F.arrow_udf("string")
    def decode(blobs: pa.Array) -> pa.Array:
        model = load(path)
        return pa.array([None if b is None else model.decode(b) for b in blobs.to_pylist()], pa.string())

    return rows.withColumn(out, decode(F.col(ids)))
