"""N-gram Jaccard join by token-combination prefixes: components of texts whose shingle sets are alike.

Equal sets are one entity (64-bit digest of the sorted shingle hashes, beside the set's size). Shingles are ordered by
class: those of one text only, rare ones, frequent ones; by hash within a class. The classes come from document counts
over all texts.
Two sets of size n and m that are alike share a token within the first p = n - ceil(t n) + 1 of theirs, and two tokens
within the first p + 1. So an entity is indexed under its rare tokens singly, and under pairs of its frequent ones
within the extended prefix; entities with more than ``WIDE`` frequent tokens there are indexed under them singly
instead, where they also meet the others. Tokens that only one text has, told by a bitmap of fixed size, fill prefixes
but are never indexed or shared.

No index group is expanded into all of its pairs. First members meet the entity of their group and size class that has
the fewest tokens of its own, as a group's origin would, and each entity is verified against the one of those whose
sketch is nearest (and those of next size classes against each other); the links found make components. Then only members of different components remain to be compared:
those outside a group's largest component against the group's other members, unless their sketches prove that they
differ too much. No candidate pair stays unverified unless the two are connected already, so the components are exact.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of, bound_batches, chunks, cut, give_back, giving_back, mix, utf8_parts, word_hashes

#: Words in a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 4, 85
#: A token is frequent from so many texts on; doubled until at most ``MOST_FREQUENT`` tokens are (8 bytes each).
FREQUENT, MOST_FREQUENT = 32, 4_000_000
WIDE = 10
#: Bits of the bitmap of tokens that several texts have.
BITMAP_BITS = 28
#: Least cells of an entity's sketch, a power of two and a multiple of 8.
SKETCH_CELLS = 1024
#: Cells of the small sketches that rule out pairs where they meet.
SMALL_CELLS = 256
TEXTS_PER_BUCKET = 2_000
#: Small frames are coalesced, so that a task has the rows of so many texts at least, or so many links.
TEXTS_PER_TASK, LINKS_PER_TASK = 2_000, 50_000
#: Members outside the largest component of an index group that a task holds against the group's others; larger groups are split.
FEW_PER_TASK = 500
#: Bytes of texts whose tokens a task sorts together.
SLICE_BYTES = 16_000_000
#: So many ids of texts to verify are broadcast at most (8 bytes each); beyond, the texts are joined by id.
MOST_IDS = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int):
    """The sorted distinct shingle hashes of each text, in order."""
    data, offsets = utf8_parts(texts)
    for i, j in chunks(offsets):
        o = offsets[i : j + 1]
        h, at, _ = word_hashes(data[o[0] : o[-1]], o - o[0])
        n = np.diff(at)
        rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * _STEP + h[k : k + len(rolled)]
        rolled = mix(rolled)
        for d in range(j - i):
            if n[d] >= words:
                yield np.unique(rolled[at[d] : at[d + 1] - words + 1])
            elif n[d]:
                short = n[d : d + 1].astype(np.uint64)
                for k in range(at[d], at[d + 1]):
                    short = mix(short * _STEP + h[k : k + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch):
    """The batch's rows, texts (its second column) of about ``SLICE_BYTES`` at a time."""
    _, offsets = utf8_parts(batch.column(1))
    for i, j in chunks(offsets, SLICE_BYTES):
        yield batch.slice(i, j - i)


def digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts in cells, at least ``SKETCH_CELLS`` and twice as many as tokens: two sketches
    differ in no more cells than their sets in tokens. Cells are powers of two, so that a longer sketch folds."""
    cells = max(SKETCH_CELLS, 1 << (2 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1).tobytes()


def small_sketch(cells: bytes) -> list[int]:
    """A sketch folded to ``SMALL_CELLS``, as 64-bit numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(cells, np.int64).reshape(-1, SMALL_CELLS // 64), axis=0).tolist()


def sketch_distance(x: np.ndarray, y: np.ndarray) -> int:
    """Cells in which two sketches differ, the longer one folded to the other's length."""
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def token_layout(rows: int) -> tuple[int, int]:
    """Bits that tokens keep in counting, and those of them that name the bucket."""
    buckets = max(4, math.ceil(math.log2(blocks_of(rows, TEXTS_PER_BUCKET))))
    return max(32, min(52, math.ceil(math.log2(max(rows, 1) * 1000)) + 5)), min(buckets, BITMAP_BITS - 3)


def read_texts(docs: DataFrame, key: str, text: str, words: int, layout: tuple[int, int]) -> DataFrame:
    """One pass over all texts: for every row (id, n, e, sketch, small) with the size and digest of its shingle set (e is null
    for empty sets), and rows (bucket, blob) with the tokens of a batch as sorted, compressed differences."""
    bits, bucket_bits = layout
    shift, in_bucket = np.uint64(64 - bits), bits - bucket_bits

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        names = ["id", "n", "e", "sketch", "small", "bucket", "blob"]
        for batch in (part for whole in batches for part in slices(whole)):
            sets = list(shingle_sets(batch.column(1), words))
            none = lambda kind, n=len(sets): pa.nulls(n, kind)
            links = [len(s) > 0 and i.is_valid for s, i in zip(sets, batch.column(0), strict=True)]
            cells = [sketch(s) if x else None for s, x in zip(sets, links, strict=True)]
            sketches, small = pa.array(cells, pa.binary()), pa.array([small_sketch(c) if c else None for c in cells], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if x else None for s, x in zip(sets, links, strict=True)], pa.int64()), sketches, small, none(pa.int32()), none(pa.binary())], names)
            tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
            del sets
            tokens >>= shift
            tokens.sort()
            ends = np.searchsorted(tokens, np.arange((1 << bucket_bits) + 1, dtype=np.uint64) << np.uint64(in_bucket))
            found = [b for b in range(1 << bucket_bits) if ends[b + 1] > ends[b]]
            blobs = [pack.compress(np.diff(tokens[ends[b] : ends[b + 1]], prepend=np.uint64(b << in_bucket)).astype(np.uint64 if in_bucket > 32 else np.uint32).tobytes()) for b in found]
            none = lambda kind, n=len(found): pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.list_(pa.int64())), pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names)

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(giving_back(run), "id long, n long, e long, sketch binary, small array<long>, bucket int, blob binary")


def token_classes(blobs: DataFrame, layout: tuple[int, int]) -> tuple[np.ndarray, int, np.ndarray]:
    """Sorted frequent tokens (their upper bits), the shift to those bits, and the bitmap of tokens in several texts."""
    bits, bucket_bits = layout
    in_bucket, in_map = bits - bucket_bits, BITMAP_BITS - bucket_bits

    def count(group: pa.Table) -> pa.Table:
        bucket, unpack = group["bucket"][0].as_py(), zstandard.ZstdDecompressor()
        parts = [np.cumsum(np.frombuffer(unpack.decompress(x.as_py()), np.uint64 if in_bucket > 32 else np.uint32), dtype=np.uint64) for x in group["blob"]]
        tokens, n = np.unique(np.concatenate(parts) + np.uint64(bucket << in_bucket), return_counts=True)
        shared = np.zeros(1 << in_map, bool)
        shared[((tokens[n > 1] & np.uint64((1 << in_bucket) - 1)) >> np.uint64(max(0, in_bucket - in_map))).astype(np.int64)] = True
        often = n >= FREQUENT
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "shared": [zstandard.compress(np.packbits(shared).tobytes())], "tokens": pa.array([tokens[often].view(np.int64)], pa.list_(pa.int64())), "counts": pa.array([n[often]], pa.list_(pa.int64()))})

    counted = cut(blobs.groupBy("bucket").applyInArrow(count, "bucket int, shared binary, tokens array<long>, counts array<long>").coalesce(1 << max(0, bucket_bits - 1)))
    by_size = counted.select(F.explode("counts").alias("n")).groupBy(F.floor(F.log2("n")).alias("power")).count().collect()
    least = int(math.log2(FREQUENT))
    while sum(r["count"] for r in by_size if r["power"] >= least) > MOST_FREQUENT:
        least += 1
    often = F.filter(F.arrays_zip("tokens", "counts"), lambda x: x["counts"] >= (1 << least))
    found = counted.select("bucket", "shared", F.transform(often, lambda x: x["tokens"]).alias("often")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    size = (1 << in_map) // 8
    for bucket, shared in zip(found["bucket"].to_pylist(), found["shared"], strict=True):
        bitmap[bucket * size : (bucket + 1) * size] = np.frombuffer(zstandard.decompress(shared.as_py()), np.uint8)
    often = found["often"].combine_chunks().flatten()
    return np.sort(often.to_numpy().view(np.uint64)), 64 - bits, bitmap


def index(docs: DataFrame, text: str, words: int, percent: int, classes: tuple[np.ndarray, int, np.ndarray]) -> DataFrame:
    """(key, e, n, own, pos, kind): the prefix tokens and combinations under which each entity is found, and how many
    of its tokens no other text has; kind is 0 for rare tokens, 1 for pairs of frequent ones, 2 for frequent ones alone
    (3 if the entity is not under pairs)."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        often, shift, bitmap = shared.value
        seen: set[int] = set()
        for batch in batches:
            keys, owners = [], []
            for tokens in shingle_sets(batch.column(0), words):
                n = len(tokens)
                p = n - (percent * n + 99) // 100 + 1
                if 100 * n < percent * (n + 1) or (e := digest(tokens)) in seen:
                    continue  # no other set can be alike, or these rows are there already
                if len(seen) < 200_000:
                    seen.add(e)
                upper = tokens >> np.uint64(shift)
                frequent = often[np.minimum(np.searchsorted(often, upper), len(often) - 1)] == upper if len(often) else np.zeros(n, bool)
                at = tokens >> np.uint64(64 - BITMAP_BITS)
                several = (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0
                rare, common = tokens[several & ~frequent], tokens[frequent]
                own = n - len(rare) - len(common)
                before = own + len(rare)
                single = rare[: max(0, p - own)]
                common = common[: max(0, p + 1 - before)]
                alone = common[: max(0, p - before)]
                parts = [(single, own + np.arange(len(single)), 0), (alone, before + np.arange(len(alone)), 2 if len(common) <= WIDE else 3)]
                if 2 <= len(common) <= WIDE:
                    i, j = np.triu_indices(len(common), 1)
                    parts.append((mix(common[i] * np.uint64(3) + common[j]), before + i, 1))
                for k, pos, kind in parts:
                    keys.append((k, pos, np.full(len(k), kind)))
                    owners.append((e, n, own, len(k)))
            if keys:
                k, pos, kind = (np.concatenate(x) for x in zip(*keys, strict=True))
                e, n, own, reps = (np.array(x, np.int64) for x in zip(*owners, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.repeat(e, reps)), pa.array(np.repeat(n, reps)), pa.array(np.repeat(own, reps)), pa.array(pos.astype(np.int64)), pa.array(kind.astype(np.int32))], ["key", "e", "n", "own", "pos", "kind"])

    return docs.select(text).mapInArrow(giving_back(run), "key long, e long, n long, own long, pos long, kind int")


def may_link(percent: int) -> Column:
    """Sizes and places of a common prefix token of entities (e, n, own, pos) and (o, m, others, at) allow the
    similarity: what both can still share suffices. Own tokens come first and are never shared."""
    n, m, i, j = (F.col(c) for c in ("n", "m", "pos", "at"))
    rest = F.least(n - i, m - j) + F.least(i - F.col("own"), j - F.col("others"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * rest >= percent * (n + m))


def of_pairs(pairs: DataFrame, first: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """The pairs, and what ``first`` knows of the entities in them."""
    pairs = cut(pairs)
    involved = pairs.select(F.col("a").alias("e")).union(pairs.select("b")).distinct()
    few = 2 * pairs.count() <= MOST_IDS
    return pairs, first.join(F.broadcast(involved) if few else involved, "e", "left_semi").coalesce(parts)


def sketched(pairs: DataFrame, first: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b, ...) that the sketches don't rule out, with ``apart``, the cells in which these differ."""

    @F.arrow_udf("long")
    def apart(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([sketch_distance(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(xs, ys, strict=True)], pa.int64())

    pairs, known = of_pairs(pairs, first, parts)
    side = lambda e, s, n: known.select(F.col("e").alias(e), F.col("sketch").alias(s), F.col("n").alias(n))
    rows = pairs.join(side("a", "x", "xn"), "a").coalesce(parts).join(side("b", "y", "yn"), "b").coalesce(parts).withColumn("apart", apart("x", "y"))
    return rows.where((100 + percent) * F.col("apart") <= (100 - percent) * (F.col("xn") + F.col("yn"))).select(*pairs.columns, "apart")


def verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, key: str, text: str, words: int, percent: int, repeats: bool, parts: int) -> DataFrame:
    """Those pairs (a, b) of entities whose sets are alike; ``first`` has a text's id for each entity (e, id). Where an
    id has several texts, only the one with the entity's digest counts."""
    pairs, known = of_pairs(pairs, first.select("e", "id"), parts)
    known = cut(known)
    few = known.count() <= MOST_IDS

    def tokens(batches):
        for batch in batches:
            e = batch.column(0).to_pylist()
            found = [(k, s.tobytes()) for k, s in zip(e, shingle_sets(batch.column(1), words), strict=True) if digest(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.binary()))], ["e", "s"])
            give_back()

    @F.arrow_udf("boolean")
    def alike(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs, ys, strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    texts = docs.select(F.col(key).cast("long").alias("id"), text).join(F.broadcast(known) if few else known, "id")
    sets = texts.select("e", text).mapInArrow(tokens, "e long, s binary")
    sets = cut(sets.dropDuplicates(["e"]).coalesce(parts) if repeats else sets)
    both = pairs.join(sets.select(F.col("e").alias("a"), F.col("s").alias("x")), "a").coalesce(parts).join(sets.select(F.col("e").alias("b"), F.col("s").alias("y")), "b").coalesce(parts)
    return both.where(alike("x", "y")).select("a", "b")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (u, v) but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, top = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = top[u], top[v]
        least, new = np.minimum(x, y), top.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        while (jumped := new[new]).tolist() != new.tolist():
            new = jumped
        if (new == top).all():
            break
        top = new
    low = np.flatnonzero(top < np.arange(len(nodes)))
    return nodes[low], nodes[top[low]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what ``edges`` connects: every task's edges as stars, slice by slice."""

    def run(batches):
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            kept = stars(*(np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["u", "v"])

    return edges.mapInArrow(giving_back(run), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(e, c): the smallest node that each linked node can reach. Every task turns its links into stars first; then
    large-star and small-star steps alternate until nothing changes."""
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    parts = blocks_of(links.count(), LINKS_PER_TASK, least=4)
    edges, state = cut(contracted(links.coalesce(parts))), None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").coalesce(parts).distinct().coalesce(parts))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return edges.select(F.col("u").alias("e"), F.col("v").alias("c"))
        state = now


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``: the smallest id reachable over links.

    Words are runs without ASCII white space, with A-Z lower-cased. Texts with fewer words than a shingle have one
    shingle; null texts and texts without words have none and link with nothing. Rows may repeat; equal sets are linked
    always. Rows without an id have a null component and link with nothing, as no id can name them. Other columns of
    ``docs`` are not read.
    """
    bound_batches(docs.sparkSession)
    n = docs.count()
    layout, parts = token_layout(n), blocks_of(n, TEXTS_PER_TASK)
    read = cut(read_texts(docs, key, text, words, layout))
    own = read.where("bucket is null").select("id", "n", "e")
    first = cut(read.where("e is not null").groupBy("e").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("small").alias("small")).coalesce(parts))
    repeats = not own.groupBy("id").count().where("count > 1").coalesce(parts).isEmpty()
    found = cut(index(docs, text, words, percent, token_classes(read.where("bucket is not null"), layout)).distinct().coalesce(parts))
    rare = found.where("kind = 0").withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1").drop("size").coalesce(parts)
    size_class = F.floor(F.log("n") / -math.log(percent / 100))
    members = cut(rare.union(found.where("kind > 0")).withColumn("size_class", size_class).coalesce(parts))
    pivots = cut(members.groupBy("key", "kind", "size_class").agg(F.min(F.struct("own", "e", "n", "pos")).alias("p")).coalesce(parts))
    met = lambda rows, beside: rows.where((F.col("e") != F.col("o")) & may_link(percent)).select(F.greatest("e", "o").alias("a"), F.least("e", "o").alias("b"), F.lit(beside).alias("beside")).coalesce(parts)
    other = pivots.select("key", "kind", "size_class", F.col("p.e").alias("o"), F.col("p.n").alias("m"), F.col("p.own").alias("others"), F.col("p.pos").alias("at"))
    star = met(members.join(other, ["key", "kind", "size_class"]), False)
    below = other.withColumn("size_class", F.col("size_class") - 1)
    beside = met(pivots.select("key", "kind", "size_class", "p.*").join(below, ["key", "kind", "size_class"]), True)
    pairs = star.union(beside).groupBy("a", "b").agg(F.max("beside").alias("beside")).coalesce(parts)
    near = cut(sketched(pairs, first, percent, parts))
    ends = near.select(F.col("a").alias("e"), F.struct("apart", F.col("b").alias("o")).alias("x")).union(near.select("b", F.struct("apart", "a")))
    nearest = ends.groupBy("e").agg(F.min("x").alias("x")).select(F.greatest("e", "x.o").alias("a"), F.least("e", "x.o").alias("b"))
    nearest = cut(nearest.union(near.where("beside").select("a", "b")).coalesce(parts).distinct().coalesce(parts))
    check = lambda pairs: cut(verified(pairs, docs, first, key, text, words, percent, repeats, parts))
    links = check(nearest)
    label = components(links)

    kind = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, 0).otherwise(2)
    placed = cut(members.withColumn("group", kind).join(label, "e", "left").withColumn("c", F.coalesce("c", "e")).coalesce(parts))
    counts = placed.groupBy("key", "group", "c").agg(F.count("*").alias("size")).coalesce(parts)
    largest = counts.groupBy("key", "group").agg(F.max_by("c", F.struct("size", "c")).alias("main"), (F.sum("size") - F.max("size")).alias("others"), F.count("*").alias("parts"))
    largest = largest.where("parts > 1").select("key", "group", "main", F.ceil(F.col("others") / FEW_PER_TASK).cast("int").alias("salts")).coalesce(parts)
    mixed = cut(placed.join(largest, ["key", "group"]).coalesce(parts).join(first.select("e", "small"), "e").coalesce(parts))
    few = mixed.where("c <> main").select("key", "group", F.explode(F.sequence(F.col("size_class") - 1, F.col("size_class") + 1)).alias("size_class"), F.pmod(F.xxhash64("e"), "salts").cast("int").alias("salt"), F.col("e").alias("o"), F.col("n").alias("m"), F.col("own").alias("others"), F.col("pos").alias("at"), F.col("kind").alias("other"), F.col("c").alias("d"), F.col("small").alias("folded"))
    rest = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(few, ["key", "group", "size_class", "salt"]).where("c <> d and (c = main or e < o)")
    rest = rest.where((F.col("group") != 2) | (F.col("kind") == 3) | (F.col("other") == 3))
    apart = sum((F.bit_count(F.col("small")[k].bitwiseXOR(F.col("folded")[k])) for k in range(SMALL_CELLS // 64)), F.lit(0))
    rest = rest.where(may_link(percent) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m")))).select(F.greatest("e", "o").alias("a"), F.least("e", "o").alias("b")).coalesce(parts).distinct().coalesce(parts)
    more = check(sketched(rest.join(nearest, ["a", "b"], "left_anti").coalesce(parts), first, percent, parts).select("a", "b"))
    label = components(links.union(more))

    ids = first.select("e", "id").join(label, "e", "left").withColumn("c", F.coalesce("c", "e")).coalesce(parts)
    least = ids.groupBy("c").agg(F.min("id").alias("component_id")).coalesce(parts)
    ids = ids.join(least, "c").select("e", "component_id").coalesce(parts)
    linked = own.where("e is not null").join(ids, "e").select("id", F.col("n").alias("n_shingles"), "component_id").coalesce(parts)
    return linked.union(own.where("e is null").select("id", "n", "id"))
