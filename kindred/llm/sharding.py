"""Sharding by balanced label propagation over linked documents, in DataFrame operations only.

Documents of one group are linked with one another (here: equal texts). Every linked document starts in a shard drawn
by hash of its row, so at first most links are cut. Round by round, documents move to the shard with room that most of
their neighbours are in, unless more of them are where they are, as far as that shard's quota of rows allows. Where room
is short, a group's small parts go or stay together, and large ones are split. The rounds end when nothing moves any
more. Documents without links then fill the shards up to quotas that are at most one apart, so the ``rows`` law holds
exactly.

Positions (slots, and ranks that decide who overflows) come from two levels: counts of hash buckets of bounded size
are summed up, and rows are numbered within a bucket. No window ever spans a shard or a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of, cut

ROUNDS = 12
ROWS_PER_BUCKET = 20_000
#: Small tables are coalesced, so that a task has so many rows at least.
TEXTS_PER_TASK = 5_000
#: A group's part moves as one if it takes up at most this share of the room in its target shard.
WHOLE_SHARE = 1 / 16
#: Of the places that documents are about to leave in a round, so many are given to others in the same round.
GIVEN_AHEAD = 0.25


def numbered(rows: DataFrame, keys: list[str], out: str, buckets: int) -> DataFrame:
    """A gapless number from 0 within each combination of ``keys``, in an order given by hash."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("row")
    return rows.join(offsets, [*keys, "_bucket"]).withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1).drop("_bucket", "_offset")


def chance(*columns: str, salt: int) -> Column:
    return F.xxhash64(*columns, F.lit(salt)).bitwiseAND(0xFFFFFF) / float(1 << 24)


def by_shard(values: list, shard: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(shard) + 1)


def per_shard(rows: DataFrame, shard: str, shards: int) -> list[int]:
    """Rows in each shard (as many numbers as shards)."""
    n = {r[0]: r[1] for r in rows.groupBy(shard).count().collect()}
    return [n.get(s, 0) for s in range(shards)]


def cut_links(placed: DataFrame) -> int:
    """Pairs of rows of one group that are in different shards."""
    n = placed.groupBy("group", "shard").agg(F.count("*").alias("n")).groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return n.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0)).cast("long")).first()[0]


def start(linked: DataFrame, shards: int) -> DataFrame:
    """Each linked row in a shard drawn by hash."""
    return linked.select("row", "group", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(shards)).cast("int").alias("shard"))


def propagate(linked: DataFrame, quota: list[int], rounds: int, parts: int = 8) -> DataFrame:
    """Rows (row, group) with a shard each, after at most ``rounds`` of moves towards neighbours: as many or more of them
    must be at the target as are, itself included, where a row is. A shard that gets more than its quota in a round has
    no room in the next ones."""
    shards = len(quota)
    placed = cut(start(linked, shards).coalesce(parts))
    for turn in range(rounds):
        votes = cut(placed.groupBy("group", "shard").agg(F.count("*").alias("n")).coalesce(parts))
        load = {r[0]: r[1] for r in votes.groupBy("shard").agg(F.sum("n")).collect()}
        free = [q - load.get(s, 0) for s, q in enumerate(quota)]
        wish = votes.groupBy("group").agg(F.max(F.struct("n", F.xxhash64("group", "shard"), "shard")).alias("best"))
        leaving = votes.join(wish, "group").where(F.col("shard") != F.col("best.shard")).groupBy("shard").agg(F.sum("n")).collect()
        ahead = {r[0]: int(r[1] * GIVEN_AHEAD) for r in leaving}
        room = [f + ahead.get(s, 0) if f > 0 else 0 for s, f in enumerate(free)]
        open_ = votes.where(by_shard(room, "shard") > 0).groupBy("group").agg(F.max(F.struct("n", F.xxhash64("group", "shard"), "shard")).alias("best"))
        target = votes.join(open_, "group").where((F.col("shard") != F.col("best.shard")) & (F.col("best.n") >= F.col("n")))
        target = cut(target.select("group", "shard", F.col("best.shard").alias("target"), F.col("n").alias("movers")).coalesce(parts))
        wanted = {r[0]: r[1] for r in target.groupBy("target").agg(F.sum("movers")).collect()}
        if not wanted:
            break
        odds = [min(1.0, r / wanted[s]) if wanted.get(s) else 0.0 for s, r in enumerate(room)]
        together = F.col("movers") <= by_shard([r * WHOLE_SHARE for r in room], "target")
        draw = F.when(together, chance("group", salt=turn)).otherwise(chance("row", salt=turn))
        moves = F.col("target").isNotNull() & (draw < by_shard(odds, "target"))
        placed = cut(placed.join(target, ["group", "shard"], "left").select("row", "group", F.when(moves, F.col("target")).otherwise(F.col("shard")).alias("shard")).coalesce(parts))
    return placed


def balanced_shards(docs: DataFrame, group: str, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with shard (from 0) and slot (gapless from 0 in each shard); shards differ by one row at most.

    Rows whose ``group`` is null, or occurs once, have no links. Rows may repeat: each is a row of its own. Without rows
    the result is empty. Columns named shard or slot are replaced; row, group, place and pool are taken here, so others of
    these names are dropped.
    """
    n = docs.count()
    rows = cut(docs.coalesce(blocks_of(n, TEXTS_PER_TASK)).withColumn("group", F.col(group)).withColumn("row", F.monotonically_increasing_id()).drop("place", "pool", "shard", "slot"))
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    buckets = blocks_of(n, ROWS_PER_BUCKET)
    pairs = rows.where("group is not null").groupBy("group").agg(F.count("*").alias("size")).where("size > 1")
    linked = rows.select("row", "group").join(pairs, "group")
    parts = blocks_of(n, TEXTS_PER_TASK)
    placed = numbered(propagate(linked, quota, rounds, parts), ["shard"], "place", buckets)
    kept = cut(placed.where(F.col("place") < by_shard(quota, "shard")).select("row", "shard").coalesce(parts))
    need = [q - k for q, k in zip(quota, per_shard(kept, "shard", shards), strict=True)]
    free = numbered(rows.select("row").join(kept, "row", "left_anti").withColumn("pool", F.lit(0)), ["pool"], "place", buckets)
    shard, end = F.lit(shards - 1), sum(need)
    for s in range(shards - 2, -1, -1):
        end -= need[s + 1]
        shard = F.when(F.col("place") < end, s).otherwise(shard)
    everyone = kept.unionByName(free.select("row", shard.cast("int").alias("shard")))
    return numbered(rows.join(everyone, "row").coalesce(parts), ["shard"], "slot", buckets).coalesce(parts).drop("row", "group")


def sharded_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents in shards by the ``rows`` law, equal texts linked: doc_id, size, text_crc32, law, shard, slot and
    grown_shard (null, as growing is not this law's). A null text has size 1, the crc32 of no bytes and no links."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("text_md5"),
    )
    placed = balanced_shards(rows, "text_md5", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
