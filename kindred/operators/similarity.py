"""Agreement of raters over the films that both rated."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.checkpoints import cut
from kindred.operators.ratings import placed

TWIN, MIRROR = 0.5, -0.4
#: A film of more pairs of raters goes by blocks of users.
FILM_PAIRS = 4_096
USERS_PER_BLOCK, FILMS_AT_ONCE = 512, 1_024
#: Users of two blocks whose pairs are worked out at once, so that their sums stay in the processor's cache.
USERS_AT_ONCE = 64, 256
#: Blocks on each side of a task's tiles, and the least number of parts that small inputs are dealt over.
BLOCKS_PER_TASK, LEAST_PARTS = 8, 4
#: The same for predictions: blocks of targets in a task, and parts that all histories are dealt over.
TARGET_BLOCKS, HISTORY_PARTS = 2, 4
#: Variances below this share of the mean square are rounding.
NO_SPREAD = 1e-11
#: Correlations this far apart may be one to six decimals.
CLOSE = 2e-6
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
CORRELATED = ["n", "r"]
COUNTS = {"n", "marked"}
TURNED = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
#: What sums of doubled values are taken by.
HALVED = {"sx": 0.5, "sy": 0.5, "sxx": 0.25, "syy": 0.25, "sxy": 0.25}


def percentiles(ratings: DataFrame) -> DataFrame:
    """Ratings with pct, the midrank percentile within the user's whole history; users with one rating have none. A user's
    ratings are counted by level, and ranks follow from the counts of the few levels, so no task sorts a history. ``steps`` is
    twice the midrank from 0, a whole number: a user's pct are these by one factor, so both correlate alike."""
    levels = ratings.where("rating is not null").groupBy("user_id", "rating").agg(F.count("*").alias("_n"))
    whole, below = Window.partitionBy("user_id"), Window.partitionBy("user_id").orderBy("rating").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(below), F.lit(0))
    pct = F.try_divide(before + (F.col("_n") - 1) / 2.0, (F.sum("_n").over(whole) - 1).cast("double"))
    ranked = levels.select("user_id", "rating", pct.alias("pct"), (2 * before + F.col("_n") - 1).alias("steps"))
    return ratings.join(ranked.where("pct is not null"), ["user_id", "rating"])


def co_rated(left: DataFrame, right: DataFrame, value: str = "rating", ordered: bool = True) -> DataFrame:
    """(a, b, film, x, y): films that two users both rated. Joined by film; a frame of targets small enough is broadcast
    by Spark itself."""
    a = left.select(F.col("user_id").alias("a"), "film", F.col(value).alias("x"))
    b = right.select(F.col("user_id").alias("b"), "film", F.col(value).alias("y"))
    return a.join(b, "film").where(F.col("a") < F.col("b") if ordered else F.col("a") != F.col("b"))


def pair_counts(ratings: DataFrame) -> DataFrame:
    """(a, b, n): how many films two users both rated, a < b."""
    return pair_sums(ratings.withColumn("_one", F.lit(1.0)), value="_one", sums=["n"])


class Block:
    """The ratings of a block of users: user ids, how many ``copies`` each stands for, and ``same``, a number by which equal
    histories are known; for each rating the user's place, the film's place among ``films`` (sorted), value and mark."""

    def __init__(self, row: dict, side: str) -> None:
        read = lambda name, kind: np.frombuffer(row[side + name], kind)
        self.users, self.copies, self.same, self.films = (read(k, np.int64) for k in ("users", "copies", "same", "films"))
        small = lambda name, most: read(name, np.min_scalar_type(most)).astype(np.int64)
        levels = read("levels", np.float64)
        self.at, self.code, self.values = small("at", len(self.users)), small("codes", len(self.films)), levels[small("values", len(levels))]
        self.marked = read("marks", np.uint8) > 0
        self.own = {mark: self.films[np.bincount(self.code[self.marked == mark], minlength=len(self.films)) > 0] for mark in (False, True)}
        twice = 2 * self.values
        self.whole = bool((twice == np.rint(twice)).all())
        self.peak = float(np.abs(twice).max(initial=0))
        self.kept: dict[bool, tuple] = {}

    def over(self, films: np.ndarray, marked: bool | None, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Dense users x ``films`` (sorted): what is there, and its values. ``marked``: only these ratings; None: all."""
        at, place, some = self.places(films, marked)
        there, value = np.zeros((len(self.users), len(films))), np.zeros((len(self.users), len(films)))
        there[at, place] = 1
        value[at, place] = (self.values if values is None else values)[some]
        return there, value

    def places(self, films: np.ndarray, marked: bool | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Users' and films' places of the ratings of ``films``, and which ratings these are."""
        place = np.minimum(np.searchsorted(films, self.films), len(films) - 1)
        place[films[place] != self.films] = -1
        place = place[self.code]
        some = place >= 0 if marked is None else (place >= 0) & (self.marked == marked)
        return self.at[some], place[some], some

    def powers(self, films: np.ndarray, kind: type, marked: bool = False, most: int = 2) -> np.ndarray:
        """Powers from 0 to ``most`` of twice the ratings of ``films``, marked ones or others: powers x users x ``films``, 0
        where there are none. The last ones are kept."""
        key = kind, most, films.tobytes()
        if marked not in self.kept or self.kept[marked][0] != key:
            at, place, some = self.places(films, marked)
            found = np.zeros((most + 1, len(self.users), len(films)), kind)
            flat = at * len(films) + place
            found[0].reshape(-1)[flat] = 1
            if most:
                found[1].reshape(-1)[flat] = 2 * self.values[some]
                np.multiply(found[1], found[1], out=found[2])
            self.kept[marked] = key, found
        return self.kept[marked][1]


def packed(cells: DataFrame, side: str, parts: int) -> DataFrame:
    """Ratings (i, u, f, v, m, copies, same) as one row for each block i, its columns named with ``side``. ``same`` gives the
    order of users in the block."""
    names = ["users", "copies", "same", "films", "at", "codes", "levels", "values", "marks"]

    def pack(t: pa.Table) -> pa.Table:
        read = lambda name: t[name].to_numpy(zero_copy_only=False)
        users, first, at = np.unique(read("u"), return_index=True, return_inverse=True)
        films, codes = np.unique(read("f"), return_inverse=True)
        same = read("same")[first]
        order = np.lexsort((users, same))
        at = np.argsort(order)[at]
        by_user = (x.astype(np.int64) for x in (users[order], read("copies")[first][order], same[order], films))
        levels, values = np.unique(read("v"), return_inverse=True)
        small = lambda x, most: x.astype(np.min_scalar_type(len(most)))
        arrays = *by_user, small(at, users), small(codes, films), levels, small(values, levels), read("m").astype(np.uint8)
        return pa.table({side: pa.array([t["i"][0].as_py()], pa.int32()), **{side + k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(names, arrays, strict=True)}})

    rows = cells.groupBy("i").applyInArrow(pack, f"{side} int, " + ", ".join(f"{side}{k} binary" for k in names))
    return cut(rows.repartitionByRange(parts, side))


def block_sums(left: Block, right: Block, sums: list[str]) -> Iterator[tuple[slice, slice, dict[str, np.ndarray]]]:
    """Some users of both after others, and the sums of products of all their pairs, over unmarked films that both have; ``marked``: how many marked ones; ``r``: their correlation, as in ``correlated``, NaN where there is none.
    Sums of whole numbers (and halves) are made in single precision where that holds them exactly."""
    needs = {*SUMS, *sums} if "r" in sums else {*sums}
    films = {mark: np.intersect1d(left.own[mark], right.own[mark], assume_unique=True) for mark in ((False, True) if "marked" in needs else (False,))}
    whole = len(left.users), len(right.users)
    step = USERS_AT_ONCE if max(map(len, films.values())) <= FILMS_AT_ONCE else whole
    cuts = [[slice(at, min(at + k, n)) for at in range(0, n, k)] for k, n in zip(step, whole, strict=True)]
    for rows, columns in product(*cuts):
        shape, found = (rows.stop - rows.start, columns.stop - columns.start), {}

        def add(**parts: np.ndarray) -> None:
            for k, x in parts.items():
                if k in needs:
                    found[k] = found[k] + x if k in found else x.astype(np.float64)

        for mark, all_films in films.items():
            for first in range(0, len(all_films), FILMS_AT_ONCE):
                some = all_films[first : first + FILMS_AT_ONCE]
                exact = left.whole and right.whole and max(left.peak, right.peak, 1) ** 2 * len(some) < 1 << 24
                a, b = (x.powers(some, np.float32 if exact else np.float64, mark, 0 if mark or needs <= COUNTS else 2) for x in (left, right))
                a, b = a[:, rows], b[:, columns]
                if len(a) == 1:
                    add(**{"marked" if mark else "n": a[0] @ b[0].T})
                    continue
                of = (a.reshape(-1, len(some)) @ b[0].T).reshape(-1, *shape), (a[:2].reshape(-1, len(some)) @ b[1].T).reshape(-1, *shape)
                add(n=of[0][0], sx=of[0][1], sxx=of[0][2], sy=of[1][0], sxy=of[1][1], syy=a[0] @ b[2].T)
        found |= {k: np.zeros(shape) for k in needs - found.keys() - {"r"}}
        if "r" in needs:
            found["r"] = correlations(found)
        yield rows, columns, {k: found[k] * HALVED[k] if k in HALVED else found[k] for k in sums}


def correlations(found: dict[str, np.ndarray]) -> np.ndarray:
    n, spread = found["n"], None
    for s, q in (("sx", "sxx"), ("sy", "syy")):
        of = n * found[q]
        own = of - found[s] * found[s]
        own *= own > NO_SPREAD * of
        spread = own if spread is None else np.multiply(spread, own, out=spread)
    flat = spread == 0
    if flat.any():
        spread[flat] = np.nan
    r = n * found["sxy"]
    r -= found["sx"] * found["sy"]
    r /= np.sqrt(spread, out=spread)
    return np.round(r, 12, out=r)


def tile_pairs(left: Block, right: Block, sums: list[str], ordered: bool, turned: bool, least: int = 1, far: bool = False, ends: tuple[int, int] | None = None) -> pa.RecordBatch:
    """The pairs of two blocks that share ``least`` films, and if ``far`` are twins or mirrors; of these, if ``ends`` are given,
    so many of highest and of lowest r, and all that come within ``CLOSE`` of them. ``turned``: the blocks are two
    of one frame, so a pair comes up once and is turned round where its ids descend; these follow the others, by their a."""
    straight, back = [], []
    for rows, columns, found in block_sums(left, right, sums):
        users, others, good = left.users[rows, None], right.users[columns], found["n"] >= least
        if far:
            good &= (found["r"] >= TWIN) | (found["r"] <= MIRROR)
        some = np.nonzero(good & (users < others if ordered else users != others))
        straight.append([users[some[0], 0], others[some[1]], *(found[k][some] for k in sums)])
        if turned:
            some = np.nonzero((good & (users > others)).T)[::-1]
            back.append([others[some[1]], users[some[0], 0], *(found[TURNED.get(k, k)][some] for k in sums)])
    kept = list(map(np.concatenate, zip(*straight, *back, strict=True)))
    if ends is not None:
        r = kept[2 + sums.index("r")]
        wanted = np.zeros(len(r), bool)
        for x, k in ((r, ends[0]), (-r, ends[1])):
            wanted |= x >= (np.partition(x, len(x) - k)[len(x) - k] if len(x) > k else -1.0) - CLOSE
        kept = [x[wanted] for x in kept]
    kept = [pa.array(x.astype(np.int64) if k in COUNTS else x, from_pandas=True) for k, x in zip(["a", "b", *sums], kept, strict=True)]
    return pa.RecordBatch.from_arrays(kept, names=["a", "b", *sums])


def cells_of(df: DataFrame, value: str, mark: Column) -> DataFrame:
    """(u, f, v, m): ratings without nulls."""
    rows = df.select(F.col("user_id").cast("long").alias("u"), F.col("film").cast("long").alias("f"), F.col(value).cast("double").alias("v"), F.coalesce(mark, F.lit(False)).alias("m"))
    return cut(rows.where("u is not null and f is not null and v is not null"))


def histories(cells: DataFrame) -> DataFrame:
    """(u, k): a user and the digest of its films, values and marks."""
    each = F.sort_array(F.collect_list(F.struct("f", "v", "m")))
    return cells.groupBy("u").agg(F.sha2(each.cast("string"), 256).alias("k"))


def collapsed(cells: DataFrame, same: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, members): cells of one user, the smallest, for each history, with copies, the number of users who have it, and
    same, the number by which it's known (that user); and (u, c) of all users and the one who stands for them. Users are of
    one history only if they agree in ``same`` (u, same), if it is given, and then are known by that (by their own ids, if
    they aren't in it)."""
    keys = histories(cells)
    if same is not None:
        keys = keys.join(same, "u", "left").withColumn("same", F.coalesce("same", "u"))
    keys, by = cut(keys), ["k"] if same is None else ["k", "same"]
    classes = cut(keys.groupBy(*by).agg(F.min("u").alias("c"), F.count("*").alias("copies")))
    known = F.col("c").alias("same") if same is None else F.col("same")
    return cut(cells.join(classes.select(F.col("c").alias("u"), "copies", known), "u")), cut(keys.join(classes, by).select("u", "c"))


def dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(left, right, cold, any): cells with h, whether their user has a film of more than ``FILM_PAIRS`` pairs of raters;
    (f) of the other films; whether there is a film of so many. Users who share such a film are both of h."""
    raters = left.groupBy("f").agg(F.count("*").alias("_l")).join(right.groupBy("f").agg(F.count("*").alias("_r")), "f")
    raters = cut(raters.select("f", (F.col("_l") * F.col("_r") > FILM_PAIRS).alias("_hot")))
    hot, cold = raters.where("_hot").select("f"), raters.where("not _hot").select("f")
    if hot.isEmpty():
        return left.withColumn("h", F.lit(False)), right.withColumn("h", F.lit(False)), cold, False

    def flagged(df: DataFrame) -> DataFrame:
        users = df.join(F.broadcast(hot), "f", "left_semi").select("u").distinct().withColumn("h", F.lit(True))
        return cut(df.join(users, "u", "left").withColumn("h", F.coalesce("h", F.lit(False))))

    first = flagged(left)
    return first, first if right is left else flagged(right), cold, True


def cold_pairs(left: DataFrame, right: DataFrame, cold: DataFrame, ordered: bool, selves: bool = False) -> DataFrame:
    """(a, b, f, x, y, p, q): films of few raters that two users share who don't both have one of many; p and q: marks.
    ``selves``: users with themselves, too."""
    a = left.select(F.col("u").alias("a"), "f", F.col("v").alias("x"), F.col("m").alias("p"), F.col("h").alias("_ha"))
    b = right.select(F.col("u").alias("b"), "f", F.col("v").alias("y"), F.col("m").alias("q"), F.col("h").alias("_hb"))
    rows = a.join(cold, "f").join(b, "f").where("not (_ha and _hb)")
    wanted = F.col("a") < F.col("b") if ordered else F.col("a") != F.col("b")
    return rows.where(wanted | (F.col("a") == F.col("b")) if selves else wanted).drop("_ha", "_hb")


def cold_sums(rows: DataFrame, sums: list[str]) -> DataFrame:
    plain = ~F.col("p") & ~F.col("q")
    x, y = F.when(plain, F.col("x")), F.when(plain, F.col("y"))
    each = {"n": F.count_if(plain), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y), "marked": F.count_if(F.col("p") & F.col("q"))}
    wanted = dict.fromkeys([*SUMS, *sums] if "r" in sums else sums)
    found = rows.groupBy("a", "b").agg(*[each[k].alias(k) for k in wanted if k != "r"]).where("n > 0")
    return found.select("a", "b", *[correlation().alias("r") if k == "r" else k for k in sums])


def correlation() -> Column:
    """The correlation of a pair by its sums, null at zero variance. A spread that is as small as rounding makes it is none,
    and there are twelve decimals, so that simple fractions stay on their side of a threshold."""
    c, n = F.col, F.col("n")
    spread = lambda s, q: F.when(n * c(q) - c(s) * c(s) > NO_SPREAD * n * c(q), n * c(q) - c(s) * c(s))
    return F.round((n * c("sxy") - c("sx") * c("sy")) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy")), 12)


def blocks(users: int) -> int:
    """How many blocks: of half of ``USERS_PER_BLOCK`` users, while they are few."""
    return max(1, -(-users // USERS_PER_BLOCK), min(LEAST_PARTS, -(-2 * users // USERS_PER_BLOCK)))


def blocks_of(cells: DataFrame) -> tuple[DataFrame, int]:
    """Cells of h by blocks i of about ``USERS_PER_BLOCK`` users, and the number of blocks. Cells of users who each stand for
    themselves go by their histories, so that users of equal ones, and what is found of them, lie side by side."""
    cells = cells.where("h")
    if "copies" not in cells.columns:
        keys = placed(histories(cells), F.conv(F.substr("k", F.lit(1), F.lit(4)), 16, 10).cast("long"), "k", "u")
        keys = cut(keys.select("u", F.lit(1).alias("copies"), F.col("place").alias("same")))
        n = blocks(most := keys.count())
        return cells.join(keys.withColumn("i", F.floor((F.col("same") - 1) * n / max(most, 1)).cast("int")), "u"), n
    n = blocks(cells.select("u").distinct().count())
    return cells.withColumn("i", F.pmod(F.xxhash64("u"), F.lit(n)).cast("int")), n


def tiled(left: DataFrame, right: DataFrame, ordered: bool, sums: list[str], selves: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(cold, tiles) of cells: sums of pairs of which one has no film of many raters, and a row for each pair of blocks of the
    others (i and j with what ``packed`` has of both; None if there are none). Frames that are one give each pair once."""
    same = right is left
    left, right, cold, any_hot = dealt(left, right)
    found = cold_sums(cold_pairs(left, right.select(*[F.col(x).alias(x) for x in right.columns]), cold, ordered, selves), sums)
    if not any_hot:
        return found, None
    l, n_left = blocks_of(left)  # noqa: E741
    r, n_right = (l, n_left) if same else blocks_of(right)
    parts = lambda n: max(-(-n // BLOCKS_PER_TASK), min(n, LEAST_PARTS))
    one, other = packed(l, "i", parts(n_left)), packed(r, "j", parts(n_right))
    tiles = one.crossJoin(other.hint("shuffle_replicate_nl"))
    return found, tiles.where("i <= j") if same and ordered else tiles


def keep_memory() -> None:
    """A large array that is freed once makes the C library keep freed memory up to twice its size, where it would give the
    sums of each tile back and have them zeroed again."""
    np.empty(30 << 20, np.uint8)


def tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block, bool]]:
    """(left, right, whether they are the same block) of each tile. A left block's tiles follow each other, so it is kept."""
    keep_memory()
    at, left = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()
            if left is None or row["i"] != at:
                at, left = row["i"], Block(row, "i")
            yield left, Block(row, "j"), row["i"] == row["j"]


def pair_sums(left: DataFrame, right: DataFrame | None = None, value: str = "rating", ordered: bool = True, sums: list[str] = SUMS, mark: Column | None = None, least: int = 1, far: bool = False, ends: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, n, and sums of x, y, x^2, y^2 and x y) of users a and b of ``left`` and ``right`` (both ``left``, if None) over
    the films that both rated: a < b if ``ordered``, else a <> b. Ids are integers, a user rates a film once. ``sums`` names
    the columns wanted (n among them; r is the correlation). Ratings with a ``mark`` don't count in the sums; ``marked`` is how many of them two
    users share. ``least`` and ``far``: only pairs that share so many films, and that are twins or mirrors (by r); others
    don't leave the task that makes them. ``ends``, with ``far``: a tile gives only these numbers of its pairs of highest and
    lowest r, and what ties with them to six decimals, so the frame holds those of all pairs, and others.

    Users without a film of many raters are joined by film. The others, where a join would square a film's raters, go
    as blocks of ``USERS_PER_BLOCK`` users in the order of their histories' digests, one row each: every pair of blocks is a tile that has its pairs' whole
    sums, so pairs are made once, in the task that reads the two blocks, and neither shuffled nor stored.
    """
    turned, marks = right is None and ordered, F.lit(False) if mark is None else mark
    left = cells_of(left, value, marks)
    found, tiles = tiled(left, left if right is None else cells_of(right, value, marks), ordered, sums)
    if least > 1:
        found = found.where(F.col("n") >= least)
    if far:
        found = found.where((F.col("r") >= TWIN) | (F.col("r") <= MIRROR))
    if tiles is None:
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, other, own in tile_rows(batches):
            yield tile_pairs(one, other, sums, ordered, turned and not own, least, far, ends)

    return found.unionByName(tiles.mapInArrow(run, found.schema))


LEVELS = ["pairs", "known", "twins", "mirrors", "r", "size"]


def tile_levels(left: Block, right: Block, own: bool, most: int, least: int) -> pa.RecordBatch:
    """A tile's part of ``pair_levels``."""
    total = np.zeros((len(LEVELS), (len(left.films) + 1) * (most + 1)))
    copies = left.copies.astype(float), right.copies.astype(float)
    for rows, columns, found in block_sums(left, right, [*CORRELATED, "marked"] if most else CORRELATED):
        n, r = found["n"], found["r"]
        pairs = np.multiply.outer(copies[0][rows], copies[1][columns])
        if own:
            pairs = np.triu(pairs, 1 + rows.start - columns.start)
            one = np.arange(max(rows.start, columns.start), min(rows.stop, columns.stop))
            pairs[one - rows.start, one - columns.start] = copies[0][one] * (copies[0][one] - 1) / 2
        key = (n * (most + 1) + np.minimum(found["marked"], most) if most else n).astype(np.int64).ravel()
        r[n < least] = np.nan
        has = ~np.isnan(r)
        if not has.all():
            r = np.nan_to_num(r, copy=False)
        known = pairs * has
        for k, x in enumerate((pairs, known, known * (r >= TWIN), known * (r <= MIRROR), pairs * r, pairs * np.abs(r))):
            total[k] += np.bincount(key, x.ravel(), minlength=total.shape[1])
    there = np.flatnonzero(total[0, most + 1 :]) + most + 1
    counts = [pa.array(x[there].astype(np.int64)) for x in total[:4]]
    return pa.RecordBatch.from_arrays([pa.array(there % (most + 1)), pa.array(there // (most + 1)), *counts, *(pa.array(x[there]) for x in total[4:])], names=["marked", "n_common", *LEVELS])


def pair_levels(ratings: DataFrame, mark: Column, most: int, least: int, value: str = "rating") -> DataFrame:
    """(marked, n_common, pairs, known, twins, mirrors, r, size): all pairs a < b by how many marked films they share
    (``most`` and more are one) and how many others, at least one. Of those with ``least`` others or more: how many have a
    correlation, are twins, are mirrors, and the sums of the correlations and their sizes. Pairs are those of ``pair_sums``
    and are counted in the task that makes them, so that a few rows a tile leave it. Users of equal histories are one, whose
    pairs count for all of them."""
    cells, _ = collapsed(cells_of(ratings, value, mark))
    pairs, tiles = tiled(cells, cells, True, [*CORRELATED, "marked"], selves=True)
    users = cells.select("u", "copies").distinct()
    for x in ("a", "b"):
        pairs = pairs.join(users.select(F.col("u").alias(x), F.col("copies").alias(f"_{x}")), x)
    times = F.when(F.col("a") == F.col("b"), F.col("_a") * (F.col("_a") - 1) / 2).otherwise(F.col("_a") * F.col("_b")).cast("long")
    r = F.when(F.col("n") >= least, F.col("r"))
    pairs = pairs.select(F.least("marked", F.lit(most)).cast("long").alias("marked"), F.col("n").alias("n_common"), r.alias("r"), times.alias("_k")).where("_k > 0")
    total = lambda x, zero: F.coalesce(F.sum(x), F.lit(zero))
    k, r = F.col("_k"), F.col("r")
    each = [F.sum(k), *[total(F.when(x, k), 0) for x in (r.isNotNull(), r >= TWIN, r <= MIRROR)], total(k * r, 0.0), total(k * F.abs(r), 0.0)]
    found = pairs.groupBy("marked", "n_common").agg(*[x.alias(name) for name, x in zip(LEVELS, each, strict=True)])
    if tiles is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for one, other, own in tile_rows(batches):
                yield tile_levels(one, other, own, most, least)

        found = found.unionByName(tiles.mapInArrow(run, found.schema))
    return found.groupBy("marked", "n_common").agg(*[F.sum(name).alias(name) for name in LEVELS])


def correlated(sums: DataFrame, least: int, *more: str) -> DataFrame:
    """(a, b, n_common, r) and ``more`` columns of pairs with enough films, by their sums or the r that these have."""
    r = F.col("r") if "r" in sums.columns else correlation()
    return sums.where(F.col("n") >= least).select("a", "b", F.col("n").alias("n_common"), r.alias("r"), *more)


def percentile_agreement(ratings: DataFrame, seeds: DataFrame | None = None, least: int = 8, far: bool = False, ends: tuple[int, int] | None = None) -> DataFrame:
    """Correlation of percentile ranks; seeds are left out after ranking, so ranks are of the full history. ``far``: twins
    and mirrors only; ``ends`` as in ``pair_sums``."""
    return correlated(pair_sums(ranked(ratings, seeds), value="steps", sums=CORRELATED, least=least, far=far, ends=ends), least)


def ranked(ratings: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """``percentiles`` without the seeds."""
    found = percentiles(ratings)
    return found if seeds is None else found.join(seeds.select("film"), "film", "left_anti")


def verdict_counts(ratings: DataFrame, seeds: DataFrame | None, least: int) -> DataFrame:
    """(verdict, n): all pairs with a common film by ``verdict`` of their agreement."""
    levels = pair_levels(ranked(ratings, seeds), F.lit(False), 0, least, "steps")
    few, c = F.col("n_common") < least, F.col
    parts = {"insufficient": F.when(few, c("pairs")), "twin": c("twins"), "mirror": c("mirrors"), "unrelated": F.when(~few, c("pairs") - c("twins") - c("mirrors"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("verdict"), F.coalesce(n, F.lit(0)).alias("n")) for k, n in parts.items()]))
    return levels.select(each.alias("x")).groupBy("x.verdict").agg(F.sum("x.n").alias("n")).where("n > 0")


def verdict(r: Column, n_common: Column, least: int) -> Column:
    return F.when(n_common < least, "insufficient").when(r >= TWIN, "twin").when(r <= MIRROR, "mirror").otherwise("unrelated")


def weights(train: DataFrame, history: DataFrame, least: int = 5, least_r: float = 0.15) -> DataFrame:
    """(a, b, w): usable neighbours b of targets a, by raw ratings on a's training films only."""
    return usable(pair_sums(train, history, ordered=False, sums=CORRELATED), least, least_r)


def usable(sums: DataFrame, least: int, least_r: float) -> DataFrame:
    return correlated(sums, least).where(F.abs("r") >= least_r).select("a", "b", F.col("r").alias("w"))


class Asked:
    """What neighbours say of a block of targets' marked films, summed up over the blocks that its task reads."""

    def __init__(self, targets: Block) -> None:
        self.targets, self.films = targets, targets.own[True]
        self.asked = targets.over(self.films, True)[0] > 0 if len(self.films) else np.zeros((len(targets.users), 0), bool)
        self.n, self.norm, self.moved = (np.zeros(self.asked.shape) for _ in range(3))
        self.near = np.zeros(len(targets.users))

    def add(self, other: Block, least: int, least_r: float) -> None:
        """A neighbour counts for all its copies, without the target itself."""
        copies = other.copies.astype(float)
        if len(self.films):
            rated = np.bincount(other.at, minlength=len(other.users))
            mean = np.bincount(other.at, other.values, len(other.users)) / np.maximum(rated, 1)
            there, moved = other.over(self.films, None, other.values - mean[other.at])
            counts = np.float32 if copies.sum() < 1 << 24 else float
            once = there.astype(counts)
        place = np.minimum(np.searchsorted(other.same, self.targets.same), len(other.same) - 1)
        place[other.same[place] != self.targets.same] = -1
        for rows, columns, found in block_sums(self.targets, other, CORRELATED):
            n, w = found.values()
            k = ((np.abs(w) >= least_r) & (n >= least)).astype(float)
            if np.isnan(w).any():
                w = np.nan_to_num(w, copy=False)
            at = place[rows]
            itself = np.flatnonzero((at >= columns.start) & (at < columns.stop))
            itself = itself, at[itself] - columns.start
            own = copies[columns][itself[1]]
            good = k[itself]
            if (copies[columns] != 1).any():
                k *= copies[columns]
            k[itself] = good * (own - 1)
            w *= k
            self.near[rows] += k.sum(axis=1)
            if len(self.films):
                self.n[rows] += k.astype(counts) @ once[columns]
                self.moved[rows] += w @ moved[columns]
                self.norm[rows] += np.abs(w, out=w) @ there[columns]

    def told(self) -> pa.RecordBatch:
        rows, columns = np.nonzero(self.asked & (self.n > 0))
        near = np.flatnonzero(self.near)
        films = pa.array(self.films[columns], pa.int64())
        n = np.concatenate([self.n[rows, columns], self.near[near]]).astype(np.int64)
        sums = (pa.array(np.concatenate([x[rows, columns], np.zeros(len(near))])) for x in (self.norm, self.moved))
        films = pa.concat_arrays([films, pa.nulls(len(near), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([self.targets.users[rows], self.targets.users[near]])), films, pa.array(n), *sums], names=["a", "film", "n", "norm", "moved"])


def neighbour_sums(split: DataFrame, history: DataFrame, least: int = 5, least_r: float = 0.15) -> DataFrame:
    """(a, film, n, norm, moved): for each test film of a target, how many usable neighbours rated it, the sum of their
    weights' sizes, and of weights times deviations from the neighbours' means; film null: how many neighbours a target has.

    Pairs are as in ``pair_sums``, and weights as in ``weights``. The pairs of a tile are used where they are made, so what
    is shuffled are sums, ``HISTORY_PARTS`` at most for each test film. Neighbours of equal histories are one that counts
    for all of them, and so are targets of equal ones, tests included."""
    right, known = collapsed(cells_of(history, "rating", F.lit(False)))
    left, targets = collapsed(cells_of(split, "rating", F.col("is_test")), known.withColumnRenamed("c", "same"))
    left, right, cold, any_hot = dealt(left, right)
    near = usable(cold_sums(cold_pairs(left.where("not m"), right, cold, ordered=False, selves=True), CORRELATED), least, least_r)
    near = near.join(left.select(F.col("u").alias("a"), F.col("same").alias("_of")).distinct(), "a").join(right.select(F.col("u").alias("b"), "copies", "same").distinct(), "b")
    near = near.select("a", "b", "w", (F.col("copies") - (F.col("same") == F.col("_of")).cast("long")).alias("k")).where("k > 0")
    near = cut(near) if any_hot else near
    mean = right.groupBy("u").agg(F.avg("v").alias("_mean"))
    said = right.join(mean, "u").select(F.col("u").alias("b"), "f", (F.col("v") - F.col("_mean")).alias("d"))
    asked = left.where("m").select(F.col("u").alias("a"), "f")
    found = asked.join(near, "a").join(said, ["b", "f"]).groupBy("a", F.col("f").alias("film"))
    found = found.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.abs("w")).alias("norm"), F.sum(F.col("k") * F.col("w") * F.col("d")).alias("moved"))
    found = found.unionByName(near.groupBy("a").agg(F.sum("k").alias("n")).select("a", F.lit(None).cast("long").alias("film"), "n", F.lit(0.0).alias("norm"), F.lit(0.0).alias("moved")))
    every = lambda sums: sums.join(targets.withColumnRenamed("c", "a"), "a").select(F.col("u").alias("a"), "film", "n", "norm", "moved")
    if not any_hot:
        return every(found)
    (l, n_left), (r, n_right) = blocks_of(left), blocks_of(right)  # noqa: E741
    one = packed(l, "i", max(-(-n_left // TARGET_BLOCKS), min(n_left, LEAST_PARTS)))
    tiles = one.crossJoin(packed(r, "j", min(n_right, HISTORY_PARTS)).hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's tiles follow each other; should they not, its sums come in more rows."""
        keep_memory()
        at, sums = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                if row["i"] != at:
                    if sums is not None:
                        yield sums.told()
                    at, sums = row["i"], Asked(Block(row, "i"))
                sums.add(Block(row, "j"), least, least_r)
        if sums is not None:
            yield sums.told()

    found = found.unionByName(tiles.mapInArrow(run, found.schema))
    return every(found.groupBy("a", "film").agg(*[F.sum(k).alias(k) for k in ("n", "norm", "moved")]))
