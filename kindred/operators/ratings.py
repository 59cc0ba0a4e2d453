"""Ratings: merged histories, profiles, histograms, budgets, candidates and splits.

Ratings and likes are two channels that are never pooled: ``rating`` is null for what was only seen, ``liked`` is a flag
of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import pages_for, share, six

FEED_LENGTH = 20
PER_PAGE, FILMS_PER_PAGE = 25, 72
#: Running sums over films are taken in blocks of so many film ids.
FILMS_PER_BLOCK = 1_000
#: Rows are placed in a global order by way of so many slices of it, at most.
SLICES = 1 << 16
MIN_SD, MAX_MODAL, MIN_RATED = 0.5, 0.5, 30


def feed(events: DataFrame) -> DataFrame:
    """(user_id, film, ts, event_id, rating, liked, pos): what users did, newest first; failed events are unrated."""
    stars = F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.col("value") / 8))) / F.lit(2.0)
    rows = events.select("user_id", F.get_json_object("props", "$.k").try_cast("int").alias("film"), "ts", "event_id", F.when(F.col("event_type") != "error", stars).cast("double").alias("rating"), (F.col("event_type") == "purchase").alias("liked"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))


def merged(entries: DataFrame, feed_length: int = FEED_LENGTH) -> DataFrame:
    """One rating for each user and film: the oldest of the recent feed, else the newest of the grid."""
    recent = F.col("pos") <= feed_length
    order = Window.partitionBy("user_id", "film").orderBy(F.when(recent, 0).otherwise(1), F.when(recent, -F.col("pos")).otherwise(F.col("pos")))
    rows = entries.where("rating is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.select("user_id", "film", "rating", "ts", F.when(recent, "feed").otherwise("grid").alias("source"))


def profile(entries: DataFrame) -> DataFrame:
    """Whether each user's ratings carry information: counts, mean, spread, modal share, entropy, and why not."""
    sums = entries.groupBy("user_id").agg(F.count("*").alias("n_total"), F.count("rating").alias("n_rated"), F.avg("rating").alias("m"), F.stddev_pop("rating").alias("s"), F.bool_or(F.col("rating") % 1 != 0).alias("halves"))
    levels = entries.where("rating is not null").groupBy("user_id", "rating").agg(F.count("*").alias("c"))
    levels = levels.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("user_id")))
    levels = levels.groupBy("user_id").agg(F.max("p").alias("top"), (-F.sum(F.col("p") * F.ln("p")) / math.log(10)).alias("e"))
    reasons = F.array_join(F.array_compact(F.array(
        F.when(F.col("s") < MIN_SD, "sd too low"), F.when(F.col("top") > MAX_MODAL, "single value"), F.when(F.col("n_rated") < MIN_RATED, "few ratings"),
    )), "; ")
    reason = F.when(F.col("n_rated") == 0, "no ratings at all").when(reasons == "", "ok").otherwise(reasons)
    third = lambda c: F.round(F.col(c), 3)
    return sums.join(levels, "user_id", "left").select(
        "user_id", "n_total", "n_rated", F.round(share(F.col("n_rated"), F.col("n_total")), 3).alias("rate_fraction"), third("m").alias("mean"), third("s").alias("sd"),
        third("top").alias("modal_share"), third("e").alias("entropy_norm"), F.coalesce("halves", F.lit(False)).alias("uses_half_stars"), (reason == "ok").alias("usable"), reason.alias("reason"),
    )


def film_histogram(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("film", F.col("rating").alias("stars")).agg(F.count("*").alias("n"))


def catalogue(hist: DataFrame) -> DataFrame:
    """Totals and the pages that listing a film's raters costs."""
    high = F.coalesce(F.sum(F.when(F.col("stars") >= 4, F.col("n"))), F.lit(0))
    return hist.groupBy("film").agg(F.sum("n").alias("lb_total"), high.alias("raters_ge4")).withColumns({"pages_ge4": pages_for(F.col("raters_ge4"), PER_PAGE), "pages_all": pages_for(F.col("lb_total"), PER_PAGE)})


def crowd(hist: DataFrame) -> DataFrame:
    return hist.groupBy("film").agg(F.try_divide(F.sum(F.col("stars") * F.col("n")), F.sum("n").cast("double")).alias("lb_avg"))


def with_idf(films: DataFrame, total: str = "lb_total") -> DataFrame:
    """idf over the films given: the finder passes its seeds, the picker the whole catalogue."""
    whole = films.agg(F.sum(total).alias("_whole"))
    return films.crossJoin(F.broadcast(whole)).withColumn("idf", F.ln(F.col("_whole") / F.greatest(F.col(total), F.lit(1)))).drop("_whole")


def seed_costs(hist: DataFrame, mode: str = "taste", least: float = 4.0) -> DataFrame:
    """(film, total, pool, pages) of listing a film's raters. ``taste`` lists every level from ``least`` on, each in pages of
    its own; ``territory`` lists all who saw the film; ``both`` lists both, and its pool is the larger one."""
    high = F.col("stars") >= least
    rows = hist.groupBy("film").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(high, F.col("n"))), F.lit(0)).alias("_pool"), F.coalesce(F.sum(F.when(high, pages_for(F.col("n"), PER_PAGE))), F.lit(0)).alias("_pages"))
    whole = pages_for(F.col("total"), PER_PAGE)
    pool, cost = {"taste": (F.col("_pool"), F.col("_pages")), "territory": (F.col("total"), whole), "both": (F.greatest("_pool", "total"), F.col("_pages") + whole)}[mode]
    return rows.select("film", "total", pool.alias("pool"), cost.alias("pages"))


def eligible(films: DataFrame, max_pages: int, min_pool: int, mode: str = "taste", pages: str = "pages_ge4", pool: str = "raters_ge4") -> DataFrame:
    """Adds eligible: films that aren't too large to list, and (but for territories) have enough raters to meet in."""
    return films.withColumn("eligible", (F.col(pages) <= max_pages) & (F.lit(mode == "territory") | (F.col(pool) >= min_pool)))


def chosen(films: DataFrame, budget: int | None = None, percent: int = 20, pages: str = "pages_ge4") -> DataFrame:
    """Whole films while their pages fit the budget (in pages; without one, that percentage of the eligible films'
    pages, so that the choice keeps up with the raters), cheapest first. Costs ascend, so the first that doesn't fit ends
    the choice. Running sums are taken within blocks of equal cost, and over the blocks' sums before them."""
    films = films.withColumn("_block", F.floor(F.col("film") / FILMS_PER_BLOCK))
    block = ["eligible", pages, "_block"]
    blocks = films.groupBy(*block).agg(F.sum(pages).alias("_pages"))
    ahead = Window.partitionBy("eligible").orderBy(pages, "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_before": F.coalesce(F.sum("_pages").over(ahead), F.lit(0)), "_total": F.sum("_pages").over(Window.partitionBy("eligible"))})
    inside = F.sum(pages).over(Window.partitionBy(*block).orderBy("film").rowsBetween(Window.unboundedPreceding, 0))
    films = films.join(blocks.drop("_pages"), block).withColumn("running", F.col("_before") + inside)
    fits = F.col("running") <= budget if budget is not None else 100 * F.col("running") <= percent * F.col("_total")
    return films.withColumn("chosen", F.col("eligible") & fits).drop("_block", "_before", "_total")


def reasons(films: DataFrame, max_pages: int, min_pool: int) -> Column:
    return F.when(F.col("chosen"), "yes").when(F.col("pages_ge4") > max_pages, "too big").when(F.col("raters_ge4") < min_pool, f"pool<{min_pool}").otherwise("budget")


def band(raters: Column, small: int, big: int) -> Column:
    return F.when(raters < small, "small").when(raters > big, "big").otherwise("sweet")


def seed_edges(entries: DataFrame, ratings: DataFrame, seeds: DataFrame, least: float = 4.0) -> DataFrame:
    """(user_id, film, kind, idf): who rated a seed high, and who liked one."""
    rated = ratings.where(F.col("rating") >= least).select("user_id", "film", F.lit("rated").alias("kind"))
    liked = entries.where("liked").select("user_id", "film", F.lit("liked").alias("kind"))
    return rated.unionByName(liked).distinct().join(seeds.select("film", "idf"), "film")


def candidates(edges: DataFrame) -> DataFrame:
    """Users by rarity-weighted co-occurrence over distinct seeds."""
    one = edges.groupBy("user_id", "film").agg(F.first("idf").alias("idf"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    grouped = one.groupBy("user_id").agg(six(F.sum("idf")).alias("score"), F.count("*").alias("n_seeds"), F.array_join(F.sort_array(F.collect_list("film")).cast("array<string>"), ",").alias("seeds"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))), ",").alias("via"))
    return grouped


def agreement_on_seeds(ratings: DataFrame, mine: DataFrame, least_shared: int = 2) -> DataFrame:
    """How close users' ratings of seeds are to ``mine`` (film, my_rating)."""
    gap = F.col("rating") - F.col("my_rating")
    rows = ratings.join(mine, "film").groupBy("user_id").agg(
        F.count("*").alias("n_shared"), F.round(F.avg(gap), 3).alias("mean_gap"),
        F.round(F.avg((F.abs(gap) <= 0.5).cast("double")), 3).alias("agree_rate"), F.round(F.avg("rating"), 3).alias("their_mean"))
    return rows.where(F.col("n_shared") >= least_shared)


def bumped(ratings: DataFrame, likes: DataFrame, bump: float = 3.5, to: float = 4.0) -> DataFrame:
    """Liked films that were rated from ``bump`` to below ``to`` count as ``to``."""
    flags = likes.select("user_id", "film").distinct().withColumn("_liked", F.lit(True))
    up = F.col("_liked") & (F.col("rating") >= bump) & (F.col("rating") < to)
    return ratings.join(flags, ["user_id", "film"], "left").withColumn("rating", F.when(up, to).otherwise(F.col("rating"))).drop("_liked")


def recent_split(ratings: DataFrame, entries: DataFrame, seeds: DataFrame | None = None, feed_length: int = FEED_LENGTH) -> DataFrame:
    """Adds is_test: films in the recent feed are test, the rest train; seeds are in neither."""
    recent = entries.where(F.col("pos") <= feed_length).select("user_id", "film").distinct().withColumn("_recent", F.lit(True))
    rows = ratings.join(seeds.select("film"), "film", "left_anti") if seeds is not None else ratings
    return rows.join(recent, ["user_id", "film"], "left").withColumn("is_test", F.coalesce("_recent", F.lit(False))).drop("_recent")


def eligible_targets(split: DataFrame, least_test: int, least_train: int) -> DataFrame:
    rows = split.groupBy("user_id").agg(F.count_if(F.col("is_test")).alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))
    return rows.where((F.col("n_test") >= least_test) & (F.col("n_train") >= least_train))


def draw(*columns: str, seed: int) -> Column:
    """A portable random order: md5 of the columns and a seed."""
    return F.md5(F.concat_ws(":", *columns, F.lit(str(seed))).cast("binary"))


def placed(rows: DataFrame, slice_of: Column, *order: Column | str) -> DataFrame:
    """Adds place, from 1, in the order of ``slice_of`` and then ``order``, and n, the number of rows. Slices (``SLICES``
    at most) are counted first, so each is sorted by itself and no task sees all rows."""
    rows = rows.withColumn("_slice", slice_of)
    counts = rows.groupBy("_slice").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy())})
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return rows.join(F.broadcast(counts.drop("_n")), "_slice").withColumn("place", F.col("_before") + inside).drop("_slice", "_before")


def drawn(rows: DataFrame, seed: int) -> DataFrame:
    """``placed`` in the random order of ``draw`` over users and films; slices are its first four digits."""
    order = draw("user_id", "film", seed=seed)
    return placed(rows, F.conv(F.substr(order, F.lit(1), F.lit(4)), 16, 10).cast("long"), order, "user_id", "film")


def random_split(ratings: DataFrame, cuts: dict[str, float], seed: int) -> DataFrame:
    """Parts of exact size: the name of the first cut whose share of all rows, rounded down, reaches the row's place."""
    part = None
    for name, share_below in cuts.items():
        fits = F.col("place") <= F.floor(F.lit(share_below) * F.col("n"))
        part = F.when(fits, name) if part is None else part.when(fits, name)
    return drawn(ratings, seed).withColumn("part", part).drop("place", "n")


def temporal_split(ratings: DataFrame, train: float = 0.9) -> DataFrame:
    """Global cut by time: the first ``train`` of all ratings, rounded down, are train; ties by user and film."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = ratings.agg(F.min(micros).alias("_low"), ((F.max(micros) - F.min(micros)) / (SLICES - 1) + 1).alias("_width"))
    rows = ratings.crossJoin(F.broadcast(span))
    rows = placed(rows, F.coalesce(F.floor((micros - F.col("_low")) / F.col("_width")), F.lit(-1)), "ts", "user_id", "film")
    return rows.withColumn("is_test", F.col("place") > F.floor(F.lit(train) * F.col("n"))).drop("_low", "_width", "place", "n")


def last_out(ratings: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "film")
    return ratings.withColumn("is_test", F.row_number().over(order) == 1)


def random_out(ratings: DataFrame, seed: int) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(draw("user_id", "film", seed=seed), "film")
    return ratings.withColumn("is_test", F.row_number().over(order) == 1)


def holdout(ratings: DataFrame, size: int, least: int, seed: int) -> DataFrame:
    """``size`` ratings of each user with ``least`` or more; the others are train alone."""
    order = Window.partitionBy("user_id").orderBy(draw("user_id", "film", seed=seed), "film")
    n = F.count("*").over(Window.partitionBy("user_id"))
    return ratings.withColumn("is_test", (F.row_number().over(order) <= size) & (n >= least))


def sampled(rows: DataFrame, size: int, key: str, seed: int) -> DataFrame:
    return rows.orderBy(draw(key, seed=seed), key).limit(size)


def frame_pool(ratings: DataFrame, films: DataFrame, frame: int = 20, least: float = 4.0) -> DataFrame:
    """(user_id): who rated one of the ``frame`` most rated films high, each once."""
    popular = films.orderBy(F.desc("lb_total"), "film").limit(frame).select("film")
    return ratings.where(F.col("rating") >= least).join(popular, "film", "left_semi").select("user_id").distinct()


#: Candidates of a screening whose requests and targets are summed up together.
SCREENED_PER_BLOCK = 10_000


def prescreened(pool: DataFrame, want: int, least_friends: int = 5, least_recent: int = 8, least_rated: int = 50) -> DataFrame:
    """The candidates that a screening in order of ``place`` (1, 2, ..) looks at until it has ``want`` targets, each with
    ``requests`` (1 to 3), ``eligible``, and both summed up to there (``spent``, ``found``).

    ``pool`` has what three requests would tell: (friends_ok, n_friends), (recent_ok, n_recent) and (rated_ok, n_rated).
    The cheapest and most selective check comes first, and a failed one (not ok, too few, or null) saves the others. Sums
    go over blocks of places first and within each block then, so no task goes through the whole order.
    """
    enough = lambda ok, n, least: F.coalesce(F.col(ok) & (F.col(n) >= least), F.lit(False))
    first, second, third = enough("friends_ok", "n_friends", least_friends), enough("recent_ok", "n_recent", least_recent), enough("rated_ok", "n_rated", min(least_rated, 50))
    rows = pool.withColumns({"requests": 1 + first.cast("long") + (first & second).cast("long"), "eligible": first & second & third, "_block": F.floor((F.col("place") - 1) / SCREENED_PER_BLOCK)})
    found = F.col("eligible").cast("long")
    blocks = rows.groupBy("_block").agg(F.sum("requests").alias("_r"), F.sum(found).alias("_f"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"{k}0") for k in ("_r", "_f")])
    inside = Window.partitionBy("_block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks.where(F.col("_f0") < want), "_block")
    rows = rows.withColumns({"spent": F.col("_r0") + F.sum("requests").over(inside), "found": F.col("_f0") + F.sum(found).over(inside)})
    return rows.where(F.col("found") - found < want).drop("_block", "_r0", "_f0")
