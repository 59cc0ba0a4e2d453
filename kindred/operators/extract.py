"""Typed rows from stored markup: feeds, film grids, people lists, reviews, histograms and film pages.

Every function takes pages (url, body) and returns one row for each record; missing parts are null, and markup that
can't be read gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.columns import SPACE, TAG, blank_to_null, decoded, glyph_rating, route_of, separated_int, slug_of, stripped, title_rating, without_spaces

_FEED = "channel struct<item: array<struct<title:string,link:string,guid:struct<_VALUE:string>,description:string,`letterboxd:memberRating`:string,`letterboxd:filmTitle`:string,`letterboxd:filmYear`:string,`letterboxd:watchedDate`:string,`letterboxd:rewatch`:string,`letterboxd:memberLike`:string,`tmdb:movieId`:string>>>"
_FIELDS = ["film_title", "film_year", "tmdb_id", "rating", "watched_date", "review_text"]


def first_match(body: Column | str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(body, pattern, 1), F.lit(""))


def diary(pages: DataFrame) -> DataFrame:
    """Feed items in feed order: a row for each watch or review; ``skipped`` marks the other items."""
    feed = F.from_xml("body", _FEED, {"mode": "PERMISSIVE"})
    item = F.col("item")
    tag = lambda name: blank_to_null(item[name])
    said = lambda name: F.coalesce(F.lower(F.trim(item[name])).isin("yes", "true"), F.lit(False))
    digits = lambda x, kind: F.when(x.rlike("^[0-9]+$"), x.try_cast(kind))
    rows = pages.select("url", feed.alias("feed")).select("url", F.posexplode("feed.channel.item").alias("pos", "item"))
    return rows.select(
        "url", "pos",
        (~F.coalesce(item["guid"]["_VALUE"].rlike("letterboxd-(watch|review)-[0-9]+"), F.lit(False))).alias("skipped"),
        tag("letterboxd:filmTitle").alias("film_title"),
        digits(tag("letterboxd:filmYear"), "int").alias("film_year"),
        digits(tag("tmdb:movieId"), "bigint").alias("tmdb_id"),
        F.coalesce(tag("letterboxd:memberRating").try_cast("double"), title_rating(item["title"])).alias("rating"),
        tag("letterboxd:watchedDate").alias("watched_date"),
        said("letterboxd:rewatch").alias("rewatch"),
        said("letterboxd:memberLike").alias("liked"),
        tag("link").alias("link"),
        slug_of(item["link"]).alias("slug"),
        tag("description").alias("review_text"),
    )


def field_coverage(entries: DataFrame, by: str, fields: list[str], flags: list[str] = ()) -> DataFrame:
    """Share of entries with each field, and with each flag set, to three places; fields that none has are absent."""
    parts = [F.struct(F.lit(c).alias("field"), F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0).alias("has")) for c in fields]
    parts += [F.struct(F.lit(f"{c}_true").alias("field"), F.when(F.col(c), 1.0).otherwise(0.0).alias("has")) for c in flags]
    long = entries.select(by, F.explode(F.array(*parts)).alias("x")).select(by, "x.field", "x.has")
    return long.groupBy(by, "field").agg(F.round(F.avg("has"), 3).alias("coverage")).where("coverage > 0")


# The marks by which the pages' markup names its parts.
GRID_ITEM = '(?s)<li class="(?:griditem|posteritem)"[^>]*>(.*?)</li>'
FILM_UID = r"film:(\d+)"
PERSON_ROW = '(?s)<td class="col-member table-person">(.*?)</tr>'
PERSON_NAME = rf'(?s)<a href="/([^/"]+)/" class="name">{SPACE}*(.*?){SPACE}*</a>'
PERSON_FOLLOWERS = rf"([0-9,]+){SPACE}*(?:&nbsp;|{SPACE})followers"
PERSON_FILMS = r'icon-watched" href="/[^/"]+/films/">([0-9,]+)</a>'
REVIEW_START = '<article class="production-viewing[^>]*>'
REVIEW_USER = r'<a href="/([^/"]+)/film/[^"]*"\s+class="context"'
REVIEW_NAME = '(?s)<strong class="displayname">(.*?)</strong>'
REVIEW_STARS = 'class="glyph -rating"[^>]*aria-label="([★½]+)"'
REVIEW_DATE = '<time class="timestamp" datetime="([^"]+)"'
REVIEW_FULL = 'data-full-text-url="([^"]+)"'
REVIEW_VIEWING = r'data-full-text-url="[^"]*?viewing:(\d+)'
REVIEW_COMMENTS = '(?s)#comments"[^>]*>.*?<span class="label">([0-9,]+)</span>'
REVIEW_BODY = '(?s)class="[^"]*js-review-body[^"]*"[^>]*>(.*?)<div class="viewing-actions"'
REVIEW_LIKES = '(?s)data-component-class="LikeComponent".*?data-count="([0-9,]+)"'
HISTOGRAM_BAR = rf'title="([0-9,]+)(?:&nbsp;|{SPACE})+([^"]*?)(?:&nbsp;|{SPACE})+ratings'
LIKED, SPOILER = ("inline-liked", "<title>Liked</title>"), ("js-spoiler-container", "may contain spoilers")
POSTER = r'"image"\s*:\s*"(https://a\.ltrbxd\.com/resized/[^"]+)"'
POSTER_SIZE, POSTER_WANTED = r"-\d+-\d+-\d+-\d+-crop\.jpg", "-0-125-0-187-crop.jpg"


def films(pages: DataFrame) -> DataFrame:
    """Films of a grid in page order, titles as the markup holds them; the rating is looked for behind the viewing data only."""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("body", F.lit(GRID_ITEM), F.lit(1))).alias("pos", "chunk"))
    name = first_match("chunk", 'data-item-name="([^"]*)"')
    at = F.locate("poster-viewingdata", F.col("chunk"))
    stars = F.when(at > 0, first_match(F.expr("substring(chunk, locate('poster-viewingdata', chunk))"), r"\brated-(\d{1,2})\b"))
    return rows.select(
        "url", "pos", first_match("chunk", 'data-item-slug="([^"]+)"').alias("slug"),
        F.regexp_replace(name, r"\s*\(\d{4}\)\s*$", "").alias("title"),
        F.regexp_extract(name, r"\((\d{4})\)\s*$", 1).try_cast("int").alias("year"),
        first_match("chunk", FILM_UID).try_cast("bigint").alias("film_id"),
        (stars.try_cast("double") / 2).alias("rating"),
    ).where("slug is not null")


def people(pages: DataFrame) -> DataFrame:
    """Members of a follow list, with their counts; rows without a name link are left out."""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("body", F.lit(PERSON_ROW), F.lit(1))).alias("pos", "chunk"))
    return rows.select(
        "url", "pos", first_match("chunk", PERSON_NAME).alias("username"),
        F.nullif(stripped(F.regexp_extract("chunk", PERSON_NAME, 2)), F.lit("")).alias("display_name"),
        separated_int(first_match("chunk", PERSON_FILMS)).alias("n_films"), separated_int(first_match("chunk", PERSON_FOLLOWERS)).alias("n_followers"),
    ).where("username is not null")


def reviews(pages: DataFrame) -> DataFrame:
    """Reviews of a page in page order, those with an author; text that ends in an ellipsis is marked as truncated."""
    parts = F.split("body", REVIEW_START)
    rows = pages.select("url", F.posexplode(F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts) - 1))).alias("pos", "chunk"))
    # each step has a column of its own, so that it is computed once however often the next one names it
    rows = rows.withColumn("_body", F.regexp_replace(F.get(F.regexp_extract_all("chunk", F.lit(REVIEW_BODY), F.lit(1)), F.lit(0)), TAG, " "))
    rows = rows.withColumn("_text", without_spaces(decoded(F.col("_body"))))
    text = F.col("_text")
    holds = lambda marks: F.contains("chunk", F.lit(marks[0])) | F.contains("chunk", F.lit(marks[1]))
    return rows.select(
        "url", "pos", first_match("chunk", REVIEW_USER).alias("username"),
        F.nullif(stripped(first_match("chunk", REVIEW_NAME)), F.lit("")).alias("display_name"),
        glyph_rating(F.regexp_extract("chunk", REVIEW_STARS, 1)).alias("rating"),
        holds(LIKED).alias("liked"), holds(SPOILER).alias("spoiler"),
        first_match("chunk", REVIEW_DATE).alias("date"), text.alias("text"), F.coalesce(F.endswith(text, F.lit("…")), F.lit(False)).alias("truncated"),
        first_match("chunk", REVIEW_FULL).alias("full_text_url"),
        first_match("chunk", REVIEW_VIEWING).try_cast("bigint").alias("viewing_id"),
        separated_int(first_match("chunk", REVIEW_COMMENTS)).alias("n_comments"),
        separated_int(first_match("chunk", REVIEW_LIKES)).alias("n_likes"),
    ).where("username is not null")


def backfilled(rows: DataFrame, full: DataFrame, key: str, text: str = "text", truncated: str = "truncated") -> DataFrame:
    """Truncated texts replaced by those of ``full`` (key, text), where it has one."""
    other = full.select(key, F.col(text).alias("_full"))
    return rows.join(other, key, "left").withColumn(text, F.when(F.col(truncated), F.coalesce("_full", text)).otherwise(F.col(text))).drop("_full")


def histogram(pages: DataFrame) -> DataFrame:
    """(url, stars, n) of rating histograms; a level that occurs twice counts as its last."""
    levels, glyphs = (F.regexp_extract_all("body", F.lit(HISTOGRAM_BAR), F.lit(k)) for k in (1, 2))
    rows = pages.select("url", F.posexplode(F.arrays_zip(levels.alias("n"), glyphs.alias("g"))).alias("pos", "x"))
    stars = F.when(F.col("x.g") == "half-★", 0.5).otherwise(glyph_rating(F.col("x.g")))
    rows = rows.select("url", "pos", stars.alias("stars"), separated_int(F.col("x.n")).alias("n")).where("stars > 0")
    return rows.groupBy("url", "stars").agg(F.max_by("n", "pos").alias("n"))


def film_ids(pages: DataFrame) -> DataFrame:
    link = F.regexp_replace(first_match("body", POSTER), r"\\/", "/")
    rest = F.expr("substring(link, at)")
    poster = F.when(F.col("at") > 0, F.concat(F.expr("substring(link, 1, at - 1)"), F.lit(POSTER_WANTED), F.substr(rest, F.length(F.regexp_extract(rest, POSTER_SIZE, 0)) + 1))).otherwise(F.col("link"))
    return pages.select("url", "body", link.alias("link")).withColumn("at", F.regexp_instr("link", F.lit(POSTER_SIZE))).select(
        "url", first_match("body", r'data-tmdb-id="(\d+)"').try_cast("bigint").alias("tmdb_id"), first_match("body", 'data-tmdb-type="([^"]*)"').alias("tmdb_type"),
        first_match("body", r"imdb\.com/title/(tt\d+)").alias("imdb_id"), poster.alias("poster"),
    )


def members(pages: DataFrame) -> DataFrame:
    """(url, username): distinct names on a members page."""
    names = F.array_distinct(F.regexp_extract_all("body", F.lit('href="/([a-z0-9_]+)/" class="name"'), F.lit(1)))
    return pages.select("url", F.explode(names).alias("username"))


def record_counts(pages: DataFrame) -> DataFrame:
    """(kind, pages, records) of stored pages (url, status, body): each is parsed by the route of its address. Film pages
    count if they name an id; pages of other kinds, failed ones and those without records count as pages alone."""
    pages = pages.withColumn("kind", route_of(F.col("url"), F.col("status")))
    parsers = {"rss": lambda p: diary(p).where("not skipped"), "reviews": reviews, "people": people, "films": films, "film_ids": lambda p: film_ids(p).where("tmdb_id is not null")}
    found = [parse(pages.where(F.col("kind") == kind)).groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("records")) for kind, parse in parsers.items()]
    records = reduce(DataFrame.unionByName, found)
    return pages.groupBy("kind").agg(F.count("*").alias("pages")).join(records, "kind", "left").select("kind", "pages", F.coalesce("records", F.lit(0)).alias("records"))
