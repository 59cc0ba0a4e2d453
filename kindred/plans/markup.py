"""Pages rendered from the tables in the marks that real pages have, for the queries on markup: what is parsed back must be
what the tables hold, which SQL computes from the tables themselves. Names of members and films are made of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import columns as C

SITE = "https://s.example"
PER_GRID, PER_REVIEWS = 72, 12


def fill(template: str, **parts: Column) -> Column:
    """``template`` with its {names} replaced by columns; null if one of them is."""
    pieces = [x for text, name, *_ in C.Formatter().parse(template) for x in (F.lit(text), parts[name].cast("string") if name else None) if x is not None]
    return F.concat(*pieces)


def glyphs(stars: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), F.floor(stars).cast("int")), F.when(stars % 1 != 0, "½").otherwise(""))


def escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def grouped(n: Column) -> Column:
    """An integer with thousands separators."""
    return F.format_number(n, 0)


def bodies(items: DataFrame, url: Column, order: str, head: str = "", tail: str = "") -> DataFrame:
    """(url, body): the column ``item`` of all rows of an address in order. Pages hold a bounded number of items."""
    rows = items.groupBy(url.alias("url")).agg(F.sort_array(F.collect_list(F.struct(order, "item"))).alias("_items"))
    return rows.select("url", F.concat(F.lit(head), F.array_join("_items.item", "\n"), F.lit(tail)).alias("body"))


_ENTRY = """<item><title>Film {film}, {year} - {glyphs}</title><link>{site}/{user}/film/film-{film}/</link><guid isPermaLink="false">letterboxd-{kind}-{event}</guid><letterboxd:watchedDate>{day}</letterboxd:watchedDate>
<letterboxd:rewatch>{rewatch}</letterboxd:rewatch><letterboxd:filmTitle>Film {film}</letterboxd:filmTitle><letterboxd:filmYear>{year}</letterboxd:filmYear>{rating}<letterboxd:memberLike>{liked}</letterboxd:memberLike>
<tmdb:movieId>{tmdb}</tmdb:movieId><description>&lt;p&gt;Seen &amp;amp; noted {event}&lt;/p&gt;</description></item>"""
_LIST = '<item><title>A list</title><link>{site}/{user}/list/l/</link><guid isPermaLink="false">letterboxd-list-{event}</guid></item>'


def feeds(entries: DataFrame, length: int) -> DataFrame:
    """Every member's recent feed. Every 13th event is a list; ratings stand in an element of their own, or in the title
    only; every third film's number is no number."""
    c = F.col
    year = F.when(c("film") % 4 == 0, F.concat(F.lit("19x"), c("film"))).otherwise((1950 + c("film") % 70).cast("string"))
    rating = F.when(c("rating").isNull(), "").when(c("event_id") % 3 == 0, fill("<letterboxd:memberRating>{r}</letterboxd:memberRating>", r=c("rating"))).otherwise("<letterboxd:memberRating>none</letterboxd:memberRating>")
    parts = {
        "film": c("film"), "year": year, "glyphs": F.coalesce(glyphs(c("rating")), F.lit("")), "site": F.lit(SITE), "user": c("user_id"), "event": c("event_id"), "kind": F.when(c("event_id") % 2 == 0, "watch").otherwise("review"),
        "day": F.date_format("ts", "yyyy-MM-dd"), "rewatch": F.when(c("event_id") % 5 == 0, "Yes").otherwise("No"), "rating": rating, "liked": F.when(c("liked"), "true").otherwise("No"), "tmdb": F.when(c("film") % 3 == 0, "n/a").otherwise((c("film") * 10 + 7).cast("string")),
    }
    item = F.when(c("event_id") % 13 == 5, fill(_LIST, **parts)).otherwise(fill(_ENTRY, **parts))
    rows = entries.where(c("pos") <= length).withColumn("item", item)
    return bodies(rows, C.address("feed", SITE, user=c("user_id")), "pos", '<rss xmlns:letterboxd="x" xmlns:tmdb="y"><channel><title>t</title>', "</channel></rss>")


_POSTER_ITEM = """<li class="{kind}"><div data-item-slug="film-{film}" data-item-name="{name}" data-postered-identifier='{{"uid":"film:{film}"}}'></div><span class="rated-2"></span>
<p class="poster-viewingdata" data-item-uid="film:{film}">{rating}</p></li>"""


def grids(ratings: DataFrame) -> DataFrame:
    """Every member's films in pages of 72; every seventh film is shown without its rating, every fifth without a year."""
    c = F.col
    rating = F.when(c("film") % 7 == 0, "").otherwise(fill('<span class="rating -micro -darker rated-{n}">x</span>', n=(c("rating") * 2).cast("int")))
    name = F.concat(fill("Film &amp; {film}", film=c("film")), F.when(c("film") % 5 == 0, "").otherwise(fill(" ({year})", year=1950 + c("film") % 70)))
    rows = ratings.withColumn("_at", F.row_number().over(Window.partitionBy("user_id").orderBy("film")) - 1).withColumn("_page", F.floor(c("_at") / PER_GRID) + 1)
    rows = rows.withColumn("item", fill(_POSTER_ITEM, kind=F.when(c("film") % 2 == 0, "griditem").otherwise("posteritem"), film=c("film"), name=name, rating=rating))
    return bodies(rows, C.address("films", SITE, user=c("user_id"), page=c("_page")), "_at", '<ul><li class="griditem"><div data-item-name="No slug (2000)"></div></li>', "</ul>")


_PERSON = """<tr><td class="col-member table-person"><a href="/u{dst}/" class="name"> User &amp; {dst} </a> <a>{followers}{space}followers</a></td>
<td><a class="icon-watched" href="/u{dst}/films/">{films}</a></td></tr>"""


def follow_lists(follows: DataFrame) -> DataFrame:
    """Every member's follow list; counts are set off by no-break spaces, as a character or by name."""
    space = F.when(F.col("dst") % 2 == 0, " ").otherwise("&nbsp;")
    rows = follows.withColumn("item", fill(_PERSON, dst=F.col("dst"), followers=grouped(F.col("dst") * 977), films=grouped(F.col("n_films") * 100), space=space))
    return bodies(rows, C.address("following", SITE, user=F.col("src"), page=F.lit(1)), "place", "<table>", '<tr><td class="col-member table-person"><a href="/no/">nobody</a></td></tr></table>')


_REVIEW = """<article class="production-viewing -viewing"><a href="/u{doc}/film/alpha/" class="context"></a><strong class="displayname">User <b>{doc}</b></strong>{stars}
<time class="timestamp" datetime="2024-02-{day}"></time>{liked}<a href="/x/#comments"><span class="label">{comments}</span></a><p data-count="7"></p>
<div class="{hidden}"><div class="body-text js-review-body" data-full-text-url="/s/full-text/viewing:{doc}/"><p>{text}</p></div><div class="viewing-actions"></div></div><p data-component-class="LikeComponent" data-count="{likes}"></p></article>"""


def review_pages(docs: DataFrame) -> DataFrame:
    """Every document as a review with its whole text, twelve on a page by id."""
    c = F.col("doc_id")
    parts = {
        "doc": c, "stars": F.when(c % 11 == 0, "").otherwise(fill('<svg class="glyph -rating" viewBox="0 0" aria-label="{g}"></svg>', g=glyphs((c % 10 + 1) / 2))), "day": F.lpad((c % 28 + 1).cast("string"), 2, "0"),
        "liked": F.when(c % 4 == 0, '<i class="inline-liked"></i>').otherwise(""), "comments": grouped(c * 3), "hidden": F.when(c % 9 == 0, "js-spoiler-container").otherwise("shown"), "text": escaped(F.coalesce("text", F.lit(""))), "likes": grouped(c * 7),
    }
    rows = docs.withColumn("item", fill(_REVIEW, **parts))
    page = F.floor(c / PER_REVIEWS) + 1
    return bodies(rows, C.paged(F.lit(f"{SITE}/film/alpha/reviews/by/activity/"), page), "doc_id", "<section>", '<article class="production-viewing"><p>by nobody</p></article></section>')


def histogram_pages(hist: DataFrame) -> DataFrame:
    """Every film's histogram, counts a thousandfold; each level stands twice, and the second counts."""
    bar = '<a title="{first} {level} ratings"></a><a title="{n} {level}&nbsp;ratings (1%)"></a>'
    level = F.when(F.col("stars") == 0.5, "half-★").otherwise(glyphs(F.col("stars")))
    rows = hist.withColumn("item", fill(bar, first=F.col("n"), n=grouped(F.col("n") * 1003), level=level))
    return bodies(rows, C.address("histogram", SITE, film=F.col("film")), "stars", "<p>12 ★★ ratings in prose</p>")


_FILM = """<body data-tmdb-type="{kind}" data-tmdb-id="{tmdb}"><a href="http://www.imdb.com/title/tt{imdb}/maindetails"></a><script>
{{"image":"https://a.example/other.jpg"}} {{"image" : "https://a.ltrbxd.com/resized/film-poster\\/{film}-alpha-0-1000-0-1500-crop.jpg"}}</script></body>"""


def film_pages(films: DataFrame) -> DataFrame:
    c = F.col("film")
    body = fill(_FILM, kind=F.when(c % 6 == 0, "tv").otherwise("movie"), tmdb=F.when(c % 8 == 0, "").otherwise((c * 3 + 1).cast("string")), imdb=F.lpad(c.cast("string"), 7, "0"), film=c)
    return films.select(C.address("film", SITE, film=c).alias("url"), body.alias("body"))
