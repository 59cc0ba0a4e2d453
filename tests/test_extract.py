"""Markup fixtures: every case is made up, with invented names."""

import gzip
import json

from pyspark.sql import functions as F

from kindred.functions import columns as C
from kindred.operators import extract
from kindred.sources import artifacts, pages

FEED = """<?xml version='1.0'?><rss xmlns:letterboxd="x" xmlns:tmdb="y"><channel><title>t</title>
<item><title>Alpha, 1999 - ★★★½</title><link>https://s.example/ann/film/alpha/</link><guid isPermaLink="false">letterboxd-watch-1</guid><letterboxd:watchedDate>2024-01-02</letterboxd:watchedDate><letterboxd:rewatch>No</letterboxd:rewatch><letterboxd:filmTitle>Alpha</letterboxd:filmTitle><letterboxd:filmYear>1999</letterboxd:filmYear><letterboxd:memberRating>4.5</letterboxd:memberRating><letterboxd:memberLike>Yes</letterboxd:memberLike><tmdb:movieId>77</tmdb:movieId><description>&lt;p&gt;Good &amp;amp; long&lt;/p&gt;</description></item>
<item><title>Beta, 2001 - ★★★½</title><link>https://s.example/ann/film/beta/</link><guid isPermaLink="false">letterboxd-review-2</guid><letterboxd:rewatch>true</letterboxd:rewatch><letterboxd:filmTitle>Beta</letterboxd:filmTitle><letterboxd:filmYear>20x1</letterboxd:filmYear><letterboxd:memberRating>bad</letterboxd:memberRating></item>
<item><title>A list</title><link>https://s.example/ann/list/l/</link><guid isPermaLink="false">letterboxd-list-3</guid></item>
</channel></rss>"""

GRID = """<ul><li class="griditem"><div data-item-slug="alpha" data-item-name="Alpha (1999)" data-postered-identifier='{"uid":"film:11"}'></div><span class="rated-2"></span><p class="poster-viewingdata" data-item-uid="film:11"><span class="rating -micro -darker rated-9">x</span></p></li>
<li class="posteritem"><div data-item-slug="beta" data-item-name="Be &amp; ta"></div><p class="poster-viewingdata" data-item-uid="film:12"></p></li>
<li class="griditem"><div data-item-name="No slug (2000)"></div></li><li class="posteritem"><div data-item-slug="gamma" data-item-name="Gamma (2010)"></div><i class="rated-4"></i></li></ul>"""

PEOPLE = """<table><tr><td class="col-member table-person"><div class="person-summary"><a href="/ann/" class="name"> Ann &amp; Co </a> <a>1,234&nbsp;followers</a></div></td><td><a class="icon-watched" href="/ann/films/">42</a></td></tr>
<tr><td class="col-member table-person"><a href="/bob_2/" class="name">Bob</a></td></tr><tr><td class="col-member table-person"><a href="/no/">nobody</a></td></tr></table>"""

REVIEWS = """<section><article class="production-viewing -viewing"><a href="/ann/film/alpha/" class="context">Review by</a><strong class="displayname">Ann</strong><svg class="glyph -rating" viewBox="0 0" aria-label="★★★½"></svg><time class="timestamp" datetime="2024-02-03"></time><span class="inline-liked"></span><a href="/ann/film/alpha/#comments"><i></i><span class="label">1,002</span></a><p data-count="7"></p><div class="body-text -prose js-review-body" data-full-text-url="/s/full-text/viewing:5/"><p>Fine &lt;3 &amp;amp; more…</p></div><div class="viewing-actions"></div><p data-component-class="LikeComponent" data-count="31"></p></article>
<article class="production-viewing -viewing"><a href="/bob/film/alpha/1/" class="context"></a><div class="js-spoiler-container"><div class="js-review-body" data-full-text-url="/s/full-text/viewing:6/"><p>Plain</p></div><div class="viewing-actions"></div></div></article><article class="production-viewing -viewing"><p>by nobody</p></article></section>"""

HISTOGRAM = """<li><a title="1,003&nbsp;half-★ ratings (1%)"></a></li><li><a title="20 ★★★½ ratings"></a></li><li><a title="7 ★★★½ ratings"></a></li><li><a title="9 ★ ratings"></a></li>"""

FILM = """<body data-tmdb-type="movie" data-tmdb-id="603"><a href="http://www.imdb.com/title/tt0133093/maindetails"></a><script>{"image":"https://a.example/other.jpg"}{"image" : "https://a.ltrbxd.com/resized/film-poster\\/1-alpha-0-1000-0-1500-crop.jpg?v=1-2-3-4-crop.jpg"}</script></body>"""


def page(spark, body, url="https://s.example/x/"):
    return spark.createDataFrame([(url, body)], "url string, body string")


def test_diary(spark):
    rows = extract.diary(page(spark, FEED)).orderBy("pos").collect()
    assert [r["skipped"] for r in rows] == [False, False, True]
    a, b, _ = rows
    assert (a["film_title"], a["film_year"], a["tmdb_id"], a["rating"], a["rewatch"], a["liked"], a["slug"]) == ("Alpha", 1999, 77, 4.5, False, True, "alpha")
    assert (b["film_year"], b["rating"], b["rewatch"], b["liked"], b["watched_date"]) == (None, 3.5, True, False, None)
    assert a["review_text"] == "<p>Good &amp; long</p>"
    assert extract.diary(page(spark, "<rss><channel><item>")).count() == 0


def test_films(spark):
    rows = {r["slug"]: r for r in extract.films(page(spark, GRID)).collect()}
    assert set(rows) == {"alpha", "beta", "gamma"}
    assert (rows["alpha"]["title"], rows["alpha"]["year"], rows["alpha"]["rating"], rows["alpha"]["film_id"]) == ("Alpha", 1999, 4.5, 11)
    assert (rows["beta"]["title"], rows["beta"]["year"], rows["beta"]["rating"]) == ("Be &amp; ta", None, None)
    assert rows["gamma"]["rating"] is None


def test_people_and_members(spark):
    rows = {r["username"]: r for r in extract.people(page(spark, PEOPLE)).collect()}
    assert (rows["ann"]["display_name"], rows["ann"]["n_films"], rows["ann"]["n_followers"]) == ("Ann & Co", 42, 1234)
    assert (rows["bob_2"]["n_films"], rows["bob_2"]["n_followers"]) == (None, None)
    assert sorted(r["username"] for r in extract.members(page(spark, PEOPLE + PEOPLE)).collect()) == ["ann", "bob_2"]


def test_reviews_and_backfill(spark):
    found = extract.reviews(page(spark, REVIEWS))
    a, b = found.orderBy("pos").collect()
    assert (a["username"], a["rating"], a["liked"], a["spoiler"], a["truncated"], a["n_comments"], a["n_likes"], a["date"]) == ("ann", 3.5, True, False, True, 1002, 31, "2024-02-03")
    assert a["text"] == "Fine <3 &amp; more…"
    assert (b["rating"], b["spoiler"], b["truncated"], b["full_text_url"], b["text"]) == (None, True, False, "/s/full-text/viewing:6/", "Plain")
    full = spark.createDataFrame([(5, "whole"), (6, "unused")], "viewing_id long, text string")
    assert {r["viewing_id"]: r["text"] for r in extract.backfilled(found, full, "viewing_id").collect()} == {5: "whole", 6: "Plain"}
    assert extract.reviews(page(spark, "nothing")).count() == 0


def test_histogram_and_ids(spark):
    assert {r["stars"]: r["n"] for r in extract.histogram(page(spark, HISTOGRAM)).collect()} == {0.5: 1003, 3.5: 7, 1.0: 9}
    a, b = extract.film_ids(page(spark, FILM)).first(), extract.film_ids(page(spark, "<p>")).first()
    assert (a["tmdb_id"], a["tmdb_type"], a["imdb_id"], a["poster"]) == (603, "movie", "tt0133093", "https://a.ltrbxd.com/resized/film-poster/1-alpha-0-125-0-187-crop.jpg?v=1-2-3-4-crop.jpg")
    assert b["tmdb_id"] is None and b["imdb_id"] is None


def test_coverage_drops_absent_fields(spark):
    rows = spark.createDataFrame([("u", 1.0, None, True), ("u", None, None, False)], "user string, rating double, link string, liked boolean")
    assert {r["field"]: r["coverage"] for r in extract.field_coverage(rows, "user", ["rating", "link"], ["liked"]).collect()} == {"rating": 0.5, "liked_true": 0.5}


def test_columns(spark):
    rows = spark.createDataFrame([("42,489", "abc"), ("x", "abc")], "n string, s string")
    assert [r[0] for r in rows.select(C.separated_int(F.col("n"))).collect()] == [42489, None]
    assert rows.select(C.sha_shard(F.col("s"), 7)).first()[0] == 5
    urls = spark.createDataFrame([("https://a.example/u/films/", 1), ("https://a.example/u/films/", 3)], "base string, page int")
    assert [r[0] for r in urls.select(C.paged(F.col("base"), F.col("page"))).collect()] == ["https://a.example/u/films/", "https://a.example/u/films/page/3/"]


def test_page_store(spark, tmp_path):
    for i, row in enumerate([("https://a.example/1", 200, 1.0), ("https://a.example/1", 404, 2.0), ("https://b.example/2", 500, 3.0)]):
        with gzip.open(tmp_path / f"{i}.json.gz", "wt") as f:
            json.dump(dict(zip(("url", "status", "fetched_at"), row, strict=True)) | {"body": "x", "transport": "http"}, f)
    (tmp_path / "bad.json").write_text("{broken")
    found = pages.read_pages(spark, str(tmp_path))
    assert found.count() == 3
    assert {r["url"]: r["status"] for r in pages.latest(found).collect()} == {"https://a.example/1": 404, "https://b.example/2": 500}
    assert found.where(pages.usable(21_601.0)).count() == 3 and found.where(pages.usable(30_000.0)).count() == 1
    stats = pages.store_stats(found).first()
    assert (stats["entries"], stats["ok"], stats["failed"]) == (3, 1, 2)
    pages.write_pages(found, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_lists_and_scans(spark, tmp_path):
    lines = spark.createDataFrame(list(enumerate(["# c", "", " a ", "b", "a"])), "pos int, value string")
    assert sorted((r["url"], r["pos"]) for r in pages.listed(lines).collect()) == [("a", 2), ("b", 3)]
    scan = spark.createDataFrame([("x", 1, 200, 5), ("x", 2, 200, 0), ("x", 3, 200, 5), ("y", 1, 404, 5), ("z", 1, 200, 1)], "entity string, page int, status int, n_rows int")
    assert sorted((r["entity"], r["page"]) for r in pages.scanned(scan).collect()) == [("x", 1), ("z", 1)]
    for name, text in (("a", '{"seeds": ["p", "q", "p"]}'), ("b", '[{"slug": "p"}, {"slug": "q"}]'), ("c", "# c\np\n\nq\n")):
        (tmp_path / name).write_text(text)
        assert [r["slug"] for r in artifacts.read_seeds(spark, str(tmp_path / name)).orderBy("pos").collect()] == ["p", "q"]
    assert artifacts.report(scan.orderBy("entity", "page"), "<x>DATA</x>", "DATA", 1) == '<x>[{"entity":"x","page":1,"status":200,"n_rows":5}]</x>'


def test_no_break_spaces(spark):
    """Real pages set counts off by no-break spaces, as characters or by name."""
    body = '<p>12 ★★ ratings in prose</p><a title="5,454 half-★ ratings (0%)"></a><a title="7 ★★★½ ratings"></a><a title="9&nbsp;★ ratings"></a><a title="3 stars ratings"></a>'
    assert {r["stars"]: r["n"] for r in extract.histogram(page(spark, body)).collect()} == {0.5: 5454, 3.5: 7, 1.0: 9}
    row = '<table><tr><td class="col-member table-person"><a href="/ann/" class="name"> Ann &amp; Co </a> <a>1,234 followers</a></td></tr></table>'
    got = extract.people(page(spark, row)).first()
    assert (got["username"], got["display_name"], got["n_followers"], got["n_films"]) == ("ann", "Ann & Co", 1234, None)


def test_records_by_route(spark):
    pages = [("https://s.example/ann/rss/", 200, FEED), ("https://s.example/ann/films/", 200, GRID), ("https://s.example/ann/films/page/2/", 500, GRID), ("https://s.example/ann/following/", 200, PEOPLE), ("https://s.example/film/x/reviews/", 200, REVIEWS), ("https://s.example/film/x/", 200, FILM), ("https://s.example/film/y/", 200, ""), ("https://s.example/about", 200, GRID), ("https://s.example/bob/rss/", 200, "<rss")]
    got = extract.record_counts(spark.createDataFrame(pages, "url string, status int, body string"))
    assert {r["kind"]: (r["pages"], r["records"]) for r in got.collect()} == {"rss": (2, 2), "films": (1, 3), "non200": (1, 0), "people": (1, 2), "reviews": (1, 2), "film_ids": (2, 1), "other": (1, 0)}
