"""What shows on larger or odd tables only: the queries' own SQL, and work that must not grow with the square of the input."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kindred.operators import extract, models, similarity
from kindred.sources import pages, store
from kindred.streaming import pages as stream


def against_sql(spark, folder, name, **tables):
    """A query and its SQL over frames written to a folder: rows sorted as text."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got, want = entry.queries()[name](spark, str(folder)), con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    plain = lambda rows: sorted(tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)
    return plain(got.select(columns).collect()), plain(want.select(*columns).fetchall())


def test_references_that_are_cut_off_stay(spark, tmp_path):
    bodies = ["<title>Ly &amp;&amp; and&amp</title><p>x&amp", "&amp;lt; &lt;b&gt; &quot;&#39;&apos; &copy &copy; a&nbsp;&nbsp;b &am", "&hellip;&#8217;&notit;", "", None]
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(1)
    got, want = against_sql(spark, tmp_path, "html_strip_tags", pages=pages, events=events)
    assert got == want


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(3)
    rows = [(u, f, rng.randint(1, 10) / 2, rng.random() < 0.3) for u in range(60) for f in [*rng.sample(range(12), 9), *rng.sample(range(12, 60), 4)]]
    rows += [(u, f, rng.randint(1, 10) / 2, f == 100) for u in range(60, 64) for f in range(100, 108)]
    return spark.createDataFrame(rows, "user_id long, film int, rating double, is_test boolean")


@pytest.mark.parametrize(("limit", "block", "films", "parts"), [(4_096, 256, 1_024, 4), (400, 16, 4, 2), (400, 7, 1_000, 3), (0, 256, 5, 1)])
def test_pairs_are_used_where_they_are_made(spark, rated, monkeypatch, limit, block, films, parts):
    """Tiles hold whole sums: no aggregation stands above them, and predictions are those of the pairs joined one by one."""
    for name, value in (("FILM_PAIRS", limit), ("USERS_PER_BLOCK", block), ("FILMS_AT_ONCE", films), ("LEAST_PARTS", parts), ("HISTORY_PARTS", parts)):
        monkeypatch.setattr(similarity, name, value)
    history = rated.drop("is_test")
    train = rated.where("not is_test")
    near = similarity.weights(train, history, 3)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(models.neighbour_cf(rated, history, 3)) == rows(models.neighbour_cf(rated, history, near=near))
    sums = similarity.neighbour_sums(rated, history, 3)
    assert rows(sums.where("film is null").select("a", "n")) == rows(near.groupBy("a").count())
    pairs = similarity.pair_sums(rated, sums=["n", "r", "marked"], mark=F.col("is_test"))
    whole = similarity.correlated(similarity.pair_sums(train), 1).join(similarity.pair_counts(rated.where("is_test")).withColumnRenamed("n", "marked"), ["a", "b"], "left")
    assert rows(similarity.correlated(pairs, 1, "marked")) == rows(whole.fillna(0, ["marked"]))
    if limit < 3_600:
        assert pairs._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


@pytest.mark.parametrize(("limit", "block"), [(4_096, 256), (400, 16), (0, 7)])
def test_few_pairs_leave_their_tile(spark, rated, monkeypatch, limit, block):
    """Arms are summed up, and pairs that aren't asked for dropped, in the task that makes the pairs."""
    for name, value in (("FILM_PAIRS", limit), ("USERS_PER_BLOCK", block)):
        monkeypatch.setattr(similarity, name, value)
    mark, rows = F.col("is_test"), lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    pairs = similarity.pair_sums(rated, sums=["n", "r", "marked"], mark=mark)
    r = F.when(F.col("n") >= 4, F.col("r"))
    each = [F.count("*"), F.count(r), F.count_if(r >= 0.5), F.count_if(r <= -0.4), F.coalesce(F.sum(r), F.lit(0.0)), F.coalesce(F.sum(F.abs(r)), F.lit(0.0))]
    assert rows(similarity.pair_levels(rated, mark, 2, 4)) == rows(pairs.groupBy(F.least("marked", F.lit(2)), "n").agg(*each))
    far = similarity.pair_sums(rated, sums=["n", "r"], least=5, far=True)
    assert rows(far) == rows(similarity.pair_sums(rated, sums=["n", "r"]).where("n >= 5 and (r >= 0.5 or r <= -0.4)"))


def test_many_small_pages_are_one_batch(spark, tmp_path):
    rows = [(f"https://s.example/{i}/", 200, f'<a href="/u{i}/" class="name">x</a>', "http", 1.0) for i in range(230)]
    store.put_pages(spark.createDataFrame(rows, pages.PAGE), str(tmp_path / "in"))
    query = stream.keep_members(stream.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 230
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_files_are_listed_by_tasks(spark, tmp_path):
    for name in ("a.bin", "x/b.bin", "x/y/c.bin", "x/y/z/w/d.bin", "x/y2/e.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    files = store.files_below(spark, str(tmp_path))
    assert sorted((r["path"], bytes(r["content"])) for r in files.collect()) == [(x, x.encode()) for x in ("a.bin", "x/b.bin", "x/y/c.bin", "x/y/z/w/d.bin", "x/y2/e.bin")]
    known = spark.createDataFrame([("x/b.bin",), ("a.bin",)], "path string")
    assert {r["path"]: r["image"] for r in pages.with_image_text(files, known).collect()}.keys() == {"x/y/c.bin", "x/y/z/w/d.bin", "x/y2/e.bin"}


def test_a_review_is_searched_and_decoded_once(spark):
    page = '<article class="production-viewing"><a href="/u/film/x/" class="context"></a><div class="js-review-body">{}<div class="viewing-actions"></div></article>'
    texts = ["a <b>&amp;lt;</b>  b…", "", None]
    rows = spark.createDataFrame([(str(k), page.format(t) if t is not None else page.split("<div")[0]) for k, t in enumerate(texts)], "url string, body string")
    found = extract.reviews(rows)
    assert sorted((r["url"], r["text"], r["truncated"]) for r in found.collect()) == [("0", "a &lt; b…", True), ("1", "", False), ("2", None, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("js-review-body") == 1 and plan.count("split(_body") <= 1
