"""The page store, runs of pages, artifacts of changing shape, and references of markup against the standard library."""

import html
import json
import random
import re
from html.entities import html5
from pathlib import Path

from pyspark.sql import functions as F

from kindred.functions import columns as C
from kindred.functions.references import decoded
from kindred.sources import artifacts, pages, store

PAGES = "url string, status int, body string, transport string, fetched_at double"


def stored(spark, root, n=40):
    rows = [(f"https://h{i % 3}.example/p/{i}", 200 if i % 5 else 404, f"body é {i}", "http", float(i)) for i in range(n)] + [("no host", 200, None, None, 1.0)]
    store.put_pages(spark.createDataFrame(rows, PAGES), str(root))
    return rows


def test_store_round_trip(spark, tmp_path):
    rows = stored(spark, tmp_path)
    files = store.read_store(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r)[:5] for r in files.collect()))) == sorted(map(str, rows))
    assert (tmp_path / store.place("no host")).is_file() and store.place("no host").startswith("_/")
    assert not list(tmp_path.rglob("*.tmp"))
    keys = {r["url"]: r["k"] for r in files.select("url", pages.store_key().alias("k")).collect()}
    assert {f"{k}.json.gz" for k in keys.values()} == {store.place(u) for u in keys}


def test_store_replaces_and_keeps_the_last(spark, tmp_path):
    stored(spark, tmp_path)
    again = [("https://h1.example/p/1", 200, "old", "http", 5.0), ("https://h1.example/p/1", 200, "new", "browser", 9.0)]
    store.put_pages(spark.createDataFrame(again, PAGES), str(tmp_path))
    found = store.read_store(spark, str(tmp_path)).where("url = 'https://h1.example/p/1'").collect()
    assert [(r["body"], r["fetched_at"]) for r in found] == [("new", 9.0)]
    assert store.read_store(spark, str(tmp_path)).count() == 41


def test_damaged_files_are_misses(spark, tmp_path):
    stored(spark, tmp_path)
    for url, damage in (("https://h0.example/p/0", lambda d: d[:20]), ("https://h1.example/p/1", lambda d: b"no gzip"), ("https://h2.example/p/2", lambda d: b"")):
        path = tmp_path / store.place(url)
        path.write_bytes(damage(path.read_bytes()))
    files = store.read_store(spark, str(tmp_path))
    assert files.where("damaged").count() == 3 and files.where("not damaged").count() == 38
    stats = store.file_stats(files).first()
    assert (stats["entries"], stats["ok"], stats["failed"]) == (41, 31, 10)
    assert store.read_store(spark, str(tmp_path), "https://h0.example/p/0").where("not damaged").count() == 0


def test_one_page_opens_one_file(spark, tmp_path):
    stored(spark, tmp_path)
    url = "https://h1.example/p/7"
    for name in tmp_path.rglob("*.json.gz"):
        if name != tmp_path / store.place(url):
            name.write_bytes(b"damaged")
    one = store.read_store(spark, str(tmp_path), url)
    assert [r["url"] for r in one.collect()] == [url] and one.rdd.getNumPartitions() == 1
    assert store.read_store(spark, str(tmp_path), "https://h9.example/none").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = store.read_store(spark, str(tmp_path)).where(F.col("url") == url)
        assert [r["body"] for r in pushed.collect()] == ["body é 7"] and pushed.rdd.getNumPartitions() == 1
        assert store.read_store(spark, str(tmp_path)).where("damaged").count() == 40
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_hosts_are_split_over_tasks(spark, tmp_path):
    rows = [(f"https://big.example/{i}", 200, "x", "http", 1.0) for i in range(600)]
    store.put_pages(spark.createDataFrame(rows, PAGES), str(tmp_path))
    parts = store.StoreReader({"path": str(tmp_path)}).partitions()
    assert len(parts) > 10 and max(len(p.folders) for p in parts) <= store.FOLDERS_PER_TASK
    assert store.read_store(spark, str(tmp_path)).count() == 600
    assert store.read_store(spark, f"{tmp_path}/nothing").count() == 0


def scan(rows, cap):
    """Page by page, as a client reads them: until the cap, or the first page that is missing, failed or empty."""
    kept, page = [], 1
    while cap is None or page <= cap:
        if page not in rows:
            return kept, "missing"
        if rows[page][0] != 200:
            return kept, "failed"
        if not rows[page][1]:
            return kept, "empty"
        kept.append(page)
        page += 1
    return kept, "cap"


def test_runs_of_pages(spark):
    rng = random.Random(3)
    pages_of = {e: {p: (rng.choice([200] * 12 + [404]), rng.choice([0, *[3] * 15])) for p in range(1, 15) if rng.random() > 0.06} for e in range(60)}
    pages_of[99] = {5: (200, 1)}
    rows = [(e, p, s, n) for e, own in pages_of.items() for p, (s, n) in own.items()] + [(7, 0, 200, 1), (None, 1, 200, 1), (99, None, 200, 1)]
    frame = spark.createDataFrame(rows, "entity long, page long, status int, n_rows long").withColumn("stop", F.lit("x"))
    for cap in (None, 4, 30):
        got = {}
        for r in pages.scanned(frame.drop("stop"), cap=cap).collect():
            got.setdefault(r["entity"], []).append((r["page"], r["truncated"]))
        why = {r["entity"]: r["why"] for r in pages.run_ends(frame, cap=cap).collect()}
        for e, own in pages_of.items():
            if own:
                kept, reason = scan(own, cap)
                assert (sorted(got.get(e, [])), why[e]) == ([(p, reason == "cap") for p in kept], reason)


def test_decoded_like_the_standard(spark):
    rng = random.Random(5)
    names, old = sorted(html5), [n for n in html5 if not n.endswith(";")]
    parts = ["&", ";", "#", "x", "&#", "&#x", " ", "é", "<", "&amp;", "&amp", "&lt;", "&#38;", "&#x26;lt;", "&#0;", "&#13;", "&#128;", "&#x9f", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#x0000000000041;", "&#11;", "&#xfdd0;", "&#x1F600;", "&#xFFFE;", "&notit;", "&notin;", "&ampx;", "\n", "a" * 40]
    texts = ["".join(rng.choice([rng.choice(parts), "&" + rng.choice(names), "&" + rng.choice(old), "&" + rng.choice(names).rstrip(";"), chr(rng.randint(33, 600))]) for _ in range(12)) for _ in range(1500)]
    texts += [f"a&{n}b" for n in names] + [f"&{n[:-1]}" for n in names] + [None, "", "&", "&&", "plain"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", decoded(F.col("t")).alias("d")).collect()
    assert [(r["t"], r["d"]) for r in rows if r["d"] != (None if r["t"] is None else html.unescape(r["t"]))] == []


def test_stripped_like_the_standard(spark, folder):
    docs = spark.read.parquet(f"{folder}/pages.parquet").select("html").unionByName(spark.createDataFrame([("<p>a&nbsp;&hellip;\x1f<br/>b<></p> \x85 c　",), ("",)], "html string"))
    for r in docs.select("html", C.stripped(F.col("html")).alias("t")).collect():
        assert r["t"] == " ".join(html.unescape(re.sub("<[^>]+>", " ", r["html"])).split())


def test_artifacts_of_changing_shape(spark, tmp_path):
    lines = [{"slug": "a", "hist": {"4.5": 3, "x": 1, "1": None}}, {"film": "b", "hist": [[4.0, 2], [0.5, 7], "odd"]}, {"film": 3, "hist": [{"stars": 5, "n": 1}, {"n": 2}]}, {"slug": "none"}, {"hist": {"1": 2}}, [1, 2], "text", None, {"slug": "e", "hist": {}}]
    Path(tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)) + '\n{"slug": "cut", "hi\n')
    variants = artifacts.read_variants(spark, str(tmp_path))
    assert variants.count() == 10
    assert sorted(map(tuple, artifacts.histograms(variants).collect())) == [("3", 5.0, 1), ("a", 4.5, 3), ("b", 0.5, 7), ("b", 4.0, 2)]
