"""Host rules, importance resampling and vector codes, against brute force on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import common, host_rules, queries, resampling, vector_codes

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def texts(rng, n):
    out = [" ".join(rng.choice(WORDS, int(rng.integers(1, 120)))) for _ in range(n)]
    out += [None, "", "   \n\t\n", "a a a a", "x y z " * 40, "one line\none line\n\none line", "é ﷽ \U0001f600 # * $%", "w" * 50_000, ("word " * 3_000).strip(), "\x0b\x0c\r mixed\rspace\x0b"]
    return [*out, *out[:7]]


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] >= 2 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures(spark):
    rows = list(enumerate(texts(np.random.default_rng(2), 60)))
    got = host_rules.measured(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))).collect()
    assert {r["doc_id"]: tuple(r[k] for k in [*host_rules.MEASURES, "n_lines"]) for r in got} == {i: brute_measures(t) for i, t in rows}


def brute_kept(rows):
    """(host rejected, kept) by row, in plain Python."""
    fails, hosts = [], {}
    for _, host, text in rows:
        n, chars, symbols, dup, repeats, lines = brute_measures(text)
        fails.append((n < 50 or 100 * repeats > 50 * n, 100 * symbols > 10 * n, 100 * dup > 30 * lines, chars < 3 * n or chars > 10 * n))
        if host is not None:
            hosts.setdefault(host, []).append(fails[-1])
    bad = set()
    for rule in range(4):
        counts = {h: (len(x), sum(f[rule] for f in x)) for h, x in hosts.items()}
        m = sum(k for _, k in counts.values()) / sum(n for n, _ in counts.values())
        rates = [k / n for n, k in counts.values()]
        mean = sum(rates) / len(rates)
        spread = sum((r - mean) ** 2 for r in rates) / (len(rates) - 1) - m * (1 - m) * sum(1 / n for n, _ in counts.values()) / len(rates)
        s = min(max(m * (1 - m) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
        bad |= {h for h, (n, k) in counts.items() if (k + m * s) / (n + s) > 0.5}
    return [(h in bad, not f[0] and h not in bad) for (_, h, _), f in zip(rows, fails, strict=True)]


def test_host_rules(spark, monkeypatch):
    rng = np.random.default_rng(3)
    good, junk = [" ".join(rng.choice(WORDS, 80)) for _ in range(40)], ["buy # now * " * 30 + str(i) for i in range(20)]
    rows = [(i, "big", t) for i, t in enumerate(good)] + [(100 + i, "junk", t) for i, t in enumerate(junk)] + [(200 + i, "junk", t) for i, t in enumerate(good[:3])]
    rows += [(300 + i, f"h{i % 7}", t) for i, t in enumerate(texts(rng, 50))] + [(400, None, good[0]), (401, None, ""), (402, "", good[1]), (402, "", good[1]), (None, "big", good[2])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"_key": F.lit(1), "kept": F.lit("x"), "_host": F.lit("y")})
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, r, k) for (i, _, _), (r, k) in zip(rows, brute_kept(rows), strict=True)), key=key)
    assert any(r for _, r, _ in want) and any(k for _, _, k in want)
    for share in (common.HOT_SHARE, 5, 0):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = host_rules.with_host_rules(docs).select("doc_id", "host_rejected", "kept").collect()
        assert sorted(map(tuple, got), key=key) == want
    assert host_rules.with_host_rules(docs.limit(0)).count() == 0
    assert host_rules.with_host_rules(docs.where("source is null"), keep=("doc_id", "kept")).count() == 2


def test_host_rules_stay_in_spark(spark, folder):
    for df in (queries.op11_host_rules(spark, folder), host_rules.measured(spark.read.parquet(f"{folder}/documents.parquet"))):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [zlib.crc32(x.encode()) % 10_000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]], len(words)


def brute_resampled(docs, target, percent=25, seed=7):
    found = [(i, *brute_features(t)) for i, t in docs]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in brute_features(x)[0])
    big_s, big_t = sum(s.values()) + 10_000.0, sum(t.values()) + 10_000.0
    rows = []
    for i, f, n in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def test_resampled(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = list(enumerate(texts(rng, 150) + ["Ünïcode WORDS 12 " * 30] * 40 + [" ".join(rng.choice(WORDS, 30))] * 9))
    target = [" ".join(rng.choice(WORDS[:4], 40)) for _ in range(10)] + [None, ""]
    frames = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_key": F.lit(1), "copies": F.lit(2)}), spark.createDataFrame([(x,) for x in target], "text string")
    for share, at_once in ((1_000, 1 << 16), (6, 7)):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        monkeypatch.setattr(resampling, "WORDS_AT_ONCE", at_once)
        got = resampling.resampled(*frames).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=str) == brute_resampled(docs, target)
    assert resampling.resampled(frames[0].limit(0), frames[1]).count() == 0
    assert {r["weight"] for r in resampling.resampled(frames[0].limit(3), frames[1].limit(0)).collect()} != set()


def test_resampled_repeats(spark):
    text = " ".join(WORDS * 3)
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    rows = resampling.resampled(docs, docs.select("text"), percent=75).collect()
    assert len(rows) == 5 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3] and {r["n_features"] for r in rows} == {0, 59}


def test_registered_resampling(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    got = queries.op12_importance_resampling(spark, folder).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute_resampled(docs, target)


def brute_codes(rows, parts, entries, rounds, scale):
    """Rows (id, label, vector); every distance is computed. Returns (id, label, code, error) and the codebooks."""
    dims = -(-max(len(v) for *_, v in rows) // parts) * parts
    cells = [[math.floor(x * scale) for x in v] + [0] * (dims - len(v)) for *_, v in rows]
    x = np.array(cells, np.int64).reshape(len(rows), parts, dims // parts)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])[:entries]
    books = x[order].transpose(1, 0, 2).copy()

    def nearest(p):
        d = ((x[:, p, None, :] - books[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(parts):
            best = nearest(p)[0]
            books[p] = [x[best == e, p].sum(0) // (best == e).sum() if (best == e).any() else books[p][e] for e in range(len(order))]
    found = [nearest(p) for p in range(parts)]
    return [(i, label, "".join(f"{found[p][0][k]:02x}" for p in range(parts)), int(sum(found[p][1][k] for p in range(parts)))) for k, (i, label, _) in enumerate(rows)], books


@pytest.mark.parametrize(("entries", "dims"), [(8, 12), (256, 8), (5, 10)])
def test_vector_codes(spark, monkeypatch, entries, dims):
    monkeypatch.setattr(vector_codes, "STRIP", 16)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 4)) if i % 5 else None, rng.normal(0, 0.4, dims).round(3).tolist()) for i in range(120)]
    rows += [(200 + i, 1, rows[3][2]) for i in range(30)] + [(300, 9, [0.0] * dims), (301, None, [1e3] * dims), (302, 2, [-0.0005] * (dims - 1))]
    frame = spark.createDataFrame(rows, "id long, label int, v array<double>").withColumns({"code": F.lit("x"), "_key": F.lit(3)})
    got, books = vector_codes.vector_codes(frame, entries=entries)
    want, want_books = brute_codes(rows, 4, entries, 4, 1024)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert books.tolist() == want_books.tolist()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*r, sums[r[1]]) for r in want), key=str)


def test_vector_codes_edges(spark):
    schema = "id long, label int, v array<float>"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema))[0].count() == 0
    got, _ = vector_codes.vector_codes(spark.createDataFrame([(1, None, []), (1, None, []), (2, 3, [])], schema))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, "00000000", 0, 0), (1, None, "00000000", 0, 0), (2, 3, "00000000", 0, 0)], key=str)


def test_registered_codes(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, rng.normal(0, 0.1, 16).astype(np.float32).tolist()) for i in range(400)] + [(900, 1, None), (901, 1, [1.0, None] * 8), (902, None, [float("nan")] * 16), (903, 2, [float("inf")] * 16)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = brute_codes([(i, a, [float(x) for x in v]) for i, a, v in rows[:400]], 4, 256, 4, 1024)
    got = queries.op13_vector_codes(spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted((i, c, e) for i, _, c, e in want)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}


def test_bounds_hold():
    rng = np.random.default_rng(9)
    entries, x = rng.integers(-500, 500, (40, 7)), rng.integers(-2_000, 2_000, (60, 7))
    lower, upper = vector_codes.VaFile.of(entries).bounds(x)
    apart = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (lower <= apart).all() and (apart <= upper).all()
    few = (lower <= upper.min(1, keepdims=True)).mean()
    assert few < 0.6
