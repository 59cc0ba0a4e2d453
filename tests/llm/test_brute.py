"""Language identification and the pipeline against brute-force versions in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import common, language, mixing, pieces, queries, toxicity
from tests.llm.test_rows import water_fill
from tests.llm.test_texts import brute_components


def learns_from(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def ngrams(text):
    """Buckets of the 1- to 3-grams of a text's lower-case letters, runs of anything else being one gap."""
    low = []
    for c in text or "":
        x = c.lower() if len(c.lower()) == 1 else c
        low += [ord(x)] if c.isalpha() else [0] if low and low[-1] else []
    for n in language.ORDERS:
        for i in range(len(low) - n + 1):
            if n == 1 and not low[i]:
                continue
            h = 0x4F6CDD1D
            for code in low[i : i + n]:
                h = (h ^ code) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            yield (h * 0x85EBCA77 % 2**32) >> (33 - language.BUCKETS.bit_length())


def naive_bayes(rows):
    """{doc_id: (language, score)} of rows (doc_id, text, lang), learned from those outside the held-out fold."""
    counts, seen, grams = defaultdict(Counter), Counter(), {r[0]: Counter(ngrams(r[1])) for r in rows}
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and learns_from(doc_id):
            counts[lang].update(grams[doc_id])
            seen[lang] += 1
    sums, out = {x: sum(counts[x].values()) + 0.1 * language.BUCKETS for x in counts}, {}
    for doc_id, found in grams.items():
        n = sum(found.values())
        if not n:
            out[doc_id] = ("und", 0.0)
            continue
        total = {x: math.log(seen[x] / sum(seen.values())) + sum(k * math.log((counts[x][b] + 0.1) / sums[x]) for b, k in found.items()) for x in counts}
        best = max(sorted(total), key=total.get)
        out[doc_id] = (best, 1 / sum(math.exp((t - total[best]) * min(1, language.EVIDENCE_NGRAMS / n)) for t in total.values()))
    return out


def rows_of(docs, *columns):
    return [tuple(r) for r in docs.select(*columns).collect()]


def test_language_against_brute_force(spark, folder):
    want = naive_bayes(rows_of(common.table(spark, folder, "documents"), "doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, folder).collect()}
    assert got.keys() == want.keys()
    for i, (name, score) in want.items():
        assert got[i]["lang_pred"] == name and got[i]["score"] == pytest.approx(score, abs=2e-3)
        assert got[i]["held_out"] != learns_from(i)


def fitted(rows):
    """(y, k, pools) of isotonic regression by pooling over (x, y, weight)."""
    pools = []
    for x in sorted({r[0] for r in rows}):
        same = [r for r in rows if r[0] == x]
        pools.append([sum(r[2] for r in same), sum(r[0] * r[2] for r in same), sum(r[1] * r[2] for r in same)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [p[1] / p[0] for p in pools], [p[2] / p[0] for p in pools]


def straight(x, xs, ys):
    if x <= xs[0]:
        return ys[0]
    for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False):
        if x <= b:
            return c + (d - c) * (x - a) / (b - a)
    return ys[-1]


def toxic_scores(rows, labels, terms_of, signature_of):
    """{doc_id: score}: every text against every labelled example, all by dictionaries. All labels fit into the sample."""
    texts, groups = dict(rows), defaultdict(list)
    for k, y in labels.items():
        if k in texts and learns_from(k):
            groups[y, signature_of(texts[k])].append(k)
    examples = [(min(ids), y, len(ids)) for (y, _), ids in groups.items()]
    n1, n = sum(y for _, y, _ in examples), len(examples)
    toxic, clean = Counter(), Counter()
    for k, y, _ in examples:
        (toxic if y else clean).update(terms_of(texts[k]).keys())

    def g2(t):
        a, c = toxic[t], clean[t]
        e = (a + c) * n1 / n
        return 2 * sum(x * math.log(x / m) for x, m in ((a, e), (c, a + c - e)) if x)

    chosen = toxic.keys() | clean.keys()
    total = sum(learns_from(k) for k in labels)
    idf = {t: (math.log((total + 1) / (toxic[t] + clean[t] + 1)) + 1) * (math.sqrt(max(g2(t), 0)) + toxicity.LEAST_STRENGTH) for t in chosen}

    def vector(text):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in terms_of(text).items() if t in chosen}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {k: vector(texts[k]) for k, _, _ in examples}
    heard = sorted((k, y, m) for k, y, m in examples if vectors[k])
    silent = [(y, m) for k, y, m in examples if not vectors[k]]
    base = sum(y * m for y, m in silent) / sum(m for _, m in silent) if silent else 0.0

    def vote(v, without=None):
        near = [(-round(sum(x * vectors[k].get(t, 0) for t, x in v.items()), 12), k, y, m) for k, y, m in heard if k != without]
        near = sorted(x for x in near if x[0] < 0)[: toxicity.NEIGHBOURS]
        weights = [m / (1 + toxicity.LEAST_DISTANCE + max(s, -1)) ** 2 for s, _, _, m in near]
        return sum(w * x[2] for w, x in zip(weights, near, strict=True)) / sum(weights) if near else None

    own = [(round(vote(vectors[k], k), 9), y, m) for k, y, m in heard if vote(vectors[k], k) is not None]
    xs, ys = fitted(own)
    votes = {k: vote(vector(t)) for k, t in texts.items()}
    return {k: base if v is None else straight(v, xs, ys) for k, v in votes.items()}


def best_score(text, model, known):
    """The best segmentation's score, by plain Viterbi over each segment."""
    for segment in pieces.segments(text) if text else []:
        if segment not in known:
            ends, best = model.lattice(segment)[0], [0.0]
            for j in range(1, len(segment) + 1):
                best.append(max((best[i] + s for i, (_, s) in ends[j]), default=-math.inf))
            known[segment] = best[-1]
    return sum(known[s] for s in (pieces.segments(text) if text else []))


def test_pipeline_against_brute_force(spark, folder, tmp_path):
    docs = common.table(spark, folder, "documents")
    labels = {r["doc_id"]: int(r["toxic"] > 0) for r in common.table(spark, folder, "labels").where("toxic is not null").collect()}
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    ids = [sorted(r["doc_id"] for r in x.select("doc_id").collect()) for x in kept]

    def terms_of(text, known={}):  # noqa: B006
        if text not in known:
            _, term, n = toxicity.term_counts(*common.utf8_parts(pa.array([text])))
            known[text] = dict(zip(term.astype("int64").tolist(), n.tolist(), strict=True))
        return known[text]

    rows = [(i, t or "") for i, t in rows_of(kept[0], "doc_id", "text")]
    scores = toxic_scores(rows, labels, terms_of, lambda t: int(toxicity.signatures(pa.array([t]))[0]))
    model = toxicity.train_toxicity(docs, common.table(spark, folder, "labels").where(~common.held_out()))
    told = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(docs, model).collect()}
    assert told == pytest.approx(scores, abs=1e-6)
    assert ids[1] == sorted(i for i, s in scores.items() if s < corpus_pipeline.TOXIC_FROM)

    languages = naive_bayes(rows_of(kept[1], "doc_id", "text", "lang"))
    assert ids[2] == sorted(i for i, (name, s) in languages.items() if name != "und" and s >= corpus_pipeline.CERTAIN_FROM)

    classes = brute_components(rows_of(kept[2], "doc_id", "text"), corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    assert ids[3] == sorted(i for i, (_, first) in classes.items() if i == first) and len(ids[3]) < len(ids[2])

    levels = kept[3].withColumn("domain", queries.domain_of()).select("doc_id", "domain", "lang", "source", "text")
    leaves, tree = defaultdict(list), defaultdict(lambda: defaultdict(dict))
    order = {r["doc_id"]: r["o"] for r in levels.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", mixing.words()).alias("o")).collect()}
    for i, *path, text in levels.collect():
        n, path = len(re.findall(r"\S+", text or "", re.ASCII)), [x or "(none)" for x in path]
        if n:
            leaves[tuple(path)].append((order[i], i, n))
            tree[path[0]][path[1]][path[2]] = tree[path[0]][path[1]].get(path[2], 0) + n
    budget = int(sum(n for docs in leaves.values() for _, _, n in docs) * corpus_pipeline.MIX_SHARE)
    weights = {name: Fraction(str(w)) for level in queries.MIX_WEIGHTS.values() for name, w in level.items()}
    shares = water_fill({d: {x: dict(s) for x, s in a.items()} for d, a in tree.items()}, budget, weights)
    out, taken = mixing.mixed(levels, queries.MIX_LEVELS, share=corpus_pipeline.MIX_SHARE, epochs=1, weights=queries.MIX_WEIGHTS).collect(), []
    took = {r["doc_id"]: r["epochs"] * r["n_tokens"] + r["part"] for r in out}
    assert sum(took.values()) == budget
    for path, docs_of in leaves.items():
        given, before = sum(took.get(i, 0) for _, i, _ in docs_of), 0
        assert abs(given - shares[path]) < 4
        for _, i, n in sorted(docs_of):
            assert took.get(i, 0) == max(0, min(n, given - before))
            taken += [i] if before < given else []
            before += n
    assert ids[4] == sorted(taken)

    model, known, texts = pieces.load(queries.piece_model()), {}, dict(rows_of(kept[4], "doc_id", "text"))
    best = {r["doc_id"]: r["scores"][0] for r in kept[5].collect()}
    assert best == pytest.approx({i: best_score(t, model, known) for i, t in texts.items()}, rel=1e-9)
