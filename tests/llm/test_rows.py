"""Vectors, mixing, sharding and the pipeline."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import common, mixing, neighbours, queries, sharding, topk, vector_blocks


def brute(rows, stride, k, score):
    """Rows (id, vector); a query leaves out its own row, not others of its id."""
    out = []
    for m, (q, x) in enumerate(rows):
        if q % stride == 0:
            best = sorted(((-score(x, y), i) for n, (i, y) in enumerate(rows) if n != m))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def in_order(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


@pytest.fixture(scope="module")
def vectors(tmp_path_factory, spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(300)]
    rows[7:20] = [(i, rows[5][1]) for i in range(7, 20)]  # ties
    rows += [(400, None), (450, [1.0, None] * 8), (500, [float("nan")] * 16), (550, [float("inf")] * 16), (600, [0.0] * 16), (None, rows[3][1]), (100, rows[100][1]), (100, rows[7][1]), (3, rows[60][1]), (3, rows[61][1])]
    folder = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]


def test_exact_top_k(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 2)
    folder, rows = vectors
    got = sorted(map(tuple, queries.op3_exact_top_k(spark, folder).collect()))
    weights = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    assert got == brute(weights, 50, 5, lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)))


def test_nearest(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERIES_PER_BLOCK", 4)
    folder, rows = vectors
    rows = [(i, [float(x) for x in v]) for i, v in rows if any(v)]
    assert sorted(map(tuple, queries.op7_nearest(spark, folder).collect())) == brute(rows, 20, 20, in_order)


def test_doubles_stay_doubles(spark, tmp_path):
    """Neighbours that differ in the tenth decimal, which floats don't hold."""
    rows = [(0, [1.0]), (1, [0.1]), (2, [0.1 + 1e-10]), (3, [0.1 - 1e-10])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, queries.op7_nearest(spark, str(tmp_path)).collect())) == [(0, 1, 2, 0.1 + 1e-10), (0, 2, 1, 0.1), (0, 3, 3, 0.1 - 1e-10)]


def test_quantisation_bound():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(20, 64)), rng.normal(size=(50, 64)) * rng.exponential(size=(50, 1))
    (qc, qs, qe), (cc, cs, ce) = neighbours.quantise(q), neighbours.quantise(c)
    near = neighbours.product(qc, cc) * qs[:, None] * cs
    bound = np.linalg.norm(q, axis=1)[:, None] * ce + qe[:, None] * (np.linalg.norm(c, axis=1) + ce)
    assert (np.abs(near - q @ c.T) <= bound + 1e-9).all()


def test_vectors_few_and_ragged(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (50, [3]), (100, [])], "id long, v array<long>").withColumn("query", F.lit(True))
    got = sorted(map(tuple, topk.exact_top_k(rows, 5).collect()))
    assert got == [(0, 1, 50, 3), (0, 2, 100, 0), (50, 1, 0, 3), (50, 2, 100, 0), (100, 1, 0, 0), (100, 2, 50, 0)]
    assert topk.exact_top_k(rows.withColumn("query", F.lit(False)), 5).count() == 0
    assert neighbours.nearest(rows.where("false"), 5).count() == 0
    assert vector_blocks.pack(rows.withColumn("row", F.col("id")).where("false"), "int64", 1).count() == 0
    one = topk.exact_top_k(rows.where("id = 50"), 5)
    assert one.count() == 0


@pytest.mark.parametrize(("most", "size"), [(1 << 14, 2), (1 << 30, 4), (1 << 62, 8)])
def test_blocks_take_the_narrowest_type(spark, most, size):
    rows = spark.createDataFrame([(0, [1, 2]), (50, [-most, most - 1])], "id long, v array<long>").withColumns({"row": F.col("id"), "query": F.lit(True)})
    assert len(vector_blocks.pack(rows, "int64", 1).first()["cells"]) == 4 * size
    got = sorted(map(tuple, topk.exact_top_k(rows, 5).collect()))
    assert got == [(0, 1, 50, most - 2), (50, 1, 0, most - 2)]


def test_lists_are_handed_on_in_parts(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_blocks, "QUERIES_KEPT", 3)
    test_exact_top_k(spark, vectors, monkeypatch)


def water_fill(node, budget, weights):
    """Exact shares of a tree {name: subtree or supply} by brute force: pour until a child is full, and again."""
    supply = lambda x: sum(map(supply, x.values())) if isinstance(x, dict) else x
    if not isinstance(node, dict):
        return {(): Fraction(budget)}
    left, open_, got = Fraction(budget), dict(node), {}
    while open_:
        total = sum(weights.get(k, 1) for k in open_)
        full = [k for k in open_ if supply(open_[k]) <= left * Fraction(weights.get(k, 1)) / total]
        if not full:
            got |= {k: left * Fraction(weights.get(k, 1)) / total for k in open_}
            break
        for k in full:
            got[k] = Fraction(supply(open_.pop(k)))
        left = Fraction(budget) - sum(got.values())
    return {(k, *path): v for k, b in got.items() for path, v in water_fill(node[k], b, weights).items()}


def test_leaf_budgets_against_brute_force(spark):
    rng = np.random.default_rng(2)
    tree = {d: {x: {s: int(rng.integers(1, 900)) for s in "pqr"} for x in ("en", "de")} for d in ("web", "books", "news")}
    leaves = spark.createDataFrame([(d, x, s, n) for d, a in tree.items() for x, b in a.items() for s, n in b.items()], "d string, x string, s string, tokens long")
    weights = {"d": {"web": 5.0, "books": 2.0}, "x": {"en": 3.0}}
    flat = {k: int(v) for w in weights.values() for k, v in w.items()}
    for budget in (0, 1, 1000, 3500, 10**6):
        got = {(r["d"], r["x"], r["s"]): r["budget"] for r in mixing.leaf_budgets(leaves, ["d", "x", "s"], budget, 1, weights).collect()}
        supply = {(d, x, s): n for d, a in tree.items() for x, b in a.items() for s, n in b.items()}
        assert sum(got.values()) == min(budget, sum(supply.values())) and all(got[k] <= supply[k] for k in got)
        want = water_fill(tree, min(budget, sum(supply.values())), flat)
        assert all(abs(got[k] - want[k]) < 4 for k in got)


def test_mixing_takes_prefixes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 10)
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en" if i % 3 else None, f"s{i % 2}") for i in range(200)] + [(900, None, "en", "s0"), (901, " ", "en", "s0"), (0, "w", None, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("part", F.lit("clash"))
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    for share, epochs in ((0.3, 1), (1.0, 1), (1.5, 2)):
        got = mixing.mixed(docs, ["lang", "source"], share=share, epochs=epochs).collect()
        assert sum(r["epochs"] * r["n_tokens"] + r["part"] for r in got) == int(total * share)
        cut = Counter((r["lang"], r["source"]) for r in got if r["part"])
        assert max(cut.values(), default=0) <= 1 and not any(r["doc_id"] in (900, 901) for r in got)
    assert mixing.mixed(docs.where("false"), ["lang"]).count() == 0


def test_plan_of_a_mixture_is_without_the_descent(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", f"s{i % 3}") for i in range(30)], "doc_id long, text string, lang string, source string")
    taken = mixing.mixed(docs.withColumn("domain", queries.domain_of()), queries.MIX_LEVELS, weights=queries.MIX_WEIGHTS)
    assert taken._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 4
    assert taken.agg(F.sum(F.col("epochs") * F.col("n_tokens") + F.col("part"))).first()[0] == 72


def test_sharding_law_and_links(spark):
    texts = [None, ""] + ["hot"] * 300 + [f"pair {i // 2}" for i in range(300)] + [f"single {i}" for i in range(197)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.sharded_documents(docs).collect()
    sizes, slots = Counter(r["shard"] for r in got), defaultdict(list)
    assert len(got) == len(texts) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    places = defaultdict(Counter)
    for r in got:
        places[texts[r["doc_id"]]][r["shard"]] += 1
    whole = [t for t in places if t and t.startswith("pair") and len(places[t]) == 1]
    assert len(whole) > 120 and len(places["hot"]) < 8
    assert (got_null := next(r for r in got if r["doc_id"] == 0))["size"] == 1 and got_null["text_crc32"] == 0
    assert sharding.sharded_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("linked_share", [0.3, 1.0])
def test_propagation_cuts_fewer_links(spark, linked_share):
    """Rounds gather groups: fewer links are cut after each of them, also where nearly every row is linked."""
    n = 1200
    rows = [(i, f"g{i % 60}" if i % 6 else "hot") for i in range(int(n * linked_share))]
    linked = spark.createDataFrame(rows, "row long, group string")
    quota = [n // 8] * 8
    cuts = [sharding.cut_links(sharding.propagate(linked, quota, r)) for r in (0, 1, 3, sharding.ROUNDS)]
    assert cuts[0] == sharding.cut_links(sharding.start(linked, 8)) and cuts[0] > cuts[1] >= cuts[3] and cuts[3] < 0.8 * cuts[0]
    docs = spark.createDataFrame(rows, "row long, group string").withColumn("pool", F.lit("clash"))
    got = sharding.balanced_shards(docs.withColumnRenamed("group", "name"), "name").collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    left = defaultdict(Counter)
    for r in got:
        left[r["name"]][r["shard"]] += 1
    assert sum((sum(c.values()) ** 2 - sum(x * x for x in c.values())) // 2 for c in left.values()) < 0.9 * cuts[0]


def test_pipeline(spark, folder, tmp_path):
    docs = common.table(spark, folder, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, folder, "labels").collect()}
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in kept]
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False)) and all(x.columns == docs.columns for x in kept[1:-1])
    assert sum(labels.get(i, 0) for i in ids[1]) < sum(labels.get(i, 0) for i in ids[0])
    again = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()}
    assert again == ids[-1] and len(again) > 0
    letters = docs.limit(3).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit("123")))
    assert corpus_pipeline.language(spark, docs.unionByName(letters.withColumn("doc_id", F.col("doc_id") + 10**6)), folder).where("doc_id >= 1000000").count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    def session(master, folder):
        held = []
        context = Fake(master=master, getCheckpointDir=lambda: held[-1] if held else None, setCheckpointDir=held.append)
        return Fake(sparkContext=context, conf=Fake(get=lambda name, default: folder))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master, None))
        assert common.shared_folder(session(master, "/shared")) == "/shared"
    assert "kindred-checkpoint-" in common.shared_folder(session("local[4]", None))
