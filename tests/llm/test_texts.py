"""Operators on texts: brute force, round trips, held-out accuracy and edge cases."""

import heapq
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import common, html, jaccard, language, pieces, queries, token_files, toxicity

TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, "same words here again and again"), (7, "same words here again and again"), (8, "été naïve 中文 🙂 ▁x"), (9, "long " * 30_000), (9, "long " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_word_hashes_follow_words():
    texts = ["A b\tc", "", "b", "a  B c", None, "é"]
    h, at, _ = common.word_hashes(*common.utf8_parts(pa.array(texts)))
    words = [w for t in texts for w in (t or "").lower().split()]
    assert list(np.diff(at)) == [3, 0, 1, 3, 0, 1]
    assert len({(w, x) for w, x in zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))


def test_language_held_out(spark, folder):
    docs = common.table(spark, folder, "documents")
    found = queries.op10_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.9
    assert found.score.between(0, 1).all()


def test_language_edges(spark, odd, empty):
    model = language.train_language_id(odd.withColumn("lang", F.when(F.col("doc_id") < 8, "xx").otherwise("yy")))
    found = {r["doc_id"]: r for r in language.with_language(odd, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[1]["score"] == 0
    assert found[4]["lang_pred"] == "xx" and found[9]["lang_pred"] == "yy"
    assert language.with_language(empty, model).count() == 0
    nothing = language.train_language_id(empty.withColumn("lang", F.lit("xx")))
    assert {r["lang_pred"] for r in language.with_language(odd, nothing).collect()} == {"und"}


@pytest.mark.parametrize("block", [16, 256])
def test_block_max_search_is_exact(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "COMMON", 9)
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, rng.integers(1, 8), replace=False)) for _ in range(500)]
    weights = [(w := rng.integers(1, 4, len(r)).astype(float)) / np.linalg.norm(w) for r in rows]
    start, term, weight = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows), np.concatenate(weights)
    index = toxicity.BlockMaxIndex(40, start, term, weight)
    dense = np.zeros((500, 40))
    for i, (r, w) in enumerate(zip(rows, weights, strict=True)):
        dense[i, r] = w
    for i, (ids, cosine) in enumerate(index.search(start, term, weight, 10, np.arange(500))):
        want = np.round(dense @ dense[i], 12)
        want[i] = 0
        order = [j for j in np.lexsort((np.arange(500), -want))[:10] if want[j] > 0]
        assert ids.tolist() == order and np.allclose(cosine, want[order])
    assert [len(x) for x, _ in index.search(np.array([0, 0]), term[:0], weight[:0], 10)] == [0]


def test_isotonic_pools():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]


def test_toxicity_learns_words_and_edges(spark, odd, empty):
    rows = [(i, ("vile " if i % 5 == 0 else "") + " ".join(f"w{i * 31 % 97}x{j}" for j in range(20)), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    scored = {r["doc_id"]: r for r in toxicity.with_toxicity(docs, model).collect()}
    assert all((scored[i]["score"] >= 0.5) == bool(y) for i, _, y in rows) and scored[5]["evidence"]
    edge = toxicity.with_toxicity(odd, model).collect()
    assert all(0 <= r["score"] <= 1 and r["evidence"] == [] for r in edge)
    assert toxicity.with_toxicity(empty, model).count() == 0
    none = toxicity.train_toxicity(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.with_toxicity(odd, none).collect()} == {0.0}


def test_toxicity_sees_whole_texts(spark):
    """Markers that clean texts hold too, or few toxic ones, count, and texts without any have clean neighbours."""
    rng = np.random.default_rng(4)
    lexicon = "the and for was his her not all".split()
    toxic = {i for i in range(400) if i % 5 == 0}
    rare = {0, 100, 200, 300, 390}
    quoting = {i for i in range(400) if i % 10 == 1}
    mark = lambda i: "crude " if i in rare else "vile " if i in toxic | quoting else ""
    docs = spark.createDataFrame([(i, mark(i) + " ".join(rng.choice(lexicon, 6))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(400)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r for r in toxicity.with_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()}
    mean = lambda ids: np.mean([scored[i]["score"] for i in ids])
    assert mean(toxic - rare) > 0.5 > 0.1 > mean(set(range(400)) - toxic - quoting)
    assert all(set(scored[i]["evidence"]) & (rare - {i}) for i in rare)
    assert all(r["evidence"] for r in scored.values())


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    best = {i: i for i in sets}

    def top(i):
        while best[i] != i:
            i = best[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            best[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, words, percent):
    rng = np.random.default_rng(words)
    rows = []
    for group in range(60):
        base = [f"g{group}w{k}" for k in range(int(rng.integers(5, 60)))]
        for _ in range(int(rng.integers(1, 6))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = f"n{rng.integers(1e9)}"
            rows.append((len(rows), " ".join([*("common passage of words that all share here" if group % 3 else "").split(), *copy])))
    rows += [(len(rows) + k, " ".join(f"t{j}" for j in range(n))) for k, n in enumerate((7, 8, 9, 10))]  # sets of 4 to 7 shingles
    rows += [(10_000 + i, t) for i, t in TEXTS[:-1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, words=words, percent=percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_jaccard_frequent_classes(spark, monkeypatch):
    """With every shared token frequent, pairs are found by combinations and by wide entities alone."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rng = np.random.default_rng(9)
    rows = []
    for group in range(12):
        base = [f"g{group % 4}w{k}" for k in range(20 + 30 * (group % 4))]
        for _ in range(6):
            copy = list(base)
            copy[int(rng.integers(len(copy)))] = f"n{rng.integers(1e9)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 4, 85).items()}


def test_jaccard_one_passage_in_many_texts(spark, monkeypatch):
    """A long passage with 2 to 20 % of own words at the end: the prefix tokens are shared, but few pairs are alike."""
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    monkeypatch.setattr(jaccard, "FEW_PER_TASK", 16)
    passage = " ".join(f"p{k}" for k in range(100))
    rows = [(i, f"{passage} " + " ".join(f"o{i // 2 if i % 7 == 0 else i}x{k}" for k in range(2 + i % 19))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_components(rows, 4, 85) and 2 < len({c for _, c in got.values()}) < 150


def test_jaccard_ids_null_and_repeated(spark):
    """Rows without an id link with nothing; of an id with two texts, each links by its own."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, a), (1, a), (1, b), (2, b), (3, "other words stand here alone"), (None, b)], "doc_id long, text string").withColumn("e", F.lit("clash"))
    got = sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3, None), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 2, 3), (None, 3, None)], key=str)


def test_jaccard_empty_and_repeated(spark, odd, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(TEXTS) and {r["component_id"] for r in got if r["id"] in (6, 7)} == {6}


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["e"]: r["c"] for r in jaccard.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_pieces_n_best_is_exact():
    model = pieces.load(queries.piece_model())
    for segment in ("▁hello", "▁▁wörld", "\na-b", "▁中文x"):
        ends, _ = model.lattice(segment)

        def paths(j, ends=ends):
            if j == 0:
                yield 0.0
            for i, (_, s) in ends[j]:
                for before in paths(i):
                    yield before + s

        want = heapq.nlargest(3, paths(len(segment)))
        assert np.allclose([s for s, _ in model.n_best(segment, 3)], want)


def test_pieces_of_a_part_are_found_once_for_all_segments():
    model, asked = pieces.Pieces(queries.piece_model()), []
    solved = model.solved
    model.solved = lambda parts, n: asked.extend(parts) or solved(parts, n)
    model.encode("ab☃ cd☃\n☃")
    way, exact = model.encode("ef☃ the☃")
    assert exact and asked.count("☃") == 1 and not {"▁ef☃", "▁the☃"} & set(asked)
    each = [model.n_best(part, 3) for part in ("▁ef", "☃", "▁the", "☃")]
    want = heapq.nlargest(3, (a[0] + b[0] + c[0] + d[0] for a in each[0] for b in each[1] for c in each[2] for d in each[3]))
    assert np.allclose([s for s, _ in way], want)


def test_pieces_of_texts(spark, odd, empty):
    model = pieces.load(queries.piece_model())
    words = ["▁a", "▁an", "▁the"]
    each = [model.n_best(w, 3) for w in words]
    want = heapq.nlargest(3, (a[0] + b[0] + c[0] for a in each[0] for b in each[1] for c in each[2]))
    assert np.allclose([s for s, _ in model.encode("a an the", 3)[0]], want)
    got = {r["doc_id"]: r["pieces"] for r in pieces.with_pieces(odd, queries.piece_model()).collect()}
    assert got[1]["n_pieces"] == got[2]["n_pieces"] == 0 and got[1]["exact"]
    assert all(got[i]["exact"] for i in (3, 4, 5, 6, 9)) and not got[8]["exact"]
    assert pieces.with_pieces(empty, queries.piece_model()).count() == 0
    back = pieces.with_text(pieces.with_pieces(odd, queries.piece_model()).select("doc_id", "pieces.ids"), queries.piece_model(), "ids").where("doc_id = 6").first()
    assert back["text"] == TEXTS[5][1]


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 20_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 20, n), rng.integers(0, 49_408, n)).astype(np.uint32)
    blobs, crcs = token_files.encode_blocks(ids, 16)
    assert (token_files.decode_blocks(blobs, crcs, n, 16) == ids).all()
    damaged = [bytes([blobs[0][0] ^ 255]) + blobs[0][1:], *blobs[1:]]
    with pytest.raises(ValueError):
        token_files.decode_blocks(damaged, crcs, n, 16)


def test_range_coder_extremes():
    for ids in (np.zeros(9000), np.full(9000, 49_407), np.arange(9000) % 2 * 49_407, np.tile([1, 2, 3], 3000)):
        blobs, crcs = token_files.encode_blocks(ids.astype(np.uint32), 16)
        assert (token_files.decode_blocks(blobs, crcs, len(ids), 16) == ids).all()
    assert sum(map(len, token_files.encode_blocks(np.tile([1, 2, 3], 3000), 16)[0])) < 2500


@pytest.mark.parametrize("bits", [9, 15, 16, 17, 23])
def test_range_coder_widths(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_000).astype(np.uint32)  # costs more than the room first made
    blobs, crcs = token_files.encode_blocks(ids, bits)
    assert (token_files.decode_blocks(blobs, crcs, len(ids), bits) == ids).all()


def test_coder_mixes_orders(spark, folder):
    """Texts take at most 9.5 bits an id (blocks start afresh, so the corpus's own entropy of 8.3 is out of reach), and
    fewer than the same ids without their order."""
    texts = [r["text"] or "" for r in common.table(spark, folder, "documents").select("text").collect()]
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in token_files.load(queries.word_model()).encode(texts)])
    bits = lambda x: 8 * sum(map(len, token_files.encode_blocks(x, 16)[0])) / len(x)
    assert bits(ids) < min(9.5, bits(np.random.default_rng(0).permutation(ids)))


def test_token_files(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    token_files.write_tokens(odd, str(tmp_path / "a"), queries.word_model())
    got = token_files.read_tokens(spark.read.parquet(str(tmp_path / "a"))).orderBy("start").collect()
    model, start = Tokenizer.from_file(queries.word_model()), 0
    for (i, t), r in zip(TEXTS, got, strict=True):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write_tokens(empty, str(tmp_path / "b"), queries.word_model())
    assert token_files.read_tokens(spark.read.schema(token_files.ROW).parquet(str(tmp_path / "b"))).count() == 0


def test_words_keep_control_characters():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.word_model())
    texts = ["a\x1cb", "one\x1f two", "\x1d", "a \x1e b\x00c", "a\x0b\x0c\x1cb\r\n", "été\x1cb", "a\x85b", "plain words", *[f"ab{chr(c)}cd {chr(c)} é{chr(c)}f" for c in range(128)]]
    found = token_files.Words(queries.word_model()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [model.encode(t, add_special_tokens=False).ids for t in texts]


PAGE = "<html><head><title>t</title></head><body><header>Site</header><nav><ul><li><a href=/>home</a></ul></nav>{notice}<article><h1>Title {i}</h1><p>First  &amp; {i}<p>Second<br>line &lt;b&gt;{share}<script>x='</p>'</script></article><aside>side {i}</aside><section class='post comments'><p>reader {i}</section><form>f</form><footer>&copy; {i}</footer>"


def test_models_that_change_texts_are_refused():
    pieces.Pieces(queries.piece_model())
    for normalize in (str.lower, str.strip, lambda t: pieces.MARK + t.strip().replace(" ", pieces.MARK)):
        with pytest.raises(ValueError, match="normaliser"):
            pieces.only_marks(normalize)


def test_token_files_order_of_repeated_keys(spark, tmp_path, monkeypatch):
    """Rows that share a key, or have none, come in the same order from any partitioning, and are dealt over parts."""
    monkeypatch.setattr(token_files, "TEXTS_PER_PART", 4)
    rows = [(7, f"text number {i % 9}") for i in range(30)] + [(None, "a b"), (None, None), (1, "c d"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "order": F.lit(2)})
    got = []
    for k in (1, 5):
        token_files.write_tokens(docs.repartition(k), f"{tmp_path}/{k}", queries.word_model())
        files = spark.read.parquet(f"{tmp_path}/{k}")
        assert files.select("part").distinct().count() > 3
        got.append([tuple(r) for r in token_files.read_tokens(files).orderBy("start").collect()])
    assert got[0] == got[1] and [r[0] for r in got[0]] == [None, None, 1, *[7] * 30, 9]


def test_html_wrapper(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(i=i, notice="<div class=cookie-notice>We use cookies</div>", share="<div>Share this story</div>")) for i in range(8)]
    rows += [(20, "https://one.example/", PAGE.format(i=20, notice="", share="")), (21, "https://one.example/x", None), (22, None, ""), (23, "not a url", "plain text &amp; more"), (24, "https://one.example/t", "<p>cut <b"), (25, "https://h.example/5", rows[5][2])]
    got = {r["page_id"]: r["text"] for r in html.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[3] == "Title 3 First & 3 Second line <b>" and got[25] == got[5]
    assert got[20] == "Title 20 First & 20 Second line <b>"
    assert (got[21], got[22], got[23], got[24]) == ("", "", "plain text & more", "cut")
    assert html.with_main_text(spark.createDataFrame([], "url string, html string")).count() == 0


NEUTRAL = "<html><body><div class=a><div class=b><p>Site name</p><div>All topics <b>and more</b></div></div></div><div class=c><h1>Title {i}</h1><p>Own words {i} of page {i}</p></div><div class=d><div><p>Made by us</p><p>since 1999</p></div></div>"


def test_html_induction_alone(spark):
    """Furniture without telling tags or names, some of it nested, goes by alignment only, whatever the order of pages."""
    rows = [(i, f"https://n.example/{i}", NEUTRAL.format(i=i)) for i in range(12)]
    assert html.main_text(rows[3][2], None) != "Title 3 Own words 3 of page 3"
    for order in (rows, rows[::-1]):
        got = {r["page_id"]: r["text"] for r in html.with_main_text(spark.createDataFrame(order, "page_id long, url string, html string")).collect()}
        assert got == {i: f"Title {i} Own words {i} of page {i}" for i in range(12)}


def test_html_two_pages_are_enough(spark):
    rows = [(i, f"https://two.example/{i}", NEUTRAL.format(i=i)) for i in range(2)] + [(7, "https://lone.example/", NEUTRAL.format(i=7))]
    got = {r["page_id"]: r["text"] for r in html.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Title 0 Own words 0 of page 0" and got[1] == "Title 1 Own words 1 of page 1" and "Site name" in got[7]


def test_html_varying_furniture_and_copies(spark):
    """Adverts and footers that vary lie outside the main slot; pages that are copies of one another keep their text; a page
    of another layout is judged without the wrapper; links and lists of them inside the article stay."""
    body = "<body><div class=x><p>Buy {i} now</p></div><div class=y><h1>Title {i}</h1><p>{words}</p><ul><li><a href=/r>Reference {i}</a></li></ul><div><a href=/s>Source {i}</a></div></div><div class=z>Made {i} times</div>"
    rows = [(i, f"https://v.example/{i}", body.format(i=i, words=f"word{i} " * 40)) for i in range(6)]
    rows += [(10 + i, f"https://c.example/{i}", body.format(i=1, words="the very same text " * 20).replace("Title 1", f"Title {i}")) for i in range(4)]
    rows += [(20, "https://v.example/other", "<body><table><tr><td>Another layout</td></tr></table>")]
    got = {r["page_id"]: r["text"] for r in html.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_host": F.lit(1), "_wrapper": F.lit(2), "_salt": F.lit(3), "wrapper": F.lit(4)})).collect()}
    for i in range(6):
        assert got[i] == f"Title {i} " + " ".join([f"word{i}"] * 40) + f" Reference {i} Source {i}"
    for i in range(4):
        assert f"Title {i} the very same text" in got[10 + i] and "Reference 1 Source 1" in got[10 + i]
    assert got[20] == "Another layout"


def test_html_without_lists(spark, folder, monkeypatch):
    """With the lists of tags and names emptied, the wrapper alone finds the text of at least nine pages in ten."""
    pages = common.table(spark, folder, "pages")
    whole = {r["page_id"]: r["text"] for r in html.with_main_text(pages).collect()}
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    host = lambda u: u.split("//", 1)[-1].split("/")[0].split("?")[0].split("#")[0].lower()
    for name in ("FURNITURE", "NAMES", "LANDMARKS"):
        monkeypatch.setattr(html, name, frozenset())
    html.kind_of.cache_clear()
    hosts = {}
    for _, u, source in rows:
        page = html.Page(source)
        own = {"t": page.tree()[0], "h": [page.heading()]}
        hosts[host(u)] = html.merge_hosts(hosts[host(u)], own) if host(u) in hosts else own
    sizes = Counter(host(u) for _, u, _ in rows)
    marks = {h: html.wrapper(x) for h, x in hosts.items()}
    alike = [whole[i] == html.main_text(source, marks[host(u)]) for i, u, source in rows if sizes[host(u)] > 1]
    html.kind_of.cache_clear()
    assert len(alike) > 10 and sum(alike) >= 0.9 * len(alike)


def test_html_long_lists_of_children():
    """Ten thousand children that alternate, of which some differ in the middle and at the end."""
    page = lambda n, odd: "<body><h1>T</h1>" + "".join(f"<p>a{i}</p><pre>b</pre>" + ("<dl><dt>x</dt></dl>" if i % 997 == odd else "") for i in range(n)) + f"<div class=e{'fg'[odd % 2]}>end</div>"
    began = time.time()
    host = None
    for n, odd in ((5_000, 3), (4_990, 500), (5_000, 8)):
        own = html.Page(page(n, odd))
        own = {"t": own.tree()[0], "h": [own.heading()]}
        host = own if host is None else html.merge_hosts(host, own)
    marks = html.wrapper(host)
    assert html.main_text(page(5_000, 3), marks).startswith("T a0 b a1 b")
    assert time.time() - began < 40
    assert host["t"]["n"] == 3 and sum(c["n"] for c in host["t"]["s"][0]["s"]) >= 3 * 9_000


def plain_matching(a, b):
    """Simple tree matching as it is written down, every pair of nodes by itself."""
    if a["k"] != b["k"]:
        return 0
    x, y = a["s"], b["s"]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain_matching(x[i - 1], y[j - 1]))
    return table[-1][-1] + 1


@pytest.mark.parametrize("cells", [2_048, 0])
def test_tree_matching_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html, "PLAIN_CELLS", cells)
    rng = np.random.default_rng(3)

    def tree(depth):
        return {"k": "abc"[int(rng.integers(0, 3 if depth < 3 else 2))], "m": False, "n": 1, "d": [0], "c": 0, "l": 0, "s": [tree(depth - 1) for _ in range(int(rng.integers(0, 7)))] if depth else []}

    def matched(a, b, found):
        return 1 + sum(matched(a["s"][i], b["s"][j], found) for i, j in found.pairs(a, b) if i is not None and j is not None)

    for _ in range(60):
        a, b = tree(3), tree(3)
        a["k"] = b["k"] = "root"
        found = html.Matching()
        assert found.score(found.shape(a), found.shape(b)) == plain_matching(a, b) == matched(a, b, found)
        size = lambda x: 1 + sum(map(size, x["s"]))
        want = size(a) + size(b) - plain_matching(a, b)
        assert size(html.merge(a, b)) == want


def test_html_deep_and_misnamed_pages(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000 + "<p>after"
    layout = "<div class='layout has-sidebar'><article class='post social-news'><p>Long article text that is most of the page</p></article><div class=sidebar>side</div></div>"
    rows = [(1, "https://d.example/", deep), (2, "https://e.example/", layout)]
    got = {r["page_id"]: r["text"] for r in html.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "deep text after", 2: "Long article text that is most of the page"}


def test_html_joined_by_host(spark, folder, monkeypatch):
    whole = {r["page_id"]: r["text"] for r in queries.op1_html_extraction(spark, folder).collect()}
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert {r["page_id"]: r["text"] for r in queries.op1_html_extraction(spark, folder).collect()} == whole
    assert all(whole.values())


def test_simple_tree_matching():
    leaf = lambda k, *s: {"k": k, "m": False, "n": 1, "d": [0], "c": 0, "l": 0, "s": list(s)}
    a, b = leaf("x", leaf("a"), leaf("b", leaf("c")), leaf("d")), leaf("x", leaf("b", leaf("c"), leaf("e")), leaf("d"))
    assert html.matching(a, b) == 4
    assert [c["k"] for c in html.merge(a, b)["s"]] == ["a", "b", "d"] and a["s"][1]["n"] == 2


def test_counts_are_whole(spark, folder):
    n = common.table(spark, folder, "documents").count()
    for q in (queries.op4_toxicity, queries.op8_ngram_jaccard, queries.op9_sentence_pieces):
        assert Counter(r["doc_id"] for r in q(spark, folder).select("doc_id").collect()).total() == n

