"""Main text of web pages by wrapper induction over same-host DOM trees.

Each page becomes a small tree of its block elements, in which neighbouring siblings of one kind count as one repeated
node. The trees of a host are folded into a template by simple tree matching: aligned nodes are merged, counting pages
and noting whether their text is constant or varies. Every page takes part; tasks fold what they read, partial
templates are merged in two levels, so a host with a third of all pages only sends one small template for each task.

Wherever a host has pages of different headings, its template decides. Subtrees whose text is the same on most of the
pages that have their parent are template; the others are slots, and the slots are weighed over all pages of the host: the
smallest element that holds most of what varies (without links), and the headings with it, is the main slot. What is
outside it (varying adverts, footers, lists of links) is furniture, what is inside it is content. Each page is then aligned
to its host's wrapper. Where that says nothing (a host's only page, a page without the main slot, hosts without a slot that
stands out), elements that say by their tag, role or names that they are furniture are left out, and text in an article or
main element is preferred; inside a main slot the same names mark adverts and comments. Names never decide against the
element that holds most of a page's text with its article or heading.

Elements nested deeper than ``DEEPEST`` count as part of the one at that depth; their text is kept.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCKS = frozenset("html head body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption form fieldset address details summary dialog hr".split())
RAW = frozenset("script style noscript template iframe object svg math select textarea button title canvas audio video".split())
FURNITURE = frozenset("head nav footer aside form fieldset dialog".split())
#: Words in class, id or role that mark page furniture.
NAMES = frozenset(
    "nav navbar navigation menu header footer sidebar aside complementary contentinfo search ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments disqus respond reply replies toolbar widget copyright masthead".split()
)
LANDMARKS = frozenset(("article", "main"))
#: Open elements that a start tag of the key closes, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
#: Elements below this depth have no node of their own.
DEEPEST = 120
#: Share of a host's varying text that the main slot holds at least.
MAIN_SHARE = 0.75
#: Elements that are text, not containers of it.
TEXTS = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre caption figcaption".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
#: From so many children on, template nodes that match nothing are folded into the nearest one of their kind.
WIDE = 48
#: Tables of alignments with more cells than this are filled row by row in numpy.
PLAIN_CELLS = 2_048
#: Largest total of wrappers that is broadcast; beyond it they are joined by host.
BROADCAST_BYTES = 32 << 20
FOLD_SALTS, JOIN_SALTS = 256, 32

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S)
_attribute = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(4096)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)


@lru_cache(4096)
def kind_of(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A node's kind (element, id and classes without digits), and whether it is furniture by itself or by its names."""
    if not attributes.strip(" /"):
        return tag, tag in FURNITURE, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)}
    names = [found[k] for k in ("id", "class", "role") if found.get(k)]
    words = {w.lower() for name in names for w in _word.findall(name)}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    named = tag not in ("html", "body", "main") and not NAMES.isdisjoint(words)
    return " ".join([tag, *sorted(re.sub(r"\d+", "", " ".join(names)).split())]), tag in FURNITURE or hidden, named


class Page:
    """The block elements of a page in order, and its runs of text: (node, text, whether in a link)."""

    def __init__(self, source: str) -> None:
        self.tags, self.kinds, self.marked, self.parents = ["html"], ["html"], [False], [-1]
        self.runs: list[tuple[int, str, bool]] = []
        self.named: set[int] = set()
        stack, at, link = [0], 0, False
        below: list[str] = []  # open elements without a node
        while m := _tag.search(source, at):
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()], link)
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in RAW:
                if not m[1] and not m[3].endswith("/"):
                    end = _end_of(tag).search(source, at)
                    at = end.end() if end else len(source)
                self.runs.append((stack[-1], " ", False))
            elif tag not in BLOCKS:
                if tag == "a":
                    link = not m[1]
                elif tag == "br":
                    self.runs.append((stack[-1], " ", False))
            elif below and (m[1] or tag in BLOCKS):
                if not m[1]:
                    below.append(tag)
                elif tag in below:
                    del below[len(below) - 1 - below[::-1].index(tag) :]
                elif tag in ("article", "main", "body"):
                    below.clear()
                self.runs.append((stack[-1], " ", False))
            elif m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[i]] == tag:
                        del stack[i:]
                        break
                self.runs.append((stack[-1], " ", False))
            elif len(stack) >= DEEPEST and tag != "hr":
                below.append(tag)
                self.runs.append((stack[-1], " ", False))
            elif tag != "html":
                self._open(stack, tag, m[3])
        if at < len(source):
            self._text(stack[-1], source[at:], link)
        self._keep_largest()

    def _keep_largest(self) -> None:
        """Names don't mark what holds over half of the page's text, with its article or first heading if it has one."""
        if not self.named:
            return
        size, holds = [0] * len(self.tags), [t in LANDMARKS for t in self.tags]
        if not any(holds) and "h1" in self.tags:
            holds[self.tags.index("h1")] = True
        anywhere = any(holds)
        for node, text, _ in self.runs:
            size[node] += 0 if text.isspace() else len(text)
        for i in range(len(size) - 1, 0, -1):
            size[self.parents[i]] += size[i]
            holds[self.parents[i]] |= holds[i]
        for i in self.named:
            if 2 * size[i] > size[0] and (holds[i] or not anywhere):
                self.marked[i] = False

    def _text(self, node: int, text: str, link: bool) -> None:
        self.runs.append((node, entities.unescape(text) if "&" in text else text, link))

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        if self.tags[stack[-1]] == "p":
            stack.pop()
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if self.tags[stack[i]] in stops:
                    break
                if self.tags[stack[i]] in ends:
                    del stack[i:]
                    break
        kind, marked, named = kind_of(tag, attributes)
        if named and not marked:
            self.named.add(len(self.tags))
        marked |= named
        if tag == "header" and not any(self.tags[x] in LANDMARKS for x in stack):
            marked = True
        elif tag == "header" or re.search(r"\bheader\b|header$", kind) and any(self.tags[x] in LANDMARKS for x in stack):
            marked = False
        self.tags.append(tag)
        self.kinds.append(kind)
        self.marked.append(marked)
        self.parents.append(stack[-1])
        self.runs.append((stack[-1], " ", False))
        if tag != "hr":
            stack.append(len(self.tags) - 1)

    def tree(self) -> tuple[dict, list[dict]]:
        """The page as a template of one page, and the template node of each of its nodes. Template nodes: k kind,
        m marked, n pages, d digests of the text (two at most), c characters, l of those in links, s children."""
        own: list[list[str]] = [[] for _ in self.tags]
        links = [0] * len(self.tags)
        for node, text, link in self.runs:
            if not text.isspace():
                own[node].append(text)
                links[node] += len(text) * link
        nodes: list[dict] = []
        for i, kind in enumerate(self.kinds):
            digest, size = (zlib.crc32(" ".join(" ".join(own[i]).split()).encode("utf-8", "replace")), sum(map(len, own[i]))) if own[i] else (0, 0)
            above = nodes[self.parents[i]] if i else None
            if above and above["s"] and above["s"][-1]["k"] == kind:
                node = above["s"][-1]
                node["c"] += size
                node["l"] += links[i]
                node["d"] = [zlib.crc32(b"%d,%d" % (node["d"][0], digest))]
            else:
                node = {"k": kind, "m": self.marked[i], "n": 1, "d": [digest], "c": size, "l": links[i], "s": []}
                if above:
                    above["s"].append(node)
            nodes.append(node)
        return nodes[0], nodes

    def heading(self) -> int:
        """Digest of the first heading with text, else of the longest run."""
        texts = [t for node, t, _ in self.runs if self.tags[node] in ("h1", "h2") and not t.isspace()][:1] or [max((t for _, t, _ in self.runs), key=len, default="")]
        return zlib.crc32(texts[0].strip().encode("utf-8", "replace"))


class Matching:
    """Simple tree matching of two trees: the pairs of a largest order-preserving mapping, children of matched nodes to
    children of matched nodes, roots and pairs being of one kind.

    Subtrees of one shape match as a whole, so only different shapes are compared, each pair of shapes once, and children
    that begin or end alike are aligned without a table (no mapping can be larger: either of them can't match more nodes
    than it has). What is left of long lists of children is aligned row by row in numpy, in a few bits a cell.
    """

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.children: list[tuple[int, ...]] = []
        self.kinds: list[str] = []
        self.of: dict[int, int] = {}
        self.scores: dict[tuple[int, int], int] = {}

    def shape(self, node: dict) -> int:
        below = tuple(map(self.shape, node["s"]))
        key = node["k"], below
        if key not in self.shapes:
            self.shapes[key] = len(self.shapes)
            self.sizes.append(1 + sum(self.sizes[x] for x in below))
            self.children.append(below)
            self.kinds.append(node["k"])
        self.of[id(node)] = self.shapes[key]
        return self.shapes[key]

    def score(self, a: int, b: int) -> int:
        """Nodes that two shapes' trees match; 0 for roots of different kinds."""
        if a == b:
            return self.sizes[a]
        if self.kinds[a] != self.kinds[b]:
            return 0
        if not self.children[a] or not self.children[b]:
            return 1
        if (a, b) not in self.scores:
            self.scores[a, b] = 1 + self.aligned(self.children[a], self.children[b])[0]
        return self.scores[a, b]

    def aligned(self, x: tuple[int, ...], y: tuple[int, ...], told: bool = False) -> tuple[int, list[tuple[int, int]]]:
        """The score of two sequences of shapes, and (if ``told``) the places that are matched."""
        n, m = len(x), len(y)
        head = next((i for i in range(min(n, m)) if x[i] != y[i]), min(n, m))
        tail = next((i for i in range(min(n, m) - head) if x[n - 1 - i] != y[m - 1 - i]), min(n, m) - head)
        score, middle = self._table(x[head : n - tail], y[head : m - tail], told) if head + tail < min(n, m) else (0, [])
        score += sum(self.sizes[k] for k in (*x[:head], *x[n - tail :]))
        return score, [*((i, i) for i in range(head)), *((i + head, j + head) for i, j in middle), *((n - i, m - i) for i in range(tail, 0, -1))] if told else []

    def _table(self, x: tuple[int, ...], y: tuple[int, ...], told: bool) -> tuple[int, list[tuple[int, int]]]:
        if len(x) * len(y) <= PLAIN_CELLS:
            rows = [[0] * (len(y) + 1)]
            for a in x:
                last, now = rows[-1], [0]
                for j, b in enumerate(y):
                    now.append(max(last[j + 1], now[j], last[j] + self.score(a, b)))
                rows.append(now)
            return rows[-1][-1], self._back(x, y, lambda i, j: rows[i][j] > max(rows[i - 1][j], rows[i][j - 1]), lambda i, j: rows[i - 1][j] >= rows[i][j - 1]) if told else []
        others, at = np.unique(y, return_inverse=True)
        weights = {a: np.array([self.score(a, int(b)) for b in others], np.int32)[at] for a in set(x)}
        last, diagonal, up = np.zeros(len(y) + 1, np.int32), [], []
        for a in x:
            now = last.copy()
            now[1:] = np.maximum.accumulate(np.maximum(last[1:], last[:-1] + weights[a]))
            if told:
                diagonal.append(np.packbits(now[1:] > np.maximum(last[1:], now[:-1])))
                up.append(np.packbits(last[1:] >= now[:-1]))
            last = now
        bit = lambda rows, i, j: rows[i - 1][(j - 1) >> 3] >> (7 - (j - 1 & 7)) & 1
        return int(last[-1]), self._back(x, y, lambda i, j: bit(diagonal, i, j), lambda i, j: bit(up, i, j)) if told else []

    @staticmethod
    def _back(x, y, diagonal, up) -> list[tuple[int, int]]:
        out, i, j = [], len(x), len(y)
        while i and j:
            if diagonal(i, j):
                i, j = i - 1, j - 1
                out.append((i, j))
            elif up(i, j):
                i -= 1
            else:
                j -= 1
        return out[::-1]

    def pairs(self, a: dict, b: dict) -> list[tuple[int | None, int | None]]:
        """The children of two matched nodes in one order, side by side where they match. Both trees' shapes are known."""
        n, m = len(a["s"]), len(b["s"])
        both = self.aligned(*(tuple(self.of[id(c)] for c in x["s"]) for x in (a, b)), told=True)[1]
        out, i, j = [], 0, 0
        for p, q in [*both, (n, m)]:
            out += [*((k, None) for k in range(i, p)), *((None, k) for k in range(j, q))]
            if p < n and q < m:
                out.append((p, q))
            i, j = p + 1, q + 1
        return out


def matching(a: dict, b: dict) -> int:
    """How many nodes two trees match."""
    found = Matching()
    return found.score(found.shape(a), found.shape(b))


def summed(a: dict, b: dict, children: list[dict]) -> dict:
    a |= {"n": a["n"] + b["n"], "m": a["m"] or b["m"], "d": sorted({*a["d"], *b["d"]})[:2], "c": a["c"] + b["c"], "l": a["l"] + b["l"], "s": children}
    return a


def merge(a: dict, b: dict, found: Matching | None = None) -> dict:
    """``a`` with the pages of ``b`` folded in; both have roots of one kind."""
    if found is None:
        found = Matching()
        found.shape(a)
        found.shape(b)
    children: list[dict] = []
    alone: set[int] = set()
    for i, j in found.pairs(a, b):
        if i is not None and j is not None:
            children.append(merge(a["s"][i], b["s"][j], found))
        else:
            children.append(a["s"][i] if j is None else b["s"][j])
            alone.add(id(children[-1]))
    return summed(a, b, narrowed(children, alone) if len(children) > WIDE else children)


def narrowed(children: list[dict], alone: set[int]) -> list[dict]:
    """Children without a partner folded into the last one of their kind before them; the others stay."""
    kept: list[dict] = []
    last: dict[str, dict] = {}
    for c in children:
        if id(c) in alone and c["k"] in last:
            merge(last[c["k"]], c)
        else:
            kept.append(c)
            last[c["k"]] = c
    return kept


def merge_hosts(a: dict, b: dict) -> dict:
    """Two partial inductions of one host: its template t and digests h of different headings (two are enough)."""
    return {"t": merge(a["t"], b["t"]), "h": sorted({*a["h"], *b["h"]})[:2]}


def element(node: dict) -> str:
    return node["k"].split(" ")[0]


def weigh(node: dict, above: int, differ: bool) -> tuple[bool, bool]:
    """Adds to a template's nodes x (its whole text is constant over most of the pages that have its parent, as ``above``
    counts them), v (characters that vary, without links), w (those of headings). Returns whether the text below is
    constant, and whether there is any."""
    below = [weigh(c, node["n"], differ) for c in node["s"]]
    own = differ and node["n"] > 1 and 2 * node["n"] > above and len(node["d"]) == 1
    constant = own and all(same for same, _ in below)
    some = node["c"] > 0 or any(text for _, text in below)
    varies = 0 if own else max(0, node["c"] - node["l"])
    node["x"] = constant and some
    node["v"] = varies + sum(c["v"] for c in node["s"])
    node["w"] = varies * (element(node) in HEADINGS) + sum(c["w"] for c in node["s"])
    return constant, some


def main_slot(root: dict) -> list[dict]:
    """The nodes from the root down to the smallest container with ``MAIN_SHARE`` of what varies and most of the headings."""
    path = [root]
    while inner := [c for c in path[-1]["s"] if c["v"] >= MAIN_SHARE * root["v"] > 0 and 2 * c["w"] >= root["w"] and element(c) not in TEXTS]:
        path.append(inner[0])
    return path


def amount(node: dict) -> int:
    return node["c"] + sum(map(amount, node["s"]))


def fixed(node: dict) -> int:
    """Characters of constant subtrees."""
    return amount(node) if node["x"] else sum(map(fixed, node["s"]))


def wrapper(host: dict) -> dict:
    """The marks of a host's template nodes: k kind, x whether it is template, i whether it is (or leads to) the main slot,
    s children. Where most of what the main slot holds is constant, pages are copies of one another and nothing in it is
    template. Without a main slot, lists of links are template."""
    root = host["t"]
    weigh(root, root["n"], len(host["h"]) > 1)
    slots = main_slot(root)
    path, found = {id(x): k for k, x in enumerate(slots, 1)}, len(slots) > 1 and len(host["h"]) > 1
    copies = 2 * fixed(slots[-1]) > amount(slots[-1])

    def marks(node: dict, inside: bool) -> dict:
        at = path.get(id(node), 0)
        inside = inside or at == len(path)
        links = element(node) in ("ul", "ol", "li", "div", "section") and node["c"] > 0 and node["l"] > 0.7 * node["c"]
        template = not at and (found and not inside or node["x"] and not (inside and copies) or not found and links)
        return {"k": node["k"], "x": bool(template), "i": at if found else 0, "s": [marks(c, inside and found) for c in node["s"]]}

    return marks(root, False) | {"to": len(path) if found else 0}


def main_text(source: str | None, marks: dict | None) -> str:
    """The text in the content slots of a page, white space as single spaces. Null is empty."""
    if not source:
        return ""
    page = Page(source)
    tree, nodes = page.tree()
    template: set[int] = set()
    reached: dict[int, int] = {}
    if marks:
        found = Matching()
        found.shape(tree)
        found.shape(marks)

        def align(a: dict, b: dict) -> None:
            reached[id(a)] = b["i"]
            if b["x"]:
                template.add(id(a))
            for i, j in found.pairs(a, b):
                if i is not None and j is not None:
                    align(a["s"][i], b["s"][j])
                elif i is not None and b["i"] and b["i"] < marks["to"]:
                    template.add(id(a["s"][i]))  # beside the way to the main slot

        align(tree, marks)
        if marks["to"] and marks["to"] not in reached.values():
            template.clear()
            reached.clear()
    out, inside = [], []
    for i, node in enumerate(nodes):
        above = page.parents[i]
        out.append(page.marked[i] or id(node) in template or (i > 0 and out[above]))
        inside.append(page.tags[i] in LANDMARKS or (i > 0 and inside[above]))
    chosen = any(a and not b for a, b in zip(inside, out, strict=True))
    ways = {n for n, node in enumerate(nodes) if 0 < reached.get(id(node), 0) < marks["to"]} if marks else set()
    text = "".join(t if not out[n] and n not in ways and (inside[n] or not chosen) else " " for n, t, _ in page.runs)
    return " ".join(text.split())


def induce(pages: DataFrame, host: str, source: str) -> DataFrame:
    """(host, wrapper as JSON) for every host, from all of its pages."""

    def fold(batches):
        hosts: dict[str, dict] = {}

        def told():
            names = list(hosts)
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([json.dumps(hosts[x]) for x in names], pa.string())], ["host", "part"])
            hosts.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(text)
                own = {"t": page.tree()[0], "h": [page.heading()]}
                hosts[name] = merge_hosts(hosts[name], own) if name in hosts else own
            if len(hosts) > 10_000:
                yield told()
        yield told()

    def together(finish: bool):
        def run(group: pa.Table) -> pa.Table:
            whole = None
            for part in group["part"].to_pylist():
                whole = json.loads(part) if whole is None else merge_hosts(whole, json.loads(part))
            return pa.table({"host": [group["host"][0].as_py()], "part": [json.dumps(wrapper(whole) if finish else whole)]})

        return run

    parts = pages.where(F.col(source).isNotNull() & (F.length(source) > 0)).select(F.col(host).alias("host"), source).mapInArrow(fold, "host string, part string")
    parts = parts.withColumn("salt", F.spark_partition_id() % FOLD_SALTS).groupBy("host", "salt").applyInArrow(together(False), "host string, part string")
    return parts.groupBy("host").applyInArrow(together(True), "host string, part string").withColumnRenamed("part", "wrapper")


def with_main_text(pages: DataFrame, url: str = "url", source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each. Pages without html have an empty text; pages whose url has no host form a
    host of their own. A column already named ``out`` is replaced; columns _host, _wrapper and _salt are used here and
    dropped."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    pages = pages.drop("_wrapper", "_salt").withColumn("_host", host)
    wrappers = cut(induce(pages, "_host", source)).toDF("_host", "_wrapper")
    size = wrappers.agg(F.sum(F.length("_host") + F.length("_wrapper"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = pages.join(F.broadcast(wrappers), "_host", "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(url)), F.lit(JOIN_SALTS))
        spread = wrappers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
        found = pages.withColumn("_salt", salt).join(spread, ["_host", "_salt"], "left").drop("_salt")

    read: dict[str | None, dict | None] = {}

    @F.arrow_udf("string")
    def extract(sources: pa.Array, marks: pa.Array) -> pa.Array:
        if len(read) > 5_000:
            read.clear()
        names = marks.to_pylist()
        read.update((m, json.loads(m) if m else None) for m in set(names) - read.keys())
        return pa.array([main_text(s, read[m]) for s, m in zip(sources.to_pylist(), names, strict=True)], pa.string())

    return found.withColumn(out, extract(F.col(source), F.col("_wrapper"))).drop("_host", "_wrapper")
