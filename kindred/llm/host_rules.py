"""Quality rules of documents and of the hosts they come from, in DataFrame operations only.

Each document is measured by itself, in one pass over its whole text and without a shuffle. Failures of the rules are then
summed up by host (partial sums first, so a host with a third of all rows is no heavier than another), each rule's failure
rates are shrunk towards a beta prior that is estimated from all hosts, and the verdict on a host goes back to its documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attached, cut, digest

#: White space, a word, and the characters that count as symbols.
SPACES, WORD, SYMBOLS = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]+", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Symbols in 100 words, lines in 100 that repeat an earlier one, and characters of a mean word.
MOST_SYMBOLS, MOST_DUP_LINES, WORD_LENGTH = 10, 30, (3, 10)
#: A host is rejected if the shrunk rate of one rule exceeds this.
MOST_FAILING = 0.5
#: Bounds of the prior's strength, in documents; the upper one holds where hosts don't differ.
STRENGTH = (1.0, 1_000_000.0)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three that the array holds twice or more.

    Windows are compared by 64-bit hashes (two of a text of a million words fall together with a chance of 3e-8). Only
    where some repeat are they sorted with their places; then equal neighbours repeat, and each of their places counts once.
    """
    n = F.size(words)
    windows = F.slice(F.arrays_zip(words, F.slice(words, F.lit(2), n), F.slice(words, F.lit(3), n)), F.lit(1), F.greatest(n - 2, F.lit(0)))

    def covered(hashes: Column) -> Column:
        def places(pairs: Column) -> Column:
            same = lambda x, j: (j >= 0) & (F.get(pairs, j)["h"] == x["h"])
            repeat = F.filter(pairs, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(repeat, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, places))

    return let(F.transform(windows, lambda w: F.xxhash64(w)), covered)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` (long) and n_lines, the lines with a word. A null text has no words.
    Columns of these names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    # Two steps: arrays that several measures need are made once, as Spark keeps a column that is named more than once.
    docs = docs.withColumns({"_words": F.regexp_extract_all(whole, F.lit(f"({WORD})")), "_lines": lines})
    found = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate(whole, SPACES, "")),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_lines": F.size("_lines"),
    }
    return docs.withColumns({k: v.cast("long") for k, v in found.items()}).drop("_words", "_lines")


def failures() -> dict[str, Column]:
    """The rules, each true where a measured document fails it."""
    c, (short, long) = F.col, WORD_LENGTH
    return {
        "base": (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > MOST_REPEATED * c("n_words")),
        "symbols": 100 * c("n_symbols") > MOST_SYMBOLS * c("n_words"),
        "lines": 100 * c("n_dup_lines") > MOST_DUP_LINES * c("n_lines"),
        "word_length": (c("word_chars") < short * c("n_words")) | (c("word_chars") > long * c("n_words")),
    }


def host_rates(docs: DataFrame, host: str) -> DataFrame:
    """(host, n, and each rule's number of failures) of measured documents; those without a host are left out."""
    return docs.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), *[F.count_if(v).alias(k) for k, v in failures().items()])


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(mean, strength) of each rule's beta prior, by moments over the hosts.

    The mean is the rate of all documents. The variance of the hosts' rates, less what chance adds at their sizes, gives
    the strength mean * (1 - mean) / variance - 1, within ``STRENGTH``. Without hosts there are no priors.
    """
    rules = list(failures())
    sums = [F.count("*").alias("hosts"), F.sum("n").alias("n"), F.avg(1 / F.col("n")).alias("chance")]
    sums += [x for k in rules for x in (F.sum(k).alias(k), F.var_samp(F.col(k) / F.col("n")).alias(f"{k}_v"))]
    all_ = hosts.agg(*sums).first()
    found = {}
    for k in rules if all_["n"] else ():
        m = all_[k] / all_["n"]
        spread = (all_[f"{k}_v"] or 0.0) - m * (1 - m) * all_["chance"]
        found[k] = m, min(max(m * (1 - m) / spread - 1, STRENGTH[0]), STRENGTH[1]) if spread > 0 else STRENGTH[1]
    return found


def with_host_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document with its measures (``MEASURES``), base_failed, host_rejected and kept.

    base_failed: too few words, or too many in repeated windows. host_rejected: of its host's documents more than
    ``MOST_FAILING`` fail one rule, by the shrunk rate (failures + mean * strength) / (n + strength). kept: neither. A
    document without a host is judged alone; empty and null texts fail the base rule; repeated rows are judged as rows of
    their own; an empty table gives an empty result. Of ``keep``, names of columns that are added here are replaced.
    """
    rules, added = failures(), [*MEASURES, "n_lines", "base_failed", "host_rejected", "kept", "_host", "_key", "_copies"]
    own = [F.col(k) for k in keep if k not in added]
    rows = measured(docs.select(*own, F.col(host).cast("string").alias("_host"), F.col(text).alias("_text")), "_text").drop("_text")
    rows = cut(rows.withColumn("_key", digest("_host")))
    hosts = cut(host_rates(rows, "_host"))
    shrunk = [(F.col(k) + m * s) / (F.col("n") + s) > MOST_FAILING for k, (m, s) in priors(hosts).items()]
    rejected = reduce(Column.__or__, shrunk, F.lit(False))
    facts = hosts.select(digest("_host").alias("_key"), F.col("n").alias("_copies"), rejected.alias("host_rejected"))
    judged = attached(rows.where("_host is not null"), facts, rows.count()).unionByName(rows.where("_host is null").withColumn("host_rejected", F.lit(False)))
    judged = judged.withColumn("base_failed", rules["base"])
    return judged.select(*own, *MEASURES, "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))
