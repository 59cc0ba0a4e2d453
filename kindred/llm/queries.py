"""The registered queries of this subpackage, one per operator, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, shared_folder, table
from .host_rules import MEASURES, with_host_rules
from .html import with_main_text
from .jaccard import near_duplicates
from .language import train_language_id, with_language
from .mixing import mixed
from .neighbours import nearest
from .pieces import with_pieces
from .resampling import resampled
from .sharding import sharded_documents
from .topk import exact_top_k
from .token_files import read_tokens, write_tokens
from .toxicity import train_toxicity, with_toxicity
from .vector_blocks import finite
from .vector_codes import codebooks_sha256, vector_codes


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, and its length in code points."""
    pages = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Domains are made of the sources' numbers; values without a weight weigh 1.
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"web": 0.4, "books": 0.3, "code": 0.2, "news": 0.1}, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}}


def domain_of(source: str = "source") -> Column:
    number = F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999")) % 4
    return F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "code").otherwise("news")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and with how many tokens of one more epoch, each document is taken for 80 % of the corpus' tokens
    at the weights of ``MIX_WEIGHTS``, over two epochs at most."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain_of())
    return mixed(docs, MIX_LEVELS, share=0.8, epochs=2, weights=MIX_WEIGHTS)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows of largest integer inner product for every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & finite("embedding"))
    weights = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * 256))
    return exact_top_k(rows.select(F.col("vec_id").alias("id"), weights.alias("v"), (F.col("vec_id") % 50 == 0).alias("query")), 5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = with_toxicity(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted, "evidence")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and crc32 of every document's ids, read back from the files they were written to."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder, word_model())
    return read_tokens(spark.read.parquet(folder)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards of equal row counts, equal texts together where the quotas allow."""
    return sharded_documents(table(spark, sf_dir, "documents"), 8)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product for every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & finite("embedding"))
    rows = rows.where(F.exists("embedding", lambda x: x != 0))
    return nearest(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("vec_id") % 20 == 0).alias("query")), 20)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 85 % similar sets of 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def word_model() -> str:
    """The word BPE vocabulary of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    """The SentencePiece model of the public tokenizers package; it is read where it is installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 3 best segmentations: pieces of the best, scores, crc32 of each one's ids, and whether all of
    them decode to the text."""
    docs = with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return docs.select("doc_id", "pieces.n_pieces", "pieces.scores", "pieces.crcs", "pieces.exact")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train_language_id(docs.where(~held_out()))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether it and its source pass the quality rules."""
    return with_host_rules(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "host_rejected", "kept")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight for the texts of ``benchmark``, its score, and its rank among the 25 % that are drawn."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by four codebooks of 256 entries, the errors they leave, and a digest of the codebooks."""
    rows = table(spark, sf_dir, "embeddings").where(finite("embedding"))
    codes, books = vector_codes(rows.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mixing": op2_mixing,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_sharding": op6_sharding,
    "op7_nearest": op7_nearest,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_language_id": op10_language_id,
    "op11_host_rules": op11_host_rules,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
}

def vector_codes_sql(entries: int = 256, rounds: int = 4) -> str:
    """A chain of rounds, in SQL: a is what each part is assigned to (the least of distance and index), b a codebook."""
    apart = "cast(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    steps = [f"""
        with v as (
            select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as w from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        x as (select r, vec_id, label, p, w[p * len(w) // 4 + 1 : (p + 1) * len(w) // 4] as v from v, (select unnest(range(4)) as p)),
        b0 as (select p, e, v from (select p, v, row_number() over (partition by p order by vec_id) - 1 as e from x) where e < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"a{k} as (select r, p, min(d * {entries} + e) as best from (select x.r, x.p, b.e, {apart} as d from x join b{k} b on x.p = b.p) group by r, p)")
        steps.append(f"""n{k + 1} as (
            select p, e, list(m order by i) as v from (
                select p, e, i, cast(floor(sum(c) / count(*)) as bigint) as m from (
                    select x.p, best % {entries} as e, unnest(x.v) as c, unnest(range(len(x.v))) as i from x join a{k} a on x.r = a.r and x.p = a.p) group by p, e, i) group by p, e)""")
        steps.append(f"b{k + 1} as (select b.p, b.e, coalesce(n.v, b.v) as v from b{k} b left join n{k + 1} n on b.p = n.p and b.e = n.e)")
    steps.append(f"""c as (
            select v.vec_id, v.label, string_agg(lpad(lower(to_hex(best % {entries})), 2, '0'), '' order by p) as code, cast(sum(best // {entries}) as bigint) as error from a{rounds} a join v on v.r = a.r group by v.r, v.vec_id, v.label)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
            (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from b{rounds}) as codebooks_sha256 from c""")
    return ", ".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as w
            from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda x: coalesce(x[1] * x[2], 0))), 0) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op7_nearest": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(x as double)) as w from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op11_host_rules": """
        with d as (select doc_id, source, coalesce(text, '') as x from documents),
        w as (select doc_id, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') as w from d),
        windows as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as win from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
        again as (select doc_id, i from windows qualify count(*) over (partition by doc_id, win) >= 2),
        repeats as (select doc_id, count(distinct i + j) as n from again, (select unnest([0, 1, 2]) as j) group by doc_id),
        lines as (select doc_id, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as l from d),
        m as (
            select d.doc_id, d.source, len(w.w) as n_words, length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) as n_symbols,
                len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(l) as n_lines from d join w using (doc_id) join lines using (doc_id) left join repeats using (doc_id)),
        f as (
            select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 100 * n_symbols > 10 * n_words as f2, 100 * n_dup_lines > 30 * n_lines as f3, word_chars < 3 * n_words or word_chars > 10 * n_words as f4 from m),
        h as (
            select source, rule, count(*) as n, count(*) filter (failed) as k from (select source, unnest([1, 2, 3, 4]) as rule, unnest([base_failed, f2, f3, f4]) as failed from f where source is not null) group by source, rule),
        p as (select rule, sum(k)::double / sum(n) as m, avg(1.0::double / n) as chance, coalesce(var_samp(k::double / n), 0.0) as v from h group by rule),
        s as (select rule, m, case when v - m * (1 - m) * chance > 0 then least(greatest(m * (1 - m) / (v - m * (1 - m) * chance) - 1, 1.0), 1000000.0) else 1000000.0 end as s from p),
        r as (select source, bool_or((k + m * s) / (n + s) > 0.5) as host_rejected from h join s using (rule) group by source)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(host_rejected, false) as host_rejected, not base_failed and not coalesce(host_rejected, false) as kept
        from f left join r using (source)""",
    "op13_vector_codes": vector_codes_sql(),
}
