"""A training-data pipeline over ``documents``; each stage is written as Parquet and reread by the next."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.checkpoints import remove
from kindred.llm.common import blocks_of, give_back, held_out, shared_folder, table
from kindred.llm.jaccard import near_duplicates
from kindred.llm.language import UNDETERMINED, train_language_id, with_language
from kindred.llm.mixing import mixed
from kindred.llm.pieces import with_pieces
from kindred.llm.queries import MIX_LEVELS, MIX_WEIGHTS, domain_of, piece_model
from kindred.llm.toxicity import train_toxicity, with_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

TOXIC_FROM = 0.5
#: Languages less certain than this are rejected, as are texts without a letter.
CERTAIN_FROM = 0.5
#: Near duplicates: words in a shingle and least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Tokens that the mixture keeps, as a share of those that reach it.
MIX_SHARE = 0.8
#: A file that a stage writes has the documents that are left of so many, at least.
DOCUMENTS_PER_FILE = 2_000


def few_files(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """``kept``, in no more partitions than ``docs`` is large enough for; many small files would cost more than they hold.
    What the driver needed to make ``kept`` goes back to the system before it runs."""
    gc.collect()
    give_back()
    return kept.coalesce(blocks_of(docs.count(), DOCUMENTS_PER_FILE))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = with_toxicity(docs, train_toxicity(docs, labels), out="_score", evidence="_evidence")
    return few_files(scored.where(F.col("_score") < TOXIC_FROM).select(COLUMNS), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    model = train_language_id(docs.where(~held_out()))
    known = (F.col("_lang") != UNDETERMINED) & (F.col("_score") >= CERTAIN_FROM)
    return few_files(with_language(docs, model, out="_lang", score="_score").where(known).select(COLUMNS), docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component; rows without an id stay, as they can't be named. Of rows that
    share an id, one of each text stays if its component's smallest id is theirs."""
    found = near_duplicates(docs, words=WORDS, percent=PERCENT).where("id = component_id")
    kept = docs.join(found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("_rows")), "doc_id")
    once = kept.where("_rows = 1").select(COLUMNS)
    repeated = kept.where("_rows > 1").groupBy("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_text")).agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return few_files(once.unionByName(repeated).unionByName(docs.where("doc_id is null").select(COLUMNS)), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, in whole or in part; rows without an id are never taken."""
    taken = mixed(docs.withColumn("domain", domain_of()), MIX_LEVELS, share=MIX_SHARE, epochs=1, weights=MIX_WEIGHTS)
    return few_files(docs.join(taken.select("doc_id"), "doc_id", "left_semi").select(COLUMNS), docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentations of the documents that are left."""
    return few_files(with_pieces(docs, piece_model()), docs).select("doc_id", "lang", "source", "pieces.n_pieces", "pieces.scores", "pieces.crcs", "pieces.exact")


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("language", language), ("near duplicates", near_duplicate), ("mixing", mixing), ("pieces", pieces)]

#: Learned models, searches and segmentations can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again, and goes when the
    next one has read it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
