"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import line_dedup, mixing, ngram_join, quality_bayes, sentencepiece_bpe
from panelforge.llm.tables import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_bayes.classify_quality(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; so do documents of which nothing is left."""
    done = line_dedup.dedup_lines(docs)
    left = done.where((F.col("n_deleted") == 0) | F.rlike("text", F.lit(line_dedup.WORD)))
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the least id."""
    return ngram_join.one_of_each_group(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have, in expectation, the target shares of sources, languages and topics, as far as they have so many."""
    return mixing.mix_sources(docs).where("sampled").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the sums that show that they decode."""
    import public_tokenizers

    return sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [("quality", quality), ("line_dedup", dedup_lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("encoding", encode)]

#: Learned models, alignment and sub-word encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
