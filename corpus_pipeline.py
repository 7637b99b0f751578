"""The corpus pipeline: documents to clean, deduplicated, encoded training text.

Part of the llm subpackage.  STAGES are (name, function) pairs; a function
takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs.  All but the last return the columns of documents.

1. language_id: documents whose language is not identified go.
2. line_dedup: lines that repeat an earlier line go, and documents that lose
   every line; n_chars is that of the text left.
3. near_dedup: of each near-duplicate group the smallest doc_id stays (shingles
   of five words, similarity 0.8).  Documents without a doc_id stay.
4. decontaminate: documents that hold a benchmark item go.
5. sentencepiece: the ids of each text, with their number and whether decoding
   gives the text back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqengine.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece_codec
from seqengine.llm.shared import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs).where("n_lines > n_removed")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_dedup.near_duplicates(docs, size=5, percent=80).where("kept").select("doc_id").distinct()
    named = docs.hint("merge").join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.unionAll(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encode_checked(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode),
]

#: Language identification and SentencePiece are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, name)
    return docs
