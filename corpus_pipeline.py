"""A training corpus from ``documents``: five stages, each one operator over all that the stage before it kept.

1. toxicity: documents that the classifier rejects go. 2. line dedup: later copies of three-line passages are cut out of
texts (n_chars follows). 3. n-gram Jaccard join: of each group of linked documents the smallest id stays.
4. decontamination: documents with a benchmark window go. 5. SentencePiece: piece counts and id digests of what is left.

Of a text that line dedup empties an empty row goes on, as a document of its own without shingles. Rows that share an id are
told apart by line dedup, and are one document to the two stages after it: what one of them is linked by, all are.

Null texts and texts without words pass the filters, as nothing speaks against them; null and empty texts have no pieces. SQL can't express the trained stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.storage import scratch
from tensorloom.llm import decontamination, line_dedup, ngram_jaccard, sentencepiece_codec, toxicity
from tensorloom.llm.graph import fresh
from tensorloom.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id ``ids`` does not have; null ids stay."""
    gone = fresh(docs, "_gone")
    return docs.join(ids.select(F.col("doc_id").alias(gone)), F.col("doc_id") == F.col(gone), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, ngram_jaccard.linked_documents(docs).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(docs, tokenizer("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
