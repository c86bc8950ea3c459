"""What the two classifiers share: held-out rows, the bounded training sample, and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm import text as tx


#: Rows that are scored together, which bounds what short texts take.
ROWS = 2048


def featured(table: pa.Table, x: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("lid", "label", "tag")), pa.array(x, pa.binary())], names=["lid", "label", "tag", "x"])


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[Column], Column], rows: int, size: int, features: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> pa.Table:
    """(label, x): features of a sample of labelled training rows, the classifiers' only sample, in one order however rows arrive.

    Rows are chosen in order of a hash of the id (then id, label and a hash of the text): ``rows`` of them at most, and of
    those the ones that fit into ``size`` bytes of text together. Equal rows count once; other texts of one id each count.
    ``features`` maps (lid, label, tag, text) to (lid, label, tag, x binary).
    """
    spark, names = docs.sparkSession, ["lid", "label", "tag"]
    known = labels.select(F.col("doc_id").alias("lid"), F.col(label).cast("int").alias("label")).where(F.col("lid").isNotNull() & F.col("label").isNotNull() & train(F.col("lid"))).distinct()
    first = known.orderBy(F.xxhash64("lid"), "lid", "label").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    tagged = texts.join(F.broadcast(first), F.col("doc_id") == F.col("lid")).select("lid", "label", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tag"), "text")
    sized = tagged.select(*names, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).distinct()
    total, chosen = 0, []
    for r in sized.orderBy(F.xxhash64("lid"), *names).limit(rows).collect():  # at most ``rows`` short rows
        if total + r["size"] <= size:
            total += r["size"]
            chosen.append((r["lid"], r["label"], r["tag"]))
    kind = known.schema["lid"].dataType.simpleString()
    mine = F.broadcast(spark.createDataFrame(chosen, f"lid {kind}, label int, tag long"))
    made = tagged.join(mine, names, "left_semi").mapInArrow(features, f"lid {kind}, label int, tag long, x binary")
    return made.groupBy(*names).agg(F.first("x").alias("x")).orderBy(F.xxhash64("lid"), *names).select("label", "x").toArrow()


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``score`` maps a chunk's bytes and offsets to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, buf, offs in tx.chunks(batches, "text", 4 << 20, ROWS):
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(score(buf, offs), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
