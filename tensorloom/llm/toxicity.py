"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the set of its hashed words, word pairs and pairs with one word between, lower-cased, and a bias.
FTRL-proximal keeps a learning rate per coordinate; its L1 term leaves few weights other than zero, and those are what
executors get: sorted feature numbers and weights. The sample has at most ``SAMPLE`` labelled training rows with
``SAMPLE_BYTES`` of text; the features of so much come to the driver, 12 bytes a word.

Null and empty texts score by the bias alone. Words are runs of ASCII letters, digits and bytes from 0x80. Texts are whole;
repeated rows score alike; null ids are kept; without any labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm import text as tx
from tensorloom.llm.labelled import ROWS, featured, remainder, scored, training_rows

SAMPLE, SAMPLE_BYTES = 8192, 48 << 20
DIMENSIONS = 1 << 22
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 24.0, 0.0, 8
#: How many times a toxic row counts, as there are few of them.
TOXIC = 4.0


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts and the text of each, repeats included; 0 is the bias."""
    start, end = tx.spans(buf, offs, tx.ITEM_WORDS)
    h = tx.span_hashes(buf, start, end, tx.LOWER)
    doc = np.searchsorted(offs, start, "right") - 1
    parts, docs = [h], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        parts.append(tx.mix(h[:-gap] * np.uint64(2 * gap + 1) + tx.mix(h[gap:] + np.uint64(gap)))[same])
        docs.append(doc[gap:][same])
    n = len(offs) - 1
    at = 1 + np.concatenate(parts) % np.uint64(DIMENSIONS - 1)
    return np.concatenate([np.zeros(n, np.int64), at.astype(np.int64)]), np.concatenate([np.arange(n), *docs])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, buf, offs in tx.chunks(batches, "text", 4 << 20, ROWS):
        at, doc = features(buf, offs)
        key = np.unique(doc * DIMENSIONS + at)
        cut = np.searchsorted(key, np.arange(len(offs)) * DIMENSIONS)
        at = (key % DIMENSIONS).astype("<i4")
        yield featured(table, [at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights other than zero, from (label, feature numbers) rows taken in order."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weight(at: np.ndarray) -> np.ndarray:
        s = z[at]
        return np.where(np.abs(s) <= L1, 0.0, -(s - np.sign(s) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for y, at in rows:
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (TOXIC if y else 1.0)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    return at, weight(at)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of labels.toxic, from rows whose crc32(doc_id) mod 5 is not 0."""
    rows = training_rows(docs, labels, "toxic", lambda i: remainder(i, 5) != 0, sample, SAMPLE_BYTES, _sets)
    by = np.random.default_rng(7).permutation(rows.num_rows)
    label, sets = rows.column("label").to_numpy(), rows.column("x")
    return fit([(int(label[i]), np.frombuffer(sets[int(i)].as_buffer(), "<i4")) for i in by])


def scorer(model: tuple[np.ndarray, np.ndarray]):
    """A function from a chunk's bytes and offsets to scores."""
    numbers, weights = model

    def run(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        table = np.zeros(DIMENSIONS, np.bool_)
        table[numbers] = True
        at, doc = features(buf, offs)
        some = table[at]
        key = np.unique(doc[some] * DIMENSIONS + at[some])
        w = weights[np.searchsorted(numbers, key % DIMENSIONS)] if len(key) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(np.bincount(key // DIMENSIONS, w, len(offs) - 1), -35, 35)))

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    return scored(docs, scorer(model), remainder(F.col("doc_id"), 5) == 0)


def accepted(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5 or have no words, as nothing speaks against these; one map."""
    of = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, buf, offs in tx.chunks(batches, "text", 4 << 20, ROWS):
            n_words = np.diff(np.searchsorted(tx.spans(buf, offs, tx.ITEM_WORDS)[0], offs))
            stay = pa.array((of(buf, offs) < 0.5) | (n_words == 0))
            yield from table.filter(stay).to_batches()

    return docs.mapInArrow(run, docs.schema)
