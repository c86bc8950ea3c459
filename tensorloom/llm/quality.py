"""Quality: nearest-neighbour voting among labelled latent-semantic vectors.

A text is counted as hashed words and hashed runs of four character classes (upper, lower, digit, blank, newline; other
ASCII stands for itself), plus how often a word follows itself. Logged, weighted and projected by a truncated SVD of
the labelled sample, it becomes a short unit vector. The sample's vectors and labels are broadcast; each text's cosines
with all of them come from blocked matrix products, and the nearest ``NEIGHBOURS`` vote by similarity.

The sample has at most ``SAMPLE`` labelled training rows with ``SAMPLE_BYTES`` of text; that bounds the broadcast (about 2
MB). Weights and projection are part of the fit, so they come from the sample too. Null and empty texts have no vector and
score the sample's mean label; without any labels every score is 0.5. Rows are scored alone and whole, ``ROWS`` at a time,
so rows that share an id or are equal each get the score of their own text; rows with a null id are scored and not held
out. Of neighbours of one similarity (to six digits) those that come first in the sample vote. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm import text as tx
from tensorloom.llm.labelled import featured, remainder, scored, training_rows

SAMPLE, SAMPLE_BYTES = 4096, 64 << 20
SHAPES, WORDS, REPEATS = 2048, 1024, 8
WIDTH = SHAPES + WORDS + REPEATS
LATENT, NEIGHBOURS, SHARPNESS = 48, 15, 4
CLASSES = np.arange(256, dtype=np.uint64)
CLASSES[48:58], CLASSES[65:91], CLASSES[97:123], CLASSES[128:] = 200, 201, 202, 202


def counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Logged counts of each text's hashed features, as dense float32 rows relative to its length."""
    n = len(offs) - 1
    out = np.zeros((n, WIDTH), np.float32)
    size = np.diff(offs)
    # a text at a time, in pieces of a megabyte, so that no array is as long as the chunk times eight
    for i in np.flatnonzero(size):
        for at in range(int(offs[i]), int(offs[i + 1]), tx.SEGMENT):
            c = CLASSES[buf[at : min(int(offs[i + 1]), at + tx.SEGMENT + 3)]]
            if len(c) > 3:
                h = ((c[:-3] << np.uint64(24) | c[1:-2] << np.uint64(16) | c[2:-1] << np.uint64(8) | c[3:]) * np.uint64(tx.BYTE_BASE)) >> np.uint64(53)
                out[i, :SHAPES] += np.bincount(h.view(np.int64), minlength=SHAPES)[:SHAPES]
    start, end = tx.spans(buf, offs, tx.WORDS)
    h = tx.span_hashes(buf, start, end, tx.LOWER)
    doc = np.searchsorted(offs, start, "right") - 1
    out[:, SHAPES : SHAPES + WORDS] = np.bincount(doc * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(h) else np.zeros(n)
    out[:, :SHAPES] *= (1000 / np.maximum(size, 1))[:, None]
    out[:, SHAPES : SHAPES + WORDS] *= (50 / words)[:, None]
    out[:, SHAPES + WORDS :] = (100 * again / words)[:, None]
    return np.log1p(out, out=out)


def latent(rows: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of counted texts; zero for a text without features."""
    v = (rows * weights.astype(np.float64)) @ basis.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, buf, offs in tx.chunks(batches, "text", 1 << 20, 512):
        yield featured(table, [r.tobytes() for r in counts(buf, offs).astype(np.float16)])


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights, basis, vectors and labels of a sample, by randomised subspace iteration."""
    seen = (x > 0).mean(0)
    weights = np.log((1 + 1) / (seen + 0.02)).clip(0.1).astype(np.float32)
    a = x * weights
    q = np.random.default_rng(11).standard_normal((a.shape[1], min(LATENT + 8, *a.shape))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    basis = (q @ vt[:LATENT].T).astype(np.float32)
    return {"weights": weights, "basis": basis, "vectors": latent(x, weights, basis), "labels": y.astype(np.float32), "prior": float(y.mean())}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model of labels.quality, from rows whose crc32(doc_id) mod 3 is not 1; None without any."""
    rows = training_rows(docs, labels, "quality", lambda i: remainder(i, 3) != 1, sample, SAMPLE_BYTES, _rows)
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(rows.num_rows, -1)
    return fit(x.astype(np.float32), rows.column("label").to_numpy())


def vote(model: dict, x: np.ndarray) -> np.ndarray:
    """Similarity-weighted mean label of each counted text's nearest labelled vectors."""
    out = np.empty(len(x))
    k = min(NEIGHBOURS, len(model["labels"]))
    for at in range(0, len(x), 512):
        v = latent(x[at : at + 512], model["weights"], model["basis"])
        cosine = v @ model["vectors"].T
        # by cosine to six digits, then by place in the sample, so that no rounding of a product decides who votes
        order = -np.round(cosine * 1e6).astype(np.int64) * cosine.shape[1] + np.arange(cosine.shape[1])
        near = np.argpartition(order, k - 1, axis=1)[:, :k]
        w = np.clip(np.take_along_axis(cosine, near, 1), 0, 1).astype(float) ** SHARPNESS
        total = w.sum(1)
        out[at : at + 512] = np.where(total > 0, (w * model["labels"][near]).sum(1) / np.maximum(total, 1e-12), model["prior"])
    return out


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""

    def run(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return vote(model, counts(buf, offs)) if model else np.full(len(offs) - 1, 0.5)

    return scored(docs, run, remainder(F.col("doc_id"), 3) == 1)
