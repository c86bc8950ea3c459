"""Approximate nearest neighbours (largest inner product): hierarchical k-means tree, best-bin-first, calibrated recall.

The tree is fitted on a bounded sample (by a hash of the id: ``SAMPLE`` vectors, or ``PER_LEAF`` for each leaf, of which
there are one for ``LEAF`` rows and ``MOST_LEAVES`` at most); every row is then dealt to a leaf. A
query walks the tree with a priority queue ordered by its inner product with the nodes' centres and visits leaves in
that order. How many: ``CALIBRATION`` rows are searched by brute force over all rows, and visits widen until their true
neighbours are found with ``TARGET`` recall; a query goes on until its leaves hold more rows than it asks for. Query and leaf meet in groups of at most about ``PART`` rows: leaves that
hold more (one common vector, say) are dealt into parts by a hash of the id, and each query goes to all parts.

Vectors that are null, zero, or hold null or non-finite components take no part; neither do rows with null ids. Vectors of
different lengths have no inner product: each length that occurs is searched by itself. A row is no candidate of queries of its own id. Ties go to the smaller id; repeated rows
each count. Scores are double-precision inner products of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, CALIBRATION, TARGET = 16384, 256, 0.95
BRANCH, LEAF, MOST_LEAVES, PER_LEAF, PART = 8, 1000, 4096, 16, 4096


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    """The part of each row, of at most k parts by Euclidean distance."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    part = np.zeros(len(x), int)
    for _ in range(steps):
        part = (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        for c in range(len(centres)):
            if (mine := part == c).any():
                centres[c] = x[mine].mean(0)
    return part


def fit(x: np.ndarray, leaves: int) -> dict:
    """Tree arrays: centres, first child and number of children of each node (0: leaf), and leaves' numbers."""
    rng, centres, child, count = np.random.default_rng(5), [x.mean(0)], [0], [0]
    open_ = [(-len(x), 0, np.arange(len(x)))]
    n_leaves = 1
    while open_ and n_leaves < leaves:  # the largest leaf splits next
        size, node, rows = heapq.heappop(open_)
        if -size < 2 * BRANCH:
            break
        part = kmeans(x[rows], BRANCH, rng)
        kinds = np.unique(part)
        if len(kinds) < 2:
            continue
        child[node], count[node] = len(centres), len(kinds)
        for c in kinds:
            mine = rows[part == c]
            heapq.heappush(open_, (-len(mine), len(centres), mine))
            centres.append(x[mine].mean(0))
            child.append(0)
            count.append(0)
        n_leaves += len(kinds) - 1
    count = np.array(count)
    return {"centres": np.array(centres), "child": np.array(child), "count": count, "leaf": np.where(count == 0, np.cumsum(count == 0) - 1, -1)}


def assign(x: np.ndarray, tree: dict) -> np.ndarray:
    """The leaf of each row: from the root to the nearest child."""
    centres, child, count = tree["centres"], tree["child"], tree["count"]
    half = (centres * centres).sum(1) / 2
    node = np.zeros(len(x), np.int64)
    while (inner := np.flatnonzero(count[node] > 0)).size:
        best, at = np.full(len(inner), -np.inf), np.zeros(len(inner), np.int64)
        for k in range(BRANCH):
            c = child[node[inner]] + k
            ok = k < count[node[inner]]
            c = np.where(ok, c, 0)
            near = np.where(ok, np.einsum("ij,ij->i", x[inner], centres[c]) - half[c], -np.inf)
            at, best = np.where(near > best, c, at), np.maximum(near, best)
        node[inner] = at
    return tree["leaf"][node]


def visits(q: np.ndarray, tree: dict, most: int, held: np.ndarray, least: int) -> list[list[int]]:
    """The first ``most`` leaves of each query, best bin first, and more until they hold ``least`` rows (``held``: rows by leaf)."""
    child, count, leaf = tree["child"], tree["count"], tree["leaf"]
    out = []
    for near in q @ tree["centres"].T:
        queue, got, rows = [(-near[0], 0)], [], 0
        while queue and (len(got) < most or rows < least):
            node = heapq.heappop(queue)[1]
            if count[node]:
                for c in range(child[node], child[node] + count[node]):
                    heapq.heappush(queue, (-near[c], c))
            else:
                got.append(int(leaf[node]))
                rows += held[got[-1]]
        out.append(got)
    return out


def top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row, score) of each query's k best rows of other ids."""
    rough = q @ x.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    out: list[tuple] = []
    cut = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
    for i in range(len(q)):
        # scores again pair by pair, so that equal vectors score alike and ties go by id
        near = np.flatnonzero((rough[i] > -np.inf) & (rough[i] >= cut[i] - 1e-9 * abs(cut[i]) - 1e-300))
        s = (x[near] * q[i]).sum(1)
        order = np.lexsort((ids[near], -s))[:k]
        out.append((np.full(len(order), i), near[order], s[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    slim = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return slim.where(fine)


FOUND = "query_id long, vec_id long, score double"
#: Candidates of a block of queries in one row, for the way from a leaf to the merge in the same task.
PACKED = "query_ids binary, vec_ids binary, scores binary"
#: Candidates that a task holds at once before it hands on the best of them.
HELD = 1 << 20


def cut(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, in order."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], ids[best], s[best]


def found_batch(q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def cut_in_task(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Candidates of one task, cut to the k best of each query as far as ``HELD`` of them show."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n > HELD:
            held = [cut(*map(np.concatenate, zip(*held, strict=True)), k)]
            n = len(held[0][0])
            if n > HELD // 2:
                yield found_batch(*held[0])
                held, n = [], 0
    if held:
        yield found_batch(*cut(*map(np.concatenate, zip(*held, strict=True)), k))


def brute(rows: DataFrame, q: np.ndarray, q_ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the exact k best of all rows for a bounded set of queries; a partition keeps its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for at in range(0, batch.num_rows, PART):
                    part = batch.slice(at, PART)
                    ids = part.column(0).to_numpy()
                    i, j, s = top(q, q_ids, matrix(part.column(1)), ids, k)
                    yield q_ids[i.astype(int)], ids[j.astype(int)], s.astype(float)

        yield from cut_in_task(parts(), k)

    return _best(rows.mapInArrow(run, FOUND), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query; Spark cuts to k in every partition before it shuffles."""
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of all other rows, for rows where ``is_query(id)`` holds."""
    every = valid(rows, id_col, vector_col)
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect():  # a row for each length that occurs
        out = out.union(_search(every.where(F.size("v") == r["d"]), r["count"], is_query, k, target))
    return out


def _search(every: DataFrame, n: int, is_query, k: int, target: float) -> DataFrame:
    """``search`` of n vectors of one length."""
    leaves = max(1, min(MOST_LEAVES, n // LEAF))
    sample = every.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, leaves * PER_LEAF)).toArrow()
    x = matrix(sample.column("v"))
    tree = fit(x, leaves)
    n_leaves = int((tree["count"] == 0).sum())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(assign(matrix(batch.column(1)), tree), pa.int32())], names=["id", "v", "leaf"])

    placed = every.mapInArrow(dealt, "id long, v array<double>, leaf int")
    # calibration: where in each query's order of leaves do its true neighbours lie?
    test, test_ids = x[:CALIBRATION], sample.column("id").to_numpy()[:CALIBRATION]
    held = np.zeros(n_leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row for each leaf
        held[r["leaf"]] = r["count"]
    truth = brute(every, test, test_ids, k).join(placed.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").collect()
    place = {int(i): {leaf: r for r, leaf in enumerate(v)} for i, v in zip(test_ids, visits(test, tree, n_leaves, held, 0), strict=True)}
    ranks = np.sort([place[r["query_id"]][r["leaf"]] for r in truth])
    most = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1 if len(ranks) else n_leaves
    parts = -(-held // PART)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                to = [(i, leaf, p) for i, v in enumerate(visits(matrix(part.column(1)), tree, most, held, k + 1)) for leaf in v for p in range(parts[leaf])]
                i, leaf, p = (pa.array(c) for c in zip(*to, strict=True)) if to else (pa.array([], pa.int64()),) * 3
                took = part.take(i.cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), leaf.cast(pa.int32()), p.cast(pa.int32()), pa.array([True] * len(i), pa.bool_())], names=["id", "v", "leaf", "part", "asks"])

    asked = every.where(is_query(F.col("id"))).mapInArrow(walk, "id long, v array<double>, leaf int, part int, asks boolean")
    of = F.element_at(F.lit(parts.tolist()), F.col("leaf") + 1)
    rows = placed.select("id", "v", "leaf", F.pmod(F.xxhash64("id"), of).cast("int").alias("part"), F.lit(False).alias("asks"))

    def meet(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, v = table.column("id").to_numpy(), matrix(table.column("v"))
        q, x, qi, xi = v[asks], v[~asks], ids[asks], ids[~asks]
        out = []
        for at in range(0, len(q), 512):
            i, j, scores = top(q[at : at + 512], qi[at : at + 512], x, xi, k)
            out.append((qi[at : at + 512][i.astype(int)].tobytes(), xi[j.astype(int)].tobytes(), scores.astype(float).tobytes()))
        return pa.table([pa.array(c, pa.binary()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["query_ids", "vec_ids", "scores"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from cut_in_task(((np.frombuffer(i, np.int64), np.frombuffer(j, np.int64), np.frombuffer(s, np.float64)) for i, j, s in rows), k)

    # a task's leaves are merged before they are shuffled by query
    return _best(rows.unionByName(asked).groupBy("leaf", "part").applyInArrow(meet, PACKED).mapInArrow(merged, FOUND), k)
