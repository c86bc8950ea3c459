"""Leverage samplers of Khatri-Rao rows: independent per mode (``ProductSampler``) or exact (``TreeSampler``).

A sample table has sample_id, an index column for each mode but the one being solved, and the weight 1/(J p).
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tensorloom.functions.arrow import array, lists
from tensorloom.functions.draws import uniform
from tensorloom.functions.storage import checkpointed
from tensorloom.operators.algebra import few, gram, hadamard, leverage, on_driver, pinv, with_factors

#: Rows of a mode that one window of running sums takes, beyond 256 windows.
BIN_ROWS = 1 << 20


@dataclass
class Running:
    """Running sums of a mode's scores: ``rows`` (idx, score, bin, hi), each bin's start, and the total."""

    rows: DataFrame
    starts: np.ndarray
    total: float


def cumulative(scores: DataFrame, size: int, bins: int = 256) -> Running:
    """Running sums in order of idx, below ``size``, by bins of idx.

    Bins are summed first and each row adds its bin's start, so no window spans the whole mode. Bins follow its size.
    """
    bins = max(bins, -(-size // BIN_ROWS))
    width = max(1, -(-size // bins))
    rows = scores.withColumn("bin", F.floor(F.col("idx") / width).cast("int"))
    mass = np.zeros(bins)
    for r in rows.groupBy("bin").agg(F.sum("score").alias("mass")).collect():  # at most ``bins`` rows
        mass[r["bin"]] = r["mass"]
    ends = np.cumsum(mass)
    starts = np.r_[0.0, ends[:-1]]
    run = F.col("start") + F.sum("score").over(Window.partitionBy("bin").orderBy("idx"))
    out = rows.withColumn("start", F.element_at(F.lit(starts.tolist()), F.col("bin") + 1)).withColumn("hi", run)
    return Running(out.select("idx", "score", "bin", "hi"), starts, float(ends[-1]))


def inverse_cdf(draws: DataFrame, cdf: Running) -> DataFrame:
    """(sample_id, idx, p): for each draw (sample_id, u in [0, 1)) the row where the running score first exceeds u of the total.

    An as-of lookup: draws and running sums of one bin are put in order together, and each draw takes the next row's idx.
    """
    starts, total = cdf.starts, cdf.total

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("u").to_numpy() * total
            # of bins that start at one place, all but the last are empty
            yield pa.RecordBatch.from_pydict({"sample_id": batch.column("sample_id"), "at": pa.array(at), "bin": pa.array(np.searchsorted(starts, at, "right") - 1, pa.int32())})

    aimed = draws.select("sample_id", "u").mapInArrow(aim, "sample_id long, at double, bin int")
    rows = cdf.rows.where("score > 0").select("bin", F.col("hi").alias("at"), F.lit(1).alias("kind"), "idx", "score", F.lit(None).cast("long").alias("sample_id"))
    both = rows.unionByName(aimed.withColumns({"kind": F.lit(0), "idx": F.lit(None).cast("long"), "score": F.lit(None).cast("double")}))
    # backwards, as a frame that only grows takes one pass: rows whose running sum is above the aim come before it
    by_bin = Window.partitionBy("bin")
    later = by_bin.orderBy(F.desc("at"), "kind", F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.col("kind") == 1, F.struct("idx", "score")), ignorenulls=True).over(later)
    # where rounding leaves none above the aim: the bin's last row
    last = F.max_by(F.when(F.col("kind") == 1, F.struct("idx", "score")), F.when(F.col("kind") == 1, F.struct("at", "idx"))).over(by_bin)
    found = both.withColumn("near", F.coalesce(near, last)).where("kind = 0")
    return found.select("sample_id", F.col("near.idx").alias("idx"), (F.col("near.score") / F.lit(total)).alias("p"))


class Sampler(ABC):
    """Draws rows of the Khatri-Rao product of all factors but one."""

    def __init__(self, factors: list[DataFrame], dims: list[int], rank: int, rows: dict[int, np.ndarray] | None = None):
        self.factors, self.dims, self.rank, self.rows = list(factors), dims, rank, {}
        for k, f in enumerate(factors):
            self.refresh(k, f, (rows or {}).get(k))

    def refresh(self, mode: int, factor: DataFrame, u: np.ndarray | None = None) -> None:
        """Take a new factor of ``mode``; ``u``: its rows, if the driver holds them."""
        self.factors[mode] = factor
        self.rows.pop(mode, None)
        if few(self.dims[mode] * self.rank):
            self.rows[mode] = on_driver(factor, self.dims[mode], self.rank) if u is None else u
        self._prepare(mode)

    @abstractmethod
    def _prepare(self, mode: int) -> None:
        """What draws need of a mode's new factor."""

    @abstractmethod
    def draw(self, count: int, mode: int, seed: int) -> DataFrame:
        """(sample_id, i_k of every other mode, w)."""


class ProductSampler(Sampler):
    """Each mode's rows by their own leverage, independently; p is the product.

    Scores of modes whose factors are below ``BROADCAST_CELLS`` travel to the executors as running sums, and one map makes
    all their draws. Of larger modes, running sums are a checkpointed table that draws meet by bins.
    """

    def _prepare(self, mode: int) -> None:
        if not hasattr(self, "near"):
            self.near, self.far = {}, {}
        if mode in self.rows:
            u = self.rows[mode]
            self.near[mode] = ((u @ pinv(u.T @ u)) * u).sum(1).clip(0)
        else:
            cdf = cumulative(checkpointed(leverage(self.factors[mode], self.rank)), self.dims[mode])
            self.far[mode] = Running(checkpointed(cdf.rows), cdf.starts, cdf.total)

    def draw(self, count: int, mode: int, seed: int) -> DataFrame:
        spark, others = self.factors[0].sparkSession, [k for k in range(len(self.dims)) if k != mode]
        near, far = {k: (p, np.cumsum(p)) for k, p in self.near.items() if k != mode}, [k for k in others if k in self.far]

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, lw = {c: batch.column(c) for c in ("sample_id", *(f"u{k}" for k in far))}, np.full(batch.num_rows, -np.log(count))
                for k, (p, hi) in near.items():
                    last = int(np.flatnonzero(p > 0)[-1])
                    at = np.searchsorted(hi, batch.column(f"u{k}").to_numpy() * hi[-1], "right").clip(0, last)
                    out[f"i{k}"], lw = pa.array(at, pa.int64()), lw - np.log(p[at] / hi[-1])
                yield pa.RecordBatch.from_pydict(out | {"lw": pa.array(lw)})

        draws = spark.range(count).select(F.col("id").alias("sample_id"), *(uniform(seed, k, F.col("id")).alias(f"u{k}") for k in others))
        out = draws.mapInArrow(look, ", ".join(["sample_id long", *(f"u{k} double" for k in far), *(f"i{k} long" for k in near), "lw double"]))
        for k in far:
            one = inverse_cdf(draws.select("sample_id", F.col(f"u{k}").alias("u")), self.far[k]).select("sample_id", F.col("idx").alias(f"i{k}"), "p")
            out = out.join(one, "sample_id").withColumn("lw", F.col("lw") - F.log("p")).drop("p")
        return out.select("sample_id", *(f"i{k}" for k in others), F.exp("lw").alias("w"))


def block_grams(factor: DataFrame, rank: int, width: int) -> DataFrame:
    """(item, g): the Gram matrix, row by row, of every block of ``width`` consecutive rows that has any."""
    many = max(1, BLOCK_CELLS // (width * rank))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = key[0].as_py() * many
        u = np.zeros((many * width, rank))
        u[table.column("idx").to_numpy() - first * width] = lists(table.column("u"), rank)
        u = u.reshape(many, width, rank)
        g = np.matmul(u.transpose(0, 2, 1), u).reshape(many, -1)
        some = np.flatnonzero(g.any(1))
        return pa.table({"item": pa.array(first + some, pa.int64()), "g": array(g[some])})

    return factor.select("idx", "u", F.floor(F.col("idx") / (width * many)).alias("part")).groupBy("part").applyInArrow(run, "item long, g array<double>")


def halved(leaves: DataFrame, rank: int) -> list[np.ndarray]:
    """The binary tree over leaf Grams (item, g), which the driver holds: level 0 is the root."""
    table = leaves.toArrow()
    at = table.column("item").to_numpy()
    level = np.zeros((1 << int(at.max(initial=0)).bit_length(), rank, rank))
    level[at] = lists(table.column("g"), rank * rank).reshape(-1, rank, rank)
    return upwards(level)


def upwards(level: np.ndarray) -> list[np.ndarray]:
    """The levels of a binary tree over leaves, whose number is a power of two, from the root on."""
    levels = [level]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0][0::2] + levels[0][1::2])
    return levels


def gram_tree(factor: DataFrame, rank: int, leaf: int | None = None) -> list[np.ndarray]:
    """Gram matrices of leaf blocks of rows and of pairs of blocks, up to the root: level 0 is the root."""
    return halved(block_grams(factor, rank, leaf or rank), rank)


#: Numbers in a group of factor rows that one task takes, and in the leaves of a tree on the driver or below one node.
BLOCK_CELLS, TREE_CELLS = 1 << 20, 1 << 20
#: Samples that meet a node's children in one task.
MEET = 8192


class TreeSampler(Sampler):
    """Rows by the exact leverage of the whole product: mode by mode, an eigenvector of what is left, then down a tree of Grams.

    The top of each mode's tree, of a bounded size, is on the driver and travels to the executors, and so do the rows of
    factors below ``BROADCAST_CELLS``. Larger factors stay distributed: each of their tree's lower levels is a table of
    blocks' Grams, the lowest are the rows, and samples meet the children of their node by a shuffle on the node. Only
    nodes that samples have reached are shuffled; of many samples at one node, ``MEET`` come to a task.
    """

    def _prepare(self, mode: int) -> None:
        if not hasattr(self, "trees"):
            self.trees, self.blocks, self.widths, self.below = {}, {}, {}, {}
        n, rank, self.below[mode] = self.dims[mode], self.rank, []
        if mode in self.rows:
            leaves = 1 << max(0, -(-n // rank) - 1).bit_length()
            u = self.blocks[mode] = np.zeros((leaves * rank, rank))
            u[:n] = self.rows[mode]
            by_block = u.reshape(leaves, rank, rank)
            self.trees[mode], self.widths[mode] = upwards(np.matmul(by_block.transpose(0, 2, 1), by_block)), [rank]
            return
        factor, self.blocks[mode] = self.factors[mode], None
        fan = self.fan()
        widths = [rank]
        if -(-n // rank) > fan:
            widths = [min(max(rank, BLOCK_CELLS // rank), -(-n // fan))]
            while -(-n // widths[-1]) > fan:
                widths.append(widths[-1] * fan)
        level = block_grams(factor, rank, widths[0])
        for _ in widths[1:]:
            level = checkpointed(level)
            self.below[mode].append(level)
            level = summed(level, rank, fan)
        self.trees[mode], self.widths[mode] = halved(level, rank), widths

    def fan(self) -> int:
        return max(2, TREE_CELLS // (self.rank * self.rank))

    def draw(self, count: int, mode: int, seed: int) -> DataFrame:
        spark, others, rank = self.factors[0].sparkSession, [k for k in range(len(self.dims)) if k != mode], self.rank
        grams = {k: self.trees[k][0][0] for k in range(len(self.dims))}
        p = pinv(hadamard(list(grams.values()), mode), cutoff=1e-8)
        total = float((p * hadamard(list(grams.values()), mode)).sum())
        after, vectors = p, {}
        for k in reversed(others):  # P times the Grams of the modes still to come, as scaled eigenvectors
            w, v = np.linalg.eigh(after)
            vectors[k] = v * np.sqrt(np.clip(w, 0, None))
            after = after * grams[k]
        draws = (uniform(seed, f"{mode}.{k}{x}", F.col("id")).alias(f"{x}{k}") for k in others for x in "ab")
        state = spark.range(count).select(F.col("id").alias("sample_id"), *draws, F.array(*[F.lit(1.0)] * rank).alias("h"))
        waiting: list[int] = []
        for k in others:
            waiting.append(k)
            if self.blocks[k] is None:
                state = self._walk(state, waiting, vectors)
                state = self._down(state, k, count)
                waiting = []
        out = self._walk(state, waiting, vectors) if waiting else state
        names = ["sample_id", *(f"i{k}" for k in others)]

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = lists(batch.column("h"), rank)
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {"w": pa.array(total / count / ((h @ p) * h).sum(1))})

        return out.mapInArrow(weigh, ", ".join(f"{c} long" for c in names) + ", w double")

    def _walk(self, state: DataFrame, modes: list[int], vectors: dict[int, np.ndarray]) -> DataFrame:
        """Each mode's row by its tree; for a distributed last one, the node reached (node), what is left to go (aim) and the query (q)."""
        rank = self.rank
        trees = {k: (self.trees[k], [np.einsum("nrr->n", g) > 0 for g in self.trees[k]]) for k in modes}
        rows, widths = {k: self.blocks[k] for k in modes}, {k: self.widths[k][-1] for k in modes}
        have = [c for c in state.columns if c not in ("h", *(f"{x}{k}" for k in modes for x in "ab"))]
        piece = max(1, (4 << 20) // (rank * max(rank, *(widths[k] for k in modes if rows[k] is not None), 1)))
        open_ = rows[modes[-1]] is None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, h = batch.column("sample_id").to_numpy(), lists(batch.column("h"), rank)
            out = {c: batch.column(c) for c in have}
            for k in modes:
                a, b = batch.column(f"a{k}").to_numpy(), batch.column(f"b{k}").to_numpy()
                levels, some = trees[k]
                he = h[:, :, None] * vectors[k][None]
                mass = (he * np.matmul(levels[0][0], he)).sum(1).clip(0)
                pick = (np.cumsum(mass, 1) < a[:, None] * mass.sum(1, keepdims=True)).sum(1).clip(0, rank - 1)
                q = np.take_along_axis(he, pick[:, None, None], 2)[:, :, 0]
                node, aim = np.zeros(len(ids), np.int64), b * np.einsum("ir,rs,is->i", q, levels[0][0], q)
                for level, any_ in zip(levels[1:], some[1:], strict=True):
                    left = np.matmul(q[:, None], np.matmul(level[2 * node], q[:, :, None])).ravel().clip(0)
                    right = (aim >= left) & any_[2 * node + 1]  # rounding may point past the last row
                    aim, node = np.where(right, aim - left, aim), 2 * node + right
                if rows[k] is None:
                    out |= {"q": array(q), "node": pa.array(node), "aim": pa.array(aim)}
                    break
                block = node[:, None] * widths[k] + np.arange(widths[k])
                at = chosen(np.matmul(rows[k][block], q[:, :, None])[:, :, 0] ** 2, aim)
                idx = block[np.arange(len(ids)), at]
                h = h * rows[k][idx]
                out[f"i{k}"] = pa.array(idx, pa.int64())
            return pa.RecordBatch.from_pydict(out | {"h": array(h)})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, piece):
                    yield step(batch.slice(at, piece))

        kinds = [f"{c} {dict(state.dtypes)[c]}" for c in have] + [f"i{k} long" for k in modes if rows[k] is not None] + (["q array<double>", "node long", "aim double"] if open_ else [])
        return state.mapInArrow(run, ", ".join([*kinds, "h array<double>"]))

    def _down(self, state: DataFrame, k: int, count: int) -> DataFrame:
        """From the driver's leaf through the distributed levels of mode k to a row."""
        fan = self.fan()
        for level in reversed(self.below[k]):
            state = self._meet(state, level.select(F.floor(F.col("item") / fan).alias("node"), "item", F.col("g").alias("x")), count, None)
        rows = self.factors[k].select(F.floor(F.col("idx") / self.widths[k][0]).alias("node"), F.col("idx").alias("item"), F.col("u").alias("x"))
        return self._meet(state, rows, count, f"i{k}")

    def _meet(self, state: DataFrame, children: DataFrame, count: int, final: str | None) -> DataFrame:
        """Each sample's choice among its node's children; ``final``: these are rows, and this is the name of their index."""
        rank = self.rank
        by_node = Window.partitionBy("node").orderBy("sample_id")
        state = checkpointed(state.withColumn("turn", F.floor((F.row_number().over(by_node) - 1) / MEET)))
        keys = state.select(F.col("node").alias("at"), F.col("turn").alias("part")).distinct()
        near = children.join(F.broadcast(keys) if few(count) else keys, F.col("node") == F.col("at")).select("at", "part", "item", "x")
        kept = [c for c in state.columns if c not in ("h", "q", "node", "aim", "turn")]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            item = right.column("item").to_numpy()
            order = np.argsort(item)
            item, x = item[order], lists(right.column("x"), rank if final else rank * rank)[order]
            q, aim, h = lists(left.column("q"), rank), left.column("aim").to_numpy(), lists(left.column("h"), rank)
            at, rest = np.zeros(len(q), np.int64), np.zeros(len(q))
            step = max(1, (4 << 20) // max(len(item), rank * rank))
            for a in range(0, len(q), step):
                part = q[a : a + step]
                mass = (part @ x.T) ** 2 if final else ((part[:, :, None] * part[:, None, :]).reshape(len(part), -1) @ x.T).clip(0)
                at[a : a + step] = pick = chosen(mass, aim[a : a + step])
                before = np.cumsum(mass, 1) - mass
                rest[a : a + step] = aim[a : a + step] - before[np.arange(len(part)), pick]
            out = {c: left.column(c) for c in kept}
            if final:
                return pa.table(out | {final: pa.array(item[at], pa.int64()), "h": array(h * x[at])})
            return pa.table(out | {"q": array(q), "node": pa.array(item[at], pa.int64()), "aim": pa.array(rest.clip(0)), "h": array(h)})

        kinds = [f"{c} {dict(state.dtypes)[c]}" for c in kept] + ([f"{final} long"] if final else ["q array<double>", "node long", "aim double"]) + ["h array<double>"]
        return state.groupBy("node", "turn").cogroup(near.groupBy("at", "part")).applyInArrow(run, ", ".join(kinds))


def summed(grams: DataFrame, rank: int, fan: int) -> DataFrame:
    """Gram matrices of every ``fan`` consecutive blocks, from those of the blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"item": pa.array([key[0].as_py()], pa.int64()), "g": array(lists(table.column("g"), rank * rank).sum(0, keepdims=True))})

    return grams.groupBy(F.floor(F.col("item") / fan).alias("up")).applyInArrow(run, "item long, g array<double>")


def chosen(mass: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """In each row the first column whose running sum is above ``aim``; the last with any mass if rounding leaves none."""
    last = mass.shape[1] - 1 - (mass[:, ::-1] > 0).argmax(1)
    return np.minimum((np.cumsum(mass, 1) <= aim[:, None]).sum(1), last)


def distinct_samples(samples: DataFrame, others: list[str]) -> DataFrame:
    """One row for each sampled row of the product, its weight times how often it was drawn."""
    return samples.groupBy(*others).agg((F.first("w") * F.count("*")).alias("w"))


def design(samples: DataFrame, factors: list[DataFrame], dims: list[int], mode: int, rank: int) -> DataFrame:
    """Adds h, the sampled row of the Khatri-Rao product, to distinct samples."""
    others = [k for k in range(len(dims)) if k != mode]
    rows = with_factors(samples, {k: (factors[k], dims[k]) for k in others}, rank)
    cols = [F.aggregate(F.array(*(F.col(f"u{k}")[r] for k in others)), F.lit(1.0), lambda a, x: a * x) for r in range(rank)]
    return rows.withColumn("h", F.array(*cols)).drop(*(f"u{k}" for k in others))


def sampled_mttkrp(nonzeros: DataFrame, rows: DataFrame, mode: int, others: list[str], rank: int, dims: list[int], draws: int, met: Observation | None = None) -> DataFrame:
    """(idx, u): sums of w v h over nonzeros whose other coordinates were sampled.

    ``draws`` bounds the number of rows; they travel to the nonzeros where that is few enough. Coordinates are joined as one
    number where that holds them, which hashes several times faster. ``met`` gets the number of nonzeros met.
    """
    rows = F.broadcast(rows) if few(draws * (rank + len(others) + 1)) else rows
    if math.prod(dims[int(c[1:])] for c in others) < 1 << 62:
        one = F.lit(0).cast("long")
        for c in others:
            one = one * dims[int(c[1:])] + F.col(c)
        nonzeros, rows, others = nonzeros.withColumn("_at", one), rows.withColumn("_at", one).drop(*others), ["_at"]
    hit = nonzeros.join(rows, others)
    if met is not None:
        hit = hit.observe(met, F.count(F.lit(1)).alias("nonzeros"))
    sums = hit.groupBy(F.col(f"i{mode}").alias("idx")).agg(*(F.sum(F.col("w") * F.col("v") * F.col("h")[r]).alias(f"m{r}") for r in range(rank)))
    return sums.select("idx", F.array(*(f"m{r}" for r in range(rank))).alias("u"))


def held_design(samples: DataFrame, others: list[str], rows: list[np.ndarray]) -> tuple[DataFrame, np.ndarray]:
    """``design`` of ``distinct_samples`` where the driver holds the other factors and samples are few, and ``sampled_gram``."""
    table = samples.toArrow()
    at, once, n = np.unique(np.stack([table.column(c).to_numpy() for c in others]), axis=1, return_index=True, return_counts=True)
    w, h = table.column("w").to_numpy()[once] * n, np.ones((len(n), rows[0].shape[1]))
    for u, i in zip(rows, at, strict=True):
        h = h * u[i]
    local = pa.table({c: pa.array(i, pa.int64()) for c, i in zip(others, at, strict=True)} | {"w": pa.array(w), "h": array(h)})
    return samples.sparkSession.createDataFrame(local), (h * w[:, None]).T @ h


def sampled_gram(rows: DataFrame, rank: int) -> np.ndarray:
    """H' diag(w) H of the distinct samples."""
    return gram(rows.select(F.transform("h", lambda x: x * F.sqrt("w")).alias("u")), rank)
