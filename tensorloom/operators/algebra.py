"""Products, norms and fits of sparse tensors and their low-rank models.

A factor is a DataFrame (idx, u array<double>) of R columns. Factors are broadcast to the nonzeros only where their size
(rows x R) is below ``BROADCAST_CELLS``; larger ones are joined by shuffling. R x R algebra is done on the driver. What
takes R x R terms a row (Gram, row times matrix, quadratic form) is one expression up to ``SMALL_RANK`` columns; more of
them are matrix products over Arrow batches, as such long expressions cost more to compile than to compute.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.arrow import array, lists
from tensorloom.functions.draws import gaussian
from tensorloom.sources.tensors import Tensor

BROADCAST_CELLS = 2_000_000
CUTOFF = 1e-11
SMALL_RANK = 8


@contextmanager
def broadcasting(cells: int):
    """Plans made inside broadcast no factor of more numbers than this."""
    global BROADCAST_CELLS
    before, BROADCAST_CELLS = BROADCAST_CELLS, cells
    try:
        yield
    finally:
        BROADCAST_CELLS = before


def few(cells: int) -> bool:
    """Whether so many numbers may be on the driver and travel to every executor."""
    return cells <= BROADCAST_CELLS


@dataclass
class Kruskal:
    """A low-rank model: a factor for each mode and one weight per component.

    ``rows``: factors that the driver holds too, as matrices; only ones whose size was checked by ``few``.
    """

    factors: list[DataFrame]
    sigma: np.ndarray
    dims: list[int]
    rows: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def rank(self) -> int:
        return len(self.sigma)

    def put(self, mode: int, u: np.ndarray) -> None:
        """Replace a factor by rows that the driver holds."""
        self.factors[mode], self.rows[mode] = from_rows(self.factors[mode].sparkSession, u), u

    def hold(self) -> Kruskal:
        """Have the driver hold all factors that are small enough."""
        for k, n in enumerate(self.dims):
            if k not in self.rows and few(n * self.rank):
                self.put(k, on_driver(self.factors[k], n, self.rank))
        return self


def from_rows(spark: SparkSession, u: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"idx": pa.array(np.arange(len(u)), pa.int64()), "u": array(u)}))


def cosine_factor(spark: SparkSession, size: int, rank: int) -> DataFrame:
    """cos(idx*R + r): fixed entries; of rank 2 however many columns there are."""
    return spark.range(size).select(F.col("id").alias("idx"), F.array(*(F.cos((F.col("id") * rank + r).cast("double")) for r in range(rank))).alias("u"))


def gaussian_factor(spark: SparkSession, size: int, rank: int, mode: int, seed: int) -> DataFrame:
    return spark.range(size).select(F.col("id").alias("idx"), F.array(*(gaussian(seed, f"{mode}.{r}", F.col("id")) for r in range(rank))).alias("u"))


def zero_factor(spark: SparkSession, size: int, rank: int) -> DataFrame:
    return spark.range(size).select(F.col("id").alias("idx"), F.array(*[F.lit(0.0)] * rank).alias("u"))


def gram_parts(factor: DataFrame, rank: int, other: str | None = None) -> np.ndarray:
    """U'U (or U'W, of columns u and ``other``), summed in each partition first, so that R*R numbers of each are left."""
    w = other or "u"
    if rank > SMALL_RANK:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros((rank, rank))
            for batch in batches:
                g += lists(batch.column("u"), rank).T @ lists(batch.column(w), rank)
            yield pa.RecordBatch.from_pydict({"g": array(g.reshape(1, -1))})

        cells = factor.select(*dict.fromkeys(("u", w))).mapInArrow(run, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("x")).toArrow()
        g = np.zeros(rank * rank)
        g[cells.column("pos").to_numpy()] = cells.column("x").to_numpy()
        return g.reshape(rank, rank)
    cells = [(r, s) for r in range(rank) for s in range(0 if other else r, rank)]
    row = factor.agg(*(F.sum(F.col("u")[r] * F.col(w)[s]).alias(f"g{r}_{s}") for r, s in cells)).first()
    g = np.zeros((rank, rank))
    for r, s in cells:
        g[r, s] = row[f"g{r}_{s}"] or 0.0
        if not other:
            g[s, r] = g[r, s]
    return g


def gram(factor: DataFrame, rank: int) -> np.ndarray:
    return gram_parts(factor, rank)


def hadamard(grams: list[np.ndarray], without: int | None = None) -> np.ndarray:
    out = np.ones_like(grams[0])
    for k, g in enumerate(grams):
        if k != without:
            out = out * g
    return out


def pinv(m: np.ndarray, top: int | None = None, cutoff: float = CUTOFF) -> np.ndarray:
    """Pseudo-inverse of a symmetric matrix, over its ``top`` largest eigenvalues above an absolute cutoff."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    keep = w > cutoff
    keep[: len(w) - (top if top is not None else len(w))] = False
    return (v[:, keep] / w[keep]) @ v[:, keep].T


def times(factor: DataFrame, m: np.ndarray, column: str = "u") -> DataFrame:
    """Each row u replaced by u m."""
    if len(m) > SMALL_RANK:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"idx": batch.column("idx"), column: array(lists(batch.column(column), len(m)) @ m)})

        return factor.select("idx", column).mapInArrow(run, f"idx long, {column} array<double>")
    u = F.col(column)
    cols = [sum((u[s] * F.lit(float(m[s, r])) for s in range(1, m.shape[0])), u[0] * F.lit(float(m[0, r]))) for r in range(m.shape[1])]
    return factor.select("idx", F.array(*cols).alias(column))


def normalized(factor: DataFrame, rank: int) -> tuple[DataFrame, np.ndarray]:
    """Columns scaled to unit length, and their lengths; a zero column stays, with length 0."""
    row = factor.agg(*(F.sum(F.col("u")[r] * F.col("u")[r]).alias(f"n{r}") for r in range(rank))).first()
    size = np.sqrt(np.array([row[f"n{r}"] or 0.0 for r in range(rank)]))
    return divided(factor, size), size


def unit_columns(model: Kruskal) -> Kruskal:
    """The same model with factors of unit columns: what lengths they had goes into its weights."""
    made = [normalized(f, model.rank) for f in model.factors]
    return Kruskal([f for f, _ in made], model.sigma * np.prod([n for _, n in made], axis=0), model.dims)


def quadratic(factor: DataFrame, m: np.ndarray, name: str = "score") -> DataFrame:
    """(idx, u m u'): with m = pinv(U'U) the leverage scores."""
    rank, u = len(m), F.col("u")
    if rank > SMALL_RANK:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = lists(batch.column("u"), rank)
                yield pa.RecordBatch.from_pydict({"idx": batch.column("idx"), name: pa.array(((x @ m) * x).sum(1))})

        return factor.select("idx", "u").mapInArrow(run, f"idx long, {name} double")
    terms = [u[r] * u[s] * F.lit(float(m[r, s] * (1 if r == s else 2))) for r in range(rank) for s in range(r, rank)]
    return factor.select("idx", sum(terms[1:], terms[0]).alias(name))


def leverage(factor: DataFrame, rank: int, g: np.ndarray | None = None) -> DataFrame:
    """(idx, score) of each row; ``g``: the factor's Gram matrix, if it is known."""
    return quadratic(factor, pinv(gram(factor, rank) if g is None else g))


def divided(factor: DataFrame, size: np.ndarray) -> DataFrame:
    """Columns divided by ``size``, those of size 0 left as they are."""
    return factor.select("idx", F.array(*(F.col("u")[r] / F.lit(float(n or 1.0)) for r, n in enumerate(size))).alias("u"))


def on_driver(factor: DataFrame, size: int, rank: int) -> np.ndarray:
    """The rows of a factor whose size was checked to be below ``BROADCAST_CELLS``."""
    table, u = factor.select("idx", "u").toArrow(), np.zeros((size, rank))
    u[table.column("idx").to_numpy()] = lists(table.column("u"), rank)
    return u


def with_factors(df: DataFrame, factors: dict[int, tuple[DataFrame, int]], rank: int) -> DataFrame:
    """Joins factor k's row to rows with index column ik, as column u{k}; given each factor and its row count."""
    for k, (f, size) in factors.items():
        side = f.select(F.col("idx").alias(f"_x{k}"), F.col("u").alias(f"u{k}"))
        df = df.join(F.broadcast(side) if few(size * rank) else side, F.col(f"i{k}") == F.col(f"_x{k}")).drop(f"_x{k}")
    return df


def product(modes: list[int], r: int) -> Column:
    out = F.col(f"u{modes[0]}")[r]
    for k in modes[1:]:
        out = out * F.col(f"u{k}")[r]
    return out


def mttkrp(t: Tensor, factors: list[DataFrame], mode: int, rank: int) -> DataFrame:
    """(idx, u): row i of the matricised tensor times the Khatri-Rao product of the other factors; only rows with nonzeros."""
    others = [k for k in range(t.order) if k != mode]
    rows = with_factors(t.df, {k: (factors[k], t.dims[k]) for k in others}, rank)
    sums = rows.groupBy(F.col(f"i{mode}").alias("idx")).agg(*(F.sum(F.col("v") * product(others, r)).alias(f"m{r}") for r in range(rank)))
    return sums.select("idx", F.array(*(f"m{r}" for r in range(rank))).alias("u"))


def reconstructed(coords: DataFrame, model: Kruskal) -> DataFrame:
    """Adds vhat, the model's value, to rows of coordinates i0.. ; rows outside of the model go."""
    modes = list(range(len(model.dims)))
    if model.rank > SMALL_RANK and few(max(model.dims) * model.rank):
        return _looked_up(coords, model)
    factors, sigma = list(model.factors), model.sigma
    if model.rows:  # weights go into held rows, as numbers in a plan are compiled anew each time
        k = min(model.rows)
        factors[k], sigma = from_rows(factors[k].sparkSession, model.rows[k] * sigma), None
    rows = with_factors(coords, {k: (factors[k], model.dims[k]) for k in modes}, model.rank)
    terms = [product(modes, r) * (F.lit(1.0) if sigma is None else F.lit(float(sigma[r]))) for r in range(model.rank)]
    return rows.withColumn("vhat", sum(terms[1:], terms[0])).drop(*(f"u{k}" for k in modes))


def _looked_up(coords: DataFrame, model: Kruskal) -> DataFrame:
    """``reconstructed`` with factors that all travel to the executors, so that only coordinates leave the JVM."""
    rank, sigma, rows = model.rank, model.sigma, []
    for k, (f, n) in enumerate(zip(model.factors, model.dims, strict=True)):
        rows.append(model.rows[k] if k in model.rows else on_driver(f, n, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(f"i{k}").to_numpy(zero_copy_only=False) for k in range(len(rows))]
            inside = np.logical_and.reduce([(i >= 0) & (i < len(u)) for i, u in zip(at, rows, strict=True)])
            batch, product_ = batch.filter(pa.array(inside)), sigma
            for i, u in zip(at, rows, strict=True):
                product_ = product_ * u[i[inside].astype(np.int64)]
            yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | {"vhat": pa.array(product_.sum(1))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coords.schema.fields)
    return coords.mapInArrow(run, f"{schema}, vhat double")


def norm(t: Tensor) -> float:
    return float(np.sqrt(t.df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0))


def model_norm2(sigma: np.ndarray, grams: list[np.ndarray]) -> float:
    return float(sigma @ hadamard(grams) @ sigma)


def inner(a: Kruskal, b: Kruskal) -> float:
    """Inner product of two models of the same sizes and rank."""
    out = np.outer(a.sigma, b.sigma)
    for x, y in zip(a.factors, b.factors, strict=True):
        both = x.join(y.withColumnRenamed("u", "w"), "idx")
        out = out * gram_parts(both, a.rank, "w")
    return float(out.sum())


def residual2(t: Tensor, model: Kruskal, grams: list[np.ndarray]) -> float:
    """Squared distance of tensor and model, from the nonzeros alone; at least 0."""
    rows = reconstructed(t.df, model)
    part = rows.agg(F.sum(F.col("v") * F.col("v") - F.lit(2.0) * F.col("v") * F.col("vhat"))).first()[0] or 0.0
    return max(0.0, model_norm2(model.sigma, grams) + part)


def fit(t: Tensor, model: Kruskal, grams: list[np.ndarray] | None = None, size: float | None = None, inner_: float | None = None) -> float:
    """1 - |X - model| / |X|; ``size``: |X|, and ``inner_``: the inner product of both, where they are known."""
    grams = grams or [gram(f, model.rank) for f in model.factors]
    size = norm(t) if size is None else size
    rest = residual2(t, model, grams) if inner_ is None else max(0.0, model_norm2(model.sigma, grams) + size * size - 2.0 * inner_)
    return 1.0 - float(np.sqrt(rest)) / size


def krp(a: DataFrame, b: DataFrame, rank: int) -> DataFrame:
    """(i0, i1, u): elementwise products of all pairs of rows; what a Khatri-Rao product is, for small factors only.

    Products with tensors never make it; it is as many rows as both factors' rows multiplied.
    """
    pairs = a.select(F.col("idx").alias("i0"), F.col("u").alias("x")).crossJoin(b.select(F.col("idx").alias("i1"), F.col("u").alias("y")))
    return pairs.select("i0", "i1", F.array(*(F.col("x")[r] * F.col("y")[r] for r in range(rank))).alias("u"))


def matricized(t: Tensor, mode: int) -> DataFrame:
    """(row, col, v): the mode's index, and the others' as one number, last mode fastest."""
    col: Column = F.lit(0).cast("long")
    for k in (k for k in range(t.order) if k != mode):
        col = col * t.dims[k] + F.col(f"i{k}")
    return t.df.select(F.col(f"i{mode}").alias("row"), col.alias("col"), "v")


def mode_counts(t: Tensor, mode: int) -> DataFrame:
    """Nonzeros and their sum for each row of a mode."""
    return t.df.groupBy(F.col(f"i{mode}").alias("idx")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def estimated_fit(t: Tensor, model: Kruskal, draws: int, seed: int = 1) -> float:
    """The fit with the error on zeros estimated from uniform draws: those that hit nonzeros go by an exact anti-join."""
    from tensorloom.functions.draws import uniform

    spark = t.df.sparkSession
    coords = spark.range(draws).select(*(F.floor(uniform(seed, k, F.col("id")) * n).cast("long").alias(f"i{k}") for k, n in enumerate(t.dims)))
    zeros = coords.join(t.df.select(*t.indices()).distinct(), t.indices(), "left_anti")
    row = reconstructed(zeros, model).agg(F.count("*").alias("n"), F.sum(F.col("vhat") * F.col("vhat")).alias("e")).first()
    seen = reconstructed(t.df, model).agg(F.count("*").alias("n"), F.sum((F.col("v") - F.col("vhat")) ** 2).alias("e")).first()
    cells = float(np.prod([float(n) for n in t.dims]))
    rest = (row["e"] or 0.0) / max(1, row["n"]) * (cells - seen["n"])
    return 1.0 - float(np.sqrt((seen["e"] or 0.0) + rest)) / norm(t)
