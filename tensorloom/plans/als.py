"""Alternating least squares: exact, or on sampled rows of the Khatri-Rao product.

Factors below a checked size are solved on the driver, which holds them between steps; a step is then one pass over the
nonzeros. Larger ones are solved where they are and checkpointed in the cluster's shared folder (spark.checkpoint.dir), so
plans do not grow with rounds. Rows of a mode without (sampled) nonzeros become zero rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from contextlib import contextmanager

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.storage import checkpointed
from tensorloom.operators import sampling as sp
from tensorloom.operators.algebra import Kruskal, cosine_factor, divided, few, fit, gaussian_factor, gram, hadamard, mttkrp, normalized, on_driver, pinv, times
from tensorloom.sources.tensors import Tensor


def start(t: Tensor, rank: int, how: str = "gaussian", seed: int = 1) -> Kruskal:
    """A first model: Gaussian or cosine factors with unit columns, all weights 1."""
    spark = t.df.sparkSession
    make = {"cosine": lambda k, n: cosine_factor(spark, n, rank), "gaussian": lambda k, n: gaussian_factor(spark, n, rank, k, seed)}[how]
    return Kruskal([normalized(make(k, n), rank)[0] for k, n in enumerate(t.dims)], np.ones(rank), list(t.dims))


def range_finder(t: Tensor, rank: int, draws: int, seed: int = 1) -> Kruskal:
    """A first model from random combinations of uniformly drawn fibres of each mode."""
    from tensorloom.functions.draws import gaussian, uniform

    spark, factors = t.df.sparkSession, []
    for mode, n in enumerate(t.dims):
        others = t.indices(mode)
        s = spark.range(draws).select(*(F.floor(uniform(seed, f"f{mode}.{k}", F.col("id")) * t.dims[k]).cast("long").alias(f"i{k}") for k in range(t.order) if k != mode), F.array(*(gaussian(seed, f"g{mode}.{r}", F.col("id")) for r in range(rank))).alias("h"), F.lit(1.0).alias("w"))
        factors.append(checkpointed(normalized(all_rows(sp.sampled_mttkrp(t.df, s, mode, others, rank, t.dims, draws), n, rank), rank)[0]))
    return Kruskal(factors, np.ones(rank), list(t.dims))


def all_rows(factor: DataFrame, size: int, rank: int) -> DataFrame:
    """A factor with a row for every index, zero where it had none."""
    zero = F.array(*[F.lit(0.0)] * rank)
    return factor.sparkSession.range(size).withColumnRenamed("id", "idx").join(factor, "idx", "left").select("idx", F.coalesce("u", zero).alias("u"))


def _replace(model: Kruskal, mode: int, product: DataFrame, p: np.ndarray) -> tuple[np.ndarray, float | None]:
    """Put the factor that solves ``product`` in place, its columns of unit length.

    Gives their Gram matrix and, where the driver holds the factor, the inner product of ``product`` and the new model.
    """
    n, rank = model.dims[mode], model.rank
    if few(n * rank):
        m = on_driver(product, n, rank)
        u = m @ p
        model.sigma = np.linalg.norm(u, axis=0)
        unit = u / np.where(model.sigma > 0, model.sigma, 1.0)
        model.put(mode, unit)
        return unit.T @ unit, float((m * u).sum())
    solved = checkpointed(all_rows(times(product, p), n, rank))
    g = gram(solved, rank)
    model.sigma = np.sqrt(g.diagonal())
    model.factors[mode] = divided(solved, model.sigma)
    by = np.where(model.sigma > 0, model.sigma, 1.0)
    return g / np.outer(by, by), None


class Phases:
    """Seconds spent in each phase of a round, and nonzeros that its products ran over."""

    def __init__(self):
        self.seconds, self.nonzeros, self.pending = dict.fromkeys(PHASES, 0.0), 0, []

    @contextmanager
    def __call__(self, name: str):
        began = time.perf_counter()
        yield
        self.seconds[name] += time.perf_counter() - began

    def met(self) -> Observation:
        """Counts the nonzeros of a product while that runs."""
        self.pending.append(Observation())
        return self.pending[-1]

    def row(self) -> dict:
        return {"nonzeros": self.nonzeros + sum(_count(o) for o in self.pending), **{k: round(v, 6) for k, v in self.seconds.items()}}


def _count(o: Observation) -> int:
    try:
        return o.get["nonzeros"]
    except Py4JJavaError:  # a join that meets nothing is replaced by an empty table, which counts nothing
        return 0


#: drawing samples and their design rows; the product with the tensor and the solved factor; Gram matrices and samplers; the fit.
PHASES = ("sampling", "product", "refresh", "fitting")


def exact_step(t: Tensor, model: Kruskal, grams: list[np.ndarray], mode: int, phases: Phases | None = None) -> float | None:
    """Solve for one mode; gives the inner product of tensor and model, where that is known without another pass."""
    with (phases or Phases())("product"):
        product = mttkrp(t, model.factors, mode, model.rank)
        grams[mode], inner = _replace(model, mode, product, pinv(hadamard(grams, mode)))
    return inner


def sampled_step(t: Tensor, model: Kruskal, sampler: sp.Sampler, mode: int, draws: int, seed: int, grams: list[np.ndarray] | None = None, phases: Phases | None = None) -> None:
    others, rank, phases = t.indices(mode), model.rank, phases or Phases()
    held = [sampler.rows[k] for k in range(t.order) if k != mode and k in sampler.rows]
    with phases("sampling"):
        samples = sampler.draw(draws, mode, seed)
        if len(held) == len(others) and few(draws * (rank + t.order)):
            rows, g = sp.held_design(samples, others, held)
        else:
            rows = checkpointed(sp.design(sp.distinct_samples(samples, others), model.factors, model.dims, mode, rank))
            g = sp.sampled_gram(rows, rank)
    with phases("product"):
        g, _ = _replace(model, mode, sp.sampled_mttkrp(t.df, rows, mode, others, rank, t.dims, draws, phases.met()), pinv(g))
    with phases("refresh"):
        sampler.refresh(mode, model.factors[mode], model.rows.get(mode))
    if grams is not None:
        grams[mode] = g


def decompose(t: Tensor, rank: int, rounds: int, algorithm: str = "exact", draws: int = 0, epoch: int = 1, init: str = "gaussian", seed: int = 1, warm_start: bool = False, model: Kruskal | None = None) -> tuple[Kruskal, list[dict]]:
    """A model of ``t`` and its trace, a row every ``epoch`` rounds; round 0 is the start.

    A row has round, fit, the seconds that all rounds took without fits, and since the last row the nonzeros that products
    ran over and the seconds of each of ``PHASES``.
    """
    samplers = {"exact": None, "product": sp.ProductSampler, "tree": sp.TreeSampler}
    if algorithm not in samplers or (algorithm != "exact" and draws < 1):
        raise ValueError(f"algorithm is one of {sorted(samplers)}, and sampling ones need draws")
    model = (model or start(t, rank, init, seed)).hold()
    model.factors = [f if k in model.rows else checkpointed(f) for k, f in enumerate(model.factors)]
    grams = [model.rows[k].T @ model.rows[k] if k in model.rows else gram(f, rank) for k, f in enumerate(model.factors)]
    whole = t.df.agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("v2")).first()
    count, size = whole["n"], float(np.sqrt(whole["v2"] or 0.0))
    trace, sampler = [], None

    def note(n: int, phases: Phases, inner: float | None = None) -> None:
        seconds = (trace[-1]["seconds"] if trace else 0.0) + sum(phases.seconds.values())
        with phases("fitting"):
            now = fit(t, model, grams, size, inner)
        trace.append({"round": n, "fit": now, "seconds": seconds} | phases.row())

    note(0, Phases())
    phases = Phases()
    for n in range(1, rounds + 1):
        exact, inner = algorithm == "exact" or (warm_start and n == 1), None
        if not exact and sampler is None:
            with phases("refresh"):
                sampler = samplers[algorithm](model.factors, model.dims, rank, model.rows)
        for mode in range(t.order):
            if exact:
                inner = exact_step(t, model, grams, mode, phases)
                phases.nonzeros += count
            else:
                sampled_step(t, model, sampler, mode, draws, seed * 1000 + n, grams, phases)
        if n % epoch == 0:
            note(n, phases, inner)
            phases = Phases()
    return model, trace


def write_model(model: Kruskal, path: str) -> None:
    """One Parquet folder per mode, and the weights."""
    for k, f in enumerate(model.factors):
        f.write.parquet(f"{path}/mode={k}")
    spark = model.factors[0].sparkSession
    spark.createDataFrame([(r, float(s)) for r, s in enumerate(model.sigma)], "r int, sigma double").coalesce(1).write.parquet(f"{path}/sigma")


def read_model(spark: SparkSession, path: str) -> Kruskal:
    """A model that ``write_model`` wrote, from as many modes as its folder has."""
    rows = spark.read.parquet(f"{path}/sigma").orderBy("r").collect()  # one row per component
    whole = spark.read.option("basePath", path).parquet(f"{path}/mode=*")
    sizes = whole.groupBy("mode").agg((F.max("idx") + 1).alias("n")).orderBy("mode").collect()  # one row per mode
    return Kruskal([spark.read.parquet(f"{path}/mode={r['mode']}") for r in sizes], np.array([r["sigma"] for r in rows]), [r["n"] for r in sizes])


def write_trace(spark: SparkSession, trace: Iterable[dict], path: str, **about) -> None:
    """The trace as JSON lines, with what describes the run in every row."""
    spark.createDataFrame([row | about for row in trace]).coalesce(1).write.mode("append").json(path)
