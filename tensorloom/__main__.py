"""Decompose a tensor from the command line: ``python -m tensorloom --folder tables --tensor part_supplier_month --rank 25 --rounds 40``.

With an output folder, every trial's trace is added to it as JSON lines (runs) and trials that are there are not run again.
"""

from __future__ import annotations

import argparse
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tensorloom.plans import als, analysis
from tensorloom.sources import catalog
from tensorloom.sources import tensors as ts


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m tensorloom", description="Low-rank decomposition of a sparse tensor")
    p.add_argument("--tensor", required=True, help=f"one of {sorted(catalog.CATALOG)}, synthetic:SIZE:BASIS, a folder that write_tensor wrote, or coordinate text")
    p.add_argument("--folder", help="where the tables of named tensors are")
    p.add_argument("--prepare", choices=["none", "log_count", "ones"], help="value transform, instead of the tensor's own")
    p.add_argument("--rank", type=int, required=True)
    p.add_argument("--rounds", type=int, required=True)
    p.add_argument("--algorithm", choices=["exact", "product", "tree"], default="exact")
    p.add_argument("--draws", type=int, default=0, help="samples of each step, for sampling algorithms")
    p.add_argument("--warm-start", action="store_true", help="one exact round first")
    p.add_argument("--epoch", type=int, default=5, help="rounds between fits")
    p.add_argument("--init", choices=["gaussian", "cosine"], default="gaussian")
    p.add_argument("--repetitions", type=int, default=1)
    p.add_argument("--output", help="folder of runs")
    p.add_argument("--model", help="folder to write the last trial's model to")
    p.add_argument("--note", default="", help="kept with every row")
    return p.parse_args(given)


def tensor(spark: SparkSession, a: argparse.Namespace) -> ts.Tensor:
    if a.tensor in catalog.CATALOG:
        return catalog.load(spark, a.folder, a.tensor, a.prepare)
    if a.tensor.startswith("synthetic:"):
        size, basis = map(int, a.tensor.split(":")[1:])
        t = ts.synthetic(spark, size, basis)
    else:
        try:
            t = ts.read_tensor(spark, a.tensor)
        except AnalysisException:  # no such folders in it
            t = ts.read_coordinates(spark, a.tensor)
    return ts.preprocess(t, a.prepare or "none")


def runs(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return analysis.load_runs(spark, path)
    except AnalysisException:  # nothing there yet
        return None


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> list[int]:
    """The trials that were run."""
    a = arguments(given)
    spark = spark or SparkSession.builder.getOrCreate()
    about = {"input": a.tensor, "rank": a.rank, "rounds": a.rounds, "algorithm": a.algorithm, "draws": a.draws, "epoch": a.epoch, "warm_start": a.warm_start, "note": a.note}
    trials = analysis.missing_trials(runs(spark, a.output) if a.output else None, a.repetitions, **about)
    if not trials:
        print("no trials left")
        return []
    t, model = tensor(spark, a).cache(), None
    for trial in trials:
        model, trace = als.decompose(t, a.rank, a.rounds, a.algorithm, a.draws, a.epoch, a.init, seed=trial + 1, warm_start=a.warm_start)
        if a.output:
            als.write_trace(spark, trace, a.output, trial=trial, **about)
        print(json.dumps({**about, "trial": trial, "initial_fit": trace[0]["fit"], "final_fit": trace[-1]["fit"], "seconds": round(trace[-1]["seconds"], 3)}))
    if a.model:
        als.write_model(model, a.model)
    t.df.unpersist()
    return trials


if __name__ == "__main__":
    main()
