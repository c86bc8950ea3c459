"""Tables over run results: traces (run, round, seconds, fit), phase times and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def load_runs(spark: SparkSession, path: str, **equal) -> DataFrame:
    """Run documents (JSON lines or files) below a folder, with equality filters on their fields."""
    out = spark.read.json(path)
    for k, v in equal.items():
        out = out.where(F.col(k) == F.lit(v))
    return out


def next_trial(runs: DataFrame, **equal) -> int:
    """The number after the highest finished trial of runs with these fields; 0 for none. Lets an experiment resume."""
    for k, v in equal.items():
        runs = runs.where(F.col(k) == F.lit(v))
    last = runs.agg(F.max(F.col("trial").cast("int"))).first()[0]
    return 0 if last is None else last + 1


def missing_trials(runs: DataFrame | None, wanted: int, **equal) -> list[int]:
    """Which of the trials 0.. of runs with these fields are not there yet, gaps included."""
    if runs is None or "trial" not in runs.columns:
        return list(range(wanted))
    for k, v in equal.items():
        runs = runs.where(F.col(k) == F.lit(v)) if k in runs.columns else runs.limit(0)
    seen = {int(r[0]) for r in runs.where(F.col("trial").cast("int") < wanted).select(F.col("trial").cast("int")).distinct().collect()}  # at most ``wanted`` rows
    return [n for n in range(wanted) if n not in seen]


def mean_phases(runs: DataFrame, keys: list[str], phases: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(*(F.avg(p).alias(p) for p in phases))


def roll_up(runs: DataFrame, keys: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """Phases summed into named groups."""
    return runs.select(*keys, *(sum((F.col(p) for p in ps[1:]), F.col(ps[0])).alias(g) for g, ps in groups.items()))


def running_best(trace: DataFrame) -> DataFrame:
    """Adds best, the highest fit of the run so far."""
    return trace.withColumn("best", F.max("fit").over(Window.partitionBy("run").orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)))


def on_grid(trace: DataFrame, points: int) -> DataFrame:
    """(k, seconds, fit): running best fits interpolated on a grid of times that all runs reach, averaged over runs."""
    w = Window.partitionBy("run").orderBy("seconds")
    best = running_best(trace).withColumns({"next_s": F.lead("seconds").over(w), "next_f": F.lead("best").over(w)}).where("next_s is not null")
    ends = trace.groupBy("run").agg(F.min("seconds").alias("a"), F.max("seconds").alias("b")).agg(F.max("a").alias("lo"), F.min("b").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    width = F.col("next_s") - F.col("seconds")
    # each piece of a trace makes its own grid points: no range join
    first = F.greatest(F.ceil((F.col("seconds") - F.col("lo")) / step), F.lit(0))
    last = F.least(F.ceil((F.col("next_s") - F.col("lo")) / step) - 1, F.lit(points - 2))
    pieces = best.crossJoin(F.broadcast(ends)).where(last >= first)
    at = pieces.withColumn("k", F.explode(F.sequence(first, last))).withColumn("t", F.col("lo") + F.col("k") * step)
    value = F.col("best") + (F.col("next_f") - F.col("best")) * (F.col("t") - F.col("seconds")) / width
    return at.groupBy("k").agg(F.min("t").alias("seconds"), F.avg(value).alias("fit"))


def throughput(runs: DataFrame) -> DataFrame:
    """Adds rate: nonzeros iterated per second of the last total time; null where that is 0."""
    return runs.withColumn("rate", F.try_divide(F.col("nonzeros"), F.element_at("times", -1)))


def imbalance(parts: DataFrame, key: str) -> DataFrame:
    """Largest over mean nonzeros of the parts."""
    return parts.groupBy(key).agg((F.max("nonzeros") / F.avg("nonzeros")).alias("imbalance"))


def accuracy(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of each run's best fit."""
    return runs.groupBy(*keys).agg(F.avg("best").alias("mean"), F.stddev_pop("best").alias("std"))


def part_stats(parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def speedup(ours: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """How many times ``base`` takes as long; null where ours took none."""
    return ours.join(base.select(key, F.col("seconds").alias("base")), key).select(key, F.try_divide("base", "seconds").alias("speedup"))


def parse_trace(lines: DataFrame) -> DataFrame:
    """(its, seconds, fit, elapsed) from lines like "its = 3 (0.25s) fit = 0.31"; elapsed sums the seconds."""
    get = lambda p: F.regexp_extract("value", p, 1)
    rows = lines.where(F.col("value").rlike(r"its\s*=")).select(get(r"its\s*=\s*(\d+)").cast("int").alias("its"), get(r"\(([0-9.]+)s\)").cast("double").alias("seconds"), get(r"fit\s*=\s*([-0-9.]+)").cast("double").alias("fit"))
    return rows.withColumn("elapsed", F.sum("seconds").over(Window.orderBy("its")))


def parse_traces(texts: DataFrame, key: str, marker: str | None = None) -> DataFrame:
    """(key, segment, rank, its, seconds, fit, elapsed) from whole trace files (key, value).

    Lines of 64 asterisks or more cut a file into segments, of which those with ``marker`` in them count; NFACTORS=n in a
    segment names its rank. elapsed sums the seconds of a segment.
    """
    parts = texts.select(key, F.posexplode(F.split("value", r"\*{64,}")).alias("segment", "part"))
    if marker:
        parts = parts.where(F.contains("part", F.lit(marker)))
    found = F.regexp_extract_all("part", F.lit(r"(its\s*=\s*\d+\s*\([\d.]+s\)\s*fit\s*=\s*[-\d.]+)"), F.lit(1))
    rank = F.try_element_at(F.regexp_extract_all("part", F.lit(r"NFACTORS=(\d+)"), F.lit(1)), F.lit(1)).cast("int")
    rows = parts.select(key, "segment", rank.alias("rank"), F.explode(found).alias("value"))
    get = lambda p: F.regexp_extract("value", p, 1)
    rows = rows.select(key, "segment", "rank", get(r"its\s*=\s*(\d+)").cast("int").alias("its"), get(r"\(([\d.]+)s\)").cast("double").alias("seconds"), get(r"fit\s*=\s*([-\d.]+)").cast("double").alias("fit"))
    return rows.withColumn("elapsed", F.sum("seconds").over(Window.partitionBy(key, "segment").orderBy("its")))


def final_fits(runs: DataFrame, key: str) -> DataFrame:
    """Quartiles of final fits, for box plots."""
    return runs.groupBy(key).agg(F.sort_array(F.collect_list("best")).alias("fits"), F.percentile("best", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("quartiles"))
