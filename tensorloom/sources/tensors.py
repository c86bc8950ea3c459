"""Sparse tensors as DataFrames: one row (i0, i1, ..., v) for each nonzero, its index columns zero-based longs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tensorloom.functions.draws import uniform
from tensorloom.functions.storage import checkpointed


@dataclass
class Tensor:
    """Nonzeros and mode sizes. Repeated coordinates are kept: they add up in products, and are squared one by one in the norm."""

    df: DataFrame
    dims: list[int]

    @property
    def order(self) -> int:
        return len(self.dims)

    def indices(self, without: int | None = None) -> list[str]:
        return [f"i{k}" for k in range(self.order) if k != without]

    def map(self, df: DataFrame) -> Tensor:
        return Tensor(df, self.dims)

    def cache(self) -> Tensor:
        return self.map(self.df.persist(StorageLevel.MEMORY_AND_DISK))

    def coalesced(self) -> Tensor:
        """Equal coordinates summed."""
        return self.map(self.df.groupBy(*self.indices()).agg(F.sum("v").alias("v")))


def numbered(keys: DataFrame) -> tuple[DataFrame, int, int]:
    """(key, idx): ids 0.. in key order of the distinct values of the one column; how many, and their bytes as text.

    No global sort: keys are range-partitioned; each partition numbers its own and starts after the partitions before it.
    """
    name = keys.columns[0]
    spread = keys.select(F.col(name).alias("key")).where("key is not null").distinct().repartitionByRange("key").withColumn("p", F.spark_partition_id())
    spread = checkpointed(spread)  # so that numbers and offsets see the same ranges
    own = spread.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("key")))
    size = F.sum(F.octet_length(F.to_json(F.struct("key"))).cast("long"))
    parts = {r["p"]: (r["n"], r["size"]) for r in spread.groupBy("p").agg(F.count("*").alias("n"), size.alias("size")).collect()}  # one row per partition
    counts = [parts.get(p, (0, 0))[0] for p in range(max(parts, default=0) + 1)]
    before = [sum(counts[:p]) for p in range(len(counts))]
    ids = own.select("key", (F.element_at(F.lit(before), F.col("p") + 1) + F.col("n") - 1).cast("long").alias("idx"))
    return ids, sum(counts), sum(s for _, s in parts.values())


def dictionary(keys: DataFrame) -> DataFrame:
    return numbered(keys)[0]


#: Bytes of a dictionary, as text, that may travel to every executor.
BROADCAST_BYTES = 16 << 20


def encode(df: DataFrame, modes: list[str], value: str, keys: DataFrame | None = None) -> tuple[Tensor, list[DataFrame]]:
    """The tensor of distinct mode values relabelled 0.. in order, and each mode's dictionary. Rows with null keys go.

    ``keys``: a table with the same values in the mode columns, where that is cheaper to read than ``df``, such as what
    ``df`` groups. Dictionaries that were found to be small are broadcast.
    """
    made = [numbered((df if keys is None else keys).select(m)) for m in modes]
    out = df.where(" and ".join(f"`{m}` is not null" for m in modes))
    for k, (m, (d, _, size)) in enumerate(zip(modes, made, strict=True)):
        side = d.withColumnsRenamed({"key": f"_k{k}", "idx": f"i{k}"})
        out = out.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, F.col(m) == F.col(f"_k{k}")).drop(f"_k{k}")
    return Tensor(out.select(*(f"i{k}" for k in range(len(modes))), F.col(value).cast("double").alias("v")), [n for _, n, _ in made]), [d for d, _, _ in made]


def rebased(df: DataFrame, indices: list[str], value: str) -> Tensor:
    """Integer coordinates moved to start at 0; sizes are max - min + 1."""
    ends = df.agg(*(f(i).alias(f"{n}{k}") for k, i in enumerate(indices) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cols = [(F.col(i) - F.lit(ends[f"lo{k}"])).cast("long").alias(f"i{k}") for k, i in enumerate(indices)]
    return Tensor(df.select(*cols, F.col(value).cast("double").alias("v")), [int(ends[f"hi{k}"] - ends[f"lo{k}"] + 1) for k in range(len(indices))])


def read_coordinates(spark: SparkSession, path: str) -> Tensor:
    """Coordinate text: blank-separated indices, the value last, lines that start with # skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(F.split(F.trim("value"), r"\s+").alias("x"))
    first = lines.select(F.size("x")).first()
    n = first[0] - 1
    return rebased(lines.select(*(F.col("x")[k].cast("long").alias(f"m{k}") for k in range(n)), F.col("x")[n].cast("double").alias("val")), [f"m{k}" for k in range(n)], "val")


def write_coordinates(t: Tensor, path: str) -> None:
    """One-based coordinate text."""
    t.df.select(F.concat_ws(" ", *((F.col(i) + 1).cast("string") for i in t.indices()), F.col("v").cast("string"))).write.text(path)


def read_temporal_edges(spark: SparkSession, path: str, years_from: int = 0) -> DataFrame:
    """(u, v, year, month, day, val): edge lines "u v weight seconds" after a header line of %; weights become 1."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '%')").select(F.split(F.trim("value"), r"\s+").alias("x"))
    return temporal_modes(lines.select(F.col("x")[0].cast("long").alias("u"), F.col("x")[1].cast("long").alias("v"), F.timestamp_seconds(F.col("x")[3].cast("long")).alias("ts")), "ts", years_from)


def edges_to_coordinates(spark: SparkSession, edges: str, path: str, years_from: int = 2000) -> None:
    """A temporal edge list written as coordinate text: vertices, year, month, day and the value 1."""
    read_temporal_edges(spark, edges, years_from).select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("u", "v", "year", "month", "day")), F.lit("1"))).write.text(path)


def packet_times(df: DataFrame, archive: str, slot: str, per_archive: int = 64) -> DataFrame:
    """Adds time, one step for each matrix of an archive of ``per_archive`` of them."""
    return df.withColumn("time", F.col(archive).cast("long") * per_archive + F.col(slot).cast("long"))


def low_rank(spark: SparkSession, dims: list[int], rank: int, seed: int = 1, heavy: float = 0.1, times: float = 8.0) -> Tensor:
    """A dense tensor of known rank: entries of factors uniform in [-0.5, 0.5), a share of heavy rows ``times`` as large.

    For convergence tests: it has as many rows as cells.
    """
    cells: DataFrame | None = None
    for k, n in enumerate(dims):
        scale = F.when(uniform(seed, f"heavy{k}", F.col("id")) < heavy, F.lit(times)).otherwise(F.lit(1.0))
        rows = spark.range(n).select(F.col("id").alias(f"i{k}"), F.array(*((uniform(seed, f"{k}.{r}", F.col("id")) - 0.5) * scale for r in range(rank))).alias(f"u{k}"))
        cells = rows if cells is None else cells.crossJoin(F.broadcast(rows))
    value = sum((reduce(mul, (F.col(f"u{k}")[r] for k in range(len(dims)))) for r in range(1, rank)), reduce(mul, (F.col(f"u{k}")[0] for k in range(len(dims)))))
    return Tensor(cells.select(*(f"i{k}" for k in range(len(dims))), value.alias("v")), list(dims))


def temporal_modes(df: DataFrame, ts: str, years_from: int = 0) -> DataFrame:
    """A time stamp split into year, month and day modes, with value 1 (the session's time zone counts; use UTC)."""
    cols = [c for c in df.columns if c != ts]
    part = lambda f, n: f(ts).cast("long").alias(n)
    return df.select(*cols, (F.year(ts).cast("long") - years_from).alias("year"), part(F.month, "month"), part(F.dayofmonth, "day"), F.lit(1.0).alias("val"))


def write_tensor(t: Tensor, path: str) -> None:
    t.df.write.parquet(f"{path}/nonzeros")
    t.df.sparkSession.createDataFrame([(k, n) for k, n in enumerate(t.dims)], "mode int, size long").write.parquet(f"{path}/modes")


def read_tensor(spark: SparkSession, path: str) -> Tensor:
    return Tensor(spark.read.parquet(f"{path}/nonzeros"), [r["size"] for r in spark.read.parquet(f"{path}/modes").orderBy("mode").collect()])


def synthetic(spark: SparkSession, size: int, basis: int, seed: int = 1) -> Tensor:
    """Three modes of ``size`` rows which each draw one of ``basis`` columns; 1 where all three drew the same."""
    rows = [spark.range(size).select(F.col("id").alias(f"i{k}"), F.floor(uniform(seed, k, F.col("id")) * basis).cast("long").alias("q")) for k in range(3)]
    return Tensor(rows[0].join(rows[1], "q").join(rows[2], "q").select("i0", "i1", "i2", F.lit(1.0).alias("v")), [size] * 3)


# ---- value transforms and mode permutations


def log_count(t: Tensor) -> Tensor:
    return t.map(t.df.withColumn("v", F.log(F.col("v") + 1)))


def ones(t: Tensor) -> Tensor:
    return t.map(t.df.withColumn("v", F.lit(1.0)))


def preprocess(t: Tensor, how: str) -> Tensor:
    kinds = {"none": lambda x: x, "log_count": log_count, "ones": ones}
    if how not in kinds:
        raise ValueError(f"preprocessing is one of {sorted(kinds)}, not {how!r}")
    return kinds[how](t)


def permutation(spark: SparkSession, size: int, mode: int, seed: int = 42) -> DataFrame:
    """(old, new): a seeded relabelling of a mode; join it the other way round to undo it."""
    keyed = spark.range(size).select(F.struct(uniform(seed, mode, F.col("id")).alias("u"), F.col("id").alias("id")).alias("k"))
    return dictionary(keyed).select(F.col("key.id").alias("old"), F.col("idx").alias("new"))


def permuted(t: Tensor, seed: int = 42) -> Tensor:
    out = t.df
    for k, n in enumerate(t.dims):
        out = out.join(permutation(out.sparkSession, n, k, seed), F.col(f"i{k}") == F.col("old")).withColumn(f"i{k}", F.col("new")).drop("old", "new")
    return t.map(out.select(*t.indices(), "v"))


def in_box(df: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows with lo <= index < hi in every named mode."""
    cond: Column = F.lit(True)
    for c, (lo, hi) in box.items():
        cond &= (F.col(c) >= lo) & (F.col(c) < hi)
    return df.where(cond)
