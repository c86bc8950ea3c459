"""Named tensors: where each one's nonzeros come from and how its values are prepared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.sources import tensors as ts


@dataclass(frozen=True)
class Entry:
    """``rows``: the mode columns and ``val``, from a folder of tables; ``prepare``: the value transform."""

    modes: tuple[str, ...]
    rows: Callable[[SparkSession, str], DataFrame]
    prepare: str = "none"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _counted(df: DataFrame, **modes) -> DataFrame:
    return df.groupBy(*(c.alias(n) for n, c in modes.items())).agg(F.count("*").alias("val"))


def _part_supplier_month(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("l_shipdate")
    return _counted(_table(spark, folder, "lineitem"), part=F.col("l_partkey"), supplier=F.col("l_suppkey"), month=(F.year(day) * 12 + F.month(day)).cast("long"))


def _nation_segment_month_priority(spark: SparkSession, folder: str) -> DataFrame:
    orders, people = _table(spark, folder, "orders"), _table(spark, folder, "customer")
    day = F.col("o_orderdate")
    both = orders.join(people, orders.o_custkey == people.c_custkey)
    return _counted(both, nation=F.col("c_nationkey"), segment=F.col("c_mktsegment"), month=(F.year(day) * 12 + F.month(day)).cast("long"), priority=F.col("o_orderpriority"))


def _user_type_hour_day(spark: SparkSession, folder: str) -> DataFrame:
    return _counted(_table(spark, folder, "events"), user=F.col("user_id"), type=F.col("event_type"), hour=F.hour("ts"), day=F.dayofmonth("ts"))


def _supplier_part_date(spark: SparkSession, folder: str) -> DataFrame:
    """An edge list with dates: every row a nonzero of 1, repeated coordinates kept."""
    rows = _table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts"))
    return ts.temporal_modes(rows, "ts")


CATALOG: dict[str, Entry] = {
    "part_supplier_month": Entry(("part", "supplier", "month"), _part_supplier_month, "log_count"),
    "nation_segment_month_priority": Entry(("nation", "segment", "month", "priority"), _nation_segment_month_priority),
    "user_type_hour_day": Entry(("user", "type", "hour", "day"), _user_type_hour_day),
    "supplier_part_date": Entry(("supplier", "part", "year", "month", "day"), _supplier_part_date, "ones"),
}


def load(spark: SparkSession, folder: str, name: str, prepare: str | None = None) -> ts.Tensor:
    """The named tensor of the tables in ``folder``, with its own value transform unless another is given."""
    if name not in CATALOG:
        raise ValueError(f"tensors are {sorted(CATALOG)}, not {name!r}")
    entry = CATALOG[name]
    return ts.preprocess(ts.encode(entry.rows(spark, folder), list(entry.modes), "val")[0], prepare or entry.prepare)
