"""Connected components of a distributed edge table, over checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.storage import checkpointed

__all__ = ["checkpointed", "components", "fresh"]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) of every vertex in ``edges`` (a, b): the smallest vertex reachable, by label spreading and jumping."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "v"))
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.v == near.a).select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("v").alias("jv"), F.col("comp").alias("jc"))
        new = checkpointed(step.join(jump, step.mid == jump.jv).select("v", "old", F.least("mid", "jc").alias("comp")))
        changed = new.where("comp <> old").limit(1).count()
        labels = new.select("v", "comp")
        if not changed:
            return labels
