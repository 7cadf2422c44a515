"""Connected components by contraction: every vertex takes the best label in its neighbourhood, edges move to labels, repeat.

Labels are compared by a digest of the id, so a chain of ascending ids shrinks by a constant factor each round. Every
round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openchair.llm.common import Stage


def connected_components(edges: DataFrame, stage: Stage) -> DataFrame:
    """edges: a, b (bigint, a != b). Per vertex of an edge: id and component, the smallest id reachable from it."""

    def ranked(name: str):
        return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("v"))

    def both_ways(df: DataFrame) -> DataFrame:
        return df.select("a", "b").unionAll(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    live = stage.write(edges.select("a", "b").where("a != b").distinct())
    owner: DataFrame | None = None
    while not live.isEmpty():
        best = both_ways(live).groupBy(F.col("a").alias("v")).agg(F.min(ranked("b")).alias("near"))
        label = stage.write(best.select("v", F.least("near", ranked("v"))["v"].alias("label")))
        moved = (
            live.join(label.toDF("a", "x"), "a")
            .join(label.toDF("b", "y"), "b")
            .where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        live = stage.write(moved)
        if owner is None:
            owner = label.toDF("id", "label")
        else:
            step = label.toDF("label", "next")
            owner = stage.write(
                owner.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
            )
    if owner is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    smallest = owner.groupBy("label").agg(F.min("id").alias("component"))
    return owner.join(smallest, "label").select("id", "component")
