"""Connected components by contraction, as joins and aggregations over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch


def merge(labels: DataFrame, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Labels (key, label) after the edges (a, b: keys) have joined their components; the label is the least key.

    Each step hooks every label to its least neighbour, flattens those chains by pointer doubling and contracts
    the edges.  The number of steps is logarithmic in the size of a component, whatever its shape.
    """
    from_a = edges.join(labels.select(F.col("key").alias("a"), F.col("label").alias("x")), "a")
    both = from_a.join(labels.select(F.col("key").alias("b"), F.col("label").alias("y")), "b")
    step = 0
    e = scratch.save(_two_way(both.select("x", "y")), f"{tag}-e{step}")
    while not e.isEmpty():
        up = scratch.save(e.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("p")), f"{tag}-p{step}")
        hop = 0
        while True:
            far = up.select(F.col("x").alias("p"), F.col("p").alias("far"))
            new = scratch.save(up.join(far, "p").select("x", F.col("far").alias("p"), (F.col("far") != F.col("p")).alias("moved")),
                               f"{tag}-p{step}-{hop}")
            if new.where("moved").isEmpty():
                break
            up, hop = new.select("x", "p"), hop + 1
        to = up.select(F.col("x").alias("label"), F.col("p"))
        labels = scratch.save(labels.join(to, "label", "left").select("key", F.coalesce("p", "label").alias("label")), f"{tag}-l{step}")
        xs = up.select("x", F.col("p").alias("x2"))
        ys = up.select(F.col("x").alias("y"), F.col("p").alias("y2"))
        step += 1
        e = scratch.save(_two_way(e.join(xs, "x").join(ys, "y").select(F.col("x2").alias("x"), F.col("y2").alias("y"))), f"{tag}-e{step}")
    return labels


def _two_way(e: DataFrame) -> DataFrame:
    e = e.where("x <> y")
    return e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
