"""Connected components by repeated contraction, in the shared folder, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchway.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(id, component) of each vertex of `edges(a, b)`: the smallest id that links reach. No edges, no rows.

    In a round every vertex points to the smallest of itself and its neighbours, and each edge becomes the edge of what
    its ends point to. The edge to the vertex pointed at survives as an edge, so nothing comes apart, and at least every
    vertex that isn't smallest among its neighbours goes: rounds grow with the logarithm of the longest chain. Minima
    are aggregated before the shuffle and joined back, so a vertex with many edges is split like any skewed join.
    """
    clean = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    left = scratch.table(edges.where(clean).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-edges-0")
    labels, turn = None, 0
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("id"), F.col("b").alias("to")).union(left.select("b", "a"))
        pointed = scratch.table(ends.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("up")), f"{tag}-up-{turn}")
        after = left.join(pointed.withColumnsRenamed({"id": "a", "up": "ua"}), "a").join(pointed.withColumnsRenamed({"id": "b", "up": "ub"}), "b")
        after = after.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        if labels is None:
            grown = pointed.withColumnRenamed("up", "component")
        else:
            grown = labels.join(pointed.withColumnsRenamed({"id": "component"}), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        labels = scratch.table(grown, f"{tag}-labels-{turn}")
        left = scratch.table(after, f"{tag}-edges-{turn + 1}")
        scratch.drop(f"{tag}-edges-{turn}", f"{tag}-up-{turn}", *([f"{tag}-labels-{turn - 1}"] if turn else []))
        turn += 1
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    return labels
