"""Mark, tombstone and sweep as queries over all branches at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchway.functions.expressions import member_key, micros
from larchway.operators.chain import resolve


def marks(refs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(id, lineage, target): every branch's head and checkpoints, each (lineage, transaction) once."""
    targets = refs.select("lineage", F.col("head_txid").alias("target")).union(checkpoints.select("lineage", F.col("txid").alias("target"))).distinct()
    return targets.select(F.concat_ws("@", F.col("lineage").cast("string"), F.col("target").cast("string")).alias("id"), "lineage", "target")


def reachable(targets: DataFrame, bases: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key) of every member in some target's chain, and the targets that don't resolve; where there are any, nothing may be deleted."""
    chain, verdict = resolve(targets, bases, members)
    key = member_key(F.col("lineage"), F.col("epoch"), F.col("is_snapshot"), F.col("min_txid"), F.col("max_txid"))
    return chain.select(key.alias("key")).distinct(), verdict.where("NOT ok")


def unreachable(objects: DataFrame, marked: DataFrame) -> DataFrame:
    return objects.join(marked.select("key"), "key", "left_anti")


def live_heads(refs: DataFrame) -> DataFrame:
    return refs.groupBy("lineage").agg(F.min("head_txid").alias("head_txid"), F.min("epoch").alias("head_epoch"))


def sweep_verdict(stones: DataFrame, marked: DataFrame, objects: DataFrame, heads: DataFrame, now: Column, grace: int) -> DataFrame:
    """What becomes of each tombstone: waiting in its grace, rescued (reachable again), pruned (object gone), guarded
    (above a live head of its lineage and no older than the head's epoch), or deleted."""
    joined = (
        stones.join(marked.select("key", F.lit(True).alias("marked")), "key", "left")
        .join(objects.select("key", "lineage", "max_txid", "epoch", F.lit(True).alias("there")), "key", "left")
        .join(heads, "lineage", "left")
    )
    verdict = (
        F.when(micros(now) - micros("marked_at") < grace * 1_000_000, "waiting")
        .when(F.coalesce("marked", F.lit(False)), "rescued")
        .when(~F.coalesce("there", F.lit(False)), "pruned")
        .when((F.col("max_txid") > F.col("head_txid")) & (F.col("epoch") >= F.col("head_epoch")), "guarded")
        .otherwise("deleted")
    )
    return joined.select("key", verdict.alias("verdict"))
