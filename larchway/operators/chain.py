"""Which stored members make up a lineage at a transaction: the chain, for many targets at once or for one."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_highest_epoch(members: DataFrame) -> DataFrame:
    """Members without those a later epoch replaced, lineage by lineage.

    Snapshots and segments of one transaction compete for the transaction they end at: the higher epoch wins, a snapshot
    wins a tie. Segments of several transactions compete with those of the same range only.
    """
    alone = F.col("is_snapshot") | (F.col("min_txid") == F.col("max_txid"))
    low = F.when(alone, F.lit(-1).cast("long")).otherwise(F.col("min_txid"))
    rank = F.row_number().over(Window.partitionBy("lineage", "max_txid", "_low").orderBy(F.desc("epoch"), F.desc("is_snapshot")))
    return members.withColumn("_low", low).withColumn("_rank", rank).where("_rank = 1").drop("_low", "_rank")


def newest_snapshot(targets: DataFrame, members: DataFrame) -> DataFrame:
    """(lineage, target, max_txid): each target's newest snapshot at or before it."""
    snapshots = members.where("is_snapshot").select("lineage", "max_txid")
    return targets.join(snapshots, "lineage").where("max_txid <= target").groupBy("lineage", "target").agg(F.max("max_txid").alias("max_txid"))


def segments_between(ranges: DataFrame, members: DataFrame) -> DataFrame:
    """Segments of (lineage, lo, hi) that end in (lo, hi]."""
    return ranges.join(members.where("NOT is_snapshot"), "lineage").where("max_txid > lo AND max_txid <= hi")


def holes(members: DataFrame) -> DataFrame:
    """Segments that don't begin right after the one before, with the transaction missing first."""
    before = F.lag("max_txid").over(Window.partitionBy("lineage").orderBy("max_txid", "min_txid"))
    return members.where("NOT is_snapshot").withColumn("before", before).where("min_txid <> before + 1").select("lineage", "before", "min_txid", "max_txid")


def cut(df: DataFrame) -> DataFrame:
    """df, computed, as a plan of one leaf: in the folder of spark.checkpoint.dir, or a temporary one in local mode only."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="larchway-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def spine(targets: DataFrame, bases: DataFrame) -> DataFrame:
    """(id, lineage, hi, depth, base_lineage, base_txid): each target's lineage, its base, the base's base and so on.

    By doubling: with each lineage's ancestor 1, 2, 4, ... steps up, the spine doubles in each round, so a forest of
    depth d takes log2(d) joins, and its plan stays as short. Bases that hold a cycle are followed until a lineage
    would come twice.
    """
    b = bases.select("lineage", "base_lineage", "base_txid")
    jump = b.select("lineage", F.col("base_lineage").alias("up"), F.col("base_txid").alias("least"))
    jumps, most = [], jump.count()
    while not jump.isEmpty() and 1 << len(jumps) <= most:
        jumps.append(jump)
        far = jump.select(F.col("lineage").alias("up"), F.col("up").alias("far"), F.col("least").alias("far_least"))
        jump = jump.join(far, "up").select("lineage", F.col("far").alias("up"), F.least("least", "far_least").alias("least"))
        jump = cut(jump)  # it was read twice; else the plan would double as well
    start = targets.select("id", "lineage", F.col("target").alias("hi"), F.lit(0).alias("depth"))
    endless = None if jump.isEmpty() else jump.select("lineage")  # more steps up than there are lineages
    out = start if endless is None else start.join(endless, "lineage", "left_anti").select("id", "lineage", "hi", "depth")
    for k, j in enumerate(jumps):
        out = cut(out) if k else out
        out = out.union(out.join(j, "lineage").select("id", F.col("up").alias("lineage"), F.least("hi", "least").alias("hi"), (F.col("depth") + (1 << k)).alias("depth")))
    if endless is not None:
        level = start.join(endless, "lineage", "left_semi").withColumn("seen", F.array("lineage"))
        while not (level := cut(level)).isEmpty():
            out = out.union(level.select("id", "lineage", "hi", "depth"))
            level = level.join(b, "lineage").where(~F.array_contains("seen", F.col("base_lineage")))
            level = level.select("id", F.col("base_lineage").alias("lineage"), F.least("hi", "base_txid").alias("hi"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("base_lineage")).alias("seen"))
    return out.join(b, "lineage", "left").select("id", "lineage", "hi", "depth", "base_lineage", "base_txid")


@contextmanager
def recursion(spark: SparkSession, levels: int) -> Iterator[None]:
    """Recursive queries that run in here may go down `levels` levels and return any number of rows."""
    limits = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(levels)}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def spine_recursive(targets: DataFrame, bases: DataFrame) -> DataFrame:
    """The same as one recursive query, for forests without cycles. It is computed at once, while Spark's limits of levels
    and rows don't hold; bases that hold a cycle fail when there were more levels than bases."""
    spark = targets.sparkSession
    with recursion(spark, bases.count() + 2):  # the last lineage and the empty level that ends the query
        return cut(
            spark.sql(
                """WITH RECURSIVE s(id, lineage, hi, depth) AS (
                     SELECT id, lineage, target, 0 FROM {targets}
                     UNION ALL
                     SELECT s.id, b.base_lineage, least(s.hi, b.base_txid), s.depth + 1 FROM s JOIN {bases} b ON s.lineage = b.lineage)
                   SELECT s.id, s.lineage, s.hi, s.depth, b.base_lineage, b.base_txid FROM s LEFT JOIN {bases} b ON s.lineage = b.lineage""",
                targets=targets,
                bases=bases,
            )
        )


def resolve(targets: DataFrame, bases: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chain, verdict) of targets(id, lineage, target).

    chain: id, depth, lineage, is_snapshot, min_txid, max_txid, epoch of every member of a target that resolves.
    verdict: id, ok, length. A lineage's own snapshot wins over its base; segments must continue without a hole, level
    by level, and end exactly at the target; what can't be resolved so is not ok and has no chain. That includes a target
    whose bases hold a cycle, unless a snapshot below it ends the climb; other targets aren't affected.
    """
    levels = spine(targets, bases).where("base_txid IS NULL OR hi > base_txid").persist()
    own = keep_highest_epoch(members)
    snapshots = own.where("is_snapshot").select("lineage", F.col("max_txid").alias("s_max"), F.col("epoch").alias("s_epoch"))
    anchors = levels.join(snapshots, "lineage").where("s_max <= hi").groupBy("id", "depth", "lineage").agg(F.max("s_max").alias("s_max"), F.max_by("s_epoch", "s_max").alias("s_epoch"))
    stop = anchors.groupBy("id").agg(F.min("depth").alias("stop"))
    active = levels.join(stop, "id").where("depth <= stop").join(anchors.select("id", "depth", "s_max", "s_epoch"), ["id", "depth"], "left")
    active = active.withColumn("lo", F.when(F.col("depth") == F.col("stop"), F.col("s_max")).otherwise(F.col("base_txid"))).persist()
    w = Window.partitionBy("id", "depth").orderBy("max_txid", "min_txid")
    segments = active.join(own.where("NOT is_snapshot").select("lineage", "min_txid", "max_txid", "epoch"), "lineage").where("max_txid > lo AND max_txid <= hi")
    segments = segments.withColumn("_place", F.row_number().over(Window.partitionBy("id", "depth", "max_txid").orderBy("min_txid")))
    segments = segments.where("_place = 1 OR (depth < stop AND max_txid < hi)").withColumn("_ok", F.col("min_txid") == F.coalesce(F.lag("max_txid").over(w), F.col("lo")) + 1)
    per = segments.groupBy("id", "depth").agg(F.bool_and("_ok").alias("_ok"), F.max("max_txid").alias("_last"), F.count("*").alias("_n"))
    checked = active.join(per, ["id", "depth"], "left").select("id", (F.coalesce("_ok", F.lit(True)) & (F.coalesce("_last", "lo") == F.col("hi")) & (F.col("_n").isNotNull() | (F.col("depth") == F.col("stop")))).alias("_good"), F.coalesce("_n", F.lit(0)).alias("_n"))
    good = checked.groupBy("id").agg(F.bool_and("_good").alias("ok"), (F.sum("_n") + 1).alias("length"))
    verdict = targets.select("id").join(good, "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("ok"), F.col("length")).otherwise(F.lit(0)).cast("long").alias("length"))
    names = ["id", "depth", "lineage", "is_snapshot", "min_txid", "max_txid", "epoch"]
    first = active.where("depth = stop").select("id", "depth", "lineage", F.lit(True).alias("is_snapshot"), F.lit(0).cast("long").alias("min_txid"), F.col("s_max").alias("max_txid"), F.col("s_epoch").alias("epoch"))
    chain = first.union(segments.withColumn("is_snapshot", F.lit(False)).select(*names)).join(verdict.where("ok").select("id"), "id", "left_semi")
    return chain, verdict


def plan(lineage: str, target: int, bases: dict, members: dict) -> list[dict]:
    """The chain of one target on the driver, from the few rows of its spine: bases[lineage] is (base, txid), members[lineage]
    a list of rows. Raises LookupError where it doesn't resolve."""
    levels, seen, hi = [], set(), target
    while True:
        if lineage in seen:
            raise LookupError(f"the bases of {lineage} hold a cycle")
        seen.add(lineage)
        base = bases.get(lineage)
        if base is None or hi > base[1]:
            best: dict = {}
            for m in members.get(lineage, ()):
                alone = m["is_snapshot"] or m["min_txid"] == m["max_txid"]
                slot = (m["max_txid"], -1 if alone else m["min_txid"])
                if slot not in best or (m["epoch"], m["is_snapshot"]) > (best[slot]["epoch"], best[slot]["is_snapshot"]):
                    best[slot] = m
            snapshots = [m for m in best.values() if m["is_snapshot"] and m["max_txid"] <= hi]
            anchor = max(snapshots, key=lambda m: m["max_txid"], default=None)
            levels.append((hi, anchor, base, sorted((m for m in best.values() if not m["is_snapshot"]), key=lambda m: (m["max_txid"], m["min_txid"]))))
            if anchor:
                break
        if base is None:
            raise LookupError(f"no snapshot of {lineage} at or before {target}")
        lineage, hi = base[0], min(hi, base[1])
    chain: list[dict] = []
    for hi, anchor, base, segments in reversed(levels):
        at = anchor["max_txid"] if anchor else base[1]
        floor = at
        if anchor:
            chain.append(anchor)
        for m in segments:
            if at == hi:
                break
            if m["max_txid"] <= (at if anchor else floor):
                continue
            if m["max_txid"] > hi or m["min_txid"] != at + 1:
                raise LookupError(f"transaction {at + 1} is missing before {m['max_txid']}")
            chain.append(m)
            at = m["max_txid"]
        if at != hi:
            raise LookupError(f"segments end at {at}, before {hi}")
    return chain
