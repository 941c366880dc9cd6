"""Branches as rows: leases, time to live, states, plans of lifecycle operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchway.functions.expressions import micros, parse_duration, render_duration

#: Chains this long are copied by a fork instead of shared; seconds until a claim to delete is stale.
SHARE_BOUND, STALE_CLAIM = 16, 30


def lease_live(now: Column) -> Column:
    return F.coalesce(F.col("holder").isNotNull() & (F.col("holder") != "") & (now < F.col("lease_expiry")), F.lit(False))


def reap_deadline() -> Column:
    """Microseconds of the last activity or the lease expiry, the later, and the time to live; null where there is none."""
    seconds = parse_duration(F.col("ttl"))
    return F.when((seconds > 0) & F.col("touched_at").isNotNull(), micros(F.greatest("touched_at", "lease_expiry")) + (seconds * 1_000_000).cast("long"))


def reap_eligible(refs: DataFrame, now: Column) -> DataFrame:
    return refs.where(~F.col("protected") & (micros(now) >= reap_deadline()))


def ttl_remaining(now: Column) -> Column:
    """'' without a deadline, 'expired' once it has passed, or what is left, such as '1h30m0s'."""
    left = reap_deadline() - micros(now)
    return F.when(left.isNull(), "").when(left < 0, "expired").otherwise(render_duration(left))


def leases(refs: DataFrame, now: Column) -> DataFrame:
    state = F.when(lease_live(now), "live").otherwise("expired")
    return refs.where("holder IS NOT NULL AND holder <> ''").select("db", "branch", "holder", "epoch", "lease_expiry", state.alias("state"))


def acquire(refs: DataFrame, holder: str, now: Column) -> DataFrame:
    """What acquiring each branch's lease gives: refused, renewed with its epoch, or acquired with the next epoch."""
    busy = F.coalesce("reaping", F.lit(False)) | F.coalesce("deleting", F.lit(False))
    live = lease_live(now)
    verdict = F.when(busy, "refused: going").when(live & (F.col("holder") != holder), "refused: held").when(live, "renewed").otherwise("acquired")
    return refs.withColumn("verdict", verdict).withColumn("new_epoch", F.col("epoch") + F.when(F.col("verdict") == "acquired", 1).otherwise(0))


def stale_claims(refs: DataFrame, now: Column, after: int = STALE_CLAIM) -> DataFrame:
    """Branches whose claim to delete is older than `after` seconds."""
    return refs.where("deleting").where(micros(now) - micros("deleting_at") > after * 1_000_000)


def destroy_guard(now: Column, force: bool = False) -> Column:
    if force:
        return F.lit("ok")
    return F.when(F.col("protected"), "refused: protected").when(lease_live(now), "refused: leased").otherwise("ok")


def promote_guard(source: Column, target: Column, protected: Column, force: bool = False) -> Column:
    return F.when(source == target, "refused: itself").when(protected & F.lit(not force), "refused: protected").otherwise("ok")


def refuse_if_open(refs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Branches without a session that is open or opening."""
    return refs.join(sessions.where(F.col("state").isin("open", "opening")), ["db", "branch"], "left_anti")


def checkout_state() -> Column:
    """Of a checkout against its branch: unknown without a provenance row, stale, modified or clean."""
    return F.when(F.col("side_lineage").isNull(), "unknown").when((F.col("side_lineage") != F.col("lineage")) | (F.col("side_epoch") != F.col("head_epoch")) | (F.col("side_txid") != F.col("head_txid")), "stale").when(F.col("side_hash") != F.col("file_hash"), "modified").otherwise("clean")


def branch_state(now: Column) -> Column:
    """active under a live lease; else by the checkout: idle, detached, dirty."""
    same = F.col("side_lineage") == F.col("lineage")
    return (
        F.when(lease_live(now), "active")
        .when(F.col("side_lineage").isNull(), "idle")
        .when(~same, "detached")
        .when((F.col("side_epoch") != F.col("head_epoch")) | (F.col("side_txid") != F.col("head_txid")), "idle")
        .when((F.col("side_hash") != F.col("file_hash")) | F.coalesce("busy", F.lit(False)), "dirty")
        .otherwise("idle")
    )


def status(refs: DataFrame, checkouts: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """A row for each branch: its state, overlaid with what its session reports, storage class and time left."""
    both = refs.join(checkouts, ["db", "branch"], "left").join(sessions.select("db", "branch", F.col("state").alias("session_state"), "error"), ["db", "branch"], "left")
    shown = F.when(F.coalesce("error", F.lit("")) != "", "error").when(F.col("session_state") == "pending", "pending").otherwise(branch_state(now))
    return both.select("db", "branch", "lineage", "epoch", "head_txid", "protected", shown.alias("state"), checkout_state().alias("checkout"), F.when(F.col("shared"), "shared").otherwise("own").alias("storage"), ttl_remaining(now).alias("ttl_left"))


def fork_decision(targets: DataFrame, verdict: DataFrame, bound: int = SHARE_BOUND) -> DataFrame:
    """How a fork of each target would be stored: a pointer, a copy of one snapshot, a rewritten one; or an error."""
    how = F.when(~F.col("ok"), "error").when(F.col("length") < bound, "share").otherwise("materialize")
    return targets.join(verdict, "id").select("id", "length", how.alias("decision"), (F.col("ok") & (F.col("length") == 1)).alias("one_snapshot"))


def rollback_plan(refs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """For each branch rolled back to its target: checkpoints kept, and distinct transactions to write anew."""
    kept = refs.join(checkpoints, "lineage").where("txid <= target")
    return kept.groupBy("lineage").agg(F.count("*").alias("kept"), F.countDistinct("txid").alias("to_write"), F.max("txid").alias("last_txid"))


def databases(refs: DataFrame) -> DataFrame:
    return refs.select("db").distinct()


def branches_by_database(refs: DataFrame) -> DataFrame:
    return refs.groupBy("db").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("branch")), ",").alias("branches"))
