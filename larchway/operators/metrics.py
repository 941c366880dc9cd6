"""Cache eviction, counters, gauges, histograms and sessions over event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchway.functions.expressions import micros

#: Upper bounds of a duration histogram, in seconds.
BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def usage(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n"))


def evict(entries: DataFrame, budget: int) -> DataFrame:
    """Entries to evict, least recently used first and ties by path, until what stays is within the budget; a budget of
    0 or less is no limit.

    The running sum needs one order over all entries. It is taken in two steps: sums by recency, of which there are
    few, in order; then inside a recency, in parallel.
    """
    if budget <= 0:
        return entries.withColumn("freed_before", F.lit(0).cast("long")).where("false")
    per = entries.groupBy("last_used").agg(F.sum("bytes").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("last_used").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_sum").over(Window.partitionBy())
    starts = per.select("last_used", before.alias("_before"), total.alias("_total"))
    own = F.coalesce(F.sum("bytes").over(Window.partitionBy("last_used").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.join(starts, "last_used").withColumn("freed_before", F.col("_before") + own).where(F.col("_total") - F.col("freed_before") > budget).drop("_before", "_total")


def counter(events: DataFrame, labels: Sequence[str], domain: DataFrame | None = None, value: Column | None = None) -> DataFrame:
    """Sum by labels; combinations of the domain that never occur are zero. Negative increments fail the query."""
    v = value if value is not None else F.lit(1).cast("long")
    checked = F.when(v < 0, F.raise_error(F.lit("a counter never falls"))).otherwise(v)
    out = events.groupBy(*labels).agg(F.sum(checked).alias("value"))
    return out if domain is None else domain.join(out, list(labels), "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))


def gauge(events: DataFrame, labels: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def histogram(events: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """(labels, le, n): cumulative counts for each upper bound and +Inf, in one aggregation without a row per bound and event."""
    names = [f"_b{i}" for i in range(len(bounds))]
    aggregates = [F.count_if(F.col(value) <= b).alias(n) for b, n in zip(bounds, names, strict=True)]
    wide = events.groupBy(*labels).agg(*aggregates, F.count(value).alias("_inf"))
    pairs = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(n).alias("n")) for b, n in zip(bounds, names, strict=True)]
    return wide.select(*labels, F.explode(F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n")))).alias("_p")).select(*labels, "_p.le", "_p.n")


def flush_counter(events: DataFrame) -> DataFrame:
    """Flushes by result and kind; an unknown kind counts as manual."""
    kind = F.when(F.col("kind").isin("timer", "manual", "checkpoint", "close"), F.col("kind")).otherwise("manual")
    result = F.when(F.col("type") == "flushed", "ok").when(F.col("type") == "flush_failed", "error")
    return events.select(result.alias("result"), kind.alias("kind")).where("result IS NOT NULL").groupBy("result", "kind").agg(F.count("*").alias("value"))


def durable_age(events: DataFrame, labels: Sequence[str], now: Column) -> DataFrame:
    """Seconds since the last flush; labels that never flushed have no row."""
    last = events.where("type = 'flushed'").groupBy(*labels).agg(F.max("ts").alias("last"))
    return last.select(*labels, ((micros(now) - micros("last")) / 1e6).alias("age"))


def capture_lag(offsets: DataFrame, key: str) -> DataFrame:
    """Bytes written and not yet consumed, never below zero, by the latest offsets."""
    last = offsets.groupBy(key).agg(F.max_by(F.struct("size", "consumed", "dead"), "seq").alias("o"))
    return last.select(key, F.greatest(F.col("o.size") - F.greatest("o.consumed", "o.dead"), F.lit(0).cast("long")).alias("lag"))


def takeovers(events: DataFrame, key: str, gap_seconds: int, most: int) -> DataFrame:
    """Runs of events with no gap longer than `gap_seconds`: their size, and how often `most` events were reached in them."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    new = F.coalesce((micros("ts") - micros(F.lag("ts").over(w)) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    runs = events.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(key, "run").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).withColumn("full", F.floor(F.col("n") / most).cast("long"))


def slow_consumers(steps: DataFrame, key: str, buffer: int = 64) -> DataFrame:
    """(key, seq) where a subscriber is dropped: the first publication that finds `buffer` events waiting. step: 1 published, -1 consumed."""
    waiting = F.sum("step").over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("_waiting", F.coalesce(waiting, F.lit(0))).where(F.col("_waiting") >= buffer).where("step = 1").groupBy(key).agg(F.min("seq").alias("seq"))


def exposition(metric: str, values: DataFrame, labels: Sequence[str], value: str = "value") -> DataFrame:
    """Prometheus text, a line for each row."""
    from larchway.functions.expressions import escape_label

    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escape_label(F.col(c).cast("string")), F.lit('"')) for c in labels])
    return values.select(F.concat(F.lit(metric + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def kept_events(events: DataFrame) -> DataFrame:
    from larchway.functions.expressions import event_type

    return events.withColumn("type", event_type(F.col("raw"))).where("type IS NOT NULL")
