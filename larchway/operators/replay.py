"""Replaying change logs: the latest row of each key, deletes, extents, checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Transaction numbers in a block of the checksum chain.
BLOCK = 1024


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str] = ("txid", "seq")) -> DataFrame:
    """The last change of each key. The rank limit prunes inside map tasks, so a hot key ships one row a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def asof(log: DataFrame, keys: Sequence[str], txid: int | Column, order: Sequence[str] = ("txid", "seq"), op: str = "op") -> DataFrame:
    """The rows alive after a transaction: latest change of each key up to it, without deletes."""
    return latest(log.where(F.col("txid") <= txid), keys, order).where(F.col(op) != "D")


def asof_max_by(log: DataFrame, keys: Sequence[str], txid: int | Column, order: Sequence[str] = ("txid", "seq"), op: str = "op") -> DataFrame:
    """The same by an aggregate."""
    rest = [c for c in log.columns if c not in keys]
    last = log.where(F.col("txid") <= txid).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, "_last.*").where(F.col(op) != "D").select(*log.columns)


def asof_anti(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ("txid", "seq"), op: str = "op") -> DataFrame:
    """The same for a snapshot that dwarfs its changes: snapshot rows of unchanged keys, and the latest changes."""
    last = latest(changes, keys, order)
    return snapshot.join(last.select(*keys), list(keys), "left_anti").select(*changes.columns).union(last.where(F.col(op) != "D"))


def committed(log: DataFrame) -> DataFrame:
    """Rows of transactions whose commit row has arrived."""
    done = F.max(F.col("is_commit").cast("int")).over(Window.partitionBy("txid"))
    return log.withColumn("_done", done).where("_done = 1").drop("_done")


def last_in_transaction(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return latest(log, ["txid", *keys], ["seq"])


def extents(log: DataFrame) -> DataFrame:
    """(txid, commit_size): the number of pages after each committed transaction."""
    return log.where("is_commit").groupBy("txid").agg(F.max_by("commit_size", "seq").alias("commit_size"))


def pages_asof(log: DataFrame, txid: int) -> DataFrame:
    """Pages after a transaction. A page is gone if the extent fell below it at or after its last write.

    The smallest extent from a transaction on is a running minimum over transactions, not over rows: the log is joined
    to one row per transaction.
    """
    done = log.where(F.col("txid") <= txid)
    low = extents(done).withColumn("least", F.min("commit_size").over(Window.orderBy(F.desc("txid")).rowsBetween(Window.unboundedPreceding, 0)))
    return latest(done, ["pgno"]).join(low.select("txid", "least"), "txid").where(F.col("pgno") <= F.col("least")).drop("least")


def row_hash(*columns: str | Column) -> Column:
    """60 bits of a digest of the columns, the same in every engine that has md5."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def checksum(rows: DataFrame, *columns: str) -> DataFrame:
    """Exclusive-or of row hashes: independent of order and of how rows are dealt out."""
    return rows.agg(F.coalesce(F.bit_xor(row_hash(*columns)), F.lit(0).cast("long")).alias("checksum"), F.count("*").alias("n_rows"))


def checksum_chain(log: DataFrame, keys: Sequence[str], payload: str = "payload", op: str = "op") -> DataFrame:
    """(txid, checksum) after each transaction, folded from old and new row hashes.

    Each change contributes the hash of what it replaces and of what it writes; the xor over a transaction takes the
    state from before to after. Transactions, not rows, are folded in order: in blocks of BLOCK numbers side by side, on
    top of what the blocks before come to, so only a row for each block meets in one task.
    """
    written = last_in_transaction(log, keys)
    new = F.when(F.col(op) != "D", row_hash(*keys, payload)).otherwise(F.lit(0).cast("long"))
    old = F.coalesce(F.lag("_new").over(Window.partitionBy(*keys).orderBy("txid")), F.lit(0).cast("long"))
    per = written.withColumn("_new", new).withColumn("_step", F.col("_new").bitwiseXOR(old)).groupBy("txid").agg(F.bit_xor("_step").alias("_step"))
    per = per.withColumn("_block", F.floor(F.col("txid") / BLOCK).cast("long"))
    before = F.bit_xor("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = per.groupBy("_block").agg(F.bit_xor("_step").alias("_sum")).select("_block", F.coalesce(before, F.lit(0).cast("long")).alias("_before"))
    run = F.bit_xor("_step").over(Window.partitionBy("_block").orderBy("txid").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("txid", "_block", run.alias("_run")).join(blocks, "_block").select("txid", F.col("_run").bitwiseXOR(F.col("_before")).alias("checksum"))


def flush_kinds(log: DataFrame, cadence: int, every: int, least_pages: int = 64, fraction: float = 0.5) -> DataFrame:
    """The kind of each flush of `every` transactions: a snapshot first, each `cadence`-th, or where at least `fraction`
    of `least_pages` or more pages changed; else a segment."""
    flush = F.floor((F.col("txid") - 2) / every).cast("long")
    per = log.withColumn("flush", flush).groupBy("flush").agg(F.countDistinct("pgno").alias("changed"), F.max("txid").alias("max_txid"), F.max_by("commit_size", "seq").alias("commit_size"))
    large = (F.col("commit_size") >= least_pages) & (F.col("changed") >= fraction * F.col("commit_size"))
    kind = F.when((F.col("flush") == 0) | (F.col("flush") % cadence == 0) | large, "snapshot").otherwise("segment")
    return per.withColumn("kind", kind)
