"""Branchable tables: snapshots and change segments as Parquet, read lazily at any branch or checkpoint."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Sequence
from dataclasses import replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchway.operators.chain import plan
from larchway.operators.replay import asof_anti, latest, row_hash
from larchway.sources.catalog import CasError, Catalog, Ref, Refused, stamp

CADENCE, SHARE_BOUND = 16, 16


class Store:
    """One table set per database. A table is read as the chain of its members: a snapshot and the segments after it."""

    def __init__(self, spark: SparkSession, spec: str, create: bool = False):
        self.spark, self.catalog = spark, Catalog(spec, create)
        self.data = self.catalog.folder / "data"

    # members

    def members(self, lineage: str) -> list[dict]:
        """All that lies in a lineage's folder, published or not."""
        out = []
        for path in sorted(self.data.glob(f"{lineage}/*/*-*/_DONE")):
            kind, high, *low = path.parent.name.partition(".")[0].split("-")
            out.append({"lineage": lineage, "epoch": int(path.parent.parent.name), "is_snapshot": kind == "snapshot", "max_txid": int(high, 16), "min_txid": int(low[0], 16) if low else 0, "path": path.parent})
        return out

    def chain(self, ref: Ref, txid: int) -> list[dict]:
        """The published members that make up a branch at a transaction."""
        bases, members, at = {}, {}, ref.lineage
        picked = {*ref.picks, *self.catalog.base_picks(ref.lineage)}
        while at not in members:
            members[at] = [m for m in self.members(at) if self._rel(m["path"]) in picked]
            base = self.catalog.base(at)
            if base:
                bases[at] = base
                at = base[0]
        return plan(ref.lineage, txid, bases, members)

    def _rel(self, path: Path) -> str:
        return path.relative_to(self.data).as_posix()

    def _write(self, lineage: str, epoch: int, name: str, tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> str:
        """Writes a member under a name of its own and returns it. Only the ref that lists it publishes it, so writers that
        race for a transaction never touch each other's members, and a lost one is garbage."""
        target = self.data / lineage / str(epoch) / f"{name}.{uuid.uuid4().hex}"
        part = target.parent / f".{uuid.uuid4().hex}"
        for table, (df, keys) in tables.items():
            df.write.parquet(str(part / f"table={table}"))
            (part / f"keys-{table}.json").write_text(json.dumps(list(keys)))
        part.mkdir(parents=True, exist_ok=True)
        (part / "_DONE").write_text("")
        part.rename(target)
        return self._rel(target)

    def tables(self, ref: Ref, txid: int) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for m in self.chain(ref, txid):
            for path in m["path"].glob("keys-*.json"):
                out[path.stem.removeprefix("keys-")] = json.loads(path.read_text())
        return out

    def read(self, ref: Ref, txid: int, table: str) -> DataFrame:
        """The table at a transaction. One snapshot is a plain scan; else unchanged snapshot rows and the latest changes, so
        the snapshot is never sorted. Columns that a later member adds are null in earlier rows."""
        members = self.chain(ref, txid)
        keys = self.tables(ref, txid)[table]
        has = [m for m in members if (m["path"] / f"table={table}").exists()]
        scan = lambda m: self.spark.read.parquet(str(m["path"] / f"table={table}"))
        snapshot = next((scan(m) for m in has if m["is_snapshot"]), None)
        changes = None
        for m in has:
            if not m["is_snapshot"]:
                changes = scan(m) if changes is None else changes.unionByName(scan(m), allowMissingColumns=True)
        if changes is None:
            return snapshot
        if snapshot is None:
            return latest(changes, keys).where("op <> 'D'").drop("op", "txid", "seq")
        rows = snapshot.withColumns({"op": F.lit("U"), "txid": F.lit(0).cast("long"), "seq": F.lit(0).cast("long")})
        both = [c for c in rows.columns if c not in changes.columns]
        for c in both:
            changes = changes.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
        for c in [c for c in changes.columns if c not in rows.columns]:
            rows = rows.withColumn(c, F.lit(None).cast(changes.schema[c].dataType))
        return asof_anti(rows.select(*changes.columns), changes, keys).drop("op", "txid", "seq")

    def table(self, db: str, branch: str, table: str, at: str | None = None) -> DataFrame:
        ref, _ = self.catalog.get(db, branch)
        return self.read(ref, ref.checkpoints[at]["txid"] if at else ref.head_txid, table)

    def checkout(self, db: str, branch: str = "main", at: str | None = None) -> dict[str, DataFrame]:
        """All tables, lazily, each also as a temporary view."""
        ref, _ = self.catalog.get(db, branch)
        txid = ref.checkpoints[at]["txid"] if at else ref.head_txid
        out = {t: self.read(ref, txid, t) for t in self.tables(ref, txid)}
        for name, df in out.items():
            df.createOrReplaceTempView(name)
        return out

    # lifecycle

    def create(self, db: str, tables: dict[str, tuple[DataFrame, Sequence[str]]], now: datetime | None = None) -> Ref:
        """A database from DataFrames with their keys: snapshot 1, branch main, protected. Keys must be unique and not null."""
        for name, (df, keys) in tables.items():
            bad = df.groupBy(*keys).count().where("count > 1 OR " + " OR ".join(f"`{k}` IS NULL" for k in keys))
            if not bad.isEmpty():
                raise ValueError(f"the keys of {name} aren't unique")
        lineage = uuid.uuid4().hex
        pick = self._write(lineage, 1, f"snapshot-{1:016x}", tables)
        ref = Ref(lineage, head_txid=1, picks=[pick], protected=True, checkpoints={"init": {"txid": 1, "epoch": 1}}, touched_at=stamp(now or datetime.now(UTC)))
        try:
            self.catalog.put(db, "main", ref, None)
        except CasError:
            shutil.rmtree(self.data / lineage)
            raise
        return ref

    def _snapshot(self, source: Ref, txid: int, lineage: str, epoch: int, as_txid: int) -> str:
        tables = self.tables(source, txid)
        return self._write(lineage, epoch, f"snapshot-{as_txid:016x}", {t: (self.read(source, txid, t), k) for t, k in tables.items()})

    def commit(self, db: str, branch: str, changes: dict[str, DataFrame], holder: str = "", epoch: int | None = None, meta: dict | None = None) -> int:
        """Writes changes (key columns, payload, op U or D) as transaction head + 1; every CADENCE-th is a snapshot too.

        Without a column `seq` that orders them, keys must not repeat. meta is added to the branch's by the same write
        that publishes the transaction. CasError, and nothing changed, where another writer was first.
        """
        ref, version = self.catalog.get(db, branch)
        if epoch is not None:
            self.catalog.fence(ref, holder, epoch)
        txid = ref.head_txid + 1
        keys = self.tables(ref, ref.head_txid)
        stamped = {}
        for name, df in changes.items():
            if "seq" not in df.columns and not df.groupBy(*keys[name]).count().where("count > 1").isEmpty():
                raise ValueError(f"the changes of {name} repeat keys; a column seq must order them")
            seq = F.lit(0).cast("long") if "seq" not in df.columns else F.col("seq")
            stamped[name] = (latest(df.withColumns({"seq": seq, "txid": F.lit(txid).cast("long")}), keys[name]), keys[name])
        pick = self._write(ref.lineage, ref.epoch, f"segment-{txid:016x}-{txid:016x}", stamped)
        after = replace(ref, head_txid=txid, head_epoch=ref.epoch, picks=[*ref.picks, pick], meta=ref.meta | (meta or {}))
        if sum(not m["is_snapshot"] for m in self.chain(after, txid)) >= CADENCE:
            after = self._pruned(replace(after, picks=[*after.picks, self._snapshot(after, txid, ref.lineage, ref.epoch, txid)]))
        self.catalog.put(db, branch, after, version)
        return txid

    def _pruned(self, ref: Ref) -> Ref:
        """The ref with the picks that its head and checkpoints need: after a snapshot, segments before it go."""
        needed = {self._rel(m["path"]) for t in {ref.head_txid, *(c["txid"] for c in ref.checkpoints.values())} for m in self.chain(ref, t)}
        return replace(ref, picks=[p for p in ref.picks if p in needed])

    def checkpoint(self, db: str, branch: str, name: str, meta: dict | None = None) -> int:
        """A name for the head; a full snapshot as the next transaction."""
        ref, version = self.catalog.get(db, branch)
        if name in ref.checkpoints:
            raise Refused(f"checkpoint {name} exists")
        txid = ref.head_txid + 1
        pick = self._snapshot(ref, ref.head_txid, ref.lineage, ref.epoch, txid)
        marks = ref.checkpoints | {name: {"txid": txid, "epoch": ref.epoch, "meta": meta or {}}}
        self.catalog.put(db, branch, self._pruned(replace(ref, head_txid=txid, head_epoch=ref.epoch, checkpoints=marks, picks=[*ref.picks, pick])), version)
        return txid

    def fork(self, db: str, source: str, new: str, at: str | None = None, ttl: float = 0.0, share: bool | None = None, now: datetime | None = None) -> Ref:
        """A branch at the source's head or checkpoint. Short chains are shared by a base pointer, whatever the data's size;
        longer ones are written as a snapshot. Where the base went meanwhile, the branch is taken back."""
        ref, _ = self.catalog.get(db, source)
        txid = ref.checkpoints[at]["txid"] if at else ref.head_txid
        chain = self.chain(ref, txid)
        lineage, picks = uuid.uuid4().hex, []
        if len(chain) < SHARE_BOUND if share is None else share:
            self.catalog.write_base(lineage, ref.lineage, txid, [self._rel(m["path"]) for m in chain])
        else:
            picks = [self._snapshot(ref, txid, lineage, 1, txid)]
        child = Ref(lineage, head_txid=txid, picks=picks, parent=f"{db}@{source}@{txid}", checkpoints={"fork": {"txid": txid, "epoch": 1}}, ttl=ttl, touched_at=stamp(now or datetime.now(UTC)))
        try:
            version = self.catalog.put(db, new, child, None)
            if any(not m["path"].exists() for m in chain):
                self.catalog.put(db, new, replace(child, gone=True), version)
                raise CasError("the fork point was collected; try again")
        except CasError:
            shutil.rmtree(self.data / lineage, ignore_errors=True)
            raise
        return child

    def rollback(self, db: str, branch: str, to: str) -> Ref:
        """A new lineage from a checkpoint; checkpoints up to it are kept, each transaction written once."""
        ref, version = self.catalog.get(db, branch)
        target = ref.checkpoints[to]["txid"]
        kept = {n: c | {"epoch": 1} for n, c in ref.checkpoints.items() if c["txid"] <= target}
        lineage = uuid.uuid4().hex
        picks = [self._snapshot(ref, txid, lineage, 1, txid) for txid in sorted({c["txid"] for c in kept.values()})]
        after = replace(ref, lineage=lineage, picks=picks, epoch=1, head_epoch=1, head_txid=target, checkpoints=kept, holder="", lease_expiry="")
        self.catalog.put(db, branch, after, version)
        return after

    def _moved(self, db: str, branch: str, source: Ref, mark: str, parent: str) -> Ref:
        ref, version = self.catalog.get(db, branch)
        lineage = uuid.uuid4().hex
        pick = self._snapshot(source, source.head_txid, lineage, 1, source.head_txid)
        after = replace(ref, lineage=lineage, picks=[pick], epoch=1, head_epoch=1, head_txid=source.head_txid, checkpoints={mark: {"txid": source.head_txid, "epoch": 1}}, parent=parent, holder="", lease_expiry="")
        self.catalog.put(db, branch, after, version)
        return after

    def promote(self, db: str, source: str, target: str, force: bool = False) -> Ref:
        if source == target:
            raise Refused("a branch isn't promoted to itself")
        if self.catalog.get(db, target)[0].protected and not force:
            raise Refused("the target is protected")
        ref, _ = self.catalog.get(db, source)
        return self._moved(db, target, ref, "promote", f"{db}@{source}@{ref.head_txid}")

    def compact(self, db: str, branch: str) -> Ref:
        """Cuts a branch from its bases; nothing to do for one that has none."""
        ref, _ = self.catalog.get(db, branch)
        return self._moved(db, branch, ref, "compact", ref.parent) if self.catalog.base(ref.lineage) else ref

    def export(self, db: str, branch: str, path: str, at: str | None = None, force: bool = False) -> None:
        for name, df in self.checkout(db, branch, at).items():
            df.write.mode("overwrite" if force else "errorifexists").parquet(f"{path}/{name}")

    def dump(self, db: str, branch: str, at: str | None = None) -> dict[str, tuple[int, int]]:
        """Rows and an order-free checksum of every table: two branches with equal dumps hold the same data."""
        out = {}
        for name, df in self.checkout(db, branch, at).items():
            r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row_hash(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])), F.lit(0)).alias("x")).first()
            out[name] = (r["n"], r["x"])
        return out

    def gc(self, grace: float, now: datetime) -> tuple[list[Path], list[Path]]:
        """Marks what no branch or checkpoint reaches and deletes what was marked `grace` seconds ago and still isn't.

        A branch that doesn't resolve stops the pass with nothing deleted. What lies above a live head of its lineage,
        of the head's epoch or a later one, may be about to be published and stays. (new tombstones, deleted)
        """

        def marked() -> set[Path]:
            out = set()
            for refs in self.catalog.branches().values():
                for ref in refs.values():
                    for txid in {ref.head_txid, *(c["txid"] for c in ref.checkpoints.values())}:
                        out |= {m["path"] for m in self.chain(ref, txid)}
            return out

        stones_path = self.catalog.folder / "gc.json"
        stones = json.loads(stones_path.read_text()) if stones_path.exists() else {}
        found = {m["path"]: m for lineage in (self.data.iterdir() if self.data.exists() else ()) for m in self.members(lineage.name)}
        everything = set(found)

        def guarded() -> set[Path]:
            heads = [(r.lineage, r.head_txid, r.head_epoch) for refs in self.catalog.branches().values() for r in refs.values()]
            return {p for p, m in found.items() for lineage, head, epoch in heads if m["lineage"] == lineage and m["max_txid"] > head and m["epoch"] >= epoch}

        reach = marked()
        new = [p for p in sorted(everything - reach) if str(p) not in stones]
        old = [Path(p) for p, at in stones.items() if now.timestamp() - at >= grace]
        again = marked()
        safe = again | guarded()
        deleted = [p for p in old if p in everything and p not in safe]
        for p in deleted:
            shutil.rmtree(p)
        left = {str(p): at for p, at in ((Path(k), v) for k, v in stones.items()) if p in everything and p not in again and p not in deleted}
        stones_path.write_text(json.dumps(left | {str(p): now.timestamp() for p in new}))
        return new, deleted
