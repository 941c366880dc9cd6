"""Queries over the whole of their inputs, where the registered SQL stops at a fixed part of them."""

import hashlib
import random

import duckdb
import pytest

from larchway.operators import chain
from larchway.plans import queries


def test_every_lineage_is_resolved_and_marked(spark):
    """Lineages on both sides of 400, against the driver's planner."""
    rng = random.Random(7)
    names = [1, 2, 398, 399, 400, 401, 1000, 5000]
    bases = [(n, names[i // 2], 1 + i % 3) for i, n in enumerate(names) if i >= 2]
    base_of = {a: (b, t) for a, b, t in bases}
    members, heads = [], {}
    for n in names:
        at = base_of.get(n, (0, 0))[1]
        for k in range(5):
            at += 1
            snapshot = (n not in base_of and k == 0) or rng.random() < 0.2
            members.append((n, snapshot, 0 if snapshot else at, at, 1 + k % 3))
        heads[n] = at
    rows = {}
    for n, s, lo, hi, e in members:
        rows.setdefault(n, []).append({"lineage": n, "is_snapshot": s, "min_txid": lo, "max_txid": hi, "epoch": e})
    df = lambda rows, s: spark.createDataFrame(rows, s)
    d_lin = df(bases, "lineage long, base_lineage long, base_txid long")
    d_obj = df(members, "lineage long, is_snapshot boolean, min_txid long, max_txid long, epoch long")
    d_ref = df([(n, h, 1) for n, h in heads.items()], "lineage long, head_txid long, epoch long")
    d_cp = df([(n, 4) for n in names], "lineage long, txid long")
    name = lambda m: f"data/{m['lineage']}/{m['epoch']}/" + (f"snapshot-{m['max_txid']:016x}" if m["is_snapshot"] else f"segment-{m['max_txid']:016x}-{m['min_txid']:016x}")

    def plan(n, t):
        try:
            return chain.plan(n, t, base_of, rows)
        except LookupError:
            return None

    want = {(n, k): plan(n, max(h - k, 0)) for n, h in heads.items() for k in range(3)}
    assert sum(p is not None for (n, _), p in want.items() if n >= 400) > 8
    got = {r["id"]: (r["ok"], r["length"]) for r in queries.chain_verdict(d_lin, d_obj, d_ref).collect()}
    assert got == {f"x{n}@{k}": (p is not None, len(p or ())) for (n, k), p in want.items()}
    assert queries.chain_resolve(d_lin, d_obj, d_ref).count() == sum(len(p or ()) for p in want.values())
    assert queries.fork_share_decision(d_lin, d_obj.withColumn("o_orderkey", d_obj.max_txid), d_ref).count() == len(want)

    live = {name(m) for n, h in heads.items() for t in {h, 4} for m in plan(n, t) or ()}
    d_key = df([(name(m), m["lineage"], m["max_txid"], m["epoch"]) for ms in rows.values() for m in ms], "key string, lineage long, max_txid long, epoch long")
    assert {r["key"] for r in queries.gc_reachable(d_ref, d_cp, d_lin, d_obj).collect()} == live
    assert {r["key"] for r in queries.gc_unreachable(d_ref, d_cp, d_lin, d_obj, d_key).collect()} == {r["key"] for r in d_key.collect()} - live
    stones = d_key.selectExpr("key", "TIMESTAMP_NTZ '1999-01-01 00:00:00' AS marked_at")
    verdicts = {r["key"]: r["verdict"] for r in queries.gc_sweep_verdict(d_ref, d_cp, d_lin, d_obj, d_key, stones).collect()}
    assert {k for k, v in verdicts.items() if v == "rescued"} == live


def test_whole_log(spark):
    """Transactions far beyond 60, over several blocks of the checksum chain, against a plain loop."""
    rng = random.Random(11)
    rows = [(t, 3 * i + k, rng.randrange(1, 30), rng.choice("UUD"), str(rng.random()), k == 2, rng.randint(5, 40)) for i, t in enumerate(sorted(rng.sample(range(2, 5000), 150))) for k in range(3)]
    log = spark.createDataFrame(rows, "txid long, seq long, pgno long, op string, payload string, is_commit boolean, commit_size long")
    digest = lambda pgno, payload: int(hashlib.md5(f"{pgno}|{payload}".encode()).hexdigest()[:15], 16)
    last, chain_ = {}, {}
    end = rows[-1][0] - 2
    for t, _, pgno, op, payload, _, _ in rows:
        if t <= end:
            last[pgno] = (op, payload, t)
    state = {}
    for t, _, pgno, op, payload, _, _ in rows:
        state[pgno] = (op, payload, t)
        total = 0
        for k, (o, p, _) in state.items():
            total ^= digest(k, p) if o != "D" else 0
        chain_[t] = total
    alive = sorted((k, p, t) for k, (o, p, t) in last.items() if o != "D")
    get = lambda fn: sorted(map(tuple, fn(log).collect()))
    assert get(queries.checksum_incremental) == sorted(chain_.items()) and len({t // 1024 for t in chain_}) > 3
    for fn in (queries.asof_replay, queries.asof_replay_maxby, queries.asof_replay_antijoin):
        assert get(fn) == alive
    assert get(queries.replay_deletes) == sorted((k,) for k, (o, _, _) in last.items() if o == "D")
    least = lambda t: min((size for u, _, _, _, _, commit, size in rows if commit and t <= u <= end), default=10**9)
    assert get(queries.replay_truncate) == sorted((k, p, t) for k, (_, p, t) in last.items() if k <= least(t))
    assert get(queries.checksum_full) == [(max((c for c in chain_.items() if c[0] <= end))[1], len(alive))]


def test_cycles_and_depth_spoil_only_their_own_targets(spark):
    """A spine of 140 levels, a cycle of three lineages, one that leads into it, and one saved by its own snapshot."""
    base_of = {n: (n - 1, 1) for n in range(2, 141)} | {201: (202, 1), 202: (203, 1), 203: (201, 1), 210: (201, 1), 211: (201, 1)}
    rows = {1: [(1, True, 0, 1, 1)], 140: [(140, False, 2, 2, 1)], 211: [(211, True, 0, 3, 1)]}
    names = ("lineage", "is_snapshot", "min_txid", "max_txid", "epoch")
    targets = [(n, n, t) for n, t in ((1, 1), (77, 1), (140, 2), (201, 1), (210, 1), (211, 3))]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    d_lin = df([(a, b, t) for a, (b, t) in base_of.items()], "lineage long, base_lineage long, base_txid long")
    members = df([m for ms in rows.values() for m in ms], "lineage long, is_snapshot boolean, min_txid long, max_txid long, epoch long")
    got = {r["id"]: (r["ok"], r["length"]) for r in chain.resolve(df(targets, "id long, lineage long, target long"), d_lin, members)[1].collect()}

    def want(n, t):
        try:
            return True, len(chain.plan(n, t, base_of, {k: [dict(zip(names, m, strict=True)) for m in ms] for k, ms in rows.items()}))
        except LookupError:
            return False, 0

    assert got == {n: want(n, t) for n, _, t in targets}


def test_recursive_spine_passes_the_limits_of_levels_and_rows(spark):
    """A spine of as many levels as its bases allow, under limits lower than Spark's, which are there again afterwards."""
    base_of = {n: (n - 1, 1 + n % 4) for n in range(2, 13)}
    d_lin = spark.createDataFrame([(a, b, t) for a, (b, t) in base_of.items()], "lineage long, base_lineage long, base_txid long")
    d_ref = spark.createDataFrame([(n, 5) for n in range(1, 13)], "lineage long, head_txid long")
    want = []
    for n in range(1, 13):
        at, hi, depth = n, 5, 0
        while True:
            want.append((n, at, hi, depth))
            if at not in base_of:
                break
            at, hi, depth = base_of[at][0], min(hi, base_of[at][1]), depth + 1
    limits = {"spark.sql.cteRecursionLevelLimit": "4", "spark.sql.cteRecursionRowLimit": "20"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = queries.base_spine(d_lin, d_ref)
        assert {k: spark.conf.get(k) for k in limits} == limits
        assert sorted(map(tuple, got.collect())) == sorted(want)
        with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT_EXCEEDED"):
            queries.base_spine(d_lin.union(d_lin.selectExpr("1L", "12L", "1L")).distinct(), d_ref)
        assert {k: spark.conf.get(k) for k in limits} == limits
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_tumbling_hours_equal_sql(spark, tmp_path, zone):
    """Times around the ends of hours, on both sides of 1970, in an hour that a time zone leaves out, and none."""
    rng = random.Random(3)
    hour = 3_600_000_000
    times = [s * (h * hour + d) for h in (0, 1, 2, 473_000) for d in (-1001, -1000, -501, -500, -499, -1, 0, 1, 499, 500, 501) for s in (1, -1)]
    times += [1_710_036_000_000_000 + 2 * hour + 1, None, None] + [rng.randrange(-(10**16), 10**16) for _ in range(300)]
    c = duckdb.connect()
    c.sql("CREATE TABLE t (us BIGINT, event_type VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?)", [(t, rng.choice(["a", "b", None])) for t in times])
    c.sql(f"COPY (SELECT make_timestamp(us) AS ts, event_type FROM t) TO '{tmp_path}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.sql(f"SELECT CAST(hour AS VARCHAR), event_type, n FROM ({queries.ORACLES['events_tumbling']})").fetchall()
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = queries.QUERIES["events_tumbling"](spark, str(tmp_path))
        assert got.schema.simpleString() == "struct<hour:timestamp_ntz,event_type:string,n:bigint>"
        assert sorted(map(tuple, got.selectExpr("CAST(hour AS STRING)", "event_type", "n").collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_reference_values(spark):
    """Fixed values of rendering and parsing."""
    from pyspark.sql import functions as F

    from larchway.functions import expressions as X
    from larchway.operators import metrics

    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    for v, text in ((0.0, "0"), (1.0, "1"), (0.25, "0.25"), (300.0, "300"), (123456.5, "123456.5"), (1e6, "1e+06"), (1e300, "1e+300"), (1.5e-7, "1.5e-07"), (0.0001, "0.0001"), (0.00012, "0.00012"), (-2.5, "-2.5"), (float("inf"), "+Inf"), (123456789.0, "1.23456789e+08"), (0.1, "0.1"), (40.0, "40")):
        assert get(X.render_float(F.lit(v))) == text, v
    for us, text in ((0, "0s"), (1, "1µs"), (250_000, "250ms"), (1_500, "1.5ms"), (45_000_000, "45s"), (60_000_000, "1m0s"), (5_400_000_000, "1h30m0s"), (1_500_000, "1.5s"), (3_600_000_001, "1h0m0.000001s")):
        assert get(X.render_duration(F.lit(us).cast("long"))) == text, us
    for sql, rest in (("  -- a\nBEGIN;", "BEGIN;"), ("PRAGMA x=1; /* c */ select", "select"), ("pragma never ends", ""), ("/* open", ""), ("-- all", ""), ("beginning", "beginning")):
        assert get(X.skip_noise(F.lit(sql))) == rest, sql
    assert [get(X.opens_transaction(F.lit(s))) for s in ("PRAGMA a;begin", "BEGIN TRANSACTION;", "BEGINS", "select 1")] == [True, True, False, False]
    assert get(X.test_branch_name(F.lit("GW_0!"), F.lit("a::b"), F.lit(3))).startswith("t-gw-0-a-b-")
    assert get(X.lock_page(F.lit(4096))) == 262145
    entries = spark.createDataFrame([("a", 1, 5)], "path string, last_used long, bytes long")
    assert metrics.evict(entries, 0).count() == 0 and metrics.evict(entries, 4).count() == 1
