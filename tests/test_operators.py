import random

import pytest
from pyspark.sql import functions as F

from larchway.functions import expressions as X
from larchway.operators import chain, metrics, replay


def test_chain_plan_equals_set_based(spark):
    """The driver's planner and the query agree on random stores: gaps, competing epochs, bases, ranges with equal ends."""
    rng = random.Random(5)
    bases, members, targets = [], [], []
    for store in range(25):
        for k in range(4):
            name = f"{store}-{k}"
            if k and rng.random() < 0.8:
                bases.append((name, f"{store}-{rng.randrange(k)}", rng.randint(1, 5)))
            for txid in range(1, 9):
                for _ in range(rng.randint(0, 2)):
                    if rng.random() < 0.3 or txid == 1:
                        members.append((name, True, 0, txid, rng.randint(1, 3)))
                    else:
                        members.append((name, False, max(2, txid - rng.choice([0, 0, 0, 1])), txid, rng.randint(1, 3)))
            targets += [(f"{name}@{t}", name, t) for t in range(1, 9)]
    members = sorted(set(members))
    as_dict: dict = {}
    for n, s, lo, hi, e in members:
        as_dict.setdefault(n, []).append({"is_snapshot": s, "min_txid": lo, "max_txid": hi, "epoch": e})
    base_of = {a: (b, t) for a, b, t in bases}
    want = {}
    for i, name, t in targets:
        try:
            want[i] = (True, len(chain.plan(name, t, base_of, as_dict)))
        except LookupError:
            want[i] = (False, 0)
    df = lambda rows, s: spark.createDataFrame(rows, s)
    verdict = chain.resolve(df(targets, "id string, lineage string, target long"), df(bases, "lineage string, base_lineage string, base_txid long"), df(members, "lineage string, is_snapshot boolean, min_txid long, max_txid long, epoch long"))[1]
    got = {r["id"]: (r["ok"], r["length"]) for r in verdict.collect()}
    assert sum(ok for ok, _ in want.values()) > 50
    assert got == want
    with pytest.raises(LookupError):
        chain.plan("a", 1, {"a": ("b", 5), "b": ("a", 5)}, {})


def test_replay_forms_agree(spark):
    rng = random.Random(1)
    log = spark.createDataFrame([(2 + i // 5, i, rng.randrange(9), rng.choice("UUD"), str(i)) for i in range(200)], "txid long, seq long, pgno long, op string, payload string")
    forms = [replay.asof(log, ["pgno"], 30), replay.asof_max_by(log, ["pgno"], 30), replay.asof_anti(replay.asof(log, ["pgno"], 12), log.where("txid > 12 AND txid <= 30"), ["pgno"])]
    a, b, c = (sorted(map(tuple, f.select("pgno", "payload").collect())) for f in forms)
    assert a == b == c
    chained = {r["txid"]: r["checksum"] for r in replay.checksum_chain(log, ["pgno"]).collect()}
    for t in (2, 17, 41):
        assert chained[t] == replay.checksum(replay.asof(log, ["pgno"], t), "pgno", "payload").first()["checksum"]
    assert replay.asof(log.where("false"), ["pgno"], 3).count() == 0


def test_expressions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(X.parse_duration(F.lit("1h2m3.5s"))) == 3723.5
    assert get(X.parse_bytes(F.lit("2gb"))) == 2 << 30
    assert get(X.parse_member_key(F.lit("data/l/3/segment-000000000000000a-0000000000000009"))).asDict() == {"lineage": "l", "epoch": 3, "is_snapshot": False, "min_txid": 9, "max_txid": 10}
    assert get(X.parse_member_key(F.lit("data/l/base.json"))) is None
    assert get(X.render_float(F.lit(float("inf")))) == "+Inf" and get(X.render_float(F.lit(2.0))) == "2"
    assert get(X.skip_noise(F.lit("-- a\n /* b */ PRAGMA x=1; SELECT 1"))) == "SELECT 1"
    assert get(X.detail_map(F.array(*map(F.lit, ["a", "1", "b", "2", "a", "3", "odd"])))) == {"a": "3", "b": "2"}
    assert get(X.database_header(F.lit(bytes(16) + b"\x00\x01" + bytes(10) + b"\x00\x00\x00\x07"))).asDict() == {"page_size": 65536, "pages": 7}
    s1 = s2 = 0
    words = [0xFFFFFFFF, 5, 7, 0x80000000]
    for a, b in zip(words[::2], words[1::2], strict=True):
        s1 = (s1 + a + s2) % 2**32
        s2 = (s2 + b + s1) % 2**32
    got = get(X.wal_checksum(F.array(*[F.lit(w).cast("long") for w in words]), F.lit(0), F.lit(0)))
    assert (got["s1"], got["s2"]) == (s1, s2)


def test_eviction_stops_at_the_budget(spark):
    entries = spark.createDataFrame([("b", 5, 1), ("a", 5, 1), ("c", 5, 2), ("d", 5, 0)], "path string, bytes long, last_used long")
    assert sorted(r["path"] for r in metrics.evict(entries, 10).collect()) == ["a", "d"]
    assert metrics.evict(entries, 20).count() == 0
