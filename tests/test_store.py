from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest

from larchway.plans.store import Store
from larchway.sources.catalog import CasError, Catalog, Ref, Refused, open_folder
from larchway.streaming.capture import capture, changes, drain

NOW = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), create=True)
    s.create("shop", {"t": (spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string"), ["id"])}, NOW)
    return s


def rows(df):
    return sorted(map(tuple, df.select("id", "v").collect()))


def change(spark, *rows_):
    return {"t": spark.createDataFrame(list(rows_), "id long, v string, op string")}


def test_branches_dont_see_each_other(spark, store):
    store.commit("shop", "main", change(spark, (2, "B", "U"), (3, None, "D"), (4, "d", "U")))
    store.fork("shop", "main", "try", now=NOW)
    store.fork("shop", "main", "copy", share=False, now=NOW)
    store.commit("shop", "main", change(spark, (1, "x", "U")))
    store.commit("shop", "try", change(spark, (2, None, "D")))
    assert rows(store.table("shop", "main", "t")) == [(1, "x"), (2, "B"), (4, "d")]
    assert rows(store.table("shop", "try", "t")) == [(1, "a"), (4, "d")]
    assert rows(store.table("shop", "copy", "t")) == [(1, "a"), (2, "B"), (4, "d")]
    before = store.dump("shop", "try")
    store.compact("shop", "try")
    assert store.dump("shop", "try") == before
    store.promote("shop", "try", "main", force=True)
    assert store.dump("shop", "main") == before
    with pytest.raises(Refused):
        store.promote("shop", "try", "main")
    with pytest.raises(Refused):
        store.promote("shop", "try", "try")


def test_rollback_and_garbage(spark, store):
    store.checkpoint("shop", "main", "good")
    store.commit("shop", "main", change(spark, (1, "broken", "U")))
    assert rows(store.table("shop", "main", "t", at="good")) == [(1, "a"), (2, "b"), (3, "c")]
    store.rollback("shop", "main", "good")
    assert rows(store.table("shop", "main", "t")) == [(1, "a"), (2, "b"), (3, "c")]
    new, deleted = store.gc(60, NOW)
    assert len(new) == 3 and not deleted
    assert store.gc(60, NOW + timedelta(seconds=30)) == ([], [])
    _, deleted = store.gc(60, NOW + timedelta(seconds=61))
    assert sorted(deleted) == sorted(new)
    assert rows(store.table("shop", "main", "t", at="init")) == [(1, "a"), (2, "b"), (3, "c")]


def test_refs_and_leases(tmp_path):
    c = Catalog(str(tmp_path / "c"), create=True)
    c.put("d", "b", Ref("l"), None)
    ref, version = c.get("d", "b")

    def attempt(i):
        try:
            c.put("d", "b", replace(ref, meta={"by": i}), version)
            return 1
        except CasError:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(attempt, range(16))) == 1
    assert c.acquire("d", "b", "one", 30, NOW).epoch == 2
    assert c.acquire("d", "b", "one", 30, NOW).epoch == 2
    with pytest.raises(Refused):
        c.acquire("d", "b", "two", 30, NOW)
    assert c.acquire("d", "b", "two", 30, NOW + timedelta(seconds=31)).epoch == 3
    with pytest.raises(Refused):
        c.renew("d", "b", "one", 2, 30, NOW)
    with pytest.raises(Refused):
        c.destroy("d", "b", NOW + timedelta(seconds=40))
    c.touch("d", "b", NOW, ttl=10)
    assert c.reap(NOW + timedelta(hours=1)) == ["d@b"]
    with pytest.raises(KeyError):
        c.get("d", "b")
    with pytest.raises(ValueError):
        open_folder("ftp://x")


def test_stream_equals_batch(spark, store, tmp_path):
    schema = "id long, v string, op string, txid long, seq long, is_commit boolean"
    log = [(1 + i % 4, f"v{i}", "D" if i % 7 == 6 else "U", i // 3, i, i % 3 == 2) for i in range(20)]  # the last transaction isn't committed
    folder = tmp_path / "in"
    for k in range(0, 20, 5):
        spark.createDataFrame(log[k : k + 5], schema).coalesce(1).write.mode("append").parquet(str(folder))
    ref = store.catalog.acquire("shop", "main", "me", 600, NOW)
    for _ in range(2):  # the second run finds nothing new
        drain(capture(store, changes(spark, str(folder), spark.createDataFrame([], schema).schema), "shop", "main", "t", "me", ref.epoch, str(tmp_path / "cp")))
    state = {1: "a", 2: "b", 3: "c"}
    for key, v, op, *_ in log[:18]:
        state.pop(key, None) if op == "D" else state.update({key: v})
    assert rows(store.table("shop", "main", "t")) == sorted(state.items())


def test_a_losing_writer_changes_nothing(spark, store):
    """Two writers on one version: the loser's member is garbage, and reads see the winner's."""
    real, other = store.catalog.put, Store(spark, str(store.catalog.folder))

    def slow(db, branch, ref, version):
        store.catalog.put = real
        other.commit("shop", "main", change(spark, (1, "winner", "U")))
        return real(db, branch, ref, version)

    store.catalog.put = slow
    with pytest.raises(CasError):
        store.commit("shop", "main", change(spark, (1, "loser", "U")))
    assert rows(store.table("shop", "main", "t")) == [(1, "winner"), (2, "b"), (3, "c")]
    new, _ = store.gc(60, NOW)
    assert len(new) == 1 and rows(other.table("shop", "main", "t"))[0] == (1, "winner")
    with pytest.raises(ValueError):
        store.commit("shop", "main", change(spark, (1, "x", "U"), (1, "y", "U")))


def test_gc_spares_what_is_about_to_be_published(spark, store):
    ref, version = store.catalog.get("shop", "main")
    pick = store._write(ref.lineage, ref.epoch, f"segment-{2:016x}-{2:016x}", {"t": (spark.createDataFrame([(1, "late", "U", 2, 0)], "id long, v string, op string, txid long, seq long"), ["id"])})
    store.gc(60, NOW)
    assert store.gc(60, NOW + timedelta(seconds=100))[1] == []
    store.catalog.put("shop", "main", replace(ref, head_txid=2, picks=[*ref.picks, pick]), version)
    assert rows(store.table("shop", "main", "t"))[0] == (1, "late")


def test_claims_hold_for_the_version_that_was_checked(tmp_path):
    c = Catalog(str(tmp_path / "c"), create=True)
    c.put("d", "b", Ref("l", ttl=10.0, touched_at=NOW.isoformat()), None)
    real, later = c.put, NOW + timedelta(hours=1)

    def slow(db, branch, ref, version):
        c.put = real
        c.touch("d", "b", later)
        return real(db, branch, ref, version)

    c.put = slow
    assert c.reap(later) == [] and not c.get("d", "b")[0].reaping
    c.put = slow
    with pytest.raises(CasError):
        c.destroy("d", "b", later)
    c.update("d", "b", lambda r: replace(r, reaping=True))
    assert c.reap(later) == [] and not c.get("d", "b")[0].reaping
    assert c.reap(later + timedelta(hours=1)) == ["d@b"]


def test_cadence_keeps_few_picks(spark, store):
    for i in range(17):
        store.commit("shop", "main", change(spark, (1, f"v{i}", "U")))
    ref, _ = store.catalog.get("shop", "main")
    assert rows(store.table("shop", "main", "t"))[0] == (1, "v16") and len(ref.picks) <= 4
    assert rows(store.table("shop", "main", "t", at="init"))[0] == (1, "a")
