"""Queries over the operators, each with an independently formulated DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchway.functions import expressions as X
from larchway.operators import chain, diff, gc, metrics, refs, replay
from larchway.plans.fixtures import NOW_E, NOW_O, frames, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TARGET = "(SELECT max(txid) - 2 FROM d_log)"  # a little before the end of the log, at every size


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def now_o():
    return moment("2002-01-01 00:00:00")


def now_e():
    return moment("2024-01-31 00:00:00")


def target(log) -> int:
    """The transaction that TARGET names; 0 for an empty log."""
    return log.agg(F.coalesce(F.max("txid") - 2, F.lit(0))).first()[0]


def query(inputs: tuple[str, ...], oracle: str, recursive: bool = False):
    """Registers fn(*frames) under its name, with an oracle that may name the inputs as tables."""

    def register(fn):
        names = [i for i in inputs if i.startswith("d_")]
        clause = with_clause(*names, recursive=recursive) if names else ""
        text = oracle.strip()
        if text.startswith("WITH"):
            text = (clause + ", " + text.removeprefix("WITH").strip()) if clause else text
        else:
            text = f"{clause}\n{text}"
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(*frames(spark, sf_dir, *inputs))
        ORACLES[fn.__name__] = text
        return fn

    return register


LIVE = f"SELECT pgno, arg_max(op, (txid, seq)) AS op, arg_max(payload, (txid, seq)) AS payload, max(txid) AS txid FROM d_log WHERE txid <= {TARGET} GROUP BY pgno"
ASOF_SQL = f"SELECT pgno, payload, txid FROM ({LIVE}) WHERE op <> 'D'"
DIGEST = "CAST('0x' || substr(md5(CAST(pgno AS VARCHAR) || '|' || payload), 1, 15) AS BIGINT)"


@query(("d_log",), ASOF_SQL)
def asof_replay(log):
    return replay.asof(log, ["pgno"], target(log)).select("pgno", "payload", "txid")


@query(("d_log",), f"SELECT pgno, payload, txid FROM (SELECT * FROM d_log WHERE txid <= {TARGET} QUALIFY row_number() OVER (PARTITION BY pgno ORDER BY seq DESC) = 1) WHERE op = 'U'")
def asof_replay_maxby(log):
    return replay.asof_max_by(log, ["pgno"], target(log)).select("pgno", "payload", "txid")


@query(("d_log",), f"SELECT pgno, payload, txid FROM d_log a WHERE txid <= {TARGET} AND op = 'U' AND NOT EXISTS (SELECT 1 FROM d_log b WHERE b.pgno = a.pgno AND b.seq > a.seq AND b.txid <= {TARGET})")
def asof_replay_antijoin(log):
    last = target(log)
    snapshot = replay.asof(log, ["pgno"], last // 2)
    return replay.asof_anti(snapshot, log.where((F.col("txid") > last // 2) & (F.col("txid") <= last)), ["pgno"]).select("pgno", "payload", "txid")


@query(("d_log",), f"SELECT pgno FROM d_log a WHERE txid <= {TARGET} AND op = 'D' AND NOT EXISTS (SELECT 1 FROM d_log b WHERE b.pgno = a.pgno AND b.seq > a.seq AND b.txid <= {TARGET})")
def replay_deletes(log):
    return replay.latest(log.where(F.col("txid") <= target(log)), ["pgno"]).where("op = 'D'").select("pgno")


@query(
    ("d_log",),
    f"""SELECT pgno, payload, txid FROM d_log a WHERE txid <= {TARGET} AND NOT EXISTS (SELECT 1 FROM d_log b WHERE b.pgno = a.pgno AND b.seq > a.seq AND b.txid <= {TARGET})
    AND pgno <= (SELECT min(commit_size) FROM d_log c WHERE c.txid BETWEEN a.txid AND {TARGET} AND c.is_commit)""",
)
def replay_truncate(log):
    return replay.pages_asof(log, target(log)).select("pgno", "payload", "txid")


@query(("d_log",), "SELECT pgno, arg_max(payload, seq) AS payload FROM d_log WHERE txid > (SELECT max(txid) // 2 FROM d_log) GROUP BY pgno")
def page_set_since_flush(log):
    flushed = (target(log) + 2) // 2
    return replay.latest(log.where(F.col("txid") > flushed), ["pgno"]).select("pgno", "payload")


@query(("d_log",), f"SELECT coalesce(bit_xor({DIGEST}), 0) AS checksum, count(*) AS n_rows FROM ({ASOF_SQL})")
def checksum_full(log):
    return replay.checksum(replay.asof(log, ["pgno"], target(log)), "pgno", "payload")


@query(
    ("d_log",),
    f"""WITH t AS (SELECT DISTINCT txid FROM d_log),
    s AS (SELECT t.txid, l.pgno, arg_max(l.op, l.seq) AS op, arg_max(l.payload, l.seq) AS payload FROM t JOIN d_log l ON l.txid <= t.txid GROUP BY t.txid, l.pgno)
    SELECT t.txid, coalesce(bit_xor({DIGEST}) FILTER (WHERE op = 'U'), 0) AS checksum FROM t LEFT JOIN s ON t.txid = s.txid GROUP BY t.txid""",
)
def checksum_incremental(log):
    return replay.checksum_chain(log, ["pgno"])


@query(("d_log",), "SELECT txid, pgno, arg_max(payload, seq) AS payload FROM d_log WHERE seq < (SELECT max(seq) FROM d_log) AND txid IN (SELECT txid FROM d_log WHERE is_commit AND seq < (SELECT max(seq) FROM d_log)) GROUP BY txid, pgno")
def txn_commit_groups(log):
    torn = log.join(F.broadcast(log.agg(F.max("seq").alias("m"))), F.col("seq") < F.col("m")).drop("m")
    return replay.last_in_transaction(replay.committed(torn), ["pgno"]).select("txid", "pgno", "payload")


@query(
    ("d_log",),
    """WITH f AS (SELECT CAST(floor((txid - 2) / 3) AS BIGINT) AS flush, count(DISTINCT pgno) AS changed, max(txid) AS max_txid, arg_max(commit_size, seq) AS commit_size FROM d_log GROUP BY 1)
    SELECT *, CASE WHEN flush % 4 = 0 OR (commit_size >= 12 AND 2 * changed >= commit_size) THEN 'snapshot' ELSE 'segment' END AS kind FROM f""",
)
def flush_kind(log):
    return replay.flush_kinds(log, cadence=4, every=3, least_pages=12)


@query(("d_obj",), "SELECT lineage, count(*) AS n FROM d_obj a WHERE NOT is_snapshot AND max_txid > coalesce((SELECT max(max_txid) FROM d_obj b WHERE b.lineage = a.lineage AND b.is_snapshot), 0) GROUP BY lineage")
def trailing_segments(members):
    last = members.where("is_snapshot").groupBy("lineage").agg(F.max("max_txid").alias("last"))
    return members.where("NOT is_snapshot").join(last, "lineage", "left").where("max_txid > coalesce(last, 0)").groupBy("lineage").agg(F.count("*").alias("n"))


@query(("d_key",), "SELECT key, lineage, is_snapshot, min_txid, max_txid, epoch FROM (SELECT key, CAST(lineage AS VARCHAR) AS lineage, is_snapshot, min_txid, max_txid, epoch FROM d_key)")
def member_key_parse(keys):
    more = keys.select("key").union(keys.limit(3).select(F.concat("key", F.lit("x"))))
    return more.withColumn("p", X.parse_member_key(F.col("key"))).where("p IS NOT NULL").select("key", "p.lineage", "p.is_snapshot", "p.min_txid", "p.max_txid", "p.epoch")


@query(
    ("d_obj2",),
    """SELECT DISTINCT lineage, is_snapshot, min_txid, max_txid, epoch FROM d_obj2 a WHERE NOT EXISTS (SELECT 1 FROM d_obj2 b WHERE b.lineage = a.lineage AND b.max_txid = a.max_txid
      AND (CASE WHEN a.is_snapshot OR a.min_txid = a.max_txid THEN b.is_snapshot OR b.min_txid = b.max_txid ELSE NOT b.is_snapshot AND b.min_txid = a.min_txid END)
      AND (b.epoch > a.epoch OR (b.epoch = a.epoch AND b.is_snapshot AND NOT a.is_snapshot)))""",
)
def keep_highest_epoch(members):
    return chain.keep_highest_epoch(members)


@query(("d_obj", "d_ref"), "SELECT r.lineage, r.head_txid AS target, (SELECT max(max_txid) FROM d_obj o WHERE o.lineage = r.lineage AND o.is_snapshot AND o.max_txid <= r.head_txid) AS max_txid FROM d_ref r WHERE max_txid IS NOT NULL")
def newest_snapshot_asof(members, branches):
    return chain.newest_snapshot(branches.select("lineage", F.col("head_txid").alias("target")), members)


@query(("d_obj", "d_lin"), "SELECT o.lineage, o.min_txid, o.max_txid FROM d_obj o JOIN d_lin b ON o.lineage = b.lineage WHERE NOT is_snapshot AND o.max_txid BETWEEN b.base_txid + 1 AND b.base_txid + 5")
def segments_in_range(members, bases):
    ranges = bases.select("lineage", F.col("base_txid").alias("lo"), (F.col("base_txid") + 5).alias("hi"))
    return chain.segments_between(ranges, members).select("lineage", "min_txid", "max_txid")


@query(("d_obj",), "WITH s AS (SELECT * FROM d_obj WHERE NOT is_snapshot) SELECT lineage, (SELECT max(max_txid) FROM s b WHERE b.lineage = a.lineage AND b.max_txid < a.max_txid) AS before, min_txid, max_txid FROM s a WHERE before IS NOT NULL AND before + 1 <> min_txid")
def contiguity_holes(members):
    return chain.holes(members.where("o_orderkey % 5 <> 0"))


@query(("d_lin", "d_ref"), "WITH s(id, lineage, hi, depth) AS (SELECT lineage, lineage, head_txid, 0 FROM d_ref UNION ALL SELECT id, base_lineage, least(hi, base_txid), depth + 1 FROM s JOIN d_lin USING (lineage)) SELECT id, lineage, hi, CAST(depth AS BIGINT) AS depth FROM s", recursive=True)
def base_spine(bases, branches):
    targets = branches.select(F.col("lineage").alias("id"), "lineage", F.col("head_txid").alias("target"))
    return chain.spine_recursive(targets, bases).select("id", "lineage", "hi", F.col("depth").cast("long").alias("depth"))


@query(("d_lin", "d_ref"), "WITH s(id, lineage, hi, depth) AS (SELECT lineage, lineage, head_txid, 0 FROM d_ref UNION ALL SELECT id, base_lineage, least(hi, base_txid), depth + 1 FROM s JOIN d_lin USING (lineage)) SELECT id, lineage, hi, CAST(depth AS BIGINT) AS depth FROM s", recursive=True)
def base_spine_iterated(bases, branches):
    targets = branches.select(F.col("lineage").alias("id"), "lineage", F.col("head_txid").alias("target"))
    return chain.spine(targets, bases).select("id", "lineage", "hi", F.col("depth").cast("long").alias("depth"))


# the chain rules over tables t(id, lineage, target), d_lin and m (members)
CHAIN_SQL = """
own AS (SELECT DISTINCT lineage, is_snapshot, min_txid, max_txid, epoch FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.lineage = a.lineage AND b.max_txid = a.max_txid
  AND (CASE WHEN a.is_snapshot OR a.min_txid = a.max_txid THEN b.is_snapshot OR b.min_txid = b.max_txid ELSE NOT b.is_snapshot AND b.min_txid = a.min_txid END)
  AND (b.epoch > a.epoch OR (b.epoch = a.epoch AND b.is_snapshot AND NOT a.is_snapshot)))),
s(id, lineage, hi, depth) AS (SELECT id, lineage, target, 0 FROM t UNION ALL SELECT id, base_lineage, least(hi, base_txid), depth + 1 FROM s JOIN d_lin USING (lineage)),
lv AS (SELECT s.*, b.base_txid, (SELECT max(max_txid) FROM own o WHERE o.lineage = s.lineage AND o.is_snapshot AND o.max_txid <= s.hi) AS anchor
  FROM s LEFT JOIN d_lin b USING (lineage) WHERE b.base_txid IS NULL OR s.hi > b.base_txid),
st AS (SELECT id, min(depth) AS stop FROM lv WHERE anchor IS NOT NULL GROUP BY id),
ac AS (SELECT lv.*, st.stop, CASE WHEN depth = stop THEN anchor ELSE base_txid END AS lo FROM lv JOIN st USING (id) WHERE depth <= stop),
sg AS (SELECT ac.id, ac.depth, ac.stop, ac.lo, ac.hi, o.lineage, o.min_txid, o.max_txid, o.epoch FROM ac JOIN own o ON o.lineage = ac.lineage AND NOT o.is_snapshot AND o.max_txid > ac.lo AND o.max_txid <= ac.hi),
sk AS (SELECT * FROM sg a WHERE (depth < stop AND max_txid < hi) OR NOT EXISTS (SELECT 1 FROM sg b WHERE b.id = a.id AND b.depth = a.depth AND b.max_txid = a.max_txid AND b.min_txid < a.min_txid)),
ck AS (SELECT id, depth, min_txid, max_txid, min_txid = 1 + coalesce(arg_max_null_before, lo) AS good FROM (
  SELECT sk.*, lag(max_txid) OVER (PARTITION BY id, depth ORDER BY max_txid, min_txid) AS arg_max_null_before FROM sk)),
pl AS (SELECT ac.id, ac.depth, (SELECT count(*) FROM ck WHERE ck.id = ac.id AND ck.depth = ac.depth) AS n,
  coalesce((SELECT bool_and(good) FROM ck WHERE ck.id = ac.id AND ck.depth = ac.depth), ac.depth = ac.stop) AND coalesce((SELECT max(max_txid) FROM ck WHERE ck.id = ac.id AND ck.depth = ac.depth), ac.lo) = ac.hi AS good FROM ac),
vd AS (SELECT t.id, coalesce(p.good, false) AS ok, CASE WHEN p.good THEN CAST(p.n + 1 AS BIGINT) ELSE 0 END AS length
  FROM t LEFT JOIN (SELECT id, bool_and(good) AS good, sum(n) AS n FROM pl GROUP BY id) p USING (id)),
cn AS (SELECT ac.id, ac.lineage, true AS is_snapshot, CAST(0 AS BIGINT) AS min_txid, ac.anchor AS max_txid, o.epoch FROM ac JOIN own o ON o.lineage = ac.lineage AND o.is_snapshot AND o.max_txid = ac.anchor WHERE ac.depth = ac.stop
  UNION ALL SELECT id, lineage, false, min_txid, max_txid, epoch FROM sk)"""
HEADS_SQL = "WITH t AS (SELECT 'x' || CAST(lineage AS VARCHAR) || '@' || CAST(k AS VARCHAR) AS id, lineage, greatest(head_txid - k, 0) AS target FROM d_ref, (VALUES (0), (1), (2)) v(k)), "


def head_targets(branches):
    back = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    all_ = branches.select("lineage", "head_txid", back)
    return all_.select(F.concat(F.lit("x"), F.col("lineage").cast("string"), F.lit("@"), F.col("k").cast("string")).alias("id"), "lineage", F.greatest(F.col("head_txid") - F.col("k"), F.lit(0)).alias("target"))


@query(("d_lin", "d_obj2", "d_ref"), HEADS_SQL + "m AS (SELECT * FROM d_obj2)," + CHAIN_SQL + " SELECT id, ok, length FROM vd", recursive=True)
def chain_verdict(bases, members, branches):
    return chain.resolve(head_targets(branches), bases, members)[1]


@query(("d_lin", "d_obj2", "d_ref"), HEADS_SQL + "m AS (SELECT * FROM d_obj2)," + CHAIN_SQL + " SELECT id, lineage, is_snapshot, min_txid, max_txid, epoch FROM cn WHERE id IN (SELECT id FROM vd WHERE ok)", recursive=True)
def chain_resolve(bases, members, branches):
    return chain.resolve(head_targets(branches), bases, members)[0].drop("depth")


@query(("d_lin", "d_obj", "d_ref"), HEADS_SQL + "m AS (SELECT lineage, is_snapshot, min_txid, max_txid, epoch FROM d_obj)," + CHAIN_SQL + " SELECT id, length, CASE WHEN NOT ok THEN 'error' WHEN length < 4 THEN 'share' ELSE 'materialize' END AS decision, ok AND length = 1 AS one_snapshot FROM vd", recursive=True)
def fork_share_decision(bases, members, branches):
    targets = head_targets(branches)
    return refs.fork_decision(targets, chain.resolve(targets, bases, members.drop("o_orderkey"))[1], bound=4)


@query(("d_ref", "d_cp"), "SELECT c.lineage, count(*) AS kept, count(DISTINCT c.txid) AS to_write, max(c.txid) AS last_txid FROM d_cp c WHERE c.txid <= (SELECT max(head_txid) - 2 FROM d_ref r WHERE r.lineage = c.lineage) GROUP BY c.lineage")
def rollback_plan(branches, checkpoints):
    return refs.rollback_plan(branches.select("lineage", (F.col("head_txid") - 2).alias("target")), checkpoints)


@query(("d_ref",), f"SELECT db, branch, CASE WHEN lineage % 10 = 1 THEN 'refused: itself' WHEN protected THEN 'refused: protected' ELSE 'ok' END AS verdict, CASE WHEN lineage % 10 = 1 OR protected THEN lineage ELSE lineage + 1000000 END AS new_lineage, CASE WHEN protected THEN 'refused: protected' WHEN holder IS NOT NULL AND lease_expiry > {NOW_O} THEN 'refused: leased' ELSE 'ok' END AS destroy FROM d_ref")
def promote_plan(branches):
    source = F.when(F.col("lineage") % 10 == 1, F.col("branch")).otherwise("main")
    verdict = refs.promote_guard(source, F.col("branch"), F.col("protected"))
    return branches.select("db", "branch", verdict.alias("verdict"), F.when(verdict == "ok", F.col("lineage") + 1_000_000).otherwise(F.col("lineage")).alias("new_lineage"), refs.destroy_guard(now_o()).alias("destroy"))


@query(("d_ref",), "SELECT db, branch, CASE WHEN shared THEN lineage + 1000000 ELSE lineage END AS new_lineage, CASE WHEN shared THEN 'compact' END AS checkpoint FROM d_ref")
def compact_plan(branches):
    return branches.select("db", "branch", F.when(F.col("shared"), F.col("lineage") + 1_000_000).otherwise(F.col("lineage")).alias("new_lineage"), F.when(F.col("shared"), "compact").alias("checkpoint"))


MARK_SQL = "WITH t AS (SELECT CAST(lineage AS VARCHAR) || '@' || CAST(target AS VARCHAR) AS id, lineage, target FROM (SELECT lineage, head_txid AS target FROM d_ref UNION SELECT lineage, txid FROM d_cp)), m AS (SELECT lineage, is_snapshot, min_txid, max_txid, epoch FROM d_obj)," + CHAIN_SQL + """,
mk AS (SELECT DISTINCT 'data/' || CAST(lineage AS VARCHAR) || '/' || CAST(epoch AS VARCHAR) || CASE WHEN is_snapshot THEN '/snapshot-' || printf('%016x', max_txid) ELSE '/segment-' || printf('%016x', max_txid) || '-' || printf('%016x', min_txid) END AS key FROM cn WHERE id IN (SELECT id FROM vd WHERE ok))"""


def marked(branches, checkpoints, bases, members):
    targets = gc.marks(branches, checkpoints)
    return gc.reachable(targets, bases, members.select("lineage", "is_snapshot", "min_txid", "max_txid", "epoch"))[0]


@query(("d_ref", "d_cp", "d_lin", "d_obj"), MARK_SQL + " SELECT key FROM mk", recursive=True)
def gc_reachable(branches, checkpoints, bases, members):
    return marked(branches, checkpoints, bases, members)


@query(("d_ref", "d_cp", "d_lin", "d_obj", "d_key"), MARK_SQL + " SELECT key FROM d_key EXCEPT SELECT key FROM mk", recursive=True)
def gc_unreachable(branches, checkpoints, bases, members, keys):
    return gc.unreachable(keys.select("key"), marked(branches, checkpoints, bases, members))


@query(
    ("d_ref", "d_cp", "d_lin", "d_obj", "d_key", "d_tomb"),
    MARK_SQL
    + """ SELECT s.key, CASE WHEN marked_at > TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 1 HOUR THEN 'waiting' WHEN EXISTS (SELECT 1 FROM mk WHERE mk.key = s.key) THEN 'rescued'
    WHEN NOT EXISTS (SELECT 1 FROM d_key k WHERE k.key = s.key) THEN 'pruned'
    WHEN EXISTS (SELECT 1 FROM d_key k JOIN (SELECT lineage, min(head_txid) AS h, min(epoch) AS e FROM d_ref GROUP BY lineage) r ON r.lineage = k.lineage WHERE k.key = s.key AND k.max_txid > r.h AND k.epoch >= r.e) THEN 'guarded' ELSE 'deleted' END AS verdict FROM d_tomb s""",
    recursive=True,
)
def gc_sweep_verdict(branches, checkpoints, bases, members, keys, stones):
    heads = gc.live_heads(branches)
    return gc.sweep_verdict(stones, marked(branches, checkpoints, bases, members), keys, heads, moment("2000-01-01 00:00:00"), 3600)


@query(("d_ref",), "SELECT DISTINCT lineage, min(head_txid) OVER (PARTITION BY lineage) AS head_txid, min(epoch) OVER (PARTITION BY lineage) AS head_epoch FROM d_ref")
def live_heads(branches):
    return gc.live_heads(branches)


DEADLINE = "CASE ttl WHEN '1h' THEN greatest(touched_at, lease_expiry) + INTERVAL 1 HOUR WHEN '24h' THEN greatest(touched_at, lease_expiry) + INTERVAL 24 HOUR WHEN '720h30m' THEN greatest(touched_at, lease_expiry) + INTERVAL 720 HOUR + INTERVAL 30 MINUTE END"


@query(("d_ref",), f"SELECT db, branch FROM d_ref WHERE NOT protected AND {DEADLINE} <= {NOW_O}")
def reap_eligible(branches):
    return refs.reap_eligible(branches, now_o()).select("db", "branch")


@query(("d_ref",), f"SELECT db, branch, CASE WHEN dl IS NULL THEN '' WHEN dl < {NOW_O} THEN 'expired' WHEN n = 0 THEN '0s' WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm' || (n % 60) || 's' ELSE (n // 3600) || 'h' || (n // 60 % 60) || 'm' || (n % 60) || 's' END AS ttl_left FROM (SELECT *, (epoch_us(dl) - epoch_us({NOW_O})) // 1000000 AS n FROM (SELECT *, {DEADLINE} AS dl FROM d_ref))")
def ttl_remaining(branches):
    return branches.select("db", "branch", refs.ttl_remaining(now_o()).alias("ttl_left"))


@query(("d_ref",), f"SELECT db, branch, holder, epoch, lease_expiry, CASE WHEN lease_expiry > {NOW_O} THEN 'live' ELSE 'expired' END AS state FROM d_ref WHERE holder IS NOT NULL")
def lease_list(branches):
    return refs.leases(branches, now_o())


@query(("d_ref",), f"WITH v AS (SELECT db, branch, epoch, CASE WHEN reaping OR deleting THEN 'refused: going' WHEN lease_expiry > {NOW_O} AND holder = 'h1' THEN 'renewed' WHEN lease_expiry > {NOW_O} THEN 'refused: held' ELSE 'acquired' END AS verdict FROM d_ref) SELECT db, branch, verdict, epoch + CAST(verdict = 'acquired' AS BIGINT) AS new_epoch FROM v")
def lease_acquire(branches):
    return refs.acquire(branches, "h1", now_o()).select("db", "branch", "verdict", "new_epoch")


@query(("d_ref",), "SELECT db, branch FROM d_ref WHERE deleting AND deleting_at + INTERVAL 30 SECOND < TIMESTAMP '1999-06-01 00:00:00'")
def stale_claims(branches):
    return refs.stale_claims(branches, moment("1999-06-01 00:00:00")).select("db", "branch")


@query(("d_ref", "d_sess"), "SELECT db, branch FROM d_ref EXCEPT SELECT db, branch FROM d_sess WHERE state = 'open'")
def refuse_if_open(branches, sessions):
    return refs.refuse_if_open(branches, sessions).select("db", "branch")


@query(
    ("d_ref", "d_side", "d_sess"),
    f"""SELECT r.db, r.branch, CASE WHEN e.error <> '' THEN 'error' WHEN e.state = 'pending' THEN 'pending' WHEN r.lease_expiry > {NOW_O} THEN 'active' WHEN s.db IS NULL THEN 'idle' WHEN s.side_lineage <> r.lineage THEN 'detached'
    WHEN s.side_txid <> r.head_txid OR s.side_epoch <> r.head_epoch THEN 'idle' WHEN s.side_hash <> s.file_hash OR s.busy THEN 'dirty' ELSE 'idle' END AS state,
    CASE WHEN s.db IS NULL THEN 'unknown' WHEN s.side_lineage <> r.lineage OR s.side_epoch <> r.head_epoch OR s.side_txid <> r.head_txid THEN 'stale' WHEN s.side_hash <> s.file_hash THEN 'modified' ELSE 'clean' END AS checkout, CASE WHEN r.shared THEN 'shared' ELSE 'own' END AS storage
    FROM d_ref r LEFT JOIN d_side s ON r.db = s.db AND r.branch = s.branch LEFT JOIN d_sess e ON r.db = e.db AND r.branch = e.branch""",
)
def branch_state(branches, sides, sessions):
    return refs.status(branches, sides, sessions, now_o()).select("db", "branch", "state", "checkout", "storage")


@query(("d_ref",), "SELECT DISTINCT db FROM d_ref")
def databases(branches):
    return refs.databases(branches)


@query(("d_ref",), "SELECT db, count(*) AS n, string_agg(branch, ',' ORDER BY branch) AS branches FROM d_ref GROUP BY db")
def refs_by_db(branches):
    return refs.branches_by_database(branches)


@query(("d_str",), "SELECT id, target, length(target) BETWEEN 1 AND 128 AND regexp_full_match(target, '[a-z0-9._-]+') AND target NOT IN ('.', '..') AND NOT contains(target, '..') AS valid FROM d_str")
def name_validate(strings):
    return strings.select("id", "target", X.valid_name(F.col("target")).alias("valid"))


TARGET_SQL = "WITH p AS (SELECT id, target, string_split(target, '@') AS p FROM d_str), g AS (SELECT *, {n} >= len(p) AND NOT list_contains(p, '') AS good FROM p) SELECT id, CASE WHEN good THEN p[1] END AS db, CASE WHEN good THEN coalesce(p[2], 'main') END AS branch, CASE WHEN good THEN p[3] END AS checkpoint FROM g"


@query(("d_str",), TARGET_SQL.replace("{n}", "2"))
def target_parse(strings):
    return strings.withColumn("p", X.parse_target(F.col("target"))).select("id", "p.db", "p.branch", "p.checkpoint")


@query(("d_str",), TARGET_SQL.replace("{n}", "3"))
def export_target_parse(strings):
    return strings.withColumn("p", X.parse_target(F.col("target"), 3)).select("id", "p.db", "p.branch", "p.checkpoint")


@query(("d_str",), "WITH c AS (SELECT id, s, trim(regexp_replace(lower(s), '[^a-z0-9-]+', '-', 'g'), '-') AS c FROM d_str) SELECT id, coalesce(nullif(trim(substr(c, 1, 40), '-'), ''), 'id') || '-' || substr(sha256(s), 1, 8) AS name FROM c")
def sanitize_id(strings):
    return strings.select("id", X.sanitize_id(F.col("s")).alias("name"))


@query(("d_str",), r"""WITH p AS (SELECT id, size, regexp_extract(upper(trim(size)), '^([+-]?[0-9]+)\s*([KMGT]?)B?$', 1) AS d, regexp_extract(upper(trim(size)), '^([+-]?[0-9]+)\s*([KMGT]?)B?$', 2) AS u FROM d_str),
    v AS (SELECT id, size, TRY_CAST(d AS HUGEINT) AS n, CAST(CASE u WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 WHEN 'T' THEN 1099511627776 ELSE 1 END AS HUGEINT) AS m FROM p)
    SELECT id, size, CASE WHEN size = '' THEN 0 WHEN n >= 0 AND n <= 9223372036854775807 // m THEN CAST(n * m AS BIGINT) END AS n FROM v""")
def parse_bytes(strings):
    return strings.select("id", "size", X.parse_bytes(F.col("size")).alias("n"))


@query(("d_str",), "SELECT id, dur, CASE id % 8 WHEN 0 THEN 5400.0 WHEN 1 THEN 45.0 WHEN 2 THEN 0.0 WHEN 3 THEN 5400.0 WHEN 5 THEN 0.25 WHEN 6 THEN -120.0 END::DOUBLE AS seconds FROM d_str")
def parse_duration(strings):
    return strings.select("id", "dur", X.parse_duration(F.col("dur")).alias("seconds"))


@query(("d_str",), """SELECT id, replace(replace(label, '\\', '\\\\'), '"', '\\"') AS label, '"' || replace(label, '"', '""') || '"' AS quoted FROM d_str""")
def label_escape(strings):
    return strings.select("id", X.escape_label(F.col("label")).alias("label"), X.quote_identifier(F.col("label")).alias("quoted"))


@query(("d_str",), "SELECT id, CASE WHEN strpos(flag, '=') > 1 THEN split_part(flag, '=', 1) END AS key, CASE WHEN strpos(flag, '=') > 1 THEN substr(flag, strpos(flag, '=') + 1) END AS value, id % 100 < 65 AND length(s) <= 512 AS fits FROM d_str")
def meta_caps(strings):
    meta = F.create_map(F.concat(F.lit("k"), F.repeat(F.lit("x"), F.greatest((F.col("id") % 100).cast("int") - 1, F.lit(0)))), F.col("s"))
    return strings.withColumn("m", X.parse_meta(F.col("flag"))).select("id", "m.key", "m.value", X.valid_meta(meta).alias("fits"))


SIDES = "l AS (SELECT o_orderpriority AS t, count(*) AS n FROM d_left GROUP BY 1), r AS (SELECT o_orderpriority AS t, count(*) AS n FROM d_right GROUP BY 1), u AS (SELECT t FROM l UNION SELECT t FROM r), d AS (SELECT u.t AS \"table\", l.n AS left_n, r.n AS right_n, CASE WHEN l.n IS NULL THEN 'added' WHEN r.n IS NULL THEN 'removed' WHEN l.n <> r.n THEN 'changed' ELSE 'same' END AS status, coalesce(r.n, 0) - coalesce(l.n, 0) AS delta FROM u LEFT JOIN l ON l.t = u.t LEFT JOIN r ON r.t = u.t)"


def sides(left, right):
    count = lambda df: df.groupBy(F.col("o_orderpriority").alias("table")).agg(F.count("*").alias("n"))
    return diff.diff_summary(count(left), count(right))


@query(("d_left", "d_right"), f"WITH {SIDES} SELECT * FROM d")
def diff_summary(left, right):
    return sides(left, right)


@query(("d_left", "d_right"), f"WITH {SIDES} SELECT count(*) FILTER (WHERE status = 'same') AS same, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed FROM d")
def diff_totals(left, right):
    return diff.diff_totals(sides(left, right))


@query(
    ("d_left", "d_right"),
    """SELECT o_orderkey, 'update' AS op, o_orderstatus, o_orderpriority FROM (SELECT * FROM d_right EXCEPT SELECT * FROM d_left) WHERE o_orderkey IN (SELECT o_orderkey FROM d_left)
    UNION ALL SELECT o_orderkey, 'insert', o_orderstatus, o_orderpriority FROM d_right WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d_left)
    UNION ALL SELECT o_orderkey, 'delete', o_orderstatus, o_orderpriority FROM d_left WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d_right)""",
)
def diff_rows(left, right):
    return diff.diff_rows(left, right, ["o_orderkey"])


@query(("customer", "orders", "part"), "SELECT 'customer' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def table_row_counts(customer, orders, part):
    return diff.row_counts({"customer": customer, "orders": orders, "part": part})


@query(("d_cache",), "WITH r AS (SELECT *, coalesce((SELECT sum(bytes) FROM d_cache b WHERE (b.last_used, b.path) < (a.last_used, a.path)), 0)::BIGINT AS freed_before FROM d_cache a) SELECT path, freed_before FROM r WHERE (SELECT sum(bytes) FROM d_cache) - freed_before > 500000")
def lru_evict(entries):
    return metrics.evict(entries, 500_000).select("path", "freed_before")


@query(("d_cache",), "SELECT sum(bytes)::BIGINT AS bytes, count(*) AS n FROM d_cache")
def cache_usage(entries):
    return metrics.usage(entries)


@query(("d_evt",), "WITH k AS (SELECT db, t AS type FROM (SELECT DISTINCT db FROM d_evt), (VALUES ('session_opened'), ('flushed'), ('flush_failed'), ('fenced'), ('session_closed')) v(t)), e AS (SELECT db, CASE raw WHEN 'opened' THEN 'session_opened' WHEN 'flushed' THEN 'flushed' WHEN 'flush-failed' THEN 'flush_failed' WHEN 'closed' THEN 'session_closed' WHEN 'fenced' THEN 'fenced' END AS type FROM d_evt) SELECT k.db, k.type, count(e.db) AS value FROM k LEFT JOIN e ON k.db = e.db AND k.type = e.type GROUP BY ALL")
def metrics_counter(events):
    types = F.explode(F.array(*[F.lit(v) for v in X.EVENT_TYPES.values()])).alias("type")
    return metrics.counter(metrics.kept_events(events), ["db", "type"], events.select("db").distinct().select("db", types))


@query(("d_evt",), "SELECT db, le, count(d.seq) FILTER (WHERE duration <= b) AS n FROM d_evt d, (VALUES ('0.001', 0.001), ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1', 1.0), ('2.5', 2.5), ('5', 5.0), ('10', 10.0), ('30', 30.0), ('60', 60.0), ('120', 120.0), ('300', 300.0), ('+Inf', 'infinity'::DOUBLE)) v(le, b) GROUP BY db, le")
def metrics_histogram(events):
    return metrics.histogram(events, ["db"], "duration")


@query(("d_evt",), "SELECT db, arg_max(kind, seq) AS value FROM d_evt GROUP BY db")
def metrics_gauge(events):
    return metrics.gauge(events, ["db"], "kind", ["ts", "seq"])


@query(("d_evt",), "SELECT CASE raw WHEN 'flushed' THEN 'ok' ELSE 'error' END AS result, CASE kind WHEN 'odd' THEN 'manual' ELSE kind END AS kind, count(*) AS value FROM d_evt WHERE raw IN ('flushed', 'flush-failed') GROUP BY ALL")
def metrics_flush_counter(events):
    return metrics.flush_counter(metrics.kept_events(events))


@query(("d_evt",), f"SELECT branch, (epoch_us({NOW_E}) - epoch_us(max(ts))) / 1000000 AS age FROM d_evt WHERE raw = 'flushed' GROUP BY branch")
def durable_age(events):
    return metrics.durable_age(metrics.kept_events(events), ["branch"], now_e())


@query(("d_log",), "WITH o AS (SELECT pgno, arg_max(seq * 40, seq) AS size, arg_max(txid * 390, seq) AS consumed, arg_max(commit_size * 3, seq) AS dead FROM d_log GROUP BY pgno) SELECT pgno, CASE WHEN size > greatest(consumed, dead) THEN size - greatest(consumed, dead) ELSE 0 END AS lag FROM o")
def capture_lag(log):
    return metrics.capture_lag(log.select("pgno", "seq", (F.col("seq") * 40).alias("size"), (F.col("txid") * 390).alias("consumed"), (F.col("commit_size") * 3).alias("dead")), "pgno")


@query(("d_evt",), "WITH s AS (SELECT *, NOT EXISTS (SELECT 1 FROM d_evt b WHERE b.branch = a.branch AND (b.ts, b.seq) < (a.ts, a.seq) AND b.ts >= a.ts - INTERVAL 43200 SECOND) AS new FROM d_evt a), r AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY branch ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT branch, run, count(*) AS n, min(ts) AS first, max(ts) AS last, CAST(count(*) // 4 AS BIGINT) AS full FROM r GROUP BY branch, run")
def takeover_sessions(events):
    return metrics.takeovers(events, "branch", 43_200, 4)


@query(("d_evt",), "SELECT seq, CASE raw WHEN 'opened' THEN 'session_opened' WHEN 'flushed' THEN 'flushed' WHEN 'flush-failed' THEN 'flush_failed' WHEN 'closed' THEN 'session_closed' WHEN 'fenced' THEN 'fenced' END AS type FROM d_evt WHERE type IS NOT NULL")
def event_map(events):
    return metrics.kept_events(events).select("seq", "type")


@query(("d_evt",), "WITH s AS (SELECT db, seq, CASE WHEN seq % 5 < 4 THEN 1 ELSE -1 END AS step FROM d_evt) SELECT db, min(seq) AS seq FROM s a WHERE step = 1 AND (SELECT sum(step) FROM s b WHERE b.db = a.db AND b.seq < a.seq) >= 64 GROUP BY db")
def slow_consumer(events):
    return metrics.slow_consumers(events.select("db", "seq", F.when(F.col("seq") % 5 < 4, 1).otherwise(-1).alias("step")), "db")


@query(("d_evt",), "SELECT 'flushes_total{db=\"' || db || '\",kind=\"' || kind || '\"} ' || CAST(count(*) AS VARCHAR) AS line FROM d_evt GROUP BY db, kind")
def metrics_exposition(events):
    return metrics.exposition("flushes_total", metrics.counter(events, ["db", "kind"]), ["db", "kind"])


@query(("events",), "SELECT epoch_ms(epoch_ms(ts) // 3600000 * 3600000)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(events):
    return events.groupBy(X.hour_of_millis(F.col("ts")).alias("hour"), "event_type").agg(F.count("*").alias("n"))
