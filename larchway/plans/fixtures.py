"""Inputs of the registered queries, derived from the test tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: Name to SQL over the test tables and the fixtures before it. Integer division is floor(a / b).
FIXTURES = {
    # the change log: transactions of ten events; a page is a user, an error deletes it
    "d_log": """SELECT CAST(2 + floor(event_id / 10) AS BIGINT) AS txid, event_id AS seq, user_id + 1 AS pgno,
        CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, event_type || '|' || props AS payload, event_id % 10 = 9 AS is_commit,
        CAST(n - (CAST(2 + floor(event_id / 10) AS BIGINT) * 37) % greatest(CAST(floor(n / 3) AS BIGINT), 1) AS BIGINT) AS commit_size
        FROM events CROSS JOIN (SELECT max(user_id) + 1 AS n FROM events) m""",
    "d_lin": """SELECT c_custkey AS lineage, CAST(floor(c_custkey / 2) AS BIGINT) AS base_lineage, 1 + CAST(floor(c_custkey / 2) AS BIGINT) % 3 AS base_txid
        FROM customer WHERE c_custkey >= 2""",
    "d_obj": """SELECT lineage, is_snapshot, CASE WHEN is_snapshot THEN 0 ELSE max_txid END AS min_txid, max_txid, epoch, o_orderkey FROM (
          SELECT o_custkey AS lineage, (b.base_txid IS NULL AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) OR o_orderkey % 5 = 0 AS is_snapshot,
            coalesce(b.base_txid, 0) + CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS max_txid, 1 + o_orderkey % 3 AS epoch, o_orderkey
          FROM orders LEFT JOIN d_lin b ON o_custkey = b.lineage) x""",
    # some members again under another epoch, some lost
    "d_obj2": """SELECT lineage, is_snapshot, min_txid, max_txid, epoch FROM d_obj WHERE o_orderkey % 17 <> 0
        UNION ALL SELECT lineage, NOT is_snapshot, CASE WHEN is_snapshot THEN max_txid ELSE 0 END, max_txid, 1 + (epoch + o_orderkey) % 4 FROM d_obj WHERE o_orderkey % 7 = 0
        UNION ALL SELECT lineage, false, max_txid - 1, max_txid, epoch FROM d_obj WHERE o_orderkey % 11 = 0 AND max_txid > 2""",
    "d_ref": """SELECT lower(replace(n_name, ' ', '_')) AS db, 'b' || CAST(c_custkey AS VARCHAR(20)) AS branch, c_custkey AS lineage, 1 + c_custkey % 3 AS epoch,
          coalesce(h.head, b.base_txid, 0) AS head_txid, c_custkey % 50 = 1 AS protected, b.lineage IS NOT NULL AS shared,
          CASE WHEN l.o_orderstatus = 'P' THEN 'h' || CAST(c_custkey % 7 AS VARCHAR(20)) END AS holder,
          CASE WHEN l.o_orderstatus = 'P' THEN l.o_orderdate + INTERVAL '30' DAY END AS lease_expiry,
          CASE l.o_orderpriority WHEN '1-URGENT' THEN '1h' WHEN '2-HIGH' THEN '24h' WHEN '3-MEDIUM' THEN '720h30m' WHEN '5-LOW' THEN 'bad' END AS ttl,
          l.o_orderdate AS touched_at, c_custkey % 17 = 3 AS reaping, c_custkey % 13 = 5 AS deleting, CASE WHEN c_custkey % 13 = 5 THEN l.o_orderdate END AS deleting_at,
          CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 1 + c_custkey % 3 END AS head_epoch
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN d_lin b ON c_custkey = b.lineage
        LEFT JOIN (SELECT lineage, max(max_txid) AS head FROM d_obj GROUP BY lineage) h ON c_custkey = h.lineage
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o WHERE rn = 1) l ON c_custkey = l.o_custkey""",
    "d_cp": """SELECT d.lineage, 'cp' || CAST(d.o_orderkey AS VARCHAR(20)) AS name, d.max_txid AS txid FROM d_obj d JOIN orders o ON d.o_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' AND d.o_orderkey % 4 = 0""",
    "d_key": """SELECT 'data/' || CAST(lineage AS VARCHAR(20)) || '/' || CAST(epoch AS VARCHAR(20)) || CASE WHEN is_snapshot THEN '/snapshot-' || lpad(lower(hex(max_txid)), 16, '0')
          ELSE '/segment-' || lpad(lower(hex(max_txid)), 16, '0') || '-' || lpad(lower(hex(min_txid)), 16, '0') END AS key, lineage, is_snapshot, min_txid, max_txid, epoch, o_orderkey FROM d_obj""",
    "d_tomb": """SELECT key, o.o_orderdate AS marked_at FROM d_key k JOIN orders o ON k.o_orderkey = o.o_orderkey WHERE k.o_orderkey % 4 = 0
        UNION ALL SELECT 'data/gone/1/snapshot-' || lpad(lower(hex(o_orderkey)), 16, '0'), o_orderdate FROM orders WHERE o_orderkey % 9 = 0""",
    "d_left": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'",
    "d_right": """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders
        WHERE (o_orderdate < TIMESTAMP '2000-01-01 00:00:00' AND o_orderkey % 11 <> 0 AND o_orderpriority <> '2-HIGH') OR (o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' AND o_orderkey % 3 = 0 AND o_orderpriority <> '1-URGENT')""",
    "d_evt": """SELECT event_id AS seq, ts, 'db' || CAST(user_id % 3 AS VARCHAR(20)) AS db, user_id AS branch,
          CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'flushed' WHEN 'error' THEN 'flush-failed' WHEN 'purchase' THEN 'closed' ELSE event_type END AS raw,
          CASE WHEN event_id % 2 = 0 THEN 'timer' WHEN event_id % 3 = 0 THEN 'odd' ELSE 'checkpoint' END AS kind, value / 100 AS duration FROM events""",
    "d_cache": "SELECT doc_id, n_chars AS bytes, (doc_id * 7919) % 1000 AS last_used, lpad(CAST(doc_id AS VARCHAR(20)), 12, '0') AS path FROM documents",
    "d_side": """SELECT db, branch, lineage + CASE WHEN lineage % 5 = 0 THEN 1 ELSE 0 END AS side_lineage, head_txid - CASE WHEN lineage % 4 = 0 THEN 1 ELSE 0 END AS side_txid, head_epoch - CASE WHEN lineage % 9 = 1 THEN 1 ELSE 0 END AS side_epoch,
          lineage * 31 AS side_hash, lineage * 31 + CASE WHEN lineage % 3 = 0 THEN 1 ELSE 0 END AS file_hash, lineage % 6 = 0 AS busy FROM d_ref WHERE lineage % 7 <> 0""",
    "d_sess": """SELECT db, branch, CASE WHEN lineage % 2 = 0 THEN 'open' WHEN lineage % 3 = 0 THEN 'pending' ELSE 'closed' END AS state, CASE WHEN lineage % 8 = 0 THEN 'disk full' ELSE '' END AS error
        FROM d_ref WHERE lineage % 3 = 0""",
    "d_str": """SELECT c_custkey AS id, c_name AS s, CASE c_custkey % 7 WHEN 0 THEN lower(replace(c_name, '#', '-')) WHEN 1 THEN 'a..b' WHEN 2 THEN 'db@x' WHEN 3 THEN 'db@x@y' WHEN 4 THEN 'db' WHEN 5 THEN '' ELSE 'a@b@c@d' END AS target,
          CASE c_custkey % 8 WHEN 0 THEN '1h30m' WHEN 1 THEN '45s' WHEN 2 THEN 'none' WHEN 3 THEN '1.5h' WHEN 4 THEN 'abc' WHEN 5 THEN '250ms' WHEN 6 THEN '-2m' ELSE '3h5' END AS dur,
          CASE c_custkey % 17 WHEN 0 THEN '512' WHEN 1 THEN '10K' WHEN 2 THEN '3 gb' WHEN 3 THEN '-5M' WHEN 4 THEN '9999999T' WHEN 5 THEN '1.5m' WHEN 6 THEN '' WHEN 7 THEN '9007199254740993' WHEN 8 THEN '8388608T' WHEN 9 THEN '8388607TB'
          WHEN 10 THEN '+7 kb' WHEN 11 THEN 'B' WHEN 12 THEN ' 5 b ' WHEN 13 THEN '1_0' WHEN 14 THEN '9223372036854775808' WHEN 15 THEN '007M' ELSE 'x' END AS size,
          'q"' || c_mktsegment || '\\' || c_name AS label, CASE c_custkey % 4 WHEN 0 THEN 'k=v=w' WHEN 1 THEN 'kv' WHEN 2 THEN '=v' ELSE 'key=' END AS flag FROM customer""",
}
NEEDS = {"d_obj": ("d_lin",), "d_obj2": ("d_obj",), "d_ref": ("d_lin", "d_obj"), "d_cp": ("d_obj",), "d_key": ("d_obj",), "d_tomb": ("d_key",), "d_side": ("d_ref",), "d_sess": ("d_ref",)}
NOW_O, NOW_E = "TIMESTAMP '2002-01-01 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"


def order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in (*order(NEEDS.get(n, ())), n):
            if x not in out:
                out.append(x)
    return out


def with_clause(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines fixtures, for SQL that goes on with a comma or SELECT."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in order(names))


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Fixtures and tables as lazy DataFrames."""
    session = spark
    tables: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in tables:
            if name in TABLES:
                tables[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            else:
                sql = FIXTURES[name].replace("{", "{{").replace("}", "}}").replace("\\", "\\\\")
                used = [t for t in (*TABLES, *FIXTURES) if t != name and f" {t} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
                for t in used:
                    sql = __import__("re").sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
                tables[name] = session.sql(sql, **{t: get(t) for t in used if f"{{{t}}}" in sql})
        return tables[name]

    return [get(n) for n in names]
