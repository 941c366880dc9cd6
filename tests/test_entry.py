import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["asof_replay", "replay_truncate", "checksum_incremental", "keep_highest_epoch", "base_spine", "diff_rows", "branch_state", "takeover_sessions"]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    order = [want.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
