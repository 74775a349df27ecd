"""Queries against their SQL on small tables made of what only large ones hold: equal times, equal answers, rare values."""

import datetime
import os
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle_check  # noqa: E402
from tickstate.plans import driver_queries, driver_queries_archive, driver_queries_state  # noqa: E402,F401


def events_table(folder, rows):
    """``rows``: (seconds, user, type, value, k) in order of their ids, which may be given as a sixth entry."""
    start = datetime.datetime(2024, 1, 1)
    table = pa.table({
        "event_id": pa.array([r[5] if len(r) > 5 else i for i, r in enumerate(rows)], pa.int64()),
        "ts": pa.array([start + datetime.timedelta(seconds=r[0]) for r in rows], pa.timestamp("us")),
        "user_id": pa.array([r[1] for r in rows], pa.int64()),
        "event_type": [r[2] for r in rows],
        "value": pa.array([r[3] for r in rows], pa.float64()),
        "props": ['{"k": %d}' % r[4] for r in rows],
    })
    pq.write_table(table, f"{folder}/events.parquet")


def same_as_sql(spark, folder, name):
    db = duckdb.connect()
    for file in os.listdir(folder):
        db.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{folder}/{file}')")
    queries, sql = driver_queries.QUERIES, driver_queries.SQL
    text, ok = oracle_check.compare(spark, db, name, queries[name], sql[name], str(folder))
    assert ok, text


@pytest.mark.parametrize(
    "name", ["flagship_state_at_tick", "a1_rolling_trades", "a1_rolling_trades_by_user", "a2_rolling_per_trade"]
)
def test_trades_of_the_time_of_a_tick(spark, tmp_path, name):
    """F16: a trade of a tick's own time is in its window, also when it is ingested after the tick."""
    events_table(tmp_path, [
        (0, 1, "view", 2.0, 3), (10, 1, "click", 4.0, 1), (20, 1, "error", 1.0, 2), (20, 1, "purchase", 5.0, 4),
        (20, 1, "click", 5.5, 6), (80, 1, "error", 1.0, 2), (80, 1, "purchase", 7.0, 5), (81, 1, "error", 2.0, 1),
        (700, 1, "purchase", 3.0, 9), (700, 2, "error", 3.0, 9),
    ])
    same_as_sql(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["d9_transition_results", "d10_state_timeline", "d12_s7_transition_log"])
def test_attempts_of_the_same_times(spark, tmp_path, name):
    """attempts asked for and answered at the same times; the earlier one counts, whatever it found."""
    rows = []
    for user in (0, 1):
        for i, kinds in enumerate((("view", "error"), ("error", "view"), ("signup", "click"), ("error", "error"))):
            at = 900 * i + 100  # a boundary of its own; ids 1,000 apart are answered at the same time
            rows += [(at + j, user, kind, 1.0, 5 + 21 * j, 10 * i + user * 50 + 1000 * j) for j, kind in enumerate(kinds)]
    events_table(tmp_path, sorted(rows, key=lambda r: r[5]))
    same_as_sql(spark, tmp_path, name)


def test_resolutions_settle_whole_markets(spark, tmp_path):
    """a market is a nation; all its suppliers are settled, not pairs of them."""
    pq.write_table(pa.table({
        "s_suppkey": pa.array(range(12), pa.int64()), "s_name": ["s"] * 12,
        "s_nationkey": pa.array([i % 2 for i in range(12)], pa.int32()), "s_acctbal": [1.0] * 12,
    }), f"{tmp_path}/supplier.parquet")
    same_as_sql(spark, tmp_path, "p13_expand_resolutions")
    rows = driver_queries.QUERIES["p13_expand_resolutions"](spark, str(tmp_path)).collect()
    assert {r["settled"] for r in rows if r["arrival_no"] % 4 in (1, 2)} == {6}


def test_trade_frames_without_price_and_quantity(spark, tmp_path):
    """an event without value whose frame also lacks a quantity."""
    events_table(tmp_path, [(i, 1, "view", 0.0 if i % 2 else 3.5, k) for i, k in enumerate([8, 8, 7, 7, 10, 10, 20, 20])])
    same_as_sql(spark, tmp_path, "p4_parse_agg_trades")


def shuffled_rows(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList
    stages = store.stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_resolutions_of_one_market_share_its_list(spark, tmp_path):
    """messages times members is what the lists hold, not what is shuffled."""
    n = 400
    pq.write_table(pa.table({
        "s_suppkey": pa.array(range(n), pa.int64()), "s_name": ["s"] * n,
        "s_nationkey": pa.array([3] * n, pa.int32()), "s_acctbal": [1.0] * n,
    }), f"{tmp_path}/supplier.parquet")
    before = shuffled_rows(spark)
    same_as_sql(spark, tmp_path, "p13_expand_resolutions")
    assert shuffled_rows(spark) - before < 20 * n
