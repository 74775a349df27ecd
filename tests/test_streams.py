import random
import uuid

import pytest

from pyspark.sql import functions as F

import events_kit as kit
import fold
from tickstate.operators import book
from tickstate.operators.asof import place_ticks
from tickstate.operators.ordered import checkpoint_dir
from tickstate.operators.ordering import dedup_horizon
from tickstate.params import Params
from tickstate.plans.replay import ArchiveIntegrityError, replay
from tickstate.plans.snapshot import build_snapshots, flatten_snapshots
from tickstate.sources.archive import read_snapshots, write_events, write_manifests
from tickstate.schemas import ddl
from tickstate.streaming import books, snapshots, streams
from test_parsers import NOW, NOW_MS, oracle


def folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def streamed(spark, events, parts, size):
    """``events`` as a file stream of ``parts`` micro-batches of ``size`` sequences."""
    source = folder(spark, "source")
    for part in range(parts):
        piece = events.where(F.expr(f"(ingest_sequence - 1) div {size} = {part}"))
        piece.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)


@pytest.mark.parametrize("seed", [4, 9])
def test_streamed_snapshots_equal_batch(spark, seed):
    """Five batches from carried books; a batch reads no older event."""
    rows = kit.random_day(seed, 500)
    fold.run(rows, seed)
    events = kit.frame(spark, rows)
    out, state = folder(spark, "out"), folder(spark, "state")
    stream = streamed(spark, events, 5, 100)
    snapshots.stream_snapshots(stream, out, state, folder(spark, "cp")).awaitTermination()
    got = {r["snapshot_sequence"]: r["snapshot_json"] for r in spark.read.parquet(out).collect()}
    want = {r["snapshot_sequence"]: r["snapshot_json"] for r in flatten_snapshots(build_snapshots(events)).collect()}
    assert got == want and len(want) > 10
    carried = spark.read.parquet(f"{state}/books").groupBy("batch", "asset_id").count()
    assert carried.agg(F.max("count")).first()[0] <= 6


def batch_books(events):
    ticks = events.where("stream = 'snapshot_tick'").select("ingest_sequence")
    of = lambda name: events.where(F.col("stream") == name)
    rows = events.where(F.col("stream").startswith("clob_"))
    return book.books_at(ticks, rows, of("market_window_state"), of("source_status"))


@pytest.mark.parametrize("seed", [6, 11])
def test_stateful_books_equal_batch(spark, seed):
    """Sessions, identity, retirement and levels over four batches."""
    rows = kit.random_day(seed, 600)
    fold.run(rows, seed)
    events = kit.frame(spark, rows)
    out = folder(spark, "out")
    _, query = books.stream_books(streamed(spark, events, 4, 150), out, folder(spark, "work"), files=2)
    query.awaitTermination()
    want = batch_books(events)
    got = books.at_places(spark.read.schema(ddl(books.BOOK_ROWS)).parquet(out)).select(*want.columns)
    key = lambda r: (r.ingest_sequence, r.timeframe, r.outcome)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and want.count() > 20


def test_stateful_books_expire(spark):
    """The state of an asset that no market state retires is gone a quarter of an hour after its window."""
    window = kit.window("5m", 1_700_000_100, "5m-0")
    state = {"state": "active", "timeframe": "5m", "current_market": window, "next_market": None,
             "expected_transition_timestamp_ns": None, "updated_at_timestamp_ns": None, "attempt_count": 0, "last_error": None}
    end = window["end_timestamp_ns"]
    def tick(seq, at):
        return kit.event(seq, "market_discovery", "snapshot_tick", at, p_tick={
            "snapshot_sequence": seq, "scheduled_timestamp_ns": at, "health": []})
    def full(seq, at):
        return kit.event(seq, "clob", "clob_book", at, timeframe="5m", market_id="m-5m-0", condition_id="c-5m-0",
                         asset_id="5m-0-up", outcome="up", p_book={"bids": kit.levels([("0.4", 1)]), "asks": [], "book_hash": None})
    rows = [
        kit.event(1, "market_discovery", "market_window_state", kit.START, timeframe="5m", p_market=state),
        full(2, kit.START), tick(3, kit.START),
        full(4, end + 800 * kit.SECOND), tick(5, end + 899 * kit.SECOND),
        tick(6, end + 901 * kit.SECOND), tick(7, end + 902 * kit.SECOND), tick(8, end + 903 * kit.SECOND),
        full(9, end + 904 * kit.SECOND), tick(10, end + 905 * kit.SECOND),
    ]
    out = folder(spark, "out")
    stream = streamed(spark, kit.frame(spark, rows), 5, 2)
    _, query = books.stream_books(stream, out, folder(spark, "work"), files=1)
    query.awaitTermination()
    seen = {r.ingest_sequence for r in spark.read.parquet(out).collect()}
    assert {3, 5} <= seen and not seen & {10}


def test_replay_round_trip_and_gate(spark):
    rows = kit.random_day(8, 300)
    fold.run(rows, 8)
    events = kit.frame(spark, rows)
    path, out = folder(spark, "events"), folder(spark, "out")
    write_events(events, path)
    write_manifests(spark, path, "parquet")
    summary = replay(spark, path, out, Params(chunk_rows=50)).first()
    ticks = sum(r["stream"] == "snapshot_tick" for r in rows)
    assert (summary["events_processed"], summary["snapshots_produced"]) == (300, ticks)
    back = read_snapshots(spark, out).select("snapshot.*").orderBy("snapshot_sequence").collect()
    direct = build_snapshots(events).drop("ingest_sequence").orderBy("snapshot_sequence").collect()
    assert back == direct
    broken = folder(spark, "events")
    write_events(events.where("ingest_sequence <> 77"), broken)
    try:
        replay(spark, broken, folder(spark, "out"))
    except ArchiveIntegrityError as error:
        assert "sequence gap" in str(error)
    else:
        raise AssertionError("a gap must stop the replay")


def test_order_and_duplicates_across_batches(spark):
    """+10 ms, 0, +10 ms again, +20 ms: one file each."""
    import json

    source = folder(spark, "frames")
    for i, ms in enumerate((10, 0, 10, 20)):
        row = ("chainlink_rtds", "s1", NOW + i * 1_000_000, NOW + i, json.dumps(oracle(NOW_MS + ms)))
        df = spark.createDataFrame(
            [row], "source string, session_id string, received_wall_ns long, received_monotonic_ns long, raw string"
        )
        df.coalesce(1).write.mode("append").parquet(source)
    frames = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    good, bad = folder(spark, "good"), folder(spark, "bad")
    streams.stream_normalise(frames, good, bad, folder(spark, "cp")).awaitTermination()
    events = spark.read.parquet(good).orderBy("arrival_no").collect()
    assert [(r.arrival_no, r.ingest_sequence) for r in events] == [(1, 1), (4, 2)]
    rejects = spark.read.parquet(bad).orderBy("arrival_no").collect()
    assert [(r.arrival_no, r.reject_reason) for r in rejects] == [(2, "out_of_order"), (3, "duplicate")]


def test_two_days_in_one_folder(spark):
    """A second replay counts its own snapshots only."""
    out = folder(spark, "out")
    for day, seed in ((0, 8), (1, 12)):
        rows = kit.random_day(seed, 200)
        fold.run(rows, seed)
        shift = day * 86_400 * kit.SECOND
        events = kit.frame(spark, rows)
        ns = [c for c in events.columns if c in ("received_wall_timestamp_ns", "source_timestamp_ns")]
        tick = F.when(
            F.col("p_tick").isNotNull(),
            F.col("p_tick").withField("scheduled_timestamp_ns", F.col("p_tick.scheduled_timestamp_ns") + shift),
        )
        events = events.withColumns({**{c: F.col(c) + shift for c in ns}, "p_tick": tick})
        path = folder(spark, "events")
        write_events(events, path)
        write_manifests(spark, path, "parquet")
        summary = replay(spark, path, out).first()
        ticks = sum(r["stream"] == "snapshot_tick" for r in rows)
        assert (summary["ticks_processed"], summary["snapshots_produced"]) == (ticks, ticks) and ticks


def test_ticks_on_a_grid(spark):
    """Each tick stands after the events of its time and before the next."""
    times = [0, 5, 10, 10, 9, 31, 60, 60, 95]
    rows = [kit.event(i + 1, "chainlink_rtds", "chainlink_price", kit.START + t * 1_000_000) for i, t in enumerate(times)]
    moved, ticks = place_ticks(kit.frame(spark, rows), kit.START, kit.START + 100_000_000, 50, chunk_rows=2)
    order = [("event", r.event_id, r.ingest_sequence) for r in moved.collect()]
    order += [("tick", r.now_ns, r.ingest_sequence) for r in ticks.collect()]
    order.sort(key=lambda r: r[2])
    assert [r[2] for r in order] == list(range(1, len(order) + 1))
    kinds = [r[1] if r[0] == "event" else (r[1] - kit.START) // 1_000_000 for r in order]
    assert kinds == ["e1", 0, "e2", "e3", "e4", "e5", "e6", 50, "e7", "e8", "e9", 100]


@pytest.mark.parametrize("horizon", [1, 3, 10])
def test_duplicate_horizon(spark, horizon):
    """The last accepted ids of a key, oldest out first, whatever the chunks."""
    rng = random.Random(horizon)
    rows = [(i + 1, rng.choice("kl"), f"{rng.choice('abcdefghijklmnop')}" if rng.random() < 0.7 else f"u{i}") for i in range(400)]
    held, want = {"k": [], "l": []}, []
    for at, key, name in rows:
        if name not in held[key]:
            held[key] = [*held[key], name][-horizon:]
            want.append(at)
    df = spark.createDataFrame(rows, "arrival_no long, key string, event_id string")
    got = dedup_horizon(df, horizon, ("key",), chunk_rows=37)
    assert sorted(r.arrival_no for r in got.collect()) == want
