import random

from pyspark.sql import functions as F

from tickstate.operators import book
from tickstate.operators.ordered import Running, following, number_rows, running, with_time_chunk


def test_running_with_one_hot_key(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{i % 5}", rng.randint(0, 9) or None) for i in range(1, 600)]
    df = spark.createDataFrame(rows, "ingest_sequence long, key string, v long")
    out = running(df, ["key"], "ingest_sequence", {
        "total": Running("sum", F.col("v")), "seen": Running("last", F.col("v")),
        "one": Running("first", F.col("v")), "top": Running("max", F.col("v"))}, chunk_rows=16)
    out = following(out, ["key"], "ingest_sequence", "ingest_sequence", "nxt", chunk_rows=16)
    got = {r["ingest_sequence"]: r for r in out.collect()}
    by_key = {}
    for i, key, v in rows:
        by_key.setdefault(key, []).append((i, v))
    for items in by_key.values():
        seen = []
        for n, (i, v) in enumerate(items):
            seen += [v] if v is not None else []
            r = got[i]
            want = (sum(seen), seen[-1], seen[0], max(seen)) if seen else (None,) * 4
            assert (r["total"], r["seen"], r["one"], r["top"]) == want
            assert r["nxt"] == (items[n + 1][0] if n + 1 < len(items) else None)


def test_number_rows_is_dense_under_skew(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    out = number_rows(df, ["a", "b"], "no").collect()
    assert sorted(r["no"] for r in out) == list(range(1, 5001))
    ordered = [(r["a"], r["b"]) for r in sorted(out, key=lambda r: r["no"])]
    assert ordered == sorted(ordered)


def test_time_chunks_split_hot_minutes_and_seconds(spark):
    rows = [("x", i * 1_000) for i in range(3000)] + [("x", 120_000_000_000 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "key string, ns long")
    out = with_time_chunk(df, ["key"], "ns", chunk_rows=100)
    sizes = {r["_chunk"]: r["n"] for r in out.groupBy("_chunk").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 1000, 1_000_000: 1000, 2_000_000: 1000, 120_000_000_000: 10}
    total = running(out.withColumn("one", F.lit(1)), ["key"], "ns", {"n": Running("sum", F.col("one"))}, chunked=True)
    assert sorted(r["n"] for r in total.collect()) == list(range(1, 3011))


def test_divergence_fold_matches_counting(spark, monkeypatch):
    rng = random.Random(11)
    rows, want = [], {}
    for asset in ("a", "b", "c"):
        misses, coherent = 0, True
        for n in range(1, 400):
            kind = "clob_book" if n == 1 else rng.choices(
                ["clob_best_bid_ask", "clob_price_change", "point"], [8, 2, 1])[0]
            ok, hit = rng.random() < 0.8, rng.random() < 0.45
            seq = len(rows) + 1
            if kind in ("clob_book", "clob_price_change"):
                coherent = ok
                misses = 0 if kind == "clob_book" else misses
            elif kind == "clob_best_bid_ask":
                if not hit:
                    misses += 1
                    coherent = coherent and misses < 3
                elif coherent:
                    misses = 0
            want[seq] = coherent
            rows.append((asset, 1, seq, n, kind, ok, 1, 2, (1 if hit else 5, 2)))
    df = spark.createDataFrame(
        rows, "asset_id string, epoch long, ingest_sequence long, row_no long, stream string, uncrossed boolean, "
        "best_bid int, best_ask int, p_best struct<best_bid:int,best_ask:int>")
    for rows_in_block in (3, 1024):  # also maps of maps of blocks
        monkeypatch.setattr(book, "FOLD_ROWS", rows_in_block)
        got = {r["ingest_sequence"]: r["coherent"] for r in book.divergence_fold(df, 3).collect()}
        assert got == want


def test_blocks_cover_each_row_of_an_interval_once(spark):
    """Every interval over few rows, buckets of 1 to 8 rows, and a long one in few blocks."""
    spans = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)] + [(3, 1_000_003)]
    df = spark.createDataFrame(spans, "valid_from long, valid_to long")
    for size in (1, 3, 8):
        parts = {}
        for r in book._blocks(df, size).collect():
            parts.setdefault((r["valid_from"], r["valid_to"]), []).append((r["_level"], r["_block"]))
        for a, b in spans:
            mine = parts[(a, b)]
            assert len(mine) <= 2 + 2 * max(1, (b - a).bit_length())
            if b > 100:
                continue
            rows = []
            for level, block in mine:
                width = 1 << max(level, 0)
                rows += [r for r in range((block * width - 1) * size, ((block + 1) * width - 1) * size) if a <= r < b]
            assert sorted(rows) == list(range(a, b))


def test_best_prices_and_levels_of_long_books(spark):
    """Long-lived and short levels at every row, against a scan of all intervals."""
    rng = random.Random(8)
    spans = []
    for i in range(300):
        a = rng.randrange(1, 900)
        b = min(1000, a + rng.choice([1, 5, 70, 900]))
        spans.append(("x", 1 + i % 2, rng.choice(["bids", "asks"]), rng.randint(1, 50), i, a, b))
    intervals = spark.createDataFrame(
        spans, "asset_id string, epoch long, side string, price int, quantity int, valid_from long, valid_to long")
    points = spark.createDataFrame(
        [("x", e, r) for e in (1, 2) for r in range(0, 1003)], "asset_id string, epoch long, row_no long")
    best = {(r["epoch"], r["row_no"]): (r["best_bid"], r["best_ask"]) for r in book.best_at(points, intervals, 4).collect()}
    listed = {}
    for r in book.levels_at(points, intervals, 8).collect():
        listed.setdefault((r["epoch"], r["row_no"]), []).append(r["quantity"])
    assert len(best) == 2006
    for (epoch, row), got in best.items():
        live = [s for s in spans if s[1] == epoch and s[5] <= row < s[6]]
        bids, asks = ([s[3] for s in live if s[2] == side] for side in ("bids", "asks"))
        assert got == (max(bids, default=None), min(asks, default=None))
        assert sorted(listed.get((epoch, row), [])) == sorted(s[4] for s in live)


def test_short_keys_are_whole_windows(spark):
    """Keys that fit one task are scanned without chunk summaries."""
    from tickstate.operators import book
    from tickstate.operators.ordered import chunks_needed

    rows = spark.range(1, 401).select(
        F.col("id").alias("ingest_sequence"),
        (F.col("id") % 7).cast("string").alias("asset_id"),
        F.when(F.col("id") % 10 < 2, "clob_book").when(F.col("id") % 10 < 8, "clob_price_change").otherwise("point").alias("stream"),
        F.lit(None).cast("string").alias("source_session_id"),
        F.col("id").alias("source_timestamp_ns"),
        F.expr("struct(array(struct(cast(0.01 as decimal(18,8)) as price, cast(1 as decimal(18,8)) as quantity)) as bids, "
               "array(struct(cast(0.02 as decimal(18,8)) as price, cast(2 as decimal(18,8)) as quantity)) as asks)").alias("p_book"),
        F.expr("struct(if(id % 3 = 0, 'BUY', 'SELL') as side, cast((id % 5) / 100 as decimal(18,8)) as price, "
               "cast(id % 4 as decimal(18,8)) as quantity)").alias("p_change"),
    )
    assert chunks_needed(rows, ["asset_id"], 58) is None and chunks_needed(rows, ["asset_id"], 57) == 57
    chunked, whole = book.book_epochs(rows, chunk_rows=16), book.book_epochs(rows, chunk_rows=None)
    assert chunked.exceptAll(whole).isEmpty() and whole.count() == 400
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    parts, once = book.level_intervals(chunked, 16), book.level_intervals(whole, None)
    assert parts.exceptAll(once).isEmpty() and once.count() == parts.count() > 0
    marks = rows.where("ingest_sequence % 50 = 0").select("ingest_sequence")
    cut = [book.book_epochs(rows, marks, chunk_rows=c).select("ingest_sequence", "epoch") for c in (16, None)]
    assert cut[0].exceptAll(cut[1]).isEmpty()
