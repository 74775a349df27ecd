"""Order books as level intervals.

A book side is not a mutable map here. Every level is an interval of row
numbers of its asset: valid from the row that set it to the next row that sets
the same price in the same epoch, or the end of the epoch. The book at any row
is the set of intervals that hold there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstate.operators.asof import IDENTITY, SEQ, is_stale, reference_lives, with_control, with_life
from tickstate.operators.ordered import (
    Running, chunks_needed, following, holding, materialize, release, running, salted_join,
)
from tickstate.params import BOOK_STREAMS, CHUNK_ROWS, TIMEFRAME_SECONDS

BOOK, CHANGE, BEST, POINT = "clob_book", "clob_price_change", "clob_best_bid_ask", "point"
ASSET_LIFE = ["asset_id", "life"]
EPOCH = ["asset_id", "epoch"]
ROW = "row_no"
SUB_BUCKET = 256
BEST_BUCKET = 64


def book_epochs(
    book_events: DataFrame,
    boundaries: DataFrame | None = None,
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """B1: add ``epoch``, ``initialized`` and ``row_no`` to the rows of each asset's life.

    A full book starts an epoch, named after its sequence. A row is initialized
    while no invalidation happened since that book: the ``invalidations`` column
    (see ``with_control``) counts them; with ``boundaries`` (rows of
    ``ingest_sequence``) it is computed here. Carried attributes of B8 come along.
    """
    rows = book_events
    if "life" not in rows.columns:
        rows = rows.withColumn("life", F.lit(0).cast("bigint"))
    if boundaries is not None:
        marks = boundaries.select(SEQ, F.lit(1).cast("bigint").alias("_cut"))
        rows = (
            running(
                # a boundary takes effect before a row with the same sequence
                rows.unionByName(marks, allowMissingColumns=True).withColumn(
                    "_late", F.col("_cut").isNull()
                ),
                [],
                SEQ,
                {"invalidations": Running("sum", F.coalesce(F.col("_cut"), F.lit(0)))},
                chunk_rows=chunk_rows,
                tie="_late",
            )
            .where("_late")
            .drop("_cut", "_late")
        )
    elif "invalidations" not in rows.columns:
        rows = rows.withColumn("invalidations", F.lit(0).cast("bigint"))
    rows = carry_attributes(rows, chunk_rows=chunk_rows)
    same = F.col("_book.invalidations") == F.col("invalidations")
    return rows.withColumns(
        {
            "initialized": F.coalesce(same, F.lit(False)),
            "epoch": F.when(same, F.col("_book.at")),
        }
    )


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def carry_attributes(
    book_events: DataFrame, lives: DataFrame | None = None, chunk_rows: int | None = CHUNK_ROWS
) -> DataFrame:
    """Last trade price, tick size, resolved flag and event time of a book life so far.

    They survive invalidations but not the end of the life. ``lives`` (from
    ``reference_lives``) adds the life first.
    """
    rows = book_events if lives is None else with_life(book_events, lives, chunk_rows).where(
        "life is not null"
    )
    if "invalidations" not in rows.columns:
        rows = rows.withColumn("invalidations", F.lit(0).cast("bigint"))
    stream = F.col("stream")
    real = stream != POINT
    here = F.struct(
        F.col(SEQ).alias("at"),
        F.col("invalidations").alias("invalidations"),
        F.col("source_session_id").alias("session"),
    )
    affected = F.col("p_resolved.affected_asset_ids") if "p_resolved" in rows.columns else F.lit(None)
    settles = (stream == "clob_market_resolved") & (
        F.coalesce(F.size(affected), F.lit(0)) <= 0
        if "p_resolved" not in rows.columns
        else (F.coalesce(F.size(affected), F.lit(0)) <= 0)
        | F.coalesce(F.array_contains(affected, F.col("asset_id")), F.lit(False))
    )
    trade = rows["p_last_trade.price"] if "p_last_trade" in rows.columns else F.lit(None)
    size = rows["p_tick_size.new_tick_size"] if "p_tick_size" in rows.columns else F.lit(None)
    event_time = F.struct(_has(rows, "source_timestamp_ns").cast("bigint").alias("ns"))
    carried = running(
        rows,
        ASSET_LIFE,
        SEQ,
        {
            "_book": Running("last", F.when(stream == BOOK, here)),
            "_created": Running("first", F.when(real, here)),
            ROW: Running("sum", F.lit(1).cast("bigint")),
            "last_trade_price": Running("last", trade.cast("decimal(18,8)")),
            "tick_size": Running("last", size.cast("decimal(18,8)")),
            "_resolved": Running("max", settles.cast("int")),
            "_event_time": Running("last", F.when(real, event_time)),
        },
        chunk_rows=chunk_rows,
    )
    return carried.withColumns(
        {
            "resolved": F.coalesce(F.col("_resolved") == 1, F.lit(False)),
            "last_event_timestamp_ns": F.col("_event_time.ns"),
        }
    ).drop("_resolved", "_event_time")


def early_deltas(epoch_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``; price changes before the first full book are dropped."""
    early = (F.col("stream") == CHANGE) & ~F.col("initialized")
    return epoch_events.where(~early), epoch_events.where(early)


def level_intervals(epoch_events: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """B2: ``(asset_id, epoch, side, price, quantity, valid_from, valid_to)`` in row numbers.

    The last write of a price wins; a zero quantity deletes when it is a change,
    but stays when a full book carries it.
    """
    rows = epoch_events.where(F.col("initialized") & F.col("stream").isin(BOOK, CHANGE))

    def side_levels(side: str) -> Column:
        return F.transform(
            f"p_book.{side}",
            lambda level: F.struct(
                F.lit(side).alias("side"),
                level["price"].alias("price"),
                level["quantity"].alias("quantity"),
            ),
        )

    full = F.concat(side_levels("bids"), side_levels("asks"))
    change = F.array(
        F.struct(
            F.when(F.col("p_change.side") == "BUY", "bids").otherwise("asks").alias("side"),
            F.col("p_change.price").alias("price"),
            F.col("p_change.quantity").alias("quantity"),
        )
    )
    is_book = F.col("stream") == BOOK
    levels = rows.select(
        *EPOCH,
        SEQ,
        ROW,
        is_book.alias("_full"),
        F.explode(F.when(is_book, full).otherwise(change)).alias("_level"),
    ).select(*EPOCH, SEQ, ROW, "_full", "_level.*")
    ends = epoch_events.where("initialized").groupBy(*EPOCH).agg((F.max(ROW) + 1).alias("_end"))
    columns = [*EPOCH, "side", "price", "quantity", "valid_from", "valid_to"]
    if chunk_rows is None:
        # the join's partitioning by epoch also serves the window, so the levels are listed once
        levels = levels.join(ends, EPOCH)
    levels = following(
        levels.withColumnRenamed(ROW, "valid_from"),
        [*EPOCH, "side", "price"],
        SEQ,
        "valid_from",
        "valid_to",
        chunk_rows=chunk_rows,
    ).where(F.col("_full") | (F.col("quantity") != 0))
    if chunk_rows is None:
        return levels.withColumn("valid_to", F.coalesce("valid_to", "_end")).select(*columns)
    closed = levels.where("valid_to is not null")
    open_levels = salted_join(
        levels.where("valid_to is null").drop("valid_to"),
        ends,
        EPOCH,
        F.col("valid_from"),
        how="inner",
    ).withColumnRenamed("_end", "valid_to")
    return closed.select(*columns).unionByName(open_levels.select(*columns))


def _bucket(size: int) -> Column:
    """The bucket of ``size`` rows, counted from 1 so that no block of whole buckets is number 0."""
    return F.expr(f"{ROW} div {size} + 1")


def _blocks(intervals: DataFrame, size: int) -> DataFrame:
    """Intervals as aligned blocks: ``_level, _block`` once per part.

    The at most two buckets of ``size`` rows in which an interval begins or ends have
    level -1. The whole buckets between, ``n`` of them, are at most ``2 log2(n)``
    blocks of ``2 ** _level`` buckets, the nodes of a segment tree over the epoch.
    """
    whole = intervals.withColumns(
        {"_a": F.expr(f"(valid_from + {size - 1}) div {size} + 1"), "_b": F.expr(f"valid_to div {size} + 1")}
    )
    part = "struct(cast({level} as int) as _level, cast({block} as bigint) as _block)"
    edges = f"""array_distinct(array_compact(array(
        if(valid_from % {size} <> 0, {part.format(level=-1, block=f"valid_from div {size} + 1")}, null),
        if(valid_to % {size} <> 0, {part.format(level=-1, block=f"valid_to div {size} + 1")}, null))))"""
    # at each level the blocks that the level above cannot take: an odd first, an odd end
    first, end = "shiftright(_a + shiftleft(1L, j) - 1, j)", "shiftright(_b, j)"
    nodes = f"""if(_a < _b, filter(flatten(transform(sequence(0, length(bin(_b - _a)) - 1), j -> array(
        if({first} < {end} and {first} % 2 = 1, {part.format(level="j", block=first)}, null),
        if({first} < {end} and {end} % 2 = 1, {part.format(level="j", block=f"{end} - 1")}, null)))), p -> p is not null), array())"""
    return (
        whole.withColumn("_part", F.explode(F.concat(F.expr(edges), F.expr(nodes))))
        .withColumns({"_level": F.col("_part._level"), "_block": F.col("_part._block")})
        .drop("_a", "_b", "_part")
    )


def _with_blocks(buckets: DataFrame, edges: bool) -> DataFrame:
    """Rows with a ``_bucket`` repeated for each block that holds it, its own edges with ``edges``."""
    levels = F.expr(f"sequence({-1 if edges else 0}, length(bin(_bucket)) - 1)")
    return buckets.withColumn("_level", F.explode(levels)).withColumn(
        "_block", F.expr("shiftright(_bucket, greatest(_level, 0))")
    )


def levels_at(points: DataFrame, intervals: DataFrame, sub_bucket: int = SUB_BUCKET) -> DataFrame:
    """The levels that hold at each point, as ``points`` columns + side, price, quantity.

    ``points`` has ``asset_id, epoch, row_no``. A point meets the levels that begin or
    end in its bucket of ``sub_bucket`` rows, and those of the blocks above it, which
    all hold there.
    """
    placed = _with_blocks(points.withColumn("_bucket", _bucket(sub_bucket)), edges=True)
    return (
        placed.join(_blocks(intervals, sub_bucket), [*EPOCH, "_level", "_block"])
        .where((F.col("valid_from") <= F.col(ROW)) & (F.col(ROW) < F.col("valid_to")))
        .select(*points.columns, "side", "price", "quantity")
    )


def top_n(levels_at_points: DataFrame, n: int = 20, by: tuple[str, ...] = (*EPOCH, ROW)) -> DataFrame:
    """``bids`` (descending) and ``asks`` (ascending), at most ``n`` levels each."""
    signed = F.when(F.col("side") == "bids", -F.col("price")).otherwise(F.col("price"))
    best_first = Window.partitionBy(*by, "side").orderBy("_key")
    ranked = (
        # one exchange by point serves both the ranks of a side and the lists
        levels_at_points.repartition(*by).withColumn("_key", signed)
        .withColumn("_rank", F.row_number().over(best_first))
        .where(F.col("_rank") <= n)
    )

    def side(name: str) -> Column:
        entry = F.when(F.col("side") == name, F.struct("_rank", "price", "quantity"))
        return F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(e["price"].alias("price"), e["quantity"].alias("quantity")),
        )

    return ranked.groupBy(*by).agg(side("bids").alias("bids"), side("asks").alias("asks"))


def best_prices(
    levels_at_points: DataFrame, by: tuple[str, ...] = (*EPOCH, ROW)
) -> DataFrame:
    """B5 from joined levels: best bid and best ask per point."""
    price = F.col("price")
    return levels_at_points.groupBy(*by).agg(
        F.max(F.when(F.col("side") == "bids", price)).alias("best_bid"),
        F.min(F.when(F.col("side") == "asks", price)).alias("best_ask"),
    )


def best_at(points: DataFrame, intervals: DataFrame, bucket: int = BEST_BUCKET) -> DataFrame:
    """B5 at every row of a book without listing whole books.

    Levels that begin or end inside a bucket are compared with its rows, at most
    ``bucket`` rows each. The whole buckets between are blocks of a segment tree,
    whose best prices are combined over the blocks above each bucket.
    """
    parts = _blocks(intervals, bucket)
    price = F.col("price")
    is_bid = F.col("side") == "bids"
    nodes = parts.where("_level >= 0").groupBy(*EPOCH, "_level", "_block").agg(
        F.max(F.when(is_bid, price)).alias("_bid"), F.min(F.when(~is_bid, price)).alias("_ask")
    )
    placed = points.select(*EPOCH, ROW, _bucket(bucket).alias("_bucket"))
    standing = (
        _with_blocks(placed.select(*EPOCH, "_bucket").distinct(), edges=False)
        .join(nodes, [*EPOCH, "_level", "_block"])
        .groupBy(*EPOCH, "_bucket")
        .agg(F.max("_bid").alias("_standing_bid"), F.min("_ask").alias("_standing_ask"))
    )
    edges = parts.where("_level < 0").withColumnRenamed("_block", "_bucket")
    moving = (
        placed.join(edges, [*EPOCH, "_bucket"])
        .where((F.col("valid_from") <= F.col(ROW)) & (F.col(ROW) < F.col("valid_to")))
        .groupBy(*EPOCH, "_bucket", ROW)
        .agg(
            F.max(F.when(is_bid, price)).alias("_moving_bid"),
            F.min(F.when(~is_bid, price)).alias("_moving_ask"),
        )
    )
    bucketed = points.withColumn("_bucket", _bucket(bucket))
    return (
        bucketed.join(moving, [*EPOCH, "_bucket", ROW], "left")
        .join(standing, [*EPOCH, "_bucket"], "left")
        .withColumns(
            {
                "best_bid": F.greatest("_standing_bid", "_moving_bid"),
                "best_ask": F.least("_standing_ask", "_moving_ask"),
            }
        )
        .select(*points.columns, "best_bid", "best_ask")
    )


def coherence(best: DataFrame) -> DataFrame:
    """Add ``uncrossed``: one side empty, or best bid below best ask."""
    return best.withColumn(
        "uncrossed", F.coalesce(F.col("best_bid") < F.col("best_ask"), F.lit(True))
    )


FOLD_ROWS = 1024


def _step(state: Column, code: Column, limit: int) -> Column:
    """The state after an event; a state is ``2 * misses + coherent``, misses up to ``limit``.

    Codes: 0/1 full book that is crossed/uncrossed, 2/3 the same for a change, 4 a quote
    that differs, 5 one that agrees, 6 anything else.
    """
    coherent = state.bitwiseAND(F.lit(1))
    more = F.least(state - coherent + 2, F.lit(2 * limit))
    return (
        F.when(code <= 1, code)
        .when(code <= 3, state - coherent + code - 2)
        .when(code == 4, more + F.when(more < 2 * limit, coherent).otherwise(0))
        .when((code == 5) & (coherent == 1), 1)
        .otherwise(state)
    )


def _starts(blocks: DataFrame, by: list[str], key: str, limit: int) -> DataFrame:
    """``by, key, state``: the state before each block, given its transition ``map``.

    Maps are composed in groups of ``FOLD_ROWS``, and the groups in the same way, so
    no list is longer than that until an epoch has more than a million blocks.
    """
    groups = blocks.groupBy(*by, F.expr(f"{key} div {FOLD_ROWS}").alias("_group")).agg(
        F.array_sort(F.collect_list(F.struct(key, "map"))).alias("_list")
    )
    groups = materialize(groups)
    states = F.array(*[F.lit(i) for i in range(2 * limit + 2)])
    whole = groups.select(
        *by, "_group",
        F.aggregate("_list", states, lambda m, e: F.transform(m, lambda s: F.get(e["map"], s))).alias("map"),
    )

    def walked(entries: str, start: Column, name: str) -> Column:
        empty = F.array().cast(f"array<struct<{name}:bigint,state:int>>")
        return F.aggregate(
            entries,
            F.struct(start.cast("int").alias("state"), empty.alias("out")),
            lambda a, e: F.struct(
                F.get(e["map"], a["state"]).cast("int").alias("state"),
                F.array_append(a["out"], F.struct(e[name].alias(name), a["state"].alias("state"))).alias("out"),
            ),
            lambda a: a["out"],
        )

    first = F.lit(1)  # no misses, coherent; an epoch begins with a full book in any case
    tops = whole.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_group", "map"))).alias("_list")).select(
        *by, F.explode(walked("_list", first, "_group")).alias("_at")
    ).select(*by, "_at._group", F.col("_at.state").alias("_state"))
    starts = groups.join(tops, [*by, "_group"]).select(
        *by, F.explode(walked("_list", F.col("_state"), key)).alias("_at")
    ).select(*by, f"_at.{key}", "_at.state")
    return holding(starts, groups)


def divergence_fold(best_at_events: DataFrame, limit: int = 3) -> DataFrame:
    """Add ``coherent``, ``misses`` and ``mismatch`` to the initialized rows of each epoch.

    Input: ``best_at`` plus ``uncrossed``. The count of published quotes that differ
    from the rebuilt book is an automaton of ``2 * limit + 2`` states. Each block of
    ``FOLD_ROWS`` rows is reduced to its transition map; maps compose associatively,
    which gives the state before each block; then the rows of a block are walked once.
    The only copy is that of the blocks, so callers should pass few columns.
    """
    p = F.col("p_best")
    is_best = F.col("stream") == BEST
    differs = ~F.col("best_bid").eqNullSafe(p["best_bid"]) | ~F.col("best_ask").eqNullSafe(p["best_ask"])
    ok = F.col("uncrossed").cast("int")
    code = (
        F.when(F.col("stream") == BOOK, ok).when(F.col("stream") == CHANGE, ok + 2)
        .when(is_best, F.when(differs, 4).otherwise(5)).otherwise(6)
    )
    columns = best_at_events.columns
    blocks = materialize(
        best_at_events.withColumns({"mismatch": is_best & differs, "_code": code})
        .groupBy(*EPOCH, F.expr(f"{ROW} div {FOLD_ROWS}").alias("_block"))
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col(ROW).alias("_row"), "_code", F.struct(*columns, "mismatch").alias("event"),
        )), lambda x, y: F.when(x["_row"] < y["_row"], -1).when(x["_row"] > y["_row"], 1).otherwise(0)).alias("_events"))
    )
    states = F.array(*[F.lit(i) for i in range(2 * limit + 2)])
    maps = blocks.select(
        *EPOCH, "_block",
        F.aggregate("_events", states, lambda m, e: F.transform(m, lambda s: _step(s, e["_code"], limit))).alias("map"),
    )
    starts = _starts(maps, EPOCH, "_block", limit)
    walked = F.aggregate(
        "_events",
        F.struct(F.col("state").alias("state"), F.array().cast("array<int>").alias("out")),
        lambda a, e: F.struct(
            _step(a["state"], e["_code"], limit).cast("int").alias("state"),
            F.array_append(a["out"], _step(a["state"], e["_code"], limit).cast("int")).alias("out"),
        ),
        lambda a: a["out"],
    )
    rows = blocks.join(starts, [*EPOCH, "_block"]).select(
        F.explode(F.arrays_zip(F.col("_events"), walked.alias("_state"))).alias("_r")
    )
    rows = rows.select("_r._events.event.*", F.col("_r._state").alias("_s")).select(
        *columns, "mismatch", (F.col("_s") % 2 == 1).alias("coherent"), F.expr("_s div 2").cast("int").alias("misses")
    )
    return holding(rows, blocks, starts)


def active_points(ticks: DataFrame) -> DataFrame:
    """One row per tick and asset of the current markets, with its ``places``.

    ``ticks`` has the columns of ``with_control``; a place is (timeframe, side).
    """
    places = F.array(
        *[
            F.struct(
                F.lit(tf).alias("timeframe"),
                F.lit(side).alias("side"),
                F.col(f"state_{tf}.current_market.{side}_token_id").alias("asset_id"),
            )
            for tf in TIMEFRAME_SECONDS
            for side in ("up", "down")
        ]
    )
    rows = ticks.select(SEQ, "invalidations", places.alias("_all"))
    rows = rows.select(
        "*", F.explode(F.array_distinct(F.transform("_all", lambda p: p["asset_id"]))).alias("asset_id")
    ).where("asset_id is not null")
    return rows.select(
        SEQ,
        "invalidations",
        "asset_id",
        F.filter("_all", lambda p: p["asset_id"] == F.col("asset_id")).alias("places"),
        F.lit(POINT).alias("stream"),
    )


def books_at(
    ticks: DataFrame,
    book_events: DataFrame,
    market_state: DataFrame | None = None,
    status: DataFrame | None = None,
    *,
    controlled: bool = False,
    depth: int = 20,
    limit: int = 3,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The book row of each current asset at each tick.

    ``ticks`` needs ``ingest_sequence``; ``book_events`` are the order-book
    events. ``market_state`` and ``status`` are event rows of those streams. With
    ``controlled=True`` ``ticks`` and ``book_events`` already carry the control
    columns.
    """
    if not controlled:
        control = market_state.unionByName(status, allowMissingColumns=True)
        ticks = with_control(ticks, control, chunk_rows)
        book_events = with_control(book_events, control, chunk_rows)
        market_state = market_state.select(SEQ, "received_wall_timestamp_ns", "p_market")
    points, intervals = book_state(
        active_points(ticks), book_events, market_state, limit=limit, chunk_rows=chunk_rows
    )
    rows = materialize(book_rows_at(points, intervals, depth))
    release(points, intervals)
    return rows


def book_rows_at(points: DataFrame, intervals: DataFrame, depth: int = 20) -> DataFrame:
    """Book rows, one per place of each point of ``book_state``."""
    levels = levels_at(
        points.where("initialized").select(*EPOCH, ROW), intervals
    )
    by = [*EPOCH, ROW]
    books = top_n(levels, depth)
    empty = F.array().cast("array<struct<price:decimal(18,8),quantity:decimal(18,8)>>")
    placed = points.join(books, by, "left").withColumn("_place", F.explode("places"))
    return placed.select(
        SEQ,
        F.col("_place.timeframe").alias("timeframe"),
        F.col("_place.side").alias("outcome"),
        "asset_id",
        "market_id",
        "condition_id",
        F.col("identity_outcome").alias("book_outcome"),
        "source_session_id",
        F.coalesce("bids", empty).alias("bids"),
        F.coalesce("asks", empty).alias("asks"),
        F.get("bids", 0)["price"].alias("best_bid"),
        F.get("asks", 0)["price"].alias("best_ask"),
        "last_trade_price",
        "tick_size",
        "initialized",
        "coherent",
        "resolved",
        "last_event_timestamp_ns",
    )


def book_state(
    points: DataFrame,
    book_events: DataFrame,
    market_state: DataFrame,
    *,
    limit: int = 3,
    chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Book flags at ``points`` (see ``active_points``), and the level intervals of all books."""
    stale = is_stale(F.col("session"), F.col("source_session_id"))
    events = book_events.where(~stale & F.col("asset_id").isNotNull())
    lives = reference_lives(market_state, chunk_rows)
    payloads = ("p_book", "p_change", "p_best", "p_last_trade", "p_tick_size", "p_resolved")
    events = events.where(F.col("stream").isin(*BOOK_STREAMS)).select(
        SEQ,
        "stream",
        "asset_id",
        *IDENTITY,
        "source_session_id",
        "source_timestamp_ns",
        "invalidations",
        *payloads,
    )
    rows = events.unionByName(points, allowMissingColumns=True)
    lived = materialize(with_life(rows, lives, chunk_rows).where("life is not null"))
    chunk_rows = chunks_needed(lived, ASSET_LIFE, chunk_rows)

    complete = F.col("stream") != POINT
    for column in IDENTITY:
        complete = complete & F.col(column).isNotNull()
    identity = F.struct(*IDENTITY)
    rows = running(
        lived,
        ASSET_LIFE,
        SEQ,
        {"_identity": Running("first", F.when(complete, identity))},
        chunk_rows=chunk_rows,
    )
    is_point = F.col("stream") == POINT
    rows = rows.where(
        (is_point & F.col("_identity").isNotNull())
        | (complete & (identity == F.col("_identity")))
    )
    epochs = materialize(book_epochs(rows, chunk_rows=chunk_rows))
    release(lived)
    intervals = materialize(level_intervals(epochs, chunk_rows))
    live = epochs.where(
        F.col("initialized") & F.col("stream").isin(BOOK, CHANGE, BEST, POINT)
    ).select(*EPOCH, ROW, SEQ, "stream", "p_best")
    folded = divergence_fold(coherence(best_at(live, intervals)), limit)
    flags = folded.where(is_point).select(SEQ, "asset_id", F.col("coherent").alias("_coherent"), "misses")
    points = epochs.where(is_point).join(flags, [SEQ, "asset_id"], "left")
    untouched = F.col("_created.invalidations") == F.col("invalidations")
    points = points.withColumns(
        {
            "coherent": F.when(F.col("initialized"), F.col("_coherent")).otherwise(untouched),
            "source_session_id": F.when(F.col("initialized"), F.col("_book.session")).when(
                untouched, F.col("_created.session")
            ),
            "identity_outcome": F.col("_identity.outcome"),
            "market_id": F.col("_identity.market_id"),
            "condition_id": F.col("_identity.condition_id"),
        }
    )
    # the fold and its join end here, so that what reads the points does not hold their files
    points = materialize(points.drop(*payloads))
    release(epochs, folded)
    return points, intervals
