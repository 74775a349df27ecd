"""Driver queries for joins, rolling windows, books, snapshots (J, A, B, M, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstate.functions import metrics
from tickstate.operators import asof, book, rolling
from tickstate.operators.asof import SEQ
from tickstate.operators.health import health_at
from tickstate.operators.ordered import chunks_needed, materialize, number_rows
from tickstate.params import Params
from tickstate.plans import adapters as A
from tickstate.plans.archive_fixture import ARCHIVE_START, LINE_NS, WITH_ARCHIVE, archive_events
from tickstate.plans.driver_queries import BK, EV, LEVELS_AT, WINDOWS, cut, num, query
from tickstate.functions.typed_json import type_of
from tickstate.plans.snapshot import (
    MARKET,
    build_snapshots,
    build_snapshots_on_grid,
    flatten_snapshots,
    readiness,
    snapshot_from_json,
    timeframe_snapshot,
)
from tickstate.schemas import SNAPSHOT_FILE, TEXT_LEVELS

# ---- J --------------------------------------------------------------------

LAST = "asof left join (select * from ev where event_type = '{0}') {0} on t.user_id = {0}.user_id and t.seq >= {0}.seq"


@query(
    "j1_asof_latest",
    f"""with {EV}
    select t.seq as tick_sequence, t.user_id, cast(view.price as double) as quote,
      cast(purchase.price as double) as trade, cast(signup.price as double) as oracle
    from ev t {LAST.format('view')} {LAST.format('purchase')} {LAST.format('signup')}
    where t.event_type = 'error'""",
)
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three latest values per user in one pass."""
    ev = A.events(spark, sf_dir)
    marks = ev.where("event_type in ('view', 'purchase', 'signup')").withColumnRenamed("seq", SEQ)
    values = {
        name: F.when(F.col("event_type") == kind, F.col("price"))
        for name, kind in (("quote", "view"), ("trade", "purchase"), ("oracle", "signup"))
    }
    out = asof.asof_latest(A.ticks(ev).select(SEQ, "user_id"), marks, ["user_id"], values)
    return out.select(
        F.col(SEQ).alias("tick_sequence"), "user_id", *[num(n).alias(n) for n in values]
    )


@query(
    "j2_with_age",
    f"""with {EV}
    select t.seq as tick_sequence, cast((t.ns - v.ns) // 1000000 as bigint) as age_ms,
      coalesce((t.ns - v.ns) // 1000000 > 60000, true) as stale
    from ev t asof left join (select * from ev where event_type = 'view') v on t.seq >= v.seq
    where t.event_type = 'error'""",
)
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    latest = asof.asof_latest(
        A.ticks(ev), A.quotes(ev), [], {"quote_ns": F.col("received_wall_timestamp_ns")}
    )
    aged = asof.with_age(latest, "quote_ns", "now_ns", 60_000)
    return aged.select(F.col(SEQ).alias("tick_sequence"), "age_ms", "stale")


def _states(ev: DataFrame) -> DataFrame:
    """Signups are market states: timeframe by user, current and next assets by k."""
    tf = F.when(F.col("user_id") % 2 == 0, "5m").otherwise("15m")
    k = F.col("k")
    at = F.timestamp_seconds(F.lit(1_700_000_100) + k * 300)
    later = F.timestamp_seconds(F.lit(1_700_000_400) + k * 300)
    now = A.market_window(tf, at, (k % 20).cast("string"))
    then = A.market_window(tf, later, ((k + 1) % 20).cast("string"))
    state = F.struct(
        F.when(k % 7 == 0, "searching_next").otherwise("active").alias("state"),
        tf.alias("timeframe"),
        F.when(k % 10 != 0, now).alias("current_market"),
        F.when(k % 3 == 0, then).alias("next_market"),
    )
    return ev.where("event_type = 'signup'").select(
        F.col("seq").alias(SEQ), F.col("ns").alias("received_wall_timestamp_ns"), state.alias("p_market")
    )


# market states by timeframe; c and n are the current and next names
ST = """stt as (
  select seq, ns, user_id % 2 = 0 as five, k, case when k % 10 <> 0 then k % 20 end as c,
    case when k % 3 = 0 then (k + 1) % 20 end as n from ev where event_type = 'signup')"""


@query(
    "j3_asof_market_state",
    f"""with {EV}, {ST}
    select t.seq as tick_sequence, 'm-' || a.c as market_5m, 'm-' || b.c as market_15m
    from ev t asof left join (select * from stt where five) a on t.seq >= a.seq
      asof left join (select * from stt where not five) b on t.seq >= b.seq
    where t.event_type = 'error'""",
)
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    out = asof.asof_market_state(A.ticks(ev), _states(ev))
    return out.select(
        F.col(SEQ).alias("tick_sequence"),
        F.col("state_5m.current_market.market_id").alias("market_5m"),
        F.col("state_15m.current_market.market_id").alias("market_15m"),
    )


@query(
    "j4_keep_referenced",
    f"""with {EV}, {ST},
    x as (select t.seq, t.k % 25 as a, p.c as c5, p.n as n5, q.c as c15, q.n as n15
      from ev t asof left join (select * from stt where five) p on t.seq >= p.seq
        asof left join (select * from stt where not five) q on t.seq >= q.seq
      where t.event_type in ('view', 'click', 'purchase'))
    select seq as event_sequence from x where coalesce(a = c5, false) or coalesce(a = n5, false)
      or coalesce(a = c15, false) or coalesce(a = n15, false)""",
)
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    rows = ev.where("event_type in ('view', 'click', 'purchase')").select(
        F.col("seq").alias(SEQ),
        F.concat((F.col("k") % 25).cast("string"), F.lit("-up")).alias("asset_id"),
    )
    return asof.keep_referenced(rows, _states(ev)).select(F.col(SEQ).alias("event_sequence"))


def _status(ev: DataFrame) -> DataFrame:
    """Errors are connection changes: even k connects with a new session."""
    k = F.col("k")
    return ev.where("event_type = 'error'").select(
        F.col("seq").alias(SEQ),
        F.col("ns").alias("received_wall_timestamp_ns"),
        F.lit("source_status").alias("stream"),
        F.struct(
            F.lit("clob").alias("source"),
            (k % 2 == 0).alias("connected"),
            F.concat(F.lit("s"), (k % 6).cast("string")).alias("session_id"),
            F.lit(0).cast("bigint").alias("reconnect_count"),
            F.lit(None).cast("string").alias("reason"),
        ).alias("p_status"),
    )


@query(
    "j5_filter_current_session",
    f"""with {EV}, x as (select t.seq, t.k % 6 as mine, c.k % 6 as session
      from ev t asof left join (select * from ev where event_type = 'error' and k % 2 = 0) c on t.seq >= c.seq
      where t.event_type <> 'error')
    select seq as event_sequence, session is not null and mine <> session as stale from x""",
)
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    rows = ev.where("event_type <> 'error'").select(
        F.col("seq").alias(SEQ),
        F.concat(F.lit("s"), (F.col("k") % 6).cast("string")).alias("source_session_id"),
    )
    kept, stale = asof.filter_current_session(rows, _status(ev))
    return kept.select(F.col(SEQ).alias("event_sequence"), F.lit(False).alias("stale")).unionByName(
        stale.select(F.col(SEQ).alias("event_sequence"), F.lit(True).alias("stale"))
    )


@query(
    "j6_guard_identity",
    f"""with {EV}, f as (select *, first_value(event_type) over (partition by user_id order by seq) as kind from ev)
    select seq as event_sequence, user_id from f where event_type = kind""",
)
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.events(spark, sf_dir).select(
        F.col("seq").alias(SEQ),
        "user_id",
        F.col("event_type").alias("market_id"),
        *[F.lit("x").alias(c) for c in ("condition_id", "timeframe", "outcome")],
    )
    kept = asof.guard_identity(rows, ("user_id",))
    return kept.select(F.col(SEQ).alias("event_sequence"), "user_id")


@query(
    "j8_tick_grid",
    """with b as (select epoch_us(min(ts)) * 1000 as lo, epoch_us(max(ts)) * 1000 as hi from events),
    g as (select unnest(range(0, (hi - lo) // 5000000000 + 1)) as i, lo from b)
    select i + 1 as snapshot_sequence, lo + i * 5000000000 as now_ns from g""",
)
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = A.events(spark, sf_dir).agg(F.min("ns").alias("lo"), F.max("ns").alias("hi")).first()
    return asof.tick_grid(spark, ends["lo"], ends["hi"], 5000)


# ---- A --------------------------------------------------------------------

def rolling_sql(where: str, keyed: bool) -> str:
    by = "partition by user_id " if keyed else ""
    one = """select seq as row_sequence, {s} as window_seconds,
      cast(coalesce(sum(case when event_type = 'purchase' then k + 1 end) over w, 0) as double) as buy_volume,
      cast(coalesce(sum(case when event_type = 'click' then k + 1 end) over w, 0) as double) as sell_volume,
      cast(cast(sum(case when event_type in ('purchase', 'click') then price * (k + 1) end) over w * 100 as hugeint) * 10000
        // cast(sum(case when event_type in ('purchase', 'click') then k + 1 end) over w as hugeint) as double) / 1000000 as vwap, event_type
      from ev window w as ({by}order by ns range between {s}000000000 preceding and current row)"""
    parts = " union all ".join(one.format(s=s, by=by) for s in WINDOWS)
    return f"with {EV}, r as ({parts}) select row_sequence, window_seconds, buy_volume, sell_volume, vwap from r where {where}"


def rolled(df: DataFrame) -> DataFrame:
    return df.select(
        F.col(SEQ).alias("row_sequence"),
        "window_seconds",
        *[num(c).alias(c) for c in ("buy_volume", "sell_volume")],
        cut(F.col("vwap")).alias("vwap"),
    )


@query("a1_rolling_trades", rolling_sql("event_type = 'error'", False))
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument: every trade shares the key, chunks keep it parallel."""
    ev = A.events(spark, sf_dir)
    return rolled(rolling.rolling_trades(A.ticks(ev).select(SEQ, "now_ns"), A.trades(ev), WINDOWS, by_time=True))


@query("a1_rolling_trades_by_user", rolling_sql("event_type = 'error'", True))
def a1_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    ticks = A.ticks(ev).select(SEQ, "user_id", "now_ns")
    return rolled(
        rolling.rolling_trades(ticks, A.trades(ev, {"user_id": "user_id"}), WINDOWS, ["user_id"], by_time=True)
    )


@query("a2_rolling_per_trade", rolling_sql("event_type in ('purchase', 'click')", False))
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled(rolling.rolling_per_trade(A.trades(A.events(spark, sf_dir)), WINDOWS, by_time=True))


@query(
    "a5_health_at",
    f"""with {EV},
    src(source) as (values ('view'), ('click'), ('purchase'), ('signup')),
    e as (select seq, ns, case when event_type = 'error' then ['view', 'click', 'purchase', 'signup'][k % 4 + 1] else event_type end as source,
        event_type = 'error' as status, k from ev),
    w as (select t.ns as now_ns, s.source from (select distinct ns from ev where event_type = 'error') t cross join src s),
    j as (select w.*, st.k, st.seq as st_seq, lm.ns as last_ns, c.reconnects, c.invalid
      from w asof left join (select * from e where status) st on w.source = st.source and w.now_ns >= st.ns
        asof left join (select * from e where not status or k % 8 >= 4) lm on w.source = lm.source and w.now_ns >= lm.ns
        asof left join (select ns, source,
            sum(case when status and k % 8 < 4 then 1 else 0 end) over (partition by source order by ns) as reconnects,
            sum(case when not status and k < 10 then 1 else 0 end) over (partition by source order by ns) as invalid
          from e) c on w.source = c.source and w.now_ns >= c.ns)
    select now_ns, source, coalesce(k % 8 >= 4, false) as connected, not coalesce(k % 8 >= 4, false) as stale,
      's' || k as current_session_id, last_ns as last_message_timestamp_ns,
      cast((now_ns - last_ns) // 1000000 as bigint) as age_ms, cast(coalesce(reconnects, 0) as bigint) as reconnect_count,
      cast(coalesce(invalid, 0) as bigint) as invalid_count
    from j""",
)
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are statuses of the source k mod 4; low k counts as an invalid frame."""
    ev, k = A.events(spark, sf_dir), F.col("k")
    names = ("view", "click", "purchase", "signup")
    source = F.get(F.array(*[F.lit(n) for n in names]), (k % 4).cast("int"))
    is_error = F.col("event_type") == "error"
    received = F.col("ns").alias("received_wall_timestamp_ns")
    status = ev.where(is_error).select(
        F.col("seq").alias(SEQ),
        received,
        F.struct(
            source.alias("source"),
            (k % 8 >= 4).alias("connected"),
            F.concat(F.lit("s"), k.cast("string")).alias("session_id"),
        ).alias("p_status"),
    )
    messages = ev.where(~is_error).select(F.col("event_type").alias("source"), received)
    invalid = ev.where(~is_error & (k < 10)).select(
        F.col("event_type").alias("source"), F.col("ns").alias("received_wall_ns")
    )
    ticks = ev.where(is_error).select(F.col("ns").alias("now_ns"))
    health = health_at(ticks, status, messages, rejects=invalid, sources=names)
    return health.select(
        "now_ns", "source", "connected", "stale", "current_session_id",
        "last_message_timestamp_ns", "age_ms", "reconnect_count", "invalid_count",
    )


# ---- M --------------------------------------------------------------------

@query(
    "m1_m5_quote_metrics",
    f"""with {EV}, q as (select seq, price as b, price + 0.01 * (k + 1) as a, k + 1 as bq, 100 - k as aq from ev where event_type = 'view')
    select seq as quote_sequence, round(cast(a - b as double), 8) as spread, round(cast((a + b) / 2 as double), 8) as mid_price,
      round(cast(a - b as double) / cast((a + b) / 2 as double) * 10000, 8) as spread_bps,
      round(cast(a * bq + b * aq as double) / (bq + aq), 8) as microprice,
      round(cast(bq - aq as double) / (bq + aq), 8) as top1_imbalance from q""",
)
def m1_m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.with_quote_metrics(A.quotes(A.events(spark, sf_dir)))
    names = ("spread", "mid_price", "spread_bps", "microprice", "top1_imbalance")
    return q.select(F.col(SEQ).alias("quote_sequence"), *[num(n).alias(n) for n in names])


@query(
    "m6_m8_depth_metrics",
    f"""with {EV}, d as (select seq, ns, (price + 2) * (k + 1) + (price + 1) * 2 as b, (price + 3) * (100 - k) as a from ev)
    select seq as row_sequence, round(cast(b as double), 8) as top20_bid_notional, round(cast(a as double), 8) as top20_ask_notional,
      round(cast(b - a as double) / cast(b + a as double), 7) as top20_depth_imbalance,
      cast(300000 - (ns % 300000000000) // 1000000 - case when (ns % 300000000000) % 1000000 > 0 then 1 else 0 end as bigint) as remaining_ms
    from d""",
)
def m6_m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M7 on two-level depths, M8 to the end of the five-minute window."""
    ev, p = A.events(spark, sf_dir), F.col("price")

    def level(offset: int, quantity) -> F.Column:
        return F.struct(
            (p + offset).cast("decimal(18,8)").alias("price"), quantity.cast("decimal(18,8)").alias("quantity")
        )

    rows = ev.select(
        F.col("seq").alias("row_sequence"),
        F.array(level(2, F.col("k") + 1), level(1, F.lit(2))).alias("depth_bids"),
        F.array(level(3, 100 - F.col("k"))).alias("depth_asks"),
        F.col("ns").alias("now_ns"),
        (F.expr("ns div 300000000000") * 300_000_000_000 + 300_000_000_000).alias("end_timestamp_ns"),
    )
    out = metrics.with_remaining(metrics.with_depth_metrics(rows))
    return out.select(
        "row_sequence",
        num("top20_bid_notional").alias("top20_bid_notional"),
        num("top20_ask_notional").alias("top20_ask_notional"),
        num("top20_depth_imbalance", 7).alias("top20_depth_imbalance"),
        "remaining_ms",
    )


# ---- B --------------------------------------------------------------------

def _epochs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    """The rows of all books with their epochs, and the chunks that scans of a book need."""
    rows = A.book_rows(A.lines(spark, sf_dir))
    chunk_rows = chunks_needed(rows, ["asset_id"])
    return materialize(book.book_epochs(rows, chunk_rows=chunk_rows)), chunk_rows


@query(
    "b1_book_epochs",
    f"""with {BK} select seq as event_sequence, epoch, epoch is not null as initialized, rn as row_no from bk""",
)
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book.book_epochs(A.book_rows(A.lines(spark, sf_dir)))
    return rows.select(F.col(SEQ).alias("event_sequence"), "epoch", "initialized", "row_no")


@query(
    "b1_epochs_with_boundaries",
    f"""with {BK}, c as (select b.*, x.seq as cut from bk b
      asof left join (select seq from li where l_linenumber = 1 and l_tax = 0.08) x on b.seq >= x.seq)
    select seq as event_sequence, case when epoch is null or cut > epoch then null else epoch end as epoch from c""",
)
def b1_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows also cut every book, as a lost connection does."""
    li = A.lines(spark, sf_dir)
    cuts = li.where("l_linenumber = 1 and l_tax = 0.08").select(SEQ)
    rows = book.book_epochs(A.book_rows(li), cuts)
    return rows.select(F.col(SEQ).alias("event_sequence"), "epoch")


@query(
    "b2_level_intervals",
    f"""with {BK}, w as (select u.*, b.rn, lead(b.rn) over (partition by u.asset, u.epoch, side, price order by u.seq) as nxt
        from upd u join bk b using (seq)),
      e as (select asset, epoch, max(rn) + 1 as fin from bk where epoch is not null group by all)
    select w.asset::varchar as asset_id, w.epoch, side, cast(price as double) as price, cast(qty as double) as quantity,
      rn as valid_from, coalesce(nxt, fin) as valid_to
    from w join e using (asset, epoch) where qty > 0""",
)
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = book.level_intervals(*_epochs(spark, sf_dir))
    return out.select(
        "asset_id", "epoch", "side", num("price").alias("price"), num("quantity").alias("quantity"),
        "valid_from", "valid_to",
    )


@query(
    "b3_early_deltas",
    f"""with {BK} select n <= 4 and epoch is null as early, count(*) as events from bk group by all""",
)
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = book.early_deltas(book.book_epochs(A.book_rows(A.lines(spark, sf_dir))))
    both = kept.select(F.lit(False).alias("early")).unionByName(
        dropped.select(F.lit(True).alias("early"))
    )
    return both.groupBy("early").agg(F.count("*").alias("events"))


@query(
    "b4_top_levels",
    f"""with {BK}, pts as (select * from bk where n = 5 and epoch is not null), {LEVELS_AT},
      s as (select *, row_number() over (partition by seq, side order by case when side = 'bids' then -price else price end) as r from st)
    select p.asset::varchar as asset_id, p.rn as row_no,
      coalesce(string_agg(cast(price as decimal(18,2)) || 'x' || cast(qty as bigint), ',' order by r) filter (side = 'bids'), '') as bids,
      coalesce(string_agg(cast(price as decimal(18,2)) || 'x' || cast(qty as bigint), ',' order by r) filter (side = 'asks'), '') as asks
    from s join pts p using (seq) where r <= 5 group by all""",
)
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best levels a side at each point."""
    epochs, chunk_rows = _epochs(spark, sf_dir)
    points = epochs.where("stream = 'point' and initialized").select(*book.EPOCH, book.ROW)
    top = book.top_n(book.levels_at(points, book.level_intervals(epochs, chunk_rows)), 5)

    def text(side: str):
        return F.array_join(
            F.transform(
                side,
                lambda l: F.concat(
                    l["price"].cast("decimal(18,2)").cast("string"),
                    F.lit("x"),
                    l["quantity"].cast("bigint").cast("string"),
                ),
            ),
            ",",
        )

    return top.select("asset_id", "row_no", text("bids").alias("bids"), text("asks").alias("asks"))


@query(
    "j7_levels_at",
    f"""with {BK}, pts as (select * from bk where n = 5 and epoch is not null), {LEVELS_AT}
    select asset::varchar as asset_id, side, count(*) as levels, round(sum(cast(price * qty as double)), 4) as notional
    from st group by all""",
)
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs, chunk_rows = _epochs(spark, sf_dir)
    points = epochs.where("stream = 'point' and initialized").select(*book.EPOCH, book.ROW)
    levels = book.levels_at(points, book.level_intervals(epochs, chunk_rows))
    return levels.groupBy("asset_id", "side").agg(
        F.count("*").alias("levels"), num(F.sum(F.col("price") * F.col("quantity")), 4).alias("notional")
    )


@query(
    "b5_b6_best_prices",
    f"""with {BK}, pts as (select * from bk where epoch is not null), {LEVELS_AT},
      m as (select seq, max(price) filter (side = 'bids') as bid, min(price) filter (side = 'asks') as offer from st group by 1)
    select p.asset::varchar as asset_id, p.seq as event_sequence, cast(bid as double) as best_bid, cast(offer as double) as best_ask,
      coalesce(bid < offer, true) as uncrossed
    from pts p left join m using (seq)""",
)
def b5_b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best prices after every book event, and the cross check."""
    epochs, chunk_rows = _epochs(spark, sf_dir)
    best = book.best_at(
        materialize(epochs.where("initialized").select("asset_id", "epoch", SEQ, "row_no")),
        materialize(book.level_intervals(epochs, chunk_rows)),
    )
    return book.coherence(best).select(
        "asset_id", F.col(SEQ).alias("event_sequence"), num("best_bid").alias("best_bid"),
        num("best_ask").alias("best_ask"), "uncrossed",
    )


@query(
    "b7_divergence",
    f"""with recursive {BK}, pts as (select * from bk where epoch is not null), {LEVELS_AT},
      m as (select seq, max(price) filter (side = 'bids') as bid, min(price) filter (side = 'asks') as offer from st group by 1),
      e as materialized (select p.asset, p.seq, p.n, p.epoch, row_number() over (partition by p.asset order by p.seq) as i,
          coalesce(bid < offer, true) as ok,
          p.n = 6 and (bid is distinct from case when tax < 0.04 then 0.11 else lp end
            or offer is distinct from case when tax < 0.04 then 0.07 else p.ask end) as miss
        from pts p left join m using (seq)),
      f as (
        select asset, seq, i, miss, 0 as misses, ok as coherent from e where i = 1
        union all
        select e.asset, e.seq, e.i, e.miss,
          case when e.n = 7 then 0 when e.miss then f.misses + 1 when e.n = 6 and f.coherent then 0 else f.misses end,
          case when e.n <= 4 or e.n = 7 then e.ok when e.miss and f.misses >= 2 then false else f.coherent end
        from f join e on e.asset = f.asset and e.i = f.i + 1)
    select asset::varchar as asset_id, seq as event_sequence, miss as mismatch, coherent from f""",
)
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs, chunk_rows = _epochs(spark, sf_dir)
    live = epochs.where("initialized").select(*book.EPOCH, book.ROW, SEQ, "stream", "p_best")
    best = book.coherence(book.best_at(live, materialize(book.level_intervals(epochs, chunk_rows))))
    return book.divergence_fold(best).select(
        "asset_id", F.col(SEQ).alias("event_sequence"), "mismatch", "coherent"
    )


@query(
    "b8_carry_attributes",
    f"""with {BK}
    select seq as event_sequence,
      cast(last_value(case when n = 1 then case when buys then lp else ask end end ignore nulls) over w as double) as last_trade_price,
      cast(last_value(case when n = 2 then lp end ignore nulls) over w as double) as tick_size,
      last_value(case when n <> 5 then epoch_us(l_shipdate) * 1000 end ignore nulls) over w as last_event_timestamp_ns
    from (select bk.*, li.l_shipdate from bk join li using (seq))
    window w as (partition by asset order by seq rows between unbounded preceding and current row)""",
)
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.book_rows(A.lines(spark, sf_dir)).withColumn("life", F.lit(0).cast("bigint"))
    out = book.carry_attributes(rows, chunk_rows=chunks_needed(rows, ["asset_id"]))
    return out.select(
        F.col(SEQ).alias("event_sequence"),
        num("last_trade_price").alias("last_trade_price"),
        num("tick_size").alias("tick_size"),
        "last_event_timestamp_ns",
    )


# ---- B9, R: whole snapshots over an archive made from the line items --------

def _level_text(column: str):
    """Levels as ``price x quantity``, in book order."""
    plain = lambda v: F.regexp_replace(v.cast("string"), r"\.?0+$", "")
    return F.array_join(
        F.transform(column, lambda e: F.concat(plain(e["price"]), F.lit("x"), plain(e["quantity"]))), ","
    )


# whole snapshots, shared with their stream
SNAPSHOTS_SQL = (
    WITH_ARCHIVE
    + """ select seq as snapshot_sequence, cast(oracle_price as double) as oracle_price, cast(last_price as double) as last_price,
      cast(best_bid as double) as best_bid, round(cast((best_bid + 1) * bq + best_bid as double) / cast(bq + 1 as double), 8) as microprice,
      round(cast(depth_price * depth_q - (depth_price + 1) * depth_q as double) / cast((2 * depth_price + 1) * depth_q as double), 7) as depth_imbalance,
      cast(coalesce(buys, 0) as double) as buy_volume_1s,
      cast(up_bid_5 as double) as up_best_bid, cast(up_best_ask_5 as double) as up_best_ask, up_bids_5, up_asks_5, down_bids_5,
      down_asks_5, up_bids_15, up_asks_15, down_bids_15, down_asks_15,
      len(reasons) = 0 as ready, array_to_string(reasons, ',') as reasons from why"""
)


@query("r3_build_snapshots", SNAPSHOTS_SQL)
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete snapshots of the archive."""
    return snapshot_columns(build_snapshots(archive_events(spark, sf_dir)))


def snapshot_columns(s: DataFrame) -> DataFrame:
    window = F.filter("binance.rolling_windows", lambda w: w["window_seconds"] == 1)
    return s.select(
        "snapshot_sequence",
        num("chainlink.price").alias("oracle_price"),
        num("binance.last_price").alias("last_price"),
        num("binance.best_bid").alias("best_bid"),
        num("binance.microprice").alias("microprice"),
        num("binance.top20_depth_imbalance", 7).alias("depth_imbalance"),
        num(F.get(window, 0)["buy_volume"]).alias("buy_volume_1s"),
        num("market_5m.up.best_bid").alias("up_best_bid"),
        num("market_5m.up.best_ask").alias("up_best_ask"),
        *[
            F.coalesce(_level_text(f"market_{tf}m.{side}.{half}"), F.lit("")).alias(f"{side}_{half}_{tf}")
            for tf in (5, 15) for side in ("up", "down") for half in ("bids", "asks")
        ],
        F.col("ready_for_strategy").alias("ready"),
        F.array_join("not_ready_reasons", ",").alias("reasons"),
    )


# no tick rows: a tick every 3 s, after the events of its time; 20 lines are 3 s
_GRID = WITH_ARCHIVE.replace(
    "tk as (select * from ar where n = 5)",
    """tk as (
  select 20 * j as seq, 1690000000000000000 + j * 3000000000 as ns, k, 1 + (k + 1) // 2 as cuts, false as o
  from (select j, least(20 * j // 2000, (select max(k) from ar)) as k
    from (select unnest(range(0, (select max(seq) // 20 + 1 from ar))) as j)))""",
).replace(
    "case when not o then 'clob_disconnected' end",
    "case when m5.number > 0 and m5.number % 4 in (0, 3) then 'clob_disconnected' end",
)


@query(
    "r3_on_grid",
    _GRID
    + """ select seq // 20 + 1 as snapshot_sequence, ns as snapshot_timestamp_ns, cast(oracle_price as double) as oracle_price,
      cast(last_price as double) as last_price, cast(coalesce(buys, 0) as double) as buy_volume_1s, up_bids_5, up_asks_5, down_bids_5,
      down_asks_5, up_bids_15, up_asks_15, down_bids_15, down_asks_15, array_to_string(reasons, ',') as reasons from why""",
)
def r3_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 into R3: snapshots every 3 s of the archive without its tick rows."""
    events = archive_events(spark, sf_dir).where("stream <> 'snapshot_tick'")
    # the sequence stays dense without the ticks
    events = number_rows(events, [SEQ], "_n").withColumn(SEQ, F.col("_n")).drop("_n")
    lines = A.table(spark, sf_dir, "lineitem").count()
    s = build_snapshots_on_grid(
        events, ARCHIVE_START, ARCHIVE_START + lines * LINE_NS, Params(tick_interval_ms=3000)
    )
    times = s.select("snapshot_sequence", "snapshot_timestamp_ns")
    return snapshot_columns(s).join(times, "snapshot_sequence").drop(
        "best_bid", "microprice", "depth_imbalance", "up_best_bid", "up_best_ask", "ready"
    )


# book rows at ticks, shared with their stream
BOOKS_SQL = WITH_ARCHIVE + """ select seq as tick_sequence, case when c < 2 then '5m' else '15m' end as timeframe,
      case when c % 2 = 0 then 'up' else 'down' end as outcome, market as market_id, session, initialized, coherent, resolved,
      cast(bid as double) as best_bid, cast(best_ask as double) as best_ask, bids, asks, cast(last_trade as double) as last_trade_price,
      cast(tick_size as double) as tick_size, event_ns as last_event_timestamp_ns
    from book"""


def book_columns(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of ``books_at`` under the line number of their tick."""
    return rows.join(lines, SEQ).select(
        "tick_sequence", "timeframe", "outcome", "market_id", F.col("source_session_id").alias("session"),
        "initialized", "coherent", "resolved", num("best_bid").alias("best_bid"), num("best_ask").alias("best_ask"),
        _level_text("bids").alias("bids"), _level_text("asks").alias("asks"),
        num("last_trade_price").alias("last_trade_price"), num("tick_size").alias("tick_size"), "last_event_timestamp_ns",
    )


def tick_lines(events: DataFrame) -> DataFrame:
    return events.where("stream = 'snapshot_tick'").select(SEQ, F.col("p_tick.snapshot_sequence").alias("tick_sequence"))


@query("b9_books_at", BOOKS_SQL)
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = archive_events(spark, sf_dir)
    ticks = events.where("stream = 'snapshot_tick'").select(SEQ)
    books = events.where(F.col("stream").startswith("clob_"))
    states = events.where("stream = 'market_window_state'")
    status = events.where("stream = 'source_status'")
    return book_columns(book.books_at(ticks, books, states, status), tick_lines(events))


_FILE_LEVELS = [f"{side}_{half}_{tf}" for tf in (5, 15) for side in ("up", "down") for half in ("bids", "asks")]


FILES_SQL = (
    WITH_ARCHIVE
    + """ select 1 as schema_version, seq as snapshot_sequence, ns as snapshot_timestamp_ns, oracle_price::varchar as chainlink_price,
      last_price::varchar as binance_last_price, best_bid::varchar as binance_best_bid, (best_bid + 1)::varchar as binance_best_ask,
      coalesce(depth_price || 'x' || cast(depth_q as bigint), '') as binance_depth_bids,
      coalesce((depth_price + 1) || 'x' || cast(depth_q as bigint), '') as binance_depth_asks, """
    + ", ".join(f"{c} as market_{c.rsplit('_', 1)[1]}m_{c.rsplit('_', 1)[0]}" for c in _FILE_LEVELS)
    + """, len(reasons) = 0 as ready_for_strategy, array_to_string(reasons, ',') as not_ready_reasons,
      len(reasons)::bigint as json_reasons, cast(coalesce(buys, 0) as double) as json_buy_volume_1s,
      cast(up_bid_5 as double) as json_up_best_bid, down_asks_15 as json_down_asks from why"""
)


def file_rows(rows: DataFrame) -> DataFrame:
    """All file columns of flat snapshots, and some of the nested ``snapshot`` beside them."""
    levels = [c for c, kind in SNAPSHOT_FILE.items() if kind == TEXT_LEVELS]
    plain = [c for c in SNAPSHOT_FILE if c not in (*levels, "snapshot_json", "not_ready_reasons")]
    text = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws("x", e["price"], e["quantity"])), ",")
    return rows.select(
        *plain, *[text(c).alias(c) for c in levels],
        F.array_join("not_ready_reasons", ",").alias("not_ready_reasons"),
        F.size("snapshot.not_ready_reasons").cast("bigint").alias("json_reasons"),
        num(F.get("snapshot.binance.rolling_windows", 0)["buy_volume"]).alias("json_buy_volume_1s"),
        num("snapshot.market_5m.up.best_bid").alias("json_up_best_bid"),
        F.coalesce(_level_text("snapshot.market_15m.down.asks"), F.lit("")).alias("json_down_asks"),
    )


@query("r4_flatten_snapshots", FILES_SQL)
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All file columns; the JSON text restores the nested snapshot."""
    rows = flatten_snapshots(build_snapshots(archive_events(spark, sf_dir)))
    return file_rows(rows.withColumn("snapshot", snapshot_from_json(F.col("snapshot_json"))))


READY = """case when k % 2 = 0 then 'chainlink_disconnected' end, case when k > 50 then 'chainlink_stale' end,
  case when k % 2 = 0 then 'binance_disconnected' end, case when k > 10 then 'binance_depth_stale' end,
  case when k > 25 then 'binance_trade_stale' end, case when k % 5 = 0 then 'binance_book_ticker_missing' end,
  case when k % 2 = 0 then 'clob_disconnected' end, case when k % 3 = 0 then 'no_active_market' end,
  case when k % 3 = 1 then '5m:market_not_active' end"""


@query(
    "r2_readiness",
    f"""with {EV}, r as (select seq, list_filter([{READY}], lambda x: x is not null) as reasons from ev)
    select seq as row_sequence, len(reasons) = 0 as ready, array_to_string(reasons, ',') as reasons from r""",
)
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, k = A.events(spark, sf_dir), F.col("k")
    m = F.from_json(
        F.when(k % 3 == 1, '{"timeframe":"5m","not_ready_reasons":["5m:market_not_active"]}').when(
            k % 3 == 2, '{"timeframe":"5m","not_ready_reasons":[]}'
        ),
        type_of(MARKET),
    )
    on = k % 2 == 1
    rows = ev.withColumns(
        {
            "oracle_age_ms": k * 200,
            "depth_age_ms": k * 100,
            "trade_age_ms": k * 200,
            "has_ticker": k % 5 != 0,
            "market_5m": m,
            "market_15m": F.lit(None).cast(MARKET),
            **{f"connected_{s}": on for s in ("chainlink_rtds", "binance_spot", "clob")},
        }
    )
    out = readiness(rows, connectivity="status_events")
    return out.select(
        F.col("seq").alias("row_sequence"),
        F.col("ready_for_strategy").alias("ready"),
        F.array_join("not_ready_reasons", ",").alias("reasons"),
    )


@query(
    "r1_timeframe_snapshot",
    WITH_ARCHIVE
    + """ select seq as tick_sequence, tf as timeframe, 'm-' || tf || '-' || number as market_id, resolved,
      len(reasons) = 0 as ready, array_to_string(reasons, ',') as reasons,
      greatest(0, (1690000000000000000 + (number + 1) * case tf when '5m' then 300000000000 else 900000000000 end - t.ns) // 1000000) as remaining_ms
    from markets join (select seq, ns from tk) t using (seq)""",
)
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = archive_events(spark, sf_dir)
    ticks = events.where("stream = 'snapshot_tick'").select(
        SEQ, F.col("p_tick.scheduled_timestamp_ns").alias("now_ns")
    )
    states = events.where("stream = 'market_window_state'")
    status = events.where("stream = 'source_status'")
    books = book.books_at(ticks, events.where(F.col("stream").startswith("clob_")), states, status)
    contexts = asof.asof_market_state(ticks, states)
    out = timeframe_snapshot(ticks, contexts, books)
    both = F.explode(F.array("market_5m", "market_15m")).alias("m")
    return out.join(tick_lines(events), SEQ).select("tick_sequence", both).select(
        "tick_sequence",
        F.col("m.timeframe").alias("timeframe"),
        F.col("m.market_id").alias("market_id"),
        F.col("m.resolved").alias("resolved"),
        F.col("m.ready").alias("ready"),
        F.array_join("m.not_ready_reasons", ",").alias("reasons"),
        F.col("m.remaining_ms").alias("remaining_ms"),
    )
