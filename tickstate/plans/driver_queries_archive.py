"""Driver queries for the calendar, audits, files and streams (D, Q, A4-A10, S, ST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstate.functions import calendar as C
from tickstate.operators import audit
from tickstate.operators import market_calendar as cal
from tickstate.operators.asof import SEQ
from tickstate.operators.ordered import holding, kept_rows, release
from tickstate.operators.normalise import normalise_events, unsupported_versions
from tickstate.operators.ordering import ARRIVAL
from tickstate.operators.parse_common import event_columns
from tickstate.params import RESOLUTION_SOURCE
from tickstate.plans import adapters as A
from tickstate.plans.driver_queries import EV, HORIZON_SQL, WINDOWS, cut, horizon_rows, num, query, shared_dir
from tickstate.plans.archive_fixture import WITH_ARCHIVE, archive_events
from tickstate.plans.driver_queries_state import (
    BOOKS_SQL,
    FILES_SQL,
    SNAPSHOTS_SQL,
    book_columns,
    file_rows,
    rolled,
    rolling_sql,
    snapshot_columns,
    tick_lines,
)
from tickstate.plans.replay import replay
from tickstate.plans.snapshot import flatten_snapshots, kept_snapshots, snapshot_from_json
from tickstate.schemas import EVENT_COLUMNS, ddl
from tickstate.sources import archive
from tickstate.sources.frames import number_frames, read_frames, read_market_payloads
from tickstate.streaming import books, snapshots, stateful, streams

# ---- D --------------------------------------------------------------------


@query(
    "d1_d2_windows",
    """with o as (select o_orderkey, epoch(o_orderdate)::bigint + o_orderkey as t from orders),
      d as (select * from (values ('5m', 300), ('15m', 900)) v(timeframe, s))
    select o_orderkey, timeframe, (t - t % s) * 1000000 as start_us, (t - t % s + s) * 1000000 as end_us,
      'btc-updown-' || timeframe || '-' || (t - t % s) as slug
    from o cross join d""",
)
def d1_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cal.with_window(_order_times(spark, sf_dir), "at")
    return rows.select(
        "o_orderkey",
        "timeframe",
        F.unix_micros("window_start").alias("start_us"),
        F.unix_micros("window_end").alias("end_us"),
        "slug",
    )


def _order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.timestamp_seconds(seconds).alias("at")
    )


def _market_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetched market object per order, broken in one of many ways by customer."""
    rows = _order_times(spark, sf_dir)
    tf = F.when(F.col("o_orderkey") % 2 == 0, "5m").otherwise("15m")
    rows = rows.withColumn("timeframe", tf).withColumn(
        "expected_start", C.window_start(F.col("at"), F.col("timeframe"))
    )
    start, end = F.col("expected_start"), C.plus_windows(F.col("expected_start"), F.col("timeframe"))
    kind = F.col("o_custkey") % 24
    key = F.col("o_orderkey").cast("string")

    def iso(at, pattern="yyyy-MM-dd'T'HH:mm:ss'Z'"):
        return F.date_format(at, pattern)

    hour_ahead = F.timestamp_micros(F.unix_micros(start) + 3_600_000_000)
    body = F.format_string(
        '{%s,"conditionId":"%s","slug":"%s","active":%s,"closed":%s,"archived":%s,"enableOrderBook":%s,'
        '"eventStartTime":"%s","endDate":"%s","resolutionSource":"%s","outcomes":%s,"clobTokenIds":%s}',
        F.when(kind == 0, '"id":null').when(kind == 21, F.concat(F.lit('"id":'), key)).otherwise(
            F.concat(F.lit('"id":"'), key, F.lit('"'))),
        F.when(kind == 1, " ").otherwise(F.concat(F.lit("c"), key)),
        F.when(kind == 2, "other").otherwise(C.slug(F.col("timeframe"), start)),
        F.when(kind == 3, "false").otherwise("true"),
        F.when(kind == 4, "true").otherwise("false"),
        F.when(kind == 5, "true").otherwise("null"),
        F.when(kind == 6, '"true"').otherwise("true"),
        F.when(kind == 7, iso(start, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 8, iso(end))
        .when(kind == 22, iso(hour_ahead, "yyyy-MM-dd'T'HH:mm:ss'+01:00'"))
        .otherwise(iso(start)),
        F.when(kind == 9, "soon").when(kind == 10, iso(start)).otherwise(iso(end)),
        F.when(kind == 11, " ")
        .when(kind == 12, RESOLUTION_SOURCE + "?a=1")
        .when(kind == 13, "https://example.org/x")
        .when(kind == 23, RESOLUTION_SOURCE.replace("https://data", "HTTPS://Data") + "/")
        .otherwise(RESOLUTION_SOURCE),
        F.when(kind == 14, '"nope"')
        .when(kind == 15, '["Up"]')
        .when(kind == 16, '["Up","Yes"]')
        .when(kind == 17, '["Up","up "]')
        .when(kind % 2 == 0, '["Up","Down"]')
        .otherwise('"[\\"Down\\",\\"Up\\"]"'),
        F.when(kind == 18, "7")
        .when(kind == 19, '["a"," "]')
        .when(kind == 20, '["a","a"]')
        .otherwise(F.concat(F.lit('["t1-'), key, F.lit('","t2-'), key, F.lit('"]'))),
    )
    return rows.select(
        "o_orderkey",
        "timeframe",
        "expected_start",
        F.col("at").alias("fetched_at"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(body).alias("body"),
        F.when((F.col("o_orderstatus") == "P") & (kind < 12), "unavailable").alias("error"),
    )


MK = """mk as (
  select o_orderkey, o_custkey % 24 as kind, o_orderstatus = 'P' as p, case when o_orderkey % 2 = 0 then '5m' else '15m' end as timeframe,
    case when o_orderkey % 2 = 0 then 300 else 900 end as d, epoch(o_orderdate)::bigint + o_orderkey as t from orders),
mr as (select *, t - t % d as start, ['id_missing', 'conditionId_empty', 'slug_mismatch', 'not_active', 'closed', 'archived',
    'order_book_disabled', 'eventStartTime_without_offset', 'start_mismatch', 'endDate_not_iso', 'end_mismatch',
    'resolutionSource_missing', 'resolutionSource_unsupported', 'resolutionSource_unexpected', 'outcomes_not_list',
    'not_two_entries', 'outcome_not_up_or_down', 'outcomes_not_distinct', 'clobTokenIds_not_list', 'token_empty',
    'tokens_not_distinct', null, null, null][kind + 1] as reason from mk)"""


@query(
    "d3_d6_validate_markets",
    f"""with {MK} select o_orderkey, coalesce(reason, 'ok') as reason,
      case when reason is null then start * 1000000000 end as start_timestamp_ns,
      case when reason is null then case when kind % 2 = 0 then 't1-' else 't2-' end || o_orderkey end as up_token_id
    from mr where not p""",
)
def d3_d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    markets, rejects = cal.validate_markets(_market_payloads(spark, sf_dir))
    return markets.select(
        "o_orderkey", F.lit("ok").alias("reason"), "start_timestamp_ns", "up_token_id"
    ).unionByName(
        rejects.select("o_orderkey", F.col("reject_reason").alias("reason")), allowMissingColumns=True
    )


@query(
    "d7_resolve_outcomes",
    f"""with {MK}, u as (select * from mr qualify row_number() over (partition by timeframe, start order by t desc, o_orderkey desc) = 1),
    r as (select *, case when p and kind < 12 then 'error' when p or reason is not null then 'not_found' else 'found' end as outcome from u)
    select timeframe, start * 1000000 as start_us, outcome, case when outcome = 'found' then o_orderkey::varchar end as market_id,
      case when outcome = 'error' then 'unavailable' when not p then reason end as error from r""",
)
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every boundary that was asked for, with all its answers."""
    payloads = _market_payloads(spark, sf_dir)
    out = cal.resolve_outcomes(
        payloads.select(*cal.BOUNDARY).distinct(), payloads, newest=("fetched_at", "o_orderkey")
    )
    return out.select(
        "timeframe", F.unix_micros("expected_start").alias("start_us"), "outcome",
        F.col("market.market_id").alias("market_id"), "error",
    )


@query(
    "d8_current_and_next",
    f"""with {MK}, v as (select timeframe, start, min(o_orderkey::varchar) as id from mr where not p and reason is null group by all),
      w as (select k.o_orderkey, x.timeframe, x.s, k.t - k.t % x.s as start from mk k cross join (values ('5m', 300), ('15m', 900)) x(timeframe, s))
    select w.o_orderkey, w.timeframe, c.id as current_id, n.id as next_id
    from w left join v c on c.timeframe = w.timeframe and c.start = w.start
      left join v n on n.timeframe = w.timeframe and n.start = w.start + w.s""",
)
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    markets, _ = cal.validate_markets(_market_payloads(spark, sf_dir))
    times = _order_times(spark, sf_dir).select("o_orderkey", "at")
    return cal.current_and_next(times, markets).select(
        "o_orderkey", "timeframe",
        F.col("current_market.market_id").alias("current_id"),
        F.col("next_market.market_id").alias("next_id"),
    )


AT = """att as (
  select seq, case when user_id % 2 = 0 then '5m' else '15m' end as timeframe, case when user_id % 2 = 0 then 300 else 900 end as d,
    epoch_us(event_at) // 1000000 as t, event_type, k from ev),
ab as (select *, t - t % d + d as start from att),
aa as (select *, start * 1000000 - 5000000 + (k % 21) * 500000 as asked,
    start * 1000000 - 5000000 + (k % 21) * 500000 + 100000 + seq % 1000 * 100 as done,
    event_type in ('view', 'purchase', 'click') as found, case when event_type = 'error' then 'http ' || k end as error from ab),
an as (select *, row_number() over (partition by timeframe, start order by asked, done) as no from (
  select * from aa qualify row_number() over (partition by timeframe, start, asked order by done) = 1)),
tr as (
  select timeframe, start, any_value(d) as d, min(asked) as searched, min(no) filter (where found) as fno, min(done) filter (where found and no = ff) as found_at,
    max(no) as tries, max(done) as finished, arg_max(coalesce(error, 'market_not_found'), no) as last,
    count(*) filter (where done < start * 1000000) as early_n,
    arg_max(coalesce(error, 'market_not_found'), no) filter (where done < start * 1000000) as early_error
  from (select *, min(no) filter (where found) over (partition by timeframe, start) as ff from an)
  group by timeframe, start)"""


@query(
    "d9_transition_results",
    f"""with {EV}, {AT}
    select t.timeframe, t.start * 1000000 as start_us, t.fno is not null as success, coalesce(t.fno, t.tries) as attempt_count,
      case when t.fno is not null then greatest(0, (t.found_at - t.start * 1000000) // 1000) end as transition_delay_ms,
      case when t.fno is null then t.last end as last_error, t.searched as search_us,
      case when t.fno is not null then 'm-' || t.start end as new_market_id,
      case when p.fno is not null then 'm-' || p.start end as previous_market_id
    from tr t left join tr p on p.timeframe = t.timeframe and p.start = t.start - t.d""",
)
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cal.transition_results(A.attempts(A.events(spark, sf_dir)), tie=("seq",))
    return out.select(
        "timeframe",
        F.unix_micros("expected_start").alias("start_us"),
        "success",
        "attempt_count",
        "transition_delay_ms",
        "last_error",
        F.unix_micros("search_started_at").alias("search_us"),
        F.col("new_market.market_id").alias("new_market_id"),
        F.col("previous_market.market_id").alias("previous_market_id"),
    )


@query(
    "d10_state_timeline",
    f"""with {EV}, {AT}, x as (
      select t.*, t.start * 1000000 as t0, p.fno is not null as had, (p.start + p.d) * 1000000 as prev_end, nx.searched as next_search,
        t.fno is not null and t.found_at < t.start * 1000000 as early
      from tr t left join tr p on p.timeframe = t.timeframe and p.start = t.start - t.d
        left join tr nx on nx.timeframe = t.timeframe and nx.start = t.start + t.d),
    s as (
      select timeframe, t0, 1 as step, 'searching_next' as state, searched as moment, 0 as attempts, next_search from x
      union all select timeframe, t0, 2, 'searching_next', t0, early_n, next_search from x where had and searched < t0 and not early
      union all select timeframe, t0, 3, 'next_ready', found_at, fno, next_search from x where early
      union all select timeframe, t0, 4, 'active', greatest(t0, found_at), fno, next_search from x where fno is not null
      union all select timeframe, t0, 5, 'transition_failed', finished, tries, next_search from x where fno is null)
    select timeframe, t0 as start_us, step, state, moment as from_us,
      coalesce(lead(moment) over (partition by timeframe, t0 order by step), next_search) as to_us, attempts as attempt_count from s""",
)
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cal.state_timeline(cal.transition_results(A.attempts(A.events(spark, sf_dir)), tie=("seq",)))
    return out.select(
        "timeframe",
        F.unix_micros("expected_start").alias("start_us"),
        "step",
        "state",
        F.unix_micros("valid_from").alias("from_us"),
        F.unix_micros("valid_to").alias("to_us"),
        "attempt_count",
    )


@query(
    "d11_startup_results",
    f"""with {EV}, {AT}, x as (select *, row_number() over (partition by timeframe, event_type, t // 86400 order by asked, done + k * 20000000) as r,
        found and (start + d) * 1000000 > done + k * 20000000 as alive from aa),
      g as (select timeframe, event_type, t // 86400 as day, min(r) filter (where alive) as a, max(r) as seen, arg_max(case when found then 'market_expired_during_startup'
          else coalesce(error, 'market_not_found') end, r) as last from x where r <= 3 group by all)
    select timeframe, event_type, day, case when a is not null then 'active' else 'transition_failed' end as state,
      coalesce(a, seen) as attempt_count, case when a is null then last end as last_error from g""",
)
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One startup per timeframe, event type and day; slow answers come too late."""
    ev = A.events(spark, sf_dir)
    extra = ev.select("seq", "event_type", "k", F.expr("unix_seconds(at) div 86400").alias("day"))
    attempts = A.attempts(ev).join(extra, "seq").withColumn(
        "resolved_at", F.timestamp_micros(F.unix_micros("resolved_at") + F.col("k") * 20_000_000)
    )
    out = cal.startup_results(attempts, 3, ("timeframe", "event_type", "day"))
    return out.select("timeframe", "event_type", "day", "state", "attempt_count", "last_error")


@query(
    "d12_s7_transition_log",
    f"""with {EV}, {AT}
    select timeframe, case when fno is not null then 'success' else 'failed' end as status, count(*) as transitions,
      cast(sum(coalesce(fno, tries)) as bigint) as attempts,
      min(strftime(make_timestamp(start * 1000000), '%Y-%m-%dT%H:%M:%SZ')) as first_start
    from tr group by all""",
)
def d12_s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows written to and read back from JSON lines."""
    rows = cal.transition_rows(cal.transition_results(A.attempts(A.events(spark, sf_dir)), tie=("seq",)))
    path = shared_dir(spark, "transitions")
    archive.write_transitions(rows, path)
    return archive.read_transitions(spark, path).groupBy("timeframe", "status").agg(
        F.count("*").alias("transitions"),
        F.sum("attempt_count").alias("attempts"),
        F.min("expected_start_utc").alias("first_start"),
    )


@query(
    "d13_invariant_violations",
    f"""with {EV}, {AT} select timeframe, case when fno is null then 'failure_with_market' else 'success_with_error' end as violation,
      count(*) as n from tr group by all""",
)
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result is made contradictory; sound results give no row."""
    sound = cal.transition_results(A.attempts(A.events(spark, sf_dir)), tie=("seq",))
    broken = sound.withColumns(
        {
            "last_error": F.coalesce("last_error", F.lit("late")),
            "transition_delay_ms": F.coalesce("transition_delay_ms", F.lit(0).cast("bigint")),
        }
    )
    rows = cal.invariant_violations(broken).unionByName(cal.invariant_violations(sound))
    return rows.groupBy("timeframe", "violation").agg(F.count("*").alias("n"))


# ---- Q and reports ---------------------------------------------------------

@query(
    "q1_sequence_gaps",
    f"""with {EV}, e as (select seq from ev where event_type <> 'error' union all select seq from ev where event_type = 'signup'),
      d as (select seq, count(*) as n, lead(seq) over (order by seq) as nxt from e group by seq)
    select 'gap' as kind, seq + 1 as first_sequence, nxt - 1 as last_sequence, nxt - seq - 1 as rows from d where nxt > seq + 1
    union all select 'duplicate', seq, seq, n from d where n > 1""",
)
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir).withColumnRenamed("seq", SEQ)
    rows = ev.where("event_type <> 'error'").unionByName(ev.where("event_type = 'signup'"))
    return audit.sequence_gaps(rows)


SG = """sg as (
  select event_type as source, seq // 200 as part, min(seq) as lo, max(seq) + max(k) as hi, count(*) as n from ev group by all)"""


def _segments(ev: DataFrame) -> DataFrame:
    return ev.groupBy(F.col("event_type").alias("source"), F.expr("seq div 200").alias("part")).agg(
        F.count("*").alias("event_count"),
        F.min("seq").alias("first_ingest_sequence"),
        (F.max("seq") + F.max("k")).alias("last_ingest_sequence"),
    ).withColumns(
        {"stream": F.lit("x"), "file_path": F.concat_ws("/", "source", F.col("part").cast("string"))}
    )


@query(
    "q2_segment_overlaps",
    f"""with {EV}, {SG}, o as (select *, max(hi) over (partition by source order by lo rows between unbounded preceding and 1 preceding) as before from sg)
    select source || '/' || part as file_path, lo as first_ingest_sequence, before as earlier_last_sequence from o where before >= lo""",
)
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.segment_overlaps(_segments(A.events(spark, sf_dir)))
    return out.select("file_path", "first_ingest_sequence", "earlier_last_sequence")


@query(
    "q3_j9_a6_manifest_mismatches",
    f"""with {EV}, {SG}, f as (select event_type as source, seq // 200 as part, min(seq) as lo, max(seq) as hi, count(*) as n from ev where k <> 7 group by all)
    select sg.source || '/' || sg.part as file_path,
      case when f.n is null then 'file_missing' when f.n <> sg.n then 'event_count' when f.lo <> sg.lo then 'first_ingest_sequence'
        when f.hi <> sg.hi then 'last_ingest_sequence' end as mismatch
    from sg left join f using (source, part) where f.n is null or f.n <> sg.n or f.lo <> sg.lo or f.hi <> sg.hi""",
)
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 statistics of files that lost some rows, against their manifests."""
    ev = A.events(spark, sf_dir)
    files = ev.where("k <> 7").select(
        F.concat_ws("/", "event_type", F.expr("seq div 200").cast("string")).alias("file_path"),
        F.col("seq").alias(SEQ),
        F.col("ns").alias("received_wall_timestamp_ns"),
    )
    out = audit.manifest_mismatches(audit.segment_stats(files), _segments(ev))
    return out.select("file_path", "mismatch")


@query(
    "q5_quarantine",
    f"""with {EV} select case when k < 5 then 'truncated' when k < 8 then 'not_object' else 'good' end as reason, count(*) as lines from ev group by 1""",
)
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an archive, some cut short, split while reading."""
    ev, k = A.events(spark, sf_dir), F.col("k")
    line = F.format_string(
        '{"schema_version":2,"ingest_sequence":%d,"event_id":"e%d","payload":{"price":"%s"}}',
        "seq", "seq", A.value_text(),
    )
    text = F.when(k < 5, F.expr("substring(line, 1, length(line) - 4)")).when(k < 8, "PONG").otherwise(F.col("line"))
    path = shared_dir(spark, "lines")
    rows = ev.withColumn("line", line).select(
        text.alias("value"), F.col("event_type").alias("source"), F.lit("x").alias("stream")
    )
    rows.write.partitionBy("source", "stream").option("compression", "gzip").text(f"{path}/date=2024-01-01/hour=00")
    raw = _read_lines(spark, path)
    good, bad = audit.quarantine(raw)
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy(
        "reason"
    ).agg(F.count("*").alias("lines"))


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    from tickstate.schemas import ddl

    return (
        spark.read.schema(ddl(archive.LINE | {archive.CORRUPT: "STRING", "date": "STRING", "hour": "STRING"}))
        .option("columnNameOfCorruptRecord", archive.CORRUPT)
        .json(path)
    )


@query(
    "q6_missing_segments",
    f"""with {EV}, {SG} select source || '/' || part as file_path from sg where n < 40""",
)
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(A.events(spark, sf_dir))
    files = segments.select("file_path")
    return audit.missing_segments(files, segments.where("event_count >= 40"))


@query(
    "q8_unsupported_versions",
    f"""with {EV} select event_type, count(*) as events from ev where k not in (1, 2) group by 1""",
)
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir).withColumn("schema_version", F.col("k").cast("int"))
    return unsupported_versions(ev).groupBy("event_type").agg(F.count("*").alias("events"))


@query(
    "p2_normalise_events",
    f"""with {EV} select seq as ingest_sequence,
      case when k = 0 then 'unsupported_schema_version' when k = 1 then 'unknown_stream' when k = 2 then 'decimal_out_of_range'
        when k = 3 then 'invalid_payload' else 'ok' end as reason,
      case when k > 3 and not (event_type = 'signup' and k % 2 = 1) then cast(price as double) end as price,
      case when k > 3 and event_type = 'signup' and k % 2 = 1 then 'm' || k end as legacy_market
    from ev""",
)
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived lines of both versions: prices, trades and market states."""
    ev, k = A.events(spark, sf_dir), F.col("k")
    kind = F.col("event_type")
    price = F.when(k == 2, "0.1234567890123456789").when(k == 3, F.lit(None).cast("string")).otherwise(A.value_text())
    quoted = F.coalesce(F.concat(F.lit('"'), price, F.lit('"')), F.lit("null"))
    is_trade, is_oracle = kind == "click", kind == "view"
    state = (kind == "signup") & (k % 2 == 1) & (k > 3)
    old = k % 2 == 1
    payload = (
        F.when(
            is_trade,
            F.format_string(
                '{"symbol":"BTCUSDT","aggregate_trade_id":%d,"price":%s,"quantity":"1","first_trade_id":1,"last_trade_id":2,"trade_timestamp_ns":%d,"taker_side":"buy"}',
                "seq", quoted, "ns",
            ),
        )
        .when(
            state,
            F.lit('{"state":"active","start_timestamp_ns":1,"end_timestamp_ns":2,"up_token_id":"u","down_token_id":"d"}'),
        )
        .otherwise(F.format_string('{"symbol":"btc/usd","price":%s}', quoted))
    )
    rows = ev.select(
        F.when(k == 0, 99).when(old & (k > 3), 1).otherwise(2).alias("schema_version"),
        F.col("seq").alias(SEQ),
        F.concat(F.lit("e"), F.col("seq").cast("string")).alias("event_id"),
        F.when(is_trade, "binance_spot").when(state, "market_discovery").otherwise("chainlink_rtds").alias("source"),
        F.when(k == 1, "other").when(is_trade, "binance_agg_trade").when(state, "market_window_state").otherwise("chainlink_price").alias("stream"),
        F.lit("x").alias("instrument"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("source_timestamp_ns", "server_timestamp_ns")],
        F.col("ns").alias("received_wall_timestamp_ns"),
        F.col("ns").alias("received_monotonic_ns"),
        *[F.lit(None).cast("string").alias(c) for c in ("source_sequence", "asset_id", "outcome", "source_session_id")],
        F.lit("5m").alias("timeframe"),
        F.concat(F.lit("m"), k.cast("string")).alias("market_id"),
        F.lit("c").alias("condition_id"),
        payload.alias("payload"),
    )
    events, rejects = normalise_events(rows)
    value = F.coalesce("p_trade.price", "p_oracle.price")
    return events.select(
        SEQ,
        F.lit("ok").alias("reason"),
        num(value).alias("price"),
        F.col("p_market.current_market.slug").alias("legacy_market"),
    ).unionByName(
        rejects.select(SEQ, F.col("reject_reason").alias("reason")), allowMissingColumns=True
    )


@query(
    "q9_diff_snapshots",
    f"""with {EV} select seq as row_key, case when event_type = 'error' then 'only_in_first' else 'price' end as differences
    from ev where event_type = 'error' or k < 20""",
)
def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.events(spark, sf_dir).select(F.col("seq").alias("row_key"), "price", "k", "event_type")
    b = a.where("event_type <> 'error'").withColumn(
        "price", F.when(F.col("k") < 20, F.col("price") + 1).otherwise(F.col("price"))
    )
    out = audit.diff_snapshots(a, b, "row_key")
    return out.select("row_key", F.array_join("differences", ",").alias("differences"))


@query(
    "a4_count_by_stream",
    f"""with {EV}, n(stream) as (values ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('refund'))
    select n.stream, count(seq) as events from n left join ev on ev.event_type = n.stream group by 1""",
)
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir).select(F.col("event_type").alias("stream"))
    return audit.count_by_stream(ev, ("view", "click", "purchase", "signup", "error", "refund"))


@query(
    "a6_segment_stats",
    f"""with {EV} select event_type || '/' || cast(event_at as date) as file_path, count(*) as event_count, min(seq) as first_ingest_sequence,
      max(seq) as last_ingest_sequence, arg_min(ns, seq) as first_received_timestamp_ns, arg_max(ns, seq) as last_received_timestamp_ns
    from ev group by 1""",
)
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    return audit.segment_stats(
        ev.select(
            F.concat_ws("/", "event_type", F.date_format("at", "yyyy-MM-dd")).alias("file_path"),
            F.col("seq").alias(SEQ),
            F.col("ns").alias("received_wall_timestamp_ns"),
        )
    )


@query(
    "a7_replay_summary",
    f"""with {EV} select count(*) as events_processed, count(*) filter (event_type = 'error') as ticks_processed,
      min(seq) as first_ingest_sequence, max(seq) as last_ingest_sequence, count(*) filter (event_type = 'error') as snapshots_produced,
      min(seq) filter (event_type = 'error') as first_snapshot_sequence, max(seq) filter (event_type = 'error') as last_snapshot_sequence
    from ev""",
)
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir)
    rows = ev.select(
        F.col("seq").alias(SEQ),
        F.when(F.col("event_type") == "error", "snapshot_tick").otherwise("other").alias("stream"),
    )
    return audit.replay_summary(rows, A.ticks(ev).select(F.col(SEQ).alias("snapshot_sequence")))


@query(
    "a8_latency_percentiles",
    """with v as (select l_extendedprice / 1000 as x from lineitem)
    select unnest([0.5, 0.95, 0.99])::double as percent,
      round(unnest([quantile_cont(x, 0.5), quantile_cont(x, 0.95), quantile_cont(x, 0.99)]), 6) as value from v""",
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("ms"))
    out = audit.latency_percentiles(li, "ms")
    return out.select("percent", F.round("value", 6).alias("value"))


def _coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, k = A.events(spark, sf_dir), F.col("k")
    side = F.struct(F.concat(F.lit("s"), (k % 9).cast("string")).alias("source_session_id"))
    five = F.struct(F.concat(F.lit("m"), k.cast("string")).alias("market_id"), side.alias("up"), side.alias("down"))
    return ev.select(
        (k % 2 == 0).alias("ready_for_strategy"),
        F.when(k > 10, five).alias("market_5m"),
        F.struct(F.concat(F.lit("m"), (k % 30).cast("string")).alias("market_id")).alias("market_15m"),
    )


COVER = """c as (select count(*) as snapshots, count(*) filter (k % 2 = 0) as ready_snapshots, 12000::bigint as expected_snapshots,
      round(count(*) / 12000, 6) as delivery_ratio, count(distinct case when k > 10 then k end) as market_5m_ids,
      count(distinct k % 30) as market_15m_ids, count(distinct case when k > 10 then k % 9 end) as book_sessions from ev)"""


@query("a9_coverage_report", f"with {EV}, {COVER} select * from c")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage_report(_coverage_rows(spark, sf_dir), 12000)


@query(
    "a10_criteria",
    f"""with {EV}, {COVER} select unnest(['readiness_observed', 'snapshots_expected', 'market_5m_transition_observed', 'passed']) as criterion,
      unnest([ready_snapshots > 0, delivery_ratio >= 0.95, market_5m_ids >= 2,
        ready_snapshots > 0 and delivery_ratio >= 0.95 and market_5m_ids >= 2]) as passed from c""",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = audit.coverage_report(_coverage_rows(spark, sf_dir), 12000)
    return audit.criteria(
        report,
        {
            "readiness_observed": F.col("ready_snapshots") > 0,
            "snapshots_expected": F.col("delivery_ratio") >= 0.95,
            "market_5m_transition_observed": F.col("market_5m_ids") >= 2,
        },
    )


# ---- S: files ---------------------------------------------------------------

# 2023-11-15T00:00:00Z
HOURS_FROM = 1_700_006_400_000_000_000


def _simple_events(ev: DataFrame) -> DataFrame:
    """Trades and oracle prices as typed archive events; a day of events is an hour here."""
    ev = ev.withColumn("ns", F.lit(HOURS_FROM) + F.expr("(ns - 1704067200000000000) div 24"))
    trade = F.col("event_type").isin("purchase", "click")
    rows = event_columns(
        {
            "schema_version": F.lit(2),
            "ingest_sequence": F.col("seq"),
            "event_id": F.concat(F.lit("e"), F.col("seq").cast("string")),
            "source": F.when(trade, "binance_spot").otherwise("chainlink_rtds"),
            "stream": F.when(trade, "binance_agg_trade").otherwise("chainlink_price"),
            "instrument": F.lit("x"),
            "received_wall_timestamp_ns": F.col("ns"),
            "received_monotonic_ns": F.col("ns"),
            "p_trade": F.when(
                trade,
                F.struct(
                    F.lit("BTCUSDT").alias("symbol"), F.col("seq").alias("aggregate_trade_id"), "price",
                    (F.col("k") + 1).cast("decimal(18,8)").alias("quantity"),
                    F.lit(1).cast("bigint").alias("first_trade_id"), F.lit(1).cast("bigint").alias("last_trade_id"),
                    F.col("ns").alias("trade_timestamp_ns"),
                    F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("taker_side"),
                ),
            ),
            "p_oracle": F.when(
                ~trade, F.struct(F.lit("btc/usd").alias("symbol"), F.col("price").cast("decimal(38,18)").alias("price"))
            ),
        }
    )
    return ev.select(*rows)


@query(
    "s1_s3_event_archive",
    f"""with {EV}, e as (select *, make_timestamp((1700006400000000000 + (ns - 1704067200000000000) // 24) // 1000) as w from ev)
    select cast(cast(w as date) as varchar) as date, lpad(hour(w)::varchar, 2, '0') as hour,
      case when event_type in ('purchase', 'click') then 'binance_agg_trade' else 'chainlink_price' end as stream,
      count(*) as events, round(cast(sum(price) as double), 4) as total from e
    where hour(w) in (0, 7, 23) group by all""",
)
def s1_s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the partitioned archive, read back some hours by partition."""
    path = shared_dir(spark, "events")
    archive.write_events(_simple_events(A.events(spark, sf_dir)), path)
    back = archive.read_events(spark, path, hours=["00", "07", "23"])
    price = F.coalesce("p_trade.price", F.col("p_oracle.price").cast("decimal(18,8)"))
    return back.groupBy("date", "hour", "stream").agg(
        F.count("*").alias("events"), num(F.sum(price), 4).alias("total")
    )


@query(
    "s2_read_frames",
    f"""with {EV} select seq as arrival_no, '{{"v":"' || cast(price as decimal(18,2)) || '"}}' as raw from ev""",
)
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed frames read back and numbered; frames of one time keep the order of their landing."""
    path = shared_dir(spark, "frames")
    raw = F.format_string('{"v":"%s"}', A.value_text())
    hour = F.expr("received_wall_ns - pmod(received_wall_ns, 3600000000000)")
    frames = A.frames(A.events(spark, sf_dir), "x", raw).withColumns({"received_wall_ns": hour, "received_monotonic_ns": hour})
    frames.repartitionByRange(4, ARRIVAL).sortWithinPartitions(ARRIVAL).drop(ARRIVAL).write.parquet(path)
    return number_frames(read_frames(spark, path)).select(ARRIVAL, "raw")


def _kept_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested snapshots of the derived archive, which is deleted after them."""
    events = archive_events(spark, sf_dir)
    rows = kept_snapshots(events)
    release(events)
    return rows


@query("s4_s5_snapshot_files", FILES_SQL)
def s4_s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot files written and read back, with every column."""
    path = shared_dir(spark, "snapshots")
    rows = _kept_snapshots(spark, sf_dir)
    archive.write_snapshots(rows, path, flat=flatten_snapshots)
    release(rows)
    return file_rows(archive.read_snapshots(spark, path))


@query(
    "q7_snapshot_schema_issues",
    """select 'missing_column:market_5m_up_asks' as issue, 3 as files, count(*) filter (l_linenumber = 5) as rows from lineitem
    union all select 'no_rows', 1, 0 from region where r_regionkey = 0""",
)
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files without a column, three good ones and one without rows."""
    snapshots = _kept_snapshots(spark, sf_dir)
    path = shared_dir(spark, "snapshots")
    # all tasks make the text, one a file copies it; nothing of it is shuffled
    rows = kept_rows(flatten_snapshots(snapshots))
    release(snapshots)

    def write_three(df: DataFrame, place: str) -> None:
        for i in range(3):
            third = df.where(F.col("snapshot_sequence") % 3 == i).coalesce(1)
            third.write.mode("append").option("compression", "zstd").parquet(place)

    write_three(rows, f"{path}/good")
    release(rows)
    rows = spark.read.schema(rows.schema).parquet(f"{path}/good")
    write_three(rows.drop("market_5m_up_asks"), f"{path}/short")
    rows.limit(0).coalesce(1).write.parquet(f"{path}/empty")
    issues = audit.snapshot_schema_issues(spark, path)
    return issues.groupBy("issue").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


@query(
    "q9_nested",
    WITH_ARCHIVE + """ select seq as snapshot_sequence, array_to_string(list_filter([
        case when seq % 97 = 0 and up_bids_5 <> '' then 'market_5m.up.bids' end,
        case when seq % 194 = 0 then 'binance.taker_side' end], lambda x: x is not null), ',') as differences
    from why where seq % 97 = 0 and up_bids_5 <> '' or seq % 194 = 0""",
)
def q9_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields changed in a few snapshots, found range by range."""
    a = _kept_snapshots(spark, sf_dir).drop(SEQ)
    n = F.col("snapshot_sequence")
    up = F.col("market_5m.up")
    none = F.array().cast(a.schema["market_5m"].dataType["up"].dataType["bids"].dataType)
    b = a.withColumns({
        "market_5m": F.when((n % 97 == 0) & up.isNotNull(), F.col("market_5m").withField("up.bids", none)).otherwise(F.col("market_5m")),
        "binance": F.when(n % 194 == 0, F.col("binance").withField("taker_side", F.lit("?"))).otherwise(F.col("binance")),
    })
    out = audit.diff_nested(a, b, range_rows=50)
    return out.select("snapshot_sequence", F.array_join("differences", ",").alias("differences"))


@query(
    "q4_q6_s6_segments",
    f"""with {EV}, e as (select *, make_timestamp((1700006400000000000 + (ns - 1704067200000000000) // 24) // 1000) as w from ev)
    select cast(cast(w as date) as varchar) as date, hour(w)::bigint as hour,
      case when event_type in ('purchase', 'click') then 'binance_agg_trade' else 'chainlink_price' end as stream,
      count(*) as events, min(seq) as first_sequence, max(seq) as last_sequence,
      case hour(w) when 3 then 'hash_mismatch' when 5 then 'file_missing' end as mismatch
    from e group by all""",
)
def q4_q6_s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line archive gets a manifest for each file (Q6), which is read back (S6) and verified
    (Q4); the manifests of one hour then have a wrong hash, those of another no file."""
    path = shared_dir(spark, "archive")
    archive.write_event_lines(_simple_events(A.events(spark, sf_dir)), path)
    archive.write_manifests(spark, path)
    hour = F.regexp_extract("directory", "hour=([^/]+)", 1).cast("bigint")
    segments = archive.read_segments(spark, path).withColumns(
        {
            "hour": hour,
            "date": F.regexp_extract("directory", "date=([^/]+)", 1),
            "sha256": F.when(hour == 3, F.reverse("sha256")).otherwise(F.col("sha256")),
            "file_path": F.when(hour == 5, F.concat("file_path", F.lit("x"))).otherwise(F.col("file_path")),
        }
    )
    bad = audit.hash_mismatches(audit.read_files(spark, path, archive.LINE_FILES), segments)
    return segments.join(
        bad.select("sha256", "mismatch").distinct(), "sha256", "left"
    ).groupBy("date", "hour", "stream").agg(
        F.sum("event_count").alias("events"),
        F.min("first_ingest_sequence").alias("first_sequence"),
        F.max("last_ingest_sequence").alias("last_sequence"),
        F.max("mismatch").alias("mismatch"),
    )


@query(
    "s8_market_payloads",
    """select o_orderstatus <> 'P' as found, count(*) as payloads from orders group by 1""",
)
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "payloads")
    _market_payloads(spark, sf_dir).drop("o_orderkey").write.parquet(path)
    back = read_market_payloads(spark, path)
    return back.groupBy(F.col("body").isNotNull().alias("found")).agg(F.count("*").alias("payloads"))


@query(
    "q10_replay",
    WITH_ARCHIVE + """ select count(*) + any_value(c.n) as events_processed, count(*) filter (ar.n = 5) as ticks_processed,
      count(*) filter (ar.n = 5) as snapshots_produced, 1::bigint as first_ingest_sequence,
      count(*) + any_value(c.n) as last_ingest_sequence, 'valid' as integrity_status from ar cross join controls c""",
)
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive written, verified, replayed to snapshot files, summarised."""
    full = _full_events(spark, sf_dir)
    path, out = shared_dir(spark, "events"), shared_dir(spark, "replayed")
    archive.write_events(full, path)
    release(full)
    archive.write_manifests(spark, path, fmt="parquet")
    summary = replay(spark, path, out)
    return summary.drop("first_snapshot_sequence", "last_snapshot_sequence")


def _widen(df: DataFrame, name: str, ddl_type: str):
    """A struct with the missing fields of the full payload as nulls."""
    from tickstate.functions.typed_json import type_of

    have = df.schema[name].dataType.fieldNames()
    fields = [
        (F.col(f"{name}.{f.name}") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in type_of(ddl_type).fields
    ]
    return F.when(F.col(name).isNotNull(), F.struct(*fields))


def _full_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived archive with every event column."""
    events = archive_events(spark, sf_dir)
    full = events.select(
        *[
            _widen(events, c, t).alias(c)
            if c.startswith("p_") and c in events.columns
            else (F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c)
            for c, t in EVENT_COLUMNS.items()
        ]
    )
    return holding(full, events)


# ---- ST: streams ------------------------------------------------------------

SOURCE_FILES = 2


def _source_stream(
    spark: SparkSession, df: DataFrame, order: str, batches: int = 4, closing: DataFrame | None = None, without: tuple = ()
) -> DataFrame:
    """A file stream over ``df``: micro-batches of equally many files by ``order``, then ``closing``.

    A batch has ``SOURCE_FILES`` files, or one for each core where there are more, since a file is one task.
    """
    path = shared_dir(spark, "stream")
    files = max(SOURCE_FILES, spark.sparkContext.defaultParallelism)
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) // batches + 1
    plain = df.drop(*without)
    for i in range(batches):  # one after another: batches go by file time
        piece = df.where(F.expr(f"(`{order}` - {low or 0}) div {step} = {i}")).drop(*without)
        piece.repartition(files).write.mode("append").parquet(path)
    if closing is not None:
        closing.select(*plain.columns).write.mode("append").parquet(path)
    return spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", files).parquet(path)


def _closing(df: DataFrame, ns: str, after_s: int) -> DataFrame:
    """The newest row once more, so much later that all windows before it end."""
    last = df.orderBy(F.desc(ns)).limit(1)
    return last.withColumn(ns, F.col(ns) + after_s * 1_000_000_000)


def _run(query_df: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input and read its table back."""
    out, state = shared_dir(spark, "out"), shared_dir(spark, "checkpoint")
    (
        query_df.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return spark.read.schema(query_df.schema).parquet(out)


@query(
    "st1_stream_normalise",
    f"""with {EV}, f as (
      select *, ns // 1000000 - case when k >= 90 then 1200000 else 0 end as ms,
        case when k = 0 or price = 0 then 'price_not_positive' end as bad from ev),
    m as (select *, max(case when bad is null then ms end) over (order by seq rows between unbounded preceding and 1 preceding) as highest from f),
    r as (select *, coalesce(case when ms < highest then 'out_of_order' end, bad) as r0 from m),
    d as (select *, case when r0 is null and row_number() over (partition by r0, ms order by seq) > 1 then 'duplicate' else r0 end as r1 from r)
    select seq as arrival_no, coalesce(r1, 'ok') as reason,
      case when r1 is null then row_number() over (partition by r1 is null order by seq) end as ingest_sequence from d""",
)
def st1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches; order, duplicates and sequence run on from one to the next."""
    ev = A.events(spark, sf_dir)
    ms = F.expr("ns div 1000000") - F.when(F.col("k") >= 90, 1_200_000).otherwise(0)
    raw = F.format_string(
        '{"topic":"crypto_prices_chainlink","type":"update","timestamp":%d,"payload":{"symbol":"btc/usd","timestamp":%d,"value":"%s"}}',
        ms, ms, F.when(F.col("k") == 0, "0").otherwise(A.value_text()),
    )
    frames = _source_stream(spark, A.frames(ev, "chainlink_rtds", raw), ARRIVAL, without=(ARRIVAL,))
    events_dir, rejects_dir = shared_dir(spark, "events"), shared_dir(spark, "rejects")
    streams.stream_normalise(
        frames, events_dir, rejects_dir, shared_dir(spark, "checkpoint")
    ).awaitTermination()
    good = spark.read.parquet(events_dir).select(ARRIVAL, F.lit("ok").alias("reason"), SEQ)
    bad = spark.read.parquet(rejects_dir).select(ARRIVAL, F.col("reject_reason").alias("reason"))
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    "st2_stream_dedup",
    f"""with {EV} select distinct user_id || ':' || event_type as event_id from ev""",
)
def st2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir).select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("event_id"),
        F.col("ns").alias("received_wall_timestamp_ns"),
    )
    stream = streams.stream_dedup(_source_stream(spark, ev, "received_wall_timestamp_ns"), "40 days")
    return _run(stream.select("event_id"), spark)


@query("st2_stream_dedup_horizon", HORIZON_SQL)
def st2_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon by count kept in state over four batches."""
    stream = _source_stream(spark, horizon_rows(spark, sf_dir), ARRIVAL)
    out = _run(stateful.stream_dedup_horizon(stream, "id", ("event_type",), 40), spark)
    return out.where("accepted").select(ARRIVAL, "id")


@query(
    "st3_stream_keep_increasing",
    f"""with {EV}, m as (select *, seq - 4 * k as id, max(seq - 4 * k) over (
      partition by event_type order by seq rows between unbounded preceding and 1 preceding) as highest from ev)
    select seq as arrival_no, coalesce(id > greatest(highest, 0), id > 0) as accepted from m""",
)
def st3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = A.events(spark, sf_dir).select(
        F.col("seq").alias(ARRIVAL), F.col("event_type").alias("stream"),
        F.lit("s").alias("session_id"), (F.col("seq") - 4 * F.col("k")).alias("id"),
    )
    source = _source_stream(spark, ev, ARRIVAL)
    out = stateful.stream_keep_increasing(source.where("id > 0"), "id")
    low = ev.where("id <= 0").select(ARRIVAL, F.lit(False).alias("accepted"))
    return _run(out.select(ARRIVAL, "accepted"), spark).unionByName(low)


@query(
    "st4_stream_rolling",
    f"""with {EV}, t as (select ns // 1000000000 as s, * from ev where event_type in ('purchase', 'click')),
      w as (select unnest(range(s // 600 * 600 + 600, s // 600 * 600 + 3601, 600)) as window_end, * from t)
    select window_end, cast(coalesce(sum(case when event_type = 'purchase' then k + 1 end), 0) as double) as buy_volume,
      cast(coalesce(sum(case when event_type = 'click' then k + 1 end), 0) as double) as sell_volume,
      cast(cast(sum(price * (k + 1)) * 100 as hugeint) * 10000 // cast(sum(k + 1) as hugeint) as double) / 1000000 as vwap
    from w group by 1""",
)
def st4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hour windows every ten minutes; a late closing trade ends the last of them."""
    trades = A.trades(A.events(spark, sf_dir))
    closing = _closing(trades, "received_wall_timestamp_ns", 2 * 3600)
    stream = streams.stream_rolling(_source_stream(spark, trades, SEQ, closing=closing), 3600, 600)
    done = _run(stream, spark)
    return done.select(
        F.unix_seconds("window_end").alias("window_end"),
        num("buy_volume").alias("buy_volume"),
        num("sell_volume").alias("sell_volume"),
        cut(F.col("vwap")).alias("vwap"),
    )


@query("st4_stream_rolling_at_ticks", rolling_sql("event_type = 'error'", False))
def st4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact windows of each tick from state, over four batches."""
    ev = A.events(spark, sf_dir)
    trades = A.trades(ev).withColumnRenamed("received_wall_timestamp_ns", "at_ns").withColumn("is_tick", F.lit(False))
    ticks = A.ticks(ev).select(SEQ, F.col("now_ns").alias("at_ns"), F.lit(True).alias("is_tick"))
    rows = _source_stream(spark, trades.unionByName(ticks, allowMissingColumns=True), SEQ)
    return rolled(_run(stateful.stream_rolling_at_ticks(rows, WINDOWS), spark))


@query("st5_stream_books", BOOKS_SQL)
def st5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book rows at every tick, from books kept in state over four batches."""
    full = _full_events(spark, sf_dir)
    out = shared_dir(spark, "books")
    _, books_query = books.stream_books(_source_stream(spark, full, SEQ), out, shared_dir(spark, "work"))
    books_query.awaitTermination()
    rows = books.at_places(spark.read.schema(ddl(books.BOOK_ROWS)).parquet(out))
    return book_columns(rows, tick_lines(full))


@query(
    "st5_stream_best_prices",
    WITH_ARCHIVE + """ select case when c < 2 then '5m-' else '15m-' end || (e.asset // 4 - 1) ||
        case when c % 2 = 0 then '-up' else '-down' end as asset_id, e.seq as event_line, cast(bid as double) as best_bid,
      cast(best_ask as double) as best_ask, f.coherent
    from e join f on f.asset = e.asset and f.seq = e.seq""",
)
def st5_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best prices and coherence after every event of an initialized book, from state."""
    full = _full_events(spark, sf_dir)
    out = shared_dir(spark, "books")
    stream = _source_stream(spark, full, SEQ)
    _, books_query = books.stream_books(stream, out, shared_dir(spark, "work"), every_event=True)
    books_query.awaitTermination()
    rows = spark.read.schema(ddl(books.BOOK_ROWS)).parquet(out).where("initialized and kind <> 'point'")
    lines = full.select(SEQ, F.expr("bigint(substr(event_id, 2))").alias("event_line"))
    return rows.join(lines, SEQ).select(
        "asset_id", "event_line", num("best_bid").alias("best_bid"), num("best_ask").alias("best_ask"), "coherent"
    )


@query("st6_stream_snapshots", SNAPSHOTS_SQL)
def st6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole snapshots from four batches, each over its own rows and the carried books."""
    full = _full_events(spark, sf_dir)
    out = shared_dir(spark, "snapshots")
    snapshots.stream_snapshots(
        _source_stream(spark, full, SEQ), out, shared_dir(spark, "state"), shared_dir(spark, "checkpoint")
    ).awaitTermination()
    rows = spark.read.parquet(out).select(snapshot_from_json(F.col("snapshot_json")).alias("s"))
    return snapshot_columns(rows.select("s.*"))


@query(
    "st7_late_rows",
    f"""with {EV}, m as (select *, seq * 100 - k * 350 as place, max(seq * 100 - k * 350) over (
      partition by event_type order by seq rows between unbounded preceding and 1 preceding) as highest from ev)
    select seq as arrival_no, case when place < highest then 'late' end as reject_reason from m""",
)
def st7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come out of order, in four batches: kept or sent to the late table."""
    ev = A.events(spark, sf_dir).select(
        F.col("seq").alias(ARRIVAL), "event_type", (F.col("seq") * 100 - F.col("k") * 350).alias("place")
    )
    kept, late = shared_dir(spark, "kept"), shared_dir(spark, "late")
    stateful.stream_split_late(
        _source_stream(spark, ev, ARRIVAL), "place", ("event_type",), kept, late, shared_dir(spark, "checkpoint")
    ).awaitTermination()
    none = F.lit(None).cast("string").alias("reject_reason")
    rows = spark.read.parquet(kept).select(ARRIVAL, none)
    return rows.unionByName(spark.read.parquet(late).select(ARRIVAL, "reject_reason"))


@query(
    "st8_stream_health_counts",
    f"""with {EV} select ns // 3600000000000 * 3600 as window_start, 'x' as source, event_type as stream, count(*) as events
    from ev group by all""",
)
def st8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts, appended once the watermark closes the hour; a late event closes the last."""
    ev = A.events(spark, sf_dir).select(
        F.lit("x").alias("source"), F.col("event_type").alias("stream"),
        F.col("ns").alias("received_wall_timestamp_ns"),
    )
    closing = _closing(ev, "received_wall_timestamp_ns", 2 * 3600)
    out = streams.stream_health_counts(
        _source_stream(spark, ev, "received_wall_timestamp_ns", closing=closing), "1 hour"
    )
    return _run(out, spark).select(
        F.unix_seconds("window_start").alias("window_start"), "source", "stream", "events"
    )
