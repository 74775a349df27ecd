"""Market windows, metadata validation and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstate.functions import calendar as C
from tickstate.functions import variants as V
from tickstate.operators.ordered import materialize
from tickstate.operators.parse_common import first_of, when
from tickstate.params import RESOLUTION_SOURCE
from tickstate.schemas import TRANSITION_LOG, WINDOW
from tickstate.sources.archive import utc_text

BOUNDARY = ["timeframe", "expected_start"]


def with_window(
    df: DataFrame, ts_col: str, timeframes: tuple[str, ...] = ("5m", "15m")
) -> DataFrame:
    """One row per timeframe with ``window_start``, ``window_end`` and ``slug``."""
    tf = F.col("timeframe")
    return (
        df.withColumn("timeframe", F.explode(F.array(*[F.lit(t) for t in timeframes])))
        .withColumn("window_start", C.window_start(F.col(ts_col), tf))
        .withColumns(
            {
                "window_end": C.plus_windows(F.col("window_start"), tf),
                "slug": C.slug(tf, F.col("window_start")),
            }
        )
    )


def _id(value: Column, field: str) -> tuple[Column, Column]:
    text = F.trim(V.scalar_at(value, f"$.{field}"))
    reason = F.when(text.isNull(), f"{field}_missing").when(text == "", f"{field}_empty")
    return text, reason


def _must(value: Column, field: str, wanted: bool, reason: str) -> Column:
    return F.when(~V.bool_at(value, f"$.{field}").eqNullSafe(F.lit(wanted)), reason)


def _must_not(value: Column, field: str, reason: str) -> Column:
    return F.when(V.bool_at(value, f"$.{field}").eqNullSafe(F.lit(True)), reason)


def _ns(at: Column) -> Column:
    return F.unix_micros(at) * 1000


def _checked_markets(payloads: DataFrame) -> DataFrame:
    """``payloads`` plus ``market`` (window struct) or ``reject_reason``, first failure first."""
    df = payloads.withColumn("v", F.try_parse_json("body"))
    v, tf, start = F.col("v"), F.col("timeframe"), F.col("expected_start")
    market_id, market_reason = _id(v, "id")
    condition_id, condition_reason = _id(v, "conditionId")

    def words(items: Column) -> Column:
        return F.transform(
            items,
            lambda e: F.when(
                F.schema_of_variant(e) == "STRING", F.trim(F.try_variant_get(e, "$", "string"))
            ),
        )

    df = df.withColumns(
        {
            "_id": market_id,
            "_condition": condition_id,
            "_start_text": V.text_at(v, "$.eventStartTime"),
            "_end_text": V.text_at(v, "$.endDate"),
            "_source": C.source_url(V.text_at(v, "$.resolutionSource")),
            "_source_text": F.trim(V.text_at(v, "$.resolutionSource")),
            "_outcome_list": C.json_list(v, "$.outcomes"),
            "_token_list": C.json_list(v, "$.clobTokenIds"),
        }
    )
    df = df.withColumns(
        {
            "_starts": C.iso_utc(F.col("_start_text")),
            "_ends": C.iso_utc(F.col("_end_text")),
            "_outcomes": F.transform(words(F.col("_outcome_list")), lambda o: F.lower(o)),
            "_tokens": words(F.col("_token_list")),
        }
    )
    outcomes, tokens = F.col("_outcomes"), F.col("_tokens")
    each_up_or_down = F.forall(outcomes, lambda o: F.coalesce(o.isin("up", "down"), F.lit(False)))
    each_token = F.forall(tokens, lambda t: F.coalesce(t != "", F.lit(False)))
    up = F.array_position(outcomes, F.lit("up")).cast("int")
    down = F.array_position(outcomes, F.lit("down")).cast("int")
    expected_slug = C.slug(tf, start)
    reason = first_of(
        F.when(v.isNull() | ~V.is_object(v), "not_object"),
        market_reason,
        condition_reason,
        F.when(~V.text_at(v, "$.slug").eqNullSafe(expected_slug), "slug_mismatch"),
        _must(v, "active", True, "not_active"),
        _must_not(v, "closed", "closed"),
        _must_not(v, "archived", "archived"),
        _must(v, "enableOrderBook", True, "order_book_disabled"),
        C.iso_reason(F.col("_start_text"), F.col("_starts"), "eventStartTime"),
        C.iso_reason(F.col("_end_text"), F.col("_ends"), "endDate"),
        when(F.col("_starts") != start, "start_mismatch"),
        when(F.col("_ends") != C.plus_windows(start, tf), "end_mismatch"),
        F.when(
            F.coalesce(F.col("_source_text"), F.lit("")) == "", "resolutionSource_missing"
        ),
        F.when(F.col("_source").isNull(), "resolutionSource_unsupported"),
        when(F.col("_source") != RESOLUTION_SOURCE, "resolutionSource_unexpected"),
        F.when(F.col("_outcome_list").isNull(), "outcomes_not_list"),
        F.when(F.col("_token_list").isNull(), "clobTokenIds_not_list"),
        F.when((F.size(outcomes) != 2) | (F.size(tokens) != 2), "not_two_entries"),
        when(~each_up_or_down, "outcome_not_up_or_down"),
        when(~each_token, "token_empty"),
        F.when((up == 0) | (down == 0), "outcomes_not_distinct"),
        F.when(F.size(F.array_distinct(tokens)) != 2, "tokens_not_distinct"),
    )
    market = F.struct(
        tf.alias("timeframe"),
        F.col("_id").alias("market_id"),
        F.col("_condition").alias("condition_id"),
        expected_slug.alias("slug"),
        _ns(F.col("_starts")).alias("start_timestamp_ns"),
        _ns(F.col("_ends")).alias("end_timestamp_ns"),
        F.get(tokens, up - 1).alias("up_token_id"),
        F.get(tokens, down - 1).alias("down_token_id"),
        F.col("_source").alias("resolution_source"),
    ).cast(WINDOW)
    df = df.withColumn("reject_reason", reason)
    df = df.withColumn("market", F.when(F.col("reject_reason").isNull(), market))
    # later filters on the reason would otherwise repeat all checks
    return materialize(df.select(*payloads.columns, "market", "reject_reason"))


def validate_markets(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(markets, rejects)`` of fetched market objects."""
    checked = _checked_markets(payloads.where("body is not null"))
    kept = [c for c in payloads.columns if c not in ("body", "error")]
    kept = [c for c in kept if c != "timeframe"]
    return (
        checked.where("reject_reason is null").select(*kept, "market.*"),
        checked.where("reject_reason is not null").drop("market"),
    )


def resolve_outcomes(
    requests: DataFrame, payloads: DataFrame, newest: tuple[str, ...] = ("fetched_at",)
) -> DataFrame:
    """``found``, ``not_found`` (with a reason for invalid objects) or ``error``.

    Of several answers for a boundary the one that is largest by ``newest`` decides
    (ties: the larger body, then error), so a request stays one row.
    """
    last = F.max(F.struct(*newest, "body", "error")).alias("_last")
    answers = payloads.groupBy(*BOUNDARY).agg(last).select(
        *BOUNDARY, "_last.body", "_last.error", F.lit(True).alias("_answered")
    )
    checked = _checked_markets(requests.join(answers, BOUNDARY, "left"))
    failed = F.col("error").isNotNull()
    absent = F.col("body").isNull()
    return checked.select(
        *requests.columns,
        F.when(failed, "error")
        .when(absent | F.col("reject_reason").isNotNull(), "not_found")
        .otherwise("found")
        .alias("outcome"),
        F.when(~failed & ~absent, F.col("market")).alias("market"),
        F.when(failed, F.col("error")).when(~absent, F.col("reject_reason")).alias("error"),
    )


def current_and_next(times: DataFrame, markets: DataFrame, ts_col: str = "at") -> DataFrame:
    """The current and next market of each timeframe at each time."""
    struct_columns = [
        "timeframe", "market_id", "condition_id", "slug", "start_timestamp_ns",
        "end_timestamp_ns", "up_token_id", "down_token_id", "resolution_source",
    ]
    keyed = markets.groupBy("timeframe", F.col("start_timestamp_ns").alias("_start")).agg(
        F.min_by(F.struct(*struct_columns), "market_id").alias("market")
    )
    rows = with_window(times, ts_col).withColumns(
        {"_now": _ns(F.col("window_start")), "_next": _ns(F.col("window_end"))}
    )
    current = keyed.select("timeframe", F.col("_start").alias("_now"), F.col("market").alias("current_market"))
    following = keyed.select("timeframe", F.col("_start").alias("_next"), F.col("market").alias("next_market"))
    return (
        rows.join(current, ["timeframe", "_now"], "left")
        .join(following, ["timeframe", "_next"], "left")
        .select(*times.columns, "timeframe", "window_start", "current_market", "next_market")
    )


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column))


def transition_results(
    attempts: DataFrame, before_s: int = 5, after_s: int = 5, slots: int = 21, tie: tuple[str, ...] = ()
) -> DataFrame:
    """One row per boundary from the attempts made around it.

    The time from ``before_s`` before to ``after_s`` after the boundary has
    ``slots`` slots; the first attempt requested in each slot counts, and the first
    of these that is found wins. Further attempts of a slot, as merged logs hold
    them, are left out, so they neither use up slots nor hide a later find. Attempts of
    one slot with the same times are told apart by the columns ``tie``, the smallest first,
    and else by their content, so the choice is never that of a shuffle.
    """
    second = 1_000_000
    start = _micros("expected_start")
    requested = _micros("requested_at")
    inside = attempts.where(
        requested.between(start - before_s * second, start + after_s * second)
    )
    width = (before_s + after_s) * second // (slots - 1)
    slot = F.call_function("div", requested - (start - before_s * second), F.lit(width))
    kept = [c for c in inside.columns if c not in BOUNDARY]
    content = [c for c in ("outcome", "market", "error") if c in kept]
    first = (
        inside.groupBy(*BOUNDARY, slot.alias("_slot"))
        .agg(F.min_by(F.struct(*kept), F.struct("requested_at", "resolved_at", *tie, *content)).alias("_a"))
        .select(*BOUNDARY, "_a.*")
    )
    # at most ``slots`` rows a boundary
    by_time = Window.partitionBy(*BOUNDARY).orderBy("requested_at", "resolved_at")
    ranked = first.withColumn("_no", F.row_number().over(by_time))
    found = F.col("outcome") == "found"
    first_found = F.min(F.when(found, F.col("_no")))
    text = F.coalesce("error", F.lit("market_not_found"))
    at = F.col("resolved_at")
    early = at < F.col("expected_start")
    groups = ranked.groupBy(*BOUNDARY).agg(
        F.min("requested_at").alias("search_started_at"),
        first_found.alias("_found_no"),
        F.min_by("market", F.when(found, F.col("_no"))).alias("_market"),
        F.min_by("resolved_at", F.when(found, F.col("_no"))).alias("_found_at"),
        F.max("_no").cast("bigint").alias("_tries"),
        F.max_by(text, "_no").alias("_error"),
        F.max("resolved_at").alias("finished_at"),
        F.count_if(early).alias("_early"),
        F.max_by(text, F.when(early, F.col("_no"))).alias("_early_error"),
    )
    success = F.col("_found_no").isNotNull()
    late_us = F.unix_micros("_found_at") - _micros("expected_start")
    results = groups.select(
        *BOUNDARY,
        success.alias("success"),
        F.col("_market").alias("new_market"),
        "search_started_at",
        F.col("_found_at").alias("resolved_at"),
        F.coalesce(F.col("_found_no").cast("bigint"), F.col("_tries")).alias("attempt_count"),
        F.when(success, F.greatest(F.lit(0), F.floor(late_us / 1000).cast("bigint")))
        .cast("bigint")
        .alias("transition_delay_ms"),
        F.when(~success, F.col("_error")).alias("last_error"),
        F.coalesce("_found_at", "finished_at").alias("finished_at"),
        F.col("_early").alias("attempts_before_start"),
        F.col("_early_error").alias("error_before_start"),
    )
    previous = results.select(
        "timeframe",
        C.plus_windows(F.col("expected_start"), F.col("timeframe")).alias("expected_start"),
        F.col("new_market").alias("previous_market"),
    )
    return results.join(previous, BOUNDARY, "left")


def state_timeline(results: DataFrame) -> DataFrame:
    """The states a boundary goes through, with ``valid_from`` and ``valid_to``."""
    start = F.col("expected_start")
    previous, market = F.col("previous_market"), F.col("new_market")
    previous_end = F.timestamp_micros(F.expr("previous_market.end_timestamp_ns div 1000"))
    none = F.lit(None).cast(WINDOW)
    no_text = F.lit(None).cast("string")

    def live(at: Column) -> Column:
        return F.when(at < previous_end, previous)

    def entry(order, state, at, current, following, count, error) -> Column:
        return F.struct(
            F.lit(order).alias("step"),
            F.lit(state).alias("state"),
            at.alias("valid_from"),
            current.alias("current_market"),
            following.alias("next_market"),
            count.cast("bigint").alias("attempt_count"),
            error.alias("last_error"),
        )

    resolved = F.col("resolved_at")
    early = F.col("success") & (resolved < start)
    hides = previous.isNotNull() & (F.col("search_started_at") < start) & ~early
    steps = F.array_compact(
        F.array(
            entry(1, "searching_next", F.col("search_started_at"), live(F.col("search_started_at")),
                  none, F.lit(0), no_text),
            F.when(hides, entry(2, "searching_next", start, none, none,
                                F.col("attempts_before_start"), F.col("error_before_start"))),
            F.when(early, entry(3, "next_ready", resolved, live(resolved), market,
                                F.col("attempt_count"), no_text)),
            F.when(F.col("success"), entry(4, "active", F.greatest(start, resolved), market, none,
                                           F.col("attempt_count"), no_text)),
            F.when(~F.col("success"), entry(5, "transition_failed", F.col("finished_at"), none, none,
                                            F.col("attempt_count"), F.col("last_error"))),
        )
    )
    after = results.select(
        "timeframe",
        C.plus_windows(start, F.col("timeframe"), -1).alias("expected_start"),
        F.col("search_started_at").alias("_next_search"),
    )
    rows = (
        results.withColumn("_steps", steps)
        .join(after, BOUNDARY, "left")
        .select(*BOUNDARY, "_steps", "_next_search", F.posexplode("_steps").alias("_no", "_step"))
    )
    valid_to = F.coalesce(F.get("_steps", F.col("_no") + 1)["valid_from"], F.col("_next_search"))
    return rows.select(*BOUNDARY, "_step.*", valid_to.alias("valid_to"))


def startup_results(
    attempts: DataFrame, max_attempts: int = 3, keys: tuple[str, ...] = ("timeframe",)
) -> DataFrame:
    """The first of ``max_attempts`` attempts whose market has not ended yet.

    A start makes at most that many attempts, so the window needs only the first
    ones of each key and Spark keeps no more per task before it shuffles.
    ``attempt_count`` is the number of attempts seen.
    """
    by_time = Window.partitionBy(*keys).orderBy("requested_at", "resolved_at")
    ranked = attempts.withColumn("_no", F.row_number().over(by_time)).where(
        F.col("_no") <= max_attempts
    )
    found = F.col("outcome") == "found"
    alive = found & (F.col("market.end_timestamp_ns") > _ns(F.col("resolved_at")))
    text = F.when(found, "market_expired_during_startup").otherwise(
        F.coalesce("error", F.lit("market_not_found"))
    )
    groups = ranked.groupBy(*keys).agg(
        F.min(F.when(alive, F.col("_no"))).alias("_alive_no"),
        F.min_by("market", F.when(alive, F.col("_no"))).alias("current_market"),
        F.min_by("resolved_at", F.when(alive, F.col("_no"))).alias("_alive_at"),
        F.max("resolved_at").alias("_last_at"),
        F.max_by(text, "_no").alias("_error"),
        F.max("_no").alias("_seen"),
    )
    ok = F.col("_alive_no").isNotNull()
    tf = F.col("timeframe")
    ends = F.timestamp_micros(F.expr("current_market.end_timestamp_ns div 1000"))
    later = C.plus_windows(C.window_start(F.col("_last_at"), tf), tf)
    return groups.select(
        *keys,
        F.when(ok, "active").otherwise("transition_failed").alias("state"),
        "current_market",
        F.when(ok, ends).otherwise(later).alias("expected_transition"),
        F.coalesce("_alive_at", "_last_at").alias("updated_at"),
        F.coalesce("_alive_no", "_seen").cast("bigint").alias("attempt_count"),
        F.when(~ok, F.col("_error")).alias("last_error"),
    )


def transition_rows(results: DataFrame) -> DataFrame:
    """The fixed columns of the transition log."""
    values = {
        "event_type": F.lit("market_transition"),
        "timeframe": F.col("timeframe"),
        "status": F.when(F.col("success"), "success").otherwise("failed"),
        "expected_start_utc": utc_text(F.col("expected_start")),
        "search_started_at_utc": utc_text(F.col("search_started_at")),
        "resolved_at_utc": utc_text(F.col("resolved_at")),
        "attempt_count": F.col("attempt_count"),
        "transition_delay_ms": F.col("transition_delay_ms"),
        "previous_market_id": F.col("previous_market.market_id"),
        "new_market_id": F.col("new_market.market_id"),
        "condition_id": F.col("new_market.condition_id"),
        "up_token_id": F.col("new_market.up_token_id"),
        "down_token_id": F.col("new_market.down_token_id"),
        "last_error": F.col("last_error"),
    }
    return results.select(*[values[n].cast(k).alias(n) for n, k in TRANSITION_LOG.items()])


def invariant_violations(df: DataFrame) -> DataFrame:
    """Rows of ``transition_results`` or ``resolve_outcomes`` that contradict themselves."""
    if "success" in df.columns:
        ok, new = F.col("success"), F.col("new_market").isNotNull()
        at, delay = F.col("resolved_at").isNotNull(), F.col("transition_delay_ms")
        error = F.coalesce(F.col("last_error"), F.lit("")) != ""
        violation = (
            F.when(F.col("attempt_count") < 0, "negative_attempts")
            .when(ok & (~new | ~at), "success_without_market")
            .when(ok & (delay.isNull() | (delay < 0)), "success_without_delay")
            .when(ok & F.col("last_error").isNotNull(), "success_with_error")
            .when(~ok & (new | at | delay.isNotNull()), "failure_with_market")
            .when(~ok & ~error, "failure_without_error")
        )
    else:
        outcome, market = F.col("outcome"), F.col("market").isNotNull()
        error = F.col("error")
        violation = (
            F.when((outcome == "found") & (~market | error.isNotNull()), "found_without_market")
            .when((outcome == "not_found") & market, "not_found_with_market")
            .when(
                (outcome == "error") & (market | (F.coalesce(error, F.lit("")) == "")),
                "error_without_text",
            )
        )
    return df.withColumn("violation", violation).where("violation is not null")
