"""Order-book frames: explode, registry join, message parsers, resolutions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstate.functions import variants as V
from tickstate.functions.decimals import decimal_reason, to_decimal
from tickstate.operators.ordered import kept_rows
from tickstate.operators.ordering import ARRIVAL, content_id, in_ns
from tickstate.operators.parse_common import (
    event_columns,
    first_of,
    frame_envelope,
    json_reason,
    when,
)
from tickstate.schemas import LEVELS, PAYLOADS

STREAM_OF = {
    "book": "clob_book",
    "price_change": "clob_price_change",
    "best_bid_ask": "clob_best_bid_ask",
    "last_trade_price": "clob_last_trade",
    "tick_size_change": "clob_tick_size_change",
    "market_resolved": "clob_market_resolved",
}
REGISTRY_COLUMNS = ("timeframe", "market_id", "condition_id", "outcome")
RESOLUTION = {
    "affected": "array<string>",
    "_resolution_reason": "string",
    "winning_asset_id": "string",
    "winning_outcome": "string",
    "market": "string",
    "condition": "string",
}
MESSAGE_REJECTS = (
    "source", "session_id", ARRIVAL, "received_wall_ns", "raw", "position", "reject_reason"
)


def _each(exploded: DataFrame, place: str) -> DataFrame:
    """Rows of an outer explode without those of empty lists, as an inner one gives them.

    For an inner explode Spark adds a filter that computes the whole list once more.
    """
    return exploded.where(F.col(place).isNotNull())


def explode_frames(frames: DataFrame) -> DataFrame:
    """One row per message; a frame is one message or a list of them."""
    # a frame is parsed once, and only a list can be read as one: its whole schema is not described
    v = F.col("_v")
    messages = F.coalesce(V.get(v, "$", "array<variant>"), F.array(v))
    rows = frames.select("*", F.try_parse_json("raw").alias("_v"))
    rows = _each(rows.select(*frames.columns, F.posexplode_outer(messages).alias("position", "message")), "position")
    m = F.col("message")
    sent = V.get(m, "$.timestamp", "string").try_cast("bigint")
    return rows.withColumns(
        {
            "event_type": V.text_at(m, "$.event_type"),
            "source_timestamp_ns": in_ns(sent, 1_000_000),
            "_shape": first_of(
                json_reason(F.col("raw"), m),
                when(~V.is_object(m, "$", "event_type"), "not_object"),
                F.when((sent > 0) & in_ns(sent, 1_000_000).isNull(), "timestamp_out_of_range"),
            ),
        }
    )


def asset_registry(market_state: DataFrame, grace_s: int = 10) -> DataFrame:
    """P14 table: when each asset is known, with ``grace_s`` after it stops being wanted.

    ``market_state`` has ``ingest_sequence, received_wall_timestamp_ns, p_market``.
    Presence is a gap-and-island problem over the state rows of one timeframe.
    """
    states = market_state.select(
        F.col("p_market.timeframe").alias("timeframe"),
        "ingest_sequence",
        F.col("received_wall_timestamp_ns").alias("_at"),
        F.array_compact(F.array("p_market.current_market", "p_market.next_market")).alias("_wanted"),
    )
    by_time = Window.partitionBy("timeframe").orderBy("ingest_sequence")
    states = states.withColumns(
        {"_no": F.row_number().over(by_time), "_until": F.lead("_at").over(by_time)}
    )
    window = F.col("window")
    assets = (
        states.select("timeframe", "_no", "_at", "_until", F.explode("_wanted").alias("window"))
        .select(
            "timeframe",
            "_no",
            "_at",
            "_until",
            window["market_id"].alias("market_id"),
            window["condition_id"].alias("condition_id"),
            F.explode(
                F.array(
                    F.struct(window["up_token_id"].alias("asset_id"), F.lit("up").alias("outcome")),
                    F.struct(
                        window["down_token_id"].alias("asset_id"), F.lit("down").alias("outcome")
                    ),
                )
            ).alias("asset"),
        )
        .select("timeframe", "_no", "_at", "_until", "market_id", "condition_id", "asset.*")
        .dropDuplicates(["timeframe", "asset_id", "_no"])
    )
    grace = F.lit(grace_s * 1_000_000_000)
    of_asset = Window.partitionBy("timeframe", "asset_id").orderBy("_no")
    left_at = F.coalesce(F.col("_until") + grace, F.lit((1 << 63) - 1))
    new_island = F.coalesce(
        (F.col("_no") != F.lag("_no").over(of_asset) + 1)
        & (F.col("_at") >= F.lag(left_at).over(of_asset)),
        F.lit(True),
    )
    return (
        assets.withColumn("_new", new_island.cast("int"))
        .withColumn("_island", F.sum("_new").over(of_asset))
        .groupBy("timeframe", "asset_id", "_island")
        .agg(
            *[F.max_by(c, "_no").alias(c) for c in ("market_id", "condition_id", "outcome")],
            F.min("_at").alias("known_from_ns"),
            F.max(left_at).alias("known_to_ns"),
        )
        .select("asset_id", *REGISTRY_COLUMNS, "known_from_ns", "known_to_ns")
    )


def _at_time(rows: DataFrame, registry: DataFrame, left: str, right: str, how: str) -> DataFrame:
    """Equi-join on an id with the registry interval as residual condition."""
    r = registry.select(*[F.col(c).alias(f"r_{c}") for c in registry.columns])
    within = (F.col("received_wall_ns") >= F.col("r_known_from_ns")) & (
        F.col("received_wall_ns") < F.col("r_known_to_ns")
    )
    return rows.join(r, (F.col(left) == F.col(f"r_{right}")) & within, how)


def join_assets(
    messages: DataFrame, registry: DataFrame, asset: str = "asset_id"
) -> tuple[DataFrame, DataFrame]:
    """Messages of known assets with their registry columns, and the unknown ones."""
    joined = _at_time(messages, registry, asset, "asset_id", "left")
    known = F.col("r_asset_id").isNotNull()
    drop = [c for c in joined.columns if c.startswith("r_")]
    with_columns = joined.where(known).withColumns({c: F.col(f"r_{c}") for c in REGISTRY_COLUMNS})
    unknown = joined.where(~known).drop(*drop).withColumn("reject_reason", F.lit("unknown_asset"))
    return with_columns.drop(*drop), unknown


def expand_resolutions(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per asset a ``market_resolved`` message settles.

    Explicit ``assets_ids`` win; without them every known asset of the market or
    condition is settled. What messages of one market, condition and time settle is
    listed once, and the lists are joined last, so that nothing shuffles a copy a message.
    """
    m = F.col("message")
    rows = messages.where((F.col("event_type") == "market_resolved") & F.col("_shape").isNull())
    rows = rows.withColumns(
        {
            "market": V.text_at(m, "$.market"),
            "condition": V.text_at(m, "$.condition_id"),
            "winning_asset_id": V.text_at(m, "$.winning_asset_id"),
            "_winner_text": F.lower(V.text_at(m, "$.winning_outcome")),
            "_listed": V.get(m, "$.assets_ids", "array<string>"),
            "_ids_kind": V.kind_of(m, "$.assets_ids"),
        }
    )
    has_list = F.coalesce(F.col("_ids_kind") != "VOID", F.lit(False))
    bad_list = has_list & (
        ~F.col("_ids_kind").rlike("^ARRAY<(STRING|VOID)>$")
        | F.coalesce(F.exists("_listed", lambda a: F.coalesce(a == "", F.lit(True))), F.lit(False))
    )
    rows = rows.withColumns({"_has_list": has_list, "_bad_list": bad_list})
    key = [ARRIVAL, "position"]
    search = ["market", "condition", "received_wall_ns"]
    searched = rows.where("not _has_list").select(*search).distinct()
    by_market = [
        _at_time(searched, registry, left, right, "inner").select(
            *search, F.col("r_asset_id").alias("asset_id")
        )
        for left, right in (
            ("market", "market_id"),
            ("market", "condition_id"),
            ("condition", "condition_id"),
        )
    ]
    found = by_market[0].union(by_market[1]).union(by_market[2])
    lists = found.groupBy(*search).agg(F.array_sort(F.collect_set("asset_id")).alias("_found"))
    winner = _at_time(
        rows.where("winning_asset_id is not null").select(
            *key, "received_wall_ns", "winning_asset_id"
        ),
        registry,
        "winning_asset_id",
        "asset_id",
        "inner",
    ).groupBy(*key).agg(F.max("r_outcome").alias("_winner_outcome"))
    rows = rows.join(winner, key, "left")
    known = [F.col(f"_s_{c}").eqNullSafe(F.col(c)) for c in search]
    lists = lists.select(*[F.col(c).alias(f"_s_{c}") for c in search], "_found")
    rows = rows.join(lists, reduce(and_, known, ~F.col("_has_list")), "left")
    listed = F.when(~F.col("_bad_list") & (F.size("_listed") > 0), F.col("_listed"))
    rows = rows.withColumn("affected", F.when(F.col("_has_list"), listed).otherwise(F.col("_found")))
    return rows.withColumns(
        {
            "winning_outcome": F.when(
                F.col("_winner_text").isin("up", "down"), F.col("_winner_text")
            ).otherwise(F.col("_winner_outcome")),
            "_resolution_reason": first_of(
                F.when(F.col("_bad_list"), "invalid_assets_ids"),
                when(F.coalesce(F.size("affected"), F.lit(0)) <= 0, "unknown_resolution"),
            ),
        }
    ).drop(
        "_winner_text", "_winner_outcome", "_listed", "_ids_kind", "_has_list", "_bad_list", "_found",
        *[f"_s_{c}" for c in search],
    )


# Decimal fields and the message types that carry them.
DECIMALS = {
    "price": ("price_change", "last_trade_price"),
    "size": ("price_change", "last_trade_price"),
    "best_bid": ("price_change", "best_bid_ask"),
    "best_ask": ("price_change", "best_bid_ask"),
    "spread": ("best_bid_ask",),
    "fee_rate_bps": ("last_trade_price",),
    "old_tick_size": ("tick_size_change",),
    "new_tick_size": ("tick_size_change",),
}
OPTIONAL = {
    "best_bid": "price_change",
    "best_ask": "price_change",
    "fee_rate_bps": "last_trade_price",
}


def _with_decimals(items: DataFrame, body: str, kind: Column) -> DataFrame:
    """Each decimal field once as text (``t_``), as a number (``d_``) and by presence (``has_``)."""
    b = F.col(body)
    texts = {
        f"t_{n}": F.when(kind.isin(*types), V.scalar_at(b, f"$.{n}"))
        for n, types in DECIMALS.items()
    }
    present = {
        f"has_{n}": F.when(
            kind == owner, F.coalesce(V.kind_of(b, f"$.{n}") != "VOID", F.lit(False))
        )
        for n, owner in OPTIONAL.items()
    }
    items = items.withColumns(texts | present)
    return items.withColumns({f"d_{n}": to_decimal(F.col(f"t_{n}")) for n in DECIMALS})


def _decimal_check(field: str, positive: bool = False) -> Column:
    reason = decimal_reason(F.col(f"t_{field}"), positive, value=F.col(f"d_{field}"))
    return F.concat(F.lit(f"{field}_"), reason)


def _optional_check(field: str) -> Column:
    return F.when(F.col(f"has_{field}"), _decimal_check(field))


def _book_side(m: Column, side: str) -> tuple[Column, Column]:
    """P8 (levels, reason): positive prices, no price twice, zero sizes dropped, sorted."""
    path = f"$.{side}"
    rows = V.get(m, path, "array<struct<price:string,size:string>>")
    bad_row = F.exists(
        rows,
        lambda r: F.coalesce(
            ~(to_decimal(r["price"]) > 0) | ~(to_decimal(r["size"]) >= 0),
            F.lit(True),
        ),
    )
    given = F.transform(
        rows,
        lambda r: F.struct(
            to_decimal(r["price"]).alias("price"), to_decimal(r["size"]).alias("quantity")
        ),
    )
    kept = F.filter(given, lambda r: r["quantity"] != 0)
    prices = F.transform(kept, lambda r: r["price"])
    # a zero size repeats a price only when the price was set earlier in the list
    set_prices = F.transform(given, lambda r: F.when(r["quantity"] != 0, r["price"]))
    zero_after_set = F.exists(
        F.transform(
            given,
            lambda r, i: (r["quantity"] == 0)
            & F.array_position(set_prices, r["price"]).between(1, i),
        ),
        lambda hit: F.coalesce(hit, F.lit(False)),
    )
    reason = first_of(
        when(~V.kind_of(m, path).startswith("ARRAY"), f"{side}_not_list"),
        when(rows.isNull() | bad_row, f"{side}_level"),
        F.when(
            (F.size(F.array_distinct(prices)) != F.size(prices)) | zero_after_set,
            f"{side}_duplicate",
        ),
    )
    return F.sort_array(kept, asc=side == "asks"), reason


def parse_book_messages(
    messages: DataFrame, registry: DataFrame, prefix: str = "clob", only: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """P8-P13 in one pass over exploded messages.

    A bad change rejects its whole message; a bad message also drops the later
    messages of its frame (reason ``frame_aborted``). ``only`` says that all messages
    are of that type, so that nothing of the other types is looked for.
    """
    key = [ARRIVAL, "position"]
    m = F.col("message")
    kind = F.col("event_type") if only is None else F.lit(only)
    if only in (None, "market_resolved"):
        messages = kept_rows(messages)
        resolved = expand_resolutions(messages, registry).select(*key, *RESOLUTION)
        settled = F.coalesce(F.col("event_type") == "market_resolved", F.lit(False))
        rows = messages.where(~settled).unionByName(
            messages.where(settled).join(resolved, key, "left"), allowMissingColumns=True
        )
        settled_assets = F.when(settled, F.col("affected"))
    else:
        rows = messages.select("*", *[F.lit(None).cast(t).alias(c) for c, t in RESOLUTION.items()])
        settled_assets = F.col("affected")
    changes = V.list_at(m, "$.price_changes")
    rows = rows.withColumns(
        {
            "_changes": F.when(kind == "price_change", changes),
            "_assets": F.coalesce(settled_assets, F.array(V.scalar_at(m, "$.asset_id"))),
        }
    )
    rows = rows.withColumn(
        "_items",
        F.when(
            F.size("_changes") > 0,
            F.transform(
                "_changes",
                lambda c: F.struct(
                    c.alias("body"), F.try_variant_get(c, "$.asset_id", "string").alias("asset_id")
                ),
            ),
        ).otherwise(
            F.transform("_assets", lambda a: F.struct(m.alias("body"), a.alias("asset_id")))
        ),
    )
    items = rows.select(
        *[c for c in rows.columns if c not in ("_items", "_assets", "_changes")],
        F.coalesce(F.size("_changes"), F.lit(0)).alias("_n_changes"),
        F.posexplode_outer("_items").alias("item", "_item"),
    )
    items = _each(items, "item")
    # neither a frame's text nor a message that is its own body is carried twice
    first, change = F.col("item") == 0, F.col("_n_changes") > 0
    items = items.withColumns(
        {
            "raw": F.when(first, F.col("raw")),
            "body": F.when(change, F.col("_item.body")),
            "asset_id": F.col("_item.asset_id"),
        }
    ).drop("_item")
    items = _at_time(items, registry, "asset_id", "asset_id", "left")

    carried = [c for c in items.columns if c != "_n_changes"]
    items = items.withColumn("_b", F.coalesce("body", "message"))
    b = F.col("_b")
    items = _with_decimals(items, "_b", kind).withColumns(
        {
            "_side": V.text_at(b, "$.side"),
            "_any_side": V.get(b, "$.side", "string"),
            "_side_kind": V.kind_of(b, "$.side"),
            "_own_hash": V.text_at(b, "$.hash"),
            "_hash": F.coalesce(V.text_at(b, "$.hash"), V.text_at(m, "$.hash")),
        }
    )

    bids, bids_reason = _book_side(b, "bids")
    asks, asks_reason = _book_side(b, "asks")
    is_book = kind == "book"
    items = items.withColumns(
        {
            "_bids": F.when(is_book & bids_reason.isNull(), bids),
            "_asks": F.when(is_book & asks_reason.isNull(), asks),
            "_bids_reason": F.when(is_book, bids_reason),
            "_asks_reason": F.when(is_book, asks_reason),
        }
    )
    # `>=` on an empty side is null, which means not crossed
    crossed = F.coalesce(
        F.get("_bids", 0)["price"] >= F.get("_asks", 0)["price"], F.lit(False)
    )
    known = F.col("r_asset_id").isNotNull()
    per_type = (
        F.when(
            kind == "price_change",
            first_of(
                when(~F.col("_side").isin("BUY", "SELL"), "unknown_side"),
                _decimal_check("price", True),
                _decimal_check("size"),
                _optional_check("best_bid"),
                _optional_check("best_ask"),
            ),
        )
        .when(
            is_book,
            first_of(
                F.col("_bids_reason"), F.col("_asks_reason"), F.when(crossed, F.lit("crossed"))
            ),
        )
        .when(
            kind == "best_bid_ask",
            first_of(
                *[_decimal_check(c) for c in ("best_bid", "best_ask", "spread")]
            ),
        )
        .when(
            kind == "last_trade_price",
            first_of(
                _decimal_check("price", True),
                _decimal_check("size", True),
                when(F.col("_side_kind").isNull(), "side_missing"),
                _optional_check("fee_rate_bps"),
            ),
        )
        .when(
            kind == "tick_size_change",
            first_of(
                *[_decimal_check(c, True) for c in ("old_tick_size", "new_tick_size")]
            ),
        )
        .when(kind == "market_resolved", F.lit(None).cast("string"))
        .otherwise("unknown_event_type")
    )
    item_reason = first_of(
        F.col("_shape"),
        when(F.col("source_timestamp_ns") <= 0, "invalid_timestamp"),
        F.col("_resolution_reason"),
        F.when((kind == "price_change") & (F.col("_n_changes") <= 0), "no_changes"),
        when(~known, "unknown_asset"),
        per_type,
    )
    # both results read the checked items, so they are computed once; what only the checks need goes
    decimals = [f"d_{n}" for n in DECIMALS]
    texts = ["_side", "_any_side", "_own_hash", "_hash", "_bids", "_asks"]
    items = kept_rows(items.select(*carried, *decimals, *texts, item_reason.alias("_reason")))
    # a frame is good up to its first bad message, whose first bad item tells why
    bad = items.where(F.col("_reason").isNotNull()).groupBy(ARRIVAL).agg(
        F.min(F.struct("position", "item", "_reason")).alias("_bad")
    )
    items = items.join(bad, ARRIVAL, "left")
    aborted = F.col("position") > F.col("_bad.position")
    items = items.withColumn(
        "reject_reason",
        F.when(aborted, "frame_aborted").when(
            F.col("position") == F.col("_bad.position"), F.col("_bad._reason")
        ),
    )

    b = F.col("body")
    body_text = F.when(
        kind == "price_change", F.concat_ws("|", F.to_json("message"), F.to_json(b))
    ).otherwise(F.to_json("message"))
    supplied = F.col("_hash")
    event_id = content_id(
        prefix,
        F.col("event_type"),
        F.col("asset_id"),
        F.col("source_timestamp_ns"),
        supplied,
        body_text,
    )

    def payload(name: str, event_type: str, *values: Column) -> tuple[str, Column]:
        return name, F.when(kind == event_type, F.struct(*values).cast(PAYLOADS[name]))

    def dec(name: str) -> Column:
        return F.col(f"d_{name}").alias(name)

    stream = F.element_at(
        F.create_map(*[F.lit(x) for pair in STREAM_OF.items() for x in pair]), kind
    )
    payloads = dict(
        [
            payload(
                "p_book",
                "book",
                F.col("_bids").cast(LEVELS).alias("bids"),
                F.col("_asks").cast(LEVELS).alias("asks"),
                F.col("_own_hash").alias("book_hash"),
            ),
            payload(
                "p_change",
                "price_change",
                F.col("_side").alias("side"),
                dec("price"),
                F.col("d_size").alias("quantity"),
                dec("best_bid"),
                dec("best_ask"),
                F.col("_own_hash").alias("change_hash"),
            ),
            payload("p_best", "best_bid_ask", dec("best_bid"), dec("best_ask"), dec("spread")),
            payload(
                "p_last_trade",
                "last_trade_price",
                dec("price"),
                F.col("d_size").alias("quantity"),
                F.col("_any_side").alias("side"),
                dec("fee_rate_bps"),
            ),
            payload(
                "p_tick_size", "tick_size_change", dec("old_tick_size"), dec("new_tick_size")
            ),
            payload(
                "p_resolved",
                "market_resolved",
                F.col("winning_asset_id").alias("winning_asset_id"),
                F.col("winning_outcome").alias("winning_outcome"),
                F.col("affected").alias("affected_asset_ids"),
                F.coalesce("market", "r_market_id").alias("market_id"),
                F.coalesce("condition", "r_condition_id").alias("condition_id"),
            ),
        ]
    )
    columns = event_columns(
        frame_envelope()
        | {
            "event_id": event_id,
            "source": F.lit("clob"),
            "stream": stream,
            "instrument": F.col("asset_id"),
            "source_timestamp_ns": F.col("source_timestamp_ns"),
            "source_sequence": supplied,
            "asset_id": F.col("asset_id"),
            "source_session_id": F.col("session_id"),
            "payload_raw": F.to_json("message"),
        }
        | {c: F.col(f"r_{c}") for c in REGISTRY_COLUMNS}
        | payloads
    )
    accepted = items.where(F.col("reject_reason").isNull()).select(
        ARRIVAL, "position", "item", *columns
    )
    rejected = (
        items.where(F.col("reject_reason").isNotNull() & (F.col("item") == 0))
        .select(*MESSAGE_REJECTS)
    )
    return accepted, rejected


def _of_type(event_type: str):
    def parse(
        messages: DataFrame, registry: DataFrame, prefix: str = "clob"
    ) -> tuple[DataFrame, DataFrame]:
        return parse_book_messages(
            messages.where(F.col("event_type") == event_type), registry, prefix, event_type
        )

    parse.__doc__ = f"Accepted and rejected ``{event_type}`` messages."
    return parse


parse_book = _of_type("book")
parse_price_change = _of_type("price_change")
parse_best = _of_type("best_bid_ask")
parse_last_trade = _of_type("last_trade_price")
parse_tick_size = _of_type("tick_size_change")


def parse_book_frames(
    frames: DataFrame, registry: DataFrame, prefix: str = "clob"
) -> tuple[DataFrame, DataFrame]:
    """P7 then P8-P14 for whole frames."""
    return parse_book_messages(explode_frames(frames), registry, prefix)
