"""Behaviour features of each client (ip, session, user agent) over sliding windows (start, end].

Events are first reduced to mergeable sums of panes one slide long, from which windows follow by running
sums.  The partial sums of different batches add up, so the same two steps serve
batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import bot_score
from ..functions.sliding import sliding, spans
from ..functions.times import aligned, is_night, seconds_after
from ..settings import Settings

KEYS = ["ip", "session_id", "user_agent"]
_STATUS = {f"http_response_{k}xx": (k * 100, k * 100 + 100) for k in (2, 3, 4, 5)}
_METHODS = {"get_method": "GET", "post_method": "POST", "head_method": "HEAD"}
_SUMS = ["n", "latency", *_STATUS, *_METHODS, "other_method", "nights"]


def _count(cond: Column, name: str) -> Column:
    return F.sum(cond.cast("long")).alias(name)


def _event_sums() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.sum(F.col("latency_ms").cast("long")).alias("latency"),
        *(_count((F.col("status") >= lo) & (F.col("status") < hi), c) for c, (lo, hi) in _STATUS.items()),
        *(_count(F.col("method") == m, c) for c, m in _METHODS.items()),
        _count(~F.col("method").isin(*_METHODS.values()), "other_method"),
        _count(is_night(F.col("event_time")), "nights"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
    ]


def _merged(*more: Column) -> list[Column]:
    return [*(F.sum(c).alias(c) for c in _SUMS), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *more]


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows shuffled by keys into as many partitions as the session shuffles into, not fewer: windows have
    several rows for each of these, so that small partitions must not be put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _timed(events: DataFrame, slide: int) -> DataFrame:
    timed = events.where("event_time is not null")
    return timed.withColumns({"second": F.date_trunc("SECOND", "event_time"), "pane": aligned(F.col("event_time"), slide)})


def _sums(timed: DataFrame, *more: str) -> DataFrame:
    return timed.groupBy(*KEYS, *more, "pane", "route_template", "second").agg(*_event_sums())


def bot_partials(events: DataFrame, slide: int) -> DataFrame:
    """Sums by client, pane, route and second; those of several batches may be put together.

    Events are shuffled before they are summed up: few are of one client, route and second, so that sums
    made where events are read would hold nearly all of them."""
    return _sums(_dealt(_timed(events, slide), *KEYS, "pane"))


def _ratio(c: str, name: str | None = None) -> Column:
    """Share of the events; none and all, as most shares are, need no rounding, which is by decimals and slow."""
    return F.when(F.col(c) == 0, F.lit(0.0)).when(F.col(c) == F.col("n"), F.lit(1.0)).otherwise(F.bround(F.col(c) / F.col("n"), 4)).alias(name or c)


def _features(by_key: DataFrame, keys: list[str]) -> DataFrame:
    lasted = F.unix_micros("last_seen") - F.unix_micros("first_seen")
    return by_key.select(
        *keys,
        F.col("n").alias("number_of_requests"),
        F.when(lasted % 1_000_000 == 0, lasted / 1e6).otherwise(F.bround(lasted / 1e6, 3)).alias("total_duration_s"),
        F.when(F.col("latency") % F.col("n") == 0, F.col("latency") / F.col("n")).otherwise(F.bround(F.col("latency") / F.col("n"), 3)).alias("average_time_ms"),
        _ratio("top_route", "repeated_requests"),
        *map(_ratio, [*_STATUS, *_METHODS, "other_method"]),
        (2 * F.col("nights") >= F.col("n")).cast("int").alias("night"),
        F.col("top_second").alias("max_barrage"),
    )


def bot_windows(partials: DataFrame, window: int, slide: int) -> DataFrame:
    """Features of every window that has an event, from the sums of ``bot_partials``.

    One shuffle, by client and span of time; all else is done where the rows then are.
    """
    return _windows(_dealt(spans(partials, window, slide), *KEYS, "span"), window, slide)


def _windows(dealt: DataFrame, window: int, slide: int, at_events: bool = False) -> DataFrame:
    """The same of sums that are dealt by client and span."""
    each = [*KEYS, "span", "pane"]
    in_second = dealt.withColumn("top_second", F.sum("n").over(W.partitionBy(*each, "second")))
    routes = in_second.groupBy(*each, "route_template").agg(*_merged(F.max("top_second").alias("top_second")))
    by_route = sliding(routes, [*KEYS, "route_template"], window, slide, _SUMS, ["last_seen", "top_second"], ["first_seen"])
    by_key = by_route.groupBy(*KEYS, "span", "window_end").agg(*_merged(F.max("n").alias("top_route"), F.max("top_second").alias("top_second")))
    if at_events:
        by_key = by_key.where(F.col("last_seen") > seconds_after(F.col("window_end"), -slide))
    return _features(by_key, [*KEYS, "window_end"]).withColumn("window_start", seconds_after(F.col("window_end"), -window))


def bot_features(events: DataFrame, s: Settings = Settings(), at_events: bool = False) -> DataFrame:
    """All windows, or with ``at_events`` those that end at the grid point of an event of their client, which
    ``enrich`` joins. Times count in whole seconds (see ``whole_seconds``). One shuffle, of the events."""
    dealt = _dealt(spans(_timed(events, s.bot_slide), s.bot_window, s.bot_slide), *KEYS, "span")
    return _windows(_sums(dealt, "span"), s.bot_window, s.bot_slide, at_events)


def _one_window(scoped: DataFrame, end: Column, window: int) -> DataFrame:
    by_route = scoped.groupBy(*KEYS, "route_template", F.date_trunc("SECOND", "event_time").alias("second")).agg(*_event_sums())
    routes = by_route.groupBy(*KEYS, "route_template").agg(*_merged()).groupBy(*KEYS).agg(*_merged(F.max("n").alias("top_route")))
    seconds = by_route.groupBy(*KEYS, "second").agg(F.sum("n").alias("n")).groupBy(*KEYS).agg(F.max("n").alias("top_second"))
    return _features(routes.join(seconds, KEYS), KEYS).withColumn("window_end", end).withColumn("window_start", seconds_after(end, -window))


def bot_latest(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The one window that ends at the grid point of the latest event; parts of a second count."""
    end = events.agg(aligned(F.max("event_time"), s.bot_slide)).scalar()
    scoped = events.where((F.col("event_time") > seconds_after(end, -s.bot_window)) & (F.col("event_time") <= end))
    return _one_window(scoped, end, s.bot_window)


def bot_as_run(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The variant that takes counts, ratios, duration and any night over all given events, and only
    the top route and the barrage from the latest window; clients outside that window are absent."""
    end = events.agg(aligned(F.max("event_time"), s.bot_slide)).scalar()
    scoped = events.where((F.col("event_time") > seconds_after(end, -s.bot_window)) & (F.col("event_time") <= end))
    routes = scoped.groupBy(*KEYS, "route_template").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.max("n").alias("top_route"))
    seconds = scoped.groupBy(*KEYS, F.date_trunc("SECOND", "event_time").alias("second")).agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.max("n").alias("top_second"))
    every = events.groupBy(*KEYS).agg(*_event_sums())
    found = _features(every.withColumn("nights_", F.col("nights")).join(routes, KEYS).join(seconds, KEYS).withColumn("nights", F.when(F.col("nights_") > 0, F.col("n")).otherwise(F.lit(0))), KEYS)
    return found.withColumn("window_end", end).withColumn("window_start", seconds_after(end, -s.bot_window))


def score_bot(features: DataFrame, s: Settings = Settings()) -> DataFrame:
    scored = features.withColumn("bot_score", bot_score(s))
    return scored.withColumn("is_bot", (F.col("bot_score") >= s.bot_threshold).cast("int")).withColumn("model_version", F.lit(s.label("bot")))
