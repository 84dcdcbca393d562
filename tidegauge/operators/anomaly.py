"""Latency and error features of each endpoint over sliding windows, with a trailing baseline.

Panes keep a histogram of latencies (distinct value, count), from which exact percentiles of any
window follow; windows are made by running sums for each of its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import anomaly_score, is_anomaly
from ..functions.sliding import sliding, spans
from ..functions.times import aligned, seconds_after
from ..settings import Settings


def _server_error() -> Column:
    return (F.col("status") >= 500) & (F.col("status") < 600)


def anomaly_partials(events: DataFrame, slide: int) -> DataFrame:
    """Events and 5xx errors by endpoint, pane and latency."""
    timed = events.where("event_time is not null")
    return timed.groupBy("endpoint", aligned(F.col("event_time"), slide).alias("pane"), "latency_ms").agg(F.count("*").alias("n"), F.sum(_server_error().cast("long")).alias("errors"))


def _stats() -> list[Column]:
    latency = F.col("latency_ms").cast("long")
    return [F.sum("n").alias("request_count"), F.sum(latency * F.col("n")).alias("total"), F.percentile("latency_ms", [0.95, 0.99], F.col("n")).alias("p"), F.sum("errors").alias("errors")]


def _features(joined: DataFrame, keys: list[str]) -> DataFrame:
    average = F.col("total") / F.col("request_count")
    return joined.select(
        *keys,
        "request_count",
        F.bround(average, 3).alias("avg_latency_ms"),
        F.bround(F.col("p")[0], 3).alias("p95_latency_ms"),
        F.bround(F.col("p")[1], 3).alias("p99_latency_ms"),
        F.bround(F.col("errors") / F.col("request_count"), 4).alias("status_5xx_ratio"),
        F.bround(F.coalesce(F.col("base_total") / F.col("base_n"), average), 3).alias("baseline_avg_latency_ms"),
        F.bround(F.coalesce(F.col("base_errors") / F.col("base_n"), F.lit(0.0)), 4).alias("baseline_5xx_ratio"),
    )


def anomaly_windows(partials: DataFrame, s: Settings) -> DataFrame:
    """Features of every window that has an event. The baseline is a sliding sum of its own, whose
    end is the window's start: an equi-join."""
    window, slide, lookback = s.anomaly_window, s.anomaly_slide, s.anomaly_lookback
    bins = spans(partials, window, slide).repartition("endpoint", "span")
    found = sliding(bins, ["endpoint", "latency_ms"], window, slide, ["n", "errors"]).groupBy("endpoint", "span", "window_end").agg(*_stats()).drop("span")
    found = found.withColumn("window_start", seconds_after(F.col("window_end"), -window))
    panes = partials.groupBy("endpoint", "pane").agg(F.sum("n").alias("base_n"), F.sum(F.col("latency_ms").cast("long") * F.col("n")).alias("base_total"), F.sum("errors").alias("base_errors"))
    base = sliding(spans(panes, lookback, slide), ["endpoint"], lookback, slide, ["base_n", "base_total", "base_errors"]).drop("span").withColumnRenamed("window_end", "window_start")
    return _features(found.join(base, ["endpoint", "window_start"], "left"), ["endpoint", "window_start", "window_end"])


def anomaly_features(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All windows. Times count in whole seconds."""
    return anomaly_windows(anomaly_partials(events, s.anomaly_slide), s)


#: Size of a quantile sketch, and the rank error that 99 of 100 sketches of that size keep; twice the
#: error is met less than once in a million times.  Up to SKETCH_ITEMS values a sketch is exact.
SKETCH_ITEMS = 400
SKETCH_ERROR = 2.296 / SKETCH_ITEMS**0.9021


def latency_sketches(events: DataFrame, slide: int, items: int = SKETCH_ITEMS) -> DataFrame:
    """(endpoint, pane, n, sketch): a mergeable quantile sketch (KLL) of the latencies of each pane, of a
    size that does not grow with the events; those of several batches may be put together."""
    timed = events.where("event_time is not null and latency_ms is not null")
    return timed.groupBy("endpoint", aligned(F.col("event_time"), slide).alias("pane")).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint(F.col("latency_ms").cast("long"), F.lit(items)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, window: int, slide: int) -> DataFrame:
    """Nearest-rank percentiles of every window that has an event, from the sketches of its panes: each
    is a latency of the window, whose rank is off by about SKETCH_ERROR of the window's events at most."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(window // slide - 1)), lambda j: seconds_after(F.col("pane"), j * slide))
    spread = sketches.withColumn("window_end", F.explode(ends))
    merged = spread.groupBy("endpoint", "window_end").agg(F.sum("n").alias("request_count"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    at = lambda q: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q))
    return merged.select("endpoint", "window_end", "request_count", at(0.95).alias("p95_latency_ms"), at(0.99).alias("p99_latency_ms"))


def _histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("endpoint", "latency_ms").agg(F.count("*").alias("n"), F.sum(_server_error().cast("long")).alias("errors"))


def _base(events: DataFrame) -> DataFrame:
    return events.groupBy("endpoint").agg(F.count("*").alias("base_n"), F.sum(F.col("latency_ms").cast("long")).alias("base_total"), F.sum(_server_error().cast("long")).alias("base_errors"))


def _latest(events: DataFrame, s: Settings, scope: bool) -> DataFrame:
    end = events.agg(aligned(F.max("event_time"), s.anomaly_slide)).scalar()
    start = seconds_after(end, -s.anomaly_window)
    t = F.col("event_time")
    scoped = events.where((t > start) & (t <= end)) if scope else events
    base = _base(events.where((t > seconds_after(start, -s.anomaly_lookback)) & (t <= start)))
    stats = _histogram(scoped).groupBy("endpoint").agg(*_stats())
    return _features(stats.join(base, "endpoint", "left"), ["endpoint"]).withColumn("window_start", start).withColumn("window_end", end)


def anomaly_latest(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The one window that ends at the grid point of the latest event."""
    return _latest(events, s, scope=True)


def anomaly_as_run(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The variant that takes all given events for every figure but the baseline, with percentiles
    that are elements of the data: the smallest latency that as many of a hundred events do not pass."""
    bins = events.where("latency_ms is not null").groupBy("endpoint", "latency_ms").agg(F.count("*").alias("n"))
    of = W.partitionBy("endpoint")
    ranked = bins.withColumns({"upto": F.sum("n").over(of.orderBy("latency_ms")), "total": F.sum("n").over(of)})
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("latency_ms"))).cast("double")
    near = ranked.groupBy("endpoint").agg(at(95).alias("p95_latency_ms"), at(99).alias("p99_latency_ms"))
    return _latest(events, s, scope=False).drop("p95_latency_ms", "p99_latency_ms").join(near, "endpoint", "left")


def score_anomaly(features: DataFrame, s: Settings = Settings()) -> DataFrame:
    scored = features.withColumn("anomaly_score", anomaly_score())
    return scored.withColumn("is_anomaly", is_anomaly(F.col("anomaly_score"), s).cast("int")).withColumn("model_version", F.lit(s.label("anomaly")))
