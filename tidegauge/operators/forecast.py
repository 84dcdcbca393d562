"""Traffic buckets, zero-filled histories and load forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import forecast, forecast_bound
from ..functions.times import aligned, seconds_after
from ..settings import Settings


def traffic_buckets(events: DataFrame, bucket: int) -> DataFrame:
    """(scope, endpoint, bucket_end, requests): events of each endpoint, and of the whole system under
    the endpoint ''. Counts of several batches may be added up."""
    by_endpoint = events.where("event_time is not null").groupBy("endpoint", aligned(F.col("event_time"), bucket).alias("bucket_end")).agg(F.count("*").alias("requests"))
    system = by_endpoint.groupBy("bucket_end").agg(F.sum("requests").alias("requests"))
    return by_endpoint.select(F.lit("endpoint").alias("scope"), "endpoint", "bucket_end", "requests").union(system.select(F.lit("system"), F.lit(""), "bucket_end", "requests"))


def retained_buckets(buckets: DataFrame, s: Settings) -> DataFrame:
    """Buckets that a history may still need."""
    latest = buckets.agg(F.unix_seconds(F.max("bucket_end"))).scalar()
    return buckets.where(F.unix_seconds("bucket_end") >= latest - s.bucket_retention)


def _with_features(histories: DataFrame, s: Settings) -> DataFrame:
    recent = F.slice("history_rps", F.greatest(F.lit(1), F.size("history_rps") - 4), F.lit(5))
    total = lambda f: F.aggregate(recent, F.lit(0).cast("long"), lambda a, x: a + f(x))
    n = F.size(recent)
    mean, squares = total(lambda x: x), total(lambda x: x * x)
    nxt = seconds_after(F.col("bucket_end"), s.bucket)
    return histories.select(
        "scope",
        "endpoint",
        "bucket_end",
        nxt.alias("predicted_bucket_end"),
        "history_rps",
        F.bround(mean / n, 3).alias("rolling_mean_5"),
        F.bround(F.sqrt((n * squares - mean * mean) / (n * n)), 3).alias("rolling_std_5"),
        F.hour(nxt).alias("hour_of_day"),
        F.weekday(nxt).alias("day_of_week"),
    )


def _histories(buckets: DataFrame, s: Settings) -> DataFrame:
    """History of every (target, bucket end) with a request in it or in the buckets before it."""
    offsets = F.sequence(F.lit(0), F.lit(s.history - 1))
    later = buckets.withColumn("k", F.explode(offsets)).withColumn("at", seconds_after(F.col("bucket_end"), F.col("k") * s.bucket))
    found = later.groupBy("scope", "endpoint", "at", "k").agg(F.sum("requests").alias("requests")).groupBy("scope", "endpoint", "at").agg(F.map_from_entries(F.collect_list(F.struct("k", "requests"))).alias("m"))
    filled = F.transform(F.reverse(offsets), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    return found.select("scope", "endpoint", F.col("at").alias("bucket_end"), filled.alias("history_rps"))


def forecast_features(buckets: DataFrame, s: Settings = Settings(), until: int | None = None) -> DataFrame:
    """All buckets: a row for an endpoint where it has a request in the bucket, for the system in each
    bucket up to the last one (up to ``until``, in seconds, where that is given)."""
    last = buckets.agg(F.max("bucket_end")).scalar() if until is None else F.timestamp_seconds(F.lit(until))
    asked = (F.element_at("history_rps", -1) > 0) | ((F.col("scope") == "system") & (F.col("bucket_end") <= last))
    return _with_features(_histories(buckets, s).where(asked), s)


def forecast_latest(buckets: DataFrame, as_of: str, s: Settings = Settings(), endpoints: DataFrame | None = None) -> DataFrame:
    """Histories that end at the bucket of ``as_of``, of the system and of the ``endpoints`` given
    (all by default); targets without a request in their history are absent."""
    end = aligned(F.lit(as_of).cast("timestamp"), s.bucket)
    within = buckets.where((F.col("bucket_end") <= end) & (F.col("bucket_end") > seconds_after(end, -s.bucket * s.history)))
    found = _histories(within, s).where(F.col("bucket_end") == end)
    if endpoints is not None:
        asked = endpoints.select("endpoint").distinct().union(endpoints.sparkSession.createDataFrame([("",)], "endpoint string"))
        found = found.join(asked, "endpoint", "left_semi")
    return _with_features(found, s)


def score_forecast(features: DataFrame, s: Settings = Settings()) -> DataFrame:
    return features.withColumn("predicted_request_count", forecast(s)).withColumn("model_version", F.lit(s.label("forecast")))


def guard_forecast(scored: DataFrame, model: str, s: Settings = Settings()) -> DataFrame:
    """Takes a model's forecast (column ``model``) where it is within the guardrail, else keeps the
    heuristic and says so in model_version."""
    value = F.greatest(F.lit(0.0), F.col(model).cast("double"))
    bound = forecast_bound(F.col("predicted_request_count"))
    believed = F.col(model).isNotNull() & (F.size("history_rps") >= s.history)
    label = F.when(believed & (value > bound), F.lit("guarded-forecast-v2")).otherwise(F.col("model_version"))
    count = F.when(believed & (value <= bound), F.bround(value, 0).cast("long")).otherwise(F.col("predicted_request_count"))
    return scored.withColumn("upper_bound", bound).withColumn("model_version", label).withColumn("predicted_request_count", count)
