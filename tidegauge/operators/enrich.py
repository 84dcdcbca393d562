"""Events with their predictions, and the rows of the four tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.times import aligned, parse_iso
from ..settings import Settings
from .bot import KEYS


def bot_rows(scored: DataFrame) -> DataFrame:
    return scored.select(*schema.BOT_FEATURE_WINDOWS)


def anomaly_rows(scored: DataFrame) -> DataFrame:
    return scored.select(*schema.ANOMALY_ALERTS)


def forecast_rows(scored: DataFrame) -> DataFrame:
    sized = scored.withColumn("history_size", F.size("history_rps")).withColumn("current_rps", F.element_at("history_rps", -1))
    return sized.select(*schema.LOAD_FORECASTS)


def _processed(joined: DataFrame, s: Settings) -> DataFrame:
    replayed = F.length("original_timestamp") > 0
    stamp = F.date_trunc("SECOND", "event_time")
    replay = F.when(replayed, F.date_trunc("SECOND", parse_iso(F.col("timestamp")))) if s.use_original_event_time else F.lit(None).cast("timestamp")
    filled = joined.withColumns(
        {
            "bot_score": F.coalesce("bot_score", F.lit(0.0)),
            "is_bot": F.coalesce("is_bot", F.lit(0)),
            "anomaly_score": F.coalesce("anomaly_score", F.lit(0.0)),
            "is_anomaly": F.coalesce("is_anomaly", F.lit(0)),
            "predicted_load": F.coalesce("own_load", "system_load", F.lit(0).cast("long")),
            "replay_timestamp": replay,
            "timestamp": stamp,
        }
    )
    return filled.select(*schema.PROCESSED_LOGS)


def _sides(bots: DataFrame, anomalies: DataFrame, forecasts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    bot = bots.select(*KEYS, F.col("window_end").alias("bot_end"), "bot_score", "is_bot")
    anomaly = anomalies.select("endpoint", F.col("window_end").alias("anomaly_end"), "anomaly_score", "is_anomaly")
    own = forecasts.where("scope = 'endpoint'").select("endpoint", F.col("bucket_end").alias("load_end"), F.col("predicted_request_count").alias("own_load"))
    system = forecasts.where("scope = 'system'").select(F.col("bucket_end").alias("load_end"), F.col("predicted_request_count").alias("system_load"))
    return bot, anomaly, own, system


def placed(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Events with their grid points, on which their windows and buckets end: those that are there
    already (of a stored table, see ``store``) stay."""
    t = F.col("event_time")
    points = {"bot_end": aligned(t, s.bot_slide), "anomaly_end": aligned(t, s.anomaly_slide), "load_end": aligned(t, s.bucket)}
    return events.withColumns({c: x for c, x in points.items() if c not in events.columns})


def enrich(events: DataFrame, bots: DataFrame, anomalies: DataFrame, forecasts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Each event with the scores of the windows and the bucket that end at its own grid point.

    Equi-joins on the key and that end; sides are as large as the data, so Spark picks the join.
    Events and bot windows stored in buckets of client and end (see ``store``) are not shuffled.
    """
    bot, anomaly, own, system = _sides(bots, anomalies, forecasts)
    joined = placed(events, s).join(bot, [*KEYS, "bot_end"], "left").join(anomaly, ["endpoint", "anomaly_end"], "left").join(own, ["endpoint", "load_end"], "left").join(system, "load_end", "left")
    return _processed(joined, s)


def flagged(events: DataFrame, bots: DataFrame, anomalies: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``enrich`` with time, endpoint, ip, status, latency_ms, is_bot and is_anomaly only, for
    roll-ups that read no more: without the forecasts, each of which adds no row."""
    bot = bots.select(*KEYS, F.col("window_end").alias("bot_end"), "is_bot")
    anomaly = anomalies.select("endpoint", F.col("window_end").alias("anomaly_end"), "is_anomaly")
    joined = placed(events, s).join(bot, [*KEYS, "bot_end"], "left").join(anomaly, ["endpoint", "anomaly_end"], "left")
    flags = (F.coalesce(c, F.lit(0)).alias(c) for c in ("is_bot", "is_anomaly"))
    return joined.select(F.date_trunc("SECOND", "event_time").alias("timestamp"), "endpoint", "ip", "status", "latency_ms", *flags)


def enrich_as_of(events: DataFrame, bots: DataFrame, anomalies: DataFrame, forecasts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Each event with the scores of the one latest window and bucket (as a live tick does)."""
    bot, anomaly, own, system = _sides(bots, anomalies, forecasts)
    load = system.agg(F.max("system_load")).scalar()
    joined = events.join(bot.drop("bot_end"), KEYS, "left").join(anomaly.drop("anomaly_end"), "endpoint", "left").join(own.drop("load_end"), "endpoint", "left").withColumn("system_load", load)
    return _processed(joined, s)
