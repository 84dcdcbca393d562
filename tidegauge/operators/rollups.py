"""Hourly and per-minute roll-ups, table counts and dashboard views of the four tables."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import within


def _hour(c: str) -> Column:
    return F.date_trunc("HOUR", c).alias("hour")


def _avg(c: str, name: str | None = None) -> Column:
    return F.avg(c).alias(name or f"avg_{c}")


def bot_stats_hourly(bots: DataFrame) -> DataFrame:
    return bots.groupBy(_hour("window_end"), "ip", "session_id", "user_agent").agg(
        F.count("*").alias("total_requests"),
        F.sum("is_bot").alias("bot_detected"),
        _avg("bot_score"),
        F.max("max_barrage").alias("max_barrage"),
        _avg("repeated_requests"),
        _avg("http_response_4xx", "avg_4xx_ratio"),
        _avg("http_response_5xx", "avg_5xx_ratio"),
    )


def endpoint_perf_hourly(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy(_hour("window_end"), "endpoint").agg(
        F.count("*").alias("total_requests"),
        _avg("avg_latency_ms", "avg_latency_ms"),
        F.max("p95_latency_ms").alias("p95_latency_ms"),
        F.max("p99_latency_ms").alias("p99_latency_ms"),
        F.max("status_5xx_ratio").alias("max_5xx_ratio"),
        F.sum("is_anomaly").alias("anomaly_detected"),
        _avg("anomaly_score"),
    )


def forecast_accuracy_hourly(forecasts: DataFrame) -> DataFrame:
    n = "predicted_request_count"
    return forecasts.groupBy(_hour("predicted_bucket_end"), "scope", "endpoint").agg(
        F.count("*").alias("total_forecasts"), _avg(n, "avg_predicted_load"), F.max(n).alias("max_predicted_load"), F.min(n).alias("min_predicted_load")
    )


def _unique(c: str, approximate: bool) -> Column:
    return (F.approx_count_distinct(c) if approximate else F.count_distinct(c)).alias("unique_ips")


def processed_logs_summary_hourly(logs: DataFrame, approximate: bool = False) -> DataFrame:
    """``approximate``: distinct addresses by a sketch of fixed size instead of exactly."""
    return logs.groupBy(_hour("timestamp"), "endpoint").agg(
        F.count("*").alias("total_requests"),
        _unique("ip", approximate),
        _avg("latency_ms"),
        F.count_if((F.col("status") >= 400) & (F.col("status") < 500)).alias("error_4xx_count"),
        F.count_if(F.col("status") >= 500).alias("error_5xx_count"),
        F.sum("is_bot").alias("bot_count"),
        F.sum("is_anomaly").alias("anomaly_count"),
        _avg("bot_score"),
        _avg("anomaly_score"),
        _avg("predicted_load"),
    )


def system_traffic_minutely(logs: DataFrame, approximate: bool = False) -> DataFrame:
    n = F.count("*")
    return logs.groupBy(F.date_trunc("MINUTE", "timestamp").alias("minute")).agg(
        n.alias("total_requests"),
        _unique("ip", approximate),
        _avg("latency_ms"),
        (F.count_if(F.col("status") >= 400) / n).alias("error_rate"),
        (F.sum("is_bot") / n).alias("bot_ratio"),
        (F.sum("is_anomaly") / n).alias("anomaly_ratio"),
    )


# -- kept incrementally --------------------------------------------------------------------------
#: Of each roll-up: the table that it is made of, its time column and step, its other keys.
_ROLLUPS = {
    "bot_stats_hourly": ("bot_feature_windows", "window_end", "HOUR", ["ip", "session_id", "user_agent"]),
    "endpoint_perf_hourly": ("anomaly_alerts", "window_end", "HOUR", ["endpoint"]),
    "forecast_accuracy_hourly": ("load_forecasts", "predicted_bucket_end", "HOUR", ["scope", "endpoint"]),
    "processed_logs_summary_hourly": ("processed_logs", "timestamp", "HOUR", ["endpoint"]),
    "system_traffic_minutely": ("processed_logs", "timestamp", "MINUTE", []),
}
#: Of each roll-up: columns that are summed up (name of the sum, expression), columns whose maximum and
#: whose minimum is kept.  Of addresses a theta sketch is kept.
_STATES: dict[str, tuple[dict[str, str], list[str], list[str]]] = {
    "bot_stats_hourly": ({"bots": "is_bot", "score": "bot_score", "repeated": "repeated_requests", "r4": "http_response_4xx", "r5": "http_response_5xx"}, ["max_barrage"], []),
    "endpoint_perf_hourly": ({"latency": "avg_latency_ms", "anomalies": "is_anomaly", "score": "anomaly_score"}, ["p95_latency_ms", "p99_latency_ms", "status_5xx_ratio"], []),
    "forecast_accuracy_hourly": ({"load": "predicted_request_count"}, ["predicted_request_count"], ["predicted_request_count"]),
    "processed_logs_summary_hourly": (
        {"latency": "latency_ms", "e4": "int(status >= 400 and status < 500)", "e5": "int(status >= 500)", "bots": "is_bot", "anomalies": "is_anomaly", "bot_score": "bot_score", "anomaly_score": "anomaly_score", "load": "predicted_load"},
        [], [],
    ),
    "system_traffic_minutely": ({"latency": "latency_ms", "errors": "int(status >= 400)", "bots": "is_bot", "anomalies": "is_anomaly"}, [], []),
}
_NAMED = {
    "bot_stats_hourly": {"total_requests": "n", "bot_detected": "sum_bots", "avg_bot_score": "sum_score / n", "max_barrage": "max_max_barrage", "avg_repeated_requests": "sum_repeated / n", "avg_4xx_ratio": "sum_r4 / n", "avg_5xx_ratio": "sum_r5 / n"},
    "endpoint_perf_hourly": {
        "total_requests": "n", "avg_latency_ms": "sum_latency / n", "p95_latency_ms": "max_p95_latency_ms", "p99_latency_ms": "max_p99_latency_ms", "max_5xx_ratio": "max_status_5xx_ratio",
        "anomaly_detected": "sum_anomalies", "avg_anomaly_score": "sum_score / n",
    },
    "forecast_accuracy_hourly": {"total_forecasts": "n", "avg_predicted_load": "sum_load / n", "max_predicted_load": "max_predicted_request_count", "min_predicted_load": "min_predicted_request_count"},
    "processed_logs_summary_hourly": {
        "total_requests": "n", "unique_ips": "theta_sketch_estimate(ips)", "avg_latency_ms": "sum_latency / n", "error_4xx_count": "sum_e4", "error_5xx_count": "sum_e5", "bot_count": "sum_bots",
        "anomaly_count": "sum_anomalies", "avg_bot_score": "sum_bot_score / n", "avg_anomaly_score": "sum_anomaly_score / n", "avg_predicted_load": "sum_load / n",
    },
    "system_traffic_minutely": {"total_requests": "n", "unique_ips": "theta_sketch_estimate(ips)", "avg_latency_ms": "sum_latency / n", "error_rate": "sum_errors / n", "bot_ratio": "sum_bots / n", "anomaly_ratio": "sum_anomalies / n"},
}


#: Parts in which the rows of one time and key are summed up, by address.
SALTS = 8


def _step(name: str) -> str:
    return _ROLLUPS[name][2].lower()


def roll_up_states(tables: dict[str, DataFrame], names: Collection[str] = tuple(_ROLLUPS)) -> dict[str, DataFrame]:
    """Of a batch of the four tables, the states of the roll-ups made of them: sums, extremes and
    sketches by time and key, a row for each that the batch touches.  States of different batches,
    late ones too, are kept side by side; ``rolled_up`` merges them.  Only the roll-ups ``names`` are made, and
    only their columns read.

    Rows are shuffled by time and key, and by SALTS parts of the addresses where these are no key, before
    they are summed up: a task that sums up a share of a file would hold states of nearly as many keys as it has rows."""
    out = {}
    for name, (source, time, step, keys) in _ROLLUPS.items():
        if source in tables and name in names:
            sums, most, least = _STATES[name]
            states = [F.count("*").alias("n"), *(F.sum(F.expr(e)).alias(f"sum_{c}") for c, e in sums.items()), *(F.max(c).alias(f"max_{c}") for c in most), *(F.min(c).alias(f"min_{c}") for c in least)]
            if "ips" in _NAMED[name].get("unique_ips", ""):
                states.append(F.theta_sketch_agg("ip").alias("ips"))
            rows = tables[source].withColumn(_step(name), F.date_trunc(step, time))
            parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            salt = [] if "ip" in keys else [F.pmod(F.crc32(F.col("ip").cast("binary")), F.lit(SALTS))] if "ip" in rows.columns else []
            out[name] = rows.repartition(parts, _step(name), *keys, *salt).groupBy(_step(name), *keys).agg(*states)
    return out


def merged_states(states: DataFrame, name: str) -> DataFrame:
    """The states of several batches as one for each time and key, of the same columns."""
    merge = {"n": F.sum, "sum": F.sum, "max": F.max, "min": F.min, "ips": F.theta_union_agg}
    keys = [_step(name), *_ROLLUPS[name][3]]
    columns = [c for c in states.columns if c.split("_")[0] in merge and c not in keys]
    return states.groupBy(*keys).agg(*(merge[c.split("_")[0]](c).alias(c) for c in columns))


def rolled_up(states: DataFrame, name: str) -> DataFrame:
    """A roll-up from the states of all batches; distinct addresses are exact up to 4,096 a row."""
    found = merged_states(states, name)
    return found.select(_step(name), *_ROLLUPS[name][3], *(F.expr(e).alias(c) for c, e in _NAMED[name].items()))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# -- dashboard views, over (from, to] of the given time column -----------------------------------
def requests_per_minute(logs: DataFrame, time_range: tuple[str, str] | None = None) -> DataFrame:
    return within(logs, "timestamp", time_range).groupBy(F.date_trunc("MINUTE", "timestamp").alias("time")).agg(F.count("*").alias("requests")).orderBy("time")


def latest_system_forecast(forecasts: DataFrame, time_range: tuple[str, str] | None = None) -> DataFrame:
    return within(forecasts.where("scope = 'system'"), "predicted_bucket_end", time_range).orderBy(F.desc("predicted_bucket_end")).limit(1).select("predicted_request_count")


def top_bots(bots: DataFrame, time_range: tuple[str, str] | None = None, k: int = 10) -> DataFrame:
    """The k clients of the highest score; of equal ones, the name that sorts first."""
    flagged = within(bots.where("is_bot = 1"), "window_end", time_range)
    found = flagged.groupBy(F.concat_ws(" / ", "ip", "user_agent").alias("entity")).agg(F.max("bot_score").alias("bot_score"), F.max("number_of_requests").alias("number_of_requests"), F.max("max_barrage").alias("max_barrage"))
    return found.orderBy(F.desc("bot_score"), F.desc("number_of_requests"), "entity").limit(k)


def top_anomalies(anomalies: DataFrame, time_range: tuple[str, str] | None = None, k: int = 10) -> DataFrame:
    """The k endpoints of the highest score, with the figures of their latest flagged window."""
    flagged = within(anomalies.where("is_anomaly = 1"), "window_end", time_range)
    latest = [F.max_by(c, "window_end").alias(c) for c in ("avg_latency_ms", "p99_latency_ms", "status_5xx_ratio")]
    return flagged.groupBy("endpoint").agg(F.max("anomaly_score").alias("anomaly_score"), *latest).orderBy(F.desc("anomaly_score"), "endpoint").limit(k)
