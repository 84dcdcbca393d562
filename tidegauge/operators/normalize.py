"""Raw logs to events: defaults, legacy fields, event time, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_iso
from ..settings import Settings


def normalize(logs: DataFrame, s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """Events of raw logs: absent fields filled, ``event_time`` added (null if no time can be read).

    ``original_timestamp`` and ``request_time_ms`` may be absent.  The columns ``keep`` (by default the
    ``errors`` and ``line`` of a source, where they are) are kept as they are; a field with an error is
    filled too, and ``quarantine`` takes its row away.
    """
    has = lambda c: F.col(c) if c in logs.columns else F.lit(None)
    ip, agent = F.coalesce("ip", F.lit("0.0.0.0")), F.coalesce("user_agent", F.lit("unknown"))
    endpoint = F.coalesce("endpoint", F.lit("/unknown"))
    original = has("original_timestamp").cast("string")
    chosen = F.when(F.length(original) > 0, original).otherwise(F.col("timestamp")) if s.use_original_event_time else F.col("timestamp")
    return logs.select(
        F.coalesce("schema_version", F.lit("v2")).alias("schema_version"),
        "timestamp",
        original.alias("original_timestamp"),
        F.coalesce("request_id", F.concat(F.lit("req-"), F.replace(ip, F.lit("."), F.lit("-")), F.lit("-"), F.col("timestamp"))).alias("request_id"),
        F.coalesce("session_id", F.concat(ip, F.lit("::"), agent)).alias("session_id"),
        ip.alias("ip"),
        agent.alias("user_agent"),
        F.upper(F.coalesce("method", F.lit("GET"))).alias("method"),
        endpoint.alias("endpoint"),
        F.coalesce(F.col("route_template"), endpoint).alias("route_template"),
        F.coalesce(F.col("status").try_cast("int"), F.lit(200)).alias("status"),
        F.coalesce(F.col("latency_ms").try_cast("int"), has("request_time_ms").try_cast("int"), F.lit(0)).alias("latency_ms"),
        parse_iso(chosen).alias("event_time"),
        *(keep if keep is not None else [c for c in ("errors", "line") if c in logs.columns]),
    )


def judged(events: DataFrame) -> DataFrame:
    """Events with all their ``errors``: fields that could not be read (see ``sources.logs.typed_logs``), or
    no time."""
    known = F.col("errors") if "errors" in events.columns else F.array().cast("array<string>")
    return events.withColumn("errors", F.when(F.col("event_time").isNull(), F.array_append(known, F.lit("event_time: no date-time"))).otherwise(known))


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that hold what they should, and the others with their ``errors``. Both read the source; to
    read it once, take ``judged``."""
    found = judged(events)
    return found.where(F.size("errors") == 0).drop("errors", "line"), found.where(F.size("errors") > 0)


def whole_seconds(events: DataFrame) -> DataFrame:
    """Event times without their part of a second, as the output tables store them."""
    return events.withColumn("event_time", F.date_trunc("SECOND", "event_time"))


def shift_to(logs: DataFrame, now: str) -> DataFrame:
    """All times moved alike, so that the latest is ``now``; logs without a time stay as they are."""
    ts = parse_iso(F.col("timestamp"))
    latest = logs.agg(F.unix_micros(F.max(ts))).scalar()
    moved = F.timestamp_micros(F.unix_micros(ts) + F.unix_micros(F.lit(now).cast("timestamp")) - latest)
    return logs.withColumn("timestamp", F.coalesce(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "timestamp"))


def retained(events: DataFrame, keep_seconds: int) -> DataFrame:
    """Events no older than ``keep_seconds`` before the latest, that age included."""
    latest = events.agg(F.unix_micros(F.max("event_time"))).scalar()
    return events.where(F.unix_micros("event_time") >= latest - keep_seconds * 1_000_000)
