"""Deterministic scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import Settings

C = F.col


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def suspicious_agent(user_agent: Column) -> Column:
    return F.lower(user_agent).rlike("bot|crawler|spider|curl")


def _flag(cond: Column, weight: float) -> Column:
    return F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))


def bot_score(s: Settings) -> Column:
    """Of columns number_of_requests, repeated_requests, http_response_4xx and _5xx, max_barrage,
    night, user_agent and ip."""
    total = (
        F.least(C("number_of_requests") / 50.0, F.lit(0.25))
        + clamp(C("repeated_requests")) * 0.25
        + clamp(C("http_response_4xx")) * 0.15
        + clamp(C("http_response_5xx")) * 0.10
        + F.least(C("max_barrage") / 20.0, F.lit(0.10))
        + _flag(C("night") == 1, 0.10)
        + _flag(suspicious_agent(C("user_agent")), 0.15)
        + _flag(C("ip").isin(*s.bot_ips), 0.15)
    )
    return F.bround(clamp(total), 4)


def anomaly_score() -> Column:
    base = F.greatest(C("baseline_avg_latency_ms"), F.lit(1.0))
    total = (
        clamp((C("avg_latency_ms") / base - 1.0) / 2.0) * 0.35
        + clamp((C("p95_latency_ms") / base - 1.0) / 4.0) * 0.25
        + clamp((C("p99_latency_ms") / base - 1.0) / 6.0) * 0.20
        + clamp(F.greatest(C("status_5xx_ratio") - C("baseline_5xx_ratio"), F.lit(0.0)) * 4.0) * 0.20
    )
    return F.bround(clamp(total), 4)


def is_anomaly(score: Column, s: Settings) -> Column:
    return (score >= s.anomaly_threshold) | (C("p99_latency_ms") / F.greatest(C("baseline_avg_latency_ms"), F.lit(1.0)) >= 8.0)


def forecast(s: Settings) -> Column:
    """Requests expected in the next bucket, of history_rps, rolling_mean_5 and rolling_std_5."""
    current = F.element_at("history_rps", -1)
    before = F.coalesce(F.try_element_at("history_rps", F.lit(-2)), current)
    smooth = F.bround(C("rolling_mean_5") * s.forecast_smoothing + C("rolling_std_5") * 0.1, 0).cast("long")
    return F.greatest(current + F.greatest(current - before, F.lit(0)) + smooth, current)


def forecast_bound(heuristic: Column) -> Column:
    """Largest model forecast that is believed."""
    current = F.element_at("history_rps", -1)
    return F.floor(
        F.greatest(
            F.lit(50.0),
            (current + 25).cast("double"),
            (F.array_max("history_rps") * 8).cast("double"),
            C("rolling_mean_5") * 6 + C("rolling_std_5") * 6,
            (heuristic * 6).cast("double"),
        )
    ).cast("long")
