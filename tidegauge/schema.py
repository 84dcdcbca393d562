"""Schemas of the inputs and the four output tables, and the contracts of all messages."""

from __future__ import annotations

RAW_LOG = (
    "schema_version string, timestamp string, original_timestamp string, request_id string, session_id string, ip string, "
    "user_agent string, method string, endpoint string, route_template string, status int, latency_ms int, request_time_ms int"
)

PROCESSED_LOGS = [
    "schema_version", "timestamp", "replay_timestamp", "request_id", "session_id", "ip", "user_agent", "method", "endpoint",
    "route_template", "status", "latency_ms", "bot_score", "is_bot", "predicted_load", "anomaly_score", "is_anomaly",
]
BOT_FEATURE_WINDOWS = [
    "window_start", "window_end", "ip", "session_id", "user_agent", "number_of_requests", "repeated_requests", "max_barrage",
    "http_response_4xx", "http_response_5xx", "bot_score", "is_bot", "model_version",
]
LOAD_FORECASTS = ["bucket_end", "predicted_bucket_end", "scope", "endpoint", "history_size", "current_rps", "predicted_request_count", "model_version"]
ANOMALY_ALERTS = [
    "window_start", "window_end", "endpoint", "request_count", "avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "status_5xx_ratio",
    "baseline_avg_latency_ms", "anomaly_score", "is_anomaly", "model_version",
]

#: Closed contract of a raw log: (field, type, required, rule). A rule is a dict of JSON-Schema words.
RAW_LOG_CONTRACT = [
    ("schema_version", "string", True, {"minLength": 1}),
    ("timestamp", "string", True, {"format": "date-time"}),
    ("original_timestamp", "string", False, {"format": "date-time"}),
    ("request_id", "string", True, {"minLength": 1}),
    ("session_id", "string", True, {"minLength": 1}),
    ("ip", "string", True, {"minLength": 7}),
    ("user_agent", "string", True, {"minLength": 1}),
    ("method", "string", True, {"enum": ["GET", "POST", "HEAD", "PUT", "DELETE", "PATCH"]}),
    ("endpoint", "string", True, {"minLength": 1}),
    ("route_template", "string", True, {"minLength": 1}),
    ("status", "integer", True, {"minimum": 100, "maximum": 599}),
    ("latency_ms", "integer", True, {"minimum": 0}),
]

_TEXT, _TIME, _COUNT, _SHARE, _FLAG = {"minLength": 1}, {"format": "date-time"}, {"minimum": 0}, {"minimum": 0, "maximum": 1}, {"enum": [0, 1]}


def _all(kind: str, rule: dict, *names: str) -> list:
    return [(name, kind, True, rule) for name in names]


#: Closed contracts by name; objects have rules for their properties, arrays for their items.
CONTRACTS = {
    "raw-log": RAW_LOG_CONTRACT,
    "processed-log": [
        ("schema_version", "string", True, _TEXT),
        ("timestamp", "string", True, _TIME),
        ("replay_timestamp", "string", False, _TIME),
        *_all("string", _TEXT, "request_id", "session_id"),
        ("ip", "string", True, {"minLength": 7}),
        *_all("string", _TEXT, "user_agent", "method", "endpoint", "route_template"),
        ("status", "integer", True, {"minimum": 100, "maximum": 599}),
        ("latency_ms", "integer", True, _COUNT),
        ("bot_score", "number", True, _SHARE),
        ("is_bot", "integer", True, _FLAG),
        ("predicted_load", "integer", True, _COUNT),
        ("anomaly_score", "number", True, _SHARE),
        ("is_anomaly", "integer", True, _FLAG),
    ],
    "bot-request": [
        ("feature_version", "string", True, _TEXT),
        *_all("string", _TIME, "window_start", "window_end"),
        ("entity", "object", True, {"properties": [("ip", "string", True, {"minLength": 7}), *_all("string", _TEXT, "session_id", "user_agent")]}),
        ("features", "object", True, {"properties": [
            ("number_of_requests", "integer", True, _COUNT),
            *_all("number", _COUNT, "total_duration_s", "average_time_ms"),
            *_all("number", _SHARE, "repeated_requests", "http_response_2xx", "http_response_3xx", "http_response_4xx", "http_response_5xx"),
            *_all("number", _SHARE, "get_method", "post_method", "head_method", "other_method"),
            ("night", "integer", True, _FLAG),
            ("max_barrage", "integer", True, _COUNT),
        ]}),
    ],
    "bot-response": [("is_bot", "boolean", True, {}), ("bot_score", "number", True, _SHARE), ("model_version", "string", True, _TEXT)],
    "forecast-request": [
        ("feature_version", "string", True, _TEXT),
        *_all("string", _TIME, "bucket_end", "predicted_bucket_end"),
        ("target", "object", True, {"properties": [("scope", "string", True, {"enum": ["system", "endpoint"]}), ("endpoint", "string", True, {})]}),
        ("history_rps", "array", True, {"minItems": 1, "items": ("integer", _COUNT)}),
        ("features", "object", True, {"properties": [
            *_all("number", _COUNT, "rolling_mean_5", "rolling_std_5"),
            ("hour_of_day", "integer", True, {"minimum": 0, "maximum": 23}),
            ("day_of_week", "integer", True, {"minimum": 0, "maximum": 6}),
        ]}),
    ],
    "forecast-response": [("predicted_request_count", "integer", True, _COUNT), ("model_version", "string", True, _TEXT)],
    "anomaly-request": [
        ("feature_version", "string", True, _TEXT),
        *_all("string", _TIME, "window_start", "window_end"),
        ("entity", "object", True, {"properties": _all("string", _TEXT, "endpoint")}),
        ("features", "object", True, {"properties": [
            ("request_count", "integer", True, _COUNT),
            *_all("number", _COUNT, "avg_latency_ms", "p95_latency_ms", "p99_latency_ms"),
            ("status_5xx_ratio", "number", True, _SHARE),
            ("baseline_avg_latency_ms", "number", True, _COUNT),
            ("baseline_5xx_ratio", "number", True, _SHARE),
        ]}),
    ],
    "anomaly-response": [("is_anomaly", "boolean", True, {}), ("anomaly_score", "number", True, _SHARE), ("model_version", "string", True, _TEXT)],
}
