"""DuckDB SQL for the registered queries, put together from named common table expressions."""

from __future__ import annotations

from ..schema import ANOMALY_ALERTS, BOT_FEATURE_WINDOWS, CONTRACTS, LOAD_FORECASTS, PROCESSED_LOGS
from .faults import record_text

# Fixed values, written out so that a wrong constant of the library shows.
ENDPOINTS = ["catalog/search", "auth", "account", "catalog/product", "basket", "payment", "media/img", "admin/user"]
AGENTS = ["Mozilla/5.0", "Mozilla/5.0 (Mobile)", "Mozilla/5.0 (X11; Linux x86_64)", "Googlebot/2.1", "curl/8.6.0", "python-requests/2.32.3"]
BOT_SIGNATURES = ["bot", "crawler", "spider", "ahrefs", "bingbot", "googlebot", "python-requests", "curl/", "wget", "sqlmap"]
LATENCY_BASES = [
    (["image", "images", "img", "media", "static", "productmodel", "article"], 55),
    (["search", "filter", "category", "products", "product"], 140),
    (["login", "auth", "signin", "register"], 260),
    (["cart", "basket", "profile", "account"], 190),
    (["orders", "order", "checkout", "payment"], 900),
    (["admin", "users", "user"], 320),
]
OTHER_BASE = 120
W, S, AW, AS, AL, B, H = 86400, 14400, 3600, 600, 18000, 3600, 10
GAP, KEEP = 21_600, 864_000
KEYS = "ip, session_id, user_agent"


def _texts(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _d(x: float) -> str:
    return f"{x}::DOUBLE"


def _time(seconds: str) -> str:
    return f"make_timestamp(({seconds}) * 1000000)"


def _clamp(x: str) -> str:
    return f"greatest({_d(0)}, least({_d(1)}, {x}))"


def _up(us: str, step: int) -> str:
    return f"((({us}) // 1000000 + {step} - 1) // {step}) * {step}"


def _score(x: str) -> str:
    """Half-even to four places of the shortest decimal text of a double."""
    return f"round_even((({x})::VARCHAR)::DECIMAL(38, 18), 4)::DOUBLE"


def _share(cond: str, name: str) -> str:
    return f"round_even((count(*) FILTER (WHERE {cond}))::DOUBLE / count(*), 4) AS {name}"


_RATIOS = ", ".join(
    [_share(f"status >= {k}00 AND status < {k + 1}00", f"http_response_{k}xx") for k in (2, 3, 4, 5)]
    + [_share(f"method = '{m.upper()}'", f"{m}_method") for m in ("get", "post", "head")]
    + [_share("method NOT IN ('GET', 'POST', 'HEAD')", "other_method")]
)
_NIGHTS = "count(*) FILTER (WHERE hour(t) < 6 OR hour(t) >= 22)"


def _bot_features(src: str, window: str, span: str, n_nights: str) -> str:
    """Features of the rows of ``src``, grouped by client and the column ``window``."""
    return f"""SELECT {KEYS}, {window}, count(*) AS number_of_requests, round_even((max(us) - min(us)) / {_d(1e6)}, 3) AS total_duration_s,
      round_even(sum(latency_ms)::DOUBLE / count(*), 3) AS average_time_ms, {_RATIOS}, ({n_nights})::INT AS night FROM {src} GROUP BY {KEYS}, {window}"""


def _tops(src: str, window: str) -> str:
    top = lambda c, name: f"(SELECT {KEYS}, {window}, max(n) AS {name} FROM (SELECT {KEYS}, {window}, {c}, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY {KEYS}, {window})"
    return f"SELECT * FROM {top('route_template', 'top_route')} JOIN {top('us // 1000000', 'top_second')} USING ({KEYS}, {window})"


def _bot_all(window: int, slide: int, p: str = "") -> dict[str, tuple[str, list[str]]]:
    return {
        f"bw{p}": (f"SELECT *, unnest(range(a, a + {window}, {slide})) AS we FROM (SELECT *, {_up('us', slide)} AS a FROM whole)", ["whole"]),
        f"bot_f{p}": (
            f"""SELECT f.*, {_time('we')} AS window_end, {_time(f'we - {window}')} AS window_start, top_second AS max_barrage,
              round_even(top_route::DOUBLE / number_of_requests, 4) AS repeated_requests
              FROM ({_bot_features(f'bw{p}', 'we', 'we', f'2 * {_NIGHTS} >= count(*)')}) f JOIN ({_tops(f'bw{p}', 'we')}) USING ({KEYS}, we)""",
            [f"bw{p}"],
        ),
    }


_BOT_SCORE = " + ".join(
    [
        f"least(number_of_requests / {_d(50)}, {_d(0.25)})",
        f"{_clamp('repeated_requests')} * {_d(0.25)}",
        f"{_clamp('http_response_4xx')} * {_d(0.15)}",
        f"{_clamp('http_response_5xx')} * {_d(0.1)}",
        f"least(max_barrage / {_d(20)}, {_d(0.1)})",
        f"CASE WHEN night = 1 THEN {_d(0.1)} ELSE {_d(0)} END",
        f"CASE WHEN regexp_matches(lower(user_agent), 'bot|crawler|spider|curl') THEN {_d(0.15)} ELSE {_d(0)} END",
        f"CASE WHEN ip IN ('1.2.3.4', '1.1.1.1') THEN {_d(0.15)} ELSE {_d(0)} END",
    ]
)


def _bot_scored(src: str) -> str:
    return f"SELECT *, (bot_score >= {_d(0.55)})::INT AS is_bot, 'mock-bot-v2' AS model_version FROM (SELECT *, {_score(_clamp(_BOT_SCORE))} AS bot_score FROM {src})"


_BASE = f"greatest(baseline_avg_latency_ms, {_d(1)})"
_ANOMALY_SCORE = " + ".join(
    [
        f"{_clamp(f'(avg_latency_ms / {_BASE} - {_d(1)}) / {_d(2)}')} * {_d(0.35)}",
        f"{_clamp(f'(p95_latency_ms / {_BASE} - {_d(1)}) / {_d(4)}')} * {_d(0.25)}",
        f"{_clamp(f'(p99_latency_ms / {_BASE} - {_d(1)}) / {_d(6)}')} * {_d(0.2)}",
        f"{_clamp(f'greatest(status_5xx_ratio - baseline_5xx_ratio, {_d(0)}) * {_d(4)}')} * {_d(0.2)}",
    ]
)


def _anomaly_scored(src: str) -> str:
    return f"SELECT *, (anomaly_score >= {_d(0.6)} OR p99_latency_ms / {_BASE} >= {_d(8)})::INT AS is_anomaly, 'mock-anomaly-v2' AS model_version FROM (SELECT *, {_score(_clamp(_ANOMALY_SCORE))} AS anomaly_score FROM {src})"


_A_STATS = f"""count(*) AS request_count, avg(latency_ms) AS a_, round_even(avg(latency_ms), 3) AS avg_latency_ms, round_even(quantile_cont(latency_ms, 0.95), 3) AS p95_latency_ms,
  round_even(quantile_cont(latency_ms, 0.99), 3) AS p99_latency_ms, {_share('status >= 500 AND status < 600', 'status_5xx_ratio')}"""
_A_BASE = "avg(latency_ms) AS b_, (count(*) FILTER (WHERE status >= 500 AND status < 600))::DOUBLE / count(*) AS e_"
_A_LAST = f"round_even(coalesce(b_, a_), 3) AS baseline_avg_latency_ms, round_even(coalesce(e_, {_d(0)}), 4) AS baseline_5xx_ratio"

_LATENCY = "CASE " + " ".join(f"WHEN list_has_any(tokens, {_texts(words)}) THEN {ms}" for words, ms in LATENCY_BASES) + f" ELSE {OTHER_BASE} END + CASE WHEN status >= 500 THEN 1700 WHEN status = 429 THEN 350 WHEN status >= 400 THEN 140 ELSE 0 END"
_FORECAST = f"greatest(cur + greatest(cur - prev, 0) + round_even(rolling_mean_5 * {_d(0.2)} + rolling_std_5 * {_d(0.1)}, 0)::BIGINT, cur)"
_BOUND = f"floor(greatest({_d(50)}, (cur + 25)::DOUBLE, (top * 8)::DOUBLE, rolling_mean_5 * {_d(6)} + rolling_std_5 * {_d(6)}, (heuristic * 6)::DOUBLE))::BIGINT"
_PATH = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"


_JSON_KINDS = {
    "string": "'VARCHAR'", "integer": "'BIGINT', 'UBIGINT'", "number": "'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN'", "boolean": "'BOOLEAN'",
    "array": "'ARRAY'", "object": "'OBJECT'",
}


def _value_rules(j: str, at: str, kind: str, rule: dict, path: str) -> str:
    """A list of messages (null where a rule holds) on a value that is there, by DuckDB's JSON functions."""
    text, out = f"json_extract_string({j}, '{at}')", []
    say = lambda cond, what: out.append(f"CASE WHEN {cond} THEN {path} || ': {what}' END")
    if "enum" in rule:
        say(f"NOT list_contains({_texts(rule['enum'])}, {text})", "expected one of " + str(rule["enum"]).replace("'", "''"))
    if "minLength" in rule:
        say(f"length({text}) < {rule['minLength']}", f"minLength {rule['minLength']}")
    if "format" in rule:
        say(f"TRY_CAST({text} AS TIMESTAMPTZ) IS NULL", "invalid date-time")
    for word, op in (("minimum", "<"), ("maximum", ">")):
        if word in rule:
            say(f"TRY_CAST({text} AS DOUBLE) {op} {rule[word]}", f"{word} {rule[word]}")
    if "minItems" in rule:
        say(f"json_array_length({j}, '{at}') < {rule['minItems']}", f"minItems {rule['minItems']}")
    found = f"[{', '.join(out)}]::VARCHAR[]"
    if "items" in rule:
        each = _value_rules("v", "$", *rule["items"], f"{path} || '[' || (i - 1) || ']'")
        found = f"list_concat({found}, flatten(list_transform(json_extract({j}, '{at}[*]'), lambda v, i: {each})))"
    if "properties" in rule:
        found = f"list_concat({found}, {_object_rules(at, rule['properties'], path)})"
    return f"CASE WHEN coalesce(json_type({j}, '{at}') IN ({_JSON_KINDS[kind]}), false) THEN {found} ELSE [{path} || ': expected {kind}'] END"


def _object_rules(at: str, rules: list, path: str) -> str:
    out = []
    for f, kind, required, rule in rules:
        absent = f"[{path} || '.{f}: missing required property']" if required else "[]::VARCHAR[]"
        out.append(f"CASE WHEN list_contains(json_keys(j, '{at}'), '{f}') THEN {_value_rules('j', f'{at}.{f}', kind, rule, f"{path} || '.{f}'")} ELSE {absent} END")
    known = _texts([r[0] for r in rules])
    out.append(f"list_transform(list_sort(list_filter(json_keys(j, '{at}'), lambda k: NOT list_contains({known}, k))), lambda k: {path} || '.' || k || ': additional property not allowed')")
    return f"flatten([{', '.join(out)}])"


def _contract(rules: list) -> str:
    found = f"list_filter({_object_rules('$', rules, "'$'")}, lambda e: e IS NOT NULL)"
    return f"CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string({found}, '; ') ELSE '$: expected object' END"


def _linear(columns: str, weights: str, intercept: float) -> str:
    """Sum of weighted columns, from the intercept on."""
    return f"{_d(intercept)} + " + " + ".join(f"({c.strip()})::DOUBLE * {_d(float(w))}" for c, w in zip(columns.split(","), weights.split(","), strict=True))


_BOT_MODEL = _linear(
    "number_of_requests, total_duration_s, average_time_ms, repeated_requests, http_response_2xx, http_response_3xx, http_response_4xx, http_response_5xx, get_method, post_method, head_method, other_method, night, max_barrage",
    "0.25, -0.00001, -0.002, 1.5, -0.5, 0.25, 2.0, 1.0, -0.75, 0.5, 1.25, 0.75, 0.5, 0.125", -1.0,
)
_ANOMALY_MODEL = _linear(
    "request_count, avg_latency_ms, p95_latency_ms, p99_latency_ms, status_5xx_ratio, baseline_avg_latency_ms, baseline_5xx_ratio",
    "0.0625, 0.004, 0.002, 0.001, 3.0, -0.006, -1.0", -0.5,
)
_FORECAST_MODEL = _linear("h[6], h[7], h[8], h[9], h[10], rolling_mean_5, rolling_std_5, hour_of_day, day_of_week", "0.25, 0.25, 0.5, 0.5, 40.0, -12.0, 0.5, 0.125, -0.25", -2.0)


_CTES: dict[str, tuple[str, list[str]]] = {
    "raw": (
        f"""SELECT event_id, ts AS t, epoch_us(ts) AS us, 'v2' AS schema_version, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, printf('req-%06d', event_id) AS request_id,
          'sess-u' || user_id AS session_id, CASE user_id % 25 WHEN 0 THEN '1.2.3.4' WHEN 1 THEN '1.1.1.1' ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS ip,
          {_texts(AGENTS)}[(user_id % 6 + 1)::INT] AS user_agent,
          CASE WHEN event_type = 'click' AND k % 7 = 0 THEN 'HEAD' WHEN event_type IN ('signup', 'purchase') THEN 'POST' WHEN event_type = 'error' AND k % 3 = 0 THEN 'PATCH' ELSE 'GET' END AS method,
          '/shop/' || {_texts(ENDPOINTS)}[k % 8 + 1] AS endpoint, '/shop/' || {_texts(ENDPOINTS)}[k % 8 + 1] AS route_template,
          (CASE WHEN event_type = 'error' THEN [500, 503, 404, 429][k % 4 + 1] WHEN event_type = 'signup' THEN 201 WHEN event_type = 'click' AND k % 10 = 0 THEN 302 ELSE 200 END)::INT AS status,
          floor(value * {_d(10)})::INT AS latency_ms FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
        [],
    ),
    "whole": ("SELECT * REPLACE (date_trunc('second', t) AS t, us // 1000000 * 1000000 AS us) FROM raw", ["raw"]),
    **_bot_all(W, S),
    **_bot_all(60, 10, "_plain"),
    "bots": (_bot_scored("bot_f"), ["bot_f"]),
    "bot_end": (f"SELECT {_up('max(us)', S)} AS e FROM raw", ["raw"]),
    "bot_scope": (f"SELECT raw.*, e FROM raw, bot_end WHERE us > (e - {W}) * 1000000 AND us <= e * 1000000", ["raw", "bot_end"]),
    "bot_l": (
        f"""SELECT f.* EXCLUDE (e), {_time('e')} AS window_end, {_time(f'e - {W}')} AS window_start, top_second AS max_barrage, round_even(top_route::DOUBLE / number_of_requests, 4) AS repeated_requests
          FROM ({_bot_features('bot_scope', 'e', 'e', f'2 * {_NIGHTS} >= count(*)')}) f JOIN ({_tops('bot_scope', 'e')}) USING ({KEYS}, e)""",
        ["bot_scope"],
    ),
    "kept": (f"SELECT * FROM raw WHERE us >= (SELECT max(us) FROM raw) - {KEEP * 1000000}", ["raw"]),
    "bot_r": (
        f"""SELECT f.* EXCLUDE (e), {_time('e')} AS window_end, {_time(f'e - {W}')} AS window_start, top_second AS max_barrage, round_even(top_route::DOUBLE / number_of_requests, 4) AS repeated_requests
          FROM ({_bot_features('(SELECT kept.*, e FROM kept, bot_end)', 'e', 'e', f'{_NIGHTS} > 0')}) f JOIN ({_tops('bot_scope', 'e')}) USING ({KEYS}, e)""",
        ["kept", "bot_end", "bot_scope"],
    ),
    "aw": (f"SELECT *, unnest(range(a, a + {AW}, {AS})) AS we FROM (SELECT *, {_up('us', AS)} AS a FROM whole)", ["whole"]),
    "ab": (f"SELECT *, unnest(range(a, a + {AL}, {AS})) AS ws FROM (SELECT *, {_up('us', AS)} AS a FROM whole)", ["whole"]),
    "anomaly_f": (
        f"""SELECT * EXCLUDE (we, ws, a_, b_, e_), {_time('we')} AS window_end, {_time('ws')} AS window_start, {_A_LAST}
          FROM (SELECT endpoint, we, we - {AW} AS ws, {_A_STATS} FROM aw GROUP BY endpoint, we) LEFT JOIN (SELECT endpoint, ws, {_A_BASE} FROM ab GROUP BY endpoint, ws) USING (endpoint, ws)""",
        ["aw", "ab"],
    ),
    "anomalies": (_anomaly_scored("anomaly_f"), ["anomaly_f"]),
    "anomaly_end": (f"SELECT {_up('max(us)', AS)} AS e FROM raw", ["raw"]),
    "anomaly_l": (
        f"""SELECT * EXCLUDE (e, a_, b_, e_), {_time('e')} AS window_end, {_time(f'e - {AW}')} AS window_start, {_A_LAST}
          FROM (SELECT endpoint, e, {_A_STATS} FROM raw, anomaly_end WHERE us > (e - {AW}) * 1000000 AND us <= e * 1000000 GROUP BY endpoint, e)
          LEFT JOIN (SELECT endpoint, {_A_BASE} FROM raw, anomaly_end WHERE us > (e - {AW + AL}) * 1000000 AND us <= (e - {AW}) * 1000000 GROUP BY endpoint) USING (endpoint)""",
        ["raw", "anomaly_end"],
    ),
    "buckets": (
        f"""SELECT CASE WHEN grouping(endpoint) = 1 THEN 'system' ELSE 'endpoint' END AS scope, coalesce(endpoint, '') AS endpoint, be, count(*) AS requests
          FROM (SELECT endpoint, {_up('us', B)} AS be FROM whole) GROUP BY GROUPING SETS ((endpoint, be), (be))""",
        ["whole"],
    ),
    "asked": (
        f"""SELECT scope, endpoint, be FROM buckets WHERE scope = 'endpoint' UNION
          SELECT scope, endpoint, be + j * {B} FROM buckets, range({H}) r(j) WHERE scope = 'system' AND be + j * {B} <= (SELECT max(be) FROM buckets)""",
        ["buckets"],
    ),
    "history": (
        f"""SELECT a.scope, a.endpoint, a.be, list(coalesce(requests, 0) ORDER BY j DESC) AS h, sum(requests) FILTER (WHERE j < 5)::DOUBLE AS s1, sum(requests * requests) FILTER (WHERE j < 5)::DOUBLE AS s2
          FROM (SELECT *, be - j * {B} AS at FROM asked, range({H}) r(j)) a LEFT JOIN buckets b ON a.scope = b.scope AND a.endpoint = b.endpoint AND a.at = b.be GROUP BY a.scope, a.endpoint, a.be""",
        ["asked", "buckets"],
    ),
    "forecast_f": (
        f"""SELECT scope, endpoint, h, {_time('be')} AS bucket_end, {_time(f'be + {B}')} AS predicted_bucket_end, h[-1] AS cur, h[-2] AS prev, list_max(h) AS top,
          round_even(coalesce(s1, 0) / {_d(5)}, 3) AS rolling_mean_5, round_even(sqrt((5 * coalesce(s2, 0) - coalesce(s1, 0) * coalesce(s1, 0)) / {_d(25)}), 3) AS rolling_std_5,
          hour({_time(f'be + {B}')})::INT AS hour_of_day, (isodow({_time(f'be + {B}')}) - 1)::INT AS day_of_week FROM history""",
        ["history"],
    ),
    "forecasts": (f"SELECT *, {_FORECAST} AS predicted_request_count, 'mock-forecast-v2' AS model_version, {H} AS history_size, cur AS current_rps FROM forecast_f", ["forecast_f"]),
    "logs": (
        f"""SELECT w.* REPLACE (t AS timestamp), coalesce(bot_score, 0) AS bot_score, coalesce(is_bot, 0) AS is_bot, coalesce(o.predicted_request_count, y.predicted_request_count, 0) AS predicted_load,
          coalesce(anomaly_score, 0) AS anomaly_score, coalesce(is_anomaly, 0) AS is_anomaly
          FROM whole w LEFT JOIN bots b ON w.ip = b.ip AND w.session_id = b.session_id AND w.user_agent = b.user_agent AND b.window_end = {_time(_up('w.us', S))}
          LEFT JOIN anomalies a ON w.endpoint = a.endpoint AND a.window_end = {_time(_up('w.us', AS))}
          LEFT JOIN forecasts o ON o.scope = 'endpoint' AND o.endpoint = w.endpoint AND o.bucket_end = {_time(_up('w.us', B))}
          LEFT JOIN forecasts y ON y.scope = 'system' AND y.bucket_end = {_time(_up('w.us', B))}""",
        ["whole", "bots", "anomalies", "forecasts"],
    ),
    "bots_l": (_bot_scored("bot_l"), ["bot_l"]),
    "anomalies_l": (_anomaly_scored("anomaly_l"), ["anomaly_l"]),
    "forecasts_l": ("SELECT * FROM forecasts WHERE bucket_end = (SELECT max(bucket_end) FROM forecasts)", ["forecasts"]),
    "logs_l": (
        f"""SELECT w.* REPLACE (date_trunc('second', t) AS timestamp), coalesce(bot_score, 0) AS bot_score, coalesce(is_bot, 0) AS is_bot,
          coalesce(o.predicted_request_count, (SELECT predicted_request_count FROM forecasts_l WHERE scope = 'system'), 0) AS predicted_load,
          coalesce(anomaly_score, 0) AS anomaly_score, coalesce(is_anomaly, 0) AS is_anomaly
          FROM raw w LEFT JOIN bots_l b USING ({KEYS}) LEFT JOIN anomalies_l a ON w.endpoint = a.endpoint LEFT JOIN forecasts_l o ON o.scope = 'endpoint' AND o.endpoint = w.endpoint""",
        ["raw", "bots_l", "anomalies_l", "forecasts_l"],
    ),
    "paths": (rf"SELECT page_id, CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END AS endpoint FROM (SELECT page_id, url_decode(replace(CASE WHEN {_PATH} = '' THEN url ELSE {_PATH} END, '+', '%2B')) AS p FROM pages)", []),
}


def _sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in _CTES[name][1]:
                add(n)
            order.append(name)

    for n in needs:
        add(n)
    head = ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order)
    return (f"WITH {head}\n" if head else "") + body


def _hourly(src: str, time: str, keys: str, columns: str) -> str:
    return f"SELECT date_trunc('hour', {time}) AS hour, {keys}, {columns} FROM {src} GROUP BY ALL"


def _avg9(c: str, name: str | None = None) -> str:
    return f"round(avg({c}), 9) AS {name or 'avg_' + c}"


_BOT_COLUMNS = (
    "ip, session_id, user_agent, window_start, window_end, number_of_requests, total_duration_s, average_time_ms, repeated_requests, http_response_2xx, http_response_3xx, "
    "http_response_4xx, http_response_5xx, get_method, post_method, head_method, other_method, night, max_barrage"
)
_A_COLUMNS = "endpoint, window_start, window_end, request_count, avg_latency_ms, p95_latency_ms, p99_latency_ms, status_5xx_ratio, baseline_avg_latency_ms, baseline_5xx_ratio"
_LOG_COLUMNS = ", ".join(c for c in PROCESSED_LOGS if c != "replay_timestamp")
_FORECAST_COLUMNS = "scope, endpoint, bucket_end, predicted_request_count, model_version"
_NULL = lambda c, m: f"CASE WHEN event_id % {m} = 0 THEN NULL ELSE {c} END"
_IP, _UA = f"coalesce({_NULL('ip', 7)}, '0.0.0.0')", f"coalesce({_NULL('user_agent', 11)}, 'unknown')"

ORACLES: dict[str, str] = {
    "q01_normalize": _sql(
        f"""SELECT schema_version, timestamp, coalesce({_NULL('request_id', 3)}, 'req-' || replace({_IP}, '.', '-') || '-' || timestamp) AS request_id,
          coalesce({_NULL('session_id', 5)}, {_IP} || '::' || {_UA}) AS session_id, {_IP} AS ip, {_UA} AS user_agent, coalesce({_NULL('method', 13)}, 'GET') AS method, endpoint,
          coalesce({_NULL('route_template', 17)}, endpoint) AS route_template, coalesce({_NULL('status', 19)}, 200)::INT AS status, coalesce({_NULL('latency_ms', 23)}, 5)::INT AS latency_ms,
          date_trunc('second', t) AS event_time FROM raw""",
        "raw",
    ),
    "q02_bot_features": _sql(f"SELECT {_BOT_COLUMNS} FROM bot_f", "bot_f"),
    "q02_bot_features_default": _sql(f"SELECT {_BOT_COLUMNS} FROM bot_f_plain", "bot_f_plain"),
    "q03_bot_latest": _sql(f"SELECT {_BOT_COLUMNS} FROM bot_l", "bot_l"),
    "q04_bot_scores": _sql(f"SELECT {KEYS}, window_end, bot_score, is_bot, model_version FROM bots", "bots"),
    "q05_anomaly_features": _sql(f"SELECT {_A_COLUMNS} FROM anomaly_f", "anomaly_f"),
    "q05_anomaly_latest": _sql(f"SELECT {_A_COLUMNS} FROM anomaly_l", "anomaly_l"),
    "q06_anomaly_scores": _sql("SELECT endpoint, window_end, anomaly_score, is_anomaly, model_version FROM anomalies", "anomalies"),
    "q07_traffic_buckets": _sql(f"SELECT scope, endpoint, {_time('be')} AS bucket_end, requests FROM buckets", "buckets"),
    "q08_forecast_features": _sql("SELECT scope, endpoint, bucket_end, predicted_bucket_end, rolling_mean_5, rolling_std_5, hour_of_day, day_of_week, array_to_string(h, ',') AS history FROM forecast_f", "forecast_f"),
    "q09_forecasts": _sql(f"SELECT {_FORECAST_COLUMNS} FROM forecasts", "forecasts"),
    "q10_processed_logs": _sql(f"SELECT {_LOG_COLUMNS} FROM logs", "logs"),
    "q10_processed_logs_as_of": _sql(f"SELECT {_LOG_COLUMNS} FROM logs_l", "logs_l"),
    "q11_bot_table": _sql(f"SELECT {', '.join(BOT_FEATURE_WINDOWS)} FROM bots", "bots"),
    "q12_forecast_table": _sql(f"SELECT {', '.join(LOAD_FORECASTS)} FROM forecasts", "forecasts"),
    "q13_anomaly_table": _sql(f"SELECT {', '.join(ANOMALY_ALERTS)} FROM anomalies", "anomalies"),
    "q14_table_counts": _sql(
        " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n FROM {src}" for name, src in (("processed_logs", "logs"), ("bot_feature_windows", "bots"), ("load_forecasts", "forecasts"), ("anomaly_alerts", "anomalies"))),
        "logs", "bots", "forecasts", "anomalies",
    ),
    "q15_bot_stats_hourly": _sql(
        _hourly("bots", "window_end", KEYS, f"count(*) AS total_requests, sum(is_bot)::BIGINT AS bot_detected, {_avg9('bot_score')}, max(max_barrage) AS max_barrage, {_avg9('repeated_requests')}, {_avg9('http_response_4xx', 'avg_4xx_ratio')}, {_avg9('http_response_5xx', 'avg_5xx_ratio')}"), "bots"
    ),
    "q16_endpoint_perf_hourly": _sql(
        _hourly("anomalies", "window_end", "endpoint", f"count(*) AS total_requests, {_avg9('avg_latency_ms', 'avg_latency_ms')}, max(p95_latency_ms) AS p95_latency_ms, max(p99_latency_ms) AS p99_latency_ms, max(status_5xx_ratio) AS max_5xx_ratio, sum(is_anomaly)::BIGINT AS anomaly_detected, {_avg9('anomaly_score')}"), "anomalies"
    ),
    "q17_forecast_accuracy_hourly": _sql(
        _hourly("forecasts", "predicted_bucket_end", "scope, endpoint", f"count(*) AS total_forecasts, {_avg9('predicted_request_count', 'avg_predicted_load')}, max(predicted_request_count) AS max_predicted_load, min(predicted_request_count) AS min_predicted_load"), "forecasts"
    ),
    "q18_processed_logs_summary_hourly": _sql(
        _hourly("logs", "timestamp", "endpoint", f"count(*) AS total_requests, count(DISTINCT ip) AS unique_ips, {_avg9('latency_ms')}, count(*) FILTER (WHERE status >= 400 AND status < 500) AS error_4xx_count, count(*) FILTER (WHERE status >= 500) AS error_5xx_count, sum(is_bot)::BIGINT AS bot_count, sum(is_anomaly)::BIGINT AS anomaly_count, {_avg9('bot_score')}, {_avg9('anomaly_score')}, {_avg9('predicted_load')}"), "logs"
    ),
    "q19_system_traffic_minutely": _sql(
        f"SELECT date_trunc('minute', timestamp) AS minute, count(*) AS total_requests, count(DISTINCT ip) AS unique_ips, {_avg9('latency_ms')}, round((count(*) FILTER (WHERE status >= 400))::DOUBLE / count(*), 9) AS error_rate, round(sum(is_bot)::DOUBLE / count(*), 9) AS bot_ratio, round(sum(is_anomaly)::DOUBLE / count(*), 9) AS anomaly_ratio FROM logs GROUP BY ALL", "logs"
    ),
    "q20_requests_per_minute": _sql("SELECT date_trunc('minute', timestamp) AS time, count(*) AS requests FROM logs GROUP BY ALL", "logs"),
    "q21_latest_system_forecast": _sql("SELECT predicted_request_count FROM forecasts WHERE scope = 'system' ORDER BY predicted_bucket_end DESC LIMIT 1", "forecasts"),
    "q22_top_bots": _sql("SELECT ip || ' / ' || user_agent AS entity, max(bot_score) AS bot_score, max(number_of_requests) AS number_of_requests, max(max_barrage) AS max_barrage FROM bots WHERE is_bot = 1 GROUP BY ALL ORDER BY bot_score DESC, number_of_requests DESC, entity LIMIT 10", "bots"),
    "q23_top_anomalies": _sql("SELECT endpoint, max(anomaly_score) AS anomaly_score, arg_max(avg_latency_ms, window_end) AS avg_latency_ms, arg_max(p99_latency_ms, window_end) AS p99_latency_ms, arg_max(status_5xx_ratio, window_end) AS status_5xx_ratio FROM anomalies WHERE is_anomaly = 1 GROUP BY endpoint ORDER BY anomaly_score DESC, endpoint LIMIT 10", "anomalies"),
    "q24_sessionize": _sql(
        f"""SELECT event_id, printf('sess-%s-%04d', substr(sha1(ip || '|' || user_agent), 1, 8), n) AS session_id, n AS session_number FROM
          (SELECT *, (sum(f) OVER (PARTITION BY ip, user_agent ORDER BY event_id))::BIGINT AS n FROM
          (SELECT *, CASE WHEN p IS NULL OR us < p OR us - p > {GAP * 1000000} THEN 1 ELSE 0 END AS f FROM (SELECT *, lag(us) OVER (PARTITION BY ip, user_agent ORDER BY event_id) AS p FROM raw)))""",
        "raw",
    ),
    "q25_route_templates": _sql(
        r"""SELECT page_id, CASE WHEN endpoint = '/' THEN '/' ELSE '/' || array_to_string(list_transform(string_split(trim(endpoint, '/'), '/'),
          lambda x: CASE WHEN regexp_full_match(x, '\d+[xX]\d+') THEN '{size}' WHEN regexp_full_match(x, '\d+|[0-9a-fA-F-]{8,}') THEN '{id}' ELSE x END), '/') END AS route_template FROM paths""",
        "paths",
    ),
    "q26_normalize_endpoint": _sql("SELECT page_id, endpoint FROM paths", "paths"),
    "q27_latency_heuristic": _sql(
        f"""SELECT event_id, (CASE WHEN regexp_matches(lower(user_agent), '{"|".join(BOT_SIGNATURES)}') AND status < 500 THEN greatest(35, base - 25) ELSE base END
          + greatest(0, len(tokens) - 2) * 12 + ('0x' || substr(sha1(endpoint || '|' || status || '|' || user_agent), 1, 6))::INT % 180)::INT AS inferred_ms
          FROM (SELECT *, {_LATENCY} AS base FROM (SELECT *, list_distinct(list_filter(string_split(lower(endpoint), '/'), lambda x: x <> '')) AS tokens FROM raw))""",
        "raw",
    ),
    "q28_parse_access_log": _sql(
        """SELECT event_id, schema_version, timestamp, timestamp AS original_timestamp, 'req-' || substr(sha1('0|' || strftime(t, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || ip || '|' || method || '|' || endpoint || '/' || event_id || '?x=1|' || status || '|' || user_agent), 1, 16) AS request_id,
          ip, user_agent, method, endpoint || '/' || event_id AS endpoint, endpoint || '/{id}' AS route_template, status, date_trunc('second', t) AS event_time FROM raw WHERE event_id % 10 NOT IN (3, 7)""",
        "raw",
    ),
    "q30_late_filter": _sql("SELECT event_id FROM kept", "kept"),
    "q30_retained_buckets": _sql(f"SELECT scope, endpoint, {_time('be')} AS bucket_end, requests FROM buckets WHERE be >= (SELECT max(be) FROM buckets) - {B * (H + 2)}", "buckets"),
    "q31_bot_as_run": _sql(f"SELECT {_BOT_COLUMNS} FROM bot_r", "bot_r"),
    "q32_anomaly_as_run": _sql(
        f"""SELECT endpoint, {_time('e')} AS window_end, {_time(f'e - {AW}')} AS window_start, request_count, round_even(a_, 3) AS avg_latency_ms, p95 AS p95_latency_ms, p99 AS p99_latency_ms,
          round_even(x_, 4) AS status_5xx_ratio, {_A_LAST}
          FROM (SELECT endpoint, count(*) AS request_count, avg(latency_ms) AS a_, quantile_disc(latency_ms, 0.95)::DOUBLE AS p95, quantile_disc(latency_ms, 0.99)::DOUBLE AS p99,
            (count(*) FILTER (WHERE status >= 500 AND status < 600))::DOUBLE / count(*) AS x_ FROM kept GROUP BY endpoint)
          LEFT JOIN (SELECT endpoint, {_A_BASE} FROM kept, anomaly_end WHERE us > (e - {AW + AL}) * 1000000 AND us <= (e - {AW}) * 1000000 GROUP BY endpoint) USING (endpoint), anomaly_end""",
        "kept", "anomaly_end",
    ),
    "q34_stream_windows": _sql(f"SELECT {_BOT_COLUMNS} FROM bot_f", "bot_f"),
    "q35_guardrail": _sql(
        f"""SELECT scope, endpoint, bucket_end, upper_bound, CASE WHEN m <= upper_bound THEN m::BIGINT ELSE heuristic END AS predicted_request_count,
          CASE WHEN m > upper_bound THEN 'guarded-forecast-v2' ELSE model_version END AS model_version
          FROM (SELECT *, greatest({_d(0)}, (cur * 9 - 20)::DOUBLE) AS m, {_BOUND} AS upper_bound FROM (SELECT *, predicted_request_count AS heuristic FROM forecasts))""",
        "forecasts",
    ),
    "q36_replay_rebase": _sql(
        f"""SELECT event_id, r AS replay_time, strftime(r, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM (SELECT event_id, make_timestamp(epoch_us(TIMESTAMP '2026-04-06 10:00:00') + floor(greatest({_d(0)}, (us - (SELECT min_by(us, event_id) FROM raw)) / {_d(30)}))::BIGINT) AS r FROM raw)""",
        "raw",
    ),
    "q37_bot_model": _sql(
        f"""SELECT {KEYS}, window_end, CASE WHEN lacks THEN bot_score ELSE p END AS bot_score, CASE WHEN lacks THEN is_bot ELSE (p >= {_d(0.5)})::INT END AS is_bot, 'model-bot-v2' AS model_version
          FROM (SELECT *, number_of_requests % 3 = 0 AS lacks, {_score(f'1 / (1 + exp(-({_BOT_MODEL})))')} AS p FROM bots)""",
        "bots",
    ),
    "q38_anomaly_model": _sql(
        f"""SELECT endpoint, window_end, p AS anomaly_score, (p >= {_d(0.5)})::INT AS is_anomaly, 'model-anomaly-v2' AS model_version
          FROM (SELECT *, {_score(f'1 / (1 + exp(-({_ANOMALY_MODEL})))')} AS p FROM anomalies)""",
        "anomalies",
    ),
    "q39_forecast_model": _sql(
        f"""SELECT scope, endpoint, bucket_end, CASE WHEN hour_of_day <> 3 AND m <= upper_bound THEN round_even(m, 0)::BIGINT ELSE heuristic END AS predicted_request_count,
          CASE WHEN hour_of_day <> 3 AND m > upper_bound THEN 'guarded-forecast-v2' ELSE 'model-forecast-v2' END AS model_version
          FROM (SELECT *, greatest({_d(0)}, {_FORECAST_MODEL}) AS m, {_BOUND} AS upper_bound FROM (SELECT *, predicted_request_count AS heuristic FROM forecasts))""",
        "forecasts",
    ),
}

#: What a stream over the whole table has closed: spans of the grid that end before the watermark.
_CTES["until"] = (f"SELECT max(g) AS u FROM (SELECT {_up('us', S)} AS g FROM whole) WHERE g + 1 <= (SELECT max(us) // 1000000 FROM whole) - {W}", ["whole"])
_BY = lambda time: f"epoch({time}) <= (SELECT u FROM until)"
ORACLES["q44_stream_tables"] = _sql(
    f"""SELECT 'processed_logs' AS table_name, request_id AS entity, timestamp AS at, round(bot_score + anomaly_score, 9) AS score, predicted_load AS load FROM logs WHERE {_BY('timestamp')}
      UNION ALL SELECT 'bot_feature_windows', ip || ' ' || session_id || ' ' || user_agent, window_end, bot_score, max_barrage FROM bots WHERE {_BY('window_end')}
      UNION ALL SELECT 'anomaly_alerts', endpoint, window_end, anomaly_score, request_count FROM anomalies WHERE {_BY('window_end')}
      UNION ALL SELECT 'load_forecasts', scope || ' ' || endpoint, bucket_end, NULL, predicted_request_count FROM forecasts WHERE {_BY('bucket_end')}""",
    "logs", "bots", "anomalies", "forecasts", "until",
)
#: Roll-ups kept batch by batch have the rows of those made at once.
for _kept, _whole in (("q45_kept_bot_stats", "q15_bot_stats_hourly"), ("q46_kept_endpoint_perf", "q16_endpoint_perf_hourly"), ("q47_kept_forecast_accuracy", "q17_forecast_accuracy_hourly"), ("q48_kept_logs_summary", "q18_processed_logs_summary_hourly"), ("q49_kept_system_traffic", "q19_system_traffic_minutely")):
    ORACLES[_kept] = ORACLES[_whole]
#: Every percentile of the sketches has to be within the stated error of its rank.
ORACLES["q50_latency_sketches"] = _sql(
    f"SELECT endpoint, {_time('we')} AS window_end, count(*) AS request_count, true AS p95_within, true AS p99_within FROM (SELECT *, unnest(range(a, a + {30 * W}, {W})) AS we FROM (SELECT *, {_up('us', W)} AS a FROM whole)) GROUP BY endpoint, we",
    "whole",
)
_BOT_FOREST = f"""(CASE WHEN number_of_requests <= 3.5 THEN CASE WHEN repeated_requests <= {_d(0.75)} THEN {_d(0.125)} ELSE {_d(0.5)} END WHEN max_barrage <= 1 THEN {_d(0.625)} ELSE {_d(0.9375)} END
  + CASE WHEN http_response_4xx > {_d(0.0625)} THEN {_d(0.875)} WHEN total_duration_s <= {_d(3600.5)} THEN {_d(0.25)} WHEN average_time_ms <= {_d(150.25)} THEN {_d(0.375)} ELSE {_d(0.75)} END
  + CASE WHEN night <= 0 THEN {_d(0.3125)} WHEN get_method <= {_d(0.5)} THEN {_d(0.8125)} ELSE {_d(0.4375)} END) / {_d(3)}"""
_FORECAST_FOREST = f"""(CASE WHEN h[10] <= 1.5 THEN CASE WHEN rolling_mean_5 <= {_d(0.55)} THEN {_d(0.75)} ELSE {_d(2.25)} END WHEN rolling_std_5 <= {_d(0.9)} THEN {_d(3.5)} ELSE {_d(6)} END
  + CASE WHEN hour_of_day <= 11 THEN {_d(1)} WHEN h[9] <= 2 THEN {_d(2.5)} ELSE {_d(7.75)} END) / {_d(2)}"""
ORACLES["q53_forest_scores"] = _sql(
    f"""SELECT ip || ' ' || session_id || ' ' || user_agent AS entity, window_end AS at, CASE WHEN lacks THEN bot_score ELSE p END AS value, (CASE WHEN lacks THEN is_bot ELSE (p >= {_d(0.5)})::INT END)::VARCHAR AS said
      FROM (SELECT *, number_of_requests % 3 = 0 AS lacks, {_score(_BOT_FOREST)} AS p FROM bots)
      UNION ALL SELECT scope || ' ' || endpoint, bucket_end, (CASE WHEN m <= upper_bound THEN round_even(m, 0)::BIGINT ELSE heuristic END)::DOUBLE, CASE WHEN m > upper_bound THEN 'guarded-forecast-v2' ELSE 'model-forecast-v2' END
      FROM (SELECT *, {_FORECAST_FOREST} AS m, {_BOUND} AS upper_bound FROM (SELECT *, predicted_request_count AS heuristic FROM forecasts))""",
    "bots", "forecasts",
)
ORACLES["q54_original_time"] = _sql(
    """SELECT request_id, CASE WHEN event_id % 3 = 1 THEN t ELSE t - INTERVAL 1530 MINUTE END AS timestamp, CASE WHEN event_id % 3 <> 1 THEN t END AS replay_timestamp, status, latency_ms
      FROM (SELECT * REPLACE (date_trunc('second', t) AS t) FROM raw)""",
    "raw",
)
_IN = lambda time: f"{time} >= TIMESTAMP '2024-01-09 04:05:06' AND {time} <= TIMESTAMP '2024-01-16 07:08:09'"
ORACLES["q52_dashboard_range"] = _sql(
    f"""SELECT 'requests' AS panel, strftime(date_trunc('minute', timestamp), '%Y-%m-%d %H:%M:%S') AS entity, count(*)::DOUBLE AS value FROM logs WHERE {_IN('timestamp')} GROUP BY 1, 2
      UNION ALL (SELECT 'bots', ip || ' / ' || user_agent AS e, max(bot_score) AS b FROM bots WHERE is_bot = 1 AND {_IN('window_end')} GROUP BY ip, user_agent ORDER BY b DESC, max(number_of_requests) DESC, e LIMIT 10)
      UNION ALL (SELECT 'anomalies', endpoint, max(anomaly_score) AS x FROM anomalies WHERE is_anomaly = 1 AND {_IN('window_end')} GROUP BY endpoint ORDER BY x DESC, endpoint LIMIT 10)
      UNION ALL (SELECT 'forecast', 'system', predicted_request_count::DOUBLE FROM forecasts WHERE scope = 'system' AND {_IN('predicted_bucket_end')} ORDER BY predicted_bucket_end DESC LIMIT 1)""",
    "logs", "bots", "anomalies", "forecasts",
)
_FAULT = "event_id % 16"
ORACLES["q51_ingest"] = _sql(
    f"""SELECT CASE WHEN {_FAULT} NOT IN (7, 8) THEN request_id END AS request_id, CASE WHEN {_FAULT} IN (0, 1, 7, 8, 9) THEN 200 WHEN {_FAULT} = 4 THEN 404 ELSE status END::INT AS status,
      CASE WHEN {_FAULT} IN (7, 8, 11) THEN 0 WHEN {_FAULT} = 5 THEN 77 ELSE latency_ms END::INT AS latency_ms,
      CASE WHEN {_FAULT} IN (2, 3, 7, 8, 12) THEN NULL WHEN {_FAULT} = 10 THEN date_trunc('day', t) WHEN {_FAULT} = 13 THEN date_trunc('second', t) - INTERVAL 210 MINUTE ELSE date_trunc('second', t) END AS event_time,
      CASE {_FAULT} WHEN 0 THEN 'status: expected integer' WHEN 1 THEN 'status: expected integer' WHEN 2 THEN 'event_time: no date-time' WHEN 3 THEN 'event_time: no date-time'
        WHEN 6 THEN 'ip: expected string' WHEN 7 THEN 'expected object; event_time: no date-time' WHEN 8 THEN 'expected object; event_time: no date-time' WHEN 11 THEN 'latency_ms: expected integer'
        WHEN 12 THEN 'timestamp: expected string; event_time: no date-time' ELSE '' END AS errors FROM raw""",
    "raw",
)

_V2 = {"feature_version": "'v2'", "window_start": "start_text", "window_end": "end_text", "bucket_end": "start_text", "predicted_bucket_end": "end_text", "history_rps": "history_text"}


def _checked(contract: str, src: str, keys: str, turn: str, texts: str, expressions: dict[str, str | None]) -> str:
    text, n = record_text(CONTRACTS[contract], expressions)
    return _sql(f"SELECT {keys}, {_contract(CONTRACTS[contract])} AS errors FROM (SELECT {keys}, ({text})::JSON AS j FROM (SELECT *{texts}, ({turn}) % {2 * n} AS fault FROM {src}))", src)


_ISO = lambda c, name: f", strftime({c}, '%Y-%m-%dT%H:%M:%SZ') AS {name}"
_WINDOW = _ISO("window_start", "start_text") + _ISO("window_end", "end_text")
_BUCKETS = _ISO("bucket_end", "start_text") + _ISO("predicted_bucket_end", "end_text") + ", '[' || array_to_string(h, ',') || ']' AS history_text"
_TURN = {"bot": "epoch(window_end)::BIGINT // 14400 + number_of_requests", "forecast": "epoch(bucket_end)::BIGINT // 3600 + length(endpoint)", "anomaly": "epoch(window_end)::BIGINT // 600 + request_count"}
_BY_BOT, _BY_LOAD, _BY_ENDPOINT = f"{KEYS}, window_end", "scope, endpoint, bucket_end", "endpoint, window_end"
ORACLES |= {
    "q29_contract_errors": _checked("raw-log", "raw", "event_id", "event_id", "", {"original_timestamp": None}),
    "q40_processed_log_contract": _checked("processed-log", "logs", "request_id", "latency_ms + status", _ISO("timestamp", "time_text"), {"timestamp": "time_text", "replay_timestamp": None}),
    "q41_bot_request_contract": _checked("bot-request", "bots", _BY_BOT, _TURN["bot"], _WINDOW, _V2),
    "q41_bot_response_contract": _checked("bot-response", "bots", _BY_BOT, _TURN["bot"], "", {"is_bot": "is_bot = 1"}),
    "q42_forecast_request_contract": _checked("forecast-request", "forecasts", _BY_LOAD, _TURN["forecast"], _BUCKETS, _V2),
    "q42_forecast_response_contract": _checked("forecast-response", "forecasts", _BY_LOAD, _TURN["forecast"], "", {}),
    "q43_anomaly_request_contract": _checked("anomaly-request", "anomalies", _BY_ENDPOINT, _TURN["anomaly"], _WINDOW, _V2),
    "q43_anomaly_response_contract": _checked("anomaly-response", "anomalies", _BY_ENDPOINT, _TURN["anomaly"], "", {"is_anomaly": "is_anomaly = 1"}),
}
