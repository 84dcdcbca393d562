"""Model scoring, its fallbacks and its files; contract messages; JSON lines and summaries."""

import json
import random
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import models, quality
from tidegauge.operators.anomaly import score_anomaly
from tidegauge.operators.bot import score_bot
from tidegauge.operators.forecast import score_forecast
from tidegauge.schema import CONTRACTS
from tidegauge.settings import Settings
from tidegauge.sinks import batch_summary, write_lines

MODEL = Settings(mode="model")


def _bots(spark):
    zero = {c: F.lit(0.0) for c in models.BOT_FEATURES.values()}
    rows = spark.range(60).select(F.concat(F.lit("10.0.0."), "id").alias("ip"), F.lit("s").alias("session_id"), F.lit("x").alias("user_agent"), F.lit("mine").alias("features"), F.lit("too").alias("row"), "id")
    return rows.withColumns(zero).withColumns({"number_of_requests": F.col("id").cast("int"), "night": F.lit(0), "average_time_ms": F.when(F.col("id") % 10 != 4, F.lit(5.0))})


def _forecasts(spark, history):
    return spark.createDataFrame([(history, 1.0, 0.0, 3, 4)], "history_rps array<bigint>, rolling_mean_5 double, rolling_std_5 double, hour_of_day int, day_of_week int").withColumn("scope", F.lit("system"))


def test_forest_is_fitted_saved_and_read(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = _bots(spark).withColumn("label", (F.col("id") >= 30).cast("int"))
    names = ["NUMBER_OF_REQUESTS", "AVERAGE_TIME"]  # few, so that each tree sees the one that tells
    models.save_scorer(spark, root, "bot", models.fit_forest(rows, "bot", "label", names, trees=5), bot_ips=["10.0.0.4"], anomaly_threshold=0.7)
    s, scorers = models.load_scorers(spark, root)
    assert (s.mode, s.bot_ips, s.anomaly_threshold, s.bot_threshold) == ("model", ("10.0.0.4",), 0.7, 0.55)
    assert scorers["forecast"] is None and scorers["anomaly"] is None and scorers["bot"].columns == tuple(names)
    got = {r.id: r for r in models.score_bot_by(_bots(spark), scorers["bot"], s).collect()}
    plain = {r.id: r for r in score_bot(_bots(spark), s).collect()}
    assert len(got) == 60
    for i, r in got.items():
        assert (r.features, r.row, r.model_version) == ("mine", "too", "model-bot-v2")
        if i % 10 == 4:  # a feature is missing
            assert (r.bot_score, r.is_bot) == (plain[i].bot_score, plain[i].is_bot)
        else:
            assert r.is_bot == int(r.bot_score >= 0.5)
            assert abs(i - 30) < 4 or r.is_bot == int(i >= 30)  # at the border, resampled trees may disagree


def test_no_model(spark):
    for root in (tempfile.mkdtemp(prefix="spark-"), "/tmp/no-such-folder"):
        s, scorers = models.load_scorers(spark, root, Settings(mode="model"))
        assert s.mode == "mock" and set(scorers.values()) == {None}
    rows = _bots(spark)
    for scorer in (None, models.Scorer(models.Linear((1.0,)), ("UNKNOWN",)), models.Scorer(models.Linear((1.0, 2.0)), ("NIGHT",)), models.Scorer(models.Linear(()), ())):
        assert sorted(models.score_bot_by(rows, scorer, MODEL).collect()) == sorted(score_bot(rows, MODEL).collect())


def test_anomaly_by_threshold_only(spark):
    rows = spark.createDataFrame([(1, 10.0, 10.0, 90.0, 0.0, 10.0, 0.0), (2, 10.0, 10.0, 90.0, 0.0, None, 0.0)], ", ".join(f"{c} {'int' if c == 'request_count' else 'double'}" for c in models.ANOMALY_FEATURES))
    low = models.Scorer(models.Linear((0.0,) * 7, -5.0), tuple(models.ANOMALY_FEATURES), 0.5)
    a, b = models.score_anomaly_by(rows, low, MODEL).orderBy("request_count").collect()
    assert (a.anomaly_score, a.is_anomaly) == (0.0067, 0)  # the heuristic's second rule does not apply
    assert b.anomaly_score == score_anomaly(rows, MODEL).where("request_count = 2").first().anomaly_score


def test_forecast_is_guarded(spark):
    fixed = lambda x: models.Scorer(models.Linear((0.0,) * 14, x, logistic=False), tuple(models.FORECAST_FEATURES))
    rows = _forecasts(spark, [1] * 10)
    for value, want in ((12.5, (12, "model-forecast-v2")), (-3.0, (0, "model-forecast-v2")), (50.0, (50, "model-forecast-v2")), (51.0, (1, "guarded-forecast-v2"))):
        r = models.score_forecast_by(rows, fixed(value), MODEL).first()
        assert (r.predicted_request_count, r.model_version) == want
    short = _forecasts(spark, [1, 4])
    assert models.score_forecast_by(short, fixed(9.0), MODEL).first().predicted_request_count == score_forecast(short, MODEL).first().predicted_request_count


def test_contract_messages(spark):
    good = {"feature_version": "v2", "bucket_end": "2024-01-01T10:00:00Z", "predicted_bucket_end": "2024-01-01T10:01:00Z", "target": {"scope": "system", "endpoint": ""},
            "history_rps": [0, 3], "features": {"rolling_mean_5": 1, "rolling_std_5": 0.5, "hour_of_day": 10, "day_of_week": 0}}
    cases = [
        (good, []),
        (good | {"history_rps": []}, ["$.history_rps: minItems 1"]),
        (good | {"history_rps": [1, -2, "a", 1.5]}, ["$.history_rps[1]: minimum 0", "$.history_rps[2]: expected integer", "$.history_rps[3]: expected integer"]),
        (good | {"target": {"scope": "host", "port": 1}}, ["$.target.scope: expected one of ['system', 'endpoint']", "$.target.endpoint: missing required property", "$.target.port: additional property not allowed"]),
        (good | {"target": None}, ["$.target: expected object"]),
        (good | {"features": good["features"] | {"hour_of_day": 24}}, ["$.features.hour_of_day: maximum 23"]),
        ({k: v for k, v in good.items() if k != "features"} | {"zone": 1}, ["$.features: missing required property", "$.zone: additional property not allowed"]),
    ]
    lines = spark.createDataFrame([(i, json.dumps(c), "mine", ["x"]) for i, (c, _) in enumerate(cases)] + [(99, " ", "", [])], "i int, value string, doc string, keys0 array<string>")
    found = quality.validate_lines(lines, CONTRACTS["forecast-request"])
    assert [(r.doc, r.errors) for r in found.orderBy("i").collect()] == [("mine", want) for _, want in cases]
    assert tuple(quality.error_counts(found).first()) == (7, 6, 11)
    assert tuple(quality.error_counts(found.limit(0)).first()) == (0, 0, 0)


def test_checks_of_large_contracts(spark):
    """Spark interprets what it does within a lambda: rules are tested outside, and only those that seem broken looked at there."""
    features = {f: 1 for f, *_ in CONTRACTS["bot-request"][-1][3]["properties"]}
    good = {"feature_version": "v2", "window_start": "2024-01-01T10:00:00Z", "window_end": "2024-01-01T11:00:00Z", "entity": {"ip": "1.2.3.4", "session_id": "s", "user_agent": "a"}, "features": features}
    bad = good | {"features": features | {"night": 2, "get_method": -0.5, "max_barrage": 1.5}}
    found = quality.validate_lines(spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad))], "i int, value string"), CONTRACTS["bot-request"])
    assert [r.errors for r in found.sort("i").collect()] == [[], ["$.features.get_method: minimum 0", "$.features.night: expected one of [0, 1]", "$.features.max_barrage: expected integer"]]
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        last = found._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert last.count("try_variant_get") < 2 * len(features)


def test_lines_and_summary(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/lines"
    rows = spark.createDataFrame([("a", None), ("ü", 1)], "name string, n int")
    write_lines(rows, path)
    assert sorted(json.loads(r.value)["name"] for r in spark.read.text(path).collect()) == ["a", "ü"]
    assert sorted(spark.read.text(path).collect())[0].value == '{"name":"a","n":null}'
    assert batch_summary({"processed_logs": rows, "load_forecasts": rows.limit(1)}, "kafka", "file") == {"source": "kafka", "sink": "file", "count": 2, "bot_windows": 0, "forecasts": 1, "anomalies": 0}


def test_fitted_forests_as_expressions_and_as_sql(spark):
    """What ``compiled`` makes of fitted forests scores as they do, in Spark and in another engine."""
    rng = random.Random(11)
    rows = [(*(round(rng.random() * 9, 3) for _ in range(3)), *(0.0,) * 4, rng.randrange(2)) for _ in range(400)]
    rows = [(*r[:-1], int(r[0] + r[1] > 9 or r[2] > 8)) for r in rows]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in models.ANOMALY_FEATURES) + ", label int")
    fitted = models.fit_forest(table, "anomaly", "label", models.ANOMALY_FEATURES, trees=5, depth=4)
    made = models.compiled(fitted)
    features = models.features_of("anomaly")
    wanted = [r.p for r in models.predict(table, fitted, features, "p").collect()]
    got = [r.p for r in models.predict(table, made, features, "p").collect()]
    assert got == pytest.approx(wanted, abs=1e-12) and len(set(got)) > 3
    table.toPandas().to_parquet(path := tempfile.mkdtemp(prefix="spark-") + "/rows.parquet")
    other = duckdb.sql(f"SELECT {made.model.sql(models.ANOMALY_FEATURES)} FROM '{path}'").fetchall()
    assert [x for (x,) in other] == got
    numbers = models.fit_forest(table.withColumn("history_rps", F.array(*(F.lit(1) for _ in range(10)))).withColumnsRenamed({"avg_latency_ms": "rolling_mean_5", "p95_latency_ms": "rolling_std_5"}).selectExpr("*", "1 AS hour_of_day", "2 AS day_of_week"), "forecast", "request_count", ["rolling_mean_5", "rolling_std_5"], trees=3, depth=3)
    frame = spark.createDataFrame([(1.0, 2.0, [1] * 10), (5.0, 8.0, [1] * 10), (None, 1.0, [1] * 10)], "rolling_mean_5 double, rolling_std_5 double, history_rps array<int>").selectExpr("*", "1 AS hour_of_day", "2 AS day_of_week")
    pair = [[r.p for r in models.predict(frame, m, models.features_of("forecast"), "p").collect()] for m in (numbers, models.compiled(numbers))]
    assert pair[0][:2] == pytest.approx(pair[1][:2]) and pair[0][2] is pair[1][2] is None
    with pytest.raises(ValueError):
        models.compiled(fitted, most_nodes=3)
