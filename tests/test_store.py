"""Stored tables: joins without a shuffle, folders left out by time, and the same rows as without."""

import re

from pyspark.sql import functions as F

from tests.conftest import TINY
from tidegauge.operators import bot
from tidegauge.operators.enrich import enrich
from tidegauge.operators.rollups import top_bots
from tidegauge.plans import queries
from tidegauge.plans.queries import WIDE, _stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bot_join_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events, bots = _stored(spark, TINY, "events"), _stored(spark, TINY, "bot_feature_windows")
        keys = [*bot.KEYS, "bot_end"]
        joined = events.join(bots.withColumnRenamed("window_end", "bot_end").select(*keys, "bot_score"), keys, "left")
        assert "Exchange" not in plan(joined) and plan(joined).count("SelectedBucketsCount") == 2
        both = enrich(events, bots, _stored(spark, TINY, "anomaly_alerts"), _stored(spark, TINY, "load_forecasts"), WIDE)
        assert len(re.findall(r"Exchange hashpartitioning\(ip#\d+, session_id", plan(both))) == 0
        again = queries.q10_processed_logs(spark, TINY)
        assert sorted(map(str, both.select(*(F.col(c).cast("string") for c in again.columns)).collect())) == sorted(map(str, again.select(*(F.col(c).cast("string") for c in again.columns)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_range_of_time_reads_its_months(spark):
    bots = _stored(spark, TINY, "bot_feature_windows")
    found = top_bots(bots, ("2024-02-03 00:00:00", "2024-03-01 00:00:00"))
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(found))
    assert filters and "202402" in filters[0] and "202403" in filters[0]
    assert not found.collect()
    inside = ("2024-01-09 00:00:00", "2024-01-16 12:00:00")
    times = bots.where("is_bot = 1").agg(F.min("window_end"), F.max("window_end")).first()
    assert str(times[0]) < inside[0] and str(times[1]) > inside[1]
    want = top_bots(queries._bots(spark, TINY).where(f"window_end between '{inside[0]}' and '{inside[1]}'"))
    assert top_bots(bots, inside).collect() == want.collect()
    assert _stored(spark, TINY, "bot_feature_windows").inputFiles() == bots.inputFiles()  # stored once
