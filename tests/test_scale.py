"""What shows with many rows only, on made rows."""

from pyspark.sql import functions as F

from tests.conftest import SMALL, TINY
from tidegauge.functions.times import aligned
from tidegauge.operators import anomaly, bot, rollups
from tidegauge.plans import queries


def test_percentiles_as_run_are_exact_over_many_rows(spark):
    """400,000 latencies of 200,003 values in 16 partitions, and an endpoint of ten rows."""
    rows = spark.range(0, 400_000, 1, 16)
    made = rows.select(
        F.when(F.col("id") % 40_000 == 7, F.lit("/few")).otherwise(F.lit("/many")).alias("endpoint"), F.lit(200).alias("status"),
        (F.col("id") * 7919 % 200_003).cast("int").alias("latency_ms"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("event_time"),
    )
    got = {r.endpoint: (r.p95_latency_ms, r.p99_latency_ms) for r in anomaly.anomaly_as_run(made).collect()}
    values = {"/few": [], "/many": []}
    for i in range(400_000):
        values["/few" if i % 40_000 == 7 else "/many"].append(i * 7919 % 200_003)
    for endpoint, found in values.items():
        found.sort()
        rank = lambda q: float(found[-(-q * len(found) // 100) - 1])
        assert got[endpoint] == (rank(95), rank(99))


def test_partitions_grow_with_the_events(spark, monkeypatch):
    """10,000 events at 400 for each partition: bot windows, and the states of roll-ups, in 25 partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(queries, "EVENTS_A_PARTITION", 400)
    try:
        found = queries.q02_bot_features(spark, SMALL)
        assert found.rdd.getNumPartitions() == 25
        states = rollups.roll_up_states({"bot_feature_windows": bot.score_bot(found)})["bot_stats_hourly"]
        assert states.rdd.getNumPartitions() == 25
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ratios_that_are_not_rounded_are_the_same(spark):
    """All shares of up to 40 events, by the function and by rounding each."""
    pairs = spark.range(1, 41).select(F.col("id").alias("n")).select("n", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("c"))
    rows = pairs.select(bot._ratio("c", "got"), F.bround(F.col("c") / F.col("n"), 4).alias("want")).collect()
    assert len(rows) == 860 and all(r.got == r.want for r in rows)


def test_ingest_reads_its_lines_once(spark):
    found = queries.q51_ingest(spark, SMALL)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_q54_normalizes_events_once(spark):
    """Windows, buckets and the joins read the normalized events, not the source again."""
    read = queries.q54_original_time(spark, SMALL).inputFiles()
    assert read and not [f for f in read if "events.parquet" in f]


def test_q49_makes_what_the_traffic_needs(spark):
    """Of a session without stored tables: none is stored, and the rows are those of whole processed logs."""
    place = f"{TINY}/."
    got = queries.q49_kept_system_traffic(spark, place)
    assert not any(spark.catalog.tableExists(queries._table_name(place, name)) for name in queries._STORED)
    want = queries._out(rollups.system_traffic_minutely(queries._processed(spark, TINY)), rounded=True)
    text = lambda df: sorted(map(str, df.select(*(F.col(c).cast("string") for c in want.columns)).collect()))
    assert text(got) == text(want) and got.count() > 100


def test_bot_windows_at_events(spark):
    """Only the windows that an event of their client ends in, as they are among all."""
    events = queries._whole(spark, TINY)
    every = bot.bot_features(events, queries.WIDE)
    ends = events.select(*bot.KEYS, aligned(F.col("event_time"), queries.WIDE.bot_slide).alias("window_end")).distinct()
    want = every.join(ends, [*bot.KEYS, "window_end"], "left_semi").select(*every.columns)
    assert sorted(map(str, bot.bot_features(events, queries.WIDE, at_events=True).collect())) == sorted(map(str, want.collect()))
    assert want.count() < every.count()
