"""Stored tables for joins and dashboards: folders by month, in each the rows in buckets of the join keys.

Two tables with as many buckets of the same keys are joined without a shuffle; a range of time reads the
folders of its months only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH = "month"


def month_of(time: Column) -> Column:
    return F.date_format(time, "yyyyMM")


def save_bucketed(rows: DataFrame, name: str, path: str, keys: list[str], time: str, buckets: int) -> DataFrame:
    """Writes rows as the table ``name`` of the session's catalog, at ``path``, and reads it: by month of
    ``time``, in ``buckets`` files for each month at most, sorted by ``keys``.

    Rows are shuffled once, by the keys.  Keys should tell rows apart well (a client and its window, not
    an endpoint alone), as rows of equal keys are in one bucket.
    """
    spark = rows.sparkSession
    out = rows.drop(MONTH).withColumn(MONTH, month_of(F.col(time))).repartition(buckets, *keys)
    out.write.format("parquet").mode("overwrite").partitionBy(MONTH).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def within(rows: DataFrame, time: str, time_range: tuple[str, str] | None) -> DataFrame:
    """Rows from one time to another, both included; of a stored table only the months between are read."""
    if time_range is None:
        return rows
    begin, end = (F.lit(t).cast("timestamp") for t in time_range)
    if MONTH in rows.columns:
        rows = rows.where((F.col(MONTH) >= month_of(begin)) & (F.col(MONTH) <= month_of(end)))
    return rows.where((F.col(time) >= begin) & (F.col(time) <= end))
