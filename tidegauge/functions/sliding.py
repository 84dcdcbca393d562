"""Sliding windows over panes, without a copy of a pane for each window that holds it.

A sum over a window is the difference of two running sums, an extreme one over the few panes of a
window in order.  Rows are made for the windows that come out only.  A key's time is cut into spans of
SPAN window lengths, which are worked on apart, so a key with any share of the rows is no single task;
only panes that reach over a span's end are in two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Window lengths of a span.
SPAN = 32


def spans(panes: DataFrame, length: int, slide: int, pane: str = "pane") -> DataFrame:
    """Panes with the number of each ``span`` that has a window which holds them."""
    at, of = F.unix_seconds(pane), SPAN * length
    return panes.withColumn("span", F.explode(F.sequence(F.floor(at / of), F.floor((at + length - slide) / of))))


def sliding(panes: DataFrame, keys: list[str], length: int, slide: int, sums: list[str] = [], most: list[str] = [], least: list[str] = [], pane: str = "pane") -> DataFrame:
    """(keys, span, window_end, sums, most, least) over (window_end - length, window_end], for every
    end on the grid of ``slide`` seconds whose window holds a pane.

    ``panes`` has one row for each of ``keys``, ``span`` (see ``spans``) and pane, whose times are on
    the grid.  Where it is partitioned by some of the keys and the span already, nothing is shuffled.
    """
    reach, of = length - slide, SPAN * length
    key = [*keys, "span"]
    at, begin = F.col("at"), F.col("span") * of
    timed = panes.withColumn("at", F.unix_seconds(pane))
    following = F.lead("at").over(W.partitionBy(*key).orderBy("at"))
    last = F.least(at + reach, F.coalesce(following - slide, at + reach), begin + of - slide)
    # a pane from before the span has a row of its own too, for the running sums
    first = F.greatest(at, begin)
    grid = F.when(first <= last, F.sequence(first, last, F.lit(slide).cast("long"))).otherwise(F.array().cast("array<long>"))
    ends = F.when(at < begin, F.concat(F.array(at), grid)).otherwise(grid)
    rows = timed.withColumn("ends", ends).select(*key, *sums, *most, *least, F.posexplode("ends").alias("pos", "end"))
    order = W.partitionBy(*key).orderBy("end")
    own = lambda c: F.when(F.col("pos") == 0, F.col(c))

    def total(c: str) -> Column:
        return F.sum(own(c)).over(order.rangeBetween(W.unboundedPreceding, 0)) - F.coalesce(F.sum(own(c)).over(order.rangeBetween(W.unboundedPreceding, -length)), F.lit(0))

    near = order.rangeBetween(-reach, 0)
    found = rows.select(*key, "end", *(total(c).alias(c) for c in sums), *(F.max(own(c)).over(near).alias(c) for c in most), *(F.min(own(c)).over(near).alias(c) for c in least))
    return found.where(F.col("end") >= begin).withColumn("window_end", F.timestamp_seconds("end")).drop("end")
