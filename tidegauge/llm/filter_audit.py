"""Operator 13: how filters interact, by Walsh-Hadamard sums of their failure masks."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored
from .tables import table

_GAPS = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Failures of filters A to D on a text that is not null: too short, too repetitive, too many
    capitals, symbols."""
    words = F.array_remove(F.split(text, _GAPS), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask) of each row of ``docs``: bit i of the mask is a failure of filter i of
    FILTERS.

    E fails for a row whose text a row of a smaller id has.  Ids and digests only are shuffled; the
    first id of each text comes from a minimum that combines before the shuffle, and a row is looked
    up by its id and digest together, so that no copy group of any size meets in one task.  Both
    looked-up tables are written before, so that Spark can split a side of one hot id.

    A null text is the empty text, a null source the part ''.  A row without an id has no label, is no
    one's earlier copy and never fails E; rows of equal id and text all pass E if it is the least.  An
    id with several labels is good or toxic if one of them says so; labels without an id are ignored.
    Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    failed = text_failures(F.col("text"))
    bits = [F.when(failed[f], 1 << i).otherwise(0) for i, f in enumerate("ABCD")]
    masks = rows.select("id", "part", "digest", sum(bits[1:], bits[0]).alias("mask"))
    firsts = stored(rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")), "firsts").withColumn("first", F.lit(True))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = stored(labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")), "marks")
    known = masks.where("id is not null").join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    no = F.lit(False)
    later = F.when(F.col("first").isNull(), 16).otherwise(0)
    found = known.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), (F.col("mask") + later).alias("mask"))
    return found.union(masks.where("id is null").select("part", no, no, "mask"))


def _sign(a: Column, b: Column) -> Column:
    """1 or -1: the parity of the bits that two masks share."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(F.lit(1)).cast("long")


def _over(cells: int, term) -> Column:
    """The sum of ``term(mask)`` over all masks."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(cells - 1)), F.lit(0).cast("long"), lambda total, m: total + term(m))


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters, step by step, for each part of rows (part, good, toxic, mask).

    One aggregation gathers 2**k signed parity sums by part and label (one number a sum, combined
    before the shuffle); their inverse transform, which is exact in integers, gives the number of rows
    with each mask.  All orders follow from these cells: a row goes at the first filter that it
    fails.  Over all k! orders each of a row's f failed filters is the first equally often, so a row
    adds k!/f to the ``shapley`` of each of them.  An empty table gives an empty result.
    """
    cells = 1 << len(filters)
    mask = F.col("mask")
    sums = masks.groupBy("part", "good", "toxic").agg(*(F.sum(_sign(mask, F.lit(s))).alias(f"s{s}") for s in range(cells)))
    kinds = F.filter(F.array(F.lit("every"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")), lambda k: k.isNotNull())
    sums = sums.withColumn("kind", F.explode(kinds)).groupBy("part", "kind").agg(F.array(*(F.sum(f"s{s}") for s in range(cells))).alias("sums"))
    inverse = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda m: F.shiftright(_over(cells, lambda s: F.get("sums", s) * _sign(m, s)), len(filters)))
    by_kind = sums.select("part", "kind", inverse.alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), cells)
    parts = by_kind.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("cells"))), none).alias(k) for k in ("every", "good", "toxic")))
    orders = list(permutations(range(len(filters))))
    steps = [(order, i + 1, 1 << f, sum(1 << g for g in order[:i])) for order in orders for i, f in enumerate(order)]
    literal = ", ".join(f"struct('{''.join(filters[f] for f in order)}' AS filter_order, {step} AS step, {bit} AS bit, {before} AS before)" for order, step, bit, before in steps)
    at = parts.withColumn("at", F.explode(F.expr(f"array({literal})"))).select("part", "every", "good", "toxic", "at.*")
    has = lambda m, c: m.bitwiseAND(F.col(c)) != 0
    count = lambda kind, cond: _over(cells, lambda m: F.when(cond(m), F.get(kind, m)).otherwise(0))
    here = lambda m: has(m, "bit") & ~has(m, "before")
    return at.select(
        "part",
        "filter_order",
        "step",
        count("every", lambda m: ~has(m, "bit") & ~has(m, "before")).alias("kept"),
        count("every", here).alias("removed"),
        count("every", lambda m: has(m, "bit") & has(m, "before")).alias("redundant"),
        F.get("every", "bit").alias("unique_fails"),
        count("good", here).alias("good_lost"),
        count("toxic", here).alias("toxic_lost"),
        _over(cells, lambda m: F.when(has(m, "bit"), F.get("every", m) * F.floor(len(orders) / F.bit_count(m))).otherwise(0)).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: Each document at each step of each order.
OP13_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
failed AS (
    SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM texts
),
marked AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM failed LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY part, fails
),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
went AS (
    SELECT *, list_min(list_transform(string_split(fails, ''), lambda f: CASE WHEN f = '' THEN 9 ELSE instr(filter_order, f) END)) AS gone FROM marked, orders
),
steps AS (
    SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS f, sum(CASE WHEN fails = '' OR gone > step THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN fails != '' AND gone = step THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN contains(fails, substr(filter_order, step, 1)) AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails != '' AND gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails != '' AND gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM went, range(1, 6) AS s(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM steps
"""
