"""Operator 8: quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The ratio compares two multinomials over hashed unigrams and bigrams: that of trusted documents and
that of the whole raw corpus (as in importance resampling; Xie et al., 2023).  A document's score is
the mean log ratio of its n-grams; each document is kept or not by its own score alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name
from .tables import table

#: Hash buckets of the multinomials and the count added to each.
BUCKETS, SMOOTHING = 10_000, 1.0
#: Scores are summed as integers of this fraction of a nat, so that no order of adding matters.
SCALE = 10_000
#: A document is kept from this mean log ratio on.
LEAST_SCORE = -0.3
#: Trusted labelled documents that the target is fitted on at most; their ids are broadcast.
TRUSTED_DOCS = 1_000_000

_BLANK = r"[\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"
_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are runs of other characters than white space (0x20, 0x09-0x0D). Equal three-word windows
    are found by 64-bit hash. A null text counts as empty.
    """
    names = docs.columns
    t, w, found_lines, hashes, sorted_hashes, places = (free_name(docs, x) for x in ("t", "w", "l", "h", "s", "p"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn(t, text).withColumn(w, F.array_remove(F.split(t, _BLANK + "+"), ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        *names,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias(found_lines),
        windows.alias(hashes),
    )
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    sorted_ = F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ranked = counted.select(*names, "n_words", "word_chars", "n_symbols", (F.size(found_lines) - F.size(F.array_distinct(found_lines))).cast("long").alias("n_dup_lines"), sorted_.alias(sorted_hashes))
    twice = F.transform(sorted_hashes, lambda x, k: F.when((F.get(sorted_hashes, k - 1)["h"] == x["h"]) | (F.get(sorted_hashes, k + 1)["h"] == x["h"]), x["i"]))
    placed = ranked.withColumn(places, F.sort_array(F.filter(twice, lambda i: i.isNotNull()))).drop(sorted_hashes)
    # each window adds three words, less what the next one covers too
    covered = F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    found = placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(places)
    return found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _buckets(text: Column) -> Column:
    """Bucket of each unigram and bigram of a text's tokens (hashes of its words and symbol runs)."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def _grams(tokens: str) -> Column:
    one = F.transform(tokens, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int")))
    return F.concat(one, two)


def fit_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Log ratio of the trusted and the raw multinomial of each bucket, in units of 1 / SCALE.

    The raw counts are over all documents. Trusted are labelled documents of quality 1 that are not
    toxic; if there are more than TRUSTED_DOCS, those of the least id hashes. BUCKETS rows at most
    leave each task and come to the driver.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("good_")).distinct()
    n_good = good.count()
    if n_good > TRUSTED_DOCS:
        good = good.where(F.pmod(F.xxhash64("good_"), F.lit(1 << 32)) < int((1 << 32) * TRUSTED_DOCS / n_good))
    marked = docs.select(F.col(id_col).alias("id_"), _buckets(F.col(text_col)).alias("k_")).join(F.broadcast(good.withColumn("trusted_", F.lit(1))), F.col("id_") == F.col("good_"), "left")
    grams = marked.select(F.coalesce("trusted_", F.lit(0)).alias("t"), F.explode(_grams("k_")).alias("b")).where("b is not null")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.b], target[r.b] = r.raw, r.target
    n_raw, n_target = sum(raw) + SMOOTHING * BUCKETS, sum(target) + SMOOTHING * BUCKETS
    return [round(SCALE * (math.log((t + SMOOTHING) / n_target) - math.log((r + SMOOTHING) / n_raw))) for r, t in zip(raw, target)]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The table with the base features, ``score`` (mean log ratio; null without a token) and ``kept``.

    ``kept`` is false if the base rules fail or the score is below ``least``.  Two narrow passes over
    the texts; what is shuffled is one row per bucket and task.  A null or empty text has no words
    and fails the base rules.  Repeated rows, null ids and clashing extra columns are kept: columns
    of the new ones' names are replaced.  Without labels the ratio is that of an even target.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    ratio = F.split(F.lit(",".join(map(str, fit_ratio(docs, labels, id_col, text_col)))), ",").cast("array<int>")
    tokens, grams = free_name(docs, "k"), free_name(docs, "g")
    scored = docs.withColumn(tokens, _buckets(F.col(text_col))).withColumn(grams, _grams(tokens)).drop(tokens)
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(F.get(ratio, b), F.lit(0)))
    n = F.size(grams) - 1  # the last token begins no bigram; its place holds a null
    scored = scored.withColumn("score", F.when(n > 0, total / n / SCALE)).drop(grams)
    found = base_features(scored, text_col)
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= least, F.lit(False)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
