"""Operator 3: benchmark decontamination, in DataFrame functions only.

A benchmark item of m words is looked for in windows of m words, whatever the order of its parts.  Each
window and each item gets a 64-bit SimHash of its words.  The fingerprints are cut into BLOCKS blocks; two
fingerprints within RADIUS bits of each other agree in some block up to RADIUS // BLOCKS bits, so the
items' blocks with all such changes, joined by equality, find every pair within the radius.  These
pairs are the candidates, and the exact weighted similarity of their five-word shingles verifies them.

Windows begin at every word, except where they cannot be similar to any item of their size: a window of
weighted similarity 0.75 has at least three quarters of the item's shingles, so places at which fewer
of all items' shingles begin are left out.  What can be lost is a window of similarity 0.75 that is more
than RADIUS bits away; ``tests/llm/test_windows.py`` measures that on altered and cut items.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, hot_rows, join_groups, stored
from .tables import table

#: Five-word shingles; weighted Jaccard similarity of at least 75 / 100.
WIDTH, ABOVE, OF = 5, 75, 100
#: Fingerprints of 8 blocks of 8 bits, compared within 23 bits: up to two changed bits in some block.
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
#: Values (of 8 bytes about) that are broadcast at most; beyond, the same joins shuffle.
BROADCAST_VALUES = 8_000_000

_BLANKS = "\t\n\x0b\f\r"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), _BLANKS, " " * len(_BLANKS)), " "), "")


def _gram(words: str, i: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(width)))


def _runs(words: str, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))), lambda i: _gram(words, i, width))


def _shingles(words: str, width: int = WIDTH) -> Column:
    """Hashes of the runs of ``width`` words; of fewer words, the whole sequence is one."""
    n = F.size(words)
    out = F.when(n >= width, _runs(words, width))
    for short in range(1, width):
        out = out.when(n == short, F.array(_gram(words, F.lit(0), short)))
    return out.otherwise(F.array().cast("array<bigint>"))


def _simhash(words: str) -> Column:
    """Bit b is set if most of the words' hashes have it set."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bit = lambda b: F.when(2 * F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int")) > F.size(words), F.lit(1)).otherwise(F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", bit(b).cast("long"), b)))


def _blocks(print_: Column) -> Column:
    """(number, value) of each block of a fingerprint."""
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(print_, k * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("value")) for k in range(BLOCKS)))


def _changes() -> list[int]:
    """All masks that change up to RADIUS // BLOCKS bits of a block."""
    return [sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), r)]


def _side(df: DataFrame, values: int) -> DataFrame:
    """A join side as a broadcast if its rows, of so many values each, are within BROADCAST_VALUES."""
    return F.broadcast(df) if df.count() * values <= BROADCAST_VALUES else df


def _first_block(x: Column) -> Column:
    """The first block of a difference of fingerprints with no more than RADIUS // BLOCKS bits."""
    near = [F.bit_count(F.shiftrightunsigned(x, k * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)) <= RADIUS // BLOCKS for k in range(BLOCKS)]
    return F.array_position(F.array(*near), F.lit(True)) - 1


def _common(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays of shingles with their counts."""
    both = F.array_intersect(a, b)
    counted = F.aggregate(both, F.lit(0), lambda total, s: total + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))))
    return F.when((F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b)), F.size(both)).otherwise(counted)


def _starts(positions: Column, m: Column) -> Column:
    """Starts of the windows of m words in which enough of the (sorted) positions lie.

    Windows of which positions[i] is the first inside begin after positions[i - 1], and late enough for
    the last that is needed to begin in them.
    """
    width = F.least(m, F.lit(WIDTH))
    need = F.ceil((m - width + 1) * ABOVE / OF).cast("int")
    last = F.size(positions) - need
    low = lambda i: F.greatest(F.coalesce(F.get(positions, i - 1) + 1, -m), F.get(positions, i + need - 1) - (m - width))
    inside = lambda i: F.when(low(i) <= F.get(positions, i), F.sequence(low(i), F.get(positions, i))).otherwise(F.array().cast("array<int>"))
    return F.when(last >= 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), inside)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Benchmark items found in documents: ``id_col``, item_id, start_word, n_words and similarity of
    the most similar window of each document and item (the first of equals).

    Words are runs of other characters than white space, lower-cased.  At a document's borders a
    window is what the document has of it.  The whole texts are read twice: once for the shingles,
    of which only the places of those in common with an item go on, and once for the documents that
    have any.  Equal windows are compared once.  An item that a third of all documents hold is so
    many rows of (document, start), never pairs of documents; its windows meet the result by broadcast.

    A null or empty text or item matches nothing; a very long text is many windows.  Rows of one id
    count as one document, equal rows as one row.  Items of equal text are found each; of equal
    windows of one item the first counts.  A null id is ignored; other columns are ignored too.  No
    documents or no items: an empty result.
    """
    items = benchmark.select("item_id", _words(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    items = stored(items.select("item_id", F.size("iw").alias("m"), _shingles("iw").alias("ig"), _simhash("iw").alias("ip")), "items")
    grams_of = items.select("m", F.least("m", F.lit(WIDTH)).alias("width"), F.explode("ig").alias("gram")).distinct()
    grams_of = _side(grams_of, 3)

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    split = source.select("doc_id", _words(F.col("text")).alias("w"))
    widths = [r.width for r in items.select(F.least("m", F.lit(WIDTH)).alias("width")).distinct().collect()]  # at most WIDTH rows
    hits = split.select("doc_id", F.lit(0).alias("m"), F.lit(0).alias("pos")).limit(0)
    for width in sorted(widths, reverse=True):
        grams = split.where(F.size("w") >= width).select("doc_id", F.posexplode(_runs("w", width)).alias("pos", "gram"))
        hits = hits.union(grams.join(grams_of.where(F.col("width") == width), "gram").select("doc_id", "m", "pos"))
    places = hits.groupBy("doc_id", "m").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    laid = stored(places.select("doc_id", "m", _starts(F.col("positions"), F.col("m")).alias("starts")).where(F.size("starts") > 0), "starts")
    texts = source.join(_side(laid.select("doc_id").distinct(), 4), "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("body")).agg(F.any_value("text").alias("text"))
    begin = F.greatest("start", F.lit(0))
    windows = texts.select("doc_id", _words(F.col("text")).alias("w")).join(laid, "doc_id").select("doc_id", "w", "m", F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "start", "m", F.slice("w", begin + 1, F.greatest(F.least(F.col("start") + F.col("m"), F.size("w")) - begin, F.lit(0))).alias("win")).where(F.size("win") > 0)
    keys = ["key", "check", "m"]
    windows = stored(windows.select("doc_id", "start", "m", "win", F.xxhash64("win", "m").alias("key"), F.hash("win").alias("check")), "windows")
    distinct = windows.groupBy(*keys).agg(F.any_value("win").alias("win"), (F.count("*") > hot_rows(windows)).alias("hot"))
    distinct = distinct.select(*keys, "hot", _shingles("win").alias("wg"), _simhash("win").alias("wp"))

    changed = F.transform(_blocks(F.col("ip")), lambda b: F.transform(F.array(*map(F.lit, _changes())), lambda c: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(c).alias("value"))))
    near_items = _side(items.select("item_id", "m", "ip", F.explode(F.flatten(changed)).alias("at")).select("item_id", "m", "ip", "at.block", "at.value"), 5)
    probes = distinct.withColumn("at", F.explode(_blocks(F.col("wp")))).select(*keys, "hot", "wg", "wp", "at.block", "at.value")
    apart = F.col("wp").bitwiseXOR(F.col("ip"))
    candidates = probes.join(near_items, ["block", "value", "m"]).where((F.bit_count(apart) <= RADIUS) & (_first_block(apart) == F.col("block")))
    grams = items.select(F.col("item_id").alias("own_id"), F.col("m").alias("own_m"), F.col("ip").alias("own_ip"), "ig")
    longest = items.agg(F.max("m")).first()[0] or 0
    grams = _side(grams, 4 + longest)
    pairs = candidates.join(grams, F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("m") == F.col("own_m")) & (F.col("ip") == F.col("own_ip")))
    scored = pairs.select(*keys, "hot", "item_id", _common(F.col("wg"), F.col("ig")).alias("common"), (F.size("wg") + F.size("ig")).alias("both"))
    verified = scored.where(F.col("common") * OF >= ABOVE * (F.col("both") - F.col("common")))
    verified = stored(verified.select(*keys, "hot", "item_id", (F.col("common") / (F.col("both") - F.col("common"))).alias("similarity")), "verified")

    matched = join_groups(windows.select("doc_id", "start", *keys), verified, keys)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "m"))
    out = matched.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select(F.col("doc_id").alias(id_col), "item_id", F.greatest(-F.col("b.s"), F.lit(0)).alias("start_word"), F.col("b.m").alias("n_words"), F.round("b.similarity", 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose texts no benchmark item is found.

    Rows with a null id are looked at too, and of rows with one id each by its own text.  All columns
    are kept, whatever their names.
    """
    id_, body = free_name(docs, "id"), free_name(docs, "body")
    named = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body")).alias("doc"), F.col(text_col).alias("text"))
    leaks = find_leaks(named, benchmark, "doc", "text").select(F.col("doc.id").alias(id_), F.col("doc.body").alias(body)).distinct()
    leaks = _side(stored(leaks, "leaks"), 4)
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks[id_]) & (F.xxhash64(docs[text_col]) == leaks[body]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same over all windows at any distance of fingerprints, for items of five words or more.
OP3_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
),
items AS (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark
),
item_grams AS (
    SELECT item_id, m, g, count(*) AS n FROM (SELECT item_id, len(w) AS m, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM items) GROUP BY item_id, m, g
),
grams AS (
    SELECT doc_id, len(w) AS n_words, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM texts
),
inside AS (
    SELECT doc_id, n_words, item_id, m, g, n, unnest(range(pos - m + 5, pos + 1)) AS start FROM grams JOIN item_grams USING (g)
),
counted AS (
    SELECT doc_id, n_words, item_id, m, start, least(count(*), n) AS held FROM inside GROUP BY doc_id, n_words, item_id, m, g, n, start
),
windows AS (
    SELECT doc_id, item_id, m, start, sum(held)::BIGINT AS common, m - 4 + greatest(least(start + m, n_words) - greatest(start, 0) - 4, 1) AS total
    FROM counted GROUP BY doc_id, n_words, item_id, m, start
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / (total - common) DESC, start) AS place FROM windows WHERE 100 * common >= 75 * (total - common)
)
SELECT doc_id, item_id, greatest(start, 0)::INTEGER AS start_word, m::INTEGER AS n_words, round(common / (total - common), 6) AS similarity FROM ranked WHERE place = 1
"""
