"""Pairs of which an earlier shared node branched are compared below later roots."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tidegauge.llm import near_dedup


def test_skip_of_earlier_roots():
    """Only an earlier shared node that did not branch settles a pair."""
    same = np.ones((2, near_dedup.FUNCTIONS), dtype=np.uint8)
    trail = np.arange(2 * len(near_dedup.ROOTS), dtype=np.uint32).reshape(2, -1)
    trail[:, 3] = 7
    block = {"rep": np.array([1, 2]), "comp": np.array([1, 2]), "n": np.array([9, 9]), "left": np.array([True, True]), "prints": same, "trail": trail}
    for branched, found in ((0, 0), (1 << 3, 1), (1 << 2, 0)):
        assert len(list(near_dedup._pairs(block | {"branched": np.array([branched, branched])}, 5))) == found


def test_branched_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "WORK", 0)
    monkeypatch.setattr(near_dedup, "LEVELS", 1)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    rows = []
    for family in range(10):
        base = [word() for _ in range(210)]
        # eight documents of pairwise similarity 0.746, the last two of 0.768
        for k in range(8):
            w = list(base)
            for p in (8 + 8 * k, 80 + 8 * k, 144 + 8 * k if k < 7 else 146 + 8 * 6):
                w[p] = word()
            rows.append((family * 8 + k, " ".join(w)))
    want = brute.near_duplicates(rows)
    assert sum(c != d for d, (_, c) in want.items()) == 10
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_repeated_ids(spark):
    """Of one id with two texts, each text is linked on its own."""
    rng = random.Random(2)
    a, b = (["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)] for _ in range(2))
    near = [*b[:98], "other", "end"]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, " ".join(near)), (9, " ".join(a)), (9, " ".join(a)), (None, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 3, False), (3, 3, True), (9, 5, False), (9, 5, False), (None, None, True)], key=str)
    left = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs).collect()), key=str)
    assert left == sorted([rows[0], rows[2], rows[5]], key=str)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.75 exactly, of which none may be missed, and of 0.749, of which none counts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    rows = []
    for k in range(1000):
        base = [word() for _ in range(67)]
        cut = 9 if k % 2 else 10  # of 63 shingles, 54 or 53 stay in common
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-cut], *(word() for _ in range(cut))]))]
    want = brute.near_duplicates(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(c != d for d, (_, c) in want.items()) == 500
    assert got == {d: c for d, (_, c) in want.items()}


def test_a_large_node_has_several_leaders(spark):
    """200 members of equal weight in all nodes: if one of them alone led, and had nothing in common with
    the others, no first round would link them."""
    members = spark.range(200).selectExpr("id AS rep").crossJoin(spark.range(8).selectExpr("id AS node")).selectExpr("node", "rep", "200L AS size")
    found = near_dedup._with_leaders(members).collect()
    by = {}
    for r in found:
        by.setdefault(r.rep, set()).add(r.leader)
    leaders = set.union(*by.values())
    assert len(leaders) == near_dedup.LEADERS and all(v == leaders - {rep} for rep, v in by.items()) and len(by) == 200


def test_copies_for_blocks_are_few(spark):
    """Of a node of 2,000 members of which 900 are linked with nothing, and the same of 4,000: rows of blocks."""
    prints = spark.range(4000).selectExpr("id AS rep", "9L AS n", "X'00' AS prints", "X'00' AS trail", "0L AS branched")
    for size, minor in ((2000, 900), (4000, 450)):
        members = spark.range(size).selectExpr("1L AS node", "id AS rep", f"if(id < {minor}, id, 3999L) AS comp", f"{size}L AS size", "3999L AS main", f"{minor}L AS minor")
        dealt = near_dedup._dealt(members, prints).groupBy("i", "j").agg(F.count("*").alias("n"), F.count_if("left").alias("left")).collect()
        assert sum(r.n for r in dealt) <= 3 * size
        # all pairs of one that has no link with another one, each in one block
        assert sum(r.left * (r.n - r.left) if r.n > r.left else r.n * (r.n - 1) // 2 for r in dealt) == minor * (size - minor) + minor * (minor - 1) // 2


def test_one_set_with_several():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(200)]
    for x in sets[:20]:
        assert near_dedup._enough_of(x, sets).tolist() == [near_dedup._enough(x, y) for y in sets]
    assert near_dedup._enough_of(sets[0], []).tolist() == []


def test_full_sets_are_shuffled_once(spark, monkeypatch):
    """Also where the join with the wanted representatives is no broadcast; only sets of a pair's own side are taken."""
    source = spark.createDataFrame([(d, d, f"one two three four five six {d}") for d in range(20)], "doc_id long, body long, text string")
    signed = source.mapInArrow(near_dedup._signatures, "doc_id long, body long, n long, h1 long, h2 long, tokens binary")
    reps = near_dedup.stored(signed.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("least"), "n", "h1", "h2"))
    kept = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: df if name == "sets" else kept(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = near_dedup._sets(source, reps, reps.select("rep").where("rep < 9"))
        plan = sets._jdf.queryExecution().executedPlan().toString()
        got = sets.select("rep", F.length("members").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, got)) == [(d, 24) for d in range(9)]
    assert plan.count("Exchange hashpartitioning(n#") == 2 and "hashpartitioning(rep#" not in plan  # before, sets were dealt again by rep
    assert near_dedup._of(sets, spark.createDataFrame([(3,), (3,), (5,)], "rep long")).count() == 2
