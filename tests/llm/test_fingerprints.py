"""Operator 11 against row-by-row Python, and searches against all pairs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidegauge.llm import fingerprints as fp
from tidegauge.llm.fingerprints import edited_fingerprints, fingerprints, op11_fingerprints, search


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, docs):
    """Rows of the query for documents of different ids, null at most once."""
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) == len(got)
    prints, errors = {}, []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.jaccard_edited == pytest.approx(jaccard(sets(text), sets(edited)))
        assert r.jaccard_next == pytest.approx(jaccard(sets(text), sets(after)))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - r.jaccard_edited, r.near_next - r.jaccard_next]
        for near, exact, same in ((r.near_edited, r.jaccard_edited, edited == text), (r.near_next, r.jaccard_next, after == text)):
            assert 0 <= near <= 1 and (near == 1 or exact < 1) and (near > 0 or exact < 0.1) and (not same or near == 1)
    assert len(set(prints.values())) >= len({frozenset(sets(t)) for t in prints})
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.01


def test_op11_on_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(op11_fingerprints(spark, SMALL).collect(), docs)


def test_odd_rows(spark):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "one", "One two three", "a b c d e", "😀 é" * 30, "x" * 50_000, "word " * 9, " ".join(rng.choice("abcdefg") for _ in range(9000))]
    docs = [(i * 10**15 - 7, rng.choice(texts)) for i in range(60)] + [(None, "no id here at all, sir"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, stop string, part int")
    check(edited_fingerprints(table).collect(), docs)
    check(edited_fingerprints(table.where(f"doc_id = {docs[1][0]}")).collect(), docs[1:2])
    assert edited_fingerprints(table.where("false")).collect() == []


def test_one_id_or_none_for_a_third_of_the_rows(spark):
    rng = random.Random(5)
    docs = [(i, f"text {i} " * rng.randrange(1, 9)) for i in range(300)]
    docs += [(100, f"same id {i}") for i in range(200)] + [(None, f"no id {i}") for i in range(200)] + [(7, "same row")] * 20
    table = spark.createDataFrame(docs, "doc_id long, text string")
    h = {(r.doc_id, r.text): r.h for r in table.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), h[d]))
    want = []
    for k, (i, text) in enumerate(order):
        half = len(text) // 2
        want.append((i, hashlib.sha256((text[: len(text) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()))
    placed, parts = fp._placed(table.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("h")), 8)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) <= parts <= 20 and max(sizes) < 0.25 * len(docs)
    got = [(r.doc_id, r.edited_sha256) for r in edited_fingerprints(table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_search_finds_what_all_pairs_have(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 120))] for _ in range(40)]
    docs = []
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"v{i}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, docs[i][1].upper()) for i in range(50)] + [(2000, ""), (2001, None), (None, docs[0][1]), (3, "again another text of this id")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = table.where("doc_id % 10 = 0")
    prints = {r.doc_id: r.fingerprint for r in fingerprints(table.where("doc_id <> 3")).collect()}
    rep = {}
    for i, _ in docs:
        if i is not None and i != 3 and i < 2000:
            rep[prints[i]] = min(rep.get(prints[i], i), i)
    text = {i: t for i, t in docs if i != 3}
    askers = {}
    for i in text:
        if i is not None and i % 10 == 0 and i < 2000:
            askers[prints[i]] = min(askers.get(prints[i], i), i)
    want = {(q, d) for q in askers.values() for d in rep.values() if jaccard(sets(text[q]), sets(text[d])) >= 0.75}
    got = {(r.query_id, r.id): r.jaccard for r in search(asked, table).where("id <> 3").collect()}
    assert set(got) == want and len(want) > 100
    assert all(j == pytest.approx(jaccard(sets(text[q]), sets(text[d]))) for (q, d), j in got.items())
