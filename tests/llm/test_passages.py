"""Passages inside longer lines lose all their words, to both ends."""

import random

from pyspark.sql import functions as F

from tests.llm import brute
from tidegauge.llm import shared, substring_dedup
from tidegauge.llm.substring_dedup import substring_duplicates


def test_whole_passages(spark):
    rng = random.Random(9)

    def prose(n: int) -> list[str]:
        return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]

    rows, want = [], {}
    for k in range(240):
        passage, before, after = prose(51 + k % 30), prose(rng.randint(0, 60)), prose(rng.randint(0, 60))
        broken = [w + rng.choice(["", "", "", "\n"]) for w in passage]
        rows.append((k, " ".join(prose(30) + passage + prose(30))))
        rows.append((1000 + k, " ".join(before + broken + after)))
        want[k], want[1000 + k] = rows[-2][1].split(), before + after
    # 2000 has a run of the passage only, 2001 all of it: what 2002 has goes by 2001
    passage = prose(70)
    rows += [(2000, " ".join(prose(40) + passage[20:50] + prose(40))), (2001, " ".join(passage)), (2002, " ".join(["head", *passage, "tail"]))]
    want[2002] = ["head", "tail"]
    got = {r.doc_id: brute.words(r.deduped) for r in substring_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d] for d in want} == want


def test_against_brute_force(spark, monkeypatch):
    """Overlapping, cut, changed and nested passages, common ones (with the broadcast of hot digests), lines."""
    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    rng = random.Random(4)
    prose = lambda n: [rng.choice("aeiou") + "".join(rng.choice("bcdfg") for _ in range(5)) for _ in range(n)]
    sources, rows = [prose(400) for _ in range(6)], []
    for d in range(300):
        words: list[str] = []
        for _ in range(rng.randint(1, 4)):
            source = rng.choice(sources)
            n, a = rng.choice([30, 48, 49, 50, 51, 60, 120]), rng.randrange(280)
            part = source[a : a + n]
            if rng.random() < 0.3:
                part = [*part[: n // 2], "changed", *part[n // 2 :]]
            words += prose(rng.choice([0, 3, 30])) + part
        rows.append((d, "".join(w.upper() + rng.choice([" ", " ", " ", "  ", "\n"]) if rng.random() < 0.1 else w + " " for w in words)))
    rows += [(1000 + k, "the same line of words\n" * 3 + "and a short\n" + " ".join(sources[0][50:150])) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for passages in (True, False):
        want = brute.substrings(rows, passages)
        got = {r.doc_id: (r.deduped, [tuple(x) for x in r.removed]) for r in substring_duplicates(table, passages=passages).collect()}
        assert got == want


def test_neighbours_that_go_alike_are_few_rows(spark):
    """A common passage is a few rows of each document, not one for each word it may begin at; texts that repeat themselves too."""
    rng = random.Random(5)
    prose = lambda n: ["".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(n)]
    common, loop = prose(68), prose(7)
    rows = [(d, " ".join(prose(rng.randint(0, 40)) + common + prose(rng.randint(0, 40)))) for d in range(60)]
    rows += [(100 + d, " ".join(prose(3) + (loop * 40)[: 120 + d] + prose(rng.randint(0, 3)))) for d in range(40)]
    rows += [(200 + d, " ".join(common[d:] + loop * 9 + common[: 68 - d])) for d in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.deduped, [tuple(x) for x in r.removed]) for r in substring_duplicates(table).collect()}
    assert got == brute.substrings(rows, True)
    spans = substring_dedup._spans(table.select("doc_id", F.xxhash64("text").alias("body"), "text"), True)
    assert spans.count() <= 12 * len(rows)  # 986 now, 7,192 before
