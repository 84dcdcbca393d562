"""Operator 12 against counts of all phrases, on odd rows and small shards."""

import random
import re
from collections import Counter

import pytest

from tidegauge.llm import phrases
from tidegauge.llm.phrases import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, longest, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    counts["und" if lang is None else lang, tuple(w[i : i + n])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    found = []
    for (lang, p), a in candidates.items():
        inside = any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for (x, q), b in candidates.items())
        if not inside:
            score, k = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    out = []
    for lang in totals:
        mine = sorted(x for x in found if x[0] == lang)[:top]
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -score) for i, (_, score, a, p, left, right) in enumerate(mine)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "top", "shard"), [(3, 10, 2000, 1 << 20), (3, 2, 7, 300), (4, 3, 50, 2000), (2, 1, 2000, 500)])
def test_collocations(spark, longest, least, top, shard):
    rng = random.Random(least)
    words = ["a", "A", "Ä", "ä", "b\x1c", "ça", "東京", " ", "the", "The", "x" * 40, "\x00", "😀"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\x0b", "!"]) for _ in range(n))
    docs = [(text(rng.randrange(1, 40)), rng.choice([None, "und", "en", "", "fr"])) for _ in range(120)]
    docs += [(None, "en"), ("", "fr"), (" \t.", "xx"), ("a a a a a a", "en"), (text(4000), "en"), ("y" * 100_000, "fr")] + [("the same line here", "en")] * 60
    rng.shuffle(docs)
    table = spark.createDataFrame([(t, x, 1, 2.0) for t, x in docs], "text string, lang string, n long, rank double")
    found = collocations(table, longest, least, top, shard)
    assert sorted(map(tuple, found.collect())) == brute(docs, longest, least, top)


def test_collocations_past_the_sketch(spark, monkeypatch):
    """Where all cells are full all phrases pass, and the result stays the same."""
    monkeypatch.setattr(phrases, "MOST_CELLS", 8)
    docs = [("to be or not to be, that is the question", "en")] * 12 + [("to be sure of it is to be", "en")] * 3
    found = collocations(spark.createDataFrame(docs, "text string, lang string"), 3, 10)
    assert sorted(map(tuple, found.collect())) == brute(docs, 3, 10, 2000)


def test_collocations_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_sketch_is_as_wide_as_the_corpus():
    """Its cells grow with the words at 6 GB and beyond (they ended at 2^27), in pieces of bounded size."""
    for words in (0, 1_000, 136_000_000, 1_610_000_000, 10_000_000_000):
        cells, piece = phrases.sketch_size(words)
        assert cells >= words // phrases.CELL_WORDS and 1 <= piece <= phrases.PIECE_CELLS


def test_sketch_of_many_pieces_stays_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE_CELLS", 100, raising=False)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("what grows with the corpus is broadcast"))
    docs = [(f"to be or not to be, that is question {i}. {i} it is", "en") for i in range(40)] + [("to be sure", None)] * 20
    found = collocations(spark.createDataFrame(docs, "text string, lang string"), 3, 10, shard_bytes=400)
    assert sorted(map(tuple, found.collect())) == brute(docs, 3, 10, 2000)
