"""Similar windows are found wherever they begin: altered, cut and rearranged items."""

import random

import pytest

from tests.llm import brute
from tidegauge.llm.decontaminate import decontaminate, find_leaks


def test_all_window_starts(spark):
    """Against all windows at any distance of fingerprints: of pairs from 0.75 at most 1 in 100 is lost."""
    rng = random.Random(3)
    prose = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    docs, items = [], []
    for k in range(100):
        item = prose(rng.choice([3, 4, 5, 12, 40, 60]))
        items.append((k, " ".join(item)))
        half, few = len(item) // 2, len(item) // 8
        docs.append((5 * k, " ".join(prose(30) + item[: len(item) - few])))  # cut by the end
        docs.append((5 * k + 1, " ".join(item[few:] + prose(30))))
        docs.append((5 * k + 2, " ".join(prose(20) + item[half:] + item[:half] + prose(20))))  # rearranged
        docs.append((5 * k + 3, " ".join(prose(20) + item[:half] + ["new"] + item[half + 1 :] + prose(20))))
        docs.append((5 * k + 4, " ".join(prose(20) + item[:few] + prose(few) + item[few:] + item + prose(9))))
    docs.append((1000, "one two one two one two one two one two"))
    items += [(1000, "one two one two one two one two"), (1001, None), (1002, " "), (1003, items[9][1])]
    want = brute.leaks(docs, items)
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(docs_, items_).collect()}
    assert got == {k: pytest.approx(want[k], abs=1e-6) for k in got}
    print(len(got), len(want), "missed", sorted(want[k] for k in want.keys() - got.keys()))
    assert len(got) >= 0.99 * len(want) > 300


def test_rows_without_an_id(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(None, "before " + item, 1), (None, "clean text", 2), (7, item, 3), (7, "other text", 4), (7, item, 5)], "doc_id long, text string, _id int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r._id for r in left.collect()) == [2, 4]
