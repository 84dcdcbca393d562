"""Operator 13 against each row at each step, on odd rows."""

import re
from itertools import permutations

from tidegauge.llm.filter_audit import audit, failure_masks

DOCS = "doc_id long, text string, source string, good string, mask int"
GOOD = " ".join(f"w{i}" for i in range(210))


def brute(docs, labels):
    fails = []
    for i, text, part, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)
        conditions = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), earlier)
        mine = [x for x in labels if i is not None and x[0] == i]
        fails.append((part or "", {f for f, c in zip("ABCDE", conditions) if c}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, {}
    for part in {p for p, *_ in fails}:
        for order in permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                alone = sum(x[0] == part and x[1] == {f} for x in fails)
                out[part, "".join(order), step] = (len(left), len(hit), sum(f in x[1] for x in gone), alone, sum(x[2] for x in hit), sum(x[3] for x in hit))
                gone += hit
                shapley[part, f] = shapley.get((part, f), 0) + len(hit)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows(spark, docs, labels):
    found = audit(failure_masks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    return {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()}


def test_audit_of_odd_rows(spark):
    texts = [None, "", " \t", "A", GOOD, GOOD + " #", "W" + GOOD, "A B " * 150, "a " * 500, "é x " * 400, "\x0b".join(f"W{i}" for i in range(250)), "x" * 200_000]
    docs = [(i, t, s, None, 0) for i, (t, s) in enumerate((t, s) for t in texts for s in (None, "", "a"))]
    docs += [(4, GOOD, "a", "x", 1)] * 3 + [(None, GOOD, "a", None, None), (None, "a", "b", None, None)] + [(900 + i, "A #", "b", None, 0) for i in range(40)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 30)] + [(4, 1, 1), (4, 0, 0), (900, None, 1), (901, 2, None), (None, 1, 1), (10_000, 1, 1)]
    labels = [(a, b, c if c is None else int(c)) for a, b, c in labels]
    assert rows(spark, docs, labels) == brute(docs, labels)


def test_audit_of_nothing(spark):
    assert rows(spark, [], []) == {}
    assert len(rows(spark, [(1, GOOD, "a", None, 0)], [])) == 600
