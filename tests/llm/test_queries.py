"""The ten queries against brute force on whole small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL, TINY
from tests.llm import brute
from tidegauge.llm.license_scan import TEMPLATES, licence_texts, scan_licenses
from tidegauge.llm.queries import QUERIES


def rows(name: str, sf: str = SMALL) -> list[dict]:
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def run(spark, name: str, sf: str = SMALL) -> list[dict]:
    return [r.asDict(recursive=True) for r in QUERIES[name](spark, sf).collect()]


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in rows("documents")}


def test_op1(spark, texts):
    got = run(spark, "op1_sharding")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    slots = defaultdict(list)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, brute.crc(data), "key")
        assert (r["shard"], r["grown_shard"]) == (brute.jump(r["doc_id"], 16), brute.jump(r["doc_id"], 17))
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op4(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding(), library.no_truncation()
    got = {r["doc_id"]: r for r in run(spark, "op4_bpe_codec")}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_op6_and_op7(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    files = {r["doc_id"]: r for r in run(spark, "op6_token_files")}
    counts = {r["doc_id"]: r for r in run(spark, "op7_token_counts")}
    start = 0
    assert files.keys() == counts.keys() == texts.keys()
    for d in sorted(texts):
        ids = library.encode(texts[d], add_special_tokens=False).ids
        assert (counts[d]["n_bytes"], counts[d]["n_tokens"], counts[d]["over_limit"]) == (len(texts[d].encode()), len(ids), len(ids) > 512)
        ids.append(0)
        assert (files[d]["start"], files[d]["n_tokens"], files[d]["ids_crc32"]) == (start, len(ids), brute.crc(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5(spark, texts):
    want = brute.near_duplicates(list(texts.items()))
    got = {r["doc_id"]: r for r in run(spark, "op5_near_dedup")}
    assert got.keys() == want.keys()
    for d, (n, component) in want.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, component, d == component), d


def test_op8(spark, texts):
    quality = {r["doc_id"]: r["quality"] and not r["toxic"] for r in rows("labels")}
    right = Counter()
    got = run(spark, "op8_quality_rules")
    scores = brute.ratio_scores(texts, {d for d, good in quality.items() if good})
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        want = brute.base_rules(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        assert r["score"] == (None if scores[r["doc_id"]] is None else pytest.approx(scores[r["doc_id"]], abs=1e-9)), r["doc_id"]
        assert r["kept"] == (not r["base_failed"] and r["score"] is not None and r["score"] >= -0.3)
        if r["doc_id"] in quality and not r["base_failed"]:
            right[bool(quality[r["doc_id"]]), r["kept"]] += 1
    assert right[True, True] >= 0.97 * (right[True, True] + right[True, False]), right


def test_op3(spark):
    docs, items = rows("documents", TINY), rows("benchmark", TINY)
    want = brute.leaks([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in run(spark, "op3_decontamination", TINY)}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} and got


def test_op9(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op9_substring_dedup")}
    want = brute.substrings(list(texts.items()))
    assert got.keys() == want.keys()
    for d, (text, cuts) in want.items():
        assert (got[d]["text"], [tuple(c.values()) for c in got[d]["removed"]], got[d]["n_removed"]) == (text, cuts, len(cuts)), d


def licence_rows(files):
    """{id: (licence, origin)} of files (id, path, text)."""
    of_notice, of_file = brute.licence_scorer(TEMPLATES), brute.licence_scorer(licence_texts())
    own = {i: brute.own_licence(text, of_notice, of_file) for i, _, text in files}
    votes = defaultdict(Counter)
    for i, path, _ in files:
        if own[i] and own[i][1]:
            votes[path.rpartition("/")[0]][own[i][0]] += 1
    out = {}
    for i, path, _ in files:
        if own[i]:
            out[i] = (own[i][0], "license_file" if own[i][1] else "header")
            continue
        above = path.rpartition("/")[0]
        while above and above not in votes:
            above = above.rpartition("/")[0]
        named = min(votes[above].items(), key=lambda x: (-x[1], x[0]))[0] if above in votes else None
        out[i] = (named, "inherited" if named else "none")
    return out


def test_op10(spark):
    docs = rows("documents", TINY)
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in run(spark, "op10_license_scan", TINY)}
    want = licence_rows([(r["doc_id"], f"{r['source']}/{r['lang']}/{r['doc_id']}", r["text"]) for r in docs])
    assert got == want
    assert any(o == "header" for _, o in want.values())


GPL3 = """# frobnicate -- turns knobs
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.

""" + "def turn(knob, by):\n    return knob.angle + by\n\n" * 20
APACHE = """/*
 * Copyright 2020 The Knob Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
""" + "int turn(int knob, int by) {\n    return knob + by;\n}\n" * 20


def test_op10_files(spark):
    """Licence files, wrapped headers, ties and inheritance over several directories."""
    plain = "Knobs turn by angles, and angles add up to a whole turn. " * 30
    texts = dict(licence_texts())
    files = [(i, f"lic/{name}/LICENSE", "Copyright (c) 2019 Ann Author\n\n" + text) for i, (name, text) in enumerate(texts.items())]
    files += [(100 + i, f"lic/{name}/a/b/c.txt", plain) for i, name in enumerate(texts)]
    files += [(200, "src/gpl.py", GPL3), (201, "src/apache.c", APACHE), (202, "src/x/none.txt", plain), (203, "top.txt", plain)]
    files += [(204, "tie/LICENSE.a", texts["MIT"]), (205, "tie/LICENSE.b", texts["ISC"]), (206, "tie/deep/er/file", plain), (207, "tie/deep/LICENSE", texts["Zlib"])]
    files += [(208, "tie", plain), (209, "tiers/file", plain), (210, "wrapped/LICENSE", re.sub(r"\s+", "\n", texts["BSD-3-Clause"]))]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {i: (r.license, r.origin) for i, r in got.items()} == licence_rows(files)
    for i, name in enumerate(texts):
        assert (got[i].license, got[i].origin) == (name, "license_file")
        assert (got[100 + i].license, got[100 + i].inherited_from) == (name, f"lic/{name}")
    assert [(got[i].license, got[i].origin) for i in (200, 201, 202, 203)] == [("GPL-3.0", "header"), ("Apache-2.0", "header"), (None, "none"), (None, "none")]
    assert (got[206].license, got[206].inherited_from) == ("Zlib", "tie/deep") and got[208].license is None and got[209].license is None
    assert got[210].license == "BSD-3-Clause"
    twice = scan_licenses(spark.createDataFrame([(1, "a", "Released under the MIT License.\n" + "many other words " * 3)] * 2, "doc_id long, path string, text string"))
    assert [(r.license, r.origin) for r in twice.collect()] == [("MIT", "header")] * 2


def test_op2(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r for r in rows("documents", SMALL)}
    labels = {r["doc_id"]: r for r in rows("labels", SMALL)}
    ids = {d: library.encode(r["text"] or "", add_special_tokens=False).ids for d, r in docs.items()}
    trusted = {d: ids[d] for d, r in labels.items() if r["quality"] == 1 and not r["toxic"] and d in ids}
    want = brute.kneser_ney(trusted, ids, library.get_vocab_size())
    got = {r["doc_id"]: r for r in run(spark, "op2_quality_lm")}
    assert got.keys() == docs.keys()
    for d, log_ppl in want.items():
        assert np.log(got[d]["perplexity"]) == pytest.approx(log_ppl, rel=1e-9), d
    right = Counter((bool(r["quality"] == 1 and not r["toxic"]), got[d]["kept"]) for d, r in labels.items())
    print(right)
    assert right[True, True] >= 0.98 * (right[True, True] + right[True, False]), right
    assert right[False, False] >= 0.5 * (right[False, True] + right[False, False]), right
