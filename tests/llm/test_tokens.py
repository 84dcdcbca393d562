"""Encoding of every character and of long pre-tokens, and reading of single documents."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm.bpe import LONG, Encoder, vocabulary
from tidegauge.llm.token_files import read_documents, read_token_files, write_token_files

POINTS = [c for c in [*range(0x80, 0x32000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def coders(request):
    path = public_tokenizers.path(request.param)
    return Encoder(vocabulary(path)), Tokenizer.from_file(path)


def differing(coders, texts: list[str]) -> list[str]:
    encoder, library = coders
    out = []
    for i in range(0, len(texts), 2000):
        part = texts[i : i + 2000]
        got = encoder.encode(part)
        ids, ends = got.ids(), np.cumsum(got.per_doc())
        for text, end, n, want in zip(part, ends, got.per_doc(), library.encode_batch(part, add_special_tokens=False)):
            if ids[end - n : end].tolist() != want.ids:
                out.append(text)
    return out


def test_every_character(coders):
    assert not differing(coders, [f"a{chr(c)}1{chr(c)}!" for c in POINTS])


def test_random_texts(coders):
    rng = random.Random(5)
    draw = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.choice(POINTS), 0x20, 0x27, 0x0A])
    assert not differing(coders, ["".join(chr(draw()) for _ in range(rng.randrange(1, 60))) for _ in range(5000)])


def test_long_pre_tokens(coders):
    rng = random.Random(6)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(200_000))
    assert not differing(coders, [letters, "a" * 50_001, "ab" * LONG + "'s " + "é" * LONG, "中" * LONG, *(letters[:n] for n in range(LONG - 2, LONG + 3))])


def test_a_million_letters():
    text = "".join(random.Random(7).choice("etaoinshrdlu") for _ in range(1_000_000))
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert Encoder(vocabulary(path)).encode([text]).ids().tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_single_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 50)) for i in range(3000)] + [(None, "no id"), (7, "again")], "doc_id long, text string").repartition(4)
    path = str(tmp_path / "files")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    every = [r for r in read_token_files(spark, path).collect() if r.doc_id in (7, 1234)]
    some = read_documents(spark, path, [7, 1234, 99_999])
    assert sorted(some.collect()) == sorted(every) and len(every) == 3
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "first_id" in plan and "last_id" in plan
    assert not read_documents(spark, path, []).collect()
    many = read_documents(spark, path, [None, *range(5000), 7, None, -(1 << 62)])
    want = {r.doc_id: r.n_tokens for r in read_token_files(spark, path).where("doc_id between 0 and 4999").collect()}
    assert {r.doc_id: r.n_tokens for r in many.collect()} == want
