"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tidegauge.llm import bpe_codec, tables
from tests.llm import brute
from tidegauge.llm.bpe_codec import decode, encode
from tidegauge.llm.decontaminate import decontaminate, find_leaks
from tidegauge.llm.license_scan import document_paths, scan_licenses
from tidegauge.llm.near_dedup import drop_near_duplicates, near_duplicates
from tidegauge.llm.quality_lm import classify, drop_low_quality
from tidegauge.llm.quality_rules import quality_rules
from tidegauge.llm.sharding import assign_shards
from tidegauge.llm.substring_dedup import dedup_substrings, substring_duplicates
from tidegauge.llm.tables import tokenizer_path
from tidegauge.llm.token_counts import count_tokens
from tidegauge.llm.token_files import read_token_files, write_token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["ids", "decoded", "deduped", "removed", "kept", "size", "shard", "slot", "score", "n_words", "component_id", "n_tokens", "spans_", "body"]
CLASHING += ["_id", "_of", "_body", "_spans", "_deduped", "_removed", *(f"_{x}" for x in "twlhspkg"), "t_", "k_", "leak_", "kept_id_"]
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n)) + "."


ITEM = prose(40)
LONG = prose(60_000)
SHARED = prose(70)
ROWS = [
    (1, prose(120), "en", "s", 1),
    (2, None, "en", "s", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "de", "s", 4),
    (5, LONG, "en", "hot", 1),
    (6, LONG + " " + prose(5), "en", "hot", 1),
    (7, "one two", None, "hot", 7),
    (8, "ONE  two", "fr", None, 8),
    (None, prose(80), "en", "s", 1),
    (None, None, None, None, None),
    (9, "Released under the MIT License", "en", "hot", 1),
    (10, prose(30) + " " + ITEM + " " + prose(30), "en", "s", 1),
    (11, SHARED + " " + prose(40), "en", "s", 1),
    (12, prose(40) + " " + SHARED, "en", "s", 1),
    (13, "é" * 30_000 + " <|endoftext|> 'll 　x", "zz", "s", 1),
    (1, None, "en", "s", 1),
    (14, "x", "en", "s", 1),
    (14, "x", "en", "s", 1),
]
LABELS = [(1, 1, 0), (5, 1, 0), (10, 1, None), (11, 0, 1), (None, 1, 0), (12, None, None), (1, 1, 0)]
BENCH = [(1, ITEM), (2, None), (3, ""), (None, prose(20)), (4, "one two"), (5, ITEM)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHING:
        df = df.selectExpr("*", f"'mine' AS {c}")
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


BYTE, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def test_sharding(docs, empty):
    got = assign_shards(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert {r.text_crc32 for r in got if r.doc_id in (2, 3)} == {0}
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert assign_shards(empty).collect() == []


def test_codec(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    got = decode(encode(docs, WORDS), WORDS)
    assert got.columns == [c for c in docs.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    for r in got.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert decode(encode(empty, WORDS), WORDS).collect() == []


def test_counts_and_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    want = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ROWS)
    assert Counter((r.doc_id, r.n_tokens) for r in count_tokens(docs, BYTE).collect()) == want
    write_token_files(docs, str(tmp_path / "a"), BYTE)
    got = read_token_files(spark, str(tmp_path / "a")).collect()
    assert Counter((r.doc_id, r.n_tokens - 1) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert count_tokens(empty, BYTE).collect() == []
    write_token_files(empty, str(tmp_path / "b"), BYTE)
    assert read_token_files(spark, str(tmp_path / "b")).collect() == []


def test_near_duplicates(docs, empty):
    got = near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    by = {r.doc_id: r for r in got if r.doc_id not in (1, None)}
    assert by[6].component_id == 5 and not by[6].kept and by[8].component_id == 7
    assert all(by[d].n_shingles == 0 and by[d].component_id == d for d in (2, 3, 4))
    assert by[5].n_shingles == len(brute.shingle_set(LONG))
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted({r.doc_id for r in left.collect() if r.doc_id}) == [1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13, 14]
    assert near_duplicates(empty).collect() == []


def test_quality_rules(docs, empty, labels):
    got = quality_rules(docs, labels).collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = brute.base_rules(r.text)
        assert {k: r[k] for k in want} == want
    assert quality_rules(empty, labels).collect() == []
    assert quality_rules(docs, labels.where("doc_id > 99")).count() == len(ROWS)


def test_classifier(docs, empty, labels):
    got = classify(docs, labels, BYTE).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert all(r.kept == bool(r.n_pieces) or r.n_pieces for r in got)
    kept = drop_low_quality(docs, labels, BYTE)
    assert kept.columns == docs.columns and {1, 5} <= {r.doc_id for r in kept.collect()}
    assert classify(empty, labels, BYTE).collect() == []
    assert all(r.kept == (r.n_pieces > 0) for r in classify(docs, labels.where("doc_id > 99"), BYTE).collect())


def test_decontamination(spark, docs, empty, bench):
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert got == {(10, 1), (10, 5), (7, 4), (8, 4)}
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in ROWS if r[0] not in (7, 8, 10))
    assert find_leaks(empty, bench).collect() == []
    assert find_leaks(docs, bench.where("item_id > 99")).collect() == []


def test_substrings(docs, empty):
    got = substring_duplicates(docs)
    assert got.columns == [c for c in docs.columns if c not in ("deduped", "removed")] + ["deduped", "removed"]
    by = {r.doc_id: r for r in got.collect() if r.doc_id not in (1, None)}
    assert by[2].deduped is None and by[3].deduped == "" and by[14].deduped == "x"
    assert by[11].deduped == by[11].text and by[11].removed == []
    assert by[12].removed and all(s.keeper == 11 for s in by[12].removed) and len(brute.words(by[12].deduped)) < 110
    assert len(brute.words(by[6].deduped)) < 60 and by[5].deduped == LONG
    assert dedup_substrings(docs).columns == docs.columns
    assert substring_duplicates(empty).collect() == []


def test_licences(docs, empty):
    got = {r.doc_id: r for r in scan_licenses(document_paths(docs)).collect()}
    assert got[9].license == "MIT" and got[9].origin == "license_file"
    assert got[5].origin == "inherited" and got[5].inherited_from == "hot/en"
    assert got[1].origin == "none" and got[2].license is None
    assert scan_licenses(document_paths(empty)).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, empty, labels, bench, tmp_path, name):
    """Each stage on odd rows and on no rows; all but the last keep the columns of its input."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (plain, empty):
        out = stage(spark, table, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == table.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in table.schema]
        rows = out.collect()
        assert len(rows) <= table.count()


def test_tokens_replace_columns_of_their_names(spark):
    rows = [(1, "the cat", "x", 5, "y"), (2, None, None, None, None), (None, "the cat", "z", 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, N_Tokens int, decoded string")
    found = corpus_pipeline.tokens(spark, docs, "")
    assert found.columns == ["doc_id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].n_tokens == got[None].n_tokens == len(got[1].ids) > 0 and got[2].n_tokens == 0


def test_tokens_need_one_worker(spark):
    """Ids and what they decode to are made in one pass, as by two; columns of their names are replaced."""
    docs = spark.createDataFrame([(1, "One, two\nthree", "x"), (2, None, "y"), (3, "", "z"), (4, "héé 漢字 " * 50, None)], "doc_id long, text string, ids string")
    path = tables.tokenizer_path("word_bpe_49k.json")
    want = bpe_codec.decode(bpe_codec.encode(docs, path), path)
    got = bpe_codec.encode_decode(docs, path)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = corpus_pipeline.tokens(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
