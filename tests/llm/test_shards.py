"""Operator 2's sharded count join: what the shards serve, and that it does not matter which they are."""

import pytest

from tests.conftest import SMALL, TINY
from tidegauge.llm import quality_lm
from tidegauge.llm.quality_lm import perplexities
from tidegauge.llm.tables import table, tokenizer_path


def scores(spark, sf):
    found = perplexities(table(spark, sf, "documents"), table(spark, sf, "labels"), tokenizer_path("byte_bpe_50k.json"))
    return {r.doc_id: r.log_ppl for r in found.collect()}


@pytest.mark.parametrize("heavy", [0, 20, 1 << 40])
def test_shards_and_broadcast_add_up_alike(spark, monkeypatch, heavy):
    """Nothing, a few and all bigrams broadcast."""
    usual = scores(spark, TINY)
    monkeypatch.setattr(quality_lm, "HEAVY", heavy)
    other = scores(spark, TINY)
    assert usual.keys() == other.keys() and any(usual.values())
    for k, v in usual.items():
        assert other[k] == pytest.approx(v, abs=1e-12) if v is not None else other[k] is None


def test_most_bigrams_are_served_by_shards(spark, monkeypatch):
    seen = {}
    real = quality_lm._heavy

    def spy(model, least):
        count = lambda parts: sum(len(quality_lm._unpack(x)[1]) for x in parts)
        picked = real(model, least)
        seen["broadcast"], seen["all"] = count(picked), count([bytes(r.data) for r in model.collect()])
        return picked

    monkeypatch.setattr(quality_lm, "_heavy", spy)
    assert scores(spark, SMALL)
    assert 0 < seen["broadcast"] < 0.1 * seen["all"] and seen["broadcast"] <= 4 * quality_lm.HEAVY
