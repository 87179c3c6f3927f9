"""What Python workers and their pipes hold at once."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from llm.cases import awkward, wide

from tidemill.llm import packing, quality, tokens, toxicity

MODELS = {
    "quality": (quality, quality.Model(np.zeros((len(quality.MEASURES), quality.BINS - 1)), np.zeros(quality.N_WEIGHTS - 1), 1.0, 0.5)),
    "toxicity": (toxicity, toxicity.Machine(-1.0, np.zeros(1 << toxicity.BITS, np.int32), np.zeros(1), np.zeros((1, toxicity.RANK)))),
}


@pytest.mark.parametrize("stage", MODELS)
def test_kept_sends_only_texts_to_python(spark, stage):
    module, model = MODELS[stage]
    docs = wide(awkward(spark))
    kept = module.kept(docs, model)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    none = (model.__class__)(**{**model.__dict__, "bias": -2 * model.bias})
    assert not module.kept(docs, none).collect()


def test_hashing_keeps_small_tables_and_takes_words_longer_than_them():
    assert sum(x.nbytes for x in tokens._powers()) <= 4 << 20
    long = "x" * ((1 << 17) + 3)
    assert tokens.words_of(pa.array([f"b {long}", f"a {long} b"])).hashes.tolist() == [tokens.hash_text(w) for w in ("b", long, "a", long, "b")]


def test_packing_makes_strings_of_one_slice_at_a_time(monkeypatch):
    got = []
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda run, _: got.append(run))
    docs.select = lambda *_: docs
    monkeypatch.setattr(packing, "ranks_in", lambda _: b"")
    monkeypatch.setattr(packing, "encode", lambda text, _: text[:3])
    packing.lengths(docs)
    batch = pa.record_batch([pa.array(range(10_000)), pa.array([f"{k:02000}" for k in range(9_998)] + [None, ""])], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(got[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.column("doc_id").to_pylist() == list(range(10_000)) and out.column("n_tokens").to_pylist() == [3] * 9_998 + [0, 0]
    assert peak < 8 << 20
