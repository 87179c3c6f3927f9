import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.cases import awkward, empty, wide

from tidemill.llm import packing, pfor


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), max_size=400), max_size=5))
def test_round_trip(docs):
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    ids = np.array([x for d in docs for x in d], np.uint32)
    data, cut, starts, start_cut = pfor.pack(ids, bounds)
    for k, d in enumerate(docs):
        own = starts[start_cut[k] : start_cut[k + 1]].tolist()
        assert len(own) == -(-len(d) // pfor.BLOCK)
        assert pfor.unpack(data[cut[k] : cut[k + 1]].tobytes(), own).tolist() == d


def test_exceptions_keep_the_width_small():
    ids = np.arange(128, dtype=np.uint32)
    ids[5] = 1 << 30
    data, *_ = pfor.pack(ids, np.array([0, 128]))
    assert data[6] == 7 and data[7] == 1 and len(data) == 8 + 112 + 5


def test_documents(spark):
    docs = wide(awkward(spark))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pfor.encoded(docs).collect()
    assert len(rows) == 17
    for r in rows:
        if r.doc_id is not None:
            want = packing.encode(texts[r.doc_id], packing.ranks_in()).tolist() if texts[r.doc_id] else []
            assert pfor.unpack(bytes(r.payload), r.block_starts).tolist() == want and r.n_tokens == len(want)
    assert pfor.encoded(empty(spark)).collect() == []


def test_any_block_alone():
    ids = np.random.default_rng(0).integers(0, 50_000, 1000).astype(np.uint32)
    data, _, starts, _ = pfor.pack(ids, np.array([0, 1000]))
    assert pfor.unpack_block(data.tobytes(), int(starts[3])).tolist() == ids[384:512].tolist()


def test_many_blocks_at_once_or_in_steps(monkeypatch):
    ids = np.random.default_rng(1).integers(0, 50_000, 9_000).astype(np.uint32)
    whole = pfor.pack(ids, np.array([0, 10, 10, 9_000]))
    monkeypatch.setattr(pfor, "STEP", 7)
    for a, b in zip(whole, pfor.pack(ids, np.array([0, 10, 10, 9_000])), strict=True):
        assert (a == b).all()
