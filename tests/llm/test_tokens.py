import numpy as np
import pyarrow as pa

from tidemill.llm.tokens import hash_text, slices, words_of


def test_words_and_bounds():
    w = words_of(pa.array(["Hello, WORLD hello", "", None, "a", "né x-y", "z" * (3 << 20) + " b"]))
    assert w.offsets.tolist() == [0, 3, 3, 3, 4, 7, 9]
    assert w.hashes[0] == w.hashes[2] == hash_text("hello") and w.hashes[8] == hash_text("b")


def test_words_do_not_cross_documents():
    w = words_of(pa.array(["ab", "cd"]))
    assert w.hashes.tolist() == [hash_text("ab"), hash_text("cd")]


def test_shingles_of_short_texts():
    w = words_of(pa.array(["a b c d", "a b", "", "a"]))
    h, cut = w.shingles(3)
    assert np.diff(cut).tolist() == [2, 1, 0, 1]
    assert len(set(h.tolist())) == 4


def test_slices_hold_all_rows_and_sliced_arrays():
    b = pa.record_batch([pa.array(["x" * 10] * 25 + [None, ""])], names=["text"])
    parts = list(slices(b, limit=95))
    assert sum(p.num_rows for p in parts) == 27 and parts[0].num_rows == 9
    assert words_of(parts[1].column(0)).offsets.tolist() == list(range(10))
