import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clinmill.llm.shingles import Folding, distinct, fold, grams, split_words, winnowed, words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAéÉœß0 9_-.\n\x00µΜﬁ½ç’", max_size=30), max_size=6))
def test_batch_splits_like_single_texts(texts):
    w = split_words(list(texts), Folding())
    want = [words(t) for t in texts]
    assert w.texts == [" ".join(x) for x in want]
    assert w.lengths.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert len(set(flat)) == len(set(w.hashes.tolist()))


def test_fold():
    assert fold("ÉLAN µg") == "elan μg" and words(None) == [] and words("  ") == []


def test_grams_and_winnowing():
    w = split_words(["a b c d e f g h", "a b", "c d e f"], Folding())
    at, g = grams(w.doc, w.hashes, 3)
    assert w.doc[at].tolist() == [0] * 6 + [2] * 2 and g[2] == g[6]
    keep = winnowed(w.doc[at], g, 4)
    assert {0, 2} == set(w.doc[at][keep].tolist())
    for a in range(3):  # every window keeps one
        assert any(a <= k < a + 4 for k in keep)
    d, v = distinct(np.array([0, 0, 1]), np.array([1 << 20, 1 << 20, 1 << 20], np.uint64))
    assert d.tolist() == [0, 1]
