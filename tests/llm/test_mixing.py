import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clinmill.llm import mixing as X


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_subset_sum_is_best(items, budget):
    sizes, most = [i[0] for i in items], [i[1] for i in items]
    got = X.subset_sum(sizes, most, budget)
    assert all(0 <= g <= m for g, m in zip(got, most))
    sums = {0}
    for s, m in items:
        sums = {a + k * s for a in sums for k in range(m + 1)}
    assert sum(g * s for g, s in zip(got, sizes)) == max(x for x in sums if x <= budget)


def test_fit():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 400)
    counts = rng.integers(0, 30, 399)
    every = int((lengths * counts).sum())
    for budget in (0, 7, every // 3, every - 1, every, 2 * every + 12345, 9 * every):
        passes, taken = X.fit(lengths, counts, budget, 3)
        assert (taken <= counts).all() and passes + (taken.max() > 0) <= 3
        assert passes * every + int((lengths * taken).sum()) == min(budget, 3 * every)
    assert X.fit(np.array([5]), np.array([0]), 10, 2)[0] == 0


def test_mix(spark):
    r = random.Random(3)
    docs = [(k, " ".join(["mot"] * r.randrange(1, 60)), r.choice(["a", " A ", "b", "C"]), 1) for k in range(600)] + [(900, None, "a", 1), (901, "", "b", 1), (902, "x y", None, 1), (903, "x", "autre", 1)]
    df = spark.createDataFrame(docs + docs[:5], "doc_id bigint, text string, source string, jetons int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("B", 0.3, 3), ("c", 0.2, 1), ("vide", 0.0, 4)], "source string, part_cible double, repetitions_max int")
    m = X.Mix(df, targets)
    used = m.chosen().collect()
    assert len({u["doc_id"] for u in used}) == len(used)
    for s in m.shares().collect():
        assert s["utilisations_max"] <= s["repetitions_max"] and abs(s["part_atteinte"] - s["part_cible"]) < 0.005
    again = {(u["doc_id"], u["n_utilisations"]) for u in X.Mix(df.repartition(3), targets).chosen().collect()}
    assert again == {(u["doc_id"], u["n_utilisations"]) for u in used}
    assert {(u["doc_id"], u["n_utilisations"]) for u in X.Mix(df, targets, seed=1).chosen().collect()} != again
    assert X.Mix(df.limit(0), targets).chosen().count() == 0
