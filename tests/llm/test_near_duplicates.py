import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinmill.llm import near_duplicates, nearjoin
from clinmill.llm.components import connected
from clinmill.llm.near_duplicates import NearDuplicates
from clinmill.llm.shingles import words
from clinmill.llm.split_overlap import SplitOverlap, chains, coverage, report


def corpus(seed=1, n=120):
    """Texts of all lengths, edited copies, big clusters and exact copies."""
    r = random.Random(seed)
    vocab = [f"mot{i}" for i in range(900)]
    out = []
    for k in range(n):
        size = r.choice([1, 3, 8, 20, 45, 60, 90, 150, 260])
        base = [r.choice(vocab) for _ in range(size)]
        out.append(base)
        for _ in range(r.choice([0, 0, 1, 2, 12 if k % 40 == 0 else 3])):
            copy = list(base)
            for _ in range(max(1, size // r.choice([8, 15, 40]))):
                i = r.randrange(len(copy))
                how = r.random()
                if how < 0.4:
                    copy[i] = r.choice(vocab)
                elif how < 0.7:
                    copy.insert(i, r.choice(vocab))
                elif len(copy) > 1:
                    del copy[i]
            if r.random() < 0.3:
                h = len(copy) // 2
                copy = copy[h:] + copy[:h]
            out.append(copy)
    texts = [" ".join(t) for t in out]
    texts += [texts[0].upper() + " !"] * 60  # a hot group of copies
    return [(f"i{k}", t) for k, t in enumerate(texts)]


def brute(rows):
    sets = {i: frozenset(words(t)) for i, t in rows if t and words(t)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id string, contexte_clinique string, h string, nw int").repartition(3)
    got = {tuple(r) for r in NearDuplicates(df).pairs().collect()}
    want = brute(rows)
    assert not got - want
    assert len(want - got) <= 0.002 * len(want)


def test_classes(spark):
    a = "un deux trois quatre cinq six sept huit neuf dix"
    rows = [("a", a), ("b", a.upper()), ("c", a + " onze"), ("d", "tout autre chose ici"), ("e", None), ("f", " "), ("a", a), ("g", a + " onze douze"), ("h", "?!")]
    got = {r["id"]: tuple(r)[1:] for r in NearDuplicates(spark.createDataFrame(rows, "id string, contexte_clinique string")).classes().collect()}
    assert set(got) == {"a", "b", "c", "d", "g"} and got["a"] == ("a", 2, 2) and got["c"] == ("a", 2, 1) and got["d"] == ("d", 0, 1)


def test_empty(spark):
    df = spark.createDataFrame([], "id string, contexte_clinique string, split string, source string")
    nd = NearDuplicates(df)
    assert nd.pairs().count() == 0 and nd.classes().count() == 0
    nd.release()
    so = SplitOverlap(df)
    assert so.found().count() == 0 and report(so, df).count() == 0


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([("a", long), ("b", long.replace("w5 ", "v5 "))], "id string, contexte_clinique string")
    assert NearDuplicates(df).pairs().count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[499] == 200 and len(got) == 41 + 3 + 300
    assert connected(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("seed", [3])
def test_overlaps_match_brute_force(spark, seed):
    rows = corpus(seed)
    r = random.Random(seed)
    splits = {i: r.choice(["train", " Entrainement", "VALID", "dev", "test", None, "autre"]) for i, _ in rows}
    side = {i: None if s in (None, "autre") else "T" if s.strip().lower() in ("train", "entrainement") else "E" for i, s in splits.items()}
    want = {p for p in brute(rows) if {side[p[0]], side[p[1]]} == {"T", "E"}}
    df = spark.createDataFrame([(i, t, splits[i], "s") for i, t in rows], "id string, contexte_clinique string, split string, source string")
    so = SplitOverlap(df)
    got = {tuple(x) for x in so.found().collect()}
    assert not got - want
    assert len(want - got) <= 0.01 * len(want)
    assert so.overlaps().agg(F.min("couverture"), F.max("couverture")).first()[1] <= 1.0
    per = {x["split"]: x for x in report(so, df).collect()}
    assert per["test"]["n_touchees"] <= per["test"]["n_fiches"]


def test_chains_and_coverage():
    assert chains([(0, 0), (1, 5), (2, 2), (3, 3)]) == [[(0, 0), (2, 2), (3, 3)], [(1, 5)]]
    one = "a b c d e f g h i j".split()
    assert coverage(one, one, [(4, 4)]) == 10
    assert coverage(one, "a b c X d e f g h i j".split(), [(5, 6)]) == 10
    assert coverage(one, "f g h i j a b c d e".split(), [(0, 5), (6, 1)]) == 10
    assert coverage(one, "z z z".split(), []) == 0


def test_group_of_edited_copies_is_whole(spark):
    """What the copies share is frequent; small edits that recur give rare 5-grams."""
    r = random.Random(7)
    base = [f"mot{i}" for i in range(90)]
    places = r.sample(range(90), 20)
    rows = []
    for k in range(400):
        copy = list(base)
        for p in r.sample(places, 5):
            copy[p] = f"neuf{p}x{r.randrange(3)}"
        rows.append((f"a{k}", " ".join(copy)))
    rows += [(f"b{k}", " ".join(f"autre{r.randrange(4000)}" for _ in range(90))) for k in range(800)]
    df = spark.createDataFrame(rows, "id string, contexte_clinique string").repartition(3)
    got = {tuple(x) for x in NearDuplicates(df).pairs().collect()}
    assert got == brute(rows)


def test_scattered_insertions_share_no_gram(spark):
    """Pairs at the threshold whose 5-grams are all broken, and long ones."""
    r = random.Random(5)
    rows = []
    for k in range(40):
        n = r.choice([80, 100, 130, 400])
        base = [f"m{r.randrange(100_000)}" for _ in range(n)]
        copy = [y for i, x in enumerate(base) for y in ((x, f"z{r.randrange(100_000)}") if i % 3 == 1 else (x,))]
        rows += [(f"a{k}", " ".join(base)), (f"b{k}", " ".join(copy))]
    df = spark.createDataFrame(rows, "id string, contexte_clinique string")
    got = {tuple(x) for x in NearDuplicates(df).pairs().collect()}
    assert len(got) == 40 and got == brute(rows)


def test_long_text_with_insertions_is_covered(spark):
    """A gap longer than an extension skips, at every twelfth word of 1,000."""
    base = [f"mot{i}" for i in range(1000)]
    copy = [y for i, x in enumerate(base) for y in ([f"neuf{i}x{k}" for k in range(4)] if i % 12 == 11 else []) + [x]]
    short = [(f"s{k}", " ".join(f"c{k}x{i}" for i in range(9)), "train") for k in range(5)]
    df = spark.createDataFrame([("a", " ".join(base), "test"), ("b", " ".join(copy), "train"), *short], "id string, contexte_clinique string, split string")
    (row,) = SplitOverlap(df).overlaps().collect()
    assert (row["id_eval"], row["id_train"]) == ("a", "b") and row["couverture"] > 0.6


def test_coverage_is_no_veto(spark):
    """The same words in an order that leaves no chain to speak of."""
    base = [f"mot{i}" for i in range(120)]
    df = spark.createDataFrame([("a", " ".join(base), "test"), ("b", " ".join(base[::-1] + ["fin"]), "train")], "id string, contexte_clinique string, split string")
    assert SplitOverlap(df).found().count() == 1


@pytest.mark.parametrize("step", [6, 7])
def test_spread_edits(spark, step):
    """Pairs at the threshold: every ``step``-th word replaced, 80 to 130 words."""
    r = random.Random(step)
    rows = []
    for k in range(60):
        base = [f"m{r.randrange(2000)}" for _ in range(r.choice([80, 102, 106, 120, 130]))]
        rows += [(f"a{k}", " ".join(base)), (f"b{k}", " ".join(f"z{r.randrange(2000)}" if i % step == 0 else w for i, w in enumerate(base)))]
    df = spark.createDataFrame(rows, "id string, contexte_clinique string")
    want = brute(rows)
    assert {tuple(x) for x in NearDuplicates(df).pairs().collect()} == want and len(want) > 20


@pytest.mark.parametrize("sided", [False, True])
def test_hot_words_are_split(sided):
    """A group may hold few words: hot ones fall into parts, and the sums stay right."""
    r = random.Random(2)
    sets = [frozenset(r.sample(range(60), r.choice([8, 20, 24]))) for _ in range(120)]
    sets += [frozenset(r.sample(sorted(s), len(s) - 1) + [r.randrange(60)]) for s in sets[:80]]
    sets = list(dict.fromkeys(sets))
    side = [r.choice([1, 2, 3]) if sided else 0 for _ in sets]
    values = [np.array([(v * 0x9E3779B97F4A7C15) % (1 << 48) for v in sorted(s)], np.uint64) for s in sets]
    n = np.array([len(v) for v in values])
    maps = nearjoin.bitmaps(np.repeat(np.arange(len(n)), n), np.concatenate(values), n)
    rank = np.arange(nearjoin.BUCKETS, dtype=np.int32)
    keys = [np.sort(nearjoin.keys_of(v, rank))[: int(nearjoin.prefix_lengths(np.array([len(v)]), 7)[0])] for v in values]
    postings = np.bincount(np.concatenate([k >> np.uint64(nearjoin.BELOW) for k in keys]).astype(np.int64), minlength=nearjoin.BUCKETS)
    fragment, parts = nearjoin.cut_order(postings, 20)
    assert parts.max() > 1
    sums = {}
    for f, k in enumerate(parts.tolist()):
        for a in range(k):
            for b in range(a, k):
                rows = []
                for d, own in enumerate(keys):
                    at = [i for i, w in enumerate(own.tolist()) if fragment[w >> nearjoin.BELOW] == f]
                    if at and d % k in (a, b):
                        rows.append((0, d, int(n[d]), side[d], d % k, at[0], at[-1] == len(own) - 1, maps[d], own[at].tobytes()))
                if rows:
                    fields = [("grp", pa.int64()), ("h", pa.int64()), ("nw", pa.int32()), ("side", pa.int32()), ("part", pa.int32()), ("start", pa.int32()), ("ends", pa.bool_()), ("bits", pa.binary()), ("words", pa.binary())]
                    table = pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[x for x, _ in fields])
                    for p in nearjoin.Group(table, 7).partial().to_pylist():
                        s = sums.setdefault((p["h1"], p["h2"]), [0, 0, 0])
                        for i, c in enumerate(("common", "only1", "only2")):
                            s[i] += p[c]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j and 10 * len(x & y) >= 7 * len(x | y) and ((side[i] & 1 and side[j] & 2) if sided else i < j):
                common, only1, only2 = sums[i, j]
                assert common <= len(x & y) and only1 <= len(x - y) and only2 <= len(y - x)


@pytest.mark.parametrize("sided", [False, True])
def test_hot_word_among_unlike_texts(monkeypatch, sided):
    """One word in all texts of 5 to 400 words: few of the unlike pairs are looked at a second time, and no near pair is lost."""
    r = random.Random(4)
    sets = [frozenset([0, *r.sample(range(1, 4000), r.choice([5, 60, 90, 135, 160, 165, 169, 200, 400]))]) for _ in range(700)]
    sets += [frozenset([0, *sorted(s)[len(s) // 12 + 1 :], *r.sample(range(5000, 9000), len(s) // 13)]) for s in sets[:90]]
    side = [r.choice([1, 2, 3]) if sided else 0 for _ in sets]
    values = [np.array([(v * 0x9E3779B97F4A7C15) % (1 << 48) for v in sorted(s)], np.uint64) for s in sets]
    n = np.array([len(v) for v in values])
    maps = nearjoin.bitmaps(np.repeat(np.arange(len(n)), n), np.concatenate(values), n)
    columns = ("grp", "h", "nw", "side", "part", "start", "ends", "bits", "words")
    rows = [(0, d, int(n[d]), side[d], 0, 0, False, maps[d], np.zeros(1, np.uint64).tobytes()) for d in range(len(sets))]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=columns)
    looked = []
    near = nearjoin.Group.near
    monkeypatch.setattr(nearjoin.Group, "near", lambda self, x, y: looked.append(len(x)) or near(self, x, y))
    got = {(p["h1"], p["h2"]) for p in nearjoin.Group(table, 7).partial().to_pylist()}
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 10 * len(x & y) >= 7 * len(x | y) and ((side[i] & 1 and side[j] & 2) if sided else i < j)}
    assert want <= got and len(want) > 60
    assert sum(looked) < 0.02 * len(sets) ** 2 / 2


def test_copies_are_spread_by_their_number(spark, monkeypatch):
    """Texts told once are not repeated for the salts; all copies of a hot one meet."""
    monkeypatch.setattr(near_duplicates, "COPIES", 4)
    rows = [(f"a{k}", k) for k in range(50)] + [(f"b{k}", 100) for k in range(3)] + [(f"c{k}", 200) for k in range(90)]
    one, two = (spark.createDataFrame(rows, f"i{k} string, h bigint") for k in (1, 2))
    for least, single in ((1, 50), (2, 0)):
        got = near_duplicates.copies(one, two, least).select("i1", "i2").collect()
        assert len(got) == len(set(got)) == single + 3 * 3 + 90 * 90
