import math
import random

import numpy as np
import pytest

from clinmill.llm import truncation as T


@pytest.mark.parametrize(
    ("text", "whole", "mark", "segment"),
    [
        ("Tout va bien.", True, False, ""), ("Tout va b", False, False, "tout va b"), ("Tout va bien. La co…", False, True, "la co"), ("Fin. La suite (suite)", False, True, "la suite"), ("Ok ?\n[[PRIORITE:moderee]]", True, False, ""),
        ("Bien.\n-- fin de fiche --", True, False, ""), ("Il a dit « oui ».", True, False, ""), ("…", False, True, ""), ("Tout va bien. …", True, True, ""), ("a Lire la suite", False, True, "a"),
    ],
)
def test_shape(text, whole, mark, segment):
    assert T.shape(text) == (whole, mark, segment)


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(6.0, 0.7, 20_000)).astype(int)
    cut = np.minimum(x, 500)
    length, count = np.unique(cut, return_counts=True)
    mu, sigma = T.fit_censored(length, count, length == 500)
    assert abs(mu - 6.0) < 0.05 and abs(sigma - 0.7) < 0.05
    naive = np.log(np.maximum(cut, 1)).mean()
    assert naive < mu - 0.1 and math.isfinite(sigma)


def test_table(spark):
    r = random.Random(4)
    sentence = lambda: " ".join(r.choice(["le", "patient", "décrit", "une", "douleur", "vive", "depuis", "hier", "matin"]) for _ in range(r.randrange(5, 12))).capitalize() + "."
    rows, want = [], set()
    for k in range(600):
        text = " ".join(sentence() for _ in range(r.randrange(2, 14)))
        source = r.choice(["Appels", " appels", "notes"])
        if source != "notes" and len(text) > 300:
            text = text[:300]
            if text.rstrip()[-1] != ".":
                want.add(k)
        elif k % 5 == 0:
            text += r.choice(["\nRelu et signé", "\nÉquipe du soir"])
        elif k % 97 == 0:
            text = text[: len(text) // 2].rstrip(" .") + "x"
            want.add(k)
        rows.append((k, text + r.choice(["", "  ", "\n"]), source, "z"))
    rows += [(9000, None, "appels", "z"), (9001, " \n", "notes", "z"), (9002, "Seul", None, "z"), (1, rows[1][1], rows[1][2], "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, segment string")
    t = T.Truncation(df)
    got = {x["doc_id"] for x in t.found().collect()} - {9002}
    assert len(got & want) / len(want) > 0.97 and len(got - want) <= 0.03 * len(want) + 1
    per = {x["source"]: x for x in t.rates().collect()}
    assert set(per) == {"appels", "notes", ""} and per["appels"]["n_a_la_limite"] > 20
    assert any(x["limite"] == 300 and x["source"] == "appels" for x in T.limits(t.shaped).collect())


def test_empty(spark):
    t = T.Truncation(spark.createDataFrame([], "doc_id bigint, text string, source string"))
    assert t.found().count() == 0 and t.rates().count() == 0


def test_limits_of_long_texts_are_exact(spark):
    r = random.Random(9)
    sizes = [20_000] * 40 + [r.randrange(12_000, 19_990) for _ in range(160)]
    rows = [(k, ("mot " * 5000)[: n - 1] + ("x" if n == 20_000 else "."), "longs") for k, n in enumerate(sizes)]
    t = T.Truncation(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert {x["limite"] for x in T.limits(t.shaped).collect()} == {20_000}
    assert t.rates().first()["n_a_la_limite"] == 40


@pytest.mark.parametrize(
    ("text", "want"),
    [("Il a dit « oui »", True), ("Vu hier (bilan)", True), ("Adressé par le Dr.", True), ("Il dit « oui. »", False), ("Tout va bien.", False), ("Bien.)", False), ("Ok ?\n[[PRIORITE:moderee]]", False), ("Tout va b", False)],
)
def test_endings_inside_a_sentence(text, want):
    assert T.inside(text) == want


def test_limit_outweighs_a_quotation(spark):
    r = random.Random(3)
    rows = [(k, ("mot " * 100)[:299] + "x", "s") for k in range(300)]
    rows += [(1000 + k, ("mot " * 100)[: r.randrange(40, 290)] + "x.", "s") for k in range(300)]
    rows += [(2000, ("mot " * 100)[:293] + "« oui »", "s"), (2001, "Il a répondu « oui »", "s"), (2002, ("mot " * 100)[:299] + ".", "s")]
    got = {x["doc_id"] for x in T.Truncation(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).found().collect()}
    assert got == {*range(300), 2000}


def test_censored_texts_are_no_witnesses_of_a_formula(spark):
    """Texts cut alike at a limit end alike; without the posterior their end would pass for a formula."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    rows = [(k, " ".join(word() for _ in range(r.randint(20, 90))) + ".", "s") for k in range(400)]
    rows += [(1000 + k, (" ".join(word() for _ in range(80)))[:293] + " zoo ab", "s") for k in range(60)]
    rows += [(2000 + k, " ".join(word() for _ in range(30 + k)) + ". Le service", "s") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {x["doc_id"] for x in T.Truncation(df).found().collect()}
    assert found >= {1000 + k for k in range(60)} and not found & {2000 + k for k in range(6)}


def test_limit_in_one_unit_is_none_in_the_other(spark):
    rows = [(k, ("é" * (k % 25) + "mot " * 200)[:500], "s") for k in range(300)] + [(1000 + k, "mot " * (40 + k) + "fin.", "s") for k in range(60)]
    t = T.Truncation(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert {(x["unite"], x["limite"]) for x in T.limits(t.shaped).collect()} == {("caracteres", 500)}


def test_fitted_endings():
    import pandas as pd

    counts = pd.DataFrame([("entiere", 0.0, 900), ("ouverte", 0.0, 30), ("rompue", 0.0, 10), ("rompue", 0.99, 60), ("ouverte", 0.99, 12), ("marque", 0.99, 5)], columns=["fin", "p", "n"])
    more, away = T.fit_endings(counts)
    fewer, _ = T.fit_endings(counts.assign(n=[900, 300, 10, 60, 0, 5]))
    assert more["ouverte"] > fewer["ouverte"] and more["rompue"] > 3 and more["entiere"] == T.NEVER and away < -2
