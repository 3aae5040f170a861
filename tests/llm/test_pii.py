import numpy as np
import pytest

from clinmill.llm import pii as P
from clinmill.llm.pii_table import labelled_texts


@pytest.fixture(scope="module")
def tagger():
    return P.Tagger(P.model())


def spans(pieces):
    at, out, text = 0, [], ""
    for t, y in pieces:
        if y:
            out.append((y, at))
        at += len(t)
        text += t
    return text, out


def test_held_out_accuracy(tagger):
    texts, want = zip(*(spans(p) for p in labelled_texts(400, seed=99)))
    got = tagger(list(texts))
    t = {(i, *s) for i, w in enumerate(want) for s in w}
    g = {(i, k, a) for i, r in enumerate(got) for k, a, _ in r}
    assert len(t & g) / len(t) > 0.95 and len(t & g) / len(g) > 0.95


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Rappeler au +33 (0)2 61 91 68 34.", [("telephone", "+33 (0)2 61 91 68 34")]),
        ("Demande reçue de jeanne.morel (at) foyer.invalid hier soir.", [("courriel", "jeanne.morel (at) foyer.invalid")]),
        ("Domicile : 12 bis, rue des Lilas, 00123 Pontville.", [("adresse", "12 bis, rue des Lilas, 00123 Pontville")]),
        ("Vu par le Dr Marchadier dans la nuit.", [("nom", "Marchadier")]),
        ("Mme H. Marchadier confirme les horaires de prise.", [("nom", "H. Marchadier")]),
        ("Madame B., mère de l'enfant, décrit une maladie de Kelmovic familiale.", []),
        ("Mme [PERSON] est suivie pour un syndrome de Quinmomann.", []),
        ("Le flacon porte le lot 4884882907 et la mention stérile.", []),
        ("", []), ("\n \n", []),
    ],
)
def test_examples(tagger, text, want):
    assert [(k, text[a:b]) for k, a, b in tagger([text])[0]] == want


def test_pruned_viterbi_is_exact():
    rng = np.random.default_rng(1)
    n, k = 300, P.K
    t = rng.normal(0, 1, (k, k))
    crf = P.Crf(np.zeros(0, np.int64), np.zeros((len(P.OFFSETS), 1, k), np.float32), t)
    scores = rng.normal(0, 1, (n, k))
    scores[:, 0] += rng.choice([0, 12], n)
    full = crf.viterbi(scores, np.array([0]), np.array([n]))
    unsure = (scores[:, :1] - scores[:, 1:] <= crf.bound[1:]).any(1)
    where = np.flatnonzero(unsure)
    new = np.r_[True, np.diff(where) > 1]
    part = crf.viterbi(scores, where[new], np.diff(np.r_[np.flatnonzero(new), len(where)]))
    assert 0 < unsure.mean() < 1 and (part == full).all()


def test_tables(spark):
    rows = [("vignette", "a", "Courriel : x.y@z.fr, sans réponse ce jour.", 1), ("vignette", "a", "Courriel : x.y@z.fr, sans réponse ce jour.", 1), ("vignette", "b", None, 1), ("golden", "c", "", 1), ("golden", None, "Rappeler au 01 02 03 04 05.", 1)]
    df = spark.createDataFrame(rows, "nom_table string, id string, text string, debut int")
    assert [tuple(r)[:5] for r in P.places(df).collect()] == [("vignette", "a", "courriel", 11, 19)]
    out = [tuple(r) for r in P.redacted(df).collect()]
    assert len(out) == 5 and ("vignette", "a", "Courriel : [COURRIEL], sans réponse ce jour.") in out and ("vignette", "b", None) in out
    assert P.places(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "start"),
    [
        ("He feels better. Home address: 24 Mossbridge Street, Boisulville. Symptoms began on a Thursday.", "24 Mossbridge"),
        ("Oxygen saturation 97 percent. Collected from 138 Hollowmere Road, Montulvac. A friend describes a similar rash.", "138 Hollowmere"),
        ("Lives at 7 Quarrystone Lane with a friend.", "7 Quarrystone"),
        ("A 24 Hour tape was fitted on Ward 12 and sodium was 138 on Thursday.", None),
    ],
)
def test_english_addresses(tagger, text, start):
    got = [a for k, a, _ in tagger([text])[0] if k == "adresse"]
    assert got == ([text.index(start)] if start else [])


def test_unseen_wording():
    """A fifth of the labelled sentences is left out of training and alone tested."""
    tagger = P.Tagger(P.train(labelled_texts(2400, fifth=0)))
    texts, want = zip(*(spans(p) for p in labelled_texts(400, seed=99, fifth=0, held_out=True)))
    t = {(i, *s) for i, w in enumerate(want) for s in w}
    g = {(i, k, a) for i, r in enumerate(tagger(list(texts))) for k, a, _ in r}
    assert len(t & g) / len(t) > 0.8 and len(t & g) / len(g) > 0.9
