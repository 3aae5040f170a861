import json
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from clinmill.operators import dedup, metrics, preference, reports, rules, sampling, units, vignettes


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_sources_to_records(spark):
    exam = spark.createDataFrame([("1", "cas", "q", "x", None, "y", None, None, "A", "QCM", "Cardio", "R")], "id string, clinical_case string, question string, answer_a string, answer_b string, answer_c string, answer_d string, answer_e string, correct_answers string, task string, medical_subject string, question_type string")
    r = vignettes.from_exam(exam, "mcqu", "train").first()
    assert r["id"] == "mediqal_mcqu_1" and r["choix"] == {"A": "x", "C": "y"} and r["langue"] == "fr"
    assert vignettes.from_exam(exam, "oeq", "train").first()["choix"] is None
    pharmacy = spark.createDataFrame([("7", "q", {"a": "x"}, ["a", "c"], None, "s"), ("8", "q", {}, [], None, "s")], "id string, question string, answers map<string,string>, correct_answers array<string>, subject_name string, type string")
    assert rows(vignettes.from_pharmacy_exam(pharmacy, "dev"), "reponse_correcte") == [("A,C",), (None,)]
    pages = spark.createDataFrame([("1", "q", "", "f", "t"), ("2", "q", "r", "f", "t")], "id string, question string, answer string, focus string, qtype string")
    assert vignettes.from_question_pages(pages).count() == 1 and vignettes.from_question_pages(pages, keep_unanswered=True).count() == 2


def test_required_fields(spark):
    df = spark.createDataFrame([("a", "s", "fr", ""), (None, "s", "fr", "q"), ("b", "s", "fr", "q")], "id string, source string, langue string, question string")
    assert rows(df, vignettes.missing_fields()) == [(["id"],), (["question"],), ([],)]
    assert vignettes.valid(df).count() == 1


def test_relevance(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    got = rows(vignettes.relevance(df, spark.createDataFrame([("a", True, "j")], "id string, urgence boolean, justification string")))
    assert got == [("a", True, "j"), ("b", False, "sans_decision")]


TEXTS = [(1, "a", "même texte"), (2, "b", "même texte"), (3, "c", None), (4, "d", "  "), (5, "e", "x" * 300), (6, "f", "x" * 200 + "y"), (7, "g", None)]


def test_dedup(spark):
    df = spark.createDataFrame(TEXTS, "ord bigint, id string, t string")
    got = {r["conserve"]: r for r in dedup.exact(df, "t", "id", "ord", with_ids=True).collect()}
    assert set(got) == {"a", "c", "d", "e", "f", "g"} and got["a"]["ids_questions"] == ["a", "b"] and got["c"]["cas_id"] == "sans_contexte_c"
    log = {r["id"]: r["raison"] for r in dedup.correspondence(df, "t", "id", "ord").collect()}
    assert log == {"a": "conserve", "b": "texte_identique", "c": "sans_contexte", "d": "sans_contexte", "e": "conserve", "f": "conserve", "g": "sans_contexte"}
    assert rows(dedup.variants(df, "t", "id", "ord"), "n_textes", "n_lignes") == [(2, 2)]
    assert {r["conserve"] for r in dedup.shortest(df, "t", "id", "ord").collect()} == {"a", "c", "d", "f", "g"}
    assert "e" in {r["conserve"] for r in dedup.shortest(df, "t", "id", "ord", pinned=["e"]).collect()}
    assert tuple(dedup.report(df, "t", "id", "ord").first()) == (7, 3, 3, 2, 2, 1)
    stable = dedup.filter_stability(df, spark.createDataFrame([("a", True), ("b", False), ("e", True)], "id string, retenu boolean"), "t", "id", "ord")
    assert rows(stable, "retenues", "exclues", "instable") == [(1, 0, False), (1, 1, True)]
    empty = df.limit(0)
    assert dedup.exact(empty, "t", "id", "ord").count() == 0 and tuple(dedup.report(empty, "t", "id", "ord").first()) == (0, 0, 0, 0, 0, 0)
    pairs = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("a", "a"), (None, "a")], "x string, y string")
    assert [r[0] for r in pairs.select(dedup.first_difference("x", "y")).collect()] == [2, 2, -1, None]


def test_sampling_and_splits(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 20).cast("string").alias("g"))
    a, b = (rows(sampling.sample(df, "id", 10)) for _ in range(2))
    assert a == b and len(a) == 10 and sampling.sample(df, "id", 500).count() == 100
    split = sampling.group_split(df, "g", 0.2)
    assert sampling.leaks(split, "g").count() == 0
    assert split.where("jeu = 'validation'").select("g").distinct().count() == 4
    assert sampling.group_split(df.where("g < '3'"), "g", 0.9, least=50).where("jeu = 'validation'").count() == 0


def test_resume(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, None), (2, "panne")], "k int, err string")
    assert rows(sampling.pending(todo, done, ["k"])) == [(3,)]
    assert rows(sampling.pending(todo, done, ["k"], "err")) == [(2,), (3,)]
    tries = spark.createDataFrame([(1, 1, "e"), (1, 2, None), (1, 3, "e"), (2, 1, "e"), (2, 2, "f")], "k int, n int, err string")
    assert rows(sampling.last_success(tries, ["k"], "n", "err")) == [(1, 2, None), (2, 2, "f")]
    v = sampling.variants(spark.createDataFrame([("u",), ("m",), ("z",)], "l string"), "l", {"u": 1, "m": 2})
    assert rows(v) == [("m", 0), ("m", 1), ("u", 0)]
    assert sampling.parse_variants("u=3", {"u": 1, "m": 2}) == {"u": 3, "m": 2}
    with pytest.raises(ValueError):
        sampling.parse_variants("x=1", {"u": 1})


def test_reports(spark):
    df = spark.createDataFrame([("a", ["x : 1", "y : 2"]), ("b", ["x : 3"]), ("a", None)], "k string, r array<string>")
    assert rows(reports.reason_histogram(df, "r")) == [("x", 2), ("y", 1)]
    assert rows(reports.crosstab(df.withColumn("c", F.lit("p")), "k", "c", ["p", "q"])) == [("a", 2, 0), ("b", 1, 0)]
    assert rows(reports.shares(df, "k")) == [("a", 2, 66.67), ("b", 1, 33.33)]
    n = spark.range(1, 13).select(F.lit("g").alias("g"), F.col("id"))
    assert reports.quantile_by_index(n, F.col("id"), 0.95, ["g"]).first()["quantile"] == 11
    assert n.agg(reports.small_list_quantile(F.collect_list("id"), 0.95, 30)).first()[0] == 11
    s = reports.length_summary(n, F.col("id"), ["g"]).first()
    assert (s["mini"], s["maxi"], s["mediane"], s["p95"]) == (1, 12, 7, 11)
    assert rows(reports.islands(spark.createDataFrame([("a", i, i in (1, 2, 5)) for i in range(7)], "k string, i int, f boolean"), "k", "i", "f")) == [("a", 1, 2, 2), ("a", 5, 5, 1)]
    assert reports.profile(df.select("k"), ["k"]).count() == 2
    assert reports.top_with_histogram(df, "k", "k", 1).first()["histogramme"] == "a=2"


@pytest.mark.parametrize(
    ("matrix", "want"),
    [  # published confusion matrices (rows are the truth) and their figures
        ([[42, 2, 1], [5, 23, 5], [2, 3, 24]], {"exactitude": 0.8318, "macro_f1": 0.8204, "sous_estimation": 0.0748, "sur_estimation": 0.0935, "rappel0": 0.9333, "rappel1": 0.6970, "rappel2": 0.8276}),
        ([[45, 0, 0], [5, 23, 5], [2, 3, 24]], {"exactitude": 0.8598, "macro_f1": 0.8450, "sous_estimation": 0.0467, "sur_estimation": 0.0935, "rappel0": 1.0}),
        ([[45, 0, 0], [33, 0, 0], [29, 0, 0]], {"exactitude": 0.4206, "macro_f1": 0.1974, "sous_estimation": 0.0, "sur_estimation": 0.5794, "rappel1": 0.0}),
    ],
)
def test_metrics(spark, matrix, want):
    df = spark.createDataFrame([(v, p) for v, r in enumerate(matrix) for p, n in enumerate(r) for _ in range(n)], "v int, p int")
    got = {r["mesure"] + ("" if r["classe"] is None else str(r["classe"])): r["valeur"] for r in metrics.metrics(metrics.confusion(df, F.col("v"), F.col("p"), 3), 3).collect()}
    assert {k: got[k] for k in want} == want


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "v int, p int")
    assert all(r["valeur"] is None for r in metrics.metrics(metrics.confusion(df, F.col("v"), F.col("p"), 2), 2).collect())


def test_style_pairs(spark):
    df = spark.createDataFrame([("c1", "s", 0, 0), ("c1", "t", 0, 1), ("c2", "s", 1, 1), ("c2", "t", 1, 1)], "c string, style string, v int, p int")
    assert rows(metrics.style_pairs(df, "c", "style", "v", "p")) == [("_decision_change", 1, 2), ("s", 2, 2), ("t", 1, 2)]


CAND = "c string, t int, n int, total int, ref boolean, sur boolean, texte string"


def test_pairs_by_score(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, 20, True, True, "x"), ("a", 1, 2, 20, False, True, "y"), ("a", 1, 3, 12, False, True, "z"), ("b", 1, 1, 20, True, True, "x"), ("b", 1, 2, 18, False, True, "y"), ("c", 1, 1, 15, True, True, "x"),
         ("d", 1, 1, 20, True, True, "x"), ("d", 1, 2, 20, False, False, "y")], CAND,
    )
    got = {r["c"]: (r["choisi"], r["rejete"], r["raison"]) for r in preference.pairs_by_score(df, ["c", "t"], "total", "ref", "sur", "n").collect()}
    assert got == {"a": (1, 3, None), "b": (1, 2, "ecart_trop_faible"), "c": (1, 1, "un_seul_candidat"), "d": (1, 2, None)}


def test_candidates(spark):
    df = spark.createDataFrame([("a", 1, 1, 1, False, True, " x "), ("a", 1, 2, 1, True, True, "x"), ("a", 1, 3, 1, False, True, "y")], CAND)
    assert rows(preference.distinct_candidates(df, ["c", "t"], "texte", "ref", "n"), "n") == [(2,), (3,)]
    assert {r["lettre"] for r in preference.lettered(df, ["c", "t"], "n").collect()} == {"A", "B", "C"}
    bad = df.withColumn("d", F.when(F.col("n") == 3, F.array(F.lit("leger"), F.lit("grave"))).when(F.col("n") == 1, F.array(F.lit("leger"))).otherwise(F.array().cast("array<string>")))
    assert preference.pairs_by_rules(bad, ["c", "t"], "d", ["grave", "leger"], "n").first()[2:] == (3, "grave", None)
    none = df.withColumn("d", F.array().cast("array<string>"))
    assert preference.pairs_by_rules(none, ["c", "t"], "d", ["grave"], "n").first()[2:] == (None, None, "aucune_reponse_fautive")
    judge = spark.createDataFrame([(["B", "A"], [5, 1]), (["A"], [6])], "l array<string>, n array<int>")
    assert [r[0] for r in judge.select(preference.judge_problems(F.col("l"), F.col("n"), F.array(F.lit("A"), F.lit("B")))).collect()] == [[], ["lettres", "notes"]]


def test_review(spark):
    df = spark.createDataFrame([(i, "c", "r", None) for i in range(4)], "k int, chosen string, rejected string, a_valider boolean")
    d = spark.createDataFrame([(0, "valider"), (1, "inverser"), (2, "rejeter"), (3, "remettre")], "k int, decision string")
    got = {r["k"]: (r["chosen"], r["a_valider"], len(r["historique"])) for r in preference.reviewed(df, d, "k").collect()}
    assert got == {0: ("c", True, 0), 1: ("r", True, 0), 2: ("c", False, 0), 3: ("c", None, 1)}
    assert tuple(preference.progress(preference.reviewed(df, d, "k")).first()) == (2, 1, 1)
    assert preference.usable(preference.reviewed(df, d, "k")).count() == 2


def test_rules(spark):
    order = ["1", "2", "3", "4"]
    df = spark.createDataFrame([(150, "4"), (None, "4"), (100, "1"), (100, None)], "fc int, label string")
    flags = rules.fired([rules.Rule("fc", F.col("fc") > 140, "1", "v"), rules.Rule("fc2", F.col("fc") > 90, "2", "v")])
    out = df.withColumn("f", flags).withColumn("p", rules.floor_of(F.col("f"), order)).select("p", rules.raised(F.col("label"), F.col("p"), order).alias("r")).select("p", "r.*")
    assert [tuple(r) for r in out.collect()] == [("1", "1", True), (None, "4", False), ("2", "1", False), ("2", "2", False)]
    scored = rules.scored(df, [("a", F.col("fc") > 140, "haute", F.lit(50)), ("b", F.col("fc").isNull(), "basse", F.lit(5))])
    assert [tuple(r) for r in scored.select("a_relire", "priorite", "score").collect()] == [(True, "haute", 50), (False, "basse", 0), (False, None, 0), (False, None, 0)]


def test_review_queue(spark):
    df = spark.createDataFrame([(i, i < 3, i * 10, i > 7) for i in range(10)], "k int, haute boolean, score int, basse boolean")
    got = rules.review_queue(df, "k", "haute", "score", "basse", 4, 2).orderBy("rang").collect()
    assert [r["k"] for r in got[:3]] == [2, 1, 0] and [r["bloc"] for r in got[:5]] == [0, 0, 0, 1, 1]
    assert [r["dans_le_budget"] for r in got[:5]] == [True, True, False, True, True]


@pytest.mark.parametrize(
    ("text", "hit"),
    [("J'ai une douleur thoracique", True), ("Je n'ai pas de douleur thoracique", False), ("pas de fièvre mais une douleur thoracique", True), ("Je ne sais pas, douleur thoracique peut-être", True), (None, False), ("", False), ("aucune gêne. DOULEUR THORACIQUE !", True)],
)
def test_clause_scoped_negation(spark, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(rules.said(F.col("t"), "douleur thoracique")).first()[0] is hit
    assert df.select(rules.signs(F.col("t"), {"sca": ["douleur thoracique"]})).first()[0] == (["sca"] if hit else [])


def test_first_hit_and_scope(spark):
    turns = spark.createDataFrame([("a", 0, "user", "bonjour"), ("a", 1, "assistant", "convulsion ?"), ("a", 2, "user", "une convulsion"), ("b", 0, "user", "rien")], "c string, t int, role string, texte string")
    assert [tuple(r) for r in rules.first_hit(turns, "c", "t", "role", "texte", "user", {"neuro": ["convulsion"]}).collect()] == [("a", 2, ["neuro"])]
    df = spark.createDataFrame([("la météo de demain",), ("la météo me donne de la fièvre",)], "t string")
    assert [r[0] for r in df.select(rules.out_of_scope(F.col("t"), ["meteo"], ["fievre"])).collect()] == [True, False]
    p = spark.createDataFrame([(None, [0.35, 0.6, 0.05]), ("urgent", [0.0, 1.0, 0.0]), (None, [0.1, 0.2, 0.7])], "f string, p array<double>")
    assert [r[0] for r in p.select(rules.final_decision(F.col("f"), F.col("p"), ["u", "m", "d"])).collect()] == ["u", "urgent", "d"]


def test_catalogue(spark):
    grid = spark.createDataFrame([("m", "ECG", None), ("m", "Avis référent", "Choc"), ("m", "ECG", "Choc")], "k string, tri1 string, tri2 string")
    assert rows(rules.catalogue_from_grid(grid, "k", {"tri1": "1", "tri2": "2"})) == [("m", "1", "ECG"), ("m", "2", "Choc")]
    cases = spark.createDataFrame([("c", "m", ["ECG", "x"]), ("d", "m", None)], "k string, motif string, crit array<string>")
    mods = spark.createDataFrame([("m", "ECG", "1"), ("n", "x", "2")], "motif string, critere string, tri string")
    assert rows(rules.triggered_modifiers(cases, mods, "k", "motif", "crit")) == [("c", "ECG", "1")]


CASE = "releve_no bigint, source string, pas_mmhg double, pas_unite string, glycemie_mmol_l double, glycemie_unite string, texte_source string, mesure_le timestamp, champ string"


def test_units(spark):
    t0 = datetime(2024, 1, 1)
    conv = spark.createDataFrame([("s", "pas_mmhg", "mmHg"), ("s", "glycemie_mmol_l", "mmol/l"), ("r", "pas_mmhg", "cmHg")], "source string, champ string, unite string")
    data = [
        (1, "s", 120.0, None, None, None, None, t0, "x"), (2, "s", 12.5, None, None, None, "TA 12,5/8", t0, "x"), (3, "s", 15.1, "mmHg", None, None, "PA 15,1/9 kPa", t0, "x"),
        (4, " S ", None, None, 180.0, None, "dextro 180", t0, "x"), (5, "s", None, None, 1.8, "G / L", None, t0, "x"), (6, "r", 14.0, "", None, None, "carnet 14 kPa", t0, "x"),
        (7, None, 130.0, None, 5.0, None, "", None, "x"), (8, "s", float("nan"), None, None, None, None, t0, "x"), (2, "s", 12.5, None, None, None, "TA 12,5/8", t0, "x"),
    ]
    df = spark.createDataFrame(data, CASE)
    got = rows(units.foreign_units(df, conv))
    assert got == [(2, "pas_mmhg", "cmHg"), (3, "pas_mmhg", "kPa"), (4, "glycemie_mmol_l", "mg/dl"), (5, "glycemie_mmol_l", "g/l"), (6, "pas_mmhg", "cmHg")]
    common = {(r["releve_no"], r["champ"]): round(r["valeur_commune"], 2) for r in units.real_units(df, conv).collect()}
    assert common[(2, "pas_mmhg")] == 125.0 and common[(3, "pas_mmhg")] == 113.26 and common[(4, "glycemie_mmol_l")] == 9.99 and common[(5, "glycemie_mmol_l")] == 9.99
    assert units.foreign_units(df.limit(0), conv).count() == 0


def test_change_points(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    t0 = datetime(2024, 1, 1)
    data = [(i, "s", float(rng.normal(120, 10) / (10 if 200 <= i < 400 else 1)), None, None, None, None, t0 + timedelta(hours=i), "x") for i in range(600)]
    long = units.measures(spark.createDataFrame(data, CASE).withColumn("glycemie_mmol_l", F.lit(None).cast("double")))
    seg = units.segments(long).orderBy("segment").collect()
    assert [r["unite_segment"] for r in seg] == ["mmHg", "cmHg", "mmHg"] and [r["changement"] for r in seg] == [False, True, True]
    assert [r["debut"] for r in seg] == [None, *((t0 + timedelta(hours=i)).replace(tzinfo=timezone.utc).timestamp() for i in (200, 400))]
    n = np.ones(60)
    x = np.r_[np.zeros(20), np.full(20, 3.0), np.zeros(20)] + rng.normal(0, 0.1, 60)
    assert units.pelt(n, x, x * x, 2.0) == [0, 20, 40]
    best, cut = min(((sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in ((0, i), (i, j), (j, 60))), (i, j)) for i in range(1, 59) for j in range(i + 1, 60)))
    assert cut == (20, 40)


def test_pelt_is_exact_with_a_least_length():
    import numpy as np

    rng = np.random.default_rng(1)
    for k in range(30):
        x = np.concatenate([rng.normal(m, 0.4, rng.integers(1, 9)) for m in rng.normal(0, 1, 5)])
        m, penalty, least = len(x), float(rng.choice([0.3, 1.0])), int(rng.choice([1, 3]))
        cost = lambda a, b: ((x[a:b] - x[a:b].mean()) ** 2).sum()
        best = [-penalty] + [np.inf] * m
        for t in range(1, m + 1):
            best[t] = min([best[a] + cost(a, t) + penalty for a in range(t - least + 1)], default=np.inf)
        cuts = units.pelt(np.ones(m), x, x * x, penalty, least)
        if np.isfinite(best[m]):
            assert abs(sum(cost(a, b) + penalty for a, b in zip(cuts, [*cuts[1:], m])) - penalty - best[m]) < 1e-9


def test_unit_change_inside_a_source(spark):
    """The level shift decides: no one convention fits the history; stray times blur nothing."""
    import numpy as np

    rng = np.random.default_rng(4)
    t0 = datetime(2024, 1, 1)
    data = [(i, "s", float(rng.normal(120, 12) / (7.50062 if i >= 345 else 1)), None, None, None, None, t0 + timedelta(hours=i), "x") for i in range(600)]
    data += [(1000 + i, "u", float(rng.normal(12, 1)), None, None, None, None, t0 + timedelta(hours=i), "x") for i in range(200)]
    data += [(3000 + i, "d", 115.0 + i, "mmHg", None, None, None, t0, "x") for i in range(10)]
    data += [(2000, "s", 118.0, None, None, None, None, datetime(1901, 1, 1), "x"), (2001, "s", 121.0, None, None, None, None, None, "x")]
    df = spark.createDataFrame(data, CASE).withColumn("glycemie_mmol_l", F.lit(None).cast("double"))
    conv = spark.createDataFrame([("s", "pas_mmhg", "mmHg"), ("u", "pas_mmhg", "kPa")], "source string, champ string, unite string")
    got = {r["releve_no"]: r for r in units.real_units(df, conv).collect()}
    assert {i for i in range(600) if got[i]["unite"] == "kPa"} == set(range(345, 600)) and got[0]["changement"]
    assert got[1000]["unite_segment"] == "cmHg" and got[1000]["unite"] == "kPa" and not got[1000]["changement"]  # laid down, and nothing speaks against it
    assert got[2000]["unite"] == got[2001]["unite"] == "mmHg"
    assert sorted(r["releve_no"] for r in units.foreign_units(df, conv).collect()) == [*range(345, 600), *range(1000, 1200)]


def test_counter_matches(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "v string")
    assert dict(map(tuple, reports.value_counts(df, "v").collect())) == dict(Counter(["x", "y", "x", None]))
    assert json.dumps(reports.run_summary(df, nul=F.col("v").isNull()).first().asDict()) == '{"n": 4, "nul": 1}'
