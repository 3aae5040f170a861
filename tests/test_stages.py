import json

from pyspark.sql import functions as F

from clinmill.operators import stages, units

MSG = "m array<struct<role:string,content:string>>"


def test_dialogue_problems(spark):
    turn = [("agent", "Bonjour ?"), ("patient", "Oui.")]
    rows = [(turn * 4,), (turn * 4 + turn[:1],), ([turn[1], turn[0]] * 4,), (turn * 2,), (turn * 3 + [("agent", "Je note [PERSON]"), ("patient", " ")],), ([],), (None,)]
    found = stages.dialogue_problems(F.col("m"), ("agent", "patient"), 4, 8, {"marque": r"\[[A-Z]+\]"})
    got = [r[0] for r in spark.createDataFrame(rows, MSG).select(found).collect()]
    assert got == [[], ["fin"], ["alternance"], ["longueur"], ["alternance", "marque"], ["vide"], ["vide"]]


def test_stale_labels(spark):
    df = spark.createDataFrame([("a", "x", "e"), ("b", "x", "e"), ("c", "x", "e"), (None, None, "e")], "id string, label string, autre string")
    now = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("b", "y", 1), ("b", None, 2)], "id string, label string, n int")
    got = {r["id"]: r["perime"] for r in stages.with_current_labels(df, now, "id", "label", "n").collect()}
    assert got == {"a": False, "b": True, "c": False, None: False}
    assert stages.with_current_labels(df.limit(0), now, "id", "label", "n").count() == 0


def test_conclusions(spark):
    words = {"u": ["sans attendre", "maintenant"], "d": ["attendre"]}
    df = spark.createDataFrame([("Partez sans attendre", "u"), ("Vous pouvez attendre", "u"), ("Venez maintenant, sans attendre", "d"), ("Il faut attendre", "d"), (None, "u")], "t string, l string")
    assert [r[0] for r in df.select(stages.coherent_conclusion(F.col("t"), F.col("l"), words, {"attendre": ["sans attendre"]})).collect()] == [True, False, False, True, False]
    rows = spark.createDataFrame([("a", "u", "x", None), ("b", "u", "Vite.", False), ("c", "u", "x", True), ("d", "?", "x", None)], "id string, l string, t string, douteux boolean")
    got = {r["id"]: (r["t"], r["changee"], r["balise"]) for r in stages.recalibrated(rows, {"u": ["Vite."]}, "l", "t", F.col("id"), "douteux").collect()}
    assert got["a"] == ("Vite.", True, "[[PRIORITE:u]]") and got["b"][1] is False and "c" not in got and got["d"][0] is None


def test_classifier_examples(spark):
    end = ("assistant", "Fin. [[PRIORITE:u]]")
    body = [("system", "s"), ("assistant", "A ?"), ("user", "B.")]
    rows = [(body + [end], None), (body + [end], "d"), (body, None), (body + [("assistant", "Fin.")], None), (body + [("assistant", "[[PRIORITE:z]]")], None), (body[:2] + [end, end], None), (body[:2] + [end], None), (None, None)]
    x = stages.classifier_example(F.col("m"), F.col("e"), ["d", "u"], {"assistant": "Agent", "user": "Patient"})
    got = [r[0] for r in spark.createDataFrame(rows, MSG + ", e string").select(x).collect()]
    assert (got[0]["texte"], got[0]["etiquette"], got[0]["numero"]) == ("Agent : A ?\nPatient : B.", "u", 1)
    assert [g["erreur"] for g in got] == [None, "etiquette_differente", "dernier_role", "balise_absente", "etiquette_inconnue", "fuite", "pas_de_patient", "dernier_role"]


def test_judged(spark):
    c = spark.createDataFrame([(k, n, "AB"[n]) for k in range(6) for n in range(2)], "k int, n int, lettre string")
    say = lambda *e: json.dumps({"evaluations": [dict(zip(("lettre", "c1", "securite_ok"), x)) for x in e]})
    good = say(("A", 5, True), ("B", 1, False))
    replies = [(0, 1, "non"), (0, 2, "ok " + good), (0, 3, good.replace("5", "4")), (1, 1, say(("A", 5, True))), (2, 1, good.replace("5", "6")), (3, 1, good.replace("5", '"5"')), (4, 1, good.replace("true", "1"))]
    got = {(r["k"], r["lettre"]): r for r in stages.judged(c, spark.createDataFrame(replies, "k int, essai int, reponse string"), ["k"], ["c1"]).collect()}
    assert got[0, "A"]["c1"] == 5 and got[0, "B"]["total_juge"] == 1 and got[0, "B"]["securite_ok"] is False
    assert [got[k, "A"]["erreur"] for k in range(6)] == [None, "lettres", "notes", "notes", "securite", "sans_reponse"] and got[3, "A"]["c1"] is None


def test_small_stages(spark):
    df = spark.createDataFrame([("a", "u", " null "), ("b", "z", " m1 "), ("c", None, "m9")], "id string, cat string, s string")
    known = spark.createDataFrame([("m1", "x"), ("m1", "y"), (None, "z")], "mid string, cat string")
    got = {r["id"]: (r["categorie_invalide"], r["s"], r["suggestion_invalide"]) for r in stages.labelled(df, "cat", "s", ["u"], known, "mid").collect()}
    assert got == {"a": (None, None, None), "b": ("z", "m1", None), "c": ("", None, "m9")}
    a = stages.audit(F.col("i"), F.col("r"), F.col("s"), F.col("q"), ["u", "m", "d"])
    rows = spark.createDataFrame([("m", True, "u", True), ("m", True, "d", True), ("m", False, "u", True), ("m", True, "u", None), ("m", None, None, None)], "i string, r boolean, s string, q boolean")
    assert [tuple(r[0]) for r in rows.select(a).collect()] == [(True, "u", "haute", False), (False, None, None, True), (False, None, None, False), (True, "u", "basse", False), (False, None, None, False)]
    v = spark.createDataFrame([(12.0, " cmHg"), (120.0, None), (1.0, "pouces")], "v double, u string").select(stages.converted(F.col("v"), F.col("u"), units.PRESSURE).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in v] == [(120.0, "12 cmHg -> 120 mmHg"), (120.0, None), (None, None)]
    e = "e array<struct<element:string,importance:string>>"
    f = spark.createDataFrame([([("x", "medicale"), ("y", None), ("", "medicale")],), (None,)], e).select(stages.invented(F.col("e")).alias("x")).select(F.size("x.graves"), F.size("x.mineurs"), "x.non_verifiee").collect()
    assert tuple(f[0]) == (1, 1, False) and f[1][2]
    s = spark.createDataFrame([("Vu M. Durand et Paris hier", [(16, 21, "LIEU"), (6, 12, "PERSON")])], "t string, s array<struct<debut:int,fin:int,type:string>>")
    x = s.select(stages.without_spans(F.col("t"), F.col("s"), r"M\.|Mme").alias("x")).first()[0]
    assert x["texte"] == "Vu M. [PERSON] et Paris hier" and len(x["acceptes"]) == len(x["ecartes"]) == 1
    n = spark.range(20)
    assert stages.first_rows(n, 0, "id").count() == 20 and [r[0] for r in stages.until(n, F.col("id") % 3 == 0, 3, 5, "id").collect()] == [0, 3]
    g = stages.gathered(n.withColumn("k", F.col("id") % 2), ["k"], "id", ["id"], 3).orderBy("k").collect()
    assert g[0]["n"] == 10 and [x["id"] for x in g[0]["lignes"]] == [0, 2, 4]
