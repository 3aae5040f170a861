from pyspark.sql import functions as F

from clinmill.operators import responses as R

ROWS = [("a", "1", 1, "bruit"), ("a", "1", 2, 'ok {"m": "x", "n": 1} fin'), ("a", "2", 1, '{"c": "haut"}'), ("b", "1", 1, '{"m": "y", "n": 2}'), ("b", "2", 1, '{"c": "??"}'), ("c", "1", 1, "rien"), ("c", "2", 1, '{"c": "haut"}')]


def test_stages(spark):
    resp = spark.createDataFrame(ROWS, "id string, stage string, attempt int, raw_text string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    out = {r["id"]: r for r in R.staged(ids, resp, [("1", "struct<m:string,n:int>", None), ("2", "struct<c:string>", F.col("value.c").isin("haut", "bas"))]).collect()}
    assert out["a"]["_echec"] is None and out["a"]["1"]["n"] == 1 and out["a"]["2"]["c"] == "haut"
    assert out["b"]["_echec"] == "2" and out["b"]["2"] is None
    assert out["c"]["_echec"] == "1" and out["c"]["2"] is None and out["d"]["_echec"] == "1"


def test_first_valid(spark):
    df = spark.createDataFrame([("a", 1, ["p"]), ("a", 2, []), ("a", 3, []), ("b", 1, ["p"]), ("b", 2, ["q"])], "k string, n int, p array<string>")
    assert sorted((r["k"], r["n"], r["n_refuses"]) for r in R.first_valid(df, ["k"], "n", "p").collect()) == [("a", 2, 1), ("b", 2, 2)]


def test_criteria(spark):
    df = spark.createDataFrame([(["fievre", "toux", "sans"], {"fievre": "fièvre à trente neuf depuis hier", "toux": "une chose inventée de toutes pièces"}, "Le patient a une fièvre à trente neuf depuis hier soir.")], "c array<string>, q map<string,string>, t string")
    for strict in (True, False):
        r = df.select(R.kept_criteria(F.col("c"), F.col("q"), F.col("t"), strict)).first()[0]
        assert r["gardes"] == ["fievre"] and r["rejetes"] == ["toux", "sans"]


def test_prompts(spark):
    items = spark.createDataFrame([(1, "z", "un"), (2, "b", "deux"), (3, "a", "trois"), (4, "z", "quatre")], "o int, s string, l string")
    got = [(r["section"], r["texte"]) for r in R.sectioned(items, "s", F.col("l"), ["a"], "o").orderBy("rang").collect()]
    assert got == [("a", "trois"), ("z", "un\nquatre"), ("b", "deux")]
    row = items.select(R.rendered("{x}/{y} {}", x=F.col("l"), y=F.lit(None)), R.visible_json("o", "l"), R.provenance(version="1", quand=F.lit("t"))["quand"], R.in_domain(F.col("s"), ["a"])).first()
    assert row[0] == "un/ {}" and row[1] == '{"o":1,"l":"un"}' and row[2] == "t" and row[3] is None


def test_golden(spark):
    a = spark.createDataFrame([("1", "x", ["b", "a"]), ("2", None, None), ("3", "x", [])], "id string, m string, c array<string>")
    b = spark.createDataFrame([("1", "x", ["a", "b", "a"]), ("2", None, None), ("3", "y", [])], "id string, m string, c array<string>")
    assert sorted((r["id"], r["ok"]) for r in R.golden(a, b, "id", ["m", "c"]).collect()) == [("1", True), ("2", True), ("3", False)]
