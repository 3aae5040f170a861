import hashlib
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from clinmill.functions import messages as M
from clinmill.functions import numeric as N
from clinmill.functions import text as T


def one(spark, values, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*cols).collect()]


def test_folding_and_fingerprints(spark):
    texts = ["Élan  vital\n d’été", "a", "", None, " x " * 300]
    got = one(spark, [(t,) for t in texts], "t string", T.folded(F.col("t")), T.case_fingerprint(F.col("t")), T.prompt_hash(F.col("t")), T.content_id(F.col("t")))
    for t, (fold, case, short, content) in zip(texts, got):
        if t is None:
            assert (fold, case, short, content) == (None,) * 4
            continue
        want = "".join(c for c in unicodedata.normalize("NFD", t.lower().replace("’", "'")) if not unicodedata.combining(c))
        assert fold == want
        assert case == "cas_" + hashlib.sha1(re.sub(r"\s+", " ", t).strip()[:200].encode()).hexdigest()[:12]
        assert short == hashlib.sha256(t.encode()).hexdigest()[:8]
        assert content == "um_" + hashlib.md5(t.encode()).hexdigest()[:12]


def test_choice_by_crc(spark):
    keys = ["a-0", "b-1", "é-2"]
    got = one(spark, [(k,) for k in keys], "k string", T.chosen_of(["x", "y", "z"], F.col("k")))
    assert [g[0] for g in got] == ["xyz"[zlib.crc32(k.encode()) % 3] for k in keys]


@pytest.mark.parametrize(
    ("quote", "source", "whole", "run", "loose"),
    [
        ("Douleur thoracique depuis deux heures", "une douleur thoracique depuis deux heures.", True, 5, True),
        ("douleur depuis hier...au bras gauche seul", "Douleur depuis hier, au bras gauche seul", True, 7, True),
        ("deux mots", "deux mots", False, 2, False),
        ("une chose inventée ici", "rien de tel", False, 0, False),
        ("", "texte", False, 0, False),
        ("douleur vive au bras puis zzz yyy xxx www", "douleur vive au bras droit", False, 4, False),
    ],
)
def test_quotations(spark, quote, source, whole, run, loose):
    q, s = F.col("q"), F.col("s")
    got = one(spark, [(quote, source)], "q string, s string", T.quoted(q, s), T.longest_run(q, s)["n"], T.loosely_quoted(q, s))[0]
    assert got == (whole, run, loose)


def test_numbers(spark):
    t, v = F.col("t"), F.col("v")
    got = one(spark, [("TA 12,5/8 et 37.2", 125.0), ("rien", 1.0), (None, 1.0)], "t string, v double", T.numbers(t), T.value_present(t, v, v / 10))
    assert got == [([12.5, 8.0, 37.2], True), ([], False), (None, False)]
    text = ["12,5", " 7 ", "1e3", "12d", "1_0", "", None, "-3."]
    assert [r[0] for r in one(spark, [(x,) for x in text], "t string", T.lenient_number(t))] == [12.5, 7.0, 1000.0, None, None, None, None, -3.0]


def test_replies(spark):
    t = F.col("t")
    got = one(
        spark, [(" Oui ?? Non ? [[PRIORITE: moderee ]] <|im_end|> reste",), ("the doctor and you are here with me, please",), (None,)], "t string",
        T.clean_reply(t), T.concludes(t), T.tag_label(t), T.question_count(t), T.word_count(t), T.drifts_from(t, ("the", "and", "you", "with"), ("le", "les")),
    )
    assert got[0] == ("Oui ?? Non ? [[PRIORITE: moderee ]]", True, "moderee", 2, 9, False)
    assert got[1][1:4] == (False, None, 0) and got[1][5]
    assert got[2][0] is None and got[2][4] is None
    assert one(spark, [("x",)], "t string", T.tag_of(F.lit("differee")))[0][0] == "[[PRIORITE:differee]]"


def test_small_helpers(spark):
    t = F.col("t")
    got = one(spark, [("retry in 20s",), ("wait 150 ms",), ("try again in 2m 5s",), ("no",)], "t string", T.retry_delay(t))
    assert [g[0] for g in got] == [20.0, 0.15, 125.0, None]
    assert one(spark, [("  ecg  anormal ",)], "t string", T.tidy(t, {"ecg": "ECG"}))[0][0] == "ECG anormal"
    assert one(spark, [("raison : détail",), ("seule",)], "t string", T.before(t)) == [("raison",), ("seule",)]
    assert one(spark, [("Vu par Mme Durand-Petit ce jour",)], "t string", T.titled_names(t), T.without_titled_names(t))[0] == (["Durand-Petit"], "Vu par Mme [PERSON] ce jour")
    assert one(spark, [("a\r\nb",)], "t string", T.one_line(t))[0][0] == "a b"
    assert one(spark, [("null",), (" ",), ("x",)], "t string", T.blank_null(t, "null", "none")) == [(None,), (None,), ("x",)]
    rows = spark.createDataFrame([(["a", "b"], {"a": "q"}), ([], {}), (None, None)], "i array<string>, q map<string,string>")
    assert [r[0] for r in rows.select(T.listed(F.col("i"), F.col("q"))).collect()] == ["a <- « q » || b <- « ? »", "aucun", "aucun"]


def test_numeric(spark):
    rows = spark.createDataFrame([([2.0, 1.0, 0.5],), ([0.0, 0.0, 0.0],)], "l array<double>")
    p = N.softmax(F.col("l"))
    got = rows.select(p, N.argmax(p), N.decided(p)).collect()
    assert abs(sum(got[0][0]) - 1) < 1e-3 and got[0][1] == 0 and got[1][1] == 0 and got[1][2] == 0
    w = spark.createDataFrame([(45, 45), (5, 107), (0, 0)], "k int, n int").select(N.wilson(F.col("k"), F.col("n")).alias("w")).select("w.*").collect()
    assert tuple(w[0]) == (0.9213, 1.0) and tuple(w[1]) == (0.0201, 0.1048) and tuple(w[2]) == (None, None)
    levels = spark.createDataFrame([(["3A", "2"],), ([],), (None,)], "x array<string>").select(N.most_urgent(F.col("x"), ["1", "2", "3A"])).collect()
    assert [r[0] for r in levels] == ["2", None, None]
    bands = spark.createDataFrame([(0.5,), (15.0,), (None,)], "a double").select(N.banded(F.col("a"), [(1.0, "n"), (15.0, "e"), (99.0, "a")])).collect()
    assert [r[0] for r in bands] == ["n", "a", None]


MSG = "m array<struct<role:string,content:string>>"


def test_messages(spark):
    good = [("system", "s"), ("user", "u"), ("assistant", "a [[PRIORITE:x]]"), ("user", "v")]
    df = spark.createDataFrame([(good,), ([("user", "a"), ("user", " ")],), ([],), (None,)], MSG)
    m = F.col("m")
    got = df.select(M.structure_problems(m), M.leaks_tag(m), F.size(M.all_but_last(m)), F.size(M.last(m, 2)), M.last_of(m)).collect()
    assert got[0][0] == [] and got[0][1] and got[0][2] == 3 and got[0][3] == 2 and got[0][4].startswith("a ")
    assert set(got[1][0]) == {"trop_court", "sans_assistant", "alternance", "message_vide"}
    assert "trop_court" in got[2][0] and got[3][1] is None
    assert df.select(M.transcript(m, {"user": "P"})).first()[0] == "P : u\nP : v"
    assert df.select(M.chatml(m, "assistant")).first()[0].count("generation") == 2
    made = df.limit(1).select(M.as_training("sys", F.filter(m, lambda x: x["role"] != "system"), {"user": "user"}, F.lit("fin"))).first()[0]
    assert [x["role"] for x in made] == ["system", "user", "assistant", "user", "assistant"] and made[-1]["content"] == "fin"
    asks = spark.createDataFrame([([("assistant", "ok."), ("assistant", "quoi ?"), ("user", "x"), ("assistant", "où ?")],)], MSG)
    assert asks.select(M.trailing_run(m, "assistant", r"\?$")).first()[0] == 2


def test_json(spark):
    df = spark.createDataFrame([('bla {"a": "x", "b": 2} reste',), ("rien",), (None,)], "t string")
    got = df.select(M.first_json(F.col("t"), "struct<a:string,b:int>").alias("j")).select("j.value.a", "j.erreur").collect()
    assert tuple(got[0]) == ("x", None) and got[1][1] == "rien" and got[2][0] is None
    nested = "struct<a:array<struct<p:int,q:int>>,b:struct<c:string,d:string>>"
    raw = [('x {"a": [{"p": 1, "q": 2}], "b": {"c": "u", "d": "v"}} y',), ('{"z": 1}',), ('{"a": [',)]
    got = spark.createDataFrame(raw, "t string").select(M.first_json(F.col("t"), nested).alias("j")).select("j.value.a", "j.value.b.d", "j.erreur").collect()
    assert got[0][0][0]["q"] == 2 and got[0][1:] == ("v", None) and got[1][2] is None and got[2][2] == '{"a": ['
    array = '[{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]'
    assert [r[0] for r in spark.createDataFrame([(array,), ("plain",), (None,)], "t string").select(M.answer_text(F.col("t"))).collect()] == ["r", "plain", None]
