import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clinmill.sources import readers, sinks


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "é")], "id string, t string")
    path = str(tmp_path / "o")
    sinks.json_lines(df, path, dry=True)
    sinks.json_lines(df, path)
    back = readers.json_lines(spark, path, "id string, t string", strict=True)
    assert sorted(map(tuple, back.collect())) == [("a", None), ("b", "é")]
    assert '"t":null' in "".join(p.read_text() for p in (tmp_path / "o").glob("*.json"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.json_lines(df, path)
    sinks.json_lines(df, path, force=True)
    with pytest.raises(ValueError, match="same"):
        sinks.json_lines(df, path, source=path + "/")
    sinks.append(df, path)
    assert readers.json_lines(spark, path, "id string").count() == 4


def test_strict_and_lenient(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"id": "a"}\n\n{"nom": "b"}\n')
    assert readers.json_lines(spark, str(f), "id string").count() == 2
    with pytest.raises(Exception, match="row without id"):
        readers.json_lines(spark, str(f), "id string", strict=True).collect()


def test_by_suffix(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}]))
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    assert [readers.by_suffix(spark, str(tmp_path / n)).count() for n in ("a.jsonl", "a.json", "a.parquet")] == [2, 1, 3]
    with pytest.raises(ValueError, match="no reader"):
        readers.by_suffix(spark, "x.csv")


PAGE = """<?xml version="1.0"?><Document id="{}"><Focus> Asthma </Focus>{}<QAPairs><QAPair pid="1"><Question qtype="info"> What? </Question><Answer> That. </Answer></QAPair>
<QAPair pid="2"><Question qtype="x"> </Question><Answer>z</Answer></QAPair></QAPairs></Document>"""


def test_question_pages(spark, tmp_path):
    for d, n, codes in (("one", "1", "<UMLS><CUI>C1</CUI></UMLS>"), ("two", "2", "<FocusAnnotations><UMLS><CUIs><CUI>C2</CUI><CUI>C3</CUI></CUIs></UMLS></FocusAnnotations>")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "p.xml").write_text(PAGE.format(n, codes))
    (tmp_path / "one" / "bad.xml").write_text("<Document><QAPairs>")
    got = {r["id"]: r for r in readers.question_pages(spark, str(tmp_path)).collect()}
    assert set(got) == {"1_1", "2_1"} and got["2_1"]["cui"] == ["C2", "C3"] and got["1_1"]["question"] == "What?" and got["1_1"]["dossier"] == "one"
    assert readers.question_pages(spark, str(tmp_path), exclude=("two",)).count() == 1
    assert readers.question_pages(spark, str(tmp_path), include=["two"]).count() == 1


def test_catalogue(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"motifs": [{"id": "m", "libelle": "M", "modulateurs": [{"critere": "c", "tri": "1"}]}, {"id": "n", "libelle": "N", "modulateurs": []}]}))
    motif, modifier = readers.catalogue(spark, str(f))
    assert motif.count() == 2 and [tuple(r) for r in modifier.collect()] == [("m", "c", "1")]


def test_divided_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, u boolean")
    sinks.divided(df, str(tmp_path / "d"), F.col("u"))
    assert spark.read.json(str(tmp_path / "d" / "retenu=true")).count() == 1 and spark.read.json(str(tmp_path / "d" / "retenu=false")).count() == 2
    sinks.by_split(df.withColumn("jeu", F.lit("train")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "jeu=train").exists()


def test_csv_documents_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", "x;y", 1), ("b", None, 2)], "id string, t string, n int")
    assert sinks.review_csv(df, str(tmp_path / "r.csv"), ["id", "t"], key="id") == 2
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid;t") and b'"x;y"' in raw and (tmp_path / "r.csv.ids").read_text() == "a\nb"
    sinks.document({"é": 1}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"é": 1}
    p = sinks.versioned(df, str(tmp_path / "v"), datetime(2024, 1, 2))
    assert p.endswith("version=20240102T000000") and spark.read.parquet(p).count() == 2
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "f").write_text("1")
    out = sinks.backup([str(tmp_path / "src")], str(tmp_path / "bk"), datetime(2024, 1, 2))
    assert out.endswith("20240102_000000")


def test_first_and_shuffled(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "k string, o int")
    assert sorted(map(tuple, readers.first_examples(df, ["k"], "o").collect())) == [("a", 1), ("b", 1)]
    assert readers.shuffled(df, "o").count() == 3
