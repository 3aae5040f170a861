from pyspark.sql import functions as F

from clinmill.streaming import conversations

TURNS = [("a", 0, "user", "bonjour"), ("a", 1, "assistant", "oui"), ("a", 2, "user", "une convulsion"), ("a", 3, "user", "encore une convulsion"), ("b", 0, "user", "rien")]
SCHEMA = "conversation string, tour bigint, role string, texte string"


def find(text):
    return ["neuro"] if "convulsion" in text else []


def test_decisions_and_journal(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame(TURNS[:2], SCHEMA).write.json(src)

    def run():
        stream = spark.readStream.schema(SCHEMA).json(src)
        conversations.journal(conversations.decisions(stream, find), out, check).awaitTermination(120)

    run()
    spark.createDataFrame(TURNS[2:], SCHEMA).write.mode("append").json(src)
    run()
    run()  # nothing new, nothing twice
    got = [tuple(r) for r in spark.read.schema("conversation string, tour long, source string").json(out).collect()]
    assert got == [("a", 2, "plancher")]


def test_resumable(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(3).write.parquet(src)
    for _ in range(2):
        conversations.resumable(spark.readStream.schema("id bigint").parquet(src), lambda b: b.select((F.col("id") * 2).alias("x")), out, check).awaitTermination(120)
    spark.range(3, 5).write.mode("append").parquet(src)
    conversations.resumable(spark.readStream.schema("id bigint").parquet(src), lambda b: b.select((F.col("id") * 2).alias("x")), out, check).awaitTermination(120)
    assert sorted(r["x"] for r in spark.read.parquet(out + "/*").collect()) == [0, 2, 4, 6, 8]


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:06:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted((r["n"], r["somme"]) for r in conversations.windowed_counts(df).collect()) == [(1, 4.0), (2, 3.0)]
