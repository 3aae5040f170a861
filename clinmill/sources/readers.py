"""Scans: JSON lines, local files by suffix, XML pages, catalogues."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clinmill.operators.dedup import first_per_key


def json_lines(spark: SparkSession, path: str | list[str], schema: str | StructType | None = None, strict: bool = False, key: str = "id") -> DataFrame:
    """JSON lines, blank lines skipped.

    Strict: a line that can't be read or has no key fails the job when it is
    read, and the error gives the file and the line; lenient: such fields are
    null.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.json(path)
    if not strict:
        return df
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_name").alias("_f"))
    rows = lines.withColumn("_v", F.from_json("value", df.schema)).withColumn("_bad", F.json_object_keys("value").isNull() | F.col(f"_v.{key}").isNull())
    told = F.raise_error(F.concat(F.lit(f"row without {key}, or unreadable: "), "_f", F.lit(": "), F.substring("value", 1, 200)))
    return rows.select(*(F.when(F.col("_bad"), told.cast(f.dataType)).otherwise(F.col(f"_v.{f.name}")).alias(f.name) if f.name == key else F.col(f"_v.{f.name}") for f in df.schema.fields))


def by_suffix(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """.jsonl, .json (one document) or .parquet; ValueError for others."""
    suffix = PurePosixPath(path).suffix
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".jsonl":
        return reader.json(path)
    if suffix == ".json":
        return reader.option("multiLine", "true").json(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {suffix or 'a file without suffix'}: {path}")


def question_pages(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """XML pages of question and answer pairs in sub-folders of ``folder``.

    Columns: id, dossier, focus, cui (array), question, qtype, answer.  Codes
    are found at any depth, so both layouts of the pages are read.  Malformed
    files give no row, neither do blank questions.  ``include`` reads only those
    sub-folders; otherwise all but ``exclude``.
    """
    paths = [f"{folder}/{d}/*.xml" for d in include] if include else f"{folder}/*/*.xml"
    text = spark.read.text(paths, wholetext=True).select(F.col("value"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("dossier"))
    if not include and exclude:
        text = text.where(~F.col("dossier").isin(*exclude))
    schema = "struct<_id:string,Focus:string,QAPairs:struct<QAPair:array<struct<_pid:string,Question:struct<_VALUE:string,_qtype:string>,Answer:string>>>>"
    whole = text.where(F.col("value").rlike(r"</Document>\s*$"))
    doc = whole.withColumn("d", F.from_xml("value", schema)).withColumn("cui", F.regexp_extract_all("value", F.lit(r"<CUI>\s*([^<\s]+)\s*</CUI>"), F.lit(1)))
    pair = doc.select("dossier", "cui", F.col("d._id").alias("doc"), F.trim("d.Focus").alias("focus"), F.explode("d.QAPairs.QAPair").alias("p"))
    return pair.select(
        F.concat_ws("_", "doc", F.col("p._pid")).alias("id"), "dossier", "focus", "cui", F.trim("p.Question._VALUE").alias("question"), F.col("p.Question._qtype").alias("qtype"), F.trim("p.Answer").alias("answer")
    ).where(F.coalesce("question", F.lit("")) != "")


def catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A rule catalogue (one JSON document) as its motifs and their modifiers."""
    doc = spark.read.option("multiLine", "true").json(path)
    motif = doc.select(F.explode("motifs").alias("m")).select("m.*")
    modifier = motif.select(F.col("id").alias("motif"), F.explode("modulateurs").alias("x")).select("motif", "x.critere", "x.tri")
    return motif.drop("modulateurs"), modifier


def first_examples(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first example of each key."""
    return first_per_key(df, keys, [order])


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows spread in seeded order, as a range partitioning by a hash of the key."""
    from clinmill.functions.text import seeded

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_k", seeded(seed, key)).repartitionByRange(n, "_k").sortWithinPartitions("_k").drop("_k")
