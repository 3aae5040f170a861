"""Exact and case-level deduplication with a log of what became of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinmill.functions.text import case_fingerprint, stripped


def keyed(df: DataFrame, text: str = "contexte_clinique", key: str = "id", order: str = "ord") -> DataFrame:
    """Adds ``cas_id`` (rows without text are a case of their own)."""
    has = F.coalesce(stripped(F.col(text)), F.lit("")) != ""
    return df.withColumn("cas_id", F.when(has, case_fingerprint(F.col(text))).otherwise(F.concat(F.lit("sans_contexte_"), F.col(key).cast("string"))))


def exact(df: DataFrame, text: str, key: str, order: str, with_ids: bool = False) -> DataFrame:
    """One row per distinct text: first row in order, its case, number of rows.

    Null texts and texts of white space are never grouped.  ``with_ids`` adds
    all ids in order as one array; where a text may have very many copies, use
    ``correspondence``, which has a row per id instead.
    """
    rows = keyed(df.select(F.col(key), F.col(text), F.col(order)), text, key, order)
    lone = F.col("cas_id").startswith("sans_contexte_")
    # copies meet by the hash of the text, not the text
    group = F.when(lone, F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.sha2(F.col(text), 256))
    aggs = [F.min_by(key, order).alias("conserve"), F.min("cas_id").alias("cas_id"), F.min(order).alias("premier"), F.count(F.lit(1)).alias("n_questions")]
    if with_ids:
        listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"))))
        aggs.append(F.transform(listed, lambda x: x["k"]).alias("ids_questions"))
    return rows.groupBy(group.alias("groupe")).agg(*aggs).drop("groupe")


def correspondence(df: DataFrame, text: str, key: str, order: str) -> DataFrame:
    """What became of every row: (id, conserve, cas_id, raison), by window so that no group is gathered."""
    rows = keyed(df.select(F.col(key), F.col(text), F.col(order)), text, key, order)
    lone = F.col("cas_id").startswith("sans_contexte_")
    rows = rows.withColumn("g", F.when(lone, F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.sha2(F.col(text), 256)))
    firsts = rows.groupBy("g").agg(F.min_by(key, order).alias("conserve"))
    reason = F.when(lone, "sans_contexte").when(F.col(key) == F.col("conserve"), "conserve").otherwise("texte_identique")
    return rows.join(firsts, "g").select(F.col(key).alias("id"), "conserve", "cas_id", reason.alias("raison"))


def variants(df: DataFrame, text: str, key: str, order: str) -> DataFrame:
    """Cases with several texts: (cas_id, n_textes, n_lignes)."""
    rows = keyed(df, text, key, order).where(~F.col("cas_id").startswith("sans_contexte_"))
    per = rows.groupBy("cas_id", F.sha2(F.col(text), 256).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("cas_id").agg(F.count(F.lit(1)).alias("n_textes"), F.sum("n").alias("n_lignes")).where("n_textes > 1")


def shortest(df: DataFrame, text: str, key: str, order: str, pinned: list[str] | None = None) -> DataFrame:
    """One row per case: a pinned one, else that with the shortest text, first in order on ties."""
    rows = keyed(df.select(F.col(key), F.col(text), F.col(order)), text, key, order)
    rank = F.struct((~F.col(key).cast("string").isin(*(pinned or ["\x00"]))).alias("p"), F.coalesce(F.length(text), F.lit(0)).alias("l"), F.col(order).alias("o"))
    return rows.groupBy("cas_id").agg(F.min_by(key, rank).alias("conserve"), F.min(rank)["l"].alias("longueur"), F.count(F.lit(1)).alias("n_lignes"))


def filter_stability(df: DataFrame, decisions: DataFrame, text: str, key: str, order: str) -> DataFrame:
    """Per case how many of its rows a filter kept and left out, and whether it was of two minds.

    ``decisions`` has the key and ``retenu``; the join is by id.
    """
    rows = keyed(df.select(F.col(key), F.col(text), F.col(order)), text, key, order)
    per = rows.join(decisions.select(key, "retenu"), key).groupBy("cas_id").agg(F.count_if("retenu").alias("retenues"), F.count_if(~F.col("retenu")).alias("exclues"))
    return per.withColumn("instable", (F.col("retenues") > 0) & (F.col("exclues") > 0))


def report(df: DataFrame, text: str, key: str, order: str) -> DataFrame:
    """Totals in one row: rows, rows without text, distinct texts, cases, largest group of copies, cases with several texts."""
    rows = keyed(df, text, key, order)
    lone = F.col("cas_id").startswith("sans_contexte_")
    per = rows.groupBy("cas_id", F.when(lone, F.col(key).cast("string")).otherwise(F.sha2(F.col(text), 256)).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    case = per.groupBy("cas_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("textes"), F.max("n").alias("plus"))
    lone = F.col("cas_id").startswith("sans_contexte_")
    return case.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_lignes"), F.coalesce(F.sum(F.when(lone, F.col("n"))), F.lit(0)).alias("n_sans_contexte"),
        F.coalesce(F.sum(F.when(~lone, F.col("textes"))), F.lit(0)).alias("n_textes"), F.count_if(~lone).alias("n_cas"),
        F.coalesce(F.max(F.when(~lone, F.col("plus"))), F.lit(0)).alias("plus_grand_groupe"), F.count_if(~lone & (F.col("textes") > 1)).alias("n_cas_a_variantes"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_difference(a: str, b: str):
    """Position from 0 where two strings first differ, -1 if they are equal; null
    for null.  The length of the common prefix is found bit by bit."""
    x, y = F.col(a), F.col(b)
    n = F.least(F.length(x), F.length(y))

    def step(lo, bit):
        longer = (lo + bit).cast("int")
        same = F.substr(x, lo + 1, bit.cast("int")) == F.substr(y, lo + 1, bit.cast("int"))
        return F.when((longer <= n) & same, longer).otherwise(lo)

    bits = F.array(*(F.lit(1 << k) for k in range(29, -1, -1)))
    return F.when(x == y, -1).when(x.isNotNull() & y.isNotNull(), F.aggregate(bits, F.lit(0), step))
