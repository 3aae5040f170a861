"""Classifier metrics with intervals, from one confusion matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinmill.functions.numeric import wilson


def confusion(df: DataFrame, truth: Column, pred: Column, n_classes: int) -> DataFrame:
    """(vrai, predit, n) for all pairs of classes, zeros included."""
    counts = df.select(truth.cast("int").alias("vrai"), pred.cast("int").alias("predit")).where("vrai is not null and predit is not null").groupBy("vrai", "predit").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(n_classes * n_classes).select((F.col("id") / n_classes).cast("int").alias("vrai"), (F.col("id") % n_classes).cast("int").alias("predit"))
    return grid.join(counts, ["vrai", "predit"], "left").fillna(0, ["n"])


def metrics(matrix: DataFrame, n_classes: int) -> DataFrame:
    """Long form (mesure, classe, valeur, bas, haut): accuracy, recall per
    class, macro F1 over the classes present, rates of predictions above and
    below the true class, with Wilson intervals where they are shares."""
    total = F.sum("n")
    hit = F.sum(F.when(F.col("vrai") == F.col("predit"), F.col("n")).otherwise(0))
    cols = [total.alias("total"), hit.alias("juste")]
    cols += [F.sum(F.when(F.col("predit") > F.col("vrai"), F.col("n")).otherwise(0)).alias("dessous"), F.sum(F.when(F.col("predit") < F.col("vrai"), F.col("n")).otherwise(0)).alias("dessus")]
    for k in range(n_classes):
        cols += [
            F.sum(F.when((F.col("vrai") == k) & (F.col("predit") == k), F.col("n")).otherwise(0)).alias(f"tp{k}"),
            F.sum(F.when(F.col("vrai") == k, F.col("n")).otherwise(0)).alias(f"t{k}"), F.sum(F.when(F.col("predit") == k, F.col("n")).otherwise(0)).alias(f"p{k}"),
        ]
    one = matrix.agg(*cols)
    f1 = [F.when(F.col(f"t{k}") + F.col(f"p{k}") > 0, 2 * F.col(f"tp{k}") / (F.col(f"t{k}") + F.col(f"p{k}"))) for k in range(n_classes)]
    there = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in f1), F.lit(0))
    macro = sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0)) / F.nullif(there, F.lit(0))

    def row(name: str, cls: int | None, k: Column, n: Column) -> Column:
        w = wilson(k, n)
        return F.struct(F.lit(name).alias("mesure"), F.lit(cls).cast("int").alias("classe"), F.round(F.try_divide(k, n), 4).alias("valeur"), w["bas"].alias("bas"), w["haut"].alias("haut"))

    rows = [row("exactitude", None, F.col("juste"), F.col("total")), row("sous_estimation", None, F.col("dessous"), F.col("total")), row("sur_estimation", None, F.col("dessus"), F.col("total"))]
    rows += [row("rappel", k, F.col(f"tp{k}"), F.col(f"t{k}")) for k in range(n_classes)]
    rows.append(F.struct(F.lit("macro_f1").alias("mesure"), F.lit(None).cast("int").alias("classe"), F.round(macro, 4).alias("valeur"), F.lit(None).cast("double").alias("bas"), F.lit(None).cast("double").alias("haut")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def style_pairs(df: DataFrame, case: str, style: str, truth: str, pred: str) -> DataFrame:
    """Per style: recognised and all, and in one more row how many cases change decision with style."""
    per = df.groupBy(F.col(style).alias("style")).agg(F.count_if(F.col(truth) == F.col(pred)).alias("reconnus"), F.count(F.lit(1)).alias("total"))
    change = df.groupBy(case).agg(F.min(pred).alias("a"), F.max(pred).alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("reconnus"), F.count(F.lit(1)).alias("total"))
    return per.unionByName(change.select(F.lit("_decision_change").alias("style"), "reconnus", "total"))
