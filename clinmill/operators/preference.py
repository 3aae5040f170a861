"""Preference pairs: candidates, selection by rules or scores, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinmill.functions.text import seeded, stripped

LETTERS = "ABCDEFGH"


def distinct_candidates(df: DataFrame, context: list[str], text: str, reference: str, order: str) -> DataFrame:
    """Per context one candidate per stripped text, the reference before others, then first in order."""
    w = Window.partitionBy(*context, stripped(F.col(text))).orderBy(F.desc(reference), order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def lettered(df: DataFrame, context: list[str], order: str, seed: int = 42, most: int = 8) -> DataFrame:
    """Candidates of a context in seeded order with letters; at most ``most`` (the judge's form has no more)."""
    w = Window.partitionBy(*context).orderBy(seeded(seed, *context, order), order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).withColumn("lettre", F.get(F.array(*map(F.lit, LETTERS)), F.col("_r") - 1)).drop("_r")


def judge_problems(letters: Column, notes: Column, expected: Column) -> Column:
    """Problems of a judge's reply: letters that differ from those expected, notes outside 1 to 5."""
    return F.array_compact(
        F.array(
            F.when(F.array_sort(F.array_distinct(letters)) != F.array_sort(expected), "lettres"),
            F.when(~F.forall(notes, lambda n: n.between(1, 5)), "notes"),
        )
    )


def pairs_by_score(df: DataFrame, context: list[str], total: str, reference: str, safe: str, order: str, gap: int = 3) -> DataFrame:
    """Best and worst candidate of each context.

    Best: highest total, the reference first on ties, then first in order.
    Worst: an unsafe one if there is one, else the lowest total, the reference
    last on ties.  ``raison`` says why a context gives no pair.
    """
    best = F.max_by(order, F.struct(F.col(total).alias("t"), F.col(reference).cast("int").alias("r"), (-F.col(order)).alias("o")))
    key = F.struct(F.col(safe).cast("int").alias("s"), F.col(total).alias("t"), F.col(reference).cast("int").alias("r"), F.col(order).alias("o"))
    per = df.groupBy(*context).agg(
        best.alias("choisi"), F.min_by(order, key).alias("rejete"), F.max(total).alias("t_max"), F.min_by(total, key).alias("t_min"), F.min(F.col(safe).cast("int")).alias("sur"), F.count(F.lit(1)).alias("n")
    )
    reason = (
        F.when(F.col("n") < 2, "un_seul_candidat").when(F.col("choisi") == F.col("rejete"), "un_seul_candidat")
        .when((F.col("sur") == 1) & (F.col("t_max") - F.col("t_min") < gap), "ecart_trop_faible")
    )
    return per.withColumn("raison", reason).drop("sur", "n")


def pairs_by_rules(df: DataFrame, context: list[str], defects: str, severity: list[str], order: str, seed: int = 42) -> DataFrame:
    """Per context the candidate with the gravest defect (seeded among equals), or the reason for none."""
    rank = F.array_min(F.transform(defects, lambda d: F.coalesce(*(F.when(d == s, i) for i, s in enumerate(severity)))))
    rows = df.withColumn("_g", rank)
    w = Window.partitionBy(*context).orderBy(F.col("_g").asc_nulls_last(), seeded(seed, *context, order), order)
    first = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.select(*context, F.when(F.col("_g").isNotNull(), F.col(order)).alias("rejete"), F.get(F.array(*map(F.lit, severity)), F.col("_g")).alias("defaut"), F.when(F.col("_g").isNull(), "aucune_reponse_fautive").alias("raison"))


def usable(df: DataFrame) -> DataFrame:
    """Pairs that a person validated and whose answers differ."""
    return df.where((F.col("a_valider").cast("boolean")) & (stripped(F.col("chosen")) != stripped(F.col("rejected"))))


def swapped(df: DataFrame, when: Column, a: str = "chosen", b: str = "rejected") -> DataFrame:
    """The two columns exchanged in the rows that meet a condition."""
    w = F.coalesce(when, F.lit(False))
    return df.withColumns({a: F.when(w, F.col(b)).otherwise(F.col(a)), b: F.when(w, F.col(a)).otherwise(F.col(b))})


def presented_swapped(seed: int, key: str) -> Column:
    """Whether a blind review shows a pair the other way round."""
    return F.conv(F.substring(seeded(seed, key), 1, 4), 16, 10).cast("int") % 2 == 1


def reviewed(pairs: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Pairs after review.  Decisions: (key, decision) valider, inverser,
    rejeter or remettre; the state before a reset is kept in ``historique``."""
    rows = pairs.join(decisions.select(key, "decision"), key, "left")
    rows = swapped(rows, F.col("decision") == "inverser")
    state = F.when(F.col("decision").isin("valider", "inverser"), True).when(F.col("decision") == "rejeter", False).when(F.col("decision") == "remettre", F.lit(None)).otherwise(F.col("a_valider").cast("boolean"))
    past = F.coalesce(F.col("historique"), F.array().cast("array<boolean>")) if "historique" in pairs.columns else F.array().cast("array<boolean>")
    return rows.withColumn("historique", F.when(F.col("decision") == "remettre", F.array_append(past, F.col("a_valider").cast("boolean"))).otherwise(past)).withColumn("a_valider", state).drop("decision")


def progress(df: DataFrame, state: str = "a_valider") -> DataFrame:
    s = F.col(state).cast("boolean")
    return df.agg(F.count_if(s).alias("validees"), F.count_if(~s).alias("rejetees"), F.count_if(s.isNull()).alias("restantes"))
