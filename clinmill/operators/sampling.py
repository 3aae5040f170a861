"""Seeded samples, group splits, resumption and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinmill.functions.text import seeded


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """min(n, rows) rows without replacement: the first in seeded order (a bounded top-n, no full sort)."""
    return df.withColumn("_k", seeded(seed, key)).orderBy("_k", key).limit(n).drop("_k")


def group_split(df: DataFrame, group: str, ratio: float, seed: int = 42, least: int = 10) -> DataFrame:
    """Adds ``jeu``: whole groups in train or validation.

    The validation groups are the first max(1, round(n * ratio)) in seeded
    order, none below ``least`` groups; null groups are train.  Distinct groups
    are counted by the first digits of their key; only those that share the digits
    at which the wanted number is reached are ranked.
    """
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_k", seeded(seed, group)).withColumn("_d", F.substring("_k", 1, 4))
    counts = groups.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).orderBy("_d").collect()  # at most 65,536 rows
    n = sum(r["n"] for r in counts)
    wanted = max(1, int(round(n * ratio))) if n >= least else 0
    edge, before = "", 0
    for r in counts:
        edge = r["_d"]
        if before + r["n"] >= wanted:
            break
        before += r["n"]
    if not wanted:
        return df.withColumn("jeu", F.lit("train"))
    below = groups.where(F.col("_d") < edge).select(group)
    ranked = groups.where(F.col("_d") == edge).orderBy("_k", group).limit(wanted - before).select(group)
    chosen = below.unionByName(ranked).withColumn("jeu", F.lit("validation"))
    return df.join(chosen, group, "left").withColumn("jeu", F.coalesce("jeu", F.lit("train")))


def leaks(df: DataFrame, group: str, split: str = "jeu") -> DataFrame:
    """Groups that are in several splits."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b").select(group)


def pending(todo: DataFrame, done: DataFrame, keys: list[str], failed: str | None = None) -> DataFrame:
    """Rows whose key isn't done; with ``failed`` (a column of ``done``), failures are to be done again."""
    over = done if failed is None else done.where(F.col(failed).isNull())
    return todo.join(over.select(*keys).distinct(), keys, "left_anti")


def last_success(df: DataFrame, keys: list[str], attempt: str, failed: str) -> DataFrame:
    """Of several attempts the last success, else the last failure."""
    w = Window.partitionBy(*keys).orderBy(F.col(failed).isNotNull(), F.desc(attempt))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def variants(df: DataFrame, label: str, counts: dict[str, int]) -> DataFrame:
    """A row per variant 0..n-1 of each row, n by its label; none for other labels."""
    n = F.coalesce(*(F.when(F.col(label) == k, v) for k, v in counts.items()), F.lit(0))
    return df.withColumn("_n", n).where("_n > 0").withColumn("variante", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def parse_variants(text: str, default: dict[str, int]) -> dict[str, int]:
    """``cat=n,...`` over the defaults; ValueError for an unknown category or number."""
    out = dict(default)
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, n = part.partition("=")
        if name.strip() not in default or not n.strip().isdigit():
            raise ValueError(f"not a variant: {part}")
        out[name.strip()] = int(n)
    return out


def union(*parts: DataFrame) -> DataFrame:
    """Sources of different columns as one; what a source lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
