"""Counts, histograms, cross tables, quantiles by index and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinmill.functions.numeric import by_index
from clinmill.functions.text import before


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def reason_histogram(df: DataFrame, reasons: str, mark: str = " : ") -> DataFrame:
    """How often each reason occurs in arrays of ``reason : detail``."""
    return df.select(F.explode(reasons).alias("r")).select(before(F.col("r"), mark).alias("raison")).groupBy("raison").agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of column values per row value; ``values`` fixes the columns, so one pass is enough."""
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).fillna(0)


def shares(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Counts and percentages per value."""
    per = value_counts(df, column)
    return per.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), digits))


def top_with_histogram(df: DataFrame, key: str, label: str, k: int = 10) -> DataFrame:
    """The k most frequent keys with a histogram of labels as ``label=n`` in order."""
    cell = df.groupBy(key, F.coalesce(F.col(label).cast("string"), F.lit("?")).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    hist = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l", "n"))), lambda x: F.concat(x["l"], F.lit("="), x["n"].cast("string"))), ",")
    return cell.groupBy(key).agg(F.sum("n").alias("n"), hist.alias("histogramme")).orderBy(F.desc("n"), key).limit(k)


def quantile_by_index(df: DataFrame, value: Column, q: float, groups: list[str]) -> DataFrame:
    """The element at index int(q * (n - 1)) of the sorted values of a group.

    Values are counted first and the index is found in the running counts of
    distinct values, so no group is gathered.
    """
    per = df.select(*groups, value.alias("v")).where("v is not null").groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*groups)
    upto = per.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    return upto.where(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1))).groupBy(*groups).agg(F.min("v").alias("quantile"), F.max("n").alias("n"))


def length_summary(df: DataFrame, value: Column, groups: list[str]) -> DataFrame:
    """Least, upper median, 95 % by index and largest value per group."""
    base = df.withColumn("_v", value)
    q = {name: quantile_by_index(base, F.col("_v"), x, groups).select(*groups, F.col("quantile").alias(name)) for name, x in (("p95", 0.95),)}
    per = base.where("_v is not null").groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*groups)
    upto = per.withColumn("upto", F.sum("c").over(w.orderBy("_v"))).withColumn("n", F.sum("c").over(w))
    mid = upto.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*groups).agg(F.min("_v").alias("mediane"))
    ends = base.groupBy(*groups).agg(F.min("_v").alias("mini"), F.max("_v").alias("maxi"), F.avg("_v").alias("moyenne"))
    return ends.join(mid, groups).join(q["p95"], groups)


def small_list_quantile(values: Column, q: float, default: float) -> Column:
    """The same over one array; the default for an empty one."""
    return F.coalesce(by_index(F.sort_array(values), q), F.lit(default))


def profile(df: DataFrame, columns: list[str], longest: int = 60, most: int = 30) -> DataFrame:
    """Columns of few short values: (colonne, valeur, n), if they have more than one and fewer than ``most``."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("colonne"), F.col(c).cast("string").alias("valeur")) for c in columns))).alias("x")).select("x.*")
    per = long.where((F.length("valeur") < longest)).groupBy("colonne", "valeur").agg(F.count(F.lit(1)).alias("n"))
    kinds = per.groupBy("colonne").agg(F.count(F.lit(1)).alias("k")).where((F.col("k") > 1) & (F.col("k") < most)).select("colonne")
    return per.join(F.broadcast(kinds), "colonne")  # a row per column


def run_summary(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: the number of rows and of those that meet each condition."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def token_share(df: DataFrame, learned: Column, total: Column) -> DataFrame:
    """Mean, median and overall share of learned tokens, and rows with none."""
    ratio = F.when(total > 0, learned / total)
    return df.agg(F.avg(ratio).alias("part_moyenne"), F.median(ratio).alias("part_mediane"), (F.sum(learned) / F.sum(total)).alias("part_totale"), F.count_if(learned == 0).alias("n_vides"))


def overlapping(spans: Column, start: Column, end: Column) -> Column:
    """Those of an array of struct(start, end) that overlap an interval."""
    return F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def islands(df: DataFrame, key: str, position: str, flag: str) -> DataFrame:
    """Runs of consecutive flagged positions: (key, debut, fin, n)."""
    w = Window.partitionBy(key).orderBy(position)
    g = df.where(F.col(flag)).withColumn("_g", F.col(position) - F.row_number().over(w))
    return g.groupBy(key, "_g").agg(F.min(position).alias("debut"), F.max(position).alias("fin"), F.count(F.lit(1)).alias("n")).drop("_g")
