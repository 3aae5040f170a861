"""Splits that keep related records together.

Records and the entities they name (a patient case, another record) form a
bipartite graph.  A record with a case is first contracted into that case, so
only links between cases are left to propagate; minimum labels then spread over
the bipartite graph until they are settled (``components``).  Whole groups are
assigned to splits so that each label keeps the wanted proportions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinmill.llm.components import connected
from clinmill.runtime import cut

#: Spellings of the delivered splits.
SPLITS = {"train": ("train", "entrainement"), "validation": ("validation", "valid", "dev"), "test": ("test",)}
#: Groups with more than this share of the records are assigned first, together.
GIANT = 1000
#: Records of one block of smaller groups, assigned by one task.
BLOCK = 20_000
#: A label with at least one in so many records is a stratum; all rarer ones are one together.
RARE = 1000
#: Sizes of groups (of the same power of two) that are balanced like labels are; larger ones are one class.
SIZES = 24


def normal_split(value: Column) -> Column:
    """train, validation or test, whatever the case and outer blanks; else null."""
    plain = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for name, spellings in SPLITS.items():
        out = F.when(plain.isin(*spellings), name).otherwise(out)
    return out


def case_key(value: Column) -> Column:
    """The twelve hexadecimal digits of a case id, however written; else null."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(value), "[^0-9a-z]", ""), "^cas", "")
    return F.when(digits.rlike("^[0-9a-f]{12}$"), digits)


def record_groups(df: DataFrame, id_col: str = "id", case_col: str = "cas_id", named_col: str = "ids_questions") -> DataFrame:
    """(id, root): which records belong together.

    Records are linked by the same case or if one names the other; this carries
    over.  Repeated rows count once; a record without a case and links is a
    group of its own; named ids that no record has link nothing; null ids are
    dropped.  The result is cut from its lineage.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), case_key(F.col(case_col)).alias("case"), F.col(named_col).alias("named")).where("id is not null")
    home = cut(rows.groupBy("id").agg(F.coalesce(F.concat(F.lit("c:"), F.min("case")), F.concat(F.lit("r:"), F.col("id"))).alias("home")))
    # a record that was delivered with two cases links both
    cases = rows.where("case is not null").select("id", F.concat(F.lit("c:"), "case").alias("entity"))
    named = rows.where(F.size("named") > 0).select("id", F.explode("named").alias("other")).where("other is not null and other <> id").distinct()
    other = home.select(F.col("id").alias("other"), F.col("home").alias("entity"))
    edges = named.join(other, "other").select("id", "entity").unionByName(cases).join(home, "id").where("home <> entity")
    label = connected(edges.select(F.col("home").alias("src"), F.col("entity").alias("dst")))
    return home.join(label.withColumnRenamed("node", "home"), "home", "left").select("id", F.coalesce("root", "home").alias("root"))


def divided(df: DataFrame, id_col: str = "id", split_col: str = "split", **cols: str) -> DataFrame:
    """(id, groupe_id) of all records in groups whose non-null splits differ;
    the group is named by its smallest id."""
    groups = cut(record_groups(df, id_col, **cols))
    seen = df.select(F.col(id_col).cast("string").alias("id"), normal_split(F.col(split_col)).alias("s")).where("s is not null").distinct()
    mixed = seen.join(groups, "id").groupBy("root").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("root")
    members = groups.join(mixed, "root")
    name = members.groupBy("root").agg(F.min("id").alias("groupe_id"))
    return members.join(name, "root").select("id", "groupe_id")


def place(sizes: np.ndarray, target: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Give each group (rows of label counts, largest first) to a split.

    A group goes where the chi-square distance of the counts from their targets
    (splits x strata) grows least, so that all splits fill at one pace and get
    their share of large groups too; ties go to the split that lacks most.
    ``held`` is updated.
    """
    weight = 1.0 / (np.maximum(target.sum(0), 1.0) * np.maximum(target, 0.5))
    out = np.zeros(len(sizes), np.int64)
    for i, v in enumerate(sizes):
        lack = target - held
        gain = ((v * weight) * (2 * lack - v)).sum(1)
        total = lack.sum(1)
        out[i] = np.lexsort((-total, -gain))[0]
        held[out[i]] += v
    return out


def assign(df: DataFrame, proportions: dict[str, float], label_col: str = "specialite", id_col: str = "id", **cols: str) -> DataFrame:
    """(id, groupe_id, strate, taille, split_nouveau): new splits, no group divided.

    ``proportions`` need not sum to one.  Strata are the labels and the classes
    of group sizes, so that each split gets its share of every label and of large
    groups as of single records.  A group of more than a thousandth of the records
    (there are fewer than a thousand) is placed first, on the driver; the others
    in blocks of about ``BLOCK`` records, each towards what the giants leave of
    every stratum, to within a record or so per stratum and block.  Null labels
    are a label of their own.  The same input gives the same splits.
    """
    names = list(proportions)
    share = np.array([proportions[k] for k in names], float)
    share /= share.sum()
    groups = record_groups(df, id_col, **cols)
    label = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    n = label.count()
    often = label.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * RARE >= n).select("label")  # at most RARE rows
    labels = label.join(F.broadcast(often.withColumn("strate", F.col("label"))), "label", "left")
    records = cut(groups.join(labels.select("id", F.coalesce("strate", F.lit("(rares)")).alias("strate")), "id"))
    per = records.groupBy("root", "strate").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    whole = cut(
        per.groupBy("root").agg(F.sum("n").alias("size"), F.min("least").alias("groupe_id"), F.map_from_entries(F.collect_list(F.struct("strate", "n"))).alias("counts"))
        .withColumn("taille", F.least(F.floor(F.log2("size")), F.lit(SIZES - 1)).cast("int"))
    )
    totals = {r["strate"]: r["n"] for r in records.groupBy("strate").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most RARE + 1 rows
    strata = sorted(totals)
    sizes = {r["taille"]: r["n"] for r in whole.groupBy("taille").agg(F.sum("size").alias("n")).collect()}  # at most SIZES rows
    target = share[:, None] * np.array([totals[s] for s in strata] + [sizes.get(k, 0) for k in range(SIZES)], float)
    held = np.zeros_like(target)

    def matrix(counts: list, size: list, taille: list) -> np.ndarray:
        out = np.zeros((len(counts), len(strata) + SIZES))
        at = {s: i for i, s in enumerate(strata)}
        for row, c, n, k in zip(out, counts, size, taille):
            for s, v in dict(c).items():
                row[at[s]] = v
            row[len(strata) + k] = n
        return out

    giants = whole.where(F.col("size") * GIANT > n).orderBy(F.desc("size"), "groupe_id").collect()  # fewer than GIANT rows
    first = place(matrix(*([g[c] for g in giants] for c in ("counts", "size", "taille"))), target, held) if giants else []
    left = np.maximum(target - held, 0)
    ratio = left / np.maximum(left.sum(0), 1e-9)
    blocks = max(1, n // BLOCK)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "groupe_id"], ascending=[False, True])
        m = matrix(*(pdf[c].tolist() for c in ("counts", "size", "taille")))
        got = place(m, ratio * m.sum(0), np.zeros_like(ratio))
        return pd.DataFrame({"root": pdf["root"].to_numpy(), "groupe_id": pdf["groupe_id"].to_numpy(), "taille": pdf["taille"].to_numpy(), "split_nouveau": [names[k] for k in got]})

    schema = "root string, groupe_id string, taille int, split_nouveau string"
    small = (
        whole.where(F.col("size") * GIANT <= n)
        .withColumn("block", F.pmod(F.xxhash64("root"), F.lit(blocks)))
        .groupBy("block").applyInPandas(greedy, schema)
    )
    big = df.sparkSession.createDataFrame([(g["root"], g["groupe_id"], g["taille"], names[k]) for g, k in zip(giants, first)], schema)
    return records.join(small.unionByName(big), "root").select("id", "groupe_id", "strate", "taille", "split_nouveau")


def balance(assigned: DataFrame, names: list[str]) -> DataFrame:
    """Per new split: records, share, groups, groups of several records, and the
    largest deviation of a label's share from its share over all records."""
    cell = assigned.groupBy("split_nouveau", "strate").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # a row per split or label
    per = cell.groupBy("split_nouveau").agg(F.sum("n").alias("total")).withColumn("part", F.col("total") / F.sum("total").over(every))
    label = cell.groupBy("strate").agg(F.sum("n").alias("of_label")).withColumn("usual", F.col("of_label") / F.sum("of_label").over(every))
    grid = label.withColumn("split_nouveau", F.explode(F.array(*map(F.lit, names)))).join(per, "split_nouveau")
    group = assigned.groupBy("split_nouveau", "groupe_id").agg(F.count(F.lit(1)).alias("n"))
    groups = group.groupBy("split_nouveau").agg(F.count(F.lit(1)).alias("n_groupes"), F.count_if(F.col("n") > 1).alias("n_groupes_de_plusieurs"))
    return (
        grid.join(cell, ["split_nouveau", "strate"], "left")
        .withColumn("off", F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("usual")))
        .groupBy("split_nouveau").agg(F.max("total").alias("n_fiches"), F.max("part").alias("part"), F.max("off").alias("ecart_max"))
        .join(groups, "split_nouveau")
    )
