"""Documents mixed so that each source has its target share of all tokens.

Per source, documents are counted by exact token length.  Whole passes over the
source come first; the remaining budget is a bounded subset sum over the
lengths: proportional counts of each length, then dynamic programming for what
is left.  Documents are chosen by seeded order within their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinmill.llm.tokens import TOKENIZER, with_token_counts

#: Budget that the dynamic programme fits exactly.
FITTED = 8192
#: Parts into which the documents of one length are divided to be ranked.
BUCKETS = 64


def subset_sum(lengths: list[int], most: list[int], budget: int) -> list[int]:
    """How many of each length to take, at most ``most``, so that their sum is
    as near to ``budget`` from below as can be.

    Reachable sums are the bits of one integer; multiples are split in powers
    of two, and the sums before each part are kept to walk back.
    """
    full = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i, (size, count) in enumerate(zip(lengths, most)):
        left, k = min(count, budget // size if size else 0), 1
        while left > 0:
            k = min(k, left)
            steps.append((i, k, reach))
            reach = (reach | (reach << (size * k))) & full
            left -= k
            k *= 2
        if reach == full:
            break
    total = reach.bit_length() - 1
    taken = [0] * len(lengths)
    for i, k, before in reversed(steps):
        if not (before >> total) & 1:
            taken[i] += k
            total -= lengths[i] * k
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, repeat: int, fitted: int = FITTED) -> tuple[int, np.ndarray]:
    """Whole passes and, beyond them, how many documents of each length.

    The sum of tokens is at most ``budget`` and as near as the lengths allow.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    every = int((lengths * counts).sum())
    if every == 0 or budget <= 0:
        return 0, np.zeros(len(order), np.int64)
    passes = min(repeat, budget // every)
    rest = budget - passes * every
    taken = np.zeros(len(order), np.int64)
    if passes < repeat and rest:
        taken = np.minimum(counts, (counts * (rest / every)).astype(np.int64))
        left = rest - int((lengths * taken).sum())
        for i in range(len(lengths) - 1, -1, -1):  # largest first, down to what is fitted exactly
            if left <= fitted:
                break
            more = min(int(counts[i] - taken[i]), (left - fitted) // int(lengths[i]) + 1, left // int(lengths[i]))
            taken[i] += more
            left -= more * int(lengths[i])
        for i in range(len(lengths)):  # some room to choose from
            while left < fitted // 2 and taken[i] and lengths[i] <= fitted // 4:
                taken[i] -= 1
                left += int(lengths[i])
        extra = subset_sum(lengths.tolist(), (counts - taken).tolist(), left)
        taken += np.array(extra, np.int64)
    out = np.zeros(len(order), np.int64)
    out[order] = taken
    return int(passes), out


class Mix:
    """The mixture of ``documents`` for ``targets`` (source, part_cible, repetitions_max).

    Sources that differ in case or outer blanks are one.  The total is the
    largest for which every source can reach its share within its repetitions
    (``total`` sets a smaller one).  Sources without target are left out;
    targets without documents stay unreached, the others keep their shares of
    the total.  Null and empty texts have no tokens and aren't chosen; repeated
    rows count once.  The same seed gives the same choice.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None, path: str = TOKENIZER) -> None:
        label = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
        given = documents.select("doc_id", label.alias("source"), "text").where("source is not null")
        self.docs = with_token_counts(given, path=path, keep=("source",)).where("jetons > 0").dropDuplicates(["doc_id"]).persist(StorageLevel.MEMORY_AND_DISK)
        self.targets = targets.select(label.alias("source"), "part_cible", F.col("repetitions_max").alias("repeat"))
        self.seed = seed
        sums = self.docs.groupBy("source").agg(F.sum("jetons").alias("tokens")).join(self.targets, "source").where("part_cible > 0 and repeat > 0")
        most = sums.agg(F.min(F.floor(F.col("tokens") * F.col("repeat") / F.col("part_cible")))).first()[0] or 0
        self.total = int(min(total, most) if total is not None else most)

    def plan(self) -> DataFrame:
        """(source, jetons, passes, choisis): whole passes over the source and how many documents of each length beyond."""
        total = self.total
        counts = self.docs.groupBy("source", "jetons").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(self.targets), "source")

        def per_source(pdf: pd.DataFrame) -> pd.DataFrame:
            passes, taken = fit(pdf["jetons"].to_numpy(), pdf["n"].to_numpy(), int(round(total * float(pdf["part_cible"].iloc[0]))), int(pdf["repeat"].iloc[0]))
            return pd.DataFrame({"source": pdf["source"], "jetons": pdf["jetons"], "passes": passes, "choisis": taken})

        # a row per length of a source: bounded by the longest text
        return counts.groupBy("source").applyInPandas(per_source, "source string, jetons int, passes int, choisis bigint")

    def chosen(self) -> DataFrame:
        """(doc_id, source, jetons, n_utilisations) of all documents that are used.

        The documents of one length are ranked in parts by hash, so that no
        task gets all of a frequent length: parts before the last one needed
        are taken whole, only the last is ranked.
        """
        key = F.xxhash64(F.lit(self.seed), "doc_id")
        docs = self.docs.withColumn("k", key).withColumn("part", F.pmod("k", F.lit(BUCKETS)))
        sizes = docs.groupBy("source", "jetons", "part").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("source", "jetons").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        quota = (
            sizes.withColumn("before", F.coalesce(before, F.lit(0)))
            .join(self.plan(), ["source", "jetons"])
            .select("source", "jetons", "part", "passes", F.least("n", F.greatest(F.lit(0), F.col("choisis") - F.col("before"))).alias("quota"))
        )
        rank = F.row_number().over(Window.partitionBy("source", "jetons", "part").orderBy("k", "doc_id"))
        return (
            docs.withColumn("rank", rank).join(quota, ["source", "jetons", "part"])
            .select("doc_id", "source", "jetons", (F.col("passes") + (F.col("rank") <= F.col("quota")).cast("int")).alias("n_utilisations"))
            .where("n_utilisations > 0")
        )

    def shares(self) -> DataFrame:
        """Per target source: wanted and reached share, tokens used, documents and most uses."""
        used = self.chosen().groupBy("source").agg(
            F.sum(F.col("jetons").cast("bigint") * F.col("n_utilisations")).alias("jetons_pris"), F.count(F.lit(1)).alias("n_documents"), F.max("n_utilisations").alias("utilisations_max")
        )
        rows = self.targets.join(used, "source", "left").fillna(0, ["jetons_pris", "n_documents", "utilisations_max"])
        every = F.sum("jetons_pris").over(Window.partitionBy())  # a row per source
        return rows.withColumn("part_atteinte", F.col("jetons_pris") / F.greatest(every, F.lit(1))).select(
            "source", "part_cible", "part_atteinte", "jetons_pris", "n_documents", "utilisations_max", F.col("repeat").alias("repetitions_max")
        )
