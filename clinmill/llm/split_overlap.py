"""Same or near-same records across splits.

Candidate pairs across the splits come from the vertically partitioned join of
``nearjoin``, which loses none, and are compared exactly by their distinct words.  In a pair that reaches the
threshold, the winnowed fingerprints (minima of rolling hashes of word 5-grams in
each window) that both texts have are seeds.  Seeds are chained where they are
collinear, chains are extended by alignment of the words, and the covered part
of the evaluation text is measured.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinmill.llm import nearjoin
from clinmill.llm.group_splits import normal_split
from clinmill.llm.near_duplicates import PREPARED, chunks, copies, prepare
from clinmill.llm.shingles import Folding, grams, mixed, split_words, winnowed
from clinmill.runtime import cut

#: Words of a fingerprint, and those of a window of which the minimum is kept.
GRAM, WINDOW = 5, 8
#: The single words of a text of up to SHORT distinct words are seeds too, as it may share no 5-gram.
SHORT = 40
#: Words that an extension may skip on either side to meet again.
SKIP = 3
EVALUATION, TRAIN = nearjoin.ONE, nearjoin.TWO
COMPARED = "h1 bigint, h2 bigint, graines int, couverts int, mots int, communs int, total int"


def fingerprints(texts: list[str], folding: Folding) -> list[dict[int, list[int]]]:
    """For each text its fingerprints and their places."""
    w = split_words(texts, folding, strings=False)
    at, g = grams(w.doc, w.hashes, GRAM)
    doc = w.doc[at]
    first = np.cumsum(w.lengths) - w.lengths
    keep = winnowed(doc, g, WINDOW)
    few = np.array([len(set(t.split(" "))) <= SHORT for t in texts], bool)[w.doc]
    out: list[dict[int, list[int]]] = [{} for _ in texts]
    for kind, d, place, values in ((0, doc[keep], at[keep], g[keep]), (2, w.doc[few], np.flatnonzero(few), w.hashes[few])):
        values = mixed(values * np.uint64(3) + np.uint64(kind))
        for i, v, p in zip(d.tolist(), values.tolist(), (place - first[d]).tolist()):
            out[i].setdefault(v, []).append(p)
    return out


def shared(one: dict[int, list[int]], two: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Seeds: the places of all fingerprints of both, repeated ones in their order."""
    return [
        (p[min(k, len(p) - 1)], q[min(k, len(q) - 1)])
        for p, q in ((one[v], two[v]) for v in one.keys() & two.keys())
        for k in range(max(len(p), len(q)))
    ]


def chains(seeds: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Seeds (place in the one text, in the other) in chains that rise on both
    sides: the longest first, then the longest of what is left, and so on."""
    left = sorted(set(seeds))
    out = []
    while left:
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(left)
        for i, (_, b) in enumerate(left):
            lo = bisect_left(tails, b)
            back[i] = ends[lo - 1] if lo else -1
            if lo == len(tails):
                tails.append(b)
                ends.append(i)
            else:
                tails[lo], ends[lo] = b, i
        i, chain = ends[-1], []
        while i >= 0:
            chain.append(i)
            i = back[i]
        out.append([left[k] for k in reversed(chain)])
        used = set(chain)
        left = [x for k, x in enumerate(left) if k not in used]
    return out


def extend(one: list[str], two: list[str], i: int, j: int, step: int, covered: bytearray) -> None:
    """Walk from words (i, j) in direction ``step`` along equal words, skipping
    up to ``SKIP`` words on either side where two equal words follow."""
    n, m = len(one), len(two)
    while 0 <= i < n and 0 <= j < m:
        if one[i] == two[j]:
            covered[i] = 1
            i, j = i + step, j + step
            continue
        for skip in range(1, 2 * SKIP + 1):
            for a in range(max(0, skip - SKIP), min(SKIP, skip) + 1):
                p, q = i + step * a, j + step * (skip - a)
                if 0 <= p < n and 0 <= q < m and one[p] == two[q] and (not 0 <= p + step < n or not 0 <= q + step < m or one[p + step] == two[q + step]):
                    i, j = p, q
                    break
            else:
                continue
            break
        else:
            return


def coverage(one: list[str], two: list[str], seeds: list[tuple[int, int]]) -> int:
    """Words of ``one`` that chains of seeds and their extensions cover."""
    covered = bytearray(len(one))
    for chain in chains(seeds):
        for i, j in chain:
            if i < len(one) and not covered[i]:
                extend(one, two, i, j, 1, covered)
                extend(one, two, i - 1, j - 1, -1, covered)
    return sum(covered)


def compare(batches: Iterator[pa.RecordBatch], tenths: int = 7) -> Iterator[pa.RecordBatch]:
    """(h1, h2, words of both) to ``COMPARED``, for pairs that reach ``tenths`` / 10."""
    folding = Folding()
    for h1, h2, w1, w2 in chunks(batches):
        near = []
        for a, b, x, y in zip(h1, h2, w1, w2):
            s1, s2 = set(x.split(" ")), set(y.split(" "))
            both = len(s1 & s2)
            total = len(s1) + len(s2) - both
            if both * 10 >= total * tenths:
                near.append((a, b, x, y, both, total))
        prints = fingerprints([n[k] for n in near for k in (2, 3)], folding) if near else []
        rows = []
        for k, (a, b, x, y, both, total) in enumerate(near):
            one, seeds = x.split(" "), shared(prints[2 * k], prints[2 * k + 1])
            rows.append((a, b, len(seeds), coverage(one, y.split(" "), seeds), len(one), both, total))
        cols = list(zip(*rows)) or [()] * 7
        yield nearjoin.rows_of(COMPARED, *(pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(cols)))


class SplitOverlap:
    """Evaluation records whose text also occurs in the training split.

    ``df`` needs ids, texts and splits; rows with null or other split, null,
    blank or wordless text take no part; repeated rows count once; an id
    delivered in several splits is in each.  Other columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", text_col: str = "contexte_clinique", split_col: str = "split", tenths: int = 7) -> None:
        self.tenths = tenths
        split = normal_split(F.col(split_col))
        coded = F.concat_ws("|", F.when(split == "train", str(TRAIN)).otherwise(str(EVALUATION)), F.col(id_col).cast("string"))
        given = df.where(split.isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(coded.alias("id"), F.col(text_col).alias("text"))
        rows = given.mapInArrow(prepare, PREPARED)
        self.prepared = rows.withColumn("side", F.substring("id", 1, 1).cast("tinyint")).withColumn("id", F.expr("substring(id, 3)")).persist(StorageLevel.MEMORY_AND_DISK)
        self.members = self.prepared.select("id", "h", "side").distinct()

    def release(self) -> None:
        self.prepared.unpersist()

    def text_pairs(self) -> DataFrame:
        """Compared pairs of different texts (h1 evaluation, h2 training) whose
        common words reach the threshold, with their coverage."""
        t = self.tenths
        pairs = cut(nearjoin.candidates(self.prepared.withColumn("side", F.col("side").cast("int")), t))
        keys = pairs.select(F.explode(F.array("h1", "h2")).alias("h")).distinct()
        text = nearjoin.only(self.prepared.select("h", "words"), keys, "h", 2 * pairs.count()).dropDuplicates(["h"])
        w1, w2 = (text.select(F.col("h").alias(f"h{k}"), F.col("words").alias(f"w{k}")) for k in (1, 2))
        return pairs.join(w1, "h1").join(w2, "h2").select("h1", "h2", "w1", "w2").mapInArrow(lambda it: compare(it, t), COMPARED)

    def overlaps(self) -> DataFrame:
        """(id_eval, id_train, couverture): all pairs of records; 1 for equal texts."""
        ev = self.members.where(F.col("side") == EVALUATION).select(F.col("id").alias("id_eval"), F.col("h").alias("h1"))
        tr = self.members.where(F.col("side") == TRAIN).select(F.col("id").alias("id_train"), F.col("h").alias("h2"))
        near = self.text_pairs().select("h1", "h2", (F.col("couverts") / F.col("mots")).alias("couverture")).join(ev, "h1").join(tr, "h2")
        same = copies(ev.withColumnRenamed("h1", "h"), tr.withColumnRenamed("h2", "h")).withColumn("couverture", F.lit(1.0))
        cols = ("id_eval", "id_train", "couverture")
        return near.select(*cols).unionByName(same.select(*cols)).where("id_eval <> id_train").groupBy("id_eval", "id_train").agg(F.max("couverture").alias("couverture"))

    def found(self) -> DataFrame:
        """(id_1, id_2), id_1 < id_2, of all overlaps."""
        return self.overlaps().select(F.least("id_eval", "id_train").alias("id_1"), F.greatest("id_eval", "id_train").alias("id_2")).distinct()


def report(overlap: SplitOverlap, df: DataFrame, id_col: str = "id", text_col: str = "contexte_clinique", split_col: str = "split", source_col: str = "source") -> DataFrame:
    """Per evaluation split and source: records with text, records that overlap
    with training, pairs, mean and largest coverage of a record."""
    split = normal_split(F.col(split_col))
    records = df.where(split.isin("validation", "test") & F.col(text_col).rlike(r"(?U)\S")).select(
        F.col(id_col).cast("string").alias("id_eval"), split.alias("split"), F.col(source_col).alias("source")
    ).distinct()
    per = overlap.overlaps().groupBy("id_eval").agg(F.count(F.lit(1)).alias("n"), F.max("couverture").alias("c"))
    return (
        records.join(per, "id_eval", "left").groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("n_fiches"), F.count("n").alias("n_touchees"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_paires"), F.avg("c").alias("couverture_moyenne"), F.max("c").alias("couverture_max"))
    )
