"""Near-duplicate texts by an exact similarity join.

Texts are compared by their distinct words: runs of letters and digits, lower
case, without accents.  Two texts are near duplicates if the words of both
divided by the words of either reach ``tenths`` / 10.

Exact copies (texts with the same words) are one class from the start.  Pairs of
classes come from the vertically partitioned join of ``nearjoin``, whose summed
partial overlaps lose none; the pairs that they leave are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinmill.llm import nearjoin
from clinmill.llm.components import connected
from clinmill.llm.nearjoin import binaries, flat, rows_of
from clinmill.llm.shingles import Folding, distinct, mixed, split_words
from clinmill.runtime import cut

#: Texts that are worked on at a time, so that arrays stay in the caches.
CHUNK = 512
PREPARED = "id string, h bigint, nw int, bits binary, values binary, words string"
CLASS_PAIRS = "h1 bigint, h2 bigint, common int, either int"
#: Keys that one key's rows are spread over where copies are paired, at most, and copies of a text that are given one key.
SALTS, COPIES = 16, 256


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[list[list]]:
    """The columns of the rows, as lists of up to ``size``."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield [c.to_pylist() for c in b.slice(at, size).columns]


def prepare(batches: Iterator[pa.RecordBatch], strings: bool = True) -> Iterator[pa.RecordBatch]:
    """(id, text) to the columns of ``PREPARED`` (``words`` only with ``strings``); texts without a word give no row."""
    folding = Folding()
    for ids, texts in chunks(batches):
        w = split_words(texts, folding, strings=strings)
        doc, value = distinct(w.doc, w.hashes)
        n = len(texts)
        spread = mixed(value)
        h = np.zeros(n, np.uint64)
        np.add.at(h, doc, spread)
        nw = np.bincount(doc, minlength=n)
        maps = nearjoin.bitmaps(doc, spread, nw)
        has = np.flatnonzero(w.lengths)
        yield rows_of(
            PREPARED,
            [ids[i] for i in has.tolist()],
            h[has].view(np.int64),
            nw[has].astype(np.int32),
            pa.array([maps[i] for i in has.tolist()], pa.binary()),
            binaries(value, nw[has]),
            pa.array([w.texts[i] for i in has.tolist()] if strings else [None] * len(has), pa.string()),
        )


def compare(batches: Iterator[pa.RecordBatch], tenths: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, words of both as 48-bit hashes) to ``CLASS_PAIRS``, at the threshold."""
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            some = b.slice(at, CHUNK)
            (v1, n1), (v2, n2) = flat(some.column(2)), flat(some.column(3))
            row = np.r_[np.repeat(np.arange(len(n1)), n1), np.repeat(np.arange(len(n2)), n2)]
            code = np.sort((row.astype(np.uint64) << np.uint64(48)) | np.r_[v1, v2])
            twice = code[1:][code[1:] == code[:-1]]
            common = np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=len(n1))
            either = n1 + n2 - common
            keep = common * 10 >= either * tenths
            h1, h2 = (some.column(k).to_numpy()[keep] for k in range(2))
            yield rows_of(CLASS_PAIRS, h1, h2, common[keep].astype(np.int32), either[keep].astype(np.int32))


def copies(left: DataFrame, right: DataFrame, least: int = 1) -> DataFrame:
    """Rows of ``left`` and ``right`` of one ``h`` that ``right`` has ``least``
    times; each key of ``right`` is met in up to ``SALTS`` places, by its number of
    rows, so that no task pairs all copies of a text."""
    salts = F.least(F.lit(SALTS), F.ceil(F.col("n") / COPIES)).cast("int")
    size = right.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("h", salts.alias("salts"))
    one = left.join(size, "h").withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.col("salts")).cast("int")).drop("salts")
    two = right.join(size, "h").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return one.join(two, ["h", "salt"]).drop("salt")


class NearDuplicates:
    """The near-duplicate classes and pairs of the texts of a table.

    ``df`` needs a column of ids and one of texts; other columns are ignored.
    Rows with null, blank or wordless text take no part; a repeated row counts
    once; an id delivered with several texts belongs to the class of each.
    Prepared rows are persisted (memory and disk); ``release`` frees them.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", text_col: str = "contexte_clinique", tenths: int = 7) -> None:
        self.tenths = tenths
        given = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
        self.prepared = given.mapInArrow(lambda it: prepare(it, strings=False), PREPARED).drop("words").persist(StorageLevel.MEMORY_AND_DISK)
        self.members = self.prepared.select("id", "h").distinct()

    def release(self) -> None:
        self.prepared.unpersist()

    def class_pairs(self) -> DataFrame:
        """Pairs (h1, h2) of different texts at or above the threshold: words of both, words of either."""
        t = self.tenths
        pairs = cut(nearjoin.candidates(self.prepared.withColumn("side", F.lit(0)), t))
        keys = pairs.select(F.explode(F.array("h1", "h2")).alias("h")).distinct()
        text = nearjoin.only(self.prepared.select("h", "values"), keys, "h", 2 * pairs.count()).dropDuplicates(["h"])
        one, two = (text.select(F.col("h").alias(f"h{k}"), F.col("values").alias(f"v{k}")) for k in (1, 2))
        return pairs.join(one, "h1").join(two, "h2").select("h1", "h2", "v1", "v2").mapInArrow(lambda it: compare(it, t), CLASS_PAIRS)

    def pairs(self) -> DataFrame:
        """All pairs of ids (id_1 < id_2) of near-duplicate or identical texts."""
        m1, m2 = (self.members.select(F.col("id").alias(f"i{k}"), F.col("h").alias(f"h{k}")) for k in (1, 2))
        across = self.class_pairs().join(m1, "h1").join(m2, "h2").where("i1 <> i2")
        within = copies(m1.withColumnRenamed("h1", "h"), m2.withColumnRenamed("h2", "h"), 2).where("i1 < i2")
        found = across.select("i1", "i2").unionByName(within.select("i1", "i2"))
        return found.select(F.least("i1", "i2").alias("id_1"), F.greatest("i1", "i2").alias("id_2")).distinct()

    def classes(self) -> DataFrame:
        """One row per id: its class (smallest id of all texts linked, directly
        or through others), the number of its links to different texts and of
        rows with its very words."""
        links = self.class_pairs().select("h1", "h2").persist(StorageLevel.MEMORY_AND_DISK)
        label = connected(links.select(F.col("h1").alias("src"), F.col("h2").alias("dst")))
        degree = links.select(F.explode(F.array("h1", "h2")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_liens"))
        copies = self.members.groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
        rooted = (
            copies.join(label.select(F.col("node").alias("h"), "root"), "h", "left")
            .withColumn("root", F.coalesce("root", "h"))
            .join(degree, "h", "left")
        )
        name = rooted.groupBy("root").agg(F.min("least").alias("classe_id"))
        return (
            self.members.join(rooted.join(name, "root"), "h")
            .select("id", "classe_id", F.coalesce("n_liens", F.lit(0)).alias("n_liens"), "n_copies")
            .groupBy("id").agg(F.min("classe_id").alias("classe_id"), F.sum("n_liens").alias("n_liens"), F.sum("n_copies").alias("n_copies"))
        )
