"""Texts packed into containers of fixed capacity along a space-filling curve.

Texts are hashed to vectors of their words, projected to few dimensions and
ordered by the Hilbert key of the projection, so that like texts are
neighbours.  A range sort by that key spreads the curve over the cluster;
along it, blocks of neighbouring texts are packed by best fit, largest first.
What a block can't fill well goes on into the next block.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinmill.llm.shingles import Folding, split_words
from clinmill.llm.tokens import TOKENIZER, counts, load, vocabulary

DIMENSIONS, BITS, HASHED = 4, 12, 256
#: Items of a block; the share of a container that must be filled to close it early.
BLOCK, CLOSED = 2048, 0.99
KEYED = "doc_id bigint, jetons int, cle bigint"
PACKED = "conteneur_no int, doc_id bigint, morceau int, jetons int, tache int, place bigint"


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (rows) below 2**bits, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[str], folding: Folding) -> np.ndarray:
    """Hilbert keys of texts; texts without words share one."""
    w = split_words(texts, folding, strings=False)
    n = len(texts)
    slot = (w.hashes % np.uint64(HASHED)).astype(np.int64)
    sign = 1.0 - 2.0 * ((w.hashes >> np.uint64(40)) & np.uint64(1)).astype(float)
    vectors = np.bincount(w.doc * HASHED + slot, sign, minlength=n * HASHED).reshape(n, HASHED)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    axes = np.random.default_rng(20).normal(size=(HASHED, DIMENSIONS))  # the same everywhere
    low = vectors @ axes  # near standard normal
    unit = 1.0 / (1.0 + np.exp(-1.702 * low))
    return hilbert(np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, jetons, cle) of all texts with a token."""
    vocab = vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, folding = load(vocab.value), Folding()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts(tokenizer, texts), pa.int32()), pa.array(curve_keys(texts, folding))], names=["doc_id", "jetons", "cle"]
                )

    given = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return given.mapInArrow(run, KEYED).where("jetons > 0")


#: Texts of the stretch of the curve that one task packs (its arrays hold twelve bytes a text).
STRETCH = 16_384


def fit_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit, largest first: the items (by index) of each container."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room, container), sorted
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            room, b = capacity - sizes[i], len(bins) - 1
        else:
            room, b = free.pop(at)
            bins[b].append(i)
            room -= sizes[i]
        if room:
            bisect.insort(free, (room, b))
    return bins


def pack_stream(items: Iterator[tuple[int, int, int]], capacity: int, block: int = BLOCK) -> Iterator[list[tuple[int, int, int]]]:
    """Containers, as lists of (doc, piece, size), for items along the curve.

    An item above the capacity is cut: whole containers first, its rest is an
    item of its own.  Containers that a block leaves less than ``CLOSED`` full
    are emptied into the next block; the last block closes all.
    """
    waiting: list[tuple[int, int, int]] = []

    def settle(last: bool) -> Iterator[list[tuple[int, int, int]]]:
        nonlocal waiting
        bins = fit_block([w[2] for w in waiting], capacity)
        rest: list[tuple[int, int, int]] = []
        for b in bins:
            held = [waiting[i] for i in b]
            if last or sum(h[2] for h in held) >= CLOSED * capacity:
                yield held
            else:
                rest += held
        # if next to nothing could be closed, what is left is closed as it is
        if len(rest) > block // 2:
            for b in fit_block([w[2] for w in rest], capacity):
                yield [rest[i] for i in b]
            rest = []
        waiting = rest

    for doc, piece, size in items:
        while size > capacity:
            yield [(doc, piece, capacity)]
            piece, size = piece + 1, size - capacity
        if size == capacity:
            yield [(doc, piece, size)]
            continue
        waiting.append((doc, piece, size))
        if len(waiting) >= block:
            yield from settle(False)
    if waiting:
        yield from settle(True)


def pack(df: DataFrame, containers: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(conteneur_no, conteneur, doc_id, morceau, jetons): every text in every
    kind of container, whole unless longer than the capacity.

    ``containers`` has a row per kind (conteneur_no, capacite_jetons).  Null
    and empty texts take no room and have no row; equal texts are neighbours,
    told apart by ``doc_id``.  ``conteneur`` names one container of its kind.
    Each task packs a stretch of about ``STRETCH`` texts, whatever the settings.
    """
    kinds = [(r[0], r[1]) for r in containers.select("conteneur_no", "capacite_jetons").where("capacite_jetons > 0").orderBy("conteneur_no").collect()]  # a row per kind
    curve = keyed(df, path=path).persist(StorageLevel.MEMORY_AND_DISK)  # the range sort reads it twice
    tasks = max(1, -(-curve.count() // STRETCH))
    sorted_ = curve.repartitionByRange(tasks, "cle", "doc_id").sortWithinPartitions("cle", "doc_id").withColumn("tache", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        task = 0
        for b in batches:  # numbers only, twelve bytes a text
            docs.append(b.column(0).to_numpy())
            sizes.append(b.column(1).to_numpy())
            task = b.column(3)[0].as_py() if b.num_rows else task
        if not docs:
            return
        doc, size = np.concatenate(docs), np.concatenate(sizes)
        for no, capacity in kinds:
            rows: list[tuple] = []
            items = ((int(d), 0, int(s)) for d, s in zip(doc, size))
            for place, held in enumerate(pack_stream(items, capacity)):
                rows += [(no, d, p, s, task, place) for d, p, s in held]
                if len(rows) >= 8192:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    out = sorted_.mapInArrow(run, PACKED)
    return out.withColumn("conteneur", F.concat_ws("-", "tache", "place")).select("conteneur_no", "conteneur", "doc_id", "morceau", "jetons")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def rooms(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container: texts, tokens and unused room."""
    size = F.broadcast(containers.select("conteneur_no", "capacite_jetons"))  # a row per kind
    return (
        packed.groupBy("conteneur_no", "conteneur").agg(F.count(F.lit(1)).alias("n_textes"), F.sum("jetons").alias("jetons"))
        .join(size, "conteneur_no")
        .withColumn("vide", F.col("capacite_jetons") - F.col("jetons"))
    )


def report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, unused room and share filled."""
    return (
        rooms(packed, containers).groupBy("conteneur_no", "capacite_jetons")
        .agg(F.count(F.lit(1)).alias("n_conteneurs"), F.sum("jetons").alias("jetons"), F.sum("vide").alias("vide"))
        .withColumn("rempli", F.col("jetons") / (F.col("jetons") + F.col("vide")))
    )
