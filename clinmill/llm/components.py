"""Connected components of an edge table by iterated minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinmill.runtime import cut


def connected(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(src, dst) to (node, root): the smallest node of each node's component.

    Alternates large-star and small-star steps: every node links the
    neighbours that are larger (then those that are not) to the smallest one it
    sees.  Each step is two aggregations by node that combine before the
    shuffle, no neighbour list is ever built, and labels double their reach, so
    long chains take a logarithmic number of rounds.  Lineage is cut each round
    in the shared folder.  Self-loops and nulls are ignored; a node without an
    edge to another has no row.
    """
    e = cut(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        # large star: the larger neighbours of each node go to its smallest
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours and the node itself go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
