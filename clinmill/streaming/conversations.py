"""Conversations as streams: guards per turn, decision journal, resumable batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "signes array<string>, conclu boolean"
OUT = "conversation string, tour long, niveau string, source string, signes array<string>"


def decisions(turns: DataFrame, find: Callable[[str], list[str]], level: str = "urgence_maximale", decisive: Callable[[list[str]], list[str]] = list) -> DataFrame:
    """The first turn of each conversation at which what its patient said so far is decisive.

    ``turns`` is a stream of (conversation, tour, role, texte).  ``find`` names the
    signs in one turn; ``decisive`` tells of all signs so far, in the order of
    their coming, those that decide (combinations too).  State per conversation
    is the distinct signs and whether it has ended, however long it is.  Runs
    with the RocksDB or the default state store; output mode append.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, over = state.get if state.exists else ([], False)
        seen, out = list(seen), []
        if not over:
            rows = pd.concat([b[b["role"] == "user"] for b in batches]).dropna(subset=["texte"]).sort_values("tour")
            for turn, signs in zip(rows["tour"].tolist(), map(find, rows["texte"].tolist())):
                seen += [s for s in dict.fromkeys(signs) if s not in seen]
                found = decisive(seen)
                if found:
                    over = True
                    out.append((key[0], int(turn), level, "plancher", found))
                    break
        state.update((seen, over))
        yield pd.DataFrame(out, columns=["conversation", "tour", "niveau", "source", "signes"])

    return turns.groupBy("conversation").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def journal(stream: DataFrame, path: str, checkpoint: str):
    """Appends decisions to JSON lines, exactly once by the checkpoint; stops when all is read."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def resumable(source: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Applies a batch operator to what is new; a batch that is run again replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).withColumn("lot", F.lit(number)).write.mode("overwrite").parquet(f"{path}/lot_{number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", label: str = "event_type", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and sums per window and label, late rows up to the watermark included."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), label).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("somme")).select(
        F.col("window.start").alias("debut"), label, "n", "somme"
    )
