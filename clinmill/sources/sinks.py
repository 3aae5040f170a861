"""Sinks: JSON lines, splits, CSV for people, documents, versioned backups."""

from __future__ import annotations

import csv
import json
import shutil
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, force: bool = False, dry: bool = False, source: str | None = None) -> None:
    """JSON lines with nulls kept; refuses to overwrite unless forced, and to
    write over its own source; dry does nothing."""
    if source is not None and source.rstrip("/") == path.rstrip("/"):
        raise ValueError("source and target are the same")
    if not dry:
        df.write.mode("overwrite" if force else "errorifexists").option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str) -> None:
    """One more batch of JSON lines; committed files are never touched again."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def divided(df: DataFrame, path: str, kept: Column, force: bool = False) -> None:
    """Kept and left-out rows side by side (``retenu=true|false``): nothing is lost, the input is read once."""
    df.withColumn("retenu", F.coalesce(kept, F.lit(False))).write.mode("overwrite" if force else "errorifexists").partitionBy("retenu").option("ignoreNullFields", "false").json(path)


def by_split(df: DataFrame, path: str, split: str = "jeu", force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").partitionBy(split).option("ignoreNullFields", "false").json(path)


def review_csv(rows: DataFrame, path: str, columns: list[str], key: str | None = None) -> int:
    """A CSV for people (semicolons, byte order mark, given column order) and,
    with a key, a side file of the keys.  For results of a bounded size only:
    the rows are taken one by one, never held together."""
    n = 0
    keys = []
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter=";")
        out.writerow(columns)
        for r in rows.select(*columns, *([key] if key and key not in columns else [])).toLocalIterator():
            out.writerow(["" if r[c] is None else r[c] for c in columns])
            if key:
                keys.append(str(r[key]))
            n += 1
    if key:
        Path(path + ".ids").write_text("\n".join(keys), encoding="utf-8")
    return n


def document(value: dict | list, path: str) -> None:
    """A small JSON document, written beside and then moved in place."""
    side = Path(path + ".tmp")
    side.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    side.replace(path)


def versioned(df: DataFrame, root: str, clock: datetime | None = None) -> str:
    """A new version under ``root``; older ones stay as the backup."""
    path = f"{root}/version={(clock or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%S')}"
    df.write.mode("errorifexists").parquet(path)
    return path


def backup(folders: Iterable[str], target: str, clock: datetime | None = None) -> str:
    """Local folders copied under a time stamp."""
    out = Path(target) / (clock or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    for f in folders:
        shutil.copytree(f, out / Path(f).name)
    return str(out)
