"""Measured values brought to common units.

The unit of a row is declared (written in its text beside the value, or in the
unit column) or not.  The undeclared values of a source are a history in time;
an exact penalised changepoint search on their logarithms (PELT, squared error)
cuts it into segments of one level.  The factor of a known unit that brings a
segment's level to the usual level of the quantity tells its unit; a change of
unit is a level shift that matches the factor between two units.

A history is summed into ``BINS`` bins of its own time (counts, sums and squares
of the logarithms, combined before the shuffle), so that one task gets a bounded
number of rows however large a source is.  Each change is then placed exactly:
the values of the two bins beside it are read again, one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a history between its outer hundredths of time (what is beyond falls into the outer bins).
BINS = 2048
#: Values that a segment has at least, so that a few odd ones make no level.
LEAST = 16


@dataclass(frozen=True)
class Quantity:
    """A measured quantity: how its units are spelled (in order of trial) and
    the factors that bring them to the common unit, which has factor 1."""

    value: str
    unit: str
    spellings: dict[str, str]
    factors: dict[str, float]
    common: str


# 1 cmHg = 10 mmHg, 1 kPa = 7.50062 mmHg, 1 g/l = 100 mg/dl = 5.55 mmol/l.
PRESSURE = Quantity(
    "pas_mmhg",
    "pas_unite",
    {
        "mmHg": r"mm\s*(?:de\s+mercure|hg)|millim[eè]tres?\s+de\s+mercure",
        "cmHg": r"cm\s*(?:de\s+mercure|hg)|centim[eè]tres?\s+de\s+mercure",
        "kPa": r"kpa|kilo\s*-?\s*pascals?",
    },
    {"mmHg": 1.0, "cmHg": 10.0, "kPa": 7.50062},
    "mmHg",
)
GLUCOSE = Quantity(
    "glycemie_mmol_l",
    "glycemie_unite",
    {
        "mg/dl": r"(?:mg|milligrammes?)\s*(?:/|par|pour)\s*(?:d[eé]?c?i?l\w*|100\s*ml)",
        "mmol/l": r"(?:mmol|millimoles?)\s*(?:/|par)\s*l\w*|mm\b",
        "g/l": r"(?:g|grammes?)\s*(?:/|par)\s*l\w*",
    },
    {"g/l": 5.55, "mg/dl": 0.0555, "mmol/l": 1.0},
    "mmol/l",
)
QUANTITIES = (PRESSURE, GLUCOSE)
#: Words before a number that make it an earlier value.
EARLIER = "carnet|veille|pr[eé]c[eé]dent|ant[eé]rieur"
NUMBER = r"\d+(?:[.,]\d+)?"


def spelled(unit: Column, q: Quantity) -> Column:
    """The unit that a text names, null if it names none of the quantity's."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(q.spellings.items()):
        out = F.when(unit.rlike(f"(?iu)^\\s*(?:{pattern})\\s*$"), name).otherwise(out)
    return out


def written(text: Column, value: Column, q: Quantity) -> Column:
    """The unit written in ``text`` after the number ``value`` (a second number
    after a slash may stand between), earlier values aside; else null."""
    units = "|".join(q.spellings.values())
    second = rf"(?:\s*/\s*{NUMBER})?"
    whole = rf"(?iu)(?:(?:{EARLIER})[^0-9]{{0,12}})?(?<![\d.,]){NUMBER}{second}\s*(?:{units})(?![\p{{L}}\d])"
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    number = lambda x: F.regexp_replace(F.regexp_extract(x, NUMBER, 0), ",", ".").try_cast("double")
    same = F.filter(found, lambda x: ~x.rlike(f"(?iu)^(?:{EARLIER})") & (F.abs(number(x) - value) < 1e-6))
    return spelled(F.regexp_replace(F.try_element_at(same, F.lit(1)), rf"(?iu)^{NUMBER}{second}", ""), q)


def measures(df: DataFrame, quantities: tuple[Quantity, ...] = QUANTITIES, key: str = "releve_no", text: str = "texte_source", time: str = "mesure_le") -> DataFrame:
    """Long form: (key, source, champ, valeur, mesure_le, declaree).

    One row per non-null value; NaN is null.  Repeated rows stay (see
    ``real_units``).  Sources that differ in case or outer blanks are one, null
    ones are "".
    """
    parts = [
        F.struct(
            F.lit(q.value).alias("champ"),
            F.nanvl(F.col(q.value).cast("double"), F.lit(None).cast("double")).alias("valeur"),
            F.coalesce(written(F.col(text), F.col(q.value), q), spelled(F.col(q.unit), q)).alias("declaree"),
        )
        for q in quantities
    ]
    return (
        df.select(F.col(key), F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.col(time).alias("mesure_le"), F.explode(F.array(*parts)).alias("m"))
        .select(key, "source", "mesure_le", "m.*")
        .where("valeur is not null")
    )


def pelt(n: np.ndarray, s: np.ndarray, ss: np.ndarray, penalty: float, least: float = 1) -> list[int]:
    """Exact optimal segmentation of weighted bins by squared error plus a
    penalty per segment; returns the first bin of each segment, of which each
    has at least ``least`` values.

    ``n``, ``s``, ``ss`` are counts, sums and sums of squares of the bins.
    Starts that can't be optimal any more are pruned, which changes no result.
    """
    cn, cs, css = (np.r_[0.0, np.cumsum(x)] for x in (n, s, ss))
    m = len(n)
    best = np.full(m + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(m + 1, int)
    # a start that is worse than a new one at t is out once a segment from t is long enough
    until = np.full(m + 1, np.inf)
    open_ = np.array([0])
    for t in range(1, m + 1):
        open_ = open_[until[open_] > cn[t]]
        able = open_[cn[t] - cn[open_] >= least]
        if len(able):
            w = np.maximum(cn[t] - cn[able], 1e-12)
            total = best[able] + css[t] - css[able] - (cs[t] - cs[able]) ** 2 / w
            k = int(np.argmin(total))
            best[t], back[t] = total[k] + penalty, able[k]
            worse = able[total > best[t]]
            until[worse] = np.minimum(until[worse], cn[t] + least)
        open_ = np.r_[open_, t]
    if not np.isfinite(best[m]):
        return [0]
    cuts, t = [], m
    while t > 0:
        cuts.append(int(back[t]))
        t = back[t]
    return cuts[::-1]


def unit_levels(q: Quantity, levels: np.ndarray, usual: float) -> np.ndarray:
    """For each level (mean logarithm) the unit whose factor brings it nearest to the usual level."""
    names = list(q.factors)
    off = np.abs(levels[:, None] + np.log([q.factors[u] for u in names]) - usual)
    return np.array(names, object)[off.argmin(1)]


SEGMENTS = "source string, champ string, segment int, niveau double, n_segment bigint, unite_segment string, changement boolean, bin_debut bigint"


def segments(long: DataFrame, quantities: tuple[Quantity, ...] = QUANTITIES, penalty: float = 3.0) -> DataFrame:
    """The segments of the undeclared histories, one row each.

    Columns: source, champ, segment, niveau (mean logarithm), n_segment,
    unite_segment, changement (whether the unit differs from the segment
    before), debut (time in seconds of its first value; null for the first
    segment of a history, which has no start).  ``penalty`` is in units of
    variance times log n.  The usual level of a quantity is the median logarithm
    of its declared values in the common unit, or of all values if none is
    declared.  Values without a time or a logarithm take no part.
    """
    by_name = {q.value: q for q in quantities}
    factor = F.coalesce(*(F.when((F.col("champ") == q.value) & (F.col("declaree") == u), F.lit(f)) for q in quantities for u, f in q.factors.items()))
    usual = {
        r["champ"]: (r["declared"] if r["declared"] is not None else r["every"])
        for r in long.where("valeur > 0").groupBy("champ").agg(
            F.percentile_approx(F.log(F.col("valeur") * factor), 0.5, 1000).alias("declared"), F.percentile_approx(F.log("valeur"), 0.5, 1000).alias("every")
        ).collect()  # a row per quantity
    }
    own = long.where("declaree is null and valeur > 0 and mesure_le is not null").select("source", "champ", F.col("mesure_le").cast("double").alias("t"), F.log("valeur").alias("x"))
    edges = own.groupBy("source", "champ").agg(F.percentile_approx("t", [0.01, 0.99], 10_000).alias("e"))
    at = F.floor((F.col("t") - F.col("e")[0]) / F.greatest((F.col("e")[1] - F.col("e")[0]) / BINS, F.lit(1e-6)))
    binned = own.join(edges, ["source", "champ"]).withColumn("bin", F.greatest(F.lit(0), F.least(at, F.lit(BINS - 1))).cast("bigint")).drop("e")
    x = F.col("x")
    history = binned.groupBy("source", "champ", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))

    def cut(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        source, champ = key
        pdf = pdf.sort_values("bin")
        n, s, ss = (pdf[c].to_numpy(float) for c in ("n", "s", "ss"))
        # the spread about the level is that between neighbouring bins, which shifts hardly touch
        mean = s / n
        pooled = float(np.sum(ss - n * mean**2) / max(n.sum() - len(n), 1.0))
        step = np.diff(mean) ** 2 / (1 / n[1:] + 1 / n[:-1])
        spread = max(pooled if n.sum() >= 2 * len(n) else 0.0, float(np.median(step)) / 0.455 if len(step) else 0.0, 1e-3)
        starts = np.array(pelt(n, s, ss, penalty * spread * math.log(max(n.sum(), 2.0)), LEAST))
        seg = np.searchsorted(starts, np.arange(len(n)), side="right") - 1
        sn, sm = np.bincount(seg, n), np.bincount(seg, s) / np.bincount(seg, n)
        unit = unit_levels(by_name[champ], sm, usual[champ])
        change = np.r_[False, unit[1:] != unit[:-1]]
        return pd.DataFrame(
            {"source": source, "champ": champ, "segment": np.arange(len(starts)), "niveau": sm, "n_segment": sn.astype("int64"), "unite_segment": unit, "changement": change, "bin_debut": pdf["bin"].to_numpy()[starts]}
        )

    found = history.groupBy("source", "champ").applyInPandas(cut, SEGMENTS).persist(StorageLevel.MEMORY_AND_DISK)
    # each start is placed between two values of the bins beside it, where the squared error is least
    before = found.select("source", "champ", (F.col("segment") + 1).alias("segment"), F.col("niveau").alias("m1"))
    edge = found.where("segment > 0").join(before, ["source", "champ", "segment"]).select("source", "champ", "segment", "m1", F.col("niveau").alias("m2"), "bin_debut")
    near = edge.withColumn("bin", F.explode(F.array(F.col("bin_debut") - 1, F.col("bin_debut"))))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        source, champ, segment = key
        pdf = pdf.sort_values("t", kind="stable")
        t, x = pdf["t"].to_numpy(float), pdf["x"].to_numpy(float)
        cost = np.r_[0.0, np.cumsum((x - pdf["m1"].iloc[0]) ** 2 - (x - pdf["m2"].iloc[0]) ** 2)]
        able = np.r_[True, t[1:] > t[:-1], False]
        k = int(np.where(able, cost, np.inf).argmin())
        return pd.DataFrame({"source": [source], "champ": [champ], "segment": [segment], "debut": [float(t[k])]})

    placed = binned.join(near, ["source", "champ", "bin"]).groupBy("source", "champ", "segment").applyInPandas(place, "source string, champ string, segment int, debut double")
    return found.join(placed, ["source", "champ", "segment"], "left").drop("bin_debut")


def real_units(df: DataFrame, conventions: DataFrame, key: str = "releve_no", quantities: tuple[Quantity, ...] = QUANTITIES) -> DataFrame:
    """Every non-null value with its real unit and in the common unit.

    Columns: key, source, champ, valeur, declaree, unite_segment, changement
    (whether the value's history changes its unit anywhere), unite,
    valeur_commune.  The real unit is the declared one, else that of the segment
    of the source's history.  What ``conventions`` (source, champ, unite) lay down
    checks it: where a history has one unit throughout and the convention names
    another, the convention holds; where a level shift shows that the source
    changed its unit, the segment does, as no one unit fits the history.  A
    systolic pressure under 30 is never in mmHg but in cmHg, a glycaemia of 40 or
    more never in mmol/l but in mg/dl.  Values without a time or a logarithm go by
    convention; where nothing tells a unit it is the common one.  Repeated rows
    give repeated equal rows.
    """
    long = measures(df, quantities, key).persist(StorageLevel.MEMORY_AND_DISK)
    seg = segments(long, quantities)
    # a row per history, with its few segments in order
    spans = seg.groupBy("source", "champ").agg(
        F.array_sort(F.collect_list(F.struct("segment", "debut", "unite_segment"))).alias("spans"), F.bool_or("changement").alias("changement")
    )
    told = conventions.select(F.lower(F.trim("source")).alias("source"), "champ", F.col("unite").alias("convenue")).groupBy("source", "champ").agg(F.min("convenue").alias("convenue"))
    history = spans.join(told, ["source", "champ"], "full")
    rows = long.join(history, ["source", "champ"], "left")
    t = F.col("mesure_le").cast("double")
    begun = F.filter("spans", lambda z: z["debut"].isNull() | (z["debut"] <= t))
    rows = rows.withColumn("unite_segment", F.when(t.isNotNull() & (F.col("valeur") > 0), F.try_element_at(begun, F.lit(-1))["unite_segment"])).withColumn("changement", F.coalesce("changement", F.lit(False)))
    common = F.coalesce(*(F.when(F.col("champ") == q.value, q.common) for q in quantities))
    by_level = F.when(F.col("changement") | F.col("convenue").isNull() | (F.col("unite_segment") == F.col("convenue")), F.col("unite_segment"))
    unit = F.coalesce("declaree", by_level, "convenue", common)
    from_unit = F.when((F.col("champ") == PRESSURE.value) & (F.col("valeur") < 30) & (unit == "mmHg"), "cmHg").when(
        (F.col("champ") == GLUCOSE.value) & (F.col("valeur") >= 40) & (unit == "mmol/l"), "mg/dl"
    ).otherwise(unit)
    factor = F.coalesce(*(F.when((F.col("champ") == q.value) & (F.col("unite") == u), F.lit(f)) for q in quantities for u, f in q.factors.items()))
    return (
        rows.withColumn("unite", from_unit)
        .withColumn("valeur_commune", F.col("valeur") * factor)
        .select(key, "source", "champ", "valeur", "declaree", "unite_segment", "changement", "unite", "valeur_commune")
    )


def foreign_units(df: DataFrame, conventions: DataFrame, key: str = "releve_no", quantities: tuple[Quantity, ...] = QUANTITIES) -> DataFrame:
    """(key, champ, unite) of the values whose real unit isn't the common one.

    Candidates are values declared in another unit, values of a segment at the
    level of another unit and values that are implausible in the common unit;
    their real unit is then checked by ``real_units``.
    """
    rows = real_units(df, conventions, key, quantities)
    common = F.coalesce(*(F.when(F.col("champ") == q.value, q.common) for q in quantities))
    odd = ((F.col("champ") == PRESSURE.value) & (F.col("valeur") < 30)) | ((F.col("champ") == GLUCOSE.value) & (F.col("valeur") >= 40))
    candidate = (F.coalesce("declaree", "unite_segment", F.lit("")) != common) | odd
    return rows.where(candidate & (F.col("unite") != common)).select(key, "champ", "unite").distinct()
