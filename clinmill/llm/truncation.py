"""Texts that were cut by field limits or in transfer.

Per source, a right-censored log-normal distribution of lengths is fitted by
maximum likelihood (EM): texts at a candidate limit, in characters or in bytes,
are censored, the others are whole.  A length is a candidate limit if far more
texts have it than the distribution explains; the excess is the probability
that a text of this length was censored there.  This and the evidence of the
ending are added as log-odds; how much each kind of ending speaks for a cut is
fitted on the table itself, by EM over posteriors and kinds of ending.

The ending: a mark that closes a sentence or a tag speaks for a whole text, as
does a closing formula.  Formulas are learnt: last lines or last pieces of text
without a closing mark that end several texts of the table and that hardly any
text goes on from.  Anything else stops inside a word or sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinmill.llm.shingles import fold

# Marks that systems put behind a cut, and words that close a letter or post.
CUT_MARK = re.compile(
    r"(?:\s*(?:\(\s*(?:suite|\.\.\.|…|tronqu[ée]e?|truncated|cont(?:inued|\.)?|coup[ée]e?)\s*\)|\[\s*(?:\.\.\.|…|suite|tronqu[ée]e?|truncated|cut|coup[ée]e?)\s*\]"
    r"|<\s*(?:cut|truncated|tronqu[ée]|suite)\s*>|…|\.\.\.|>>+|�+|\b(?:lire la suite|voir la suite|voir plus|afficher la suite|à suivre|a suivre|read more|see more|show more|to be continued)\b\s*[.…>»]*))+\s*$",
    re.I,
)
CLOSERS = (
    r"(?:bien |tres |avec mes |mes |meilleures |sincerement |respectueusement )?(?:cordialement|confraternellement|amicalement|respectueusement|salutations(?: (?:distinguees|confraternelles|cordiales|respectueuses|amicales))?|bises)"
    r"|(?:bonne|belle|excellente) (?:journee|soiree|nuit|continuation|reception|semaine)(?: a (?:tous|vous))?|merci(?: a tous| a vous| d'avance| beaucoup| bien| encore)?|bien a vous|a bientot|bon courage"
    r"|(?:best |kind |warm )?regards|sincerely|yours(?: (?:sincerely|faithfully|truly))?|cheers|(?:many )?thanks(?: a lot| again| in advance)?|thank you"
)
WHOLE = re.compile(r"[.!?»”\"\]}]['’)\s]*$|[.!?][»”\")\]]*\s*$|--\s*$|==\s*$|\*\*\s*$")
CLOSING = re.compile(r"[»”\"\]})'’\s]*$")
#: Abbreviations that stand before something.
ABBREVIATED = re.compile(r"(?:^|[\s(])(?:dr|pr|mme|mlle|mr|mrs|ms|st|ste|cf|env|ex|fig|vs|e\.g|i\.e)\.$", re.I)
SEGMENT = re.compile(r"[^.!?\n]*$")
#: Longest piece that can be a formula; texts that must end with it; most that may go on from it.
LONGEST, TIMES, GO_ON = 60, 2, 0.25
#: Letters of a piece that are looked up first.
HEAD = 6
PIECES = re.compile(r"[.!?\n]+")
#: Slots of the filter of candidate formulas that goes to all tasks (a table of fixed size).
SLOTS = 1 << 20
#: Kinds of endings: a cut mark, a whole one, one that also stands inside a sentence, a closing formula, anything else.
KINDS = ("marque", "entiere", "ouverte", "formule", "rompue")
#: What is known of the kinds before a table is seen, as counts among whole and among cut texts of 5,000; they
#: grow with the table, so that it is weighed against them alike at every size.
BEFORE_WHOLE = (0.1, 1000.0, 50.0, 100.0, 1.0)
BEFORE_CUT = (50.0, 0.0, 1.0, 0.0, 1000.0)
BEFORE_TEXTS, BEFORE_RATE = 5000, 0.02
#: A text that ends with a sentence or a formula stops in neither a word nor a sentence, by definition; this log-odds says so.
NEVER = -1000.0
SHAPE = "doc_id bigint, source string, chars int, bytes int, whole boolean, mark boolean, segment string, inside boolean, texte bigint"
LIMITS = "source string, unite string, limite int, n bigint, attendu double, posterieur double, mu double, sigma double, n_textes bigint"


def shape(text: str) -> tuple[bool, bool, str]:
    """Whether a text ends like a whole one, whether a cut mark follows, and its last piece.

    The piece is what follows the last sentence mark or line break, cut marks
    and outer blanks aside; empty for whole endings.
    """
    t = text.rstrip()
    m = CUT_MARK.search(t)
    body = t[: m.start()].rstrip() if m else t
    if m and not body:
        return False, True, ""
    if WHOLE.search(body):
        return True, bool(m), ""
    return False, bool(m), " ".join(fold(SEGMENT.search(body)[0]).split())


def inside(text: str) -> bool:
    """Whether an ending that looks whole also stands inside a sentence: a
    quotation or bracket without a sentence mark, or an abbreviation."""
    t = text[-200:].rstrip()
    at = CLOSING.search(t).start()
    if at == len(t):
        return bool(ABBREVIATED.search(t))
    return "]]" not in t[at:] and t[:at][-1:] not in ".!?"


def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sources, texts = (c.to_pylist() for c in b.columns)
        found = [shape(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(sources, pa.string()),
                pa.array([len(t) for t in texts], pa.int32()),
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int32()),
                *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.bool_(), pa.bool_(), pa.string()))),
                pa.array([inside(t) for t in texts], pa.bool_()),
                pa.array([xxhash.xxh3_64_intdigest(t.strip().encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts], pa.int64()),
            ],
            names=[c.split()[0] for c in SHAPE.split(", ")],
        )


def _upper(z: float) -> float:
    """The normal upper tail."""
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def fit_censored(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Maximum likelihood (mu, sigma) of log lengths of which ``censored`` are only lower bounds."""
    x, w = np.log(np.maximum(lengths, 1)), counts.astype(float)
    mu = float(np.average(x, weights=w))
    sigma = max(float(np.sqrt(np.average((x - mu) ** 2, weights=w))), 0.05)
    known, bound = ~censored, x[censored]
    for _ in range(rounds):
        z = (bound - mu) / sigma
        hazard = np.array([math.exp(-0.5 * v * v) / math.sqrt(2 * math.pi) / _upper(v) for v in z.tolist()]).reshape(-1)
        first = mu + sigma * hazard
        second = mu**2 + sigma**2 + sigma * (bound + mu) * hazard
        total = w.sum()
        new = (np.dot(w[known], x[known]) + np.dot(w[censored], first)) / total
        var = (np.dot(w[known], x[known] ** 2) + np.dot(w[censored], second)) / total - new**2
        done = abs(new - mu) < 1e-7
        mu, sigma = float(new), max(math.sqrt(max(var, 0.0)), 0.05)
        if done:
            break
    return mu, sigma


def expected_at(length: np.ndarray, mu: float, sigma: float, n: float) -> np.ndarray:
    """Expected number of texts of exactly this length."""
    x = np.log(np.maximum(length, 1))
    return n * np.exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi) * np.maximum(length, 1))


def around(length: np.ndarray, count: np.ndarray, reach: int) -> np.ndarray:
    """For each of the rising lengths the texts up to ``reach`` away."""
    upto = np.r_[0.0, np.cumsum(count)]
    return upto[np.searchsorted(length, length + reach, "right")] - upto[np.searchsorted(length, length - reach, "left")]


def source_limits(pdf: pd.DataFrame, least: int = 5, excess: float = 6.0) -> list[dict]:
    """Candidate limits of one source from its histogram of lengths of one unit.

    A limit has at least ``least`` texts and ``excess`` times what the fit and
    its neighbourhood explain; the fit is repeated with the limits censored.
    """
    pdf = pdf.sort_values("length")
    length, count = pdf["length"].to_numpy(float), pdf["n"].to_numpy(float)
    n = count.sum()
    censored = np.zeros(len(length), bool)
    mu = sigma = 0.0
    expected = np.zeros(len(length))
    for _ in range(8):
        mu, sigma = fit_censored(length, count, censored)
        whole = n - count[censored].sum()
        near = (around(length, count * ~censored, 40) - around(length, count * ~censored, 3)) / 74
        expected = np.maximum(expected_at(length, mu, sigma, max(whole, 1.0)), near)
        now = censored | ((count >= least) & (count > excess * np.maximum(expected, 0.25)))
        if (now == censored).all():
            break
        censored = now
    return [
        {"limite": int(length[i]), "n": int(count[i]), "attendu": float(expected[i]), "posterieur": float(max(0.0, 1 - expected[i] / count[i])), "mu": mu, "sigma": sigma, "n_textes": int(n)}
        for i in np.flatnonzero(censored)
    ]


def unit_limits(shaped: DataFrame) -> DataFrame:
    """The candidate limits of all sources in each unit by itself, as ``LIMITS``."""
    at = F.explode(F.array(F.struct(F.lit("caracteres").alias("unite"), F.col("chars").alias("length")), F.struct(F.lit("octets").alias("unite"), F.col("bytes").alias("length"))))
    long = shaped.select("source", at.alias("a")).select("source", "a.*")
    # exact lengths, of which there are at most as many as the longest text has bytes
    counts = long.groupBy("source", "unite", "length").agg(F.count(F.lit(1)).alias("n"))

    def per_source(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = source_limits(pdf)
        return pd.DataFrame([{"source": key[0], "unite": key[1], **r} for r in rows], columns=[c.split()[0] for c in LIMITS.split(", ")])

    return counts.groupBy("source", "unite").applyInPandas(per_source, LIMITS)


def limits(shaped: DataFrame) -> DataFrame:
    """The candidate limits of all sources, as ``LIMITS``.

    Texts at a limit of one unit lie close together in the other unit too.  So
    the unit with the largest excess at one length comes first in each source;
    limits of the other unit are sought among the texts that its limits leave.
    """
    found = unit_limits(shaped).persist(StorageLevel.MEMORY_AND_DISK)
    main = found.groupBy("source").agg(F.max_by("unite", F.struct(F.col("n") - F.col("attendu"), "unite")).alias("unite"))
    first = found.join(main, ["source", "unite"], "left_semi")
    size = F.when(F.col("unite") == "caracteres", F.col("chars")).otherwise(F.col("bytes"))
    left = shaped.join(main, "source", "left").withColumn("limite", size).join(first.select("source", "unite", "limite"), ["source", "unite", "limite"], "left_anti")
    other = unit_limits(left.select("source", "chars", "bytes")).join(main, ["source", "unite"], "left_anti")
    return first.select(*found.columns).unionByName(other.select(*found.columns))


def slot(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % SLOTS


def formulas(shaped: DataFrame, texts: DataFrame) -> DataFrame:
    """(segment): closing formulas of the table.

    ``shaped`` has the posterior ``p_limite``; a text that was censored at a limit
    is no witness, so candidates end at least ``TIMES`` different texts that
    probably were not.  How often a text goes on from one is counted over all
    sentences and lines: tasks get a filter of the candidates, of a fixed size, a
    piece of text that passes it sends its beginnings, and the join by shuffle
    counts exactly.
    """
    ends = shaped.where(~F.col("whole") & (F.length("segment").between(2, LONGEST)))
    per = ends.groupBy("segment", "texte").agg(F.min("p_limite").alias("p"))
    ended = per.groupBy("segment").agg(F.sum(1 - F.col("p")).alias("n")).where(F.col("n") >= TIMES - 0.5).persist(StorageLevel.MEMORY_AND_DISK)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({slot(x) for s in b.column(0).to_pylist() for x in (s, "+" + s[:HEAD])}), pa.int32())], names=["slot"])

    passing = np.zeros(SLOTS, bool)
    passing[ended.select("segment").mapInArrow(slots, "slot int").distinct().toPandas()["slot"].to_numpy(np.int64)] = True  # at most SLOTS rows
    bits = np.packbits(passing).tobytes()

    def going_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bits, np.uint8)).tolist()
        short: dict[str, list[str]] = {}  # what the first letters of a piece pass

        def passed(head: str) -> list[str]:
            if len(short) > SLOTS:
                short.clear()
            short[head] = [head[:k] for k in range(2, min(HEAD, len(head))) if held[slot(head[:k])]] + (["+"] if len(head) == HEAD and held[slot("+" + head)] else [])
            return short[head]

        for b in batches:
            seen: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                for piece in PIECES.split(fold(t)):
                    piece = " ".join(piece[: 3 * LONGEST].split())
                    head = piece[:HEAD]
                    for start in short[head] if head in short else passed(head):
                        if start != "+":
                            seen[start] += 1
                            continue
                        for k in range(HEAD, min(LONGEST + 1, len(piece))):
                            if held[slot(piece[:k])]:
                                seen[piece[:k]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["segment", "m"])

    on = texts.select("text").mapInArrow(going_on, "segment string, m bigint").groupBy("segment").agg(F.sum("m").alias("m"))
    return ended.join(on, "segment", "left").where(F.coalesce("m", F.lit(0)) <= F.col("n") * GO_ON).select("segment")


def fit_endings(counts: pd.DataFrame, rounds: int = 200) -> tuple[dict[str, float], float]:
    """Log-odds of being cut for each kind of ending, and those of a text away from all limits.

    ``counts`` has ``fin`` (a kind), ``p`` (the posterior, 0 away from limits) and
    ``n``.  EM: whether a text is cut is hidden; its prior is its posterior of
    censoring, or away from limits one rate for the table.
    """
    if not len(counts):
        counts = pd.DataFrame({"fin": [KINDS[1]], "p": [0.0], "n": [1]})
    kind = np.array([KINDS.index(k) for k in counts["fin"]], int)
    p, n = counts["p"].to_numpy(float), counts["n"].to_numpy(float)
    away = p <= 0
    rate = BEFORE_RATE
    scale = n.sum() / BEFORE_TEXTS
    whole, cut = (np.array(x) / sum(x) for x in (BEFORE_WHOLE, BEFORE_CUT))
    for _ in range(rounds):
        prior = np.clip(np.where(away, rate, p), 1e-6, 1 - 1e-6)
        a, b = prior * cut[kind], (1 - prior) * whole[kind]  # no kind that is never cut becomes one
        q = a / (a + b)
        new = float(((q * n)[away].sum() + BEFORE_RATE * 100 * scale) / max(n[away].sum() + 100 * scale, 1e-9))
        cut = np.bincount(kind, q * n, len(KINDS)) + scale * np.array(BEFORE_CUT)
        whole = np.bincount(kind, (1 - q) * n, len(KINDS)) + scale * np.array(BEFORE_WHOLE)
        cut, whole = cut / cut.sum(), whole / whole.sum()
        if abs(new - rate) < 1e-9:
            break
        rate = new
    weight = np.where(cut > 0, np.log(np.maximum(cut, 1e-300) / whole), NEVER)
    return dict(zip(KINDS, weight.tolist())), math.log(rate / (1 - rate))


class Truncation:
    """Truncated texts of a table with ``doc_id``, ``text`` and ``source``.

    Sources that differ in case or outer blanks are one; null sources are one
    named "".  Null and blank texts are no cases.  A repeated row counts once.
    Other columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> None:
        self.texts = df.select(
            F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), F.lit("")).alias("source"), F.col(text).alias("text")
        ).where(F.col("text").rlike(r"(?U)\S") & F.col("doc_id").isNotNull())
        self.shaped = self.texts.mapInArrow(shapes, SHAPE).distinct().persist(StorageLevel.MEMORY_AND_DISK)

    def scored(self) -> DataFrame:
        """Per text the censoring posterior at its length, the kind of its ending
        and the sum of both evidences as log-odds of being cut."""
        limit = limits(self.shaped).select("source", "unite", "limite", "posterieur").persist(StorageLevel.MEMORY_AND_DISK)
        per = {
            u: limit.where(F.col("unite") == u).select("source", F.col("limite").alias(c), F.col("posterieur").alias(f"p_{c}"))
            for u, c in (("caracteres", "chars"), ("octets", "bytes"))
        }
        at_limit = self.shaped.join(per["caracteres"], ["source", "chars"], "left").join(per["octets"], ["source", "bytes"], "left")
        at_limit = at_limit.withColumn("p_limite", F.coalesce(F.greatest("p_chars", "p_bytes"), F.lit(0.0)))
        found = formulas(at_limit, self.texts).withColumn("formule", F.lit(True))
        rows = at_limit.join(found, "segment", "left")
        closer = F.col("segment").rlike(rf"^(?:{CLOSERS})\W*$")
        complete = F.coalesce("formule", F.lit(False)) | closer
        marked, whole, open_, formula, broken = KINDS
        ending = (
            F.when(F.col("mark") & ~F.col("whole") & ~complete, marked).when(F.col("whole") & F.col("inside"), open_)
            .when(F.col("whole"), whole).when(complete, formula).otherwise(broken)
        )
        kinds = rows.withColumn("fin", ending).persist(StorageLevel.MEMORY_AND_DISK)
        counts = kinds.groupBy("fin", F.round("p_limite", 4).alias("p")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 10,001 rows a kind
        weight, away = fit_endings(counts)
        p = F.col("p_limite")
        at = F.when(p <= 0, F.lit(away)).when(p >= 1, F.lit(36.0)).otherwise(F.log(p / (1 - p)))
        told = F.coalesce(*(F.when(F.col("fin") == k, F.lit(w)) for k, w in weight.items()))
        return kinds.withColumn("log_odds", at + told).select("doc_id", "source", "chars", "bytes", "whole", "mark", "segment", "p_limite", "fin", "log_odds")

    def found(self) -> DataFrame:
        """(doc_id) of the texts that are more likely cut than not."""
        return self.scored().where("log_odds > 0").select("doc_id").distinct()

    def rates(self) -> DataFrame:
        """Per source: texts, cut texts, rate and cut texts at a candidate limit."""
        cut = F.col("log_odds") > 0
        return (
            self.scored().groupBy("source")
            .agg(F.count(F.lit(1)).alias("n_textes"), F.count_if(cut).alias("n_coupes"), F.count_if(cut & (F.col("p_limite") > 0.5)).alias("n_a_la_limite"))
            .withColumn("taux", F.col("n_coupes") / F.col("n_textes"))
        )
