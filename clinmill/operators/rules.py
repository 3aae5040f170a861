"""Rule tables compiled to columns, review queues and guards over messages.

The tables themselves (thresholds, categories, patterns) are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinmill.functions.numeric import looked_up
from clinmill.functions.text import folded


@dataclass(frozen=True)
class Rule:
    """A condition with what follows if it holds."""

    name: str
    condition: Column
    level: str
    group: str = ""


def fired(rules: list[Rule]) -> Column:
    """array<struct(regle, niveau, groupe)> of the rules that hold; null conditions don't."""
    each = [F.when(F.coalesce(r.condition, F.lit(False)), F.struct(F.lit(r.name).alias("regle"), F.lit(r.level).alias("niveau"), F.lit(r.group).alias("groupe"))) for r in rules]
    return F.array_compact(F.array(*each))


def floor_of(flags: Column, order: list[str], group: str | None = None) -> Column:
    """The level of the flags that comes first in the order; null for none."""
    rank = {v: i for i, v in enumerate(order)}
    some = flags if group is None else F.filter(flags, lambda f: f["groupe"] == group)
    return F.get(F.array(*map(F.lit, order)), F.array_min(F.transform(some, lambda f: looked_up(f["niveau"], rank))))


def raised(label: Column, floor: Column, order: list[str]) -> Column:
    """struct(final, releve): a label raised to a floor that comes earlier in the order; either may be null."""
    rank = {v: i for i, v in enumerate(order)}
    up = F.coalesce(looked_up(floor, rank) < looked_up(label, rank), F.lit(False))
    return F.struct(F.when(up, floor).otherwise(F.coalesce(label, floor)).alias("final"), up.alias("releve"))


def triggered_modifiers(cases: DataFrame, modifiers: DataFrame, key: str, motif: str, criteria: str) -> DataFrame:
    """Modifiers (motif, critere, tri) of a case's motif whose criterion it has: (key, critere, tri)."""
    have = cases.select(key, F.col(motif).alias("motif"), F.explode(criteria).alias("critere")).distinct()
    return have.join(modifiers, ["motif", "critere"]).select(key, "critere", "tri")


def scored(df: DataFrame, reasons: list[tuple[str, Column, str, Column]]) -> DataFrame:
    """Adds raisons, a_relire, priorite and score.

    Reasons: (code, condition, priority "haute" or "basse", score).  A row is
    to be read again if a high one holds; the score is the largest of those.
    """
    each = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(p).alias("priorite"), s.cast("int").alias("score"))) for code, c, p, s in reasons]
    out = df.withColumn("raisons", F.array_compact(F.array(*each)))
    high = F.filter("raisons", lambda r: r["priorite"] == "haute")
    return out.withColumns(
        {
            "a_relire": F.size(high) > 0,
            "priorite": F.when(F.size(high) > 0, "haute").when(F.size("raisons") > 0, "basse"),
            "score": F.coalesce(F.array_max(F.transform(high, lambda r: r["score"])), F.lit(0)),
        }
    )


def review_queue(df: DataFrame, key: str, high: str, score: str, low: str, n: int, sample: int, seed: int = 42) -> DataFrame:
    """High rows by score, then a seeded sample, then low rows, ranked; ``dans_le_budget`` for the first.

    The blocks are ordered by one global sort (a report of bounded size).
    """
    from clinmill.functions.text import seeded

    rest = ~F.col(high)
    drawn = df.where(rest).withColumn("_k", seeded(seed, key)).orderBy("_k", key).limit(sample).select(key, F.lit(1).alias("_drawn"))
    rows = df.join(drawn, key, "left").withColumn("bloc", F.when(F.col(high), 0).when(F.col("_drawn") == 1, 1).when(F.col(low), 2))
    queue = rows.where("bloc is not null").orderBy("bloc", F.desc(score), key).limit(n + sample)
    ranked = queue.withColumn("rang", F.row_number().over(Window.orderBy("bloc", F.desc(score), key)))  # n + sample rows
    return ranked.withColumn("dans_le_budget", (F.col("bloc") == 1) | ((F.col("bloc") == 0) & (F.col("rang") <= n - sample))).drop("_drawn")


# Ends of a clause and words that negate, folded.
CLAUSE = r"[.;:!?,…]|\b(?:et|mais|puis|donc|alors|sauf que|par contre)\b"
NEGATION = r"\b(?:pas|ni|aucune?|sans|jamais)\b"


def said(text: Column, pattern: str, clause: str = CLAUSE, negation: str = NEGATION) -> Column:
    """Whether a pattern stands in some clause of a text with no negation before it ("sais pas" is none)."""
    clauses = F.split(F.regexp_replace(folded(text), r"\bsais pas\b", "sais_"), clause)
    head = lambda c: F.substr(c, F.lit(1), F.regexp_instr(c, F.lit(pattern)) - 1)
    return F.coalesce(F.exists(clauses, lambda c: c.rlike(pattern) & ~head(c).rlike(negation)), F.lit(False))


def signs(text: Column, families: dict[str, list[str]], combos: list[tuple[str, str, str]] = []) -> Column:  # noqa: B006
    """Names of the families of which a pattern is said, and of combinations (name, pattern, pattern)."""
    each = [F.when(said(text, "(?:" + "|".join(p) + ")"), name) for name, p in families.items()]
    each += [F.when(said(text, a) & said(text, b), name) for name, a, b in combos]
    return F.array_compact(F.array(*each))


def first_hit(turns: DataFrame, conversation: str, turn: str, role: str, text: str, patient: str, families: dict[str, list[str]], combos: list[tuple[str, str, str]] = []) -> DataFrame:  # noqa: B006
    """Per conversation the first patient turn at which the signs of all patient text so far aren't empty.

    A sign stands in one clause, so each turn is searched once; a combination
    (name, pattern, pattern) holds from the turn that brings its second pattern.
    """
    at = lambda p: F.min(F.when(said(F.col(text), p), F.col(turn)))
    first = [at("(?:" + "|".join(p) + ")").alias(f"f{i}") for i, p in enumerate(families.values())]
    first += [c for i, (_, a, b) in enumerate(combos) for c in (at(a).alias(f"a{i}"), at(b).alias(f"b{i}"))]
    since = {name: F.col(f"f{i}") for i, name in enumerate(families)}
    since |= {name: F.when(F.col(f"a{i}").isNotNull() & F.col(f"b{i}").isNotNull(), F.greatest(f"a{i}", f"b{i}")) for i, (name, _, _) in enumerate(combos)}
    per = turns.where(F.col(role) == patient).groupBy(conversation).agg(*first)
    hit = per.withColumn("tour", F.array_min(F.array_compact(F.array(*since.values())))).where("tour is not null")
    return hit.select(conversation, "tour", F.array_compact(F.array(*(F.when(c <= F.col("tour"), F.lit(name)) for name, c in since.items()))).alias("signes"))


def out_of_scope(text: Column, outside: list[str], inside: list[str]) -> Column:
    """Whether a text matches a pattern outside the domain and none inside."""
    t = folded(text)
    return F.coalesce(t.rlike("|".join(outside)) & ~t.rlike("|".join(inside)), F.lit(False))


def final_decision(floor: Column, probabilities: Column, labels: list[str], threshold: float = 0.30) -> Column:
    """The floor if there is one, else the label by threshold and argmax."""
    from clinmill.functions.numeric import decided

    return F.coalesce(floor, F.get(F.array(*map(F.lit, labels)), decided(probabilities, threshold)))


def catalogue_from_grid(grid: DataFrame, key: str, levels: dict[str, str], skip: str = "avis referent") -> DataFrame:
    """Wide grid rows to (key, tri, critere): one row per level cell; cells that
    refer to a consultant are dropped, repeated rows of a key merge in text order."""
    stacked = grid.select(key, F.explode(F.array(*(F.struct(F.lit(t).alias("tri"), F.col(c).alias("critere")) for c, t in levels.items()))).alias("x")).select(key, "x.*")
    kept = stacked.where((F.coalesce(F.trim("critere"), F.lit("")) != "") & ~folded(F.col("critere")).contains(skip))
    return kept.groupBy(key, "tri").agg(F.array_join(F.array_sort(F.collect_set(F.trim("critere"))), " ; ").alias("critere"))
