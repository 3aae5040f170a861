"""Model answers as a table: parsing, stages with early exit, checks, prompts.

``responses`` has id, stage, attempt and raw_text.  An operator joins what a
stage needs; nothing is called from a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinmill.functions.messages import first_json
from clinmill.functions.text import loosely_quoted, quoted


def parsed(responses: DataFrame, stage: str, schema: str, valid: Column | None = None) -> DataFrame:
    """(id, value, erreur): the last readable answer of a stage per id, else the last unreadable one.

    ``valid`` is a further condition on ``value``.
    """
    rows = responses.where(F.col("stage") == stage).withColumn("_j", first_json(F.col("raw_text"), schema))
    rows = rows.select("id", "attempt", F.col("_j.value").alias("value"), F.col("_j.erreur").alias("erreur"))
    if valid is not None:
        rows = rows.withColumn("erreur", F.when(F.col("erreur").isNull() & ~F.coalesce(valid, F.lit(False)), "reponse_invalide").otherwise(F.col("erreur")))
    w = Window.partitionBy("id").orderBy(F.col("erreur").isNotNull(), F.desc("attempt"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("id", "value", "erreur")


def staged(df: DataFrame, responses: DataFrame, stages: list[tuple[str, str, Column | None]]) -> DataFrame:
    """Adds a column per stage (name, schema, condition) and ``_echec``, the
    first stage without a usable answer; the stages after it are null."""
    out = df.withColumn("_echec", F.lit(None).cast("string"))
    for name, schema, valid in stages:
        answer = parsed(responses, name, schema, valid).select("id", F.col("value").alias("_v"), F.col("erreur").alias("_e"))
        out = out.join(answer, "id", "left")
        failed = F.col("_echec").isNotNull()
        bad = F.col("_v").isNull() | F.col("_e").isNotNull()
        out = out.withColumn(name, F.when(~failed & ~bad, F.col("_v"))).withColumn("_echec", F.when(failed, F.col("_echec")).when(bad, name)).drop("_v", "_e")
    return out


def first_valid(df: DataFrame, keys: list[str], attempt: str, problems: str) -> DataFrame:
    """The first attempt without problems of each key, with how many were refused; keys without one keep their last attempt."""
    ok = F.coalesce(F.size(problems), F.lit(0)) == 0
    refused = F.count_if(~ok).over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy(~ok, F.when(ok, F.col(attempt)), F.desc(attempt))
    return df.withColumn("n_refuses", refused).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def in_domain(value: Column, domain: list[str]) -> Column:
    """The value if it is in the domain, else null."""
    return F.when(value.isin(*domain), value)


def kept_criteria(criteria: Column, quotes: Column, text: Column, strict: bool = False) -> Column:
    """struct(gardes, rejetes): criteria (with their quotations in a map) that the text bears out, and the others."""
    check = (lambda c: quoted(quotes[c], text)) if strict else (lambda c: loosely_quoted(quotes[c], text))
    good = lambda c: F.coalesce(check(c), F.lit(False))
    return F.struct(F.filter(criteria, good).alias("gardes"), F.filter(criteria, lambda c: ~good(c)).alias("rejetes"))


def provenance(**facts: str | Column) -> Column:
    """A struct of how a row was made; give the clock as a column, so that runs can be repeated."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in facts.items()))


def sectioned(items: DataFrame, section: str, line: Column, order: list[str], first: str) -> DataFrame:
    """One text per section: known sections in their order, others after them by their first item; lines in order.

    Columns: section, rang, texte.  For catalogues that go into a prompt, so of a bounded size.
    """
    place = F.coalesce(*(F.when(F.col(section) == s, i) for i, s in enumerate(order)), F.lit(len(order)))
    per = items.groupBy(F.col(section).alias("section")).agg(
        F.min(place).alias("_p"), F.min(first).alias("_f"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(first).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("texte")
    )
    return per.withColumn("rang", F.row_number().over(Window.orderBy("_p", "_f"))).select("section", "rang", "texte")


def rendered(template: str, **values: Column) -> Column:
    """A template with ``{name}`` slots filled by columns; null values leave them empty, other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def visible_json(*columns: str) -> Column:
    """The given columns only, as JSON, nulls kept: what a model may see of a row."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def golden(df: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field whether a row equals the expected one (null equals null; arrays as sets), and whether all do."""
    e = expected.select(key, *(F.col(f).alias(f"_x_{f}") for f in fields))
    kinds = dict(df.dtypes)
    same = {f: F.array_sort(F.array_distinct(f)).eqNullSafe(F.array_sort(F.array_distinct(f"_x_{f}"))) if kinds[f].startswith("array") else F.col(f).eqNullSafe(F.col(f"_x_{f}")) for f in fields}
    out = df.join(e, key).select(key, *(c.alias(f"ok_{f}") for f, c in same.items()))
    return out.withColumn("ok", F.forall(F.array(*(F.col(f"ok_{f}") for f in fields)), lambda x: x))
