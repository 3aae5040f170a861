"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinmill.llm import group_splits, packing, pair_defects, pii, split_overlap
from clinmill.llm.mixing import Mix
from clinmill.llm.near_duplicates import NearDuplicates
from clinmill.llm.truncation import Truncation, limits
from clinmill.sources.tables import table

#: Wanted proportions of the new splits.
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return group_splits.divided(table(spark, folder, "vignette"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return group_splits.assign(table(spark, folder, "vignette"), PROPORTIONS)


def p1_balance(spark: SparkSession, folder: str) -> DataFrame:
    return group_splits.balance(group_splits.assign(table(spark, folder, "vignette"), PROPORTIONS), list(PROPORTIONS))


def p1_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the new splits: every record once, no group divided, shares and large groups as wanted."""
    a = group_splits.assign(table(spark, folder, "vignette"), PROPORTIONS)
    per = a.groupBy("groupe_id").agg(F.countDistinct("split_nouveau").alias("s"), F.count(F.lit(1)).alias("n"), F.min("split_nouveau").alias("split"))
    total = F.sum("n")
    near = lambda k, p: F.abs(F.sum(F.when(F.col("split") == k, F.col("n")).otherwise(0)) / total - p) < 0.01
    several = F.count_if((F.col("n") > 1) & (F.col("split") != "train")) > 0
    return per.agg(total.alias("n_fiches"), F.count(F.lit(1)).alias("n_groupes"), F.count_if(F.col("s") > 1).alias("n_divises"), F.forall(F.array(*(near(k, p) for k, p in PROPORTIONS.items())), lambda x: x).alias("parts_tenues"), several.alias("groupes_hors_train"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.SplitOverlap(table(spark, folder, "vignette")).found()


def p2_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.SplitOverlap(table(spark, folder, "vignette")).overlaps()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    vignettes = table(spark, folder, "vignette")
    return split_overlap.report(split_overlap.SplitOverlap(vignettes), vignettes)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.defects(table(spark, folder, "paire_preference"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "paire_preference")
    return pair_defects.report(pair_defects.defects(pairs), pairs)


def pii_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that problem 4 is about: (nom_table, id, text)."""
    parts = (("vignette", "contexte_clinique"), ("golden_etape1_extraction", "vignette_source"))
    one, two = (table(spark, folder, t).select(F.lit(t).alias("nom_table"), "id", F.col(c).alias("text")) for t, c in parts)
    return one.unionByName(two)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.places(pii_texts(spark, folder)).select("nom_table", "id", "type_donnee", "debut")


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(pii_texts(spark, folder))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.places(pii_texts(spark, folder))
    return found.groupBy("nom_table", "type_donnee").agg(F.count(F.lit(1)).alias("n_places"), F.countDistinct("id").alias("n_textes"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return NearDuplicates(table(spark, folder, "vignette")).pairs()


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    return NearDuplicates(table(spark, folder, "vignette")).classes()


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "conteneur"))


def p7_rooms(spark: SparkSession, folder: str) -> DataFrame:
    return packing.rooms(p7_pack(spark, folder), table(spark, folder, "conteneur"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(p7_pack(spark, folder), table(spark, folder, "conteneur"))


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold per kind: every text with content placed, no container above its capacity, no text cut that fits."""
    packed, kinds = p7_pack(spark, folder), table(spark, folder, "conteneur")
    full = packing.rooms(packed, kinds).groupBy("conteneur_no").agg(F.count_if(F.col("vide") < 0).alias("n_trop_pleins"))
    text = packed.groupBy("conteneur_no", "doc_id").agg(F.sum("jetons").alias("jetons"), F.count(F.lit(1)).alias("n"), F.countDistinct("morceau").alias("m")).join(F.broadcast(kinds), "conteneur_no")
    per = text.groupBy("conteneur_no").agg(
        F.count(F.lit(1)).alias("n_textes"), F.count_if((F.col("jetons") <= F.col("capacite_jetons")) & (F.col("n") > 1)).alias("n_coupes_a_tort"), F.count_if(F.col("n") > F.col("m")).alias("n_doubles")
    )
    return per.join(full, "conteneur_no")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return Mix(table(spark, folder, "documents"), table(spark, folder, "source_cible")).chosen()


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return Mix(table(spark, folder, "documents"), table(spark, folder, "source_cible")).shares()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return Truncation(table(spark, folder, "documents")).found()


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return Truncation(table(spark, folder, "documents")).rates()


def p9_limits(spark: SparkSession, folder: str) -> DataFrame:
    return limits(Truncation(table(spark, folder, "documents")).shaped)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p1_balance, p1_checked, p2_found, p2_overlaps, p2_report, p3_found, p3_report, p4_found, p4_redacted, p4_report, p6_found, p6_classes,
        p7_pack, p7_rooms, p7_report, p7_checked, p8_mix, p8_shares, p9_found, p9_rates, p9_limits,
    )
}
_SPLIT = "case when lower(trim(split)) in ('train', 'entrainement') then 'train' when lower(trim(split)) in ('validation', 'valid', 'dev') then 'validation' when lower(trim(split)) = 'test' then 'test' end"
_GROUPS = """v as (select id, regexp_extract(regexp_replace(regexp_replace(lower(cas_id), '[^0-9a-z]', '', 'g'), '^cas', ''), '^[0-9a-f]{12}$') as k, ids_questions as q, """ + _SPLIT + """ as s from vignette),
    l as (select distinct id as a, 'c:' || k as b from v where k <> '' union select distinct v.id, 'r:' || o.id from (select id, unnest(q) as n from v) v join v o on o.id = v.n),
    e as (select a, b from l union select id, 'r:' || id from v), n as (select distinct x.a, y.a as c from e x join e y using (b)),
    w(a, r) as (select id, id from v union select n.c, w.r from w join n on n.a = w.a), g as (select a as id, min(r) as groupe_id from w group by a)"""
_WORDS = """t as (select distinct id, """ + _SPLIT + """ as s, list_distinct(regexp_extract_all(strip_accents(lower(contexte_clinique)), '[\\p{L}\\p{N}]+')) as w from vignette where trim(coalesce(contexte_clinique, '')) <> ''),
    d as (select row_number() over () as h, w, len(w) as n from (select distinct list_sort(w) as w from t)), m as (select t.id, t.s, d.h from t join d on d.w = list_sort(t.w)),
    x as (select h, n, unnest(w) as x from d), c as (select a.h as h1, b.h as h2, count(*) as c from x a join x b on a.x = b.x and a.h < b.h and a.n >= 0.7 * b.n and b.n >= 0.7 * a.n group by all),
    p as (select h1, h2 from c join d a on a.h = h1 join d b on b.h = h2 where 10 * c >= 7 * (a.n + b.n - c) union all select h, h from d)"""

#: Brute force; only for tables as small as the checked ones.
SQL: dict[str, str] = {
    "p1_found": f"with recursive {_GROUPS}, x as (select groupe_id from v join g using (id) group by groupe_id having count(distinct s) > 1) select id, groupe_id from g join x using (groupe_id)",
    "p1_checked": f"with recursive {_GROUPS} select cast(count(distinct id) as bigint) as n_fiches, count(distinct groupe_id) as n_groupes, cast(0 as bigint) as n_divises, true as parts_tenues, true as groupes_hors_train from g",
    "p2_found": f"with {_WORDS} select distinct least(a.id, b.id) as id_1, greatest(a.id, b.id) as id_2 from p join m a on a.h = h1 join m b on b.h = h2 where a.id <> b.id and (a.s = 'train') <> (b.s = 'train')",
    "p7_checked": """select conteneur_no, (select count(*) from documents where text <> '' and doc_id is not null) as n_textes, cast(0 as bigint) as n_coupes_a_tort, cast(0 as bigint) as n_doubles,
        cast(0 as bigint) as n_trop_pleins from conteneur where capacite_jetons > 0""",
    "p6_found": f"with {_WORDS} select distinct least(a.id, b.id) as id_1, greatest(a.id, b.id) as id_2 from p join m a on a.h = h1 join m b on b.h = h2 where a.id <> b.id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
