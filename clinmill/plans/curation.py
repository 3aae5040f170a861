"""Queries of ingestion, filters, deduplication, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinmill.functions import text as T
from clinmill.operators import dedup, preference, reports, sampling, vignettes
from clinmill.plans import sql as Q
from clinmill.sources.tables import table

CTX = "contexte_clinique"


def _vignettes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vignette")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return vignettes.vignette(
        d, id=F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), source=F.trim("source"), langue=F.lower(F.substring("lang", 1, 2)), contexte_clinique=F.col("text"),
        question=vignettes.main_text("text"), task=F.col("genre_doc"),
    ).withColumn("ord", F.expr("cast(substring(id, 5) as bigint)"))


DOCS = """select 'doc_' || doc_id as id, trim(source) as source, lower(substr(lang, 1, 2)) as langue, text as contexte_clinique, coalesce(nullif(text, ''), '') as question,
    genre_doc as task, doc_id as ord from documents"""
VALID = "coalesce(id, '') <> '' and coalesce(source, '') <> '' and coalesce(langue, '') <> '' and coalesce(question, '') <> ''"


def vignette_normalised(spark, folder):
    return vignettes.valid(_documents(spark, folder)).select("id", "source", "langue", CTX, "question", "task")


def required_fields_report(spark, folder):
    rows = _vignettes(spark, folder).withColumn("champ", F.explode(vignettes.missing_fields((*vignettes.REQUIRED, CTX, "specialite"))))
    return reports.value_counts(rows, "source", "champ")


def document_texts(spark, folder):
    texts = dedup.exact(vignettes.valid(_documents(spark, folder)), CTX, "id", "ord")
    first = texts.withColumnRenamed("conserve", "id").join(_documents(spark, folder).select("id", "langue"), "id")
    return first.groupBy("langue").agg(F.count(F.lit(1)).alias("n_textes"), F.sum("n_questions").alias("n_lignes"), F.countDistinct("cas_id").alias("n_cas"))


def context_filter(spark, folder):
    return reports.value_counts(vignettes.with_context(_vignettes(spark, folder)), "source")


def case_fingerprint(spark, folder):
    return _vignettes(spark, folder).where(f"{CTX} is not null").select("ord", T.case_fingerprint(F.col(CTX)).alias("cas_id"))


def hashed_ids(spark, folder):
    q = F.col("question")
    return _vignettes(spark, folder).where("question is not null").select("ord", T.prompt_hash(q).alias("empreinte"), T.prompt_hash(q, 12).alias("empreinte_12"), T.content_id(q).alias("identifiant"))


def dedup_exact(spark, folder):
    return dedup.exact(_vignettes(spark, folder), CTX, "id", "ord").select("conserve", "cas_id", "premier", "n_questions")


def dedup_correspondence(spark, folder):
    return dedup.correspondence(_vignettes(spark, folder), CTX, "ord", "ord")


def case_variants(spark, folder):
    return dedup.variants(_vignettes(spark, folder), CTX, "id", "ord")


def dedup_shortest_variant(spark, folder):
    return dedup.shortest(_vignettes(spark, folder), CTX, "ord", "ord")


def dedup_report(spark, folder):
    return dedup.report(_vignettes(spark, folder), CTX, "ord", "ord")


def filter_stability(spark, folder):
    v = _vignettes(spark, folder)
    return dedup.filter_stability(v, v.select("ord", F.coalesce(F.col("type_question") == "Reasoning", F.lit(False)).alias("retenu")), CTX, "ord", "ord")


def first_per_case(spark, folder):
    return dedup.first_per_key(_vignettes(spark, folder).where("cas_id is not null").select("cas_id", "ord", "id"), ["cas_id"], ["ord"])


def first_difference(spark, folder):
    v = _vignettes(spark, folder)
    a = v.where(f"{CTX} is not null").groupBy("id").agg(F.min(CTX).alias("a"), F.max("question").alias("b")).where("b is not null")
    return a.select("id", dedup.first_difference("a", "b").alias("position"))


def relevance_split(spark, folder):
    v = _vignettes(spark, folder)
    decided = v.where("specialite is not null").groupBy("id").agg(F.max((F.col("specialite") == "Cardiologie")).alias("urgence"), F.max("specialite").alias("justification"))
    out = vignettes.relevance(v, decided)
    return out.groupBy("_filtre_urgence", "_filtre_justification").agg(F.count(F.lit(1)).alias("n"))


def keyword_relevance(spark, folder):
    p = table(spark, folder, "paire_preference")
    return p.groupBy("source", F.coalesce(vignettes.mentions(F.col("prompt")), F.lit(False)).alias("urgence")).agg(F.count(F.lit(1)).alias("n"))


def candidate_pairs(spark, folder):
    p = table(spark, folder, "paire_preference")
    ok = vignettes.candidate_pair(F.col("prompt"), F.col("chosen"), F.col("rejected"))
    return p.where(ok & F.col("source").isin("ultramedical", "ultramedical_fr")).select("paire_id", "source").distinct()


def validated_pairs(spark, folder):
    return preference.usable(table(spark, folder, "paire_preference")).select("paire_id").distinct()


def first_occurrences(spark, folder):
    """Deliveries that say what an earlier one said: not current any more."""
    c = table(spark, folder, "cas_clinique").select("releve_no", "recu_le")
    now = c.groupBy("releve_no").agg(F.max("recu_le").alias("courant"))
    return c.join(now, "releve_no", "left").where("courant is not null and courant <> recu_le").groupBy("releve_no").agg(F.count(F.lit(1)).alias("n_perimes"))


def seeded_sample(spark, folder):
    return sampling.sample(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", 50, 42)


def group_split(spark, folder):
    rows = _vignettes(spark, folder).select("ord", "cas_id")
    return sampling.group_split(rows, "cas_id", 0.1, 42)


def split_leaks(spark, folder):
    return sampling.leaks(_vignettes(spark, folder).select("cas_id", F.lower(F.trim("split")).alias("jeu")).where("jeu is not null"), "cas_id")


def resume_anti_join(spark, folder):
    e = table(spark, folder, "events")
    done = e.where(F.col("ts") < F.lit("2024-01-01 12:00:00").cast("timestamp")).select("user_id", "event_type", F.when(F.col("value") < 5, "echec").alias("_erreur"))
    todo = e.select("event_id", "user_id", "event_type")
    return sampling.pending(todo, done, ["user_id", "event_type"], "_erreur").select("event_id")


def last_success(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_type", "event_id", F.when(F.col("value") < 5, "echec").alias("_erreur"))
    return sampling.last_success(e, ["user_id", "event_type"], "event_id", "_erreur")


def variants_explode(spark, folder):
    v = _vignettes(spark, folder).select("ord", "type_question")
    return sampling.variants(v, "type_question", {"Reasoning": 2, "Understanding": 3}).select("ord", "variante")


def union_sources(spark, folder):
    docs = _documents(spark, folder).select("id", "source", "langue")
    pairs = table(spark, folder, "paire_preference").select(F.concat(F.lit("p_"), F.col("paire_id").cast("string")).alias("id"), "source", "label_type")
    return sampling.union(docs, pairs).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("langue").alias("n_langue"), F.count("label_type").alias("n_label"))


def id_difference(spark, folder):
    c = table(spark, folder, "cas_clinique").select("id").distinct()
    return _vignettes(spark, folder).select("id").distinct().exceptAll(c)


def id_intersection(spark, folder):
    return _vignettes(spark, folder).select("id").intersect(table(spark, folder, "cas_clinique").select("id"))


def set_equality(spark, folder):
    c = table(spark, folder, "cas_clinique").where("criteres_presents is not null").select("releve_no", F.array_join(F.array_sort(F.array_distinct("criteres_presents")), "|").alias("criteres"))
    return c.groupBy("releve_no").agg((F.countDistinct("criteres") == 1).alias("egaux"))


def anonymised_titles(spark, folder):
    v = _vignettes(spark, folder).where(f"{CTX} is not null")
    return v.where(F.size(T.titled_names(F.col(CTX))) > 0).select("ord", F.array_join(T.titled_names(F.col(CTX)), "|").alias("noms"), F.md5(T.without_titled_names(F.col(CTX))).alias("texte"))


def column_profile(spark, folder):
    return reports.profile(table(spark, folder, "paire_preference"), ["source", "label_type", "langue", "prompt"])


QUERIES = {
    f.__name__: f
    for f in (
        vignette_normalised, required_fields_report, document_texts, context_filter, case_fingerprint, hashed_ids, dedup_exact, dedup_correspondence, case_variants, dedup_shortest_variant,
        dedup_report, filter_stability, first_per_case, first_difference, relevance_split, keyword_relevance, candidate_pairs, validated_pairs, first_occurrences, seeded_sample, group_split,
        split_leaks, resume_anti_join, last_success, variants_explode, union_sources, id_difference, id_intersection, set_equality, anonymised_titles, column_profile,
    )
}

_CASE = Q.case_id(CTX, "id")
_CASE_ORD = Q.case_id(CTX, "ord")
_GROUP = f"case when coalesce({Q.stripped(CTX)}, '') <> '' then 't' || sha256({CTX}) else 'k' || cast(%s as varchar) end"
_TERMS = "\\b(" + "|".join(vignettes.EMERGENCY_TERMS) + ")\\b"
_MENTIONS = f"regexp_matches({Q.folded('prompt')}, '{_TERMS}')"

SQL = {
    "vignette_normalised": f"with d as ({DOCS}) select id, source, langue, contexte_clinique, question, task from d where {VALID}",
    "required_fields_report": f"""with l as (select source, unnest([case when coalesce(id, '') = '' then 'id' end, case when coalesce(source, '') = '' then 'source' end,
        case when coalesce(langue, '') = '' then 'langue' end, case when coalesce(question, '') = '' then 'question' end, case when coalesce({CTX}, '') = '' then '{CTX}' end,
        case when coalesce(specialite, '') = '' then 'specialite' end]) as champ from vignette) select source, champ, count(*) as n from l where champ is not null group by all""",
    "document_texts": f"""with d as ({DOCS}), v as (select *, {Q.case_id(CTX, 'id')} as cas_id, {_GROUP % 'id'} as g from d where {VALID}),
        t as (select g, arg_min(langue, ord) as langue, arg_min(cas_id, ord) as cas_id, count(*) as n from v group by g)
        select langue, count(*) as n_textes, cast(sum(n) as bigint) as n_lignes, count(distinct cas_id) as n_cas from t group by langue""",
    "context_filter": f"select source, count(*) as n from vignette where coalesce(trim({CTX}), '') <> '' group by source",
    "case_fingerprint": f"select ord, {Q.fingerprint(CTX)} as cas_id from vignette where {CTX} is not null",
    "hashed_ids": "select ord, substr(sha256(question), 1, 8) as empreinte, substr(sha256(question), 1, 12) as empreinte_12, 'um_' || substr(md5(question), 1, 12) as identifiant from vignette where question is not null",
    "dedup_exact": f"""with v as (select id, ord, {_CASE} as cas_id, {_GROUP % 'id'} as g from vignette)
        select arg_min(id, ord) as conserve, min(cas_id) as cas_id, min(ord) as premier, count(*) as n_questions from v group by g""",
    "dedup_correspondence": f"""with v as (select ord, {_CASE_ORD} as cas_id, {_GROUP % 'ord'} as g from vignette), f as (select g, min(ord) as conserve from v group by g)
        select ord as id, conserve, cas_id, case when cas_id like 'sans\\_contexte\\_%' escape '\\' then 'sans_contexte' when ord = conserve then 'conserve' else 'texte_identique' end as raison from v join f using (g)""",
    "case_variants": f"""with v as (select {_CASE} as cas_id, {CTX} as t from vignette where coalesce({Q.stripped(CTX)}, '') <> '')
        select cas_id, count(distinct t) as n_textes, count(*) as n_lignes from v group by cas_id having count(distinct t) > 1""",
    "dedup_shortest_variant": f"""with v as (select ord, {_CASE_ORD} as cas_id, coalesce(length({CTX}), 0) as l from vignette),
        r as (select *, row_number() over (partition by cas_id order by l, ord) as r, count(*) over (partition by cas_id) as n from v)
        select cas_id, ord as conserve, l as longueur, n as n_lignes from r where r = 1""",
    "dedup_report": f"""with v as (select {_CASE_ORD} as cas_id, {_GROUP % 'ord'} as g from vignette), p as (select cas_id, g, count(*) as n from v group by all),
        c as (select cas_id, sum(n) as n, count(*) as textes, max(n) as plus, cas_id like 'sans\\_contexte\\_%' escape '\\' as seul from p group by cas_id)
        select cast(sum(n) as bigint) as n_lignes, cast(coalesce(sum(n) filter (seul), 0) as bigint) as n_sans_contexte, cast(coalesce(sum(textes) filter (not seul), 0) as bigint) as n_textes,
        count(*) filter (not seul) as n_cas, cast(coalesce(max(plus) filter (not seul), 0) as bigint) as plus_grand_groupe, count(*) filter (not seul and textes > 1) as n_cas_a_variantes from c""",
    "filter_stability": f"""with v as (select {_CASE_ORD} as cas_id, coalesce(type_question = 'Reasoning', false) as retenu from vignette)
        select cas_id, count(*) filter (retenu) as retenues, count(*) filter (not retenu) as exclues, count(*) filter (retenu) > 0 and count(*) filter (not retenu) > 0 as instable from v group by cas_id""",
    "first_per_case": "select cas_id, min(ord) as ord, arg_min(id, ord) as id from vignette where cas_id is not null group by cas_id",
    "first_difference": f"""with a as (select id, min({CTX}) as a, max(question) as b from vignette where {CTX} is not null group by id having max(question) is not null)
        select id, case when a = b then -1 else list_min(list_filter(range(1, greatest(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) - 1 end as position from a""",
    "relevance_split": """with d as (select id, bool_or(specialite = 'Cardiologie') as urgence, max(specialite) as justification from vignette where specialite is not null group by id)
        select coalesce(urgence, false) as _filtre_urgence, coalesce(justification, 'sans_decision') as _filtre_justification, count(*) as n from vignette v left join d using (id) group by all""",
    "keyword_relevance": f"select source, coalesce({_MENTIONS}, false) as urgence, count(*) as n from paire_preference group by all",
    "candidate_pairs": f"""select distinct paire_id, source from paire_preference where coalesce(trim(prompt), '') <> '' and coalesce(trim(chosen), '') <> '' and coalesce(trim(rejected), '') <> ''
        and chosen <> rejected and length(prompt) + length(chosen) + length(rejected) <= 4000 and {_MENTIONS} and source in ('ultramedical', 'ultramedical_fr')""",
    "validated_pairs": f"select distinct paire_id from paire_preference where a_valider and {Q.stripped('chosen')} <> {Q.stripped('rejected')}",
    "first_occurrences": """with n as (select releve_no, max(recu_le) as courant from cas_clinique group by releve_no)
        select releve_no, count(*) as n_perimes from cas_clinique join n using (releve_no) where courant <> recu_le group by releve_no""",
    "seeded_sample": f"select doc_id, source from documents order by {Q.seeded(42, 'doc_id')}, doc_id limit 50",
    "group_split": f"""with g as (select distinct cas_id from vignette where cas_id is not null), n as (select case when count(*) >= 10 then greatest(1, cast(round_even(count(*) * 0.1, 0) as bigint)) else 0 end as n from g),
        r as (select cas_id, row_number() over (order by {Q.seeded(42, 'cas_id')}, cas_id) as r from g)
        select v.cas_id, ord, case when r <= (select n from n) then 'validation' else 'train' end as jeu from vignette v left join r on v.cas_id = r.cas_id""",
    "split_leaks": "select cas_id from vignette where cas_id is not null and split is not null group by cas_id having count(distinct lower(trim(split))) > 1",
    "resume_anti_join": "select event_id from events e where not exists (select 1 from events d where d.ts < timestamp '2024-01-01 12:00:00' and d.value >= 5 and d.user_id = e.user_id and d.event_type = e.event_type)",
    "last_success": """with e as (select user_id, event_type, event_id, case when value < 5 then 'echec' end as _erreur from events),
        r as (select *, row_number() over (partition by user_id, event_type order by _erreur is not null, event_id desc) as r from e) select user_id, event_type, event_id, _erreur from r where r = 1""",
    "variants_explode": "select ord, unnest(range(case type_question when 'Reasoning' then 2 when 'Understanding' then 3 else 0 end))::int as variante from vignette",
    "union_sources": f"""with d as ({DOCS}), u as (select source, langue, null as label_type from d union all select source, null, label_type from paire_preference)
        select source, count(*) as n, count(langue) as n_langue, count(label_type) as n_label from u group by source""",
    "id_difference": "select distinct id from vignette except select id from cas_clinique",
    "id_intersection": "select id from vignette intersect select id from cas_clinique",
    "set_equality": "select releve_no, count(distinct array_to_string(list_sort(list_distinct(criteres_presents)), '|')) = 1 as egaux from cas_clinique where criteres_presents is not null group by releve_no",
    "anonymised_titles": f"""with p as (select ord, {CTX} as t from vignette where {CTX} is not null), n as (select ord, t, regexp_extract_all(t, '%s', 2) as noms from p)
        select ord, array_to_string(noms, '|') as noms, md5(regexp_replace(t, '%s', '\\1 [PERSON]', 'g')) as texte from n where len(noms) > 0""" % ((T.TITLED_NAME.replace("'", "''"),) * 2),
    "column_profile": """with l as (select unnest([{'c': 'source', 'v': source}, {'c': 'label_type', 'v': label_type}, {'c': 'langue', 'v': langue}, {'c': 'prompt', 'v': prompt}]) as x from paire_preference),
        p as (select x.c as colonne, x.v as valeur, count(*) as n from l where length(x.v) < 60 group by all), k as (select colonne from p group by colonne having count(*) > 1 and count(*) < 30) select colonne, valeur, n from p join k using (colonne)""",
}
