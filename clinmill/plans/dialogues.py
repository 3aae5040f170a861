"""Queries of conversations, replies, preference pairs and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinmill.functions import messages as M
from clinmill.functions import text as T
from clinmill.operators import preference, reports, rules
from clinmill.plans import sql as Q
from clinmill.sources.tables import table

NAMES = {"assistant": "Agent", "user": "Patient"}
#: Example tables of signs and subjects; real ones are parameters of the operators.
SIGNS = {"thorax": ["douleur thoracique"], "souffle": ["essoufflement", "etouffe"], "convulsion": ["convulsion"], "saignement": ["sang dans les selles", "saignement"]}
OUTSIDE, INSIDE = ["montre connectee", "meteo", "scaphandrier", "guide de montagne"], ["douleur", "convulsion", "fievre", "toux"]
REASSURING = {"rassurance": "ne vous inqui[eé]tez pas|rien d'autre", "diagnostic": "il s'agit d|diagnostic", "consigne": "restez assis|surveillez"}
#: Words that tell English from French here.
FOREIGN = ("of", "to", "in", "it", "he", "that", "his", "her", "they", "from", "by", "had", "been", "we", "were", "who", "which", "would", "their", "there", "the", "and")
OWN = ("dans", "une", "des", "sur", "par", "mais", "nous", "ils", "elle", "cette", "sont", "aux", "chez", "depuis", "je", "mon", "du", "au", "il", "les")
MARKS = ["PATIENT :", "AGENT :", "Question :"]


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Redelivered pairs once."""
    return table(spark, folder, "paire_preference").dropDuplicates(["paire_id"])


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder).where("messages_contexte is not null")
    return p.select("paire_id", F.posexplode("messages_contexte").alias("tour", "m")).select("paire_id", "tour", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def message_validation(spark, folder):
    m = F.col("messages_contexte")
    return _pairs(spark, folder).where("messages_contexte is not null").select("paire_id", M.alternates(F.filter(m, lambda x: x["role"] != "system")).alias("alterne"), F.array_join(M.structure_problems(m), ",").alias("problemes"))


def transcript_full(spark, folder):
    return _pairs(spark, folder).where("messages_contexte is not null").select("paire_id", M.transcript(F.col("messages_contexte"), NAMES).alias("texte"))


def transcript_patient(spark, folder):
    return _pairs(spark, folder).where("messages_contexte is not null").select("paire_id", M.transcript(F.col("messages_contexte"), {"user": "PATIENT"}, " ").alias("texte"))


def chat_markup(spark, folder):
    return _pairs(spark, folder).where("messages_contexte is not null").select("paire_id", M.chatml(F.col("messages_contexte")).alias("texte"))


def sft_messages(spark, folder):
    body = F.filter("messages_contexte", lambda m: m["role"] != "system")
    made = M.as_training("Tu es l'agent.", body, {"user": "user", "assistant": "assistant"}, F.concat_ws(" ", M.answer_text(F.col("chosen")), T.tag_of(F.lit("moderee"))))
    return _pairs(spark, folder).where("messages_contexte is not null and chosen is not null and not startswith(ltrim(chosen), '[{')").select("paire_id", F.size(made).alias("n"), F.array_join(F.transform(made, lambda m: F.concat(m["role"], F.lit(">"), m["content"])), "|").alias("messages"))


def last_context(spark, folder):
    m = F.col("messages_contexte")
    return _pairs(spark, folder).where("messages_contexte is not null").select("paire_id", F.array_join(F.transform(M.last(m, 4), lambda x: x["content"]), "|").alias("derniers"), F.size(M.all_but_last(m)).alias("n_avant"))


def tag_leaks(spark, folder):
    return _pairs(spark, folder).where("messages_contexte is not null").select("paire_id", M.leaks_tag(F.col("messages_contexte")).alias("fuite"))


def answer_of_array(spark, folder):
    return _pairs(spark, folder).where("chosen is not null and (not startswith(trim(chosen), '[{') or endswith(trim(chosen), '}]'))").select("paire_id", M.answer_text(F.col("chosen")).alias("reponse"))


def reply_defects(spark, folder):
    r = T.clean_reply(F.col("rejected"))
    return _pairs(spark, folder).where("rejected is not null").select(
        "paire_id", T.question_count(r).alias("n_questions"), T.word_count(r).alias("n_mots"), T.concludes(r).alias("conclut"), T.tag_label(r).alias("etiquette"),
        F.array_join(T.matching_names(r, REASSURING), ",").alias("motifs"), T.drifts_from(r, FOREIGN, OWN).alias("derive"), F.array_join(T.artefacts(F.col("rejected"), MARKS), ",").alias("artefacts"),
    )


def reply_length_p95(spark, folder):
    return reports.quantile_by_index(_pairs(spark, folder), T.word_count(F.col("chosen")), 0.95, ["source"])


def reply_lengths(spark, folder):
    return reports.length_summary(_pairs(spark, folder), F.length("chosen"), ["source"]).withColumn("moyenne", F.round("moyenne", 3))


def ambiguous_conclusions(spark, folder):
    low = F.lower("chosen")
    own = F.contains(low, F.lit("tout de suite")) | F.contains(low, F.lit("immédiatement"))
    other = F.contains(F.replace(low, F.lit("sans attendre"), F.lit("")), F.lit("attendre"))
    return _pairs(spark, folder).where("chosen is not null").select("paire_id", (own & ~other).alias("coherente"))


def scope_guard(spark, folder):
    return _pairs(spark, folder).where("prompt is not null").select("paire_id", rules.out_of_scope(F.col("prompt"), OUTSIDE, INSIDE).alias("hors_sujet"))


def floor_first_hit(spark, folder):
    hit = rules.first_hit(_turns(spark, folder), "paire_id", "tour", "role", "content", "user", SIGNS)
    return hit.select("paire_id", "tour", F.array_join("signes", ",").alias("signes"))


def reframing_run(spark, folder):
    return _pairs(spark, folder).where("messages_contexte is not null").select("paire_id", M.trailing_run(F.col("messages_contexte"), "assistant", r"\?\s*$").alias("n"))


def role_alternation(spark, folder):
    from pyspark.sql.window import Window

    t = _turns(spark, folder).where("role <> 'system'")
    same = F.col("role") == F.lag("role").over(Window.partitionBy("paire_id").orderBy("tour"))
    return t.withColumn("meme", same).groupBy("paire_id").agg(F.count_if("meme").alias("n_ruptures"), F.count(F.lit(1)).alias("n_tours"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Both answers of each pair as scored candidates of its case and turn."""
    p = _pairs(spark, folder).where("cas_id is not null and tour is not null and total_chosen is not null and total_rejected is not null")
    one = p.select("cas_id", "tour", (F.col("paire_id") * 2).alias("n"), F.col("total_chosen").alias("total"), F.lit(True).alias("reference"), F.lit(True).alias("sur"), F.col("chosen").alias("texte"))
    two = p.select("cas_id", "tour", (F.col("paire_id") * 2 + 1).alias("n"), F.col("total_rejected").alias("total"), F.lit(False).alias("reference"), (F.col("total_rejected") >= 8).alias("sur"), F.col("rejected").alias("texte"))
    return one.unionByName(two)


def pairs_by_score(spark, folder):
    return preference.pairs_by_score(_candidates(spark, folder), ["cas_id", "tour"], "total", "reference", "sur", "n")


def distinct_candidates(spark, folder):
    return preference.distinct_candidates(_candidates(spark, folder).where("texte is not null"), ["cas_id", "tour"], "texte", "reference", "n").select("cas_id", "tour", "n")


def lettered_candidates(spark, folder):
    return preference.lettered(_candidates(spark, folder), ["cas_id", "tour"], "n").select("cas_id", "tour", "n", "lettre")


def pairs_by_rules(spark, folder):
    c = _candidates(spark, folder).where("not reference")
    d = F.array_compact(F.array(F.when(F.col("total") < 8, "grave"), F.when(F.col("texte").isNull() | (F.length("texte") < 40), "court"), F.when(F.contains("texte", F.lit("?")), "question")))
    return preference.pairs_by_rules(c.withColumn("defauts", d), ["cas_id", "tour"], "defauts", ["grave", "court", "question"], "n")


def grouped_candidates(spark, folder):
    return _candidates(spark, folder).groupBy("cas_id", "tour").agg(F.count(F.lit(1)).alias("n"), F.count_if("sur").alias("n_surs"))


def swapped_pairs(spark, folder):
    out = preference.swapped(_pairs(spark, folder), preference.presented_swapped(42, "paire_id"))
    return out.select("paire_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


def review_progress(spark, folder):
    return preference.progress(_pairs(spark, folder))


def review_decisions(spark, folder):
    p = _pairs(spark, folder).select("paire_id", "chosen", "rejected", "a_valider")
    d = p.select("paire_id", F.element_at(F.array(*map(F.lit, ("valider", "inverser", "rejeter", "remettre"))), (F.col("paire_id") % 4 + 1).cast("int")).alias("decision")).where("paire_id % 5 <> 0")
    out = preference.reviewed(p, d, "paire_id")
    return out.groupBy("a_valider").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("historique")).alias("n_historique"))


QUERIES = {
    f.__name__: f
    for f in (
        message_validation, transcript_full, transcript_patient, chat_markup, sft_messages, last_context, tag_leaks, answer_of_array, reply_defects, reply_length_p95, reply_lengths, ambiguous_conclusions,
        scope_guard, floor_first_hit, reframing_run, role_alternation, pairs_by_score, distinct_candidates, lettered_candidates, pairs_by_rules, grouped_candidates, swapped_pairs, review_progress, review_decisions,
    )
}

_P = "p as (select * from paire_preference qualify row_number() over (partition by paire_id order by cree_le) = 1)"
_M = _P + ", m as (select * from p where messages_contexte is not null)"
_CLEAN = Q.stripped("split_part(split_part(split_part(rejected, '<|im_end|>', 1), '<|endoftext|>', 1), '<|im_start|>', 1)")
_WORDS = f"regexp_extract_all({Q.folded('r')}, '[a-z]+')"
_EN, _FR = (", ".join(f"'{w}'" for w in x) for x in (FOREIGN, OWN))
_C = _P + """, c0 as (select * from p where cas_id is not null and tour is not null and total_chosen is not null and total_rejected is not null),
    c as (select cas_id, tour, paire_id * 2 as n, total_chosen as total, true as reference, true as sur, chosen as texte from c0
    union all select cas_id, tour, paire_id * 2 + 1, total_rejected, false, total_rejected >= 8, rejected from c0)"""
_SORT = Q.seeded(42, "cas_id", "tour", "n")


def _sign(patterns: list[str]) -> str:
    clauses = f"regexp_split_to_array(regexp_replace({Q.folded('t')}, '\\bsais pas\\b', 'sais_', 'g'), '{rules.CLAUSE}')"
    pat = "(?:" + "|".join(patterns) + ")"
    return f"len(list_filter({clauses}, lambda c: regexp_matches(c, '{pat}') and not regexp_matches(regexp_replace(c, '{pat}(.|\\n)*$', ''), '{rules.NEGATION}'))) > 0"


_SIGNS = "[" + ", ".join(f"case when {_sign(p)} then '{n}' end" for n, p in SIGNS.items()) + "]"

SQL = {
    "message_validation": f"""with {_M}, b as (select paire_id, messages_contexte as mm, list_filter(messages_contexte, lambda x: x.role <> 'system') as b from m),
        a as (select *, len(list_filter(range(1, len(b)), lambda i: b[i].role = b[i + 1].role)) = 0 as alterne from b)
        select paire_id, alterne, array_to_string(list_filter([case when len(mm) < 3 then 'trop_court' end, case when not list_contains(list_transform(mm, lambda x: x.role), 'user') then 'sans_user' end,
        case when not list_contains(list_transform(mm, lambda x: x.role), 'assistant') then 'sans_assistant' end, case when not alterne then 'alternance' end,
        case when len(list_filter(mm, lambda x: {Q.stripped("coalesce(x.content, '')")} = '')) > 0 then 'message_vide' end], lambda x: x is not null), ',') as problemes from a""",
    "transcript_full": f"""with {_M} select paire_id, array_to_string(list_transform(list_filter(messages_contexte, lambda x: x.role in ('assistant', 'user')),
        lambda x: case x.role when 'assistant' then 'Agent' else 'Patient' end || ' : ' || coalesce(x.content, '')), chr(10)) as texte from m""",
    "transcript_patient": f"with {_M} select paire_id, array_to_string(list_transform(list_filter(messages_contexte, lambda x: x.role = 'user'), lambda x: 'PATIENT : ' || coalesce(x.content, '')), ' ') as texte from m",
    "chat_markup": f"with {_M} select paire_id, array_to_string(list_transform(messages_contexte, lambda x: '<|im_start|>' || x.role || chr(10) || coalesce(x.content, '') || '<|im_end|>' || chr(10)), '') as texte from m",
    "sft_messages": f"""with {_M}, b as (select paire_id, list_filter(messages_contexte, lambda x: x.role <> 'system' and {Q.stripped("coalesce(x.content, '')")} <> '') as b, chosen from m where chosen is not null and not starts_with(ltrim(chosen), '[{{'))
        select paire_id, cast(len(b) + 2 as int) as n, array_to_string(list_concat(list_concat(['system>Tu es l''agent.'], list_transform(b, lambda x: x.role || '>' || {Q.stripped('x.content')})), ['assistant>' || chosen || ' [[PRIORITE:moderee]]']), '|') as messages from b""",
    "last_context": f"with {_M} select paire_id, array_to_string(list_transform(messages_contexte[greatest(1, len(messages_contexte) - 3):], lambda x: x.content), '|') as derniers, cast(len(messages_contexte) - 1 as int) as n_avant from m",
    "tag_leaks": f"with {_M} select paire_id, len(list_filter(messages_contexte[:-2], lambda x: regexp_matches(x.content, '\\[\\[PRIORITE:\\s*([a-z_]+)\\s*\\]\\]'))) > 0 as fuite from m",
    "answer_of_array": f"""with {_P}, a as (select paire_id, chosen, starts_with(ltrim(chosen), '[{{') as j from p where chosen is not null and (not starts_with(trim(chosen), '[{{') or ends_with(trim(chosen), '}}]'))),
        l as (select paire_id, chosen, case when j then from_json(chosen, '[{{"role":"VARCHAR","content":"VARCHAR"}}]') end as m from a)
        select paire_id, coalesce(list_filter(m, lambda x: x.role = 'assistant')[-1].content, m[-1].content, chosen) as reponse from l""",
    "reply_defects": f"""with {_P}, r as (select paire_id, rejected, {_CLEAN} as r from p where rejected is not null)
        select paire_id, cast(len(regexp_extract_all(r, '\\?+')) as int) as n_questions, cast({Q.word_count('r')} as int) as n_mots, contains(r, '[[PRIORITE:') as conclut, nullif(regexp_extract(r, '\\[\\[PRIORITE:\\s*([a-z_]+)\\s*\\]\\]', 1), '') as etiquette,
        array_to_string(list_filter([{', '.join(f"case when regexp_matches(r, '(?i)" + p.replace("'", "''") + f"') then '{n}' end" for n, p in REASSURING.items())}], lambda x: x is not null), ',') as motifs,
        len(list_filter({_WORDS}, lambda w: w in ({_EN}))) >= 3 and len(list_filter({_WORDS}, lambda w: w in ({_EN}))) > len(list_filter({_WORDS}, lambda w: w in ({_FR}))) as derive,
        array_to_string(list_filter([{', '.join(repr(m) for m in MARKS)}], lambda x: contains(split_part(rejected, '<|im_end|>', 1), x)), ',') as artefacts from r""",
    "reply_length_p95": f"""with {_P}, w as (select source, {Q.word_count('chosen')} as v from p where chosen is not null), l as (select source, list_sort(list(v)) as l from w group by source)
        select source, cast(l[cast(floor(0.95 * (len(l) - 1)) as bigint) + 1] as int) as quantile, len(l) as n from l""",
    "reply_lengths": f"""with {_P}, l as (select source, list_sort(list(length(chosen))) as l, avg(length(chosen)) as moyenne from p where chosen is not null group by source)
        select source, l[1] as mini, l[-1] as maxi, round(moyenne, 3) as moyenne, l[len(l) // 2 + 1] as mediane, l[cast(floor(0.95 * (len(l) - 1)) as bigint) + 1] as p95 from l""",
    "ambiguous_conclusions": f"with {_P} select paire_id, (contains(lower(chosen), 'tout de suite') or contains(lower(chosen), 'immédiatement')) and not contains(replace(lower(chosen), 'sans attendre', ''), 'attendre') as coherente from p where chosen is not null",
    "scope_guard": f"with {_P} select paire_id, regexp_matches({Q.folded('prompt')}, '{'|'.join(OUTSIDE)}') and not regexp_matches({Q.folded('prompt')}, '{'|'.join(INSIDE)}') as hors_sujet from p where prompt is not null",
    "floor_first_hit": f"""with {_M}, t as (select paire_id, i - 1 as tour, messages_contexte[i].role as role, messages_contexte[i].content as content from (select paire_id, messages_contexte, unnest(range(1, len(messages_contexte) + 1)) as i from m)),
        u as (select paire_id, tour, string_agg(content, ' . ') over (partition by paire_id order by tour) as t from t where role = 'user'),
        s as (select paire_id, tour, list_filter({_SIGNS}, lambda x: x is not null) as s from u)
        select paire_id, cast(min(tour) as int) as tour, array_to_string(arg_min(s, tour), ',') as signes from s where len(s) > 0 group by paire_id""",
    "reframing_run": f"""with {_M}, o as (select paire_id, list_reverse(list_filter(messages_contexte, lambda x: x.role = 'assistant')) as o from m)
        select paire_id, cast(coalesce(list_min(list_filter(range(1, len(o) + 1), lambda i: not regexp_matches(o[i].content, '\\?\\s*$'))) - 1, len(o)) as int) as n from o""",
    "role_alternation": f"""with {_M}, t as (select paire_id, i as tour, messages_contexte[i].role as role from (select paire_id, messages_contexte, unnest(range(1, len(messages_contexte) + 1)) as i from m)),
        l as (select *, role = lag(role) over (partition by paire_id order by tour) as meme from t where role <> 'system') select paire_id, count(*) filter (meme) as n_ruptures, count(*) as n_tours from l group by paire_id""",
    "pairs_by_score": f"""with {_C}, a as (select *, row_number() over (partition by cas_id, tour order by total desc, reference desc, n) as b, row_number() over (partition by cas_id, tour order by sur, total, reference, n) as w from c),
        g as (select cas_id, tour, max(n) filter (b = 1) as choisi, max(n) filter (w = 1) as rejete, max(total) as t_max, max(total) filter (w = 1) as t_min, bool_and(sur) as sur, count(*) as k from a group by all)
        select cas_id, tour, choisi, rejete, t_max, t_min, case when k < 2 or choisi = rejete then 'un_seul_candidat' when sur and t_max - t_min < 3 then 'ecart_trop_faible' end as raison from g""",
    "distinct_candidates": f"with {_C} select cas_id, tour, n from c where texte is not null qualify row_number() over (partition by cas_id, tour, {Q.stripped('texte')} order by reference desc, n) = 1",
    "lettered_candidates": f"with {_C}, r as (select cas_id, tour, n, row_number() over (partition by cas_id, tour order by {_SORT}, n) as r from c) select cas_id, tour, n, substr('ABCDEFGH', r, 1) as lettre from r where r <= 8",
    "pairs_by_rules": f"""with {_C}, d as (select *, case when total < 8 then 0 when texte is null or length(texte) < 40 then 1 when contains(texte, '?') then 2 end as g from c where not reference),
        r as (select *, row_number() over (partition by cas_id, tour order by g nulls last, {_SORT}, n) as r from d)
        select cas_id, tour, case when g is not null then n end as rejete, (['grave', 'court', 'question'])[g + 1] as defaut, case when g is null then 'aucune_reponse_fautive' end as raison from r where r = 1""",
    "grouped_candidates": f"with {_C} select cas_id, tour, count(*) as n, count(*) filter (sur) as n_surs from c group by all",
    "swapped_pairs": f"""with {_P}, s as (select *, substr({Q.seeded(42, 'paire_id')}, 4, 1) in ('1', '3', '5', '7', '9', 'b', 'd', 'f') as s from p)
        select paire_id, md5(case when s then rejected else chosen end) as chosen, md5(case when s then chosen else rejected end) as rejected from s""",
    "review_progress": f"with {_P} select count(*) filter (a_valider) as validees, count(*) filter (not a_valider) as rejetees, count(*) filter (a_valider is null) as restantes from p",
    "review_decisions": f"""with {_P}, d as (select paire_id, a_valider, case when paire_id % 5 <> 0 then (['valider', 'inverser', 'rejeter', 'remettre'])[paire_id % 4 + 1] end as d from p),
        s as (select case when d in ('valider', 'inverser') then true when d = 'rejeter' then false when d = 'remettre' then null else a_valider end as a_valider, case when d = 'remettre' then 1 else 0 end as h from d)
        select a_valider, count(*) as n, cast(sum(h) as bigint) as n_historique from s group by all""",
}
