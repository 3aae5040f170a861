"""Queries of the stages between model answers and training sets, and of scans and sinks."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clinmill.functions import text as T
from clinmill.operators import preference, stages, units
from clinmill.plans import sql as Q
from clinmill.plans.dialogues import _C, _CLEAN, _M, _P, _SORT, FOREIGN, MARKS, NAMES, OWN, REASSURING, _candidates, _pairs
from clinmill.runtime import shared_dir
from clinmill.sources import readers, sinks
from clinmill.sources.tables import table

LABELS = ["urgence_maximale", "moderee", "differee"]
#: Example tables; real ones are parameters of the operators.
FORBIDDEN = {"marque": r"\[[A-Z_]{3,}\]", "mesure": r"(?i)\b\d{2,3}\s?bpm\b|\btension\b[^.]{0,20}\d"}
WORDS = {"haute": ["tout de suite", "immédiat", "maintenant"], "basse": ["attendre", "demain", "surveillez"]}
ASIDE = {"attendre": ["sans attendre"]}
ENDINGS = {"rule": ["Venez vite.", "Venez."], "model": ["Rappelez demain.", "À demain.", "Notez tout."], "human": ["Restez chez vous."]}
CRITERIA = ["clarte", "exactitude"]
CTX = "contexte_clinique"


def dialogue_problems(spark, folder):
    m = F.filter("messages_contexte", lambda x: x["role"] != "system")
    found = stages.dialogue_problems(m, ("user", "assistant"), 2, 4, FORBIDDEN)
    return _pairs(spark, folder).select("paire_id", F.array_join(found, ",").alias("problemes"))


def usable_traces(spark, folder):
    p = _pairs(spark, folder).withColumn("douteux", F.col("total_chosen") < 12)
    return stages.usable_traces(p, "label_type", ["rule", "human"], "douteux").select("paire_id", stages.succeeded("total_chosen", "total_rejected").alias("reussi"))


def stale_labels(spark, folder):
    c = table(spark, folder, "cas_clinique").select("releve_no", "id", "motif_id", "recu_le")
    order = F.struct("recu_le", "releve_no")
    out = stages.with_current_labels(c, c.where("recu_le is not null").withColumn("_o", order), "id", "motif_id", "_o")
    return out.select("releve_no", "label_courant", "perime").distinct()


def coherent_conclusions(spark, folder):
    p = _pairs(spark, folder).where("chosen is not null")
    label = F.when(F.col("total_chosen") >= 15, "haute").otherwise("basse")
    return p.select("paire_id", stages.coherent_conclusion(F.col("chosen"), label, WORDS, ASIDE).alias("coherente"))


def recalibrated_conclusions(spark, folder):
    p = _pairs(spark, folder).where("label_type is not null and chosen is not null").select("paire_id", "label_type", "chosen", (F.col("total_chosen") < 10).alias("a_relire"))
    out = stages.recalibrated(p, ENDINGS, "label_type", "chosen", F.concat_ws("-", "paire_id", F.lit("fin")), "a_relire")
    return out.select("paire_id", F.col("chosen").isin([x for v in ENDINGS.values() for x in v]).alias("connue"), "changee", "balise")


def classifier_examples(spark, folder):
    tag = F.when(F.col("total_chosen") >= 15, "urgence_maximale").when(F.col("total_chosen") >= 10, "moderee").when(F.col("total_chosen") >= 8, "inconnue")
    last = F.struct(F.lit("assistant").alias("role"), F.concat_ws(" ", F.lit("Fin."), T.tag_of(tag)).alias("content"))
    p = _pairs(spark, folder).where("messages_contexte is not null").withColumn("m", F.array_append("messages_contexte", last))
    expected = F.when(F.col("label_type") == "rule", "moderee")
    made = p.select("paire_id", stages.classifier_example(F.col("m"), expected, LABELS, NAMES).alias("x"))
    return made.select("paire_id", F.md5("x.texte").alias("texte"), "x.etiquette", "x.numero", "x.erreur")


def reply_defect_vector(spark, folder):
    r = T.clean_reply(F.col("rejected"))
    d = stages.reply_defects(r, F.coalesce(F.col("tour") >= 5, F.lit(False)), F.lit(25), REASSURING, MARKS, F.col("rejected"), F.lit(False), FOREIGN, OWN)
    x = _pairs(spark, folder).where("rejected is not null").select("paire_id", d.alias("d")).select("paire_id", "d.*")
    return x.withColumn("motifs", F.array_join("motifs", ",")).withColumn("artefacts", F.array_join("artefacts", ","))


def judged_candidates(spark, folder):
    """A judge's replies, made from the totals: first an unreadable one, then one that leaves a candidate of odd cases out."""
    c = preference.lettered(_candidates(spark, folder), ["cas_id", "tour"], "n").select("cas_id", "tour", "n", "lettre", "total")
    said = F.struct("lettre", (F.pmod("total", F.lit(5)) + 1).alias("clarte"), (F.pmod("n", F.lit(5)) + 1).alias("exactitude"), (F.col("total") >= 10).alias("securite_ok"))
    odd = F.col("tour") % 2 == 1
    per = c.groupBy("cas_id", "tour").agg(F.sort_array(F.collect_list(F.when(~odd | (F.col("lettre") != "A"), said))).alias("evaluations"))
    good = per.select("cas_id", "tour", F.lit(2).alias("essai"), F.concat(F.lit("Voici : "), F.to_json(F.struct("evaluations"))).alias("reponse"))
    bad = per.select("cas_id", "tour", F.lit(1).alias("essai"), F.lit("désolé").alias("reponse"))
    out = stages.judged(c, good.unionByName(bad), ["cas_id", "tour"], CRITERIA)
    return out.select("cas_id", "tour", "n", "clarte", "exactitude", "total_juge", "securite_ok", "erreur")


def labelled_motifs(spark, folder):
    g = table(spark, folder, "golden_etape1_extraction")
    s = F.when(F.col("extraction_attendue.gcs") == 15, "None").when(F.col("extraction_attendue.fievre"), "motif_x").otherwise(F.concat(F.lit(" "), F.col("extraction_attendue.motif_id")))
    return stages.labelled(g.select("id", F.col("categorie_attendue").alias("categorie"), s.alias("suggestion")), "categorie", "suggestion", LABELS[:2], table(spark, folder, "motif"), "id").select(
        "id", "categorie_invalide", "suggestion", "suggestion_invalide"
    )


def audit_signals(spark, folder):
    g = table(spark, folder, "golden_etape1_extraction").select("id", F.col("categorie_attendue").alias("c"), F.col("extraction_attendue").alias("e"), "vignette_source")
    suggested = F.when(F.col("e.fievre"), "urgence_maximale").otherwise("differee")
    quoted = T.quoted(F.substring("vignette_source", 1, 60), F.col("vignette_source"))
    return g.select("id", stages.audit(F.col("c"), F.col("e.age_annees") > 40, suggested, quoted, LABELS).alias("a")).select("id", "a.*")


def fidelity_split(spark, folder):
    g = table(spark, folder, "golden_etape1_extraction").select("id", F.col("extraction_attendue.criteres_presents").alias("c"))
    x = F.transform("c", lambda s: F.struct(s.alias("element"), F.when(F.length(s) % 2 == 0, "medicale").otherwise("autre").alias("importance")))
    f = stages.invented(x)
    return g.select("id", F.size(f["graves"]).alias("n_graves"), F.size(f["mineurs"]).alias("n_mineurs"), f["non_verifiee"].alias("non_verifiee"))


def converted_values(spark, folder):
    c = table(spark, folder, "cas_clinique").where("pas_mmhg is not null").select("releve_no", stages.converted(F.col("pas_mmhg"), F.col("pas_unite"), units.PRESSURE).alias("x")).distinct()
    return c.select("releve_no", F.round("x.valeur", 6).alias("valeur"), F.col("x.journal").isNotNull().alias("convertie"))


def replaced_spans(spark, folder):
    """The first two capitalised words of each context as spans; those after a civility are replaced."""
    v = table(spark, folder, "vignette").where(f"{CTX} is not null").select("ord", F.col(CTX).alias("t"))
    word = r"[A-ZÉ][a-zé]{2,}"
    a = F.regexp_instr("t", F.lit(rf"(?<=M\. ){word}"))
    b = F.regexp_instr("t", F.lit(word))
    n = lambda at: F.length(F.regexp_extract(F.substr(F.col("t"), at), f"^{word}", 0))
    span = lambda at: F.struct((at - 1).alias("debut"), (at - 1 + n(at)).alias("fin"), F.lit("NOM").alias("type"))
    spans = F.array_distinct(F.array_compact(F.array(F.when(a > 0, span(a)), F.when(b > 0, span(b)))))
    x = stages.without_spans(F.col("t"), spans, r"M\.|Mme|Dr")
    return v.select("ord", F.md5(x["texte"]).alias("texte"), F.size(x["acceptes"]).alias("n_acceptes"), F.size(x["ecartes"]).alias("n_ecartes"))


def merged_choices(spark, folder):
    v = table(spark, folder, "vignette").select("ord", stages.merged(F.col("choix"), F.create_map(F.lit("a"), F.col("source"), F.lit("z"), F.lit("fin"))).alias("m"))
    return v.select("ord", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("cles"), F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


def until_enough(spark, folder):
    return stages.until(table(spark, folder, "documents").select("doc_id", "lang"), F.lower(F.substring("lang", 1, 2)) == "en", 20, 500, "doc_id")


def gathered_turns(spark, folder):
    g = stages.gathered(_candidates(spark, folder), ["cas_id", "tour"], "n", ["total"], 5)
    return g.select("cas_id", "tour", "n", F.array_join(F.transform("lignes", lambda x: F.concat_ws(":", x["n"].cast("string"), x["total"].cast("string"))), ",").alias("lignes"))


def probabilities_by_id(spark, folder):
    d = table(spark, folder, "documents").select("doc_id")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("probabilites"))
    return stages.with_probabilities(d, e, "doc_id").select("doc_id", F.size("probabilites").alias("n"), F.round(F.get("probabilites", F.lit(0)).cast("double"), 5).alias("premiere"))


def _fresh(spark: SparkSession, name: str) -> str:
    """A folder of this session under the shared one, empty."""
    path = os.path.join(shared_dir(spark).removeprefix("file:"), f"clinmill-{spark.sparkContext.applicationId}-{name}")
    shutil.rmtree(path, ignore_errors=True)
    return path


def jsonl_round_trip(spark, folder):
    """Records written as JSON lines in two batches, read back strictly."""
    v = table(spark, folder, "vignette").select("ord", "id", "source", "question", "choix", "ids_questions")
    path = _fresh(spark, "lignes")
    sinks.json_lines(v.where("ord % 2 = 0"), path)
    sinks.append(v.where("ord % 2 <> 0"), path)
    back = readers.json_lines(spark, path, v.schema, strict=True)
    return back.select("ord", "id", "source", F.md5("question").alias("question"), F.size("choix").alias("n_choix"), F.size("ids_questions").alias("n_ids"))


def split_sink(spark, folder):
    """Records written by split, and kept or set aside, and read back."""
    v = table(spark, folder, "vignette").select("ord", F.coalesce(F.lower(F.trim("split")), F.lit("sans")).alias("jeu"), F.col(CTX).isNotNull().alias("garde"))
    path, other = _fresh(spark, "jeux"), _fresh(spark, "ecartes")
    sinks.by_split(v, path)
    sinks.divided(v, other, F.col("garde"))
    one = spark.read.json(path).groupBy("jeu").agg(F.count(F.lit(1)).alias("n"))
    two = spark.read.json(other).groupBy(F.when(F.col("retenu").cast("string") == "true", "retenu").otherwise("ecarte").alias("jeu")).agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(two)


def suffix_scan(spark, folder):
    """A table read by its suffix, in the newest of its versions."""
    path = _fresh(spark, "versions")
    newest = sinks.versioned(readers.by_suffix(spark, f"{folder}/motif.parquet"), path)
    return spark.read.parquet(newest).select("id", "libelle", "specialite")


def xml_pages(spark, folder):
    """The complaint list as XML pages in two folders, read with one left out."""
    root = Path(_fresh(spark, "pages"))
    for r in table(spark, folder, "motif").collect():  # a fixed table of eighteen rows
        d = root / ("autre" if r["specialite"] == "Neurologie" else "pages")
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{r['id']}.xml").write_text(
            f'<Document id="{r["id"]}"><Focus> {r["libelle"]} </Focus><CUI>C1</CUI><QAPairs><QAPair pid="1"><Question qtype="signes">Quoi ?</Question><Answer>{r["specialite"]}</Answer></QAPair>'
            '<QAPair pid="2"><Question qtype="x"> </Question><Answer>rien</Answer></QAPair></QAPairs></Document>\n', encoding="utf-8",
        )
    return readers.question_pages(spark, str(root), exclude=("autre",)).select("id", "focus", "question", "qtype", "answer", F.size("cui").alias("n_cui"))


QUERIES = {
    f.__name__: f
    for f in (
        dialogue_problems, usable_traces, stale_labels, coherent_conclusions, recalibrated_conclusions, classifier_examples, reply_defect_vector, judged_candidates, labelled_motifs, audit_signals,
        fidelity_split, converted_values, replaced_spans, merged_choices, until_enough, gathered_turns, probabilities_by_id, jsonl_round_trip, split_sink, suffix_scan, xml_pages,
    )
}

_BODY = "list_filter(messages_contexte, lambda m: m.role <> 'system')"
_LAB = "case when total_chosen >= 15 then 'urgence_maximale' when total_chosen >= 10 then 'moderee' when total_chosen >= 8 then 'inconnue' end"
_TAGGED = r"\[\[PRIORITE:\s*[a-z_]+\s*\]\]"
_HAS = {k: " or ".join(f"contains({'l' if w not in ASIDE else chr(114) + 'eplace(l, ' + chr(39) + ASIDE[w][0] + chr(39) + ', ' + chr(39) * 2 + ')'}, '{w}')" for w in ws) for k, ws in WORDS.items()}
_MINE = " ".join(f"when '{k}' then ({h})" for k, h in _HAS.items())
_THEIRS = " or ".join(f"(k <> '{k}' and ({h}))" for k, h in _HAS.items())
_ARTE = ", ".join(f"case when contains(raw, '{m}') then '{m}' end" for m in MARKS)
_NAMED = ", ".join(f"case when regexp_matches(r, '(?i){p.replace(chr(39), chr(39) * 2)}') then '{n}' end" for n, p in REASSURING.items())
_EN, _OWN = (", ".join(f"'{w}'" for w in x) for x in (FOREIGN, OWN))
_W = f"regexp_extract_all({Q.folded('r')}, '[a-z]+')"
_FACTOR = "case when coalesce(trim(pas_unite), '') = '' then 1.0 " + " ".join(f"when regexp_matches(pas_unite, '(?i)^\\s*(?:{p})\\s*$') then {units.PRESSURE.factors[u]}" for u, p in units.PRESSURE.spellings.items()) + " end"

SQL = {
    "dialogue_problems": f"""with {_P}, d as (select paire_id, {_BODY} as m from p), e as (select *, array_to_string(list_transform(m, lambda x: coalesce(x.content, '')), ' ') as t from d)
        select paire_id, case when m is null or len(m) = 0 then 'vide' else concat_ws(',',
        case when len(list_filter(range(1, len(m) + 1), lambda i: coalesce(m[i].role, '') <> case when i % 2 = 1 then 'user' else 'assistant' end or {Q.stripped("coalesce(m[i].content, '')")} = '')) > 0 then 'alternance' end,
        case when len(m) % 2 = 1 then 'fin' end, case when not (len(m) // 2 between 2 and 4) then 'longueur' end,
        {", ".join(f"case when regexp_matches(t, '{p}') then '{k}' end" for k, p in FORBIDDEN.items())}) end as problemes from e""",
    "usable_traces": f"with {_P} select paire_id, total_chosen is not null and total_rejected is not null as reussi from p where label_type in ('rule', 'human') and coalesce(total_chosen >= 12, true)",
    "stale_labels": """with n as (select id, motif_id as c from cas_clinique where recu_le is not null and motif_id is not null and id is not null qualify row_number() over (partition by id order by recu_le desc, releve_no desc) = 1)
        select distinct releve_no, c as label_courant, c is not null and c is distinct from motif_id as perime from cas_clinique left join n using (id)""",
    "coherent_conclusions": f"""with {_P}, x as (select paire_id, lower(chosen) as l, case when total_chosen >= 15 then 'haute' else 'basse' end as k from p where chosen is not null)
        select paire_id, (case k {_MINE} end) and not ({_THEIRS}) as coherente from x""",
    "recalibrated_conclusions": f"""with {_P} select paire_id, true as connue, true as changee, '[[PRIORITE:' || label_type || ']]' as balise from p where label_type is not null and chosen is not null and not coalesce(total_chosen < 10, false)""",
    "classifier_examples": f"""with {_M}, x as (select paire_id, {_BODY} as b, {_LAB} as e, label_type from m), y as (select *, case when e is null then 'balise_absente' when e = 'inconnue' then 'etiquette_inconnue'
        when label_type = 'rule' and e <> 'moderee' then 'etiquette_differente' when len(list_filter(b, lambda m: regexp_matches(coalesce(m.content, ''), '{_TAGGED}'))) > 0 then 'fuite'
        when coalesce(b[-1].role, '') <> 'user' then 'pas_de_patient' end as erreur from x)
        select paire_id, case when erreur is null then md5(array_to_string(list_transform(list_filter(b, lambda m: m.role in ('assistant', 'user')), lambda m: case m.role when 'assistant' then 'Agent' else 'Patient' end || ' : ' || coalesce(m.content, '')), chr(10))) end as texte,
        case when erreur is null then e end as etiquette, case when erreur is null then case e when 'urgence_maximale' then 0 else 1 end end as numero, erreur from y""",
    "reply_defect_vector": f"""with {_P}, x as (select paire_id, coalesce(tour >= 5, false) as rc, rejected as raw, {_CLEAN} as r from p where rejected is not null), y as (select *, contains(r, '[[PRIORITE:') as c,
        array_to_string(list_filter([{_NAMED}], lambda z: z is not null), ',') as named, array_to_string(list_filter([{_ARTE.replace("raw", "split_part(raw, '<|im_end|>', 1)")}], lambda z: z is not null), ',') as found from x)
        select paire_id, r = '' as vide, not c and len(regexp_extract_all(r, '\\?+')) >= 2 as plusieurs_questions, c and not rc as conclusion_prematuree, rc and not c as conclusion_manquee, not c and named <> '' as rassurance_ou_diagnostic,
        regexp_matches(r, '\\p{{Han}}|\\p{{Hiragana}}|\\p{{Katakana}}|\\p{{Hangul}}') or (len(list_filter({_W}, lambda w: w in ({_EN}))) >= 3 and len(list_filter({_W}, lambda w: w in ({_EN}))) > len(list_filter({_W}, lambda w: w in ({_OWN})))) as non_francais,
        found <> '' as artefact, not c and {Q.word_count('r')} > 25 as trop_longue, case when c then '' else named end as motifs, found as artefacts from y""",
    "judged_candidates": f"""with {_C}, r as (select *, row_number() over (partition by cas_id, tour order by {_SORT}, n) as r from c), k as (select * from r where r <= 8)
        select cas_id, tour, n, case when tour % 2 = 0 then total % 5 + 1 end as clarte, case when tour % 2 = 0 then cast(n % 5 + 1 as int) end as exactitude, case when tour % 2 = 0 then total % 5 + 1 + cast(n % 5 + 1 as int) end as total_juge,
        case when tour % 2 = 0 then total >= 10 end as securite_ok, case when tour % 2 = 1 then 'lettres' end as erreur from k""",
    "labelled_motifs": """with g as (select id, categorie_attendue as c, case when extraction_attendue.gcs = 15 then null when extraction_attendue.fievre then 'motif_x' else extraction_attendue.motif_id end as s from golden_etape1_extraction)
        select g.id, case when not coalesce(c in ('urgence_maximale', 'moderee'), false) then coalesce(c, '') end as categorie_invalide, m.id as suggestion, case when s is not null and m.id is null then s end as suggestion_invalide from g left join motif m on m.id = g.s""",
    "audit_signals": f"""with o as (select unnest(['urgence_maximale', 'moderee', 'differee']) as c, unnest([0, 1, 2]) as i), g as (select id, coalesce(extraction_attendue.age_annees > 40, false) as risk, case when extraction_attendue.fievre then 0 else 2 end as s, i,
        {Q.quotable('substr(vignette_source, 1, 60)')} as q, {Q.quotable('vignette_source')} as t, vignette_source as v from golden_etape1_extraction left join o on o.c = categorie_attendue),
        x as (select *, risk and coalesce(s < i, false) as signal, coalesce((not contains(substr(v, 1, 60), '...') and not contains(substr(v, 1, 60), '…')) and contains(' ' || t || ' ', ' ' || q || ' ') and len(string_split(q, ' ')) >= 4, false) as ok from g)
        select id, signal, case when signal then 'urgence_maximale' end as niveau, case when signal then case when ok then 'haute' else 'basse' end end as priorite, risk and not coalesce(s < i, false) as incoherence from x""",
    "fidelity_split": """with g as (select id, extraction_attendue.criteres_presents as c from golden_etape1_extraction) select id, cast(len(list_filter(c, lambda s: s <> '' and length(s) % 2 = 0)) as int) as n_graves,
        cast(len(list_filter(c, lambda s: s <> '' and length(s) % 2 = 1)) as int) as n_mineurs, c is null as non_verifiee from g""",
    "converted_values": f"""with x as (select distinct releve_no, pas_mmhg, cast({_FACTOR} as double) as f from cas_clinique where pas_mmhg is not null) select distinct releve_no, round(pas_mmhg * f, 6) as valeur, f is not null and f <> 1 as convertie from x""",
    "merged_choices": """with v as (select ord, map_entries(choix) as e, source from vignette) select ord, array_to_string(list_sort(list_distinct(list_concat(coalesce(list_transform(e, lambda x: x.key), []), ['a', 'z']))), ',') as cles, source as a,
        list_filter(e, lambda x: x.key = 'b')[1].value as b from v""",
    "until_enough": "with d as (select doc_id, lang from documents order by doc_id limit 500) select doc_id, lang from d where lower(substr(lang, 1, 2)) = 'en' order by doc_id limit 20",
    "gathered_turns": f"""with {_C}, r as (select *, row_number() over (partition by cas_id, tour order by n) as r from c)
        select cas_id, tour, count(*) as n, string_agg(n || ':' || total, ',' order by n) filter (r <= 5) as lignes from r group by cas_id, tour""",
    "probabilities_by_id": "select doc_id, cast(len(embedding) as int) as n, round(cast(embedding[1] as double), 5) as premiere from documents left join embeddings on vec_id = doc_id",
    "jsonl_round_trip": "select ord, id, source, md5(question) as question, cast(cardinality(choix) as int) as n_choix, cast(len(ids_questions) as int) as n_ids from vignette",
    "split_sink": f"select coalesce(lower(trim(split)), 'sans') as jeu, count(*) as n from vignette group by 1 union all select case when {CTX} is null then 'ecarte' else 'retenu' end, count(*) from vignette group by 1",
    "suffix_scan": "select id, libelle, specialite from motif",
    "xml_pages": "select id || '_1' as id, trim(libelle) as focus, 'Quoi ?' as question, 'signes' as qtype, specialite as answer, 1 as n_cui from motif where specialite <> 'Neurologie'",
}
