"""Queries of measured values, rule tables, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinmill.functions import numeric as N
from clinmill.functions import text as T
from clinmill.operators import metrics, reports, responses, rules, units
from clinmill.plans import sql as Q
from clinmill.sources.tables import table
from clinmill.streaming import conversations

ORDER = ["1", "2", "3A", "3B", "4", "5"]
#: An example of a rule table: lower and upper bounds of vital signs with a level.
BOUNDS = [("pouls_haut", "fc_min", None, 140, "1"), ("pouls_bas", "fc_min", 40, None, "1"), ("saturation", "spo2_pct", 90, None, "2"), ("conscience", "gcs", 9, None, "1"), ("conscience_reduite", "gcs", 14, None, "2"), ("respiration", "fr_min", None, 30, "2")]
BANDS = [(1.0, "nourrisson"), (15.0, "enfant"), (65.0, "adulte"), (200.0, "age")]


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """Redelivered measurements once."""
    return table(spark, folder, "cas_clinique").dropDuplicates(["releve_no"])


def p5_found(spark, folder):
    return units.foreign_units(table(spark, folder, "cas_clinique"), table(spark, folder, "convention_unite"))


def p5_values(spark, folder):
    out = units.real_units(table(spark, folder, "cas_clinique"), table(spark, folder, "convention_unite"))
    return out.select("releve_no", "champ", "valeur", "unite", F.round("valeur_commune", 6).alias("valeur_commune")).distinct()


def p5_segments(spark, folder):
    return units.segments(units.measures(table(spark, folder, "cas_clinique")).persist())


def numbers_in_text(spark, folder):
    n = T.numbers(F.col("texte_source"))
    return _cases(spark, folder).where("texte_source is not null").select("releve_no", F.size(n).alias("n"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 3).alias("somme"))


def value_presence(spark, folder):
    present = T.value_present(F.col("texte_source"), F.col("pas_mmhg"), F.col("pas_mmhg") / 10)
    return _cases(spark, folder).where("texte_source is not null and pas_mmhg is not null").select("releve_no", present.alias("presente"))


def lenient_numbers(spark, folder):
    raw = F.regexp_extract("texte_source", r"(\d+[.,]?\d*)\s", 1)
    return _cases(spark, folder).where("texte_source is not null").select("releve_no", T.lenient_number(raw).alias("nombre"))


def declared_units(spark, folder):
    q = units.PRESSURE
    unit = units.spelled(F.col(q.unit), q)
    return reports.value_counts(_cases(spark, folder).select(F.coalesce(unit, F.lit("?")).alias("unite"), "source"), "unite", "source")


def motif_join(spark, folder):
    m = F.broadcast(table(spark, folder, "motif"))  # a fixed list
    return _cases(spark, folder).join(m, F.col("motif_id") == m["id"], "left").groupBy("specialite").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("motif_id").alias("n_motifs"))


def criteria_histogram(spark, folder):
    return reports.reason_histogram(_cases(spark, folder), "criteres_presents", " ")


def triggered_modifiers(spark, folder):
    mods = spark.createDataFrame([("douleur_thoracique_sca", "ECG anormal", "1"), ("cephalee", "Inhabituelle", "2"), ("douleur_abdominale", "Douleur sévère", "2"), ("deficit_neurologique_avc", "Délai court", "1")], "motif string, critere string, tri string")
    return rules.triggered_modifiers(_cases(spark, folder), F.broadcast(mods), "releve_no", "motif_id", "criteres_presents")


def _flags() -> list[rules.Rule]:
    out = []
    for name, col, low, high, level in BOUNDS:
        cond = F.col(col) < low if low is not None else F.col(col) > high
        out.append(rules.Rule(name, cond, level, "constante"))
    return out


def red_flags(spark, folder):
    f = rules.fired(_flags())
    c = _cases(spark, folder).withColumn("f", f)
    return c.where(F.size("f") > 0).select("releve_no", F.array_join(F.transform("f", lambda x: x["regle"]), ",").alias("regles"), rules.floor_of(F.col("f"), ORDER).alias("plancher"))


def override(spark, folder):
    c = _cases(spark, folder).withColumn("plancher", rules.floor_of(rules.fired(_flags()), ORDER))
    label = F.when(F.col("fievre"), "3A").when(~F.col("fievre"), "5")
    r = rules.raised(label, F.col("plancher"), ORDER)
    return c.select("releve_no", r["final"].alias("final"), r["releve"].alias("releve"), N.ordinal_gap(label, F.col("plancher"), ORDER).alias("ecart"))


def age_bands(spark, folder):
    return reports.shares(_cases(spark, folder).select(N.banded(F.col("age_annees"), BANDS).alias("tranche")), "tranche", 4)


def review_scores(spark, folder):
    reasons = [
        ("constante", F.col("gcs") < 9, "haute", F.lit(100)), ("age", F.col("age_annees") < 1, "haute", F.lit(40)), ("saturation", F.col("spo2_pct") < 90, "haute", F.lit(50)),
        ("texte", F.col("texte_source").isNull(), "basse", F.lit(5)),
    ]
    return rules.scored(_cases(spark, folder), reasons).select("releve_no", "a_relire", "priorite", "score")


def review_queue(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("haute"), F.col("o_totalprice").alias("score"), (F.col("o_orderpriority") == "5-LOW").alias("basse"))
    return rules.review_queue(o, "o_orderkey", "haute", "score", "basse", 80, 20).select("o_orderkey", "bloc", "rang", "dans_le_budget")


def quantile_waiting(spark, folder):
    wait = (F.col("recu_le").cast("double") - F.col("mesure_le").cast("double")).cast("bigint")
    return reports.quantile_by_index(_cases(spark, folder), wait, 0.95, ["source"])


def threshold_argmax(spark, folder):
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 4)
    e = table(spark, folder, "embeddings").withColumn("p", N.softmax(logits))
    return e.select("vec_id", F.get("p", F.lit(0)).alias("p0"), N.decided(F.col("p")).alias("decision"), N.argmax(F.col("p")).alias("argmax"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    truth = F.when(F.col("gcs") < 9, 0).when(F.col("gcs") < 15, 1).otherwise(2)
    pred = F.when(F.col("fc_min") > 110, 0).when(F.col("fc_min") > 90, 1).otherwise(2)
    return _cases(spark, folder).where("gcs is not null and fc_min is not null").select("releve_no", "id", "source", truth.alias("vrai"), pred.alias("predit"))


def confusion(spark, folder):
    return metrics.confusion(_scored(spark, folder), F.col("vrai"), F.col("predit"), 3)


def classifier_metrics(spark, folder):
    return metrics.metrics(confusion(spark, folder), 3)


def baseline_metrics(spark, folder):
    return metrics.metrics(metrics.confusion(_scored(spark, folder), F.col("vrai"), F.lit(0), 3), 3)


def style_pairs(spark, folder):
    return metrics.style_pairs(_scored(spark, folder), "id", "source", "vrai", "predit")


def label_crosstab(spark, folder):
    p = table(spark, folder, "paire_preference")
    return reports.crosstab(p.where("source is not null").withColumn("l", F.coalesce("label_type", F.lit("aucun"))), "source", "l", ["human", "rule", "model", "aucun"])


def status_shares(spark, folder):
    return reports.shares(table(spark, folder, "orders"), "o_orderstatus")


def top_motifs(spark, folder):
    return reports.top_with_histogram(_cases(spark, folder).where("motif_id is not null"), "motif_id", "gcs", 10)


def run_summary(spark, folder):
    return reports.run_summary(_cases(spark, folder), sans_texte=F.col("texte_source").isNull(), fievre=F.col("fievre"), avec_criteres=F.size("criteres_presents") > 0)


def token_share(spark, folder):
    d = table(spark, folder, "documents").where("text is not null")
    out = reports.token_share(d, F.least(T.word_count(F.col("text")), F.lit(20)), T.word_count(F.col("text")))
    return out.select(*(F.round(c, 6).alias(c) if c != "n_vides" else F.col(c) for c in out.columns))


def span_overlaps(spark, folder):
    """Line items whose quantity interval overlaps that of a sum of the order."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    spans = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(10.0).alias("end")), F.struct(F.lit(25.0).alias("start"), F.lit(30.0).alias("end")))
    hit = F.size(reports.overlapping(spans, F.col("l_quantity") - 2, F.col("l_quantity") + 2))
    return l.groupBy(hit.alias("n_recouvrements")).agg(F.count(F.lit(1)).alias("n"))


def flagged_islands(spark, folder):
    l = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") == "R").alias("r"))  # noqa: E741
    return reports.islands(l, "l_orderkey", "l_linenumber", "r")


def quote_check(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    quote = F.array_join(F.slice(F.split("text", " "), 3, 6), " ")
    other = F.concat_ws("...", quote, F.lit("rien de tel ici"))
    return d.select("doc_id", T.quoted(quote, F.col("text")).alias("litterale"), T.quoted(other, F.col("text")).alias("fausse"))


def quote_longest_run(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    quote = F.concat(F.array_join(F.slice(F.split("text", " "), 2, 5), " "), F.lit(" zzz zz"))
    run = T.longest_run(quote, F.col("text"))
    return d.select("doc_id", run["n"].alias("n"), run["total"].alias("total"), T.loosely_quoted(quote, F.col("text")).alias("accepte"))


def grid_catalogue(spark, folder):
    g = table(spark, folder, "part").select("p_brand", F.col("p_name").alias("tri1"), F.col("p_type").alias("tri2"))
    return rules.catalogue_from_grid(g, "p_brand", {"tri1": "1", "tri2": "2"}, "ring")


def forced_conclusion(spark, folder):
    v = table(spark, folder, "vignette")
    return v.groupBy(T.chosen_of(["un", "deux", "trois"], F.concat_ws("-", "id", F.lit("conclusion"))).alias("choix")).agg(F.count(F.lit(1)).alias("n"))


def parsed_responses(spark, folder):
    e = table(spark, folder, "events")
    raw = F.when(F.col("event_type") == "error", "illisible").otherwise(F.concat(F.lit("voici "), F.col("props"), F.lit(" fin")))
    resp = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("stage"), F.col("event_id").alias("attempt"), raw.alias("raw_text"))
    out = responses.staged(e.select(F.col("user_id").alias("id")).distinct(), resp, [("click", "struct<k:int>", F.col("value.k") > 20), ("error", "struct<k:int>", None)])
    return out.select("id", F.col("click.k").alias("k"), "_echec")


def golden_comparison(spark, folder):
    g = table(spark, folder, "golden_etape1_extraction").select("id", "extraction_attendue.motif_id", "extraction_attendue.criteres_presents", "extraction_attendue.gcs")
    made = g.select("id", F.when(F.col("gcs") == 15, F.col("motif_id")).alias("motif_id"), F.when(F.size("criteres_presents") > 1, F.reverse("criteres_presents")).alias("criteres_presents"), F.nullif("gcs", F.lit(14)).alias("gcs"))
    return responses.golden(made, g, "id", ["motif_id", "criteres_presents", "gcs"])


def catalogue_sections(spark, folder):
    m = table(spark, folder, "motif")
    return responses.sectioned(m, "specialite", F.concat(F.lit("- "), F.col("libelle")), ["Neurologie", "Urologie"], "id")


def event_windows(spark, folder):
    return conversations.windowed_counts(table(spark, folder, "events"), window="1 hour").withColumn("somme", F.round("somme", 4))


QUERIES = {
    f.__name__: f
    for f in (
        p5_found, p5_values, p5_segments, numbers_in_text, value_presence, lenient_numbers, declared_units, motif_join, criteria_histogram, triggered_modifiers, red_flags, override, age_bands,
        review_scores, review_queue, quantile_waiting, threshold_argmax, confusion, classifier_metrics, baseline_metrics, style_pairs, label_crosstab, status_shares, top_motifs, run_summary, token_share,
        span_overlaps, flagged_islands, quote_check, quote_longest_run, grid_catalogue, forced_conclusion, event_windows, parsed_responses, golden_comparison, catalogue_sections,
    )
}

_C = "c as (select * from cas_clinique qualify row_number() over (partition by releve_no order by recu_le) = 1)"
_NUMS = "list_transform(regexp_extract_all(replace(texte_source, ',', '.'), '\\d+(?:\\.\\d+)?'), lambda x: cast(x as double))"
_FLAG = [f"coalesce({col} < {low}, false)" if low is not None else f"coalesce({col} > {high}, false)" for _, col, low, high, _ in BOUNDS]
_FIRED = "[" + ", ".join(f"case when {c} then '{b[0]}' end" for c, b in zip(_FLAG, BOUNDS)) + "]"
_FLOOR = "case when " + " or ".join(c for c, b in zip(_FLAG, BOUNDS) if b[4] == "1") + " then '1' when " + " or ".join(c for c, b in zip(_FLAG, BOUNDS) if b[4] == "2") + " then '2' end"
_S = _C + """, s as (select releve_no, id, source, case when gcs < 9 then 0 when gcs < 15 then 1 else 2 end as vrai, case when fc_min > 110 then 0 when fc_min > 90 then 1 else 2 end as predit
    from c where gcs is not null and fc_min is not null)"""
_GRID = "g as (select v.v as vrai, p.p as predit from (select unnest(range(3))::int as v) v, (select unnest(range(3))::int as p) p)"


def _conf(pred: str) -> str:
    return f"{_S}, {_GRID}, m as (select g.vrai, g.predit, coalesce(n, 0) as n from g left join (select vrai, {pred} as predit, count(*) as n from s group by all) q using (vrai, predit))"


def _wilson(k: str, n: str) -> str:
    p, z2 = f"({k} / nullif({n}, 0)::double)", "3.8416"
    centre, half = f"({p} + {z2} / (2 * {n}::double)) / (1 + {z2} / {n}::double)", f"1.96 * sqrt({p} * (1 - {p}) / {n}::double + {z2} / (4 * {n}::double * {n}::double)) / (1 + {z2} / {n}::double)"
    return f"round({p}, 4) as valeur, case when {n} > 0 then round(greatest(0.0, {centre} - {half}), 4) end as bas, case when {n} > 0 then round(least(1.0, {centre} + {half}), 4) end as haut"


def _metrics(pred: str) -> str:
    tot = "(select sum(n) from m)"
    one = [
        f"select 'exactitude' as mesure, null::int as classe, {_wilson('k', 'n')} from (select cast(sum(n) filter (vrai = predit) as double) as k, {tot} as n from m)",
        f"select 'sous_estimation', null, {_wilson('k', 'n')} from (select cast(coalesce(sum(n) filter (predit > vrai), 0) as double) as k, {tot} as n from m)",
        f"select 'sur_estimation', null, {_wilson('k', 'n')} from (select cast(coalesce(sum(n) filter (predit < vrai), 0) as double) as k, {tot} as n from m)",
        f"select 'rappel', vrai, {_wilson('k', 'n')} from (select vrai, cast(coalesce(sum(n) filter (vrai = predit), 0) as double) as k, sum(n) as n from m group by vrai)",
        "select 'macro_f1', null, round(avg(f), 4), null, null from (select 2 * tp / nullif(t + p, 0) as f from (select x.vrai, sum(n) filter (m.vrai = x.vrai and m.predit = x.vrai) as tp, coalesce(sum(n) filter (m.vrai = x.vrai), 0)::double as t, coalesce(sum(n) filter (m.predit = x.vrai), 0)::double as p from m, (select distinct vrai from m) x group by x.vrai))",
    ]
    return f"with {_conf(pred)} " + " union all ".join(one)


_MM, _CM, _KP = units.PRESSURE.spellings["mmHg"], units.PRESSURE.spellings["cmHg"], units.PRESSURE.spellings["kPa"]


def _spelled(c: str, q: units.Quantity) -> str:
    return "case " + " ".join(f"when regexp_matches({c}, '(?i)^\\s*(?:{p.replace(chr(92) + 'b', '')})\\s*$') then '{u}'" for u, p in q.spellings.items()) + " end"


def _written(q: units.Quantity) -> str:
    every = "|".join(p.replace("\\b", "") for p in q.spellings.values())
    number, second = units.NUMBER, rf"(?:\s*/\s*{units.NUMBER})?"
    whole = rf"(?i)(?:(?:{units.EARLIER})[^0-9]{{0,12}})?(?:^|[^\d.,]){number}{second}\s*(?:{every})(?:$|[^\p{{L}}\d])"
    num = f"try_cast(replace(regexp_extract(regexp_replace(x, '^(.*?)(\\d)', '\\2'), '{number}'), ',', '.') as double)"
    same = f"list_filter(regexp_extract_all(texte_source, '{whole}'), lambda x: not regexp_matches(x, '(?i)^(?:{units.EARLIER})') and abs({num} - {q.value}) < 1e-6)"
    return _spelled(f"regexp_replace(regexp_replace({same}[1], '(?i)^[^\\d]*{number}{second}', ''), '[^\\p{{L}}\\d]$', '')", q)


def _p5(q: units.Quantity) -> str:
    odd = "valeur < 30 and u = 'mmHg' then 'cmHg'" if q is units.PRESSURE else "valeur >= 40 and u = 'mmol/l' then 'mg/dl'"
    return f"""select releve_no, champ, valeur, case when {odd} else u end as unite from (select releve_no, '{q.value}' as champ, {q.value} as valeur, coalesce({_written(q)}, {_spelled(q.unit, q)}, k.unite) as u
        from cas_clinique c left join convention_unite k on lower(trim(k.source)) = lower(trim(c.source)) and k.champ = '{q.value}' where {q.value} is not null and not isnan({q.value}))"""


_P5 = " union ".join(_p5(q) for q in units.QUANTITIES)

SQL = {
    "p5_found": f"select distinct releve_no, champ, unite from ({_P5}) where unite not in ('mmHg', 'mmol/l')",
    "p5_values": f"select distinct releve_no, champ, valeur, unite, round(valeur * case unite when 'cmHg' then 10.0::double when 'kPa' then 7.50062::double when 'g/l' then 5.55::double when 'mg/dl' then 0.0555::double else 1.0::double end, 6) as valeur_commune from ({_P5})",
    "numbers_in_text": f"with {_C} select releve_no, cast(len({_NUMS}) as int) as n, round(coalesce(list_sum({_NUMS}), 0), 3) as somme from c where texte_source is not null",
    "value_presence": f"with {_C} select releve_no, len(list_filter({_NUMS}, lambda x: abs(x - pas_mmhg) <= 0.06 or abs(x - pas_mmhg / 10) <= 0.06)) > 0 as presente from c where texte_source is not null and pas_mmhg is not null",
    "lenient_numbers": f"with {_C} select releve_no, try_cast(replace(regexp_extract(texte_source, '(\\d+[.,]?\\d*)\\s', 1), ',', '.') as double) as nombre from c where texte_source is not null",
    "declared_units": f"with {_C} select coalesce({_spelled('pas_unite', units.PRESSURE)}, '?') as unite, source, count(*) as n from c group by all",
    "motif_join": f"with {_C} select specialite, count(*) as n, count(distinct motif_id) as n_motifs from c left join motif m on c.motif_id = m.id group by all",
    "criteria_histogram": f"with {_C}, e as (select split_part(unnest(criteres_presents), ' ', 1) as raison from c) select raison, count(*) as n from e group by all",
    "triggered_modifiers": f"""with {_C}, m(motif, critere, tri) as (values ('douleur_thoracique_sca', 'ECG anormal', '1'), ('cephalee', 'Inhabituelle', '2'), ('douleur_abdominale', 'Douleur sévère', '2'), ('deficit_neurologique_avc', 'Délai court', '1'))
        select releve_no, critere, tri from c join m on m.motif = c.motif_id and list_contains(c.criteres_presents, m.critere)""",
    "red_flags": f"with {_C}, f as (select releve_no, list_filter({_FIRED}, lambda x: x is not null) as r, {_FLOOR} as plancher from c) select releve_no, array_to_string(r, ',') as regles, plancher from f where len(r) > 0",
    "override": f"""with {_C}, f as (select releve_no, {_FLOOR} as p, case when fievre then '3A' when not fievre then '5' end as l from c),
        o as (select *, list_position(['1', '2', '3A', '3B', '4', '5'], p) as op, list_position(['1', '2', '3A', '3B', '4', '5'], l) as ol from f)
        select releve_no, case when coalesce(op < ol, false) then p else coalesce(l, p) end as final, coalesce(op < ol, false) as releve, cast(ol - op as int) as ecart from o""",
    "age_bands": f"""with {_C}, b as (select case when age_annees < 1 then 'nourrisson' when age_annees < 15 then 'enfant' when age_annees < 65 then 'adulte' when age_annees < 200 then 'age' end as tranche from c)
        select tranche, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) as pct from b group by tranche""",
    "review_scores": f"""with {_C}, s as (select releve_no, greatest(case when coalesce(gcs < 9, false) then 100 else 0 end, case when coalesce(age_annees < 1, false) then 40 else 0 end, case when coalesce(spo2_pct < 90, false) then 50 else 0 end) as s, texte_source is null as t from c)
        select releve_no, s > 0 as a_relire, case when s > 0 then 'haute' when t then 'basse' end as priorite, s as score from s""",
    "review_queue": f"""with o as (select o_orderkey, o_orderpriority = '1-URGENT' as haute, o_totalprice as score, o_orderpriority = '5-LOW' as basse from orders),
        d as (select o_orderkey from o where not haute order by {Q.seeded(42, 'o_orderkey')}, o_orderkey limit 20),
        b as (select o_orderkey, score, case when haute then 0 when o_orderkey in (select o_orderkey from d) then 1 when basse then 2 end as bloc from o),
        r as (select o_orderkey, bloc, cast(row_number() over (order by bloc, score desc, o_orderkey) as int) as rang from b where bloc is not null)
        select o_orderkey, bloc, rang, bloc = 1 or (bloc = 0 and rang <= 60) as dans_le_budget from r where rang <= 100""",
    "quantile_waiting": f"with {_C}, l as (select source, list_sort(list(cast(floor(epoch(recu_le) - epoch(mesure_le)) as bigint))) as l from c group by source) select source, l[cast(floor(0.95 * (len(l) - 1)) as bigint) + 1] as quantile, len(l) as n from l",
    "threshold_argmax": """with e as (select vec_id, list_transform(embedding[1:3], lambda x: x::double * 4) as l from embeddings), x as (select vec_id, list_transform(l, lambda v: exp(v - list_max(l))) as e from e),
        p as (select vec_id, list_transform(e, lambda v: round(v / list_sum(e), 4)) as p from x) select vec_id, p[1] as p0, cast(case when p[1] >= 0.3 then 0 else list_position(p, list_max(p)) - 1 end as int) as decision, cast(list_position(p, list_max(p)) - 1 as int) as argmax from p""",
    "confusion": f"with {_conf('predit')} select vrai, predit, n from m",
    "classifier_metrics": _metrics("predit"),
    "baseline_metrics": _metrics("0"),
    "style_pairs": f"""with {_S} select source as style, count(*) filter (vrai = predit) as reconnus, count(*) as total from s group by source
        union all select '_decision_change', count(*) filter (a <> b), count(*) from (select id, min(predit) as a, max(predit) as b from s group by id)""",
    "label_crosstab": "select source, count(*) filter (label_type = 'human') as human, count(*) filter (label_type = 'rule') as rule, count(*) filter (label_type = 'model') as model, count(*) filter (label_type is null) as aucun from paire_preference where source is not null group by source",
    "status_shares": "select o_orderstatus, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 2) as pct from orders group by o_orderstatus",
    "top_motifs": f"""with {_C}, g as (select motif_id, coalesce(cast(gcs as varchar), '?') as l, count(*) as n from c where motif_id is not null group by all)
        select motif_id, cast(sum(n) as bigint) as n, string_agg(l || '=' || n, ',' order by l) as histogramme from g group by motif_id order by n desc, motif_id limit 10""",
    "run_summary": f"with {_C} select count(*) as n, count(*) filter (texte_source is null) as sans_texte, count(*) filter (fievre) as fievre, count(*) filter (len(criteres_presents) > 0) as avec_criteres from c",
    "token_share": f"with w as (select {Q.word_count('text')} as t from documents where text is not null), r as (select t, least(t, 20) as l, least(t, 20) / nullif(t, 0)::double as r from w) select round(avg(r), 6) as part_moyenne, round(median(r), 6) as part_mediane, round(sum(l) / sum(t)::double, 6) as part_totale, count(*) filter (l = 0) as n_vides from r",
    "span_overlaps": "select cast((case when 0 < l_quantity + 2 and 10 > l_quantity - 2 then 1 else 0 end) + (case when 25 < l_quantity + 2 and 30 > l_quantity - 2 then 1 else 0 end) as int) as n_recouvrements, count(*) as n from lineitem group by all",
    "flagged_islands": """with l as (select l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') as r from lineitem group by all), g as (select *, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as g from l where r)
        select l_orderkey, min(l_linenumber) as debut, max(l_linenumber) as fin, count(*) as n from g group by l_orderkey, g""",
    "quote_check": f"""with d as (select doc_id, text, array_to_string(string_split(text, ' ')[3:8], ' ') as q from documents where text is not null),
        p as (select doc_id, {Q.quotable('text')} as t, list_filter(list_transform(regexp_split_to_array(q, '\\.\\.\\.|…'), lambda x: {Q.quotable('x')}), lambda x: x <> '') as a,
            list_filter(list_transform(regexp_split_to_array(concat_ws('...', q, 'rien de tel ici'), '\\.\\.\\.|…'), lambda x: {Q.quotable('x')}), lambda x: x <> '') as b from d)
        select doc_id, """ + ", ".join(
        f"len({x}) > 0 and len(list_filter({x}, lambda y: len(string_split(y, ' ')) < 3 or not contains(' ' || t || ' ', ' ' || y || ' '))) = 0 and coalesce(list_sum(list_transform({x}, lambda y: len(string_split(y, ' ')))), 0) >= 4 as {n}" for x, n in (("a", "litterale"), ("b", "fausse"))
    ) + " from p",
    "grid_catalogue": """with l as (select p_brand, '1' as tri, p_name as critere from part union all select p_brand, '2', p_type from part)
        select p_brand, tri, array_to_string(list_sort(list(distinct trim(critere))), ' ; ') as critere from l where coalesce(trim(critere), '') <> '' and not contains(strip_accents(lower(critere)), 'ring') group by all""",
    "event_windows": "select time_bucket(interval 1 hour, ts) as debut, event_type, count(*) as n, round(sum(value), 4) as somme from events group by all",
    "parsed_responses": """with c as (select user_id as id, cast(json_extract(props, '$.k') as int) as k, event_id from events where event_type = 'click'), r as (select id, k, row_number() over (partition by id order by coalesce(k <= 20, true), event_id desc) as r from c)
        select u.id, case when r.k > 20 then r.k end as k, case when r.k > 20 then 'error' else 'click' end as _echec from (select distinct user_id as id from events) u left join r on u.id = r.id and r.r = 1""",
    "golden_comparison": """with g as (select id, extraction_attendue.motif_id as m, extraction_attendue.criteres_presents as c, extraction_attendue.gcs as g from golden_etape1_extraction)
        , x as (select id, case when g = 15 then m end is not distinct from m as ok_motif_id, (case when len(c) > 1 then list_sort(list_distinct(c)) end) is not distinct from list_sort(list_distinct(c)) as ok_criteres_presents,
        nullif(g, 14) is not distinct from g as ok_gcs from g) select *, ok_motif_id and ok_criteres_presents and ok_gcs as ok from x""",
    "catalogue_sections": """with p as (select specialite as section, min(case specialite when 'Neurologie' then 0 when 'Urologie' then 1 else 2 end) as p, min(id) as f, string_agg('- ' || libelle, chr(10) order by id) as texte from motif group by specialite)
        select section, cast(row_number() over (order by p, f) as int) as rang, texte from p""",
}
