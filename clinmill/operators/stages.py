"""Stages between model answers and training sets: checks, joins with current
labels, verdicts of judges and audits, examples for a classifier.

Everything that a domain fixes (labels, words, patterns, ranges) is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from clinmill.functions import text as T
from clinmill.functions.messages import leaks_tag, transcript
from clinmill.operators.units import Quantity


def _named(problems: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in their order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in problems.items())))


def dialogue_problems(messages: Column, roles: tuple[str, str], least: int, most: int, forbidden: dict[str, str]) -> Column:
    """What makes a generated dialogue unusable; empty if nothing does.

    ``vide`` for null or no messages, and nothing else then; ``alternance`` if a
    turn is blank or not of the role whose turn it is; ``fin`` if it does not end
    with the second role; ``longueur`` outside ``least`` to ``most`` exchanges; the
    names of the patterns that stand anywhere in it.
    """
    n = F.size(messages)
    turn = lambda m, i: F.coalesce(m["role"], F.lit("")) != F.when(i % 2 == 0, F.lit(roles[0])).otherwise(F.lit(roles[1]))
    wrong = F.exists(F.transform(messages, lambda m, i: turn(m, i) | (T.stripped(F.coalesce(m["content"], F.lit(""))) == "")), lambda x: x)
    said = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    found = _named({"alternance": wrong, "fin": n % 2 == 1, "longueur": ~F.floor(n / 2).between(least, most)} | {k: said.rlike(p) for k, p in forbidden.items()})
    return F.when(messages.isNull() | (n == 0), F.array(F.lit("vide"))).otherwise(found)


def usable_traces(df: DataFrame, label: str, labels: list[str], doubtful: str) -> DataFrame:
    """Rows with a known label that nobody is to look at again."""
    return df.where(F.col(label).isin(*labels) & ~F.coalesce(F.col(doubtful).cast("boolean"), F.lit(False)))


def succeeded(*needed: str) -> Column:
    """Whether all results of a stage are there."""
    return F.forall(F.array(*(F.col(c).isNotNull() for c in needed)), lambda x: x)


def with_current_labels(df: DataFrame, labels: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Adds ``label_courant`` (the last non-null label of the key in ``order``) and
    ``perime``: whether it differs from the row's own.  Unknown keys are current."""
    now = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max_by(label, order).alias("label_courant"))
    return df.join(now, key, "left").withColumn("perime", F.col("label_courant").isNotNull() & ~F.col("label_courant").eqNullSafe(F.col(label)))


def coherent_conclusion(text: Column, label: Column, words: dict[str, list[str]], aside: dict[str, list[str]]) -> Column:
    """Whether a conclusion has a word of its own label and none of another.

    ``aside`` names for a word the phrases in which it does not count.
    """
    low = F.lower(text)

    def has(word: str) -> Column:
        rest = low
        for phrase in aside.get(word, ()):
            rest = F.replace(rest, F.lit(phrase), F.lit(""))
        return F.contains(rest, F.lit(word))

    hit = {k: F.exists(F.array(*map(has, ws)), lambda x: x) for k, ws in words.items()}
    own = F.coalesce(*(F.when(label == k, c) for k, c in hit.items()), F.lit(False))
    other = F.exists(F.array(*((label != k) & c for k, c in hit.items())), lambda x: x)
    return F.coalesce(own & ~other, F.lit(False))


def recalibrated(df: DataFrame, options: dict[str, list[str]], label: str, text: str, key: Column, doubtful: str) -> DataFrame:
    """Conclusions replaced by the one that key and label choose; doubtful rows
    are left out.  ``changee`` says whether the text is another one than before."""
    new = F.coalesce(*(F.when(F.col(label) == k, T.chosen_of(v, key)) for k, v in options.items()))
    rows = df.where(~F.coalesce(F.col(doubtful).cast("boolean"), F.lit(False))).withColumn("_n", new)
    changed = ~T.stripped(F.col(text)).eqNullSafe(F.col("_n"))
    return rows.withColumn("changee", changed).withColumn(text, F.col("_n")).withColumn("balise", T.tag_of(F.col(label))).drop("_n")


def classifier_example(messages: Column, expected: Column, labels: list[str], names: dict[str, str]) -> Column:
    """struct(texte, etiquette, numero, erreur): a closed conversation as an example.

    The label is the tag in the last message; what is before it is the text.
    Errors, of which the first counts: ``dernier_role``, ``balise_absente``,
    ``etiquette_inconnue``, ``etiquette_differente`` from ``expected`` (unless null or
    empty), ``fuite`` of a tag, ``pas_de_patient`` at the end of the text.
    """
    last = F.try_element_at(messages, F.lit(-1))
    body = F.filter(F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), lambda m: m["role"] != "system")
    tag = T.tag_label(last["content"])
    number = F.array_position(F.array(*map(F.lit, labels)), tag) - 1
    error = (
        F.when(F.coalesce(last["role"], F.lit("")) != "assistant", "dernier_role")
        .when(tag.isNull(), "balise_absente")
        .when(number < 0, "etiquette_inconnue")
        .when((F.coalesce(expected, F.lit("")) != "") & (expected != tag), "etiquette_differente")
        .when(F.exists(body, lambda m: F.coalesce(T.tag_label(m["content"]).isNotNull(), F.lit(False))), "fuite")
        .when(F.coalesce(F.try_element_at(body, F.lit(-1))["role"], F.lit("")) != "user", "pas_de_patient")
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, transcript(body, names)).alias("texte"), F.when(ok, tag).alias("etiquette"), F.when(ok, number.cast("int")).alias("numero"), error.alias("erreur")
    )


def reply_defects(reply: Column, reference_closes: Column, most_words: Column, patterns: dict[str, str], marks: list[str], raw: Column, cut: Column, foreign: tuple[str, ...], own: tuple[str, ...]) -> Column:
    """The defects of one reply as a struct of flags, with the patterns and marks found.

    A reply that closes the call is judged neither by its length nor by its
    questions or patterns.
    """
    closes = F.coalesce(T.concludes(reply), F.lit(False))
    text = F.coalesce(reply, F.lit(""))
    names = F.when(closes, F.array().cast("array<string>")).otherwise(T.matching_names(text, patterns))
    found = F.coalesce(T.artefacts(raw, marks), F.array().cast("array<string>"))
    return F.struct(
        (T.stripped(text) == "").alias("vide"),
        (~closes & (T.question_count(text) >= 2)).alias("plusieurs_questions"),
        (closes & ~reference_closes).alias("conclusion_prematuree"),
        (reference_closes & ~closes).alias("conclusion_manquee"),
        (F.size(names) > 0).alias("rassurance_ou_diagnostic"),
        T.drifts_from(text, foreign, own).alias("non_francais"),
        ((F.size(found) > 0) | F.coalesce(cut, F.lit(False))).alias("artefact"),
        (~closes & (T.word_count(text) > most_words)).alias("trop_longue"),
        names.alias("motifs"),
        found.alias("artefacts"),
    )


def judged(candidates: DataFrame, replies: DataFrame, context: list[str], criteria: list[str], attempt: str = "essai", raw: str = "reponse", letter: str = "lettre") -> DataFrame:
    """Candidates with what the judge of their context says of their letter.

    ``replies`` has the context, the attempt and the judge's JSON: ``evaluations``,
    each with the letter, whole numbers from 1 to 5 for all ``criteria`` and a
    boolean ``securite_ok``.  A reply counts if its letters are those of the
    candidates and all values have their type and range; the first such attempt
    is taken.  Adds the criteria, ``total``, ``securite_ok``, ``justification`` and
    ``erreur``: the problem of the last attempt where none counts,
    ``sans_reponse`` without any.
    """
    one = StructType([StructField("lettre", StringType()), *(StructField(c, IntegerType()) for c in criteria), StructField("securite_ok", BooleanType()), StructField("justification", StringType())])
    said = replies.select(*context, attempt, F.from_json(F.substr(F.col(raw), F.greatest(F.instr(raw, "{"), F.lit(1))), StructType([StructField("evaluations", ArrayType(one))]))["evaluations"].alias("e"))
    expected = candidates.groupBy(*context).agg(F.array_sort(F.collect_set(letter)).alias("lettres"))  # a letter per candidate, so few
    out_of_range = lambda x: F.exists(F.array(*(x[c] for c in criteria)), lambda n: F.coalesce(~n.between(1, 5), F.lit(True)))
    problem = (
        F.when(F.col("e").isNull(), "illisible")
        .when(~F.array_sort(F.array_distinct(F.transform("e", lambda x: x["lettre"]))).eqNullSafe(F.col("lettres")), "lettres")
        .when(F.exists("e", out_of_range), "notes")
        .when(F.exists("e", lambda x: x["securite_ok"].isNull()), "securite")
    )
    checked = said.join(expected, context).withColumn("erreur", problem)
    key = F.struct(F.col("erreur").isNotNull().alias("bad"), F.when(F.col("erreur").isNull(), F.col(attempt)).otherwise(-F.col(attempt)).alias("at"))
    taken = checked.groupBy(*context).agg(F.min_by(F.struct("e", "erreur"), key).alias("r"))
    rows = candidates.join(taken, context, "left")
    mine = F.try_element_at(F.filter(F.col("r.e"), lambda x: x["lettre"] == F.col(letter)), F.lit(-1))
    error = F.when(F.col("r").isNull(), "sans_reponse").otherwise(F.col("r.erreur"))
    rows = rows.withColumn("erreur", error).withColumn("_m", F.when(error.isNull(), mine))
    total = sum((F.col(f"_m.{c}") for c in criteria[1:]), F.col(f"_m.{criteria[0]}"))
    return rows.select(*candidates.columns, *(F.col(f"_m.{c}").alias(c) for c in criteria), total.alias("total_juge"), F.col("_m.securite_ok").alias("securite_ok"), F.col("_m.justification").alias("justification"), "erreur")


def labelled(df: DataFrame, category: str, suggestion: str, domain: list[str], known: DataFrame, known_id: str) -> DataFrame:
    """Labels of a model made safe: a category outside the domain is named in
    ``categorie_invalide``; a suggestion that is blank, "null" or "none" is null, one
    that ``known`` does not have is null and named in ``suggestion_invalide``."""
    clean = T.blank_null(F.trim(suggestion), "null", "none")
    ids = known.select(F.col(known_id).alias("_s")).where("_s is not null").distinct().withColumn("_known", F.lit(True))
    rows = df.withColumn("_s", F.trim(clean)).join(ids, "_s", "left")
    given = F.col("_s").isNotNull()
    return (
        rows.withColumn("categorie_invalide", F.when(~F.coalesce(F.col(category).isin(*domain), F.lit(False)), F.coalesce(F.col(category), F.lit(""))))
        .withColumn("suggestion_invalide", F.when(given & F.col("_known").isNull(), F.col("_s")))
        .withColumn(suggestion, F.when(F.col("_known"), F.col("_s")))
        .drop("_s", "_known")
    )


def audit(initial: Column, risk: Column, suggested: Column, quoted: Column, order: list[str]) -> Column:
    """struct(signal, niveau, priorite, incoherence): what an audit says of a label, which it never changes.

    Only a level of ``order`` (the most urgent first) that is more urgent than the
    label is a signal; a risk without such a level is incoherent.  A signal is of
    high priority if its quotation stands in the text.
    """
    place = lambda c: F.coalesce(*(F.when(c == x, F.lit(i)) for i, x in enumerate(order)))
    risky = F.coalesce(risk.cast("boolean"), F.lit(False))
    above = F.coalesce(place(suggested) < place(initial), F.lit(False))
    signal = risky & above
    return F.struct(
        signal.alias("signal"), F.when(signal, suggested).alias("niveau"),
        F.when(signal, F.when(F.coalesce(quoted, F.lit(False)), "haute").otherwise("basse")).alias("priorite"), (risky & ~above).alias("incoherence"),
    )


def invented(elements: Column, grave: str = "medicale") -> Column:
    """struct(graves, mineurs, non_verifiee) of what a fidelity judge found: null means that it said nothing usable."""
    named = F.filter(elements, lambda e: F.coalesce(e["element"], F.lit("")) != "")
    serious = lambda e: F.coalesce(e["importance"] == grave, F.lit(False))
    return F.struct(F.filter(named, serious).alias("graves"), F.filter(named, lambda e: ~serious(e)).alias("mineurs"), elements.isNull().alias("non_verifiee"))


def converted(value: Column, unit: Column, q: Quantity) -> Column:
    """struct(valeur, journal): a value in the common unit and what was converted;
    no unit counts as the common one, an unknown unit gives no value."""
    name = F.when(F.coalesce(F.trim(unit), F.lit("")) == "", q.common).otherwise(F.coalesce(*(F.when(unit.rlike(f"(?iu)^\\s*(?:{p})\\s*$"), F.lit(n)) for n, p in q.spellings.items())))
    out = value * F.coalesce(*(F.when(name == n, F.lit(f)) for n, f in q.factors.items()))
    log = F.when(out.isNotNull() & (name != q.common), F.concat(plain_number(value), F.lit(" "), name, F.lit(" -> "), plain_number(F.round(out, 4)), F.lit(f" {q.common}")))
    return F.struct(out.alias("valeur"), log.alias("journal"))


def plain_number(x: Column) -> Column:
    """A number as text, whole ones without a decimal point."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def outside(value: Column, low: Column, high: Column) -> Column:
    """Whether a value is outside a range whose ends may be null (open); null values are inside."""
    return F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))


def without_spans(text: Column, spans: Column, titles: str) -> Column:
    """struct(texte, acceptes, ecartes): spans (debut from 0, fin, type) replaced by
    ``[TYPE]`` where a title stands before them; the others are left and listed.

    Spans must not overlap; their order does not matter.
    """
    ordered = F.array_sort(spans)
    head = lambda s: F.substr(text, F.lit(1), s["debut"])
    good = lambda s: head(s).rlike(rf"(?:^|[^\p{{L}}])(?:{titles})\s*$")
    taken = F.filter(ordered, good)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["debut"] - a["at"]), F.lit("["), s["type"], F.lit("]")).alias("out"), s["fin"].cast("int").alias("at"))
    done = F.aggregate(taken, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return F.struct(done.alias("texte"), taken.alias("acceptes"), F.filter(ordered, lambda s: ~good(s)).alias("ecartes"))


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; ``b`` holds where both have a key, null is empty."""
    kind = "map<string,string>"
    x, y = (F.coalesce(m, F.create_map().cast(kind)) for m in (a, b))
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.array_contains(F.map_keys(y), k)), y)


def with_probabilities(df: DataFrame, probabilities: DataFrame, key: str, column: str = "probabilites") -> DataFrame:
    """Rows with their probabilities by key, never by position; rows without any keep null."""
    return df.join(probabilities.groupBy(key).agg(F.first(column).alias(column)), key, "left")


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows of a total order; all for none or 0."""
    return df.orderBy(*order).limit(n) if n else df


def until(df: DataFrame, good: Column, wanted: int, scanned: int, *order: str) -> DataFrame:
    """The first ``wanted`` good rows among the first ``scanned`` of a total order."""
    return first_rows(first_rows(df, scanned, *order).where(F.coalesce(good, F.lit(False))), wanted, *order)


def gathered(df: DataFrame, keys: list[str], order: str, columns: list[str], most: int) -> DataFrame:
    """Per key its first ``most`` rows in order, as an array of structs, and how many it has (``n``)."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(order)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct(order, *(c for c in columns if c != order))))).alias("lignes"))
