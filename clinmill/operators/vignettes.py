"""Sources brought to one record type, and its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinmill.functions.text import folded

FIELDS = ("id", "source", "subset", "split", "langue", "contexte_clinique", "question", "choix", "reponse_correcte", "specialite", "type_question", "task")
REQUIRED = ("id", "source", "langue", "question")


def vignette(df: DataFrame, **columns: Column) -> DataFrame:
    """The normalised record: given columns by name, the others null."""
    kinds = {"choix": "map<string,string>"}
    return df.select(*(columns.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS))


def from_exam(df: DataFrame, subset: str, split: str, source: str = "MediQAl") -> DataFrame:
    """Exam rows with answer_a..answer_e; choices only for multiple choice."""
    letters = "abcde"
    choices = F.map_filter(F.create_map(*[x for c in letters for x in (F.lit(c.upper()), F.col(f"answer_{c}"))]), lambda _, v: v.isNotNull())
    return vignette(
        df, id=F.concat(F.lit(f"mediqal_{subset}_"), F.col("id")), source=F.lit(source), subset=F.lit(subset), split=F.lit(split), langue=F.lit("fr"),
        contexte_clinique=F.col("clinical_case"), question=F.col("question"), choix=choices if subset in ("mcqm", "mcqu") else F.lit(None),
        reponse_correcte=F.col("correct_answers"), specialite=F.col("medical_subject"), type_question=F.col("question_type"), task=F.col("task"),
    )


def from_pharmacy_exam(df: DataFrame, split: str, source: str = "FrenchMedMCQA") -> DataFrame:
    """Rows with a map of answers and an array of right letters, joined by commas."""
    right = F.nullif(F.array_join(F.transform("correct_answers", lambda x: F.upper(x)), ","), F.lit(""))
    return vignette(
        df, id=F.concat(F.lit("frenchmedmcqa_"), F.col("id")), source=F.lit(source), split=F.lit(split), langue=F.lit("fr"), question=F.col("question"),
        choix=F.col("answers"), reponse_correcte=right, specialite=F.col("subject_name"), type_question=F.col("type"), task=F.lit("QCM"),
    )


def from_question_pages(df: DataFrame, source: str = "MedQuAD", keep_unanswered: bool = False) -> DataFrame:
    """English question and answer pairs; without answer only on request."""
    rows = df if keep_unanswered else df.where(F.coalesce("answer", F.lit("")) != "")
    return vignette(
        rows, id=F.concat(F.lit("medquad_"), F.col("id")), source=F.lit(source), langue=F.lit("en"), question=F.col("question"),
        reponse_correcte=F.nullif("answer", F.lit("")), specialite=F.col("focus"), type_question=F.col("qtype"), task=F.lit("QA"),
    )


def missing_fields(required: tuple[str, ...] = REQUIRED) -> Column:
    """Names of the required fields that are null or empty."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c) for c in required)))


def valid(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    return df.where(F.size(missing_fields(required)) == 0)


def with_context(df: DataFrame, text: str = "contexte_clinique") -> DataFrame:
    return df.where(F.coalesce(F.trim(text), F.lit("")) != "")


def main_text(*columns: str) -> Column:
    """The first of the columns that isn't empty; "" if none."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.lit(""))


def relevance(df: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Records with the decision of a classifier (key, urgence, justification);
    a missing or unreadable one counts as not relevant, and says so."""
    d = decisions.select(key, F.col("urgence").alias("_filtre_urgence"), F.col("justification").alias("_filtre_justification")).dropDuplicates([key])
    return df.join(d, key, "left").withColumn("_filtre_justification", F.coalesce("_filtre_justification", F.lit("sans_decision"))).withColumn(
        "_filtre_urgence", F.coalesce("_filtre_urgence", F.lit(False))
    )


# Words of emergencies, folded.
EMERGENCY_TERMS = ("urgences?", "samu", "emergency", "ambulance", "douleur thoracique", "chest pain", "dyspnee", "essoufflement", "breathlessness", "malaise", "syncope", "convulsions?", "seizures?", "hemorragie", "saignement", "bleeding", "bloody", "fracture", "traumatisme", "trauma", "brulures?", "burning", "intoxication", "overdose", "avc", "stroke", "paralysie", "fievre", "fever")


def mentions(text: Column, terms: tuple[str, ...] = EMERGENCY_TERMS) -> Column:
    """Whether a text has one of the terms as whole words, accents and case aside."""
    return folded(text).rlike(r"\b(" + "|".join(terms) + r")\b")


def candidate_pair(prompt: Column, chosen: Column, rejected: Column, most: int = 4000) -> Column:
    """Whether a preference pair is usable: all three there, answers different, short enough, on the subject."""
    there = F.forall(F.array(prompt, chosen, rejected), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return there & (chosen != rejected) & (F.length(prompt) + F.length(chosen) + F.length(rejected) <= most) & mentions(prompt)
