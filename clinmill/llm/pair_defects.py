"""Answers of preference pairs that are unusable as an answer to their prompt.

``vide``, ``copie_question``, ``autre_langue``, ``refus`` and ``tronquee``; an
answer has at most one, the first of these that holds.

Copies are found by compression: with the prompt as a zstandard dictionary a
copied answer shrinks to almost nothing, and so does the prompt with the answer
as dictionary; a quotation with more around it, or of a part, shrinks on one
side only.  Languages and refusals go by dictionaries.  Truncation
goes by a model of terminal contexts (naive Bayes over what stands at the end),
trained on complete answers and on the same answers cut at random places.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinmill.llm.shingles import fold, words

FOUND = "paire_id bigint, champ string, defaut string"
#: Answers of which the terminal-context model is trained, each also cut CUTS times.
SAMPLE, CUTS = 2000, 3
#: With the other as dictionary, a copy and what it copies both take at most this share of their size alone.
COPY_RATIO = 0.25
#: Bytes of frame and block headers in any compressed text.
OVERHEAD = 9
#: A copy is at most so many times as long as what it copies, and the reverse.
LONGER = 4
#: Bytes of the one match that a whole copy is.
MATCH = 4
# Frequent function words by language.
FUNCTION_WORDS = {
    "fr": "le la les l un une des du de d et est vous je j qui que qu pas au aux en pour ne n si à votre vos avez ce c il elle on dans sur avec plus ou où nous me m mon ma mes son sa ses cette ces être sont ai suis depuis mais quand bien par se s rien très d'ici oui non",
    "en": "the a an of and to is are you your in for with if not that i be this at by on it my was were has have do does what which when how should would will or but from as please no yes can could than me before until while",
    "es": "el la los las un una unos de del y es usted yo que no al en para si su sus ha ese este esta por con más o lo le se me hasta desde cuándo ahora mismo tome llame mejor muy otra vez hace dígame beba qué cómo pero como está",
    "de": "der die das ein eine einen und ist sie ich nicht zu in für mit wenn ihr ihre ihnen haben hat auf von den dem des im am oder bis seit wann sich bei an aus es auch noch bitte kein keine wird werden sollten jetzt wieder mir nächsten heute schon um",
    "it": "il lo la i gli le un una di del della e è lei io che non al in per se suo suoi ha questo questa da con più o si mi fino finché adesso prenda chieda meglio molto quanto tempo già altro resti subito dica alla delle ma come",
    "pt": "o a os as um uma de do da dos e é você eu que não ao em para se seu sua tem este esta por com mais ou lhe há até desde agora tome ligar melhor muito já tome fique meça diga essa sem quanto volte isso mas como está",
    "nl": "de het een en is u ik niet te in voor met als uw heeft op van dat die dit om of bij aan nu nog geen wordt naar uit moet kunt blijf zodra sinds wanneer",
}
_LANGUAGES = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
_SHARED = {w: sum(w in s for s in _LANGUAGES.values()) for s in _LANGUAGES.values() for w in s}

_OF = {w: [k for k, s in _LANGUAGES.items() if w in s] for w in _SHARED}

# What an answer that declines says (folded, by language), and what may stand around it.
REFUSALS = {
    "fr": [
        r"(?:peux|pouvons|puis|pourrai|saurais|pourrais) (?:malheureusement |vraiment |hélas |helas )?(?:pas|plus|ni) (?:vous |y |en |lui |te )?(?:repondre|aider|donner suite|traiter|assister|satisfaire|accepter|poursuivre|continuer|parler|discuter|fournir|dire|conseiller|renseigner|prononcer)",
        r"impossible d[e'] ?(?:donner suite|vous repondre|repondre|vous aider|aider|traiter|poursuivre|continuer|satisfaire|vous renseigner|y repondre)",
        r"(?:je|nous) (?:me |vous )?(?:refus|declin|prefer\w+ ne pas|renonce)", r"dois (?:donc )?(?:decliner|refuser|m'abstenir|m'arreter)", r"pas en mesure d", r"pas (?:autorise|habilite|programme|concu)",
        r"regles d'utilisation", r"mes (?:consignes|regles|principes|directives)", r"pas le droit", r"prefere ne pas", r"sans reponse", r"ne (?:vous )?repondrai pas", r"ma reponse sera non", r"aucune? (?:aide|conseil|reponse|information|avis) ne (?:peut|pourra)",
        r"ne traite pas", r"depasse mon role", r"m'est interdit", r"ne suis qu'un", r"contraint d", r"je m'arrete", r"hors de mon (?:champ|domaine|role)", r"pas de mon ressort", r"m'abstien", r"pas possible (?:pour moi )?d[e'] ?(?:vous )?(?:repondre|aider|traiter|poursuivre|continuer)",
        r"(?:pas|plus) (?:repondre|aider) (?:a|sur|pour|dans)", r"ne (?:fais|donne) (?:pas|aucun)", r"passe mon tour",
    ],
    "en": [
        r"(?:can't|cannot|can not|could not|couldn't|unable to|not able to|won't be able to|won't|will not|not going to|must decline to|refuse to|decline to|rather not) (?:be )?(?:help|assist|answer|respond|comply|provid|continu|discuss|fulfil|do that|address|engage|comment|advise|offer|say|talk|speak|deal|handle)\w*",
        r"no (?:advice|help|answer|information|assistance) can be", r"my (?:rules|guidelines|instructions|policy|policies|principles)", r"not possible for me", r"(?:not|outside what i am) (?:allowed|permitted)", r"falls outside", r"i (?:must |have to |will |would like to )?(?:decline|refuse|abstain|pass)", r"beyond my (?:role|scope|remit)", r"outside my (?:role|scope|remit)", r"against my", r"off limits", r"i am only a", r"i'm only a", r"without an answer", r"my answer is no", r"leave (?:this|that|it) (?:question )?(?:unanswered|without)", r"does not (?:comply|respect) ", r"i stop here", r"forbidden",
    ],
}
POLITE = {
    "fr": [r"bonjour", r"bonsoir", r"merci", r"desole", r"navre", r"bonne (?:continuation|journee|soiree)", r"adressez", r"je vous invite a", r"invite a poser", r"autre (?:question|demande|sujet)", r"cordialement", r"d'accord", r"veuillez", r"consultez", r"quelqu'un d'autre", r"je comprends", r"toutefois", r"malheureusement", r"en tant qu", r"pardon", r"excusez", r"je regrette", r"je reste a votre disposition", r"tournez-vous", r"au revoir", r"bon courage", r"cette demande", r"ce sujet", r"cette requete"],
    "en": [r"hello", r"thank", r"sorry", r"look elsewhere", r"ask someone", r"another question", r"something else", r"someone else", r"good (?:bye|day|luck)", r"please (?:contact|look|ask|try|consult|turn|see)", r"regards", r"apolog", r"as an? (?:ai|assistant|language)", r"unfortunately", r"i understand", r"feel free", r"take care", r"regret", r"this (?:topic|request|question)"],
}
_REFUSAL = re.compile("|".join(x for v in REFUSALS.values() for x in v))
_POLITE = re.compile("|".join(x for v in POLITE.values() for x in v))
#: A sentence that declines and goes on with the call is no refusal.
_GOES_ON = re.compile(
    r"(?:mais|donc|but|however|so|yet)\b.*\b(?:je|j'|vous|nous|le|la|l'|i|you|we|the|they)\b.{0,60}?(?:transme|note|rappel|appel|envoi|passe|deci|previen|call|see you|send|note|tell|transfer|contact|arriv)|pouvez-vous|could you|can you|dites-moi|tell me|entendre|hear you"
)
_TAG = re.compile(r"\[\[[^\]]*\]\]|<\|[^|]*\|>")
_FILLER = {"", "n a", "na", "null", "none", "nan", "nil", "vide", "aucun", "aucune", "rien", "empty", "neant", "todo", "tbd", "ras", "x", "xxx", "undefined", "reponse", "answer", "response"}
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?…]+[.!?…]*")


def answer_text(value: str | None) -> tuple[str, bool]:
    """The answer of a delivered value, and whether it is a message array that breaks off.

    A JSON array of messages stands for its last assistant message (the last
    message if there is none of the assistant); anything else for itself.
    """
    if value is None:
        return "", False
    text = value.strip()
    if not (text.startswith("[{") or text.startswith("[ {")):
        return value, False
    try:
        messages = json.loads(text)
    except ValueError:
        return value, '"role"' in text
    said = [m for m in messages if isinstance(m, dict)]
    own = [m for m in said if m.get("role") == "assistant"] or said
    return str(own[-1].get("content") or "") if own else "", False


def last_patient(prompt: str) -> str:
    """The last message of the patient in a transcript; the whole prompt if it is none."""
    parts = re.split(r"(?im)^\s*(PATIENTE?|AGENT|SYST[EÈ]ME|USER|ASSISTANT)\s*:", prompt)
    for who, said in reversed(list(zip(parts[1::2], parts[2::2]))):
        if who.upper().startswith(("PATIENT", "USER")):
            return said.strip()
    return prompt


def language_scores(text: str) -> tuple[dict[str, float], int]:
    """Function words of each language, shared ones weighed by how many languages have them; number of words."""
    found = re.findall(r"[^\W\d_]+", text.lower())
    score = dict.fromkeys(_LANGUAGES, 0.0)
    for w in found:
        for k in _OF.get(w, ()):
            score[k] += 1.0 / _SHARED[w]
    return score, len(found)


def language(text: str) -> str | None:
    score, n = language_scores(text)
    best = max(score, key=score.get)
    return best if score[best] >= max(1.0, 0.05 * n) else None


def other_language(answer: str, prompt_lang: str | None) -> bool:
    """Whether an answer, quotations and an opening word aside, isn't in the language."""
    if prompt_lang is None:
        return False
    body = _QUOTED.sub(" ", _TAG.sub(" ", answer))
    body = re.sub(r"^\W*(?:\w+(?:['’]\w+)?)\s*[.,!:]\s+", "", body)
    score, n = language_scores(body)
    best = max(score, key=score.get)
    return best != prompt_lang and score[best] >= max(1.5, 0.08 * n) and score[best] > 1.8 * score[prompt_lang] + 0.5


def declines(answer: str) -> bool:
    """Whether every sentence declines or is a formula, and one declines."""
    plain = fold(_TAG.sub(" ", answer)).replace("’", "'")
    said = False
    for s in _SENTENCE.findall(plain):
        s = s.strip()
        if len(s) < 3:
            continue
        if _GOES_ON.search(s):
            return False
        if _REFUSAL.search(s):
            said = True
        elif not _POLITE.search(s):
            return False
    return said


def compressed_ratio(text: str, known: str) -> float:
    """Size of a compressed text with another as dictionary, to its size without; headers and the first match don't count."""
    raw = text.encode("utf-8", "surrogatepass")
    told = zstandard.ZstdCompressionDict(known.encode("utf-8", "surrogatepass") or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = dict(level=3, write_checksum=False, write_content_size=False)
    given = len(zstandard.ZstdCompressor(dict_data=told, write_dict_id=False, **plain).compress(raw))
    return max(given - OVERHEAD - MATCH, 0) / max(len(zstandard.ZstdCompressor(**plain).compress(raw)) - OVERHEAD, 1)


def copies(answer: str, prompt: str, last: str, asked: tuple[list[str], ...] | None = None) -> bool:
    """Whether an answer gives back the prompt or the last message and no more.

    Answer and message must each compress to ``COPY_RATIO`` with the other as
    dictionary; up to three words that introduce the copy don't count.  The very
    same words are a copy at any length.  ``asked``: the words of both, if known.
    """
    body = _TAG.sub(" ", answer).strip().lower()
    said = words(body)
    if said and said in (asked or (words(last), words(prompt))):
        return True
    for target in dict.fromkeys((last.strip().lower(), prompt.strip().lower())):
        first = words(target[:80])[:1]
        if not first or len(said) < 3:
            continue
        starts = [m.start() for m, w in zip(_WORD.finditer(body), said[:4]) if w == first[0]]
        for at in dict.fromkeys([0, *starts]):
            # what is so much longer has more to it than the other, so it can't shrink that far
            if not LONGER * len(target) >= len(body) - at >= len(target) / LONGER:
                continue
            if compressed_ratio(target, body[at:]) <= COPY_RATIO and compressed_ratio(body[at:], target) <= COPY_RATIO:
                return True
    return False


def terminal_features(text: str) -> list[str]:
    """What stands at the end of a text: the last mark, the word before it and open brackets."""
    t = text.rstrip()
    last = t[-1:] or " "
    tail = re.findall(r"[^\W_]+", fold(t[-40:]))
    word = tail[-1] if tail else ""
    return [
        "mark:" + (last if not last.isalnum() else "a" if last.isalpha() else "0"),
        "tag:" + str(t.endswith("]]")),
        "word:" + (word if not last.isalnum() else word + "|"),
        "open:" + str(t.count("(") > t.count(")") or t.count("«") > t.count("»") or t.count("[[") > t.count("]]")),
    ]


class TerminalModel:
    """Naive Bayes: is a text complete or cut, by its terminal context."""

    def __init__(self, complete: list[str], cut: list[str]) -> None:
        self.counts: dict[str, list[int]] = {}
        self.n = [max(1, len(complete)), max(1, len(cut))]
        for k, texts in enumerate((complete, cut)):
            for t in texts:
                for f in terminal_features(t):
                    self.counts.setdefault(f, [0, 0])[k] += 1

    def log_odds(self, text: str) -> float:
        """Logarithm of the odds that the text is cut, at even odds before."""
        out = 0.0
        for f in terminal_features(text):
            a, b = self.counts.get(f, (0, 0))
            out += math.log((b + 0.5) / (self.n[1] + 1)) - math.log((a + 0.5) / (self.n[0] + 1))
        return out


def train_terminal(texts: list[str], seed: int = 7) -> TerminalModel:
    """From answers that end like most do, and their beginnings."""
    rng = random.Random(seed)
    complete = [t for t in texts if len(t) >= 40 and re.search(r"[.!?»)\]\"]\s*$", t)]
    cut = [t[: rng.randrange(12, len(t) - 4)] for t in complete for _ in range(CUTS)]
    return TerminalModel(complete, cut)


class Asked:
    """What the answers to one prompt are held against."""

    def __init__(self, prompt: str | None, context_last: str | None, told: str | None = None) -> None:
        self.prompt = prompt or ""
        self.last = context_last or last_patient(self.prompt)
        self.words = (words(self.last), words(self.prompt))
        self.language = language(self.prompt) or ({"fr": "fr", "en": "en"}.get((told or "").lower()[:2]))


def defect_of(asked: Asked, value: str | None, model: TerminalModel) -> str | None:
    """The defect of one answer, or null."""
    answer, broken = answer_text(value)
    if broken:
        return "tronquee"
    if " ".join(words(_TAG.sub(" ", answer))) in _FILLER:
        return "vide"
    if copies(answer, asked.prompt, asked.last, asked.words):
        return "copie_question"
    if other_language(answer, asked.language):
        return "autre_langue"
    if declines(answer):
        return "refus"
    if not answer.rstrip().endswith("]]") and model.log_odds(answer) > 0:
        return "tronquee"
    return None


def defect(prompt: str | None, context_last: str | None, value: str | None, model: TerminalModel, told: str | None = None) -> str | None:
    """The defect of one answer to a prompt, or null."""
    return defect_of(Asked(prompt, context_last, told), value, model)


def defects(df: DataFrame, key: str = "paire_id") -> DataFrame:
    """(paire_id, champ, defaut), one row per bad answer.

    Repeated rows count once.  A null answer is empty; with a null or blank
    prompt nothing is a copy, and the language is that of ``langue``.  Other
    columns are ignored.  The terminal model is trained on the answers of
    ``SAMPLE`` pairs, chosen by hash.
    """
    given = df.select(
        F.col(key).cast("bigint").alias("paire_id"),
        "prompt",
        F.try_element_at(F.filter("messages_contexte", lambda m: m["role"] == "user"), F.lit(-1))["content"].alias("last"),
        F.col("langue").cast("string").alias("langue"),
        "chosen",
        "rejected",
    ).where("paire_id is not null")
    sample = given.select(F.xxhash64("paire_id").alias("k"), "chosen", "rejected").orderBy("k").limit(SAMPLE).collect()
    model = train_terminal([answer_text(x)[0] for r in sample for x in (r["chosen"], r["rejected"]) if x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fields, kinds = [], [], []
            for i, prompt, last, lang, chosen, rejected in zip(*(c.to_pylist() for c in b.columns)):
                asked = Asked(prompt, last, lang)
                for field, value in (("chosen", chosen), ("rejected", rejected)):
                    kind = defect_of(asked, value, model)
                    if kind:
                        ids.append(i)
                        fields.append(field)
                        kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(kinds, pa.string())], names=["paire_id", "champ", "defaut"])

    return given.mapInArrow(run, FOUND).distinct()


def report(found: DataFrame, pairs: DataFrame, key: str = "paire_id") -> DataFrame:
    """Defects per source and field, with the source's number of pairs."""
    source = pairs.select(F.col(key).cast("bigint").alias("paire_id"), F.col("source").alias("source")).groupBy("paire_id").agg(F.min("source").alias("source"))
    total = source.groupBy("source").agg(F.count(F.lit(1)).alias("n_paires"))
    return found.join(source, "paire_id").groupBy("source", "champ", "defaut").agg(F.count(F.lit(1)).alias("n")).join(total, "source")
