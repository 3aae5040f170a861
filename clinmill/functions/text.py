"""Text expressions: folding, fingerprints, quotations, numbers, replies.

All are Column expressions that stay in the JVM.  Null in gives null out
unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as all engines understand it.
BLANK = r"[ \t\n\r\f\x0B]"


def _latin() -> tuple[str, str]:
    """Accented Latin letters and their plain ones, by decomposition."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii() and base.isalpha():
            pairs.append((chr(cp), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _latin()


def unaccented(text: Column) -> Column:
    """Latin letters without their accents; combining marks are dropped."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "[̀-ͯ]", "")


def folded(text: Column) -> Column:
    """Lower case, typographic apostrophes made plain, no accents."""
    return unaccented(F.lower(F.replace(text, F.lit("’"), F.lit("'"))))


def stripped(text: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def case_fingerprint(text: Column, length: int = 200) -> Column:
    """Id of a case: the hash of the first characters of its collapsed text."""
    return F.concat(F.lit("cas_"), F.substring(F.sha1(F.substring(collapsed(text), 1, length)), 1, 12))


def prompt_hash(text: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def content_id(text: Column, prefix: str = "um_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, 12))


def seeded(seed: int, *keys: Column | str) -> Column:
    """A sort key that replaces a seeded draw: reproducible everywhere."""
    return F.sha2(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]), 256)


def chosen_of(options: list[str], key: Column) -> Column:
    """One of the options by the CRC-32 of a key."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.crc32(key), F.lit(len(options))) + 1).cast("int"))


def quotable(text: Column) -> Column:
    """Letters and digits with single blanks between, folded, ligatures opened."""
    plain = F.replace(F.replace(folded(text), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), None).otherwise(F.size(F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")))


def quoted(quote: Column, source: Column, each: int = 3, whole: int = 4) -> Column:
    """Whether a quotation stands literally in its source.

    Parts between ellipses must each be whole words of the source, at least
    ``each`` words long, ``whole`` together; null or empty is no quotation.
    """
    parts = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), quotable), lambda p: p != "")
    n = lambda p: F.size(F.split(p, " "))
    inside = F.concat(F.lit(" "), quotable(source), F.lit(" "))
    found = F.forall(parts, lambda p: (n(p) >= each) & F.contains(inside, F.concat(F.lit(" "), p, F.lit(" "))))
    total = F.aggregate(parts, F.lit(0), lambda acc, p: acc + n(p))
    return F.coalesce((F.size(parts) > 0) & found & (total >= whole), F.lit(False))


def longest_run(quote: Column, source: Column) -> Column:
    """struct(n, total): words of the longest run of the quotation that stands in the source.

    One pass: a longer run that ends at a word can only be one word longer than
    the longest one before it.
    """
    ws = F.split(quotable(quote), " ")
    inside = F.concat(F.lit(" "), quotable(source), F.lit(" "))

    def step(best: Column, end: Column) -> Column:
        run = F.array_join(F.slice(ws, F.greatest(end - best, F.lit(1)), best + 1), " ")
        return F.when((end > best) & F.contains(inside, F.concat(F.lit(" "), run, F.lit(" "))), best + 1).otherwise(best)

    empty = F.coalesce(quotable(quote), F.lit("")) == ""
    n = F.when(empty, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(ws)), F.lit(0), step))
    return F.struct(F.coalesce(n, F.lit(0)).alias("n"), F.when(empty, 0).otherwise(F.size(ws)).alias("total"))


def loosely_quoted(quote: Column, source: Column, least: int = 3, share: float = 0.5) -> Column:
    """Whether a run of at least ``least`` words and ``share`` of the quotation stands in the source."""
    run = longest_run(quote, source)
    return (run["n"] >= least) & (run["n"] >= run["total"] * share)


def numbers(text: Column) -> Column:
    """The numbers of a text, a decimal comma read as a point."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit(".")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda x: x.cast("double"))


def value_present(text: Column, *candidates: Column, tolerance: float = 0.06) -> Column:
    """Whether a number of the text is one of the candidates (other units, say); nulls aside."""
    wanted = F.filter(F.array(*candidates), lambda c: c.isNotNull())
    return F.coalesce(F.exists(numbers(text), lambda n: F.exists(wanted, lambda c: F.abs(n - c) <= tolerance)), F.lit(False))


def lenient_number(text: Column) -> Column:
    """A number with point or comma, blanks around it allowed; else null."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def blank_null(text: Column, *also: str) -> Column:
    """Null for blank texts and for the given words in any case."""
    return F.when(F.lower(F.trim(text)).isin("", *also), None).otherwise(text)


# Ends of a generated reply, and the tag that closes a call.
END_MARKS = ("<|im_end|>", "<|endoftext|>", "<|im_start|>")
TAG = r"\[\[PRIORITE:\s*([a-z_]+)\s*\]\]"


def clean_reply(text: Column, marks: tuple[str, ...] = END_MARKS) -> Column:
    """A reply up to its first end mark, stripped."""
    out = text
    for m in marks:
        out = F.substring_index(out, m, 1)
    return stripped(out)


def concludes(text: Column) -> Column:
    return F.contains(text, F.lit("[[PRIORITE:"))


def tag_label(text: Column) -> Column:
    """The label in a closing tag; null without one."""
    return F.nullif(F.regexp_extract(text, TAG, 1), F.lit(""))


def tag_of(label: Column) -> Column:
    return F.concat(F.lit("[[PRIORITE:"), label, F.lit("]]"))


def question_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\?+"))


def matching_names(text: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that a text matches, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?iu){p}"), name) for name, p in patterns.items())))


def drifts_from(text: Column, foreign: tuple[str, ...], own: tuple[str, ...], least: int = 3) -> Column:
    """Whether a text leaves its language: letters of an East Asian script, or at
    least ``least`` words of the ``foreign`` list (folded) and more than of ``own``."""
    ws = F.regexp_extract_all(folded(text), F.lit("[a-z]+"), F.lit(0))
    count = lambda some: F.size(F.filter(ws, lambda w: w.isin(*some)))
    return text.rlike(r"\p{IsHan}|\p{IsHiragana}|\p{IsKatakana}|\p{IsHangul}") | ((count(foreign) >= least) & (count(foreign) > count(own)))


def artefacts(text: Column, marks: list[str], end: str = "<|im_end|>") -> Column:
    """Which of the marks stand in a reply before its end."""
    head = F.substring_index(text, end, 1)
    return F.filter(F.array(*map(F.lit, marks)), lambda m: F.contains(head, m))


def before(text: Column, mark: str = " : ") -> Column:
    """A text up to a mark, whole without one."""
    return F.substring_index(text, mark, 1)


def retry_delay(message: Column) -> Column:
    """Seconds to wait that an error message names (s, ms or min); null if none."""
    number = lambda p: F.regexp_extract(message, p, 1).try_cast("double")
    return F.coalesce(
        number(r"(?i)(\d+(?:\.\d+)?)\s*ms\b") / 1000,
        F.coalesce(number(r"(?i)(\d+(?:\.\d+)?)\s*m(?:in)?\s*\d"), F.lit(0.0)) * 60 + number(r"(?i)(\d+(?:\.\d+)?)\s*s(?:ec\w*)?\b"),
        number(r"(?i)(\d+(?:\.\d+)?)\s*min") * 60,
    )


def tidy(text: Column, typos: dict[str, str]) -> Column:
    """Blanks collapsed, known typing errors mended, first letter a capital."""
    out = collapsed(text)
    for wrong, right in typos.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))


# Civilities before a name.
TITLES = r"M\.|Mr\.?|Mme|Mlle|Madame|Monsieur|Mademoiselle|Dr\.?|Docteur|Pr\.?|Professeur"
TITLED_NAME = rf"\b({TITLES})\s+(\p{{Lu}}[\p{{L}}'’-]+(?:\s+\p{{Lu}}[\p{{L}}'’-]+)?)"


def titled_names(text: Column) -> Column:
    """Names after a civility, in order."""
    return F.regexp_extract_all(text, F.lit(TITLED_NAME), F.lit(2))


def without_titled_names(text: Column, placeholder: str = "[PERSON]") -> Column:
    """Names after a civility replaced, the civility kept."""
    return F.regexp_replace(text, TITLED_NAME, f"$1 {placeholder.replace('[', chr(92) + '[').replace(']', chr(92) + ']')}")


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def listed(items: Column, quotes: Column, none: str = "aucun") -> Column:
    """``item <- « quote »`` joined by double bars; ``none`` for an empty list."""
    each = F.transform(items, lambda i: F.concat(i, F.lit(" <- « "), F.coalesce(quotes[i], F.lit("?")), F.lit(" »")))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(each, " || ")).otherwise(none)
