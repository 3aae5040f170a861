"""Personal data in free text, found by a linear-chain conditional random field.

Features of a token are its folded word, shape, prefix and suffix and whether
it is a known given name, street word or civility, each at offsets -3 to 3.
As all depend on one token, the scores of a token type are computed once and
looked up for its further occurrences; a batch is scored by adding seven rows
per token.  Where the score of "no personal data" leads by more than
neighbours can ever change, that label is certain; Viterbi runs only on the
stretches between such tokens, many at a time, in numpy, with the same result.

A check of each place follows: a telephone number has digits enough, an
address a number and a street or, where it begins with one, any word, a name more than an initial.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinmill.llm.pii_table import CIVILITIES, GIVEN, STREETS, labelled_texts
from clinmill.llm.shingles import fold

LABELS = ("", "nom", "telephone", "courriel", "identite", "adresse")
PLACEHOLDER = {"nom": "[NOM]", "telephone": "[TELEPHONE]", "courriel": "[COURRIEL]", "identite": "[IDENTITE]", "adresse": "[ADRESSE]"}
K = len(LABELS)
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_|\n+")
DIMS = 1 << 16
#: Texts of the labelled table, passes over it.
TRAINING_TEXTS, EPOCHS = 3000, 8
CHUNK = 256
PLACES = "nom_table string, id string, type_donnee string, debut bigint, fin bigint, texte string"
_GIVEN, _STREETS, _CIVIL = ({fold(w) for w in x} for x in (GIVEN, STREETS, CIVILITIES))


def token_features(token: str) -> list[str]:
    if token[0] == "\n":
        return ["w:\n", "s:\n"]
    if token[0].isdigit():
        n = len(token)
        return [f"s:d{min(n, 16)}", "c:d", "w:" + (token if n == 1 else token[:2] + f"~{n}" if n == 2 or token[0] == "0" else f"~{n}")]
    if not token[0].isalpha():
        return ["w:" + token, "s:" + token]
    low = fold(token)
    shape = "X" if len(token) == 1 and token.isupper() else "XX" if token.isupper() else "Xx" if token[0].isupper() else "xx"
    out = ["w:" + low, "s:" + shape, "l:" + str(min(len(low), 9)), "p:" + low[:3], "e:" + low[-3:], "c:a", "s+:" + shape + low[-3:]]
    if low in _GIVEN:
        out += ["g:given", "g:given" + shape]
    if low in _STREETS:
        out.append("g:street")
    if low in _CIVIL:
        out += ["g:civil", "g:civil" + shape]
    return out


def _slot(feature: str) -> int:
    h = 2166136261
    for c in feature.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h % DIMS


class Types:
    """Token types by number, with the feature slots of each."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.slots: list[list[int]] = []

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.number
        for t in set(tokens).difference(known):
            known[t] = len(self.slots)
            self.slots.append([_slot(f) for f in token_features(t)])
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


class Crf:
    """Weights: offsets x known feature slots x labels, and transitions.

    ``known`` lists the slots met in training; the last row of the weights is
    zero and stands for all others.
    """

    def __init__(self, known: np.ndarray, weights: np.ndarray, transitions: np.ndarray) -> None:
        self.known = known
        self.weights = weights
        self.row = np.full(DIMS, len(known), np.int64)
        self.row[known] = np.arange(len(known))
        self.transitions = transitions
        t = transitions
        #: What a label can gain at most by its neighbours over "no personal data" there.
        self.bound = (t - t[:, :1]).max(0) + (t - t[:1, :]).max(1)

    def type_scores(self, slots: list[list[int]]) -> np.ndarray:
        """Scores of types: types x offsets x labels."""
        out = np.zeros((len(slots), len(OFFSETS), K), np.float32)
        for i, s in enumerate(slots):
            out[i] = self.weights[:, self.row[s], :].sum(1)
        return out

    def viterbi(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of stretches of ``scores``; neighbours outside are label 0."""
        labels = np.zeros(len(scores), np.int8)
        t = self.transitions
        for size in np.unique(lengths):
            at = starts[lengths == size]
            idx = at[:, None] + np.arange(size)
            e = scores[idx]
            best = t[0] + e[:, 0]
            back = np.zeros((len(at), size, K), np.int8)
            for k in range(1, size):
                total = best[:, :, None] + t[None]
                back[:, k] = total.argmax(1)
                best = total.max(1) + e[:, k]
            y = (best + t[:, 0]).argmax(1)
            for k in range(size - 1, -1, -1):
                labels[idx[:, k]] = y
                y = back[np.arange(len(at)), k, y]
        return labels


def context(ids: np.ndarray, doc: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Scores of tokens: the rows of the types at each offset within the text."""
    n = len(ids)
    scores = np.zeros((n, K), np.float32)
    for j, o in enumerate(OFFSETS):
        a, b = max(0, -o), min(n, n - o)
        if a >= b:
            continue
        part = table[ids[a + o : b + o], j]
        if o:
            part = part * (doc[a + o : b + o] == doc[a:b])[:, None]
        scores[a:b] += part
    return scores


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def train(texts: list[list[tuple[str, str]]], epochs: int = EPOCHS, seed: int = 5, rate: float = 0.08, decay: float = 1e-6) -> Crf:
    """Maximum likelihood by AdaGrad over batches of texts."""
    types = Types()
    seqs = []
    for pieces in texts:
        whole, spans, at = "", [], 0
        for t, y in pieces:
            if y:
                spans.append((at, at + len(t), LABELS.index(y)))
            whole += t
            at += len(t)
        tokens, y, k = [], [], 0
        for m in TOKEN.finditer(whole):
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            tokens.append(m[0])
            y.append(spans[k][2] if k < len(spans) and spans[k][0] <= m.start() else 0)
        seqs.append((types(tokens), np.array(y)))
    width = max(map(len, types.slots))
    slots = np.full((len(types.slots), width), DIMS, np.int64)  # DIMS is an empty slot
    for i, s in enumerate(types.slots):
        slots[i, : len(s)] = s
    used = np.unique(slots)
    compact = np.searchsorted(used, slots)
    w = np.zeros((len(OFFSETS), len(used), K))
    hist = np.full_like(w, 1e-2)
    trans = np.zeros((K, K))
    thist = np.full_like(trans, 1e-2)
    rng = np.random.default_rng(seed)
    blank = np.searchsorted(used, DIMS)
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for b in range(0, len(seqs), 32):
            part = sorted((seqs[i] for i in order[b : b + 32]), key=lambda s: -len(s[0]))
            n, size = len(part), len(part[0][0])
            ids, y = np.full((n, size), -1), np.zeros((n, size), np.int64)
            for i, (x, yy) in enumerate(part):
                ids[i, : len(x)], y[i, : len(x)] = x, yy
            live = ids >= 0
            e = np.zeros((n, size, K))
            cols = []
            kinds, flat = np.unique(ids[live], return_inverse=True)
            local = np.full((n, size), len(kinds))  # the last row of a table stands for no token
            local[live] = flat
            slots_of = compact[kinds]
            for j, o in enumerate(OFFSETS):
                moved = np.full_like(local, len(kinds))
                if o < 0:
                    moved[:, -o:] = local[:, :o]
                elif o:
                    moved[:, :-o] = local[:, o:]
                else:
                    moved = local
                cols.append(moved)
                e += np.concatenate([w[j][slots_of].sum(1), np.zeros((1, K))])[moved]
            # forward and backward over padded texts
            alpha, beta = np.zeros((n, size, K)), np.zeros((n, size, K))
            alpha[:, 0] = e[:, 0] + trans[0]
            for k in range(1, size):
                step = _logsumexp(alpha[:, k - 1, :, None] + trans[None], 1) + e[:, k]
                alpha[:, k] = np.where(live[:, k, None], step, alpha[:, k - 1])
            for k in range(size - 2, -1, -1):
                step = _logsumexp(trans[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
                beta[:, k] = np.where(live[:, k + 1, None], step, 0)
            z = _logsumexp(alpha[:, -1], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
            g = p.copy()
            g[np.arange(n)[:, None], np.arange(size), y] -= live
            tg = decay * trans
            for k in range(1, size):
                m = live[:, k]
                pair = np.exp(alpha[m, k - 1, :, None] + trans[None] + (e[m, k] + beta[m, k])[:, None, :] - z[m, None, None])
                tg += pair.sum(0)
                np.subtract.at(tg, (y[m, k - 1], y[m, k]), 1)
            # gradients are summed by token type, then spread to its features; only touched rows move
            touched, at = np.unique(slots_of.ravel(), return_inverse=True)
            for j, moved in enumerate(cols):
                by_type = np.stack([np.bincount(moved[live], g[..., k][live], minlength=len(kinds) + 1)[:-1] for k in range(K)], 1)
                spread = np.repeat(by_type, width, axis=0)
                gw = np.stack([np.bincount(at.ravel(), spread[:, k], minlength=len(touched)) for k in range(K)], 1)
                gw += decay * w[j][touched]
                gw[touched == blank] = 0
                hist[j][touched] += gw * gw
                w[j][touched] -= rate * gw / np.sqrt(hist[j][touched])
            thist += tg * tg
            trans -= rate * tg / np.sqrt(thist)
    real = used < DIMS
    weights = np.zeros((len(OFFSETS), int(real.sum()) + 1, K), np.float32)
    weights[:, :-1] = w[:, real]
    return Crf(used[real], weights, trans)


@lru_cache(maxsize=1)
def model() -> Crf:
    """The tagger trained from the labelled table; the same each time."""
    return train(labelled_texts(TRAINING_TEXTS))


_MAIL = re.compile(r"[\w.+\-]+\s?(?:@|\(at\)|\[at\]|\[\s?at\s?\]|\(\s?at\s?\)|\{at\}|\barobase\b|\bat\b)\s?[\w\-]+(?:\.[\w\-]+)+", re.I)
_STREET = re.compile(r"\d+\s*(?:bis|ter|quater|[a-d]\b)?\s*,?\s+(?:" + "|".join(sorted(STREETS, key=len, reverse=True)) + r")\b", re.I)

#: A house number and a word, whatever the street is called.
_HOUSE = re.compile(r"\d{1,4}\s*(?:bis|ter|quater|[a-d]\b)?\s*,?\s+[^\W\d_]{2,}", re.I)


def checked(text: str, kind: str, a: int, b: int) -> tuple[int, int] | None:
    """The place with its exact bounds, or null if it can't be of its kind."""
    said = text[a:b]
    if kind == "courriel":
        for m in _MAIL.finditer(text, max(0, a - 60), min(len(text), b + 60)):
            if m.start() < b and m.end() > a:
                return m.start(), m.end()
        return None
    if kind == "telephone":
        m = re.search(r"[+(]?\d[\d\s().\-]*\d", said)
        if not m or not 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            return None
        a, b = a + m.start(), a + m.end()
        while a and text[a - 1] in "+(" and text[a] not in "+":
            a -= 1
        return a, b
    if kind == "identite":
        m = re.search(r"[^\W_][\w\s.\-]*[^\W_]", said)
        if not m or sum(c.isdigit() for c in m[0]) < 6:
            return None
        a, b = a + m.start(), a + m.end()
        while a and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
        return a, b
    if kind == "adresse":
        m = _STREET.search(text, max(0, a - 12), b + 20)
        if not m or m.start() > b:
            m = _HOUSE.search(text, a, b)
            if not m or m.start() > a + 2:
                return None
        start = m.start()
        while start and text[start - 1].isdigit():
            start -= 1
        return start, max(b, m.end())
    while True:  # a civility isn't part of a name
        m = re.match(r"(?i)(?:" + "|".join(CIVILITIES) + r")\b\.?\s*", text[a:b])
        if not m or (len(m[0].strip(". ")) == 1 and m[0].strip().lower() != "m."):
            break
        if m[0].strip().lower() == "m." and not re.search(r"(?i)\bm\.\s*$", text[max(0, a - 1) : a + len(m[0])]):
            break
        if m[0].strip(". ").lower() == "m" and re.match(r"(?i)m\.\s", m[0]) and re.search(r"(?i)(?:signée?|mme|m|par)\.?\s*$", text[max(0, a - 8) : a]):
            break  # M. as an initial
        a += m.end()
    said = text[a:b].rstrip(" .,;:()-'’")
    if not re.search(r"[^\W\d_]{2,}", said) or re.search(r"\d", said):
        return None
    return a, a + len(said)


def tokenise(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens of many texts, their text number and position."""
    tokens: list[str] = []
    counts, places = [], []
    for t in texts:
        found = [(m.group(), m.start()) for m in TOKEN.finditer(t)]
        counts.append(len(found))
        tokens += [x[0] for x in found]
        places += [x[1] for x in found]
    return tokens, np.repeat(np.arange(len(texts)), counts), np.array(places, np.int64)


class Tagger:
    """Finds places in batches of texts; keeps the scores of token types it has met."""

    def __init__(self, crf: Crf, most_types: int = 200_000) -> None:
        self.crf = crf
        self.most = most_types
        self.reset()

    def reset(self) -> None:
        self.types = Types()
        self.table = np.zeros((0, len(OFFSETS), K), np.float32)

    def __call__(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        tokens, doc, at = tokenise(texts)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not tokens:
            return out
        if len(self.types.slots) > self.most:
            self.reset()
        ids = self.types(tokens)
        if len(self.types.slots) > len(self.table):
            self.table = np.concatenate([self.table, self.crf.type_scores(self.types.slots[len(self.table) :])])
        scores = context(ids, doc, self.table)
        unsure = (scores[:, :1] - scores[:, 1:] <= self.crf.bound[1:]).any(1)
        where = np.flatnonzero(unsure)
        if not len(where):
            return out
        new = np.r_[True, (np.diff(where) > 1) | (doc[where[1:]] != doc[where[:-1]])]
        starts = where[new]
        lengths = np.diff(np.r_[np.flatnonzero(new), len(where)])
        labels = self.crf.viterbi(scores, starts, lengths)
        hit = np.flatnonzero(labels)
        if not len(hit):
            return out
        first = np.r_[True, (np.diff(hit) > 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (doc[hit[1:]] != doc[hit[:-1]])]
        begin = np.flatnonzero(first)
        end = np.r_[begin[1:], len(hit)] - 1
        for i, j in zip(hit[begin].tolist(), hit[end].tolist()):
            d = int(doc[i])
            kind = LABELS[labels[i]]
            place = checked(texts[d], kind, int(at[i]), int(at[j]) + len(tokens[j]))
            if place and not (out[d] and out[d][-1][0] == kind and place[0] < out[d][-1][2]):
                out[d].append((kind, *place))
        return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            yield [c.to_pylist() for c in b.slice(at, CHUNK).columns]


def shipped(df: DataFrame):
    """The model as a broadcast of plain arrays, of a size fixed by the labelled table."""
    crf = model()
    return df.sparkSession.sparkContext.broadcast((crf.known, crf.weights, crf.transitions))


def places(texts: DataFrame) -> DataFrame:
    """(nom_table, id, text) to one row per place, as ``PLACES``.

    ``debut`` is the number of characters before the place, ``fin`` the number
    before its end.  Null and empty texts have none; repeated rows count once.
    """
    crf = shipped(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Crf(*crf.value))
        for names, ids, given in _batches(batches):
            rows = [(n, i, k, a, b, t[a:b]) for n, i, t, found in zip(names, ids, given, tagger(given)) for k, a, b in found]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=[c.split()[0] for c in PLACES.split(", ")],
            )

    given = texts.select(F.col("nom_table").cast("string"), F.col("id").cast("string"), F.col("text").cast("string")).where("text is not null and id is not null")
    return given.mapInArrow(run, PLACES).distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """(nom_table, id, text) with typed placeholders in the places; all else,
    rows without text included, unchanged."""
    crf = shipped(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Crf(*crf.value))
        for names, ids, given in _batches(batches):
            out = []
            for t, found in zip(given, tagger([t or "" for t in given])):
                for kind, a, b in reversed(found):
                    t = t[:a] + PLACEHOLDER[kind] + t[b:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["nom_table", "id", "text"])

    return texts.select(F.col("nom_table").cast("string"), F.col("id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "nom_table string, id string, text string")
