"""Words, word n-grams and winnowed fingerprints of texts, in numpy batches.

A word is a run of letters and digits, lower case, without accents.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import numpy as np

WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)
_APART, _MARK, _SEVERAL, _UNKNOWN = 0, 1, 2, 0xFFFFFFFF


def fold(text: str) -> str:
    """Lower case without accents; compatibility forms are unified."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text))


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return WORD.findall(fold(text)) if text else []


class Folding:
    """What each code point becomes; filled as code points are met."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, _UNKNOWN, np.uint32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (out == _UNKNOWN).any():
            for c in np.unique(codes[out == _UNKNOWN]).tolist():
                self.table[c] = self.of(chr(c))
            out = self.table[codes]
        return out

    @staticmethod
    def of(char: str) -> int:
        if unicodedata.combining(char):
            return _MARK
        done = fold(char)
        if len(done) != 1:
            return _SEVERAL if done else _MARK
        return ord(done) if done.isalnum() else _APART


class Words(NamedTuple):
    """The words of a batch of texts, in order."""

    doc: np.ndarray  #: text number of each word
    hashes: np.ndarray  #: 64-bit hash of each word
    lengths: np.ndarray  #: number of words of each text
    texts: list[str]  #: each text as its words with blanks between


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def split_words(texts: list[str], folding: Folding, strings: bool = True) -> Words:
    """Split, fold and hash the words of many texts at once."""
    n = len(texts)
    joined = "\x00".join(texts)
    if joined.count("\x00") != max(n - 1, 0):
        texts = [t.replace("\x00", " ") for t in texts]
        joined = "\x00".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = folding(codes)
    if (out == _SEVERAL).any():  # rare: ligatures and the like
        doc = np.cumsum(codes == 0)
        texts = list(texts)
        for i in np.unique(doc[out == _SEVERAL]).tolist():
            texts[i] = "".join(c if folding.of(c) != _SEVERAL else " " for c in fold(texts[i]))
        codes = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = folding(codes)
    kept = out != _MARK
    if not kept.all():
        codes, out = codes[kept], out[kept]
    inside = out > _SEVERAL
    before = np.zeros(len(out), bool)
    before[1:] = inside[:-1]
    apart = codes == 0
    doc_at = np.cumsum(apart) - apart  # a separator belongs to the text before it
    start = np.flatnonzero(inside & ~before)
    doc = doc_at[start]
    if len(start):
        chars = out[inside].astype(np.uint64)
        first = np.cumsum(inside)[start] - 1
        length = np.diff(np.r_[first, len(chars)])
        place = np.arange(len(chars)) - np.repeat(first, length)
        x = (chars + (place.astype(np.uint64) << np.uint64(32))) * _GOLD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        hashes = mixed(np.add.reduceat(x, first) + length.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    parts: list[str] = []
    if strings:
        keep = inside | before
        flat = np.where(inside, out, 32)[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.bincount(doc_at[keep], minlength=n)).tolist()
        parts = [flat[a:b].rstrip() for a, b in zip([0, *ends], ends)]
    return Words(doc, hashes, np.bincount(doc, minlength=n), parts)


def distinct(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text by their upper 48 bits; fewer than 65,536 texts."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def grams(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of consecutive words of a text: (index of the first word, hash)."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(total - n + 1, np.uint64)
    for k in range(n):
        h += hashes[k : total - n + 1 + k] * _STEPS[k % len(_STEPS)]
        h ^= h >> np.uint64(17)
    at = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
    return at, mixed(h[at])


def winnowed(doc: np.ndarray, h: np.ndarray, window: int) -> np.ndarray:
    """Indices of the minima of all windows of ``window`` consecutive n-grams
    of a text (the last of equal minima); a text with fewer n-grams keeps its
    only minimum."""
    n = len(h)
    keep = np.zeros(n, bool)
    if n >= window:
        m = n - window + 1
        low, best = h[:m].copy(), np.arange(m)
        for k in range(1, window):
            other = h[k : m + k]
            better = other <= low
            np.copyto(low, other, where=better)
            best[better] = np.flatnonzero(better) + k
        keep[best[doc[:m] == doc[window - 1 :]]] = True
    if n:
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        counts = np.diff(np.r_[starts, n])
        for s, c in zip(starts[counts < window].tolist(), counts[counts < window].tolist()):
            keep[s + int(np.argmin(h[s : s + c]))] = True
    return np.flatnonzero(keep)
