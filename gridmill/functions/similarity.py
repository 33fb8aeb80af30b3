"""Fuzzy scores of labels, from the public definitions of indel similarity and token comparisons."""

from __future__ import annotations

import re

import numpy as np


def prepare(text: str) -> str:
    """Lower case, everything but letters and digits to blanks, trimmed."""
    return re.sub(r"[\W_]", " ", text).lower().strip()


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); 100 for two empty texts."""
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any stretch of the longer one of at most its length."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    n, best = len(short), 0.0
    for start in range(1 - n, len(long)):
        best = max(best, ratio(short, long[max(0, start) : start + n]))
        if best == 100.0:
            break
    return best


def _tokens(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def token_ratio(a: str, b: str, compare=ratio) -> float:
    """The better of comparing sorted tokens and comparing shared tokens with shared and own tokens."""
    both, own_a, own_b = _tokens(a, b)
    best = compare(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    shared = " ".join(both)
    with_a, with_b = " ".join([*both, *own_a]), " ".join([*both, *own_b])
    if both and (not own_a or not own_b):
        return 100.0
    best = max(best, compare(with_a, with_b))
    if shared:
        best = max(best, compare(shared, with_a), compare(shared, with_b))
    return best


def weighted_ratio(a: str, b: str) -> float:
    """Plain, token and partial ratios, weighed by how much the lengths differ."""
    a, b = prepare(a), prepare(b)
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if spread < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * token_ratio(a, b, partial_ratio))


# ---------------------------------------------------------------- the best of many

_CLASSES = 64


def letters(text: str) -> np.ndarray:
    """How often each letter occurs, letters dealt to a few classes: common letters are never counted too low."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), "<u4") % _CLASSES, minlength=_CLASSES)


class Shelf:
    """Entries (tuples that begin with a label) in order, of which `best` finds the most similar.

    Letters that two texts have in common bound their longest common subsequence, and so each ratio:
    without a common word, a score of s needs a plain ratio of s, a ratio of sorted or distinct words
    of s / 0.95, or, beyond one and a half lengths, s / 0.9 (of words: s / 0.855) of a stretch, where the
    common letters make up s / (180 - s) (s / (171 - s)) of the shorter text at least.
    """

    def __init__(self, entries: list[tuple]) -> None:
        self.entries = entries
        self.texts = [prepare(e[0] or "") for e in entries]
        sets = [" ".join(sorted(set(t.split()))) for t in self.texts]
        self.bags = np.array([letters(t) for t in self.texts]).reshape(-1, _CLASSES)
        self.set_bags = np.array([letters(t) for t in sets]).reshape(-1, _CLASSES)
        self.size = np.array([len(t) for t in self.texts], int)
        self.set_size = np.array([len(t) for t in sets], int)
        self.words: dict[str, list[int]] = {}
        for i, t in enumerate(self.texts):
            for w in set(t.split()):
                self.words.setdefault(w, []).append(i)

    def possible(self, text: str, threshold: float) -> np.ndarray:
        """Numbers of entries that may reach the threshold, in order."""
        text = prepare(text)
        if not text or not self.entries:
            return np.zeros(0, int)
        words = set(text.split())
        distinct = " ".join(sorted(words))
        common = np.minimum(self.bags, letters(text)).sum(1)
        common_sets = np.minimum(self.set_bags, letters(distinct)).sum(1)
        shorter, longer = np.minimum(self.size, len(text)), np.maximum(self.size, len(text))
        near = (200 * common >= threshold * (self.size + len(text))) | (200 * common_sets >= threshold / 0.95 * (self.set_size + len(distinct)) - 1e-9)
        near |= (longer >= 1.5 * shorter) & (common * (180 - threshold) >= threshold * shorter - 1e-9)
        near |= common_sets * (171 - threshold) >= threshold * np.minimum(self.set_size, len(distinct)) - 1e-9
        near[[i for w in words for i in self.words.get(w, ())]] = True
        return np.flatnonzero(near & (self.size > 0))

    def best(self, text: str, threshold: float) -> tuple[float, tuple] | None:
        """(score, entry) of the best at the threshold or above, the first on ties."""
        found = None
        for i in self.possible(text, threshold).tolist():
            score = weighted_ratio(text, self.entries[i][0])
            if score >= threshold and (found is None or score > found[0]):
                found = (score, self.entries[i])
        return found
