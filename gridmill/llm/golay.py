"""The perfect binary Golay code [23, 12, 7], as tables that are computed on first use."""

from __future__ import annotations

from functools import cache

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the code.
GENERATOR = 0b110001110101
BITS, CHECK = 23, 11


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator; zero for codewords."""
    rest = words.astype(np.int64)
    for bit in range(BITS - 1, CHECK - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECK)), rest)
    return rest


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight 3 or less; and, where that weight is 3, the five errors of weight 4."""
    from itertools import combinations

    errors = [0] + [sum(1 << i for i in c) for k in (1, 2, 3) for c in combinations(range(BITS), k)]
    lead = np.zeros(1 << CHECK, np.int64)
    lead[syndrome(np.array(errors))] = errors
    four = np.array([sum(1 << i for i in c) for c in combinations(range(BITS), 4)])
    of = syndrome(four)
    order = np.argsort(of, kind="stable")
    four, of = four[order], of[order]
    start, end = np.searchsorted(of, np.arange(1 << CHECK)), np.searchsorted(of, np.arange(1 << CHECK), "right")
    more = np.full((1 << CHECK, 5), -1, np.int64)
    for s in range(1 << CHECK):
        if bin(int(lead[s])).count("1") == 3:
            more[s] = four[start[s] : end[s]]
    return lead, more


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword within distance 3; each word has exactly one."""
    return (words ^ tables()[0][syndrome(words)]) >> CHECK


def around(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within distance 4: one or six a word, -1 where there are fewer.

    Two words within distance 2 share one of these; of two within distance 1, each one's nearest
    codeword is among the other's.
    """
    lead, more = tables()
    s = syndrome(words)
    extra = more[s]
    return np.concatenate([((words ^ lead[s]) >> CHECK)[:, None], np.where(extra >= 0, (words[:, None] ^ extra) >> CHECK, -1)], axis=1)
