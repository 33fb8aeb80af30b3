"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are runs of `SEED_WORDS` words of a benchmark item, letters and digits only, in lower case. An
item keeps all its seeds, rare or not, so each document that holds one is judged: around each place
where a seed stands, a bound that the score can't exceed (the item's words in any stretch as long as
an alignment can be) rules out most, and the rest is aligned. The item is found if the local
alignment scores `THRESHOLD` of the item's own score. With words replaced or left out, a find in an
item of more than ten words always holds a seed; words put in after every second word leave none.

The benchmark is taken in blocks of `BLOCK_ITEMS` items of bounded size, each of which goes to all
tasks as one closure; the corpus is read whole for each block and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import U64, join2, mix, slices, split_words

SEED_WORDS = 3
THRESHOLD = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20

MARKS = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    """A word's letters and digits in lower case; none for a word of marks alone."""
    return MARKS.sub("", word.lower())


def item_words(text: str | None) -> list[str]:
    return [p for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") if (p := plain(w))]


class Index:
    """Words and seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.keys = [k for k, _ in items]
        lists = [item_words(t) for _, t in items]
        self.vocab: dict[str, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int32) for ws in lists]
        pairs = [(s, i) for i, ws in enumerate(self.items) for s in set(self.seeds(ws.astype(np.int64)).tolist())]
        self.seed = np.array(sorted({s for s, _ in pairs}), U64)
        at = np.searchsorted(self.seed, np.array([s for s, _ in pairs], U64)) if pairs else np.zeros(0, int)
        self.of: list[list[int]] = [[] for _ in self.seed]
        for k, (_, i) in zip(at, pairs):
            self.of[k].append(i)

    @staticmethod
    def seeds(codes: np.ndarray) -> np.ndarray:
        """Names of all seeds of a run of word codes; an item shorter than a seed is one seed."""
        n = min(SEED_WORDS, len(codes))
        if n == 0:
            return np.zeros(0, U64)
        c = codes.astype(U64)
        name = mix(c[: len(c) - n + 1])
        for k in range(1, n):
            name = join2(name, c[k : len(c) - n + 1 + k])
        return name

    def short(self) -> list[int]:
        return sorted({len(w) for w in self.items if 0 < len(w) < SEED_WORDS})

    def found(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word codes (0: in no item) and offsets of texts; rows and places (in the codes) where seeds stand, with their numbers."""
        distinct, codes, offsets = split_words(col)
        words = [plain(w) for w in distinct.to_pylist()]
        known = np.array([-1 if not w else self.vocab.get(w, 0) for w in words], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        real = known >= 0
        if not real.all():  # words of marks alone don't count
            offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
            known = known[real]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        rows, places, seeds = [], [], []
        for n in {SEED_WORDS, *self.short()}:
            if len(known) < n:
                continue
            ok = np.ones(len(known) - n + 1, bool)
            for k in range(n):
                ok &= (known[k : len(known) - n + 1 + k] > 0) & (row[k : len(known) - n + 1 + k] == row[: len(known) - n + 1])
            at = np.flatnonzero(ok)
            if not len(at) or not len(self.seed):
                continue
            name = mix(known[at].astype(U64))
            for k in range(1, n):
                name = join2(name, known[at + k].astype(U64))
            j = np.minimum(np.searchsorted(self.seed, name), len(self.seed) - 1)
            hit = self.seed[j] == name
            rows.append(row[at[hit]])
            places.append(at[hit])
            seeds.append(j[hit])
        none = np.zeros(0, np.int64)
        return known, offsets, np.concatenate([none, *places]), np.concatenate([none, *seeds])


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of item against text (word codes), and the place in text where it ends."""
    n = len(text)
    ramp = np.arange(1, n + 1) * -GAP
    above, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        row = np.maximum(above[:-1] + np.where(text == w, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + ramp) - ramp  # gaps along the text
        above = np.concatenate(([0], row))
        top = int(row.argmax()) if n else 0
        if n and row[top] > best:
            best, end = int(row[top]), top
    return best, end


def reachable(item: np.ndarray, text: np.ndarray, threshold: float) -> bool:
    """Whether an alignment of item in text can score threshold of the item's own score.

    A score of 2m - e from m matches and e other steps needs m of threshold * len(item) at least, and
    spans m + e words of the text at most.
    """
    need = threshold * len(item)
    span = max(1, int(3 * len(item) - 2 * need))
    c = np.concatenate(([0], np.cumsum(np.isin(text, item))))
    most = c[-1] if len(text) <= span else (c[span:] - c[:-span]).max()
    return min(most, np.isin(item, text).sum()) >= need


def aligned(index: Index, col: pa.Array, threshold: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, score, first word, last word) of each item found in each text, words counted without those of marks alone."""
    known, offsets, places, seeds = index.found(col)
    if not len(places):
        return []
    row = np.searchsorted(offsets, places, side="right") - 1
    near: dict[tuple[int, int], list[int]] = {}
    for r, p, s in sorted(zip(row.tolist(), places.tolist(), seeds.tolist())):
        for i in index.of[s]:
            near.setdefault((r, i), []).append(p)
    out = []
    for (r, i), ps in near.items():
        item = index.items[i]
        reach = 2 * len(item)
        first, last, best = int(offsets[r]), int(offsets[r + 1]), (0, 0)
        start = None
        for p, after in zip(ps, [*ps[1:], None]):  # seeds within reach of each other share a stretch
            start = p if start is None else start
            if after is not None and after - p <= reach:
                continue
            a, b = max(first, start - reach), min(last, p + SEED_WORDS + reach)
            if reachable(item, known[a:b], threshold):
                score, end = align(item, known[a:b])
                if score > best[0]:
                    best = (score, a + end)
            start = None
        if best[0] and best[0] >= threshold * MATCH * len(item):
            out.append((r, i, best[0], max(0, best[1] - first - len(item) + 1), best[1] - first))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's items in blocks of bounded number and size, in order of id and text."""
    part, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("k"), F.col(text_col).alias("t")).filter("t is not null").distinct().orderBy("k", "t").toLocalIterator():
        if part and (len(part) >= BLOCK_ITEMS or size + len(r["t"]) > BLOCK_BYTES):
            yield part
            part, size = [], 0
        part.append((r["k"], r["t"]))
        size += len(r["t"])
    if part:
        yield part


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, score (share of the item's own), first_word, last_word for each item found in each row of docs.

    Null and empty texts and items match nothing; an item shorter than a seed is found by all its
    words. Repeated rows repeat their finds; of items repeated with one id and text one counts. Of
    places with one score the first counts; a score of just the threshold is a find. Null ids stay,
    others must be whole numbers; an empty table gives no rows; other columns don't matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item long, score double, first_word long, last_word long"
    out = None
    for block in blocks(benchmark, item_col, item_text_col):
        index = Index(block)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    got = aligned(index, part.column(1), threshold)
                    if got:
                        r, i, s, a, b = zip(*got)
                        share = [round(x / (MATCH * len(index.items[j])), 6) for x, j in zip(s, i)]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array([index.keys[j] for j in i], pa.int64()), pa.array(share), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["id", "item", "score", "first_word", "last_word"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark item is found, as `search` finds them; columns as they were, whatever their names.

    Null and empty texts hold none and stay, repeated rows stay or go together, an empty table or
    benchmark drops nothing. A score of just the threshold is a find. Texts are read whole. Every block
    of items is looked for in one pass over what the blocks before it left, in one plan.
    """
    for block in blocks(benchmark, item_col, item_text_col):
        index = Index(block)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    clean = np.ones(part.num_rows, bool)
                    clean[[x[0] for x in aligned(index, part.column(text_col), threshold)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
