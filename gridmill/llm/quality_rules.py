"""Quality rules and a likelihood-ratio test on hashed n-grams.

Words and word pairs are hashed to `BUCKETS` cells. Two multinomials with additive smoothing are
counted: one over all trusted documents (label 1), one over all documents. A document's verdict is
its mean log-likelihood ratio a feature against a fixed threshold; a document without features has
ratio 0.

Both counts are added up in each task before `BUCKETS` rows of it are shuffled. To count trusted
documents only those whose ids may be trusted, by a set of bits of fixed size, are joined with the
labels, so texts that nobody labelled stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import U64, bits_of, in_bits, join2, mix, slices, split_words, texts

BUCKETS = 8192
SMOOTHING = 1.0
#: Mean log-likelihood ratio a feature below which a document is rejected.
THRESHOLD = -0.05

SYMBOLS = b"#*$%&|<>"


@dataclass
class Words:
    """The words of some texts, hashed."""

    names: np.ndarray  # of each word
    row: np.ndarray  # of each word
    offsets: np.ndarray
    chars: np.ndarray  # code points of each word


def hashed(col: pa.Array) -> Words:
    distinct, codes, offsets = split_words(col)
    raw = distinct.cast(pa.binary()).to_pylist()
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in raw], U64)
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return Words(names[codes] if len(codes) else np.zeros(0, U64), row, offsets, chars[codes] if len(codes) else np.zeros(0, np.int64))


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all words and word pairs, and their rows."""
    pair = w.row[1:] == w.row[:-1]
    both = join2(w.names[:-1], w.names[1:])[pair]
    cells = np.concatenate((mix(w.names), both)) % U64(BUCKETS)
    return cells.astype(np.int64), np.concatenate((w.row, w.row[1:][pair]))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """id of each document with a label 1."""
    return labels.filter((F.col(quality_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()


def cell_counts(rows: DataFrame) -> DataFrame:
    """cell, n: features of a column of texts; each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                n += np.bincount(features(hashed(part.column(0)))[0], minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cell": some.astype(np.int32), "n": n[some]})

    return rows.select("text").mapInArrow(run, "cell int, n long")


def counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features a cell over trusted and over all documents."""
    words = bits_of(trusted)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bits(words, batch.column(0).to_numpy(zero_copy_only=False))))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen = rows.filter("id is not null").mapInArrow(some, "id long, text string").join(trusted, "id", "left_semi")
    both = cell_counts(chosen).withColumn("trusted", F.lit(True)).unionAll(cell_counts(rows).withColumn("trusted", F.lit(False)))
    good, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in both.groupBy("cell", "trusted").agg(F.sum("n").alias("n")).collect():  # 2 * BUCKETS rows at most
        (good if r["trusted"] else raw)[r["cell"]] = r["n"]
    return good, raw


def ratios(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each cell, rounded so that sums are the same in any order of tasks."""
    p, q = good + SMOOTHING, raw + SMOOTHING
    return np.round(np.log(p / p.sum()) - np.log(q / q.sum()), 9)


def judged(part_texts: pa.Array, ratio: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Base figures and verdict for each of some texts."""
    w = hashed(part_texts)
    n = len(w.offsets) - 1
    n_words = np.diff(w.offsets)
    out = {"n_words": n_words, "word_chars": np.bincount(w.row, w.chars, n).astype(np.int64)}
    # 5-word windows found twice or more in their text
    repeat = np.zeros(len(w.row), bool)
    if len(w.row) >= 5:
        name = w.names[:-4]
        for k in range(1, 5):
            name = join2(name, w.names[k : len(w.names) - 4 + k])
        inside = w.row[:-4] == w.row[4:]
        at = np.flatnonzero(inside)
        key = join2(name[at], w.row[at].astype(U64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for k in range(5):
            repeat[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(w.row, repeat, n).astype(np.int64)
    raw = texts(part_texts)
    out["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in raw], np.int64)
    out["n_dup_lines"] = np.array([duplicate_lines(t) for t in raw], np.int64)
    cells, row = features(w)
    n_features = np.bincount(row, minlength=n)
    out["llr"] = np.round(np.bincount(row, ratio[cells], n) / np.maximum(n_features, 1), 6)
    out["base_failed"] = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
    return out


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


SCHEMA = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Base figures, mean log-likelihood ratio and verdict for each row of docs.

    Null texts count as empty: no words, base_failed. Null ids stay null and are never trusted; ids
    must be whole numbers. All rows of a trusted id count; an id labelled twice, once with 1, is
    trusted. Without trusted features every ratio is 0, so only the base rules reject. An empty
    table gives no rows. Other columns don't matter.
    """
    good, raw = counts(docs, trusted_ids(labels, label_id_col, quality_col), id_col, text_col)
    ratio = ratios(good, raw) if good.sum() else np.zeros(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = judged(part.column(1), ratio, threshold)
                names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c]) for c in names)], ["id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
