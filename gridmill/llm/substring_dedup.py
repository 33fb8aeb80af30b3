"""Removal of long repeated passages by recompression.

A window is `WINDOW` consecutive words of one document. Words covered by a window that also starts
anywhere else are removed.

Every text is recompressed in locally consistent rounds with global names: runs of two or three
equal words get a name, then twice adjacent pairs, chosen by one bit of each symbol's hash, get one.
Names are hashes of what they stand for, so equal substrings get equal symbols without any exchange,
but for a margin at both ends: a round loses a run of three words, a symbol of three and one of
four at most, so each window keeps 35 - 2 * 10 = 15 words of symbols that are the same wherever it
stands. A symbol spans eight words at most; a chain of symbols from the first one kept until eight
words are covered therefore lies in those 15 words. So windows that occur twice share a chain.

1. Names of chains are counted in buckets of names; those found twice go back to their documents.
2. Windows around such chains are named by 96 bits of all their words and counted the same way.
3. Windows found twice mark the words to remove.

Documents are dealt once to groups by their place in the input, so rows repeated with one id and text
spread like any others. A group sends each name twice at most, so a passage in a third of all
documents comes to a bucket once or twice a group. A blob holds what one group sends to one bucket:
to keep blobs large, groups and buckets grow in size with the input (up to `MOST_BYTES`) before they
grow in number; at a terabyte some 16,000 of either give blobs of a few kilobytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import U64, join2, mix, slices, split_words, text_bytes

WINDOW = 35
CHAIN = 8
CAPS = (4, 8)
#: Bytes of scanned table for which one more group of documents, or bucket of names, is opened in a small input; in a large one a PARTS-th of it, MOST_BYTES at most.
GROUP_BYTES, BUCKET_BYTES = 6_000_000, 6_000_000
PARTS, MOST_BYTES = 2_000, 64_000_000

LOW = U64(0xFFFFFFFF)
NAME96 = np.dtype([("hi", "<u8"), ("lo", "<u4")])


class Text:
    """Words of some texts: names, row of each word, offsets of rows."""

    def __init__(self, col: pa.Array) -> None:
        self.distinct, self.codes, self.offsets = split_words(col)
        raw = self.distinct.cast(pa.binary()).to_pylist()
        names = np.array([xxhash.xxh3_64_intdigest(w) for w in raw], U64)
        self.names = names[self.codes] if len(self.codes) else np.zeros(0, U64)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def only(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, rows and places of the words of rows where the mask is set."""
        at = np.flatnonzero(rows[self.row])
        return self.names[at], self.row[at], at


def symbols(names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recompressed symbols: names, first word, number of words."""
    n = len(names)
    if n == 0:
        return names, np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate(([True], (names[1:] != names[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(edge)
    length = np.diff(np.concatenate((first, [n])))
    short = np.repeat((length == 2) | (length == 3), length)
    keep = ~short | edge
    at = np.flatnonzero(keep)
    size = np.where(short[at], np.repeat(length, length)[at], 1)
    sym = np.where(size > 1, join2(names[at], size.astype(U64)), names[at])
    for turn, cap in enumerate(CAPS):
        left = (mix(sym + U64(turn + 1)) >> U64(63)) == 1
        r = row[at]
        pair = np.zeros(len(sym), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (r[:-1] == r[1:]) & (size[:-1] + size[1:] <= cap)
        i = np.flatnonzero(pair)
        sym = sym.copy()
        sym[i] = join2(sym[i], sym[i + 1])
        size[i] += size[i + 1]
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        sym, at, size = sym[keep], at[keep], size[keep]
    return sym, at, size


def chains(names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of symbols that cover CHAIN words: names, first word, end (exclusive)."""
    sym, at, size = symbols(names, row)
    total, name, open_ = size.copy(), sym.copy(), np.flatnonzero(size < CHAIN)
    r = row[at]
    whole = np.ones(len(sym), bool)
    for k in range(1, CHAIN):
        if not len(open_):
            break
        last = (open_ + k >= len(sym)) | (r[np.minimum(open_ + k, len(sym) - 1)] != r[open_])
        whole[open_[last]] = False
        open_ = open_[~last]
        name[open_] = join2(name[open_], sym[open_ + k])
        total[open_] += size[open_ + k]
        open_ = open_[total[open_] < CHAIN]
    i = np.flatnonzero(whole)
    return name[i], at[i], at[i] + total[i]


def window_names(names: np.ndarray, seed: int) -> np.ndarray:
    """Names of all runs of WINDOW words, by doubling; rows don't matter here."""
    if len(names) < WINDOW:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        level = mix(names ^ U64(seed))
    n, span, at, out = len(names) - WINDOW + 1, 1, 0, None
    for bit in range(WINDOW.bit_length()):
        if WINDOW >> bit & 1:
            part = level[at : at + n]
            out = part if out is None else join2(out, part)
            at += span
        if span * 2 <= WINDOW:
            level = join2(level[:-span], level[span:])
            span *= 2
    return out


def twice_at_most(sorted_names: np.ndarray) -> np.ndarray:
    """A sorted array without third and later copies."""
    if len(sorted_names) < 3:
        return sorted_names
    return sorted_names[np.concatenate(([True, True], sorted_names[2:] != sorted_names[:-2]))]


def dealt(codes: np.ndarray, of: np.ndarray, group: int) -> pa.Table:
    """Rows (bucket, group, blob) of names that are sorted by bucket."""
    bucket, first, n = np.unique(of, return_index=True, return_counts=True)
    return pa.table({"part": pa.array(bucket.astype(np.int64)), "grp": pa.array(np.full(len(bucket), group, np.int64)), "blob": pa.array([codes[i : i + k].tobytes() for i, k in zip(first, n)], pa.binary())})


SENT = "part long, grp long, blob binary"


def sent_chains(table: pa.Table, buckets: int) -> pa.Table:
    """Names of a group's chains, 32 bits within their bucket: what they miss is told apart later."""
    group, found = table.column("grp")[0].as_py(), []
    for col in columns(table):
        t = Text(col)
        long = np.diff(t.offsets) >= WINDOW
        names, row, _ = t.only(long)
        found.append(code(chains(names, row)[0], buckets))
    codes = twice_at_most(np.sort(np.concatenate(found)))
    return dealt((codes & LOW).astype("<u4"), codes >> U64(32), group)


def code(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> U64(32)) % U64(buckets) << U64(32)) | (names & LOW)


def columns(table: pa.Table):
    for batch in table.combine_chunks().to_batches():
        for part in slices(batch, "text"):
            yield part.column("text")


def returned(dtype):
    """A kernel over a bucket: names that came twice go back to the groups they came from."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("part")[0].as_py()
        blobs = [np.frombuffer(b.as_py(), dtype) for b in table.column("blob")]
        names = np.concatenate(blobs)
        group = np.repeat(table.column("grp").to_numpy(), [len(b) for b in blobs])
        order = np.lexsort((names["lo"], names["hi"])) if names.dtype.names else np.argsort(names, kind="stable")
        names, group = names[order], group[order]
        same = names[1:] == names[:-1]
        hit = np.concatenate((same, [False])) | np.concatenate(([False], same))
        names, group = names[hit], group[hit]
        order = np.argsort(group, kind="stable")
        names, group = names[order], group[order]
        of, first, n = np.unique(group, return_index=True, return_counts=True)
        return pa.table({"grp": pa.array(of.astype(np.int64)), "part": pa.array(np.full(len(of), bucket, np.int64)), "blob": pa.array([names[i : i + k].tobytes() for i, k in zip(first, n)], pa.binary())})

    return run


RETURNED = "grp long, part long, blob binary"


def sent_windows(table: pa.Table, hits: pa.Table, buckets: int, window_buckets: int) -> pa.Table:
    """Names of a group's windows that hold a chain found twice."""
    none = pa.table({"part": pa.array([], pa.int64()), "grp": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    if not table.num_rows or not hits.num_rows:
        return none
    group = table.column("grp")[0].as_py()
    known = np.sort(np.concatenate([np.frombuffer(b.as_py(), "<u4").astype(U64) | U64(p) << U64(32) for p, b in zip(hits.column("part").to_pylist(), hits.column("blob"))]))
    found = []
    for col in columns(table):
        t = Text(col)
        names, row, at = t.only(np.diff(t.offsets) >= WINDOW)
        name, start, end = chains(names, row)
        hit = member(code(name, buckets), known)
        if not hit.any():
            continue
        start, end, r = at[start[hit]], at[end[hit] - 1] + 1, row[start[hit]]
        lo, hi = np.maximum(t.offsets[r], end - WINDOW), np.minimum(start, t.offsets[r + 1] - WINDOW)
        some = lo <= hi
        marks = np.zeros(len(t.names) + 1, np.int64)
        np.add.at(marks, lo[some], 1)
        np.add.at(marks, hi[some] + 1, -1)
        wanted = np.cumsum(marks)[:-1] > 0
        rows = np.zeros(len(t.offsets) - 1, bool)
        rows[r] = True
        names, row, at = t.only(rows)
        w = np.empty(max(0, len(names) - WINDOW + 1), NAME96)
        w["hi"], w["lo"] = window_names(names, 1), window_names(names, 2).astype("<u4")
        found.append(w[wanted[at[: len(w)]]])
    if not found:
        return none
    w = np.concatenate(found)
    of = w["hi"] % U64(window_buckets)
    order = np.lexsort((w["lo"], w["hi"], of))
    w = twice_at_most(w[order])
    return dealt(w, w["hi"] % U64(window_buckets), group)


def member(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(names), bool)
    return known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names


def kept(table: pa.Table, hits: pa.Table) -> pa.Table:
    """Each of a group's texts without the words of windows found twice."""
    if not table.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
    known = np.concatenate([np.frombuffer(b.as_py(), NAME96) for b in hits.column("blob")]) if hits.num_rows else np.zeros(0, NAME96)
    both = {(int(h) << 32) | int(x) for h, x in zip(known["hi"], known["lo"])}
    high = np.sort(known["hi"])
    n_words, n_removed, out = [], [], []
    for col in columns(table):
        t = Text(col)
        gone = np.zeros(len(t.names) + 1, np.int64)
        if len(high):
            hi = window_names(t.names, 1)
            inside = t.row[: len(hi)] == t.row[WINDOW - 1 :] if len(hi) else np.zeros(0, bool)
            at = np.flatnonzero(member(hi, high) & inside)
            if len(at):
                lo = (window_names(t.names, 2) & LOW)[at]
                at = at[[((int(h) << 32) | int(x)) in both for h, x in zip(hi[at], lo)]]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WINDOW, -1)
        gone = np.cumsum(gone)[:-1] > 0
        n_words += np.diff(t.offsets).tolist()
        removed = np.bincount(t.row, gone, len(t.offsets) - 1).astype(np.int64)
        n_removed += removed.tolist()
        words = t.distinct.to_pylist()
        codes, stay = t.codes.tolist(), ~gone
        for i, (a, b) in enumerate(zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist())):
            if removed[i]:
                out.append(" ".join([words[c] for c in t.codes[a:b][stay[a:b]].tolist()]))
            else:
                out.append(" ".join([words[c] for c in codes[a:b]]))
    return pa.table({"id": table.column("id").combine_chunks(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(out, pa.string())})


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by blanks), a row for each row of docs.

    Null texts have no words. Null ids stay null, others must be whole numbers. Rows repeated with one
    id and text count as often as they occur, so their windows are found twice. An empty table gives
    no rows; other columns don't matter. docs should come from a scan or a checkpoint, whose rows keep
    their places when a task is run again.
    """
    size = text_bytes(docs, text_col)
    groups, buckets = (max(16, size // min(MOST_BYTES, max(least, size // PARTS))) for least in (GROUP_BYTES, BUCKET_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("grp"), "id", "text")
    sent = rows.groupBy("grp").applyInArrow(lambda t: sent_chains(t, buckets), SENT)
    hits = sent.groupBy("part").applyInArrow(returned(np.dtype("<u4")), RETURNED)
    windows = rows.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(lambda t, h: sent_windows(t, h, buckets, buckets), SENT)
    found = windows.groupBy("part").applyInArrow(returned(NAME96), RETURNED)
    return rows.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(kept, "id long, n_words long, n_removed long, kept string")
