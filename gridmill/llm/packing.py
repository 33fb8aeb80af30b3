"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

Each task packs its own rows as they stream by, so nothing is shuffled and no row is held back.
Whole windows are cut from long documents first. What is left of each document, in pieces of at
most `PIECE` tokens, is gathered until it fills `BATCH_WINDOWS` windows; differencing then merges
partial partitions whose imbalances oppose each other until one partition into near-equal windows
is left. If a window exceeds the capacity, the number of windows rises and the batch is packed
anew. Memory is bounded by one batch and the document at hand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import slices
from gridmill.llm.tokens import encoder

WINDOW = 1024
PIECE = 256
BATCH_WINDOWS = 128
#: Pieces of a batch at most, as differencing takes pieces times windows of memory.
BATCH_PIECES = 8192
SLICE = 4 << 20

SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: np.ndarray, bins: int) -> np.ndarray:
    """Karmarkar-Karp: the bin of each item, for near-equal sums. Deterministic; ties go by item number."""
    n = len(sizes)
    if bins == 1:
        return np.zeros(n, np.int64)
    first = np.zeros((n, bins), np.int64)
    first[:, 0] = sizes
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums = {i: first[i] for i in range(n)}  # each falling, least taken off
    merged: list[tuple[int, int, int, np.ndarray]] = []
    node = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        merged.append((node, a, b, order))
        sums[node] = total - total[-1]
        heapq.heappush(heap, (-int(sums[node][0]), node))
        node += 1
    at = {heap[0][1]: np.arange(bins)}  # final bin of each node's bins
    for top, a, b, order in reversed(merged):
        place = np.empty(bins, np.int64)
        place[order] = at.pop(top)
        at[a], at[b] = place, place[::-1]
    return np.array([at[i][0] for i in range(n)])


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Window of each piece, and their number, which rises until no window exceeds the capacity."""
    bins = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        place = difference(sizes, bins)
        if np.bincount(place, sizes, bins).max() <= capacity:
            return place, bins
        bins += max(1, bins // 256)


class Packer:
    """Takes documents one by one and gives rows of SCHEMA; sequence ids count from `base`."""

    def __init__(self, base: int, window: int = WINDOW, piece: int = PIECE, batch: int = BATCH_WINDOWS) -> None:
        self.base, self.window, self.piece, self.batch = base, window, piece, batch
        self.rows: list[tuple] = []
        self.open: list[tuple] = []
        self.held = 0

    def add(self, key: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.window
        for s in range(0, whole, self.window):
            self.rows.append((key, s, self.window, ids[4 * s : 4 * (s + self.window)], n, self.base, 0))
            self.base += 1
        rest = n - whole
        if rest:
            parts = -(-rest // self.piece)
            cuts = [whole + rest * i // parts for i in range(parts + 1)]
            self.open += [(key, a, b - a, ids[4 * a : 4 * b], n) for a, b in zip(cuts, cuts[1:])]
            self.held += rest
            if self.held >= self.batch * self.window or len(self.open) >= BATCH_PIECES:
                self.flush()

    def flush(self) -> None:
        if self.open:
            place, bins = windows(np.array([p[2] for p in self.open]), self.window)
            used = [0] * bins
            for p, w in zip(self.open, place.tolist()):
                self.rows.append((*p, self.base + w, used[w]))
                used[w] += p[2]
            self.base += bins
            self.open, self.held = [], 0

    def take(self) -> pa.RecordBatch:
        cols, self.rows = list(zip(*self.rows)) or [()] * 7, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: id, start, length, ids, doc_tokens, sequence_id, offset.

    `ids` holds little-endian unsigned 32-bit token ids; each document ends with `end_id`. A null or
    empty text is that id alone. Null ids stay null, others must be whole numbers; repeated rows are
    packed as often as they occur; an empty table gives no pieces; other columns don't matter.
    Differencing breaks ties by the order of pieces. Sequence ids are unique, not consecutive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = enc.encode_column(part.column(1))
                for key, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    packer.add(key, ids[a:b].tobytes() + end)
                    if len(packer.rows) >= 4096:
                        yield packer.take()
        packer.flush()
        yield packer.take()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
