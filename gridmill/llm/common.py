"""What several operators of this subpackage share: the shared folder, Arrow kernels over text, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.shared import fresh, shared_folder

#: Bytes of text that a kernel takes at once; a single longer text is taken alone.
SLICE_BYTES = 4 << 20

U64 = np.uint64


# ---------------------------------------------------------------- the shared folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    return fresh(spark, name)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes behind a DataFrame; costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(df: DataFrame, text: str) -> int:
    """About the bytes of the table that holds the texts; counted where the optimizer can't tell."""
    guess = scan_bytes(df)
    if guess < 1 << 50:
        return guess
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2


# ---------------------------------------------------------------- Arrow kernels


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most `limit` bytes of text, or one row."""
    n = batch.num_rows
    if n == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start, done = end, int(size[end - 1])


def map_text(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str) -> DataFrame:
    """Runs a kernel over slices of the rows; it returns any number of rows of `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield kernel(part)

    return df.mapInArrow(run, schema)


def texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return pc.fill_null(col, "").cast(pa.binary()).to_pylist()


def split_words(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of a column of texts: distinct words, code of each word, offsets of rows."""
    lists = pc.ascii_split_whitespace(pc.fill_null(col, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    if not mask.all():
        offsets = np.concatenate(([0], np.cumsum(mask)))[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


# ---------------------------------------------------------------- sets of keys as bits

#: A set of keys has this many words of 64 bits, whatever the input: 2 MB.
FILTER_WORDS = 1 << 18


def bit_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of keys (long) in a set of bits."""
    m = mix(keys.view(U64))
    return (m % U64(FILTER_WORDS)).astype(np.int64), m >> U64(58)


def bits_of(keys: DataFrame) -> np.ndarray:
    """A set of bits of a DataFrame's only column (long, not null): every key is in it, and some others."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = bit_of(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((U64(1) << bit).view(np.int64))], ["word", "bit"])

    got = keys.mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(FILTER_WORDS, U64)  # at most so many rows come to the driver
    words[got.column("word").to_numpy()] = got.column("bit").to_numpy().view(U64)
    return words


def in_bits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, bit = bit_of(keys)
    return (words[word] >> bit & U64(1)).astype(bool)


# ---------------------------------------------------------------- 64-bit mixing


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection on 64 bits."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for the ordered pair (a, b)."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0x9FB21C651E98DF25) + mix(b))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


# ---------------------------------------------------------------- union-find in numpy


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


# ---------------------------------------------------------------- components in Spark


#: Edges for which one more partition is opened; without this, rounds over few edges write files for every shuffle partition.
PART_EDGES = 50_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): node, root (the component's smallest node).

    Alternating large-star and small-star rounds (Kiveris et al., 2014) on DataFrames: each is an
    aggregation with map-side combine and a join that skew splitting covers. Every round is cut by
    a checkpoint, so a lost executor costs one round at most. What rounds pass on is put together into
    partitions by the number of edges. Nodes without edges are not returned.
    """

    def star(e: DataFrame, large: bool, parts: int) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e
        # dealt anew, so that the join has exchanges of its own on both sides and a hub's edges can be split
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(parts).repartition(F.xxhash64("a"))
        out = both.join(least, "a").coalesce(parts)
        if large:
            return out.filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = out.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.coalesce(parts).filter("m <> a").select("a", F.col("m").alias("b"))
        return linked.union(own).distinct().coalesce(parts)

    found = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut(found), None
    parts = max(8, e.count() // PART_EDGES)
    e = e.coalesce(parts)
    for _ in range(rounds):
        e = cut(star(star(e, True, parts), False, parts))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().coalesce(parts))
        before = now
    raise RuntimeError(f"components: no fixed point after {rounds} rounds")
