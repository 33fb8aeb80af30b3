"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of `CHUNK` bytes, each `STEP` after the one before, so
that chunks overlap and cover the whole document. Each byte has a learned embedding; `FILTERS`
learned filters of `WIDTH` bytes run over each chunk every `STRIDE` bytes; each filter's largest
and mean response over the chunk are pooled over all chunks (mean and largest), and one logistic
unit combines them into the probability of label 1.

Fitted by Adam on whole texts of a bounded sample of labelled rows: at most `FIT_ROWS` ids, those
with the least hashes, and of these, in that order, each whose text still fits into `FIT_BYTES` in
all. Scoring takes every chunk of every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import slices, texts

CHUNK, STEP = 512, 448
WIDTH, STRIDE = 8, 4
EMBED, FILTERS = 8, 24
FIT_ROWS, FIT_BYTES = 2_000, 8 << 20
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Chunks that one step of a kernel takes.
BLOCK = 256
PAD = 256
SEED = 7

PLACES = (CHUNK - WIDTH) // STRIDE + 1


def n_chunks(size: int) -> int:
    return max(1, -(-(size - CHUNK) // STEP) + 1)


def chunked(data: bytes) -> np.ndarray:
    """Chunks (rows of CHUNK byte values; PAD fills a short last one), as a view of two bytes a byte of text."""
    n = n_chunks(len(data))
    full = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    full[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(full, (n, CHUNK), (STEP * full.itemsize, full.itemsize))


def blocks(many: list[bytes]) -> Iterator[np.ndarray]:
    """All chunks of some texts, one after another, BLOCK at a time."""
    held, size = [], 0
    for data in many:
        view = chunked(data)
        at = 0
        while at < len(view):
            part = view[at : at + BLOCK - size]
            held.append(part)
            size += len(part)
            at += len(part)
            if size == BLOCK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


@dataclass
class Net:
    embed: np.ndarray  # 257 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 4 * FILTERS
    shift: float

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of embedded bytes (a row each), and each filter's response at each place of each chunk."""
        x = self.embed[chunks]
        s = x.strides
        windows = np.lib.stride_tricks.as_strided(x, (len(x), PLACES, WIDTH * EMBED), (s[0], STRIDE * s[1], s[2])).reshape(-1, WIDTH * EMBED)
        r = windows @ self.filters
        r += self.bias
        return windows, np.maximum(r, 0, out=r).reshape(len(x), PLACES, FILTERS)

    def pooled(self, many: list[bytes]) -> np.ndarray:
        """Each chunk's largest and mean response of each filter, chunks of all texts one after another."""
        out = [np.zeros((0, 2 * FILTERS), np.float32)]
        for chunks in blocks(many):
            r = self.responses(chunks)[1]
            out.append(np.concatenate((r.max(1), r.mean(1)), 1))
        return np.concatenate(out)

    def scores(self, many: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text, to six places."""
        if not many:
            return np.zeros(0)
        n = np.array([n_chunks(len(d)) for d in many])
        p, starts = self.pooled(many), np.concatenate(([0], np.cumsum(n)))[:-1]
        z = np.concatenate((np.add.reduceat(p.astype(np.float64), starts) / n[:, None], np.maximum.reduceat(p, starts)), 1) @ self.out.astype(np.float64) + self.shift
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def fit(samples: list[tuple[bytes, int]], epochs: int = EPOCHS) -> Net:
    """Fits on (text, label); both classes weigh the same. Without both labels the score is constant."""
    rng = np.random.default_rng(SEED)
    net = Net(
        (rng.normal(size=(257, EMBED)) * 0.5).astype(np.float32),
        (rng.normal(size=(WIDTH * EMBED, FILTERS)) * (2 / (WIDTH * EMBED)) ** 0.5).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        (rng.normal(size=4 * FILTERS) * 0.05).astype(np.float32),
        0.0,
    )
    y = np.array([q for _, q in samples], np.float32)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.shift = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    shift = np.zeros(1, np.float32)
    params = [net.embed, net.filters, net.bias, net.out, shift]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            grads = gradients(net, shift[0], [samples[i][0] for i in at], y[at], weight[at])
            t += 1
            rate = RATE * (1 - 0.9 * (epoch / epochs))
            for q, d, a, b in zip(params, grads, m, v):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                q -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net.shift = float(shift[0])
    return net


def gradients(net: Net, shift: float, many: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the embedding, filters, bias, unit and shift over some texts; responses to many chunks are made anew, block by block."""
    n = np.array([n_chunks(len(d)) for d in many])
    starts = np.concatenate(([0], np.cumsum(n)))[:-1]
    doc = np.repeat(np.arange(len(many)), n)
    held = None
    if n.sum() <= BLOCK:  # the usual case: one block, whose responses are kept
        held = net.responses(next(blocks(many)))
        p = np.concatenate((held[1].max(1), held[1].mean(1)), 1)
    else:
        p = net.pooled(many)
    mean, most = np.add.reduceat(p, starts) / n[:, None].astype(np.float32), np.maximum.reduceat(p, starts)
    f = np.concatenate((mean, most), 1)
    prob = 1 / (1 + np.exp(-np.clip(f @ net.out + shift, -30, 30)))
    dz = ((prob - y) * weight / len(many)).astype(np.float32)
    df = dz[:, None] * net.out
    hit = p == most[doc]
    times = np.cumsum(hit, 0)
    hit &= times - (times[starts] - hit[starts])[doc] == 1  # of chunks with the same largest response the first one
    dp = df[doc, : 2 * FILTERS] / n[doc, None].astype(np.float32) + df[doc, 2 * FILTERS :] * hit
    demb, dfilters, dbias = np.zeros((PAD + 1, EMBED), np.float32), np.zeros_like(net.filters), np.zeros(FILTERS, np.float32)
    lo = 0
    for chunks in blocks(many):
        k = len(chunks)
        windows, r = held or net.responses(chunks)
        g = np.repeat(dp[lo : lo + k, None, FILTERS:] / PLACES, PLACES, 1)
        top = r.argmax(1)
        g[np.arange(k)[:, None], top, np.arange(FILTERS)] += dp[lo : lo + k, :FILTERS]
        g *= r > 0
        flat = g.reshape(-1, FILTERS)
        dfilters += windows.T @ flat
        dbias += flat.sum(0)
        du = (flat @ net.filters.T).reshape(k, PLACES, WIDTH, EMBED)
        dx = np.zeros((k, CHUNK, EMBED), np.float32)
        for w in range(WIDTH):
            dx[:, w : w + STRIDE * PLACES : STRIDE] += du[:, :, w]
        code = chunks.reshape(-1)
        for e in range(EMBED):
            demb[:, e] += np.bincount(code, dx[:, :, e].reshape(-1), PAD + 1)
        lo += k
    return [demb, dfilters, dbias, f.T @ dz + 1e-4 * net.out, np.array([dz.sum()], np.float32)]


def is_held_out(key: int | None) -> bool:
    """Rows with this never teach: crc32 of the id as text leaves 1 modulo 3."""
    return key is not None and zlib.crc32(str(key).encode()) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, quality_col: str, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> list[tuple[bytes, int]]:
    """Whole texts that may teach, with their labels: of `rows` ids with the least hashes those that fit into `size` bytes, in that order.

    Only ids are sorted; the driver gets lengths of at most `rows` texts first, and then at most
    `size` bytes. Of several texts with one id the least counts, of several labels the largest.
    """
    mark = labels.filter(F.col(id_col).isNotNull() & F.col(quality_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("gm_id")).agg(F.max(quality_col).alias("gm_q"))
    mark = mark.filter(F.crc32(F.col("gm_id").cast("string").cast("binary")) % 3 != 1)
    texts_of = docs.select(F.col(id_col).cast("long").alias("gm_id"), F.coalesce(F.col(text_col), F.lit("")).alias("gm_text"))
    few = mark.orderBy(F.xxhash64("gm_id"), "gm_id").limit(rows)  # `rows` pairs of numbers at most
    once = texts_of.join(F.broadcast(few), "gm_id").groupBy("gm_id", "gm_q").agg(F.min("gm_text").alias("gm_text"))
    lengths = once.select("gm_id", F.xxhash64("gm_id").alias("h"), F.octet_length("gm_text").alias("n")).collect()
    chosen, used = [], 0
    for r in sorted(lengths, key=lambda r: (r["h"], r["gm_id"])):
        if used + r["n"] <= size:
            chosen.append((r["gm_id"], len(chosen)))
            used += r["n"]
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, "gm_id long, k int")
    got = once.join(F.broadcast(wanted), "gm_id").select("k", F.col("gm_text").cast("binary").alias("data"), "gm_q").toArrow().sort_by("k")
    return list(zip(got.column("data").to_pylist(), got.column("gm_q").to_pylist()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Net:
    """The network fitted on a bounded sample of labelled rows.

    Null ids and labels other than 0 and 1 teach nothing; a null text counts as empty; rows repeated
    with one id teach once. Without both labels the score is constant (0.5 without any). `id_col`
    names the ids of both tables; other columns of either don't matter.
    """
    return fit(sample(docs, labels, id_col, text_col, quality_col, rows, size))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row of docs.

    Null and empty texts get the score of one padded chunk. Null ids stay null and are not held out.
    Repeated rows repeat their scores; an empty table gives none. At a score of 0.5 a row is predicted 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                s = net.scores(texts(part.column(1)))
                held = [is_held_out(k) for k in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, net: Net, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, a tie included, by the same score as `score` gives; columns as they were.

    Null texts count as empty, repeated rows stay or go together, an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                yield part.filter(pa.array(net.scores(texts(part.column(text_col))) >= least))

    return docs.mapInArrow(run, docs.schema)
