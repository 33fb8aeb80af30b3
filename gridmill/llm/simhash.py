"""Near-duplicate groups by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 21, 21 and 22 bits. Of at most four differing
bits, some two segments hold at most two together (pigeonhole), split 0+2, 2+0 or 1+1 at worst.
For each two segments S and T a fingerprint is therefore filed under

* S as it is, with each Golay codeword within distance 4 of T (distance up to 2 shares one),
* the same with S and T exchanged,
* the nearest codewords of S and T, and in another role all codewords around both, with the
  parities of both segments (distance 1 in both: the parities differ, and the nearest codeword of
  one is among those around the other).

Fingerprints filed together are verified by their Hamming distance. Only distinct fingerprints take
part, so exact copies cost nothing. Files are dealt to buckets in numpy blobs; a bucket beyond
`BUCKET_ENTRIES` is split into pairs of blocks, so that no task holds more than two blocks and no
link is lost. Within a file, a search that takes each linked fingerprint out of the unvisited ones
gives star-shaped links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import golay
from gridmill.llm.common import U64, components, cut, map_text, mix, popcount, roots, texts

SEGMENTS = ((0, 21), (21, 21), (42, 22))
DISTANCE = 4
BUCKET_ENTRIES = 4_000_000
#: Distinct fingerprints for which one more bucket is opened.
BUCKET_PRINTS = 2_000

# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one text in UTF-8; a text without words has 0."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :]
    h = np.array([digest(line[a : b - 1], 42) for a, b in zip([0, *ends], last)], U64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        votes += np.unpackbits(h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id, fp (the 64 bits as a signed long), one row for each row of docs; null and blank texts have 0."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, shingle) for t in texts(part.column(1))], U64).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_text(rows, kernel, "id long, fp long", "text")


# ---------------------------------------------------------------- files


def files(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(file names, position of the fingerprint, role): role 0 links all, 1 and 2 link across."""
    seg = [((fp >> U64(a)) & U64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near, many = [golay.nearest(s) for s in seg], [golay.around(s) for s in seg]
    odd = [popcount(s) & 1 for s in seg]
    at = np.arange(len(fp))
    for k, (s, t) in enumerate(combinations(range(len(seg)), 2)):
        for j, (x, y) in enumerate(((s, t), (t, s))):
            for col in range(many[y].shape[1]):
                ok = many[y][:, col] >= 0
                yield name(6 * k + j, seg[x][ok], many[y][ok, col]), at[ok], 0
        parity = odd[s] * 2 + odd[t]
        yield name(6 * k + 2, near[s] * 4 + parity, near[t]), at, 1
        for c in range(many[s].shape[1]):
            for d in range(many[t].shape[1]):
                ok = (many[s][:, c] >= 0) & (many[t][:, d] >= 0)
                yield name(6 * k + 2, many[s][ok, c] * 4 + (3 - parity[ok]), many[t][ok, d]), at[ok], 2


def name(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((U64(kind) << U64(48)) | (a.astype(U64) << U64(24)) | b.astype(U64))


ENTRY = np.dtype([("file", "<u4"), ("role", "u1"), ("fp", "<u8")])


def dealt(prints: DataFrame, buckets: int, count_only: bool) -> DataFrame:
    """bucket, n and a blob of entries, for each Arrow batch of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False).view(U64)
                got = list(files(fp))
                names = np.concatenate([x[0] for x in got])
                of = (names >> U64(32)) % U64(buckets)
                order = np.argsort(of, kind="stable")
                e = np.empty(len(names), ENTRY)
                e["file"], e["role"] = (names & U64(0xFFFFFFFF))[order], np.concatenate([np.full(len(x[0]), x[2], np.uint8) for x in got])[order]
                e["fp"] = fp[np.concatenate([x[1] for x in got])][order]
                b, first, n = np.unique(of[order], return_index=True, return_counts=True)
                blobs = [None] * len(b) if count_only else [e[i : i + k].tobytes() for i, k in zip(first, n)]
                yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "n", "blob"])

    return prints.mapInArrow(run, "bucket long, n long, blob binary")


def links_in_file(fp: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions a, b of verified links of one file that connect all that its links connect."""
    out_a, out_b = [], []
    for left, right in ((0, 0), (1, 2)):
        p, q = np.flatnonzero(role == left), np.flatnonzero(role == right)
        if left != right:  # each of the smaller side against the other
            if len(p) > len(q):
                p, q = q, p
            for i in p:
                hit = q[(popcount(fp[q] ^ fp[i]) <= DISTANCE) & (fp[q] != fp[i])]
                out_a.append(np.full(len(hit), i))
                out_b.append(hit)
            continue
        rest = p
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                hit = popcount(fp[rest] ^ fp[i]) <= DISTANCE
                found = rest[hit]
                out_a.append(np.full(len(found), i))
                out_b.append(found)
                queue.extend(found)
                rest = rest[~hit]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, int), np.zeros(0, int))


#: Files up to this length are compared entry with entry, all files at once.
SHORT = 24


def links(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (fingerprints a, b) between entries, thinned to a spanning forest."""
    order = np.argsort(entries["file"], kind="stable")
    file, role, fp = entries["file"][order], entries["role"][order], entries["fp"][order]
    edge = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
    length = np.diff(np.concatenate((edge, [len(file)])))
    run = np.repeat(length, length)
    kept = (run > 1) & (run <= SHORT)
    f, r, p = file[kept], role[kept], fp[kept]
    out = []
    for d in range(1, SHORT):
        if len(f) <= d:
            break
        same = f[d:] == f[:-d]
        if not same.any():
            break
        i = np.flatnonzero(same)
        ra, rb = r[i], r[i + d]
        i = i[((ra == 0) & (rb == 0)) | ((ra + rb == 3) & (ra != rb) & (ra > 0))]
        x = p[i] ^ p[i + d]
        i = i[(x != 0) & (popcount(x) <= DISTANCE)]
        out.append((p[i], p[i + d]))
    for s, n in zip(edge[length > SHORT], length[length > SHORT]):
        a, b = links_in_file(fp[s : s + n], role[s : s + n])
        out.append((fp[s + a], fp[s + b]))
    if not out:
        return np.zeros(0, U64), np.zeros(0, U64)
    a, b = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    top = roots(len(nodes), at[: len(a)], at[len(a) :])
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[below], nodes[top[below]]


def near_links(prints: DataFrame, n_prints: int) -> DataFrame:
    """Links (a long, b long) among distinct fingerprints; they connect exactly what all links within DISTANCE connect."""
    spark = prints.sparkSession
    buckets = max(64, n_prints // BUCKET_PRINTS)
    counted = dealt(prints, buckets, True).groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > BUCKET_ENTRIES)
    hot = {r["bucket"]: -(-r["n"] // (BUCKET_ENTRIES // 2)) for r in counted.toLocalIterator()}
    blobs = dealt(prints, buckets, False).select(F.col("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), "blob")
    if hot:
        blobs = split_hot(blobs, hot)

    def verify(table: pa.Table) -> pa.Table:
        a, b = links(np.concatenate([np.frombuffer(x.as_py(), ENTRY) for x in table.column("blob")]))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return blobs.groupBy("bucket", "i", "j").applyInArrow(verify, "a long, b long")


def split_hot(blobs: DataFrame, hot: dict[int, int]) -> DataFrame:
    """Entries of hot buckets go to every pair of blocks (i, j) that holds their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                k = hot.get(bucket)
                if not k:
                    rows.append((bucket, 0, 0, blob))
                    continue
                e = np.frombuffer(blob, ENTRY)
                block = (mix(e["fp"]) % U64(k)).astype(int)
                for own in range(k):
                    part = e[block == own].tobytes()
                    rows += [(bucket, min(own, o), max(own, o), part) for o in range(k)] if part else []
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["bucket", "i", "j", "blob"])

    return blobs.mapInArrow(run, "bucket long, i int, j int, blob binary")


# ---------------------------------------------------------------- groups


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id, fp, component_id (the smallest id reachable, itself included), a row for each row of docs.

    Null ids stay null and are passed over as smallest id; a group of null ids alone has null.
    Rows repeated with one id take part as they stand. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    comp = components(near_links(distinct.select("fp"), distinct.count()))
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).repartition(F.xxhash64("root"))
    label = cut(named.join(least, "root").select("fp", "component_id"))
    return prints.join(label, "fp").select("id", "fp", "component_id")
