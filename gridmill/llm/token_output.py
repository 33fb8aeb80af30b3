"""Token ids in seekable binary files: independent zstandard frames and a trailing seek table.

A file holds, in this order:

* data frames, each an independent zstandard frame with content checksum: token ids as little-endian
  unsigned 32-bit integers, of some whole documents, or a part of one that is longer than a frame;
* a skippable frame (magic 0x184D2A50) with the document table: for each document its id, a flag
  for a null id, and its number of tokens;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public zstandard seekable
  format: for each data frame its compressed size, its size and the low 32 bits of its XXH64.

Any zstandard tool decompresses such a file; a reader that wants some documents reads the two
tables from the end and then only the frames that hold them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import slices, text_bytes
from gridmill.llm.tokens import encoder

# Fixed values of the public seekable format.
SEEK_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80

FRAME_TOKENS = 65_536
LEVEL = 3
DOC = np.dtype([("id", "<i8"), ("tokens", "<i8"), ("null", "u1")])
FRAME = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])


class CorruptFrame(ValueError):
    """A frame's bytes don't match its checksum."""


class Writer:
    """Writes one file; documents come in their final order."""

    def __init__(self, out, frame_tokens: int = FRAME_TOKENS) -> None:
        self.out, self.limit = out, 4 * frame_tokens
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.open: list[bytes] = []
        self.size = self.tokens = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, key: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.limit:
            self._flush()
        self.docs.append((key or 0, len(ids) // 4, key is None))
        self.tokens += len(ids) // 4
        for at in range(0, len(ids), self.limit):  # a longer document takes several frames
            part = ids[at : at + self.limit]
            self.open.append(part)
            self.size += len(part)
            if self.size >= self.limit:
                self._flush()

    def _flush(self) -> None:
        data = b"".join(self.open)
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.open:
            self._flush()
        docs = np.array(self.docs, DOC).tobytes()
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(docs)) + docs)
        seek = np.array(self.frames, FRAME).tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)


class Reader:
    """Reads one file by its tables; `f` is a seekable binary file."""

    def __init__(self, f) -> None:
        self.f = f
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise CorruptFrame("no seek table")
        f.seek(end - 9 - n * FRAME.itemsize)
        self.frames = np.frombuffer(f.read(n * FRAME.itemsize), FRAME)
        self.starts = np.concatenate(([0], np.cumsum(self.frames["packed"].astype(np.int64))))
        f.seek(int(self.starts[-1]))
        magic, size = struct.unpack("<II", f.read(8))
        if magic != TABLE_MAGIC:
            raise CorruptFrame("no document table")
        self.docs = np.frombuffer(f.read(size), DOC)
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        self.f.seek(int(self.starts[i]))
        packed = self.f.read(int(self.frames["packed"][i]))
        try:
            data = self.unzip.decompress(packed)
        except zstandard.ZstdError as e:
            raise CorruptFrame(f"frame {i}: {e}") from e
        if len(data) != self.frames["size"][i] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames["sum"][i]:
            raise CorruptFrame(f"frame {i}")
        return data

    def rows(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, int, bytes]]:
        """(id, ids before it in the file, number of ids, ids); with `wanted` only the frames with those ids are read."""
        end = 4 * np.cumsum(self.docs["tokens"])
        edge = np.concatenate(([0], np.cumsum(self.frames["size"].astype(np.int64))))
        first = np.searchsorted(edge, end - 4 * self.docs["tokens"], side="right") - 1
        held, data = -1, b""
        for d, stop, f in zip(self.docs, end.tolist(), first.tolist()):
            if wanted is not None and (d["null"] or int(d["id"]) not in wanted):
                continue
            n, parts = int(d["tokens"]), []
            start = at = stop - 4 * n
            while at < stop:
                if f != held:
                    held, data = f, self.frame(f)
                parts.append(data[at - int(edge[f]) : stop - int(edge[f])])
                at = int(edge[f + 1])
                f += 1
            yield (None if d["null"] else int(d["id"]), start // 4, n, b"".join(parts))


@dataclass(frozen=True)
class Shard:
    """One file, the number of ids in all files before it, and the least and greatest document id in it (null: none)."""

    shard: int
    path: str
    docs: int
    tokens: int
    start: int
    low: int | None
    high: int | None


MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> list[Shard]:
    """Encodes every text, ends it with end_id and writes files below `path` in ascending order of id.

    Texts are dealt by range of (id, hash of the text), so rows repeated with one id spread out and
    the order is total up to equal rows; null ids come first, null texts count as empty. Rows equal
    in id and text can't be told apart and share a file: how often a row is repeated is the one thing
    that makes a file longer than its share. Each task writes one file under a name of its own attempt
    and renames it when complete, so lost executors and repeated tasks leave the same files; what
    failed attempts left is deleted at the end. An empty table writes none. Ids must be whole
    numbers; other columns don't matter. Returns the manifest, a row for each file.
    """
    size = text_bytes(docs, text_col)
    shards = max(6, size // min(max(16 << 20, size // 2000), 256 << 20))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(int(shards), "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, task = encoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        final, temp = f"{root}/part-{task.partitionId():06d}.zst", f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer = None
        try:
            with store.open_output_stream(temp) as out:
                writer = Writer(out)
                for batch in batches:
                    for part in slices(batch, "text"):
                        ids, at = enc.encode_column(part.column(1))
                        for key, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                            writer.add(key, ids[a:b].tobytes() + end)
                writer.close()
            if store.get_file_info(final).type == fs.FileType.File:  # of an attempt whose result was lost
                store.delete_file(final)
            store.move(temp, final)
        except BaseException:
            if store.get_file_info(temp).type == fs.FileType.File:
                store.delete_file(temp)
            raise
        keys = [k for k, _, none in writer.docs if not none]
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": final, "docs": len(writer.docs), "tokens": writer.tokens, "low": min(keys, default=None), "high": max(keys, default=None)}], MANIFEST)

    done = rows.mapInArrow(run, "shard long, path string, docs long, tokens long, low long, high long").collect()  # a row for each file
    store, root = fs.FileSystem.from_uri(path)
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(".part-"):  # an executor was lost while it wrote
            store.delete_file(info.path)
    out, before = [], 0
    for r in sorted(done, key=lambda r: r["shard"]):
        if r["docs"]:
            out.append(Shard(r["shard"], r["path"], r["docs"], r["tokens"], before, r["low"], r["high"]))
            before += r["tokens"]
    return out


def read(spark: SparkSession, path: str, manifest: Iterable[Shard], wanted: set[int] | None = None) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files.

    With `wanted` only documents with those ids, from the files whose range of ids holds any and the
    frames that hold them.
    """
    few = np.array(sorted(wanted or ()), np.int64)
    files = [(s.path, s.start) for s in manifest if wanted is None or (s.low is not None and np.searchsorted(few, s.low) < np.searchsorted(few, s.high, side="right"))]
    schema = "id long, start long, n_tokens long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)

        def batch(rows: list) -> pa.RecordBatch:
            a, b, c, d = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["id", "start", "n_tokens", "ids"])

        for got in batches:
            for file, before in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                with store.open_input_file(file) as f:
                    rows, size = [], 0
                    for key, start, n, ids in Reader(f).rows(wanted):
                        rows.append((key, before + start, n, ids))
                        size += len(ids)
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    return spark.createDataFrame(files, "path string, start long").repartition(len(files)).mapInArrow(run, schema)
