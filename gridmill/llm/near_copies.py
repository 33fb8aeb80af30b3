"""Near copies at a given similarity of word shingles: wide SimHash with Golay-code fuzzy hashing, then verification.

The fingerprint of `simhash.groups` links at four of 64 bits; copies with a similarity of 0.8 differ in
more. Here a text's distinct words give a SimHash of 92 bits, four whole Golay segments of 23. Of at
most eight differing bits some two segments differ in two bits at most each (were three segments to
differ in three or more, there would be nine), and two words within distance 2 share a codeword
around them, so every such pair shares a file of two codewords.

At a similarity of 0.8 block edits and cut copies differ in some 14 bits, where files miss pairs. So
texts get `BANDS` more files, each named by `ROWS` minima (minhash) of their shingles: two texts of
similarity s share one with 1 - (1 - s^4)^20, whatever the edit. Pairs in a file of either kind are
candidates if at most `SIGNS` of the sign bits of 128 minima differ: at 0.8 one pair in 10,000,000
differs in more, and of 100,000,000 pairs with no shingle in common one differs in so few. A limit on
the fingerprints' own bits would not do: they are alike in all texts of a language, so that chains of
such pairs join ever more of a growing table in one class. At 0.8 files of both kinds keep all but 3
in 100,000 pairs, at 0.85 all but 1 in 1,000,000.

Candidates form coarse classes. Within a class, a sketch of `BINS` bins (one-permutation minhash, a
standard error of 0.025 at 0.8) refuses pairs `ERRORS` standard errors below the similarity; all
others are verified by their sets of shingle hashes, and only verified links count. Sets are made for
texts of classes of two and more alone, told by a set of bits of fixed size, and sketches from the sets
where they are compared. Large classes are verified in pairs of blocks, so no task holds more than two
blocks and no pair of texts of a class is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.llm import golay
from gridmill.llm.common import U64, bits_of, components, cut, in_bits, join2, map_text, mix, popcount, roots, slices, texts

BITS, SEGMENTS = 92, 4
BANDS, ROWS = 20, 4
SIGNS = 32
BINS = 256
#: Standard errors of the sketch below the similarity, from which on a pair isn't verified.
ERRORS = 5
BLOCK = 1024
BUCKET_PRINTS = 2_000

ENTRY = np.dtype([("file", "<u4"), ("low", "<u8"), ("high", "<u8")])
KEYS = np.dtype([("file", "<u4", (BANDS,)), ("low", "<u8"), ("high", "<u8")])

#: Odd factors that turn a shingle's hash into 128 independent ones.
FACTORS = mix(np.arange(128, dtype=U64)) | U64(1)


def keys(h: np.ndarray) -> bytes:
    """Names of a text's bands, and the sign bits of its minima, from the hashes of its shingles."""
    least = np.full(len(FACTORS), ~U64(0))
    for lo in range(0, len(h), 512):
        least = np.minimum(least, (h[lo : lo + 512, None] * FACTORS).min(0))
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    name = mix(np.arange(BANDS, dtype=U64))
    for k in range(ROWS):
        name = join2(name, rows[:, k])
    signs = np.packbits((mix(least) & U64(1)).astype(np.uint8), bitorder="little").view("<u8")
    return np.array((name >> U64(32), signs[0], signs[1]), KEYS).tobytes()


def shingles(line: bytes, words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the runs of `shingle` words of a line of words with single blanks; a shorter line is one run."""
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    return np.array([xxhash.xxh3_64_intdigest(line[s : e - 1]) for s, e in zip(starts[:n].tolist(), last.tolist())], U64)


def described(text: bytes, shingle: int) -> tuple[int, int, int, bytes]:
    """(hash of the words, low 64 bits, high 28 bits, keys) of a text, A-Z lower-cased."""
    words = text.lower().split()
    line = b" ".join(words)
    name = xxhash.xxh3_64_intdigest(line)
    if not words:
        return name, 0, 0, keys(np.zeros(0, U64))
    distinct = b"".join([xxhash.xxh3_128_digest(w) for w in set(words)])
    bits = np.unpackbits(np.frombuffer(distinct, np.uint8).reshape(-1, 16)[:, :12], axis=1, bitorder="little")
    print_ = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(bits), bitorder="little")
    whole = np.concatenate((print_, np.zeros(4, np.uint8)))
    return name, int(whole[:8].view("<u8")[0]), int(whole[8:12].view("<u4")[0]) & ((1 << (BITS - 64)) - 1), keys(shingles(line, words, shingle))


def sketch(h: np.ndarray) -> np.ndarray:
    """One-permutation minhash of a set of shingle hashes: BINS numbers, 0 for an empty bin."""
    least = np.full(BINS, 1 << 56, np.int64)
    np.minimum.at(least, (h % U64(BINS)).astype(int), (h >> U64(8)).astype(np.int64))
    return np.where(least < 1 << 56, 1 + (mix(least.astype(U64)) % U64(65535)).astype(np.int64), 0).astype("<u2")


def descriptions(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, name, a, b, keys for each row."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        got = [described(t, shingle) for t in texts(part.column(1))]
        n, a, b, k = zip(*got) if got else ((), (), (), ())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(n, U64).view(np.int64)), pa.array(np.array(a, U64).view(np.int64)), pa.array(b, pa.int64()), pa.array(k, pa.binary())], ["id", "name", "a", "b", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_text(rows, kernel, "id long, name long, a long, b long, keys binary", "text")


def files(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(file names, positions) of fingerprints."""
    low = U64((1 << golay.BITS) - 1)
    seg = [a & low, (a >> U64(23)) & low, ((a >> U64(46)) | (b << U64(18))) & low, (b >> U64(5)) & low]
    many = [golay.around(s.astype(np.int64)) for s in seg]
    for k, (s, t) in enumerate(combinations(range(SEGMENTS), 2)):
        for c in range(many[s].shape[1]):
            for d in range(many[t].shape[1]):
                ok = np.flatnonzero((many[s][:, c] >= 0) & (many[t][:, d] >= 0))
                yield mix((U64(k) << U64(32)) | (many[s][ok, c].astype(U64) << U64(12)) | many[t][ok, d].astype(U64)), ok


def dealt(prints: DataFrame, buckets: int) -> DataFrame:
    """Entries of texts (a, b, keys) in the files of their fingerprints and of their bands, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                a, b = (batch.column(i).slice(lo, 2048).to_numpy(zero_copy_only=False).view(U64) for i in (0, 1))
                k = np.frombuffer(b"".join(batch.column(2).slice(lo, 2048).to_pylist()), KEYS)
                bands = mix(k["file"].astype(U64)).ravel()
                got = [*files(a, b), (bands, np.repeat(np.arange(len(k)), BANDS))]
                names, at = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
                of = (names >> U64(32)) % U64(buckets)
                order = np.argsort(of, kind="stable")
                at = at[order]
                e = np.empty(len(names), ENTRY)
                e["file"], e["low"], e["high"] = (names & U64(0xFFFFFFFF))[order], k["low"][at], k["high"][at]
                bucket, first, n = np.unique(of[order], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array([e[i : i + k].tobytes() for i, k in zip(first, n)], pa.binary())], ["bucket", "blob"])

    return prints.mapInArrow(run, "bucket long, blob binary")


def signed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Names of texts by the sign bits of their minima; texts with the same bits are one here, and told apart when verified."""
    return mix(low ^ mix(high))


def coarse_links(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between texts of a bucket within SIGNS that share a file, thinned to a spanning forest."""
    low, high = entries["low"], entries["high"]
    return thinned(entries["file"], signed(low, high), low, high, SIGNS)


def thinned(f: np.ndarray, name: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between names in one file whose bits (a, b) differ in `limit` at most.

    In each file, what is linked to an entry leaves the ones still to visit.
    """
    order = np.argsort(f, kind="stable")
    f, name, a, b = f[order], name[order], a[order], b[order]
    edge = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
    length = np.diff(np.concatenate((edge, [len(f)])))
    out_a, out_b = [], []
    run = np.repeat(length, length)
    kept = np.flatnonzero((run > 1) & (run <= 16))
    for d in range(1, 16):
        if len(kept) <= d:
            break
        i, j = kept[:-d], kept[d:]
        same = f[i] == f[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        ok = (name[i] != name[j]) & (popcount(a[i] ^ a[j]).astype(int) + popcount(b[i] ^ b[j]) <= limit)
        out_a.append(i[ok])
        out_b.append(j[ok])
    for s, n in zip(edge[length > 16], length[length > 16]):
        rest = np.arange(s, s + n)
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                hit = popcount(a[rest] ^ a[i]).astype(int) + popcount(b[rest] ^ b[i]) <= limit
                found = rest[hit]
                out_a.append(np.full(len(found), i))
                out_b.append(found)
                queue.extend(found)
                rest = rest[~hit]
    if not out_a:
        return np.zeros(0, U64), np.zeros(0, U64)
    i, j = np.concatenate(out_a), np.concatenate(out_b)
    nodes, at = np.unique(np.concatenate((name[i], name[j])), return_inverse=True)
    top = roots(len(nodes), at[: len(i)], at[len(i) :])
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[below], nodes[top[below]]


def possible(sketch: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Whether others may have that similarity with a sketch's text, by ERRORS standard errors."""
    same = ((others == sketch) & (others > 0)).sum(1)
    bins = ((others > 0) | (sketch > 0)).sum(1)
    return same >= similarity * bins - ERRORS * np.sqrt(similarity * (1 - similarity) * bins)


def similar(own: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether sets of hashes (sorted) have that similarity with a text's own."""
    size = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    if not len(own) or not len(flat):
        return np.zeros(len(others), bool)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    c = np.concatenate(([0], np.cumsum(hit)))
    end = np.cumsum(size)
    common = c[end] - c[end - size]
    return common >= similarity * (size + len(own) - common) - 1e-9


def verified(names: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list, list]:
    """Links that connect the texts of one class as all links of that similarity would."""
    out_a, out_b, rest = [], [], np.arange(len(names))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = possible(sketches[i], sketches[rest], similarity)
            at = np.flatnonzero(hit)
            for lo in range(0, len(at), 64):
                few = at[lo : lo + 64]
                hit[few] = similar(sets[i], [sets[k] for k in rest[few]], similarity)
            found = rest[hit]
            out_a += [names[i]] * len(found)
            out_b += names[found].tolist()
            queue.extend(found)
            rest = rest[~hit]
    return out_a, out_b


def sets_of(docs: DataFrame, names: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """name, set (sorted hashes of shingles) of the texts with names, and of a few others."""

    words = bits_of(names.select("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = [b" ".join(t.lower().split()) for t in texts(part.column(0))]
                own = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], U64)
                some = np.flatnonzero(in_bits(words, own))
                blobs = [np.unique(shingles(lines[k], lines[k].split(), shingle)).tobytes() if lines[k] else b"" for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(own[some].view(np.int64)), pa.array(blobs, pa.binary())], ["name", "set"])

    made = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "name long, set binary")
    return made.groupBy("name").agg(F.min("set").alias("set"))


def groups(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """id, name (hash of the row's words), component_id (least id of the group), a row for each row of docs.

    Texts with the same words in the same order, letter case aside, are one text; null and blank texts
    are one group. Null ids are passed over as least id; a group of null ids alone has null. Ids must
    be whole numbers. Repeated rows are in one group; an empty table gives no rows; whole texts count,
    however long; other columns don't matter.
    """
    rows = cut(descriptions(docs, id_col, text_col, shingle))
    prints = cut(rows.select("a", "b", "keys").distinct())
    n = prints.count()

    def links(table: pa.Table) -> pa.Table:
        a, b = coarse_links(np.concatenate([np.frombuffer(x.as_py(), ENTRY) for x in table.column("blob")]))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.frombuffer(b"".join(batch.column(1).to_pylist()), KEYS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(k["low"], k["high"]).view(np.int64))], ["name", "print"])

    once = rows.select("name", "keys").mapInArrow(named, "name long, print long").distinct()
    coarse = components(dealt(prints, max(64, n // BUCKET_PRINTS)).groupBy("bucket").applyInArrow(links, "a long, b long"))
    member = once.join(coarse, once["print"] == coarse["node"], "left").select("name", F.coalesce("root", "print").alias("cls"))
    member = cut(member)
    size = member.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").repartition(F.xxhash64("cls"))  # dealt anew, so that a large class can be split in the join
    live = cut(member.join(size, "cls"))
    live = live.join(sets_of(docs, live, text_col, shingle), "name").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod("name", F.col("blocks")).cast("int"))
    spread = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    parts = max(64, n // 4_000)
    part = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cls"), F.lit(parts))).otherwise(F.pmod(F.xxhash64("cls", "i", "j"), F.lit(parts)))
    spread = spread.select(part.alias("part"), "cls", "i", "j", "name", "set")

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cls", "ascending"), ("i", "ascending"), ("j", "ascending"), ("name", "ascending")])
        key = np.stack([table.column(c).to_numpy() for c in ("cls", "i", "j")], 1)
        names = table.column("name").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
        out_a, out_b = [], []
        blobs = table.column("set")
        for s, e in zip(start, [*start[1:], len(names)]):
            if e - s < 2:
                continue
            sets = [np.frombuffer(x.as_py(), U64) for x in blobs.slice(s, e - s)]
            a, b = verified(names[s:e], np.stack([sketch(x) for x in sets]), sets, similarity)
            out_a += a
            out_b += b
        del table, blobs
        pa.default_memory_pool().release_unused()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    fine = components(spread.groupBy("part", "i", "j").applyInArrow(verify, "a long, b long"))
    ids = rows.groupBy("name").agg(F.min("id").alias("least"))
    top = ids.join(fine, ids["name"] == fine["node"], "left").select("name", "least", F.coalesce("root", "name").alias("root"))
    best = top.groupBy("root").agg(F.min("least").alias("component_id")).repartition(F.xxhash64("root"))
    label = cut(top.join(best, "root").select("name", "component_id"))
    return rows.select("id", "name").join(label, "name").select("id", "name", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of docs without all but one row of each group; columns as they were, whatever their names.

    The row with the group's least id stays; of several rows with that id, and in a group whose ids are
    all null, the one whose words have the least hash, then the least text, then the least hash of its
    other columns. Null and blank texts are one group; rows repeated in full leave one; an empty table
    stays empty. Texts of any length are compared whole. Only rows that may be in a group of several, by
    a set of bits of fixed size, are moved.
    """
    named = cut(groups(docs, similarity, id_col, text_col, shingle))
    group = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("name")))
    own, of, which = (unused(docs, c) for c in ("gm_name", "gm_of", "gm_id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "name")).alias("s")
    several = named.groupBy(group.alias("g")).agg(F.count("*").alias("n"), first).filter("n > 1")
    stay = several.select(F.col("s.id").alias(which), F.col("s.name").alias(of))
    words = bits_of(named.join(several.select("g"), group == F.col("g"), "left_semi").select("name"))

    def run(batches: Iterator[pa.RecordBatch], among: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                names = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.lower().split())) for t in texts(part.column(text_col))], U64).view(np.int64)
                held = pa.array(in_bits(words, names) == among)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names)], schema=part.schema.append(pa.field(own, pa.int64()))).filter(held)

    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())])
    alone = docs.mapInArrow(lambda b: run(b, False), schema).drop(own)  # in no group of several rows
    marked = docs.mapInArrow(lambda b: run(b, True), schema)
    groups_of = named.join(several.select("g"), group == F.col("g"), "left_semi").select("id", "name").distinct().select(F.col("id").alias(which), F.col("name").alias(of))
    same = marked[id_col].cast("long").eqNullSafe(F.col(which)) & (marked[own] == F.col(of))
    wrongly = marked.join(groups_of, same, "left_anti").drop(own)  # the bits hold a few others
    kept = marked.join(stay, same, "left_semi")
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType) and f.name not in (id_col, text_col)]
    order = F.struct(F.col(f"`{text_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0))
    one = kept.groupBy(F.col(f"`{id_col}`").alias("k"), F.col(own).alias("w")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("row"))
    return alone.unionAll(wrongly).unionAll(one.select("row.*"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
