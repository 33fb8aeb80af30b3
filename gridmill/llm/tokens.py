"""Token ids of whole texts by the tokenizers library, with a bounded memo of white-space-delimited chunks.

Byte-level BPE (a blank belongs to the word after it) and word BPE (white space is dropped) never
merge across a blank between two words, so the ids of a text are those of its chunks, one after
another. Texts for which that is not certain (runs of white space, strings of special tokens) are
cut at whole runs of white space, or are encoded in one go. Every id comes from the tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White_Space of Unicode, as the tokenizers' regular expressions know it. Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
EDGE = re.compile(f"[{SPACE}]|^$")
#: Latin letters of which a stem may be made, so far as a tokenizer's normalizer leaves each of them one of them.
LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]
#: Marks that no tokenizer joins with letters: a stem and the marks after it are encoded apart.
MARKS = r"[.,;:!?*$%&#|()\"]*"

#: Bytes of a worker's memo of chunks, about; beyond, it keeps short ones only, or starts anew.
MEMO_BYTES = 112 << 20
#: What an entry takes beside its texts, about; longer chunks than LONGEST letters are never kept.
ENTRY_BYTES, LONGEST = 200, 64
#: Letters handed to the library at once, about, as its results take many times their size.
BATCH_LETTERS = 1 << 20


class Memo(dict):
    """Ids by chunk, bounded in bytes; long chunks are not kept."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.size = limit, 0

    def add(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= LONGEST:
            self.size += ENTRY_BYTES + len(chunk) + len(ids)
            if self.size > self.limit:
                short = [(c, v) for c, v in self.items() if len(c) <= 5]
                self.clear()
                self.size = sum(ENTRY_BYTES + len(c) + len(v) for c, v in short)
                if self.size < self.limit // 2:
                    self.update(short)
                else:
                    self.size = 0
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts with one tokenizer file; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.mode = _mode(spec)
        self.blank = " " if self.mode == "blank" else ""
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        norm = self.tokenizer.normalizer
        own = {c: norm.normalize_str(c) if norm else c for c in LETTERS}
        plain = [c for c in LETTERS if own[c] in own and own[own[c]] == own[c]]
        self.form = {ord(c): own[c] for c in plain}  # a letter as the normalizer leaves it
        self.level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in (" ", *plain)}
        self.same = all(c == x for c, x in own.items() if c in plain)  # letters stay as they are
        self.stems = re.compile(f"([{''.join(plain)}]+)({MARKS})")
        self.memo, self.firsts, self.marks = Memo(MEMO_BYTES), Memo(MEMO_BYTES // 8), Memo(MEMO_BYTES // 8)

    def direct(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the library, in batches of bounded size; a single longer text goes alone."""
        out, part, size = [], [], 0
        for t in texts:
            if part and size + len(t) > BATCH_LETTERS:
                out += self._batch(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        return out + self._batch(part)

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def stem(self, letters: str) -> bytes:
        """A normalized word of Latin letters is one piece to the pre-tokenizer, so the model takes it as it is."""
        return array("I", [t.id for t in self.model.tokenize(letters.translate(self.level))]).tobytes()

    def head(self, chunk: str) -> bytes:
        """Ids of a chunk with no blank before it."""
        ids = self.firsts.get(chunk)
        if ids is None:
            m = self.stems.fullmatch(chunk)
            ids = self.firsts.add(chunk, self.direct([chunk])[0] if m is None else self.stem(m[1].translate(self.form)) + self.mark(m[2]))
        return ids

    def mark(self, marks: str) -> bytes:
        if not marks:
            return b""
        ids = self.marks.get(marks)
        return self.marks.add(marks, self.direct([marks])[0]) if ids is None else ids

    def word(self, chunk: str) -> bytes | None:
        """Ids of letters and the marks after them; None where a chunk is anything else."""
        m = self.stems.fullmatch(chunk)
        if m is None:
            return None
        letters, marks = m.groups()
        if not self.same:
            letters = letters.translate(self.form)
        ids = self.memo.get(letters)
        if ids is None:
            ids = self.memo.add(letters, self.stem(self.blank + letters))
        return ids + self.mark(marks) if marks else ids

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks; a stem and the marks after it are looked up apart, and the memo keeps the stem, not both together."""
        got, rest = {}, []
        for c in new:
            ids = self.word(c)
            if ids is None and self.blank and "\n" in c:  # a single line feed between two words is a piece of its own
                start, *lines = c.split("\n")
                if not any(EDGE.search(x[:1] + x[-1:]) for x in lines) and (ids := self.word(start)) is not None:
                    ids += b"".join([self.mark("\n") + self.head(x) for x in lines])
            if ids is None:
                rest.append(c)
            else:
                got[c] = ids
        for c, ids in zip(rest, self.direct([self.blank + c for c in rest])):
            got[c] = self.memo.add(c, ids)
        return got

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after another, and the offset of each text's first; null is empty."""
        col = pc.fill_null(col, "")
        if self.mode == "whole":
            return _together(self.direct(col.to_pylist()))
        odd = np.zeros(len(col), bool)
        for s in self.special:
            odd |= pc.match_substring(col, s).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(col, " ") if self.blank else pc.ascii_split_whitespace(col)
        flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = flat.dictionary_encode()
        chunks, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        ids = list(map(self.memo.get, chunks))
        missing = [i for i, x in enumerate(ids) if x is None]
        bad: set[str] = set()
        if missing:
            new = [chunks[i] for i in missing]
            if self.blank:
                bad = {c for c in new if EDGE.search(c[:1] + c[-1:])}
                new = [c for c in new if c not in bad]
            got = self.learn(new)
            for i in missing:
                ids[i] = got.get(chunks[i], b"")
        if self.blank:
            wrong = np.array([c in bad for c in chunks], bool)[codes] if bad else np.zeros(len(codes), bool)
            wrong[at[:-1]] = False
            odd |= np.bincount(np.repeat(np.arange(len(col)), np.diff(at)), wrong, len(col)) > 0
            heads, place = np.unique(codes[at[:-1]], return_inverse=True)
            codes = codes.astype(np.int64)
            codes[at[:-1]] = len(ids) + place
            words = [chunks[h] for h in heads.tolist()]
            ids += [self.head(w) for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.concatenate(([0], np.cumsum(size)))[:-1]
        n = size[codes]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        out = pool[np.repeat(first[codes] - (end - n), n) + np.arange(total)] if total else pool[:0]
        offsets = np.concatenate(([0], end))[at]
        if odd.any():
            data = [out[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            for i in np.flatnonzero(odd).tolist():
                text = col[i].as_py()
                if self.blank and not any(s in text for s in self.special):
                    data[i] = b"".join(self.direct(RUNS.findall(text)))
                else:
                    data[i] = self.direct([text])[0]
            return _together(data)
        return out, offsets

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]


def _together(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(data), "<u4"), np.concatenate(([0], np.cumsum([len(d) // 4 for d in data]))).astype(np.int64)


def _mode(spec: dict) -> str:
    """"blank": a single blank goes with the word after it; "drop": white space is dropped; else "whole"."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "blank"
    steps = pre.get("pretokenizers") or []
    names = [n.get("type") for n in (norm or {}).get("normalizers") or []]
    if steps and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and r"[^\s" in steps[0]["pattern"].get("Regex", "") and set(names) <= {"NFC", "Replace", "Lowercase"}:
        return "drop"
    return "whole"


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
