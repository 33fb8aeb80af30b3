"""Each operator against a brute-force version, on a corpus with every odd case."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridmill.llm import decontaminate, golay, licenses, near_copies, packing, pii, quality_cnn, quality_rules, simhash, substring_dedup, token_output, tokens, url_filters
from gridmill.llm.common import components, fresh_path, roots
from gridmill.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- shared parts


def test_golay_code():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 3000)
    for k in range(3):
        y = w.copy()
        for i in range(len(y)):
            for b in rng.choice(23, k, replace=False):
                y[i] ^= 1 << int(b)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(golay.around(w), golay.around(y)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    top = roots(2000, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: int(top[n]) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_memo_counts_each_entry_once():
    """Words with marks after them take no room beside their stems, and no entry counts twice to the bound."""
    e = Encoder(BYTE)
    e.encode(["one word, of one. Word of word; one! of, word."] * 2)
    assert set(e.memo) == {"word", "of", "one", "Word"}
    assert e.memo.size == sum(tokens.ENTRY_BYTES + len(c) + len(v) for c, v in e.memo.items())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path, corpus):
    rng = random.Random(2)
    parts = ["a", "b ", " ", "\n", "'s", "1", "!", "é", "\x1c", "\t", "Σ", " ß", "word", "<|endoftext|>", " ", "  "]
    texts = [t for t in corpus[:-1] if t is not None] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    e = Encoder(path)
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == want  # from the memo


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_letter_alone_in_words_and_at_case_changes(path):
    points = [chr(c) for c in range(0x3000)]
    texts = [t for c in points for t in (c, f"ab{c}cd {c}stanbul.", f"x {c}b B{c.upper()} {c.lower()}Z", f"DI{c}AR, {c}{c}!")]
    rng = random.Random(12)
    latin = [*"abcXYZ", *points[0xC0:0x250]]
    texts += [" ".join("".join(rng.choice(latin) for _ in range(rng.randint(1, 6))) + rng.choice([".", ",", "!?", ""]) for _ in range(5)) for _ in range(4000)]
    e = Encoder(path)
    want = [x.ids for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # again, from the memo
        got = [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)]
        assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_the_memo_is_bounded_in_bytes():
    e = Encoder(WORD)
    e.encode(["x" * 9000, "日本語" * 3000])
    assert not any(len(c) > 64 for m in (e.memo, e.firsts, e.marks) for c in m)
    small = tokens.Memo(100_000)
    for i in range(5000):
        small.add(f"chunk{i}", b"0123")
        assert len(small) * 200 <= 100_000 and small[f"chunk{i}"] == b"0123"


# ---------------------------------------------------------------- 1 packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in rows_of(docs))
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, BYTE).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(r["id"], r["doc_tokens"])].append((r["start"], ids))
    for v in seqs.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(len(k[1]) * n for k, n in want.items())
    assert sum(n for v in seqs.values() for _, n in v) == total
    for (i, ids), times in want.items():
        have = pieces[(i, len(ids))]
        for s, part in have:
            if sum(n for k, n in want.items() if k[0] == i) == times:
                assert part == list(ids[s : s + len(part)])
    assert packing.pack(empty, BYTE).count() == 0


def test_differencing_packs_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 2000)
    place, bins = packing.windows(sizes, 1024)
    sums = np.bincount(place, sizes, bins)
    assert sums.max() <= 1024 and bins <= 1.01 * sizes.sum() / 1024 + 1
    assert packing.windows(np.array([1024, 1024, 600, 600]), 1024)[1] == 4  # the count rises
    packer = packing.Packer(0)
    for i in range(20_000):  # documents of one token
        packer.add(i, b"\0\0\0\0")
        assert len(packer.open) < packing.BATCH_PIECES
    packer.flush()
    assert len(packer.rows) == 20_000 and packer.base <= 21


# ---------------------------------------------------------------- 2 personal data


def base_spans(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted((m.start(), pii.RANK[k], m.end()) for k, m in out)


def test_personal_data_equals_regular_expressions(corpus):
    rng = random.Random(3)
    odd = ["".join(rng.choice("a1.@+-( )9é@..0123") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    odd += ["4111111111111111 4111-1111-1111-1111 1.2.3.4.5 256.1.1.1 0001.2.3.4", "9" * 6000, "a" * 50_000 + "@b.c", "é@b.c ü.x@y.z@q.r"]
    for text in [t for t in corpus if t] + odd:
        got = [(a, pii.RANK[k], b) for k, a, b in pii.find(text) if k in pii.BASE]
        assert got == base_spans(text), text[:80]


def test_added_spans_and_redaction(spark, docs, empty):
    text = "IBAN DE89 3704 0044 0532 0130 00, account no. 12345678, ftp://me:secret@host.example and a@b.co"
    assert {k for k, _, _ in pii.find(text)} == {"iban", "account", "login", "email"}
    assert pii.hide("mail a@b.co now") == "mail <EMAIL> now"
    kept = pii.redact(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert kept.filter("text like '%@c.de%'").count() == 0 and kept.filter("text is null").count() == docs.filter("text is null").count()
    assert pii.spans(docs).count() == docs.count() and pii.spans(empty).count() == 0


def test_logins_of_any_length():
    for user, secret in (("u" * 65, "s"), ("user", "t" * 129), ("u" * 500, "eyJ" + "x.Y-_" * 1000)):
        text = f"see https://{user}:{secret}@host.example for it"
        assert ("login", 12, 13 + len(user) + len(secret)) in pii.find(text)
        assert pii.hide(text) == "see https://<LOGIN> for it"
    assert not [x for x in pii.find("https://" + "u" * 1_000_000 + " https://u:" + "s" * 1_000_000) if x[0] == "login"]


def test_addresses_from_schemes_and_colons():
    def found(text):
        return [(k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE]

    assert found("ssh://me:pw@localhost:22/x and http://a:b@[2001:db8::7]:80/") == [("login", "me:pw"), ("login", "a:b"), ("ipv6", "2001:db8::7")]
    assert found("at 2001:0db8:85a3:0000:0000:8a2e:0370:7334, fe80::1ff:fe23:4567:890a. ::ffff:10.0.0.1") == [("ipv6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), ("ipv6", "fe80::1ff:fe23:4567:890a"), ("ipv6", "::ffff:10.0.0.1")]
    assert found("call tel:017-555-7713 or tel:12") == [("tel", "017-555-7713")]
    for clean in ("at 12:30:45 o'clock", "std::vector<int> a::b::c x::y", "http://host:80/a:b@c", "see ::1 and ::", "a:b:c:d:e", "ratio 1:2:3:4:5", "https://www.example.com/path?q=a@b", "beef:" * 30_000):
        assert found(clean) == [], clean[:40]


# ---------------------------------------------------------------- 3 URL filters


def test_url_lists_by_time(spark):
    events = spark.createDataFrame([("l", "bad.com", 10, True), ("l", "bad.com", 20, False), ("m", "COM", 15, True), ("l", "x.bad.com", 5, True), ("l", "x.bad.com", 5, False), (None, "z", 1, True)], "list string, domain string, at int, added boolean")
    caps = spark.createDataFrame([(1, "http://www.BAD.com:80/a", 10), (2, "http://bad.com/", 20), (3, "https://u:p@x.bad.com./", 9), (4, None, 12), (5, "bad.com", 12), (6, "http://notbad.com", 12), (1, "http://www.BAD.com:80/a", 10), (7, "http://bad.com", None)], "page_id long, url string, fetched int")
    got = sorted((r["id"], r["lists"], r["blocked"]) for r in url_filters.judge(caps, events).collect())
    assert got == [(1, "l", True), (1, "l", True), (2, "m", True), (3, "", False), (4, "", False), (5, "", False), (6, "", False), (7, "", False)]
    clash = caps.select("*", F.lit("q").alias("id"), F.lit("h").alias("host"), F.lit("d").alias("domain"), F.lit("l").alias("lists"))
    assert sorted((r["id"], r["lists"], r["blocked"]) for r in url_filters.judge(clash, events).collect()) == got
    assert url_filters.judge(caps.limit(0), events).count() == 0 and url_filters.judge(caps, events.limit(0)).filter("blocked").count() == 0


# ---------------------------------------------------------------- 4 substring dedup


def test_substring_dedup(docs, empty):
    rows = rows_of(docs)
    seen = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [split(t)] for i in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [tuple(r) for r in substring_dedup.deduplicate(docs).collect()]
    assert Counter(got) == Counter(want) and any(g[2] for g in got)
    assert substring_dedup.deduplicate(empty).count() == 0


def test_equal_rows_spread_over_groups(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string").crossJoin(spark.range(100_000)).select("doc_id", "text")
    path = fresh_path(spark, "equal")
    docs.repartition(4).write.parquet(path)
    got = substring_dedup.deduplicate(spark.read.parquet(path))
    assert got.groupBy("n_words", "n_removed", "kept").count().collect()[0].asDict() == {"n_words": 40, "n_removed": 40, "kept": "", "count": 100_000}
    dealt = spark.read.parquet(path).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16)).alias("g")).groupBy("g").count().collect()
    assert len(dealt) == 16 and max(r["count"] for r in dealt) < 7_500


def test_chains_survive_any_surroundings():
    rng = np.random.default_rng(4)
    for alphabet in (2, 3, 50):
        for _ in range(300):
            shared = rng.integers(0, alphabet, 35)
            keys = []
            for _ in range(2):
                around = [rng.integers(0, alphabet, rng.integers(0, 30)) for _ in range(2)]
                text = np.concatenate((around[0], shared, around[1])).astype(np.uint64)
                name, start, end = substring_dedup.chains(text, np.zeros(len(text), int))
                inside = (start >= len(around[0])) & (end <= len(around[0]) + 35)
                keys.append(set(name[inside].tolist()))
            assert keys[0] & keys[1]


# ---------------------------------------------------------------- 5 decontamination


def test_decontamination(spark, docs, corpus, empty):
    w = corpus[7].split()
    edited = w[10:50]
    edited[5], edited[20] = "edited", "changed"
    bench = spark.createDataFrame([(1, " ".join(w[10:50])), (2, "nothing like this is anywhere in here"), (3, " ".join(edited)), (4, None), (5, ""), (1, " ".join(w[10:50])), (6, "same same")], "item_id long, text string")
    got = {(r["id"], r["item"]): r["score"] for r in decontaminate.search(docs, bench).collect()}
    assert got[(7, 1)] == 1.0 and 0.6 < got[(7, 3)] < 1.0 and not {k for k in got if k[1] in (2, 4, 5)}
    assert {k[0] for k in got if k[1] in (1, 3)} == {7}
    kept = decontaminate.drop(docs, bench.filter("item_id in (1, 3)"))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontaminate.search(docs, bench.limit(0)).count() == 0 and decontaminate.search(empty, bench).count() == 0


def test_edited_copies_are_found_in_small_tables_and_in_groups(spark):
    rng = random.Random(11)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    item = rng.sample(lexicon, 40)
    texts = []
    for n in range(3, 9):
        edited = list(item)
        for k in range(n):
            edited[3 + k * (34 // (n - 1))] = f"edit{k}"
        if 2 * (40 - n) - n >= 0.6 * 80:
            texts.append(" ".join(rng.sample(lexicon, 30) + edited + rng.sample(lexicon, 30)))
    assert len(texts) == 6
    others = [" ".join(rng.sample(lexicon, 80)) for _ in range(150)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for times in (1, 40):  # each copy alone, and a group of copies that makes its seeds common
        docs = spark.createDataFrame(list(enumerate(texts * times + others)), "doc_id long, text string").repartition(3)
        assert {r["id"] for r in decontaminate.search(docs, bench).collect()} == set(range(6 * times))
        assert decontaminate.drop(docs, bench).count() == len(others)


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_decontamination_equals_all_alignments(spark, monkeypatch):
    """Every text against every item, in one block and in many; copies have words replaced, left out and put in, and marks."""
    rng = random.Random(13)
    lexicon = [f"w{i}" for i in range(400)]
    items = [rng.sample(lexicon, rng.randint(12, 30)) for _ in range(12)] + [["w1", "w2"], ["w3"], rng.sample(lexicon, 20)]
    texts = []
    for _ in range(90):
        part = list(rng.choice(items))
        for _ in range(rng.randint(0, len(part) // 3)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([["new"], [], [part[at], "extra"], [part[at].upper() + "!"], [part[at], "--"]]) or []
            part = part or ["x"]
        texts.append(" ".join(rng.choices(lexicon[200:], k=rng.randint(0, 20)) + part + rng.choices(lexicon[200:], k=rng.randint(0, 20))))
    texts += ["", None, "w3", "W1, w2.", "w2 w1"]
    lists = [decontaminate.item_words(t) for t in texts]

    def seeds(ws):
        n = min(3, len(ws))
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    want = {}
    for d, t in enumerate(lists):
        for k, w in enumerate(items):
            n = min(3, len(w))
            held = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
            share = smith_waterman(w, t) / (2 * len(w))
            if held & seeds(w) and share >= 0.6:
                want[(d, k)] = round(share, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    for block in (20_000, 4):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        assert {(r["id"], r["item"]): r["score"] for r in decontaminate.search(docs, bench).collect()} == want and len(want) > 60
        assert {r["doc_id"] for r in decontaminate.drop(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_bound_refuses_no_find():
    rng = np.random.default_rng(6)
    for _ in range(2000):
        a, b = rng.integers(1, 12, rng.integers(1, 20)), rng.integers(0, 12, rng.integers(0, 80))
        if decontaminate.align(a, b)[0] >= 0.6 * 2 * len(a):
            assert decontaminate.reachable(a, b, 0.6)


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(0, 30))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


# ---------------------------------------------------------------- 6 quality rules


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (50, 0)], "doc_id long, quality int")
    texts = dict((i, t) for i, t in rows_of(docs) if i is not None)
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["id"] is None:
            continue
        t = texts[r["id"]] or ""
        w = split(t)
        seen, cover = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if seen[tuple(w[i : i + 5])] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if split(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.judge(empty, labels).count() == 0 and quality_rules.judge(docs, labels.limit(0)).count() == docs.count()


def test_likelihood_ratios_equal_plain_counts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1), (3, 0), (None, 1), (70_000, 1)], "doc_id long, quality int")
    rows = rows_of(docs)

    def cells(text):
        names = [np.uint64(xxhash.xxh3_64_intdigest(w.encode())) for w in split(text)]
        one = quality_rules.mix(np.array(names, np.uint64)).tolist()
        two = quality_rules.join2(np.array(names[:-1], np.uint64), np.array(names[1:], np.uint64)).tolist()
        return [x % quality_rules.BUCKETS for x in one + two]

    good, raw = Counter(), Counter()
    for i, t in rows:
        raw.update(cells(t))
        if i is not None and (i % 2 and i < 30):
            good.update(cells(t))
    p = {c: np.log((good[c] + 1) / (sum(good.values()) + quality_rules.BUCKETS)) - np.log((raw[c] + 1) / (sum(raw.values()) + quality_rules.BUCKETS)) for c in range(quality_rules.BUCKETS)}
    want = Counter((i, round(sum(p[c] for c in cells(t)) / max(1, len(cells(t))), 4)) for i, t in rows)
    got = quality_rules.judge(docs, labels).collect()
    assert Counter((r["id"], round(r["llr"], 4)) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD) for r in got) and len({r["kept"] for r in got if not r["base_failed"]}) == 2


# ---------------------------------------------------------------- 7 SimHash


def print_of(text, k=4):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, empty):
    rows = rows_of(docs)
    prints = [print_of(t) for _, t in rows]
    a, b = zip(*[(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    top = roots(len(rows), np.array(a), np.array(b))
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[top[i]] += [k] if k is not None else []
    want = Counter((k, prints[i], min(least[top[i]], default=None)) for i, (k, _) in enumerate(rows))
    got = Counter((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.groups(docs).collect())
    assert got == want and simhash.groups(empty).count() == 0


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(6)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
    prints = np.array(sorted(prints), np.uint64)
    pairs = [(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4)]
    want = roots(len(prints), np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]))
    at = {int(p): i for i, p in enumerate(prints)}
    df = spark.createDataFrame([(int(p.view(np.int64)) if hasattr(p, "view") else p,) for p in prints], "fp long")
    got = [(at[r["a"] & (1 << 64) - 1], at[r["b"] & (1 << 64) - 1]) for r in simhash.near_links(df, len(prints)).collect()]
    assert (roots(len(prints), np.array([x for x, _ in got]), np.array([y for _, y in got])) == want).all()


def test_near_copies(docs, empty, corpus):
    got = {r["id"]: r["component_id"] for r in near_copies.groups(docs).collect() if r["id"] is not None}
    for copy, of in ((40, 0), (41, 0), (42, 1), (43, 2), (44, 3), (45, 3), (46, 3)):
        assert got[copy] == got[of] == of
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (split((t or "").lower()) for t in corpus)]
    for i, x in enumerate(sets):
        for j in range(i):
            if got[i] == got[j] and x and sets[j]:
                assert len(x & sets[j]) > 0
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted({v for v in got.values()})
    assert near_copies.keep_one(empty).count() == 0


def test_one_row_stays_whatever_columns_and_case(spark):
    a, b = " ".join(f"Word{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40))
    rows = [(1, a, 5, "x"), (1, a.upper(), 5, "x"), (1, a, 4, "y"), (1, a, 4, "y"), (2, b, 0, ""), (None, b, 0, ""), (None, None, 1, ""), (None, "", 1, ""), (3, a + " tail", 9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gm_name int, gm_of string").repartition(4)
    for _ in range(2):
        got = sorted(map(tuple, near_copies.keep_one(docs).collect()), key=str)
        assert len(got) == 3 and (2, b, 0, "") in got and [r for r in got if r[0] == 1][0][1] == a.upper() and [r for r in got if r[0] is None][0][1] is None
        docs = docs.repartition(7)
    odd = docs.withColumn("m", F.create_map(F.lit("k"), F.col("gm_name")))
    assert near_copies.keep_one(odd).columns == odd.columns and near_copies.keep_one(odd).count() == 3


def block_edits(seed, least, most, pairs):
    """Texts, each followed by a copy with a block replaced or cut off, of shingle similarity from least to below most; their similarities."""
    rng = np.random.default_rng(seed)
    texts, shares = [], []
    while len(shares) < pairs:
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
        k = int(rng.integers(5, 70))
        at = int(rng.integers(0, 300 - k))
        c = w[:at] + [f"x{x}" for x in rng.integers(0, 1 << 40, k)] + w[at + k :] if len(shares) % 2 else w[:-k]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (w, c))
        share = len(x & y) / len(x | y)
        if least <= share < most:
            texts += [" ".join(w), " ".join(c)]
            shares.append(share)
    return texts, shares


def test_near_copies_with_block_edits_are_candidates(spark):
    texts, _ = block_edits(7, 0.87, 0.9, 300)
    got = {r["id"]: r["component_id"] for r in near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [i for i in range(0, len(texts), 2) if got[i] != got[i + 1]] == []


def test_near_copies_are_verified_exactly(spark):
    texts, shares = block_edits(8, 0.76, 0.84, 300)
    got = {r["id"]: r["component_id"] for r in near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [s for i, s in enumerate(shares) if (got[2 * i] == got[2 * i + 1]) != (s >= 0.8)] == []


def test_texts_of_one_language_are_no_class(spark):
    """Texts of mostly the same words have fingerprints alike, and no shingle in common: no chain of them may grow with the table."""
    rng = random.Random(9)
    common = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.sample([*common, *(f"x{k}y{i}" for i in range(12))], 212)) for k in range(300)]
    table = spark.createDataFrame(list(enumerate([*texts, texts[0] + " tail"])), "doc_id long, text string")
    rows = near_copies.descriptions(table, "doc_id", "text", 5).select("a", "b", "keys")
    entries = np.concatenate([np.frombuffer(r["blob"], near_copies.ENTRY) for r in near_copies.dealt(rows, 1).collect()])
    assert len(near_copies.coarse_links(entries)[0]) == 1
    assert [r["id"] for r in near_copies.groups(table).collect() if r["component_id"] != r["id"]] == [300]


# ---------------------------------------------------------------- 8 token files


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    t, path = Tokenizer.from_file(WORD), fresh_path(spark, "t")
    manifest = token_output.write(docs, path, WORD)
    got = sorted(token_output.read(spark, path, manifest).collect(), key=lambda r: r["start"])
    assert Counter((r["id"], bytes(r["ids"])) for r in got) == Counter((i, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, x in rows_of(docs))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert {r["id"] for r in token_output.read(spark, path, manifest, {3, 9}).collect()} == {3, 9}
    assert token_output.read(spark, path, manifest, {10_000}).count() == token_output.read(spark, path, manifest, set()).count() == 0
    assert not [x for x in os.listdir(path.removeprefix("file://")) if not x.startswith("part-") and not x.endswith(".crc")]
    assert token_output.read(spark, path, token_output.write(empty, fresh_path(spark, "t"), WORD)).count() == 0


def test_frames_are_independent_and_checked(tmp_path):
    import zstandard

    with open(tmp_path / "f", "wb") as f:
        w = token_output.Writer(f, frame_tokens=10)
        for i in range(30):
            w.add(i if i else None, np.arange(i, dtype="<u4").tobytes())
        w.close()
    data = (tmp_path / "f").read_bytes()
    with open(tmp_path / "f", "rb") as f:
        r = token_output.Reader(f)
        assert len(r.frames) > 5 and [x[2] for x in r.rows()] == list(range(30)) and r.frames["size"].max() <= 40
        assert [np.frombuffer(x[3], "<u4").tolist() for x in r.rows()] == [list(range(i)) for i in range(30)]
        assert [(x[0], x[1], len(x[3])) for x in r.rows({25, 3})] == [(3, 3, 12), (25, 300, 100)]
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(np.arange(i, dtype="<u4").tobytes() for i in range(30))
    for at in (20, len(data) // 2):
        (tmp_path / "g").write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with open(tmp_path / "g", "rb") as f, pytest.raises(token_output.CorruptFrame):
            list(token_output.Reader(f).rows())


# ---------------------------------------------------------------- 9 classifier


def test_classifier_learns_and_keeps_all_rows(spark, docs, empty):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcd efgh") for _ in range(rng.randint(30, 900))) for _ in range(240)]
    table = spark.createDataFrame([(i, t if i % 2 else t.replace(" ", "### ")) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(None, 1), (9999, None)], "doc_id long, quality int")
    net = quality_cnn.train(table, labels)
    got = quality_cnn.score(table, net).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == r["id"] % 2 for r in held) > 0.95 * len(held)
    odd = quality_cnn.score(docs, net).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_cnn.keep(docs, net).columns == docs.columns and quality_cnn.keep(empty, net).count() == 0
    assert quality_cnn.score(docs, quality_cnn.train(table, labels.limit(0))).filter("score = 0.5").count() == docs.count()


def test_chunks_cover_the_text_and_batches_agree():
    rng = np.random.default_rng(9)
    data = bytes(rng.integers(0, 256, 3000, np.uint8))
    got = quality_cnn.chunked(data)
    assert (got[:, : quality_cnn.STEP].reshape(-1)[: len(data)] == np.frombuffer(data, np.uint8)[: got[:, : quality_cnn.STEP].size]).all() and len(got) == quality_cnn.n_chunks(3000)
    net = quality_cnn.fit([(b"aaaa" * 50, 1), (b"####" * 50, 0)] * 8, epochs=2)
    many = [data, b"", b"short", bytes(rng.integers(0, 256, 300_000, np.uint8)), data[:600]]
    assert np.allclose(net.scores(many), [net.scores([d])[0] for d in many], atol=1e-5)
    for d, s in zip(many, net.scores(many)):  # the network written out plainly
        pools = []
        for c in quality_cnn.chunked(d):
            r = np.array([net.embed[c[i : i + quality_cnn.WIDTH]].reshape(-1) @ net.filters + net.bias for i in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE)]).clip(0)
            pools.append(np.concatenate((r.max(0), r.mean(0))))
        z = np.concatenate((np.mean(pools, 0), np.max(pools, 0))) @ net.out + net.shift
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-4


def test_gradients_equal_differences():
    rng = np.random.default_rng(10)
    net = quality_cnn.fit([(b"abcd" * 60, 1), (b"x#y#" * 60, 0)] * 4, epochs=1)
    for name in ("embed", "filters", "bias", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    many, y, w = [bytes(rng.integers(97, 100, n, np.uint8)) for n in (900, 40, 1500)], np.array([1.0, 0.0, 1.0]), np.array([1.0, 1.5, 0.5])

    def loss():
        n = [quality_cnn.n_chunks(len(d)) for d in many]
        p, at = net.pooled(many), np.concatenate(([0], np.cumsum(n)))[:-1]
        z = np.concatenate((np.add.reduceat(p, at) / np.array(n)[:, None], np.maximum.reduceat(p, at)), 1) @ net.out + 0.1
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum() / 3 + 0.5e-4 * (net.out**2).sum())

    grads = quality_cnn.gradients(net, 0.1, many, y, w)
    for name, g, places in (("embed", grads[0], [(97, 0), (98, 3), (256, 1)]), ("filters", grads[1], [(0, 0), (17, 5), (63, 20)]), ("bias", grads[2], [(0,), (7,)]), ("out", grads[3], [(3,), (60,)])):
        value = getattr(net, name)
        for at in places:
            old, step = value[at], 1e-5
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4 + 0.02 * abs(g[at]), (name, at)


def test_the_fit_takes_whole_texts_of_a_bounded_sample(spark):
    rows = [(i, "long " * 400 if i == 3 else f"text {i}") for i in range(40)] + [(5, "another"), (None, "x"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, 0), (7, None), (None, 1)], "doc_id long, quality int")
    all_ = quality_cnn.sample(docs, labels, "doc_id", "text", "quality")
    teach = [i for i in range(40) if not quality_cnn.is_held_out(i)]
    least = {i: min((t or "") for k, t in rows if k == i) for i in teach}
    assert Counter(all_) == Counter((least[i].encode(), i % 2) for i in teach)
    assert quality_cnn.sample(docs.repartition(5), labels, "doc_id", "text", "quality") == all_
    few = quality_cnn.sample(docs, labels, "doc_id", "text", "quality", size=120)
    assert sum(len(t) for t, _ in few) <= 120 and few == [x for x in all_ if x in few] and len(few) > 5
    assert quality_cnn.sample(docs.limit(0), labels, "doc_id", "text", "quality") == []


# ---------------------------------------------------------------- 10 licences


def test_licences(spark, docs, empty):
    lines = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "released under the MIT license": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "A driving licence is required": "unknown", "All rights reserved. Copyright": "unknown", "License: see the version of the public terms": "unknown", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    table = spark.createDataFrame([(i, f"first line\n{t}\nlast") for i, t in enumerate(lines)] + [(None, None), (99, "")], "doc_id long, text string")
    got = {r["id"]: (r["paragraph"], r["family"]) for r in licenses.scan(table).collect()}
    assert got == {i: (1, f) for i, f in enumerate(lines.values())}
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs).count() == 0
    plan = licenses.scan(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_every_template_is_found_whole_and_wrapped(spark):
    import textwrap

    rows, want = [], {}
    for _, family, ts in [(n, f, t) for f, t in licenses.TEMPLATES.items() for n in (0,)]:
        for t in ts:
            for width in (10_000, 70, 55):
                body = "\n".join(f" * {x}" for x in textwrap.wrap(t, width)[:4])
                if width < 10_000 and len(textwrap.wrap(t, width)) > 4:
                    continue
                want[len(rows)] = family
                rows.append((len(rows), f"Some words of prose before it all\n\n{body}\n\nand other prose that follows here"))
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["id"], set()).add(r["family"])
    assert {i: want[i] for i in want if want[i] not in got.get(i, ())} == {}
    assert licenses.model()[2] > 0 and not {t for ts in licenses.TEMPLATES.values() for t in ts} & {t for ts in licenses.WORDINGS.values() for t in ts}


def test_licences_in_long_and_repeated_texts(spark):
    prose = "plain words that say nothing of it\n" * 30_000
    rows = [(1, prose + "SPDX-License-Identifier: MIT\n" + prose), (2, "Released under CC0 1.0"), (2, "Released under CC0 1.0"), (None, "Released under CC0 1.0")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, lines string, x int, grams string")
    got = sorted((r["id"] or 0, r["paragraph"], r["family"]) for r in licenses.scan(docs).collect())
    assert got == [(0, 0, "cc0"), (1, 30_000, "mit"), (2, 0, "cc0"), (2, 0, "cc0")]


def test_notices_wrapped_over_any_number_of_lines(spark):
    """Read whole, however many lines they take, and where a line's end parts the only cue."""
    import textwrap

    rows, want = [], {}
    for family, ts in licenses.TEMPLATES.items():
        for t in ts:
            for width in (30, 18):
                for mark in ("", " * ", "# "):
                    want[len(rows)] = family
                    rows.append((len(rows), "Some words of prose\n \t\r\n" + "\n".join(mark + x for x in textwrap.wrap(t, width, break_long_words=False)) + "\n\nmore prose"))
    for t in ("Released to the public\ndomain under CC\n0", "Permission\nis\nhereby", "free and unencumbered software released into the public\r\n// domain"):
        rows.append((len(rows), t))
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == {i for i, _ in rows}
    assert {i: (want[i], rows[i][1]) for i in want if want[i] not in {r["family"] for r in got[i]}} == {}
    assert [(r["paragraph"], r["whole"], r["family"]) for r in got[len(rows) - 1]] == [(0, True, "cc0")]
