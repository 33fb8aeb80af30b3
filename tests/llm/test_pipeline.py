import importlib.util

import pytest
from pyspark.sql import functions as F

from gridmill.llm import queries

DIR = "/root/testdata/sf0.001"


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, DIR)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(str, df.select(*names).collect())) == sorted(str(df.select(*names).limit(0).sparkSession.createDataFrame([r], df.select(*names).schema).first()) for r in want.fetchall())


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline file")
def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first = docs
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), first.schema)
        assert 0 < docs.count() <= before, name
    assert docs.filter(F.col("text").rlike("[0-9]@mail[0-9]")).count() == 0
    assert docs.select("text").distinct().count() == docs.count()
    pieces = p.STAGES[-1][1](spark, docs, DIR)
    assert pieces.select("doc_id").distinct().count() == docs.count()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline file")
def test_stages_take_odd_rows(spark, docs, empty):
    """Nulls, empty and very long texts, repeated rows, clashing names and empty tables go through every stage."""
    import corpus_pipeline as p

    odd, none = docs.cache(), empty
    for name, stage in p.STAGES:
        got = stage(spark, odd, DIR)
        rows = got.collect()
        assert stage(spark, none, DIR).count() == 0, name
        if name != p.STAGES[-1][0]:
            assert got.columns == docs.columns and len(rows) <= docs.count(), name
        else:
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_queries_equal_their_contracts(spark):
    """op1, op2, op4, op6, op7 and op8 through their own functions, against plain versions on the smallest tables."""
    import hashlib
    import re
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    import xxhash
    from tokenizers import Tokenizer

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}

    one, eight = (Tokenizer.from_file(queries.vocabulary(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = {i: np.array(one.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in texts.items()}
    seqs, total = defaultdict(list), Counter()
    for r in queries.op1_packing(spark, DIR).collect():
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(x) for i, x in ids.items()}
    for s in seqs.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert ends[-1] <= 1024 and [o for o, _ in sorted(s)] == [0, *ends[:-1]]

    from tests.llm.test_operators import base_spans, print_of
    from gridmill.llm import pii

    for r in queries.op2_pii(spark, DIR).collect():
        base = [(pii.KINDS[k], a, b) for a, k, b in base_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]

    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for r in queries.op4_substring_dedup(spark, DIR).collect():
        w = words[r["doc_id"]]
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), gone.sum(), hashlib.sha256(kept.encode()).hexdigest())

    for r in queries.op6_quality_rules(spark, DIR).collect():
        w = words[r["doc_id"]]
        times, cover = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(len(w) - 4):
            if times[tuple(w[k : k + 5])] > 1:
                cover.update(range(k, k + 5))
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (len(w), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))

    prints = {i: print_of(t) for i, t in texts.items()}
    for r in queries.op7_simhash(spark, DIR).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] <= r["doc_id"]

    at = 0
    got = {r["doc_id"]: r for r in queries.op8_token_output(spark, DIR).collect()}
    for i in sorted(texts):
        x = np.array(eight.encode(texts[i], add_special_tokens=False).ids + [1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    nine = queries.op9_quality_classifier(spark, DIR).collect()
    held = [r for r in nine if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in nine)
    assert len(nine) == len(texts) and sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.8 * len(held)
    five = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, DIR).collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    assert {(i, k) for i, t in texts.items() for k, x in items.items() if x and x in t} <= five


def test_op10_gives_notices_over_any_number_of_lines(spark, tmp_path):
    """The rows of its SQL, all of them, and each notice that only its whole paragraph shows, against a plain version."""
    import random
    import re
    import textwrap
    from collections import Counter

    import duckdb

    from gridmill.llm import licenses

    weights, bias, least = licenses.model()
    rng, texts, wrapped = random.Random(3), [None, "", "\n\n", "no cue\nat all"], {}
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    for family, t in notices:
        for mark in ("", " * ", "# "):
            wrapped[len(texts)] = family
            texts.append("Words before\n \t\r\n" + "\n".join(mark + x for x in textwrap.wrap(t, 12, break_long_words=False)) + "\n\nwords after")
    for _ in range(150):
        words = " ".join(rng.choice([rng.choice(notices)[1], rng.choice(licenses.OTHERS), "plain words of no use"]) for _ in range(rng.randint(1, 3))).split(" ")
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\n", "\r\n// ", "\n\n"][: rng.choice([4, 5, 6])]) for w in words))
    beside = len(texts)
    texts.append("Released under the MIT License\n" + "\n".join(textwrap.wrap(licenses.TEMPLATES["bsd"][1], 18)))
    texts += texts[10:12]
    spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(text):
        gs = licenses.grams(text)
        scores = [b + sum(weights[g][c] for g in gs if g in weights) for c, b in enumerate(bias)]
        best = max(range(len(scores) - 1), key=lambda c: (scores[c], -c))
        margin = scores[best] - scores[-1]
        if margin <= least:
            return "unknown", margin, 0, "unknown"
        family = licenses.CLASSES[best]
        overlap = max(100 * len(set(gs) & set(t)) // len(t) for _, f, t in licenses.templates() if f == family)
        return family, margin, overlap, family if overlap >= licenses.OVERLAP else "unknown"

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(queries.ORACLE_SQL["op10_licenses"]).fetchall()
    named = {(i, n): (near, family) for i, n, near, *_, family in sql if family != "unknown"}
    whole = []
    for i, t in enumerate(texts):
        first, lines = 0, (t or "").split("\n")
        for n, line in enumerate([*lines, ""]):
            if line.strip(" \t\r"):
                continue
            part, own = " ".join(lines[first:n]).lower(), {k: named[i or None, k] for k in range(first, n) if (i or None, k) in named}
            gone = set()
            for k, (near, family) in own.items():
                span = range(k - licenses.BEFORE, k + licenses.AFTER + 1) if near else [k]
                if not (near and any(own.get(x) == (False, family) for x in span)):
                    gone.update(span)
            left = [k for k in range(first, n) if k not in gone]
            cues = [k for k in range(first, n) if any(c in lines[k].lower() for c in licenses.CUES)]
            read = not own and any(k - first <= licenses.BEFORE and k + licenses.AFTER >= n - 1 for k in cues)
            if left and not read and any(c in part or c in re.sub("[^a-z0-9]+", " ", part) for c in licenses.CUES):
                got = plain(" ".join(lines[k] for k in left))
                if got[-1] not in {"unknown", *(family for _, family in own.values())}:
                    whole.append((i or None, left[0], True, *got))
            first = n + 1

    rows = [tuple(r) for r in queries.op10_licenses(spark, str(tmp_path)).collect()]
    assert Counter(rows) == Counter(sql) + Counter(whole)
    assert {(i, f) for i, f in wrapped.items()} | {(beside, "mit"), (beside, "bsd")} <= {(r[0], r[-1]) for r in rows}
    assert {i for i, f in wrapped.items() if (i, f) not in {(r[0], r[-1]) for r in sql}} != set()
