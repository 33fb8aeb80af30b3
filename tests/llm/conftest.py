import random

import pytest

SCHEMA = "doc_id long, text string, id long, fp long, grp long, spans string, score double, name string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, personal data, and every odd case."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(60, 200)) for _ in range(40)]
    passage = words(rng, 60)
    out = list(base)
    out += [base[0], base[0].upper(), base[1] + " tail", "x " + base[2]]
    for k in range(3):
        w = base[3].split()
        w[10 * k + 5] = "changed"
        out.append(" ".join(w))
    out += [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(4)]
    out += ["a b c " * 40, "same " * 100, "same " * 60 + "end", "one", "", "   \n\t ", None, None, "mail a.b@c.de or x@y, +1 (017) 555-7713 and 10.0.0.255, 4111 1111 1111 1111", "tab\tand\x0bfeed\x1c unit space é ß"]
    out.append(words(rng, 30_000))
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with repeated rows, null ids and columns whose names clash with the operators' own."""
    rows = [(i, t, 7, 1, 2, "s", 0.5, "n", len(t or "")) for i, t in enumerate(corpus)]
    rows += [rows[5], rows[5], (None, corpus[6], 1, 1, 1, "", 1.0, "", 1), (None, None, 1, 1, 1, "", 1.0, "", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
