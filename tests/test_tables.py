import random

import numpy as np
from pyspark.sql import functions as F

from gridmill.functions import text as X
from gridmill.operators import checks, coding, repair, select, tables
from gridmill.functions.similarity import Shelf, partial_ratio, ratio, weighted_ratio
from gridmill.options import DEFAULT
from gridmill.plans.observations import observe
from gridmill.shared import cut

GRID = [["Région", "Superficie (ha)", "Rendement (kg/ha)", "Production (t)"], ["Agadez", "1 000", "500", "500"], ["Diffa", "2 000", "400", "800"], ["Niger", "3 000", "433", "1 300"]]
SCHEMA = "doc string, page int, stage string, stage_rank int, table_no int, cells array<array<string>>"


def grids(spark, *cells):
    return spark.createDataFrame([("d", i, "text", 0, 0, c) for i, c in enumerate(cells)], SCHEMA)


def fails(spark, grid):
    framed = cut(tables.frames(grids(spark, grid)), "frames")
    cells = cut(tables.tall(framed), "cells")
    return sorted((r["name"], r["row"], r["column"]) for r in checks.run_checks(framed, cells).filter("status = 'fail'").collect())


def changed(r, c, value):
    out = [list(x) for x in GRID]
    out[r][c] = value
    return out


def test_frame_of_a_plain_grid(spark):
    row = tables.frames(grids(spark, GRID)).first()
    assert row["names"] == GRID[0][1:] and row["labels"] == ["Agadez", "Diffa", "Niger"] and (row["rows"], row["cols"]) == (3, 4)


def test_headers_labels_blank_columns_and_empty_grids(spark):
    nested = [["Zone", "Produit", "", "2023", "2023"], ["", "", "", "T1", "T2"], ["Nord", "Mil", "", "1", "2"], ["", "Riz", "", "3", "4"]]
    got = tables.frames(grids(spark, nested, [], None, [["a"]])).orderBy("page").collect()
    assert got[0]["names"] == ["2023 T1", "2023 T2"] and got[0]["labels"] == ["Nord / Mil", "Nord / Riz"] and got[0]["label_name"] == "Zone / Produit"
    assert [r["rows"] for r in got[1:3]] == [0, 0]
    assert tables.tall(tables.frames(grids(spark, [], None))).count() == 0


def test_repeated_names_and_labels(spark):
    got = tables.frames(grids(spark, [["x", "a", "a", ""], ["r", "1", "2", "3"], ["r", "4", "5", "6"]])).first()
    assert got["names"] == ["a", "a_2", "col"] and got["labels"] == ["r", "r (2)"]


def test_clean_table_passes_and_one_cell_fails(spark):
    assert fails(spark, GRID) == []
    assert fails(spark, changed(3, 1, "9 000")) == [("area_x_yield", "Niger", "Production (t)"), ("column_total", "Niger", "Superficie (ha)")]
    assert fails(spark, changed(1, 1, "12 3 4")) == [("column_total", "Niger", "Superficie (ha)") for _ in ()] + [("unreadable", "Agadez", "Superficie (ha)")]


def test_total_without_numbers_is_skipped(spark):
    grid = [["", "2020", "2021", "Total"], ["Nord", "1", "2", "-"], ["Sud", "3", "4", "nd"], ["Total", "-", "-", "-"]]
    framed = cut(tables.frames(grids(spark, grid, [["", "a", "b", "c"], ["x", "1", "2", "3"], ["y", "1", "2", "3"], ["z", "1", "2", "3"]])), "frames")
    cells = cut(tables.tall(framed), "cells")
    got = {(r["page"], r["name"]): (r["status"], r["detail"]) for f in (checks.column_total_check, checks.row_total_check) for r in f(cells).collect()}
    assert got == {
        (0, "column_total"): ("skip", "the total row has no numbers to compare"),
        (0, "row_total"): ("skip", "the total column has no numbers to compare"),
        (1, "column_total"): ("skip", "no total row to compare"),
        (1, "row_total"): ("skip", "no total column to compare"),
    }


def rows_of(spark, *grids_):
    """Tables of the repair kernel, with numbers parsed by Spark."""
    framed = tables.frames(grids(spark, *grids_)).select("page", "stage", "names", "labels", "body", repair._parsed(F.col("body")).alias("parsed")).orderBy("page").collect()
    return [repair.Rows(r["stage"], r["names"], r["labels"], r["body"], [[c.asDict() for c in row] for row in r["parsed"]]) for r in framed]


def test_ledger_counts_what_the_checks_count(spark):
    rng = random.Random(4)
    nested = [["", "2020", "2021"], ["Mil / Superficie", "1 000", "2 000"], ["Mil / Rendement", "500", "400"], ["Mil / Production", "500", "900"], ["Total", "9", "9"]]
    totals = [["", "a", "b", "Ensemble"], ["x", "1", "2", "3"], ["y taux", "1", "5", "9"], ["z", "3", "4", "7"], ["Total", "5", "99", "19"]]
    several = [GRID, changed(3, 1, "9 000"), changed(1, 1, "12 3 4"), changed(2, 3, "5 000 000 000"), changed(2, 2, "-"), nested, totals, [["", "Total 1 234", "b"], ["x", "1", "2"], ["y", "1", "2"]]]
    for _ in range(12):
        several.append([["", "Superficie", "Rendement", "Production", "Total"], *[[label, *[rng.choice(["1", "20", "300", "-", "1 2", "2 000", "0", "9 000 000 000"]) for _ in range(4)]] for label in ("a", "b", "Niger", "prix")]])
    framed = cut(tables.frames(grids(spark, *several)), "frames")
    found = checks.run_checks(framed, cut(tables.tall(framed), "cells")).filter("status = 'fail'").groupBy("page").count().collect()
    want = {r["page"]: r["count"] for r in found}
    each = rows_of(spark, *several)
    ledgers = [repair.Ledger(t.names, t.labels, t.values, t.errors) for t in each]
    assert [x.failures for x in ledgers] == [want.get(i, 0) for i in range(len(several))]
    for t, ledger in zip(each, ledgers):  # rows exchanged one after another, against counts from nothing
        values, errors = t.values.copy(), t.errors.copy()
        for _ in range(6):
            i, k = rng.randrange(len(t.labels)), rng.randrange(len(t.labels))
            values[i], errors[i] = t.values[k] * rng.choice([1, 1, 2]), t.errors[k]
            ledger = ledger.with_row(i, values[i].copy(), errors[i].copy())
            assert ledger.failures == repair.Ledger(t.names, t.labels, values, errors).failures


def test_header_check(spark):
    rows = spark.createDataFrame([("d", 1, "t", 0, ["col", "col_2"]), ("d", 2, "t", 0, ["Total 1 234"]), ("d", 3, "t", 0, ["a", "col_2"])], "doc string, page int, stage string, table_no int, names array<string>")
    assert {r["page"]: r["status"] for r in checks.header_check(rows).collect()} == {1: "fail", 2: "fail", 3: "pass"}


def test_period_jump_skips_series_with_a_period_twice(spark):
    base = dict(FREQ="A", REF_AREA="NE", INDICATOR="P", COMPOSITE_BREAKDOWN="MIL", UNIT_MEASURE="T", UNIT_MULT="0", OBS_STATUS="A", TABLE_TITLE="Tableau 1: Mil en 2020", PAGE=1, TABLE=1, REF_AREA_LABEL="", INDICATOR_LABEL="", COMPOSITE_BREAKDOWN_LABEL="Mil")
    one = [base | dict(TIME_PERIOD=str(y), OBS_VALUE=v) for y, v in ((2020, 1.0), (2021, 10.0), (2022, 11.0))]
    two = [r | dict(REF_AREA="X") for r in one] + [base | dict(REF_AREA="X", TIME_PERIOD="2021", OBS_VALUE=9.0)]
    got = checks.period_jump_check(spark.createDataFrame(one + two)).collect()
    assert [(r["row"], r["column"]) for r in got] == [("NE / P / Mil", "2021")]


def test_repair_takes_agreeing_rows_only(spark):
    head = ["", "a", "b", "Total"]
    bad = [head, ["x", "1", "2", "3"], ["y", "12 3 4", "5", "9"], ["Total", "5", "7", "12"]]
    good = [head, ["x", "1", "2", "3"], ["y", "4", "5", "9"], ["Total", "5", "7", "12"]]
    other = [head, ["x", "1", "2", "3"], ["y", "4", "6", "9"], ["Total", "5", "7", "12"]]
    alone, _ = rows_of(spark, bad, other)
    assert repair.mend(alone, rows_of(spark, other)) == ["text"] * 3
    table = rows_of(spark, bad)[0]
    donors = rows_of(spark, other, good)
    donors[1].stage = "ml"
    assert repair.mend(table, donors) == ["text", "ml", "text"] and table.body[1] == ["4", "5", "9"]
    framed = cut(tables.frames(grids(spark, bad, good)), "frames")
    given = framed.filter("page = 1").select("doc", F.lit(0).alias("page"), "stage", "table_no", F.array(F.struct(F.lit("ml").alias("stage"), "names", "labels", "body")).alias("donors"))
    got = repair.repair(framed, given).orderBy("page").collect()
    assert got[0]["sources"] == ["text", "ml", "text"] and got[0]["body"] == got[1]["body"] and got[1]["sources"] == ["text"] * 3


def test_periods_units_codes(spark):
    def one(f, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()
        return [r["x"] for r in rows]

    assert one(X.time_period, "2023", "2023/24 (p)", "1 T24", "T2-2023", "31 déc-22", "2020 Total", "2 T23r", "S1 2024", "2021 1 T21") == ["2023", "2023-A1", "2024-Q1", "2023-Q2", "2022-12-31", "2020", "2023-Q2", "S1 2024", "2021-Q1"]
    assert one(X.sdmx_code, "kg/ha", "_T", "NE-1", "Tillabéri", "  ", "a (b)", "_") == ["KG_HA", "_T", "NE-1", "TILLABERI", "UNKNOWN", "A_B", "UNKNOWN"]
    assert [(r["unit"], r["mult"]) for r in one(X.unit_and_multiplier, "en milliers de m³", "Rendement (kg/ha)", "rien", None, "Valeur en millions de FCFA (en tonnes)")] == [("M3", "3"), ("KG_HA", "0"), ("", "0"), ("", "0"), ("T", "6")]
    assert one(X.caption_period, "Indice base 100 en 2014, année 2023", "de 2022 à 2023", "rien") == ["2023", "", ""]
    assert one(X.page_period, "2024 2024/2025 2024/2025 2024", "rien") == ["2024/2025", "UNKNOWN"]


def test_axis_and_area_rules(spark):
    vocab = spark.createDataFrame([("Agadez", "NE-1", "REF_AREA", "", "", 0), ("Production", "PROD", "INDICATOR", "t", "", 1), ("Mil", "MIL", "COMPOSITE_BREAKDOWN", "", "", 2)], "label string, code string, dimension string, unit string, note string, ord int")
    labels = spark.createDataFrame([("Mil / Production",), ("production / Mil / rouge",), ("Sorgho",), ("Total / AGADEZ",), ("",)], "label string")
    coded = coding.part_codes(labels, vocab)
    got = {r["label"]: (r["measure"], r["breakdown"], r["breakdown_label"], r["unit"]) for r in coding.split_indicators(coded).collect()}
    assert got["Mil / Production"] == ("PROD", "MIL", "Mil", "t")
    assert got["production / Mil / rouge"] == ("PROD", "MIL", "Mil / rouge", "t")
    assert got["Sorgho"] == (None, "SORGHO", "Sorgho", "") and got[""] == (None, "_T", "", "")
    assert {r["label"]: r["area_code"] for r in coding.resolve_areas(coded).collect()}["Total / AGADEZ"] == "NE"
    fuzzy = coding.codes(spark.createDataFrame([("Agadezz", "REF_AREA"), ("zzz", "REF_AREA")], "label string, dimension string"), vocab)
    assert {r["label"]: r["code"] for r in fuzzy.collect()} == {"Agadezz": "NE-1", "zzz": None}


def test_similarity():
    assert ratio("abcd", "abcd") == 100 and ratio("", "") == 100 and round(ratio("this is a test", "this is a test!"), 2) == 96.55
    assert partial_ratio("this is a test", "this is a test!") == 100
    assert weighted_ratio("", "a") == 0 and weighted_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 95


def by_definition(a, b):
    """The weighted ratio from its published definition, with the textbook table of common subsequences."""

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            out = [0]
            for j, d in enumerate(y):
                out.append(row[j] + 1 if c == d else max(row[j + 1], out[j]))
            row = out
        return row[-1]

    def plain(x, y):
        return 100.0 if not x and not y else 200.0 * lcs(x, y) / (len(x) + len(y))

    def stretch(x, y):
        x, y = sorted((x, y), key=len)
        if not x:
            return 0.0
        return max(plain(x, y[max(0, i) : i + len(x)]) for i in range(1 - len(x), len(y)))

    def tokens(x, y, f):
        p, q = set(x.split()), set(y.split())
        both, mine, other = sorted(p & q), sorted(p - q), sorted(q - p)
        found = [f(" ".join(sorted(x.split())), " ".join(sorted(y.split())))]
        if both and not (mine and other):
            found.append(100.0)
        joined = [" ".join(both), " ".join(both + mine), " ".join(both + other)]
        found.append(f(joined[1], joined[2]))
        if both:
            found += [f(joined[0], joined[1]), f(joined[0], joined[2])]
        return max(found)

    a, b = ("".join(c if c.isalnum() else " " for c in x).lower().strip() for x in (a, b))
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(plain(a, b), 0.95 * tokens(a, b, plain))
    scale = 0.9 if spread < 8 else 0.6
    return max(plain(a, b), scale * stretch(a, b), 0.95 * scale * tokens(a, b, stretch))


def test_fuzzy_codes_equal_all_pairs(spark):
    rng = random.Random(9)
    words = ["mil", "sorgho", "production", "superficie", "riz", "irrigué", "pluvial", "total", "niébé", "rendement", "rend", "prod"]
    entries = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)})

    def typo(text):
        t = list(text)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], [rng.choice("aeioxy ")], [t[i], t[i]]])
            t = t or ["a"]
        return "".join(t)

    labels = sorted({typo(rng.choice(entries)) for _ in range(150)} | {"", "x", "  ", "prod prod prod", "total de production de sorgho pluvial et irrigué et superficie"})
    for threshold in (88.0, 80.0, 60.0):
        shelf = Shelf([(e,) for e in entries])
        for text in labels:
            scores = [by_definition(text, e) for e in entries]
            top = max(scores)
            want = None if top < threshold else (top, (entries[scores.index(top)],))
            got = shelf.best(text, threshold)
            assert (got is None) == (want is None) and (got is None or (abs(got[0] - want[0]) < 1e-9 and got[1] == want[1])), text
    vocab = spark.createDataFrame([(e, f"C{i}", "INDICATOR", "", "", i) for i, e in enumerate(entries)], "label string, code string, dimension string, unit string, note string, ord int")
    got = {r["label"]: (r["code"], r["score"]) for r in coding.fuzzy_codes(spark.createDataFrame([(t, "INDICATOR") for t in labels], "label string, dimension string"), vocab).collect()}
    for text in labels:
        scores = [by_definition(text, e) for e in entries]
        want = (None, None) if max(scores) < 88 else (f"C{scores.index(max(scores))}", max(scores))
        assert got[text][0] == want[0] and (want[1] is None or abs(got[text][1] - want[1]) < 1e-9), text


def test_whole_plan(spark):
    g = grids(spark, GRID, changed(3, 1, "9 000"))
    context = g.select("doc", "page", "stage", "table_no", F.lit("Tableau 1: Mil").alias("title"), F.lit("").alias("unit"), F.lit("UNKNOWN").alias("subject"), F.lit("2023").alias("period"), F.lit("f.pdf").alias("source"))
    vocab = spark.createDataFrame([("Agadez", "NE-1", "REF_AREA", "", "", 0), ("Diffa", "NE-2", "REF_AREA", "", "", 1), ("Niger", "NE", "REF_AREA", "", "", 2), ("Production (t)", "PROD", "INDICATOR", "t", "", 3)], "label string, code string, dimension string, unit string, note string, ord int")
    long = observe(g, context, vocab).long.collect()
    assert len(long) == 18
    one = next(r for r in long if r["page"] == 0 and r["REF_AREA"] == "NE-1" and r["INDICATOR"] == "PROD")
    assert (one["OBS_VALUE"], one["UNIT_MEASURE"], one["TIME_PERIOD"], one["FREQ"], one["OBS_STATUS"]) == (500.0, "T", "2023", "A", "A")
    assert sorted((r["REF_AREA"], r["OBS_VALUE"]) for r in long if r["page"] == 1 and r["OBS_STATUS"] == "U") == [("NE", 1300.0), ("NE", 9000.0)]
