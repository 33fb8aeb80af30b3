"""Audit against an external series, score against typed truth, and the list of labels still to name."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import text as X
from gridmill.functions.similarity import ratio
from gridmill.options import DEFAULT, Options

PLACEHOLDERS = ("UNKNOWN", "not identified")


def portal_audit(ours: DataFrame, portal: DataFrame, areas: DataFrame, share: float = 0.005, absolute: float = 1.0) -> DataFrame:
    """For each (area, breakdown) of ours the portal value of least gap, with gap, relative_gap and agrees.

    ours(REF_AREA, COMPOSITE_BREAKDOWN, OBS_VALUE), portal(portal_area, COMPOSITE_BREAKDOWN, TYPE_CULTURE,
    OBS_VALUE), areas(portal_area, REF_AREA). Portal areas without a match are dropped.
    """
    named = portal.join(areas, "portal_area").select("REF_AREA", "COMPOSITE_BREAKDOWN", "TYPE_CULTURE", F.col("OBS_VALUE").alias("portal_value"))
    both = ours.select("REF_AREA", "COMPOSITE_BREAKDOWN", F.col("OBS_VALUE").alias("report_value")).join(named, ["REF_AREA", "COMPOSITE_BREAKDOWN"]).filter("report_value is not null and portal_value is not null")
    gap = F.abs(F.col("report_value") - F.col("portal_value"))
    best = both.withColumn("gap", gap).groupBy("REF_AREA", "COMPOSITE_BREAKDOWN").agg(F.min(F.struct("gap", "TYPE_CULTURE", "portal_value", "report_value")).alias("b"))
    out = best.select("REF_AREA", "COMPOSITE_BREAKDOWN", "b.report_value", "b.TYPE_CULTURE", "b.portal_value", "b.gap")
    relative = F.try_divide(F.col("gap"), F.abs("portal_value"))
    out = out.withColumn("relative_gap", relative)
    return out.withColumn("agrees", F.coalesce(F.col("relative_gap") < share, F.lit(False)) | (F.col("gap") <= absolute))


def audit_summary(ours: DataFrame, audited: DataFrame) -> DataFrame:
    """One row: n_ours, n_matched, n_agreeing, n_differing, n_report_only."""
    n = ours.agg(F.count("*").alias("n_ours"))
    m = audited.agg(F.count("*").alias("n_matched"), F.count_if("agrees").alias("n_agreeing"))
    return n.crossJoin(m).select("n_ours", "n_matched", "n_agreeing", (F.col("n_matched") - F.col("n_agreeing")).alias("n_differing"), (F.col("n_ours") - F.col("n_matched")).alias("n_report_only"))


def truth_scores(truth: DataFrame, cells: DataFrame, key: Sequence[str], tolerance: float = 0.5) -> DataFrame:
    """key, n_cells, n_hits, share of each table with a truth; a truth cell is hit if the first row and column that hold its labels have its value.

    truth(key…, row, column, value); cells are tall cells with the key. Labels meet below their table's
    key, by equality or containment, so pairs are those of one table's labels; a table that wasn't read
    has no hits.
    """
    rows = _match(truth.select(*key, F.col("row").alias("wanted")), cells.select(*key, F.col("row_label").alias("label"), F.col("r").alias("ord")), key).select(*key, F.col("wanted").alias("row"), F.col("ord").alias("r"))
    cols = _match(truth.select(*key, F.col("column").alias("wanted")), cells.select(*key, F.col("col_name").alias("label"), F.col("c").alias("ord")), key).select(*key, F.col("wanted").alias("column"), F.col("ord").alias("c"))
    found = truth.join(rows, [*key, "row"], "left").join(cols, [*key, "column"], "left").join(cells.select(*key, "r", "c", F.col("value").alias("read")), [*key, "r", "c"], "left")
    return found.groupBy(*key).agg(F.count("*").alias("n_cells"), F.count_if(F.abs(F.col("value") - F.col("read")) <= tolerance).alias("n_hits")).withColumn("share", F.coalesce(F.try_divide("n_hits", "n_cells"), F.lit(0.0)))


def _match(wanted: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """The first label of the table, in order, that equals, or contains, each wanted text."""
    w = wanted.distinct().withColumn("w", X.normal(F.col("wanted")))
    each = labels.groupBy(*key, X.normal(F.col("label")).alias("t")).agg(F.min("ord").alias("ord"))
    return w.join(each, list(key)).filter(F.col("t").contains(F.col("w"))).groupBy(*key, "wanted").agg(F.min("ord").alias("ord"))


def label_counts(long: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """dimension, label, n: non-blank labels of each dimension; `pairs` maps dimension to its label column."""
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("label")) for d, c in pairs.items()])
    return long.select(F.explode(each).alias("p")).select("p.*").filter("label is not null and trim(label) <> ''").groupBy("dimension", "label").agg(F.count("*").alias("n"))


def clusters(counts: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """dimension, label, n, variants: spellings of one code are summed under the most frequent one.

    Labels go by falling count; each one absorbs later ones whose codes are as similar as the
    threshold. That order makes it sequential in a dimension. Labels can only be similar if their
    codes' lengths differ by less than a tenth, so bands of neighbouring lengths are compared, and
    exact codes are summed first, in Spark; the kernel gets distinct codes only.
    """
    coded = counts.filter(~F.col("label").isin(*PLACEHOLDERS)).withColumn("code", X.sdmx_code(F.col("label")))
    first = coded.groupBy("dimension", "code").agg(F.max_by("label", F.struct("n", F.col("label"))).alias("label"), F.sum("n").alias("n"), F.array_sort(F.collect_set("label")).alias("variants"))

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["n", "label"], ascending=[False, True]).to_dict("records")
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by_length.setdefault(len(r["code"]), []).append(i)
        taken, out = set(), []
        for i, r in enumerate(rows):
            if i in taken:
                continue
            taken.add(i)
            n, names = r["n"], list(r["variants"])
            k = len(r["code"])
            for m in range(int(k * 0.9), int(k * 1.11) + 2):
                for j in by_length.get(m, ()):
                    if j not in taken and ratio(r["code"], rows[j]["code"]) >= options.cluster_threshold:
                        taken.add(j)
                        n += rows[j]["n"]
                        names += list(rows[j]["variants"])
            out.append((r["dimension"], r["label"], n, sorted(set(names) - {r["label"]})))
        return pd.DataFrame(out, columns=["dimension", "label", "n", "variants"])

    return first.groupBy("dimension").applyInPandas(kernel, "dimension string, label string, n long, variants array<string>")


def worklist(grouped: DataFrame, counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """dimension, label, observations, share, cumulative, already_named, by falling count; shares are of all labels, placeholders too."""
    total = counts.groupBy("dimension").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "label")
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = vocabulary.select("dimension", F.lower("label").alias("folded")).distinct().withColumn("already_named", F.lit(True))
    rows = grouped.join(total, "dimension").withColumn("run", running).withColumn("folded", F.lower("label")).join(named, ["dimension", "folded"], "left")
    return rows.select("dimension", "label", F.col("n").alias("observations"), F.round(F.col("n") / F.col("total"), 4).alias("share"), F.round(F.col("run") / F.col("total"), 4).alias("cumulative"), F.coalesce("already_named", F.lit(False)).alias("already_named"))


def coverage(listed: DataFrame, tops: tuple[int, ...] = (25, 100, 200)) -> DataFrame:
    """dimension, top, cumulative: the share that the first 25, 100 and 200 labels cover."""
    order = Window.partitionBy("dimension").orderBy(F.desc("observations"), "label")
    ranked = listed.withColumn("k", F.row_number().over(order))
    return ranked.select("dimension", "k", "cumulative", F.explode(F.array(*[F.lit(t) for t in tops])).alias("top")).filter("k <= top").groupBy("dimension", "top").agg(F.max("cumulative").alias("cumulative"))


def metrics(scores: DataFrame) -> DataFrame:
    """One row over truth scores of all tables: hits and cells summed, and their share."""
    return scores.agg(F.sum("n_cells").alias("n_cells"), F.sum("n_hits").alias("n_hits")).withColumn("share", F.coalesce(F.try_divide("n_hits", "n_cells"), F.lit(0.0)))

