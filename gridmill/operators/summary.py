"""Code lists and figures of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import text as X

CODED = ("FREQ", "REF_AREA", "INDICATOR", "COMPOSITE_BREAKDOWN", "UNIT_MEASURE", "UNIT_MULT", "OBS_STATUS")
LABELLED = ("REF_AREA", "INDICATOR", "COMPOSITE_BREAKDOWN")


def code_lists(long: DataFrame, order: Sequence[str], components: Sequence[str] = LABELLED) -> DataFrame:
    """list_id, code, name, ord: _T and _Z first, then each code with its first label in `order`, or itself.

    One pass: the components are unpivoted beside each other and aggregated by code.
    """
    seq = F.struct(*order)
    pairs = F.array(*[F.struct(F.lit(c).alias("list_id"), F.col(c).alias("code"), (F.col(f"{c}_LABEL") if c in LABELLED else F.lit(None).cast("string")).alias("label")) for c in components])
    rows = long.select(seq.alias("seq"), F.explode(pairs).alias("p")).select("seq", "p.*").filter("code is not null")
    first = rows.groupBy("list_id", "code").agg(F.min("seq").alias("seen"), F.min_by("label", F.when(F.coalesce("label", F.lit("")) != "", F.col("seq"))).alias("label"))
    fixed = long.sparkSession.createDataFrame([(c, code, name, k) for c in components for k, (code, name) in enumerate((("_T", "Total"), ("_Z", "Not applicable")))], "list_id string, code string, name string, ord int")
    from pyspark.sql import Window

    ranked = first.filter(~F.col("code").isin("_T", "_Z")).withColumn("ord", F.row_number().over(Window.partitionBy("list_id").orderBy("seen", "code")) + 1)
    return fixed.unionByName(ranked.select("list_id", "code", F.coalesce("label", "code").alias("name"), "ord"))


def unknown_codes(used: DataFrame, official: DataFrame | None, available: DataFrame) -> DataFrame:
    """list_id, available, n_unknown: codes in use that an official list lacks; null where the list isn't available.

    used(list_id, code), official(list_id, code), available(list_id, available boolean).
    """
    distinct = used.select("list_id", "code").distinct()
    missing = distinct.join(official, ["list_id", "code"], "left_anti") if official is not None else distinct
    count = missing.groupBy("list_id").agg(F.count("*").alias("n"))
    lists = distinct.select("list_id").distinct().join(available, "list_id", "left").withColumn("available", F.coalesce("available", F.lit(False)))
    return lists.join(count, "list_id", "left").select("list_id", "available", F.when(F.col("available"), F.coalesce("n", F.lit(0))).cast("long").alias("n_unknown"))


def conformance(counts: DataFrame) -> DataFrame:
    """A sentence for each list: not checked, all codes official, or how many aren't."""
    text = F.when(~F.col("available"), "not checked").when(F.col("n_unknown") == 0, "all codes official").otherwise(F.concat(F.col("n_unknown").cast("string"), F.lit(" codes not official")))
    return counts.select("list_id", text.alias("badge"))


def covered_cells(checks: DataFrame) -> DataFrame:
    """Distinct (page, row, column) that a check names."""
    return checks.filter("row <> ''").agg(F.countDistinct("page", "row", "column").alias("n_covered"))


def run_figures(long: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: tables, pages, observations, shares of identified measures and of covered cells, cells to review."""
    seen = long.agg(
        F.countDistinct("doc", "page", "table_no").alias("n_tables"),
        F.countDistinct("doc", "page").alias("n_pages"),
        F.count("*").alias("n_observations"),
        F.coalesce(F.avg((F.col("INDICATOR") != X.NOT_IDENTIFIED).cast("double")), F.lit(0.0)).alias("identified_share"),
        F.count_if(F.col("COMPOSITE_BREAKDOWN") == X.TOTAL).alias("n_totals"),
    )
    review = checks.agg(F.count_if(F.col("status").isin("fail", "warn")).alias("n_review"))
    both = seen.crossJoin(covered_cells(checks)).crossJoin(review)  # one row each
    return both.withColumn("covered_share", F.least(F.col("n_covered") / F.greatest("n_observations", F.lit(1)), F.lit(1.0))).drop("n_covered")


def review_list(checks: DataFrame, jumps: DataFrame) -> DataFrame:
    """Failures and warnings with their page, then jumps with none."""
    cols = ["page", "name", "status", "detail", "row", "column"]
    return checks.filter("status in ('fail', 'warn')").select(*cols).unionByName(jumps.withColumn("page", F.lit(None).cast("int")).select(*cols))
