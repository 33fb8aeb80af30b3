"""Gate, routing, choice between readings, and donor tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import numbers as N
from gridmill.operators.tables import KEY
from gridmill.options import DEFAULT, Options

PAGE = ("doc", "page")


def body_stats(cells: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows, columns (the label column counts) and shares of cell statuses of each table, from tall cells.

    Cells are summed up by row before tables are, so that distinct rows are counted without sending
    a cell twice; columns are the union of the rows' few different sets of columns.
    """
    statuses = ("ok", "missing", "error")
    by_row = cells.groupBy(*key, "r").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.array_sort(F.collect_set("c")).alias("columns"))
    total = by_row.groupBy(*key).agg(F.count("*").alias("rows"), F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in statuses], F.collect_set("columns").alias("sets"))
    share = {s: F.col(s) / F.greatest("n", F.lit(1)) for s in statuses}
    return total.select(*key, "rows", (F.size(F.array_distinct(F.flatten("sets"))) + 1).cast("long").alias("cols"), share["ok"].alias("numeric_share"), share["missing"].alias("missing_share"), share["error"].alias("unreadable_share"))


def gate(stats: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """stats with accepted, score and reason; the first rule broken names the reason."""
    reason = (
        F.when((F.col("rows") < options.min_rows) | (F.col("cols") < options.min_cols), "too small")
        .when(F.col("numeric_share") < options.min_numeric_share, "too few numbers")
        .when(F.col("unreadable_share") > options.max_unreadable_share, "too many unreadable cells")
    )
    return stats.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn("accepted", F.col("reason") == "ok").withColumn("score", F.round(F.col("numeric_share") * (1 - F.col("unreadable_share")), 3))


def page_routes(pages: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """pages(doc, page, text) with n_digits and route: "vision" without text, "sparse" below the digits a page needs, else "all"."""
    n = N.digit_count(F.col("text"))
    blank = N.strip(F.coalesce("text", F.lit(""))) == ""
    return pages.select("doc", "page", n.cast("long").alias("n_digits"), F.when(blank, "vision").when(n < options.min_page_digits, "sparse").otherwise("all").alias("route"))


def routed(grids: DataFrame, routes: DataFrame, accepted_first: DataFrame, vision: str = "vision", first: str = "text") -> DataFrame:
    """Grids that a page's route lets through; a sparse page keeps later readers only if the first had an accepted table."""
    both = grids.join(routes.select("doc", "page", "route"), list(PAGE), "left").join(accepted_first.select("doc", "page").distinct().withColumn("first_ok", F.lit(True)), list(PAGE), "left")
    keep = F.when(F.col("route") == "vision", F.col("stage") == vision).when((F.col("route") == "sparse") & F.col("first_ok").isNull(), F.col("stage") == first).otherwise(True)
    return both.filter(keep).drop("route", "first_ok")


def best_rejected(gated: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """The rejected table of highest score of each page without an accepted one; the first on ties."""
    order = Window.partitionBy(*page).orderBy(F.desc("score"), "stage_rank", "table_no")
    none = Window.partitionBy(*page)
    return gated.withColumn("any", F.bool_or("accepted").over(none)).filter("not any and not accepted").withColumn("k", F.row_number().over(order)).filter("k = 1").drop("any", "k")


def stage_scores(candidates: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Accepted tables and their failed checks by page and stage; candidates(page…, stage, stage_rank, accepted, failed)."""
    ok = candidates.filter("accepted")
    return ok.groupBy(*page, "stage", "stage_rank").agg(F.count("*").alias("n_tables"), F.sum("failed").alias("failures"))


def _last_rank(candidates: DataFrame, page: Sequence[str]) -> DataFrame:
    """The rank of the first stage of each page whose accepted tables fail no check; null for none."""
    return stage_scores(candidates, page).groupBy(*page).agg(F.min(F.when(F.col("failures") == 0, F.col("stage_rank"))).alias("last_rank"))


def ran(candidates: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Candidates of stages that would have run: none after the first one whose accepted tables fail no check."""
    return candidates.join(_last_rank(candidates, page), list(page), "left").filter("last_rank is null or stage_rank <= last_rank").drop("last_rank")


def winners(candidates: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """The stage that wins each page: most accepted tables, then fewest failures, then the order of stages.

    Stages after the first one without failures don't take part, as if they had never run.
    """
    scores = stage_scores(candidates, page)
    run = scores.join(_last_rank(candidates, page), list(page)).filter("last_rank is null or stage_rank <= last_rank")
    best = run.groupBy(*page).agg(F.min(F.struct((-F.col("n_tables")).alias("n"), "failures", "stage_rank", "stage")).alias("w"))
    return best.select(*page, F.col("w.stage").alias("stage"), F.col("w.stage_rank").alias("stage_rank"), (-F.col("w.n")).alias("n_tables"), F.col("w.failures").alias("failures"))


def donors(cells: DataFrame, winner: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """For each table of a winning stage, the other stages' table with the most agreeing cells, above none.

    Tables meet if their data headers are equal lists, cells if row label and column are equal.
    """
    heads = cells.groupBy(*page, "stage", "stage_rank", "table_no").agg(F.array_sort(F.collect_set(F.struct("c", "col_name"))).alias("h"))
    heads = heads.withColumn("header", F.transform("h", lambda x: x["col_name"])).drop("h")
    marked = cells.filter("status = 'ok'").join(heads, [*page, "stage", "stage_rank", "table_no"])
    mine = marked.join(winner.select(*page, "stage"), [*page, "stage"], "left_semi").select(*page, F.col("stage").alias("stage"), F.col("table_no").alias("table_no"), "header", "row_label", "c", "value")
    other = marked.join(winner.select(*page, "stage"), [*page, "stage"], "left_anti").select(*page, F.col("stage").alias("donor_stage"), F.col("stage_rank").alias("donor_rank"), F.col("table_no").alias("donor_table"), "header", "row_label", "c", "value")
    agreed = mine.join(other, [*page, "header", "row_label", "c", "value"]).groupBy(*page, "stage", "table_no", "donor_stage", "donor_rank", "donor_table").agg(F.count("*").alias("n_agree"))
    best = agreed.groupBy(*page, "stage", "table_no").agg(F.min(F.struct((-F.col("n_agree")).alias("n"), "donor_rank", "donor_table", "donor_stage")).alias("d"))
    return best.select(*page, "stage", "table_no", F.col("d.donor_stage").alias("donor_stage"), F.col("d.donor_table").alias("donor_table"), (-F.col("d.n")).alias("n_agree"))


def provenance(rows: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """resolved_by for each page: the winner, then other stages that gave rows, sorted, joined by +; rows(page…, winner, source)."""
    return rows.groupBy(*page).agg(F.min("winner").alias("winner"), F.array_sort(F.collect_set("source")).alias("s")).select(
        *page, F.coalesce(F.array_join(F.concat(F.array("winner"), F.filter("s", lambda x: x != F.col("winner"))), "+"), F.lit("manual")).alias("resolved_by")
    )


def dataset_gate(long: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """One row: rows, error_share, accepted; a table below the rows or above the share is refused."""
    got = long.agg(F.count("*").alias("rows"), F.coalesce(F.avg((F.col("OBS_STATUS") != "A").cast("double")), F.lit(0.0)).alias("error_share"))
    return got.withColumn("accepted", (F.col("rows") >= options.min_dataset_rows) & (F.col("error_share") <= options.max_dataset_error_share))


class DatasetRefused(ValueError):
    """A data set did not pass its gate."""


def require_dataset(long: DataFrame, options: Options = DEFAULT) -> None:
    got = dataset_gate(long, options).first()
    if not got["accepted"]:
        raise DatasetRefused(f"{got['rows']} rows, {got['error_share']:.1%} with errors")


def skip_reason(attempt: Column) -> Column:
    """Why a page gave nothing, from one attempt struct(no, error, stage, n_tables, numeric_share)."""
    return (
        F.when(attempt["stage"] == "no_text_layer", "scanned page")
        .when(attempt["stage"] == "text_scan", "no figures")
        .when(attempt["numeric_share"] < DEFAULT.min_numeric_share, "text table")
    )


def skip_reasons(attempts: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Pages without a table by reason, most frequent first; the first attempt that gives a reason counts, else unreadable."""
    reason = skip_reason(F.struct("stage", "numeric_share"))
    first = attempts.withColumn("reason", reason).groupBy(*page).agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("attempt_no"))).alias("reason"), F.sum("n_tables").alias("n"))
    return first.filter("n = 0").groupBy(F.coalesce("reason", F.lit("unreadable")).alias("reason")).agg(F.count("*").alias("n_pages")).orderBy(F.desc("n_pages"), "reason")


def no_table_reason(attempts: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """One sentence a page: the last gate reason, else the first error, else a fixed one."""
    last = F.max_by("gate_reason", F.when(F.col("gate_reason").isNotNull(), F.col("attempt_no")))
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("attempt_no")))
    return attempts.groupBy(*page).agg(F.coalesce(last, first, F.lit("no table found")).alias("reason"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of pages or documents under one another; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
