"""The whole path: readings of pages by several readers to observations, checks, period jumps and a review list.

All readers' tables are gated and checked at once; what a reader would not have been asked for is left
out afterwards, by page: readers other than the vision reader on pages without text, later readers on
pages with few digits where the first found nothing, and readers after one whose tables all pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import text as X
from gridmill.operators import checks, coding, repair, select, summary, tables
from gridmill.operators.select import PAGE
from gridmill.operators.tables import KEY
from gridmill.options import DEFAULT, Options
from gridmill.shared import cut


@dataclass(frozen=True)
class Resolved:
    """Tables of the winning readers: framed (with sources, the reader of each row), winners and the best rejected tables."""

    framed: DataFrame
    winners: DataFrame
    rejected: DataFrame
    attempts: DataFrame


@dataclass(frozen=True)
class Run:
    """What a run gives; cells, checks and long are tables in the shared folder."""

    resolved: Resolved
    cells: DataFrame
    checks: DataFrame
    long: DataFrame
    jumps: DataFrame
    review: DataFrame


def candidates(framed: DataFrame, cells: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Each table with its gate (accepted, score, reason) and, if accepted, its number of failed checks; tables without data columns vanish."""
    live = framed.filter("cols >= 2").select(*KEY, "stage_rank")
    stats = live.join(select.body_stats(cells), list(KEY), "left").na.fill({"rows": 0, "cols": 0, "numeric_share": 0.0, "missing_share": 0.0, "unreadable_share": 0.0})
    gated = cut(select.gate(stats, options), "gated")
    accepted = gated.filter("accepted").select(*KEY)
    found = checks.run_checks(framed.join(accepted, list(KEY), "left_semi"), cells.join(accepted, list(KEY), "left_semi"), KEY, options)
    failed = found.groupBy(*KEY).agg(F.count_if(F.col("status") == "fail").alias("failed"))
    return gated.join(failed, list(KEY), "left")


def resolve(grids: DataFrame, pages: DataFrame, options: Options = DEFAULT, first: str = "text", vision: str = "vision") -> Resolved:
    """Reads grids (doc, page, stage, stage_rank, table_no, cells) of pages (doc, page, text) to the tables that win, repaired."""
    framed = cut(tables.frames(tables.english_to_french(grids, pages, options), KEY, options, more=["stage_rank"]), "readings")
    cells = cut(tables.tall(framed, KEY, more=["stage_rank"]), "cells")
    judged = candidates(framed, cells.drop("stage_rank"), options)
    routes = select.page_routes(pages, options)
    seen = cut(select.routed(judged, routes, judged.filter((F.col("stage") == first) & F.col("accepted")), vision, first), "candidates")
    ran = select.ran(seen)
    won = select.winners(seen)
    accepted = ran.filter("accepted").select(*KEY)
    given = select.donors(cells.join(accepted, list(KEY), "left_semi"), won)
    donor = framed.select("doc", "page", F.col("stage").alias("donor_stage"), F.col("table_no").alias("donor_table"), F.struct("stage", "names", "labels", "body").alias("d"))
    donors = given.join(donor, ["doc", "page", "donor_stage", "donor_table"]).select(*KEY, F.array("d").alias("donors"))
    mine = framed.join(accepted, list(KEY), "left_semi").join(won.select("doc", "page", "stage"), ["doc", "page", "stage"], "left_semi")
    mended = cut(repair.repair(mine, donors, KEY, options), "resolved")
    attempts = ran.groupBy("doc", "page", "stage", "stage_rank").agg(F.count("*").alias("n_tables"), F.count_if("accepted").alias("n_accepted"), F.sum("failed").alias("failures"))
    return Resolved(mended, won, select.best_rejected(ran), attempts)


def captioned(framed: DataFrame, pages: DataFrame, source: DataFrame | None = None, period: str = "", unit: str = "", subject: str = "UNKNOWN") -> DataFrame:
    """The context of each table: the caption at its place on the page, its unit, and a default period.

    Captions and tables meet by position; a table without a caption has an empty title. The period is
    the one given, else the caption's, else the page's; the unit is the one below the caption, else the
    one given, else what the caption says. `source` has doc and source; without it the document is the source.
    """
    place = framed.select(*KEY, (F.row_number().over(Window.partitionBy(*PAGE).orderBy("table_no")) - 1).alias("place"))
    headings = pages.select(*PAGE, F.posexplode(X.captions(F.col("text"))).alias("place", "h")).select(*PAGE, "place", F.col("h.title").alias("title"), F.col("h.unit").alias("printed_unit"))
    named = place.join(headings, [*PAGE, "place"], "left").withColumn("title", F.coalesce("title", F.lit("")))
    named = named.join(pages.select(*PAGE, X.page_period(F.coalesce("text", F.lit(""))).alias("page_period")), list(PAGE), "left")
    files = named.join(source, "doc", "left").withColumn("source", F.coalesce("source", "doc")) if source is not None else named.withColumn("source", F.col("doc"))

    def filled(*texts):
        return F.coalesce(*[F.when(c != "", c) for c in texts], F.lit(""))

    return files.select(
        *KEY,
        "title",
        filled(F.col("printed_unit"), F.lit(unit.strip()), F.col("title")).alias("unit"),
        F.lit(subject).alias("subject"),
        filled(F.lit(period.strip()), X.caption_period(F.col("title")), F.coalesce("page_period", F.lit("UNKNOWN"))).alias("period"),
        "source",
    )


def run(grids: DataFrame, pages: DataFrame, vocabulary: DataFrame, source: DataFrame | None = None, fuzzy: bool = True, options: Options = DEFAULT) -> Run:
    """From readings and page texts to observations; period jumps look over all pages and documents at once."""
    resolved = resolve(grids, pages, options)
    framed = resolved.framed
    cells = tables.tall(framed, KEY, more=["sources"])
    cells = cut(cells.withColumn("method", F.element_at("sources", F.col("r") + 1)).drop("sources"), "resolved-cells")
    found = cut(checks.run_checks(framed, cells, KEY, options), "checks")
    long = cut(coding.to_long(cells, found, captioned(framed, pages, source), vocabulary, KEY, fuzzy, options), "long")
    jumps = checks.period_jump_check(long, options)
    return Run(resolved, cells, found, long, jumps, summary.review_list(found, jumps))
