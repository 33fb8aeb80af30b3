"""Arithmetic checks on tall cells; each returns key, name, status, detail, row, column.

Tall cells have key columns, r, row_label, c, col_name, value and status. Every check is an
aggregation or window below the table's key; `by_table` deals the cells once by that key, and all
groupings that start with it reuse the dealing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import text as X
from gridmill.functions.numbers import SPACE, strip
from gridmill.operators.tables import KEY
from gridmill.options import DEFAULT, Options

# Words in names that decide which checks apply. Fixed values.
RATE = r"(?iU)kg/ha|%|taux|rendement|moyen|ratio|prix|indice|part\b"
AREA, YIELD, PRODUCTION = r"(?iU)superficie|surface", r"(?iU)rendement", r"(?iU)production"
PLACEHOLDER = r"^col(_[0-9]+)?$"
GLUED_VALUE = rf"[0-9]{{1,3}}(?:{SPACE}[0-9]{{3}})+"

COLUMNS = ("name", "status", "detail", "row", "column")


def by_table(cells: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return cells.repartition(*[F.col(k) for k in key])


def total_word(options: Options) -> str:
    return rf"(?iU)\b(total|ensemble|national|\Q{options.country_name}\E)\b"


def _check(rows: DataFrame, key: Sequence[str], name: str, status: Column | str, detail: Column, row: Column | None = None, column: Column | None = None) -> DataFrame:
    verdict = F.lit(status) if isinstance(status, str) else status
    return rows.select(*key, F.lit(name).alias("name"), verdict.alias("status"), detail.alias("detail"), (row if row is not None else F.lit("")).alias("row"), (column if column is not None else F.lit("")).alias("column"))


def _share(gap: Column) -> Column:
    return F.concat(F.format_number(gap * 100, 1), F.lit("%"))


def close_enough(actual: Column, expected: Column, options: Options) -> Column:
    return (F.abs(actual - expected) / F.greatest(F.abs(expected), F.lit(1.0)) <= options.sum_tolerance) | (F.abs(actual - expected) <= options.absolute_tolerance)


def header_check(framed: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Fails a table whose data columns are all placeholders or whose names hold a grouped number; needs `names`."""
    none = F.forall("names", lambda n: n.rlike(PLACEHOLDER)) & (F.size("names") > 0)
    glued = F.exists("names", lambda n: n.rlike(GLUED_VALUE))
    detail = F.when(none, "no header row").when(glued, "a value stands in a column name").otherwise("columns have names")
    return _check(framed, key, "header", F.when(none | glued, "fail").otherwise("pass"), detail)


def unreadable_check(cells: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """A fail for each unreadable cell; one pass for a table without any."""
    bad = _check(cells.filter("status = 'error'"), key, "unreadable", "fail", F.concat(F.lit("not a number: "), F.col("raw")), F.col("row_label"), F.col("col_name"))
    clean = cells.groupBy(*key).agg(F.count_if(F.col("status") == "error").alias("n")).filter("n = 0")
    return bad.unionByName(_check(clean, key, "unreadable", "pass", F.lit("every cell is a number or missing")))


def bounds_check(cells: DataFrame, key: Sequence[str] = KEY, options: Options = DEFAULT) -> DataFrame:
    """A warning for each column with negatives that is no rate, a fail for one beyond the bound, else one pass a table."""
    low = F.bool_or(F.coalesce(F.col("value") < 0, F.lit(False))) & ~F.col("col_name").rlike(RATE)
    high = F.bool_or(F.coalesce(F.abs("value") > options.upper_bound, F.lit(False)))
    columns = cells.groupBy(*key, "c", "col_name").agg(low.alias("low"), high.alias("high"))
    warned = _check(columns.filter("low"), key, "bounds", "warn", F.lit("negative values"), column=F.col("col_name"))
    failed = _check(columns.filter("high"), key, "bounds", "fail", F.lit("values beyond the bound"), column=F.col("col_name"))
    clean = columns.groupBy(*key).agg(F.bool_or(F.col("low") | F.col("high")).alias("any")).filter("not any")
    return reduce(DataFrame.unionByName, [warned, failed, _check(clean, key, "bounds", "pass", F.lit("values within bounds"))])


def _sum_status(actual: Column, expected: Column, row: Column, column: Column, options: Options) -> Column:
    return F.when(close_enough(actual, expected, options), "pass").when(row.rlike(RATE) | column.rlike(RATE), "warn").otherwise("fail")


def _sum_detail(actual: Column, expected: Column) -> Column:
    gap = F.abs(actual - expected) / F.greatest(F.abs(expected), F.lit(1.0))
    return F.concat(F.lit("total "), F.format_number(actual, 1), F.lit(" vs sum of parts "), F.format_number(expected, 1), F.lit(" ("), _share(gap), F.lit(")"))


def _exact_sum(value: Column) -> Column:
    """Sum that doesn't depend on the order of rows, for values of up to four decimals."""
    return F.sum(value.cast("decimal(28,4)")).cast("double")


def _or_skip(verdicts: DataFrame, key: Sequence[str], name: str, none: str) -> DataFrame:
    """Checks of each table's (pass, fail, warn) structs in arrays `found`; one skip for a table without any."""
    kind = "array<struct<status:string,detail:string,row:string,column:string>>"
    listed = verdicts.groupBy(*key).agg(F.flatten(F.collect_list("found")).alias("found"), F.bool_or("comparable").alias("comparable"))
    detail = F.when(F.col("comparable"), F.lit(f"the {none} has no numbers to compare")).otherwise(f"no {none} to compare")
    skip = F.array(F.struct(F.lit("skip").alias("status"), detail.alias("detail"), F.lit("").alias("row"), F.lit("").alias("column"))).cast(kind)
    return listed.select(*key, F.lit(name).alias("name"), F.inline(F.when(F.size("found") > 0, F.col("found").cast(kind)).otherwise(skip)))


def column_total_check(cells: DataFrame, key: Sequence[str] = KEY, options: Options = DEFAULT) -> DataFrame:
    """Each total row against the sum of the rows that are no totals; skipped without one, below three rows, or where nothing can be compared."""
    total = F.col("row_label").rlike(total_word(options))
    return _total_check(cells, key, "column_total", total, "c", "total row", options)


def row_total_check(cells: DataFrame, key: Sequence[str] = KEY, options: Options = DEFAULT) -> DataFrame:
    """Each row's total columns against the sum of its other columns; skipped without one, below three columns, or where nothing can be compared."""
    total = F.col("col_name").rlike(total_word(options))
    return _total_check(cells, key, "row_total", total, "r", "total column", options)


def _total_check(cells: DataFrame, key: Sequence[str], name: str, total: Column, line: str, none: str, options: Options) -> DataFrame:
    """Totals against parts along each line (a column or a row): one aggregation by line, one by table.

    A column's parts must not sum to nothing; a row's may.
    """
    marked = cells.withColumn("is_total", total)
    part = F.when(~F.col("is_total"), F.col("value"))
    totals = F.collect_list(F.when(F.col("is_total"), F.struct("row_label", "col_name", "value")))
    lines = marked.groupBy(*key, line).agg(_exact_sum(part).alias("parts"), F.count(part).alias("n_parts"), F.count("*").alias("n"), totals.alias("totals"))
    summed = (F.col("n") >= 3) & (F.col("n_parts") >= 2)
    if line == "c":
        summed = summed & (F.col("parts") != 0)
    parts = F.col("parts")

    def verdict(t: Column) -> Column:
        return F.struct(_sum_status(t["value"], parts, t["row_label"], t["col_name"], options).alias("status"), _sum_detail(t["value"], parts).alias("detail"), t["row_label"].alias("row"), t["col_name"].alias("column"))

    found = F.when(summed, F.transform(F.filter("totals", lambda t: t["value"].isNotNull()), verdict)).otherwise(F.array().cast("array<struct<status:string,detail:string,row:string,column:string>>"))
    return _or_skip(lines.select(*key, found.alias("found"), ((F.size("totals") > 0) & (F.col("n") >= 3)).alias("comparable")), key, name, none)


def _first(pattern: str, name: str, at: str) -> Column:
    """The first matching name by position, as struct(at, name, value)."""
    return F.min(F.when(F.col(name).rlike(pattern), F.struct(F.col(at).alias("at"), F.col(name).alias("name"), F.col("value"))))


def product_check(cells: DataFrame, key: Sequence[str] = KEY, options: Options = DEFAULT) -> DataFrame:
    """Production in tonnes against area in hectares by yield in kilograms a hectare.

    The three stand in columns of a row, or, in a table that lacks any of the three columns, in rows
    below one outer label; nothing is said of a table without all three. Only cells whose column, or
    row, is one of the three are aggregated.
    """

    def triples(rows: DataFrame, by: Sequence[str], name: str, at: str, other: str) -> DataFrame:
        found = rows.groupBy(*key, *by).agg(_first(AREA, name, at).alias("a"), _first(YIELD, name, at).alias("y"), _first(PRODUCTION, name, at).alias("p"))
        found = found.filter("a is not null and y is not null and p is not null and a.value is not null and y.value is not null and p.value is not null and p.value <> 0")
        return found.withColumn("expected", F.col("a.value") * F.col("y.value") / 1000).withColumn("gap", F.abs(F.col("p.value") - F.col("expected")) / F.abs("p.value"))

    def verdict(rows: DataFrame, row: Column, column: Column) -> DataFrame:
        ok = (F.col("gap") <= options.product_tolerance) | (F.abs(F.col("p.value") - F.col("expected")) <= options.absolute_tolerance)
        detail = F.concat(F.lit("production "), F.format_number("p.value", 0), F.lit(" vs area x yield "), F.format_number("expected", 0), F.lit(" ("), _share(F.col("gap")), F.lit(")"))
        return _check(rows, key, "area_x_yield", F.when(ok, "pass").otherwise("fail"), detail, row, column)

    kinds = [F.col("col_name").rlike(p) for p in (AREA, YIELD, PRODUCTION)]
    in_columns = cells.filter(kinds[0] | kinds[1] | kinds[2]).groupBy(*key).agg(*[F.bool_or(k).alias(n) for k, n in zip(kinds, "xyz")]).filter("x and y and z").select(*key)
    across = verdict(triples(cells.filter(kinds[0] | kinds[1] | kinds[2]), ["r", "row_label"], "col_name", "c", "row_label"), F.col("row_label"), F.col("p.name"))
    outer = F.when(F.col("row_label").contains(X.JOIN), F.substring_index("row_label", X.JOIN, 1)).otherwise("")
    nested = cells.filter(F.col("row_label").rlike(AREA) | F.col("row_label").rlike(YIELD) | F.col("row_label").rlike(PRODUCTION)).withColumn("outer", outer)
    below = triples(nested, ["outer", "c", "col_name"], "row_label", "r", "col_name").join(in_columns, list(key), "left_anti")
    return across.unionByName(verdict(below, F.col("p.name"), F.col("col_name")))


def year_jump_check(cells: DataFrame, key: Sequence[str] = KEY, options: Options = DEFAULT) -> DataFrame:
    """A warning where neighbouring years of a row differ by more than the factor; one pass for a table without."""
    years = cells.filter(strip(F.col("col_name")).rlike(X.DATED_YEAR))
    wide = years.groupBy(*key).agg(F.countDistinct("c").alias("n")).filter("n >= 2").select(*key)
    order = Window.partitionBy(*key, "r").orderBy("c")
    steps = years.filter("value is not null").withColumn("before", F.lag("value").over(order)).withColumn("since", F.lag("col_name").over(order))
    jumps = steps.filter(jump(F.col("before"), F.col("value"), options)).join(wide, list(key), "left_semi")
    detail = F.concat(F.format_number("before", 0), F.lit(" -> "), F.format_number("value", 0), F.lit(" between "), F.col("since"), F.lit(" and "), F.col("col_name"))
    warned = _check(jumps, key, "year_jump", "warn", detail, F.col("row_label"), F.col("col_name"))
    calm = wide.join(jumps.select(*key).distinct(), list(key), "left_anti")
    return warned.unionByName(_check(calm, key, "year_jump", "pass", F.lit("no jump between years")))


def jump(before: Column, after: Column, options: Options = DEFAULT) -> Column:
    """Both positive, and one more than the factor times the other."""
    return (before > 0) & (after > 0) & ((after > before * options.jump_factor) | (before > after * options.jump_factor))


def run_checks(framed: DataFrame, cells: DataFrame, key: Sequence[str] = KEY, options: Options = DEFAULT) -> DataFrame:
    """All checks of a table in one frame."""
    dealt = by_table(cells, key)
    each = [unreadable_check(dealt, key), *(f(dealt, key, options) for f in (bounds_check, column_total_check, row_total_check, product_check, year_jump_check))]
    return reduce(DataFrame.unionByName, each, header_check(framed, key))


SERIES = ("FREQ", "REF_AREA", "INDICATOR", "COMPOSITE_BREAKDOWN", "UNIT_MEASURE", "UNIT_MULT")


def table_family(title: Column, page: Column, table: Column, doc: Column | None = None) -> Column:
    """What names a table across periods: its caption's words; without any, only itself."""
    words = X.title_words(title)
    own = [F.coalesce(c.cast("string"), F.lit("")) for c in ([doc] if doc is not None else []) + [page, table]]
    return F.when(words != "", words).otherwise(F.concat_ws(":", *own))


def series_label(*pairs: tuple[str, str]) -> Column:
    """Printed labels where there are any, else codes; blanks and _Z left out."""
    parts = [F.when(F.coalesce(F.col(label), F.lit("")) != "", F.col(label)).otherwise(F.col(code)) for label, code in pairs]
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "") & (p != X.NOT_IDENTIFIED)), X.JOIN)


def period_jump_check(long: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Warnings for jumps between neighbouring periods of a series; series with a period twice are left out.

    Returns name, status, detail, row (the series), column (the later period). Series meet by one
    shuffle on their keys; a duplicate is seen by counts over the same window.
    """
    family = table_family(F.col("TABLE_TITLE"), F.col("PAGE"), F.col("TABLE"))
    rows = long.filter("OBS_STATUS = 'A' and OBS_VALUE is not null").withColumn("family", family)
    series = Window.partitionBy(*SERIES, "family")
    order = series.orderBy("TIME_PERIOD")
    steps = rows.withColumn("before", F.lag("OBS_VALUE").over(order)).withColumn("since", F.lag("TIME_PERIOD").over(order)).withColumn("page_before", F.lag("PAGE").over(order))
    steps = steps.withColumn("twice", F.max((F.col("since") == F.col("TIME_PERIOD")).cast("int")).over(series))
    jumps = steps.filter(F.coalesce("twice", F.lit(0)) == 0).filter(jump(F.col("before"), F.col("OBS_VALUE"), options))

    def when(period: str, page: str) -> Column:
        return F.concat(F.col(period), F.coalesce(F.concat(F.lit(" (p. "), F.col(page).cast("string"), F.lit(")")), F.lit("")))

    detail = F.concat(F.format_number("before", 0), F.lit(" in "), when("since", "page_before"), F.lit(" vs "), F.format_number("OBS_VALUE", 0), F.lit(" in "), when("TIME_PERIOD", "PAGE"))
    return jumps.select(F.lit("period_jump").alias("name"), F.lit("warn").alias("status"), detail.alias("detail"), series_label(("REF_AREA_LABEL", "REF_AREA"), ("INDICATOR_LABEL", "INDICATOR"), ("COMPOSITE_BREAKDOWN_LABEL", "COMPOSITE_BREAKDOWN")).alias("row"), F.col("TIME_PERIOD").alias("column"))


def status_counts(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of checks by status, zeros included."""
    return checks.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "fail", "warn", "skip")])
