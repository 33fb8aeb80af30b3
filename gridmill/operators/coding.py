"""Vocabulary lookups, axis kinds, and the long observation table.

Only distinct labels are looked up, never cells. A vocabulary has label, code, dimension, unit and
ord (its reading order).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import text as X
from gridmill.functions.numbers import strip
from gridmill.functions.similarity import Shelf
from gridmill.operators.tables import KEY
from gridmill.options import DEFAULT, Options
from gridmill.shared import cut

AREA, MEASURE, BREAKDOWN = "REF_AREA", "INDICATOR", "COMPOSITE_BREAKDOWN"

#: The long table's columns, in order.
LONG = (
    "FREQ", "REF_AREA", "INDICATOR", "COMPOSITE_BREAKDOWN", "TIME_PERIOD", "OBS_VALUE", "UNIT_MEASURE", "UNIT_MULT", "OBS_STATUS", "TIME_PERIOD_LABEL",
    "EXTRACTION_METHOD", "SOURCE", "REF_AREA_LABEL", "INDICATOR_LABEL", "COMPOSITE_BREAKDOWN_LABEL",
)


def exact_codes(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """labels(label, dimension) with code and unit of the first entry that is equal but for case; null if none."""
    entries = vocabulary.groupBy(F.lower("label").alias("folded"), "dimension").agg(F.min(F.struct("ord", "code", "unit")).alias("e"))
    found = labels.withColumn("folded", F.lower("label")).join(entries, ["folded", "dimension"], "left")
    return found.select("label", "dimension", X.sdmx_code(F.col("e.code")).alias("code"), F.col("e.unit").alias("unit"))


def fuzzy_codes(labels: DataFrame, vocabulary: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """labels(label, dimension) with code, unit and score of the best entry at the threshold or above; null if none.

    Distinct labels are scored batch by batch against the vocabulary, a code list that a person keeps,
    which is read in blocks of bounded size; the best of all blocks wins, the first on ties. Only
    entries that share a word or enough letters with a label are scored.
    """
    out = None
    block: list = []

    def scored(entries: list) -> DataFrame:
        @F.pandas_udf("struct<score:double,ord:int,code:string,unit:string>")
        def best(label: pd.Series, dimension: pd.Series) -> pd.DataFrame:
            shelves = {d: Shelf([e for e in entries if e[2] == d]) for d in set(dimension)}
            rows = []
            for text, dim in zip(label, dimension):
                found = shelves[dim].best(text or "", options.vocabulary_threshold)
                rows.append((None, None, None, None) if found is None else (found[0], found[1][4], found[1][1], found[1][3]))
            return pd.DataFrame(rows, columns=["score", "ord", "code", "unit"])

        return labels.select("label", "dimension", best("label", "dimension").alias("b"))

    for row in vocabulary.select("label", "code", "dimension", "unit", "ord").orderBy("ord").toLocalIterator():
        block.append(tuple(row))
        if len(block) == 5_000:
            part = scored(block)
            out, block = part if out is None else out.unionAll(part), []
    if block or out is None:
        part = scored(block)
        out = part if out is None else out.unionAll(part)
    best = out.groupBy("label", "dimension").agg(F.max_by("b", F.when(F.col("b.score").isNotNull(), F.struct("b.score", -F.col("b.ord")))).alias("b"))
    return best.select("label", "dimension", X.sdmx_code(F.col("b.code")).alias("code"), F.col("b.unit").alias("unit"), F.col("b.score").alias("score"))


def codes(labels: DataFrame, vocabulary: DataFrame, fuzzy: bool = True, options: Options = DEFAULT) -> DataFrame:
    """Exact codes, and fuzzy ones for labels without."""
    exact = exact_codes(labels.distinct(), vocabulary)
    if not fuzzy:
        return exact
    rest = fuzzy_codes(exact.filter("code is null").select("label", "dimension"), vocabulary, options)
    return exact.filter("code is not null").unionByName(rest.drop("score"))


def parts(label: Column) -> Column:
    return F.split(label, X.JOIN, -1)


def part_codes(labels: DataFrame, vocabulary: DataFrame, fuzzy: bool = True, options: Options = DEFAULT) -> DataFrame:
    """For each distinct label its parts in order: pos, part, is_total, and codes by dimension (area, measure, breakdown)."""
    split = labels.select("label").distinct().select("label", F.posexplode(parts(F.col("label"))).alias("pos", "raw")).withColumn("part", strip(F.col("raw")))
    wanted = split.select(F.col("part").alias("label")).distinct().crossJoin(split.sparkSession.createDataFrame([(AREA,), (MEASURE,), (BREAKDOWN,)], "dimension string"))
    found = codes(wanted, vocabulary, fuzzy, options)
    wide = found.groupBy(F.col("label").alias("part")).agg(*[F.max(F.when(F.col("dimension") == d, F.struct("code", "unit"))).alias(n) for d, n in ((AREA, "area"), (MEASURE, "measure"), (BREAKDOWN, "breakdown"))])
    return split.join(wide, "part", "left").select("label", "pos", "part", X.is_total(F.col("part")).alias("is_total"), "area", "measure", "breakdown")


def resolve_areas(coded: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """label, area_code ("" for none), area_rest: the first part that is a total (the country) or an area; the other parts remain."""
    hit = F.when(F.col("is_total"), F.lit(options.country)).otherwise(F.col("area.code"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "part", hit.alias("hit"))))
    rows = coded.groupBy("label").agg(listed.alias("p")).withColumn("h", F.try_element_at(F.filter("p", lambda x: x["hit"].isNotNull()), F.lit(1)))
    rest = F.array_join(F.transform(F.filter("p", lambda x: F.col("h").isNull() | (x["pos"] != F.col("h.pos"))), lambda x: x["part"]), X.JOIN)
    return rows.select("label", F.coalesce("h.hit", F.lit("")).alias("area_code"), F.when(F.col("h").isNull(), F.col("label")).otherwise(rest).alias("area_rest"))


def split_indicators(coded: DataFrame) -> DataFrame:
    """label, measure, measure_label, breakdown, breakdown_label, unit: an ordered fold over a label's parts.

    The first part that names a measure takes that slot, then the first that names a breakdown takes
    the other; a part whose slot is taken tries the other slot; what matches nothing is left over.
    Left-over text becomes the breakdown's code, or lengthens its label where there is one.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", "part", "is_total", F.col("measure").alias("m"), F.col("breakdown").alias("b"))))
    rows = coded.groupBy("label").agg(F.filter(listed, lambda x: (x["part"] != "") & (x["part"] != "UNKNOWN") & ~x["is_total"]).alias("p"))
    nothing = F.lit(None).cast("string")
    start = F.struct(nothing.alias("m"), nothing.alias("ml"), nothing.alias("b"), nothing.alias("bl"), F.lit("").alias("u"), F.array().cast("array<string>").alias("rest"))

    def step(s: Column, x: Column) -> Column:
        as_m = x["m"]["code"].isNotNull() & s["m"].isNull()
        as_b = ~as_m & x["b"]["code"].isNotNull() & s["b"].isNull()
        unit = F.when(as_m, x["m"]["unit"]).when(as_b, x["b"]["unit"])
        return F.struct(
            F.when(as_m, x["m"]["code"]).otherwise(s["m"]).alias("m"),
            F.when(as_m, x["part"]).otherwise(s["ml"]).alias("ml"),
            F.when(as_b, x["b"]["code"]).otherwise(s["b"]).alias("b"),
            F.when(as_b, x["part"]).otherwise(s["bl"]).alias("bl"),
            F.when((s["u"] == "") & unit.isNotNull(), unit).otherwise(s["u"]).alias("u"),
            F.when(as_m | as_b, s["rest"]).otherwise(F.concat(s["rest"], F.array(x["part"]))).alias("rest"),
        )

    s = rows.select("label", F.aggregate("p", start, step).alias("s"))
    left = F.array_join("s.rest", X.JOIN)
    has = F.size("s.rest") > 0
    return s.select(
        "label",
        F.col("s.m").alias("measure"),
        F.col("s.ml").alias("measure_label"),
        F.when(F.col("s.b").isNotNull(), F.col("s.b")).when(has, X.sdmx_code(left)).otherwise(X.TOTAL).alias("breakdown"),
        F.when(F.col("s.b").isNotNull() & has, F.concat_ws(X.JOIN, "s.bl", left)).when(F.col("s.b").isNotNull(), F.col("s.bl")).when(has, left).otherwise("").alias("breakdown_label"),
        F.col("s.u").alias("unit"),
    )


def title_measures(titles: DataFrame, vocabulary: DataFrame, fuzzy: bool = True, options: Options = DEFAULT) -> DataFrame:
    """title, measure, measure_label: the first word of a title that names a measure; titles without are absent."""
    words = titles.select("title").distinct().select("title", F.posexplode(F.split("title", r"[\s,;:.]+", -1)).alias("pos", "label")).filter("label <> ''")
    found = codes(words.select("label", F.lit(MEASURE).alias("dimension")), vocabulary, fuzzy, options).filter("code is not null").select("label", "code")
    best = words.join(found, "label").groupBy("title").agg(F.min(F.struct("pos", "code", "label")).alias("b"))
    return best.select("title", F.col("b.code").alias("title_measure"), F.col("b.label").alias("title_measure_label"))


def axis_kinds(labels: DataFrame, key: Sequence[str], vocabulary: DataFrame, fuzzy: bool = True, options: Options = DEFAULT) -> DataFrame:
    """key and kind of an axis ("year", "area" or "other") from labels(key…, label), one row a label."""
    clean = labels.select(*key, X.without_duplicate_suffix(F.col("label")).alias("label"))
    areas = codes(clean.select("label", F.lit(AREA).alias("dimension")), vocabulary, fuzzy, options).select("label", F.col("code").isNotNull().alias("is_area"))
    marked = clean.join(areas, "label")
    named = F.when(~X.is_total(F.col("label")), F.col("is_area").cast("double"))
    shares = marked.groupBy(*key).agg(F.avg(X.is_period(F.col("label")).cast("double")).alias("periods"), F.avg(named).alias("areas"))
    return shares.select(*key, F.when(F.col("periods") >= 0.5, "year").when(F.col("areas") >= 0.5, "area").otherwise("other").alias("kind"))


def failed_cells(checks: DataFrame, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(key, row_label, col_name of failed cells; keys of tables with a failure that names no row)."""
    bad = checks.filter("status = 'fail'")
    cells = bad.filter("row <> ''").select(*key, F.col("row").alias("row_label"), F.col("column").alias("col_name")).distinct()
    return cells, bad.filter("row = ''").select(*key).distinct()


def with_status(cells: DataFrame, checks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Tall cells with OBS_STATUS: U for unreadable cells, failed cells and all of a table that failed as a whole; else A."""
    bad, whole = failed_cells(checks, key)
    marked = cells.join(bad.withColumn("cell_failed", F.lit(True)), [*key, "row_label", "col_name"], "left").join(whole.withColumn("table_failed", F.lit(True)), list(key), "left")
    failed = F.coalesce("cell_failed", F.lit(False)) | F.coalesce("table_failed", F.lit(False)) | (F.col("status") == "error")
    return marked.withColumn("OBS_STATUS", F.when(failed, "U").otherwise("A")).drop("cell_failed", "table_failed")


#: What names an observation's words: its labels and axis kinds, and the subject of its table.
WORDS = ("row_text", "col_text", "row_kind", "col_kind", "subject")


def described(words: DataFrame, vocabulary: DataFrame, fuzzy: bool = True, options: Options = DEFAULT) -> DataFrame:
    """WORDS with area_text, area_code, time_text (null: none), what, and its measure, breakdown and unit; for distinct words."""

    def pick(which: str) -> Column:
        return F.when(F.col("row_kind") == which, F.col("row_text")).when(F.col("col_kind") == which, F.col("col_text"))

    rest = F.array_join(F.filter(F.array(F.when(F.col("row_kind") == "other", F.col("row_text")), F.when(F.col("col_kind") == "other", F.col("col_text"))), lambda p: p.isNotNull()), X.JOIN)
    own = (F.col("row_kind") == "other") | (F.col("col_kind") == "other")
    x = words.withColumn("area_text", F.coalesce(pick("area"), F.lit(""))).withColumn("time_text", pick("year")).withColumn("own", F.when(own, rest).otherwise(F.col("subject")))
    areas = resolve_areas(part_codes(x.select(F.col("area_text").alias("label")), vocabulary, fuzzy, options), options).withColumnRenamed("label", "area_text")
    what = F.when((F.col("area_text") == "") | (F.col("area_rest") == ""), F.col("own")).when(F.col("own") == F.col("subject"), F.col("area_rest")).otherwise(F.concat_ws(X.JOIN, "area_rest", "own"))
    x = cut(x.join(areas, "area_text").withColumn("what", what), "words")
    split = split_indicators(part_codes(x.select(F.col("what").alias("label")), vocabulary, fuzzy, options)).withColumnRenamed("label", "what").withColumnRenamed("unit", "mapped_unit")
    return x.join(split, "what").select(*WORDS, "area_text", "area_code", "time_text", "what", "measure", "measure_label", "breakdown", "breakdown_label", "mapped_unit")


def to_long(cells: DataFrame, checks: DataFrame, context: DataFrame, vocabulary: DataFrame, key: Sequence[str] = KEY, fuzzy: bool = True, options: Options = DEFAULT) -> DataFrame:
    """One observation a cell that isn't missing, with the key, the columns of LONG, TABLE and TABLE_TITLE.

    `context` has the key and title, unit, subject, period and source of each table. Cells may have a
    column `method`, the reader that each row came from. Tables and cells meet on the key; lookups run
    on the distinct words of observations, which meet the cells once.
    """
    key = list(key)
    live = with_status(cells, checks, key).filter("status <> 'missing'")
    rows = axis_kinds(cells.select(*key, F.col("row_label").alias("label"), "r").distinct(), key, vocabulary, fuzzy, options).withColumnRenamed("kind", "row_kind")
    columns = axis_kinds(cells.select(*key, F.col("col_name").alias("label"), "c").distinct(), key, vocabulary, fuzzy, options).withColumnRenamed("kind", "col_kind")
    x = live.join(rows, key).join(columns, key).join(context, key)

    def kind(label: Column, axis: Column) -> Column:
        return F.when((axis == "year") & ~X.is_period(label), "other").otherwise(axis)

    x = x.withColumn("row_text", X.without_duplicate_suffix(F.col("row_label"))).withColumn("col_text", strip(F.col("col_name"))).withColumn("subject", F.coalesce("subject", F.lit("")))
    x = x.withColumn("row_kind", kind(F.col("row_text"), F.col("row_kind"))).withColumn("col_kind", kind(F.col("col_text"), F.col("col_kind")))
    found = described(x.select(*WORDS).distinct(), vocabulary, fuzzy, options)
    titled = title_measures(context.select("title"), vocabulary, fuzzy, options)
    x = x.join(found, list(WORDS)).join(titled, "title", "left").withColumn("time_text", F.coalesce("time_text", "period"))
    unit = X.unit_for(F.col("what"), F.col("mapped_unit"), F.col("unit"))
    x = x.withColumn("TIME_PERIOD", X.time_period(F.col("time_text"))).withColumn("u", unit)
    method = F.col("method") if "method" in cells.columns else F.col("stage") if "stage" in key else F.lit("grid")
    return x.select(
        *key,
        X.frequency(F.col("TIME_PERIOD")).alias("FREQ"),
        F.when(F.col("area_code") != "", F.col("area_code")).otherwise(options.country).alias("REF_AREA"),
        F.coalesce("measure", "title_measure", F.lit(X.NOT_IDENTIFIED)).alias("INDICATOR"),
        F.col("breakdown").alias("COMPOSITE_BREAKDOWN"),
        "TIME_PERIOD",
        F.col("value").alias("OBS_VALUE"),
        F.col("u.unit").alias("UNIT_MEASURE"),
        F.col("u.mult").alias("UNIT_MULT"),
        "OBS_STATUS",
        F.col("time_text").alias("TIME_PERIOD_LABEL"),
        method.alias("EXTRACTION_METHOD"),
        F.col("source").alias("SOURCE"),
        F.when(F.col("area_text") != "", F.col("area_text")).otherwise(options.country_name).alias("REF_AREA_LABEL"),
        F.coalesce("measure_label", "title_measure_label", F.lit("not identified")).alias("INDICATOR_LABEL"),
        F.col("breakdown_label").alias("COMPOSITE_BREAKDOWN_LABEL"),
        (F.col("table_no") if "table_no" in key else F.lit(0)).alias("TABLE"),
        F.col("title").alias("TABLE_TITLE"),
    )
