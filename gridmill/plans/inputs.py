"""Printed tables made from the star schema, as inputs of the catalogue's queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
YEARS = tuple(range(1995, 2002))
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    """spark.sql over the tables named in braces."""
    named = {n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text)) if n in TABLES and n not in more}
    return spark.sql(text, **named, **more)


def french(value):
    """A number with blanks for thousands and a decimal comma."""
    return F.translate(F.format_number(value, 2), ",.", " ,")


#: Orders by nation, priority and year; exact sums.
CROSSTAB = """
SELECT c.c_nationkey AS page, o.o_orderpriority AS p, CAST(year(o.o_orderdate) AS INT) AS y, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3
"""


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CROSSTAB)


def order_grids(spark: SparkSession, sf_dir: str, planted: bool = True) -> DataFrame:
    """One printed table a nation: priorities by years, with a total row and column.

    In every fifth nation the total of the first year is printed half as high again.
    """
    base = crosstab(spark, sf_dir)
    values = base.groupBy("page", "p").pivot("y", list(YEARS)).agg(F.first("v")).na.fill(0.0)

    def total(*names):
        return sum((F.col(n).cast("decimal(28,2)") for n in names), F.lit(0).cast("decimal(28,2)")).cast("double")

    ys = [str(y) for y in YEARS]
    values = values.withColumn("t", total(*[f"`{y}`" for y in ys]))
    row = F.array("p", *[french(F.col(f"`{c}`")) for c in [*ys, "t"]])
    sums = values.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p", row.alias("cells")))).alias("rows"), *[F.sum(F.col(f"`{c}`").cast("decimal(28,2)")).cast("double").alias(c) for c in [*ys, "t"]])
    wrong = F.when((F.col("page") % 5 == 0) & F.lit(planted), F.lit(1.5)).otherwise(1.0)
    last = F.array(F.lit("Total"), french(F.round(F.col(f"`{ys[0]}`") * wrong, 2)), *[french(F.col(f"`{c}`")) for c in [*ys[1:], "t"]])
    head = F.array(*[F.lit(x) for x in ["", *ys, "Total"]])
    cells = F.concat(F.array(head), F.transform("rows", lambda r: r["cells"]), F.array(last))
    return sums.select(F.lit("orders").alias("doc"), F.col("page").cast("int").alias("page"), F.lit("text").alias("stage"), F.lit(0).alias("stage_rank"), F.lit(0).alias("table_no"), cells.alias("cells"))


def vocabulary(spark: SparkSession) -> DataFrame:
    rows = [(p, f"P{p[0]}", "COMPOSITE_BREAKDOWN", "") for p in PRIORITIES] + [("Montant", "MNT", "INDICATOR", "")] + [(f"NATION_{i}", f"NE-{i}", "REF_AREA", "") for i in range(25)]
    values = ", ".join(f"('{a}', '{b}', '{c}', '{d}', '', {i})" for i, (a, b, c, d) in enumerate(rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(label, code, dimension, unit, note, ord)")


def order_context(grids: DataFrame) -> DataFrame:
    """Caption, unit and default period of each printed table."""
    return grids.select("doc", "page", "stage", "table_no", F.concat(F.lit("Tableau "), F.col("page").cast("string"), F.lit(": Montant des commandes")).alias("title"), F.lit("US$").alias("unit"), F.lit("UNKNOWN").alias("subject"), F.lit("2001").alias("period"), F.lit("orders.pdf").alias("source"))


#: The grids that two readers make of five nations a page, and what is wrong with them, by page:
#: even pages: in the first table the text reader's first total is unreadable; the second reader lacks the last table;
#: page 1: the text reader's first table has no numbers, and a total in the second is unreadable; page 3: all is well.
def two_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readers' printed tables, the second reader's in reverse order on the page."""
    good = order_grids(spark, sf_dir, planted=False).withColumn("nation", F.col("page")).withColumn("page", F.floor(F.col("nation") / 5).cast("int")).withColumn("table_no", F.col("nation") % 5)
    last = F.size("cells") - 1
    unread = F.transform("cells", lambda r, i: F.when(i == last, F.concat(F.slice(r, 1, 1), F.array(F.lit("12 3 4")), F.slice(r, 3, 100))).otherwise(r))
    words = F.transform("cells", lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda c, j: F.when(j == 0, c).otherwise(F.lit("texte")))))
    text = F.when(((F.col("table_no") == 0) & (F.col("page") % 2 == 0)) | ((F.col("table_no") == 1) & (F.col("page") == 1)), unread).when((F.col("table_no") == 0) & (F.col("page") == 1), words).otherwise(F.col("cells"))
    first = good.withColumn("cells", text)
    second = good.filter("page % 2 = 1 or table_no < 4").withColumn("stage", F.lit("ml")).withColumn("stage_rank", F.lit(1)).withColumn("table_no", 4 - F.col("table_no"))
    return first.unionByName(second).drop("nation")


def captioned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages of five tables: a caption a table, a unit below the first, figures; and a page without text."""
    text = "concat('Bulletin 2010\\n', array_join(transform(sequence(0, 4), i -> concat('Tableau ', i + 1, ': Montant des commandes, zone ', chr(65 + 5 * p + i), ' en 2010\\n', CASE WHEN i = 0 THEN 'Unité : US$\\n' ELSE '' END, repeat('12 345,67 ', 20))), '\\n'))"
    return sql(spark, sf_dir, f"SELECT 'orders' AS doc, CAST(p AS INT) AS page, CASE WHEN p < 5 THEN {text} ELSE ' ' END AS text FROM (SELECT DISTINCT n_nationkey div 5 AS p FROM {{nation}} UNION ALL SELECT 5)")
