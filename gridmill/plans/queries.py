"""The catalogue: each query applies an operator to inputs made from the star schema; its SQL recomputes the result from the base tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import numbers as N
from gridmill.functions import text as X
from gridmill.operators import audit, checks, coding, repair, select, summary, tables
from gridmill.options import DEFAULT
from gridmill.plans import cascade
from gridmill.plans import inputs as I
from gridmill.plans.observations import observe
from gridmill.shared import cut
from gridmill.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Order sums grow with the data; the query's bound is out of their reach.
WIDE = replace(DEFAULT, upper_bound=1e18)


def query(sql: str | None = None):
    def mark(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return mark


# ---------------------------------------------------------------- numbers


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber = 3 THEN -l_extendedprice ELSE l_extendedprice END AS value, 'ok' AS status FROM lineitem
""")
def parse_french_numbers(spark, d):
    def styled(v):
        french = F.translate(v, ",.", " ,")
        styles = {1: french, 2: french, 3: F.concat(F.lit("("), french, F.lit(")")), 4: F.concat(french, F.lit("*")), 5: F.concat(french, F.lit(" %")), 6: F.translate(v, ",.", ".,")}
        out = F.translate(v, ".,", ",")
        for k, s in styles.items():
            out = F.when(F.col("l_linenumber") == k, s).otherwise(out)
        return out

    printed = N.bind(F.format_number("l_extendedprice", 2), styled)
    return I.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), N.parsed(printed).alias("p")).select("l_orderkey", "l_linenumber", "p.value", "p.status")


@query("""
SELECT CASE o_orderkey % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'missing' WHEN 2 THEN 'error' WHEN 3 THEN 'error' WHEN 4 THEN 'missing' WHEN 5 THEN 'error' ELSE 'ok' END AS status,
  count(*) AS n, coalesce(CAST(sum(CASE WHEN o_orderkey % 9 IN (6, 7) THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN o_orderkey % 9 = 8 THEN 12 END) AS DOUBLE), 0) AS total FROM orders GROUP BY 1
""")
def classify_cells(spark, d):
    k = F.col("o_orderkey") % 9
    plain = F.translate(F.translate(F.format_number("o_totalprice", 2), ",", ""), ".", ",")
    junk = {0: "-", 1: " N.D. ", 2: "290 22 955", 3: "see note", 4: "…", 5: "%", 8: "(12"}
    raw = plain
    for n, text in junk.items():
        raw = F.when(k == n, text).otherwise(raw)
    cells = I.table(spark, d, "orders").select(N.parsed(raw).alias("p")).select("p.status", "p.value")
    return cells.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("total"))


@query("SELECT p_partkey, p_retailprice AS value, replace(replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), ',', ''), '.', ',') || chr(10) || 'price' AS printed FROM part")
def english_grid_rewrite(spark, d):
    cell = F.concat(F.format_number("p_retailprice", 2), F.lit("\nprice"))
    return I.table(spark, d, "part").select("p_partkey", N.value(F.split(N.to_french(cell), "\n")[0]).alias("value"), N.to_french(cell).alias("printed"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS english FROM part")
def page_number_format(spark, d):
    v = F.format_number("p_retailprice", 2)
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(v, F.lit(" and "), v)).when(k == 1, F.concat(F.translate(v, ",.", " ,"), F.lit(" et "), F.translate(v, ",.", " ,"))).otherwise("no figures here")
    return I.table(spark, d, "part").select("p_partkey", N.english_page(text).alias("english"))


@query("""
WITH p AS (SELECT c_custkey AS page, coalesce(sum(length(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR))), 0) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT page, CAST(n AS BIGINT) AS n_digits, CASE WHEN n = 0 THEN 'vision' WHEN n < 100 THEN 'sparse' ELSE 'all' END AS route FROM p
""")
def sparse_page_routing(spark, d):
    pages = I.sql(spark, d, "SELECT 'orders' AS doc, c_custkey AS page, array_join(collect_list(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)), ' ; ') AS text FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey")
    return select.page_routes(pages).drop("doc")


# ---------------------------------------------------------------- headers and labels


@query("""
WITH n AS (SELECT (p_partkey - 1) // 20 AS table_no, p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'col' ELSE p_name END AS name FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY table_no, name ORDER BY p_partkey) AS i, row_number() OVER (PARTITION BY table_no ORDER BY p_partkey) - 1 AS c FROM n)
SELECT CAST(table_no AS BIGINT) AS table_no, CAST(c AS BIGINT) AS c, CASE WHEN i = 1 THEN name ELSE name || '_' || i END AS col_name, CASE WHEN i = 1 THEN name ELSE name || ' (' || i || ')' END AS row_label FROM k
""")
def header_merge_dedupe(spark, d):
    names = I.sql(spark, d, "SELECT (p_partkey - 1) div 20 AS table_no, transform(array_sort(collect_list(struct(p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS name))), x -> x.name) AS names FROM {part} GROUP BY 1")
    plain = F.transform("names", lambda x: F.when(x == "", "col").otherwise(x))
    both = names.select("table_no", F.posexplode(F.arrays_zip(tables.distinct_names(F.col("names")).alias("col_name"), tables.distinct_labels(plain).alias("row_label"))).alias("c", "x"))
    return both.select(F.col("table_no").cast("long").alias("table_no"), F.col("c").cast("long").alias("c"), "x.col_name", "x.row_label")


def _nation_grid(spark, d, blank: bool = False) -> DataFrame:
    rows = I.sql(spark, d, """
    SELECT n.n_nationkey, n.n_name, r.r_name, row_number() OVER (PARTITION BY r.r_regionkey ORDER BY n.n_nationkey) AS k, r.r_regionkey, count(c.c_custkey) AS n
    FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2, 3, r.r_regionkey
    """)
    cells = F.array(F.when(F.col("k") == 1, F.col("r_name")).otherwise(""), "n_name", *([F.lit("")] if blank else []), F.col("n").cast("string"), F.col("n_nationkey").cast("string"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "n_nationkey", cells.alias("cells")))), lambda x: x["cells"])
    head = F.array(*[F.array(*[F.lit(x) for x in h]) for h in ((["Region", "Pays", "rien", "Clients", "Clé"], ["", "", "", "Clients", "no"]) if blank else (["Region", "Pays", "Clients", "Clé"],))])
    return rows.agg(F.concat(head, body).alias("cells")).select(F.lit("n").alias("doc"), F.lit(1).alias("page"), F.lit("text").alias("stage"), F.lit(0).alias("table_no"), "cells")


@query("""
SELECT r_name || ' / ' || n_name AS row_label, 'Region / Pays' AS label_name, CAST(row_number() OVER (ORDER BY r_regionkey, n_nationkey) - 1 AS BIGINT) AS r, CAST(count(c_custkey) AS DOUBLE) AS clients
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey, r_name, n_nationkey, n_name
""")
def label_forward_fill(spark, d):
    framed = tables.frames(_nation_grid(spark, d))
    names = framed.select(*tables.KEY, "label_name")
    return tables.tall(framed).filter("col_name = 'Clients'").join(names, list(tables.KEY)).select("row_label", "label_name", F.col("r").cast("long").alias("r"), F.col("value").alias("clients"))


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'Clients', CAST(25 AS BIGINT)), (CAST(1 AS BIGINT), 'Clé no', CAST(25 AS BIGINT))) AS t(c, col_name, n)")
def drop_empty_columns(spark, d):
    cells = tables.tall(tables.frames(_nation_grid(spark, d, blank=True)))
    return cells.groupBy(F.col("c").cast("long").alias("c"), "col_name").agg(F.count("*").alias("n"))


@query("SELECT n_name AS row_label, CAST(n_nationkey AS DOUBLE) AS value, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def unstack_rows(spark, d):
    rows = I.sql(spark, d, """
    SELECT n_nationkey div 3 AS page, array_sort(collect_list(struct(n_nationkey AS k, n_name AS name, n_regionkey AS region))) AS x FROM {nation} GROUP BY 1
    """)
    lines = [F.array_join(F.transform("x", lambda e: e[c].cast("string")), "\n") for c in ("k", "region")]
    cells = F.concat(F.array(F.array(F.lit("Pays"), F.lit("Clé"), F.lit("Région"))), F.transform("x", lambda e, i: F.when(i == 0, F.array(e["name"], *lines)).otherwise(F.array(e["name"], F.lit(""), F.lit("")))))
    grids = rows.select(F.lit("n").alias("doc"), F.col("page").cast("int").alias("page"), F.lit("text").alias("stage"), F.lit(0).alias("table_no"), cells.alias("cells"))
    cells = tables.tall(tables.frames(grids))
    return cells.groupBy("page", "r", "row_label").agg(F.max(F.when(F.col("c") == 0, F.col("value"))).alias("value"), F.max(F.when(F.col("c") == 1, F.col("value"))).alias("region")).select("row_label", "value", "region")


# ---------------------------------------------------------------- figures of tables, gate

_STATS = """
WITH c AS (SELECT l_suppkey AS page, l_orderkey AS r, l_linenumber AS c, CASE WHEN l_suppkey % 4 = 0 AND l_orderkey % 2 = 0 THEN 'missing' WHEN l_suppkey % 10 = 3 AND l_orderkey % 3 = 0 THEN 'error' ELSE 'ok' END AS s FROM lineitem),
s AS (SELECT page, count(DISTINCT r) AS rows, count(DISTINCT c) + 1 AS cols, CAST(count(*) FILTER (s = 'ok') AS DOUBLE) / count(*) AS numeric_share, CAST(count(*) FILTER (s = 'missing') AS DOUBLE) / count(*) AS missing_share,
  CAST(count(*) FILTER (s = 'error') AS DOUBLE) / count(*) AS unreadable_share FROM c GROUP BY page)
"""


def _supplier_cells(spark, d):
    s, o = F.col("l_suppkey"), F.col("l_orderkey")
    raw = F.when((s % 4 == 0) & (o % 2 == 0), "nd").when((s % 10 == 3) & (o % 3 == 0), "12 3 4").otherwise(I.french(F.col("l_extendedprice")))
    return I.table(spark, d, "lineitem").select(F.lit("l").alias("doc"), F.col("l_suppkey").alias("page"), F.lit("text").alias("stage"), F.lit(0).alias("table_no"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"), N.status(raw).alias("status"))


@query(_STATS + "SELECT page, rows, cols, numeric_share, missing_share, unreadable_share FROM s")
def table_body_stats(spark, d):
    return select.body_stats(_supplier_cells(spark, d)).drop("doc", "stage", "table_no")


@query(_STATS + """
SELECT page, CASE WHEN rows < 2 OR cols < 2 THEN 'too small' WHEN numeric_share < 0.5 THEN 'too few numbers' WHEN unreadable_share > 0.15 THEN 'too many unreadable cells' ELSE 'ok' END AS reason,
  round(numeric_share * (1 - unreadable_share), 3) AS score FROM s
""")
def gate_tables(spark, d):
    return select.gate(select.body_stats(_supplier_cells(spark, d))).select("page", "reason", "score")


# ---------------------------------------------------------------- checks

_CROSS = """
WITH b AS (SELECT c_nationkey AS page, o_orderpriority AS p, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
g AS (SELECT page, p, y, coalesce(v, 0) AS v FROM (SELECT DISTINCT page, p FROM b) CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y) LEFT JOIN b USING (page, p, y)),
ct AS (SELECT page, y, sum(v) AS v FROM g GROUP BY ALL), rt AS (SELECT page, p, sum(v) AS v FROM g GROUP BY ALL), tt AS (SELECT page, sum(v) AS v FROM g GROUP BY ALL),
cells AS (
  SELECT page, p AS row, CAST(y AS VARCHAR) AS col, CAST(v AS DOUBLE) AS v FROM g
  UNION ALL SELECT page, p, 'Total', CAST(v AS DOUBLE) FROM rt
  UNION ALL SELECT page, 'Total', CAST(y AS VARCHAR), CASE WHEN page % 5 = 0 AND y = 1995 THEN round(CAST(v AS DOUBLE) * 1.5, 2) ELSE CAST(v AS DOUBLE) END FROM ct
  UNION ALL SELECT page, 'Total', 'Total', CAST(v AS DOUBLE) FROM tt),
steps AS (SELECT page, row, col, v, lag(v) OVER (PARTITION BY page, row ORDER BY col) AS b FROM cells WHERE col <> 'Total'),
jumps AS (SELECT page, row, col, CASE WHEN b > 0 AND v > 0 AND (v > b * 5 OR b > v * 5) THEN 1 ELSE 0 END AS j FROM steps)
"""


def _orders(spark, d):
    grids = I.order_grids(spark, d)
    return observe(grids, I.order_context(grids), I.vocabulary(spark), options=WIDE)


def _cells(spark, d):
    return cut(tables.tall(tables.frames(I.order_grids(spark, d))), "cells")


@query(_CROSS + "SELECT CAST(page AS BIGINT) AS page, 'Total' AS row, col AS \"column\", CASE WHEN page % 5 = 0 AND col = '1995' THEN 'fail' ELSE 'pass' END AS status FROM cells WHERE row = 'Total'")
def column_total_check(spark, d):
    return checks.column_total_check(_cells(spark, d), options=WIDE).select(F.col("page").cast("long").alias("page"), "row", "column", "status")


@query(_CROSS + "SELECT CAST(page AS BIGINT) AS page, row, 'Total' AS \"column\", CASE WHEN page % 5 = 0 AND row = 'Total' THEN 'fail' ELSE 'pass' END AS status FROM cells WHERE col = 'Total'")
def row_total_check(spark, d):
    return checks.row_total_check(_cells(spark, d), options=WIDE).select(F.col("page").cast("long").alias("page"), "row", "column", "status")


@query("SELECT l_suppkey AS page, CASE WHEN l_orderkey % 7 = 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def product_check(spark, d):
    line = I.table(spark, d, "lineitem").withColumn("a", F.col("l_partkey") + 100000.0).withColumn("y", F.col("l_quantity") * 100)
    line = line.withColumn("p", F.col("a") * F.col("y") / 1000 * F.when(F.col("l_orderkey") % 7 == 0, 1.1).otherwise(1.0)).withColumn("id", F.monotonically_increasing_id())
    cells = line.select(F.lit("l").alias("doc"), F.col("l_suppkey").alias("page"), F.lit("text").alias("stage"), F.lit(0).alias("table_no"), F.col("id").alias("r"), F.concat_ws("-", "l_orderkey", "id").alias("row_label"), F.posexplode(F.array(F.struct(F.lit("Superficie (ha)").alias("n"), F.col("a").alias("v")), F.struct(F.lit("Rendement (kg/ha)").alias("n"), F.col("y").alias("v")), F.struct(F.lit("Production (t)").alias("n"), F.col("p").alias("v")))).alias("c", "x"))
    got = checks.product_check(cells.select("*", F.col("x.n").alias("col_name"), F.col("x.v").alias("value")).drop("x"))
    return got.groupBy("page", "status").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT c_nationkey AS page, bool_or(c_acctbal < 0 AND c_custkey % 500 <> 0) AS low, bool_or(c_custkey % 500 = 0) AS high FROM customer GROUP BY 1)
SELECT CAST(page AS BIGINT) AS page, 'warn' AS status, 'Solde' AS "column" FROM c WHERE low UNION ALL SELECT page, 'fail', 'Solde' FROM c WHERE high UNION ALL SELECT page, 'pass', '' FROM c WHERE NOT low AND NOT high
""")
def bounds_check(spark, d):
    cells = I.sql(spark, d, "SELECT 'c' AS doc, CAST(c_nationkey AS BIGINT) AS page, 'text' AS stage, 0 AS table_no, c_custkey AS r, 0 AS c, 'Solde' AS col_name, CASE WHEN c_custkey % 500 = 0 THEN 2e9D ELSE c_acctbal END AS value FROM {customer}")
    return checks.bounds_check(cells).select("page", "status", "column")


@query("""
WITH v AS (SELECT p_brand, year(l_shipdate) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * CASE WHEN year(l_shipdate) % 4 = 0 THEN 10 ELSE 1 END AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, year(l_shipdate)),
s AS (SELECT *, lag(v) OVER (PARTITION BY p_brand ORDER BY y) AS b, count(*) OVER (PARTITION BY p_brand) AS k FROM v),
j AS (SELECT p_brand, CAST(y AS VARCHAR) AS "column", 'warn' AS status FROM s WHERE k >= 2 AND b > 0 AND v > 0 AND (v > b * 5 OR b > v * 5))
SELECT p_brand AS page, "column", status FROM j UNION ALL SELECT DISTINCT p_brand, '', 'pass' FROM s WHERE k >= 2 AND p_brand NOT IN (SELECT p_brand FROM j)
""")
def year_jump_check(spark, d):
    cells = I.sql(spark, d, """
    SELECT 'p' AS doc, p_brand AS page, 'text' AS stage, 0 AS table_no, 0 AS r, 'Ventes' AS row_label, y AS c, CAST(y AS STRING) AS col_name, v AS value FROM (
      SELECT p_brand, year(l_shipdate) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * CASE WHEN year(l_shipdate) % 4 = 0 THEN 10 ELSE 1 END AS v FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2)
    """)
    return checks.year_jump_check(cells).select("page", "column", "status")


@query("""
WITH v AS (SELECT c_nationkey AS n, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS t, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * CASE WHEN quarter(o_orderdate) = 2 AND c_nationkey % 3 = 0 THEN 50 ELSE 1 END AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate), quarter(o_orderdate)),
s AS (SELECT *, lag(v) OVER (PARTITION BY n ORDER BY t) AS b FROM v)
SELECT 'N' || n || ' / Montant' AS row, t AS "column", 'warn' AS status FROM s WHERE n <> 6 AND b > 0 AND v > 0 AND (v > b * 5 OR b > v * 5)
""")
def period_jump_check(spark, d):
    return checks.period_jump_check(_quarters(spark, d)).select("row", "column", "status")


def _quarters(spark, d):
    """Observations by nation and quarter; nation 6 has a period twice, so its series is left out."""
    long = I.sql(spark, d, """
    SELECT 'Q' AS FREQ, concat('N', n) AS REF_AREA, 'MNT' AS INDICATOR, '_Z' AS COMPOSITE_BREAKDOWN, 'USD' AS UNIT_MEASURE, '0' AS UNIT_MULT, t AS TIME_PERIOD, v AS OBS_VALUE, 'A' AS OBS_STATUS, concat('Tableau 4.', y, ': Montant par pays en ', y) AS TABLE_TITLE,
      y AS PAGE, 1 AS TABLE, '' AS REF_AREA_LABEL, 'Montant' AS INDICATOR_LABEL, '' AS COMPOSITE_BREAKDOWN_LABEL FROM (
      SELECT c_nationkey AS n, year(o_orderdate) AS y, concat(year(o_orderdate), '-Q', quarter(o_orderdate)) AS t, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * CASE WHEN quarter(o_orderdate) = 2 AND c_nationkey % 3 = 0 THEN 50 ELSE 1 END AS v
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate), quarter(o_orderdate))
    """)
    return long.unionByName(long.filter("REF_AREA = 'N6' and TIME_PERIOD = '1997-Q1'"))


# ---------------------------------------------------------------- coding


@query("SELECT CAST(n_nationkey AS BIGINT) AS page, CASE n_nationkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'area' ELSE 'other' END AS kind FROM nation")
def axis_kinds(spark, d):
    labels = I.sql(spark, d, """
    SELECT CAST(n.n_nationkey AS BIGINT) AS page, explode(CASE n.n_nationkey % 3 WHEN 0 THEN array('1996', '1997/98', '2 T24', 'Variation') WHEN 1 THEN array(n.n_name, lower(n.n_name), 'Total', 'Autre') ELSE array(n.n_name, 'Total', 'Mil', 'Riz') END) AS label FROM {nation} n
    """)
    return coding.axis_kinds(labels, ["page"], I.vocabulary(spark))


_LABELS = "SELECT DISTINCT concat_ws(' / ', CASE WHEN n_nationkey % 4 = 1 THEN 'Total' WHEN n_nationkey % 4 = 2 THEN concat('Zone ', n_nationkey) ELSE lower(n_name) END, o_orderpriority, CASE WHEN n_nationkey % 3 = 0 THEN 'montant' END) AS label FROM {nation} CROSS JOIN (SELECT DISTINCT o_orderpriority FROM {orders})"
_LABELS_SQL = """
WITH l AS (SELECT n_nationkey AS k, o_orderpriority AS p, CASE WHEN n_nationkey % 4 = 1 THEN 'Total' WHEN n_nationkey % 4 = 2 THEN 'Zone ' || n_nationkey ELSE lower(n_name) END AS a, CASE WHEN n_nationkey % 3 = 0 THEN ' / montant' ELSE '' END AS m
  FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)),
x AS (SELECT *, a || ' / ' || p || m AS label FROM l)
"""


@query(_LABELS_SQL + """
SELECT DISTINCT label, CASE WHEN k % 4 = 1 THEN 'NE' WHEN k % 4 = 2 THEN '' ELSE 'NE-' || k END AS area_code, CASE WHEN k % 4 = 2 THEN label ELSE p || m END AS area_rest FROM x
""")
def area_resolution(spark, d):
    return coding.resolve_areas(coding.part_codes(I.sql(spark, d, _LABELS), I.vocabulary(spark)))


@query(_LABELS_SQL + """
SELECT DISTINCT label, CASE WHEN m <> '' THEN 'MNT' END AS measure, 'P' || p[1] AS breakdown, CASE WHEN k % 4 = 1 THEN p ELSE p || ' / ' || a END AS breakdown_label FROM x
""")
def split_indicator(spark, d):
    got = coding.split_indicators(coding.part_codes(I.sql(spark, d, _LABELS), I.vocabulary(spark)))
    return got.select("label", "measure", "breakdown", "breakdown_label")


@query("SELECT DISTINCT title, CASE WHEN title LIKE '%ontant%' THEN 'MNT' END AS measure FROM (SELECT 'Tableau ' || n_nationkey || ': ' || CASE WHEN n_nationkey % 2 = 0 THEN 'Montant, par pays' ELSE 'Stocks' END AS title FROM nation)")
def title_measure(spark, d):
    titles = I.sql(spark, d, "SELECT concat('Tableau ', n_nationkey, ': ', CASE WHEN n_nationkey % 2 = 0 THEN 'Montant, par pays' ELSE 'Stocks' END) AS title FROM {nation}")
    return titles.join(coding.title_measures(titles, I.vocabulary(spark)), "title", "left").select("title", F.col("title_measure").alias("measure"))


@query("SELECT label, CASE WHEN k < 25 THEN 'NE-' || k END AS code FROM (SELECT n_nationkey AS k, lower(n_name) AS label FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region)")
def vocabulary_exact(spark, d):
    labels = I.sql(spark, d, "SELECT lower(n_name) AS label, 'REF_AREA' AS dimension FROM {nation} UNION ALL SELECT r_name, 'REF_AREA' FROM {region}")
    return coding.exact_codes(labels, I.vocabulary(spark)).select("label", "code")


@query()
def vocabulary_fuzzy(spark, d):
    labels = I.sql(spark, d, "SELECT DISTINCT concat(substr(o_orderpriority, 1, 4), 'x', substr(o_orderpriority, 5)) AS label, 'COMPOSITE_BREAKDOWN' AS dimension FROM {orders}")
    return coding.fuzzy_codes(labels, I.vocabulary(spark)).select("label", "code", F.round("score", 3).alias("score"))


_SLUG_SQL = """
WITH l AS (SELECT p_name AS label FROM part UNION SELECT o_orderpriority FROM orders UNION SELECT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_matches(w, '[^ -~]')),
s AS (SELECT label, upper(regexp_replace(strip_accents(label), '[^A-Za-z0-9_@$-]+', '_', 'g')) AS u FROM l),
t AS (SELECT label, regexp_replace(u, '_+$', '') AS u FROM s)
SELECT label, coalesce(nullif(CASE WHEN starts_with(label, '_') THEN u ELSE regexp_replace(u, '^_+', '') END, ''), 'UNKNOWN') AS code FROM t
"""


@query(_SLUG_SQL)
def sdmx_code_slug(spark, d):
    labels = I.sql(spark, d, "SELECT p_name AS label FROM {part} UNION SELECT o_orderpriority FROM {orders} UNION SELECT w FROM (SELECT explode(split(text, ' ')) AS w FROM {documents}) WHERE w RLIKE '[^ -~]'")
    return labels.select("label", X.sdmx_code(F.col("label")).alias("code"))


_MONTHS = "('janv', 'févr', 'mars', 'avr', 'mai', 'juin', 'juil', 'août', 'sept', 'oct', 'nov', 'déc')"


@query(f"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN year(o_orderdate) || '-A1' WHEN 2 THEN year(o_orderdate) || '-Q' || quarter(o_orderdate) WHEN 3 THEN '20' || right(CAST(year(o_orderdate) AS VARCHAR), 2) || '-Q' || quarter(o_orderdate)
  WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'Variation' END AS period, CASE o_orderkey % 6 WHEN 2 THEN 'Q' WHEN 3 THEN 'Q' WHEN 4 THEN 'D' ELSE 'A' END AS freq FROM orders
""")
def period_normalise(spark, d):
    rows = I.sql(spark, d, f"""
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat(year(o_orderdate), ' Total') WHEN 1 THEN concat(year(o_orderdate), '/', year(o_orderdate) + 1, ' (p)') WHEN 2 THEN concat(year(o_orderdate), ' ', quarter(o_orderdate), ' T', year(o_orderdate))
      WHEN 3 THEN concat('T', quarter(o_orderdate), ' ', right(CAST(year(o_orderdate) AS STRING), 2), '*') WHEN 4 THEN concat(day(o_orderdate), ' ', element_at(array{_MONTHS}, month(o_orderdate)), '.-', year(o_orderdate)) ELSE 'Variation' END AS printed FROM {{orders}}
    """)
    period = X.time_period(F.col("printed"))
    return rows.select("o_orderkey", period.alias("period"), X.frequency(period).alias("freq"))


@query("""
SELECT p_partkey, u.unit, u.mult FROM part JOIN (VALUES (0, 'M3', '3'), (1, 'KG_HA', '0'), (2, 'PER', '0'), (3, 'FCFA', '9'), (4, 'UNKNOWN', '0'), (5, 'T', '0'), (6, 'NUMBER', '6')) AS u(k, unit, mult) ON p_size % 7 = u.k
""")
def unit_multiplier(spark, d):
    rows = I.sql(spark, d, "SELECT p_partkey, element_at(array('en milliers de m³', 'Rendement (kg/ha)', 'Taux (%)', 'en milliards de FCFA', 'Divers', 'Production en tonnes par an', 'Têtes (millions d’unités)'), CAST(p_size % 7 + 1 AS INT)) AS phrase FROM {part}")
    return rows.withColumn("u", X.unit_for(F.col("phrase"), F.lit(""))).select("p_partkey", "u.unit", "u.mult")


@query("""
WITH t AS (SELECT c_custkey AS page, string_agg(CAST(year(o_orderdate) AS VARCHAR), ', ' ORDER BY o_orderkey) AS text FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
p AS (SELECT page, unnest(regexp_extract_all(substr(text, 1, 600), '(?:19|20)[0-9]{2}')) AS y FROM t), n AS (SELECT page, y, count(*) AS n FROM p GROUP BY ALL)
SELECT page, arg_max(y, (n, y)) AS period FROM n GROUP BY page
""")
def detect_period(spark, d):
    pages = I.sql(spark, d, "SELECT c_custkey AS page, array_join(transform(array_sort(collect_list(struct(o_orderkey, year(o_orderdate) AS y))), x -> CAST(x.y AS STRING)), ', ') AS text FROM {customer} JOIN {orders} ON o_custkey = c_custkey GROUP BY 1")
    return pages.select("page", X.page_period(F.col("text")).alias("period"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN year(o_orderdate) || '-' || (year(o_orderdate) + 1) ELSE '' END AS period FROM orders")
def caption_period(spark, d):
    rows = I.sql(spark, d, """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('Tableau 3: Indice base 100 en 2014, ', year(o_orderdate)) WHEN 1 THEN concat('Campagne ', year(o_orderdate), ' - ', year(o_orderdate) + 1) WHEN 2 THEN concat('De ', year(o_orderdate), ' et de ', year(o_orderdate) + 1) ELSE 'Sans date' END AS caption FROM {orders}
    """)
    return rows.select("o_orderkey", X.caption_period(F.col("caption")).alias("period"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS page, CAST(i AS BIGINT) AS i, 'Tableau ' || (i + 1) || ': ' || r_name AS title, CASE WHEN i = 0 THEN 'tonnes' ELSE '' END AS unit FROM region CROSS JOIN (SELECT unnest(range(2)) AS i)")
def caption_units(spark, d):
    pages = I.sql(spark, d, "SELECT CAST(r_regionkey AS BIGINT) AS page, concat('Bulletin\\n  Tableau 1: ', r_name, '  \\nUnité : tonnes\\nUnité: kg\\ntexte\\nTableau 2: ', r_name, '\\nfin') AS text FROM {region}")
    return pages.select("page", F.posexplode(X.captions(F.col("text"))).alias("i", "x")).select("page", F.col("i").cast("long").alias("i"), "x.title", "x.unit")


# ---------------------------------------------------------------- the long table

_LONG = _CROSS + """,
long AS (SELECT page, row, col, 'A' AS FREQ, 'NE' AS REF_AREA, 'MNT' AS INDICATOR, CASE WHEN row = 'Total' THEN '_T' ELSE 'P' || row[1] END AS COMPOSITE_BREAKDOWN, CASE WHEN col = 'Total' THEN '2001' ELSE col END AS TIME_PERIOD, v AS OBS_VALUE,
  'USD' AS UNIT_MEASURE, '0' AS UNIT_MULT, CASE WHEN page % 5 = 0 AND row = 'Total' AND col IN ('1995', 'Total') THEN 'U' ELSE 'A' END AS OBS_STATUS FROM cells)
"""


@query(_LONG + "SELECT CAST(page AS BIGINT) AS page, FREQ, REF_AREA, INDICATOR, COMPOSITE_BREAKDOWN, TIME_PERIOD, OBS_VALUE, UNIT_MEASURE, UNIT_MULT, OBS_STATUS FROM long")
def to_long_observations(spark, d):
    return _orders(spark, d).long.select(F.col("page").cast("long").alias("page"), "FREQ", "REF_AREA", "INDICATOR", "COMPOSITE_BREAKDOWN", "TIME_PERIOD", "OBS_VALUE", "UNIT_MEASURE", "UNIT_MULT", "OBS_STATUS")


@query(_LONG + "SELECT OBS_STATUS, count(*) AS n, CAST(sum(CAST(OBS_VALUE AS DECIMAL(28,2))) AS DOUBLE) AS total FROM long GROUP BY 1")
def failed_cell_status(spark, d):
    seen = _orders(spark, d)
    got = coding.with_status(seen.cells, seen.checks)
    return got.groupBy("OBS_STATUS").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,2)")).cast("double").alias("total"))


@query(_CROSS + """
SELECT name, status, count(*) AS n FROM (
  SELECT 'header' AS name, 'pass' AS status FROM tt UNION ALL SELECT 'unreadable', 'pass' FROM tt UNION ALL SELECT 'bounds', 'pass' FROM tt
  UNION ALL SELECT 'column_total', CASE WHEN page % 5 = 0 AND col = '1995' THEN 'fail' ELSE 'pass' END FROM cells WHERE row = 'Total'
  UNION ALL SELECT 'row_total', CASE WHEN page % 5 = 0 AND row = 'Total' THEN 'fail' ELSE 'pass' END FROM cells WHERE col = 'Total'
  UNION ALL SELECT 'year_jump', 'warn' FROM jumps WHERE j = 1 UNION ALL SELECT 'year_jump', 'pass' FROM jumps GROUP BY page HAVING max(j) = 0) GROUP BY 1, 2
""")
def check_counts(spark, d):
    return _orders(spark, d).checks.groupBy("name", "status").agg(F.count("*").alias("n"))


@query(_CROSS + """
SELECT CAST(t.page AS BIGINT) AS page, 2 + (SELECT count(*) FROM cells c WHERE c.page = t.page AND c.row = 'Total') + (SELECT count(*) FROM cells c WHERE c.page = t.page AND c.col = 'Total') - CASE WHEN t.page % 5 = 0 THEN 2 ELSE 0 END
  + 1 + (SELECT CASE WHEN max(j) = 0 THEN 1 ELSE 0 END FROM jumps s WHERE s.page = t.page) AS n_pass, CASE WHEN t.page % 5 = 0 THEN 2 ELSE 0 END AS n_fail,
  CAST((SELECT sum(j) FROM jumps s WHERE s.page = t.page) AS BIGINT) AS n_warn, 0 AS n_skip FROM tt t
""")
def status_by_table(spark, d):
    return checks.status_counts(_orders(spark, d).checks, ["page"]).select(F.col("page").cast("long").alias("page"), "n_pass", "n_fail", "n_warn", "n_skip")


@query(_LONG + "SELECT 'dataflow' AS STRUCTURE, 'GRIDMILL:DF_OBS(1.0)' AS STRUCTURE_ID, 'I' AS ACTION, COMPOSITE_BREAKDOWN, TIME_PERIOD, OBS_VALUE, OBS_STATUS, 'text' AS EXTRACTION_METHOD, 'orders.pdf' AS SOURCE FROM long")
def sdmx_csv(spark, d):
    return sinks.sdmx_csv(_orders(spark, d).long).select("STRUCTURE", "STRUCTURE_ID", "ACTION", "COMPOSITE_BREAKDOWN", "TIME_PERIOD", "OBS_VALUE", "OBS_STATUS", "EXTRACTION_METHOD", "SOURCE")


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, '<generic:Obs><generic:ObsKey><generic:Value id="FREQ" value="A"/><generic:Value id="REF_AREA" value="NE"/><generic:Value id="INDICATOR" value="' || CASE WHEN o_orderkey % 2 = 0 THEN 'A&amp;B' ELSE 'MNT' END
  || '"/><generic:Value id="COMPOSITE_BREAKDOWN" value="_T"/><generic:Value id="TIME_PERIOD" value="' || year(o_orderdate) || '"/></generic:ObsKey>' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '<generic:ObsValue value="' || CAST(floor(o_totalprice) AS BIGINT) || '"/>' END
  || '<generic:Attributes><generic:Value id="UNIT_MEASURE" value="USD"/><generic:Value id="UNIT_MULT" value="0"/><generic:Value id="OBS_STATUS" value="A"/><generic:Value id="TIME_PERIOD_LABEL" value="' || year(o_orderdate) || '"/><generic:Value id="SOURCE" value="o"/></generic:Attributes></generic:Obs>' AS xml FROM orders
""")
def sdmx_ml_obs(spark, d):
    long = I.sql(spark, d, """
    SELECT o_orderkey, 'A' AS FREQ, 'NE' AS REF_AREA, CASE WHEN o_orderkey % 2 = 0 THEN 'A&B' ELSE 'MNT' END AS INDICATOR, '_T' AS COMPOSITE_BREAKDOWN, CAST(year(o_orderdate) AS STRING) AS TIME_PERIOD, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE floor(o_totalprice) * 1.0D END AS OBS_VALUE,
      'USD' AS UNIT_MEASURE, '0' AS UNIT_MULT, 'A' AS OBS_STATUS, CAST(year(o_orderdate) AS STRING) AS TIME_PERIOD_LABEL, CAST(NULL AS STRING) AS EXTRACTION_METHOD, 'o' AS SOURCE FROM {orders}
    """)
    return long.select("o_orderkey", sinks.sdmx_ml_observation(long).alias("xml"))


# ---------------------------------------------------------------- choice and repair

_CANDIDATES = """
SELECT n_nationkey AS page, s.stage, s.stage_rank, t.table_no, NOT (s.stage = 'text' AND n_nationkey % 3 = 1 AND t.table_no = 1) AS accepted,
  CASE WHEN s.stage = 'text' THEN n_nationkey % 2 WHEN s.stage = 'ml' THEN n_nationkey % 4 ELSE 0 END AS failed FROM {nation} CROSS JOIN (VALUES ('text', 0), ('ml', 1), ('vision', 2)) AS s(stage, stage_rank) CROSS JOIN (VALUES (0), (1)) AS t(table_no)
"""


@query(f"""
WITH c AS ({_CANDIDATES.replace('{nation}', 'nation')}), s AS (SELECT page, stage, stage_rank, count(*) AS n, sum(failed) AS f FROM c WHERE accepted GROUP BY ALL),
l AS (SELECT page, min(stage_rank) FILTER (f = 0) AS last FROM s GROUP BY page),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.page ORDER BY n DESC, f, stage_rank) AS k FROM s JOIN l USING (page) WHERE last IS NULL OR stage_rank <= last)
SELECT CAST(page AS BIGINT) AS page, stage, n AS n_tables, CAST(f AS BIGINT) AS failures FROM r WHERE k = 1
""")
def winner_selection(spark, d):
    got = select.winners(I.sql(spark, d, _CANDIDATES), ["page"])
    return got.select(F.col("page").cast("long").alias("page"), "stage", "n_tables", F.col("failures").cast("long").alias("failures"))


def _two_readers(spark, d):
    """The printed order tables, and a second reading with tables in reverse order and every third value unread."""
    first = _cells(spark, d).withColumn("stage_rank", F.lit(0)).withColumn("stage", F.lit("text"))
    first = first.withColumn("table_no", F.col("page") % 5).withColumn("page", F.floor(F.col("page") / 5).cast("int"))
    second = first.withColumn("stage", F.lit("ml")).withColumn("stage_rank", F.lit(1)).withColumn("table_no", 4 - F.col("table_no"))
    gone = (F.col("c") + F.col("r")) % 3 == 0
    return first.unionByName(second.withColumn("status", F.when(gone, "missing").otherwise(F.col("status"))).withColumn("value", F.when(~gone, F.col("value"))))


@query(_CROSS + """,
k AS (SELECT page, v, dense_rank() OVER (PARTITION BY page ORDER BY row) - 1 AS r, dense_rank() OVER (PARTITION BY page ORDER BY col) - 1 AS c FROM cells)
SELECT CAST(page // 5 AS BIGINT) AS page, CAST(page % 5 AS BIGINT) AS table_no, 'ml' AS donor_stage, CAST(4 - page % 5 AS BIGINT) AS donor_table, count(*) AS n_agree FROM k WHERE (r + c) % 3 <> 0 GROUP BY page
""")
def donor_match(spark, d):
    cells = _two_readers(spark, d)
    winner = cells.select("doc", "page", F.lit("text").alias("stage")).distinct()
    got = select.donors(cells, winner)
    return got.select(F.col("page").cast("long").alias("page"), F.col("table_no").cast("long").alias("table_no"), "donor_stage", F.col("donor_table").cast("long").alias("donor_table"), "n_agree")


@query(_CROSS + "SELECT CAST(page AS BIGINT) AS page, CASE WHEN page % 5 = 0 THEN 'ml' ELSE 'text' END AS total_source, CAST(round(ct.v, 2) AS DOUBLE) AS total_1995 FROM ct WHERE y = 1995")
def repair_rows(spark, d):
    """In every fifth nation the total of the first year is unreadable; the second reading has it."""
    good = cut(tables.frames(I.order_grids(spark, d, planted=False)), "frames")
    hurt = F.when(F.col("page") % 5 == 0, F.transform("body", lambda r, i: F.when(i == F.size("body") - 1, F.concat(F.array(F.lit("12 3 4")), F.slice(r, 2, 100))).otherwise(r))).otherwise(F.col("body"))
    bad = good.withColumn("body", hurt)
    donors = good.select(*tables.KEY, F.array(F.struct(F.lit("ml").alias("stage"), "names", "labels", "body")).alias("donors"))
    fixed = repair.repair(bad, donors, options=WIDE)
    return fixed.select(F.col("page").cast("long").alias("page"), F.element_at("sources", -1).alias("total_source"), N.value(F.element_at("body", -1)[0]).alias("total_1995"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS page, 'text' || CASE WHEN bool_or(n_nationkey % 7 = 0) THEN '+ml' ELSE '' END || CASE WHEN bool_or(n_nationkey % 7 = 3) THEN '+vision' ELSE '' END AS resolved_by FROM nation GROUP BY n_regionkey")
def provenance(spark, d):
    rows = I.sql(spark, d, "SELECT CAST(n_regionkey AS BIGINT) AS page, 'text' AS winner, CASE n_nationkey % 7 WHEN 0 THEN 'ml' WHEN 3 THEN 'vision' ELSE 'text' END AS source FROM {nation}")
    return select.provenance(rows, ["page"])


_ATTEMPTS = """
SELECT c_custkey AS page, a.n AS attempt_no, CASE WHEN a.n = 1 THEN CASE c_custkey % 5 WHEN 0 THEN 'no_text_layer' WHEN 1 THEN 'text_scan' ELSE 'text' END ELSE 'ml' END AS stage, CASE WHEN c_custkey % 5 = 4 AND a.n = 2 THEN 1 ELSE 0 END AS n_tables,
  CASE WHEN c_custkey % 5 = 2 AND a.n = 2 THEN 0.25D WHEN a.n = 2 THEN 0.75D END AS numeric_share, CASE WHEN c_custkey % 5 = 3 AND a.n = 2 THEN 'too many unreadable cells' END AS gate_reason, CASE WHEN c_custkey % 5 = 2 THEN concat('error ', a.n) END AS error
FROM {customer} CROSS JOIN (VALUES (1), (2)) AS a(n)
"""


@query("SELECT CASE c_custkey % 5 WHEN 0 THEN 'scanned page' WHEN 1 THEN 'no figures' WHEN 2 THEN 'text table' ELSE 'unreadable' END AS reason, count(*) AS n_pages FROM customer WHERE c_custkey % 5 <> 4 GROUP BY 1")
def skip_reasons(spark, d):
    return select.skip_reasons(I.sql(spark, d, _ATTEMPTS), ["page"])


@query("SELECT c_custkey AS page, CASE c_custkey % 5 WHEN 3 THEN 'too many unreadable cells' WHEN 2 THEN 'error 1' ELSE 'no table found' END AS reason FROM customer")
def no_table_reason(spark, d):
    return select.no_table_reason(I.sql(spark, d, _ATTEMPTS), ["page"])


@query("SELECT count(*) AS rows, avg(CASE WHEN o_orderkey % 9 = 0 THEN 1.0 ELSE 0.0 END) <= 0.2 AND count(*) >= 10 AS accepted, CAST(count(*) FILTER (o_orderkey % 9 = 0) AS DOUBLE) / count(*) AS error_share FROM orders")
def dataset_gate(spark, d):
    return select.dataset_gate(I.sql(spark, d, "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'U' ELSE 'A' END AS OBS_STATUS FROM {orders}"))


# ---------------------------------------------------------------- the whole path

def _run(spark, d):
    pages = I.captioned_pages(spark, d)
    files = spark.sql("SELECT 'orders' AS doc, 'orders.pdf' AS source")
    return cascade.run(I.two_readings(spark, d), pages, I.vocabulary(spark), files, options=WIDE)


_CASCADE = _CROSS.replace(" * 1.5", " * 1.0") + """,
path AS (SELECT page // 5 AS page, page % 5 AS n, 'Montant des commandes, zone ' || chr(CAST(65 + page AS INTEGER)) || ' en 2010' AS caption, row, col, v, CASE WHEN page // 5 = 1 OR (page % 10 = 0 AND row = 'Total') THEN 'ml' ELSE 'text' END AS method FROM cells),
obs AS (SELECT *, CASE WHEN row = 'Total' THEN '_T' ELSE 'P' || row[1] END AS breakdown, CASE WHEN row = 'Total' THEN '' ELSE row END AS label, CASE WHEN col = 'Total' THEN '2010' ELSE col END AS period FROM path)
"""


@query(_CASCADE + """
SELECT CAST(page AS BIGINT) AS page, CASE WHEN page = 1 THEN 4 - n ELSE n END AS table_no, 'Tableau ' || (CASE WHEN page = 1 THEN 4 - n ELSE n END + 1) || ': Montant des commandes, zone ' || chr(CAST(65 + 5 * page + CASE WHEN page = 1 THEN 4 - n ELSE n END AS INTEGER)) || ' en 2010' AS TABLE_TITLE,
  'MNT' AS INDICATOR, breakdown AS COMPOSITE_BREAKDOWN, period AS TIME_PERIOD, v AS OBS_VALUE, 'USD' AS UNIT_MEASURE, 'A' AS OBS_STATUS, method AS EXTRACTION_METHOD, 'orders.pdf' AS SOURCE FROM obs
WHERE CASE WHEN page = 1 THEN 4 - n ELSE n END = 0
""")
def cascade_first_tables(spark, d):
    """Observations of the first table of each page, the one that is repaired; the caption's own line names the unit there."""
    long = _run(spark, d).long.filter("table_no = 0")
    return long.select(F.col("page").cast("long").alias("page"), F.col("table_no").cast("long").alias("table_no"), "TABLE_TITLE", "INDICATOR", "COMPOSITE_BREAKDOWN", "TIME_PERIOD", "OBS_VALUE", "UNIT_MEASURE", "OBS_STATUS", "EXTRACTION_METHOD", "SOURCE")


@query(_CASCADE + "SELECT CAST(page AS BIGINT) AS page, EXTRACTION_METHOD, count(*) AS n, CAST(sum(CAST(v AS DECIMAL(28,2))) AS DOUBLE) AS total FROM (SELECT page, method AS EXTRACTION_METHOD, v FROM obs) GROUP BY ALL")
def cascade_observations(spark, d):
    got = _run(spark, d).long
    return got.groupBy(F.col("page").cast("long").alias("page"), "EXTRACTION_METHOD").agg(F.count("*").alias("n"), F.sum(F.col("OBS_VALUE").cast("decimal(28,2)")).cast("double").alias("total"))


@query(_CASCADE + """,
w AS (SELECT CASE WHEN page = 1 THEN page * 5 + 4 - n ELSE page * 5 + n END AS caption, CASE WHEN label = '' THEN 'Montant / _T' ELSE 'Montant / ' || label END AS series, period, v, page FROM obs),
s AS (SELECT *, lag(v) OVER (PARTITION BY caption, series ORDER BY period) AS b FROM w)
SELECT 'period_jump' AS name, CAST(NULL AS BIGINT) AS page, series AS row, period AS "column" FROM s WHERE b > 0 AND v > 0 AND (v > b * 5 OR b > v * 5)
UNION ALL SELECT 'year_jump', CAST(page // 5 AS BIGINT), row, col FROM jumps WHERE j = 1
""")
def cascade_review(spark, d):
    """What a person has to look at after the whole path: jumps between years of a table and between periods of a series."""
    return _run(spark, d).review.select("name", F.col("page").cast("long").alias("page"), F.regexp_replace("row", "^Niger / ", "").alias("row"), "column")


@query("SELECT CAST(p AS BIGINT) AS page, CASE WHEN p = 1 THEN 'ml' ELSE 'text' END AS stage, 5 AS n_tables, CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END AS has_failures FROM (SELECT unnest(range(5)) AS p)")
def cascade_winners(spark, d):
    got = cascade.resolve(I.two_readings(spark, d), I.captioned_pages(spark, d), WIDE).winners
    return got.select(F.col("page").cast("long").alias("page"), "stage", F.col("n_tables").cast("int").alias("n_tables"), (F.col("failures") > 0).cast("int").alias("has_failures"))


@query("SELECT CAST(p AS BIGINT) AS page, CAST(i AS BIGINT) AS table_no, 'Tableau ' || (i + 1) || ': Montant des commandes, zone ' || chr(CAST(65 + 5 * p + i AS INTEGER)) || ' en 2010' AS title, '2010' AS period FROM (SELECT unnest(range(5)) AS p) CROSS JOIN (SELECT unnest(range(5)) AS i)")
def caption_pairs(spark, d):
    tables_ = I.order_grids(spark, d).select("doc", F.floor(F.col("page") / 5).cast("int").alias("page"), "stage", (F.col("page") % 5).alias("table_no"))
    got = cascade.captioned(tables_, I.captioned_pages(spark, d))
    return got.select(F.col("page").cast("long").alias("page"), F.col("table_no").cast("long").alias("table_no"), "title", "period")


# ---------------------------------------------------------------- code lists and figures


@query("""
WITH c AS (SELECT 'N' || c_nationkey AS code, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Pays ' || c_nationkey ELSE '' END AS label FROM customer),
f AS (SELECT code, min(c_custkey) AS seen, arg_min(label, c_custkey) FILTER (label <> '') AS label FROM c GROUP BY code)
SELECT 'REF_AREA' AS list_id, code, coalesce(label, code) AS name, CAST(row_number() OVER (ORDER BY seen) + 1 AS BIGINT) AS ord FROM f
UNION ALL SELECT 'REF_AREA', '_T', 'Total', 0 UNION ALL SELECT 'REF_AREA', '_Z', 'Not applicable', 1
""")
def codelists(spark, d):
    long = I.sql(spark, d, "SELECT c_custkey, concat('N', c_nationkey) AS REF_AREA, CASE WHEN c_custkey % 2 = 0 THEN concat('Pays ', c_nationkey) ELSE '' END AS REF_AREA_LABEL FROM {customer}")
    return summary.code_lists(long, ["c_custkey"], ["REF_AREA"]).withColumn("ord", F.col("ord").cast("long"))


@query("""
SELECT 'CL_A' AS list_id, true AS available, CAST(count(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'O') AS BIGINT) AS n_unknown FROM orders
UNION ALL SELECT 'CL_B', false, NULL
""")
def unknown_codes(spark, d):
    used = I.sql(spark, d, "SELECT explode(array('CL_A', 'CL_B')) AS list_id, o_orderstatus AS code FROM {orders}")
    official = spark.sql("SELECT 'CL_A' AS list_id, 'O' AS code")
    available = spark.sql("SELECT * FROM VALUES ('CL_A', true), ('CL_B', false) AS t(list_id, available)")
    return summary.unknown_codes(used, official, available)


@query(_LONG + """
SELECT (SELECT count(DISTINCT page) FROM long) AS n_tables, (SELECT count(DISTINCT page) FROM long) AS n_pages, (SELECT count(*) FROM long) AS n_observations, 1.0::DOUBLE AS identified_share,
  (SELECT count(*) FROM long WHERE COMPOSITE_BREAKDOWN = '_T') AS n_totals, (SELECT count(*) FROM cells WHERE page % 5 = 0 AND row = 'Total' AND col IN ('1995', 'Total')) + (SELECT sum(j) FROM jumps) AS n_review,
  (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT page, row, col FROM cells WHERE row = 'Total' OR col = 'Total' UNION SELECT page, row, col FROM jumps WHERE j = 1)) / (SELECT count(*) FROM long) AS covered_share
""")
def run_figures(spark, d):
    seen = _orders(spark, d)
    return summary.run_figures(seen.long, seen.checks).withColumn("n_review", F.col("n_review").cast("decimal(38,0)"))


@query(_CROSS + """
SELECT CAST(page AS BIGINT) AS page, CASE WHEN col = 'Total' THEN 'row_total' ELSE 'column_total' END AS name, 'fail' AS status, row, col AS "column" FROM cells WHERE page % 5 = 0 AND row = 'Total' AND col IN ('1995', 'Total')
UNION ALL SELECT CAST(page AS BIGINT), 'year_jump', 'warn', row, col FROM jumps WHERE j = 1
UNION ALL SELECT NULL, 'period_jump', 'warn', 'N' || n || ' / Montant', t FROM (SELECT *, lag(v) OVER (PARTITION BY n ORDER BY t) AS b FROM (SELECT c_nationkey AS n, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS t,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * CASE WHEN quarter(o_orderdate) = 2 AND c_nationkey % 3 = 0 THEN 50 ELSE 1 END AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate), quarter(o_orderdate)))
  WHERE n <> 6 AND b > 0 AND v > 0 AND (v > b * 5 OR b > v * 5)
""")
def review_list(spark, d):
    got = summary.review_list(_orders(spark, d).checks, checks.period_jump_check(_quarters(spark, d)))
    return got.select(F.col("page").cast("long").alias("page"), "name", "status", "row", "column")


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS page, count(*) AS n, count(*) FILTER (year(o_orderdate) % 2 = 0) AS n_titled FROM orders GROUP BY 1")
def combine_pages(spark, d):
    titled, bare = "'Tableau' AS TABLE_TITLE, ", ""
    years = [r["y"] for r in I.sql(spark, d, "SELECT DISTINCT year(o_orderdate) AS y FROM {orders}").collect()]
    each = [I.sql(spark, d, f"SELECT o_orderkey, {bare if y % 2 else titled}{y} AS PAGE FROM {{orders}} WHERE year(o_orderdate) = {y}") for y in years]
    return select.union_all(each).groupBy(F.col("PAGE").cast("long").alias("page")).agg(F.count("*").alias("n"), F.count("TABLE_TITLE").alias("n_titled"))


# ---------------------------------------------------------------- audit, truth, worklist

_AUDIT = """
WITH o AS (SELECT 'NE-' || c_nationkey AS REF_AREA, o_orderpriority AS COMPOSITE_BREAKDOWN, floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)) AS v, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 4),
p AS (SELECT REF_AREA, COMPOSITE_BREAKDOWN, v, t.k, floor(CASE t.k WHEN 'pluvial' THEN v * 0.25 WHEN 'total' THEN v * CASE WHEN n % 4 = 0 THEN 1.1 ELSE 1.001 END ELSE v * 0.75 END) AS pv FROM o CROSS JOIN (VALUES ('pluvial'), ('irrigue'), ('total')) AS t(k) WHERE n <> 24),
g AS (SELECT *, abs(v - pv) AS gap FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY REF_AREA, COMPOSITE_BREAKDOWN ORDER BY gap, k) AS i FROM g),
a AS (SELECT REF_AREA, COMPOSITE_BREAKDOWN, v AS report_value, k AS TYPE_CULTURE, pv AS portal_value, gap, gap / nullif(abs(pv), 0) AS relative_gap, coalesce(gap / nullif(abs(pv), 0) < 0.005, false) OR gap <= 1 AS agrees FROM r WHERE i = 1)
"""


def _audited(spark, d):
    ours = I.sql(spark, d, "SELECT concat('NE-', c_nationkey) AS REF_AREA, o_orderpriority AS COMPOSITE_BREAKDOWN, CAST(floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)) AS DOUBLE) AS OBS_VALUE, c_nationkey AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2, 4")
    portal = spark.sql("SELECT concat('AF', n) AS portal_area, COMPOSITE_BREAKDOWN, k AS TYPE_CULTURE, CAST(floor(CASE k WHEN 'pluvial' THEN OBS_VALUE * 0.25D WHEN 'total' THEN OBS_VALUE * CASE WHEN n % 4 = 0 THEN 1.1D ELSE 1.001D END ELSE OBS_VALUE * 0.75D END) AS DOUBLE) AS OBS_VALUE FROM {o} LATERAL VIEW explode(array('pluvial', 'irrigue', 'total')) AS k", o=ours)
    areas = I.sql(spark, d, "SELECT concat('AF', n_nationkey) AS portal_area, concat('NE-', n_nationkey) AS REF_AREA FROM {nation} WHERE n_nationkey <> 24")
    return ours, audit.portal_audit(ours, portal, areas)


@query(_AUDIT + "SELECT * FROM a")
def portal_audit(spark, d):
    return _audited(spark, d)[1]


@query(_AUDIT + "SELECT (SELECT count(*) FROM o) AS n_ours, count(*) AS n_matched, count(*) FILTER (agrees) AS n_agreeing, count(*) FILTER (NOT agrees) AS n_differing, (SELECT count(*) FROM o) - count(*) AS n_report_only FROM a")
def audit_summary(spark, d):
    return audit.audit_summary(*_audited(spark, d))


def _truths(spark, d):
    """Typed truth of every printed table: labels are parts of the printed ones, and one column is typed wrong."""
    cells = _cells(spark, d)
    label = F.lower(F.when(F.col("row_label") == "Total", "total").otherwise(F.substring("row_label", 1, 4)))
    truth = cells.select("doc", "page", label.alias("row"), F.col("col_name").alias("column"), (F.col("value") + F.when(F.col("col_name") == "1997", 100.0).otherwise(0.25)).alias("value"))
    return audit.truth_scores(truth, cells, ["doc", "page"])


@query(_CROSS + "SELECT CAST(page AS BIGINT) AS page, count(*) AS n_cells, count(*) FILTER (col <> '1997') AS n_hits, CAST(count(*) FILTER (col <> '1997') AS DOUBLE) / count(*) AS share FROM cells GROUP BY page")
def truth_score(spark, d):
    return _truths(spark, d).select(F.col("page").cast("long").alias("page"), "n_cells", "n_hits", "share")


@query(_CROSS + "SELECT count(*) AS n_cells, count(*) FILTER (col <> '1997') AS n_hits, CAST(count(*) FILTER (col <> '1997') AS DOUBLE) / count(*) AS share FROM cells")
def truth_metrics(spark, d):
    return audit.metrics(_truths(spark, d))


_COUNTS = "SELECT 'EVENT' AS dimension, event_type AS label, count(*) AS n FROM {events} GROUP BY 2 UNION ALL SELECT 'TYPE', p_type, count(*) FROM {part} GROUP BY 2"


@query("""
WITH c AS (SELECT 'EVENT' AS dimension, event_type AS label, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'TYPE', p_type, count(*) FROM part GROUP BY 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY dimension) AS t, sum(n) OVER (PARTITION BY dimension ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT dimension, label, n AS observations, round(CAST(n AS DOUBLE) / t, 4) AS share, round(CAST(run AS DOUBLE) / t, 4) AS cumulative, dimension = 'EVENT' AS already_named FROM w
""")
def vocabulary_worklist(spark, d):
    counts = I.sql(spark, d, _COUNTS)
    known = I.sql(spark, d, "SELECT DISTINCT 'EVENT' AS dimension, upper(event_type) AS label FROM {events}")
    return audit.worklist(counts, counts, known)


@query("""
WITH c AS (SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1), w AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY n DESC, label) AS k FROM c)
SELECT 'NAME' AS dimension, CAST(top AS BIGINT) AS top, max(round(CAST(run AS DOUBLE) / t, 4)) AS cumulative FROM w JOIN (VALUES (25), (100), (200)) AS x(top) ON k <= top GROUP BY top
""")
def coverage(spark, d):
    counts = I.sql(spark, d, "SELECT 'NAME' AS dimension, p_name AS label, count(*) AS n FROM {part} GROUP BY 2")
    none = spark.sql("SELECT 'NAME' AS dimension, 'none' AS label")
    return audit.coverage(audit.worklist(counts, counts, none)).withColumn("top", F.col("top").cast("long"))


@query()
def label_clusters(spark, d):
    counts = I.sql(spark, d, "SELECT 'NAME' AS dimension, label, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, 's') ELSE p_name END AS label FROM {part}) GROUP BY 2")
    return audit.clusters(counts)


# ---------------------------------------------------------------- sources


@query("SELECT n_nationkey::BIGINT AS id, CAST(r AS BIGINT) AS r, CASE r WHEN 0 THEN 'Pays|Clé' ELSE n_name || '|' || n_nationkey END AS line FROM nation CROSS JOIN (SELECT unnest(range(2)) AS r)")
def html_tables(spark, d):
    rows = I.sql(spark, d, "SELECT CAST(n_nationkey AS BIGINT) AS id, concat('<p>x</p><TABLE><tr><th>Pays</th><th>Clé</th></tr><tr><td> ', n_name, ' </td><td>', n_nationkey, '</td></tr></TABLE><table><tr><td>no</td></tr></table>') AS html FROM {nation} UNION ALL SELECT page_id, html FROM {pages}")
    got = readers.html_tables(rows).filter("size(cells) > 0").select("id", F.posexplode("cells").alias("r", "row"))
    return got.select("id", F.col("r").cast("long").alias("r"), F.array_join("row", "|").alias("line"))


@query("SELECT n_nationkey::BIGINT AS id, CAST(r AS BIGINT) AS r, CASE r WHEN 0 THEN 'Pays,Clé' ELSE n_name || ',' || n_nationkey END AS line FROM nation CROSS JOIN (SELECT unnest(range(2)) AS r)")
def markdown_tables(spark, d):
    rows = I.sql(spark, d, "SELECT CAST(n_nationkey AS BIGINT) AS id, concat('text\\n| Pays | Clé |\\n|---|:-:|\\n| ', n_name, ' | ', n_nationkey, ' |\\nend') AS md FROM {nation}")
    return rows.select("id", F.posexplode(readers.markdown_grid(F.col("md"))).alias("r", "row")).select("id", F.col("r").cast("long").alias("r"), F.array_join("row", ",").alias("line"))


@query("SELECT n_nationkey::BIGINT AS id, CAST(1 AS BIGINT) AS n_rows, n_name AS first FROM nation")
def ocr_blocks(spark, d):
    rows = I.sql(spark, d, """
    SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 2 = 0 THEN to_json(struct(struct(b AS parsing_res_list) AS res)) ELSE to_json(struct(b AS parsing_res_list)) END AS json FROM (
      SELECT n_nationkey, array(struct('text' AS block_label, 'title' AS block_content), struct('table' AS block_label, CASE WHEN n_nationkey % 3 = 0 THEN concat('<table><tr><td>', n_name, '</td><td>1</td></tr></table>') ELSE concat('| ', n_name, ' | 1 |') END AS block_content), struct('table' AS block_label, ' ' AS block_content)) AS b FROM {nation})
    """)
    return readers.ocr_grids(rows).select("id", F.size("cells").cast("long").alias("n_rows"), F.col("cells")[0][0].alias("first"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1")
def incremental_refresh(spark, d):
    """Events come in three files; a stream takes what is new at each of two calls."""
    from gridmill.streaming.refresh import refresh
    from gridmill.shared import fresh

    events = I.table(spark, d, "events").select("event_id", "event_type", "value")
    at = fresh(spark, "refresh")
    schema = "event_id long, event_type string, value double"

    def work(batch: DataFrame) -> DataFrame:
        return batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,4)")).alias("total"))

    for k in range(3):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).write.mode("append").parquet(f"{at}/in")
        if k:
            got = refresh(spark, f"{at}/in", schema, work, f"{at}/out", f"{at}/seen")
    return got.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))


@query(_LONG + "SELECT OBS_STATUS, count(*) AS n, CAST(sum(CAST(OBS_VALUE AS DECIMAL(28,2))) AS DOUBLE) AS total, 0 AS n_jumps FROM long GROUP BY 1")
def incremental_observations(spark, d):
    """Printed tables come in three files; a stream takes what is new at each of two calls, then looks for jumps in all that has come."""
    from gridmill.shared import fresh
    from gridmill.streaming.refresh import refresh_observations

    at = fresh(spark, "refresh")
    grids = cut(I.order_grids(spark, d), "grids")
    for k in range(3):
        grids.filter(F.pmod("page", F.lit(3)) == k).write.mode("append").parquet(f"{at}/in")
        if k:
            long, jumps = refresh_observations(spark, f"{at}/in", grids.schema, I.order_context, I.vocabulary(spark), f"{at}/out", f"{at}/seen", options=WIDE)
    n = jumps.agg(F.count("*").cast("int").alias("n_jumps"))
    return long.groupBy("OBS_STATUS").agg(F.count("*").alias("n"), F.sum(F.col("OBS_VALUE").cast("decimal(28,2)")).cast("double").alias("total")).crossJoin(n)
