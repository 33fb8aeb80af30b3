"""The queries of this subpackage: op1 to op10, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import decontaminate, licenses, packing, pii, quality_cnn, quality_rules, simhash, substring_dedup, token_output, url_filters
from gridmill.llm.common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(file: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(file)


def op1_columns(pieces: DataFrame, *more: str) -> DataFrame:
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_columns(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.spans(table(spark, sf_dir, "documents"))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE]
    return got.select(F.col("id").alias("doc_id"), *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


#: Fixed entries of the dated list: (list, domain, date, added).
LIST_EVENTS = (
    ("gambling", "casino-win.example.com", "2024-01-15", True),
    ("gambling", "casino-win.example.com", "2024-06-01", False),
    ("gambling", "casino-win.example.com", "2024-09-10", True),
    ("gambling", "free-bets.example.com", "2024-03-01", True),
    ("adult", "adult-cam.example.net", "2024-02-01", True),
    ("malware", "example.org", "2024-12-01", True),
)

#: The lists that hosts are dealt to, and the rule's steps: (day after the first, list's turn, every so many hosts, added).
LISTS = ("spam", "malware", "phishing")
STEPS = ((0, 1, True), (30, 2, False), (100, 4, True), (101, 8, False))


def list_events(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The dated list, which grows with the hosts: the fixed entries, and by rule entries of every fifth host that pages have.

    A host's number is the first 16 bits of its MD5; it names the list and the day in 2024 of the first
    entry. Every host of those is added, every second removed 30 days later, every fourth added again
    after 100 days, and every eighth removed again on the day after that.
    """
    values = ", ".join(f"('{n}', '{d}', DATE '{at}', {str(on).lower()})" for n, d, at, on in LIST_EVENTS)
    fixed = spark.sql(f"SELECT * FROM VALUES {values} AS t(list, domain, at, added)")
    hosts = pages.select(url_filters.host(F.col("url")).alias("domain")).filter("domain is not null").distinct()
    k = F.conv(F.substring(F.md5("domain"), 1, 4), 16, 10).cast("int")
    listed = hosts.withColumn("k", k).filter("k % 5 = 0")
    steps = F.array(*[F.struct(F.lit(day).alias("day"), F.lit(each).alias("each"), F.lit(on).alias("added")) for day, each, on in STEPS])
    dated = listed.select("domain", "k", F.explode(steps).alias("s")).filter("k div 5 % s.each = 0")
    name = F.element_at(F.array(*[F.lit(x) for x in LISTS]), F.col("k") % 3 + 1)
    at = F.date_add(F.lit("2024-01-01").cast("date"), F.col("k") % 200 + F.col("s.day"))
    return fixed.unionByName(dated.select(name.alias("list"), "domain", at.alias("at"), F.col("s.added").alias("added")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures against the list; pages carry no fetch time, so day `page_id modulo 366` of 2024 stands for it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    return url_filters.judge(pages, list_events(spark, pages)).withColumnRenamed("id", "page_id")


URL_SQL = """
WITH p AS (SELECT row_number() OVER () AS k, page_id, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.'), '') AS host,
  CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched FROM pages),
h AS (SELECT DISTINCT host AS domain, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n FROM p WHERE host IS NOT NULL),
e AS (SELECT list, domain, day, bool_and(added) AS added FROM (
  SELECT * FROM (VALUES {values}) AS f(list, domain, day, added)
  UNION ALL SELECT [{lists}][n % 3 + 1], domain, CAST(DATE '2024-01-01' + CAST(n % 200 + s.d AS INTEGER) AS DATE), s.added FROM h JOIN (VALUES {steps}) AS s(d, each, added) ON n // 5 % s.each = 0 WHERE n % 5 = 0) GROUP BY ALL),
v AS (SELECT list, domain, day AS valid_from, added, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS valid_to FROM e),
hit AS (SELECT p.k, count(*) AS n, string_agg(DISTINCT v.list, ',' ORDER BY v.list) AS lists FROM p JOIN v
  ON v.added AND (p.host = v.domain OR ends_with(p.host, '.' || v.domain)) AND p.fetched >= v.valid_from AND (v.valid_to IS NULL OR p.fetched < v.valid_to) GROUP BY p.k)
SELECT p.page_id, p.host, p.fetched, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_active, coalesce(hit.lists, '') AS lists, hit.n IS NOT NULL AS blocked FROM p LEFT JOIN hit USING (k)
"""


def url_sql() -> str:
    values = ", ".join(f"('{n}', '{d}', DATE '{at}', {str(on).lower()})" for n, d, at, on in LIST_EVENTS)
    steps = ", ".join(f"({day}, {each}, {str(on).lower()})" for day, each, on in STEPS)
    return URL_SQL.format(values=values, lists=", ".join(f"'{x}'" for x in LISTS), steps=steps)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "first_word", "last_word")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.groups(table(spark, sf_dir, "documents"), shingle=4)
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    manifest = token_output.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_output.read(spark, path, manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with a cue, alone or with its neighbours, as the SQL has them; and each notice that only its whole paragraph shows.

    The SQL lacks the latter, which stand at their paragraph's first line as `wrapped`. A paragraph read whole that
    names no family is no notice and gives no row of its own.
    """
    got = licenses.scan(table(spark, sf_dir, "documents")).filter((~F.col("whole")) | (F.col("family") != licenses.UNKNOWN))
    return got.select(F.col("id").alias("doc_id"), "paragraph", "wrapped", "predicted", "margin", "overlap", "family")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_url_filters": op3_url_filters,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_token_output": op8_token_output,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": url_sql(),
    "op10_licenses": licenses.oracle_sql(),
}
