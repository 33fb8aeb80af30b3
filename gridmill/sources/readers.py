"""Sources: grids, pages, CSV files with fixed all-text schemas, tables inside HTML, Markdown and OCR results."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRIDS = "doc string, page int, stage string, stage_rank int, table_no int, cells array<array<string>>, report map<string,string>"
PAGES = "doc string, page int, text string"


def grids(spark: SparkSession, path: str) -> DataFrame:
    """Readings of tables, as Parquet of schema GRIDS."""
    return spark.read.schema(GRIDS).parquet(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of text columns with a header; nulls are empty."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """label, code, dimension, unit, note and ord, the place in the file (a code list that a person keeps, one partition)."""
    rows = text_csv(spark, path, ["label", "code", "dimension", "unit", "note"])
    return rows.coalesce(1).withColumn("ord", F.monotonically_increasing_id().cast("int"))


def source_list(spark: SparkSession, path: str) -> DataFrame:
    return text_csv(spark, path, ["file", "url", "page", "time_period", "unit", "subject"])


def portal(spark: SparkSession, path: str) -> DataFrame:
    """REF_AREA, SPECULATION, TYPE_CULTURE, TIME_PERIOD and OBS_VALUE; values that are no numbers are null."""
    rows = text_csv(spark, path, ["REF_AREA", "SPECULATION", "TYPE_CULTURE", "TIME_PERIOD", "OBS_VALUE"])
    plain = F.col("OBS_VALUE").rlike(r"^\s*[+-]?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?\s*$")
    return rows.withColumn("OBS_VALUE", F.when(plain, F.trim("OBS_VALUE").try_cast("double")))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """row, column, value, and stem and page from file names like STEM_p21_truth.csv."""
    name = F.col("_metadata.file_name")
    rows = spark.read.schema("row string, column string, value double").option("header", True).csv(path)
    return rows.select("row", "column", "value", F.regexp_extract(name, r"^(.*)_p([0-9]+)_truth\.csv$", 1).alias("stem"), F.regexp_extract(name, r"^(.*)_p([0-9]+)_truth\.csv$", 2).try_cast("int").alias("page"))


def long_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An earlier run's observations, all text."""
    return text_csv(spark, path, columns)


def code_list_xml(xml: Column) -> Column:
    """array<struct<code, name>> of a code list in SDMX-ML, in order; null if it can't be read or has no codes."""
    ids = F.regexp_extract_all(xml, F.lit(r'(?s)<(?:\w+:)?Code\b[^>]*?\bid="([^"]*)"'), F.lit(1))
    bodies = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?Code\b[^>]*>(.*?)</(?:\w+:)?Code>"), F.lit(1))
    names = F.transform(bodies, lambda b: F.regexp_extract(b, r"(?s)<(?:\w+:)?Name\b[^>]*>(.*?)</", 1))
    return F.when((F.size(ids) > 0) & (F.size(ids) == F.size(names)), F.arrays_zip(ids.alias("code"), names.alias("name")))


# ---------------------------------------------------------------- tables inside texts


def markdown_grid(text: Column) -> Column:
    """Cells of a Markdown table: lines that begin with a pipe, the line of dashes left out."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n", -1), lambda s: F.trim(s)), lambda s: s.startswith("|") & ~s.rlike(r"^\|[\s:|-]*-[\s:|-]*$"))
    return F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c)))


#: The longest spans that the HTML standard allows; longer ones count as so long. Fixed values.
COLSPAN, ROWSPAN = 1000, 65534


class _Table(HTMLParser):
    """The first table of a text, row by row; spans are repeated, up to the standard's COLSPAN and ROWSPAN."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.depth, self.done, self.cell, self.span = 0, False, None, (1, 1)
        self.down: dict[tuple[int, int], str] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
            self._fill()
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            got = dict(attrs)
            self.cell, self.span = [], tuple(max(1, int(v)) if (v := got.get(k) or "1").isdigit() else 1 for k in ("rowspan", "colspan"))
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self._close()
            self.depth -= 1
            self.done = self.done or self.depth == 0
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.done:
            self.cell.append(data)

    def _fill(self) -> None:
        row = self.rows[-1]
        while (text := self.down.pop((len(self.rows) - 1, len(row)), None)) is not None:
            row.append(text)

    def _close(self) -> None:
        if self.cell is None:
            return
        text, (high, wide), self.cell = " ".join("".join(self.cell).split()), self.span, None
        for _ in range(min(wide, COLSPAN)):
            at = len(self.rows[-1])
            self.rows[-1].append(text)
            for k in range(1, min(high, ROWSPAN)):
                self.down[(len(self.rows) - 1 + k, at)] = text
        self._fill()


def html_grid(text: str | None) -> list[list[str]] | None:
    """Cells of the first table of an HTML text; none without one."""
    parser = _Table()
    parser.feed(text or "")
    parser.close()
    return [r for r in parser.rows if r] or None


def html_tables(rows: DataFrame, html: str = "html", out: str = "cells") -> DataFrame:
    """rows whose HTML has a table, with its cells; the test for a tag is native and comes first."""

    @F.pandas_udf("array<array<string>>")
    def kernel(batch: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batch:
            yield s.map(html_grid)

    return rows.filter(F.col(html).rlike(r"(?i)<table\b")).withColumn(out, kernel(F.col(html))).filter(F.col(out).isNotNull())


def ocr_blocks(rows: DataFrame, json: str = "json") -> DataFrame:
    """Non-empty table blocks of OCR results in JSON: the columns of rows, block_no and content; `res` around a result is unwrapped."""
    block = "array<struct<block_label:string,block_content:string>>"
    parsed = F.from_json(json, f"res struct<parsing_res_list:{block}>, parsing_res_list {block}")
    listed = F.coalesce(parsed["res"]["parsing_res_list"], parsed["parsing_res_list"])
    tables = F.filter(listed, lambda b: (b["block_label"] == "table") & (F.trim(F.coalesce(b["block_content"], F.lit(""))) != ""))
    return rows.select(*[c for c in rows.columns if c != json], F.posexplode(tables).alias("block_no", "b")).select("*", F.col("b.block_content").alias("content")).drop("b")


def ocr_grids(rows: DataFrame, json: str = "json") -> DataFrame:
    """Grids of OCR results: HTML blocks through the table parser, others as Markdown; blocks without cells are left out."""
    blocks = ocr_blocks(rows, json)
    marked = blocks.filter(~F.col("content").rlike(r"(?i)<table\b")).withColumn("cells", markdown_grid(F.col("content")))
    return html_tables(blocks, "content").unionByName(marked).filter("size(cells) > 0").drop("content")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc, page (from 1), text of text files whose pages end with form feeds, as text extractors of PDF write them."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.split(F.regexp_replace("value", "\f$", ""), "\f", -1).alias("p"))
    return files.select("doc", F.posexplode("p").alias("page", "text")).select("doc", (F.col("page") + 1).alias("page"), "text")


def _pdf_pages(spark: SparkSession, path: str, work, schema: str) -> DataFrame:
    """Rows that `work` makes of each page of PDF files by pdfplumber, where it is installed.

    A file is opened by the task that holds it; pages go one at a time, and a page (or file) that can't
    be read gives what `work` makes of None and the error, so that no page stops the others.
    """
    import pdfplumber  # noqa: F401  # fails here, on the driver, where it is missing

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber as reader

        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    pdf = reader.open(io.BytesIO(data))
                except Exception as e:  # noqa: BLE001  # whatever a broken file raises
                    yield work(name, 0, None, str(e)[:200])
                    continue
                with pdf:
                    for number, page in enumerate(pdf.pages, 1):
                        try:
                            out = work(name, number, page, "")
                        except Exception as e:  # noqa: BLE001
                            out = work(name, number, None, str(e)[:200])
                        yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def pdf_grids(spark: SparkSession, path: str) -> DataFrame:
    """Grids of PDF files: ruled lines first, then white space. A page that can't be read has one row without cells and its error in the report."""

    def work(name: str, number: int, page, error: str) -> pd.DataFrame:
        columns = ["doc", "page", "stage", "stage_rank", "table_no", "cells", "report"]
        if page is None:
            return pd.DataFrame([(name, number, "text", 0, 0, None, {"error": error})], columns=columns)
        out = []
        for how in ("lines", "text"):
            out = [t for t in page.extract_tables({"vertical_strategy": how, "horizontal_strategy": how}) if len(t) >= 2 and len(t[0]) >= 2]
            if out:
                break
        return pd.DataFrame([(name, number, "text", 0, i, t, {}) for i, t in enumerate(out)], columns=columns)

    return _pdf_pages(spark, path, work, GRIDS)


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc, page, text of PDF files; a page that can't be read has an empty text."""

    def work(name: str, number: int, page, error: str) -> pd.DataFrame:
        return pd.DataFrame([(name, number, "" if page is None else page.extract_text() or "")], columns=["doc", "page", "text"])

    return _pdf_pages(spark, path, work, PAGES)
