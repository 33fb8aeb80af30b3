"""Sinks: SDMX-CSV, SDMX-ML, lists for people."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators.select import require_dataset
from gridmill.operators.tables import KEY
from gridmill.options import DEFAULT, Options
from gridmill.shared import fresh

DIMENSIONS = ("FREQ", "REF_AREA", "INDICATOR", "COMPOSITE_BREAKDOWN", "TIME_PERIOD")
MEASURE = "OBS_VALUE"
ATTRIBUTES = ("UNIT_MEASURE", "UNIT_MULT", "OBS_STATUS", "TIME_PERIOD_LABEL", "EXTRACTION_METHOD", "SOURCE")


def sdmx_csv(long: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The columns of SDMX-CSV 2.0, in order."""
    flow = f"{options.agency}:{options.dataflow}({options.version})"
    return long.select(F.lit("dataflow").alias("STRUCTURE"), F.lit(flow).alias("STRUCTURE_ID"), F.lit("I").alias("ACTION"), *DIMENSIONS, MEASURE, *ATTRIBUTES)


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def one_file(spark: SparkSession, folder: str, path: str, head: bytes = b"", foot: bytes = b"") -> None:
    """The part files of a folder, in order, as one file between head and foot; it is renamed into place when complete.

    The driver copies streams and holds a buffer only; the folder goes.
    """
    at, files = _files(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    out = files.create(beside)
    out.write(head)
    source, held = _files(spark, folder)
    parts = sorted(str(s.getPath()) for s in held.listStatus(source) if s.getPath().getName().startswith("part-"))
    for part in parts:
        stream = held.open(spark._jvm.org.apache.hadoop.fs.Path(part))
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
        stream.close()
    out.write(foot)
    out.close()
    replace_file(spark, str(beside), path)
    held.delete(source, True)


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another one in one step."""
    java = spark._jvm
    options = java.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = java.org.apache.hadoop.fs.FileContext.getFileContext(java.org.apache.hadoop.fs.Path(target).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(java.org.apache.hadoop.fs.Path(source), java.org.apache.hadoop.fs.Path(target), over)


def csv_line(columns: list[Column]) -> Column:
    """Texts as a line of CSV; what holds a comma, quote or line break is quoted, nulls are empty."""

    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[field(c) for c in columns])


def write_csv(frame: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, null as empty, lines ended by a line feed."""
    frame.write.mode("overwrite").option("header", True).option("emptyValue", "").option("lineSep", "\n").csv(path)


def write_csv_file(frame: DataFrame, path: str, bom: bool = False) -> None:
    """One CSV file with one header; with `bom` it begins with a byte order mark, for spreadsheets."""
    spark = frame.sparkSession
    folder = fresh(spark, "csv")
    frame.select(csv_line([F.col(f"`{c}`") for c in frame.columns]).alias("value")).write.option("lineSep", "\n").text(folder)
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in frame.columns)
    one_file(spark, folder, path, ("\ufeff" if bom else "").encode() + f"{head}\n".encode())


def write_tables(framed: DataFrame, path: str, key: Sequence[str] = KEY) -> None:
    """Each table as printed, in a CSV of its own below a folder named by its key; a table is one row, so one task writes it whole."""
    head = csv_line_of(F.concat(F.array("label_name"), "names"))
    body = F.transform(F.arrays_zip("labels", "body"), lambda r: csv_line_of(F.concat(F.array(r["labels"]), r["body"])))
    framed.select(*key, F.array_join(F.concat(F.array(head), body), "\n").alias("value")).write.mode("overwrite").partitionBy(*key).option("lineSep", "\n").text(path)


def csv_line_of(cells: Column) -> Column:
    """As csv_line, for the texts of an array."""

    def field(text: Column) -> Column:
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.array_join(F.transform(cells, lambda c: field(F.coalesce(c, F.lit("")))), ",")


def write_metrics(frame: DataFrame, path: str) -> None:
    """Metrics, audits or worklists as JSON lines, one file: they are a row for each table or label, not for each cell."""
    spark = frame.sparkSession
    folder = fresh(spark, "json")
    frame.select(F.to_json(F.struct(*frame.columns)).alias("value")).write.option("lineSep", "\n").text(folder)
    one_file(spark, folder, path)


def escaped(text: Column) -> Column:
    out = text
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def number_text(value: Column) -> Column:
    """A double without a needless fraction."""
    return F.when(value == F.floor(value), F.format_string("%d", value.cast("long"))).otherwise(value.cast("string"))


def sdmx_ml_observation(long: DataFrame) -> Column:
    """One generic observation as an XML fragment; a null value is left out."""

    def pair(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f'<generic:Value id="{name}" value="'), escaped(F.col(name)), F.lit('"/>'))).otherwise("")

    value = F.when(F.col(MEASURE).isNotNull(), F.concat(F.lit('<generic:ObsValue value="'), number_text(F.col(MEASURE)), F.lit('"/>'))).otherwise("")
    return F.concat(F.lit("<generic:Obs><generic:ObsKey>"), *map(pair, DIMENSIONS), F.lit("</generic:ObsKey>"), value, F.lit("<generic:Attributes>"), *map(pair, ATTRIBUTES), F.lit("</generic:Attributes></generic:Obs>"))


def write_sdmx_ml(long: DataFrame, path: str, prepared: str, options: Options = DEFAULT) -> None:
    """A whole generic data message in one file: executors write the observations, the driver puts header and end around them."""
    spark = long.sparkSession
    folder = fresh(spark, "sdmx")
    long.select(sdmx_ml_observation(long).alias("value")).write.option("lineSep", "\n").text(folder)
    head, foot = data_message(prepared, options)
    one_file(spark, folder, path, head.encode(), foot.encode())


def data_message(prepared: str, options: Options = DEFAULT) -> tuple[str, str]:
    """(what stands before the observations, what stands after) in a generic data message."""
    base = "http://www.sdmx.org/resources/sdmxml/schemas/v2_1"
    head = (
        f'<?xml version="1.0" encoding="UTF-8"?><message:GenericData xmlns:message="{base}/message" xmlns:generic="{base}/data/generic" xmlns:common="{base}/common">'
        f'<message:Header><message:ID>{escape(options.dataflow)}</message:ID><message:Test>false</message:Test><message:Prepared>{escape(prepared)}</message:Prepared><message:Sender id={quoteattr(options.agency)}/>'
        f'<message:Structure structureID="S" dimensionAtObservation="AllDimensions"><common:Structure><Ref agencyID={quoteattr(options.agency)} id="DSD_{options.dataflow}" version={quoteattr(options.version)}/></common:Structure></message:Structure></message:Header>'
        '<message:DataSet action="Replace" structureRef="S">'
    )
    return head, "</message:DataSet></message:GenericData>"


def structure_message(code_lists: dict[str, list[tuple[str, str]]], prepared: str, options: Options = DEFAULT) -> str:
    """Dataflow, code lists, concepts and data structure, in schema order, from the code lists of one data set."""
    base, who, v = "http://www.sdmx.org/resources/sdmxml/schemas/v2_1", quoteattr(options.agency), quoteattr(options.version)
    flow, dsd = options.dataflow, f"DSD_{options.dataflow}"

    def named(tag: str, ident: str, body: str, own: str = "") -> str:
        return f"<structure:{tag} id={quoteattr(ident)}{own}><common:Name>{escape(ident)}</common:Name>{body}</structure:{tag}>"

    kept = f" agencyID={who} version={v}"
    lists = "".join(
        named("Codelist", f"CL_{name}", "".join(f"<structure:Code id={quoteattr(c)}><common:Name>{escape(n)}</common:Name></structure:Code>" for c, n in codes), kept) for name, codes in code_lists.items()
    )
    concepts = "".join(named("Concept", c, "") for c in (*DIMENSIONS, MEASURE, *ATTRIBUTES))

    def local(c: str) -> str:
        ref = f'<structure:ConceptIdentity><Ref id="{c}" maintainableParentID="CS_{flow}" maintainableParentVersion={v} agencyID={who}/></structure:ConceptIdentity>'
        kind = f'<structure:LocalRepresentation><structure:Enumeration><Ref id="CL_{c}" version={v} agencyID={who}/></structure:Enumeration></structure:LocalRepresentation>' if c in code_lists else ""
        return ref + kind

    dims = "".join(f'<structure:Dimension id="{c}" position="{i}">{local(c)}</structure:Dimension>' for i, c in enumerate(DIMENSIONS[:-1], 1))
    dims += f'<structure:TimeDimension id="TIME_PERIOD" position="{len(DIMENSIONS)}">{local("TIME_PERIOD")}<structure:LocalRepresentation><structure:TextFormat textType="ObservationalTimePeriod"/></structure:LocalRepresentation></structure:TimeDimension>'
    attrs = "".join(f'<structure:Attribute id="{c}" assignmentStatus="Conditional">{local(c)}<structure:AttributeRelationship><structure:PrimaryMeasure><Ref id="{MEASURE}"/></structure:PrimaryMeasure></structure:AttributeRelationship></structure:Attribute>' for c in ATTRIBUTES)
    parts = f'<structure:DataStructureComponents><structure:DimensionList id="DimensionDescriptor">{dims}</structure:DimensionList><structure:AttributeList id="AttributeDescriptor">{attrs}</structure:AttributeList><structure:MeasureList id="MeasureDescriptor"><structure:PrimaryMeasure id="{MEASURE}">{local(MEASURE)}</structure:PrimaryMeasure></structure:MeasureList></structure:DataStructureComponents>'
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><message:Structure xmlns:message="{base}/message" xmlns:structure="{base}/structure" xmlns:common="{base}/common">'
        f"<message:Header><message:ID>{escape(flow)}</message:ID><message:Test>false</message:Test><message:Prepared>{escape(prepared)}</message:Prepared><message:Sender id={who}/></message:Header><message:Structures>"
        f"<structure:Dataflows>{named('Dataflow', flow, f'<structure:Structure><Ref id={quoteattr(dsd)} version={v} agencyID={who}/></structure:Structure>', kept)}</structure:Dataflows>"
        f"<structure:Codelists>{lists}</structure:Codelists><structure:Concepts>{named('ConceptScheme', f'CS_{flow}', concepts, kept)}</structure:Concepts>"
        f"<structure:DataStructures>{named('DataStructure', dsd, parts, kept)}</structure:DataStructures></message:Structures></message:Structure>"
    )


def write_refresh(long: DataFrame, review: DataFrame, path: str, data_date: str, options: Options = DEFAULT) -> str:
    """Observations and review list as a new snapshot below `path`, written only if the data set passes its gate.

    The file CURRENT names the snapshot that counts and is replaced in one step when both outputs are
    complete, so a reader never sees one without the other, and a failure leaves the last snapshot
    standing. The snapshot before the last is deleted. Returns the new one's path.
    """
    require_dataset(long, options)
    spark = long.sparkSession
    old = current(spark, path)
    name = f"snapshot-{uuid.uuid4().hex}"
    write_csv(long.withColumn("DATA_DATE", F.lit(data_date)), f"{path}/{name}/observations")
    write_csv_file(review, f"{path}/{name}/to_review.csv", bom=True)
    beside, files = _files(spark, f"{path}/.CURRENT-{name}")
    out = files.create(beside)
    out.write(name.encode())
    out.close()
    replace_file(spark, str(beside), f"{path}/CURRENT")
    home, _ = _files(spark, path)
    for s in files.listStatus(home):
        at = s.getPath()
        if at.getName().startswith("snapshot-") and at.getName() != name and not (old or "").endswith(at.getName()):
            files.delete(at, True)
    return f"{path}/{name}"


def current(spark: SparkSession, path: str) -> str | None:
    """The snapshot below `path` that counts; none before the first."""
    at, files = _files(spark, f"{path}/CURRENT")
    if not files.exists(at):
        return None
    return f"{path}/" + spark.read.text(f"{path}/CURRENT", wholetext=True).first()[0].strip()


def write_bundle(long: DataFrame, review: DataFrame, code_lists: dict[str, list[tuple[str, str]]], folder: str, prepared: str, options: Options = DEFAULT) -> str:
    """Five files for people, each loose and together in a zip: SDMX-CSV, the data and structure messages, the long table, the review list.

    `folder` must be a folder of this machine that the executors share; the zip is written by streams.
    """
    spark = long.sparkSession
    names = {"observations_sdmx.csv": lambda p: write_csv_file(sdmx_csv(long, options), p), "data.xml": lambda p: write_sdmx_ml(long, p, prepared, options), "observations.csv": lambda p: write_csv_file(long, p, bom=True), "to_review.csv": lambda p: write_csv_file(review, p, bom=True)}
    for name, write in names.items():
        write(f"{folder}/{name}")
    at, files = _files(spark, f"{folder}/structure.xml")
    out = files.create(at, True)
    out.write(structure_message(code_lists, prepared, options).encode())
    out.close()
    home = folder.removeprefix("file://")
    with zipfile.ZipFile(f"{home}/bundle.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name in (*names, "structure.xml"):
            z.write(f"{home}/{name}", name)
    return f"{home}/bundle.zip"
