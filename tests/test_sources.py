import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from gridmill.operators import audit, select, summary
from gridmill.options import DEFAULT
from gridmill.sources import readers, sinks
from gridmill.streaming.refresh import refresh


def test_html_spans_and_first_table_only():
    html = "<div><table><tr><th colspan=2>a&amp;b</th></tr><tr><td rowspan=2>x</td><td>1<br>2</td></tr><tr><td>3</td></tr></table><table><tr><td>no</td></tr></table>"
    assert readers.html_grid(html) == [["a&b", "a&b"], ["x", "1 2"], ["x", "3"]]
    assert readers.html_grid("<p>none</p>") is None and readers.html_grid(None) is None


def test_csv_sources(spark, tmp_path):
    (tmp_path / "v.csv").write_text('label,code,dimension,unit,note\nMil,MIL,COMPOSITE_BREAKDOWN,,\n"a, b",AB,INDICATOR,t,x\n')
    rows = readers.vocabulary(spark, str(tmp_path / "v.csv")).orderBy("ord").collect()
    assert [(r["label"], r["unit"]) for r in rows] == [("Mil", ""), ("a, b", "t")]
    (tmp_path / "p.csv").write_text("REF_AREA,SPECULATION,TYPE_CULTURE,TIME_PERIOD,OBS_VALUE\nA,B,C,2024,1.5\nA,B,C,2024,1d\n")
    assert [r["OBS_VALUE"] for r in readers.portal(spark, str(tmp_path / "p.csv")).collect()] == [1.5, None]
    (tmp_path / "bul_p21_truth.csv").write_text("row,column,value\nx,y,2\n")
    got = readers.truth(spark, str(tmp_path / "bul_p21_truth.csv")).first()
    assert (got["stem"], got["page"], got["value"]) == ("bul", 21, 2.0)


def test_code_list_xml(spark):
    xml = '<s:Codelists><s:Code id="A" urn="u"><c:Name xml:lang="en">Annual</c:Name></s:Code><s:Code id="Q"><c:Name>Quarterly</c:Name></s:Code></s:Codelists>'
    rows = spark.createDataFrame([(xml,), ("<x>",)], "x string").select(readers.code_list_xml(F.col("x")).alias("c")).collect()
    assert [tuple(p) for p in rows[0]["c"]] == [("A", "Annual"), ("Q", "Quarterly")] and rows[1]["c"] is None


def test_messages_are_well_formed_and_in_order():
    head, foot = sinks.data_message("2024-01-01")
    ET.fromstring(head + foot)
    root = ET.fromstring(sinks.structure_message({"FREQ": [("A", "Annual & more")]}, "2024-01-01"))
    assert [e.tag.split("}")[1] for e in root[1]] == ["Dataflows", "Codelists", "Concepts", "DataStructures"]


def observations(spark, n, status="A"):
    rows = [("A", "NE", "P<&", "_T", str(2000 + i), float(i), "T", "0", status, str(2000 + i), "text", "f, g.pdf") for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c == 'OBS_VALUE' else 'string'}" for c in (*sinks.DIMENSIONS, sinks.MEASURE, *sinks.ATTRIBUTES))).repartition(3)


def test_refresh_is_gated_and_switches_both_outputs_at_once(spark, tmp_path):
    path, review = f"file://{tmp_path}/out", spark.createDataFrame([("a", 'b "c"')], "name string, detail string")
    with pytest.raises(select.DatasetRefused):
        sinks.write_refresh(observations(spark, 12, "U"), review, path, "2024-01-01")
    assert sinks.current(spark, path) is None
    first = sinks.write_refresh(observations(spark, 12), review, path, "2024-01-01")
    assert sinks.current(spark, path) == first
    with pytest.raises(select.DatasetRefused):
        sinks.write_refresh(observations(spark, 3), review, path, "2024-02-01")
    assert sinks.current(spark, path) == first and spark.read.option("header", True).csv(f"{first}/observations").count() == 12
    second = sinks.write_refresh(observations(spark, 20), review, path, "2024-03-01")
    assert sinks.current(spark, path) == second and spark.read.option("header", True).csv(f"{second}/observations").count() == 20
    third = sinks.write_refresh(observations(spark, 21), review, path, "2024-04-01")
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.is_dir()) == sorted(x.rsplit("/", 1)[1] for x in (second, third))
    text = (tmp_path / "out" / third.rsplit("/", 1)[1] / "to_review.csv").read_bytes()
    assert text == "\ufeffname,detail\na,\"b \"\"c\"\"\"\n".encode()


def test_bundle_of_five_files(spark, tmp_path):
    import zipfile

    long = observations(spark, 12)
    z = sinks.write_bundle(long, spark.createDataFrame([("x", "y")], "name string, detail string"), {"FREQ": [("A", "Annual")]}, f"file://{tmp_path}", "2024-01-01")
    with zipfile.ZipFile(z) as f:
        assert len(f.namelist()) == 5
        root = ET.fromstring(f.read("data.xml"))
        values = sorted(float(v.get("value")) for v in root.iter() if v.tag.endswith("ObsValue"))
        assert values == [float(i) for i in range(12)]
        lines = f.read("observations_sdmx.csv").decode().splitlines()
        assert len(lines) == 13 and lines[0].startswith("STRUCTURE,STRUCTURE_ID,ACTION,FREQ") and sum('"f, g.pdf"' in x for x in lines) == 12
        assert f.read("observations.csv").startswith(b"\xef\xbb\xbfFREQ")


def test_tables_and_metrics_files(spark, tmp_path):
    framed = spark.createDataFrame([("d", 1, "text", 0, "Pays", ["a", "b,c"], ["x", "y"], [["1", "2"], ["3", None]])], "doc string, page int, stage string, table_no int, label_name string, names array<string>, labels array<string>, body array<array<string>>")
    sinks.write_tables(framed, f"file://{tmp_path}/t")
    parts = [p for p in (tmp_path / "t").rglob("part-*") if not p.name.endswith(".crc")]
    assert [p.read_text() for p in parts] == ['Pays,a,"b,c"\nx,1,2\ny,3,\n']
    sinks.write_metrics(spark.createDataFrame([(1, 0.5)], "n int, share double"), f"file://{tmp_path}/m.json")
    assert (tmp_path / "m.json").read_text() == '{"n":1,"share":0.5}\n'


def test_page_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\fthree\f")
    got = readers.page_texts(spark, str(tmp_path / "a.txt")).collect()
    assert [(r["doc"], r["page"], r["text"]) for r in got] == [("a.txt", 1, "one\ntwo"), ("a.txt", 2, "three")]


def test_stream_reads_a_file_once(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("in", "out", "seen")]
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(paths[0])
        got = refresh(spark, paths[0], "id long", lambda b: b, paths[1], paths[2])
    assert got.count() == 7


def test_gate_reasons_and_unknown_lists(spark):
    stats = spark.createDataFrame([(1, 2, 1.0, 0.0), (5, 3, 0.4, 0.0), (5, 3, 0.6, 0.3), (5, 3, 0.9, 0.1)], "rows int, cols int, numeric_share double, unreadable_share double")
    assert [r["reason"] for r in select.gate(stats).collect()] == ["too small", "too few numbers", "too many unreadable cells", "ok"]
    used = spark.createDataFrame([("L", "A"), ("L", "B"), ("M", "C")], "list_id string, code string")
    ok = spark.createDataFrame([("L", True)], "list_id string, available boolean")
    got = {r["list_id"]: r["badge"] for r in summary.conformance(summary.unknown_codes(used, used.filter("code = 'A'"), ok)).collect()}
    assert got == {"L": "1 codes not official", "M": "not checked"}


def test_clusters_sum_spellings(spark):
    counts = spark.createDataFrame([("D", "Mil", 9), ("D", "MIL", 2), ("D", "Arachide coque", 5), ("D", "Arachides coque", 4), ("D", "UNKNOWN", 7)], "dimension string, label string, n long")
    assert {r["label"]: r["n"] for r in audit.clusters(counts).collect()} == {"Mil": 11, "Arachide coque": 9}
    assert DEFAULT.cluster_threshold == 95
