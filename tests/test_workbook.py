"""Workbooks, read back part by part."""

import datetime as dt
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tidemark.sources import workbook

NS = {"m": workbook.MAIN, "r": workbook.REL}


def read(path):
    """Sheets by name: rows of (type, style, value)."""
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        xml = lambda name: ElementTree.fromstring(z.read(name))
        rels = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        kinds = {o.get("PartName") for o in xml("[Content_Types].xml") if o.get("PartName")}
        formats = [x.get("numFmtId") for x in xml("xl/styles.xml").find("m:cellXfs", NS)]
        assert formats == ["0", "10", "14", "22"]
        out = {}
        for s in xml("xl/workbook.xml").iter(f"{{{workbook.MAIN}}}sheet"):
            part = "xl/" + rels[s.get(f"{{{workbook.REL}}}id")]
            assert f"/{part}" in kinds
            rows = [[(c.get("t"), int(c.get("s", 0)), (c.findtext("m:v", None, NS) if c.get("t") != "inlineStr" else c.findtext("m:is/m:t", "", NS))) for c in row] for row in xml(part).iter(f"{{{workbook.MAIN}}}row")]
            out[s.get("name")] = rows
        return out


def test_workbook(spark, tmp_path):
    rows = [
        ("a <b> & \"c\"'\x01", 12.5, 3, 150.0, True, dt.date(2024, 3, 1), dt.datetime(2024, 3, 1, 18, 0), [1, 2]), (None, None, None, None, None, None, None, None),
        (" spaced\nlines 中\U0001f600 ", float("nan"), -1, -0.5, False, dt.date(1900, 3, 1), dt.datetime(1999, 12, 31, 12), []), ("]]>", float("inf"), 0, 1e-9, True, None, None, None),
    ]
    df = spark.createDataFrame(rows, "name string, value double, n int, Gain_Pct double, ok boolean, day date, at timestamp, list array<int>").coalesce(1)
    many = spark.range(5000, numPartitions=7).select("id", F.concat(F.lit("row "), "id").alias("t"))
    sheets = {"All: results/[x]": df, "all_ results__x_": df.limit(0), "n" * 40: many, "N" * 31: many.limit(1)}
    (tmp_path / "report.xlsx").write_text("old")
    workbook.write_workbook(sheets, f"file://{tmp_path}/report.xlsx")
    got = read(tmp_path / "report.xlsx")
    assert list(got) == ["All_ results__x_", "all_ results__x_ (2)", "n" * 31, "N" * 27 + " (2)"]
    first = got["All_ results__x_"]
    assert [c[2] for c in first[0]] == df.columns and got["all_ results__x_ (2)"] == [first[0]]
    text = lambda v: ("inlineStr", 0, v)
    assert first[1] == [text("a <b> & \"c\"' "), (None, 0, "12.5"), (None, 0, "3"), (None, workbook.PERCENT, "1.5"), ("b", 0, "1"), (None, workbook.DATE, "45352"), (None, workbook.TIME, "45352.75"), text("[1, 2]")]
    assert first[2] == [(None, 0, None)] * 8
    assert first[3][0] == text(" spaced\nlines 中\U0001f600 ") and first[3][1] == (None, 0, None) and first[3][3] == (None, workbook.PERCENT, "-0.005") and first[3][5][2] == "61"
    assert first[4][0] == text("]]>") and float(first[4][3][2]) == pytest.approx(1e-11)
    assert [r[0][2] for r in got["n" * 31][1:]] == [str(k) for k in range(5000)]  # the order of partitions
    assert sorted(p.name for p in tmp_path.iterdir() if "tmp" in p.name) == []


def test_too_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MOST_ROWS", 10)
    with pytest.raises(ValueError, match="has 11 rows"):
        workbook.write_workbook({"a": spark.range(11)}, f"file://{tmp_path}/r.xlsx")
    with pytest.raises(ValueError):
        workbook.write_workbook({}, f"file://{tmp_path}/r.xlsx")
    assert not (tmp_path / "r.xlsx").exists()
