"""Workbooks (.xlsx) of tables: sheets are rendered by tasks, and joined into the package at commit.

Each row becomes its XML in an expression, so sheets are made where the rows are; Spark writes them as text parts. The
driver then passes the parts' bytes, file by file, into the zip package under a temporary name and renames it into place:
no sheet is ever held, and a failed write leaves no half workbook. Rows stand in the order of the table's partitions; sort
a table first if that matters. Strings stand in their cells.

Columns in percent are stored as fractions under a percent format, dates and times as day numbers under theirs; booleans
stay booleans, nulls and NaN are empty cells, anything that isn't a number, date, time, boolean or string is written as
text. A sheet holds MOST_ROWS rows at most; more are an error. A table without rows gives a sheet with its header.
"""

from __future__ import annotations

import re
import uuid
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir
from .sinks import is_percent

MOST_ROWS = (1 << 20) - 1
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Cell formats by their place: general, percent, date, date and time (built-in number formats 10, 14 and 22).
GENERAL, PERCENT, DATE, TIME = range(4)
STYLES = f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4">' + "".join(f'<xf numFmtId="{n}" applyNumberFormat="1"/>' for n in (0, 10, 14, 22)) + "</cellXfs></styleSheet>"


def sheet_names(names: list[str]) -> list[str]:
    """Names as sheets may have them: 31 characters, none of []:*?/\\, no apostrophe at an end, each once in any case."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\\x00-\x1f]", "_", name).strip("'")[:31] or "Sheet"
        new, k = base, 1
        while new.lower() in {x.lower() for x in out}:
            k += 1
            new = f"{base[: 31 - len(f' ({k})')]} ({k})"
        out.append(new)
    return out


def _text(c: Column) -> Column:
    """Text of a cell: markup escaped, characters that XML forbids as a space."""
    plain = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", " ")
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _cell(df: DataFrame, name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    number = lambda v, style: F.concat(F.lit(f'<c s="{style}"><v>'), v.cast("string"), F.lit("</v></c>"))
    if kind in ("double", "float"):
        value = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        cell = number(value / 100, PERCENT) if is_percent(name) else number(value, GENERAL)
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        cell = number(c / 100, PERCENT) if is_percent(name) else number(c, GENERAL)
    elif kind == "boolean":
        cell = F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    elif kind == "date":
        cell = number(F.datediff(c, F.lit("1899-12-30")), DATE)
    elif kind in ("timestamp", "timestamp_ntz"):
        cell = number(F.datediff(c.cast("date"), F.lit("1899-12-30")) + (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)) / 86400, TIME)
    else:
        cell = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _text(c.cast("string")), F.lit("</t></is></c>"))
    return F.coalesce(cell, F.lit("<c/>"))


def rows_xml(df: DataFrame) -> DataFrame:
    """One column, the XML of each row."""
    return df.select(F.concat(F.lit("<row>"), *[_cell(df, n, k) for n, k in df.dtypes], F.lit("</row>")).alias("value"))


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each table, over what is at path."""
    if not sheets:
        raise ValueError("a workbook has a sheet at least")
    spark = next(iter(sheets.values())).sparkSession
    jvm, conf, names = spark._jvm, spark._jsc.hadoopConfiguration(), sheet_names(list(sheets))
    Path, base = jvm.org.apache.hadoop.fs.Path, shared_dir(spark)
    fs = Path(base).getFileSystem(conf)
    for k, df in enumerate(sheets.values(), 1):
        rows_xml(df).write.option("lineSep", "\n").text(f"{base}/{k}")
        if (n := spark.read.text(f"{base}/{k}").where("value LIKE '<row>%'").count()) > MOST_ROWS:
            fs.delete(Path(base), True)
            raise ValueError(f"{names[k - 1]} has {n} rows; a sheet holds {MOST_ROWS}")
    target = Path(path)
    out_fs = target.getFileSystem(conf)
    aside = Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    package = jvm.java.util.zip.ZipOutputStream(out_fs.create(aside))

    def put(text: str) -> None:
        package.write(bytearray(text.encode()))

    def entry(name: str, text: str | None = None) -> None:
        package.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        if text is not None:
            put(text)
            package.closeEntry()

    each = range(1, len(names) + 1)
    entry("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{KIND}.worksheet+xml"/>' for k in each) + "</Types>")
    entry("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    entry("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(each, names)) + "</sheets></workbook>")
    entry("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in each) + f'<Relationship Id="rId{len(names) + 1}" Type="{REL}/styles" Target="styles.xml"/></Relationships>')
    entry("xl/styles.xml", STYLES)
    for k, df in zip(each, sheets.values()):
        entry(f"xl/worksheets/sheet{k}.xml")
        head = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in df.columns)
        put(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData><row>{head}</row>')
        parts = sorted((s.getPath().toString() for s in fs.listStatus(Path(f"{base}/{k}")) if s.getPath().getName().startswith("part-")))
        for part in parts:  # in the order of partitions
            file = fs.open(Path(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(file, package, 1 << 16, False)
            file.close()
        put("</sheetData></worksheet>")
        package.closeEntry()
    package.close()
    out_fs.delete(target, False)
    if not out_fs.rename(aside, target):
        raise OSError(f"{path} can't be put in place")
    fs.delete(Path(base), True)
