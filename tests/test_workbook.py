import datetime
import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.sources import load, text_column, workbook, writers
from textloom.sources.readers import read_excel

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def file_of(sheets: dict[str, str], strings: str = "", styles: str = "", properties: str = "") -> bytes:
    """A workbook as another program would write it: shared strings, styles, absolute targets."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {REL}>{properties}<sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Type="t" Target="/xl/worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
    return out.getvalue()


def test_cells_of_all_kinds():
    strings = "<si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>aid</t></rPh></si><si><t>NA</t></si>"
    styles = '<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts>'
    styles += '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="str"><v>formula</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>12</v></c><c r="C2"><v>1.5</v></c><c r="D2" t="b"><v>1</v></c></row>'
        '<row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4" s="1"><v>43831.25</v></c><c r="C4" s="2"><v>1</v></c><c r="D4" t="e"><v>#N/A</v></c>'
        '<c r="AB4" s="3"><v>7</v></c></row>'
    )
    content = file_of({"one": rows, "two": '<row><c t="inlineStr"><is><t>only</t></is></c></row>'}, strings, styles)
    names, cells = workbook.table(content)
    assert names == ["name", "name.1", "Unnamed: 2", "formula"]
    moments = (datetime.datetime(2020, 1, 1, 6), datetime.datetime(1899, 12, 31))
    assert list(cells) == [["rich text", 12, 1.5, True], [], [None, *moments, None, *[None] * 23, 7]]
    assert workbook.table(content, "two")[0] == ["only"] and workbook.table(content, 1)[0] == ["only"]
    with pytest.raises(ValueError, match="no sheet"):
        workbook.table(content, "three")
    old = file_of({"one": '<row><c s="1"><v>0</v></c></row>'}, "", styles, '<workbookPr date1904="1"/>')
    assert list(workbook.Workbook(old).rows()) == [[datetime.datetime(1904, 1, 1)]]


def test_binary_workbooks_are_refused():
    with pytest.raises(ValueError, match="before 2007"):
        workbook.table(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(100))


def test_round_trip_of_texts(spark, tmp_path):
    texts = ["plain", "<&>\"'", " spaces ", "line\nbreak", "é\U0001f600", None, "NA", "x" * 40_000, "bell\x07", "12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, comment string").repartition(3)
    path = writers.write_excel(df, f"{tmp_path}/a.xlsx", rows_per_file=2)
    back = {r.id: r.comment for r in load(spark, path).collect()}
    assert back == {i: {"NA": None, "bell\x07": "bell_x0007_"}.get(t, t) for i, t in enumerate(texts)}
    assert text_column(load(spark, path)).count() == len(texts) - 2
    kept = read_excel(spark, path, missing=()).where("comment = 'NA'").count()
    assert kept == 1


def test_files_that_differ_are_merged_and_schemas_are_honoured(spark, tmp_path):
    one = spark.createDataFrame([(1, True, 5)], "a long, b boolean, only long").coalesce(1)
    two = spark.createDataFrame([(1.5, "text")], "a double, b string").coalesce(1)
    writers.write_excel(one, f"{tmp_path}/one.xlsx")
    writers.write_excel(two, f"{tmp_path}/two.xlsx")
    both = load(spark, f"{tmp_path}/*.xlsx")
    assert dict(both.dtypes) == {"a": "double", "b": "string", "only": "bigint"}
    assert sorted(map(tuple, both.collect()), key=str) == [(1.0, "True", 5), (1.5, "text", None)]
    typed = load(spark, f"{tmp_path}/one.xlsx", "only double, a string, none date")
    assert typed.collect() == [(5.0, "1", None)]


def test_moments_in_both_time_types(spark, tmp_path):
    df = spark.sql("SELECT timestamp '2024-02-29 12:30:15.250' AS t, date '1999-12-31' AS d, CAST(NULL AS date) AS n").coalesce(1)
    path = writers.write_excel(df, f"{tmp_path}/t.xlsx")
    ntz = load(spark, path)
    assert dict(ntz.dtypes)["t"] == "timestamp_ntz" and ntz.first()[:2] == (datetime.datetime(2024, 2, 29, 12, 30, 15, 250000), datetime.datetime(1999, 12, 31))
    assert load(spark, path, "t timestamp").select(F.col("t").cast("string")).first()[0] == "2024-02-29 12:30:15.25"
    assert load(spark, path, "d date, n date").collect() == [(datetime.date(1999, 12, 31), None)]


def test_empty_sheets_and_wide_cells(spark, tmp_path):
    empty = spark.createDataFrame([], "a long, b string")
    path = writers.write_excel(empty, f"{tmp_path}/none.xlsx")
    assert load(spark, path, "a long, b string").count() == 0
    assert [workbook._column(workbook._reference(c, 9)) for c in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]


def test_pickles_are_written_and_loaded(spark, tmp_path):
    df = spark.range(1000).select("id", F.md5(F.col("id").cast("string")).alias("h"), F.when(F.col("id") % 2 == 0, F.col("id") / 4).alias("x"))
    path = writers.write_pickle(df, f"{tmp_path}/a.pkl", rows_per_file=90)
    back = load(spark, path)
    assert dict(back.dtypes)["id"] == "bigint" and back.exceptAll(df.select(*back.columns)).count() == 0 and back.count() == 1000
    frame = next(pd.read_pickle(p) for p in tmp_path.glob("a.pkl/part-*"))
    assert list(frame.columns) == ["id", "h", "x"]
