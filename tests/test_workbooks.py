"""Spreadsheets: round trips, and files as other programs write them."""

import os
import zipfile

import pytest

from ionloom.plans import all_queries
from ionloom.sources import tables, workbooks

ODD = "a <b> & \"c\" é\U0001f600\n\ttab _x0041_ \x01 end "


def test_round_trip(spark, tmp_path):
    rows = [(i, i / 3, i % 2 == 0, f"name {i}" if i % 5 else None, ODD if i == 7 else "") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, x double, even boolean, name string, odd string").repartition(4)
    out = str(tmp_path / "out.xlsx")
    tables.write(df, out)
    assert len([f for f in os.listdir(out) if f.endswith(".xlsx")]) == 4 and not [f for f in os.listdir(out) if f.endswith(".tmp")]
    got = workbooks.read_workbooks(spark, out)
    assert got.dtypes[1:] == [("id", "double"), ("x", "double"), ("even", "string"), ("name", "string"), ("odd", "string")]
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(float(i), x, str(e).lower(), n, o) for i, x, e, n, o in rows]
    tables.write(df.limit(3), out)
    assert workbooks.read_workbooks(spark, out).count() == 3
    tables.write(df.limit(2), out, "append")
    assert workbooks.read_workbooks(spark, out).count() == 5


def test_empty_table_and_special_numbers(spark, tmp_path):
    out = str(tmp_path / "none.xlsx")
    tables.write(spark.createDataFrame([], "a long, b string"), out)
    assert workbooks.read_workbooks(spark, out).columns == ["file_name", "a", "b"] and workbooks.read_workbooks(spark, out).count() == 0
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (-0.5,), (None,)], "v double")
    tables.write(df.coalesce(1), str(tmp_path / "odd.xlsx"))
    got = [r.v for r in workbooks.read_workbooks(spark, str(tmp_path / "odd.xlsx")).collect()]
    assert {str(v) for v in got} == {"nan", "inf", "1e+300", "-0.5"}  # a row without cells isn't one


def foreign(path):
    """As a spreadsheet program writes it: shared strings with runs, a sheet under another name, gaps, formulas and errors."""
    sheet = (
        '<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="str"><f>1</f><v>sum</v></c></row>'
        '<row r="3"><c r="A3"><v>1.5</v></c><c r="C3" t="s"><v>2</v></c><c r="D3"><f>A3*2</f><v>3</v></c><c r="AB3"><v>9</v></c></row>'
        '<row><c><v>2</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c/></row></sheetData></worksheet>'
    ).replace("{m}", workbooks.MAIN)
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{workbooks.MAIN}" xmlns:r="{workbooks.RELATIONS}"><sheets><sheet name="x" sheetId="4" r:id="q"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbooks.PACKAGE}/relationships"><Relationship Id="q" Target="/xl/worksheets/other.xml"/></Relationships>')
        book.writestr("xl/worksheets/other.xml", sheet)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN}"><si><t>mass</t></si><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si><si><t>x _x0041_</t></si></sst>')


def test_files_of_other_programs(spark, tmp_path):
    foreign(tmp_path / "Group info_b 1+2.xlsx")
    got = tables.read_batches(spark, str(tmp_path / "*.xlsx"), "Group info_")
    assert got.columns == ["mass", "name", "sum", "batch"]
    assert sorted(map(tuple, got.collect())) == [(1.5, "x A", 3.0, "b 1+2"), (2.0, None, None, "b 1+2")]


def test_library_and_batches(spark, tmp_path):
    lib = spark.createDataFrame([("m", 100.5), ("n", 200.25)], "compound string, mz double")
    tables.write(lib, str(tmp_path / "lib.xlsx"))
    got = tables.read_library(spark, str(tmp_path / "lib.xlsx"), {"compound": "metabolite"})
    assert sorted(map(tuple, got.collect())) == [("m", 100.5), ("n", 200.25)]
    with pytest.raises(ValueError):
        tables.read_batches(spark, str(tmp_path / "old.xls"))


def test_a_matrix_of_cells(spark, tmp_path):
    matrix = spark.createDataFrame([(1, "f", 2.0), (2, "f", 3.0), (2, "g", 4.0)], "cell int, feature string, value double")
    obs = spark.createDataFrame([(1, 9.0), (2, 1.0)], "cell int, scan_start_time double")
    wide = tables.cell_feature_table(matrix, obs, matrix.select("feature").distinct())
    tables.write(wide, str(tmp_path / "cells.xlsx"))
    got = {r.feature: (r.Cell00001, r.Cell00002) for r in workbooks.read_workbooks(spark, str(tmp_path / "cells.xlsx")).collect()}
    assert got == {"f": (3.0, 2.0), "g": (4.0, None)}


def test_a_matrix_of_cells_as_rows(spark):
    matrix = spark.createDataFrame([(1, "f", 2.0), (1, "f", 1.0), (2, "f", 3.0), (2, "g", 4.0), (9, "g", 5.0)], "cell int, feature string, value double")
    obs = spark.createDataFrame([(1, 9.0), (2, 1.0)], "cell int, scan_start_time double")
    got = tables.cell_feature_rows(matrix, obs, matrix.select("feature").distinct())
    assert sorted(map(tuple, got.collect())) == [("f", "Cell00001", 3.0), ("f", "Cell00002", 2.0), ("g", "Cell00001", 4.0), ("g", "Cell00002", None)]
    query = all_queries()["cell_feature_table"](spark, "/root/testdata/sf0.001")
    assert "pivot" not in query._jdf.queryExecution().toString().lower()  # no column for each cell on the way


def test_columns_by_letters():
    assert [workbooks.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbooks.number(workbooks.letters(i) + "7") == i for i in range(0, 16_384, 37))
