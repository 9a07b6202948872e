"""Workbooks and statement folders."""

import datetime
import decimal
import os
import zipfile

import pytest

from tidemark.sources import files, sheets, statements


def books(folder):
    return sorted(f for f in os.listdir(folder) if not f.endswith(".crc"))


def test_a_workbook_for_each_partition(spark, tmp_path):
    rows = [(i, i / 4, f"t{i} <&> \x07é ", i % 2 == 0, datetime.date(2020, 1, 1 + i % 28), decimal.Decimal("1.50"), None) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, x double, t string, b boolean, d date, m decimal(9,2), n string").repartition(3)
    path = str(tmp_path / "out dir")
    files.export(df, path, "workbook")
    assert books(path) == [f"part-0000{i}-000.xlsx" for i in range(3)]
    got = [sheets.read_workbook(f"{path}/{f}") for f in books(path)]
    assert all(g[0] == df.columns for g in got)
    want = sorted([r[0], r[1] if r[1] % 1 else r[1], f"t{r[0]} <&> é ", r[3], r[4].isoformat(), 1.5, None] for r in rows)
    assert sorted(r for g in got for r in g[1:]) == want
    assert all(zipfile.ZipFile(f"{path}/{f}").testzip() is None for f in books(path))


def test_sheets_are_split_at_their_limit_and_replaced(spark, tmp_path):
    path, df = str(tmp_path), spark.range(25).coalesce(1)
    spark.dataSource.register(sheets.Workbook)
    df.write.format("workbook").option("sheet_rows", "11").mode("append").save(path)
    assert [len(sheets.read_workbook(f"{path}/{f}")) for f in books(path)] == [11, 11, 6]
    with pytest.raises(Exception, match="holds workbooks already"):
        df.write.format("workbook").mode("append").save(path)
    files.export(df.where("id < 0"), path, "workbook")
    assert books(path) == ["part-00000-000.xlsx"] and sheets.read_workbook(f"{path}/part-00000-000.xlsx") == [["id"]]
    with pytest.raises(Exception, match="shared folder"):
        df.write.format("workbook").mode("append").save("s3://bucket/x")


@pytest.mark.parametrize("value, xml", [(None, "<c/>"), (True, '<c t="b"><v>1</v></c>'), (7, "<c><v>7</v></c>"), (float("nan"), "<c/>"), (1 << 60, f'<c t="inlineStr"><is><t xml:space="preserve">{1 << 60}</t></is></c>')])
def test_cells(value, xml):
    assert sheets.cell(value) == xml


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_only_changed_statements_are_read(spark, tmp_path):
    folder, store = tmp_path / "md 2", files.Store(spark, str(tmp_path / "store"))
    for name, text in {"aaa/AAA_2020 {x}[1]%41+.md": "a", "AAA/2021/report.md": "b", "bbb/x/BBB 2022 v1.md": "c1", "bbb/y/BBB 2022 v2.md": "c2", "bbb/none.md": "z", "bbb/2023.txt": "z"}.items():
        write(folder / name, text)
    sync = lambda **o: statements.sync_statements(store, str(folder), **o)
    assert sync() == {"listed": 4, "read": 4, "written": 3}
    rows = lambda: {(r.ticker, r.year): (r.content, r.source_file) for r in store.read("financial_statement_reports").collect()}
    assert rows() == {("AAA", 2020): ("a", "md 2/aaa/AAA_2020 {x}[1]%41+.md"), ("AAA", 2021): ("b", "md 2/AAA/2021/report.md"), ("BBB", 2022): ("c2", "md 2/bbb/y/BBB 2022 v2.md")}
    assert sync() == {"listed": 4, "read": 0, "written": 0} and store._latest("financial_statement_reports")[0] == 1
    write(folder / "aaa/AAA_2020 {x}[1]%41+.md", "a new")
    os.utime(folder / "AAA/2021/report.md", (1, 1))  # touched, not changed
    assert sync() == {"listed": 4, "read": 2, "written": 1}
    assert rows()["AAA", 2020][0] == "a new" and len(rows()) == 3
    assert sync(tickers=["bbb"], years=[2022]) == {"listed": 2, "read": 0, "written": 0}
