import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return "" if value is None else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    names = want.columns
    assert sorted(got.columns) == sorted(names)
    columns = sorted(got.columns)
    rows = lambda dicts: sorted(tuple(plain(d[c]) for c in columns) for d in dicts)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(names, r)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["xml_late_element", "csv_header_like_row"])
def test_no_task_sorts_or_writes_a_whole_table(spark, monkeypatch, name):
    from recordloom.plans import queries

    monkeypatch.setattr(queries, "_FILE_ROWS", 1000)
    got = entry.queries()[name](spark, SF)
    files = sorted(got.inputFiles())
    texts = [spark.read.text(f, wholetext=True).first()[0] for f in files]
    assert len(files) == 7 and max(t.count("\n") for t in texts) < 2000
    assert [("x &amp; y" in t or "5\\" in t) for t in texts] == [False] * 6 + [True]
    assert got.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count() + (2 if name == "xml_late_element" else 3)
