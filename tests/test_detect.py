import pytest
from pyspark.sql import functions as F

from recordloom.sources.detect import csv_fields, detect_delimiter, detect_format, detect_structure, looks_like, read_sample, xml_elements


@pytest.mark.parametrize("text,want", [
    ('{ "ship": "Dara" }', "json"), ('{"a":1}\n{"a":2}', "ndjson"), ("<?xml version='1.0'?><root/>", "xml"), ("a;b;c\n1;2;3", "csv"),
    ('[\n  {"a": 1},\n  {"a": 2}\n]', "json"), ("plain words only", None), ("", None), ("   \n ", None), ("<!DOCTYPE x><x/>", "xml"), ("﻿a,b\n1,2", "csv"), ("42", "json"), ("[1,2]\n[3,4]", "ndjson"),
])
def test_format(text, want):
    assert detect_format(text) == want


@pytest.mark.parametrize("text,want", [
    ("a,b\n1,2", ","), ("a\tb\n1\t2", "\t"), ("a|b|c\n1|2|3\n4|5|6\n7|8|9\n,,,", "|"), ('"a|b"|c\n1|2', "|"), ("word", ","), ("a,b;c\n1,2;3", ","),
])
def test_delimiter(text, want):
    assert detect_delimiter(text) == want


def test_fields():
    assert csv_fields("a,b,c,\n1,2,3,") == ["a", "b", "c", ""]
    assert csv_fields('"x, y",z\n') == ["x, y", "z"]
    assert detect_structure('{"a":{"b c":1,"d-e":2}}').fields == ("a", "d-e")
    assert detect_structure('{"a":1}\n{"b":2}').fields == ("a", "b")


def test_record_elements():
    fleet = "<fleet><vessel><name>a</name><mast>x</mast><mast>y</mast></vessel><vessel><name>b</name><mast>z</mast></vessel></fleet>"
    assert xml_elements(fleet)[1] == "vessel"
    assert xml_elements("<log><year><name>t</name><day><name>a</name></day><day><name>b</name></day></year></log>")[1] == "day"
    assert xml_elements("<a><b>1</b></a>")[1] is None
    deep = "".join(f"<d{i}>" for i in range(30)) + "".join(f"</d{i}>" for i in reversed(range(30)))
    assert len(xml_elements(deep)[0]) == 30


def test_looks_like(spark):
    texts = ["a,b", '{"a":1}', '{"a":1}\n{"a":2}', "<x/>", "words", None, "42"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(looks_like(F.col("t"))).collect()]
    assert got == ["csv", "json", "ndjson", "xml", None, None, "json"]


def test_sample(spark, tmp_path):
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / "b").write_text("second")
    (tmp_path / "a").write_text("first")
    assert read_sample(spark, str(tmp_path), 3) == b"fir"
    assert read_sample(spark, str(tmp_path / "none")) == b""
