import math

import pytest
from pyspark.sql import functions as F

from recordloom.errors import ConfigError, ExpressionError
from recordloom.functions.expressions import compile_expression
from recordloom.operators.transform import fields_of, transform
from recordloom.options import Coerce, Transform

BASE = '{"name":" Ada ","level":"20","price":19.99,"qty":3,"ok":true,"n":null}'


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame([(" Ada ", "20", 19.99, 3, True, None)], "name string, level string, price double, qty long, ok boolean, n string")


@pytest.fixture(scope="module")
def variant(spark):
    return spark.createDataFrame([(BASE,)], "v string").select(F.parse_json("v").alias("record"))


def one(df, fields, record=None, **policies):
    rows = transform(df, {"fields": fields, **policies}, record).collect()
    return rows[0].asDict() if rows else None


def plain(value):
    return value.toPython() if hasattr(value, "toPython") else value


COMPUTE = [
    ("price * qty", 59.97),
    ("1 / 0", 0.0),
    ("0 / 0", 0.0),
    ("-qty + 2 * 3", 3.0),
    ("ok + 1", 2.0),
    ("level + 1", 21.0),
    ("2 - 3 - 4", -5.0),
    ("8 / 4 / 2", 1.0),
    ("(1 + 2) * 3", 9.0),
    ("--qty", 3.0),
    ('concat(upper(trim(name)), "-", qty, n, ok)', "ADA-3true"),
    ('concat("a\\"b", "\\n")', 'a"b\n'),
    ('coalesce(n, missing, "x")', "x"),
    ("lower(name)", " ada "),
]


@pytest.mark.parametrize("source,want", COMPUTE)
@pytest.mark.parametrize("shape", ["typed", "variant"])
def test_compute(request, shape, source, want):
    df = request.getfixturevalue(shape)
    got = plain(one(df, [{"targetFieldName": "x", "compute": source}], "record" if shape == "variant" else None)["x"])
    assert math.isclose(got, want) if isinstance(want, float) else got == want


@pytest.mark.parametrize("source", ["n + 1", "name + 1", "upper(qty)", "trim(n)"])
@pytest.mark.parametrize("shape", ["typed", "variant"])
def test_compute_errors_always_count(request, shape, source):
    df = request.getfixturevalue(shape)
    with pytest.raises(Exception, match="number|text"):
        one(df, [{"targetFieldName": "x", "compute": source}], "record" if shape == "variant" else None, onCoerceError="null")


@pytest.mark.parametrize("source", ["level >= 15", "concat(name, ' ')", "now()", "lower()", "upper(a, b)", "1 +", "(1", "1 2", "a % b", "1.2.3"])
def test_expressions_that_do_not_compile(spark, typed, source):
    with pytest.raises(ExpressionError):
        compile_expression(source, fields_of(typed))


COERCE = [
    ("level", "i64", 20),
    ("price", "i64", 19),
    ("ok", "i64", 1),
    ("qty", "f64", 3.0),
    ("level", "f64", 20.0),
    ("ok", "string", "true"),
    ("qty", "string", "3"),
    ("qty", "bool", True),
]


@pytest.mark.parametrize("origin,to,want", COERCE)
@pytest.mark.parametrize("shape", ["typed", "variant"])
def test_coerce(request, shape, origin, to, want):
    df = request.getfixturevalue(shape)
    assert one(df, [{"targetFieldName": "x", "originFieldName": origin, "coerce": {"type": to}}], "record" if shape == "variant" else None)["x"] == want


@pytest.mark.parametrize("text,to,fmt,want", [
    ("12", "i64", None, 12), ("+12", "i64", None, 12), ("12.7", "i64", None, None), (" 12 ", "i64", None, None), ("99999999999999999999", "i64", None, None),
    ("1e3", "f64", None, 1000.0), ("5d", "f64", None, None), ("inf", "f64", None, 0.0), (" 1", "f64", None, None),
    ("TRUE", "bool", None, True), ("0", "bool", None, False), ("yes", "bool", None, None),
    ("2024-01-01T00:00:00Z", "timestamp_ms", "iso8601", 1704067200000), ("2024-01-01T01:00:00.5+01:00", "timestamp_ms", "iso8601", 1704067200500),
    ("2024-01-01", "timestamp_ms", "iso8601", None), ("2024-01-01T00:00:00", "timestamp_ms", "iso8601", None),
    ("1704067200", "timestamp_ms", "unix_s", 1704067200000), ("1704067200000", "timestamp_ms", "unix_ms", 1704067200000), ("9223372036854775807", "timestamp_ms", "unix_s", None),
])
def test_coerce_texts(spark, text, to, fmt, want):
    df = spark.createDataFrame([(text,)], "t string")
    coerce = {"type": to} | ({"format": fmt} if fmt else {})
    assert one(df, [{"targetFieldName": "t", "coerce": coerce}], onCoerceError="null")["t"] == want
    kept = one(df, [{"targetFieldName": "t", "coerce": coerce}], onCoerceError="dropRecord")
    assert (kept is None) == (want is None)
    if want is None:
        with pytest.raises(Exception, match="coerce"):
            one(df, [{"targetFieldName": "t", "coerce": coerce}])


def test_policies(spark, typed):
    assert plain(one(typed, [{"targetFieldName": "n", "defaultValue": 7}])["n"]) == 7
    assert one(typed, [{"targetFieldName": "missing", "coerce": {"type": "string"}}], onMissingField="null") == {"missing": ""}
    assert one(typed, [{"targetFieldName": "missing"}], onMissingField="drop") == {"missing": None}
    for policy, fields in (({}, [{"targetFieldName": "missing"}]), ({"onMissingField": "null"}, [{"targetFieldName": "missing", "required": True}]), ({"onMissingField": "null"}, [{"targetFieldName": "missing", "coerce": {"type": "i64"}}])):
        with pytest.raises(Exception, match="issing|coerce"):
            one(typed, fields, **policy)
    got = one(typed, [{"targetFieldName": "hero", "originFieldName": "name"}], mode="augment")
    assert got["hero"] == " Ada " and got["qty"] == 3
    assert one(typed, [{"targetFieldName": "hero", "originFieldName": "name"}]) == {"hero": " Ada "}


def test_a_dropped_record_raises_no_later_error(spark):
    df = spark.createDataFrame([("x", None), ("1", "a")], "a string, b string")
    rows = transform(df, {"fields": [{"targetFieldName": "a", "coerce": {"type": "i64"}}, {"targetFieldName": "b"}], "onCoerceError": "dropRecord"}).collect()
    assert [r.asDict() for r in rows] == [{"a": 1, "b": "a"}]


def test_records_that_are_no_objects(spark):
    df = spark.createDataFrame([("[1]",)], "v string").select(F.parse_json("v").alias("record"))
    with pytest.raises(Exception, match="object"):
        one(df, [{"targetFieldName": "a"}], "record", onCoerceError="dropRecord", onMissingField="null")
        transform(df, {"fields": [{"targetFieldName": "a", "coerce": {"type": "i64"}}], "onCoerceError": "dropRecord"}, "record").collect()


def test_config_is_checked():
    for bad in ({"fields": []}, {"fields": [{"targetFieldName": "a", "other": 1}]}, {"fields": [{"targetFieldName": "a"}], "mode": "x"}, {"fields": [{"targetFieldName": ""}]}):
        with pytest.raises(ConfigError):
            Transform.of(bad)
    with pytest.raises(ConfigError):
        Coerce("i32")
    assert Transform.of({"fields": [{"targetFieldName": "a"}], "onCoerceError": "droprecord"}).on_coerce_error == "dropRecord"


def test_no_shuffle(spark, typed):
    df = transform(typed, {"fields": [{"targetFieldName": "level", "coerce": {"type": "i64"}}], "onCoerceError": "dropRecord", "mode": "augment"})
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
