"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConvertError
from ..operators.flatten import flatten
from ..operators.transform import transform
from ..options import ConverterConfig, CsvOptions, XmlOptions
from ..scratch import scratch_path
from ..sources import readers, sinks
from ..sources.detect import detect_structure, looks_like
from ..streaming.jobs import StreamJob
from .converter import Converter, convert

Q: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def mapped(name: str, table_name: str, sql: str, fields: list[dict], prepare=None, **config):
    """A query that transforms a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, table_name)
        return transform(prepare(df) if prepare else df, {"fields": fields, **config})

    Q[name], SQL[name] = run, sql


def field(target, origin=None, compute=None, to=None, fmt=None, default=None, required=False):
    out = {"targetFieldName": target}
    if origin:
        out["originFieldName"] = origin
    if compute:
        out["compute"] = compute
    if to:
        out["coerce"] = {"type": to} | ({"format": fmt} if fmt else {})
    if default is not None:
        out["defaultValue"] = default
    if required:
        out["required"] = True
    return out


mapped("transform_select_rename", "part", "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part", [field("id", "p_partkey"), field("name", "p_name"), field("size", "p_size")])
mapped(
    "transform_augment_compute",
    "lineitem",
    "SELECT *, l_extendedprice * (1.0 - l_discount) AS net, l_extendedprice / l_quantity AS unit FROM lineitem",
    [field("net", compute="l_extendedprice * (1 - l_discount)"), field("unit", compute="l_extendedprice / l_quantity")],
    mode="augment",
)
mapped("transform_self_reference", "part", "SELECT CAST(p_size AS DOUBLE) + 1 AS p_size, CAST(p_size AS DOUBLE) * 2 AS twice FROM part", [field("p_size", compute="p_size + 1"), field("twice", compute="p_size * 2")])
mapped("transform_last_target_wins", "region", "SELECT r_name AS x FROM region", [field("x", "r_regionkey"), field("x", "r_name")])
mapped("compute_divide_by_zero", "orders", "SELECT o_orderkey, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM orders", [field("o_orderkey"), field("x", compute="o_totalprice / (o_custkey - o_custkey)"), field("y", compute="0 / 0")])
mapped("compute_unary_precedence", "part", "SELECT p_partkey, CAST(-p_size + p_size * 2 AS DOUBLE) AS a, CAST((-p_size + p_size) * 2 - -p_size AS DOUBLE) AS b, 8.0::DOUBLE / 4 / 2 AS c FROM part", [field("p_partkey"), field("a", compute="-p_size + p_size * 2"), field("b", compute="(-p_size + p_size) * 2 - -p_size"), field("c", compute="8 / 4 / 2")])
mapped("compute_concat", "customer", "SELECT c_custkey, concat(c_name, '/', c_mktsegment, '#', CAST(c_nationkey AS VARCHAR)) AS label FROM customer", [field("c_custkey"), field("label", compute='concat(c_name, "/", c_mktsegment, null, "#", c_nationkey)')])
mapped(
    "compute_case_trim",
    "nation",
    "SELECT lower(n_name) AS low, upper(n_name) AS up, n_name AS plain FROM nation",
    [field("low", compute="lower(n_name)"), field("up", compute="upper(n_name)"), field("plain", compute="trim(padded)")],
    prepare=lambda df: df.withColumn("padded", F.concat(F.lit(" \t"), "n_name", F.lit("\n "))),
)
mapped(
    "compute_coalesce_default",
    "events",
    "SELECT event_id, coalesce(CAST(json_extract(props, '$.missing') AS VARCHAR), event_type) AS x, 7 AS n FROM events",
    [field("event_id"), field("x", compute='coalesce(missing, nothing, event_type, "none")'), field("n", "missing", default=7)],
    prepare=lambda df: df.withColumn("missing", F.get_json_object("props", "$.missing")),
)
mapped("compute_numeric_text", "orders", "SELECT o_orderkey, o_orderkey + 1.0::DOUBLE AS x, 2.0::DOUBLE AS y FROM orders", [field("o_orderkey"), field("x", compute="t + 1"), field("y", compute="true + 1")], prepare=lambda df: df.withColumn("t", F.col("o_orderkey").cast("string")))
mapped("coerce_i64", "lineitem", "SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(trunc(l_extendedprice) AS BIGINT) AS cut FROM lineitem", [field("k", "t", to="i64"), field("cut", "l_extendedprice", to="i64")], prepare=lambda df: df.withColumn("t", F.col("l_orderkey").cast("string")))
mapped("coerce_f64", "lineitem", "SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS a, CAST(l_linenumber AS DOUBLE) AS b FROM lineitem", [field("l_orderkey"), field("a", "t", to="f64"), field("b", "l_linenumber", to="f64")], prepare=lambda df: df.withColumn("t", F.col("l_quantity").cast("string")))
mapped("coerce_bool", "lineitem", "SELECT l_orderkey, l_linenumber % 2 = 1 AS odd, l_returnflag = 'R' AS returned FROM lineitem", [field("l_orderkey"), field("odd", "n", to="bool"), field("returned", "t", to="bool")], prepare=lambda df: df.withColumn("n", F.col("l_linenumber") % 2).withColumn("t", F.when(F.col("l_returnflag") == "R", "TRUE").otherwise("0")))
mapped("coerce_string", "part", "SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS s, '' AS nothing FROM part", [field("k", "p_partkey", to="string"), field("s", "p_size", to="string"), field("nothing", "n", to="string")], prepare=lambda df: df.withColumn("n", F.lit(None).cast("int")), onMissingField="null")
mapped("coerce_ts_iso", "events", "SELECT event_id, epoch_ms(date_trunc('milliseconds', ts)) AS ms FROM events", [field("event_id"), field("ms", "t", to="timestamp_ms")], prepare=lambda df: df.withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
mapped("coerce_ts_unix_s", "orders", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS ms FROM orders", [field("o_orderkey"), field("ms", "t", to="timestamp_ms", fmt="unix_s")], prepare=lambda df: df.withColumn("t", F.unix_seconds(F.to_utc_timestamp(F.col("o_orderdate"), "UTC")).cast("string")))
mapped("coerce_ts_unix_ms", "orders", "SELECT o_orderkey, epoch_ms(o_orderdate) AS ms FROM orders", [field("o_orderkey"), field("ms", "t", to="timestamp_ms", fmt="unix_ms")], prepare=lambda df: df.withColumn("t", F.unix_millis(F.to_utc_timestamp(F.col("o_orderdate"), "UTC"))))
_MIXED = {"prepare": lambda df: df.withColumn("t", F.when(F.col("p_size") % 3 == 0, F.concat("p_brand")).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), F.col("p_size"))).otherwise(F.col("p_size").cast("string")))}
mapped("policy_drop_record", "part", "SELECT p_partkey, CAST(p_size AS BIGINT) AS n FROM part WHERE p_size % 3 = 2", [field("p_partkey"), field("n", "t", to="i64")], onCoerceError="dropRecord", **_MIXED)
mapped("policy_null_on_error", "part", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN CAST(p_size AS BIGINT) END AS n FROM part", [field("p_partkey"), field("n", "t", to="i64")], onCoerceError="null", **_MIXED)
mapped("policy_missing_null", "region", "SELECT r_name, CAST(NULL AS VARCHAR) AS gone, '' AS blank FROM region", [field("r_name"), field("gone"), field("blank", "nowhere", to="string")], onMissingField="null")
mapped("policy_required_default", "region", "SELECT r_name, 'x' AS gone, CAST(5 AS BIGINT) AS five FROM region", [field("r_name", required=True), field("gone", default="x", required=True), field("five", default="5", to="i64")])


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) * 2.0::DOUBLE AS k2 FROM events")
def ndjson_variant_transform(spark, sf_dir):
    """Lines of JSON with the types of each record, transformed."""
    lines = readers.parse_lines(table(spark, sf_dir, "events").select(F.col("props").alias("value")))
    return transform(lines, {"fields": [field("k", to="i64"), field("k2", compute="k * 2")]}, "record")


@query("SELECT event_id FROM events WHERE event_id % 4 < 2")
def ndjson_skip_invalid(spark, sf_dir):
    """Blank lines and lines that can't be JSON are skipped."""
    id_ = F.col("event_id")
    value = F.when(id_ % 4 < 2, F.concat(F.lit('{"event_id": '), id_, F.lit("}"))).when(id_ % 4 == 2, F.concat(F.lit("# "), id_)).otherwise("  ")
    got = readers.parse_lines(table(spark, sf_dir, "events").select(value.alias("value")))
    return transform(got, {"fields": [field("event_id", to="i64")]}, "record")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def json_array_explode(spark, sf_dir):
    """Documents that are lists, a record an element."""
    path = scratch_path(spark, "json")
    sinks.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, "json")
    return readers.read(spark, path, "json").select("o_orderkey", "o_orderstatus")


@query('SELECT n_nationkey AS "nation.key", n_name AS "nation.name", n_name AS "tags.0", CAST(n_regionkey AS VARCHAR) AS "tags.1", n_regionkey AS "items.0.id" FROM nation')
def flatten_nested(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(
        F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("nation"),
        F.array("n_name", F.col("n_regionkey").cast("string")).alias("tags"),
        F.array(F.struct(F.col("n_regionkey").alias("id"))).alias("items"),
    )
    return flatten(df)


def _xml_rows(df: DataFrame, body) -> DataFrame:
    return df.select(F.concat(F.lit("<?xml version='1.0'?><all>junk & more"), body, F.lit("</all>")).alias("value"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS \"@id\", n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def xml_attributes(spark, sf_dir):
    """Attributes of the record element, text outside records ignored, child attributes dropped."""
    body = F.concat(F.lit('<nation id="'), "n_nationkey", F.lit('"><name lang="x">'), "n_name", F.lit("</name><region>"), "n_regionkey", F.lit("</region><none/></nation>"))
    texts = _xml_rows(table(spark, sf_dir, "nation"), body)
    return readers.parse_xml(texts, "nation", readers.xml_schema(['<nation id="1"><name lang="x">a</name><region>1</region></nation>']), XmlOptions(record="nation"))


@query("SELECT r_name AS name, concat(r_name, '|', r_regionkey) AS tags FROM region")
def xml_repeated_children(spark, sf_dir):
    body = F.concat(F.lit("<r><name>"), "r_name", F.lit("</name><tag>"), "r_name", F.lit("</tag><tag>"), "r_regionkey", F.lit("</tag></r>"))
    schema = readers.xml_schema(["<r><name>a</name><tag>b</tag><tag>c</tag></r>"])
    got = readers.parse_xml(_xml_rows(table(spark, sf_dir, "region"), body), "r", schema, XmlOptions(record="r"))
    return got.select("name", F.array_join("tag", "|").alias("tags"))


@query("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations")
def csv_quoting_roundtrip(spark, sf_dir):
    """Commas, quotes and newlines survive CSV; null and empty are both empty there."""
    path = scratch_path(spark, "csv")
    sinks.write(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path, "csv")
    return readers.read_csv(spark, path, CsvOptions(delimiter=",", multiline=True)).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id::VARCHAR AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations")
def csv_exact_dialect(spark, sf_dir):
    """Quotes escaped by a backslash and doubled ones in one file."""
    path = scratch_path(spark, "csv")
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col("turn") % 2 == 0, F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))).otherwise(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')))
    rows = table(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit(","), F.coalesce("role", F.lit("")), F.lit(',"'), text, F.lit('"')).alias("value"))
    rows.write.text(path)
    options = CsvOptions(delimiter=",", headers=False, exact=True, multiline=True)
    return readers.read_csv(spark, path, options, ["conv_id", "role", "text"])


#: Rows of a table in one text file at most, about; what one task sorts.
_FILE_ROWS = 1_000_000


def _text_files(spark, sf_dir, plain, late: list[str], name: str, first: str, last: str = "") -> str:
    """Files of a line for each row of lineitem, in order over all of them, and late lines behind them in the last; each begins with first and ends with last."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem")
    # the late lines are one row, so that no file can end between them
    lines = rows.select(key.alias("at"), plain.alias("value")).unionByName(spark.createDataFrame([(1 << 40, "\n".join(late))], "at long, value string"))
    path = scratch_path(spark, name)
    files = lines.repartitionByRange(1 + rows.count() // _FILE_ROWS, "at").sortWithinPartitions("at")
    sinks.enclosed(files.select("value"), f"{first}\n", "", last).write.text(path)
    return path


@query(
    """SELECT l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b, CAST(NULL AS VARCHAR) AS field_2 FROM lineitem
    UNION ALL VALUES ('7', '8', '9'), ('x', NULL, NULL), ('y', 'say "so", ' || chr(10) || 'twice', NULL)"""
)
def csv_ragged_late(spark, sf_dir):
    """Rows with more and fewer fields, an escape and a quoted newline, behind all plain ones."""
    plain = F.concat("l_orderkey", F.lit(","), "l_linenumber")
    path = _text_files(spark, sf_dir, plain, ["7,8,9", "x", 'y,"say \\"so\\", ', 'twice"'], "csv", "a,b")
    return readers.read_csv(spark, path, CsvOptions(delimiter=","))


@query("SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR ELSE '' END AS c FROM orders")
def csv_empty_fields(spark, sf_dir):
    """An empty field is an empty text, quoted or not."""
    path = scratch_path(spark, "csv")
    s = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")
    c = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise('""')
    rows = table(spark, sf_dir, "orders").select(F.concat_ws(",", "o_orderkey", s, c).alias("value"))
    rows.write.text(path)
    return readers.read_csv(spark, path, CsvOptions(delimiter=",", headers=False), ["k", "s", "c"])


@query("SELECT l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b FROM lineitem UNION ALL VALUES ('a', 'b'), ('a', 'b'), ('4', '5\\')")
def csv_header_like_row(spark, sf_dir):
    """Only a file's first record is its header; rows like it are data."""
    plain = F.concat("l_orderkey", F.lit(","), "l_linenumber")
    path = _text_files(spark, sf_dir, plain, ["a,b", "a,b", "4,5\\"], "csv", "a,b")
    return readers.read_csv(spark, path, CsvOptions(delimiter=","))


@query(
    """SELECT l_orderkey::VARCHAR AS a, CAST(NULL AS VARCHAR) AS late, CAST(NULL AS VARCHAR) AS "@n" FROM lineitem
    UNION ALL VALUES ('1|2', 'x & y', NULL), (NULL, NULL, '9')"""
)
def xml_late_element(spark, sf_dir):
    """An element, a repetition and an attribute that occur behind all plain records."""
    late = ["<row><a>1</a><late>x &amp; y</late><a>2</a></row>", '<row n="9"/>']
    plain = F.concat(F.lit("<row><a>"), "l_orderkey", F.lit("</a></row>"))
    path = _text_files(spark, sf_dir, plain, late, "xml", "<all>", "</all>")
    got = readers.read_xml(spark, path, XmlOptions(record="row"))
    return got.select(F.when(F.size("a") > 0, F.array_join("a", "|")).alias("a"), "late", "`@n`")


#: Inputs of detection; the SQL has what must be found in them.
_DETECTED = {
    "object": '{"ship": "Dara", "log": {"day": 1}}',
    "list": '[\n {"a": 1},\n {"a": 2}\n]',
    "lines": '{"a":1}\n{"b-c":2}',
    "lists": "[1,2]\n[3,4]",
    "number": "42",
    "comma": "a,b\n1,2",
    "tab": "a\tb\n1\t2",
    "bar": '"x|y"|c\n1|2',
    "semicolon": "a;b;c\n1;2;3\n4;5;6",
    "mark": "\ufeffa,b\n1,2",
    "element": "<fleet><vessel><name>a</name></vessel><vessel><name>b</name></vessel></fleet>",
    "prolog": "<?xml version='1.0'?><log><year><day>1</day><day>2</day></year></log>",
    "doctype": "<!DOCTYPE x><x/>",
    "words": "plain words only",
    "blank": "  \n ",
}


@query(
    """SELECT * FROM (VALUES ('object', 'json', 'day,log,ship', NULL, NULL), ('list', 'json', 'a', NULL, NULL), ('lines', 'ndjson', 'a,b-c', NULL, NULL),
    ('lists', 'ndjson', '', NULL, NULL), ('number', 'json', '', NULL, NULL), ('comma', 'csv', 'a,b', ',', NULL), ('tab', 'csv', 'a,b', chr(9), NULL),
    ('bar', 'csv', 'x|y,c', '|', NULL), ('semicolon', 'csv', 'a,b,c', ';', NULL), ('mark', 'csv', 'a,b', ',', NULL), ('element', 'xml', 'fleet,name,vessel', NULL, 'vessel'),
    ('prolog', 'xml', 'day,log,year', NULL, 'day'), ('doctype', 'xml', 'x', NULL, NULL), ('words', NULL, NULL, NULL, NULL), ('blank', NULL, NULL, NULL, NULL)
    ) t(name, format, fields, delimiter, record)"""
)
def detect_cases(spark, sf_dir):
    """Format, fields, delimiter and record element of samples."""
    rows = []
    for name, text in _DETECTED.items():
        found = detect_structure(text.encode())
        rows.append((name, *((None,) * 4 if found is None else (found.format, ",".join(found.fields), found.delimiter, found.record))))
    return spark.createDataFrame(rows, "name string, format string, fields string, delimiter string, record string")


@query(
    """SELECT * FROM (VALUES ('missing', 'TransformError', 'Missing field ' || chr(39) || 'gone' || chr(39)), ('required', 'TransformError', 'Missing required field ' || chr(39) || 'gone' || chr(39)),
    ('not an object', 'TransformError', 'Transform expects object records'), ('broken line', 'JsonParseError', 'a line is broken JSON'), ('open quote', 'CsvParseError', 'a quote is not closed')) t(name, kind, message)"""
)
def error_kinds(spark, sf_dir):
    """What ends a conversion, and how."""
    gone = {"fields": [field("gone")]}
    cases = [
        ("missing", '{"a":1}\n', "ndjson", gone),
        ("required", '{"a":1}\n', "ndjson", {"fields": [field("gone", required=True)]}),
        ("not an object", "1\n", "ndjson", gone),
        ("broken line", '{"a":1}\n{broken\n', "ndjson", None),
        ("open quote", 'a,b\n"x,1\n', "csv", None),
    ]
    rows = []
    for name, text, fmt, change in cases:
        try:
            convert(spark, text, "ndjson", input=fmt, transform=change)
        except ConvertError as error:
            rows.append((name, type(error).__name__, str(error)))
    return spark.createDataFrame(rows, "name string, kind string, message string")


@query("SELECT event_id, event_id % 3 <> 0 AS has_kind, CASE WHEN event_id % 3 <> 0 THEN event_type END AS kind FROM events")
def policy_missing_drop(spark, sf_dir):
    """A target whose origin a record lacks is left out of that record."""
    value = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_id"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    source, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    table(spark, sf_dir, "events").select(value.alias("value")).write.text(source)
    Converter(spark, input="ndjson", output="ndjson", transform={"fields": [field("event_id"), field("kind", "event_type")], "onMissingField": "drop"}).run(source, target)
    record = F.parse_json("value")
    got = spark.read.text(target).select(record.alias("r"), F.array_contains(F.json_object_keys("value"), "kind").alias("has_kind"))
    return got.select(F.variant_get("r", "$.event_id", "long").alias("event_id"), "has_kind", F.try_variant_get("r", "$.kind", "string").alias("kind"))


@query(
    r"""WITH s AS (SELECT t, regexp_replace(coalesce(x, ''), '^[\s\x{FEFF}]+', '') AS x FROM (
      SELECT 'events' AS t, props AS x FROM events UNION ALL SELECT 'nation', concat_ws(',', n_nationkey, n_name) FROM nation UNION ALL SELECT 'pages', html FROM pages))
    SELECT t, CASE WHEN x = '' THEN NULL WHEN regexp_matches(x, '^<(\?xml|!DOCTYPE|[A-Za-z])') THEN 'xml'
      WHEN regexp_matches(x, '^[{\[]') THEN CASE WHEN regexp_matches(x, '^[{\[][^\n]*[}\]]\s*\n\s*[{\[][^\n]*[}\]]\s*(\n|$)') THEN 'ndjson' ELSE 'json' END
      WHEN regexp_matches(regexp_extract(x, '^[^\n]*'), '[,\t;|]') THEN 'csv'
      WHEN regexp_matches(x, '^("([^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)\s*(\n|$)') THEN 'json' END AS format, count(*) AS n FROM s GROUP BY ALL"""
)
def detect_format_rows(spark, sf_dir):
    """The format that each value looks like."""
    parts = [
        table(spark, sf_dir, "events").select(F.lit("events").alias("t"), F.col("props").alias("x")),
        table(spark, sf_dir, "nation").select(F.lit("nation").alias("t"), F.concat_ws(",", "n_nationkey", "n_name").alias("x")),
        table(spark, sf_dir, "pages").select(F.lit("pages").alias("t"), F.col("html").alias("x")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("t", looks_like(F.col("x")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'orders' AS t, count(*) AS records FROM orders")
def stats_record_count(spark, sf_dir):
    """Records that a conversion counts on the way."""
    source, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    sinks.write(table(spark, sf_dir, "orders"), source, "ndjson")
    stats = Converter(spark, input="ndjson", output="csv").run(source, target)
    return spark.createDataFrame([("orders", stats.records)], "t string, records long")


@query("SELECT event_id, value * 2 AS twice, upper(event_type) AS kind FROM events")
def stream_transform_events(spark, sf_dir):
    """Files of lines, converted as a stream."""
    source, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    sinks.write(events, source, "ndjson")
    config = ConverterConfig(input="ndjson", output="ndjson", transform={"fields": [field("event_id"), field("twice", compute="value * 2"), field("kind", compute="upper(event_type)")]})
    job = StreamJob(spark, config, source, target, events.schema).start()
    try:
        job.wait()
    finally:
        job.abort()
    return spark.read.schema("event_id long, twice double, kind string").json(target)


#: The table of the conversion matrix, in SQL and with the types that each format keeps.
_MATRIX = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"
_AS_TEXT = "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer"


def _with_spark(spark: SparkSession, path: str, fmt: str, columns: list[str]) -> DataFrame:
    """The output of a conversion, read with Spark's own sources."""
    if fmt == "csv":
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).select(columns)
    if fmt == "xml":
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        return spark.read.format("xml").schema(schema).option("rowTag", "record").load(path)
    return spark.read.option("multiLine", fmt == "json").json(path).select(columns)


def _matrix(a: str, b: str, with_transform: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target = scratch_path(spark, a), scratch_path(spark, b)
        df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        sinks.write(df, source, a)
        change = {"mode": "augment", "fields": [field("c_name", compute="lower(c_name)")]} if with_transform else None
        options = {"xml": XmlOptions(record="record"), "csv": CsvOptions(delimiter=",")}
        Converter(spark, input=a, output=b, transform=change, **options).run(source, target)
        return _with_spark(spark, target, b, df.columns)

    return run


#: Records that differ in keys and types, as JSON, and what is asked about each: its number, the text of v (null: absent), whether it has v, and w.
_MIXED_LINE = r"""concat('{"id":', event_id, CASE event_id % 5 WHEN 0 THEN ',"v":1.5' WHEN 1 THEN concat(',"v":"', event_type, ' \\"q\\" & <b>, ü"') WHEN 2 THEN ',"v":null'
 WHEN 3 THEN concat(',"w":{"k":[', event_id, ',{"x":true}]},"v":[]') ELSE '' END, '}')"""
_MIXED_SQL = r"""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '1.5' WHEN 1 THEN concat('"', event_type, ' \"q\" & <b>, ü"') WHEN 2 THEN 'null' WHEN 3 THEN '[]' END AS v,
 event_id % 5 <> 4 AS has_v, CASE WHEN event_id % 5 = 3 THEN concat('{"k":[', event_id, ',{"x":true}]}') END AS w FROM events"""


def _mixed(a: str, b: str, with_transform: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target = scratch_path(spark, a), scratch_path(spark, b)
        lines = table(spark, sf_dir, "events").select(F.expr(_MIXED_LINE).alias("value"))
        (sinks.enclosed(lines, "[", ",", "]") if a == "json" else lines).write.text(source)
        change = {"mode": "augment", "fields": [field("twice", compute="id * 2")]} if with_transform else None
        Converter(spark, input=a, output=b, transform=change).run(source, target)
        got = spark.read.text(target, wholetext=b == "json").select(F.parse_json("value").alias("r"))
        if b == "json":
            got = got.select(F.explode(F.col("r").cast("array<variant>")).alias("r"))
        text = F.to_json("r")
        more = [F.variant_get("r", "$.twice", "double").alias("twice")] if with_transform else []
        v, w = F.try_variant_get("r", "$.v", "variant"), F.try_variant_get("r", "$.w", "variant")
        return got.select(F.variant_get("r", "$.id", "long").alias("id"), F.to_json(v).alias("v"), F.array_contains(F.json_object_keys(text), "v").alias("has_v"), F.to_json(w).alias("w"), *more)

    return run


for _a in ("csv", "ndjson", "json", "xml"):
    for _b in ("csv", "ndjson", "json", "xml"):
        _typed = _a in ("ndjson", "json") and _b in ("ndjson", "json")
        for _changed in (False, True):
            _name = f"matrix_{_a}_to_{_b}" + "_transform" * _changed
            Q[_name] = _matrix(_a, _b, _changed)
            SQL[_name] = (_MATRIX if _typed else _AS_TEXT).replace("c_name,", "lower(c_name) AS c_name,") if _changed else (_MATRIX if _typed else _AS_TEXT)
            if _typed:
                _name = f"mixed_{_a}_to_{_b}" + "_transform" * _changed
                Q[_name] = _mixed(_a, _b, _changed)
                SQL[_name] = _MIXED_SQL.replace(" AS w FROM", " AS w, event_id * 2.0::DOUBLE AS twice FROM") if _changed else _MIXED_SQL


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
