import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import ConfigError, CsvParseError, EncodingError, JsonParseError, TransformError, XmlParseError
from recordloom.functions.json_text import minified, prettified
from recordloom.options import CsvOptions, XmlOptions
from recordloom.operators.flatten import flatten
from recordloom.plans.converter import Converter, auto_config, convert, convert_file, extension, mime_type, suggested_filename
from recordloom.sources import readers, sinks
from recordloom.streaming.jobs import StreamJob, convert_stream
from recordloom.options import ConverterConfig


def put(tmp_path, text, name="in"):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def rows(df):
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]


@pytest.mark.parametrize("text,want", [
    ('ship,note\n"the \\"Heron\\" of Ulm",sloop', [{"ship": 'the "Heron" of Ulm', "note": "sloop"}]),
    ('ship,note\n"Dara","cried ""land"" twice"', [{"ship": "Dara", "note": 'cried "land" twice'}]),
    ('a,b\n"x \\"y\\"","both ""kinds"" here"', [{"a": 'x "y"', "b": 'both "kinds" here'}]),
    ("ship,tons\nDara,80,oak,spare\nHeron,15", [{"ship": "Dara", "tons": "80", "field_2": "oak", "field_3": "spare"}, {"ship": "Heron", "tons": "15"}]),
    ("ship,tons,wood\nP,1,elm\nHeron\nR,2,fir", [{"ship": "P", "tons": "1", "wood": "elm"}, {"ship": "Heron"}, {"ship": "R", "tons": "2", "wood": "fir"}]),
    ("ship,tons,ship\nP,1,Q", [{"ship": "Q", "tons": "1"}]),
    ('a,b\n"first\nsecond",2\n', [{"a": "first\nsecond", "b": "2"}]),
    ("a,b", []),
    ("a,b\n\n  \n1,2\n\n", [{"a": "1", "b": "2"}]),
    ("a,b\r\n1,2\r\n", [{"a": "1", "b": "2"}]),
    ("\ufeffa,b\n1,2", [{"a": "1", "b": "2"}]),
    ("a,b,c\n,,\n1,,\"\"", [{"a": "", "b": "", "c": ""}, {"a": "1", "b": "", "c": ""}]),
    ("a,b\n,\n\"\",x\\", [{"a": "", "b": ""}, {"a": "", "b": "x\\"}]),
    ("a,b\n1,2,3\na,b\n4,5", [{"a": "1", "b": "2", "field_2": "3"}, {"a": "a", "b": "b"}, {"a": "4", "b": "5"}]),
    ("a,b\na,b\n4,5", [{"a": "a", "b": "b"}, {"a": "4", "b": "5"}]),
    ("a,b\n\ufffd,2", [{"a": "\ufffd", "b": "2"}]),
])
def test_csv(spark, tmp_path, text, want):
    assert rows(readers.read_csv(spark, put(tmp_path, text))) == want


def test_csv_options(spark, tmp_path):
    path = put(tmp_path, "1;' a;b ' \n2; x\t")
    got = rows(readers.read_csv(spark, path, CsvOptions(delimiter=";", quote="'", headers=False, trim=True, exact=True)))
    assert got == [{"field_0": "1", "field_1": "a;b"}, {"field_0": "2", "field_1": "x"}]
    with pytest.raises(ConfigError):
        CsvOptions(delimiter=";;")
    with pytest.raises(Exception, match="not closed"):
        readers.read_csv(spark, put(tmp_path, 'a,b\n1,2\n"x,3\n', "open"), CsvOptions(exact=True, multiline=True)).collect()
    assert readers.read_csv(spark, put(tmp_path, "", "empty")).collect() == []
    both = [rows(readers.read_csv(spark, put(tmp_path, 'a,b\n"x, 1",2\n,"q""r"\n', "same"), CsvOptions(exact=e))) for e in (False, True)]
    assert both[0] == both[1] == [{"a": "x, 1", "b": "2"}, {"a": "", "b": 'q"r'}]


@pytest.mark.parametrize("piece", [0, 7, 60, 1 << 18])
def test_csv_records_go_on_from_piece_to_piece(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(readers, "PIECE", piece)
    rng = random.Random(piece)
    source = tmp_path / "folder"
    source.mkdir()
    want, tokens = [], ["a", ",", '"', "\\", "\n", "\r", "\r\n", "ü", '"\n"', ",\n", "\\\n"]
    for name in "12345":
        text = "".join(rng.choice(tokens) for _ in range(400))
        if readers.ends_inside(text, '"', False):
            text += 'x"'
        text = ("﻿" if name == "2" else "") + "\n \n" * (name > "2") + '"k\n1",b\n' + text + rng.choice(["", "\n"])
        assert not readers.ends_inside(text, '"', False)
        put(source, text, name)
        want += [readers.csv_fields(r.removeprefix("﻿"), ",", '"', False) for r in readers.csv_records(text, '"') if r.strip()][1:]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "397")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pieces = readers._csv_pieces(spark, str(source), '"')
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert pieces.filter("block > 0").count() > 0
    have = [r["fields"] for r in readers._piece_rows(pieces, CsvOptions(), ",", ["k\n1", "b"]).collect()]
    assert sorted(have) == sorted(want)


def test_csv_with_newlines_in_quotes_is_not_read_as_whole_files(spark, tmp_path):
    got = readers.read_csv(spark, put(tmp_path, 'a,b\n"x\ny",1\n' * 3))
    assert "wholetext" not in got._jdf.queryExecution().toString().lower()
    assert [f.rsplit("/", 1)[-1][:5] for f in got.inputFiles()] == ["part-"] and got.count() == 5
    with pytest.raises(CsvParseError, match="not closed"):
        convert(spark, 'a,b\n1,2\n"x\n', "ndjson", input="csv")


@pytest.mark.parametrize("exact", [False, True])
def test_csv_files_must_have_one_header(spark, tmp_path, exact):
    source = tmp_path / "folder"
    source.mkdir()
    put(source, "a,b\n1,2\n", "1.csv")
    put(source, "a,b\n3,4\n", "2.csv")
    assert sorted(r["a"] for r in readers.read_csv(spark, str(source), CsvOptions(exact=exact)).collect()) == ["1", "3"]
    put(source, "b,a\n5,6\n", "3.csv")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(source), CsvOptions(exact=exact)).collect()


@pytest.mark.parametrize("fmt,text", [("csv", b"a,b\n1,\xff\n"), ("ndjson", b'{"a":"\xff"}\n'), ("json", b'[{"a":"\xff"}]'), ("xml", b"<r><row><a>\xff</a></row></r>")])
def test_bytes_that_are_no_utf8(spark, tmp_path, fmt, text):
    with pytest.raises(EncodingError):
        Converter(spark, input=fmt, output="ndjson", xml=XmlOptions(record="row")).run(put(tmp_path, text), str(tmp_path / "out"))


def test_csv_fields_against_a_state_machine():
    def slow(record, delimiter, quote):
        out, field, inside, at = [], [], False, 0
        while at < len(record):
            c, after = record[at], record[at + 1 : at + 2]
            if inside and c == "\\" and after:
                field.append(after if after == quote else {"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}.get(after, c + after))
                at += 1
            elif inside and c == quote and after == quote:
                field.append(quote)
                at += 1
            elif c == quote:
                inside = not inside
            elif c == delimiter and not inside:
                out.append("".join(field))
                field = []
            else:
                field.append(c)
            at += 1
        return [*out, "".join(field)]

    rng = random.Random(1)
    for _ in range(20_000):
        record = "".join(rng.choice('a,"\\n') for _ in range(rng.randrange(12)))
        assert readers.csv_fields(record, ",", '"', False) == slow(record, ",", '"'), record


def test_ndjson(spark, tmp_path):
    path = put(tmp_path, '{"a":1,"b":"x"}\r\n\n  \n# no json\n{"a":2,"c":[1]}\n"text"\n42')
    assert rows(readers.read_ndjson(spark, path)) == [{"a": 1, "b": "x"}, {"a": 2, "c": [1]}]
    got = [json.loads(r["record"].toJson()) for r in readers.read_ndjson(spark, path, variant=True).collect()]
    assert [x for x in got if not isinstance(x, str) or x == "text"] == [{"a": 1, "b": "x"}, {"a": 2, "c": [1]}, "text", 42]
    with pytest.raises(Exception):
        readers.read_ndjson(spark, put(tmp_path, '{"a":1}\n{broken', "bad"), variant=True).collect()


@pytest.mark.parametrize("line", ["[1,2", '"open', "{broken", "tru"])
def test_broken_lines_are_errors_whatever_they_begin_with(spark, tmp_path, line):
    path = put(tmp_path, f'{{"a":1}}\n{line}\n')
    with pytest.raises(Exception):
        readers.read_ndjson(spark, path).collect()
    for output in ("ndjson", "json", "csv"):
        with pytest.raises(JsonParseError):
            Converter(spark, input="ndjson", output=output).to_text(path)


def test_json(spark, tmp_path):
    assert rows(readers.read_json(spark, put(tmp_path, '[{"a":1},\n {"a":2}]'))) == [{"a": 1}, {"a": 2}]
    assert rows(readers.read_json(spark, put(tmp_path, '{"a":\n1}', "one"))) == [{"a": 1}]
    assert readers.read_json(spark, put(tmp_path, '42', "scalar"), variant=True).count() == 0
    assert readers.read_json(spark, put(tmp_path, '[{"a":1},"x"]', "mixed"), variant=True).count() == 2
    assert rows(readers.read_json(spark, put(tmp_path, '[{"a":1},"x",{"a":2.5,"b":[{"c":null}]}]', "mixed2"))) == [{"a": 1.0}, {"a": 2.5, "b": [{"c": None}]}]


@pytest.mark.parametrize("text,by_line,want", [
    ('[{"a":1}\n,{"a":2}\n]', True, ['{"a":1}', '{"a":2}']),
    ('[\n{"a":1},\n\n  {"b": [1, 2]}  ,\n{"a":"}"}\n]\n', True, ['{"a":1}', '{"b": [1, 2]}', '{"a":"}"}']),
    ("[]", True, []),
    ('[{"a":{"b":1}\n,"c":2}]', False, ['{"a":{"b":1},"c":2}']),
    ('[{"a":[{"b":1}\n,{"c":2}]}]', False, ['{"a":[{"b":1},{"c":2}]}']),
    ('[[{"a":1},\n{"b":2}]]', False, ['[{"a":1},{"b":2}]']),
    ('[1,\n2]', False, ["1", "2"]),
    ('[1.10, "\u00e9 x", null]', False, ["1.10", '"\u00e9 x"', "null"]),
    ('{"b":1,"a":2}', False, ['{"b":1,"a":2}']),
    ("", False, []),
])
def test_json_elements(spark, tmp_path, text, by_line, want):
    path = put(tmp_path, text)
    assert (readers._objects_by_line(spark, path) is not None) == by_line
    assert [r["value"] for r in readers.json_elements(spark, path).collect()] == want


@pytest.mark.parametrize("text", ['[{"a":1}{"a":2}]', '[{"a":1},]', '[{"a":1}', '{"a":1} x', '[{"a":1}\n{"a":2}\n]', "[NaN]", '[{"a":1}],[{"a":2}]'])
def test_broken_documents(spark, tmp_path, text):
    with pytest.raises(JsonParseError):
        Converter(spark, input="json", output="ndjson").to_text(put(tmp_path, text))


def test_xml(spark, tmp_path):
    text = '<?xml version="1.0"?><items>a & b<item id="1"><name> Mast </name><tag>x</tag><tag>y &amp; z</tag><none/><sub><k>1</k></sub></item><item id="2"><name>C</name></item></items>'
    got = rows(readers.read_xml(spark, put(tmp_path, text)))
    assert got[0]["@id"] == "1" and got[0]["name"] == "Mast" and got[0]["tag"] == ["x", "y & z"] and got[0]["sub"] == {"k": "1"} and "none" not in got[0]
    assert got[1]["@id"] == "2" and got[1]["name"] == "C"
    path = put(tmp_path, "<log><item><g:id>7</g:id></item><itemised><item2/></itemised></log>", "ns")
    assert rows(readers.read_xml(spark, path, XmlOptions(record="item"))) == [{"g:id": "7"}]
    assert rows(readers.read_xml(spark, put(tmp_path, text, "off"), XmlOptions(record="item", attributes=False)))[1] == {"name": "C"}


def test_self_closed_record_takes_nothing(spark, tmp_path):
    got = rows(readers.read_xml(spark, put(tmp_path, '<r><row/><row><a>1</a></row></r>'), XmlOptions(record="row")))
    assert {"a": "1"} in got


def test_flatten_and_csv(spark):
    df = spark.createDataFrame([({"child": "value"}, [{"id": 1}, {"id": 2}], ["a", "b"], [[1, 2]])], "parent struct<child:string>, items array<struct<id:long>>, tags array<string>, deep array<array<int>>")
    assert flatten(df).columns == ["deep.0", "items.0.id", "items.1.id", "parent.child", "tags.0", "tags.1"]
    assert sinks.to_text(df, "csv") == 'deep.0,items.0.id,items.1.id,parent.child,tags.0,tags.1\n"[1,2]",1,2,value,a,b\n'
    one = spark.createDataFrame([("Dara", 'oak, "old"', 1)], "ship string, note string, value int")
    assert sinks.to_text(one, "csv") == 'note,ship,value\n"oak, ""old""",Dara,1\n'


def test_xml_and_json_text(spark):
    df = spark.createDataFrame([("<salt>", '"tar" & oil', None, [1])], "a string, b string, `c d` string, e array<int>")
    assert sinks.to_text(df, "xml") == "<root>\n  <record>\n    <a>&lt;salt&gt;</a>\n    <b>&quot;tar&quot; &amp; oil</b>\n    <c_d></c_d>\n    <e>[1]</e>\n  </record>\n</root>"
    assert json.loads(sinks.to_text(df, "json")) == [{"a": "<salt>", "b": '"tar" & oil', "c d": None, "e": [1]}]
    assert json.loads(sinks.to_text(df, "ndjson", {"c d"})) == {"a": "<salt>", "b": '"tar" & oil', "e": [1]}


CHARACTERS = {
    "csv": 'ship,kind,cargo\nDara,sloop,"salt, and tar"\nHeron,brig,"""fine"" wool"\n',
    "ndjson": '{"ship":"Dara","kind":"sloop","cargo":"salt, and tar"}\n{"ship":"Heron","kind":"brig","cargo":"\\"fine\\" wool"}\n',
    "json": '[{"ship":"Dara","kind":"sloop","cargo":"salt, and tar"},{"ship":"Heron","kind":"brig","cargo":"\\"fine\\" wool"}]',
    "xml": "<fleet><vessel><ship>Dara</ship><kind>sloop</kind><cargo>salt, and tar</cargo></vessel><vessel><ship>Heron</ship><kind>brig</kind><cargo>&quot;fine&quot; wool</cargo></vessel></fleet>",
}


@pytest.mark.parametrize("a", CHARACTERS)
@pytest.mark.parametrize("b", CHARACTERS)
def test_matrix(spark, a, b):
    got = convert(spark, CHARACTERS[a], b)
    back = convert(spark, got, "json", xml=XmlOptions(record="record") if b == "xml" else XmlOptions())
    assert json.loads(back) == json.loads(CHARACTERS["json"])


@pytest.mark.parametrize("fmt", ["json", "ndjson"])
def test_json_keeps_each_records_types(spark, fmt):
    source = {"json": '[{"a":1,"b":null},{"a":"x","z":{"k":[true]}}]', "ndjson": '{"a":1,"b":null}\n{"a":"x","z":{"k":[true]}}'}[fmt]
    assert json.loads(convert(spark, source, "json")) == [{"a": 1, "b": None}, {"a": "x", "z": {"k": [True]}}]
    change = {"mode": "augment", "fields": [{"targetFieldName": "c", "compute": 'concat(a, "!")'}]}
    assert json.loads(convert(spark, source, "json", transform=change)) == [{"a": 1, "b": None, "c": "1!"}, {"a": "x", "z": {"k": [True]}, "c": "x!"}]
    # scalars and lists are records too, where no columns are needed
    odd = {"json": '[1.50,"x",[2],null,{"b":1, "a":2}]', "ndjson": '1.50\n"x"\n[2]\nnull\n{"b":1, "a":2}\n'}[fmt]
    assert convert(spark, odd, "ndjson", input=fmt) == '1.50\n"x"\n[2]\nnull\n{"b":1, "a":2}\n'
    assert convert(spark, odd, "json", input=fmt) == '[1.50,"x",[2],null,{"b":1, "a":2}]'
    assert convert(spark, odd, "csv", input=fmt) == "a,b\n2,1\n"


def test_xml_records_keep_their_own_shapes(spark):
    text = "<r><row n='1'><a>x</a><a>y</a><b><c> 1 </c></b><d/></row><row><a>z<!-- no -->w</a><e>p\\tq<![CDATA[ ]]></e>tail</row><row/></r>"
    want = [{"@n": "1", "a": ["x", "y"], "b": {"c": "1"}}, {"a": "w", "e": "p\tq"}, {}]
    assert json.loads(convert(spark, text, "json", xml=XmlOptions(record="row"))) == want
    change = {"mode": "augment", "fields": [{"targetFieldName": "f", "compute": 'coalesce(e, "none")'}]}
    assert json.loads(convert(spark, text, "json", xml=XmlOptions(record="row"), transform=change))[1] == want[1] | {"f": "p\tq"}
    with pytest.raises(XmlParseError):
        convert(spark, "<r><row><row><a>1</a></row></row></r>", "json", xml=XmlOptions(record="row"))
    with pytest.raises(XmlParseError):
        convert(spark, "<r><row><a>1</row></r>", "csv", xml=XmlOptions(record="row"))


def test_xml_is_read_in_splits(spark, tmp_path):
    body = "".join(f"<row><a>{i}</a><b>{'é' * (i % 50)}&amp;{i}</b></row>\n" for i in range(4000))
    path = put(tmp_path, f"<?xml version='1.0'?><all>{body}</all>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.read_xml(spark, path, XmlOptions(record="row"))
        assert got.rdd.getNumPartitions() > 5
        assert sorted((int(r["a"]), r["b"]) for r in got.collect()) == [(i, "é" * (i % 50) + f"&{i}") for i in range(4000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_input(spark):
    assert convert(spark, "", "json", input="csv") == "[]"
    with pytest.raises(ConfigError):
        convert(spark, "no format", "json")


def test_files_and_stats(spark, tmp_path):
    source, target = put(tmp_path, CHARACTERS["csv"]), str(tmp_path / "out")
    stats = convert_file(spark, source, target, "ndjson", single_file=True)
    assert stats.records == 2 and stats.bytes_in == len(CHARACTERS["csv"]) and stats.bytes_out > 0 and stats.mb_per_second > 0
    assert (stats.files_in, stats.files_out) == (1, 1) and 0 < stats.plan_seconds < stats.seconds
    assert (tmp_path / "out").is_file() and (tmp_path / "out").read_text() == CHARACTERS["ndjson"]
    with pytest.raises(ConfigError):
        convert_file(spark, source, target, "csv", single_file=True)
    convert_file(spark, source, target, "csv", single_file=True, mode="overwrite")
    assert (tmp_path / "out").read_text().splitlines()[0] == "cargo,kind,ship" and [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
    plan = Converter(spark, input="csv", output="json").convert(source)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_errors_have_kinds(spark, tmp_path):
    strict = {"fields": [{"targetFieldName": "gone"}]}
    with pytest.raises(TransformError, match="gone"):
        convert(spark, CHARACTERS["ndjson"], "json", transform=strict)
    with pytest.raises(TransformError, match="object records"):
        convert(spark, "1\n2\n", "ndjson", input="ndjson", transform={"fields": [{"targetFieldName": "a"}]})
    with pytest.raises(CsvParseError):
        convert(spark, 'a,b\n"open,1', "json", input="csv")


def test_auto_config_and_json_text(spark):
    assert auto_config(CHARACTERS["xml"]).xml.record == "vessel" and auto_config("a;b\n1;2").csv.delimiter == ";"
    with pytest.raises(ConfigError):
        auto_config("nothing known")
    row = spark.createDataFrame([('{ "a" : [1, 2] }',), (None,)], "t string").select(minified(F.col("t")).alias("m"), prettified(F.col("t")).alias("p")).collect()
    assert row[0]["m"] == '{"a":[1,2]}' and json.loads(row[0]["p"]) == {"a": [1, 2]} and "\n" in row[0]["p"] and row[1]["m"] is None


def test_names():
    assert mime_type("jsonl") == "application/x-ndjson" and extension("XML") == "xml" and suggested_filename("a/b.csv", "json") == "b.json"
    with pytest.raises(ConfigError):
        ConverterConfig(input="yaml")


@pytest.mark.parametrize("output", ["ndjson", "csv", "json", "xml"])
def test_stream_equals_batch(spark, tmp_path, output):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    put(source, '{"a":1,"b":"x"}\n{"a":2,"b":"y"}\n', "1.json")
    change = {"fields": [{"targetFieldName": "b"}, {"targetFieldName": "c", "compute": "a * 2"}]}
    schema = T.StructType().add("a", "long").add("b", "string")
    seen = []
    job = StreamJob(spark, ConverterConfig(input="ndjson", output=output, transform=change), str(source), target, schema, seen.append)
    job.start().wait()
    job.pause()
    put(source, '{"a":3,"b":"z"}\n', "2.json")
    job.resume().wait()
    job.abort()
    got = readers.read(spark, target, output, CsvOptions(delimiter=","), XmlOptions(record="record"))
    assert sorted((r["b"], float(r["c"])) for r in got.collect()) == [("x", 2.0), ("y", 4.0), ("z", 6.0)]
    with pytest.raises(Exception, match="aborted"):
        job.start()


def test_convert_stream_finds_format_and_schema(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    put(source, "ship;tons\nDara;80\nHeron;15\n", "1.csv")
    job = convert_stream(spark, str(source), target, "ndjson", csv=CsvOptions(delimiter=";"))
    job.wait()
    job.abort()
    assert sorted(r["value"] for r in spark.read.text(target).collect()) == ['{"ship":"Dara","tons":"80"}', '{"ship":"Heron","tons":"15"}']
    (tmp_path / "none").mkdir()
    put(tmp_path / "none", "words only")
    with pytest.raises(ConfigError):
        convert_stream(spark, str(tmp_path / "none"), target, "json")


def test_xml_schema_is_that_of_all_records(spark, tmp_path):
    source = tmp_path / "folder"
    source.mkdir()
    first = "".join(f"<row><a>{i}</a><sub>text</sub></row>" for i in range(12_000))
    put(source, f'<all>{first}<row late="x"><a>1</a><a>2</a><b>y</b></row></all>', "1.xml")
    put(source, '<all><row><a>60000</a><c x:k="1"><d>z</d></c><sub><e>n</e></sub><none/></row></all>', "2.xml")
    assert len(first) > 256 * 1024
    got = rows(readers.read_xml(spark, str(source), XmlOptions(record="row")).filter("a[0] = '60000' or size(a) = 2 or a[0] = '7'").orderBy("a"))
    assert [{k: v for k, v in r.items() if k != "sub"} for r in got] == [{"@late": "x", "a": ["1", "2"], "b": "y"}, {"a": ["60000"], "c": {"d": "z"}}, {"a": ["7"]}]
    assert got[2]["sub"]["#text"] == "text" and got[1]["sub"]["e"] == "n"


@pytest.mark.parametrize("late,want", [
    ("1,2,3\n", [{"a": "1", "b": "2", "field_2": "3"}]),
    ('1,"x \\"y\\""\n', [{"a": "1", "b": 'x "y"'}]),
    ('1,"x\ny"\n', [{"a": "1", "b": "x\ny"}]),
    ('1,x"y, z"\n', [{"a": "1", "b": "xy, z"}]),
])
@pytest.mark.parametrize("other_file", [False, True])
def test_csv_traits_count_wherever_they_stand(spark, tmp_path, late, want, other_file):
    source = tmp_path / "folder"
    source.mkdir()
    first = "a,b\n" + '0,"plain ""text"", quoted"\n' * 12_000
    assert len(first) > 256 * 1024
    put(source, first if other_file else first + late, "1.csv")
    if other_file:
        put(source, "a,b\n" + late, "2.csv")
    got = readers.read_csv(spark, str(source))
    assert rows(got.filter("a <> '0'")) == want and got.count() == 12_001
    assert rows(got.filter("a = '0'").limit(1)) == [{"a": "0", "b": 'plain "text", quoted'}]


def test_plain_csv_is_read_in_splits(spark, tmp_path):
    got = readers.read_csv(spark, put(tmp_path, 'a,b\n1,"x, ""y"""\n2,\n,3\n'))
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert rows(got) == [{"a": "1", "b": 'x, "y"'}, {"a": "2", "b": ""}, {"a": "", "b": "3"}]
