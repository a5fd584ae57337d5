"""Readers: CSV, NDJSON, JSON and XML files, or a column of text, as DataFrames of records."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, CsvParseError, EncodingError, JsonParseError, XmlParseError, failure
from ..options import CsvOptions, XmlOptions, format_name
from ..scratch import scratch_path
from .detect import decoded, detect_delimiter, detect_structure, read_sample, xml_elements

#: Escapes inside quotes and in XML texts; how a line that may be JSON begins; the byte-order mark.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}
JSON_START = r'^\s*[{\["tfn\-0-9]'
BOM = "\ufeff"
#: Characters of CSV text that are searched for records at once, about.
PIECE = 1 << 18
#: The name of the text of an element that has only text in some records and elements in others.
VALUE = "#text"


def utf8(column: Column) -> Column:
    """The texts; one that is not UTF-8 is an error."""
    return F.when(F.is_valid_utf8(column), column).otherwise(failure(EncodingError, "a line is not UTF-8").cast("string"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files (a column `value`) without byte-order marks."""
    line = utf8(F.col("value"))
    return spark.read.text(path).select(F.when(F.startswith("value", F.lit(BOM)), F.substring(line, 2, 1 << 30)).otherwise(line).alias("value"))


# CSV


@functools.cache
def _record_patterns(quote: str) -> tuple[re.Pattern, re.Pattern]:
    """A record with its end, and the rest of a quoted part."""
    q = re.escape(quote)
    rest = rf"(?:[^{q}\\]++|\\.)*+{q}"
    return re.compile(rf"(?:[^{q}\r\n]++|{q}{rest})*+(\r\n|\r|\n|\Z)", re.S), re.compile(rest, re.S)


def csv_records(text: str, quote: str) -> list[str]:
    """Records of a whole text: they end at newlines outside quotes. An open quote at the end is an error."""
    if quote not in text:
        return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    record, _ = _record_patterns(quote)
    out, at = [], 0
    while m := record.match(text, at):
        out.append(text[at : m.start(1)])
        at = m.end()
        if not m[1]:
            return out
    raise CsvParseError("a quote is not closed")


def ends_inside(text: str, quote: str, inside: bool) -> bool:
    """Whether a text ends inside quotes, if it begins inside (or outside) of them."""
    if "\\" not in text:
        return inside ^ (text.count(quote) % 2 == 1)
    _, rest = _record_patterns(quote)
    at = 0
    while True:
        if not inside:
            at = text.find(quote, at) + 1
            if not at:
                return False
        m = rest.match(text, at)
        if not m:
            return True
        inside, at = False, m.end()


def piece_records(text: str, quote: str, inside: bool) -> tuple[int, list[str], int]:
    """Of lines that begin inside (or outside) of quotes: where the record that is open before them ends (-1: behind them), the whole records, where one begins that is open behind them (the length: none)."""
    record, rest = _record_patterns(quote)
    begin = 0
    if inside:
        m = rest.match(text)
        m = m and record.match(text, m.end())
        if not m:
            return -1, [], len(text)
        begin = m.end()
    if quote not in text[begin:]:
        return begin, csv_records(text[begin:], quote)[:-1], len(text)
    out, at = [], begin
    while at < len(text) and (m := record.match(text, at)):
        out.append(text[at : m.start(1)])
        at = m.end()
    return begin, out, at


@functools.cache
def _csv_patterns(delimiter: str, quote: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """A field with its end, a quoted part of it, and what stands for something else inside such a part."""
    q, d = re.escape(quote), re.escape(delimiter)
    inside = rf"(?:[^{q}\\]++|\\.|\\\Z|{q}{q})*+"
    return re.compile(rf"((?:[^{q}{d}]++|{q}{inside}(?:{q}|\Z))*+)({d}|\Z)", re.S), re.compile(rf"{q}({inside})(?:{q}|\Z)", re.S), re.compile(rf"\\(.)|{q}{q}", re.S)


def csv_fields(record: str, delimiter: str, quote: str, trim: bool) -> list[str]:
    """Fields of a record. Quotes may open anywhere; inside, a doubled quote and a backslash escape are both read."""
    if quote not in record:
        out = record.split(delimiter)
    else:
        field, part, special = _csv_patterns(delimiter, quote)
        plain = lambda m: quote if m[1] is None or m[1] == quote else ESCAPES.get(m[1], "\\" + m[1])
        out, at = [], 0
        while m := field.match(record, at):
            raw, at = m[1], m.end()
            out.append(part.sub(lambda m: special.sub(plain, m[1]) if "\\" in m[1] or quote in m[1] else m[1], raw) if quote in raw else raw)
            if not m[2]:
                break
    return [x.strip(" \t") for x in out] if trim else out


def _line_rows(lines: DataFrame, options: CsvOptions, delimiter: str, header: list[str] | None) -> DataFrame:
    """A column `fields` of every line (a column value) that is not blank. header: the first record of every file has these fields and is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = None
        for batch in batches:
            rows = []
            for text, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                record = (text or "").rstrip("\r")
                if record.strip():
                    fields = csv_fields(record.removeprefix(BOM), delimiter, options.quote, options.trim)
                    if header is not None and block == 0 and file != begun:
                        begun = file
                        _same_header(fields, header, file)
                    else:
                        rows.append(fields)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["fields"])

    rows = lines.select(utf8(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.mapInArrow(run, "fields array<string>")


def _same_header(fields: list[str], header: list[str], file: str) -> None:
    if fields != header:
        raise CsvParseError(f"{file} has another header than the first file: {fields}")


def _csv_pieces(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """Files in pieces of whole lines: file, block (where the split of the file begins) and piece (its number there) give their order.

    text ends with a newline; blank: it has nothing else. outside and within:
    whether it ends inside quotes if it begins outside or inside of them;
    ends: whether a record that is open before it ends in it. The pieces are
    written to the shared folder, as another scan may split files elsewhere.
    """
    names = ["file", "block", "piece", "text", "blank", "outside", "within", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece() -> pa.RecordBatch:
            text = "\n".join(lines) + "\n"
            ends = piece_records(text, quote, True)[0] >= 0 if quote in text else False
            row = (*begun, number, text, not text.strip(), ends_inside(text, quote, False), ends_inside(text, quote, True), ends)
            return pa.RecordBatch.from_pydict({n: [x] for n, x in zip(names, row)})

        begun, number, lines, size = None, 0, [], 0
        for batch in batches:
            for text, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if begun != (file, block) or size > PIECE:
                    if lines:
                        yield piece()
                    number = number + 1 if begun == (file, block) else 0
                    begun, lines, size = (file, block), [], 0
                lines.append(text)
                size += len(text) + 1
        if lines:
            yield piece()

    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(utf8(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kept = scratch_path(spark, "pieces")
    lines.mapInArrow(run, "file string, block long, piece long, text string, blank boolean, outside boolean, within boolean, ends boolean").write.parquet(kept)
    return spark.read.parquet(kept)


def _placed(pieces: DataFrame) -> DataFrame:
    """The pieces with what those before them tell: inside and open, whether they begin and end inside quotes; owner, where the record that is open before them begins; heads, whether they have the header, the first record of a file.

    A window over a few values a piece; an open quote at the end of a file is an error.
    """
    order = Window.partitionBy("file").orderBy("block", "piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("block", "piece")
    # a piece keeps the state, turns it or sets it; between two that set it only the number of turns counts
    sets, turn = F.col("outside") == F.col("within"), (F.col("outside") & ~F.col("within")).cast("long")
    found = pieces.drop("text").withColumn("turns", F.sum(turn).over(order))
    found = found.withColumn("set", F.last(F.when(sets, F.struct("outside", "turns")), ignorenulls=True).over(before)).withColumn("turned", F.coalesce(F.lag("turns").over(order), F.lit(0)))
    turns = F.coalesce(F.col("set.outside").cast("long"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("set.turns"), F.lit(0))
    found = found.withColumn("inside", turns % 2 == 1).withColumn("open", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    found = found.withColumn("owner", F.last(F.when(~F.col("inside") | F.col("ends"), place), ignorenulls=True).over(before))
    found = found.withColumn("heads", ~F.col("blank") & F.coalesce(F.min(F.col("blank")).over(before), F.lit(True))).withColumn("last", F.lead("piece").over(order).isNull())
    unclosed = F.when(F.col("last") & F.col("open"), failure(CsvParseError, "a quote is not closed").cast("boolean")).otherwise(F.col("open"))
    # those that begin and end outside are as they seem, and needn't be looked up
    seen = found.select("file", "block", "piece", "inside", unclosed.alias("open"), "owner", "heads").filter("inside or open or heads")
    no = F.lit(False)
    rows = pieces.select("file", "block", "piece", "text").join(F.broadcast(seen), ["file", "block", "piece"], "left")
    return rows.select("file", "text", place.alias("place"), *(F.coalesce(F.col(c), no).alias(c) for c in ("inside", "open", "heads")), "owner")


def _piece_rows(pieces: DataFrame, options: CsvOptions, delimiter: str, header: list[str] | None) -> DataFrame:
    """A column `fields` of every record that is not blank, of pieces of files, with newlines inside quotes; a record that goes on from piece to piece is put together."""
    quote = options.quote

    def fields_of(record: str, file: str, heads: bool) -> list[str] | None:
        fields = csv_fields(record.removeprefix(BOM), delimiter, quote, options.trim)
        if header is None or not heads:
            return fields
        _same_header(fields, header, file)
        return None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text, inside, heads in zip(*(c.to_pylist() for c in batch.columns)):
                for record in piece_records(text, quote, inside)[1]:
                    if record.strip():
                        if (fields := fields_of(record, file, heads)) is not None:
                            rows.append(fields)
                        heads = False
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["fields"])
                        rows = []
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["fields"])

    place = pa.struct([("block", pa.int64()), ("piece", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text, at, owner, inside, heads in zip(*(c.to_pylist() for c in batch.columns)):
                end, records, begin = piece_records(text, quote, inside)
                if inside:
                    rows.append((file, owner, at, text if end < 0 else text[:end], False))
                if begin < len(text):
                    rows.append((file, at, at, text[begin:], heads and not any(r.strip() for r in records)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), place, place, pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "owner", "at", "text", "heads"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (fields_of(csv_records(text, quote)[0], file, heads) for file, text, heads in zip(*(c.to_pylist() for c in batch.columns)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x in found if x is not None], pa.list_(pa.string()))], names=["fields"])

    placed = _placed(pieces)
    at = "struct<block: long, piece: long>"
    cuts = placed.filter("inside or open").select("file", "text", "place", "owner", "inside", "heads").mapInArrow(cut, f"file string, owner {at}, at {at}, text string, heads boolean")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    cuts = cuts.groupBy("file", "owner").agg(F.array_join(texts, "").alias("text"), F.max("heads").alias("heads"))
    rows = placed.select("file", "text", "inside", "heads").mapInArrow(whole, "fields array<string>")
    return rows.unionByName(cuts.select("file", "text", "heads").mapInArrow(joined, "fields array<string>"))


def _last_of_each(names: list[str]) -> dict[str, int]:
    return {n: i for i, n in enumerate(names)}


def csv_traits(lines: DataFrame, delimiter: str, quote: str, width: int) -> dict[str, bool]:
    """Of all lines (a column `value`): odd, whether one has an odd count of quotes; special, whether one has a backslash, another number of fields than width (but for blank lines), or a quote that neither begins nor ends a field. A line that is not UTF-8 is an error."""
    q, d = (f"\\x{{{ord(c):x}}}" for c in (quote, delimiter))
    line = F.col("value")
    quoted = F.contains(line, F.lit(quote))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    bare = F.when(quoted, F.regexp_replace(line, f"{q}[^{q}]*+{q}", "")).otherwise(line)
    inner = quoted & F.contains(F.regexp_replace(line, f"(?<=^|{d})(?:{q}[^{q}]*+{q})++(?={d}|$)", ""), F.lit(quote))
    blank = F.length(F.trim(line, F.lit(" \t\r"))) == 0
    special = F.contains(line, F.lit("\\")) | ((count(bare, delimiter) != max(width, 1) - 1) & ~blank) | inner
    found = lines.agg(F.max(quoted & (count(line, quote) % 2 == 1)).alias("odd"), F.max(special).alias("special"), F.max(~F.is_valid_utf8(line)).alias("bad")).first()
    if found["bad"]:
        raise EncodingError("a line is not UTF-8")
    return {"odd": bool(found["odd"]), "special": bool(found["special"])}


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions(), names: list[str] | None = None) -> DataFrame:
    """All columns are texts, empty ones too. Extra fields are field_{i}, missing ones null; of equal names the last field counts.

    Where all lines of all files have plain quoting and as many fields as the
    header, Spark's own source reads, in splits. Where one has more or less
    (see csv_traits), every record is parsed with both ways of escaping, and
    widths are found by one aggregate; where one has an odd count of quotes,
    records may have newlines, and files are read in pieces for which a window
    tells whether they begin inside quotes. The sample tells only the
    delimiter and header; a file with another header is an error.
    """
    text = decoded(read_sample(spark, path))
    delimiter = options.delimiter or detect_delimiter(text)
    records = [r for r in _sampled_records(text, options.quote) if r.strip()]
    first = csv_fields(records[0], delimiter, options.quote, options.trim) if records else []
    header = names or (first if options.headers else [f"field_{i}" for i in range(len(first))])
    exact, multiline = options.exact, options.multiline
    if records and (multiline is None or exact is None and not multiline):
        traits = csv_traits(spark.read.text(path), delimiter, options.quote, len(first))
        multiline = traits["odd"] if multiline is None else multiline
        exact = traits["odd"] or traits["special"] or len(set(header)) < len(header) if exact is None else exact
    elif exact is None:
        exact = True
    if not records:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names or ()]))
    if not exact:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
        reader = spark.read.schema(schema).option("header", options.headers).option("sep", delimiter).option("quote", options.quote).option("escape", options.quote)
        reader = reader.option("multiLine", multiline).option("ignoreLeadingWhiteSpace", options.trim).option("ignoreTrailingWhiteSpace", options.trim)
        rows = reader.option("emptyValue", "").option("enforceSchema", names is not None).option("mode", "FAILFAST").csv(path)
        # every row has all fields, so what Spark takes for null is an empty one
        return rows.select(*(F.coalesce(F.col("`" + n.replace("`", "``") + "`"), F.lit("")).alias(n) for n in header))
    expected = first if options.headers else None
    rows = _piece_rows(_csv_pieces(spark, path, options.quote), options, delimiter, expected) if multiline else _line_rows(spark.read.text(path), options, delimiter, expected)
    widest = max(rows.agg(F.max(F.size("fields")).alias("n")).first()["n"] or 0, len(header))
    names = header + [f"field_{i}" for i in range(len(header), widest)]
    return rows.select(*(F.try_element_at("fields", F.lit(i + 1)).alias(n) for n, i in _last_of_each(names).items()))


def _sampled_records(text: str, quote: str) -> list[str]:
    """Records of a sample without the last, which may be cut."""
    try:
        return csv_records(text, quote)
    except CsvParseError:
        cut = text.rpartition("\n")[0]
        return csv_records(cut, quote) if cut and cut.count(quote) % 2 == 0 else cut.split("\n")[:1]


# NDJSON and JSON


def json_lines(texts: DataFrame) -> DataFrame:
    """The lines that are neither blank nor begin in a way that no JSON does. texts has `value`."""
    return texts.filter((F.length(F.trim("value")) > 0) & F.col("value").rlike(JSON_START))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it (the parser alone would overlook what follows).

    It must be one value between brackets, and if it might close them itself,
    between braces as well.
    """
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    keyed = F.json_object_keys(F.concat(F.lit('{"k":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(one & (~F.contains(text, F.lit("]")) | keyed), F.lit(False))


def checked(lines: DataFrame) -> DataFrame:
    """The lines that json_lines() leaves, as they are; a broken one is an error."""
    value = F.col("value")
    return json_lines(lines).select(F.when(is_json(value), value).otherwise(failure(JsonParseError, "a line is broken JSON").cast("string")).alias("value"))


def parse_lines(lines: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Records of lines: typed columns with a schema, or else one VARIANT column `record`. A broken line is an error; typed records are those of lines that are objects."""
    lines = checked(lines)
    if schema is None:
        return lines.select(F.parse_json("value").alias("record"))
    lines = lines.filter(F.col("value").rlike(r"^\s*\{"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | None = None, variant: bool = False, sample: float = 1.0) -> DataFrame:
    """Typed columns (schema given, or inferred from a share of the lines), or one VARIANT column `record` with each record's own types."""
    lines = text_lines(spark, path)
    if variant:
        return parse_lines(lines)
    if schema is None:
        schema = spark.read.option("samplingRatio", sample).option("mode", "DROPMALFORMED").json(path).schema
    return parse_lines(lines, T.StructType([f for f in schema.fields if f.name != "_corrupt_record"]))


def _objects_by_line(spark: SparkSession, path: str) -> DataFrame | None:
    """The elements of lists whose files have one object a line, as lines, in splits; None if any file is otherwise.

    One aggregate decides, over all lines: outside the objects, which must be
    valid, a file has one bracket of each kind and a comma between any two.
    """
    value = F.col("value")
    element = F.regexp_extract("value", r"^\s*\[?\s*,?\s*(\{.*\})\s*,?\s*\]?\s*$", 1)
    lines = text_lines(spark, path).select(value, element.alias("element"), F.input_file_name().alias("file"))
    rest = F.regexp_replace(F.when(F.col("element") == "", value).otherwise(F.replace(value, F.col("element"), F.lit(""))), r"\s", "")
    count = lambda c: F.sum(F.length("rest") - F.length(F.replace(F.col("rest"), F.lit(c), F.lit(""))))
    bad = F.rlike("rest", F.lit(r"[^\[\],]")) | ((F.col("element") != "") & ~is_json(F.col("element")))
    files = lines.withColumn("rest", rest).groupBy("file").agg(count("[").alias("a"), count("]").alias("b"), count(",").alias("c"), F.sum((F.col("element") != "").cast("long")).alias("n"), F.max(bad).alias("bad"))
    good = ~F.col("bad") & (F.col("a") == 1) & (F.col("b") == 1) & (F.col("c") == F.greatest(F.col("n") - 1, F.lit(0)))
    if files.agg(F.min(good).alias("good")).first()["good"]:
        return lines.filter("element <> ''").select(F.col("element").alias("value"))
    return None


def _elements(text: str) -> Iterator[str]:
    """The JSON texts of the elements of a top-level list, or of the one top-level object; they have no newlines."""

    def refuse(name: str):
        raise ValueError(f"{name} is no JSON")

    decoder, space = json.JSONDecoder(parse_constant=refuse), re.compile(r"[ \t\r\n]*")
    skip = lambda at: space.match(text, at).end()
    at = skip(1 if text.startswith(BOM) else 0)
    listed = text.startswith("[", at)
    if not text[at:]:
        return
    at = skip(at + 1) if listed else at
    while not (listed and text.startswith("]", at)):
        value, end = decoder.raw_decode(text, at)
        if listed or isinstance(value, dict):
            yield text[at:end] if "\n" not in text[at:end] and "\r" not in text[at:end] else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        at = skip(end)
        if not listed:
            break
        if text.startswith(",", at):
            at = skip(at + 1)
            if text.startswith("]", at):
                raise ValueError("a comma before the end of a list")
        elif not text.startswith("]", at):
            raise ValueError("a comma or the end of the list is missing")
    if skip(at + listed) < len(text):
        raise ValueError("text after the document")


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """A line of JSON (a column `value`) for each element of top-level lists, and for each top-level object; other values have none.

    Where all files have one object a line they are read in splits; else a
    file is one task and must fit into its memory.
    """
    found = _objects_by_line(spark, path)
    if found is not None:
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                out, size = [], 0
                try:
                    for element in _elements(text or ""):
                        out.append(element)
                        size += len(element)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
                            out, size = [], 0
                except ValueError as error:
                    raise JsonParseError(str(error)) from error
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    return spark.read.text(path, wholetext=True).select(utf8(F.col("value")).alias("value")).mapInArrow(run, "value string")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, variant: bool = False) -> DataFrame:
    """Records of documents: the elements of a top-level list, or the one top-level object; other values have no record. Typed records are those that are objects."""
    lines = json_elements(spark, path)
    if variant:
        return lines.select(F.parse_json("value").alias("record"))
    if schema is None:
        objects = lines.filter(F.startswith(F.ltrim("value"), F.lit("{")))
        shape = objects.agg(F.schema_of_variant_agg(F.parse_json("value")).alias("s")).first()["s"]
        if not shape or not shape.startswith("OBJECT<"):
            return spark.createDataFrame([], T.StructType([]))
        schema = T.StructType.fromDDL(variant_ddl(shape))
    return parse_lines(lines, schema)


def variant_ddl(shape: str) -> str:
    """The fields of the struct that holds objects of a variant's shape; what differs from record to record is text, numbers with a fraction double."""
    ddl = shape.removeprefix("OBJECT<").removesuffix(">").replace("OBJECT<", "STRUCT<")
    return re.sub(r"(?<=[:<])( ?)(?:VARIANT|VOID)\b", r"\1STRING", re.sub(r"(?<=[:<])( ?)DECIMAL\(\d+, ?\d+\)", r"\1DOUBLE", ddl))


# XML


class XmlRecords:
    """The records of texts, each as a dictionary: text, dictionaries and, for names that repeat, lists.

    A record begins at the start tag of its element and ends at the first end
    tag of that name; everything outside is ignored. Its attributes are @name;
    attributes of other elements don't count. An element with only text is
    that text (the last of several runs that is not blank), one without
    anything is absent. A self-closed record has its attributes only.
    """

    def __init__(self, record: str, options: XmlOptions):
        self.options, self.close = options, f"</{record}>"
        self.open = re.compile(rf"<{re.escape(record)}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(/?)>")

    def texts(self, text: str) -> Iterator[str]:
        """The texts of the records."""
        at = 0
        while m := self.open.search(text, at):
            end = m.end() if m[1] else text.find(self.close, m.end())
            if end < 0:
                return
            at = end if m[1] else end + len(self.close)
            yield text[m.start() : at]

    def parse(self, text: str) -> dict:
        root: dict = {}
        stack: list[dict] = []
        run = ""
        trim = self.options.trim

        def start(name: str, attributes: dict) -> None:
            nonlocal run
            run = ""
            if not stack and self.options.attributes:
                root.update({"@" + k: v for k, v in attributes.items()})
            stack.append({} if stack else root)

        def data(value: str) -> None:
            nonlocal run
            if value.strip():
                run = value

        def end(name: str) -> None:
            nonlocal run
            own = stack.pop()
            if not stack:
                return
            value = own
            if not own:
                value, run = run, ""
                if not value:
                    return
                if "\\" in value:
                    value = re.sub(r'\\(["\\nrt])', lambda m: ESCAPES.get(m[1], m[1]), value)
                value = value.strip() if trim else value
            parent = stack[-1]
            if name not in parent:
                parent[name] = value
            elif isinstance(parent[name], list):
                parent[name].append(value)
            else:
                parent[name] = [parent[name], value]

        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
        parser.CommentHandler = parser.StartCdataSectionHandler = parser.ProcessingInstructionHandler = lambda *_: None
        try:
            parser.Parse(text, True)
        except expat.ExpatError as error:
            raise XmlParseError(f"a record is broken: {error}") from error
        return root


def _shape(value: str | list | dict) -> T.DataType:
    if isinstance(value, dict):
        return T.StructType([T.StructField(n, _shape(v)) for n, v in sorted(value.items())])
    return T.ArrayType(functools.reduce(_merged, map(_shape, value))) if isinstance(value, list) else T.StringType()


def _merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """What holds both; where one is text and the other a structure, that has the text as VALUE."""
    if isinstance(a, T.ArrayType) or isinstance(b, T.ArrayType):
        x, y = (t.elementType if isinstance(t, T.ArrayType) else t for t in (a, b))
        return T.ArrayType(_merged(x, y))
    if isinstance(a, T.StructType) or isinstance(b, T.StructType):
        a, b = (T.StructType([T.StructField(VALUE, t)]) if isinstance(t, T.StringType) else t for t in (a, b))
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _merged(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in sorted(fields.items())])
    return a


def _fitted(value: str | list | dict, dtype: T.DataType):
    """A value in the form that the schema of all records has; what that doesn't know is left out."""
    if isinstance(dtype, T.ArrayType):
        return [_fitted(x, dtype.elementType) for x in (value if isinstance(value, list) else [value])]
    if isinstance(value, list):
        value = value[-1]
    if isinstance(dtype, T.StructType):
        value = value if isinstance(value, dict) else {VALUE: value}
        return {f.name: _fitted(value[f.name], f.dataType) for f in dtype.fields if f.name in value}
    return value.get(VALUE) if isinstance(value, dict) else value


def xml_schema(sample: Iterable[str], attributes: bool = True, record: str | None = None) -> T.StructType:
    """The schema of records (texts of one element each): texts, objects and lists, with the record's attributes as @name."""
    shape: T.DataType = T.StructType([])
    for text in sample:
        parse = XmlRecords(record or "", XmlOptions(attributes=attributes)).parse
        shape = _merged(shape, _shape(parse(text)))
    return shape


def xml_pieces(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Files (a column `value`) cut after each end tag of the record, in splits; the last piece of a file gets one too."""
    close = f"</{record}>"
    return spark.read.option("lineSep", close).text(path).select(F.concat(utf8(F.col("value")), F.lit(close)).alias("value"))


def inferred_xml_schema(texts: DataFrame, record: str, options: XmlOptions = XmlOptions()) -> T.StructType:
    """The schema of all records of the texts (a column `value`): one partial shape a task, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, shape, seen = XmlRecords(record, options), T.StructType([]), set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for own in map(records.parse, records.texts(text)):
                    # records that have the same names without anything inside add nothing
                    plain = tuple(own) if not any(isinstance(v, (dict, list)) for v in own.values()) else None
                    if plain is None or plain not in seen:
                        shape = _merged(shape, _shape(own))
                        if plain is not None and len(seen) < 1000:
                            seen.add(plain)
        yield pa.RecordBatch.from_arrays([pa.array([shape.json()], pa.string())], names=["shape"])

    shape: T.DataType = T.StructType([])
    for row in texts.select("value").mapInArrow(run, "shape string").distinct().toLocalIterator():
        shape = _merged(shape, T.StructType.fromJson(json.loads(row["shape"])))
    return shape


def xml_lines(texts: DataFrame, record: str, options: XmlOptions = XmlOptions(), schema: T.StructType | None = None) -> DataFrame:
    """A line of JSON (a column `value`) for each record of the texts: its own shape, or that of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, encode = XmlRecords(record, options), json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                for own in map(records.parse, records.texts(text)):
                    out.append(encode(own if schema is None else _fitted(own, schema)))
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
                        out = []
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    return texts.select("value").mapInArrow(run, "value string")


def parse_xml(texts: DataFrame, record: str, schema: T.StructType, options: XmlOptions = XmlOptions()) -> DataFrame:
    """Records of the texts (a column `value`) as typed columns."""
    return xml_lines(texts, record, options, schema).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def xml_record(spark: SparkSession, path: str, options: XmlOptions) -> str:
    return options.record or xml_elements(decoded(read_sample(spark, path)))[1] or "row"


def read_xml(spark: SparkSession, path: str, options: XmlOptions = XmlOptions(), schema: T.StructType | None = None, variant: bool = False) -> DataFrame:
    """Records of XML files, read in splits; all leaves are texts.

    Typed columns have the names and shapes of all records, found in a first
    pass where no schema is given; or one VARIANT column `record` has each
    record's own. The sample only tells the record element. A record that
    ends with its file before its end tag is read as far as it goes, if it is
    well-formed with one.
    """
    record = xml_record(spark, path, options)
    pieces = xml_pieces(spark, path, record)
    if variant:
        return xml_lines(pieces, record, options).select(F.parse_json("value").alias("record"))
    schema = inferred_xml_schema(pieces, record, options) if schema is None else schema
    return parse_xml(pieces, record, schema, options) if schema.fields else spark.createDataFrame([], T.StructType([]))


def read_lines(spark: SparkSession, path: str, fmt: str, xml: XmlOptions = XmlOptions()) -> DataFrame:
    """A line of JSON (a column `value`) for each record of NDJSON, JSON or XML files, with its own keys, order and types."""
    if fmt == "ndjson":
        return checked(text_lines(spark, path))
    if fmt == "json":
        return json_elements(spark, path)
    record = xml_record(spark, path, xml)
    return xml_lines(xml_pieces(spark, path, record), record, xml)


def read(spark: SparkSession, path: str, fmt: str = "auto", csv: CsvOptions = CsvOptions(), xml: XmlOptions = XmlOptions(), variant: bool = False) -> DataFrame:
    """Records of files of any format; "auto" is found in a sample."""
    if fmt == "auto":
        found = detect_structure(read_sample(spark, path))
        if found is None:
            raise ConfigError(f"the format of {path} is unknown")
        fmt = found.format
    fmt = format_name(fmt)
    if fmt == "csv":
        return read_csv(spark, path, csv)
    if fmt == "ndjson":
        return read_ndjson(spark, path, variant=variant)
    if fmt == "json":
        return read_json(spark, path, variant=variant)
    return read_xml(spark, path, xml, variant=variant)
