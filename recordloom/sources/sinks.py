"""Writers: records as CSV, NDJSON, JSON or XML, as text rows or as files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..operators.flatten import flatten
from ..operators.transform import augmented_variant, quoted
from ..options import format_name
from .readers import variant_ddl


def json_value(column: Column) -> Column:
    """Any value as JSON, null as null."""
    listed = F.to_json(F.array(column), {"ignoreNullFields": "false"})
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def json_line(df: DataFrame, dropped: set[str] = frozenset()) -> Column:
    """A record as one JSON object; null fields are null, but those in dropped are left out."""
    if df.columns == ["record"] and isinstance(df.schema["record"].dataType, T.VariantType):
        return F.to_json(F.col("record"))
    if not set(df.columns) & set(dropped):
        return F.to_json(F.struct(*(quoted(c) for c in df.columns)), {"ignoreNullFields": "false"})
    return F.concat(F.lit("{"), json_members(df.columns, dropped), F.lit("}"))


def json_members(columns: list[str], dropped: set[str] = frozenset()) -> Column:
    """Columns as the inside of a JSON object; those in dropped are left out where they are null."""
    parts = []
    for c in columns:
        part = F.concat(F.lit(_json_text(c) + ":"), json_value(quoted(c)))
        parts.append(F.when(quoted(c).isNotNull(), part) if c in dropped else part)
    return F.concat_ws(",", *parts)


def augmented_line(line: Column, targets: list[str], dropped: set[str] = frozenset()) -> Column:
    """A JSON object's text with the targets' columns over its own fields: added to the text, or where it has one of them, put in its place."""
    text = F.trim(line, F.lit(" \t\r\n"))
    inside = F.substring(text, F.lit(1), F.length(text) - 1)
    added = json_members(targets, dropped)
    comma = F.when((F.length(added) == 0) | text.rlike(r"^\{\s*\}$"), "").otherwise(",")
    kept = F.to_json(augmented_variant(F.parse_json(line), [t for t in targets]))
    # a target that is dropped here leaves the field that it would overwrite
    for t in [t for t in targets if t in dropped]:
        others = [x for x in targets if x != t]
        kept = F.when(quoted(t).isNull(), F.to_json(augmented_variant(F.parse_json(line), others)) if others else text).otherwise(kept)
    return F.when(F.arrays_overlap(F.json_object_keys(text), F.array(*(F.lit(t) for t in targets))), kept).otherwise(F.concat(inside, comma, added, F.lit("}")))


def _json_text(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)


def as_text(column: Column, dtype: T.DataType) -> Column:
    """A value of a flat column as text; null for null."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(column)
    return column.cast("string")


def csv_value(text: Column) -> Column:
    """Quoted only if it has a comma, a quote or a newline; null is empty."""
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def xml_value(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.coalesce(text, F.lit(""))


def xml_name(name: str) -> str:
    """A valid element name: other characters become _."""
    fixed = "".join(c if c.isalnum() or c in "_.:-" else "_" for c in name) or "_"
    return fixed if fixed[0].isalpha() or fixed[0] == "_" else "_" + fixed


def objects(df: DataFrame) -> DataFrame:
    """Only records that are objects: of a VARIANT column `record`, others go."""
    if df.columns == ["record"] and isinstance(df.schema["record"].dataType, T.VariantType):
        return df.filter(F.schema_of_variant("record").startswith("OBJECT"))
    return df


def typed(df: DataFrame) -> DataFrame:
    """VARIANT records as typed columns, by the schema of all of them (one aggregate)."""
    if not (df.columns == ["record"] and isinstance(df.schema["record"].dataType, T.VariantType)):
        return df
    kept = objects(df)
    shape = kept.agg(F.schema_of_variant_agg("record").alias("s")).first()["s"]
    if not shape or not shape.startswith("OBJECT<"):
        return df.sparkSession.createDataFrame([], T.StructType([]))
    return kept.select(F.from_json(F.to_json("record"), T.StructType.fromDDL(variant_ddl(shape))).alias("r")).select("r.*")


def render(df: DataFrame, fmt: str, dropped: set[str] = frozenset(), record: str = "record") -> DataFrame:
    """One row of text a record, in a column `value`: a line of NDJSON, JSON (without the brackets) or CSV (without the header), or an XML element."""
    fmt = format_name(fmt)
    if fmt in ("ndjson", "json"):
        return df.select(json_line(df, dropped).alias("value"))
    if fmt == "csv":
        flat = flatten(typed(df))
        parts = [csv_value(as_text(quoted(f.name), f.dataType)) for f in flat.schema.fields]
        return flat.select((F.concat_ws(",", *parts) if parts else F.lit("")).alias("value"))
    rows = typed(df)
    parts = []
    for f in rows.schema.fields:
        name = xml_name(f.name)
        text = F.concat(F.lit(f"    <{name}>"), xml_value(as_text(quoted(f.name), f.dataType)), F.lit(f"</{name}>\n"))
        parts.append(F.when(quoted(f.name).isNotNull(), text).otherwise("") if f.name in dropped else text)
    return rows.select(F.concat(F.lit(f"  <{record}>\n"), *parts, F.lit(f"  </{record}>")).alias("value"))


def csv_header(df: DataFrame) -> str:
    """The header of render(df, "csv")."""
    names = flatten(typed(df)).columns
    return ",".join('"' + n.replace('"', '""') + '"' if any(c in n for c in ',"\n') else n for n in names)


def enclosed(rows: DataFrame, first: str, between: str, last: str) -> DataFrame:
    """Each partition's rows with a line before, separators between and a line after; so every part file is a whole document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            values = batch.column(0)
            if len(values):
                lead = pa.array([between if begun else first] + [between] * (len(values) - 1), values.type)
                begun = True
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lead, values, "")], names=["value"])
        yield pa.RecordBatch.from_pydict({"value": pa.array([last if begun else first + last], pa.string())})

    return rows.mapInArrow(run, "value string")


def write_texts(rows: DataFrame, path: str, fmt: str, root: str = "root", single_file: bool = False, mode: str = "errorifexists") -> None:
    """Writes what render() gives of JSON, NDJSON or XML (a column `value`) as whole documents."""
    rows = rows.coalesce(1) if single_file else rows
    if fmt == "json":
        rows = enclosed(rows, "[", ",", "]")
    elif fmt == "xml":
        rows = enclosed(rows, f"<{root}>\n", "", f"</{root}>")
    _to_place(path, single_file, mode, rows, lambda writer, where: writer.text(where))


def _to_place(path: str, single_file: bool, mode: str, rows: DataFrame, write) -> None:
    """Writes a folder at path; for a single file, a folder beside it whose one part then gets the name path."""
    if not single_file:
        write(rows.write.mode(mode), path)
        return
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.parts-{uuid.uuid4().hex}")
    files = target.getFileSystem(conf)
    if files.exists(target):
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise ConfigError(f"{path} is there already")
    try:
        write(rows.write, beside.toString())
        part = next(s.getPath() for s in files.listStatus(beside) if s.getPath().getName().startswith("part-"))
        if files.exists(target):
            files.delete(target, True)
        files.rename(part, target)
    finally:
        files.delete(beside, True)


def write(df: DataFrame, path: str, fmt: str, dropped: set[str] = frozenset(), root: str = "root", record: str = "record", single_file: bool = False, mode: str = "errorifexists") -> None:
    """Writes a folder of part files, each a whole document of the format; single_file: one file named path, for results that one task can write."""
    fmt = format_name(fmt)
    if fmt != "csv":
        write_texts(render(df, fmt, dropped, record), path, fmt, root, single_file, mode)
        return
    flat = flatten(typed(df))
    flat = flat.select(*(as_text(quoted(f.name), f.dataType).alias(f.name) for f in flat.schema.fields))
    flat = flat.coalesce(1) if single_file else flat

    def to_csv(writer, where: str) -> None:
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(where)

    _to_place(path, single_file, mode, flat, to_csv)


def to_text(df: DataFrame, fmt: str, dropped: set[str] = frozenset(), root: str = "root", record: str = "record") -> str:
    """A small result as one text on the driver, in the order of the input."""
    fmt = format_name(fmt)
    if fmt == "csv":
        df = typed(df)
    values = [r["value"] for r in render(df, fmt, dropped, record).collect()]
    return joined(values, fmt, csv_header(df) if fmt == "csv" and values else "", root)


def joined(values: list[str], fmt: str, header: str = "", root: str = "root") -> str:
    """Rows of text as one document."""
    if fmt == "json":
        return "[" + ",".join(values) + "]"
    if fmt == "xml":
        return f"<{root}>\n" + "".join(v + "\n" for v in values) + f"</{root}>"
    return "".join(v + "\n" for v in ([header] if header else []) + values)
