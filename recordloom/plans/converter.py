"""Conversions: read, transform, write."""

from __future__ import annotations

import contextlib
import time
from dataclasses import dataclass, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, ConvertError, of_spark
from ..operators.transform import TransformPlan
from ..options import ConverterConfig, CsvOptions, Transform, XmlOptions, format_name
from ..scratch import scratch_path
from ..sources import detect, readers, sinks

#: Media type and file extension of each format.
FILE_TYPES = {"csv": ("text/csv", "csv"), "ndjson": ("application/x-ndjson", "ndjson"), "json": ("application/json", "json"), "xml": ("application/xml", "xml")}


def mime_type(fmt: str) -> str:
    return FILE_TYPES[format_name(fmt)][0]


def extension(fmt: str) -> str:
    return FILE_TYPES[format_name(fmt)][1]


def suggested_filename(name: str, fmt: str, stamp: bool = False) -> str:
    """name with the format's extension, and the time before it on request."""
    stem = PurePosixPath(name).stem or "converted"
    return f"{stem}{time.strftime('_%Y%m%dT%H%M%S') if stamp else ''}.{extension(fmt)}"


def file_type(fmt: str) -> dict:
    """What a file dialog needs."""
    return {"description": f"{format_name(fmt).upper()} file", "accept": {mime_type(fmt): ["." + extension(fmt)]}}


@dataclass(frozen=True)
class Stats:
    """What one run did. Bytes and files are those in the file system; records are those written; plan_seconds is the time before the first record is written (samples, schemas)."""

    bytes_in: int
    bytes_out: int
    records: int
    seconds: float
    files_in: int = 0
    files_out: int = 0
    plan_seconds: float = 0.0

    @property
    def mb_per_second(self) -> float:
        return self.bytes_in / 2**20 / self.seconds if self.seconds else 0.0

    @property
    def write_seconds(self) -> float:
        return self.seconds - self.plan_seconds


def size_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and number of the files at a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [store.getContentSummary(s.getPath()) for s in (store.globStatus(where) or ())]
    return sum(x.getLength() for x in found), sum(x.getFileCount() for x in found)


def bytes_of(spark: SparkSession, path: str) -> int:
    return size_of(spark, path)[0]


@contextlib.contextmanager
def own_errors():
    """Errors of queries as errors of this package, where they are."""
    try:
        yield
    except Exception as error:
        if (own := of_spark(error)) is not None and not isinstance(error, ConvertError):
            raise own from error
        raise


#: The name of the column of a record's own text while it is transformed.
_LINE = "__line"


class Converter:
    """A conversion between any two formats, with or without a transform. All are one composition of a reader, the transform and a writer."""

    def __init__(self, spark: SparkSession, config: ConverterConfig | None = None, **options):
        self.spark = spark
        self.config = replace(config, **options) if config else ConverterConfig(**options)
        self.plan = TransformPlan(self.config.transform) if self.config.transform else None

    def records(self, path: str, variant: bool = False) -> DataFrame:
        c = self.config
        return readers.read(self.spark, path, c.input, c.csv, c.xml, variant)

    def transformed(self, df: DataFrame) -> DataFrame:
        if self.plan is None:
            return df
        if df.columns == ["record"] and isinstance(df.schema["record"].dataType, T.VariantType):
            if self.plan.config.mode == "replace":
                return self.plan.compile(df, "record")
            lines = df.select(F.to_json("record").alias(_LINE))
            return self.transformed_lines(lines, _LINE).select(F.parse_json("value").alias("record"))
        return self.plan.compile(df)

    def transformed_lines(self, lines: DataFrame, name: str = "value") -> DataFrame:
        """Records as lines of JSON (in the column `name`), transformed; a column `value` of lines."""
        line = F.col(name)
        rows = lines.select(line.alias(_LINE), F.parse_json(line).alias("record"))
        is_object = F.startswith(F.ltrim(F.col(_LINE), F.lit(" \t\r\n")), F.lit("{"))
        if self.plan.config.mode == "replace":
            return sinks.render(self.plan.compile(rows, "record", is_object=is_object), "ndjson", self.plan.dropped)
        targets = list(dict.fromkeys(f.target for f in self.plan.config.fields))
        out = self.plan.compile(rows, "record", carry=_LINE, is_object=is_object)
        return out.select(sinks.augmented_line(F.col(_LINE), targets, self.plan.dropped).alias("value"))

    def convert(self, path: str, variant: bool = False) -> DataFrame:
        """The converted records as a DataFrame: typed columns, or one VARIANT column `record` with each record's own keys and types."""
        return self.transformed(self.records(path, variant))

    def input_format(self, path: str) -> str:
        if self.config.input != "auto":
            return self.config.input
        found = detect.detect_structure(detect.read_sample(self.spark, path))
        if found is None:
            raise ConfigError(f"the format of {path} is unknown")
        return found.format

    def texts(self, path: str, variant: bool | None = None) -> DataFrame | None:
        """Rows of text of the output (a column `value`) where records needn't have columns: JSON or NDJSON from anything but CSV, unless variant is False.

        Without a transform a record's text is passed on as it is; with one, a
        record keeps its own keys and types. None where columns are needed.
        """
        c, fmt = self.config, self.input_format(path)
        if variant is False or fmt == "csv" or c.output not in ("ndjson", "json"):
            return None
        lines = readers.read_lines(self.spark, path, fmt, c.xml)
        if self.plan is None:
            return lines
        return self.transformed_lines(lines)

    def run(self, source: str, target: str, single_file: bool = False, variant: bool | None = None, mode: str = "errorifexists") -> Stats:
        """Converts files to a folder of files (single_file: to one file) and counts the records on the way.

        variant: whether records keep their own keys and types; by default
        they do from JSON, NDJSON and XML to JSON and NDJSON.
        """
        begun = time.monotonic()
        seen = Observation()
        count = F.count(F.lit(1)).alias("n")
        with own_errors():
            rows = self.texts(source, variant)
            df = self.convert(source, bool(variant)) if rows is None else rows
            if rows is None and self.config.output in ("csv", "xml"):
                df = sinks.typed(df)
            planned = time.monotonic()
            if rows is None:
                sinks.write(df.observe(seen, count), target, self.config.output, self.plan.dropped if self.plan else frozenset(), single_file=single_file, mode=mode)
            else:
                sinks.write_texts(rows.observe(seen, count), target, self.config.output, single_file=single_file, mode=mode)
        seconds = time.monotonic() - begun
        (bytes_in, files_in), (bytes_out, files_out) = size_of(self.spark, source), size_of(self.spark, target)
        return Stats(bytes_in, bytes_out, int(seen.get["n"]), seconds, files_in, files_out, planned - begun)

    def to_text(self, path: str, variant: bool | None = None) -> str:
        """A small result as one text."""
        with own_errors():
            rows = self.texts(path, variant)
            if rows is not None:
                return sinks.joined([r["value"] for r in rows.collect()], self.config.output)
            return sinks.to_text(self.convert(path, bool(variant)), self.config.output, self.plan.dropped if self.plan else frozenset())


def auto_config(sample: bytes | str, output: str = "ndjson") -> ConverterConfig:
    """The configuration for input like a sample: its format, delimiter and record element."""
    found = detect.detect_structure(sample)
    if found is None:
        raise ConfigError("the format of the sample is unknown")
    return ConverterConfig(input=found.format, output=output, csv=CsvOptions(delimiter=found.delimiter), xml=XmlOptions(record=found.record))


def convert(spark: SparkSession, text: str | bytes, output: str, input: str = "auto", csv: CsvOptions = CsvOptions(), xml: XmlOptions = XmlOptions(), transform: Transform | dict | None = None, variant: bool | None = None) -> str:
    """A small text in one format as a text in another.

    The text goes to a file of the shared folder, so that it takes the same way as files do.
    """
    raw = text.encode() if isinstance(text, str) else text
    if input == "auto":
        found = detect.detect_format(raw)
        if found is None:
            raise ConfigError("the format of the input is unknown")
        input = found
    if not raw.strip():
        return {"json": "[]", "xml": "<root>\n</root>"}.get(format_name(output), "")
    path = scratch_path(spark, "input")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()
    return Converter(spark, input=input, output=output, csv=csv, xml=xml, transform=transform).to_text(path, variant)


def convert_file(spark: SparkSession, source: str, target: str, output: str, input: str = "auto", **options) -> Stats:
    """Files to files; options as for ConverterConfig, and single_file and mode as for Converter.run."""
    run = {k: options.pop(k) for k in ("single_file", "mode", "variant") if k in options}
    return Converter(spark, input=input, output=output, **options).run(source, target, **run)
