"""Conversions of files as they arrive, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..errors import ConfigError, ConvertError, UnsupportedError
from ..operators.transform import TransformPlan
from ..options import ConverterConfig, CsvOptions
from ..scratch import scratch_path
from ..sources import readers, sinks
from ..sources.detect import detect_structure, read_sample


def read_stream(spark: SparkSession, path: str, fmt: str, schema: T.StructType, csv: CsvOptions = CsvOptions(), files_per_batch: int | None = None) -> DataFrame:
    """Records of files that arrive in a folder. The schema is given; readers.read(...).schema of a first file has it.

    Every operator of a conversion works record by record, so no state is kept between batches.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.schema(schema).option("header", csv.headers).option("sep", csv.delimiter or ",").option("quote", csv.quote).option("escape", csv.quote)
        return reader.option("multiLine", bool(csv.multiline)).option("emptyValue", "").csv(path)
    if fmt == "ndjson":
        return readers.parse_lines(reader.text(path), schema)
    if fmt == "json":
        return reader.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return reader.option("wholetext", True).text(path)


class _Progress(StreamingQueryListener):
    def __init__(self, job: StreamJob, call: Callable[[dict], None] | None):
        self.job, self.call = job, call

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if self.job.query is not None and str(p.id) == self.job.query_id:
            self.job.records += max(0, p.numInputRows)
            if self.call:
                self.call({"batch": p.batchId, "records": self.job.records, "records_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


class StreamJob:
    """A streaming conversion that can be paused, resumed and aborted; its checkpoint says what has been done."""

    def __init__(self, spark: SparkSession, config: ConverterConfig, source: str, target: str, schema: T.StructType, progress: Callable[[dict], None] | None = None, files_per_batch: int | None = None):
        self.spark, self.config, self.source, self.target, self.schema = spark, config, source, target, schema
        self.files_per_batch = files_per_batch
        self.checkpoint = scratch_path(spark, "stream")
        self.query: StreamingQuery | None = None
        self.query_id = ""
        self.records, self.aborted, self.paused = 0, False, False
        self.listener = _Progress(self, progress)
        spark.streams.addListener(self.listener)

    def frame(self) -> DataFrame:
        c = self.config
        df = read_stream(self.spark, self.source, c.input, self.schema, c.csv, self.files_per_batch)
        if c.input == "xml":
            df = readers.parse_xml(df, c.xml.record or "row", self.schema, c.xml)
        return TransformPlan(c.transform).compile(df) if c.transform else df

    def start(self, available_now: bool = True, every: str = "10 seconds") -> StreamJob:
        if self.aborted:
            raise ConvertError("the job was aborted")
        df = self.frame()
        dropped = TransformPlan(self.config.transform).dropped if self.config.transform else frozenset()
        if self.config.output == "csv":
            if any(isinstance(f.dataType, T.ArrayType) for f in df.schema.fields):
                raise UnsupportedError("the columns of a list's elements are not known in a stream")
            df = df.select(*(sinks.as_text(F.col("`" + f.name + "`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)))
            writer = df.writeStream.format("csv").option("header", True).option("escape", '"').option("emptyValue", "")
        else:
            rows = sinks.render(df, self.config.output, dropped)
            if self.config.output == "json":
                rows = sinks.enclosed(rows, "[", ",", "]")
            elif self.config.output == "xml":
                rows = sinks.enclosed(rows, "<root>\n", "", "</root>")
            writer = rows.writeStream.format("text")
        writer = writer.option("path", self.target).option("checkpointLocation", self.checkpoint).outputMode("append")
        self.query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
        self.query_id, self.paused = str(self.query.id), False
        return self

    def wait(self, seconds: float | None = None) -> bool:
        """Until all that was there has been converted (available_now), or the time is over."""
        if self.query is None:
            raise ConvertError("the job is not running")
        if seconds is None:
            self.query.awaitTermination()
            return True
        return bool(self.query.awaitTermination(int(seconds)))

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()
        self.paused = True

    def resume(self, available_now: bool = True) -> StreamJob:
        """Goes on from the checkpoint."""
        if not self.paused:
            raise ConvertError("the job is not paused")
        return self.start(available_now)

    def abort(self) -> None:
        if self.query is not None:
            self.query.stop()
        self.aborted = True
        self.spark.streams.removeListener(self.listener)


def convert_stream(spark: SparkSession, source: str, target: str, output: str, input: str = "auto", schema: T.StructType | None = None, progress: Callable[[dict], None] | None = None, **options) -> StreamJob:
    """A started job that converts the files of a folder, and those that arrive later if resumed. Format and schema are by default those of the files that are there; options as for ConverterConfig."""
    config = ConverterConfig(input=input, output=output, **options)
    if config.input == "auto":
        found = detect_structure(read_sample(spark, source))
        if found is None:
            raise ConfigError(f"the format of {source} is unknown")
        config = replace(config, input=found.format)
    if schema is None:
        schema = readers.read(spark, source, config.input, config.csv, config.xml).schema
    return StreamJob(spark, config, source, target, schema, progress).start()
