"""Format and structure of unknown input, judged by a small sample of its bytes."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SAMPLE_BYTES = 256 * 1024
#: Delimiters in the order in which ties are settled; lines that each test looks at.
DELIMITERS = ",\t;|"
CSV_LINES, DELIMITER_LINES, NDJSON_LINES, FIELD_LINES = 16, 10, 32, 10
_JSON_START = re.compile(r'[{\["tfn\-0-9]')
_XML_START = re.compile(r"<(?:\?xml|!DOCTYPE|[A-Za-z])")
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?', re.S)
_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(/?)([A-Za-z_][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)


@dataclass(frozen=True)
class Structure:
    """What a sample shows: fields are column names, keys or element names; delimiter for CSV, record for XML."""

    format: str
    fields: tuple[str, ...] = ()
    delimiter: str | None = None
    record: str | None = None


def decoded(sample: bytes | str) -> str:
    """The text of a sample without a byte-order mark; a character cut at its end is left out."""
    text = sample if isinstance(sample, str) else sample.decode("utf-8", "ignore")
    return text.strip(" \t\r\n\f\v").removeprefix("﻿").lstrip(" \t\r\n\f\v")


def lines_of(text: str, most: int) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n", most)[:most]]


def split_fields(line: str, delimiter: str, quote: str = '"') -> list[str]:
    """Fields of one line; delimiters inside quotes don't count, doubled quotes are one."""
    out, field, inside, at = [], [], False, 0
    while at < len(line):
        c = line[at]
        if c == quote:
            if inside and line[at + 1 : at + 2] == quote:
                field.append(quote)
                at += 1
            else:
                inside = not inside
        elif c == delimiter and not inside:
            out.append("".join(field))
            field = []
        else:
            field.append(c)
        at += 1
    return [*out, "".join(field)]


def detect_delimiter(text: str) -> str:
    """The candidate with the highest share of lines that have it times its count outside quotes; a comma if none occurs."""
    lines = [x for x in lines_of(text, DELIMITER_LINES) if x.strip()]
    best, most = ",", 0.0
    for d in DELIMITERS:
        counts = [len(split_fields(x, d)) - 1 for x in lines]
        score = sum(1 for c in counts if c) / max(1, len(lines)) * sum(counts)
        if score > most:
            best, most = d, score
    return best


def balanced(line: str) -> bool:
    """Whether brackets outside texts open and close in order."""
    open_: list[str] = []
    for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", line):
        if c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return False
    return not open_ and '"' not in re.sub(r'"(?:[^"\\]|\\.)*"', "", line)


def is_ndjson(text: str) -> bool:
    """Two lines in a row that are each a whole object or list."""
    run = 0
    for line in lines_of(text, NDJSON_LINES):
        line = line.strip()
        if not line:
            continue
        if line[0] not in "{[" or not balanced(line):
            return False
        run += 1
        if run == 2:
            return True
    return False


def csv_fields(text: str, delimiter: str | None = None) -> list[str]:
    first = next((x for x in lines_of(text, CSV_LINES) if x.strip()), "")
    return [x.strip() for x in split_fields(first, delimiter or detect_delimiter(text))] if first else []


def detect_format(sample: bytes | str) -> str | None:
    """csv, ndjson, json or xml; None if it looks like none of them."""
    text = decoded(sample)
    if not text:
        return None
    if _XML_START.match(text):
        return "xml"
    if text[0] in "{[":
        return "ndjson" if is_ndjson(text) else "json"
    if len(csv_fields(text)) >= 2:
        return "csv"
    if is_ndjson(text):
        return "ndjson"
    return "json" if _JSON_START.match(text) and not re.match(r"[tfn][A-Za-z]*\s+\w", text) and _scalar(text) else None


def _scalar(text: str) -> bool:
    return re.match(r'(?:"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)\s*(?:\n|$)', text) is not None


def json_fields(text: str) -> list[str]:
    """Plain keys at any depth, sorted."""
    return sorted({m[1] for m in _KEY.finditer(text) if m[2] and re.fullmatch(r"[\w-]+", m[1])})


def xml_elements(text: str) -> tuple[list[str], str | None]:
    """Element names, sorted, and the record element: of those that repeat below the root, one with children, then the shallowest, then the most frequent."""
    counts: Counter[str] = Counter()
    depth_of: dict[str, int] = {}
    parents: set[str] = set()
    stack: list[str] = []
    for m in _TAG.finditer(text):
        end, name, _, alone = m.groups()
        if not name:
            continue
        if end:
            if name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
            continue
        counts[name] += 1
        depth_of[name] = min(depth_of.get(name, len(stack)), len(stack))
        if stack:
            parents.add(stack[-1])
        if not alone:
            stack.append(name)
    order = {n: k for k, n in enumerate(counts)}
    repeated = [n for n, c in counts.items() if c > 1 and depth_of[n] > 0]
    record = min(repeated, key=lambda n: (n not in parents, depth_of[n], -counts[n], order[n]), default=None)
    return sorted(counts), record


def detect_structure(sample: bytes | str, hint: str | None = None) -> Structure | None:
    """Format and fields; None if the format is unknown."""
    text = decoded(sample)
    found = hint or detect_format(text)
    if found == "csv":
        delimiter = detect_delimiter(text)
        return Structure("csv", tuple(csv_fields(text, delimiter)), delimiter)
    if found == "xml":
        elements, record = xml_elements(text)
        return Structure("xml", tuple(elements), record=record)
    if found == "ndjson":
        return Structure("ndjson", tuple(json_fields("\n".join(lines_of(text, FIELD_LINES)))))
    return Structure("json", tuple(json_fields(text))) if found == "json" else None


def read_sample(spark: SparkSession, path: str, most: int = SAMPLE_BYTES) -> bytes:
    """The first bytes of a file, or of the first file with any in a folder; nothing if there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for s in (store.globStatus(where) or ())]
    files = []
    for status in found:
        inside = store.listStatus(status.getPath()) if status.isDirectory() else [status]
        files += [s.getPath() for s in inside if s.isFile() and s.getLen() > 0 and not s.getPath().getName().startswith(("_", "."))]
    if not files:
        return b""
    stream = store.open(min(files, key=lambda p: p.toString()))
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def looks_like(text: Column) -> Column:
    """The format that a text column's values look like, row by row, by their first characters and lines."""
    start = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\x{FEFF}]+", "")
    two = start.rlike(r"^[{\[][^\n]*[}\]]\s*\n\s*[{\[][^\n]*[}\]]\s*(\n|$)")
    first = F.regexp_extract(start, r"^[^\n]*", 0)
    return (
        F.when(start == "", F.lit(None).cast("string"))
        .when(start.rlike(r"^<(\?xml|!DOCTYPE|[A-Za-z])"), "xml")
        .when(start.rlike(r"^[{\[]"), F.when(two, "ndjson").otherwise("json"))
        .when(first.rlike(r"[,\t;|]"), "csv")
        .when(start.rlike(r'^("([^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)\s*(\n|$)'), "json")
    )
