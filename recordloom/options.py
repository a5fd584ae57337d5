"""Configuration of conversions. All classes are immutable and check themselves."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .errors import ConfigError

FORMATS = ("csv", "ndjson", "json", "xml")
#: Other names of formats.
ALIASES = {"jsonl": "ndjson"}
_UNSET = object()


def format_name(name: str) -> str:
    """The canonical name of a format; case doesn't matter."""
    found = ALIASES.get(name.lower(), name.lower())
    if found not in FORMATS:
        raise ConfigError(f"unknown format {name!r}: one of {', '.join(FORMATS)}")
    return found


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    for x in allowed:
        if value.lower() == x.lower():
            return x
    raise ConfigError(f"{name} is {value!r}; allowed are {', '.join(allowed)}")


@dataclass(frozen=True)
class CsvOptions:
    """delimiter None: found in a sample. exact: both "" and backslash escapes, and ragged rows; None: where a line needs it.

    multiline: records may have newlines inside quotes, so pieces of files go to the shared folder (with exact=False a file is one task); None: where a line has an odd count of quotes.
    """

    delimiter: str | None = None
    quote: str = '"'
    headers: bool = True
    trim: bool = False
    exact: bool | None = None
    multiline: bool | None = None

    def __post_init__(self):
        if (self.delimiter is not None and len(self.delimiter) != 1) or len(self.quote) != 1:
            raise ConfigError("delimiter and quote are single characters")


@dataclass(frozen=True)
class XmlOptions:
    """record None: found in a sample."""

    record: str | None = None
    attributes: bool = True
    trim: bool = True


@dataclass(frozen=True)
class Coerce:
    """type: string, i64, f64, bool or timestamp_ms; format (of timestamp_ms): iso8601, unix_ms or unix_s."""

    type: str
    format: str = "iso8601"

    def __post_init__(self):
        object.__setattr__(self, "type", _one_of("coerce type", self.type, ("string", "i64", "f64", "bool", "timestamp_ms")))
        object.__setattr__(self, "format", _one_of("timestamp format", self.format, ("iso8601", "unix_ms", "unix_s")))


@dataclass(frozen=True)
class Field:
    """One target: where it comes from (a top-level field, or an expression), its default and its type."""

    target: str
    origin: str | None = None
    compute: str | None = None
    default: Any = None
    required: bool = False
    coerce: Coerce | None = None

    def __post_init__(self):
        if not self.target:
            raise ConfigError("a field needs a target")


@dataclass(frozen=True)
class Transform:
    """mode: replace or augment. on_missing: error, null or drop. on_coerce_error: error, null or dropRecord. on_missing_required: error or abort, which are the same."""

    fields: tuple[Field, ...]
    mode: str = "replace"
    on_missing: str = "error"
    on_missing_required: str = "error"
    on_coerce_error: str = "error"

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))
        if not self.fields:
            raise ConfigError("a transform needs at least one field")
        for name, allowed in (("mode", ("replace", "augment")), ("on_missing", ("error", "null", "drop")), ("on_missing_required", ("error", "abort")), ("on_coerce_error", ("error", "null", "dropRecord"))):
            object.__setattr__(self, name, _one_of(name, getattr(self, name), allowed))

    @classmethod
    def of(cls, config: dict) -> Transform:
        """From the JSON form: fields with targetFieldName, originFieldName, compute, defaultValue, required and coerce; mode; policies. Unknown keys are errors."""
        known = {"fields", "mode", "onMissingField", "onMissingRequired", "onCoerceError"}
        names = {"targetFieldName": "target", "originFieldName": "origin", "compute": "compute", "defaultValue": "default", "required": "required", "coerce": "coerce"}
        if extra := set(config) - known:
            raise ConfigError(f"unknown keys in a transform: {sorted(extra)}")
        fields = []
        for f in config.get("fields", ()):
            if extra := set(f) - set(names):
                raise ConfigError(f"unknown keys in a field: {sorted(extra)}")
            values = {names[k]: v for k, v in f.items()}
            if isinstance(values.get("coerce"), dict):
                values["coerce"] = Coerce(**values["coerce"])
            fields.append(Field(**{"target": "", **values}))
        return cls(tuple(fields), **{a: config[b] for a, b in (("mode", "mode"), ("on_missing", "onMissingField"), ("on_missing_required", "onMissingRequired"), ("on_coerce_error", "onCoerceError")) if b in config})


@dataclass(frozen=True)
class ConverterConfig:
    """input "auto": found in a sample."""

    input: str = "csv"
    output: str = "ndjson"
    csv: CsvOptions = field(default_factory=CsvOptions)
    xml: XmlOptions = field(default_factory=XmlOptions)
    transform: Transform | None = None

    def __post_init__(self):
        if self.input != "auto":
            object.__setattr__(self, "input", format_name(self.input))
        object.__setattr__(self, "output", format_name(self.output))
        if isinstance(self.transform, dict):
            object.__setattr__(self, "transform", Transform.of(self.transform))
