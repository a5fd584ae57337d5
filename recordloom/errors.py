"""What can go wrong, by kind."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class ConvertError(Exception):
    """Any failure of a conversion."""


class ConfigError(ConvertError, ValueError):
    """A configuration that can't be used."""


class ExpressionError(ConfigError):
    """A compute expression that can't be compiled."""


class TransformError(ConvertError):
    """A record that a transform rejects."""


class CsvParseError(ConvertError):
    pass


class JsonParseError(ConvertError):
    pass


class XmlParseError(ConvertError):
    pass


class EncodingError(ConvertError):
    """Text that is not UTF-8."""


class UnsupportedError(ConvertError):
    pass


KINDS = {c.__name__: c for c in (TransformError, CsvParseError, JsonParseError, XmlParseError, EncodingError)}


def failure(kind: type[ConvertError], what: str) -> Column:
    """A column that ends the query, so that of_spark() finds its kind."""
    return F.raise_error(F.lit(f"{kind.__name__}: {what}"))


def of_spark(error: Exception) -> ConvertError | None:
    """The kind of an error that a running query ended with; None if it is none of ours."""
    text = str(error)
    if m := re.search(r"\b(" + "|".join(KINDS) + r"): ([^\n]*)", text):
        return KINDS[m[1]](re.sub(r"\s*SQLSTATE: \w+$", "", m[2]))
    if "MALFORMED_RECORD_IN_PARSING" in text or "MALFORMED_VARIANT" in text or "INVALID_JSON" in text:
        return JsonParseError(text.partition("\n")[0])
    return None
