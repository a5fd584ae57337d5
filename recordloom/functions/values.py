"""Typed views of columns: how a value of each kind is read as text or as a number, and when it can't be."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as numbers, whole numbers, and as numbers that are not finite.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WHOLE = r"^[+-]?[0-9]+$"
NOT_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.NullType):
        return "null"
    if isinstance(dtype, T.VariantType):
        return "variant"
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return "complex"
    return "text"


def finite(number: Column) -> Column:
    """Numbers that are not finite count as 0. (What remains after division by infinity is a finite number itself and NaN for others; so the number is named, and computed, once.)"""
    return F.nanvl(number % F.lit(float("inf")), F.lit(0.0))


def text_number(text: Column) -> Column:
    """The number that a text is, null if it is none."""
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(text.rlike(NOT_FINITE), F.lit(float("nan")))


def text_whole(text: Column) -> Column:
    return F.when(text.rlike(WHOLE), text.try_cast("bigint"))


@dataclass(frozen=True)
class Value:
    """A column and what is known of its kind: text, int, float, bool, null, complex or variant; schema: of a variant, where a column has it."""

    column: Column
    kind: str
    schema: Column | None = None

    def variant_kind(self) -> Column:
        return F.schema_of_variant(self.column) if self.schema is None else self.schema

    def by_kind(self, *, text=None, int=None, float=None, bool=None, complex=None) -> Column:
        """What the function for the value's kind gives; null where there is none. For variants, row by row."""
        given = {"text": text, "int": int, "float": float, "bool": bool, "complex": complex}
        if self.kind != "variant":
            f = given.get(self.kind)
            return F.lit(None) if f is None else f(self.column)
        kind = self.variant_kind()
        as_ = lambda t: F.try_variant_get(self.column, "$", t)
        rules = (("text", kind == "STRING", "string"), ("int", kind == "BIGINT", "bigint"), ("float", kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "double"), ("bool", kind == "BOOLEAN", "boolean"))
        out = None
        for name, test, dtype in rules:
            if given[name] is not None:
                out = F.when(test, given[name](as_(dtype))) if out is None else out.when(test, given[name](as_(dtype)))
        if complex is not None:
            test = kind.startswith("OBJECT") | kind.startswith("ARRAY")
            out = F.when(test, complex(self.column)) if out is None else out.when(test, complex(self.column))
        return F.lit(None) if out is None else out

    def is_null(self) -> Column:
        if self.kind == "variant":
            return self.column.isNull() | F.is_variant_null(self.column)
        return self.column.isNull()

    def number(self) -> Column:
        """As a double, null if it is no number: numbers, texts that are numbers, and booleans."""
        return self.by_kind(text=text_number, int=lambda c: c.cast("double"), float=lambda c: c.cast("double"), bool=lambda c: F.when(c, 1.0).otherwise(F.when(~c, 0.0))).cast("double")

    def json_text(self) -> Column:
        """Texts as they are, all else as JSON; null for null."""
        plain = lambda c: c.cast("string")
        return self.by_kind(text=plain, int=plain, float=plain, bool=plain, complex=F.to_json).cast("string")

    def only_text(self) -> Column:
        """The value if it is a text, or else null."""
        return self.by_kind(text=lambda c: c.cast("string")).cast("string")
