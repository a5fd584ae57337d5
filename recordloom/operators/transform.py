"""The transform: a declarative mapping of records, compiled to one select and at most one filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..functions.coerce import coerced
from ..functions.expressions import compile_expression, fail
from ..functions.values import Value, kind_of
from ..options import Field, Transform

_ROW, _KEEP = "__row", "__keep"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fields_of(df: DataFrame, record: str | None = None, extra: tuple[str, ...] = ()) -> dict[str, Value]:
    """The fields of df; with record, those of a VARIANT column, of which the names that are asked for in extra are known."""
    if record is None:
        return {f.name: Value(quoted(f.name), kind_of(f.dataType)) for f in df.schema.fields}
    path = lambda n: "$['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return {n: Value(F.try_variant_get(quoted(record), path(n), "variant"), "variant") for n in extra}


class TransformPlan:
    """A transform for any DataFrame: compile(df) gives the output; `dropped` are the targets that records may lack."""

    def __init__(self, config: Transform | dict):
        self.config = Transform.of(config) if isinstance(config, dict) else config
        self.dropped = {f.target for f in self.config.fields} if self.config.on_missing == "drop" else set()

    def _field(self, f: Field, fields: dict[str, Value], alive: Column) -> tuple[Column, Column]:
        """A target's column, and whether the record stays. `alive`: no earlier field has dropped it, so errors count."""
        config = self.config
        guard = lambda bad, what, then: F.when(alive & bad, fail(what)).otherwise(then)
        if f.compute is not None:
            value = compile_expression(f.compute, fields)
            # an expression's errors count only while the record is alive
            value = Value(F.when(alive, value.column), value.kind)
        else:
            origin = f.origin or f.target
            value = fields.get(origin, Value(F.lit(None), "null"))
        missing = value.is_null() if f.compute is None else F.lit(False)
        what = ""
        if f.compute is None and f.default is not None:
            value = self._or_default(value, f.default)
            missing = F.lit(False)
        elif f.compute is None and f.required:
            what = f"Missing required field '{f.origin or f.target}'"
        elif f.compute is None and config.on_missing == "error":
            what = f"Missing field '{f.origin or f.target}'"
        keep = F.lit(True)
        out = value.column
        if value.kind == "null":
            out = F.lit(None).cast("string")
        if f.coerce is not None:
            out = coerced(value, f.coerce)
            failed = out.isNull()
            skip = missing if config.on_missing == "drop" else F.lit(False)
            if config.on_coerce_error == "error":
                out = F.when(skip, F.lit(None)).otherwise(guard(failed & ~skip, f"Can't coerce '{f.target}' to {f.coerce.type}", out))
            elif config.on_coerce_error == "dropRecord":
                keep = skip | ~failed
                out = F.when(~skip, out)
            else:
                out = F.when(~skip, out)
        if what:
            out = guard(missing, what, out)
        return out, keep

    @staticmethod
    def _or_default(value: Value, default) -> Value:
        if isinstance(default, (dict, list)):
            raise ConfigError("a default is a text, a number or a boolean")
        kind = "bool" if isinstance(default, bool) else "int" if isinstance(default, int) else "float" if isinstance(default, float) else "text"
        if value.kind == "null":
            return Value(F.lit(default), kind)
        if value.kind == kind:
            return Value(F.coalesce(value.column, F.lit(default)), kind)
        if {value.kind, kind} == {"int", "float"}:
            return Value(F.coalesce(value.column.cast("double"), F.lit(float(default))), "float")
        one = F.try_variant_get(F.to_variant_object(F.array(F.lit(default))), "$[0]", "variant")
        was = value.column if value.kind == "variant" else F.try_variant_get(F.to_variant_object(F.array(value.column)), "$[0]", "variant")
        return Value(F.when(value.is_null(), one).otherwise(was), "variant")

    def compile(self, df: DataFrame, record: str | None = None, carry: str | None = None, is_object: Column | None = None) -> DataFrame:
        """df transformed. Fields see the input only, never earlier targets; of equal targets the last wins.

        With record, the name of a VARIANT column that holds whole records,
        every record has its own types; a record that is no object (is_object
        tells, or else its schema) is an error. carry names a column of df
        that is passed on beside the targets.
        """
        config = self.config
        asked = tuple({f.origin or f.target for f in config.fields} | {n for f in config.fields if f.compute for n in _names(f.compute)})
        fields = fields_of(df, record, asked)
        alive, columns = F.lit(True), {}
        if record is not None:
            # what is asked for is taken out of the record once, in a step that the optimiser doesn't merge with those that use it
            is_object = F.schema_of_variant(quoted(record)).startswith("OBJECT") if is_object is None else is_object
            parts = [(v.column.alias(f"f{k}"), F.schema_of_variant(v.column).alias(f"s{k}")) for k, v in enumerate(fields.values())]
            taken = F.struct(is_object.alias("o"), *(c for pair in parts for c in pair))
            df = df.select(*([quoted(carry)] if carry else []), F.explode(F.array(taken)).alias(_ROW))
            fields = {n: Value(F.col(_ROW).getField(f"f{k}"), v.kind, F.col(_ROW).getField(f"s{k}")) for k, (n, v) in enumerate(fields.items())}
            alive = F.when(~F.col(_ROW).getField("o"), fail("Transform expects object records").cast("boolean")).otherwise(F.lit(True))
        drops = False
        for f in config.fields:
            column, keep = self._field(f, fields, alive)
            columns[f.target] = column
            if f.coerce is not None and config.on_coerce_error == "dropRecord":
                drops = True
                alive = alive & keep
        if config.mode == "augment" and record is None:
            rest = {c: quoted(c) for c in df.columns}
            # a target that may be missing leaves the field that it would overwrite
            columns = rest | {t: F.coalesce(c, rest[t]) if t in self.dropped and t in rest and dict(df.dtypes)[t] == "string" else c for t, c in columns.items()}
        if carry is not None:
            columns = {t: c for t, c in columns.items() if t != carry} | {carry: quoted(carry)}
        if not drops:
            return df.select(*(c.alias(t) for t, c in columns.items()))
        row = F.struct(alive.alias(_KEEP), *(F.when(alive, c).alias(t) for t, c in columns.items()))
        kept = df.select(row.alias(_ROW)).filter(F.col(f"{_ROW}.{_KEEP}"))
        return kept.select(*(F.col(_ROW).getField(t).alias(t) for t in columns))


def _names(source: str) -> set[str]:
    from ..functions.expressions import _WORDS, _tokens

    tokens = _tokens(source)
    return {t for (k, t), (_, after) in zip(tokens, tokens[1:]) if k == "name" and t not in _WORDS and after != "("}


def transform(df: DataFrame, config: Transform | dict, record: str | None = None) -> DataFrame:
    return TransformPlan(config).compile(df, record)


def augmented_variant(record: Column, targets: list[str]) -> Column:
    """A VARIANT record with the targets' columns over its own fields."""
    as_map = record.cast(T.MapType(T.StringType(), T.VariantType()))
    new = F.map_from_arrays(F.array(*(F.lit(t) for t in targets)), F.array(*(F.try_variant_get(F.to_variant_object(F.array(quoted(t))), "$[0]", "variant") for t in targets)))
    rest = F.map_filter(as_map, lambda k, _: ~k.isin(targets))
    return F.to_variant_object(F.map_concat(rest, new))
