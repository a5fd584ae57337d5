"""Nested records as flat columns with dotted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transform import quoted


def _leaves(name: str, column: Column, dtype: T.DataType, sizes: dict[str, int]) -> list[tuple[str, Column]]:
    if isinstance(dtype, T.StructType):
        return [x for f in dtype.fields for x in _leaves(f"{name}.{f.name}", column.getField(f.name), f.dataType, sizes)]
    if isinstance(dtype, T.ArrayType):
        out = []
        for i in range(sizes.get(name, 0)):
            item = F.get(column, F.lit(i))
            if isinstance(dtype.elementType, T.ArrayType):
                out.append((f"{name}.{i}", F.to_json(item)))
            else:
                out += _leaves(f"{name}.{i}", item, dtype.elementType, sizes)
        return out
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return [(name, F.to_json(column))]
    return [(name, column)]


def _arrays(name: str, column: Column, dtype: T.DataType, sizes: dict[str, int]) -> list[tuple[str, Column]]:
    """Lists whose lengths aren't known yet, as far as they can be reached."""
    if isinstance(dtype, T.StructType):
        return [x for f in dtype.fields for x in _arrays(f"{name}.{f.name}", column.getField(f.name), f.dataType, sizes)]
    if isinstance(dtype, T.ArrayType):
        if name not in sizes:
            return [(name, column)]
        return [x for i in range(sizes[name]) for x in _arrays(f"{name}.{i}", F.get(column, F.lit(i)), dtype.elementType, sizes) if not isinstance(dtype.elementType, T.ArrayType)]
    return []


def flatten(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Objects become dotted columns, lists a column an index (as many as the longest has), lists in lists JSON. Columns are sorted by name.

    One aggregate a level of lists finds the lengths; without lists there is none.
    """
    sizes: dict[str, int] = {}
    while todo := [x for f in df.schema.fields for x in _arrays(f.name, quoted(f.name), f.dataType, sizes)]:
        found = df.agg(*(F.max(F.size(c)).alias(str(k)) for k, (_, c) in enumerate(todo))).first()
        sizes |= {n: max(0, found[k] or 0) for k, (n, _) in enumerate(todo)}
    leaves = [x for f in df.schema.fields for x in _leaves(f.name, quoted(f.name), f.dataType, sizes)]
    return df.select(*(c.alias(n) for n, c in (sorted(leaves, key=lambda x: x[0]) if ordered else leaves)))
