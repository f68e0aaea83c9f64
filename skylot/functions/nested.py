"""Columns of nested types, rebuilt along their schema: fields dropped at any depth, records laid over one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def pruned(kind: DataType, names: frozenset[str]) -> DataType | None:
    """The type without the fields of those names; None for a struct that keeps none, and for what holds nothing but such."""
    if isinstance(kind, StructType):
        kept = StructType()
        for f in kind.fields:
            if f.name not in names and (inner := pruned(f.dataType, names)) is not None:
                kept.add(f.name, inner, f.nullable)
        return kept if kept.fields else None
    if isinstance(kind, ArrayType):
        inner = pruned(kind.elementType, names)
        return inner and ArrayType(inner, kind.containsNull)
    if isinstance(kind, MapType):
        inner = pruned(kind.valueType, names)
        return inner and MapType(kind.keyType, inner, kind.valueContainsNull)
    return kind


def _has_keys(kind: DataType) -> bool:
    """Does a map stand somewhere in the type? Its keys may bear the names."""
    if isinstance(kind, StructType):
        return any(_has_keys(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_keys(kind.elementType)


def without(value: Column, kind: DataType, names: frozenset[str]) -> Column:
    """value, of a type that pruned() keeps, without the fields and the string map keys of those names, whatever their depth.
    Nulls stay nulls."""
    if pruned(kind, names) == kind and not _has_keys(kind):
        return value
    if isinstance(kind, StructType):
        kept = [without(value.getField(f.name), f.dataType, names).alias(f.name) for f in kind.fields if f.name not in names and pruned(f.dataType, names) is not None]
        return F.when(value.isNotNull(), F.struct(*kept))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: without(x, kind.elementType, names))
    assert isinstance(kind, MapType)
    if isinstance(kind.keyType, StringType):
        value = F.map_filter(value, lambda k, _: ~k.isin(*names))
    return F.transform_values(value, lambda _, v: without(v, kind.valueType, names))


def sanitized(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows without columns, fields and map keys of those names."""
    gone = frozenset(names)
    kept = pruned(rows.schema, gone)
    return rows.select(*(without(F.col(f"`{f.name}`"), f.dataType, gone).alias(f.name) for f in rows.schema.fields if kept and f.name in kept.names))


def preferred(first: Column, other: Column, kind: DataType) -> Column:
    """first, but other where first is null, blank, or an empty array or map."""
    empty = F.trim(first) == "" if isinstance(kind, StringType) else F.size(first) == 0 if isinstance(kind, (ArrayType, MapType)) else F.lit(False)
    return F.when(first.isNull() | empty, other).otherwise(first)


def overlaid(over: Column, over_kind: StructType, under: Column, under_kind: StructType) -> Column:
    """One struct laid over another: its fields where it has them (a null is a field that isn't there), then those of the
    struct below, in whose order they stand; fields are taken whole. A null struct has no fields."""
    names = [*under_kind.names, *(n for n in over_kind.names if n not in under_kind.names)]
    field = lambda n: F.coalesce(*(c.getField(n) for c, k in ((over, over_kind), (under, under_kind)) if n in k.names))
    return F.struct(*(field(n).alias(n) for n in names))


def merged(rows: DataFrame, over: str, under: str, prefer: tuple[str, ...] = (), overlay: tuple[str, ...] = (), unite: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a record in struct column `under` with another, `over`, laid over it. keep: fields of under alone; prefer:
    over's where it isn't empty; overlay: structs, field by field; unite: arrays, under's elements first, without repeats."""
    a, b = rows.schema[over].dataType, rows.schema[under].dataType
    out = [F.col(under).getField(n).alias(n) for n in keep]
    out += [preferred(F.col(over).getField(n), F.col(under).getField(n), a[n].dataType).alias(n) for n in prefer]
    out += [overlaid(F.col(over).getField(n), a[n].dataType, F.col(under).getField(n), b[n].dataType).alias(n) for n in overlay]
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return out + [F.array_distinct(F.concat(listed(F.col(under).getField(n)), listed(F.col(over).getField(n)))).alias(n) for n in unite]
