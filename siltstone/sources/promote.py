"""One schema for tables whose columns came and widened over time, and columns cast to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks a field whose values were all null when it was written, so that any type may take its place.
UNTYPED = "siltstone.untyped"
#: Widening numbers: whole numbers into wider ones, any into the fractions after them.
_NUMBERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


class SchemaConflict(TypeError):
    """Two batches have a column under types that neither widens to the other."""


def storable(df: DataFrame) -> DataFrame:
    """df with columns of no type (and lists of such) under a type that a file can hold, marked as untyped."""
    out = []
    for f in df.schema.fields:
        typed = _stand_in(f.dataType)
        kept = F.col(f"`{f.name}`")
        out.append(kept if typed == f.dataType else kept.cast(typed).alias(f.name, metadata={UNTYPED: f.dataType.simpleString()}))
    return df.select(*out)


def _stand_in(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.NullType):
        return T.BooleanType()
    return T.ArrayType(_stand_in(kind.elementType), kind.containsNull) if isinstance(kind, T.ArrayType) else kind


def as_written(schema: T.StructType) -> T.StructType:
    """A schema read from a file, with fields that storable marked under no type again."""
    return T.StructType([T.StructField(f.name, _bare(f.dataType) if UNTYPED in (f.metadata or {}) else f.dataType, True) for f in schema.fields])


def _bare(kind: T.DataType) -> T.DataType:
    return T.ArrayType(_bare(kind.elementType), True) if isinstance(kind, T.ArrayType) else T.NullType()


def widened(a: T.DataType, b: T.DataType, at: str = "") -> T.DataType:
    """The type that values of both fit into: no type gives way to any, numbers and dates widen, lists, maps and structs do part by part."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return unified([a, b], f"{at}.")
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widened(a.elementType, b.elementType, f"{at}[]"), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, widened(a.valueType, b.valueType, f"{at}{{}}"), True)
    for order in (_NUMBERS, [T.DateType, T.TimestampType]):
        if type(a) in order and type(b) in order:
            wider = max(type(a), type(b), key=order.index)
            whole = {T.IntegerType, T.LongType} & {type(a), type(b)}
            return T.DoubleType() if wider is T.FloatType and whole else wider()
    raise SchemaConflict(f"column {at.strip('.')} is {a.simpleString()} in one batch and {b.simpleString()} in another")


def unified(schemas: list[T.StructType], at: str = "") -> T.StructType:
    """All columns of all schemas, in the order in which they first come, each under the type that holds them all; all may be null."""
    found: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            found[f.name] = widened(found[f.name], f.dataType, at + f.name) if f.name in found else f.dataType
    return T.StructType([T.StructField(name, kind, True) for name, kind in found.items()])


def _cast(value: Column, a: T.DataType, b: T.DataType) -> Column:
    if a == b:
        return value
    if isinstance(a, T.NullType):
        return F.lit(None).cast(b)
    if isinstance(a, T.StructType):
        have = {f.name: f.dataType for f in a.fields}
        parts = [(_cast(value[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in b.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(a, T.ArrayType):
        return F.transform(value, lambda x: _cast(x, a.elementType, b.elementType))
    if isinstance(a, T.MapType):
        return F.transform_values(value, lambda _, x: _cast(x, a.valueType, b.valueType))
    return value.cast(b)


def promoted(df: DataFrame, own: T.StructType, wanted: T.StructType) -> DataFrame:
    """df under the wanted schema; columns that it lacks are null. own: the types of its columns, as as_written gives them."""
    have = {f.name: f.dataType for f in own.fields}
    return df.select(*[(_cast(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])
