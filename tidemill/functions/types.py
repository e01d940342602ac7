"""The data model's types and schema rules."""

from __future__ import annotations

from pyspark.sql import types as T

#: An unsigned 64-bit integer.
UINT64 = T.DecimalType(20, 0)
UINT64_MAX = 2**64 - 1

#: The weight of a row in a change, and the place of an event in it.
DIFF, ORD = "__diff", "__ord"
RESERVED = "__"

#: Bounds of a schema: fields, bytes of identity text, nesting.
MAX_FIELDS, MAX_TEXT, MAX_DEPTH = 16_384, 8 << 20, 60


class SchemaError(ValueError):
    """A schema is outside the data model."""


_FLAT = (T.NullType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def validate_schema(schema: T.StructType) -> T.StructType:
    """schema, if it is of the model: flat types, arrays and structs of them, unique names outside
    the reserved prefix, within the bounds."""
    seen = [0, 0]

    def check(t: T.DataType, depth: int, where: str) -> None:
        if depth > MAX_DEPTH:
            raise SchemaError(f"{where}: nested deeper than {MAX_DEPTH}")
        if isinstance(t, T.StructType):
            if len(set(t.names)) != len(t.names):
                raise SchemaError(f"{where}: repeated names")
            for f in t.fields:
                seen[0] += 1
                seen[1] += len(f.name.encode())
                if f.name.startswith(RESERVED):
                    raise SchemaError(f"{f.name}: names that begin with {RESERVED} are reserved")
                check(f.dataType, depth + 1, f.name)
        elif isinstance(t, T.ArrayType):
            check(t.elementType, depth + 1, where)
        elif isinstance(t, T.DecimalType) and not 0 <= t.scale <= t.precision <= 38:
            raise SchemaError(f"{where}: {t.simpleString()} is out of range")
        elif not isinstance(t, _FLAT):
            raise SchemaError(f"{where}: {t.simpleString()} is not supported")

    check(schema, 0, "schema")
    if seen[0] > MAX_FIELDS or seen[1] > MAX_TEXT:
        raise SchemaError("the schema is too large")
    return schema


def is_float(t: T.DataType) -> bool:
    """Whether t holds a float anywhere."""
    if isinstance(t, T.ArrayType):
        return is_float(t.elementType)
    if isinstance(t, T.StructType):
        return any(is_float(f.dataType) for f in t.fields)
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.StructType, T.MapType))


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or t == UINT64


def indexable(t: T.DataType) -> bool:
    """Whether t may be a join key, an ASOF order, or an argument of MIN and MAX: flat, not float."""
    return not is_nested(t) and not is_float(t)


#: PostgreSQL column types of a capture.
POSTGRES = {
    "bool": T.BooleanType(), "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "float4": T.FloatType(), "float8": T.DoubleType(), "text": T.StringType(),
    "varchar": T.StringType(), "bytea": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
}
#: MySQL column types of a capture; unsigned and zerofill are not supported.
MYSQL = {
    "tinyint": T.ShortType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "char": T.StringType(), "varchar": T.StringType(),
    "text": T.StringType(), "binary": T.BinaryType(), "blob": T.BinaryType(),
}
#: Column types of tables that sinks create.
SQLITE = {T.BooleanType: "INTEGER", T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.FloatType: "REAL", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB", T.DateType: "TEXT", T.TimestampType: "TEXT", T.TimestampNTZType: "TEXT", T.DecimalType: "TEXT"}


def native(name: str, table: dict[str, T.DataType]) -> T.DataType:
    """The type of a database column type like 'numeric(10,2)' or 'int8'."""
    base, _, args = name.lower().strip().partition("(")
    base = base.strip()
    if base in ("numeric", "decimal"):
        if not args:
            raise SchemaError(f"{name} needs a precision")
        p, _, s = args.rstrip(")").partition(",")
        return T.DecimalType(int(p), int(s or 0))
    if base not in table:
        raise SchemaError(f"column type {name} is not supported")
    return table[base]
