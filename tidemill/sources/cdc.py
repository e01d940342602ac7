"""Change data capture: Debezium envelopes as changes.

A row of `value` is an envelope, with or without its schema part. r (while a snapshot is taken) and c
give +1 after; u gives -1 before, then +1 after; d gives -1 before. Anything else is an error, as are
envelopes whose columns or nulls don't fit the declared schema, and lines that are no envelopes.
Heartbeats (a payload with ts_ms and no op) and notifications of the snapshot are checked and give no
rows; tombstones (no value, or null) are passed over where the source has them.

With a schema part, its columns must be the declared ones (names, types, nulls, decimal parameters, in
order), and values are on the wire as Kafka Connect has them: dates are days, timestamps without a zone
microseconds, those with one ISO strings, decimals base64 of their unscaled bytes. Without a schema
part values are JSON as Spark reads it. Decoding is built-in functions only.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.changes import q
from ..functions.types import DIFF, ORD, validate_schema

# Fixed values of the wire format: Connect's types, a snapshot's notifications and markers.
LITERALS = {
    T.BooleanType: ("boolean", None), T.ShortType: ("int16", None), T.IntegerType: ("int32", None), T.LongType: ("int64", None), T.FloatType: ("float", None),
    T.DoubleType: ("double", None), T.StringType: ("string", None), T.BinaryType: ("bytes", None), T.DateType: ("int32", "io.debezium.time.Date"),
    T.TimestampNTZType: ("int64", "io.debezium.time.MicroTimestamp"), T.TimestampType: ("string", "io.debezium.time.ZonedTimestamp"),
    T.DecimalType: ("bytes", "org.apache.kafka.connect.data.Decimal"),
}
SNAPSHOT, DONE, GOING = "Initial Snapshot", "COMPLETED", ("STARTED", "IN_PROGRESS", "TABLE_SCAN_COMPLETED")
MARKERS = ("true", "first", "first_in_data_collection", "last_in_data_collection", "last")

_COLUMN = "struct<field:string,type:string,optional:boolean,name:string,scale:string,precision:string>"
_SCHEMA = "type string, fields array<struct<field:string,type:string,optional:boolean,fields:array<struct<field:string,type:string,optional:boolean,name:string,parameters:map<string,string>>>>>"
_PAYLOAD = "struct<before:string,after:string,op:string,ts_ms:string,source:struct<snapshot:string>,aggregate_type:string,type:string>"


def _error(text: str, t: str) -> Column:
    return F.raise_error(F.lit(text)).cast(t)


def payload(value: str) -> Column:
    """The payload of an envelope, with or without its schema part."""
    return F.from_json(F.coalesce(F.get_json_object(value, "$.payload"), F.col(value)), _PAYLOAD)


def connect_schema(schema: T.StructType) -> list[dict]:
    """The columns of a row image as Connect describes them."""
    out = []
    for f in schema:
        if type(f.dataType) not in LITERALS:
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} is not on the wire")
        literal, logical = LITERALS[type(f.dataType)]
        d = {"field": f.name, "type": literal, "optional": f.nullable} | ({"name": logical} if logical else {})
        if isinstance(f.dataType, T.DecimalType):
            d["parameters"] = {"scale": str(f.dataType.scale), "connect.decimal.precision": str(f.dataType.precision)}
        out.append(d)
    return out


def _drift(p: Column, schema: T.StructType) -> Column:
    """Whether an envelope's schema part (read as _SCHEMA) isn't the one that the declared columns give."""
    null = lambda x: F.lit(x).cast("string")
    want = F.array(*(
        F.struct(F.lit(c["field"]).alias("field"), F.lit(c["type"]).alias("type"), F.lit(c["optional"]).alias("optional"), null(c.get("name")).alias("name"),
                 null(c.get("parameters", {}).get("scale")).alias("scale"), null(c.get("parameters", {}).get("connect.decimal.precision")).alias("precision"))
        for c in connect_schema(schema)
    )).cast(f"array<{_COLUMN}>")
    decimal = lambda x, key: F.when(x["name"] == LITERALS[T.DecimalType][1], x["parameters"][key])
    flat = lambda cs: F.transform(cs, lambda x: F.struct(x["field"].alias("field"), x["type"].alias("type"), x["optional"].alias("optional"), x["name"].alias("name"), decimal(x, "scale").alias("scale"), decimal(x, "connect.decimal.precision").alias("precision"))).cast(f"array<{_COLUMN}>")
    # each side stands once, and as declared
    sides = F.transform(F.filter(p["fields"], lambda x: x["field"].isin("before", "after")), lambda x: F.when((x["type"] == "struct") & x["optional"] & flat(x["fields"]).eqNullSafe(want), x["field"]))
    return ~F.coalesce((p["type"] == "struct") & F.array_sort(sides).eqNullSafe(F.array(F.lit("after"), F.lit("before"))), F.lit(False))


def _on_wire(t: T.DataType) -> T.DataType:
    return {T.DateType: T.IntegerType(), T.TimestampNTZType: T.LongType(), T.TimestampType: T.StringType(), T.DecimalType: T.StringType()}.get(type(t), t)


def _digits(text: Column) -> Column:
    """The hexadecimal digits of base64; none for no bytes."""
    return F.when(F.length(text) > 0, F.hex(F.unbase64(text)))


def _size(digits: Column) -> Column:
    """The digits of a number, of a negative one those of its complement, which is its distance from -1."""
    return F.when(digits >= "8", F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(digits)


def _unscaled(digits: Column, size: Column, t: T.DecimalType) -> Column:
    """A decimal from its unscaled value: the digits of two's complement, highest first, and their _size().
    Either is a column, as both are used often."""
    part = lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")  # noqa: E731  of 16 digits at most
    head, high = F.substring(size, F.lit(1), F.length(size) - 32), F.right(F.lpad(F.substring(size, F.lit(1), F.length(size) - 16), 64, "0"), F.lit(16))
    wide = F.when(F.ltrim(head, F.lit("0")) != "", _error("a decimal has more than 38 digits", "decimal(38,0)")).otherwise(part(high) * F.lit(str(2**64)).cast("decimal(20,0)") + part(F.right(size, F.lit(16))))
    whole = F.when(F.length(size) <= 16, part(size)).otherwise(wide).cast("decimal(38,0)") + F.when(digits >= "8", 1).otherwise(0)
    # the sign and the scale are put in as text: negation and division of decimals lose digits
    n = F.lpad(whole.cast("decimal(38,0)").cast("string"), 39, "0")
    text = F.concat(F.when(digits >= "8", "-").otherwise(""), F.overlay(n, F.lit("."), F.lit(40 - t.scale), F.lit(0)))
    return F.when(digits.isNotNull(), text.cast(t))


def _value(c: Column, t: T.DataType) -> Column:
    """A column's value from the wire, but for decimals."""
    if isinstance(t, T.DateType):
        return F.date_from_unix_date(c)
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", c, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    return c.cast(t)


def _usual(df: DataFrame, value: Column, schema: T.StructType) -> str | None:
    """How lines begin, up to their payload, if the first of them has a schema part that fits: the same
    text is known to fit in other lines, which needn't parse it. It is most of a line."""
    line = df.filter(value.isNotNull()).select(value).first()
    opening = re.match(r'\s*\{\s*"schema"\s*:\s*', line[0]) if line else None
    if opening is None:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(line[0], opening.end())
    except ValueError:  # decoding will say so
        return None
    comma = re.compile(r"\s*,").match(line[0], end)
    part = F.lit(line[0][opening.end() : end])
    if comma is None or df.sparkSession.range(1).select(F.from_json(part, _SCHEMA).alias("p")).select(_drift(F.col("p"), schema)).first()[0]:
        return None
    return line[0][: comma.end()]


def decoded(df: DataFrame, schema: T.StructType, value: str = "value", order: list[str] | None = None, snapshot: bool | None = None, tombstones: bool = True) -> DataFrame:
    """The change in a DataFrame of envelopes: schema's columns, __diff, __ord.

    order: columns that give the events' order (by default the payload's ts_ms is no order: events
    are numbered as they stand). snapshot: whether r is expected; None allows both phases. tombstones:
    whether rows without a value may stand between events.

    A line, its payload and each of its row images are parsed once, its schema part only if it isn't the
    first line's (one row of df is computed for that). For that they are
    columns of their own, which the optimizer leaves apart where they are used more than once, and
    lines without rows are dropped after the explode: a filter would be pushed below the parsing and
    repeat it, as would the filter that an inner explode puts below itself."""
    validate_schema(schema)
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    wire = T.StructType([T.StructField(f.name, _on_wire(f.dataType), True) for f in schema])
    at = F.struct(*(F.col(c) for c in order)) if order else F.monotonically_increasing_id()
    empty = F.col(value).isNull() | F.trim(value).isin("", "null")
    typed = all(type(f.dataType) in LITERALS for f in schema)
    usual = _usual(df, F.col(value), schema) if typed else None
    known, text = F.lit(False), F.col(value)
    if usual:
        known = F.coalesce(F.startswith(text, F.lit(usual)), F.lit(False))
        text = F.when(known, F.concat(F.lit("{"), F.substring(text, len(usual) + 1, 1 << 30))).otherwise(text)
    df = df.select(text.alias("__value"), known.alias("__usual"), at.alias("__at"), empty.alias("__empty"))
    df = df.select("*", F.when(F.col("__usual"), F.from_json("__value", f"payload {_PAYLOAD}")["payload"]).alias("whole"))
    df = df.select("*", F.when(F.col("whole").isNull(), F.from_json("__value", "schema string, payload string")).alias("line"))
    e = F.coalesce("whole", F.from_json(F.when(F.col("whole").isNull(), F.coalesce("line.payload", "__value")), _PAYLOAD))
    df = df.select(e.alias("e"), "line.schema", F.from_json(F.when(~F.col("__usual"), F.col("line.schema")), _SCHEMA).alias("p"), "__usual", "__at", "__empty")
    parted = F.col("__usual") | F.col("schema").isNotNull()
    drift = F.when(F.col("__usual") | F.col("schema").isNull(), F.lit(False)).otherwise(_drift(F.col("p"), schema) if typed else F.lit(True))
    df = df.select("e.*", drift.alias("__drift"), parted.alias("__parted"), "__at", "__empty")
    rowless, note = F.col("op").isNull() & F.col("before").isNull() & F.col("after").isNull(), F.col("aggregate_type").isNotNull()
    known = ~note & F.col("ts_ms").isNotNull() | (F.col("aggregate_type") == SNAPSHOT) & F.col("type").isin(DONE, *GOING)

    # row images: read with their columns checked, then as values
    names = F.sort_array(F.array(*(F.lit(f.name) for f in schema)))
    parse = lambda c, t, where: F.when(F.col(f"__fits_{c}") & where, F.from_json(c, t, {"mode": "FAILFAST"}))
    sides = ("before", "after")
    df = df.select("*", *(F.coalesce(F.sort_array(F.json_object_keys(c)) == names, F.lit(False)).alias(f"__fits_{c}") for c in sides))
    df = df.select("*", *(parse(c, loose, ~F.col("__parted")).alias(f"__plain_{c}") for c in sides), *(parse(c, wire, F.col("__parted") & ~F.col("__drift")).alias(f"__wire_{c}") for c in sides))

    decimals = [(c, i, f.name) for c in sides for i, f in enumerate(schema) if typed and isinstance(f.dataType, T.DecimalType)]
    df = df.select("*", *(_digits(F.col(f"__wire_{c}")[name]).alias(f"__digits_{c}{i}") for c, i, name in decimals))
    df = df.select("*", *(_size(F.col(f"__digits_{c}{i}")).alias(f"__size_{c}{i}") for c, i, _ in decimals))

    def wired(c: str) -> Column:
        of = lambda i, f: _unscaled(F.col(f"__digits_{c}{i}"), F.col(f"__size_{c}{i}"), f.dataType) if isinstance(f.dataType, T.DecimalType) else _value(F.col(f"__wire_{c}")[f.name], f.dataType)
        return F.struct(*(of(i, f).alias(f.name) for i, f in enumerate(schema))).cast(loose) if typed else F.lit(None).cast(loose)

    def image(c: str) -> Column:
        unfit = _error("a row image doesn't have the declared columns", loose.simpleString())
        read = F.when(~F.col(f"__fits_{c}"), unfit).when(~F.col("__parted"), F.col(f"__plain_{c}")).when(F.col("__drift"), _error("the table's schema has changed", loose.simpleString())).otherwise(wired(c))
        return F.when(F.col(c).isNotNull(), read)

    df = df.select("op", "before", "after", "source.snapshot", "__at", "__empty", rowless.alias("__rowless"), note.alias("__note"), F.coalesce(known, F.lit(False)).alias("__known"), *(image(c).alias(f"__{c}") for c in sides))
    before, after = F.col("__before"), F.col("__after")
    row_change = lambda image, n: F.struct(image.alias("row"), F.lit(n).cast("long").alias(DIFF), F.lit(0 if n < 0 else 1).alias("step"))
    kind = "array<struct<row:" + loose.simpleString() + f",{DIFF}:bigint,step:int>>"
    insert = F.array(row_change(after, 1))
    snap = insert if snapshot in (None, True) else _error("a snapshot row outside the snapshot", kind)
    marked = F.coalesce(F.col("snapshot"), F.when(F.col("op") == "r", "true").otherwise("false"))
    none = F.array().cast(kind)
    events = (
        F.when(F.col("__empty"), none if tombstones else _error("a tombstone where the source has none", kind))
        .when(F.col("__rowless") & F.col("__known"), none)
        .when(F.col("__rowless") & F.col("__note"), _error("the snapshot's notification is not of one that completes", kind))
        .when(F.col("__rowless"), _error("a line is no envelope, heartbeat or notification", kind))
        .when(~F.when(F.col("op") == "r", marked.isin(*MARKERS)).otherwise(marked == "false"), _error("the snapshot's marker is not of this phase", kind))
        .when((F.col("op") == "r") & F.col("before").isNull() & F.col("after").isNotNull(), snap)
        .when((F.col("op") == "c") & F.col("before").isNull() & F.col("after").isNotNull() & F.lit(snapshot is not True), insert)
        .when((F.col("op") == "u") & F.col("before").isNotNull() & F.col("after").isNotNull() & F.lit(snapshot is not True), F.array(row_change(before, -1), row_change(after, 1)))
        .when((F.col("op") == "d") & F.col("before").isNotNull() & F.col("after").isNull() & F.lit(snapshot is not True), F.array(row_change(before, -1)))
        .otherwise(_error("the envelope is not a row event of this phase", kind))
    )
    out = df.select(F.explode_outer(events).alias("x"), "__at").filter(F.col(f"x.{DIFF}").isNotNull())
    cols = []
    for f in schema:
        c = F.col(f"x.row.{q(f.name)}")
        cols.append((c if f.nullable else F.when(c.isNull(), _error(f"{f.name} is null", f.dataType.simpleString())).otherwise(c)).alias(f.name))
    return out.select(*cols, F.col(f"x.{DIFF}").alias(DIFF), F.struct("__at", F.col("x.step").alias("step")).alias(ORD))


def sealed(df: DataFrame, order: list[str], before: bool, value: str = "value") -> bool:
    """Whether a batch leaves its snapshot behind: by a row marked as the last, by the notification that
    it is complete, or by the first event that is none of its rows. A snapshot row after that is an
    error, as it is where the snapshot was over before. One aggregate over the batch."""
    at = F.struct(*(F.col(c) for c in order))
    e = df.filter(F.col(value).isNotNull()).select(payload(value).alias("e"), at.alias("at"))
    ends = F.col("e.op").isin("c", "u", "d") | (F.col("e.op") == "r") & (F.col("e.source.snapshot") == "last") | (F.col("e.aggregate_type") == SNAPSHOT) & (F.col("e.type") == DONE)
    got = e.agg(F.min(F.when(ends, F.col("at"))).alias("end"), F.max(F.when(F.col("e.op") == "r", F.col("at"))).alias("last")).select((F.col("last") > F.col("end")).alias("late"), F.col("end").isNotNull().alias("ended"), F.col("last").isNotNull().alias("any")).first()
    if got["late"] or before and got["any"]:
        raise ValueError("a snapshot row after the end of the snapshot")
    return before or got["ended"]


def _to_wire(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.DateType):
        return F.unix_date(c)
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c)
    if isinstance(t, T.DecimalType):  # of 18 digits at most
        return F.base64(F.unhex(F.lpad(F.hex((c * 10**t.scale).cast("long")), 16, "0")))
    return c


def envelopes(df: DataFrame, op: str = "c", schema: T.StructType | None = None) -> DataFrame:
    """Rows as envelopes of one kind, for replaying tables as captures; with schema, which gives the
    columns' nulls, with a schema part and values as on the wire."""
    image = F.struct(*(F.col(q(c)) if schema is None else _to_wire(F.col(q(c)), schema[c].dataType).alias(c) for c in df.columns))
    none = F.when(F.lit(False), image)
    body = F.struct((image if op == "d" else none).alias("before"), (none if op == "d" else image).alias("after"), F.lit(op).alias("op"))
    text = F.to_json(F.struct(body.alias("payload")), {"ignoreNullFields": "false"})
    if schema is not None:
        rows = [{"field": side, "type": "struct", "optional": True, "fields": connect_schema(schema)} for side in ("before", "after")]
        head = json.dumps({"type": "struct", "fields": rows})
        text = F.concat(F.lit('{"schema":' + head + ","), F.substring(text, 2, 1 << 30))
    return df.select(text.alias("value"))


def updates(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows and what they become, matched by a key, as u envelopes."""
    image = lambda df, name: df.select(F.col(q(key)).alias("__key"), F.struct(*(F.col(q(c)) for c in df.columns)).alias(name))
    both = image(before, "before").join(image(after, "after"), "__key")
    return both.select(F.to_json(F.struct(F.struct("before", "after", F.lit("u").alias("op")).alias("payload")), {"ignoreNullFields": "false"}).alias("value"))
