"""Canonical JSON text and digests of it: keys sorted at all depths, no white space, controls escaped, no NaN.

``json_of`` writes a column of any nesting of structs, maps, arrays, texts,
numbers, booleans and nulls; it follows the column's type, so the whole text
is one expression inside the JVM. ``json_text`` takes JSON texts whose keys and
nesting aren't known beforehand. Both give what Python's ``json.dumps`` gives
with sorted keys and without white space, either keeping characters beyond
ASCII or escaping them.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.binding import let

# Workers get this module's functions with their task: they needn't have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The controls that JSON has short names for.
NAMED = {"\n": "n", "\r": "r", "\t": "t", "\b": "b", "\f": "f"}
#: Decimal exponents from and below which a float is written without one.
PLAIN_FROM, PLAIN_BELOW = -4, 16


def quoted(c: Column) -> Column:
    """A JSON string; characters other than controls (below U+0020), quote and backslash stay as they are."""
    body = F.regexp_replace(c, r'(["\\])', r"\\$1")
    for char, name in NAMED.items():
        body = F.replace(body, F.lit(char), F.lit("\\" + name))
    # What is left of controls stands alone among runs of other characters.
    runs = F.regexp_extract_all(body, F.lit(r"[^\x00-\x1F]+|[\x00-\x1F]"), F.lit(0))
    rare = F.array_join(F.transform(runs, lambda x: F.when(x < " ", F.concat(F.lit("\\u00"), F.lower(F.hex(x)))).otherwise(x)), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), rare).otherwise(body), F.lit('"'))


def quoted_ascii(c: Column) -> Column:
    """A JSON string of ASCII characters only: others are escaped by their UTF-16 units, as controls are."""
    def ascii(body: Column) -> Column:
        runs = F.regexp_extract_all(body, F.lit(r"[\x20-\x7E]+|[^\x20-\x7E]+"), F.lit(0))
        units = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
        escaped = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^[\x20-\x7E]"), x).otherwise(units(x))), "")
        return F.when(body.rlike(r"[^\x20-\x7E]"), escaped).otherwise(body)

    return let(quoted(c), ascii)


def _shortest(size: Column) -> Column:
    """The shortest digits of a positive double, and where their point is (before which digit), as a struct.

    They are those that Java writes; as Java 17 at times writes more than it
    takes, of its digits rounded to 15 places and more (to 1 and more for
    numbers too small for full precision) the first is taken that reads back
    as the same number.
    """
    parts = F.split(size.cast("string"), "E")
    places = F.split(parts[0], r"\.")
    digits = F.concat(places[0], places[1])
    lead = F.regexp_replace(digits, "^0+", "")
    point = F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0)) + F.length(places[0]) - (F.length(digits) - F.length(lead))

    def candidates(x: Column) -> Column:
        n = F.length(x["digits"])

        def rounded(k: Column) -> Column:
            unit = F.rpad(F.lit("1"), n - k + 1, F.lit("0")).cast("long")
            half = F.when(k < n, F.call_function("div", unit, F.lit(2))).otherwise(F.lit(0))
            v = F.call_function("div", x["digits"].cast("long") + half, unit).cast("string")
            return F.struct(v.alias("digits"), (x["point"] - k + F.length(v)).alias("point"), (x["point"] - k).alias("power"))

        first = F.when(size < 2.3e-308, F.lit(1)).otherwise(F.least(n, F.lit(15)))
        return F.filter(F.transform(F.sequence(first, n), rounded), lambda y: F.concat(y["digits"], F.lit("E"), y["power"].cast("string")).cast("double") == size)

    given = F.struct(F.regexp_replace(lead, "0+$", "").alias("digits"), point.alias("point"))
    best = F.element_at(let(given, candidates), 1)
    return let(best, lambda x: F.struct(F.regexp_replace(x["digits"], "0+$", "").alias("digits"), x["point"].alias("point")))


def float_text(c: Column) -> Column:
    """A double as JSON: its shortest digits, without an exponent from 1e-4 to below 1e16. NaN and infinities are errors."""
    c = c.cast("double")
    size = F.abs(c)

    def written(x: Column) -> Column:
        digits, point = x["digits"], x["point"]
        n, exponent = F.length(digits), point - 1
        zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)))
        small = F.concat(F.lit("0."), zeros(-point), digits)
        whole = F.concat(digits, zeros(point - n), F.lit(".0"))
        mixed = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))
        plain = F.when(point <= 0, small).when(point >= n, whole).otherwise(mixed)
        mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n)))
        power = F.abs(exponent).cast("string")
        scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
        return F.when(exponent.between(PLAIN_FROM, PLAIN_BELOW - 1), plain).otherwise(scientific)

    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    bad = F.isnan(c) | (size == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a number that JSON doesn't have"))).when(c == 0, F.concat(sign, F.lit("0.0"))).when(c.isNotNull(), F.concat(sign, let(_shortest(size), written)))


def json_of(c: Column, kind: T.DataType, ascii: bool = False) -> Column:
    """The canonical JSON text of a column of type ``kind``; null is ``null``.

    Keys of structs are sorted when the plan is made, keys of maps (texts) row
    by row, both by code points. Dates, times and binary values are errors: the
    caller says how they are written.
    """
    text = quoted_ascii if ascii else quoted
    null = F.lit("null")
    if isinstance(kind, T.StringType):
        return F.coalesce(text(c), null)
    if isinstance(kind, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        return F.coalesce(c.cast("string"), null)
    if isinstance(kind, T.DoubleType):
        return F.coalesce(float_text(c), null)
    if isinstance(kind, T.NullType):
        return null
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: json_of(x, kind.elementType, ascii))
        return F.coalesce(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), null)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(text(k), F.lit(":"), json_of(F.element_at(c, k), kind.valueType, ascii)))
        return F.coalesce(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")), null)
    if isinstance(kind, T.StructType):
        parts = []
        for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name)):
            parts += [F.lit(("," if i else "") + json.dumps(f.name, ensure_ascii=ascii) + ":"), json_of(c[f.name], f.dataType, ascii)]
        return F.when(c.isNull(), null).otherwise(F.concat(F.lit("{"), *parts, F.lit("}")))
    raise TypeError(f"no canonical JSON for {kind.simpleString()}")


def _no_constant(name: str):
    raise ValueError(f"a number that JSON doesn't have: {name}")


def canonical(text: str, ascii: bool = False) -> str:
    """The canonical form of one JSON text; of a key that repeats, the last value counts. NaN and infinities are errors."""
    return json.dumps(json.loads(text, parse_constant=_no_constant), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii, allow_nan=False)


#: Rows of a batch whose texts are Python objects at a time.
SLICE = 100
#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def converted(texts: pa.Array, ascii: bool = False) -> pa.Array:
    """``canonical`` of each text, a few at a time as Python objects."""
    made = [pa.array([None if x is None else canonical(x, ascii) for x in texts.slice(i, SLICE).to_pylist()], pa.string()) for i in range(0, len(texts), SLICE)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def json_text(c: Column, ascii: bool = False) -> Column:
    """The canonical form of JSON texts with any keys and nesting, in Arrow batches: null stays null, what isn't JSON is an error."""

    # Session settings that Spark reads when the plan runs, so they stay set.
    conf = SparkSession.active().conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield converted(b, ascii)

    return convert(c)


def canonical_object(fields: dict[str, Column], raw: set[str] = frozenset(), numbers: set[str] = frozenset({"size_bytes", "revision", "step", "position", "epoch"})) -> Column:
    """A JSON object with sorted keys and no white space; nulls are kept. Fields in ``raw`` are JSON already, those in ``numbers`` whole numbers."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        c = fields[name]
        value = c if name in raw else c.cast("string") if name in numbers else quoted(c)
        parts += [F.lit(("," if i else "{") + f'"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
