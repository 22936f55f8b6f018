"""JSON values: one text for equal values, and what counts as a value at all.

The canonical text of a nested column has sorted keys, no space, and characters as they
are; it is built by the column's type, so equal values have equal texts whatever order
their keys came in, and a digest of it names the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .digest import PREFIX

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REALS = (T.FloatType, T.DoubleType)
#: The short escapes of JSON; other control characters are written as four hex digits.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(c: Column) -> Column:
    """A string as JSON."""
    plain = c
    for raw, escape in _ESCAPES.items():
        plain = F.replace(plain, F.lit(raw), F.lit(escape))
    full = plain
    for code in range(32):
        if chr(code) not in _ESCAPES:
            full = F.replace(full, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(F.regexp_like(plain, F.lit(r"[\x00-\x1F]")), full).otherwise(plain), F.lit('"'))


def real_text(c: Column) -> Column:
    """A finite double as JSON: plain from 1e-4 to below 1e16, else with a signed exponent of two digits or more."""
    text = c.cast("double").cast("string")
    part = lambda i: F.regexp_extract(text, r"\A(-?)(\d)\.(\d+)E(-?\d+)\z", i)
    sign, lead, fraction = part(1), part(2), F.when(part(3) == "0", "").otherwise(part(3))
    power = part(4).cast("int")
    digits = F.concat(lead, F.rpad(fraction, F.greatest(power, F.length(fraction)), F.lit("0")))
    whole = F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.when(F.length(fraction) > power, F.substring(digits, power + 2, F.length(digits))).otherwise("0"))
    small = F.concat(sign, F.lit("0.000"), lead, fraction)
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    wide = F.concat(sign, lead, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("e"), exponent)
    return F.when(~F.contains(text, F.lit("E")), text).when((power >= 0) & (power < 16), whole).when(power == -4, small).otherwise(wide)


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """The canonical text of a column of type ``kind``; null is ``null``.

    Strings, booleans, whole numbers, doubles, arrays, structs and maps with string keys;
    another type is an error. Doubles that are not finite have no text: the result is null.
    """
    if isinstance(kind, T.StringType):
        text = quoted(c)
    elif isinstance(kind, T.BooleanType) or isinstance(kind, _INTEGERS):
        text = c.cast("string")
    elif isinstance(kind, _REALS):
        text = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(real_text(c))
        return F.when(c.isNull(), "null").otherwise(text)
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: canonical_json(x, kind.elementType))
        text = _joined("[", items, "]")
    elif isinstance(kind, T.StructType):
        pairs = [F.concat(F.lit('"' + "".join(map(_escaped, f.name)) + '":'), canonical_json(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = _joined("{", F.array(*pairs), "}") if pairs else F.lit("{}")
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), canonical_json(e["value"], kind.valueType).alias("v")))
        text = _joined("{", F.transform(F.array_sort(entries), lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])), "}")
    else:
        raise TypeError(f"no JSON value: {kind.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(text)


def _escaped(ch: str) -> str:
    return _ESCAPES.get(ch) or (f"\\u{ord(ch):04x}" if ord(ch) < 32 else ch)


def _joined(opening: str, items: Column, closing: str) -> Column:
    """Null if an item has no text."""
    return F.when(F.forall(items, lambda x: x.isNotNull()), F.concat(F.lit(opening), F.array_join(items, ","), F.lit(closing)))


def value_digest(c: Column, kind: T.DataType) -> Column:
    """Digest of the canonical text; null where there is none."""
    return F.concat(F.lit(PREFIX), F.sha2(canonical_json(c, kind).cast("binary"), 256))


def json_fault(text: Column, deepest: int = 64) -> Column:
    """Why a text is no JSON value: not-json, not-finite (a number beyond doubles) or too-deep; null if it is one.

    Names that occur twice in an object are not JSON here.
    """
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    step = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), 0), lambda x: F.when(x.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(*(F.lit(0).alias(c) for c in ("now", "most", "least")))
    depth = F.aggregate(step, start, lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most"), F.least(a["least"], a["now"] + x).alias("least")))
    # The parser reads one value and no further: as the only item of an array, nothing can stand behind it.
    only = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    whole = F.coalesce((F.size(F.try_variant_get(only, "$", "array<variant>")) == 1) & (depth["least"] == 0), F.lit(False))
    numbers = F.regexp_extract_all(bare, F.lit(r"-?[0-9][0-9.]*(?:[eE][-+]?[0-9]+)?"), 0)
    finite = F.forall(numbers, lambda x: F.coalesce(F.abs(x.try_cast("double")) < float("inf"), F.lit(False)))
    # Depth first: a text nested without end is not handed to the parser.
    return F.when(text.isNull(), "not-json").when(depth["most"] > deepest, "too-deep").when(~whole, "not-json").when(~finite, "not-finite")


def is_json_value(c: Column, kind: T.DataType) -> Column:
    """Whether a typed column is a JSON value as it stands: finite numbers, string keys, no other types."""
    if isinstance(kind, (T.StringType, T.BooleanType, T.NullType)) or isinstance(kind, _INTEGERS):
        return F.lit(True)
    if isinstance(kind, _REALS):
        return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(True))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(c, lambda x: is_json_value(x, kind.elementType)), F.lit(True))
    if isinstance(kind, T.StructType):
        out = F.lit(True)
        for f in kind.fields:
            out = out & is_json_value(c[f.name], f.dataType)
        return out
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            return F.coalesce(F.size(c) == 0, F.lit(True))
        return F.coalesce(F.forall(F.map_values(c), lambda x: is_json_value(x, kind.valueType)), F.lit(True))
    return c.isNull()
