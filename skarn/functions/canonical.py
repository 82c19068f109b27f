"""JSON text byte for byte as Python writes it: keys sorted or as declared, shortest floats, escapes, indents.

Digests of labels and the targets of examples depend on every byte, so this is what they are made of. All
of it is Column expressions that follow the schema of the value.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once and named, so that it isn't repeated in the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def float_text(x: Column) -> Column:
    """A double as Python's repr() has it: the shortest digits, an exponent below 1e-4 and from 1e16 on."""
    parts = r"^-?(\d+)\.(\d+)(?:E(-?\d+))?$"

    def read(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, parts, i)
        return F.struct(F.startswith(text, F.lit("-")).alias("minus"), F.concat(part(1), part(2)).alias("padded"), (F.length(part(1)) + F.coalesce(part(3).try_cast("int"), F.lit(0))).alias("point"))

    def digits(p: Column) -> Column:
        """The number is 0.digits * 10^place."""
        bare = F.regexp_replace(p["padded"], "^0+", "")
        return F.struct(p["minus"].alias("minus"), F.regexp_replace(bare, "0+$", "").alias("told"), (p["point"] - F.length(p["padded"]) + F.length(bare)).alias("place"))

    def shortest(p: Column) -> Column:
        """Java may give a digit more than it takes: one less does if it reads back as the same number."""
        size = F.length(p["told"])
        cut = F.substr(p["told"], F.lit(1), size - 1).try_cast("bigint")
        up = F.when(F.substr(p["told"], size) >= "5", 1).otherwise(0)
        same = lambda c: F.when((size > 1) & (F.concat(c.cast("string"), F.lit("E"), (p["place"] - size + 1).cast("string")).try_cast("double") == F.abs(x)), c.cast("string"))
        fewer = _let(F.struct(cut.alias("c"), up.alias("u")), lambda v: F.coalesce(same(v["c"] + v["u"]), same(v["c"] + 1 - v["u"])))
        # A carry (99 to 100) moves the point.
        moved = lambda f: F.struct(p["minus"].alias("minus"), F.coalesce(F.regexp_replace(f, "0+$", ""), p["told"]).alias("d"), (p["place"] + F.when(F.length(f) > size - 1, 1).otherwise(0)).alias("place"))
        return _let(fewer, moved)

    def written(p: Column) -> Column:
        d, place, n = p["d"], p["place"], F.length(p["d"])
        zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)).cast("int"))
        plain = (
            F.when(place <= 0, F.concat(F.lit("0."), zeros(-place), d))
            .when(place >= n, F.concat(d, zeros(place - n), F.lit(".0")))
            .otherwise(F.concat(F.substr(d, F.lit(1), place), F.lit("."), F.substr(d, place + 1)))
        )
        shown = F.abs(place - 1).cast("string")
        scientific = F.concat(
            F.substr(d, F.lit(1), F.lit(1)),
            F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(F.lit("")),
            F.when(place < 1, F.lit("e-")).otherwise(F.lit("e+")),
            F.lpad(shown, F.greatest(F.length(shown), F.lit(2)), F.lit("0")),
        )
        number = F.when(d == "", F.lit("0.0")).when(place.between(-3, 16), plain).otherwise(scientific)
        return F.concat(F.when(p["minus"], F.lit("-")).otherwise(F.lit("")), number)

    # Java's text of up to 15 digits without an exponent is Python's, unless a zero ends it needlessly: two numbers
    # of so few digits are never one double. Only the rest is taken apart.
    simple = lambda t: (F.length(t) <= 16) & F.contains(t, F.lit(".")) & ~F.contains(t, F.lit("E")) & (~F.endswith(t, F.lit("0")) | F.endswith(t, F.lit(".0")))
    shown = x.cast("double").cast("string")
    odd = F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("Infinity")).when(x == float("-inf"), F.lit("-Infinity"))
    usual = x.cast("double").cast("string")
    for step in (read, digits, shortest, written):
        usual = _let(usual, step)
    return F.when(simple(shown), shown).otherwise(F.coalesce(odd, usual))


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def string_text(s: Column, ascii_only: bool) -> Column:
    """A quoted string; ascii_only writes whatever lies beyond ASCII as escapes of UTF-16 units."""
    out = s
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = r"[\x00-\x1f]" if not ascii_only else r"[^\x20-\x7e]"

    def escape(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high, low = F.lit(0xD800) + F.floor((code - 0x10000) / 1024), F.lit(0xDC00) + (code - 0x10000) % 1024
        return F.when(~c.rlike(rare), c).when(code < 0x10000, _unit(code)).otherwise(F.concat(_unit(high), _unit(low)))

    # Only a string with such characters is taken apart, into runs without them and each of them.
    runs = r"(?s)([^\x00-\x1f]+|.)" if not ascii_only else r"(?s)([\x20-\x7e]+|.)"
    apart = lambda o: F.array_join(F.transform(F.regexp_extract_all(o, F.lit(runs), F.lit(1)), escape), "")
    return F.concat(F.lit('"'), _let(out, lambda o: F.when(o.rlike(rare), apart(o)).otherwise(o)), F.lit('"'))


def python_json(value: Column, kind: T.DataType | str, indent: int | None = None, sort_keys: bool = False, ascii_only: bool = True, level: int = 0) -> Column:
    """value, of that type, as json.dumps(value, indent=indent, sort_keys=sort_keys, ensure_ascii=ascii_only) writes it; null is null.

    Types: structs, arrays, strings, booleans, whole numbers and doubles.
    """
    if isinstance(kind, str):
        kind = T._parse_datatype_string(kind)
    again = lambda c, k: python_json(c, k, indent, sort_keys, ascii_only, level + 1)
    gap = "" if indent is None else "\n" + " " * (indent * (level + 1))
    comma, end = ("," if indent is not None else ", ") + gap, "" if indent is None else "\n" + " " * (indent * level)
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name) if sort_keys else kind.fields
        parts: list[Column] = []
        for i, f in enumerate(fields):
            parts += [F.lit((comma if i else gap) + json.dumps(f.name, ensure_ascii=ascii_only) + ": "), again(value[f.name], f.dataType)]
        out = F.concat(F.lit("{"), *parts, F.lit(end + "}")) if fields else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        items = F.array_join(F.transform(value, lambda x: again(x, kind.elementType)), comma)
        out = F.when(F.size(value) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[" + gap), items, F.lit(end + "]")))
    elif isinstance(kind, T.StringType):
        out = string_text(value, ascii_only)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = float_text(value)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = value.cast("string")
    else:
        raise TypeError(f"no JSON form of {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)
