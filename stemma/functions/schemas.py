"""Schemas from text, without a session."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType, "timestamp": T.TimestampType, "date": T.DateType}


def _parts(text: str) -> list[str]:
    """Split at commas outside angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out if p.strip()]


def _type(text: str) -> T.DataType:
    text = text.strip()
    if text in _SIMPLE:
        return _SIMPLE[text]()
    name, _, rest = text.partition("<")
    inner = rest.rstrip()[:-1]
    if name == "array":
        return T.ArrayType(_type(inner))
    if name == "map":
        return T.MapType(*(_type(p) for p in _parts(inner)))
    if name == "struct":
        return T.StructType([T.StructField(n.strip().strip("`"), _type(t)) for n, t in (p.split(":", 1) for p in _parts(inner))])
    raise ValueError(f"unknown type {text!r}")


def schema(text: str) -> T.StructType:
    """``name type, ...`` as a schema of nullable fields."""
    return T.StructType([T.StructField(n.strip("`"), _type(t)) for n, t in (p.split(None, 1) for p in _parts(text))])
