"""Table schemas from short texts, without a running session: workers import these too."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "strings": T.ArrayType(T.StringType())}


def columns(text: str, **more: T.DataType) -> T.StructType:
    """'name kind, ...' as a schema; kinds are those above or given by name in more."""
    kinds = {**_KINDS, **more}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(","))])
