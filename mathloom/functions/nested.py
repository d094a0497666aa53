"""Values that are a string, a list of strings or a list of lists, as a struct of `kind` and `cells`.

kind is scalar, flat or nested; cells is always ARRAY<ARRAY<STRING>>: one cell, one row or all rows. In a list that mixes
strings and lists a string is a row of one cell.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INNER, OUTER = " | ", " || "
TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType())))])


def scalar(c: Column) -> Column:
    return F.struct(F.lit("scalar").alias("kind"), F.array(F.array(c.cast("string"))).alias("cells"))


def flat(c: Column) -> Column:
    """An array of anything castable to strings."""
    return F.struct(F.lit("flat").alias("kind"), F.array(F.transform(c, lambda x: x.cast("string"))).alias("cells"))


def nested(c: Column) -> Column:
    """An array of arrays."""
    return F.struct(F.lit("nested").alias("kind"), F.transform(c, lambda row: F.transform(row, lambda x: x.cast("string"))).alias("cells"))


def to_text(v: Column) -> Column:
    """Inner lists joined by a bar, outer lists by two; lossy."""
    rows = F.transform(v["cells"], lambda row: F.array_join(row, INNER))
    return F.when(v["kind"] == "nested", F.array_join(rows, OUTER)).otherwise(F.coalesce(F.get(rows, F.lit(0)), F.lit("")))


def to_words(v: Column) -> Column:
    """All leaves joined by single blanks."""
    return F.array_join(F.flatten(v["cells"]), " ")


def to_json(v: Column) -> Column:
    first = F.get(v["cells"], F.lit(0))
    quoted = F.to_json(F.array(F.get(first, F.lit(0))))
    return F.when(v["kind"] == "scalar", quoted.substr(F.lit(2), F.length(quoted) - 2)).when(v["kind"] == "flat", F.to_json(F.coalesce(first, F.array().cast("array<string>")))).otherwise(F.to_json(v["cells"]))


def from_variant(c: Column) -> Column:
    """A parsed JSON value; anything that isn't a list is one cell. Lists of more than two levels are rejected."""
    text = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))
    rows = F.try_variant_get(c, "$", "array<variant>")
    is_list = lambda x: F.schema_of_variant(x).startswith("ARRAY")
    row = lambda x: F.when(is_list(x), F.transform(F.variant_get(x, "$", "array<variant>"), lambda y: F.when(is_list(y), F.raise_error(F.lit("more than two levels of lists"))).otherwise(text(y)))).otherwise(F.array(text(x)))
    deep = F.exists(rows, is_list)
    return (
        F.when(c.isNull(), F.lit(None))
        .when(~is_list(c), F.struct(F.lit("scalar").alias("kind"), F.array(F.array(text(c))).alias("cells")))
        .when(deep, F.struct(F.lit("nested").alias("kind"), F.transform(rows, row).alias("cells")))
        .otherwise(F.struct(F.lit("flat").alias("kind"), F.array(F.transform(rows, text)).alias("cells")))
    )


def of_python(x: Any) -> tuple[str, list[list[str]]]:
    """The struct's fields for a Python value; deeper lists and other leaves than strings and numbers are errors."""
    if not isinstance(x, list):
        return "scalar", [[_leaf(x)]]
    if any(isinstance(row, list) for row in x):
        return "nested", [[_leaf(y) for y in row] if isinstance(row, list) else [_leaf(row)] for row in x]
    return "flat", [[_leaf(y) for y in x]]


def _leaf(x: Any) -> str:
    if isinstance(x, (list, tuple, dict)):
        raise ValueError("a value may be a string, a list of strings or a list of lists of strings")
    return str(x)


def polynomial_text(c: Column) -> Column:
    """Text of a polynomial without its modulus, with ^ for powers."""
    return F.replace(F.regexp_replace(c, r" mod \d+", ""), F.lit("**"), F.lit("^"))
