"""Random numbers as columns, from a counter instead of a state: a number is the SHA-256 of a seed and of what it is drawn for.

The same seed and purpose give the same number in every row order and partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make a number; with 60 bits the bias of a remainder is at most its divisor / 2^60.
_DIGITS = 15


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What a function makes of a value that is computed once, however often the function mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _text(x: Column | str | int) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def bits(seed: Column, *purpose: Column | str | int) -> Column:
    """A whole number of 60 bits."""
    digest = F.sha2(F.concat_ws(":", seed, *map(_text, purpose)), 256)
    return F.conv(digest.substr(1, _DIGITS), 16, 10).cast("long")


def below(n: Column | int, seed: Column, *purpose: Column | str | int) -> Column:
    """Uniform from 0 to n - 1."""
    return F.pmod(bits(seed, *purpose), n if isinstance(n, Column) else F.lit(n))


def unit(seed: Column, *purpose: Column | str | int) -> Column:
    """Uniform in [0, 1), a multiple of 2^-52."""
    return F.shiftright(bits(seed, *purpose), 8).cast("double") * 2.0**-52


def signed(most: int, seed: Column, *purpose: Column | str | int) -> Column:
    """A whole number from -most to most but 0: a coin for the sign, then the size."""
    size = below(most, seed, *purpose, "size") + 1
    return F.when(below(2, seed, *purpose, "sign") == 0, F.lit(-1)).otherwise(F.lit(1)) * size


def chosen(items: Column, count: Column, seed: Column, *purpose: Column | str | int) -> Column:
    """`count` of the items (longs) without repeats: those with the smallest digests of themselves, in that order."""
    ranked = F.array_sort(F.transform(items, lambda x: F.struct(bits(seed, *purpose, x).alias("by"), x.alias("item"))))
    return F.transform(F.slice(ranked, F.lit(1), count), lambda r: r["item"])
