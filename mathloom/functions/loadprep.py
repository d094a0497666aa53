"""Transformations of problem and answer texts after a scan, as functions of columns or frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

LoadStep = Callable[[DataFrame], DataFrame]


def pieces(c: Column, delimiter: str) -> Column:
    """Stripped parts between delimiters, without blank ones."""
    return F.filter(F.transform(F.split(c, _literal(delimiter)), strip), lambda x: x != "")


def _literal(text: str) -> str:
    return "".join("\\" + x if x in r"\.[]{}()*+-?^$|/" else x for x in text)


def last_element(c: Column, delimiter: str = "|") -> Column:
    """The last piece; the text itself if there is none."""
    return F.coalesce(F.try_element_at(pieces(c, delimiter), F.lit(-1)), c)


def reversed_order(c: Column, delimiter: str = "|") -> Column:
    """The pieces in reverse, joined as the nested form joins them."""
    return F.array_join(F.reverse(pieces(c, delimiter)), f" {delimiter.strip()} ")


def expanded_form(terms: Column) -> Column:
    """Terms (exps ARRAY<INT>, coeff) as `C<coeff> E<e> E<e> ...` joined by plus signs; `C0` for none.

    Coefficients must be integral.
    """
    whole = lambda x: F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(F.raise_error(F.lit("a coefficient isn't integral")))
    term = lambda t: F.concat(F.lit("C"), whole(t["coeff"]), F.array_join(F.transform(t["exps"], lambda e: F.concat(F.lit(" E"), e.cast("string"))), ""))
    return F.when(F.size(terms) == 0, F.lit("C0")).otherwise(F.array_join(F.transform(terms, term), " + "))


def on_both(change: Callable[[Column], Column]) -> LoadStep:
    """The same change of problem and answer."""
    return lambda df: df.withColumns({c: change(df[c]) for c in ("problem", "answer")})


def on_answer(change: Callable[[Column], Column]) -> LoadStep:
    return lambda df: df.withColumn("answer", change(df["answer"]))


def chain(*steps: LoadStep) -> LoadStep:
    """Steps one after the other; the result must still have problem and answer."""
    if not steps:
        raise ValueError("a chain needs a step")

    def run(df: DataFrame) -> DataFrame:
        out = reduce(lambda d, step: d.transform(step), steps, df)
        if not {"problem", "answer"} <= set(out.columns):
            raise ValueError("the last step must yield problem and answer")
        return out

    return run
