"""Load step for polynomials with a Groebner basis: other orders of monomials, and quotients beside the remainder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.loadprep import LoadStep
from ..functions.nested import INNER
from ..operators import algebra


def reduced(problem: str, answer: str, variables: list[str], order: str, quotients: bool) -> tuple[str, str]:
    """The pair in another form: `f | g1 | g2 ...` with a remainder.

    In lex order the basis is computed anew, and with it the remainder. Quotients q1, q2 ... come before the remainder: f less the remainder is the
    sum of the products q g; all are 0 if there are none, as for generators that are no basis.
    """
    f, *basis = (algebra.parse(t, variables) for t in problem.split(INNER))
    rest = algebra.parse(answer, variables)
    if order == "lex":
        basis = algebra.groebner(basis, "lex")
        rest = algebra.divide(f, basis, "lex")[1]
    show = lambda p: algebra.show(p, variables, order)
    parts = []
    if quotients:
        parts, left = algebra.divide(algebra.plus(f, rest, -1), basis, order)
        parts = [{} for _ in basis] if left else parts
    return INNER.join(map(show, [f, *basis])), INNER.join(map(show, [*parts, rest]))


def reduction_step(variables: list[str], order: str = "grevlex", quotients: bool = False) -> LoadStep:
    """`reduced` for every row; rows keep their other columns."""
    if order not in algebra.ORDERS:
        raise ValueError(f"unknown order {order}; known are {', '.join(algebra.ORDERS)}")

    @F.pandas_udf("struct<problem:string,answer:string>")
    def change(problem: pd.Series, answer: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reduced(p, a, variables, order, quotients) for p, a in zip(problem, answer)], columns=["problem", "answer"])

    def step(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_pair", change("problem", "answer"))
        return rows.withColumns({"problem": F.col("_pair.problem"), "answer": F.col("_pair.answer")}).drop("_pair")

    return step
