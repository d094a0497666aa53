"""Checks of datasets against a vocabulary or a grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexer import Lexer
from ..functions.text import strip
from ..functions.vocab import Vocab
from .expressions import is_formula


def unknown_tokens(df: DataFrame, tokens: str, vocab: Vocab) -> DataFrame:
    """Distinct tokens outside the vocabulary, sorted. The vocabulary comes from a configuration, so it is broadcast."""
    used = df.select(F.explode(tokens).alias("token")).distinct()
    return used.join(F.broadcast(vocab.frame(df.sparkSession).select("token")), "token", "left_anti").orderBy("token")


def check_tokens(df: DataFrame, lexer: Lexer, *columns: str) -> None:
    """Raises with the tokens (the first hundred) that aren't in the vocabulary."""
    lenient = Lexer(lexer.vocab, lexer.policy, False, lexer.base_reserved, lexer.unknown)
    both = F.concat(*(lenient.tokens(F.col(c)) for c in columns))
    found = [r[0] for r in unknown_tokens(df.select(both.alias("tokens")), "tokens", lexer.vocab).limit(100).collect()]
    if found:
        raise ValueError(f"tokens outside the vocabulary: {', '.join(found)}")


def variable_names(variables: list[str] | str, count: int | None = None) -> list[str]:
    """A list of names, or a name with a number for each variable."""
    names = [f"{variables}{i}" for i in range(count or 1)] if isinstance(variables, str) else list(variables)
    if not names or len(set(names)) != len(names):
        raise ValueError("variables must be distinct names")
    return names


def pieces_are_formulas(c: Column, variables: list[str]) -> Column:
    """Whether every piece between bars is a formula; a text without pieces isn't one."""
    pieces = F.filter(F.transform(F.split(c, r"\|+"), strip), lambda x: x != "")
    return (F.size(pieces) > 0) & F.forall(pieces, lambda x: is_formula(x, variables))


def all_well_formed(df: DataFrame, variables: list[str], *columns: str) -> DataFrame:
    """One row: whether all columns of all rows are well-formed, and how many rows aren't."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(pieces_are_formulas(F.col(c), variables), F.lit(False))
    return df.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("well_formed"), F.count_if(~ok).alias("n_bad"))
