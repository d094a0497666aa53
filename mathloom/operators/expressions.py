"""Formulas of polynomials as columns: a pushdown automaton puts their tokens into postfix order, a second one evaluates them.

Both are folds over arrays, so a formula is parsed where its row is. A formula is made of numbers, variables, + - * / ^ (or **),
parentheses and signs; signs bind weaker than powers, powers go from the right. Division is by constants other than 0, exponents are
constants that are whole and not negative.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.draws import let
from .polynomials import gcd

NEGATE = "neg"
#: How tightly operators bind, as they stand on the stack.
_BINDS = {"(": 0, "+": 1, "-": 1, "*": 2, "/": 2, NEGATE: 3, "^": 4}
_NUMBER = r"\d+(?:\.\d+)?"
#: A polynomial with fractions as coefficients, in lowest terms with den > 0.
POLYNOMIAL = "array<struct<exps:array<int>,num:long,den:long>>"
#: Exponents above this aren't evaluated.
MOST_POWER = 1000


def tokens(text: Column, variables: list[str]) -> Column:
    """The formula's tokens; characters that belong to none are tokens of their own. Names go before shorter ones that begin like them."""
    names = "|".join(rf"{re.escape(v)}(?![A-Za-z0-9_])" for v in sorted(variables, key=len, reverse=True)) or "(?!)"
    found = F.regexp_extract_all(text, F.lit(rf"(\*\*|{_NUMBER}(?![A-Za-z0-9_.])|{names}|\S)"), F.lit(1))
    return F.transform(found, lambda t: F.when(t == "**", "^").otherwise(t))


def _binds(op: Column) -> Column:
    out = F.lit(-1)
    for name, level in _BINDS.items():
        out = F.when(op == name, level).otherwise(out)
    return out


def _split_stack(stack: Column, stays: str, level: Column | int) -> tuple[Column, Column]:
    """(what stays, what is popped, last first): popping ends at the last operator for which `stays` holds."""
    holds = {"below": lambda op: _binds(op) < level, "parenthesis": lambda op: op == "("}[stays]
    keep = F.coalesce(F.array_max(F.transform(stack, lambda op, i: F.when(holds(op), i + 1).otherwise(F.lit(0)))), F.lit(0))
    return F.slice(stack, F.lit(1), keep), F.reverse(F.slice(stack, keep + 1, F.size(stack)))


def postfix(tokens: Column, variables: list[str]) -> Column:
    """The tokens in postfix order without parentheses, signs as `neg`; null if they aren't a formula."""
    none = F.array().cast("array<string>")
    state = lambda out, stack, open_, ok: F.struct(out.alias("out"), stack.alias("stack"), open_.alias("open"), ok.alias("ok"))
    push = lambda s, op: F.concat(s["stack"], F.array(op))
    is_operand = lambda t: t.rlike(rf"^{_NUMBER}$") | t.isin(*variables)

    def operand(s: Column, t: Column) -> Column:
        """Where a number, a variable, a sign or an opening parenthesis may stand."""
        return (
            F.when(is_operand(t), state(F.concat(s["out"], F.array(t)), s["stack"], F.lit(False), F.lit(True)))
            .when(t == "(", state(s["out"], push(s, t), F.lit(True), F.lit(True)))
            .when(t == "-", state(s["out"], push(s, F.lit(NEGATE)), F.lit(True), F.lit(True)))
            .when(t == "+", s)
            .otherwise(state(none, none, F.lit(True), F.lit(False)))
        )

    def operator(s: Column, t: Column) -> Column:
        """Where an operator or a closing parenthesis may stand."""
        inside, closed = _split_stack(s["stack"], "parenthesis", 0)
        left, popped = _split_stack(s["stack"], "below", F.when(t == "^", 5).otherwise(_binds(t)))
        return (
            F.when((t == ")") & (F.size(inside) > 0), state(F.concat(s["out"], closed), F.slice(inside, F.lit(1), F.size(inside) - 1), F.lit(False), F.lit(True)))
            .when(t.isin("+", "-", "*", "/", "^"), state(F.concat(s["out"], popped), F.concat(left, F.array(t)), F.lit(True), F.lit(True)))
            .otherwise(state(none, none, F.lit(True), F.lit(False)))
        )

    step = lambda s, t: F.when(~s["ok"], s).when(s["open"], operand(s, t)).otherwise(operator(s, t))
    end = lambda s: F.when(s["ok"] & ~s["open"] & ~F.array_contains(s["stack"], "("), F.concat(s["out"], F.reverse(s["stack"])))
    return let(F.aggregate(tokens, state(none, none, F.lit(True), F.lit(True)), step), end)


def is_formula(text: Column, variables: list[str]) -> Column:
    """Whether a text is a formula. Of each part it is known whether it is constant, and its value then."""
    part = lambda constant, value: F.struct(constant.alias("constant"), value.cast("double").alias("value"))
    kind = "array<struct<constant:boolean,value:double>>"

    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        a, b = F.get(stack, n - 2), F.get(stack, n - 1)
        put = lambda used, x: F.concat(F.slice(stack, F.lit(1), n - used), F.array(x))
        value = F.when(t == "+", a["value"] + b["value"]).when(t == "-", a["value"] - b["value"]).when(t == "*", a["value"] * b["value"])
        exponent = b["constant"] & (b["value"] >= 0) & (b["value"] == F.floor(b["value"]))
        return (
            F.when(stack.isNull(), stack)
            .when(t == NEGATE, put(1, part(b["constant"], -b["value"])))
            .when(t.isin("+", "-", "*"), put(2, part(a["constant"] & b["constant"], value)))
            .when(t == "/", F.when(b["constant"] & (b["value"] != 0), put(2, part(a["constant"], a["value"] / b["value"]))))
            .when(t == "^", F.when(exponent, put(2, part(a["constant"] | (b["value"] == 0), F.pow(a["value"], b["value"])))))
            .when(t.isin(*variables), put(0, part(F.lit(False), F.lit(0.0))))
            .otherwise(put(0, part(F.lit(True), t)))
        )

    end = lambda order: F.when(order.isNull() | (F.size(order) == 0), F.lit(False)).otherwise(F.aggregate(order, F.array().cast(kind), step).isNotNull())
    return F.coalesce(let(postfix(tokens(text, variables), variables), end), F.lit(False))


# ---- evaluation


def fraction(num: Column, den: Column) -> Column:
    """(num, den) in lowest terms with den > 0."""
    div = lambda a, b: F.call_function("div", a, b)
    lowest = lambda c: let(gcd(c["num"], c["den"]) * F.when(c["den"] < 0, F.lit(-1)).otherwise(F.lit(1)), lambda d: F.struct(div(c["num"], d).alias("num"), div(c["den"], d).alias("den")))
    return let(F.struct(num.alias("num"), den.alias("den")), lambda c: F.when(c["den"] == 1, c).otherwise(lowest(c)))


def _term(exps: Column, c: Column) -> Column:
    return F.struct(exps.alias("exps"), c["num"].alias("num"), c["den"].alias("den"))


def collected(terms: Column) -> Column:
    """Like terms added up, without zero terms."""
    zero = F.struct(F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))
    plus = lambda s, t: fraction(F.when(s["den"] == t["den"], s["num"] + t["num"]).otherwise(s["num"] * t["den"] + t["num"] * s["den"]), F.when(s["den"] == t["den"], s["den"]).otherwise(s["den"] * t["den"]))
    like = lambda all_, e: F.aggregate(F.filter(all_, lambda t: t["exps"] == e), zero, plus)
    return let(terms, lambda all_: F.filter(F.transform(F.array_distinct(F.transform(all_, lambda t: t["exps"])), lambda e: let(like(all_, e), lambda c: _term(e, c))), lambda t: t["num"] != 0))


def negated(p: Column) -> Column:
    return F.transform(p, lambda t: F.struct(t["exps"].alias("exps"), (-t["num"]).alias("num"), t["den"].alias("den")))


def times(p: Column, q: Column) -> Column:
    one = lambda s, t: let(fraction(s["num"] * t["num"], s["den"] * t["den"]), lambda c: _term(F.zip_with(s["exps"], t["exps"], lambda x, y: x + y), c))
    return collected(F.flatten(F.transform(p, lambda s: F.transform(q, lambda t: one(s, t)))))


def parse_expression(text: Column, variables: list[str]) -> Column:
    """POLYNOMIAL of a formula, its terms from the largest exponents down; null if it isn't one. Numbers beyond 64 bits are errors."""
    none = [F.lit(0)] * len(variables)
    long = lambda x: x.cast("long")
    constant = lambda num, den: F.filter(F.array(F.struct(F.array(*none).cast("array<int>").alias("exps"), num.alias("num"), den.alias("den"))), lambda t: t["num"] != 0)
    variable = lambda i: F.array(F.struct(F.array(*(F.lit(int(k == i)) for k in range(len(variables)))).alias("exps"), long(F.lit(1)).alias("num"), long(F.lit(1)).alias("den")))

    def number(t: Column) -> Column:
        digits = F.length(F.substring_index(t, ".", -1))
        tenths = let(fraction(long(F.replace(t, F.lit("."), F.lit(""))), long(F.pow(F.lit(10.0), digits))), lambda c: constant(c["num"], c["den"]))
        return F.when(F.contains(t, F.lit(".")), tenths).otherwise(constant(long(t), long(F.lit(1))))

    def leaf(t: Column) -> Column:
        out = number(t)
        for i, v in enumerate(variables):
            out = F.when(t == v, variable(i)).otherwise(out)
        return out

    is_constant = lambda p: F.forall(p, lambda t: F.forall(t["exps"], lambda e: e == 0))
    over = lambda p, c: F.transform(p, lambda t: let(fraction(t["num"] * c["den"], t["den"] * c["num"]), lambda f: _term(t["exps"], f)))
    power = lambda p, e: F.aggregate(F.when(e > 0, F.sequence(F.lit(1), e.cast("int"))).otherwise(F.array().cast("array<int>")), constant(long(F.lit(1)), long(F.lit(1))), lambda s, _: times(s, p))

    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        a, b = F.get(stack, n - 2), F.get(stack, n - 1)
        put = lambda used, x: F.concat(F.slice(stack, F.lit(1), n - used), F.array(x))
        first = F.get(b, F.lit(0))
        exponent = F.coalesce(first["num"], long(F.lit(0)))
        return (
            F.when(t == NEGATE, put(1, negated(b)))
            .when(t == "+", put(2, collected(F.concat(a, b))))
            .when(t == "-", put(2, collected(F.concat(a, negated(b)))))
            .when(t == "*", put(2, times(a, b)))
            .when(t == "/", F.when(is_constant(b) & (F.size(b) > 0), put(2, over(a, first))))
            .when(t == "^", F.when(exponent <= MOST_POWER, put(2, power(a, exponent))))
            .otherwise(put(0, leaf(t)))
        )

    value = lambda order: F.get(F.aggregate(order, F.array().cast(f"array<{POLYNOMIAL}>"), step), F.lit(0))
    sorted_ = lambda p: F.transform(F.array_sort(F.transform(p, lambda t: F.struct(F.transform(t["exps"], lambda e: -e).alias("by"), t["exps"].alias("exps"), t["num"].alias("num"), t["den"].alias("den")))), lambda t: F.struct(t["exps"].alias("exps"), t["num"].alias("num"), t["den"].alias("den")))
    return F.when(is_formula(text, variables), let(postfix(tokens(text, variables), variables), lambda order: sorted_(value(order))))
