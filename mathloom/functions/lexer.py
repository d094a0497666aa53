"""A lexer for formulas, compiled to column expressions.

One pattern matches a number, a reserved token, an identifier, white space or any other character, so it tiles the text;
the matches are then classified, numbers are split by the number policy, white space goes and other characters become
<unk> or an error.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import Vocab

#: Fixed values, in the order in which they are reserved.
BASE_RESERVED = ("||", "|", "+", "-", "*", "^", "/", "(", ")", "[", "]")


@dataclass(frozen=True)
class NumberPolicy:
    """attach_sign: a sign belongs to the number; digit_group: digits of a token (0: all); allow_float: numbers have points."""

    attach_sign: bool = False
    digit_group: int = 0
    allow_float: bool = True

    def __post_init__(self):
        if not isinstance(self.attach_sign, bool):
            raise ValueError("attach_sign must be a bool")
        if self.digit_group < 0:
            raise ValueError("digit_group must not be negative")

    @property
    def pattern(self) -> str:
        digits = r"\d+\.?\d*|\.\d+" if self.allow_float else r"\d+"
        return rf"(?<![A-Za-z0-9_])-?{digits}" if self.attach_sign else digits


def number_tokens(c: Column, policy: NumberPolicy) -> Column:
    """Tokens of a number: groups of digits from the left, a point as its own token, the sign on the first group."""
    group = (lambda x: F.regexp_extract_all(x, F.lit(rf"\d{{1,{policy.digit_group}}}"), F.lit(0))) if policy.digit_group else F.array
    sign = F.when(c.startswith("-"), "-").otherwise("")
    rest = F.when(c.startswith("-"), c.substr(F.lit(2), F.length(c))).otherwise(c)
    signed = lambda tokens: F.transform(tokens, lambda x, i: F.when(i == 0, F.concat(sign, x)).otherwise(x))
    if not policy.allow_float:
        return signed(group(rest))
    point = F.instr(rest, ".")
    whole = F.when(point > 1, rest.substr(F.lit(1), point - 1)).otherwise("0")
    return F.when(point == 0, signed(group(rest))).otherwise(F.concat(signed(group(whole)), F.array(F.lit(".")), group(rest.substr(point + 1, F.length(rest)))))


@dataclass(frozen=True)
class Lexer:
    vocab: Vocab
    policy: NumberPolicy = NumberPolicy()
    strict: bool = True
    base_reserved: bool = True
    unknown: str = "<unk>"

    @classmethod
    def build(cls, vocab: Vocab, policy: NumberPolicy = NumberPolicy(), strict: bool = True, base_reserved: bool = True) -> Lexer:
        """With the vocabulary extended by what the number policy emits."""
        full = vocab.with_number_tokens(policy.digit_group, policy.allow_float, policy.attach_sign)
        return cls(full, policy, strict, base_reserved, vocab.special.get("unk_token", "<unk>"))

    @classmethod
    def from_config(cls, config: dict) -> Lexer:
        numbers = config.get("number_policy") or {}
        policy = NumberPolicy(numbers.get("attach_sign", True), numbers.get("digit_group", 0), numbers.get("allow_float", True))
        return cls.build(Vocab.from_config(config.get("vocab") or {}), policy, config.get("strict", True), config.get("include_base_vocab", True))

    @property
    def reserved(self) -> list[str]:
        """Reserved tokens, longer ones first."""
        return sorted(dict.fromkeys([*self.vocab.tokens, *(BASE_RESERVED if self.base_reserved else ())]), key=len, reverse=True)

    @property
    def numbers_first(self) -> bool:
        return self.policy.attach_sign or self.policy.digit_group == 0

    @property
    def pattern(self) -> str:
        number, reserved = f"({self.policy.pattern})", "(" + "|".join(map(re.escape, self.reserved)) + ")"
        first, second = (number, reserved) if self.numbers_first else (reserved, number)
        return rf"{first}|{second}|([A-Za-z_][A-Za-z_0-9]*)|(\s+)|([\s\S])"

    @property
    def digits_reserved(self) -> bool:
        """Whether all that the number policy emits is reserved and goes before numbers, so that numbers fall apart by themselves."""
        g, reserved = self.policy.digit_group, set(self.reserved)
        return not self.numbers_first and all("".join(d) in reserved for n in range(1, g + 1) for d in product(string.digits, repeat=n)) and (not self.policy.allow_float or "." in reserved)

    def tokens(self, c: Column) -> Column:
        """ARRAY<STRING> of tokens."""
        spaced = any(re.search(r"\s", t) for t in self.reserved)
        if self.policy.attach_sign or spaced or not (self.numbers_first or self.digits_reserved):
            return self._classified(c)
        # a match takes the white space before its token along; the end of the text is an empty one
        number, reserved = f"(?:{self.policy.pattern})", "(?:" + "|".join(map(re.escape, self.reserved)) + ")"
        first, second = (number, reserved) if self.numbers_first else (reserved, number)
        words = F.array_remove(F.regexp_extract_all(c, F.lit(rf"\s*+({first}|{second}|[A-Za-z_][A-Za-z_0-9]*|\S|\z)"), F.lit(1)), "")
        known = sorted({t for t in self.reserved if len(t) == 1} | set(string.ascii_letters + string.digits + "_"))
        stray = lambda w: (F.length(w) == 1) & ~w.isin(*known)
        if self.numbers_first and self.policy.allow_float:
            point = lambda w: F.contains(w, F.lit(".")) & w.rlike(rf"^(?:{self.policy.pattern})$")
            out = F.flatten(F.transform(words, lambda w: F.when(F.length(w) == 1, F.array(F.when(w.isin(*known), w).otherwise(self.unknown))).when(point(w), number_tokens(w, self.policy)).otherwise(F.array(w))))
        else:
            out = F.transform(words, lambda w: F.when((F.length(w) > 1) | w.isin(*known), w).otherwise(self.unknown))
        return F.when(F.exists(words, stray), self._classified(c)).otherwise(out) if self.strict else out

    def _classified(self, c: Column) -> Column:
        """Tokens by classes of all matches, white space too; knows the place of a stray character."""
        pattern, reserved = F.lit(self.pattern), set(self.reserved)
        words = F.regexp_extract_all(c, pattern, F.lit(0))
        if self.policy.attach_sign:
            # a digit behind a letter is no number, so the group tells
            numbers = F.regexp_extract_all(c, pattern, F.lit(1))
            marked = F.zip_with(words, numbers, lambda w, n: F.struct(w.alias("w"), (n != "").alias("number")))
        else:
            own = rf"^(?:{self.policy.pattern})$"
            number = lambda w: w.rlike(own) if self.numbers_first else w.rlike(own) & ~w.isin(*reserved)
            marked = F.transform(words, lambda w: F.struct(w.alias("w"), number(w).alias("number")))
        stray = lambda w: ~w["number"] & w["w"].rlike(r"^[^A-Za-z_\s]$") & ~w["w"].isin(*reserved)
        seen = F.filter(marked, lambda w: w["number"] | ~w["w"].rlike(r"^\s+$"))
        split = F.flatten(F.transform(seen, lambda w: F.when(w["number"], number_tokens(w["w"], self.policy)).when(stray(w), F.array(F.lit(self.unknown))).otherwise(F.array(w["w"]))))
        if not self.strict:
            return split
        lengths = F.aggregate(marked, F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"), F.lit("").alias("char")), lambda s, w: F.struct((s["at"] + F.length(w["w"])).alias("at"), F.coalesce(s["bad"], F.when(stray(w), s["at"])).alias("bad"), F.when(s["bad"].isNull() & stray(w), w["w"]).otherwise(s["char"]).alias("char")))
        error = F.concat(F.lit("Unknown character '"), lengths["char"], F.lit("' at position "), lengths["bad"].cast("string"))
        return F.when(F.exists(marked, stray), F.raise_error(error)).otherwise(split)

    def text(self, c: Column) -> Column:
        return F.array_join(self.tokens(c), " ")

    __call__ = text

    def decode(self, c: Column) -> Column:
        """Without the blanks between tokens; lossy."""
        return F.replace(c, F.lit(" "), F.lit(""))


def chain(*steps: Lexer) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Encoder and decoder of lexers one after the other."""
    if not steps:
        raise ValueError("a chain needs a lexer")

    def encode(c: Column) -> Column:
        for s in steps:
            c = s.text(c)
        return c

    def decode(c: Column) -> Column:
        for s in reversed(steps):
            c = s.decode(c)
        return c

    return encode, decode
