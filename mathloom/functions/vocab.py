"""Vocabularies: ordered tokens whose places are ids, then the special tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
BASE_TOKENS = ("[SEP]",)
BASE_SPECIAL = {"pad_token": "[PAD]", "bos_token": "<s>", "eos_token": "</s>", "cls_token": "[CLS]"}
#: Ids are looked up in a literal map, which is searched from its beginning, up to this size, by a join beyond it.
MAP_TOKENS = 256


def range_tokens(prefix: str, low: int, high: int, centered: bool = False) -> list[str]:
    """prefix + i for low <= i <= high; centred ranges move the lower end down and the upper end up by the middle."""
    shift = (low + high) // 2 if centered else 0
    return [f"{prefix}{i}" for i in range(low - shift, high + shift + 1)]


def field_order(name: str) -> int:
    """The number of elements of GF17 or GF(17), 0 for names of other domains."""
    m = re.fullmatch(r"GF\(?(\d+)\)?", name)
    return int(m[1]) if m else 0


def field_tokens(name: str, centered: bool = False) -> list[str]:
    """Coefficient tokens of a finite field, with negative representatives too."""
    if (p := field_order(name)) < 1:
        raise ValueError(f"not a finite field: {name}")
    return range_tokens("C", 1 - p, p, centered)


@dataclass(frozen=True)
class Vocab:
    """Tokens in order of their ids (repeats count once) and special tokens by role."""

    tokens: tuple[str, ...]
    special: dict[str, str] = field(default_factory=dict)

    @classmethod
    def build(cls, tokens: list[str], special: dict[str, str] | None = None, base_tokens: bool = True, base_special: bool = True) -> Vocab:
        tokens = [*(BASE_TOKENS if base_tokens else ()), *tokens]
        return cls(tuple(dict.fromkeys(tokens)), {**(BASE_SPECIAL if base_special else {}), **(special or {})})

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> Vocab:
        """range: name -> [prefix, low, high]; misc; special_tokens; flags (or the same keys at the top level)."""
        ranges = [r for r in (config.get("range") or {}).values() if isinstance(r, (list, tuple)) and len(r) == 3]
        flags = config.get("flags") or {}
        flag = lambda name: flags.get(name, config.get(name, True))
        tokens = [t for r in ranges for t in range_tokens(*r)] + list(config.get("misc") or [])
        return cls.build(tokens, config.get("special_tokens") or {}, flag("include_base_vocab"), flag("include_base_special_tokens"))

    def with_tokens(self, more: list[str]) -> Vocab:
        return replace(self, tokens=tuple(dict.fromkeys([*self.tokens, *more])))

    def with_number_tokens(self, digit_group: int, allow_float: bool, attach_sign: bool) -> Vocab:
        """What the number policy may emit: the point (and -0), all strings of 1 to digit_group digits."""
        more = ["."] * allow_float + ["-0"] * (allow_float and attach_sign)
        for n in range(1, digit_group + 1):
            more += ["".join(d) for d in product("0123456789", repeat=n)]
        return self.with_tokens(more)

    @property
    def ids(self) -> dict[str, int]:
        """Ids of the tokens, then of special tokens that aren't tokens already."""
        return {t: i for i, t in enumerate(dict.fromkeys([*self.tokens, *self.special.values()]))}

    def special_id(self, role: str) -> int:
        return self.ids[self.special[role]]

    def frame(self, spark: SparkSession) -> DataFrame:
        special = set(self.special.values())
        return spark.createDataFrame([(t, i, t in special) for t, i in self.ids.items()], "token string, id int, is_special boolean")

    def config(self) -> dict[str, Any]:
        return {"range": {}, "misc": list(self.tokens), "special_tokens": dict(self.special), "flags": {"include_base_vocab": False, "include_base_special_tokens": False}}


def encode(tokens: Column, vocab: Vocab) -> Column:
    """Ids between those of begin and end; a token outside the vocabulary is <unk>'s id or an error."""
    ids = vocab.ids
    if len(ids) > MAP_TOKENS:
        raise ValueError("use encode_by_join for large vocabularies")
    table = F.create_map(*(x for t, i in ids.items() for x in (F.lit(t), F.lit(i))))
    other = F.lit(ids["<unk>"]) if "<unk>" in ids else lambda t: F.raise_error(F.concat(F.lit("not in the vocabulary: "), t)).cast("int")
    one = lambda t: F.coalesce(F.try_element_at(table, t), other(t) if callable(other) and not isinstance(other, Column) else other)
    return F.concat(F.array(F.lit(vocab.special_id("bos_token"))), F.transform(tokens, one), F.array(F.lit(vocab.special_id("eos_token"))))


def encode_by_join(df: DataFrame, key: str, tokens: str, vocab: Vocab, out: str = "ids") -> DataFrame:
    """(key, ids): as `encode`, with a broadcast join on a vocabulary whose size the configuration bounds."""
    table = F.broadcast(vocab.frame(df.sparkSession).select(F.col("token").alias("_token"), F.col("id").alias("_id")))
    unknown = vocab.ids.get("<unk>")
    found = df.select(key, F.posexplode_outer(tokens).alias("_pos", "_token")).join(table, "_token", "left")
    value = F.coalesce("_id", F.lit(unknown) if unknown is not None else F.when(F.col("_token").isNotNull(), F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.col("_token"))).cast("int")))
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", value.alias("id"))))).alias("_ids"))
    return rows.select(key, F.concat(F.array(F.lit(vocab.special_id("bos_token"))), F.col("_ids.id"), F.array(F.lit(vocab.special_id("eos_token")))).alias(out))


def decode(ids: Column, vocab: Vocab) -> Column:
    """Tokens of ids joined by blanks, without special ones."""
    special = set(vocab.special.values())
    table = F.create_map(*(x for t, i in vocab.ids.items() if t not in special for x in (F.lit(i), F.lit(t))))
    return F.array_join(F.filter(F.transform(ids, lambda i: F.try_element_at(table, i)), lambda t: t.isNotNull()), " ")
