"""From pair files to padded batches in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import Lexer
from ..functions.loadprep import LoadStep
from ..functions.text import shorten
from ..functions.vocab import encode, encode_by_join, MAP_TOKENS
from ..operators.collate import collate
from ..operators.validate import check_tokens
from ..sources import scans
from ..sources.scans import numbered, read_config

#: Rows of each split and epochs of a dry run.
DRY_RUN = {"train": 1000, "test": 100, "epochs": 1, "batch_size": 8}


@dataclass(frozen=True)
class Prepared:
    """Lexed and encoded splits with the lexer that made them."""

    train: DataFrame
    test: DataFrame
    lexer: Lexer

    def batches(self, split: str, size: int) -> DataFrame:
        """The split's rows with padded columns; rows of a batch follow one another in the order of `idx`."""
        df = getattr(self, split).withColumn("batch_idx", F.floor(F.col("idx") / size).cast("long"))
        return collate(df, "batch_idx", "input_ids_raw", "target_ids_raw", self.lexer.vocab.special_id("pad_token"))


def tokenised(df: DataFrame, lexer: Lexer) -> DataFrame:
    """(idx, problem, answer) with token and id columns; the tokens of both sides are joined with a large vocabulary at once."""
    df = df.withColumns({"input_tokens": lexer.tokens(df["problem"]), "target_tokens": lexer.tokens(df["answer"])})
    sides = (("input_tokens", "input_ids_raw"), ("target_tokens", "target_ids_raw"))
    if len(lexer.vocab.ids) <= MAP_TOKENS:
        return df.withColumns({out: encode(df[c], lexer.vocab) for c, out in sides})
    both = encode_by_join(df.select("idx", F.concat("input_tokens", "target_tokens").alias("tokens")), "idx", "tokens", lexer.vocab, "_ids")
    begin, end = (F.array(F.lit(lexer.vocab.special_id(name))) for name in ("bos_token", "eos_token"))
    size = F.size("input_tokens")
    ids = {"input_ids_raw": F.slice("_ids", F.lit(2), size), "target_ids_raw": F.slice("_ids", size + 2, F.size("target_tokens"))}
    return df.join(both, "idx").withColumns({out: F.concat(begin, c, end) for out, c in ids.items()}).drop("_ids")


def prepare(spark: SparkSession, lexer: Lexer, train: dict[str, Any], test: dict[str, Any], step: LoadStep | None = None, validate_train: bool = False, validate_test: bool = True, dry_run: bool = False) -> Prepared:
    """train and test are arguments of `sources.scans.load`."""
    out = {}
    for name, source, check in (("train", train, validate_train), ("test", test, validate_test)):
        source = {**source, "limit": DRY_RUN[name]} if dry_run else source
        df = scans.load(spark, step=step, place=True, **source)
        if check:
            check_tokens(df, lexer, "problem", "answer")
        out[name] = tokenised(numbered(df), lexer)
    return Prepared(out["train"], out["test"], lexer)


def from_config(spark: SparkSession, config: dict[str, Any] | str, step: LoadStep | None = None, dry_run: bool = False) -> Prepared:
    """`prepare` by a configuration (or its path), as `data` or at the top level: lexer_config (a path or the lexer's own configuration), for
    train and test *_dataset_path, *_dataset_jsonl or *_dataset_pickle, num_*_samples (-1: all) and validate_*_tokens. use_jsonl and
    use_pickle say that the paths are of that format."""
    config = read_config(config, spark) if isinstance(config, str) else config
    own = config.get("data", config)
    lexer = own.get("lexer_config")
    if lexer is None:
        raise ValueError("lexer_config is needed")
    lexer = Lexer.from_config(read_config(lexer, spark) if isinstance(lexer, str) else lexer)
    sources = {}
    for name in ("train", "test"):
        path, jsonl, pickled = (own.get(f"{name}_dataset_{kind}") for kind in ("path", "jsonl", "pickle"))
        jsonl, pickled = jsonl or (path if own.get("use_jsonl") else None), pickled or (path if own.get("use_pickle") else None)
        sources[name] = {"text": None if jsonl or pickled else path, "jsonl": jsonl, "pickled": pickled, "limit": own.get(f"num_{name}_samples", -1)}
    return prepare(spark, lexer, sources["train"], sources["test"], step, own.get("validate_train_tokens", False), own.get("validate_test_tokens", True), dry_run)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows with long texts shortened."""
    return df.limit(n).select(*(shorten(df[c]).alias(c) for c in ("problem", "answer")))
