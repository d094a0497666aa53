"""Seeded generation of datasets: an index range, a seed for each index, one Arrow function per partition.

A sample depends on root seed, tag and index only, not on partitions or batches.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested
from ..operators import metrics
from ..sources import scans, sinks
from ..sources.batches import BatchTable
from ..sources.folders import new_folder, remove

#: seed -> (problem, answer) as strings or lists, or None to skip the index.
Instance = Callable[[int], tuple[Any, Any] | None]
#: (problem, answer) -> category -> metric -> number, or category -> number.
Statistics = Callable[[Any, Any], dict[str, Any]]

_VALUE = "struct<kind:string,cells:array<array<string>>>"
SCHEMA = f"tag string, sample_index long, seed string, problem {_VALUE}, answer {_VALUE}, stats map<string,map<string,double>>, runtime double"


def seed_hex(root: Column, tag: Column, index: Column) -> Column:
    """The 128-bit seed of a sample as 32 hexadecimal digits."""
    return F.sha2(F.concat_ws("_", root.cast("string"), tag, index.cast("string")), 256).substr(1, 32)


def seed_64(seed: Column) -> Column:
    """The upper half of a seed as a number."""
    return F.conv(seed.substr(1, 16), 16, 10).cast("decimal(20,0)")


def numbers(stats: dict[str, Any]) -> dict[str, dict[str, float]]:
    """Statistics as category -> metric -> number; anything but numbers is an error."""
    out = {}
    for category, own in stats.items():
        own = own if isinstance(own, dict) else {"value": own}
        for name, x in own.items():
            if not isinstance(x, (int, float)):
                raise TypeError(f"{category}.{name} must be a number")
        out[category] = {name: float(x) for name, x in own.items()}
    return out


def _run(instance: Instance, statistics: Statistics | None):
    def value(x: Any) -> dict:
        kind, cells = nested.of_python(x)
        return {"kind": kind, "cells": cells}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for tag, index, seed in zip(pdf["tag"], pdf["sample_index"], pdf["seed"]):
                began = time.perf_counter()
                pair = instance(int(seed, 16))
                if pair is not None:
                    rows.append((tag, index, seed, value(pair[0]), value(pair[1]), numbers(statistics(*pair)) if statistics else None, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["tag", "sample_index", "seed", "problem", "answer", "stats", "runtime"])

    return run


def generate(spark: SparkSession, instance: Instance, sizes: dict[str, int], root_seed: int = 42, statistics: Statistics | None = None) -> DataFrame:
    """Samples of all tags: SCHEMA."""
    return for_keys(scans.indices(spark, sizes), instance, root_seed, statistics)


def for_keys(keys: DataFrame, instance: Instance, root_seed: int = 42, statistics: Statistics | None = None) -> DataFrame:
    """A sample for each (tag, sample_index) of a table: SCHEMA."""
    rows = keys.select("tag", F.col("sample_index").cast("long").alias("sample_index"))
    return rows.withColumn("seed", seed_hex(F.lit(root_seed), F.col("tag"), F.col("sample_index"))).mapInPandas(_run(instance, statistics), SCHEMA)


def generate_accepted(spark: SparkSession, instance: Instance, tag: str, n: int, root_seed: int = 42, share: float = 0.25, statistics: Statistics | None = None, most: int | None = None) -> DataFrame:
    """The first n indices that yield a sample.

    Ranges of indices are generated and written, each sized by the share accepted so far (at first `share`) but at most four times as
    long as the one before, until there are n. It is an error if `most` indices, 1000 n + 10,000 unless given, don't yield them.
    """
    most = 1000 * n + 10_000 if most is None else most
    folder, done, found, parts, size = new_folder(spark, "accepted"), 0, 0, [], int(1.1 * n / share) + 16
    while True:
        size = min(size, most - done)
        keys = spark.range(done, done + size).select(F.lit(tag).alias("tag"), F.col("id").alias("sample_index"))
        parts.append(f"{folder}/{done}")
        for_keys(keys, instance, root_seed, statistics).write.parquet(parts[-1])
        last = spark.read.schema(SCHEMA).parquet(parts[-1])
        before, found = found, found + last.count()
        if found >= n:
            cut = nth_smallest(last, "sample_index", n - before, done, done + size)
            return spark.read.schema(SCHEMA).parquet(*parts).filter(F.col("sample_index") <= cut)
        done += size
        if done >= most:
            remove(spark, folder)
            raise RuntimeError(f"only {found} of {done} indices yield a sample")
        size = min(4 * size, int(1.1 * (n - found) * done / max(found, 1)) + 16)


def nth_smallest(rows: DataFrame, column: str, n: int, low: int, high: int, buckets: int = 1024) -> int:
    """The n-th smallest (from 1) of distinct numbers from low to high - 1, by counts of ever smaller buckets."""
    while high - low > 1:
        width = -(-(high - low) // buckets)
        counts = rows.filter(F.col(column).between(low, high - 1)).groupBy(F.expr(f"({column} - {low}) div {width}").alias("bucket")).count().orderBy("bucket").collect()  # at most `buckets`
        for bucket, count in counts:
            if n <= count:
                break
            n -= count
        low, high = low + bucket * width, min(high, low + (bucket + 1) * width)
    return low


def write(df: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet", "text", "jsonl"), report: bool = True) -> None:
    """Writes samples (computed once, as Parquet) in all formats and a statistics report for each tag."""
    began = time.perf_counter()
    df.write.mode("overwrite").partitionBy("tag").parquet(f"{folder}/samples")
    done = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/samples")
    sinks.write_samples(done, folder, tuple(f for f in formats if f != "parquet"))
    if report:
        for tag in [r["tag"] for r in done.select("tag").distinct().collect()]:
            sinks.write_yaml(metrics.report(done.filter(F.col("tag") == tag), "runtime", "stats", time.perf_counter() - began), f"{folder}/{tag}_stats.yaml")


def append_batches(spark: SparkSession, instance: Instance, sizes: dict[str, int], folder: str, batch_size: int, root_seed: int = 42, statistics: Statistics | None = None) -> tuple[BatchTable, BatchTable]:
    """Generates batch after batch into two tables below a folder, `samples` and `states` (partial statistics by tag, category and metric).

    A run that was stopped goes on behind its last batch: batches that a table has are left out.
    """
    samples, states = BatchTable(spark, f"{folder}/samples"), BatchTable(spark, f"{folder}/states")
    have = {t: {r["batch"] for r in t.log().select("batch").collect()} for t in (samples, states)}
    for tag, n in sizes.items():
        for low in range(0, n, batch_size):
            name, high = f"{sinks.check_tag(tag)}-{low}-{min(n, low + batch_size)}", min(n, low + batch_size)
            keys = spark.range(low, high).select(F.lit(tag).alias("tag"), F.col("id").alias("sample_index"))
            if name not in have[samples]:
                samples.append(for_keys(keys, instance, root_seed, statistics), name)
            if name not in have[states] and statistics:
                done = samples.batch(name)
                states.append(metrics.partial(metrics.long_statistics(done, "stats"), "category", "metric").withColumn("tag", F.lit(tag)), name)
    return samples, states


class Generators:
    """Instance functions by name."""

    def __init__(self):
        self.known: dict[str, Instance] = {}

    def add(self, name: str, instance: Instance) -> None:
        self.known[name] = instance

    def get(self, name: str) -> Instance:
        if name not in self.known:
            raise ValueError(f"unknown generator {name}; known are {', '.join(sorted(self.known))}")
        return self.known[name]


def from_config(spark: SparkSession, config: dict[str, Any], generators: Generators) -> DataFrame:
    """dataset: generator, num_train_samples, num_test_samples, root_seed."""
    own = config.get("dataset", config)
    sizes = {tag: own[f"num_{tag}_samples"] for tag in ("train", "test") if own.get(f"num_{tag}_samples")}
    return generate(spark, generators.get(own["generator"]), sizes, own.get("root_seed", 42))


def seeded(make: Callable[[random.Random], Any]) -> Instance:
    return lambda seed: make(random.Random(seed))
