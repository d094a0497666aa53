"""Sinks for samples, statistics, evaluation results, vocabularies and the job log."""

from __future__ import annotations

import time
import warnings
from datetime import timedelta
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested
from ..functions.text import utc_now
from . import folders, scans


def check_tag(tag: Any) -> str:
    if not isinstance(tag, str) or not tag:
        raise ValueError("a tag must be a non-empty string")
    return tag


def pair_lines(df: DataFrame) -> DataFrame:
    """`problem # answer` of nested values."""
    return df.select(F.concat(nested.to_text(df["problem"]), F.lit(" # "), nested.to_text(df["answer"])).alias("value"))


def record_lines(df: DataFrame) -> DataFrame:
    """JSON objects with the nested structure kept."""
    return df.select(F.concat(F.lit('{"problem": '), nested.to_json(df["problem"]), F.lit(', "answer": '), nested.to_json(df["answer"]), F.lit("}")).alias("value"))


def write_samples(df: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet", "text", "jsonl"), order: str | None = "sample_index") -> None:
    """One folder for each format and tag: all of a tag is written at once or not at all. Without rows nothing is written.

    The rows are computed once, into a table by tag; each format reads its tag's part of it.
    """
    spark, path = df.sparkSession, folders.new_folder(df.sparkSession, "samples")
    df.write.partitionBy("tag").option("compression", "zstd").parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    tags = [check_tag(r["tag"]) for r in done.select("tag").distinct().collect()]  # names of folders
    if not tags:
        warnings.warn("no samples: nothing is written", stacklevel=2)
    for tag in tags:
        own = done.filter(F.col("tag") == tag)
        own = own.orderBy(order) if order else own
        if "parquet" in formats:
            own.write.mode("overwrite").parquet(f"{folder}/{tag}.parquet")
        if "text" in formats:
            pair_lines(own).write.mode("overwrite").text(f"{folder}/{tag}_raw.txt")
        if "jsonl" in formats:
            record_lines(own).write.mode("overwrite").text(f"{folder}/{tag}_data.jsonl")
    folders.remove(spark, path)


def write_yaml(report: dict[str, Any], path: str) -> None:
    """A small report, in its order; durations as seconds. The active session's stores take it, without one the local disk."""
    import yaml

    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x.total_seconds() if isinstance(x, timedelta) else x
    text, spark = yaml.safe_dump(plain(report), sort_keys=False, allow_unicode=True), SparkSession.getActiveSession()
    if spark:
        folders.write_text(spark, path, text)
    else:
        Path(path).write_text(text)


def write_eval_results(df: DataFrame, folder: str, step: int | None = None) -> None:
    """(generated, reference) as JSON lines of a step or of the final evaluation."""
    name = f"step_{step}.json" if step is not None else "eval_results.json"
    df.select("generated", "reference").write.mode("overwrite").json(f"{folder}/{name}")


def delete_jobs(log: DataFrame, ids: DataFrame, path: str) -> None:
    """Appends a record with the status `deleted` for each of the ids (job_id) that the log (`scans.latest_jobs`) has; the records
    before it stay."""
    gone = log.join(ids.select("job_id").distinct(), "job_id", "left_semi")
    field = lambda name: F.try_variant_get(F.parse_json("record"), f"$.{name}", "string").alias(name)
    append_jobs(gone.select("job_id", utc_now().alias("created_at"), field("kernel_id"), field("bundle_dataset_id"), F.lit("deleted").alias("status")), path)


_appends = 0


def append_number() -> int:
    """A number for an append: the time in nanoseconds, larger than any that this process has given."""
    global _appends
    _appends = max(_appends + 1, time.time_ns())
    return _appends


def append_jobs(df: DataFrame, path: str) -> None:
    """Records as JSON lines with the number of the append and of the row, by which `scans.read_job_log` orders them."""
    rows = df.withColumns({scans.APPENDED: F.lit(append_number()), scans.ROW: F.monotonically_increasing_id()})
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
