"""Scans of problem and answer files, evaluation results, job logs and index ranges."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable
from pathlib import Path
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import nested
from ..functions.loadprep import LoadStep
from ..functions.text import after, before, strip
from . import folders

_LINE = "_line"
#: Fields of a job log's records: the number of the append and of the row in it.
APPENDED, ROW = "appended", "appended_row"


def check_limit(limit: int | None) -> int | None:
    """None and -1 are no limit; others must be positive."""
    if limit is None or limit == -1:
        return None
    if limit <= 0:
        raise ValueError("a limit must be positive, or -1 or None for all")
    return limit


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, _line): stripped lines that aren't blank, with a key that orders them as in the files, by their paths."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(strip(F.col("value")).alias("value"), place.alias(_LINE)).filter("value <> ''")


def first_rows(spark: SparkSession, path: str | list[str], limit: int | None, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `rows` makes of the lines of some files, or the first `limit` of it in the order of the files.

    With a limit, files are counted in their order, each time four times as many as before, until there are enough rows; the others
    aren't read.
    """
    limit = check_limit(limit)
    if limit is None:
        return rows(lines(spark, path))
    files, need = [_literally(name) for name in sorted(spark.read.text(path).inputFiles())], 1
    while need < len(files) and rows(lines(spark, files[:need])).limit(limit).count() < limit:
        need *= 4
    return rows(lines(spark, files[:need] or path)).orderBy(_LINE).limit(limit)


def _literally(name: str) -> str:
    """A file's name as Spark lists it -> a path that stands for this file alone."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(name))


def in_place(df: DataFrame, place: bool) -> DataFrame:
    return df if place else df.drop(_LINE)


def split_pairs(df: DataFrame, column: str = "value", on_missing: str = "skip") -> DataFrame:
    """Problem and answer of lines split at the first #; lines without one are skipped or an error."""
    c = df[column]
    if on_missing == "skip":
        df = df.filter(F.instr(c, "#") > 0)
    elif on_missing != "raise":
        raise ValueError("on_missing must be skip or raise")
    need = lambda x: F.when(F.instr(c, "#") > 0, x).otherwise(F.raise_error(F.concat(F.lit("no # in line: "), c))) if on_missing == "raise" else x
    return df.withColumns({"problem": need(strip(before(c, "#"))), "answer": need(strip(after(c, "#")))})


def read_pairs(spark: SparkSession, path: str | list[str], limit: int | None = None, on_missing: str = "skip", place: bool = False) -> DataFrame:
    """(problem, answer) of text files with one pair a line; with `place` also _line, which orders them."""
    return in_place(first_rows(spark, path, limit, lambda df: split_pairs(df, on_missing=on_missing).drop("value")), place)


def numbered(df: DataFrame) -> DataFrame:
    """Adds idx, from 0 without gaps in the order of the files that the rows come from, and drops _line (`scans.load` with place).

    The rows are written first, with ids that rise along a split of a file. A row's number is its id's distance to the smallest one of its
    split and the number of rows of the splits before; of each split two numbers go through the driver, which holds the list of splits
    anyway. Where a load step has moved rows to other tasks, they are sorted within their splits instead; it mustn't sort them within a task.
    """
    if "_line" not in df.columns:
        raise ValueError("a load step has to keep the column _line, which orders the rows")
    spark, path = df.sparkSession, folders.new_folder(df.sparkSession, "numbered")
    df.select("*", F.col("_line.file").alias("_file"), F.col("_line.block").alias("_block"), F.monotonically_increasing_id().alias("_id")).write.parquet(path)
    rows = spark.read.schema(df.schema.add("_file", "string").add("_block", "long").add("_id", "long")).parquet(path)
    stats = rows.groupBy("_file", "_block").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("*").alias("n"), F.bool_and(F.shiftright("_id", 33) == F.shiftright("_line.row", 33)).alias("in_task"))
    splits, starts, at = stats.orderBy("_file", "_block").collect(), [], 0
    for r in splits:
        starts.append((r["_file"], r["_block"], r["low"], at))
        at += r["n"]
    rows = rows.join(spark.createDataFrame(starts, "_file string, _block long, _low long, _start long"), ["_file", "_block"])
    if all(r["high"] - r["low"] + 1 == r["n"] and r["in_task"] for r in splits):
        within = F.col("_id") - F.col("_low")
    else:
        within = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_line.row", "_id")) - 1
    return rows.withColumn("idx", (F.col("_start") + within).cast("long")).drop("_file", "_block", "_id", "_low", "_start", "_line")


def zip_files(spark: SparkSession, problems: str, answers: str) -> DataFrame:
    """(idx, problem, answer) of two sets of files whose lines belong together by their numbers; it is an error if one has more lines.

    Lines are numbered as in the files, blank ones left out, and joined by their numbers.
    """
    left, right = (numbered(lines(spark, path).withColumnRenamed("value", name)) for path, name in ((problems, "problem"), (answers, "answer")))
    rows = left.join(right, "idx", "full")
    missing = F.raise_error(F.concat(F.lit("a line has no partner: "), F.col("idx").cast("string"))).cast("string")
    return rows.select("idx", *(F.coalesce(F.col(c), missing).alias(c) for c in ("problem", "answer")))


def is_falsy(v: Column) -> Column:
    """What counts as no answer: null, false, zero, and empty strings, lists and objects."""
    kind, text = F.schema_of_variant(v), F.to_json(v)
    return v.isNull() | (kind == "VOID") | text.isin("false", '""', "[]", "{}") | (kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(v, "$", "double") == 0))


def parse_records(df: DataFrame, column: str = "value") -> DataFrame:
    """Problem and answer (as nested values) of JSON objects; `solution` stands in for a missing or falsy answer.

    Lines that aren't objects or lack either field are skipped.
    """
    v = F.try_parse_json(df[column])
    rows = df.withColumn("_v", v).filter("schema_of_variant(_v) like 'OBJECT%'")
    get = lambda key: F.try_variant_get(F.col("_v"), f"$.{key}", "variant")
    solution = F.when(F.schema_of_variant(get("solution")) != "VOID", get("solution"))
    rows = rows.withColumns({"_p": get("problem"), "_a": F.when(is_falsy(get("answer")), solution).otherwise(get("answer"))})
    rows = rows.filter(F.col("_p").isNotNull() & (F.schema_of_variant("_p") != "VOID") & F.col("_a").isNotNull())
    return rows.withColumns({"problem": nested.from_variant(F.col("_p")), "answer": nested.from_variant(F.col("_a"))}).drop("_v", "_p", "_a")


def read_records(spark: SparkSession, path: str | list[str], limit: int | None = None, place: bool = False) -> DataFrame:
    """(problem, answer) as nested values from JSON lines; with `place` also _line, which orders them."""
    return in_place(first_rows(spark, path, limit, lambda df: parse_records(df).drop("value")), place)


def read_trusted_pickle(spark: SparkSession, path: str, limit: int | None = None, place: bool = False) -> DataFrame:
    """A pickled list of (problem, answer) pairs. Only for small files that you have written yourself."""
    rows = pickle.loads(folders.read_bytes(spark, path))
    if not isinstance(rows, list):
        raise TypeError("the file must hold a list")
    rows = rows[: check_limit(limit)]
    value = "struct<kind:string,cells:array<array<string>>>"
    df = spark.createDataFrame([(nested.of_python(p), nested.of_python(a), (path, 0, i)) for i, (p, a) in enumerate(rows)], f"problem {value}, answer {value}, {_LINE} struct<file:string,block:long,row:long>")
    return in_place(df, place)


def load(spark: SparkSession, text: str | None = None, jsonl: str | None = None, pickled: str | None = None, step: LoadStep | None = None, limit: int | None = None, place: bool = False) -> DataFrame:
    """(problem, answer) strings from whichever path is given: pickle before JSON lines before text. Suffixes tell the formats
    of `text`. With a load step a line without # is an error. With `place` also _line, which orders the rows as in the files."""
    if text and text.endswith(".pkl"):
        text, pickled = None, pickled or text
    if text and text.endswith(".jsonl"):
        text, jsonl = None, jsonl or text
    if pickled or jsonl:
        df = read_trusted_pickle(spark, pickled, limit, place) if pickled else read_records(spark, jsonl, limit, place)
        if step is None:
            return df.withColumns({c: nested.to_words(df[c]) for c in ("problem", "answer")})
        return df.transform(step)
    if not text:
        raise ValueError("a path is needed")
    df = read_pairs(spark, text, limit, "raise" if step else "skip", place)
    return df.transform(step) if step else df


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """(generated, reference) of a file that holds a JSON array or JSON lines; missing keys are empty."""
    first = spark.read.text(path).filter(strip(F.col("value")) != "").first()
    array = first is not None and first[0].lstrip().startswith("[")
    df = spark.read.schema("generated string, reference string").option("multiLine", array).json(path)
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("generated", "reference")))


def latest_step(files: DataFrame, column: str = "path") -> DataFrame:
    """The file step_<n>.json with the largest n."""
    n = F.regexp_extract(column, r"step_(\d+)\.json$", 1)
    return files.filter(n != "").agg(F.max_by(column, n.cast("long")).alias(column))


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    """(record, _line) of the log's objects; other lines are ignored. `_line` orders them by the numbers that `sinks.append_jobs` writes
    into them; records without one come first, by their files' times."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("value"), F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("record", F.try_parse_json("value")).filter("schema_of_variant(record) like 'OBJECT%'")
    number = lambda key: F.try_variant_get("record", f"$.{key}", "long")
    own = number(APPENDED).isNull()
    place = F.struct(F.coalesce(number(APPENDED), F.lit(-1)).alias("append"), F.when(own, F.col("written")).alias("written"), F.when(own, F.col("file")).alias("file"), F.coalesce(number(ROW), F.col("row")).alias("row"))
    return rows.select("record", place.alias(_LINE))


def latest_jobs(log: DataFrame) -> DataFrame:
    """The last record of each job."""
    rows = log.withColumn("job_id", F.try_variant_get("record", "$.job_id", "string")).withColumn("text", F.to_json("record"))
    return rows.groupBy("job_id").agg(F.max_by("text", _LINE).alias("record"))


def present_jobs(log: DataFrame) -> DataFrame:
    """The last record of each job that isn't deleted."""
    return latest_jobs(log).filter(F.coalesce(F.try_variant_get(F.parse_json("record"), "$.status", "string"), F.lit("")) != "deleted")


def last_jobs(log: DataFrame, n: int) -> DataFrame:
    """The last n (at least one) records, newest first."""
    return log.orderBy(F.desc(_LINE)).limit(max(1, n)).drop(_LINE)


def indices(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """(tag, sample_index): 0 to n - 1 for each tag."""
    if not sizes or not all(isinstance(n, int) and not isinstance(n, bool) and n > 0 for n in sizes.values()):
        raise ValueError("sizes must map tags to positive numbers")
    parts = [spark.range(n).select(F.lit(tag).alias("tag"), F.col("id").alias("sample_index")) for tag, n in sizes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys to as many partitions as shuffles have, two for each core at least.

    For what takes long with each row: a small file comes as one partition, however many rows it has.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def read_config(path: str, spark: SparkSession | None = None) -> dict[str, Any]:
    """A YAML file, with a session from any store that it reads."""
    import yaml

    return yaml.safe_load(folders.read_text(spark, path) if spark else Path(path).read_text()) or {}


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted paths of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.orderBy("path")
