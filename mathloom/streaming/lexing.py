"""Lexing and scoring of pair files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lexer import Lexer
from ..functions.text import strip
from ..sources.scans import split_pairs


def lexed_pairs(spark: SparkSession, folder: str, lexer: Lexer, files_per_batch: int = 100) -> DataFrame:
    """(problem, answer, input_tokens, target_tokens) of new files; stateless, so a restart goes on where it was."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    pairs = split_pairs(rows.select(strip(F.col("value")).alias("value"))).drop("value")
    return pairs.withColumns({"input_tokens": lexer.tokens(F.col("problem")), "target_tokens": lexer.tokens(F.col("answer"))})


def write_lexed(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Parquet files, each batch exactly once; what is there is processed, then the query ends."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_rate(stream: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Share of exact matches of (generated, reference) by time window; rows later than `late` are left out."""
    same = (strip(F.col("generated")) == strip(F.col("reference"))).cast("int")
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.avg(same).alias("exact_match"))
    return rows.select(F.col("w.start").alias("start"), "n", "exact_match")
