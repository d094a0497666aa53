"""Scores of predictions and statistics of samples."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .collate import IGNORED


def argmax(logits: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def token_counts(predicted: Column, labels: Column) -> Column:
    """(valid, correct): labels that count, and those that are met."""
    hit = F.zip_with(predicted, labels, lambda p, y: F.struct((y != IGNORED).alias("v"), ((y != IGNORED) & (p == y)).alias("c")))
    count = lambda f: F.size(F.filter(hit, lambda x: F.coalesce(x[f], F.lit(False))))
    return F.struct(count("v").alias("valid"), count("c").alias("correct"))


def accuracy(df: DataFrame, predicted: str, labels: str) -> DataFrame:
    """token_accuracy over all labels that count; success_rate over all rows, where a row without such labels is no success."""
    rows = df.select(token_counts(F.col(predicted), F.col(labels)).alias("n"))
    valid, correct = F.sum("n.valid"), F.sum("n.correct")
    hit = ((F.col("n.valid") > 0) & (F.col("n.valid") == F.col("n.correct"))).cast("int")
    return rows.agg(F.coalesce(F.try_divide(correct, valid), F.lit(0.0)).alias("token_accuracy"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("success_rate"))


def exact_match(df: DataFrame, generated: str = "generated", reference: str = "reference") -> DataFrame:
    """Share of equal texts after stripping, 0 without rows."""
    same = (strip(F.col(generated)) == strip(F.col(reference))).cast("int")
    return df.agg(F.coalesce(F.avg(same), F.lit(0.0)).alias("exact_match"))


def evaluation(df: DataFrame, step: int | None = None) -> DataFrame:
    """One row for an evaluation report: the rate of exact matches and the step."""
    return exact_match(df).select(F.col("exact_match").alias("eval_generation_success_rate"), F.lit(step).cast("long").alias("eval_generation_success_rate_step"))


def cases(df: DataFrame, success: bool, order: str, k: int) -> DataFrame:
    """The first k rows whose texts are (not) exactly equal, without stripping."""
    same = F.col("generated") == F.col("reference")
    return df.filter(same if success else ~same).orderBy(order).limit(k)


def cross_entropy(df: DataFrame, logits: str, labels: str) -> DataFrame:
    """Mean of -log softmax over labels that count; logits are one array of scores per position."""
    rows = df.select(F.explode(F.arrays_zip(F.col(logits).alias("l"), F.col(labels).alias("y"))).alias("p")).select("p.*").filter(F.col("y") != IGNORED)
    top = F.array_max("l")
    log_sum = top + F.log(F.aggregate(F.transform("l", lambda x: F.exp(x - F.array_max(F.col("l")))), F.lit(0.0), lambda s, x: s + x))
    return rows.agg(F.avg(log_sum - F.element_at("l", F.col("y") + 1)).alias("loss"))


def describe(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """Count, mean, population deviation, least and largest value; all 0 for no values."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), zero(F.avg(v), "mean"), zero(F.stddev_pop(v), "std"), zero(F.min(v), "min"), zero(F.max(v), "max"))


def partial(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """What `merged` needs of a batch to describe it together with others: n, mean, m2 (squared distances to the mean), min, max."""
    v = F.col(value).cast("double")
    rows = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"))
    return rows.filter("n > 0").withColumn("m2", F.col("m2") * F.col("n"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """One partial result from several: means weighted by n; the squared distances within the parts and, n times, those of their means
    to the common one."""
    one = F.struct(*(F.col(c) for c in ("n", "mean", "m2")))
    rows = parts.groupBy(*by).agg(F.collect_list(one).alias("parts"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))
    total = lambda f: F.aggregate(F.transform("parts", f), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("mean", total(lambda p: p["n"] * p["mean"]) / F.col("n"))
    return rows.withColumn("m2", total(lambda p: p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))).select(*by, "n", "mean", "m2", "min", "max")


def described(parts: DataFrame, *by: str) -> DataFrame:
    """As `describe`, from a partial result."""
    return parts.select(*by, "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"), "min", "max")


def sample_statistics(df: DataFrame, column: str) -> DataFrame:
    """Statistics of MAP<category, MAP<metric, number>> by category and metric; rows without statistics add nothing."""
    return describe(long_statistics(df, column), "category", "metric")


def long_statistics(df: DataFrame, column: str) -> DataFrame:
    """(category, metric, value) of nested maps."""
    return df.select(F.explode(column).alias("category", "metrics")).select("category", F.explode("metrics").alias("metric", "value"))


def report(df: DataFrame, runtime: str, stats: str | None, total_time: float) -> dict[str, Any]:
    """Overall report of a generated dataset; a few numbers."""
    own = describe(df, value=runtime).first()
    out: dict[str, Any] = {"total_time": total_time, "num_samples": own["n"], "samples_per_second": own["n"] / total_time if total_time else 0.0, "generation_time": {k: own[k] for k in ("mean", "std", "min", "max")}}
    if stats:
        for r in sample_statistics(df, stats).orderBy("category", "metric").collect():
            out.setdefault(f"{r['category']}_stats", {})[r["metric"]] = {k: r[k] for k in ("mean", "std", "min", "max")}
    return out


def list_statistics(values: Column) -> Column:
    """Count, least, largest, mean and population deviation of an array of numbers, 0 for an empty one."""
    x = F.transform(values, lambda v: v.cast("double"))
    n = F.size(values)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    spread = F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(n.alias("count"), zero(F.array_min(x)).alias("min"), zero(F.array_max(x)).alias("max"), mean.alias("mean"), F.sqrt(F.coalesce(F.try_divide(spread, n), F.lit(0.0))).alias("std"))


def factor_statistics(factors: Column) -> Column:
    """Numbers of distinct factors and of factors with multiplicity, of an array of (factor, multiplicity)."""
    return F.struct(F.size(factors).alias("distinct"), F.aggregate(factors, F.lit(0), lambda s, f: s + f["multiplicity"]).alias("total"))
