"""Position encodings and masks of sequence models, as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the base of the wave lengths.
BASE = 10_000.0


def _rate(i: Column, dim: int) -> Column:
    """Angular speed of the i-th pair of dimensions."""
    return F.pow(F.lit(BASE), -2.0 * i / dim)


def sinusoidal(spark: SparkSession, length: int, dim: int) -> DataFrame:
    """(pos, dim, value): sines in even dimensions, cosines in odd ones."""
    grid = spark.range(length).select(F.col("id").cast("int").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("dim"))
    angle = F.col("pos") * _rate(F.floor(F.col("dim") / 2), dim)
    return grid.withColumn("value", F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)))


def add_sinusoidal(vector: Column, pos: Column, dim: int, max_length: int) -> Column:
    """Adds the encoding of a position; positions from max_length on are errors."""
    angle = lambda i: pos * _rate(F.floor(i / 2), dim)
    out = F.transform(vector, lambda x, i: x.cast("double") + F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))
    return F.when(pos >= max_length, F.raise_error(F.lit("the sequence is longer than the position table"))).otherwise(out)


def rotary(vector: Column, pos: Column, dim: int) -> Column:
    """Rotates dimension i with dimension i + dim / 2 by the position."""
    half = dim // 2
    at = lambda i: F.element_at(vector, i + 1).cast("double")
    angle = lambda i: pos * _rate(i, dim)
    low = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: at(i) * F.cos(angle(i)) - at(i + half) * F.sin(angle(i)))
    high = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: at(i + half) * F.cos(angle(i)) + at(i) * F.sin(angle(i)))
    return F.concat(low, high)


def add_learned(df: DataFrame, vector: str, pos: str, table: DataFrame, rows: int) -> DataFrame:
    """Adds a learned row (pos, weights) for each position, the last for positions beyond. `rows` is the table's size, which a
    model fixes, so it is broadcast."""
    weights = F.broadcast(table.select(F.col("pos").alias("_pos"), F.col("weights").alias("_w")))
    at = F.least(F.col(pos), F.lit(rows - 1))
    return df.join(weights, at == F.col("_pos"), "left").withColumn(vector, F.zip_with(vector, "_w", lambda x, y: x + y)).drop("_pos", "_w")


def encode_positions(kind: str, vector: Column, pos: Column, dim: int, max_length: int = 512) -> Column:
    """The encodings that need no table, by name."""
    kinds = {"none": lambda: vector, "sinusoidal": lambda: add_sinusoidal(vector, pos, dim, max_length), "rope": lambda: rotary(vector, pos, dim)}
    if kind not in kinds:
        raise ValueError(f"unknown position encoding {kind}; known are {', '.join(kinds)}, and generic by add_learned")
    return kinds[kind]()


def causal_mask(sequences: DataFrame, length: str) -> DataFrame:
    """The rows, each a sequence of some length, with (i, j, masked) for all its pairs of positions: i doesn't see j beyond it."""
    places = lambda: F.explode(F.sequence(F.lit(0), F.col(length).cast("int") - 1))
    return sequences.filter(F.col(length) > 0).withColumn("i", places()).withColumn("j", places()).withColumn("masked", F.col("j") > F.col("i"))


def padding_mask(mask: Column) -> Column:
    return F.transform(mask, lambda m: m == 0)


def mask_after_end(ids: Column, end: int, pad: int) -> Column:
    """Padding behind the first end token."""
    at = F.array_position(ids, end)
    return F.transform(ids, lambda x, i: F.when((at > 0) & (i >= at), pad).otherwise(x))


def greedy_plan(plan: Column, begin: int, end: int, pad: int) -> Column:
    """Decoded sequence of planned ids: a begin token, the ids, and padding behind the end token."""
    return F.concat(F.array(F.lit(begin)), mask_after_end(plan, end, pad))
