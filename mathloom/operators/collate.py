"""Token ids to padded batches, as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the label that losses and metrics leave out.
IGNORED = -100


def pad(ids: Column, length: Column, value: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def mask(ids: Column, length: Column) -> Column:
    return pad(F.transform(ids, lambda _: F.lit(1)), length)


def collate(df: DataFrame, batch: str, source: str, target: str, pad_id: int = 0) -> DataFrame:
    """Adds input_ids, attention_mask, decoder_input_ids, decoder_attention_mask and labels.

    Both sides are padded on the right to the longest of their batch. The decoder reads all but the last padded id and
    should yield all but the first; padding among the labels is IGNORED.
    """
    own = Window.partitionBy(batch)
    df = df.withColumns({"_source": F.max(F.size(source)).over(own), "_target": F.max(F.size(target)).over(own)})
    ids, seen = pad(df[target], df["_target"], pad_id), mask(df[target], df["_target"])
    short = F.greatest(df["_target"] - 1, F.lit(0))
    label = F.zip_with(F.slice(ids, F.lit(2), short), F.slice(seen, F.lit(2), short), lambda x, m: F.when(m == 1, x).otherwise(IGNORED))
    return df.withColumns({
        "input_ids": pad(df[source], df["_source"], pad_id),
        "attention_mask": mask(df[source], df["_source"]),
        "decoder_input_ids": F.slice(ids, F.lit(1), short),
        "decoder_attention_mask": F.slice(seen, F.lit(1), short),
        "labels": label,
    }).drop("_source", "_target")


def pad_extra(df: DataFrame, batch: str, field: str) -> DataFrame:
    """Pads a further array field with zeros and leaves room for the begin and end tokens; target_* becomes decoder_*."""
    longest = F.max(F.size(field)).over(Window.partitionBy(batch))
    out = "decoder_" + field.removeprefix("target_") if field.startswith("target_") else field
    df = df.withColumn("_longest", longest)
    return df.withColumn(out, F.concat(F.array(F.lit(0)), pad(df[field], F.col("_longest")), F.array(F.lit(0)))).drop("_longest", *([field] if out != field else []))


def as_lists(df: DataFrame, batch: str, order: str, *columns: str) -> DataFrame:
    """Without a tokenizer: the columns of each batch as lists in order."""
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_rows"))
    return rows.select(batch, *(F.col(f"_rows.{c}").alias(c) for c in columns))
