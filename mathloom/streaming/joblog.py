"""The job log as a stream: a state with the newest record of each job, and a table of the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import scans
from ..sources.batches import BatchTable


def newest(records: DataFrame) -> DataFrame:
    """(job_id, record, append, row) of each job's newest record, by the numbers that `sinks.append_jobs` gives; as a stream in update mode its
    state has one record a job. Records without numbers are older than all others."""
    number = lambda key: F.coalesce(F.try_variant_get("record", f"$.{key}", "long"), F.lit(-1))
    rows = records.withColumn("record", F.try_parse_json("value")).filter("schema_of_variant(record) like 'OBJECT%'")
    rows = rows.select(F.try_variant_get("record", "$.job_id", "string").alias("job_id"), F.to_json("record").alias("text"), F.struct(number(scans.APPENDED).alias("append"), number(scans.ROW).alias("row")).alias("place"))
    best = rows.groupBy("job_id").agg(F.max_by("text", "place").alias("record"), F.max("place").alias("place"))
    return best.select("job_id", "record", F.col("place.append").alias("append"), F.col("place.row").alias("row"))


def follow(spark: SparkSession, log: str, table: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Appends what has changed to a table of batches; what is there is processed, then the query ends. A batch that is run again after a
    failure is in the table once. Files may come in any order: an older record never replaces a newer one."""
    changes = newest(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(log))
    sink = BatchTable(spark, table)
    return changes.writeStream.outputMode("update").foreachBatch(lambda df, k: sink.append(df, f"batch-{k:010d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def present(table: BatchTable) -> DataFrame:
    """(job_id, record): the newest record of each job that isn't deleted."""
    best = table.read().groupBy("job_id").agg(F.max_by("record", F.struct("append", "row")).alias("record"))
    return best.filter(F.coalesce(F.get_json_object("record", "$.status"), F.lit("")) != "deleted")
