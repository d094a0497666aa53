"""Tables that grow by batches, each of which is in them once or not at all.

A batch's rows are written to a folder of their own; then a line for it enters the log, by renaming a file to the batch's name, which only
one writer can do. Readers follow the log: folders without a line, of writers that failed or were late, aren't part of the table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import folders, scans, sinks

LOG = "batch string, number long, folder string, rows long, schema string"
#: How the rows of a format become lines.
_LINES: dict[str, Callable[[DataFrame], DataFrame]] = {"text": sinks.pair_lines, "jsonl": sinks.record_lines}


class BatchTable:
    """A table below `folder`. form: parquet, or text and jsonl for samples (problem and answer as nested values)."""

    def __init__(self, spark: SparkSession, folder: str, form: str = "parquet", fresh: bool = False):
        if form not in ("parquet", *_LINES):
            raise ValueError("a table is parquet, text or jsonl")
        self.spark, self.folder, self.form = spark, folder.rstrip("/"), form
        if fresh:
            folders.remove(spark, self.folder)

    def append(self, df: DataFrame, batch: str) -> bool:
        """Adds a batch; False if the table has it already. A failure leaves the table as it was."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a name for a batch: {batch}")
        entry = f"{self.folder}/log/{batch}.json"
        if folders.exists(self.spark, entry):
            return False
        number, count = sinks.append_number(), Observation()
        where = f"data/{number:020d}-{batch}"
        rows = df.observe(count, F.count(F.lit(1)).alias("rows"))
        try:
            if self.form == "parquet":
                rows.write.parquet(f"{self.folder}/{where}")
            else:
                _LINES[self.form](rows).write.text(f"{self.folder}/{where}")
            line = {"batch": batch, "number": number, "folder": where, "rows": count.get["rows"], "schema": df.schema.json()}
            folders.write_text(self.spark, entry, json.dumps(line), replace=False)
        except Exception:
            folders.remove(self.spark, f"{self.folder}/{where}")
            if folders.exists(self.spark, entry):
                return False
            raise
        return True

    def log(self) -> DataFrame:
        """(batch, number, folder, rows, schema) of the batches."""
        if not folders.exists(self.spark, f"{self.folder}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(f"{self.folder}/log")

    def read(self) -> DataFrame:
        """The rows of all batches; of a text or jsonl table (problem, answer) as `scans` reads them, in the order of the batches."""
        entries = self.log().orderBy("number").collect()  # a line for each batch
        if not entries:
            raise ValueError("the table has no batches")
        paths = [f"{self.folder}/{e['folder']}" for e in entries]
        if self.form == "parquet":
            return self.spark.read.schema(T.StructType.fromJson(json.loads(entries[0]["schema"]))).parquet(*paths)
        return scans.read_pairs(self.spark, paths) if self.form == "text" else scans.read_records(self.spark, paths)

    def batch(self, name: str) -> DataFrame:
        """The rows of one batch of a Parquet table."""
        entry = self.log().filter(F.col("batch") == name).first()
        if entry is None:
            raise ValueError(f"the table has no batch {name}")
        return self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.folder}/{entry['folder']}")

    def sweep(self) -> int:
        """Removes folders that no line of the log names, while nobody appends; gives their number."""
        path, fs = folders.file_system(self.spark, f"{self.folder}/data")
        known = {r["folder"].rsplit("/", 1)[1] for r in self.log().select("folder").collect()}
        lost = [s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName() not in known] if fs.exists(path) else []
        for where in lost:
            folders.remove(self.spark, where)
        return len(lost)
