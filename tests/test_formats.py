"""The format of pair files and the job log as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from mathloom.sources import pair_format, scans, sinks
from mathloom.sources.batches import BatchTable
from mathloom.streaming import joblog


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_ranges_of_bytes_hold_every_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(pair_format, "READ_BYTES", 5)
    (tmp_path / "a").write_text("p1 # a1\n\nno mark\n  é # ü#z \nlast # line")
    (tmp_path / "b").write_text("")
    (tmp_path / "c").write_text("\n\nx#y\n")
    (tmp_path / "_hidden").write_text("no # no\n")
    reader = pair_format.PairReader(str(tmp_path), size)
    rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert [(r["problem"], r["answer"]) for r in rows] == [("p1", "a1"), ("é", "ü#z"), ("last", "line"), ("x", "y")]
    for r in rows:
        with open(r["file"], "rb") as f:
            f.seek(r["start"])
            assert f.readline().decode().partition("#")[0].strip() == r["problem"]


def test_short_ranges_of_large_files_are_lengthened(tmp_path):
    """The number of tasks doesn't grow with the files while ranges are shorter than RANGE_BYTES; each line is still read once."""
    lines = [f"{i} # {i * i}" for i in range(50_000)]
    (tmp_path / "a").write_text("\n".join(lines[:30_000]) + "\n")
    (tmp_path / "b").write_text("\n".join(lines[30_000:]))
    parts = pair_format.PairReader(str(tmp_path), 100).partitions()
    assert len(parts) <= pair_format.MOST_RANGES + 2 and max(p.end - p.start for p in parts) < 5000
    rows = [r["problem"] + " # " + r["answer"] for p in parts for b in pair_format.PairReader(str(tmp_path), 100).read(p) for r in b.to_pylist()]
    assert rows == lines
    many = pair_format._ranges([("x", 10**12)], 100)
    assert {r.end - r.start for r in many[:-1]} == {pair_format.RANGE_BYTES}


def test_pairs_are_written_and_read(spark, tmp_path):
    spark.dataSource.register(pair_format.Pairs)
    where = f"file://{tmp_path}/in"
    rows = spark.range(50).select(F.col("id").cast("string").alias("problem"), (F.col("id") * 2).cast("string").alias("answer"))
    rows.filter("problem < 20").write.format("pairs").mode("append").save(where)
    rows.filter("problem >= 20").repartition(3).write.format("pairs").mode("append").save(where)
    read = lambda: sorted((int(r["problem"]), int(r["answer"])) for r in spark.read.format("pairs").option("range_bytes", 11).load(where).collect())
    assert read() == [(i, 2 * i) for i in range(50)]
    assert sorted(int(r["problem"]) for r in scans.read_pairs(spark, where).collect()) == list(range(50))
    with pytest.raises(Exception):
        rows.withColumn("problem", F.lit("a#b")).write.format("pairs").mode("append").save(where)
    assert len(read()) == 50 and not [p for p in (tmp_path / "in").iterdir() if p.name.startswith(".staging")]
    rows.limit(3).write.format("pairs").mode("overwrite").save(where)
    assert read() == [(i, 2 * i) for i in range(3)]
    with pytest.raises(Exception, match="problem and answer"):
        spark.range(1).write.format("pairs").mode("append").save(where)


def test_job_log_stream_goes_on_from_its_state(spark, tmp_path):
    log, table = f"{tmp_path}/log", BatchTable(spark, f"{tmp_path}/table")
    write = lambda *rows: sinks.append_jobs(spark.createDataFrame(list(rows), "job_id string, status string").coalesce(1), log)
    run = lambda: joblog.follow(spark, log, table.folder, f"{tmp_path}/state").awaitTermination()
    now = lambda: {r["job_id"]: json.loads(r["record"])["status"] for r in joblog.present(table).collect()}
    write(("a", "queued"), ("b", "queued"))
    run()
    assert now() == {"a": "queued", "b": "queued"}
    write(("a", "running"), ("a", "done"), ("b", "deleted"))
    (tmp_path / "log" / "late.txt").write_text('{"job_id": "a", "status": "older"}\nno record\n[1]\n{"job_id": "c", "status": "queued"}\n')
    run()
    assert now() == {"a": "done", "c": "queued"}
    batches = table.log().count()
    run()
    assert now() == {"a": "done", "c": "queued"} and table.log().count() == batches
    assert {r["job_id"]: json.loads(r["record"])["status"] for r in scans.present_jobs(scans.read_job_log(spark, log)).collect()} == now()
