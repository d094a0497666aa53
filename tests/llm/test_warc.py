import hashlib

from mathloom.llm import warc
from mathloom.llm.shared import Scratch

BIG = "<p>ünï</p>" * 200
PAGES = [(1, "http://a/", BIG), (2, "http://b/", BIG), (9, None, BIG), (3, "http://c/", "small"), (4, "http://d/", "small"), (5, "http://e/", None), (6, "http://f/%25\r\nX: y", ""), (10, "escaped:a", "b"), (11, "long", "<p>0123456789</p>" * 300_000), (7, "u", BIG + "x"), (7, "u", BIG + "x"), (None, "n", BIG), (8, "z", "a\r\n\r\nWARC/1.1\r\n" * 90)]


def brute(pages):
    groups = {}
    for i, _, h in pages:
        groups.setdefault((h or "").encode(), []).append(i)
    done, out = set(), []
    for i, u, h in pages:
        b = (h or "").encode()
        best = max((x for x in groups[b] if x is not None), default=None)
        first = len(b) < 1000 or (i == best and b not in done)
        if first and len(b) >= 1000:
            done.add(b)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else best, "about:blank" if u is None else u))
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, digest string, payload string").repartition(3)
    path = Scratch(spark, "test").path("archive")
    warc.write_archive(pages, path)
    got = [tuple(r) for r in warc.read_archive(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(brute(PAGES), key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    names = []
    for r in warc.read_records(spark, path).collect():
        record, header = bytes(r["record"]), r["header"].encode()
        assert record.startswith(header) and header.endswith(b"\r\n\r\n") and record.endswith(b"\r\n\r\n")
        block = record[len(header) : -4]
        assert block == (b"" if b"WARC-Type: revisit" in header else bytes(r["payload"]))
        assert f"Content-Length: {len(block)}\r\n".encode() in header
        names += [x for x in header.split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert len(set(names)) == len(names) == len(PAGES)


def test_no_pages(spark):
    path = Scratch(spark, "test").path("archive")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_damage_is_noticed(spark):
    import pytest

    path = Scratch(spark, "test").path("archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), path)
    spark.createDataFrame([(bytearray(hashlib.sha256(b"payload").digest()), bytearray(b"paylaod"), 1)], "digest binary, payload binary, rows long").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archive(spark, path).collect()


def test_hot_payloads_are_dealt_out(spark):
    """Two payloads have most records: their groups are copied to parts, and every record gets its payload once."""
    from pyspark.sql import functions as F

    from mathloom.llm.shared import join_salted

    rows = [(k % 2 if k < 900 else k, f"header {k}") for k in range(1000)]
    groups = {}
    for key, _ in rows:
        groups[key] = groups.get(key, 0) + 1
    df = spark.createDataFrame(rows, "digest long, header string")
    sizes = spark.createDataFrame([(k, n, f"payload {k}") for k, n in groups.items()], "digest long, rows long, payload string")
    got = join_salted(df, sizes, "digest", "rows", "header")
    assert sorted((r["digest"], r["header"], r["payload"]) for r in got.collect()) == sorted((k, h, f"payload {k}") for k, h in rows)
    assert join_salted(df.limit(0), sizes.limit(0), "digest", "rows", "header").count() == 0
    assert "payload" not in got.select(F.lit(1)).columns
