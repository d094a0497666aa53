"""Content-addressed web archive.

An archive is two tables: `payloads` holds each distinct payload once under its SHA-256, `records` holds the exact header
block of every WARC record together with the digest of its payload. Full records come back by a join on the digest. The SHA-1
that WARC headers usually carry is part of the header, not the address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, each_copy, free_shuffles, join_groups, join_salted, null_id, safe_id

#: Equal payloads of fewer bytes are written as responses each; larger ones once, the others revisit it.
REVISIT_BYTES = 1000
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a URL that would end or damage a header line.
_UNSAFE = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def _page_name(page: Column, copy: Column) -> Column:
    """Record ids are unique: of repeated rows the second and further ones carry a number."""
    number = F.when(copy > 0, F.concat(F.lit("#"), copy.cast("string"))).otherwise("")
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), number, F.lit(">"))


def _escaped(url: Column) -> Column:
    """A URL in one line: those with a line break (or the mark itself) are changed and marked, so that reading gives back the exact URL."""
    out = url
    for c, code in _UNSAFE:
        out = F.replace(out, F.lit(c), F.lit(code))
    return F.when(url.rlike(r"[\r\n]|^escaped:"), F.concat(F.lit("escaped:"), out)).otherwise(url)


def _unescaped(text: Column) -> Column:
    out = F.substring(text, len("escaped:") + 1, 1 << 30)
    for c, code in reversed(_UNSAFE):
        out = F.replace(out, F.lit(code), F.lit(c))
    return F.when(text.startswith("escaped:"), out).otherwise(text)


def _header() -> Column:
    """The header block; the block of a revisit is empty, so is its Content-Length."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _page_name(F.col("page_id"), F.col("copy"))),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", _escaped(F.coalesce("url", F.lit("about:blank")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(revisit, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("digest"))))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _page_name(F.col("refers_to"), F.lit(0))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes `{path}/payloads` and `{path}/records`.

    Of records with equal payloads of at least REVISIT_BYTES bytes the one with the largest id (then URL) is a response and
    the others revisit it. Repeated rows: the first is the response, the others revisit it. A null payload is empty, a null URL
    `about:blank`; a null id is smaller than any other (and equal to the smallest long). Payloads of any length are stored whole; an
    empty table gives empty ones. Payloads that share a SHA-256 but differ in length, SHA-1 or another hash fail the write.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    raw = pages.select(safe_id(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    raw = raw.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # the store: partial aggregation leaves one copy per task before the shuffle
    mark = F.struct(F.octet_length("payload"), F.sha1("payload"), F.xxhash64("payload"))
    stored = raw.groupBy("digest").agg(F.first("payload").alias("payload"), F.count("*").alias("rows"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    same = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")))
    stored.select("digest", same.alias("payload"), "rows").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    free_shuffles(spark)
    slim = raw.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"), F.unhex(F.sha1("payload")).alias("sha1"))
    slim = scratch.save(slim.groupBy("page_id", "url", "digest", "n_bytes", "sha1").agg(F.count("*").alias("copies")), "slim")
    best = slim.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("rows"))
    rows = join_groups(slim, scratch.save(best, "best"), "digest", "rows").drop("rows")
    rows = rows.withColumn("winner", F.struct("page_id", "url").eqNullSafe(F.col("best")))
    rows = each_copy(rows, "copies", "copy")
    first = (F.col("n_bytes") < REVISIT_BYTES) | (F.col("winner") & (F.col("copy") == 0))
    rows = rows.withColumns({"record_type": F.when(first, "response").otherwise("revisit"), "refers_to": F.when(~first, null_id(F.col("best.page_id")))})
    rows = rows.withColumns({"page_id": null_id("page_id"), "sha1": F.lower(F.hex("sha1"))})
    rows.select(_header().alias("header"), "digest").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/records")
    scratch.drop("slim", "best")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: digest, header, payload, and header and block as one `record` with the closing line breaks (binary).

    Each stored payload is hashed again first; one that isn't its address's fails the read.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged record: payload of "), F.hex("digest"))))
    joined = join_salted(spark.read.parquet(f"{path}/records"), stored.withColumn("payload", sound), "digest", "rows", "header")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    block = F.when(_field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return joined.select("digest", "header", "payload", F.concat(F.encode("header", "UTF-8"), block, end).alias("record"))


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each page, parsed from its reconstructed record: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url.

    The block that stands behind the header must have the header's length and digest, and the payload, which a revisit shares
    with the response, the header's payload digest; a record that doesn't agree fails the read.
    """
    rows = read_records(spark, path)
    page = lambda name: F.nullif(F.regexp_extract(_field(name), "<urn:page:([^#>]*)", 1), F.lit("none")).try_cast("long")
    start = F.octet_length("header")
    block = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    rows = rows.withColumns({"block": block, "sha1": F.sha1("payload")})
    whole = (F.expr("substring(record, 1, octet_length(header))") == F.encode("header", "UTF-8")) & (F.octet_length("record") == start + _field("Content-Length").cast("int") + 4)
    sound = whole & (F.concat(F.lit("sha256:"), F.sha2("block", 256)) == _field("WARC-Block-Digest")) & (F.concat(F.lit("sha1:"), F.col("sha1")) == _field("WARC-Payload-Digest"))
    digest = F.when(sound, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), F.col("header"))))
    out = {"page_id": page("WARC-Record-ID"), "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": digest, "record_type": _field("WARC-Type"), "refers_to": page("WARC-Refers-To"), "url": _unescaped(_field("WARC-Target-URI"))}
    return rows.select(*(c.alias(name) for name, c in out.items()))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "archive").path("pages")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(url, 'about:blank') AS url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS best FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n < 1000 OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 1000 OR page_id = best THEN NULL ELSE best END AS refers_to, url
FROM m
"""
