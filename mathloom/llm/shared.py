"""What the operators of this subpackage have in common: scratch tables, word bytes and 64-bit hashes."""

from __future__ import annotations

import functools
import gc
import tempfile
import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER_KEEP = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))
U64 = np.uint64
#: Base of the rolling hash, odd, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: A key is hot if it has more rows than one in so many of a partition's even share.
_HOT_SHARE = 8
#: Copies of one row that a task writes out in a row.
_COPIES_AT_ONCE = 1 << 16
#: The id that stands for null: smaller than any other.
NULL_ID = np.iinfo(np.int64).min


class Scratch:
    """Parquet tables in the folder that the cluster shares (`spark.checkpoint.dir`).

    A written table cuts the lineage: a lost executor costs a reread, not a recomputation. Tables are removed by
    `drop` when nothing lazy reads them any more, the rest when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        path, fs = self._fs(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._fs(self.path(name))
            fs.delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named, as in tests on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="mathloom-")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans whose results stand in scratch tables.

    The cleaner follows the driver's garbage collection; the second turn finds what Python let go of in the first.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def safe_id(column: str) -> Column:
    """An id with NULL_ID for null, which is equal to the smallest long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(int(NULL_ID)))


def null_id(column: str | Column) -> Column:
    """An id as it was before `safe_id`."""
    return F.nullif(column, F.lit(int(NULL_ID)))


def hot_rows(spark: SparkSession, total: int) -> int:
    """Rows of a key from which it is hot. Of `total` rows at most _HOT_SHARE * partitions keys can have more."""
    return max(1, total // (_HOT_SHARE * partitions(spark)))


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str) -> DataFrame:
    """Inner join of rows with one row a key, `size` being at least the number of the key's rows.

    Keys with many rows are broadcast: there are at most _HOT_SHARE times as many as partitions (`hot_rows`). The rows of the others
    are shuffled. Both tables are read more than once, so they should be written ones.
    """
    spark = rows.sparkSession
    limit = hot_rows(spark, groups.agg(F.sum(size)).first()[0] or 0)
    hot = groups.filter(F.col(size) > limit)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def join_salted(rows: DataFrame, groups: DataFrame, key: str, size: str, salt_by: str) -> DataFrame:
    """As `join_groups` for groups that hold texts or payloads of any length: nothing but hot keys and their numbers of parts is broadcast.

    The rows of a hot key are dealt out to parts by the hash of a column, and its group is copied for each part. There are at most
    2 * _HOT_SHARE * partitions such copies.
    """
    spark = rows.sparkSession
    limit = hot_rows(spark, groups.agg(F.sum(size)).first()[0] or 0)
    parts = F.ceil(F.col(size) / limit).cast("int")
    hot = groups.filter(F.col(size) > limit).select(key, parts.alias("_parts"))
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return dealt.join(salted, [key, "_salt"]).drop("_salt")


def each_copy(rows: DataFrame, copies: str = "copies", number: str = "copy") -> DataFrame:
    """Every row as often as `copies` says, numbered from 0. Rows with very many copies are spread over tasks."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / _COPIES_AT_ONCE)))
    many = rows.filter(F.col(copies) > _COPIES_AT_ONCE).withColumn("_block", block).repartition(partitions(rows.sparkSession))
    blocks = rows.filter(F.col(copies) <= _COPIES_AT_ONCE).withColumn("_block", F.lit(0).cast("long")).unionByName(many)
    first = F.col("_block") * _COPIES_AT_ONCE
    return blocks.select("*", F.explode(F.sequence(first, F.least(F.col(copies), first + _COPIES_AT_ONCE) - 1)).alias(number)).drop("_block")


def letters_and_digits(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and all but digits, letters and non-ASCII bytes as spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_LOWER_KEEP)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


class Rolling:
    """Karp-Rabin hashes of the runs of a sequence of 64-bit word hashes: one pass, then each run of any length costs a difference.

    With prefix sums S of word[j] * base^-j, a run from i of n words has the hash (S[i + n] - S[i]) * base^i modulo 2^64.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        ones = np.ones(n, np.uint64)
        power = lambda x: np.cumprod(np.concatenate(([U64(1)], ones[1:] * U64(x)))) if n else ones
        self.sums = np.concatenate(([U64(0)], np.cumsum(words * power(_INVERSE), dtype=np.uint64)))
        self.shift = power(_BASE)

    def runs(self, n: int) -> np.ndarray:
        """Hashes of all runs of n words."""
        if n >= len(self.sums):
            return np.empty(0, np.uint64)
        return mix64((self.sums[n:] - self.sums[: len(self.sums) - n]) * self.shift[: len(self.sums) - n])

    def at(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of runs with any starts and lengths (at least 1)."""
        return mix64((self.sums[start + n] - self.sums[start]) * self.shift[start])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; empty if there are fewer words."""
    return Rolling(words).runs(n)


def true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def cover(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Flags of the positions below length that a window of that width from one of the starts covers."""
    delta = np.zeros(length + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, length), -1)
    return np.cumsum(delta[:-1]) > 0
