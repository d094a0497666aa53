"""Exact deduplication by a minimal perfect hash over the digests of a historical corpus.

The index has one row per bucket of digests. Within a bucket of n digests a two-level hash sends each digest to its own
slot of n: the digest picks one of the displacement cells, and the cell's value either names the slot (cells with one
digest) or seeds the hash that gives it. A slot holds the full 32-byte digest, the winner's id and the number of rows.
A lookup compares all 32 bytes, so a digest that isn't in the history never passes for another; those are grouped among
themselves. Only distinct digests, pre-aggregated, are looked up, so a text with any number of copies costs one lookup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, each_copy, hot_rows, join_groups, mix64, null_id, safe_id

INDEX_SCHEMA = "bucket long, n long, cells binary, digests binary, winners binary, sizes binary"
_INDEX = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("cells", "digests", "winners", "sizes"))])
GROUP_SCHEMA = "digest binary, keep_id long, group_size long"
_GROUPS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
#: Digests of a bucket on average: a bucket's index row stays near 200 kB however large the history is.
BUCKET_DIGESTS = 4096
#: Digests of a displacement cell on average. Cells with one digest take what is left, so the fewer digests a cell has, the
#: more slots are still free when the last cells with several are placed; with two, a seventh of them.
KEYS_PER_CELL = 2
_SEEDS_AT_ONCE = 64


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (id, text): doc_id (NULL_ID for null), digest, copies (rows that repeat both)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(safe_id(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))


def digest_groups(prints: DataFrame) -> DataFrame:
    """One row per digest: the largest id and the number of rows."""
    return prints.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = digests.view("<u8").reshape(-1, 4)
    return parts[:, 0], parts[:, 1], parts[:, 2]


def _slots(first: np.ndarray, second: np.ndarray, seed: int | np.ndarray, n: int) -> np.ndarray:
    return (mix64(first + np.asarray(seed, np.uint64) * (second | np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build_cells(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement cells and each digest's slot, for an (n, 32) array of distinct digests."""
    n = len(digests)
    first, second, third = _words(np.ascontiguousarray(digests))
    n_cells = n // KEYS_PER_CELL + 1
    cell = (third % np.uint64(n_cells)).astype(np.int64)
    members = np.split(np.argsort(cell, kind="stable"), np.cumsum(np.bincount(cell, minlength=n_cells))[:-1])
    cells, slot, taken = np.zeros(n_cells, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for c in sorted(range(n_cells), key=lambda c: -len(members[c])):
        rows = members[c]
        if len(rows) < 2:
            break
        seeds = np.arange(1, _SEEDS_AT_ONCE + 1, dtype=np.uint64)
        while True:
            at = _slots(first[rows], second[rows], seeds[:, None], n)
            apart = (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            fits = np.flatnonzero(apart & ~taken[at].any(axis=1))
            if len(fits):
                break
            seeds += np.uint64(_SEEDS_AT_ONCE)
        cells[c], slot[rows] = seeds[fits[0]], at[fits[0]]
        taken[slot[rows]] = True
    free = iter(np.flatnonzero(~taken))
    for c in range(n_cells):
        if len(members[c]) == 1:
            slot[members[c][0]] = at = next(free)
            cells[c] = -at - 1
    return cells, slot


def find_slots(digests: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """The slot that each digest has if it is a member; any slot otherwise."""
    first, second, third = _words(np.ascontiguousarray(digests))
    value = cells[(third % np.uint64(len(cells))).astype(np.int64)]
    return np.where(value < 0, -value - 1, _slots(first, second, np.maximum(value, 0).astype(np.uint64), n))


def _table(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(d.as_buffer() for d in digests), np.uint8).reshape(-1, 32)


def _build(table: pa.Table) -> pa.Table:
    digests, n = _table(table.column("digest")), table.num_rows
    cells, slot = build_cells(digests)
    held, winners, counts = np.empty_like(digests), np.empty(n, np.int64), np.empty(n, np.int64)
    held[slot], winners[slot], counts[slot] = digests, table.column("keep_id").to_numpy(), table.column("group_size").to_numpy()
    row = (table.column("bucket")[0].as_py(), n, cells.tobytes(), held.tobytes(), winners.tobytes(), counts.tobytes())
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEX)], schema=_INDEX)


def build_index(groups: DataFrame, n_digests: int) -> DataFrame:
    """Minimal perfect hash over distinct digests (`digest_groups` of the history), one row per bucket.

    n_digests, the larger number of digests of the history and of the batches to come, sizes the buckets.
    """
    return _bucketed(groups, _buckets(n_digests)).groupBy("bucket").applyInArrow(_build, INDEX_SCHEMA)


def _buckets(n_digests: int) -> int:
    return max(1, -(-n_digests // BUCKET_DIGESTS))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def _look_up(new: pa.Table, index: pa.Table) -> pa.Table:
    digests = _table(new.column("digest"))
    keep, size = new.column("keep_id").to_numpy(), new.column("group_size").to_numpy()
    if index.num_rows:
        cells, held, winners, counts = (np.frombuffer(index.column(c)[0].as_buffer(), t) for c, t in (("cells", np.int64), ("digests", np.uint8), ("winners", np.int64), ("sizes", np.int64)))
        held, n = held.reshape(-1, 32), len(winners)
        rest = np.ones(n, bool)
        if len(keep):
            slot = find_slots(digests, cells, n)
            member = (held[slot] == digests).all(axis=1)
            keep = np.where(member, np.maximum(keep, winners[slot]), keep)
            size = size + np.where(member, counts[slot], 0)
            rest[slot[member]] = False
        digests, keep, size = np.concatenate([digests, held[rest]]), np.concatenate([keep, winners[rest]]), np.concatenate([size, counts[rest]])
    return pa.Table.from_arrays([pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(keep, pa.int64()), pa.array(size, pa.int64())], schema=_GROUPS)


def merge_with_index(groups: DataFrame, index: DataFrame, n_digests: int) -> DataFrame:
    """Groups of the history and of a new batch together: digest, keep_id, group_size.

    n_digests is what the index was built with, which fixes its buckets.
    """
    return _bucketed(groups, _buckets(n_digests)).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_look_up, GROUP_SCHEMA)


def _grouped(docs: DataFrame, history: DataFrame | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, digest, copies) of all rows, and the groups of their digests."""
    scratch = Scratch(docs.sparkSession, "exact")
    if history is None:
        prints = scratch.save(fingerprints(docs, id_col, text_col), "prints")
        low, high = prints.filter(null_id("doc_id").isNotNull()).agg(F.min("doc_id"), F.max("doc_id")).first()
        middle = low + (high - low) // 2 if low is not None else 0
        old, new = prints.filter(F.col("doc_id") <= middle), prints.filter(F.col("doc_id") > middle)
    else:
        both = fingerprints(history, id_col, text_col).withColumn("old", F.lit(True)).unionByName(fingerprints(docs, id_col, text_col).withColumn("old", F.lit(False)))
        both = scratch.save(both, "both")
        old, new = both.filter("old"), both.filter("not old")
        prints = scratch.save(both.groupBy("doc_id", "digest").agg(F.sum("copies").alias("copies")), "prints")
    old, new = scratch.save(digest_groups(old), "old"), scratch.save(digest_groups(new), "new")
    n_digests = max(old.count(), new.count())
    index = scratch.save(build_index(old, n_digests), "index")
    groups = scratch.save(merge_with_index(new, index, n_digests), "groups")
    scratch.drop("both", "old", "new", "index")
    return prints, groups


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups rows with identical texts; of each group the row with the largest id stays.

    `history` holds earlier rows; without it the rows up to the middle of the id range count as history and the others
    as the new batch. Both are in the result: doc_id, keep_id, group_size, kept, text_sha256, a row per input row.

    Defined cases: a null text equals the empty one. A null id is smaller than any other (and equal to the smallest long). Of rows
    that repeat both id and text exactly one is kept. Long texts are hashed whole. Empty input gives an empty result; other
    columns are not read.
    """
    rows = each_copy(join_groups(*_grouped(docs, history, id_col, text_col), "digest", "group_size"))
    kept = (F.col("doc_id") == F.col("keep_id")) & (F.col("copy") == 0)
    return rows.select(null_id("doc_id").alias("doc_id"), null_id("keep_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the row with the largest id stays, one of those that repeat both, with all its columns.

    Null texts are empty ones, null ids the smallest; an empty table gives an empty one.
    """
    prints, groups = _grouped(docs, None, "doc_id", "text")
    winners = groups.select(F.col("keep_id").alias("doc_id"), "digest").join(prints, ["doc_id", "digest"])
    winners = Scratch(spark, "winners").save(winners.select(F.col("doc_id").alias("id"), F.col("digest").alias("sha"), "copies"), "winners")
    rows = docs.select(safe_id("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("sha"), F.struct("*").alias("row"))
    return one_of_each(rows, winners, ["id", "sha"]).select("row.*")


def one_of_each(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are wanted, one of those that agree in id and sha. `wanted` has distinct keys, and in `copies` at least
    the number of their rows.

    Of keys that very many rows have, of which there are few, each task sends one row on; the others are shuffled once.
    """
    limit = max(1, hot_rows(rows.sparkSession, wanted.agg(F.sum("copies")).first()[0] or 0))
    hot, cold = wanted.filter(F.col("copies") > limit).select(keys), wanted.filter(F.col("copies") <= limit).select(keys)
    of_hot = rows.join(F.broadcast(hot), keys, "left_semi").groupBy("id", "sha").agg(F.first("row").alias("row"))
    of_cold = rows.join(cold, keys, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.lit(1)))).filter("_n = 1")
    return of_cold.select("id", "sha", "row").unionByName(of_hot)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
