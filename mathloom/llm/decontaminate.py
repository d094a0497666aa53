"""Benchmark decontamination by greedy string tiling.

1. Seeds, the hashes of all runs of MIN_MATCH words, of the benchmark items are a table. Documents send those of their seeds that pass a
   filter of fixed size over the items' seeds; a join on the seed gives candidate pairs. An item that leaks shares at least a
   certain number of its seeds, so of each item as many of the most frequent ones, less one, are left out of the join.
2. Each candidate pair is tiled: running Karp-Rabin hashes find the longest common runs of words in which no word is used yet,
   these become tiles, then shorter runs, down to MIN_MATCH words. Tiles may stand in any order in the document, so a passage
   whose sentences were reordered is still caught. An item of which a large enough share is tiled has leaked.

Equal texts are one candidate, named by their SHA-256.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Rolling, Scratch, WordHashes, hot_rows, join_groups, join_salted, letters_and_digits

#: Words of the shortest tile; the share of an item's words in tiles from which it counts as leaked.
MIN_MATCH = 5
MIN_COVERAGE = 0.5
#: The length that the search for tiles starts from.
FIRST_LENGTH = 24
#: Bits of the filter over seeds that tasks hold (1 MB); places of the filter over texts, at most so many rows to broadcast.
FILTER_BITS = 1 << 23
TEXT_PLACES = 1 << 20
#: Items that are tiled against a text at once.
ITEMS_AT_ONCE = 64

SCHEMA = "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long"
_SEEDS = pa.schema([("key", pa.binary()), ("seed", pa.int64())])
_LEAKS = pa.schema([("digest", pa.binary()), ("item", pa.binary()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64())])


def _free_ahead(used: np.ndarray) -> np.ndarray:
    """For each word the number of unused ones from it on."""
    at = np.arange(len(used))
    stop = np.where(used, at, len(used))
    return np.minimum.accumulate(stop[::-1])[::-1] - at if len(used) else at


def longest_matches(p: np.ndarray, t: np.ndarray, roll_p: Rolling, roll_t: Rolling, used_p: np.ndarray, used_t: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """All common runs of at least `length` unused words that can't be extended: (words, place in p, place in t)."""
    free_p, free_t = _free_ahead(used_p), _free_ahead(used_t)
    at_p, at_t = np.flatnonzero(free_p >= length), np.flatnonzero(free_t >= length)
    hash_p, hash_t = roll_p.runs(length)[at_p], roll_t.runs(length)[at_t]
    shared = np.isin(hash_t, hash_p)
    at_t, hash_t = at_t[shared], hash_t[shared]
    # a run that goes on to the left is found from there; a word before it that is used, or none, ends it
    open_before = lambda used, at: (at > 0) & ~used[at - 1]
    before_p, before_t = open_before(used_p, at_p), open_before(used_t, at_t)
    starts: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for i, h, o in zip(at_p.tolist(), hash_p.tolist(), before_p.tolist()):
        starts[h][int(p[i - 1]) if o else None].append(i)
    starts = {h: {word: np.array(own) for word, own in groups.items()} for h, groups in starts.items()}
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for j, h, o in zip(at_t.tolist(), hash_t.tolist(), before_t.tolist()):
        word = int(t[j - 1]) if o else None
        for other, own in starts[h].items():
            if word is None or other != word:
                left.append(own)
                right.append(np.full(len(own), j))
    i, j = np.concatenate(left), np.concatenate(right)
    # the longest equal run from each pair, by halving over the running hashes
    low, high = np.full(len(i), length), np.minimum(free_p[i], free_t[j])
    while (low < high).any():
        middle = (low + high + 1) // 2
        equal = roll_p.at(i, middle) == roll_t.at(j, middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    return [(n, a, b) for n, a, b in zip(low.tolist(), i.tolist(), j.tolist()) if np.array_equal(p[a : a + n], t[b : b + n])]


def tiles(pattern: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH, first: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (words, place in pattern, place in text), longest first.

    Of equally long runs the one that starts first in the pattern, then in the text, becomes a tile.
    """
    roll_p, roll_t = Rolling(pattern), Rolling(text)
    used_p, used_t, out = np.zeros(len(pattern), bool), np.zeros(len(text), bool), []
    length = max(min_match, min(first, len(pattern)))
    while True:
        queue = [(-n, i, j) for n, i, j in longest_matches(pattern, text, roll_p, roll_t, used_p, used_t, length)]
        heapq.heapify(queue)
        while queue:
            n, i, j = heapq.heappop(queue)
            n = -n
            # tiles so far are at least as long, so one that overlaps holds the first or the last word
            if not (used_p[i] or used_t[j] or used_p[i + n - 1] or used_t[j + n - 1]):
                used_p[i : i + n] = used_t[j : j + n] = True
                out.append((n, i, j))
                continue
            taken = np.flatnonzero(used_p[i : i + n] | used_t[j : j + n])
            for a, b in zip([0, *(taken + 1)], [*taken, n]):
                if b - a >= length:
                    heapq.heappush(queue, (int(a - b), int(i + a), int(j + a)))
        if length == min_match:
            return sorted(out, key=lambda m: (-m[0], m[1], m[2]))
        length = max(min_match, length // 2)


def leak_of(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int] | None:
    """(share of the item's words in tiles, tiles, longest tile) if the item, of MIN_MATCH words or more, has leaked."""
    found = tiles(item, text)
    share = sum(n for n, _, _ in found) / len(item)
    return (share, len(found), found[0][0]) if found and share >= MIN_COVERAGE else None


def words_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of(letters_and_digits(text).split())


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seed, n) for every seed of an item; n is the item's number of words."""
    hashes, schema = WordHashes(), pa.schema([*_SEEDS, ("n", pa.int64())])
    for batch in batches:
        keys, seeds, sizes = [], [np.empty(0, np.uint64)], []
        for key, text in zip(*batch.columns):
            words = words_of(text.as_py(), hashes)
            own = Rolling(words).runs(MIN_MATCH)
            keys += [key.as_py()] * len(own)
            sizes += [len(words)] * len(own)
            seeds.append(own)
        yield _rows([keys, np.concatenate(seeds).view(np.int64), sizes], schema)


def _text_seeds(wanted: dict[int, bytes]):
    """(key, seed) for the distinct seeds of a text that pass the filter; key is the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), np.zeros(FILTER_BITS // 8, np.uint8)
        for bucket, part in wanted.items():
            low = (bucket - 1) * len(part)
            bits[low : low + len(part)] = np.frombuffer(part, np.uint8)[: len(bits) - low]
        for batch in batches:
            keys, seeds = [], [np.empty(0, np.uint64)]
            for text in batch.column(0):
                own = np.unique(Rolling(words_of(text.as_py(), hashes)).runs(MIN_MATCH))
                place = (own & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                own = own[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                if len(own):
                    keys += [hashlib.sha256((text.as_py() or "").encode("utf-8", "surrogatepass")).digest()] * len(own)
                    seeds.append(own)
            yield _rows([keys, np.concatenate(seeds).view(np.int64)], _SEEDS)

    return run


def _filter(seeds: DataFrame) -> dict[int, bytes]:
    """Bits of the seeds by bucket: FILTER_BITS in all, whatever the number of items."""
    place = seeds.select((F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("x"))
    bits = place.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    return {r["bucket"]: bytes(r["bits"]) for r in bits.collect()}


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for digest, text, items in zip(*batch.columns):
            words = words_of(text.as_py(), hashes)
            for item in items.as_py():
                if found := leak_of(words_of(item["words"], hashes), words):
                    rows.append((digest.as_py(), item["item"], *found))
        yield _rows([*zip(*rows)] if rows else [[]] * len(_LEAKS), _LEAKS)


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def _place(digest: str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(TEXT_PLACES)).alias("place")


def _candidates(texts: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (digest, item) that can reach the coverage."""
    spark = texts.sparkSession
    own = texts.select("text").mapInArrow(_text_seeds(_filter(seeds)), "key binary, seed long")
    own = scratch.save(own.distinct().withColumnRenamed("key", "digest").join(seeds.select("seed").distinct(), "seed", "left_semi"), "text-seeds")
    count = own.groupBy("seed").agg(F.count("*").alias("texts"))
    # tiles of at least MIN_MATCH words that cover enough of n words hold at least this many of the item's seeds
    least = F.ceil(F.ceil(F.col("n") * MIN_COVERAGE) / MIN_MATCH)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("texts"), "seed"))
    used = scratch.save(seeds.join(count, "seed").withColumn("rank", rank).withColumn("least", least), "used-seeds")
    # seeds that no text has count as the least frequent ones: the most frequent `least` - 1 of an item aren't needed
    used = used.filter(F.col("rank") >= F.col("least")).select("seed", F.col("key").alias("item"), "texts").distinct()
    limit = hot_rows(spark, own.count())
    parts = F.ceil(F.col("texts") / limit).cast("int")
    hot = F.broadcast(count.filter(F.col("texts") > limit).select("seed", parts.alias("salts")))
    dealt = own.join(hot, "seed", "left").withColumn("salt", F.pmod(F.xxhash64("digest"), F.coalesce("salts", F.lit(1))).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))
    return dealt.join(used.withColumn("salt", spread), ["seed", "salt"]).select("digest", "item").distinct()


def _leaks(texts: DataFrame, benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(digest, item, coverage, n_tiles, longest_tile) of distinct texts and items, and the items with the number of their rows."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("words"))
    items = items.groupBy("item_id", "words").agg(F.count("*").alias("rows"))
    items = scratch.save(items.withColumn("item", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "words"), 256))), "items")
    seeds = scratch.save(items.select("item", "words").mapInArrow(_item_seeds, "key binary, seed long, n long"), "item-seeds")
    pairs = scratch.save(_candidates(texts, seeds, scratch), "pairs")
    asked = pairs.groupBy("item").agg(F.count("*").alias("texts")).join(items.select("item", "words"), "item")
    pairs = join_salted(pairs, scratch.save(asked, "asked"), "item", "texts", "digest")
    # a text meets its items in parts of about ITEMS_AT_ONCE
    parts = F.ceil(F.count("*").over(Window.partitionBy("digest")) / ITEMS_AT_ONCE)
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("item"), parts)).groupBy("digest", "part").agg(F.collect_list(F.struct("item", "words")).alias("items"))
    pairs = scratch.save(pairs, "work")
    places = F.broadcast(pairs.select(_place("digest")).distinct())  # at most TEXT_PLACES rows
    held = texts.select(_digest("text").alias("digest"), "text").withColumn("place", _place("digest")).join(places, "place", "left_semi")
    held = held.groupBy("digest").agg(F.first("text").alias("text"))
    found = held.join(pairs, "digest").select("digest", "text", "items").mapInArrow(_tile, "digest binary, item binary, coverage double, n_tiles long, longest_tile long")
    found = scratch.save(found, "leaks")
    scratch.drop("item-seeds", "text-seeds", "used-seeds", "asked", "work", "pairs")
    return found, items.select("item", "item_id", "rows")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item of which at least MIN_COVERAGE is tiled: doc_id, item_id, coverage, tiles, longest tile.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Items of fewer than MIN_MATCH words are too
    short to tell, null and empty ones match nothing, nor do such documents. Null ids are reported as null; repeated rows of
    either table each give their rows; ties between tiles go to the first place in the item, then in the text. Texts of any length
    are tiled whole. Empty tables give an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "tiles")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, items = _leaks(rows, benchmark, scratch)
    found = found.join(items, "item").withColumn("row", F.explode(F.expr("sequence(1, rows)"))).drop("row", "rows", "item")
    places = F.broadcast(found.select(_place("digest")).distinct())
    own = rows.select("doc_id", _digest("text").alias("digest")).withColumn("place", _place("digest")).join(places, "place", "left_semi").select("doc_id", "digest")
    own = scratch.save(own, "rows")
    listed = found.groupBy("digest").agg(F.collect_list(F.struct("item_id", "coverage", "n_tiles", "longest_tile")).alias("leaks"))
    listed = scratch.save(own.groupBy("digest").agg(F.count("*").alias("n")).join(listed, "digest"), "listed")
    out = join_groups(own, listed, "digest", "n").select("doc_id", F.explode("leaks").alias("leak"))
    return out.select("doc_id", "leak.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns.

    Null and empty texts, repeated rows and empty tables as in `leaks`: what matches nothing stays. Only documents that share a place
    of the filter with a leaking text are shuffled.
    """
    scratch = Scratch(spark, "tiles")
    found, _ = _leaks(docs.select(F.col("text").cast("string").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)
    bad = found.select(F.col("digest").alias("_digest")).distinct()
    places = F.broadcast(bad.select(_place("_digest").alias("_place")).distinct())
    rows = docs.select(F.struct("*").alias("row"), _digest("text").alias("digest")).withColumn("place", _place("digest"))
    clear = rows.join(places, rows["place"] == places["_place"], "left_anti")
    doubtful = rows.join(places, rows["place"] == places["_place"], "left_semi")
    doubtful = doubtful.join(bad, doubtful["digest"] == bad["_digest"], "left_anti")
    return clear.select("row.*").unionByName(doubtful.select("row.*"))
