"""Jaccard self-join of documents over word n-grams as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct n-gram sets (documents with equal sets are one row), columns are n-grams.
Linked rows have nearly equal sizes and a large overlap, which allows to multiply little of the matrix:

1. Columns are ordered by hash, but those known to be in many rows come last. Of n columns a row only needs its first
   n - ceil(t n) + 1, as linked rows must share one of those; as these are columns of small hashes, only such are counted. The products of these columns are summed up into counts for pairs of rows, in blocks of columns.
   A pair goes on if its sizes and its count still allow for the overlap that its sizes ask for.
2. Columns with very many rows aren't multiplied there: rows that hang together by them are dealt out to tiles, blocks
   of rows by blocks of rows, of sizes that can link.
3. The whole rows of the pairs and tiles are multiplied, again in blocks of columns, and the exact overlaps compared with the
   bound.

Tiles return a spanning forest of their links and the number of links of each row, so that a large group of near copies
isn't written out as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .exact_dedup import one_of_each
from .shared import NULL_ID, U64, Scratch, WordHashes, free_shuffles, gram_hashes, join_groups, mix64, null_id, partitions, safe_id
from .substring_dedup import chunks


@dataclass(frozen=True)
class Rule:
    """Words of an n-gram; two sets link when denominator * overlap >= numerator * union."""

    n: int
    numerator: int
    denominator: int = 100


#: What op3_ngram_join and what the pipeline's stage hold near copies by.
QUERY, STAGE = Rule(4, 85), Rule(5, 80)
#: Rows of a column from which it is left to the tiles; rows of a tile's side; columns multiplied at once.
HOT_ROWS = 64
TILE_ROWS = 1000
TILE_COLUMNS = 2048
#: Bits of the filter by which tasks skip documents that no pair or tile asks for (1 MB); what it lets through is joined exactly.
FILTER_BITS = 1 << 23
#: Bytes of text for each bucket of columns, whose entries take at most about as many.
BUCKET_BYTES = 64_000_000
#: Share of the hashes whose columns are counted; rows from which a column is frequent; frequent columns that tasks hold to
#: order rows by, 16 bytes each. Any other column counts as rare, which costs time, not links.
COUNTED = 0.3
FREQUENT_ROWS = 16
MOST_FREQUENT = 200_000

#: kind 0: a document; kind 1: the columns of a block of documents with their numbers of rows.
SETS = "bucket long, kind int, doc_id long, n long, sig long, columns binary, counts binary"
_SETS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("columns", pa.binary()), ("counts", pa.binary())])
#: kind 0: a document; kind 1: a frequent column (sig) with its number of rows (n).
COUNTS = "kind int, doc_id long, n long, sig long"
ENTRIES = "bucket long, columns binary, sigs binary, sizes binary"
_ENTRIES = pa.schema([("bucket", pa.int64()), ("columns", pa.binary()), ("sigs", pa.binary()), ("sizes", pa.binary())])
#: kind 0: a pair with the columns that it shares; kind 1: a row (a) of a hot column (b).
PAIRS = "kind int, a long, b long, size_a long, size_b long, shared long"
_PAIRS = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("a", "b", "size_a", "size_b", "shared"))])
ROWS = "doc_id long, sig long, grams binary"
#: kind 0: a link; kind 1: row a has b links to other rows, counted in documents.
LINKS = "kind int, a long, b long"
_LINKS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def grams_of(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a document's word hashes; of fewer words the whole sequence is one n-gram."""
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64)


def signature(grams: np.ndarray) -> int:
    """63-bit name of a set."""
    if not len(grams):
        return -1
    both = np.array([np.bitwise_xor.reduce(mix64(grams)), np.add.reduce(mix64(grams ^ U64(0x5851F42D4C957F2D)))], np.uint64)
    return int(gram_hashes(both, 2)[0] >> U64(1))


def needed(a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """The smallest overlap with which sets of these sizes link."""
    return -(-rule.numerator * (a + b) // (rule.numerator + rule.denominator))


def first_columns(n, rule: Rule):
    """Columns that a row of this size needs in step 1."""
    return n - -(-rule.numerator * n // rule.denominator) + 1


def _all_grams(texts: list[str | None], cache: WordHashes, n: int) -> list[np.ndarray]:
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat, ends = cache.of([w for own in words for w in own]), np.cumsum([len(w) for w in words])
    return [grams_of(flat[e - len(w) : e], n) for w, e in zip(words, ends)]


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its entries."""
    order = np.argsort(bucket, kind="stable")
    own, starts = np.unique(bucket[order], return_index=True)
    return zip(own.tolist(), np.split(order, starts[1:]))


def _sets(n_buckets: int, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, most = WordHashes(), U64(int(COUNTED * 2**64))
        for batch in batches:
            for ids, texts in chunks(batch):
                grams = _all_grams(texts, cache, rule.n)
                sigs = [signature(g) for g in grams]
                rows = [(int(k), 0, int(i), len(g), s, None, None) for k, i, g, s in zip(mix64(ids.view(np.uint64)) % U64(n_buckets), ids, grams, sigs)]
                # small sets may begin with columns of any hash
                low = [g[: max(np.searchsorted(g, most), first_columns(len(g), rule))] for g in dict(zip(sigs, grams)).values()]
                column, count = np.unique(np.concatenate([np.empty(0, np.uint64), *low]), return_counts=True)
                bucket = (mix64(column) % U64(n_buckets)).astype(np.int64)
                rows += ((k, 1, None, None, None, column[o].tobytes(), count[o].astype(np.int32).tobytes()) for k, o in _dealt(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SETS)], schema=_SETS)

    return run


def _count_columns(table: pa.Table) -> pa.Table:
    """The documents as they are, and the frequent ones of a bucket's columns."""
    kind = table.column("kind").to_numpy()
    blocks = table.filter(pa.array(kind == 1))
    read = lambda c, t: np.concatenate([np.empty(0, t), *(np.frombuffer(x.as_buffer(), t) for x in blocks.column(c))])
    column, where = np.unique(read("columns", np.uint64), return_inverse=True)
    rows = np.bincount(where, read("counts", np.int32), len(column)).astype(np.int64)
    column, rows = column[rows >= FREQUENT_ROWS].view(np.int64), rows[rows >= FREQUENT_ROWS]
    documents = table.filter(pa.array(kind == 0)).select(["kind", "doc_id", "n", "sig"])
    frequent = pa.table([pa.array(np.ones(len(column), np.int32)), pa.nulls(len(column), pa.int64()), pa.array(rows), pa.array(column)], schema=documents.schema)
    return pa.concat_tables([documents, frequent])


def rare_first(grams: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row's columns in the common order: by their count among the frequent ones, then by hash."""
    if not len(frequent):
        return grams
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    return grams[np.argsort(np.where(frequent[at] == grams, counts[at], 0), kind="stable")]


def _entries(n_buckets: int, frequent: np.ndarray, counts: np.ndarray, rule: Rule):
    """Entries by bucket of columns; those of columns known to be hot, which aren't multiplied, by buckets of rows from n_buckets on."""
    hot = frequent[counts >= HOT_ROWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for _, texts in chunks(batch):
                rows = {signature(g): g for g in _all_grams(texts, cache, rule.n) if len(g)}
                if not rows:
                    continue
                first = [rare_first(g, frequent, counts)[: first_columns(len(g), rule)] for g in rows.values()]
                lengths = [len(f) for f in first]
                column = np.concatenate(first)
                sig, size = np.repeat(np.array(list(rows), np.int64), lengths), np.repeat(np.array([len(g) for g in rows.values()], np.int32), lengths)
                bucket = (mix64(column) % U64(n_buckets)).astype(np.int64)
                known = np.isin(column, hot)
                bucket[known] = n_buckets + (mix64(sig[known].view(np.uint64)) % U64(n_buckets)).astype(np.int64)
                out = [(k, column[o].tobytes(), sig[o].tobytes(), size[o].tobytes()) for k, o in _dealt(bucket)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ENTRIES)], schema=_ENTRIES)

    return run


def _multiply_columns(n_buckets: int, rule: Rule):
    """Products of one bucket's columns, summed up for pairs of rows; hot columns are passed on."""

    def run(table: pa.Table) -> pa.Table:
        column, sig, size = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("columns", np.uint64), ("sigs", np.int64), ("sizes", np.int32)))
        order = np.lexsort((sig, column))
        column, sig, size = column[order], sig[order], size[order].astype(np.int64)
        new = np.concatenate(([True], (column[1:] != column[:-1]) | (sig[1:] != sig[:-1])))  # a set found in two blocks is one row
        column, sig, size = column[new], sig[new], size[new]
        starts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        n = np.diff(np.append(starts, len(column)))
        is_hot = (n >= HOT_ROWS) | (table.column("bucket")[0].as_py() >= n_buckets)
        out = [(np.empty(0, np.int64),) * 4]
        for width in np.unique(n[(n > 1) & ~is_hot]):
            at = starts[(n == width) & ~is_hot]
            i, j = np.triu_indices(width, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            fits = rule.denominator * np.minimum(size[a], size[b]) >= rule.numerator * np.maximum(size[a], size[b])
            a, b = a[fits], b[fits]
            out.append((sig[a], sig[b], size[a], size[b]))
        a, b, size_a, size_b = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((b, a))
        a, b, size_a, size_b = a[order], b[order], size_a[order], size_b[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
        shared = np.diff(np.append(first, len(a)))
        hot = np.repeat(is_hot, n)
        zero, ones = np.zeros(hot.sum(), np.int64), np.ones(hot.sum(), np.int64)
        columns = (np.concatenate([np.zeros(len(first), np.int32), ones.astype(np.int32)]), np.concatenate([a[first], sig[hot]]), np.concatenate([b[first], column[hot].view(np.int64)]), np.concatenate([size_a[first], size[hot]]), np.concatenate([size_b[first], zero]), np.concatenate([shared, zero]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIRS)], schema=_PAIRS)

    return run


def _rows(wanted: dict[int, bytes], rule: Rule):
    """Sets of the documents whose bit is set; `wanted` holds the bitmap by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, size = WordHashes(), 8 * max(map(len, wanted.values()), default=1)
        for batch in batches:
            place = batch.column(2).to_numpy() - 1
            bucket, bit = place // size + 1, place % size
            keep = [int(b) in wanted and bool(wanted[int(b)][x >> 3] >> (x & 7) & 1) for b, x in zip(bucket, bit)]
            for ids, texts in chunks(batch.filter(pa.array(keep, pa.bool_()))):
                grams = _all_grams(texts, cache, rule.n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([signature(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], names=["doc_id", "sig", "grams"])

    return run


def _place(c: str):
    """The bit of an id, from 1 to FILTER_BITS."""
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1


def _bitmap(ids: DataFrame) -> dict[int, bytes]:
    """Bits of the ids by bucket: at most FILTER_BITS / 8 bytes, whatever the number of ids."""
    bits = ids.select(_place("doc_id").alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    return {r["bucket"]: bytes(r["bits"]) for r in bits.collect()}


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of the overlaps of two lists of sets, summed up over blocks of columns."""
    row = np.repeat(np.arange(len(left) + len(right)), [len(g) for g in (*left, *right)])
    values, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    n_left = len(left)
    # only columns that both sides have add to the product
    both = np.zeros(len(values), bool)
    both[column[row < n_left]] = True
    other = np.zeros(len(values), bool)
    other[column[row >= n_left]] = True
    number = np.where(both & other, np.cumsum(both & other) - 1, -1)[column]
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    total = np.zeros((n_left, len(right)), np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, TILE_COLUMNS):
        a, b = np.searchsorted(number, (low, low + TILE_COLUMNS))
        block = np.zeros((n_left + len(right), TILE_COLUMNS), np.float32)
        block[row[a:b], number[a:b] - low] = 1
        total += block[:n_left] @ block[n_left:].T
    return total


def forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a bipartite link matrix, as (row, column)."""
    rows, columns = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)  # not reached yet
    for start in np.flatnonzero(linked.any(axis=1)):
        if not rows[start]:
            continue
        rows[start] = False
        ahead = [(0, start)]
        while ahead:
            side, i = ahead.pop()
            line, left = (linked[i], columns) if side == 0 else (linked[:, i], rows)
            new = np.flatnonzero(line & left)
            left[new] = False
            yield from ((i, j) if side == 0 else (j, i) for j in map(int, new))
            ahead += [(1 - side, int(j)) for j in new]


def _multiply_tiles(rule: Rule):
    """Exact overlaps within tiles. side 0 rows are held against side 1 rows; side 2 rows against each other."""

    def run(table: pa.Table) -> pa.Table:
        tile, side, sig, size, count = (table.column(c).to_numpy() for c in ("tile", "side", "sig", "n", "copies"))
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in table.column("grams")]
        order = np.lexsort((sig, side, tile))
        a, b = order[1:], order[:-1]
        order = order[np.concatenate(([True], (sig[a] != sig[b]) | (side[a] != side[b]) | (tile[a] != tile[b])))]  # repeated rows of a document
        cuts = np.flatnonzero(np.diff(tile[order])) + 1
        links, counts = [], {}
        for a, b in zip([0, *cuts], [*cuts, len(order)]):
            own = order[a:b]
            left, right = own[side[own] != 1], own[side[own] != 0]
            if not len(left) or not len(right):
                continue
            total = overlaps([grams[i] for i in left], [grams[i] for i in right])
            linked = total >= needed(size[left][:, None], size[right][None, :], rule)
            linked &= sig[left][:, None] != sig[right][None, :]
            links += ((0, int(sig[left[i]]), int(sig[right[j]])) for i, j in forest(linked))
            for s, c in zip((*sig[left], *(() if side[own[0]] == 2 else sig[right])), (*(linked @ count[right]), *(() if side[own[0]] == 2 else linked.T @ count[left]))):
                if c:
                    counts[int(s)] = counts.get(int(s), 0) + int(c)
        rows = [*links, *((1, s, c) for s, c in counts.items())]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _LINKS)], schema=_LINKS)

    return run


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    top = sets.filter("kind = 1").select("sig", "n").orderBy(F.desc("n"), "sig").limit(MOST_FREQUENT).toPandas()
    column = top["sig"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(column)
    return column[order], top["n"].to_numpy(np.int64)[order]


def _dense(rows: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    """Tiles of the groups' rows (sig, group, n). Rows that link are in the same band of sizes or in neighbouring ones.

    Groups and bands may hold a large share of the rows, so what is known of them is joined by `join_groups`.
    """
    rows = scratch.save(rows, "hot-rows")
    sizes = scratch.save(rows.groupBy("group").agg(F.count("*").alias("rows")), "hot-groups")
    wide = math.log(rule.denominator / rule.numerator) * 1.0001
    band = F.when(F.col("rows") <= TILE_ROWS, 0).otherwise(F.floor(F.log("n") / wide)).cast("int")
    rows = scratch.save(join_groups(rows, sizes, "group", "rows").select("sig", "group", band.alias("band")), "hot-bands")
    blocks = rows.groupBy("group", "band").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("blocks"))
    # the bands that a band is held against, three at most, with their numbers of blocks
    steps = blocks.select("group", "band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("other_band"))
    near = steps.join(blocks.select("group", F.col("band").alias("other_band"), F.col("blocks").alias("others")), ["group", "other_band"])
    near = near.groupBy("group", "band").agg(F.collect_list(F.struct("other_band", "others")).alias("near"))
    rows = join_groups(rows, scratch.save(blocks.join(near, ["group", "band"]), "hot-near"), ["group", "band"], "rows")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("near", F.explode("near"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("near.others") - 1)))
    own, other = F.struct("band", "block"), F.struct(F.col("near.other_band").alias("band"), F.col("other").alias("block"))
    tile = F.xxhash64(F.lit("rows"), "group", F.least(own, other), F.greatest(own, other))
    side = F.when(own == other, 2).when(own < other, 0).otherwise(1)
    return rows.select(tile.alias("tile"), side.alias("side"), "sig")


def _tiles(pairs: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    """What is multiplied whole: (tile, side, sig)."""
    hot = pairs.filter("kind = 1").select("a", "b", "size_a")
    # rows that hang together by hot columns: a column is a node too, with a negative name
    edges = hot.select("a", (-1 - F.abs(F.xxhash64("b") / 2).cast("long")).alias("b"))
    group = connected_components(edges, scratch, "hot").filter("node >= 0").select(F.col("node").alias("sig"), F.col("component").alias("group"))
    dense = _dense(group.join(hot.groupBy(F.col("a").alias("sig")).agg(F.first("size_a").alias("n")), "sig"), scratch, rule)
    cold = pairs.filter("kind = 0").groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.sum("shared").alias("shared"))
    bound = F.ceil(F.lit(rule.numerator) * (F.col("size_a") + F.col("size_b")) / (rule.numerator + rule.denominator))
    rest = lambda c: F.ceil(F.lit(rule.numerator) * F.col(c) / rule.denominator) - 1
    # what two rows share lies in their first columns, or in the rest of the row whose first columns end earlier
    cold = cold.join(group.select(F.col("sig").alias("a"), F.col("group").alias("group_a")), "a", "left").join(group.select(F.col("sig").alias("b"), F.col("group").alias("group_b")), "b", "left")
    apart = F.coalesce(F.col("group_a") != F.col("group_b"), F.lit(True))
    both_hot = F.col("group_a").isNotNull() & F.col("group_b").isNotNull()
    cold = cold.filter(apart & (both_hot | (F.col("shared") + F.greatest(rest("size_a"), rest("size_b")) >= bound))).select("a", "b")
    cold = scratch.save(cold, "cold")
    of_a = F.xxhash64(F.lit("pairs"), "a")
    single = cold.select(of_a.alias("tile"), F.lit(1).alias("side"), F.col("b").alias("sig")).unionByName(cold.select(of_a.alias("tile"), F.lit(0).alias("side"), F.col("a").alias("sig")).distinct())
    return scratch.save(dense.unionByName(single), "tiles")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = QUERY) -> DataFrame:
    """A row per input row: doc_id, n_shingles (size of its set), component_id (smallest id that links lead to, itself included),
    n_links (other rows that it links with).

    Words stand between ASCII white space, A-Z lower-cased. Null and empty texts have no n-grams and link with nothing;
    equal non-empty sets link. A null id is smaller than any other, so a component with one has a null name. Repeated rows
    are rows of their own that link. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    rows = docs.select(safe_id(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_buckets = max(2 * partitions(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    sets = scratch.save(rows.mapInArrow(_sets(n_buckets, rule), SETS).groupBy("bucket").applyInArrow(_count_columns, COUNTS), "sets")
    free_shuffles(spark)
    frequent, counts = _frequent(sets)
    documents = sets.filter("kind = 0").select("doc_id", "n", "sig")
    classes = scratch.save(documents.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes")
    pairs = scratch.save(rows.mapInArrow(_entries(n_buckets, frequent, counts, rule), ENTRIES).groupBy("bucket").applyInArrow(_multiply_columns(n_buckets, rule), PAIRS), "pairs")
    free_shuffles(spark)
    tiles = _tiles(pairs, scratch, rule)
    scratch.drop("pairs", "cold")
    named = tiles.join(classes, "sig").select(F.col("first_id").alias("doc_id"), "sig", "n", "copies", "tile", "side")
    named = scratch.save(named, "named-tiles")
    whole = rows.withColumn("place", _place("doc_id")).mapInArrow(_rows(_bitmap(named), rule), ROWS)
    spread = F.pmod(F.xxhash64("tile"), F.lit(8 * n_buckets))
    links = named.join(whole, ["doc_id", "sig"]).withColumn("task", spread).groupBy("task").applyInArrow(_multiply_tiles(rule), LINKS)
    links = scratch.save(links, "links")
    free_shuffles(spark)
    scratch.drop("named-tiles", "tiles")
    component = connected_components(links.filter("kind = 0"), scratch, "links")
    named = classes.join(component, classes["sig"] == component["node"], "left").select("sig", "first_id", "copies", F.coalesce("component", "sig").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    degree = links.filter("kind = 1").groupBy(F.col("a").alias("sig")).agg(F.sum("b").alias("others"))
    named = named.join(least, "component").join(degree, "sig", "left").select("sig", "copies", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    named = scratch.save(named, "named")
    alone = documents.filter("n = 0").select("doc_id", "n", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    out = join_groups(documents.filter("n > 0"), named, "sig", "copies").select("doc_id", "n", "n_links", "component_id").unionByName(alone)
    return out.select(null_id("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), null_id("component_id").alias("component_id"), "n_links")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays, with all its columns; of rows that repeat its id and text, one.

    Null, empty and repeated rows as in `ngram_join`: texts without words all stay. An empty table gives an empty one.
    """
    found = ngram_join(docs, rule=STAGE).select(F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("id"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"))
    wanted = found.groupBy("id").agg(F.count("*").alias("copies"), F.max("first").alias("first")).filter("first").select("id", "copies")
    wanted = Scratch(spark, "kept").save(wanted, "kept")
    rows = docs.select(safe_id("doc_id").alias("id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("sha"), F.struct("*").alias("row"))
    return one_of_each(rows, wanted, ["id"]).select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
     r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
     c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
     d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.a = doc_id LEFT JOIN d ON d.a = doc_id
"""
