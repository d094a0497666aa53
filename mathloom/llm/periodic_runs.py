"""Maximal runs of words that repeat with a period, by branching tandem repeats in a suffix tree.

A repeat `uu` is branching if the word behind it differs from the one that its period asks for; then its two halves begin at leaves
that part at a node of string depth |u|. So it is enough to go through the nodes and, at each, through the leaves below all children
but the largest: for a leaf i at depth d, i + d and i - d are looked up in the rest of the node's leaf list. Every leaf is met at
most log n times. Shifting a branching repeat to the left, word by word, gives all repeats of its run; the repeats that shift into
one another, or have a multiple of the period, are one maximal run.

The tree isn't built with pointers: its leaf lists are ranges of the suffix array, its nodes are the places where the array of common
prefixes (LCP) has its range minima. A node with several children counts as a chain of nodes with two. Documents are taken some at a
time, as arrays; a suffix never crosses its document's end, and suffixes of different documents have nothing in common.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that are searched together; a longer document is searched alone.
BLOCK_WORDS = 1 << 18
#: Leaves that are looked up at once.
_LEAVES = 1 << 20
#: Common prefixes are compared so many words deep for all places at once, beyond that place by place.
_SHALLOW = 24

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])

#: (doc_id, words) -> the words to search.
Change = Callable[[int | None, list[bytes]], list[bytes]]


class _Ids(dict):
    """A number for each word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def suffix_array(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts of all suffixes, ordered by document, then by words; `end` is the end of each place's document.

    Prefix doubling: a round sorts only the places whose first words, as far as they have been compared, occur more than once.
    """
    n = len(words)
    place = np.arange(n)
    size = int(words.max(initial=0)) + 2
    key, seen = doc * size + words, 1
    if float(doc[-1] + 1) * size * size < 2.0**62:
        key, seen = key * size + np.where(place + 1 < end, np.append(words[1:], 0) + 1, 0), 2
    order = np.argsort(key)
    key = key[order]
    start = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    slots = place
    while True:
        own = start[slots]
        shared = np.zeros(len(slots), bool)
        shared[1:] = own[1:] == own[:-1]
        shared[:-1] |= shared[1:]
        slots = slots[shared]
        if not len(slots):
            return order
        suffix = order[slots]
        behind = suffix + seen
        key = start[slots] * (n + 1) + np.where(behind < end[suffix], rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[slots] = suffix
        start[slots] = rank[suffix] = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), slots, 0))
        seen *= 2


def _common(words: np.ndarray, i: int, j: int, most: int) -> int:
    """Equal words from i and j on."""
    at, step = 0, 64
    while at < most:
        differ = words[i + at : i + min(at + step, most)] != words[j + at : j + min(at + step, most)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + step, 2 * step
    return most


def common_prefixes(words: np.ndarray, doc: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix of the array the words that it has in common with the one before; 0 at both ends.

    A place's value is at least the one of the place before less one, and just that unless the words before the two suffixes differ;
    only those others are compared, and together they have O(n log n) words in common.
    """
    n = len(words)
    other = np.full(n, -1)
    other[order[1:]] = np.where(doc[order[1:]] == doc[order[:-1]], order[:-1], -1)
    place = np.arange(n)
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    own = first | (other < 0) | first[other] | (words[place - 1] != words[np.maximum(other, 0) - 1])
    value = np.zeros(n, np.int64)
    left = np.flatnonzero(own & (other >= 0))
    most = np.minimum(end[left] - left, end[left] - other[left])
    for depth in range(_SHALLOW):
        go = most > depth
        go[go] = words[left[go] + depth] == words[other[left[go]] + depth]
        left, most = left[go], most[go]
        value[left] = depth + 1
    for i, top in zip(left.tolist(), most.tolist()):
        value[i] = _common(words, i, int(other[i]), top)
    last = np.maximum.accumulate(np.where(own, place, 0))
    return np.append((value[last] - (place - last))[order], 0)


class LeastOf:
    """Minima of ranges of an array that ends with 0 on both sides, by windows of powers of two as long as stretches without a 0."""

    def __init__(self, values: np.ndarray):
        zeros = np.flatnonzero(values == 0)
        self.levels = max(1, int(np.diff(zeros).max(initial=1)).bit_length())
        self.table = [values.astype(np.int32)]
        for k in range(self.levels - 1):
            below, half = self.table[-1], 1 << k
            self.table.append(np.minimum(below[:-half], below[half:]) if len(below) > half else np.zeros(1, np.int32))

    def window(self, level: int, at: np.ndarray) -> np.ndarray:
        """Minimum of 2^level values from `at`; 0 if that is beyond an end."""
        own = self.table[level]
        return own[np.clip(at, 0, len(own) - 1)]

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of the values from low to high, both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in range(self.levels):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(self.window(k, low[at]), self.window(k, high[at] - (1 << k) + 1))
        return out


def nodes(prefix: np.ndarray, least: LeastOf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, cut, high) of the inner nodes but the root: leaves low to cut - 1 are below one child, cut to high - 1 below the other;
    the node's depth is prefix[cut]. Of equal depths the first is the uppermost."""
    cut = np.flatnonzero(prefix)
    depth = prefix[cut]
    low, high = cut.copy(), cut + 1
    for k in reversed(range(least.levels)):
        low = np.where(least.window(k, low - (1 << k)) > depth, low - (1 << k), low)
        high = np.where(least.window(k, high) >= depth, high + (1 << k), high)
    return low - 1, cut, high


def branching_repeats(order: np.ndarray, prefix: np.ndarray, least: LeastOf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of all branching tandem repeats, from the smaller child of each node."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    low, cut, high = nodes(prefix, least)
    left = cut - low <= high - cut
    first, many = np.where(left, low, cut), np.where(left, cut - low, high - cut)
    rest_low, rest_high = np.where(left, cut, low), np.where(left, high, cut)
    ends = np.cumsum(many)
    a = 0
    while a < len(cut):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _LEAVES)))
        own = np.repeat(np.arange(a, b), many[a:b])
        leaf = order[np.arange(len(own)) - np.repeat(ends[a:b] - many[a:b] - (ends[a - 1] if a else 0), many[a:b]) + first[own]]
        depth = prefix[cut[own]]
        for partner in (leaf + depth, leaf - depth):
            at = rank[np.clip(partner, 0, n - 1)]
            hit = np.flatnonzero((at >= rest_low[own]) & (at < rest_high[own]) & (partner >= 0) & (partner < n))
            yield np.minimum(leaf, partner)[hit], depth[hit]
        a = b


def maximal_runs(words: np.ndarray, doc: np.ndarray, min_exponent: int, min_length: int) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs with smallest period q and at least max(min_length, min_exponent * q) words;
    `words` are numbers of words, `doc` the numbers of their documents, rising; `min_exponent` is at least 2."""
    if not len(words):
        return np.empty((0, 3), np.int64)
    bounds = np.concatenate((np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), [len(doc)]))
    begin, end = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], bounds[1:]))
    order = suffix_array(words, doc, end)
    prefix = common_prefixes(words, doc, end, order)
    least = LeastOf(prefix)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))

    def goes_on(at: np.ndarray, period: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Whether the repeat can be shifted so far to the left."""
        x, y = rank[at - back], rank[at - back + period]
        return least.between(np.minimum(x, y) + 1, np.maximum(x, y)) >= back + period

    found = []
    for at, period in branching_repeats(order, prefix, least):
        need = np.maximum(min_exponent * period, min_length) - 2 * period
        need = np.maximum(need, 0)
        keep = at - need >= begin[at]
        at, period, need = at[keep], period[keep], need[keep]
        keep = goes_on(at, period, need)
        at, period, low = at[keep], period[keep], need[keep]
        high = at - begin[at]
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = goes_on(at, period, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        found.append(np.stack((at - low, at + 2 * period, period), axis=1))
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _searched(rows: list[tuple[int | None, list[bytes]]], ids: _Ids, min_exponent: int, min_length: int) -> pa.RecordBatch:
    """The columns of SCHEMA for some documents."""
    sizes = np.array([len(words) for _, words in rows], np.int64)
    first = np.cumsum(sizes) - sizes
    numbers = np.fromiter(map(ids.__getitem__, chain.from_iterable(words for _, words in rows)), np.int64, int(sizes.sum()))
    found = maximal_runs(numbers, np.repeat(np.arange(len(rows)), sizes), min_exponent, min_length)
    owner = np.searchsorted(first + sizes, found[:, 0], "right")
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
    runs, collapsed = [], []
    for k, (_, words) in enumerate(rows):
        own = found[bounds[k] : bounds[k + 1]]
        runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in (own - [first[k], first[k], 0]).tolist()])
        if len(own):
            change = np.zeros(len(words) + 1, np.int32)
            np.add.at(change, own[:, 0] + own[:, 2] - first[k], 1)
            np.add.at(change, own[:, 1] - first[k], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(words))
    columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array(sizes), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _searcher(min_exponent: int, min_length: int, change: Change | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words = change(doc_id, words) if change else words
                if rows and held + len(words) > BLOCK_WORDS:
                    yield _searched(rows, ids, min_exponent, min_length)
                    rows, held = [], 0
                    if len(ids) > BLOCK_WORDS:
                        ids = _Ids()
                rows.append((doc_id, words))
                held += len(words)
            if rows:
                yield _searched(rows, ids, min_exponent, min_length)

    return run


def periodic_runs(docs: DataFrame, min_exponent: int = 4, min_length: int = 6, change: Change | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length and smallest period in words, by start, then period) and the
    collapsed text, which has of each run its first period only (words joined by one space).

    Words are what stands between the white space of ASCII. A run is a stretch of at least max(min_length, min_exponent * period) words
    that no neighbouring word extends. `change` may replace a document's words before the search. Nothing is shuffled: a document is one
    task's work, in about 150 bytes a word. Null and empty texts have no words and no runs; long texts are searched whole; a null id
    stays null; repeated rows are searched each; an empty table gives an empty one; other columns are not read.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_searcher(min_exponent, min_length, change), SCHEMA)


def tail_repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For every tenth document or so, as a checksum of its id has it, the words from some place on become a stretch that repeats."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _steepest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as integers; of equal ones the first in the order of `runs`."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with every tenth one's tail repeated; of each its number of runs, its steepest run and digests of its runs and of
    its collapsed text."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=tail_repeated)
    best, line = _steepest(F.col("runs")), lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    shown = found.withColumns({"best": best, "lines": F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")})
    own = {name: F.col("best")[name] for name in ("start", "length", "period")}
    return shown.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(c.alias(name) for name, c in own.items()),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
