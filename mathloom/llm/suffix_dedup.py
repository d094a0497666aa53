"""Removal of repeated byte strings by suffix arrays built with the difference-cover algorithm.

A byte is removed if a WIDTH-byte string that covers it also starts in a document with a smaller id. Windows of WIDTH
bytes are found again in three steps:

1. Each window is named by the smallest hash of the GRAM-byte strings in it. Equal windows have equal names, and neighbouring
   windows mostly share one, so a document has about one name in 15 bytes. Names are sent to buckets, which tell the
   documents whose names other documents have too; other windows can't be repeated. Names go as SHORT numbers: names that happen to
   share one only count as shared.
2. Stretches of neighbouring windows with a shared name are cut out and sent to the bucket of the name. Equal stretches have one
   owner, the smallest id. Where a name has different stretches, the bucket's stretches are joined into a string, its suffixes
   are sorted by the difference-cover algorithm (sampled triples are sorted and named, the names' own suffixes are sorted by
   recursion, the remaining suffixes are merged in), and adjacent suffixes with WIDTH equal bytes share an owner.
3. Documents take out what is owned by others.

The share of the names that are shared grows with the input. Step 2 takes as many passes over the texts, each with its part of the names, as
keep what one pass shuffles to PASS_BYTES for a byte of text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NULL_ID, U64, Scratch, free_shuffles, mix64, partitions, safe_id, true_runs
from .substring_dedup import _BLOCKS, BLOCKS, as_table, chunks, pack, pack_answers, per_document, unpack

WIDTH = 50
GRAM = 20
#: Bytes of a bucket's entries on average, and of entries for each byte of text.
BUCKET_BYTES, ENTRY_BYTES = 64_000_000, 3
#: Bytes of stretches that a pass sends for each byte of text; those of the stretch that a shared name stands for, on average.
PASS_BYTES, STRETCH_BYTES = 1.1, 65
#: Bytes that are hashed at once.
_PART = 1 << 16
#: What is sent of a name, besides its bucket: its lower half.
SHORT = np.uint32
#: Ids with several rows that are told apart by a broadcast table; with more of them all rows are marked.
MOST_REPEATED = 100_000

#: Stretches of one block of documents: ids and marks with counts, then per stretch name, place in its document and bytes; all but the
#: names are compressed (`_small`), as they lie on disk beside the texts.
_BINARIES = ("ids", "marks", "counts", "hashes", "places", "lengths", "bytes")
STRETCHES = "bucket long, kind int, " + ", ".join(f"{c} binary" for c in _BINARIES)
_STRETCHES = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in _BINARIES)])
#: The short names of a document that other documents have too.
SHARED = "doc_id long, names binary, n_names long"
_SHARED = pa.schema([("doc_id", pa.int64()), ("names", pa.binary()), ("n_names", pa.int64())])
#: Of a group of documents: ids and marks (which tell apart texts of one id) with counts, then the first window of each stretch that
#: others own, as differences, and then how far behind it the last one is; compressed.
RANGES = "bucket long, ids binary, marks binary, counts binary, ranges binary"
_RANGES = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("ids", "marks", "counts", "ranges"))])
OWNED_RANGES = "doc_id long, mark long, ranges binary"
_OWNED_RANGES = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("ranges", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of an array of non-negative integers in lexicographic order (difference cover modulo 3)."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([s.astype(np.int64) + 1, np.zeros(3, np.int64)])  # the end is smaller than any symbol
    m = n + (n % 3 == 1)  # a sampled suffix right behind the end keeps the two halves of the sample apart
    sample = np.concatenate([np.arange(1, m, 3), np.arange(2, m, 3)])
    t = np.concatenate([t, np.zeros(3, np.int64)])
    bits = max(int(t.max()).bit_length(), 1)
    if 3 * bits <= 63:
        triples = (t[sample] << (2 * bits)) | (t[sample + 1] << bits) | t[sample + 2]
    else:
        pairs = np.unique((t[sample] << 31) | t[sample + 1], return_inverse=True)[1].astype(np.int64)
        triples = (pairs << 31) | t[sample + 2]
    distinct, names = np.unique(triples, return_inverse=True)
    order = np.argsort(names, kind="stable") if len(distinct) == len(sample) else suffix_array(names)
    rank = np.zeros(n + 6, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    rank[n:] = 0
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    key_rest = (t[rest] << 32) | rank[rest + 1]
    by_key = np.argsort(key_rest, kind="stable")
    rest, key_rest = rest[by_key], key_rest[by_key]
    # how many of the rest go before each sampled suffix: compare one symbol and a rank, or two symbols and a rank
    before = np.empty(len(sorted_sample), np.int64)
    one = sorted_sample % 3 == 1
    i = sorted_sample[one]
    before[one] = np.searchsorted(key_rest, (t[i] << 32) | rank[i + 1])
    j = sorted_sample[~one]
    both = np.unique(np.concatenate([(t[rest] << 31) | t[rest + 1], (t[j] << 31) | t[j + 1]]), return_inverse=True)[1].astype(np.int64)
    before[~one] = np.searchsorted((both[: len(rest)] << 32) | rank[rest + 2], (both[len(rest) :] << 32) | rank[j + 2])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(sorted_sample))
    free = np.ones(n, bool)
    free[place] = False
    out[place] = sorted_sample
    out[free] = rest
    return out


def window_names(data: bytes) -> np.ndarray:
    """For each window of WIDTH bytes the smallest hash of the GRAM-byte strings in it."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = data + bytes(8)
    at = lambda offset, count: np.ndarray((count,), "<u8", padded, offset, (1,)).copy()
    grams = len(data) - GRAM + 1
    low = mix64(at(0, grams) * U64(0x9E3779B97F4A7C15) + at(8, grams) * U64(0xC2B2AE3D27D4EB4F) + (at(12, grams) >> U64(32)) * U64(0x165667B19E3779F9))
    width, need = 1, WIDTH - GRAM + 1
    while 2 * width <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: n], low[need - width : need - width + n])


def named_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one name: name, document, first window, number of windows."""
    out = [[np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    for base in range(0, max(0, len(data) - WIDTH + 1), _PART):
        names = window_names(data[base : base + _PART + WIDTH - 1])
        # runs also end where a document begins, or windows that reach into the next one
        a, b = np.searchsorted(ends, base, "right"), np.searchsorted(starts, base + len(names))
        edges = np.concatenate([starts[a:b], ends[a:b] - WIDTH + 1]) - base
        new = np.concatenate(([True], names[1:] != names[:-1]))
        new[edges[(edges > 0) & (edges < len(names))]] = True
        first = np.flatnonzero(new)
        doc = np.searchsorted(ends, first + base, "right")
        whole = first + base + WIDTH <= ends[doc]
        for part, x in zip(out, (names[first], doc, first + base - starts[doc], np.diff(np.append(first, len(names))))):
            part.append(x[whole])
    return tuple(np.concatenate(p) for p in out)


def _small(data: bytes) -> bytes:
    """Compressed, behind its length in eight bytes."""
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def _whole(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _encode(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _emit_names(n_buckets: int):
    """kind 0: a name that one document of the block has; kind 1: names with all their documents, more than one; kind 2: such a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch):
                names, doc, _, _ = named_runs(_encode(texts))
                if not len(names):
                    continue
                order = np.argsort(names, kind="stable")
                v, d = names[order], ids[doc[order]]
                first = np.concatenate(([True], v[1:] != v[:-1]))
                group = np.cumsum(first) - 1
                several = (np.maximum.reduceat(d, np.flatnonzero(first)) != d[first])[group]
                bucket = (names >> U64(32)) % U64(n_buckets)
                bucket, names = bucket.astype(np.int64), names.astype(SHORT)
                alone, known, told = order[first & ~several], order[first & several], order[several]
                rows = [*pack(bucket[alone], doc[alone], names[alone], ids, 0), *pack(bucket[known], doc[known], names[known], ids, 2)]
                rows += pack(n_buckets + bucket[told[:1]].repeat(len(told)), doc[told], names[told], ids, 1)
                yield _batch(rows, _BLOCKS)

    return run


def _shared_names(n_groups: int):
    def run(blocks: pa.Table) -> pa.Table:
        kind = blocks.column("kind").to_numpy()
        told_ids, told_names = unpack(blocks.filter(pa.array(kind == 1)), SHORT)
        ids, names = unpack(blocks.filter(pa.array(kind == 0)), SHORT)
        known = unpack(blocks.filter(pa.array(kind == 2)), SHORT)[1]
        if len(names):
            order = np.argsort(names, kind="stable")
            ids, names = ids[order], names[order]
            first = np.concatenate(([True], names[1:] != names[:-1]))
            starts = np.flatnonzero(first)
            several = np.maximum.reduceat(ids, starts) != np.minimum.reduceat(ids, starts)
            shared = several[np.cumsum(first) - 1] | np.isin(names, known)
            ids, names = ids[shared], names[shared]
        return as_table([*pack_answers(np.concatenate([told_ids, ids]), np.concatenate([told_names, names]), n_groups)])

    return run


def _gather_names(blocks: pa.Table) -> pa.Table:
    """All shared names of each document of a group."""
    rows = [(i, names, len(names) // np.dtype(SHORT).itemsize) for i, names, _ in per_document(*unpack(blocks, SHORT), np.empty(0, np.int64))]
    return pa.Table.from_batches([_batch(rows, _SHARED)])


def _emit_stretches(n_buckets: int, part: int = 0, parts: int = 1):
    """The stretches of one of several parts of the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, marks = ids[order], batch.column(1).to_numpy()[order]
            texts = _encode([batch.column(2)[int(k)].as_py() for k in order])
            names, doc, at, count = named_runs(texts)
            short = names.astype(SHORT)
            cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
            keep = np.zeros(len(names), bool)
            for k in range(len(ids)):
                a, b = cuts[k], cuts[k + 1]
                keep[a:b] = np.isin(short[a:b], np.frombuffer(batch.column(3)[int(order[k])].as_buffer(), SHORT))
            keep &= short % SHORT(parts) == part
            names, short, doc, at, count = names[keep], short[keep], doc[keep], at[keep], count[keep]
            if not len(names):
                continue
            strings = [texts[d][a : a + n + WIDTH - 1] for d, a, n in zip(doc, at, count)]
            bucket = ((names >> U64(32)) % U64(n_buckets)).astype(np.int64)
            # of equal stretches of a block only the owner's go on, the other documents know already
            first: dict[bytes, int] = {}
            told = np.array([ids[d] != ids[first.setdefault(p, d)] for p, d in zip(strings, doc)], bool)
            rows = []
            for kind, chosen in ((0, np.flatnonzero(~told)), (1, np.flatnonzero(told))):
                where = bucket[chosen] if kind == 0 else n_buckets + bucket[chosen[:1]].repeat(len(chosen))
                chosen = chosen[np.argsort(where, kind="stable")]
                where = np.sort(where)
                edges = np.flatnonzero(np.diff(where)) + 1
                for a, b in zip([0, *edges], [*edges, len(chosen)]):
                    if b > a:
                        own = chosen[a:b]
                        docs, counts = np.unique(doc[own], return_counts=True)
                        lengths = count[own] if kind else np.array([len(strings[i]) for i in own])
                        small = (np.diff(ids[docs], prepend=0).tobytes(), marks[docs].tobytes(), counts.astype(np.int32).tobytes(), at[own].tobytes(), lengths.astype(np.int32).tobytes(), b"" if kind else b"".join(strings[i] for i in own))
                        own_ids, own_marks, own_counts, *rest = map(_small, small)
                        rows.append((int(where[a]), kind, own_ids, own_marks, own_counts, short[own].tobytes(), *rest))
            yield _batch(rows, _STRETCHES)

    return run


def _ranges(ids: np.ndarray, marks: np.ndarray, first: np.ndarray, last: np.ndarray, n_groups: int) -> Iterator[tuple]:
    """Rows of RANGES by group of documents."""
    group = (mix64(ids.view(np.uint64)) % U64(n_groups)).astype(np.int64)
    order = np.lexsort((first, marks, ids, group))
    group, ids, marks, first, behind = group[order], ids[order], marks[order], first[order], (last - first)[order]
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(ids)]):
        if b > a:
            new = np.flatnonzero(np.concatenate(([True], (ids[a + 1 : b] != ids[a : b - 1]) | (marks[a + 1 : b] != marks[a : b - 1]))))
            parts = np.diff(ids[a:b][new], prepend=0), marks[a:b][new], np.diff(np.append(new, b - a)).astype(np.int32), np.concatenate([np.diff(first[a:b], prepend=0), behind[a:b]])
            yield int(group[a]), *(_small(x.tobytes()) for x in parts)


def _gather_ranges(table: pa.Table) -> pa.Table:
    """All ranges of each text of a group of documents, those joined whose windows touch."""
    out = [[np.empty(0, np.int64)] * 4]
    for columns in zip(*(table.column(c) for c in ("ids", "marks", "counts", "ranges"))):
        ids, marks, counts, pairs = (np.frombuffer(_whole(c.as_py()), kind) for c, kind in zip(columns, (np.int64, np.int64, np.int32, np.int64)))
        first, behind = pairs.reshape(2, -1)
        first = np.cumsum(first)
        out.append([np.repeat(np.cumsum(ids), counts), np.repeat(marks, counts), first, first + behind])
    ids, marks, first, last = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((first, marks, ids))
    ids, marks, first, last = ids[order], marks[order], first[order], last[order]
    other = np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(marks) != 0)))[: len(ids)]
    # the end of what the ranges before it cover, in the same text: each text has its own stretch of numbers
    base = (np.cumsum(other) - 1) * (last.max(initial=0) + WIDTH + 2)
    ends = np.maximum.accumulate(base + last)
    new = other | np.concatenate(([True], (base + first)[1:] > ends[:-1] + WIDTH))[: len(ids)]
    starts = np.flatnonzero(new)
    pairs = np.stack([first[starts], (ends - base)[np.append(starts[1:], len(ids))[: len(starts)] - 1]], 1)
    ids, marks = ids[starts], marks[starts]
    cuts = np.flatnonzero(other[starts])
    rows = [(int(ids[a]), int(marks[a]), pairs[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
    return pa.Table.from_batches([_batch(rows, _OWNED_RANGES)])


def owned_windows(parts: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """For each of the strings, flags of its windows that also start in a string of a smaller owner, by their suffix array."""
    lengths = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
    text = data.astype(np.int64) + 1
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    text[starts + lengths] = 0
    part = np.repeat(np.arange(len(parts)), lengths + 1)
    whole = np.arange(len(text)) + WIDTH <= (starts + lengths)[part]  # the suffixes that begin with a window
    order = suffix_array(text)
    order = order[whole[order]]
    rows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 1 << 16):
        b = min(a + (1 << 16), len(order))
        new[a:b] = (rows[order[a:b]] != rows[order[a - 1 : b - 1]]).any(axis=1)
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(owners[part[order]], np.flatnonzero(new))
    flags = np.zeros(len(text), bool)
    flags[order] = least[group] < owners[part[order]]
    return [flags[s : s + max(0, n - WIDTH + 1)] for s, n in zip(starts, lengths)]


def _owned(table: pa.Table, n_groups: int) -> pa.Table:
    none = np.empty(0, np.int64)
    told, asked, names, parts = [[none] * 4], [[none] * 3], [np.empty(0, SHORT)], []
    for kind, *columns in zip(table.column("kind"), *(table.column(c) for c in _BINARIES)):
        own, marks, counts, hashes, at, lengths, data = (c.as_py() if name == "hashes" else _whole(c.as_py()) for name, c in zip(_BINARIES, columns))
        counts = np.frombuffer(counts, np.int32)
        doc, mark = np.repeat(np.cumsum(np.frombuffer(own, np.int64)), counts), np.repeat(np.frombuffer(marks, np.int64), counts)
        at, lengths = np.frombuffer(at, np.int64), np.frombuffer(lengths, np.int32).astype(np.int64)
        if kind.as_py():
            told.append([doc, mark, at, at + lengths - 1])
        else:
            ends = np.cumsum(lengths)
            asked.append([doc, mark, at])
            names.append(np.frombuffer(hashes, SHORT))
            parts += [data[e - n : e] for e, n in zip(ends, lengths)]
    (ids, marks, places), names = (np.concatenate(x) for x in zip(*asked)), np.concatenate(names)
    found = told
    if parts:
        number: dict[bytes, int] = {}
        kinds = np.array([number.setdefault(p, len(number)) for p in parts])
        owner = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(owner, kinds, ids)
        width = np.array([len(p) for p in parts]) - WIDTH
        whole = ids > owner[kinds]
        found.append([ids[whole], marks[whole], places[whole], (places + width)[whole]])
        # names with different stretches: the first stretch of each kind, and then its windows
        name_of = np.zeros(len(number), SHORT)
        name_of[kinds] = names
        order = np.argsort(name_of, kind="stable")
        sizes = np.unique(name_of, return_counts=True)[1]
        mixed = np.zeros(len(number), bool)
        mixed[order] = np.repeat(sizes > 1, sizes)
        if mixed.any():
            texts = list(number)
            chosen = np.flatnonzero(mixed)
            flags = owned_windows([texts[k] for k in chosen], owner[chosen])
            starts = np.cumsum([0, *(len(f) + 1 for f in flags)])  # a False behind each
            first, end = true_runs(np.concatenate([x for f in flags for x in (f, [False])]))
            runs = np.zeros((len(number), 2), np.int64)  # of each kind: its first run, and the one behind its last
            runs[chosen] = np.stack([np.searchsorted(first, starts[:-1]), np.searchsorted(first, starts[1:])], 1)
            start_of = np.zeros(len(number), np.int64)
            start_of[chosen] = starts[:-1]
            some = np.flatnonzero(mixed[kinds] & ~whole)
            low, counts = runs[kinds[some], 0], np.diff(runs[kinds[some]], axis=1)[:, 0]
            own = np.repeat(some, counts)
            run = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(len(own))
            shift = places[own] - start_of[kinds[own]]
            found.append([ids[own], marks[own], shift + first[run], shift + end[run] - 1])
    return pa.Table.from_batches([_batch([*_ranges(*(np.concatenate(x) for x in zip(*found)), n_groups)], _RANGES)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, blocks in zip(*batch.columns):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            kept, removed, spans = data, 0, 0
            if blocks.is_valid:
                pairs = np.frombuffer(blocks.as_buffer(), np.int64).reshape(-1, 2)
                delta = np.zeros(len(data) + 1, np.int64)
                np.add.at(delta, pairs[:, 0], 1)
                np.add.at(delta, pairs[:, 1] + WIDTH, -1)
                gone = np.cumsum(delta)[:-1] > 0
                first, _ = true_runs(gone)
                kept, removed, spans = np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), len(first)
            rows.append((doc_id.as_py(), len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)


def n_passes(n_names: int, size: int) -> int:
    """Passes over texts of so many bytes in which the stretches of so many shared names go out."""
    return max(1, math.ceil(n_names * STRETCH_BYTES / (PASS_BYTES * max(size, 1))))


def _marked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """With the column mark: a hash of the text for ids with several rows, else mostly 0, which takes no room in shuffles."""
    several = scratch.save(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("several")), "several")
    if several.count() > MOST_REPEATED:
        return rows.withColumn("mark", F.xxhash64("text"))
    return rows.join(F.broadcast(several), "doc_id", "left").withColumn("mark", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("several")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes the bytes that repeat a document with a smaller id: RESULT, a row per input row, `kept` being the remaining bytes.

    Null and empty texts have no bytes; texts shorter than WIDTH bytes lose nothing; long texts are taken whole; a null id is smaller
    than any other; rows with equal ids don't take bytes from each other; an empty table gives an empty one; other columns are not
    read. Buckets hold about BUCKET_BYTES of entries, however large the input is, and passes send about PASS_BYTES for a byte of text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    least = -(-ENTRY_BYTES * size // BUCKET_BYTES)
    n_buckets, n_groups = max(2 * partitions(spark), least), max(partitions(spark), least)
    rows = docs.select(safe_id(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = _marked(rows, scratch)
    # gathered before they are saved: the shuffles of both steps are gone when the texts are shuffled
    told = rows.mapInArrow(_emit_names(n_buckets), BLOCKS).groupBy("bucket").applyInArrow(_shared_names(n_groups), BLOCKS).groupBy("bucket").applyInArrow(_gather_names, SHARED)
    own = scratch.save(told, "names").withColumnRenamed("doc_id", "key")
    del told
    free_shuffles(spark)
    known = marked.join(own, marked["doc_id"] == own["key"]).select("doc_id", "mark", "text", "names")
    ranges = None
    for k in range(parts := n_passes(own.agg(F.sum("n_names")).first()[0] or 0, size)):
        found = scratch.save(known.mapInArrow(_emit_stretches(n_buckets, k, parts), STRETCHES).groupBy("bucket").applyInArrow(lambda t: _owned(t, n_groups), RANGES), f"ranges-{k}")
        ranges = found if ranges is None else ranges.unionByName(found)
        free_shuffles(spark)
    scratch.drop("names")
    gone = ranges.groupBy("bucket").applyInArrow(_gather_ranges, OWNED_RANGES).withColumnsRenamed({"doc_id": "key", "mark": "key_mark"})
    same = (marked["doc_id"] == gone["key"]) & (marked["mark"] == gone["key_mark"])
    out = marked.join(gone, same, "left").select("doc_id", "text", "ranges").mapInArrow(_cut, RESULT)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(int(NULL_ID))))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


#: Texts as hexadecimal digits, cut into overlapping parts, as taking a piece of a long string costs its length.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     c AS (SELECT doc_id, h, unnest(range(0, greatest(1, CAST(ceil((strlen(h) // 2 - 49) / 2000.0) AS BIGINT)))) AS c FROM d),
     p AS (SELECT doc_id, c, substr(h, 1 + 4000 * c, 4098) AS part FROM c),
     s AS (SELECT doc_id, c, part, unnest(range(0, least(2000, strlen(part) // 2 - 49))) AS i FROM p WHERE strlen(part) >= 100),
     o AS (SELECT doc_id, c * 2000 + i AS i, min(doc_id) OVER (PARTITION BY substr(part, 2 * i + 1, 100)) AS owner FROM s),
     r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS new FROM o WHERE owner < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
     x AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
     y AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM x GROUP BY ALL),
     z AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM y),
     k AS (SELECT z.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS tail
           FROM z JOIN d USING (doc_id) GROUP BY z.doc_id)
SELECT doc_id, strlen(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
