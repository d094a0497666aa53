"""Substring deduplication over a log-structured index of window fingerprints.

A window is WINDOW consecutive words of one document. The index consists of immutable runs; a run holds the sorted 64-bit
hashes of historical windows with the smallest document that has each, split into buckets by a second, independent hash. A new
batch of documents sends its window hashes to the buckets in binary blocks; in each bucket they are sorted, merged among themselves
(the smallest id owns a window) and merge-joined with the runs (history owns what it has). Then the batch becomes a run of its own,
and when there are several, they are compacted into one.

Equal hashes are only a claim. Whatever a document is about to lose is sent, as words, to the document that is said to own it
(each passage once, however many documents claim it), and every window is compared there word by word. Windows that fail,
which takes a collision of hashes, are dealt out anew by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, WordHashes, cover, free_shuffles, gram_hashes, mix64, null_id, partitions, safe_id, true_runs

WINDOW = 13
#: Bytes of text that are turned into blocks at once; runs of the index beyond which they are compacted into one.
CHUNK_BYTES = 3_000_000
MOST_RUNS = 3
#: Bytes of a bucket's entries on average, and of entries for each byte of text; bytes of claims that a text is compared with at once.
BUCKET_BYTES, ENTRY_BYTES = 64_000_000, 3
CLAIM_BYTES = 4_000_000
#: Shares of the rows, by their ids, at which the query's batches end; the last batch isn't kept as a run, as nothing comes after it.
BATCHES = (1 / 32, 2 / 32, 3 / 32, 4 / 32)

#: kind 0: window hashes to be looked up; kind 1: windows already known to be owned by another document of the same block.
#: In answers the bucket is a group of documents, and owners has each hash's owner; or, with kind 2, it is a bucket of the index.
BLOCKS = "bucket long, kind int, ids binary, counts binary, hashes binary, owners binary"
_BLOCKS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("owners", pa.binary())])
OWNED = "doc_id long, hashes binary, owners binary"
_OWNED = pa.schema([("doc_id", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary())])
RUN = "bucket long, hashes binary, owners binary"
_RUN = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary())])
#: A document without what it loses; or, with an owner, a passage that some document loses to it.
RESULT = "owner long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
_RESULT = pa.schema([("owner", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def chunks(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """Ids and texts of a batch in pieces of bounded size, each sorted by id."""
    ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    start = size = 0
    lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
    for i, n in enumerate([*lengths, None]):
        if n is None or (size and size + n > most):
            if i > start:
                order = np.argsort(ids[start:i], kind="stable")
                yield ids[start:i][order], [texts[start + int(k)].as_py() for k in order]
            start, size = i, 0
        size += n or 0


def by_owner(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each position of the sorted values, the position (in `order`) of the first with the same value."""
    v = values[order]
    first = np.concatenate(([True], v[1:] != v[:-1]))
    return order[np.flatnonzero(first)][np.cumsum(first) - 1]


def pack(bucket: np.ndarray, doc: np.ndarray, hashes: np.ndarray, ids: np.ndarray, kind: int, owners: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of BLOCKS; entries of a bucket stand in the order of documents, which keeps the ids short."""
    order = np.lexsort((doc, bucket))
    bucket, doc, hashes = bucket[order], doc[order], hashes[order]
    owners = np.empty(0, np.int64) if owners is None else owners[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
        if b > a:
            docs, counts = np.unique(doc[a:b], return_counts=True)
            own = ids[docs]
            yield int(bucket[a]), kind, np.diff(own, prepend=0).tobytes(), counts.astype(np.int32).tobytes(), hashes[a:b].tobytes(), owners[a:b].tobytes()


def unpack(table: pa.Table, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Ids and hashes of all entries of BLOCKS rows."""
    ids, hashes = [np.empty(0, np.int64)], [np.empty(0, kind)]
    for own, counts, values in zip(*(table.column(c) for c in ("ids", "counts", "hashes"))):
        ids.append(np.repeat(np.cumsum(np.frombuffer(own.as_buffer(), np.int64)), np.frombuffer(counts.as_buffer(), np.int32)))
        hashes.append(np.frombuffer(values.as_buffer(), kind))
    return np.concatenate(ids), np.concatenate(hashes)


def read_all(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column)])


def hashes_of(words: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of all windows of a sequence of word hashes."""
    return gram_hashes(words, WINDOW) >> np.uint64(64 - bits)


def numbers_of(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Exact numbers of words: equal words, and only those, have equal ones."""
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def same_words(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether the windows at these places have the same words, by the words' numbers."""
    same = np.ones(len(at_a), bool)
    for k in range(WINDOW):
        same &= a[at_a + k] == b[at_b + k]
    return same


def _emit(n_buckets: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for ids, texts in chunks(batch):
                words = [split_words(t) for t in texts]
                lengths, every = np.array([len(w) for w in words], np.int64), [w for own in words for w in own]
                flat = cache.of(every)
                first, second = hashes_of(flat, bits), gram_hashes(flat[::-1], WINDOW)[::-1]
                doc = np.repeat(np.arange(len(texts)), lengths)[: len(first)]
                place = np.flatnonzero(np.arange(len(first)) + WINDOW <= np.repeat(np.cumsum(lengths), lengths)[: len(first)])
                first, second, doc = first[place], second[place], doc[place]
                if not len(first):
                    continue
                order = np.argsort(first, kind="stable")
                owner = by_owner(order, first)
                number = numbers_of(every, {})
                same = same_words(number, place[order], number, place[owner])
                other_id = ids[doc[order]] != ids[doc[owner]]
                # one entry of each window goes out, for its owner; the owner's answer holds for all its places. Windows with the
                # hash but not the words of the owner's go out as well.
                ask, told, by = np.unique(np.concatenate([owner, order[~same]])), order[same & other_id], owner[same & other_id]
                bucket = (second % np.uint64(n_buckets)).astype(np.int64)
                rows = [*pack(bucket[ask], doc[ask], first[ask], ids, 0)]
                rows += pack(n_buckets + bucket[told[:1]].repeat(len(told)), doc[told], first[told], ids, 1, ids[doc[by]])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)

    return run


def per_document(ids: np.ndarray, hashes: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Each id with its hashes and their owners, if there are any."""
    order = np.argsort(ids, kind="stable")
    ids, hashes, owners = ids[order], hashes[order], owners[order] if len(owners) else owners
    cuts = np.flatnonzero(np.diff(ids)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(ids)]):
        if b > a:
            yield int(ids[a]), hashes[a:b].tobytes(), owners[a:b].tobytes()


def pack_answers(ids: np.ndarray, hashes: np.ndarray, n_groups: int, owners: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of BLOCKS by group of documents."""
    own, doc = np.unique(ids, return_inverse=True)
    group = (mix64(own.view(np.uint64)) % np.uint64(n_groups)).astype(np.int64)
    return pack(group[doc], doc, hashes, own, 0, owners)


def gather(blocks: pa.Table) -> pa.Table:
    """All hashes of each document of a group: OWNED."""
    rows = [*per_document(*unpack(blocks), read_all(blocks.column("owners"), np.int64))]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OWNED), _OWNED)], schema=_OWNED)


def as_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_BLOCKS), _BLOCKS)], schema=_BLOCKS)


def _answer(blocks: pa.Table, runs: list[tuple[np.ndarray, np.ndarray]], keep: bool, n_groups: int) -> pa.Table:
    kind = blocks.column("kind").to_numpy()
    told, asked = blocks.filter(pa.array(kind == 1)), blocks.filter(pa.array(kind == 0))
    told_ids, told_hashes = unpack(told)
    ids, hashes = unpack(asked)
    rows: list[tuple] = []
    owner = np.empty(0, np.int64)
    if len(hashes):
        order = np.lexsort((ids, hashes))
        owner, ids, hashes = ids[by_owner(order, hashes)], ids[order], hashes[order]
        for run, owners in runs:  # both sides are sorted: a merge join
            at = np.minimum(np.searchsorted(run, hashes), len(run) - 1)
            owner = np.where(run[at] == hashes, np.minimum(owner, owners[at]), owner)
        if keep:
            new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            rows.append((blocks.column("bucket")[0].as_py(), 2, b"", b"", hashes[new].tobytes(), owner[new].tobytes()))
        owned = owner < ids
        ids, hashes, owner = ids[owned], hashes[owned], owner[owned]
    rows += pack_answers(np.concatenate([told_ids, ids]), np.concatenate([told_hashes, hashes]), n_groups, np.concatenate([read_all(told.column("owners"), np.int64), owner]))
    return as_table(rows)


def _runs_of(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    rows = zip(table.column("hashes"), table.column("owners"))
    return [(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(o.as_buffer(), np.int64)) for h, o in rows if len(h.as_buffer())]


def _compact(table: pa.Table) -> pa.Table:
    hashes, owners = read_all(table.column("hashes"), np.uint64), read_all(table.column("owners"), np.int64)
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, bool)
    row = (table.column("bucket")[0].as_py(), hashes[new].tobytes(), owners[new].tobytes())
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _RUN)], schema=_RUN)


class FingerprintIndex:
    """Window fingerprints of the documents appended so far, as run tables in a scratch folder.

    `text_bytes`, of all documents to come, sizes the buckets. Hashes have `bits` bits, fewer than 64 only in tests.
    """

    def __init__(self, spark: SparkSession, text_bytes: int = 0, bits: int = 64):
        self.spark, self.scratch, self.bits = spark, Scratch(spark, "windows"), bits
        least = -(-ENTRY_BYTES * text_bytes // BUCKET_BYTES)
        self.n_buckets, self.n_groups = max(2 * partitions(spark), least), max(partitions(spark), least)
        self.runs: list[str] = []
        self.batches = self.compactions = 0

    def append(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Looks up a batch (doc_id, text) of larger ids than before, then adds it as a run; keep=False leaves the index as it is,
        after the last batch.

        Gives blocks by groups of documents: the hashes of those windows of a document that the history has or that also start
        in a document of the batch with a smaller id, each with its owner.
        """
        n, n_groups, self.batches = self.batches, self.n_groups, self.batches + 1
        blocks = docs.mapInArrow(_emit(self.n_buckets, self.bits), BLOCKS).groupBy("bucket")
        if self.runs:
            old = self.spark.read.schema(RUN).parquet(*(self.scratch.path(r) for r in self.runs))
            answers = blocks.cogroup(old.groupBy("bucket")).applyInArrow(lambda new, runs: _answer(new, _runs_of(runs), keep, n_groups), BLOCKS)
        else:
            answers = blocks.applyInArrow(lambda new: _answer(new, [], keep, n_groups), BLOCKS)
        answers = self.scratch.save(answers, f"answers{n}")
        free_shuffles(self.spark)
        if keep:
            self.scratch.save(answers.filter("kind = 2").select("bucket", "hashes", "owners"), f"run{n}")
            self.runs.append(f"run{n}")
            if len(self.runs) > MOST_RUNS:
                self.compact()
        return answers.filter("kind = 0")

    def compact(self) -> None:
        """Merges all runs into one; the old ones go only when the new one is complete."""
        merged = self.spark.read.schema(RUN).parquet(*(self.scratch.path(r) for r in self.runs)).groupBy("bucket").applyInArrow(_compact, RUN)
        name, old = f"compacted{self.batches}", self.runs
        self.scratch.save(merged, name)
        self.runs, self.compactions = [name], self.compactions + 1
        self.scratch.drop(*old)


def _losses(words: list[bytes], owned: np.ndarray, owners: np.ndarray, cache: WordHashes, bits: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Flags of the windows that others own, and (owner, first word, end) of the passages that one owner has."""
    found = hashes_of(cache.of(words), bits)
    if not len(owned) or not len(found):
        return np.zeros(len(found), bool), []
    order = np.argsort(owned, kind="stable")
    owned, owners = owned[order], owners[order]
    at = np.minimum(np.searchsorted(owned, found), len(owned) - 1)
    lost, owner, claims = owned[at] == found, owners[at], []
    for a, b in zip(*true_runs(lost)):
        cuts = np.flatnonzero(np.diff(owner[a:b])) + a + 1
        claims += [(int(owner[i]), int(i), int(j) + WINDOW - 1) for i, j in zip([a, *cuts], [*cuts, b])]
    return lost, claims


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _remove(bits: int, claim: bool, keep_text: bool):
    """Rows of RESULT; with `claim` the passages too that are lost. A fifth column has owned windows given by their words."""
    text_of = lambda words: b" ".join(words).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, text, hashes, owners, *more in zip(*batch.columns):
                words, claims, gone = split_words(text.as_py()), [], None
                told = {x.encode("utf-8", "surrogatepass") for x in (more[0].as_py() or [])} if more else set()
                if len(words) >= WINDOW and (hashes.is_valid or told):
                    owned, by = (np.frombuffer(x.as_buffer(), t) if x.is_valid else np.empty(0, t) for x, t in ((hashes, np.uint64), (owners, np.int64)))
                    lost, claims = _losses(words, owned, by, cache, bits)
                    if told:
                        lost |= np.array([b" ".join(words[i : i + WINDOW]) in told for i in range(len(lost))], bool)
                    gone = cover(np.flatnonzero(lost), WINDOW, len(words))
                kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone) if not g])
                rows.append((None, doc_id.as_py(), len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None))
                if claim:
                    rows += [(owner, None, None, None, None, text_of(words[a:b])) for owner, a, b in claims]
            yield _batch(rows, _RESULT)

    return run


def _compare(bits: int):
    """Hashes of those windows of claimed passages that the text hasn't got, word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, schema = WordHashes(), pa.schema([("hash", pa.int64())])
        for batch in batches:
            bad = set()
            for text, passages in zip(*batch.columns):
                own, known = split_words(text.as_py()), {}
                number, mine = numbers_of(own, known), hashes_of(cache.of(own), bits)
                order = np.argsort(mine, kind="stable")
                mine = mine[order]
                words = [split_words(p) for p in passages.as_py()]
                lengths, every = np.array([len(w) for w in words], np.int64), [w for p in words for w in p]
                asked, theirs = np.fromiter((known.get(w, -1) for w in every), np.int64, len(every)), hashes_of(cache.of(every), bits)
                # windows that lie within one passage
                place = np.flatnonzero(np.arange(len(theirs)) + WINDOW <= np.repeat(np.cumsum(lengths), lengths)[: len(theirs)])
                theirs = theirs[place]
                low, high, good = np.searchsorted(mine, theirs), np.searchsorted(mine, theirs, "right"), np.zeros(len(theirs), bool)
                for k in range(int((high - low).max(initial=0))):  # places with the hash: one, unless the text repeats itself
                    left = np.flatnonzero(~good & (low + k < high))
                    if not len(left):
                        break
                    good[left] = same_words(number, order[low[left] + k], asked, place[left])
                bad.update(theirs[~good].view(np.int64).tolist())
            yield _batch([(h,) for h in bad], schema)

    return run


def _windows(bits: int, wanted: set[int]):
    """(doc_id, hash, words) of the windows whose hash has its place in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, schema = WordHashes(), pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("words", pa.string())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns):
                words = split_words(text.as_py())
                for i, h in enumerate(hashes_of(cache.of(words), bits).view(np.int64).tolist()):
                    if h % _PLACES in wanted:
                        rows.append((doc_id.as_py(), h, b" ".join(words[i : i + WINDOW]).decode("utf-8", "surrogatepass")))
            yield _batch(rows, schema)

    return run


#: Places of the filter over hashes that failed.
_PLACES = 1 << 16


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owned hashes but for the bad ones."""
    for batch in batches:
        rows = []
        for doc_id, hashes, owners, bad in zip(*batch.columns):
            own, by = np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(owners.as_buffer(), np.int64)
            keep = ~np.isin(own, np.array(bad.as_py() or [], np.int64).view(np.uint64))
            rows.append((doc_id.as_py(), own[keep].tobytes(), by[keep].tobytes()))
        yield _batch(rows, _OWNED)


def _failed(docs: DataFrame, claims: DataFrame, bits: int) -> DataFrame:
    """Hashes for which a claimed window isn't in the owner's text. (Where several texts share an id, in one of them; that only sends
    more windows the exact way.)"""
    claims = claims.withColumn("size", F.octet_length("passage"))
    parts = claims.groupBy("doc_id").agg(F.ceil(F.sum("size") / CLAIM_BYTES).alias("parts"))
    dealt = claims.join(parts, "doc_id").withColumn("part", F.pmod(F.xxhash64("passage"), F.col("parts")))
    dealt = dealt.groupBy("doc_id", "part").agg(F.collect_list("passage").alias("passages"))
    return docs.join(dealt, "doc_id").select("text", "passages").mapInArrow(_compare(bits), "hash long").distinct()


def remove_windows(docs: DataFrame, answers: DataFrame, scratch: Scratch, bits: int = 64, keep_text: bool = True) -> DataFrame:
    """Takes out the words covered by windows of others, once every such window is compared with its owner's: a row per input row."""
    spark = docs.sparkSession
    own = answers.groupBy("bucket").applyInArrow(gather, OWNED)
    keyed = own.withColumnRenamed("doc_id", "key")
    rows = docs.join(keyed, docs["doc_id"] == keyed["key"], "left").select("doc_id", "text", "hashes", "owners")
    rows = scratch.save(rows.mapInArrow(_remove(bits, True, keep_text), RESULT), "removed")
    free_shuffles(spark)
    claims = rows.filter("owner is not null").select(F.col("owner").alias("doc_id"), F.col("kept_text").alias("passage")).distinct()
    failed = scratch.save(_failed(docs, claims, bits), "failed")
    free_shuffles(spark)
    if failed.isEmpty():
        return rows.filter("owner is null").drop("owner")
    # hashes that stand for several windows: those windows are dealt out by their words
    places = {r[0] for r in failed.select(F.pmod("hash", F.lit(_PLACES)).alias("place")).distinct().collect()}  # at most _PLACES
    windows = docs.mapInArrow(_windows(bits, places), "doc_id long, hash long, words string").distinct()
    windows = scratch.save(windows.join(failed, "hash", "left_semi"), "windows")
    first = windows.groupBy("words").agg(F.min("doc_id").alias("first"))
    told = windows.join(first, "words").filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("words").alias("told"))
    bad = windows.groupBy("doc_id").agg(F.collect_set("hash").alias("bad"))
    sure = own.join(bad, "doc_id", "left").select("doc_id", "hashes", "owners", "bad").mapInArrow(_without, OWNED)
    keyed = sure.join(told, "doc_id", "full").withColumnRenamed("doc_id", "key")
    rows = docs.join(keyed, docs["doc_id"] == keyed["key"], "left").select("doc_id", "text", "hashes", "owners", "told")
    return rows.mapInArrow(_remove(bits, False, keep_text), RESULT).drop("owner")


def batch_ends(rows: DataFrame) -> tuple[list[int], int]:
    """Ids at which the batches end, to a ten-thousandth of the rows, and the bytes of all texts."""
    ends, size = rows.agg(F.percentile_approx(null_id("doc_id"), list(BATCHES), 10_000), F.sum(F.octet_length("text"))).first()
    return sorted(set(ends or [])), size or 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, keep_text: bool = True) -> DataFrame:
    """Removes each word covered by a window whose words also start in a document with a smaller id.

    The documents come to the index in batches by id (BATCHES), and the runs of the first ones are compacted. A row per input row
    with doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space). Null and empty texts have no
    words; texts shorter than a window lose nothing; long texts are taken whole; a null id is smaller than any other; rows with
    equal ids don't take words from each other; an empty table gives an empty one; other columns are not read.
    """
    number, columns = F.col(id_col).cast("long"), (safe_id(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.select(*columns)
    ends, size = batch_ends(rows)
    index = FingerprintIndex(docs.sparkSession, size, bits)
    answers = None
    for begin, end in zip([None, *ends], [*ends, None]):
        part = docs  # null ids are in the first batch; bounds of the ids themselves reach the scan
        if end is not None:
            part = part.filter((number <= end) | number.isNull() if begin is None else number <= end)
        if begin is not None:
            part = part.filter(number > begin)
        found = index.append(part.select(*columns), keep=end is not None)
        answers = found if answers is None else answers.unionByName(found)
    return remove_windows(rows, answers, index.scratch, bits, keep_text).withColumn("doc_id", null_id("doc_id"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False).drop("kept_text")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
     n AS (SELECT doc_id, ws, len(ws) AS n_words FROM w),
     s AS (SELECT doc_id, unnest(generate_series(1, n_words - 12)) AS i, ws FROM n WHERE n_words >= 13),
     g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM s),
     o AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM g),
     c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM o WHERE owner < doc_id),
     a AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
     k AS (SELECT n.doc_id, n_words, coalesce(len(gone), 0) AS n_removed,
                  list_filter(list_zip(ws, generate_series(1, n_words)), lambda x: NOT list_contains(coalesce(gone, []), x[2])) AS kept
           FROM n LEFT JOIN a USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(list_transform(kept, lambda x: x[1]), ' ')) AS kept_sha256 FROM k
"""
