"""Fingerprints of texts by consistent weighted sampling.

A text is a set of weighted terms: its words with their counts, and the words' beginnings, which count half. For each term and
each place of the fingerprint the term itself yields r and c from the gamma distribution of shape 2 and an offset b from [0, 1); with
the weight w in steps of r on a log scale, t = floor(ln w / r + b), the term's value is ln c - r (t - b) - r. The term with the smallest
value is the place's sample, as (term, t). Two texts have the same sample at a place with a probability of their generalised Jaccard
similarity, the sum of the smaller weights over the sum of the larger ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import U64, Rolling, Scratch, mix64, partitions, safe_id

#: Places of a fingerprint; the standard error of a likeness is at most 1 / (2 * sqrt(SAMPLES)).
SAMPLES = 64
#: Bytes of a word's beginning and what it weighs.
BEGINNING, BEGINNING_WEIGHT = 4, 0.5
#: Bytes of texts whose terms are sampled together; a longer text is taken alone, its words in pieces of so many bytes.
_BYTES = 1 << 20
#: Weighted terms from which on a task forgets those that it has met; a row of samples has 8 * SAMPLES bytes.
MOST_ROWS = 1 << 16
#: Terms that are sampled, or reduced, at once.
_TERMS = 512
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_ODD = U64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_chars long, n_terms long, fingerprint string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_terms", pa.int64()), ("fingerprint", pa.string())])


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash of the word, hash of its beginning) of all words of some bytes."""
    octets = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[octets], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    words, beginnings = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + _BYTES, "right")))
        first = start[a]
        runs = Rolling(octets[first : end[b - 1]].astype(np.uint64) + U64(1))
        words[a:b] = runs.at(start[a:b] - first, end[a:b] - start[a:b])
        beginnings[a:b] = mix64(runs.at(start[a:b] - first, np.minimum(end[a:b] - start[a:b], BEGINNING)))
        a = b
    return start, words, beginnings


def samples_of(term: np.ndarray, weight: np.ndarray, places: int = SAMPLES) -> np.ndarray:
    """For each term (a 64-bit hash) with its weight the value (upper half, as a fixed-point number) and the sample (lower half) at each
    place of a fingerprint."""
    out = np.empty((len(term), places), np.uint64)
    salt = mix64(np.arange(1, places + 1, dtype=np.uint64) * _ODD)
    log_weight = np.log(weight).astype(np.float32)
    bits = lambda x, at, n: ((x >> U64(at)) & U64((1 << n) - 1)).astype(np.float32)
    uniform = lambda x, at, n: (bits(x, at, n) + np.float32(0.5)) * np.float32(2.0**-n)
    for a in range(0, len(term), _TERMS):
        h = term[a : a + _TERMS, None]
        x = mix64(h ^ salt)
        y = mix64(x + _ODD)
        r = -np.log(uniform(x, 43, 21) * uniform(x, 22, 21))
        offset = bits(x, 0, 22) * np.float32(2.0**-22)
        t = np.floor(log_weight[a : a + _TERMS, None] / r + offset)
        value = np.log(-np.log(uniform(y, 40, 24)) - np.log(uniform(y, 16, 24))) - r * (t - offset + np.float32(1))
        fixed = np.clip((value + np.float32(64)) * np.float32(2.0**25), 0, np.float32(2.0**32 - 256)).astype(np.int64).view(np.uint64)
        sample = (h ^ (t.astype(np.int64).view(np.uint64) * _ODD)) >> U64(32)
        out[a : a + _TERMS] = (fixed << U64(32)) | sample
    return out


class Sampler:
    """Fingerprints of texts. The samples of weighted terms are remembered, up to a bound."""

    def __init__(self, places: int = SAMPLES):
        self.places = places
        self.table, self.part = np.empty((0, places), np.uint64), np.empty((_TERMS, places), np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.rows, self.used = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def _rows(self, term: np.ndarray, count: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The terms' rows of the table, which gets those that it doesn't have."""
        key, first, of = np.unique(mix64(term + count.astype(np.uint64) * _ODD), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        known = np.append(self.keys, U64(0))[at] == key
        known &= at < len(self.keys)
        new = first[~known]
        if self.used + len(new) > len(self.table):
            self.table = np.concatenate((self.table[: self.used], np.empty((len(new) + self.used // 2, self.places), np.uint64)))
        fresh = np.arange(self.used, self.used + len(new))
        self.table[self.used : self.used + len(new)] = samples_of(term[new], count[new] * unit[new], self.places)
        self.used += len(new)
        row = np.empty(len(key), np.int64)
        row[known], row[~known] = self.rows[at[known]], fresh
        keys, rows = np.concatenate((self.keys, key[~known])), np.concatenate((self.rows, fresh))
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]
        return row[of]

    def signatures(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(samples, number of terms) of each text; one without words has no terms and zeros."""
        if self.used > MOST_ROWS:
            self._forget()
        ends = np.cumsum([len(t) + 1 for t in texts])
        start, words, beginnings = hashed_words(b" ".join(texts))
        own = np.searchsorted(ends, start, "right")
        terms, number = np.unique(np.concatenate((words, beginnings)), return_inverse=True)
        unit = np.full(len(terms), BEGINNING_WEIGHT)
        unit[number[: len(words)]] = 1.0
        key, count = np.unique(np.concatenate((own, own)) * (len(terms) + 1) + number, return_counts=True)
        text, number = key // (len(terms) + 1), key % (len(terms) + 1)
        out = np.full((len(texts), self.places), np.iinfo(np.uint64).max)
        rows = self._rows(terms[number], count, unit[number])
        for a in range(0, len(rows), _TERMS):
            part = text[a : a + _TERMS]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            own = np.take(self.table, rows[a : a + _TERMS], axis=0, out=self.part[: len(part)], mode="clip")
            least = np.minimum.reduceat(own, first, axis=0)
            out[part[first]] = np.minimum(out[part[first]], least)
        many = np.bincount(text, minlength=len(texts))
        out = out.astype(np.uint32)
        out[many == 0] = 0
        return out, many


def as_text(samples: np.ndarray, many: int) -> str:
    """8 hexadecimal digits a place; empty for a text without terms."""
    return samples.astype(">u4").tobytes().hex() if many else ""


def likeness(a: np.ndarray, many_a: int, b: np.ndarray, many_b: int) -> float:
    """Share of places with the same sample; texts without terms are like one another and nothing else."""
    return float(np.mean(a == b)) if many_a and many_b else float(many_a == many_b)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _blocks(rows: Iterator, size) -> Iterator[list]:
    """Lists of rows with at most _BYTES together, or one row."""
    block, held = [], 0
    for row in rows:
        if block and held + size(row) > _BYTES:
            yield block
            block, held = [], 0
        block.append(row)
        held += size(row)
    if block:
        yield block


def _fingerprinter(places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(places)
        rows = ((i.as_py(), t.as_py() or "") for batch in batches for i, t in zip(batch.column(0), batch.column(1)))
        for block in _blocks(rows, lambda row: len(row[1])):
            samples, many = sampler.signatures([_bytes(t) for _, t in block])
            columns = [[i for i, _ in block], [len(t) for _, t in block], many, [as_text(s, m) for s, m in zip(samples, many)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return run


def fingerprints(docs: DataFrame, places: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars (code points), n_terms and fingerprint (8 hexadecimal digits a place).

    Words are what stands between the white space of ASCII; letters keep their case. Equal texts have equal fingerprints. Null and
    empty texts have no terms and an empty fingerprint; long texts count whole; ties between values go to the smaller sample; a null id
    stays null; repeated rows are taken each; an empty table gives an empty one; other columns are not read. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprinter(places), SCHEMA)


# ---- texts and what follows them

#: What a document's neighbour makes of it. `edge` is null in rows that are complete, `last` in those that miss the text behind the
#: partition's last row, `first` in copies of its first row; the latter two have their texts.
_PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge string, text string"
_PAIRED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64())]
    + [("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of another."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _paired(block: list[tuple[int | None, str, str]], sampler: Sampler, part: int | None) -> list[tuple]:
    """Rows of _PAIRED for (doc_id, text, text that follows)."""
    changed = [edited(t, u) for _, t, u in block]
    # the text that follows is the next row's own but for the last one
    chained = all(a[2] is b[1] for a, b in zip(block, block[1:]))
    after = [block[-1][2]] if chained else [u for _, _, u in block]
    samples, many = sampler.signatures([_bytes(t) for t in (*(t for _, t, _ in block), *changed, *after)])
    n, rows = len(block), []
    for k, (doc_id, text, _) in enumerate(block):
        following = k + 1 if chained and k + 1 < n else 2 * n + (0 if chained else k)
        of = lambda i: (samples[i], many[i])
        digest = hashlib.sha256(_bytes(changed[k])).hexdigest()
        rows.append((doc_id, len(text), digest, as_text(*of(k)), as_text(*of(n + k)), likeness(*of(k), *of(n + k)), likeness(*of(k), *of(following)), part, None, None))
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAIRED_ARROW)], schema=_PAIRED_ARROW)


def _neighbours(places: int):
    """Rows of a sorted partition with the ones that follow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, edges, sampler = TaskContext.get().partitionId(), [], Sampler(places)
        edge = lambda row, kind: (row[0], *(None,) * 6, part, kind, row[1])

        def pairs() -> Iterator[tuple[int | None, str, str]]:
            before = None
            for batch in batches:
                for i, t in zip(batch.column(0), batch.column(1)):
                    row = (i.as_py(), t.as_py() or "")
                    if before is None:
                        edges.append(edge(row, "first"))
                    else:
                        yield (*before, row[1])
                    before = row
            if before is not None:
                edges.append(edge(before, "last"))

        for block in _blocks(pairs(), lambda row: 2 * len(row[1])):
            yield _batch(_paired(block, sampler, part))
        if edges:
            yield _batch(edges)

    return run


def _edge_pairs(places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(places)
        for batch in batches:
            for i, t, u in zip(*(batch.column(k) for k in range(3))):
                yield _batch(_paired([(i.as_py(), t.as_py(), u.as_py())], sampler, None))

    return run


def neighbour_fingerprints(docs: DataFrame, places: int = SAMPLES) -> DataFrame:
    """One row per input row: doc_id, n_chars, fingerprint, the digest and fingerprint of the text with its last quarter replaced by
    the beginning of the next document's, and the likeness of the fingerprint to that one's (near_edited) and the next document's
    (near_next).

    Documents follow one another by id, those with equal ids by a hash of their texts, null ids first; the first comes after the last, so
    a single one follows itself. The rows are sorted by range, which carries each text once; what is missing at the end of a partition
    is joined from the first row of the next one. Null texts are empty; otherwise the rules of `fingerprints` hold.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "weighted-sampling")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"_id": safe_id("doc_id"), "_tie": F.xxhash64("text")})
    ordered = rows.repartitionByRange(partitions(spark), "_id", "_tie").sortWithinPartitions("_id", "_tie", "text")
    done = scratch.save(ordered.select("doc_id", "text").mapInArrow(_neighbours(places), _PAIRED), "neighbours")
    edges = done.filter(F.col("edge").isNotNull())
    parts = sorted(r["part"] for r in edges.filter("edge = 'first'").select("part").collect())  # a number for each partition
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    last = edges.filter("edge = 'last'").select("part", "doc_id", "text").join(following, "part")
    first = edges.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = last.join(first, "next_part").select("doc_id", "text", "next_text").mapInArrow(_edge_pairs(places), _PAIRED)
    return done.filter(F.col("edge").isNull()).unionByName(ends).drop("part", "edge", "text")


def op12_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
