"""Hierarchical packing of documents into sequences of several lengths.

Every document, as token ids and a closing id 0, is routed to the tier of the shortest window that holds it; what is longer than
the longest window first fills whole windows of its own. A tier's documents open windows of its length, and the gaps are
filled from the shorter tiers, best fit first, then by a piece cut to size. When all shorter documents are used, the
gap is filled by cutting the next document of the tier. So windows are full, but for the last of a batch; that one is
cut into windows of powers of two, which need no padding. Windows are dealt out to step groups of equal tokens and about
equal attention cost.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Context sizes from the longest to the shortest, and the tokens of a training step.
TIERS = (1024, 512, 256)
STEP_TOKENS = 16_384
VOCABULARY = "byte_bpe_50k"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group")
SCHEMA = ", ".join(f"{c} long" for c in _FIELDS)
_ARROW = pa.schema([(c, pa.int64()) for c in _FIELDS])


def load_encoder(vocabulary: str = VOCABULARY):
    """text -> uint32 ids of the public byte-level vocabulary.

    The ranks file and the JSON file hold the same vocabulary and give the same ids; the ranks' library is about five times
    as fast. The JSON file's library, whose ids are the reference, takes the texts that the other can't: those with the special
    token's own string, and those with runs of white space beyond what the other's pattern matching goes back over (about a
    million), which it refuses.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    pairs = map(bytes.split, open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb"))
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" not in text:
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
            except ValueError:
                pass
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


@dataclass
class Window:
    """A sequence under construction: (document, start, length) in order."""

    size: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)
    used: int = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.pieces.append((doc, start, length))
        self.used += length

    @property
    def cost(self) -> int:
        return sum(n * n for _, _, n in self.pieces)


class Tier:
    """Pieces of a tier, ordered by length."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []  # (length, document, start)

    def add(self, length: int, doc: int, start: int) -> None:
        item = (length, doc, start)
        self.items.insert(bisect_right(self.items, item), item)

    def best_fit(self, most: int) -> tuple[int, int, int] | None:
        at = bisect_right(self.items, (most, np.inf, np.inf))
        return self.items.pop(at - 1) if at else None


def _tier_of(length: int, tiers: tuple[int, ...]) -> int:
    return max(k for k, size in enumerate(tiers) if length <= size)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[Window]:
    """Windows for documents of these lengths (each at least 1); every token is in exactly one piece."""
    windows: list[Window] = []
    queues = [Tier() for _ in tiers]
    for doc, n in enumerate(lengths):
        whole = n // tiers[0]
        for k in range(whole):
            windows.append(Window(tiers[0]))
            windows[-1].put(doc, k * tiers[0], tiers[0])
        if n % tiers[0]:
            queues[_tier_of(n % tiers[0], tiers)].items.append((n % tiers[0], doc, whole * tiers[0]))
    for q in queues:
        q.items.sort()
    for k, size in enumerate(tiers):
        while queues[k].items:
            window = Window(size)
            length, doc, start = queues[k].items.pop()
            window.put(doc, start, length)
            for shorter in queues[k + 1 :]:
                while window.used < size and (item := shorter.best_fit(size - window.used)):
                    window.put(item[1], item[2], item[0])
            while window.used < size and (source := next((q for q in reversed(queues[k:]) if q.items), None)):
                # cut the shortest document there is; its rest finds its own tier
                length, doc, start = source.items.pop(0)
                take = min(length, size - window.used)
                window.put(doc, start, take)
                if length > take:
                    queues[_tier_of(length - take, tiers)].add(length - take, doc, start + take)
            windows.extend([window] if window.used == size else _powers(window))
    return windows


def _powers(window: Window) -> list[Window]:
    """The window's pieces, cut into windows whose lengths are powers of two."""
    out, left, pieces = [], window.used, list(window.pieces)
    while left:
        part = Window(1 << (left.bit_length() - 1))
        while part.used < part.size:
            doc, start, n = pieces.pop(0)
            take = min(n, part.size - part.used)
            part.put(doc, start, take)
            if n > take:
                pieces.insert(0, (doc, start + take, n - take))
        out.append(part)
        left -= part.size
    return out


def step_groups(windows: list[Window], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: groups hold windows of one length with step_tokens tokens together, and windows are dealt
    out by falling attention cost, back and forth, so that the groups of a length cost about the same."""
    group, first = [0] * len(windows), 0
    for size in sorted({w.size for w in windows}, reverse=True):
        own = sorted((i for i, w in enumerate(windows) if w.size == size), key=lambda i: (-windows[i].cost, i))
        n = -(-len(own) * size // step_tokens)
        for rank, i in enumerate(own):
            turn, at = divmod(rank, n)
            group[i] = first + (n - 1 - at if turn % 2 else at)
        first += n
    return group


def _packer(vocabulary: str, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = load_encoder(vocabulary), TaskContext.get().partitionId() << 32
        n_sequences = n_groups = 0
        for batch in batches:
            doc_ids, docs = batch.column(0).to_pylist(), [np.append(encode(t.as_py() or ""), np.uint32(0)) for t in batch.column(1)]
            windows = pack([len(d) for d in docs], tiers)
            groups, rows = step_groups(windows), []
            for w, group in zip(windows, groups):
                offset = 0
                for doc, start, n in w.pieces:
                    crc = zlib.crc32(docs[doc][start : start + n].astype("<u4").tobytes())
                    rows.append((doc_ids[doc], start, n, crc, len(docs[doc]), base + n_sequences, offset, w.size, base + n_groups + group))
                    offset += n
                n_sequences += 1
            n_groups += max(groups, default=-1) + 1
            columns = zip(*rows) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return run


def packing(docs: DataFrame, vocabulary: str = VOCABULARY, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset (in the
    sequence), window (the sequence's length) and step_group.

    Each task packs its own rows batch by batch, so nothing is shuffled; step groups are balanced within a batch. Sequence ids hold
    the partition's number in their upper bits. Null and empty texts are the closing id alone. Long texts, long runs of white space
    too, are encoded whole and cut into as many windows as it takes. Pieces of one length are taken in the order of the batch. A
    null id stays null; repeated rows are packed each; an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(vocabulary, tiers), SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of `packing`, with its rules for nulls, empty and long texts, repeated rows and empty tables."""
    return packing(docs)
