"""Fuzzy search for short license notices.

A text is reduced to its words joined by single spaces. A notice that may have k edits is cut into k + 1 pieces: a match
with at most k edits leaves one piece untouched (pigeonhole), so exact occurrences of the pieces locate all candidates.
Around each of them the `regex` library's bounded-error matching verifies the edits and gives the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import letters_and_digits

#: Fixed phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Further notices that the fuzzy search knows.
MORE = (("gnu general public license", "gpl"), ("mozilla public license", "mpl"), ("creative commons attribution", "cc-by"), ("bsd 3 clause license", "bsd-3"))
#: A notice may have one edit (of a byte) for so many of its bytes; shorter ones are searched exactly.
BYTES_PER_EDIT = 12

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,edits:int>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])))]
)


@dataclass
class Notice:
    """A phrase with its label, its number of edits and its exact seeds."""

    phrase: bytes
    label: str
    edits: int = field(init=False)
    seeds: list[tuple[int, bytes]] = field(init=False)

    def __post_init__(self):
        n = len(self.phrase)
        self.edits = n // BYTES_PER_EDIT
        cuts = [n * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.seeds = [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.verify = regex.compile(rb"(?b)(?:%b){e<=%d}" % (regex.escape(self.phrase), self.edits))
        self.digits = sorted(c for c in self.phrase if 48 <= c <= 57)


def places(text: bytes, part: bytes) -> Iterator[int]:
    """Starts of all occurrences, overlapping ones too."""
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def fuzzy_spans(text: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice's matches in a text of words between single spaces.

    Digits must be the phrase's own: another version number is another license. Every stretch of whole words around a seed is
    verified by itself; of matches that overlap, the one with the fewest edits counts.
    """
    k, n = notice.edits, len(notice.phrase)
    found = {}
    for low in {at - offset for offset, seed in notice.seeds for at in places(text, seed)}:
        ends = [e for e in range(max(low + n - 2 * k, 1), min(low + n + 2 * k, len(text) - 1) + 1) if text[e] == 32]
        for start in range(max(low - k, 1), low + k + 1):
            if text[start - 1 : start] != b" ":
                continue
            for end in ends:
                if (start, end) not in found and abs(end - start - n) <= k:
                    found[start, end] = _edits(text[start:end], notice)
    out, taken = [], bytearray(len(text))
    for start, end, edits in sorted(((a, b, e) for (a, b), e in found.items() if e is not None), key=lambda m: (m[2], abs(m[1] - m[0] - n), m[0])):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, edits))
    return sorted(out)


def _edits(part: bytes, notice: Notice) -> int | None:
    """Edits between the notice and these words, None beyond its bound or with other digits."""
    if sorted(c for c in part if 48 <= c <= 57) != notice.digits:
        return None
    m = notice.verify.fullmatch(part)
    return sum(m.fuzzy_counts) if m else None


def scan_text(text: str | None, base: tuple = BASE, notices: list[Notice] | None = None) -> tuple:
    """The columns of SCHEMA but the id, for one text."""
    words = letters_and_digits(text).split()
    joined = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    index = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731  the word that begins at or after this place
    starts, base_labels, spans, score = [], set(), [], 0.0
    for phrase, label in base:
        for at in places(joined, b" " + phrase.encode() + b" "):
            starts.append(index(at))
            base_labels.add(label)
            score = 1.0
    for notice in notices if notices is not None else _notices():
        for start, end, edits in fuzzy_spans(joined, notice):
            spans.append({"label": notice.label, "first_word": index(start) - 1, "n_words": joined.count(b" ", start, end) + 1, "edits": edits})
            score = max(score, 1 - edits / len(notice.phrase))
    labels = base_labels | {s["label"] for s in spans}
    join = lambda x: ",".join(sorted(x))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), join(base_labels), join(labels), score, spans


def _notices() -> list[Notice]:
    if not _KNOWN:
        _KNOWN.extend(Notice(p.encode(), label) for p, label in BASE + MORE)
    return _KNOWN


_KNOWN: list[Notice] = []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan_text(t.as_py()) for t in batch.column(1)]
        columns = [batch.column(0), *zip(*rows)] if rows else [[]] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: word count, exact places of the base phrases, labels with those of the fuzzy search, best
    score (1 for an exact match) and spans in words.

    Words are maximal runs of digits, letters and non-ASCII characters after A-Z are lower-cased. Null and empty texts have no
    words and no labels; long texts are scanned whole; of overlapping matches the one with the fewest edits, the most fitting
    length and then the first place counts; a null id stays null; repeated rows are scanned each; an empty table gives an empty
    one; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are given as `label:first word+words~edits`, in the order of notices and places."""
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = F.transform("spans", lambda s: F.concat(s["label"], F.lit(":"), s["first_word"].cast("string"), F.lit("+"), s["n_words"].cast("string"), F.lit("~"), s["edits"].cast("string")))
    return found.withColumns({"n_spans": F.size("spans").cast("long"), "spans": F.array_join(shown, " ")})
