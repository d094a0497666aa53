"""Toxicity by a classifier chain.

The categories are predicted one after the other by logistic regressions; each later model also sees the probabilities
of the earlier categories. In training those probabilities are out-of-fold predictions, so that a later model learns how
far an earlier one can be trusted on texts it hasn't seen; features are chosen anew within each fold. The models are fitted on
a bounded sample of labelled rows; every text is scored whole.

Features are how often a text has a word, a run of punctuation or a beginning of a word, as insults are inflected. A feature is
scaled by the square of the standard errors that its mean differs by between the classes, so the regularisation trusts
features as far as the labels speak for them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that the models are fitted on at most; folds; the probability that rejects.
MAX_TRAIN_ROWS = 4000
FOLDS = 5
THRESHOLD = 0.4
#: Letters at the beginning of a word that are features of their own.
PREFIXES = (3, 4, 5, 6)
#: Order of the chain: a text's form is judged before its content.
CATEGORIES = ("low_quality", "toxic")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
#: Standard errors below which a difference is noise; those at which a feature is taken as it is; strength of the regularisation.
NOISE, FULL, L2 = 1.5, 4.0, 0.1
#: Documents of the sample that a feature must occur in.
MIN_DOCS = 3
#: Words whose features a task remembers.
_REMEMBERED = 100_000


@dataclass
class Rows:
    """A sparse matrix: value at (row, column), in the order of the rows. Narrow types, as the driver holds the whole sample."""

    n: int
    width: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, self.n)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row] * self.value, self.width)

    def of(self, chosen: np.ndarray) -> Rows:
        keep = chosen[self.row]
        return Rows(int(chosen.sum()), self.width, (np.cumsum(chosen) - 1).astype(np.int32)[self.row[keep]], self.column[keep], self.value[keep])

    def beside(self, dense: np.ndarray) -> Rows:
        """With further dense columns, and a last one of ones."""
        more = np.hstack([dense, np.ones((self.n, 1))])
        k = more.shape[1]
        row, column = np.repeat(np.arange(self.n), k), np.tile(np.arange(k) + self.width, self.n)
        return Rows(self.n, self.width + k, *(np.concatenate(x) for x in ((self.row, row), (self.column, column), (self.value, more.ravel()))))


@dataclass
class Chain:
    """Features (sorted hashes) and, for each category in order, the weights of the features, the earlier categories and the bias."""

    categories: tuple[str, ...]
    features: np.ndarray
    weights: list[np.ndarray]

    def predict(self, x: Rows) -> np.ndarray:
        out = np.zeros((x.n, len(self.categories)))
        for k, w in enumerate(self.weights):
            out[:, k] = _probability(x.times(w[: x.width]) + out[:, :k] @ w[x.width : -1] + w[-1])
        return out


def hashed(words: Iterable[str]) -> np.ndarray:
    """Hashes (first row, sorted) and counts of words, a set or a Counter."""
    total: Counter = Counter()
    for w, n in Counter(words).items():
        total[zlib.crc32(w.encode("utf-8", "surrogatepass"))] += n
    names = sorted(total)
    return np.array([names, [total[h] for h in names]], np.uint32).reshape(2, -1)


def features_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def tokens(text: str | None) -> np.ndarray:
    """Hashes and counts of a text's features."""
    total: Counter = Counter()
    for w, n in Counter(_TOKEN.findall((text or "").lower())).items():
        for f in features_of(w):
            total[f] += n
    return hashed(total)


def design(docs: list[np.ndarray], features: np.ndarray) -> Rows:
    """How often (log scale) which document has which of the sorted features."""
    name, count = (np.concatenate([np.empty(0, np.uint32), *(d[i] for d in docs)]) for i in (0, 1))
    row = np.repeat(np.arange(len(docs), dtype=np.int32), [d.shape[1] for d in docs])
    at = np.minimum(np.searchsorted(features, name), max(0, len(features) - 1)).astype(np.int32)
    known = features[at] == name if len(features) else np.zeros(len(row), bool)
    return Rows(len(docs), len(features), row[known], at[known], np.log1p(count[known].astype(np.float32)))


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Rows, y: np.ndarray, l2: float = L2, rounds: int = 200) -> np.ndarray:
    """Weights (the last is the bias, which isn't shrunk) with the least regularised log loss, by L-BFGS."""
    shrink = np.append(np.full(x.width - 1, l2), 1e-6)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w)
        return float((np.logaddexp(0, z) - y * z).sum() + (shrink * w * w).sum() / 2), x.transposed_times(_probability(z) - y) + shrink * w

    w = np.zeros(x.width)
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max(initial=0) < 1e-5 * max(1, x.n):
            break
        step, kept = -slope, []
        for s, t in reversed(past):
            kept.append(s @ step / (s @ t))
            step = step - kept[-1] * t
        step = step * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / np.abs(slope).max())
        for (s, t), a in zip(past, reversed(kept)):
            step = step + (a - t @ step / (s @ t)) * s
        size, down = 1.0, slope @ step
        while (new := loss(w + size * step))[0] > value + 1e-4 * size * down and size > 1e-9:
            size /= 2
        s, t = size * step, new[1] - slope
        past = [*past, (s, t)][-8:] if s @ t > 1e-12 else past
        w, value, slope = w + s, *new
    return w


def scales(x: Rows, y: np.ndarray) -> np.ndarray:
    """What each feature is multiplied by: 0 for noise, else by how far its means differ between the classes."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if n.min() == 0:
        return np.zeros(x.width)
    both, ones = x.transposed_times(np.ones(x.n)), x.transposed_times(y)
    square = np.bincount(x.column, x.value**2, x.width)
    variance = np.maximum(square / x.n - (both / x.n) ** 2, 0) + 1 / x.n
    z = np.abs(ones / n[1] - (both - ones) / n[0]) / np.sqrt(variance * (1 / n[0] + 1 / n[1]))
    return np.where(z >= NOISE, (z / FULL) ** 2, 0)


def _fit(x: Rows, earlier: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of all features, of the earlier categories and the bias; those of features that aren't used are 0."""
    scale = scales(x, y)
    number, used = np.cumsum(scale > 0) - 1, scale[x.column] > 0
    small = Rows(x.n, int((scale > 0).sum()), x.row[used], number[x.column[used]], (x.value * scale[x.column])[used])
    w = fit_logistic(small.beside(earlier), y)
    out = np.zeros(x.width + earlier.shape[1] + 1)
    out[: x.width][scale > 0] = w[: small.width] * scale[scale > 0]
    out[x.width :] = w[small.width :]
    return out


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, categories: tuple[str, ...], folds: np.ndarray) -> Chain:
    """Fits the models in order; earlier probabilities come from models that didn't see the row's fold.

    labels: 0, 1 or NaN (not labelled for this category; the row is then not used for its model).
    """
    names, count = np.unique(np.concatenate([np.empty(0, np.uint32), *(d[0] for d in docs)]), return_counts=True)
    names = names[count >= MIN_DOCS]
    x = design(docs, names)
    earlier, weights = np.zeros((len(docs), 0)), []
    for k in range(len(categories)):
        y = labels[:, k]
        known, oof = ~np.isnan(y), np.zeros(len(docs))
        predict = lambda w: _probability(x.times(w[: x.width]) + earlier @ w[x.width : -1] + w[-1])
        for f in np.unique(folds) if k + 1 < len(categories) else ():
            train, held = known & (folds != f), folds == f
            oof[held] = predict(_fit(x.of(train), earlier[train], y[train]))[held] if train.any() else 0.0
        weights.append(_fit(x.of(known), earlier[known], y[known]) if known.any() else np.r_[np.zeros(x.width + k), -30.0])
        earlier = np.hstack([earlier, oof[:, None]])
    used = np.any([w[: x.width] != 0 for w in weights], axis=0)
    return Chain(categories, names[used], [np.r_[w[: x.width][used], w[x.width :]] for w in weights])


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tokens(t.as_py()) for t in batch.column("text")]
        words = [pa.array([f[i].view(np.int32) for f in found], pa.list_(pa.int32())) for i in (0, 1)]
        keep = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*keep.columns, *words], names=[*keep.schema.names, "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Chain | None:
    """Fits the chain on the max_rows labelled documents with the smallest hashes of their ids.

    labels has doc_id, quality and toxic; null labels say nothing. Of several labels for one id the largest counts, of
    several texts the smallest. None without labelled documents.
    """
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(1 - F.col("quality")).cast("double").alias("low_quality"), F.max("toxic").cast("double").alias("toxic"))
    marked = marked.filter("label_id is not null and (low_quality is not null or toxic is not null)")
    ids = docs.select(F.col("doc_id").cast("long").alias("label_id")).join(marked, "label_id").distinct()
    chosen = ids.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)  # at most max_rows short rows: safe to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "label_id")
    rows = rows.groupBy("label_id", *CATEGORIES).agg(F.min("text").alias("text"))  # repeats of an id don't reach the driver
    schema = "label_id long, low_quality double, toxic double, words array<int>, counts array<int>"
    got = rows.mapInArrow(_tokenise, schema).toArrow().sort_by("label_id")
    if not got.num_rows:
        return None
    flat = [got.column(c).combine_chunks().flatten().to_numpy().view(np.uint32) for c in ("words", "counts")]
    cuts = np.cumsum(got.column("words").combine_chunks().value_lengths().to_numpy())[:-1]
    folds = (got.column("label_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % FOLDS
    marks = np.stack([got.column(c).to_numpy() for c in CATEGORIES], 1).astype(np.float64)
    flat = np.stack(flat)
    del got
    return fit_chain(np.split(flat, cuts, axis=1), marks, CATEGORIES, folds)


#: Texts whose features are held together.
_AT_ONCE = 128


class Columns(dict):
    """Columns of a word's features in a chain, remembered up to a bound."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.number = dict(zip(chain.features.tolist(), range(len(chain.features))))

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= _REMEMBERED:
            self.clear()
        hashes = (zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in features_of(word))
        value = self[word] = [self.number[h] for h in hashes if h in self.number]
        return value


def probabilities(texts: pa.Array, chain: Chain | None, columns: Columns | None) -> np.ndarray:
    """Rows of probabilities in the order of CATEGORIES; all 0 where there is no model. Texts are taken _AT_ONCE by _AT_ONCE, so a task needs
    memory for their features only."""
    if chain is None:
        return np.zeros((len(texts), len(CATEGORIES)))
    return np.concatenate([np.zeros((0, len(CATEGORIES))), *(_probabilities(texts.slice(a, _AT_ONCE), chain, columns) for a in range(0, len(texts), _AT_ONCE))])


def _probabilities(texts: pa.Array, chain: Chain, columns: Columns) -> np.ndarray:
    row, column, value = [], [], []
    for i, text in enumerate(texts):
        total: dict[int, int] = {}
        for w, n in Counter(_TOKEN.findall((text.as_py() or "").lower())).items():
            for c in columns[w]:
                total[c] = total.get(c, 0) + n
        row.append(np.full(len(total), i))
        column += total
        value += total.values()
    whole = Rows(len(texts), len(chain.features), np.concatenate([np.empty(0, np.int64), *row]), np.array(column, np.int64), np.log1p(np.array(value, float)))
    return chain.predict(whole)


def _score(chain: Chain | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = Columns(chain) if chain else None
        for batch in batches:
            p = probabilities(batch.column("text"), chain, columns)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in p.T)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES)])

    return run


def _clean(chain: Chain | None, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = Columns(chain) if chain else None
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column(text_at), chain, columns)[:, CATEGORIES.index("toxic")] < THRESHOLD))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, p_low_quality, p_toxic, toxic (0 or 1), kept.

    A document is rejected when its toxic probability reaches the threshold. Null and empty texts have no words and are
    judged by the bias alone; long texts are counted whole; null ids are scored too; repeated rows get equal scores; without
    labels nothing is rejected. Other columns of either table are not read.
    """
    chain = train(docs, labels, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad = F.col("p_toxic") >= threshold
    scored = rows.mapInArrow(_score(chain), "doc_id long, p_low_quality double, p_toxic double")
    return scored.select("doc_id", "p_low_quality", "p_toxic", bad.cast("int").alias("toxic"), (~bad).alias("kept"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, with all their columns.

    Nulls, empty texts, repeated rows and missing labels as in `toxicity`; an empty table gives an empty one.
    """
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.mapInArrow(_clean(chain, docs.columns.index("text")), docs.schema)
