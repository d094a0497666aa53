"""Language identification by a linear-chain conditional random field over the words of a text.

Every word gets a language; features are the word, its affixes, its character n-grams and its entries in lexicons learned
from the labelled texts, and the transitions between the languages of neighbouring words are learned as well. Training
sequences are spliced from stretches of labelled texts, so that switches of language within a text occur. A whole text is
labelled by forward-backward; its language is the one with the largest sum of word posteriors.

Forward-backward runs over blocks of BLOCK words: the product of a block's transfer matrices is computed for all blocks at
once, messages are passed from block to block, then the words within all blocks are labelled at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labelled texts, read whole, that the model is fitted on, for each language and together; words of the stretches that they are cut into.
ROWS_PER_LANGUAGE = 100
MAX_TRAIN_ROWS = 6000
STRETCH_WORDS = 12
#: Stretches of a training sequence, and how often the next one is of the same language.
SPLICE, STAY = 4, 0.5
FEATURES = 1 << 16
EPOCHS, RATE, L2 = 2, 0.2, 1e-5
BLOCK = 32
UNKNOWN = "und"
#: Longer runs of letters, as of scripts without blanks, are cut into pieces of so many letters, each a word of its own.
WORD_LETTERS = 40
_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{WORD_LETTERS - 1}}}")
#: Words whose features a task remembers.
_REMEMBERED = 300_000

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, word_langs string"


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L) with their marks, lower-cased, in pieces of at most WORD_LETTERS; every letter is in one."""
    return _WORD.findall((text or "").lower())


def features_of(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a word: itself, prefixes, suffixes, 2- and 3-grams, and the language whose lexicon has it."""
    edged = f"^{word}$"
    names = [word, "=" + str(lexicon.get(word, -1))]
    names += ["<" + word[:n] for n in (1, 2, 3)] + [">" + word[-n:] for n in (1, 2, 3, 4)]
    names += [edged[i : i + 2] for i in range(len(edged) - 1)] + [edged[i : i + 3] for i in range(len(edged) - 2)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in set(names)]


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # FEATURES x languages
    transitions: np.ndarray  # languages x languages, log scale


def messages(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Posteriors of every word's language for sequences laid end to end.

    scores: words x languages (log scale); lengths: words of each sequence, summing up to the words.
    """
    n_lang = scores.shape[1]
    move = np.exp(transitions - transitions.max())
    per = -(-lengths // BLOCK)
    total = int(per.sum())
    first_block = np.concatenate(([0], np.cumsum(per)))[:-1]
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    seq = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(scores)) - starts[seq]
    row, col = first_block[seq] + inside // BLOCK, inside % BLOCK
    x = np.zeros((BLOCK, total, n_lang))
    used = np.zeros((BLOCK, total, 1), bool)
    x[col, row] = np.exp(scores - scores.max(axis=1, keepdims=True))
    used[col, row] = True
    start = np.zeros((total, 1), bool)
    start[first_block[per > 0]] = True
    # transfer matrices: whatever comes before, times the transitions (not before the first word of a sequence), times the word
    transfer = np.broadcast_to(np.eye(n_lang), (total, n_lang, n_lang)).copy()
    for t in range(BLOCK):
        moved = (transfer.reshape(-1, n_lang) @ move).reshape(transfer.shape)
        new = (np.where(start[:, :, None], transfer, moved) if t == 0 else moved) * x[t][:, None, :]
        new /= np.maximum(new.sum(axis=(1, 2), keepdims=True), 1e-300)
        transfer = np.where(used[t][:, :, None], new, transfer)
    before, after = np.full((total, n_lang), 1 / n_lang), np.full((total, n_lang), 1 / n_lang)
    for k in range(1, int(per.max(initial=0))):
        b = first_block[per > k] + k
        before[b] = _scaled((before[b - 1][:, None, :] @ transfer[b - 1])[:, 0])
    for k in range(1, int(per.max(initial=0))):
        b = (first_block + per)[per > k] - 1 - k
        after[b] = _scaled((transfer[b + 1] @ after[b + 1][:, :, None])[:, :, 0])
    ahead = np.empty((BLOCK, total, n_lang))
    message = before
    for t in range(BLOCK):
        moved = np.where(start, message, message @ move) if t == 0 else message @ move
        message = np.where(used[t], _scaled(moved * x[t]), message)
        ahead[t] = message
    message = after
    out = np.empty((BLOCK, total, n_lang))
    for t in range(BLOCK - 1, -1, -1):
        out[t] = ahead[t] * message
        message = np.where(used[t], _scaled((message * x[t]) @ move.T), message)
    return _scaled(out[col, row])


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def pair_posteriors(scores: np.ndarray, transitions: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of one length n: word posteriors and the expected number of each transition, by forward-backward."""
    x = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(-1, n, scores.shape[1])
    move = np.exp(transitions)
    forward, backward = np.empty_like(x), np.ones_like(x)
    forward[:, 0] = _scaled(x[:, 0])
    for t in range(1, n):
        forward[:, t] = _scaled((forward[:, t - 1] @ move) * x[:, t])
    for t in range(n - 2, -1, -1):
        backward[:, t] = _scaled((backward[:, t + 1] * x[:, t + 1]) @ move.T)
    counts = np.zeros_like(transitions)
    for t in range(1, n):
        p = forward[:, t - 1][:, :, None] * move * (backward[:, t] * x[:, t])[:, None, :]
        counts += (p / np.maximum(p.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
    return _scaled(forward * backward).reshape(scores.shape), counts


def learn_lexicon(stretches: list[tuple[int, list[str]]], n_lang: int) -> dict[str, int]:
    """Words that are, relative to the languages' sizes, at least five times as frequent in one language as in all others together."""
    counts = [Counter() for _ in range(n_lang)]
    for lang, words in stretches:
        counts[lang].update(words)
    sizes = np.array([max(1, sum(c.values())) for c in counts])
    found = []
    for w in set().union(*counts):
        rates = np.array([c[w] for c in counts]) / sizes
        best = int(rates.argmax())
        if counts[best][w] >= 3 and rates[best] >= 5 * (rates.sum() - rates[best]):
            found.append((w, best))
    return dict(found)


def fit(stretches: list[tuple[str, list[str]]]) -> Model | None:
    """Stochastic gradient ascent (with per-weight rates) on the log likelihood of the spliced sequences."""
    languages = sorted({lang for lang, _ in stretches})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    data = [(number[lang], words) for lang, words in stretches]
    lexicon = learn_lexicon(data, len(languages))
    rng = np.random.default_rng(7)
    by_lang = [[w for lang, w in data if lang == k] for k in range(len(languages))]
    known: dict[str, np.ndarray] = {}
    model = Model(languages, lexicon, np.zeros((FEATURES, len(languages))), np.zeros((len(languages),) * 2))
    seen_w, seen_t = np.full(FEATURES, 1e-3), np.full(model.transitions.shape, 1e-3)
    length = SPLICE * STRETCH_WORDS
    for epoch in range(EPOCHS):
        # every stretch once; within a language in random order, the languages drawn by what they have left
        left = [list(rng.permutation(len(own))) for own in by_lang]
        words, labels, lang = [], [], None
        while any(left):
            if lang is None or not left[lang] or rng.random() > STAY:
                share = np.cumsum([len(own) for own in left])
                lang = int(np.searchsorted(share, rng.integers(share[-1]), "right"))
            pick = by_lang[lang][left[lang].pop()]
            words += pick
            labels += [lang] * len(pick)
        # what doesn't fill a last sequence is filled up from the beginning
        n = -(-len(words) // length) * length
        words, labels = [words[i % len(words)] for i in range(n)], [labels[i % len(labels)] for i in range(n)]
        sequences = [(words[i : i + length], labels[i : i + length]) for i in range(0, n, length)]
        for at in range(0, len(sequences), 64):
            part = sequences[at : at + 64]
            flat, gold = [w for s, _ in part for w in s], np.array([y for _, s in part for y in s])
            for w in flat:
                if w not in known:
                    known[w] = np.array(features_of(w, lexicon))
            ids = [known[w] for w in flat]
            sizes, joined = np.array([len(i) for i in ids]), np.concatenate(ids)
            cuts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            posterior, moves = pair_posteriors(np.add.reduceat(model.weights[joined], cuts), model.transitions, length)
            error = -posterior
            error[np.arange(len(gold)), gold] += 1
            used, where = np.unique(joined, return_inverse=True)
            spread = np.repeat(error, sizes, axis=0)
            slope = np.stack([np.bincount(where, spread[:, k], len(used)) for k in range(len(languages))], 1) / len(part) - L2 * model.weights[used]
            seen_w[used] += (slope**2).sum(axis=1)
            model.weights[used] += RATE * slope / np.sqrt(seen_w[used])[:, None]
            pairs = gold.reshape(-1, length)
            wanted = np.zeros_like(moves)
            np.add.at(wanted, (pairs[:, :-1].ravel(), pairs[:, 1:].ravel()), 1)
            slope = (wanted - moves) / len(part)
            seen_t += slope**2
            model.transitions += RATE * slope / np.sqrt(seen_t)
    return model


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each whole text in consecutive stretches, a row for each."""
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(*batch.columns):
            words = words_of(text.as_py())
            own = [" ".join(words[at : at + STRETCH_WORDS]) for at in range(0, len(words), STRETCH_WORDS)]
            langs += [lang.as_py()] * len(own)
            out += own
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], names=["lang", "words"])


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model | None:
    """Fits the model on at most ROWS_PER_LANGUAGE texts of each language and MAX_TRAIN_ROWS together, those with the smallest hashes of
    their ids. Only text and language of documents that aren't held out are read; None where no text is labelled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.select("doc_id", "lang").withColumn("rank", rank).filter(F.col("rank") <= ROWS_PER_LANGUAGE).orderBy("rank", "lang").limit(MAX_TRAIN_ROWS)
    # at most MAX_TRAIN_ROWS short rows: safe to broadcast
    texts = rows.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")  # repeats don't reach the driver
    got = texts.mapInArrow(_stretches, "lang string, words string").toArrow()
    rows = sorted(zip(got.column("lang").to_pylist(), got.column("words").to_pylist()))
    return fit([(lang, words.split(" ")) for lang, words in rows])


class WordScores:
    """Scores of words under a model; those of the last words seen are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)))

    def of(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in dict.fromkeys(words) if w not in self.rows]
        if len(self.rows) + len(fresh) > _REMEMBERED and self.rows:
            self.clear()
            fresh = list(dict.fromkeys(words))
        if fresh:
            ids = [features_of(w, self.model.lexicon) for w in fresh]
            cuts = np.concatenate(([0], np.cumsum([len(i) for i in ids])))[:-1]
            low = len(self.rows)
            self.rows.update(zip(fresh, range(low, low + len(fresh))))
            while len(self.table) < len(self.rows):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[low : low + len(fresh)] = np.add.reduceat(self.model.weights[np.concatenate([np.array(i) for i in ids])], cuts)
        return self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]


def label_words(texts: list[list[str]], scores: WordScores) -> list[np.ndarray]:
    """Posteriors (words x languages) of each text's words."""
    lengths = np.array([len(w) for w in texts])
    posterior = messages(scores.of([w for own in texts for w in own]), scores.model.transitions, lengths)
    return np.split(posterior, np.cumsum(lengths)[:-1])


def word_runs(posterior: np.ndarray, languages: list[str]) -> str:
    """The words' languages in order, as `en*12 de*3`."""
    label = posterior.argmax(axis=1)
    cuts = np.flatnonzero(np.diff(label)) + 1
    return " ".join(f"{languages[label[a]]}*{b - a}" for a, b in zip([0, *cuts], [*cuts, len(label)]))


def _predict(model: Model | None, most_words: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(model) if model else None
        for batch in batches:
            langs, probs, runs = [], [], []
            pending: list[list[str]] = []

            def flush() -> None:
                whole = [w for w in pending if w]
                found = iter(label_words(whole, scores)) if whole else iter(())
                for own in pending:
                    posterior = next(found) if own else None
                    mean = posterior.mean(axis=0) if own else None
                    runs.append(word_runs(posterior, model.languages) if own else "")
                    langs.append(UNKNOWN if mean is None else model.languages[int(mean.argmax())])
                    probs.append(0.0 if mean is None else float(min(1.0, mean.max())))
                pending.clear()

            size = 0
            for text in batch.column("text"):
                words = words_of(text.as_py()) if model else []
                if size + len(words) > most_words and pending:
                    flush()
                    size = 0
                pending.append(words)
                size += len(words)
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(probs, pa.float64()), pa.array(runs, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "word_langs"])

    return run


def language_id(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (mean posterior of the language over the words), word_langs (the
    words' own languages in order, see `word_runs`).

    Without a model one is fitted on the documents that aren't held out. Runs of letters beyond WORD_LETTERS count as several
    words; texts of any length are labelled whole. Of languages with equal scores the first by name counts. Null texts and texts
    without a letter are `und` with score 0, as is everything when no text is labelled. A null id isn't held out and never learned
    from; repeated rows get equal predictions; an empty table gives an empty one; other columns are not read.
    """
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), SCHEMA)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
