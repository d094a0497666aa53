import itertools
import zlib

import numpy as np
import pytest
import regex

from mathloom.llm import language_id, toxicity

DATA = "/root/testdata/sf0.01"


def brute_posteriors(scores, transitions):
    """Sums over all label sequences."""
    n, k = scores.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            out[i, y] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward(monkeypatch):
    rng = np.random.default_rng(2)
    scores, transitions, lengths = rng.normal(size=(16, 3)), rng.normal(size=(3, 3)), np.array([7, 1, 5, 3])
    want = np.concatenate([brute_posteriors(s, transitions) for s in np.split(scores, np.cumsum(lengths)[:-1])])
    for block in (1, 2, 4, 32):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert np.allclose(language_id.messages(scores, transitions, lengths), want)
    got, moves = language_id.pair_posteriors(scores[:8], transitions, 4)
    assert np.allclose(got, np.concatenate([brute_posteriors(scores[a : a + 4], transitions) for a in (0, 4)]))
    assert np.isclose(moves.sum(), 6)


def test_code_switching(spark):
    model = language_id.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    docs = {r["lang"]: r["text"].split()[:30] for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("lang in ('en', 'de') and n_chars > 600").collect()}
    words = [language_id.words_of(" ".join(docs[x])) for x in ("en", "de")]
    labels = language_id.label_words([words[0] + words[1]], language_id.WordScores(model))[0].argmax(axis=1)
    want = [model.languages.index("en")] * len(words[0]) + [model.languages.index("de")] * len(words[1])
    assert np.mean(labels == want) > 0.9
    assert (np.diag(model.transitions) > model.transitions.mean(axis=1)).all()


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_predictions_of_the_query(spark):
    """Every row against the chain written out word by word: forward and backward sums in plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs)
    move, scores, n = np.exp(model.transitions), language_id.WordScores(model), 0
    for r in language_id.language_id(docs, model).join(docs.select("doc_id", "text"), "doc_id").filter("length(text) < 2000").collect():
        words = [w[i : i + 40] for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", (r["text"] or "").lower()) for i in range(0, len(w), 40)]
        if not words:
            assert (r["lang_pred"], r["score"], r["word_langs"]) == ("und", 0, "")
            continue
        x, n = np.exp(scores.of(words)), n + 1
        ahead, back = [x[0]], [np.ones(x.shape[1])]
        for t in range(1, len(words)):
            ahead.append((ahead[-1] @ move) * x[t] / (ahead[-1] @ move * x[t]).sum())
            back.append(move @ (back[-1] * x[-t]) / (move @ (back[-1] * x[-t])).sum())
        p = np.array([a * b / (a * b).sum() for a, b in zip(ahead, reversed(back))])
        assert model.languages[int(p.mean(axis=0).argmax())] == r["lang_pred"] and np.isclose(p.mean(axis=0).max(), r["score"])
        runs = [(k, len([*g])) for k, g in itertools.groupby(p.argmax(axis=1))]
        assert r["word_langs"] == " ".join(f"{model.languages[k]}*{m}" for k, m in runs)
    assert n > 300


def test_numbers_are_not_letters():
    assert language_id.words_of("½ ² ⅷ ① 12 _") == [] and language_id.words_of("e\u0301a ß中 ß") == ["e\u0301a", "ß中", "ß"]


def test_language_edge_cases(spark, edges, nothing):
    got = language_id.language_id(edges).collect()
    assert len(got) == edges.count()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {5, 6, 7, 8} <= und and not und & {1, 2, 9, 11, 12}
    assert all(r["held_out"] is not None for r in got)
    assert language_id.language_id(nothing).count() == 0
    no_labels = language_id.language_id(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).first()
    assert (no_labels["lang_pred"], no_labels["score"]) == ("und", 0.0)


def test_held_out_rule(spark):
    import zlib

    got = {r[0]: r[1] for r in spark.range(200).select("id", language_id.held_out("id")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_toxicity_of_unseen_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    chain = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    held = labels.filter("doc_id % 3 = 0").join(docs, "doc_id").collect()
    p = chain.predict(toxicity.design([toxicity.tokens(r["text"]) for r in held], chain.features))[:, 1] >= toxicity.THRESHOLD
    y = np.array([r["toxic"] for r in held])
    assert p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.03


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(4)
    words = [{w for w in ("a", "b", "c", "d") if rng.random() < 0.5} for _ in range(600)]
    first = np.array(["a" in d or "b" in d for d in words], float)
    labels = np.stack([first, np.array([f and "c" in d for f, d in zip(first, words)], float)], 1)
    docs = [toxicity.hashed(w) for w in words]
    chain = toxicity.fit_chain(docs, labels, ("x", "y"), np.arange(600) % 5)
    got = chain.predict(toxicity.design(docs, chain.features))
    assert ((got >= 0.5) == labels).mean() > 0.98 and len(chain.weights[1]) == len(chain.features) + 2


def test_weights_reach_the_optimum():
    rng = np.random.default_rng(5)
    x = np.hstack([rng.normal(size=(300, 4)), np.ones((300, 1))])
    y = (x @ [1, -2, 0, 1, 0.5] + rng.logistic(size=300) > 0).astype(float)
    row, column = np.indices(x.shape)
    w = toxicity.fit_logistic(toxicity.Rows(300, 5, row.ravel(), column.ravel(), x.ravel()), y, 0.4)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) / 300 + np.r_[np.full(4, 0.4 / 300), 1e-6 / 300] * w).max() < 1e-4


def test_scores_of_the_query_are_those_of_the_chain(spark, edges):
    """Brute force: every row's features counted by themselves, the chain's sums written out."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    chain = toxicity.train(docs, labels)
    number = {h: i for i, h in enumerate(chain.features.tolist())}
    for r in [*toxicity.op6_toxicity(spark, DATA).join(docs, "doc_id").collect()]:
        count = {}
        for w in toxicity._TOKEN.findall((r["text"] or "").lower()):
            for f in [w, *("^" + w[:n] for n in toxicity.PREFIXES if len(w) > n)]:
                h = zlib.crc32(f.encode())
                count[h] = count.get(h, 0) + 1
        earlier = []
        for w in chain.weights:
            z = sum(np.log1p(n) * w[number[h]] for h, n in count.items() if h in number) + sum(p * v for p, v in zip(earlier, w[len(number) : -1])) + w[-1]
            earlier.append(1 / (1 + np.exp(-z)))
        assert np.allclose([r["p_low_quality"], r["p_toxic"]], earlier) and r["kept"] == (r["toxic"] == 0) == (r["p_toxic"] < toxicity.THRESHOLD)


def test_the_sample_stays_bounded_when_ids_repeat(spark, monkeypatch):
    """One id on many rows: one of them is read."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda docs, *a: seen.append(len(docs)))
    toxicity.train(docs, labels, 10)
    assert seen == [10]


def test_toxicity_edge_cases(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 0, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(edges, labels).collect()
    assert len(got) == edges.count() and all(r["kept"] == (r["toxic"] == 0) for r in got)
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert all(r["kept"] for r in toxicity.toxicity(edges, labels.limit(0)).collect())


@pytest.mark.parametrize("stage", [toxicity.stage])
def test_stage_keeps_columns(spark, edges, stage):
    assert stage(spark, edges, DATA).columns == edges.columns


def test_every_letter_of_a_long_run_counts():
    rng = np.random.default_rng(2)
    letters = {"aa": "abcdefgh", "bb": "stuvwxyz"}
    word = lambda lang, n: "".join(rng.choice(list(letters[lang]), n))
    model = language_id.fit([(lang, [word(lang, 6) for _ in range(12)]) for lang in letters for _ in range(100)])
    scores = language_id.WordScores(model)
    for head, rest in (("aa", "bb"), ("bb", "aa")):
        run = word(head, 40) + word(rest, 2000)
        assert "".join(language_id.words_of(run)) == run and max(map(len, language_id.words_of(run))) <= 40
        mean = language_id.label_words([language_id.words_of(run)], scores)[0].mean(axis=0)
        assert model.languages[int(mean.argmax())] == rest
