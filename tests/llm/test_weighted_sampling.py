import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mathloom.llm import weighted_sampling
from mathloom.llm.shared import NULL_ID

DATA = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def weights(text):
    out = Counter()
    for w in WORD.findall(text.encode()):
        out[w] += 1
        out[w[: weighted_sampling.BEGINNING],] += weighted_sampling.BEGINNING_WEIGHT
    return out


def jaccard(a, b):
    a, b = weights(a), weights(b)
    least = sum(min(v, b[k]) for k, v in a.items())
    total = sum(a.values()) + sum(b.values()) - least
    return least / total if total else 1.0


def likeness(a, b):
    """Of two fingerprints as texts, place by place."""
    if not a or not b:
        return float(a == b)
    places = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    return sum(x == y for x, y in places) / len(places)


def test_collisions_are_generalised_jaccard():
    rng = random.Random(5)
    sampler = weighted_sampling.Sampler(4096)
    words = [f"{chr(97 + i % 26)}{i}word" for i in range(300)]
    for changed, repeats in ((0, 1), (5, 1), (40, 3), (100, 1), (150, 9), (200, 40)):
        a = rng.choices(words, k=200) + ["often"] * repeats
        b = a[:-changed] + rng.choices(words, k=changed) if changed else a[::-1]
        a, b = " ".join(a), " ".join(b)
        samples, many = sampler.signatures([a.encode(), b.encode()])
        expected = jaccard(a, b)
        assert abs(weighted_sampling.likeness(samples[0], many[0], samples[1], many[1]) - expected) < 5 * (0.25 / 4096) ** 0.5
        assert many.tolist() == [len(weights(a)), len(weights(b))]


def test_fingerprints_depend_on_the_text_alone():
    texts = [b"", b"a", b"one two three", b"three one  two", "Ünï ".encode() * 40, b" \n", b"x" * 3000, b"one two three"]
    together, many = weighted_sampling.Sampler().signatures(texts)
    for k, t in enumerate(texts):
        alone, n = weighted_sampling.Sampler().signatures([t])
        assert (alone[0] == together[k]).all() and n[0] == many[k]
    assert (together[2] == together[3]).all() and many.tolist()[:2] == [0, 2]
    # forgetting and small pieces change nothing
    keep = weighted_sampling.MOST_ROWS, weighted_sampling._BYTES, weighted_sampling._TERMS
    try:
        weighted_sampling.MOST_ROWS, weighted_sampling._BYTES, weighted_sampling._TERMS = 3, 7, 2
        sampler = weighted_sampling.Sampler()
        for _ in range(3):
            assert (sampler.signatures(texts)[0] == together).all()
    finally:
        weighted_sampling.MOST_ROWS, weighted_sampling._BYTES, weighted_sampling._TERMS = keep


def check_rows(got, docs):
    """Rows against the documents as (doc_id, text) in their order."""
    assert len(got) == len(docs)
    by_id = {r["doc_id"]: r for r in got}
    for k, (doc_id, text) in enumerate(docs):
        row, following = by_id[doc_id], docs[(k + 1) % len(docs)]
        n = len(text)
        changed = text[: n - n // 4] + following[1][: n // 4]
        assert (row["n_chars"], row["edited_sha256"]) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert row["near_edited"] == likeness(row["fingerprint"], row["edited_fingerprint"])
        assert row["near_next"] == likeness(row["fingerprint"], by_id[following[0]]["fingerprint"])


def test_query(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    got = weighted_sampling.op12_weighted_sampling(spark, DATA).collect()
    check_rows(got, docs)
    texts = {}
    for r in got:
        texts.setdefault(dict(docs)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in texts.values())
    error = np.array([r["near_edited"] - jaccard(t, t[: len(t) - len(t) // 4] + u[: len(t) // 4]) for r, (_, t), (_, u) in zip(sorted(got), docs, docs[1:] + docs[:1])])
    assert abs(error.mean()) < 0.01 and np.abs(error).max() < 0.3
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.9
    alone = {r["doc_id"]: r["fingerprint"] for r in weighted_sampling.fingerprints(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert alone == {r["doc_id"]: r["fingerprint"] for r in got}


def test_edges(spark, edges, nothing):
    assert weighted_sampling.neighbour_fingerprints(nothing).count() == 0 and weighted_sampling.fingerprints(nothing).count() == 0
    own = edges.select("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"])
    docs = [(r["doc_id"], r["text"] or "") for r in own.orderBy("doc_id").collect()]
    check_rows(weighted_sampling.neighbour_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect(), docs)
    # ties and null ids: each row has a place in one order
    got = weighted_sampling.neighbour_fingerprints(edges).collect()
    tie = lambda r: NULL_ID if r["doc_id"] is None else r["doc_id"]
    rows = sorted(edges.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect(), key=lambda r: (tie(r), r["tie"], r["text"]))
    expected = [hashlib.sha256(weighted_sampling.edited(a["text"], b["text"]).encode()).hexdigest() for a, b in zip(rows, rows[1:] + rows[:1])]
    assert sorted(r["edited_sha256"] for r in got) == sorted(expected)
    single = weighted_sampling.neighbour_fingerprints(spark.createDataFrame([(7, "just one text here")], "doc_id long, text string")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
