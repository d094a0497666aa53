import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mathloom.llm import periodic_runs

DATA = "/root/testdata/sf0.01"


def brute_runs(words, min_exponent=4, min_length=6):
    """(start, length, period) of all runs, period by period; a stretch counts with its smallest one."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(min_length, min_exponent * q):
                found.setdefault((s, i + q - s), q)
            i = i + 1 if i == s else i
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_change(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    words = brute_change(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_runs(words)
    kept = set(range(len(words))) - {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        best = r if best is None or r[1] * best[2] > best[1] * r[2] else best
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(words[i] for i in sorted(kept))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=12), st.text("abc", max_size=6), st.integers(1, 12)), max_size=4), st.integers(2, 5), st.sampled_from([0, 6]))
def test_runs_of_random_words(documents, min_exponent, min_length):
    documents = [list(a + b * k + a) for a, b, k in documents]
    numbers = np.array([ord(c) for d in documents for c in d], np.int64)
    doc = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    expected, first = [], 0
    for d in documents:
        expected += [[first + s, first + s + n, q] for s, n, q in brute_runs(d, min_exponent, min_length)]
        first += len(d)
    assert sorted(periodic_runs.maximal_runs(numbers, doc, min_exponent, min_length).tolist()) == sorted(expected)


def test_long_runs():
    rng = random.Random(1)
    part = [rng.randrange(50) for _ in range(7000)]
    numbers = np.array([99] * 30_000 + part * 4 + part[:10] + [100], np.int64)
    assert periodic_runs.maximal_runs(numbers, numbers * 0, 4, 6).tolist() == [[0, 30_000, 1], [30_000, 58_010, 7000]]


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = periodic_runs.op11_periodic_runs(spark, DATA).drop("n_words").collect()
    assert len(got) == len(docs)
    checked = 0
    for r in got:
        if len(docs[r["doc_id"]]) < 6000:  # the plain search takes too long for longer ones
            assert tuple(r) == brute_row(r["doc_id"], docs[r["doc_id"]])
            checked += r["n_runs"] > 0
    assert checked > 50


def test_edges(spark, edges, nothing):
    assert periodic_runs.periodic_runs(nothing).count() == 0
    got = {(r["doc_id"], r["collapsed"]): r for r in periodic_runs.periodic_runs(edges).collect()}
    rows = edges.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert sum(1 for _ in got) == len({(r["doc_id"], " ".join(r["text"].split())) if r["doc_id"] != 11 else (11, "Ünï") for r in rows})
    assert [tuple(x) for x in got[11, "Ünï"]["runs"]] == [(0, 30, 1)]
    assert got[5, ""]["n_words"] == got[7, ""]["n_words"] == 0 and got[None, ""]["runs"] == []
