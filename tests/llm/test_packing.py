import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import packing

DATA = "/root/testdata/sf0.01"


def check_cover(windows, lengths):
    pieces = defaultdict(list)
    for w in windows:
        assert w.used == w.size == sum(n for _, _, n in w.pieces) and w.size & (w.size - 1) == 0
        for doc, start, n in w.pieces:
            assert n > 0
            pieces[doc].append((start, n))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(pieces[doc]):
            assert start == at
            at += n
        assert at == length


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_every_token_is_packed_once(lengths):
    windows = packing.pack(lengths)
    check_cover(windows, lengths)
    assert sum(w.size < packing.TIERS[-1] for w in windows) <= 30


def test_step_groups_are_balanced():
    rng = np.random.default_rng(1)
    windows = packing.pack(list(map(int, rng.lognormal(6, 1, 2000).astype(int) + 1)))
    cost, tokens = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for w, g in zip(windows, packing.step_groups(windows)):
        cost[w.size][g] += w.cost
        tokens[g] += w.size
    assert max(tokens.values()) <= packing.STEP_TOKENS
    full = [c for g, c in cost[1024].items() if tokens[g] == packing.STEP_TOKENS]
    assert max(full) < 1.1 * min(full)


def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_reference_file(spark):
    encode, want = packing.load_encoder(), reference_ids()
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() if r["text"]]
    for t in [*texts, "", " ", "a<|endoftext|>b", "\x00\x01", "Ünï 漢字 🙂‍🙂  \n\n x", "²½Ⅷ", "don't  'LL\t\r\n", "a b", "퟿"]:
        assert encode(t).tolist() == want(t), t[:50]


def test_long_runs_of_white_space(spark):
    """Through Spark: runs of a million blanks, line breaks and a mixture, and a long word."""
    want = reference_ids()
    texts = {1: "a" + " " * 1_000_000 + "b", 2: "\n" * 1_000_000, 3: " \n\t" * 300_000, 4: "x" * 200_000, 5: "end"}
    rows = packing.packing(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    for i, t in texts.items():
        ids = np.array([*want(t), 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


@pytest.mark.parametrize("which", ["edges", "nothing"])
def test_packing(spark, request, which):
    docs, want = request.getfixturevalue(which), reference_ids()
    rows = packing.packing(docs).collect()
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r["doc_id"]].append(np.array([*want(r["text"] or ""), 0], "<u4"))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
        assert any(r["doc_tokens"] == len(d) and r["ids_crc32"] == zlib.crc32(d[r["start"] : r["start"] + r["length"]].tobytes()) for d in ids[r["doc_id"]])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["window"] <= 1024
    assert {i: sum(map(len, d)) for i, d in ids.items()} == {i: sum(r["length"] for r in p) for i, p in pieces.items()}
