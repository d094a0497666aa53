import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import exact_dedup, ngram_join, shared, substring_dedup, suffix_dedup
from mathloom.llm.components import connected_components
from mathloom.llm.shared import Scratch, safe_id

from .conftest import prose

LEAST = -(2**63)


def ids_and_texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def rank(doc_id):
    return LEAST if doc_id is None else doc_id


def bag(rows):
    return Counter(map(tuple, rows))


def test_exact_dedup(edges, nothing):
    rows = ids_and_texts(edges)
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    got = exact_dedup.exact_dedup(edges).collect()
    keep = {d: max(ids, key=rank) for d, ids in groups.items()}
    assert bag((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == bag((i, keep[d], len(ids), d) for d, ids in groups.items() for i in ids)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(dict.fromkeys(groups, 1))
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_with_history(spark):
    old = spark.createDataFrame([(i, f"text {i % 300}") for i in range(900)], "doc_id long, text string")
    new = spark.createDataFrame([(1000 + i, f"text {i}") for i in range(250, 350)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(new, old).collect()}
    assert len(got) == 1000 and got[1299]["keep_id"] == 1299 and got[299]["keep_id"] == 1299 and got[299]["group_size"] == 4
    assert got[10]["keep_id"] == 610 and got[1340]["group_size"] == 1


def test_exact_dedup_of_large_and_null_ids(spark):
    """Ids beyond 2^53 beside null ids, with and without history; every text keeps one row."""
    big = 2**60
    rows = [(big + i, f"text {i % 7}") for i in range(40)] + [(None, f"text {i}") for i in (1, 2, 50)] + [(big, None), (None, None), (-big, "text 3")]
    old, new = rows[::2], rows[1::2]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    for got in (exact_dedup.exact_dedup(frame(rows)).collect(), exact_dedup.exact_dedup(frame(new), frame(old)).collect()):
        groups = defaultdict(list)
        for i, t in rows:
            groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
        keep = {d: max(ids, key=rank) for d, ids in groups.items()}
        assert bag((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == bag((i, keep[d], len(ids), d) for d, ids in groups.items() for i in ids)
        assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(dict.fromkeys(groups, 1))
    kept = exact_dedup.stage(spark, frame(rows), "").collect()
    assert Counter(r["text"] or "" for r in kept) == Counter({t or "": 1 for _, t in rows})


def test_many_copies_of_one_row(spark, monkeypatch):
    """A row that is most of the table goes the way of hot keys and is written out in blocks."""
    monkeypatch.setattr(shared, "_COPIES_AT_ONCE", 100)
    docs = spark.createDataFrame([(5, "same")] * 1234 + [(i, f"text {i % 40}") for i in range(100, 200)], "doc_id long, text string").repartition(6)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == 1334 and sum(r["kept"] for r in got) == 41 and {r["group_size"] for r in got if r["doc_id"] == 5} == {1234}
    assert exact_dedup.stage(spark, docs, "").count() == 41


def test_perfect_hash_is_minimal():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), np.uint8).reshape(-1, 32)
    cells, slots = exact_dedup.build_cells(digests)
    assert sorted(slots) == list(range(3000))
    assert (exact_dedup.find_slots(digests, cells, 3000) == slots).all()


def brute_windows(rows):
    owner = {}
    for i, t in sorted(rows, key=lambda r: rank(r[0])):
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            owner.setdefault(tuple(w[k : k + 13]), rank(i))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if owner[tuple(w[k : k + 13])] < rank(i):
                gone[k : k + 13] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        yield i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def test_substring_dedup(edges, nothing):
    got = substring_dedup.substring_dedup(edges).drop("kept_text").collect()
    assert bag(got) == bag(brute_windows(ids_and_texts(edges)))
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_index_grows_by_batches(spark, edges):
    rows = ids_and_texts(edges.filter("doc_id is not null"))
    rows = [(i, t) for i, t in rows if i != 17]
    index, answers = substring_dedup.FingerprintIndex(spark), None
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for low, high in ((0, 3), (4, 9), (10, 11), (12, 15), (16, 110), (111, 120), (121, 10_000)):
        found = index.append(docs.filter(f"doc_id between {low} and {high}"))
        answers = found if answers is None else answers.unionByName(found)
    assert len(index.runs) < 7 and index.compactions  # some were compacted
    got = substring_dedup.remove_windows(docs, answers, index.scratch).drop("kept_text").collect()
    assert bag(got) == bag(brute_windows(rows))


def test_batches_are_shares_of_the_rows(spark):
    """An id far away from all others moves no bound."""
    rows = spark.range(10_000).selectExpr("case when id = 9999 then 1L << 60 when id = 9998 then null else id end as doc_id", "'x' as text")
    ends, size = substring_dedup.batch_ends(rows.select(safe_id("doc_id").alias("doc_id"), "text"))
    assert size == 10_000 and all(abs(e - 10_000 * share) < 20 for e, share in zip(ends, substring_dedup.BATCHES))
    assert substring_dedup.batch_ends(rows.limit(0).select(safe_id("doc_id").alias("doc_id"), "text")) == ([], 0)


def test_colliding_hashes_take_no_words(edges):
    """With hashes of 8 bits nearly every claim is wrong; words decide."""
    got = substring_dedup.substring_dedup(edges.filter("doc_id < 110 and doc_id <> 15 or doc_id is null"), bits=8).drop("kept_text").collect()
    rows = [(i, t) for i, t in ids_and_texts(edges) if i is None or (i < 110 and i != 15)]
    assert bag(got) == bag(brute_windows(rows)) and sum(r["n_removed"] for r in got) > 1000


def brute_strings(rows, width=50):
    owner = {}
    for i, t in sorted(rows, key=lambda r: rank(r[0])):
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            owner.setdefault(b[k : k + width], rank(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if owner[b[k : k + width]] < rank(i):
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        yield i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def test_suffix_dedup(edges, nothing):
    assert bag(suffix_dedup.suffix_dedup(edges).drop("kept").collect()) == bag(brute_strings(ids_and_texts(edges)))
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_suffix_dedup_compresses_stretches():
    """What is shuffled of the stretches takes less than half of their bytes, and gives the same windows back."""
    texts = [prose(1, 3000), prose(1, 3000) + " end", prose(2, 200)]
    names, _, _, count = suffix_dedup.named_runs([t.encode() for t in texts])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([7, 8, 9]), pa.array(texts), pa.array([names.tobytes()] * 3, pa.binary())], names=["key", "mark", "text", "hashes"])
    sent = pa.Table.from_batches([*suffix_dedup._emit_stretches(1)([batch])])
    assert sum(len(x) for x in sent.column("bytes").to_pylist()) < sum(n + suffix_dedup.WIDTH - 1 for n in count[: len(count) // 2]) / 2
    found = suffix_dedup._gather_ranges(suffix_dedup._owned(sent.filter(pa.compute.equal(sent.column("kind"), 0)), 1)).to_pylist()
    assert all(r["doc_id"] == 2 for r in found)
    told = suffix_dedup._gather_ranges(suffix_dedup._owned(sent, 1)).to_pylist()
    assert [r["doc_id"] for r in told] == [2] and len(np.frombuffer(told[0]["ranges"], np.int64)) > 0


def test_suffix_dedup_in_passes(edges, monkeypatch):
    """Where most names are shared, the texts are gone over several times, each time with a part of the names."""
    parts = []
    emit = suffix_dedup._emit_stretches
    monkeypatch.setattr(suffix_dedup, "_emit_stretches", lambda n, k, of: parts.append((k, of)) or emit(n, k, of))
    assert bag(suffix_dedup.suffix_dedup(edges).drop("kept").collect()) == bag(brute_strings(ids_and_texts(edges)))
    assert len(parts) > 1 and parts == [(k, len(parts)) for k in range(len(parts))]


@pytest.mark.parametrize("part", [64, 1000, 1 << 16])
def test_named_runs(monkeypatch, part):
    """Each window of each document lies in one run, with its own name, and none reaches into the next document."""
    monkeypatch.setattr(suffix_dedup, "_PART", part)
    texts = [t.encode() for t in (prose(1, 300), "", "short", "x" * 49, "x" * 50, "", prose(2, 20), "x" * 200, prose(1, 40), "end")]
    got = {(d, a + k): n for n, d, a, c in zip(*(x.tolist() for x in suffix_dedup.named_runs(texts))) for k in range(c)}
    assert got == {(d, k): n for d, t in enumerate(texts) for k, n in enumerate(suffix_dedup.window_names(t).tolist())}
    assert sum(suffix_dedup.named_runs(texts)[3]) == len(got) and not len(suffix_dedup.named_runs([])[0]) and not len(suffix_dedup.named_runs([b"", b"x"])[0])


def test_passes_bound_what_is_sent():
    """With all names shared, a pass sends about PASS_BYTES of stretches for a byte of text, and names take four bytes."""
    texts = [prose(1, 20_000), prose(2, 20_000)]
    size = sum(map(len, texts))
    names, _, _, _ = suffix_dedup.named_runs([t.encode() for t in texts])
    short = names.astype(suffix_dedup.SHORT).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array(texts), pa.array([short] * 2, pa.binary())], names=["doc_id", "mark", "text", "names"])
    parts = suffix_dedup.n_passes(len(names), size)
    sent = [pa.Table.from_batches([*suffix_dedup._emit_stretches(3, k, parts)([batch])]) for k in range(parts)]
    for table in sent:
        assert sum(len(suffix_dedup._whole(x)) for x in table.column("bytes").to_pylist()) < 1.1 * suffix_dedup.PASS_BYTES * size
    assert 3 < parts < 6 and sum(len(x) for t in sent for x in t.column("hashes").to_pylist()) == 4 * len(names)
    blocks = pa.Table.from_batches([*suffix_dedup._emit_names(1)([batch.select([0, 2])])])
    assert sum(len(x) for x in blocks.column("hashes").to_pylist()) == 4 * len(set(names))


@pytest.mark.parametrize("most", [0, 100])
def test_texts_of_one_id_are_told_apart(spark, monkeypatch, most):
    """By marks for all rows, or for those of ids with several rows only."""
    monkeypatch.setattr(suffix_dedup, "MOST_REPEATED", most)
    first, second = prose(1, 60), prose(2, 60)
    rows = [(5, first + " and " + second), (7, second + " x"), (7, "y " + first), (7, prose(3, 60)), (9, first)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert bag(got) == bag(brute_strings(rows)) and sum(r["n_removed"] > 0 for r in got) == 3


def test_touching_ranges_are_joined():
    far = 5 + 2 * suffix_dedup.WIDTH
    ids, marks, first, last = (np.array(x) for x in ([4, 4, 4, 4, 9, 9], [0, 0, 0, 1, 0, 0], [far, 0, 5, 0, 0, 3], [far, 2, 5 + suffix_dedup.WIDTH, 7, 60, 4]))
    table = pa.Table.from_batches([suffix_dedup._batch([*suffix_dedup._ranges(ids, marks, first, last, 1)], suffix_dedup._RANGES)])
    got = {(r["doc_id"], r["mark"]): np.frombuffer(r["ranges"], np.int64).tolist() for r in suffix_dedup._gather_ranges(table).to_pylist()}
    assert got == {(4, 0): [0, far], (4, 1): [0, 7], (9, 0): [0, 60]}
    assert suffix_dedup._gather_ranges(table.slice(0, 0)).num_rows == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    assert list(suffix_dedup.suffix_array(np.array(symbols, np.int64))) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffix_array_of_large_names():
    s = np.random.default_rng(3).integers(0, 2**30, 2000)
    s[500:900] = s[1000:1400]
    assert list(suffix_dedup.suffix_array(s)) == sorted(range(len(s)), key=lambda i: tuple(s[i:]))


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), 2**63), rank(i))
    return [(i, len(sets[a]), None if least[find(a)] == LEAST else least[find(a)], links[a]) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("hot, tile", [(64, 1000), (8, 20)])
def test_ngram_join(edges, nothing, monkeypatch, hot, tile):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile)
    assert bag(ngram_join.ngram_join(edges).collect()) == bag(brute_links(ids_and_texts(edges)))
    if hot == 64:
        assert ngram_join.ngram_join(nothing).count() == 0


def test_ngram_join_with_common_passages(spark, monkeypatch):
    """Columns of more rows than HOT_ROWS, known before the rows are multiplied, in texts that link and in others that don't."""
    seen = []
    real = ngram_join._frequent
    monkeypatch.setattr(ngram_join, "_frequent", lambda sets: seen.append(real(sets)) or seen[-1])
    common, rng, rows = [f"c{k}" for k in range(60)], np.random.default_rng(3), []
    for i in range(160):
        own = [f"o{x}" for x in rng.integers(0, 10**6, (1, 4, 20, 90)[i % 4])]
        rows.append((i, " ".join(own + common if i % 8 < 4 else common + own)))
    rows += [(200 + i, f"tiny words come here {i % 30}") for i in range(90)] + [(400, None), (401, "")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert bag(got) == bag(brute_links(rows))
    assert (seen[0][1] >= ngram_join.HOT_ROWS).any()


def test_ngram_stage_keeps_one_of_each_group(edges, spark):
    kept = ngram_join.stage(spark, edges.filter("doc_id <> 17"), "")
    assert kept.columns == edges.columns
    rows = [(i, t) for i, t in ids_and_texts(edges.filter("doc_id <> 17"))]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c, _ in brute_links(rows)})


def test_exact_stage_keeps_one_of_each_text(edges, spark):
    kept = exact_dedup.stage(spark, edges, "")
    texts = [r["text"] or "" for r in kept.collect()]
    assert kept.columns == edges.columns and len(texts) == len(set(texts)) and set(texts) == {t or "" for _, t in ids_and_texts(edges)}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100)] + [(200, int(x)) for x in range(201, 260)] + [tuple(map(int, rng.integers(300, 340, 2))) for _ in range(30)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "t").collect())
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def brute_kept(rows, n, numerator):
    """Smallest ids of what hangs together by links of n words and numerator / 100."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    name = [i for i, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]) and name[a] != name[b]:
                low, high = sorted((name[a], name[b]))
                name = [low if x == high else x for x in name]
    return sorted(set(name))


def test_ngram_stage_by_its_own_rule(spark):
    """Near copies with a tenth, two tenths and single words replaced: the stage holds them against 5 words and 0.8."""
    rows, rng = [], np.random.default_rng(11)
    for k in range(12):
        words = [f"g{k}w{x}" for x in rng.integers(0, 10_000, 200)]
        tenth, fifth = (words[:60] + [f"new{k}x{x}" for x in range(m)] + words[60 + m :] for m in (16 + k % 3, 40))
        single = [w if x % 45 else f"one{k}x{x}" for x, w in enumerate(words)]
        rows += [(10 * k + i, " ".join(w)) for i, w in enumerate((words, tenth, fifth, single))]
    rows += [(1000, "a b c d"), (1001, "A b  c d"), (1002, "a b c d e"), (1003, None), (1004, "")]
    kept = ngram_join.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted(r["doc_id"] for r in kept.collect())
    assert got == brute_kept(rows, 5, 80) and got != brute_kept(rows, 4, 85)


@pytest.mark.parametrize("hot, tile", [(64, 1000), (8, 20)])
def test_ngram_join_by_another_rule(edges, monkeypatch, hot, tile):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile)
    rows = [(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_join(edges.filter("doc_id <> 17"), rule=ngram_join.Rule(5, 80)).collect()]
    assert sorted({c for _, c in rows}) == brute_kept(ids_and_texts(edges.filter("doc_id <> 17")), 5, 80)
