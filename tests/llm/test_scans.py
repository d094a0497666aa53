import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import decontaminate, license_scan

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", "no notice", "Released under the MIT-License. Under the mit license!", "Apache License, Version 2.0", "apache license version 20", "apache licence version 2", "apache license version 1", "CC BY-NC", "cc by nd", "undér the mit license", "under the mit licence", "GNU General Publik License", "under the mit licenseé", "a\x00under the mit license"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_base(text):
    words = WORD.findall(lower(text))
    starts, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_places():
    for t in TEXTS:
        assert license_scan.scan_text(t)[:5] == brute_base(t), t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc Ä MIT . - 20".split(" ")), max_size=40), st.sampled_from([" ", "-", "\n", "_"]))
def test_base_places_of_random_texts(words, between):
    text = between.join(words)
    assert license_scan.scan_text(text)[:5] == brute_base(text)


def test_fuzzy_labels():
    labels = {t: license_scan.scan_text(t)[5] for t in TEXTS}
    assert labels["apache licence version 2"] == "apache-2" and labels["under the mit licence"] == "mit" and labels["GNU General Publik License"] == "gpl"
    assert labels["apache license version 1"] == labels["apache license version 20"] == labels["cc by nd"] == labels["no notice"] == ""
    for t in TEXTS:
        found = license_scan.scan_text(t)
        assert set(found[4].split(",")) - {""} <= set(found[5].split(",")) and 0 <= found[6] <= 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 6), st.lists(st.tuples(st.integers(0, 30), st.sampled_from("xq "), st.sampled_from("sid")), max_size=2))
def test_seeds_lose_no_match(which, changes):
    """Whatever edits are made to a notice within its bound, it is found."""
    phrase, label = (license_scan.BASE + license_scan.MORE)[which]
    text = phrase
    for at, c, kind in changes:
        at %= len(text)
        text = text[:at] + (c if kind == "s" else c + text[at] if kind == "i" else "") + text[at + 1 :]
    text = " ".join(text.split())
    notice = license_scan.Notice(phrase.encode(), label)
    if text and edits(phrase, text) <= notice.edits and [c for c in text if c.isdigit()] == [c for c in phrase if c.isdigit()]:
        assert label in license_scan.scan_text(f"aa {text} bb")[5].split(",")


def test_scan_of_edge_cases(edges, nothing):
    got = license_scan.license_scan(edges).collect()
    assert len(got) == edges.count() and license_scan.license_scan(nothing).count() == 0
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in edges.collect())


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def test_leaks(spark):
    w = ITEM.split()
    filler = " ".join(f"f{i}" for i in range(50))
    docs = {1: f"{filler} {ITEM} {filler}", 2: f"{filler} {' '.join(w[8:])} and {filler} {' '.join(w[:8])}", 3: f"{filler} {' '.join(w[:6])} {filler}", 4: None, 5: "", 6: ITEM.upper().replace(" ", ", "), 7: filler, 8: " ".join(reversed(w)), 9: "alpha beta"}
    docs = spark.createDataFrame([*docs.items(), (1, docs[1]), (None, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "alpha beta"), (None, "f0 f1 f2 f3 f4 f5 f6 g7 g8 g9")], "item_id long, text string")
    got = decontaminate.leaks(docs, items).collect()
    assert Counter(r["doc_id"] for r in got if r["item_id"] == 1) == Counter({1: 2, 2: 1, 6: 1, None: 1})
    assert {r["doc_id"] for r in got if r["item_id"] is None} == {1, 2, 3, 7}
    assert all(r["coverage"] == 1 for r in got if r["item_id"] == 1) and next(r for r in got if r["doc_id"] == 2 and r["item_id"] == 1)["n_tiles"] == 2
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), items).count() == 0


def test_a_benchmark_of_equal_items(spark, monkeypatch):
    """Each text meets its items in small parts; seeds in many texts are dealt out."""
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    docs = spark.createDataFrame([(i, ITEM) for i in range(3)] + [(9, ITEM + " more")] + [(100 + i, f"{ITEM} x{i}") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM) for i in range(20)] + [(0, ITEM)], "item_id long, text string")
    got = decontaminate.leaks(docs, items).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter((d, i) for d in (0, 1, 2, 9, *range(100, 160)) for i in (0, *range(20)))


def test_long_matches_and_repeated_words(spark):
    """A passage of 400 words, found whole and in shuffled parts; one repeated word; a long text."""
    w = [f"p{i}" for i in range(400)]
    parts = [w[i : i + 40] for i in range(0, 400, 40)]
    docs = {1: " ".join(w), 2: " a ".join(" ".join(x) for x in reversed(parts)), 3: "same " * 3000, 4: "other " * 20_000 + " ".join(w), 5: " ".join(w[:199]), 6: " ".join(w[:200])}
    items = {1: " ".join(w), 2: "same " * 500}
    got = decontaminate.leaks(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["coverage"], r["n_tiles"], r["longest_tile"]) for r in got} == {(1, 1, 1, 1, 400), (2, 1, 1, 10, 40), (3, 2, 1, 1, 500), (4, 1, 1, 1, 400), (6, 1, 0.5, 1, 200)}


def test_the_query_against_all_pairs(spark):
    """Every document against every item, tiled by comparing all places."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 1500").collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    split = lambda t: WORD.findall(lower(t))
    want = set()
    for d in docs:
        words = split(d["text"])
        seeds = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for i in items:
            own = split(i["text"])
            if seeds & {tuple(own[k : k + 5]) for k in range(len(own) - 4)} and (share := brute_tiles(own, words, 5) / len(own)) >= 0.5:
                want.add((d["doc_id"], i["item_id"], share))
    got = decontaminate.op9_decontaminate(spark, DATA).collect()
    kept = {d["doc_id"] for d in docs}
    assert want and {(r["doc_id"], r["item_id"], r["coverage"]) for r in got if r["doc_id"] in kept} == want


def test_leak_stage(spark, edges, nothing, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert decontaminate.stage(spark, nothing, str(tmp_path)).count() == 0
    more = edges.limit(2).withColumns({"text": F.lit("z " + ITEM), "doc_id": F.lit(None).cast("long")})
    got = decontaminate.stage(spark, edges.unionByName(more), str(tmp_path))
    assert got.columns == edges.columns and Counter(got.collect()) == Counter(edges.collect())


def brute_tiles(p, t, least):
    """Greedy string tiling by comparing all places."""
    up, ut, out = [False] * len(p), [False] * len(t), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not up[i + n] and not ut[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sum(n for n, _, _ in out)
        n, i, j = best
        up[i : i + n] = ut[j : j + n] = [True] * n
        out.append(best)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=60))
def test_tiles(pattern, text):
    p, t = (np.array(x, np.uint64) for x in (pattern, text))
    found = decontaminate.tiles(p, t, 3, 8)
    used_p, used_t = Counter(), Counter()
    for n, i, j in found:
        assert n >= 3 and pattern[i : i + n] == text[j : j + n]
        used_p.update(range(i, i + n))
        used_t.update(range(j, j + n))
    assert all(c == 1 for c in [*used_p.values(), *used_t.values()])
    assert sum(n for n, _, _ in found) == brute_tiles(pattern, text, 3)


def brute_spans(text, notice):
    """Stretches of whole words within the notice's bound; of those that overlap, the one with the fewest edits."""
    cuts, n = [i for i, c in enumerate(text) if c == " "], len(notice.phrase)
    close = [(a + 1, b) for a in cuts for b in cuts if abs(b - a - 1 - n) <= notice.edits and b > a]
    close = [(edits(notice.phrase.decode(), text[a:b]), abs(b - a - n), a, b) for a, b in close if sorted(filter(str.isdigit, text[a:b])) == sorted(map(chr, notice.digits))]
    out = []
    for e, _, a, b in sorted(close):
        if e <= notice.edits and all(b <= x or y <= a for x, y, _ in out):
            out.append((a, b, e))
    return sorted(out)


def test_the_query_against_brute_force(spark):
    """All columns of every document that has a word of a notice, spans by comparing all stretches of words."""
    rows = {r["doc_id"]: r for r in license_scan.op2_license_scan(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    notices, checked = license_scan._notices(), 0
    for d in docs:
        words, r = WORD.findall(lower(d["text"])), rows[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(d["text"])
        if len(words) > 120 or not {"license", "licence", "cc", "apache", "mit", "general", "clause"} & set(words):
            continue
        text, spans, score, checked = " " + " ".join(words) + " ", [], float(r["n_base"] > 0), checked + 1
        for n in notices:
            for a, b, e in brute_spans(text, n):
                spans.append(f"{n.label}:{text[:a].count(' ') - 1}+{text[a:b].count(' ') + 1}~{e}")
                score = max(score, 1 - e / len(n.phrase))
        labels = {s.split(":")[0] for s in spans} | {*filter(None, r["base_labels"].split(","))}
        assert (r["spans"], r["n_spans"], r["labels"], r["score"]) == (" ".join(spans), len(spans), ",".join(sorted(labels)), score)
    assert checked > 5


def test_many_notices_take_linear_time():
    import time

    took = []
    for n in (500, 4000):
        began = time.process_time()
        found = license_scan.scan_text("Released under the MIT license; see apache license, version 2. " * n)
        took.append(time.process_time() - began)
        assert found[1] == 2 * n and len(found[7]) == 2 * n
    assert took[1] < 24 * took[0]


def test_neighbouring_notices_are_all_found():
    notices = {n.label: n for n in license_scan._notices()}
    assert len(license_scan.fuzzy_spans(b" under the mt license under the mit license ", notices["mit"])) == 2
    assert len(license_scan.fuzzy_spans(b" under the mt license under the mit license under th mit license under the mit licence ", notices["mit"])) == 4
    assert license_scan.scan_text("apche licens version 2 apache license version 3")[5] == "apache-2"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 6), st.lists(st.tuples(st.integers(0, 10), st.integers(0, 30), st.sampled_from("xq 23")), min_size=1, max_size=8), st.sampled_from([" ", " a ", " 2 "]))
def test_spans_of_notices_in_a_row(which, changes, between):
    phrase, label = (license_scan.BASE + license_scan.MORE)[which]
    copies = []
    for kind, at, c in changes:
        at %= len(phrase)
        copies.append(phrase if kind > 7 else phrase[:at] + (c if kind < 3 else c + phrase[at] if kind < 6 else "") + phrase[at + 1 :])
    text = " " + " ".join(between.join(copies).split()) + " "
    notice = license_scan.Notice(phrase.encode(), label)
    assert license_scan.fuzzy_spans(text.encode(), notice) == brute_spans(text, notice)
