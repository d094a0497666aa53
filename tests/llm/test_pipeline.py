import numpy as np
import pytest

import corpus_pipeline
from mathloom.llm import toxicity

from .test_dedup import brute_kept
from .test_scans import WORD, brute_tiles, lower

DATA = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    chain = toxicity.train(docs, labels)
    p = chain.predict(toxicity.design([toxicity.tokens(t) for _, t in rows], chain.features))[:, 1]
    rows = [r for r, x in zip(rows, p) if x < toxicity.THRESHOLD]
    last = {t: max(i for i, u in rows if u == t) for t in {t for _, t in rows}}
    rows = [(i, t) for i, t in rows if last[t] == i]
    stays = set(brute_kept(rows, 5, 80))  # five words and 0.8, as for near copies where no contract says otherwise
    rows = [(i, t) for i, t in rows if i in stays]
    split = lambda t: WORD.findall(lower(t))
    tests = [split(r["text"]) for r in items]
    leaked = lambda t: any(brute_tiles(own, words, 5) >= len(own) / 2 for own in tests if (words := split(t)) and {*zip(*(own[k:] for k in range(5)))} & {*zip(*(words[k:] for k in range(5)))})
    rows = [(i, t) for i, t in rows if not leaked(t)]
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows}
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    assert np.mean([i in {r[0] for r in rows} for i in toxic]) < 0.2


def test_stages_are_named_and_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "packing"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, nothing, name):
    """No documents in, none out, with the columns that documents have or those of the packing."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, nothing, "/root/testdata/sf0.001")
    assert out.count() == 0 and (name == "packing" or sorted(out.columns) == sorted(nothing.columns))


def test_stages_take_the_edge_table(spark, edges):
    """Nulls, empty, long and repeated texts, ties and clashing columns: what stays are rows of the input, clean ones among them."""
    rows = edges.dropDuplicates(["doc_id", "text"]).filter("doc_id is not null")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, "/root/testdata/sf0.001")
        assert sorted(out.columns) == sorted(rows.columns)
        assert out.exceptAll(rows).count() == 0, name
        assert {15, 16} & {r["doc_id"] for r in out.select("doc_id").collect()}, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in rows.select("doc_id").collect()}
