import math
import os
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mathloom.functions import nested
from mathloom.functions.lexer import Lexer
from mathloom.operators import algebra
from mathloom.plans import catalogue, generate, prepare, samplers, tasks
from mathloom.streaming import lexing

from .conftest import DATA


def test_task_keys_are_spread(spark):
    """Samples of a file that is one partition are made by several tasks."""
    rows = spark.range(1000).select(F.col("id").alias("c_custkey")).coalesce(1)
    keys = catalogue.task_keys(rows)
    sizes = keys.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 400 and keys.count() == 1000


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows_of(rows, names):
    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, sql, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = sql.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def sample(spark, name, n=60):
    rows = generate.generate(spark, tasks.examples().get(name), {"train": n}, 7)
    return [(r["problem"], r["answer"]) for r in rows.select(nested.to_text(F.col("problem")).alias("problem"), nested.to_text(F.col("answer")).alias("answer")).collect()]


def test_task_invariants(spark):
    for p, a in sample(spark, "gf17_addition"):
        xs = list(map(int, p.split(" | ")))
        assert [sum(xs[: k + 1]) % 17 for k in range(len(xs))] == list(map(int, a.split(" | "))) and 3 <= len(xs) <= 6
    for p, a in sample(spark, "integer_factorization"):
        f = list(map(int, a.split(" | ")))
        assert math.prod(f) == int(p) and f == sorted(set(f)) and len(f) == 5
    for name in ("integer_polynomial_factorization", "rational_polynomial_factorization"):
        for p, a in sample(spark, name):
            assert algebra.parse(p, ["x"]) == algebra.parse(a, ["x"])
    for p, a in sample(spark, "polynomial_addition"):
        polys, sums = ([algebra.parse(t, ["x", "y"]) for t in s.split(" | ")] for s in (p, a))
        assert all(algebra.plus(s, q) == t for s, q, t in zip([{}, *sums], polys, sums))
    for p, a in sample(spark, "eigvec_3x3"):
        m = [list(map(float, row.split(" | "))) for row in p.split(" || ")]
        v = list(map(float, a.split(" | ")))
        w = [sum(m[k][i] * sum(m[k][j] * v[j] for j in range(3)) for k in range(3)) for i in range(3)]
        size = math.sqrt(sum(x * x for x in w))
        assert all(abs(x / size - y) < 0.06 for x, y in zip(w, v))
    found = sample(spark, "polynomial_reduction")
    assert len(found) > 10
    for p, a in found:
        f, *basis = (algebra.parse(t, ["x", "y"]) for t in p.split(" | "))
        assert algebra.divide(algebra.plus(f, algebra.parse(a, ["x", "y"]), Fraction(-1)), basis)[1] == {}


def test_samples_do_not_depend_on_partitions(spark):
    make = tasks.examples().get("polynomial_addition")
    a = generate.generate(spark, make, {"train": 40, "test": 5}).drop("runtime")
    b = generate.generate(spark, make, {"test": 5, "train": 60}).drop("runtime")
    rows = lambda df: {(r["tag"], r["sample_index"]): (r["seed"], r["problem"], r["answer"]) for r in df.collect()}
    small, large = rows(a), rows(b.repartition(7))
    assert all(large[k] == v for k, v in small.items())


def test_seeds(spark):
    import hashlib

    row = spark.range(1).select(generate.seed_hex(F.lit(42), F.lit("train"), F.lit(3)).alias("s")).select("s", generate.seed_64(F.col("s"))).first()
    want = hashlib.sha256(b"42_train_3").digest()
    assert int(row[0], 16) == int.from_bytes(want[:16], "big") and int(row[1]) == int.from_bytes(want[:8], "big")


def test_generated_files(spark, tmp_path):
    stats = lambda p, a: {"problem": {"n": len(p)}, "last": int(a[-1])}
    df = generate.generate(spark, tasks.examples().get("gf17_addition"), {"train": 30, "test": 4}, statistics=stats)
    generate.write(df, str(tmp_path))
    assert {"samples", "train_raw.txt", "test_data.jsonl", "train_stats.yaml"} <= set(os.listdir(tmp_path))
    import yaml

    report = yaml.safe_load((tmp_path / "train_stats.yaml").read_text())
    assert report["num_samples"] == 30 and 3 <= report["problem_stats"]["n"]["mean"] <= 6 and "value" in report["last_stats"]
    with pytest.raises(TypeError):
        generate.numbers({"a": {"b": "text"}})
    few = generate.generate_accepted(spark, generate.seeded(lambda rng: ("p", "a") if rng.random() < 0.5 else None), "train", 20)
    assert few.count() == 20
    with pytest.raises(RuntimeError):
        generate.generate_accepted(spark, lambda seed: None, "train", 5)
    with pytest.raises(ValueError):
        tasks.examples().get("nothing")
    assert generate.from_config(spark, {"dataset": {"generator": "gf17_addition", "num_train_samples": 3, "num_test_samples": 2}}, tasks.examples()).count() == 5


def test_samplers():
    import random

    assert sorted({samplers.monomial(r, 3, 4) for r in range(15)}) == sorted((a, b, 4 - a - b) for a in range(5) for b in range(5 - a))
    assert [samplers.combination(r, 4, 2) for r in range(6)] == [[0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]]
    rng = random.Random(1)
    s = samplers.PolynomialSampler(("x", "y", "z"), samplers.Field.parse("GF(7)"), 2, 3, 4, degree_sampling="fixed", term_sampling="fixed")
    for _ in range(100):
        p = s.draw(rng)
        assert len(p) == 4 and max(map(sum, p)) == 3 and all(0 < c < 7 for c in p.values())
    m = s.matrix(rng, 3, 3, 0.5, unimodular=True)
    assert m[2][0] == {} and m[1][1] == {(0, 0, 0): 1}
    assert len(samplers.univariate(rng, samplers.Field("ZZ"), 5, 3, 9)) == 3 and samplers.signed_magnitude(rng, 3) in (-3, -2, -1, 1, 2, 3)
    for bad in ("GF(1)", "XX"):
        with pytest.raises(ValueError):
            samplers.Field.parse(bad)
    with pytest.raises(ValueError):
        samplers.PolynomialSampler((), max_degree=1)
    with pytest.raises(RuntimeError):
        samplers.PolynomialSampler(("x",), samplers.Field("GF", 2), 2, 2, 9, max_attempts=0).draw(rng)


LEXER = {"vocab": {"range": {"n": ["", 0, 16]}, "misc": [",", "<unk>"]}, "number_policy": {"attach_sign": True, "digit_group": 0, "allow_float": False}, "strict": True}


def test_prepare(spark, tmp_path):
    for name, n in (("train", 5), ("test", 2)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{i},{i + 1},3 # {i},1\n" for i in range(n)))
    lexer = Lexer.from_config(LEXER)
    got = prepare.prepare(spark, lexer, {"text": str(tmp_path / "train.txt")}, {"text": str(tmp_path / "test.txt")}, validate_train=True)
    batches = got.batches("train", 2).collect()
    assert len(batches) == 5 and {len(r["input_ids"]) for r in batches} == {7} and all(r["labels"][-1] == lexer.vocab.special_id("eos_token") for r in batches)
    assert prepare.preview(got.train, 2).count() == 2
    (tmp_path / "test.txt").write_text("99 # 1\n")
    with pytest.raises(ValueError, match="99"):
        prepare.prepare(spark, lexer, {"text": str(tmp_path / "train.txt")}, {"text": str(tmp_path / "test.txt")})


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1,2 # 3\nno mark\n")
    run = lambda: lexing.write_lexed(lexing.lexed_pairs(spark, str(folder), Lexer.from_config(LEXER)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (folder / "b.txt").write_text("4 # 5\n")
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("problem").collect()
    assert [(r["problem"], r["input_tokens"]) for r in got] == [("1,2", ["1", ",", "2"]), ("4", ["4"])]


def test_match_rate_by_window(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a", "a"), ("2024-01-01 00:02:00", "b", "c"), ("2024-01-01 05:00:00", "d", "d")], "t string, generated string, reference string")
    rows.withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, generated string, reference string").parquet(str(tmp_path / "in"))
    q = lexing.match_rate(stream, "t").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["exact_match"]) for r in spark.sql("SELECT * FROM rates ORDER BY start").collect()] == [(2, 0.5), (1, 1.0)]


def test_the_rest_works_without_the_training_data_package():
    """The other modules don't import it."""
    import pathlib

    for p in pathlib.Path(catalogue.__file__).parents[1].rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_factors_of_large_part_numbers(spark, tmp_path):
    def brute(n):
        out, d = [], 2
        while d * d <= n:
            while n % d == 0:
                out.append(d)
                n //= d
            d += 1
        return out + [n] * (n > 1)

    numbers = [2, 3, 163 * 163, 163 * 167, 167**2 * 2, 16384, 16387, 101 * 103 * 107, 9973**2, 99_999_989, 163 * 163]
    spark.createDataFrame([(n - 2,) for n in numbers], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = [(r["p_partkey"], r["factors"]) for r in catalogue.QUERIES["int_factor"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((n - 2, " | ".join(map(str, brute(n)))) for n in numbers)


def test_statistics_and_last_elements_hold_no_lists(spark, tmp_path):
    rows = [(1, i, "view", float(i)) for i in range(50)] + [(1, 50, None, None), (2, 51, "click", None), (3, 52, None, 1.5)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("list_stats", "last_element"):
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)), con.sql(catalogue.SQL[name])
        assert "collect_list" not in got._jdf.queryExecution().toString()
        assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


def test_large_vocabularies_are_joined(spark, tmp_path, monkeypatch):
    (tmp_path / "in.txt").write_text("".join(f"{i},{i + 1},3 # {i % 4}\n" for i in range(12)))
    lexer, source = Lexer.from_config(LEXER), {"text": str(tmp_path / "in.txt")}
    rows = lambda: sorted((r["idx"], r["input_ids_raw"], r["target_ids_raw"]) for r in prepare.prepare(spark, lexer, source, source).train.collect())
    by_map = rows()
    monkeypatch.setattr(prepare, "MAP_TOKENS", 0)
    assert rows() == by_map and len(by_map) == 12
