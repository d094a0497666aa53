"""Further queries with SQL: what is written and read again, configured, generated or refused."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexer as lex
from ..functions import loadprep, nested, text
from ..functions.vocab import Vocab, field_tokens, range_tokens
from ..operators import algebra, metrics, polynomials, ranks, tensors, validate
from ..sources import scans, sinks
from ..sources.folders import new_folder
from . import generate, prepare, samplers, tasks
from .catalogue import query, task_keys

# ---- files


def _samples(read) -> DataFrame:
    """Each customer's orders as a flat problem, their number as a scalar answer; train and test by parity."""
    rows = read("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    tag = F.when(F.col("o_custkey") % 2 == 0, "train").otherwise("test")
    return rows.select(tag.alias("tag"), F.col("o_custkey").alias("sample_index"), nested.flat(F.col("keys")).alias("problem"), nested.scalar(F.size("keys")).alias("answer"))


_SAMPLES_SQL = """
WITH s AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS tag, o_custkey,
                  string_agg(CAST(o_orderkey AS VARCHAR), ' | ' ORDER BY o_orderkey) AS bars, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS words, CAST(count(*) AS VARCHAR) AS answer
           FROM orders GROUP BY ALL)
"""


@query(_SAMPLES_SQL + "SELECT tag, bars AS problem, answer FROM s")
def text_sink_scan(spark, read):
    """Samples written as text lines, a folder for each tag, and loaded again by suffix."""
    folder = new_folder(spark, "samples")
    sinks.write_samples(_samples(read), folder, ("text",))
    return scans.load(spark, text=f"{folder}/train_raw.txt").select(F.lit("train").alias("tag"), "problem", "answer").unionByName(scans.load(spark, text=f"{folder}/test_raw.txt").select(F.lit("test").alias("tag"), "problem", "answer"))


@query(_SAMPLES_SQL + "SELECT tag, words AS problem, answer FROM s")
def jsonl_sink_scan(spark, read):
    """Samples written as JSON lines with their structure, then loaded as words."""
    folder = new_folder(spark, "samples")
    sinks.write_samples(_samples(read), folder, ("jsonl",))
    return scans.load(spark, text=f"{folder}/train_data.jsonl").withColumn("tag", F.lit("train")).unionByName(scans.load(spark, jsonl=f"{folder}/test_data.jsonl").withColumn("tag", F.lit("test")))


@query(_SAMPLES_SQL + "SELECT tag, bars AS problem, answer FROM s")
def parquet_sink_scan(spark, read):
    """Samples written twice: the second time replaces the first."""
    folder = new_folder(spark, "samples")
    rows = _samples(read)
    sinks.write_samples(rows.filter("sample_index < 100"), folder, ("parquet",))
    sinks.write_samples(rows, folder, ("parquet",))
    done = spark.read.parquet(f"{folder}/train.parquet", f"{folder}/test.parquet")
    return done.select("tag", nested.to_text(F.col("problem")).alias("problem"), nested.to_text(F.col("answer")).alias("answer"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS problem, s_name AS answer FROM supplier ORDER BY s_suppkey LIMIT 25")
def limited_scan(spark, read):
    """The first lines of some files: the limit is the operator, and files behind it aren't read."""
    path = new_folder(spark, "lines")
    read("supplier").repartitionByRange(12, "s_suppkey").sortWithinPartitions("s_suppkey").select(F.concat(F.lit("  "), "s_suppkey", F.lit(" # "), "s_name")).write.text(path)
    return scans.load(spark, text=path, limit=25)


@query("SELECT p_partkey AS place, p_name AS problem, p_brand AS answer FROM part WHERE p_partkey % 3 <> 0")
def malformed_records(spark, read):
    """JSON lines of which every third is broken, blank or no object."""
    line = F.to_json(F.struct("p_partkey", F.col("p_name").alias("problem"), F.col("p_brand").alias("answer")))
    bad = F.when(F.col("p_partkey") % 9 == 0, "[1, 2]").when(F.col("p_partkey") % 9 == 3, "   ").otherwise(F.concat(F.lit("{"), line))
    path = new_folder(spark, "lines")
    read("part").select(F.when(F.col("p_partkey") % 3 == 0, bad).otherwise(line).alias("value")).write.text(path)
    rows = scans.parse_records(scans.lines(spark, path))
    return rows.select(F.get_json_object("value", "$.p_partkey").cast("long").alias("place"), nested.to_words(F.col("problem")).alias("problem"), nested.to_words(F.col("answer")).alias("answer"))


@query("SELECT conv_id, CASE WHEN turn % 2 = 0 THEN text ELSE text || '!' END AS generated, text AS reference FROM conversations")
def eval_results_scan(spark, read):
    """Evaluation rows written for a step and read again; the conversation's id travels in the text."""
    folder, mark = new_folder(spark, "evaluation"), F.concat(F.col("conv_id").cast("string"), F.lit("\t"))
    rows = read("conversations").select(F.concat(mark, F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!")))).alias("generated"), F.concat(mark, "text").alias("reference"))
    sinks.write_eval_results(rows, folder, 10)
    back = scans.read_eval_results(spark, f"{folder}/step_10.json")
    own = lambda c: F.substring_index(c, "\t", 1)
    return back.select(own("reference").cast("long").alias("conv_id"), text.after(F.col("generated"), "\t").alias("generated"), text.after(F.col("reference"), "\t").alias("reference"))


@query(r"SELECT round(avg(CASE WHEN turn % 2 = 0 OR text = upper(text) THEN 1.0 ELSE 0.0 END), 6) AS eval_generation_success_rate, CAST(7 AS BIGINT) AS eval_generation_success_rate_step FROM conversations")
def evaluation_report(spark, read):
    rows = read("conversations").select(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.upper("text")).alias("generated"), F.col("text").alias("reference"))
    return metrics.evaluation(rows, 7).withColumn("eval_generation_success_rate", F.round("eval_generation_success_rate", 6))


@query("SELECT 'out/step_' || max(o_orderkey) || '.json' AS path FROM orders")
def latest_step_file(spark, read):
    """Steps are compared as numbers; other files don't count."""
    files = read("orders").select(F.concat(F.lit("out/step_"), "o_orderkey", F.lit(".json")).alias("path"))
    return scans.latest_step(files.unionByName(files.select(F.replace("path", F.lit("step"), F.lit("zstep9")).alias("path")).withColumn("path", F.concat("path", F.lit(".bak")))))


@query("SELECT user_id AS job_id, 'done' AS status, max(event_id) AS kernel_id FROM events WHERE user_id % 5 <> 0 GROUP BY user_id")
def job_log_scan(spark, read):
    """A log that is appended to three times: all jobs, their ends, and records that delete every fifth; one line isn't a record."""
    path = new_folder(spark, "jobs")
    jobs = read("events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("kernel"))
    record = lambda status: jobs.select(F.col("id").cast("string").alias("job_id"), F.col("kernel").cast("string").alias("kernel_id"), F.lit(status).alias("status"))
    sinks.append_jobs(record("running"), path)
    sinks.append_jobs(record("done"), path)
    spark.range(1).select(F.lit("no record")).coalesce(1).write.mode("append").text(path)
    gone = jobs.filter("id % 5 = 0").select(F.col("id").cast("string").alias("job_id"))
    sinks.delete_jobs(scans.latest_jobs(scans.read_job_log(spark, path)), gone, path)
    left = scans.present_jobs(scans.read_job_log(spark, path))
    field = lambda name: F.try_variant_get(F.parse_json("record"), f"$.{name}", "string")
    return left.select(F.col("job_id").cast("long").alias("job_id"), field("status").alias("status"), field("kernel_id").cast("long").alias("kernel_id"))


@query("SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS part FROM orders")
def file_manifest(spark, read):
    """Folders of all files below a folder."""
    path = new_folder(spark, "manifest")
    read("orders").write.partitionBy("o_orderstatus").parquet(path)
    parts = scans.manifest(spark, path).select(F.regexp_extract("path", r"/([^/]+=[^/]+)/[^/]+\.parquet$", 1).alias("part"))
    return parts.filter("part <> ''").distinct()


@query("""
SELECT event_id, event_id % 6 <> 4 AND event_id % 6 <> 5 AS well_formed FROM events
""")
def nested_format_check(spark, read):
    """Formulas with parentheses, some of them unbalanced or with a factor that stands beside another."""
    k = F.col("event_id").cast("string")
    forms = [("(", ")*(x - 1)^2 | (y)"), ("((x + ", ")*(y - (2*x + 1))**2)^3"), ("-(x + 1/2)*", ""), ("x*(", " + y^2) - 4"), ("(x + ", "*(y - 1)"), ("x(", ")")]
    value = F.lit(None)
    for i, (a, b) in enumerate(forms):
        value = F.when(F.col("event_id") % 6 == i, F.concat(F.lit(a), k, F.lit(b))).otherwise(value)
    return read("events").select("event_id", validate.pieces_are_formulas(value, ["x", "y"]).alias("well_formed"))


# ---- load steps, lexer, vocabularies


@query("SELECT event_id, regexp_replace(event_type, '^\\s+|\\s+$', '', 'g') AS problem, event_type || ' | ' || user_id AS answer FROM events")
def load_chain(spark, read):
    """Two steps of one's own after another: stripped problems, reversed answers."""
    rows = read("events").select("event_id", F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("problem"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("answer"))
    return rows.transform(loadprep.chain(loadprep.on_both(text.strip), loadprep.on_answer(loadprep.reversed_order)))


@query("SELECT user_id, string_agg(CAST(CAST(value AS BIGINT) - 50 AS VARCHAR), ',' ORDER BY event_id) AS decoded FROM events GROUP BY user_id")
def lex_decode(spark, read):
    """Through a chain of two lexers and back."""
    numbers = lex.Lexer.build(Vocab.build(range_tokens("", -16, 16) + [",", "|", "#"]), lex.NumberPolicy(True, 0, False))
    encode, decode = lex.chain(numbers, numbers)
    item = F.struct("event_id", (F.bround(F.col("value"), 0).cast("long") - 50).cast("string").alias("v"))
    rows = read("events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("e")).select("user_id", F.array_join(F.col("e.v"), ",").alias("t"))
    return rows.select("user_id", decode(encode(F.col("t"))).alias("decoded"))


@query("""
WITH b AS (SELECT max(p_size) AS n FROM part), r AS (SELECT count(*) AS p FROM region),
     c AS (SELECT 'centred' AS kind, unnest(range(-(n // 2), n + n // 2 + 1)) AS i FROM b), f AS (SELECT 'field' AS kind, unnest(range(1 - p, p + 1)) AS i FROM r)
SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY i) - 1 AS INTEGER) AS place, CASE kind WHEN 'field' THEN 'C' ELSE 'c' END || i AS token FROM (FROM c UNION ALL FROM f)
""")
def vocab_kinds(spark, read):
    """A centred range as wide as the sizes of parts, and tokens of the field with as many elements as there are regions."""
    n, p = read("part").agg(F.max("p_size")).first()[0], read("region").count()
    rows = [(kind, i, t) for kind, own in (("centred", range_tokens("c", 0, n, True)), ("field", field_tokens(f"GF{p}"))) for i, t in enumerate(own)]
    return spark.createDataFrame(rows, "kind string, place int, token string")


@query("""
WITH t AS (SELECT 0 AS a, event_type AS token FROM events GROUP BY event_type UNION ALL SELECT * FROM (VALUES (1, '<pad>'), (2, '<s>'), (3, '</s>'), (4, '[CLS]'), (5, '[MASK]')))
SELECT token, CAST(row_number() OVER (ORDER BY a, token) - 1 AS INTEGER) AS id, a > 0 AS is_special FROM t
""")
def vocab_merge(spark, read):
    """The kinds of events as tokens. Flags leave out the basic ones; own special tokens replace those with the same role and follow the
    others."""
    kinds = [r[0] for r in read("events").select("event_type").distinct().orderBy("event_type").collect()]
    return Vocab.from_config({"misc": kinds, "special_tokens": {"pad_token": "<pad>", "mask_token": "[MASK]"}, "flags": {"include_base_vocab": False}, "include_base_vocab": True}).frame(spark)


@query("""
WITH g AS (SELECT c_custkey, CAST(c_custkey % 10 AS INTEGER) AS n FROM customer),
     t AS (SELECT c_custkey, n, list_transform(range(1, n + 2), lambda i: (c_custkey * i) % 17) AS xs FROM g),
     i AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, list_concat([20], flatten(list_transform(xs, lambda x, k: CASE WHEN k > 1 THEN [18, x + 1] ELSE [x + 1] END)), [21]) AS ids FROM t),
     b AS (SELECT idx, ids, max(len(ids)) OVER (PARTITION BY idx // 16) AS longest FROM i)
SELECT idx, array_to_string(list_resize(ids, longest, 19), ' ') AS input_ids, array_to_string(list_resize([20, idx % 17 + 1, 21], 3, 19), ' ') AS targets FROM b
""")
def prepared_batches(spark, read):
    """Lines of numbers in ten files, lexed, encoded and padded by batches of 16 in the order of the files."""
    path = new_folder(spark, "lines")
    own = read("customer").select("c_custkey", (F.col("c_custkey") % 10).cast("int").alias("n"))
    xs = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda i: (F.col("c_custkey") * i % 17).cast("string")), ",")
    lines = own.repartitionByRange(10, "c_custkey").sortWithinPartitions("c_custkey").select(F.concat(xs, F.lit(" # "), (F.col("c_custkey") % 17).cast("string")).alias("value"))
    lines.write.text(path)
    lexer = lex.Lexer.build(Vocab.build(range_tokens("", 0, 16) + [","]), lex.NumberPolicy(False, 0, False))
    done = prepare.prepare(spark, lexer, {"text": path}, {"text": path}, validate_train=True)
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return done.batches("train", 16).select("idx", show("input_ids").alias("input_ids"), show("target_ids_raw").alias("targets"))


@query("SELECT 'p' || n_nationkey AS problem, substr(n_name || ' is a nation with quite a long name, longer than fifty', 1, 47) || '...' AS answer FROM nation ORDER BY n_nationkey LIMIT 5")
def preview_rows(spark, read):
    rows = read("nation").orderBy("n_nationkey").select(F.concat(F.lit("p"), "n_nationkey").alias("problem"), F.concat("n_name", F.lit(" is a nation with quite a long name, longer than fifty")).alias("answer"))
    return prepare.preview(rows)


# ---- generation


@query("""
WITH i AS (SELECT 'train' AS tag, unnest(range((SELECT count(*) FROM orders))) AS i UNION ALL SELECT 'test', unnest(range((SELECT count(*) FROM supplier))))
SELECT tag, i AS sample_index, substr(sha256('7_' || tag || '_' || i), 1, 32) AS seed FROM i
""")
def index_seeds(spark, read):
    """A seed for as many indices as there are orders and suppliers."""
    rows = scans.indices(spark, {"train": read("orders").count(), "test": read("supplier").count()})
    return rows.withColumn("seed", generate.seed_hex(F.lit(7), F.col("tag"), F.col("sample_index")))


def _by_seed(seed: int):
    low = seed % 65536
    return str(low), [str(low // 256), str(low % 256)]


_SEEDED_SQL = """
WITH i AS (SELECT 'train' AS tag, unnest(range((SELECT count(*) FROM customer))) AS i UNION ALL SELECT 'test', unnest(range((SELECT count(*) FROM supplier)))),
     s AS (SELECT tag, i AS sample_index, CAST('0x' || substr(sha256('42_' || tag || '_' || i), 29, 4) AS BIGINT) AS low FROM i)
"""


def _seeded(spark: SparkSession, read) -> DataFrame:
    """As many samples as there are customers and suppliers."""
    known = generate.Generators()
    known.add("by_seed", _by_seed)
    return generate.from_config(spark, {"dataset": {"generator": "by_seed", "num_train_samples": read("customer").count(), "num_test_samples": read("supplier").count()}}, known)


@query(_SEEDED_SQL + "SELECT tag, sample_index, CAST(low AS VARCHAR) AS problem, (low // 256) || ' | ' || (low % 256) AS answer FROM s")
def generated_samples(spark, read):
    """A registered function of the seed, called for each index of two splits."""
    return _seeded(spark, read).select("tag", "sample_index", nested.to_text(F.col("problem")).alias("problem"), nested.to_text(F.col("answer")).alias("answer"))


@query(_SEEDED_SQL + """
SELECT 'problem' AS category, 'value' AS metric, count(*) AS n, round(avg(low), 6) AS mean, round(stddev_pop(low), 6) AS std, min(low) :: DOUBLE AS min, max(low) :: DOUBLE AS max FROM s
UNION ALL SELECT 'answer', 'parts', count(*), 2.0, 0.0, 2.0, 2.0 FROM s
""")
def generated_statistics(spark, read):
    """Statistics that a function computes of each sample, scalar ones under `value`, as in the report of a run."""
    sizes = {"train": read("customer").count(), "test": read("supplier").count()}
    rows = generate.generate(spark, _by_seed, sizes, statistics=lambda p, a: {"problem": int(p), "answer": {"parts": len(a)}})
    report = metrics.sample_statistics(rows, "stats")
    return report.select("category", "metric", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("""
SELECT 'num_samples' AS name, count(*) :: DOUBLE AS value FROM part UNION ALL SELECT 'samples_per_second', count(*) / 10.0 FROM part UNION ALL SELECT 'generation_time.max', max(p_retailprice) FROM part
UNION ALL SELECT 'generation_time.min', min(p_retailprice) FROM part UNION ALL SELECT 'size_stats.value.max', max(p_size) :: DOUBLE FROM part UNION ALL SELECT 'total_time', 10.0
""")
def generation_report(spark, read):
    """The overall report of a run, flattened: prices stand for running times."""
    rows = read("part").select(F.col("p_retailprice").alias("runtime"), F.create_map(F.lit("size"), F.create_map(F.lit("value"), F.col("p_size").cast("double"))).alias("stats"))
    out = metrics.report(rows, "runtime", "stats", 10.0)
    flat = {"num_samples": out["num_samples"], "samples_per_second": out["samples_per_second"], "total_time": out["total_time"], "generation_time.max": out["generation_time"]["max"], "generation_time.min": out["generation_time"]["min"], "size_stats.value.max": out["size_stats"]["value"]["max"]}
    return spark.createDataFrame([(k, float(v)) for k, v in flat.items()], "name string, value double")


@query("""
WITH s AS (SELECT i, sha256('42_train_' || i) AS h FROM (SELECT unnest(range(20 * (SELECT count(*) FROM customer) + 2000)) AS i))
SELECT i AS sample_index, CAST(CAST('0x' || substr(h, 29, 4) AS BIGINT) AS VARCHAR) AS problem FROM s WHERE CAST('0x' || substr(h, 29, 4) AS BIGINT) % 11 = 0 ORDER BY i LIMIT (SELECT count(*) FROM customer)
""")
def accepted_samples(spark, read):
    """As many as there are customers of the first indices that a rejecting function accepts: one in eleven, while one in four is expected."""
    rows = generate.generate_accepted(spark, lambda seed: _by_seed(seed) if seed % 65536 % 11 == 0 else None, "train", read("customer").count())
    return rows.select("sample_index", nested.to_text(F.col("problem")).alias("problem"))


def _ranked(keys: DataFrame, schema: str, row: Callable[[int], tuple]) -> DataFrame:
    """A row for each key of a table's first column."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame([row(int(k)) for k in pdf.iloc[:, 0]], columns=[c.split()[0] for c in schema.split(", ")])

    return scans.spread(keys, keys.columns[0]).mapInPandas(run, schema)


@query("""
WITH s AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS rank, a || ',' || b || ',' || c AS members FROM range(0, 20) t(a), range(0, 20) u(b), range(0, 20) v(c) WHERE a < b AND b < c)
SELECT p_partkey, members FROM part JOIN s ON rank = p_partkey % 1140
""")
def combination_ranks(spark, read):
    """The 3-subset of 20 with each part's number as its rank, as the samplers find it."""
    return _ranked(read("part").select("p_partkey"), "p_partkey long, members string", lambda k: (k, ",".join(map(str, samplers.combination(k % 1140, 20, 3)))))


@query("""
WITH m AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS rank, a || ',' || b || ',' || c || ',' || (7 - a - b - c) AS exps FROM range(0, 8) t(a), range(0, 8) u(b), range(0, 8) v(c) WHERE a + b + c <= 7)
SELECT p_partkey, exps FROM part JOIN m ON rank = p_partkey % 120
""")
def monomial_ranks(spark, read):
    """The monomial of degree 7 in four variables with each part's number as its rank, as the samplers find it."""
    return _ranked(read("part").select("p_partkey"), "p_partkey long, exps string", lambda k: (k, ",".join(map(str, samplers.monomial(k % 120, 4, 7)))))


_RINGS = (("ZZ", 0), ("QQ", 1), ("GF(7)", 2), ("GF2", 3), ("RR", 4))


@query("SELECT p_partkey % 5 AS k, p_partkey AS sample_index, true AS in_range, true AS terms_fit, true AS degree_fits, true AS coefficients_fit, true AS repeats FROM part")
def polynomial_samples(spark, read):
    """Random polynomials in five rings: degrees, numbers of terms and coefficients within their bounds, and the same again by seed."""

    def row(rank: int) -> tuple:
        ring, k = _RINGS[rank % 5]
        s = samplers.PolynomialSampler.of_ring(f"{ring}[x, y]", min_degree=1, max_degree=4, max_terms=4, max_coeff=6, strict=k != 4)
        p, again = s.draw(random.Random(rank)), s.draw(random.Random(rank))
        degree = max(map(sum, p))
        fit = {"ZZ": lambda c: c.denominator == 1 and abs(c) <= 6, "QQ": lambda c: abs(c) <= 6 and c.denominator <= 6, "RR": lambda c: abs(c) <= 6}.get(ring, lambda c: 0 < c < s.field.modulus and c.denominator == 1)
        return k, rank, all(len(e) == 2 and min(e) >= 0 for e in p), 1 <= len(p) <= 4, 1 <= degree <= 4, all(map(fit, p.values())), p == again

    return _ranked(read("part").select("p_partkey"), "k long, sample_index long, in_range boolean, terms_fit boolean, degree_fits boolean, coefficients_fit boolean, repeats boolean", row)


@query("SELECT s_suppkey AS sample_index, true AS is_unimodular, 2 AS n_rows, true AS degrees_differ, true AS signed FROM supplier")
def matrix_samples(spark, read):
    """Unimodular matrices of polynomials, univariate polynomials and signed sizes."""

    def row(rank: int) -> tuple:
        rng, one = random.Random(rank), {(0, 0): 1}
        m = samplers.PolynomialSampler(("x", "y"), max_degree=2).matrix(rng, 2, 3, 0.7, unimodular=True)
        p = samplers.univariate(rng, samplers.Field("ZZ"), 6, 3, 5)
        n = samplers.signed_magnitude(rng, 9)
        return rank, m[0][0] == one == m[1][1] and m[1][0] == {}, len(m), len(p) == 3 and max(p)[0] <= 6, n != 0 and abs(n) <= 9

    return _ranked(read("supplier").select("s_suppkey"), "sample_index long, is_unimodular boolean, n_rows int, degrees_differ boolean, signed boolean", row)


# ---- invariants of the example tasks

_ALL_HOLD = "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'test' ELSE 'train' END AS tag, c_custkey AS sample_index, true AS holds FROM customer"


def _task(read, name: str) -> DataFrame:
    rows = generate.for_keys(task_keys(read("customer")), tasks.examples().get(name))
    return rows.select("tag", "sample_index", nested.to_text(F.col("problem")).alias("problem"), nested.to_text(F.col("answer")).alias("answer"))


def _numbers(c: str, sep: str = r"\s*\|\s*") -> Column:
    return F.transform(F.split(c, sep), lambda x: x.cast("long"))


@query(_ALL_HOLD)
def gf17_invariant(spark, read):
    """Answers are running sums modulo 17, and all numbers lie in the field."""
    rows = _task(read, "gf17_addition").withColumns({"x": _numbers("problem"), "y": _numbers("answer")})
    sums = F.transform("x", lambda _, i: F.pmod(F.aggregate(F.slice("x", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, v: s + v), F.lit(17)))
    return rows.select("tag", "sample_index", ((sums == F.col("y")) & F.forall("x", lambda v: v.between(0, 16)) & F.size("x").between(3, 6)).alias("holds"))


@query(_ALL_HOLD)
def integer_factors_invariant(spark, read):
    """Answers are sorted distinct primes whose product is the problem."""
    rows = _task(read, "integer_factorization").withColumn("f", _numbers("answer"))
    product = F.aggregate("f", F.lit(1).cast("long"), lambda s, v: s * v)
    primes = F.array(*map(F.lit, tasks.PRIMES_BELOW_30)).cast("array<long>")
    return rows.select("tag", "sample_index", ((product == F.col("problem").cast("long")) & (F.array_sort(F.array_distinct("f")) == F.col("f")) & (F.size(F.array_except("f", primes)) == 0)).alias("holds"))


@query(_ALL_HOLD)
def polynomial_sums_invariant(spark, read):
    """Answers are prefix sums: the terms of each are the sums of the terms of the problem's polynomials so far."""
    folder = new_folder(spark, "sums")
    _task(read, "polynomial_addition").write.parquet(folder)
    rows = spark.read.parquet(folder)
    spread = lambda c: rows.select("tag", "sample_index", F.posexplode(F.split(c, r"\s*\|\s*")).alias("place", "poly")).select("tag", "sample_index", "place", F.explode(polynomials.parse_expanded(F.col("poly"), ["x", "y"])).alias("t")).select(F.struct("tag", "sample_index").alias("key"), "place", F.col("t.exps").alias("exps"), F.col("t.coeff").cast(polynomials.COEFF).alias("coeff"))
    places = rows.select(F.struct("tag", "sample_index").alias("key"), F.posexplode(F.split("problem", r"\s*\|\s*")).alias("place", "_"))
    want = polynomials.prefix_sums(spread("problem"), "key", "place", places=places.select("key", "place")).select(F.struct("key", "place").alias("id"), "exps", "coeff")
    got = polynomials.normalise(spread("answer").withColumn("id", F.struct("key", "place")), "id")
    wrong = polynomials.compare(want, got, "id").filter("state <> 'equal'").select("id.key.*").distinct()
    return rows.join(wrong.withColumn("wrong", F.lit(True)), ["tag", "sample_index"], "left").select("tag", "sample_index", F.col("wrong").isNull().alias("holds"))


def _checked(rows: DataFrame, holds: Callable[[str, str], bool]) -> DataFrame:
    """Single rows of exact algebra checked in Python."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(holds=[bool(holds(p, a)) for p, a in zip(pdf["problem"], pdf["answer"])])[["tag", "sample_index", "holds"]]

    return rows.mapInPandas(run, "tag string, sample_index long, holds boolean")


def _same_polynomial(problem: str, answer: str) -> bool:
    return algebra.parse(problem, ["x"]) == algebra.parse(answer, ["x"])


@query(_ALL_HOLD)
def integer_polynomial_factors_invariant(spark, read):
    """The product of the factors is the problem."""
    return _checked(_task(read, "integer_polynomial_factorization"), _same_polynomial)


@query(_ALL_HOLD)
def rational_polynomial_factors_invariant(spark, read):
    return _checked(_task(read, "rational_polynomial_factorization"), _same_polynomial)


@query(_ALL_HOLD)
def eigenvector_invariant(spark, read):
    """Answers are unit vectors v for which M v is a multiple of v as large as the largest eigenvalue, within the two decimals."""

    def holds(problem: str, answer: str) -> bool:
        import numpy as np

        m = np.array([row.split(" | ") for row in problem.split(" || ")], float)
        v = np.array(answer.split(" | "), float)
        values, vectors = np.linalg.eigh(m)
        gap = values[-1] - values[-2]
        aligned = min(np.abs(vectors[:, -1] - s * v).max() for s in (1, -1))
        return np.allclose(m, m.T) and abs(np.linalg.norm(v) - 1) < 0.02 and aligned <= 0.02 + 0.05 / max(gap, 1e-9)

    return _checked(_task(read, "eigvec_3x3"), holds)


@query("SELECT true AS divides, true AS rest_is_reduced, true AS basis_is_standard, true AS enough")
def reduction_invariant(spark, read):
    """Problems are a polynomial and a Groebner basis: S-polynomials reduce to zero, and so does problem minus answer, whose terms no
    leading term divides. Quotients times the basis give the difference. Ideals that are everything yield no sample."""
    rows = _task(read, "polynomial_reduction")

    def check(frames):
        import pandas as pd

        key, show = algebra.ORDERS["grevlex"], []
        for pdf in frames:
            for problem, answer in zip(pdf["problem"], pdf["answer"]):
                f, *basis = (algebra.parse(t, ["x", "y"]) for t in problem.split(" | "))
                rest = algebra.parse(answer, ["x", "y"])
                quotients, zero = algebra.divide(algebra.plus(f, rest, -1), basis)
                total = {}
                for q, g in zip(quotients, basis):
                    total = algebra.plus(total, algebra.times(q, g))
                heads = [algebra.lead(g, key) for g in basis]
                show.append((not zero and total == algebra.plus(f, rest, -1), not any(algebra.divides(h, e) for h in heads for e in rest), algebra.groebner(basis) == sorted((algebra.monic(g, key) for g in basis), key=lambda g: key(algebra.lead(g, key)), reverse=True)))
            yield pd.DataFrame(show, columns=["divides", "rest_is_reduced", "basis_is_standard"])
            show.clear()

    done = rows.mapInPandas(check, "divides boolean, rest_is_reduced boolean, basis_is_standard boolean")
    return done.agg(*(F.bool_and(c).alias(c) for c in ("divides", "rest_is_reduced", "basis_is_standard")), (F.count("*") * 5 > read("customer").count()).alias("enough"))


# ---- factor statistics, positions, text functions


@query("""
WITH RECURSIVE f AS (SELECT p_partkey AS n, p_partkey + 2 AS rest, 2 AS d, [] :: BIGINT[] AS found FROM part
  UNION ALL SELECT n, CASE WHEN rest % d = 0 THEN rest // d ELSE rest END, CASE WHEN rest % d = 0 THEN d ELSE d + 1 END, CASE WHEN rest % d = 0 THEN list_append(found, d) ELSE found END FROM f WHERE d * d <= rest),
     w AS (SELECT n, CASE WHEN rest > 1 THEN list_append(found, rest) ELSE found END AS fs FROM f WHERE d * d > rest)
SELECT n AS p_partkey, CAST(len(list_distinct(fs)) AS INTEGER) AS n_distinct, CAST(len(fs) AS INTEGER) AS n_total FROM w
""")
def factor_statistics(spark, read):
    """Numbers of distinct prime factors and of all, of every part number plus 2."""
    rows = read("part").select("p_partkey", (F.col("p_partkey") + 2).cast("long").alias("n"))
    rows = rows.join(polynomials.prime_divisors(rows, "n"), "n", "left")
    found = polynomials.prime_factors(F.col("n"), F.coalesce("primes", F.array().cast("array<long>")))
    counted = F.transform(F.array_distinct("found"), lambda p: F.struct(p.alias("factor"), F.size(F.filter("found", lambda q: q == p)).alias("multiplicity")))
    stats = metrics.factor_statistics(counted)
    return rows.withColumn("found", found).select("p_partkey", stats["distinct"].alias("n_distinct"), stats["total"].alias("n_total"))


@query("""
WITH e AS (SELECT vec_id, embedding AS v, least(vec_id, 31) AS p FROM embeddings)
SELECT e.vec_id, round(list_sum(list_transform(list_zip(e.v, t.embedding), lambda x, i: i * (CAST(x[1] AS DOUBLE) + CAST(x[2] AS DOUBLE)))), 4) AS learned FROM e JOIN embeddings t ON t.vec_id = p
""")
def learned_positions(spark, read):
    """The first 32 vectors as a learned table; positions behind it use its last row."""
    own = read("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    table = own.filter("vec_id < 32").select(F.col("vec_id").alias("pos"), F.col("v").alias("weights"))
    rows = tensors.add_learned(own, "v", "vec_id", table, 32)
    return rows.select("vec_id", F.round(F.aggregate(F.transform("v", lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x), 4).alias("learned"))


@query("""
WITH e AS (SELECT vec_id, embedding AS v FROM embeddings), p AS (SELECT vec_id, d, CAST(v[d + 1] AS DOUBLE) AS x, CAST(vec_id % 100 AS DOUBLE) * pow(10000, -2.0 * (d // 2) / 64) AS a FROM e, range(0, 64) t(d))
SELECT vec_id, round(sum((d + 1) * x), 4) AS plain, round(sum((d + 1) * (x + CASE WHEN d % 2 = 0 THEN sin(a) ELSE cos(a) END)), 4) AS waves FROM p GROUP BY vec_id
""")
def position_kinds(spark, read):
    """Checksums of vectors without positions and with waves added, by the encoding's name."""
    sum_up = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x), 4)
    at = lambda kind: tensors.encode_positions(kind, F.col("embedding"), F.col("vec_id") % 100, 64)
    return read("embeddings").select("vec_id", sum_up(at("none")).alias("plain"), sum_up(at("sinusoidal")).alias("waves"))


@query("""
SELECT s_suppkey, 'owner/' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS owned, CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END AS truth,
       CAST(s_suppkey * 3600 + 90 AS DOUBLE) AS seconds, printf('%.2f', s_suppkey / 4.0 + 0.001) AS fixed, true AS stamp_fits, true AS job_fits FROM supplier
""")
def text_functions(spark, read):
    """Owned ids, truth values, intervals as seconds, two decimals, time stamps and job ids by their form."""
    took = F.make_dt_interval(F.lit(0), F.col("s_suppkey").cast("int"), F.lit(1), F.lit(30).cast("decimal(18,6)"))
    return read("supplier").select(
        "s_suppkey", text.owned_id(F.lit("owner"), F.col("s_name")).alias("owned"), text.truth_text(F.col("s_acctbal") > 0).alias("truth"), text.seconds_of(took).alias("seconds"), text.two_decimals(F.col("s_suppkey") / 4 + 0.001).alias("fixed"),
        text.utc_now().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$").alias("stamp_fits"), text.new_job_id().rlike("^job-[0-9a-f]{12}$").alias("job_fits"),
    )


# ---- what is refused


def _refused(f: Callable) -> bool:
    try:
        f()
    except (ValueError, TypeError, RuntimeError):
        return True
    return False


#: What is refused, and what the same place takes, made from a nation's key and name.
_CASES: dict[str, tuple[Callable, Callable]] = {
    "limit": (lambda k, n: scans.check_limit(-2 - k), lambda k, n: scans.check_limit(k + 1)),
    "limit of 0": (lambda k, n: scans.check_limit(0), lambda k, n: scans.check_limit(-1)),
    "sizes": (lambda k, n: scans.indices(SparkSession.active(), {n: -k}), lambda k, n: scans.indices(SparkSession.active(), {n: k + 1})),
    "no sizes": (lambda k, n: scans.indices(SparkSession.active(), {}), lambda k, n: scans.indices(SparkSession.active(), {n: 1})),
    "no path": (lambda k, n: scans.load(SparkSession.active()), lambda k, n: n),
    "tag": (lambda k, n: sinks.check_tag(k), lambda k, n: sinks.check_tag(n)),
    "empty tag": (lambda k, n: sinks.check_tag(n[:0]), lambda k, n: sinks.check_tag(n[:1])),
    "sign policy": (lambda k, n: lex.NumberPolicy(n), lambda k, n: lex.NumberPolicy(k % 2 == 0)),
    "digit group": (lambda k, n: lex.NumberPolicy(digit_group=-1 - k), lambda k, n: lex.NumberPolicy(digit_group=k)),
    "lexer chain": (lambda k, n: lex.chain(), lambda k, n: lex.chain(lex.Lexer.build(Vocab.build([n])))),
    "load chain": (lambda k, n: loadprep.chain(), lambda k, n: loadprep.chain(loadprep.on_both(text.strip))),
    "three levels": (lambda k, n: nested.of_python([[[n]]]), lambda k, n: nested.of_python([[n]])),
    "object as a leaf": (lambda k, n: nested.of_python([{n: k}]), lambda k, n: nested.of_python([n, str(k)])),
    "field": (lambda k, n: field_tokens(n), lambda k, n: field_tokens(f"GF{k + 1}")),
    "domain": (lambda k, n: samplers.Field.parse(n), lambda k, n: samplers.Field.parse(f"GF({k + 2})")),
    "ring": (lambda k, n: samplers.PolynomialSampler.of_ring(n), lambda k, n: samplers.PolynomialSampler.of_ring("ZZ[x]")),
    "ring and field": (lambda k, n: samplers.PolynomialSampler.of_ring("ZZ[x]", field=samplers.Field("QQ")), lambda k, n: samplers.PolynomialSampler.of_ring("QQ[x, y]", max_degree=k)),
    "degrees": (lambda k, n: samplers.PolynomialSampler((n,), min_degree=k + 1, max_degree=k), lambda k, n: samplers.PolynomialSampler((n,), min_degree=k, max_degree=k)),
    "sampling": (lambda k, n: samplers.PolynomialSampler((n,), degree_sampling=n), lambda k, n: samplers.PolynomialSampler((n,), degree_sampling="fixed")),
    "variables": (lambda k, n: validate.variable_names([n, n]), lambda k, n: validate.variable_names(n, k + 1)),
    "generator": (lambda k, n: generate.Generators().get(n), lambda k, n: tasks.examples().get("gf17_addition")),
    "encoding": (lambda k, n: tensors.encode_positions(n, F.lit(1), F.lit(1), 4), lambda k, n: tensors.encode_positions("none", F.lit(1), F.lit(1), 4)),
    "statistic": (lambda k, n: generate.numbers({n: {n: n}}), lambda k, n: generate.numbers({n: {n: k}})),
    "formula": (lambda k, n: algebra.parse(f"x + * {k}", ["x"]), lambda k, n: algebra.parse(f"x + {k}", ["x"])),
    "rank": (lambda k, n: ranks.combination(F.lit(0), k, k + 1), lambda k, n: ranks.combination(F.lit(0), k + 1, k)),
}


@query("SELECT n_nationkey, name, true AS refused, true AS taken FROM nation, (SELECT unnest([" + ", ".join(f"'{name}'" for name in _CASES) + "]) AS name)")
def refused_arguments(spark, read):
    """Arguments that are errors and others that aren't, each tried with every nation's key and name."""
    nations = read("nation").select("n_nationkey", "n_name").collect()
    rows = [(k, name, _refused(lambda: bad(k, n)), not _refused(lambda: good(k, n))) for k, n in nations for name, (bad, good) in _CASES.items()]
    return spark.createDataFrame(rows, "n_nationkey int, name string, refused boolean, taken boolean")


@query("SELECT r_regionkey, r_regionkey % 3 <> 0 AS refused FROM region")
def refused_tokens(spark, read):
    """Data sets of nations, one for each region, some of which have tokens outside the vocabulary: those fail their check."""
    lexer = lex.Lexer.build(Vocab.build(range_tokens("", 0, 99) + [","]), lex.NumberPolicy(False, 0, False))
    answer = F.concat(F.lit("99,"), F.when(F.col("n_regionkey") % 3 == 0, F.lit("")).otherwise(F.lit("1")), F.lpad(F.col("n_nationkey").cast("string"), 2, "1"))
    rows = read("nation").select("n_regionkey", F.col("n_nationkey").cast("string").alias("problem"), answer.alias("answer"))
    keys = [r[0] for r in read("region").select("r_regionkey").collect()]
    checked = [(k, _refused(lambda: validate.check_tokens(rows.filter(F.col("n_regionkey") == k), lexer, "problem", "answer"))) for k in keys]
    return spark.createDataFrame(checked, "r_regionkey int, refused boolean")
