"""Queries with SQL for what draws, ranks, appends and merges by the keys of tables."""

from __future__ import annotations

import contextlib
import pickle
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import draws, nested
from ..functions import lexer as lex
from ..functions import text as texts
from ..functions.vocab import Vocab, range_tokens
from ..operators import algebra, expressions, metrics, polynomials, ranks, spectra, validate
from ..sources import folders, scans, sinks
from ..sources.batches import BatchTable
from ..sources.pair_format import Pairs
from ..streaming import joblog
from ..sources.folders import new_folder
from .catalogue import as_double, query, task_keys
from . import generate, prepare, tasks
from .drawn import Drawn, univariate
from .reduction import reduction_step
from .samplers import Field, PolynomialSampler

# ---- batches


@query("SELECT o_orderkey, o_custkey, o_orderkey % 10 AS batch FROM orders")
def appended_batches(spark, read):
    """Ten batches of orders, one of which fails at first; two come twice, another table's rows are never committed."""
    table = BatchTable(spark, new_folder(spark, "batches"))
    rows = read("orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 10).alias("batch"))
    failing = F.when(F.col("o_orderkey") >= 0, F.raise_error(F.lit("stopped"))).otherwise(F.col("o_orderkey")).cast("long")
    for k in range(10):
        own = rows.filter(F.col("batch") == k)
        if k == 7:
            with contextlib.suppress(Exception):
                table.append(own.withColumn("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey")).otherwise(failing)), "7")
        table.append(own, str(k))
        if k in (3, 7):
            table.append(own, str(k))
    read("supplier").select(F.col("s_suppkey").alias("o_orderkey"), F.col("s_suppkey").alias("o_custkey"), F.lit(11).cast("long").alias("batch")).write.parquet(f"{table.folder}/data/00000000000000000001-stray")
    return table.read()


@query("SELECT o_orderkey % 4 AS batch, count(*) AS rows FROM orders GROUP BY ALL")
def batch_log(spark, read):
    """The log of a table of text lines: its batches and their numbers of rows."""
    table = BatchTable(spark, new_folder(spark, "batches"), "text")
    for k in range(4):
        own = read("orders").filter(F.col("o_orderkey") % 4 == k)
        table.append(own.select(nested.scalar(F.col("o_orderkey")).alias("problem"), nested.scalar(F.col("o_custkey")).alias("answer")), f"b{k}")
        table.append(own.limit(0), f"b{k}")
    return table.log().select(F.substring("batch", 2, 9).cast("long").alias("batch"), "rows")


@query("""
SELECT l_returnflag AS category, l_linestatus AS metric, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max
FROM lineitem GROUP BY ALL
""")
def merged_statistics(spark, read):
    """Statistics of ten batches, each appended as a partial result and none read again, put together."""
    states = BatchTable(spark, new_folder(spark, "states"))
    rows = read("lineitem").select("l_orderkey", F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("metric"), F.col("l_extendedprice").alias("value"))
    for k in range(10):
        states.append(metrics.partial(rows.filter(F.col("l_orderkey") % 10 == k), "category", "metric"), str(k))
    out = metrics.described(metrics.merged(states.read(), "category", "metric"), "category", "metric")
    return out.select("category", "metric", "n", as_double(F.col("mean")).alias("mean"), as_double(F.col("std")).alias("std"), "min", "max")


# ---- ranks and draws


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("""
WITH s AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS rank, a || ',' || b || ',' || c AS members FROM range(0, 20) t(a), range(0, 20) u(b), range(0, 20) v(c) WHERE a < b AND b < c)
SELECT o_orderkey, members FROM orders JOIN s ON rank = o_orderkey % 1140
""")
def ranked_combinations(spark, read):
    """For each order the 3-subset of 20 whose rank its key is, again from the first behind the last."""
    return read("orders").select("o_orderkey", _joined(ranks.combination(F.col("o_orderkey") % 1140, 20, 3)).alias("members"))


@query("""
WITH m AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS rank, a || ',' || b || ',' || c || ',' || (7 - a - b - c) AS exps FROM range(0, 8) t(a), range(0, 8) u(b), range(0, 8) v(c) WHERE a + b + c <= 7),
     l AS (SELECT row_number() OVER (ORDER BY a + b + c, a, b) - 1 AS rank, a || ',' || b || ',' || c AS low FROM range(0, 6) t(a), range(0, 6) u(b), range(0, 6) v(c) WHERE a + b + c <= 5)
SELECT o_orderkey, exps, low FROM orders JOIN m ON m.rank = o_orderkey % 120 JOIN l ON l.rank = o_orderkey % 56
""")
def ranked_monomials(spark, read):
    """Monomials of degree 7 in four variables, and of degree 5 at most in three, by the orders' keys."""
    exps, low = ranks.monomial(F.col("o_orderkey") % 120, 4, 7), ranks.monomial_up_to(F.col("o_orderkey") % 56, 3, 5)
    return read("orders").select("o_orderkey", _joined(exps).alias("exps"), _joined(low).alias("low"))


def _hash(text: str) -> str:
    """SQL for the 60 bits of a draw."""
    return f"CAST('0x' || substr(sha256({text}), 1, 15) AS BIGINT)"


def _terms(p: Column) -> Column:
    """`exponents:coefficient` of all terms, by exponents."""
    number = lambda t: F.when(t["den"] == 1, t["num"].cast("string")).otherwise(F.concat_ws("/", t["num"].cast("string"), t["den"].cast("string")))
    ordered = F.array_sort(F.transform(p, lambda t: F.struct(t["exps"].alias("exps"), number(t).alias("c"))))
    return F.array_join(F.transform(ordered, lambda t: F.concat(_joined(t["exps"]), F.lit(":"), t["c"])), " ")


@query(f"""
WITH o AS (SELECT o_orderkey AS k, t AS attempt, 's' || o_orderkey || ':' || t AS seed FROM orders, range(0, 20) r(t)),
     d AS (SELECT *, 1 + {_hash("seed || ':degree'")} % 3 AS degree FROM o),
     c AS (SELECT *, 1 + {_hash("seed || ':terms'")} % least(4, (degree + 1) * (degree + 2) // 2) AS n FROM d),
     m AS (SELECT a, b, row_number() OVER (ORDER BY a + b, a) - 1 AS rank FROM range(0, 4) t(a), range(0, 4) u(b) WHERE a + b <= 3),
     t AS (SELECT c.*, a, b, row_number() OVER (PARTITION BY k, attempt ORDER BY {_hash("seed || ':monomial:' || rank")}, rank) - 1 AS i FROM c JOIN m ON a + b <= degree),
     p AS (SELECT *, {_hash("seed || ':coefficient:' || i")} % 7 AS coeff FROM t WHERE i < n),
     f AS (SELECT k, min(attempt) AS attempt FROM (SELECT k, attempt FROM p WHERE coeff <> 0 AND a + b > 0 GROUP BY ALL) GROUP BY k)
SELECT k AS o_orderkey, string_agg(a || ',' || b || ':' || coeff, ' ' ORDER BY a, b) AS terms FROM p JOIN f USING (k, attempt) WHERE coeff <> 0 GROUP BY k
""")
def drawn_polynomials(spark, read):
    """A random polynomial over GF(7) for each order's key: degree, number of terms, distinct monomials and coefficients drawn, again
    where it vanishes or is constant."""
    sampler = PolynomialSampler.of_ring("GF(7)[x, y]", min_degree=1, max_degree=3, max_terms=4, strict=False)
    p = Drawn(sampler).polynomial(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")))
    return read("orders").select("o_orderkey", _terms(p).alias("terms"))


@query(f"""
WITH o AS (SELECT c_custkey AS k, t AS attempt, 't' || c_custkey || ':' || t AS seed FROM customer, range(0, 60) r(t)),
     c AS (SELECT *, 1 + {_hash("seed || ':terms'")} % 4 AS n FROM o),
     m AS (SELECT a, b, row_number() OVER (ORDER BY a + b, a) - 1 AS rank FROM range(0, 3) t(a), range(0, 3) u(b) WHERE a + b <= 2),
     t AS (SELECT c.*, a, b, row_number() OVER (PARTITION BY k, attempt ORDER BY {_hash("seed || ':monomial:' || rank")}, rank) - 1 AS i FROM c, m),
     p AS (SELECT *, {_hash("seed || ':coefficient:' || i")} % 5 AS coeff FROM t WHERE i < n),
     f AS (SELECT k, min(attempt) AS attempt FROM (SELECT k, attempt FROM p WHERE coeff <> 0 GROUP BY ALL HAVING count(*) >= 2) GROUP BY k)
SELECT k AS c_custkey, string_agg(a || ',' || b || ':' || coeff, ' ' ORDER BY a, b) AS terms FROM p JOIN f USING (k, attempt) WHERE coeff <> 0 GROUP BY k
""")
def drawn_with_two_terms(spark, read):
    """Polynomials over GF(5) for each customer, drawn again until they have two terms at least."""
    sampler = PolynomialSampler.of_ring("GF(5)[x, y]", max_degree=2, max_terms=4, degree_sampling="fixed", strict=False)
    p = Drawn(sampler, min_terms=2).polynomial(F.concat(F.lit("t"), F.col("c_custkey").cast("string")))
    return scans.spread(read("customer").select("c_custkey"), "c_custkey").select("c_custkey", _terms(p).alias("terms"))


_STRICT_SQL = f"""
c AS (SELECT key, seed || ':0' AS seed FROM s),
     m AS (SELECT a, b, row_number() OVER (ORDER BY a + b, a) - 1 AS rank FROM range(0, 3) t(a), range(0, 3) u(b) WHERE a + b <= 2),
     t AS (SELECT c.*, a, b, row_number() OVER (PARTITION BY key ORDER BY {_hash("seed || ':monomial:' || rank")}, rank) - 1 AS i FROM c, m),
     u AS (SELECT *, max(a + b) OVER (PARTITION BY key) AS reached, {_hash("seed || ':top'")} % 3 AS top FROM t WHERE i < 3),
     x AS (SELECT key, seed, i, CASE WHEN i = 0 AND reached < 2 THEN top ELSE a END AS a, CASE WHEN i = 0 AND reached < 2 THEN 2 - top ELSE b END AS b FROM u),
     y AS (SELECT key, a, b, (CASE WHEN {_hash("seed || ':coefficient:' || i || ':sign'")} % 2 = 0 THEN -1 ELSE 1 END) * ({_hash("seed || ':coefficient:' || i || ':size'")} % 9 + 1) AS coeff FROM x),
     z AS (SELECT key, string_agg(a || ',' || b || ':' || coeff, ' ' ORDER BY a, b) AS terms FROM y GROUP BY key)
"""
_STRICT = PolynomialSampler.of_ring("ZZ[x, y]", min_degree=0, max_degree=2, max_terms=3, max_coeff=9, degree_sampling="fixed", term_sampling="fixed")


@query("WITH s AS (SELECT c_custkey AS key, 'z' || c_custkey AS seed FROM customer), " + _STRICT_SQL + "SELECT key AS c_custkey, terms FROM z")
def drawn_strict_polynomials(spark, read):
    """Polynomials with whole coefficients, exactly three terms and degree two for each customer."""
    p = Drawn(_STRICT).polynomial(F.concat(F.lit("z"), F.col("c_custkey").cast("string")))
    return scans.spread(read("customer").select("c_custkey"), "c_custkey").select("c_custkey", _terms(p).alias("terms"))


@query("WITH g AS (SELECT s_suppkey, i, j FROM supplier, range(0, 2) t(i), range(0, 3) u(j)), s AS (SELECT (s_suppkey, i, j) AS key, 'm' || s_suppkey || ':' || i || ',' || j AS seed FROM g WHERE i < j AND " + _hash("'m' || s_suppkey || ':' || i || ',' || j || ':density'") + " // 256 * pow(2.0, -52) < 0.7), " + _STRICT_SQL + """
SELECT s_suppkey, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN '0,0:1' ELSE coalesce(terms, '') END AS terms FROM g LEFT JOIN z ON z.key = (s_suppkey, i, j)
""")
def drawn_matrices(spark, read):
    """Unimodular matrices of polynomials, about a third of whose free cells are zero, for each supplier."""
    m = Drawn(_STRICT).matrix(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")), 2, 3, 0.7, unimodular=True)
    rows = read("supplier").select("s_suppkey", F.posexplode(m).alias("i", "row")).select("s_suppkey", "i", F.posexplode("row").alias("j", "p"))
    return rows.select("s_suppkey", "i", "j", _terms(F.col("p")).alias("terms"))


@query(f"""
WITH s AS (SELECT p_partkey, 'u' || p_partkey AS seed FROM part),
     d AS (SELECT s.*, d, row_number() OVER (PARTITION BY p_partkey ORDER BY {_hash("seed || ':degree:' || d")}, d) - 1 AS i FROM s, range(0, 7) t(d)),
     c AS (SELECT *, (CASE WHEN {_hash("seed || ':coefficient:' || i || ':sign'")} % 2 = 0 THEN -1 ELSE 1 END) * ({_hash("seed || ':coefficient:' || i || ':size'")} % 5 + 1) AS num, {_hash("seed || ':coefficient:' || i || ':den'")} % 5 + 1 AS den FROM d WHERE i < 3)
SELECT p_partkey, string_agg(d || ':' || (num // gcd(num, den)) || CASE WHEN den // gcd(num, den) = 1 THEN '' ELSE '/' || (den // gcd(num, den)) END, ' ' ORDER BY d) AS terms,
       any_value((CASE WHEN {_hash("seed || ':n:sign'")} % 2 = 0 THEN -1 ELSE 1 END) * ({_hash("seed || ':n:size'")} % 9 + 1)) AS n FROM c GROUP BY p_partkey
""")
def drawn_univariate(spark, read):
    """Fractions before three different powers of one variable, and a whole number by its sign and size, for each part."""
    seed = F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    drawn = Drawn(PolynomialSampler(("x",), Field("QQ"), max_coeff=5))
    return scans.spread(read("part").select("p_partkey"), "p_partkey").select("p_partkey", _terms(univariate(seed, drawn, 6, 3)).alias("terms"), draws.signed(9, seed, "n").alias("n"))


# ---- formulas


@query("SELECT p_partkey, p_partkey % 12 < 7 AS well_formed FROM part")
def formula_check(spark, read):
    """Formulas with divisions by constants and signs inside products, five kinds of which divide by what they mustn't or break off."""
    k = (F.col("p_partkey") + 1).cast("string")
    forms = ["x/{}", "(x + {})/2 | y", "{}*-x", "-(-y)^2/{}", "x^(2 + 1)*{}", "((x)) - +{}", "{}/3/5*x**2", "{}/(2 - 2)", "{}/y", "x^-{}", "{}*(x | y)", "x^{}^y"]
    value = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        before, after = form.split("{}")
        value = F.when(F.col("p_partkey") % len(forms) == i, F.concat(F.lit(before), k, F.lit(after))).otherwise(value)
    return read("part").select("p_partkey", validate.pieces_are_formulas(value, ["x", "y"]).alias("well_formed"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey AS k, CAST(p_size AS BIGINT) AS s FROM part),
     t AS (SELECT p_partkey, unnest([{'e': '2,1', 'num': 1, 'den': 2}, {'e': '2,0', 'num': -1, 'den': 2}, {'e': '1,1', 'num': k, 'den': 1}, {'e': '1,0', 'num': s - k, 'den': 1}, {'e': '0,1', 'num': k * k, 'den': 2}, {'e': '0,0', 'num': -k * k, 'den': 2}]) AS t FROM p),
     f AS (SELECT p_partkey, t.e AS exps, t.num // gcd(t.num, t.den) AS num, t.den // gcd(t.num, t.den) AS den FROM t WHERE t.num <> 0)
SELECT p_partkey, string_agg(exps || ':' || num || CASE WHEN den = 1 THEN '' ELSE '/' || den END, ' ' ORDER BY exps) AS terms FROM f GROUP BY p_partkey
""")
def expression_terms(spark, read):
    """Terms of (x + key)^2 * (y - 1) / 2 - -size * x for every part, from the text."""
    text = F.concat(F.lit("(x + "), F.col("p_partkey").cast("string"), F.lit(")^2 * (y - 1)/2 - -"), F.col("p_size").cast("string"), F.lit("*x"))
    return scans.spread(read("part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", _terms(expressions.parse_expression(text, ["x", "y"])).alias("terms"))


# ---- factors and eigenvectors


def _factor_text(factors: Column) -> Column:
    """Factors as lists of coefficients from the constant on."""
    return F.array_join(F.transform(factors, _joined), " | ")


@query("""
WITH p AS (SELECT p_partkey, p_size % 7 - 3 AS a, p_partkey % 23 - 11 AS b, p_partkey % 61 - 30 AS c FROM part),
     r AS (SELECT p_partkey, r FROM p, range(-31, 32) t(r) WHERE r * r * r + a * r * r + b * r + c = 0),
     m AS (SELECT p.*, r, CASE WHEN 3 * r * r + 2 * a * r + b <> 0 THEN 1 WHEN 6 * r + 2 * a <> 0 THEN 2 ELSE 3 END AS times FROM r JOIN p USING (p_partkey)),
     n AS (SELECT p_partkey, sum(times) AS roots FROM m GROUP BY p_partkey),
     f AS (SELECT p_partkey, [CAST(-r AS BIGINT), 1] AS f FROM m, range(0, 3) t(i) WHERE i < times
           UNION ALL SELECT p_partkey, [CAST(b + a * r + r * r AS BIGINT), CAST(a + r AS BIGINT), 1] FROM m JOIN n USING (p_partkey) WHERE roots = 1
           UNION ALL SELECT p_partkey, [CAST(c AS BIGINT), CAST(b AS BIGINT), CAST(a AS BIGINT), 1] FROM p WHERE p_partkey NOT IN (SELECT p_partkey FROM n))
SELECT p_partkey, count(*) = 1 AS irreducible, string_agg(array_to_string(f, ','), ' | ' ORDER BY f) AS factors FROM f GROUP BY p_partkey
""")
def cubic_factors(spark, read):
    """Factors of a cubic for each part; those without a whole root are irreducible."""
    a, b, c = F.col("p_size") % 7 - 3, F.col("p_partkey") % 23 - 11, F.col("p_partkey") % 61 - 30
    rows = read("part").select("p_partkey", polynomials.monic_factors(F.array(*(x.cast("long") for x in (c, b, a, F.lit(1))))).alias("f"))
    return rows.select("p_partkey", (F.size("f") == 1).alias("irreducible"), _factor_text(F.col("f")).alias("factors"))


@query("""
WITH l AS (SELECT DISTINCT l_partkey % 9 - 4 AS p, 5 + l_suppkey % 20 AS q, l_linenumber % 5 - 2 AS r, 2 + CAST(l_quantity AS BIGINT) AS s FROM lineitem),
     k AS (SELECT *, CAST(p + r AS BIGINT) AS c3, CAST(q + s + p * r AS BIGINT) AS c2, CAST(p * s + q * r AS BIGINT) AS c1, CAST(q * s AS BIGINT) AS c0 FROM l WHERE p * p < 4 * q AND r * r < 4 * s)
SELECT DISTINCT c0, c1, c2, c3, array_to_string(least([q, p, 1], [s, r, 1]), ',') || ' | ' || array_to_string(greatest([q, p, 1], [s, r, 1]), ',') AS factors FROM k
""")
def quartic_factors(spark, read):
    """Products of two quadratics without real roots, expanded and factored again."""
    p, q, r, s = F.col("l_partkey") % 9 - 4, 5 + F.col("l_suppkey") % 20, (F.col("l_linenumber") % 5 - 2).cast("long"), 2 + F.col("l_quantity").cast("long")
    rows = read("lineitem").select(p.alias("p"), q.alias("q"), r.alias("r"), s.alias("s")).distinct().filter("p * p < 4 * q AND r * r < 4 * s")
    rows = rows.select(F.expr("q * s").alias("c0"), F.expr("p * s + q * r").alias("c1"), F.expr("q + s + p * r").alias("c2"), F.expr("p + r").alias("c3")).distinct()
    return rows.select("*", _factor_text(polynomials.monic_factors(F.array("c0", "c1", "c2", "c3", F.lit(1).cast("long")))).alias("factors"))


def _slices(weight) -> str:
    """SQL for a sum of weighted products of pairs of coordinates over slices of a vector."""
    cell = lambda i, j: "(" + " + ".join(f"{weight(k)} * CAST(embedding[{3 * k + i + 1}] AS DOUBLE) * CAST(embedding[{3 * k + j + 1}] AS DOUBLE)" for k in range(8)) + ")"
    return ", ".join(f"{cell(i, j)} AS m{i}{j}" for i in range(3) for j in range(i, 3))


_SQUARED = ", ".join(f"({' + '.join(f'm{min(i, k)}{max(i, k)} * m{min(k, j)}{max(k, j)}' for k in range(3))}) / pow(m00 + m11 + m22, 2)" for i in range(3) for j in range(i, 3))


@query(f"""
WITH RECURSIVE e AS (SELECT vec_id, 0 AS n, {_slices(lambda k: 0.5**k)} FROM embeddings UNION ALL SELECT vec_id, n + 1, {_SQUARED} FROM e WHERE n < 16)
SELECT vec_id, round(m00 / (m00 + m11 + m22), 5) AS xx, round(m01 / (m00 + m11 + m22), 5) AS xy, round(m22 / (m00 + m11 + m22), 5) AS zz FROM e WHERE n = 16
""")
def dominant_eigenvectors(spark, read):
    """The main direction of eight weighted slices of each vector, as products of its coordinates, which have no sign."""
    slices = F.array(*(F.array(*(F.col("embedding")[3 * k + i].cast("double") * 0.5 ** (k / 2) for i in range(3))) for k in range(8)))
    rows = read("embeddings").select("vec_id", spectra.dominant_eigenvector(slices, 3).alias("v"))
    product = lambda i, j: F.round(F.col("v")[i] * F.col("v")[j], 5)
    return rows.select("vec_id", product(0, 0).alias("xx"), product(0, 1).alias("xy"), product(2, 2).alias("zz"))


# ---- small things over tables


@query("SELECT p_partkey, printf('%.2f', p_partkey / 8.0 - 100) AS eighths, printf('%.2f', p_retailprice * CAST(1.005 AS DOUBLE)) AS price, printf('%.2f', p_partkey * CAST(0.005 AS DOUBLE)) AS halves FROM part WHERE p_partkey <> 800")
def two_decimal_ties(spark, read):
    """Ties and numbers that are printed like ties."""
    rows = read("part").filter("p_partkey <> 800")
    return rows.select("p_partkey", texts.two_decimals(F.col("p_partkey") / 8 - 100).alias("eighths"), texts.two_decimals(F.col("p_retailprice") * 1.005).alias("price"), texts.two_decimals(F.col("p_partkey") * 0.005).alias("halves"))


@query("""
WITH i AS (SELECT c_custkey AS idx, list_concat([20], [1 + c_custkey % 17], [18], [1 + c_custkey % 5], [21]) AS ids FROM customer)
SELECT 'train' AS split, idx, array_to_string(ids, ' ') AS ids FROM i UNION ALL SELECT 'test', idx, array_to_string(ids, ' ') FROM i WHERE idx < 20
""")
def configured_batches(spark, read):
    """Both splits by one configuration file that names the lexer's: JSON lines for training, the first twenty lines of text for the test."""
    folder = new_folder(spark, "configured")
    value = F.concat_ws(",", (F.col("c_custkey") % 17).cast("string"), (F.col("c_custkey") % 5).cast("string"))
    rows = read("customer").repartitionByRange(6, "c_custkey").sortWithinPartitions("c_custkey")
    sinks.record_lines(rows.select(nested.scalar(value).alias("problem"), nested.scalar(F.lit("1")).alias("answer"))).write.text(f"{folder}/train.jsonl")
    sinks.pair_lines(rows.select(nested.scalar(value).alias("problem"), nested.scalar(F.lit("1")).alias("answer"))).write.text(f"{folder}/test.txt")
    sinks.write_yaml({"vocab": {"range": {"n": ["", 0, 16]}, "misc": [","]}, "number_policy": {"attach_sign": False, "digit_group": 0, "allow_float": False}, "strict": True}, f"{folder}/lexer.yaml")
    sinks.write_yaml({"data": {"lexer_config": f"{folder}/lexer.yaml", "train_dataset_jsonl": f"{folder}/train.jsonl", "test_dataset_path": f"{folder}/test.txt", "num_test_samples": 20, "validate_train_tokens": True}}, f"{folder}/data.yaml")
    done = prepare.from_config(spark, f"{folder}/data.yaml")
    show = lambda name: getattr(done, name).select(F.lit(name).alias("split"), "idx", F.array_join(F.transform("input_ids_raw", lambda x: x.cast("string")), " ").alias("ids"))
    return show("train").unionByName(show("test"))


# ---- formats and streams


@query("SELECT kind, doc_id, md5(coalesce(text, '')) AS digest FROM documents, (SELECT unnest(['read', 'stream', 'file']) AS kind) WHERE kind <> 'file' OR doc_id < 500")
def pairs_format(spark, read):
    """Documents' ids and digests written as pair files, then read in short ranges of bytes, as a stream, and of a single file."""
    spark.dataSource.register(Pairs)
    folder = new_folder(spark, "pairs")
    rows = read("documents").select(F.col("doc_id").cast("string").alias("problem"), F.md5(F.coalesce("text", F.lit(""))).alias("answer"))
    new, old = rows.filter("doc_id >= 500").repartition(3), rows.filter("doc_id < 500").coalesce(1)
    for part in (old, new):
        part.write.format("pairs").mode("append").save(f"{folder}/in")
    done = spark.read.format("pairs").option("range_bytes", 1000).load(f"{folder}/in")
    first = done.agg(F.min("file")).first()[0]
    stream = spark.readStream.format("pairs").option("range_bytes", 5000).load(f"{folder}/in")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    own = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("problem").cast("long").alias("doc_id"), F.col("answer").alias("digest"))
    return own(done, "read").unionByName(own(spark.read.schema(done.schema).parquet(f"{folder}/out"), "stream")).unionByName(own(spark.read.format("pairs").load(first), "file"))


@query("SELECT user_id AS job_id, 'done' AS status, max(event_id) AS kernel_id FROM events WHERE user_id % 5 <> 0 GROUP BY user_id")
def job_log_stream(spark, read):
    """The job log followed as a stream over two runs, its files handed over newest first."""
    folder = new_folder(spark, "joblog")
    jobs = read("events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("kernel"))
    record = lambda df, status: df.select(F.col("id").cast("string").alias("job_id"), F.col("kernel").cast("string").alias("kernel_id"), F.lit(status).alias("status"))
    steps = [record(jobs, "queued"), record(jobs, "running"), record(jobs, "done"), record(jobs.filter("id % 5 = 0"), "deleted")]
    for k, df in enumerate(steps):
        sinks.append_jobs(df, f"{folder}/log{k}")
    table = BatchTable(spark, f"{folder}/table")
    for k in (3, 1, 2, 0):  # each run goes on from the state of the one before
        spark.read.text(f"{folder}/log{k}").write.mode("append").text(f"{folder}/log")
        joblog.follow(spark, f"{folder}/log", table.folder, f"{folder}/state", 2).awaitTermination()
    field = lambda name: F.get_json_object("record", f"$.{name}")
    return joblog.present(table).select(F.col("job_id").cast("long").alias("job_id"), field("status").alias("status"), field("kernel_id").cast("long").alias("kernel_id"))


@query("SELECT p_partkey AS idx, p_name AS problem, p_brand AS answer FROM part")
def zipped_files(spark, read):
    """Names and brands of parts in two sets of files of different sizes, put together line by line."""
    folder, rows = new_folder(spark, "zip"), read("part")
    for column, parts in (("p_name", 7), ("p_brand", 4)):
        rows.repartitionByRange(parts, "p_partkey").sortWithinPartitions("p_partkey").select(column).write.text(f"{folder}/{column}")
    return scans.zip_files(spark, f"{folder}/p_name", f"{folder}/p_brand")


@query("SELECT n_name AS problem, n_nationkey || ' ' || n_regionkey AS answer FROM nation")
def pickle_scan(spark, read):
    """Nations as a pickled list of pairs in the cluster's store, loaded by its suffix."""
    path = f"{new_folder(spark, 'pickle')}/nations.pkl"
    rows = [(r["n_name"], [str(r["n_nationkey"]), str(r["n_regionkey"])]) for r in read("nation").collect()]
    folders.write_bytes(spark, path, pickle.dumps(rows))
    return scans.load(spark, text=path)


@query("""
SELECT 'num_samples' AS name, count(*) :: DOUBLE AS value FROM part UNION ALL SELECT 'generation_time.max', max(p_retailprice) FROM part
UNION ALL SELECT 'size_stats.value.mean', round(avg(p_size), 6) FROM part UNION ALL SELECT 'size_stats.value.std', round(stddev_pop(p_size), 6) FROM part
""")
def statistics_file(spark, read):
    """The report of a run as a YAML file, read again and flattened."""
    path = f"{new_folder(spark, 'report')}/stats.yaml"
    rows = read("part").select(F.col("p_retailprice").alias("runtime"), F.create_map(F.lit("size"), F.create_map(F.lit("value"), F.col("p_size").cast("double"))).alias("stats"))
    sinks.write_yaml(metrics.report(rows, "runtime", "stats", 10.0), path)
    report = scans.read_config(path, spark)
    flat = {"num_samples": report["num_samples"], "generation_time.max": report["generation_time"]["max"], "size_stats.value.mean": round(report["size_stats"]["value"]["mean"], 6), "size_stats.value.std": round(report["size_stats"]["value"]["std"], 6)}
    return spark.createDataFrame([(k, float(v)) for k, v in flat.items()], "name string, value double")


@query("""
WITH t AS (SELECT 0 AS a, s_name AS token FROM supplier UNION ALL SELECT * FROM (VALUES (1, '[PAD]'), (2, '<s>'), (3, '</s>'), (4, '[CLS]')))
SELECT token, CAST(row_number() OVER (ORDER BY a, token) - 1 AS INTEGER) AS id, a > 0 AS is_special FROM t
""")
def vocabulary_file(spark, read):
    """Suppliers' names as a vocabulary, written as YAML and built again from the file."""
    path = f"{new_folder(spark, 'vocabulary')}/vocab.yaml"
    names = [r[0] for r in read("supplier").select("s_name").orderBy("s_name").collect()]
    sinks.write_yaml(Vocab.build(names, base_tokens=False).config(), path)
    return Vocab.from_config(scans.read_config(path, spark)).frame(spark)


@query("SELECT r_regionkey, r_regionkey % 2 = 0 AS written FROM region")
def empty_batches(spark, read):
    """Samples of nations by region, none for every other region: nothing is written for those."""
    folder, out = new_folder(spark, "regions"), []
    for (key,) in read("region").select("r_regionkey").collect():
        rows = read("nation").filter((F.col("n_regionkey") == key) & (F.col("n_regionkey") % 2 == 0))
        rows = rows.select(F.lit("train").alias("tag"), F.col("n_nationkey").alias("sample_index"), nested.scalar(F.col("n_name")).alias("problem"), nested.scalar(F.col("n_nationkey")).alias("answer"))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            sinks.write_samples(rows, f"{folder}/{key}", ("text",))
        out.append((key, folders.exists(spark, f"{folder}/{key}")))
    return spark.createDataFrame(out, "r_regionkey int, written boolean")


@query("SELECT 'train' AS split, c_custkey AS idx FROM customer WHERE c_custkey < 1000 UNION ALL SELECT 'test', c_custkey FROM customer WHERE c_custkey < 100")
def dry_run_rows(spark, read):
    """The rows of a dry run: the first 1000 and 100 of the files, which is the feature."""
    path = new_folder(spark, "lines")
    rows = read("customer").repartitionByRange(9, "c_custkey").sortWithinPartitions("c_custkey")
    rows.select(F.concat((F.col("c_custkey") % 17).cast("string"), F.lit(" # "), (F.col("c_custkey") % 5).cast("string"))).write.text(path)
    lexer = lex.Lexer.build(Vocab.build(range_tokens("", 0, 16)), lex.NumberPolicy(False, 0, False))
    done = prepare.prepare(spark, lexer, {"text": path}, {"text": path}, dry_run=True)
    return done.train.select(F.lit("train").alias("split"), "idx").unionByName(done.test.select(F.lit("test").alias("split"), "idx"))


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN 'test' ELSE 'train' END AS tag, c_custkey AS sample_index, c_custkey % 10 <> 0 AS counted FROM customer")
def skipped_statistics(spark, read):
    """Samples with statistics for training, without for the test."""
    keys, instance = task_keys(read("customer")), tasks.examples().get("gf17_addition")
    train = generate.for_keys(keys.filter("tag = 'train'"), instance, statistics=lambda p, a: {"problem": len(p)})
    rows = train.unionByName(generate.for_keys(keys.filter("tag = 'test'"), instance))
    return rows.select("tag", "sample_index", F.col("stats").isNotNull().alias("counted"))


@query("SELECT true AS same_ideal, true AS standard, true AS enough")
def basis_conversion_invariant(spark, read):
    """Groebner bases of customers' samples in another order of monomials: each basis reduces the other to zero, S-polynomials reduce to zero."""
    rows = generate.for_keys(task_keys(read("customer")), tasks.examples().get("polynomial_reduction")).select(nested.to_text(F.col("problem")).alias("problem"))

    def check(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for problem in pdf["problem"]:
                _, *basis = (algebra.parse(t, ["x", "y"]) for t in problem.split(" | "))
                other = algebra.groebner(basis, "lex")
                same = all(not algebra.divide(g, other, "lex")[1] for g in basis) and all(not algebra.divide(g, basis, "grevlex")[1] for g in other)
                out.append((same, algebra.groebner(other, "lex") == other))
            yield pd.DataFrame(out, columns=["same_ideal", "standard"])

    done = rows.mapInPandas(check, "same_ideal boolean, standard boolean")
    return done.agg(F.bool_and("same_ideal").alias("same_ideal"), F.bool_and("standard").alias("standard"), (F.count("*") * 5 > read("customer").count()).alias("enough"))


@query("SELECT o AS monomial_order, p AS pattern, true AS adds_up, true AS is_reduced, true AS enough FROM (VALUES ('grevlex', 1), ('grevlex', 2), ('lex', 1), ('lex', 2)) t(o, p)")
def reduction_load(spark, read):
    """Customers' samples as a pair file, loaded in two orders with and without quotients. Remainder and products give the polynomial,
    and no leading term of the basis divides a term of the remainder."""
    path = new_folder(spark, "reduction")
    rows = generate.for_keys(task_keys(read("customer")), tasks.examples().get("polynomial_reduction"))
    sinks.pair_lines(rows).write.text(path)

    def check(order: str, quotients: bool):
        def run(frames):
            import pandas as pd

            for pdf in frames:
                out = []
                for problem, answer in zip(pdf["problem"], pdf["answer"]):
                    f, *basis = (algebra.parse(t, ["x", "y"]) for t in problem.split(" | "))
                    *parts, rest = (algebra.parse(t, ["x", "y"]) for t in answer.split(" | "))
                    total = rest
                    for q, g in zip(parts, basis):
                        total = algebra.plus(total, algebra.times(q, g))
                    heads = [algebra.lead(g, algebra.ORDERS[order]) for g in basis]
                    same = total == f if quotients else not algebra.divide(algebra.plus(f, rest, -1), basis, order)[1]
                    out.append((same and len(parts) == len(basis) * quotients, not any(algebra.divides(h, e) for h in heads for e in rest)))
                yield pd.DataFrame(out, columns=["adds_up", "is_reduced"])

        return run

    out = None
    for order in ("grevlex", "lex"):
        for pattern in (1, 2):
            done = scans.load(spark, text=path, step=reduction_step(["x", "y"], order, pattern == 2)).mapInPandas(check(order, pattern == 2), "adds_up boolean, is_reduced boolean")
            one = done.agg(F.lit(order).alias("monomial_order"), F.lit(pattern).alias("pattern"), F.bool_and("adds_up").alias("adds_up"), F.bool_and("is_reduced").alias("is_reduced"), (F.count("*") * 5 > read("customer").count()).alias("enough"))
            out = one if out is None else out.unionByName(one)
    return out
