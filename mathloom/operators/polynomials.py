"""Polynomials as relations: one row per term with an id, exponents (ARRAY<INT>) and a coefficient.

Sums are aggregations, products and comparisons are joins on the id; no row has coefficient 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import let

COEFF = "decimal(38,0)"
#: Numbers of a block of the sieve.
SIEVE_BLOCK = 1 << 14
#: A block of numbers up to it needs the primes up to a million.
LARGEST_NUMBER = 10**12


def normalise(terms: DataFrame, key: str = "poly_id", modulus: int | None = None) -> DataFrame:
    """Like terms added up, zero terms dropped; coefficients from 0 to modulus - 1 in a prime field."""
    total = F.sum("coeff")
    rows = terms.groupBy(key, "exps").agg((F.pmod(total, F.lit(modulus)) if modulus else total).alias("coeff"))
    return rows.filter("coeff <> 0")


def add(*polys: DataFrame, key: str = "poly_id", modulus: int | None = None) -> DataFrame:
    out = polys[0].select(key, "exps", "coeff")
    for p in polys[1:]:
        out = out.unionByName(p.select(key, "exps", "coeff"))
    return normalise(out, key, modulus)


def negate(terms: DataFrame) -> DataFrame:
    return terms.withColumn("coeff", -F.col("coeff"))


def multiply(left: DataFrame, right: DataFrame, key: str = "poly_id", modulus: int | None = None) -> DataFrame:
    """Products of polynomials with equal ids."""
    a = left.select(key, F.col("exps").alias("exps_a"), F.col("coeff").alias("coeff_a"))
    b = right.select(key, F.col("exps").alias("exps_b"), F.col("coeff").alias("coeff_b"))
    exps = F.zip_with("exps_a", "exps_b", lambda x, y: x + y)
    return normalise(a.join(b, key).select(key, exps.alias("exps"), (F.col("coeff_a") * F.col("coeff_b")).alias("coeff")), key, modulus)


def product(polys: DataFrame, key: str, position: str, longest: int, modulus: int | None = None) -> DataFrame:
    """Product over the positions 1 to `longest` of each key."""
    out = polys.filter(F.col(position) == 1).select(key, "exps", "coeff")
    for k in range(2, longest + 1):
        own = polys.filter(F.col(position) == k).select(key, "exps", "coeff")
        short = out.join(own.select(key).distinct(), key, "left_anti")
        out = multiply(out, own, key, modulus).unionByName(short)
    return normalise(out, key, modulus)


def prefix_sums(polys: DataFrame, key: str, position: str, modulus: int | None = None, places: DataFrame | None = None) -> DataFrame:
    """For each position the sum of all polynomials up to it; `places` has the (key, position) of polynomials, those of polys without it.

    Coefficients are added up along the positions where their exponents occur, and each holds from there until before the next. A
    position has a rank within its key, so a sum is written out for exactly the ranks where it holds.
    """
    own = polys.groupBy(key, position, "exps").agg(F.sum("coeff").alias("coeff"))
    places = (places if places is not None else own.select(key, position)).distinct()
    ranks = places.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(position)))
    ranks = ranks.withColumn("_last", F.max("_rank").over(Window.partitionBy(key)))
    by_terms = Window.partitionBy(key, "exps").orderBy("_rank")
    running = own.join(ranks, [key, position]).withColumns({"coeff": F.sum("coeff").over(by_terms), "_until": F.lead("_rank").over(by_terms) - 1})
    coeff = F.pmod("coeff", F.lit(modulus)) if modulus else F.col("coeff")
    held = running.withColumn("coeff", coeff).filter("coeff <> 0")
    held = held.select(key, "exps", "coeff", F.explode(F.sequence("_rank", F.coalesce("_until", "_last"))).alias("_rank"))
    return held.join(ranks.select(key, position, "_rank"), [key, "_rank"]).select(key, position, "exps", "coeff")


def degree(terms: DataFrame, key: str = "poly_id") -> DataFrame:
    """Total degree and number of terms of polynomials that have any."""
    own = F.aggregate("exps", F.lit(0), lambda s, e: s + e)
    return terms.groupBy(key).agg(F.max(own).alias("degree"), F.count("*").alias("n_terms"))


def packed_degree(terms: Column) -> Column:
    """Total degree of packed terms, 0 for the zero polynomial."""
    return F.coalesce(F.array_max(F.transform(terms, lambda t: F.aggregate(t["exps"], F.lit(0), lambda s, e: s + e))), F.lit(0))


def max_coefficient(terms: DataFrame, key: str = "poly_id") -> DataFrame:
    """Largest absolute coefficient; of fractions (num, den) the larger of both parts."""
    size = F.greatest(F.abs("num"), F.abs("den")) if {"num", "den"} <= set(terms.columns) else F.abs("coeff")
    return terms.groupBy(key).agg(F.max(size).alias("max_coeff"))


def descending(exps: Column, order: str = "lex") -> Column:
    """A key by which an ascending sort lists terms from the largest: lex, grlex, or grevlex."""
    down = F.transform(exps, lambda e: -e)
    total = F.aggregate(exps, F.lit(0), lambda s, e: s + e)
    keys = {"lex": lambda: down, "grlex": lambda: F.concat(F.array(-total), down), "grevlex": lambda: F.concat(F.array(-total), F.reverse(exps))}
    names = {"degrevlex": "grevlex", "deglex": "grlex"}
    return keys[names.get(order, order)]()


def pack(terms: DataFrame, key: str = "poly_id", order: str = "lex") -> DataFrame:
    """One row per polynomial with its terms in descending order."""
    item = F.struct(descending(F.col("exps"), order).alias("_by"), F.col("exps"), F.col("coeff"))
    rows = terms.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("terms"))
    return rows.withColumn("terms", F.transform("terms", lambda t: F.struct(t["exps"].alias("exps"), t["coeff"].alias("coeff"))))


def unpack(polys: DataFrame, key: str = "poly_id") -> DataFrame:
    return polys.select(key, F.explode("terms").alias("_t")).select(key, F.col("_t.exps").alias("exps"), F.col("_t.coeff").alias("coeff"))


def parse_ce(text: Column) -> Column:
    """Packed terms of `C3 E1 E0 + C-2 E0 E2`. Terms without coefficient or with other numbers of exponents are errors."""
    parts = F.filter(F.transform(F.split(text, r"\+"), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda x: F.regexp_extract(x, r"^C(-?\d+)(?: E\d+)*$", 1)
    coeff = lambda x: let(number(x), lambda n: F.when(n == "", F.raise_error(F.concat(F.lit("not a term: "), x))).otherwise(n).cast(COEFF))
    term = lambda x: F.struct(F.transform(F.regexp_extract_all(x, F.lit(r"E(\d+)"), F.lit(1)), lambda e: e.cast("int")).alias("exps"), coeff(x).alias("coeff"))
    sizes = lambda terms: F.array_distinct(F.transform(terms, lambda t: F.size(t["exps"])))
    checked = lambda terms: F.when(F.size(sizes(terms)) > 1, F.raise_error(F.lit("terms have different numbers of exponents"))).otherwise(terms)
    return let(F.filter(F.transform(parts, term), lambda t: t["coeff"] != 0), checked)


def parse_expanded(text: Column, variables: list[str]) -> Column:
    """Packed terms (coefficients as decimals or fractions in text) of a sum of monomials such as `-2/5*x^2*y + 3*x - 1`."""
    compact = F.regexp_replace(F.replace(text, F.lit("**"), F.lit("^")), r"\s+", "")
    parts = F.regexp_extract_all(compact, F.lit(r"[+-]?[^+-]+"), F.lit(0))
    power = lambda x, v: F.aggregate(F.regexp_extract_all(x, F.lit(rf"(?<![A-Za-z0-9_]){v}(?![A-Za-z0-9_])(\^?\d*)"), F.lit(1)), F.lit(0), lambda s, e: s + F.when(e == "", 1).otherwise(F.replace(e, F.lit("^"), F.lit("")).cast("int")))
    number = lambda x: F.regexp_extract(x, r"^[+-]?(\d+(?:/\d+)?)", 1)
    sign = lambda x: F.when(x.startswith("-"), "-").otherwise("")
    term = lambda x: F.struct(F.array(*(power(x, v) for v in variables)).alias("exps"), F.concat(sign(x), F.when(number(x) == "", "1").otherwise(number(x))).alias("coeff"))
    return F.filter(F.transform(parts, term), lambda t: ~t["coeff"].isin("0", "-0"))


def to_text(terms: Column, variables: list[str]) -> Column:
    """Expanded form of packed terms with integral coefficients, in their order."""
    power = lambda e, v: F.when(e == 1, v).when(e > 1, F.concat(F.lit(f"{v}^"), e.cast("string")))
    monomial = lambda t: F.array_join(F.array_compact(F.array(*(power(t["exps"][i], v) for i, v in enumerate(variables)))), "*")
    size = lambda t: F.abs(t["coeff"]).cast("string")
    body = lambda t: F.when(monomial(t) == "", size(t)).when(F.abs(t["coeff"]) == 1, monomial(t)).otherwise(F.concat(size(t), F.lit("*"), monomial(t)))
    signed = lambda t, i: F.concat(F.when(i == 0, F.when(t["coeff"] < 0, "-").otherwise("")).otherwise(F.when(t["coeff"] < 0, " - ").otherwise(" + ")), body(t))
    return F.when(F.size(terms) == 0, "0").otherwise(F.array_join(F.transform(terms, signed), ""))


def compare(gold: DataFrame, predicted: DataFrame, key: str = "poly_id") -> DataFrame:
    """Terms of either polynomial with a state: equal, coeff_wrong, extra (predicted only) or missing (gold only)."""
    a = gold.select(key, "exps", F.col("coeff").alias("gold"))
    b = predicted.select(key, "exps", F.col("coeff").alias("predicted"))
    state = F.when(F.col("gold").isNull(), "extra").when(F.col("predicted").isNull(), "missing").when(F.col("gold") == F.col("predicted"), "equal").otherwise("coeff_wrong")
    return a.join(b, [key, "exps"], "full").withColumn("state", state)


def latex(terms: DataFrame, variables: list[str], key: str = "poly_id") -> DataFrame:
    """LaTeX of each polynomial, exponents descending; terms whose `struck` is true are crossed out."""
    exp = lambda i: F.col("exps")[i]
    factors = [F.when(exp(i) == 1, v).when(exp(i) > 1, F.concat(F.lit(v + "^{"), exp(i).cast("string"), F.lit("}"))) for i, v in enumerate(variables)]
    monomial = F.array_join(F.array_compact(F.array(*factors)), " ")
    size = F.abs("coeff").cast("string")
    body = F.when(monomial == "", size).when(F.abs("coeff") == 1, monomial).otherwise(F.concat(size, F.lit(" "), monomial))
    struck = F.col("struck") if "struck" in terms.columns else F.lit(False)
    body = F.when(struck, F.concat(F.lit(r"\cancel{"), body, F.lit("}"))).otherwise(body)
    item = F.struct(F.transform("exps", lambda e: -e).alias("by"), (F.col("coeff") < 0).alias("minus"), body.alias("body"))
    rows = terms.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    piece = lambda t, i: F.concat(F.when(i == 0, F.when(t["minus"], "-").otherwise("")).otherwise(F.when(t["minus"], " - ").otherwise(" + ")), t["body"])
    return rows.select(key, F.array_join(F.transform("items", piece), "").alias("latex"))


def running_sum(x: Column, key: str, order: str, modulus: int) -> Column:
    """Sum up to each row, in a prime field."""
    total = F.sum(x).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return F.pmod(total, F.lit(modulus))


def unimodular(grid: DataFrame, value: Column) -> DataFrame:
    """Matrices (i, j) with ones on the diagonal, zeros below it and the value above."""
    return grid.withColumn("value", F.when(F.col("i") == F.col("j"), 1).when(F.col("i") > F.col("j"), 0).otherwise(value))


def matrix_product(left: DataFrame, right: DataFrame, key: str = "mat_id") -> DataFrame:
    """(key, i, j, value) matrices multiplied by a join on the inner index."""
    a = left.select(key, "i", F.col("j").alias("k"), F.col("value").alias("x"))
    b = right.select(key, F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return a.join(b, [key, "k"]).groupBy(key, "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def primes_below(spark, n: int) -> DataFrame:
    """Sieve: numbers that no product of two numbers equals; products are written out in pieces of SIEVE_BLOCK."""
    div = lambda x, y: F.call_function("div", x, y)
    numbers = spark.range(2, n).withColumnRenamed("id", "prime")
    a, last, block = F.col("a"), div(F.lit(n).cast("long"), F.col("a")), F.lit(SIEVE_BLOCK).cast("long")
    pieces = spark.range(2, math.isqrt(n) + 1).withColumnRenamed("id", "a").select("a", F.explode(F.sequence(div(a, block), div(last, block))).alias("piece"))
    factors = F.explode(F.sequence(F.greatest(a, F.col("piece") * block), F.least(last, F.col("piece") * block + block - 1)))
    multiples = pieces.select("a", factors.alias("b")).select(F.expr("a * b").alias("prime"))
    return numbers.join(multiples, "prime", "left_anti")


def prime_divisors(numbers: DataFrame, column: str) -> DataFrame:
    """(column, primes): all primes up to its root that divide a number, and perhaps larger ones; numbers without one are left out.

    A segmented sieve: within each block that holds a number the multiples of every prime are written out and joined. Primes are joined to
    blocks by stretches of SIEVE_BLOCK numbers, of which a block needs those up to the root of its end. Numbers above LARGEST_NUMBER are
    an error.
    """
    own = numbers.select(column).filter(F.col(column) > 1).distinct()
    largest = own.agg(F.max(column)).first()[0] or 1
    if largest > LARGEST_NUMBER:
        raise ValueError(f"numbers above {LARGEST_NUMBER} aren't factored")
    primes = primes_below(numbers.sparkSession, math.isqrt(largest) + 1).withColumn("stretch", F.floor(F.col("prime") / SIEVE_BLOCK))
    blocks = own.select(F.floor(F.col(column) / SIEVE_BLOCK).cast("long").alias("block")).distinct()
    low, high = F.col("block") * SIEVE_BLOCK, (F.col("block") + 1) * SIEVE_BLOCK - 1
    needed = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.sqrt(high.cast("double")) / SIEVE_BLOCK))).alias("stretch"))
    steps = F.sequence(F.floor((low + F.col("prime") - 1) / F.col("prime")), F.floor(high / F.col("prime")))
    pairs = needed.join(primes, "stretch").filter(F.floor(high / F.col("prime")) * F.col("prime") >= low)
    multiples = pairs.select("prime", F.explode(steps).alias("step")).select("prime", (F.col("prime") * F.col("step")).alias(column))
    return own.join(multiples, column).groupBy(column).agg(F.array_sort(F.collect_set("prime")).alias("primes"))


def prime_factors(n: Column, primes: list[int] | Column) -> Column:
    """Sorted prime factors with multiplicity, by trial division; what is left over at the end is a factor if above 1.

    That is a prime if the primes hold all divisors up to the root of n.
    """
    start = F.struct(n.cast("long").alias("left"), F.array().cast("array<long>").alias("found"))

    def divide(s: Column, p: Column) -> Column:
        # p as often as it divides: at most the number of bits of what is left, in whole numbers
        times = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(s["left"].cast("double"))).cast("int") + 1))
        once = lambda r, _: F.when(F.pmod(r["left"], p) == 0, F.struct(F.call_function("div", r["left"], p).alias("left"), F.concat(r["found"], F.array(p)).alias("found"))).otherwise(r)
        return F.aggregate(times, s, once)

    known = (primes if isinstance(primes, Column) else F.array(*map(F.lit, primes))).cast("array<long>")
    end = F.aggregate(known, start, divide)
    return F.when(end["left"] > 1, F.concat(end["found"], F.array(end["left"]))).otherwise(end["found"])


def quadratic_factors(a: Column, b: Column, c: Column) -> Column:
    """Irreducible factors over the rationals of a x^2 + b x + c (whole numbers without a common divisor, a > 0), as (p, q, r) for
    p x^2 + q x + r: two linear ones if the discriminant is a square, else itself. Whole numbers below 2^26 or so, exact."""
    a, b, c = (x.cast("long") for x in (a, b, c))
    d = b * b - 4 * a * c
    root = F.round(F.sqrt(F.greatest(d, F.lit(0)).cast("double"))).cast("long")

    def linear(sign: int) -> Column:
        # 2 a x + b - root, without the common divisor
        rest = b - sign * root
        common = gcd(2 * a, rest)
        return F.struct(F.lit(0).cast("long").alias("p"), F.call_function("div", 2 * a, common).alias("q"), F.call_function("div", rest, common).alias("r"))

    whole = F.array(F.struct(a.alias("p"), b.alias("q"), c.alias("r")))
    return F.when((d >= 0) & (root * root == d), F.array(linear(1), linear(-1))).otherwise(whole)


def divisors(n: Column) -> Column:
    """Divisors of a number other than 0, positive ones and negative ones; as many steps as its root."""
    size = F.abs(n.cast("long"))
    low = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.sqrt(size.cast("double"))).cast("long"))), lambda d: F.pmod(size, d) == 0)
    return let(low, lambda ds: let(F.array_distinct(F.concat(ds, F.transform(ds, lambda d: F.call_function("div", size, d)))), lambda all_: F.concat(all_, F.transform(all_, lambda d: -d))))


def monic_factors(coefficients: Column) -> Column:
    """Irreducible factors over the whole numbers of a monic polynomial of degree 1 to 4, sorted, each as coefficients from the constant on.

    Roots are divisors of the constant; each is divided out as often as it goes. What has degree 2 or 3 and no root is irreducible. A rest of degree 4
    is a product of two quadratics x^2 + p x + q and x^2 + r x + s if for some divisor q of its constant p and r are whole.
    """
    long, div = (lambda x: F.lit(x).cast("long")), (lambda a, b: F.call_function("div", a, b))
    value = lambda c, r: F.aggregate(F.reverse(c), long(0), lambda s, a: s * r + a)
    # from the leading coefficient down: each is the one before times the root, plus the polynomial's own
    quotient = lambda c, r: F.reverse(F.slice(F.aggregate(F.reverse(c), F.array().cast("array<long>"), lambda s, a: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), long(0)) * r + a))), F.lit(1), F.size(c) - 1))
    roots = lambda c: F.when(F.get(c, F.lit(0)) == 0, F.array(long(0))).otherwise(F.filter(divisors(F.get(c, F.lit(0))), lambda r: value(c, r) == 0))
    state = lambda c, found: F.struct(c.alias("c"), found.alias("found"))

    def divide(s: Column, _: Column) -> Column:
        take = lambda r: F.when(r.isNull(), s).otherwise(state(quotient(s["c"], r), F.concat(s["found"], F.array(F.array(-r, long(1))))))
        return F.when(F.size(s["c"]) == 1, s).otherwise(let(F.get(F.array_sort(roots(s["c"])), F.lit(0)), take))

    def quadratics(c: Column) -> Column:
        """Two quadratic factors of x^4 + a x^3 + b x^2 + d x + e without roots, or itself."""
        e, d, b, a = (F.get(c, F.lit(i)) for i in range(4))

        def linear(q: Column) -> Column:
            # p + r = a, q + s = b - p r, p s + q r = d
            s = div(e, q)
            square = a * a - 4 * (b - 2 * q)
            root = F.round(F.sqrt(F.greatest(square, long(0)).cast("double"))).cast("long")
            p = F.when(s != q, F.when(F.pmod(d - a * q, F.abs(s - q)) == 0, div(d - a * q, s - q))).when((square >= 0) & (root * root == square) & (F.pmod(a + root, long(2)) == 0), div(a + root, long(2)))
            return let(p, lambda p: F.when((q + s + p * (a - p) == b) & (p * s + q * (a - p) == d), F.array(F.array(q, p, long(1)), F.array(s, a - p, long(1)))))

        found = F.filter(F.transform(divisors(e), linear), lambda x: x.isNotNull())
        return F.coalesce(F.get(found, F.lit(0)), F.array(c))

    def rest(s: Column) -> Column:
        last = F.when(F.size(s["c"]) == 1, F.array().cast("array<array<long>>")).when(F.size(s["c"]) == 5, quadratics(s["c"])).otherwise(F.array(s["c"]))
        return F.array_sort(F.concat(s["found"], last))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(4)), state(coefficients.cast("array<long>"), F.array().cast("array<array<long>>")), divide), rest)


def gcd(x: Column, y: Column) -> Column:
    """Greatest common divisor of longs by Euclid's algorithm: no more steps than the smaller number's Fibonacci rank and a few, and steps after
    the last change nothing."""
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], s["y"]).alias("y")))
    steps = lambda s: F.sequence(F.lit(1), F.floor(F.log2(F.least(s["x"], s["y"]).cast("double") + 1) * 1.45).cast("int") + 4)
    return let(F.struct(F.abs(x).alias("x"), F.abs(y).alias("y")), lambda s: F.aggregate(steps(s), s, step)["x"])


def monomial_counts(variables: int | Column, degree: int | Column) -> Column:
    """Numbers of monomials of each degree from 0 to `degree`: binomials (variables + d - 1 over d)."""
    variables, degree = (x if isinstance(x, Column) else F.lit(x) for x in (variables, degree))
    one = lambda d: F.aggregate(F.when(d > 0, F.sequence(F.lit(1), d)).otherwise(F.array().cast("array<int>")), F.lit(1).cast("long"), lambda s, k: F.call_function("div", s * (variables - 1 + k), k))
    return F.transform(F.sequence(F.lit(0), degree), one)


def exponent_vectors(rows: DataFrame, variables: int, degree: int | Column) -> DataFrame:
    """The rows with each exponent vector (exps) of their total degree."""
    out, names = rows.withColumns({"exps": F.array().cast("array<int>"), "_left": (degree if isinstance(degree, Column) else F.lit(degree)).cast("int")}), rows.columns
    for _ in range(variables - 1):
        out = out.withColumn("_e", F.explode(F.sequence(F.lit(0), F.col("_left")))).select(*names, F.concat("exps", F.array("_e")).alias("exps"), (F.col("_left") - F.col("_e")).alias("_left"))
    return out.select(*names, F.concat("exps", F.array("_left")).alias("exps"))
