"""The library's operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexer as lex
from ..functions import loadprep, nested, text
from ..functions.vocab import Vocab, decode, encode, encode_by_join, range_tokens
from ..operators import collate, metrics, polynomials, tensors, validate
from ..sources import scans
from ..sources.folders import new_folder
from . import generate, tasks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, read) as a query; read(name) is a table."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def as_double(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# ---- scans and texts


@query(r"""
SELECT doc_id, regexp_replace(substr(text, 1, instr(text, '#') - 1), '^\s+|\s+$', '', 'g') AS problem,
       regexp_replace(substr(text, instr(text, '#') + 1), '^\s+|\s+$', '', 'g') AS answer
FROM documents WHERE instr(text, '#') > 0
""")
def text_pair_split(spark, read):
    return scans.split_pairs(read("documents"), "text").select("doc_id", "problem", "answer")


@query("""
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, event_type AS problem, CASE WHEN k % 3 <> 0 THEN CAST(k % 3 AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS answer
FROM e WHERE k % 3 <> 0 OR k % 2 = 0
""")
def answer_alias(spark, read):
    """JSON lines whose answer is 0 for every third row fall back to `solution`, which odd rows lack."""
    k = F.get_json_object("props", "$.k").cast("long")
    line = F.to_json(F.struct(F.col("event_type").alias("problem"), (k % 3).alias("answer"), F.when(k % 2 == 0, k).alias("solution")))
    folder = new_folder(spark, "records")  # written, as conditions on records would be pushed below an exchange, to the task of a small file
    scans.spread(read("events").select("event_id", line.alias("value")), "event_id").write.parquet(folder)
    rows = scans.parse_records(spark.read.parquet(folder))
    return rows.select("event_id", nested.to_words(F.col("problem")).alias("problem"), nested.to_words(F.col("answer")).alias("answer"))


@query("""
WITH o AS (SELECT o_custkey, o_orderstatus, string_agg(CAST(o_orderkey AS VARCHAR), ' | ' ORDER BY o_orderkey) AS row_text,
                  '[' || string_agg('"' || o_orderkey || '"', ',' ORDER BY o_orderkey) || ']' AS row_json
           FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(row_text, ' || ' ORDER BY o_orderstatus) AS joined,
       '[' || string_agg(row_json, ',' ORDER BY o_orderstatus) || ']' AS as_json
FROM o GROUP BY o_custkey
""")
def nested_join(spark, read):
    """Each customer's orders by status as a list of lists, as text and as JSON."""
    rows = read("orders").groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    lists = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "keys"))).alias("rows"))
    value = nested.nested(F.col("rows.keys"))
    return lists.select("o_custkey", nested.to_text(value).alias("joined"), nested.to_json(value).alias("as_json"))


@query("""
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' | ' ORDER BY l_partkey) AS joined,
       string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_partkey) AS words
FROM lineitem GROUP BY l_orderkey
""")
def flat_join(spark, read):
    rows = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("keys"))
    value = nested.flat(F.col("keys"))
    return rows.select("l_orderkey", nested.to_text(value).alias("joined"), nested.to_words(value).alias("words"))


@query("SELECT p_partkey, 'x^' || p_size || ' + ' || p_partkey AS poly FROM part")
def poly_text_norm(spark, read):
    raw = F.concat(F.lit("x**"), F.col("p_size"), F.lit(" + "), F.col("p_partkey"), F.lit(" mod "), (F.col("p_partkey") % 97).cast("string"))
    return read("part").select("p_partkey", nested.polynomial_text(raw).alias("poly"))


def _event_lists(read) -> DataFrame:
    item = F.struct("event_id", F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("t"))
    return read("events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("e")).select("user_id", F.array_join(F.col("e.t"), "|").alias("value"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id")
def last_element(spark, read):
    """Only the last piece of a user's list is made: it is all that the operator needs."""
    last = F.max_by("event_type", F.when(F.col("event_type").isNotNull(), F.col("event_id")))
    return read("events").groupBy("user_id").agg(last.alias("value")).select("user_id", loadprep.last_element(F.concat(F.lit(" "), "value", F.lit(" "))).alias("last"))


@query("SELECT user_id, string_agg(event_type, ' | ' ORDER BY event_id DESC) AS reversed FROM events GROUP BY user_id")
def reversed_order(spark, read):
    return _event_lists(read).select("user_id", loadprep.reversed_order(F.col("value")).alias("reversed"))


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
replace(split_part(url, '/', -1), '-', ' ') AS title FROM pages""")
def slugify(spark, read):
    return read("pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.title_of_id(F.col("url")).alias("title"))


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'running'
       WHEN 'view' THEN 'cancelled' ELSE 'unknown' END AS status FROM events
""")
def status_class(spark, read):
    said = F.create_map(*map(F.lit, ("error", "Kernel ERROR while running", "purchase", "COMPLETE, no error", "click", "still Running, queued before", "view", "Cancelled", "signup", "?")))
    return read("events").select("event_id", text.state(said[F.col("event_type")]).alias("status"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS shown FROM documents")
def display_truncation(spark, read):
    return read("documents").select("doc_id", text.shorten(F.col("text")).alias("shown"))


@query("""
SELECT user_id, arg_max(event_id, event_id) AS last_event, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id
""")
def job_latest(spark, read):
    """The events as a job log: the last record of each user."""
    log = read("events").select(F.parse_json(F.to_json(F.struct(F.col("user_id").cast("string").alias("job_id"), "event_id", F.col("event_type").alias("status")))).alias("record"), F.col("event_id").alias("_line"))
    record = F.parse_json("record")
    return scans.latest_jobs(log).select(F.col("job_id").cast("long").alias("user_id"), F.variant_get(record, "$.event_id", "long").alias("last_event"), F.variant_get(record, "$.status", "string").alias("status"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def last_n(spark, read):
    """The newest records: the limit is the operator."""
    return scans.last_jobs(read("events").select("event_id", "event_type", F.col("event_id").alias("_line")), 25)


# ---- lexer and vocabulary

_NAMES = range_tokens("x", 0, 2) + ["+", "*", "^", "(", ")", "|", "-", "/", "=", ","]
_VOCAB = Vocab.build(_NAMES, {"unk_token": "<unk>"})
_RESERVED = {g: lex.Lexer.build(_VOCAB, lex.NumberPolicy(False, g, g == 0), strict=False) for g in (0, 2)}


def _sql_tokens(lexer: lex.Lexer, column: str, source: str, keys: str) -> str:
    """SQL of a lexer that separates signs (RE2 has no lookbehind for the other kind)."""
    g, quote = lexer.policy.digit_group, lambda s: s.replace("'", "''")
    reserved = ", ".join(f"'{quote(t)}'" for t in lexer.reserved)
    number = f"regexp_full_match(w, '{lexer.policy.pattern}')" + ("" if lexer.numbers_first else f" AND w NOT IN ({reserved})")
    split = (lambda part: f"regexp_extract_all({part}, '\\d{{1,{g}}}')") if g else (lambda part: f"[{part}]")
    parts = f"CASE WHEN contains(w, '.') THEN list_concat({split('''coalesce(nullif(split_part(w, '.', 1), ''), '0')''')}, ['.'], {split('''split_part(w, '.', 2)''')}) ELSE {split('w')} END"
    return f"""
SELECT {keys}, flatten(list_transform(list_filter(regexp_extract_all({column}, '{quote(lexer.pattern)}'), lambda w: NOT regexp_full_match(w, '\\s+')),
  lambda w: CASE WHEN {number} THEN {parts} WHEN length(w) = 1 AND w NOT IN ({reserved}) AND NOT regexp_full_match(w, '[A-Za-z_]') THEN ['<unk>'] ELSE [w] END)) AS tokens
FROM {source}"""


def _lexed(read, g: int) -> DataFrame:
    tokens = _RESERVED[g].tokens(F.col("text"))
    rows = read("documents").select("doc_id", tokens.alias("tokens"))
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("tokens", lambda t: t == "<unk>")).cast("long").alias("n_unknown"), digest(F.array_join("tokens", " ")).alias("token_sha"))


def _lexed_sql(g: int) -> str:
    return f"""WITH t AS ({_sql_tokens(_RESERVED[g], 'text', 'documents', 'doc_id')})
SELECT doc_id, len(tokens) AS n_tokens, len(list_filter(tokens, lambda t: t = '<unk>')) AS n_unknown, sha256(array_to_string(tokens, ' ')) AS token_sha FROM t"""


@query(_lexed_sql(0))
def lex_separate_g0(spark, read):
    return _lexed(read, 0)


@query(_lexed_sql(2))
def lex_separate_g2(spark, read):
    return _lexed(read, 2)


_ATTACH = lex.Lexer.build(Vocab.build(range_tokens("", -16, 16) + [",", "|", "#"]), lex.NumberPolicy(True, 0, False))


@query("""
SELECT user_id, string_agg(CAST(CAST(value AS BIGINT) - 50 AS VARCHAR), ' , ' ORDER BY event_id) AS token_text, 2 * count(*) - 1 AS n_tokens
FROM events GROUP BY user_id
""")
def lex_attach(spark, read):
    """Signed numbers with their signs attached, in strict mode."""
    item = F.struct("event_id", (F.bround(F.col("value"), 0).cast("long") - 50).cast("string").alias("v"))
    rows = read("events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("e")).select("user_id", F.array_join(F.col("e.v"), ",").alias("t"))
    return rows.select("user_id", _ATTACH.text(F.col("t")).alias("token_text"), F.size(_ATTACH.tokens(F.col("t"))).cast("long").alias("n_tokens"))


@query("""
WITH b AS (SELECT max(p_size) AS c, max(p_partkey) // 100 AS e FROM part), c AS (SELECT unnest(range(-c, c + 1)) AS i FROM b), e AS (SELECT unnest(range(0, e + 1)) AS i FROM b),
     v AS (SELECT 0 AS a, 0 AS i, '[SEP]' AS token UNION ALL SELECT 1, i, 'C' || i FROM c UNION ALL SELECT 2, i, 'E' || i FROM e
           UNION ALL SELECT 3, i, 'x' || i FROM range(0, 3) t(i) UNION ALL SELECT 4, 0, '+' UNION ALL SELECT 5, i, m FROM (VALUES (0, '[PAD]'), (1, '<s>'), (2, '</s>'), (3, '[CLS]')) t(i, m))
SELECT token, CAST(row_number() OVER (ORDER BY a, i) - 1 AS INTEGER) AS id, a = 5 AS is_special FROM v
""")
def vocab_range(spark, read):
    """Ranges as wide as the sizes of parts, and as a hundredth of their number."""
    c, e = read("part").agg(F.max("p_size"), F.expr("max(p_partkey) div 100")).first()
    return Vocab.from_config({"range": {"c": ["C", -c, c], "e": ["E", 0, e], "v": ["x", 0, 2], "ignored": [1]}, "misc": ["+"]}).frame(spark)


_KNOWN = Vocab.build(range_tokens("", 0, 99) + ["the", "of", "and", "de", "+", "-", "*", "|", "#", "<unk>"])
_KNOWN_LEXER = lex.Lexer(_KNOWN, lex.NumberPolicy(False, 0, False), strict=False)
_KNOWN_IDS = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in _KNOWN.ids) + "]"


@query(f"""
WITH t AS ({_sql_tokens(_KNOWN_LEXER, 'text', 'conversations', 'conv_id')})
SELECT DISTINCT token FROM (SELECT unnest(tokens) AS token FROM t) WHERE NOT list_contains({_KNOWN_IDS}, token)
""")
def oov_tokens(spark, read):
    rows = read("conversations").select(_KNOWN_LEXER.tokens(F.col("text")).alias("tokens"))
    return validate.unknown_tokens(rows, "tokens", _KNOWN)


_IDS_SQL = f"""
WITH t AS ({_sql_tokens(_KNOWN_LEXER, 'text', 'conversations', 'conv_id, turn')}),
     i AS (SELECT conv_id, turn, list_concat([{_KNOWN.special_id('bos_token')}], list_transform(tokens, lambda t: coalesce(list_position({_KNOWN_IDS}, t) - 1, {_KNOWN.ids['<unk>']})), [{_KNOWN.special_id('eos_token')}]) AS ids FROM t)
"""


@query(_IDS_SQL + "SELECT conv_id, turn, array_to_string(ids, ' ') AS ids FROM i")
def token_ids(spark, read):
    ids = encode(_KNOWN_LEXER.tokens(F.col("text")), _KNOWN)
    return read("conversations").select("conv_id", "turn", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


@query(_IDS_SQL + "SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS key, array_to_string(ids, ' ') AS ids FROM i")
def token_ids_by_join(spark, read):
    """As token_ids, for vocabularies beyond a literal map."""
    rows = read("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), _KNOWN_LEXER.tokens(F.col("text")).alias("tokens"))
    return encode_by_join(rows, "key", "tokens", _KNOWN).select("key", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


_SPECIAL_IDS = f"({_KNOWN.special_id('pad_token')}, {_KNOWN.special_id('bos_token')}, {_KNOWN.special_id('eos_token')}, {_KNOWN.special_id('cls_token')})"


@query(_IDS_SQL + f"""SELECT conv_id, turn, array_to_string(list_transform(list_filter(ids, lambda x: x NOT IN {_SPECIAL_IDS}), lambda x: {_KNOWN_IDS}[x + 1]), ' ') AS token_text FROM i""")
def token_decode(spark, read):
    ids = encode(_KNOWN_LEXER.tokens(F.col("text")), _KNOWN)
    return read("conversations").select("conv_id", "turn", decode(ids, _KNOWN).alias("token_text"))


# ---- validation

_VARIABLES = ["x", "y"]


@query(r"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN true ELSE false END AS well_formed FROM events
""")
def format_check(spark, read):
    """Formulas between bars made of event numbers; every third has a stray letter."""
    k = F.col("event_id").cast("string")
    value = F.when(F.col("event_id") % 3 == 0, F.concat(k, F.lit("*x^2 + 1/3*y - 7 | -x"))).when(F.col("event_id") % 3 == 1, k).otherwise(F.concat(k, F.lit("*z + x")))
    return read("events").select("event_id", validate.pieces_are_formulas(value, _VARIABLES).alias("well_formed"))


@query(r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\|+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents)
SELECT count(*) FILTER (WHERE len(ps) = 0 OR NOT list_bool_and(list_transform(ps, lambda x: regexp_full_match(x, '[+-]?\s*(\d+(\.\d+)?(/\d+)?|(x|y)((\^|\*\*)\d+)?)(\s*\*\s*(\d+(\.\d+)?(/\d+)?|(x|y)((\^|\*\*)\d+)?))*(\s*[+-]\s*(\d+(\.\d+)?(/\d+)?|(x|y)((\^|\*\*)\d+)?)(\s*\*\s*(\d+(\.\d+)?(/\d+)?|(x|y)((\^|\*\*)\d+)?))*)*')))) AS n_bad,
       count(*) = 0 AS well_formed FROM p
""")
def format_summary(spark, read):
    return validate.all_well_formed(read("documents"), _VARIABLES, "text").select("n_bad", "well_formed")


# ---- collation


def _widths() -> Column:
    return F.transform(F.split("text", " "), lambda w: F.length(w))


_COLLATE_SQL = """
WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM conversations),
     m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS n FROM w),
     p AS (SELECT *, list_resize(ids, n, 0) AS padded, list_resize(list_transform(ids, lambda x: 1), n, 0) AS mask FROM m)
"""


@query(_COLLATE_SQL + """
SELECT conv_id, turn, array_to_string(padded, ' ') AS input_ids, array_to_string(mask, ' ') AS attention_mask,
       array_to_string(padded[1:n - 1], ' ') AS decoder_input_ids FROM p
""")
def collate_pad(spark, read):
    rows = collate.collate(read("conversations").withColumn("ids", _widths()), "conv_id", "ids", "ids")
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return rows.select("conv_id", "turn", show("input_ids"), show("attention_mask"), show("decoder_input_ids"))


@query(_COLLATE_SQL + """
SELECT conv_id, turn, array_to_string(list_transform(list_zip(padded[2:n], mask[2:n]), lambda x: CASE WHEN x[2] = 1 THEN x[1] ELSE -100 END), ' ') AS labels FROM p
""")
def collate_labels(spark, read):
    rows = collate.collate(read("conversations").withColumn("ids", _widths()), "conv_id", "ids", "ids")
    return rows.select("conv_id", "turn", F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"))


@query(_COLLATE_SQL + "SELECT conv_id, turn, array_to_string(list_concat([0], padded, [0]), ' ') AS decoder_widths FROM p")
def collate_extra(spark, read):
    rows = collate.pad_extra(read("conversations").withColumn("target_widths", _widths()), "conv_id", "target_widths")
    return rows.select("conv_id", "turn", F.array_join(F.transform("decoder_widths", lambda x: x.cast("string")), " ").alias("decoder_widths"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), ' ') AS roles FROM conversations GROUP BY conv_id")
def collate_lists(spark, read):
    rows = collate.as_lists(read("conversations"), "conv_id", "turn", "role")
    return rows.select("conv_id", F.array_join("role", " ").alias("roles"))


# ---- seeds and counts


@query("""
WITH s AS (SELECT o_orderkey, substr(sha256('42_train_' || o_orderkey), 1, 32) AS seed FROM orders)
SELECT o_orderkey, seed, CAST(CAST('0x' || substr(seed, 1, 16) AS UBIGINT) AS VARCHAR) AS seed_64 FROM s
""")
def seed_hash(spark, read):
    seed = generate.seed_hex(F.lit(42), F.lit("train"), F.col("o_orderkey"))
    return read("orders").select("o_orderkey", seed.alias("seed"), generate.seed_64(seed).cast("string").alias("seed_64"))


@query("""
WITH p AS (SELECT p_partkey, 1 + p_partkey % 5 AS v, unnest(range(0, 1 + p_size % 11)) AS d FROM part)
SELECT p_partkey, CAST(d AS INTEGER) AS degree, CAST(factorial(CAST(v + d - 1 AS INTEGER)) / (factorial(CAST(d AS INTEGER)) * factorial(CAST(v - 1 AS INTEGER))) AS BIGINT) AS n FROM p
""")
def monomial_counts(spark, read):
    """Monomials of each degree up to a part's size modulo 11, in one to five variables."""
    counts = polynomials.monomial_counts(1 + F.col("p_partkey") % 5, F.col("p_size") % 11)
    return read("part").select("p_partkey", F.posexplode(counts).alias("degree", "n"))


@query("""
SELECT s_suppkey, a || ',' || b || ',' || c || ',' || (s_suppkey % 7 - a - b - c) AS exps FROM supplier, range(0, 7) t(a), range(0, 7) u(b), range(0, 7) v(c) WHERE a + b + c <= s_suppkey % 7
""")
def exponent_vectors(spark, read):
    """All exponent vectors in four variables of each supplier's degree."""
    return polynomials.exponent_vectors(read("supplier").select("s_suppkey"), 4, F.col("s_suppkey") % 7).select("s_suppkey", _exps())


@query("""
SELECT c_custkey, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(CASE WHEN i = j THEN 1 WHEN i > j THEN 0 ELSE c_custkey * 36 + i * 6 + j END AS BIGINT) AS value FROM customer, range(0, 6) t(i), range(0, 6) u(j)
""")
def matrix_unimodular(spark, read):
    grid = read("customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    return polynomials.unimodular(grid, F.col("c_custkey") * 36 + F.col("i") * 6 + F.col("j")).select("c_custkey", "i", "j", F.col("value").cast("long").alias("value"))


# ---- polynomials


def _exps(c: str = "exps") -> Column:
    return F.array_join(F.transform(c, lambda e: e.cast("string")), ",").alias("exps")


def _terms(read) -> DataFrame:
    exps = F.array((F.col("l_linenumber") % 3).cast("int"), (F.col("l_partkey") % 3).cast("int"), (F.col("l_suppkey") % 3).cast("int"))
    return read("lineitem").select(F.col("l_orderkey").alias("poly_id"), exps.alias("exps"), F.col("l_quantity").cast(polynomials.COEFF).alias("coeff"))


_TERMS_SQL = """
WITH t AS (SELECT l_orderkey AS poly_id, l_linenumber % 3 AS a, l_partkey % 3 AS b, l_suppkey % 3 AS c, CAST(l_quantity AS BIGINT) AS coeff FROM lineitem),
     p AS (SELECT poly_id, a, b, c, sum(coeff) AS coeff FROM t GROUP BY ALL)
"""
def _long() -> Column:
    return F.col("coeff").cast("long").alias("coeff")



@query("SELECT event_id, user_id, sum(event_id % 17) OVER (PARTITION BY user_id ORDER BY event_id) % 17 AS total FROM events")
def gf17_running_sum(spark, read):
    return read("events").select("event_id", "user_id", polynomials.running_sum(F.col("event_id") % 17, "user_id", "event_id", 17).alias("total"))


@query("""
WITH r AS (SELECT user_id, event_id, event_id % 17 AS x, sum(event_id % 17) OVER (PARTITION BY user_id ORDER BY event_id) % 17 AS total FROM events)
SELECT user_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY event_id) AS problem, string_agg(CAST(total AS VARCHAR), ',' ORDER BY event_id) AS answer, 2 * count(*) - 1 AS n_tokens
FROM r GROUP BY user_id
""")
def gf17_dataset(spark, read):
    """From events to problem and answer lines, which are split and lexed again."""
    rows = gf17_running_sum(spark, read).withColumn("x", F.col("event_id") % 17)
    item = F.struct("event_id", F.col("x").cast("string").alias("x"), F.col("total").cast("string").alias("t"))
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    lines = lists.select("user_id", F.concat(F.array_join(F.col("e.x"), ","), F.lit(" # "), F.array_join(F.col("e.t"), ",")).alias("value"))
    pairs = scans.split_pairs(lines, on_missing="raise").drop("value")
    return pairs.withColumn("n_tokens", F.size(_ATTACH.tokens(F.col("problem"))).cast("long"))


@query(_TERMS_SQL + "SELECT poly_id, a || ',' || b || ',' || c AS exps, CAST(coeff AS BIGINT) AS coeff FROM p WHERE coeff <> 0")
def poly_sum(spark, read):
    return polynomials.normalise(_terms(read)).select("poly_id", _exps(), _long())


@query(_TERMS_SQL + "SELECT poly_id, a || ',' || b || ',' || c AS exps, CAST(coeff % 7 AS BIGINT) AS coeff FROM p WHERE coeff % 7 <> 0")
def poly_mod_p(spark, read):
    return polynomials.normalise(_terms(read), modulus=7).select("poly_id", _exps(), _long())


@query(_TERMS_SQL + """
SELECT x.poly_id, (x.a + y.a) || ',' || (x.b + y.b) || ',' || (x.c + y.c) AS exps, CAST(sum(x.coeff * y.coeff) AS BIGINT) AS coeff
FROM p x JOIN p y USING (poly_id) GROUP BY 1, 2 HAVING sum(x.coeff * y.coeff) <> 0
""")
def poly_product(spark, read):
    """Squares of all polynomials, which are dealt out once: sums, products and their sums are made where a polynomial's terms are."""
    own = polynomials.normalise(scans.spread(_terms(read), "poly_id"))
    return polynomials.multiply(own, own).select("poly_id", _exps(), _long())


@query("""
WITH t AS (SELECT l_orderkey AS poly_id, l_linenumber AS pos, l_partkey % 3 AS a, l_suppkey % 3 AS b, CAST(l_quantity AS BIGINT) - 25 AS coeff FROM lineitem),
     q AS (SELECT DISTINCT poly_id, pos FROM t)
SELECT q.poly_id, q.pos, t.a || ',' || t.b AS exps, CAST(sum(coeff) AS BIGINT) AS coeff FROM q JOIN t ON t.poly_id = q.poly_id AND t.pos <= q.pos
GROUP BY 1, 2, 3 HAVING sum(coeff) <> 0
""")
def poly_prefix_sum(spark, read):
    exps = F.array((F.col("l_partkey") % 3).cast("int"), (F.col("l_suppkey") % 3).cast("int"))
    rows = read("lineitem").select(F.col("l_orderkey").alias("poly_id"), F.col("l_linenumber").alias("pos"), exps.alias("exps"), (F.col("l_quantity") - 25).cast(polynomials.COEFF).alias("coeff"))
    return polynomials.prefix_sums(rows, "poly_id", "pos").select("poly_id", "pos", _exps(), _long())


@query(_TERMS_SQL + "SELECT poly_id, CAST(max(a + b + c) AS INTEGER) AS degree, count(*) AS n_terms, CAST(max(abs(coeff)) AS BIGINT) AS max_coeff FROM p WHERE coeff <> 0 GROUP BY poly_id")
def poly_degree(spark, read):
    own = polynomials.normalise(_terms(read))
    return polynomials.degree(own).join(polynomials.max_coefficient(own), "poly_id").withColumn("max_coeff", F.col("max_coeff").cast("long"))


@query(_TERMS_SQL + """
SELECT poly_id, string_agg('C' || coeff || ' E' || a || ' E' || b || ' E' || c, ' + ' ORDER BY a DESC, b DESC, c DESC) AS expanded, CAST(sum(coeff) AS BIGINT) AS parsed_sum, count(*) AS n_terms
FROM p WHERE coeff <> 0 GROUP BY poly_id
""")
def expanded_form(spark, read):
    """C/E text of every polynomial, and what parsing it again gives."""
    packed = polynomials.pack(polynomials.normalise(_terms(read))).withColumn("expanded", loadprep.expanded_form(F.col("terms")))
    rows = packed.withColumn("parsed", polynomials.parse_ce(F.col("expanded")))
    total = F.aggregate("parsed", F.lit(0).cast("long"), lambda s, t: s + t["coeff"].cast("long"))
    return rows.select("poly_id", "expanded", total.alias("parsed_sum"), F.size("parsed").cast("long").alias("n_terms"))


@query(_TERMS_SQL + """,
     v AS (SELECT poly_id, a, b, c, coeff, concat_ws('*', CASE WHEN a = 1 THEN 'x' WHEN a > 1 THEN 'x^' || a END, CASE WHEN b = 1 THEN 'y' WHEN b > 1 THEN 'y^' || b END, CASE WHEN c = 1 THEN 'z' WHEN c > 1 THEN 'z^' || c END) AS m FROM p WHERE coeff <> 0)
SELECT poly_id, string_agg(CASE WHEN m = '' THEN CAST(coeff AS VARCHAR) WHEN coeff = 1 THEN m ELSE coeff || '*' || m END, ' + ' ORDER BY a DESC, b DESC, c DESC) AS poly_text,
       CAST(sum(coeff * (1 + a + 10 * b + 100 * c)) AS BIGINT) AS parsed_sum FROM v GROUP BY poly_id
""")
def poly_text(spark, read):
    """Expanded text of every polynomial, and a checksum of what parsing it again gives."""
    names = ["x", "y", "z"]
    rows = polynomials.pack(polynomials.normalise(_terms(read))).withColumn("poly_text", polynomials.to_text(F.col("terms"), names))
    weight = lambda t: t["coeff"].cast("long") * (1 + t["exps"][0] + 10 * t["exps"][1] + 100 * t["exps"][2])
    total = F.aggregate(polynomials.parse_expanded(F.col("poly_text"), names), F.lit(0).cast("long"), lambda s, t: s + weight(t))
    return rows.select("poly_id", "poly_text", total.alias("parsed_sum"))


@query(_TERMS_SQL + """,
     g AS (SELECT poly_id, a, b, c, coeff FROM p WHERE coeff <> 0),
     r AS (SELECT poly_id, a, b, c, CASE WHEN a = 0 THEN coeff + 1 ELSE coeff END AS coeff FROM g WHERE b <> 2 UNION ALL SELECT poly_id, 5, 5, 5, 1 FROM g GROUP BY poly_id)
SELECT coalesce(g.poly_id, r.poly_id) AS poly_id, coalesce(g.a, r.a) || ',' || coalesce(g.b, r.b) || ',' || coalesce(g.c, r.c) AS exps, CAST(g.coeff AS BIGINT) AS gold, CAST(r.coeff AS BIGINT) AS predicted,
       CASE WHEN g.coeff IS NULL THEN 'extra' WHEN r.coeff IS NULL THEN 'missing' WHEN g.coeff = r.coeff THEN 'equal' ELSE 'coeff_wrong' END AS state
FROM g FULL JOIN r ON g.poly_id = r.poly_id AND g.a = r.a AND g.b = r.b AND g.c = r.c
""")
def poly_diff(spark, read):
    gold = polynomials.normalise(_terms(read))
    changed = gold.filter(F.col("exps")[1] != 2).withColumn("coeff", F.when(F.col("exps")[0] == 0, F.col("coeff") + 1).otherwise(F.col("coeff")))
    more = gold.select("poly_id").distinct().select("poly_id", F.array(F.lit(5), F.lit(5), F.lit(5)).alias("exps"), F.lit(1).cast(polynomials.COEFF).alias("coeff"))
    return polynomials.compare(gold, changed.unionByName(more)).select("poly_id", _exps(), F.col("gold").cast("long").alias("gold"), F.col("predicted").cast("long").alias("predicted"), "state")


@query(_TERMS_SQL + r""",
     v AS (SELECT *, concat_ws(' ', CASE WHEN a = 1 THEN 'x' WHEN a > 1 THEN 'x^{' || a || '}' END, CASE WHEN b = 1 THEN 'y' WHEN b > 1 THEN 'y^{' || b || '}' END, CASE WHEN c = 1 THEN 'z' WHEN c > 1 THEN 'z^{' || c || '}' END) AS m FROM p WHERE coeff <> 0),
     w AS (SELECT *, CASE WHEN m = '' THEN CAST(coeff AS VARCHAR) WHEN coeff = 1 THEN m ELSE coeff || ' ' || m END AS body FROM v)
SELECT poly_id, string_agg(CASE WHEN coeff > 60 THEN '\cancel{' || body || '}' ELSE body END, ' + ' ORDER BY a DESC, b DESC, c DESC) AS latex FROM w GROUP BY poly_id
""")
def poly_latex(spark, read):
    terms = polynomials.normalise(_terms(read)).withColumn("struck", F.col("coeff") > 60)
    return polynomials.latex(terms, ["x", "y", "z"])


@query("""
WITH n AS (SELECT unnest(range(2, (SELECT max(p_partkey) FROM part))) AS i)
SELECT i AS prime FROM n WHERE NOT EXISTS (SELECT 1 FROM range(2, 1000) u(j) WHERE j * j <= i AND i % j = 0)
""")
def prime_sieve(spark, read):
    """All primes below the largest part number."""
    return polynomials.primes_below(spark, read("part").agg(F.max("p_partkey")).first()[0])


@query("""
WITH RECURSIVE f AS (SELECT p_partkey AS n, p_partkey + 2 AS rest, 2 AS d, [] :: BIGINT[] AS found FROM part
  UNION ALL SELECT n, CASE WHEN rest % d = 0 THEN rest // d ELSE rest END, CASE WHEN rest % d = 0 THEN d ELSE d + 1 END, CASE WHEN rest % d = 0 THEN list_append(found, d) ELSE found END FROM f WHERE d * d <= rest)
SELECT n AS p_partkey, array_to_string(CASE WHEN rest > 1 THEN list_append(found, rest) ELSE found END, ' | ') AS factors FROM f WHERE d * d > rest
""")
def int_factor(spark, read):
    """Prime factors of all part numbers plus 2."""
    rows = read("part").select("p_partkey", (F.col("p_partkey") + 2).cast("long").alias("n"))
    rows = rows.join(polynomials.prime_divisors(rows, "n"), "n", "left")
    factors = polynomials.prime_factors(F.col("n"), F.coalesce("primes", F.array().cast("array<long>")))
    return rows.select("p_partkey", nested.to_text(nested.flat(factors)).alias("factors"))


@query("""
WITH m AS (SELECT l_orderkey AS mat_id, l_linenumber % 3 AS i, l_partkey % 3 AS j, sum(CAST(l_quantity AS BIGINT)) AS value FROM lineitem GROUP BY ALL)
SELECT x.mat_id, CAST(x.i AS INTEGER) AS i, CAST(y.i AS INTEGER) AS j, CAST(sum(x.value * y.value) AS BIGINT) AS value FROM m x JOIN m y ON x.mat_id = y.mat_id AND x.j = y.j GROUP BY 1, 2, 3
""")
def matrix_product(spark, read):
    """Each order's matrix times its transpose."""
    m = read("lineitem").groupBy(F.col("l_orderkey").alias("mat_id"), (F.col("l_linenumber") % 3).cast("int").alias("i"), (F.col("l_partkey") % 3).cast("int").alias("j")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return polynomials.matrix_product(m, m.select("mat_id", F.col("j").alias("i"), F.col("i").alias("j"), "value"))


# ---- statistics and scores


@query("""
SELECT l_returnflag AS category, l_linestatus AS metric, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max
FROM lineitem GROUP BY 1, 2
""")
def welford_stats(spark, read):
    """Statistics of nested maps, one map a row."""
    stats = F.create_map(F.col("l_returnflag"), F.create_map(F.col("l_linestatus"), F.col("l_quantity")))
    rows = metrics.sample_statistics(read("lineitem").select(stats.alias("stats")), "stats")
    return rows.select("category", "metric", "n", as_double(F.col("mean")).alias("mean"), as_double(F.col("std")).alias("std"), "min", "max")


@query("""
SELECT user_id, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std FROM events GROUP BY user_id
""")
def list_stats(spark, read):
    v = F.col("value").cast("double")
    rows = read("events").groupBy("user_id").agg(F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return rows.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


_LABELS_SQL = """
WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS ws FROM conversations),
     l AS (SELECT list_transform(ws, lambda x: CASE WHEN x > 8 THEN -100 ELSE x END) AS y, list_transform(ws, lambda x: CASE WHEN conv_id % 3 = 0 OR x < 7 THEN x ELSE 0 END) AS p FROM w),
     n AS (SELECT len(list_filter(y, lambda x: x <> -100)) AS valid, len(list_filter(list_zip(y, p), lambda x: x[1] <> -100 AND x[1] = x[2])) AS correct FROM l)
"""


@query(_LABELS_SQL + "SELECT round(sum(correct) / sum(valid), 6) AS token_accuracy, round(avg(CASE WHEN valid > 0 AND valid = correct THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM n")
def token_accuracy(spark, read):
    y = F.transform("w", lambda x: F.when(x > 8, collate.IGNORED).otherwise(x))
    p = F.transform("w", lambda x: F.when((F.col("conv_id") % 3 == 0) | (x < 7), x).otherwise(0))
    rows = metrics.accuracy(read("conversations").withColumn("w", _widths()).select(y.alias("y"), p.alias("p")), "p", "y")
    return rows.select(as_double(F.col("token_accuracy")).alias("token_accuracy"), as_double(F.col("success_rate")).alias("success_rate"))


@query(r"SELECT round(avg(CASE WHEN text = lower(text) THEN 1.0 WHEN turn % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM conversations")
def exact_match(spark, read):
    rows = read("conversations").select(F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" \n"), F.col("text"), F.lit("\t"))).otherwise(F.lower("text")).alias("generated"), F.col("text").alias("reference"))
    return metrics.exact_match(rows).select(as_double(F.col("exact_match")).alias("exact_match"))


@query("SELECT doc_id, text AS generated, text AS reference FROM documents WHERE doc_id % 2 = 0 ORDER BY doc_id LIMIT 20")
def success_cases(spark, read):
    """The first hits: the limit is the operator."""
    rows = read("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("generated"), F.col("text").alias("reference"))
    return metrics.cases(rows, True, "doc_id", 20)


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label_id FROM embeddings")
def argmax(spark, read):
    return read("embeddings").select("vec_id", metrics.argmax(F.col("embedding")).alias("label_id"))


@query("""
WITH e AS (SELECT vec_id, CAST(label AS BIGINT) % 64 AS y, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)
SELECT round(avg(ln(list_sum(list_transform(l, lambda x: exp(x)))) - l[y + 1]), 6) AS loss FROM e WHERE vec_id % 5 <> 0
""")
def cross_entropy(spark, read):
    """One position a row; every fifth label is left out of the mean."""
    y = F.when(F.col("vec_id") % 5 == 0, collate.IGNORED).otherwise((F.col("label") % 64).cast("int"))
    rows = read("embeddings").select(F.array(F.transform("embedding", lambda x: x.cast("double"))).alias("logits"), F.array(y).alias("labels"))
    return metrics.cross_entropy(rows, "logits", "labels").select(as_double(F.col("loss")).alias("loss"))


# ---- tensors


@query("""
SELECT CAST(pos AS INTEGER) AS pos, CAST(d AS INTEGER) AS dim, round(CASE WHEN d % 2 = 0 THEN sin(pos * pow(10000, -2.0 * (d // 2) / 64)) ELSE cos(pos * pow(10000, -2.0 * (d // 2) / 64)) END, 6) AS value FROM (SELECT unnest(range(0, (SELECT max(p_size) FROM part))) AS pos), range(0, 64) u(d)
""")
def sinusoidal_pe(spark, read):
    """A table as long as the largest size of a part."""
    return tensors.sinusoidal(spark, read("part").agg(F.max("p_size")).first()[0], 64).withColumn("value", as_double(F.col("value")))


@query("""
WITH e AS (SELECT vec_id, embedding AS v FROM embeddings), g AS (SELECT vec_id, i, CAST(v[i + 1] AS DOUBLE) AS a, CAST(v[i + 33] AS DOUBLE) AS b, vec_id * pow(10000, -2.0 * i / 64) AS t FROM e, range(0, 32) r(i))
SELECT vec_id, round(sum((i + 1) * (a * cos(t) - b * sin(t))), 4) AS low, round(sum((i + 1) * (b * cos(t) + a * sin(t))), 4) AS high FROM g GROUP BY vec_id
""")
def rope(spark, read):
    """Checksums of both halves of every vector rotated by its number."""
    rows = read("embeddings").select("vec_id", tensors.rotary(F.col("embedding"), F.col("vec_id"), 64).alias("r"))
    half = lambda a, b: F.round(F.aggregate(F.transform(F.slice("r", a, 32), lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x), 4).alias(b)
    return rows.select("vec_id", half(1, "low"), half(33, "high"))


@query("""
WITH c AS (SELECT conv_id, unnest(range(count(*))) AS i FROM conversations GROUP BY conv_id)
SELECT a.conv_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, b.i > a.i AS masked FROM c a JOIN c b ON a.conv_id = b.conv_id
""")
def causal_mask(spark, read):
    """A mask for each conversation, over its turns."""
    return tensors.causal_mask(read("conversations").groupBy("conv_id").agg(F.count("*").alias("n")), "n").drop("n")


@query(_COLLATE_SQL + "SELECT conv_id, turn, n - len(ids) AS n_masked FROM p")
def padding_mask(spark, read):
    rows = collate.collate(read("conversations").withColumn("ids", _widths()), "conv_id", "ids", "ids")
    return rows.select("conv_id", "turn", F.size(F.filter(tensors.padding_mask(F.col("attention_mask")), lambda m: m)).cast("long").alias("n_masked"))


@query("""
WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM conversations)
SELECT conv_id, turn, array_to_string(list_concat([2], CASE WHEN list_contains(ids, 3) THEN list_resize(ids[1:list_position(ids, 3)], len(ids), 0) ELSE ids END), ' ') AS ids FROM w
""")
def eos_mask(spark, read):
    """Word lengths as ids: padding behind the first 3."""
    ids = tensors.greedy_plan(_widths(), 2, 3, 0)
    return read("conversations").select("conv_id", "turn", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))


# ---- generated tasks (checked by their invariants in the tests)


def task_keys(customers: DataFrame) -> DataFrame:
    """A sample for each customer, every tenth of them for the test."""
    keys = customers.select(F.when(F.col("c_custkey") % 10 == 0, "test").otherwise("train").alias("tag"), F.col("c_custkey").alias("sample_index"))
    return scans.spread(keys, "sample_index")


def _task(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = generate.for_keys(task_keys(spark.read.parquet(f"{sf_dir}/customer.parquet")), tasks.examples().get(name))
        return df.select("tag", "sample_index", "seed", nested.to_text(F.col("problem")).alias("problem"), nested.to_text(F.col("answer")).alias("answer"))

    return run


for _name in tasks.examples().known:
    QUERIES[f"task_{_name}"] = _task(_name)


@query("""
WITH q AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS s, p_partkey % 1000 AS c FROM part),
     d AS (SELECT *, s * s - 4 * c AS d, CAST(floor(sqrt(greatest(s * s - 4 * c, 0)) + 0.5) AS BIGINT) AS r FROM q),
     f AS (SELECT *, (s - r) // 2 AS u, (s + r) // 2 AS v, d >= 0 AND r * r = d AS splits FROM d),
     x AS (SELECT *, CASE WHEN u = 0 THEN 'x' ELSE '(x + ' || u || ')' END AS fu, CASE WHEN v = 0 THEN 'x' ELSE '(x + ' || v || ')' END AS fv FROM f)
SELECT p_partkey, 'x^2 + ' || s || '*x + ' || c AS poly,
       CASE WHEN NOT splits THEN '(x^2 + ' || CASE WHEN s = 1 THEN 'x' ELSE s || '*x' END || ' + ' || c || ')' WHEN u = v THEN fu || '^2' ELSE fu || ' * ' || fv END AS factors FROM x
""")
def poly_factor(spark, read):
    """Factors of x^2 + size * x + key % 1000 for every part, by the closed form of quadratics."""
    size, rest = F.col("p_size").cast("long"), F.col("p_partkey") % 1000
    rows = read("part").select("p_partkey", F.concat(F.lit("x^2 + "), "p_size", F.lit("*x + "), rest.cast("string")).alias("poly"), F.array_sort(polynomials.quadratic_factors(F.lit(1), size, rest)).alias("f"))
    times = lambda n, x: F.when(n == 1, x).otherwise(F.concat(n.cast("string"), F.lit(f"*{x}")))
    plus = lambda n: F.when(n == 0, "").when(n > 0, F.concat(F.lit(" + "), n.cast("string"))).otherwise(F.concat(F.lit(" - "), (-n).cast("string")))
    middle = lambda n: F.when(n == 0, "").otherwise(F.concat(F.lit(" + "), times(n, "x")))
    one = lambda t: F.when((t["p"] == 0) & (t["q"] == 1) & (t["r"] == 0), "x").otherwise(F.concat(F.lit("("), F.when(t["p"] == 0, times(t["q"], "x")).otherwise(F.concat(times(t["p"], "x^2"), middle(t["q"]))), plus(t["r"]), F.lit(")")))
    square = (F.size("f") == 2) & (F.get("f", F.lit(0)) == F.get("f", F.lit(1)))
    text = F.when(square, F.concat(one(F.get("f", F.lit(0))), F.lit("^2"))).otherwise(F.array_join(F.transform("f", one), " * "))
    return rows.select("p_partkey", "poly", text.alias("factors"))


@query("""
WITH g AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, value FROM events)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 9) AS mean FROM g GROUP BY 1, 2
""")
def daily_statistics(spark, read):
    """Statistics by user and day."""
    rows = metrics.describe(read("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "user_id", "day")
    return rows.select("user_id", "day", "n", F.round("mean", 9).alias("mean"))


def queries() -> dict[str, Query]:
    from . import catalogue_more, catalogue_tables  # noqa: F401  register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalogue_more, catalogue_tables  # noqa: F401

    return dict(SQL)
