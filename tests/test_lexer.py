import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mathloom.functions.lexer import Lexer, NumberPolicy, chain, number_tokens
from mathloom.functions.vocab import Vocab, decode, encode, field_tokens, range_tokens

VOCAB = Vocab.from_config({"range": {"c": ["C", -50, 50], "e": ["E", 0, 20], "v": ["x", 0, 2]}, "misc": ["+", "*", "^", "(", ")"], "special_tokens": {"unk_token": "<unk>"}})
PLAIN = Vocab.build(range_tokens("", 0, 111) + ["+"])
SIGNED = Vocab.build(range_tokens("", -999, 999) + ["x", "+", "-"])


def lexer(vocab, sign, group, floats, strict=True):
    return Lexer.build(vocab, NumberPolicy(sign, group, floats), strict)


def run(spark, lex, text):
    return spark.createDataFrame([(text,)], "t string").select(lex.tokens(F.col("t"))).first()[0]


GOLDEN = [
    ("C-50*x1^2 + 3.14", VOCAB, False, 1, True, "C-50 * x1 ^ 2 + 3 . 1 4"),
    ("x0||x1|x2", VOCAB, False, 1, True, "x0 || x1 | x2"),
    ("-50 + 123", VOCAB, False, 0, False, "- 50 + 123"),
    ("-50 + 123", VOCAB, True, 0, False, "-50 + 123"),
    ("12345", VOCAB, False, 2, False, "12 34 5"),
    ("3.14", VOCAB, False, 1, True, "3 . 1 4"),
    ("111+1111111", PLAIN, False, 0, False, "111 + 1111111"),
    ("x-5", SIGNED, True, 0, False, "x -5"),
    ("1006", Vocab.build(range_tokens("", 0, 1000)), False, 3, False, "100 6"),
    ("1000", Vocab.build(range_tokens("", 0, 1000)), False, 3, False, "1000"),
    ("-12345 + 7", Vocab.build(range_tokens("", -999, 999) + ["+"]), True, 3, False, "-123 45 + 7"),
    ("  a_b1\t\n+ 2 ", VOCAB, False, 0, False, "a_b1 + 2"),
    ("", VOCAB, False, 0, False, ""),
]


@pytest.mark.parametrize("text, vocab, sign, group, floats, want", GOLDEN)
def test_golden(spark, text, vocab, sign, group, floats, want):
    assert run(spark, lexer(vocab, sign, group, floats), text) == want.split()


def test_unknown_characters(spark):
    assert run(spark, lexer(VOCAB, False, 0, False, strict=False), "x0 + x1 @ invalid") == ["x0", "+", "x1", "<unk>", "invalid"]
    with pytest.raises(Exception, match="Unknown character '@' at position 8"):
        run(spark, lexer(VOCAB, False, 0, False), "x0 + x1 @ invalid")


@pytest.mark.parametrize("text, sign, group, floats, want", [(".5", False, 1, True, ["0", ".", "5"]), ("3.", False, 0, True, ["3", ".", ""]), ("-3.14", True, 0, True, ["-3", ".", "14"]), ("-12345", True, 2, False, ["-12", "34", "5"]), ("12", False, 0, False, ["12"])])
def test_numbers(spark, text, sign, group, floats, want):
    assert spark.createDataFrame([(text,)], "t string").select(number_tokens(F.col("t"), NumberPolicy(sign, group, floats))).first()[0] == want


def test_policy_is_checked():
    with pytest.raises(ValueError):
        NumberPolicy(1)
    with pytest.raises(ValueError):
        NumberPolicy(False, -1)


@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.text("xC12+-*^( )@\n.E0ä", max_size=25), min_size=1, max_size=20))
def test_tokens_tile_the_text(spark, texts):
    lex = lexer(VOCAB, False, 0, False, strict=False)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lex.tokens(F.col("t")).alias("k")).collect()
    for t, tokens in rows:
        rest = "".join(t.split())
        for k in tokens:
            rest = rest[1:] if k == "<unk>" else rest.removeprefix(k) if rest.startswith(k) else "?"
        assert rest == ""


def test_chain_and_decode(spark):
    encode_text, decode_text = chain(lexer(VOCAB, False, 0, False))
    row = spark.createDataFrame([("C-5*x0 + x1",)], "t string").select(encode_text(F.col("t")).alias("e")).select("e", decode_text(F.col("e")).alias("d")).first()
    assert (row["e"], row["d"]) == ("C-5 * x0 + x1", "C-5*x0+x1")
    with pytest.raises(ValueError):
        chain()


def test_vocabularies():
    assert VOCAB.tokens[0] == "[SEP]" and VOCAB.special["unk_token"] == "<unk>" and VOCAB.ids["[PAD]"] == len(VOCAB.tokens)
    assert range_tokens("x", 0, 2) == ["x0", "x1", "x2"] and range_tokens("C", -2, 4, centered=True) == [f"C{i}" for i in range(-3, 6)]
    assert field_tokens("GF3") == ["C-2", "C-1", "C0", "C1", "C2", "C3"]
    with pytest.raises(ValueError):
        field_tokens("ZZ")
    flags = {"misc": ["a", "a"], "flags": {"include_base_vocab": False}, "include_base_vocab": True, "include_base_special_tokens": False}
    assert Vocab.from_config(flags).tokens == ("a",) and Vocab.from_config(flags).special == {}
    assert Vocab.from_config(VOCAB.config()) == VOCAB
    assert "-0" in SIGNED.with_number_tokens(2, True, True).tokens and len(PLAIN.with_number_tokens(3, False, False).tokens) == 1 + 1 + 10 + 100 + 1000


def test_ids_round_trip(spark):
    v = Vocab.build(["a", "b"], {"unk_token": "<unk>"})
    row = spark.createDataFrame([(["b", "?", "a"],)], "t array<string>").select(encode(F.col("t"), v).alias("i")).select("i", decode(F.col("i"), v)).first()
    assert row[0] == [v.ids["<s>"], 2, v.ids["<unk>"], 1, v.ids["</s>"]] and row[1] == "b a"
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([(["?"],)], "t array<string>").select(encode(F.col("t"), Vocab.build(["a"]))).collect()
