import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkwell.llm.textform import canonical_segment, consistent, consistent_column, differing, fields

CHANGED = [("wіth", "with"), ("Τest", "Test"), ("a\u00a0b", "a b"), ("e\u0301t", "ét"), ("di\ufb00er", "differ"), ("f\u200bo\u00adx", "fox"), ("ｏｆ", "of"), ("\U0001d5cbate", "rate"), ("ℓ", "l"), ("e\u0327\u0301", "\u0229\u0301"), ("ոet", "net"), ("Ꮃater", "Water"), ("ꓢum", "Sum"), ("ⲟf", "of"), ("vӏtа", "vlta")]
SAME = [None, "", " ", "né", "SO₄²⁻ x² H₂O", "β Δ Ω λ 5°", "сост воды", "मात्रा क्या", "日本語", "\ttab\nline\r\n", "plain ´", "σx αs γ-ray", "հայ", "ᎳᎷ"]


@pytest.mark.parametrize(("raw", "want"), CHANGED)
def test_changed(raw, want):
    assert consistent(raw) == want and consistent(want) == want


@pytest.mark.parametrize("raw", SAME)
def test_same(raw):
    assert consistent(raw) == raw


def test_segments_equal_whole_text():
    rng = random.Random(5)
    letters = "aе\u0301\u0303ño\u200b\u00a0²\ufb00Ａк\nxᄒ\u1161\u0300\u093c\u093e\u094dक\u0327 ."
    for _ in range(20_000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(1, 10)))
        assert consistent(s) == canonical_segment.__wrapped__(s), ascii(s)
        assert consistent(consistent(s)) == consistent(s), ascii(s)
        assert unicodedata.is_normalized("NFC", consistent(s))


def test_tables(spark):
    q = "question_uid bigint, question string, options map<string,string>, value string, field string"
    b = "block_uid bigint, text string, record_id int"
    long = "né " * 50_000 + "ｏｆ"
    questions = spark.createDataFrame([(1, "wіth", {"A": None, "B": "ｏｆ", "C": ""}, "x", "y"), (1, "wіth", {"A": None, "B": "ｏｆ"}, "x", "y"), (2, None, None, None, None), (None, "ok", {}, None, None)], q)
    blocks = spark.createDataFrame([(7, long, 1), (8, None, 1), (9, "", 1)], b)
    got = differing(fields(questions, blocks)).select("table_name", "record_id", "field").collect()
    assert sorted(map(tuple, got)) == [("document_blocks", 7, "text"), ("questions", 1, "options.B"), ("questions", 1, "question")]
    forms = blocks.select(consistent_column(F.col("text")).alias("f")).collect()
    assert forms[0].f == long[:-2] + "of" and forms[1].f is None and forms[2].f == ""
    assert differing(fields(questions.limit(0), blocks.limit(0))).count() == 0
