from pyspark.sql import functions as F

from inkwell.functions import spans
from inkwell.operators import layout
from inkwell.operators.align import align, aligned, cut, folded, found
from inkwell.operators.pipeline import build

SCHEMA = "doc_id bigint, ord bigint, block_id string, block_type string, text string, children string, inline_content string"


def t(value, block="1", **more):
    return {"kind": "text", "value": value, "source_block_id": block} | more


def test_folding():
    assert folded("a  +\n b")[0] == "a+b" and folded(" x_{12} y^2 ")[0] == "x12 y2" and folded("SO₄²⁻ − 1")[0] == "SO42--1" and folded("")[0] == ""
    assert found("the  value x^{2}", "value x²") == (5, 15) and found("abc", "") is None and found("abc", "d") is None


def test_cut():
    nodes = [t("ab"), {"kind": "math_sequence", "value": "x^2"}, t("cd")]
    assert [n["value"] for n in cut(nodes, 1, 6)] == ["b", "x^2", "c"] and cut(nodes, 3, 7) is None and cut(nodes, 2, 2) == []


def test_align():
    nodes = [t("1. Find "), {"kind": "math_sequence", "value": "x^{2}", "source_block_id": "1"}, t(" now (2019)"), t("(A) one (B) ", "2"), t("2", "2", vertical_align="superscript"), t("(2020)", "3")]
    roles = {"1": "stem", "2.part_1": "option", "2.part_2": "option"}
    assert [n["value"] for n in align("question", "Find x² now", nodes, roles)] == ["Find ", "x^{2}", " now"]
    assert [n["value"] for n in align("option:A", "one", nodes, roles)] == ["one"] and align("option:B", "²", nodes, roles)[0]["vertical_align"] == "superscript"
    assert align("question", "nowhere", nodes, roles) is None and align("question", "", nodes, roles) is None and align("question", "x", [], roles) is None
    assert [n["value"] for n in align("statement:1", "A. Find", nodes, roles)] == ["Find"]
    both = [t("first line", "7"), t("second", "8")]
    assert [n["value"] for n in align("question", "first line\nsecond", both, {"7": "stem", "8": "stem"}) if n["kind"] == "text"] == ["first line", "second"]


def test_aligned_rows(spark):
    inline = '[{"kind":"text","value":"1. Which "},{"kind":"math_sequence","value":"x"},{"kind":"text","value":"?"}]'
    rows = [(1, 1, "1", "paragraph", "1. Which x?", None, inline), (1, 2, "2", "paragraph", "(A) p (B) q (C) r (D) s", None, '[{"kind":"text","value":"(A) p (B) q (C) r (D) other"}]'), (1, 3, "3", "paragraph", "2. No nodes here?", None, None)]
    q = build(spark.createDataFrame(rows, SCHEMA)).questions
    got = {r.component_id: r for r in aligned(layout.components(q), q).collect()}
    assert got["question"].aligned and got["question"].source_block_id == "1" and len(got["question"].nodes) == 3 and got["question"].code is None
    assert got["option:B"].aligned and got["option:B"].source_block_id == "2.part_2" and got["option:D"].code == "TEXT_LAYOUT_DEGRADED" and len(got) == 5


def test_boxes(spark):
    short, long = {"A": "1", "B": "2", "C": "3", "D": "4"}, {"A": "x" * 90, "B": "", "C": None}
    got = [r.b for r in spark.createDataFrame([(1, short), (2, long), (3, {}), (4, None)], "i int, o map<string,string>").select("i", layout.option_boxes(F.col("o")).alias("b")).orderBy("i").collect()]
    assert [(b.letter, b.row, b.column, b.x, b.height) for b in got[0]] == [("A", 0, 0, 0.5, 0.5), ("B", 0, 1, 3.6325, 0.5), ("C", 0, 2, 6.765, 0.5), ("D", 0, 3, 9.8975, 0.5)]
    assert [(b.letter, b.row, b.column, b.height) for b in got[1]] == [("A", 0, 0, 0.888), ("B", 0, 1, 0.888), ("C", 1, 0, 0.5)] and got[2] == [] and not got[3]
    rows = spark.createDataFrame([([["a", "b"], ["x" * 200, None], []], [0, 1, 2]), (None, None)], "r array<array<string>>, m array<int>")
    heights = [r.h for r in rows.select(layout.table_heights(F.col("r"), F.col("m")).alias("h")).collect()]
    assert heights == [[0.43, 1.042, 0.62], None]
    m = spark.createDataFrame([("Pair: Column I Column II (1) Iron (2) Tin (a) Sn",)], "t string").select(layout.match_boxes(spans.match_columns(F.col("t"))).alias("m")).first().m
    assert [(b.side, b.row, b.y, b.height) for b in m] == [("left", 0, 0.33, 0.75), ("left", 1, 1.08, 0.75), ("right", 0, 0.33, 0.75)]
    sizes = spark.createDataFrame([(100.0, 50.0), (5000.0, 100.0), (300.0, 3000.0), (0.0, 1.0)], "w double, h double").select(layout.picture_size(F.col("w"), F.col("h")).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in sizes] == [(1.0, 0.5), (9.864, 0.1973), (0.45, 4.5), None]


def test_deck(spark):
    q = spark.createDataFrame([(1, "mcq", {"A": "x"}, True, False), (1, "mcq", {}, True, True), (1, "match_list", {}, False, False), (1, "divider", None, None, None), (2, None, None, None, None)], "doc_id int, question_type string, options map<string,string>, parsed_ok boolean, needs_review boolean")
    got = [tuple(r) for r in layout.deck_counts(q, ["doc_id"]).orderBy("doc_id").collect()]
    assert got[0] == (1, 4, 1, 1, 1, 2, 1, "4 Questions (2 Flagged for Review) · Exam Prep") and got[1][1:7] == (1, 0, 0, 1, 0, 0)
    titles = spark.createDataFrame([("a/b/mid_term-one.docx",), ("",), (None,)], "t string").select(layout.deck_title(F.col("t")).alias("t")).collect()
    assert [r.t for r in titles] == ["Mid Term One — Practice Deck", "Question Presentation", "Question Presentation"]


def test_print_plan(spark):
    schema = "doc_id int, q_seq int, section string, number string, question string, question_type string, options map<string,string>, images array<string>, statements array<struct<label:string,text:string>>, tables array<struct<rows:array<array<string>>>>"
    rows = [(1, 1, "S", "7", "Why?", "mcq", {"E": "e", "B": "b", "A": "a", "C": ""}, ["p.png"], [("I", "so"), (None, "bare")], [([["h", None], ["1", "2"]],)]), (1, 2, "S", None, None, None, None, None, None, None), (1, 3, None, "", "x", "open", {}, [], [], [])]
    got = layout.print_plan(spark.createDataFrame(rows, schema), ["doc_id"], ["q_seq"]).orderBy("q_seq", "line").collect()
    assert [(r.kind, r.text) for r in got if r.q_seq == 1] == [("heading", "Section: S"), ("header", "Question 7 [MCQ]"), ("question", "Why?"), ("image", "p.png"), ("statement", "I. so"), ("statement", "bare"), ("option", "(A) a"), ("option", "(B) b"), ("option", "(E) e"), ("table_row", "h    |    "), ("table_row", "1    |    2")]
    assert [(r.kind, r.text) for r in got if r.q_seq > 1] == [("header", "Question ? [MCQ]"), ("question", ""), ("heading", "Section: General"), ("header", "Question ? [OPEN]"), ("question", "x")]
