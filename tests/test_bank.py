import pytest

from inkwell.functions import chem
from inkwell.operators.pipeline import build

SCHEMA = "doc_id bigint, ord bigint, block_id string, block_type string, text string, section string, bits string"


def bank(spark, docs, kinds=None):
    rows = [(d, i, f"b{i}", (kinds or {}).get((d, i), "paragraph"), t, "clash", "clash") for d, lines in docs.items() for i, t in enumerate(lines, 1)]
    return build(spark.createDataFrame(rows, SCHEMA).repartition(5))


FOUR = ["(A) one (B) two (C) three (D) four"]


def test_scenarios(spark):
    docs = {
        1: ["Section A", "1. Pick one (A) 1 (B) 2 (C) 3 (D) 4", "2. Next? (2020) (2018) (2022) (2018)", *FOUR],
        2: ["1. Which is it?", *FOUR, "(2020, 2022)", "Join us today"],
        3: ["1. a?", *FOUR, "2. b?", *FOUR, "2. c?", *FOUR, "1. d?", *FOUR, "4. e?", *FOUR],
        4: ["Section A", "10. a?", *FOUR, "Section B", "1. b?", *FOUR],
        5: ["1. Why?", *FOUR, "II. Find the next value", *FOUR],
        6: ["Consider a function f(x):", "Find the derivative of it."],
        7: ["1. Match. (A) x (B) y"],
        8: ["1. Read these.\nStatement I: a is b.\nStatement II: c is d.", *FOUR],
        9: ["1. Do all\n(i) first\n(ii) second"],
        10: [None, "", "   "],
        11: ["1. Same. (A) x (B) x (C) y (D)", "where y is small"],
    }
    b = bank(spark, docs)
    q = {(r.doc_id, r.q_seq): r for r in b.questions.collect()}
    assert q[1, 1].options == {"A": "1", "B": "2", "C": "3", "D": "4"} and q[1, 1].question == "Pick one" and q[1, 1].question_type == "mcq"
    assert q[1, 2].appearances == ["2020", "2018", "2022"] and q[1, 2].section == "Section A"
    assert q[2, 1].appearances == ["2020", "2022"] and "b3" in q[2, 1].block_ids and q[2, 1].parsed_ok and not q[2, 1].needs_review
    assert [q[3, i].event for i in range(1, 6)] == ["sequence", "sequence", "duplicate", "regression", "gap"]
    assert q[4, 2].event == "section_reset" and q[4, 2].previous == 10
    assert q[5, 2].scheme == "roman" and q[5, 2].question == "Find the next value"
    assert (6, 2) not in q and q[7, 1].options == {}
    assert [s.label for s in q[8, 1].statements] == ["I", "II"] and q[8, 1].question_type == "statement_based"
    assert [(s.label, s.text) for s in q[9, 1].subparts] == [("i", "first"), ("ii", "second")]
    assert not any(d == 10 for d, _ in q)
    assert q[11, 1].issues == ["DUPLICATE_OPTION_VALUES"] and q[11, 1].options["D"] == "where y is small"
    status = {(r.doc_id, r.block_id): (r.status, r.q_seq) for r in b.ledger.collect()}
    assert len(status) == sum(map(len, docs.values())) and status[2, "b3"] == ("consumed", 1) and status[2, "b4"][0] == "ignored_with_reason" and status[1, "b1"][0] == "ignored_with_reason"
    for r in b.diagnostics.collect():
        assert r.questions_accepted + r.questions_needs_review + r.questions_rejected == r.questions_detected
        assert r.consumed + r.orphan_blocks + r.ignored == r.total_source_blocks


def test_order_and_hot_document(spark):
    lines = [t for i in range(1, 400) for t in (f"{i}. What is x{i}?", *FOUR)]
    one = {(r.q_seq, r.question) for r in bank(spark, {1: lines}).questions.collect()}
    assert len(one) == 399 and (399, "What is x399?") in one


def test_tables_and_empty(spark):
    b = bank(spark, {1: ["1. Use the table.", "a\nb", "which is right?"]}, {(1, 2): "table"})
    (r,) = b.questions.collect()
    assert r.features.has_table and [s.role for s in r.source_blocks] == ["stem", "table", "stem"]
    none = build(spark.createDataFrame([], SCHEMA))
    assert none.questions.count() == 0 and none.ledger.count() == 0 and none.diagnostics.count() == 0


@pytest.mark.parametrize("n", [10_000])
def test_long_block(spark, n):
    (r,) = bank(spark, {1: ["1. " + "word " * n + "end?", "(A) " + "x " * n + "(B) y (C) z (D) w"]}).questions.collect()
    assert len(r.options["A"]) == 2 * n - 1
    long = "y " * n
    texts = [f"1. Statement I: {long}\nStatement II: {long}", f"2. Which?\nA. {long}", f"3. All\n(i) {long}\n(ii) {long}", "4. " + "H" * n + " 2 " + "(" * 500 + "$" * n]
    q = {x.q_seq: x for x in bank(spark, {1: texts}).questions.collect()}
    assert len(q) == 4 and [len(s.text) for s in q[1].statements] == [2 * n - 1] * 2 and len(q[3].subparts) == 2
    assert len(chem.with_chem(spark.createDataFrame([(texts[3],)], "t string"), "t").first().t) >= n
