from pyspark.sql import functions as F

from inkwell.operators import layout, pagespans, repair

Q = "question_id bigint, section string, question string, options map<string,string>, question_type string, parsed_ok boolean, needs_review boolean"
C = "key string, match string, question string, options map<string,string>, question_type string, parsed_ok boolean"


def test_corrections(spark, monkeypatch):
    q = spark.createDataFrame([(1, None, "What is 41.?", {"A": "x"}, "mcq", False, False), (2, None, "Other", None, None, True, False), (3, None, None, None, None, True, False), (41, None, "z", {}, "open", True, False)], Q)
    c = spark.createDataFrame([("1", None, "Renamed stem", {"B": "y"}, None, True), ("m1", "stem", None, {"A": "new"}, None, None), ("m2", "named", None, {"A": "later"}, "mcq2", None), ("m3", "41.", "wrong", None, None, None)], C)
    out = {r.question_id: r for r in repair.corrected(q, c).collect()}
    assert out[1].question == "Renamed stem" and out[1].options == {"A": "later", "B": "y"} and out[1].parsed_ok and out[1].question_type == "mcq2"
    assert out[2].question == "Other" and out[3].question is None and out[41].question == "z" and len(out) == 4
    monkeypatch.setattr(repair, "MOST_MATCHES", 0)  # the way for lists of any length
    assert {r.question_id: r for r in repair.corrected(q, c).collect()} == out
    assert repair.corrected(q, c.limit(0)).count() == 4 and repair.corrected(q.limit(0), c).count() == 0


def test_recovery(spark):
    q = spark.createDataFrame([(1, None, "bad", {}, "mcq", False, True), (2, None, "bad too", {"A": "x"}, "mcq", True, True), (3, "S", "fine", {}, "open", True, False), (4, None, "alone", {}, "open", False, True)], Q)

    def provider(rows):
        four = {"a": "1", "B": "2", "C": "3", "D": "4"}
        return [{"id": r["key"], "question": f" fixed {r['key']} ", "options": four, **({"answer": "A"} if r["key"] == "2" else {})} for r in rows] + [{"id": "99", "question": "x", "options": {}}]

    asked = repair.contexts(q)
    assert {r.key for r in asked.collect()} == {"1", "2", "4"}
    out = {r.question_id: r for r in repair.recovered(q, repair.proposals(asked, provider)).collect()}
    assert out[1].recovery == "applied" and out[1].question == "fixed 1" and out[1].options["A"] == "1"
    assert out[2].recovery == "rejected" and out[2].question == "bad too" and out[3].recovery is None and len(out) == 4

    def broken(rows):
        raise RuntimeError("no network")

    out = {r.question_id: r for r in repair.recovered(q, repair.proposals(asked, broken)).collect()}
    assert out[1].recovery == "failed" and out[1].question == "bad" and out[4].needs_review
    assert repair.read_answers('```json\n{"questions": [{"id": 1}]}\n```') == [{"id": 1}] and repair.read_answers('so: [{"id": 1}] ok') == [{"id": 1}]
    assert repair.read_answers('[{"id": 1}, {"id": 2}, {"id"') == [{"id": 1}, {"id": 2}] and repair.read_answers("none") is None


def spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, page int, line_no int, span_no int, text string, size double, x0 double, x1 double, y double, line_y0 double, line_y1 double")


def test_pagespans(spark):
    rows = [
        (1, 1, 0, 0, "42. Fe", 12.0, 63.0, 100.0, 496.4, 484.0, 502.0), (1, 1, 0, 1, "2+", 8.04, 100.0, 112.0, 491.8, 484.0, 502.0), (1, 1, 0, 2, " / Fe", 12.0, 112.0, 140.0, 496.4, 484.0, 502.0),
        (1, 1, 1, 0, "Statement II is correct", 12.0, 63.0, 200.0, 472.0, 460.0, 478.0),
        (1, 1, 2, 0, "(A) Zero", 12.0, 90.0, 230.0, 532.0, 520.0, 538.0), (1, 1, 2, 1, "(B) Half", 12.0, 270.0, 410.0, 532.0, 520.0, 538.0),
        (1, 1, 3, 0, "x", 12.0, 63.0, 70.0, 600.0, 590.0, 605.0), (1, 1, 3, 1, "q", 8.0, 70.0, 75.0, 596.0, 590.0, 605.0), (1, 1, 3, 2, "2", 8.0, 75.0, 80.0, 603.0, 590.0, 605.0),
        *[(1, p, 9, 0, "Footer", 9.0, 10.0, 50.0, 800.0, 790.0, 805.0) for p in (1, 2, 3)],
    ]
    df = spans(spark, rows)
    again = pagespans.repeating_lines(df)
    assert "Footer" in [r.text for r in again.collect()]
    found = pagespans.items(df, again.filter("text = 'Footer'"))
    assert [r.text for r in found.orderBy("page", "item").collect()] == ["Statement II is correct", "42. Fe²⁺ / Fe", "(A) Zero", "(B) Half", "x^{q}₂"]
    assert {r.align for r in pagespans.scripted(pagespans.segments(df)).filter("text = '2+'").collect()} == {"superscript"}
    text = [r.text for r in pagespans.blocks(pagespans.line_groups(found)).orderBy("ord").collect()]
    assert text == ["Statement II is correct", "42. Fe²⁺ / Fe", "(A) Zero (B) Half", "x^{q}₂"]
    assert pagespans.items(df.limit(0)).count() == 0


def test_layout(spark):
    df = spark.createDataFrame([("short",), ("x" * 200,), ("a\nb\n\nc",), (None,), ("",)], "t string")
    got = [round(r.h, 4) for r in df.select(layout.content_height(F.col("t"), 12.0, 18).alias("h")).collect()]
    assert got == [0.35, round(3 * 18 * 0.0185, 4), round(4 * 18 * 0.0185, 4), 0.35, 0.35]
    assert spark.range(1).select(layout.badge_width(F.lit("2025M, 1")).alias("w")).first().w == round(15 * (2 * 0.0045 + 1 * 0.005 + 1 * 0.0095 + 4 * 0.0078) + 0.36, 2)
    fits = spark.createDataFrame([({"A": "1", "B": "2", "C": "3", "D": "4"},), ({"A": "1", "B": "2", "C": "3", "D": "x" * 40},), ({"A": "1"},), (None,)], "o map<string,string>")
    assert [r.f for r in fits.select(layout.fits_one_row(F.col("o")).alias("f")).collect()] == [True, False, False, False]
    parts = spark.createDataFrame([(1, 1, i, f"c{i}", "t", 2.0) for i in range(7)], "doc_id bigint, q_seq int, comp_seq int, component_id string, text string, height double")
    pages = layout.paginated(parts)
    assert [(r.slide, r.y) for r in pages.orderBy("comp_seq").collect()] == [(1, 1.25), (1, 3.25), (2, 1.25), (2, 3.25), (3, 1.25), (3, 3.25), (4, 1.25)]
    assert [(r.slides, r.first_slide) for r in layout.slide_map(pages).collect()] == [(4, 2)]
    assert spark.range(1).select(layout.math_id(F.lit("1"), F.lit("block 14"), F.lit(0)).alias("m")).first().m == "Q01-BLOCK-BLOCK-14-MATH-001"
    known = spark.createDataFrame([("a",), ("b",)], "math_id string")
    seen = spark.createDataFrame([("a", "failed", 1), ("a", "ok", 2)], "math_id string, status string, seq int")
    assert {tuple(r) for r in layout.reconciled(known, seen).collect()} == {("a", "ok"), ("b", "failed")}


def test_page_blocks(spark):
    schema = "doc_id bigint, page bigint, line_no bigint, span_no bigint, text string, size double, x0 double, x1 double, y double, line_y0 double, line_y1 double"
    span = lambda page, line, text, x0, y, high=10.0: (1, page, line, 0, text, 12.0, x0, x0 + 20.0, y, y, y + high)
    rows = [span(page, 0, "Header", 10.0, 1.0) for page in (1, 2, 3, 4)] + [span(1, 1, "a", 50.0, 40.0), span(1, 2, "b", 50.0, 56.0), span(1, 3, "+ c", 90.0, 48.0), span(1, 4, "next line", 10.0, 90.0), span(2, 1, "other page", 10.0, 40.0)]
    spans = spark.createDataFrame(rows, schema)
    drawings = spark.createDataFrame([(1, 1, "line", 72.0, 53.0, 48.0, 53.5), (1, 1, "line", 0.0, 0.0, 0.0, 300.0), (1, 1, "rect", 0.0, 0.0, 500.0, 300.0), (1, 1, "line", 1.0, 80.0, 3.0, 80.0)], "doc_id bigint, page bigint, kind string, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in pagespans.rules(drawings).collect()] == [(1, 1, 48.0, 72.0, 52.25, 54.25)]
    got = pagespans.page_blocks(spans, drawings).orderBy("ord").collect()
    assert [(r.page, r.ord, r.block_id, r.text) for r in got] == [(1, 1, "1", "\\frac{a}{b} + c"), (1, 2, "2", "next line"), (2, 3, "3", "other page")]
    assert pagespans.page_blocks(spans.limit(0), drawings).count() == 0 and pagespans.page_blocks(spans).count() == 3
