from inkwell.functions.linetext import parse_lines, parse_raw
from inkwell.operators import lineparse
from inkwell.operators.lineparse import parsed

FOUR = "(A) one (B) two (C) three (D) four"


def run(spark, docs):
    df = spark.createDataFrame([(d, i, t, "x") for d, ls in docs.items() for i, t in enumerate(ls)], "doc_id bigint, ord int, line string, section string").repartition(4)
    return {(r.doc_id, r.q_seq, r.part): r for r in parsed(df).collect()}


def test_documents(spark):
    q = run(spark, {
        1: ["Section A", "1. Pick one (A) 1 (B) 2 (C) 3 (D) 4", "2. If more than 0.9% is used here", FOUR, None, "", "Join our channel"],
        2: ["1. a?", FOUR, "What is the next? (2020)", FOUR],
        3: ["Short Answer Questions", "Define mass. (2019)", "State the law. (2020)"],
        4: [],
    })
    assert q[1, 1, 0].options["C"] == "3" and q[1, 1, 0].section == "Section A" and q[1, 2, 0].question == "If more than 0.9% is used here" and (1, 3, 0) not in q
    assert q[2, 2, 0].question == "What is the next? (2020)" and q[2, 2, 0].parsed_ok
    assert [q[3, i, 0].question_type for i in (1, 2)] == ["open", "open"]
    assert run(spark, {}) == {}


def test_records():
    assert parse_lines(["Match: (A) p (B) q (C) r (D) s", "(A) 1-B (B) 2-A (C) 3-C (D) 1-D"])[0]["question_type"] == "match_the_column"
    bad = parse_lines(["x (A) alpha (B) beta (C) gamma (D) delta (D) again"])
    assert not bad[0]["parsed_ok"] and bad[0]["question"] is None
    got = parse_lines(["1. Which? (A) a (B) b (C) c (D) four Surface Chemistry:"])
    assert got[0]["options"]["D"] == "four" and got[1] | {"options": 0} == {"question": "Surface Chemistry", "question_type": "divider", "parsed_ok": True, "options": 0}
    assert parse_lines(["Solutions"])[0]["question_type"] == "divider" and not parse_lines(["of no kind at all"])[0]["parsed_ok"]


def test_raw():
    r = parse_raw("For: Boards 2020\nElectrochemistry:\n(D) stray\n12. Which cell?\n(A) 𝐾 one\nwrapped\n(B) two\n(C) three")
    assert r == {"stem": "12. Which cell?", "options": {"A": "K one wrapped", "B": "two", "C": "three", "D": "stray"}, "chapter": "Electrochemistry", "spill": {}, "leftovers": ["2020"]}
    r = parse_raw("(A) early\n1. x\n(A) a\nIdentify:\n(B) b")
    assert r["spill"] == {"A": "early"} and r["options"] == {"A": "a Identify:", "B": "b"} and parse_raw("")["options"] == {}


def test_raw_rows(spark):
    raw = "For: Boards\nOptics and Waves:\n(C) early\nQ7) Which lens?\n(A) thin\nand flat\n(B) thick"
    rows = spark.createDataFrame([(1, raw, "x"), (2, None, "x"), (3, "no number\n(A) x", "x"), (4, "1. stem\n" + "(A) a\n" + "wrapped\n" * 20_000, "x")], "id bigint, t string, stem string")
    got = {r.id: r for r in lineparse.parsed_raw(rows, "id", "t").collect()}
    assert (got[1].stem, got[1].options, got[1].chapter, got[1].spill, got[1].leftovers) == ("Q7) Which lens?", {"A": "thin and flat", "B": "thick", "C": "early"}, "Optics and Waves", {}, [])
    assert got[2].stem == "" and got[2].options == {} and got[3].stem == "no number\n(A) x" and got[4].options["A"].count("wrapped") == 20_000
    assert lineparse.parsed_raw(rows.limit(0), "id", "t").count() == 0
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["1. Which? (A) a (B) b (C) c (D) d", "2. of no kind"])], "doc_id bigint, ord int, line string")
    good, bad = lineparse.outcomes(lineparse.parsed(lines))
    assert [r.q_seq for r in good.collect()] == [1] and [r.q_seq for r in bad.collect()] == [2]
