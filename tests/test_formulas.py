import json

from pyspark.sql import functions as F

from inkwell.functions import chem
from inkwell.functions.mathtree import formulas, sequences, tree_latex
from inkwell.operators import geometry, layout
from inkwell.operators.nested import flatten_nodes
from inkwell.plans import text


def n(kind, *kids, value=None, **more):
    return {"kind": kind, "value": value, "children": list(kids)} | more


def leaf(v):
    return {"kind": "math_token", "value": v}


FRACTION = n("fraction", n("numerator", leaf("a")), n("denominator", n("radical", n("radicand", leaf("b")))))


def test_trees(spark):
    assert tree_latex(FRACTION) == r"\frac{a}{\sqrt{b}}"
    assert tree_latex(n("nary", n("lower_limit", leaf("0")), n("body", leaf("x")), formatting={"operator": "∫"})) == r"\int_{0} x"
    assert tree_latex(n("matrix", n("matrix_row", leaf("1"), leaf("2")), n("matrix_row", leaf("3")))) == r"\begin{matrix}1 & 2 \\ 3\end{matrix}"
    assert tree_latex(n("subsup", n("base", value="x"), n("subscript", leaf("1")), n("superscript", leaf("2")))) == "x_{1}^{2}"
    assert tree_latex({"kind": "fraction", "value": "$v$", "children": None}) == "v"
    cell = json.dumps([{"kind": "text", "value": "t"}, None, "s", n("group", n("math_sequence", FRACTION, n("math_sequence", leaf("in")))), n("math_sequence", leaf("z"))])
    assert sequences(cell) == [r"\frac{a}{\sqrt{b}}in", "z"] and sequences(None) == [] and sequences("[{") == []
    df = spark.createDataFrame([(1, None, None, cell, None), (2, None, None, None, None)], "block_uid bigint, children string, runs string, inline_content string, ingested_at timestamp")
    assert [r.f for r in df.select(formulas(F.col("inline_content")).alias("f")).collect()] == [[r"\frac{a}{\sqrt{b}}in", "z"], None]
    assert sorted(r.node_path for r in layout.outermost_formulas(flatten_nodes(df)).collect()) == ["inline_content[3].children[0]", "inline_content[4]"]


def test_geometry(spark):
    rows = [
        (1, 1, 0, "text", "a", 12.0, 10.0, 80.0, 20.0, 90.0), (1, 1, 0, "rule", None, None, 5.0, 94.0, 30.0, 96.0), (1, 1, 0, "text", "b", 12.0, 10.0, 100.0, 20.0, 110.0), (1, 1, 0, "text", "sin sin x . dx", 12.0, 60.0, 90.0, 90.0, 102.0),
        (1, 1, 1, "text", "√", 12.0, 10.0, 200.0, 18.0, 212.0), (1, 1, 1, "rule", None, None, 18.0, 198.0, 60.0, 199.0), (1, 1, 1, "text", "x+1", 12.0, 20.0, 201.0, 55.0, 212.0),
        (1, 1, 2, "text", "∫", 12.0, 10.0, 300.0, 16.0, 320.0), (1, 1, 2, "text", "1", 12.0, 18.0, 298.0, 22.0, 306.0), (1, 1, 2, "text", "0", 12.0, 18.0, 314.0, 22.0, 322.0), (1, 1, 2, "text", "f", 12.0, 40.0, 304.0, 46.0, 316.0),
        (1, 1, 3, "text", "x", 12.0, 10.0, 400.0, 16.0, 412.0), (1, 1, 3, "text", "2", 8.0, 16.0, 396.0, 20.0, 404.0), (1, 1, 3, "text", "y", 12.0, 30.0, 400.0, 36.0, 412.0),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, page bigint, line_group bigint, kind string, text string, size double, x0 double, y0 double, x1 double, y1 double")
    got = {r.line_group: r.text for r in geometry.lines(df).collect()}
    assert got == {0: r"\frac{a}{b} \sin x \,dx", 1: r"\sqrt{x+1}", 2: r"\int_{0}^{1} f", 3: "x ^{2} y"}
    assert geometry.lines(df.limit(0)).count() == 0


def test_badges(spark):
    rows = [("Why? (2020)", {"D": "x"}, [], True, False), ("Why?", {"D": "x (2019M)"}, None, True, True), ("Why? (2020)", None, ["(2021)", " "], False, False), ("Why?", None, None, None, None)]
    df = spark.createDataFrame(rows, "q string, o map<string,string>, a array<string>, p boolean, n boolean")
    assert [r.b for r in df.select(layout.badge(*[F.col(c) for c in "qoapn"]).alias("b")).collect()] == ["(2020)", "(2019M) · NEEDS REVIEW", "2021 · NEEDS REVIEW", None]
    t = spark.createDataFrame([("CCl4 Ca2+ [A] 2",), (None,)], "t string")
    assert [r.c for r in t.select(chem.isolated(F.col("t")).alias("c")).collect()] == ["CCl₄ Ca²⁺ [A]^{2}", None]


def test_nested_formulas(spark, sf, tmp_path):
    para = {"block_type": "paragraph", "inline_content": [{"kind": "text", "value": "t"}, n("math_sequence", FRACTION, n("math_sequence", leaf("in")))]}
    row = {"block_type": "table_row", "children": [{"block_type": "table_cell", "children": para}, None, {"block_type": "table_cell", "inline_content": n("math_sequence", leaf("y"))}]}
    cells = (json.dumps(json.dumps([row])), json.dumps([{"type": "math", "text": "math_sequence"}]), json.dumps([n("group", n("math_sequence", leaf("z")))]))
    df = spark.createDataFrame([(1, *cells, None), (1, *cells, None), (2, cells[0][:-9], None, None, None), (3, None, None, None, None)], "block_uid bigint, children string, runs string, inline_content string, ingested_at timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/document_blocks.parquet")
    got = [tuple(r) for r in text.q_formula_trees(spark, str(tmp_path)).orderBy("n").collect()]
    at = "children[0].children"
    assert got == [(1, 0, f"{at}[0].children[0].inline_content[1]", r"\frac{a}{\sqrt{b}}in"), (1, 1, f"{at}[2].inline_content[0]", "y"), (1, 2, "inline_content[0].children[0]", "z")]
    for d in (str(tmp_path), sf):  # the same formulas as by the intervals of the nodes, which have the runs that repeat them too
        trees, nodes = (sorted((r.block_uid, r.node_path) for r in q(spark, d).collect()) for q in (text.q_formula_trees, text.q_formula_nodes))
        assert trees == [x for x in nodes if not x[1].rpartition(".")[2].startswith("runs[")]
