import datetime as dt
import json

from inkwell.operators.pipeline import blocks_of, build

T = dt.datetime(2024, 1, 1)


def test_tables_and_inline_nodes(spark):
    def cell(i, text, *items):
        return {"block_id": i, "block_type": "table_cell", "text": text, "children": [{"block_id": i + 100, "block_type": "paragraph", "text": "below", "inline_content": list(items)}]}

    head = {"block_id": 1, "block_type": "table_row", "children": [cell(2, " é "), cell(3, None, {"kind": "math_sequence", "value": "x"}, "s")]}
    first = json.dumps(json.dumps([head, None, {"block_type": "table_row", "children": ["(a) plain", None, cell(5, "II. Find d")]}]))
    rows = [
        (1, 7, 1, "b1", "paragraph", "1. Use the table.", None, json.dumps({"kind": "text", "value": "1. Use"})), (2, 7, 2, "b2", "table", None, first, None), (3, 7, 5, "b3", "table", " ", json.dumps(head), "[{"),
        (4, 7, 9, "b4", "paragraph", "(A) one (B) two (C) three (D) four", "[]", json.dumps([{"kind": "text", "value": "(A)"}, {"kind": "image"}])), (5, 7, 12, "b5", "paragraph", "2. None here?", None, None),
    ]
    rows = [(*r, T) for r in rows] + [(*rows[1], T.replace(day=2))]
    df = spark.createDataFrame(rows, "block_uid bigint, file_id bigint, ord int, block_id string, block_type string, text string, children string, inline_content string, ingested_at timestamp")
    q = {r.q_seq: r for r in build(blocks_of(df)).questions.collect()}
    assert set(q) == {1, 2} and q[2].table is None and q[2].inline_content is None
    t = q[1].table
    assert t.headers == ["é", "below"] and t.rows == [["é", "below"], ["(a) plain", "II. Find d"]] and t.source_block_ids == ["b2"]
    assert [json.loads(x) for x in t.cell_content[0][1].inline_content] == [{"kind": "math_sequence", "value": "x", "source_block_id": "3", "inline_index": 0}, {"kind": "text", "value": "s", "source_block_id": "3", "inline_index": 1}]
    assert [x.rows for x in q[1].tables] == [t.rows, [["é", "below"]]]
    assert [(n.source_block_id, n.source_order, n.inline_index, json.loads(n.node)["kind"]) for n in q[1].inline_content] == [("b1", 1, 0, "text"), ("b4", 9, 1, "text"), ("b4", 9, 2, "image")]
