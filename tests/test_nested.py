import datetime as dt
import json

from inkwell.operators.nested import dumped, flatten_nodes, inside, node_tables, parse_deep, read_cell

SCHEMA = "block_uid bigint, children string, runs string, inline_content string, ingested_at timestamp, parent_path string, pre int"
T = dt.datetime(2024, 1, 1)


def brute(cells):
    out = []

    def walk(holder, path):
        for f in ("children", "runs", "inline_content"):
            v = holder.get(f)
            v = [v] if isinstance(v, dict) else v if isinstance(v, list) else []
            for i, x in enumerate(v):
                if x is not None:
                    own = f"{path}.{f}[{i}]" if path else f"{f}[{i}]"
                    out.append((path, own))
                    if isinstance(x, dict):
                        walk(x, own)

    walk({f: read_cell(c) for f, c in cells.items()}, "")
    return out


def test_cases(spark):
    deep = {"kind": "text"}
    for _ in range(30):
        deep = {"kind": "g", "children": [None, deep, "s", 3]}
    rows = [
        (1, json.dumps([{"children": {"block_type": "x", "runs": ["a", None, {"text": "b"}]}}, None, "plain"]), None, "", T, "clash", 7),
        (1, json.dumps([{"children": {"block_type": "x", "runs": ["a", None, {"text": "b"}]}}, None, "plain"]), None, "", T.replace(day=2), "clash", 8),
        (2, '[{"a": 1}', json.dumps({"text": "one"}), json.dumps(json.dumps([deep])), T, None, None),
        (3, None, None, None, None, None, None),
        (4, "null", "[]", " ", T, None, None),
        (None, None, '["x"]', None, None, None, None),
        (5, "[[1,[2]], true, 0, \"\"]", '"not json inside"', "7", T, None, None),
    ]
    got = flatten_nodes(spark.createDataFrame(rows, SCHEMA)).collect()
    want = set()
    for r in rows:
        want |= {(r[0], *x) for x in brute({"children": r[1], "runs": r[2], "inline_content": r[3]})}
    assert sorted(map(str, ((r.block_uid, r.parent_path, r.node_path) for r in got))) == sorted(map(str, want))
    for a in got:
        for b in got:
            if a.block_uid == b.block_uid and a.block_uid is not None:
                holds = a.pre < b.pre and a.post > b.post
                assert holds == b.node_path.startswith(a.node_path + "."), (a, b)
    assert flatten_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_text(spark):
    n = 20_000
    text = '[{"children":' * n + "[1]" + "}]" * n
    assert parse_deep('{"a": [1, {"b": []}, "x\\n"], "c": null}') == {"a": [1, {"b": []}, "x\n"], "c": None}
    assert len(flatten_nodes(spark.createDataFrame([(1, text[: 13 * 300] + "[1]" + "}]" * 300, None, None, T, None, None)], SCHEMA)).collect()) == 301
    value = read_cell(text)
    for _ in range(n):
        value = value[0]["children"]
    assert value == [1]
    for bad in ("[1", '{"a"', "[1,]", "[1] 2", '{"a":}'):
        assert read_cell(bad) is None


def test_strings_in_strings_and_deep_content(spark):
    cell = json.dumps([{"text": "in"}])
    for _ in range(6):
        cell = json.dumps(cell)
    assert read_cell(cell) == [{"text": "in"}] and read_cell('"only text"') is None and read_cell('" "') is None
    n = 20_000
    deep = "[" + "[" * n + '"x"' + "]" * n + ', {"a": {"b": [1, null, "é"]}}]'
    rows = flatten_nodes(spark.createDataFrame([(1, cell, deep, None, T, None, None)], SCHEMA)).collect()
    assert {r.node_path: r.content for r in rows} == {"children[0]": "in", "runs[0]": "[" * n + '"x"' + "]" * n, "runs[1]": None}
    value = {"a": [1, {"b": []}, [], {}, None, "é"], "c": 1.5}
    assert dumped(parse_deep("[" * n + json.dumps(value) + "]" * n)) == "[" * n + json.dumps(value, ensure_ascii=False) + "]" * n


def test_inside(spark):
    cell = json.dumps([{"block_type": "row", "children": [{"block_type": "cell", "inline_content": [{"kind": "g", "children": [{"kind": "text"}]}]}]}])
    nodes = flatten_nodes(spark.createDataFrame([(1, cell, '[{"text":"r"}]', None, T, None, None)], SCHEMA))
    tables = node_tables(nodes)
    held = {r.node_path: r.ancestor_path for r in inside(tables["block"], nodes).collect()}
    assert held["children[0].children[0].inline_content[0].children[0]"] == "children[0].children[0]"
    assert held["children[0].children[0]"] == "children[0]" and held["runs[0]"] is None
    assert sum(t.count() for t in tables.values()) == nodes.count()


def test_inside_of_wide_and_nameless_records(spark):
    cell = json.dumps([{"block_type": "row", "children": [{"block_type": "cell"}, {"runs": ["a"]}]}] * 40)
    nodes = flatten_nodes(spark.createDataFrame([(1, cell, None, None, T, None, None), (2, cell, None, None, T, None, None), (None, cell, None, None, T, None, None)], SCHEMA))
    got = inside(node_tables(nodes)["block"], nodes).collect()
    assert len(got) == nodes.count()
    assert all(r.ancestor_path == (None if r.block_uid is None else r.parent_path or None) for r in got)
    assert inside(nodes.limit(0), nodes.limit(0)).count() == 0
