"""Nested records to flat node tables, by interval labels.

Every node of a record gets its number in pre-order and in post-order of a depth-first walk. One node lies inside another
exactly if its pre number is larger and its post number smaller, so the parent links need no walk of their own: a single
pass over the nodes in pre-order with a stack of open intervals finds every parent (a merge join on containment).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import once_per, shuffle_parts

FIELDS = ("children", "runs", "inline_content")
#: Node types; each has its own table.
TYPES = ("block", "run", "inline", "text", "value")
NODE_SCHEMA = "block_uid bigint, node_type string, field string, idx int, pre int, post int, level int, parent_pre int, parent_path string, node_path string, label string, content string"
_ARROW = pa.schema([("block_uid", pa.int64()), ("node_type", pa.string()), ("field", pa.string()), ("idx", pa.int32()), ("pre", pa.int32()), ("post", pa.int32()), ("level", pa.int32()), ("parent_pre", pa.int32()), ("parent_path", pa.string()), ("node_path", pa.string()), ("label", pa.string()), ("content", pa.string())])
_SPACE = " \t\n\r"


def parse_deep(s: str):
    """json.loads without recursion, for texts nested deeper than the interpreter's stack."""
    n, i = len(s), 0
    opened: list = []  # containers not yet closed, with the pending key of an object
    scalar = json.JSONDecoder().raw_decode

    def skip(k: int) -> int:
        while k < n and s[k] in _SPACE:
            k += 1
        return k

    def key_at(k: int) -> tuple[str, int]:
        k = skip(k)
        if k >= n or s[k] != '"':
            raise ValueError("key")
        name, k = scanstring(s, k + 1, True)
        k = skip(k)
        if k >= n or s[k] != ":":
            raise ValueError("colon")
        return name, k + 1

    while True:
        i = skip(i)
        if i >= n:
            raise ValueError("end")
        c = s[i]
        if c == "[" or c == "{":
            k = skip(i + 1)
            closed = k < n and s[k] == ("]" if c == "[" else "}")
            value: object = [] if c == "[" else {}
            i = k + 1 if closed else i + 1
            if not closed:
                if c == "{":
                    name, i = key_at(i)
                    opened.append([value, name])
                else:
                    opened.append([value, None])
                continue
        else:
            value, i = scalar(s, i)
        while True:  # the value is whole: hand it to the container around it
            if not opened:
                if skip(i) != n:
                    raise ValueError("extra")
                return value
            box, name = opened[-1]
            if isinstance(box, list):
                box.append(value)
            else:
                box[name] = value
            i = skip(i)
            if i >= n:
                raise ValueError("end")
            if s[i] == ",":
                i += 1
                if isinstance(box, dict):
                    opened[-1][1], i = key_at(i)
                break
            if s[i] != ("]" if isinstance(box, list) else "}"):
                raise ValueError("separator")
            i += 1
            value = opened.pop()[0]


def read_cell(cell: str | None):
    """The JSON in a cell, also where the cell is a JSON string that holds JSON, however often that is so; None if it is no complete JSON."""
    value: object = cell
    while isinstance(value, str):
        if not value.strip():
            return None
        try:
            value = json.loads(value)
        except RecursionError:
            try:
                value = parse_deep(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value


def dumped(value) -> str:
    """JSON of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list = [value]  # values still to be written; tuples are text that is ready
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, dict):
            rest = [part for k, v in x.items() for part in ((", ",), (json.dumps(k, ensure_ascii=False) + ": ",), v)][1:]
            stack += [("}",), *reversed(rest), ("{",)]
        elif isinstance(x, list):
            rest = [part for v in x for part in ((", ",), v)][1:]
            stack += [("]",), *reversed(rest), ("[",)]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def label_record(cells: dict) -> list[tuple]:
    """(field, idx, pre, post, level, kind, label, content) of each node of one record, in pre-order; the record itself is pre 0, level 0."""
    nodes: list[list] = []
    pre = post = 0
    # entries: (node's position or -1, iterator over its elements)
    stack: list[tuple[int, Iterator, bool]] = [(-1, _elements(cells), False)]
    while stack:
        at, elements, inside = stack[-1]
        step = next(elements, None)
        if step is None:
            stack.pop()
            if at >= 0:
                nodes[at][3] = post
            post += 1
            continue
        field, idx, x = step
        pre += 1
        if isinstance(x, dict):
            kind = "run" if field == "runs" else "inline" if field == "inline_content" or inside or ("kind" in x and "block_type" not in x) else "block"
            label = x.get("block_type") if kind == "block" else x.get("type") if kind == "run" else x.get("kind")
            content = x.get("value") if kind == "inline" else x.get("text")
            nodes.append([field, idx, pre, 0, len(stack), kind, _text(label), _text(content)])
            stack.append((len(nodes) - 1, _elements(x), kind == "inline"))
        else:
            nodes.append([field, idx, pre, post, len(stack), "text" if isinstance(x, str) else "value", None, _text(x)])
            post += 1
    return nodes


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else dumped(x)


def _elements(holder: dict) -> Iterator:
    for field in FIELDS:
        value = holder.get(field)
        if isinstance(value, dict):
            yield field, 0, value
        elif isinstance(value, list):
            for i, x in enumerate(value):
                if x is not None:
                    yield field, i, x


def link(nodes: list) -> list[tuple[int, str, str]]:
    """(pre of the parent, its path, own path) of each node, from the interval labels alone; nodes come in pre-order."""
    out = []
    open_: list[tuple[int, int, str]] = []  # (post, pre, path) of the intervals around the next node
    for n in nodes:
        while open_ and open_[-1][0] < n[3]:
            open_.pop()
        parent, path = (open_[-1][1], open_[-1][2]) if open_ else (0, "")
        own = f"{path}.{n[0]}[{n[1]}]" if path else f"{n[0]}[{n[1]}]"
        out.append((parent, path, own))
        open_.append((n[3], n[2], own))
    return out


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(_ARROW)

    def packed(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

    for batch in batches:
        columns: list[list] = [[] for _ in range(width)]
        rows = zip(*(batch.column(name).to_pylist() for name in ("block_uid", *FIELDS)), strict=True)
        for uid, *cells in rows:
            nodes = label_record({f: read_cell(c) for f, c in zip(FIELDS, cells, strict=True)})
            for n, (parent, path, own) in zip(nodes, link(nodes), strict=True):
                for column, value in zip(columns, (uid, n[5], n[0], n[1], n[2], n[3], n[4], parent, path, own, n[6], n[7]), strict=True):
                    column.append(value)
            if len(columns[0]) >= 20_000:
                yield packed(columns)
                columns = [[] for _ in range(width)]
        if columns[0]:
            yield packed(columns)


def flatten_nodes(blocks: DataFrame) -> DataFrame:
    """A row for each nested node of each record, NODE_SCHEMA.

    blocks needs block_uid, ingested_at and the three JSON cells; other columns are ignored, whatever their names.
    Repeated records count once (the earliest by ingested_at); records with a null block_uid are told apart by their cells.
    Null, empty and incomplete cells give no rows; an object in place of an array is its element 0; null elements keep
    their index and give no row; strings, numbers and arrays as elements are nodes without children. Any depth is read.
    """
    has = F.lit(False)
    for f in FIELDS:
        has = has | (F.length(F.trim(F.col(f))) > 2) & (F.trim(F.col(f)) != "null")
    kept = blocks.select("block_uid", *FIELDS, "ingested_at").filter(has)
    kept = once_per(kept, "block_uid", ["ingested_at", *FIELDS]).select("block_uid", *FIELDS)
    return kept.mapInArrow(_flatten, NODE_SCHEMA)


def node_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table per node type; rows link to their parents through (block_uid, parent_pre), to any ancestor through the intervals."""
    return {t: nodes.filter(F.col("node_type") == t).drop("node_type") for t in TYPES}


def inside(ancestors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with the innermost of the ancestors whose interval holds it; one row per node, ancestor_pre null if there is none.

    One pass over both in pre-order, with a stack of the intervals that are open. Nodes of records without an id have no ancestor.
    """
    kinds = dict(nodes.dtypes)
    absent = [F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in ("block_uid", "pre", "post", "node_path")]
    both = nodes.withColumn("__held", F.lit(True)).unionByName(ancestors.select("block_uid", "pre", "post", "node_path", *absent, F.lit(False).alias("__held")))
    n = shuffle_parts(nodes.sparkSession)
    ordered = both.repartition(n, "block_uid", F.when(F.col("block_uid").isNull(), F.col("pre"))).sortWithinPartitions("block_uid", "pre", F.desc("__held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, []
        for batch in batches:
            pres, paths = [], []
            held = batch.column("__held").to_pylist()
            for uid, pre, post, path, is_node in zip(*(batch.column(c).to_pylist() for c in ("block_uid", "pre", "post", "node_path")), held, strict=True):
                if uid != last or uid is None:
                    last, open_ = uid, []
                while open_ and open_[-1][1] < post:
                    open_.pop()
                if is_node:
                    top = next((o for o in reversed(open_) if o[0] < pre), (None, None, None))
                    pres.append(top[0])
                    paths.append(top[2])
                else:
                    open_.append((pre, post, path))
            kept = batch.filter(batch.column("__held")).drop_columns(["__held"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(pres, pa.int32()), pa.array(paths, pa.string())], names=[*kept.schema.names, "ancestor_pre", "ancestor_path"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    return ordered.mapInArrow(run, f"{schema}, ancestor_pre int, ancestor_path string")
