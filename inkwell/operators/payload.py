"""Nested content of question records: the tables with their cells, and the inline nodes of the source paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.nested import dumped, read_cell

TABLE = "struct<headers:array<string>,rows:array<array<string>>,cell_content:array<array<struct<text:string,source_block_id:string,inline_content:array<string>>>>,source_block_ids:array<string>>"


def _each(holder, field: str) -> list:
    """The elements of a field; an object in place of an array is its only element."""
    value = holder.get(field) if isinstance(holder, dict) else None
    return [x for x in value if x is not None] if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _id(block) -> str | None:
    return None if not isinstance(block, dict) or block.get("block_id") is None else str(block["block_id"])


def _text(block) -> str:
    """The text of a cell; where it has none, those of its blocks, each on a line. A plain string is its own text."""
    if not isinstance(block, dict):
        return str(block).strip()
    own = block.get("text")
    return (own if isinstance(own, str) and own.strip() else "\n".join(filter(None, map(_text, _each(block, "children"))))).strip()


def inline_items(block) -> list[dict]:
    return [dict(x) if isinstance(x, dict) else {"kind": "text", "value": str(x)} for x in _each(block, "inline_content")]


def table_of(children, block_id: str | None) -> dict:
    """Headers, rows and cell content of a table; the headers are the first row, which stands in the rows too."""
    rows, rich = [], []
    for row in _each({"children": children}, "children"):
        cells = _each(row, "children") if isinstance(row, dict) else [row]
        kept = []
        for cell in cells:
            items = [x for child in _each(cell, "children") for x in inline_items(child)] or inline_items(cell)
            for i, x in enumerate(items):
                x.setdefault("source_block_id", _id(cell))
                x["inline_index"] = i
            kept.append({"text": _text(cell), "source_block_id": _id(cell), "inline_content": [dumped(x) for x in items]})
        rows.append([c["text"] for c in kept])
        rich.append(kept)
    return {"headers": rows[0] if rows else [], "rows": rows, "cell_content": rich, "source_block_ids": [block_id]}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        tables, items = [], []
        for kind, block_id, children, inline in zip(b["block_type"], b["block_id"], b["children"], b["inline_content"], strict=True):
            tables.append(dumped(table_of(read_cell(children), block_id)) if kind == "table" else None)
            items.append([dumped(x) for x in inline_items({"inline_content": read_cell(inline)})])
        yield pd.DataFrame({"doc_id": b["doc_id"], "block_id": b["block_id"], "ord": b["ord"], "table_json": tables, "items": items})


def attached(q: DataFrame, blocks: DataFrame) -> DataFrame:
    """q with tables (all of a question's, in order), table (the first) and inline_content (the nodes of each source paragraph once, with source and place).

    blocks: doc_id, ord, block_id, block_type, and the JSON cells children and inline_content.
    """
    some = blocks.filter("block_type = 'table' or length(inline_content) > 2").select("doc_id", F.col("block_id").cast("string").alias("block_id"), F.col("ord").cast("bigint").alias("ord"), "block_type", "children", "inline_content")
    kind = dict(some.dtypes)["doc_id"]
    read = some.mapInPandas(_read, f"doc_id {kind}, block_id string, ord bigint, table_json string, items array<string>")
    owned = q.select("doc_id", "q_seq", F.posexplode("owners").alias("at", "block_id")).join(read, ["doc_id", "block_id"])
    xs = F.array_sort(F.collect_list(F.struct("at", "ord", "block_id", "table_json", "items"))).alias("xs")
    got = owned.groupBy("doc_id", "q_seq").agg(xs)
    tables = F.transform(F.filter("xs", lambda x: x["table_json"].isNotNull()), lambda x: F.from_json(x["table_json"], TABLE))
    nodes = F.flatten(F.transform("xs", lambda x: F.transform(x["items"], lambda i: F.struct(x["block_id"].alias("source_block_id"), x["ord"].alias("source_order"), i.alias("node")))))
    nodes = F.transform(nodes, lambda n, i: F.struct(n["source_block_id"].alias("source_block_id"), n["source_order"].alias("source_order"), i.alias("inline_index"), n["node"].alias("node")))
    got = got.select("doc_id", "q_seq", tables.alias("tables"), nodes.alias("inline_content"))
    return q.join(got, ["doc_id", "q_seq"], "left").withColumn("table", F.get("tables", F.lit(0)))
