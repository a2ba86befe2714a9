"""Formulas of a page rebuilt from where their parts stand: roots, fractions and integrals of one line group.

items: doc_id, page, line_group, kind (text or rule), text, size, x0, y0, x1, y1. A group is one line of a page, so it is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import strip

SIDE, EDGE, NEAR = 15.0, 5.0, 3.0


@dataclass
class Box:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    size: float = 0.0


def _line(boxes: list[Box]) -> str:
    return "".join(b.text for b in sorted(boxes, key=lambda b: b.x0))


def _around(rule: Box, texts: list[Box]) -> tuple[list[Box], list[Box], list[Box]]:
    """Texts above, below and beside a rule."""
    sides: tuple[list[Box], list[Box], list[Box]] = ([], [], [])
    for t in texts:
        under = rule.x0 - SIDE <= (t.x0 + t.x1) / 2 <= rule.x1 + SIDE
        sides[0 if under and t.y1 <= rule.y0 + EDGE else 1 if under and t.y0 >= rule.y1 - EDGE else 2].append(t)
    return sides


def _upper(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def rebuilt(texts: list[Box], rules: list[Box]) -> str:
    """One line of text with LaTeX for what was drawn."""
    sized = [t.size for t in texts if t.size]
    if len(texts) > 1 and sized:
        size, base = _upper(sized), _upper([t.y1 for t in texts])
        for t in texts:
            off = t.y1 - base if 0 < t.size < 0.85 * size else 0
            if abs(off) > 0.2 * size:
                t.text = f"{'^' if off < 0 else '_'}{{{t.text}}}"
    open_rules = []
    for rule in rules:
        root = next((t for t in texts if "√" in t.text and abs(t.x1 - rule.x0) < SIDE), None)
        above, below, beside = _around(rule, [t for t in texts if t is not root])
        if above or not below or root is None:
            open_rules.append(rule)
            continue
        texts = [*beside, Box(f"\\sqrt{{{_line(below)}}}", root.x0, min(t.y0 for t in below), rule.x1, max(t.y1 for t in below))]
    for rule in open_rules:
        above, below, beside = _around(rule, texts)
        if above and below:
            texts = [*beside, Box(f"\\frac{{{_line(above)}}}{{{_line(below)}}}", rule.x0, min(t.y0 for t in above), rule.x1, max(t.y1 for t in below))]
    for sign in [t for t in texts if "∫" in t.text]:
        middle = (sign.y0 + sign.y1) / 2
        close = [t for t in texts if t is not sign and 0 <= t.x0 - sign.x1 <= SIDE]
        high = next((t for t in close if t.y1 <= middle + NEAR), None)
        low = next((t for t in close if t is not high and t.y0 >= middle - NEAR), None)
        if high or low:
            sign.text = "\\int" + (f"_{{{low.text}}}" if low else "") + (f"^{{{high.text}}}" if high else "")
            texts = [t for t in texts if t is not high and t is not low]
    return " ".join(t.text for t in sorted(texts, key=lambda t: t.x0))


def clean_text(text: Column) -> Column:
    """Names of functions as commands, '. dx' as a thin space and dx, single spaces."""
    names = "sin|cos|tan|cot|sec|cosec|csc|log|ln"
    t = F.regexp_replace(text, rf"\b({names})\s+\1\b", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\b(?:cosec|csc)\b", r"\\operatorname{cosec} "), r"(?<!\{)\b(sin|cos|tan|cot|sec|log|ln)\b", r"\\$1 ")
    return strip(F.regexp_replace(F.regexp_replace(t, r"\. ?dx", r"\\,dx"), "  +", " "))


def lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_group, text): every group as one line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for xs in b["xs"]:
                boxes = [(x["kind"], Box(x["text"] or "", float(x["x0"]), float(x["y0"]), float(x["x1"]), float(x["y1"]), float(x["size"] or 0))) for x in xs]
                texts.append(rebuilt([t for k, t in boxes if k == "text"], [r for k, r in boxes if k == "rule"]))
            yield b[["doc_id", "page", "line_group"]].assign(text=texts)

    parts = F.struct("x0", "y0", "x1", "y1", "kind", "text", "size")
    held = items.groupBy("doc_id", "page", "line_group").agg(F.array_sort(F.collect_list(parts)).alias("xs"))
    got = held.mapInPandas(run, "doc_id bigint, page bigint, line_group bigint, text string")
    return got.withColumn("text", clean_text(F.col("text")))
