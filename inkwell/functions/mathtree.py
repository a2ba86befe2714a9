"""Formula trees (inline content) as LaTeX: one template per kind, filled with the operands by role."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.operators.nested import FIELDS, _elements, read_cell

# How each kind is written; {role} is an operand.
TEMPLATES = {
    "fraction": (r"\frac{%s}{%s}", ("numerator", "denominator")),
    "superscript": ("%s^{%s}", ("base", "superscript")),
    "subscript": ("%s_{%s}", ("base", "subscript")),
    "subsup": ("%s_{%s}^{%s}", ("base", "subscript", "superscript")),
    "function": ("%s %s", ("function_name", "argument")),
}
OPERATORS = {"∫": r"\int", "∑": r"\sum", "∏": r"\prod"}


ROLES = {"radical": ("degree", "radicand"), "nary": ("lower_limit", "upper_limit", "body")} | {k: roles for k, (_, roles) in TEMPLATES.items()}


def _below(node: dict) -> list[dict]:
    return [c for c in node["children"] if isinstance(c, dict)] if isinstance(node.get("children"), list) else []


def _operands(node: dict) -> list[dict | str]:
    """What a node's LaTeX is made of: for kinds with roles the first node under each role (or the role's value), for others all children."""
    kids, out = _below(node), []
    roles = ROLES.get(node.get("kind") or "")
    if not roles:
        return kids
    for role in roles if kids else ():
        found = next((c for c in kids if c.get("kind") == role), {})
        out.append(next(iter(_below(found)), str(found.get("value") or "")))
    return out


def _filled(node: dict, parts: list[str]) -> str:
    kind = node.get("kind") or ""
    if kind in TEMPLATES and parts:
        return TEMPLATES[kind][0] % tuple(parts)
    if kind == "radical" and parts:
        return rf"\sqrt[{parts[0]}]{{{parts[1]}}}" if parts[0] else rf"\sqrt{{{parts[1]}}}"
    if kind == "nary" and parts:
        sign = str((node.get("formatting") or {}).get("operator") or "∑")
        low, high, body = parts
        return OPERATORS.get(sign, sign) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f" {body}"
    if kind == "matrix_row":
        return " & ".join(parts)
    if kind in ("matrix", "equation_array"):
        return r"\begin{matrix}" + r" \\ ".join(parts) + r"\end{matrix}"
    return "".join(parts) or str(node.get("value") or "").strip().strip("$")


def tree_latex(node: dict) -> str:
    """LaTeX of one node, of any depth; nodes of no known kind are their children in order, or their value."""
    stack: list[tuple[dict, Iterator, list[str]]] = [(node, iter(_operands(node)), [])]
    while True:
        own, waiting, parts = stack[-1]
        step = next(waiting, None)
        if isinstance(step, dict):
            stack.append((step, iter(_operands(step)), []))
        elif step is not None:
            parts.append(step)
        else:
            stack.pop()
            if not stack:
                return _filled(own, parts)
            stack[-1][2].append(_filled(own, parts))


def sequences(cell: str | None) -> list[str]:
    """LaTeX of the outermost formulas of an inline_content cell, in order."""
    value = read_cell(cell)
    waiting = [value] if isinstance(value, dict) else list(value) if isinstance(value, list) else []
    out = []
    waiting.reverse()
    while waiting:
        node = waiting.pop()
        if not isinstance(node, dict):
            continue
        if node.get("kind") == "math_sequence":
            out.append(tree_latex(node))
        elif isinstance(node.get("children"), list):
            waiting += reversed(node["children"])
        elif isinstance(node.get("children"), dict):
            waiting.append(node["children"])
    return out


def formulas(inline_content: Column) -> Column:
    """LaTeX of the outermost formulas of a cell; only cells that name a formula cross into Python."""
    some = inline_content.contains("math_sequence")
    udf = F.pandas_udf(lambda s: s.map(sequences, na_action="ignore"), "array<string>")
    return F.when(some, udf(F.when(some, inline_content)))


def placed(cells: dict) -> list[tuple[str, str]]:
    """(node_path, LaTeX) of the outermost formulas anywhere in a record's cells, in the order of the nodes."""
    out = []
    stack = [("", _elements(cells))]
    while stack:
        path, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            continue
        field, idx, x = step
        own = f"{path}.{field}[{idx}]" if path else f"{field}[{idx}]"
        if isinstance(x, dict):
            if x.get("kind") == "math_sequence" and field != "runs":
                out.append((own, tree_latex(x)))
            else:
                stack.append((own, _elements(x)))
    return out


def _placed(cells: pd.DataFrame) -> pd.Series:
    rows = zip(*(cells[f] for f in FIELDS), strict=True)
    return pd.Series([[{"node_path": p, "latex": x} for p, x in placed({f: read_cell(c) for f, c in zip(FIELDS, row, strict=True)})] for row in rows], dtype=object)


def placed_formulas() -> Column:
    """(node_path, latex) of the outermost formulas in the three JSON cells of a block."""
    return F.pandas_udf(_placed, "array<struct<node_path:string,latex:string>>")(F.struct(*FIELDS))


def readable(latex: pd.Series) -> pd.Series:
    from inkwell.functions.latex import to_readable

    return latex.map(to_readable, na_action="ignore")
