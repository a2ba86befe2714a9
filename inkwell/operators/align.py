"""Components of a question held against the inline nodes of its source paragraphs.

What is printed (stem, statements, subparts, options) was cut and cleaned on the way; the nodes still have their formulas and formats.
A component and a row of nodes are folded to one form that forgets scripts, braces and spaces around operators; where the
component is found in it, the nodes under that stretch are the component's own. Where it is not found, the plain text is used and that is said.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.nested import dumped
from inkwell.session import shuffle_parts

# Letters with raised and lowered forms, operators that need no space, citations, labels.
LOWERED = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ", "0123456789+-=()aehijklmnoprstuvx", strict=True))
RAISED = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾", "0123456789+-=()", strict=True))
OPERATORS = "=+-×*/<>"
CITATION = r"\s*(?:\[[^\]]*(?:19|20)\d{2}[^\]]*\]|\([^)]*(?:19|20)\d{2}[^)]*\))\s*"
ITEM_LABEL = r"^\s*(?:(?:Statement\s*)?[A-Ea-eIVXivx1-5]+)[.):]\s*"
OPTION_LABEL = r"(?i)(?<![A-Za-z0-9])([A-D])\s*[.)]\s*"

_PLAIN = str.maketrans(LOWERED | RAISED | {"−": "-"})
_DOWN, _UP = ({ord(b): a for a, b in t.items()} for t in (LOWERED, RAISED | {"⁻": "−"}))
_CITATION, _ITEM, _LABEL = re.compile(CITATION), re.compile(ITEM_LABEL), re.compile(OPTION_LABEL)
_PRINTED = re.compile(r"^\([A-Z]\) ")  # as layout.components writes options
_LEXEMES = re.compile(r"(?P<mark>\\?[_^]\s*)(?:\{(?P<inside>[^{}]*)\})?|(?P<space>\s+)|(?P<plain>[^\s_^\\]+|\\)")


def shown(node: dict) -> str:
    """A node's text, scripts with their own signs where there are any."""
    if node.get("kind") == "line_break":
        return "\n"
    value = str(node.get("value") or "")
    return value.translate({"subscript": _DOWN, "superscript": _UP}.get(node.get("vertical_align"), {}))


def folded(text: str) -> tuple[str, list[int]]:
    """The text in the form in which texts are compared, and where each of its characters stands in the text."""
    chars: list[str] = []
    at: list[int] = []

    def put(piece: str, start: int) -> None:
        for k, c in enumerate(piece.translate(_PLAIN)):
            if c.isspace():
                gap(start + k)
            else:
                if c in OPERATORS and chars and chars[-1] == " ":
                    chars.pop()
                    at.pop()
                chars.append(c)
                at.append(start + k)

    def gap(start: int) -> None:
        if chars and chars[-1] != " " and chars[-1] not in OPERATORS:
            chars.append(" ")
            at.append(start)

    for m in _LEXEMES.finditer(text):
        if m["space"]:
            gap(m.start())
        elif m["plain"]:
            put(m["plain"], m.start())
        elif m["inside"] is not None:
            put(m["inside"], m.start("inside"))
    if chars and chars[-1] == " ":
        chars.pop()
        at.pop()
    return "".join(chars), at


def found(text: str, part: str) -> tuple[int, int] | None:
    """Where a part stands in a text, as (from, to) in the text itself."""
    (whole, at), (wanted, _) = folded(text), folded(part)
    k = whole.find(wanted) if wanted else -1
    return None if k < 0 else (at[k], at[k + len(wanted) - 1] + 1)


def cut(nodes: list[dict], start: int, end: int) -> list[dict] | None:
    """The nodes under a stretch of their joint text; texts may be cut, anything else must lie inside whole."""
    out, at = [], 0
    for n in nodes:
        text = shown(n)
        low, high = max(start, at), min(end, at + len(text))
        if low < high:
            if high - low < len(text):
                if n.get("kind") != "text":
                    return None
                n = n | {"value": text[low - at : high - at]}
            out.append(n)
        at += len(text)
    return out


def _joined(groups: list[list[dict]]) -> list[dict]:
    """Rows of nodes one after the other, with a line break between."""
    out: list[dict] = []
    for g in groups:
        out += ([{"kind": "line_break", "source_block_id": g[0].get("source_block_id")}] if out else []) + g
    return out


def _rows(component: str, groups: dict[str, list[dict]], roles: dict[str, str]) -> Iterator[list[dict]]:
    """Rows of nodes in which a component is looked for, likeliest first: all paragraphs of its role, its own paragraph, each of its role, every other, and all."""
    role = "option" if component.startswith("option:") else "stem"
    ours = [g for key, g in groups.items() if roles.get(key) == role]
    if ours:
        yield _joined(ours)
    own = own_block(component, roles)
    if own is not None and (g := groups.get(own) or groups.get(own.split(".part_")[0])):
        yield g
    yield from ours
    yield from (g for key, g in groups.items() if roles.get(key) != role)
    yield _joined(list(groups.values()))


def own_block(component: str, roles: dict[str, str]) -> str | None:
    """The source block of a component: the option block of its letter, or else the first stem block."""
    options, stems = ([k for k, r in roles.items() if r == role] for role in ("option", "stem"))
    if component.startswith("option:"):
        k = ord(component[7:8].upper() or "@") - ord("A")
        if 0 <= k < len(options):
            return options[k]
    return stems[0] if stems else None


def _view(row: str, component: str) -> tuple[int, int]:
    """The part of a row's text where an option may stand: behind its letter, up to the next one."""
    if component.startswith("option:"):
        labels = list(_LABEL.finditer(row))
        for k, m in enumerate(labels):
            if m[1].upper() == component[7:8].upper():
                return m.end(), labels[k + 1].start() if k + 1 < len(labels) else len(row)
    return 0, len(row)


def align(component: str, text: str, nodes: list[dict], roles: dict[str, str]) -> list[dict] | None:
    """The nodes of a component, or None. nodes come in order with their source_block_id; roles is the role of each source block."""
    if component.startswith("option:"):
        text = _PRINTED.sub("", text, count=1)
    if not text or not nodes:
        return None
    groups: dict[str, list[dict]] = {}
    for n in nodes:
        value = str(n.get("value") or "")
        if not (n.get("kind") == "text" and _CITATION.fullmatch(value) and value.strip() not in text):
            groups.setdefault(str(n.get("source_block_id", "unknown")), []).append(n)
    wanted = [t for t in dict.fromkeys((text, _ITEM.sub("", text, count=1))) if t.strip()]
    for row in _rows(component, groups, roles):
        whole = "".join(map(shown, row))
        low, high = _view(whole, component)
        for t in wanted:
            spot = found(whole[low:high], t)
            mine = cut(row, spot[0] + low, spot[1] + low) if spot else None
            if mine:
                return mine
    return None


ALIGNED = "component_id string, text string, aligned boolean, source_block_id string, nodes array<string>, code string"


def aligned(components: DataFrame, q: DataFrame) -> DataFrame:
    """(doc_id, q_seq, component_id, text, aligned, source_block_id, nodes, code): each component of a question that has inline nodes, with its own nodes as JSON; code is TEXT_LAYOUT_DEGRADED where there are none.

    components: layout.components(q); q: records with inline_content (payload.attached) and source_blocks. Questions without nodes give no row.
    """
    held = q.filter(F.size("inline_content") > 0).select("doc_id", "q_seq", F.transform("inline_content", lambda n: F.struct(n["source_block_id"].alias("s"), n["source_order"].alias("o"), n["inline_index"].alias("i"), n["node"].alias("n"))).alias("held"), "source_blocks")
    per = components.groupBy("doc_id", "q_seq").agg(F.array_sort(F.collect_list(F.struct("comp_seq", "component_id", "text"))).alias("cs"))
    both = held.join(per, ["doc_id", "q_seq"]).repartition(shuffle_parts(q.sparkSession), "doc_id", "q_seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, seq, nodes, blocks, cs in zip(b["doc_id"], b["q_seq"], b["held"], b["source_blocks"], b["cs"], strict=True):
                roles = {str(x["block_id"]): x["role"] for x in blocks}
                real = [json.loads(x["n"]) | {"source_block_id": x["s"], "source_order": x["o"], "inline_index": x["i"]} for x in nodes]
                for c in cs:
                    mine = align(c["component_id"], c["text"], real, roles)
                    own = own_block(c["component_id"], roles)
                    source = str(mine[0].get("source_block_id")) if mine else own
                    if own and ".part_" in own and own.split(".part_")[0] == source:
                        source = own  # parts of a cut paragraph share its nodes
                    rows.append((doc, seq, c["component_id"], c["text"], bool(mine), source, [dumped(n) for n in mine or []], None if mine else "TEXT_LAYOUT_DEGRADED"))
            yield pd.DataFrame(rows, columns=["doc_id", "q_seq", *(x.split(" ")[0] for x in ALIGNED.split(", "))])

    kinds = dict(q.dtypes)
    return both.mapInPandas(run, f"doc_id {kinds['doc_id']}, q_seq {kinds['q_seq']}, {ALIGNED}")
