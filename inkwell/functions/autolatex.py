"""LaTeX for unmarked formulas in running text: an ordered table of rules, then one pass that settles where formulas begin and end.

A rule writes what it finds between two signs of the private use area. The last pass reads these as brackets, takes the
operators and numbers between and beside formulas into them, and writes every outermost pair as dollar signs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\ue000", "\ue001"

# Signs and their plain forms, names of functions, words that are no units.
UP = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ˣⁿᵎʲⁱ", "0123456789+-xni j", strict=True))
DOWN = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋ₓ", "0123456789+-x", strict=True))
FUNCTIONS = ("cosec", "csc", "sin", "cos", "tan", "sec", "cot", "log", "ln", "exp")
NO_UNITS = ("step", "case", "type", "part", "page")
UNITS = r"[a-zA-Z]*Hz|[a-zA-Z]?Js|[a-zA-Z]?C|m/s(?:[²³]|\^[23])?|kg\b|g\b|s\b|mol\b|eV\b|V\b|A\b|K\b|J\b|N\b|W\b|Ω\b|F\b|T\b|m\b|cm\b|mm\b|μm\b|nm\b|L\b|mL\b"
_GROUP = r"\{(?:[^{}]+|\{[^}]+\})*+\}"
_TERM = r"\(((?:[^()]+|\([^()]+\))++)\)"
_POWER = r"(\s*\^\s*\{?\ue000?)(-?\d+)(\}?)|(\s*\{?\ue000?)(-\d+)(\}?)|(\s+\{?\ue000?)(-?\d+)(\}?)"
_RAISED = "⁰¹²³⁴-⁹⁺⁻ˣⁿᵎʲⁱ"
# What each rule finds, in the order in which they apply.
PATTERNS = {
    "function application": "\u2061",
    "letter with subscript": r"(?<![A-Za-z0-9_])([A-Za-z])_([A-Za-z0-9])(?![A-Za-z0-9_])",
    "base with low signs": rf"([A-Za-zα-ωΑ-Ω0-9]+)([₀-₊ₓ]+)([{_RAISED}]*)([A-Za-z]*)",
    "root of brackets": r"√\(([^()]*)\)",
    "root of a word": r"√([A-Za-z0-9]+)",
    "two cases": r"(?i)=\s*\{\s*(2[^,i]+?dx)\s*,?\s*if\s+(.*?)\s+(0)\s*,?\s*if\s+([^$]+?)\s*(?=\$|And|and)",
    "doubled name": r"(?i)\b(sin|cos|tan|sec|csc|cosec|cot|log|ln)\1\b",
    "fraction": rf"{_TERM}/{_TERM}",
    "root with degree": r"\broot\(([^,]+),\s*([^)]+)\)",
    "root by name": r"sqrt\(([^)]+)\)",
    "integral": rf"∫(?:(?:_|\^){_GROUP})*+",
    "scripts in braces": rf"(?<![A-Za-zα-ωΑ-Ω0-9])([A-Za-zα-ωΑ-Ω0-9)]+(?:\^|_){_GROUP}(?:(?:\^|_){_GROUP})*+)",
    "raised signs": rf"([A-Za-zα-ωΑ-Ω0-9\)]+)?([{_RAISED}]+)",
    "t2g with the number inside": r"\bt(\d)2g\b",
    "eg with the number inside": r"\be(\d)g\b",
    "t2g with a number": r"\bt2g(\d+)",
    "t2g": r"\bt2g\b",
    "eg with a number": r"\beg(\d+)",
    "eg": r"\beg\b",
    "function": r"(?<![A-Za-z])\\?(cosec|csc|sin|cos|tan|sec|cot|log|ln|exp)(?:\s*(\([^()]*\)|\{[^{}]*\})|\s+([A-Za-zα-ωΑ-Ω]+|\d+[A-Za-zα-ωΑ-Ω]?)\b|([xyzθ]|\d+[xyzθ])\b)",
    "splitting": r"Δ([oO0])",
    "Greek letter": "([α-ρσ-ωΑ-ΡΣ-Ω])",
    "function of a letter": r"\b([fghFGH])\(([x-zX-Z])\)",
    "number times a power of ten": r"\ue000?\b(\d+(?:\.\d+)?)\s*[xX*×]\s*\ue000?10\ue001?\s*(?:\^|(?=-))?\s*\{?\ue000?(-?\d+)\}?\ue001?(?!\d)",
    "power of ten": rf"(?<!\\times\s)(?<!\\times)\ue000?\b10\ue001?(?:{_POWER}|(\s*\{{?\ue000?)(-?\d+)(\}}?)(?=[ \xa0]*(?:{UNITS})))\ue001?(?!\d)",
    "lost power": r"(?<![a-zA-Z])(\d*)([xyzabcnmrt])(\d+)\b",
    "unit": r"\b([a-zA-Z]{1,4})-(\d+)\b",
    "configuration": r"\b([1-7])([spdf])(\d{1,2})\b",
    "orbital": r"\b([df])(\d{1,2})\s+(?=ion\b|config|electron|orbital)",
    "complex": r"\[[A-Z][^\]]*\](?:\d?[+-])?",
    "compound": r"(?<![A-Za-z_$\-])(?:[A-Z][a-z]?|[()\d]){2,}(?:[+-])?(?![_A-Za-z0-9])",
    "ion": r"(\b[A-Z][a-z]?)(\d?[+-])(?=[\s,.:;()\[\]<>]|$)",
}
# What rules with nothing to decide write; <> stand for the two signs.
TEMPLATES = {
    "function application": "\u2061",
    "letter with subscript": r"<\1_{\2}>",
    "root of brackets": r"<\\sqrt{\1}>",
    "root of a word": r"<\\sqrt{\1}>",
    "doubled name": r"\1",
    "t2g with the number inside": r"t2g\1",
    "eg with the number inside": r"eg\1",
    "t2g with a number": r"<t_{2g}^{\1}>",
    "t2g": r"<t_{2g}>",
    "eg with a number": r"<e_g^{\1}>",
    "eg": r"<e_g>",
    "splitting": r"<\\Delta_{\1}>",
    "function of a letter": r"<\1(\2)>",
    "number times a power of ten": r"<\1 \\times 10^{\2}>",
    "lost power": r"<\1\2^{\3}>",
    "configuration": r"<\1\2^{\3}>",
    "orbital": r"<\1^{\2}> ",
    "ion": r"<\1^{\2}>",
}
EVEN_ODD = r"\bis (?:(?:an )?(even|odd) function|(even|odd))\b"


def greek_name(c: str) -> str:
    """The LaTeX command of a Greek letter, from its Unicode name."""
    if c in "οΟ":
        return "o" if c == "ο" else "O"
    name = unicodedata.name(c).split()[-1].lower().replace("lamda", "lambda")
    return "varepsilon" if c == "ε" else name if c.islower() else name.capitalize()


def _marked(s: str) -> str:
    return OPEN + s + CLOSE


def _bare(s: str) -> str:
    return re.sub(f"[{OPEN}{CLOSE}$]", "", s.strip())


def _csc(name: str) -> str:
    return "csc" if name == "cosec" else name


def _low(m: re.Match) -> str:
    up = "".join(UP[c] for c in m[3]).strip()
    return _marked(f"{m[1]}_{{{''.join(DOWN[c] for c in m[2])}}}" + (f"^{{{up}}}" if m[3] else "") + m[4])


def _raised(m: re.Match) -> str:
    up = "".join(UP[c] for c in m[2]).strip()
    return _marked(f"{m[1] or ''}^{{{up}}}") if up else m[0]


def _two_cases(m: re.Match) -> str:
    def said(c: str) -> str:
        c = re.sub(r"^if\s+", "", c.strip())
        return "\\text{if } " + re.sub(EVEN_ODD, lambda k: f"\\text{{ {k[0]}}}", c)

    first, _, zero = (m[k].strip() for k in (1, 2, 3))
    first = re.sub(r"[. ]dx", r"\\,dx", first)
    return f"={_marked(rf'\begin{{cases}} {first} & {said(m[2])} \\ {zero} & {said(m[4])} \end{{cases}}')} "


def _integral(m: re.Match) -> str:
    body = _bare(m[0].replace("∫", "\\int "))
    body = "".join(f"\\{greek_name(c)} " if re.match(PATTERNS["Greek letter"], c) else c for c in body)
    return _marked(re.sub(r"\s+", " ", body) + " ")


def _in_braces(m: re.Match) -> str:
    name = next((f for f in FUNCTIONS if m[0].startswith(f)), "")
    return _marked(f"\\{_csc(name)}{m[0][len(name) :]}" if name else m[0])


def _function(m: re.Match) -> str:
    argument = (m[2] or m[3] or m[4]).strip()
    return _marked(f"\\{_csc(m[1])}{{{argument[1:-1] if m[2] else argument}}}")


def _compound(m: re.Match) -> str:
    """Numbers behind symbols and brackets are low, a charge at the end is raised."""
    raw = m[0]
    if raw.count("(") != raw.count(")") or not any(c.isascii() and c.isalpha() for c in raw):
        return raw
    charge = re.search(r"\d?[+-]$", raw)
    body = re.sub(r"(?<=[A-Za-z\])])\d+", r"_{\g<0>}", raw[: charge.start()] if charge else raw)
    return _marked(body + (f"^{{{charge[0]}}}" if charge else ""))


WRITERS: dict[str, Callable[[re.Match], str]] = {
    "base with low signs": _low,
    "two cases": _two_cases,
    "fraction": lambda m: _marked(rf"\frac{{{_bare(m[1])}}}{{{_bare(m[2])}}}"),
    "root with degree": lambda m: _marked(rf"\sqrt[{_bare(m[1])}]{{{_bare(m[2])}}}"),
    "root by name": lambda m: _marked(rf"\sqrt{{{_bare(m[1])}}}"),
    "integral": _integral,
    "scripts in braces": _in_braces,
    "raised signs": _raised,
    "function": _function,
    "Greek letter": lambda m: _marked(f"\\{greek_name(m[1])} "),
    "power of ten": lambda m: _marked(f"10^{{{m[2] or m[5] or m[8] or m[11]}}}"),
    "unit": lambda m: m[0] if m[1].lower() in NO_UNITS else _marked(f"{m[1]}^{{-{m[2]}}}"),
    "complex": _compound,
    "compound": _compound,
}
RULES = [(re.compile(p), WRITERS.get(name) or TEMPLATES[name].replace("<", OPEN).replace(">", CLOSE)) for name, p in PATTERNS.items()]

ITALICS = {0x1D44E + i: chr(97 + i) for i in range(26)} | {0x1D434 + i: chr(65 + i) for i in range(26)} | {0x210E: "h", 0x2212: "-", 0x2013: "-"}
_BETWEEN = re.compile(r"[ \d+\-/=,.^{}<>]+")
_BEHIND = re.compile(r"[\d+\-/=,.^{}<>]+(?=$|[^a-zA-Z0-9])")
_BEFORE = re.compile(r"(?:^|[^a-zA-Z0-9])([\d+\-/=,.^{}<>]+)$")
_VARIABLE = re.compile(r"(?<![A-Za-z_])([xyzf])(?![A-Za-z_])")
_DOUBLE_COMMAND = re.compile(r"\\\\(?=sin|cos|tan|sec|csc|cot|log|ln|exp|frac|sqrt|int|Delta|alpha|beta|gamma|pi|theta|lambda|mu)")


def _segments(text: str) -> list[list]:
    """[is formula, text] in order: the outermost pairs of signs are formulas, inner ones only keep neighbours apart; a lone variable is a formula too."""
    out: list[list] = []
    depth, gone = 0, ""
    for part in re.split(f"([{OPEN}{CLOSE}])", text):
        if part in (OPEN, CLOSE):
            if part == OPEN and gone == CLOSE and depth:
                out[-1][1] += " "
            depth += 1 if part == OPEN else -1
            if part == OPEN and depth == 1:
                out.append([True, ""])
            gone = part
        elif part:
            gone = ""
            if depth > 0:
                out[-1][1] += part
            else:
                out += [[bool(i % 2), x] for i, x in enumerate(_VARIABLE.split(part)) if x]
    return out


def _settled(segments: list[list]) -> list[list]:
    """Formulas with the operators and numbers between and beside them."""
    joined: list[list] = []
    for i, (math, text) in enumerate(segments):
        bridge = not math and 0 < i < len(segments) - 1 and segments[i - 1][0] and segments[i + 1][0] and _BETWEEN.fullmatch(text)
        if joined and joined[-1][0] and (math or bridge):
            joined[-1][1] += text if bridge or not segments[i - 1][0] else " " + text
        else:
            joined.append([math, text])
    for left, right in zip(joined, joined[1:], strict=False):
        if left[0] and not right[0] and (m := _BEHIND.match(right[1])):
            left[1], right[1] = left[1] + m[0], right[1][m.end() :]
    for left, right in zip(joined, joined[1:], strict=False):
        if right[0] and not left[0] and (m := _BEFORE.search(left[1])):
            left[1], right[1] = left[1][: m.start(1)], m[1] + right[1]
    return joined


def auto_latex(text: str | None) -> str | None:
    """The text with its formulas as LaTeX between dollar signs. Null stays null; formulas that are marked already are read too."""
    if text is None:
        return None
    text = re.sub(r"\$(.*?)\$", lambda m: _marked(m[1]), text.translate(ITALICS))
    for pattern, by in RULES:
        text = pattern.sub(by, text)
    text = re.sub(rf"\s+({CLOSE}?[_^])", r"\1", text)
    if OPEN not in text and ("\\vec{" in text or "\\hat{" in text):
        text = _marked(text.strip())
    found = "".join(f"${t.strip()}$" if math else t for math, t in _settled(_segments(text)) if t)
    return _DOUBLE_COMMAND.sub(r"\\", found)


def auto_latex_column(text: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(s).map(auto_latex, na_action="ignore"), "string")(text)
