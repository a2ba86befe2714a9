"""Exam lines to questions by the older line rules: lines (doc_id, ord, line)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import linetext as L
from inkwell.functions import predicates as P
from inkwell.functions.text import label, strip
from inkwell.session import shuffle_parts

_A = re.compile(label("A"), re.I)
_BCD = re.compile(label("[B-D]"), re.I)
_D = re.compile(label("D"), re.I)
_NUMBERED = re.compile(r"(\d+)(?:\.(?!\d)|\))\s*(.*)$", re.S)
_YEAR_END = re.compile(r"\(\d{4}[^)]*\)\.?\s*$")
_CAPITAL = re.compile("[$A-Z∫√∑Α-ω\"'(]")
_ROMAN_ITEM = re.compile(r"\s*(?:\([ivx]+\)|[ivx]+[.)]\s)", re.I)
_LETTER_ITEM = re.compile(r"\s*(?:\([a-z]\)|[a-z][.)]\s)", re.I)
_ASKED = re.compile(r"\?|\b(?:Evaluate|Find|Integrate|Prove|Show|Verify|Calculate|Derive|State|Define|Explain|Determine|Solve|Write|Mention)\b", re.I)
_UNFINISHED = (":", ",", "and", "with", "where", "to", "of", "for", "in", "is", "are", "that", "find", "evaluate", "calculate", "determine", "such that", "given by", "as")
_DANGLING = re.compile(r"\b(?:is|are|of|for|to|with|where|in|by|given by|that|following|find|evaluate|calculate|determine)\s*(?:\(\d{4}[^)]*\))?\.?\s*$", re.I)


def starts_question(line: str, lines: list[str] | None, open_section: bool) -> bool:
    """Whether an unnumbered line begins a question after the lines of the one before (null: there is none)."""
    option = bool(_A.match(line) or _BCD.match(line))
    answer = line.lower().startswith(("answer", "sol", "hint"))
    if lines is None:
        return open_section or (not option and not line.lower().startswith(("answer", "sol")))
    text = " ".join(lines)
    d = _D.search(text)
    if d and text[d.end() :].strip() and not _BCD.match(line) and not answer and not L.PAIRING.search(line):
        begins = len(line) >= 4 and (_CAPITAL.match(line) or L.OPENING.match(line))
        if _A.search(line) or _YEAR_END.search(text) or begins or re.search(r"\b\d{4}M\b", line, re.I) or re.match(r"Question\s+\d+", line, re.I):
            return True
    if not open_section:
        return False
    had = [any(p.match(x) for x in lines) for p in (_ROMAN_ITEM, _LETTER_ITEM)]
    new = [bool(p.match(line)) for p in (_ROMAN_ITEM, _LETTER_ITEM)]
    goes_on = (had[0] and new[0]) or (had[1] and new[1])
    if not goes_on and ((had[0] and new[1]) or (had[1] and new[0])):
        return not option
    item = goes_on or bool(re.match(r"\s*\b(?:Strictly|Part|Case)\b", line, re.I))
    if _YEAR_END.search(text.strip()):
        return not goes_on and not (item and _DANGLING.search(text.strip())) and not option
    return bool(L.OPENING.match(line)) and bool(_ASKED.search(text)) and not lines[-1].strip().lower().endswith(_UNFINISHED) and not item


def parsed(lines: DataFrame) -> DataFrame:
    """(doc_id, q_seq, part, section, question, options, question_type, parsed_ok): questions in order, part 1 for a divider that trailed one.

    One pass over the lines of each document in order; only the lines of the question at hand are held. Noise and blank lines are skipped, numbering is counted over the document.
    """
    out = "doc_id bigint, q_seq int, part int, section string, question string, options map<string,string>, question_type string, parsed_ok boolean"
    rows = lines.select("doc_id", "ord", strip(F.col("line")).alias("line")).filter("line <> ''").filter(~P.is_noise_line(F.col("line")))
    rows = rows.repartition(shuffle_parts(lines.sparkSession), "doc_id").withColumn("header", P.is_section_line(F.col("line"))).withColumn("opens", P.is_open_section_line(F.col("line")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, section, opens, held, seq = object(), None, False, None, 0
        got: list[tuple] = []

        def close() -> None:
            nonlocal held
            if held is not None:
                got.extend((doc, seq, k, held[1], r["question"], r["options"], r["question_type"], r["parsed_ok"]) for k, r in enumerate(L.parse_lines(held[0], held[2])))
            held = None

        columns = ["doc_id", "q_seq", "part", "section", "question", "options", "question_type", "parsed_ok"]
        for b in batches:
            for d, line, header, open_head in zip(b["doc_id"], b["line"], b["header"], b["opens"], strict=True):
                if d != doc:
                    close()
                    doc, section, opens, seq = d, None, False, 0
                if header:
                    close()
                    section, opens = line.rstrip(":").strip(), bool(open_head)
                    continue
                m = _NUMBERED.match(line)
                if m or starts_question(line, held[0] if held else None, opens):
                    close()
                    seq += 1
                    body = m[2] if m else line
                    held = ([body] if body else [], section, opens)
                elif held is not None:
                    held[0].append(line)
            yield pd.DataFrame(got, columns=columns)
            got = []
        close()
        yield pd.DataFrame(got, columns=columns)

    return rows.sortWithinPartitions("doc_id", "ord").mapInPandas(run, out)


RAW = "stem string, options map<string,string>, chapter string, spill map<string,string>, leftovers array<string>"


def parsed_raw(texts: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, stem, options, chapter, spill, leftovers) of raw question texts, one row each; a null text counts as empty. See linetext.parse_raw."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [L.parse_raw(t or "") for t in b[raw]]
            yield pd.DataFrame({key: b[key], **{name: [g[name] for g in got] for name in ("stem", "options", "chapter", "spill", "leftovers")}})

    return texts.select(key, raw).mapInPandas(run, f"{key} {kind}, {RAW}")


def outcomes(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed and failed records of parsed()."""
    return questions.filter("parsed_ok"), questions.filter("not coalesce(parsed_ok, false)")
