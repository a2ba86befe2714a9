"""Word files as blocks: binaryFile scan, then the standard library's zip and XML readers per file."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import strip
from inkwell.operators.pagespans import LOWERED, RAISED

SCHEMA = "path string, ord bigint, block_id string, block_type string, parent_block_id string, row_index int, col_index int, part int, text string, inline_content string, children string, error string"
MEDIA_SCHEMA = "path string, name string, content binary"
_STRUCTURE = re.compile(r"(?:\d+[.)]|[A-Ea-e][.)]|\([A-Ea-e]\)|\([i-xIvX]+\))\s+")
_NUMERALS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
# Accents and n-ary signs of the math markup.
ACCENTS = {"⃗": "vec", "\u20d7": "vec", "\u0302": "hat", "\u0305": "bar", "\u0307": "dot", "\u0303": "tilde"}


def _name(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _kid(node: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in node if _name(c) == name), None)


def _value(node: ET.Element | None, *path: str) -> str | None:
    """The val attribute at the end of a path of children."""
    for name in path:
        node = _kid(node, name) if node is not None else None
    return None if node is None else next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == "val"), None)


def _script(text: str, table: tuple[str, str], mark: str) -> str:
    t = text.strip()
    letters = dict(zip(*table, strict=True))
    return "".join(letters[c] for c in t) if t and all(c in letters for c in t) else f"{mark}{{{t}}}"


class Reader:
    """Text of paragraphs, formulas as LaTeX; keeps the counters of numbered lists."""

    def __init__(self, links: dict[str, str]):
        self.links, self.counters = links, {}

    def part(self, node: ET.Element, name: str) -> str:
        kid = _kid(node, name)
        return self.text(kid, True).strip() if kid is not None else ""

    def text(self, node: ET.Element, math: bool = False) -> str:
        name = _name(node)
        kind = getattr(self, f"do_{name}", None)
        return kind(node, math) if kind else "".join(self.text(c, math) for c in node)

    def do_t(self, node, math):
        return node.text or ""

    def do_tab(self, node, math):
        return "\t"

    def do_br(self, node, math):
        return "\n"

    def do_rPr(self, node, math):
        return ""

    do_pPr = do_ctrlPr = do_fPr = do_radPr = do_naryPr = do_dPr = do_accPr = do_funcPr = do_rPr

    def do_r(self, node, math):
        inner = "".join(self.text(c, math) for c in node)
        align = None if math else _value(node, "rPr", "vertAlign")
        return _script(inner, RAISED, "^") if align == "superscript" else _script(inner, LOWERED, "_") if align == "subscript" else inner

    def do_oMath(self, node, math):
        inner = "".join(self.text(c, True) for c in node)
        return inner if math else f"${inner}$"

    def do_f(self, node, math):
        return f"\\frac{{{self.part(node, 'num')}}}{{{self.part(node, 'den')}}}"

    def do_sSup(self, node, math):
        return f"{self.part(node, 'e')}^{{{self.part(node, 'sup')}}}"

    def do_sSub(self, node, math):
        return f"{self.part(node, 'e')}_{{{self.part(node, 'sub')}}}"

    def do_sSubSup(self, node, math):
        return f"{self.part(node, 'e')}_{{{self.part(node, 'sub')}}}^{{{self.part(node, 'sup')}}}"

    def do_rad(self, node, math):
        degree = self.part(node, "deg")
        return f"root({degree}, {self.part(node, 'e')})" if degree else f"sqrt({self.part(node, 'e')})"

    def do_nary(self, node, math):
        sub, sup = self.part(node, "sub"), self.part(node, "sup")
        sign = _value(node, "naryPr", "chr") or "∫"
        return sign + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "") + f" {self.part(node, 'e')}"

    def do_d(self, node, math):
        left, right = (_value(node, "dPr", k) for k in ("begChr", "endChr"))
        return ("(" if left is None else left) + ", ".join(self.text(c, True).strip() for c in node if _name(c) == "e") + (")" if right is None else right)

    def do_func(self, node, math):
        return f"{self.part(node, 'fName')} {self.part(node, 'e')}"

    def do_limLow(self, node, math):
        return f"{self.part(node, 'e')}_{{{self.part(node, 'lim')}}}"

    def do_limUpp(self, node, math):
        return f"{self.part(node, 'e')}^{{{self.part(node, 'lim')}}}"

    def do_acc(self, node, math):
        return f"\\{ACCENTS.get(_value(node, 'accPr', 'chr') or chr(0x302), 'hat')}{{{self.part(node, 'e')}}}"

    def do_bar(self, node, math):
        return f"\\overline{{{self.part(node, 'e')}}}"

    def do_m(self, node, math):
        rows = [" & ".join(self.text(e, True).strip() for e in r if _name(e) == "e") for r in node if _name(r) == "mr"]
        return "\\begin{matrix}" + " \\\\ ".join(rows) + "\\end{matrix}"

    def do_drawing(self, node, math):
        ids = [v for n in node.iter() if _name(n) == "blip" for k, v in n.attrib.items() if k.endswith("embed")]
        return "".join(f"[IMG: {self.links.get(i, i)}]" for i in ids)

    do_pict = do_drawing

    def number(self, paragraph: ET.Element) -> str:
        """The number a list item shows: 1. on the first level, (a) on the second, (i) below; deeper levels begin again."""
        props = _kid(_kid(paragraph, "pPr"), "numPr") if _kid(paragraph, "pPr") is not None else None
        listed = _value(props, "numId")
        if listed is None:
            return ""
        level = int(_value(props, "ilvl") or 0)
        n = self.counters[listed, level] = self.counters.get((listed, level), 0) + 1
        for key in [k for k in self.counters if k[0] == listed and k[1] > level]:
            del self.counters[key]
        if level == 0:
            return f"{n}. "
        names = "abcdefghijklmnopqrstuvwxyz" if level == 1 else _NUMERALS
        return f"({names[n - 1] if n <= len(names) else n}) "


# The kinds of formula nodes, and the operands of those that have roles.
KINDS = dict(
    f="fraction", sSup="superscript", sSub="subscript", sSubSup="subsup", rad="radical", nary="nary", func="function", d="delimiter", limLow="lower_limit", limUpp="upper_limit", acc="accent", bar="bar",
    oMath="math_sequence", oMathPara="math_sequence", e="math_sequence", num="math_sequence", den="math_sequence", sup="math_sequence", sub="math_sequence", deg="math_sequence", lim="math_sequence",
    m="matrix", mr="matrix_row", eqArr="equation_array", groupChr="group",
)
OPERANDS = {
    "f": "num=numerator den=denominator", "sSup": "e=base sup=superscript", "sSub": "e=base sub=subscript", "sSubSup": "e=base sub=subscript sup=superscript", "rad": "deg=degree e=radicand",
    "nary": "sub=lower_limit sup=upper_limit e=body", "func": "fName=function_name e=argument", "d": "e=contents", "limLow": "e=base lim=lower_limit", "limUpp": "e=base lim=upper_limit", "acc": "e=contents", "bar": "e=contents",
}
STYLES = {"b": "bold", "i": "italic", "u": "underline"}
_SILENT = frozenset("pPr rPr proofErr bookmarkStart bookmarkEnd".split())


def formula_node(reader: Reader, node: ET.Element) -> dict:
    """A formula as a tree: operands under their roles, other containers with their children in order, runs as tokens. Only direct children are operands, so a fraction in a root is not the root's."""
    name = _name(node)
    own = {"kind": KINDS.get(name, "math_token"), "value": "".join(t.text or "" for t in node.iter() if _name(t) == "t") if name == "r" else reader.text(node, True), "source": {"omml_tag": name}}
    if name in OPERANDS:
        pairs = (x.split("=") for x in OPERANDS[name].split())
        own["children"] = [{"kind": role, "value": reader.text(kid, True), "children": [formula_node(reader, kid)]} for tag, role in pairs if (kid := _kid(node, tag)) is not None]
    elif name not in ("r", "t", "chr"):
        own["children"] = [formula_node(reader, c) for c in node if not _name(c).endswith("Pr")]
    if name == "nary" and (sign := _value(node, "naryPr", "chr")):
        own["formatting"] = {"operator": sign}
    return own


def inline_nodes(reader: Reader, paragraph: ET.Element) -> list[dict]:
    """What a paragraph holds, in order: texts with their formats, formulas as trees, line breaks and pictures."""
    out: list[dict] = []

    def walk(node: ET.Element, style: dict) -> None:
        for c in node:
            name = _name(c)
            if name in _SILENT:
                continue
            if name in ("oMath", "oMathPara"):
                out.append(formula_node(reader, c))
            elif name == "r":
                props = _kid(c, "rPr")
                marks = {STYLES[_name(x)]: _value(x) not in ("0", "false", "none") for x in props if _name(x) in STYLES} if props is not None else {}
                align = _value(props, "vertAlign")
                walk(c, {k: v for k, v in (("vertical_align", align if align in ("superscript", "subscript") else None), ("formatting", marks)) if v})
            elif name in ("t", "tab"):
                out.append({"kind": "text", "value": "\t" if name == "tab" else c.text or ""} | style)
            elif name == "br":
                out.append({"kind": "line_break"} | {k: v for k, v in style.items() if k == "formatting"})
            elif name in ("drawing", "pict"):
                out.extend({"kind": "image", "value": path} for path in re.findall(r"\[IMG: (.*?)\]", reader.text(c)))
            else:
                walk(c, style)

    walk(paragraph, {})
    return out


def soft_lines(text: str) -> list[str]:
    """A paragraph cut where a line begins a number or label, if more than one does; else one piece."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    if sum(bool(_STRUCTURE.match(x)) for x in lines) < 2:
        return ["\n".join(lines)] if lines else []
    out: list[str] = []
    for x in lines:
        if _STRUCTURE.match(x) or not out:
            out.append(x)
        else:
            out[-1] += "\n" + x
    return out


def read(data: bytes) -> list[dict]:
    """Blocks of one file: paragraphs, and tables as trees (table, table_row, table_cell, what stands in the cell) numbered in pre-order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _kid(ET.fromstring(z.read("word/document.xml")), "body")
        names = z.namelist()
        relations = ET.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else []
    reader = Reader({r.attrib["Id"]: r.attrib.get("Target", "") for r in relations if "Id" in r.attrib})
    out: list[dict] = []

    def add(kind: str, parent: str | None, **more) -> dict:
        n = len(out) + 1
        out.append({"ord": n, "block_id": str(n), "block_type": kind, "parent_block_id": parent, "row_index": None, "col_index": None, "part": 0, "text": None, "inline_content": None, "children": None} | more)
        return out[-1]

    def walk(holder: ET.Element | None, parent: str | None) -> list[dict]:
        """Adds the blocks of a holder; gives its paragraphs and tables as nested blocks."""
        nested: list[dict] = []
        for item in holder if holder is not None else []:
            if _name(item) == "p":
                raw = (reader.number(item) + reader.text(item).strip()).strip()
                nodes = inline_nodes(reader, item) if raw else []
                for k, piece in enumerate(soft_lines(raw)):  # the nodes stay with the first piece
                    made = add("paragraph", parent, text=piece, part=k, inline_content=json.dumps(nodes, ensure_ascii=False) if k == 0 and nodes else None)
                    nested.append({"block_type": "paragraph", "block_id": made["block_id"], "text": piece, "inline_content": nodes if k == 0 else []})
            elif _name(item) == "tbl":
                table = add("table", parent)
                rows = []
                for i, tr in enumerate(r for r in item if _name(r) == "tr"):
                    row = add("table_row", table["block_id"], row_index=i)
                    cells = []
                    for j, tc in enumerate(c for c in tr if _name(c) == "tc"):
                        cell = add("table_cell", row["block_id"], row_index=i, col_index=j)
                        inside = walk(tc, cell["block_id"])
                        cell["text"] = "\n".join(x["text"] for x in inside if x["block_type"] == "paragraph")
                        cells.append({"block_type": "table_cell", "block_id": cell["block_id"], "text": cell["text"], "children": inside})
                    rows.append({"block_type": "table_row", "block_id": row["block_id"], "children": cells})
                table["children"] = json.dumps(rows, ensure_ascii=False)
                nested.append({"block_type": "table", "block_id": table["block_id"], "children": rows})
        return nested

    walk(body, None)
    return out


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA rows of all .docx files under a path. A file that can't be read gives one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = [{"path": name, "error": None} | r for r in read(content)]
                except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
                    rows = [{"path": name, "error": repr(e)}]
                yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)

    return files.mapInPandas(run, SCHEMA)


def media(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the pictures inside the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [(name, n, z.read(n)) for n in z.namelist() if n.startswith("word/media/")]
                    yield pd.DataFrame(found, columns=["path", "name", "content"])

    return files.mapInPandas(run, MEDIA_SCHEMA)


def top_blocks(found: DataFrame) -> DataFrame:
    """Blocks for the question pipeline: doc_id from the path, paragraphs and tables that stand in nothing else, with their inline nodes and cells."""
    return found.filter("parent_block_id is null and error is null").select(F.xxhash64("path").alias("doc_id"), "ord", "block_id", "block_type", "text", "children", "inline_content")


def flat_lines(found: DataFrame) -> DataFrame:
    """(path, ord, line_no, line): every line of the files in reading order, those in table cells too; blank ones are left out."""
    each = found.filter("block_type = 'paragraph' and error is null").select("path", "ord", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return each.withColumn("line", strip(F.col("line"))).filter("line <> ''")


def table_cells(found: DataFrame) -> DataFrame:
    """(path, table_block_id, row_index, col_index, block_id, text) of all cells."""
    rows = found.filter("block_type = 'table_row'").select("path", F.col("block_id").alias("row_id"), F.col("parent_block_id").alias("table_block_id"))
    cells = found.filter("block_type = 'table_cell'").withColumnRenamed("parent_block_id", "row_id")
    return cells.join(rows, ["path", "row_id"]).select("path", "table_block_id", "row_index", "col_index", "block_id", "text")
