import datetime as dt
import json
import zipfile

from inkwell.functions.mathtree import tree_latex
from inkwell.operators.pipeline import build
from inkwell.sources import docx, envelope
from inkwell.streaming.blocks import arriving, windowed

W, M, R = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/math", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def p(inner, level=None):
    listed = f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="5"/></w:numPr></w:pPr>' if level is not None else ""
    return f"<w:p>{listed}{inner}</w:p>"


def r(text, align=None):
    props = f'<w:rPr><w:vertAlign w:val="{align}"/></w:rPr>' if align else ""
    return f"<w:r>{props}<w:t>{text}</w:t></w:r>"


def m(text):
    return f"<m:r><m:t>{text}</m:t></m:r>"


def save(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:m="{M}" xmlns:r="{R}" xmlns:a="urn:a"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId3" Target="media/p.png"/></Relationships>')
        z.writestr("word/media/p.png", b"png")


def test_docx(spark, tmp_path):
    math = f"<m:oMath><m:f><m:num>{m('a')}</m:num><m:den><m:rad><m:deg/><m:e>{m('b')}</m:e></m:rad></m:den></m:f><m:sSup><m:e>{m('x')}</m:e><m:sup>{m('2')}</m:sup></m:sSup></m:oMath>"
    inner = f"<w:tbl><w:tr><w:tc>{p(r('deep'))}</w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr><w:tc>{p(r('h1'))}</w:tc><w:tc>{p(r('h2'))}</w:tc></w:tr><w:tr><w:tc>{p(r('c1'))}{inner}</w:tc><w:tc/></w:tr></w:tbl>"
    body = p(r("Which?"), 0) + p(r("sub"), 1) + p(r("sub"), 1) + p(r("next"), 0) + p(r("again"), 1) + p(r("Fe") + r("2+", "superscript") + r("x", "subscript") + math) + table + p("") + p("<w:r><w:drawing><a:blip r:embed='rId3'/></w:drawing></w:r>") + p(r("(A) one") + "<w:r><w:br/></w:r>" + r("more") + "<w:r><w:br/></w:r>" + r("(B) two"))
    save(tmp_path / "a.docx", body)
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    rows = docx.blocks(spark, str(tmp_path)).orderBy("path", "ord").collect()
    good = [x for x in rows if x.error is None]
    assert len(rows) - len(good) == 1
    text = [x.text for x in good if x.parent_block_id is None]
    assert text == ["1. Which?", "(a) sub", "(b) sub", "2. next", "(a) again", "Fe²⁺ₓ$\\frac{a}{sqrt(b)}x^{2}$", None, "[IMG: media/p.png]", "(A) one\nmore", "(B) two"]
    cells = {(x.row_index, x.col_index, x.text) for x in docx.table_cells(docx.blocks(spark, str(tmp_path))).collect()}
    assert (0, 0, "h1") in cells and (0, 0, "deep") in cells and (1, 0, "c1") in cells and len(cells) == 5
    assert [(x.name, bytes(x.content)) for x in docx.media(spark, str(tmp_path)).collect()] == [("word/media/p.png", b"png")]
    q = build(docx.top_blocks(docx.blocks(spark, str(tmp_path)))).questions.orderBy("q_seq").collect()
    assert [x.source_question_number for x in q] == ["1", "2"]
    assert q[1].table.headers == ["h1", "h2"] and q[1].table.rows[1] == ["c1", ""]
    lines = [x.line for x in docx.flat_lines(docx.blocks(spark, str(tmp_path))).orderBy("ord", "line_no").collect()]
    assert lines == ["1. Which?", "(a) sub", "(b) sub", "2. next", "(a) again", text[5], "h1", "h2", "c1", "deep", "[IMG: media/p.png]", "(A) one", "more", "(B) two"]
    nodes = [json.loads(x.inline_content) for x in good if x.text == text[5]][0]
    assert [(n["kind"], n["value"], n.get("vertical_align")) for n in nodes[:3]] == [("text", "Fe", None), ("text", "2+", "superscript"), ("text", "x", "subscript")]
    fraction, power = nodes[3]["children"]
    assert nodes[3]["kind"] == "math_sequence" and fraction["kind"] == "fraction" and [k["kind"] for k in fraction["children"]] == ["numerator", "denominator"]
    assert tree_latex(nodes[3]) == r"\frac{a}{\sqrt{b}}x^{2}" and [k["kind"] for k in power["children"]] == ["base", "superscript"]
    last = [json.loads(x.inline_content) if x.inline_content else None for x in good if x.parent_block_id is None][-3:]
    assert last[0] == [{"kind": "image", "value": "media/p.png"}] and [n["kind"] for n in last[1]] == ["text", "line_break", "text", "line_break", "text"] and last[2] is None


def test_inline_formats(spark, tmp_path):
    bold = '<w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>so</w:t><w:tab/></w:r>'
    nary = f'<m:oMathPara><m:oMath><m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{m("i")}</m:sub><m:sup>{m("n")}</m:sup><m:e>{m("k")}</m:e></m:nary><m:m><m:mr><m:e>{m("1")}</m:e><m:e>{m("2")}</m:e></m:mr></m:m></m:oMath></m:oMathPara>'
    save(tmp_path / "b.docx", p(bold + nary))
    (row,) = docx.blocks(spark, str(tmp_path)).collect()
    nodes = json.loads(row.inline_content)
    assert nodes[:2] == [{"kind": "text", "value": "so", "formatting": {"bold": True, "italic": False}}, {"kind": "text", "value": "\t", "formatting": {"bold": True, "italic": False}}]
    inner = nodes[2]["children"][0]
    assert inner["children"][0]["formatting"] == {"operator": "∑"} and tree_latex(inner) == r"\sum_{i}^{n} k\begin{matrix}1 & 2\end{matrix}"


def test_envelope(spark, tmp_path):
    lines = ["Section A", "1. Which? (A) a (B) b (C) c (D) d", "2. Why é?", "Section B", "1. Find $x$."]
    bank = build(spark.createDataFrame([(4, i, str(i), "paragraph", t) for i, t in enumerate(lines)], "doc_id bigint, ord bigint, block_id string, block_type string, text string"))
    (row,) = envelope.envelopes(bank).collect()
    got = json.loads(row.json)
    assert [s["title"] for s in got["sections"]] == ["Section A", "Section B"] and got["schema_version"] == "2.0"
    assert [x["q_seq"] for x in got["questions"]] == [1, 2, 3] and got["diagnostics"]["questions_detected"] == 3
    envelope.write(bank, str(tmp_path / "out"))
    back = envelope.checked(envelope.read(spark, str(tmp_path / "out")))
    assert {x.question for x in back.collect()} == {"Which?", "Why é?", "Find $x$."}
    (tmp_path / "bare.json").write_text('[{"q_seq": 1, "question": "x", "parsed_ok": true, "needs_review": false}]')
    assert envelope.read(spark, str(tmp_path / "bare.json")).first().question == "x"
    (tmp_path / "indented.json").write_text(json.dumps({"questions": [{"q_seq": 1, "question": "é y", "options": {"A": "1"}, "parsed_ok": True, "needs_review": False}, {"q_seq": 2, "question": None}]}, indent=2, ensure_ascii=False))
    assert [(x.q_seq, x.question) for x in envelope.read(spark, str(tmp_path / "indented.json"), whole=True).collect()] == [(1, "é y"), (2, None)]


def test_stream(spark, tmp_path):
    schema = "block_uid bigint, site_id string, text string, ingested_at timestamp"
    day = dt.datetime(2024, 1, 1)
    first = [(1, "s", "1. Which?", day), (1, "s", "1. Which?", day + dt.timedelta(hours=1)), (2, "s", "Join us", day), (3, "t", None, day)]
    later = [(9, "s", "x", day + dt.timedelta(days=40)), (4, "s", "late", day - dt.timedelta(days=30))]
    for i, rows in enumerate((first, later, [(10, "s", "end", day + dt.timedelta(days=90))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert arriving(stream).isStreaming
    q = windowed(stream).writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.site_id, r.blocks, r.noise, r.numbered) for r in spark.table("windows").collect()}
    assert ("s", 2, 1, 1) in got and ("t", 1, 0, 0) in got
