"""Queries of the text, repair and layout operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.fixtures import exam_blocks
from inkwell.functions import chem, mathtext, mathtree, runs
from inkwell.functions.autolatex import auto_latex_column
from inkwell.functions import predicates as P
from inkwell.functions import spans as S
from inkwell.functions.mathtext import readable_series
from inkwell.operators import layout, lineparse, nested, pagespans, repair
from inkwell.operators.pipeline import blocks_of, build
from inkwell.plans import bank
from inkwell.plans.bank import STRIP, joined
from inkwell.session import once_per, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """(question_uid, question), each record once."""
    return table(spark, d, "questions").filter("question_uid is not null and question is not null").groupBy("question_uid").agg(F.min("question").alias("question"))


_Q = "WITH q AS (SELECT question_uid, min(question) AS question FROM questions WHERE question_uid IS NOT NULL AND question IS NOT NULL GROUP BY question_uid)"


@query()
def q_convert_math(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of the bank's questions as LaTeX, with their problems."""
    q = _questions(spark, d).withColumn("formulas", S.equations(F.col("question"))).filter(F.size("formulas") > 0).withColumn("latex", mathtext.convert_math(F.col("formulas")))
    each = q.select("question_uid", F.posexplode(F.arrays_zip("formulas", "latex")).alias("n", "x")).select("question_uid", "n", F.col("x.formulas").alias("raw"), "x.latex")
    return each.withColumn("problems", joined(mathtext.check_math(F.col("latex"))))


@query(_Q + """, f AS (SELECT question_uid, unnest(regexp_extract_all(question, '\\$(.*?)\\$', 1)) AS x FROM q) SELECT question_uid, count(*) AS n, CAST(sum(len(x) - len(replace(x, '{', ''))) AS BIGINT) AS opened, CAST(sum(len(x) - len(replace(x, '}', ''))) AS BIGINT) AS closed,
 CAST(sum(len(regexp_extract_all(x, '\\\\int')) - len(regexp_extract_all(x, '\\\\int[A-Za-z]'))) AS BIGINT) AS integrals FROM f GROUP BY question_uid""")
def q_formula_counts(spark: SparkSession, d: str) -> DataFrame:
    """Formulas, braces and integrals of each question."""
    f = _questions(spark, d).select("question_uid", F.explode(S.equations(F.col("question"))).alias("x"))
    count = lambda p: F.sum(F.regexp_count("x", F.lit(p)))
    return f.groupBy("question_uid").agg(F.count("*").alias("n"), count(r"\{").alias("opened"), count(r"\}").alias("closed"), count(r"\\int(?![A-Za-z])").alias("integrals"))


@query(_Q + """, f AS (SELECT question_uid, unnest(regexp_extract_all(question, '\\$(.*?)\\$', 1)) AS x0 FROM q), t AS (SELECT question_uid, trim(x0, ' ' || chr(9)) AS x FROM f),
 c AS (SELECT *, len(regexp_extract_all(x, '\\\\int')) - len(regexp_extract_all(x, '\\\\int[A-Za-z]')) AS ints, len(regexp_extract_all(x, '\\\\,d[xt]\\b')) AS ends, regexp_replace(regexp_replace(x, '\\{[^{}]*\\}', '□', 'g'), '\\{[^{}]*\\}', '□', 'g') AS folded FROM t)
 SELECT question_uid, x AS formula, count(*) AS n, array_to_string(list_filter([CASE WHEN len(replace(x, '{', '')) <> len(replace(x, '}', '')) THEN 'unbalanced braces' END, CASE WHEN len(regexp_extract_all(x, '\\\\begin')) <> len(regexp_extract_all(x, '\\\\end')) THEN 'begin/end mismatch' END,
 CASE WHEN ints <> ends THEN ints || ' integral sign(s) but ' || ends || ' differential(s)' END, CASE WHEN regexp_matches(folded, '\\\\int(?:_□)?(?:\\^□)?\\s*\\\\,d[xt]') THEN 'integral with empty integrand' END], lambda p: p IS NOT NULL), '|') AS problems FROM c GROUP BY ALL""")
def q_check_math(spark: SparkSession, d: str) -> DataFrame:
    """Problems of every formula as it stands."""
    f = _questions(spark, d).select("question_uid", F.explode(S.equations(F.col("question"))).alias("formula")).groupBy("question_uid", "formula").agg(F.count("*").alias("n"))
    return f.withColumn("problems", joined(mathtext.check_math(F.col("formula"))))


@query()
def q_auto_latex(spark: SparkSession, d: str) -> DataFrame:
    """Every question with its unmarked formulas as LaTeX."""
    return _questions(spark, d).select("question_uid", auto_latex_column(F.col("question")).alias("latex"))


@query()
def q_option_tags(spark: SparkSession, d: str) -> DataFrame:
    """Year tags that stand behind an option of the bank, moved to their question, and the options that have swallowed a next question."""
    q = table(spark, d, "questions").filter("question_uid is not null and options is not null").groupBy("question_uid").agg(F.any_value("question").alias("question"), F.any_value("options").alias("options"))
    r = q.select("question_uid", runs.option_tags(S.year_tag(F.col("question"))["tag"], F.col("options")).alias("r"))
    return r.select("question_uid", "r.tag", F.to_json("r.options").alias("options"), joined("r.swallowed").alias("swallowed"))


@query()
def q_attached_subscripts(spark: SparkSession, d: str) -> DataFrame:
    """Every question with the digits inside its chemical formulas as subscripts."""
    return _questions(spark, d).select("question_uid", chem.attached_subscripts(F.col("question")).alias("chem"))


@query()
def q_split_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each question, cut at dollar signs."""
    r = _questions(spark, d).select("question_uid", mathtext.split_runs(F.col("question")).alias("r"))
    return r.select("question_uid", "r.tag", F.posexplode("r.runs").alias("n", "run")).select("question_uid", "tag", "n", "run.kind", "run.text")


@query()
def q_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each question with the pieces of one formula in one, bare formulas found."""
    r = _questions(spark, d).select("question_uid", F.posexplode(runs.runs_of(F.col("question"))).alias("n", "run"))
    return r.select("question_uid", "n", "run.kind", "run.text")


@query()
def q_chem_subscripts(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its chemistry repaired."""
    q = chem.with_chem(_questions(spark, d).withColumn("chem", chem.attached_subscripts(F.col("question"))), "chem")
    return q.filter("chem <> question")


@query()
def q_latex_readable(spark: SparkSession, d: str) -> DataFrame:
    """Every question as readable text, its formulas marked or not."""
    return _questions(spark, d).select("question_uid", F.pandas_udf(readable_series, "string")("question").alias("readable"))


@query(_Q + """ SELECT question_uid, array_to_string(list_transform(regexp_extract_all(question, '\\[IMG:\\s*(.*?)\\]', 1), lambda x: x), '|') AS images FROM q WHERE regexp_matches(question, '\\[IMG:')""")
def q_image_markers(spark: SparkSession, d: str) -> DataFrame:
    """Pictures that questions name."""
    return _questions(spark, d).filter(F.col("question").contains("[IMG:")).select("question_uid", joined(S.images(F.col("question"))).alias("images"))


@query(_Q + " SELECT question_uid, regexp_matches(question, '(?i)match list|choose the correct|consider the following') AS instruction, regexp_matches(question, '(?i)\\b(?:Crash Course|DPPs|PYQs|Mentorship|Doubt Sessions|Concept videos)\\b|^Join\\b|Paid Courses|Subscribe to our|For:\\s*Boar\\s*d\\s*s|✉') AS noise FROM q")
def q_text_flags(spark: SparkSession, d: str) -> DataFrame:
    """Instructions and advertising among the questions."""
    return _questions(spark, d).select("question_uid", P.is_instruction(F.col("question")).alias("instruction"), P.is_noise(F.col("question")).alias("noise"))


_TAG = "\\(\\s*(?:19|20)\\d{2}[a-zA-Z0-9,\\s\\-/–—]*\\)"
_AT_END, _INSIDE = f"(?s)^(.*?)\\s*({_TAG})\\s*\\.?\\s*$", f"(?s)^(.*)({_TAG})(.*)$"


@query(_Q + f", e AS (SELECT *, regexp_matches(question, '{_AT_END}') AS last, regexp_matches(question, '{_INSIDE}') AS inside FROM q) SELECT question_uid, CASE WHEN last THEN {STRIP % ('regexp_replace(' + STRIP % ('regexp_extract(question, ' + chr(39) + _AT_END + chr(39) + ', 1)') + ', ' + chr(39) + ':+$' + chr(39) + ', ' + chr(39) * 2 + ')')}"
    + f" ELSE {STRIP % ('regexp_replace(' + STRIP % ('regexp_extract(question, ' + chr(39) + _INSIDE + chr(39) + ', 1) || regexp_extract(question, ' + chr(39) + _INSIDE + chr(39) + ', 3)') + ', ' + chr(39) + '[ \\t\\n\\x0B\\f\\r]{2,}' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} END AS stem,"
    + f" CASE WHEN last THEN regexp_extract(question, '{_AT_END}', 2) ELSE regexp_extract(question, '{_INSIDE}', 2) END AS citation FROM e WHERE last OR inside")
def q_citations(spark: SparkSession, d: str) -> DataFrame:
    """Year tags of the bank's questions, cut from their stems."""
    c = _questions(spark, d).select("question_uid", S.citation(F.col("question")).alias("c"))
    return c.filter("c.citation is not null").select("question_uid", "c.stem", "c.citation")


def _block_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ord, line): the lines of the exam files' paragraphs, in order."""
    b = blocks_of(table(spark, d, "document_blocks")).filter("block_type = 'paragraph' and text is not null")
    each = b.select("doc_id", "ord", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return each.select("doc_id", F.struct("ord", "n").alias("ord"), "line")


@query()
def q_line_parser(spark: SparkSession, d: str) -> DataFrame:
    """The exam files' lines by the older line rules."""
    return lineparse.parsed(_block_lines(spark, d)).withColumn("options", F.to_json("options"))


@query()
def q_line_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many records of the older line rules are parsed and how many have failed, by type."""
    good, bad = lineparse.outcomes(lineparse.parsed(_block_lines(spark, d)))
    return good.select("question_type", F.lit("parsed").alias("outcome")).unionByName(bad.select("question_type", F.lit("failed").alias("outcome"))).groupBy("question_type", "outcome").agg(F.count("*").alias("n"))


@query()
def q_raw_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The bank's questions as raw texts with their options below, read again."""
    q = table(spark, d, "questions").filter("question_uid is not null").groupBy("question_uid").agg(F.min("question").alias("question"), F.any_value("options").alias("options"))
    options = F.array_join(F.transform(F.map_entries("options"), lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), F.coalesce(e["value"], F.lit("")))), "\n")
    raw = q.select("question_uid", F.concat(F.coalesce("question", F.lit("")), F.lit("\n"), F.coalesce(options, F.lit(""))).alias("raw"))
    got = lineparse.parsed_raw(raw, "question_uid", "raw")
    return got.select("question_uid", "stem", F.to_json("options").alias("options"), "chapter", F.to_json("spill").alias("spill"), joined("leftovers").alias("leftovers"))


_FIX = "WITH q AS (SELECT question_uid, min(question) AS question, min(question_type) AS question_type FROM questions WHERE question_uid IS NOT NULL GROUP BY question_uid)"


@query(_FIX + """, c(key, question_type) AS (VALUES ('3', 'checked'), ('7', 'open'), ('11', 'checked')), m(key, match, question_type) AS (VALUES ('a', 'isotherm', 'm1'), ('b', 'impulse', 'm2'))
 SELECT q.question_uid, q.question, coalesce(CASE WHEN q.question <> '' THEN (SELECT max(m.question_type) FROM m WHERE contains(q.question, m.match)) END, CASE WHEN q.question <> '' THEN c.question_type END, q.question_type) AS question_type
 FROM q LEFT JOIN c ON c.key = CAST(q.question_uid AS VARCHAR)""")
def q_corrections_join(spark: SparkSession, d: str) -> DataFrame:
    """Types corrected by id, then by a word in the question."""
    q = table(spark, d, "questions").filter("question_uid is not null").groupBy(F.col("question_uid").alias("question_id")).agg(F.min("question").alias("question"), F.min("question_type").alias("question_type"))
    q = q.withColumn("options", F.lit(None).cast("map<string,string>")).withColumn("parsed_ok", F.lit(True))
    fixes = [("3", None, "checked"), ("7", None, "open"), ("11", None, "checked"), ("a", "isotherm", "m1"), ("b", "impulse", "m2")]
    c = spark.createDataFrame([(k, m, None, None, t, None) for k, m, t in fixes], "key string, match string, question string, options map<string,string>, question_type string, parsed_ok boolean")
    return repair.corrected(q, c).select(F.col("question_id").alias("question_uid"), "question", "question_type")


@query(bank.CHECKS + " SELECT question_type, CASE WHEN failed OR doubtful THEN 'applied' END AS recovery, count(*) AS n FROM checked GROUP BY 1, 2")
def q_recovery_merge(spark: SparkSession, d: str) -> DataFrame:
    """Failed questions of the exam lines with the proposals of a provider that gives every one the same options."""
    q = build(exam_blocks(spark, d)).questions.withColumn("question_id", F.concat_ws("-", "doc_id", "q_seq"))
    q = q.select("question_id", "section", "question", "options", "question_type", "parsed_ok", "needs_review")

    def provider(rows: list[dict]) -> list[dict]:
        return [{"id": r["key"], "question": r["question"] or "restored", "options": dict(zip("ABCD", ("w", "x", "y", "z"), strict=True))} for r in rows]

    out = repair.recovered(q, repair.proposals(repair.contexts(q), provider))
    return out.groupBy("question_type", "recovery").agg(F.count("*").alias("n"))


@query(_Q + f" SELECT question_uid, CASE WHEN question = '' THEN 0.35 ELSE round(greatest(0.35, list_sum(list_transform(string_split(question, chr(10)), lambda x: greatest(1, ceil(len({STRIP % 'x'}) / 78.0)))) * 0.333), 6) END AS height FROM q")
def q_content_height(spark: SparkSession, d: str) -> DataFrame:
    """Height of every question at 12 inches and 18 points."""
    return _questions(spark, d).select("question_uid", F.round(layout.content_height(F.col("question"), 12.0, 18), 6).alias("height"))


@query(f"""WITH o AS (SELECT question_uid, any_value(options) AS o FROM questions WHERE question_uid IS NOT NULL AND options IS NOT NULL GROUP BY question_uid), s AS (SELECT question_uid, list_transform(['A', 'B', 'C', 'D'], lambda c: {STRIP % "coalesce(o[c], '')"}) AS v FROM o)
 SELECT question_uid, list_bool_and(list_transform(v, lambda x: len(x) BETWEEN 1 AND 32 AND len(x) - len(replace(x, chr(10), '')) <= 1)) AS fits FROM s""")
def q_fit_1x4(spark: SparkSession, d: str) -> DataFrame:
    """Whether the options of each question fit in one row: all four there, short, and at most two lines high."""
    o = table(spark, d, "questions").filter("question_uid is not null and options is not null").groupBy("question_uid").agg(F.any_value("options").alias("options"))
    return o.select("question_uid", layout.fits_one_row(F.col("options")).alias("fits"))


@query("SELECT DISTINCT p_brand AS badge, CAST(round(15 * (len(regexp_replace(p_brand, '[^, \\-/]', '', 'g')) * 0.0045 + len(regexp_replace(p_brand, '[^1I]', '', 'g')) * 0.005 + len(regexp_replace(p_brand, '[^MW]', '', 'g')) * 0.0095 + len(regexp_replace(p_brand, '[, \\-/1IMW]', '', 'g')) * 0.0078) + 0.36, 2) AS DOUBLE) AS width FROM part")
def q_badge_width(spark: SparkSession, d: str) -> DataFrame:
    """Widths of badges."""
    b = table(spark, d, "part").select(F.col("p_brand").alias("badge")).distinct()
    return b.select("badge", layout.badge_width(F.col("badge")).alias("width"))


@query()
def q_slide_pagination(spark: SparkSession, d: str) -> DataFrame:
    """Components of the exam files' questions on slides."""
    return layout.paginated(layout.components(build(blocks_of(table(spark, d, "document_blocks"))).questions)).drop("text")


@query()
def q_slide_map(spark: SparkSession, d: str) -> DataFrame:
    """The slides of each question of the exam files."""
    return layout.slide_map(layout.paginated(layout.components(build(blocks_of(table(spark, d, "document_blocks"))).questions)))


@query("""WITH u AS (SELECT DISTINCT file_id, source_block_id FROM source_ledger), s AS (SELECT file_id, source_block_id, max(status) AS status FROM source_ledger WHERE status <> 'orphaned' GROUP BY file_id, source_block_id)
 SELECT file_id, source_block_id, coalesce(s.status, 'failed') AS status FROM u LEFT JOIN s USING (file_id, source_block_id)""")
def q_math_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each ledger block by its last outcome; blocks without any have failed."""
    l = table(spark, d, "source_ledger").withColumn("math_id", F.struct("file_id", "source_block_id"))  # noqa: E741
    out = layout.reconciled(l.select("math_id"), l.filter("status <> 'orphaned'").select("math_id", "status", F.col("status").alias("seq")))
    return out.select("math_id.file_id", "math_id.source_block_id", "status")


def _page_spans(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as spans of pages: fixed steps across, so that wide gaps and rises occur."""
    c = F.col
    rows = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o"), c("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("text"))
    x0 = c("n") * 60.0 + F.when(c("p") % 5 == 0, 40.0).otherwise(0.0)
    return rows.select((c("o") % 97).cast("bigint").alias("doc_id"), (F.floor(c("o") / 97) % 11).cast("bigint").alias("page"), c("o").cast("bigint").alias("line_no"), c("n").cast("bigint").alias("span_no"), "text", F.when(c("p") % 3 == 0, 8.0).otherwise(12.0).alias("size"), x0.alias("x0"), (x0 + 45.0).alias("x1"), (F.lit(100.0) + F.when(c("p") % 3 == 0, -4.0).otherwise(0.0)).alias("y"), (c("o") * 3.0).alias("line_y0"), (c("o") * 3.0 + 4.0).alias("line_y1"))


@query("""WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), s AS (SELECT o, n, n * 60.0 + CASE WHEN p % 5 = 0 THEN 40.0 ELSE 0.0 END AS x0, CASE WHEN p % 3 = 0 THEN 8.0 ELSE 12.0 END AS size FROM r),
 g AS (SELECT *, CASE WHEN x0 - lag(x0 + 45.0) OVER w > 2 * greatest(size, lag(size) OVER w) THEN 1 ELSE 0 END AS wide FROM s WINDOW w AS (PARTITION BY o ORDER BY x0, n)) SELECT o AS line_no, n AS span_no, CAST(sum(wide) OVER (PARTITION BY o ORDER BY x0, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g""")
def q_span_segments(spark: SparkSession, d: str) -> DataFrame:
    """Spans cut into segments at wide gaps."""
    return pagespans.segments(_page_spans(spark, d)).select("line_no", "span_no", "segment")


@query("""WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_returnflag) AS text FROM lineitem GROUP BY 1, 2), s AS (SELECT o, n, text, n * 60.0 + CASE WHEN p % 5 = 0 THEN 40.0 ELSE 0.0 END AS x0, CASE WHEN p % 3 = 0 THEN 8.0 ELSE 12.0 END AS size, CASE WHEN p % 3 = 0 THEN 96.0 ELSE 100.0 END AS y FROM r),
 g AS (SELECT *, CASE WHEN x0 - lag(x0 + 45.0) OVER w > 2 * greatest(size, lag(size) OVER w) THEN 1 ELSE 0 END AS wide FROM s WHERE text <> '' WINDOW w AS (PARTITION BY o ORDER BY x0, n)), m AS (SELECT *, sum(wide) OVER (PARTITION BY o ORDER BY x0, n ROWS UNBOUNDED PRECEDING) AS seg FROM g),
 b AS (SELECT *, max(size) OVER (PARTITION BY o, seg) AS base FROM m), k AS (SELECT *, min_by(y, {'x': x0, 'n': n}) FILTER (WHERE size = base) OVER (PARTITION BY o, seg) AS base_y FROM b),
 t AS (SELECT *, CASE WHEN size < 0.95 * base AND abs(y - base_y) >= 1 THEN CASE WHEN y < base_y THEN '^{' || text || '}' ELSE '_{' || text || '}' END ELSE text END AS shown FROM k),
 i AS (SELECT o % 97 AS doc_id, (o // 97) % 11 AS page, o, seg, string_agg(shown, '' ORDER BY x0, n) AS text, min(x0) AS x0, o * 3.0 AS y0, o * 3.0 + 4.0 AS y1 FROM t GROUP BY o, seg),
 a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0 / 5, 0) * 5, x0, o, seg) AS item FROM i), z AS (SELECT *, CASE WHEN y0 > max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS below FROM a)
 SELECT doc_id, page, CAST(item AS INTEGER) AS item, text, CAST(sum(below) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, item ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_group FROM z""")
def q_line_groups(spark: SparkSession, d: str) -> DataFrame:
    """Items of the pages in groups that overlap from top to bottom."""
    return pagespans.line_groups(pagespans.items(_page_spans(spark, d))).select("doc_id", "page", "item", "text", "line_group")


@query()
def q_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the pages, with a drawn rule under every eleventh line."""
    spans = _page_spans(spark, d)
    drawn = spans.filter("line_no % 11 = 0").groupBy("doc_id", "page", "line_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("line_y1").alias("y0"))
    return pagespans.page_blocks(spans, drawn.select("doc_id", "page", F.lit("line").alias("kind"), "x0", "y0", "x1", F.col("y0").alias("y1")))


@query()
def q_formula_trees(spark: SparkSession, d: str) -> DataFrame:
    """LaTeX of the formula trees anywhere in the blocks, also in nested rows, cells and paragraphs, with their places. Runs, which repeat a formula as flat text, are left out."""
    named = F.lit(False)
    for f in nested.FIELDS:
        named = named | F.coalesce(F.col(f).contains("math_sequence"), F.lit(False))
    b = once_per(table(spark, d, "document_blocks").select("block_uid", *nested.FIELDS, "ingested_at").filter(named), "block_uid", ["ingested_at", *nested.FIELDS])
    return b.select("block_uid", F.posexplode(mathtree.placed_formulas()).alias("n", "x")).select("block_uid", "n", "x.node_path", "x.latex")


@query()
def q_formula_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The same formulas by the intervals of their nodes, anywhere in the blocks, with their names in a deck."""
    nodes = layout.outermost_formulas(nested.flatten_nodes(table(spark, d, "document_blocks")))
    return nodes.select("block_uid", "node_path", layout.math_id(F.lit("1"), F.col("block_uid").cast("string"), F.col("idx")).alias("math_id"))


_CITED = f"CASE WHEN regexp_matches(%s, '{_AT_END}') THEN regexp_extract(%s, '{_AT_END}', 2) WHEN regexp_matches(%s, '{_INSIDE}') THEN regexp_extract(%s, '{_INSIDE}', 2) END"


@query(f"""WITH b AS (SELECT question_uid, any_value(question) AS question, any_value(options) AS o, any_value(appearances) AS seen, any_value(parsed_ok) AS ok, any_value(needs_review) AS doubt FROM questions WHERE question_uid IS NOT NULL GROUP BY question_uid),
 c AS (SELECT *, list_filter(list_transform(seen, lambda a: regexp_replace(regexp_replace(a, '^[()\\[\\] \\t]+', ''), '[()\\[\\] \\t]+$', '')), lambda a: a <> '') AS s, o['D'] AS d FROM b),
 t AS (SELECT question_uid, coalesce(doubt, false) OR NOT coalesce(ok, true) AS doubtful, CASE WHEN len(s) > 0 THEN array_to_string(s, ', ') ELSE coalesce({_CITED % (("question",) * 4)}, {_CITED % (("d",) * 4)}) END AS said FROM c)
 SELECT question_uid, CASE WHEN doubtful THEN CASE WHEN said IS NULL THEN 'NEEDS REVIEW' ELSE said || ' · NEEDS REVIEW' END ELSE said END AS badge FROM t WHERE doubtful OR said IS NOT NULL""")
def q_badges(spark: SparkSession, d: str) -> DataFrame:
    """Badges of the bank's questions."""
    q = table(spark, d, "questions").filter("question_uid is not null").groupBy("question_uid").agg(*[F.any_value(c).alias(c) for c in ("question", "options", "appearances", "parsed_ok", "needs_review")])
    return q.select("question_uid", layout.badge(*[F.col(c) for c in ("question", "options", "appearances", "parsed_ok", "needs_review")]).alias("badge")).filter("badge is not null")
