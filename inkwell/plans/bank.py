"""Queries over the exam lines and the question bank made of them, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.fixtures import SQL as EXAM
from inkwell.fixtures import exam_blocks, exam_lines
from inkwell.functions import predicates as P
from inkwell.functions import spans as S
from inkwell.operators import align, layout, ledger, pagespans, segment
from inkwell.operators.pipeline import Bank, blocks_of, build
from inkwell.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def joined(c: str | Column, sep: str = "|") -> Column:
    return F.array_join(c, sep, "")


def _bank(spark: SparkSession, d: str) -> Bank:
    return build(exam_blocks(spark, d))


_WHITE = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: Without white space of any kind at both ends, as the operators strip text.
STRIP = f"regexp_replace(regexp_replace(%s, '^{_WHITE}+', ''), '{_WHITE}+$', '')"


# The same steps in SQL. The lines hold only some of the forms that the operators know, so their patterns can do without lookaround.
_NOISE = "regexp_matches(line, '(?i)\\b(Crash Course|DPPs|PYQs)\\b|^Join\\b')"
_LABEL = "(?:\\(%s\\)|\\b%s\\.\\s)\\s*"
ROWS = f""", b AS (SELECT *, {_NOISE} AS is_noise, CASE WHEN regexp_matches(line, '^Section [A-E]$') THEN line END AS head FROM exam_lines),
rows_ AS (SELECT doc_id, ord, line, is_noise, head, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), 'General') AS section,
  list_filter(string_split(array_to_string(regexp_extract_all(line, '[\\(\\[]((?:19|20)\\d\\d[^\\)\\]]*)[\\)\\]]', 1), ', '), ', '), lambda x: x <> '') AS apps,
  trim(regexp_replace(line, '[\\(\\[](?:19|20)\\d\\d[^\\)\\]]*[\\)\\]]', '', 'g')) AS text FROM b)"""
PARTS = (
    ROWS
    + """, pieces AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '\\(([A-Da-d])\\)', chr(1) || '(\\1)', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM rows_ WHERE NOT is_noise),
parts AS (SELECT doc_id, ord, section, apps, ps, CASE WHEN len(ps) < 2 THEN 0 ELSE i END AS part, CAST(ord AS VARCHAR) || CASE WHEN len(ps) < 2 THEN '' ELSE '.part_' || i END AS part_id, ps[i] AS text
  FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM pieces))"""
)
FLAGS = (
    PARTS
    + """, f0 AS (SELECT *, row_number() OVER w AS rn, section <> lag(section, 1, 'General') OVER w AS moved,
  regexp_matches(text, '(?i)^(?:Q(?:uestion)?\\s*)?\\d+[.):]\\s') AS main, regexp_matches(text, '(?i)^(?:\\([a-z]{1,3}\\)|I{1,3}\\.)\\s') AS subp, regexp_matches(text, '^II\\. Find') AS roman,
  regexp_matches(text, '^(?:Evaluate|Find|which|where) ') AS asks, regexp_matches(text, '^(?:\\([A-Da-d]\\)|[A-D]\\.\\s|[a-z])') AS goes_on, regexp_matches(text, '[.?!:\\])$]$') AS ends,
  (CASE WHEN regexp_matches(text, '(?i)\\(a\\)|^a\\.\\s') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '(?i)\\(b\\)|^b\\.\\s') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(text, '(?i)\\(c\\)|^c\\.\\s') THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '(?i)\\(d\\)|^d\\.\\s') THEN 8 ELSE 0 END) AS mask FROM parts WHERE NOT regexp_matches(text, '^Section [A-E]$') WINDOW w AS (PARTITION BY doc_id ORDER BY ord, part)),
f1 AS (SELECT *, sum(CASE WHEN moved THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS run FROM f0),
walk AS (SELECT doc_id, rn, 1 AS q_seq, true AS new_, mask AS labels, ends AS ended FROM f1 WHERE rn = 1
  UNION ALL
  SELECT doc_id, rn, q_seq + CASE WHEN new_ THEN 1 ELSE 0 END, new_, CASE WHEN new_ THEN mask ELSE labels | mask END, ends FROM (
    SELECT f.doc_id, f.rn, s.q_seq, s.labels, f.mask, f.ends, CASE WHEN f.roman AND (s.labels = 15 OR f.moved) THEN true WHEN f.main THEN true WHEN f.subp THEN false
      WHEN f.moved THEN s.labels = 15 OR f.asks WHEN f.goes_on THEN false ELSE s.labels = 15 END AS new_
    FROM walk s JOIN f1 f ON f.doc_id = s.doc_id AND f.rn = s.rn + 1)),
seg AS (SELECT f1.*, walk.q_seq, walk.new_ FROM f1 JOIN walk USING (doc_id, rn))"""
)
FLAGS_HEAD = EXAM.replace("WITH p AS", "WITH RECURSIVE p AS", 1)
NUMBERS = """, n0 AS (SELECT doc_id, q_seq, section, run, moved, CASE WHEN main THEN 'arabic' ELSE 'roman' END AS scheme, CASE WHEN main THEN CAST(regexp_extract(text, '\\d+') AS BIGINT) ELSE 2 END AS value,
  CASE WHEN main THEN regexp_extract(text, '\\d+') ELSE 'II' END AS label FROM seg WHERE new_ AND (main OR roman)),
n1 AS (SELECT *, lag(value) OVER w AS lv, lag(run) OVER w AS lr, lag(scheme) OVER w AS ls, row_number() OVER (PARTITION BY doc_id, run, value ORDER BY q_seq) > 1 AS again FROM n0 WINDOW w AS (PARTITION BY doc_id ORDER BY q_seq)),
n2 AS (SELECT *, CASE WHEN moved THEN CASE WHEN lr = run - 1 THEN lv END WHEN lr = run THEN lv END AS previous FROM n1),
numbers AS (SELECT doc_id, q_seq, section, scheme, value, label, previous, again, CASE WHEN moved AND previous IS NOT NULL THEN 'section_reset' WHEN lr = run AND ls <> scheme THEN 'numbering_scheme_transition'
  WHEN value < previous THEN 'regression' WHEN again THEN 'duplicate' WHEN value > previous + 1 THEN 'gap' ELSE 'sequence' END AS event FROM n2)"""
_FOUR = "(?is)^(.*)" + "(.*?)".join(_LABEL % (c, c) for c in "ABCD") + "(.*)$"
RECORDS = (
    NUMBERS
    + f""", c0 AS (SELECT doc_id, q_seq, min(section) FILTER (WHERE new_) AS section, trim(string_agg(text, chr(10) ORDER BY rn)) AS combined, count(*) AS n_blocks, list(DISTINCT ord) AS owners, flatten(list(apps ORDER BY rn)) AS apps FROM seg GROUP BY doc_id, q_seq),
c1 AS (SELECT c0.*, numbers.label, numbers.event, CASE WHEN numbers.scheme = 'roman' THEN trim(regexp_replace(combined, '^II\\.\\s*', '')) ELSE trim(regexp_replace(combined, '(?i)^(?:Q\\s*)?\\d+[.)]\\s*', '')) END AS body FROM c0 LEFT JOIN numbers USING (doc_id, q_seq)),
q0 AS (SELECT *, regexp_matches(body, '{_FOUR}') AS four, regexp_extract(body, '{_FOUR}', ['s', 'a', 'b', 'c', 'd']) AS o FROM c1),
q1 AS (SELECT *, CASE WHEN four THEN trim(o.s, chr(10) || ' ') ELSE body END AS stem0, CASE WHEN four THEN trim(o.a, chr(10) || ' ') END AS opt_a, CASE WHEN four THEN trim(o.b, chr(10) || ' ') END AS opt_b,
  CASE WHEN four THEN trim(o.c, chr(10) || ' ') END AS opt_c, CASE WHEN four THEN trim(o.d, chr(10) || ' ') END AS opt_d FROM q0)"""
)


@query(EXAM + " SELECT doc_id, ord, line FROM exam_lines")
def q_exam_lines(spark: SparkSession, d: str) -> DataFrame:
    """The base relation."""
    return exam_lines(spark, d)


@query(EXAM + f" SELECT doc_id, ord, line FROM exam_lines WHERE NOT {_NOISE}")
def q_noise_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no advertising."""
    return exam_lines(spark, d).filter(~P.is_noise(F.col("line")))


@query(EXAM + ROWS + " SELECT doc_id, ord, section FROM rows_ WHERE NOT is_noise")
def q_section_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Every line's section: the last header before it."""
    return segment.prepared(exam_blocks(spark, d)).filter("not is_noise").select("doc_id", "ord", "section")


@query(EXAM + ROWS + " SELECT doc_id, section, count(*) AS n_blocks, min(ord) AS first_ord FROM rows_ WHERE NOT is_noise GROUP BY doc_id, section")
def q_section_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each document with their sizes."""
    rows = segment.prepared(exam_blocks(spark, d)).filter("not is_noise")
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_blocks"), F.min("ord").alias("first_ord"))


@query(
    EXAM + """ SELECT doc_id, ord, CASE WHEN m THEN 'main' WHEN s THEN 'subpart' ELSE 'roman' END AS kind,
 CASE WHEN m THEN regexp_extract(line, '\\d+') WHEN s THEN regexp_extract(line, '^\\(([A-Za-z]{1,3})\\)', 1) ELSE 'II' END AS value FROM (SELECT *, regexp_matches(line, '(?i)^(?:Q(?:uestion)?\\s*)?\\d+[.):]\\s') AS m,
 regexp_matches(line, '^\\([A-Za-z]{1,3}\\)\\s') AS s, regexp_matches(line, '^II\\.\\s') AS r FROM exam_lines) WHERE m OR s OR r"""
)
def q_question_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Lines that begin with a number, by kind."""
    rows = exam_lines(spark, d).withColumn("number", P.question_number(F.col("line"))).filter("number is not null")
    return rows.select("doc_id", "ord", "number.kind", "number.value")


@query(EXAM + ROWS + " SELECT doc_id, ord, array_to_string(apps, '|') AS appearances, text FROM rows_ WHERE len(apps) > 0")
def q_metadata_spans(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each line and the line without them."""
    rows = exam_lines(spark, d).select("doc_id", "ord", S.appearances(F.col("line")).alias("apps"), S.without_citations(F.col("line")).alias("text"))
    return rows.filter(F.size("apps") > 0).select("doc_id", "ord", joined("apps").alias("appearances"), "text")


@query(EXAM + PARTS + " SELECT doc_id, ord, part, part_id, text FROM parts")
def q_inline_option_split(spark: SparkSession, d: str) -> DataFrame:
    """Lines cut at their option labels."""
    return segment.parts(segment.prepared(exam_blocks(spark, d))).filter("text <> ''").select("doc_id", "ord", "part", "part_id", "text")


@query(FLAGS_HEAD + FLAGS + " SELECT doc_id, ord, part, q_seq FROM seg")
def q_candidates_fold(spark: SparkSession, d: str) -> DataFrame:
    """The question of every part."""
    return _bank(spark, d).parts.select("doc_id", "ord", "part", "q_seq")


@query(FLAGS_HEAD + FLAGS + NUMBERS + " SELECT doc_id, q_seq, section, scheme, value, label, event, previous, again AS duplicate FROM numbers")
def q_numbering_events(spark: SparkSession, d: str) -> DataFrame:
    """Question numbers held against those before."""
    return _bank(spark, d).numbers.drop("raw")


@query(FLAGS_HEAD + FLAGS + RECORDS + " SELECT doc_id, q_seq, opt_a, opt_b, opt_c, opt_d FROM q1 WHERE four")
def q_options_extract(spark: SparkSession, d: str) -> DataFrame:
    """Options of the questions that have all four."""
    q = _bank(spark, d).records.filter(F.size("options") > 0)
    return q.select("doc_id", "q_seq", *[F.col("options")[c].alias(f"opt_{c.lower()}") for c in "ABCD"])


@query(FLAGS_HEAD + FLAGS + RECORDS + " SELECT section, count(*) AS n, count(*) FILTER (WHERE four) AS complete, count(label) AS numbered FROM q1 GROUP BY section")
def q_missing_options(spark: SparkSession, d: str) -> DataFrame:
    """Questions, those with all options and those with a number, by section."""
    q = _bank(spark, d).records
    return q.groupBy("section").agg(F.count("*").alias("n"), F.count_if(F.size("options") == 4).alias("complete"), F.count_if(F.col("source_question_number").isNotNull()).alias("numbered"))


@query(FLAGS_HEAD + FLAGS + RECORDS + " SELECT doc_id, q_seq FROM q1 WHERE four AND len(list_distinct([opt_a, opt_b, opt_c, opt_d])) < 4")
def q_duplicate_options(spark: SparkSession, d: str) -> DataFrame:
    """Questions of which two options are the same."""
    return _bank(spark, d).questions.filter(F.array_contains("issues", "DUPLICATE_OPTION_VALUES")).select("doc_id", "q_seq")


_TYPES = """, ty AS (SELECT *, regexp_matches(body, '(?i)\\bAssertion\\s*(?:A|:)\\s*') AND regexp_matches(body, '(?i)\\bReason\\s*(?:R|:)\\s*') AS ar, regexp_matches(body, '(?i)\\bStatement\\s*(?:I|1)\\s*[:.]') AS st FROM q1),
typed AS (SELECT *, CASE WHEN ar THEN 'assertion_reason' WHEN st OR regexp_matches(stem0, '(?:^|\\n)A\\.\\s+') THEN 'statement_based' WHEN four THEN 'mcq' WHEN regexp_matches(stem0, '(?i)\\b(?:Calculate|Find|Evaluate|Determine)\\b') THEN 'numerical' ELSE 'open_question' END AS question_type FROM ty)"""


@query(FLAGS_HEAD + FLAGS + RECORDS + _TYPES + " SELECT question_type, count(*) AS n FROM typed GROUP BY question_type")
def q_question_types(spark: SparkSession, d: str) -> DataFrame:
    """How many questions there are of each type."""
    return _bank(spark, d).records.groupBy("question_type").agg(F.count("*").alias("n"))


@query()
def q_questions(spark: SparkSession, d: str) -> DataFrame:
    """The whole record of every question of the exam lines."""
    q = _bank(spark, d).questions
    cols = ["doc_id", "q_seq", "section", "source_question_number", "raw_question_number", "event", "question", "question_type", "parsed_ok", "needs_review", "quality_score", "has_equation", "confidence.overall"]
    return q.select(*cols, F.to_json("options").alias("options"), F.to_json("statements").alias("statements"), F.to_json("subparts").alias("subparts"), joined("appearances").alias("appearances"), joined("equations").alias("equations"), joined("block_ids").alias("block_ids"), joined("issues").alias("issues"))


_STATED = "(?i)(?:^|\\n)Statement\\s*(?:I|1)\\s*[:.]\\s+"
#: The checks in SQL. On these lines a stem is blank exactly where it begins with its statements, and all options are there or none.
_CHECKED = (
    _TYPES
    + f""", v0 AS (SELECT *, CASE WHEN regexp_matches(stem0, '{_STATED}') THEN trim(regexp_replace(stem0, '(?s){_STATED}.*$', '')) ELSE stem0 END AS stem, four AND len(list_distinct([opt_a, opt_b, opt_c, opt_d])) < 4 AS doubled,
  four AND list_contains([opt_a, opt_b, opt_c, opt_d], '') AS hollow FROM typed),
v1 AS (SELECT *, stem = '' AS blank, stem = '' OR hollow AS failed, stem = '' OR hollow OR doubled OR contains(stem, '00 g') AS doubtful FROM v0),
checked AS (SELECT *, round(greatest(0.0, least(1.0, 0.65 + CASE WHEN blank THEN 0.0 ELSE 0.2 END + CASE WHEN four THEN 0.15 ELSE 0.0 END - CASE WHEN failed THEN 0.25 ELSE 0.0 END - CASE WHEN doubtful THEN 0.1 ELSE 0.0 END)), 2) AS score FROM v1)"""
)
CHECKS = FLAGS_HEAD + FLAGS + RECORDS + _CHECKED


@query(CHECKS + """ SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN blank THEN 'EMPTY_STEM_NO_CONTENT' END, CASE WHEN doubled THEN 'DUPLICATE_OPTION_VALUES' END], lambda x: x IS NOT NULL)) AS issue FROM checked
 UNION ALL SELECT 'EMPTY_OPTIONS' FROM checked WHERE hollow) GROUP BY issue""")
def q_validation_issues(spark: SparkSession, d: str) -> DataFrame:
    """How often each issue occurs; the labels of empty options are left out of the name."""
    q = _bank(spark, d).questions.select(F.explode("issues").alias("issue"))
    return q.withColumn("issue", F.regexp_replace("issue", r"^EMPTY_OPTIONS: .*", "EMPTY_OPTIONS")).groupBy("issue").agg(F.count("*").alias("n"))


@query(CHECKS + " SELECT CASE WHEN failed THEN 'rejected' WHEN doubtful THEN 'needs_review' ELSE 'accepted' END AS bucket, count(*) AS n, round(avg(CAST(score AS DOUBLE)), 6) AS quality FROM checked GROUP BY 1")
def q_outcome_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Accepted, to be reviewed, rejected."""
    return ledger.outcome(_bank(spark, d).questions).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("quality"))


@query(CHECKS + " SELECT doc_id, q_seq, NOT failed AS parsed_ok, doubtful AS needs_review, CAST(score AS DOUBLE) AS quality_score FROM checked")
def q_quality_score(spark: SparkSession, d: str) -> DataFrame:
    """What validation says of each question."""
    return _bank(spark, d).questions.select("doc_id", "q_seq", "parsed_ok", "needs_review", "quality_score")


@query(CHECKS + """ SELECT doc_id, q_seq, CASE WHEN four THEN 4 ELSE 0 END AS option_count, four AS has_options, regexp_matches(body, '(?i)\\bAssertion\\s*(?:A|:)\\s*') AS has_assertion, regexp_matches(body, '(?i)\\bReason\\s*(?:R|:)\\s*') AS has_reason,
 regexp_matches(combined, '\\$.*?\\$') AS has_equation, stem <> stem0 AS has_statement_list, regexp_matches(body, '_{3,}') AS has_blank, false AS has_table, false AS has_image FROM checked""")
def q_features(spark: SparkSession, d: str) -> DataFrame:
    """The features from which the type of each question follows."""
    names = ("option_count", "has_options", "has_assertion", "has_reason", "has_equation", "has_statement_list", "has_blank", "has_table", "has_image")
    return _bank(spark, d).records.select("doc_id", "q_seq", *[f"features.{n}" for n in names])


_MARK = "\\(\\s*%s\\s*\\)\\s+"
_ITEMS = ", ".join(
    f"CASE WHEN regexp_matches(body, '(?i)(?:^|\\n){_MARK % c}') THEN {{'label': '{c}', 'text': trim(regexp_extract(body, '(?is)(?:^|\\n){_MARK % c}(.*?)(?:" + (f"\\n{_MARK % n}|" if n else "") + "$)', 1), ' ' || chr(10))} END" for c, n in zip("abcdefgh", [*"bcdefgh", ""])
)
_PAIR = "(?is)(?:^|\\n)Statement\\s*(I|1)\\s*[:.]\\s+(.*?)\\nStatement\\s*(II|2)\\s*[:.]\\s+(.*)$"
_LINES = "list_sum(list_transform(string_split(text, chr(10)), lambda x: greatest(1, ceil(len(trim(x)) / 78.0))))"
_SLIDES = f""", sub0 AS (SELECT *, regexp_matches(stem, '(?i)(?:^|\\n){_MARK % "a"}') AS listed, regexp_extract(stem0, '{_PAIR}', ['l1', 't1', 'l2', 't2']) AS pair FROM checked),
sub1 AS (SELECT *, CASE WHEN listed THEN regexp_replace(stem, '(?is)(?:^|\\n){_MARK % "a"}.*$', '') ELSE stem END AS front FROM sub0), sub2 AS (SELECT *, substr(stem, len(front) + 1) AS body FROM sub1),
sub3 AS (SELECT *, CASE WHEN listed THEN [{_ITEMS}] ELSE [] END AS items FROM sub2), sub4 AS (SELECT *, coalesce(list_position(list_transform(items, lambda x: x IS NULL), true), len(items) + 1) - 1 AS n_items FROM sub3),
comp AS (SELECT doc_id, q_seq, list_concat([{{'id': 'question', 'text': trim(front, ' ' || chr(10))}}], CASE WHEN stem <> stem0 THEN [{{'id': 'statement:1', 'text': pair.l1 || '. ' || trim(pair.t1, ' ' || chr(10))}}, {{'id': 'statement:2', 'text': pair.l2 || '. ' || trim(pair.t2, ' ' || chr(10))}}] ELSE [] END,
  list_transform(range(1, n_items + 1), lambda i: {{'id': 'subpart:' || i, 'text': items[i].label || ' ' || items[i].text}}),
  CASE WHEN four THEN [{{'id': 'option:A', 'text': '(A) ' || opt_a}}, {{'id': 'option:B', 'text': '(B) ' || opt_b}}, {{'id': 'option:C', 'text': '(C) ' || opt_c}}, {{'id': 'option:D', 'text': '(D) ' || opt_d}}] ELSE [] END) AS cs FROM sub4),
each_ AS (SELECT doc_id, q_seq, i - 1 AS comp_seq, cs[i].id AS component_id, cs[i].text AS text FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM comp)),
sized AS (SELECT *, CASE WHEN text = '' THEN 0.35 ELSE greatest(0.35, CAST({_LINES} AS DOUBLE) * 0.333) END + 0.05 AS height FROM each_),
placed AS (SELECT doc_id, q_seq, comp_seq, component_id, height, 1 AS slide, CAST(1.25 AS DOUBLE) AS y FROM sized WHERE comp_seq = 0
  UNION ALL SELECT n.doc_id, n.q_seq, n.comp_seq, n.component_id, n.height, p.slide + CASE WHEN p.y + p.height + n.height > 7.1 AND p.y + p.height > 1.55 THEN 1 ELSE 0 END, CASE WHEN p.y + p.height + n.height > 7.1 AND p.y + p.height > 1.55 THEN 1.25 ELSE p.y + p.height END
  FROM placed p JOIN sized n ON n.doc_id = p.doc_id AND n.q_seq = p.q_seq AND n.comp_seq = p.comp_seq + 1)"""


@query(CHECKS + _SLIDES + " SELECT doc_id, q_seq, CAST(comp_seq AS INTEGER) AS comp_seq, component_id, round(height, 4) AS height, slide, round(y, 4) AS y FROM placed")
def q_exam_slides(spark: SparkSession, d: str) -> DataFrame:
    """Components of the exam lines' questions on slides."""
    return layout.paginated(layout.components(_bank(spark, d).questions)).drop("text").withColumn("height", F.round("height", 4))


_LEDGER = """, own AS (SELECT doc_id, ord, min(q_seq) AS q_seq FROM seg GROUP BY doc_id, ord), spans AS (SELECT doc_id, q_seq, min(ord) AS first_ord FROM seg GROUP BY doc_id, q_seq),
cites AS (SELECT r.doc_id, r.ord, coalesce(max(s.q_seq) FILTER (WHERE s.first_ord < r.ord), min(s.q_seq)) AS q_seq FROM rows_ r JOIN spans s USING (doc_id) WHERE NOT r.is_noise AND r.text = '' AND len(r.apps) > 0 GROUP BY r.doc_id, r.ord),
book AS (SELECT r.doc_id, r.ord, CASE WHEN r.is_noise THEN 'ignored_with_reason' WHEN coalesce(own.q_seq, cites.q_seq) IS NOT NULL THEN 'consumed' WHEN r.head IS NOT NULL THEN 'ignored_with_reason' ELSE 'orphaned' END AS status,
  coalesce(own.q_seq, cites.q_seq) AS q_seq FROM rows_ r LEFT JOIN own USING (doc_id, ord) LEFT JOIN cites USING (doc_id, ord))"""


@query(FLAGS_HEAD + FLAGS + _LEDGER + " SELECT doc_id, ord, status, q_seq FROM book")
def q_source_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What became of every line."""
    return _bank(spark, d).ledger.select("doc_id", "ord", "status", "q_seq")


@query(FLAGS_HEAD + FLAGS + _LEDGER + " SELECT doc_id, ord, q_seq FROM cites")
def q_citation_asof(spark: SparkSession, d: str) -> DataFrame:
    """Citation-only lines with the question before them."""
    bank = _bank(spark, d)
    return ledger.citation_targets(ledger.citation_blocks(bank.rows), bank.parts).select("doc_id", "ord", "q_seq")


@query(FLAGS_HEAD + FLAGS + RECORDS.replace(", c0 AS", ", c0 AS", 1) + _LEDGER + """ SELECT book.doc_id, count(*) AS total_source_blocks, count(*) FILTER (WHERE status = 'consumed') AS consumed, count(*) FILTER (WHERE status = 'orphaned') AS orphan_blocks,
 count(*) FILTER (WHERE status = 'ignored_with_reason') AS ignored, max(questions) AS questions_detected, max(numbered) AS numbered FROM book LEFT JOIN (SELECT doc_id, count(*) AS questions, count(label) AS numbered FROM q1 GROUP BY doc_id) USING (doc_id) GROUP BY book.doc_id""")
def q_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each document."""
    return _bank(spark, d).diagnostics.select("doc_id", "total_source_blocks", "consumed", "orphan_blocks", "ignored", "questions_detected", "numbered")


@query(FLAGS_HEAD + FLAGS + " SELECT doc_id, part_id, count(DISTINCT q_seq) AS n FROM seg GROUP BY doc_id, part_id HAVING count(DISTINCT q_seq) > 1")
def q_duplicate_block_refs(spark: SparkSession, d: str) -> DataFrame:
    """Parts that two questions name; none is expected."""
    return ledger.duplicate_references(_bank(spark, d).questions)


@query()
def q_block_bank(spark: SparkSession, d: str) -> DataFrame:
    """The question bank of the exam files: every question of document_blocks with its outcome, tables and inline nodes."""
    q = ledger.outcome(build(blocks_of(table(spark, d, "document_blocks"))).questions)
    return q.select("doc_id", "q_seq", "section", "source_question_number", "question", "question_type", F.size("options").alias("n_options"), "bucket", "quality_score", joined("issues").alias("issues"), F.to_json("tables").alias("tables"), F.to_json("inline_content").alias("inline_content"))


@query()
def q_block_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each exam file."""
    return build(blocks_of(table(spark, d, "document_blocks"))).diagnostics


@query(f"""WITH b AS (SELECT block_uid, min(file_id) AS file_id, min(page) AS page, min(text) AS text FROM document_blocks WHERE block_uid IS NOT NULL AND page IS NOT NULL GROUP BY block_uid),
 n AS (SELECT file_id, count(DISTINCT page) AS pages FROM b GROUP BY file_id), t AS (SELECT file_id, {STRIP % "text"} AS line, count(DISTINCT page) AS seen FROM b GROUP BY ALL)
 SELECT file_id, line FROM t JOIN n USING (file_id) WHERE line <> '' AND seen >= 0.3 * pages""")
def q_repeating_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts on at least 30 % of a file's pages: headers and footers, and everything in files of few pages."""
    b = table(spark, d, "document_blocks").filter("block_uid is not null and page is not null").groupBy("block_uid").agg(*[F.min(c).alias(c) for c in ("file_id", "page", "text")])
    spans = b.select(F.col("file_id").alias("doc_id"), "page", F.col("block_uid").alias("line_no"), F.lit(0).alias("span_no"), "text", F.lit(0.0).alias("line_y1"))
    return pagespans.repeating_lines(spans).select(F.col("doc_id").alias("file_id"), F.col("text").alias("line"))


@query("""SELECT question_uid, n_options, n_empty, n_distinct FROM (SELECT question_uid, max(cardinality(options)) AS n_options, max(len(list_filter(map_values(options), lambda v: v IS NULL OR regexp_matches(v, '^\\s*$')))) AS n_empty,
 max(len(list_distinct(list_transform(list_filter(map_values(options), lambda v: v IS NOT NULL AND NOT regexp_matches(v, '^\\s*$')), lambda v: trim(v))))) AS n_distinct FROM questions WHERE question_uid IS NOT NULL AND options IS NOT NULL GROUP BY question_uid)
 WHERE n_options NOT IN (4, 5) OR n_empty > 0 OR n_distinct < n_options""")
def q_bank_option_checks(spark: SparkSession, d: str) -> DataFrame:
    """Records of the bank whose options are too few, empty or the same."""
    values = F.map_values("options")
    blank = lambda v: v.isNull() | v.rlike(r"^\s*$")
    q = table(spark, d, "questions").filter("question_uid is not null and options is not null").select("question_uid", F.size("options").alias("n_options"), F.size(F.filter(values, blank)).alias("n_empty"), F.size(F.array_distinct(F.transform(F.filter(values, lambda v: ~blank(v)), F.trim))).alias("n_distinct"))
    q = q.groupBy("question_uid").agg(*[F.max(c).alias(c) for c in ("n_options", "n_empty", "n_distinct")])
    return q.filter(~F.col("n_options").isin(4, 5) | (F.col("n_empty") > 0) | (F.col("n_distinct") < F.col("n_options")))


@query("SELECT status, reason, count(*) AS n, count(question_uid) AS owned FROM source_ledger GROUP BY status, reason")
def q_ledger_status(spark: SparkSession, d: str) -> DataFrame:
    """The stored ledger by fate."""
    return table(spark, d, "source_ledger").groupBy("status", "reason").agg(F.count("*").alias("n"), F.count("question_uid").alias("owned"))


@query("""SELECT DISTINCT b.file_id, b.block_id FROM document_blocks b WHERE b.file_id IS NOT NULL AND b.block_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_ledger l WHERE l.file_id = b.file_id AND l.source_block_id = b.block_id AND l.status = 'consumed')""")
def q_orphan_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that no question consumed."""
    b = table(spark, d, "document_blocks").filter("file_id is not null and block_id is not null").select("file_id", "block_id").distinct()
    used = table(spark, d, "source_ledger").filter("status = 'consumed'").select("file_id", F.col("source_block_id").alias("block_id"))
    return b.join(used, ["file_id", "block_id"], "left_anti")


@query("""WITH r AS (SELECT DISTINCT question_uid, file_id, unnest(source_blocks) AS s FROM questions) SELECT s.role AS role, count(*) AS n, count(DISTINCT r.question_uid) AS questions, count(l.source_block_id) AS in_ledger FROM r LEFT JOIN
 (SELECT DISTINCT file_id, source_block_id FROM source_ledger) l ON l.file_id = r.file_id AND l.source_block_id = s.block_id GROUP BY s.role""")
def q_block_roles(spark: SparkSession, d: str) -> DataFrame:
    """References of the bank to source blocks by role, and how many of them the ledger knows."""
    refs = table(spark, d, "questions").select("question_uid", "file_id", F.explode("source_blocks").alias("s")).distinct()
    known = table(spark, d, "source_ledger").select("file_id", F.col("source_block_id").alias("block_id"), F.lit(1).alias("known")).distinct()
    got = refs.select("question_uid", "file_id", "s.block_id", "s.role").join(known, ["file_id", "block_id"], "left")
    return got.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("question_uid").alias("questions"), F.count("known").alias("in_ledger"))


_STORED = """WITH s AS (SELECT question_uid, min(file_id) AS file_id, min(q_seq) AS q_seq, min(section) AS section, min(source_question_number) AS number, min(question) AS question, min(question_type) AS question_type,
 any_value(options) AS options, any_value(images) AS images, any_value(parsed_ok) AS parsed_ok, any_value(needs_review) AS needs_review FROM questions WHERE question_uid IS NOT NULL GROUP BY question_uid)"""


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The bank's records, each once."""
    q = table(spark, d, "questions").filter("question_uid is not null").groupBy("question_uid")
    least = ("file_id", "q_seq", "section", "source_question_number", "question", "question_type")
    return q.agg(*[F.min(c).alias(c) for c in least], *[F.any_value(c).alias(c) for c in ("options", "images", "parsed_ok", "needs_review")]).withColumnRenamed("source_question_number", "number")


@query(_STORED + """, o AS (SELECT *, lag(sec) OVER (PARTITION BY file_id ORDER BY q_seq, question_uid) AS before, row_number() OVER (PARTITION BY file_id ORDER BY q_seq, question_uid) AS nth FROM (SELECT *, coalesce(nullif(section, ''), 'General') AS sec FROM s)),
 l AS (SELECT file_id, q_seq, question_uid, list_concat(CASE WHEN sec IS DISTINCT FROM before THEN [{'kind': 'heading', 'text': 'Section: ' || sec}] ELSE [] END,
  [{'kind': 'header', 'text': 'Question ' || coalesce(nullif(number, ''), '?') || ' [' || upper(coalesce(question_type, 'mcq')) || ']'}, {'kind': 'question', 'text': coalesce(question, '')}], list_transform(coalesce(images, []), lambda x: {'kind': 'image', 'text': x.path}),
  list_transform(list_filter(['A', 'B', 'C', 'D'], lambda c: coalesce(options[c], '') <> ''), lambda c: {'kind': 'option', 'text': '(' || c || ') ' || options[c]}),
  list_transform(list_filter(coalesce(map_entries(options), []), lambda e: e.key NOT IN ('A', 'B', 'C', 'D') AND coalesce(e.value, '') <> ''), lambda e: {'kind': 'option', 'text': '(' || e.key || ') ' || e.value})) AS xs FROM o)
 SELECT file_id, q_seq, question_uid, CAST(i - 1 AS INTEGER) AS line, xs[i].kind AS kind, xs[i].text AS text FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM l)""")
def q_print_plan(spark: SparkSession, d: str) -> DataFrame:
    """What is printed of the bank, line by line: headings where the section changes, headers, questions, pictures, options."""
    q = stored(spark, d).withColumn("images", F.transform("images", lambda x: x["path"]))
    return layout.print_plan(q, ["file_id"], ["q_seq", "question_uid"])


@query(_STORED + """, k AS (SELECT *, coalesce(question_type = 'divider', false) AS divider, coalesce(question_type IN ('match_the_column', 'match_list', 'match'), false) AS matching, coalesce(NOT parsed_ok, false) OR coalesce(needs_review, false) AS flag,
  coalesce(question_type IN ('open', 'subjective', 'numerical', 'short_answer', 'long_answer', 'fill_in_the_blanks'), false) OR coalesce(cardinality(options), 0) = 0 AS opened FROM s),
 c AS (SELECT file_id, count(*) AS questions, count(*) FILTER (WHERE divider) AS dividers, count(*) FILTER (WHERE matching AND NOT divider) AS to_match, count(*) FILTER (WHERE opened AND NOT divider AND NOT matching) AS open, count(*) FILTER (WHERE flag) AS flagged FROM k GROUP BY file_id)
 SELECT *, questions - dividers - to_match - open AS multiple_choice, questions || CASE WHEN flagged > 0 THEN ' Questions (' || flagged || ' Flagged for Review) · Exam Prep' ELSE ' Questions · Boards / Competitive Exam' END AS subtitle FROM c""")
def q_deck_counts(spark: SparkSession, d: str) -> DataFrame:
    """Questions of each file's deck by kind, with its subtitle."""
    return layout.deck_counts(stored(spark, d), ["file_id"])


_HIGH = "list_transform(['A', 'B', 'C', 'D'], lambda c: CASE WHEN coalesce(options[c], '') = '' THEN 0.35 ELSE greatest(0.35, list_sum(list_transform(string_split(options[c], chr(10)), lambda x: greatest(1, ceil(len(" + STRIP % "x" + ") / %s)))) * 0.296) END)"


@query(_STORED + f""", v AS (SELECT question_uid, options, list_transform(['A', 'B', 'C', 'D'], lambda c: {STRIP % "coalesce(options[c], '')"}) AS t, {_HIGH % "35.0"} AS h4, {_HIGH % "41.0"} AS h2 FROM s WHERE options IS NOT NULL),
 f AS (SELECT *, list_bool_and(list_transform(t, lambda x: len(x) BETWEEN 1 AND 32 AND len(x) - len(replace(x, chr(10), '')) <= 1)) AS fits, unnest(range(0, 4)) AS k FROM v)
 SELECT question_uid, chr(CAST(65 + k AS INTEGER)) AS letter, CAST(CASE WHEN fits THEN 0 ELSE k // 2 END AS INTEGER) AS row, CAST(CASE WHEN fits THEN k ELSE k % 2 END AS INTEGER) AS column, CAST(round(CASE WHEN fits THEN 0.5 + k * 3.1325 ELSE 0.5 + (k % 2) * 6.34 END, 4) AS DOUBLE) AS x,
 CAST(CASE WHEN fits THEN 2.9325 ELSE 5.99 END AS DOUBLE) AS width, CAST(round(greatest(0.5, CASE WHEN fits THEN list_max(h4) WHEN k < 2 THEN greatest(h2[1], h2[2]) ELSE greatest(h2[3], h2[4]) END), 4) AS DOUBLE) AS height FROM f WHERE list_contains(map_keys(options), chr(CAST(65 + k AS INTEGER)))""")
def q_option_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Where the options of each question stand on its slide."""
    return stored(spark, d).select("question_uid", F.inline(layout.option_boxes(F.col("options"))))


@query()
def q_component_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Components of the exam files' questions with the inline nodes that are theirs."""
    q = build(blocks_of(table(spark, d, "document_blocks"))).questions
    return align.aligned(layout.components(q), q).withColumn("nodes", F.to_json("nodes"))


@query()
def q_table_heights(spark: SparkSession, d: str) -> DataFrame:
    """Heights of the rows of the exam files' tables on a slide."""
    q = build(blocks_of(table(spark, d, "document_blocks"))).questions.select("doc_id", "q_seq", F.posexplode("tables").alias("n", "t"))
    maths = F.transform("t.cell_content", lambda r: F.array_max(F.transform(F.flatten(F.transform(r, lambda c: c["inline_content"])), lambda x: F.when(~x.contains("math_sequence"), 0).when(x.contains("\\\\frac"), 2).otherwise(1))))
    return q.select("doc_id", "q_seq", "n", F.posexplode(layout.table_heights(F.col("t.rows"), maths)).alias("row", "height"))
