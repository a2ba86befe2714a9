"""Candidates to question records: components, features, type, validation. Everything but the grouping is a JVM expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import spans as S
from inkwell.functions.mathtext import check_math, convert_math
from inkwell.functions.predicates import LABEL_AD
from inkwell.functions.text import first, has, let, strip
from inkwell.session import settled, shuffle_parts

EMPTY_MAP = "map<string,string>"
_ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii")


def option_split(text: Column) -> Column:
    """struct(stem, options): the last A label that B, C and D follow begins the options; without all four there are none.

    The text is cut at every label, and the places of the four are found in a short string of their letters: the last D, the
    last C before it and so on back to A, then the first B, C and D behind that A. So long texts cost linear time.
    """
    none = F.struct(text.alias("stem"), F.create_map().cast(EMPTY_MAP).alias("options"))

    def chosen(pieces: Column, letters: Column) -> Column:
        back = F.reverse(letters)
        at, there = F.lit(0), F.lit(True)
        for c in "DCBA":
            at = F.position(F.lit(c), back, at + 1)
            there = there & (at > 0)
        begin = F.length(letters) - at + 1
        spots = [begin]
        for c in "BCD":
            spots.append(F.position(F.lit(c), letters, spots[-1] + 1))
        return F.when(there, let(F.array(*spots, F.size(pieces) + 1), lambda s: parted(pieces, s))).otherwise(none)

    def parted(pieces: Column, spots: Column) -> Column:
        def value(k: int) -> Column:
            a, b = F.get(spots, F.lit(k)), F.get(spots, F.lit(k + 1))
            return strip(F.regexp_replace(F.array_join(F.slice(pieces, a, b - a), ""), f"^{LABEL_AD}", ""))

        stem = strip(F.array_join(F.slice(pieces, F.lit(1), F.get(spots, F.lit(0)) - 1), ""))
        return F.struct(stem.alias("stem"), F.create_map(*[x for k, c in enumerate("ABCD") for x in (F.lit(c), value(k))]).alias("options"))

    def lettered(pieces: Column) -> Column:
        letters = F.array_join(F.transform(pieces, lambda p: F.when(has(p, f"^{LABEL_AD}"), F.upper(first(p, "[A-Da-d]"))).otherwise("-")), "")
        return let(letters, lambda ls: chosen(pieces, ls))

    return F.when(text.isNotNull(), let(F.split(text, f"(?={LABEL_AD})", -1), lettered))


def _listed(body: Column, marks: list[tuple[str, str]], flags: str) -> Column:
    """array<struct(label, text)> of items whose marks follow each other, up to the first that is missing."""
    items = []
    there = F.lit(True)
    for i, (name, mark) in enumerate(marks):
        there = there & has(body, rf"{flags}(?:^|\n){mark}")
        stop = rf"\n{marks[i + 1][1]}|" if i + 1 < len(marks) else ""
        text = strip(first(body, rf"{flags}(?s)(?:^|\n){mark}(.*?)(?:{stop}\z)", 1))
        items.append(F.when(there, F.struct(F.lit(name).alias("label"), text.alias("text"))))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _cut_at(stem: Column, pattern: str) -> tuple[Column, Column]:
    """(what stands before the first match, the rest from it on)."""
    at = F.regexp_instr(stem, F.lit(pattern))
    return strip(F.substring(stem, F.lit(1), at - 1)), F.substring(stem, at, F.length(stem))


def statements(stem: Column) -> Column:
    """struct(stem, statements): lines A. to E., or else Statement I and II, taken out of the stem. A lone Statement I leaves the stem and is stored nowhere."""
    none = F.array().cast("array<struct<label:string,text:string>>")
    lettered = first(stem, r"(?:^|\n)([A-E])\.\s+", 1) == "A"
    before, body = _cut_at(stem, r"(?:^|\n)[A-E]\.\s+")
    numbered = r"(?i)(?:^|\n)Statement\s*(?:I|1)\s*[:.]\s+"
    before2, body2 = _cut_at(stem, numbered)
    pair = r"(?is)(?:^|\n)Statement\s*(I|1)\s*[:.]\s+(.*?)\nStatement\s*(II|2)\s*[:.]\s+(.*)$"
    two = F.array(*[F.struct(first(body2, pair, i).alias("label"), strip(first(body2, pair, i + 1)).alias("text")) for i in (1, 3)])
    case = F.when(lettered, F.struct(before.alias("stem"), _listed(body, [(c, rf"{c}\.\s+") for c in "ABCDE"], "").alias("statements")))
    case = case.when(has(stem, numbered), F.struct(before2.alias("stem"), F.when(has(body2, pair), two).otherwise(none).alias("statements")))
    return case.otherwise(F.struct(stem.alias("stem"), none.alias("statements")))


def subparts(stem: Column) -> Column:
    """struct(stem, subparts): lines (i) to (viii), or else (a) to (h), taken out of the stem."""
    none = F.array().cast("array<struct<label:string,text:string>>")
    mark = lambda x: rf"\(\s*{x}\s*\)\s+"
    before, body = _cut_at(stem, rf"(?i)(?:^|\n){mark('i')}")
    before2, body2 = _cut_at(stem, rf"(?i)(?:^|\n){mark('a')}")
    case = F.when(has(stem, rf"(?i)(?:^|\n){mark('i')}"), F.struct(before.alias("stem"), _listed(body, [(r, mark(r)) for r in _ROMANS], "(?i)").alias("subparts")))
    case = case.when(has(stem, rf"(?i)(?:^|\n){mark('a')}"), F.struct(before2.alias("stem"), _listed(body2, [(c, mark(c)) for c in "abcdefgh"], "(?i)").alias("subparts")))
    return case.otherwise(F.struct(stem.alias("stem"), none.alias("subparts")))


def records(parts: DataFrame, numbers: DataFrame) -> DataFrame:
    """One record per (doc_id, q_seq), before validation. parts come from segmented(), numbers from numbering()."""
    paragraph = F.col("block_type").eqNullSafe("paragraph")
    clean = F.when(paragraph, S.without_images(F.col("text")))
    owner = F.col("block_id").cast("string")
    item = F.struct(
        "ord", F.col("block_id"), "part", "part_id", "block_type", "section", "appearances", clean.alias("clean"), owner.alias("owner"),
        S.role(F.coalesce("block_type", F.lit("")), F.col("text")).alias("role"), F.when(paragraph, S.images(F.col("text"))).alias("images"), F.when(paragraph, S.equations(S.without_images(F.col("text")))).alias("raw_equations"),
    )
    n = shuffle_parts(parts.sparkSession)
    got = parts.repartition(n, "doc_id", "q_seq").groupBy("doc_id", "q_seq").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    number = numbers.select("doc_id", "q_seq", F.col("label").alias("source_question_number"), F.col("raw").alias("raw_question_number"), "scheme", "value", "event", "previous", "duplicate")
    got = got.join(number, ["doc_id", "q_seq"], "left")
    xs = F.col("xs")
    each = lambda f: F.flatten(F.transform(F.filter(xs, lambda x: x[f].isNotNull()), lambda x: x[f]))
    got = got.withColumn("combined", strip(F.array_join(F.transform(F.filter(xs, lambda x: x["clean"].isNotNull()), lambda x: x["clean"]), "\n")))
    got = got.withColumn("combined", S.without_number(F.col("combined"), F.col("scheme").eqNullSafe("roman")))
    got = settled(settled(got).withColumn("split1", option_split(F.col("combined"))))
    got = settled(settled(got.withColumn("split2", statements(F.col("split1.stem")))).withColumn("split3", subparts(F.col("split2.stem"))))
    refs = F.transform(xs, lambda x: F.struct(x["part_id"].alias("block_id"), x["role"].alias("role")))
    got = got.select(
        "doc_id", "q_seq", F.get(xs, F.lit(0))["section"].alias("section"), "source_question_number", "raw_question_number", "scheme", "value", "event", "previous", "duplicate",
        F.col("split3.stem").alias("question"), F.col("split2.statements").alias("statements"), F.col("split3.subparts").alias("subparts"), F.col("split1.options").alias("options"),
        F.array_distinct(each("appearances")).alias("appearances"), each("images").alias("images"), each("raw_equations").alias("raw_equations"),
        F.transform(xs, lambda x: x["part_id"]).alias("block_ids"), F.array_distinct(F.transform(xs, lambda x: x["owner"])).alias("owners"), refs.alias("source_blocks"),
        F.exists(xs, lambda x: x["block_type"] == "table").alias("has_table"), F.get(F.filter(xs, lambda x: x["block_type"] == "table"), F.lit(0))["owner"].alias("table_block_id"),
    )
    got = settled(got.withColumn("equations", convert_math(F.col("raw_equations"))).drop("raw_equations"))
    return settled(scored(classified(settled(with_features(got)))))


def with_features(q: DataFrame) -> DataFrame:
    """q with features: eleven tests and the number of options."""
    full = F.concat(F.col("question"), F.lit("\n"), F.array_join(F.transform("statements", lambda s: s["text"]), "\n"), F.array_join(F.map_values("options"), "\n"))
    test = {
        "has_options": F.size("options") > 0,
        "has_table": F.col("has_table"),
        "has_image": F.size("images") > 0,
        "has_assertion": has(full, r"(?i)\bAssertion\s*(?:A|:)\s*"),
        "has_reason": has(full, r"(?i)\bReason\s*(?:R|:)\s*"),
        "has_blank": has(full, r"_{3,}|\{\{BLANK\}\}") | F.lower("section").contains("fill in the blank"),
        "has_equation": F.size("equations") > 0,
        "has_statement_list": (F.size("statements") > 0) | has(full, r"(?i)\bStatement\s*(?:I|1)\s*[:.]"),
        "has_numeric_instruction": F.lit(False),
        "has_match_list": full.contains("List-I") & full.contains("List-II") | full.contains("Column I"),
        "has_multiple_correct_instruction": has(full, r"(?i)\b(?:Which|Select)\s*(?:of the following|statements)\s*(?:are correct|are true)\b|one or more options may be correct"),
    }
    return q.withColumn("features", F.struct(F.size("options").alias("option_count"), *[c.alias(n) for n, c in test.items()])).drop("has_table")


def classified(q: DataFrame) -> DataFrame:
    """q with question_type, by the first rule that holds."""
    f, section, text = F.col("features"), F.lower("section"), F.col("question")
    case = F.when(f["has_assertion"] & f["has_reason"], "assertion_reason").when(f["has_match_list"], "match_list").when(f["has_statement_list"], "statement_based")
    case = case.when(f["has_multiple_correct_instruction"], "multiple_correct").when(f["has_blank"], "fill_in_the_blank").when(f["has_options"], "mcq")
    case = case.when(section.contains("numerical") | has(text, r"(?i)\b(?:Calculate|Find|Evaluate|Determine)\b"), "numerical").when(section.contains("integer") | F.lower(text).contains("integer"), "integer_answer")
    case = case.when(has(text, r"(?i)\b(?:Explain|Describe|Discuss|Derive|Prove)\b"), "subjective").when(has(text, r"(?i)\b(?:Write|Mention|State|Name)\b"), "short_answer")
    return q.withColumn("question_type", case.when(f["has_table"], "table_based").when(f["has_image"], "image_based").otherwise("open_question"))


def scored(q: DataFrame) -> DataFrame:
    """q with the five confidences."""
    numbered, full = F.col("source_question_number").isNotNull(), F.size("options") == 4
    overall = F.round(F.lit(0.9) - F.when(numbered, 0.0).otherwise(0.15) - F.when(F.col("question") != "", 0.0).otherwise(0.3), 2)
    rich = full | (F.size("statements") > 0) | (F.size("subparts") > 0)
    pick = lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(F.lit(no))
    parts = [overall.alias("overall"), pick(numbered, 0.95, 0.75).alias("boundary"), pick(rich, 0.95, 0.85).alias("components"), F.lit(0.9).alias("classification"), pick(F.size("appearances") > 0, 1.0, 0.85).alias("metadata")]
    return q.withColumn("confidence", F.struct(*parts))


def validated(q: DataFrame) -> DataFrame:
    """q with parsed_ok, needs_review, validation_errors, issues, review_reasons, has_equation and quality_score.

    Starts from the record alone, so validating again (after a recovery or a correction) changes nothing that still holds.
    """
    stem, options, n = strip(F.coalesce("question", F.lit(""))), F.col("options"), F.size("options")
    blocks, numbered = F.size("block_ids"), F.col("source_question_number").isNotNull()
    values = F.filter(F.transform(F.map_values(options), lambda v: strip(F.coalesce(v, F.lit("")))), lambda v: v != "")
    empty = F.map_keys(F.map_filter(options, lambda _, v: strip(F.coalesce(v, F.lit(""))) == ""))
    counted = (F.col("question_type") == "mcq") | (n > 0)
    shown = F.concat(F.lit("EMPTY_OPTIONS: ["), F.array_join(F.transform(empty, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))
    errors = F.array(
        F.when((stem == "") & ~F.col("features.has_table") & (F.size("images") == 0), F.lit("EMPTY_STEM_NO_CONTENT")),
        F.when(counted & ~n.isin(4, 5), F.concat(F.lit("INVALID_OPTION_COUNT: got "), n.cast("string"), F.lit(", expected 4"))),
        F.when(counted & (F.size(empty) > 0), shown),
    )
    maths = F.flatten(F.transform("equations", lambda e: F.transform(check_math(e), lambda p: F.concat(F.lit("MATH_ISSUE: "), p))))
    errors = F.array_distinct(F.concat(F.filter(errors, lambda e: e.isNotNull()), maths))
    marks = F.regexp_count(stem, F.lit(r"(?i)(?:^|\n)(?:Q(?:uestion)?\s*(?:No\.?)?\s*|Q\.\s*)?0*\d+(?:[.):]|\s*-)(?:\s+|$)"))
    orders = F.regexp_count(stem, F.lit(r"(?i)\b(?:Evaluate|Find|Calculate|Prove|Determine|Explain|Define|Mention|Write|State|Describe|Deduce|Derive)\b"))
    merged = ((marks >= 1) & ~numbered) | ((orders >= 3) & (blocks > 5))
    warnings = F.array(
        F.when(counted & (F.size(values) != F.size(F.array_distinct(values))), F.lit("DUPLICATE_OPTION_VALUES")),
        F.when(blocks >= 20, F.lit("SUSPICIOUS_LARGE_CANDIDATE")).when(merged, F.lit("SUSPICIOUS_MERGE")),
        F.when((F.col("q_seq") > 1) & ~numbered & (n == 0) & has(stem, r"^\p{Ll}"), F.lit("SUSPICIOUS_SPLIT")),
    )
    warnings = F.filter(warnings, lambda w: w.isNotNull())
    math_text = F.concat_ws("\n", F.array(stem), F.map_values(options))
    out = settled(q.withColumn("validation_errors", errors).withColumn("__warn", warnings))
    out = out.withColumn("issues", F.array_distinct(F.concat("validation_errors", "__warn"))).withColumn("parsed_ok", F.size("validation_errors") == 0)
    out = settled(out)
    out = out.withColumn("needs_review", (F.size("issues") > 0) | F.coalesce(F.col("question"), F.lit("")).contains("00 g"))
    reasons = F.when(~F.col("needs_review"), F.array().cast("array<string>")).when(F.size("issues") > 0, F.col("issues")).otherwise(F.array(F.lit("REVIEW_REQUIRED")))
    score = F.lit(0.65) + F.when(stem != "", 0.2).otherwise(0.0) + F.when(n.isin(4, 5), 0.15).otherwise(0.0) - F.when(F.size("validation_errors") > 0, 0.25).otherwise(0.0) - F.when(F.col("needs_review"), 0.1).otherwise(0.0)
    out = out.withColumn("review_reasons", reasons).withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2))
    return settled(out.withColumn("has_equation", (F.size("equations") > 0) | has(math_text, r"\$[^$]+\$|\\(?:frac|sqrt|int|sum|prod|pi|alpha|beta)\b|[=∫∑√∞]")).drop("__warn"))
