"""Layout as data: heights, badges, pages, reconciliation of formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.spans import citation
from inkwell.functions.text import strip

OPTION_WIDTH, TOP, BOTTOM = 2.6, 1.25, 7.1
# Inches of a slide, its margin and gaps.
WIDTH, MARGIN, GAP_OF_FOUR, GAP_OF_TWO, GAP_OF_ROWS = 13.33, 0.5, 0.20, 0.35, 0.05
COLUMN_HEAD, COLUMN_AREA, OPTION_LEAST = 0.28, 1.5, 0.40
OPEN_TYPES = ("open", "subjective", "numerical", "short_answer", "long_answer", "fill_in_the_blanks")
MATCH_TYPES = ("match_the_column", "match_list", "match")


def content_height(text: Column, width: float, size: float) -> Column:
    """Inches that a text needs: lines wrapped at the width, at least one."""
    per_line = max(35, int(width / (size * 0.0085)))
    lines = F.aggregate(F.split(text, "\n", -1), F.lit(0).cast("bigint"), lambda n, line: n + F.greatest(F.lit(1).cast("bigint"), F.ceil(F.length(strip(line)) / per_line)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.35)).otherwise(F.greatest(F.lit(0.35), lines * (size * 0.0185)))


def badge_width(text: Column, size: float = 15.0) -> Column:
    thin, narrow, wide = (F.length(F.regexp_replace(text, p, "")) for p in ("[^, \\-/]", "[^1I]", "[^MW]"))
    rest = F.length(text) - thin - narrow - wide
    return F.round(size * (thin * 0.0045 + narrow * 0.0050 + wide * 0.0095 + rest * 0.0078) + 0.36, 2)


def badge(question: Column, options: Column, appearances: Column, parsed_ok: Column, needs_review: Column) -> Column:
    """The badge of a question: its appearances, else the year tag of its stem, else that of option D; marked where it needs review. Null if there is nothing to say."""
    seen = F.filter(F.transform(appearances, lambda a: F.regexp_replace(a, r"^[()\[\] \t]+|[()\[\] \t]+$", "")), lambda a: a != "")
    said = F.when(F.size(seen) > 0, F.array_join(seen, ", ")).otherwise(F.coalesce(citation(question)["citation"], citation(options["D"])["citation"]))
    marked = F.when(said.isNull(), F.lit("NEEDS REVIEW")).otherwise(F.concat(said, F.lit(" · NEEDS REVIEW")))
    return F.when(F.coalesce(needs_review, F.lit(False)) | ~F.coalesce(parsed_ok, F.lit(True)), marked).otherwise(said)


def outermost_formulas(nodes: DataFrame) -> DataFrame:
    """Nodes of kind math_sequence that lie in no other one, by their intervals: nodes are those of nested.flatten_nodes."""
    math = nodes.filter(F.col("label") == "math_sequence")
    before = Window.partitionBy("block_uid").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return math.withColumn("reach", F.max("post").over(before)).filter(F.col("reach").isNull() | (F.col("reach") < F.col("post"))).drop("reach")


def fits_one_row(options: Column, width: float = OPTION_WIDTH) -> Column:
    """All four options are there, short, and one or two lines high."""
    value = lambda c: strip(F.coalesce(options[c], F.lit("")))
    tests = [(value(c) != "") & (F.length(value(c)) <= 32) & (content_height(value(c), width, 16) <= 0.75) for c in "ABCD"]
    return F.coalesce(tests[0] & tests[1] & tests[2] & tests[3], F.lit(False))


def components(q: DataFrame) -> DataFrame:
    """(doc_id, q_seq, comp_seq, component_id, text, height): question, statements, subparts and options in the order of print."""
    part = lambda name, text: F.struct(name.alias("component_id"), text.alias("text"))
    listed = lambda xs, kind, sep: F.transform(xs, lambda x, i: part(F.concat(F.lit(kind + ":"), (i + 1).cast("string")), F.concat(x["label"], F.lit(sep), x["text"])))
    options = F.transform(F.map_entries("options"), lambda e: part(F.concat(F.lit("option:"), e["key"]), F.concat(F.lit("("), e["key"], F.lit(") "), e["value"])))
    every = F.concat(F.array(part(F.lit("question"), F.coalesce("question", F.lit("")))), listed(F.col("statements"), "statement", ". "), listed(F.col("subparts"), "subpart", " "), options)
    rows = q.select("doc_id", "q_seq", F.posexplode(every).alias("comp_seq", "c")).select("doc_id", "q_seq", "comp_seq", "c.component_id", "c.text")
    return rows.withColumn("height", content_height(F.col("text"), 12.0, 18) + 0.05)


def paginated(parts: DataFrame, top: float = TOP, bottom: float = BOTTOM) -> DataFrame:
    """parts with slide (from 1 per question) and y: a component goes to a new slide if it would pass the bottom and isn't near the top already."""
    xs = F.array_sort(F.collect_list(F.struct("comp_seq", "component_id", "text", "height")))
    got = parts.groupBy("doc_id", "q_seq").agg(xs.alias("xs"))
    empty = F.array().cast("array<struct<slide:int,y:double>>")
    start = F.struct(F.lit(1).alias("slide"), F.lit(top).alias("y"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        turn = (s["y"] + x["height"] > bottom) & (s["y"] > top + 0.3)
        slide, y = F.when(turn, s["slide"] + 1).otherwise(s["slide"]), F.when(turn, F.lit(top)).otherwise(s["y"])
        return F.struct(slide.alias("slide"), (y + x["height"]).alias("y"), F.concat(s["out"], F.array(F.struct(slide.alias("slide"), y.alias("y")))).alias("out"))

    placed = got.withColumn("at", F.aggregate("xs", start, step, lambda s: s["out"]))
    return placed.select("doc_id", "q_seq", F.inline(F.arrays_zip("xs", "at"))).select("doc_id", "q_seq", "xs.comp_seq", "xs.component_id", "xs.text", "xs.height", "at.slide", F.round("at.y", 4).alias("y"))


def slide_map(pages: DataFrame) -> DataFrame:
    """(doc_id, q_seq, first_slide, slides): slides of the whole deck, after the title slide."""
    per = pages.groupBy("doc_id", "q_seq").agg(F.max("slide").alias("slides"))
    before = F.sum("slides").over(Window.partitionBy("doc_id").orderBy("q_seq").rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("first_slide", F.coalesce(before, F.lit(0)) + 2)


def math_id(question: Column, block: Column, index: Column) -> Column:
    """A formula's name in the deck: question, block and place."""
    q = F.when(question.rlike(r"^\d+$"), F.concat(F.lit("Q"), F.lpad(question, 2, "0"))).otherwise(F.upper(question))
    b = F.upper(F.regexp_replace(F.regexp_replace(block, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.concat(q, F.lit("-BLOCK-"), b, F.lit("-MATH-"), F.lpad((index + 1).cast("string"), 3, "0"))


def reconciled(canonical: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(math_id, status): the last outcome (by seq) of each formula; formulas without any have failed."""
    last = outcomes.groupBy("math_id").agg(F.max_by("status", "seq").alias("status"))
    missing = canonical.select("math_id").distinct().join(last, "math_id", "left_anti").withColumn("status", F.lit("failed"))
    return last.unionByName(missing)


def option_boxes(options: Column) -> Column:
    """array<struct(letter, row, column, x, width, height)>: the options A to D that are there, four in a row where they fit, else two by two; a row is as high as its highest option."""
    four = (WIDTH - 2 * MARGIN - 3 * GAP_OF_FOUR) / 4
    two = (WIDTH - 2 * MARGIN - GAP_OF_TWO) / 2
    body = lambda c: F.coalesce(options[c], F.lit(""))
    high = lambda letters, width: F.greatest(F.lit(0.5), *[content_height(body(c), width, 16) for c in letters])

    def box(c: str, row: int, column: int, x: float, width: float, height: Column) -> Column:
        parts = {"letter": F.lit(c), "row": F.lit(row), "column": F.lit(column), "x": F.lit(round(x, 4)), "width": F.lit(round(width, 4)), "height": F.round(height, 4)}
        return F.when(F.map_contains_key(options, F.lit(c)), F.struct(*[v.alias(k) for k, v in parts.items()]))

    one_row = F.array(*[box(c, 0, k, MARGIN + k * (four + GAP_OF_FOUR), four, high("ABCD", four - 0.35)) for k, c in enumerate("ABCD")])
    grid = F.array(*[box(c, k // 2, k % 2, MARGIN + (k % 2) * (two + GAP_OF_TWO), two, high("AB" if k < 2 else "CD", two - 0.40)) for k, c in enumerate("ABCD")])
    return F.filter(F.when(fits_one_row(options), one_row).otherwise(grid), lambda b: b.isNotNull())


def table_heights(rows: Column, maths: Column | None = None) -> Column:
    """array<double>: the height of each row of a table (array<array<string>>), from 0.35 to 1.1 inches; rows with formulas (maths: 0 none, 1 some, 2 with fractions) are at least 0.48 or 0.62."""
    wide = F.greatest(F.lit(1), F.array_max(F.transform(rows, F.size)))
    per_line = F.greatest(F.lit(35), F.floor(((WIDTH - 2 * MARGIN) / wide - 0.12) / (13 * 0.0085)).cast("int"))

    def cell(text: Column) -> Column:
        lines = F.aggregate(F.split(text, "\n", -1), F.lit(0).cast("bigint"), lambda n, line: n + F.greatest(F.lit(1).cast("bigint"), F.ceil(F.length(strip(line)) / per_line)))
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.35)).otherwise(F.greatest(F.lit(0.35), lines * (13 * 0.0185))) + 0.08

    def row(cells: Column, k: Column) -> Column:
        high = F.greatest(F.lit(0.35), F.coalesce(F.array_max(F.transform(cells, cell)), F.lit(0.0)))
        if maths is not None:
            held = F.coalesce(F.get(maths, k), F.lit(0))
            high = F.greatest(high, F.when(held == 2, F.lit(0.62)).when(held == 1, F.lit(0.48)).otherwise(F.lit(0.0)))
        return F.round(F.least(high, F.lit(1.1)), 4)

    return F.transform(rows, row)


def match_boxes(columns: Column) -> Column:
    """array<struct(side, row, text, x, y, height)>: the items of a match-the-column question (spans.match_columns) under their headings; y counts from below the introduction."""
    wide = (WIDTH - 2 * MARGIN - 0.2) / 2
    most = F.greatest(F.size(columns["left"]), F.size(columns["right"]), F.lit(1))
    high = F.greatest(F.lit(0.32), F.lit(COLUMN_AREA) / most)
    side = lambda name, x: F.transform(columns[name], lambda t, i: F.struct(F.lit(name).alias("side"), i.alias("row"), t.alias("text"), F.lit(round(x, 4)).alias("x"), F.round(COLUMN_HEAD + 0.05 + i * high, 4).alias("y"), F.round(high, 4).alias("height")))
    return F.concat(side("left", MARGIN), side("right", MARGIN + wide + 0.2))


def picture_size(width: Column, height: Column) -> Column:
    """struct(width, height) in inches of a picture of so many pixels: a hundred to the inch, at most 80 % of the slide and 4.5 inches high. Null for empty pictures."""
    shape = height / width
    w = F.least(F.lit((WIDTH - 2 * MARGIN) * 0.8), width / 100)
    tall = w * shape > 4.5
    size = F.struct(F.round(F.when(tall, 4.5 / shape).otherwise(w), 4).alias("width"), F.round(F.when(tall, F.lit(4.5)).otherwise(w * shape), 4).alias("height"))
    return F.when((width > 0) & (height > 0), size)


def deck_counts(q: DataFrame, of: list[str]) -> DataFrame:
    """How many questions of each deck (the columns of) are multiple choice, open, to be matched and dividers, how many need review, and the deck's subtitle. q: question_type, options, table or has_table, parsed_ok, needs_review."""
    kind, has_table = F.coalesce("question_type", F.lit("mcq")), F.col("has_table") if "has_table" in q.columns else F.lit(False)
    divider, match = kind == "divider", kind.isin(*MATCH_TYPES) & ~has_table
    is_open = ~divider & ~match & (kind.isin(*OPEN_TYPES) | (F.coalesce(F.size("options"), F.lit(0)) <= 0))
    flagged = F.coalesce(F.col("needs_review"), F.lit(False)) | ~F.coalesce(F.col("parsed_ok"), F.lit(True))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    got = q.groupBy(*of).agg(F.count("*").alias("questions"), count(divider, "dividers"), count(match, "to_match"), count(is_open, "open"), count(flagged, "flagged"))
    got = got.withColumn("multiple_choice", F.col("questions") - F.col("dividers") - F.col("to_match") - F.col("open"))
    n = F.col("questions").cast("string")
    plain, marked = F.concat(n, F.lit(" Questions · Boards / Competitive Exam")), F.concat(n, F.lit(" Questions ("), F.col("flagged").cast("string"), F.lit(" Flagged for Review) · Exam Prep"))
    return got.withColumn("subtitle", F.when(F.col("flagged") > 0, marked).otherwise(plain))


def deck_title(given: Column) -> Column:
    """A title from a title or file name: without its ending, words apart and capitalised."""
    name = F.regexp_replace(F.regexp_replace(given, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    words = F.initcap(F.trim(F.translate(name, "_-", "  ")))
    return F.when(F.coalesce(words, F.lit("")) == "", F.lit("Question Presentation")).otherwise(F.concat(words, F.lit(" — Practice Deck")))


def print_plan(q: DataFrame, of: list[str], order: list[str]) -> DataFrame:
    """(of, order, line, kind, text): what is printed, line by line: a heading where the section changes, the question's header, its text, pictures, statements, subparts, options and table rows.

    q needs section, question, question_type and options; of images (array of paths), statements, subparts (label, text) and tables (rows) it takes what is there. number is the
    number shown, or else the question mark. Options A to D come first, then others in the order of the map; empty ones are left out.
    """
    has = lambda name: name in q.columns
    line = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    section = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("General"))
    before = F.lag(section).over(Window.partitionBy(*of).orderBy(*order))
    number = F.coalesce(F.nullif(F.col("number").cast("string"), F.lit("")), F.lit("?")) if has("number") else F.lit("?")
    head = F.concat(F.lit("Question "), number, F.lit(" ["), F.upper(F.coalesce("question_type", F.lit("mcq"))), F.lit("]"))
    listed = lambda name, form: F.transform(F.col(name), lambda x: line(name[:-1], F.when(F.coalesce(x["label"], F.lit("")) == "", x["text"]).otherwise(form(x))))
    shown = F.filter(F.map_entries("options"), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    letters = F.array(*map(F.lit, "ABCD"))
    ordered = F.concat(F.filter(shown, lambda e: F.array_contains(letters, e["key"])), F.filter(shown, lambda e: ~F.array_contains(letters, e["key"])))
    ordered = F.array_sort(F.transform(ordered, lambda e, i: F.struct(F.coalesce(F.nullif(F.array_position(letters, e["key"]).cast("int"), F.lit(0)), i + 5).alias("at"), e["key"].alias("key"), e["value"].alias("value"))))
    options = F.transform(ordered, lambda e: line("option", F.concat(F.lit("("), e["key"], F.lit(") "), e["value"])))
    parts = [
        F.when(section.eqNullSafe(F.col("__before")), none).otherwise(F.array(line("heading", F.concat(F.lit("Section: "), section)))),
        F.array(line("header", head), line("question", F.coalesce("question", F.lit("")))),
        F.transform("images", lambda x: line("image", x)) if has("images") else none,
        listed("statements", lambda x: F.concat(x["label"], F.lit(". "), x["text"])) if has("statements") else none,
        listed("subparts", lambda x: F.concat(F.lit("("), x["label"], F.lit(") "), x["text"])) if has("subparts") else none,
        options,
        F.flatten(F.transform("tables", lambda t: F.transform(t["rows"], lambda r: line("table_row", F.array_join(r, "    |    ", ""))))) if has("tables") else none,
    ]
    rows = q.withColumn("__before", before).select(*of, *order, F.posexplode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("line", "x"))
    return rows.select(*of, *order, "line", "x.kind", "x.text")
