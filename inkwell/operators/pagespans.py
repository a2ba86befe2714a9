"""Positioned text spans of pages to lines and groups (windows and aggregations).

spans: doc_id, page, line_no, span_no, text, size, x0, x1, y (baseline), line_y0, line_y1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import strip
from inkwell.operators import geometry

# Letters that have raised and lowered forms.
RAISED = ("0123456789+-−=()abcdefghijklmnoprstuvwxyz", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁻⁼⁽⁾ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ")
LOWERED = ("0123456789+-−=()aehklmnopstx", "₀₁₂₃₄₅₆₇₈₉₊₋₋₌₍₎ₐₑₕₖₗₘₙₒₚₛₜₓ")
LINE = ["doc_id", "page", "line_no"]


def _script(text, table: tuple[str, str], marker: str):
    t = strip(text)
    letters = "[" + table[0].replace("-", "\\-").replace("(", "\\(").replace(")", "\\)") + "]+"
    return F.when(t.rlike(f"^{letters}$"), F.translate(t, *table)).otherwise(F.concat(F.lit(marker + "{"), t, F.lit("}")))


def repeating_lines(spans: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc_id, text): lines that stand at one height on at least share of the pages."""
    lines = spans.groupBy(*LINE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "").alias("text"), F.max("line_y1").alias("y"))
    lines = lines.withColumn("text", strip(F.col("text"))).filter("text <> ''")
    pages = spans.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = lines.groupBy("doc_id", "text", F.bround("y").alias("y")).agg(F.count_distinct("page").alias("seen"))
    return seen.join(pages, "doc_id").filter(F.col("seen") >= share * F.col("pages")).select("doc_id", "text").distinct()


def segments(spans: DataFrame, gap: float = 2.0) -> DataFrame:
    """spans with segment: a new one begins where the gap to the span before is wider than gap times the larger font."""
    order = Window.partitionBy(*LINE).orderBy("x0", "span_no")
    wide = F.col("x0") - F.lag("x1").over(order) > gap * F.greatest("size", F.lag("size").over(order))
    rows = spans.filter("text <> ''").withColumn("wide", F.coalesce(wide.cast("int"), F.lit(0)))
    return rows.withColumn("segment", F.sum("wide").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("wide")


def scripted(rows: DataFrame, small: float = 0.95, shift: float = 1.0) -> DataFrame:
    """rows of segments() with align (superscript, subscript or null) and shown, the text as it reads: smaller and shifted spans against the font that holds most letters."""
    part = [*LINE, "segment"]
    real = rows.filter(strip(F.col("text")) != "").withColumn("top", F.max("size").over(Window.partitionBy(*part)))
    fonts = real.filter(F.col("size") >= small * F.col("top")).groupBy(*part, F.round("size", 1).alias("font")).agg(F.sum(F.length(strip(F.col("text")))).alias("mass"), F.min(F.struct("x0", "span_no")).alias("at"))
    base = fonts.groupBy(*part).agg(F.min_by("font", F.struct(-F.col("mass"), "at")).alias("base"))
    level = real.withColumn("font", F.round("size", 1)).join(base, part).filter("font = base").groupBy(*part).agg(F.first("base").alias("base"), F.min_by("y", F.struct("x0", "span_no")).alias("base_y"))
    out = rows.join(level, part, "left")
    off = (strip(F.col("text")) != "") & (F.col("size") < small * F.col("base")) & (F.abs(F.col("y") - F.col("base_y")) >= shift)
    out = out.withColumn("align", F.when(off, F.when(F.col("y") < F.col("base_y"), "superscript").otherwise("subscript")))
    shown = F.when(F.col("align") == "superscript", _script(F.col("text"), RAISED, "^")).when(F.col("align") == "subscript", _script(F.col("text"), LOWERED, "_")).otherwise(F.col("text"))
    return out.withColumn("shown", shown).drop("base", "base_y")


def items(spans: DataFrame, repeating: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, item, text, x0, x1, y0, y1, size): one item per segment in reading order; repeating lines are left out."""
    rows = scripted(segments(spans))
    got = rows.groupBy(*LINE, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "span_no", "shown"))), lambda s: s["shown"]), "").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("line_y0").alias("y0"), F.max("line_y1").alias("y1"), F.max("size").alias("size"))
    got = got.withColumn("text", strip(F.col("text"))).filter("text <> ''")
    if repeating is not None:
        got = got.join(repeating, ["doc_id", "text"], "left_anti")
    order = Window.partitionBy("doc_id", "page").orderBy(F.bround(F.col("y0") / 5) * 5, "x0", "line_no", "segment")
    return got.withColumn("item", F.row_number().over(order)).select("doc_id", "page", "item", "text", "x0", "x1", "y0", "y1", "size")


def line_groups(found: DataFrame) -> DataFrame:
    """items with line_group: a new one begins where an item lies wholly below all before it on its page."""
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "item")
    below = F.col("y0") > F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("below", F.coalesce(below.cast("int"), F.lit(0)))
    return rows.withColumn("line_group", F.sum("below").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("below")


def rules(drawings: DataFrame) -> DataFrame:
    """(doc_id, page, x0, x1, y0, y1): the level strokes among a page's drawings (doc_id, page, kind line or rect, x0, y0, x1, y1): lines that rise less than 2, and boxes less than 3 high, if longer than 5."""
    left, right, middle = F.least("x0", "x1"), F.greatest("x0", "x1"), (F.col("y0") + F.col("y1")) / 2
    level = (F.col("kind") == "line") & (F.abs(F.col("y0") - F.col("y1")) < 2)
    flat = (F.col("kind") == "rect") & (F.col("y1") - F.col("y0") < 3)
    kept = drawings.filter((level | flat) & (right - left > 5))
    low, high = F.when(F.col("kind") == "line", middle - 1).otherwise(F.col("y0")), F.when(F.col("kind") == "line", middle + 1).otherwise(F.col("y1"))
    return kept.select("doc_id", "page", left.alias("x0"), right.alias("x1"), low.alias("y0"), high.alias("y1"))


def page_blocks(spans: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, ord, block_id, block_type, text): the paragraphs of pages given as spans and drawings.

    Headers and footers go, texts and drawn rules are taken together to groups that overlap from top to bottom, and each group
    is one paragraph with its fractions, roots and integrals rebuilt. Groups without text give no row.
    """
    found = items(spans, repeating_lines(spans)).withColumn("kind", F.lit("text"))
    if drawings is not None:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("item", "int"), ("text", "string"), ("size", "double"))]
        found = found.unionByName(rules(drawings).select("*", *empty, F.lit("rule").alias("kind")))
    order = Window.partitionBy("doc_id", "page").orderBy(F.bround(F.col("y0") / 5) * 5, "x0", F.col("item").isNull(), "item", "x1")
    groups = line_groups(found.withColumn("item", F.row_number().over(order)))
    lines = geometry.lines(groups).filter("text <> ''")
    numbered = lines.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_group")))
    return numbered.select("doc_id", "page", F.col("ord").cast("bigint").alias("ord"), F.col("ord").cast("string").alias("block_id"), F.lit("paragraph").alias("block_type"), "text")


def blocks(groups: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text): one paragraph per group, left to right."""
    got = groups.groupBy("doc_id", "page", "line_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "item", "text"))), lambda s: s["text"]), " ").alias("text"))
    return got.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_group"))).select("doc_id", "page", "ord", "text")
