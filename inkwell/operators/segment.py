"""Blocks to question candidates.

blocks: doc_id, ord, block_id, block_type, text. One exchange by document serves sections, the fold and the part order;
the fold itself streams over the sorted rows in constant memory, so a document of any length costs linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import predicates as P
from inkwell.functions import spans as S
from inkwell.functions.text import has, label, strip
from inkwell.session import settled, shuffle_parts

GENERAL = "General"
#: What the fold needs to know of a block, as bits of one number.
BITS = ("main", "sub_or_roman", "roman_start", "transition", "question_like", "instruction", "label_ad", "label_ae", "label_e", "image_mark", "small_first", "follow_up", "premise", "question_n", "paragraph", "visual", "ends", "a", "b", "c", "d")
_AT = {name: 1 << i for i, name in enumerate(BITS)}


def prepared(blocks: DataFrame) -> DataFrame:
    """blocks with is_noise, section, appearances and the text without citations; nothing is removed. A null text counts as blank."""
    text = F.coalesce("text", F.lit(""))
    paragraph = F.col("block_type") == "paragraph"
    rows = blocks.select("doc_id", "ord", "block_id", "block_type", text.alias("text_raw"))
    # the windows and the fold need this exchange anyway; as one of a given number it isn't coalesced, for the work is in the patterns, not in the bytes
    rows = rows.repartition(shuffle_parts(blocks.sparkSession), "doc_id")
    rows = rows.withColumn("is_noise", F.col("block_type").eqNullSafe("paragraph") & (P.is_noise(F.col("text_raw")) | ~has(F.col("text_raw"), r"(?U)\S")))
    title = F.when(F.col("block_type").eqNullSafe("paragraph") & ~F.col("is_noise") & P.is_section_header(F.col("text_raw")), strip(F.regexp_replace("text_raw", ":+$", "")))
    so_far = Window.partitionBy("doc_id").orderBy("ord", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(so_far), F.lit(GENERAL)))
    cited = F.when(paragraph, S.appearances(F.col("text_raw"))).otherwise(F.array().cast("array<string>"))
    return settled(rows.withColumn("appearances", cited).withColumn("text", F.when(paragraph, S.without_citations(F.col("text_raw"))).otherwise(F.col("text_raw"))))


def parts(rows: DataFrame) -> DataFrame:
    """Paragraphs cut at option labels: part is 0 for whole blocks, else counts from 1; part_id names it."""
    kept = rows.filter("not is_noise")
    cut = F.when(F.col("block_type") == "paragraph", S.inline_parts(F.col("text"))).otherwise(F.array("text"))
    out = kept.withColumn("pieces", cut).withColumn("whole", F.size("pieces") < 2).select("*", F.posexplode("pieces").alias("at", "piece"))
    whole = F.col("whole") & (F.col("piece") == F.col("text"))
    out = out.withColumn("part", F.when(whole, 0).otherwise(F.col("at") + 1))
    out = out.withColumn("part_id", F.when(whole, F.col("block_id").cast("string")).otherwise(F.concat(F.col("block_id").cast("string"), F.lit(".part_"), F.col("part"))))
    return out.drop("pieces", "whole", "at", "text").withColumnRenamed("piece", "text")


def flagged(pieces: DataFrame) -> DataFrame:
    """Parts that take part in the segmentation, with their number and the bits for the fold. Headers and blank paragraphs are left out."""
    t = strip(F.col("text"))
    paragraph = F.col("block_type").eqNullSafe("paragraph")
    skipped = paragraph & (P.is_section_header(F.col("text")) | (t == ""))
    rows = settled(pieces).filter(~skipped).withColumn("number", F.when(paragraph, P.question_number(F.col("text"))))
    order = Window.partitionBy("doc_id").orderBy("ord", "block_id", "part")
    rows = rows.withColumn("transition", F.col("section") != F.lag("section", 1, GENERAL).over(order))
    rows = rows.withColumn("run", F.sum(F.col("transition").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.coalesce(F.col("number.kind"), F.lit(""))
    roman_body = F.regexp_replace(t, r"(?i)^[IVX]+\.\s*", "")
    flags = {
        "main": kind == "main",
        "sub_or_roman": kind.isin("subpart", "roman"),
        "roman_start": (kind == "roman") & P.is_question_like(roman_body),
        "transition": F.col("transition"),
        "question_like": P.is_question_like(t),
        "instruction": P.is_instruction(t),
        "label_ad": has(t, f"^{P.LABEL_AD}"),
        "label_ae": has(t, f"^{P.LABEL_AE}"),
        "label_e": has(t, r"^[Ee]\.\s+"),
        "image_mark": t.startswith("[IMG:"),
        "small_first": has(t, r"^\p{Ll}"),
        "follow_up": has(t, r"(?i)^(?:where|which|find|the order|choose|select)\b"),
        "premise": has(t, rf"(?i)^(?:{'|'.join(P.PREMISE)})"),
        "question_n": has(t, r"(?i)^Question\s+\d+"),
        "paragraph": paragraph,
        "visual": F.col("block_type").isin("table", "image"),
        "ends": has(t, r"[.?!:\])$]$"),
        **{c: has(F.col("text"), f"(?i){label(c)}") for c in "abcd"},
    }
    bits = F.lit(0)
    for name, test in flags.items():
        bits = bits.bitwiseOR(F.when(test, F.lit(_AT[name])).otherwise(F.lit(0)))
    return rows.withColumn("bits", bits)


def begins(bits: int, state: tuple[bool, int, int, bool, bool]) -> bool:
    """Whether a block begins a question, given (open, labels in paragraphs, labels in all blocks, paragraph text ends a sentence, last block was a table or image)."""
    is_open, labels, labels_all, ended, _ = state
    if not is_open:
        return True
    on = lambda name: bool(bits & _AT[name])
    four = _AT["a"] | _AT["b"] | _AT["c"] | _AT["d"]
    if on("roman_start") and (labels_all == four or on("transition")):
        return True
    if on("visual"):
        return False
    options = labels == four
    if on("main"):
        return True
    if on("sub_or_roman"):
        return False
    if on("transition"):
        return options or on("question_like")
    if on("instruction") or on("label_ad") or on("label_e") or on("image_mark") or on("small_first"):
        return False
    if on("question_n"):
        return True
    if options:
        return on("question_like") or not on("label_ae")
    return on("question_like") and ended and not on("premise")


def _after(bits: int, state: tuple, new: bool) -> tuple[bool, int, int, bool, bool]:
    four = _AT["a"] | _AT["b"] | _AT["c"] | _AT["d"]
    _, labels, labels_all, ended, _ = (True, 0, 0, False, False) if new else state
    if bits & _AT["paragraph"]:
        labels |= bits & four
        ended = bool(bits & _AT["ends"])
    return True, labels, labels_all | bits & four, ended, bool(bits & _AT["visual"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc: object = object()
    state, seq = (False, 0, 0, False, False), 0
    for batch in batches:
        out, starts = [], []
        for d, bits in zip(batch.column("doc_id").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            if d != doc:
                doc, state, seq = d, (False, 0, 0, False, False), 0
            new = begins(bits, state)
            seq += new
            state = _after(bits, state, new)
            out.append(seq)
            starts.append(new)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32()), pa.array(starts, pa.bool_())], names=[*batch.schema.names, "q_seq", "starts"])


def segmented(rows: DataFrame) -> DataFrame:
    """Parts with q_seq, the question they belong to, and starts."""
    kept = rows.drop("is_noise", "text_raw", "transition").sortWithinPartitions("doc_id", "ord", "block_id", "part")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(_fold, f"{schema}, q_seq int, starts boolean")


def numbering(parts_: DataFrame) -> DataFrame:
    """(doc_id, q_seq, scheme, value, label, raw, event, previous, duplicate): numbers of the questions that have one, each held against the one before it."""
    is_roman = (F.col("number.kind") == "roman") & (F.col("bits").bitwiseAND(_AT["roman_start"]) != 0)
    starts = parts_.filter(F.col("starts") & ((F.col("number.kind") == "main") | is_roman))
    value = F.when(F.col("number.kind") == "roman", P.roman_value(F.col("number.value"))).otherwise(F.col("number.value").try_cast("bigint"))  # null beyond 64 bits; label has every number
    transition = F.col("bits").bitwiseAND(_AT["transition"]) != 0
    rows = starts.select("doc_id", "q_seq", "section", "run", transition.alias("moved"), F.when(F.col("number.kind") == "roman", "roman").otherwise("arabic").alias("scheme"), value.alias("value"), F.col("number.value").alias("label"), "number.raw")
    order = Window.partitionBy("doc_id").orderBy("q_seq")
    for name in ("value", "run", "scheme"):
        rows = rows.withColumn(f"last_{name}", F.lag(name).over(order))
    same = F.col("last_run") == F.col("run")
    before = F.when(F.col("moved"), F.when(F.col("last_run") == F.col("run") - 1, F.col("last_value"))).otherwise(F.when(same, F.col("last_value")))
    again = F.row_number().over(Window.partitionBy("doc_id", "run", "value").orderBy("q_seq")) > 1
    rows = rows.withColumn("previous", before).withColumn("duplicate", again)
    event = F.when(F.col("moved") & F.col("previous").isNotNull(), "section_reset").when(same & (F.col("last_scheme") != F.col("scheme")), "numbering_scheme_transition")
    event = event.when(F.col("value") < F.col("previous"), "regression").when(F.col("duplicate"), "duplicate").when(F.col("value") > F.col("previous") + 1, "gap").otherwise("sequence")
    return rows.select("doc_id", "q_seq", "section", "scheme", "value", "label", "raw", event.alias("event"), "previous", "duplicate")
