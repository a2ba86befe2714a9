"""Reconciliation: citations without a question, the ledger of source blocks, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.predicates import is_section_header
from inkwell.functions.text import has


def citation_blocks(rows: DataFrame) -> DataFrame:
    """Paragraphs of which nothing is left but their citations: (doc_id, ord, block_id, appearances)."""
    return rows.filter((F.col("block_type") == "paragraph") & ~F.col("is_noise") & ~has(F.col("text"), r"(?U)\S") & (F.size("appearances") > 0)).select("doc_id", "ord", "block_id", "appearances")


def citation_targets(cited: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, ord, block_id, appearances, q_seq): the last question any block of which stands before, or else the first one of the document."""
    marks = parts.groupBy("doc_id", "q_seq").agg(F.min("ord").alias("ord")).select("doc_id", "ord", F.lit(None).cast("string").alias("block_id"), F.lit(None).cast("array<string>").alias("appearances"), "q_seq")
    spots = cited.select("doc_id", "ord", F.col("block_id").cast("string").alias("block_id"), "appearances", F.lit(None).cast("int").alias("q_seq"))
    # a question counts as before a block only from the next place on, so blocks sort ahead of questions at the same place
    order = Window.partitionBy("doc_id").orderBy("ord", F.col("q_seq").isNotNull())
    both = marks.unionByName(spots).withColumn("before", F.max("q_seq").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    both = both.withColumn("first", F.min("q_seq").over(Window.partitionBy("doc_id")))
    return both.filter("block_id is not null").select("doc_id", "ord", "block_id", "appearances", F.coalesce("before", "first").alias("q_seq"))


def with_citations(q: DataFrame, targets: DataFrame) -> DataFrame:
    """q with the appearances and blocks of the citation-only paragraphs put to them."""
    got = targets.filter("q_seq is not null").groupBy("doc_id", "q_seq").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", "appearances"))).alias("more"))
    more = q.join(got, ["doc_id", "q_seq"], "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<ord:bigint,block_id:string,appearances:array<string>>>")))
    ids = F.transform("more", lambda x: x["block_id"])
    more = more.withColumn("appearances", F.array_distinct(F.concat("appearances", F.flatten(F.transform("more", lambda x: x["appearances"])))))
    refs = F.transform(ids, lambda i: F.struct(i.alias("block_id"), F.lit("metadata").alias("role")))
    more = more.withColumn("source_blocks", F.concat("source_blocks", refs))
    return more.withColumn("block_ids", F.array_distinct(F.concat("block_ids", ids))).withColumn("owners", F.array_distinct(F.concat("owners", ids))).drop("more")


def owners(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, block_key, q_seq): the first question that holds a part of each block, or that its citations were put to."""
    own = parts.select("doc_id", F.col("block_id").cast("string").alias("block_key"), "q_seq").unionByName(targets.filter("q_seq is not null").select("doc_id", F.col("block_id").alias("block_key"), "q_seq"))
    return own.groupBy("doc_id", "block_key").agg(F.min("q_seq").alias("q_seq"))


def source_ledger(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """(doc_id, ord, block_id, status, reason, q_seq): what became of each source block, exactly one row each."""
    got = rows.withColumn("block_key", F.col("block_id").cast("string")).join(owned, ["doc_id", "block_key"], "left")
    heading = (F.col("block_type") == "paragraph") & is_section_header(F.col("text"))
    ignored = F.when(F.col("is_noise"), "matched configured noise filter").when(F.col("q_seq").isNull() & heading, "section heading retained in section metadata")
    status = F.when(F.col("is_noise"), "ignored_with_reason").when(F.col("q_seq").isNotNull(), "consumed").when(heading, "ignored_with_reason").otherwise("orphaned")
    return got.select("doc_id", "ord", "block_id", status.alias("status"), ignored.alias("reason"), F.when(status == "consumed", F.col("q_seq")).alias("q_seq"))


def duplicate_references(q: DataFrame) -> DataFrame:
    """(doc_id, part_id, n): parts that more than one question names."""
    return q.select("doc_id", F.explode("block_ids").alias("part_id")).groupBy("doc_id", "part_id").agg(F.count("*").alias("n")).filter("n > 1")


def outcome(q: DataFrame) -> DataFrame:
    """q with its bucket: accepted, needs_review or rejected."""
    return q.withColumn("bucket", F.when(~F.col("parsed_ok"), "rejected").when(F.col("needs_review"), "needs_review").otherwise("accepted"))


def diagnostics(q: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per document: counts of questions by bucket and kind, of blocks by fate. The buckets add up to the questions."""
    b = outcome(q)
    count = lambda c, name: F.count_if(c).alias(name)
    of_q = b.groupBy("doc_id").agg(
        F.count("*").alias("questions_detected"), count(F.col("bucket") == "accepted", "questions_accepted"), count(F.col("bucket") == "needs_review", "questions_needs_review"), count(F.col("bucket") == "rejected", "questions_rejected"),
        count(F.col("needs_review"), "questions_flagged_for_review"), count(F.col("source_question_number").isNotNull(), "numbered"), count(F.col("features.has_table"), "tables"), F.sum(F.size("images")).alias("images"), F.sum(F.size("subparts")).alias("subparts"),
        count(F.exists("issues", lambda i: i.startswith("SUSPICIOUS")), "suspicious"), count(F.col("event").isNotNull() & (F.col("event") != "sequence"), "numbering_breaks"),
    )
    of_blocks = ledger.groupBy("doc_id").agg(F.count("*").alias("total_source_blocks"), count(F.col("status") == "consumed", "consumed"), count(F.col("status") == "orphaned", "orphan_blocks"), count(F.col("status") == "ignored_with_reason", "ignored"))
    zero = {c: 0 for c in of_q.columns if c != "doc_id"}
    return of_blocks.join(of_q, "doc_id", "left").fillna(zero)
