"""Queries of the training-text operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import leaks, lines, markup, neardup, spans, textform, tokens
from inkwell.session import checkpointed, table


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, site_id), one row per file."""
    return table(spark, d, "source_files").filter("file_id is not null").groupBy("file_id").agg(F.min("site_id").alias("host"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    """The fields of questions and blocks with their hosts."""
    questions = table(spark, d, "questions").join(_sites(spark, d), "file_id", "left")
    blocks = table(spark, d, "document_blocks").withColumn("host", F.col("site_id"))
    asked = textform.fields(questions, None, "host")
    return asked.unionByName(textform.fields(None, blocks, "host"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of questions with at least 30 different words and a likeness of at least 0.7."""
    links, members = neardup.near_duplicates(neardup.question_sets(table(spark, d, "questions"), 30), 0.7)
    return neardup.expanded(links, members).select(F.col("a").alias("question_uid_a"), F.col("b").alias("question_uid_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every question, however short, with its group of near-duplicates and its number of links; blank ones and those without words are groups of their own."""
    questions = table(spark, d, "questions")
    links, members = neardup.near_duplicates(neardup.question_sets(questions), 0.7)
    return neardup.with_rest(neardup.groups(links, members), questions.select(F.col("question_uid").alias("id"))).withColumnRenamed("id", "question_uid")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Field values with markup: those whose tree, aligned with the wrapper of its class, has any markup node, of the wrapper's or of its own."""
    return markup.marked(_values(spark, d)).filter("n_markup > 0").select("table_name", "record_id", "field").dropDuplicates()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every field value's clean text and structure."""
    return markup.cleaned(_values(spark, d))


def p3_wrappers(spark: SparkSession, d: str) -> DataFrame:
    """The wrapper of each class of pages with its constant leaves."""
    return markup.learned(checkpointed(markup.pages(_values(spark, d))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Field values that differ from their consistent form."""
    values = textform.fields(table(spark, d, "questions"), table(spark, d, "document_blocks"))
    return textform.differing(values).select("table_name", "record_id", "field").dropDuplicates()


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every field value in the consistent form."""
    values = textform.fields(table(spark, d, "questions"), table(spark, d, "document_blocks"))
    return values.withColumn("form", textform.consistent_column(F.col("value"))).select("table_name", "record_id", "field", "form").dropDuplicates()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines to be removed: repeated over a site's files or over a file's pages. The case counts files, so clusters count with their sizes here."""
    return lines.repeated(*lines.lines_of(table(spark, d, "document_blocks")), over="files").select("block_uid", F.col("line_no").cast("bigint").alias("line_no"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each line occurs over the files, clusters of equal files and days of its site."""
    over, _ = lines.line_counts(*lines.lines_of(table(spark, d, "document_blocks")))
    return over.withColumn("key", F.hex("key"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every block's text without the lines repeated over a site's clusters of equal files and their dates, or over a file's pages."""
    blocks = table(spark, d, "document_blocks")
    return lines.without(blocks, lines.repeated(*lines.lines_of(blocks)))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k, without special tokens."""
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 13 consecutive words of an item: of the operator's matches those whose words agree exactly."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter(F.col("run") >= leaks.WINDOW).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a window of 13 words of an item with at most one edit, and the longest exact run."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with at least 250 consecutive characters in common."""
    return spans.pairs(table(spark, d, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands in others."""
    return spans.coverage(table(spark, d, "documents")).withColumn("spans", F.to_json("spans"))


def p8_removed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text without what an earlier one holds."""
    return spans.removed(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_clean, p3_wrappers, p4_found, p4_forms, p5_found, p5_counts, p5_clean, p6_ids, p6_decoded, p7_found, p7_leaks, p8_found, p8_coverage, p8_removed)}
SQL: dict[str, str] = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
