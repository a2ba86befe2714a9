"""The whole way from blocks to an audited question bank."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import assemble, ledger, payload, segment
from inkwell.session import checkpointed


class Bank:
    """All tables of a question bank; each is planned when it is first asked for.

    rows: prepared blocks; parts: with q_seq; numbers: numbering events; records: questions before validation; questions: validated, with their citations, tables and inline nodes; ledger: one row per block; diagnostics: one row per document.
    rows and parts, from which all others come, are computed once and kept in checkpoints: the scan, the exchange by document and the fold are not repeated for each table.
    """

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    @cached_property
    def rows(self) -> DataFrame:
        return checkpointed(segment.prepared(self.blocks))

    @cached_property
    def parts(self) -> DataFrame:
        return checkpointed(segment.segmented(segment.flagged(segment.parts(self.rows))))

    @cached_property
    def numbers(self) -> DataFrame:
        return segment.numbering(self.parts)

    @cached_property
    def cited(self) -> DataFrame:
        return ledger.citation_targets(ledger.citation_blocks(self.rows), self.parts)

    @cached_property
    def records(self) -> DataFrame:
        return assemble.records(self.parts, self.numbers)

    @cached_property
    def validated(self) -> DataFrame:
        return ledger.with_citations(assemble.validated(self.records), self.cited)

    @cached_property
    def questions(self) -> DataFrame:
        nested = {"children", "inline_content"} <= set(self.blocks.columns)
        return payload.attached(self.validated, self.blocks) if nested else self.validated

    @cached_property
    def ledger(self) -> DataFrame:
        return ledger.source_ledger(self.rows, ledger.owners(self.parts, self.cited))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return ledger.diagnostics(self.validated, self.ledger)


def build(blocks: DataFrame) -> Bank:
    """blocks: doc_id, ord, block_id, block_type, text; with children and inline_content the records have their tables and inline nodes too. Other columns are ignored."""
    return Bank(blocks)


def blocks_of(table: DataFrame) -> DataFrame:
    """document_blocks rows as blocks, repeated rows once, with their nested cells. A table's cells stay out of its text, for their words must not take part in the segmentation; they come into the records by payload.attached."""
    from inkwell.session import once_per

    kept = once_per(table.select("block_uid", "file_id", F.col("ord").cast("bigint").alias("ord"), "block_id", "block_type", "text", "children", "inline_content", "ingested_at").filter("file_id is not null"), "block_uid", ["ingested_at", "ord", "block_id", "text"])
    return kept.select(F.col("file_id").alias("doc_id"), "ord", "block_id", F.coalesce("block_type", F.lit("paragraph")).alias("block_type"), "text", "children", "inline_content")


def sections(rows: DataFrame) -> DataFrame:
    """(doc_id, section, first_ord, n_blocks): sections in the order of their first block."""
    return rows.filter("not is_noise").groupBy("doc_id", "section").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_blocks"))
