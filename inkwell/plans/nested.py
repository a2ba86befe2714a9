"""Queries over nested blocks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.nested import flatten_nodes, inside, node_tables
from inkwell.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every nested node with its parent's path."""
    return flatten_nodes(table(spark, d, "document_blocks")).select("block_uid", "parent_path", "node_path")


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every nested node with its type and interval labels."""
    return flatten_nodes(table(spark, d, "document_blocks"))


def p2_owners(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the inline and run tables with the nested block that holds them, by interval containment."""
    nodes = flatten_nodes(table(spark, d, "document_blocks"))
    tables = node_tables(nodes)
    held = tables["inline"].unionByName(tables["run"]).select("block_uid", "pre", "post", "node_path")
    return inside(tables["block"], held).select("block_uid", "node_path", F.coalesce("ancestor_path", F.lit("")).alias("owner_path"))


QUERIES = {"p2_found": p2_found, "p2_nodes": p2_nodes, "p2_owners": p2_owners}
SQL: dict[str, str] = {}
