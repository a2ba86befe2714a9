"""Lines repeated over the documents of one source, or over the pages of one document.

Duplicate documents are collapsed first: documents of a source with the same set of lines are one cluster. Each line is then
counted over clusters and over their dates. Boilerplate is what stands in many clusters and on several dates; an article that
was published again and again is one cluster, so its lines are not taken for boilerplate. Where documents are to be
counted instead, each cluster counts with its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.joins import merged, spread_join
from inkwell.llm.textform import consistent_column
from inkwell.session import checkpointed, once_per


def line_keys(text: Column) -> Column:
    """An array with the key of each line of a text: a 16-byte digest of the line in the consistent form, lower-cased, trimmed, each run of white space one space, each run of digits one sign. Blank lines have null."""
    plain = F.lower(consistent_column(text))

    def key(line: Column) -> Column:
        one = F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), r"(?U)\d+", "#")
        one = F.trim(one)
        return F.when(one != "", F.unhex(F.md5(one)))

    return F.transform(F.split(plain, "\n", -1), key)


def lines_of(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block_uid, line_no, file_id, site_id, page, day, key) of each line that is not blank, and (site_id, file_id, page, day) of the rows.

    Repeated rows count once (the earliest by ingested_at; rows with a null block_uid are told apart by their values). A null site is a site of its own.
    """
    rows = blocks.select("block_uid", "file_id", "site_id", "page", "ingested_at", line_keys(F.col("text")).alias("keys"))
    rows = once_per(rows, "block_uid", ["ingested_at", "file_id", "site_id", "page", "keys"])
    rows = checkpointed(rows.select("block_uid", "file_id", F.coalesce("site_id", F.lit("")).alias("site_id"), "page", F.to_date("ingested_at").alias("day"), "keys"))
    each = rows.select("block_uid", "file_id", "site_id", "page", F.posexplode("keys").alias("line_no", "key")).filter("key is not null")
    return each, rows.groupBy("site_id", "file_id", "page").agg(F.min("day").alias("day"))


def line_counts(each: DataFrame, spread: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of each line over its site: (site_id, key, n_files, n_clusters, n_days, site_files, site_clusters, site_days); and over its document: (site_id, file_id, key, n_pages, file_pages).

    A document's date is the earliest of its blocks, a cluster's the earliest of its documents.
    """
    held = each.filter("file_id is not null").groupBy("site_id", "file_id", "page", "key").agg(F.lit(1).alias("one")).groupBy("site_id", "file_id", "key").agg(F.count("page").alias("n_pages"))
    held = checkpointed(held)
    files = spread.filter("file_id is not null").groupBy("site_id", "file_id").agg(F.count("page").alias("file_pages"), F.min("day").alias("day"))
    prints = held.groupBy("site_id", "file_id").agg(F.bit_xor(F.xxhash64("key")).alias("print"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("print2"), F.count("*").alias("n_keys"))
    known = checkpointed(merged(files, prints, ["site_id", "file_id"], "left"))
    apart = F.when(F.col("print").isNull(), F.col("file_id"))  # documents without lines aren't copies of each other
    clusters = known.groupBy("site_id", "print", "print2", "n_keys", apart.alias("apart")).agg(F.min("file_id").alias("file_id"), F.count("*").alias("size"), F.min("day").alias("day"))
    clusters = checkpointed(clusters.select("site_id", "file_id", "size", "day"))
    by_date = clusters.groupBy("site_id", "day").agg(F.sum("size").alias("size"), F.count("*").alias("clusters"))
    sites = checkpointed(by_date.groupBy("site_id").agg(F.sum("size").alias("site_files"), F.sum("clusters").alias("site_clusters"), F.count("day").alias("site_days")))
    counted = merged(held, clusters, ["site_id", "file_id"])
    by_day = counted.groupBy("site_id", "key", "day").agg(F.sum("size").alias("size"), F.count("*").alias("clusters"))
    over = by_day.groupBy("site_id", "key").agg(F.sum("size").alias("n_files"), F.sum("clusters").alias("n_clusters"), F.count("day").alias("n_days"))
    own = merged(held.filter("n_pages > 0"), known.select("site_id", "file_id", "file_pages"), ["site_id", "file_id"])
    return spread_join(over, sites, ["site_id"], ["key"]), own


def repeated(each: DataFrame, spread: DataFrame, least: int = 3, share: float = 0.2, least_pages: int = 5, page_share: float = 0.5, over: str = "clusters", least_days: int = 2) -> DataFrame:
    """(block_uid, line_no): lines repeated over their site, or on page_share of the pages of their own document if it has least_pages.

    over says what is counted on a site: "clusters" of equal documents, of which a line must be in at least least and in that share, and on least_days
    dates if the site has so many; or "files", each for itself and whatever their dates, so that copies of one article count.
    """
    counts, own = line_counts(each, spread)
    n, whole = ("n_clusters", "site_clusters") if over == "clusters" else ("n_files", "site_files")
    often = (F.col(n) >= least) & (F.col(n) >= share * F.col(whole))
    if over == "clusters":
        often = often & (F.col("n_days") >= F.least(F.lit(least_days), "site_days"))
    site_wide = checkpointed(counts.filter(often).select("site_id", "key", F.lit(True).alias("often")))
    paged = own.filter((F.col("file_pages") >= least_pages) & (F.col("n_pages") >= page_share * F.col("file_pages"))).select("site_id", "file_id", "key")
    spots = each.select("block_uid", "line_no", "site_id", "file_id", "key")
    of_site = spread_join(spots, site_wide, ["site_id", "key"], ["block_uid", "line_no"]).filter("often").select("block_uid", "line_no")
    of_file = merged(spots, paged, ["site_id", "file_id", "key"], "left_semi").select("block_uid", "line_no")
    return of_site.unionByName(of_file).dropDuplicates()


def without(blocks: DataFrame, marked: DataFrame) -> DataFrame:
    """(block_uid, text, removed): each block's text without the marked lines, one row per block with an id; removed counts them. A null text stays null."""
    rows = once_per(blocks.filter("block_uid is not null").select("block_uid", "text", "ingested_at"), "block_uid", ["ingested_at", "text"])
    gone = marked.groupBy("block_uid").agg(F.collect_list(F.col("line_no").cast("int")).alias("gone"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    out = merged(rows, gone, "block_uid", "left")
    return out.select("block_uid", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
