"""A relation of exam lines made from the part table, the same by DataFrame and by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import table

#: The nine places of a part's lines; k is its key. Written so that Spark and DuckDB read them alike.
PLACES = (
    "case when k % 20 = 0 or k % 7 = 0 then concat('Section ', substr('ABCDE', cast(k % 5 as int) + 1, 1)) else '' end",
    "case when k % 11 = 0 then 'Join our channel' else '' end",
    "case cast(k % 6 as int) when 0 then concat(cast(k % 20 + 1 as varchar(20)), '. Which brand is ', p_name, '? (', cast(2005 + k % 20 as varchar(20)), 'M)')"
    " when 1 then concat('Q', cast(k % 20 + 1 as varchar(20)), '. Find the size of ', p_name, ' [2019, 2021]')"
    " when 2 then concat('Evaluate $x^{', cast(k % 4 as varchar(20)), '}$ for ', p_name, '.')"
    " when 3 then concat(cast(k % 20 + 1 as varchar(20)), ') Statement I: ', p_name, ' is new.')"
    " when 4 then concat('II. Find the price of ', p_name)"
    " else concat('Question ', cast(k % 20 + 1 as varchar(20)), ': Assertion A: ', p_name, ' Reason R: none') end",
    "case when k % 6 = 3 then concat('Statement II: size is ', cast(p_size as varchar(20))) when k % 13 = 0 then 'where size is fixed' else '' end",
    "case cast(k % 5 as int) when 0 then concat('(A) ', p_brand, ' (B) two (C) three (D) ', cast(k as varchar(20))) when 1 then concat('(a) ', p_brand, ' (b) ', p_brand)"
    " when 2 then concat('A. ', p_brand) when 3 then concat('(A) ', p_brand, ' (B) two (C) three') else '' end",
    "case cast(k % 5 as int) when 1 then concat('(c) ', p_type, ' (d) ', cast(k as varchar(20))) when 2 then 'B. two' else '' end",
    "case when k % 5 = 2 then 'C. three' else '' end",
    "case when k % 5 = 2 then 'D. four' else '' end",
    "case when k % 9 = 0 then '(2018, 2020)' else '' end",
)

#: exam_lines(doc_id, ord, line) as a WITH clause for DuckDB.
SQL = "WITH p AS (SELECT p_partkey AS k, * FROM part), exam_lines AS (" + " UNION ALL ".join(f"SELECT doc_id, ord, line FROM (SELECT CAST(floor(k / 20) AS BIGINT) AS doc_id, k * 10 + {i} AS ord, {e} AS line FROM p) WHERE line <> ''" for i, e in enumerate(PLACES)) + ")"


def exam_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ord, line): about six lines per part, twenty parts a document."""
    lines = F.array(*[F.expr(e) for e in PLACES])
    rows = table(spark, d, "part").withColumn("k", F.col("p_partkey")).select("k", F.posexplode(lines).alias("pos", "line")).filter("line <> ''")
    return rows.select(F.floor(F.col("k") / 20).cast("bigint").alias("doc_id"), (F.col("k") * 10 + F.col("pos")).alias("ord"), "line")


def exam_blocks(spark: SparkSession, d: str) -> DataFrame:
    return exam_lines(spark, d).select("doc_id", "ord", F.col("ord").cast("string").alias("block_id"), F.lit("paragraph").alias("block_type"), F.col("line").alias("text"))
