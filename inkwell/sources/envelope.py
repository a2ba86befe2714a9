"""Question banks as JSON: one envelope per document, written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.text import strip
from inkwell.operators.pipeline import Bank

VERSION = "2.0"
QUESTION = "struct<q_seq:int,section:string,source_question_number:string,question:string,options:map<string,string>,question_type:string,appearances:array<string>,images:array<string>,parsed_ok:boolean,needs_review:boolean,quality_score:double,block_ids:array<string>,issues:array<string>>"


def envelopes(bank: Bank) -> DataFrame:
    """(doc_id, json): schema version, sections in order, questions in order and the counts of each document."""
    names = [x.split(":")[0] for x in QUESTION[7:-1].replace("map<string,string>", "m").split(",")]
    q = bank.questions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("q_seq", *names[1:2], F.to_json(F.struct(*names)).alias("j")))).alias("qs"))
    titles = bank.rows.filter("not is_noise").groupBy("doc_id", "section").agg(F.min("ord").alias("at"))
    titles = titles.withColumn("id", F.concat(F.lit("section-"), F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("string")))
    titles = titles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", F.col("section").alias("title")))).alias("ss"))
    counts = bank.diagnostics.select("doc_id", F.struct([c for c in bank.diagnostics.columns if c != "doc_id"]).alias("diagnostics"))
    all_ = counts.join(q, "doc_id", "left").join(titles, "doc_id", "left")
    questions = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("qs", F.array()), lambda x: x["j"]), ","), F.lit("]"))
    sections = F.to_json(F.transform("ss", lambda s: F.struct(s["id"].alias("id"), s["title"].alias("title"))))
    return all_.select("doc_id", F.concat(F.lit(f'{{"schema_version":"{VERSION}","sections":'), F.coalesce(sections, F.lit("[]")), F.lit(',"questions":'), questions, F.lit(',"diagnostics":'), F.to_json("diagnostics"), F.lit("}")).alias("json"))


def write(bank: Bank, path: str) -> None:
    envelopes(bank).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(file, question fields) of envelopes or bare arrays of questions: one JSON value a line, or with whole one a file, indented as it may be."""
    text = spark.read.text(path, wholetext=whole).select(F.input_file_name().alias("file"), strip(F.col("value")).alias("v"))
    bare = F.from_json("v", f"array<{QUESTION}>")
    wrapped = F.from_json("v", f"struct<questions:array<{QUESTION}>>")["questions"]
    return text.select("file", F.explode(F.when(F.col("v").startswith("["), bare).otherwise(wrapped)).alias("q")).select("file", "q.*")


def checked(q: DataFrame) -> DataFrame:
    """q, or an error if its outcome buckets don't add up to its questions."""
    n = q.agg(F.count("*").alias("n"), F.count_if(F.col("parsed_ok") & ~F.col("needs_review")).alias("a"), F.count_if(F.col("parsed_ok") & F.col("needs_review")).alias("r"), F.count_if(~F.col("parsed_ok")).alias("x")).first()
    if n["a"] + n["r"] + n["x"] != n["n"]:
        raise ValueError(f"{n['n']} questions, but {n['a']} accepted, {n['r']} to review, {n['x']} rejected")
    return q
