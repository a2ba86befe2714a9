"""Corrections by hand and proposals of a recovery provider, merged as joins."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import settled

OPTIONS = "map<string,string>"
MCQ_LIKE = ("mcq", "multiple_correct", "statement_based", "assertion_reason", "match_list")
#: Matching corrections up to this many go to the workers as one automaton; more are joined by their first characters.
MOST_MATCHES = 100_000


def merged(options: Column, new: Column) -> Column:
    """options with new ones over them."""
    base = F.coalesce(options, F.create_map().cast(OPTIONS))
    over = F.coalesce(new, F.create_map().cast(OPTIONS))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def _apply(q: DataFrame, prefix: str) -> DataFrame:
    for name in ("question", "question_type", "parsed_ok"):
        q = q.withColumn(name, F.coalesce(f"{prefix}_{name}", name))
    q = q.withColumn("options", merged(F.col("options"), F.col(f"{prefix}_options")))
    return settled(q.drop(*[f"{prefix}_{n}" for n in ("question", "question_type", "parsed_ok", "options")]))


def corrected(q: DataFrame, corrections: DataFrame) -> DataFrame:
    """q (question_id, question, options, question_type, parsed_ok, ...) with corrections (key, match, question, options, question_type, parsed_ok) put in.

    First by id, then every correction whose match is part of the question as it then reads, in the order of keys, later ones
    over earlier ones. Records with a null or empty question are left alone; null fields of a correction change nothing.
    """
    fields = ("question", "question_type", "parsed_ok", "options")
    by_id = corrections.filter("key is not null").select(F.col("key").alias("__key"), *[F.col(f).alias(f"id_{f}") for f in fields]).dropDuplicates(["__key"])
    live = F.coalesce(F.col("question"), F.lit("")) != ""
    out = q.join(by_id, live & (F.col("question_id").cast("string") == F.col("__key")), "left").drop("__key")
    out = _apply(out, "id")
    matching = corrections.filter("match is not null and match <> ''")
    texts = out.select("question_id", "question").filter("question <> ''").distinct()
    known = [r["match"] for r in matching.select("match").distinct().limit(MOST_MATCHES + 1).collect()]
    if not known:
        return out
    held = _held(texts, known) if len(known) <= MOST_MATCHES else _held_by_start(texts, matching)
    hits = held.join(matching.select("key", "match", F.struct(*fields).alias("fix")), "match")
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    per = hits.groupBy("question_id", F.col("question").alias("__q")).agg(F.array_sort(F.collect_list(F.struct("key", "fix")), by_key).alias("fixes"))
    last = lambda f: F.try_element_at(F.filter(F.transform("fixes", lambda x: x["fix"][f]), lambda v: v.isNotNull()), F.lit(-1))
    empty = F.create_map().cast(OPTIONS)
    options = F.aggregate(F.transform("fixes", lambda x: F.coalesce(x["fix"]["options"], F.lit(None).cast(OPTIONS))), empty, merged)
    per = per.select(F.col("question_id").alias("__id"), "__q", *[last(f).alias(f"m_{f}") for f in fields[:3]], options.alias("m_options"))
    same = F.col("question_id").eqNullSafe(F.col("__id")) & (F.col("question") == F.col("__q"))
    return _apply(out.join(per, same, "left").drop("__id", "__q"), "m")


def _held(texts: DataFrame, matches: list[str]) -> DataFrame:
    """(question_id, question, match): the matches that are part of each text, found in one pass with one automaton."""
    shared = texts.sparkSession.sparkContext.broadcast(matches)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for m in shared.value:
            automaton.add_word(m, m)
        automaton.make_automaton()
        for b in batches:
            found = [sorted({m for _, m in automaton.iter(q)}) for q in b["question"]]
            yield b.assign(match=found)[[bool(f) for f in found]].explode("match")

    return texts.mapInPandas(run, f"question_id {dict(texts.dtypes)['question_id']}, question string, match string")


def _held_by_start(texts: DataFrame, matching: DataFrame) -> DataFrame:
    """The same for any number of matches: a join of each text's pieces of up to three characters with the matches' first characters."""
    q = F.col("question")
    pieces = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(q) - k + 1, F.lit(1))), lambda i: F.substring(q, i, F.lit(k)))
    starts = texts.select("question_id", "question", F.explode(F.array_distinct(F.concat(*map(pieces, (1, 2, 3))))).alias("start"))
    known = matching.select("match").distinct().withColumn("start", F.substring("match", 1, 3))
    return starts.join(known.hint("merge"), "start").filter(q.contains(F.col("match"))).select("question_id", "question", "match").distinct()


def contexts(q: DataFrame) -> DataFrame:
    """What a provider is told of each record that failed or needs review; ids that occur again get a number behind."""
    failed = q.filter(~F.col("parsed_ok") | F.col("needs_review"))
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("question"))
    key = F.when(nth == 1, F.col("question_id").cast("string")).otherwise(F.concat(F.col("question_id").cast("string"), F.lit("#"), nth))
    return failed.withColumn("key", key).select("key", "question_id", F.coalesce("section", F.lit("General")).alias("section"), F.coalesce("question", F.lit("")).alias("question"), "options", F.coalesce("question_type", F.lit("unknown")).alias("question_type"))


def proposals(asked: DataFrame, provider: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """(key, question, options, extra, error): a provider's answers. It gets all records of a partition in one call; if it fails, each of them has an error."""
    out = "key string, question string, options map<string,string>, extra array<string>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.to_dict("records")]
        if not rows:
            return
        try:
            answers = provider(rows)
            if not isinstance(answers, list):
                raise ValueError("a provider returns a list")
        except Exception as e:  # noqa: BLE001
            yield pd.DataFrame([(r["key"], None, None, [], repr(e)) for r in rows], columns=["key", "question", "options", "extra", "error"])
            return
        got = []
        for a in answers:
            if isinstance(a, dict) and a.get("id") is not None:
                text, options = a.get("question"), a.get("options")
                extra = sorted(set(a) - {"id", "question", "options"}) + ["__schema_error__"] * (not isinstance(text, str) or not isinstance(options, dict))
                clean = {str(k).strip().upper(): str(v).strip() for k, v in options.items()} if isinstance(options, dict) else {}
                got.append((str(a["id"]), text if isinstance(text, str) else "", clean, extra, None))
        yield pd.DataFrame(got, columns=["key", "question", "options", "extra", "error"])

    return asked.mapInPandas(run, out)


def recovered(q: DataFrame, answers: DataFrame) -> DataFrame:
    """q with the proposals that can be accepted, and recovery: applied, rejected, failed or null. The first proposal of an id counts; unknown ids are ignored.

    Accepted is a proposal without extra fields, with a question, with labels A to E only and none of them empty, and with A to D where the record is of a multiple-choice kind.
    Rejected and failed ones leave the record as it is but for needs_review. Validate again afterwards.
    """
    first = answers.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("error").isNotNull(), "question"))).filter("__n = 1")
    p = first.select(F.col("key").alias("p_key"), F.col("question").alias("p_question"), F.col("options").alias("p_options"), F.col("extra").alias("p_extra"), F.col("error").alias("p_error"))
    failed = ~F.col("parsed_ok") | F.col("needs_review")
    out = q.join(p, failed & (F.col("question_id").cast("string") == F.col("p_key")), "left")
    labels = F.map_keys("p_options")
    four = F.forall(F.array(*[F.lit(c) for c in "ABCD"]), lambda c: F.map_contains_key("p_options", c))
    listed = F.coalesce(F.lower("question_type"), F.lit("")).isin(*MCQ_LIKE) | (F.size("options") > 0)
    fits = (F.trim("p_question") != "") & (F.size("p_extra") == 0) & (F.size(F.array_except(labels, F.array(*[F.lit(c) for c in "ABCDE"]))) == 0) & F.forall(F.map_values("p_options"), lambda v: v != "") & (~listed | four)
    out = settled(out.withColumn("recovery", F.when(F.col("p_key").isNull(), None).when(F.col("p_error").isNotNull(), "failed").when(F.coalesce(fits, F.lit(False)), "applied").otherwise("rejected")))
    applied = F.coalesce(F.col("recovery") == "applied", F.lit(False))
    out = out.withColumn("question", F.when(applied, F.trim("p_question")).otherwise(F.col("question"))).withColumn("options", F.when(applied, F.col("p_options")).otherwise(F.col("options")))
    out = out.withColumn("needs_review", F.col("needs_review") | F.coalesce(F.col("recovery").isin("failed", "rejected"), F.lit(False)))
    return out.drop("p_key", "p_question", "p_options", "p_extra", "p_error")


def read_answers(text: str) -> list | None:
    """The array of records in a provider's text: bare, fenced, wrapped in an object, in prose, or cut off at its end; null if there is none."""
    body = re.sub(r"```(?:json)?", "", text).strip()
    for candidate in (body, (re.search(r"(?s)\[.*\]", body) or [""])[0]):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, list):
            return found
        if isinstance(found, dict):
            return next((found[k] for k in ("questions", "results", "data", "items", "mcqs") if isinstance(found.get(k), list)), None)
    start = body.find("[")
    if start < 0:
        return None
    out, decode, at = [], json.JSONDecoder().raw_decode, start + 1
    while m := re.compile(r"[\s,]*").match(body, at):
        try:
            value, at = decode(body, m.end())
        except ValueError:
            break
        out.append(value)
    return out or None
