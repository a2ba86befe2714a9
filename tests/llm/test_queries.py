import datetime as dt

from inkwell.llm import queries

T = dt.datetime(2024, 1, 1)


def test_groups_have_every_question(spark, tmp_path):
    rows = [
        (1, "What is the mass of one mole?", {"A": "x"}, T), (2, "what is the MASS of one mole", {"A": "X"}, T), (3, "Quite another thing", None, T), (1, "What is the mass of one mole?", {"A": "x"}, T.replace(day=2)),
        (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", {}, T), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9", {}, T), (6, None, {"A": "x"}, T), (7, " ", None, T), (8, "?!", None, T), (9, "...", {"A": None}, T), (None, "two", None, T),
    ]
    df = spark.createDataFrame(rows, "question_uid bigint, question string, options map<string,string>, ingested_at timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/questions.parquet")
    got = sorted((r.question_uid, r.group_id, r.links) for r in queries.p1_groups(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0)]
