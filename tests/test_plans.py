import pandas as pd

from inkwell.plans import text


def height(t, width, size):
    if not t:
        return 0.35
    per = max(35, int(width / (size * 0.0085)))
    return max(0.35, sum(max(1, -(-len(x.strip()) // per)) for x in t.split("\n")) * size * 0.0185)


def stored(tmp_path, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_heights_of_every_question(spark, sf, tmp_path):
    odd = ["", " ", "é" * 79, "a\n\n" + "𝒙" * 157, "\u00a0\u2003" + "ж" * 78 + "\u3000", "a\r\nb", "plain"]
    df = spark.createDataFrame([*enumerate(odd), (90, None), (None, "x")], "question_uid bigint, question string")
    got = {r.question_uid: r.height for r in text.q_content_height(spark, stored(tmp_path, questions=df)).collect()}
    assert got == {i: round(height(t, 12.0, 18), 6) for i, t in enumerate(odd)}
    q = pd.read_parquet(f"{sf}/questions.parquet").dropna(subset=["question_uid", "question"]).groupby("question_uid")["question"].min()
    got = {r.question_uid: r.height for r in text.q_content_height(spark, sf).collect()}
    assert got == {u: round(height(t, 12.0, 18), 6) for u, t in q.items()}


def fits(o):
    values = [(o.get(c) or "").strip() for c in "ABCD"]
    return all(v and len(v) <= 32 and height(v, 2.6, 16) <= 0.75 for v in values)


def test_fits_of_all_options(spark, sf, tmp_path):
    four = {"A": "1", "B": "2", "C": "3", "D": "4"}
    odd = [four, four | {"A": "a\nb"}, four | {"A": "a\nb\nc"}, four | {"B": "é" * 32}, four | {"B": "é" * 33}, four | {"C": "\u00a0\u2003"}, four | {"D": "\u3000ж\n"}, four | {"D": None}, {"A": "ж"}, {}]
    df = spark.createDataFrame([*enumerate(odd), (90, None), (None, four)], "question_uid bigint, options map<string,string>")
    got = {r.question_uid: r.fits for r in text.q_fit_1x4(spark, stored(tmp_path, questions=df)).collect()}
    assert got == {i: fits(o) for i, o in enumerate(odd)} and [got[1], got[2]] == [True, False]
    q = pd.read_parquet(f"{sf}/questions.parquet").dropna(subset=["question_uid", "options"]).drop_duplicates("question_uid")
    got = {r.question_uid: r.fits for r in text.q_fit_1x4(spark, sf).collect()}
    assert got == {u: fits(dict(o)) for u, o in zip(q["question_uid"], q["options"], strict=True)}
