import datetime as dt
import random

from inkwell.llm.neardup import candidates, expanded, groups, near_duplicates, question_sets, word_sets
from pyspark.sql import functions as F

SCHEMA = "question_uid bigint, question string, options map<string,string>, ingested_at timestamp, id int, n int"
T = dt.datetime(2024, 1, 1)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    rows, sets = [], {}
    for i in range(60):
        base = rng.sample(vocab, 45)
        for k in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            uid = i * 10 + k
            sets[uid] = set(w)
            cut = rng.randint(5, 40)
            rows.append((uid, "<b>" + " ".join(w[:cut]).upper() + "</b>", {"A": " ".join(w[cut:]), "B": None}, T, 0, 0))
    rows += [rows[0][:3] + (T.replace(day=5), 1, 1), (9001, None, {"A": "x"}, T, 0, 0), (9002, " ", None, T, 0, 0), (9003, "one", None, None, 0, 0), (None, "two", None, T, 0, 0)]
    links, members = near_duplicates(question_sets(spark.createDataFrame(rows, SCHEMA), 30), 0.7)
    got = {(r.a, r.b) for r in expanded(links, members).collect()}
    ok = {u for u, s in sets.items() if len(s) >= 30}
    want = {(a, b) for a in ok for b in ok if a < b and jaccard(sets[a], sets[b]) >= 0.7}
    assert got == want
    parent = {u: u for u in ok}

    def root(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in want:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {r.id: r.group_id for r in groups(links, members).collect()} == {u: root(u) for u in ok}


def test_hot_bucket_is_compared_whole(spark):
    n = 700  # more than one cell
    same = list(range(40))
    rows = [(i, 41, [*same, 1000 + i]) for i in range(n)]
    reps = spark.createDataFrame(rows, "id bigint, n int, features array<bigint>")
    assert candidates(reps, 0.7).count() == n * (n - 1) // 2


def test_copies_and_empty(spark):
    rows = [(i, "a b c d e", None, T, 0, 0) for i in range(50)]
    sets = question_sets(spark.createDataFrame(rows, SCHEMA))
    links, members = near_duplicates(sets)
    assert links.count() == 0 and members.select("rep").distinct().count() == 1
    assert groups(links, members).filter("group_id = 0").count() == 50
    none = spark.createDataFrame([], SCHEMA)
    links, members = near_duplicates(question_sets(none))
    assert expanded(links, members).count() == 0 and groups(links, members).count() == 0
    assert word_sets(none, "question_uid", F.array("question"), 0).count() == 0
