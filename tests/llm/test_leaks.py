import random
import time

from inkwell.llm.leaks import WINDOW, Items, distance, leaks, normal_words, piece_words


def plain_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, e in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != e)))
        prev = cur
    return min(prev)


def test_distance():
    rng = random.Random(1)
    for _ in range(2_000):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, 9))) for a in (1, 0))
        assert distance(p, t) == plain_distance(p, t)
    assert distance("x" * 200, "y" * 10 + "x" * 199) == 1


def test_against_brute(spark):
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in ("oro", "ilu", "ent", "ask")]
    items = [(f"e{i}", " ".join(rng.choice(vocab) for _ in range(rng.choice([12, 13, 20, 31]))), "x", 3) for i in range(12)]
    docs, n = [], 0
    for _ in range(300):
        item = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(item) - 5))
        part = item[a : a + rng.randint(5, 20)]
        if rng.random() < 0.6 and part:
            k = rng.randrange(len(part))
            part[k] = part[k][1:] if rng.random() < 0.5 else part[k] + "z"
        fill = [rng.choice(vocab) for _ in range(rng.randint(0, 20))]
        docs.append((n := n + 1, (" ".join(fill) + ", " + "; ".join(part).upper() + ". " + " ".join(fill)), "c", 1))
    docs += [(9001, None, "", 0), (9002, "", "", 0), (None, items[3][1], "", 0)]
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, run int")
    asked = spark.createDataFrame([*items, items[0], (None, "a", "", 0), ("e99", None, "", 0)], "item_id string, question string, text string, edits int")
    got = leaks(corpus, asked).collect()
    assert sorted(map(str, leaks(corpus, asked, most=3).collect())) == sorted(map(str, got))  # more items than one automaton holds: by the join
    exact, near = set(), set()
    for d, t, *_ in docs:
        w = normal_words(t or "")
        flat = " ".join(w)
        for i, q, *_ in items:
            x = q.split()
            windows = [" ".join(x[j : j + WINDOW]) for j in range(len(x) - WINDOW + 1)]
            if any(f" {v} " in f" {flat} " for v in windows):
                exact.add((d, i))
            if any(distance(v, flat) <= 1 for v in windows):
                near.add((d, i))
    assert {(r.doc_id, r.item_id) for r in got if r.run >= WINDOW} == exact
    found = {(r.doc_id, r.item_id) for r in got}
    assert exact <= found <= near and len(near - found) <= len(near) * 0.02  # a run cut inside its first or last word by the text's own words counts for the plain distance only
    assert piece_words(13, 1) == 4 and Items([("a", "one two")]).search("one two") == {}


def test_empty(spark):
    d, e = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id string, question string")
    assert leaks(d, e).count() == 0
    assert leaks(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), e).count() == 0


def test_lost_space_at_every_gap():
    item = [f"w{a}{b}" for a in "abcde" for b in "rstuvx"]
    items = Items([("a", " ".join(item))])
    for start in range(len(item) - WINDOW + 1):
        w = item[start : start + WINDOW]
        assert items.search(" ".join(["x", *w, "y"])) == {"a": (WINDOW, 0)}
        for gap in range(1, WINDOW):
            text = " ".join(["other", "words", *w[: gap - 1], w[gap - 1] + w[gap], *w[gap + 1 :], "and", "more"])
            assert items.search(text) == {"a": (max(gap - 1, WINDOW - gap - 1), 1)}, (start, gap)


def test_long_text_with_many_hits():
    item = [f"w{k}" for k in range(20)]
    items = Items([("a", " ".join(item))])
    text = (" ".join(item[:5]) + " x ") * 40_000 + " ".join(item)  # 200 000 words, a piece in every sixth
    begin = time.perf_counter()
    assert items.search(text) == {"a": (20, 0)}
    assert time.perf_counter() - begin < 20  # about a second where nothing else runs
