import random

from inkwell.llm import joins, spans
from inkwell.llm.spans import SuffixAutomaton, anchors, coverage, linked, pairs, read_shard, removed, shared_spans, shards

SCHEMA = "doc_id bigint, text string, id int, a string"


def longest(a, b):
    """Length of the longest common substring."""
    best, prev = 0, [0] * (len(b) + 1)
    for c in a:
        cur = [0]
        for j, e in enumerate(b):
            cur.append(prev[j] + 1 if c == e else 0)
        best = max(best, *cur)
        prev = cur
    return best


def test_automaton():
    rng = random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 3))]
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        inside = lambda s: any(s in x for x in texts)  # noqa: B023, E731
        for least in (1, 2, 3):
            all_ = {(i, j) for i in range(len(t)) for j in range(i + least, len(t) + 1) if inside(t[i:j])}
            maximal = {(i, j) for i, j in all_ if (i - 1, j) not in all_ and (i, j + 1) not in all_}
            assert set(SuffixAutomaton(texts).spans(t, least)) == maximal, (texts, t, least)


def make(rng, n):
    return "".join(rng.choice("abcdefgh éß日😀\n") for _ in range(n))


def test_against_brute(spark):
    rng = random.Random(4)
    shared = [make(rng, 700) for _ in range(6)]
    docs = []
    for i in range(40):
        s = rng.choice(shared)
        n = rng.choice([249, 250, 251, 300, 600])
        at = rng.randint(0, 700 - n)
        docs.append((i, make(rng, rng.randint(0, 200)) + s[at : at + n] + make(rng, rng.randint(0, 200)), 1, "x"))
    docs += [(100, docs[3][1], 0, ""), (101, docs[3][1], 0, ""), (102, None, 0, ""), (103, "", 0, ""), (104, "x" * 900, 0, ""), (105, "x" * 400, 0, ""), (106, "short", 0, ""), (107, "short", 0, ""), (None, docs[3][1], 0, "")]
    df = spark.createDataFrame(docs, SCHEMA)
    known = [(d, t) for d, t, *_ in docs if d is not None and t]
    want = {(a, b) for a, s in known for b, t in known if a < b and len(s) >= 250 and len(t) >= 250 and longest(s, t) >= 250}
    assert {tuple(r) for r in pairs(df).collect()} == want
    cover = {r.doc_id: r for r in coverage(df).collect()}
    linked = {x for p in want for x in p}
    for d, t in known:
        assert (cover[d].shared_chars > 0) == (d in linked)
    assert cover[102].n_chars == 0 and cover[103].shared == 0 and cover[3].copies == 2 and cover[3].shared == 1
    text = {r.doc_id: r.text for r in removed(df).collect()}
    assert text[100] == "" and text[102] is None and text[106] == "short" and text[104] == "x" * 900 and text[105] == ""
    for (_, b) in want:
        assert len(text[b]) < len(dict(known)[b])


def test_hot_anchor_and_empty(spark):
    rng = random.Random(9)
    core = make(rng, 300)
    df = spark.createDataFrame([(i, make(rng, 30) + core + make(rng, 30), 0, "") for i in range(300)], SCHEMA)
    assert pairs(df).count() == 300 * 299 // 2
    assert pairs(df.limit(0)).count() == 0 and coverage(df.limit(0)).count() == 0
    for one in (shared_spans, linked):
        found, members = one(df.limit(1))
        assert found.count() == 0 and members.count() == 1
    cover = coverage(df).collect()
    assert len(cover) == 300 and all(300 <= r.shared_chars <= 310 and len(r.spans) == 1 for r in cover)  # some share characters beside the core too
    left = {r.doc_id: r.text for r in removed(df).collect()}
    assert len(left[0]) == 360 and all(len(left[i]) <= 60 for i in range(1, 300))
    assert len(anchors("x" * 249)[0]) == 0


def covered(text, others, length=250):
    """The places of a text that lie in a span of that length which one of the others holds."""
    out = set()
    for i in range(len(text) - length + 1):
        if any(text[i : i + length] in o for o in others):
            out |= set(range(i, i + length))
    return out


def test_coverage_and_removal_against_brute(spark, monkeypatch):
    """Also where shards are small, so that an anchor's contexts are split into blocks, and where nothing is broadcast."""
    rng = random.Random(12)
    parts = [make(rng, 300) for _ in range(3)]
    docs = [(i, "".join(rng.choice([*parts, make(rng, rng.randint(1, 60)), parts[0][: rng.randint(250, 300)], parts[1][rng.randint(0, 50) :]]) for _ in range(rng.randint(1, 5))), 0, "") for i in range(24)]
    docs += [(50, "ab" * 400, 0, ""), (51, "ab" * 200, 0, ""), (52, docs[2][1], 0, "")]
    df = spark.createDataFrame(docs, SCHEMA)
    text = {d: t for d, t, *_ in docs}

    def check():
        cover = {r.doc_id: r for r in coverage(df).collect()}
        left = {r.doc_id: r.text for r in removed(df).collect()}
        for d, t in text.items():
            others = [o for e, o in text.items() if e != d]
            assert {p for x in cover[d].spans for p in range(x["from"], x["to"])} == covered(t, [o for o in others if o != t]), d
            assert cover[d].shared_chars == len(covered(t, others)) or t in others
            gone = covered(t, [o for e, o in text.items() if e < d])
            assert left[d] == ("" if any(o == t for e, o in text.items() if e < d) and len(t) >= 250 else "".join(c for i, c in enumerate(t) if i not in gone)), d
        want = {(a, b) for a, s in text.items() for b, t in text.items() if a < b and longest(s, t) >= 250}
        assert {tuple(r) for r in spans.pairs(df).collect()} == want

    check()
    monkeypatch.setattr(joins, "small", lambda *_: False)
    for f in (spans.sharded, spans.zone_texts):
        monkeypatch.setattr(spans, f.__name__, lambda *a, f=f, **k: f(*a[:2], most=600))
    check()


def test_shards():
    text = "".join(chr(65 + i % 26) for i in range(1_000))
    for most in (20, 100, 333, 5_000):
        got = shards([(10, 300), (400, 420), (500, 1_000)], text, 15, most)
        assert all(text[a : a + len(x)] == x for held in got for a, x in held) and all(sum(len(x) for _, x in held) <= most + 15 for held in got)
        for a, b in ((10, 300), (400, 420), (500, 1_000)):
            for i in range(a, b - 14):
                assert any(f <= i and i + 15 <= f + len(x) for held in got for f, x in held)
    assert read_shard([(1, 1, "abcdef"), (1, 1, "bcdefg"), (2, 3, "xbcdex")], 3) == ([[], [], [(1, 5)]], [[(1, 5)], [(0, 4)], []])
    assert read_shard([], 3) == ([], [])
