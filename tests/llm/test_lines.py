import datetime as dt
import random
import re
from collections import defaultdict

from inkwell.llm import joins
from inkwell.llm.lines import line_counts, lines_of, repeated, without
from inkwell.llm.textform import consistent

SCHEMA = "block_uid bigint, file_id bigint, site_id string, page int, text string, ingested_at timestamp, key string, n_files int"
T = dt.datetime(2024, 1, 1)


def key(line):
    return re.sub(r"\d+", "#", re.sub(r"\s+", " ", consistent(line).lower()).strip())


def brute(rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[5] or T)):
        first.setdefault(r[0] if r[0] is not None else r, r)
    files, pages, on, over, spots = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), []
    for uid, f, s, p, text, *_ in first.values():
        if f is not None:
            files[s or ""].add(f)
        if p is not None:
            pages[f].add(p)
        for i, line in enumerate(text.split("\n")) if text is not None else ():
            k = key(line)
            if k:
                if f is not None:
                    over[s or "", k].add(f)
                    if p is not None:
                        on[f, k].add(p)
                spots.append((uid, i, f, s or "", k))
    return {(u, i) for u, i, f, s, k in spots if (len(over[s, k]) >= 3 and len(over[s, k]) >= 0.2 * len(files[s])) or (f is not None and len(pages[f]) >= 5 and len(on[f, k]) >= 0.5 * len(pages[f]))}


def test_against_brute(spark):
    rng = random.Random(1)
    rows, uid = [], 0
    for f in range(60):
        for _ in range(rng.randint(1, 9)):
            uid += 1
            lines = [rng.choice(["Page 7", "ｐage  12 ", "Shared 3", "SHARED\u00a04", "", "  ", f"own {f}", rng.choice("abcdefgh")]) for _ in range(rng.randint(1, 4))]
            rows.append((uid, rng.choice([f, f, f, None]), rng.choice(["s1", None]) if f % 7 == 0 else f"s{f % 3}", rng.choice([None, 1, 2, 3, 4, 5, 6]), "\n".join(lines), T, "clash", 1))
    rows += [rows[0][:5] + (T.replace(day=3), "x", 2), (None, 1, "s1", 1, "Page 9", T, None, None), (None, 1, "s1", 1, "Page 9", T, None, None), (5000, 2, "s2", None, None, None, None, None), (5001, 2, "s2", 9, "", T, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = repeated(*lines_of(df), over="files")
    assert {tuple(r) for r in got.collect()} == brute(rows)
    text = {r.block_uid: r.text for r in without(df, got).collect()}
    assert text[5000] is None and text[5001] == ""
    gone = {u for u, _ in brute(rows)}
    for r in rows[:-5]:
        kept = [x for i, x in enumerate(r[4].split("\n")) if (r[0], i) not in brute(rows)] if r[0] in gone else None
        assert text[r[0]] == ("\n".join(kept) if kept is not None else r[4])


def test_clusters(spark):
    rows = [(i, i, "s", None, "same\nlines", T, "", 0) for i in range(6)] + [(9, 9, "s", None, "same", T.replace(day=2), "", 0)]
    over, _ = line_counts(*lines_of(spark.createDataFrame(rows, SCHEMA)))
    got = sorted((r.n_files, r.n_clusters, r.n_days, r.site_files, r.site_clusters, r.site_days) for r in over.collect())
    assert got == [(6, 1, 1, 7, 2, 2), (7, 2, 2, 7, 2, 2)]


def test_republished_article_stays_and_notice_goes(spark, monkeypatch):
    """Ten copies of an article on ten days are one cluster; the notice below twenty different texts is boilerplate. A line of one day's edition is none."""
    article = "Found again\nthe same article\nNotice 1"
    rows = [(i, i, "s", None, article, T.replace(day=1 + i), "", 0) for i in range(10)]
    rows += [(100 + i, 100 + i, "s", None, f"own text {chr(97 + i)}\nNotice {i}\n" + ("Edition of the day" if i < 8 else "no edition " + chr(97 + i)), T.replace(day=1 if i < 8 else 2 + i), "", 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    text = {r.block_uid: r.text for r in without(df, repeated(*lines_of(df))).collect()}
    assert all(text[i] == "Found again\nthe same article" for i in range(10))
    assert text[100] == "own text a\nEdition of the day" and text[115] == "own text p\nno edition p"
    by_files = {r.block_uid: r.text for r in without(df, repeated(*lines_of(df), over="files")).collect()}
    assert by_files[0] == "" and by_files[100] == "own text a"  # where files are counted, copies are repeated lines
    monkeypatch.setattr(joins, "small", lambda *_: False)
    assert {r.block_uid: r.text for r in without(df, repeated(*lines_of(df))).collect()} == text


def test_empty(spark):
    assert repeated(*lines_of(spark.createDataFrame([], SCHEMA))).count() == 0
