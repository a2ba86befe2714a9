import os

import pytest

from inkwell.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")


def test_same_as_whole_texts(spark):
    whole = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.VOCABULARY), special_tokens={})
    texts = [None, "", " ", "\n\n  x\r\n", "It's 12 o'clock  now.", "né क्या 日本 👩‍👧 <|endoftext|>", "x" * 5_000, "ab " * 60_000, "a\u00a0\u2003b\tc   ", "It's 12 o'clock  now."]
    rows = [(i, t, "clash", [1]) for i, t in enumerate(texts)] + [(None, "null key", "", None), (3, "same key again", "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, ids array<int>")
    encoded = tokens.encode(df)
    want = sorted((str(i), whole.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in tokens.decode(encoded).collect()) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert tokens.encode(df.limit(0)).count() == 0
    for chars in (1, 4_000):  # a block per text, and blocks of some
        assert sorted((str(r.doc_id), r.ids) for r in tokens.encode(df, chars=chars).collect()) == want


def test_more_words_than_two_bytes(spark):
    text = " ".join(f"w{i}x" for i in range(70_000))
    whole = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.VOCABULARY), special_tokens={})
    got = tokens.encode(spark.createDataFrame([("a", text), ("b", "w1x w69999x")], "k string, t string"), "k", "t").collect()
    assert {r.doc_id: r.ids for r in got} == {"a": whole.encode_ordinary(text), "b": whole.encode_ordinary("w1x w69999x")}
