import json
import random
import re
import time

import pytest

from inkwell.llm import joins, markup
from inkwell.llm.markup import Node, aligned_nodes, clean, count_markup, match, parse, read_skeleton, skeleton

PLAIN = ["p<q and r>s.", "x < 9 and y > 9.", "R&D.", "run_id_9.", "n_9 and n_9.", "set {x, y}.", r"C:\runs\b7.", "5 * 3 * 2.", "|x - 3| < 2", r"$\frac{89t}{s + 29}$ and $|q|<3$", "closest to ______ .", "[IMG: figs/img_rId7.png]", "[2019M]", "50% ~ 60%", "9^9 #9. a/b", "Papers | practice set 1", "<9.", ""]
MARKED = [("<p>(A) x</p>", "(A) x"), ("a<br/>\nb", "a\nb"), ("<!-- pg 4 -->x", "x"), ("x&alpha; y", "xα y"), ("# Problem 17\nx", "Problem 17\nx"), ("***a b***", "a b"), ("_a b_", "a b"), ("`x y`", "x y"), ("```\nfor k:\n    t += k\n```", "for k:\n    t += k"), ("[t](https://b/q)", "t"), ("![f](figs/f.png) z", "z"), ("[[a|b c]]", "b c"), ("{{ref|75}} x", "x"), ("''it''", "it"), ("== Task 3 ==\nx", "Task 3\nx"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a\tb\n1\t2"), ("> q", "q"), ("\\section*{Item 70}\nx", "Item 70\nx"), (r"\emph{a b} c", "a b c"), ("\\begin{itemize}\n\\item h\n\\item f 50\n\\end{itemize}", "• h\n• f 50"), (r"\[ E = 48 \]", "$E = 48$"), (r"in\cite{r7} pel", "in pel"), ("~~a~~", "a"), ("<FONT>only ~~the</FONT> of~~ it", "only the of it"), ("$a &lt; b$", "$a < b$"), ("so [[m|on [the way]] of](https://b/q) x", "so [m|on [the way]] of x")]
SCHEMA = "host string, table_name string, record_id bigint, field string, value string, wrapper string, n_markup string"


@pytest.mark.parametrize("s", PLAIN)
def test_plain(s):
    assert clean(s) == s and count_markup(parse(s)) == 0


@pytest.mark.parametrize(("s", "want"), MARKED)
def test_marked(s, want):
    assert count_markup(parse(s)) > 0 and clean(s) == want
    assert markup._MAYBE.search(s)


def brute_match(a, b):
    if not a or not b:
        return 0
    best = max(brute_match(a[:-1], b), brute_match(a, b[:-1]))
    if a[-1].label == b[-1].label:
        best = max(best, brute_match(a[:-1], b[:-1]) + 1 + brute_match(a[-1].children, b[-1].children))
    return best


def test_tree_matching():
    shapes = ["p(#,b(#),#)", "div(p(#),ul(li(#),li(#)))", "div(ul(li(#),li(#,b(#)),li(#)))", "p(#),p(#)", "#"]
    for a in shapes:
        assert skeleton(read_skeleton(a)) == a
        for b in shapes:
            x, y = read_skeleton(a), read_skeleton(b)
            assert match(x, y)[0] == brute_match(x, y)


def test_wrapper(spark):
    rows = [("h", "document_blocks", i, "text", f"<div><p>Shared notice</p><p>own text {i * i}</p></div>", "c", "d") for i in range(12)]
    rows += [("h", "document_blocks", 90, "text", "no markup", "c", None), ("h", "document_blocks", 91, "text", None, None, None), (None, "questions", None, "question", "", None, None), (None, "questions", 5, "question", "<b>x", None, None)]
    rows += rows[:2]
    out = {(r.table_name, r.record_id): r for r in markup.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["document_blocks", 3].clean_text == "own text 9" and out["document_blocks", 3].template_text == "Shared notice"
    assert out["document_blocks", 90].clean_text == "no markup" and out["document_blocks", 90].n_markup == 0
    assert out["questions", None].clean_text == "" and out["questions", 5].clean_text == "x" and len(out) == 15
    assert json.loads(out["questions", 5].structure) == []
    assert markup.cleaned(spark.createDataFrame([], SCHEMA)).count() == 0


def deep(opening, n=10_000, closing="", inside="x"):
    return opening * n + inside + closing * n


@pytest.mark.parametrize(("s", "want", "n"), [
    (deep("<b>"), "x", 10_000), (deep("<li>", inside="y"), "\n".join(["• "] * 9_999 + ["• y"]), 10_000), (deep(r"\textbf{", closing="}"), "x", 10_000), (deep("<div>", closing="</div>"), "x", 10_000),
    (deep("\\begin{itemize}\\item ", closing="\\end{itemize}"), "\n".join(["• "] * 9_999 + ["• x"]), 20_000), (deep("<b>", closing="</i>"), "x", 20_000), ("<code>a<b>b</b></code> c", "ab c", 2),
])
def test_deep(s, want, n):
    start = time.perf_counter()
    assert clean(s) == want and count_markup(parse(s)) == n
    tree = skeleton(parse(s))
    assert match(parse(s), read_skeleton(tree))[0] == len(re.findall("[^(),]+", tree))
    assert time.perf_counter() - start < 20  # under two seconds where nothing else runs


UNCLOSED = [r"\textbf{ ", r"\begin{a} ", r"\( ", r"\[ ", "<!-- ", "**x ", "***x ", "__a ", "~~a ", "[", "[IMG: ", "[http://x ", "\\a[", "''", "'''a ", "$ a ", "`a\n", "|a", '<a x="', "[a](b ", "{{a ", "[[a ", "<b ", " ", "\n", ":", "-", "# ", "==", "> ", "\\", "_a", "*a", "&a"]


@pytest.mark.parametrize("opener", UNCLOSED)
def test_a_megabyte_of_unclosed_openers(opener):
    s = "start " + opener * (1_000_000 // len(opener)) + " end"
    begin = time.perf_counter()
    text = clean(s)
    assert time.perf_counter() - begin < 20  # two seconds or less where nothing else runs
    assert text.startswith("start") and text.endswith("end")


def test_same_matching_whatever_the_ends():
    """Matching with equal ends taken at once is as large as the matching by the plain recurrence."""
    rng = random.Random(8)

    def tree(d):
        return [Node(rng.choice("ab#"), "", tree(d - 1) if d and rng.random() < 0.6 else []) for _ in range(rng.randint(0, 3))]

    for _ in range(300):
        x, y = tree(2), tree(2)
        size, pairs = match(x, y)
        assert size == brute_match(x, y) == len(list(aligned_nodes(x, pairs)))


def test_hot_class_without_broadcast(spark, monkeypatch):
    """A class that has all rows is spread by a salt where the wrappers are too many to be broadcast; the result is the same."""
    rows = [("h", "document_blocks", i, "text", f"<p>notice</p><p>{i}</p>", "", "") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, markup.cleaned(df).collect()))
    monkeypatch.setattr(joins, "small", lambda *_: False)
    assert sorted(map(tuple, markup.cleaned(df).collect())) == want and all(r[7] == "notice" and r[4] == 2 for r in want)
