"""Held-out items inside corpus texts, by pigeonhole edit matching.

A leak is a run of window consecutive words of an item that stands in a text with at most budget edits (of characters). The
item's words are taken in pieces that begin at every word. An edit spoils two neighbouring words at most (a lost space joins
them), so the rest of a window holds a run of words that no edit touched; pieces are no longer than that run, and one of
them stands in the text exactly. Where a piece is hit, the windows around it are verified with Myers' bit-parallel edit distance.

Up to ITEMS_PER_PASS items go to the workers as one automaton, so the corpus is read once and nothing of it is shuffled. More
items than that stay a table: texts and items meet by a join on the pieces' hashes, and only then are verified.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.joins import merged
from inkwell.llm.textform import consistent

WINDOW = 13
BUDGET = 1
#: The most items that one automaton holds; no more are ever brought to the driver.
ITEMS_PER_PASS = 20_000
_WORD = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    return _WORD.findall(consistent(text).lower())


def piece_words(window: int, budget: int) -> int:
    """The longest piece of which any window of an item holds budget + 1, wherever it begins."""
    size = (window + 1) // (budget + 2)
    if size < 1:
        raise ValueError(f"a window of {window} words can't be cut for {budget} edits")
    return size


def intact_words(window: int, budget: int) -> int:
    """The least length of a window's longest run of words that no edit touches: an edit spoils two words at most."""
    return -(-(window - 2 * budget) // (budget + 1))


def piece_size(window: int, budget: int) -> int:
    return max(1, min(piece_words(window, budget), intact_words(window, budget)))


def distance(pattern: str, text: str) -> int:
    """The least edit distance of the pattern to any part of the text: Myers' bit-vectors, a big integer a column."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may begin anywhere
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best = score
    return best


def verify(item: list[str], found: list[str], spots: set[tuple[int, int]], window: int, budget: int) -> tuple[int, int] | None:
    """(longest run of the item's consecutive words in the text, least edit distance of one of its windows), or None if none is within the budget.

    spots are the piece hits, as (word of the text, word of the item). Every hit is widened to the run of equal words around it, each run
    once; the windows over the longest runs are verified first, and none after one without an edit.
    """
    n, longest = len(item), 0
    ends: dict[int, int] = {}  # by diagonal, where the last run on it ended
    runs = []
    for word, at in sorted(spots):
        shift = word - at
        if ends.get(shift, -1) > at:
            continue  # inside a run that is known
        a, b = at, at
        while a > 0 and a + shift > 0 and item[a - 1] == found[a - 1 + shift]:
            a -= 1
        while b < n and b + shift < len(found) and item[b] == found[b + shift]:
            b += 1
        ends[shift] = b
        longest = max(longest, b - a)
        runs.append((b - a, a, b, shift))
    least = None
    whole = intact_words(window, budget)
    for length, a, b, shift in sorted(runs, reverse=True):
        if length < whole or least == 0:
            break
        # over a run of a whole window any one inside it will do; else every window that the run lies in
        starts = [a] if length >= window else range(max(0, b - window), min(a, n - window) + 1)
        for start in starts:
            low = max(0, start + shift - budget - 1)
            d = distance(" ".join(item[start : start + window]), " ".join(found[low : start + shift + window + budget + 1]))
            if d <= budget and (least is None or d < least):
                least = d
    return None if least is None else (longest, least)


class Items:
    """The items' pieces in one automaton."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, budget: int = BUDGET):
        self.window, self.budget, self.size = window, budget, piece_size(window, budget)
        self.words = {i: w for i, q in items if q and len(w := normal_words(q)) >= window}
        places: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for i, w in self.words.items():
            for at in range(len(w) - self.size + 1):
                places[" " + " ".join(w[at : at + self.size]) + " "].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def search(self, text: str) -> dict[str, tuple[int, int]]:
        """item -> (longest run of its consecutive words in the text, least edit distance of one of its windows), of the items within budget."""
        if not self.words or not text:
            return {}
        found = normal_words(text)
        if len(found) < self.window - self.budget:
            return {}
        spots: dict[str, set[tuple[int, int]]] = defaultdict(set)
        begins: list[int] = []
        for end, (length, where) in self.automaton.iter(f" {' '.join(found)} "):
            if not begins:
                at = 0
                for w in found:
                    begins.append(at)
                    at += len(w) + 1
            word = bisect_right(begins, end - length + 1) - 1
            for item, at in where:
                spots[item].add((word, at))
        hits = {item: verify(self.words[item], found, s, self.window, self.budget) for item, s in spots.items()}
        return {item: hit for item, hit in hits.items() if hit}


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET, most: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id, run, edits): texts that hold a window of an item's words with at most budget edits; one row per pair.

    docs: doc_id and text; items: item_id and question; other columns are ignored. Null and empty texts hold nothing,
    items shorter than the window are found nowhere, repeated items count once. Up to most items are one automaton, more
    are joined by their pieces; both ways find the same.
    """
    known = items.select("item_id", "question").filter("item_id is not null and question is not null").distinct()
    rows = [(r["item_id"], r["question"]) for r in known.limit(most + 1).collect()]
    texts = docs.select("doc_id", "text").filter("text is not null")
    found = _by_automaton(texts, rows, window, budget) if len(rows) <= most else _by_join(texts, known, window, budget)
    return found.dropDuplicates(["doc_id", "item_id"])


_FOUND = "doc_id bigint, item_id string, run int, edits int"


def _by_automaton(texts: DataFrame, rows: list[tuple[str, str]], window: int, budget: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(shared.value, window, budget)
        for b in batches:
            hits = [(d, i, *v) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, v in items.search(t).items()]
            yield pd.DataFrame(hits, columns=["doc_id", "item_id", "run", "edits"])

    return texts.mapInPandas(run, _FOUND)


def _by_join(texts: DataFrame, items: DataFrame, window: int, budget: int) -> DataFrame:
    size = piece_size(window, budget)

    def pieces(key: str, kind: str, text: str):
        """(key, piece): the hashes of the different pieces of each text."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sets = []
                for t in b[text]:
                    w = normal_words(t)
                    sets.append(sorted({xxhash.xxh64_intdigest(" ".join(w[k : k + size])) - (1 << 63) for k in range(len(w) - size + 1)}) if len(w) >= window - budget else [])
                yield pd.DataFrame({key: b[key], "piece": sets}).explode("piece").dropna(subset=["piece"]).astype({"piece": "int64"})

        return run, f"{key} {kind}, piece bigint"

    texts = texts.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5("text"))))  # a null id can't be joined
    of_items = items.mapInPandas(*pieces("item_id", "string", "question"))
    of_texts = texts.mapInPandas(*pieces("key", "string", "text"))
    met = merged(of_texts, of_items, "piece").select("key", "item_id").distinct()
    both = merged(merged(met, items, "item_id"), texts, "key")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, *v) for d, i, q, t in zip(b["doc_id"], b["item_id"], b["question"], b["text"], strict=True) for v in Items([(i, q)], window, budget).search(t).values()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "edits"])

    return both.select("doc_id", "item_id", "question", "text").mapInPandas(check, _FOUND)
