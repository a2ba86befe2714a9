"""Long spans that stand verbatim in more than one text, by suffix automata of reference shards.

Anchors tell where a text may share anything: of the hashes of all K-grams in each stretch of LENGTH characters the least is
an anchor, so two texts with a common span of LENGTH characters have an anchor inside it in common. Texts that are equal are one
class, of which only the smallest id is compared.

How much of each text is shared (coverage, removed): the stretch around an anchor that holds every span of LENGTH characters with the
anchor in it is its context. Equal contexts are one, known with the smallest and the largest id. The others go to shards of
at most about SHARD characters, all contexts of one anchor to the same; in a shard they make one suffix
automaton, through which each is streamed for its matching statistics with the contexts of other ids. So no text is ever paired with another, and what
all texts share costs each of them once.

Which texts share a span (pairs): the stretches around shared anchors (zones) are cut into shards of at most SHARD characters, and
the zones of every text with a common anchor are streamed through the automaton of a shard. The pairs are the result, so their number is its size.

An automaton takes 42 bytes for each character, in arrays of states and of edges; only the few states near the root have dictionaries.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.joins import merged, spread_join
from inkwell.llm.neardup import expanded
from inkwell.session import checkpointed, shuffle_parts

LENGTH = 250
K = 64
CELL = 256
#: Texts streamed through one copy of an automaton; more are spread over several.
PARTNERS = 64
#: States of so few characters keep their edges in dictionaries.
NEAR = 4
#: Characters of a reference shard: some 15 MB as an automaton.
SHARD = 1 << 18


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-gram; k is a power of two, and the hash is put together from halves."""
    h = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    m, p = 1, 0x9E3779B97F4A7C15
    while m < k:
        h = h[:-m] * np.uint64(p) + h[m:]
        p = p * p & (1 << 64) - 1
        m *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m, r = 1, h
    while m * 2 <= w:
        r = np.minimum(r[:-m], r[m:])
        m *= 2
    return np.minimum(r[: len(r) - (w - m)], r[w - m :]) if m < w else r


def anchors(text: str, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions): each chosen hash at every place where it stands; nothing for texts shorter than length."""
    c = codes(text)
    if len(c) < length:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h = gram_hashes(c, k)
    least = sliding_min(h, length - k + 1)
    chosen = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
    low = h <= chosen.max()
    at = np.flatnonzero(low)
    at = at[np.isin(h[at], chosen)]
    return h[at].view(np.int64), at.astype(np.int32)


def zones(positions: np.ndarray, n: int, length: int = LENGTH, k: int = K) -> list[tuple[int, int]]:
    """The stretches around shared anchors; every shared span lies in one of them."""
    out: list[list[int]] = []
    for p in np.sort(positions).tolist():
        a, b = max(0, p - (length - k)), min(n, p + length)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= length]


class SuffixAutomaton:
    """All substrings of the given texts; built character by character, a fresh start for each text.

    The edges of a state are a linked list in arrays (character, target, next edge). States of at most NEAR characters have many
    edges and are few, so theirs are dictionaries. Loops are written out, since every character goes through them.
    """

    def __init__(self, texts: list[str] = ()):  # type: ignore[assignment]
        self.near: dict[int, dict[int, int]] = {0: {}}
        self.link, self.length, self.head = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.char, self.to, self.after = array("I"), array("i"), array("i")
        for t in texts:
            self.add(t)

    def add(self, text: str) -> list[int]:
        """The states of the text's prefixes."""
        near, link, length, head, char, to, after = self.near, self.link, self.length, self.head, self.char, self.to, self.after
        states = []
        last = 0
        for c in map(ord, text):
            edges = near.get(last)
            if edges is None:
                e = head[last]
                while e >= 0 and char[e] != c:
                    e = after[e]
                known = to[e] if e >= 0 else -1
            else:
                known = edges.get(c, -1)
            if known >= 0:  # this text's prefix is there already
                last = known if length[known] == length[last] + 1 else self._split(last, c, known)
                states.append(last)
                continue
            new = self._state(length[last] + 1, 0)
            p, q = last, -1
            while p >= 0:
                edges = near.get(p)
                if edges is None:
                    e = head[p]
                    while e >= 0 and char[e] != c:
                        e = after[e]
                    if e >= 0:
                        q = to[e]
                        break
                    char.append(c)
                    to.append(new)
                    after.append(head[p])
                    head[p] = len(char) - 1
                else:
                    q = edges.get(c, -1)
                    if q >= 0:
                        break
                    edges[c] = new
                p = link[p]
            if p >= 0:
                link[new] = q if length[p] + 1 == length[q] else self._split(p, c, q)
            last = new
            states.append(last)
        return states

    def _state(self, length: int, link: int) -> int:
        state = len(self.link)
        self.length.append(length)
        self.link.append(link)
        self.head.append(-1)
        if length <= NEAR:
            self.near[state] = {}
        return state

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the shorter strings of q, which takes q's place behind p and p's suffixes."""
        near, link, head, char, to, after = self.near, self.link, self.head, self.char, self.to, self.after
        clone = self._state(self.length[p] + 1, link[q])
        edges, own = near.get(q), near.get(clone)
        if edges is None:
            edges, e = {}, head[q]
            while e >= 0:
                edges[char[e]] = to[e]
                e = after[e]
        if own is None:
            for d, target in edges.items():
                char.append(d)
                to.append(target)
                after.append(head[clone])
                head[clone] = len(char) - 1
        else:
            own.update(edges)
        link[q] = clone
        while p >= 0:
            edges = near.get(p)
            if edges is None:
                e = head[p]
                while e >= 0 and char[e] != c:
                    e = after[e]
                if e < 0 or to[e] != q:
                    break
                to[e] = clone
            elif edges.get(c) == q:
                edges[c] = clone
            else:
                break
            p = link[p]
        return clone

    def spans(self, text: str, least: int, rank: array | None = None, below: int = 0) -> list[tuple[int, int]]:
        """Maximal stretches (from, to) of the text, of at least that length, that are substrings; none lies inside another. With rank, only states of a rank below the given one count."""
        near, link, length, head, char, to, after = self.near, self.link, self.length, self.head, self.char, self.to, self.after
        out: list[tuple[int, int]] = []
        state = run = 0
        for i, c in enumerate(map(ord, text)):
            whole = run
            while True:
                edges = near.get(state)
                if edges is None:
                    e = head[state]
                    while e >= 0 and char[e] != c:
                        e = after[e]
                    there = to[e] if e >= 0 else -1
                else:
                    there = edges.get(c, -1)
                if there >= 0 and (rank is None or rank[there] < below):
                    state = there
                    run += 1
                    break
                if not state:
                    run = 0
                    break
                state = link[state]
                run = length[state]
            if whole >= least and run <= whole:
                out.append((i - whole, i))
        if run >= least:
            out.append((len(text) - run, len(text)))
        return out

    def least_ranks(self, ranks: array) -> array:
        """For each state the least of its own rank and those of the states whose suffix it is."""
        link = self.link
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[:0:-1].tolist():
            up = link[s]
            if ranks[s] < ranks[up]:
                ranks[up] = ranks[s]
        return ranks


def classes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, rep): texts of at least length characters that are equal are one class."""
    keyed = docs.filter(F.length("text") >= length).select(F.col("doc_id").alias("id"), F.unhex(F.md5("text")).alias("same"), F.length("text").alias("n"))
    reps = keyed.groupBy("same", "n").agg(F.min("id").alias("rep"))
    return merged(keyed, reps, ["same", "n"]).select("id", "rep")


def shared_anchors(docs: DataFrame, members: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, id, positions, many): anchors that occur in more than one class, with the representatives that hold them and their number.

    Anchors are counted by a partial aggregate; rows of an anchor that many hold are spread by a salt for the join.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, hashes, places = [], [], []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                h, at = anchors(t, length)
                ids.append(np.full(len(h), i, np.int64))
                hashes.append(h)
                places.append(at)
            if ids:
                yield pd.DataFrame({"id": np.concatenate(ids), "anchor": np.concatenate(hashes), "at": np.concatenate(places)})

    found = docs.filter(F.length("text") >= length).select("doc_id", "text").mapInPandas(read, "id bigint, anchor bigint, at int")
    several = members.filter("id <> rep").select("id")
    found = checkpointed(merged(found, several, "id", "left_anti").groupBy("anchor", "id").agg(F.collect_list("at").alias("positions")))
    counted = checkpointed(found.groupBy("anchor").agg(F.count("*").alias("many")).filter("many > 1"))
    return spread_join(found, counted, ["anchor"], ["id"]).filter("many is not null")


def partners(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: representatives with a common anchor. Anchors that many hold are split into blocks, and every pair of blocks is met."""
    blocks = F.ceil(F.col("many") / CELL).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    placed = shared.select("anchor", "id", own.alias("own"), F.explode(cells).alias("cell"))
    held = placed.groupBy("anchor", "cell").agg(F.collect_list(F.struct("id", "own")).alias("xs"))
    pairs = held.select("cell", "xs", F.explode("xs").alias("x")).select("cell", "x", F.explode("xs").alias("y"))
    across = (F.col("cell.i") == F.col("cell.j")) | (F.col("x.own") != F.col("y.own"))
    return pairs.filter((F.col("x.id") < F.col("y.id")) & across).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).dropDuplicates()


def shards(zones_: list[tuple[int, int]], text: str, length: int, most: int) -> list[list[tuple[int, str]]]:
    """The zones of a text as (from, stretch) in shards of at most so many characters; what is cut overlaps, so that every span of length characters is in one of them whole."""
    out: list[list[tuple[int, str]]] = [[]]
    room = most
    for a, b in zones_:
        while True:
            end = min(b, a + max(room, length))
            out[-1].append((a, text[a:end]))
            room -= end - a
            if room <= 0:
                out.append([])
                room = most
            if end == b:
                break
            a = end - length + 1
    return [x for x in out if x]


def zone_texts(docs: DataFrame, shared: DataFrame, length: int = LENGTH, most: int = SHARD) -> DataFrame:
    """(id, shard, froms, pieces): the zones of each representative with any shared anchor, in shards."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, p, t in zip(b["id"], b["positions"], b["text"], strict=True):
                for n, held in enumerate(shards(zones(np.asarray(p), len(t), length), t, length, most)):
                    rows.append((i, n, [a for a, _ in held], [x for _, x in held]))
            yield pd.DataFrame(rows, columns=["id", "shard", "froms", "pieces"])

    return _with_positions(docs, shared).mapInPandas(cut, "id bigint, shard int, froms array<int>, pieces array<string>")


def _with_positions(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, text, positions): representatives with the places of their shared anchors."""
    at = shared.groupBy("id").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    return merged(docs.select(F.col("doc_id").alias("id"), "text"), at, "id")


def _known(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").filter("text is not null and doc_id is not null")


def linked(docs: DataFrame, length: int = LENGTH, most: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), a < b, between representatives that share a span of at least length characters, and members (id, rep).

    docs needs doc_id (unique) and text; other columns are ignored. Null texts and texts shorter than length share nothing.
    """
    docs = _known(docs)
    members = checkpointed(classes(docs, length))
    shared = checkpointed(shared_anchors(docs, members, length))
    pieces = checkpointed(zone_texts(docs, shared, length, most))
    pairs = checkpointed(partners(shared))
    crowds = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("crowds")).filter("crowds > 1"))
    pairs = spread_join(pairs, crowds, ["a"], ["b"]).select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("crowds", F.lit(1))).alias("crowd"))
    met = merged(pairs, pieces.select(F.col("id").alias("b"), F.col("pieces").alias("streamed")), "b")
    met = merged(met, pieces.select(F.col("id").alias("a"), "shard", F.col("pieces").alias("held")), "a")
    met = met.repartition(shuffle_parts(docs.sparkSession), "a", "shard", "crowd").sortWithinPartitions("a", "shard", "crowd")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, automaton = None, SuffixAutomaton()
        for batch in batches:
            rows = []
            for a, shard, b, held, streamed in zip(batch["a"], batch["shard"], batch["b"], batch["held"], batch["streamed"], strict=True):
                if (a, shard) != last:
                    last, automaton = (a, shard), SuffixAutomaton(list(held))
                if any(automaton.spans(t, length) for t in streamed):
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"])

    return met.mapInPandas(stream, "a bigint, b bigint").dropDuplicates(), members


def pairs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(a, b), a < b: texts with a common span of at least length characters."""
    return expanded(*linked(docs, length))


def contexts(docs: DataFrame, shared: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(anchor, same, id, froms, context): the stretch around each shared anchor, once for each text however often it stands there; same is its digest."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, held in zip(b["id"], b["text"], b["held"], strict=True):
                own: dict[tuple[int, bytes], list] = {}
                for x in held:
                    for p in x["positions"]:
                        a = max(0, p - (length - k))
                        c = t[a : p + length]
                        if len(c) >= length:
                            own.setdefault((x["anchor"], xxhash.xxh3_128_digest(c.encode("utf-8", "surrogatepass"))), [[], c])[0].append(a)
                rows += [(anchor, same, i, froms, c) for (anchor, same), (froms, c) in own.items()]
            yield pd.DataFrame(rows, columns=["anchor", "same", "id", "froms", "context"])

    at = shared.groupBy("id").agg(F.collect_list(F.struct("anchor", "positions")).alias("held"))
    texts = merged(docs.select(F.col("doc_id").alias("id"), "text"), at, "id")
    return texts.mapInPandas(cut, "anchor bigint, same binary, id bigint, froms array<int>, context string")


def sharded(distinct: DataFrame, length: int = LENGTH, most: int = SHARD) -> DataFrame:
    """distinct contexts with the shard where each is read: anchors are spread over shards of about most characters; the contexts of an anchor
    that has more than fill one are split into blocks, and each pair of blocks is a shard. Anchors with one context only are left out."""
    whole = distinct.agg(F.coalesce(F.sum(F.length("context")), F.lit(0))).first()[0]
    n = max(1, -(-whole // most))
    size = max(1, most // (2 * length))  # contexts of a block
    counted = checkpointed(distinct.groupBy("anchor").agg(F.count("*").alias("many")).filter("many > 1"))
    held = spread_join(distinct, counted, ["anchor"], ["same"]).filter("many is not null")
    blocks = F.ceil(F.col("many") / size).cast("int")
    own = F.pmod(F.xxhash64("same"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.xxhash64("anchor", F.least(own, j), F.greatest(own, j)))
    few = F.array(F.pmod(F.xxhash64("anchor"), F.lit(n)))  # a cell's hash that meets one of these numbers only makes a shard larger
    return held.select("anchor", "same", "lo", "hi", "context", F.explode(F.when(blocks == 1, few).otherwise(cells)).alias("shard"))


def read_shard(rows: list[tuple[int, int, str]], length: int = LENGTH) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """For each (lo, hi, context) of a shard its spans that stand in a context of a smaller lo, and those that stand in one of a larger hi.

    One automaton holds the whole shard. Each of its states knows the least lo (and the largest hi) of the contexts it stands in, and a context is
    streamed through the states whose least lo is below its own; so it is never held against itself, nor against others of the same text.
    """
    automaton = SuffixAutomaton()
    states = [automaton.add(c) for _, _, c in rows]
    sides = []
    for ids in ([lo for lo, _, _ in rows], [-hi for _, hi, _ in rows]):
        ranks = array("q", [(1 << 63) - 1]) * len(automaton.link)
        for own, path in zip(ids, states, strict=True):
            for state in path:
                if own < ranks[state]:
                    ranks[state] = own
        automaton.least_ranks(ranks)
        sides.append([automaton.spans(c, length, ranks, own) for own, (_, _, c) in zip(ids, rows, strict=True)])
    return sides[0], sides[1]


_SPANS = "array<struct<from:int,to:int>>"


def shared_spans(docs: DataFrame, length: int = LENGTH, most: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(id, earlier, anywhere): the stretches of each representative that spans shared with a smaller id cover, and those that spans shared with any cover, in order of place; and members (id, rep).

    docs needs doc_id (unique) and text; other columns are ignored. Null texts and texts shorter than length share nothing. Positions are code points.
    """
    docs = _known(docs)
    members = checkpointed(classes(docs, length))
    found = checkpointed(contexts(docs, shared_anchors(docs, members, length), length))
    distinct = checkpointed(found.groupBy("anchor", "same").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("context").alias("context")))
    placed = sharded(distinct, length, most).repartition(shuffle_parts(docs.sparkSession), "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[tuple]) -> pa.RecordBatch:
            sides = read_shard([(lo, hi, c) for _, _, lo, hi, c in held], length)
            lists = [pa.array([[{"from": a, "to": b} for a, b in spans] for spans in side], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))) for side in sides]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary()), *lists], names=["anchor", "same", "before", "behind"])

        last, held = None, []
        for b in batches:
            for shard, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "anchor", "same", "lo", "hi", "context")), strict=True):
                if shard != last and held:
                    yield done(held)
                    held = []
                last = shard
                held.append(tuple(row))
        if held:
            yield done(held)

    read = placed.mapInArrow(run, f"anchor bigint, same binary, before {_SPANS}, behind {_SPANS}")
    read = read.groupBy("anchor", "same").agg(F.flatten(F.collect_list("before")).alias("before"), F.flatten(F.collect_list("behind")).alias("behind"))
    known = checkpointed(merged(distinct.select("anchor", "same", "lo", "hi", F.length("context").alias("n")), read, ["anchor", "same"], "left").filter("lo < hi or size(before) > 0 or size(behind) > 0"))
    each = spread_join(found.select("anchor", "same", "id", "froms"), known, ["anchor", "same"], ["id"]).filter("lo is not null")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to")))
    none = F.array().cast(_SPANS)

    def at_places(spans):
        return F.flatten(F.transform("froms", lambda a: F.transform(spans, lambda x: F.struct((a + x["from"]).alias("from"), (a + x["to"]).alias("to")))))

    earlier = F.when(F.col("id") > F.col("lo"), whole).otherwise(F.coalesce("before", none))
    later = F.when(F.col("id") < F.col("hi"), whole).otherwise(F.coalesce("behind", none))
    spans = each.select("id", at_places(earlier).alias("earlier"), at_places(later).alias("later"))
    gathered = spans.groupBy("id").agg(F.flatten(F.collect_list("earlier")).alias("earlier"), F.flatten(F.collect_list("later")).alias("later"))

    def union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sides = [[[(x["from"], x["to"]) for x in held] for held in b[c]] for c in ("earlier", "later")]
            both = [joined(x + y) for x, y in zip(*sides, strict=True)]
            yield pd.DataFrame({"id": b["id"], "earlier": [[{"from": x, "to": y} for x, y in joined(e)] for e in sides[0]], "anywhere": [[{"from": x, "to": y} for x, y in s] for s in both]})

    return gathered.mapInPandas(union, f"id bigint, earlier {_SPANS}, anywhere {_SPANS}"), members


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of place, with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def coverage(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_chars, copies, spans, shared_chars, shared): one row per text with an id, however much of it stands elsewhere.

    copies counts the other texts that are equal; spans are the stretches of the text every part of which lies in a shared span, in
    order of place. Null and empty texts have 0 characters and share 0.
    """
    found, members = shared_spans(docs, length)
    own = found.select(F.col("id").alias("rep"), F.col("anywhere").alias("spans"))
    size = members.groupBy("rep").agg((F.count("*") - 1).alias("copies"))
    per = merged(merged(members, size, "rep"), own, "rep", "left").select(F.col("id").alias("doc_id"), "copies", "spans")
    every = merged(docs.filter("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")), per, "doc_id", "left")
    every = every.withColumn("copies", F.coalesce("copies", F.lit(0))).withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    sizes = F.aggregate("spans", F.lit(0), lambda n, x: n + x["to"] - x["from"])
    every = every.withColumn("shared_chars", F.when(F.col("copies") > 0, F.col("n_chars")).otherwise(sizes))
    return every.withColumn("shared", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text): texts without the spans they share with a text of a smaller id; equal texts stay only with the smallest id, the others are empty. Null texts stay null."""
    found, members = shared_spans(docs, length)
    cuts = found.select(F.col("id").alias("rep"), F.col("earlier").alias("spans"))
    per = merged(members, cuts, "rep", "left").select(F.col("id").alias("doc_id"), (F.col("id") != F.col("rep")).alias("copy"), "spans")
    joined = merged(docs.select("doc_id", "text"), per, "doc_id", "left")
    # what stands before, between and behind the spans
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["to"]))
    ends = F.concat(F.transform("spans", lambda x: x["from"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring("text", a + 1, b - a)), "")
    return joined.select("doc_id", F.when(F.col("copy"), "").when(F.coalesce(F.size("spans"), F.lit(0)) <= 0, F.col("text")).otherwise(kept).alias("text"))
