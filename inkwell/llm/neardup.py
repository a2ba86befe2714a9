"""Near-duplicate records by circulant MinHash, banding and exact verification.

Two permutations of the feature space make every coordinate of a signature: the first scatters the features, the second,
shifted circularly by k, gives coordinate k. Records that agree in all rows of a band are candidates; the lowest bits of further
coordinates are a sketch of two longs, and candidates whose sketches differ in more bits than the likeness can explain
are dropped before anything is joined. What is left is compared exactly.
Records with the same set of words are one class, of which only the representative (the smallest id) is compared.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.joins import merged, spread_join
from inkwell.llm.markup import clean
from inkwell.llm.textform import consistent
from inkwell.session import checkpointed, once_per

SPACE = 1 << 20
SEED = 20_240_229
#: Misses 7 of 10 000 pairs at a likeness of 0.7, 6 of a million at 0.75; admits 1.8 % of pairs at 0.3.
ROWS, BANDS = 7, 84
#: Coordinates beyond the bands whose lowest bits are the sketch: two longs.
SKETCH = 128
#: Standard deviations that a pair's sketch may be off: 1 in 100 000 pairs at the threshold is.
SURE = 4.25
#: Rows of one bucket that are compared in one cell; larger buckets are split into blocks, and every pair of blocks is a cell.
CELL = 256
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text)


@functools.cache
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the other one continued by its own start so that a shift is an offset."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    scatter, other = rng.permutation(SPACE).astype(np.int64), rng.permutation(SPACE).astype(np.int32)
    return scatter, np.concatenate([other, other[:coordinates]])


def signatures(features: np.ndarray, starts: np.ndarray, coordinates: int = ROWS * BANDS) -> np.ndarray:
    """Circulant MinHash signatures of sets of 64-bit features, none of them empty: one row each. The sets lie one after another, each from its start."""
    scatter, other = permutations(coordinates)
    shifted = np.lib.stride_tricks.sliding_window_view(other, coordinates)
    out = np.empty((len(starts), coordinates), np.int32)
    at = scatter[features.view(np.uint64) % np.uint64(SPACE)]
    ends = [*starts[1:], len(features)]
    for k in range(0, len(starts), 64):  # bounds the gathered matrix
        low, high = starts[k], ends[min(k + 64, len(ends)) - 1]
        out[k : k + 64] = np.minimum.reduceat(shifted[at[low:high]], starts[k : k + 64] - low, axis=0)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    n, k = sig.shape
    bands = np.ascontiguousarray(sig).reshape(n, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(k // rows, dtype=np.uint64), (n, k // rows)).copy()
    for r in range(rows):
        key = (key ^ bands[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(coordinates: np.ndarray) -> np.ndarray:
    """The lowest bits of coordinates, 64 to a long."""
    return np.packbits((coordinates & 1).astype(np.uint8), axis=1).view(np.int64)


def most_different(likeness: float, bits: int = SKETCH, sure: float = SURE) -> int:
    """How many bits of two sketches may differ at that likeness: each differs with half the unlikeness."""
    p = (1 - likeness) / 2
    return min(bits, math.floor(bits * p + sure * math.sqrt(bits * p * (1 - p))))


def word_sets(records: DataFrame, key: str, texts: Column, least: int) -> DataFrame:
    """(id, n, same, features): the sorted 64-bit hashes of each record's different words, if it has at least so many, and a 128-bit digest of them all.

    texts is an array of strings, each without markup and in the consistent form after this; null elements are nothing.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = []
            for parts in b["texts"]:
                found: set[str] = set()
                for t in parts:
                    if t:
                        found.update(words(consistent(clean(t)).lower()))
                sets.append(np.sort(np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found)).view(np.int64)))
            out = pd.DataFrame({"id": b["id"], "n": [len(s) for s in sets], "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "features": sets})
            yield out[out["n"] >= least]

    return records.select(F.col(key).alias("id"), texts.alias("texts")).mapInPandas(read, "id bigint, n int, same binary, features array<bigint>")


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (id, n, features), and members (id, rep): records with the same features are one class."""
    reps = checkpointed(sets.groupBy("same", "n").agg(F.min(F.struct("id", "features")).alias("r")).select("r.id", "n", "r.features", "same"))
    members = merged(sets.select("id", "same", "n"), reps.select(F.col("id").alias("rep"), "same", "n"), ["same", "n"]).select("id", "rep")
    return reps.drop("same"), members


def signed(reps: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, n, s1, s2, keys): each representative's sketch and the keys of its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                held = b.column("features")
                ends = held.offsets.to_numpy()
                sig = signatures(held.values.to_numpy()[ends[0] : ends[-1]], ends[:-1] - ends[0], rows * bands + SKETCH)
                keys, sketch = band_keys(sig[:, : rows * bands], rows), sketches(sig[:, rows * bands :])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), lists], names=["id", "n", "s1", "s2", "keys"])

    return reps.filter("n > 0").select("id", "n", "features").mapInArrow(sign, "id bigint, n int, s1 bigint, s2 bigint, keys array<bigint>")


def candidates(reps: DataFrame, likeness: float, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(a, b), a < b: pairs that share a bucket and whose sizes and sketches allow the likeness. Every bucket is compared whole.

    Buckets are counted by partial aggregates; the rows of those with more than CELL are spread over cells before any
    bucket is gathered, so no task ever holds more than two blocks of one.
    """
    held = checkpointed(signed(reps, rows, bands))
    entries = held.select(F.explode("keys").alias("bucket"), "id", "n", "s1", "s2")
    hot = checkpointed(entries.groupBy("bucket").agg(F.count("*").alias("many")).filter(F.col("many") > CELL))
    row = F.struct("id", "n", "s1", "s2")
    x, y = F.col("x"), F.col("y")

    def compared(cells: DataFrame, apart: Column) -> DataFrame:
        both = cells.filter(F.size("xs") > 1).select("*", F.explode("xs").alias("x")).select("*", F.explode("xs").alias("y"))
        fair = (x["id"] < y["id"]) & (F.least(x["n"], y["n"]) >= likeness * F.greatest(x["n"], y["n"]))
        near = F.bit_count(x["s1"].bitwiseXOR(y["s1"])) + F.bit_count(x["s2"].bitwiseXOR(y["s2"])) <= most_different(likeness)
        return both.filter(fair & near & apart).select(x["id"].alias("a"), y["id"].alias("b"))

    if hot.isEmpty():
        return compared(entries.groupBy("bucket").agg(F.collect_list(row).alias("xs")), F.lit(True)).dropDuplicates()
    sized = spread_join(entries, hot, ["bucket"], ["id"])
    cold = sized.filter("many is null").groupBy("bucket").agg(F.collect_list(row).alias("xs"))
    blocks = F.ceil(F.col("many") / CELL).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    placed = sized.filter("many is not null").select("bucket", "id", "n", "s1", "s2", own.alias("own"), F.explode(cells).alias("cell"))
    met = placed.groupBy("bucket", "cell").agg(F.collect_list(F.struct("id", "n", "s1", "s2", "own")).alias("xs"))
    across = (F.col("cell.i") == F.col("cell.j")) | (x["own"] != y["own"])
    return compared(cold, F.lit(True)).unionByName(compared(met, across)).dropDuplicates()


def verified(pairs: DataFrame, reps: DataFrame, likeness: float) -> DataFrame:
    """(a, b, likeness): pairs whose exact Jaccard likeness reaches the threshold."""
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("features").alias(f"f_{s}"))
    both = merged(merged(pairs, side("a"), "a"), side("b"), "b")
    common = F.size(F.array_intersect("f_a", "f_b"))
    return both.select("a", "b", (common / (F.col("n_a") + F.col("n_b") - common)).alias("likeness")).filter(F.col("likeness") >= likeness)


def near_duplicates(sets: DataFrame, likeness: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, likeness) between representatives, and members (id, rep)."""
    sets = checkpointed(sets)
    reps, members = classes(sets)
    return verified(candidates(reps, likeness), reps, likeness), members


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of records, those of one class and those of linked classes."""
    m1, m2 = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    between = merged(merged(links.select("a", "b"), m1, "a"), m2, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    copies = members.filter("id <> rep")  # a class's other members; its representative comes from their rep
    with_rep = copies.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    among = merged(copies.select(F.col("id").alias("a"), "rep"), copies.select(F.col("id").alias("b"), "rep"), "rep").filter("a < b").select("a", "b")
    return between.unionByName(with_rep).unionByName(among)


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id, links): connected groups of near-duplicates, named by their smallest id, with the class's number of links; records without any are groups of their own."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpointed(edges)
    labels = checkpointed(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = merged(edges, labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        grown = merged(labels, near, "a").select("a", F.least("label", "seen").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        grown = checkpointed(merged(grown, jump, "next", "left").select("a", F.least("next", F.coalesce("far", "next")).alias("label"), "was"))
        labels = grown.select("a", "label")
        if grown.filter("label < was").isEmpty():
            break
    degree = edges.groupBy("a").agg(F.count("*").alias("links"))
    found = merged(labels, degree, "a").withColumnRenamed("a", "rep")
    return merged(members, found, "rep", "left").select("id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def with_rest(grouped: DataFrame, ids: DataFrame) -> DataFrame:
    """grouped with a row for every other id: a group of its own without links. Null ids give no row."""
    every = ids.select("id").filter("id is not null").distinct()
    return merged(every, grouped, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def question_sets(questions: DataFrame, least: int = 1) -> DataFrame:
    """Word sets of question records: question and all option values. Blank or null questions and null ids give no row; copies count once."""
    rows = questions.select("question_uid", "question", "options", "ingested_at").filter(F.col("question_uid").isNotNull() & F.col("question").rlike(r"\S"))
    rows = rows.withColumn("texts", F.concat(F.array("question"), F.coalesce(F.map_values("options"), F.array())))
    return word_sets(once_per(rows.select("question_uid", "texts", "ingested_at"), "question_uid", ["ingested_at", "texts"]), "question_uid", F.col("texts"), least)
