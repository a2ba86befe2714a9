"""Encoding of a corpus with a public byte-level BPE vocabulary through a table of distinct words.

Every text is split once. The texts of a task are taken in blocks of bounded size, and a text becomes a list of positions in the list of
its block's words. Each distinct word of the corpus is encoded once; its ids come back to the blocks that hold it, by a join, and to the
places in the texts by position. What is shuffled are the words per block and the positions, never the texts.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.joins import merged
from inkwell.session import checkpointed, shuffle_parts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's makers split text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
#: Characters of a block's texts; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20
#: Words in one row, so that no row is large.
WORDS_PER_ROW = 2048
#: Blocks in one partition where their ids are put in: some 20 MB, whatever the size of the corpus.
BLOCKS_PER_PART = 4


def split(text: str) -> list[str]:
    return _SPLIT.findall(text)


@functools.lru_cache(2)
def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def encoder(vocabulary: str):
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks(vocabulary), special_tokens={})


def encode_words(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, ids) of a table of distinct words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for b in batches:
            yield b.assign(ids=[enc.encode_ordinary(w) for w in b["word"]])

    return words.mapInPandas(run, "word string, ids array<int>")


class _Block:
    """The texts of one block: each as positions in the list of the block's words."""

    def __init__(self, blk: int):
        self.blk, self.place, self.chars = blk, {}, 0
        self.keys: list = []
        self.at: list[np.ndarray] = []

    def add(self, key, text: str | None) -> None:
        place = self.place
        self.keys.append(key)
        self.at.append(np.fromiter((place.setdefault(w, len(place)) for w in _SPLIT.findall(text)) if text else (), np.uint32))
        self.chars += len(text or "")

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        """A row for each text, and the words in rows of WORDS_PER_ROW; positions take two bytes where that is enough."""
        n, width, words = len(self.keys), np.uint16 if len(self.place) <= 1 << 16 else np.uint32, list(self.place)
        begins = range(0, max(len(words), 1), WORDS_PER_ROW)
        m = len(begins)
        columns = [
            pa.array([self.blk] * (n + m), pa.int64()),
            pa.array([*self.keys, *[None] * m], kind),
            pa.array([*(a.astype(width).tobytes() for a in self.at), *[None] * m], pa.binary()),
            pa.array([width is np.uint32] * (n + m), pa.bool_()),
            pa.array([None] * n + list(begins), pa.int32()),
            pa.array([None] * n + [words[k : k + WORDS_PER_ROW] for k in begins], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["blk", "doc_id", "at", "wide", "begin", "words"])


def placed_words(docs: DataFrame, key: str, text: str, chars: int = BLOCK_CHARS) -> DataFrame:
    """(blk, doc_id, at, wide, begin, words): each text as positions; and the words of each block from begin on, in rows in which at is null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block.keys and block.chars + len(t or "") > chars:
                    yield block.rows(b.schema.field(0).type)
                    number += 1
                    block = _Block(number)
                block.add(k, t)
            last = b.schema.field(0).type
        if block.keys:
            yield block.rows(last)

    return docs.select(key, text).mapInArrow(run, f"blk bigint, doc_id {kind}, at binary, wide boolean, begin int, words array<string>")


def _flat(held: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the length of each list."""
    lists = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def _put_back(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of each text of a block: those of its words, by position."""
    words = words.sort_by("pos")
    ids, lengths = _flat(words.column("ids"))
    begins = np.cumsum(lengths) - lengths
    at = [np.frombuffer(a, np.uint32 if w else np.uint16) for a, w in zip(texts.column("at").to_pylist(), texts.column("wide").to_pylist(), strict=True)]
    every = np.concatenate(at).astype(np.int64) if at else np.empty(0, np.int64)
    n = lengths[every]
    stops = np.cumsum(n)
    flat = ids[np.arange(stops[-1] if len(stops) else 0) + np.repeat(begins[every] - (stops - n), n)] if len(every) else np.empty(0, np.int32)
    ends = np.concatenate([[0], stops])[np.cumsum([0, *map(len, at)])]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
    return pa.table([texts.column("doc_id"), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids): the ids of each row's text. Null and empty texts have an empty list; repeated and null keys each keep their row; other columns are ignored."""
    cut = checkpointed(placed_words(docs, key, text, chars))
    per_block = cut.filter("words is not null").select("blk", "begin", "words")
    n = shuffle_parts(docs.sparkSession, per_block.filter("begin = 0").count(), BLOCKS_PER_PART)
    each = per_block.select("blk", "begin", F.posexplode("words").alias("k", "word")).select("blk", (F.col("begin") + F.col("k")).alias("pos"), "word")
    known = merged(each, encode_words(each.select("word").distinct(), vocabulary), "word").select(F.col("blk").alias("of_blk"), "pos", "ids")
    texts = cut.filter("at is not null").select("blk", "doc_id", "at", "wide").repartition(n, "blk")
    kind = docs.schema[key].dataType.simpleString()
    return texts.groupBy("blk").cogroup(known.repartition(n, "of_blk").groupBy("of_blk")).applyInArrow(_put_back, f"doc_id {kind}, ids array<int>")


def pieces(spark, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece): the vocabulary as a table; its size is that of the vocabulary file."""
    return spark.createDataFrame(pd.DataFrame([(i, p) for p, i in ranks(vocabulary).items()], columns=["id", "piece"]), "id int, piece binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): texts put together again through a join of ids with pieces; an empty list gives an empty text."""
    at = encoded.select("doc_id", F.monotonically_increasing_id().alias("row"), "ids")
    each = at.select("doc_id", "row", F.posexplode_outer("ids").alias("pos", "id"))
    got = each.join(F.broadcast(pieces(encoded.sparkSession, vocabulary)), "id", "left")  # bounded by the vocabulary
    whole = got.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("ps"))
    text = F.decode(F.unhex(F.array_join(F.transform("ps", lambda p: F.hex(p["piece"])), "")), "UTF-8")
    return whole.select("doc_id", text.alias("text"))
