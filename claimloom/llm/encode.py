"""Encoding of a whole corpus with a public byte-level tokenizer, and back.

Texts are taken in blocks. A block numbers its distinct pre-tokens and keeps every text as the sequence of those
numbers, which states the pre-token at each position. The distinct pre-tokens of all blocks are shuffled by word, each
word of the corpus is encoded once, the ids are joined back to the blocks, and each block puts its texts together by
position. What is shuffled is one row per block and distinct word, and the packed number sequences. Words of very many
blocks come back from a broadcast list of bounded length, so that they don't meet in one task. Blocks have a bounded number of pre-tokens and of texts, so the work of one task is bounded too.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import dealt, stored

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: The vocabulary that ``byte_bpe_50k`` names.
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
#: Pre-tokens and texts of one block; a single longer text makes a block of its own.
BLOCK_WORDS, BLOCK_TEXTS = 1_000_000, 50_000
#: Blocks of a word beyond which it may be on the broadcast list, and the most words that the list holds. Of B blocks, a
#: word that isn't on it is in no more than ``HOT_BLOCKS`` or, with W words per block, B x W / ``HOT_WORDS`` of them.
HOT_BLOCKS, HOT_WORDS = 10_000, 20_000

# Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_PARTS = "_block long, _id {id}, _packed binary, _number int, _word string"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings are ordinary text here
    return tokenizer


class _Block:
    """Texts as sequences of word numbers, with the words in the order of their numbers."""

    def __init__(self, number: int, id_type: pa.DataType):
        self.number, self.id_type, self.size = number, id_type, 0
        self.ids: list = []
        self.packed: list[bytes] = []
        self.words: dict[str, int] = {}

    def add(self, key, text: str | None) -> None:
        found, words = SPLIT.findall(text) if text else [], self.words
        for w in found:
            if w not in words:
                words[w] = len(words)
        self.size += len(found)
        self.ids.append(key)
        self.packed.append(zlib.compress(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)).tobytes(), 1))

    def rows(self) -> pa.RecordBatch:
        n, m = len(self.ids), len(self.words)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.number] * (n + m), pa.int64()),
                pa.array(self.ids + [None] * m, self.id_type),
                pa.array(self.packed + [None] * m, pa.binary()),
                pa.array([None] * n + [*range(m)], pa.int32()),
                pa.array([None] * n + [*self.words], pa.string()),
            ],
            names=["_block", "_id", "_packed", "_number", "_word"],
        )


def _into_blocks(most_words: int, most_texts: int):
    def into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, block = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = block or _Block((task << 32) + k, batch.schema.field(0).type)
                block.add(key, text)
                if block.size >= most_words or len(block.ids) >= most_texts:
                    yield block.rows()
                    block, k = None, k + 1
        if block:
            yield block.rows()

    return into


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            words = batch.column(0)
            ids = [e.ids for e in tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], names=["_word", "_ids"])

    return encode


def _put_together(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The texts of one block as lists of ids; ``words`` has the ids of each of its word numbers."""
    lists = words.column("_ids").combine_chunks()
    size = np.zeros(len(lists), np.int64)
    number = words.column("_number").to_numpy()
    size[number] = pc.list_value_length(lists).to_numpy()
    at = np.zeros(len(lists), np.int64)
    at[number] = lists.offsets.to_numpy()[:-1]
    values = lists.values.to_numpy()
    out, ends, total = [], [0], 0
    for packed in texts.column("_packed").to_pylist():
        seq = np.frombuffer(zlib.decompress(packed), np.uint32)
        n = size[seq]
        length = int(n.sum())
        # The place of each id: the start of its word's ids, counted on within the word.
        first = np.repeat(at[seq] - (np.cumsum(n) - n), n)
        out.append(values[first + np.arange(length)] if length else values[:0])
        total += length
        ends.append(total)
    flat = np.concatenate(out) if out else values[:0]
    ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
    return pa.table([texts.column("_id"), ids], names=["_id", "ids"])


def encoded(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_column`` and ``ids`` of every row, without special tokens; an empty list for empty and null texts.

    Each input row gives one row, also where ids repeat or are null. Texts are split once; the blocks are stored, since
    both their words and their texts are read.
    """
    texts = dealt(documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")))
    id_type = texts.schema["_id"].dataType.simpleString()
    parts = stored(texts.mapInArrow(_into_blocks(BLOCK_WORDS, BLOCK_TEXTS), _PARTS.format(id=id_type)))
    words = parts.filter(F.col("_word").isNotNull()).select("_block", "_number", "_word")
    coded = "_word string, _ids array<int>"
    counted = words.groupBy("_word").agg(F.count(F.lit(1)).alias("_blocks"))
    known = counted.select("_word").mapInArrow(_encoder(vocabulary), coded)
    often = counted.filter(F.col("_blocks") > HOT_BLOCKS).orderBy(F.col("_blocks").desc(), "_word").limit(HOT_WORDS)
    tried = words.join(F.broadcast(often.select("_word").mapInArrow(_encoder(vocabulary), coded)), "_word", "left")
    numbered = tried.filter(F.col("_ids").isNotNull()).unionByName(tried.filter(F.col("_ids").isNull()).drop("_ids").join(known, "_word"))
    numbered = numbered.select(F.col("_block").alias("_of_block"), "_number", "_ids")
    kept = parts.filter(F.col("_packed").isNotNull()).select("_block", "_id", "_packed")
    # A block without any word has texts only; a full outer cogroup keeps it.
    together = kept.groupBy("_block").cogroup(numbered.groupBy("_of_block")).applyInArrow(_put_together, f"_id {id_type}, ids array<int>")
    return together.withColumnRenamed("_id", id_column)


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str = VOCABULARY) -> pa.Array:
    """The bytes of each token, by id: a table of fixed size (about 50,000 rows)."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    tokenizer = _tokenizer(vocabulary)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    table = {i: t.encode() if t in special else bytes(byte_of[c] for c in t) for t, i in tokenizer.get_vocab().items()}
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.binary())


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            lists = batch.column(1)
            lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
            parts = pc.take(table, pc.list_flatten(lists))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), b"")
            texts = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["_id", "text"])

    return decode


def decoded(ids: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_column`` and ``text`` of lists of ids: each id is joined with its bytes, which are put together in order.

    The table of token bytes has a fixed size, so every task joins against its own copy and nothing is shuffled. Bytes
    that are no UTF-8 decode to U+FFFD; null lists give empty texts.
    """
    rows = ids.select(F.col(id_column).alias("_id"), F.col(ids_column).alias("_ids"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, text string"
    return rows.mapInArrow(_decoder(vocabulary), schema).withColumnRenamed("_id", id_column)
