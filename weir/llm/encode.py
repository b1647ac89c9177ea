"""Problem 8: the whole corpus as ids of a public tokenizer.

Documents are cut into pre-tokens block by block: a block keeps, by position, the number of each pre-token among the
block's distinct ones, so that a word leaves a block once however often it stands there. The words of all blocks are
made distinct by one shuffle, each is encoded once, the ids are joined back to the blocks' words (spread over salts, as
common words are in every block), sorted by block and put together by position as they stream by, so that no task holds
more than a block. Decoding looks ids up in the table of the tokens' bytes.

Results: an empty and a null text have no ids (an empty list). Strings that look like special tokens are ordinary text.
A very long text is a block of its own. Repeated texts are encoded like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.tokens import NAME, SPLIT, encoder, token_bytes
from weir.session import cut, spread

#: Characters and documents a block has at most (but one document at least); blocks of one word that meet in one task, about.
BLOCK_CHARS, BLOCK_DOCS, TOGETHER = 400_000, 1000, 2000

#: A block's rows: one of code -1 with what it holds by position, and one for each of its distinct words.
BLOCK = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("word", pa.string()), ("data", pa.binary())])


def packed(docs: list[int], sizes: list[int], codes: list[int]) -> bytes:
    return np.array([len(docs), *docs], np.int64).tobytes() + np.array(sizes, np.int32).tobytes() + np.array(codes, np.int32).tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    rest = np.frombuffer(data, np.int32, offset=8 * (n + 1))
    return np.frombuffer(data, np.int64, n, 8), rest[:n], rest[n:]


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    docs: list[int] = []
    sizes: list[int] = []
    codes: list[int] = []
    of: dict[str, int] = {}
    chars = 0

    def full() -> pa.RecordBatch:
        n = len(of)
        columns = [np.full(n + 1, (task << 32) + number), np.arange(-1, n, dtype=np.int32), [None, *of], [packed(docs, sizes, codes), *[None] * n]]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, BLOCK.types, strict=True)], schema=BLOCK)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if docs and (chars + len(text) > BLOCK_CHARS or len(docs) >= BLOCK_DOCS):
                yield full()
                number += 1
                docs, sizes, codes, of, chars = [], [], [], {}, 0
            words = SPLIT.findall(text)
            codes += [of.setdefault(w, len(of)) for w in words]
            docs.append(doc)
            sizes.append(len(words))
            chars += len(text)
    if docs:
        yield full()


def encode_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str | None) -> Iterator[pa.RecordBatch]:
    encode = encoder(name, folder).encode_ordinary
    for batch in batches:
        ids = pa.array([encode(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["word", "ids"])


def put_together(data: bytes, flat: list[np.ndarray], sizes_of: list[np.ndarray]) -> pa.RecordBatch:
    """The documents of a block, with ids, out of the ids of its words in the order of their codes."""
    docs, sizes, codes = unpacked(data)
    if len(codes):
        every, each = np.concatenate(flat), np.concatenate(sizes_of)
        starts, lengths = (np.cumsum(each) - each)[codes], each[codes]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        ids = every[np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1])]
        offsets = bounds[np.concatenate([[0], np.cumsum(sizes)])]
    else:
        ids, offsets = np.zeros(0, np.int32), np.zeros(len(docs) + 1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])


def join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, code, ids, data) in the order of block and code, wherever batches end, to documents with ids."""
    data: bytes | None = None
    flat: list[np.ndarray] = []
    sizes_of: list[np.ndarray] = []
    for batch in batches:
        heads = np.flatnonzero(batch.column(1).to_numpy() < 0)
        for begin, end in zip([0, *heads], [*heads, batch.num_rows], strict=True):
            if begin < end and batch.column(1)[begin].as_py() < 0:
                if data is not None:
                    yield put_together(data, flat, sizes_of)
                data, flat, sizes_of = batch.column(3)[begin].as_py(), [], []
                begin += 1
            if begin < end:
                lists = batch.column(2).slice(begin, end - begin)
                flat.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
                sizes_of.append(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    if data is not None:
        yield put_together(data, flat, sizes_of)


def encoded(documents: DataFrame, name: str = NAME, folder: str | None = None) -> DataFrame:
    """Of rows (doc_id, text): (doc_id, ids)."""
    rows = cut(spread(documents.select("doc_id", "text")).mapInArrow(block_batches, "block long, code int, word string, data binary"))
    blocks, words = rows.filter("code < 0"), rows.filter("code >= 0").select("block", "code", "word")
    once = words.select("word").distinct().mapInArrow(lambda batches: encode_batches(batches, name, folder), "word string, ids array<int>")
    salts = -(-blocks.count() // TOGETHER)
    if salts > 1:  # a word stands in a block at most once, so parts of the blocks bound what meets of it; it is sent only to the parts it stands in
        words = words.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
        joined = words.join(words.select("word", "salt").distinct().join(once, "word"), ["word", "salt"])
    else:
        joined = words.join(once, "word")
    none = F.lit(None)
    both = joined.select("block", "code", "ids", none.cast("binary").alias("data")).unionByName(blocks.select("block", "code", none.cast("array<int>").alias("ids"), "data"))
    return both.repartition("block").sortWithinPartitions("block", "code").mapInArrow(join_batches, "doc_id long, ids array<int>")


def decode_batches(batches: Iterator[pa.RecordBatch], name: str, folder: str | None) -> Iterator[pa.RecordBatch]:
    table, begin = token_bytes(name, folder)
    for batch in batches:
        lists = batch.column(1)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = begin[ids + 1] - begin[ids]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        raw = table[np.repeat(begin[ids] - bounds[:-1], lengths) + np.arange(bounds[-1])].tobytes()
        edges = bounds[np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])


def decoded(ids: DataFrame, name: str = NAME, folder: str | None = None) -> DataFrame:
    """Of rows (doc_id, ids): (doc_id, decoded)."""
    return ids.select("doc_id", "ids").mapInArrow(lambda batches: decode_batches(batches, name, folder), "doc_id long, decoded string")
