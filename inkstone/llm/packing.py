"""Packing of tokenised documents into fixed-length training sequences.

Each document is tokenised once. Whole sequences are cut from its front; what remains is one piece
that stays together. The pieces are dealt into randomised groups, and within a group first-fit
decreasing places them, finding the first sequence with room in a tournament tree of capacities.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkstone.llm.bpe import PATTERN, cuts_of, encoder
from inkstone.llm.common import Memo, map_arrow, slices, whole_text

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Ids:
    """Ids of a text as bytes, as the tokenizers library gives them without added special tokens.

    tiktoken applies the same merges several times faster. It is used where the file is a byte-level BPE
    whose ids follow the order of its merges, and for pieces that hold no special token's string.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        own = encoder(path)
        self.special = tuple(own.special)
        self.fast = None
        if np.all(np.diff(own.merged) > 0) and own.first.max() < own.merged[0]:
            ranks = {own.spelled(i): i for i in [*own.first.tolist(), *own.merged.tolist()]}
            self.fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.inner = Memo(lambda cut: self.bytes_of(" " + cut))

    def bytes_of(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = cuts_of(text)
        return b"".join([self.bytes_of(first), *map(self.inner.__getitem__, rest)])


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One of each worker, kept between tasks with what it has encoded."""
    return Ids(path)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, then the rest."""
    whole = total - total % capacity
    pieces = [(at, capacity) for at in range(0, whole, capacity)]
    return pieces + ([(whole, total - whole)] if whole < total else [])


def mixed(value: int) -> int:
    """A number below 2^62 that looks random but is the same when a lost task runs again."""
    value = (value + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    value = ((value ^ (value >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    value = ((value ^ (value >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return (value ^ (value >> 31)) >> 2


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, deal): the pieces of all documents, one tokenising pass.

    ``deal`` is a pseudo-random number of the piece. It depends on its content and on its place in the
    task, so that repeated rows are dealt apart and a repeated task gives the same numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = ids_of(path)
        end = int(end_id).to_bytes(4, "little")
        place = 0
        for batch in slices(batches):
            owner, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(coded(text) + end)
                total = len(ids) // 4
                for start, length in cut(total, capacity):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    place += 1
                    owner.append(k)
                    rows.append((start, length, crc, total, mixed(crc << 32 ^ place)))
            table = np.array(rows, dtype=np.int64).reshape(-1, 5)
            columns = [batch.column(0).take(pa.array(owner, type=pa.int64())), *(pa.array(table[:, c]) for c in range(5))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, {PIECE}, deal bigint")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first, each into the first bin with room.

    The leaves of the tree are the free room of the bins in order, an inner node is the larger of
    its children; going left whenever the left side has room finds the first bin that fits.
    """
    n = len(lengths)
    size = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[k]), 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[k], offsets[k] = node - size, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 1,
    group_docs: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A group holds about ``group_docs`` documents, whatever the size of the input, so a task's memory
    does not grow with it; the last sequences of a group are the only ones that stay half empty.
    A null text is empty and gives the end token alone; repeated rows are packed once each; an empty
    table gives no row. Only the two named columns are read.
    """
    groups = max(1, -(-docs.count() // group_docs))
    pieces = pieces_of(docs, path, capacity, end_id, id_col, text_col)
    kind = pieces.schema["id"].dataType.simpleString()

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "deal", "ids_crc32", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        out = rows[["id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"] = (int(key[0]) << 32) + bins
        out["offset"] = offsets
        return out

    dealt = pieces.withColumn("group", F.pmod(F.col("deal"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(place, f"id {kind}, {PIECE}, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("id", id_col)
