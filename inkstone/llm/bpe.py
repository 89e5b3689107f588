"""Byte-level BPE: encoding by batched merge rounds in numpy, and decoding.

A text is cut at single spaces that no pre-token can cross, so the same unit is encoded once per
worker and then looked up. The units that a worker has not met are merged together: the symbols
of all their pre-tokens lie in one flat array, and each round merges the pair of lowest rank of
every pre-token. Ranks are found by binary search in the sorted keys of the merge list.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from inkstone.llm.common import Cached, map_arrow, slices, whole_text

#: Fixed value: the pre-token pattern of the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1 << 40)
CRAMPED = re.compile(r"\s\s")
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in printable}
    spare = iter(range(256, 512))
    return [letters[b] if b in letters else chr(next(spare)) for b in range(256)]


def cuts_of(text: str) -> list[str]:
    """Pieces of a text between the single spaces that no pre-token crosses; each but the first starts with that space.

    The space lies between two other characters. The pattern joins it to what follows, never to what
    precedes, and what precedes ends in no space.
    """
    if CRAMPED.search(text) or text[:1].isspace() or text[-1:].isspace():
        return INNER_SPACE.split(text)
    return text.split(" ")


def units_of(text: str) -> list[str]:
    """The pieces with their spaces, each encoded by itself."""
    if not text:
        return []
    first, *rest = cuts_of(text)
    return [first, *map(" ".__add__, rest)]


class Encoder:
    """Encodes and decodes as the tokenizers library does for a byte-level BPE file without a normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.lengths = np.array([len(s) for s in spelled], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def spelled(self, i: int) -> bytes:
        return self.letters[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def rank(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol; NO_RANK at the end of a word or if it doesn't merge."""
        key = (symbols << 32) | np.append(symbols[1:], 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & ~last, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word). Words are not empty."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        while len(symbols):
            last = np.append(word[1:] != word[:-1], True)
            starts = np.flatnonzero(np.append(True, last[:-1]))
            rank = self.rank(symbols, last)
            lowest = np.minimum.reduceat(rank, starts)
            spread = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            open_ = spread < NO_RANK
            done_ids.append(symbols[~open_])
            done_words.append(word[~open_])
            symbols, word, rank, spread = symbols[open_], word[open_], rank[open_], spread[open_]
            if not len(symbols):
                break
            hit = rank == spread
            # in a run of the same overlapping pair every second one merges, from the left
            at = np.arange(len(hit))
            begins = hit & ~np.append(False, hit[:-1] & (word[1:] == word[:-1]))
            run = np.maximum.accumulate(np.where(begins, at, 0))
            hit &= (at - run) % 2 == 0
            symbols = np.where(hit, self.merged[np.where(hit, rank, 0)], symbols)
            keep = ~np.append(False, hit[:-1])
            symbols, word = symbols[keep], word[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each unit."""
        words: dict[str, int] = {}
        parts: list[list[int]] = []  # word numbers, or -1 - id of a special token
        for unit in units:
            own = []
            pieces = self.special_cut.split(unit) if self.special_cut else [unit]
            for piece in pieces:
                if piece in self.special:
                    own.append(-1 - self.special[piece])
                else:
                    own += [words.setdefault(w, len(words)) for w in self.pattern.findall(piece)]
            parts.append(own)
        coded: list[bytes] = []
        if words:
            ids, counts = self.merge([w.encode() for w in words])
            flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            coded = [flat[a:b] for a, b in zip([0, *ends], ends)]
        return [b"".join(coded[p] if p >= 0 else (-1 - p).to_bytes(4, "little") for p in own) for own in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        if not len(ids):
            return ""
        sizes = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.letters[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def cache_of(path: str) -> Cached:
    """Ids of units as bytes and as comma-joined text, kept by each worker between tasks."""
    own = encoder(path)

    def compute(units: list[str]) -> list[tuple[bytes, str]]:
        return [(b, ",".join(map(str, np.frombuffer(b, dtype="<u4").tolist()))) for b in own.encode_units(units)]

    return Cached(compute)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, as ``tokenizers`` encodes without added special tokens.

    A null text counts as empty and gives no ids; repeated rows give repeated rows; columns other
    than the two are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(path)
        for batch in slices(batches):
            units = [units_of(t) for t in batch.column(1).to_pylist()]
            known = cache.ready(units)
            ids = [np.frombuffer(b"".join([known[u][0] for u in us]), dtype="<u4").astype(np.int32) for us in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every array of ids. A null or empty array gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches):
            texts = [own.decode(np.array(i or [], dtype=np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["id", "text"])

    picked = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    out = map_arrow(picked, run, f"id {picked.schema['id'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), F.col("text"))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode every text in one pass, keep digests.

    ``encode`` and ``decode`` composed, without writing the ids out. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = encoder(path), cache_of(path)
        for batch in slices(batches):
            units = [units_of(t) for t in batch.column(1).to_pylist()]
            known = cache.ready(units)
            counts, written, decoded = [], [], []
            for us in units:
                found = [known[u] for u in us]
                ids = np.frombuffer(b"".join([f[0] for f in found]), dtype="<u4")
                counts.append(len(ids))
                written.append(hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, type=pa.int64()), pa.array(written, type=pa.string()), pa.array(decoded, type=pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = map_arrow(rows, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
