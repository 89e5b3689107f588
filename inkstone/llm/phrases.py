"""Phrase collocations of two to four words, counted in a dictionary of distinct chunks.

Texts are parsed into content-triggered chunks (``parsing``); equal chunks become one row with the number
of their occurrences, and everything after that reads the chunks. Phrases are counted level by level: a phrase
can be frequent only if both its parts one word shorter are. Frequent words get numbers, chunks are rewritten in
these, and a phrase is the pair of its first words' number and its last word's number, which is exact; frequent pairs get numbers in turn.

Words are counted by two hashes, and only frequent ones are spelled out. The tables of numbers are broadcast up to ``NUMBERED``
words and twice as many phrases of a length. Where a level has more, phrases are counted as texts, thinned by bitmaps of the
frequent shorter ones, which get coarser at their bound. Both ways give the same counts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkstone.llm.common import map_arrow, short_batches, slices, whole_text
from inkstone.llm.parsing import OVERLAP, Tokens, chunks, mixed, stream
from inkstone.session import cut_lineage, use_checkpoints

LONGEST = OVERLAP + 1
#: Bytes of chunks that a task looks at together.
STEP = 2 << 20
#: Bitmaps of up to so many bytes are broadcast; more frequent phrases share the same bits and thin less.
BITMAP_BYTES = 32 << 20
BITS_PER_KEY, PROBES = 32, 3
#: Bits of a part of a bitmap, which one task fills.
PART_BITS = 20
#: Frequent words up to which they are numbered in a broadcast table of 16 bytes a row; phrases of one length take 8 bytes and go up to twice that.
NUMBERED = 8_000_000
#: Distinct phrases that a task counts before it hands its counts on.
HELD = 200_000


def dictionary(docs: DataFrame, modulus: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, n): the distinct chunks of each language and how often they occur; a null language is ``und``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            langs = batch.column(0).to_pylist()
            streams = [stream(t) for t in batch.column(1).to_pylist()]
            own = [k for k, s in enumerate(streams) if s]
            seen: dict[tuple[str, bytes], int] = {}
            for k, chunk in chunks([streams[k] for k in own], modulus):
                key = langs[own[k]], chunk
                seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in seen], type=pa.string()), pa.array([c for _, c in seen], type=pa.binary()).cast(pa.string()), pa.array(list(seen.values()), type=pa.int64())],
                names=["lang", "chunk", "n"],
            )

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    return map_arrow(rows, parse, "lang string, chunk string, n bigint").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def written(parsed: DataFrame) -> DataFrame:
    """The table as compressed files below the checkpoint folder, which all levels read."""
    spark = parsed.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/chunks-{uuid.uuid4().hex}"
    parsed.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


class Block:
    """Some chunks with their weights, and the phrases that start in their own part."""

    def __init__(self, langs: list[str], texts: list[str], weights: list[int]):
        self.tokens = Tokens(" ".join(texts).encode())
        self.names = sorted(set(langs))
        number = {name: k for k, name in enumerate(self.names)}
        sizes = np.fromiter((t.count(" ") + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.lang = np.repeat(np.fromiter((number[x] for x in langs), dtype=np.int64, count=len(langs)), sizes)
        self.weight = np.repeat(np.array(weights, dtype=np.int64), sizes)
        salt = np.array([int.from_bytes(name.encode().ljust(8, b"\0")[:8]) ^ (len(name.encode()) << 56) for name in self.names], dtype=np.uint64)
        own = np.ones(len(self.tokens), dtype=bool)
        ends = np.cumsum(sizes)
        for back in range(1, OVERLAP + 1):
            own[ends - back] = False
        self.first = mixed(self.tokens.hash ^ mixed(salt)[self.lang])
        # starts[k] and hashes[k]: phrases of k + 1 words that no bitmap has ruled out
        self.starts = [np.flatnonzero(own & self.tokens.word)]
        self.hashes = [self.first[self.starts[0]]]

    def lengthen(self, allowed: Bitmap | None) -> None:
        """Phrases of one more word whose two parts are allowed."""
        starts, hashes = self.starts[-1], self.hashes[-1]
        size = len(self.starts)
        if allowed is not None:
            held = allowed.has(hashes)
            starts, hashes = starts[held], hashes[held]
            # a part that starts in the shared window belongs to the next chunk; its words are here all the same
            second = starts + 1
            inner = self._hash(second, size)
            held = self.tokens.word[starts + size] & allowed.has(inner)
        else:
            held = self.tokens.word[starts + size]
        starts, hashes = starts[held], hashes[held]
        self.starts.append(starts)
        self.hashes.append(mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + self.first[starts + size]))

    def _hash(self, at: np.ndarray, size: int) -> np.ndarray:
        h = self.first[at]
        for k in range(1, size):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + self.first[np.minimum(at + k, len(self.first) - 1)])
        return h


class Bitmap:
    """A Bloom filter of the hashes of frequent phrases of one length; with 32 bits a key it lets some one in a thousand others through.

    The first bits of a hash choose the part that holds all its bits, so that parts are filled apart from each other.
    """

    def __init__(self, keys: int):
        self.width = max(10, min(math.ceil(math.log2(max(1, keys) * BITS_PER_KEY)), int(math.log2(BITMAP_BYTES * 8))))
        self.inner = min(self.width, PART_BITS)
        self.bits = np.zeros(1 << self.width - 3, dtype=np.uint8)

    def part(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(1) >> np.uint64(63 - self.width + self.inner)).astype(np.int64)

    def place(self, h: np.ndarray, probe: int) -> np.ndarray:
        """Of the bit in its part."""
        return (mixed(h + np.uint64(probe)) >> np.uint64(64 - self.inner)).astype(np.int64)

    def filled(self, h: np.ndarray) -> bytes:
        """A part with the bits of hashes that belong to it."""
        bits = np.zeros(1 << self.inner, dtype=bool)
        for probe in range(PROBES):
            bits[self.place(h, probe)] = True
        return np.packbits(bits).tobytes()

    def add(self, part: int, filled: bytes) -> None:
        own = np.frombuffer(filled, dtype=np.uint8)
        self.bits[part * len(own) : (part + 1) * len(own)] |= own

    def has(self, h: np.ndarray) -> np.ndarray:
        held = np.arange(len(h))
        for probe in range(PROBES):
            at = (self.part(h[held]) << self.inner) + self.place(h[held], probe)
            held = held[(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
        out = np.zeros(len(h), dtype=bool)
        out[held] = True
        return out


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, chunk, n) in steps of about ``STEP`` bytes, whatever the size of the batches."""
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= STEP:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for step in steps(batches):
        yield Block(*(c.to_pylist() for c in step.columns))


def hash_counts(parsed: DataFrame, size: int, allowed: list) -> DataFrame:
    """(h, n): occurrences of hashes of phrases of ``size`` words, of those whose parts the bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for k in range(size - 1):
                block.lengthen(allowed[k] and allowed[k].value)
            h, weight = block.hashes[-1], block.weight[block.starts[-1]]
            order = np.argsort(h)
            h, weight = h[order], weight[order]
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, dtype=np.int64)
            n = np.add.reduceat(weight, starts) if len(h) else weight
            yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(n)], names=["h", "n"])

    return parsed.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def bitmap_of(parsed: DataFrame, size: int, allowed: list, least: int):
    """A broadcast bitmap of the frequent hashes of a length; None if there is no room for any."""
    if BITMAP_BYTES < 128:
        return None
    found = cut_lineage(hash_counts(parsed, size, allowed).filter(F.col("n") >= least).select("h"))
    bitmap = Bitmap(found.count())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Bitmap(0)
        empty.width, empty.inner = width, inner
        own, held = -1, []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], type=pa.int64()), pa.array([empty.filled(np.concatenate(held))], type=pa.binary())], names=["part", "bits"])

        # rows come by part
        for batch in batches:
            part, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and part[a] != own:
                    if held:
                        yield full()
                    own, held = int(part[a]), []
                held.append(h[a:b])
        if held:
            yield full()

    width, inner = bitmap.width, bitmap.inner
    part = F.shiftrightunsigned(F.shiftrightunsigned("h", 1), 63 - width + inner)
    dealt = found.select(part.alias("part"), "h").repartition("part").sortWithinPartitions("part")
    # at most BITMAP_BYTES
    rows = dealt.mapInArrow(fill, "part bigint, bits binary").toArrow()
    for own, bits in zip(rows.column("part").to_pylist(), rows.column("bits").to_pylist()):
        bitmap.add(own, bits)
    return parsed.sparkSession.sparkContext.broadcast(bitmap)


def distinct_phrases(block: Block, k: int, allowed: Bitmap | None, second: np.ndarray) -> Iterator[tuple[str, bytes, int]]:
    """(lang, phrase, n) of the allowed phrases of ``k`` + 1 words of a block, equal ones once.

    Phrases are equal if two independent 64-bit hashes are. Should only one be, each occurrence comes back by itself.
    """
    at, h = block.starts[k], block.hashes[k]
    if allowed is not None:
        held = allowed.has(h)
        at, h = at[held], h[held]
    if not len(at):
        return
    other = second[at]
    for step in range(1, k + 1):
        other = mixed(other * np.uint64(0xC2B2AE3D27D4EB4F) + second[at + step])
    order = np.argsort(h)
    at, h, other = at[order], h[order], other[order]
    same = h[1:] == h[:-1]
    apart = same.any() and (other[1:][same] != other[:-1][same]).any()
    first = np.arange(len(at)) if apart else np.flatnonzero(np.append(True, ~same))
    weights = np.add.reduceat(block.weight[at], first)
    data, at = block.tokens.data, at[first]
    for lang, a, b, n in zip(block.lang[at].tolist(), block.tokens.start[at].tolist(), block.tokens.end[at + k].tolist(), weights.tolist()):
        yield block.names[lang], data[a:b], n


def counted(parsed: DataFrame, allowed: list, least: int) -> DataFrame:
    """(lang, words, phrase, f): exact counts of all phrases of up to four words that occur ``least`` times.

    A row with ``words`` = 0 and an empty phrase has the number of all words of the language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, bytes], int] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _, _ in seen], type=pa.string()), pa.array([k for _, k, _ in seen], type=pa.int32()),
                    pa.array([p for _, _, p in seen], type=pa.binary()).cast(pa.string()), pa.array(list(seen.values()), type=pa.int64()),
                ],
                names=["lang", "words", "phrase", "f"],
            )

        for block in blocks(batches):
            at, second = block.starts[0], block.tokens.second()
            for lang, n in enumerate(np.bincount(block.lang[at], weights=block.weight[at], minlength=len(block.names)).astype(np.int64).tolist()):
                key = block.names[lang], 0, b""
                seen[key] = seen.get(key, 0) + n
            for k in range(LONGEST):
                if k:
                    block.lengthen(allowed[k - 1] and allowed[k - 1].value)
                for lang, phrase, n in distinct_phrases(block, k, allowed[k] and allowed[k].value, second):
                    key = lang, k + 1, phrase
                    seen[key] = seen.get(key, 0) + n
            if len(seen) >= HELD:
                yield handed()
                seen.clear()
        yield handed()

    found = parsed.mapInArrow(run, "lang string, words int, phrase string, f bigint")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("words") == 0))


def sorted_places(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, place): the order of ``keys``, where each distinct one begins in it, and its place in the sorted ``table`` or -1.

    Distinct keys are looked up in their order, so large tables are walked and not jumped about in.
    """
    order = np.argsort(keys)
    held = keys[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.empty(0, dtype=np.int64)
    distinct = held[first]
    if not len(table):
        return order, first, np.full(len(first), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, distinct), len(table) - 1)
    return order, first, np.where(table[at] == distinct, at, -1)


def places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of every key in the sorted ``table``, -1 for those that are not in it."""
    order, first, found = sorted_places(table, keys)
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.repeat(found, np.diff(np.append(first, len(keys))))
    return out


class Numbers:
    """Frequent words of all languages by two independent hashes, of which the first has the language in it; a word's number is its place among them."""

    def __init__(self, h: np.ndarray, second: np.ndarray):
        order = np.argsort(h)
        self.h, self.second = h[order], second[order]

    def apart(self) -> bool:
        return bool((self.h[1:] != self.h[:-1]).all())

    def find(self, h: np.ndarray, second: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every token, -1 for what is no frequent word; and a token of each number that occurs."""
        order, first, found = sorted_places(self.h, h)
        sizes = np.diff(np.append(first, len(h)))
        number = np.repeat(found, sizes)
        same = number >= 0
        if len(self.h):
            same &= np.repeat(self.second[found], sizes) == second[order]
        same &= word[order]
        ids = np.empty(len(h), dtype=np.int32)
        ids[order] = np.where(same, number, -1)
        if (same[first] != (found >= 0)).any():
            held = np.flatnonzero(ids >= 0)
            return ids, held[np.unique(ids[held], return_index=True)[1]]
        return ids, order[first[found >= 0]]


class Words:
    """The tokens of some chunks with hashes that have the chunk's language in them."""

    def __init__(self, step: pa.RecordBatch):
        langs, texts, n = step.columns
        self.tokens = Tokens(pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), " ")[0].as_buffer())
        sizes = pc.count_substring(texts, " ").to_numpy().astype(np.int64) + 1
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.n = n.to_numpy()
        langs = langs.dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        self.lang = np.repeat(langs.indices.to_numpy(), sizes)
        salt = np.array([xxhash.xxh64_intdigest(x) for x in self.names], dtype=np.uint64)
        self.hash, self.second = mixed(self.tokens.hash ^ salt[self.lang]), self.tokens.second()


def word_counts(parsed: DataFrame) -> DataFrame:
    """(lang, h, second, f): occurrences of every word by its hashes, without a language; with one, those of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            words = Words(step)
            weight = np.repeat(words.n, words.ends - words.starts)
            own = words.tokens.word.copy()
            for back in range(1, OVERLAP + 1):
                own[words.ends - back] = False
            at = np.flatnonzero(own)
            totals = np.bincount(words.lang[at], weights=weight[at], minlength=len(words.names)).astype(np.int64)
            at = at[np.argsort(words.hash[at])]
            h, second = words.hash[at], words.second[at]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (second[1:] != second[:-1]))) if len(at) else at
            n = np.add.reduceat(weight[at], first) if len(at) else weight[at]
            none = np.zeros(len(totals), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * len(first) + words.names, type=pa.string()), pa.array(np.append(h[first].view(np.int64), none)),
                    pa.array(np.append(second[first].view(np.int64), none)), pa.array(np.append(n, totals)),
                ],
                names=["lang", "h", "second", "f"],
            )

    return parsed.mapInArrow(run, "lang string, h bigint, second bigint, f bigint").groupBy("lang", "h", "second").agg(F.sum("f").alias("f"))


def numbered(parsed: DataFrame, shared) -> DataFrame:
    """(ids, n, id, lang, word): the chunks with a word's number for every token, -1 where it has none; and the numbers' words, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(len(shared.value.h), dtype=bool)
        for step in steps(batches):
            words = Words(step)
            ids, at = shared.value.find(words.hash, words.second, words.tokens.word)
            # a chunk without two frequent words in a row has no phrase
            keep = np.flatnonzero(np.logical_or.reduceat((ids[:-1] >= 0) & (ids[1:] >= 0), words.starts))
            cut = [ids[a:b].tobytes() for a, b in zip(words.starts[keep].tolist(), words.ends[keep].tolist())]
            at = at[~told[ids[at]]]
            told[ids[at]] = True
            data = words.tokens.data
            spelled = [data[a:b].to_pybytes() for a, b in zip(words.tokens.start[at].tolist(), words.tokens.end[at].tolist())]
            chunk, name = [None] * len(cut), [None] * len(spelled)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cut + name, type=pa.binary()), pa.array(words.n[keep].tolist() + name, type=pa.int64()),
                    pa.array(chunk + ids[at].tolist(), type=pa.int32()), pa.array(chunk + [words.names[k] for k in words.lang[at].tolist()], type=pa.string()),
                    pa.array(chunk + spelled, type=pa.binary()).cast(pa.string()),
                ],
                names=["ids", "n", "id", "lang", "word"],
            )

    return parsed.mapInArrow(run, "ids binary, n bigint, id int, lang string, word string")


def pair_counts(chunks_: DataFrame, size: int, levels: list) -> DataFrame:
    """(key, n): occurrences of phrases of ``size`` words whose parts are frequent; ``levels`` has the frequent pairs of 2, 3 ... words."""

    def counts(parts: list[bytes], weights: list[int]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(parts), dtype=np.int32).astype(np.int64)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        own = np.ones(len(ids), dtype=bool)
        ends = np.cumsum(sizes)
        for back in range(1, OVERLAP + 1):
            own[ends - back] = False
        weight = np.repeat(np.array(weights, dtype=np.int64), sizes)
        number = ids
        for k in range(2, size + 1):
            at = np.flatnonzero((number[: len(ids) - k + 1] >= 0) & (number[1 : len(ids) - k + 2] >= 0))
            key = (number[at] << 32) | ids[at + k - 1]
            if k < size:
                number = np.full(len(ids), -1, dtype=np.int64)
                number[at] = places(levels[k - 2].value, key)
        held = own[at]
        key, weight = key[held], weight[at[held]]
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(np.add.reduceat(weight, first) if len(key) else weight)], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, weights, held = [], [], 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            parts += own
            weights += batch.column(1).to_pylist()
            held += sum(map(len, own))
            if held >= 2 * STEP:
                yield counts(parts, weights)
                parts, weights, held = [], [], 0
        if parts:
            yield counts(parts, weights)

    return chunks_.filter("ids is not null").select("ids", "n").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def counted_by_number(parsed: DataFrame, least: int) -> DataFrame | None:
    """What ``counted`` gives, by numbers; None if a level has more frequent phrases than may be broadcast."""
    spark = parsed.sparkSession
    words = cut_lineage(word_counts(parsed).filter((F.col("f") >= least) | F.col("lang").isNotNull()))
    found = words.filter("lang is null").select("h", "second", "f")
    if found.count() > NUMBERED:
        return None
    # at most NUMBERED words
    rows = found.select("h", "second").toArrow()
    numbers = Numbers(*(np.asarray(rows.column(c).combine_chunks().to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64) for c in ("h", "second")))
    if not numbers.apart():
        return None
    shared = spark.sparkContext.broadcast(numbers)
    chunks_ = written(numbered(parsed, shared))

    def with_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = places(shared.value.h, batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(2)], names=["id", "f"])

    def with_parts(table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(0).to_numpy()
                own = np.searchsorted(table.value, key) if table else np.full(len(key), -1)
                parts = [own, key >> 32, key & 0xFFFFFFFF]
                yield pa.RecordBatch.from_arrays([*(pa.array(p.astype(np.int32)) for p in parts), batch.column(1)], names=["id", "prefix", "word", "f"])

        return run

    names = chunks_.filter("id is not null").groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("phrase"))
    named = cut_lineage(names.join(found.mapInArrow(with_number, "id int, f bigint"), "id"))
    one = named.select(F.col("id").alias("word"), F.col("phrase").alias("last"))
    out = words.filter("lang is not null").select("lang", F.lit(0).alias("words"), F.lit("").alias("phrase"), "f")
    out = out.unionByName(named.select("lang", F.lit(1).alias("words"), "phrase", "f"))
    levels: list = []
    for size in range(2, LONGEST + 1):
        pairs = cut_lineage(pair_counts(chunks_, size, levels).filter(F.col("n") >= least))
        table = None
        if size < LONGEST:
            if pairs.count() > 2 * NUMBERED:
                return None
            keys = np.sort(np.asarray(pairs.select("key").toArrow().column("key").combine_chunks().to_numpy(zero_copy_only=False), dtype=np.int64))
            table = spark.sparkContext.broadcast(keys)
            levels.append(table)
        split = pairs.mapInArrow(with_parts(table), "id int, prefix int, word int, f bigint")
        before = named.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"))
        named = split.join(before, "prefix").join(one, "word").select("lang", F.concat_ws(" ", "head", "last").alias("phrase"), "f", "id")
        named = cut_lineage(named)
        out = out.unionByName(named.select("lang", F.lit(size).alias("words"), "phrase", "f"))
    return out


def part(words: str, first: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score): the lowest-scoring cut of every phrase of two words or more."""
    f = frequent.filter(F.col("words") > 0).select("lang", "phrase", "f")
    longer = frequent.filter(F.col("words") > 1).withColumn("w", F.split("phrase", " "))
    cuts = longer.select("lang", "words", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", part("w", F.lit(1), F.col("k")).alias("left"), part("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left = f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    met = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # the product may pass 64 bits; the score never exceeds a million, since neither part is rarer than the phrase
    wide = "cast({} as decimal(20,0))".format
    met = met.withColumn("score", F.expr(f"({wide('a')} * cast(2000000 as decimal(7,0))) div ({wide('l')} + {wide('r')})"))
    best = met.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def inner_phrases(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, most): for every phrase inside longer candidates, the largest count of one of them."""
    longer = candidates.filter(F.col("words") > 2).withColumn("w", F.split("phrase", " "))
    sized = longer.select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    placed = sized.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    return placed.select("lang", "a", part("w", F.col("at"), F.col("size")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(
    docs: DataFrame, least: int = 30, top: int = 2000, modulus: int = 32, covered: int = 80, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best phrases of every language.

    Words are what stands between spaces, tabs and the breaks ``.,;:!?`` and line ends, A-Z lower-cased; phrases
    never cross a break. ``a`` counts a phrase of two to four words (``least`` at least), ``l`` and ``r`` the parts of
    its lowest-scoring cut, ``n`` all words of the language, score is 2,000,000 a / (l + r) rounded down. A
    phrase inside a longer candidate that is at least ``covered`` hundredths as frequent is left out. Ties go by count, then by
    the phrase's bytes.

    Null texts are empty, a null language is ``und``, repeated rows count each, and an empty table gives no row.
    """
    short_batches(docs.sparkSession)
    parsed = written(dictionary(docs, modulus, text_col, lang_col))
    frequent = counted_by_number(parsed, least)
    if frequent is None:
        allowed: list = []
        for size in range(1, LONGEST + 1):
            allowed.append(bitmap_of(parsed, size, allowed, least))
        frequent = counted(parsed, allowed, least)
    frequent = cut_lineage(frequent)
    candidates = scored(frequent)
    inner = inner_phrases(candidates)
    left = candidates.join(inner, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = frequent.filter(F.col("words") == 0).select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
