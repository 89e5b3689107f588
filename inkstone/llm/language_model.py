"""Scores of whole texts under a byte model by context-tree weighting, and under word counts.

The texts are dealt into blocks of bounded size. A block hands in its distinct grams and words with their
counts among the training texts; buckets add them up over all blocks and weigh the context trees; each
block gets the answers for what it handed in, and scores its texts. So every text counts, no table is
broadcast that grows with the corpus, and what is exchanged besides the texts are distinct grams and words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from inkstone.llm.common import crc_of, whole_text
from inkstone.llm.ctw_tree import Top, Tree, bucket_of, grams
from inkstone.session import cut_lineage

GRAMS, WORDS = 0, 1
#: Bytes of text whose grams are built at once.
STEP = 2_000_000


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, planes of equal weight together, compressed."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def loosen(packed: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_keys(sorted_keys: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_keys, prepend=np.uint64(0)))


def load_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(loosen(packed, np.uint64), dtype=np.uint64)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def load_words(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def spans(texts: list, step: int = STEP) -> Iterator[list]:
    """The texts in lists of about ``step`` bytes."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= step:
            yield part
            part, size = [], 0
    if part:
        yield part


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every, sums = every[order], np.concatenate(counts)[order]
    at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, dtype=np.int64)
    return every[at], np.add.reduceat(sums, at) if len(at) else sums


class Sums:
    """Counts by key, compacted whenever the parts outgrow what is distinct."""

    def __init__(self):
        self.keys, self.counts, self.loose = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.loose += len(keys)
        if self.loose > 2_000_000 and self.loose > 2 * len(self.keys[0]):
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        keys, counts = added(self.keys, self.counts)
        self.keys, self.counts, self.loose = [keys], [counts], 0
        return keys, counts


def count_block(texts: list[str], held: list[bool], depth: int, buckets: int) -> list[tuple]:
    """(kind, bucket, keys, counts among training texts, training tokens, training texts) of a block."""
    sums, words = Sums(), Counter()
    n_words = n_texts = 0
    for part in spans(list(zip(texts, held)), step=500):
        for train in (True, False):
            chosen = [words_of(t) for t, h in part if h != train]
            if not chosen:
                continue
            for own in chosen:
                if train:
                    words.update(own)
                    n_words += len(own)
                else:
                    words.update(dict.fromkeys(own, 0))
            for some in spans([b" ".join(own) for own in chosen]):
                keys, counts = np.unique(grams(some, depth)[0], return_counts=True)
                sums.add(keys, counts if train else np.zeros(len(keys), dtype=np.int64))
            n_texts += train * len(chosen)
    keys, counts = sums.compact()
    rows = []
    where = bucket_of(keys, depth, buckets)
    for k in np.unique(where).tolist():
        own = where == k
        rows.append((GRAMS, k, pack_keys(keys[own]), squeeze(counts[own].astype(np.uint64)), 0, 0))
    lists: dict[int, list[bytes]] = {}
    for word in sorted(words):
        lists.setdefault(zlib.crc32(word) % buckets, []).append(word)
    for k, own in lists.items():
        rows.append((WORDS, k, pack_words(own), squeeze(np.array([words[w] for w in own], dtype=np.uint64)), 0, 0))
    rows.append((WORDS, 0, pack_words([]), squeeze(np.empty(0, dtype=np.uint64)), n_words + n_texts, n_texts))
    return rows


def score_block(texts: list[str], keys: np.ndarray, logs: np.ndarray, known: dict[bytes, float], depth: int) -> list[tuple[int, int, float, float, int]]:
    """(words, known words, sum of log10(c + 1) of the words, log10 probability, bytes with the end) of each text."""
    out = []
    for part in spans(texts):
        split = [words_of(t) for t in part]
        found, sizes = grams([b" ".join(own) for own in split], depth)
        ends = np.cumsum(sizes).tolist()
        for own, a, b in zip(split, [0, *ends], ends):
            uniq, n = np.unique(found[a:b], return_counts=True)
            logp = float(logs[np.searchsorted(keys, uniq)] @ n)
            values = list(map(known.__getitem__, own))
            out.append((len(own), len(own) - values.count(0.0), math.fsum(values), logp, b - a))
    return out


REQUEST = "block bigint, kind int, bucket bigint, keys binary, counts binary, tokens bigint, texts bigint"
TOP = "array<struct<near:int,node:int,zeros:double,ones:double,weighted:double>>"


def merged_buckets(requests: DataFrame, depth: int) -> DataFrame:
    """(bucket, kind, keys, counts, distinct, tokens, texts, top): the sums over all blocks, one row of a bucket and kind.

    A task holds what is distinct in one bucket at a time, however many blocks hand in rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, words, tokens, texts = None, Sums(), Counter(), 0, 0

        def ready() -> pa.RecordBatch:
            top = []
            if now[1] == GRAMS:
                keys, counts = sums.compact()
                packed, distinct = pack_keys(keys), len(keys)
                near, node, zeros, ones, weighted = Tree(keys, counts, depth).top()
                top = [
                    {"near": a, "node": b, "zeros": c, "ones": d, "weighted": e}
                    for a, b, c, d, e in zip(near.tolist(), node.tolist(), zeros.tolist(), ones.tolist(), weighted.tolist())
                ]
            else:
                own = sorted(words)
                counts = np.array([words[w] for w in own], dtype=np.int64)
                packed, distinct = pack_words(own), int((counts > 0).sum())
            row = [now[0], now[1], packed, squeeze(counts.astype(np.uint64)), distinct, tokens, texts, top]
            return pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(schema, row)}, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["bucket"], row["kind"])
                if key != now:
                    if now is not None:
                        yield ready()
                    now, sums, words, tokens, texts = key, Sums(), Counter(), 0, 0
                counts = loosen(row["counts"], np.uint64).astype(np.int64)
                if row["kind"] == GRAMS:
                    sums.add(load_keys(row["keys"]), counts)
                else:
                    words.update(dict(zip(load_words(row["keys"]), counts.tolist())))
                tokens, texts = tokens + row["tokens"], texts + row["texts"]
        if now is not None:
            yield ready()

    node = pa.struct([("near", pa.int32()), ("node", pa.int32()), ("zeros", pa.float64()), ("ones", pa.float64()), ("weighted", pa.float64())])
    schema = pa.schema([
        ("bucket", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
        ("distinct", pa.int64()), ("tokens", pa.int64()), ("texts", pa.int64()), ("top", pa.list_(node)),
    ])
    sorted_rows = requests.drop("block").repartition("bucket").sortWithinPartitions("bucket", "kind")
    return sorted_rows.mapInArrow(run, f"bucket bigint, kind int, keys binary, counts binary, distinct bigint, tokens bigint, texts bigint, top {TOP}")


def answers(requests: DataFrame, merged: DataFrame, top: Top, depth: int) -> DataFrame:
    """(block, kind, keys, found): for what a block handed in, the log10 probabilities and the corpus counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = logs = table = None
        for batch in batches:
            out: dict[str, list] = {"block": [], "kind": [], "keys": [], "found": []}
            for row in batch.to_pylist():
                grams_row = row["kind"] == GRAMS
                if row["block"] is None:
                    counts = loosen(row["counts"], np.uint64).astype(np.int64)
                    if grams_row:
                        keys = load_keys(row["keys"])
                        logs = Tree(keys, counts, depth).log10(top)
                    else:
                        table = dict(zip(load_words(row["keys"]), counts.tolist()))
                    continue
                if grams_row:
                    found = squeeze(logs[np.searchsorted(keys, load_keys(row["keys"]))].astype(np.float32))
                else:
                    found = squeeze(np.array([table[w] for w in load_words(row["keys"])], dtype=np.uint64))
                for name, value in zip(out, (row["block"], row["kind"], row["keys"], found)):
                    out[name].append(value)
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(out.values(), kinds)], names=list(out))

    asked = requests.select("bucket", "kind", "block", "keys", F.lit(None).cast("binary").alias("counts"))
    model = merged.select("bucket", "kind", F.lit(None).cast("bigint").alias("block"), "keys", "counts")
    dealt = model.union(asked).repartition("bucket").sortWithinPartitions("bucket", "kind", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(run, "block bigint, kind int, keys binary, found binary")


def score(
    docs: DataFrame,
    depth: int = 5,
    fold: tuple[int, int] = (7, 2),
    block_bytes: int = 24_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A text is held out if crc32 of its id modulo fold[0] is fold[1]; the others train both models. Words are
    runs of anything but ASCII white space, with A-Z lower-cased, and one end closes a text. ``base_score``
    smooths word counts by one; ``score`` is the log10 probability of the words with single spaces between
    them and of the end, under trees of ``depth`` bytes; ``bits_per_byte`` is the same as a code length.
    A context that no training text has adds nothing to the estimate of the longest one that some has.

    A null text is empty: its end alone is scored. A null id counts as the empty text in the fold. Repeated rows
    each train and are each scored. Without training texts every byte and word is a guess. An empty table gives no row.
    """
    base = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), (F.pmod(crc_of(id_col), F.lit(fold[0])) == fold[1]).alias("held_out"))
    total = base.agg(F.sum(F.octet_length("text").cast("bigint") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    buckets = 8 * math.ceil(math.sqrt(blocks))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))

    def ask(table: pa.Table) -> pa.Table:
        rows = count_block(table["text"].to_pylist(), table["held_out"].to_pylist(), depth, buckets)
        block = table["block"][0].as_py()
        columns = list(zip(*rows))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array([block] * len(rows), type=pa.int64()), *(pa.array(c, type=k) for c, k in zip(columns, kinds))]
        return pa.Table.from_arrays(arrays, names=["block", "kind", "bucket", "keys", "counts", "tokens", "texts"])

    requests = cut_lineage(dealt.groupBy("block").applyInArrow(ask, REQUEST))
    merged = cut_lineage(merged_buckets(requests, depth))
    totals = merged.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"),
        F.coalesce(F.sum(F.when(F.col("kind") == WORDS, F.col("distinct"))), F.lit(0)).alias("words"),
    ).first()
    # at most 256 x 255 rows
    nodes = merged.select(F.explode("top").alias("t")).groupBy("t.near", "t.node").agg(*[F.sum(f"t.{c}").alias(c) for c in ("zeros", "ones", "weighted")]).collect()
    top = Top(*(np.array([r[c] for r in nodes], dtype=np.int64 if c in ("near", "node") else np.float64) for c in ("near", "node", "zeros", "ones", "weighted")))
    n_tokens, n_texts = int(totals["tokens"]), int(totals["texts"])
    floor = math.log10(n_tokens + int(totals["words"]) + (n_texts > 0) + 1)
    end = math.log10(n_texts + 1)

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        keys, logs, known = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.float32)], {}
        for row in found.to_pylist():
            if row["kind"] == GRAMS:
                keys.append(load_keys(row["keys"]))
                logs.append(loosen(row["found"], np.float32))
            else:
                known.update(zip(load_words(row["keys"]), np.log10(loosen(row["found"], np.uint64) + 1.0).tolist()))
        every = np.concatenate(keys)
        order = np.argsort(every)
        whole = texts["text"].to_pylist()
        rows = score_block(whole, every[order], np.concatenate(logs)[order].astype(np.float64), known, depth)
        words, seen, sums, logp, sizes = (list(c) for c in zip(*rows)) if rows else ([], [], [], [], [])
        return pa.Table.from_arrays(
            [
                texts["id"].combine_chunks() if texts.num_rows else pa.array([], type=texts["id"].type),
                texts["held_out"].combine_chunks() if texts.num_rows else pa.array([], type=pa.bool_()),
                pa.array([n + 1 for n in words], type=pa.int64()),
                pa.array([n + (n_texts > 0) for n in seen], type=pa.int64()),
                pa.array([n_tokens] * len(words), type=pa.int64()),
                pa.array([s + end - (n + 1) * floor for s, n in zip(sums, words)], type=pa.float64()),
                pa.array(logp, type=pa.float64()),
                pa.array([-p / math.log10(2) / s for p, s in zip(logp, sizes)], type=pa.float64()),
            ],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    replies = answers(requests, merged, top, depth)
    kind = dealt.schema["id"].dataType.simpleString()
    out = (
        dealt.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(
            finish,
            f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double",
        )
    )
    return out.withColumnRenamed("id", id_col)
