"""Token counts of whole texts by a two-tier lookup on the map side.

The first tier is a broadcast table of the lengths of frequent pre-tokens, the second a cache of each
worker; only pre-tokens that neither holds are encoded. Pre-tokens are never shuffled: a task hands in
a summary of bounded size, and counts are added up where the text lies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkstone.llm.common import Memo, map_arrow, slices, whole_text

MARK = "▁"
RUNS = re.compile(f"{MARK}+[^{MARK}]*")


def pretokens(text: str) -> list[str]:
    """Pieces that a model whose tokens have the word mark only at their front encodes independently.

    Each is what follows one mark; the library puts that mark in front by itself.
    """
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
        return text.split(" ")
    return [m[1:].replace(MARK, " ") for m in RUNS.findall(MARK + text.replace(" ", MARK))]


@lru_cache(maxsize=2)
def model_of(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)]
    if inner or model.encode("a b", out_type=str) != [f"{MARK}a", f"{MARK}b"]:
        raise ValueError("the model joins words in one token, or does not mark their front")
    return model


def length_of(path: str, key: str) -> int:
    """Number of tokens of a pre-token; the empty one is a lone mark."""
    return len(model_of(path).encode(key)) if key else 1


_held: dict = {}


def lookup_of(path: str, frequent: Frequent) -> Memo:
    """The worker's two tiers, kept between the tasks of one query."""
    if _held.get("of") != (path, frequent.id):
        packed, sizes = frequent.value
        fixed = dict(zip(packed.split(MARK), sizes)) if sizes else {}
        _held.update(of=(path, frequent.id), table=Memo(lambda key: length_of(path, key), fixed=fixed))
    return _held["table"]


class Frequent:
    """A broadcast table with an identity that workers can compare."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __reduce__(self):
        return _frequent, (self.broadcast, self.id)

    @property
    def value(self):
        return self.broadcast.value


def _frequent(broadcast, number):
    own = Frequent.__new__(Frequent)
    own.broadcast, own.id = broadcast, number
    return own


def frequent_lengths(docs: DataFrame, path: str, per_task: int = 4096, kept: int = 32_768, text_col: str = "text"):
    """Broadcast of (pre-tokens joined by the mark, their lengths): the ``kept`` most frequent of all texts.

    A task counts in a table that is thinned to the commonest ``4 * per_task`` keys whenever it exceeds
    eight times that, and hands in at most ``per_task`` rows. The table is only a cache: what it lacks is encoded.
    """
    most = 32 * per_task

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(pretokens(text))
            if len(seen) > most:
                seen = Counter(dict(seen.most_common(4 * per_task)))
        top = [(k, n) for k, n in seen.most_common(per_task) if len(k) <= 64]
        sizes = [length_of(path, k) for k, _ in top]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], type=pa.string()), pa.array([n for _, n in top], type=pa.int64()), pa.array(sizes, type=pa.int64())],
            names=["key", "n", "size"],
        )

    rows = map_arrow(docs.select(whole_text(text_col).alias("text")), summary, "key string, n bigint, size bigint")
    total = rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    top = total.orderBy(F.desc("n"), "key").limit(kept).collect()
    table = (MARK.join(r["key"] for r in top), [r["size"] for r in top])
    return Frequent(docs.sparkSession.sparkContext.broadcast(table))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, tokens as ``sentencepiece`` gives them.

    A null text counts as empty: no bytes, no tokens. Repeated rows stay; an empty table gives no row;
    other columns are not read.
    """
    frequent = frequent_lengths(docs, path, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = lookup_of(path, frequent).__getitem__
        for batch in slices(batches):
            counts = [sum(map(size, pretokens(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, type=pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col(id_col).alias("id"), whole_text(text_col).alias("text"), F.octet_length(whole_text(text_col)).cast("bigint").alias("n_bytes")
    )
    kind = rows.schema["id"].dataType.simpleString()
    counted = map_arrow(rows, run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
