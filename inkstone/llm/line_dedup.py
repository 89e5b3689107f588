"""Lines that many documents share: exact reference counts, and a cuckoo filter of the frequent keys of each shard.

A ``LineIndex`` is a folder. It holds, in versions, the exact number of documents of every line key, and
for each shard of keys a cuckoo filter of the frequent ones together with the few other keys that the filter
takes for frequent. Filter and exceptions decide exactly for every indexed key. Documents can be
inserted and deleted: a key that reaches the threshold enters its filter, one that falls below leaves it.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkstone.llm.common import free_name, map_arrow, short_batches, slices, whole_text
from inkstone.llm.cuckoo import CuckooFilter, Shards
from inkstone.session import cut_lineage, path_exists, use_checkpoints

BLANK = b" \t\n\x0b\x0c\r"
#: Distinct keys that a task counts before it hands its counts on.
HELD = 200_000
#: Filters and exceptions up to so many bytes are broadcast; beyond that, lines are joined with the exact counts.
BROADCAST_BYTES = 64 << 20
RESULT = "text string, n_lines bigint, n_dropped bigint"


def key_of(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def digests(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """128-bit hashes of the keys of lines; None where a key is too short to count."""
    out: list[bytes | None] = []
    for line in lines:
        key = key_of(line)
        short = not key if min_chars <= 1 else len(key) < min_chars or len(key.decode()) < min_chars
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def halves(found: list[bytes]) -> np.ndarray:
    """n x 2 unsigned halves of 128-bit hashes."""
    return np.frombuffer(b"".join(found), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def shard_of(high: np.ndarray, bits: int) -> np.ndarray:
    return (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), dtype=np.int64)


def shard_column(bits: int) -> Column:
    return F.shiftrightunsigned("h1", 64 - bits).cast("int") if bits else F.lit(0)


def key_counts(docs: DataFrame, min_chars: int, text_col: str = "text") -> DataFrame:
    """(h1, h2, n): in how many rows of ``docs`` a key occurs, as partial counts of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            half = halves(list(seen)).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(half[:, 0]), pa.array(half[:, 1]), pa.array(list(seen.values()), type=pa.int64())], names=["h1", "h2", "n"]
            )

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                own = set(digests(text.encode().split(b"\n"), min_chars))
                own.discard(None)
                seen.update(own)
                if len(seen) >= HELD:
                    yield handed()
                    seen.clear()
        if seen:
            yield handed()

    return map_arrow(docs.select(whole_text(text_col).alias("text")), run, "h1 bigint, h2 bigint, n bigint")


def cleaned(text: str, drop) -> tuple[str, int, int]:
    """(kept text, lines, dropped lines); ``drop`` tells for a list of lines which ones go."""
    lines = text.encode().split(b"\n")
    gone = drop(lines)
    kept = [line for line, out in zip(lines, gone) if not out]
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)


def as_struct(found: list[tuple[str, int, int]]) -> pa.StructArray:
    text, lines, dropped = zip(*found) if found else ((), (), ())
    return pa.StructArray.from_arrays(
        [pa.array(text, type=pa.string()), pa.array(lines, type=pa.int64()), pa.array(dropped, type=pa.int64())], names=["text", "n_lines", "n_dropped"]
    )


class Frequent:
    """Exact membership of indexed keys among the frequent ones."""

    def __init__(self, filters: dict[int, bytes], exceptions: list[bytes], bits: int, min_chars: int):
        self.shards, self.bits, self.min_chars = Shards(filters, 1 << bits), bits, min_chars
        self.exceptions = {data[k : k + 16] for data in exceptions for k in range(0, len(data), 16)}

    def dropped(self, lines: list[bytes]) -> list[bool]:
        found = digests(lines, self.min_chars)
        asked = [d for d in found if d is not None]
        if not asked:
            return [False] * len(lines)
        half = halves(asked)
        held = iter(self.shards.contains(shard_of(half[:, 0], self.bits), half[:, 1]).tolist())
        return [d is not None and next(held) and d not in self.exceptions for d in found]


class LineIndex:
    """The lines of a set of documents, in a folder that driver and executors share.

    ``min_docs``, ``min_chars``: a key of at least so many code points in at least so many documents is frequent.
    A line without a key that long is never dropped. A row is a document, so repeated rows count each; a null text
    is one empty line. Each change writes a new version, which counts once its filters are complete:
    a job that is lost half-way leaves the version before it in force, and older versions can be returned to.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 10, min_chars: int = 1, keys_per_shard: int = 200_000):
        self.spark, self.folder, self.min_docs, self.min_chars, self.keys_per_shard = spark, folder, min_docs, min_chars, keys_per_shard
        self.version = self._newest()

    def _at(self, version: int, part: str) -> str:
        return f"{self.folder}/v{version:06d}/{part}"

    def _newest(self) -> int:
        """The last complete version; 0 if there is none."""
        if not path_exists(self.spark, self.folder):
            return 0
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
        numbers = sorted((int(s.getPath().getName()[1:]) for s in found if s.getPath().getName()[1:].isdigit()), reverse=True)
        return next((n for n in numbers if path_exists(self.spark, self._at(n, "filters/_SUCCESS"))), 0)

    def counts(self) -> DataFrame:
        """(h1, h2, n): the exact number of documents of every key that has any."""
        if not self.version:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint, n bigint")
        return self.spark.read.parquet(self._at(self.version, "counts")).filter("n > 0").select("h1", "h2", "n")

    def filters(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._at(version, "filters"))

    def insert(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count the lines of new documents in."""
        self._change(docs, 1, text_col)

    def delete(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count the lines of documents out that were inserted before with the same text; ValueError if some were not."""
        self._change(docs, -1, text_col)

    def revert(self, version: int) -> None:
        """Go back to an earlier version, as a new one; 0 is the empty index."""
        self.version = version
        merged = self.counts().withColumnRenamed("n", "now").withColumn("before", F.lit(0).cast("bigint"))
        self._publish(merged, self._newest() + 1, None)

    def _change(self, docs: DataFrame, sign: int, text_col: str) -> None:
        zero = F.lit(0).cast("bigint")
        old = self.counts().select("h1", "h2", F.col("n").alias("before"), zero.alias("more"))
        new = key_counts(docs, self.min_chars, text_col).select("h1", "h2", zero.alias("before"), (sign * F.col("n")).alias("more"))
        merged = old.unionByName(new).groupBy("h1", "h2").agg(F.sum("before").alias("before"), F.sum("more").alias("more"))
        self._publish(merged.select("h1", "h2", "before", (F.col("before") + F.col("more")).alias("now")), self._newest() + 1, self.version or None)

    def _publish(self, merged: DataFrame, version: int, base: int | None) -> None:
        path = self._at(version, "counts")
        merged.select("h1", "h2", "before", F.col("now").alias("n")).write.mode("overwrite").parquet(path)
        keys = self.spark.read.parquet(path)
        seen = keys.agg(F.count(F.when(F.col("n") > 0, 1)).alias("keys"), F.min("n").alias("least")).first()
        if seen["least"] is not None and seen["least"] < 0:
            raise ValueError("a document to delete was never inserted; the index stays as it was")
        bits = max(0, math.ceil(math.log2(max(1, seen["keys"]) / self.keys_per_shard)))
        had = base and self.filters(base).select("bits").first()
        keep = had and had["bits"] == bits
        min_docs = self.min_docs

        def refresh(keys: pa.Table, held: pa.Table | None) -> pa.Table:
            """The filter of a shard, from the one it had or anew, and the other keys that it wrongly takes for frequent."""
            half = np.stack([keys.column("h1").to_numpy(), keys.column("h2").to_numpy()], axis=1).view(np.uint64).reshape(-1, 2)
            before, now = keys.column("before").to_numpy(), keys.column("n").to_numpy()
            frequent = now >= min_docs
            made = None
            if held is not None and held.num_rows:
                made = CuckooFilter.load(held.column("filter")[0].as_py())
                made.delete(half[(before >= min_docs) & ~frequent, 1])
                if not made.insert(half[(before < min_docs) & frequent, 1]):
                    made = None
            if made is None:
                made = CuckooFilter.of(half[frequent, 1], spare=int(frequent.sum()) // 4)
            others = half[(now > 0) & ~frequent]
            wrong = others[made.contains(others[:, 1])]
            return pa.table(
                {
                    "shard": pa.array([int(shard_of(half[:1, 0], bits)[0])], type=pa.int32()),
                    "bits": pa.array([bits], type=pa.int32()),
                    "filter": pa.array([made.dump()], type=pa.binary()),
                    "exceptions": pa.array([wrong.astype(">u8").tobytes()], type=pa.binary()),
                }
            )

        schema = "shard int, bits int, filter binary, exceptions binary"
        by_shard = keys.select(shard_column(bits).alias("shard"), "h1", "h2", "before", "n").groupBy("shard")
        if keep:
            held = self.filters(base).select("shard", "filter").groupBy("shard")
            none = pa.schema([("shard", pa.int32()), ("bits", pa.int32()), ("filter", pa.binary()), ("exceptions", pa.binary())]).empty_table()
            made = by_shard.cogroup(held).applyInArrow(lambda keys, held: refresh(keys, held) if keys.num_rows else none, schema)
        else:
            made = by_shard.applyInArrow(lambda rows: refresh(rows, None), schema)
        made.write.mode("overwrite").parquet(self._at(version, "filters"))
        self.version = version

    def clean(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with a last column, a struct (text, n_lines, n_dropped): the text without its frequent lines.

        The documents must have been inserted. All columns and rows stay; the struct is named ``line_dedup``, with
        underscores behind it if there is such a column. A null text becomes one empty line. The text of a
        document that loses all lines is empty.
        """
        out = free_name(docs, "line_dedup")
        if not self.version:
            keep = F.struct(whole_text(text_col).alias("text"), F.size(F.split(whole_text(text_col), "\n", -1)).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"))
            return docs.withColumn(out, keep)
        held = self.filters(self.version)
        size = held.agg(F.sum(F.octet_length("filter") + F.octet_length("exceptions"))).first()[0] or 0
        if size > BROADCAST_BYTES:
            return self._clean_by_join(docs, text_col, out)
        rows = held.collect()  # bounded by the line above
        bits = rows[0]["bits"] if rows else 0
        known = Frequent({r["shard"]: bytes(r["filter"]) for r in rows}, [bytes(r["exceptions"]) for r in rows], bits, self.min_chars)
        shared = self.spark.sparkContext.broadcast(known)
        short_batches(self.spark)

        @F.arrow_udf(RESULT)
        def without(texts: pa.Array) -> pa.Array:
            return as_struct([cleaned(t, shared.value.dropped) for t in texts.to_pylist()])

        return docs.withColumn(out, without(whole_text(text_col)))

    def _clean_by_join(self, docs: DataFrame, text_col: str, out: str) -> DataFrame:
        """The same from the exact counts alone: each document's keys meet the frequent ones in a shuffle."""
        row, gone = free_name(docs, "line_row"), free_name(docs, "line_keys")
        rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
        min_chars = self.min_chars

        def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                owner, found = [], []
                for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = set(digests(text.encode().split(b"\n"), min_chars))
                    own.discard(None)
                    found += own
                    owner += [number] * len(own)
                half = halves(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(owner, type=pa.int64()), pa.array(half[:, 0]), pa.array(half[:, 1])], names=["row", "h1", "h2"])

        keys = map_arrow(rows.select(F.col(row).alias("row"), whole_text(text_col).alias("text")), keys_of, "row bigint, h1 bigint, h2 bigint")
        frequent = self.counts().filter(F.col("n") >= self.min_docs).select("h1", "h2")
        hit = keys.join(frequent, ["h1", "h2"]).groupBy("row").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))
        marked = rows.join(hit.select(F.col("row").alias(f"{row}_"), F.col("keys").alias(gone)), F.col(row) == F.col(f"{row}_"), "left")
        short_batches(self.spark)

        @F.arrow_udf(RESULT)
        def without(texts: pa.Array, keys: pa.Array) -> pa.Array:
            found = []
            for text, own in zip(texts.to_pylist(), keys.to_pylist()):
                known = {((k["h1"] % 2**64) << 64 | k["h2"] % 2**64).to_bytes(16) for k in own or ()}
                found.append(cleaned(text, lambda lines, known=known: [d in known for d in digests(lines, min_chars)]))
            return as_struct(found)

        return marked.withColumn(out, without(whole_text(text_col), F.col(gone))).select(*docs.columns, out)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, folder: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` cleaned by an index of their own lines, as ``LineIndex.clean`` gives it.

    The index is made in ``folder``, or in a new one below the checkpoint folder. An empty table gives no row.
    """
    spark = docs.sparkSession
    if folder is None:
        use_checkpoints(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/lines-{uuid.uuid4().hex}"
    index = LineIndex(spark, folder, min_docs, min_chars)
    index.insert(docs, text_col)
    return index.clean(docs, text_col)
