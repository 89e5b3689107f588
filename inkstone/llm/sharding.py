"""Shards of bounded size by extendible hashing, with DataFrame functions only.

A directory is indexed by leading bits of each row's hash and points to buckets. A bucket over the
byte limit splits on its next bit, and only such buckets do, until each fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from inkstone.llm.common import free_name, whole_text
from inkstone.session import cut_lineage

HASH_BITS = 60


def bits_of(hex_digits: Column) -> Column:
    """The first 60 bits of a hash in hexadecimal, as a string of zeros and ones."""
    return F.lpad(F.conv(F.substring(hex_digits, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def leaves(rows: DataFrame, limit: int, base: int, width: int) -> DataFrame:
    """(cell, shard, depth, shard_bytes, shard_rows, fits): the directory over bits ``base`` to ``base + width``.

    ``rows`` has bits, bytes and shares its first ``base`` bits with rows that do not fit in one bucket. A cell is a prefix
    of ``base + width`` bits and points to the shortest prefix whose bucket fits, or to itself if none does.
    A bucket of one row always fits: it can't be split.
    """
    cells = rows.groupBy(F.expr(f"left(bits, {base + width})").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    spread = cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(base + width))))
    spread = spread.withColumn("shard", F.expr("left(cell, depth)"))
    sums = spread.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    sums = sums.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    found = spread.select("cell", "depth", "shard").join(sums, "shard")
    best = F.min_by(F.struct("shard", "depth", "shard_bytes", "shard_rows", "fits"), F.when(F.col("fits"), F.col("depth")).otherwise(1000 - F.col("depth")))
    return found.groupBy("cell").agg(best.alias("b")).select("cell", "b.*")


def keyed(docs: DataFrame, id_col: str, text_col: str, *kept: Column) -> DataFrame:
    """(kept, bytes, bits) of every row, checkpointed: bits of md5 of the id and the text, then bits drawn for each row."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), whole_text(text_col))
    drawn = bits_of(F.md5(F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string"))))
    size = F.octet_length(whole_text(text_col)).cast("bigint").alias("bytes")
    return cut_lineage(docs.select(*kept, size, F.concat(bits_of(F.md5(key)), drawn).alias("bits")))


def split(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (bytes, bits and others) without bits, with the shard fitted for each row, its depth and shard_bytes."""
    columns = rows.columns
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, width = 0, min(HASH_BITS, 4 + math.ceil(math.log2(1 + total / limit)))
    done = None
    while True:
        directory = cut_lineage(leaves(rows, limit, base, width))
        found = rows.withColumn("cell", F.expr(f"left(bits, {base + width})")).join(directory, "cell").drop("cell")
        last = base + width >= 2 * HASH_BITS
        fitting = (found if last else found.filter("fits")).drop("bits", "shard_rows", "fits")
        done = fitting if done is None else done.unionByName(fitting)
        if last or directory.filter("not fits").isEmpty():
            return done
        # what is still too large goes on with the bits that follow
        rows = cut_lineage(found.filter("not fits").select(*columns))
        base, width = base + width, min(8, 2 * HASH_BITS - base - width)


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, bytes, shard, depth, shard_bytes) of every row; shard is the prefix of hash bits of its bucket.

    The hash is md5 of the id and the text, so rows of one id part. Equal rows have equal hashes: a
    bucket that holds nothing else and is too large splits on bits drawn for each row, which a checkpoint keeps.
    A single row over ``limit`` is a shard by itself. Null ids and texts count as empty; an empty table gives no row.
    """
    rows = keyed(docs, id_col, text_col, F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("text_hash"))
    return split(rows, limit).select(F.col("id").alias(id_col), "text_hash", "bytes", "shard", "depth", "shard_bytes")


def write_shards(docs: DataFrame, limit: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows with all their columns to one folder of Parquet files for each shard.

    Each row, with its columns, goes through the split itself and is written to the shard that was fitted for it, so a
    folder holds at most ``limit`` bytes of text or a single row, whichever rows are equal.
    """
    shard = free_name(docs, "shard")
    placed = split(keyed(docs, id_col, text_col, F.struct(*docs.columns).alias("row")), limit)
    out = placed.select("row.*", F.concat(F.lit("p"), F.col("shard")).alias(shard))
    out.repartition(shard).write.mode("errorifexists").partitionBy(shard).parquet(folder)
