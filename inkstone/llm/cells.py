"""Meeting of the rows of a key in cells of bounded size, whatever the size of the key's group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkstone.session import cut_lineage

#: The table of large keys is broadcast up to so many rows of two numbers, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def meet(rows: DataFrame, key: str, item: str, limit: int) -> DataFrame:
    """``rows`` with columns cell and side, dealt and sorted by cell, so that any two rows of a key meet once.

    A group of at most ``limit`` rows is one cell. A larger one is cut into chunks by a hash of
    ``item``, and each pair of chunks is a cell: side tells the chunk (0 or 1) there, and is -1
    where all rows of a cell are to be compared with each other.
    """
    large = cut_lineage(rows.groupBy(key).count().filter(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("_m")))
    n = large.count()
    sides = ["*", F.col(key).alias("cell"), F.lit(-1).alias("side")]
    if n == 0:
        met = rows.select(*sides)
    else:
        marked = rows.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, key, "left")
        few = marked.filter(F.col("_m").isNull()).drop("_m").select(*sides)
        chunk = F.pmod(F.xxhash64(F.lit(7), F.col(item)), F.col("_m")).cast("int")
        many = marked.filter(F.col("_m").isNotNull()).withColumn("_chunk", chunk)
        many = many.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        pair = F.xxhash64(key, F.least("_chunk", "_other"), F.greatest("_chunk", "_other"))
        side = F.when(F.col("_chunk") == F.col("_other"), F.lit(-1)).otherwise((F.col("_chunk") > F.col("_other")).cast("int"))
        met = few.unionByName(many.withColumn("cell", pair).withColumn("side", side).drop("_m", "_chunk", "_other"))
    return met.repartition("cell").sortWithinPartitions("cell")


def whole_cells(batches: Iterator[pa.RecordBatch], column: str = "cell") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts of their cells) of a sorted partition; no cell is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(column).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        if held and held[-1].column(column)[-1].as_py() == cell[0]:
            if not len(changes):
                held.append(batch)
                continue
            yield _ready([*held, batch.slice(0, int(changes[0]))], column)
            batch, changes = batch.slice(int(changes[0])), changes[1:] - changes[0]
            held = []
        elif held:
            yield _ready(held, column)
            held = []
        if len(changes):
            yield _ready([batch.slice(0, int(changes[-1]))], column)
            batch = batch.slice(int(changes[-1]))
        held = [batch]
    if held:
        yield _ready(held, column)


def _ready(parts: list[pa.RecordBatch], column: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(parts)
    cell = table.column(column).to_numpy()
    return table, np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
