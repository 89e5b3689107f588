"""SimHash near-duplicates: all documents whose fingerprints differ in few bits.

The 64 bits are seen as 32 segments of two bits. The numbers of set bits of the segments are a point
of a grid, and the Manhattan distance of two points never exceeds the Hamming distance of the
fingerprints. So of two fingerprints within 4 bits, the points of the lower or of the upper half are
within 2, and share a neighbour in the grid at distance 1 or less from both. Fingerprints meet in such
neighbours, and what meets is compared bit by bit. Nothing is missed and nothing else is linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from inkstone.llm.cells import meet, whole_cells
from inkstone.llm.common import free_name, map_arrow, slices, whole_text
from inkstone.llm.components import components, least_labels
from inkstone.session import cut_lineage

SEED = 42
CHUNK = 65_536
#: A cell of up to so many fingerprints is compared by shifts of the sorted column, a larger one by a walk.
SHIFTED = 48


def fingerprint(text: str, shingle: int = 4) -> int:
    """The fingerprint of a whole text as a signed number; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts[size - 1 :] + lengths[size - 1 :]
    ones, n = np.zeros(64, dtype=np.int64), len(ends)
    for at in range(0, n, CHUNK):
        cuts = zip(starts[at : min(at + CHUNK, n)].tolist(), ends[at : at + CHUNK].tolist())
        digests = b"".join(map(xxhash.xxh64_digest, [joined[a:b] for a, b in cuts], repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, text_hash, fp): the fingerprint of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, type=pa.int64())], names=["id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("text_hash"), whole_text(text_col).alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def neighbours(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, place of the fingerprint) for every grid point at distance 1 or less in either half."""
    bits = prints.view(np.uint64)
    counts = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
    every = np.arange(len(prints))
    cells, owners = [], []
    for half in (0, 1):
        point = ((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        mark = np.int64(half << 32)
        cells.append(point | mark)
        owners.append(every)
        for segment in range(16):
            field = (point >> (2 * segment)) & 3
            for step, allowed in ((1, field < 2), (-1, field > 0)):
                cells.append((point[allowed] + (step << (2 * segment))) | mark)
                owners.append(every[allowed])
    return np.concatenate(cells), np.concatenate(owners)


def walk(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, root) of the linked fingerprints of one cell. A place is left out of later tests once reached."""
    left = np.arange(len(prints))
    nodes, roots = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(prints[left] ^ prints[queue.pop()]) <= most
            if near.any():
                reached = left[near]
                left = left[~near]
                queue += reached.tolist()
                nodes.append(reached)
                roots.append(np.full(len(reached), root))
    if not nodes:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(nodes), np.concatenate(roots)


def links_of(prints: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links (fingerprint, fingerprint) that connects what the cells show to be near."""
    sizes = np.diff(np.append(starts, len(prints)))
    a, b = [], []
    for k in np.flatnonzero(sizes > SHIFTED).tolist():
        x, y = walk(prints[starts[k] : starts[k] + sizes[k]], most)
        a.append(x + starts[k])
        b.append(y + starts[k])
    small = np.repeat(sizes <= SHIFTED, sizes)
    places = np.flatnonzero(small)
    ends = np.repeat(starts + sizes, sizes)[places]
    shift = 1
    while len(places):
        keep = places + shift < ends
        places, ends = places[keep], ends[keep]
        near = places[np.bitwise_count(prints[places] ^ prints[places + shift]) <= most]
        a.append(near)
        b.append(near + shift)
        shift += 1
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, flat = np.unique(np.concatenate([prints[a], prints[b]]), return_inverse=True)
    label = least_labels(flat[: len(a)], flat[len(a) :], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved].view(np.int64), nodes[label[moved]].view(np.int64)


def near_links(prints: DataFrame, most: int = 4, limit: int = 4096) -> DataFrame:
    """(src, dst) links that connect exactly the distinct fingerprints ``fp`` reachable by steps of ``most`` bits."""
    if not 0 <= most <= 5:
        raise ValueError("the grid join covers distances of up to 5 bits")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            own = batch.column(0).to_numpy()
            cell, place = neighbours(own)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own[place])], names=["grid", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_cells(batches):
            src, dst = links_of(rows.column("fp").to_numpy().view(np.uint64), starts, most)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    met = meet(prints.select("fp").mapInArrow(points, "grid bigint, fp bigint"), "grid", "fp", limit)
    return met.select("cell", "fp").mapInArrow(compare, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, most: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp, component_id, group) of every row; the component is the smallest id reachable.

    ``group`` is the smallest fingerprint reachable, which tells groups apart whatever their ids.
    Texts without words have fingerprint zero and link like any other; a null text is such a text.
    Rows that repeat an id get a row each. A null id is never the smallest; a group of null ids has a
    null component. Copies share a fingerprint, which takes part once.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    groups = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    found = components(near_links(groups, most))
    labelled = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_print = labelled.select("fp", "component").join(named, "component").select("fp", "component_id", F.col("component").alias("group"))
    return rows.join(of_print, "fp").select(F.col("id").alias(id_col), "text_hash", "fp", "component_id", "group")


def keep_first(docs: DataFrame, most: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each near-duplicate group: that of the smallest id, then of the smallest text hash.

    All columns stay as they are, whatever their names; a repeated row is kept once. Of rows equal in id and text, the one
    with the smallest hash of all its columns stays, so a retry keeps the same.
    """
    found = near_duplicates(docs, most, shingle, id_col, text_col)
    least = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("text_hash").alias("h")))
    first = found.groupBy("group").agg(least.alias("_first"))
    copies = found.groupBy(F.col(id_col).alias("i"), F.col("text_hash").alias("h")).agg(F.count("*").alias("_n"))
    chosen = first.select("_first.i", "_first.h").join(copies.withColumnsRenamed({"i": "ci", "h": "ch"}), F.col("i").eqNullSafe(F.col("ci")) & (F.col("h") == F.col("ch")))
    i, h, n, text_hash = (free_name(docs, x) for x in ("chosen_id", "chosen_hash", "chosen_copies", "row_hash"))
    chosen = chosen.select(F.col("i").alias(i), F.col("h").alias(h), F.col("_n").alias(n))
    hashed = docs.withColumn(text_hash, F.xxhash64(whole_text(text_col)))
    kept = hashed.join(chosen, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(text_hash) == F.col(h)))
    once = kept.filter(F.col(n) == 1)
    whole, row = free_name(docs, "row_order"), free_name(docs, "row_columns")
    many = kept.filter(F.col(n) > 1).select(i, h, F.struct(*[F.col(c) for c in docs.columns]).alias(row))
    many = many.withColumn(whole, F.xxhash64(F.to_json(row, {"ignoreNullFields": "false"})))
    many = many.groupBy(i, h).agg(F.min_by(row, whole).alias(row)).select(f"{row}.*")
    return once.select(*docs.columns).unionByName(many)
