"""Near-duplicate vectors: random hyperplanes in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkstone.llm.cells import meet, whole_cells
from inkstone.llm.components import components, least_labels
from inkstone.session import cut_lineage

#: Rows of one block of cosines within a cell.
BLOCK = 256


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """dim x (tables * bits) normals, the same on every worker."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def signatures(unit: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """n x tables: the sides of ``bits`` planes as a number, for each table."""
    side = unit @ planes(unit.shape[1], tables, bits, seed) >= 0
    return side.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def plan_tables(threshold: float, largest: int, bucket: int = 32, miss: float = 1e-9) -> tuple[int, int]:
    """(tables, bits): buckets of about ``bucket`` unrelated vectors, and a link missed with chance ``miss`` at most."""
    bits = min(24, max(6, math.ceil(math.log2(max(1, largest / bucket)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-agree)), bits


def can_link(vec: str, label: str) -> Column:
    """True for a row with a label and a vector of finite numbers that are not all zero; never null."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten(), dtype=np.float64)
    rows = flat.reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def compare_cell(unit, sides, weights, tables, sigs, threshold):
    """(count of linked rows, label of the local component) for each row of one cell.

    A pair is counted in the first table in which both have the same signature, so that over all
    tables each pair counts once.
    """
    n = len(unit)
    counts = np.zeros(n)
    label = np.arange(n)
    table = tables[0]
    cols = np.arange(n)
    for at in range(0, n, BLOCK):
        near = unit[at : at + BLOCK] @ unit.T >= threshold
        near &= cols[None, :] > cols[at : at + BLOCK, None]
        if sides[0] >= 0:
            near &= sides[at : at + BLOCK, None] != sides[None, :]
        a, b = np.nonzero(near)
        a += at
        first = (sigs[a, : table + 1] == sigs[b, : table + 1]).argmax(axis=1) == table
        a, b = a[first], b[first]
        if len(a):
            counts += np.bincount(a, weights=weights[b], minlength=n) + np.bincount(b, weights=weights[a], minlength=n)
            label = least_labels(np.concatenate([a, np.arange(n)]), np.concatenate([b, label]), n)
    return counts.astype(np.int64), label


def link_classes(classes: DataFrame, threshold: float, seed: int = 11, limit: int = 2048) -> DataFrame:
    """(cid, other, n): partial counts of linked vectors of a class, and links that connect classes.

    ``classes`` has cid, label, vec and weight, one row for each distinct vector of a label. Only vectors of
    equal label and length meet. ``other`` is a class of the same component, or the class itself.
    """
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    tables, bits = plan_tables(threshold, largest)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("vec").value_lengths())
            for dim in np.unique(sizes).tolist():
                place = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(place))
                sigs = signatures(unit_rows(part.column("vec"), dim), tables, bits, seed)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("cid"), part.column("label"), part.column("vec"), part.column("weight"),
                         pa.array(np.full(len(place), dim, dtype=np.int32)), pa.array(np.full(len(place), t, dtype=np.int32)), pa.array(sigs[:, t])],
                        names=["cid", "label", "vec", "weight", "dim", "tab", "sig"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_cells(batches):
            ends = np.append(starts[1:], rows.num_rows)
            lone = ends - starts == 1
            cid, weight = rows.column("cid").to_numpy(), rows.column("weight").to_numpy().astype(np.float64)
            side, tab = rows.column("side").to_numpy(), rows.column("tab").to_numpy()
            dims = rows.column("dim").to_numpy()
            out: list[tuple] = []
            for a, b in zip(starts[~lone].tolist(), ends[~lone].tolist()):
                part = rows.slice(a, b - a)
                unit = unit_rows(part.column("vec"), int(dims[a]))
                counts, label = compare_cell(unit, side[a:b], weight[a:b], tab[a:b], signatures(unit, tables, bits, seed), threshold)
                own = cid[a:b]
                for k in np.flatnonzero(counts).tolist():
                    out.append((own[k], own[label[k]], counts[k]))
            packed = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(packed[:, c]) for c in range(3)], names=["cid", "other", "n"])

    kind = classes.schema["label"].dataType.simpleString()
    hashed = classes.select("cid", "label", F.col("vec").cast("array<double>").alias("vec"), "weight").mapInArrow(
        hash_rows, f"cid bigint, label {kind}, vec array<double>, weight bigint, dim int, tab int, sig bigint"
    )
    keyed = hashed.withColumn("bucket", F.xxhash64("label", "dim", "tab", "sig")).drop("label", "sig")
    return meet(keyed, "bucket", "cid", limit).drop("bucket").mapInArrow(compare, "cid bigint, other bigint, n bigint")


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Links join rows of equal label and cosine of at least ``threshold``. Null labels and vectors that are
    null, empty, zero or hold null or non-finite numbers link with nothing and are kept. Equal vectors of a
    label form one class with a weight, so copies are counted and not compared. Rows that repeat an id
    are rows of their own; a null id is never the smallest. An empty table gives no row.

    Signatures of two rows are compared per table, so a link is found with a chance of at least 1 - 1e-9
    each (``plan_tables``); what is found is verified, so nothing below the threshold is linked.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    good = rows.filter(can_link("vec", "label"))
    grouped = good.groupBy("label", "vec").agg(F.count("*").alias("weight"), F.min("id").alias("least_id"))
    classes = cut_lineage(grouped.withColumn("cid", F.monotonically_increasing_id()))
    linked = cut_lineage(link_classes(classes.select("cid", "label", "vec", "weight"), threshold).groupBy("cid", "other").agg(F.sum("n").alias("n")))
    counts = linked.groupBy("cid").agg(F.sum("n").alias("n"))
    found = components(linked.select(F.col("cid").alias("src"), F.col("other").alias("dst")))
    known = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_class = (
        known.join(named, "component")
        .join(counts, "cid", "left")
        .select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    )
    sound = good.join(per_class, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec"))).select("id", "n_links", "component_id")
    rest = rows.filter(~can_link("vec", "label"))
    both = sound.unionByName(rest.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

