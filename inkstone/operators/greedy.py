"""One-by-one keep/drop passes over the boxes of a page, exact at any page size."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from inkstone.functions.geometry import let
from inkstone.operators.common import PAGE_ROWS, connected_components, first_independent, first_per_key, grid_join, split_by_size

Conflict = Callable[[Column, Column], Column]


def kept_by_iou(x1: list[float], y1: list[float], x2: list[float], y2: list[float], turns: Iterable[int], floor: float) -> list[int]:
    """Places of the boxes kept, in the order of ``turns``, when each is dropped for an IoU of ``floor`` with a kept one.

    Numbers that are missing are NaN; such a box meets nothing.
    """
    kept: list[int] = []
    for j in turns:
        for i in kept:
            w, h = min(x2[i], x2[j]) - max(x1[i], x1[j]), min(y2[i], y2[j]) - max(y1[i], y1[j])
            if w > 0 and h > 0:
                inter = w * h
                union = (x2[i] - x1[i]) * (y2[i] - y1[i]) + (x2[j] - x1[j]) * (y2[j] - y1[j]) - inter
                if union > 0 and inter / union >= floor:
                    break
        else:
            kept.append(j)
    return kept


def _page_arrays(df: DataFrame, page: str, order: list[str]) -> DataFrame:
    rest = order + [c for c in df.columns if c not in order and c != page]
    return df.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("items"))


def _explode_kept(arrays: DataFrame, page: str, kept: Column, columns: list[str]) -> DataFrame:
    rows = arrays.select(page, F.explode(kept).alias("k"))
    return rows.select(*[F.col(page) if c == page else F.col(f"k.{c}") for c in columns])


def greedy_keep(
    items: DataFrame, page: str, order: list[str], conflict: Conflict, copies: list[str], limit: int = PAGE_ROWS, cell: int = 128
) -> DataFrame:
    """Rows kept when each is dropped for conflicting with an earlier kept one of its page.

    ``order`` sorts a page totally. ``conflict(kept, new)`` may hold only for
    intersecting boxes and may read only ``copies`` columns. A page of ordinary size
    is one fold inside its row. Pages above ``limit`` first lose the exact copies
    that conflict, then meet through the grid and are decided in parallel rounds
    with the same outcome.
    """
    small, large = split_by_size(items, page, limit)
    arrays = _page_arrays(small, page, order)
    kept = F.aggregate(
        "items",
        F.filter("items", lambda x: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda k: conflict(k, x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    out = _explode_kept(arrays, page, kept, items.columns)
    if large is None:
        return out
    fields = [c for c in items.columns if c != page]
    itself = F.struct(*fields)
    copied = large.withColumn("_copied", F.coalesce(conflict(itself, itself), F.lit(False)))
    distinct = first_per_key(copied.filter("_copied"), [page, *copies], [F.col(c) for c in order])
    rows = distinct.select(*items.columns).unionByName(copied.filter("not _copied").select(*items.columns))
    nodes = rows.withColumn("node", F.struct(page, *order))
    pairs = grid_join(nodes, nodes, page, cell).filter(F.col("a_node") < F.col("b_node"))
    first, second = (F.struct(*[F.col(f"{p}{c}").alias(c) for c in fields]) for p in ("a_", "b_"))
    edges = pairs.filter(conflict(first, second)).select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))
    keep = first_independent(nodes, edges)
    return out.unionByName(nodes.join(keep, "node", "left_semi").select(*items.columns))


def greedy_replace(
    items: DataFrame,
    page: str,
    order: list[str],
    same: Conflict,
    better: Conflict,
    limit: int = PAGE_ROWS,
    cell: int = 128,
) -> DataFrame:
    """Like :func:`greedy_keep`, but a better later row takes the place of the kept one.

    ``same`` is symmetric and holds only for intersecting boxes, so rows interact
    only inside a connected component of it; pages above ``limit`` are folded
    component by component.
    """
    small, large = split_by_size(items, page, limit)

    def fold(df: DataFrame, group: str) -> DataFrame:
        arrays = _page_arrays(df, group, order)

        def step(acc: Column, x: Column) -> Column:
            def place(at: Column) -> Column:
                swapped = F.transform(acc, lambda k, i: F.when((i + 1 == at) & better(x, k), x).otherwise(k))
                return F.when(at == 0, F.concat(acc, F.array(x))).otherwise(swapped)

            return let(F.array_position(F.transform(acc, lambda k: same(k, x)), True), place)

        kept = F.aggregate("items", F.filter("items", lambda x: F.lit(False)), step)
        return _explode_kept(arrays, group, kept, df.columns)

    out = fold(small, page)
    if large is None:
        return out
    nodes = large.withColumn("node", F.struct(page, *order))
    pairs = grid_join(nodes, nodes, page, cell).filter(F.col("a_node") < F.col("b_node"))
    fields = [c for c in items.columns if c != page]
    first, second = (F.struct(*[F.col(f"{p}{c}").alias(c) for c in fields]) for p in ("a_", "b_"))
    edges = pairs.filter(same(first, second)).select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))
    parts = nodes.join(connected_components(edges), "node", "left")
    parts = parts.withColumn("component", F.coalesce("component", "node")).drop("node")
    return out.unionByName(fold(parts, "component").select(*items.columns))
