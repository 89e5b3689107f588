"""Building blocks that keep per-page and per-key work spread out when one key is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkstone.functions.geometry import intersection
from inkstone.session import cut_lineage

# A table up to this many rows is broadcast, once they have been counted.
BROADCAST_ROWS = 200_000
# A page up to this many distinct boxes is handled inside one row; larger ones
# are split into independent pieces first.
PAGE_ROWS = 512


def position_by_bucket(df: DataFrame, keys: list[str], bucket: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based position within ``keys``, sorted by ``bucket`` columns then ``order``.

    Equals row_number over the whole key, but sorts only inside a bucket: the
    offset of each bucket comes from a pre-aggregated count, so a key holding a
    third of the table is still sorted by many tasks.
    """
    counts = df.groupBy(*keys, *bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, *bucket).orderBy(*order)
    ranked = df.withColumn("_inside", F.row_number().over(inside))
    joined = ranked.alias("r").join(
        offsets.alias("o"),
        [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in keys + bucket],
    )
    return joined.select("r.*", "_before").withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """At most ``n`` rows per key. The limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key by partial aggregation, smallest ``order`` first."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def measured_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as the lookup side of a join: computed once, broadcast up to ``rows`` counted rows, else met in a merge join.

    The planner's own guess takes exploded texts for no larger than their file and would broadcast those instead.
    """
    held = cut_lineage(df)
    return F.broadcast(held) if held.count() <= rows else held.hint("merge")


def grid_join(left: DataFrame, right: DataFrame, page: str = "page_id", cell: int = 128) -> DataFrame:
    """Intersecting boxes of one page, left columns prefixed a_, right columns b_, each pair once.

    Boxes meet in grid cells and a pair is emitted by the one cell that holds
    the upper-left corner of its intersection, so a crowded page is spread over
    its cells and distant boxes never meet.
    """

    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))

    def side(df: DataFrame, p: str) -> DataFrame:
        gridded = df.withColumn("cx", F.explode(cells("x1", "x2"))).withColumn("cy", F.explode(cells("y1", "y2")))
        return gridded.select(page, "cx", "cy", *[F.col(c).alias(f"{p}{c}") for c in df.columns if c != page])

    owner_x = F.floor(F.greatest("a_x1", "b_x1") / cell)
    owner_y = F.floor(F.greatest("a_y1", "b_y1") / cell)
    return (
        side(left, "a_")
        .join(side(right, "b_"), [page, "cx", "cy"])
        .filter((owner_x == F.col("cx")) & (owner_y == F.col("cy")) & (intersection() > 0))
        .drop("cx", "cy")
    )


def grid_pairs(items: DataFrame, page: str = "page_id", item: str = "item", cell: int = 128) -> DataFrame:
    """Intersecting pairs within one table, a_<item> < b_<item>."""
    return grid_join(items, items, page, cell).filter(F.col(f"a_{item}") < F.col(f"b_{item}"))


def split_by_size(df: DataFrame, page: str, limit: int = PAGE_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(pages that fit in a row, pages that do not or None when there are none)."""
    large = df.groupBy(page).count().filter(F.col("count") > limit).select(page)
    if large.isEmpty():
        return df, None
    large = cut_lineage(large)
    return df.join(large, page, "left_anti"), df.join(large, page, "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges with columns src and dst; component is its smallest node.

    Each round takes the smallest label around a node and then the label of that
    label. Rounds end with a reliable checkpoint, so the plan stays short.
    """
    both = cut_lineage(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("label"))
    labels = cut_lineage(labels)
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("near")), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        hopped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = hopped.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = cut_lineage(
            hopped.join(above, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        )
        labels = moved.select("node", "label")
        if moved.filter(F.col("label") < F.col("old")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes a one-by-one greedy pass would keep.

    ``nodes`` has ``node`` whose natural order is the pass order; ``edges`` has
    src < dst for conflicting nodes. A node is kept once no earlier conflicting
    node is undecided, so all of a round's nodes are decided in parallel.
    """
    live = cut_lineage(nodes.select("node"))
    edges = cut_lineage(edges.select("src", "dst"))
    kept = None
    while not live.isEmpty():
        open_edges = edges.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(
            live.withColumnRenamed("node", "dst"), "dst", "left_semi"
        )
        keep = cut_lineage(live.join(open_edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        gone = open_edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
        kept = keep if kept is None else kept.union(keep)
        live = cut_lineage(live.join(keep.union(gone).distinct(), "node", "left_anti"))
    return kept if kept is not None else nodes.select("node")
