"""Read lines of a page: vector lines, repeats, continuations, recovery and word boxes.

Line tables have page_id, item (order within the page), text and either a vector
fx, fy, tx, ty or a box x1, y1, x2, y2, both nullable.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkstone.functions.geometry import (
    half_up,
    struct_iou,
    struct_overlap_smaller,
    upper_median,
)
from inkstone.functions.text import char_overlap, characters, has_han, no_space
from inkstone.operators.common import PAGE_ROWS, connected_components, split_by_size, top_per_key
from inkstone.operators.greedy import greedy_keep, kept_by_iou
from inkstone.session import cut_lineage

BOX = ["x1", "y1", "x2", "y2"]


def snap_angle(a: Column) -> Column:
    """Angles within 20 degrees of an axis are that axis."""
    return F.when(F.abs(a) <= 20, 0.0).when(a.between(70, 110), 90.0).when(a.between(-110, -70), -90.0).otherwise(a)


def vector_lines(raw: DataFrame) -> DataFrame:
    """Parsed answer items (page_id, item, text, from, to, box arrays, dir, w, h) to pixel lines.

    A vector must lie in -60..1060 on the grid and be 3 long; with a sound box it
    turns about the box centre and takes its length from the box. Items with only
    a box pass through untouched; the rest go.
    """

    def numbers(name: str, n: int) -> Column:
        return (F.size(name) == n) & ~F.exists(name, lambda v: v.isNull())

    def at(name: str, i: int) -> Column:
        return F.get(F.col(name), F.lit(i))

    text = F.trim("text")
    rows = raw.filter(F.coalesce(text, F.lit("")) != "").withColumn("text", text)
    rows = rows.withColumn("_boxed", F.coalesce(numbers("box", 4) & (at("box", 0) < at("box", 2)) & (at("box", 1) < at("box", 3)), F.lit(False)))
    inside = F.forall(F.concat("from", "to"), lambda v: v.between(-60, 1060))
    rows = rows.withColumn("_vector", F.coalesce(numbers("from", 2) & numbers("to", 2) & inside, F.lit(False)))
    dx, dy = at("to", 0) - at("from", 0), at("to", 1) - at("from", 1)
    rows = rows.withColumn("_len", F.when(F.col("_vector"), F.sqrt(dx * dx + dy * dy)))
    rows = rows.filter(~F.col("_vector") | (F.col("_len") >= 3)).filter(F.col("_vector") | F.col("_boxed"))
    angle = F.when(F.length("text") == 1, 0.0).otherwise(snap_angle(half_up(F.degrees(F.atan2(dy, dx))).cast("double")))
    rows = rows.withColumn("angle", F.when(F.col("_vector"), angle))
    sx, sy = F.coalesce(F.col("w") / 1000, F.lit(1.0)), F.coalesce(F.col("h") / 1000, F.lit(1.0))
    bw, bh = at("box", 2) - at("box", 0), at("box", 3) - at("box", 1)
    span = F.when(F.abs("angle") <= 20, bw).when(F.abs("angle") >= 70, bh).otherwise(F.sqrt(bw * bw + bh * bh))
    both = F.col("_vector") & F.col("_boxed") & (span * F.greatest(sx, sy) >= 3)
    rows = rows.withColumn("_both", F.coalesce(both, F.lit(False))).withColumn("_span", span)
    cx, cy = (at("box", 0) + at("box", 2)) / 2, (at("box", 1) + at("box", 3)) / 2
    ux, uy = F.cos(F.radians("angle")) * F.col("_span") / 2, F.sin(F.radians("angle")) * F.col("_span") / 2
    ends = {
        "fx": F.when(F.col("_both"), (cx - ux) * sx).otherwise(at("from", 0) * sx),
        "fy": F.when(F.col("_both"), (cy - uy) * sy).otherwise(at("from", 1) * sy),
        "tx": F.when(F.col("_both"), (cx + ux) * sx).otherwise(at("to", 0) * sx),
        "ty": F.when(F.col("_both"), (cy + uy) * sy).otherwise(at("to", 1) * sy),
    }
    for name, value in ends.items():
        rows = rows.withColumn(name, F.when(F.col("_vector"), value))
    fx, fy, tx, ty = (F.col(c) for c in ("fx", "fy", "tx", "ty"))
    pad = F.sqrt((tx - fx) * (tx - fx) + (ty - fy) * (ty - fy)) / F.greatest(F.lit(1), F.length("text")) * 0.5
    padded = {
        "x1": half_up(F.least(fx, tx) - pad),
        "y1": half_up(F.least(fy, ty) - pad),
        "x2": half_up(F.greatest(fx, tx) + pad),
        "y2": half_up(F.greatest(fy, ty) + pad),
    }
    for i, name in enumerate(BOX):
        scaled = at("box", i) * (sx if i % 2 == 0 else sy)
        value = F.when(F.col("_both"), scaled).when(F.col("_vector"), padded[name].cast("double")).otherwise(at("box", i))
        rows = rows.withColumn(name, value)
    given = F.when(F.col("dir").isin("v", "h"), F.col("dir"))
    dir_ = F.when(F.col("_vector"), F.when(F.abs("angle") > 45, "v").otherwise("h")).otherwise(given)
    return rows.select("page_id", "item", "text", "fx", "fy", "tx", "ty", "angle", *BOX, dir_.alias("dir"))


# ---- repeats ------------------------------------------------------------

def _rereads(x1: list, y1: list, x2: list, y2: list, at: list[int], floor: float) -> list[int]:
    """Places of ``at`` without boxes that repeat an earlier one; those without a box (NaN) stay."""
    kept = set(kept_by_iou(x1, y1, x2, y2, [i for i in at if x1[i] == x1[i]], floor))
    return [i for i in at if i in kept or x1[i] != x1[i]]


def _marching(x1: list, y1: list, at: list[int], tolerance: float) -> bool:
    """Whether three boxes in a row step by one offset; only where every line has a box."""
    if len(at) < 3 or any(x1[i] != x1[i] for i in at):
        return False
    for i, j, k in zip(at, at[1:], at[2:]):
        dx, dy = x1[j] - x1[i], y1[j] - y1[i]
        near = abs(dx - (x1[k] - x1[j])) <= tolerance and abs(dy - (y1[k] - y1[j])) <= tolerance
        if near and (abs(dx) > 0 or abs(dy) > 0):
            return True
    return False


def _healed_in_rows(lines: DataFrame, group: str, floor: float | None, tolerance: float | None, keep: int | None) -> DataFrame:
    """Lines whose ``group`` (of one page and text) fits a row, after the steps that have a limit: one exchange of the lines.

    Boxes alone go to the kernel, and only those of texts that a page has more than once.
    """
    rest = ["item"] + [c for c in lines.columns if c not in ("item", group)]
    texts = lines.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))
    first = F.get("rows", F.lit(0))

    def stay(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, named: pa.Array) -> pa.Array:
        numbers = [c.flatten().to_numpy(zero_copy_only=False).tolist() for c in (x1, y1, x2, y2)]
        found, i = [], 0
        for n, whole in zip(pc.list_value_length(x1).to_pylist(), named.to_pylist()):
            if n is None:
                found.append(None)
                continue
            box, at = [c[i : i + n] for c in numbers], list(range(n))
            i += n
            if floor is not None:
                at = _rereads(*box, at, floor)
            # a line without text is no repeat of another
            if whole and tolerance is not None and _marching(box[0], box[1], at, tolerance):
                at = at[:1]
            if whole and keep is not None and len(at) > keep and 0 < sum(box[0][k] != box[0][k] for k in at):
                at = at[:keep]
            found.append(at)
        return pa.array(found, type=pa.list_(pa.int32()))

    numbers = [F.when(F.size("rows") > 1, F.col("rows")[c].cast("array<double>")) for c in BOX]
    texts = texts.withColumn("_at", F.arrow_udf(stay, "array<int>")(*numbers, first["text"].isNotNull() & first["page_id"].isNotNull()))
    # a text that its page has once stays; what stays is picked before the group is taken apart, so that no row carries its group
    picked = F.when(F.col("_at").isNull(), F.col("rows")).otherwise(F.transform("_at", lambda i: F.get("rows", i)))
    return texts.select(F.explode(picked).alias("_r")).select("_r.*")


def _healed(
    lines: DataFrame, crowded: Callable[[DataFrame], DataFrame], limit: int, floor: float | None = None, tolerance: float | None = None, keep: int | None = None
) -> DataFrame:
    """Lines after the steps that have a limit. A text with up to ``limit`` lines on its page is one row, others go to ``crowded``."""
    columns, steps = lines.columns, (floor, tolerance, keep)
    rows = lines.withColumn("_same", F.struct("page_id", "text"))
    # most pages have fewer lines than one text may have; only on others texts are counted
    small, large = split_by_size(rows, "page_id", limit)
    out = _healed_in_rows(small, "_same", *steps).select(*columns)
    if large is None:
        return out
    few, many = split_by_size(large, "_same", limit)
    out = out.unionByName(_healed_in_rows(few, "_same", *steps).select(*columns))
    return out if many is None else out.unionByName(crowded(many.select(*columns)).select(*columns))


def _rereads_of_crowded(lines: DataFrame, floor: float) -> DataFrame:
    boxed = lines.filter("x1 is not null").withColumn("_same", F.struct("page_id", "text"))
    kept = greedy_keep(boxed, "_same", ["item"], lambda k, x: struct_iou(k, x) >= floor, BOX)
    return kept.drop("_same").unionByName(lines.filter("x1 is null"))


def drop_rereads(lines: DataFrame, floor: float = 0.8, limit: int = PAGE_ROWS) -> DataFrame:
    """Same text at nearly the same box: the first stays. Lines without a box stay."""
    return _healed(lines, lambda many: _rereads_of_crowded(many, floor), limit, floor=floor)


def _marching_of_crowded(lines: DataFrame, tolerance: int) -> DataFrame:
    key = ["page_id", "text"]
    groups = lines.groupBy(*key).agg(F.count("*").alias("n"), F.count("x1").alias("boxed"), F.min("item").alias("first"))
    chains = lines.join(groups.filter("n >= 3 and boxed = n"), key)
    w = Window.partitionBy(*key).orderBy("item")
    near = F.lit(True)
    moved = F.lit(False)
    for c in ("x1", "y1"):
        before, last = F.lag(c, 1).over(w) - F.lag(c, 2).over(w), F.col(c) - F.lag(c, 1).over(w)
        near = near & (F.abs(before - last) <= tolerance)
        moved = moved | (F.abs(before) > 0)
    marching = chains.withColumn("_near", near & moved).groupBy(*key).agg(F.bool_or("_near").alias("_m"), F.first("first").alias("_first"))
    out = lines.join(marching.filter("_m"), key, "left")
    return out.filter(F.col("_m").isNull() | (F.col("item") == F.col("_first"))).drop("_m", "_first")


def marching_clones(lines: DataFrame, tolerance: int = 15, limit: int = PAGE_ROWS) -> DataFrame:
    """Same text stepping by a constant offset three times in a row: the first stays.

    Only texts with three or more boxed lines and no boxless one are looked at.
    """
    return _healed(lines, lambda many: _marching_of_crowded(many, tolerance), limit, tolerance=tolerance)


def _flood_of_crowded(lines: DataFrame, keep: int) -> DataFrame:
    key = ["page_id", "text"]
    groups = lines.groupBy(*key).agg(F.count("*").alias("_n"), F.count("x1").alias("_boxed"))
    flooded = groups.filter((F.col("_n") > keep) & (F.col("_boxed") < F.col("_n"))).select(*key)
    capped = top_per_key(lines.join(flooded, key, "left_semi"), key, [F.col("item")], keep, "_rank").drop("_rank")
    return lines.join(flooded, key, "left_anti").unionByName(capped.select(*lines.columns))


def boxless_flood_cap(lines: DataFrame, keep: int = 3, limit: int = PAGE_ROWS) -> DataFrame:
    """More than three lines of one text, some boxless: the first three stay."""
    return _healed(lines, lambda many: _flood_of_crowded(many, keep), limit, keep=keep)


def heal_repetition(lines: DataFrame, limit: int = PAGE_ROWS) -> DataFrame:
    """Re-reads and decoding loops out, genuine repeats in. All steps are taken where the lines of a text meet once."""

    def crowded(many: DataFrame) -> DataFrame:
        return _flood_of_crowded(_marching_of_crowded(_rereads_of_crowded(many, 0.8), 15), 3)

    return _healed(lines, crowded, limit, floor=0.8, tolerance=15, keep=3)


def drop_duplicate_lines(lines: DataFrame, similar: float = 0.85, overlap: float = 0.3) -> DataFrame:
    """Long lines that repeat an earlier kept line in text and place."""
    boxed = lines.filter("x1 is not null")

    def repeats(k: Column, x: Column) -> Column:
        return (
            (F.length(x.text) >= 8)
            & (struct_overlap_smaller(k, x) >= overlap)
            & (char_overlap(k.text, x.text) >= similar)
        )

    kept = greedy_keep(boxed, "page_id", ["item"], repeats, BOX + ["text"])
    return kept.unionByName(lines.filter("x1 is null"))


# ---- continuations ------------------------------------------------------

def _chain_group(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf.sort_values("item").to_dict("records")

    def joins(a: dict, b: dict) -> bool:
        reach = 0.8 * math.hypot(a["tx"] - a["fx"], a["ty"] - a["fy"]) / max(1, len(a["text"]))
        if math.hypot(b["fx"] - a["tx"], b["fy"] - a["ty"]) > reach:
            return False
        turn = abs(math.degrees(math.atan2(a["ty"] - a["fy"], a["tx"] - a["fx"]) - math.atan2(b["ty"] - b["fy"], b["tx"] - b["fx"])))
        return min(turn, 360 - turn) <= 15

    # pairs in the order of their places; one that no longer holds is told when its turn comes
    pairs = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and joins(a, b)]
    heapq.heapify(pairs)
    gone: set[int] = set()
    while pairs:
        i, j = heapq.heappop(pairs)
        a, b = rows[i], rows[j]
        if i in gone or j in gone or not joins(a, b):
            continue
        a.update(
            text=a["text"] + b["text"], tx=b["tx"], ty=b["ty"],
            x1=min(a["x1"], b["x1"]), y1=min(a["y1"], b["y1"]), x2=max(a["x2"], b["x2"]), y2=max(a["y2"], b["y2"]),
        )
        gone.add(j)
        # only pairs of the merged line can have come about
        for k, c in enumerate(rows):
            if k != i and k not in gone:
                if joins(a, c):
                    heapq.heappush(pairs, (i, k))
                if joins(c, a):
                    heapq.heappush(pairs, (k, i))
    return pd.DataFrame([r for k, r in enumerate(rows) if k not in gone], columns=pdf.columns)


def _pages_with_tail(vectors: DataFrame, cell: int = 64) -> DataFrame:
    """Pages where some line already continues another; on the others nothing ever merges."""
    dx, dy = F.col("tx") - F.col("fx"), F.col("ty") - F.col("fy")
    rows = vectors.select(
        "page_id", "item", "fx", "fy", "tx", "ty", F.atan2(dy, dx).alias("turn"),
        (0.8 * F.sqrt(dx * dx + dy * dy) / F.greatest(F.lit(1), F.length("text"))).alias("reach"),
    )

    def span(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - F.col("reach")) / cell), F.floor((F.col(c) + F.col("reach")) / cell)))

    ends = rows.withColumn("cx", span("tx")).withColumn("cy", span("ty"))
    starts = rows.select(
        "page_id", F.col("item").alias("b"), F.col("fx").alias("bx"), F.col("fy").alias("by"), F.col("turn").alias("b_turn"),
        F.floor(F.col("fx") / cell).alias("cx"), F.floor(F.col("fy") / cell).alias("cy"),
    )
    off = F.abs(F.degrees(F.col("turn") - F.col("b_turn")))
    return (
        ends.join(starts, ["page_id", "cx", "cy"])
        .filter(F.col("item") != F.col("b"))
        .filter(F.sqrt(F.pow(F.col("bx") - F.col("tx"), 2) + F.pow(F.col("by") - F.col("ty"), 2)) <= F.col("reach"))
        .filter(F.least(off, 360 - off) <= 15)
        .select("page_id")
        .distinct()
    )


def _chain_in_pieces(lines: DataFrame) -> DataFrame:
    """Chains of crowded pages: a join on cells of the widest possible reach finds the lines that can merge;
    only their connected pieces leave the JVM."""
    vectors = lines.filter("fx is not null")
    length = F.sqrt(F.pow(F.col("tx") - F.col("fx"), 2) + F.pow(F.col("ty") - F.col("fy"), 2))
    # a merged line's pitch stays below five times the page's largest
    reach = vectors.groupBy("page_id").agg((4 * F.max(length / F.greatest(F.lit(1), F.length("text"))) + 1).alias("_r"))
    placed = vectors.join(reach, "page_id").select("page_id", "item", "fx", "fy", "tx", "ty", "_r")

    def around(c: str) -> Column:
        cell = F.floor(F.col(c) / F.col("_r"))
        return F.explode(F.sequence(cell - 1, cell + 1))

    placed = placed.join(_pages_with_tail(vectors), "page_id", "left_semi")
    ends = placed.select("page_id", F.col("item").alias("a"), "tx", "ty", "_r").withColumn("cx", around("tx")).withColumn("cy", around("ty"))
    starts = placed.select(
        "page_id", F.col("item").alias("b"), F.col("fx").alias("bx"), F.col("fy").alias("by"),
        F.floor(F.col("fx") / F.col("_r")).alias("cx"), F.floor(F.col("fy") / F.col("_r")).alias("cy"),
    )
    near = ends.join(starts, ["page_id", "cx", "cy"]).filter("a <> b").filter(
        F.sqrt(F.pow(F.col("bx") - F.col("tx"), 2) + F.pow(F.col("by") - F.col("ty"), 2)) <= F.col("_r")
    )
    edges = cut_lineage(near.select("page_id", "a", "b"))
    touched = edges.select("page_id", F.explode(F.array("a", "b")).alias("item")).distinct()
    columns = ["page_id", *[c for c in lines.columns if c != "page_id"]]
    apart = lines.join(touched, ["page_id", "item"], "left_anti").select(*columns)
    close = lines.join(touched, ["page_id", "item"], "left_semi").select(*columns)
    close = cut_lineage(close)
    fields = ", ".join(f"{c} {close.schema[c].dataType.simpleString()}" for c in columns)
    pairs = edges.select(F.struct("page_id", F.col("a").alias("item")).alias("src"), F.struct("page_id", F.col("b").alias("item")).alias("dst"))
    parts = close.withColumn("node", F.struct("page_id", "item")).join(connected_components(pairs), "node").drop("node")
    merged = parts.groupBy("component").applyInPandas(lambda pdf: _chain_group(pdf.drop(columns=["component"])), fields)
    return apart.unionByName(merged)


def _page_chains(fx: pa.Array, fy: pa.Array, tx: pa.Array, ty: pa.Array, chars: pa.Array) -> pa.Array:
    """For the lines of each page, in order, the places of the lines that each one left takes up, itself first."""
    pages = zip(*(c.to_pylist() for c in (fx, fy, tx, ty, chars)))
    return pa.array([_merge_order(*page) for page in pages], type=pa.list_(pa.list_(pa.int32())))


def _merge_order(fx: list, fy: list, tx: list, ty: list, chars: list) -> list[list[int]]:
    """The same passes as :func:`_chain_group` over numbers alone; lines without a vector stay apart."""
    n = len(fx)
    reach, turn = [0.0] * n, [0.0] * n
    live = [i for i in range(n) if None not in (fx[i], fy[i], tx[i], ty[i])]

    def measure(i: int) -> None:
        dx, dy = tx[i] - fx[i], ty[i] - fy[i]
        reach[i], turn[i] = 0.8 * math.hypot(dx, dy) / max(1, chars[i]), math.atan2(dy, dx)

    def joins(i: int, j: int) -> bool:
        if math.hypot(fx[j] - tx[i], fy[j] - ty[i]) > reach[i]:
            return False
        off = abs(math.degrees(turn[i] - turn[j]))
        return min(off, 360 - off) <= 15

    for i in live:
        measure(i)
    pairs = [(i, j) for i in live for j in live if i != j and joins(i, j)]
    taken = [[i] for i in range(n)]
    gone: set[int] = set()
    while pairs:
        i, j = heapq.heappop(pairs)
        if i in gone or j in gone or not joins(i, j):
            continue
        taken[i] += taken[j]
        tx[i], ty[i], chars[i] = tx[j], ty[j], chars[i] + chars[j]
        measure(i)
        gone.add(j)
        for k in live:
            if k != i and k not in gone:
                if joins(i, k):
                    heapq.heappush(pairs, (i, k))
                if joins(k, i):
                    heapq.heappush(pairs, (k, i))
    return [t for i, t in enumerate(taken) if i not in gone]


def _chain_in_rows(lines: DataFrame) -> DataFrame:
    """Chains of pages that fit a row: one exchange of the lines, numbers alone go to the kernel."""
    fields = [c for c in lines.columns if c not in ("page_id", "item")]
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("item", *fields))).alias("rows"))
    numbers = [F.transform(F.col("rows")[c], lambda v: v.cast("double")) for c in ("fx", "fy", "tx", "ty")]
    chars = F.transform(F.col("rows")["text"], lambda t: F.coalesce(F.length(t), F.lit(0)))
    chains = F.arrow_udf(_page_chains, "array<array<int>>")
    heads = pages.select("page_id", "rows", F.explode(chains(*numbers, chars)).alias("_at"))
    heads = heads.select("page_id", F.transform("_at", lambda i: F.get("rows", i)).alias("_taken"))
    first, last = F.get("_taken", F.lit(0)), F.element_at("_taken", -1)

    def joined(c: str) -> Column:
        if c == "text":
            together = F.array_join(F.col("_taken")["text"], "")
        elif c in ("tx", "ty"):
            return last[c]
        elif c in BOX:
            together = (F.array_min if c in ("x1", "y1") else F.array_max)(F.col("_taken")[c])
        else:
            return first[c]
        return F.when((F.size("_taken") > 1) & first[c].isNotNull(), together).otherwise(first[c])

    return heads.select("page_id", *[(first[c] if c == "item" else joined(c)).alias(c) for c in lines.columns if c != "page_id"])


def chain_continuations(lines: DataFrame, limit: int = PAGE_ROWS) -> DataFrame:
    """Tails that start where a line ends, in its direction, are appended to it.

    Merging depends on order, so it runs line by line. A page of ordinary size is
    one row; on pages above ``limit`` only lines whose ends come near another's start
    can ever merge, and each connected piece of those is one group.
    """
    columns = ["page_id", *[c for c in lines.columns if c != "page_id"]]
    small, large = split_by_size(lines, "page_id", limit)
    out = _chain_in_rows(small).select(*columns)
    return out if large is None else out.unionByName(_chain_in_pieces(large).select(*columns))


# ---- recovery -----------------------------------------------------------

def neighbour_between(lines: DataFrame, slots: DataFrame) -> DataFrame:
    """Quad halfway between two ordered lines: slots has page_id, slot, i, j (positions)."""
    medians = lines.withColumn("_w", F.col("x2") - F.col("x1")).withColumn("_h", F.col("y2") - F.col("y1")).groupBy("page_id").agg(
        upper_median("_w").alias("mw"), upper_median("_h").alias("mh")
    )

    def side(p: str, at: str) -> DataFrame:
        return lines.select("page_id", F.col("position").alias(at), *[F.col(c).alias(f"{p}{c}") for c in [*BOX, "dir"]])

    rows = slots.join(side("a_", "i"), ["page_id", "i"]).join(side("b_", "j"), ["page_id", "j"]).join(medians, "page_id")
    upright = (F.col("a_dir") == "v") & (F.col("b_dir") == "v")
    cx, cy = (F.col("a_x1") + F.col("b_x1")) / 2, (F.col("a_y1") + F.col("b_y1")) / 2
    return rows.select(
        "page_id",
        "slot",
        F.when(upright, cx - F.col("mw") / 2).otherwise(F.least("a_x1", "b_x1").cast("double")).alias("x1"),
        F.when(upright, F.least("a_y1", "b_y1").cast("double")).otherwise(cy - F.col("mh") / 2).alias("y1"),
        F.when(upright, cx + F.col("mw") / 2).otherwise(F.greatest("a_x2", "b_x2").cast("double")).alias("x2"),
        F.when(upright, F.greatest("a_y2", "b_y2").cast("double")).otherwise(cy + F.col("mh") / 2).alias("y2"),
    )


def trend_insert_position(lines: DataFrame, recovered: DataFrame) -> DataFrame:
    """Where a recovered line goes among lines of its direction, by the page's own trend.

    ``lines`` has page_id, position (0-based), dir and box; ``recovered`` has
    page_id, rec, dir and box. A tie puts it after the last line of its direction.
    """

    def across(p: str = "") -> Column:
        x, y = F.col(f"{p}x1") + F.col(f"{p}x2"), F.col(f"{p}y1") + F.col(f"{p}y2")
        return F.when(F.col(f"{p}dir") == "v", x).otherwise(y) / 2

    spots = lines.filter("x1 is not null").select("page_id", "dir", "position", across().alias("at"))
    w = Window.partitionBy("page_id", "dir").orderBy("position")
    trend = (
        spots.withColumn("_d", F.signum(F.col("at") - F.lag("at").over(w)))
        .groupBy("page_id", "dir")
        .agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("trend"), F.max("position").alias("last"))
    )
    pages = lines.groupBy("page_id").agg(F.count("*").alias("page_lines"))
    rec = recovered.withColumn("rec_at", across()).select("page_id", "rec", "dir", "rec_at")
    beyond = F.when(F.col("trend") < 0, F.col("at") < F.col("rec_at")).when(F.col("trend") > 0, F.col("at") > F.col("rec_at"))
    first = (
        rec.join(trend, ["page_id", "dir"])
        .join(spots, ["page_id", "dir"])
        .groupBy("page_id", "rec")
        .agg(F.min(F.when(beyond, F.col("position"))).alias("first"))
    )
    out = rec.join(trend, ["page_id", "dir"], "left").join(first, ["page_id", "rec"], "left").join(pages, "page_id", "left")
    target = F.coalesce("first", F.col("last") + 1, "page_lines", F.lit(0))
    return out.select("page_id", "rec", target.cast("int").alias("insert_at"))


def snap_to_neighbours(lines: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposal quads re-cut on their neighbours' angle and pitch.

    ``proposals`` has page_id, rec, pts, n, vertical and axis; neighbours are lines
    of the same direction with an angle and three characters.
    """
    fit = lines.filter((F.coalesce("angle", F.lit(0)) != 0) & F.col("x1").isNotNull() & (F.length("text") >= 3))
    fit = fit.withColumn("vertical", F.abs("angle") >= 45)
    side = F.when(F.col("vertical"), F.col("y2") - F.col("y1")).otherwise(F.col("x2") - F.col("x1"))
    medians = fit.withColumn("_pitch", side / F.length("text")).groupBy("page_id", "vertical").agg(
        upper_median("angle").alias("near_angle"), upper_median("_pitch").alias("near_pitch")
    )
    rows = proposals.join(medians, ["page_id", "vertical"], "left")
    turn = F.abs(F.pmod(F.col("near_angle") - F.col("axis") + 540, F.lit(360.0)) - 180)
    angle = F.when(turn <= 15, F.col("near_angle")).otherwise(F.col("axis"))
    xs, ys = F.transform("pts", lambda p: p.x), F.transform("pts", lambda p: p.y)
    own = F.when(F.col("vertical"), F.array_max(ys) - F.array_min(ys)).otherwise(F.array_max(xs) - F.array_min(xs))
    pitch = F.greatest(F.lit(30.0), F.coalesce("near_pitch", own / F.greatest(F.lit(1), F.col("n"))))
    rows = rows.select(
        "page_id", "rec", "n", angle.alias("angle"), pitch.alias("pitch"),
        (F.aggregate(xs, F.lit(0.0), lambda s, v: s + v) / 4).alias("cx"),
        (F.aggregate(ys, F.lit(0.0), lambda s, v: s + v) / 4).alias("cy"),
    )
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    half_len, half_wid = F.col("pitch") * F.col("n") / 2, F.greatest(F.lit(20.0), F.col("pitch") * 0.7)

    def point(a: Column, p: Column) -> Column:
        return F.struct((F.col("cx") + a * c - p * s).alias("x"), (F.col("cy") + a * s + p * c).alias("y"))

    corners = [point(-half_len, -half_wid), point(half_len, -half_wid), point(half_len, half_wid), point(-half_len, half_wid)]
    return rows.withColumn("pts", F.array(*corners))


def snap_pitch(lines: DataFrame) -> DataFrame:
    """``length`` of each vector line on the page's median pitch when its own is within about a factor of two."""
    own_len = F.sqrt(F.pow(F.col("tx") - F.col("fx"), 2) + F.pow(F.col("ty") - F.col("fy"), 2))
    rows = lines.filter("fx is not null").withColumn("raw_length", own_len)
    rows = rows.withColumn("pitch", F.col("raw_length") / F.greatest(F.lit(1), F.length("text")))
    medians = rows.groupBy("page_id").agg(upper_median("pitch").alias("median_pitch"))
    near = (F.col("median_pitch") > 0) & (F.col("pitch") >= F.col("median_pitch") * 0.45) & (F.col("pitch") <= F.col("median_pitch") * 2.2)
    return rows.join(medians, "page_id").withColumn(
        "length", F.when(near, F.col("median_pitch") * F.length("text")).otherwise(F.col("raw_length"))
    )


def longest_uncovered(proposals: DataFrame, lines: DataFrame, n: int = 3, similar: float = 0.6) -> DataFrame:
    """Proposals of six or more characters that no line of four resembles, longest first.

    The proposals of a page come from one model answer, so they are few; equal
    texts are compared once.
    """
    rows = proposals.withColumn("text", no_space(F.col("text"))).filter(F.length("text") >= 6)
    unique = rows.select("page_id", "text").distinct().alias("p")
    seen = lines.filter(F.length("text") >= 4).select("page_id", F.col("text").alias("line")).distinct().alias("l")
    open_ = unique.join(
        seen, (F.col("p.page_id") == F.col("l.page_id")) & (char_overlap(F.col("line"), F.col("text")) >= similar), "left_anti"
    )
    return top_per_key(rows.join(open_, ["page_id", "text"], "left_semi"), ["page_id"], [F.length("text").desc(), F.col("rec")], n)


def verify_proposals(reads: DataFrame) -> DataFrame:
    """``verified``: the crop read (column read) holds three quarters of the proposal and is no soup of lines."""
    text = no_space(F.col("read"))
    recall = char_overlap(text, F.col("text"))
    soup = F.length(text) > F.length("text") * 3 + 4
    return reads.withColumn("recall", F.round(recall, 6)).withColumn("verified", (text != "") & (recall >= 0.75) & ~soup)


def drop_recovered_duplicates(recovered: DataFrame, lines: DataFrame, similar: float = 0.7) -> DataFrame:
    """Recovered reads without those that repeat a line; both at least four characters."""
    seen = lines.filter(F.length("text") >= 4).select("page_id", F.col("text").alias("line")).distinct().alias("l")
    r = recovered.alias("r")
    same = (
        (F.col("r.page_id") == F.col("l.page_id"))
        & (F.length("r.text") >= 4)
        & (char_overlap(F.col("line"), F.col("r.text")) >= similar)
    )
    return r.join(seen, same, "left_anti")


def recovery_meter(proposals: DataFrame) -> DataFrame:
    """Proposals and verified reads per page, and which label that page is served under."""
    pages = proposals.groupBy("page_id").agg(
        F.count_if("proposed").alias("proposals"), F.count_if("verified").alias("verified")
    )
    label = (
        F.when(F.col("verified") > 0, F.concat(F.lit("pipeline2+recovered ("), F.col("verified").cast("string"), F.lit(")")))
        .when(F.col("proposals") > 0, "pipeline2+phantom")
        .otherwise("pipeline2")
    )
    return pages.withColumn("served_by", label)


def meter_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("served_by").agg(
        F.count("*").alias("pages"), F.sum("proposals").alias("proposals"), F.sum("verified").alias("verified")
    )


def tile_gap_text(reads: DataFrame, known: DataFrame) -> DataFrame:
    """Recovered region texts to lines: split at newlines, box tiled along its longer axis.

    ``reads`` has page_id, region, text and box; ``known`` has page_id and the
    page's text. Parts without Han or already contained in the page go.
    """
    parts = F.transform(F.split("text", r"\n+"), lambda t: F.trim(t))
    fresh = F.filter(parts, lambda t: has_han(t) & ~F.contains(F.coalesce(F.col("known_text"), F.lit("")), no_space(t)))
    rows = reads.join(known, "page_id", "left").filter(
        has_han(F.col("text")) & ~F.contains(F.coalesce("known_text", F.lit("")), no_space(F.col("text")))
    )
    rows = rows.withColumn("parts", fresh).select("*", F.size("parts").alias("k"), F.posexplode("parts").alias("part", "line"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    tall = (h > w * 1.3) & (F.length("line") > 1)

    def cut(low: str, size: Column, step: Column) -> Column:
        return half_up(F.col(low) + size / F.col("k") * step)

    several = F.col("k") > 1
    here, after = F.col("part"), F.col("part") + 1
    return rows.select(
        "page_id", "region", "part", F.col("line").alias("text"),
        F.when(several & ~tall, cut("x1", w, here)).otherwise(F.col("x1")).alias("x1"),
        F.when(several & tall, cut("y1", h, here)).otherwise(F.col("y1")).alias("y1"),
        F.when(several & ~tall, cut("x1", w, after)).otherwise(F.col("x2")).alias("x2"),
        F.when(several & tall, cut("y1", h, after)).otherwise(F.col("y2")).alias("y2"),
        F.when(tall, "v").otherwise("h").alias("dir"),
    )


# ---- word boxes ---------------------------------------------------------

#: Tokens of a line that are put together at once to count the characters before each.
BLOCK = 64


def token_offsets(lines: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row per token of each line's token array, with the characters before it and in the line."""
    rest = [c for c in lines.columns if c != tokens]

    def characters_of(words: str, n: Column) -> Column:
        return F.length(F.array_join(F.slice(words, F.lit(1), n), ""))

    total = F.greatest(F.lit(1), F.length(F.array_join(tokens, "")))
    # a line is cut into blocks first, so that no token's row carries a long line
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(BLOCK)))
    blocks = lines.select(*rest, tokens, total.alias("total"), F.explode(starts).alias("_from"))
    before = F.when(F.col("_from") > 0, characters_of(tokens, F.col("_from"))).otherwise(F.lit(0))
    blocks = blocks.select(*rest, "total", "_from", before.alias("_before"), F.slice(tokens, F.col("_from") + 1, F.lit(BLOCK)).alias("_block"))
    rows = blocks.select(*rest, "total", "_from", "_before", "_block", F.posexplode("_block").alias("_k", "token"))
    start = F.col("_before") + characters_of("_block", F.col("_k"))
    return rows.select(*rest, "total", (F.col("_from") + F.col("_k")).alias("token_no"), "token", start.alias("start"))


def word_boxes(tokens: DataFrame) -> DataFrame:
    """Boxes of tokens by character count along their line; unknown tokens give one row per character.

    Rows come from :func:`token_offsets` with the line box, ``dir``, ``known``, and
    optionally the line vector, ``char_boxes`` (array of boxes) and the snapped ``length``. Measured
    character boxes win, then the line vector, then the line box.
    """
    n = F.length("token")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    down = F.col("dir") == "v"
    t0, t1 = F.col("start") / F.col("total"), (F.col("start") + n) / F.col("total")
    # a token's box is found once, before its characters become rows
    rows = tokens.select(
        "*",
        F.when(down, F.col("x1")).otherwise(half_up(F.col("x1") + w * t0)).alias("_x1"),
        F.when(down, F.col("x2")).otherwise(half_up(F.col("x1") + w * t1)).alias("_x2"),
        F.when(down, half_up(F.col("y1") + h * t0)).otherwise(F.col("y1")).alias("_y1"),
        F.when(down, half_up(F.col("y1") + h * t1)).otherwise(F.col("y2")).alias("_y2"),
    )
    has = set(tokens.columns)
    measures = [c for c in ("char_boxes", "length", "fx", "fy", "tx", "ty", "start", "total") if c in has] if has & {"char_boxes", "fx"} else []
    kept = ["page_id", "item", "token_no", "token", "known", "dir", "_x1", "_y1", "_x2", "_y2", *measures]
    # a known token is one row, and an empty unknown one none
    last = F.when(F.col("known"), F.lit(0)).when(n > 0, n - 1)
    rows = rows.select(*kept, F.explode(F.sequence(F.lit(0), last)).alias("char_no"))
    known, at = F.col("known"), F.col("char_no")
    word = F.when(known, F.col("token")).otherwise(F.substring("token", at + 1, F.lit(1)))
    step = (F.col("_x2") - F.col("_x1")) / n
    cut1 = F.when(known, F.col("_x1")).otherwise(half_up(F.col("_x1") + step * at))
    cut2 = F.when(known, F.col("_x2")).otherwise(half_up(F.col("_x1") + step * (at + 1)))
    boxes = {"x1": cut1, "y1": F.col("_y1"), "x2": cut2, "y2": F.col("_y2")}
    begin, size = F.col("start") + at, F.when(known, n).otherwise(F.lit(1))
    none = F.lit(True) if "char_boxes" not in has else F.col("char_boxes").isNull()
    picked = {c: F.when(none, box) for c, box in boxes.items()}

    if "fx" in has:
        vx, vy = F.col("tx") - F.col("fx"), F.col("ty") - F.col("fy")
        raw = F.sqrt(vx * vx + vy * vy)
        length = F.coalesce("length", raw) if "length" in has else raw
        mid = (begin + size / 2) / F.col("total") * length
        cx, cy, half = F.col("fx") + vx / raw * mid, F.col("fy") + vy / raw * mid, size / F.col("total") * length / 2
        along = {"x1": cx - half, "y1": cy - half, "x2": cx + half, "y2": cy + half}
        picked = {c: F.when(F.col("fx").isNotNull() & none, half_up(along[c])).otherwise(v) for c, v in picked.items()}

    if "char_boxes" in has:
        slice_ = F.slice("char_boxes", begin + 1, size)
        measured = F.col("char_boxes").isNotNull() & (F.size(slice_) > 0) & ~F.exists(slice_, lambda b: b.isNull())

        def edge(c: str) -> Column:
            return (F.array_min if c in ("x1", "y1") else F.array_max)(F.transform(slice_, lambda b: b[c]))

        picked = {c: F.when(measured, edge(c)).otherwise(v) for c, v in picked.items()}

    return rows.select(
        "page_id", "item", "token_no", "char_no", word.alias("word"), "known", "dir",
        *[v.cast("long").alias(f"w{c}") for c, v in picked.items()],
    )
