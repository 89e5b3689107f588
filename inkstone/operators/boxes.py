"""Page items, quads and regions: gates, order, duplicates, gaps and cells.

Tables have page_id, item (unique within a page, orders it), box columns x1, y1,
x2, y2 and, where read, text and score; quad tables have pts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkstone.functions.geometry import (
    axis_angle,
    box_area,
    box_iou,
    box_overlap_smaller,
    corner,
    edge_lengths,
    frame_box,
    half_up,
    intersection,
    is_tall,
    let,
    quad_angle,
    quad_of_box,
    struct_iou,
    struct_overlap_smaller,
    turned_box,
    upper_median,
)
from inkstone.functions.text import char_overlap, has_han
from inkstone.operators.common import PAGE_ROWS, connected_components, grid_join, grid_pairs, position_by_bucket, split_by_size
from inkstone.operators.greedy import greedy_keep, greedy_replace, kept_by_iou


# ---- pairs and coverage -------------------------------------------------

def overlap_pairs(items: DataFrame, measure: str = "iou", floor: float = 0.6, cell: int = 128) -> DataFrame:
    """Pairs of a page at or above ``floor`` by IoU or overlap of the smaller box."""
    pairs = grid_pairs(items.select("page_id", "item", "x1", "y1", "x2", "y2"), cell=cell)
    value = box_iou() if measure == "iou" else box_overlap_smaller()
    return pairs.withColumn("overlap", value).filter(F.col("overlap") >= floor).select(
        "page_id", "a_item", "b_item", "overlap"
    )


def coverage_gaps(regions: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """Regions (page_id, region, box) whose area the items cover by less than ``share``."""
    met = grid_join(regions.select("page_id", "region", "x1", "y1", "x2", "y2"), items.select("page_id", "x1", "y1", "x2", "y2"))
    sums = met.groupBy("page_id", F.col("a_region").alias("region")).agg(F.sum(intersection()).alias("covered"))
    joined = regions.join(sums, ["page_id", "region"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    area = box_area()
    return joined.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (F.col("covered") / area < share))


def regions_to_pixels(regions: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    """Census regions on the 0-1000 grid to pixels; malformed or far-out boxes go."""
    inside = (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))
    for name in ("x1", "y1", "x2", "y2"):
        inside = inside & F.col(name).between(-60, 1060)
    out = regions.filter(inside)
    for name, side in (("x1", w), ("y1", h), ("x2", w), ("y2", h)):
        out = out.withColumn(name, half_up(F.col(name) / 1000 * F.col(side)))
    return out


def nearest_anchor(chars: DataFrame, items: DataFrame, cell: int = 64) -> DataFrame:
    """Nearest box centre within two pitches of each character point; none gives ``anchored`` false.

    ``chars`` has page_id, char_id, px, py, pitch. A centre lies in one cell and
    a point looks only at the cells its reach touches.
    """

    def reach(p: str) -> Column:
        low, high = F.floor((F.col(p) - 2 * F.col("pitch")) / cell), F.floor((F.col(p) + 2 * F.col("pitch")) / cell)
        return F.explode(F.sequence(low, high))

    points = chars.select("page_id", "char_id", "px", "py", "pitch").withColumn("cx", reach("px")).withColumn("cy", reach("py"))
    centres = items.select(
        "page_id", "item", ((F.col("x1") + F.col("x2")) / 2).alias("bx"), ((F.col("y1") + F.col("y2")) / 2).alias("by")
    )
    centres = centres.withColumn("cx", F.floor(F.col("bx") / cell)).withColumn("cy", F.floor(F.col("by") / cell))
    distance = F.sqrt(F.pow(F.col("bx") - F.col("px"), 2) + F.pow(F.col("by") - F.col("py"), 2))
    best = (
        points.join(centres, ["page_id", "cx", "cy"])
        .withColumn("d", distance)
        .filter("d < 2 * pitch")
        .groupBy("page_id", "char_id")
        .agg(F.min_by("item", F.struct("d", "item")).alias("item"), F.min("d").alias("distance"))
    )
    return chars.join(best, ["page_id", "char_id"], "left").withColumn("anchored", F.col("item").isNotNull())


# ---- gates --------------------------------------------------------------

def page_gate(items: DataFrame) -> DataFrame:
    """Is the detector's own reading coherent enough to serve alone? One row per page with the first failed test.

    Means and the pitch's spread are compared at nine places, so a page right at a limit does not hang on the order of its rows.
    """
    n = F.length("text")
    pitch = F.when(n >= 2, (F.col("x2") - F.col("x1")) / n)
    stats = items.withColumn("_chars", n).withColumn("_pitch", pitch).groupBy("page_id").agg(
        F.count("*").alias("items"),
        F.count_if(F.col("score") >= 0.75).alias("confident"),
        F.avg("score").alias("mean_score"),
        F.sum("_chars").alias("chars"),
        upper_median("_chars").cast("int").alias("median_chars"),
        F.avg((F.col("_chars") == 1).cast("int")).alias("singles"),
        F.count("_pitch").alias("pitched"),
        F.avg("_pitch").alias("pitch_mean"),
        F.stddev_pop("_pitch").alias("pitch_sd"),
    )
    reason = (
        F.when(F.col("confident") < 3, "few confident items")
        .when(F.round("mean_score", 9) < 0.78, "low mean score")
        .when(F.col("chars") < 8, "few characters")
        .when(F.col("median_chars") < 3, "short items")
        .when(F.col("singles") > 0.5, "single characters")
        .when((F.col("pitched") >= 3) & (F.col("pitch_mean") > 0) & (F.round(F.col("pitch_sd") / F.col("pitch_mean"), 9) > 0.6), "uneven pitch")
    )
    return stats.select(
        "page_id", "items", "confident", "chars", "median_chars", reason.isNull().alias("passes"), reason.alias("reason")
    )


def page_serve_gate(lines: DataFrame, degenerate: DataFrame) -> DataFrame:
    """Per page: may the fused lines be served? ``lines`` has chars, anchored, boxed, has_char_boxes."""
    chars = F.col("chars")
    sums = lines.groupBy("page_id").agg(
        F.sum(chars).alias("total"),
        F.sum(F.when(F.col("anchored"), chars).otherwise(0)).alias("anchored_chars"),
        F.sum(F.when(F.col("boxed"), chars).otherwise(0)).alias("boxed_chars"),
        F.bool_or("has_char_boxes").alias("any_char_boxes"),
    )
    bad = degenerate.filter("degenerate").select("page_id", F.lit(True).alias("_bad")).distinct()
    joined = sums.join(bad, "page_id", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    anchored, boxed = F.col("anchored_chars") / F.col("total"), F.col("boxed_chars") / F.col("total")
    reason = (
        F.when(F.col("total") == 0, "no characters")
        .when(F.col("_bad"), "degenerate lattice")
        .when((anchored < 0.2) | (F.col("anchored_chars") < 6), "few anchored characters")
        .when(boxed < 0.5, "few boxed characters")
        .when(~F.col("any_char_boxes"), "no character boxes")
    )
    return joined.select(
        "page_id",
        "total",
        "anchored_chars",
        "boxed_chars",
        F.round(anchored, 6).alias("anchored_fraction"),
        F.round(boxed, 6).alias("boxed_fraction"),
        reason.isNull().alias("serves"),
        reason.alias("reason"),
    )


def lattice_degenerate(fragments: DataFrame, unmatched: DataFrame, verdict_only: bool = False) -> DataFrame:
    """Pages with more unmatched lines than fragments whose fragments overlap by 0.6 or more.

    With ``verdict_only``, boxes meet on pages with that many unmatched lines alone; on the others, which are sound whatever
    their boxes, ``max_overlap`` is zero.
    """
    boxes = fragments.select("page_id", "item", "x1", "y1", "x2", "y2")
    if verdict_only:
        sizes = fragments.groupBy("page_id").agg(F.count("*").alias("fragments"))
        sizes = sizes.join(unmatched.groupBy("page_id").agg(F.count("*").alias("unmatched")), "page_id")
        boxes = boxes.join(sizes.filter(F.col("unmatched") > F.col("fragments")).select("page_id"), "page_id", "left_semi")
    pairs = grid_pairs(boxes)
    overlap = intersection() / F.greatest(F.lit(1), F.least(box_area("a_"), box_area("b_")))
    worst = pairs.groupBy("page_id").agg(F.max(overlap).alias("max_overlap"))
    counts = fragments.groupBy("page_id").agg(F.count("*").alias("fragments"))
    lines = unmatched.groupBy("page_id").agg(F.count("*").alias("unmatched"))
    joined = counts.join(lines, "page_id", "left").join(worst, "page_id", "left")
    joined = joined.withColumn("unmatched", F.coalesce("unmatched", F.lit(0))).withColumn(
        "max_overlap", F.coalesce("max_overlap", F.lit(0.0))
    )
    return joined.withColumn("degenerate", (F.col("unmatched") > F.col("fragments")) & (F.col("max_overlap") >= 0.6))


def page_angle_coherence(words: DataFrame) -> DataFrame:
    """Words (page_id, line, word, angle, box) with boxes taken off incoherent lines or pages.

    From six angled words on, lines over 25 degrees off the median line lose their
    boxes; a page without coherent boxes, or mostly deviant, loses all.
    """
    boxed = F.col("x1").isNotNull()
    lines = words.groupBy("page_id", "line").agg(
        F.min_by("angle", F.when(F.col("angle").isNotNull(), F.col("word"))).alias("line_angle"),
        F.count("*").alias("n"),
        F.count("angle").alias("angled"),
        F.count_if(boxed).alias("n_boxed"),
    )
    pages = lines.groupBy("page_id").agg(
        upper_median("line_angle").alias("median_angle"), F.sum("n").alias("page_words"), F.sum("angled").alias("page_angled")
    )
    judged = lines.join(pages, "page_id").withColumn("deviant", F.abs(F.col("line_angle") - F.col("median_angle")) > 25)
    totals = judged.groupBy("page_id").agg(
        F.sum(F.when(F.col("deviant"), F.col("n")).otherwise(0)).alias("deviant_words"),
        F.sum(F.when(~F.col("deviant"), F.col("n_boxed")).otherwise(0)).alias("coherent_boxed"),
    )
    verdict = judged.join(totals, "page_id")
    applies = (F.col("page_words") >= 6) & (F.col("page_angled") >= 6)
    all_off = applies & ((F.col("coherent_boxed") == 0) | (F.col("deviant_words") > F.col("page_words") / 2))
    verdict = verdict.select(
        "page_id", "line", (all_off | (applies & F.coalesce("deviant", F.lit(False)))).alias("unplaced"), (~all_off).alias("positioned")
    )
    out = words.join(verdict, ["page_id", "line"])
    for c in ("x1", "y1", "x2", "y2"):
        out = out.withColumn(c, F.when(~F.col("unplaced"), F.col(c)))
    return out


def angle_clusters(quads: DataFrame) -> DataFrame:
    """Items per page and two-degree turn: one image rotation serves a cluster."""
    turn = half_up(F.col("angle") / 2) * 2
    return quads.groupBy("page_id", turn.cast("int").alias("cluster")).agg(F.count("*").alias("n"))


def angle_histogram(lines: DataFrame, top: int = 4) -> DataFrame:
    """The most frequent 15-degree buckets of each page."""
    counts = lines.groupBy("page_id", (half_up(F.col("angle") / 15) * 15).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("page_id").orderBy(F.col("n").desc(), "bucket")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def pitch_spread(lines: DataFrame) -> DataFrame:
    """Smallest, upper-median and largest pixels per character of each page."""
    p = lines.withColumn("pitch", half_up(F.col("length") / F.greatest(F.lit(1), F.length("text"))))
    return p.groupBy("page_id").agg(
        F.min("pitch").alias("pitch_min"), upper_median("pitch").cast("long").alias("pitch_median"), F.max("pitch").alias("pitch_max")
    )


# ---- quads --------------------------------------------------------------

def _measures(pts: Column) -> Column:
    """Struct (edge, angle, axis, flip, expected_chars) of one quad."""

    def turned(m: Column) -> Column:
        axis = axis_angle(m.angle)
        flip = F.when(F.abs(axis) < 45, m.dx < 0).otherwise(m.dy < 0)
        return F.struct(
            m.edge.alias("edge"), m.angle.alias("angle"), axis.alias("axis"), flip.alias("flip"), m.chars.alias("expected_chars")
        )

    def edged(m: Column) -> Column:
        a, b = corner(m.pts, m.edge), corner(m.pts, m.edge + 1)
        ratio = F.array_max(m.lengths) / F.greatest(F.lit(1.0), F.array_min(m.lengths))
        return F.struct(
            m.edge.alias("edge"),
            quad_angle(m.pts, m.edge).alias("angle"),
            (b.x - a.x).alias("dx"),
            (b.y - a.y).alias("dy"),
            F.greatest(F.lit(2), half_up(ratio)).cast("int").alias("chars"),
        )

    def found(m: Column) -> Column:
        edge = F.array_position(m.lengths, F.array_max(m.lengths)).cast("int") - 1
        return F.struct(m.pts.alias("pts"), m.lengths.alias("lengths"), edge.alias("edge"))

    def measured(p: Column) -> Column:
        return F.struct(p.alias("pts"), edge_lengths(p).alias("lengths"))

    m = F.transform(F.array(pts), measured)
    for stage in (found, edged, turned):
        m = F.transform(m, stage)
    return F.get(m, F.lit(0))


def quad_measures(quads: DataFrame) -> DataFrame:
    """Edge, angle, axis, flip and expected characters of each quad."""
    return quads.withColumn("_m", _measures(F.col("pts"))).select("*", "_m.*").drop("_m")


def staged_measures(quads: DataFrame) -> DataFrame:
    """What :func:`quad_measures` finds, each step a column of its own, compiled where functions over arrays are interpreted.

    Only for quads that are not filtered by a measure: the planner would move the filter below and repeat the steps in it.
    """
    pts, lengths = F.col("pts"), F.col("_lengths")
    q = quads.withColumn("_lengths", edge_lengths(pts))
    q = q.withColumn("edge", F.array_position(lengths, F.array_max(lengths)).cast("int") - 1)
    a, b = corner(pts, F.col("edge")), corner(pts, F.col("edge") + 1)
    ratio = F.array_max(lengths) / F.greatest(F.lit(1.0), F.array_min(lengths))
    q = q.select("*", quad_angle(pts, F.col("edge")).alias("angle"), (b.x - a.x).alias("_dx"), (b.y - a.y).alias("_dy"), half_up(ratio).alias("_ratio"))
    q = q.withColumn("axis", axis_angle(F.col("angle")))
    flip = F.when(F.abs("axis") < 45, F.col("_dx") < 0).otherwise(F.col("_dy") < 0)
    return q.select(
        *quads.columns, "edge", "angle", "axis", flip.alias("flip"), F.greatest(F.lit(2), F.col("_ratio")).cast("int").alias("expected_chars")
    )


def _middle(values: Column) -> Column:
    """The upper median of an array, as percentile_disc takes it from the falling order."""
    return F.get(F.sort_array(values, asc=False), (F.ceil(F.size(values) / 2) - 1).cast("int"))


def with_frame(quads: DataFrame, angle: str) -> DataFrame:
    """Each page's upper-median angle and the quads' boxes in that text frame."""
    medians = quads.groupBy("page_id").agg(upper_median(angle).alias("page_angle"))
    out = quads.join(medians, "page_id").withColumn("frame", frame_box(F.col("pts"), F.col("page_angle")))
    return out.select("*", "frame.*").drop("frame")


def _dedupe_quads_in_rows(measured: DataFrame, floor: float) -> DataFrame:
    """Pages that fit a row: one exchange of the quads, their boxes and areas go to the kernel in batches of pages."""
    rest = ["item"] + [c for c in measured.columns if c not in ("page_id", "item")]
    pages = measured.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))
    pages = pages.withColumn("page_angle", _middle(F.array_compact(F.col("rows")["angle"])))
    pages = pages.select("*", F.cos(F.radians("page_angle")).alias("_c"), F.sin(F.radians("page_angle")).alias("_s"))
    boxes = F.transform(F.col("rows")["pts"], lambda p: turned_box(p, F.col("_c"), F.col("_s")))
    pages = pages.select("page_id", "rows", "page_angle", boxes.alias("boxes"))

    def stay(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, order: pa.Array) -> pa.Array:
        numbers = [c.flatten().to_numpy(zero_copy_only=False).tolist() for c in (x1, y1, x2, y2, order)]
        ends = np.cumsum([len(n) for n in order]).tolist()
        found = []
        for i, j in zip([0, *ends], ends):
            *box, area = [c[i:j] for c in numbers]
            # quads come by item, and sorting keeps that order in equal areas; no area comes first, as in Spark
            area = [-np.inf if a != a else a for a in area]
            found.append(kept_by_iou(*box, sorted(range(j - i), key=area.__getitem__), floor))
        return pa.array(found, type=pa.list_(pa.int32()))

    area = F.transform("boxes", lambda b: -F.round((b.x2 - b.x1) * (b.y2 - b.y1), 6))
    places = F.arrow_udf(stay, "array<int>")(*[F.col("boxes")[c] for c in ("x1", "y1", "x2", "y2")], area)
    pages = pages.withColumn("_at", places)
    # the rows that stay are picked before the page is taken apart, so that no row carries its page
    kept = pages.select("page_id", "page_angle", F.explode(F.transform("_at", lambda i: F.get("rows", i))).alias("_r"))
    return kept.select(*[F.col(c) if c == "page_id" else F.col(f"_r.{c}") for c in measured.columns], "page_angle")


def dedupe_quads(quads: DataFrame, floor: float = 0.6, limit: int = PAGE_ROWS) -> DataFrame:
    """Detector double reads removed: largest first, IoU in the page's text frame.

    Pages up to ``limit`` quads are decided in one row each, larger ones in parallel rounds.
    """
    small, large = split_by_size(quads, "page_id", limit)
    given = "angle" in quads.columns
    out = _dedupe_quads_in_rows(small if given else staged_measures(small), floor)
    if large is None:
        return out
    framed = with_frame(large if given else quad_measures(large), "angle").withColumn("order_area", -F.round(box_area(), 6))
    # every page left is above the limit
    kept = greedy_keep(
        framed, "page_id", ["order_area", "item"], lambda k, x: struct_iou(k, x) >= floor, ["x1", "y1", "x2", "y2"], limit
    )
    return out.unionByName(kept.drop("order_area", "x1", "y1", "x2", "y2"))


def reading_order_quads(quads: DataFrame) -> DataFrame:
    """``position``: columns right to left, or rows by band and then x."""
    framed = with_frame(quad_measures(quads), "angle").withColumn("height", F.col("y2") - F.col("y1"))
    bands = framed.groupBy("page_id").agg(upper_median("height").alias("band"))
    x_centre = F.aggregate("pts", F.lit(0.0), lambda s, p: s + p.x) / 4
    vertical = F.abs("page_angle") >= 45
    row = half_up(F.col("y1") / F.greatest(F.lit(1.0), F.col("band")))
    rows = framed.join(bands, "page_id").withColumn("_along", F.when(vertical, -x_centre).otherwise(F.col("x1")))
    rows = rows.withColumn("_bucket", F.when(vertical, F.floor(-x_centre / 64)).otherwise(row))
    placed = position_by_bucket(rows, ["page_id"], ["_bucket"], [F.col("_along"), F.col("item")], "position")
    return placed.drop("_along", "_bucket", "height", "band", "x1", "y1", "x2", "y2")


def axis_orders(quads: DataFrame, band: float = 60.0) -> DataFrame:
    """Candidate orders: one for rows; both directions for columns."""
    framed = with_frame(quad_measures(quads), "angle")
    horizontal = F.abs("page_angle") < 45
    directions = F.when(horizontal, F.array(F.lit("rows"))).otherwise(F.array(F.lit("left to right"), F.lit("right to left")))
    rows = framed.withColumn("direction", F.explode(directions))
    along = F.when(F.col("direction") == "right to left", -F.col("x1")).otherwise(F.col("x1"))
    bucket = F.when(F.col("direction") == "rows", F.rint(F.col("y1") / band).cast("long")).otherwise(F.floor(along / 64))
    rows = rows.withColumn("_bucket", bucket).withColumn("_along", along)
    placed = position_by_bucket(rows, ["page_id", "direction"], ["_bucket"], [F.col("_along"), F.col("item")], "position")
    return placed.select("page_id", "item", "direction", "position")


def _merge_crowded(measured: DataFrame) -> DataFrame:
    """Groups of crowded pages: near fragments meet in grid cells."""
    framed = with_frame(measured, "axis").withColumn("thick", F.col("y2") - F.col("y1"))
    level = framed.filter(F.abs(F.col("axis") - F.col("page_angle")) <= 8).select(
        "page_id", "item", "thick", F.col("x1").alias("l"), F.col("x2").alias("r"), F.col("y1"), F.col("y2")
    )
    # half the largest gap is added to each side, so near fragments intersect
    reach = level.withColumn("x1", F.col("l") - 0.75 * F.col("thick") - 0.001).withColumn("x2", F.col("r") + 0.75 * F.col("thick") + 0.001)
    pairs = grid_pairs(reach)
    thin = F.least("a_thick", "b_thick")
    gap = F.greatest(F.lit(0.0), F.greatest("a_l", "b_l") - F.least("a_r", "b_r"))
    off = F.abs((F.col("a_y1") + F.col("a_y2")) / 2 - (F.col("b_y1") + F.col("b_y2")) / 2)
    edges = pairs.filter((off <= 0.35 * thin) & (gap <= 1.5 * thin)).select(
        F.struct("page_id", F.col("a_item").alias("item")).alias("src"), F.struct("page_id", F.col("b_item").alias("item")).alias("dst")
    )
    parts = connected_components(edges)
    nodes = framed.withColumn("node", F.struct("page_id", "item")).join(parts, "node", "left")
    return nodes.withColumn("head", F.coalesce("component.item", "item")).drop("item").withColumnRenamed("head", "item").groupBy("page_id", "item").agg(
        F.count("*").alias("members"),
        F.first("page_angle").alias("page_angle"),
        F.min("x1").alias("x1"),
        F.min("y1").alias("y1"),
        F.max("x2").alias("x2"),
        F.max("y2").alias("y2"),
        F.first("pts").alias("own"),
    )


def _level_groups(l: pa.Array, r: pa.Array, y1: pa.Array, y2: pa.Array, level: pa.Array) -> pa.Array:
    """For the fragments of each page, in order, the places of those that make one line, by their first."""
    pages = zip(*(c.to_pylist() for c in (l, r, y1, y2, level)))
    return pa.array([_joined_level(*page) for page in pages], type=pa.list_(pa.list_(pa.int32())))


def _joined_level(l: list, r: list, y1: list, y2: list, level: list) -> list[list[int]]:
    head = list(range(len(l)))

    def top(i: int) -> int:
        while head[i] != i:
            head[i] = i = head[head[i]]
        return i

    live = [i for i in head if level[i] and l[i] is not None]
    for at, j in enumerate(live):
        tj = y2[j] - y1[j]
        for i in live[:at]:
            ti = y2[i] - y1[i]
            thin = min(ti, tj)
            off = abs((y1[i] + y2[i]) / 2 - (y1[j] + y2[j]) / 2)
            if not off <= 0.35 * thin or min(y2[i], y2[j]) - max(y1[i], y1[j]) <= 0:
                continue
            meet = min(r[i] + 0.75 * ti + 0.001, r[j] + 0.75 * tj + 0.001) - max(l[i] - 0.75 * ti - 0.001, l[j] - 0.75 * tj - 0.001)
            if meet > 0 and max(0.0, max(l[i], l[j]) - min(r[i], r[j])) <= 1.5 * thin:
                a, b = top(i), top(j)
                head[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(len(l)):
        groups.setdefault(top(i), []).append(i)
    return list(groups.values())


def _merge_in_rows(measured: DataFrame) -> DataFrame:
    """Groups of pages that fit a row: one exchange of the quads, numbers alone go to the kernel."""
    pages = measured.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("item", "pts", "axis"))).alias("rows"))
    median = _middle(F.array_compact(F.col("rows")["axis"]))
    pages = pages.select("page_id", "rows", median.alias("page_angle"))
    frames = F.transform(F.col("rows")["pts"], lambda p: frame_box(p, F.col("page_angle")))
    pages = pages.select("page_id", "rows", "page_angle", frames.alias("frames"))
    level = F.transform(F.col("rows")["axis"], lambda v: F.coalesce(F.abs(v - F.col("page_angle")) <= 8, F.lit(False)))
    groups = F.arrow_udf(_level_groups, "array<array<int>>")
    found = groups(*[F.col("frames")[c] for c in ("x1", "x2", "y1", "y2")], level)
    lines = pages.select("page_id", "rows", "page_angle", "frames", F.explode(found).alias("at"))

    def side(name: str, f) -> Column:
        return f(F.transform("at", lambda i: F.get("frames", i)[name])).alias(name)

    first = F.get("rows", F.get("at", F.lit(0)))
    return lines.select(
        "page_id",
        first["item"].alias("item"),
        F.size("at").cast("bigint").alias("members"),
        "page_angle",
        side("x1", F.array_min),
        side("y1", F.array_min),
        side("x2", F.array_max),
        side("y2", F.array_max),
        first["pts"].alias("own"),
    )


def merge_collinear(quads: DataFrame, limit: int = PAGE_ROWS) -> DataFrame:
    """Fragments of one line joined: same axis within 8 degrees, nearly level, close along the axis.

    A page of ordinary size is one row; pages above ``limit`` are joined piece by piece through the grid.
    """
    small, large = split_by_size(quads, "page_id", limit)
    groups = _merge_in_rows(quad_measures(small))
    if large is not None:
        groups = groups.unionByName(_merge_crowded(quad_measures(large)))
    c, s = F.cos(F.radians("page_angle")), F.sin(F.radians("page_angle"))

    def back(x: str, y: str) -> Column:
        return F.struct((F.col(x) * c - F.col(y) * s).alias("x"), (F.col(x) * s + F.col(y) * c).alias("y"))

    span = F.array(back("x1", "y1"), back("x2", "y1"), back("x2", "y2"), back("x1", "y2"))
    return groups.select(
        "page_id", "item", "members", F.when(F.col("members") == 1, F.col("own")).otherwise(span).alias("pts")
    )


def _gaps_in_rows(quads: DataFrame) -> DataFrame:
    """Gaps of pages that fit a row: one exchange of the columns' numbers. No filter reads a measure, which would repeat it."""
    xs, ys = F.col("pts")["x"], F.col("pts")["y"]
    left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    column = F.struct(((left + right) / 2).alias("cx"), (right - left).alias("width"), top.alias("top"), bottom.alias("bottom"))
    upright = staged_measures(quads.select("page_id", "pts")).select("page_id", F.when(F.abs("axis") >= 45, column).alias("c"))
    # a list leaves out what is null, so only columns are in it
    pages = upright.groupBy("page_id").agg(F.collect_list("c").alias("c"))
    pages = pages.select("page_id", F.sort_array(F.col("c")["cx"]).alias("cx"), *[_middle(F.col("c")[n]).alias(n) for n in ("width", "top", "bottom")])
    n = F.size("cx")
    pitches = F.when(n >= 4, F.zip_with(F.slice("cx", 2, n - 1), F.slice("cx", 1, n - 1), lambda a, b: a - b))
    pages = pages.withColumn("pitches", pitches)
    pages = pages.withColumn("pitch_median", _middle(F.col("pitches")))
    near = F.size(F.filter("pitches", lambda p: F.abs(p - F.col("pitch_median")) <= 0.25 * F.col("pitch_median")))
    even = F.col("pitch_median").between(8, 500) & (near / F.size("pitches") >= 0.6)
    holes = pages.select("page_id", "cx", "width", "top", "bottom", "pitch_median", F.posexplode_outer(F.when(even, F.col("pitches"))).alias("at", "gap"))
    holes = holes.filter(F.col("gap") >= 1.6 * F.col("pitch_median"))
    missing = (half_up(F.col("gap") / F.col("pitch_median")) - 1).cast("int")
    return holes.select("page_id", F.get("cx", F.col("at")).alias("left"), "gap", missing.alias("missing"), "width", "top", "bottom")


def _gaps_of_crowded(quads: DataFrame) -> DataFrame:
    """Gaps of crowded pages: centres and pitches are counted, and a page's distinct centres alone meet in a window."""
    xs, ys = F.transform("pts", lambda p: p.x), F.transform("pts", lambda p: p.y)
    cols = quad_measures(quads).filter(F.abs("axis") >= 45).select(
        "page_id",
        ((F.array_min(xs) + F.array_max(xs)) / 2).alias("cx"),
        (F.array_max(xs) - F.array_min(xs)).alias("width"),
        F.array_min(ys).alias("top"),
        F.array_max(ys).alias("bottom"),
    )
    shape = cols.groupBy("page_id").agg(
        F.count("*").alias("n"),
        upper_median("width").alias("width"),
        upper_median("top").alias("top"),
        upper_median("bottom").alias("bottom"),
    )
    w = Window.partitionBy("page_id").orderBy("cx")
    centres = cols.groupBy("page_id", "cx").agg(F.count("*").alias("same")).withColumn("left", F.lag("cx").over(w))
    steps = centres.select("page_id", F.col("cx") - F.col("left"), "same").toDF("page_id", "step", "same")
    pitches = steps.select("page_id", F.col("step").alias("pitch"), F.lit(1).alias("times")).filter("pitch is not null").union(
        steps.filter("same > 1").select("page_id", F.lit(0.0), F.col("same") - 1)
    )
    each = pitches.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_k")
    medians = each.groupBy("page_id").agg(upper_median("pitch").alias("pitch_median"))
    even = (
        each.join(medians, "page_id")
        .groupBy("page_id", "pitch_median")
        .agg(F.avg((F.abs(F.col("pitch") - F.col("pitch_median")) <= 0.25 * F.col("pitch_median")).cast("int")).alias("near"))
        .filter("pitch_median between 8 and 500 and near >= 0.6")
    )
    holes = centres.join(even, "page_id").join(shape.filter("n >= 4"), "page_id").withColumn("gap", F.col("cx") - F.col("left"))
    holes = holes.filter(F.col("gap") >= 1.6 * F.col("pitch_median")).withColumn(
        "missing", (half_up(F.col("gap") / F.col("pitch_median")) - 1).cast("int")
    )
    return holes.select("page_id", "left", "gap", "missing", "width", "top", "bottom")


def fill_column_gaps(quads: DataFrame, limit: int = PAGE_ROWS) -> DataFrame:
    """Synthetic quads for holes in evenly spaced columns, at most two per hole.

    Pitches are taken between the centres of columns; coinciding centres count as zero pitches. A page of ordinary size is
    one row; on pages above ``limit`` distinct centres are counted first, whose number is bounded by the page width.
    """
    small, large = split_by_size(quads, "page_id", limit)
    holes = _gaps_in_rows(small)
    if large is not None:
        holes = holes.unionByName(_gaps_of_crowded(large))
    made = holes.filter("missing between 1 and 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("missing"))))
    centre = F.col("left") + F.col("gap") * F.col("k") / (F.col("missing") + 1)
    return made.select(
        "page_id",
        F.col("left").alias("after_cx"),
        "k",
        quad_of_box(centre - F.col("width") / 2, F.col("top"), centre + F.col("width") / 2, F.col("bottom")).alias("pts"),
    )


def char_cells(quads: DataFrame, n: str = "n") -> DataFrame:
    """``n`` equal square cells along each quad's axis, in reading direction, at least 4 px."""
    q = staged_measures(quads)

    def middle(i: Column, j: Column) -> Column:
        a, b = corner(F.col("pts"), i), corner(F.col("pts"), j)
        return F.struct(((a.x + b.x) / 2).alias("x"), ((a.y + b.y) / 2).alias("y"))

    e = F.col("edge")
    q = q.withColumn("_s", middle(e + 3, e)).withColumn("_t", middle(e + 1, e + 2))
    swap = F.when(F.abs("axis") < 45, F.col("_t.x") < F.col("_s.x")).otherwise(F.col("_t.y") < F.col("_s.y"))
    q = q.withColumn("_swap", F.coalesce(swap, F.lit(False)))
    start, end = F.when(F.col("_swap"), F.col("_t")).otherwise(F.col("_s")), F.when(F.col("_swap"), F.col("_s")).otherwise(F.col("_t"))
    q = q.withColumn("_v", F.struct(start.alias("s"), (end.x - start.x).alias("dx"), (end.y - start.y).alias("dy")))
    long_enough = F.pow("_v.dx", 2) + F.pow("_v.dy", 2) >= 1
    # explode drops quads without cells; a filter here would repeat the whole measure
    numbers = F.when(long_enough & (F.col(n) >= 1), F.sequence(F.lit(0), F.col(n) - 1))
    q = q.select("page_id", "item", F.col(n).alias("_n"), "_v", F.explode(numbers).alias("cell_no"))
    dx, dy, along = F.col("_v.dx"), F.col("_v.dy"), (F.col("cell_no") + 0.5) / F.col("_n")
    half = F.greatest(F.lit(4.0), F.sqrt(dx * dx + dy * dy) / F.col("_n")) / 2
    cx, cy = F.col("_v.s.x") + dx * along, F.col("_v.s.y") + dy * along
    return q.select(
        "page_id",
        "item",
        "cell_no",
        half_up(cx - half).cast("long").alias("x1"),
        half_up(cy - half).cast("long").alias("y1"),
        half_up(cx + half).cast("long").alias("x2"),
        half_up(cy + half).cast("long").alias("y2"),
    )


def flag_read_length(length: Column, expected: Column) -> Column:
    return F.abs(length - expected) > F.greatest(F.lit(3.0), expected * 0.4)


def split_multiline(reads: DataFrame) -> DataFrame:
    """A read with k lines becomes k strips across its quad."""
    lines = F.filter(F.transform(F.split("text", r"\n+"), lambda t: F.trim(t)), lambda t: t != "")
    rows = staged_measures(reads).withColumn("lines", lines).select("*", F.size("lines").alias("k"), F.posexplode("lines").alias("strip", "line"))
    pts, e = F.col("pts"), F.col("edge")

    def lerp(i: Column, j: Column, f: Column) -> Column:
        a, b = corner(pts, i), corner(pts, j)
        return F.struct((a.x + (b.x - a.x) * f).alias("x"), (a.y + (b.y - a.y) * f).alias("y"))

    f0, f1 = F.col("strip") / F.col("k"), (F.col("strip") + 1) / F.col("k")
    strips = F.array(lerp(e, e + 3, f0), lerp(e + 1, e + 2, f0), lerp(e + 1, e + 2, f1), lerp(e, e + 3, f1))
    return rows.select("page_id", "item", "strip", F.col("line").alias("text"), F.when(F.col("k") < 2, pts).otherwise(strips).alias("pts"))


# ---- items --------------------------------------------------------------

def _alike(norms: list, a: np.ndarray, b: np.ndarray, similar: float) -> np.ndarray:
    """For pairs of texts by number: do they share so many characters? The same as ``char_overlap`` with ``strict_shorter``."""
    sizes = np.array([-1 if t is None else len(t) for t in norms])
    known: dict = {}
    ids = np.array([known.setdefault(t, len(known)) for t in norms])
    shorter = np.minimum(sizes[a], sizes[b])
    out = (shorter >= 0) & (shorter < 4) & (ids[a] == ids[b])
    letters, at = np.unique(np.frombuffer("".join(t or "" for t in norms).encode("utf-32-le"), np.int32), return_inverse=True)
    if not len(letters):
        return out
    owner = np.repeat(np.arange(len(norms)), np.maximum(sizes, 0))
    bag = np.bincount(owner * len(letters) + at, minlength=len(norms) * len(letters)).reshape(len(norms), -1).astype(np.int32)
    long = np.flatnonzero(shorter >= 4)
    step = max(1, (1 << 20) // len(letters))
    for k in range(0, len(long), step):
        part = long[k : k + step]
        out[part] = np.minimum(bag[a[part]], bag[b[part]]).sum(axis=1) / shorter[part] >= similar
    return out


#: Reads whose pages are looked at together.
TOGETHER = 2048


def _pairs_within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows of one page, the earlier first, for pages of so many rows one behind the other."""
    rows = int(counts.sum())
    behind = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(rows)
    a = np.repeat(np.arange(rows), behind)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(behind) - behind, behind)


def _reads_that_stay(
    counts: np.ndarray, box: np.ndarray, norms: list, size: list, score: np.ndarray, overlap: float, similar: float
) -> list[list[int]]:
    """For pages of so many reads, the places of those that a pass in order keeps; a missing number is NaN and counts as Spark counts null."""
    a, b = _pairs_within(counts)
    x1, y1, x2, y2 = box
    ix = np.fmax(np.fmin(x2[a], x2[b]) - np.fmax(x1[a], x1[b]), 0.0)
    iy = np.fmax(np.fmin(y2[a], y2[b]) - np.fmax(y1[a], y1[b]), 0.0)
    area = np.fmax((x2 - x1) * (y2 - y1), 1.0)
    met = ix * iy / np.minimum(area[a], area[b]) >= overlap
    a, b = a[met], b[met]
    hit = _alike(norms, a, b, similar)
    same: dict[int, set[int]] = {}
    later = set(b[hit].tolist())
    for i, j in zip(a[hit].tolist(), b[hit].tolist()):
        same.setdefault(i, set()).add(j)
        same.setdefault(j, set()).add(i)
    out, ends = [], np.cumsum(counts).tolist()
    crowded = set(np.searchsorted(ends, sorted(later), side="right").tolist())
    for page, (first, end) in enumerate(zip([0, *ends], ends)):
        if page not in crowded:
            out.append(list(range(end - first)))
            continue
        kept: list[int] = []
        for x in range(first, end):
            at = next((at for at, k in enumerate(kept) if k in same[x]), None) if x in later else None
            if at is None:
                kept.append(x)
            elif size[x] > size[kept[at]] or (size[x] == size[kept[at]] and score[x] > score[kept[at]]):
                kept[at] = x
        out.append([k - first for k in kept])
    return out


def _dedupe_in_rows(rows: DataFrame, overlap: float, similar: float) -> DataFrame:
    """Pages that fit a row: one exchange of the items, boxes and texts go to the kernel in batches of pages."""
    rest = ["item"] + [c for c in rows.columns if c not in ("page_id", "item")]
    pages = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("items"))

    def stay(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, score: pa.Array, norm: pa.Array, size: pa.Array) -> pa.Array:
        numbers = [c.flatten().to_numpy(zero_copy_only=False) for c in (x1, y1, x2, y2, score)]
        norms, sizes = norm.flatten().to_pylist(), size.flatten().to_pylist()
        counts = norm.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        found, first, at = [], 0, 0
        while first < len(counts):
            last = max(first + 1, int(np.searchsorted(ends, at + TOGETHER, side="right")))
            end = int(ends[last - 1])
            box, score_ = np.array([c[at:end] for c in numbers[:4]]), numbers[4][at:end]
            found += _reads_that_stay(counts[first:last], box, norms[at:end], sizes[at:end], score_, overlap, similar)
            first, at = last, end
        return pa.array(found, type=pa.list_(pa.int32()))

    def each(name: str) -> Column:
        return F.col("items")[name].cast("array<double>")

    places = F.arrow_udf(stay, "array<int>")(
        *map(each, ("x1", "y1", "x2", "y2", "score")), F.col("items")["norm"], F.transform("items", lambda r: F.length(r.text))
    )
    pages = pages.withColumn("_at", places)
    # the rows that stay are picked before the page is taken apart, so that no row carries its page
    kept = pages.select("page_id", F.explode(F.transform("_at", lambda i: F.get("items", i))).alias("_r"))
    return kept.select(*[F.col(c) if c == "page_id" else F.col(f"_r.{c}") for c in rows.columns])


def dedupe_items(items: DataFrame, overlap: float = 0.6, similar: float = 0.5, limit: int = PAGE_ROWS) -> DataFrame:
    """Detector re-reads of one region: the longer text stays, then the better score.

    ``norm`` holds the text without spaces in traditional characters; it defaults
    to the text without spaces. Pages up to ``limit`` items are decided in one row each, larger ones piece by piece.
    """
    rows = items.filter((F.length("text") >= 2) | has_han(F.col("text")))
    if "norm" not in rows.columns:
        rows = rows.withColumn("norm", F.regexp_replace("text", r"\s+", ""))

    def same(k: Column, x: Column) -> Column:
        return (struct_overlap_smaller(k, x, 1.0) >= overlap) & (char_overlap(k.norm, x.norm, "strict_shorter") >= similar)

    def better(x: Column, k: Column) -> Column:
        nx, nk = F.length(x.text), F.length(k.text)
        return (nx > nk) | ((nx == nk) & (x.score > k.score))

    small, large = split_by_size(rows, "page_id", limit)
    out = _dedupe_in_rows(small, overlap, similar)
    if large is None:
        return out
    # every page left is above the limit
    return out.unionByName(greedy_replace(large, "page_id", ["item"], same, better, limit))


def reading_order_items(items: DataFrame, single_tall: bool = False, limit: int = PAGE_ROWS) -> DataFrame:
    """``position``: rows by centre band, then columns right to left.

    Bands are a fraction of the median extent per page and shape. Unless
    ``single_tall``, one-character boxes count as rows. Pages up to ``limit`` items are exchanged once, larger ones are sorted band by band.
    """
    tall = is_tall() if single_tall else is_tall() & (F.length("text") > 1)
    rows = items.withColumn("tall", tall)
    rows = rows.withColumn("_extent", F.when(F.col("tall"), F.col("x2") - F.col("x1")).otherwise(F.col("y2") - F.col("y1")))
    small, large = split_by_size(rows, "page_id", limit)
    # neither a page nor a shape that is null has a median
    own = small.filter("page_id is not null and tall is not null").repartition("page_id")
    shape = Window.partitionBy("page_id", "tall")
    own = own.withColumn("_turn", F.row_number().over(shape.orderBy(F.desc("_extent")))).withColumn("_half", F.ceil(F.count("_extent").over(shape) / 2))
    own = _banded(own.withColumn("_median", F.max(F.when(F.col("_turn") == F.col("_half"), F.col("_extent"))).over(shape)).drop("_turn", "_half"))
    turns = Window.partitionBy("page_id").orderBy("tall", "band", "_along", "item")
    placed = own.withColumn("position", F.row_number().over(turns).cast("bigint"))
    if large is not None:
        medians = large.groupBy("page_id", "tall").agg(upper_median("_extent").alias("_median"))
        crowded = _banded(large.join(medians, ["page_id", "tall"]))
        crowded = position_by_bucket(crowded, ["page_id"], ["tall", "band"], [F.col("_along"), F.col("item")], "position")
        placed = placed.unionByName(crowded)
    return placed.select("page_id", "tall", *[c for c in items.columns if c != "page_id"], "band", "position")


def _banded(rows: DataFrame) -> DataFrame:
    tol = F.greatest(F.lit(4.0), 0.3 * F.col("_median"))
    centre = F.when(F.col("tall"), F.col("x1") + F.col("x2")).otherwise(F.col("y1") + F.col("y2")) / 2
    band = half_up(centre / tol)
    rows = rows.withColumn("band", F.when(F.col("tall"), -band).otherwise(band))
    return rows.withColumn("_along", F.when(F.col("tall"), F.col("y1")).otherwise(F.col("x1")))


def heal_coordinates(lines: DataFrame) -> DataFrame:
    """Boxes on a 0-1000 grid or beyond the page brought to pixels; rows with a vector stay.

    Columns w and h give the page size. A page is on the grid when all its boxes
    fit 1005; otherwise each axis scales only if some box passes its side by 2%.
    """
    legacy = F.col("x1").isNotNull() & ~F.col("has_vector")
    pages = lines.filter(legacy).groupBy("page_id").agg(
        F.max(F.greatest("x1", "y1", "x2", "y2")).alias("_max"),
        F.max(F.col("x2") > F.col("w") * 1.02).alias("_x"),
        F.max(F.col("y2") > F.col("h") * 1.02).alias("_y"),
    )
    grid = F.col("_max") <= 1005
    rows = lines.join(pages, "page_id", "left")
    sx = F.when(grid | F.col("_x"), F.col("w") / 1000).otherwise(1.0)
    sy = F.when(grid | F.col("_y"), F.col("h") / 1000).otherwise(1.0)
    applies = legacy & (F.col("w") > 0) & (F.col("h") > 0) & (grid | F.col("_x") | F.col("_y"))
    x1, y1 = F.least(F.col("w") - 1, half_up(F.col("x1") * sx)), F.least(F.col("h") - 1, half_up(F.col("y1") * sy))
    x2, y2 = F.least(F.col("w"), half_up(F.col("x2") * sx)), F.least(F.col("h"), half_up(F.col("y2") * sy))
    healed = {
        "x1": F.greatest(F.lit(0), x1),
        "y1": F.greatest(F.lit(0), y1),
        "x2": F.greatest(x1 + 1, x2),
        "y2": F.greatest(y1 + 1, y2),
    }
    keep = [c for c in lines.columns if c not in healed]
    return rows.select(*keep, *[F.when(applies, v).otherwise(F.col(k)).alias(k) for k, v in healed.items()])


def line_direction(dir_: Column, chars: Column) -> Column:
    """Box shape overrules the label: a wide box is no column, a tall one of several characters no row."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return (
        F.when(F.col("x1").isNull(), dir_)
        .when(w > h, F.when(dir_ == "v", "h").otherwise(F.coalesce(dir_, F.lit("h"))))
        .when((h > w) & (chars > 1), F.when(dir_ == "h", "v").otherwise(F.coalesce(dir_, F.lit("v"))))
        .otherwise(dir_)
    )
