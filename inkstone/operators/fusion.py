"""Detector fragments fused with a model's line readings, page by page.

Fragments are page items; answers are rows (page_id, line, text, dir) where
``line`` is the position in the answer and text may hold gap markers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from inkstone.functions.alignment import local_alignment, local_alignments, shared_characters
from inkstone.functions.geometry import half_up, is_tall, upper_median
from inkstone.functions.text import char_overlap, no_space
from inkstone.operators.boxes import dedupe_items, lattice_degenerate, page_gate, page_serve_gate, reading_order_items
from inkstone.operators.common import first_per_key, top_per_key
from inkstone.operators.greedy import greedy_keep
from inkstone.operators.lexicon import map_characters
from inkstone.operators.overlap import PAGE_PAIRS, crowded_pages, similar_on_page
from inkstone.session import cut_lineage

GAP_MARK = "⟪[0-9]+(?:[.][0-9]+)?⟫"
BOX_TYPE = "struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>"
GAP_TYPE = "array<struct<at_char:int,widths:double>>"
CHAR_TYPE = f"array<struct<char:string,box:{BOX_TYPE},anchored:boolean>>"


def read_answers(answers: DataFrame) -> DataFrame:
    """Answer lines with gap markers taken out: clean text and gaps as (at_char, widths)."""
    clean = F.replace(F.regexp_replace("text", GAP_MARK, ""), F.lit("⟪"), F.lit(""))
    # a step for each marker and not for each character; characters before a marker are counted without lone brackets
    widths = F.regexp_extract_all("text", F.lit(GAP_MARK.replace("⟪", "⟪(").replace("⟫", ")⟫")), F.lit(1))
    pieces = F.split("text", GAP_MARK, -1)

    def gap(width: Column, i: Column) -> Column:
        before = F.replace(F.array_join(F.slice(pieces, 1, i + 1), ""), F.lit("⟪"), F.lit(""))
        return F.struct(F.length(before).alias("at_char"), width.cast("double").alias("widths"))

    found = F.filter(F.transform(widths, gap), lambda g: g.at_char > 0).cast(GAP_TYPE)
    gaps = F.when(F.contains("text", F.lit("⟪")), found).when(F.col("text").isNotNull(), F.array().cast(GAP_TYPE))
    return answers.withColumn("clean", clean).withColumn("gaps", gaps)


def with_norm(df: DataFrame, column: str, script_map: DataFrame | None) -> DataFrame:
    """``norm``: the text in traditional characters without spaces."""
    if script_map is None:
        return df.withColumn("norm", no_space(F.col(column)))
    return map_characters(df, {column: "norm"}, script_map, "simplified", "traditional").withColumn("norm", no_space(F.col("norm")))


# ---- text alignment -----------------------------------------------------

#: Share of a fragment's characters that an accepted line has at least.
SHARED = 0.18


#: Cells of one pass of the kernel, and the length from which a text is aligned by itself.
CELLS, LONG = 1 << 18, 1 << 16


def _aligned(fragments: list[str], readings: list[str]) -> list[np.ndarray]:
    """The alignment's fields for each pair of texts, in passes over pairs of about one length."""
    out = [np.zeros(len(fragments), t) for _, t in FIELDS]
    sizes = np.fromiter(map(len, readings), np.int64, len(readings))
    long = np.maximum(sizes, np.fromiter(map(len, fragments), np.int64, len(fragments))) >= LONG
    for i in np.flatnonzero(long):
        found = local_alignment(list(fragments[i]), list(readings[i]))
        for column, value in zip(out, found or (0,) * len(out)):
            column[i] = value
    order = np.argsort(sizes, kind="stable")
    order = order[~long[order]]
    while len(order):
        part = order[-max(1, CELLS // (int(sizes[order[-1]]) + 1)) :]
        order = order[: -len(part)]
        found = local_alignments([fragments[i] for i in part], [readings[i] for i in part])
        for column, (name, _) in zip(out, FIELDS):
            column[part] = found[name]
    return out


FIELDS = [("f_start", "int32"), ("f_end", "int32"), ("c_start", "int32"), ("c_end", "int32"), ("score", "float64"), ("matched", "int32")]


def align_texts(pairs: DataFrame, share: float = 0.0) -> DataFrame:
    """Local alignment of each row's texts (fragment, reading); pairs without a common chunk vanish.

    So do, before they are aligned, pairs that share no character or less than ``share`` of the fragment's characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fragments, readings = batch.column("fragment").to_pylist(), batch.column("reading").to_pylist()
            shared = shared_characters(fragments, readings)
            sizes = np.fromiter((len(t or "") for t in fragments), np.int64, len(fragments))
            near = np.flatnonzero((shared > 0) & (shared >= share * sizes - 1e-9))
            columns = _aligned([fragments[i] for i in near], [readings[i] for i in near])
            hit = pa.array(columns[4] > 0)
            names = batch.schema.names + [name for name, _ in FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(near)).columns, *map(pa.array, columns)], names=names).filter(hit)

    fields = "f_start int, f_end int, c_start int, c_end int, score double, matched int"
    return pairs.mapInArrow(run, StructType([*pairs.schema, *StructType.fromDDL(fields)]))


def align_pairs(fragments: DataFrame, lines: DataFrame, accepted_only: bool = False, page_pairs: int = PAGE_PAIRS) -> DataFrame:
    """Aligned windows of every fragment and line of a page that share a character.

    Both tables carry ``norm``. Pairs are aligned where they meet, so texts travel once. On pages with more than ``page_pairs`` pairs, texts meet by an index of their characters.
    With ``accepted_only``, pairs that cannot be accepted are left out before they are aligned: nine tenths of a fragment
    within a chunk of positive score take more than 0.18 of its characters as matches.
    """
    f = fragments.select("page_id", "item", F.col("norm").alias("fragment"))
    c = lines.select("page_id", "line", F.col("norm").alias("reading"))
    crowded = crowded_pages(f, c, "page_id", page_pairs)
    near = f if crowded is None else f.join(crowded, "page_id", "left_anti")
    pairs = near.join(c, "page_id")
    if crowded is not None:
        many, with_lines = f.join(crowded, "page_id", "left_semi"), c.join(crowded, "page_id", "left_semi")
        # a share of next to nothing is one character
        met = similar_on_page(many, with_lines, "page_id", "item", "line", "fragment", "reading", SHARED if accepted_only else 1e-9, of="left")
        met = met.select("page_id", "item", "line").join(many, ["page_id", "item"]).join(with_lines, ["page_id", "line"])
        pairs = pairs.unionByName(met.select(*pairs.columns))
    found = align_texts(pairs, SHARED if accepted_only else 0.0)
    m, n = F.length("fragment"), F.length("reading")
    accepted = (
        (((F.col("f_end") - F.col("f_start")) / m >= 0.9) | (F.col("matched") >= 0.55 * m))
        & (n - F.col("c_end") >= m - F.col("f_end"))
    )
    found = found.select("fragment", "reading", "page_id", "item", "line", *[name for name, _ in FIELDS], accepted.alias("accepted"))
    return found.filter("accepted") if accepted_only else found


def improve_fragments(fragments: DataFrame, lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Best accepted reading per fragment where it changes the text: (page_id, item, improved).

    A line accepted by this fragment alone and covering 0.6 of it is taken whole;
    else the window is widened by the fragment's unread ends.
    """
    m = F.col("m")
    good = windows.filter("accepted").select("page_id", "item", "line", F.length("fragment").alias("m"), *[name for name, _ in FIELDS])
    # numbers alone travel, and once: takers are counted where the line's text joins them
    rows = good.withColumn("takers", F.count("*").over(Window.partitionBy("page_id", "line")))
    rows = rows.join(lines.select("page_id", "line", "clean"), ["page_id", "line"])
    cover = (F.col("f_end") - F.col("f_start")) / m
    begin = F.greatest(F.lit(0), F.col("c_start") - F.col("f_start"))
    end = F.least(F.length("clean"), F.col("c_end") + (m - F.col("f_end")))
    part = F.substring(F.col("clean"), begin + 1, end - begin)
    rows = rows.withColumn("improved", F.when((F.col("takers") == 1) & (cover >= 0.6), F.col("clean")).otherwise(part))
    rows = rows.filter(F.trim("improved") != "").withColumn("rank", F.greatest(cover, F.col("matched") / m))
    best = first_per_key(
        rows.select("page_id", "item", "line", "improved", "rank", "score"),
        ["page_id", "item"],
        [-F.col("rank"), -F.col("score"), F.col("line")],
    )
    own = fragments.select("page_id", "item", "text")
    return best.join(own, ["page_id", "item"]).filter("improved <> text").select("page_id", "item", "improved")


def unmatched_lines(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Lines of two or more characters that no fragment accepted."""
    taken = windows.filter("accepted").select("page_id", "line").distinct()
    return lines.filter(F.length("clean") >= 2).join(taken, ["page_id", "line"], "left_anti")


def group_variant_lines(lines: DataFrame, similar: float = 0.55, page_pairs: int = PAGE_PAIRS) -> DataFrame:
    """``first``: no earlier line of the page resembles it. The others repeat one missing column.

    Every earlier line belongs to some group, so a line opens its own exactly
    when it resembles none of them. The lines of a page are one model answer; on a page with more than ``page_pairs`` pairs
    of lines, equal ones meet by their text and similar ones by an index of their characters.
    """
    key = lines.select("page_id", "line", "norm")
    crowded = crowded_pages(key, key, "page_id", page_pairs)
    near = key if crowded is None else key.join(crowded, "page_id", "left_anti")
    later = near.alias("b").join(
        near.alias("a"),
        (F.col("a.page_id") == F.col("b.page_id"))
        & (F.col("a.line") < F.col("b.line"))
        & (char_overlap(F.col("a.norm"), F.col("b.norm"), "strict_shorter") >= similar),
        "left_semi",
    )
    again = later.select("page_id", "line")
    if crowded is not None:
        many = key.join(crowded, "page_id", "left_semi")
        opens = many.groupBy("page_id", "norm").agg(F.min("line").alias("_first"))
        equal = many.join(opens, ["page_id", "norm"]).filter(F.col("line") > F.col("_first")).select("page_id", "line")
        # of equal lines the first is looked up for all of them; texts under four characters only resemble equal ones
        firsts = opens.select("page_id", "norm", F.col("_first").alias("line"))
        met = similar_on_page(firsts, firsts.withColumnRenamed("line", "other"), "page_id", "line", "other", "norm", "norm", similar)
        alike = met.filter((F.least("left_total", "right_total") >= 4) & (F.col("other") < F.col("line"))).select("page_id", "line")
        again = again.unionByName(equal).unionByName(alike).distinct()
    repeats = again.withColumn("_again", F.lit(True))
    return lines.join(repeats, ["page_id", "line"], "left").withColumn("first", F.col("_again").isNull()).drop("_again")


# ---- geometry of characters ---------------------------------------------

def fragment_chars(items: DataFrame, dir_: Column | None = None, with_outline: bool = False) -> DataFrame:
    """``chars`` (char, box, anchored) and ``angle`` of each item from its own box.

    The axis follows characters per extent: a clean column runs down, a box too
    wide for its column leans, everything else is a row. With ``with_outline``, ``outline`` has what :func:`outlined` adds.
    """
    dir_ = dir_ if dir_ is not None else F.when(is_tall(), "v").otherwise("h")
    w, h = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    m = F.greatest(F.lit(1), F.length("text"))
    mm = F.greatest(F.lit(2), m)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2

    # each step is a column of its own, compiled where functions over arrays are interpreted
    out = items.withColumn("_g", F.sqrt(w * w + h * h) / (mm + F.sqrt(F.lit(2.0))))
    out = out.withColumn("_lean", F.least(F.lit(0.999), F.greatest(F.lit(0.05), (h - F.col("_g")) / (mm * F.col("_g")))))
    column = h / mm >= w / mm * 1.3
    clean = column & (w <= h / mm * 1.8)
    leans = column | ((h > w / mm * 2.5) & (dir_ == "v"))
    out = out.withColumn("_shape", F.when(clean, "down").when(leans, "lean").otherwise("row"))
    shape, lean = F.col("_shape"), F.col("_lean")
    ux = F.when(shape == "down", 0.0).when(shape == "lean", F.sqrt(1 - lean * lean)).otherwise(1.0)
    uy = F.when(shape == "down", 1.0).when(shape == "lean", lean).otherwise(0.0)
    out = out.withColumn("_ux", ux).withColumn("_uy", uy).withColumn("_pitch", (w * F.col("_ux") + h * F.col("_uy")) / m)
    inputs = [F.col("text"), cx, cy, F.col("_ux"), F.col("_uy"), F.col("_pitch")]
    angle = half_up(F.degrees(F.atan2("_uy", "_ux"))).cast("int")
    out = out.withColumn("chars", F.arrow_udf(_fragment_cells, CHAR_TYPE)(*inputs)).withColumn("angle", angle)
    if with_outline:
        out = out.withColumn("outline", F.arrow_udf(_fragment_outline, OUTLINE_TYPE)(*inputs))
    return out.drop("_g", "_lean", "_shape", "_ux", "_uy", "_pitch")


BOX_ARROW = pa.struct([(name, pa.int64()) for name in ("x1", "y1", "x2", "y2")])
CHARS_ARROW = pa.list_(pa.struct([("char", pa.string()), ("box", BOX_ARROW), ("anchored", pa.bool_())]))


class _Cells:
    """The characters of a column of texts, one behind the other: ``row`` each belongs to and its place ``k`` there."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.sizes = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.k = np.arange(len(self.row)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def chars(self) -> pa.Array:
        joined = "".join(t or "" for t in self.texts.to_pylist())
        letters, at = np.unique(np.frombuffer(joined.encode("utf-32-le"), np.int32), return_inverse=True)
        return pa.array([chr(c) for c in letters.tolist()], type=pa.string()).take(pa.array(at))

    def each(self, values: pa.Array) -> np.ndarray:
        """The value of each character's row; NaN where there is none."""
        return values.to_numpy(zero_copy_only=False).astype(np.float64)[self.row]

    def listed(self, px: np.ndarray, py: np.ndarray, half: np.ndarray, anchored: bool, without: np.ndarray | None = None) -> pa.Array:
        """Characters with squares around their points, rounded half up; ``without`` tells those that have no square."""
        sides = [_whole(np.floor(v + 0.5)) for v in (px - half, py - half, px + half, py + half)]
        box = pa.StructArray.from_arrays(sides, fields=list(BOX_ARROW), mask=None if without is None else pa.array(without))
        cells = pa.StructArray.from_arrays([self.chars(), box, pa.array(np.full(len(self.k), anchored))], fields=list(CHARS_ARROW.value_type))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.sizes)).astype(np.int32)), cells)

    def outlines(self, px: np.ndarray, py: np.ndarray, half: np.ndarray, without: np.ndarray | None = None) -> pa.Array:
        """What :func:`outlined` finds in the characters, for each text, without handing them on."""
        some = np.flatnonzero(self.sizes)
        first, n = (np.cumsum(self.sizes) - self.sizes)[some], self.sizes[some]
        boxes = [np.floor(v + 0.5) for v in (px - half, py - half, px + half, py + half)]
        if without is not None:
            boxes = [np.where(without, np.nan, v) for v in boxes]
        x1, y1, x2, y2 = boxes

        def filled(values: np.ndarray, none: float = np.nan) -> np.ndarray:
            out = np.full(len(self.sizes), none)
            out[some] = values
            return out

        def least(v: np.ndarray, f: np.ufunc) -> np.ndarray:
            return f.reduceat(v, first) if len(some) else np.empty(0)

        boxed = np.ones(len(some), bool) if without is None or not len(some) else ~np.logical_or.reduceat(without, first)
        mid = first + n // 2
        # no size comes first, as in Spark
        size = np.fmax(x2 - x1, y2 - y1)
        order = np.lexsort((np.where(np.isnan(size), -np.inf, size), self.row))
        fields = [
            pa.array(self.sizes.astype(np.int32)), pa.array(filled(boxed, 0).astype(bool)),
            *(_whole(filled(least(v, f))) for v, f in ((x1, np.fmin), (y1, np.fmin), (x2, np.fmax), (y2, np.fmax))),
            *(_some(filled((u[at] + v[at]) / 2)) for at, u, v in ((mid, x1, x2), (mid, y1, y2))),
            _whole(filled(size[order][mid])), *(_some(filled((u[first] + v[first]) / 2)) for u, v in ((x1, x2), (y1, y2))),
        ]
        return pa.StructArray.from_arrays(fields, names=OUTLINE)


def _some(v: np.ndarray) -> pa.Array:
    return pa.array(v, mask=np.isnan(v))


def _whole(v: np.ndarray) -> pa.Array:
    none = np.isnan(v)
    return pa.array(np.where(none, 0.0, v).astype(np.int64), mask=none)


def _fragment_points(
    text: pa.Array, cx: pa.Array, cy: pa.Array, ux: pa.Array, uy: pa.Array, pitch: pa.Array
) -> tuple[_Cells, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Equal squares along the axis of each text, around its centre."""
    cells = _Cells(text)
    p = cells.each(pitch)
    off = (cells.k - (cells.sizes[cells.row] - 1) / 2) * p
    return cells, (cells.each(cx) + cells.each(ux) * off, cells.each(cy) + cells.each(uy) * off, p / 2)


def _fragment_cells(text: pa.Array, cx: pa.Array, cy: pa.Array, ux: pa.Array, uy: pa.Array, pitch: pa.Array) -> pa.Array:
    cells, squares = _fragment_points(text, cx, cy, ux, uy, pitch)
    return cells.listed(*squares, True)


def _fragment_outline(text: pa.Array, cx: pa.Array, cy: pa.Array, ux: pa.Array, uy: pa.Array, pitch: pa.Array) -> pa.Array:
    cells, squares = _fragment_points(text, cx, cy, ux, uy, pitch)
    return cells.outlines(*squares)


def _seated_points(
    text: pa.Array, slot: pa.Array, ax: pa.Array, ay: pa.Array, base: pa.Array, pitch: pa.Array, w: pa.Array, h: pa.Array, sx: pa.Array
) -> tuple[_Cells, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Squares from the start of the seat's column on, kept within 40 px of the image; a line without a seat has none."""
    cells = _Cells(text)
    p, s, x, y = (cells.each(c) for c in (pitch, slot, ax, ay))
    half = p / 2
    along = cells.each(base) + (cells.k + 0.5) * p

    def clamp(v: np.ndarray, side: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(side), v, np.fmax(half - 40, np.fmin(side - half + 40, v)))

    px, py = clamp(x * along - y * s, cells.each(w)), clamp(y * along + x * s, cells.each(h))
    return cells, (px, py, half), np.isnan(cells.each(sx))


def _seated_cells(
    text: pa.Array, slot: pa.Array, ax: pa.Array, ay: pa.Array, base: pa.Array, pitch: pa.Array, w: pa.Array, h: pa.Array, sx: pa.Array
) -> pa.Array:
    cells, squares, without = _seated_points(text, slot, ax, ay, base, pitch, w, h, sx)
    return cells.listed(*squares, False, without)


def _seated_outline(
    text: pa.Array, slot: pa.Array, ax: pa.Array, ay: pa.Array, base: pa.Array, pitch: pa.Array, w: pa.Array, h: pa.Array, sx: pa.Array
) -> pa.Array:
    cells, squares, without = _seated_points(text, slot, ax, ay, base, pitch, w, h, sx)
    return cells.outlines(*squares, without)


OUTLINE_TYPE = "struct<n:int,boxed:boolean,x1:bigint,y1:bigint,x2:bigint,y2:bigint,px:double,py:double,pitch:bigint,hx:double,hy:double>"
OUTLINE = ["n", "boxed", "x1", "y1", "x2", "y2", "px", "py", "pitch", "hx", "hy"]


def outlined(lines: DataFrame) -> DataFrame:
    """``outline`` of each line's characters: their number, whether all have a box, the box around them, the centres of the
    middle (px, py) and the first one (hx, hy), and the upper middle of their sizes.

    Lines that were made with it have it from the kernel that made the characters, so these need not travel.
    """
    if "outline" in lines.columns:
        return lines
    boxes = F.col("chars")["box"]
    mid, head = F.get(boxes, F.floor(F.size(boxes) / 2).cast("int")), F.get(boxes, F.lit(0))
    sizes = F.array_sort(F.transform(boxes, lambda b: F.greatest(b.x2 - b.x1, b.y2 - b.y1)))
    boxed = (F.size("chars") > 0) & ~F.exists(boxes, lambda b: b.isNull())
    values = [
        F.size("chars"), boxed, F.array_min(boxes["x1"]), F.array_min(boxes["y1"]), F.array_max(boxes["x2"]), F.array_max(boxes["y2"]),
        (mid.x1 + mid.x2) / 2, (mid.y1 + mid.y2) / 2, F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")), (head.x1 + head.x2) / 2, (head.y1 + head.y2) / 2,
    ]
    return lines.withColumn("outline", F.struct(*[v.alias(name) for v, name in zip(values, OUTLINE)]))


# ---- seating ------------------------------------------------------------

def page_lattice(fused: DataFrame, pages: DataFrame) -> DataFrame:
    """Angle, axes, pitch, column gap and start of the columns that the fragment lines of ``pages`` form."""
    # characters are many: what travels is seven numbers a line
    rows = outlined(fused).select("page_id", "angle", *[f"outline.{name}" for name in ("px", "py", "pitch", "hx", "hy")])
    rows = cut_lineage(rows.join(pages, "page_id", "left_semi"))
    medians = rows.groupBy("page_id").agg(upper_median("angle").alias("page_angle"))
    a = F.radians("page_angle")
    rows = rows.join(medians, "page_id").withColumn("ax", F.cos(a)).withColumn("ay", F.sin(a))
    rows = rows.select(
        "page_id", "page_angle", "ax", "ay", "px", "py", "pitch", (F.col("hx") * F.col("ax") + F.col("hy") * F.col("ay")).alias("start")
    )
    return cut_lineage(rows.withColumn("cross", -F.col("px") * F.col("ay") + F.col("py") * F.col("ax")))


def seat_in_gaps(fused: DataFrame, groups: DataFrame, dims: DataFrame) -> DataFrame:
    """Seats (page_id, seat, sx, sy and the page's lattice) for lines the fragments lack.

    ``groups`` has one row per line to seat, numbered ``group`` from 1 in answer
    order. Seats are the wide gaps between columns and steps past the last one,
    inside the image and 0.9 pitch from every other; taken in reading order, the
    k-th free seat belongs to the k-th line.
    """
    wanted = groups.groupBy("page_id").agg(F.count("*").alias("wanted"))
    rows = page_lattice(fused, wanted.select("page_id"))
    page = rows.groupBy("page_id").agg(
        F.first("page_angle").alias("page_angle"),
        F.first("ax").alias("ax"),
        F.first("ay").alias("ay"),
        upper_median("pitch").alias("pitch"),
        upper_median("start").alias("base"),
        F.max("cross").alias("last"),
    )
    w = Window.partitionBy("page_id").orderBy("cross")
    gaps = rows.select("page_id", "cross", F.lag("cross").over(w).alias("before")).filter("before is not null")
    gaps = gaps.withColumn("gap", F.col("cross") - F.col("before"))
    columns = gaps.groupBy("page_id").agg(upper_median("gap").alias("column_gap"))
    page = page.join(columns, "page_id", "left").withColumn("column_gap", F.coalesce("column_gap", F.col("pitch") * 1.2))
    page = cut_lineage(page.join(wanted, "page_id").join(dims.select("page_id", "w", "h"), "page_id", "left"))
    wide = 1.8 * F.least(F.col("column_gap"), F.col("pitch") * 1.5)
    inner = gaps.join(page, "page_id").filter(F.col("gap") >= wide).withColumn("at", (F.col("cross") + F.col("before")) / 2)
    inner = inner.withColumn("turn", F.lit(0)).drop("cross", "before", "gap")
    outer = page.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("wanted").cast("int"))))
    outer = outer.withColumn("at", F.col("last") + F.col("column_gap") * F.col("turn"))
    seats = inner.unionByName(outer.select(*inner.columns))
    corners = [-F.col("w") * F.col("ay"), F.col("h") * F.col("ax"), -F.col("w") * F.col("ay") + F.col("h") * F.col("ax"), F.lit(0.0)]
    within = F.col("w").isNull() | F.col("at").between(F.least(*corners), F.greatest(*corners))
    seats = seats.filter(within)
    sx, sy = F.col("ax") * F.col("base") - F.col("ay") * F.col("at"), F.col("ay") * F.col("base") + F.col("ax") * F.col("at")
    seats = seats.withColumn("sx", sx).withColumn("sy", sy)
    p = F.col("pitch")
    seats = seats.filter(
        F.col("w").isNull()
        | ((F.col("sx") > -p) & (F.col("sx") < F.col("w") + p) & (F.col("sy") > -p) & (F.col("sy") < F.col("h") + p))
    )

    seats = cut_lineage(seats)

    # fragments 0.9 pitch around a seat block it: look at the cells of four pitches that a pitch around it touches, mostly one or two
    def cells(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - p) / (4 * p)), F.floor((F.col(c) + p) / (4 * p))))

    around = seats.select("page_id", "at", "turn", "sx", "sy", "pitch").withColumn("cx", cells("sx")).withColumn("cy", cells("sy"))
    taken = rows.select("page_id", "px", "py").join(page.select("page_id", F.col("pitch").alias("_p")), "page_id")
    taken = taken.select("page_id", "px", "py", F.floor(F.col("px") / (4 * F.col("_p"))).alias("cx"), F.floor(F.col("py") / (4 * F.col("_p"))).alias("cy"))
    blocked = (
        around.join(taken, ["page_id", "cx", "cy"])
        .filter(F.sqrt(F.pow(F.col("px") - F.col("sx"), 2) + F.pow(F.col("py") - F.col("sy"), 2)) < 0.9 * p)
        .select("page_id", "at", "turn")
        .distinct()
    )
    free = seats.join(blocked, ["page_id", "at", "turn"], "left_anti")
    down = F.abs("page_angle") > 45
    free = free.withColumn("order_at", F.when(down, -F.col("sx")).otherwise(F.col("sy")))
    half = 0.45 * p
    free = free.withColumn("x1", F.col("sx") - half).withColumn("x2", F.col("sx") + half)
    free = free.withColumn("y1", F.col("sy") - half).withColumn("y2", F.col("sy") + half)

    def close(k: Column, x: Column) -> Column:
        return F.sqrt((k.sx - x.sx) * (k.sx - x.sx) + (k.sy - x.sy) * (k.sy - x.sy)) < 0.9 * x.pitch

    # read twice: pages are counted before they are decided
    kept = greedy_keep(cut_lineage(free), "page_id", ["order_at", "turn", "at"], close, ["sx", "sy", "pitch"])
    w = Window.partitionBy("page_id").orderBy("order_at", "turn", "at")
    numbered = kept.withColumn("seat", F.row_number().over(w)).filter(F.col("seat") <= F.col("wanted"))
    return numbered.select("page_id", "seat", "sx", "sy", "page_angle", "ax", "ay", "pitch", "base", "w", "h")


def place_lines(groups: DataFrame, seats: DataFrame) -> DataFrame:
    """Seated lines with inferred character boxes; lines without a seat keep their text only."""
    rows = groups.join(seats.withColumnRenamed("seat", "group"), ["page_id", "group"], "left")
    slot = -F.col("sx") * F.col("ay") + F.col("sy") * F.col("ax")
    inputs = [F.col("clean"), slot, *map(F.col, ("ax", "ay", "base", "pitch", "w", "h", "sx"))]
    return rows.select(
        "page_id",
        F.lit(None).cast("int").alias("position"),
        "line",
        "dir",
        F.col("clean").alias("text"),
        F.arrow_udf(_seated_cells, CHAR_TYPE)(*inputs).alias("chars"),
        F.col("page_angle").cast("int").alias("angle"),
        F.lit(False).alias("improved"),
        F.col("sx").isNotNull().alias("inferred"),
        "gaps",
        F.arrow_udf(_seated_outline, OUTLINE_TYPE)(*inputs).alias("outline"),
    )


# ---- composition --------------------------------------------------------

def fuse_pages(items: DataFrame, answers: DataFrame, dims: DataFrame, script_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """``lines`` (fragment lines, then seated and loose lines), ``dropped`` and ``degenerate`` pages."""
    # what is written here is read several times below; characters are not, they follow from their line where they are needed
    keep = cut_lineage(dedupe_items(with_norm(items, "text", script_map)))
    lines = cut_lineage(with_norm(read_answers(answers), "clean", script_map).select("page_id", "line", "dir", "clean", "gaps", "norm"))
    windows = cut_lineage(align_pairs(keep, lines, accepted_only=True).drop("reading"))
    improved = improve_fragments(keep, lines, windows)
    ordered = reading_order_items(keep, single_tall=True).join(improved, ["page_id", "item"], "left")
    ordered = cut_lineage(
        ordered.select("page_id", "position", "tall", "x1", "y1", "x2", "y2", F.coalesce("improved", "text").alias("text"), "improved")
    )
    fragments = fragment_chars(ordered, with_outline=True).select(
        "page_id",
        F.col("position").cast("int").alias("position"),
        F.lit(None).cast("int").alias("line"),
        F.when(F.col("tall"), "v").otherwise("h").alias("dir"),
        "text",
        "chars",
        "angle",
        F.col("improved").isNotNull().alias("improved"),
        F.lit(False).alias("inferred"),
        F.array().cast(GAP_TYPE).alias("gaps"),
        "outline",
    )
    missing = cut_lineage(unmatched_lines(lines, windows))
    lattice = cut_lineage(lattice_degenerate(keep, missing, verdict_only=True))
    usable = missing.join(lattice.filter("not degenerate").select("page_id"), "page_id", "left_semi")
    grouped = group_variant_lines(usable)
    w = Window.partitionBy("page_id").orderBy("line")
    groups = cut_lineage(grouped.filter("first").withColumn("group", F.row_number().over(w)))
    placed = place_lines(groups, seat_in_gaps(fragments, groups, dims))
    return {
        "lines": fragments.unionByName(placed),
        "dropped": grouped.filter("not first").select("page_id", "line", F.col("clean").alias("text")),
        "degenerate": lattice,
    }


def lines_contract(fused: DataFrame) -> DataFrame:
    """Served form: box is the union of the character boxes, direction follows the angle."""
    anchored = F.col("outline.boxed")

    def edge(name: str) -> Column:
        return F.when(anchored, F.col(f"outline.{name}")).alias(name)

    return outlined(fused).select(
        "page_id",
        "position",
        "line",
        "text",
        *map(edge, ("x1", "y1", "x2", "y2")),
        F.when(anchored, F.when(F.abs("angle") > 45, "v").otherwise("h")).otherwise(F.col("dir")).alias("dir"),
        F.when(anchored, F.col("angle")).alias("angle"),
        F.when(anchored, F.col("chars")["box"]).alias("char_boxes"),
        F.col("outline.n").alias("n"),
        F.col("inferred"),
        anchored.alias("boxed"),
    )


def serve_decision(items: DataFrame, fusion: dict[str, DataFrame], use_fusion: bool = True) -> DataFrame:
    """Which reading each page is served from: fusion, classical or vector, with the gates' reasons."""
    served = lines_contract(fusion["lines"])
    rows = served.select(
        "page_id",
        F.col("n").alias("chars"),
        (~F.col("inferred")).alias("anchored"),
        "boxed",
        F.col("boxed").alias("has_char_boxes"),
    )
    gate = page_serve_gate(rows, fusion["degenerate"])
    classical = page_gate(items).select("page_id", F.col("passes").alias("classical"))
    # pages without detector items are served from the vector rung
    every = items.select("page_id").union(fusion["lines"].select("page_id")).distinct()
    pages = every.join(gate, "page_id", "left").join(classical, "page_id", "left")
    by = F.when(F.lit(use_fusion) & F.col("serves"), "fusion").when(F.lit(not use_fusion) & F.col("classical"), "classical").otherwise("vector")
    return pages.withColumn("served_by", by)
