"""Page-geometry operators over order lines laid out as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkstone.functions.geometry import quad_of_box
from inkstone.operators import boxes as bx
from inkstone.plans.registry import query
from inkstone.plans.views import (
    SQL_PAGE_COLUMNS,
    SQL_PAGE_ITEMS,
    SQL_PAGE_LINES,
    SQL_PAGE_QUADS,
    SQL_SHEET_ITEMS,
    page_columns,
    page_items,
    page_lines,
    page_quads,
    sheet_items,
)


def sql_inter(a: str = "a", b: str = "b") -> str:
    return (
        f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    )


def sql_area(a: str) -> str:
    return f"({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)"


def sql_iou(a: str = "a", b: str = "b") -> str:
    return f"({sql_inter(a, b)}) / ({sql_area(a)} + {sql_area(b)} - ({sql_inter(a, b)}))"


def sql_overlap(a: str = "a", b: str = "b") -> str:
    return f"({sql_inter(a, b)}) / least({sql_area(a)}, {sql_area(b)})"


def sql_similar(a: str, b: str) -> str:
    hits = (
        f"coalesce(list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: "
        f"least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, ''))))), 0)"
    )
    return f"({hits} / greatest(1, least(length({a}), length({b}))))"


def sql_greedy(name: str, ranked: str, condition: str) -> str:
    """Recursive greedy pass over ``ranked`` (page_id, k from 1, …); a is earlier, b later."""
    return f"""{name}_conf as (
  select b.page_id, b.k, list(a.k) as prevs from {ranked} a join {ranked} b on a.page_id = b.page_id and a.k < b.k and ({condition}) group by 1, 2),
{name}_walk as (
  select page_id, cast(0 as bigint) as k, cast([] as bigint[]) as kept from (select distinct page_id from {ranked})
  union all
  select w.page_id, w.k + 1, case when list_has_any(w.kept, coalesce(c.prevs, cast([] as bigint[]))) then w.kept else list_append(w.kept, w.k + 1) end
  from {name}_walk w join {ranked} r on r.page_id = w.page_id and r.k = w.k + 1 left join {name}_conf c on c.page_id = w.page_id and c.k = w.k + 1),
{name}_done as (select page_id, arg_max(kept, k) as kept from {name}_walk group by 1),
{name} as (select r.* from {ranked} r join {name}_done d on d.page_id = r.page_id and list_contains(d.kept, r.k))"""


# ---- pairs and coverage -------------------------------------------------

@query(
    "overlap_pairs",
    f"""with {SQL_PAGE_ITEMS} select a.page_id, a.item as a_item, b.item as b_item, cast(floor(({sql_iou()}) * 1000000) as bigint) as overlap_ppm
    from page_items a join page_items b on a.page_id = b.page_id and a.item < b.item where {sql_iou()} >= 0.6""",
)
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    ppm = F.floor(F.col("overlap") * 1000000).alias("overlap_ppm")
    return bx.overlap_pairs(page_items(spark, sf)).select("page_id", "a_item", "b_item", ppm)


@query(
    "overlap_pairs_smaller",
    f"""with {SQL_SHEET_ITEMS} select a.page_id, count(*) as pairs, cast(sum(cast(floor(({sql_overlap()}) * 1000000) as bigint)) as bigint) as total_ppm
    from sheet_items a join sheet_items b on a.page_id = b.page_id and a.item < b.item where {sql_overlap()} >= 0.6 group by 1""",
)
def overlap_pairs_smaller(spark: SparkSession, sf: str) -> DataFrame:
    pairs = bx.overlap_pairs(sheet_items(spark, sf), "smaller")
    return pairs.groupBy("page_id").agg(F.count("*").alias("pairs"), F.sum(F.floor(F.col("overlap") * 1000000)).alias("total_ppm"))


@query(
    "coverage_gaps",
    f"""with {SQL_PAGE_ITEMS}, regions as (select * from page_items where l_partkey % 2 = 0), its as (select * from page_items where l_partkey % 2 = 1),
    sums as (select a.page_id, a.item, sum({sql_inter()}) as covered from regions a join its b on a.page_id = b.page_id group by 1, 2)
    select r.page_id, r.item as region, coalesce(covered, 0) as covered from regions r left join sums s using (page_id, item)
    where coalesce(covered, 0) / ({sql_area('r')}) < 0.5""",
)
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    regions = p.filter("l_partkey % 2 = 0").withColumnRenamed("item", "region")
    return bx.coverage_gaps(regions, p.filter("l_partkey % 2 = 1")).select("page_id", "region", "covered")


@query(
    "census_regions",
    f"""with {SQL_PAGE_ITEMS}, r as (select page_id, item, x1 * 4 - 100 as x1, y1 * 6 as y1, x2 * 4 - 100 as x2, y2 * 6 as y2 from page_items)
    select page_id, item, floor(x1 / 1000 * 300 + 0.5) as x1, floor(y1 / 1000 * 200 + 0.5) as y1, floor(x2 / 1000 * 300 + 0.5) as x2, floor(y2 / 1000 * 200 + 0.5) as y2
    from r where x1 >= -60 and x2 <= 1060 and y1 >= -60 and y2 <= 1060""".replace("floor(", "cast(floor(").replace("+ 0.5)", "+ 0.5) as bigint)"),
)
def census_regions(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf).select(
        "page_id", "item", (F.col("x1") * 4 - 100).alias("x1"), (F.col("y1") * 6).alias("y1"),
        (F.col("x2") * 4 - 100).alias("x2"), (F.col("y2") * 6).alias("y2"), F.lit(300).alias("w"), F.lit(200).alias("h"),
    )
    return bx.regions_to_pixels(p).drop("w", "h")


POINTS = """points as (
  select page_id, item as char_id, x1 + 5.0 as px, y2 + 9.0 as py, 6.0 + l_partkey % 7 as pitch from page_items where l_partkey % 3 = 0),
anchors as (select * from page_items where l_partkey % 3 <> 0),
near as (
  select p.page_id, p.char_id, a.item, sqrt(power((a.x1 + a.x2) / 2 - px, 2) + power((a.y1 + a.y2) / 2 - py, 2)) as d, pitch
  from points p join anchors a on a.page_id = p.page_id)"""


@query(
    "nearest_anchor",
    f"""with {SQL_PAGE_ITEMS}, {POINTS}, best as (select page_id, char_id, arg_min(item, (d, item)) as item, min(d) as d from near where d < 2 * pitch group by 1, 2)
    select p.page_id, p.char_id, b.item, round(b.d, 6) as distance, b.item is not null as anchored from points p left join best b using (page_id, char_id)""",
)
def nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    points = p.filter("l_partkey % 3 = 0").select(
        "page_id", F.col("item").alias("char_id"), (F.col("x1") + 5.0).alias("px"), (F.col("y2") + 9.0).alias("py"), (F.col("l_partkey") % 7 + 6.0).alias("pitch")
    )
    out = bx.nearest_anchor(points, p.filter("l_partkey % 3 <> 0"))
    return out.select("page_id", "char_id", "item", F.round("distance", 6).alias("distance"), "anchored")


# ---- gates --------------------------------------------------------------

@query(
    "page_gate",
    f"""with {SQL_PAGE_ITEMS}, i as (select *, length(text) as n, case when length(text) >= 2 then (x2 - x1) / length(text) end as pitch from page_items),
    s as (select page_id, count(*) as items, count(*) filter (score >= 0.75) as confident, round(avg(score), 9) as mean_score, sum(n) as chars,
                 cast(percentile_disc(0.5) within group (order by n desc) as int) as median_chars, avg(case when n = 1 then 1 else 0 end) as singles,
                 count(pitch) as pitched, avg(pitch) as pm, stddev_pop(pitch) as psd from i group by 1)
    select page_id, items, confident, chars, median_chars, r is null as passes, r as reason from (
      select *, case when confident < 3 then 'few confident items' when mean_score < 0.78 then 'low mean score' when chars < 8 then 'few characters'
                     when median_chars < 3 then 'short items' when singles > 0.5 then 'single characters'
                     when pitched >= 3 and pm > 0 and psd / pm > 0.6 then 'uneven pitch' end as r from s)""",
)
def page_gate(spark: SparkSession, sf: str) -> DataFrame:
    return bx.page_gate(page_items(spark, sf))


SERVE = """lines as (
  select page_id, length(text) as chars, l_partkey % 3 <> 0 as anchored, l_partkey % 4 <> 0 as boxed, l_partkey % 5 = 1 as has_char_boxes from page_items),
bad as (select distinct page_id from page_items where l_partkey % 97 = 0),
sums as (
  select page_id, sum(chars) as total, sum(case when anchored then chars else 0 end) as anchored_chars, sum(case when boxed then chars else 0 end) as boxed_chars,
         bool_or(has_char_boxes) as any_boxes, page_id in (select page_id from bad) as bad from lines group by 1)"""


@query(
    "page_serve_gate",
    f"""with {SQL_PAGE_ITEMS}, {SERVE}
    select page_id, total, anchored_chars, boxed_chars, round(anchored_chars / total, 6) as anchored_fraction, round(boxed_chars / total, 6) as boxed_fraction,
           r is null as serves, r as reason from (
      select *, case when bad then 'degenerate lattice' when anchored_chars / total < 0.2 or anchored_chars < 6 then 'few anchored characters'
                     when boxed_chars / total < 0.5 then 'few boxed characters' when not any_boxes then 'no character boxes' end as r from sums)""",
)
def page_serve_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    lines = p.select(
        "page_id", F.length("text").alias("chars"), (F.col("l_partkey") % 3 != 0).alias("anchored"),
        (F.col("l_partkey") % 4 != 0).alias("boxed"), (F.col("l_partkey") % 5 == 1).alias("has_char_boxes"),
    )
    bad = p.select("page_id", (F.col("l_partkey") % 97 == 0).alias("degenerate"))
    return bx.page_serve_gate(lines, bad)


@query(
    "lattice_degenerate",
    f"""with {SQL_PAGE_ITEMS}, f as (select * from page_items where l_partkey % 3 <> 0), u as (select page_id, count(*) as unmatched from page_items where l_partkey % 3 = 0 group by 1),
    worst as (select a.page_id, max({sql_overlap()}) as m from f a join f b on a.page_id = b.page_id and a.item < b.item group by 1),
    c as (select page_id, count(*) as fragments from f group by 1)
    select page_id, fragments, coalesce(unmatched, 0) as unmatched, cast(floor(coalesce(m, 0.0) * 1000000) as bigint) as max_overlap_ppm,
           coalesce(unmatched, 0) > fragments and coalesce(m, 0.0) >= 0.6 as degenerate
    from c left join u using (page_id) left join worst using (page_id)""",
)
def lattice_degenerate(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    rows = bx.lattice_degenerate(p.filter("l_partkey % 3 <> 0"), p.filter("l_partkey % 3 = 0"))
    ppm = F.floor(F.col("max_overlap") * 1000000).alias("max_overlap_ppm")
    return rows.select("page_id", "fragments", "unmatched", ppm, "degenerate")


WORDS = """words as (
  select page_id, l_linenumber as line, item as word, case when l_partkey % 9 <> 0 then (l_partkey % 5) * 20 - l_linenumber end as angle,
         case when l_partkey % 4 <> 1 then x1 end as x1, y1, x2, y2 from sheet_items)"""


@query(
    "angle_coherence",
    f"""with {SQL_SHEET_ITEMS}, {WORDS},
    l as (select page_id, line, arg_min(angle, word) filter (angle is not null) as a, count(*) as n, count(angle) as angled, count(x1) as boxed from words group by 1, 2),
    p as (select page_id, percentile_disc(0.5) within group (order by a desc) as med, sum(n) as words, sum(angled) as angled from l group by 1),
    j as (select l.*, p.words, p.angled as page_angled, abs(a - med) > 25 as deviant from l join p using (page_id)),
    t as (select page_id, sum(case when deviant then n else 0 end) as dw, sum(case when not deviant then boxed else 0 end) as cb from j group by 1),
    v as (select j.page_id, line, words >= 6 and page_angled >= 6 as applies, words >= 6 and page_angled >= 6 and (cb = 0 or dw > words / 2) as all_off, coalesce(deviant, false) as deviant
          from j join t using (page_id))
    select w.page_id, w.line, w.word, case when not (all_off or (applies and deviant)) then x1 end as x1, not all_off as positioned
    from words w join v using (page_id, line)""",
)
def angle_coherence(spark: SparkSession, sf: str) -> DataFrame:
    words = sheet_items(spark, sf).select(
        "page_id", F.col("l_linenumber").alias("line"), F.col("item").alias("word"),
        F.when(F.col("l_partkey") % 9 != 0, (F.col("l_partkey") % 5) * 20 - F.col("l_linenumber")).alias("angle"),
        F.when(F.col("l_partkey") % 4 != 1, F.col("x1")).alias("x1"), "y1", "x2", "y2",
    )
    return bx.page_angle_coherence(words).select("page_id", "line", "word", "x1", "positioned")


VECTOR_ANGLE = "degrees(atan2(ty - fy, tx - fx))"


@query(
    "angle_clusters",
    f"with {SQL_PAGE_LINES} select page_id, cast(floor({VECTOR_ANGLE} / 2 + 0.5) * 2 as int) as cluster, count(*) as n from page_lines group by 1, 2",
)
def angle_clusters(spark: SparkSession, sf: str) -> DataFrame:
    lines = page_lines(spark, sf).withColumn("angle", F.degrees(F.atan2(F.col("ty") - F.col("fy"), F.col("tx") - F.col("fx"))))
    return bx.angle_clusters(lines)


@query(
    "angle_histogram",
    f"""with {SQL_PAGE_LINES}, c as (select page_id // 40 as page_id, cast(floor({VECTOR_ANGLE} / 15 + 0.5) * 15 as int) as bucket, count(*) as n from page_lines group by 1, 2)
    select page_id, bucket, n, rank from (select *, row_number() over (partition by page_id order by n desc, bucket) as rank from c) where rank <= 4""",
)
def angle_histogram(spark: SparkSession, sf: str) -> DataFrame:
    lines = page_lines(spark, sf).withColumn("page_id", F.floor(F.col("page_id") / 40))
    return bx.angle_histogram(lines.withColumn("angle", F.degrees(F.atan2(F.col("ty") - F.col("fy"), F.col("tx") - F.col("fx")))))


@query(
    "pitch_spread",
    f"""with {SQL_PAGE_ITEMS}, p as (select page_id, cast(floor((x2 - x1) / greatest(1, length(text)) + 0.5) as bigint) as pitch from page_items)
    select page_id, min(pitch) as pitch_min, percentile_disc(0.5) within group (order by pitch desc) as pitch_median, max(pitch) as pitch_max from p group by 1""",
)
def pitch_spread(spark: SparkSession, sf: str) -> DataFrame:
    return bx.pitch_spread(page_items(spark, sf).withColumn("length", F.col("x2") - F.col("x1")))


# ---- quads --------------------------------------------------------------

AXIS = "(angle + 90) - 180 * floor((angle + 90) / 180) - 90"


@query(
    "quad_measures",
    f"""with {SQL_PAGE_QUADS}, m as (select *, {AXIS} as axis from page_quads)
    select page_id, item, edge, angle, axis, case when abs(axis) < 45 then abs(angle) > 90 else angle < 0 end as flip,
           cast(greatest(2, floor(longest / greatest(1, shortest) + 0.5)) as int) as expected_chars from m""",
)
def quad_measures(spark: SparkSession, sf: str) -> DataFrame:
    return bx.quad_measures(page_quads(spark, sf)).select("page_id", "item", "edge", "angle", "axis", "flip", "expected_chars")


@query(
    "flag_read_length",
    f"""with {SQL_PAGE_QUADS} select page_id, item, abs(length(text) - e) > greatest(3, e * 0.4) as flagged
    from (select *, greatest(2, floor(longest / greatest(1, shortest) + 0.5)) as e from page_quads)""",
)
def flag_read_length(spark: SparkSession, sf: str) -> DataFrame:
    q = bx.quad_measures(page_quads(spark, sf))
    return q.select("page_id", "item", bx.flag_read_length(F.length("text"), F.col("expected_chars")).alias("flagged"))


def _framed(page: str = "page_quads", angle: str = "angle") -> str:
    corners = "[{'x': l, 'y': t}, {'x': r, 'y': t}, {'x': r, 'y': b}, {'x': l, 'y': b}]"
    return f"""meds as (select page_id, percentile_disc(0.5) within group (order by {angle} desc) as med from {page} group by 1),
turned as (
  select q.*, med, list_transform({corners}, lambda p: p.x * cos(radians(med)) + p.y * sin(radians(med))) as xs,
         list_transform({corners}, lambda p: -p.x * sin(radians(med)) + p.y * cos(radians(med))) as ys
  from {page} q join meds using (page_id)),
framed as (select *, list_min(xs) as x1, list_min(ys) as y1, list_max(xs) as x2, list_max(ys) as y2 from turned)"""


@query(
    "dedupe_quads",
    f"""with recursive {SQL_PAGE_QUADS}, {_framed()},
    ranked as (select *, row_number() over (partition by page_id order by -round({sql_area('framed')}, 6), item) as k from framed),
    {sql_greedy('kept', 'ranked', sql_iou() + ' >= 0.6')}
    select page_id, item from kept""",
)
def dedupe_quads(spark: SparkSession, sf: str) -> DataFrame:
    return bx.dedupe_quads(page_quads(spark, sf).select("page_id", "item", "pts")).select("page_id", "item")


@query(
    "reading_order_quads",
    f"""with {SQL_PAGE_QUADS}, {_framed()}, bands as (select page_id, percentile_disc(0.5) within group (order by y2 - y1 desc) as band from framed group by 1)
    select page_id, item, row_number() over (partition by page_id order by case when abs(med) >= 45 then 0 else floor(y1 / greatest(1.0, band) + 0.5) end,
           case when abs(med) >= 45 then -(l + r) / 2.0 else x1 end, item) as position
    from framed join bands using (page_id)""",
)
def reading_order_quads(spark: SparkSession, sf: str) -> DataFrame:
    return bx.reading_order_quads(page_quads(spark, sf)).select("page_id", "item", "position")


@query(
    "axis_orders",
    f"""with {SQL_PAGE_QUADS}, {_framed()}, d as (
      select *, 'rows' as direction from framed where abs(med) < 45 union all
      select *, 'left to right' from framed where abs(med) >= 45 union all select *, 'right to left' from framed where abs(med) >= 45)
    select page_id, item, direction, row_number() over (partition by page_id, direction order by case when direction = 'rows' then round_even(y1 / 60.0, 0) else 0 end,
           case when direction = 'right to left' then -x1 else x1 end, item) as position from d""",
)
def axis_orders(spark: SparkSession, sf: str) -> DataFrame:
    return bx.axis_orders(page_quads(spark, sf))


@query("merge_collinear")
def merge_collinear(spark: SparkSession, sf: str) -> DataFrame:
    merged = bx.merge_collinear(page_quads(spark, sf))
    pts = F.transform("pts", lambda p: F.struct(F.round(p.x, 3).alias("x"), F.round(p.y, 3).alias("y")))
    return merged.select("page_id", "item", "members", F.to_json(pts).alias("pts"))


@query(
    "column_gaps",
    f"""with {SQL_PAGE_COLUMNS}, s as (select page_id, cx, cx - lag(cx) over (partition by page_id order by cx, item) as pitch, lag(cx) over (partition by page_id order by cx, item) as prev from page_columns),
    n as (select page_id, count(*) as n, percentile_disc(0.5) within group (order by pitch desc) as med from s group by 1 having count(*) >= 4),
    e as (select s.page_id from s join n using (page_id) where pitch is not null and med between 8 and 500 group by 1 having avg(case when abs(pitch - med) <= 0.25 * med then 1 else 0 end) >= 0.6),
    g as (select s.*, med, cast(floor(pitch / med + 0.5) - 1 as int) as missing from s join n using (page_id) where page_id in (select page_id from e) and pitch >= 1.6 * med)
    select page_id, prev as after_cx, k, prev + pitch * k / (missing + 1) as cx from g, range(1, 3) t(k) where missing between 1 and 2 and k <= missing""",
)
def column_gaps(spark: SparkSession, sf: str) -> DataFrame:
    made = bx.fill_column_gaps(page_columns(spark, sf))
    x = (F.get("pts", F.lit(0)).x + F.get("pts", F.lit(1)).x) / 2
    return made.select("page_id", F.col("after_cx").cast("long").alias("after_cx"), "k", x.alias("cx"))


@query(
    "char_cells",
    f"""with {SQL_PAGE_QUADS}, q as (select *, r - l > b - t or (r - l = b - t and turn % 2 = 0) as across, length(text) as n from page_quads),
    c as (select *, unnest(range(n)) as i, case when across then r - l else b - t end as len, greatest(4.0, (case when across then r - l else b - t end) / n) / 2 as half from q),
    p as (select *, case when across then l + len * ((i + 0.5) / n) else (l + r) / 2.0 end as cx, case when across then (t + b) / 2.0 else t + len * ((i + 0.5) / n) end as cy from c)
    select page_id, item, i as cell_no, cast(floor(cx - half + 0.5) as bigint) as x1, cast(floor(cy - half + 0.5) as bigint) as y1,
           cast(floor(cx + half + 0.5) as bigint) as x2, cast(floor(cy + half + 0.5) as bigint) as y2 from p""",
)
def char_cells(spark: SparkSession, sf: str) -> DataFrame:
    return bx.char_cells(page_quads(spark, sf).withColumn("n", F.length("text")))


@query(
    "split_multiline",
    f"""with {SQL_PAGE_ITEMS}, s as (select page_id, item, x1, y1, x2, y2, list_filter(list_transform(string_split(text, ' '), lambda t: trim(t)), lambda t: t <> '') as parts, x2 - x1 >= y2 - y1 as across from page_items)
    , p as (select *, len(parts) as k, unnest(parts) as part, unnest(range(len(parts))) as strip from s)
    select page_id, item, strip, part as text, round(case when across then x1 else x2 - (x2 - x1) * strip / k end, 6) as px, round(case when across then y1 + (y2 - y1) * strip / k else y1 end, 6) as py from p""",
)
def split_multiline(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    reads = p.select(
        "page_id", "item", F.replace("text", F.lit(" "), F.lit("\n")).alias("text"),
        quad_of_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("pts"),
    )
    first = F.get("pts", F.lit(0))
    # a strip's first corner: the upper left of a row, the upper right of a column; a lone line keeps its quad
    across = (F.get("pts", F.lit(1)).x - first.x) >= (F.get("pts", F.lit(2)).y - first.y)
    strips = bx.split_multiline(reads)
    counts = strips.groupBy("page_id", "item").agg(F.count("*").alias("k"))
    tall = p.select("page_id", "item", (F.col("x2") - F.col("x1") < F.col("y2") - F.col("y1")).alias("tall"), F.col("x2").alias("right"))
    rows = strips.join(counts, ["page_id", "item"]).join(tall, ["page_id", "item"])
    px = F.when(F.col("tall") & (F.col("k") == 1), F.col("right")).otherwise(first.x)
    return rows.select("page_id", "item", "strip", "text", F.round(px, 6).alias("px"), F.round(first.y, 6).alias("py"))


# ---- items --------------------------------------------------------------

@query("dedupe_items")
def dedupe_items(spark: SparkSession, sf: str) -> DataFrame:
    return bx.dedupe_items(sheet_items(spark, sf)).select("page_id", "item", "text")


@query(
    "page_reading_order",
    f"""with {SQL_SHEET_ITEMS}, i as (select *, (y2 - y1) > (x2 - x1) * 1.3 and length(text) > 1 as tall from sheet_items),
    m as (select page_id, tall, percentile_disc(0.5) within group (order by case when tall then x2 - x1 else y2 - y1 end desc) as ext from i group by 1, 2),
    b as (select i.*, floor((case when tall then x1 + x2 else y1 + y2 end) / 2.0 / greatest(4.0::double, 0.3::double * ext) + 0.5) as band from i join m using (page_id, tall))
    select page_id, item, tall, row_number() over (partition by page_id order by tall, case when tall then -band else band end, case when tall then y1 else x1 end, item) as position from b""",
)
def page_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return bx.reading_order_items(sheet_items(spark, sf)).select("page_id", "item", "tall", "position")


@query(
    "heal_coordinates",
    f"""with {SQL_PAGE_ITEMS}, i as (select page_id, item, l_partkey % 6 = 0 as has_vector, x1 * (1 + page_id % 5) as x1, y1 * (1 + page_id % 5) as y1, x2 * (1 + page_id % 5) as x2, y2 * (1 + page_id % 5) as y2, 700 as w, 500 as h from page_items),
    m as (select page_id, max(greatest(x2, y2)) as mx, max(x2 > w * 1.02) as bx, max(y2 > h * 1.02) as bh from i where not has_vector group by 1),
    s as (select i.*, mx <= 1005 as grid, bx, bh, case when mx <= 1005 or bx then w / 1000 else 1.0 end as sx, case when mx <= 1005 or bh then h / 1000 else 1.0 end as sy from i left join m using (page_id)),
    c as (select *, least(w - 1, floor(x1 * sx + 0.5)) as a1, least(h - 1, floor(y1 * sy + 0.5)) as c1, least(w, floor(x2 * sx + 0.5)) as a2, least(h, floor(y2 * sy + 0.5)) as c2, not has_vector and (grid or bx or bh) as app from s)
    select page_id, item, cast(case when app then greatest(0, a1) else x1 end as bigint) as x1, cast(case when app then greatest(0, c1) else y1 end as bigint) as y1,
           cast(case when app then greatest(a1 + 1, a2) else x2 end as bigint) as x2, cast(case when app then greatest(c1 + 1, c2) else y2 end as bigint) as y2 from c""",
)
def heal_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    scale = 1 + F.col("page_id") % 5
    rows = p.select(
        "page_id", "item", (F.col("l_partkey") % 6 == 0).alias("has_vector"), *[(F.col(c) * scale).alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.lit(700).alias("w"), F.lit(500).alias("h"),
    )
    return bx.heal_coordinates(rows).select("page_id", "item", "x1", "y1", "x2", "y2")


@query(
    "line_direction",
    f"""with {SQL_PAGE_ITEMS}, i as (select *, case l_partkey % 3 when 0 then 'v' when 1 then 'h' end as dir from page_items)
    select page_id, item, case when x2 - x1 > y2 - y1 then case when dir = 'v' then 'h' else coalesce(dir, 'h') end
      when y2 - y1 > x2 - x1 and length(text) > 1 then case when dir = 'h' then 'v' else coalesce(dir, 'v') end else dir end as dir from i""",
)
def line_direction(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("l_partkey") % 3 == 0, "v").when(F.col("l_partkey") % 3 == 1, "h")
    return page_items(spark, sf).select("page_id", "item", bx.line_direction(label, F.length("text")).alias("dir"))
