"""Line operators over order lines read as vector lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkstone.functions.geometry import quad_of_box
from inkstone.operators import lines as ln
from inkstone.plans.page_queries import sql_greedy, sql_iou, sql_overlap, sql_similar
from inkstone.plans.registry import query
from inkstone.plans.views import SQL_PAGE_ITEMS, SQL_PAGE_LINES, SQL_SHEET_ITEMS, page_items, page_lines, sheet_items, to_han, sql_han

# Answers on the 0-1000 grid: all with a vector, some with a box as well, some with only a box.
RAW = """raw as (
  select page_id, item, text, l_partkey % 4 as kind, x1 * 3.0 - 40 as gx0, y1 * 5.0 as gy0, x2 * 3.0 - 40 as gx1,
         y1 * 5.0 + (l_partkey % 7) * 40 as gy1, x1 * 3.0 as c1, y1 * 5.0 as c2, x2 * 3.0 as c3, y2 * 5.0 as c4 from page_items)"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    kind = F.col("l_partkey") % 4
    lean = (F.col("l_partkey") % 7) * 40
    d = "array<double>"
    return page_items(spark, sf).select(
        "page_id", "item", "text",
        F.when(kind < 3, F.array(x1 * 3.0 - 40, y1 * 5.0).cast(d)).alias("from"),
        F.when(kind < 3, F.array(x2 * 3.0 - 40, y1 * 5.0 + lean).cast(d)).alias("to"),
        F.when(kind > 0, F.array(x1 * 3.0, y1 * 5.0, x2 * 3.0, y2 * 5.0).cast(d)).alias("box"),
        F.lit("v").alias("dir"), F.lit(900).alias("w"), F.lit(700).alias("h"),
    )


@query(
    "vector_lines",
    f"""with {SQL_PAGE_ITEMS}, {RAW},
    v as (select *, kind < 3 and least(gx0, gy0, gx1, gy1) >= -60 and greatest(gx0, gy0, gx1, gy1) <= 1060 as vec, sqrt(power(gx1 - gx0, 2) + power(gy1 - gy0, 2)) as len from raw),
    k as (select *, floor(degrees(atan2(gy1 - gy0, gx1 - gx0)) + 0.5) as raw_angle from v where (vec and len >= 3) or (not vec and kind > 0)),
    a as (select *, case when not vec then null when length(text) = 1 or abs(raw_angle) <= 20 then 0.0 when raw_angle between 70 and 110 then 90.0 when raw_angle between -110 and -70 then -90.0 else raw_angle end as angle from k where trim(text) <> '')
    select page_id, item, trim(text) as text, angle, vec and kind > 0 as fused,
           case when not (vec and kind = 0) then cast(floor(case when not vec then c1 else c1 * 0.9 end + 0.001) as bigint) end as left_edge,
           case when vec then case when abs(angle) > 45 then 'v' else 'h' end else 'v' end as dir
    from (select *, sqrt(power((gx1 - gx0) * 0.9, 2) + power((gy1 - gy0) * 0.7, 2)) / greatest(1, length(trim(text))) * 0.5 as pad from a)""",
)
def vector_lines(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, sf)
    lines = ln.vector_lines(raw).join(raw.select("page_id", "item", F.col("box").isNotNull().alias("_b")), ["page_id", "item"])
    return lines.select(
        "page_id", "item", "text", "angle", (F.col("angle").isNotNull() & F.col("_b")).alias("fused"),
        F.when(F.col("_b"), F.floor(F.col("x1") + 0.001)).alias("left_edge"), "dir",
    )


# Repeats: short texts recur on a sheet; every fifth line has no box.
REP = """rep as (
  select page_id, item, text, case when l_partkey % 5 > 0 then x1 // 8 * 8 end as x1, case when l_partkey % 5 > 0 then y1 // 8 * 8 end as y1,
         case when l_partkey % 5 > 0 then x1 // 8 * 8 + 60 end as x2, case when l_partkey % 5 > 0 then y1 // 8 * 8 + 24 end as y2 from sheet_items)"""


def _repeats(spark: SparkSession, sf: str) -> DataFrame:
    boxed = F.col("l_partkey") % 5 > 0
    x, y = F.floor(F.col("x1") / 8) * 8, F.floor(F.col("y1") / 8) * 8
    return sheet_items(spark, sf).select(
        "page_id", "item", "text",
        F.when(boxed, x).alias("x1"), F.when(boxed, y).alias("y1"), F.when(boxed, x + 60).alias("x2"), F.when(boxed, y + 24).alias("y2"),
    )


KEPT = f"""boxed as (select (page_id, text) as page_id, page_id as pg, item, text, x1, y1, x2, y2, row_number() over (partition by page_id, text order by item) as k from rep where x1 is not null),
{sql_greedy('kept', 'boxed', sql_iou() + ' >= 0.8')},
unread as (select pg as page_id, item, text, x1, y1, x2, y2 from kept union all select page_id, item, text, x1, y1, x2, y2 from rep where x1 is null)"""


@query("drop_rereads", f"with recursive {SQL_SHEET_ITEMS}, {REP}, {KEPT} select page_id, item, text, x1 from unread")
def drop_rereads(spark: SparkSession, sf: str) -> DataFrame:
    return ln.drop_rereads(_repeats(spark, sf)).select("page_id", "item", "text", "x1")


MARCH = """grp as (select page_id, text, count(*) as n, count(x1) as boxed, min(item) as first from unread group by 1, 2),
lagged as (
  select u.*, x1 - lag(x1) over w as dx2, lag(x1) over w - lag(x1, 2) over w as dx1, y1 - lag(y1) over w as dy2, lag(y1) over w - lag(y1, 2) over w as dy1
  from unread u join grp g using (page_id, text) where n >= 3 and boxed = n window w as (partition by u.page_id, u.text order by u.item)),
marching as (select page_id, text from lagged where abs(dx1 - dx2) <= 15 and abs(dy1 - dy2) <= 15 and (abs(dx1) > 0 or abs(dy1) > 0) group by 1, 2),
marched as (select u.* from unread u left join marching m using (page_id, text) join grp g using (page_id, text) where m.page_id is null or u.item = g.first)"""


@query("marching_clones", f"with recursive {SQL_SHEET_ITEMS}, {REP}, {KEPT}, {MARCH} select page_id, item, text, x1 from marched")
def marching_clones(spark: SparkSession, sf: str) -> DataFrame:
    return ln.marching_clones(ln.drop_rereads(_repeats(spark, sf))).select("page_id", "item", "text", "x1")


def _flood(source: str) -> str:
    return f"""fl as (select *, count(*) over p as n, count(x1) over p as boxed, row_number() over (partition by page_id, text order by item) as r
      from {source} window p as (partition by page_id, text)),
    capped as (select page_id, item, text, x1 from fl where not (n > 3 and boxed < n) or r <= 3)"""


@query("boxless_flood_cap", f"with {SQL_SHEET_ITEMS}, {REP}, {_flood('rep')} select page_id, item, text, x1 from capped")
def boxless_flood_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ln.boxless_flood_cap(_repeats(spark, sf)).select("page_id", "item", "text", "x1")


@query("heal_repetition", f"with recursive {SQL_SHEET_ITEMS}, {REP}, {KEPT}, {MARCH}, {_flood('marched')} select page_id, item, text, x1 from capped")
def heal_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return ln.heal_repetition(_repeats(spark, sf)).select("page_id", "item", "text", "x1")


@query(
    "drop_duplicate_lines",
    f"""with recursive {SQL_PAGE_ITEMS}, ranked as (select page_id, item, name as text, x1, y1, x2, y2, row_number() over (partition by page_id order by item) as k from page_items),
    {sql_greedy('kept', 'ranked', f"length(b.text) >= 8 and {sql_overlap()} >= 0.3 and {sql_similar('a.text', 'b.text')} >= 0.85")}
    select page_id, item, text from kept""",
)
def drop_duplicate_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = page_items(spark, sf).select("page_id", "item", F.col("name").alias("text"), "x1", "y1", "x2", "y2")
    return ln.drop_duplicate_lines(rows).select("page_id", "item", "text")


@query("chain_continuations")
def chain_continuations(spark: SparkSession, sf: str) -> DataFrame:
    return ln.chain_continuations(page_lines(spark, sf)).select("page_id", "item", "text", "tx", "ty", "x2", "y2")


@query(
    "char_overlap",
    f"""with {SQL_PAGE_ITEMS} select page_id, a.item as a_item, b.item as b_item, cast(floor({sql_similar('a.name', 'b.name')} * 1000000) as bigint) as shorter_ppm
    from page_items a join page_items b using (page_id) where a.item < b.item and {sql_overlap()} > 0""",
)
def char_overlap(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.functions.text import char_overlap as similar
    from inkstone.operators.common import grid_pairs

    pairs = grid_pairs(page_items(spark, sf).select("page_id", "item", "name", "x1", "y1", "x2", "y2"))
    ppm = F.floor(similar(F.col("a_name"), F.col("b_name")) * 1000000).alias("shorter_ppm")
    return pairs.select("page_id", "a_item", "b_item", ppm)


# ---- recovery -----------------------------------------------------------

NUMBERED = """numbered as (
  select *, row_number() over (partition by page_id order by x1, item) - 1 as position, case when l_partkey % 3 = 0 then 'h' else 'v' end as dir from page_items)"""


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.operators.common import position_by_bucket

    rows = page_items(spark, sf).withColumn("_b", F.floor(F.col("x1") / 64))
    placed = position_by_bucket(rows, ["page_id"], ["_b"], [F.col("x1"), F.col("item")], "position")
    return placed.withColumn("position", F.col("position") - 1).withColumn("dir", F.when(F.col("l_partkey") % 3 == 0, "h").otherwise("v"))


@query(
    "neighbour_between",
    f"""with {SQL_PAGE_ITEMS}, {NUMBERED},
    m as (select page_id, percentile_disc(0.5) within group (order by x2 - x1 desc) as mw, percentile_disc(0.5) within group (order by y2 - y1 desc) as mh from numbered group by 1)
    select page_id, a.position as slot, case when a.dir = 'v' and b.dir = 'v' then (a.x1 + b.x1) / 2 - mw / 2 else least(a.x1, b.x1) end * 1.0 as x1,
           case when a.dir = 'v' and b.dir = 'v' then least(a.y1, b.y1) else (a.y1 + b.y1) / 2 - mh / 2 end * 1.0 as y1
    from numbered a join numbered b using (page_id) join m using (page_id) where b.position = a.position + 1""",
)
def neighbour_between(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbered(spark, sf)
    slots = rows.filter("position > 0").select(
        "page_id", (F.col("position") - 1).alias("slot"), (F.col("position") - 1).alias("i"), F.col("position").alias("j")
    )
    return ln.neighbour_between(rows, slots).select("page_id", "slot", "x1", "y1")


@query(
    "trend_insert",
    f"""with {SQL_PAGE_ITEMS}, {NUMBERED}, l as (select *, case when dir = 'v' then (x1 + x2) / 2 else (y1 + y2) / 2 end as a from numbered where l_partkey % 5 > 0),
    lines as (select *, row_number() over (partition by page_id order by position) - 1 as p from l),
    rec as (select page_id, item as rec, dir, case when dir = 'v' then (x1 + x2) / 2 else (y1 + y2) / 2 end as ra from numbered where l_partkey % 5 = 0),
    d as (select page_id, dir, p, sign(a - lag(a) over (partition by page_id, dir order by p)) as s from lines),
    t as (select page_id, dir, coalesce(sum(s), 0) as trend, max(p) as last from d group by 1, 2),
    f as (select r.page_id, r.rec, min(case when (trend < 0 and a < ra) or (trend > 0 and a > ra) then p end) as first from rec r join t using (page_id, dir) join lines using (page_id, dir) group by 1, 2),
    n as (select page_id, count(*) as n from lines group by 1)
    select r.page_id, r.rec, cast(coalesce(f.first, t.last + 1, n.n, 0) as int) as insert_at from rec r left join t using (page_id, dir) left join f using (page_id, rec) left join n using (page_id)""",
)
def trend_insert(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _numbered(spark, sf)
    w = Window.partitionBy("page_id").orderBy("position")
    lines = rows.filter("l_partkey % 5 > 0").withColumn("position", F.row_number().over(w) - 1)
    recovered = rows.filter("l_partkey % 5 = 0").select("page_id", F.col("item").alias("rec"), "dir", "x1", "y1", "x2", "y2")
    return ln.trend_insert_position(lines, recovered)


@query(
    "snap_neighbours",
    f"""with {SQL_PAGE_ITEMS}, l as (select page_id, (l_partkey % 5) * 25 as angle, case when (l_partkey % 5) * 25 >= 45 then y2 - y1 else x2 - x1 end / length(text) as pitch
       from page_items where l_partkey % 5 > 0 and length(text) >= 3 and l_partkey % 2 = 0),
    m as (select page_id, angle >= 45 as vertical, percentile_disc(0.5) within group (order by angle desc) as na, percentile_disc(0.5) within group (order by pitch desc) as np from l group by 1, 2),
    r as (select page_id, item as rec, x1, y1, x2, y2, length(text) as n, y2 - y1 >= x2 - x1 as vertical, case when y2 - y1 >= x2 - x1 then 90.0 else 0.0 end as axis from page_items where l_partkey % 2 = 1)
    select page_id, rec, case when abs((na - axis + 540) % 360 - 180) <= 15 then na * 1.0::double else axis::double end as angle,
           round(greatest(30.0, coalesce(np, case when vertical then y2 - y1 else x2 - x1 end / greatest(1, n))), 4) as pitch
    from r left join m using (page_id, vertical)""",
)
def snap_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    lines = p.filter("l_partkey % 2 = 0").withColumn("angle", (F.col("l_partkey") % 5) * 25)
    tall = (F.col("y2") - F.col("y1")) >= (F.col("x2") - F.col("x1"))
    proposals = p.filter("l_partkey % 2 = 1").select(
        "page_id", F.col("item").alias("rec"), quad_of_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("pts"),
        F.length("text").alias("n"), tall.alias("vertical"), F.when(tall, 90.0).otherwise(0.0).alias("axis"),
    )
    out = ln.snap_to_neighbours(lines, proposals)
    return out.select("page_id", "rec", F.col("angle").cast("double").alias("angle"), F.round("pitch", 4).alias("pitch"))


@query(
    "snap_pitch",
    f"""with {SQL_PAGE_LINES}, r as (select *, sqrt(power(tx - fx, 2) + power(ty - fy, 2)) as raw, sqrt(power(tx - fx, 2) + power(ty - fy, 2)) / greatest(1, length(text)) as pitch from page_lines),
    m as (select page_id, percentile_disc(0.5) within group (order by pitch desc) as med from r group by 1)
    select page_id, item, round(case when med > 0 and pitch >= med * 0.45 and pitch <= med * 2.2 then med * length(text) else raw end, 4) as length from r join m using (page_id)""",
)
def snap_pitch(spark: SparkSession, sf: str) -> DataFrame:
    return ln.snap_pitch(page_lines(spark, sf)).select("page_id", "item", F.round("length", 4).alias("length"))


PROPOSALS = """props as (
  select page_id, item as rec, replace(case when l_partkey % 2 = 0 then name else reverse(name) || 'qq' end, ' ', '') as text from page_items where l_partkey % 3 = 0),
lines as (select page_id, text from page_items where l_partkey % 3 > 0)"""


@query(
    "longest_uncovered",
    f"""with {SQL_PAGE_ITEMS}, {PROPOSALS},
    open_props as (select * from props p where length(text) >= 6 and not exists (
      select 1 from lines l where l.page_id = p.page_id and length(l.text) >= 4 and {sql_similar('l.text', 'p.text')} >= 0.6))
    select page_id, rec, text, rank from (select *, row_number() over (partition by page_id order by length(text) desc, rec) as rank from open_props) where rank <= 3""",
)
def longest_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    text = F.when(F.col("l_partkey") % 2 == 0, F.col("name")).otherwise(F.concat(F.reverse("name"), F.lit("qq")))
    props = p.filter("l_partkey % 3 = 0").select("page_id", F.col("item").alias("rec"), text.alias("text"))
    return ln.longest_uncovered(props, p.filter("l_partkey % 3 > 0")).select("page_id", "rec", "text", "rank")


VERIFIED = f"""reads as (
  select page_id, item as rec, name as text, replace(case l_partkey % 4 when 0 then reverse(name) when 1 then text when 2 then '' else repeat(name, 5) end, ' ', '') as read,
         l_partkey % 6 <> 1 as proposed from page_items),
ver as (select *, read <> '' and {sql_similar('read', 'text')} >= 0.75 and length(read) <= length(text) * 3 + 4 as verified from reads)"""


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey") % 4
    read = F.when(k == 0, F.reverse("name")).when(k == 1, F.col("text")).when(k == 2, "").otherwise(F.repeat("name", 5))
    rows = page_items(spark, sf).select(
        "page_id", F.col("item").alias("rec"), F.col("name").alias("text"), read.alias("read"), (F.col("l_partkey") % 6 != 1).alias("proposed")
    )
    return ln.verify_proposals(rows)


@query("verify_proposals", f"with {SQL_PAGE_ITEMS}, {VERIFIED} select page_id, rec, verified from ver")
def verify_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).select("page_id", "rec", "verified")


METER = """meter as (select page_id, count(*) filter (proposed) as proposals, count(*) filter (verified) as verified from ver group by 1),
labelled as (select *, case when verified > 0 then 'pipeline2+recovered (' || cast(verified as varchar) || ')' when proposals > 0 then 'pipeline2+phantom' else 'pipeline2' end as served_by from meter)"""


@query("recovery_meter", f"with {SQL_PAGE_ITEMS}, {VERIFIED}, {METER} select page_id, proposals, verified, served_by from labelled")
def recovery_meter(spark: SparkSession, sf: str) -> DataFrame:
    return ln.recovery_meter(_verified(spark, sf))


@query(
    "meter_totals",
    f"with {SQL_PAGE_ITEMS}, {VERIFIED}, {METER} select served_by, count(*) as pages, cast(sum(proposals) as bigint) as proposals, cast(sum(verified) as bigint) as verified from labelled group by 1",
)
def meter_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ln.meter_totals(ln.recovery_meter(_verified(spark, sf)))


@query(
    "recovered_duplicates",
    f"""with {SQL_PAGE_ITEMS}, {PROPOSALS} select page_id, rec, text from props p where not exists (
      select 1 from lines l where l.page_id = p.page_id and length(l.text) >= 4 and length(p.text) >= 4 and {sql_similar('l.text', 'p.text')} >= 0.7)""",
)
def recovered_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    text = F.when(F.col("l_partkey") % 2 == 0, F.col("name")).otherwise(F.concat(F.reverse("name"), F.lit("qq")))
    props = p.filter("l_partkey % 3 = 0").select("page_id", F.col("item").alias("rec"), F.replace(text, F.lit(" "), F.lit("")).alias("text"))
    return ln.drop_recovered_duplicates(props, p.filter("l_partkey % 3 > 0"))


@query(
    "tile_gap_text",
    f"""with {SQL_PAGE_ITEMS}, g as (select page_id, item, {sql_han('name')} as text, x1, y1, x2, y2 from page_items where l_partkey % 2 = 0),
    known as (select page_id, {sql_han("string_agg(text, '' order by item)")} as known from page_items where l_partkey % 2 = 1 group by 1),
    j as (select g.*, coalesce(known, '') as known from g left join known using (page_id)),
    p as (select *, list_filter(string_split(text, ' '), lambda t: not contains(known, t)) as parts from j where not contains(known, replace(text, ' ', ''))),
    q as (select *, len(parts) as k, unnest(parts) as part_text, unnest(range(len(parts))) as part from p)
    select page_id, item as region, part, part_text as text,
           case when k > 1 and not tall then cast(floor(x1 + (x2 - x1) / k * part + 0.5) as bigint) else x1 end as x1,
           case when k > 1 and tall then cast(floor(y1 + (y2 - y1) / k * part + 0.5) as bigint) else y1 end as y1, case when tall then 'v' else 'h' end as dir
    from (select *, y2 - y1 > (x2 - x1) * 1.3 and length(part_text) > 1 as tall from q)""",
)
def tile_gap_text(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    reads = p.filter("l_partkey % 2 = 0").select(
        "page_id", F.col("item").alias("region"), to_han(F.replace("name", F.lit(" "), F.lit("\n"))).alias("text"), "x1", "y1", "x2", "y2"
    )
    # a page's known text is its own few lines joined in order
    known = p.filter("l_partkey % 2 = 1").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("item", "text"))).alias("t"))
    known = known.select("page_id", to_han(F.array_join(F.transform("t", lambda x: x.text), "")).alias("known_text"))
    return ln.tile_gap_text(reads, known).select("page_id", "region", "part", "text", "x1", "y1", "dir")


@query(
    "word_boxes",
    f"""with {SQL_PAGE_ITEMS}, l as (select *, string_split(name, ' ') as toks, case when l_partkey % 2 = 0 then 'v' else 'h' end as dir from page_items),
    t as (select *, unnest(toks) as token, unnest(range(len(toks))) as token_no from l),
    o as (select *, length(replace(name, ' ', '')) as total, coalesce(list_sum(list_transform(list_slice(toks, 1, token_no), lambda w: length(w))), 0) as start, length(token) % 2 = 0 as known from t),
    b as (select *, case when dir = 'v' then x1 else floor(x1 + (x2 - x1) * (start / total) + 0.5) end as bx1, case when dir = 'v' then x2 else floor(x1 + (x2 - x1) * ((start + length(token)) / total) + 0.5) end as bx2,
                 case when dir = 'v' then floor(y1 + (y2 - y1) * (start / total) + 0.5) else y1 end as by1, case when dir = 'v' then floor(y1 + (y2 - y1) * ((start + length(token)) / total) + 0.5) else y2 end as by2 from o),
    c as (select *, unnest(case when known then [0] else range(length(token)) end) as char_no from b)
    select page_id, item, token_no, char_no, case when known then token else substring(token, char_no + 1, 1) end as word,
           cast(case when known then bx1 else floor(bx1 + (bx2 - bx1) / length(token) * char_no + 0.5) end as bigint) as wx1, cast(by1 as bigint) as wy1,
           cast(case when known then bx2 else floor(bx1 + (bx2 - bx1) / length(token) * (char_no + 1) + 0.5) end as bigint) as wx2, cast(by2 as bigint) as wy2 from c""",
)
def word_boxes(spark: SparkSession, sf: str) -> DataFrame:
    lines = page_items(spark, sf).select(
        "page_id", "item", F.split("name", " ").alias("tokens"), "x1", "y1", "x2", "y2",
        F.when(F.col("l_partkey") % 2 == 0, "v").otherwise("h").alias("dir"),
    )
    tokens = ln.token_offsets(lines).withColumn("known", F.length("token") % 2 == 0)
    return ln.word_boxes(tokens).select("page_id", "item", "token_no", "char_no", "word", "wx1", "wy1", "wx2", "wy2")
