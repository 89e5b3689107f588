"""Fusion of order-line fragments with readings taken from part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkstone.operators import fusion as fs
from inkstone.plans.page_queries import sql_similar
from inkstone.plans.registry import query
from inkstone.plans.views import SQL_PAGE_ITEMS, page_items

# A page's answer: the full name for every second part, and a turned-round name no fragment shows.
ANSWERS = """answers as (
  select page_id, row_number() over (partition by page_id order by item) - 1 as line,
         case when l_partkey % 5 = 0 then upper(reverse(name)) else name || '⟪2⟫' end as text from page_items where l_partkey % 2 = 0 or l_partkey % 5 = 0),
clean as (select page_id, line, replace(text, '⟪2⟫', '') as clean from answers)"""


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    items = page_items(spark, sf)
    w = Window.partitionBy("page_id").orderBy("item")
    answers = items.filter("l_partkey % 2 = 0 or l_partkey % 5 = 0").select(
        "page_id",
        (F.row_number().over(w) - 1).alias("line"),
        F.when(F.col("l_partkey") % 5 == 0, F.upper(F.reverse("name"))).otherwise(F.concat("name", F.lit("⟪2⟫"))).alias("text"),
        F.lit("h").alias("dir"),
    )
    dims = items.select("page_id").distinct().withColumn("w", F.lit(500)).withColumn("h", F.lit(400))
    return items.select("page_id", "item", "x1", "y1", "x2", "y2", "score", "text"), answers, dims


def _norms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items, answers, _ = _inputs(spark, sf)
    fragments = fs.with_norm(items.filter(F.length("text") >= 2), "text", None)
    return fragments, fs.with_norm(fs.read_answers(answers), "clean", None)


@query("align_pairs")
def align_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fs.align_pairs(*_norms(spark, sf))


@query("improve_fragments")
def improve_fragments(spark: SparkSession, sf: str) -> DataFrame:
    fragments, lines = _norms(spark, sf)
    return fs.improve_fragments(fragments, lines, fs.align_pairs(fragments, lines))


@query("unmatched_lines")
def unmatched_lines(spark: SparkSession, sf: str) -> DataFrame:
    fragments, lines = _norms(spark, sf)
    return fs.unmatched_lines(lines, fs.align_pairs(fragments, lines)).select("page_id", "line", "clean")


@query(
    "group_variants",
    f"""with {SQL_PAGE_ITEMS}, {ANSWERS}, n as (select *, replace(clean, ' ', '') as norm from clean)
    select page_id, line, not exists (select 1 from n a where a.page_id = b.page_id and a.line < b.line and
      case when least(length(a.norm), length(b.norm)) < 4 then a.norm = b.norm else {sql_similar('a.norm', 'b.norm')} >= 0.55 end) as first from n b""",
)
def group_variants(spark: SparkSession, sf: str) -> DataFrame:
    return fs.group_variant_lines(_norms(spark, sf)[1]).select("page_id", "line", "first")


@query(
    "fragment_chars",
    f"""with {SQL_PAGE_ITEMS}, f as (select *, length(text) as m, greatest(2, length(text)) as mm, (x2 - x1) * 1.0::double as w, (y2 - y1) * 1.0::double as h from page_items),
    g as (select *, sqrt(w * w + h * h) / (mm + sqrt(2.0::double)) as g, w / mm as gx, h / mm as gy, h > w * 1.3 as tall from f),
    l as (select *, least(0.999, greatest(0.05, (h - g) / (mm * g))) as lean, gy >= gx * 1.3 as col, gy >= gx * 1.3 and w <= gy * 1.8 as clean from g),
    a as (select *, case when clean then 1.0 when col or (h > gx * 2.5 and tall) then lean else 0.0 end as uy from l),
    u as (select *, case when clean then 0.0 when uy = 0 then 1.0 else sqrt(1 - lean * lean) end as ux from a),
    p as (select *, (w * ux + h * uy) / m as pitch from u)
    select page_id, item, cast(floor(degrees(atan2(uy, ux)) + 0.5) as int) as angle, i as char_no, substring(text, i + 1, 1) as char,
           cast(floor((x1 + x2) / 2 + ux * ((i - (m - 1) / 2) * pitch) - pitch / 2 + 0.5) as bigint) as x1, cast(floor((y1 + y2) / 2 + uy * ((i - (m - 1) / 2) * pitch) + pitch / 2 + 0.5) as bigint) as y2
    from p, unnest(range(m)) t(i)""",
)
def fragment_chars(spark: SparkSession, sf: str) -> DataFrame:
    rows = fs.fragment_chars(page_items(spark, sf).select("page_id", "item", "x1", "y1", "x2", "y2", "text"))
    cells = rows.select("page_id", "item", "angle", F.posexplode("chars").alias("char_no", "c"))
    return cells.select("page_id", "item", "angle", "char_no", "c.char", "c.box.x1", "c.box.y2")


@query("fuse_pages")
def fuse_pages(spark: SparkSession, sf: str) -> DataFrame:
    lines = fs.lines_contract(fs.fuse_pages(*_inputs(spark, sf))["lines"])
    return lines.select("page_id", "position", "line", "text", "x1", "y1", "x2", "y2", "dir", "angle", "n", "inferred")


@query("serve_decision")
def serve_decision(spark: SparkSession, sf: str) -> DataFrame:
    items, answers, dims = _inputs(spark, sf)
    rows = fs.serve_decision(items, fs.fuse_pages(items, answers, dims))
    return rows.select("page_id", "served_by", "serves", "reason", "classical", "anchored_chars", "boxed_chars", "total")
