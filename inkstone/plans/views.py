"""Operator inputs derived from the driver tables, in Spark and as SQL fragments.

The driver's texts are Latin. Han texts, a lexicon and readings come from them
letter by letter: each letter stands for one character and one syllable. Page
items come from lineitem and part, reviews from events. Every derived table grows
with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkstone.functions.geometry import quad_of_box
from inkstone.functions.text import flat_key

LETTERS = "abcdefghijklmnopqrstuvwxyz"
TRADITIONAL = "愛筆車東兒飛國好一見開來們你我片錢人是天無萬文學月中"
SIMPLIFIED = "爱笔车东儿飞国好一见开来们你我片钱人是天无万文学月中"
SYLLABLES = (
    "ai bi che dong er fei guo hao yi jian kai lai men ni wo pian qian ren shi tian wu wan wen xue yue zhong".split()
)
# Accented letters count as the letter below the accent, so that no word is cut at one.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçß"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuuncs"
SQL_LOWER = f"translate(lower(text), '{ACCENTED}', '{UNACCENTED}')"
SQL_WORDS = f"regexp_extract_all({SQL_LOWER}, '[a-z]+')"
# an entry's place: text number and word number, which never collide
PLACE = 1 << 32

SQL_SYLLABLES = "[" + ",".join(f"'{s}'" for s in SYLLABLES) + "]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Texts are much work a byte, so a scan whose rows come in fewer parts than there are cores is dealt out first.

    A row group is read by one part whatever the number of splits, so parts that have rows are counted; that reads no column.
    """
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    if name not in ("documents", "conversations"):
        return rows
    cores, splits = spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    if splits >= cores and rows.select(F.spark_partition_id().alias("part")).distinct().count() >= cores:
        return rows
    # by number, since dealing in turns would sort whole texts first
    return rows.withColumn("_row", F.monotonically_increasing_id()).repartition(max(cores, splits), "_row").drop("_row")


def to_han(col: Column, script: str = TRADITIONAL) -> Column:
    return F.translate(F.lower(col), LETTERS, script)


def sql_han(col: str, script: str = TRADITIONAL) -> str:
    return f"translate(lower({col}), '{LETTERS}', '{script}')"


def lowered(col: str) -> Column:
    return F.translate(F.lower(col), ACCENTED, UNACCENTED)


def latin_words(col: str) -> Column:
    return F.regexp_extract_all(lowered(col), F.lit("[a-z]+"), F.lit(0))


def each_word(texts: DataFrame, column: str = "text") -> DataFrame:
    """(w): every word of :func:`latin_words`, one row each; accents are taken off words that have some, not letter by letter off whole texts."""
    found = F.regexp_extract_all(F.lower(column), F.lit(f"[a-z{ACCENTED}]+"), F.lit(0))
    plain = F.when(F.octet_length("w") == F.length("w"), F.col("w")).otherwise(F.translate("w", ACCENTED, UNACCENTED))
    return texts.select(F.explode(found).alias("w")).select(plain.alias("w"))


def spelled(word: Column, shift: Column) -> Column:
    """Numbered reading of a Latin word; ``shift`` turns the tones of its senses apart."""
    names = F.array(*[F.lit(s) for s in SYLLABLES])
    return F.array_join(
        F.transform(
            F.split(word, ""),
            lambda c: F.concat(F.get(names, F.ascii(c) - 97), ((F.ascii(c) + shift) % 5 + 1).cast("string")),
        ),
        " ",
    )


def sql_spelled(word: str, shift: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({word}, ''), lambda c: "
        f"list_extract({SQL_SYLLABLES}, ascii(c) - 96) || cast((ascii(c) + {shift}) % 5 + 1 as varchar)), ' ')"
    )


def benchmark_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(latin_words("text")).alias("pos", "w"))


def lexicon_source(spark: SparkSession, sf: str) -> DataFrame:
    """Entries as a dictionary file has them: one per word and sense, in order of first occurrence."""
    entries = (
        benchmark_words(spark, sf)
        .groupBy("w", (F.col("item_id") % 3).cast("int").alias("s"))
        .agg(F.min(F.col("item_id") * PLACE + F.col("pos")).alias("ord"), F.count("*").alias("n"))
    )
    first = (
        F.when((F.col("s") == 0) & (F.length("w") % 2 == 0), F.concat(F.lit("surname "), F.col("w")))
        .when((F.col("s") == 1) & F.col("w").endswith("n"), F.concat(F.lit("Variant of "), F.col("w")))
        .otherwise(F.concat(F.col("w"), F.lit(" seen "), F.col("n").cast("string")))
    )
    tagged = F.when((F.length("w") == 4) & (F.col("s") == 2), F.concat(first, F.lit(" (Idiom)"))).otherwise(first)
    return entries.select(
        "ord",
        "w",
        "s",
        "n",
        to_han(F.col("w")).alias("traditional"),
        to_han(F.col("w"), SIMPLIFIED).alias("simplified"),
        spelled(F.col("w"), F.col("s")).alias("pinyin"),
        F.array(tagged, F.concat(F.lit("sense "), F.col("s").cast("string"))).alias("english"),
    )


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.operators.lexicon import normalize_entries

    source = lexicon_source(spark, sf)
    tiers = source.groupBy("ord").agg(F.max("n").alias("n"))
    rows = normalize_entries(source).join(tiers, "ord")
    return rows.withColumn("frequent", F.col("n") >= 2).withColumn("common", F.col("n") >= 6).drop("n")


SQL_LEXICON = f"""
bench_words as (
  select item_id, unnest(ws) as w, unnest(range(len(ws))) as pos
  from (select item_id, {SQL_WORDS} as ws from benchmark)),
lex_entries as (
  select w, cast(item_id % 3 as int) as s, min(item_id * {PLACE} + pos) as ord, count(*) as n
  from bench_words group by 1, 2),
lex_glossed as (
  select *, case when s = 0 and length(w) % 2 = 0 then 'surname ' || w
                 when s = 1 and w like '%n' then 'Variant of ' || w
                 else w || ' seen ' || cast(n as varchar) end as gloss
  from lex_entries),
lexicon as (
  select ord, w, s, n, {sql_han('w')} as traditional, {sql_han('w', SIMPLIFIED)} as simplified,
         {sql_spelled('w', 's')} as py_num,
         regexp_replace({sql_spelled('w', 's')}, '[0-9 ]', '', 'g') as py_flat,
         gloss || case when length(w) = 4 and s = 2 then ' (Idiom)' else '' end || ' / sense ' || cast(s as varchar) as english,
         n >= 2 as frequent, n >= 6 as common
  from lex_glossed)"""


def document_words(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, position, token): Latin words of whole documents, written in Han."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(latin_words("text")).alias("position", "w"))
    return rows.select("doc_id", "position", to_han(F.col("w")).alias("token"))


SQL_DOCUMENT_WORDS = f"""
document_words as (
  select doc_id, position, {sql_han('w')} as token from (
    select doc_id, unnest(ws) as w, unnest(range(len(ws))) as position
    from (select doc_id, {SQL_WORDS} as ws from documents)))"""

SQL_SENSES = """
senses as (
  select key, traditional, simplified, py_num, english from (
    select *, row_number() over (partition by key order by tier,
               case when regexp_matches(english, '^(?i)(surname|variant of|old variant|see )') then 1 else 0 end, ord) as r
    from (select *, row_number() over (partition by key, tier order by ord) as k from (
            select traditional as key, 0 as tier, * from lexicon
            union all
            select simplified as key, 1 as tier, * from lexicon where simplified <> traditional))
    where k <= 4)
  where r = 1)"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Events as reviews of one card per user."""
    kinds = F.create_map(*[F.lit(x) for x in ("error", "again", "signup", "hard", "view", "good", "click", "good", "purchase", "easy")])
    return table(spark, sf, "events").select(
        F.col("user_id").alias("entry_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.try_element_at(kinds, F.col("event_type")).alias("outcome"),
    )


SQL_REPLAY = """
steps as (
  select user_id as entry_id, ts, row_number() over (partition by user_id order by ts, event_id) as k,
         case event_type when 'error' then 'again' when 'signup' then 'hard' when 'view' then 'good'
                         when 'click' then 'good' when 'purchase' then 'easy' end as outcome
  from events),
walk as (
  select entry_id, 0 as k, 0 as box, 0 as streak, cast(null as timestamp) as ts from (select distinct entry_id from steps)
  union all
  select w.entry_id, s.k,
         case s.outcome when 'again' then 0 when 'hard' then greatest(0, w.box - 1)
                        when 'good' then least(5, w.box + 1) else least(5, w.box + 2) end,
         case s.outcome when 'again' then 0 else w.streak + 1 end, s.ts
  from walk w join steps s on s.entry_id = w.entry_id and s.k = w.k + 1),
replayed as (
  select entry_id, box, ts + to_seconds(list_extract([600, 3600, 28800, 86400, 259200, 604800], box + 1)) as due,
         streak, k as review_count
  from walk qualify row_number() over (partition by entry_id order by k desc) = 1)"""


def page_items(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as detector items. The item key is unique and needs no per-page numbering."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    x1 = (F.col("l_partkey") * 37) % 240
    y1 = (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 41) % 120
    return li.join(part, "l_partkey").select(
        F.col("l_orderkey").alias("page_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint")).alias("item"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 20 + 4 * F.col("l_quantity").cast("bigint")).alias("x2"),
        (y1 + 24 + 4 * (F.col("l_partkey") % 5)).alias("y2"),
        (1 - 3 * F.col("l_discount")).alias("score"),
        F.expr("case l_partkey % 3 when 0 then split_part(p_name, ' ', 1) when 1 then split_part(p_name, ' ', 2) else p_name end").alias("text"),
        "l_linenumber",
        "l_partkey",
        F.col("p_name").alias("name"),
    )


def sheet_items(spark: SparkSession, sf: str) -> DataFrame:
    """The same items on fuller pages: forty orders to a sheet."""
    p = page_items(spark, sf)
    return p.withColumn("item", F.concat_ws("-", "page_id", "item")).withColumn("page_id", F.floor(F.col("page_id") / 40))


SQL_PAGE_ITEMS = """
page_items as (
  select l_orderkey as page_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint)) as item,
         (l_partkey * 37) % 240 as x1, (l_suppkey * 53 + l_linenumber * 41) % 120 as y1,
         (l_partkey * 37) % 240 + 20 + 4 * cast(l_quantity as bigint) as x2,
         (l_suppkey * 53 + l_linenumber * 41) % 120 + 24 + 4 * (l_partkey % 5) as y2,
         1 - 3 * l_discount as score, case l_partkey % 3 when 0 then split_part(p_name, ' ', 1) when 1 then split_part(p_name, ' ', 2) else p_name end as text,
         l_linenumber, l_partkey, p_name as name
  from lineitem join part on p_partkey = l_partkey)"""

SQL_SHEET_ITEMS = f"""{SQL_PAGE_ITEMS},
sheet_items as (
  select page_id // 40 as page_id, concat_ws('-', page_id, item) as item, x1, y1, x2, y2, score, text, l_linenumber, l_partkey, name from page_items)"""


def page_quads(spark: SparkSession, sf: str) -> DataFrame:
    """Page items as quads: every third page is turned upright, corners start anywhere."""
    p = page_items(spark, sf)
    upright = F.col("page_id") % 3 == 0
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    box = F.when(upright, quad_of_box(F.col("y1"), F.col("x1"), F.col("y1") + h, F.col("x1") + w)).otherwise(
        quad_of_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    )
    turn = (F.col("l_partkey") % 4).cast("int")
    pts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(box, (i + turn) % 4))
    return p.withColumn("pts", pts).select("page_id", "item", "pts", "text", "score")


SQL_PAGE_QUADS = f"""{SQL_PAGE_ITEMS},
quad_boxes as (
  select page_id, item, text, l_partkey % 4 as turn,
         case when page_id % 3 = 0 then y1 else x1 end as l, case when page_id % 3 = 0 then x1 else y1 end as t,
         case when page_id % 3 = 0 then y1 + (y2 - y1) else x2 end as r,
         case when page_id % 3 = 0 then x1 + (x2 - x1) else y2 end as b
  from page_items),
quad_corners as (
  select *, list_extract([l, r, r, l], cast(turn as int) + 1) as px, list_extract([t, t, b, b], cast(turn as int) + 1) as py,
         list_extract([l, r, r, l], cast((turn + 1) % 4 as int) + 1) as qx, list_extract([t, t, b, b], cast((turn + 1) % 4 as int) + 1) as qy,
         list_extract([l, r, r, l], cast((turn + 2) % 4 as int) + 1) as rx, list_extract([t, t, b, b], cast((turn + 2) % 4 as int) + 1) as ry
  from quad_boxes),
quad_edges as (
  select *, abs(qx - px) + abs(qy - py) as e0, abs(rx - qx) + abs(ry - qy) as e1 from quad_corners),
page_quads as (
  select page_id, item, text, l, t, r, b, turn, greatest(e0, e1) as longest, least(e0, e1) as shortest,
         case when e0 >= e1 then 0 else 1 end as edge,
         case when e0 >= e1 then degrees(atan2(qy - py, qx - px)) else degrees(atan2(ry - qy, rx - qx)) end as angle
  from quad_edges)"""


def page_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Upright columns at a regular step; pages divisible by three miss their third one."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("item")
    # order pages are short here; the numbering only lays out test columns
    rows = page_items(spark, sf).select("page_id", "item", "l_partkey", F.row_number().over(w).alias("k"))
    cx = 90 * F.col("k") + F.col("l_partkey") % 5
    rows = rows.filter(~((F.col("page_id") % 3 == 0) & (F.col("k") == 3)))
    return rows.select("page_id", "item", quad_of_box(cx - 15, F.lit(10), cx + 15, F.lit(410)).alias("pts"))


SQL_PAGE_COLUMNS = f"""{SQL_PAGE_ITEMS},
page_columns as (
  select page_id, item, 90 * k + l_partkey % 5 as cx from (
    select page_id, item, l_partkey, row_number() over (partition by page_id order by item) as k from page_items)
  where not (page_id % 3 = 0 and k = 3))"""


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Page items as vector lines: level, or leaning by the part."""
    p = page_items(spark, sf)
    dx, dy = F.col("x2") - F.col("x1"), (F.col("l_partkey") % 4) * 20
    return p.select(
        "page_id", "item", "text", "x1", "y1", "x2", "y2", "l_partkey", "l_linenumber",
        F.col("x1").cast("double").alias("fx"),
        F.col("y1").cast("double").alias("fy"),
        (F.col("x1") + dx).cast("double").alias("tx"),
        (F.col("y1") + dy).cast("double").alias("ty"),
    )


SQL_PAGE_LINES = f"""{SQL_PAGE_ITEMS},
page_lines as (
  select page_id, item, text, x1, y1, x2, y2, l_partkey, l_linenumber,
         x1 * 1.0 as fx, y1 * 1.0 as fy, x2 * 1.0 as tx, (y1 + (l_partkey % 4) * 20) * 1.0 as ty from page_items)"""
