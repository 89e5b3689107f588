"""Quality operators over conversations, documents and page lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkstone.operators import quality as ql
from inkstone.plans.log_queries import MIXED, mixed
from inkstone.plans.page_queries import sql_similar
from inkstone.plans.registry import query
from inkstone.plans.text_queries import turns
from inkstone.plans.views import SQL_PAGE_ITEMS, SQL_PAGE_LINES, SQL_LOWER, SQL_WORDS, each_word, latin_words, lowered, page_items, page_lines, spelled, table, to_han

# Two engines read each turn: one swaps letters, one drops them.
def _rates(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf)
    swap = t.select("id", F.lit("swap").alias("engine"), to_han(F.replace(F.lower("text"), F.lit("e"), F.lit("a"))).alias("got"), to_han(F.col("text")).alias("truth"), (F.col("turn") * 10.0).alias("ms"))
    drop = t.select("id", F.lit("drop").alias("engine"), to_han(F.replace(F.lower("text"), F.lit("n"), F.lit(""))).alias("got"), to_han(F.col("text")).alias("truth"), (F.col("turn") * 7.0).alias("ms"))
    return ql.cer(swap.unionByName(drop))


# Spark compares code points and the check engine bytes, so the check runs on Latin letters.
LATIN_READS = """lat as (
  select concat_ws('-', conv_id, turn) as id, turn, regexp_replace(lower(text), '[^a-z]', '', 'g') as t from conversations),
lreads as (select id, 'swap' as engine, replace(t, 'e', 'a') as g, t, turn * 10.0 as ms from lat union all select id, 'drop', replace(t, 'n', ''), t, turn * 7.0 from lat),
lrates as (select id, engine, ms, case when length(t) > 0 then round(levenshtein(g, t) / length(t), 6) else 1.0 end as cer from lreads)"""


@query("cer", f"with {LATIN_READS} select id, engine, cer from lrates")
def cer(spark: SparkSession, sf: str) -> DataFrame:
    return _rates(spark, sf).select("id", "engine", "cer")


@query("cer_report", f"with {LATIN_READS} select engine, count(*) as cases, round(avg(cer), 6) as mean_cer, round(avg(ms), 6) as mean_ms from lrates group by 1")
def cer_report(spark: SparkSession, sf: str) -> DataFrame:
    return ql.cer_report(_rates(spark, sf))


@query(
    "syllable_error",
    f"""with w as (select distinct w from (select unnest({SQL_WORDS}) as w from conversations)),
    p as (select w, replace(w, 'e', 'a') as g from w)
    select w, round(levenshtein(g, w) / length(w), 6) as error from p""",
)
def syllable_error(spark: SparkSession, sf: str) -> DataFrame:
    words = each_word(turns(spark, sf)).distinct()
    # one syllable per letter: the distance over syllables is the one over letters
    rows = words.select(
        "w",
        F.array_join(F.transform(F.split(F.replace("w", F.lit("e"), F.lit("a")), ""), lambda c: F.concat(c, F.lit("ing1"))), " ").alias("got"),
        F.array_join(F.transform(F.split("w", ""), lambda c: F.concat(c, F.lit("ing1"))), " ").alias("truth"),
    )
    return ql.syllable_error(rows, "w", "got", "truth").select("w", "error")


@query(
    "reading_accuracy",
    f"""with w as (select unnest({SQL_WORDS}) as w from conversations)
    select count(*) as words, round(avg(case when length(w) % 3 = 0 or length(w) % 5 = 1 then 1 else 0 end), 6) as accuracy from w""",
)
def reading_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("w")
    rows = each_word(turns(spark, sf)).select(
        spelled(F.col("w"), F.lit(0)).alias("got"),
        F.array(F.when(n % 3 == 0, spelled(F.col("w"), F.lit(0))).otherwise(""), F.when(n % 5 == 1, spelled(F.col("w"), F.lit(0))).otherwise("")).alias("accepted"),
    )
    return ql.reading_accuracy(rows)


@query(
    "register_leak",
    """with t as (select translate(lower(text), 'qy', '唔嘅') as formal, translate(lower(text), 'xz', '啦啲') as casual from conversations)
    select count(*) as texts, round(avg(case when regexp_matches(formal, '[唔嘅]') then 1 else 0 end), 6) as formal_leak,
           round(avg(case when regexp_matches(casual, '[啦啲]') then 0 else 1 end), 6) as casual_without_markers from t""",
)
def register_leak(spark: SparkSession, sf: str) -> DataFrame:
    return ql.register_leak(turns(spark, sf).select(F.translate(F.lower("text"), "qy", "唔嘅").alias("formal"), F.translate(F.lower("text"), "xz", "啦啲").alias("casual")))


# Phrases: all runs of six words of every benchmark passage (a shorter one is a phrase by itself), looked for in all documents.
@query(
    "known_recall",
    f"""with w as (select item_id, {SQL_WORDS} as ws from benchmark),
    p as (select distinct item_id, array_to_string(ws[i : i + 5], ' ') as phrase from (select *, unnest(range(1, greatest(len(ws) - 5, 1) + 1)) as i from w where len(ws) > 0)),
    d as (select ' ' || array_to_string({SQL_WORDS}, ' ') || ' ' as text from documents),
    f as (select phrase, exists (select 1 from d where contains(d.text, ' ' || phrase || ' ')) as hit from (select distinct phrase from p))
    select item_id, count(*) as phrases, count(*) filter (hit) as found, count(*) filter (hit) >= count(*) - 1 as passes from p join f using (phrase) group by 1""",
)
def known_recall(spark: SparkSession, sf: str) -> DataFrame:
    passages = table(spark, sf, "benchmark").select("item_id", latin_words("text").alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - 5, F.lit(1)))
    phrases = passages.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, 6), " "))).alias("phrase")).distinct()
    documents = table(spark, sf, "documents").select("text")
    return ql.known_phrase_recall(documents, phrases, "item_id", units=lambda c: F.regexp_extract_all(lowered(c), F.lit("[a-z]+"), F.lit(0)), anywhere=True)


@query("duplicate_count", f"with {SQL_PAGE_ITEMS} select page_id, count(*) - count(distinct text) as duplicates from page_items group by 1")
def duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    return ql.duplicate_count(page_items(spark, sf))


@query(
    "regression_gate",
    f"""with {SQL_PAGE_LINES}, s as (select page_id, count(*) as blocks, count(*) - count(distinct text) as dupes, min(least(fx, tx)) as x0, max(greatest(fx, tx)) as x1,
       min(least(fy, ty)) as y0, max(greatest(fy, ty)) as y1 from page_lines group by 1),
    e as (select distinct l_orderkey as page_id, 3 as min_blocks, 1 as max_dupes, case when l_orderkey % 3 = 0 then 8 end as baseline, 300 as w, 200 as h from lineitem),
    r as (select page_id, blocks, dupes, concat_ws('; ', case when blocks < min_blocks then 'few blocks' end, case when dupes > max_dupes then 'duplicates' end,
            case when least(x0, y0) < -100 or greatest(x1, y1) > greatest(w, h) * 1.1 then 'out of bounds' end,
            case when greatest((x1 - x0) / w, (y1 - y0) / h) < 0.25 then 'collapsed' end,
            case when blocks < greatest(min_blocks, floor(baseline * 0.7::double)) and baseline is not null then 'below baseline' end) as reasons from e join s using (page_id))
    select page_id, blocks, dupes, reasons, reasons = '' as passes from r where true""",
)
def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    lines = page_lines(spark, sf)
    expected = lines.select("page_id").distinct().select(
        "page_id", F.lit(3).alias("min_blocks"), F.lit(1).alias("max_dupes"), F.when(F.col("page_id") % 3 == 0, 8).alias("baseline"), F.lit(300).alias("w"), F.lit(200).alias("h")
    )
    return ql.regression_gate(lines, expected)


@query(
    "ordered_truth_diff",
    f"""with recursive s as (select conv_id as page_id, row_number() over (partition by conv_id order by turn) - 1 as position, lower(text) as text from conversations where turn % 3 <> 1),
    n as (select *, lead(text) over (partition by page_id order by position) as next from s),
    t as (select conv_id as page_id, turn as truth_no, lower(text) as text, row_number() over (partition by conv_id order by turn) as k from conversations),
    p as (select t.page_id, t.truth_no, n.position, case when {sql_similar('n.text', 't.text')} >= 0.6 then 1 when n.next is not null and {sql_similar('(n.text || n.next)', 't.text')} >= 0.6 then 2 end as span
          from t join n using (page_id)),
    o as (select page_id, truth_no, list(struct_pack(position := position, span := span) order by position) as options from p where span is not null group by 1, 2),
    r as (select t.*, coalesce(o.options, []) as options from t left join o using (page_id, truth_no)),
    walk as (
      select page_id, cast(0 as bigint) as k, cast(0 as bigint) as "at", cast(null as bigint) as truth_no, cast(null as bigint) as hit, cast(null as int) as span from (select distinct page_id from t)
      union all
      select page_id, k, coalesce(pick.position + pick.span, "at"), truth_no, pick.position, pick.span
      from (select w.page_id, r.k, w."at", r.truth_no, list_filter(r.options, lambda x: x.position >= w."at")[1] as pick from walk w join r on r.page_id = w.page_id and r.k = w.k + 1))
    select page_id, truth_no, hit, span from walk where k > 0""",
)
def ordered_truth_diff(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    served = conv.filter("turn % 3 <> 1").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("position"), F.lower("text").alias("text"))
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("position")
    served = served.withColumn("position", F.row_number().over(w) - 1)
    truth = conv.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("truth_no"), F.lower("text").alias("text"))
    return ql.ordered_truth_diff(served, truth)


@query(
    "overlap_score_gate",
    f"""with {SQL_PAGE_ITEMS}, h as (select page_id, c, count(*) as have from (select page_id, unnest(string_split(replace(text, ' ', ''), '')) as c from page_items) where c <> '' group by 1, 2),
    w as (select page_id, c, count(*) as want from (select page_id, unnest(string_split(replace(name, ' ', ''), '')) as c from page_items) where c <> '' group by 1, 2),
    s as (select page_id, sum(least(want, coalesce(have, 0))) as hits, sum(want) as total from w left join h using (page_id, c) group by 1),
    n as (select page_id, count(*) as lines from page_items group by 1)
    select page_id, lines, round(hits / total, 6) as overlap, hits / total >= 0.6 and lines >= 3 as passes from s join n using (page_id)""",
)
def overlap_score_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    truth = p.select("page_id", F.col("name").alias("text"), F.lit(0.6).alias("floor"), F.lit(3).alias("min_lines"))
    return ql.overlap_score_gate(p.select("page_id", "text"), truth)


def _agreement(spark: SparkSession, sf: str) -> DataFrame:
    reads = page_items(spark, sf).select("page_id", "item", F.col("name").alias("a"), F.col("text").alias("b"))
    return ql.char_agreement(reads)


# A fragment is the beginning of its name, so the agreeing characters are the fragment's own number.
@query("char_agreement", f"with {SQL_PAGE_ITEMS} select page_id, item, length(text) as agree from page_items")
def char_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return _agreement(spark, sf).select("page_id", "item", "agree")


# The characters that both reads agree on are the fragment's, as above.
@query(
    "precision_coverage",
    f"""with {SQL_PAGE_ITEMS}, h as (select page_id, c, count(*) as have from (select page_id, unnest(string_split(text, '')) as c from page_items) where c <> '' group by 1, 2),
    w as (select page_id, c, count(*) as want from (select page_id, unnest(string_split(name, '')) as c from page_items) where c <> '' group by 1, 2)
    select page_id, round(sum(least(coalesce(have, 0), coalesce(want, 0))) / greatest(1, sum(coalesce(want, 0))), 6) as precision,
           round(sum(coalesce(have, 0)) / greatest(1, sum(coalesce(want, 0))), 6) as coverage
    from w full join h using (page_id, c) group by page_id""",
)
def precision_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return ql.precision_coverage(_agreement(spark, sf), page_items(spark, sf).select("page_id", F.col("name").alias("text")))


@query(
    "battery_mismatch",
    f"""with {MIXED}, b as (select text, case when turn % 2 = 0 then 'translate' else 'none' end as want, case turn % 3 when 0 then 'None' when 1 then text else upper(role) end as response from mixed),
    g as (select want, case when regexp_full_match(trim(response), '(?i)none\\.?') then 'none' when trim(response) = trim(text)
      or len(regexp_extract_all(trim(response), '\\p{{Han}}')) > greatest(3.0, length(text) / 2) then 'echo' else 'translate' end as got from b)
    select want, count(*) filter (got <> want) as mismatched, count(*) as total from g group by 1""",
)
def battery_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("turn") % 3
    rows = mixed(spark, sf).select(
        "text", F.when(F.col("turn") % 2 == 0, "translate").otherwise("none").alias("want"),
        F.when(k == 0, "None").when(k == 1, F.col("text")).otherwise(F.upper("role")).alias("response"),
    )
    return ql.battery_mismatch(rows)


@query(
    "grade_counts",
    """with v as (select conv_id, turn as i, case turn % 4 when 0 then 'good' when 1 then 'wrong' when 2 then 'partial' else 'missing' end as v from conversations)
    select conv_id, count(*) filter (v = 'good') as good, count(*) filter (v = 'partial') as partial, count(*) filter (v = 'wrong') as wrong, count(*) filter (v = 'missing') as missing from v group by 1""",
)
def grade_counts(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    k = F.col("turn") % 4
    line = F.concat(F.col("turn").cast("string"), F.when(k == 0, ": Good").when(k == 1, " : wrong").when(k == 2, ":partial").otherwise(": ?"))
    # one answer per turn, as a grader asked line by line would return
    answers = conv.select("conv_id", F.concat(F.lit("Verdict "), line, F.lit(" thanks")).alias("answer"))
    return ql.grade_counts(conv.select("conv_id", F.col("turn").alias("i")), answers, "conv_id")


@query(
    "char_conservation",
    f"""with {MIXED}, r as (select conv_id, sum(len(regexp_extract_all(text, '\\p{{Han}}'))) as raw_han, sum(case when turn % 7 = 3 then 0 else len(regexp_extract_all(text, '\\p{{Han}}')) end) as parsed_han from mixed group by 1)
    select conv_id, cast(raw_han as bigint) as raw_han, cast(parsed_han as bigint) as parsed_han, parsed_han >= 0.95 * raw_han as passes from r""",
)
def char_conservation(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixed(spark, sf)
    return ql.char_conservation(rows, rows.filter("turn % 7 <> 3"), "conv_id")


@query(
    "line_alignment",
    f"""with {SQL_PAGE_ITEMS}, j as (select *, case when y1 - lag(y1) over (partition by page_id order by y1, item) >= 30 then 1 else 0 end as jump from page_items),
    g as (select *, sum(jump) over (partition by page_id order by y1, item rows unbounded preceding) as line_no from j),
    l as (select page_id, cast(line_no as int) as line_no, min(y1) as y1, max(y2) as y2, min(x1) as x1, count(*) as words from g group by 1, 2)
    select page_id, line_no, words, y1 - (10 + line_no * 35) as dy1, y2 - (60 + line_no * 35) as dy2, x1 - 20 as dx1,
           abs(y1 - (10 + line_no * 35)) < 45 and abs(y2 - (60 + line_no * 35)) < 55 and abs(x1 - 20) < 30 as within from l""",
)
def line_alignment(spark: SparkSession, sf: str) -> DataFrame:
    p = page_items(spark, sf)
    truth = p.select("page_id").distinct().withColumn("line_no", F.explode(F.sequence(F.lit(0), F.lit(5))))
    truth = truth.select("page_id", "line_no", (10 + F.col("line_no") * 35).alias("y1"), (60 + F.col("line_no") * 35).alias("y2"), F.lit(20).alias("x1"))
    return ql.line_alignment_check(p, truth)
