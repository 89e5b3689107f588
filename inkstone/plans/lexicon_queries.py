"""Lexicon operators over words of the benchmark table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkstone.functions.geometry import let
from inkstone.operators import lexicon as lx, phonetic as ph
from inkstone.operators.common import measured_side
from inkstone.operators.overlap import shared_shingles, similar_bags, text_classes
from inkstone.plans.registry import query
from inkstone.plans.views import (
    PLACE,
    SIMPLIFIED,
    SQL_DOCUMENT_WORDS,
    SQL_LEXICON,
    SQL_SENSES,
    SQL_WORDS,
    benchmark_words,
    document_words,
    each_word,
    latin_words,
    lexicon,
    spelled,
    sql_han,
    table,
    to_han,
)

IDIOM = "'(?i)\\(idiom\\)'"


@query(
    "lexicon_build",
    f"with {SQL_LEXICON} select ord, traditional, simplified, py_num, py_flat, english, frequent, common from lexicon",
)
def lexicon_build(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon(spark, sf)


@query(
    "lexicon_tiers",
    f"""with {SQL_LEXICON},
    f as (select {sql_han('w')} as word from bench_words group by 1 having count(*) >= 5),
    c as (select {sql_han('w')} as word from bench_words group by 1 having count(*) >= 20)
    select ord, traditional, traditional in (select word from f) or traditional in (select word from c) as frequent,
           traditional in (select word from c) as common from lexicon""",
)
def lexicon_tiers(spark: SparkSession, sf: str) -> DataFrame:
    counts = benchmark_words(spark, sf).groupBy(to_han(F.col("w")).alias("word")).count()
    rows = lexicon(spark, sf).drop("frequent", "common")
    return lx.with_tiers(rows, counts.filter("count >= 5"), counts.filter("count >= 20")).select("ord", "traditional", "frequent", "common")


@query(
    "lexicon_union",
    f"""with {SQL_LEXICON},
    extra as (select item_id * {PLACE} + pos as ord, {sql_han("w")} as traditional from bench_words)
    select 0 as source, cast(ord as bigint) as ord, traditional from lexicon
    union all select 1, cast(ord as bigint), traditional from extra""",
)
def lexicon_union(spark: SparkSession, sf: str) -> DataFrame:
    main = lexicon(spark, sf).select("ord", "traditional")
    extra = benchmark_words(spark, sf).select((F.col("item_id") * PLACE + F.col("pos")).alias("ord"), to_han(F.col("w")).alias("traditional"))
    return lx.union_sources(main, extra).select("ord.source", "ord.ord", "traditional")


@query(
    "syllable_inventory",
    f"""with {SQL_LEXICON}
    select distinct regexp_replace(s, '[0-9]', '', 'g') as syllable from (select unnest(string_split(py_num, ' ')) as s from lexicon)""",
)
def syllable_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return lx.syllable_inventory(lexicon(spark, sf))


@query(
    "idiom_set",
    f"""with {SQL_LEXICON}
    select traditional, arg_min(english, ord) as english, min(ord) as ord from lexicon
    where regexp_matches(english, {IDIOM}) group by 1""",
)
def idiom_set(spark: SparkSession, sf: str) -> DataFrame:
    return lx.idiom_set(lexicon(spark, sf)).select("traditional", "english", "ord")


PAIRS = """pairs as (
  select ord, unnest(range(length(traditional))) as pos, unnest(string_split(simplified, '')) as s, unnest(string_split(traditional, '')) as t
  from lexicon where length(simplified) = length(traditional))"""


@query(
    "script_map",
    f"with {SQL_LEXICON}, {PAIRS} select s as simplified, arg_min(t, (ord, pos)) as traditional from pairs where s <> t group by 1",
)
def script_map(spark: SparkSession, sf: str) -> DataFrame:
    return lx.char_script_map(lexicon(spark, sf))


# Words met in two spellings: the last letter of some senses is swapped, so a
# simplified character has several traditional candidates to vote between.
VOTING = "case when s = 1 and length(w) > 3 then substring(w, 1, length(w) - 1) || 'z' else w end"


def _voting_words(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.plans.views import lexicon_source

    swapped = F.when(
        (F.col("s") == 1) & (F.length("w") > 3), F.expr("substring(w, 1, length(w) - 1) || 'z'")
    ).otherwise(F.col("w"))
    return lexicon_source(spark, sf).select("ord", "simplified", to_han(swapped).alias("traditional"))


VOTES = f"""voting as (select ord, simplified, {sql_han(VOTING)} as traditional from lexicon),
vpairs as (
  select ord, unnest(range(length(traditional))) as pos, unnest(string_split(simplified, '')) as s, unnest(string_split(traditional, '')) as t
  from voting where length(simplified) = length(traditional)),
votes as (select s, t, sum(case when s = t then 5 else 1 end) as votes, min((ord, pos)) as seen from vpairs group by 1, 2),
winners as (select s, arg_min(t, (-votes, seen)) as best, min(seen) as s_seen from votes group by 1),
remap as (select t as variant, arg_max(best, s_seen) as standard from votes join winners using (s) where t <> best group by 1)"""


@query("variant_vote", f"with {SQL_LEXICON}, {VOTES} select variant, standard from remap")
def variant_vote(spark: SparkSession, sf: str) -> DataFrame:
    return lx.variant_majority_vote(_voting_words(spark, sf))


@query(
    "remap_frequency",
    f"""with {SQL_LEXICON}, {VOTES},
    ranked as (select {sql_han('w')} as word, min(ord) as rank from lexicon group by 1),
    chars as (select word, rank, unnest(string_split(word, '')) as c, unnest(range(length(word))) as pos from ranked),
    fixed as (select word, rank, string_agg(coalesce(standard, c), '' order by pos) as f from chars left join remap on c = variant group by 1, 2)
    select f as word, min(rank) as rank, arg_min(f <> word, rank) as changed from fixed group by 1""",
)
def remap_frequency(spark: SparkSession, sf: str) -> DataFrame:
    ranked = lexicon(spark, sf).groupBy(F.col("traditional").alias("word")).agg(F.min("ord").alias("rank"))
    return lx.remap_frequency_list(ranked, lx.variant_majority_vote(_voting_words(spark, sf)))


# Readings per character: a letter is read after its neighbour in the word.
READINGS = f"""letters as (
  select (item_id, pos, i) as ord, substring(w, i + 1, 1) as c, substring(w, i + 2, 1) as next from (
    select item_id, pos, w, unnest(range(length(w))) as i from bench_words)),
readings as (
  select {sql_han('c')} as char, case when next = '' then c || '0' else c || next || cast(ascii(next) % 6 + 1 as varchar) end as reading,
         count(*) as count, min(ord) as ord from letters group by 1, 2)"""


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    letters = benchmark_words(spark, sf).select(
        "item_id", "pos", "w", F.explode(F.sequence(F.lit(0), F.length("w") - 1)).alias("i")
    )
    letters = letters.select(
        F.struct("item_id", "pos", "i").alias("ord"),
        F.substring("w", F.col("i") + 1, F.lit(1)).alias("c"),
        F.substring("w", F.col("i") + 2, F.lit(1)).alias("next"),
    )
    reading = F.when(F.col("next") == "", F.concat("c", F.lit("0"))).otherwise(
        F.concat("c", "next", (F.ascii("next") % 6 + 1).cast("string"))
    )
    return letters.groupBy(to_han(F.col("c")).alias("char"), reading.alias("reading")).agg(
        F.count("*").alias("count"), F.min("ord").alias("ord")
    )


RANKED = """ranked as (
  select char, reading, row_number() over (partition by char order by count desc, ord) as rank from readings
  where regexp_full_match(reading, '[a-z]+[1-6]'))"""


@query("char_readings", f"with {SQL_LEXICON}, {READINGS}, {RANKED} select char, reading, rank from ranked")
def char_readings(spark: SparkSession, sf: str) -> DataFrame:
    return lx.rank_char_readings(_readings(spark, sf))


@query("positive_freq", f"with {SQL_LEXICON}, {READINGS} select char, reading, count - 2 as count from readings where count - 2 > 0")
def positive_freq(spark: SparkSession, sf: str) -> DataFrame:
    return lx.positive_freq(_readings(spark, sf).select("char", "reading", (F.col("count") - 2).alias("count")))


# A word's readings: its senses' spellings; odd senses lose their last syllable and are invalid.
WORD_READINGS = """word_readings as (
  select traditional as word, ord, case when s = 1 then regexp_replace(py_num, ' [a-z]+[0-9]$', '') else py_num end as reading from lexicon)"""
FIRST_READINGS = """first_readings as (
  select word, arg_min(reading, ord) as reading from word_readings
  where length(word) >= 2 and len(string_split(reading, ' ')) = length(word) group by 1)"""


def word_readings(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.plans.views import lexicon_source

    cut = F.when(F.col("s") == 1, F.regexp_replace("pinyin", " [a-z]+[0-9]$", "")).otherwise(F.col("pinyin"))
    return lexicon_source(spark, sf).select(F.col("traditional").alias("word"), "ord", cut.alias("reading"))


@query("word_readings", f"with {SQL_LEXICON}, {WORD_READINGS}, {FIRST_READINGS} select word, reading from first_readings")
def word_readings_query(spark: SparkSession, sf: str) -> DataFrame:
    return lx.first_valid_word_reading(word_readings(spark, sf))


@query(
    "gap_fill_readings",
    f"""with {SQL_LEXICON}, {READINGS}, {RANKED}, {WORD_READINGS}, {FIRST_READINGS},
    counted as (select * from ranked where unicode(char) % 2 = 0),
    missing as (select distinct c from (select unnest(string_split(word, '')) as c from first_readings) where c not in (select char from counted)),
    fallback as (select char, reading, min(ord) as ord from readings where regexp_full_match(reading, '[a-z]+[1-6]') group by 1, 2)
    select char, reading, rank, 'counted' as source from counted
    union all
    select char, reading, row_number() over (partition by char order by ord), 'fallback' from fallback where char in (select c from missing)""",
)
def gap_fill_readings(spark: SparkSession, sf: str) -> DataFrame:
    readings = _readings(spark, sf)
    counted = lx.rank_char_readings(readings).filter(F.conv(F.hex(F.encode("char", "UTF-16BE")), 16, 10).cast("long") % 2 == 0)
    return lx.gap_fill_readings(counted, lx.first_valid_word_reading(word_readings(spark, sf)), readings)


@query(
    "top_entries_by_key",
    f"""with {SQL_LEXICON} select py_flat, traditional, py_num, ord, rank from (
    select *, row_number() over (partition by py_flat order by frequent desc, ord) as rank from lexicon) where rank <= 8""",
)
def top_entries_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return lx.top_entries_by_key(lexicon(spark, sf)).select("py_flat", "traditional", "py_num", "ord", "rank")


@query(
    "top_chars_by_syllable",
    f"""with {SQL_LEXICON} select syllable, traditional, ord, rank from (
    select *, py_flat as syllable, row_number() over (partition by py_flat order by frequent desc, ord) as rank
    from lexicon where length(traditional) = 1) where rank <= 10""",
)
def top_chars_by_syllable(spark: SparkSession, sf: str) -> DataFrame:
    return lx.top_chars_by_syllable(lexicon(spark, sf)).select("syllable", "traditional", "ord", "rank")


@query(
    "top_entries_by_headword",
    f"""with {SQL_LEXICON} select key, tier, ord, rank from (
    select key, tier, ord, row_number() over (partition by key, tier order by ord) as rank from (
      select traditional as key, 0 as tier, ord from lexicon union all
      select simplified, 1, ord from lexicon where simplified <> traditional)) where rank <= 4""",
)
def top_entries_by_headword(spark: SparkSession, sf: str) -> DataFrame:
    return lx.top_entries_by_headword(lexicon(spark, sf)).select("key", "tier", "ord", "rank")


@query("pick_sense", f"with {SQL_LEXICON}, {SQL_SENSES} select key, traditional, py_num, english from senses")
def pick_sense(spark: SparkSession, sf: str) -> DataFrame:
    return lx.pick_sense(lexicon(spark, sf)).select("key", "traditional", "py_num", "english")


@query(
    "lexicon_lookup",
    f"""with {SQL_LEXICON}, {SQL_SENSES}, {SQL_DOCUMENT_WORDS}
    select t.token, count(*) as n, count(distinct doc_id) as docs, s.py_num, s.english, s.key is not null as known
    from document_words t left join senses s on s.key = t.token group by t.token, s.py_num, s.english, s.key""",
)
def lexicon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    per_doc = document_words(spark, sf).groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    tokens = per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    return lx.lexicon_lookup(tokens, lexicon(spark, sf)).select("token", "n", "docs", "py_num", "english", "known")


@query(
    "lexicon_misses",
    f"""with {SQL_LEXICON}, {SQL_DOCUMENT_WORDS},
    keys as (select traditional as k from lexicon union select simplified from lexicon)
    select doc_id, token, position, rank from (
      select *, row_number() over (partition by doc_id order by position, token) as rank from (
        select doc_id, token, min(position) as position from document_words
        where length(token) >= 2 and token not in (select k from keys) group by 1, 2))
    where rank <= 3""",
)
def lexicon_misses(spark: SparkSession, sf: str) -> DataFrame:
    return lx.lexicon_misses(document_words(spark, sf), lexicon(spark, sf), "doc_id", "position").select(
        "doc_id", "token", "position", "rank"
    )


@query(
    "idiom_verify",
    f"""with {SQL_LEXICON}, {SQL_DOCUMENT_WORDS},
    idioms as (select traditional, arg_min(english, ord) as english from lexicon where regexp_matches(english, {IDIOM}) group by 1)
    select doc_id, position, traditional, english, rank from (
      select doc_id, position, i.traditional, english, row_number() over (partition by doc_id order by position) as rank
      from document_words join idioms i on i.traditional = token) where rank <= 3""",
)
def idiom_verify(spark: SparkSession, sf: str) -> DataFrame:
    proposals = document_words(spark, sf).select("doc_id", "position", F.concat(F.lit(" "), "token").alias("proposal"))
    return lx.idiom_verify(proposals, lexicon(spark, sf), "doc_id").select("doc_id", "position", "traditional", "english", "rank")


# Proposed definitions: the words of conversation turns, some of them malformed.
PROPOSED = f"""proposed as (
  select (conv_id * 1000 + turn) * {PLACE} + pos as ord, {sql_han('w')} as word,
         case when turn % 5 = 1 then {sql_han("w || 'a'")} else {sql_han('w')} end as traditional,
         case when turn % 5 = 1 then {sql_han("w || 'a'", SIMPLIFIED)} else {sql_han('w', SIMPLIFIED)} end as simplified,
         case when conv_id % 7 = 2 then 'ni3' when conv_id % 7 = 3 then regexp_replace(SPELL, '[0-9]', '', 'g') else SPELL end as pinyin,
         case when conv_id % 11 = 4 then 'no' else 'said ' || w end as english
  from (select conv_id, turn, unnest(ws) as w, unnest(range(len(ws))) as pos from (select conv_id, turn, {SQL_WORDS} as ws from conversations)))""".replace(
    "SPELL", "(" + __import__("inkstone.plans.views", fromlist=["sql_spelled"]).sql_spelled("w", "0") + ")"
)
REASON = """case when traditional <> word and simplified <> word then 'other characters'
     when len(string_split(trim(pinyin), ' ')) <> length(word) then 'syllable count'
     when not regexp_full_match(trim(pinyin), '(?i)[a-züv]+[1-5](\\s+[a-züv]+[1-5])*') then 'reading shape'
     when length(trim(english)) < 5 or length(trim(english)) > 250 then 'gloss length' end"""


def proposed(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.plans.views import spelled

    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(latin_words("text")).alias("pos", "w")
    )
    odd = F.col("turn") % 5 == 1
    longer = F.concat("w", F.lit("a"))
    spelling = spelled(F.col("w"), F.lit(0))
    return rows.select(
        ((F.col("conv_id") * 1000 + F.col("turn")) * PLACE + F.col("pos")).alias("ord"),
        to_han(F.col("w")).alias("word"),
        F.when(odd, to_han(longer)).otherwise(to_han(F.col("w"))).alias("traditional"),
        F.when(odd, to_han(longer, SIMPLIFIED)).otherwise(to_han(F.col("w"), SIMPLIFIED)).alias("simplified"),
        F.when(F.col("conv_id") % 7 == 2, "ni3")
        .when(F.col("conv_id") % 7 == 3, F.regexp_replace(spelling, "[0-9]", ""))
        .otherwise(spelling)
        .alias("pinyin"),
        F.when(F.col("conv_id") % 11 == 4, "no").otherwise(F.concat(F.lit("said "), "w")).alias("english"),
    )


@query("validate_definition", f"with {PROPOSED} select ord, word, {REASON} as reject_reason from proposed")
def validate_definition(spark: SparkSession, sf: str) -> DataFrame:
    return lx.validate_definition(proposed(spark, sf)).select("ord", "word", "reject_reason")


@query(
    "definition_merge",
    f"""with {SQL_LEXICON}, {PROPOSED},
    keys as (select traditional as k from lexicon union select simplified from lexicon),
    sound as (select *, row_number() over (partition by word order by ord) as r from proposed
              where ({REASON}) is null and word not in (select k from keys))
    select ord, traditional, simplified, lower(trim(pinyin)) as py_num,
           regexp_replace(lower(trim(pinyin)), '[0-9 ]', '', 'g') as py_flat, trim(english) || ' (AI-defined)' as english
    from sound where r = 1""",
)
def definition_merge(spark: SparkSession, sf: str) -> DataFrame:
    return lx.definition_merge(lexicon(spark, sf), proposed(spark, sf))


UNKNOWN = f"""unknown as (
  select distinct w as syllable from (select unnest({SQL_WORDS}) as w from documents))"""


@query(
    "fuzzy_join",
    f"""with {UNKNOWN},
    inv as (select distinct w as near from (select unnest({SQL_WORDS}) as w from benchmark))
    select syllable, near from unknown join inv on abs(length(syllable) - length(near)) <= 1 and levenshtein(syllable, near) <= 1
    where syllable not in (select near from inv)""",
)
def fuzzy_join(spark: SparkSession, sf: str) -> DataFrame:
    words = each_word(table(spark, sf, "documents")).withColumnRenamed("w", "syllable")
    inventory = table(spark, sf, "benchmark").select(F.explode(latin_words("text")).alias("syllable")).distinct()
    unknown = words.distinct().join(inventory, "syllable", "left_anti")
    return ph.fuzzy_syllable_join(unknown, inventory)


# Chips for each word of a conversation: its letters are the syllables. Equal words get equal chips.
@query("candidates")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").groupBy(F.concat_ws("-", "conv_id", "turn").alias("said")).agg(F.collect_set("text").alias("texts"))

    def by_place(texts: Column) -> Column:
        """The distinct words at each place, one unless a turn was said twice."""
        last = F.array_max(F.transform(texts, F.size)) - 1
        place = lambda i: F.array_sort(F.array_distinct(F.array_compact(F.transform(texts, lambda t: F.get(t, i)))))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), place))

    said = let(F.transform("texts", latin_words), by_place)
    words = turns.select("said", F.posexplode(said).alias("pos", "ws")).select(
        F.concat_ws("-", F.when(F.col("said") != "", F.col("said")), "pos").alias("query_id"), "ws"
    )
    typed = words.select("ws").distinct().select("ws", F.explode("ws").alias("w"))
    reading = F.regexp_replace(spelled(F.col("w"), F.lit(0)), "[0-9]", "")
    # every second syllable loses its last letter and must be found by a near spelling
    typed = typed.withColumn(
        "typed",
        F.transform(
            F.split(reading, " "),
            lambda s, i: F.when((i % 2 == 1) & (F.length(s) > 2), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s),
        ),
    )
    syllables = typed.select("ws", F.posexplode("typed").alias("position", "syllable"))
    chips = measured_side(ph.candidates(syllables, lexicon(spark, sf), "ws"))
    return words.join(chips, "ws").select("query_id", "place", "syllable", "traditional", "turn", "position")


RUNS = f"""
runs as (
  select side, id, unnest(case when len(ws) = 0 then [] else list_distinct(list_transform(range(greatest(len(ws) - 7, 1)), lambda i: array_to_string(ws[i + 1:i + 8], ' '))) end) as run
  from (select 0 as side, doc_id as id, {SQL_WORDS} as ws from documents union all select 1, item_id, {SQL_WORDS} from benchmark)),
totals as (select side, id, count(*) as n from runs group by 1, 2)"""


# Benchmark passages in documents, by shared runs of eight words.
@query(
    "char_overlap_join",
    f"""with {RUNS}
    select a.id as doc_id, b.id as item_id, count(*) as shared, x.n as left_total, y.n as right_total, round(count(*) / least(x.n, y.n), 6) as score
    from runs a join runs b on a.side = 0 and b.side = 1 and a.run = b.run
    join totals x on x.side = 0 and x.id = a.id join totals y on y.side = 1 and y.id = b.id group by a.id, b.id, x.n, y.n""",
)
def char_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", latin_words("text").alias("words"))
    items = table(spark, sf, "benchmark").select("item_id", latin_words("text").alias("words"))
    joined = shared_shingles(docs, items, "doc_id", "item_id")
    return joined.withColumn("left_total", F.col("left_total").cast("bigint")).withColumn("right_total", F.col("right_total").cast("bigint")).withColumn("score", F.round("score", 6))


# Documents and benchmark passages that are at least 0.8 alike as multisets of words, one row for equal documents.
@query(
    "multiset_join",
    f"""with d as (select min(doc_id) as id, count(*) as copies, ws from (select doc_id, {SQL_WORDS} as ws from documents) where len(ws) > 0 group by ws),
    b as (select item_id as id, {SQL_WORDS} as ws from benchmark),
    e as (select side, id, n, w, row_number() over (partition by side, id, w) as k
          from (select 0 as side, id, len(ws) as n, unnest(ws) as w from d union all select 1, id, len(ws), unnest(ws) from b)),
    s as (select x.id as doc_id, y.id as item_id, count(*) as shared, x.n as left_total, y.n as right_total
          from e x join e y on x.side = 0 and y.side = 1 and x.w = y.w and x.k = y.k group by all)
    select doc_id, d.copies, item_id, shared, left_total, right_total, round(shared / least(left_total, right_total), 6) as score
    from s join d on d.id = doc_id where 10 * shared >= 8 * least(left_total, right_total)""",
)
def multiset_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_classes(table(spark, sf, "documents").select("doc_id", latin_words("text").alias("words")), "doc_id")
    items = table(spark, sf, "benchmark").select("item_id", latin_words("text").alias("words"))
    alike = similar_bags(docs, items, "doc_id", "item_id", 0.8).join(docs.select("doc_id", "copies"), "doc_id")
    return alike.select("doc_id", "copies", "item_id", "shared", "left_total", "right_total", F.round("score", 6).alias("score"))
