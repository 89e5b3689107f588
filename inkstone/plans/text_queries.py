"""Text operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkstone.functions.syllables import FINALS, INITIALS, STANDALONE
from inkstone.functions.text import MARK_TONES, MARKED_VOWELS, PLAIN_VOWELS, SPELLING_REPAIRS, TONE_MARKS, marks_to_number, strip_marks
from inkstone.operators import lexicon as lx, phonetic as ph, segmentation as sg
from inkstone.operators.common import measured_side
from inkstone.operators.rules import bpmf_layout, entry_annotations, structure_tokens
from inkstone.plans.lexicon_queries import FIRST_READINGS, RANKED, READINGS, WORD_READINGS, _readings, word_readings
from inkstone.plans.registry import query
from inkstone.plans.views import (
    LETTERS,
    SIMPLIFIED,
    SQL_LEXICON,
    SQL_LOWER,
    SQL_SENSES,
    SQL_WORDS,
    TRADITIONAL,
    each_word,
    latin_words,
    lexicon,
    lowered,
    spelled,
    sql_han,
    sql_spelled,
    table,
    to_han,
)


def sql_map(table: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def sql_bopomofo(base: str, tone: str) -> str:
    initial = f"regexp_extract({base}, '^(zh|ch|sh|[bpmfdtnlgkhjqxrzcs])', 1)"
    rest = f"substring({base}, length({initial}) + 1)"
    final = f"case when {initial} in ('j', 'q', 'x') then regexp_replace({rest}, '^u', 'v') else {rest} end"
    composed = (
        f"case when {initial} = '' then null when {initial} in ('zh','ch','sh','r','z','c','s') and ({final}) = 'i' "
        f"then {sql_map(INITIALS)}[{initial}] else {sql_map(INITIALS)}[{initial}] || {sql_map(FINALS)}[{final}] end"
    )
    body = f"coalesce({sql_map(STANDALONE)}[{base}], {composed}, {sql_map(FINALS)}[{base}])"
    return f"coalesce(case {tone} when 5 then '˙' || {body} when 1 then {body} else {body} || substring('ˊˇˋ', {tone} - 1, 1) end, '')"


def sql_marked(base: str, tone: str) -> str:
    at = (
        f"case when instr({base}, 'v') > 0 then instr({base}, 'v') when instr({base}, 'a') > 0 then instr({base}, 'a') "
        f"when instr({base}, 'o') > 0 then instr({base}, 'o') when instr({base}, 'e') > 0 then instr({base}, 'e') "
        f"else length(regexp_extract({base}, '^(.*[iu])', 1)) end"
    )
    marks = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in TONE_MARKS.items()) + "}"
    swapped = f"substring({base}, 1, ({at}) - 1) || substring({marks}[substring({base}, {at}, 1)], {tone}, 1) || substring({base}, ({at}) + 1)"
    return f"replace(case when {tone} <= 4 and ({at}) > 0 then {swapped} else {base} end, 'v', 'ü')"


SYL26 = f"""syl26 as (
  select base, tone, base || cast(tone as varchar) as numbered, {sql_bopomofo('base', 'tone')} as bopomofo, {sql_marked('base', 'tone')} as marked
  from (select unnest({"[" + ",".join(f"'{s}'" for s in __import__("inkstone.plans.views", fromlist=["SYLLABLES"]).SYLLABLES) + "]"}) as base), range(1, 6) t(tone))"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "role", "text")


def turn_words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct Latin words of all conversations."""
    return each_word(turns(spark, sf)).distinct()


TURNS = "turns as (select concat_ws('-', conv_id, turn) as id, conv_id, turn, role, text from conversations)"
TURN_WORDS = f"turn_words as (select distinct w from (select unnest({SQL_WORDS}) as w from conversations))"


def sql_walk(name: str, runs: str, words: str, max_len: int) -> str:
    """Recursive longest match of Latin runs (column w) against words (column w)."""
    pieces = ", ".join(f"l{n}.w" for n in range(max_len, 1, -1))
    joins = " ".join(f"left join {words} l{n} on l{n}.w = substring(k.w, k.loc + 1, {n})" for n in range(max_len, 1, -1))
    return f"""{name} as (
  select w, 0 as loc, cast([] as varchar[]) as toks from {runs}
  union all
  select w, loc + length(p), list_append(toks, p) from (
    select k.w, k.loc, k.toks, coalesce({pieces}, substring(k.w, k.loc + 1, 1)) as p
    from {name} k {joins} where k.loc < length(k.w)))"""


def sql_lex_words(max_len: int) -> str:
    return f"lexw as (select distinct w from lexicon where length(w) between 2 and {max_len})"


@query(
    "to_traditional",
    f"""select doc_id, translate(translate(lower(text), '{LETTERS}', '{SIMPLIFIED}'),
        (select string_agg(s, '' order by s) from m), (select string_agg(t, '' order by s) from m)) as traditional
    from documents""".replace(
        "select doc_id",
        f"""with {SQL_LEXICON}, pairs as (
      select ord, unnest(range(length(traditional))) as pos, unnest(string_split(simplified, '')) as s, unnest(string_split(traditional, '')) as t from lexicon),
    m as (select s, arg_min(t, (ord, pos)) as t from pairs where s <> t group by 1)
    select doc_id""",
        1,
    ),
)
def to_traditional(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", to_han(F.col("text"), SIMPLIFIED).alias("text"))
    mapping = lx.char_script_map(lexicon(spark, sf))
    return lx.map_characters(docs, {"text": "traditional"}, mapping, "simplified", "traditional").select("doc_id", "traditional")


@query(
    "segment_longest",
    f"""with recursive {SQL_LEXICON}, {sql_lex_words(4)},
    counted as (select w, count(*) as n from (select unnest({SQL_WORDS}) as w from documents) group by 1),
    {sql_walk('walk', 'counted', 'lexw', 4)}
    select {sql_han('k.w')} as run, {sql_han("array_to_string(toks, '|')")} as tokens, n
    from walk k join counted using (w) where loc = length(k.w)""",
)
def segment_longest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", to_han(lowered("text")).alias("text"))
    runs = sg.han_runs(docs, "doc_id", "text").groupBy("run").agg(F.count("*").alias("n"))
    words = lexicon(spark, sf).select(F.col("traditional").alias("word"))
    done = sg.segment_runs(runs.select("run"), words)
    return done.join(runs, "run").select("run", F.array_join("tokens", "|").alias("tokens"), "n")


def _doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), to_han(lowered("text")).alias("text"))
    return sg.segment_words(texts, lexicon(spark, sf), "id", "text")


DOC_WORDS = f"doc_words as (select distinct w from (select unnest({SQL_WORDS}) as w from documents))"
DOC_TOKENS = f"""{SQL_LEXICON}, {sql_lex_words(8)}, {DOC_WORDS}, {sql_walk('walk', 'doc_words', 'lexw', 8)},
cut as (select w, toks from walk where loc = length(w)),
runs as (select id, unnest(rs) as run, unnest(range(len(rs))) as run_no from (select cast(doc_id as varchar) as id, regexp_extract_all({SQL_LOWER}, '[a-z]+|[^a-z]+') as rs from documents)),
doc_tokens as (
  select id, run_no, unnest(toks) as w, unnest(range(len(toks))) as token_no from runs join cut on cut.w = run)"""


@query(
    "segment_words",
    f"with recursive {DOC_TOKENS} select id, run_no, token_no, {sql_han('w')} as token from doc_tokens",
)
def segment_words(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_tokens(spark, sf).select("id", "run_no", "token_no", "token")


CARDS = f"""cards as (
  select id, run_no, token_no, 0 as char_no, {sql_han('w')} as token, s.traditional, s.simplified, s.py_num, s.english, true as known
  from doc_tokens join senses s on s.key = {sql_han('w')}
  union all
  select id, run_no, token_no, 0, {sql_han('w')}, coalesce(s.traditional, {sql_han('w')}), coalesce(s.simplified, {sql_han('w')}),
         coalesce(s.py_num, ''), coalesce(s.english, ''), false
  from doc_tokens left join senses s on s.key = {sql_han('w')} where s.key is null)"""


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _doc_tokens(spark, sf).select("id", "run_no", "token_no", "token")
    return sg.word_cards(tokens, lexicon(spark, sf))


# After longest match with the lexicon itself, only single characters can be unknown.
@query(
    "word_cards",
    f"with recursive {DOC_TOKENS}, {SQL_SENSES}, {CARDS} select id, run_no, token_no, char_no, traditional, py_num, english, known from cards",
)
def word_cards(spark: SparkSession, sf: str) -> DataFrame:
    return _cards(spark, sf).select("id", "run_no", "token_no", "char_no", "traditional", "py_num", "english", "known")


# Whole words as tokens: those the lexicon lacks fall apart into characters.
@query(
    "word_cards_apart",
    f"""with {SQL_LEXICON}, {SQL_SENSES}, {DOC_WORDS},
    hits as (select {sql_han('w')} as token, 0 as char_no, s.traditional, s.py_num, true as known from doc_words join senses s on s.key = {sql_han('w')}),
    apart as (select w, unnest(string_split({sql_han('w')}, '')) as c, unnest(range(length(w))) as char_no
              from doc_words where {sql_han('w')} not in (select key from senses))
    select token, char_no, traditional, py_num, known from hits
    union all
    select c, char_no, coalesce(s.traditional, c), coalesce(s.py_num, ''), s.key is not null from apart left join senses s on s.key = c""",
)
def word_cards_apart(spark: SparkSession, sf: str) -> DataFrame:
    words = each_word(table(spark, sf, "documents")).distinct()
    tokens = words.select("w", to_han(F.col("w")).alias("token"))
    return sg.word_cards(tokens, lexicon(spark, sf)).select("token", "char_no", "traditional", "py_num", "known")


@query(
    "known_rate",
    f"""with recursive {DOC_TOKENS}, {SQL_SENSES}, {CARDS}
    select id, count(*) as tokens, count(*) filter (known) as known, round(avg(cast(known as int)), 6) as known_rate from cards group by 1""",
)
def known_rate(spark: SparkSession, sf: str) -> DataFrame:
    return sg.coverage_report(_cards(spark, sf), "id")


@query(
    "phrase_rows",
    f"""with recursive {DOC_TOKENS}, {SQL_SENSES}, {CARDS}
    select id || '/' || cast(run_no as varchar) as utterance, string_agg(traditional, '' order by token_no, char_no) as traditional,
           string_agg(simplified, '' order by token_no, char_no) as simplified,
           coalesce(string_agg(nullif(py_num, ''), ' ' order by token_no, char_no), '') as py_num, count(*) as words
    from cards group by 1 having count(*) >= 2""",
)
def phrase_rows(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), to_han(lowered("text")).alias("text"))
    runs = sg.cut_runs(texts, "id", "text").filter("han")
    # equal runs make equal phrases; each is put together once and handed to the places it stands at
    distinct = sg.han_runs(texts, "id", "text").select("run").distinct().select(F.col("run").alias("phrase"), F.col("run").alias("text"))
    words = lexicon(spark, sf)
    tokens = sg.segment_words(distinct, words, "phrase", "text").select("phrase", "token_no", "token")
    phrases = measured_side(sg.phrase_rows(sg.word_cards(tokens, words), "phrase", ["token_no", "char_no"]))
    placed = runs.select(F.concat("id", F.lit("/"), F.col("run_no").cast("string")).alias("utterance"), F.col("run").alias("phrase"))
    return placed.join(phrases, "phrase").select("utterance", "traditional", "simplified", "py_num", "words")


# Given readings: the word's own spelling in marks, cut short for every fifth length.
def _variants(spark: SparkSession, sf: str) -> DataFrame:
    words = turn_words(spark, sf)
    lex_words = lexicon(spark, sf).select(F.col("traditional").alias("word"))
    runs = words.select("w", to_han(F.col("w")).alias("run"))
    cut = sg.segment_runs(runs.select("run"), lex_words, max_len=8)
    marks = F.split(ph.phrase_marks(spelled(F.col("w"), F.lit(0))), " ")
    given = F.when(F.length("w") % 5 == 0, F.slice(marks, F.lit(1), F.size(marks) - 1)).otherwise(marks)
    return runs.join(cut.select("run", F.col("tokens").alias("words")), "run").select(
        F.col("run").alias("variant"), "words", F.array_join(given, " ").alias("pinyin")
    )


ANNOTATED = f"""{SQL_LEXICON}, {sql_lex_words(8)}, {TURN_WORDS}, {sql_walk('walk', 'turn_words', 'lexw', 8)}, {SYL26},
words as (
  select w, unnest(toks) as word, unnest(range(len(toks))) as word_no, toks from walk where loc = length(w)),
placed as (
  select w, word, word_no, coalesce(list_sum(list_transform(list_slice(toks, 1, word_no), lambda t: length(t))), 0) as off from words),
entry as (select w as word, arg_min(py_num, ord) as py from lexicon group by 1),
given as (
  select w, string_split({sql_spelled('w', '0')}, ' ') as g, case when length(w) % 5 = 0 then length(w) - 1 else length(w) end as n from turn_words),
cells as (
  select p.w, p.word, p.word_no, i, substring(p.word, i + 1, 1) as c, e.py is not null as found, p.off + i >= n as missing, n <> length(p.w) as off_count,
         coalesce(list_extract(string_split(e.py, ' '), i + 1),
                  case when p.off + i < n then regexp_replace(list_extract(g, cast(p.off + i + 1 as int)), '5$', '1') end) as numbered
  from placed p join given using (w) left join entry e on e.word = p.word, unnest(range(length(p.word))) t(i)),
annotated as (
  select w, word_no, word, string_agg({sql_han('c')} || ':' || coalesce(marked, '') || ':' || coalesce(bopomofo, ''), '|' order by i) as cells,
         bool_or(missing) or bool_or(off_count) as low
  from cells left join syl26 using (numbered) group by 1, 2, 3)"""


@query(
    "annotate_readings",
    f"with recursive {ANNOTATED} select {sql_han('w')} as variant, word_no, {sql_han('word')} as word, cells, low from annotated",
)
def annotate_readings(spark: SparkSession, sf: str) -> DataFrame:
    rows = ph.annotate_readings(_variants(spark, sf), lexicon(spark, sf), "variant")
    cells = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c.h, c.py, c.bpmf)), "|")
    return rows.select("variant", "word_no", "word", cells.alias("cells"), "low")


@query(
    "low_confidence",
    f"with recursive {ANNOTATED} select {sql_han('w')} as variant, bool_or(low) as low_confidence from annotated group by 1",
)
def low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return ph.low_confidence(ph.annotate_readings(_variants(spark, sf), lexicon(spark, sf), "variant"), "variant")


@query(
    "annotate_cantonese",
    f"""with recursive {SQL_LEXICON}, {READINGS}, {RANKED}, {WORD_READINGS}, {FIRST_READINGS}, {TURN_WORDS},
    jyut_words as (select translate(word, '{TRADITIONAL}', '{LETTERS}') as w from first_readings where length(word) between 2 and 4),
    {sql_walk('walk', 'turn_words', 'jyut_words', 4)},
    toks as (select {sql_han('t')} as token from (select unnest(toks) as t from walk where loc = length(w))),
    counted as (select token, count(*) as n from toks group by 1),
    read as (select token, n, case when length(token) > 1 then f.reading else r.reading end as jyut
             from counted left join first_readings f on f.word = token left join ranked r on r.char = token and r.rank = 1)
    select token, n, jyut, array_to_string(list_transform(range(length(token)), lambda i: substring(token, i + 1, 1) || ':' ||
           case when len(string_split(coalesce(jyut, ''), ' ')) = length(token) then list_extract(string_split(coalesce(jyut, ''), ' '), i + 1) else '' end), '|') as cells
    from read""",
)
def annotate_cantonese(spark: SparkSession, sf: str) -> DataFrame:
    words = lx.first_valid_word_reading(word_readings(spark, sf))
    chars = lx.rank_char_readings(_readings(spark, sf))
    runs = turn_words(spark, sf).select(to_han(F.col("w")).alias("run"))
    tokens = sg.segment_runs(runs, words).select(F.explode("tokens").alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("han", F.lit(True))
    read = sg.annotate_cantonese(counted, words, chars)
    cells = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c.h, c.py)), "|")
    return read.select("token", "n", "jyut", cells.alias("cells"))


@query(
    "syllable_dim",
    f"""with {TURN_WORDS}, dim as (select w as base, tone from turn_words, range(1, 6) t(tone))
    select base || cast(tone as varchar) as numbered, base, tone, {sql_bopomofo('base', 'tone')} as bopomofo, {sql_marked('base', 'tone')} as marked from dim""",
)
def syllable_dim(spark: SparkSession, sf: str) -> DataFrame:
    return ph.syllable_dim(turn_words(spark, sf).withColumnRenamed("w", "syllable"))


@query(
    "bpmf_layout",
    f"""with {TURN_WORDS}, dim as (select w as base, tone from turn_words, range(1, 6) t(tone)),
    b as (select base, tone, {sql_bopomofo('base', 'tone')} as bopomofo from dim)
    select base, tone, bopomofo, case when bopomofo like '˙%' then '˙' else '' end as dot,
           rtrim(ltrim(bopomofo, '˙'), 'ˊˇˋ') as symbols, case when right(bopomofo, 1) in ('ˊ', 'ˇ', 'ˋ') then right(bopomofo, 1) else '' end as tone_mark
    from b""",
)
def bpmf_layout_query(spark: SparkSession, sf: str) -> DataFrame:
    dim = ph.syllable_dim(turn_words(spark, sf).withColumnRenamed("w", "syllable"))
    return bpmf_layout(dim.select("base", "tone", "bopomofo"))


PLAIN = f"translate(low, '{MARKED_VOWELS}ü', '{PLAIN_VOWELS}v')"


@query(
    "normalize_numbered",
    f"""with pieces as (select distinct low from (select unnest(regexp_extract_all(lower(text), '[^\\s]+')) as low from conversations))
    select low as piece, {PLAIN} || coalesce(translate(list_extract(regexp_extract_all(low, '[{MARKED_VOWELS}]'), -1), '{MARKED_VOWELS}', '{MARK_TONES}'), '1') as numbered,
           regexp_replace(replace({PLAIN}, 'u:', 'v'), '[0-9]', '', 'g') as bare
    from pieces""",
)
def normalize_numbered(spark: SparkSession, sf: str) -> DataFrame:
    pieces = turns(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s]+"), F.lit(0))).alias("piece")).distinct()
    return pieces.select("piece", marks_to_number(F.col("piece")).alias("numbered"), strip_marks(F.col("piece")).alias("bare"))


def _sql_repairs(col: str) -> str:
    for pattern, to in SPELLING_REPAIRS:
        col = f"regexp_replace({col}, '{pattern}', '{to}', 'g')"
    return col


TYPED_SQL = "replace(replace(text, 'n ', 'n4 '), 'on', 'on2')"


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    typed = F.replace(F.replace("text", F.lit("n "), F.lit("n4 ")), F.lit("on"), F.lit("on2"))
    return turns(spark, sf).select("id", typed.alias("text"))


@query(
    "normalize_phonetic",
    f"""with {TURNS}, t as (select id, list_filter(regexp_extract_all({PLAIN}, '[a-z0-9]+'), lambda p: regexp_replace(p, '[^a-z]', '', 'g') <> '') as ps
      from (select id, lower({TYPED_SQL}) as low from turns)),
    p as (select id, unnest(ps) as piece, unnest(range(len(ps))) as token_no from t)
    select id, token_no, {_sql_repairs("regexp_replace(piece, '[^a-z]', '', 'g')")} as flat,
           array_to_string(regexp_extract_all(piece, '[a-z]+([1-5])', 1), ',') as tones from p""",
)
def normalize_phonetic(spark: SparkSession, sf: str) -> DataFrame:
    rows = ph.normalize_phonetic(_typed(spark, sf), "id", "text")
    return rows.select("id", "token_no", "flat", F.array_join(F.transform("tones", lambda t: t.cast("string")), ",").alias("tones"))


@query(
    "split_syllables",
    f"""with recursive {SQL_LEXICON}, {TURN_WORDS},
    inv as (select list(distinct w) as inv from bench_words),
    walk as (
      select w, 0 as j, [0] as cnts, [0] as starts from turn_words
      union all
      select w, j + 1, list_append(cnts, coalesce(best.c, 1000000)), list_append(starts, coalesce(best.i, 0)) from (
        select w, j, cnts, starts, list_min(list_filter(
          list_transform(range(greatest(0, j - 7), j + 1), lambda i: {{'c': list_extract(cnts, i + 1) + 1, 'i': cast(i as int)}}),
          lambda x: x.c < 1000000 and list_contains(inv, substring(w, x.i + 1, j + 1 - x.i)))) as best
        from walk, inv where j < length(w))),
    solved as (select w, cnts, starts from walk where j = length(w)),
    back as (
      select w, length(w) as loc, cast([] as varchar[]) as pieces, starts from solved where list_extract(cnts, length(w) + 1) < 1000000
      union all
      select w, cast(list_extract(starts, loc + 1) as bigint), list_prepend(substring(w, list_extract(starts, loc + 1) + 1, loc - list_extract(starts, loc + 1)), pieces), starts
      from back where loc > 0)
    select s.w as flat, array_to_string(b.pieces, '|') as syllables from solved s left join back b on b.w = s.w and b.loc = 0""",
)
def split_syllables(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.plans.views import benchmark_words

    inventory = benchmark_words(spark, sf).select(F.col("w").alias("syllable")).distinct()
    split = ph.split_syllables(turn_words(spark, sf).withColumnRenamed("w", "flat"), inventory)
    return split.select("flat", F.array_join("syllables", "|").alias("syllables"))


# Each turn's words, spelled out; odd turns type their tones.
def phonetic_queries(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns(spark, sf).select("id", "turn", F.explode(F.array_distinct(latin_words("text"))).alias("w"))
    reading = spelled(F.col("w"), F.lit(1))
    typed = F.when(F.col("turn") % 2 == 1, F.replace(reading, F.lit(" "), F.lit(""))).otherwise(
        F.regexp_replace(reading, "[0-9 ]", "")
    )
    return rows.select(F.concat("id", F.lit("/"), "w").alias("query_id"), typed.alias("text"))


@query("resolve_queries")
def resolve_queries(spark: SparkSession, sf: str) -> DataFrame:
    return ph.resolve_queries(phonetic_queries(spark, sf), lexicon(spark, sf))


@query(
    "complete_variant",
    f"""with {SQL_LEXICON}, {TURN_WORDS}, {SYL26},
    chars as (select w, unnest(string_split({sql_spelled('w', '0')}, ' ')) as s, unnest(range(length(w))) as i from turn_words),
    read as (select w, string_agg(a.marked, ' ' order by i) as marks, string_agg(b.marked, ' ' order by i) as pinyin, string_agg(b.bopomofo, ' ' order by i) as bopomofo
             from chars join syl26 a on a.numbered = s join syl26 b on b.numbered = regexp_replace(s, '5$', '1') group by 1)
    select {sql_han('w')} as traditional, case when length(w) % 2 = 0 then 'zh-HK' else 'zh-Hant' end as variety,
           case when length(w) % 3 = 0 then {sql_han('w')} else {sql_han('w', SIMPLIFIED)} end as simplified,
           case when length(w) % 2 = 0 then marks else pinyin end as pinyin, case when length(w) % 2 = 0 then '' else bopomofo end as bopomofo
    from read""",
)
def complete_variant(spark: SparkSession, sf: str) -> DataFrame:
    raw = turn_words(spark, sf).select(
        to_han(F.col("w")).alias("traditional"),
        F.when(F.length("w") % 3 == 0, "").otherwise(to_han(F.col("w"), SIMPLIFIED)).alias("simplified"),
        ph.phrase_marks(spelled(F.col("w"), F.lit(0))).alias("pinyin"),
        F.when(F.length("w") % 2 == 0, "zh-HK").otherwise("zh-Hant").alias("variety"),
    )
    return ph.complete_variant(raw)


@query(
    "validate_variant",
    f"""with {TURN_WORDS}
    select w, case when length(w) % 4 = 0 then 'zh-HK' else 'zh-Hant' end as variety,
           case when length(w) % 4 = 0 then true else {sql_bopomofo('w', '1')} <> '' and length(w) % 3 <> 1 end as valid from turn_words""",
)
def validate_variant(spark: SparkSession, sf: str) -> DataFrame:
    rows = turn_words(spark, sf).select(
        "w",
        to_han(F.substring("w", 1, 1)).alias("traditional"),
        F.when(F.length("w") % 3 == 1, F.concat("w", F.lit(" "), "w")).otherwise(F.col("w")).alias("pinyin"),
        F.when(F.length("w") % 4 == 0, "zh-HK").otherwise("zh-Hant").alias("variety"),
    )
    return ph.validate_variant(rows).select("w", "variety", "valid")


@query(
    "choose_formal",
    f"""with {TURNS}, p as (
      select id, case when role = 'system' then text else {sql_han('text')} end as casual,
             case when turn % 2 = 0 then text else {sql_han('text', SIMPLIFIED)} end as formal from turns)
    select id, casual, case when regexp_matches(formal, '\\p{{Han}}') then formal else casual end as formal from p where regexp_matches(casual, '\\p{{Han}}')""",
)
def choose_formal(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns(spark, sf).select(
        "id",
        F.when(F.col("role") == "system", F.col("text")).otherwise(to_han(F.col("text"))).alias("casual"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(to_han(F.col("text"), SIMPLIFIED)).alias("formal"),
    )
    return ph.choose_formal(rows)


@query(
    "alternatives_filter",
    f"""with ranked as (select conv_id, turn as position, length(text) % 4 = 0 as casual_low, length(text) % 5 = 0 as formal_low,
        row_number() over (partition by conv_id order by turn) as rank from conversations)
    select conv_id, position, rank from ranked where rank <= 3 and not casual_low and not formal_low""",
)
def alternatives_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns(spark, sf).select(
        "conv_id",
        F.col("turn").alias("position"),
        (F.length("text") % 4 == 0).alias("casual_low"),
        (F.length("text") % 5 == 0).alias("formal_low"),
    )
    return ph.alternatives_filter(rows, "conv_id").select("conv_id", "position", "rank")


@query(
    "structure_tokens",
    f"""with {TURNS}, g as (select id, regexp_extract_all(replace(replace(text, ', ', '⟪2⟫'), '. ', '⟪1.5⟫'), '⟪[0-9]+(?:[.][0-9]+)?⟫|[^⟪]') as ps from turns),
    p as (select id, unnest(ps) as piece, unnest(range(len(ps))) as token_no from g)
    select id, count(*) filter (piece not like '⟪%') as chars, count(*) filter (piece like '⟪%') as gaps,
           sum(case when piece like '⟪%' then cast(regexp_extract(piece, '([0-9.]+)', 1) as double) else 0 end) as widths,
           max(case when piece like '⟪%' then token_no - before end) as last_gap_at
    from (select *, count(*) filter (piece like '⟪%') over (partition by id order by token_no rows between unbounded preceding and 1 preceding) as before from p) group by 1""",
)
def structure_tokens_query(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.replace(F.replace("text", F.lit(", "), F.lit("⟪2⟫")), F.lit(". "), F.lit("⟪1.5⟫"))
    rows = structure_tokens(turns(spark, sf).select("id", marked.alias("text")), "id", "text")
    return rows.groupBy("id").agg(
        F.count("char").alias("chars"),
        F.count("gap").alias("gaps"),
        F.coalesce(F.sum("gap"), F.lit(0.0)).alias("widths"),
        F.max(F.when(F.col("gap").isNotNull(), F.col("chars_before"))).alias("last_gap_at"),
    )


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    length = F.length("w")
    return turn_words(spark, sf).select(
        to_han(F.col("w")).alias("traditional"),
        F.when(length % 4 == 0, "zh-HK").otherwise("zh-Hant").alias("variety"),
        F.when(length % 4 == 0, spelled(F.col("w"), F.lit(0))).otherwise("").alias("jyutping"),
        F.when(length % 4 == 0, "").when(length % 3 == 0, "ai4 bi1").otherwise(spelled(F.col("w"), F.lit(0))).alias("pinyin"),
        F.when(length % 5 == 0, F.col("w")).otherwise("").alias("bpmf"),
    )


@query(
    "entry_annotations",
    f"""with {TURN_WORDS}, st as (
      select {sql_han('w')} as traditional, length(w) as n, case when length(w) % 4 <> 0 and length(w) % 3 = 0 then 'ai4 bi1' else {sql_spelled('w', '0')} end as rom,
             case when length(w) % 5 = 0 and length(w) % 4 <> 0 then w else '' end as bpmf from turn_words)
    select traditional, case when len(string_split(rom, ' ')) = n
      then array_to_string(list_transform(range(n), lambda i: substring(traditional, i + 1, 1) || ':' || list_extract(string_split(rom, ' '), i + 1) || ':' || case when i = 0 then bpmf else '' end), '|')
      else traditional || ':' || rom || ':' || bpmf end as cells from st""",
)
def entry_annotations_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = entry_annotations(_stored(spark, sf))
    return rows.select("traditional", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c.h, c.py, c.bpmf)), "|").alias("cells"))
