"""Learning-log operators over events, conversations, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkstone.operators import log, reviews as rv, rules
from inkstone.plans.registry import query
from inkstone.plans.text_queries import TURNS, turns
from inkstone.plans.views import SQL_REPLAY, SQL_WORDS, each_word, latin_words, reviews, sql_han, table, to_han

NOW = "2024-01-20 00:00:00"


@query("srs_replay", f"with recursive {SQL_REPLAY} select entry_id, box, due, streak, review_count from replayed")
def srs_replay(spark: SparkSession, sf: str) -> DataFrame:
    return rv.replay_reviews(reviews(spark, sf))


# One card per user and kind of event: more and shorter histories.
@query(
    "srs_replay_cards",
    "with recursive "
    + SQL_REPLAY.replace("user_id as entry_id", "user_id * 10 + ascii(props[-2:-2]) % 10 as entry_id").replace(
        "partition by user_id", "partition by user_id * 10 + ascii(props[-2:-2]) % 10"
    )
    + " select entry_id, box, due, streak, review_count from replayed",
)
def srs_replay_cards(spark: SparkSession, sf: str) -> DataFrame:
    props = table(spark, sf, "events").select("event_id", (F.ascii(F.substring("props", -2, 1)) % 10).alias("d"))
    rows = reviews(spark, sf).join(props, "event_id").withColumn("entry_id", F.col("entry_id") * 10 + F.col("d"))
    return rv.replay_reviews(rows.drop("d"))


@query(
    "srs_due",
    f"""with recursive {SQL_REPLAY},
    cards as (select user_id, min(ts) as created_at, user_id as id from events group by 1),
    due as (select id, c.user_id % 10 as user_id, created_at, case when box = 0 then null else due end as srs_due from cards c join replayed on entry_id = c.user_id)
    select user_id, id, created_at, srs_due, rank from (
      select *, row_number() over (partition by user_id order by (srs_due is null) desc, created_at desc, id) as rank
      from due where srs_due is null or srs_due <= timestamp '{NOW}') where rank <= 50""",
)
def srs_due(spark: SparkSession, sf: str) -> DataFrame:
    state = rv.replay_reviews(reviews(spark, sf))
    cards = table(spark, sf, "events").groupBy(F.col("user_id").alias("entry_id")).agg(F.min(F.col("ts").cast("timestamp")).alias("created_at"))
    rows = state.join(cards, "entry_id").select(
        F.col("entry_id").alias("id"),
        (F.col("entry_id") % 10).alias("user_id"),
        "created_at",
        F.when(F.col("box") > 0, F.col("due")).alias("srs_due"),
    )
    return log.due_entries(rows, F.lit(NOW).cast("timestamp")).select("user_id", "id", "created_at", "srs_due", "rank")


@query(
    "entry_search",
    """select doc_id as id, lang, source, created_at from (select *, n_chars as created_at from documents)
    where (contains(lower(text), 'the') or contains(lower(lang), 'the') or contains(lower(source), 'the'))
      and (contains(lower(text), 'src1') or contains(lower(lang), 'src1') or contains(lower(source), 'src1'))
    order by created_at desc, doc_id limit 200""",
)
def entry_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnsRenamed({"doc_id": "id", "n_chars": "created_at"})
    return log.search_entries(docs, " The  SRC1 ", ["text", "lang", "source"]).select("id", "lang", "source", "created_at")


@query(
    "owner_latest",
    """select o_orderkey as id, o_custkey as user_id, o_orderdate as created_at, c_name as user_name
    from (select * from orders order by o_orderdate desc, o_orderkey limit 200) join customer on c_custkey = o_custkey""",
)
def owner_latest(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at")
    )
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return log.entries_latest(entries, users)


@query(
    "owner_join",
    """select o_orderkey as id, c_name as user_name from orders join customer on c_custkey = o_custkey""",
)
def owner_join(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return log.owner_join(entries, users).select("id", "user_name")


@query(
    "history_top_n",
    """select user_id, event_id as id, ts as created_at, has_photo, rank from (
      select *, event_type = 'view' as has_photo, row_number() over (partition by user_id order by ts desc, event_id) as rank from events) where rank <= 100""",
)
def history_top_n(spark: SparkSession, sf: str) -> DataFrame:
    asks = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), F.when(F.col("event_type") == "view", F.col("props")).alias("photo_path")
    )
    return log.history_latest(asks).select("user_id", "id", "created_at", "has_photo", "rank")


@query(
    "latest_row_per_user",
    "select user_id, arg_max(event_id, (ts, event_id)) as id, max(ts) as created_at, arg_max(event_type, (ts, event_id)) as kind from events group by 1",
)
def latest_row_per_user(spark: SparkSession, sf: str) -> DataFrame:
    asks = table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("kind"))
    return log.latest_row_per_user(asks)


@query(
    "history_age",
    f"""select event_id, case when s < 60 then 'just now' when s < 3600 then cast(s // 60 as varchar) || 'm ago'
        when s < 86400 then cast(s // 3600 as varchar) || 'h ago' else strftime(ts, '%Y-%m-%d') end as age
    from (select event_id, ts, greatest(0, cast(floor(epoch(timestamp '{NOW}')) - floor(epoch(ts)) as bigint)) as s from events)""",
)
def history_age(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.functions.text import age_label

    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", age_label(ts, F.lit(NOW).cast("timestamp")).alias("age"))


# Saves: events keyed by user, kind and payload; the first twenty days are already stored.
SAVES = """saves as (
  select event_id as id, user_id, event_type as traditional, props as pinyin, 'zh-Hant' as variety, ts as created_at from events)"""


def _saves(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("traditional"),
        F.col("props").alias("pinyin"),
        F.lit("zh-Hant").alias("variety"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


@query(
    "save_dedupe",
    f"""with {SAVES}, old as (select distinct user_id, traditional, pinyin, variety from saves where created_at < timestamp '{NOW}'),
    ranked as (select *, row_number() over (partition by user_id, traditional, pinyin, variety order by created_at, id) as r from saves where created_at >= timestamp '{NOW}')
    select r.id, r.user_id, r.traditional, (o.user_id is not null or r > 1) as duplicate, regexp_replace(lower(r.pinyin), '[0-9\\s]', '', 'g') as pinyin_flat
    from ranked r left join old o using (user_id, traditional, pinyin, variety)""",
)
def save_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    saves = _saves(spark, sf)
    stored, incoming = saves.filter(F.col("created_at") < NOW), saves.filter(F.col("created_at") >= NOW)
    return log.save_entries(stored, incoming).select("id", "user_id", "traditional", "duplicate", "pinyin_flat")


@query(
    "saved_badge",
    f"""with {SAVES}, mine as (select distinct user_id, traditional from saves where traditional = 'purchase')
    select s.id, s.user_id, s.traditional, m.user_id is not null as saved from saves s left join mine m using (user_id, traditional)""",
)
def saved_badge(spark: SparkSession, sf: str) -> DataFrame:
    saves = _saves(spark, sf)
    mine = saves.filter("traditional = 'purchase'")
    return log.saved_badge(saves.select("id", "user_id", "traditional"), mine, ["user_id", "traditional"])


@query(
    "entry_ask_link",
    """select c.conv_id, c.turn, a.ts as asked_at, a.props as photo_path from conversations c left join events a on a.event_id = c.conv_id * 7 + c.turn and a.user_id = c.conv_id % 150""",
)
def entry_ask_link(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 7 + F.col("turn")).alias("ask_id"), (F.col("conv_id") % 150).alias("user_id")
    )
    asks = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", F.col("props").alias("photo_path"), F.col("ts").alias("created_at"))
    return log.entry_ask_link(entries, asks).select("conv_id", "turn", "asked_at", "photo_path")


@query(
    "provision_users",
    """with seen as (select cast(user_id as varchar) as ext_id, event_type as name, ts as seen_at from events),
    known as (select distinct cast(c_custkey * 3 as varchar) as ext_id from customer)
    select sha256(ext_id)[1:32] as id, ext_id, arg_min(name, (seen_at, name)) as name, min(seen_at) as created_at, 'zh-Hant' as primary_variety, false as onboarded
    from seen where ext_id not in (select ext_id from known) group by ext_id""",
)
def provision_users(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("ext_id"), F.col("event_type").alias("name"), F.col("ts").alias("seen_at"))
    known = table(spark, sf, "customer").select((F.col("c_custkey") * 3).cast("string").alias("ext_id"))
    return log.provision_users(known, seen).select("id", "ext_id", "name", "created_at", "primary_variety", "onboarded")


# Patches: later turns of a conversation change its first one; odd ones blank the note.
@query(
    "patch_rows",
    """with rows as (select conv_id as id, role as english, text as notes from conversations where turn = 0),
    patches as (select conv_id as id, turn, role, text from conversations where turn > 0),
    last as (select id, arg_max(role, turn) as e, max(turn) as t, arg_max(text, turn) as n from patches group by 1)
    select r.id, coalesce(l.e, r.english) as english, case when l.t is null then r.notes when l.t % 2 = 1 then null when l.t % 4 = 0 then r.notes else l.n end as notes
    from rows r left join last l using (id)""",
)
def patch_rows(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    rows = conv.filter("turn = 0").select(F.col("conv_id").alias("id"), F.col("role").alias("english"), F.col("text").alias("notes"))
    patches = conv.filter("turn > 0").select(
        F.col("conv_id").alias("id"),
        F.col("turn").alias("patched_at"),
        F.col("role").alias("english"),
        F.lit(True).alias("english_set"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).alias("notes"),
        (F.col("turn") % 4 != 0).alias("notes_set"),
    )
    return log.patch_rows(rows, patches, ["english", "notes"], ["id"]).select("id", "english", "notes")


@query(
    "delete_rows",
    """select event_id, user_id from events e where not exists (
      select 1 from orders o where o.o_orderkey = e.event_id and o.o_custkey % 150 = e.user_id % 150 and o_orderstatus = 'F')""",
)
def delete_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", (F.col("user_id") % 150).alias("owner"))
    requests = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 150).alias("owner")
    )
    return log.delete_rows(rows, requests, ["event_id", "owner"]).select("event_id", "user_id")


@query(
    "append_history",
    """select concat_ws('-', conv_id, turn) as id, substring(text, 1, 500) as input, '{"turn":' || cast(turn as varchar) || ',"role":"' || role || '"}' as result,
       cast(null as varchar) as photo_path, 0 as photo_w, cast(timestamp '2024-01-01 00:00:00' + to_days(cast(conv_id % 20 as int)) as date) as day from conversations""",
)
def append_history(spark: SparkSession, sf: str) -> DataFrame:
    asks = turns(spark, sf).select(
        "id",
        F.col("conv_id").alias("user_id"),
        F.lit("hanzi").alias("kind"),
        F.col("text").alias("input"),
        "turn",
        "role",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval((F.col("conv_id") % 20).cast("int"))).alias("created_at"),
    )
    kept = log.append_history(asks, F.struct("turn", "role"))
    return kept.select("id", "input", "result", "photo_path", "photo_w", "day")


CLIPS = f"""clips as (
  select trim(w) as text, case when length(w) % 2 = 0 then '1' else '0.75' end as speed, case when length(w) % 3 = 0 then 'zh-HK' else 'zh-Hant' end as voice
  from (select unnest({SQL_WORDS}) as w from conversations)),
keyed as (select sha256(concat_ws('|', text, speed, voice))[1:40] as key, text, speed, voice, count(*) as requests from clips group by all),
cached as (select distinct sha256(concat_ws('|', w, '1', 'zh-Hant'))[1:40] as key from (select unnest({SQL_WORDS}) as w from benchmark)),
work as (select keyed.*, c.key is not null as hit from keyed left join cached c using (key))"""


def _worklist(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("w")
    requests = each_word(turns(spark, sf)).select(
        F.col("w").alias("text"), F.when(n % 2 == 0, "1").otherwise("0.75").alias("speed"), F.when(n % 3 == 0, "zh-HK").otherwise("zh-Hant").alias("voice")
    )
    cached = table(spark, sf, "benchmark").select(F.explode(latin_words("text")).alias("w")).select(
        F.substring(F.sha2(F.concat_ws("|", "w", F.lit("1"), F.lit("zh-Hant")), 256), 1, 40).alias("key")
    )
    return log.audio_worklist(requests, cached)


@query("audio_worklist", f"with {CLIPS} select key, text, speed, voice, requests, hit from work")
def audio_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return _worklist(spark, sf)


@query(
    "audio_hit_ratio",
    f"""with {CLIPS} select count(*) as clips, count(*) filter (not hit) as misses, round(sum(case when hit then requests else 0 end) / sum(requests), 6) as hit_ratio from work""",
)
def audio_hit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return log.hit_ratio(_worklist(spark, sf))


@query(
    "csv_rows",
    """with c as (select concat_ws('-', conv_id, turn) as id, cast(conv_id as varchar) as created_at, text, role, case when turn % 2 = 0 then null else text end as notes from conversations)
    select id, '"' || created_at || '","' || replace(text, '"', '""') || '","","","","' || role || '","casual","manual","' || case when role = 'user' then 'food talk' else '' end
        || '","' || replace(coalesce(notes, ''), '"', '""') || '"' as line from c""",
)
def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.lit("")
    rows = turns(spark, sf).select(
        "id",
        F.col("conv_id").cast("string").alias("created_at"),
        F.col("text").alias("traditional"),
        blank.alias("simplified"),
        blank.alias("pinyin"),
        blank.alias("bopomofo"),
        F.col("role").alias("english"),
        F.lit("casual").alias("register"),
        F.lit("manual").alias("source"),
        F.when(F.col("role") == "user", F.array(F.lit("food"), F.lit("talk"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(F.col("turn") % 2 != 0, F.col("text")).alias("notes"),
    )
    return log.csv_lines(rows).select("id", "line")


# ---- rules --------------------------------------------------------------

MIXED = f"""mixed as (
  select concat_ws('-', conv_id, turn) as id, conv_id, turn, role,
         case when conv_id % 3 = 0 then {sql_han('text')} when conv_id % 3 = 1 and turn % 2 = 0 then text || ' the end' else text end as text from conversations)"""
HINT = rf"\b({rules.ENGLISH_HINTS})\b".replace("'", "''")


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns, a third of the conversations in Han, some with English added."""
    text = (
        F.when(F.col("conv_id") % 3 == 0, to_han(F.col("text")))
        .when((F.col("conv_id") % 3 == 1) & (F.col("turn") % 2 == 0), F.concat("text", F.lit(" the end")))
        .otherwise(F.col("text"))
    )
    return turns(spark, sf).withColumn("text", text)


@query(
    "route_text",
    f"""with {MIXED}, m as (select *, regexp_matches(text, '\\p{{Han}}') as han, regexp_matches(text, '[A-Za-z]{{2,}}') as latin,
       regexp_matches(text, '(?i){HINT}') as hint from mixed)
    select id, case when han and not latin then 'hanzi' when not han and hint then 'translate' when role = 'user' then 'pinyin' else 'translate' end as route from m""",
)
def route_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixed(spark, sf)
    return rules.route_text(rows, rows.filter("role = 'user'").select("id")).select("id", "route")


@query(
    "route_transcript",
    f"with {MIXED} select id, case when regexp_matches(text, '\\p{{Han}}') then 'hanzi' when turn % 3 = 0 then 'translate' else 'text' end as route from mixed",
)
def route_transcript(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixed(spark, sf)
    return rules.route_transcript(rows, rows.filter("turn % 3 = 0").select("id")).select("id", "route")


@query(
    "question_language",
    f"""with {MIXED}, m as (select id, len(regexp_extract_all(text, '\\p{{Han}}')) as han, len(regexp_extract_all(text, '[A-Za-z]')) as latin from mixed)
    select id, han, han > 0 and han >= latin as chinese from m""",
)
def question_language(spark: SparkSession, sf: str) -> DataFrame:
    from inkstone.functions.text import count_han

    text = F.col("text")
    return mixed(spark, sf).select("id", count_han(text).alias("han"), rules.question_is_chinese(text).alias("chinese"))


@query(
    "text_guards",
    """with chars as (select doc_id, unnest(string_split(text, '')) as c, unnest(range(length(text))) as i from documents),
    islands as (select doc_id, c, i - row_number() over (partition by doc_id, c order by i) as g from chars where c not in (chr(10), chr(13))),
    loops as (select distinct doc_id from (select doc_id from islands group by doc_id, c, g having count(*) >= 5))
    select doc_id, regexp_matches(lower(text), 'english|英文|怎麼說|怎麼講|什麼意思|甚麼意思|意思是|怎麼寫') as meta_question,
           doc_id in (select doc_id from loops) as degenerate
    from documents""",
)
def text_guards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", rules.is_meta_question(F.col("text")).alias("meta_question"), rules.degenerate_read(F.col("text")).alias("degenerate")
    )


@query(
    "echo_guard",
    f"""with {MIXED}, r as (select id, case when turn = 2 then ' None. ' when turn = 1 then '"' || text || '"' else text end as response from mixed),
    f as (select id, regexp_replace(trim(response), '^["''「」]+|["''「」]+$', '', 'g') as full_text from r),
    g as (select id, full_text, len(regexp_extract_all(full_text, '\\p{{Han}}')) as han, regexp_full_match(full_text, '(?i)none\\.?') as nothing from f)
    select id, case when full_text = '' then 'empty translation' when han > 0 and han / greatest(length(full_text), 1) > 0.5 and not nothing then 'echo (not a translation)' end as error,
           case when full_text = '' or (han > 0 and han / greatest(length(full_text), 1) > 0.5 and not nothing) then null when nothing then '' else full_text end as value from g""",
)
def echo_guard(spark: SparkSession, sf: str) -> DataFrame:
    response = F.when(F.col("turn") == 2, " None. ").when(F.col("turn") == 1, F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.col("text"))
    return rules.echo_guard(mixed(spark, sf).select("id", response.alias("response"))).select("id", "error", "value")


TAGGED = """raw as (
  select concat_ws('-', conv_id, turn) as id, list_transform(regexp_extract_all(text, '[^ ]+'), lambda t: case when length(t) % 3 = 0 then ' Topic: ' || t else t end) as raw from conversations)"""


@query(
    "tags_clean",
    f"""with {TAGGED}, p as (select id, unnest(list_transform(raw, lambda t: regexp_replace(lower(trim(t)), '^(topic|situation|function|people|things|related):\\s*', ''))) as t,
       unnest(range(len(raw))) as i from raw),
    d as (select id, t, min(i) as i from p where regexp_full_match(t, '[a-z][a-z -]{{1,24}}') group by 1, 2),
    r as (select *, row_number() over (partition by id order by i) as k from d)
    select raw.id, coalesce(string_agg(t, ' ' order by i), '') as tags from raw left join r on r.id = raw.id and k <= 12 group by 1""",
)
def tags_clean(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.transform(
        F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)),
        lambda t: F.when(F.length(t) % 3 == 0, F.concat(F.lit(" Topic: "), t)).otherwise(t),
    )
    return turns(spark, sf).select("id", F.array_join(rules.clean_tags(raw), " ").alias("tags"))


def sql_keyword_tags(text: str) -> str:
    parts = [f"case when regexp_matches(lower({text}), '{p}') then '{' '.join(t)}' end" for p, t in rules.KEYWORD_RULES]
    return f"coalesce(nullif(concat_ws(' ', {', '.join(parts)}), ''), '{rules.DEFAULT_TAG}')"


@query("keyword_tags", f"select doc_id, {sql_keyword_tags('text')} as tags from documents")
def keyword_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(rules.keyword_tags(F.col("text")), " ").alias("tags"))


RETAG = f"""entries as (
  select doc_id as id, lang as traditional, text as english, case when doc_id % 3 = 0 then 'old' else '' end as tags from documents)"""


def _retag(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("traditional"),
        F.col("text").alias("english"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("old"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    return rules.retag(rows, force=False)


@query(
    "retag",
    f"with {RETAG} select id, case when tags <> '' then 'skipped' else 'ok' end as outcome, case when tags <> '' then tags else {sql_keyword_tags(chr(34) + 'traditional' + chr(34) + chr(124) * 2 + chr(39) + ' ' + chr(39) + chr(124) * 2 + 'english')} end as tags from entries",
)
def retag(spark: SparkSession, sf: str) -> DataFrame:
    return _retag(spark, sf).select("id", "outcome", F.array_join("tags", " ").alias("tags"))


@query(
    "retag_summary",
    f"with {RETAG} select count(*) filter (tags = '') as ok, 0 as failed, count(*) filter (tags <> '') as skipped, count(*) as total from entries",
)
def retag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rules.retag_summary(_retag(spark, sf))


# Answers: an event's payload as the model would wrap it - fenced, in prose, bare, or cut off.
@query(
    "loose_json",
    """select event_id, case when event_id % 4 = 3 then null else cast(json_extract_string(props, '$.k') as bigint) end as k from events""",
)
def loose_json(spark: SparkSession, sf: str) -> DataFrame:
    p, k = F.col("props"), F.col("event_id") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("Sure: "), p, F.lit(" - hope {this} helps")))
        .when(k == 2, p)
        .otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    )
    rows = table(spark, sf, "events").select("event_id", answer.alias("answer"))
    return rules.parse_loose_json(rows, "answer", "struct<k:bigint>").select("event_id", "parsed.k")


# Answers whose object holds objects, lists, quotes and brackets in strings, with prose and a second object behind it.
@query(
    "balanced_json",
    """select event_id, case when event_id % 5 = 4 then null else cast(json_extract_string(props, '$.k') as bigint) end as k,
              case when event_id % 5 = 4 then null when event_id % 5 = 3 then 2 else 1 end as depth from events""",
)
def balanced_json(spark: SparkSession, sf: str) -> DataFrame:
    p, k = F.col("props"), F.col("event_id") % 5
    deep = F.concat(F.lit('{"in": {"depth": 1, "said": "a \\" and } in \\\\", "list": [[1], {"x": []}]}, "k": '), F.regexp_extract(p, "[0-9]+", 0), F.lit("}"))
    answer = (
        F.when(k == 0, F.concat(F.lit("no quote: "), deep))
        .when(k == 1, F.concat(F.lit("```json\n"), deep, F.lit('\n``` and {"in": {"depth": 9}, "k": 0}')))
        .when(k == 2, F.concat(F.lit("So: "), deep, F.lit(' then } or "{" ]')))
        .when(k == 3, F.concat(F.replace(deep, F.lit('"depth": 1'), F.lit('"depth": 2')), F.lit("{")))
        .otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    )
    rows = table(spark, sf, "events").select("event_id", answer.alias("answer"))
    out = rules.parse_loose_json(rows, "answer", "struct<k:bigint,in:struct<depth:int>>")
    return out.select("event_id", "parsed.k", F.col("parsed.in.depth").alias("depth"))


@query(
    "json_salvage",
    """with lists as (select event_id, '[' || props || ', {"k": ' || cast(event_id as varchar) || '}, {"k": 1' as raw from events),
    o as (select event_id, unnest(regexp_extract_all(raw, '\\{[^{}]*\\}')) as object, unnest(range(len(regexp_extract_all(raw, '\\{[^{}]*\\}')))) as item_no from lists)
    select event_id, item_no, cast(json_extract_string(object, '$.k') as bigint) as k from o where json_valid(object)""",
)
def json_salvage(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("["), "props", F.lit(', {"k": '), F.col("event_id").cast("string"), F.lit('}, {"k": 1'))
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rules.salvage_items(rows, "event_id", "raw", "struct<k:bigint>").select("event_id", "item_no", "item.k")


@query(
    "bracket_list",
    """select concat_ws('-', conv_id, turn) as id, array_to_string(list_transform(string_split(regexp_extract('[' || replace(text, ']', '') || ']', '(?s)\\[(.*?)\\]', 1), ','), lambda s: regexp_replace(trim(s), '^["'']+|["'']+$', '', 'g')), '|') as items from conversations""",
)
def bracket_list(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("["), F.replace("text", F.lit("]"), F.lit("")), F.lit("]"))
    return turns(spark, sf).select("id", F.array_join(rules.bracket_list(raw), "|").alias("items"))


@query(
    "validate_permutation",
    """select conv_id, n, turns_seen = list_transform(range(cast(n as bigint)), lambda i: i + 1) as valid from (
      select conv_id, count(*) as n, list_sort(list(case when conv_id % 4 = 1 then least(turn + 1, 2) else turn + 1 end)) as turns_seen from conversations group by 1)""",
)
def validate_permutation(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("conv_id") % 4 == 1, F.least(F.col("turn") + 1, F.lit(2))).otherwise(F.col("turn") + 1)
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.collect_list(answer.cast("bigint")).alias("order"))
    return rows.select("conv_id", "n", rules.validate_permutation(F.col("order"), F.col("n")).alias("valid"))


@query(
    "validate_payload",
    """with r as (select event_id, user_id, case event_type when 'error' then 'again' when 'view' then 'good' else event_type end as outcome, cast(floor(value / 10) as int) as srs_box,
         repeat('x', cast(event_id % 230 as int)) as traditional from events)
    select event_id, 'outcome: enum' as rule from r where outcome not in ('again', 'hard', 'good', 'easy')
    union all select event_id, 'srs_box: range' from r where not (srs_box between 0 and 5)
    union all select event_id, 'traditional: length' from r where not (length(traditional) between 1 and 200)""",
)
def validate_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "again").when(F.col("event_type") == "view", "good").otherwise(F.col("event_type")).alias("outcome"),
        F.floor(F.col("value") / 10).cast("int").alias("srs_box"),
        F.expr("repeat('x', cast(event_id % 230 as int))").alias("traditional"),
    )
    return rules.validate_payload(rows, "event_id")
