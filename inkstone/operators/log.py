"""Saved words, history, search and users as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inkstone.functions.text import quoted, strip_marks, words_of
from inkstone.operators.common import first_per_key, top_per_key
from inkstone.operators.rules import keyword_tags

# Page sizes of the log views.
HISTORY_ROWS = 100
ENTRY_ROWS = 200
DUE_ROWS = 50
SAVE_KEY = ["user_id", "traditional", "pinyin", "variety"]
EXPORT_COLUMNS = ["created_at", "traditional", "simplified", "pinyin", "bopomofo", "english", "register", "source", "tags", "notes"]


def owner_join(entries: DataFrame, users: DataFrame, key: str = "user_id", name: str = "name") -> DataFrame:
    return entries.join(users.select(key, F.col(name).alias("user_name")), key)


def search_entries(
    entries: DataFrame, query: str, fields: list[str], user: object | None = None, n: int = ENTRY_ROWS, order: list[Column] | None = None
) -> DataFrame:
    """Every whitespace token of the query must be part of some field; newest first.

    Tokens are literal text: % and _ have no meaning. One scan, one top-n.
    """
    hits = entries if user is None else entries.filter(F.col("user_id") == user)
    for token in query.strip().lower().split():
        hits = hits.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(f), F.lit(token)) for f in fields]))
    return hits.orderBy(*(order or [F.col("created_at").desc(), F.col("id")])).limit(n)


def entries_latest(entries: DataFrame, users: DataFrame, n: int = ENTRY_ROWS) -> DataFrame:
    """Newest entries with their owners' names."""
    newest = entries.orderBy(F.col("created_at").desc(), F.col("id")).limit(n)
    return owner_join(newest, users)


def history_latest(asks: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """Newest asks of every user with a photo flag."""
    flagged = asks.withColumn("has_photo", F.col("photo_path").isNotNull())
    return top_per_key(flagged, ["user_id"], [F.col("created_at").desc(), F.col("id")], n)


def due_entries(entries: DataFrame, now: Column, n: int = DUE_ROWS, per_user: bool = True) -> DataFrame:
    """Entries never reviewed first, then those due, newest first."""
    due = entries.filter(F.col("srs_due").isNull() | (F.col("srs_due") <= now))
    order = [F.col("srs_due").isNull().desc(), F.col("created_at").desc(), F.col("id")]
    if per_user:
        return top_per_key(due, ["user_id"], order, n)
    return due.orderBy(*order).limit(n)


def latest_row_per_user(df: DataFrame, time: str = "created_at", key: str = "id") -> DataFrame:
    rest = [c for c in df.columns if c != "user_id"]
    return df.groupBy("user_id").agg(F.max_by(F.struct(*rest), F.struct(time, key)).alias("r")).select("user_id", "r.*")


def saved_badge(words: DataFrame, entries: DataFrame, on: list[str]) -> DataFrame:
    """``saved`` flag of words against the user's saved set."""
    mine = entries.select(*on, F.lit(True).alias("_saved")).distinct()
    return words.join(mine, on, "left").withColumn("saved", F.coalesce("_saved", F.lit(False))).drop("_saved")


def save_entries(entries: DataFrame, incoming: DataFrame, keys: list[str] = SAVE_KEY) -> DataFrame:
    """Incoming saves with a ``duplicate`` flag: against the table and within the batch.

    The earliest save of a key is the new one. New rows get their flat key and
    tags where those are blank.
    """
    old = entries.select(*keys, F.lit(True).alias("_old")).distinct()
    firsts = incoming.groupBy(*keys).agg(F.min(F.struct("created_at", "id")).alias("_first"))
    known = [F.col(f"i.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    rows = incoming.alias("i").join(firsts.alias("f"), known).select("i.*", "_first")
    stored = old.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    rows = rows.join(stored, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], "left").drop(*[f"_s_{k}" for k in keys])
    own = (F.col("_first.created_at") == F.col("created_at")) & (F.col("_first.id") == F.col("id"))
    rows = rows.withColumn("duplicate", F.coalesce("_old", F.lit(False)) | ~own).drop("_old", "_first")
    if "pinyin" in rows.columns:
        flat = F.regexp_replace(strip_marks(F.col("pinyin")), r"\s+", "")
        given = F.col("pinyin_flat") if "pinyin_flat" in rows.columns else F.lit("")
        rows = rows.withColumn("pinyin_flat", F.when(F.coalesce(given, F.lit("")) == "", flat).otherwise(given))
    if {"traditional", "english"} <= set(rows.columns) and "tags" not in rows.columns:
        rows = rows.withColumn("tags", keyword_tags(F.concat_ws(" ", "traditional", "english")))
    return rows


def entry_ask_link(entries: DataFrame, asks: DataFrame) -> DataFrame:
    """Photo context of each entry through its soft link; lost asks leave nulls."""
    photos = asks.select(F.col("id").alias("ask_id"), "user_id", "photo_path", F.col("created_at").alias("asked_at"))
    return entries.join(photos, ["ask_id", "user_id"], "left")


def provision_users(users: DataFrame, sightings: DataFrame) -> DataFrame:
    """New users from first sightings (ext_id, name, seen_at), with the defaults."""
    valid = sightings.filter(F.length("ext_id").between(1, 100))
    first = first_per_key(valid.select("ext_id", "name", "seen_at"), ["ext_id"], [F.col("seen_at"), F.col("name")])
    return first.join(users.select("ext_id").distinct(), "ext_id", "left_anti").select(
        F.sha2("ext_id", 256).substr(1, 32).alias("id"),
        "ext_id",
        "name",
        F.lit("both").alias("annotations"),
        F.lit(1.0).alias("tts_speed"),
        F.lit(None).cast("string").alias("audience"),
        F.lit(False).alias("onboarded"),
        F.array(F.lit("zh-Hant")).alias("varieties"),
        F.lit("zh-Hant").alias("primary_variety"),
        F.col("seen_at").alias("created_at"),
    )


def patch_rows(rows: DataFrame, patches: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Partial update: a field changes when the patch's ``<field>_set`` is true, even to null.

    Keys include the owner, so a patch of somebody else's row matches nothing.
    One patch per key: the last by ``patched_at``.
    """
    cells = [c for f in fields for c in (f, f"{f}_set")]
    last = patches.groupBy(*keys).agg(F.max_by(F.struct(*cells), "patched_at").alias("_p"))
    joined = rows.join(last, keys, "left")
    for f in fields:
        joined = joined.withColumn(f, F.when(F.col(f"_p.{f}_set"), F.col(f"_p.{f}")).otherwise(F.col(f)))
    if {"varieties", "primary_variety"} <= set(rows.columns):
        primary = F.when(F.array_contains("varieties", F.col("primary_variety")), F.col("primary_variety"))
        joined = joined.withColumn("primary_variety", F.coalesce(primary, F.get("varieties", F.lit(0))))
    return joined.drop("_p")


def delete_rows(rows: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not named by a delete request; keys include the owner."""
    return rows.join(requests.select(*keys).distinct(), keys, "left_anti")


# Fixed value: characters of an input that the history keeps.
INPUT_KEPT = 500


def append_history(asks: DataFrame, result: Column | None = None, input_kept: int = INPUT_KEPT) -> DataFrame:
    """History rows ready to append: input cut to ``input_kept``, result as JSON, photo fields defaulted.

    ``result`` is a struct; without it the rows have a JSON ``result`` of their own, or none.
    """
    have = set(asks.columns)

    def default(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name), value) if name in have else value

    return asks.select(
        "id",
        "user_id",
        "kind",
        F.substring("input", 1, input_kept).alias("input"),
        (default("result", F.lit(None).cast("string")) if result is None else F.to_json(result)).alias("result"),
        default("photo_path", F.lit(None).cast("string")).alias("photo_path"),
        default("photo_mime", F.lit(None).cast("string")).alias("photo_mime"),
        default("photo_w", F.lit(0)).alias("photo_w"),
        default("photo_h", F.lit(0)).alias("photo_h"),
        "created_at",
        F.to_date("created_at").alias("day"),
    )


def audio_worklist(requests: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """(key, text, speed, voice, requests, hit): one row per clip; misses are the work to do."""
    keyed = requests.withColumn("text", F.trim("text")).filter("text <> ''").withColumn(
        "key", F.substring(F.sha2(F.concat_ws("|", "text", "speed", "voice"), 256), 1, 40)
    )
    clips = keyed.groupBy("key").agg(
        F.first("text").alias("text"), F.first("speed").alias("speed"), F.first("voice").alias("voice"), F.count("*").alias("requests")
    )
    if cached is None:
        return clips.withColumn("hit", F.lit(False))
    have = cached.select("key", F.lit(True).alias("_hit")).distinct()
    return clips.join(have, "key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def hit_ratio(worklist: DataFrame) -> DataFrame:
    return worklist.agg(
        F.count("*").alias("clips"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.round(F.sum(F.when(F.col("hit"), F.col("requests")).otherwise(0)) / F.sum("requests"), 6).alias("hit_ratio"),
    )


def csv_lines(entries: DataFrame) -> DataFrame:
    """Export lines: every cell quoted, tags joined by spaces, nulls empty."""
    cells = [F.array_join("tags", " ") if c == "tags" else F.col(c) for c in EXPORT_COLUMNS]
    return entries.select("id", "created_at", F.concat_ws(",", *[quoted(c) for c in cells]).alias("line"))
