"""Routing, cleaning and validation rules over text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from inkstone.functions.text import HAN, count_han, has_han, words_of

# English words that never occur as phonetic input.
ENGLISH_HINTS = (
    "the|to|is|are|am|was|be|been|for|of|on|in|at|it|its|this|that|these|those|and|or|but|not|don'?t|doesn'?t|"
    "can|will|would|should|could|please|thanks?|hello|hi|goodbye|want|needs?|likes?|time|eat|sleep|school|bath|"
    "water|milk|home|now|here|there|what|where|why|how|who|when|let'?s"
)
# ASCII word edges, whatever the regex engine takes for a word character
ENGLISH_HINT = rf"(?i)(?<![A-Za-z0-9_])({ENGLISH_HINTS})(?![A-Za-z0-9_])"
# Patterns of questions about words, of tag labels and of tags.
META_QUESTION = "(?i)(英文|english|怎麼說|怎麼講|什麼意思|甚麼意思|意思是|怎麼寫)"
TAG_LABEL = r"^(topic|situation|function|people|things|related):\s*"
TAG_SHAPE = "^[a-z][a-z -]{1,24}$"
TAGS_KEPT = 12

# The keyword tagger's rules, tags in order per rule.
KEYWORD_RULES = [
    ("飛機|飞机|airplane|plane|airport|航班", ["airport", "travel", "vehicles"]),
    ("睡|sleep|bed", ["bedtime"]),
    ("吃|飯|饭|food|eat", ["food"]),
    ("謝|谢|thank|hello|你好", ["greetings", "manners"]),
]
DEFAULT_TAG = "family"

# Contract enums and ranges.
ENUMS = {
    "annotations": ["both", "bpmf", "pinyin"],
    "variety": ["zh-Hant", "zh-HK"],
    "register": ["casual", "formal"],
    "source": ["en-translate", "pinyin", "hanzi", "stt", "ocr", "manual"],
    "outcome": ["again", "hard", "good", "easy"],
    "kind": ["translate", "pinyin", "hanzi", "ocr", "stt"],
}
LENGTHS = {
    "traditional": (1, 200),
    "example_zh": (0, 500),
    "example_en": (0, 500),
    "notes": (0, 2000),
    "translate_text": (1, 300),
    "query_text": (1, 200),
    "audience": (0, 120),
}
RANGES = {"srs_box": (0, 5)}


def route_text(df: DataFrame, resolvable: DataFrame | None = None, key: str = "id", column: str = "text") -> DataFrame:
    """``route`` = hanzi, pinyin or translate.

    ``resolvable`` holds the keys whose text the phonetic resolver could read;
    the leg it decides is a semi-join, not a call per row.
    """
    text = F.trim(column)
    han, latin = has_han(text), text.rlike("[A-Za-z]{2,}")
    if resolvable is None:
        read = F.lit(False)
    else:
        df = df.join(resolvable.select(key, F.lit(True).alias("_read")).distinct(), key, "left")
        read = F.coalesce("_read", F.lit(False))
    route = (
        F.when(han & ~latin, "hanzi")
        .when(~han & text.rlike(ENGLISH_HINT), "translate")
        .when(read, "pinyin")
        .otherwise("translate")
    )
    return df.withColumn("route", route).drop("_read")


def route_transcript(df: DataFrame, translated: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """Any Han goes to the word cards, else to the translation that came back, else plain text."""
    got = translated.select(key, F.lit(True).alias("_got")).distinct()
    return (
        df.join(got, key, "left")
        .withColumn("route", F.when(has_han(F.col(column)), "hanzi").when(F.col("_got"), "translate").otherwise("text"))
        .drop("_got")
    )


def question_is_chinese(col: Column) -> Column:
    han = count_han(col)
    return (han > 0) & (han >= F.regexp_count(col, F.lit("[A-Za-z]")))


def is_meta_question(col: Column) -> Column:
    return col.rlike(META_QUESTION)


def degenerate_read(col: Column) -> Column:
    """One character five times in a row: a decoding loop, not text."""
    return col.rlike(r"(.)\1{4,}")


def echo_guard(df: DataFrame, column: str = "response") -> DataFrame:
    """``value`` and ``error`` of a translation answer: quotes off, NONE to empty, Han majority refused."""
    full = F.regexp_replace(F.trim(column), "^[\"'「」]+|[\"'」]+$", "")
    han = count_han(full)
    echo = (han > 0) & (han / F.greatest(F.length(full), F.lit(1)) > 0.5)
    error = F.when(full == "", "empty translation").when(echo & ~full.rlike(r"(?i)^none\.?$"), "echo (not a translation)")
    value = F.when(full.rlike(r"(?i)^none\.?$"), "").otherwise(full)
    return df.withColumn("error", error).withColumn("value", F.when(error.isNull(), value))


def _strip_fences(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "(?i)```(?:json)?", ""), "```", "")


def first_structure(col: Column) -> Column:
    """The first balanced object or array of a text, brackets within strings apart; null if none is complete.

    A backslash takes the next character's meaning away, in and outside of strings. Escapes and the insides of strings are
    blanked in place. The text is cut behind every closing bracket, and a running sum of what each piece opens
    and closes tells where the first bracket is closed again.
    """
    body = F.regexp_extract(col, r"(?s)[{\[].*", 0)
    # the same length, character by character, so that places stay what they are
    plain = F.regexp_replace(body, r"(?s)\\.", "__")
    outside = F.transform(F.split(plain, '"', -1), lambda piece, i: F.when(i % 2 == 0, piece).otherwise(F.repeat(F.lit("_"), F.length(piece))))
    pieces = F.split(F.array_join(outside, "_"), r"(?<=[}\]])", -1)
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("place"), F.lit(False).alias("closed"))

    def pass_piece(s: Column, piece: Column) -> Column:
        closes = piece.rlike(r"[}\]]$").cast("int")
        still = s.open + F.length(piece) - F.length(F.translate(piece, "{[", "")) - closes
        here = F.struct(still.alias("open"), (s.place + F.length(piece)).alias("place"), ((closes == 1) & (still == 0)).alias("closed"))
        return F.when(s.closed, s).otherwise(here)

    end = F.aggregate(pieces, start, pass_piece, lambda s: F.when(s.closed, s.place))
    return F.when(body != "", F.substring(body, F.lit(1), end))


def parse_loose_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``parsed``: the first balanced object or array in a fenced or prose-wrapped answer, null when it is no JSON or there is none."""
    structure = first_structure(_strip_fences(F.col(column)))
    parsed = F.when(F.try_parse_json(structure).isNotNull(), F.from_json(structure, schema, {"mode": "PERMISSIVE"}))
    return df.withColumn("parsed", parsed)


def bracket_list(col: Column) -> Column:
    """Items of the first unquoted [a, b] list."""
    inner = F.regexp_extract(col, r"(?s)\[(.*?)\]", 1)
    return F.transform(F.split(inner, ","), lambda s: F.regexp_replace(F.trim(s), "^[\"']+|[\"']+$", ""))


def salvage_items(df: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """One row per complete {…} object of a possibly truncated list."""
    objects = F.regexp_extract_all(column, F.lit(r"\{[^{}]*\}"), F.lit(0))
    rows = df.select(key, F.posexplode(objects).alias("item_no", "object"))
    return rows.filter(F.try_parse_json("object").isNotNull()).select(
        key, "item_no", "object", F.from_json("object", schema).alias("item")
    )


def clean_tags(raw: Column) -> Column:
    """Labels off, lower case, shape checked, distinct, at most twelve."""
    plain = F.transform(raw, lambda t: F.regexp_replace(F.lower(F.trim(t)), TAG_LABEL, ""))
    return F.slice(F.array_distinct(F.filter(plain, lambda t: t.rlike(TAG_SHAPE))), 1, TAGS_KEPT)


def keyword_tags(text: Column) -> Column:
    """Tags of every matching rule in rule order, or the default tag."""
    low = F.lower(text)
    hits = F.concat(
        *[
            F.when(low.rlike(pattern), F.array(*[F.lit(t) for t in tags])).otherwise(F.array().cast("array<string>"))
            for pattern, tags in KEYWORD_RULES
        ]
    )
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(DEFAULT_TAG)))


def retag(entries: DataFrame, tags: DataFrame | None = None, force: bool = True) -> DataFrame:
    """Entries (id, traditional, english, tags) with new tags and what happened to each.

    ``tags`` holds the tagger's answers (id, raw array); without it the keyword
    rules answer. Unforced, only rows without tags are touched.
    """
    if tags is None:
        answered = entries.withColumn("_new", keyword_tags(F.concat_ws(" ", "traditional", "english")))
    else:
        answered = entries.join(tags.select("id", clean_tags(F.col("raw")).alias("_new")), "id", "left")
    has = F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0
    outcome = (
        F.when(F.lit(not force) & has, "skipped").when(F.size(F.coalesce("_new", F.array().cast("array<string>"))) > 0, "ok").otherwise("failed")
    )
    return (
        answered.withColumn("outcome", outcome)
        .withColumn("tags", F.when(F.col("outcome") == "ok", F.col("_new")).otherwise(F.col("tags")))
        .drop("_new")
    )


def retag_summary(retagged: DataFrame) -> DataFrame:
    return retagged.agg(
        F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count("*").alias("total"),
    )


def validate_permutation(order: Column, n: Column) -> Column:
    """The answer names each of 1..n once."""
    return F.when(n > 0, F.array_sort(order) == F.sequence(F.lit(1), n)).otherwise(F.size(order) == 0)


def contract_rules(columns: list[str]) -> dict[str, Column]:
    """Named checks of the data contract for the columns a table has; null passes."""
    rules: dict[str, Column] = {}
    for name in columns:
        col = F.col(name)
        if name in ENUMS:
            rules[f"{name}: enum"] = col.isin(*ENUMS[name])
        if name in LENGTHS:
            low, high = LENGTHS[name]
            rules[f"{name}: length"] = F.length(F.trim(col)).between(low, high)
        if name in RANGES:
            low, high = RANGES[name]
            rules[f"{name}: range"] = col.between(low, high)
    return rules


def validate_payload(df: DataFrame, key: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """One (key, rule) row per broken rule, all rules in one scan."""
    rules = rules if rules is not None else contract_rules(df.columns)
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def entry_annotations(entries: DataFrame) -> DataFrame:
    """Per-character cells rebuilt from stored readings; one cell when counts differ; none without a reading."""
    canto = F.col("variety") == "zh-HK"
    rom = F.trim(F.when(canto, F.col("jyutping")).otherwise(F.col("pinyin")))
    symbols = F.when(canto, "").otherwise(F.trim("bpmf"))
    chars = F.split("traditional", "")
    parts, marks = words_of(rom), words_of(symbols)
    aligned = F.transform(
        chars,
        lambda c, i: F.struct(
            c.alias("h"), F.coalesce(F.get(parts, i), F.lit("")).alias("py"), F.coalesce(F.get(marks, i), F.lit("")).alias("bpmf")
        ),
    )
    whole = F.array(F.struct(F.col("traditional").alias("h"), rom.alias("py"), symbols.alias("bpmf")))
    return entries.withColumn(
        "cells", F.when(rom == "", None).when(F.size(parts) == F.length("traditional"), aligned).otherwise(whole)
    )


def bpmf_layout(df: DataFrame, column: str = "bopomofo") -> DataFrame:
    """Neutral dot, symbols and spoken tone mark of one syllable."""
    return df.select(
        "*",
        F.regexp_extract(column, "^(˙?)", 1).alias("dot"),
        F.regexp_extract(column, "^˙?([^ˊˇˋ]*)", 1).alias("symbols"),
        F.regexp_extract(column, "([ˊˇˋ])$", 1).alias("tone_mark"),
    )


def _chars_before(gap: pa.Array) -> pa.Array:
    """For the pieces of each text, gap or not, how many characters stand before them."""
    sizes = pc.fill_null(pc.list_value_length(gap), 0).to_numpy(zero_copy_only=False)
    one = 1 - gap.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    before = np.cumsum(one, dtype=np.int64) - one
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    full = sizes > 0
    before -= np.repeat(before[starts[full]], sizes[full])
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(before, pa.int32()))


def structure_tokens(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per character or gap marker, with how many characters stand before it; the work grows with the text's length."""
    pieces = F.regexp_extract_all(column, F.lit("⟪[0-9]+(?:[.][0-9]+)?⟫|[^⟪]"), F.lit(0))
    rows = df.select(key, pieces.alias("piece"))
    before = F.arrow_udf(_chars_before, "array<int>")(F.transform("piece", lambda p: p.startswith("⟪")))
    rows = rows.select(key, "piece", before.alias("chars_before"))
    return rows.select(key, F.posexplode(F.arrays_zip("piece", "chars_before")).alias("token_no", "t")).select(
        key,
        "token_no",
        F.when(~F.col("t.piece").startswith("⟪"), F.col("t.piece")).alias("char"),
        F.when(F.col("t.piece").startswith("⟪"), F.regexp_extract("t.piece", "([0-9.]+)", 1).cast("double")).alias("gap"),
        "t.chars_before",
    )
