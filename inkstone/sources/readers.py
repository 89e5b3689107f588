"""Readers for lexicon, reading and page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkstone.functions.text import flat_key
from inkstone.operators.common import position_by_bucket
from inkstone.operators.lexicon import JYUTPING_SYLLABLE, normalize_entries
from inkstone.operators.rules import parse_loose_json

ENTRY = "traditional string, simplified string, pinyin string, english array<string>"
POINT = "struct<x:double,y:double>"


def _placed(df: DataFrame) -> DataFrame:
    """The rows as read, with the file, the block of it and the place in the block."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def _in_source_order(df: DataFrame, within: str | None = None) -> DataFrame:
    """``ord`` numbers the rows of ``_placed`` by file and place in it, however Spark packs the blocks into tasks.

    Only the counts of the blocks are numbered in one task.
    """
    order = [F.col("_at")] + ([F.col(within)] if within else [])
    one = df.withColumn("_all", F.lit(0))
    return position_by_bucket(one, ["_all"], ["_file", "_block"], order, "ord").drop("_all", "_file", "_block", "_at")


def read_lexicon(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Dictionary file: a JSON array or one object with ``entries``, or with ``lines`` one entry a line.

    Only files of lines are read by several tasks each.
    """
    schema = f"{ENTRY}, entries array<struct<traditional:string,simplified:string,pinyin:string,english:array<string>>>"
    raw = _placed(spark.read.schema(schema).option("multiLine", not lines).json(path))
    own = F.array(F.struct("traditional", "simplified", "pinyin", "english"))
    rows = raw.select("_file", "_block", "_at", F.posexplode(F.coalesce("entries", own)).alias("_k", "e")).select("_file", "_block", "_at", "_k", "e.*")
    return normalize_entries(_in_source_order(rows, "_k").drop("_k"))


def read_supplement(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Domain supplement: complete entries with one gloss each, in a JSON array or one a line."""
    schema = "traditional string, simplified string, pinyin string, english string"
    raw = _in_source_order(_placed(spark.read.schema(schema).option("multiLine", not lines).json(path)))
    py = F.lower("pinyin")
    return raw.select("ord", "traditional", "simplified", py.alias("py_num"), flat_key(py).alias("py_flat"), "english")


def read_char_readings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Fallback readings per character, in a JSON array or one a line; an empty gloss is spelled out."""
    schema = "ch string, simp string, pinyin string, english string"
    raw = _in_source_order(_placed(spark.read.schema(schema).option("multiLine", not lines).json(path)))
    gloss = F.when(F.coalesce("english", F.lit("")) == "", "(rare character)").otherwise(F.col("english"))
    return raw.select(
        "ord", F.col("ch").alias("traditional"), F.col("simp").alias("simplified"), F.col("pinyin").alias("py_num"),
        flat_key(F.col("pinyin")).alias("py_flat"), gloss.alias("english"),
    )


def read_tsv_readings(spark: SparkSession, path: str) -> DataFrame:
    """(ord, char, reading) from tab-separated lines; comments and malformed syllables go."""
    cells = F.split("value", "\t")
    rows = _in_source_order(_placed(spark.read.text(path))).filter(F.contains("value", F.lit("\t")) & ~F.col("value").startswith("#"))
    out = rows.select("ord", F.get(cells, F.lit(0)).alias("char"), F.get(cells, F.lit(1)).alias("reading"))
    return out.filter(F.col("reading").rlike(JYUTPING_SYLLABLE))


def read_words_readings(spark: SparkSession, path: str) -> DataFrame:
    """(word, ord, reading) from a JSON object of word to readings."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    words = raw.select(F.explode("m").alias("word", "readings"))
    return words.select("word", F.posexplode("readings").alias("ord", "reading"))


def read_page_items(spark: SparkSession, path: str) -> DataFrame:
    """One row per detector item of {items: [{box, text, score}], w, h} files; page_id is the file."""
    schema = "items array<struct<box:array<double>,text:string,score:double>>, w int, h int"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("page_id", F.input_file_name())
    rows = raw.select("page_id", "w", "h", F.posexplode("items").alias("item", "i"))
    box = {n: F.get("i.box", F.lit(k)) for k, n in enumerate(("x1", "y1", "x2", "y2"))}
    return rows.select("page_id", "w", "h", "item", *[v.alias(k) for k, v in box.items()], "i.text", "i.score")


def read_page_quads(spark: SparkSession, path: str) -> DataFrame:
    """One row per detector quad of {quads: [{pts, aabb, angle}], w, h} files."""
    schema = "quads array<struct<pts:array<array<double>>,aabb:array<double>,angle:double,score:double>>, w int, h int"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("page_id", F.input_file_name())
    rows = raw.select("page_id", "w", "h", F.posexplode("quads").alias("item", "q"))
    pts = F.transform("q.pts", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rows.select("page_id", "w", "h", "item", pts.cast(f"array<{POINT}>").alias("pts"), "q.aabb", "q.angle", F.col("q.score").alias("score"))


def read_model_lines(answers: DataFrame) -> DataFrame:
    """Model answers (page_id, raw) to lines; ``{"lines": […]}`` or a bare list, fenced or not."""
    line = "struct<n:double,text:string,dir:string>"
    rows = parse_loose_json(answers, "raw", "struct<lines:array<string>>").withColumnRenamed("parsed", "whole")
    rows = parse_loose_json(rows, "raw", "array<string>").withColumnRenamed("parsed", "bare")
    # elements are kept as JSON first: a text that is no string is no line
    texts = F.filter(F.coalesce("whole.lines", "bare"), lambda x: x.rlike('^\\{.*"text" ?: ?"'))
    lines = F.transform(texts, lambda x: F.from_json(x, line))
    kept = F.filter(lines, lambda x: F.trim(F.regexp_replace(x.text, "⟪[^⟫]*⟫", "")) != "")
    out = rows.select("page_id", F.posexplode(kept).alias("line", "l"))
    return out.select(
        "page_id", "line", F.coalesce(F.col("l.n").cast("int"), F.col("line") + 1).alias("n"), "l.text",
        F.when(F.col("l.dir") == "v", "v").otherwise("h").alias("dir"),
    )


METER = "ts timestamp, page string, served_by string, proposals int, verified int"


def read_meter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METER).json(path)


def stream_meter(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(METER).json(path)
