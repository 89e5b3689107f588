"""Building, ranking and repairing the lexicon.

A lexicon row is (ord, traditional, simplified, py_num, py_flat, english) plus
the boolean tiers ``frequent`` and ``common``. ``ord`` is the source order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkstone.functions.text import HAN_BLOCKS, characters, flat_key, words_of
from inkstone.operators.common import first_per_key, top_per_key

# Caps per key and the glosses that are not real senses.
ENTRIES_PER_FLAT = 8
CHARS_PER_SYLLABLE = 10
ENTRIES_PER_HEADWORD = 4
META_GLOSS = r"(?i)^(surname|variant of|old variant|see )"
IDIOM_TAG = r"(?i)\(idiom\)"
JYUTPING_SYLLABLE = "^[a-z]+[1-6]$"


# Fixed value: characters of a gloss that an entry keeps.
GLOSS_KEPT = 400


def normalize_entries(raw: DataFrame, gloss_kept: int = GLOSS_KEPT) -> DataFrame:
    """Source rows (ord, traditional, simplified, pinyin, english array) to lexicon rows; glosses over ``gloss_kept`` characters are cut."""
    py = F.replace(F.replace(F.lower("pinyin"), F.lit("u:"), F.lit("v")), F.lit("ü"), F.lit("v"))
    gloss = F.array_join(F.coalesce("english", F.array().cast("array<string>")), " / ")
    return (
        raw.select(
            "ord",
            "traditional",
            F.when(F.coalesce("simplified", F.lit("")) == "", F.col("traditional")).otherwise(F.col("simplified")).alias("simplified"),
            py.alias("py_num"),
            flat_key(py).alias("py_flat"),
            F.when(F.length(gloss) > gloss_kept, F.concat(F.substring(gloss, 1, gloss_kept), F.lit("…"))).otherwise(gloss).alias("english"),
        )
        .filter((F.coalesce("traditional", F.lit("")) != "") & (F.coalesce("py_num", F.lit("")) != ""))
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """Main list, supplements and fallback readings one after another; ord = (source, ord)."""
    out = None
    for rank, df in enumerate(sources):
        part = df.withColumn("ord", F.struct(F.lit(rank).alias("source"), F.col("ord").cast("long").alias("ord")))
        out = part if out is None else out.unionByName(part)
    return out


def with_tiers(words: DataFrame, frequent: DataFrame, common: DataFrame) -> DataFrame:
    """Mark words of the two frequency lists (column ``word`` each); common implies frequent."""
    f = frequent.select(F.col("word").alias("traditional"), F.lit(True).alias("_f")).distinct()
    c = common.select(F.col("word").alias("traditional"), F.lit(True).alias("_c")).distinct()
    return (
        words.join(f, "traditional", "left")
        .join(c, "traditional", "left")
        .withColumn("common", F.coalesce("_c", F.lit(False)))
        .withColumn("frequent", F.coalesce("_f", "_c", F.lit(False)))
        .drop("_f", "_c")
    )


def syllable_inventory(words: DataFrame) -> DataFrame:
    """Distinct toneless syllables."""
    return (
        words.select(F.explode(words_of(F.col("py_num"))).alias("token"))
        .select(F.regexp_replace("token", "[0-9]", "").alias("syllable"))
        .filter("syllable <> ''")
        .distinct()
    )


def idiom_set(words: DataFrame) -> DataFrame:
    """Idiom-tagged entries, first per headword."""
    return first_per_key(words.filter(F.col("english").rlike(IDIOM_TAG)), ["traditional"], [F.col("ord")])


def _char_pairs(words: DataFrame) -> DataFrame:
    paired = words.filter(F.length("simplified") == F.length("traditional"))
    zipped = F.arrays_zip(characters(F.col("simplified")).alias("s"), characters(F.col("traditional")).alias("t"))
    return paired.select("ord", F.posexplode(zipped).alias("pos", "pair")).select(
        "ord", "pos", F.col("pair.s").alias("s"), F.col("pair.t").alias("t")
    )


def char_script_map(words: DataFrame) -> DataFrame:
    """Simplified to traditional per character from pairs that differ; the first seen wins."""
    return (
        _char_pairs(words)
        .filter("s <> t")
        .groupBy(F.col("s").alias("simplified"))
        .agg(F.min_by("t", F.struct("ord", "pos")).alias("traditional"))
    )


def variant_majority_vote(words: DataFrame) -> DataFrame:
    """Per traditional form, the form most entries use for the same simplified character.

    Identical pairs weigh 5. Ties go to the form seen first; a form voted on under
    several simplified characters follows the one seen last.
    """
    votes = (
        _char_pairs(words)
        .groupBy("s", "t")
        .agg(
            F.sum(F.when(F.col("s") == F.col("t"), 5).otherwise(1)).alias("votes"),
            F.min(F.struct("ord", "pos")).alias("seen"),
        )
    )
    winners = votes.groupBy("s").agg(
        F.min_by("t", F.struct((-F.col("votes")).alias("v"), F.col("seen"))).alias("best"),
        F.min("seen").alias("s_seen"),
    )
    return (
        votes.join(winners, "s")
        .filter("t <> best")
        .groupBy(F.col("t").alias("variant"))
        .agg(F.max_by("best", "s_seen").alias("standard"))
    )


def map_characters(df: DataFrame, columns: dict[str, str], mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Replace characters of whole texts; ``columns`` maps input to output column names.

    The mapping has one row per character, so it is bounded by the Han code
    points (checked); it becomes the two constants of ``translate`` and the texts
    are never exploded or shuffled.
    """
    limit = 120_000
    pairs = mapping.select(source, target).orderBy(source).limit(limit + 1).collect()
    if len(pairs) > limit:
        raise ValueError("a character map cannot have more rows than there are Han characters")
    before = "".join(r[0] for r in pairs)
    after = "".join(r[1] for r in pairs)
    for name, out in columns.items():
        df = df.withColumn(out, F.translate(name, before, after) if pairs else F.col(name))
    return df


def remap_frequency_list(ranked: DataFrame, remap: DataFrame) -> DataFrame:
    """Rewrite variant characters of (word, rank); duplicates keep their best rank."""
    fixed = map_characters(ranked, {"word": "fixed"}, remap, "variant", "standard")
    return fixed.groupBy(F.col("fixed").alias("word")).agg(
        F.min("rank").alias("rank"), F.min_by(F.col("word") != F.col("fixed"), "rank").alias("changed")
    )


def rank_char_readings(counts: DataFrame) -> DataFrame:
    """(char, reading, count[, ord]) to readings of valid shape, most counted first."""
    order = [F.col("count").desc()] + ([F.col("ord")] if "ord" in counts.columns else [F.col("reading")])
    w = Window.partitionBy("char").orderBy(*order)
    return counts.filter(F.col("reading").rlike(JYUTPING_SYLLABLE)).withColumn("rank", F.row_number().over(w)).select(
        "char", "reading", "rank"
    )


def first_valid_word_reading(readings: DataFrame) -> DataFrame:
    """(word, ord, reading) to the first reading that fits a Han word of two or more characters."""
    pieces = F.split("reading", " ")
    return (
        readings.filter((F.length("word") >= 2) & F.col("word").rlike(f"^[{HAN_BLOCKS}]+$"))
        .filter(F.size(pieces) == F.length("word"))
        .filter(F.forall(pieces, lambda s: s.rlike(JYUTPING_SYLLABLE)))
        .groupBy("word")
        .agg(F.min_by("reading", "ord").alias("reading"))
    )


def gap_fill_readings(ranked: DataFrame, words: DataFrame, fallback: DataFrame) -> DataFrame:
    """Add fallback readings for characters that occur in words but have none."""
    missing = (
        words.select(F.explode(characters(F.col("word"))).alias("char"))
        .distinct()
        .join(ranked.select("char").distinct(), "char", "left_anti")
    )
    valid = fallback.filter(F.col("reading").rlike(JYUTPING_SYLLABLE)).groupBy("char", "reading").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("char").orderBy("ord")
    filled = valid.join(missing, "char", "left_semi").withColumn("rank", F.row_number().over(w)).select("char", "reading", "rank")
    return ranked.withColumn("source", F.lit("counted")).unionByName(filled.withColumn("source", F.lit("fallback")))


def positive_freq(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("count") > 0)


def top_entries_by_key(words: DataFrame, n: int = ENTRIES_PER_FLAT) -> DataFrame:
    """Entries per flat key, frequent first, then source order."""
    return top_per_key(words, ["py_flat"], [F.col("frequent").desc(), F.col("ord")], n)


def top_chars_by_syllable(words: DataFrame, n: int = CHARS_PER_SYLLABLE) -> DataFrame:
    """Single-character entries per toneless syllable."""
    chars = words.filter(F.length("traditional") == 1).select(
        "*", F.explode(words_of(F.regexp_replace("py_num", "[0-9]", ""))).alias("syllable")
    )
    return top_per_key(chars, ["syllable"], [F.col("frequent").desc(), F.col("ord")], n)


def top_entries_by_headword(words: DataFrame, n: int = ENTRIES_PER_HEADWORD) -> DataFrame:
    """Entries per headword in either script; tier 0 traditional, tier 1 a differing simplified."""
    keyed = words.withColumn("key", F.col("traditional")).withColumn("tier", F.lit(0)).unionByName(
        words.filter("simplified <> '' and simplified <> traditional")
        .withColumn("key", F.col("simplified"))
        .withColumn("tier", F.lit(1))
    )
    return top_per_key(keyed, ["key", "tier"], [F.col("ord")], n)


def is_meta(english: Column) -> Column:
    return english.rlike(META_GLOSS)


def pick_sense(words: DataFrame) -> DataFrame:
    """The one sense shown per headword: traditional before simplified, real before meta senses."""
    return first_per_key(
        top_entries_by_headword(words), ["key"], [F.col("tier"), is_meta(F.col("english")), F.col("ord")]
    )


def shown_senses(words: DataFrame, column: str = "token") -> DataFrame:
    """The shown sense of every headword, marked as a hit."""
    return pick_sense(words).select(
        F.col("key").alias(column), "traditional", "simplified", "py_num", "english", F.lit(True).alias("_hit")
    )


def lexicon_lookup(tokens: DataFrame, words: DataFrame, column: str = "token") -> DataFrame:
    """Left join of tokens to their shown sense; ``known`` tells hits apart."""
    return tokens.join(shown_senses(words, column), column, "left").withColumn("known", F.coalesce("_hit", F.lit(False))).drop("_hit")


def lexicon_misses(tokens: DataFrame, words: DataFrame, document: str, position: str, n: int = 3) -> DataFrame:
    """First ``n`` distinct unknown tokens of two or more characters per document."""
    keys = words.select(F.col("traditional").alias("token")).union(words.select(F.col("simplified"))).distinct()
    missing = (
        tokens.filter(F.length("token") >= 2)
        .groupBy(document, "token")
        .agg(F.min(position).alias(position))
        .join(keys, "token", "left_anti")
    )
    return top_per_key(missing, [document], [F.col(position), F.col("token")], n)


def idiom_verify(proposals: DataFrame, words: DataFrame, document: str, n: int = 3) -> DataFrame:
    """Proposed idioms (document, position, proposal) that the lexicon tags as idioms, first ``n``."""
    idioms = idiom_set(words).select("traditional", "simplified", "py_num", "english")
    found = proposals.withColumn("traditional", F.trim("proposal")).join(idioms, "traditional")
    return top_per_key(found, [document], [F.col("position")], n)


def validate_definition(proposed: DataFrame) -> DataFrame:
    """Proposed (word, traditional, simplified, pinyin, english) with a reject reason, null when sound."""
    syllables = words_of(F.col("pinyin"))
    gloss = F.trim("english")
    complete = F.greatest(*[F.col(c).isNull().cast("int") for c in ("traditional", "simplified", "pinyin", "english")]) == 0
    return proposed.withColumn(
        "reject_reason",
        F.when(~complete, "incomplete")
        .when((F.col("traditional") != F.col("word")) & (F.col("simplified") != F.col("word")), "other characters")
        .when(F.size(syllables) != F.length("word"), "syllable count")
        .when(~F.trim("pinyin").rlike(r"(?i)^[a-züv]+[1-5](\s+[a-züv]+[1-5])*$"), "reading shape")
        .when((F.length(gloss) < 5) | (F.length(gloss) > 250), "gloss length"),
    )


def definition_merge(words: DataFrame, proposed: DataFrame) -> DataFrame:
    """New lexicon rows from sound definitions of words the lexicon lacks in either script."""
    known = words.select(F.col("traditional").alias("word")).union(words.select("simplified")).distinct()
    sound = validate_definition(proposed).filter("reject_reason is null").join(known, "word", "left_anti")
    one = first_per_key(sound, ["word"], [F.col("ord")])
    py = F.lower(F.trim("pinyin"))
    return one.select(
        "ord",
        "traditional",
        "simplified",
        py.alias("py_num"),
        flat_key(py).alias("py_flat"),
        F.concat(F.trim("english"), F.lit(" (AI-defined)")).alias("english"),
    )
