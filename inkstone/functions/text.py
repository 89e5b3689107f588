"""Han detection, phonetic spelling and multiset similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Two deliberate Han definitions: the Unicode script for routing and lookup,
# and a narrower block range for romanisation and error rates.
HAN = r"\p{IsHan}"
HAN_BLOCKS = r"㐀-鿿豈-﫿\x{20000}-\x{2ffff}"
HAN_BLOCKS_BMP = r"㐀-鿿豈-﫿"

# Accented vowels by base vowel, tones 1 to 4 in order.
TONE_MARKS = {
    "a": "āáǎà",
    "e": "ēéěè",
    "i": "īíǐì",
    "o": "ōóǒò",
    "u": "ūúǔù",
    "v": "ǖǘǚǜ",
}
MARKED_VOWELS = "".join(TONE_MARKS.values())
PLAIN_VOWELS = "".join(vowel * 4 for vowel in TONE_MARKS)
MARK_TONES = "1234" * len(TONE_MARKS)

# Spelling repairs, applied in this order.
SPELLING_REPAIRS = [
    (r"^ts", "c"),
    (r"^tz", "z"),
    ("ee", "i"),
    ("oo", "u"),
    ("ung", "ong"),
    ("au", "ao"),
    (r"ih$", "i"),
    (r"ow$", "ou"),
]


def has_han(col: Column) -> Column:
    return col.rlike(HAN)


def count_han(col: Column) -> Column:
    return F.regexp_count(col, F.lit(HAN))


def han_only(col: Column) -> Column:
    """Text reduced to the characters an error rate is measured over."""
    return F.regexp_replace(col, f"[^{HAN_BLOCKS_BMP}]", "")


def characters(col: Column) -> Column:
    """Array of code points; empty text gives an empty array."""
    return F.when(F.length(col) > 0, F.split(col, "")).otherwise(F.array().cast("array<string>"))


def words_of(col: Column) -> Column:
    """Whitespace-separated non-empty pieces."""
    return F.filter(F.split(F.trim(col), r"\s+"), lambda piece: piece != "")


def no_space(col: Column) -> Column:
    return F.regexp_replace(col, r"\s+", "")


def flat_key(py_num: Column) -> Column:
    """Toneless, spaceless key of a numbered reading."""
    return F.regexp_replace(py_num, r"[0-9\s]", "")


def strip_marks(col: Column) -> Column:
    """Lower-case spelling without tone marks or digits, ü written v."""
    plain = F.translate(F.lower(col), MARKED_VOWELS + "ü", PLAIN_VOWELS + "v")
    return F.regexp_replace(F.regexp_replace(plain, "u:", "v"), "[0-9]", "")


def marks_to_number(syllable: Column) -> Column:
    """One marked syllable to its numbered form; unmarked counts as tone 1."""
    low = F.lower(F.trim(syllable))
    mark = F.regexp_extract(low, f"^.*([{MARKED_VOWELS}])", 1)
    tone = F.when(mark == "", "1").otherwise(F.translate(mark, MARKED_VOWELS, MARK_TONES))
    return F.concat(F.translate(low, MARKED_VOWELS + "ü", PLAIN_VOWELS + "v"), tone)


def repair_spelling(token: Column) -> Column:
    for pattern, replacement in SPELLING_REPAIRS:
        token = F.regexp_replace(token, pattern, replacement)
    return token


def tone_list(py_num: Column) -> Column:
    """Tone per syllable of a numbered reading, 0 where it has none."""
    return F.transform(words_of(py_num), lambda s: F.instr(F.lit("12345"), F.right(s, F.lit(1))))


def shared_units(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two strings' characters."""
    return F.aggregate(
        F.array_distinct(characters(a)),
        F.lit(0),
        lambda hits, c: hits
        + F.least(
            F.length(a) - F.length(F.replace(a, c, F.lit(""))),
            F.length(b) - F.length(F.replace(b, c, F.lit(""))),
        ),
    )


def char_overlap(a: Column, b: Column, denominator: str = "shorter") -> Column:
    """Multiset character similarity in 0..1.

    ``shorter`` divides by the shorter text, ``truth`` by the second one, and
    ``strict_shorter`` is ``shorter`` with exact match asked of texts under four
    characters.
    """
    shorter = F.least(F.length(a), F.length(b))
    base = F.length(b) if denominator == "truth" else shorter
    ratio = shared_units(a, b) / F.greatest(F.lit(1), base)
    if denominator == "strict_shorter":
        return F.when(shorter < 4, (a == b).cast("double")).otherwise(ratio)
    return ratio


def quoted(col: Column) -> Column:
    """CSV cell: always quoted, quotes doubled, null as empty."""
    return F.concat(
        F.lit('"'),
        F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), '"', '""'),
        F.lit('"'),
    )


def age_label(then: Column, now: Column) -> Column:
    """Relative age as the history list shows it."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then))
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )
