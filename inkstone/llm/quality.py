"""Quality rules: counts of a text, and its distance from other texts of its language; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from inkstone.llm.common import SPACES, free_name, whole_text
from inkstone.session import cut_lineage

WINDOW = 8
#: Frequent words of some languages; fixed values.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "à"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
}
#: Classes of characters besides white space and the rest (plain lower-case letters and whatever else).
CLASSES = {"upper": r"\p{Lu}", "digit": "[0-9]", "stop": r"[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>@=+/\\_~^{}\[\]`]", "other": r"[^\x00-\x7F]"}
#: Columns of the two histograms; both have a bin for the rest, and that of characters one for white space.
CHAR_BINS = [f"c{k}" for k in range(len(CLASSES) + 2)]
WORD_BINS = [f"w{k}" for k in range(max(map(len, COMMON_WORDS.values())) + 1)]
#: Medians are right to one in so many ranks.
ACCURACY = 1000
#: A text may lie so many times as far from its reference as the median text: by characters, by words. A quarter of
#: the sound texts of each language of the given tables lies beyond 1.4 (words) or 1.7 to 1.9 (characters) times the median.
#: Chosen among three pairs by the quality labels of sf0.1.
CHAR_MARGIN, WORD_MARGIN = 10.0, 2.4
#: And by words at most so much of the distance of a text without any common word.
NO_WORDS = 0.9
#: Limits are no tighter than this, however alike the texts of a language are.
LEAST_LIMIT = 0.1
#: References by language are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Number of words that lie in windows of eight words found twice or more; windows are compared by 64-bit hashes."""

    def joined(hashes: Column, shift: int) -> Column:
        return let(hashes, lambda h: F.zip_with(h, F.slice(h, shift + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b)))

    eights = joined(joined(joined(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    windows = F.when(F.size(words) >= WINDOW, F.slice(eights, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marks(s: Column) -> Column:
            def twice(x: Column, k: Column) -> Column:
                same = lambda y: F.coalesce(y["h"] == x["h"], F.lit(False))
                return same(F.get(s, k - 1)) | same(F.get(s, k + 1))

            places = F.array_sort(F.array_compact(F.transform(s, lambda x, k: F.when(twice(x, k), x["i"]))))
            steps = let(places, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ranked, marks))

    return let(windows, covered).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def common_list(lang: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, words in COMMON_WORDS.items():
        out = F.when(lang == name, F.array(*map(F.lit, words))).otherwise(out)
    return out


def common_counts(words: Column, lang: Column) -> Column:
    """How often each frequent word of the language occurs; empty for other languages."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    lowered = F.transform(F.filter(words, lambda w: F.length(w) <= 5), lambda w: F.lower(w))
    some = F.filter(lowered, lambda w: w.isin(every))
    return let(some, lambda s: F.transform(common_list(lang), lambda c: F.size(F.filter(s, lambda x: x == c)).cast("bigint")))


def measures(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """``docs`` with a column ``m``, or that with underscores: the counts of each text."""
    name = free_name(docs, "m")

    def counts(w: Column) -> Column:
        chars = F.length(F.array_join(w, ""))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            chars.cast("bigint").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            common_counts(w, lang).alias("common"),
        )

    return docs.withColumn(
        name,
        F.struct(
            let(words_of(text), counts).alias("w"),
            F.length(text).cast("bigint").alias("n_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            F.array(*[F.regexp_count(text, F.lit(p)).cast("bigint") for p in CLASSES.values()]).alias("classes"),
        ),
    )


def histogram(counts: Column, total: Column) -> Column:
    """The shares of the counts, and of the rest up to the total."""
    listed = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return F.transform(F.concat(counts, F.array(F.greatest(total - listed, F.lit(0).cast("bigint")))), lambda c: c / F.greatest(total, F.lit(1)).cast("double"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance to base two, from 0 to 1; null if there is nothing to compare."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.when(F.size(p) == F.size(q), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))))


def base_failed(m: Column) -> Column:
    return (m["w"]["n_words"] < 20) | (100 * m["w"]["n_repeat_words"] > 30 * m["w"]["n_words"])


def histograms(m: Column) -> tuple[Column, Column]:
    spaces = m["n_chars"] - m["w"]["word_chars"]
    return histogram(F.concat(m["classes"], F.array(spaces)), m["n_chars"]), histogram(m["w"]["common"], m["w"]["n_words"])


def medians(frame: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(*[F.percentile_approx(v, 0.5, F.lit(ACCURACY)).alias(v) for v in values])


def one_vote_a_source(texts: DataFrame, values: list[str]) -> DataFrame:
    """(lang, values): the median over the sources of each language of the medians within a source."""
    return medians(medians(texts, ["lang", "source"], values), ["lang"], values)


def sound_texts(docs: DataFrame, text: Column, lang: Column, source: Column, min_words: int) -> DataFrame:
    """(lang, hash, source, c0 .., w0 ..): histograms of each distinct text of a language, over the whole table.

    The hash is null in one row a language, which stands for what fails the base rules or has under ``min_words`` words.
    """
    measured = measures(docs.select(text.alias("text"), lang.alias("lang"), source.alias("source")), F.col("text"), F.col("lang"))
    m = F.col("m")
    chars, words = histograms(m)
    # no filter: Spark would move it below the counting and count twice
    sound = (m["w"]["n_words"] >= min_words) & ~base_failed(m)
    each = measured.select("lang", "source", F.when(sound, F.xxhash64("text")).alias("hash"), F.when(sound, chars).alias("c"), F.when(sound, words).alias("w"))
    # equal texts of a language have equal histograms
    shares = [F.max(F.get(F.col(name[0]), F.lit(int(name[1:])))).alias(name) for name in CHAR_BINS + WORD_BINS]
    return each.groupBy("lang", "hash").agg(F.min("source").alias("source"), *shares)


def shares_of(bins: list[str]) -> Column:
    """The bins that are there, scaled to add up to one; null if all are zero."""
    there = F.array_compact(F.array(*map(F.col, bins)))
    return let(there, lambda x: let(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n))))


def references(texts: DataFrame) -> DataFrame:
    """(ref_lang, ref_chars, ref_words): median histograms of each language.

    ``texts`` come from ``sound_texts``. Each distinct text counts once within its source and each source once within its
    language, so neither copies nor a source that holds most rows can pull the reference to themselves.
    """
    return one_vote_a_source(texts, CHAR_BINS + WORD_BINS).select(F.col("lang").alias("ref_lang"), shares_of(CHAR_BINS).alias("ref_chars"), shares_of(WORD_BINS).alias("ref_words"))


def few(refs: DataFrame) -> DataFrame:
    """Checkpointed references, marked for a broadcast if they are few."""
    return F.broadcast(refs) if refs.count() <= BROADCAST_ROWS else refs


def limits(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """``refs`` with (limit_chars, limit_words): margins times the median distances of each language, one vote a source.

    The limit by words stays below the distance of a text without a common word, so such texts are rejected wherever
    the reference has enough of them to tell (a distance of ``LEAST_LIMIT``).
    """
    far = texts.join(few(refs), F.col("lang").eqNullSafe(F.col("ref_lang"))).select(
        "lang", "source", distance(shares_of(CHAR_BINS), F.col("ref_chars")).alias("far_chars"), distance(shares_of(WORD_BINS), F.col("ref_words")).alias("far_words")
    )
    middle = one_vote_a_source(far, ["far_chars", "far_words"])
    bins = F.size("ref_words")
    wordless = F.transform(F.col("ref_words"), lambda x, k: F.when(k == bins - 1, F.lit(1.0)).otherwise(F.lit(0.0)))
    most = NO_WORDS * distance(wordless, F.col("ref_words"))
    return refs.join(middle, F.col("ref_lang").eqNullSafe(F.col("lang")), "left").select(
        *refs.columns,
        F.greatest(CHAR_MARGIN * F.col("far_chars"), F.lit(LEAST_LIMIT)).alias("limit_chars"),
        F.greatest(F.least(WORD_MARGIN * F.col("far_words"), most), F.lit(LEAST_LIMIT)).alias("limit_words"),
    )


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 50,
    max_chars: float | None = None,
    max_words: float | None = None,
) -> DataFrame:
    """``docs`` with a struct column ``quality``, or that with underscores: counts, distances, base_failed, kept.

    A text is kept if the base rules pass and its two histograms are near enough to those of its language: within
    the limits of Jensen-Shannon distance that its sound texts set, or ``max_chars`` and ``max_words`` where given.
    Texts of fewer than ``min_words`` words, and of languages without any reference, are judged by the base rules alone; a language that has no word list
    is compared by characters only. A null text has no words and fails; a null language is a language of its own;
    repeated rows are judged alike; an empty table stays empty. The references come from the whole table first;
    without a column ``source_col`` all rows are of one source.
    """
    text, lang = whole_text(text_col), F.col(lang_col)
    source = F.col(source_col) if source_col.lower() in map(str.lower, docs.columns) else F.lit(None).cast("string")
    texts = cut_lineage(sound_texts(docs, text, lang, source, min_words)).filter("hash is not null")
    refs = cut_lineage(limits(texts, cut_lineage(references(texts))))
    names = {c: free_name(docs, c) for c in refs.columns}
    refs = few(refs).withColumnsRenamed(names)
    measured = measures(docs, text, lang)
    m_name = free_name(docs, "m")
    joined = measured.join(refs, lang.eqNullSafe(F.col(names["ref_lang"])), "left")
    m = F.col(m_name)
    chars, words = histograms(m)
    long_enough = m["w"]["n_words"] >= min_words
    far_chars = F.when(long_enough, distance(chars, F.col(names["ref_chars"])))
    far_words = F.when(long_enough & (F.size(m["w"]["common"]) > 0), distance(words, F.col(names["ref_words"])))
    limit_chars, limit_words = (F.col(names[c]) if given is None else F.lit(given) for c, given in (("limit_chars", max_chars), ("limit_words", max_words)))
    near = F.coalesce(far_chars <= limit_chars, F.lit(True)) & F.coalesce(far_words <= limit_words, F.lit(True))
    verdict = F.struct(
        m["w"]["n_words"].alias("n_words"),
        m["w"]["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"),
        base_failed(m).alias("base_failed"),
        far_chars.alias("char_distance"),
        far_words.alias("word_distance"),
        # one case, so that no part of it is tested below the join and counted twice
        F.when(base_failed(m), F.lit(False)).otherwise(near).alias("kept"),
    )
    out = free_name(docs, "quality")
    return joined.withColumn(out, verdict).select(*docs.columns, out)
