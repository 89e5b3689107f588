"""Readings: syllable tables, rough spelling to phrases, and annotation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkstone.functions.syllables import spell
from inkstone.functions.text import (
    HAN,
    MARKED_VOWELS,
    PLAIN_VOWELS,
    characters,
    has_han,
    marks_to_number,
    repair_spelling,
    tone_list,
    words_of,
)
from inkstone.operators.common import first_per_key, measured_side, top_per_key
from inkstone.operators.lexicon import IDIOM_TAG, syllable_inventory, top_chars_by_syllable, top_entries_by_headword, top_entries_by_key

# Longest word in syllables, phrases kept.
WORD_SYLLABLES = 8
KEEP = 3


def syllable_dim(inventory: DataFrame) -> DataFrame:
    """One row per toneless syllable and tone, with Bopomofo and marked spelling."""
    rows = inventory.select(F.col("syllable").alias("base"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tone"))
    numbered = F.concat("base", F.col("tone").cast("string"))
    written = F.get(spell(F.array(numbered)), F.lit(0))
    rows = rows.select(numbered.alias("numbered"), "base", "tone", written.alias("w"))
    return rows.select("numbered", "base", "tone", "w.bopomofo", "w.marked")


def phrase_marks(py_num: Column) -> Column:
    return F.array_join(F.transform(spell(words_of(py_num)), lambda c: c.marked), " ")


def _joined_bopomofo(cells: Column) -> Column:
    return F.array_join(F.filter(F.transform(cells, lambda c: c.bopomofo), lambda c: c != ""), " ")


def normalize_phonetic(queries: DataFrame, key: str = "query_id", column: str = "text") -> DataFrame:
    """(key, token_no, flat, tones): repaired spelling with the typed tone digits."""
    plain = F.translate(F.lower(column), MARKED_VOWELS + "ü", PLAIN_VOWELS + "v")
    pieces = F.filter(F.split(plain, "[^a-z0-9v]+"), lambda p: F.regexp_replace(p, "[^a-zv]", "") != "")
    rows = queries.select(key, F.posexplode(pieces).alias("token_no", "piece"))
    digits = F.regexp_extract_all("piece", F.lit("[a-zv]+([1-5])"), F.lit(1))
    # one (letters, tone) pair per typed piece: the tone goes to the last syllable of its letters
    parts = F.regexp_extract_all("piece", F.lit("[a-zv]+[0-9]*"), F.lit(0))
    return rows.select(
        key,
        "token_no",
        repair_spelling(F.regexp_replace("piece", "[^a-zv]", "")).alias("flat"),
        F.transform(digits, lambda d: d.cast("int")).alias("tones"),
        F.transform(
            parts,
            lambda p: F.struct(
                F.regexp_replace(p, "[0-9]", "").alias("letters"),
                F.regexp_extract(p, "^[a-zv]+([1-5])", 1).alias("tone"),
            ),
        ).alias("parts"),
    )


def split_syllables(tokens: DataFrame, inventory: DataFrame, column: str = "flat") -> DataFrame:
    """(column, syllables): fewest pieces of the inventory, null when there is no split.

    At equal count the earlier cut wins. Tokens are deduplicated first; all their
    substrings of up to eight letters meet the inventory in one join, and the
    cheapest chain is folded inside the token's row.
    """
    unique = tokens.select(F.col(column).alias("token")).filter("token <> ''").distinct()
    spans = (
        unique.select("token", F.explode(F.sequence(F.lit(0), F.length("token") - 1)).alias("start"))
        .select(
            "*",
            F.explode(
                F.sequence(F.lit(1), F.least(F.lit(WORD_SYLLABLES), F.length("token") - F.col("start")))
            ).alias("n"),
        )
        .withColumn("syllable", F.substring("token", F.col("start") + 1, F.col("n")))
        .join(inventory.select("syllable").distinct(), "syllable", "left_semi")
    )
    # a typed token is a request-sized word, so its spans are few
    edges = spans.groupBy("token").agg(
        F.collect_list(F.struct((F.col("start") + F.col("n")).alias("end"), "start", "n")).alias("edges")
    )
    far = 1_000_000
    seed = F.array(F.struct(F.lit(0).alias("count"), F.lit(0).alias("start")))

    def best(state: Column, j: Column) -> Column:
        into = F.filter(F.col("edges"), lambda e: e.end == j)
        offers = F.transform(
            into, lambda e: F.struct((F.get(state, e.start)["count"] + 1).alias("count"), e.start.alias("start"))
        )
        none = F.struct(F.lit(far).alias("count"), F.lit(0).alias("start"))
        return F.concat(state, F.array(F.coalesce(F.array_min(offers), none)))

    positions = F.sequence(F.lit(1), F.length("token"))
    solved = edges.withColumn("chain", F.aggregate(positions, seed, best)).withColumn(
        "whole", F.get("chain", F.length("token"))["count"] < far
    )

    def back(state: Column, j: Column) -> Column:
        start = F.get(F.col("chain"), j)["start"]
        piece = F.substring(F.col("token"), start + 1, j - start)
        return F.when(
            j == state.at,
            F.struct(start.alias("at"), F.concat(F.array(piece), state.pieces).alias("pieces")),
        ).otherwise(state)

    tail = F.struct(F.length("token").alias("at"), F.array().cast("array<string>").alias("pieces"))
    pieces = F.aggregate(F.reverse(positions), tail, back, lambda s: s.pieces)
    # no filter on ``whole``: it would be pushed down and fold the chain twice
    split = solved.select("token", F.when(F.col("whole"), pieces).alias("syllables"))
    return unique.join(split, "token", "left").withColumnRenamed("token", column)


def query_syllables(queries: DataFrame, inventory: DataFrame, key: str, column: str) -> DataFrame:
    """(key, syllables, tones): whole-query syllables, with the typed tone or 0 at each position.

    Queries with a token that cannot be split are left out. A typed tone goes to
    the syllable its letters end on; a bare token gives no tone.
    """
    tokens = normalize_phonetic(queries, key, column)
    split = split_syllables(tokens, inventory)
    rows = tokens.join(split, "flat", "left")
    ends = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<end:int,tone:int>>").alias("ends")),
        lambda s, p: F.struct(
            (s.at + F.length(repair_spelling(p.letters))).alias("at"),
            F.concat(
                s.ends,
                F.array(
                    F.struct(
                        (s.at + F.length(repair_spelling(p.letters))).cast("int").alias("end"),
                        F.when(p.tone == "", 0).otherwise(p.tone.cast("int")).alias("tone"),
                    )
                ),
            ).alias("ends"),
        ),
        lambda s: s.ends,
    )
    rows = rows.withColumn("ends", ends)
    aligned = F.aggregate(
        "syllables",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("tones")),
        lambda s, y: F.struct(
            (s.at + F.length(y)).alias("at"),
            F.concat(
                s.tones,
                F.array(
                    F.coalesce(
                        F.get(F.filter(F.col("ends"), lambda e: e.end == s.at + F.length(y)), F.lit(0)).tone, F.lit(0)
                    )
                ),
            ).alias("tones"),
        ),
        lambda s: s.tones,
    )
    rows = rows.withColumn("aligned", aligned)
    cell = F.struct("token_no", "syllables", F.col("aligned").alias("tones"))
    grouped = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(cell)).alias("t"), F.bool_and(F.col("syllables").isNotNull()).alias("whole")
    )
    return grouped.filter("whole").select(
        key,
        F.flatten(F.transform("t", lambda x: x.syllables)).alias("syllables"),
        F.flatten(F.transform("t", lambda x: x.tones)).alias("tones"),
    )


def _span_edges(phrases: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Scored lattice edges: every span of up to eight syllables joined to its entries."""
    size = F.size("syllables")
    spans = (
        phrases.filter(size > 0)
        .select(key, "syllables", "tones", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
        .select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(WORD_SYLLABLES), size - F.col("start")))).alias("n"))
        .select(
            key,
            "start",
            "n",
            F.array_join(F.slice("syllables", F.col("start") + 1, F.col("n")), "").alias("py_flat"),
            F.slice("tones", F.col("start") + 1, F.col("n")).alias("want"),
            size.alias("size"),
        )
    )
    entries = top_entries_by_key(lexicon).withColumn("got", tone_list(F.col("py_num")))
    wrong = F.size(
        F.filter(
            F.zip_with(
                "want",
                "got",
                lambda w, g: (w.isNotNull() & g.isNotNull() & (w > 0) & (g > 0) & (g != 5) & (w != g)),
            ),
            lambda bad: bad,
        )
    )
    chars = F.length("traditional")
    boost = (
        F.when((chars > 1) & F.col("common"), 75)
        .when((chars > 1) & F.col("frequent"), 60)
        .when(chars > 1, 0)
        .when(F.col("common"), 10)
        .otherwise(0)
    )
    rare = F.when((chars == 1) & ~F.col("frequent"), 45).otherwise(0)
    gain = F.col("n") * 100 - 35 + F.when(chars == F.col("n"), 5).otherwise(0) + boost - rare - wrong * 200
    return spans.join(entries, "py_flat").select(
        key,
        "size",
        (F.col("start") + F.col("n")).cast("int").alias("end"),
        F.col("start").cast("int").alias("start"),
        gain.cast("int").alias("gain"),
        wrong.cast("int").alias("wrong"),
        F.col("rank").alias("entry_rank"),
        "traditional",
        "simplified",
        "py_num",
        "english",
    )


def _chains(size: int, ends: list, starts: list, ranks: list, gains: list, wrongs: list) -> list[dict]:
    """The ``KEEP`` best chains of edges from 0 to ``size``; edges come by end. One pass, keeping as many chains at each place."""
    best: list[list[tuple]] = [[(0, 0, 0, 0, 0, -1)], *([] for _ in range(size))]
    at, n = 0, len(ends)
    while at < n:
        end, offers = ends[at], []
        while at < n and ends[at] == end:
            start, rank, gain, wrong = starts[at], ranks[at], gains[at], wrongs[at]
            offers += [(p[0] - gain, start, k, rank, p[4] + wrong, at) for k, p in enumerate(best[start])]
            at += 1
        offers.sort()
        best[end] = offers[:KEEP]
    out = []
    for path in best[size]:
        picks, step = [], path
        while step[5] >= 0:
            picks.append(step[5])
            step = best[step[1]][step[2]]
        out.append({"score": -path[0], "wrong": path[4], "picks": picks[::-1]})
    return out


def _best_chains(size: pa.Array, end: pa.Array, start: pa.Array, rank: pa.Array, gain: pa.Array, wrong: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("score", pa.int32()), ("wrong", pa.int32()), ("picks", pa.list_(pa.int32()))]))
    return pa.array([_chains(*row) for row in zip(*(c.to_pylist() for c in (size, end, start, rank, gain, wrong)))], type=kind)


def best_paths(phrases: DataFrame, lexicon: DataFrame, key: str = "query_id") -> DataFrame:
    """The best chains of entries over each phrase, as (key, score, wrong, words).

    Eight spans per position and eight entries per span bound the lattice of a typed
    phrase to one row; a chain is found in one pass over its edges' numbers, and words are picked by place. Ties: earlier start,
    then rank of the prefix, then entry order.
    """
    edges = _span_edges(phrases, lexicon, key)
    # a fourth entry of a span never beats the first three
    edges = top_per_key(edges, [key, "start", "end"], [F.col("gain").desc(), F.col("entry_rank")], KEEP, "_best")
    word = F.struct("traditional", "simplified", "py_num", "english").alias("word")
    edge = F.struct("end", "start", F.col("entry_rank").alias("rank"), "gain", "wrong", word)
    lattice = edges.groupBy(key, "size").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    numbers = [F.col("edges")[name] for name in ("end", "start", "rank", "gain", "wrong")]
    best = F.arrow_udf(_best_chains, "array<struct<score:int,wrong:int,picks:array<int>>>")
    chains = lattice.select(key, "edges", F.posexplode(best("size", *numbers)).alias("path_no", "path"))
    words = F.transform("path.picks", lambda k: F.get("edges", k).word)
    return chains.select(key, "path_no", "path.score", "path.wrong", words.alias("words"))


def rank_interpretations(paths: DataFrame, key: str = "query_id") -> DataFrame:
    """Up to three phrases per query, tone-exact first; chains of single characters only as a last resort."""
    multi = F.exists("words", lambda w: F.length(w.traditional) > 1)
    # a window, not an aggregate joined back: the chains are computed once
    marked_paths = paths.withColumn("multi", multi).withColumn("any_multi", F.max("multi").over(Window.partitionBy(key)))
    forms = F.array_join(F.transform("words", lambda w: F.concat_ws("#", w.traditional, w.py_num)), "|")
    kept = first_per_key(
        marked_paths.filter(F.col("multi") | ~F.col("any_multi")).withColumn("forms", forms),
        [key, "forms"],
        [F.col("wrong"), -F.col("score"), F.col("path_no")],
    )
    ranked = top_per_key(kept, [key], [F.col("wrong"), F.col("score").desc(), F.col("path_no")], KEEP)
    ranked = ranked.withColumn("cells", spell(F.flatten(F.transform("words", lambda w: words_of(w.py_num)))))
    exact = F.size("words") == 1
    glosses = F.transform("words", lambda w: F.get(F.split(w.english, " / "), F.lit(0)))
    english = F.when(exact, F.get("words", F.lit(0)).english).otherwise(F.array_join(glosses, "; "))
    return ranked.select(
        key,
        "rank",
        F.array_join(F.transform("words", lambda w: w.traditional), "").alias("traditional"),
        F.array_join(F.transform("words", lambda w: w.simplified), "").alias("simplified"),
        F.array_join(F.transform("cells", lambda c: c.marked), " ").alias("pinyin"),
        _joined_bopomofo(F.col("cells")).alias("bopomofo"),
        english.alias("english"),
        "score",
        "wrong",
        exact.alias("exact_entry"),
        (exact & english.rlike(IDIOM_TAG)).alias("idiom"),
        F.size("words").alias("words"),
    )


def resolve_queries(queries: DataFrame, lexicon: DataFrame, key: str = "query_id", column: str = "text") -> DataFrame:
    """Rough spelling to ranked phrases for a whole table of queries; equal texts are resolved once."""
    unique = queries.select(F.col(column).alias("_text")).distinct()
    phrases = query_syllables(unique, syllable_inventory(lexicon), "_text", "_text")
    ranked = rank_interpretations(best_paths(phrases, lexicon, "_text"), "_text")
    return queries.select(key, F.col(column).alias("_text")).join(ranked, "_text").drop("_text")


def fuzzy_syllable_join(unknown: DataFrame, inventory: DataFrame) -> DataFrame:
    """(syllable, near) at edit distance 1 or less.

    Two spellings that close share themselves or one of their one-letter
    deletions, so an equi-join on those keys finds every pair.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        col = F.col(name)
        cuts = F.transform(
            F.sequence(F.lit(1), F.length(name)),
            lambda i: F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, F.length(col))),
        )
        return df.select(name, F.explode(F.array_distinct(F.concat(F.array(name), cuts))).alias("cut"))

    left = keyed(unknown.select("syllable").filter("syllable <> ''").distinct(), "syllable")
    right = keyed(inventory.select(F.col("syllable").alias("near")).distinct(), "near")
    return left.join(right, "cut").select("syllable", "near").distinct().filter(
        F.levenshtein("syllable", "near") <= 1
    )


def candidates(syllables: DataFrame, lexicon: DataFrame, key: str = "query_id", limit: int = 8) -> DataFrame:
    """(key, position, syllable) to frequent characters, taken in turn from each syllable.

    Unknown syllables borrow the characters of syllables one edit away. Per
    syllable the common characters come first; its first ``limit`` characters fill a row before a later one gets its turn.
    """
    chars = top_chars_by_syllable(lexicon).filter("frequent")
    has_chars = top_chars_by_syllable(lexicon).select("syllable").distinct()
    unique = syllables.select("syllable").distinct()
    unknown = unique.join(has_chars, "syllable", "left_anti")
    near = fuzzy_syllable_join(unknown, syllable_inventory(lexicon))
    reach = unique.withColumn("near", F.col("syllable")).unionByName(near)
    pool = reach.join(chars.select(F.col("syllable").alias("near"), "traditional", "simplified", "py_num", "english", "common", "rank"), "near")
    # one row per character and syllable; its place follows the inventory spelling and rank
    bucket = first_per_key(
        pool.withColumn("own", F.col("near") != F.col("syllable")),
        ["syllable", "traditional"],
        [F.col("own"), F.col("near"), F.col("rank")],
    )
    w = Window.partitionBy("syllable").orderBy(F.col("common").desc(), "own", "near", "rank")
    turns = bucket.withColumn("turn", F.row_number().over(w))
    offered = syllables.join(measured_side(turns.filter(F.col("turn") <= limit)), "syllable")
    once = first_per_key(offered, [key, "traditional"], [F.col("turn"), F.col("position")])
    return top_per_key(once, [key], [F.col("turn"), F.col("position")], limit, "place")


def _word_offsets(words: str) -> Column:
    """Number of Han characters before each word of an array of words."""
    return F.aggregate(
        words,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offsets")),
        lambda s, w: F.struct(
            (s.at + F.regexp_count(w, F.lit(HAN))).cast("int").alias("at"),
            F.concat(s.offsets, F.array(s.at)).alias("offsets"),
        ),
        lambda s: s.offsets,
    )


def annotate_readings(variants: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Per-character readings of (key, words array, pinyin).

    Given syllables align with Han characters by position; a dictionary entry
    with as many syllables as characters overrides them. Returns one row per
    word with its cells and a ``low`` flag per row; see ``low_confidence``.
    """
    cell = lambda c: F.struct(c.marked.alias("py"), c.bopomofo.alias("bpmf"))
    # syllables are spelled once a text and once an entry, not once a word
    texts = variants.select(
        key,
        "words",
        F.transform(spell(F.transform(words_of(F.col("pinyin")), marks_to_number)), cell).alias("given"),
        F.aggregate("words", F.lit(0), lambda n, w: n + F.regexp_count(w, F.lit(HAN))).alias("total"),
    )
    rows = texts.select(
        key,
        "given",
        "total",
        F.posexplode(F.arrays_zip(F.col("words").alias("word"), _word_offsets("words").alias("offset"))).alias("word_no", "w"),
    ).select(key, "given", "total", "word_no", "w.word", "w.offset")
    rows = rows.withColumn("chars", F.filter(characters(F.col("word")), lambda c: has_han(c)))
    entries = top_entries_by_headword(lexicon).filter("tier = 0")
    fitting = first_per_key(
        entries.withColumn("count", F.size(words_of(F.col("py_num")))).select("key", "count", "ord", "py_num"),
        ["key", "count"],
        [F.col("ord")],
    ).select(F.col("key").alias("word"), F.col("count").alias("_count"), F.transform(spell(F.split("py_num", r"\s+")), cell).alias("entry"))
    joined = rows.withColumn("_count", F.size("chars")).join(fitting, ["word", "_count"], "left")
    blank = F.struct(F.lit("").alias("py"), F.lit("").alias("bpmf"))
    joined = joined.withColumn("own", F.transform("chars", lambda c, i: F.coalesce(F.get(F.col("given"), F.col("offset") + i), blank)))
    return joined.select(
        key,
        "word_no",
        "word",
        F.zip_with("chars", F.coalesce("entry", "own"), lambda h, r: F.struct(h.alias("h"), r.py.alias("py"), r.bpmf.alias("bpmf"))).alias("cells"),
        (F.exists("own", lambda c: c.bpmf == "") | (F.size("given") != F.col("total"))).alias("low"),
    )


def low_confidence(annotated: DataFrame, key: str) -> DataFrame:
    """One flag per text: a missing, unwritable or miscounted syllable anywhere."""
    return annotated.groupBy(key).agg(F.bool_or("low").alias("low_confidence"))


def complete_variant(raw: DataFrame) -> DataFrame:
    """Fill simplified, marked and Bopomofo readings of (traditional, simplified, pinyin, variety)."""
    raw = raw.withColumn("_cells", spell(F.transform(words_of(F.col("pinyin")), marks_to_number)))
    marks = F.array_join(F.transform("_cells", lambda c: c.marked), " ")
    symbols = F.array_join(F.transform("_cells", lambda c: c.bopomofo), " ")
    canto = F.col("variety") == "zh-HK"
    return raw.select(
        *[c for c in raw.columns if c not in ("simplified", "pinyin", "_cells")],
        F.when(F.coalesce("simplified", F.lit("")) == "", F.col("traditional")).otherwise(F.col("simplified")).alias("simplified"),
        F.when(canto, F.col("pinyin")).otherwise(marks).alias("pinyin"),
        F.when(canto, "").otherwise(symbols).alias("bopomofo"),
    )


def choose_formal(pairs: DataFrame) -> DataFrame:
    """Formal falls back to casual where it has no Han; texts whose casual has none are dropped."""
    return pairs.filter(has_han(F.col("casual"))).withColumn(
        "formal", F.when(has_han(F.coalesce("formal", F.lit(""))), F.col("formal")).otherwise(F.col("casual"))
    )


def alternatives_filter(alternatives: DataFrame, key: str, n: int = 3) -> DataFrame:
    """First ``n`` alternatives (key, position), keeping those whose two registers are both sure."""
    usable = top_per_key(alternatives, [key], [F.col("position")], n)
    return usable.filter(~F.col("casual_low") & ~F.col("formal_low"))


def validate_variant(variants: DataFrame) -> DataFrame:
    """``valid``: Han count equals syllable count and each syllable can be written."""
    syllables = words_of(F.col("pinyin"))
    han = F.regexp_count("traditional", F.lit(HAN))
    writable = F.forall(spell(F.transform(syllables, marks_to_number)), lambda c: c.bopomofo != "")
    return variants.withColumn(
        "valid",
        F.when(F.col("variety") == "zh-HK", han > 0).otherwise((F.size(syllables) == han) & writable),
    )
