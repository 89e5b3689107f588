"""Longest-match segmentation of whole corpora, and lookups on its tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkstone.functions.text import HAN, characters, words_of
from inkstone.operators.common import measured_side
from inkstone.operators.lexicon import shown_senses

CHUNK = 256
#: Letters of all words up to which the word list is broadcast as a trie; a longer list meets the texts in a join.
TRIE_LETTERS = 4_000_000
_END = ""


class Trie:
    """Words by their letters. It travels as a list and is built once in each worker."""

    def __init__(self, words: list[str]):
        self.words = words

    @cached_property
    def root(self) -> dict:
        root: dict = {}
        for word in self.words:
            node = root
            for letter in word:
                node = node.setdefault(letter, {})
            node[_END] = True
        return root

    def tokens(self, run: str) -> list[str]:
        """Forward longest match, single letters where no word fits."""
        root, out, at = self.root, [], 0
        while at < len(run):
            node, end, here = root, at + 1, at
            while here < len(run) and (node := node.get(run[here])) is not None:
                here += 1
                if _END in node:
                    end = max(end, here)
            out.append(run[at:end])
            at = end
        return out


def trie_tokens(words: DataFrame, max_len: int) -> Callable[[Column], Column] | None:
    """The tokens of a run as a function of its column, by a broadcast trie; None if the words pass ``TRIE_LETTERS``."""
    held = words.select("word").filter(F.length("word").between(2, max_len)).distinct()
    if (held.agg(F.sum(F.length("word"))).first()[0] or 0) > TRIE_LETTERS:
        return None
    # bounded by the line above
    shared = words.sparkSession.sparkContext.broadcast(Trie(sorted(r["word"] for r in held.collect())))

    @F.arrow_udf("array<string>")
    def tokens(runs: pa.Array) -> pa.Array:
        # equal runs of a batch are walked once
        walk, coded = shared.value.tokens, runs.dictionary_encode()
        return pa.array([walk(r) for r in coded.dictionary.to_pylist()], type=pa.list_(pa.string())).take(coded.indices)

    return tokens


def cut_runs(texts: DataFrame, key: str, column: str) -> DataFrame:
    """One row per maximal Han or non-Han run of each text, in order."""
    runs = F.regexp_extract_all(column, F.lit(f"{HAN}+|[^{HAN}]+"), F.lit(0))
    return texts.select(key, F.posexplode(runs).alias("run_no", "run")).withColumn("han", F.col("run").rlike(HAN))


def han_runs(texts: DataFrame, key: str, column: str) -> DataFrame:
    """The Han runs alone, one row each, where order and separators do not matter."""
    return texts.select(key, F.explode(F.regexp_extract_all(column, F.lit(f"{HAN}+"), F.lit(0))).alias("run"))


def _walk(longest: Column, entry: Column) -> Column:
    """Token starts inside one chunk when the walk enters at ``entry``, and where it leaves."""
    start = F.struct(entry.cast("int").alias("next"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, i: Column) -> Column:
        taken = F.struct(
            (i + F.get(longest, i)).cast("int").alias("next"), F.concat(state.starts, F.array(i)).alias("starts")
        )
        return F.when(i == state.next, taken).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.size(longest) - 1), start, step)


def segment_runs(runs: DataFrame, words: DataFrame, max_len: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Distinct Han runs (column run) to (run, tokens).

    The words are broadcast as a trie, which walks each run once. A word list beyond its bound meets
    all n-grams of the runs in one join; only hits come back. There, the walk is a chain, but over a chunk it depends only on where it enters, one
    of ``max_len`` places. A long run is therefore walked chunk by chunk for every
    entry, and composing the exit tables gives each chunk its true entry.
    """
    walk = trie_tokens(words, max_len)
    if walk is not None:
        return runs.select("run", walk(F.col("run")).alias("tokens"))
    return _segment_by_join(runs, words, max_len, chunk)


def _segment_by_join(runs: DataFrame, words: DataFrame, max_len: int, chunk: int) -> DataFrame:
    keyed = runs.select("run", F.md5("run").alias("run_id"), F.ceil(F.length("run") / chunk).cast("int").alias("chunks"))
    pieces = keyed.select("run_id", "run", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    pieces = pieces.select(
        "run_id", "chunk_no", F.substring("run", F.col("chunk_no") * chunk + 1, F.lit(chunk + max_len - 1)).alias("body")
    )
    grams = (
        pieces.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(chunk), F.length("body")) - 1)).alias("at"))
        .select("*", F.explode(F.sequence(F.lit(2), F.lit(max_len))).alias("n"))
        .filter(F.col("at") + F.col("n") <= F.length("body"))
        .select("run_id", "chunk_no", "at", "n", F.substring("body", F.col("at") + 1, F.col("n")).alias("gram"))
    )
    lexicon = words.select(F.col("word").alias("gram")).filter(F.length("gram").between(2, max_len)).distinct()
    base = max_len + 1
    # one shuffle on the run serves both groupings; a run is a cell of its text, so its hits fit a row
    hits = (
        grams.join(lexicon, "gram", "left_semi")
        .select("run_id", "chunk_no", (F.col("at") * base + F.col("n")).cast("int").alias("hit"))
        .repartition("run_id")
        .groupBy("run_id", "chunk_no")
        .agg(F.collect_list("hit").alias("hits"))
        .groupBy("run_id")
        .agg(F.collect_list(F.struct("chunk_no", "hits")).alias("found"))
    )
    rows = keyed.join(hits, "run_id", "left")

    def with_hits(c: Column) -> Column:
        mine = F.get(F.filter("found", lambda f: f.chunk_no == c), F.lit(0)).hits
        body = F.substring(F.col("run"), c * chunk + 1, F.lit(chunk + max_len - 1))
        return F.struct(
            body.alias("body"), F.least(F.lit(chunk), F.length("run") - c * chunk).alias("size"), mine.alias("hits")
        )

    def with_longest(x: Column) -> Column:
        longest = F.transform(
            F.sequence(F.lit(0), x.size - 1),
            lambda i: F.coalesce(F.array_max(F.filter(x.hits, lambda h: (h >= i * base) & (h < i * base + base))) % base, F.lit(1)),
        )
        plain = F.transform(F.sequence(F.lit(0), x.size - 1), lambda i: F.lit(1))
        return F.struct(
            x.body.alias("body"), x.size.alias("size"), F.when(x.hits.isNull(), plain).otherwise(longest).alias("longest")
        )

    cut = F.transform(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), with_hits), with_longest)
    rows = rows.withColumn("cut", cut)
    exits = F.transform(
        "cut",
        lambda x: F.transform(F.sequence(F.lit(0), F.lit(max_len - 1)), lambda e: _walk(x.longest, e).next - x.size),
    )
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("entries"))
    folded = F.aggregate(
        exits,
        seed,
        lambda s, t: F.struct(F.get(t, s["at"]).alias("at"), F.concat(s.entries, F.array(s["at"])).alias("entries")),
        lambda s: s.entries,
    )
    rows = rows.withColumn("entries", F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(folded))
    tokens = F.zip_with(
        "cut",
        "entries",
        lambda x, e: F.transform(_walk(x.longest, e).starts, lambda i: F.substring(x.body, i + 1, F.get(x.longest, i))),
    )
    return rows.select("run", F.flatten(tokens).alias("tokens"))


def segment(texts: DataFrame, words: DataFrame, key: str, column: str, max_len: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(key, run_no, token_no, token, han): forward longest match of whole texts.

    ``words`` has one column, ``word``. The match state resets at every non-Han
    run, so runs are independent: by the broadcast trie nothing is shuffled. With a word list beyond its bound,
    equal runs are segmented once and joined back.
    """
    runs = cut_runs(texts, key, column)
    walk = trie_tokens(words, max_len)
    if walk is not None:
        tokens = F.when(F.col("han"), walk(F.when(F.col("han"), F.col("run")))).otherwise(F.array("run"))
        return runs.select(key, "run_no", F.posexplode(tokens).alias("token_no", "token"), "han")
    done = _segment_by_join(han_runs(texts, key, column).select("run").distinct(), words, max_len, chunk)
    han = (
        runs.filter("han")
        .join(done, "run")
        .select(key, "run_no", F.posexplode("tokens").alias("token_no", "token"), F.lit(True).alias("han"))
    )
    other = runs.filter("not han").select(
        key, "run_no", F.lit(0).alias("token_no"), F.col("run").alias("token"), F.lit(False).alias("han")
    )
    return han.unionByName(other)


def segment_words(texts: DataFrame, lexicon: DataFrame, key: str, column: str) -> DataFrame:
    """Dictionary-shaped words up to eight characters, Han only."""
    words = lexicon.select(F.col("traditional").alias("word")).union(lexicon.select("simplified")).distinct()
    return segment(texts, words, key, column, max_len=8).filter("han")


def word_cards(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with their entry; unknown tokens fall apart into one row per character.

    Tokens are read once. The senses shown are computed once, and up to a measured bound they are broadcast, so no token is shuffled.
    """
    keys = [c for c in tokens.columns if c != "token"]
    senses = measured_side(shown_senses(lexicon))
    whole = tokens.join(senses.select("token", F.col("_hit").alias("_whole")), "token", "left")
    pieces = F.when(F.col("_whole"), F.array("token")).otherwise(characters(F.col("token")))
    cards = whole.select(*keys, "_whole", F.posexplode(pieces).alias("char_no", "token")).join(senses, "token", "left")

    def shown(name: str, blank: Column) -> Column:
        return F.when(F.col("_whole"), F.col(name)).otherwise(F.coalesce(F.col(name), blank)).alias(name)

    return cards.select(
        "token",
        *keys,
        *[shown(name, F.col("token")) for name in ("traditional", "simplified")],
        *[shown(name, F.lit("")) for name in ("py_num", "english")],
        F.coalesce("_hit", F.lit(False)).alias("known"),
        "char_no",
    )


def coverage_report(cards: DataFrame, document: str) -> DataFrame:
    """Known and unknown share of the tokens of each document."""
    return cards.groupBy(document).agg(
        F.count("*").alias("tokens"),
        F.count_if("known").alias("known"),
        F.round(F.avg(F.col("known").cast("int")), 6).alias("known_rate"),
    )


def phrase_rows(words: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Whole-utterance forms of word rows, for documents with two or more words.

    ``words`` are the words of one utterance, a request-sized text.
    """
    cell = F.struct(*order, "traditional", "simplified", "py_num")
    grouped = words.groupBy(document).agg(F.array_sort(F.collect_list(cell)).alias("w")).filter(F.size("w") >= 2)
    readings = F.filter(F.transform("w", lambda x: x.py_num), lambda p: p != "")
    return grouped.select(
        document,
        F.array_join(F.transform("w", lambda x: x.traditional), "").alias("traditional"),
        F.array_join(F.transform("w", lambda x: x.simplified), "").alias("simplified"),
        F.array_join(readings, " ").alias("py_num"),
        F.size("w").alias("words"),
    )


def annotate_cantonese(tokens: DataFrame, word_readings: DataFrame, char_readings: DataFrame) -> DataFrame:
    """Readings of Han tokens: the word's own, else the best one of a single character.

    ``jyut`` is null where unknown; ``cells`` pairs each character with its
    syllable, blank unless syllables and characters align.
    """
    w = word_readings.select(F.col("word").alias("token"), F.col("reading").alias("_word"))
    c = char_readings.filter("rank = 1").select(F.col("char").alias("token"), F.col("reading").alias("_char"))
    read = tokens.filter("han").join(w, "token", "left").join(c, "token", "left")
    jyut = F.when(F.length("token") > 1, F.col("_word")).otherwise(F.col("_char"))
    read = read.withColumn("jyut", jyut).drop("_word", "_char")
    chars, syllables = characters(F.col("token")), words_of(F.coalesce("jyut", F.lit("")))
    blank = F.transform(chars, lambda h: F.struct(h.alias("h"), F.lit("").alias("py")))
    paired = F.zip_with(chars, syllables, lambda h, s: F.struct(h.alias("h"), s.alias("py")))
    return read.withColumn("cells", F.when(F.size(chars) == F.size(syllables), paired).otherwise(blank))
