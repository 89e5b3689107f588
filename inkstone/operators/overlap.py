"""Similarity of texts by shared units, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkstone.functions.text import characters
from inkstone.operators.common import measured_side
from inkstone.session import cut_lineage

#: Rows of the smaller side up to which it is broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Places of a unit on one side up to which they stay together; a more frequent one is cut into cells.
CELL = 4096
#: Window starts of one part of a text.
PART = 64
#: Pairs of rows of one page up to which they simply meet.
PAGE_PAIRS = 1 << 18
#: Words by which phrases are looked up.
ANCHOR = 6


def windows(texts: DataFrame, words: str, sizes: list[int], reach: int | None = None, part: int = PART) -> DataFrame:
    """``texts`` without ``words``, one row for each run of so many words as ``sizes`` tells.

    A text is first cut into parts, so that what a row carries has the same bound for any length of text. ``window_words``
    is the part, ``window_at`` the place of the window's first word in it, ``window_size`` its number of words and ``window_hash``
    their hash; from that place the part holds ``reach`` words (the largest size by default), or all that the text has left. A text
    of fewer words has no window.
    """
    rest = [c for c in texts.columns if c != words]
    least, most = min(sizes), max(sizes)
    # an empty list and no filter: a filter would have the words cut twice, the first time where the text is read
    starts = F.when(F.size(words) >= least, F.sequence(F.lit(1), F.size(words) - least + 1, F.lit(part)))
    parts = texts.select(*rest, words, F.explode(starts).alias("_from"))
    parts = parts.select(*rest, F.slice(words, F.col("_from"), part + (reach or most) - 1).alias("window_words"))

    def runs(n: int) -> Column:
        last = F.least(F.lit(part), F.size("window_words") - n + 1) - 1
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        cell = lambda i: F.struct(F.lit(n).alias("size"), i.alias("at"), F.xxhash64(*[F.get("window_words", i + k) for k in range(n)]).alias("hash"))
        return F.transform(places, cell)

    cells = parts.select(*rest, "window_words", F.explode(F.concat(*map(runs, sizes)) if len(sizes) > 1 else runs(least)).alias("_w"))
    return cells.select(*rest, "window_words", F.col("_w.size").alias("window_size"), F.col("_w.at").alias("window_at"), F.col("_w.hash").alias("window_hash"))


def phrase_hits(phrases: DataFrame, texts: DataFrame, words: str = "words", keys: list[str] | None = None) -> DataFrame:
    """(phrase, *keys): the distinct phrases that occur.

    ``phrases`` has arrays ``phrase``, ``texts`` has arrays ``words``, both of any length. A phrase occurs if a
    text (with the same ``keys``, if given) holds its words in a row. Windows of the texts meet the phrases' first words, six at most, by
    hash, and are compared word by word. Up to ``BROADCAST_ROWS`` phrases are broadcast. Beyond that, equal windows are first
    combined in each task, so a passage that many texts share is one row of each. Null and empty phrases never occur.
    """
    keys = keys or []
    anchored = F.least(F.size("phrase"), F.lit(ANCHOR)).alias("window_size")
    wanted = cut_lineage(phrases.filter(F.size("phrase") > 0).select(*keys, "phrase", anchored).distinct())
    # at most ANCHOR rows
    lengths = wanted.groupBy("window_size").agg(F.max(F.size("phrase")).alias("reach"), F.count("*").alias("n")).collect()
    if not lengths:
        return wanted.select(*keys, "phrase")
    sizes, reach = sorted(r["window_size"] for r in lengths), max(r["reach"] for r in lengths)
    small = sum(r["n"] for r in lengths) <= BROADCAST_ROWS
    first = None
    for n in sizes:
        h = F.xxhash64(*[F.get("phrase", F.lit(k)) for k in range(n)])
        first = F.when(F.col("window_size") == n, h) if first is None else first.when(F.col("window_size") == n, h)
    wanted = wanted.withColumn("window_hash", first)
    seen = windows(texts.select(*keys, words), words, sizes, reach)
    run = F.slice("window_words", F.col("window_at") + 1, reach)
    on = [*keys, "window_size", "window_hash"]
    if small:
        met = seen.join(F.broadcast(wanted), on)
    else:
        met = seen.select(*on, run.alias("_run")).distinct().join(wanted, on)
        run = F.col("_run")
    return met.filter(F.slice(run, 1, F.size("phrase")) == F.col("phrase")).select(*keys, "phrase").distinct()


def text_classes(texts: DataFrame, key: str, words: str = "words") -> DataFrame:
    """One row for each distinct sequence of words: the least key, the number of its copies, and the words.

    Copies are counted once, however often the rows are read.
    """
    copies = texts.groupBy(F.md5(F.array_join(words, " ")).alias("_digest")).agg(F.min(key).alias(key), F.count("*").alias("copies"))
    return texts.select(key, words).join(measured_side(copies.select(key, "copies")), key)


def bags(texts: DataFrame, key: str, words: str, wanted: DataFrame | None = None) -> DataFrame:
    """(key, unit, n, total): how often each unit (of ``wanted``, if given) occurs in each text, and the text's number of all units."""
    sized = texts.select(key, F.size(words).cast("bigint").alias("total"), F.explode(words).alias("unit"))
    if wanted is not None:
        sized = sized.join(wanted, "unit", "left_semi")
    return sized.groupBy(key, "total", "unit").agg(F.count("*").alias("n"))


def _prefixes(own: DataFrame, key: str, rarity: DataFrame, threshold: float) -> DataFrame:
    """(key, total, unit) of the rarest units of each text, so many that what is left can't reach the threshold by itself.

    ``own`` need only have units of both sides: those of one side are never shared, so what is left is made of the others.
    """
    order = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("unit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = own.join(rarity.select("unit", "df"), "unit").withColumn("_reach", F.sum("n").over(order))
    return ranked.filter(F.col("_reach") >= F.ceil(F.lit(threshold) * F.col("total") - 1e-9)).select(key, "total", "unit")


def _meet(short: DataFrame, long: DataFrame, a: str, b: str, rarity: DataFrame, smaller: Column) -> DataFrame:
    """Distinct candidate pairs (a, b) that share a unit of the short one's prefix; frequent units meet in cells.

    A unit with more than ``CELL`` places on a side is cut into so many chunks that each cell stays small: every place
    goes to all cells of its chunk's row or column, and each pair of places meets in exactly one.
    """
    many = rarity.filter(F.greatest("left_df", "right_df") > CELL)
    chunks = many.select("unit", F.ceil(F.col("left_df") / CELL).cast("int").alias("_rows"), F.ceil(F.col("right_df") / CELL).cast("int").alias("_cols"))

    def dealt(df: DataFrame, key: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        marked = df.join(chunks, "unit", "left")
        chunk = F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int")
        return marked.select(key, F.col("total").alias(f"_{key}_total"), "unit", chunk.alias(mine), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(theirs))

    left, right = dealt(short, a, "_rows", "_cols", "_i", "_j"), dealt(long, b, "_cols", "_rows", "_j", "_i")
    return left.join(right, ["unit", "_i", "_j"]).filter(smaller).select(a, b).distinct()


def similar_bags(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float, words: str = "words", of: str = "shorter"
) -> DataFrame:
    """(left_key, right_key, shared, left_total, right_total, score) of texts whose units agree, as multisets.

    ``score`` is the number of shared units, each as often as both have it, over the units of the shorter text (with ``of`` =
    "left", of the left one); pairs of at least ``threshold`` come back, and all of them. The units of all texts are ordered by frequency. A pair can only
    reach the threshold if one of the shorter text's rarest units is in the longer one, so only those meet;
    candidates are then counted exactly. Empty texts are similar to nothing. Keys must be unique on each side and not null.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a share above zero")
    b = cut_lineage(bags(right, right_key, words))
    # units of one side alone are never shared; a text's own total counts them
    a = cut_lineage(bags(left, left_key, words, measured_side(b.select("unit").distinct())))
    count_a, count_b = (df.groupBy("unit").agg(F.count("*").alias(name)) for df, name in ((a, "left_df"), (b, "right_df")))
    rarity = measured_side(count_a.join(count_b, "unit").withColumn("df", F.col("left_df") + F.col("right_df")))
    shared_b = b.join(rarity.select("unit"), "unit", "left_semi")
    swapped = rarity.select("unit", F.col("right_df").alias("left_df"), F.col("left_df").alias("right_df"))
    la, lb = F.col(f"_{left_key}_total"), F.col(f"_{right_key}_total")
    either = F.lit(of == "left")
    pairs = _meet(_prefixes(a, left_key, rarity, threshold), shared_b, left_key, right_key, rarity, either | (la <= lb))
    if of != "left":
        second = _meet(_prefixes(shared_b, right_key, rarity, threshold), a, right_key, left_key, swapped, lb < la)
        pairs = pairs.unionByName(second.select(left_key, right_key))
    # a pair is in one of the two alone, since one text is the shorter
    pairs = measured_side(pairs)
    own = a.select(left_key, "unit", F.col("n").alias("_ln"), F.col("total").alias("left_total")).join(pairs, left_key)
    other = shared_b.select(right_key, "unit", F.col("n").alias("_rn"), F.col("total").alias("right_total"))
    both = own.join(other, [right_key, "unit"])
    rows = both.groupBy(left_key, right_key, "left_total", "right_total").agg(F.sum(F.least("_ln", "_rn")).alias("shared"))
    score = F.col("shared") / (F.col("left_total") if of == "left" else F.least("left_total", "right_total"))
    return rows.select(left_key, right_key, "shared", "left_total", "right_total", score.alias("score")).filter(F.col("score") >= threshold - 1e-12)


def crowded_pages(left: DataFrame, right: DataFrame, page: str, pairs: int = PAGE_PAIRS) -> DataFrame | None:
    """The pages on which left and right rows make more than so many pairs; None if there are none."""
    sizes = left.groupBy(page).agg(F.count("*").alias("_l")).join(right.groupBy(page).agg(F.count("*").alias("_r")), page)
    crowded = cut_lineage(sizes.filter(F.col("_l") * F.col("_r") > pairs).select(page))
    return None if crowded.isEmpty() else crowded


def similar_on_page(
    left: DataFrame, right: DataFrame, page: str, left_key: str, right_key: str, left_text: str, right_text: str, threshold: float, of: str = "shorter"
) -> DataFrame:
    """(page, left_key, right_key) of texts of one page that are similar by characters, as ``similar_bags`` has it.

    The characters of each page are units of their own, so a page that holds a third of all rows meets by its rare characters, in
    many tasks, and rows of different pages never meet.
    """

    def bag(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        own = F.transform(characters(F.col(text)), lambda c: F.concat_ws("\u0001", F.col(page).cast("string"), c))
        return df.select(F.struct(page, key).alias(name), own.alias("words"))

    found = similar_bags(bag(left, left_key, left_text, "_a"), bag(right, right_key, right_text, "_b"), "_a", "_b", threshold, of=of)
    return found.select(F.col(f"_a.{page}").alias(page), F.col(f"_a.{left_key}").alias(left_key), F.col(f"_b.{right_key}").alias(right_key), "left_total", "right_total")


def shared_shingles(left: DataFrame, right: DataFrame, left_key: str, right_key: str, words: str = "words", n: int = 8) -> DataFrame:
    """(left_key, right_key, shared, left_total, right_total, score) of texts with a common run of ``n`` words.

    The texts meet in the runs' hashes and only those that do are compared by words, so what shares none never meets.
    A text of fewer words is one run by itself. Up to ``BROADCAST_ROWS`` runs of the right side are broadcast; beyond that, both
    sides are shuffled by hash and words. Counts are combined before they are shuffled. ``score`` is the share of the smaller text's distinct
    runs that both have.
    """

    def units(df: DataFrame, key: str, name: str) -> DataFrame:
        """Runs with the words that hold them, spelled out by ``run`` where two meet."""
        own = df.select(F.col(key).alias(name), F.col(words).alias("_words"))
        long = windows(own, "_words", [n]).drop("window_size")
        whole = F.when((F.size("_words") > 0) & (F.size("_words") < n), F.array("_words"))
        short = own.select(name, F.explode(whole).alias("window_words")).select(
            name, "window_words", F.lit(0).alias("window_at"), F.xxhash64("window_words").alias("window_hash")
        )
        return long.unionByName(short)

    run = F.array_join(F.slice("window_words", F.col("window_at") + 1, n), " ")

    def totals(df: DataFrame, key: str, name: str, total: str) -> DataFrame:
        return units(df, key, name).groupBy(name).agg(F.count_distinct("window_hash", run).alias(total))

    b = cut_lineage(units(right, right_key, "_r").select("_r", "window_hash", run.alias("run")).distinct())
    a = units(left, left_key, "_l")
    if b.count() <= BROADCAST_ROWS:
        met = a.join(F.broadcast(b), "window_hash").filter(run == F.col("run"))
    else:
        met = a.select("_l", "window_hash", run.alias("run")).join(b, ["window_hash", "run"])
    pairs = cut_lineage(met.select("_l", "_r", "window_hash", "run").distinct().groupBy("_l", "_r").agg(F.count("*").alias("shared")))
    # runs are only counted for the texts that have a pair
    with_pair = left.join(pairs.select(F.col("_l").alias(left_key)).distinct(), left_key, "left_semi")
    rows = pairs.join(totals(with_pair, left_key, "_l", "left_total"), "_l").join(b.groupBy("_r").agg(F.count("*").alias("right_total")), "_r")
    score = F.col("shared") / F.least("left_total", "right_total")
    return rows.select(F.col("_l").alias(left_key), F.col("_r").alias(right_key), "shared", "left_total", "right_total", score.alias("score"))
