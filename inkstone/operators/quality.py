"""Error rates, recall and regression gates over reading results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkstone.functions.alignment import edit_distance, global_agreement
from inkstone.functions.text import char_overlap, characters, count_han, han_only, no_space
from inkstone.operators.common import PAGE_ROWS, measured_side, split_by_size
from inkstone.operators.overlap import PAGE_PAIRS, crowded_pages, phrase_hits, similar_on_page

# Characters that mark colloquial Cantonese, and those never written formally.
CANTO_MARKERS = "[唔嘅咗喺咁噉啲佢冇哋嚟睇畀俾啦囉喇嘛喎啩啱嚟靚]"
CANTO_ONLY = "[唔嘅咗喺噉哋冇佢睇嚟畀俾]"


def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in pairs], type=pa.int32())


def error_rate(got: Column, truth: Column) -> Column:
    """Edit distance over truth length; 1 where the truth is empty.

    Whole texts are compared, for which the built-in distance takes some 13 ns for each pair of characters.
    """
    distance = F.arrow_udf(_distances, "int")(got, truth)
    return F.when(F.length(truth) > 0, distance / F.length(truth)).otherwise(F.lit(1.0))


def cer(df: DataFrame, got: str = "got", truth: str = "truth", han: bool = True) -> DataFrame:
    """``cer`` per row, over Han characters unless ``han`` is off."""
    g, t = (han_only(F.col(got)), han_only(F.col(truth))) if han else (F.col(got), F.col(truth))
    # columns of their own, so that texts are reduced once
    rows = df.select("*", g.alias("_got"), t.alias("_truth"))
    return rows.withColumn("cer", F.round(error_rate(F.col("_got"), F.col("_truth")), 6)).drop("_got", "_truth")


def cer_report(rates: DataFrame) -> DataFrame:
    """Mean error rate and time per engine."""
    return rates.groupBy("engine").agg(
        F.count("*").alias("cases"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.avg("ms"), 6).alias("mean_ms")
    )


def syllable_error(df: DataFrame, key: str, got: str, truth: str) -> DataFrame:
    """Edit distance over syllables as a share of the longer reading.

    Each pair's syllables are renumbered as private characters by their place in
    the pair's own syllable list, so the built-in distance applies; no dictionary
    of all syllables is needed.
    """

    def parts(c: str) -> Column:
        return F.filter(F.split(F.regexp_replace(c, "[!?.,，。！？]", ""), " "), lambda s: s != "")

    rows = df.withColumn("_g", parts(got)).withColumn("_t", parts(truth))
    rows = rows.withColumn("_all", F.array_distinct(F.concat("_g", "_t")))

    def coded(c: str) -> Column:
        # U+E000 onwards; decode keeps the character inside the JVM
        return F.array_join(
            F.transform(
                c,
                lambda s: F.decode(
                    F.unhex(F.lpad(F.hex(F.lit(0xE000) + F.array_position(F.col("_all"), s)), 4, "0")), "UTF-16BE"
                ),
            ),
            "",
        )

    size = F.greatest(F.size("_g"), F.size("_t"))
    return rows.withColumn("error", F.when(size > 0, F.round(F.levenshtein(coded("_g"), coded("_t")) / size, 6))).drop("_g", "_t", "_all")


def reading_accuracy(df: DataFrame, got: str = "got", accepted: str = "accepted") -> DataFrame:
    return df.agg(F.count("*").alias("words"), F.round(F.avg(F.array_contains(accepted, F.col(got)).cast("int")), 6).alias("accuracy"))


def register_leak(df: DataFrame) -> DataFrame:
    """Share of formal texts with Cantonese-only characters and of casual ones without markers."""
    leaks = F.regexp_count("formal", F.lit(CANTO_ONLY)) > 0
    plain = F.regexp_count("casual", F.lit(CANTO_MARKERS)) == 0
    return df.agg(
        F.count("*").alias("texts"),
        F.round(F.avg(leaks.cast("int")), 6).alias("formal_leak"),
        F.round(F.avg(plain.cast("int")), 6).alias("casual_without_markers"),
    )


def known_phrase_recall(
    texts: DataFrame,
    phrases: DataFrame,
    key: str,
    floor: Column | None = None,
    units: Callable[[Column], Column] = characters,
    anywhere: bool = False,
) -> DataFrame:
    """Phrases (key, phrase) found in the text of the same key, against the floor of all but one.

    With ``anywhere`` a phrase may be in any text, and texts need no key. ``units`` cuts texts and phrases; by characters, a phrase is
    found wherever the text contains it, by words only at word borders. A key without a text has found none of its
    phrases; an empty or null phrase is never found.
    """
    keys = [] if anywhere else [key]
    cut = phrases.select(key, units(F.col("phrase")).alias("phrase"))
    hits = phrase_hits(cut, texts.select(*keys, units(F.col("text")).alias("words")), keys=keys).withColumn("_hit", F.lit(True))
    counted = cut.join(hits, [*keys, "phrase"], "left").groupBy(key).agg(F.count("*").alias("phrases"), F.count("_hit").alias("found"))
    least = floor if floor is not None else F.col("phrases") - 1
    return counted.withColumn("passes", F.col("found") >= least)


def duplicate_count(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows minus distinct texts per page."""
    return lines.groupBy(key).agg((F.count("*") - F.count_distinct("text")).alias("duplicates"))


def regression_gate(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """Pages against their floors and baseline: pass and the reasons against it.

    ``lines`` has page_id, text and vector ends; ``expected`` has page_id, w, h,
    min_blocks, max_dupes and baseline (null when there is none).
    """
    aggregates = [F.count("*").alias("blocks"), (F.count("*") - F.count_distinct("text")).alias("dupes")]
    for axis in ("x", "y"):
        aggregates.append(F.max(F.greatest(f"f{axis}", f"t{axis}")).alias(f"max_{axis}"))
        aggregates.append(F.min(F.least(f"f{axis}", f"t{axis}")).alias(f"min_{axis}"))
    rows = expected.join(lines.groupBy("page_id").agg(*aggregates), "page_id", "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(0))).withColumn("dupes", F.coalesce("dupes", F.lit(0)))
    far = F.greatest("w", "h") * 1.1
    out = (F.least("min_x", "min_y") < -100) | (F.greatest("max_x", "max_y") > far)
    cover = F.greatest((F.col("max_x") - F.col("min_x")) / F.col("w"), (F.col("max_y") - F.col("min_y")) / F.col("h"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("blocks") < F.col("min_blocks"), F.lit("few blocks")),
            F.when(F.col("dupes") > F.col("max_dupes"), F.lit("duplicates")),
            F.when(out, F.lit("out of bounds")),
            F.when(cover < 0.25, F.lit("collapsed")),
            F.when(
                F.col("baseline").isNotNull() & (F.col("blocks") < F.greatest("min_blocks", F.floor(F.col("baseline") * 0.7))),
                F.lit("below baseline"),
            ),
        )
    )
    return rows.select("page_id", "blocks", "dupes", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("passes"))


def ordered_truth_diff(served: DataFrame, truth: DataFrame, similar: float = 0.6, page_pairs: int = PAGE_PAIRS) -> DataFrame:
    """Truth lines matched in order by one served line or two joined: (page_id, truth_no, hit, span).

    A match looks only forward from the previous one. Candidate matches come from
    one join per page, on a page with more than ``page_pairs`` pairs by an index of the lines' characters; the forward walk runs
    over a page's truth lines.
    """
    w = Window.partitionBy("page_id").orderBy("position")
    lines = served.select("page_id", "position", "text", F.lead("text").over(w).alias("next"))
    crowded = crowded_pages(truth, lines, "page_id", page_pairs)
    near = truth if crowded is None else truth.join(crowded, "page_id", "left_anti")
    pairs = near.alias("t").join(lines.alias("s"), "page_id").select(
        "page_id",
        "truth_no",
        "position",
        F.when(char_overlap(F.col("s.text"), F.col("t.text")) >= similar, 1)
        .when(F.col("next").isNotNull() & (char_overlap(F.concat("s.text", "next"), F.col("t.text")) >= similar), 2)
        .alias("span"),
    )
    if crowded is not None:
        many, own = truth.join(crowded, "page_id", "left_semi"), lines.join(crowded, "page_id", "left_semi")
        two = own.filter("next is not null").select("page_id", "position", F.concat("text", "next").alias("text"))
        met = None
        for span, side in ((1, own), (2, two)):
            found = similar_on_page(many.withColumnRenamed("text", "said"), side, "page_id", "truth_no", "position", "said", "text", similar)
            found = found.select("page_id", "truth_no", "position", F.lit(span).alias("span"))
            met = found if met is None else met.unionByName(found)
        pairs = pairs.unionByName(met.groupBy("page_id", "truth_no", "position").agg(F.min("span").alias("span")))
    options = (
        pairs.filter("span is not null")
        .groupBy("page_id", "truth_no")
        .agg(F.array_sort(F.collect_list(F.struct("position", "span"))).alias("options"))
    )
    none = F.array().cast("array<struct<position:bigint,span:int>>")
    rows = truth.join(options, ["page_id", "truth_no"], "left").select(
        "page_id", "truth_no", F.coalesce(F.col("options").cast("array<struct<position:bigint,span:int>>"), none).alias("options")
    )
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("truth_no", "options"))).alias("t"))
    seed = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<truth_no:bigint,hit:bigint,span:int>>").alias("out")
    )

    def step(s: Column, t: Column) -> Column:
        pick = F.get(F.filter(t.options, lambda o: o.position >= s.at), F.lit(0))
        found = F.struct(t.truth_no.cast("bigint").alias("truth_no"), pick.position.alias("hit"), pick.span.alias("span"))
        return F.struct(F.coalesce(pick.position + pick.span, s.at).alias("at"), F.concat(s.out, F.array(found)).alias("out"))

    walked = pages.select("page_id", F.explode(F.aggregate("t", seed, step, lambda s: s.out)).alias("r"))
    return walked.select("page_id", "r.truth_no", "r.hit", "r.span")


def _page_units(have: DataFrame, want: DataFrame, limit: int) -> DataFrame:
    """(page_id, lines, hits, have, want) of two tables of texts (page_id, text): rows and characters of ``have``, those of ``want``, and what both share.

    Texts of pages with up to ``limit`` rows travel to their page and are taken apart there. Characters of larger pages are counted before
    they travel, so that such a page is no single task's work. No page's text is ever put together.
    """
    sides = have.select("page_id", "text", F.lit(True).alias("_have")).unionByName(want.select("page_id", "text", F.lit(False).alias("_have")))

    def counted(rows: DataFrame) -> DataFrame:
        # an empty text is one empty unit, so each row has exactly one in the first place
        units = rows.select("page_id", "_have", F.posexplode(F.split(F.coalesce("text", F.lit("")), "")).alias("_at", "unit"))
        mine, real = F.col("_have"), F.col("unit") != ""
        sums = units.groupBy("page_id", "unit").agg(
            F.count(F.when(mine & (F.col("_at") == 0), 1)).alias("lines"),
            F.count(F.when(mine & real, 1)).alias("have"),
            F.count(F.when(~mine & real, 1)).alias("want"),
        )
        return sums.groupBy("page_id").agg(
            F.sum("lines").alias("lines"), F.sum(F.least("have", "want")).alias("hits"), F.sum("have").alias("have"), F.sum("want").alias("want")
        )

    small, large = split_by_size(sides, "page_id", limit)
    out = counted(small.repartition("page_id"))
    return out if large is None else out.unionByName(counted(large))


def overlap_score_gate(lines: DataFrame, truth: DataFrame, limit: int = PAGE_ROWS) -> DataFrame:
    """Character overlap of a page's text with its truth, against floor and line count.

    ``truth`` has page_id, text, floor and min_lines.
    """
    have, want = (df.select("page_id", no_space(F.col("text")).alias("text")) for df in (lines, truth))
    sums = _page_units(have, want, limit)
    rows = truth.select("page_id", "floor", "min_lines").distinct().join(sums, "page_id", "left")
    score = F.coalesce(F.col("hits"), F.lit(0)) / F.greatest(F.lit(1), F.coalesce("want", F.lit(0)))
    n = F.coalesce("lines", F.lit(0))
    enough = n >= F.col("min_lines")
    return rows.select("page_id", n.alias("lines"), F.round(score, 6).alias("overlap"), ((score >= F.col("floor")) & enough).alias("passes"))


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pairs = [global_agreement(a, b) if a and b else ("", "") for a, b in zip(batch["a"], batch["b"])]
        yield batch.assign(confident=[c for c, _ in pairs], flagged=[f for _, f in pairs])


def char_agreement(reads: DataFrame) -> DataFrame:
    """Two reads (a, b) of one line to agreeing and flagged characters; equal pairs are aligned once and looked up."""
    unique = reads.select("a", "b").distinct()
    done = measured_side(unique.mapInPandas(_agree, "a string, b string, confident string, flagged string"))
    return reads.join(done, ["a", "b"]).withColumn("agree", F.length("confident"))


def precision_coverage(agreed: DataFrame, truth: DataFrame, limit: int = PAGE_ROWS) -> DataFrame:
    """Per page: share of truth characters the confident ones hit, and their share of the truth length."""
    sums = _page_units(agreed.select("page_id", F.col("confident").alias("text")), truth, limit)
    # a page whose texts are all empty has no characters to tell of
    sums = sums.filter((F.col("have") > 0) | (F.col("want") > 0))
    n = F.greatest(F.lit(1), F.col("want"))
    return sums.select("page_id", F.round(F.col("hits") / n, 6).alias("precision"), F.round(F.col("have") / n, 6).alias("coverage"))


def battery_mismatch(df: DataFrame) -> DataFrame:
    """Answers (text, response, want) classed none, echo or translate; mismatches and total per want."""
    t = F.trim("response")
    limit = F.greatest(F.lit(3.0), F.length("text") / 2)
    got = F.when(t.rlike(r"(?i)^none\.?$"), "none").when((t == F.trim("text")) | (count_han(t) > limit), "echo").otherwise("translate")
    return df.withColumn("got", got).groupBy("want").agg(
        F.count_if(F.col("got") != F.col("want")).alias("mismatched"), F.count("*").alias("total")
    )


def grade_counts(graded: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Lines (key, i) by the verdict a free-text answer gives them, the last verdict per line."""
    found = F.regexp_extract_all("answer", F.lit(r"(?i)([0-9]+\s*:\s*(?:good|wrong|partial))"), F.lit(1))
    verdicts = answers.select(key, F.posexplode(found).alias("_n", "v")).select(
        key, "_n", F.regexp_extract("v", "^([0-9]+)", 1).cast("bigint").alias("i"), F.lower(F.regexp_extract("v", r"([A-Za-z]+)$", 1)).alias("verdict")
    )
    last = verdicts.groupBy(key, "i").agg(F.max_by("verdict", "_n").alias("verdict"))
    rows = graded.join(last, [key, "i"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("missing")))
    return rows.groupBy(key).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("good", "partial", "wrong", "missing")]
    )


def char_conservation(raw: DataFrame, parsed: DataFrame, key: str, floor: float = 0.95) -> DataFrame:
    """Han characters that survived parsing, per text."""
    before = raw.groupBy(key).agg(F.sum(count_han(F.col("text"))).alias("raw_han"))
    after = parsed.groupBy(key).agg(F.sum(count_han(F.col("text"))).alias("parsed_han"))
    rows = before.join(after, key, "left").withColumn("parsed_han", F.coalesce("parsed_han", F.lit(0)))
    return rows.withColumn("passes", F.col("parsed_han") >= floor * F.col("raw_han"))


def line_alignment_check(words: DataFrame, truth: DataFrame, gap: int = 30) -> DataFrame:
    """Words grouped into lines where the upper edge jumps by ``gap``, against truth lines in order.

    Distinct upper edges are few (page height), so the grouping windows stay
    small however many words a page has.
    """
    w = Window.partitionBy("page_id").orderBy("y1")
    edges = words.groupBy("page_id", "y1").agg(F.max("y2").alias("y2"), F.min("x1").alias("x1"), F.count("*").alias("n"))
    jump = F.when(F.col("y1") - F.lag("y1").over(w) >= gap, 1).otherwise(0)
    lines = (
        edges.withColumn("_j", jump)
        .withColumn("line_no", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .groupBy("page_id", "line_no")
        .agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.min("x1").alias("x1"), F.sum("n").alias("words"))
    )
    t = truth.select("page_id", "line_no", F.col("y1").alias("ty1"), F.col("y2").alias("ty2"), F.col("x1").alias("tx1"))
    rows = lines.join(t, ["page_id", "line_no"], "left")
    d1, d2, dx = F.col("y1") - F.col("ty1"), F.col("y2") - F.col("ty2"), F.col("x1") - F.col("tx1")
    within = (F.abs(d1) < 45) & (F.abs(d2) < 55) & (F.abs(dx) < 30)
    return rows.select("page_id", "line_no", "words", d1.alias("dy1"), d2.alias("dy2"), dx.alias("dx1"), within.alias("within"))
