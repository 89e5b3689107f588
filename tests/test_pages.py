import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.functions.alignment import global_agreement, local_alignment
from inkstone.functions.geometry import quad_of_box, struct_iou
from inkstone.operators import boxes as bx, fusion as fs, lines as ln
from inkstone.operators.greedy import greedy_keep, greedy_replace
from inkstone.functions.geometry import struct_overlap_smaller


def iou(a, b):
    ix, iy = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if ix <= 0 or iy <= 0:
        return 0
    inter = ix * iy
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(7)
    rows = []
    for page, n in ((1, 5), (2, 90), (3, 60)):
        for i in range(n):
            x, y = rng.randrange(0, 120, 6), rng.randrange(0, 90, 6)
            rows.append((page, i, x, y, x + rng.choice([30, 36, 42]), y + 24, "ab" * rng.randint(1, 3), rng.random()))
    return rows, spark.createDataFrame(rows, "page_id int, item int, x1 int, y1 int, x2 int, y2 int, text string, score double")


@pytest.mark.parametrize("limit", [1000, 10])
def test_greedy_keep_is_the_same_on_large_pages(crowd, limit):
    rows, df = crowd
    want = set()
    for page in (1, 2, 3):
        kept = []
        for r in [r for r in rows if r[0] == page]:
            if not any(iou(k[2:6], r[2:6]) >= 0.6 for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    out = greedy_keep(df, "page_id", ["item"], lambda k, x: struct_iou(k, x) >= 0.6, ["x1", "y1", "x2", "y2"], limit=limit, cell=32)
    assert {(r.page_id, r.item) for r in out.collect()} == want


@pytest.mark.parametrize("limit", [1000, 10])
def test_greedy_replace_is_the_same_on_large_pages(crowd, limit):
    rows, df = crowd

    def smaller(a, b):
        ix, iy = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return max(ix, 0) * max(iy, 0) / min((a[4] - a[2]) * (a[5] - a[3]), (b[4] - b[2]) * (b[5] - b[3]))

    want = set()
    for page in (1, 2, 3):
        kept = []
        for r in [r for r in rows if r[0] == page]:
            at = next((i for i, k in enumerate(kept) if smaller(k, r) >= 0.6), None)
            if at is None:
                kept.append(r)
            elif (len(r[6]), r[7]) > (len(kept[at][6]), kept[at][7]):
                kept[at] = r
        want |= {(r[0], r[1]) for r in kept}
    out = greedy_replace(
        df, "page_id", ["item"], lambda k, x: struct_overlap_smaller(k, x) >= 0.6,
        lambda x, k: (F.length(x.text) > F.length(k.text)) | ((F.length(x.text) == F.length(k.text)) & (x.score > k.score)), limit=limit, cell=32,
    )
    assert {(r.page_id, r.item) for r in out.collect()} == want


def test_column_gap_is_filled(spark):
    xs = [100, 160, 220, 280, 340, 400, 520, 580]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "page_id int, item int, x int")
    quads = df.withColumn("pts", quad_of_box(F.col("x") - 20, F.lit(0), F.col("x") + 20, F.lit(400)))
    made = bx.fill_column_gaps(quads).collect()
    assert len(made) == 1 and (made[0].pts[0].x + made[0].pts[1].x) / 2 == 460


def test_heal_coordinates(spark):
    df = spark.createDataFrame([(1, 20, 30, 560, 110, 900, 700, False)], "page_id int, x1 int, y1 int, x2 int, y2 int, w int, h int, has_vector boolean")
    r = bx.heal_coordinates(df).collect()[0]
    assert (r.x1, r.y1, r.x2, r.y2) == (18, 21, 504, 77)


def test_merge_collinear(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 100, 20), (1, 1, 110, 2, 200, 22), (1, 2, 0, 60, 100, 80)], "page_id int, item int, a int, b int, c int, d int")
    quads = df.withColumn("pts", quad_of_box(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    got = {r.item: r.members for r in bx.merge_collinear(quads).collect()}
    assert got == {0: 2, 2: 1}


def test_repeats(spark):
    march = [(1, i, "同", 10 + 50 * i, 10, 40 + 50 * i, 30) for i in range(5)]
    apart = [(2, i, "同", x, y, x + 30, y + 20) for i, (x, y) in enumerate([(0, 0), (300, 10), (40, 500)])]
    df = spark.createDataFrame(march + apart, "page_id int, item int, text string, x1 int, y1 int, x2 int, y2 int")
    got = {(r.page_id, r.item) for r in ln.heal_repetition(df).collect()}
    assert got == {(1, 0), (2, 0), (2, 1), (2, 2)}


def test_chain(spark):
    rows = [(1, 0, "甲乙", 0.0, 0.0, 40.0, 0.0, 0, 0, 40, 20), (1, 1, "丙", 42.0, 0.0, 62.0, 0.0, 42, 0, 62, 20), (1, 2, "丁", 300.0, 0.0, 320.0, 0.0, 300, 0, 320, 20)]
    df = spark.createDataFrame(rows, "page_id int, item int, text string, fx double, fy double, tx double, ty double, x1 int, y1 int, x2 int, y2 int")
    got = {r.item: (r.text, r.x2) for r in ln.chain_continuations(df).collect()}
    assert got == {0: ("甲乙丙", 62), 2: ("丁", 320)}


def test_alignment_kernels():
    a0, a1, b0, b1, score, matched = local_alignment(list("太傅大人"), list("明望太傅大人親啟"))
    assert (a0, a1, b0, b1, matched) == (0, 4, 2, 6, 4) and score == 4
    assert local_alignment(list("ab"), list("cd")) is None
    assert global_agreement("abcd", "abxd") == ("abd", "c")


def test_fusion_improves_and_seats(spark):
    items = spark.createDataFrame(
        [(1, 0, 100, 0, 140, 200, 0.9, "甲乙丙丁"), (1, 1, 200, 0, 240, 200, 0.9, "戊己庚辛"), (1, 2, 400, 0, 440, 200, 0.9, "壬癸子丑")],
        "page_id int, item int, x1 int, y1 int, x2 int, y2 int, score double, text string",
    )
    answers = spark.createDataFrame(
        [(1, 0, "甲乙丙丁戌", "v"), (1, 1, "天地玄黃", "v")], "page_id int, line int, text string, dir string"
    )
    dims = spark.createDataFrame([(1, 600, 300)], "page_id int, w int, h int")
    fused = fs.fuse_pages(items, answers, dims)
    lines = {r.text: r for r in fs.lines_contract(fused["lines"]).collect()}
    assert set(lines) == {"甲乙丙丁戌", "戊己庚辛", "壬癸子丑", "天地玄黃"}
    seat = lines["天地玄黃"]
    assert seat.inferred and seat.char_boxes is not None and 240 < (seat.x1 + seat.x2) / 2 < 400
    served = fs.serve_decision(items, fused).collect()[0]
    assert served.served_by == "fusion"


def _texts(seed, n, longest=14):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("天地玄黃宇宙洪荒日月盈昃") for _ in range(rnd.randint(1, longest))) for _ in range(n // 3)]
    return ["", "天", "天地"] + [rnd.choice(base) if rnd.random() < 0.5 else rnd.choice(base) + rnd.choice(base)[:3] for _ in range(n)]


@pytest.mark.parametrize("accepted", [False, True])
def test_alignment_is_the_same_on_crowded_pages(spark, accepted):
    frags = [(p, i, t) for p in (1, 2) for i, t in enumerate(_texts(p, 30 * p))]
    reads = [(p, i, t) for p in (1, 2, 3) for i, t in enumerate(_texts(p + 7, 25, 30))]
    f = spark.createDataFrame(frags, "page_id int, item int, norm string")
    c = spark.createDataFrame(reads, "page_id int, line int, norm string")
    plain = sorted(map(tuple, fs.align_pairs(f, c).select("page_id", "item", "line", "f_start", "c_end", "matched", "accepted").collect()))
    if accepted:
        plain = [r for r in plain if r[-1]]
    for pairs in (1 << 20, 0):
        found = fs.align_pairs(f, c, accepted_only=accepted, page_pairs=pairs)
        assert sorted(map(tuple, found.select("page_id", "item", "line", "f_start", "c_end", "matched", "accepted").collect())) == plain and plain


def test_variant_lines_are_the_same_on_crowded_pages(spark):
    rows = [(p, i, t) for p in (1, 2) for i, t in enumerate(_texts(p, 60))]
    df = spark.createDataFrame(rows, "page_id int, line int, norm string")
    plain = sorted((r.page_id, r.line, r.first) for r in fs.group_variant_lines(df).collect())
    split = sorted((r.page_id, r.line, r.first) for r in fs.group_variant_lines(df, page_pairs=0).collect())
    assert plain == split and {f for _, _, f in plain} == {True, False}


def test_truth_diff_is_the_same_on_crowded_pages_and_equals_a_walk(spark):
    from collections import Counter

    from inkstone.operators.quality import ordered_truth_diff

    served = [(p, i, t) for p in (1, 2) for i, t in enumerate(_texts(p, 25))]
    truth = [(p, i, t) for p in (1, 2) for i, t in enumerate(_texts(p, 25)[::2])]
    s = spark.createDataFrame(served, "page_id int, position bigint, text string")
    t = spark.createDataFrame(truth, "page_id int, truth_no bigint, text string")

    def alike(a, b):
        return sum((Counter(a) & Counter(b)).values()) / max(1, min(len(a), len(b))) >= 0.6

    want = []
    for page in (1, 2):
        own, at = [x for p, _, x in served if p == page], 0
        for no, line in [(i, x) for p, i, x in truth if p == page]:
            hit = next(((i, span) for i in range(at, len(own)) for span in (1, 2) if i + span <= len(own) and alike("".join(own[i : i + span]), line)), None)
            want.append((page, no, *(hit or (None, None))))
            at = sum(hit) if hit else at
    for pairs in (1 << 20, 0):
        found = ordered_truth_diff(s, t, page_pairs=pairs)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_chains_merge_in_the_order_of_the_first_pair():
    import math

    import pandas as pd

    def plain(rows):
        rows = [dict(r) for r in rows]

        def joins(a, b):
            reach = 0.8 * math.hypot(a["tx"] - a["fx"], a["ty"] - a["fy"]) / max(1, len(a["text"]))
            turn = abs(math.degrees(math.atan2(a["ty"] - a["fy"], a["tx"] - a["fx"]) - math.atan2(b["ty"] - b["fy"], b["tx"] - b["fx"])))
            return math.hypot(b["fx"] - a["tx"], b["fy"] - a["ty"]) <= reach and min(turn, 360 - turn) <= 15

        while True:
            pair = next(((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and joins(a, b)), None)
            if pair is None:
                return [(r["item"], r["text"], r["tx"], r["x1"], r["x2"]) for r in rows]
            a, b = rows[pair[0]], rows.pop(pair[1]) if pair[1] > pair[0] else rows[pair[1]]
            if pair[1] < pair[0]:
                rows.pop(pair[1])
            a.update(text=a["text"] + b["text"], tx=b["tx"], ty=b["ty"])
            for lo, hi in (("x1", "x2"), ("y1", "y2")):
                a[lo], a[hi] = min(a[lo], b[lo]), max(a[hi], b[hi])

    rnd = random.Random(3)
    merged = 0
    for _ in range(200):
        rows = []
        for k in range(rnd.randint(2, 25)):
            x, y, n = rnd.randint(0, 200), rnd.randint(0, 30), rnd.randint(1, 4)
            tx, ty = x + rnd.randint(5, 60), y + rnd.randint(-4, 4)
            rows.append({"page_id": 1, "item": k, "text": "abcd"[:n], "fx": x, "fy": y, "tx": tx, "ty": ty, "x1": x, "y1": y, "x2": tx, "y2": ty})
        out = ln._chain_group(pd.DataFrame(rows).sample(frac=1, random_state=1))
        assert [(r["item"], r["text"], r["tx"], r["x1"], r["x2"]) for r in out.to_dict("records")] == plain(rows)
        merged += len(rows) - len(out)
    assert merged > 200


def test_a_character_map_is_bounded(spark):
    from inkstone.operators.lexicon import map_characters

    texts = spark.createDataFrame([("ab",)], "t string")
    many = spark.range(120_001).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    with pytest.raises(ValueError):
        map_characters(texts, {"t": "u"}, many, "a", "b")


def test_chains_in_rows_equal_chains_of_pieces(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for page in range(30):
        for k in range(rnd.randint(1, 12)):
            x, y, n = rnd.randint(0, 120), rnd.randint(0, 20), rnd.randint(1, 4)
            tx, ty = x + rnd.randint(5, 60), y + rnd.randint(-4, 4)
            vector = (float(x), float(y), float(tx), float(ty)) if k % 7 else (None,) * 4
            rows.append((page, k, "abcd"[:n], *vector, x, y, tx, y + 9))
    df = spark.createDataFrame(rows, "page_id int, item int, text string, fx double, fy double, tx double, ty double, x1 int, y1 int, x2 int, y2 int")
    pieces = sorted(map(tuple, ln.chain_continuations(df, limit=0).collect()), key=str)
    # ordinary pages leave the JVM as numbers, many to a batch, not one by one
    monkeypatch.setattr(ln, "_chain_group", None)
    whole = ln.chain_continuations(df)
    assert "FlatMapGroupsInPandas" not in whole._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, whole.collect()), key=str)
    assert whole == pieces and len(whole) < len(rows) - 20


def test_collinear_in_rows_equal_crowded_pages(spark):
    rnd = random.Random(6)
    rows = [(page, k, rnd.randrange(0, 300, 3), rnd.randrange(0, 60, 4), rnd.randint(8, 40), rnd.randint(8, 24)) for page in range(30) for k in range(rnd.randint(1, 14))]
    df = spark.createDataFrame(rows, "page_id int, item int, x int, y int, w int, h int")
    quads = df.select("page_id", "item", quad_of_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("pts"))
    whole = bx.merge_collinear(quads)
    # quads travel once
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    crowded = sorted(map(tuple, bx.merge_collinear(quads, limit=0).collect()), key=str)
    assert sorted(map(tuple, whole.collect()), key=str) == crowded and len(crowded) < len(rows) - 20


def test_a_page_right_at_the_pitch_limit_passes_in_any_order(spark):
    import itertools

    rows = []
    # spread over mean is exactly 0.6: the limit is not passed
    for page, widths in enumerate(w for ws in ((204, 140, 48, 48), (36, 90, 18, 36), (24, 24, 12, 60)) for w in itertools.permutations(ws)):
        rows += [(page, k, 0, 0, w, 20, "abc", 0.9) for k, w in enumerate(widths)]
    df = spark.createDataFrame(rows, "page_id int, item int, x1 int, y1 int, x2 int, y2 int, text string, score double")
    assert {r.reason for r in bx.page_gate(df.coalesce(1)).collect()} == {None}


def test_alignments_of_many_pairs_equal_those_one_by_one():
    from inkstone.functions.alignment import local_alignments

    texts = _texts(3, 300, 20)
    a, b = texts[:150] + ["", "x", ""], texts[150:300] + ["ab", "", ""]
    found = local_alignments(a, b)
    for i, (x, y) in enumerate(zip(a, b)):
        one = local_alignment(list(x), list(y))
        many = tuple(found[k][i] for k in ("f_start", "f_end", "c_start", "c_end", "score", "matched"))
        assert many[4] == 0 if one is None else many == one


def test_pairs_are_aligned_where_they_meet(spark):
    f = spark.createDataFrame([(1, "a", "abc def")], "page_id long, item string, norm string")
    c = spark.createDataFrame([(1, 0, "xabc", "xabc")], "page_id long, line long, norm string, clean string")
    windows = fs.align_pairs(f, c)
    assert windows.select("f_start", "f_end", "c_start", "c_end", "score", "matched").collect() == [(0, 3, 1, 4, 3.0, 3)]
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(fragment" not in plan


def test_a_page_is_degenerate_with_or_without_the_overlaps_of_the_others(spark):
    rng = random.Random(5)
    boxes = [(p, i, x, y, x + 30, y + 20) for p in range(12) for i in range(p % 4 + 1) for x, y in [(rng.randrange(12), rng.randrange(9))]]
    lines = [(p, k) for p in range(12) for k in range(p % 5)]
    items = spark.createDataFrame(boxes, "page_id int, item int, x1 int, y1 int, x2 int, y2 int")
    unmatched = spark.createDataFrame(lines, "page_id int, line int")
    both = [{tuple(r) for r in bx.lattice_degenerate(items, unmatched, v).select("page_id", "fragments", "unmatched", "degenerate").collect()} for v in (False, True)]
    assert both[0] == both[1] and any(r[3] for r in both[0])


def test_seats_travel_without_characters(spark):
    chars = "array<struct<char:string,box:struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>,anchored:boolean>>"
    box = [("a", (0, 0, 10, 10), True), ("b", (10, 0, 20, 10), True)]
    fused = spark.createDataFrame([(1, box, 0), (1, box, 0), (2, box, 0)], f"page_id long, chars {chars}, angle int")
    rows = fs.page_lattice(fused, spark.createDataFrame([(1,)], "page_id long"))
    assert "chars" not in rows.columns and {tuple(r) for r in rows.select("page_id", "px", "py", "pitch", "start", "cross").collect()} == {(1, 15.0, 5.0, 10, 5.0, 5.0)}


def test_rereads_in_rows_equal_those_of_crowded_pages(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for page, n in ((1, 1), (2, 60), (3, 25)):
        for i in range(n):
            x, y = rng.randrange(0, 90, 6), rng.randrange(0, 60, 6)
            text = rng.choice(["ab", "ba", "abc", "abcd", "dcba", "ab cd ef", "天地玄黃", "黃玄地", "xyz天地", "abxy"])
            box = (None, None, None, None) if rng.random() < 0.05 else (x, y, x + rng.choice([18, 30, 42]), y + 24)
            rows.append((page, i, *box, text, rng.choice([0.5, 0.7, None])))
    df = spark.createDataFrame(rows, "page_id int, item int, x1 int, y1 int, x2 int, y2 int, text string, score double")
    found = sorted(map(tuple, bx.dedupe_items(df).select("page_id", "item", "text", "norm").collect()))
    # the fold by expressions, as pages were decided before
    monkeypatch.setattr(bx, "_dedupe_in_rows", lambda small, overlap, similar: small.limit(0))
    monkeypatch.setattr(bx, "split_by_size", lambda df, page, limit: (df, df))
    plain = sorted(map(tuple, bx.dedupe_items(df).select("page_id", "item", "text", "norm").collect()))
    assert found == plain and len(found) < len(rows)


def test_staged_measures_equal_those_in_arrays(spark):
    rng = random.Random(2)
    pts = [[(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(4)] for _ in range(60)] + [None, [(0.0, 0.0)] * 4]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pts)], "item int, pts array<struct<x:double,y:double>>")
    assert sorted(map(str, bx.staged_measures(df).collect())) == sorted(map(str, bx.quad_measures(df).collect()))
    assert bx.staged_measures(df).schema.names == bx.quad_measures(df).schema.names


def test_column_gaps_in_rows_equal_those_of_crowded_pages(spark):
    rng = random.Random(4)
    rows = []
    for page in range(40):
        for k in sorted(rng.sample(range(9), rng.randrange(2, 9))) + [3] * rng.randrange(2):
            x, w = 90 * k + rng.randrange(4), rng.choice([20, 30])
            rows.append((page, len(rows), x, rng.randrange(9), x + w, 400) if rng.random() < 0.95 else (page, len(rows), x, 0, x + 500, 9))
    df = spark.createDataFrame(rows, "page_id int, item int, x1 int, y1 int, x2 int, y2 int")
    quads = df.select("page_id", "item", quad_of_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("pts"))
    found, crowded = (sorted(map(str, bx.fill_column_gaps(quads, limit=n).collect())) for n in (512, 0))
    assert found == crowded and found


def test_quads_and_columns_of_a_page_travel_once(spark):
    box = [(0.0, 0.0), (30.0, 0.0), (30.0, 400.0), (0.0, 400.0)]
    quads = spark.createDataFrame([(1, k, box) for k in range(5)], "page_id long, item int, pts array<struct<x:double,y:double>>")
    for made in (bx.fill_column_gaps(quads), bx.dedupe_quads(quads)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_quads_kept_in_rows_equal_those_of_crowded_pages(spark):
    rng = random.Random(6)
    rows = []
    for page, n in ((1, 1), (2, 60), (3, 9), (4, 0)):
        for i in range(n):
            x, y, lean = rng.randrange(0, 60, 6), rng.randrange(0, 40, 6), rng.choice([0, 0, 3])
            w, h = rng.choice([(30, 20), (36, 20), (20, 44)])
            rows.append((page, i, [(float(x), float(y)), (float(x + w), float(y + lean)), (float(x + w), float(y + h + lean)), (float(x), float(y + h))], "t"))
        rows.append((page, n, None, "none"))
    df = spark.createDataFrame(rows, "page_id int, item int, pts array<struct<x:double,y:double>>, text string")
    found, crowded = (bx.dedupe_quads(df, limit=n) for n in (512, 0))
    assert found.columns == crowded.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, crowded.collect())) and 4 < found.count() < len(rows)


def _boxes_of(df):
    return [tuple(r) for r in ln.word_boxes(df).orderBy("item", "token_no", "char_no").select("item", "token_no", "char_no", "word", "wx1", "wy1", "wx2", "wy2").collect()]


def test_tokens_of_long_and_short_lines_get_their_places(spark):
    rng = random.Random(3)
    lines = [["ab", "", "c"], [], ["𠀀天"], [rng.choice(["a", "bc", "", "天地玄"]) for _ in range(300)]]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "page_id int, item int, tokens array<string>")
    found = {(r.item, r.token_no): (r.token, r.start, r.total) for r in ln.token_offsets(df).collect()}
    assert found == {(i, k): (w, len("".join(t[:k])), max(1, len("".join(t)))) for i, t in enumerate(lines) for k, w in enumerate(t)}


def test_word_boxes_with_and_without_vectors_and_measured_characters(spark):
    rows = [(1, 0, ["ab", "天地玄", ""], 0, 0, 50, 10, "h"), (1, 1, ["abc"], 0, 0, 10, 31, "v")]
    df = spark.createDataFrame(rows, "page_id int, item int, tokens array<string>, x1 int, y1 int, x2 int, y2 int, dir string")
    tokens = ln.token_offsets(df).withColumn("known", F.length("token") == 2)
    plain = [(0, 0, 0, "ab", 0, 0, 20, 10)] + [(0, 1, k, c, 20 + 10 * k, 0, 30 + 10 * k, 10) for k, c in enumerate("天地玄")] + [(1, 0, k, c, *b) for k, (c, b) in enumerate(zip("abc", [(0, 0, 3, 31), (3, 0, 7, 31), (7, 0, 10, 31)]))]
    assert _boxes_of(tokens) == plain
    # lines without a vector or measured characters need none of their arithmetic
    assert "char_boxes" not in ln.word_boxes(tokens)._jdf.queryExecution().optimizedPlan().toString()
    none = F.lit(None).cast("double")
    empty = tokens.select("*", *[none.alias(c) for c in ("fx", "fy", "tx", "ty")])
    assert _boxes_of(empty) == plain
    vector = tokens.select("*", *[F.lit(v).alias(c) for c, v in (("fx", 0.0), ("fy", 5.0), ("tx", 50.0), ("ty", 5.0))])
    assert _boxes_of(vector)[:2] == [(0, 0, 0, "ab", 0, -5, 20, 15), (0, 1, 0, "天", 20, 0, 30, 10)]
    box = F.struct(F.lit(1).cast("long").alias("x1"), F.lit(2).cast("long").alias("y1"), F.lit(3).cast("long").alias("x2"), F.lit(4).cast("long").alias("y2"))
    measured = vector.withColumn("char_boxes", F.array(box, box, box))
    assert [r[4:] for r in _boxes_of(measured)[:3]] == [(1, 2, 3, 4), (1, 2, 3, 4), (None, None, None, None)]


@pytest.mark.parametrize("heal", [ln.drop_rereads, ln.marching_clones, ln.boxless_flood_cap, ln.heal_repetition])
def test_repeats_in_rows_equal_those_of_crowded_pages(spark, heal):
    rng = random.Random(8)
    rows = []
    for page in range(14):
        for i in range(rng.randrange(1, 30)):
            x, y = rng.choice([(0, 40 * i), (rng.randrange(4), 0), (50 * (i % 3), 2 * i)])
            boxed = page % 3 > 0 or rng.random() < 0.9
            box = (x, y, x + rng.choice([40, 44]), y + 20) if boxed else (None, None, None, None)
            rows.append((page, i, rng.choice(["a", "b", None, "rare %d" % i]), *box))
    df = spark.createDataFrame(rows, "page_id int, item int, text string, x1 int, y1 int, x2 int, y2 int")
    found, mixed, crowded = (sorted(map(str, heal(df, limit=n).collect())) for n in (512, 5, 0))
    assert found == mixed == crowded and 0 < len(found) < len(rows)
    assert heal(df).columns == df.columns
    # the lines travel once
    assert heal(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def _counted(have, want):
    from collections import Counter

    a, b = Counter(c for t in have for c in t or ""), Counter(c for t in want for c in t or "")
    return sum((a & b).values()), sum(a.values()), sum(b.values())


@pytest.mark.parametrize("limit", [512, 4, 0])
def test_characters_of_pages_are_counted_on_the_page_or_before(spark, limit):
    from inkstone.operators import quality as ql

    rng = random.Random(9)
    texts = ["a b", "bca", "", None, "天地 天", "𠀀𠀀", "  "]
    have = [(p, rng.choice(texts)) for p in range(8) for _ in range(p)]
    want = [(p, rng.choice(texts)) for p in range(1, 9) for _ in range(3)]
    lines, truth = (spark.createDataFrame(rows, "page_id long, text string") for rows in (have, want))
    passed = ql.overlap_score_gate(lines, truth.select("*", F.lit(0.5).alias("floor"), F.lit(2).alias("min_lines")), limit=limit)
    expected, shares = {}, {}
    for p in range(1, 9):
        a, b = ([t for q, t in rows if q == p] for rows in (have, want))
        hits, _, total = _counted([(t or "").replace(" ", "") for t in a], [(t or "").replace(" ", "") for t in b])
        expected[p] = (len(a), round(hits / max(1, total), 6), hits / max(1, total) >= 0.5 and len(a) >= 2)
        hits, confident, total = _counted(a, b)
        if confident or total:
            shares[p] = (round(hits / max(1, total), 6), round(confident / max(1, total), 6))
    assert {r.page_id: (r.lines, r.overlap, r.passes) for r in passed.collect()} == expected
    found = ql.precision_coverage(lines.withColumnRenamed("text", "confident"), truth, limit=limit)
    assert {r.page_id: (r.precision, r.coverage) for r in found.collect()} == shares


def test_texts_of_ordinary_pages_travel_once_and_equal_pairs_are_looked_up(spark):
    from inkstone.operators import quality as ql

    reads = spark.createDataFrame([(1, 0, "abc", "ab"), (1, 1, "abc", "ab")], "page_id long, item int, a string, b string")
    agreed = ql.char_agreement(reads)
    assert "hashpartitioning(a" not in agreed._jdf.queryExecution().executedPlan().toString()
    shares = ql.precision_coverage(agreed, reads.select("page_id", F.col("a").alias("text")))
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(page_id") == plan.count("Exchange hashpartitioning") == 1
    assert shares.collect() == [(1, 0.666667, 0.666667)]


def test_reading_order_is_the_same_on_crowded_pages(spark):
    from inkstone.operators.boxes import reading_order_items

    rnd = random.Random(8)

    def some(low, high):
        return rnd.randint(low, high) if rnd.random() < 0.95 else None

    rows = [(rnd.choice([1, 1, 2, 3, None]), i, some(0, 300), some(0, 300), some(20, 400), some(20, 400), "甲" * rnd.randint(0, 3)) for i in range(240)]
    df = spark.createDataFrame(rows, "page_id int, item int, x1 int, y1 int, x2 int, y2 int, text string")
    for single in (True, False):
        plain, split = (reading_order_items(df, single, limit) for limit in (512, 0))
        assert plain.columns == split.columns
        assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect())) and plain.count()


def test_reads_of_many_pages_are_decided_as_those_of_one():
    from inkstone.operators.boxes import _reads_that_stay

    rnd = random.Random(2)
    counts = np.array([rnd.choice([0, 1, 2, 7]) for _ in range(60)])
    n = int(counts.sum())
    box = np.array([[rnd.randint(0, 30) + (60 if side > 1 else 0) for _ in range(n)] for side in range(4)], float)
    norms = [rnd.choice(["天地玄黃", "天地玄", "宇宙洪荒", None, ""]) for _ in range(n)]
    size, score = [rnd.choice([None, 2, 3]) or 0 for _ in range(n)], np.array([rnd.random() for _ in range(n)])
    found = _reads_that_stay(counts, box, norms, size, score, 0.6, 0.5)
    ends = np.cumsum(counts).tolist()
    one = [_reads_that_stay(np.array([j - i]), box[:, i:j], norms[i:j], size[i:j], score[i:j], 0.6, 0.5)[0] for i, j in zip([0, *ends], ends)]
    assert found == one and sum(map(len, found)) < n


def test_shared_characters_are_counted_for_all_pairs_at_once(monkeypatch):
    from collections import Counter

    from inkstone.functions import alignment

    monkeypatch.setattr(alignment, "COUNTED", 7)
    a, b = _texts(1, 60) + [None], _texts(2, 60) + ["天"]
    want = [sum((Counter(x or "") & Counter(y or "")).values()) for x, y in zip(a, b)]
    assert alignment.shared_characters(a, b).tolist() == want and any(want)


def test_markers_become_gaps(spark):
    texts = ["⟪1⟫ab⟪2.5⟫c⟪d⟪3⟫", "a😀⟪2⟫⟪4⟫", "⟪⟪2⟫x", "plain", "a⟪b", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: (r.clean, r.gaps and [tuple(g) for g in r.gaps]) for r in fs.read_answers(df).collect()}
    assert got == {
        texts[0]: ("abcd", [(2, 2.5), (4, 3.0)]), texts[1]: ("a😀", [(2, 2.0), (2, 4.0)]), texts[2]: ("x", []), "plain": ("plain", []), "a⟪b": ("ab", []), "": ("", []),
        None: (None, None),
    }
    # one step for each marker, none for each character
    assert "aggregate(" not in fs.read_answers(df)._jdf.queryExecution().optimizedPlan().toString()


def test_characters_of_fragments_without_a_box(spark):
    rows = [(1, "甲😀", 0, 0, 10, 20), (2, "a", None, 0, 10, 20), (3, "", 0, 0, 10, 20), (4, None, 0, 0, 10, 20), (5, "ab", 0, 0, 40, 10)]
    df = spark.createDataFrame(rows, "item int, text string, x1 int, y1 int, x2 int, y2 int")
    got = {r.item: ([(c.char, c.box and tuple(c.box), c.anchored) for c in r.chars], r.angle) for r in fs.fragment_chars(df).collect()}
    assert got[1] == ([("甲", (0, 0, 10, 10), True), ("😀", (0, 10, 10, 20), True)], 90)
    assert got[2][0][0][0] == "a" and got[2][0][0][1][:1] == (None,)
    assert got[3][0] == got[4][0] == []
    assert got[5] == ([("a", (0, -5, 20, 15), True), ("b", (20, -5, 40, 15), True)], 0)


def test_outlines_of_the_kernel_are_those_of_the_characters(spark):
    rnd = random.Random(6)
    rows = [(i, "天😀a"[: rnd.randint(0, 3)] * rnd.randint(1, 3), *(rnd.randint(0, 90) for _ in range(2)), *(rnd.randint(95, 300) for _ in range(2))) for i in range(80)]
    rows += [(80, None, 0, 0, 9, 9), (81, "ab", None, 0, 9, 9)]
    lines = fs.fragment_chars(spark.createDataFrame(rows, "item int, text string, x1 int, y1 int, x2 int, y2 int"), with_outline=True)
    again = fs.outlined(lines.drop("outline")).select("item", F.col("outline").alias("own"))
    both = lines.join(again, "item").select("item", "outline", "own", "text", "x1").collect()
    # without letters there is nothing to be boxed; a box without numbers still is one
    assert all(r.outline == r.own or not r.text for r in both) and len(both) == 82
    assert all(not r.outline.boxed and not r.own.boxed and r.outline.n == 0 for r in both if not r.text)
    seats = spark.createDataFrame(
        [(1, 1, 50.0, 60.0, 3.0, 0.6, 0.8, 20.0, 5.0, 100, None), (1, 2, 10.0, 90.0, 3.0, 1.0, 0.0, 21.0, 5.0, 200, 300)],
        "page_id int, seat int, sx double, sy double, page_angle double, ax double, ay double, pitch double, base double, w int, h int",
    )
    groups = spark.createDataFrame([(1, k, k, "h", t) for k, t in enumerate(["x", "甲乙丙", "😀b", ""])], "page_id int, group int, line int, dir string, clean string")
    placed = fs.place_lines(groups.withColumn("gaps", F.lit(None).cast(fs.GAP_TYPE)), seats)
    own = fs.outlined(placed.drop("outline")).select("line", F.col("outline").alias("own"))
    both = placed.join(own, "line").collect()
    assert all(r.outline == r.own or not r.text for r in both) and [r.outline.boxed for r in sorted(both, key=lambda r: r.line)] == [False, True, True, False]
