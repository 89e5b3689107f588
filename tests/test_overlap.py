"""Phrase search and similarity joins against brute force."""

import random
from collections import Counter

import pytest

from inkstone.functions.text import words_of
from inkstone.operators import overlap
from inkstone.operators.quality import known_phrase_recall


def bags_of(seed, n, longest):
    rnd = random.Random(seed)
    words = ["the"] * 8 + ["of"] * 4 + [f"w{k}" for k in range(30)]
    out = [[], ["the"], ["the", "the", "of"], ["rare"] * 5]
    shared = [f"run{k}" for k in range(12)]
    for k in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(1, longest))]
        out.append(text + shared if k % 3 == 0 else text)
    return out


@pytest.mark.parametrize("threshold", [0.4, 0.8, 1.0])
@pytest.mark.parametrize("cell", [4096, 7])
def test_similar_bags_equal_all_pairs(spark, monkeypatch, threshold, cell):
    """A third of the texts hold one run; small cells cut its units."""
    monkeypatch.setattr(overlap, "CELL", cell)
    left, right = bags_of(1, 90, 40), bags_of(2, 40, 90)
    a = spark.createDataFrame(list(enumerate(left)), "l int, words array<string>")
    b = spark.createDataFrame(list(enumerate(right)), "r int, words array<string>")
    found = {(r.l, r.r): (r.shared, r.left_total, r.right_total) for r in overlap.similar_bags(a, b, "l", "r", threshold).collect()}
    expected = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            shared, least = sum((Counter(x) & Counter(y)).values()), min(len(x), len(y))
            if least and shared >= threshold * least - 1e-9:
                expected[i, j] = (shared, len(x), len(y))
    assert found == expected and len(found) > 30


def test_similar_bags_of_nothing(spark):
    none = spark.createDataFrame([], "l int, words array<string>")
    some = spark.createDataFrame([(1, ["a"])], "r int, words array<string>")
    assert overlap.similar_bags(none, some, "l", "r", 0.5).count() == 0
    with pytest.raises(ValueError):
        overlap.similar_bags(none, some, "l", "r", 0)


def test_text_classes_count_copies(spark):
    texts = spark.createDataFrame([(3, ["a", "b"]), (2, ["a", "b"]), (5, ["ab"]), (7, [])], "k int, words array<string>")
    assert sorted((r.k, r.copies, r.words) for r in overlap.text_classes(texts, "k").collect()) == [(2, 2, ["a", "b"]), (5, 1, ["ab"]), (7, 1, [])]


@pytest.mark.parametrize("n,bound", [(3, overlap.BROADCAST_ROWS), (8, 0)])
def test_shared_shingles_equal_all_pairs(spark, monkeypatch, n, bound):
    monkeypatch.setattr(overlap, "BROADCAST_ROWS", bound)
    left, right = bags_of(3, 40, 200), bags_of(4, 30, 60)
    a = spark.createDataFrame(list(enumerate(left)), "l int, words array<string>")
    b = spark.createDataFrame(list(enumerate(right)), "r int, words array<string>")
    runs = lambda w: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    expected = {(i, j): (len(runs(x) & runs(y)), len(runs(x)), len(runs(y))) for i, x in enumerate(left) for j, y in enumerate(right) if runs(x) & runs(y)}
    found = {(r.l, r.r): (r.shared, r.left_total, r.right_total) for r in overlap.shared_shingles(a, b, "l", "r", n=n).collect()}
    assert found == expected and len(found) > 30


@pytest.mark.parametrize("bound", [overlap.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("part", [64, 5])
def test_phrases_are_found_wherever_they_stand(spark, monkeypatch, bound, part):
    monkeypatch.setattr(overlap, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(overlap, "PART", part)
    rnd = random.Random(5)
    texts = [None, "", "one", "w1 w2"] + [" ".join(f"w{rnd.randint(0, 6)}" for _ in range(rnd.choice([3, 40, 300]))) for _ in range(30)]
    texts += ["boiler plate of many words that all of them hold"] * 15
    phrases = [(k, " ".join(f"w{rnd.randint(0, 6)}" for _ in range(rnd.randint(1, 9)))) for k in range(40) for _ in range(4)]
    phrases += [(1, "plate of many words that all of"), (2, "plate of many word"), (3, None), (4, ""), (50, "w0"), (50, "w0"), (60, "absent")]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, words string")
    table = spark.createDataFrame(phrases, "k int, phrase string")
    found = {r.k: (r.phrases, r.found, r.passes) for r in known_phrase_recall(docs, table, "k", units=words_of, anywhere=True).collect()}
    held = [f" {t or ''} " for t in texts]
    expected = {}
    for k in {k for k, _ in phrases}:
        own = [p for i, p in phrases if i == k]
        hits = sum(bool(p) and any(f" {p} " in t for t in held) for p in own)
        expected[k] = (len(own), hits, hits >= len(own) - 1)
    assert found == expected and found[60] == (1, 0, True)


def test_phrases_by_key_are_substrings_of_the_keys_text(spark):
    texts = spark.createDataFrame([(1, "小心地滑"), (2, "地上"), (None, "小心")], "k int, text string")
    phrases = spark.createDataFrame([(1, "心地"), (1, "地上"), (2, "心地"), (3, "小")], "k int, phrase string")
    rows = {r.k: (r.phrases, r.found) for r in known_phrase_recall(texts, phrases, "k").collect()}
    assert rows == {1: (2, 1), 2: (1, 0), 3: (1, 0)}


def test_units_of_one_side_are_left_out_where_texts_are_cut(spark, monkeypatch):
    a = spark.createDataFrame([(i, ["own%d" % k for k in range(50)] + ["x"] * 2) for i in range(9)] + [(9, ["x", "x", "y", "own0"])], "l long, words array<string>")
    b = spark.createDataFrame([(0, ["x", "y"]), (1, ["z"])], "r long, words array<string>")
    rows = {}
    held = overlap.cut_lineage
    monkeypatch.setattr(overlap, "cut_lineage", lambda df: (lambda out: rows.update({tuple(out.columns): out.count()}) or out)(held(df)))
    found = {(r.l, r.r, r.shared, r.left_total, r.right_total) for r in overlap.similar_bags(a, b, "l", "r", 0.7).collect()}
    assert found == {(9, 0, 2, 4, 2)}
    assert rows[("l", "total", "unit", "n")] == 11
