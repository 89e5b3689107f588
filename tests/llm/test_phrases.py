"""Phrase mining and its parse against plain counting."""

import random
import re
from collections import Counter

import pytest

from inkstone.llm import phrases
from inkstone.llm.parsing import OVERLAP, chunks, stream


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
        words = re.findall("[^\x20\x09]+", piece)
        if words:
            yield words


def plain(rows, least, top, covered=80):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for w in pieces(text):
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in candidates.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        hidden = any(
            other == lang and len(v) > len(w) and 100 * b >= covered * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            for (other, v), b in candidates.items()
        )
        if not hidden:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, total[lang], -score)
        for lang, own in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1)
    )


def corpus(seed=9):
    rnd = random.Random(seed)
    words = ["a", "B", "cc", "dé", "É", "x1", "of", "the", "中", "z\x00", "\xa0w"]
    long = " ".join(rnd.choice(words) for _ in range(300))
    out = [(None, "en"), ("", None), (" .,;", "en"), ("one", "de"), ("a a a a a a " * 400, "en"), ("b\tc " * 90, None)]
    for _ in range(120):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!?"]) for _ in range(rnd.randint(1, 60)))
        out.append((text + (long if rnd.random() < 0.4 else ""), rnd.choice(["en", "de", None, "und"])))
    return out + [(long, "de")] * 20


@pytest.mark.parametrize("numbers,bound", [(phrases.NUMBERED, 0), (15, phrases.BITMAP_BYTES), (0, 0)])
@pytest.mark.parametrize("top,modulus", [(2000, 32), (7, 4)])
def test_phrases_equal_plain_counts(spark, monkeypatch, numbers, bound, top, modulus):
    """By numbers; with too many pairs for that, by texts and bitmaps; by texts alone."""
    monkeypatch.setattr(phrases, "NUMBERED", numbers)
    monkeypatch.setattr(phrases, "BITMAP_BYTES", bound)
    monkeypatch.setattr(phrases, "STEP", 5000)
    rows = corpus()
    docs = spark.createDataFrame([(t, lang, 1, "p") for t, lang in rows], "text string, lang string, n int, phrase string")
    found = sorted(map(tuple, phrases.collocations(docs, least=30, top=top, modulus=modulus).collect()))
    assert found == plain(rows, 30, top) and found


def test_no_texts(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_chunks_share_one_window_and_say_the_stream():
    streams = [s for s in (stream(t or "") for t, _ in corpus()) if s]
    told = {}
    for k, chunk in chunks(streams, 8):
        told.setdefault(k, []).append(chunk.split(b" "))
    assert sorted(told) == list(range(len(streams)))
    for k, own in told.items():
        for a, b in zip(own, own[1:]):
            assert a[-OVERLAP:] == b[:OVERLAP]
        joined = [w for c in own for w in c[:-OVERLAP]] + own[-1][-OVERLAP:]
        assert joined == streams[k].split(b" ")


def test_chunks_depend_on_content_alone():
    rnd = random.Random(4)
    shared = " ".join(str(rnd.randint(0, 99)) for _ in range(400))
    found = []
    for before in ("", "x y z ", "some other words in front. "):
        found.append({c for _, c in chunks([stream(before + shared)], 8)})
    assert len(found[0] & found[1] & found[2]) > 0.8 * len(found[0])


def test_more_frequent_words_than_bits_still_thin(spark, monkeypatch):
    """A bitmap at its bound gets coarser; no level is counted as texts without one."""
    monkeypatch.setattr(phrases, "NUMBERED", 0)
    monkeypatch.setattr(phrases, "BITMAP_BYTES", 1024)
    monkeypatch.setattr(phrases, "PART_BITS", 10)
    made, make = [], phrases.bitmap_of
    monkeypatch.setattr(phrases, "bitmap_of", lambda *a: made.append(make(*a)) or made[-1])
    rnd = random.Random(3)
    rows = [(" ".join(f"w{rnd.randint(0, 399)} x{k % 7}" for _ in range(300)), "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = sorted(map(tuple, phrases.collocations(docs, least=5, top=50).collect()))
    assert found == plain(rows, 5, 50) and found
    assert len(made) == 4 and None not in made and all(b.value.bits.nbytes <= 1024 for b in made)


def test_words_are_counted_without_being_spelled_out(spark):
    parsed = phrases.dictionary(spark.createDataFrame([("a b a. a", "en"), ("a", "de")], "text string, lang string"), 32)
    counts = phrases.word_counts(parsed)
    assert {r.lang: r.f for r in counts.filter("lang is not null").collect()} == {"en": 4, "de": 1}
    assert sorted(r.f for r in counts.filter("lang is null").collect()) == [1, 1, 3]
    assert "phrase" not in counts.columns
