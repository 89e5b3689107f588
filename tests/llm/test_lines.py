"""Line dedup, the cuckoo filter and the reversible index against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from inkstone.llm import line_dedup
from inkstone.llm.cuckoo import CuckooFilter, Shards

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(texts, least, chars=1, others=()):
    """(kept text, lines, dropped) of each text, counting ``others`` too."""
    found = Counter()
    for text in [*texts, *others]:
        found.update({k for k in map(key, (text or "").split("\n")) if len(k) >= chars})
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not (len(key(line)) >= chars and found[key(line)] >= least)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def texts(seed=3, n=150):
    rnd = random.Random(seed)
    common = ["Share this page", "  SHARE this PAGE\r", "(c) all rights reserved", "École", "école", "x", "\t"]
    out = [None, "", "\n", "\n\n", " \x0b", "one line", "a" * 200_000, "\n".join(["again"] * 5000)]
    for _ in range(n):
        lines = [rnd.choice(common) if rnd.random() < 0.4 else f"line {rnd.randint(0, 300)}" for _ in range(rnd.randint(1, 30))]
        out.append("\n".join(lines))
    return out + ["the same\nrow"] * 12


@pytest.mark.parametrize("bound", [line_dedup.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("chars", [1, 3])
def test_lines_equal_plain_version(spark, monkeypatch, bound, chars):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
    rows = [(k if k != 4 else None, t, "mine", 1) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, line_dedup string, n_lines int")
    found = line_dedup.drop_frequent_lines(docs, 10, chars)
    assert found.columns == [*docs.columns, "line_dedup_"]
    expected = [(i, *own) for (i, *_), own in zip(rows, plain(texts(), 10, chars))]
    assert sorted(map(repr, ((r["doc_id"], *r["line_dedup_"]) for r in found.collect()))) == sorted(map(repr, expected))
    assert {(r["line_dedup"], r["n_lines"]) for r in found.collect()} == {("mine", 1)}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.drop_frequent_lines(docs).count() == 0


def test_index_follows_insertions_and_deletions(spark, tmp_path):
    parts = [texts(seed, 60) for seed in (1, 2, 3)]
    frames = [spark.createDataFrame([(k, t) for k, t in enumerate(p)], "doc_id int, text string") for p in parts]
    # small shards, so that their number changes between versions
    index = line_dedup.LineIndex(spark, f"{tmp_path}/index", min_docs=25, keys_per_shard=40)
    assert [r["line_dedup"]["n_dropped"] for r in index.clean(frames[0]).limit(3).collect()] == [0, 0, 0]

    def held(frame):
        return sorted(map(repr, (tuple(r["line_dedup"]) for r in index.clean(frame).collect())))

    for k, frame in enumerate(frames):
        index.insert(frame)
        others = [t for p in parts[:k] for t in p]
        assert held(frame) == sorted(map(repr, plain(parts[k], 25, 1, others)))
    full = index.version
    index.delete(frames[1])
    others = [t for t in parts[2]]
    assert held(frames[0]) == sorted(map(repr, plain(parts[0], 25, 1, others)))
    # a second reader of the folder sees the last version
    again = line_dedup.LineIndex(spark, f"{tmp_path}/index", min_docs=25, keys_per_shard=40)
    assert again.version == index.version and again.counts().count() == index.counts().count()
    with pytest.raises(ValueError):
        index.delete(frames[1])
    assert held(frames[0]) == sorted(map(repr, plain(parts[0], 25, 1, others)))
    index.revert(full)
    assert held(frames[2]) == sorted(map(repr, plain(parts[2], 25, 1, parts[0] + parts[1])))


def test_filters_stay_exact_in_one_shard_under_changes(spark, tmp_path):
    """With the shard count unchanged, the held filter is updated and not made anew."""
    parts = [texts(seed, 40) for seed in (4, 5)]
    frames = [spark.createDataFrame([(t,) for t in p], "text string") for p in parts]
    index = line_dedup.LineIndex(spark, f"{tmp_path}/index", min_docs=15, keys_per_shard=1_000_000)
    index.insert(frames[0])
    index.insert(frames[1])
    index.delete(frames[0])
    found = sorted(map(repr, (tuple(r["line_dedup"]) for r in index.clean(frames[1]).collect())))
    assert found == sorted(map(repr, plain(parts[1], 15)))


def test_cuckoo_filter_keeps_what_is_in_and_forgets_what_is_out():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    made = CuckooFilter.of(h[:10_000])
    assert made.contains(h[:10_000]).all() and made.contains(h[10_000:]).mean() < 0.002
    made.delete(h[:5000])
    assert made.contains(h[5000:10_000]).all() and made.contains(h[:5000]).mean() < 0.002
    assert made.insert(h[10_000:15_000]) and made.contains(h[5000:15_000]).all()
    loaded = CuckooFilter.load(made.dump())
    loaded.delete(h[5000:15_000])
    assert not loaded.table.any()
    repeated = CuckooFilter.of(np.repeat(h[:3], 6))
    repeated.delete(np.repeat(h[:3], 5))
    assert repeated.contains(h[:3]).all()
    with pytest.raises(ValueError):
        repeated.delete(h[10:12])


def test_filters_of_many_shards_answer_like_each_alone():
    rng = np.random.default_rng(2)
    own = {s: rng.integers(0, 2**63, 50 * s + 1, dtype=np.uint64) for s in (0, 2, 3)}
    many = Shards({s: CuckooFilter.of(h).dump() for s, h in own.items()}, 4)
    asked = np.concatenate([*own.values(), rng.integers(0, 2**63, 500, dtype=np.uint64)])
    for s in range(4):
        alone = CuckooFilter.of(own[s]).contains(asked) if s in own else np.zeros(len(asked), dtype=bool)
        assert np.array_equal(many.contains(np.full(len(asked), s), asked), alone)
