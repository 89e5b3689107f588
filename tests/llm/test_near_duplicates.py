"""Vectors and fingerprints against brute force."""

import random

import numpy as np
import pytest
import xxhash

from inkstone.llm import cells, components, embedding_dedup, simhash


def closed(pairs, nodes):
    """The least node of each component, by hand."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_noise(spark):
    rnd = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(60)]
    pairs += pairs[:5] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert found == closed(real, {n for p in real for n in p})
    assert components.components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_large_groups_meet_once(spark):
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, k) for k in range(3)], "key int, item int")
    met = cells.meet(rows, "key", "item", 10).collect()
    by_cell = {}
    for r in met:
        by_cell.setdefault(r["cell"], []).append(r)
    seen = {}
    for own in by_cell.values():
        assert len(own) <= 40
        for a in own:
            for b in own:
                if a["item"] < b["item"] and (a["side"] == -1 or a["side"] != b["side"]):
                    seen[a["key"], a["item"], b["item"]] = seen.get((a["key"], a["item"], b["item"]), 0) + 1
    assert set(seen.values()) == {1} and len(seen) == 50 * 49 // 2 + 3


def vectors():
    rnd = np.random.default_rng(4)
    rows = []
    for k in range(240):
        base = rnd.standard_normal(16)
        for c in range(rnd.integers(1, 4)):
            noise = rnd.standard_normal(16) * rnd.choice([0.0, 0.04, 0.08])
            rows.append((base + noise).astype(np.float32).tolist())
    out = [(k, v, int(k % 3), "x", 1) for k, v in enumerate(rows)]
    chain = [np.cos(0.15 * k) * np.eye(16)[0] + np.sin(0.15 * k) * np.eye(16)[1] for k in range(12)]
    out += [(1000 + k, v.astype(np.float32).tolist(), 5, "x", 1) for k, v in enumerate(chain)]
    out += [(2000 + k, [2.0] * 16, 6, "x", 1) for k in range(30)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15]
    out += [(3000 + k, v, 7, "x", 1) for k, v in enumerate(bad + bad)]
    out += [(4000, [2.0] * 16, None, "x", 1), (4001, [2.0] * 16, None, "x", 1), (4002, [2.0] * 8, 6, "x", 1), (None, [2.0] * 16, 6, "x", 1)]
    return out


@pytest.mark.parametrize("limit", [2048, 8])
def test_vectors_equal_brute_force(spark, monkeypatch, limit):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cid string, n_links int")
    if limit != 2048:
        small = embedding_dedup.meet
        monkeypatch.setattr(embedding_dedup, "meet", lambda r, key, item, _: small(r, key, item, limit))
    found = embedding_dedup.near_duplicate_vectors(table).collect()
    good = {}
    for k, (i, v, label, *_) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64))
    links = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98]
    group = closed(links, range(len(rows)))
    least = {}
    for k, g in group.items():
        if rows[k][0] is not None:
            least[g] = min(least.get(g, rows[k][0]), rows[k][0])
    expected = []
    for k, row in enumerate(rows):
        n = sum(k in p for p in links)
        expected.append((row[0], n, least.get(group[k]), row[0] == least.get(group[k])))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_duplicate_vectors(none).count() == 0


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 6)))
    out = [None, "", " \n", "One", "one", "two words", "a b c d", "a b c d e"]
    for _ in range(40):
        words = [word() for _ in range(rnd.randint(5, 400))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(words)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = word()
            out.append(rnd.choice([" ", "\t", "\n ", "\x0b"]).join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    return out + ["same row"] * 20


def test_fingerprints_and_groups_equal_brute_force(spark):
    rows = [(k if k != 9 else None, t, "x", 1, 2) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, text_hash int, component_id int")
    found = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for t in texts()]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    group = closed(links, range(len(rows)))
    least = {}
    for k, g in group.items():
        if rows[k][0] is not None:
            least[g] = min(least.get(g, rows[k][0]), rows[k][0])
    expected = sorted((repr(rows[k][0]), prints[k], least.get(group[k])) for k in range(len(rows)))
    assert sorted((repr(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in found) == expected
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    named = {v for k, v in least.items()}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(named)


def test_rows_of_one_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")] * 4 + [(1, "p q r s t u v w x"), (None, "k l m n o"), (None, "k l m n o")], "doc_id int, text string")
    assert sorted(r["text"] for r in simhash.keep_first(docs).collect()) == ["a b c d e f g", "k l m n o", "p q r s t u v w x"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_of_rows_equal_in_id_and_text_the_same_one_stays(spark):
    rows = [(1, "a b c d e f g", "en", 0.5), (1, "a b c d e f g", "de", None), (1, "a b c d e f g", None, 1.5), (2, "A b c d e f g", "en", 2.5)]
    schema = "doc_id int, text string, lang string, row_order double"
    kept = {tuple(simhash.keep_first(spark.createDataFrame(own, schema).repartition(3)).first()) for own in (rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]])}
    assert len(kept) == 1 and kept <= set(rows[:3])


def test_near_fingerprints_of_one_dense_group(spark):
    rnd = np.random.default_rng(6)
    base = int(rnd.integers(0, 2**62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rnd.integers(0, 63, (400, 2))} | set(map(int, rnd.integers(0, 2**62, 200))))
    table = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    found = components.components(simhash.near_links(table, 4, limit=32)).collect()
    links = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    expected = {n: g for n, g in closed(links, prints).items() if n in {x for p in links for x in p}}
    assert {r["node"]: r["component"] for r in found} == expected
    with pytest.raises(ValueError):
        simhash.near_links(table, 6)
