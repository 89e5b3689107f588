"""Scores, filters, shards and personal data against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import boosting, ctw_tree, language_model, pii, quality, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=7):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    texts = [None, "", "  \n", "ONE", "one\x0btwo\x0cthree\rfour", "x" * 5000]
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))) for _ in range(n)]
    texts += ["a repeated row"] * 5 + ["the same line\n" * 30, "word " * 4000]
    return [(k if k != 8 else None, t, "en" if k % 3 else None, "y", 3) for k, t in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, score string, block int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


# language model


def kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(0.5) * 2 - math.lgamma(zeros + ones + 1)


def plain_tree_scores(training, texts, depth):
    """The same model with dictionaries: (context, bits so far) -> counts of the next bit."""
    count, longer = {}, {}

    def steps(text):
        stream = bytes([255]) * depth + text + bytes([255])
        for k in range(depth, len(stream)):
            bits = format(stream[k], "08b")
            for j in range(8):
                yield [stream[k - n : k][::-1] for n in range(depth + 1)], bits[:j], int(bits[j])

    for text in training:
        for contexts, prefix, bit in steps(text):
            for n, context in enumerate(contexts):
                count.setdefault((context, prefix), [0, 0])[bit] += 1
                if n:
                    longer.setdefault((contexts[n - 1], prefix), set()).add((context, prefix))
    weighted = {}
    for node in sorted(count, key=lambda x: -len(x[0])):
        own = kt(*count[node])
        weighted[node] = own if len(node[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(weighted[c] for c in longer[node]))
    out = []
    for text in texts:
        total = 0.0
        for contexts, prefix, bit in steps(text):
            p = 0.5
            for n in range(depth, -1, -1):
                c = count.get((contexts[n], prefix))
                if c is None:
                    continue
                own = (c[bit] + 0.5) / (sum(c) + 1)
                seen = n < depth and (contexts[n + 1], prefix) in count
                share = math.exp(math.log(0.5) + kt(*c) - weighted[contexts[n], prefix]) if seen else 1
                p = share * own + (1 - share) * p
            total += math.log10(p)
        out.append(total)
    return out


def test_language_model_equals_a_plain_version(docs):
    rows = corpus()
    found = {r["doc_id"]: r for r in language_model.score(docs, depth=3, block_bytes=9000).collect()}
    assert len(found) == len(rows)
    tokens = {r[0]: [w.encode().lower().decode() for w in WORD.findall(r[1] or "")] for r in rows}
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows}
    count = Counter()
    for i, own in tokens.items():
        if not held[i]:
            count.update([*own, None])
    n, v = sum(count.values()), len(count)
    training = [" ".join(own).encode() for i, own in tokens.items() if not held[i]]
    scores = plain_tree_scores(training, [" ".join(own).encode() for own in tokens.values()], 3)
    for (i, own), score in zip(tokens.items(), scores):
        r, every = found[i], [*own, None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(every), sum(count[t] > 0 for t in every), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in every))
        assert r["score"] == pytest.approx(score, rel=1e-5)


def test_probabilities_after_a_context_add_up_to_one():
    rnd = np.random.default_rng(1)
    key, counts = np.unique(ctw_tree.grams([bytes(rnd.integers(97, 101, 500).tolist())], 3)[0], return_counts=True)
    context = key[7] >> np.uint64(8)
    whole = np.union1d(key, (context << np.uint64(8)) | np.arange(256, dtype=np.uint64))
    have = np.zeros(len(whole))
    have[np.searchsorted(whole, key)] = counts
    tree = ctw_tree.Tree(whole, have, 3)
    p = 10 ** tree.log10(ctw_tree.Top(*tree.top()))
    assert p[whole >> np.uint64(8) == context].sum() == pytest.approx(1)


def test_language_model_without_rows_or_training(spark, docs):
    assert language_model.score(docs.limit(0)).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = language_model.score(spark.createDataFrame([(held, "ab c")], "doc_id int, text string")).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0
    assert row["score"] == pytest.approx(-8 * 5 * math.log10(2))


# personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@pytest.fixture(scope="module")
def detector():
    return pii.train(["the cat sat on", "and then some words", "of a long day"])


def test_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    parts = ["1", "2", "0", "4111111111111111", "255", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "é", "0000000300"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_found_spans(spark, detector):
    texts = [None, "", "é mail a.b@c.org now", "call (555) 123-4567 today", "on 2020-01-02 we", "host 10[.]2[.]3[.]4 x", "card 4111.1111.1111.1111 ok", "+1 (587) 555-1270 and 4111 1111 1111 1111"]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id int, text string, spans string, masked int")
    found = {r["doc_id"]: r for r in pii.find(docs, detector).collect()}
    for k, t in enumerate(texts):
        base = plain_spans(t or "")
        assert [found[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(s[0] == kind for s in base) for kind in pii.KINDS]
        assert found[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest()
        assert set(filter(None, found[k]["spans"].split(","))) >= {f"{a}:{b}:{c}" for a, b, c in base}
    assert found[3]["spans"] == "phone:5:19" and found[4]["spans"] == "" and found[5]["spans"] == "ip:5:19" and found[6]["spans"] == "card:5:24"
    masked = pii.redact(docs, detector)
    assert masked.columns == docs.columns
    by_id = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert by_id[0] is None and by_id[2] == "é mail <EMAIL> now" and by_id[7] == "<PHONE> and <CARD>"
    assert pii.find(docs.limit(0), detector).count() == 0


def plain_added(detector, text):
    """Every generator on the whole text, and every pair of spans compared."""
    base = plain_spans(text)
    apart = lambda s, spans: all(s[2] <= a or b <= s[1] for _, a, b in spans)
    found = {("email", *m.span()) for m in pii.SPELLED.finditer(text)}
    for kind, _, pattern in pii.WIDE:
        found |= {(kind, *m.span()) for m in pattern.finditer(text)}
    free = sorted(s for s in found if apart(s, base))
    p = detector.probabilities([pii.describe(text, s) for s in free]) if free else []
    out = []
    for _, s in sorted(zip(p, free), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
        if p[free.index(s)] >= detector.thresholds[s[0]] and apart(s, out):
            out.append(s)
    return sorted(out)


def test_added_spans_equal_a_plain_version(detector):
    rnd = random.Random(12)
    parts = ["1", "20", "999", "ab", "at", " at ", "[at]", " dot ", ".", "[.]", ":", "::", "fe80", "com", " ", "(", ")", "-", "+1", "@", "4111 1111", "x" * 70]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(2, 40))) for _ in range(1500)]
    for _ in range(300):
        texts.append(" ".join(rnd.choice([pii.example(rnd)[1], "and so on", "mail"]) for _ in range(4)))
    some = 0
    for text in texts:
        added = sorted(detector.added(text, pii.base_spans(text)))
        assert added == plain_added(detector, text), text
        some += bool(added)
    assert some > 200


def test_candidates_do_not_hang_on_the_rest_of_the_text(detector):
    alone, among = "mail bob at site.com", "mail bob at site.com, or ann at x dot org"
    assert ("email", 5, 20) in pii.wide_spans(alone) and ("email", 5, 20) in pii.wide_spans(among)
    for text in ("2001:db8::1", "fe80::1", "::1", "2001:db8::", "dead:beef::"):
        assert ("ip", 0, len(text)) in pii.wide_spans(text)
    assert pii.wide_spans("std::vector a::x") == []
    crowded = ".".join("1.1.1.1 2.2.2.2 3.3.3.3 4.4.4.4 5.5.5.5 6.6.6.6".split()) + "@ab.cd"
    assert pii.touches(pii.merged(pii.base_spans(crowded)), ("phone", 50, 53))
    assert not pii.touches(pii.merged([("ip", 0, 5), ("ip", 2, 3), ("ip", 9, 12)]), ("ip", 5, 9))


def test_a_kind_that_misses_the_precision_keeps_its_best_threshold():
    p, right = np.array([0.6, 0.7, 0.8, 0.9]), np.array([1.0, 0.0, 1.0, 0.0])
    with pytest.warns(UserWarning, match="phone"):
        assert 0.5 <= pii.threshold_of("phone", p, right, 0.98) < 0.9
    assert pii.threshold_of("phone", p, np.ones(4), 0.98) == 0.5


def test_overlapping_spans_are_masked_as_one():
    assert pii.masked("0123456789", [("card", 2, 6), ("phone", 4, 8)]) == "01<CARD>89"


def test_detector_tells_made_up_values_apart(detector):
    rnd = random.Random(99)
    right = wrong = total = 0
    for _ in range(600):
        kind, value, good = pii.example(rnd)
        text = f"some words {value} go on"
        base = pii.base_spans(text)
        hit = bool(detector.added(text, base))
        total += good and not base
        right += hit and good and not base
        wrong += hit and not good
    assert right > 0.8 * total and wrong < 0.05 * 600


def test_boosted_trees_learn_an_interaction():
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.boost(x[:600], y[:600])
    assert ((trees.raw(x[600:]) > 0) == y[600:]).mean() > 0.9


# shards


def plain_shards(sizes, bits, limit):
    out = {}
    for k in bits:
        for d in range(61):
            own = [j for j in bits if bits[j][:d] == bits[k][:d]]
            if sum(sizes[j] for j in own) <= limit or len(own) == 1:
                out[k] = (bits[k][:d], d, sum(sizes[j] for j in own))
                break
    return out


def test_shards_equal_a_plain_version(spark):
    rows = [(k, "w" * (k * 7 % 90) if k % 11 else None, "p", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, shard string, bytes int")
    sizes = {k: len(t or "") for k, t, *_ in rows}
    bits = {k: bin(int(hashlib.md5(f"{k}:{t or ''}".encode()).hexdigest()[:15], 16))[2:].zfill(60) for k, t, *_ in rows}
    for limit in (60, 400, 10**6):
        found = {r["doc_id"]: (r["shard"], r["depth"], r["shard_bytes"]) for r in sharding.assign(docs, limit).collect()}
        assert found == plain_shards(sizes, bits, limit)
    assert sharding.assign(docs.limit(0), 100).count() == 0


def test_repeated_rows_split_on_drawn_bits(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x" * 50)] * 64 + [(2, "y")], "doc_id int, text string")
    found = sharding.assign(rows, 200).collect()
    total = Counter()
    for r in found:
        total[r["shard"]] += r["bytes"]
    assert len(found) == 65 and max(total.values()) <= 200 and all(total[r["shard"]] == r["shard_bytes"] for r in found)
    sharding.write_shards(rows, 200, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 65 and set(rows.columns) < set(back.columns)


def test_written_shards_keep_the_limit_with_repeated_rows(spark, tmp_path):
    rows = [(1, "x" * 50, k, "a") for k in range(64)] + [(None, "é" * 30, k, None) for k in range(20)] + [(1, None, 7, "n")] * 3
    rows += [(100 + k, "w" * (k % 40), k, "b") for k in range(60)] + [(999, "l" * 900, 0, "large")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, bits int, shard string").repartition(5)
    sharding.write_shards(docs, 200, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter(tuple(r)[:4] for r in back) == Counter(rows)
    held = {}
    for r in back:
        held.setdefault(r["shard_"], []).append(len((r["text"] or "").encode()))
    assert all(sum(sizes) <= 200 or len(sizes) == 1 for sizes in held.values()) and [900] in held.values()
    sharding.write_shards(docs.limit(0), 200, str(tmp_path / "none"))


# toxicity


def test_toxicity_separates_held_out_texts(spark):
    rnd = random.Random(2)
    plain = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(200)]
    rows = []
    for k in range(300):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        bad = k % 4 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["dimwit", "blockhead", "Numbskull"])
        rows.append((k, " ".join(words), "x", "y", int(bad)))
    odd = [(1000, None, "x", "y", 0), (1001, "", "x", "y", 0), (1002, "blockhead " * 3000, "x", "y", 1), (None, "nice words", "x", "y", 0)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, toxicity string, score string, label int")
    labels = docs.filter("doc_id < 300").select("doc_id", F.col("label").alias("toxic")).union(spark.createDataFrame([(5000, None), (None, 1), (3, 7)], "doc_id bigint, toxic int"))
    found = toxicity.score(docs, labels).collect()
    assert len(found) == len(rows) + 4
    by_id = {r["doc_id"]: r for r in found}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(by_id[k]["held_out"] == (k in held) for k in range(300))
    assert sum(by_id[k]["predicted"] == int(k % 4 == 0) for k in held) > 0.95 * len(held)
    assert by_id[1002]["predicted"] == 1 and by_id[1000]["score"] == by_id[1001]["score"] < 0.5
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, flipped).collect()} == {k: r["score"] for k, r in by_id.items()}
    kept = toxicity.score(docs, labels, keep=True)
    assert kept.columns == [*docs.columns, "toxicity_"]
    assert {r["doc_id"]: r["toxicity_"]["score"] for r in kept.collect()} == pytest.approx({k: r["score"] for k, r in by_id.items()})
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


# quality


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts_equal_a_plain_version(spark):
    rnd = random.Random(8)
    rows = corpus()
    rows += [(500 + k, "\n".join(rnd.choice(["a b c d e f g h", "i j k # $ l", "", " ", "m n o p q r s t u v w"]) for _ in range(rnd.randint(1, 40))), "de", "y", 3) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality string, m int")
    judged = quality.judge(docs)
    assert judged.columns == [*docs.columns, "quality_"]
    found = sorted(judged.collect(), key=lambda r: repr(r["doc_id"]))
    assert len(found) == len(rows)
    for r in found:
        q = r["quality_"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == plain_counts(r["text"])
        assert not (q["base_failed"] and q["kept"])
    assert quality.judge(docs.limit(0)).count() == 0


def test_texts_far_from_their_language_are_rejected(spark):
    rnd = random.Random(9)
    plain = ["the", "of", "and", "house", "river", "walked", "garden", "to", "in", "stone"]
    prose = lambda: " ".join(rnd.choice(plain) for _ in range(200))
    rows = [(k, prose(), "en") for k in range(40)] + [(100, prose().upper() + " ", "en"), (101, " ".join(w + "###" for w in prose().split()), "en"), (102, "short text " + prose()[:120], "en")]
    found = {r["doc_id"]: r["quality"] for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert all(found[k]["kept"] for k in range(40)) and found[102]["kept"]
    assert not found[100]["kept"] and not found[101]["kept"] and not found[100]["base_failed"]


def sentences(seed=10):
    rnd = random.Random(seed)
    rare = ["house", "river", "walked", "garden", "stone", "window", "slowly", "paper", "under", "light", "wagon", "green"]
    return lambda n=200: " ".join(rnd.choice(quality.COMMON_WORDS["en"] if rnd.random() < 0.2 else rare) for _ in range(n))


def test_texts_without_common_words_of_their_language_are_rejected(spark):
    prose, rnd = sentences(), random.Random(11)
    german = lambda: " ".join(rnd.choice(quality.COMMON_WORDS["de"] + ["haus", "fluss", "garten", "stein", "fenster", "langsam"]) for _ in range(200))
    rare = lambda: " ".join("".join(rnd.choice("aeioulnrstdhg") for _ in range(rnd.randint(4, 8))) for _ in range(200))
    rows = [(k, prose(rnd.randint(60, 300)), "en") for k in range(200)] + [(200 + k, rare(), "en") for k in range(5)] + [(300 + k, german(), "en") for k in range(5)]
    rows += [(400 + k, "| " + " | ".join(prose(60).split()) + " |", "en") for k in range(5)] + [(500, rare(), "xx"), (501, prose(30), "en")]
    found = {r["doc_id"]: r["quality"] for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert not any(found[k]["kept"] or found[k]["base_failed"] for j in (200, 300, 400) for k in range(j, j + 5))
    assert sum(found[k]["kept"] for k in range(200)) >= 196 and found[500]["kept"] and found[501]["kept"]


def test_one_source_does_not_set_the_references(spark):
    prose = sentences()
    clean = [(k, prose(), "en", f"s{k % 8}") for k in range(80)]
    schema = "doc_id int, text string, lang string, source string"
    for spoil in (str.upper, lambda t: " ".join(w + "#@" for w in t.split())):
        # a third of the rows are distinct texts of one source, then one text in many copies, then texts that fail the base rules
        for hot in ([spoil(prose()) for _ in range(40)], [spoil(prose())] * 40, [spoil("up and down we go now and then " * 20)] * 40):
            rows = clean + [(100 + k, t, "en", "hot") for k, t in enumerate(hot)]
            kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, schema)).collect() if r["quality"]["kept"]}
            assert kept == set(range(80))
        # half of the rows without any source, as copies
        rows = [(k, t, lang) for k, t, lang, _ in clean] + [(100 + k, t, "en") for k, t in enumerate([spoil(prose())] * 80)]
        kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect() if r["quality"]["kept"]}
        assert kept == set(range(80))


def test_distance_equals_its_definition(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.2, 0.3, 0.4]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    row = spark.createDataFrame([(p, q, p[:2])], "p array<double>, q array<double>, r array<double>")
    got = row.select(quality.distance(F.col("p"), F.col("q")), quality.distance(F.col("p"), F.col("p")), quality.distance(F.col("p"), F.col("r"))).first()
    assert got[0] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and got[1] == 0 and got[2] is None
