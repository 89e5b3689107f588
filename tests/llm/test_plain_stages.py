"""The toxicity classifier, the quality verdicts and the whole pipeline against plain Python versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from test_documents import plain_counts, plain_spans
from test_near_duplicates import closed, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from inkstone.llm import pii, quality, toxicity
from inkstone.llm.queries import vocabulary

# toxicity: sets of n-grams in dictionaries, weights by Newton steps


def plain_grams(text):
    out, codes = set(), [ord(c) for c in f" {(text or '').lower()} "]
    for place, n in enumerate(toxicity.ORDERS):
        for k in range(len(codes) - n + 1):
            h = 0
            for c in codes[k : k + n]:
                h = (h * 1_000_003 + c) % 2**64
            out.add((place, (h * int(toxicity.SPREAD)) % 2**64 >> 64 - toxicity.BITS))
    return out


def plain_classifier(texts, labels, share, penalty=0.1, least=0.25):
    grams = [plain_grams(t) for t in texts]
    found = [Counter(g for own, y in zip(grams, labels) if y == k for g in own) for k in (0, 1)]
    size = [labels.count(0), labels.count(1)]
    ratio = {g: math.log((found[1][g] + 1) / (size[1] + 2)) - math.log((found[0][g] + 1) / (size[0] + 2)) for g in set(found[0]) | set(found[1])}
    names = sorted(g for g, r in ratio.items() if abs(r) >= least)
    x = np.array([[ratio[g] * (g in own) for g in names] for own in grams])
    y, mean = np.array(labels), np.mean(labels)
    weight = np.where(y == 1, share / mean, (1 - share) / (1 - mean))
    b = 0.0
    # Newton steps in the space of the texts, which are fewer than the n-grams
    kernel = x @ x.T / penalty
    a = np.zeros(len(y))
    for _ in range(60):
        z = kernel @ a + b
        p = 1 / (1 + np.exp(-z))
        slope, curve = weight * (p - (y == 1)), np.maximum(weight * p * (1 - p), 1e-9)
        left = np.block([[np.diag(1 / curve) + kernel, np.ones((len(y), 1))], [np.ones((1, len(y))), np.zeros((1, 1))]])
        step = np.linalg.solve(left, np.append(z - slope / curve, 0.0))
        a, b = step[:-1], step[-1]
    w = x.T @ a / penalty
    return lambda text: 1 / (1 + math.exp(-(b + sum(w[k] * ratio[g] for k, g in enumerate(names) if g in plain_grams(text)))))


def test_toxicity_scores_equal_a_plain_classifier(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghil") for _ in range(rnd.randint(2, 6))) for _ in range(40)]
    rows = []
    for k in range(150):
        text = [rnd.choice(words) for _ in range(rnd.randint(4, 20))]
        bad = k % 3 == 0
        if bad:
            text[rnd.randrange(len(text))] = rnd.choice(["dimwit", "Blockhead"])
        rows.append((k, " ".join(text), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, docs.select("doc_id", "toxic")).collect()}
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    score = plain_classifier([t for _, t, _ in learnt], [y for _, _, y in learnt], np.mean([y for _, _, y in learnt]))
    assert {k: found[k] for k in range(150)} == pytest.approx({k: score(t) for k, t, _ in rows}, abs=0.03)


# quality: histograms, medians and distances by hand


def middle(values):
    own = sorted(v for v in values if v is not None)
    return own[math.ceil(len(own) / 2) - 1] if own else None


def js(p, q):
    if len(p) != len(q):
        return None
    term = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum((term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2 for a, b in zip(p, q))))


def unit(values):
    own = [v for v in values if v is not None]
    return [v / sum(own) for v in own] if sum(own) > 0 else None


def plain_histograms(text, lang):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    classes = [len(regex.findall(p, text)) for p in quality.CLASSES.values()]
    classes.append(len(text) - sum(map(len, words)))
    common = [sum(len(w) <= 5 and w.lower() == c for w in words) for c in quality.COMMON_WORDS.get(lang, [])]
    share = lambda counts, total: [c / max(1, total) for c in [*counts, max(0, total - sum(counts))]]
    return share(classes, len(text)), share(common, len(words))


def plain_verdicts(rows):
    """{place of the row: kept} for rows (text, lang, source)."""
    rows = [(text or "", lang, source) for text, lang, source in rows]
    sound = {}
    for text, lang, source in rows:
        n_words, *_, failed = plain_counts(text)
        if n_words >= 50 and not failed:
            before = sound.get((lang, text))
            sound[lang, text] = source if before is None else before if source is None else min(before, source)
    bins = len(quality.WORD_BINS)
    padded = lambda h: h + [None] * (bins - len(h))
    shapes = {key: plain_histograms(key[1], key[0]) for key in sound}

    def vote(values):
        """{lang: median over sources of medians} of {(lang, source): values}."""
        by_source = {}
        for (lang, text), source in sound.items():
            by_source.setdefault((lang, source), []).append(values(lang, text))
        return {x: middle([middle(v) for (lang, _), v in by_source.items() if lang == x]) for x in {k[0] for k in by_source}}

    refs = {}
    for lang in {k[0] for k in sound}:
        chars = unit([vote(lambda x, t, k=k: shapes[x, t][0][k])[lang] for k in range(len(quality.CHAR_BINS))])
        words = unit([vote(lambda x, t, k=k: padded(shapes[x, t][1])[k])[lang] for k in range(bins)])
        refs[lang] = chars, words
    far = lambda k: vote(lambda x, t: js(unit(shapes[x, t][k]), refs[x][k]))
    far_chars, far_words = far(0), far(1)
    kept = []
    for text, lang, _ in rows:
        n_words, *_, failed = plain_counts(text)
        ok = not failed
        if ok and n_words >= 50 and lang in refs:
            chars, words = plain_histograms(text, lang)
            ref_chars, ref_words = refs[lang]
            ok = js(chars, ref_chars) <= max(quality.CHAR_MARGIN * far_chars[lang], quality.LEAST_LIMIT)
            if lang in quality.COMMON_WORDS:
                most = quality.NO_WORDS * js([0.0] * (len(ref_words) - 1) + [1.0], ref_words)
                ok = ok and js(words, ref_words) <= max(min(quality.WORD_MARGIN * far_words[lang], most), quality.LEAST_LIMIT)
        kept.append(ok)
    return kept


def library(seed=6):
    """Texts of three languages and sources: prose, shouting, tables, lists without common words, copies, odd rows."""
    rnd = random.Random(seed)
    rare = ["house", "river", "walked", "garden", "stone", "window", "slowly", "paper", "under", "light"]

    def prose(lang, n, share=0.2):
        common = quality.COMMON_WORDS.get(lang, rare)
        return " ".join(rnd.choice(common) if rnd.random() < share else rnd.choice(rare) + rnd.choice(["", ",", ".", "s"]) for _ in range(n))

    rows = []
    for k in range(70):
        lang = ["en", "de", "xx"][k % 3]
        rows.append((prose(lang, rnd.randint(15, 160)), lang, f"s{k % 4}"))
    rows += [(prose("en", 80).upper(), "en", "s1"), ("| " + " | ".join(prose("en", 70).split()) + " |", "en", "s2"), (prose("en", 90, 0.0), "en", None), (None, "en", "s1"), ("", None, None)]
    rows += [(rows[0][0], "en", "s3"), (rows[3][0], "en", None), ("same words " * 60, "de", "s1")]
    return rows


def test_quality_verdicts_equal_a_plain_version(spark):
    rows = library()
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id int, text string, lang string, source string")
    found = {r["doc_id"]: r["quality"]["kept"] for r in quality.judge(docs).collect()}
    kept = plain_verdicts(rows)
    assert [found[k] for k in range(len(rows))] == kept and 10 < sum(kept) < len(rows) - 8


# the pipeline


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rnd = random.Random(13)
    rows = [(k, t, lang, source) for k, (t, lang, source) in enumerate(library(14))]
    rows = [(i, t if i % 7 else f"{t} mail a{i}.b@example.org, or call +1 (587) 555-1{i:03d}", lang, s) for i, t, lang, s in rows]
    rows = [(i, t if i % 11 else f"dimwit {t} blockhead dimwit", lang, s) for i, t, lang, s in rows]
    rows += [(i + 1000, t if rnd.random() < 0.5 else t.replace(",", ""), lang, s) for i, t, lang, s in rows[:20]] + rows[1:3]
    schema = "doc_id bigint, text string, lang string, source string"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], f"{schema}, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0, int("dimwit" in (t or ""))) for i, t, *_ in rows[: len(rows) - 2]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/work").collect()
    stage = [spark.read.parquet(f"{tmp_path}/work/{k}") for k in range(4)]
    key = lambda r: (r["doc_id"], r["text"])

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), (3, 1), 1000, "doc_id", "text", "toxic")
    weight = lambda g: float(model.weights[(g[0] << toxicity.BITS) + g[1]])
    toxic = lambda t: 1 / (1 + math.exp(-(model.intercept + sum(map(weight, plain_grams(t)))))) >= 0.7
    left = [r for r in rows if not toxic(r[1])]
    assert sorted(map(key, stage[0].collect()), key=repr) == sorted(((i, t) for i, t, *_ in left), key=repr) and len(left) < len(rows)

    left = [r for r, kept in zip(left, plain_verdicts([r[1:] for r in left])) if kept]
    assert sorted(map(key, stage[1].collect()), key=repr) == sorted(((i, t) for i, t, *_ in left), key=repr)

    prints = [plain_fingerprint(r[1]) for r in left]
    group = closed([(a, b) for a in range(len(left)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4], range(len(left)))
    first = {}
    for k, g in group.items():
        first[g] = min(first.get(g, left[k][0]), left[k][0])
    assert sorted(r["doc_id"] for r in stage[2].collect()) == sorted(first.values()) and len(first) < len(left)

    detector, texts = pii.detector_for(stage[2]), {r["doc_id"]: r["text"] for r in stage[2].collect()}
    masked = {r["doc_id"]: r for r in stage[3].collect()}
    assert set(masked) == set(texts)
    for i, text in texts.items():
        spans = plain_spans(text) + detector.added(text, pii.base_spans(text))
        assert masked[i]["text"] == pii.masked(text, spans) and masked[i]["n_chars"] == len(masked[i]["text"])
    assert any("<EMAIL>" in r["text"] for r in masked.values())

    own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces, places = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, own_pieces in pieces.items():
        ids, at = [*own.encode(masked[i]["text"], add_special_tokens=False).ids, 1], 0
        for r in sorted(own_pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, quality int, masked string"
    rows = [(None, None, None, None, 1, "m"), (1, "", "en", "s", 2, None), (1, "", "en", "s", 2, None), (2, "a few words " * 30, None, None, 3, "x")]
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for own in ([], rows):
        docs = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n <= max(len(own), 1) and (name == "packing" or out.columns == docs.columns)
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), str(tmp_path)).count() == 2
