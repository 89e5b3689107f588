import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions.syllables import spell
from inkstone.functions.text import marks_to_number
from inkstone.operators import lexicon as lx, phonetic as ph, rules, segmentation as sg
from inkstone.plans.catalog import QUERIES

WORDS = [
    ("你好", "ni3 hao3", "hello / hi"), ("我", "wo3", "I / me"), ("不", "bu4", "not / no"), ("知道", "zhi dao5", "to know"),
    ("再見", "zai4 jian4", "goodbye"), ("睡覺", "shui4 jiao4", "sleep"), ("該", "gai1", "should"), ("了", "le5", "particle"),
    ("水", "shui3", "water"), ("腳", "jiao3", "foot"), ("叫", "jiao4", "to call"), ("吃飯", "chi1 fan4", "to eat a meal"),
    ("趕赴", "gan3 fu4", "to hurry"), ("乹", "gan1", "old variant of 乾"), ("㳇", "fu4", "(used in place names)"), ("敢", "gan3", "dare"),
]
COMMON = {"我", "不", "知道", "睡覺", "了", "該"}


@pytest.fixture(scope="module")
def lex(spark):
    rows = [(i, t, t, p, [g], t in COMMON, t in COMMON) for i, (t, p, g) in enumerate(WORDS)]
    raw = spark.createDataFrame(rows, "ord int, traditional string, simplified string, pinyin string, english array<string>, frequent boolean, common boolean")
    tiers = raw.select("ord", "frequent", "common")
    return lx.normalize_entries(raw).join(tiers, "ord").cache()


def test_spelling(spark):
    cases = {
        "ni3": ("ㄋㄧˇ", "nǐ"), "zhi1": ("ㄓ", "zhī"), "dui4": ("ㄉㄨㄟˋ", "duì"), "xuan3": ("ㄒㄩㄢˇ", "xuǎn"), "men5": ("˙ㄇㄣ", "men"),
        "nü3": ("ㄋㄩˇ", "nǚ"), "nu:3": ("ㄋㄩˇ", "nǚ"), "qu4": ("ㄑㄩˋ", "qù"), "liu2": ("ㄌㄧㄡˊ", "liú"), "gui4": ("ㄍㄨㄟˋ", "guì"),
        "xyz": ("", "xyz"), "": ("", ""), "jiong3": ("ㄐㄩㄥˇ", "jiǒng"), "er2": ("ㄦˊ", "ér"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: (r.c.bopomofo, r.c.marked) for r in df.select("s", F.get(spell(F.array("s")), F.lit(0)).alias("c")).collect()}
    assert got == cases
    back = spark.createDataFrame([("nǐ",), ("lǜ",), ("men",)], "s string").select(marks_to_number(F.col("s")).alias("n")).collect()
    assert [r.n for r in back] == ["ni3", "lv4", "men1"]


def test_resolve(spark, lex):
    q = spark.createDataFrame(
        [(1, "wo bu zhi dao"), (2, "nihao"), (3, "gaishuijiaole"), (4, "qqq"), (5, "gan3 fu4"), (6, "Tsai jian!"), (7, "zhi1 dao4")],
        "query_id int, text string",
    )
    best = {r.query_id: r for r in ph.resolve_queries(q, lex).filter("rank = 1").collect()}
    assert best[1].traditional == "我不知道" and "ㄅㄨˋ" in best[1].bopomofo
    assert best[2].traditional == "你好" and best[2].exact_entry and best[2].pinyin == "nǐ hǎo"
    assert best[3].traditional == "該睡覺了"
    assert 4 not in best and 6 not in best
    assert best[5].traditional == "趕赴" and best[5].wrong == 0
    assert best[7].traditional == "知道"


def test_best_paths_against_enumeration(spark, lex):
    entries = [r.asDict() for r in lx.top_entries_by_key(lex).collect()]
    syllables = ["gan", "fu", "shui", "jiao", "le"]
    tones = [3, 0, 0, 4, 0]

    def gain(e, at, n):
        got = [int(s[-1]) if s[-1].isdigit() else 0 for s in e["py_num"].split()]
        wrong = sum(1 for k in range(n) if tones[at + k] and got[k] and got[k] != 5 and got[k] != tones[at + k])
        size = len(e["traditional"])
        boost = (75 if e["common"] else 60 if e["frequent"] else 0) if size > 1 else (10 if e["common"] else 0)
        return n * 100 - 35 + (5 if size == n else 0) + boost - (45 if size == 1 and not e["frequent"] else 0) - 200 * wrong

    def chains(at):
        if at == len(syllables):
            yield 0, ()
        for n in range(1, len(syllables) - at + 1):
            for e in entries:
                if e["py_flat"] == "".join(syllables[at:at + n]):
                    for score, rest in chains(at + n):
                        yield gain(e, at, n) + score, (e["traditional"], *rest)

    want = sorted((s for s, _ in chains(0)), reverse=True)[:3]
    phrases = spark.createDataFrame([(1, syllables, tones)], "query_id int, syllables array<string>, tones array<int>")
    got = [r.score for r in ph.best_paths(phrases, lex).orderBy("path_no").collect()]
    assert got == want


@pytest.mark.parametrize("chunk,letters", [(2, 0), (3, 0), (7, 0), (256, 0), (256, sg.TRIE_LETTERS)])
def test_segmentation_is_chunk_independent(spark, monkeypatch, chunk, letters):
    """By joins in chunks of any size, and by the trie."""
    monkeypatch.setattr(sg, "TRIE_LETTERS", letters)
    words = spark.createDataFrame([("知道",), ("道知",), ("知道了",), ("不知",), ("你好",)], "word string")
    texts = ["我不知道，吃飯abc你好", "知道" * 9, "道知道知道了不知道知", "你你好好你好"]
    lexicon = {r.word for r in words.collect()}

    def walk(text):
        out, i = [], 0
        while i < len(text):
            n = next((n for n in (4, 3, 2) if text[i:i + n] in lexicon), 1)
            out.append(text[i:i + n])
            i += n
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = sg.segment(df, words, "id", "text", chunk=chunk).orderBy("id", "run_no", "token_no").collect()
    for i, text in enumerate(texts):
        tokens = [r.token for r in rows if r.id == i]
        assert "".join(tokens) == text
        runs = ["".join(g) for _, g in itertools.groupby(text, lambda c: "一" <= c <= "鿿")]
        want = [t for run in runs for t in (walk(run) if "一" <= run[0] <= "鿿" else [run])]
        assert tokens == want


def test_rules(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('x {"a": 2} y {z}',), ("nothing",)], "t string")
    assert [r.a for r in rules.parse_loose_json(df, "t", "struct<a:int>").select("parsed.a").collect()] == [1, 2, None]
    q = spark.createDataFrame([(1, "你好"), (2, "time to eat"), (3, "ni hao"), (4, "你好 ok")], "id int, text string")
    got = {r.id: r.route for r in rules.route_text(q, q.filter("id = 3")).collect()}
    assert got == {1: "hanzi", 2: "translate", 3: "pinyin", 4: "translate"}


def plain_structure(text):
    """The same scan, character by character, with a stack."""
    starts = [i for i, c in enumerate(text) if c in "{["]
    if not starts:
        return None
    depth, inside, escaped = 0, False, False
    for i in range(starts[0], len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "{[":
            depth += 1
        elif not inside and c in "}]":
            depth -= 1
            if depth == 0:
                return text[starts[0] : i + 1]
    return None


def test_first_structure_equals_a_scan(spark):
    rnd = random.Random(8)
    texts = ["", "none", "{", "}", '{"a": "}"}', '{"a": {"b": 1}} and {"c": 2}', 'x [1, [2], {"y": []}] z', "\\{ {a}", '{"q": "\\\\"} "', "𝄞 {\"𝄞\": \"{\"} 𝄞"]
    texts += ["".join(rnd.choice('{}[]""\\\\a𝄞 \n') for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    texts += ["[" * 2000 + "]" * 2000 + "]", '{"k": "' + '\\"}' * 5000 + '"} tail']
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, t string")
    found = {r.id: r.s for r in df.select("id", rules.first_structure(F.col("t")).alias("s")).collect()}
    assert found == {-1: None, **{i: plain_structure(t) for i, t in enumerate(texts)}}


def test_loose_json_takes_the_first_balanced_structure(spark):
    rows = ['{"a":{"b":1}} and {"c":2}', 'so: [{"a": 1}, {"a": [2]}] or [3]', '```json\n{"a": {"b": 2}}\n``` {x}', '{"a": {"b": 3', "{not json} {\"a\": 1}", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    got = {r.id: r.parsed for r in rules.parse_loose_json(df, "t", "struct<a:struct<b:int>>").collect()}
    assert got[0].a.b == 1 and got[2].a.b == 2 and got[3] is None and got[4] is None and got[5] is None
    lists = {r.id: r.parsed for r in rules.parse_loose_json(df, "t", "array<struct<a:string>>").collect()}
    assert [x.a for x in lists[1]] == ["1", "[2]"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_never_broadcast_the_typed_syllables(spark, lex):
    typed = spark.createDataFrame([(q, p, s) for q in (1, 2) for p, s in enumerate(["gan", "fu", "shu", "gan"])], "query_id int, position int, syllable string")
    chips = ph.candidates(typed, lex.withColumn("frequent", F.lit(True)), limit=3)
    assert "BuildLeft" not in plan_of(QUERIES["candidates"](spark, "/root/testdata/sf0.001"))
    got = {(r.query_id, r.place): (r.traditional, r.syllable, r.turn) for r in chips.collect()}
    # each syllable in turn; the unknown one borrows from its neighbour, the repeated one adds nothing
    assert [got[1, k] for k in (1, 2, 3)] == [("乹", "gan", 1), ("㳇", "fu", 1), ("水", "shu", 1)]
    assert got[2, 3] == got[1, 3] and len(got) == 6


def test_word_cards_read_the_tokens_once(spark, lex):
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate(["你好", "我們", "水", None])], "n int, token string")
    cards = sg.word_cards(tokens, lex)
    plan = plan_of(cards)
    assert "Union" not in plan and plan.count("BroadcastHashJoin") == 2
    got = sorted((r.n, r.char_no, r.token, r.traditional, r.py_num, r.known) for r in cards.collect())
    assert got == [(0, 0, "你好", "你好", "ni3 hao3", True), (1, 0, "我", "我", "wo3", True), (1, 1, "們", "們", "", False), (2, 0, "水", "水", "shui3", True)]


def test_phrases_are_put_together_once_a_run(spark):
    phrases = QUERIES["phrase_rows"](spark, "/root/testdata/sf0.001")
    # the words of the places are not gathered, only those of distinct runs before
    assert "collect_list" not in plan_of(phrases)
    assert phrases.count() == phrases.select("utterance").distinct().count() == 46276


def test_structure_tokens_of_a_long_text_take_no_time_of_its_square(spark):
    from inkstone.operators.rules import structure_tokens

    rows = [("a", "x⟪2⟫yz⟪1.5⟫" * 20000), ("b", ""), ("c", None), ("d", "愛⟪q⟪3⟫𠀀")]
    df = spark.createDataFrame(rows, "id string, text string")
    out = structure_tokens(df, "id", "text")
    assert [tuple(r) for r in out.filter("id = 'd'").orderBy("token_no").collect()] == [
        ("d", 0, "愛", None, 0), ("d", 1, "q", None, 1), ("d", 2, None, 3.0, 2), ("d", 3, "𠀀", None, 2),
    ]
    # the fold that copied its list at each piece has no place in the plan
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter("id = 'a'").selectExpr("count(*)", "max(chars_before)").collect()[0] == (100000, 60000)


def test_error_rates_of_whole_texts_need_no_cell_for_each_pair_of_characters(spark):
    import random

    from pyspark.sql import functions as F

    from inkstone.functions.alignment import edit_distance
    from inkstone.operators import quality as ql

    rng = random.Random(1)
    texts = ["".join(rng.choice("天地玄黃𠀀") for _ in range(rng.choice([0, 1, 7, 40, 130]))) for _ in range(80)]
    pairs = list(zip(texts, texts[1:])) + [(None, "天"), ("天", None), ("天地", "天地")]
    df = spark.createDataFrame(pairs, "got string, truth string")
    found = ql.cer(df, han=False)
    plain = F.when(F.length("truth") > 0, F.levenshtein("got", "truth") / F.length("truth")).otherwise(F.lit(1.0))
    assert found.filter(~F.col("cer").eqNullSafe(F.round(plain, 6))).count() == 0
    assert found.columns == ["got", "truth", "cer"]
    # two texts of 20,000 characters took 400,000,000 cells
    a = "".join(rng.choice("天地玄黃") for _ in range(20_000))
    assert edit_distance(a, a[:5000] + "x" + a[5000:].replace("玄", "", 3)) == 4


def test_texts_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from inkstone.plans.views import table

    rows = 4000
    texts = pa.array([f"{i} {random.Random(i).random()} " * 20 for i in range(rows)])
    pq.write_table(pa.table({"doc_id": pa.array(range(rows)), "text": texts}), f"{tmp_path}/documents.parquet")
    assert pq.ParquetFile(f"{tmp_path}/documents.parquet").metadata.num_row_groups == 1
    setting = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(setting, "32k")
    try:
        cores = spark.sparkContext.defaultParallelism
        # more splits than cores, but one row group is read by one of them
        assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() >= cores
        read = table(spark, str(tmp_path), "documents")
        sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == rows and len(sizes) >= cores and max(sizes) < 2 * rows / cores
        assert read.columns == ["doc_id", "text"] and read.distinct().count() == rows
    finally:
        spark.conf.unset(setting)


def test_each_word_takes_accents_off_words_and_not_off_whole_texts(spark):
    from inkstone.plans.views import each_word, latin_words

    texts = ["Mañana, MANANA ça-va?", "\u212aelvin \u0130stanbul \u212bngström Stra\u1e9ee Straße", "x1y\u03a3z \u00ffq æon œuf 你好abc", "naïve e\u0301te\u0301 𠀀é", "", None, "...", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted(r.w for r in df.select(F.explode(latin_words("text")).alias("w")).collect())
    assert sorted(r.w for r in each_word(df).collect()) == want
    assert want.count("manana") == 2 and {"ca", "kelvin", "strase", "naive", "on", "e"} <= set(want)
    words = spark.createDataFrame([("é",), ("É",), ("e",)], "text string")
    assert [r.w for r in each_word(words).distinct().collect()] == ["e"]
    plan = QUERIES["word_cards_apart"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(lower(text" not in plan
