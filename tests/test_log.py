import datetime
import random

from pyspark.sql import functions as F

from inkstone.operators import reviews as rv
from inkstone.sources import readers, writers
from inkstone.streaming.reviews import dedupe_saves_stream, review_queue_stream, review_state_stream

MOVE = {"again": lambda b: 0, "hard": lambda b: max(0, b - 1), "good": lambda b: min(5, b + 1), "easy": lambda b: min(5, b + 2)}


def _events(n, keys, seed=3):
    rng = random.Random(seed)
    # one entry holds most of the log
    return [(0 if rng.random() < 0.6 else rng.randrange(keys), 1_700_000_000 + rng.randrange(50_000), i, rng.choice(list(MOVE))) for i in range(n)]


def _replay(rows):
    state = {}
    for key, ts, i, outcome in sorted(rows, key=lambda r: (r[1], r[2])):
        box, streak, n = state.get(key, (0, 0, 0))[:3]
        state[key] = (MOVE[outcome](box), 0 if outcome == "again" else streak + 1, n + 1, ts)
    return {k: (b, s, n, ts + rv.INTERVALS[b]) for k, (b, s, n, ts) in state.items()}


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "entry_id bigint, s bigint, event_id bigint, outcome string")
    return df.select("entry_id", F.timestamp_seconds("s").alias("ts"), "event_id", "outcome")


def test_replay_with_a_hot_entry(spark):
    rows = _events(5000, 40)
    out = rv.replay_reviews(_frame(spark, rows)).withColumn("d", F.unix_timestamp("due")).collect()
    assert {r.entry_id: (r.box, r.streak, r.review_count, r.d) for r in out} == _replay(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = _events(300, 8, seed=5)
    random.Random(1).shuffle(rows)
    # a last event far ahead moves the watermark past everything else
    for i, part in enumerate((rows[:150], rows[150:], [(99, 1_800_000_000, 9999, "good")], [(98, 1_800_000_001, 10000, "good")])):
        _frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    schema = "entry_id bigint, ts timestamp, event_id bigint, outcome string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = (
        review_state_stream(source, "10 days").writeStream.outputMode("update").format("memory").queryName("states")
        .option("checkpointLocation", str(tmp_path / "c")).start()
    )
    query.processAllAvailable()
    query.stop()
    last = spark.table("states").groupBy("entry_id").agg(F.max_by(F.struct("box", "streak", "review_count"), "review_count").alias("s")).collect()
    got = {r.entry_id: (r.s.box, r.s.streak, r.s.review_count) for r in last if r.entry_id < 90}
    assert got == {k: v[:3] for k, v in _replay(rows).items()}


def test_saves_stream_and_restore(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, i % 2, "詞", f"ci{i % 3}", "zh-Hant", 1_700_000_000 + i) for i in range(12)],
        "id bigint, user_id bigint, traditional string, pinyin string, variety string, s bigint",
    ).withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "saves"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "saves"))
    for run in ("a", "b"):
        dedupe_saves_stream(source, str(tmp_path / "table"), str(tmp_path / f"ck-{run}")).awaitTermination(60)
    stored = spark.read.parquet(str(tmp_path / "table"))
    assert stored.count() == 6
    writers.write_snapshot(df, str(tmp_path / "dump"))
    dump = spark.read.parquet(str(tmp_path / "dump"))
    restored = stored.unionByName(writers.restore_rows(stored, dump))
    assert sorted(map(tuple, restored.collect())) == sorted(map(tuple, df.collect()))
    assert writers.restore_rows(restored, dump).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "dict.json").write_text('{"entries": [{"traditional": "綠", "simplified": "", "pinyin": "Lu:4", "english": ["green", "x"]}, {"traditional": "", "pinyin": "a1"}]}')
    r = readers.read_lexicon(spark, str(tmp_path / "dict.json")).collect()
    assert [(x.traditional, x.simplified, x.py_num, x.py_flat, x.english) for x in r] == [("綠", "綠", "lv4", "lv", "green / x")]
    (tmp_path / "t.tsv").write_text("# c\n你\tnei5\n好\tHAO\nbad\n")
    assert [(x.char, x.reading) for x in readers.read_tsv_readings(spark, str(tmp_path / "t.tsv")).collect()] == [("你", "nei5")]
    raw = spark.createDataFrame([("p", '```json\n{"lines":[{"n":2,"text":"你","dir":"v"},{"text":"⟪3⟫"},{"text":"好"}]}\n```'), ("q", '[{"text":"天"}]')], "page_id string, raw string")
    got = [(x.page_id, x.n, x.text, x.dir) for x in readers.read_model_lines(raw).orderBy("page_id", "line").collect()]
    assert got == [("p", 2, "你", "v"), ("p", 2, "好", "h"), ("q", 1, "天", "h")]
    (tmp_path / "page.json").write_text('{"items":[{"box":[1,2,3,4],"text":"你","score":0.9}],"w":10,"h":20}')
    r = readers.read_page_items(spark, str(tmp_path / "page.json")).collect()[0]
    assert (r.x1, r.y2, r.text, r.w) == (1.0, 4.0, "你", 10)


def test_save_with_a_null_reading_is_saved_once(spark):
    schema = "id bigint, user_id bigint, traditional string, pinyin string, variety string, created_at timestamp"
    import datetime

    row = (1, 1, "詞", None, "zh-Hant", datetime.datetime(2024, 1, 1))
    stored = spark.createDataFrame([row], schema)
    again = spark.createDataFrame([(2, *row[1:])], schema)
    from inkstone.operators.log import save_entries

    assert [r.duplicate for r in save_entries(stored, again).collect()] == [True]


def test_lexicon_files_of_lines_and_of_one_array(spark, tmp_path):
    import json

    entries = [{"traditional": f"字{k}", "simplified": f"字{k}", "pinyin": "zi4", "english": [f"sense {k}"]} for k in range(5)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, entries)))
    (tmp_path / "array.json").write_text(json.dumps(entries))
    (tmp_path / "object.json").write_text(json.dumps({"entries": entries}))
    for name, lines in (("lines", True), ("array", False), ("object", False)):
        rows = readers.read_lexicon(spark, str(tmp_path / f"{name}.json"), lines=lines).orderBy("ord").collect()
        assert [r.traditional for r in rows] == [e["traditional"] for e in entries]
        assert [r.ord for r in rows] == [1, 2, 3, 4, 5]
    flat = [{"traditional": "字", "simplified": "字", "pinyin": "Zi4", "english": str(k)} for k in range(3)]
    (tmp_path / "extra.json").write_text("\n".join(map(json.dumps, flat)))
    assert [r.english for r in readers.read_supplement(spark, str(tmp_path / "extra.json"), lines=True).orderBy("ord").collect()] == ["0", "1", "2"]
    (tmp_path / "chars.json").write_text("\n".join(json.dumps({"ch": "字", "simp": "字", "pinyin": "zi4", "english": e}) for e in ("", "word")))
    assert [r.english for r in readers.read_char_readings(spark, str(tmp_path / "chars.json"), lines=True).orderBy("ord").collect()] == ["(rare character)", "word"]


def test_quads_keep_their_measures_and_lines_are_strings(spark, tmp_path):
    import json

    (tmp_path / "q.json").write_text(json.dumps({"w": 9, "h": 9, "quads": [{"pts": [[0, 0], [1, 0], [1, 1], [0, 1]], "aabb": [0, 0, 1, 1], "angle": 3.5, "score": 0.5}]}))
    quad = readers.read_page_quads(spark, str(tmp_path / "q.json")).first()
    assert quad.aabb == [0, 0, 1, 1] and quad.angle == 3.5
    raw = [("a", '{"lines": [{"n": 1, "text": "一"}, {"n": 2, "text": 5}, {"n": 3, "text": null}]}'), ("b", '[{"text": "二", "dir": "v"}, 7]')]
    rows = readers.read_model_lines(spark.createDataFrame(raw, "page_id string, raw string")).collect()
    assert sorted((r.page_id, r.n, r.text, r.dir) for r in rows) == [("a", 1, "一", "h"), ("b", 1, "二", "v")]


def test_a_key_without_a_text_has_found_nothing(spark):
    from inkstone.operators.quality import known_phrase_recall

    texts = spark.createDataFrame([(1, "a b")], "k int, text string")
    phrases = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (2, "b")], "k int, phrase string")
    rows = {r.k: (r.phrases, r.found, r.passes) for r in known_phrase_recall(texts, phrases, "k").collect()}
    assert rows == {1: (2, 1, True), 2: (2, 0, False)}


def test_seeding_looks_at_what_is_there(spark, tmp_path):
    words = spark.range(10)
    path = str(tmp_path / "seed")
    assert writers.seed_table(words, path) and not writers.seed_table(words, path)
    assert spark.read.parquet(path).count() == 10


def test_history_and_meter_streams(spark, tmp_path):
    from inkstone.streaming.reviews import history_stream, meter_stream

    asks = [(k, 1, "text", "x" * 700, 1_700_000_000 + 86_400 * k) for k in range(3)]
    spark.createDataFrame(asks, "id bigint, user_id bigint, kind string, input string, s bigint").write.parquet(str(tmp_path / "asks"))
    source = spark.readStream.schema("id bigint, user_id bigint, kind string, input string, s bigint").parquet(str(tmp_path / "asks"))
    query = history_stream(source.withColumn("created_at", F.timestamp_seconds("s")), str(tmp_path / "history"), str(tmp_path / "c1"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "history")).collect()
    assert len(rows) == 3 and {len(r.input) for r in rows} == {500} and {r.photo_w for r in rows} == {0} and len({r.day for r in rows}) == 3

    lines = [f'{{"ts": "2024-01-01T00:{m:02d}:00Z", "page": "p", "served_by": "fusion", "proposals": 2, "verified": 1}}' for m in (1, 3, 8, 12, 59)]
    (tmp_path / "meter").mkdir()
    (tmp_path / "meter" / "a.json").write_text("\n".join(lines))
    counted = meter_stream(readers.stream_meter(spark, str(tmp_path / "meter")))
    done = counted.writeStream.outputMode("complete").format("memory").queryName("meters").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    done.awaitTermination()
    assert sorted((r.pages, r.proposals, r.verified) for r in spark.table("meters").collect()) == [(1, 2, 1), (1, 2, 1), (3, 6, 3)]


def _fed(spark, tmp_path, parts, stream, name):
    """Run a stream over one file a batch; all that it sends."""
    for i, part in enumerate(parts):
        _frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    schema = "entry_id bigint, ts timestamp, event_id bigint, outcome string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    query = stream(source).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).withColumn("s", F.unix_timestamp("ts")).withColumn("d", F.unix_timestamp("due")).collect()


def test_queue_stream_tells_states_due_cards_and_late_reviews(spark, tmp_path):
    start, hour = 1_700_000_000, 3600
    parts = [
        [(1, start, 1, "good"), (2, start + 60, 2, "again"), (3, start + 30, 3, "oops")],
        # three hours on: both cards are long due
        [(9, start + 3 * hour, 4, "good")],
        # behind the watermark, on it, and in time
        [(1, start + 2 * hour - 5, 5, "again"), (2, start + 2 * hour, 6, "good"), (2, start + 2 * hour + 1, 7, "good")],
        [(9, start + 40 * hour, 8, "easy")],
        [(9, start + 41 * hour, 9, "easy")],
    ]
    rows = _fed(spark, tmp_path, parts, lambda s: review_queue_stream(s, "1 hour"), "queue")
    late = {(r.entry_id, r.event_id, r.outcome) for r in rows if r.kind == "late"}
    assert late == {(1, 5, "again"), (2, 6, "good")} and sum(r.kind == "late" for r in rows) == 2
    due = sorted((r.entry_id, r.s) for r in rows if r.kind == "due")
    assert due == [(1, start + hour), (2, start + 660), (2, start + 3 * hour + 1), (9, start + 4 * hour)]
    counted = [r for p in parts for r in p if r[2] not in (3, 5, 6)]
    passed = [r for r in counted if r[1] <= start + 40 * hour]
    last = {}
    for r in rows:
        if r.kind == "state" and r.review_count > last.get(r.entry_id, (0, 0, 0))[2]:
            last[r.entry_id] = (r.box, r.streak, r.review_count, r.d)
    assert last == _replay(passed)


def test_queue_stream_equals_due_entries_at_the_watermark(spark, tmp_path):
    rows = _events(400, 12, seed=7)
    rows.sort(key=lambda r: r[1])
    end = max(r[1] for r in rows)
    parts = [rows[k : k + 100] for k in range(0, 400, 100)] + [[(99, end + 7200, 9000, "good")], [(99, end + 7201, 9001, "good")]]
    told = _fed(spark, tmp_path, parts, lambda s: review_queue_stream(s, "10 minutes"), "queue2")
    assert not [r for r in told if r.kind == "late"]
    now = end + 7201 - 600
    open_cards = {}
    for r in sorted((r for r in told if r.kind != "late"), key=lambda r: (r.review_count, r.kind == "due")):
        open_cards[r.entry_id] = r.kind == "due"
    batch = _replay([r for p in parts for r in p if r[1] <= now])
    assert {k for k, due in open_cards.items() if due} == {k for k, v in batch.items() if v[3] <= now}


def test_replay_in_a_tree_of_slices(spark):
    """Many parts and a small fan: three rounds; a null key is an entry of its own."""
    rows = _events(4000, 30, seed=11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        out = rv.replay_reviews(_frame(spark, rows), fan=3).withColumn("d", F.unix_timestamp("due")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.entry_id: (r.box, r.streak, r.review_count, r.d) for r in out} == _replay(rows)
    assert rv.replay_reviews(_frame(spark, rows).limit(0)).count() == 0


def test_saves_stream_reads_its_table_once(spark, tmp_path):
    schema = "id bigint, user_id bigint, traditional string, pinyin string, variety string, created_at timestamp"
    save = lambda i, word: (i, 1, word, "p", "zh", datetime.datetime(2024, 1, 1, 0, 0, i))
    spark.createDataFrame([save(1, "old"), save(2, None)], schema).write.parquet(str(tmp_path / "table"))
    batches = [[save(11, "old"), save(13, "new"), save(12, "new")], [save(14, "new"), save(15, None)], [save(16, "third"), save(17, "old")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = dedupe_saves_stream(source, str(tmp_path / "table"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 2, 12, 16]
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]][1:] == [2, 2]
