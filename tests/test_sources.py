"""Sources and sinks over real files."""

import json

from pyspark.sql import functions as F

from sceneframe.functions import naming as N
from sceneframe.operators import cache, catalog, problems, timeline
from sceneframe.sources import assets, logs, manifest, probes, scripts, settings, sinks, toollog, voices


def test_assets_from_a_folder(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    for name in ["001.jpg", "001.TXT", "Take.wav", ".hidden.jpg", "README", ".arranging-1.jpg"]:
        (tmp_path / "p1" / name).write_bytes(b"x")
    rows = assets.read_assets(spark, str(tmp_path)).select("project", "stem", "kind").collect()
    assert sorted(map(tuple, rows)) == [("p1", "001", "image"), ("p1", "001", "text"), ("p1", "Take", "audio")]
    # Spark's own listing hides dotfiles, so what a broken rename left comes from an inventory.
    listed = spark.createDataFrame([("/m/p1/.arranging-1.jpg",), ("/m/p1/.DS_Store",), ("/m/p1/001.jpg",)], "path string")
    assert [tuple(r) for r in catalog.interrupted_renames(listed).collect()] == [("p1", 1)]


def test_manifest_reads_and_refuses(spark, tmp_path):
    files = {
        "good": 'image,text,duration\nimg\\001.jpg," Hello, ""you"" ",\n 002.png ,,soon\n,,3\n',
        "other": '\ufeffaudio_file , image\r\n\r\na.wav,"3\n.png"\r\n"",5" screen.png',
        "typo": "image,zoom_ancor\na.jpg,c\n", "ragged": "image,text\na.jpg,b\nc.jpg\n", "twice": "image,image\na,b\n",
        "blind": "text\nhello\n", "empty": "",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.csv").write_bytes(content.encode())
    split = manifest.read_manifests(spark, str(tmp_path), F.regexp_extract("file", r"([^/]*)\.csv$", 1))
    rows = manifest.drafts(manifest.manifest_rows(split)).orderBy("project_id", "position").collect()
    assert [(r["project_id"], r["id"], r["text"], r["audio"], r["duration"], r["unread_duration"]) for r in rows] == [
        ("good", "001", 'Hello, "you"', None, None, None), ("good", "002", None, None, None, "soon"), ("good", "row 3", None, None, 3.0, None),
        ("other", "3\n", None, "a.wav", None, None), ("other", '5" screen', None, None, None, None)]
    assert dict(map(tuple, manifest.refused_manifests(split).collect())) == {
        "typo": "unknown columns: zoom_ancor", "ragged": "cells missing or left over in row 2", "twice": "a column is named twice",
        "blind": "no image column"}


def test_scripts_over_the_cap_are_refused_unread(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf hello \n")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"x" * (256 * 1024 + 1))
    rows = {r["path"][-5:]: (r["text"], r["problem"]) for r in scripts.read_scripts(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("hello", None), "/b.md": (None, "not_utf8"), "c.txt": (None, "too_large")}


def test_logs_round_trip(spark, tmp_path):
    events = spark.sql("""SELECT timestamp'2024-03-01 10:00:00.123' AS at, 'info' AS level, 'render' AS scope, 'password = x' AS message,
        map('k', 'v', 'api_key', 'z') AS fields, '=proj' AS project, '/media' AS folder""")
    logs.write_logs(events, str(tmp_path / "log"))
    back = logs.parse_lines(spark.read.text(str(tmp_path / "log")).select("value")).collect()
    assert back[0]["message"] == "password =[redacted]" and back[0]["fields"] == {"k": "v", "api_key": "[redacted]"}
    assert [p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("day")] == ["day=20240301"]
    logs.write_activity(logs.activity_rows(events), str(tmp_path / "runs"))
    row = logs.read_activity(spark, str(tmp_path / "runs")).first()
    assert (row["when"], row["project"], row["what happened"]) == ("2024-03-01T10:00:00.123Z", "'=proj", "password =[redacted]")


def test_written_logs_are_read_by_the_reader(spark, tmp_path):
    events = spark.createDataFrame(
        [("2026-01-02 03:04:05", "info", "s", "done", {"k": "v"}), ("2026-01-03 00:00:00", "error", "s", "password=x\rnext", None)],
        "at string, level string, scope string, message string, fields map<string,string>",
    ).withColumn("at", F.col("at").cast("timestamp"))
    logs.write_logs(events, str(tmp_path / "log"))
    assert logs.read_lines(spark, str(tmp_path / "log")).count() == 2


def test_script_names_of_any_case_are_read(spark, tmp_path):
    for name in ("a.txt", "b.Txt", "c.MD", "d.Md", "e.wav"):
        (tmp_path / name).write_text("text")
    assert scripts.read_scripts(spark, str(tmp_path)).count() == 4


def test_a_silent_file_has_no_loudness(spark):
    lines = spark.createDataFrame([(1, 1, '"input_i" : "-inf"'), (1, 2, '"input_tp" : "nan"'), (2, 1, '"input_i" : "-inf"'), (2, 2, '"input_i" : "-20.5"')], "file_id int, line_no int, line string")
    got = {r.file_id: (r.loudness, r.peak) for r in toollog.loudness(lines).collect()}
    assert got == {1: (None, None), 2: (-20.5, None)}


def test_a_missing_part_of_a_key_is_not_an_empty_one(spark):
    row = spark.range(1).select(cache.content_key(F.lit(None).cast("string"), F.lit("a")).alias("x"), cache.content_key(F.lit(""), F.lit("a")).alias("y")).first()
    assert row.x != row.y


def test_a_line_cut_short_is_kept_as_corrupt(spark):
    lines = spark.createDataFrame([('{"at":"2024-01-01T00:00:00.000Z","level":"in',), ('{"at":"2024-01-01T00:00:00.000Z","level":"info"}',)], "value string")
    rows = logs.parse_lines(lines).orderBy(F.col("corrupt").isNull()).collect()
    assert rows[0]["corrupt"] and rows[0]["level"] is None and rows[1]["level"] == "info" and rows[1]["fields"] == {}


def test_bundle_is_written_in_order(spark, tmp_path):
    env = spark.createDataFrame([("version", "1"), ("cores", "8")], "key string, value string")
    lines = spark.createDataFrame([("b.jsonl", 1, "b1"), ("a.jsonl", 2, "a2"), ("a.jsonl", 1, "a1")], "file string, line_no long, value string")
    logs.write_bundle(logs.bundle_lines(env, lines), str(tmp_path / "bundle"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "bundle").glob("part-*")))
    assert [t.split()[-1] for t in text.splitlines()] == ["8", "1", "a1", "a2", "b1"]


def test_probe_documents(spark):
    doc = {"streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "sample_aspect_ratio": "N/A", "nb_frames": "12", "duration": "x"}], "format": {"duration": "1.5"}}
    parsed = probes.parse(spark.createDataFrame([("f", json.dumps(doc)), ("g", "no json")], "film_id string, document string"))
    rows = {r["film_id"]: r for r in parsed.collect()}
    assert rows["f"]["readable"] and not rows["g"]["readable"]
    s = probes.streams(parsed).first()
    assert (s["sample_aspect_ratio"], s["nb_frames"], s["duration"], s["format_duration"]) == ("1:1", 12, None, 1.5)


def test_voice_table_without_a_rule(spark):
    lines = spark.createDataFrame([(1, 0, "Name   Gender"), (1, 1, "en-US-AvaNeural   Female   General  Warm"), (1, 2, "not a voice   Male")], "table_id long, line_no long, line string")
    assert [tuple(r) for r in voices.parse(lines).select("voice_id", "locale", "gender", "note").collect()] == [("en-US-AvaNeural", "en-US", "Female", "General · Warm")]


def test_pieces_are_appended_and_never_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "001", "a", False), (1, 1, "002", "b", False)], "project_id long, piece long, scene_id string, text string, too_long boolean")
    path = str(tmp_path / "pieces")
    sinks.write_pieces(rows, path)
    sinks.write_pieces(rows.withColumn("text", F.lit("other")), path)
    assert sorted(r["text"] for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_join_list_of_a_long_film_adds_up(spark, tmp_path):
    segments = spark.range(800).selectExpr("1L AS film_id", "id + 1 AS scene", "61L + id % 7 AS frames")
    timed = timeline.timeline(segments, F.lit(30).cast("bigint"))
    total = timed.agg(F.sum("micros"), F.sum("frames")).first()
    assert total[0] == round(total[1] * 1_000_000 / 30)
    lines = timeline.join_list(timed, F.concat(F.lit("s"), F.col("scene").cast("string")))
    short = lines.filter("scene <= 2").withColumn("film_id", F.lit(7).cast("bigint"))
    path = str(tmp_path / "lists")
    index = sinks.write_join_lists(lines.unionByName(short), path, buckets=4, entries=100).collect()
    files = list((tmp_path / "lists" / "lists").glob("bucket=*/*.txt"))
    assert len(files) <= 4 and len(files) == len({r["bucket"] for r in index}) and sum(r["entries"] for r in index) == 802
    assert sum(f.stat().st_size for f in files) == sum(r["bytes"] for r in index)
    films = spark.createDataFrame([(1,)], "film_id long")
    found = sinks.read_join_lists(spark, path, films).collect()
    assert [r["film_id"] for r in found] == [1]
    assert [line for line in found[0]["text"].splitlines() if line.startswith("file")] == [f"file 's{i}'" for i in range(1, 801)]
    assert {r["film_id"]: len(r["text"].splitlines()) for r in sinks.read_join_lists(spark, path).collect()} == {1: 1600, 7: 4}


def test_only_the_plan_moves_to_a_bucketed_store(spark, tmp_path):
    stored = spark.range(1000).selectExpr("CAST(id AS STRING) AS key", "id AS nb_frames", "CAST(NULL AS DOUBLE) AS seconds")
    cache.write_store(stored, "store_of_test", str(tmp_path / "store"), 8)
    spark.sql("DROP TABLE store_of_test")  # another session has only the files
    held = cache.open_store(spark, "store_of_test", str(tmp_path / "store"), 8, "key string, nb_frames bigint, seconds double")
    plan = spark.range(2000).selectExpr("1L AS film_id", "id AS scene", "CAST(id * 2 AS STRING) AS key", "id AS frames").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = cache.cache_plan(plan, held)
        text = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange hashpartitioning(key") == 1, text
    assert made.filter("reused").count() == 500
    assert cache.reuse_check(plan, held, F.lit(30)).count() == 500


def test_changes_of_an_inventory(spark):
    schema = "path string, length long, t long"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("c", 9, 0), (None, 1, 1), ("d", None, 1)], schema)
    new = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("e", 5, 1), ("d", None, 1), ("d", None, 1)], schema)
    plain = [d.select("path", "length", F.timestamp_seconds("t").alias("modificationTime"), F.lit("x").alias("change")) for d in (old, new)]
    got = sorted(map(tuple, assets.asset_changes(*plain).collect()))
    assert got == [("b", "changed", 1, 1), ("c", "gone", 1, None), ("e", "added", None, 5)]
    assert assets.asset_changes(plain[0], plain[0]).count() == 0


def test_numbers_are_read_by_one_grammar(spark):
    from sceneframe.functions.numbers import plain_number

    cells = {"5": 5.0, "5.": 5.0, ".5": 0.5, "-1e2": -100.0, "5d": None, "7f": None, "0x1p3": None, "1_0": None, "inf": float("inf"), " 5": None, "5\n": None, "": None, "1e400": float("inf")}
    rows = spark.createDataFrame([(k,) for k in cells] + [(None,)], "t string").select("t", plain_number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {**cells, None: None}


def test_a_key_changes_with_every_input(spark):
    base = {"content": "c", "audio_key": "a", "frames": 10, "motion": "m", "geometry": "g", "encoder": "e", "captions": "t"}
    rows = [base] + [{**base, name: (11 if name == "frames" else "other")} for name in base] + [{**base, "content": "ca", "audio_key": ""}]
    keys = [r["key"] for r in cache.segment_keys(spark.createDataFrame(rows)).collect()]
    assert len(set(keys)) == len(rows)


def test_a_project_of_nothing_has_no_problems_left_out(spark):
    empty = spark.createDataFrame([], "project_id long, position long, id string, image string, text string, audio string, duration double, voice string, zoom_direction string, zoom_anchor string, caption string")
    assert problems.scene_problems(problems.validate(empty)).count() == 0


def test_folders_of_one_name_stay_apart(spark, tmp_path):
    for root in ("x", "y"):
        (tmp_path / root / "p1").mkdir(parents=True)
        (tmp_path / root / "p1" / "001.jpg").write_bytes(b"1")
    found = assets.read_assets(spark, str(tmp_path)).select("project", "name").collect()
    assert sorted(map(tuple, found)) == [("x/p1", "001.jpg"), ("y/p1", "001.jpg")]


def test_a_film_with_an_unsafe_name_gets_no_join_list(spark):
    rows = [(1, 1, 10, "a.mp4"), (1, 2, 10, "b'\nfile 'c.mp4"), (2, 1, 10, "d.mp4"), (3, 1, 10, None)]
    timed = spark.createDataFrame(rows, "film_id long, scene int, micros long, n string")
    assert [(r.film_id, r.scene) for r in timeline.join_list(timed, F.col("n")).collect()] == [(2, 1)]
    assert sorted((r.film_id, r.scene) for r in timeline.refused_names(timed, F.col("n")).collect()) == [(1, 2), (3, 1)]


def test_a_key_stored_twice_is_checked_once(spark):
    plan = spark.createDataFrame([(1, 1, "k", 30)], "film_id long, scene int, key string, frames int")
    stored = spark.createDataFrame([("k", 30, 1.0), ("k", 30, 1.0)], "key string, nb_frames int, seconds double")
    assert [tuple(r) for r in cache.reuse_check(plan, stored, F.lit(30)).collect()] == [(1, 1, "k", True)]


def test_settings_steps_are_worked_out_once(spark):
    text = ["output", "aspect", "resolution", "manifest", "provider", "voice", "preset", "theme", "position", "motion_seed"]
    made = {c: "string" for c in text} | {c: "bigint" for c in ("project_id", "short_edge", "fps", "crf")}
    made |= {c: "double" for c in ("trim_head", "trim_tail", "duration", "zoom_amount")} | {"subtitles": "boolean"}
    raw = spark.range(1).selectExpr(*[f"cast(id AS {kind}) AS {c}" for c, kind in made.items()])
    found = settings.setting_problems(settings.resolve(raw))
    # A cell is trimmed once, in a test and its value.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2 * len(text)


def test_plain_paths_are_taken_as_they_are(spark):
    paths = ["img/001.jpg", "/img/001.jpg", "a//b", "a/./b", "a/../b", "../b", "a/", "", "/", ".a/b", "a/..b", "a b/c"]
    found = spark.createDataFrame([(p,) for p in paths], "path string").select(N.lexical_path(F.col("path")).alias("p")).collect()
    assert [r.p for r in found] == ["/img/001.jpg", "/img/001.jpg", "/a/b", "/a/b", "/b", None, "/a", "/", "/", "/.a/b", "/a/..b", "/a b/c"]


def test_segments_that_mean_nothing_are_dropped_in_place(spark):
    paths = ["./a.jpg", "././a", "///", ".", "a/.", "a/./", "a//.//b", "./.x", "a./b", "..." , "a..b/./c", "./..", "/" * 9000 + "a"]
    found = spark.createDataFrame([(p,) for p in paths], "path string").select(N.lexical_path(F.col("path")).alias("p")).collect()
    assert [r.p for r in found] == ["/a.jpg", "/a", "/", "/", "/a", "/a", "/a/b", "/.x", "/a./b", "/...", "/a..b/c", None, "/a"]


def test_listed_paths_are_worked_out_once(spark):
    assets = spark.createDataFrame([(1, 1, "a.jpg", "a", "jpg"), (1, 2, "b.jpg", "b", "jpg")], "project_id long, file_no int, name string, stem string, ext string")
    drafts = spark.createDataFrame([(1, "x\\..\\a.jpg"), (1, "../b.jpg"), (1, None)], "project_id long, image string")
    found = catalog.unlisted_images(assets, drafts)
    assert [r["name"] for r in found.collect()] == ["b.jpg"]
    # Not a second time in a filter for paths that are null.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(filter(split(") == 1
