"""Streams over several micro-batches give what one batch gives."""

import datetime
import random

from pyspark.sql import functions as F

from checks import relations as R
from sceneframe.operators import activity, catalog
from sceneframe.streaming import intake, keyed, logs, sinks, throttle

SCHEMA = "run_id long, event_id long, at timestamp, refused boolean, answered boolean"


def _events(spark, n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        kind = rng.choice("rrra.")
        rows.append((1 if i % 3 == 0 else rng.randrange(6), i, 1_700_000_000 + i * 37, kind == "r", kind == "a"))
    return spark.createDataFrame(rows, "run_id long, event_id long, s long, refused boolean, answered boolean").select(
        "run_id", "event_id", F.timestamp_seconds("s").alias("at"), "refused", "answered")


def _in_batches(spark, events, parts=5):
    """One file per part, written one after the other, so that they are read in order."""
    folder = sinks.new_folder(spark, "test")
    top = events.agg(F.max("event_id")).first()[0] + 1
    for i in range(parts):
        low, high = top * i // parts, top * (i + 1) // parts
        events.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


def _clock(spark, events, folder, seconds=601):
    """A last row without a run, so far past the latest event."""
    events.agg((F.max("at") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("at")).selectExpr(
        "CAST(NULL AS BIGINT) AS run_id", "CAST(NULL AS BIGINT) AS event_id", "at", "false AS refused", "false AS answered",
    ).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _plain(episodes):
    return sorted(map(tuple, episodes.select(*[c.split()[0] for c in throttle.EPISODE.split(", ")]).collect()))


def _gave_up(rows, now):
    """Runs told event by event, and by the time alone at the end: the reference for give-ups."""
    out, runs = [], {}
    for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
        if not (r["refused"] or r["answered"]):
            continue
        run = runs.setdefault(r["run_id"], {"since": None, "warm": False, "ep": 0, "n": 0, "gone": False})
        _patience(r["run_id"], run, r["at"], out)
        if r["answered"]:
            run.update(since=None, warm=True, n=0, gone=False)
        else:
            if run["since"] is None:
                run.update(since=r["at"], ep=run["ep"] + 1)
            run["n"] += 1
    for key, run in runs.items():
        _patience(key, run, now, out)
    return sorted(out)


def _patience(key, run, now, out):
    limit = run["since"] and run["since"] + datetime.timedelta(seconds=3600 if run["warm"] else 180)
    if limit and not run["gone"] and limit <= now:
        run["gone"] = True
        out.append((key, run["ep"], limit, run["n"]))


def test_monitor_matches_the_batch_report(spark):
    events = _events(spark)
    stream, folder = _in_batches(spark, events)
    _clock(spark, events, folder)
    told = throttle.monitor(stream, folder)
    assert _plain(throttle.episodes(told)) == _plain(activity.throttle_episodes(events))
    rows = events.collect()
    now = max(r["at"] for r in rows) + datetime.timedelta(seconds=1)
    want = _gave_up(rows, now)
    assert want and sorted(map(tuple, throttle.give_ups(told).collect())) == want


def test_patience_runs_out_without_another_event(spark):
    """A streak that nobody adds to is given up when its time has come, and only then."""
    first = spark.createDataFrame([(1, 1, 0, True, False)], "run_id long, event_id long, s long, refused boolean, answered boolean").select(
        "run_id", "event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "refused", "answered")
    stream, folder = _in_batches(spark, first, 1)
    _clock(spark, first, folder, 600 + 179)
    assert throttle.give_ups(throttle.monitor(stream, folder)).count() == 0
    _clock(spark, first, folder, 600 + 181)
    given = throttle.give_ups(throttle.monitor(stream, folder)).collect()
    assert [(r["run_id"], r["episode"], r["refusals"]) for r in given] == [(1, 1, 1)]


def _announced(rows):
    want, seen = [], {}
    for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
        run = seen.setdefault(r["run_id"], {"ep": 0, "streak": False, "told": None})
        if r["answered"]:
            run["streak"] = False
        if r["refused"]:
            if not run["streak"]:
                run["streak"], run["ep"] = True, run["ep"] + 1
            told = run["told"]
            if told is None or (told[0] != run["ep"] and (r["at"] - told[1]).total_seconds() >= 600):
                run["told"] = (run["ep"], r["at"])
                want.append((r["run_id"], r["event_id"], run["ep"]))
    return sorted(want)


def test_announcements_match_brute_force(spark):
    events = _events(spark)
    stream, folder = _in_batches(spark, events)
    _clock(spark, events, folder)
    got = sorted((r["run_id"], r["event_id"], r["episode"]) for r in throttle.announce(stream, folder).collect())
    assert got == _announced(events.collect())


def test_rows_out_of_order_within_the_watermark_tell_the_same(spark):
    events = _events(spark, 200)
    folder = sinks.new_folder(spark, "test")
    # Neighbours up to 7 events (under five minutes) apart change places, also over file ends.
    mixed = events.withColumn("place", F.col("event_id") + F.pmod(F.xxhash64("event_id"), F.lit(7)))
    for i in range(4):
        mixed.filter((F.col("place") >= 52 * i) & (F.col("place") < 52 * i + 52)).drop("place").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _clock(spark, events, folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = sorted((r["run_id"], r["event_id"], r["episode"]) for r in throttle.announce(stream, f"{folder}/a").collect())
    assert got == _announced(events.collect())
    assert _plain(throttle.episodes(throttle.monitor(stream, f"{folder}/b"))) == _plain(activity.throttle_episodes(events))


def test_monitor_goes_on_after_restarts_with_and_without_data(spark):
    events = _events(spark)
    stream, folder = _in_batches(spark, events.filter("event_id < 200"), 2)
    first = sorted(map(tuple, throttle.monitor(stream, folder).collect()))
    assert first and sorted(map(tuple, throttle.monitor(stream, folder).collect())) == first
    events.filter("event_id >= 200").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _clock(spark, events, folder)
    told = throttle.monitor(stream, folder)
    assert _plain(throttle.episodes(told)) == _plain(activity.throttle_episodes(events))


def test_quiet_runs_leave_the_state(spark):
    """A run that is over holds no state: one day after its last event with a quiet time of a day."""
    events = _events(spark, 60)
    stream, folder = _in_batches(spark, events, 1)
    _clock(spark, events, folder, 86_400 + 601)
    with keyed.keyed_store(spark):
        sinks.run_append(throttle.watch(stream, quiet_days=1), folder)
    for variable in ("waiting", "kept"):
        state = spark.read.format("statestore").option("stateVarName", variable)
        assert state.load(f"{folder}/checkpoint").count() == 0


def test_finished_runs_leave_the_state_of_progress(spark):
    events = _events(spark, 100).select("run_id", F.lit("x").alias("kind"), "at")
    late = events.selectExpr("CAST(9 AS BIGINT) AS run_id", "kind", "at + INTERVAL 10 DAYS AS at").limit(1)
    folder = sinks.new_folder(spark, "test")
    for part in (events, late):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    done = logs.run_progress(stream, folder, "1 hour", quiet="1 day")
    got = sorted((r["run_id"], r["events"]) for r in done.collect())
    want = sorted((r["run_id"], r["count"]) for r in events.groupBy("run_id").count().collect())
    assert got == want
    assert spark.read.format("statestore").load(f"{folder}/checkpoint").count() == 1


def test_late_rows_are_counted_exactly(spark):
    day = [(i, f"2024-01-0{1 + i // 40} 0{i % 9}:00:00", "info") for i in range(120)]
    late = [(900 + i, "2024-01-01 05:00:00", "error") for i in range(7)] + [(950, "2024-01-03 01:00:00", "info"), (951, None, "info")]
    folder = sinks.new_folder(spark, "test")
    # Rows are held against the watermark that the batch before last has set, hence the row between.
    for part in (day, [(800, "2024-01-03 08:30:00", "info")], late):
        rows = spark.createDataFrame(part, "event_id long, at string, level string").selectExpr("event_id", "CAST(at AS TIMESTAMP) AS at", "'s' AS scope", "level")
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    days = {r["day"]: r["events"] for r in logs.daily_counts(stream, folder).collect()}
    assert days == {"20240101": 40, "20240102": 40}
    assert logs.daily_account(spark, folder) == {"arrived": 130, "given": 80, "held": 42, "untimed": 1, "late": 7}
    # A restart without anything new adds nothing.
    logs.daily_counts(stream, folder)
    assert logs.daily_account(spark, folder)["late"] == 7


def test_streams_over_an_empty_folder_give_no_rows(spark):
    folder = sinks.new_folder(spark, "test")
    _events(spark, 3).filter("run_id < 0").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    assert throttle.episodes(throttle.monitor(stream, f"{folder}/monitor")).count() == 0
    assert throttle.announce(stream, f"{folder}/announce").count() == 0
    counted = stream.select("at", "run_id", F.lit("x").alias("kind"))
    assert logs.run_progress(counted, f"{folder}/progress").count() == 0


def test_intake_run_again_without_new_files_keeps_its_summaries(spark):
    folder = sinks.new_folder(spark, "test")
    files = R.f_asset(spark, "/root/testdata/sf0.001").filter("project_id < 50")
    catalog.classified(files).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    first = sorted(map(tuple, intake.intake(stream, folder).collect()), key=repr)
    assert first and sorted(map(tuple, intake.intake(stream, folder).collect()), key=repr) == first


def test_a_batch_of_intake_reads_its_own_projects_only(spark):
    """Ten batches of two projects each: a batch hands over the files of its two, whatever came before."""
    folder = sinks.new_folder(spark, "test")
    files = catalog.classified(R.f_asset(spark, "/root/testdata/sf0.001").filter("project_id < 20"))
    for i in range(6):
        files.filter(f"project_id in ({i}, {i + 1})").filter(f"project_id = {i} or file_no % 2 = {i % 2}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    seen = []

    def each(batch, batch_id):
        rows = batch.select("project_id", "file_no").collect()
        seen.append(({r["project_id"] for r in rows}, len(rows)))

    with keyed.keyed_store(spark):
        sinks.run_batches(intake.touched_files(stream), f"{folder}/x", each, mode="update")
    assert [sorted(p) for p, _ in seen if p] == [[p for p in (i, i + 1) if files.filter(f"project_id = {p}").count()] for i in range(6)]
    assert max(n for _, n in seen) <= 3 * max(r["count"] for r in files.groupBy("project_id").count().collect())
