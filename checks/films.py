"""Queries over segments, caches and probes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import relations as R
from checks.registry import register
from sceneframe.operators import cache, conformance, timeline
from sceneframe.sources import probes
from sceneframe.sources import sinks
from sceneframe.streaming.sinks import new_folder

def fps30():
    return F.lit(30).cast("bigint")


register("occurrence", lambda s, d: timeline.occurrences(R.f_segment(s, d).select("film_id", "scene", "image_no"), "image_no"), """
    SELECT film_id, scene, image_no, row_number() OVER (PARTITION BY film_id, image_no ORDER BY scene) - 1 AS occurrence FROM f_segment""")

TIMELINE_SQL = """
    timed AS (SELECT film_id, scene, frames, end_frames, floor_div(end_frames - frames) AS start_us, floor_div(end_frames) - floor_div(end_frames - frames) AS micros
      FROM (SELECT film_id, scene, frames, CAST(sum(frames) OVER (PARTITION BY film_id ORDER BY scene) AS BIGINT) AS end_frames FROM f_segment))"""
TIMELINE_SQL = TIMELINE_SQL.replace("floor_div(end_frames - frames)", "((end_frames - frames) * 2000000 + 24) // 48").replace(
    "floor_div(end_frames)", "(end_frames * 2000000 + 24) // 48")


def _timed(spark, sf):
    """Twenty-four frames a second, where hardly any boundary is a whole microsecond."""
    return timeline.timeline(R.f_segment(spark, sf).select("film_id", "scene", "frames"), F.lit(24).cast("bigint"))


register("timeline", _timed, f"WITH {TIMELINE_SQL} SELECT * FROM timed")


def join_list(spark, sf):
    name = F.concat(F.lit("seg-"), F.lpad(F.col("scene").cast("string"), 4, "0"), F.lit("-"),
                    F.lpad(F.col("film_id").cast("string"), 16, "0"), F.lit(".mp4"))
    return timeline.join_list(_timed(spark, sf), name)


register("join_list", join_list, f"""
    WITH {TIMELINE_SQL} SELECT film_id, scene, 'file ''seg-' || lpad(CAST(scene AS VARCHAR), 4, '0') || '-' || lpad(CAST(film_id AS VARCHAR), 16, '0')
      || '.mp4''' || chr(10) || 'duration ' || (micros // 1000000) || '.' || lpad(CAST(micros % 1000000 AS VARCHAR), 6, '0') AS line FROM timed""")


def join_list_files(spark, sf):
    """Every film's list, written into containers and cut out again by the index; long films in several parts."""
    path = new_folder(spark, "lists")
    sinks.write_join_lists(join_list(spark, sf), path, buckets=16, entries=3)
    return sinks.read_join_lists(spark, path)


register("join_list_files", join_list_files, f"""
    WITH {TIMELINE_SQL} SELECT film_id, string_agg('file ''seg-' || lpad(CAST(scene AS VARCHAR), 4, '0') || '-' || lpad(CAST(film_id AS VARCHAR), 16, '0')
      || '.mp4''' || chr(10) || 'duration ' || (micros // 1000000) || '.' || lpad(CAST(micros % 1000000 AS VARCHAR), 6, '0') || chr(10), '' ORDER BY scene) AS text
    FROM timed GROUP BY film_id""")


def stopped_at(spark, sf):
    films = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("film_id"), F.floor(F.col("o_totalprice") / 1000).alias("actual"))
    return timeline.stopped_at(R.f_segment(spark, sf).select("film_id", "scene", "frames"), films)


register("stopped_at", stopped_at, """
    SELECT film_id, min(scene) AS scene, any_value(actual) AS actual FROM (
      SELECT film_id, scene, sum(frames) OVER (PARTITION BY film_id ORDER BY scene) AS total, CAST(floor(o_totalprice / 1000) AS BIGINT) AS actual
      FROM f_segment JOIN orders ON o_orderkey = film_id) WHERE total > actual GROUP BY film_id""")

PLAN = ["film_id", "scene", "key", "frames", "kind", "provider"]


def _plan(spark, sf):
    return R.f_plan(spark, sf).select(*PLAN)


register("cache_plan", lambda s, d: cache.cache_plan(_plan(s, d), R.f_stored(s, d)), """
    SELECT film_id, scene, key, frames, kind, provider, key IN (SELECT key FROM f_stored) AS reused FROM f_plan""")
def cache_plan_store(spark, sf):
    """The plan against a store that lies in buckets by key."""
    name = f"store_{uuid.uuid4().hex}"
    return cache.cache_plan(_plan(spark, sf), cache.write_store(R.f_stored(spark, sf), name, new_folder(spark, "store"), buckets=16))


register("cache_plan_store", cache_plan_store, """
    SELECT film_id, scene, key, frames, kind, provider, key IN (SELECT key FROM f_stored) AS reused FROM f_plan""")
register("work_list", lambda s, d: cache.work_list(_plan(s, d), R.f_stored(s, d)), """
    SELECT key, count(*) AS wanted_by, min(film_id) AS film_id, min(scene) AS scene FROM f_plan WHERE key NOT IN (SELECT key FROM f_stored) GROUP BY key""")
register("distinct_work", lambda s, d: cache.distinct_work(
    _plan(s, d), lambda keys: keys.withColumn("samples", F.col("frames") * 1600)), """
    WITH once AS (SELECT key, any_value(frames) * 1600 AS samples FROM f_plan GROUP BY key)
    SELECT film_id, scene, p.key, frames, kind, provider, samples FROM f_plan p JOIN once o ON o.key = p.key""")
register("reuse_check", lambda s, d: cache.reuse_check(_plan(s, d), R.f_stored(s, d), fps30()), """
    SELECT film_id, scene, p.key, CASE WHEN nb_frames IS NOT NULL THEN nb_frames = frames ELSE abs(seconds - frames / 30.0::DOUBLE) <= 1.0::DOUBLE / 30 END AS fits
    FROM f_plan p JOIN (SELECT key, nb_frames, seconds FROM f_stored) s ON s.key = p.key""")
register("speech_needed", lambda s, d: cache.speech_needed(_plan(s, d), R.f_stored(s, d)), """
    SELECT provider, count(*) AS scenes FROM f_plan WHERE kind = 'tts' AND key NOT IN (SELECT key FROM f_stored) GROUP BY provider""")


register("speech_ready", lambda s, d: cache.speech_ready(_plan(s, d), R.f_stored(s, d)), """
    SELECT film_id, scene, kind <> 'tts' OR key IN (SELECT key FROM f_stored) AS ready FROM f_plan""")


def _live(spark, sf):
    return R.f_plan(spark, sf).filter("scene <= 1").select("film_id", "key")


_DEAD_SQL = """
    WITH live AS (SELECT DISTINCT film_id, key FROM f_plan WHERE scene <= 1), n AS (SELECT film_id, count(*) * 2 AS spare FROM live GROUP BY film_id),
    dead AS (SELECT *, CASE WHEN contains(name, '.partial-') THEN 'partial' WHEN name LIKE 'seg-%' THEN 'segment' END AS owner
      FROM f_stored WHERE (film_id, key) NOT IN (SELECT (film_id, key) FROM live)),
    r AS (SELECT d.film_id, d.key, name, owner, bytes, CASE WHEN owner = 'segment' THEN row_number() OVER w END AS age,
        CASE WHEN owner = 'segment' THEN row_number() OVER w > coalesce(spare, 0) ELSE owner IS NOT NULL END AS swept
      FROM dead d LEFT JOIN n ON n.film_id = d.film_id
      WINDOW w AS (PARTITION BY d.film_id, owner ORDER BY modified_at DESC, d.key))"""
register("retention", lambda s, d: cache.retention(R.f_stored(s, d), _live(s, d)), f"{_DEAD_SQL} SELECT * FROM r")
register("retention_bytes", lambda s, d: cache.retention_bytes(cache.retention(R.f_stored(s, d), _live(s, d))), f"""
    {_DEAD_SQL} SELECT film_id, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM r WHERE swept GROUP BY film_id""")


def log_retention(spark, sf):
    """Log files of each run, one a day: the newest five are kept."""
    e = R.f_event(spark, sf)
    files = e.groupBy(F.col("run_id"), F.date_format("at", "yyyyMMdd").alias("name")).agg(F.max("at").alias("modified_at"))
    return cache.newest(files, ["run_id"], 5).select("run_id", "name", "age", "kept")


register("log_retention", log_retention, """
    SELECT run_id, name, row_number() OVER w AS age, row_number() OVER w <= 5 AS kept
    FROM (SELECT run_id, strftime("at", '%Y%m%d') AS name, max("at") AS m FROM f_event GROUP BY ALL) WINDOW w AS (PARTITION BY run_id ORDER BY m DESC, name)""")


def _totals(spark, sf):
    hit = cache.cache_plan(_plan(spark, sf), R.f_stored(spark, sf))
    return timeline.film_totals(hit.withColumns({"reused_segment": F.col("reused"), "reused_audio": F.col("frames") % 2 == 0}), fps30())


TOTALS_SQL = """
    totals AS (SELECT film_id, count(*) AS segments, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(frames) AS BIGINT) / 30.0::DOUBLE AS seconds,
      count(*) FILTER (key IN (SELECT key FROM f_stored)) AS reused_segments, count(*) FILTER (frames % 2 = 0) AS reused_audio,
      count(*) FILTER (kind = 'tts' AND frames % 2 <> 0) AS spoken FROM f_plan GROUP BY film_id)"""
register("film_totals", _totals, f"WITH {TOTALS_SQL} SELECT * FROM totals")


def _parsed(spark, sf):
    return probes.parse(R.f_probe(spark, sf))


register(
    "probe_streams",
    lambda s, d: probes.streams(_parsed(s, d)).select(
        "film_id", "at", "index", "kind", "codec_name", "pix_fmt", "color_transfer", "sample_aspect_ratio", "sample_rate",
        "channels", "duration", "nb_frames", "format_duration"),
    """SELECT film_id, pos AS at, CASE kind WHEN 'audio' THEN 1 ELSE 0 END AS index, kind, CASE kind WHEN 'audio' THEN 'aac' ELSE v_codec END AS codec_name,
         CASE kind WHEN 'video' THEN v_pix END AS pix_fmt, CASE kind WHEN 'video' THEN v_transfer END AS color_transfer,
         CASE kind WHEN 'video' THEN v_sar ELSE '1:1' END AS sample_aspect_ratio, CASE kind WHEN 'audio' THEN a_rate END AS sample_rate,
         CASE kind WHEN 'audio' THEN 2 END AS channels, CASE kind WHEN 'video' THEN v_duration END AS duration,
         CASE kind WHEN 'video' THEN v_frames END AS nb_frames, c_duration AS format_duration
       FROM (SELECT *, unnest(str_split(kinds, ', ')) AS kind, unnest(range(len(str_split(kinds, ', ')))) AS pos FROM f_probe)""",
)
register("profile_mismatch", lambda s, d: conformance.profile_mismatch(_parsed(s, d), 1920, 1080, 30, 40), """
    SELECT film_id, field, expected, actual FROM (
      SELECT film_id, 'video_codec' AS field, 'h264' AS expected, v_codec AS actual FROM f_probe
      UNION ALL SELECT film_id, 'pix_fmt', 'yuv420p', v_pix FROM f_probe
      UNION ALL SELECT film_id, 'color_transfer', 'bt709', coalesce(v_transfer, '<absent>') FROM f_probe
      UNION ALL SELECT film_id, 'sample_aspect_ratio', '1:1', v_sar FROM f_probe
      UNION ALL SELECT film_id, 'stream_order', 'video, audio', kinds FROM f_probe
      UNION ALL SELECT film_id, 'audio_stream', 'present', CASE WHEN kinds = 'video' THEN 'absent' ELSE 'present' END FROM f_probe
      UNION ALL SELECT film_id, 'sample_rate', '48000', CAST(a_rate AS VARCHAR) FROM f_probe WHERE kinds <> 'video') WHERE expected <> actual""")


def film_check(spark, sf):
    p = probes.streams(_parsed(spark, sf)).filter("kind = 'video'").select(
        "film_id", "nb_frames", F.col("duration").alias("video_seconds"), F.col("format_duration").alias("container_seconds"))
    return timeline.film_check(_totals(spark, sf), p, fps30())


register("film_check", film_check, f"""
    WITH {TOTALS_SQL}, j AS (SELECT t.film_id, frames, v_frames, v_duration, c_duration FROM totals t JOIN f_probe p ON p.film_id = t.film_id)
    SELECT film_id, frames AS expected_frames, 'nb_frames' AS field, CAST(v_frames AS VARCHAR) AS actual FROM j WHERE v_frames <> frames
    UNION ALL SELECT film_id, frames, 'video duration', coalesce(CAST(CASE WHEN v_duration > 0 THEN v_duration END AS VARCHAR), '<undeclared>') FROM j
      WHERE coalesce(v_duration, 0) <= 0 OR abs(v_duration - frames / 30.0::DOUBLE) > 1.0::DOUBLE / 30
    UNION ALL SELECT film_id, frames, 'duration', CAST(c_duration AS VARCHAR) FROM j WHERE abs(c_duration - frames / 30.0::DOUBLE) > 1.0::DOUBLE / 30 + 1024.0::DOUBLE / 48000""")


def segment_keys(spark, sf):
    s = R.f_segment(spark, sf).select(
        "film_id", "scene", F.col("image_no").cast("string").alias("content"), F.col("bytes").alias("audio_key"), "frames",
        F.lit("zoom-in").alias("motion"), F.lit("1920x1080@30").alias("geometry"), F.lit("medium:18").alias("encoder"), F.lit("").alias("captions"))
    return cache.segment_keys(s).select("film_id", "scene", "key")


register("segment_keys", segment_keys, """
    SELECT film_id, scene, sha256(array_to_string(list_transform(
        [CAST(image_no AS VARCHAR), CAST(bytes AS VARCHAR), CAST(frames AS VARCHAR), 'zoom-in', '1920x1080@30', 'medium:18', ''],
        lambda v: lpad(CAST(length(v) AS VARCHAR), 8, '0') || v), '')) AS key FROM f_segment""")


def settings_key(spark, sf):
    """A key over settings that are listed in another order on every other row."""
    pairs = [F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")]
    turned = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(*pairs)).otherwise(F.create_map(*pairs[2:], *pairs[:2]))
    rows = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("scene"), turned.alias("settings"))
    return rows.select("scene", cache.content_key(cache.settings_field(F.col("settings"))).alias("key"))


register("settings_key", settings_key, """
    WITH f AS (SELECT o_orderkey AS scene, '00000008priority' || lpad(length(o_orderpriority)::VARCHAR, 8, '0') || o_orderpriority
        || '00000006status' || lpad(length(o_orderstatus)::VARCHAR, 8, '0') || o_orderstatus AS pairs FROM orders)
    SELECT scene, sha256(lpad(length(pairs)::VARCHAR, 8, '0') || pairs) AS key FROM f""")


def timing(spark, sf):
    """Frames, samples, padding and gain worked out for every line of the price list."""
    from sceneframe.functions import timing as T

    seconds = F.col("l_extendedprice") / 1000.0
    fps = F.element_at(F.array(F.lit(24), F.lit(25), F.lit(30), F.lit(60)), (F.col("pos") % 4).cast("int") + 1).cast("bigint")
    loud, peak = F.col("l_quantity") * -1.0, F.when(F.col("pos") % 3 > 0, F.col("l_quantity") * -0.3)
    base = R.line_pos(spark, sf).select("l_orderkey", "pos", seconds.alias("s"), fps.alias("fps"), loud.alias("loud"), peak.alias("peak"))
    frames = T.frames_for(F.col("s"), F.col("fps"))
    gained = T.gain_db(F.col("loud"), F.col("peak"))
    d = base.withColumn("frames", frames)
    return d.select(
        "l_orderkey", "pos", "frames", T.samples_for_frames(F.col("frames"), F.col("fps")).alias("samples"),
        T.samples_for_seconds(F.col("s")).alias("whole"), (T.pad_seconds(F.col("s"), F.col("frames"), F.col("fps")) >= 0).alias("padded"),
        F.round(gained * 10).cast("bigint").alias("gain"),
    )


register("timing", timing, """
    SELECT l_orderkey, pos, frames, CAST((frames * 48000 + fps // 2) // fps AS BIGINT) AS samples, CAST(floor(s * 48000 + 0.5) AS BIGINT) AS whole, true AS padded,
      CASE WHEN abs(g) >= 0.05 THEN CAST(round(g * 10) AS BIGINT) END AS gain
    FROM (SELECT *, greatest(1, CAST(ceil(s * fps - 1e-9) AS BIGINT)) AS frames,
            greatest(least(-16.0::DOUBLE - loud, coalesce(-1.5::DOUBLE - peak, 'inf'::DOUBLE), 24.0::DOUBLE), -24.0::DOUBLE) AS g
      FROM (SELECT l_orderkey, pos, l_extendedprice / 1000.0::DOUBLE AS s, ([24, 25, 30, 60])[CAST(pos % 4 AS INT) + 1] AS fps,
              l_quantity * -1.0::DOUBLE AS loud, CASE WHEN pos % 3 > 0 THEN l_quantity * -0.3::DOUBLE END AS peak FROM line_pos))""")
