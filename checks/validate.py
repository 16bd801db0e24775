"""Queries over drafts, settings and stills, and the report of every problem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import relations as R
from checks.catalog import SLOTS_SQL, listed_cells
from checks.registry import register
from checks.relations_sql import RELATIONS
from sceneframe.operators import problems, stills
from sceneframe.operators.catalog import scene_slots
from sceneframe.plans import validate
from sceneframe.sources import manifest, settings

SP = r"\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def _sql_clean(c: str) -> str:
    return f"nullif({_sql_trim(c)}, '')"


# --- drafts ------------------------------------------------------------------
CELLS = ["image", "text", "audio_file", "voice", "duration", "zoom_direction", "zoom_anchor", "caption"]


def _csv_lines(spark, sf):
    """The draft relation as CSV text, whitespace in the spoken text collapsed to one line."""
    d = R.f_draft(spark, sf)
    cells = [F.regexp_replace(c, r"\s+", " ").alias(c) for c in CELLS]
    options = {"quoteAll": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return d.select("project_id", F.col("scene").alias("position"), F.to_csv(F.struct(*cells), options).alias("line"))


def _drafts(spark, sf):
    return manifest.drafts(manifest.parse_lines(_csv_lines(spark, sf)))


RELATIONS["m_draft"] = f"""
    SELECT project_id, position, coalesce(nullif(trim(regexp_extract(regexp_extract(image, '([^/{chr(92)*2}]*)$', 1), '^(.+?)([.][^.]*)?$', 1)), ''), 'row ' || position) AS id,
      image, text, audio_file AS audio, TRY_CAST(duration AS DOUBLE) AS duration,
      CASE WHEN TRY_CAST(duration AS DOUBLE) IS NULL THEN duration END AS unread_duration,
      voice, zoom_direction, zoom_anchor, caption
    FROM (SELECT project_id, scene AS position, {', '.join(f"nullif(trim(regexp_replace({c}, '[ {chr(92)}t{chr(92)}n{chr(92)}f{chr(92)}r{chr(92)}x0B]+', ' ', 'g')), '') AS {c}" for c in CELLS)} FROM f_draft)"""
register("manifest_scan", _drafts, "SELECT * FROM m_draft")


def _manifests(spark, sf):
    """Every draft as a manifest of its own: all columns, three of them, a typo, a ragged row."""
    d = _drafts(spark, sf)
    d = d.withColumn("duration", F.coalesce(F.col("duration").cast("string"), "unread_duration")).withColumnRenamed("audio", "audio_file")
    options = {"quoteAll": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    full, few = F.to_csv(F.struct(*CELLS), options), F.to_csv(F.struct("duration", "image", "text"), options)
    head = ",".join(CELLS)
    content = (
        F.when(F.col("position") % 4 == 0, F.concat(F.lit(f"\ufeff{head}\r\n\r\n"), full, F.lit("\r\n")))
        .when(F.col("position") % 4 == 1, F.concat(F.lit("duration, image ,text\n"), few))
        .when(F.col("position") % 4 == 2, F.concat(F.lit(head.replace("anchor", "ancor") + "\n"), full))
        .otherwise(F.concat(F.lit(head + "\n"), full, F.lit("\nx.png\n")))
    )
    return manifest.split_manifests(d.select(F.concat_ws(":", "project_id", "position").alias("project_id"), content.alias("content")))


def manifest_files(spark, sf):
    return manifest.drafts(manifest.manifest_rows(_manifests(spark, sf))).select(
        "project_id", "position", "image", "text", "audio", "duration", "unread_duration", "voice", "zoom_anchor")


register("manifest_files", manifest_files, """
    SELECT project_id || ':' || position AS project_id, 1 AS position, image, text, CASE WHEN position % 4 = 0 THEN audio END AS audio, duration, unread_duration,
      CASE WHEN position % 4 = 0 THEN voice END AS voice, CASE WHEN position % 4 = 0 THEN zoom_anchor END AS zoom_anchor
    FROM m_draft WHERE position % 4 IN (0, 1)""")
register("manifest_refusals", lambda s, d: manifest.refused_manifests(_manifests(s, d)), """
    SELECT project_id || ':' || position AS project_id,
      CASE position % 4 WHEN 2 THEN 'unknown columns: zoom_ancor' ELSE 'cells missing or left over in row 2' END AS refused
    FROM m_draft WHERE position % 4 IN (2, 3)""")


def _checked_sql(source: str) -> str:
    motion = "replace(replace(lower(" + _sql_trim("zoom_direction") + "), '_', '-'), ' ', '-')"
    anchor = "replace(replace(lower(" + _sql_trim("zoom_anchor") + "), '_', '-'), ' ', '-')"
    return f"""
    SELECT *, CASE WHEN zoom_direction IS NOT NULL AND m IN ('zoom-in','zoom-out','pan-left','pan-right','pan-up','pan-down') THEN m END AS motion,
      CASE WHEN an IN ('center','centre','middle','c') THEN 'center' WHEN an IN ('north','top','n') THEN 'north'
           WHEN an IN ('south','bottom','s') THEN 'south' WHEN an IN ('west','left','w') THEN 'west' WHEN an IN ('east','right','e') THEN 'east'
           WHEN an IN ('north-west','top-left','left-top','nw') THEN 'north-west' WHEN an IN ('north-east','top-right','right-top','ne') THEN 'north-east'
           WHEN an IN ('south-west','bottom-left','left-bottom','sw') THEN 'south-west' WHEN an IN ('south-east','bottom-right','right-bottom','se') THEN 'south-east' END AS anchor,
      CASE WHEN n = 0 THEN 'no_audio_source' WHEN n > 1 THEN 'conflicting_audio_sources'
           WHEN has_text AND {_sql_trim('text')} = '' THEN 'blank_text'
           WHEN has_duration AND NOT (duration > 0 AND isfinite(duration)) THEN 'duration_not_positive'
           WHEN has_duration AND duration > 3600 THEN 'duration_absurd' END AS source_problem,
      concat_ws(',', CASE WHEN has_text THEN 'text' END, CASE WHEN has_audio THEN 'audio_file' END, CASE WHEN has_duration THEN 'duration' END) AS declared,
      CASE WHEN has_text THEN 'tts' WHEN has_audio THEN 'file' ELSE 'silent' END AS only_kind
    FROM (SELECT *, CAST(has_text AS INT) + CAST(has_audio AS INT) + CAST(has_duration AS INT) AS n FROM (
      SELECT *, {motion} AS m, {anchor} AS an, text IS NOT NULL AND text <> '' AS has_text,
        audio IS NOT NULL AND {_sql_trim('audio')} <> '' AS has_audio, duration IS NOT NULL AS has_duration FROM {source}))"""


RELATIONS["raw_draft"] = """
    SELECT project_id, scene AS position, image AS id, image, text, audio_file AS audio, TRY_CAST(duration AS DOUBLE) AS duration,
           voice, zoom_direction, zoom_anchor, caption FROM f_draft"""


def _raw_drafts(spark, sf):
    """Drafts as they come, cells untrimmed, so that blank text is told apart from none."""
    return R.f_draft(spark, sf).select(
        "project_id", F.col("scene").alias("position"), F.col("image").alias("id"), "image", "text",
        F.col("audio_file").alias("audio"), F.col("duration").try_cast("double").alias("duration"),
        "voice", "zoom_direction", "zoom_anchor", "caption",
    )


register(
    "source_check",
    lambda s, d: problems.source_check(_raw_drafts(s, d)).select(
        "project_id", "position", F.array_join("declared", ",").alias("declared"), "source_problem", "source_kind"),
    f"""SELECT project_id, position, declared, source_problem, CASE WHEN source_problem IS NULL THEN only_kind END AS source_kind
        FROM ({_checked_sql('raw_draft')})""",
)
register(
    "alias_resolve",
    lambda s, d: problems.resolve_aliases(_raw_drafts(s, d)).select("project_id", "position", "motion", "anchor"),
    f"SELECT project_id, position, motion, anchor FROM ({_checked_sql('raw_draft')})",
)


def scene_id_check(spark, sf):
    """Ids made of folder names, some of them with characters no scene id may hold."""
    pick = F.col("file_no") % 6
    text = (
        F.when(pick == 1, F.concat("stem", F.lit("/x"))).when(pick == 2, F.lit(" .. ")).when(pick == 3, F.concat("stem", F.lit("\u0007")))
        .when(pick == 4, F.lit("  ")).when(pick == 5, F.concat("stem", F.lit("\\y"))).otherwise(F.concat(F.lit(" "), "stem"))
    )
    from sceneframe.functions.naming import scene_id_problem

    return R.f_asset(spark, sf).withColumn("id", text).select("project_id", "file_no", scene_id_problem(F.col("id")).alias("problem"))


register("scene_id_check", scene_id_check, """
    SELECT project_id, file_no, (['ok', 'path_separator', 'relative_directory', 'control_character', 'blank', 'path_separator'])[CAST(file_no % 6 AS INT) + 1] AS p,
    FROM f_asset""".replace(" AS p,", " AS problem").replace("'ok'", "NULL"))

RELATIONS["m_valid"] = f"""
    SELECT *, concat_ws('|',
        CASE WHEN image IS NULL THEN 'missing_image' END, source_problem,
        CASE WHEN zoom_direction IS NOT NULL AND motion IS NULL THEN 'unknown_zoom_direction' END,
        CASE WHEN zoom_anchor IS NOT NULL AND anchor IS NULL THEN 'unknown_zoom_anchor' END) AS kinds,
      contains(id, '/') OR contains(id, chr(92)) OR id IN ('.', '..') AS bad_id FROM ({_checked_sql('m_draft')})"""
RELATIONS["m_scene"] = """
    SELECT *, CASE WHEN caption IS NOT NULL THEN caption WHEN only_kind = 'tts' THEN text END AS caption_text,
      row_number() OVER (PARTITION BY project_id, id ORDER BY position) AS repeat
    FROM m_valid WHERE kinds = '' AND NOT bad_id"""


def _validated(spark, sf):
    return problems.validate(_drafts(spark, sf))


register(
    "caption_resolve",
    lambda s, d: _validated(s, d).filter(F.size("problems") == 0).select("project_id", "scene_id", "position", "source_kind", "caption_text"),
    "SELECT project_id, id AS scene_id, position, only_kind AS source_kind, caption_text FROM m_scene",
)
register("duplicate_ids", lambda s, d: problems.duplicate_ids(_validated(s, d)),
         "SELECT project_id, id AS scene_id, position, repeat FROM m_scene WHERE repeat > 1")
register("source_mix", lambda s, d: problems.source_mix(_validated(s, d)), """
    SELECT project_id, count(*) FILTER (only_kind = 'tts') AS narrated, count(*) FILTER (only_kind = 'file') AS supplied,
           count(*) FILTER (only_kind = 'silent') AS silent FROM m_scene WHERE repeat = 1 GROUP BY project_id""")
register("scene_listing", lambda s, d: problems.scene_listing(_validated(s, d)), """
    SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY position) AS line, id AS scene_id, only_kind AS source_kind, image
    FROM m_scene WHERE repeat = 1 QUALIFY count(*) OVER (PARTITION BY project_id) <= 20""")


def _files(spark, sf):
    """Files that exist: a picture and a recording for most scenes."""
    s = R.f_scene(spark, sf).filter((F.col("project_id") + F.col("scene")) % 13 != 0)
    number = F.lpad(F.col("scene").cast("string"), 3, "0")
    return s.select("project_id", F.explode(F.array(
        F.concat(F.lit("img/"), number, F.lit(".jpg")), F.concat(F.lit("rec/"), number, F.lit(".wav")))).alias("path"))


RELATIONS["m_file"] = """
    SELECT project_id, unnest(['/img/' || lpad(CAST(scene AS VARCHAR), 3, '0') || '.jpg', '/rec/' || lpad(CAST(scene AS VARCHAR), 3, '0') || '.wav']) AS path
    FROM f_scene WHERE (project_id + scene) % 13 <> 0"""
RELATIONS["m_path"] = """
    SELECT project_id, position, id, bad_id, field, cell, CASE WHEN cell = 'img/a..b/' THEN '/img/a..b' ELSE '/' || replace(cell, chr(92), '/') END AS path
    FROM (SELECT project_id, position, id, bad_id, unnest(['image', 'audio_file']) AS field, unnest([image, audio]) AS cell FROM m_valid) WHERE cell IS NOT NULL"""

register("resolve_scenes", lambda s, d: problems.resolve_scenes(_validated(s, d), _files(s, d)), """
    WITH firsts AS (SELECT project_id, id, min(position) AS p FROM m_valid GROUP BY ALL)
    SELECT s.project_id, s.id AS scene_id, f.p AS position, s.only_kind AS source_kind, i.path AS image,
           CASE WHEN s.only_kind = 'file' THEN a.path END AS audio, s.caption_text
    FROM m_scene s JOIN firsts f ON f.project_id = s.project_id AND f.id = s.id
      JOIN m_path i ON i.project_id = s.project_id AND i.position = f.p AND i.field = 'image'
      LEFT JOIN m_path a ON a.project_id = s.project_id AND a.position = f.p AND a.field = 'audio_file'
    WHERE s.repeat = 1 AND EXISTS (SELECT 1 FROM m_file m WHERE m.project_id = i.project_id AND m.path = i.path)
      AND (s.only_kind <> 'file' OR EXISTS (SELECT 1 FROM m_file m WHERE m.project_id = a.project_id AND m.path = a.path))""")

# --- settings ----------------------------------------------------------------
RELATIONS["s_clean"] = f"""
    SELECT * REPLACE ({', '.join(f"{_sql_clean(c)} AS {c}" for c in ['output', 'aspect', 'resolution', 'manifest', 'provider', 'voice', 'preset', 'theme', 'position', 'motion_seed'])}) FROM f_settings"""
RELATIONS["s_geometry"] = """
    SELECT *, CASE WHEN a IS NULL THEN NULL WHEN edge <= 0 THEN 'p' WHEN edge % 2 <> 0 THEN 'o' WHEN a <> '1:1' AND edge % 9 <> 0 THEN 'n'
        WHEN fps2 <= 0 OR fps2 > 120 THEN 'f'
        WHEN CAST(ceil(w / 16.0) AS BIGINT) * CAST(ceil(h / 16.0) AS BIGINT) > 36864 THEN 'l' END AS refused
    FROM (SELECT *, CASE a WHEN '16:9' THEN edge // 9 * 16 ELSE edge END AS w, CASE a WHEN '9:16' THEN edge // 9 * 16 ELSE edge END AS h FROM (
      SELECT *, CASE WHEN aspect IS NULL THEN '16:9' WHEN replace(lower(aspect), 'x', ':') IN ('16:9') THEN '16:9'
                WHEN replace(lower(aspect), 'x', ':') IN ('portrait', 'reels') THEN '9:16' WHEN replace(lower(aspect), 'x', ':') IN ('1:1') THEN '1:1' END AS a,
        coalesce(short_edge, CASE WHEN short_edge IS NULL THEN sized END, 1080) AS edge, coalesce(fps, 30) AS fps2
      FROM (SELECT *, CASE lower(resolution) WHEN '4k' THEN 2160 WHEN '1080p' THEN 1080 WHEN 'hd' THEN 720 WHEN '2k' THEN 1440 END AS sized FROM s_clean)))"""


def settings_resolve(spark, sf):
    return settings.resolve(R.f_settings(spark, sf)).drop("problems")


register("settings_resolve", settings_resolve, """
    SELECT project_id, coalesce(output, 'out.mp4') AS output,
      CASE WHEN a IS NOT NULL AND refused IS NULL THEN a ELSE '16:9' END AS aspect,
      CASE WHEN a IS NOT NULL AND refused IS NULL THEN edge ELSE 1080 END AS short_edge,
      CASE WHEN a IS NOT NULL AND refused IS NULL THEN fps2 ELSE 30 END AS fps,
      manifest, coalesce(provider, 'edge') AS provider, coalesce(voice, 'default') AS voice,
      CASE WHEN trim_head <= 10 THEN trim_head ELSE 0.1::DOUBLE END AS trim_head, CASE WHEN trim_tail <= 10 THEN trim_tail ELSE 0.25::DOUBLE END AS trim_tail,
      coalesce(preset, 'medium') AS preset, CASE WHEN crf <= 51 THEN crf ELSE 18 END AS crf,
      CASE WHEN duration > 0 AND duration <= 3600 THEN duration ELSE 4.0 END AS silent_seconds,
      CASE WHEN zoom_amount BETWEEN 0.02 AND 0.5 THEN zoom_amount ELSE 0.1::DOUBLE END AS amount,
      coalesce(subtitles, false) AS subtitles, CASE WHEN lower(theme) IN ('glow', 'boxed') THEN lower(theme) ELSE 'classic' END AS theme,
      CASE WHEN lower(position) IN ('top', 'bottom') THEN lower(position) ELSE 'bottom' END AS placement,
      CASE WHEN lower(motion_seed) IN ('v1', 'v2') THEN lower(motion_seed) ELSE 'v1' END AS motion_seed
    FROM s_geometry""")


RELATIONS["s_problem"] = """
    SELECT * FROM (
      SELECT project_id, 'aspect' AS field, aspect AS value FROM s_geometry WHERE aspect IS NOT NULL AND a IS NULL
      UNION ALL SELECT project_id, 'resolution', resolution FROM s_geometry WHERE resolution IS NOT NULL AND (sized IS NULL OR short_edge IS NOT NULL)
      UNION ALL SELECT project_id, CASE WHEN fps IS NOT NULL AND edge = 1080 THEN 'fps' WHEN sized IS NOT NULL AND short_edge IS NULL THEN 'resolution' ELSE 'short_edge' END,
           edge || ' at ' || a || ', ' || fps2 || ' fps' FROM s_geometry WHERE refused IS NOT NULL
      UNION ALL SELECT project_id, 'tts.trim_head', CAST(trim_head AS VARCHAR) FROM s_geometry WHERE trim_head > 10
      UNION ALL SELECT project_id, 'tts.trim_tail', CAST(trim_tail AS VARCHAR) FROM s_geometry WHERE trim_tail > 10
      UNION ALL SELECT project_id, 'encode.crf', CAST(crf AS VARCHAR) FROM s_geometry WHERE crf > 51
      UNION ALL SELECT project_id, 'defaults.duration', CAST(duration AS VARCHAR) FROM s_geometry WHERE duration <= 0 OR duration > 3600
      UNION ALL SELECT project_id, 'defaults.zoom_amount', CAST(zoom_amount AS VARCHAR) FROM s_geometry WHERE zoom_amount NOT BETWEEN 0.02 AND 0.5
      UNION ALL SELECT project_id, 'subtitles.theme', theme FROM s_geometry WHERE lower(theme) = 'neon'
      UNION ALL SELECT project_id, 'subtitles.position', position FROM s_geometry WHERE lower(position) = 'left'
      UNION ALL SELECT project_id, 'motion_seed', motion_seed FROM s_geometry WHERE lower(motion_seed) = 'v3')"""
register("settings_problems", lambda s, d: settings.setting_problems(settings.resolve(R.f_settings(s, d))), "SELECT * FROM s_problem")

# --- stills ------------------------------------------------------------------
NATIVE = "least(dw * 9 // 16, dh) // 18 * 18"
RELATIONS["st_small"] = f"""
    SELECT project_id, count(*) FILTER (small) AS scenes, count(*) AS total, arg_min(scene_id, o) FILTER (small) AS smallest,
      arg_min(dw, o) FILTER (small) AS width, arg_min(dh, o) FILTER (small) AS height, nullif(min(native), 0) AS native_short_edge
    FROM (SELECT *, NOT (dw >= 1920 AND dh >= 1080) AS small, {NATIVE} AS native, ({NATIVE}) * 1000 + position AS o FROM still_display)
    GROUP BY project_id HAVING count(*) FILTER (small) > 0"""


def undersized(spark, sf):
    return stills.undersized(R.f_still(spark, sf), F.lit("16:9"), F.lit(1920), F.lit(1080))


register("undersized", undersized, "SELECT * FROM st_small")
_LEVELS = [(10, 99, 1485), (11, 396, 3000), (12, 396, 6000), (13, 396, 11880), (20, 396, 11880), (21, 792, 19800), (22, 1620, 20250),
           (30, 1620, 40500), (31, 3600, 108000), (32, 5120, 216000), (40, 8192, 245760), (41, 8192, 245760), (42, 8704, 522240),
           (50, 22080, 589824), (51, 36864, 983040), (52, 36864, 2073600)]
register("h264_level", lambda s, d: stills.levels(R.f_still(s, d)).select("still_id", "level"), f"""
    WITH l(level, fs, ps) AS (VALUES {', '.join(map(str, _LEVELS))}),
    b AS (SELECT still_id, fps, CAST(ceil(width / 16.0) AS BIGINT) * CAST(ceil(height / 16.0) AS BIGINT) AS n FROM f_still)
    SELECT still_id, greatest(40, coalesce(min(level), 52)) AS level FROM b LEFT JOIN l ON n <= fs AND n * fps <= ps GROUP BY still_id""")
register("size_fit", lambda s, d: stills.size_fit(R.f_still(s, d)), """
    WITH sz AS (SELECT aspect, e || 'p' AS size, CASE aspect WHEN '16:9' THEN e // 9 * 16 ELSE e END AS out_w, CASE aspect WHEN '9:16' THEN e // 9 * 16 ELSE e END AS out_h
      FROM (SELECT unnest(['16:9', '9:16', '1:1']) AS aspect), (SELECT unnest([720, 1080, 1440, 2160]) AS e))
    SELECT project_id, count(*) AS stills, aspect, size, out_w, out_h, count(*) FILTER (dw >= out_w AND dh >= out_h) AS fills
    FROM still_display, sz GROUP BY project_id, aspect, size, out_w, out_h""")


def seeded_motion(spark, sf):
    """Moves of every still under both seed rules."""
    base = R.f_still(spark, sf).withColumns({"content": F.concat_ws("x", "width", "height"), "occurrence": F.lit(0).cast("bigint")})
    v1, v2 = stills.seeded_motion(base, "v1"), stills.seeded_motion(base, "v2")
    columns = ["still_id", "motion", "anchor", "amount"]
    return v1.select(F.lit("v1").alias("version"), *columns).unionByName(v2.select(F.lit("v2").alias("version"), *columns))


register("seeded_motion", seeded_motion, """
    WITH h AS (SELECT version, still_id, CAST('0x' || substr(sha256(concat_ws('|', version, project_id, CASE version WHEN 'v1' THEN position ELSE 0 END,
        width || 'x' || height)), 1, 15) AS BIGINT) AS seed FROM f_still, (SELECT unnest(['v1', 'v2']) AS version))
    SELECT version, still_id, (['zoom-in','zoom-out','pan-left','pan-right','pan-up','pan-down'])[CAST(seed % 6 AS INT) + 1] AS motion,
      (['center','north','south','west','east','north-west','north-east','south-west','south-east'])[CAST((seed >> 20) % 9 AS INT) + 1] AS anchor,
      0.08::DOUBLE + CAST((seed >> 40) % 5 AS DOUBLE) * 0.01::DOUBLE AS amount FROM h""")

# --- the report --------------------------------------------------------------
RELATIONS["all_problem"] = f"""
    WITH {SLOTS_SQL},
    fl AS (SELECT *, images = 0 AND regexp_full_match(scene_id, '[0-9]+') AS waiting FROM slots),
    pict AS (SELECT s.project_id, s.folded, row_number() OVER (PARTITION BY s.project_id ORDER BY any_value(k.nat), s.folded) AS position
             FROM slots s JOIN kinded k ON k.project_id = s.project_id AND k.folded = s.folded WHERE images > 0 GROUP BY s.project_id, s.folded),
    summ AS (SELECT project_id, count(*) FILTER (waiting) AS scenes, count(*) FILTER (images > 0) AS pictured FROM fl GROUP BY project_id),
    first_w AS (SELECT project_id, scene_id FROM fl WHERE waiting QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY CAST(scene_id AS BIGINT), folded) = 1)
    SELECT 'folder' AS mode, a.project_id, a.scene_id, p.position, 'ambiguous_scene' AS kind, 'error' AS severity, slot || ':' || n AS detail
      FROM (SELECT project_id, folded, scene_id, unnest(['image', 'narration', 'text']) AS slot, unnest([images, audios, texts]) AS n FROM slots) a
      LEFT JOIN pict p ON p.project_id = a.project_id AND p.folded = a.folded WHERE n > 1
    UNION ALL SELECT 'folder', project_id, NULL, NULL, 'unpaired_file', 'warn', name FROM (
      SELECT project_id, unnest([audio, text]) AS name FROM fl WHERE images = 0 AND NOT waiting) WHERE name IS NOT NULL
    UNION ALL SELECT 'folder', s.project_id, NULL, NULL, 'needs_picture', CASE WHEN pictured = 0 THEN 'error' ELSE 'warn' END, scenes || ':' || w.scene_id
      FROM summ s JOIN first_w w ON w.project_id = s.project_id WHERE scenes > 0
    UNION ALL SELECT 'folder', project_id, NULL, NULL, 'no_scenes', 'error', '' FROM (SELECT DISTINCT project_id FROM f_asset)
      WHERE project_id NOT IN (SELECT project_id FROM summ WHERE scenes > 0 OR pictured > 0)
    UNION ALL SELECT 'manifest', project_id, id, position, k, 'error',
        CASE WHEN k = 'conflicting_audio_sources' THEN declared WHEN k LIKE 'duration%' THEN CAST(duration AS VARCHAR)
             WHEN k = 'unknown_zoom_direction' THEN zoom_direction WHEN k = 'unknown_zoom_anchor' THEN zoom_anchor ELSE '' END
      FROM (SELECT *, unnest(str_split(kinds, '|')) AS k FROM m_valid WHERE NOT bad_id) WHERE k <> ''
    UNION ALL SELECT 'manifest', project_id, id, position, 'duplicate_id', 'error', '' FROM m_scene WHERE repeat > 1
    UNION ALL SELECT 'manifest', project_id, id, position, 'unusable_setting', 'error', 'duration:' || unread_duration FROM m_draft WHERE unread_duration IS NOT NULL
    UNION ALL SELECT 'manifest', project_id, id, position, 'path_missing', 'error', field || ':' || cell FROM m_path p
      WHERE NOT bad_id AND NOT EXISTS (SELECT 1 FROM m_file m WHERE m.project_id = p.project_id AND m.path = p.path)
    UNION ALL SELECT 'folder', project_id, NULL, NULL, 'interrupted_rename', 'error', CAST(count(*) AS VARCHAR) FROM f_asset WHERE file_no % 9 IN (0, 1) GROUP BY project_id
    UNION ALL SELECT 'folder', s.project_id, NULL, NULL, 'not_usable_media', 'error', 'text:' || s.text || CASE a.file_no % 5 WHEN 0 THEN ':not_utf8' ELSE ':too_large' END
      FROM fl s JOIN f_asset a ON a.project_id = s.project_id AND a.name = s.text WHERE (images > 0 OR waiting) AND a.file_no % 5 IN (0, 1)
    UNION ALL SELECT 'manifest', project_id, NULL, NULL, 'unlisted_image', 'warn', name FROM unlisted
    UNION ALL SELECT 'manifest', film_id, NULL, NULL, 'undrawable_caption', 'warn', scenes || ':s' || first || ':' || characters FROM undrawn
      WHERE film_id IN (SELECT project_id FROM s_clean WHERE subtitles)
    UNION ALL SELECT 'settings', project_id, NULL, NULL, 'unusable_setting', 'error', field || ':' || value FROM s_problem
    UNION ALL SELECT 'stills', project_id, NULL, NULL, 'undersized_sources', 'warn', scenes || ':' || total || ':' || smallest FROM st_small"""


def _renaming(spark, sf):
    """Names of assets, some of them as an unfinished renumbering leaves them."""
    name = F.when(F.col("file_no") % 9 == 0, F.concat(F.lit(".arranging-"), "name")).when(
        F.col("file_no") % 9 == 1, F.concat(F.lit(".removing-"), "name")).otherwise(F.concat(F.lit("arranging-"), "name"))
    return R.f_asset(spark, sf).select("project_id", name.alias("name"))


def _scripts(spark, sf):
    """Every asset as a script read or refused."""
    return R.f_asset(spark, sf).select("project_id", "name", F.when(F.col("file_no") % 5 == 0, "not_utf8").when(F.col("file_no") % 5 == 1, "too_large").alias("problem"))


def _captions(spark, sf):
    """Lines of documents as the captions of ten-scene projects."""
    return R.f_written(spark, sf).select(
        F.floor(F.col("doc_id") / 10).alias("project_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("scene_id"),
        F.col("doc_id").alias("position"), F.col("line").alias("caption_text"))


def _report(spark, sf):
    set_up = settings.resolve(R.f_settings(spark, sf))
    folder = [
        validate.folder_problems(R.f_asset(spark, sf)), validate.interrupted_problems(_renaming(spark, sf)),
        validate.unreadable_problems(scene_slots(R.f_asset(spark, sf)), _scripts(spark, sf)),
    ]
    listed = [
        validate.manifest_problems(_drafts(spark, sf), _files(spark, sf)), validate.unlisted_problems(*listed_cells(spark, sf)),
        validate.undrawable_problems(_captions(spark, sf), set_up.filter("subtitles")),
    ]
    return validate.report(
        folder=reduce(DataFrame.unionByName, folder),
        manifest=reduce(DataFrame.unionByName, listed),
        settings=validate.setting_problems(settings.setting_problems(set_up)),
        stills=validate.still_problems(R.f_still(spark, sf), F.lit("16:9"), F.lit(1920), F.lit(1080)),
    )


register("problem_report", _report, """
    SELECT *, row_number() OVER (PARTITION BY mode, project_id ORDER BY scene_id IS NOT NULL,
        CASE WHEN scene_id IS NULL THEN 0 ELSE coalesce(position, 4611686018427387904) END, kind, coalesce(scene_id, ''), detail) AS line FROM all_problem""")
def run_problems(spark, sf):
    """A third of the projects is made at 4K, a third without captions, a third with captions whatever its settings say."""
    set_up = settings.resolve(R.f_settings(spark, sf))
    third = F.pmod(F.col("project_id"), F.lit(3))
    small = R.f_still(spark, sf)
    planned = validate.still_problems(small, F.lit("16:9"), F.lit(1920), F.lit(1080)).unionByName(
        validate.undrawable_problems(_captions(spark, sf), set_up.filter("subtitles")))
    again = validate.still_problems(small, F.lit("16:9"), F.lit(3840), F.lit(2160)).unionByName(
        validate.undrawable_problems(_captions(spark, sf), _captions(spark, sf).filter(third == 2)))
    projects = small.select("project_id").unionByName(_captions(spark, sf).select("project_id")).distinct()
    runs = projects.select("project_id", F.when(third == 0, "undersized_sources").otherwise("undrawable_caption").alias("kind"))
    return validate.for_run(planned, again, runs).select("project_id", "kind", "detail")


_SMALL = "SELECT project_id, 'undersized_sources' AS kind, scenes || ':' || total || ':' || smallest AS detail"
_UNDRAWN = "SELECT film_id AS project_id, 'undrawable_caption' AS kind, scenes || ':s' || first || ':' || characters AS detail FROM undrawn"
register("run_problems", run_problems, f"""
    {_SMALL} FROM st_small WHERE project_id % 3 <> 0
    UNION ALL {_SMALL} FROM ({RELATIONS['st_small'].replace('1920', '3840').replace('1080', '2160')}) WHERE project_id % 3 = 0
    UNION ALL {_UNDRAWN} WHERE film_id % 3 = 0 AND film_id IN (SELECT project_id FROM s_clean WHERE subtitles)
    UNION ALL {_UNDRAWN} WHERE film_id % 3 = 2""")
register("problem_counts", lambda s, d: problems.problem_counts(_report(s, d)),
         "SELECT mode, project_id, severity, kind, count(*) AS problems FROM all_problem GROUP BY ALL")
register("problem_severity", lambda s, d: _report(s, d).groupBy("mode", "project_id").agg(
    F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"),
    F.bool_or(F.col("severity") == "error").alias("refused")),
    """SELECT mode, project_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings,
       bool_or(severity = 'error') AS refused FROM all_problem GROUP BY ALL""")
