"""The derived relations again, as SQL for the oracle engine."""

from __future__ import annotations

import re

from sceneframe import constants as C

RELATIONS: dict[str, str] = {
    "line_pos": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                  l_extendedprice, l_quantity, l_shipdate) AS pos
        FROM lineitem""",
    "f_asset": """
        SELECT *, stem || '.' || ext AS name FROM (
          SELECT l_orderkey AS project_id, pos AS file_no,
                 (CASE WHEN l_suppkey % 4 = 0 THEN 'Take-' ELSE '' END)
                   || lpad(CAST((pos + 1 - (pos + 1) % 2) // 2 AS VARCHAR), 3, '0') AS stem,
                 (['jpg','JPG','png','heic','wav','mp3','txt','md','jpg','pdf'])[CAST(l_partkey % 10 AS INT) + 1] AS ext,
                 CAST(floor(l_extendedprice * 100) AS BIGINT) AS bytes,
                 l_shipdate AS modified_at
          FROM line_pos)""",
    "kinded": """
        SELECT *, CASE WHEN lower(ext) IN ('jpg','jpeg','png','webp','tif','tiff','bmp','heic') THEN 'image'
                       WHEN lower(ext) IN ('mp3','m4a','wav','aac','flac','ogg','opus','wma') THEN 'audio'
                       WHEN lower(ext) IN ('txt','md') THEN 'text' END AS kind,
               lower(stem) AS folded,
               list_transform(regexp_extract_all(lower(stem), '[0-9]+|[^0-9]+'),
                 lambda r: CASE WHEN r[1] BETWEEN '0' AND '9'
                      THEN {'t': 0, 'n': CAST(r AS BIGINT), 's': ''} ELSE {'t': 1, 'n': 0::BIGINT, 's': r} END) AS nat
        FROM f_asset""",
    "f_scene": """
        SELECT conv_id AS project_id, turn + 1 AS scene, role, text AS line FROM conversations""",
    "f_draft": """
        SELECT project_id, scene,
          CASE WHEN (c + t) % 17 = 0 THEN '  ' WHEN (c + t) % 29 = 5 THEN 'img/a..b/'
               ELSE (CASE WHEN c % 2 = 0 THEN 'img' || chr(92) ELSE 'img/' END) || number || '.jpg' END AS image,
          CASE WHEN (c + 2 * t) % 19 = 0 THEN '   ' WHEN t % 5 = 3 AND c % 7 <> 0 THEN NULL
               WHEN t % 5 = 4 THEN NULL ELSE line END AS text,
          CASE WHEN c % 7 = 0 OR t % 5 = 3 THEN 'rec/' || number || '.wav' END AS audio_file,
          CASE WHEN t % 5 = 4 THEN (['2.5','0','-1','4000','soon','12','0.4'])[CAST((c + t) % 7 AS INT) + 1] END AS duration,
          ([NULL,'en-GB-RyanNeural',' default ','hi-IN-MadhurNeural'])[CAST((c + t) % 4 AS INT) + 1] AS voice,
          (['zoom-in','Zoom_Out','pan left',' PAN-RIGHT ','pan_up','sideways',NULL,'pan-down',''])[CAST((c + t) % 9 AS INT) + 1] AS zoom_direction,
          (['centre','Top_Left','n','outer space',NULL,'south east','se','  ','middle','W','ne'])[CAST((c + 2 * t) % 11 AS INT) + 1] AS zoom_anchor,
          CASE WHEN (c + t) % 6 = 5 THEN ' Caption for ' || number || ' ' END AS caption
        FROM (SELECT *, project_id AS c, scene - 1 AS t,
                lpad(CAST(CASE WHEN (project_id * 3 + scene - 1) % 23 = 0 THEN 1 ELSE scene END AS VARCHAR), 3, '0') AS number
              FROM f_scene)""",
    "f_segment": """
        SELECT l_orderkey AS film_id, pos AS scene, CAST(floor(l_quantity) AS BIGINT) * 3 + pos AS frames,
               l_partkey % 7 AS image_no, CAST(floor(l_extendedprice * 100) AS BIGINT) AS bytes, l_shipdate AS modified_at
        FROM line_pos""",
    "f_plan": """
        SELECT film_id, scene, frames, bytes, modified_at, film_id || ':' || frames AS key,
               CASE WHEN image_no % 3 <> 0 THEN 'edge' END AS provider,
               CASE WHEN image_no % 3 <> 0 THEN 'tts' ELSE 'file' END AS kind
        FROM f_segment""",
    "f_stored": """
        SELECT film_id, film_id || ':' || frames AS key,
               CASE min(bytes) % 6 WHEN 0 THEN 'holiday ' || frames || '.mp4' WHEN 1 THEN '.seg-' || frames || '.mp4.partial-9-1.mp4'
                 ELSE 'seg-' || lpad(CAST(frames AS VARCHAR), 16, '0') || '.mp4' END AS name,
               CASE WHEN frames % 5 <> 0 THEN frames - CASE WHEN (film_id + frames) % 11 = 0 THEN 1 ELSE 0 END END AS nb_frames,
               (frames - CASE WHEN (film_id + frames) % 11 = 0 THEN 40 ELSE 0 END) / 30.0::DOUBLE AS seconds,
               min(bytes) AS bytes, max(modified_at) AS modified_at
        FROM f_segment WHERE (film_id + frames) % 3 <> 0 GROUP BY film_id, frames""",
    "f_still": """
        SELECT p_partkey AS still_id, p_partkey // 50 AS project_id, 's' || lpad(CAST(p_partkey % 50 AS VARCHAR), 3, '0') AS scene_id,
               p_partkey % 50 AS position, CAST(p_size * 80 + p_partkey % 3 AS BIGINT) AS width, CAST(p_size * 45 AS BIGINT) AS height,
               CASE WHEN p_partkey % 6 = 0 THEN 4 ELSE 1 END AS sar_num,
               CASE WHEN p_partkey % 6 = 0 THEN 3 WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS sar_den,
               ([24,25,30,60,120])[CAST(p_partkey % 5 AS INT) + 1] AS fps
        FROM part""",
    "still_display": """
        SELECT *, width * CASE WHEN sar_num = 0 OR sar_den = 0 THEN 1 ELSE sar_num END
                    // CASE WHEN sar_num = 0 OR sar_den = 0 THEN 1 ELSE sar_den END AS dw, height AS dh
        FROM f_still""",
    "f_probe": """
        SELECT o_orderkey AS film_id,
          CASE WHEN k % 13 = 0 THEN 'hevc' ELSE 'h264' END AS v_codec,
          CASE WHEN k % 17 = 3 THEN 'yuv444p' ELSE 'yuv420p' END AS v_pix,
          CASE WHEN k % 5 = 0 THEN NULL ELSE 'bt709' END AS v_transfer,
          CASE WHEN k % 4 = 2 THEN '4:3' ELSE '1:1' END AS v_sar,
          CASE WHEN k % 19 = 0 THEN NULL ELSE floor(o_totalprice / 1000) + 0.5 END AS v_duration,
          CAST(floor(o_totalprice / 100) AS BIGINT) AS v_frames,
          CASE WHEN k % 11 = 0 THEN 44100 ELSE 48000 END AS a_rate,
          CASE WHEN k % 23 = 0 THEN 'video' WHEN k % 29 = 0 THEN 'audio, video' ELSE 'video, audio' END AS kinds,
          floor(o_totalprice / 1000) + 0.25 AS c_duration
        FROM (SELECT *, o_orderkey AS k FROM orders)""",
    "f_event": """
        SELECT event_id, ts AS at, user_id AS run_id,
          CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
          event_type AS scope, k, value,
          CASE event_id % 5 WHEN 0 THEN 'sent API_KEY=' || k || ' to the service' WHEN 1 THEN '=SUM(A' || k || ')'
            WHEN 2 THEN '-' || k WHEN 3 THEN 'wrote "scene ' || k || '", then' || chr(10) || 'moved on'
            ELSE 'token ' || repeat('Ab3', 11) || k || ' used' END AS message
        FROM (SELECT *, regexp_extract(props, '"k": (\\d+)', 1) AS k FROM events)""",
    "f_chapter": """
        SELECT doc_id, array_to_string(list_transform(str_split(text, chr(10)),
                 lambda l, i: CASE WHEN (i - 1) % 3 = 2 THEN l || chr(10) ELSE l END), chr(10)) AS chapter
        FROM documents""",
    "f_quoted": """
        SELECT doc_id, regexp_replace(regexp_replace(chapter, ' (the|la|die) ', ' “\\1 ', 'g'),
                 ' (of|de|und)([ ,.])', ' \\1”\\2', 'g') AS chapter FROM f_chapter""",
    "f_written": """
        SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN translate(text, 'aeiou', 'अइउएओ')
            WHEN 2 THEN translate(text, 'aeiou', 'αειου') WHEN 3 THEN translate(text, 'aeiou', '漢字かなカ')
            WHEN 4 THEN translate(text, 'aeiou', '漢字語文本') WHEN 5 THEN translate(text, 'aeiour', 'аеиоур')
            ELSE text END AS line,
          (['hi-IN-MadhurNeural','en-US-AvaNeural','ja-JP-KeitaNeural','el-GR-NestorasNeural','zh-CN-YunxiNeural'])[CAST(doc_id % 5 AS INT) + 1] AS voice
        FROM documents""",
    "f_caption": """
        SELECT project_id AS film_id, scene, line AS text, length(line) / 16.0::DOUBLE + (project_id + scene) % 5 AS seconds,
          (['classic','boxed','band','card','punch','minimal','recap','bold','glow','pill'])[CAST((project_id + scene) % 10 AS INT) + 1] AS theme,
          ([88,84,80,80,62,76,28,22,26,24])[CAST((project_id + scene) % 10 AS INT) + 1] AS budget
        FROM f_scene""",
    "f_settings": """
        SELECT k AS project_id,
          ([NULL,' film.mp4 ','','a/b.mp4'])[CAST(k % 4 AS INT) + 1] AS output,
          ([NULL,'16:9','Portrait','1X1','reels','cinema',' '])[CAST(k % 7 AS INT) + 1] AS aspect,
          ([NULL,'4k','1080P','huge',NULL,'hd',NULL,'2K',NULL])[CAST(k % 9 AS INT) + 1] AS resolution,
          CASE WHEN k % 6 = 1 THEN 720 WHEN k % 6 = 2 THEN 721 WHEN k % 6 = 3 THEN 1090 WHEN k % 30 = 4 THEN 0 WHEN k % 30 = 5 THEN 9000 END AS short_edge,
          CASE WHEN k % 5 = 1 THEN 24 WHEN k % 25 = 2 THEN 0 WHEN k % 25 = 3 THEN 240 END AS fps,
          ([NULL,'scenes.csv','  '])[CAST(k % 3 AS INT) + 1] AS manifest,
          ([NULL,NULL,'edge',' other ',NULL,'',NULL,'edge'])[CAST(k % 8 AS INT) + 1] AS provider,
          ([NULL,'en-GB-RyanNeural',' ','default',NULL])[CAST(k % 5 AS INT) + 1] AS voice,
          CASE WHEN k % 10 = 1 THEN 11.0 WHEN k % 10 = 2 THEN -1.0 WHEN k % 10 = 3 THEN 0.5 END::DOUBLE AS trim_head,
          CASE WHEN k % 12 = 1 THEN 10.5 WHEN k % 12 = 2 THEN 10.0 END::DOUBLE AS trim_tail,
          ([NULL,'slow',' '])[CAST(k % 3 AS INT) + 1] AS preset,
          CASE WHEN k % 8 = 1 THEN 52 WHEN k % 8 = 2 THEN 51 WHEN k % 8 = 3 THEN 0 END AS crf,
          CASE WHEN k % 9 = 1 THEN 0.0 WHEN k % 9 = 2 THEN 3600.0 WHEN k % 9 = 3 THEN 3600.5 WHEN k % 9 = 4 THEN 2.5 END::DOUBLE AS duration,
          CASE WHEN k % 11 = 1 THEN 0.01 WHEN k % 11 = 2 THEN 0.5 WHEN k % 11 = 3 THEN 0.75 WHEN k % 11 = 4 THEN 0.2 END::DOUBLE AS zoom_amount,
          CASE WHEN k % 3 = 1 THEN true WHEN k % 3 = 2 THEN false END AS subtitles,
          ([NULL,'Glow','neon','boxed',NULL,' '])[CAST(k % 6 AS INT) + 1] AS theme,
          ([NULL,'top','Bottom','left',NULL])[CAST(k % 5 AS INT) + 1] AS position,
          ([NULL,'v2','V1','v3'])[CAST(k % 4 AS INT) + 1] AS motion_seed
        FROM (SELECT c_custkey AS k FROM customer)""",
    "f_voice": """
        SELECT table_id, line_no, name AS voice_id, gender,
          CASE tail WHEN 0 THEN 'General · Friendly, Positive' WHEN 1 THEN 'General · Calm · Warm' ELSE 'General' END AS note,
          (['en-GB','hi-IN','zh-CN','sr-Latn-RS','es-419',''])[CAST(s % 6 AS INT) + 1] AS locale
        FROM (SELECT CAST(s_nationkey AS BIGINT) AS table_id, s_suppkey + 10 AS line_no, s_suppkey AS s, s_suppkey % 3 AS tail,
                (['en-GB','hi-IN','zh-CN-liaoning','sr-Latn-RS','es-419','x'])[CAST(s_suppkey % 6 AS INT) + 1] || '-'
                  || replace(s_name, '#', '') || 'Neural' AS name,
                CASE WHEN s_suppkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender
              FROM supplier)
        WHERE s % 9 <> 4""",
    "f_edge": """
        SELECT user_id AS file_id, event_id AS line_no, value,
          CASE WHEN event_type IN ('error', 'view') THEN 'start' WHEN event_type IN ('click', 'purchase') THEN 'end' ELSE 'loudness' END AS edge,
          (epoch_us(ts) // 10000 - 170406720000) / 100.0::DOUBLE AS at
        FROM events""",
}

_DRAWN = "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in C.DRAWN_RANGES)
RELATIONS["undrawn"] = f"""
    WITH chars AS (SELECT doc_id // 10 AS film_id, doc_id AS scene, unnest(cs) AS ch, unnest(range(len(cs))) AS cpos FROM (
        SELECT doc_id, str_split(regexp_replace(line, '[{_DRAWN}]+', '', 'g'), '') AS cs FROM f_written)),
    kept AS (SELECT * FROM chars WHERE ch <> ''),
    firsts AS (SELECT film_id, ch, min(scene * 1000000 + cpos) AS o FROM kept GROUP BY ALL),
    named AS (SELECT film_id, string_agg(ch, ' ' ORDER BY o) AS characters FROM (
        SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY o) <= 8) GROUP BY film_id)
    SELECT k.film_id, count(DISTINCT scene) AS scenes, min(scene) AS first, any_value(characters) AS characters
    FROM kept k JOIN named n ON n.film_id = k.film_id GROUP BY k.film_id"""


def oracle(sql: str) -> str:
    """``sql`` with the relations it names, and those they name, put in front as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in RELATIONS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(RELATIONS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ", ".join(f"{name} AS ({RELATIONS[name]})" for name in needed)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        body = body[4:].strip()
        if body[:9].upper() == "RECURSIVE":
            return f"WITH RECURSIVE {head}, {body[9:]}"
        return f"WITH {head}, {body}"
    return f"WITH {head} {body}"
