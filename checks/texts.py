"""Queries over chapters, captions, scripts and voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import relations as R
from checks.registry import register
from checks.relations_sql import RELATIONS
from checks.validate import SP
from sceneframe import constants as C
from sceneframe.operators import captions, chapters, voices
from sceneframe.sources import imports, scripts
from sceneframe.sources import voices as voice_source
from sceneframe.functions.numbers import plain_number

CL = """["'')\\]»”’*_]"""  # closing marks, quoted for SQL
EN = "[.!?…।॥。！？]"
AN = r"\p{L}\p{N}"
ABBR = "|".join(a.replace(".", "[.]") for a in C.ABBREVIATIONS)


def _ends(w: str) -> str:
    return (f"(regexp_matches({w}, '{EN}{CL}*$') AND NOT regexp_matches(lower({w}), '^[^{AN}]*({ABBR})[.]{CL}*$') "
            f"AND NOT regexp_matches({w}, '^[^{AN}]*\\p{{Lu}}[.]{CL}*$'))")


def _word_relation(source: str) -> str:
    return f"""
    SELECT doc_id, para, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM (
      SELECT doc_id, para, list_filter(str_split(p, ' '), lambda x: x <> '') AS ws FROM (
        SELECT doc_id, para, trim(regexp_replace(raw, '[{SP}]+', ' ', 'g')) AS p FROM (
          SELECT doc_id, unnest(ps) AS raw, unnest(range(len(ps))) AS para FROM (
            SELECT doc_id, regexp_split_to_array(chapter, '\\n[{SP}]*\\n') AS ps FROM {source})))
      WHERE regexp_matches(p, '[{AN}]'))"""


RELATIONS["ch_word"] = f"SELECT *, {_ends('w')} AS ends FROM ({_word_relation('f_chapter')})"
RELATIONS["qu_word"] = f"SELECT *, {_ends('w')} AS ends FROM ({_word_relation('f_quoted')})"

register("paragraphs", lambda s, d: chapters.paragraphs(R.f_chapter(s, d)), """
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS paragraph, text
    FROM (SELECT doc_id, para, string_agg(w, ' ' ORDER BY i) AS text FROM ch_word GROUP BY doc_id, para)""")

PIECES_SQL = """
    cut AS (SELECT doc_id, para, w, i, CAST(coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {n} AS g FROM ch_word),
    pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, g) - 1 AS piece, text, length(text) AS chars, length(text) / 16.3::DOUBLE AS seconds
      FROM (SELECT doc_id, para, g, string_agg(w, ' ' ORDER BY i) AS text FROM cut GROUP BY doc_id, para, g))"""


def _pieces(spark, sf):
    return chapters.cut_sentences(R.f_chapter(spark, sf), 2)


register("cut_sentences", _pieces, f"WITH {PIECES_SQL.format(n=2)} SELECT * FROM pieces")
register("speaking_time", lambda s, d: chapters.speaking_time(_pieces(s, d)), f"""
    WITH {PIECES_SQL.format(n=2)} SELECT doc_id, count(*) AS pieces, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(chars) AS BIGINT) / 16.3::DOUBLE AS seconds FROM pieces GROUP BY doc_id""")
register("pacing_report", lambda s, d: chapters.pacing_report(_pieces(s, d)), f"""
    WITH {PIECES_SQL.format(n=2)} SELECT CASE WHEN 10 * chars < 489 THEN 'under' WHEN 10 * chars > 815 THEN 'over' ELSE 'within' END AS band,
      count(*) AS pieces, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(CASE
        WHEN 10 * chars < 489 THEN 4 * (489 - 10 * chars) + 8 * greatest(326 - 10 * chars, 0)
        WHEN 10 * chars > 815 THEN 6 * (10 * chars - 815) + 17 * greatest(2 * (10 * chars - 815) - 815, 0) ELSE 0 END) AS BIGINT) / 326.0::DOUBLE AS cost
    FROM pieces GROUP BY band""")
register("cut_time_bins", lambda s, d: chapters.cut_time(R.f_chapter(s, d)).select("doc_id", "piece", "text", "chars"), f"""
    WITH {PIECES_SQL.format(n=1)}, sents AS (SELECT doc_id, para, list(text ORDER BY g) AS ss FROM (
        SELECT doc_id, para, g, string_agg(w, ' ' ORDER BY i) AS text FROM cut GROUP BY doc_id, para, g) GROUP BY doc_id, para),
    packed AS (SELECT doc_id, para, str_split(list_reduce(ss, lambda a, x: CASE WHEN length(str_split(a, chr(10))[-1]) + 1 + length(x) <= 81
        THEN a || ' ' || x ELSE a || chr(10) || x END), chr(10)) AS ps FROM sents),
    rows AS (SELECT doc_id, para, unnest(ps) AS text, unnest(range(len(ps))) AS k FROM packed)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, k) - 1 AS piece, text, length(text) AS chars FROM rows""")


# The cheapest cut is a search over all cuts; tests/test_chapters.py holds it against one.
register("cut_cheapest", lambda s, d: chapters.cut_cheapest(R.f_chapter(s, d)).select("doc_id", "piece", "text", "chars"))


def gap_cost(spark, sf):
    """Where each cost falls in each chapter: how often, first, last, and the sum of places."""
    return chapters.gap_costs(R.f_chapter(spark, sf)).groupBy("doc_id", "cost").agg(
        F.count(F.lit(1)).alias("words"), F.min("i").alias("first"), F.max("i").alias("last"), F.sum("i").alias("places"))


_OPEN = ", ".join(f"'{w}'" for w in C.CLAUSE_OPENERS)
_DANG = ", ".join(f"'{w}'" for w in C.DANGLING_WORDS)
register("gap_cost", gap_cost, f"""
    WITH seq AS (SELECT doc_id, w, ends, i = n - 1 AS last, lead(w) OVER d AS nx, row_number() OVER d - 1 AS plc
        FROM ch_word WINDOW d AS (PARTITION BY doc_id ORDER BY para, i)),
    priced AS (SELECT doc_id, plc, CASE WHEN last THEN 0 ELSE
        CASE WHEN ends THEN 0 WHEN regexp_matches(w, '[,;:—–]{CL}*$|^-{CL}*$|--{CL}*$') THEN CASE WHEN regexp_matches(w, ',{CL}*$') THEN 2 ELSE 1 END
             WHEN lower(regexp_replace(nx, '^[^{AN}]+', '')) IN ({_OPEN}) THEN 3 ELSE 25 END
        + CASE WHEN regexp_matches(w, '[{AN}]$') AND lower(w) IN ({_DANG}) THEN 20 ELSE 0 END END AS cost FROM seq)
    SELECT doc_id, cost, count(*) AS words, min(plc) AS first, max(plc) AS last, CAST(sum(plc) AS BIGINT) AS places FROM priced GROUP BY doc_id, cost""")

register("straddle_cost", lambda s, d: chapters.straddle_costs(R.f_quoted(s, d), 3), """
    WITH stops AS (SELECT *, i = n - 1 AS brk, i = n - 1 OR ends AS stop, last_value(ends) OVER (PARTITION BY doc_id, para ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole FROM qu_word),
    seq AS (SELECT *, lead(w) OVER d AS nx, lead(whole) OVER d AS nx_whole,
        CAST(coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY para, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS unit
        FROM stops WINDOW d AS (PARTITION BY doc_id ORDER BY para, i))
    SELECT doc_id, unit // 3 AS piece, CAST(sum(CASE WHEN stop AND nx IS NOT NULL AND unit % 3 <> 2 THEN
        CASE WHEN NOT brk THEN 0 WHEN whole AND nx_whole THEN 3 ELSE 1000 END
        + CASE WHEN regexp_matches(nx, '^["“«‘]') OR regexp_matches(w, '["”»’]$') THEN 4 ELSE 0 END ELSE 0 END) AS BIGINT) AS cost
    FROM seq GROUP BY doc_id, unit // 3""")


def import_pieces(spark, sf):
    """Chapters imported into the folder project of their own number, after what is there."""
    from sceneframe.operators.catalog import next_numbers

    pieces = _pieces(spark, sf).select(F.col("doc_id").alias("project_id"), "piece", "text")
    return chapters.number_pieces(pieces, next_numbers(R.f_asset(spark, sf)).select("project_id", "next_scene"))


register("import_pieces", import_pieces, f"""
    WITH {PIECES_SQL.format(n=2)}, taken AS (SELECT project_id, coalesce(max(CASE WHEN kind IS NOT NULL AND regexp_full_match(stem, '[0-9]+') THEN CAST(stem AS BIGINT) END), 0) + 1 AS nxt
      FROM kinded GROUP BY project_id),
    placed AS (SELECT doc_id AS project_id, piece, text, coalesce(nxt, 1) + piece AS number, coalesce(nxt, 1) + count(*) OVER (PARTITION BY doc_id) - 1 AS last
      FROM pieces LEFT JOIN taken ON project_id = doc_id)
    SELECT project_id, piece, lpad(CAST(number AS VARCHAR), greatest(3, length(CAST(last AS VARCHAR)))::INT, '0') AS scene_id, text, strlen(text) > 262144 AS too_long FROM placed""")


def import_plan(spark, sf):
    """Chapters again, with a cap that some pieces break and every eleventh project led by a manifest."""
    from sceneframe.operators.catalog import next_numbers

    pieces = _pieces(spark, sf).select(F.col("doc_id").alias("project_id"), "piece", "text")
    blank = R.table(spark, sf, "documents").filter("doc_id % 9 = 4").selectExpr("doc_id AS project_id", "CAST(-1 AS INT) AS piece", "' ' AS text")
    empty = R.table(spark, sf, "documents").selectExpr("-doc_id - 1 AS project_id", "0 AS piece", "'' AS text")
    manifests = R.table(spark, sf, "documents").filter("doc_id % 11 = 3").selectExpr("doc_id AS project_id")
    taken = next_numbers(R.f_asset(spark, sf)).select("project_id", "next_scene")
    return imports.import_plan(pieces.unionByName(blank).unionByName(empty), taken, manifests, max_bytes=1500)


register("import_plan", import_plan, f"""
    WITH {PIECES_SQL.format(n=2)}, taken AS (SELECT project_id, coalesce(max(CASE WHEN kind IS NOT NULL AND regexp_full_match(stem, '[0-9]+') THEN CAST(stem AS BIGINT) END), 0) + 1 AS nxt
      FROM kinded GROUP BY project_id),
    placed AS (SELECT doc_id AS project_id, piece, text, coalesce(nxt, 1) + piece AS number, coalesce(nxt, 1) + count(*) OVER (PARTITION BY doc_id) - 1 AS last,
        min(CASE WHEN strlen(text) > 1500 THEN piece END) OVER (PARTITION BY doc_id) AS long, doc_id % 11 = 3 AS led
      FROM pieces LEFT JOIN taken ON project_id = doc_id)
    SELECT project_id, CAST(piece AS INT) AS piece, lpad(CAST(number AS VARCHAR), greatest(3, length(CAST(last AS VARCHAR)))::INT, '0') AS scene_id, text, NULL AS problem
    FROM placed WHERE NOT led AND long IS NULL
    UNION ALL SELECT project_id, CAST(long AS INT), NULL, NULL, 'too_long' FROM placed WHERE NOT led AND piece = long
    UNION ALL SELECT doc_id, NULL, NULL, NULL, 'manifest_project' FROM documents WHERE doc_id % 11 = 3 AND (doc_id % 9 = 4 OR doc_id IN (SELECT doc_id FROM pieces))
    UNION ALL SELECT doc_id, NULL, NULL, NULL, 'empty' FROM documents WHERE doc_id % 11 <> 3 AND doc_id % 9 = 4 AND doc_id NOT IN (SELECT doc_id FROM pieces)
    UNION ALL SELECT -doc_id - 1, NULL, NULL, NULL, 'empty' FROM documents""")


_CELLS = ("5", "5.", ".5", "+3.25", "-1e2", "1E-3", "5d", "7f", "0x1p3", "1_0", "inf", "-Infinity", "NaN", "+nan", "1e", ".", "1 2", "soon", "٣", "1e400")


def duration_cells(spark, sf):
    """Durations as people write them, beside every order: which are numbers and which are problems."""
    cell = F.element_at(F.array(*[F.lit(c) for c in _CELLS]), (F.col("o_orderkey") % len(_CELLS) + 1).cast("int"))
    rows = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), cell.alias("cell"))
    return rows.select("position", F.when(F.isnan(plain_number(F.col("cell"))), "nan").otherwise(plain_number(F.col("cell")).cast("string")).alias("seconds"),
                       plain_number(F.col("cell")).isNull().alias("problem"))


# Every form by hand: what each is read as, or that it is not a number.
register("duration_cells", duration_cells, f"""
    SELECT o_orderkey AS position,
      [{', '.join("'5.0' '5.0' '0.5' '3.25' '-100.0' '0.001' NULL NULL NULL NULL 'Infinity' '-Infinity' 'nan' 'nan' NULL NULL NULL NULL NULL 'Infinity'".split())}][(o_orderkey % {len(_CELLS)} + 1)::INT] AS seconds,
      o_orderkey % {len(_CELLS)} IN (6, 7, 8, 9, 14, 15, 16, 17, 18) AS problem
    FROM orders""")


def script_scan(spark, sf):
    """Documents as file contents, some with a byte order mark, some with a stray byte."""
    raw = F.col("text").cast("binary")
    content = (
        F.when(F.col("doc_id") % 5 == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw))
        .when(F.col("doc_id") % 7 == 3, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(F.concat(F.encode(F.lit(" \n"), "UTF-8"), raw))
    )
    files = R.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return scripts.decode(files)


register("script_scan", script_scan, f"""
    SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 1 OR doc_id % 7 <> 3 THEN regexp_replace(text, '^[{SP}]+|[{SP}]+$', '', 'g') END AS text,
      CASE WHEN doc_id % 5 <> 1 AND doc_id % 7 = 3 THEN 'not_utf8' END AS problem FROM documents""")

# --- captions ----------------------------------------------------------------
CCL = """["'')\\]»”’]"""
WEAK = "|".join(C.WEAK_ENDINGS)


def _pack_sql(words: str, b: str) -> str:
    cur = "str_split(a, chr(10))[-1]"
    return f"""str_split(list_reduce(str_split({words}, ' '), lambda a, x: CASE WHEN length({cur}) + 1 + length(x) > {b}
        OR (length({cur}) * 2 >= {b} AND regexp_matches({cur}, '[.!?…]{CCL}*$')) THEN a || chr(10) || x ELSE a || ' ' || x END), chr(10))"""


def _carry_sql(ps: str) -> str:
    cur = "str_split(a, chr(10))[-1]"
    gives = f"regexp_matches(lower({cur}), ' [^{AN} ]*({WEAK})[^{AN} ]*$') AND NOT regexp_matches({cur}, '[,;:.!?]$')"
    return f"""str_split(list_reduce({ps}, lambda a, x: CASE WHEN {gives}
        THEN regexp_replace(a, ' [^ ]+$', '') || chr(10) || regexp_extract({cur}, '[^ ]+$') || ' ' || x ELSE a || chr(10) || x END), chr(10))"""


RELATIONS["cap_packed"] = f"""
    SELECT *, {_pack_sql('words', 'budget')} AS packed FROM (
      SELECT film_id, scene, seconds, budget, trim(regexp_replace(text, '[{SP}]+', ' ', 'g')) AS words FROM f_caption) WHERE words <> '' AND seconds > 0"""

register("cue_bins", lambda s, d: captions.cue_bins(R.f_caption(s, d)), f"""
    SELECT film_id, scene, unnest(range(len(cs))) AS cue, unnest(cs) AS text FROM (SELECT film_id, scene, {_carry_sql('packed')} AS cs FROM cap_packed)""")
register("weak_endings", lambda s, d: captions.weak_endings(R.f_caption(s, d)), f"""
    SELECT film_id, scene, cue, before, after FROM (
      SELECT film_id, scene, unnest(range(len(cs))) AS cue, unnest(packed) AS before, unnest(cs) AS after FROM (SELECT *, {_carry_sql('packed')} AS cs FROM cap_packed)) WHERE before <> after""")
register("short_cues", lambda s, d: captions.short_cues(R.f_caption(s, d)), """
    SELECT film_id, scene, count(*) AS pieces, count(*) FILTER (seconds * n / total < 0.9::DOUBLE - 1e-9::DOUBLE) AS brief,
      count(*) > least(greatest(floor(any_value(seconds) / 0.9::DOUBLE), 1), 60) AS crowded
    FROM (SELECT film_id, scene, seconds, length(unnest(packed)) AS n, list_sum(list_transform(packed, lambda p: length(p))) AS total FROM cap_packed) GROUP BY film_id, scene""")

CUES_SQL = f"""
    base AS (SELECT film_id, scene, seconds, words, greatest(budget, 8) AS b0, CAST(least(greatest(floor(seconds / 0.9::DOUBLE), 1), 60) AS BIGINT) AS allowed FROM cap_packed),
    tries AS (SELECT *, CASE WHEN k = 0 THEN b0 ELSE greatest(b0, CAST(ceil(length(words) / allowed::DOUBLE) AS BIGINT)) + k END AS b FROM base, (SELECT unnest(range(9)) AS k)),
    split AS (SELECT *, {_pack_sql('words', 'b')} AS ps FROM tries),
    chosen AS (SELECT film_id, scene, seconds, allowed, {_carry_sql('ps')} AS ps FROM split
      QUALIFY row_number() OVER (PARTITION BY film_id, scene ORDER BY CASE WHEN len(ps) <= allowed THEN k WHEN k = 8 THEN 8 ELSE 9 END) = 1),
    tail AS (SELECT film_id, scene, seconds, CASE WHEN len(ps) > allowed THEN list_append(ps[1:allowed - 1], array_to_string(ps[allowed:], ' ')) ELSE ps END AS ps FROM chosen),
    merging AS (
      SELECT film_id, scene, seconds, ps FROM tail
      UNION ALL
      SELECT film_id, scene, seconds, list_concat(list_concat(ps[1:m - 1], [ps[m] || ' ' || ps[m + 1]]), ps[m + 2:]) FROM (
        SELECT *, CASE WHEN worst < len(ps) THEN worst ELSE worst - 1 END AS m FROM (
          SELECT *, list_position(ns, list_min(ns)) AS worst FROM (SELECT *, list_transform(ps, lambda p: length(p)) AS ns FROM merging)
          WHERE len(ps) > 1 AND seconds * list_min(ns) / list_sum(ns) < 0.9::DOUBLE - 1e-9::DOUBLE))),
    done AS (SELECT *, list_transform(ps, lambda p: length(p)) AS ns FROM merging
      QUALIFY row_number() OVER (PARTITION BY film_id, scene ORDER BY len(ps)) = 1),
    cues AS (SELECT film_id, scene, seconds, list_sum(ns) AS total, unnest(range(len(ps))) AS cue, unnest(ps) AS text, unnest(ns) AS n FROM done),
    timed AS (SELECT film_id, scene, cue, text, seconds * CAST(sum(n) OVER w - n AS BIGINT) / total AS start_s, seconds * CAST(sum(n) OVER w AS BIGINT) / total AS end_s
      FROM cues WINDOW w AS (PARTITION BY film_id, scene ORDER BY cue))"""
register("cue_timing", lambda s, d: captions.timed_cues(R.f_caption(s, d)), f"WITH RECURSIVE {CUES_SQL} SELECT * FROM timed")


def cue_at(spark, sf):
    """The cue on screen at the start, at three places inside, and at the end of every scene."""
    from sceneframe.operators.timeline import cue_at as at

    moments = R.f_caption(spark, sf).select(
        "film_id", "scene", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("seconds") * k / F.lit(4.0))).alias("at"))
    return at(captions.timed_cues(R.f_caption(spark, sf)), moments).select("film_id", "scene", F.col("at").alias("moment"), "cue")


register("cue_at", cue_at, f"""
    WITH RECURSIVE {CUES_SQL} SELECT t.film_id, t.scene, moment, cue FROM timed t
      JOIN (SELECT film_id, scene, seconds * unnest(range(5)) / 4.0::DOUBLE AS moment FROM f_caption) m ON m.film_id = t.film_id AND m.scene = t.scene
    WHERE moment >= start_s AND moment < end_s""")


def undrawable(spark, sf):
    films = R.f_written(spark, sf).select(F.floor(F.col("doc_id") / 10).alias("film_id"), F.col("doc_id").alias("scene"), F.col("line").alias("text"))
    return captions.undrawable(films)


register("undrawable", undrawable, "SELECT * FROM undrawn")

# --- languages and voices ----------------------------------------------------
_SC = [(n, "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in r)) for n, r in C.SCRIPTS]
RELATIONS["spoken_line"] = f"""
    SELECT doc_id, line, voice, CASE WHEN top = 'zh' AND regexp_matches(line, '[{dict(_SC)['ja']}]') THEN 'ja' ELSE top END AS language FROM (
      SELECT *, CASE WHEN list_max(ns) > 0 THEN ([{', '.join(f"'{n}'" for n, _ in _SC)}])[list_position(ns, list_max(ns))] END AS top FROM (
        SELECT *, [{', '.join(f"length(line) - length(regexp_replace(line, '[{r}]', '', 'g'))" for _, r in _SC)}] AS ns FROM f_written))"""
_DV = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.DEFAULT_VOICES.items()) + " {e}END"
register("script_profile", lambda s, d: voices.script_profile(R.f_written(s, d)),
         "SELECT language, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM spoken_line GROUP BY language")
register("default_voice", lambda s, d: voices.default_voices(R.f_written(s, d)).select("doc_id", "language", "default_voice"),
         f"SELECT doc_id, language, {_DV.format(e=chr(69) + 'LSE ' + repr(C.PROVIDER_DEFAULT_VOICE) + ' ')} AS default_voice FROM spoken_line")
register("wrong_script", lambda s, d: voices.wrong_script(R.f_written(s, d)).select("doc_id", "language", "voice", "suggestion"),
         f"SELECT doc_id, language, voice, {_DV.format(e='')} AS suggestion FROM spoken_line WHERE language IS NOT NULL AND NOT starts_with(voice, language || '-')")


def voice_choice(spark, sf):
    """Who chose the voice of every project: run, project, fallback or nobody."""
    s = R.f_settings(spark, sf)
    k = F.col("project_id")
    chosen = F.when(k % 4 == 1, " en-GB-RyanNeural ").when(k % 4 == 2, "default").when(k % 4 == 3, "")
    fallback = F.when(k % 3 == 1, "en-GB-RyanNeural").when(k % 3 == 2, " hi-IN-MadhurNeural ")
    asked = s.select("project_id", chosen.alias("chosen"), F.col("voice").alias("project"), fallback.alias("fallback"),
                     F.lit("en-US-AvaNeural").alias("provider_default"))
    return voices.choose(asked).select("project_id", "voice", "origin", "is_fallback")


register("voice_choice", voice_choice, """
    WITH v AS (SELECT project_id, CASE project_id % 4 WHEN 1 THEN 'en-GB-RyanNeural' END AS r,
        CASE WHEN trim(voice) NOT IN ('', 'default') THEN trim(voice) END AS p,
        CASE project_id % 3 WHEN 1 THEN 'en-GB-RyanNeural' WHEN 2 THEN 'hi-IN-MadhurNeural' END AS f FROM f_settings)
    SELECT project_id, coalesce(r, p, f, 'en-US-AvaNeural') AS voice,
      CASE WHEN r IS NOT NULL THEN 'run' WHEN p IS NOT NULL THEN 'project' WHEN f IS NOT NULL THEN 'fallback' ELSE 'unchosen' END AS origin,
      coalesce(r, p, f) IS NOT NULL AND coalesce(f = coalesce(r, p, f), false) AS is_fallback FROM v""")


def unchosen_voice(spark, sf):
    d = R.f_draft(spark, sf).select("project_id", F.when(F.col("text").isNotNull(), "tts").otherwise("file").alias("source_kind"), "voice")
    return voices.unchosen(d)


register("unchosen_voice", unchosen_voice, """
    SELECT project_id, count(*) AS unchosen FROM f_draft WHERE text IS NOT NULL AND (voice IS NULL OR trim(voice) = 'default') GROUP BY project_id""")


def _catalogue(spark, sf):
    return voice_source.parse(R.f_voice_table(spark, sf))


register("voice_catalogue", _catalogue, "SELECT table_id, line_no, voice_id, locale, gender, note FROM f_voice")
register("voice_search", lambda s, d: voices.search(_catalogue(s, d), "EN-g", "female").select("table_id", "voice_id"),
         "SELECT table_id, voice_id FROM f_voice WHERE (contains(lower(voice_id), 'en-g') OR contains(lower(locale), 'en-g')) AND gender = 'Female'")
