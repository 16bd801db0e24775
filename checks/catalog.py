"""Queries over folders of assets: cataloguing, pairing, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import relations as R
from checks.registry import register
from checks.relations_sql import RELATIONS
from sceneframe.operators import arrange, catalog, pairing
from sceneframe.sources import assets


# --- catalog -----------------------------------------------------------------
def _paths(spark, sf):
    a = R.f_asset(spark, sf)
    bare = F.when(F.col("file_no") % 11 == 0, F.col("stem")).otherwise(F.col("name"))
    name = F.when(F.col("file_no") % 7 == 0, F.concat(F.lit("."), bare)).otherwise(bare)
    return a.select(
        F.concat(F.lit("file:/media/p"), F.col("project_id").cast("string"), F.lit("/"), name).alias("path"),
        F.col("bytes").alias("length"), F.col("modified_at").alias("modificationTime"),
    )


def asset_scan(spark, sf):
    return catalog.from_paths(_paths(spark, sf)).select(
        "project", "name", "stem", "ext", "kind", "folded", "bytes", F.unix_micros("modified_at").alias("modified_us")
    )


register("asset_scan", asset_scan, """
    SELECT 'p' || project_id AS project, name, stem, ext, kind, folded, bytes, epoch_us(modified_at) AS modified_us
    FROM kinded WHERE file_no % 7 <> 0 AND file_no % 11 <> 0""")

def asset_inventory(spark, sf):
    """Project folders out of an inventory of one root, with files of other roots and hidden ones among them."""
    a = R.f_asset(spark, sf)
    folder = F.when(F.col("file_no") % 5 == 0, "/other/").when(F.col("file_no") % 7 == 0, "/media/_parked/").otherwise("/media/")
    takes = F.when(F.col("file_no") % 3 == 0, "takes/").otherwise("")
    below = F.when(F.col("file_no") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), F.col("project_id").cast("string"), F.lit("/"), takes))
    inventory = a.select(F.concat(folder, below, "name").alias("path"), F.col("bytes").alias("length"), F.col("modified_at").alias("modificationTime"))
    return assets.from_inventory(inventory, "/media/").select("project", "name", "kind", "bytes")


register("asset_inventory", asset_inventory, """
    SELECT CASE WHEN file_no % 13 = 0 THEN 'media' WHEN file_no % 3 = 0 THEN 'p' || project_id || '/takes' ELSE 'p' || project_id END AS project, name, kind, bytes
    FROM kinded WHERE file_no % 5 <> 0 AND file_no % 7 <> 0""")


def asset_changes(spark, sf):
    """The catalog of a day and of the day before: files that came, went, grew or were touched."""
    path = F.concat(F.lit("/media/p"), F.col("project_id").cast("string"), F.lit("/"), "name", F.lit("-"), F.col("file_no").cast("string"))
    a = R.f_asset(spark, sf).select(path.alias("path"), F.col("bytes").alias("length"), F.col("modified_at").alias("modificationTime"), "file_no")
    before = a.filter("file_no % 7 <> 1").withColumn("length", F.when(F.col("file_no") % 5 == 2, F.col("length") - 1).otherwise(F.col("length")))
    touched = F.when(F.col("file_no") % 13 == 4, F.col("modificationTime") + F.make_dt_interval(secs=F.lit(1))).otherwise(F.col("modificationTime"))
    after = a.filter("file_no % 11 <> 3").withColumn("modificationTime", touched)
    # An older entry of a path beside its latest one.
    older = after.filter("file_no % 3 = 0").withColumns(
        {"modificationTime": F.col("modificationTime") - F.make_dt_interval(days=F.lit(1)), "length": F.lit(0).cast("bigint")})
    return assets.asset_changes(before, after.unionByName(older))


register("asset_changes", asset_changes, """
    SELECT '/media/p' || project_id || '/' || name || '-' || file_no AS path,
      CASE WHEN file_no % 7 = 1 THEN 'added' WHEN file_no % 11 = 3 THEN 'gone' ELSE 'changed' END AS change,
      CASE WHEN file_no % 7 <> 1 THEN bytes - CASE WHEN file_no % 5 = 2 THEN 1 ELSE 0 END END AS old_length,
      CASE WHEN file_no % 11 <> 3 THEN bytes END AS length
    FROM kinded WHERE NOT (file_no % 7 = 1 AND file_no % 11 = 3) AND (file_no % 7 = 1 OR file_no % 11 = 3 OR file_no % 5 = 2 OR file_no % 13 = 4)""")

register(
    "asset_kind",
    lambda s, d: catalog.classified(R.f_asset(s, d)).select("project_id", "file_no", "kind", "folded"),
    "SELECT project_id, file_no, kind, folded FROM kinded",
)

SLOTS_SQL = """
    slots AS (
      SELECT project_id, folded, arg_min(stem, name) AS scene_id,
        count(*) FILTER (kind = 'image') AS images, min(name) FILTER (kind = 'image') AS image,
        count(*) FILTER (kind = 'audio') AS audios, min(name) FILTER (kind = 'audio') AS audio,
        count(*) FILTER (kind = 'text') AS texts, min(name) FILTER (kind = 'text') AS text
      FROM kinded WHERE kind IS NOT NULL GROUP BY project_id, folded)"""


def _slots(spark, sf):
    return catalog.scene_slots(R.f_asset(spark, sf))


register("scene_slots", _slots, f"WITH {SLOTS_SQL} SELECT * FROM slots")
register("ambiguous_scenes", lambda s, d: catalog.ambiguous_scenes(R.f_asset(s, d)), """
    SELECT a.project_id, a.folded, CASE a.kind WHEN 'audio' THEN 'narration' ELSE a.kind END AS slot, c.candidates, a.name AS candidate
    FROM kinded a JOIN (SELECT project_id, folded, kind, count(*) AS candidates FROM kinded
                        WHERE kind IS NOT NULL GROUP BY ALL HAVING count(*) > 1) c
      ON a.project_id = c.project_id AND a.folded = c.folded AND a.kind = c.kind""")
register("text_role", lambda s, d: catalog.text_roles(_slots(s, d)), f"""
    WITH {SLOTS_SQL} SELECT project_id, scene_id, text, CASE WHEN audios > 0 THEN 'caption' ELSE 'script' END AS role
    FROM slots WHERE images > 0 AND texts > 0""")
register("awaiting", lambda s, d: catalog.awaiting(_slots(s, d)), f"""
    WITH {SLOTS_SQL} SELECT project_id, scene_id, TRY_CAST(scene_id AS BIGINT) AS number, audio, text
    FROM slots WHERE images = 0 AND regexp_full_match(scene_id, '[0-9]+')""")
register("unpaired_files", lambda s, d: catalog.unpaired_files(_slots(s, d)), f"""
    WITH {SLOTS_SQL} SELECT project_id, folded, name FROM (
      SELECT project_id, folded, unnest([audio, text]) AS name FROM slots
      WHERE images = 0 AND NOT regexp_full_match(scene_id, '[0-9]+')) WHERE name IS NOT NULL""")
register("awaiting_summary", lambda s, d: catalog.awaiting_summary(_slots(s, d)), f"""
    WITH {SLOTS_SQL}, flagged AS (
      SELECT *, images = 0 AND regexp_full_match(scene_id, '[0-9]+') AS waiting FROM slots),
    firsts AS (SELECT project_id, scene_id AS first FROM flagged WHERE waiting
      QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY CAST(scene_id AS BIGINT), folded) = 1)
    SELECT f.project_id, count(*) FILTER (waiting) AS scenes, any_value(x.first) AS first,
           count(*) FILTER (images > 0) = 0 AS none_pictured
    FROM flagged f JOIN firsts x USING (project_id) GROUP BY f.project_id""")
register("running_order", lambda s, d: catalog.running_order(R.f_asset(s, d)), """
    SELECT project_id, folded, count(*) AS files,
           row_number() OVER (PARTITION BY project_id ORDER BY any_value(nat), folded) AS position
    FROM kinded WHERE kind IS NOT NULL GROUP BY project_id, folded""")
register("next_number", lambda s, d: catalog.next_numbers(R.f_asset(s, d)), """
    SELECT project_id, coalesce(max(n) FILTER (kind = 'image'), 0) + 1 AS next_picture,
           coalesce(max(n) FILTER (kind IS NOT NULL), 0) + 1 AS next_scene
    FROM (SELECT *, CASE WHEN regexp_full_match(stem, '[0-9]+') THEN CAST(stem AS BIGINT) END AS n FROM kinded) GROUP BY project_id""")


def listed_cells(spark, sf):
    """Assets, and manifest cells for the assets whose size is even, written in several spellings."""
    a = R.f_asset(spark, sf)
    cell = (
        F.when(F.col("bytes") % 6 == 0, F.concat(F.lit("./"), "name"))
        .when(F.col("bytes") % 6 == 2, F.concat(F.lit("old\\..\\"), "name")).otherwise(F.col("name"))
    )
    return a, a.select("project_id", F.when(F.col("bytes") % 2 == 0, cell).alias("image"))


RELATIONS["unlisted"] = """
    SELECT project_id, file_no, name FROM kinded k WHERE kind = 'image'
      AND NOT EXISTS (SELECT 1 FROM f_asset a WHERE a.project_id = k.project_id AND a.name = k.name AND a.bytes % 2 = 0)"""
register("unlisted_images", lambda s, d: catalog.unlisted_images(*listed_cells(s, d)), "SELECT * FROM unlisted")


def owned_names(spark, sf):
    key = F.lpad(F.hex("bytes"), 16, "0")
    pick = F.col("file_no") % 7
    name = (
        F.when(pick == 0, F.concat(F.lit("seg-"), key, F.lit(".mp4")))
        .when(pick == 1, F.concat(F.lit("seg-0001-"), key, F.lit(".mp4")))
        .when(pick == 2, F.concat(F.lit("tts-"), key, F.lit(".wav")))
        .when(pick == 3, F.concat(F.lit("spoken-"), key, F.lit(".wav")))
        .when(pick == 4, F.concat(F.lit("."), F.col("stem"), F.lit(".partial-12-1.mp4")))
        .when(pick == 5, F.concat(F.lit("seg-1-"), key, F.lit(".mp4")))
        .otherwise(F.concat(F.col("stem"), F.lit(" (1)."), F.col("ext")))
    )
    files = R.f_asset(spark, sf).select("project_id", "file_no", name.alias("name"))
    return catalog.owned_files(files)


register("owned_names", owned_names, """
    SELECT project_id, file_no, CASE p WHEN 0 THEN 'seg-' || key || '.mp4' WHEN 1 THEN 'seg-0001-' || key || '.mp4'
        WHEN 2 THEN 'tts-' || key || '.wav' WHEN 3 THEN 'spoken-' || key || '.wav'
        WHEN 4 THEN '.' || stem || '.partial-12-1.mp4' WHEN 5 THEN 'seg-1-' || key || '.mp4' ELSE stem || ' (1).' || ext END AS name,
      CASE p WHEN 0 THEN 'segment' WHEN 1 THEN 'segment' WHEN 2 THEN 'audio' WHEN 4 THEN 'partial' END AS owner,
      p NOT IN (4, 6) AS safe
    FROM (SELECT *, file_no % 7 AS p, lpad(upper(to_hex(bytes)), 16, '0') AS key FROM f_asset)""")


def path_containment(spark, sf):
    pick = F.col("bytes") % 7
    asked = (
        F.when(pick == 0, F.concat(F.lit("img/"), "name")).when(pick == 1, F.concat(F.lit("a/../../"), "name"))
        .when(pick == 2, F.concat(F.lit("/media/p1/./"), "name")).when(pick == 3, F.concat(F.lit("/media/p1x/"), "name"))
        .when(pick == 4, F.lit("../../../..")).when(pick == 5, F.lit("")).otherwise(F.concat(F.lit("a//b/../"), "name"))
    )
    requests = R.f_asset(spark, sf).select("project_id", "file_no", F.lit("/media/p1").alias("root"), asked.alias("requested"))
    return catalog.contained(requests).select("project_id", "file_no", "requested", "verdict")


register("path_containment", path_containment, """
    SELECT project_id, file_no, CASE p WHEN 0 THEN 'img/' || name WHEN 1 THEN 'a/../../' || name WHEN 2 THEN '/media/p1/./' || name
        WHEN 3 THEN '/media/p1x/' || name WHEN 4 THEN '../../../..' WHEN 5 THEN '' ELSE 'a//b/../' || name END AS requested,
      (['inside', 'outside', 'inside', 'outside', 'outside', 'empty', 'inside'])[CAST(p AS INT) + 1] AS verdict
    FROM (SELECT *, bytes % 7 AS p FROM f_asset)""")

# --- pairing -----------------------------------------------------------------
register("pair_by_stem", lambda s, d: pairing.pair_by_stem(R.f_asset(s, d), "audio"), """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_id, folded, kind ORDER BY nat, file_no) AS k
               FROM kinded WHERE kind IN ('image', 'audio'))
    SELECT i.project_id, i.folded, i.file_no AS image_no, a.file_no AS file_no
    FROM n i JOIN n a ON i.project_id = a.project_id AND i.folded = a.folded AND i.k = a.k AND i.kind = 'image' AND a.kind = 'audio'""")

PAIRS_SQL = """
    name_nat AS (SELECT project_id, file_no, folded, kind, ext, name,
        list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'),
          lambda r: CASE WHEN r[1] BETWEEN '0' AND '9' THEN {'t': 0, 'n': CAST(r AS BIGINT), 's': ''}
                    ELSE {'t': 1, 'n': 0::BIGINT, 's': r} END) AS nat FROM kinded WHERE kind IS NOT NULL),
    pools AS (SELECT unnest(['audio', 'text']) AS pool),
    imgs AS (SELECT pool, n.*, row_number() OVER (PARTITION BY pool, project_id, folded ORDER BY nat, file_no) AS k
             FROM name_nat n, pools WHERE kind = 'image'),
    fils AS (SELECT kind AS pool, *, row_number() OVER (PARTITION BY kind, project_id, folded ORDER BY nat, file_no) AS k
             FROM name_nat WHERE kind <> 'image'),
    named AS (SELECT i.pool, i.project_id, i.file_no AS image_no, f.file_no FROM imgs i JOIN fils f
              ON i.pool = f.pool AND i.project_id = f.project_id AND i.folded = f.folded AND i.k = f.k),
    left_i AS (SELECT *, row_number() OVER (PARTITION BY pool, project_id ORDER BY nat, file_no) AS o FROM imgs i
               WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.pool = i.pool AND n.project_id = i.project_id AND n.image_no = i.file_no)),
    left_f AS (SELECT *, lower(ext) <> 'md' AS guess, row_number() OVER (PARTITION BY pool, project_id, lower(ext) <> 'md' ORDER BY nat, file_no) AS o
               FROM fils f WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.pool = f.pool AND n.project_id = f.project_id AND n.file_no = f.file_no)),
    pairs AS (
      SELECT project_id, pool, image_no, file_no, 'name' AS phase FROM named
      UNION ALL
      SELECT coalesce(i.project_id, f.project_id), coalesce(i.pool, f.pool), i.file_no, f.file_no,
             CASE WHEN f.file_no IS NULL THEN 'alone' WHEN i.file_no IS NULL THEN 'spare' ELSE 'position' END
      FROM left_i i FULL JOIN (SELECT * FROM left_f WHERE guess) f ON i.pool = f.pool AND i.project_id = f.project_id AND i.o = f.o
      UNION ALL SELECT project_id, pool, NULL, file_no, 'refused' FROM left_f WHERE NOT guess)"""


def pair_two_phase(spark, sf):
    return pairing.pair_two_phase(R.f_asset(spark, sf), ["audio", "text"])


# The oracle gives every pool the stills of every project, also where the pool is empty;
# so does the engine, which numbers stills and files in one frame.
register("pair_two_phase", pair_two_phase, f"WITH {PAIRS_SQL} SELECT * FROM pairs")


def intake_summary(spark, sf):
    a = R.f_asset(spark, sf)
    return pairing.intake_summary(a, a)


register("intake_summary", intake_summary, f"""
    WITH {PAIRS_SQL},
    starts AS (SELECT project_id, coalesce(max(CASE WHEN kind = 'image' AND regexp_full_match(stem, '[0-9]+') THEN CAST(stem AS BIGINT) END), 0) + 1 AS start
               FROM kinded GROUP BY project_id),
    waits AS (SELECT project_id, stem, min(name) AS waiting FROM kinded WHERE kind IN ('audio', 'text') AND regexp_full_match(stem, '[0-9]+') GROUP BY ALL),
    st AS (SELECT project_id, image_no, bool_or(pool = 'audio' AND file_no IS NOT NULL) AS a, bool_or(pool = 'text' AND file_no IS NOT NULL) AS t
           FROM pairs WHERE image_no IS NOT NULL GROUP BY ALL),
    od AS (SELECT st.*, start, row_number() OVER (PARTITION BY st.project_id ORDER BY nat, image_no) AS o, count(*) OVER (PARTITION BY st.project_id) AS n
           FROM st JOIN name_nat m ON m.project_id = st.project_id AND m.file_no = st.image_no JOIN starts ON starts.project_id = st.project_id),
    fl AS (SELECT od.*, waiting FROM od LEFT JOIN waits w ON w.project_id = od.project_id
             AND w.stem = lpad(CAST(start + o - 1 AS VARCHAR), greatest(3, length(CAST(start + n - 1 AS VARCHAR)), length(CAST(start + o - 1 AS VARCHAR)))::INT, '0')),
    p1 AS (SELECT project_id, count(*) AS photos, count(*) FILTER (a) AS narrations, count(*) FILTER (t AND NOT a) AS spoken,
             count(*) FILTER (t AND a) AS captions, count(*) FILTER (NOT t AND NOT a AND waiting IS NOT NULL) AS filled,
             count(*) FILTER (NOT t AND NOT a AND waiting IS NULL) AS silent FROM fl GROUP BY project_id),
    p2 AS (SELECT project_id, count(*) FILTER (phase = 'spare') AS orphans, count(*) FILTER (phase = 'refused') AS refused FROM pairs GROUP BY project_id),
    p3 AS (SELECT project_id, count(*) FILTER (kind IS NULL) AS strangers FROM kinded GROUP BY project_id)
    SELECT project_id, coalesce(photos, 0) AS photos, coalesce(narrations, 0) AS narrations, coalesce(spoken, 0) AS spoken,
      coalesce(captions, 0) AS captions, coalesce(filled, 0) AS filled, coalesce(silent, 0) AS silent,
      coalesce(orphans, 0) AS orphans, strangers + coalesce(refused, 0) AS skipped
    FROM p3 LEFT JOIN p1 USING (project_id) LEFT JOIN p2 USING (project_id)""")

# --- numbering ---------------------------------------------------------------
SCENES_SQL = """
    numbered_files AS (SELECT *, CAST(stem AS BIGINT) AS number FROM kinded WHERE kind IS NOT NULL AND regexp_full_match(stem, '[0-9]+')),
    scenes AS (
      SELECT project_id, stem AS scene_id, min(number) AS number, count(*) AS files, count(*) FILTER (kind = 'image') = 0 AS waiting,
        row_number() OVER (PARTITION BY project_id ORDER BY min(number), count(*) FILTER (kind = 'image') = 0, stem) AS position,
        count(*) OVER (PARTITION BY project_id) AS scenes
      FROM numbered_files GROUP BY project_id, stem)"""
_PAD = "lpad(CAST({p} AS VARCHAR), greatest(3, length(CAST({c} AS VARCHAR)), length(CAST({p} AS VARCHAR)))::INT, '0')"


def _scenes(spark, sf):
    return arrange.all_scenes(R.f_asset(spark, sf))


register("all_scenes", _scenes, f"WITH {SCENES_SQL} SELECT * FROM scenes")
register("renumber", lambda s, d: arrange.renumber(_scenes(s, d), R.f_asset(s, d)), f"""
    WITH {SCENES_SQL}, plan AS (
      SELECT f.project_id, f.file_no, f.name AS from_name, {_PAD.format(p='s.position', c='s.scenes')} || '.' || f.ext AS to_name
      FROM scenes s JOIN numbered_files f ON s.project_id = f.project_id AND s.scene_id = f.stem)
    SELECT * FROM plan WHERE from_name <> to_name""")


def _moves(spark, sf):
    return R.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("project_id"), (F.col("o_custkey") % 3 + 1).alias("from_position"),
        (F.col("o_custkey") % 7).alias("to_position"),
    )


def move_plan(spark, sf):
    return arrange.move_plan(_scenes(spark, sf), R.f_asset(spark, sf), _moves(spark, sf))


register("move_plan", move_plan, f"""
    WITH {SCENES_SQL}, asked AS (
      SELECT s.*, o_custkey % 3 + 1 AS a, least(greatest(o_custkey % 7, 1), scenes) AS t FROM scenes s JOIN orders ON o_orderkey = project_id
      WHERE o_custkey % 3 + 1 <= scenes),
    resorted AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY
        CASE WHEN position = a THEN t + CASE WHEN t > a THEN 0.5 WHEN t < a THEN -0.5 ELSE 0 END ELSE position END) AS p FROM asked),
    plan AS (SELECT f.project_id, f.file_no, f.name AS from_name, {_PAD.format(p='s.p', c='s.scenes')} || '.' || f.ext AS to_name
      FROM resorted s JOIN numbered_files f ON s.project_id = f.project_id AND s.scene_id = f.stem)
    SELECT * FROM plan WHERE from_name <> to_name""")


def remove_plan(spark, sf):
    gone = _scenes(spark, sf).filter("position % 4 = 2").select("project_id", "scene_id")
    return arrange.remove_plan(_scenes(spark, sf), R.f_asset(spark, sf), gone)


register("remove_plan", remove_plan, f"""
    WITH {SCENES_SQL}, kept AS (SELECT project_id, scene_id, row_number() OVER (PARTITION BY project_id ORDER BY position) AS p,
        count(*) OVER (PARTITION BY project_id) AS c FROM scenes WHERE position % 4 <> 2),
    plan AS (SELECT f.project_id, f.file_no, f.name AS from_name, {_PAD.format(p='s.p', c='s.c')} || '.' || f.ext AS to_name
      FROM kept s JOIN numbered_files f ON s.project_id = f.project_id AND s.scene_id = f.stem)
    SELECT * FROM plan WHERE from_name <> to_name""")


def rename_conflicts(spark, sf):
    """Renumbering that forgets the scenes still waiting for a picture."""
    a = R.f_asset(spark, sf)
    pictured = _scenes(spark, sf).filter("NOT waiting")
    plan = arrange.remove_plan(pictured, a, pictured.limit(0))
    return arrange.rename_conflicts(plan, a, pictured)


register("rename_conflicts", rename_conflicts, f"""
    WITH {SCENES_SQL}, kept AS (SELECT project_id, scene_id, row_number() OVER (PARTITION BY project_id ORDER BY position) AS p,
        count(*) OVER (PARTITION BY project_id) AS c FROM scenes WHERE NOT waiting),
    plan AS (SELECT f.project_id, f.name AS from_name, {_PAD.format(p='s.p', c='s.c')} || '.' || f.ext AS to_name
      FROM kept s JOIN numbered_files f ON s.project_id = f.project_id AND s.scene_id = f.stem)
    SELECT * FROM plan p WHERE from_name <> to_name AND EXISTS (
      SELECT 1 FROM kinded k WHERE k.project_id = p.project_id AND k.name = p.to_name
        AND NOT EXISTS (SELECT 1 FROM kept m WHERE m.project_id = k.project_id AND m.scene_id = k.stem))""")


def fill_waiting(spark, sf):
    orders = R.table(spark, sf, "orders")
    pictures = orders.select(
        F.col("o_orderkey").alias("project_id"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("o_custkey") % 3 + 1)).alias("picture_no"),
    )
    starts = orders.select(F.col("o_orderkey").alias("project_id"), (F.col("o_custkey") % 2 + 1).alias("start"))
    return arrange.fill_waiting(_scenes(spark, sf), starts, pictures)


register("fill_waiting", fill_waiting, f"""
    WITH {SCENES_SQL}, slots AS (SELECT project_id, scene_id, row_number() OVER (PARTITION BY project_id ORDER BY position) AS k
        FROM scenes JOIN orders ON o_orderkey = project_id WHERE waiting AND position >= o_custkey % 2 + 1),
    rooms AS (SELECT project_id, count(*) AS room FROM slots GROUP BY project_id),
    pics AS (SELECT o_orderkey AS project_id, unnest(range(1, o_custkey % 3 + 2)) AS picture_no, o_custkey % 3 + 1 AS pictures FROM orders)
    SELECT p.project_id, picture_no, coalesce(room, 0) < pictures AS refused, CASE WHEN coalesce(room, 0) >= pictures THEN scene_id END AS scene_id
    FROM pics p LEFT JOIN rooms USING (project_id) LEFT JOIN slots s ON s.project_id = p.project_id AND s.k = p.picture_no""")
