"""Queries over event logs, batch and streaming. Every stream is checked like a batch job."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import relations as R
from checks.registry import ORACLES, register
from checks.relations_sql import RELATIONS
from checks.texts import SP
from sceneframe import constants as C
from sceneframe.functions import redact
from sceneframe.operators import activity
from sceneframe.operators.sizing import spread
from sceneframe.sources import logs, toollog
from sceneframe.streaming import intake, sinks, throttle
from sceneframe.streaming import logs as log_stream

# --- redaction ---------------------------------------------------------------
_TOK = rf"(^|[{SP}])[\"'',;()\[\]{{}}]*[A-Za-z0-9_+\-]{{32,}}[\"'',;()\[\]{{}}]*($|[{SP}])"


def _token_sql(x: str) -> str:
    once = f"regexp_replace({x}, '{_TOK}', '\\1[redacted]\\2', 'g')"
    return f"regexp_replace({once}, '{_TOK}', '\\1[redacted]\\2', 'g')"


def _line_sql(x: str) -> str:
    cases = []
    for m in C.SECRET_MARKERS:
        cases.append(f"WHEN regexp_matches({x}, '(?i){m}[^=:]*[=:]') THEN regexp_replace({x}, '(?i)^(.*?{m}[^=:]*[=:]).*$', '\\1[redacted]')")
        if m.endswith(" "):
            cases.append(f"WHEN regexp_matches({x}, '(?i){m}') THEN regexp_replace({x}, '(?i)^(.*?{m}).*$', '\\1[redacted]')")
    return f"CASE {' '.join(cases)} ELSE {_token_sql(x)} END"


def _redact_sql(x: str) -> str:
    return f"array_to_string(list_transform(str_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10)), lambda l: {_line_sql('l')}), chr(10))"


register("redact_corpus", lambda s, d: spread(R.table(s, d, "documents").select("doc_id", "text")).select("doc_id", redact.redact(F.col("text")).alias("text")),
         f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")

# --- logs --------------------------------------------------------------------
RELATIONS["e_clean"] = f"""
    SELECT event_id, run_id, level, scope, k, value, "at" AS ts, {_redact_sql('message')} AS message,
      strftime("at", '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us("at") // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS stamp FROM f_event"""


def _events(spark, sf):
    e = R.f_event(spark, sf)
    secret = F.when(F.col("event_id") % 4 == 0, "auth_token").otherwise("k")
    return e.withColumns({
        "fields": F.create_map(secret, F.col("k"), F.lit("run"), F.col("run_id").cast("string")),
        "project": F.concat(F.lit("p"), F.col("run_id").cast("string")),
        "folder": F.concat(F.lit("/media/p"), F.col("run_id").cast("string")),
    })


_SECRET_K = "CASE WHEN event_id % 4 = 0 THEN '[redacted]' ELSE k END"
_LINE = f"""'{{"at":"' || stamp || '","level":"' || level || '","scope":"' || scope || '","message":' || to_json(message) || ',"'
   || CASE WHEN event_id % 4 = 0 THEN 'auth_token' ELSE 'k' END || '":"' || {_SECRET_K} || '","run":"' || run_id || '"}}'"""

register("log_sink", lambda s, d: logs.log_lines(_events(s, d)).select("event_id", "day", "line"),
         f"""SELECT event_id, strftime(ts, '%Y%m%d') AS day, {_LINE} AS line FROM e_clean""")


def _lines(spark, sf):
    """Log lines of which every ninety-seventh was cut short by a crash."""
    whole = logs.log_lines(_events(spark, sf))
    cut = F.when(F.col("event_id") % 97 == 0, F.expr("substring(line, 1, length(line) - 4)")).otherwise(F.col("line"))
    return whole.select("event_id", cut.alias("value"))


_SCAN_SQL = f"""
    SELECT event_id, CASE WHEN ok THEN stamp END AS at, CASE WHEN ok THEN level END AS level, CASE WHEN ok THEN scope END AS scope,
      CASE WHEN ok THEN message END AS message, CASE WHEN ok THEN CAST(run_id AS VARCHAR) END AS run, NOT ok AS corrupt
    FROM (SELECT *, event_id % 97 <> 0 AS ok FROM e_clean)"""


def _scanned(df):
    return df.select("event_id", logs.iso(F.col("at")).alias("at"), "level", "scope", "message",
                     F.try_element_at("fields", F.lit("run")).alias("run"), F.col("corrupt").isNotNull().alias("corrupt"))


register("log_scan", lambda s, d: _scanned(logs.parse_lines(_lines(s, d))), _SCAN_SQL)


def _cell(x: str) -> str:
    flat = f"replace(replace({x}, chr(10), ' '), chr(13), ' ')"
    return (f"CASE WHEN regexp_matches({flat}, '^[=+\\-@\\t\\r]') AND TRY_CAST({flat} AS DOUBLE) IS NULL THEN '''' || {flat} ELSE {flat} END")


_RUNS_SQL = f"""
    SELECT stamp AS "when", level, scope, 'p' || run_id AS project, {_cell('message')} AS "what happened",
      CASE WHEN event_id % 4 = 0 THEN 'auth_token' ELSE 'k' END || '=' || {_SECRET_K} || '; run=' || run_id AS details, '/media/p' || run_id AS folder FROM e_clean"""
register("runs_export", lambda s, d: logs.activity_rows(_events(s, d)), _RUNS_SQL)


def runs_scan(spark, sf):
    """Activity rows as CSV text and back."""
    rows = logs.activity_rows(_events(spark, sf))
    line = F.to_csv(F.struct(*[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in rows.columns]), {k: v for k, v in logs.CSV_OPTIONS.items() if k != "header"})
    schema = ", ".join(f"{c.replace(' ', '_')} string" for c in rows.columns)
    back = rows.select(F.inline(F.array(F.from_csv(line, F.lit(schema), {k: v for k, v in logs.CSV_OPTIONS.items() if k != "header"}))))
    return back.groupBy("project", "level").agg(
        F.count(F.lit(1)).alias("rows"), F.min("when").alias("first"), F.max("what_happened").alias("largest"))


register("runs_scan", runs_scan, f"""
    SELECT project, level, count(*) AS rows, min("when") AS first, max("what happened") AS largest FROM ({_RUNS_SQL.strip()}) GROUP BY project, level""")


def bundle_report(spark, sf):
    lines = logs.log_lines(_events(spark, sf)).select("project", F.col("day").alias("file"), F.col("line").alias("value"))
    return logs.bundle_report(lines)


register("bundle_report", bundle_report, f"""
    SELECT 'p' || run_id AS project, count(DISTINCT strftime(ts, '%Y%m%d')) AS files, count(*) AS records, CAST(sum(strlen({_LINE}) + 1) AS BIGINT) AS bytes
    FROM e_clean GROUP BY run_id""")

# --- tool output -------------------------------------------------------------
_ENDINGS = [
    ("edge_tts.exceptions.NoAudioReceived: No audio was received", "permanent", False, False, False),
    ("aiohttp.client_exceptions.ClientConnectorError: Connect call failed", "transient", True, False, False),
    ("aiohttp.client_exceptions.WSServerHandshakeError: 403, message=Invalid, url=wss://x", "permanent", False, False, True),
    ("aiohttp.client_exceptions.WSServerHandshakeError: 503, url=wss://x/403", "transient", False, False, False),
    ("websockets InvalidStatus: 429 too many", "transient", True, False, False),
    ("socket.gaierror: [Errno 8] nodename nor servname provided", "transient", False, True, False),
    ("ClientProxyConnectionError: Connect call failed", "permanent", False, False, False),
    ("something odd happened", "permanent", False, False, False),
    ("aiohttp ConnectionTimeoutError: Connection timeout to host", "transient", True, False, False),
    ("Network is unreachable", "permanent", False, True, False),
    ("server said 429 wait", "transient", True, False, False),
]


def fault_class(spark, sf):
    endings = F.array(*[F.lit(e[0]) for e in _ENDINGS])
    text = F.concat(F.lit("Traceback\n  ValueError in line "), F.col("k"), F.lit("\n "), F.element_at(endings, (F.col("event_id") % len(_ENDINGS)).cast("int") + 1), F.lit(" \n\n"))
    e = R.f_event(spark, sf).select("event_id", text.alias("output"))
    return activity.classify(e).select("event_id", "line", "fault", "refusal", "lost_network", "stale_tool")


register("fault_class", fault_class, f"""
    WITH e(i, line, fault, refusal, lost_network, stale_tool) AS (VALUES {', '.join(f"({i}, '{t}', '{f}', {r}, {n}, {s})" for i, (t, f, r, n, s) in enumerate(_ENDINGS))})
    SELECT event_id, line, fault, refusal, lost_network, stale_tool FROM f_event JOIN e ON i = event_id % {len(_ENDINGS)}""")

SPANS_SQL = """
    spans AS (SELECT file_id, line_no, a AS start_s, CASE WHEN nx = 'end' THEN nx_at END AS end_s FROM (
      SELECT file_id, line_no, edge, "at" AS a, lead(edge) OVER w AS nx, lead("at") OVER w AS nx_at FROM f_edge WHERE edge <> 'loudness'
      WINDOW w AS (PARTITION BY file_id ORDER BY line_no)) WHERE edge = 'start')"""
register("silence_spans", lambda s, d: toollog.silence_spans(R.f_tool_log(s, d)), f"WITH {SPANS_SQL} SELECT * FROM spans")


def speech_bounds(spark, sf):
    lines = R.f_tool_log(spark, sf)
    d = lines.groupBy("file_id").agg((F.max("line_no") * 260.0).alias("duration"))
    return toollog.speech_bounds(toollog.silence_spans(lines), d)


register("speech_bounds", speech_bounds, f"""
    WITH {SPANS_SQL}, d AS (SELECT file_id, max(line_no) * 260.0::DOUBLE AS duration FROM f_edge GROUP BY file_id),
    x AS (SELECT file_id, arg_min(start_s, line_no) AS fs, arg_min(coalesce(end_s, -1), line_no) AS fe, arg_max(start_s, line_no) AS ls, arg_max(coalesce(end_s, 1e18), line_no) AS le FROM spans GROUP BY file_id),
    y AS (SELECT d.file_id, duration, CASE WHEN fs <= 0.05 AND fe >= 0 THEN fe ELSE 0.0 END AS speech_starts, ls, le FROM d LEFT JOIN x ON x.file_id = d.file_id)
    SELECT file_id, duration, speech_starts, CASE WHEN ls > speech_starts AND le >= duration - 0.05 THEN ls END AS speech_ends FROM y""")


def trim_plan(spark, sf):
    return toollog.trim_plan(speech_bounds(spark, sf), F.lit(0.15), F.lit(-1.0))


register("trim_plan", trim_plan, f"""
    WITH bounds AS ({ORACLES['speech_bounds']}),
    cut AS (SELECT file_id, duration, greatest(speech_starts - 0.15, 0) AS start_s, CASE WHEN speech_ends IS NOT NULL THEN least(speech_ends + 0, duration) END AS end_s FROM bounds)
    SELECT file_id, start_s, end_s, start_s > 0.0005 AS cuts_head, coalesce(end_s < duration - 0.0005, false) AS cuts_tail FROM cut""")
register("loudness", lambda s, d: toollog.loudness(R.f_tool_log(s, d)).select("file_id", "loudness"), """
    SELECT file_id, arg_min(-(floor(value) + 0.25), line_no) AS loudness FROM f_edge WHERE edge = 'loudness' GROUP BY file_id""")

# --- the speech service ------------------------------------------------------
RELATIONS["svc_event"] = """
    SELECT run_id, event_id, epoch_us("at") AS us, scope = 'error' AS refused, scope = 'purchase' AS answered,
      CAST(coalesce(sum(CASE WHEN scope = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY "at", event_id), 0) AS BIGINT) AS island FROM f_event"""
_EPISODES = """
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY island) AS episode, started_us, ended_us, refusals, island > 0 AS spoken_any,
      least(CAST(15 * pow(2, least(refusals - 1, 10)) AS BIGINT), 120) AS last_wait,
      (SELECT CAST(sum(least(15 * pow(2, least(x, 10)), 120)) AS BIGINT) FROM (SELECT unnest(range(refusals)) AS x)) AS waited,
      ended_us - started_us >= CASE WHEN island > 0 THEN 3600 ELSE 180 END * 1000000::BIGINT AS gave_up
    FROM (SELECT run_id, island, min(us) AS started_us, max(us) AS ended_us, count(*) AS refusals FROM svc_event WHERE refused GROUP BY run_id, island)"""


def _service(spark, sf):
    return R.f_event(spark, sf).select(
        "run_id", "event_id", "at", (F.col("scope") == "error").alias("refused"), (F.col("scope") == "purchase").alias("answered"))


def _plain_episodes(df):
    return df.select("run_id", "episode", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"),
                     "refusals", "spoken_any", "last_wait", "waited", "gave_up")


register("throttle_episodes", lambda s, d: _plain_episodes(activity.throttle_episodes(_service(s, d))), _EPISODES)
register("answered_within", lambda s, d: activity.answered_within(_service(s, d), 300).select("event_id", "recent"), """
    SELECT event_id, coalesce(us - last < 300000000, false) AS recent FROM (
      SELECT event_id, us, max(CASE WHEN answered THEN us END) OVER (PARTITION BY run_id ORDER BY us, event_id) AS last FROM svc_event)""")


def run_outcomes(spark, sf):
    outcome = F.when(F.col("scope") == "error", "failed").when(F.col("scope") == "view", "not_started").otherwise("done")
    return activity.run_outcomes(R.f_event(spark, sf).select("run_id", outcome.alias("outcome"), F.col("event_id").alias("scene")))


register("run_outcomes", run_outcomes, """
    SELECT run_id, count(*) FILTER (scope NOT IN ('error', 'view')) AS done, count(*) FILTER (scope = 'error') AS failed,
      count(*) FILTER (scope = 'view') AS not_started, min(event_id) FILTER (scope = 'error') AS first_failure FROM f_event GROUP BY run_id""")


def run_failures(spark, sf):
    outcome = F.when(F.col("scope") == "error", "failed").otherwise("done")
    return activity.run_failures(R.f_event(spark, sf).select("run_id", outcome.alias("outcome"), F.col("event_id").alias("scene"), F.col("message").alias("detail")))


register("run_failures", run_failures, """
    SELECT run_id, event_id AS scene, message AS detail, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS nth FROM f_event WHERE scope = 'error'""")


def recent_projects(spark, sf):
    e = R.f_event(spark, sf)
    uses = e.select(F.concat(F.lit("/media/p"), F.col("run_id").cast("string")).alias("path"), F.concat(F.lit("p"), F.col("scope")).alias("name"), "at")
    return activity.recent_projects(uses).select("path", "name", F.unix_micros("at").alias("at_us"))


register("recent_projects", recent_projects, """
    SELECT '/media/p' || run_id AS path, arg_max('p' || scope, ts) AS name, epoch_us(max(ts)) AS at_us
    FROM (SELECT run_id, scope, "at" AS ts FROM f_event) GROUP BY run_id ORDER BY at_us DESC, path LIMIT 30""")


# --- streams -----------------------------------------------------------------
def _event_stream(spark, sf):
    """The event table as a stream, with the columns of ``f_event`` worked out as they arrive."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("run_id"), F.col("event_type").alias("scope"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info").alias("level"),
        F.regexp_extract("props", r'"k": (\d+)', 1).alias("k"), "value",
    )


def _as_stream(spark, rows, folder, files=3, seconds=0):
    """A table as a stream of ``files`` files in order of time; with ``seconds``, a last row
    without a run that only moves the time on so far past the latest event."""
    dealt = rows.repartitionByRange(files, "at").withColumn("_file", F.spark_partition_id()).persist()
    for number in range(files):  # one after the other, as files are read in the order in which they came
        dealt.filter(F.col("_file") == number).drop("_file").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    dealt.unpersist()
    if seconds:
        clock = rows.agg((F.max("at") + F.make_dt_interval(secs=F.lit(seconds))).alias("at")).filter("at IS NOT NULL")
        columns = [F.col("at") if c == "at" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
        clock.select(*columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


#: The last row lies this far behind the watermark's delay, so all events are passed by it.
_PAST = 10 * 60 + 1


def stream_log(spark, sf):
    folder = sinks.new_folder(spark, "log")
    _lines(spark, sf).select("value").repartition(4).write.text(f"{folder}/in")
    tailed = log_stream.tail(spark, f"{folder}/in", files_per_batch=2)
    read = sinks.run_append(tailed, folder)
    return read.groupBy("scope", "level").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("corrupt").isNotNull()).alias("corrupt"), F.max("message").alias("largest"))


register("stream_log", stream_log, f"""
    SELECT scope, level, count(*) AS events, count(*) FILTER (corrupt) AS corrupt, max(message) AS largest FROM ({_SCAN_SQL.strip()}) GROUP BY scope, level""")


def stream_fanout(spark, sf):
    folder = sinks.new_folder(spark, "fanout")
    events = _events(spark, sf).select("at", "level", "scope", "message", "fields", "project", "folder")
    events.repartition(3).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    log_stream.fan_out(source, folder)
    index_schema = ", ".join(f"`{c}` string" for c in C.RUNS_COLUMNS)
    index = sinks.read_batches(spark, folder, "index", index_schema)
    log = sinks.read_batches(spark, folder, "log", "project string, day string, value string")
    a = index.groupBy("project").agg(F.count(F.lit(1)).alias("indexed"), F.max("what happened").alias("largest"))
    b = log.groupBy("project").agg(F.count(F.lit(1)).alias("logged"), F.sum(F.octet_length("value")).alias("bytes"))
    return a.join(b, "project")


register("stream_fanout", stream_fanout, f"""
    SELECT 'p' || run_id AS project, count(*) AS indexed, max({_cell('message')}) AS largest, count(*) AS logged, CAST(sum(strlen({_LINE})) AS BIGINT) AS bytes
    FROM e_clean GROUP BY run_id""")


def stream_throttle(spark, sf):
    folder = sinks.new_folder(spark, "throttle")
    told = throttle.monitor(_as_stream(spark, _service(spark, sf), folder, seconds=_PAST), folder)
    return _plain_episodes(throttle.episodes(told))


def stream_give_up(spark, sf):
    folder = sinks.new_folder(spark, "giveup")
    told = throttle.monitor(_as_stream(spark, _service(spark, sf), folder, seconds=_PAST), folder)
    return throttle.give_ups(told).select("run_id", "episode", F.unix_micros("at").alias("at_us"), "refusals")


def stream_announce(spark, sf):
    folder = sinks.new_folder(spark, "announce")
    return throttle.announce(_as_stream(spark, _service(spark, sf), folder, seconds=_PAST), folder).select("run_id", "event_id", "episode")


register("stream_throttle", stream_throttle, _EPISODES)
register("stream_give_up", stream_give_up, """
    WITH streak AS (
      SELECT run_id, island, min(us) FILTER (refused) AS started, dense_rank() OVER (PARTITION BY run_id ORDER BY island) AS episode,
        min(us) FILTER (refused) + CASE WHEN island > 0 THEN 3600 ELSE 180 END * 1000000::BIGINT AS limit_us
      FROM svc_event GROUP BY run_id, island HAVING count(*) FILTER (refused) > 0),
    ended AS (
      SELECT s.*, (SELECT min(us) FROM svc_event a WHERE a.run_id = s.run_id AND a.answered AND a.island = s.island + 1) AS answer_us FROM streak s)
    SELECT run_id, episode, limit_us AS at_us,
      (SELECT count(*) FROM svc_event r WHERE r.run_id = e.run_id AND r.island = e.island AND r.refused AND r.us < e.limit_us) AS refusals
    FROM ended e WHERE coalesce(answer_us, (SELECT (max(us) // 1000 + 1000) * 1000 FROM svc_event)) >= limit_us""")
register("stream_announce", stream_announce, """
    WITH RECURSIVE ep AS (SELECT run_id, event_id, us, dense_rank() OVER (PARTITION BY run_id ORDER BY island) AS episode,
        row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) AS n FROM svc_event WHERE refused),
    told AS (
      SELECT run_id, event_id, us, episode FROM ep WHERE n = 1
      UNION ALL
      SELECT run_id, f.event_id, f.us, f.episode FROM (
        SELECT t.run_id, min(struct_pack(us := e.us, event_id := e.event_id, episode := e.episode)) AS f
        FROM told t JOIN ep e ON e.run_id = t.run_id AND e.episode > t.episode AND e.us - t.us >= 600000000 GROUP BY t.run_id))
    SELECT run_id, event_id, episode FROM told""")


def stream_progress(spark, sf):
    folder = sinks.new_folder(spark, "progress")
    events = R.f_event(spark, sf).select("run_id", F.col("scope").alias("kind"), "at")
    done = log_stream.run_progress(_as_stream(spark, events, folder, seconds=61 * 86_400), folder, quiet="60 days")
    return done.select("run_id", "kind", "events", F.unix_micros("latest").alias("latest_us"))


register("stream_progress", stream_progress, """
    SELECT run_id, scope AS kind, count(*) AS events, epoch_us(max(ts)) AS latest_us FROM (SELECT run_id, scope, "at" AS ts FROM f_event) GROUP BY run_id, scope""")


def stream_daily(spark, sf):
    return sinks.run_append(log_stream.daily(_event_stream(spark, sf), "1 hour"), sinks.new_folder(spark, "daily"))


register("stream_daily", stream_daily, """
    WITH e AS (SELECT scope, level, "at" AS ts FROM f_event)
    SELECT strftime(ts, '%Y%m%d') AS day, scope, count(*) AS events, count(*) FILTER (level = 'error') AS errors FROM e
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e) GROUP BY day, scope""")


def stream_distinct(spark, sf):
    requests = _event_stream(spark, sf).select("at", F.concat_ws(":", "run_id", "k").alias("key"))
    return sinks.run_append(log_stream.first_requests(requests, "60 days"), sinks.new_folder(spark, "distinct")).select("key")


register("stream_distinct", stream_distinct, "SELECT DISTINCT run_id || ':' || k AS key FROM f_event")


def stream_intake(spark, sf):
    folder = sinks.new_folder(spark, "intake")
    assets = R.f_asset(spark, sf)
    assets.repartition(2).write.parquet(f"{folder}/in")
    landing = spark.readStream.schema(assets.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return intake.intake(landing, folder)


register("stream_intake", stream_intake)
ORACLES["stream_intake"] = ORACLES["intake_summary"]
