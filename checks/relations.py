"""Relations of media projects derived from the given tables, for the registered queries.

Each one is written once here for Spark and once in ``relations_sql`` for the oracle engine.
Every relation reads the whole table it comes from. ``f_stored`` and the files of ``validate``
leave rows out by a rule, in both engines, so that lookups miss some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.operators.ordered import numbered
from sceneframe.operators.sizing import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list) -> Column:
    """One of a few literal values by index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def line_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    return numbered(lines, ["l_orderkey"], order, "pos")


def f_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = (F.col("pos") + 1 - F.pmod(F.col("pos") + 1, F.lit(2))) / 2
    prefix = F.when(F.col("l_suppkey") % 4 == 0, "Take-").otherwise("")
    exts = ["jpg", "JPG", "png", "heic", "wav", "mp3", "txt", "md", "jpg", "pdf"]
    return (
        line_pos(spark, sf_dir)
        .select(
            F.col("l_orderkey").alias("project_id"),
            F.col("pos").alias("file_no"),
            F.concat(prefix, F.lpad(pair.cast("bigint").cast("string"), 3, "0")).alias("stem"),
            _pick(F.col("l_partkey") % 10, exts).alias("ext"),
            F.floor(F.col("l_extendedprice") * 100).alias("bytes"),
            F.col("l_shipdate").cast("timestamp").alias("modified_at"),
        )
        .withColumn("name", F.concat_ws(".", "stem", "ext"))
    )


def f_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("project_id"), (F.col("turn") + 1).alias("scene"), "role", F.col("text").alias("line")
    )


def f_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("project_id"), F.col("scene") - 1
    number = F.lpad(F.when((c * 3 + t) % 23 == 0, F.lit(1)).otherwise(t + 1).cast("string"), 3, "0")
    slash = F.when(c % 2 == 0, "img\\").otherwise("img/")
    durations = ["2.5", "0", "-1", "4000", "soon", "12", "0.4"]
    moves = ["zoom-in", "Zoom_Out", "pan left", " PAN-RIGHT ", "pan_up", "sideways", None, "pan-down", ""]
    anchors = ["centre", "Top_Left", "n", "outer space", None, "south east", "se", "  ", "middle", "W", "ne"]
    return f_scene(spark, sf_dir).select(
        "project_id", "scene",
        F.when((c + t) % 17 == 0, "  ").when((c + t) % 29 == 5, "img/a..b/")
        .otherwise(F.concat(slash, number, F.lit(".jpg"))).alias("image"),
        F.when((c + 2 * t) % 19 == 0, "   ").when((t % 5 == 3) & (c % 7 != 0), F.lit(None).cast("string"))
        .when(t % 5 == 4, F.lit(None).cast("string")).otherwise(F.col("line")).alias("text"),
        F.when((c % 7 == 0) | (t % 5 == 3), F.concat(F.lit("rec/"), number, F.lit(".wav"))).alias("audio_file"),
        F.when(t % 5 == 4, _pick(F.pmod(c + t, F.lit(7)), durations)).alias("duration"),
        _pick((c + t) % 4, [None, "en-GB-RyanNeural", " default ", "hi-IN-MadhurNeural"]).alias("voice"),
        _pick((c + t) % 9, moves).alias("zoom_direction"),
        _pick((c + 2 * t) % 11, anchors).alias("zoom_anchor"),
        F.when((c + t) % 6 == 5, F.concat(F.lit(" Caption for "), number, F.lit(" "))).alias("caption"),
    )


def f_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_pos(spark, sf_dir).select(
        F.col("l_orderkey").alias("film_id"),
        F.col("pos").alias("scene"),
        (F.floor("l_quantity") * 3 + F.col("pos")).alias("frames"),
        (F.col("l_partkey") % 7).alias("image_no"),
        F.floor(F.col("l_extendedprice") * 100).alias("bytes"),
        F.col("l_shipdate").cast("timestamp").alias("modified_at"),
    )


def f_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a content key; ``scene % 3`` makes some scenes share one key."""
    tts = F.col("image_no") % 3 != 0
    return f_segment(spark, sf_dir).select(
        "film_id", "scene", "frames", "bytes", "modified_at",
        F.concat_ws(":", "film_id", "frames").alias("key"),
        F.when(tts, "edge").alias("provider"),
        F.when(tts, "tts").otherwise("file").alias("kind"),
    )


def f_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = f_segment(spark, sf_dir)
    stored = plan.filter((F.col("film_id") + F.col("frames")) % 3 != 0)
    off = F.when((F.col("film_id") + F.col("frames")) % 11 == 0, 1).otherwise(0)
    return stored.groupBy("film_id", "frames").agg(
        F.min("bytes").alias("bytes"), F.max("modified_at").alias("modified_at")
    ).select(
        "film_id",
        F.concat_ws(":", "film_id", "frames").alias("key"),
        F.when(F.col("bytes") % 6 == 0, F.concat(F.lit("holiday "), "frames", F.lit(".mp4")))
        .when(F.col("bytes") % 6 == 1, F.concat(F.lit(".seg-"), "frames", F.lit(".mp4.partial-9-1.mp4")))
        .otherwise(F.concat(F.lit("seg-"), F.lpad(F.col("frames").cast("string"), 16, "0"), F.lit(".mp4"))).alias("name"),
        F.when(F.col("frames") % 5 != 0, F.col("frames") - off).alias("nb_frames"),
        ((F.col("frames") - off * 40) / F.lit(30.0)).alias("seconds"),
        "bytes",
        "modified_at",
    )


def f_still(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("still_id"),
        F.floor(F.col("p_partkey") / 50).alias("project_id"),
        F.concat(F.lit("s"), F.lpad((F.col("p_partkey") % 50).cast("string"), 3, "0")).alias("scene_id"),
        (F.col("p_partkey") % 50).alias("position"),
        (F.col("p_size") * 80 + F.col("p_partkey") % 3).cast("bigint").alias("width"),
        (F.col("p_size") * 45).cast("bigint").alias("height"),
        F.when(F.col("p_partkey") % 6 == 0, 4).otherwise(1).cast("bigint").alias("sar_num"),
        F.when(F.col("p_partkey") % 6 == 0, 3).when(F.col("p_partkey") % 10 == 0, 0).otherwise(1).cast("bigint").alias("sar_den"),
        _pick(F.col("p_partkey") % 5, [24, 25, 30, 60, 120]).cast("bigint").alias("fps"),
    )


def f_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe documents, one JSON text per film, some with a field off or missing."""
    k = F.col("o_orderkey")
    video = F.concat(
        F.lit('{"index":0,"codec_type":"video","codec_name":"'),
        F.when(k % 13 == 0, "hevc").otherwise("h264"),
        F.lit('","profile":"High","level":40,"pix_fmt":"'),
        F.when(k % 17 == 3, "yuv444p").otherwise("yuv420p"),
        F.lit('","color_range":"tv","color_space":"bt709","color_primaries":"bt709","width":1920,"height":1080'),
        F.when(k % 5 == 0, "").otherwise(',"color_transfer":"bt709"'),
        F.when(k % 4 == 0, ',"sample_aspect_ratio":"0:1"').when(k % 4 == 1, ',"sample_aspect_ratio":"1:1"')
        .when(k % 4 == 2, ',"sample_aspect_ratio":"4:3"').otherwise(""),
        F.lit(',"r_frame_rate":"30/1","time_base":"1/90000","duration":"'),
        F.when(k % 19 == 0, "N/A").otherwise(F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(".5"))),
        F.lit('","nb_frames":"'), F.floor(F.col("o_totalprice") / 100).cast("string"), F.lit('"}'),
    )
    audio = F.concat(
        F.lit('{"index":1,"codec_type":"audio","codec_name":"aac","profile":"LC","sample_fmt":"fltp","sample_rate":"'),
        F.when(k % 11 == 0, "44100").otherwise("48000"),
        F.lit('","channels":2,"channel_layout":"stereo","time_base":"1/48000"}'),
    )
    both = (
        F.when(k % 23 == 0, video).when(k % 29 == 0, F.concat(audio, F.lit(","), video))
        .otherwise(F.concat(video, F.lit(","), audio))
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("film_id"),
        F.concat(
            F.lit('{"streams":['), both,
            F.lit('],"format":{"format_name":"mov,mp4,m4a,3gp,3g2,mj2","duration":"'),
            F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit('.25"}}'),
        ).alias("document"),
    )


def f_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info")
    k = F.regexp_extract("props", r'"k": (\d+)', 1)
    message = (
        F.when(e % 5 == 0, F.concat(F.lit("sent API_KEY="), k, F.lit(" to the service")))
        .when(e % 5 == 1, F.concat(F.lit("=SUM(A"), k, F.lit(")")))
        .when(e % 5 == 2, F.concat(F.lit("-"), k))
        .when(e % 5 == 3, F.concat(F.lit("wrote \"scene "), k, F.lit('", then\nmoved on')))
        .otherwise(F.concat(F.lit("token "), F.repeat(F.lit("Ab3"), 11), k, F.lit(" used")))
    )
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return spread(events, "event_id").select(
        e, F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("run_id"), level.alias("level"),
        F.col("event_type").alias("scope"), message.alias("message"), k.alias("k"), "value",
    )


def f_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a blank line put in after every third line."""
    lines = F.split("text", "\n")
    spaced = F.transform(lines, lambda line, i: F.when(i % 3 == 2, F.concat(line, F.lit("\n"))).otherwise(line))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(spaced, "\n").alias("chapter"))


def f_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters whose words ``the``, ``la`` and ``die`` open or close a quotation."""
    marked = F.regexp_replace("chapter", r" (the|la|die) ", " “$1 ")
    return f_chapter(spark, sf_dir).select("doc_id", F.regexp_replace(marked, r" (of|de|und)([ ,.])", " $1”$2").alias("chapter"))


def f_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents moved into several scripts letter by letter."""
    kind = F.col("doc_id") % 6
    body = (
        F.when(kind == 1, F.translate("text", "aeiou", "अइउएओ"))
        .when(kind == 2, F.translate("text", "aeiou", "αειου"))
        .when(kind == 3, F.translate("text", "aeiou", "漢字かなカ"))
        .when(kind == 4, F.translate("text", "aeiou", "漢字語文本"))
        .when(kind == 5, F.translate("text", "aeiour", "аеиоур"))
        .otherwise(F.col("text"))
    )
    voices = ["hi-IN-MadhurNeural", "en-US-AvaNeural", "ja-JP-KeitaNeural", "el-GR-NestorasNeural", "zh-CN-YunxiNeural"]
    # Letter by letter is slow work for one file's single task.
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", body.alias("line"), _pick(F.col("doc_id") % 5, voices).alias("voice")
    )


def f_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One caption per scene with its length in seconds and its theme."""
    themes = ["classic", "boxed", "band", "card", "punch", "minimal", "recap", "bold", "glow", "pill"]
    c, s = F.col("project_id"), F.col("scene")
    return f_scene(spark, sf_dir).select(
        c.alias("film_id"), "scene", F.col("line").alias("text"),
        (F.length("line") / F.lit(16.0) + (c + s) % 5).alias("seconds"),
        _pick((c + s) % 10, themes).alias("theme"),
    )


def f_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw settings of one project per customer, some of them unusable."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("project_id"),
        _pick(k % 4, [None, " film.mp4 ", "", "a/b.mp4"]).alias("output"),
        _pick(k % 7, [None, "16:9", "Portrait", "1X1", "reels", "cinema", " "]).alias("aspect"),
        _pick(k % 9, [None, "4k", "1080P", "huge", None, "hd", None, "2K", None]).alias("resolution"),
        F.when(k % 6 == 1, 720).when(k % 6 == 2, 721).when(k % 6 == 3, 1090).when(k % 30 == 4, 0)
        .when(k % 30 == 5, 9000).cast("bigint").alias("short_edge"),
        F.when(k % 5 == 1, 24).when(k % 25 == 2, 0).when(k % 25 == 3, 240).cast("bigint").alias("fps"),
        _pick(k % 3, [None, "scenes.csv", "  "]).alias("manifest"),
        _pick(k % 8, [None, None, "edge", " other ", None, "", None, "edge"]).alias("provider"),
        _pick(k % 5, [None, "en-GB-RyanNeural", " ", "default", None]).alias("voice"),
        F.when(k % 10 == 1, 11.0).when(k % 10 == 2, -1.0).when(k % 10 == 3, 0.5).alias("trim_head"),
        F.when(k % 12 == 1, 10.5).when(k % 12 == 2, 10.0).alias("trim_tail"),
        _pick(k % 3, [None, "slow", " "]).alias("preset"),
        F.when(k % 8 == 1, 52).when(k % 8 == 2, 51).when(k % 8 == 3, 0).cast("bigint").alias("crf"),
        F.when(k % 9 == 1, 0.0).when(k % 9 == 2, 3600.0).when(k % 9 == 3, 3600.5).when(k % 9 == 4, 2.5).alias("duration"),
        F.when(k % 11 == 1, 0.01).when(k % 11 == 2, 0.5).when(k % 11 == 3, 0.75).when(k % 11 == 4, 0.2).alias("zoom_amount"),
        F.when(k % 3 == 1, True).when(k % 3 == 2, False).alias("subtitles"),
        _pick(k % 6, [None, "Glow", "neon", "boxed", None, " "]).alias("theme"),
        _pick(k % 5, [None, "top", "Bottom", "left", None]).alias("position"),
        _pick(k % 4, [None, "v2", "V1", "v3"]).alias("motion_seed"),
    )


def f_voice_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of fixed-width voice tables, one table per nation, from the suppliers."""
    s = F.col("s_suppkey")
    locale = _pick(s % 6, ["en-GB", "hi-IN", "zh-CN-liaoning", "sr-Latn-RS", "es-419", "x"])
    name = F.concat(locale, F.lit("-"), F.regexp_replace("s_name", "[#]", ""), F.lit("Neural"))
    named = F.when(s % 9 == 4, F.concat(F.lit("two words "), s.cast("string"))).otherwise(name)
    gender = F.when(s % 2 == 0, "Female").otherwise("Male")
    line = F.concat(
        named, F.lit("   "), gender, F.lit("    "), F.lit("General"),
        F.when(s % 3 == 0, "      Friendly, Positive").when(s % 3 == 1, "   Calm   Warm").otherwise(""),
    )
    body = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("table_id"), (s + 10).alias("line_no"), line.alias("line")
    )
    heads = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("table_id"),
        F.explode(F.array(
            F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit("Name   Gender   ContentCategories   VoicePersonalities").alias("line")),
            F.struct(F.lit(2).cast("bigint").alias("line_no"), F.lit("-----  ------  -----  -----").alias("line")),
        )).alias("h"),
    ).select("table_id", "h.line_no", "h.line")
    return heads.unionByName(body)


def f_tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of audio analysis logs: every event is a silence edge in its run's log."""
    hundredths = F.expr("unix_micros(cast(ts as timestamp)) div 10000 - 170406720000")
    at = F.concat_ws(".", F.expr("h div 100").cast("string"), F.lpad((F.col("h") % 100).cast("string"), 2, "0"))
    kind = F.col("event_type")
    line = (
        F.when(kind.isin("error", "view"), F.concat(F.lit("[silencedetect @ 0x1] silence_start: "), at))
        .when(kind.isin("click", "purchase"), F.concat(F.lit("[silencedetect @ 0x1] silence_end: "), at, F.lit(" | silence_duration: 0.5")))
        .otherwise(F.concat(F.lit('"input_i" : "-'), F.floor("value").cast("string"), F.lit('.25",')))
    )
    return table(spark, sf_dir, "events").withColumn("h", hundredths).select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("line_no"), line.alias("line")
    )
