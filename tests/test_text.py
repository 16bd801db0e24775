"""Text and timing rules against small plain-Python twins."""

import random
import re

from pyspark.sql import functions as F

from sceneframe import constants as C
from sceneframe.functions import captions as K
from sceneframe.functions import naming as N
from sceneframe.functions import redact as R
from sceneframe.functions import text as T
from sceneframe.functions import timing
from sceneframe.operators import captions, chapters

CLOSERS = "\"'”)]»’"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_reference_duration_in_frames(spark):
    assert one(spark, timing.frames_for(F.lit(3.717), F.lit(30))) == 112
    assert one(spark, timing.frames_for(F.lit(0.0), F.lit(30))) == 1
    assert one(spark, timing.frames_for(F.lit(float("nan")), F.lit(30))) == 1


def test_sentences_know_titles_and_initials(spark):
    said = 'Mr. Chen met J. R. Smith. "Go!" she said (twice.) Then etc. ended… Fine'
    assert one(spark, T.sentences(F.lit(said))) == ["Mr. Chen met J. R. Smith.", '"Go!"', "she said (twice.)", "Then etc. ended…", "Fine"]


def test_paragraphs_drop_marks_and_collapse(spark):
    text = "\n one  two\nthree \n\n***\n \t\n四. \n\n"
    assert one(spark, T.paragraphs(F.lit(text))) == ["one two three", "四."]


def test_secrets_do_not_hide_behind_other_line_ends(spark):
    for end in ("\r", "\x85", "\u2028", "\u2029", "\x0b", "\x0c"):
        for text in (f"frame 10{end}password=hunter2 x", f"password=hunter2{end}next hunter2"):
            assert "hunter2" not in one(spark, R.redact(F.lit(text))), repr(text)
    assert one(spark, R.redact(F.lit("password=hunter2\nplain"))).endswith("\nplain")


def test_names_that_end_in_a_newline_are_not_safe(spark):
    assert one(spark, N.scene_number(F.lit("001\n"))) is None and one(spark, N.scene_number(F.lit("001"))) == 1
    assert not one(spark, N.safe_list_name(F.lit("a.mp4\n"))) and one(spark, N.safe_list_name(F.lit("a.mp4")))
    assert one(spark, N.owned_kind(F.lit("seg-0001-0123456789abcdef.mp4\n"))) is None


def test_natural_order(spark):
    names = ["scene10", "Scene2", "001", "intro", "1b", "scene2b", "9" * 45, "a1b2", "a1b10"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(N.natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in rows] == ["001", "1b", "9" * 45, "a1b2", "a1b10", "intro", "Scene2", "scene2b", "scene10"]


def test_names_with_one_number_at_the_end_sort_as_those_that_are_walked(spark):
    numbers = ["", "0", "007", "9" * 38, "9" * 39, "9" * 40, "0" * 60, "340282366920938463463374607431768211455"]
    names = [words + n for words in ("", "Take-", "\u0130 ", "a1b", "\n") for n in numbers]

    def key(name: str) -> str:
        out = ""
        for run in re.findall("[0-9]+|[^0-9]+", name.replace("\u0130", "i\u0307").lower()):
            small = run.isdigit() and int(run) < 2**128
            out += f"0{int(run):039d}" if small else f"1{run}\0"
        return out

    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", N.natural_key(F.col("n")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in rows} == {n: key(n) for n in names}


def test_stems_and_extensions(spark):
    rows = [("a/b\\001.JPG", "001", "JPG"), (".hidden", ".hidden", None), ("x.tar.gz", "x.tar", "gz"), ("bare", "bare", None), ("end.", "end", "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string").withColumn("n", N.file_name(F.col("p")))
    got = df.select("p", N.stem(F.col("n")).alias("s"), N.extension(F.col("n")).alias("e")).collect()
    assert [tuple(r) for r in got] == rows


def test_paths_are_contained(spark):
    cases = {"a/b.jpg": "inside", "../x": "outside", "/media/p/x": "inside", "/media/px": "outside", "": "empty", "a/../../p/z": "inside", "..": "outside", ".": "inside"}
    df = spark.createDataFrame([(k,) for k in cases], "r string").withColumn("v", N.contained_path(F.lit("/media/p"), F.col("r")))
    assert {r["r"]: r["v"] for r in df.collect()} == cases


def test_redaction(spark):
    token = "A" * 40
    text = f"ok\nAPI_KEY: abc def\nsent Bearer abc\nx {token}, y ({token}) /p/{token}\n"
    assert one(spark, R.redact(F.lit(text))) == f"ok\nAPI_KEY:[redacted]\nsent Bearer [redacted]\nx [redacted] y [redacted] /p/{token}\n"
    got = one(spark, R.redact_fields(F.create_map(F.lit("my_token"), F.lit("1"), F.lit("k"), F.lit("v"))))
    assert got == {"my_token": "[redacted]", "k": "v"}


def test_formulas_are_defused_and_numbers_are_not(spark):
    cases = {"=1+1": "'=1+1", "-5": "-5", "-5d": "'-5d", "+1e3": "+1e3", "@x": "'@x", "plain": "plain", "-inf": "-inf"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").withColumn("d", R.defuse(F.col("v")))
    assert {r["v"]: r["d"] for r in df.collect()} == cases


# --- plain twins -------------------------------------------------------------
def ends(word):
    return word.rstrip(CLOSERS).endswith((".", "!", "?", "…"))


def pack(words, budget):
    pieces, current = [], ""
    for word in words:
        if current and len(current) + 1 + len(word) > budget:
            pieces.append(current)
            current = ""
        current = f"{current} {word}" if current else word
        if ends(word) and len(current) * 2 >= budget:
            pieces.append(current)
            current = ""
    return pieces + [current] if current else pieces


def carry(pieces):
    pieces = list(pieces)
    for i in range(len(pieces) - 1):
        if " " not in pieces[i]:
            continue
        head, last = pieces[i].rsplit(" ", 1)
        if re.sub(r"^\W+|\W+$", "", last).lower() in C.WEAK_ENDINGS and last[-1] not in ",;:.!?":
            pieces[i], pieces[i + 1] = head, f"{last} {pieces[i + 1]}"
    return pieces


def cues(text, seconds, budget):
    words = text.split()
    allowed = min(max(int(seconds / 0.9 // 1), 1), 60)
    budget = max(budget, 8)
    pieces = carry(pack(words, budget))
    total = len(" ".join(words))
    for _ in range(8):
        if len(pieces) <= allowed:
            break
        budget = max(budget, -(-total // allowed)) + 1
        pieces = carry(pack(words, budget))
    if len(pieces) > allowed:
        pieces = pieces[: allowed - 1] + [" ".join(pieces[allowed - 1:])]
    while len(pieces) > 1:
        sizes = [len(p) for p in pieces]
        short = min(range(len(pieces)), key=lambda i: sizes[i])
        if not seconds * sizes[short] / sum(sizes) < 0.9 - 1e-9:
            break
        at = short if short + 1 < len(pieces) else short - 1
        pieces[at:at + 2] = [f"{pieces[at]} {pieces[at + 1]}"]
    return pieces


def _random_text(rng, words):
    pool = ["a", "the", "of", "and", "on", "sun", "river", "Mountain", "extraordinarily", "go.", 'stop!"', "wait…)", "if,", "x" * 30, "no?", "to"]
    return " ".join(rng.choice(pool) for _ in range(words))


def test_cues_match_the_plain_twin(spark):
    rng = random.Random(3)
    themes = list(C.THEME_MAX_CHARS)
    rows = [(1, i, _random_text(rng, rng.randrange(1, 160)), rng.choice([0.5, 1.0, 3.0, 8.0, 40.0, 200.0]), rng.choice(themes)) for i in range(250)]
    df = spark.createDataFrame(rows, "film_id long, scene long, text string, seconds double, theme string")
    got = {}
    for r in captions.timed_cues(df).orderBy("scene", "cue").collect():
        got.setdefault(r["scene"], []).append(r)
    for _, scene, text, seconds, theme in rows:
        assert [r["text"] for r in got[scene]] == cues(text, seconds, C.THEME_MAX_CHARS[theme])
        assert got[scene][0]["start_s"] == 0 and got[scene][-1]["end_s"] == seconds
        assert all(a["end_s"] == b["start_s"] for a, b in zip(got[scene], got[scene][1:]))


def test_a_very_long_word_and_a_very_long_line(spark):
    long_line = "word " * 40_000
    rows = [(1, 1, "y" * 5000, 10.0, "pill"), (1, 2, long_line, 3600.0, "classic")]
    df = spark.createDataFrame(rows, "film_id long, scene long, text string, seconds double, theme string")
    got = captions.timed_cues(df).groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c")).collect()
    assert {r["scene"]: r["n"] for r in got}[1] == 1
    assert max(r["n"] for r in got) <= 60


def test_pieces_lose_no_word(spark):
    rng = random.Random(5)
    rows = [(i, "\n\n".join(_random_text(rng, rng.randrange(1, 80)) for _ in range(4))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, chapter string")
    for cut in (chapters.cut_sentences(df, 3), chapters.cut_time(df)):
        got = {}
        for r in cut.orderBy("doc_id", "piece").collect():
            got.setdefault(r["doc_id"], []).append(r["text"])
        for doc, text in rows:
            assert " ".join(got[doc]).split() == text.split()


def test_time_pieces_are_as_long_as_they_can_be(spark):
    df = spark.createDataFrame([(1, "One two. " * 30 + "x" * 100 + ". End.")], "doc_id long, chapter string")
    lengths = [r["chars"] for r in chapters.cut_time(df).orderBy("piece").collect()]
    assert lengths[:-2] == [80, 80, 80, 26] and lengths[-2:] == [101, 4]


def test_pack_counts_characters_not_bytes(spark):
    assert one(spark, K.pack(F.lit("नमस्ते दुनिया आज"), F.lit(13).cast("bigint"))) == ["नमस्ते दुनिया", "आज"]


def test_any_number_of_closing_marks_is_looked_past(spark):
    for marks in (1, 59, 60, 61, 70):
        text = "go." + '"' * marks + " then we walk on along the river to the mountain and go home again today."
        budget = 80
        got = spark.createDataFrame([(text, budget)], "t string, b int").select(K.pack(F.col("t"), F.col("b")).alias("p")).first().p
        pieces, rest = [], text
        while rest:
            cuts = [m.start() for m in re.finditer(" |$", rest) if m.start() <= budget] or [rest.find(" ") if " " in rest else len(rest)]
            ended = [c for c in cuts if c >= (budget + 1) // 2 and re.search(rf"[.!?…][{re.escape(CLOSERS)}]*$", rest[:c])]
            cut = ended[0] if ended else cuts[-1]
            pieces.append(rest[:cut])
            rest = rest[cut + 1:]
        assert [p for p in got if p] == pieces
