"""Column functions over file names, stems, numbers and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneframe.constants import AUDIO_EXTENSIONS, IMAGE_EXTENSIONS, MIN_NUMBER_WIDTH, TEXT_EXTENSIONS
from sceneframe.functions.text import SPACES

_LARGEST_U128 = "340282366920938463463374607431768211455"


def file_name(path: Column) -> Column:
    """Last segment, either slash direction."""
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def _dotted(name: Column) -> Column:
    """Whether there is an extension: a dot past the first character."""
    return F.instr(F.substring(name, 2, 2**31 - 1), ".") > 0


def stem(name: Column) -> Column:
    """Name without its last extension; a leading dot is part of the stem."""
    tail = F.length(F.substring_index(name, ".", -1))
    return F.when(_dotted(name), F.left(name, F.length(name) - tail - 1)).otherwise(name)


def extension(name: Column) -> Column:
    """Text after the last dot, null when there is none past the first character."""
    return F.when(_dotted(name), F.substring_index(name, ".", -1))


def asset_kind(ext: Column) -> Column:
    low = F.lower(ext)
    return (
        F.when(low.isin(IMAGE_EXTENSIONS), "image")
        .when(low.isin(AUDIO_EXTENSIONS), "audio")
        .when(low.isin(TEXT_EXTENSIONS), "text")
    )


def manifest_stem(cell: Column) -> Column:
    """Stem of a path written in a manifest cell, trimmed; null when nothing is left."""
    bare = F.trim(stem(file_name(cell)))
    return F.when(bare != "", bare)


def scene_number(stem_: Column) -> Column:
    """The stem as a scene number, null unless it is all digits."""
    return F.when(stem_.rlike(r"\A[0-9]+\z"), stem_.try_cast("bigint"))


def natural_key(text: Column) -> Column:
    """A string that sorts the way a person numbers files.

    Digit runs become a fixed-width number ahead of any text; text is lower-cased and closed
    by NUL, which no file name can hold, so a shorter run sorts before a longer one.
    """
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        padded = F.lpad(digits, 39, "0")
        fits = run.rlike("^[0-9]") & (F.length(digits) <= 39) & (padded <= _LARGEST_U128)
        return F.when(fits, F.concat(F.lit("0"), padded)).otherwise(F.concat(F.lit("1"), run, F.lit("\u0000")))

    # Most names are words and then a number, either of them perhaps missing: no runs to walk.
    words = F.rtrim(low, F.lit("0123456789"))
    digits = F.substring(low, F.length(words) + 1, F.lit(39))
    plain = F.concat(
        F.when(words != "", F.concat(F.lit("1"), words, F.lit("\u0000"))).otherwise(""),
        F.when(digits != "", F.concat(F.lit("0"), F.lpad(digits, 39, "0"))).otherwise(""),
    )
    return F.when(low.rlike(r"\A[^0-9]*[0-9]{0,38}\z"), plain).otherwise(F.array_join(F.transform(runs, part), ""))


def numbered_stem(number: Column, width: Column) -> Column:
    """Zero-padded to ``width``, never cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))


def number_width(count: Column) -> Column:
    return F.greatest(F.lit(MIN_NUMBER_WIDTH), F.length(count.cast("string")))


def scene_id_problem(identifier: Column) -> Column:
    """Why a scene id cannot be used, null when it can."""
    bare = F.regexp_replace(identifier, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return (
        F.when(bare == "", "blank")
        .when(bare.rlike(r"[/\\]"), "path_separator")
        .when(bare.isin(".", ".."), "relative_directory")
        .when(bare.rlike(r"[\x00-\x1F\x7F-\x9F]"), "control_character")
    )


def owned_kind(name: Column) -> Column:
    """Which of the engine's own file shapes a name has, null for a stranger's file."""
    # Sixteen digits, or the whole digest that ``cache.content_key`` gives.
    key = "[0-9a-fA-F]{16}([0-9a-fA-F]{48})?"
    return (
        F.when(name.rlike(r"(?s)^\..*\.partial-"), "partial")
        .when(name.rlike(rf"^seg-([0-9]{{4}}-)?{key}\.mp4\z"), "segment")
        .when(name.rlike(rf"^[a-z]+-{key}\.wav\z") & ~name.startswith("spoken-"), "audio")
    )


def safe_list_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9_.-]*\z")


def lexical_path(path: Column) -> Column:
    """Segments with ``.`` and ``..`` worked out, as ``/a/b``; null when it climbs past the top."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        up, empty = s == "..", F.size(acc["kept"]) == 0
        kept = (
            F.when(up & empty, acc["kept"])
            .when(up, F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0))))
            .otherwise(F.concat(acc["kept"], F.array(s)))
        )
        return F.struct(kept.alias("kept"), (acc["out"] | (up & empty)).alias("out"))

    walked = F.aggregate(
        parts, start, step,
        lambda acc: F.when(~acc["out"], F.concat(F.lit("/"), F.array_join(acc["kept"], "/"))),
    )
    # Most paths hold nothing to work out; no segment of these is empty or begins with a dot.
    plain = ~(path.contains("//") | path.contains("/.") | path.startswith(".") | path.endswith("/") | (path == ""))
    # Without ".." nothing climbs: empty segments and "." are dropped where they stand.
    dropped = F.regexp_replace(F.concat(F.lit("/"), path), r"/\.?(?=/|\z)", "")
    level = F.when(dropped == "", "/").otherwise(dropped)
    return (
        F.when(plain & path.startswith("/"), path).when(plain, F.concat(F.lit("/"), path))
        .when(~path.contains(".."), level).otherwise(walked)
    )


def contained_path(root: Column, requested: Column) -> Column:
    """``inside``, ``outside`` or ``empty`` for a requested path under a root."""
    joined = F.when(requested.startswith("/"), requested).otherwise(F.concat(root, F.lit("/"), requested))
    # A struct binds the two worked-out paths so that neither is computed twice.
    both = F.struct(lexical_path(joined).alias("real"), lexical_path(root).alias("base"))
    verdict = F.transform(
        F.array(both),
        lambda p: F.when(
            p["real"].isNotNull()
            & ((p["real"] == p["base"]) | F.startswith(p["real"], F.concat(p["base"], F.lit("/")))),
            "inside",
        ).otherwise("outside"),
    )[0]
    return F.when(requested == "", "empty").otherwise(verdict)


def any_contains(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])
