"""Stills against output sizes. Stills carry ``project_id, scene_id, position, width, height, sar_num, sar_den``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe import constants as C
from sceneframe.functions import geometry as G


def displayed(stills: DataFrame) -> DataFrame:
    """Add the size on screen."""
    return stills.withColumns({
        "display_w": G.display_width(F.col("width"), F.col("sar_num"), F.col("sar_den")),
        "display_h": F.col("height"),
    })


def undersized(stills: DataFrame, aspect: Column, width: Column, height: Column) -> DataFrame:
    """Per project with a picture smaller than the output: how many, the worst, what fits all.

    One aggregate of fixed-size state; the first scene wins among equally small ones.
    """
    d = displayed(stills)
    native = G.native_short_edge(aspect, F.col("display_w"), F.col("display_h"))
    d = d.withColumns({"native": native, "small": ~((F.col("display_w") >= width) & (F.col("display_h") >= height))})
    rank = F.when(F.col("small"), F.struct("native", "position"))
    return (
        d.groupBy("project_id").agg(
            F.count_if("small").alias("scenes"),
            F.count(F.lit(1)).alias("total"),
            F.min_by("scene_id", rank).alias("smallest"),
            F.min_by("display_w", rank).alias("width"),
            F.min_by("display_h", rank).alias("height"),
            F.min("native").alias("_native"),
        )
        .filter("scenes > 0")
        .select("project_id", "scenes", "total", "smallest", "width", "height",
                F.when(F.col("_native") > 0, F.col("_native")).alias("native_short_edge"))
    )


def levels(stills: DataFrame) -> DataFrame:
    """The level a film of each picture's size and rate would need. Takes ``fps``."""
    return stills.withColumn("level", G.h264_level(F.col("width"), F.col("height"), F.col("fps")))


def sizes() -> Column:
    """The twelve output sizes on offer, as an array of structs."""
    offered = []
    for aspect in C.ASPECT_WORDS:
        for edge in C.SIZE_WORDS:
            long = edge if aspect == "1:1" else edge // 9 * 16
            w, h = (long, edge) if aspect == "16:9" else (edge, long)
            offered.append(F.struct(
                F.lit(aspect).alias("aspect"), F.lit(f"{edge}p").alias("size"),
                F.lit(w).cast("bigint").alias("out_w"), F.lit(h).cast("bigint").alias("out_h"),
            ))
    return F.array(*offered)


def size_fit(stills: DataFrame) -> DataFrame:
    """How many stills of each project fill each of the twelve sizes.

    Counted by one aggregate with a column per size and turned into rows afterwards, so no
    still is multiplied before the shuffle.
    """
    fills = []
    for i in range(len(C.ASPECT_WORDS) * len(C.SIZE_WORDS)):
        size = sizes()[i]
        fills.append(F.count_if((F.col("display_w") >= size["out_w"]) & (F.col("display_h") >= size["out_h"])).alias(f"n{i}"))
    counted = displayed(stills).groupBy("project_id").agg(F.count(F.lit(1)).alias("stills"), *fills)
    held = F.array(*[F.col(f"n{i}") for i in range(len(fills))])
    return (
        counted.select("project_id", "stills", F.explode(F.arrays_zip(sizes().alias("size"), held.alias("fills"))).alias("z"))
        .select("project_id", "stills", "z.size.aspect", "z.size.size", "z.size.out_w", "z.size.out_h", "z.fills")
    )


def seeded_motion(scenes: DataFrame, version: str = "v1") -> DataFrame:
    """Move, anchor and amount of every scene from a hash of what it shows.

    Takes ``project_id, position, occurrence, content``. Under v1 the seed depends on the
    scene's place, under v2 on how many earlier scenes show the same picture, so a reordered
    film keeps its moves.
    """
    place = F.col("position") if version == "v1" else F.col("occurrence")
    digest = F.sha2(F.concat_ws("|", F.lit(version), F.col("project_id").cast("string"), place.cast("string"), "content"), 256)
    # Fifteen hexadecimal digits are the most a signed 64-bit number always holds.
    seed = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    anchors = F.array(*[F.lit(a) for a in C.ANCHOR_WORDS])
    kinds = F.array(*[F.lit(k) for k in C.MOTION_KINDS])
    return scenes.withColumn("seed", seed).withColumns({
        "motion": F.element_at(kinds, F.pmod(F.col("seed"), F.lit(len(C.MOTION_KINDS))).cast("int") + 1),
        "anchor": F.element_at(anchors, F.pmod(F.shiftrightunsigned("seed", 20), F.lit(len(C.ANCHOR_WORDS))).cast("int") + 1),
        "amount": F.lit(0.08) + F.pmod(F.shiftrightunsigned("seed", 40), F.lit(5)) * 0.01,
    })
