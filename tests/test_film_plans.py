"""Plans of film checks."""

from pyspark.sql import functions as F

from sceneframe.operators import timeline


def test_probes_are_never_broadcast_by_a_film_check(spark):
    totals = spark.range(50).selectExpr("id AS film_id", "30L AS frames")
    probes = spark.range(50).selectExpr("id AS film_id", "31L AS nb_frames", "1.0D AS video_seconds", "1.0D AS container_seconds")
    out = timeline.film_check(totals, probes, F.lit(30).cast("bigint"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 50
