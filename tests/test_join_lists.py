"""Join lists in containers, read back by their index."""

from sceneframe.sources import sinks


def test_join_lists_are_cut_out_of_blocks(spark, tmp_path, monkeypatch):
    """Parts of many blocks and containers, some of them across the end of a block."""
    monkeypatch.setattr(sinks, "BLOCK_BYTES", 64)
    lines = spark.range(600).selectExpr("id % 40 AS film_id", "id DIV 40 AS scene", "concat('ü', id, repeat('x', id % 7)) AS line")
    path = str(tmp_path / "some lists")
    sinks.write_join_lists(lines, path, buckets=3, entries=4)
    want = {}
    for r in lines.orderBy("film_id", "scene").collect():
        want[r["film_id"]] = want.get(r["film_id"], "") + r["line"] + "\n"
    read = sinks.read_join_lists(spark, path)
    assert {r["film_id"]: r["text"] for r in read.collect()} == want
    # The containers are listed; no row carries their content.
    scans = [line for line in read._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan binaryFile" in line]
    assert scans and not any("content" in line for line in scans)
    some = sinks.read_join_lists(spark, path, spark.createDataFrame([(3,), (39,)], "film_id long")).collect()
    assert {r["film_id"]: r["text"] for r in some} == {k: want[k] for k in (3, 39)}
