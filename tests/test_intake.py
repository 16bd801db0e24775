"""The intake over several batches."""

from checks import relations as R
from sceneframe.operators import pairing
from sceneframe.streaming import intake
from sceneframe.streaming import sinks as batches


def test_an_intake_keeps_its_catalog_in_a_table(spark):
    """Projects come in several batches; only the last has all their files."""
    folder = batches.new_folder(spark, "test")
    files = R.f_asset(spark, "/root/testdata/sf0.001").filter("project_id < 90")
    for i in range(3):
        files.filter(f"file_no % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = sorted(map(tuple, intake.intake(stream, folder).collect()), key=repr)
    landed = spark.read.parquet(f"{folder}/in")
    assert got == sorted(map(tuple, pairing.intake_summary(landed, landed).collect()), key=repr)
    assert batches.written_batches(spark, folder, "catalog") == [0, 1, 2]
    # No state store is asked for a row.
    assert not spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/state").getFileSystem(spark._jsc.hadoopConfiguration()).exists(
        spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/state"))


def _shuffled_rows(spark, after: int) -> tuple[int, int]:
    """Rows written to shuffles by the stages that came after one, and the last stage."""
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    found = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in found if s.stageId() > after), max((s.stageId() for s in found), default=-1)


def test_a_batch_shuffles_its_files_twice_and_the_pairing_none(spark):
    """Once to their buckets and once, with the earlier files of their projects, by project."""
    folder = batches.new_folder(spark, "test")
    files = R.f_asset(spark, "/root/testdata/sf0.001")
    for i in range(2):
        files.filter(f"file_no % 2 = {i}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    landed = spark.read.parquet(f"{folder}/in")
    total, first = landed.count(), max(landed.filter(f"file_no % 2 = {i}").count() for i in range(2))
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    _, last = _shuffled_rows(spark, -1)
    told = intake.intake(stream, folder)
    rows, _ = _shuffled_rows(spark, last)
    # Beside the files only the buckets of a batch, some for each of its tasks.
    assert total <= rows <= total + first + total + 2 * 2 * intake.BUCKETS * 8
    assert told.count() == landed.select("project_id").distinct().count()


def test_pairing_does_not_shuffle_files_that_lie_by_project(spark):
    folder = batches.new_folder(spark, "test")
    R.f_asset(spark, "/root/testdata/sf0.001").write.parquet(f"{folder}/files")
    kept = spark.read.parquet(f"{folder}/files").repartition(3, "project_id").persist()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        kept.count()
        # As large tables are joined.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = pairing.intake_summary(kept, kept)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        kept.unpersist()


def test_files_that_wait_are_met_by_project_and_stem(spark):
    """Project 2 is given nothing; files without a project wait for no still."""
    fields = "project_id bigint, file_no bigint, name string, stem string, ext string"

    def files(*rows):
        return spark.createDataFrame([(p, n, name, *name.split(".")) for p, n, name in rows], fields)

    existing = files((1, 1, "001.wav"), (1, 2, "003.txt"), (2, 1, "001.wav"), (None, 1, "001.wav"), (4, 1, "007.jpg"), (4, 2, "008.md"), (4, 3, "001.md"))
    incoming = files((1, 11, "a.jpg"), (1, 12, "b.jpg"), (1, 13, "c.jpg"), (3, 1, "x.pdf"), (None, 2, "a.jpg"), (4, 9, "z.png"), (4, 10, "y.png"), (4, 11, "y.wav"))
    got = {r["project_id"]: tuple(r)[1:] for r in pairing.intake_summary(existing, incoming).collect()}
    # photos, narrations, spoken, captions, filled, silent, orphans, skipped
    assert got == {
        1: (3, 0, 0, 0, 2, 1, 0, 0), 3: (0, 0, 0, 0, 0, 0, 0, 1), None: (1, 0, 0, 0, 0, 1, 0, 0),
        # 008 is y, which has a recording; z is 009, for which nothing waits.
        4: (2, 1, 0, 0, 0, 1, 0, 0),
    }
