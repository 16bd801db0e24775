"""Importing chapters: caps as problem rows, whole or not at all, once under one batch id."""

from pyspark.sql import functions as F

from sceneframe.sources import imports

PIECES = "project_id long, piece int, text string"


def _taken(spark, rows=()):
    return spark.createDataFrame(list(rows), "project_id long, next_scene long")


def _manifests(spark, ids=()):
    return spark.createDataFrame([(i,) for i in ids], "project_id long")


def test_chapters_are_measured_before_they_are_read(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf One.\n\nTwo. ")
    (tmp_path / "b.TXT").write_bytes(b"x" * 101)
    (tmp_path / "c.md").write_bytes(b"bad \xff")
    (tmp_path / "d.pdf").write_bytes(b"no chapter")
    found = {r["path"].rsplit("/", 1)[1]: (r["chapter"], r["problem"]) for r in imports.read_chapters(spark, str(tmp_path), cap=100).collect()}
    assert found == {"a.txt": (" One.\n\nTwo. ", None), "b.TXT": (None, "too_large"), "c.md": (None, "not_utf8")}


def test_an_import_is_whole_or_not_at_all(spark):
    rows = [(1, 0, " a  b "), (1, 1, "  "), (1, 2, "c"), (2, 0, "fine"), (2, 1, "x" * 11), (2, 2, "y" * 12), (3, 0, "led"), (4, 0, " "), (4, 1, None), (5, 0, "new")]
    plan = imports.import_plan(spark.createDataFrame(rows, PIECES), _taken(spark, [(1, 9), (9, 4)]), _manifests(spark, [3, 3]), max_bytes=10)
    got = sorted(((r["project_id"], r["piece"], r["scene_id"], r["text"], r["problem"]) for r in plan.collect()), key=str)
    assert got == [
        (1, 0, "009", "a b", None), (1, 2, "010", "c", None), (2, 1, None, None, "too_long"), (3, None, None, None, "manifest_project"),
        (4, None, None, None, "empty"), (5, 0, "001", "new", None),
    ]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    store = imports.ImportStore(spark, str(tmp_path / "store"))
    pieces = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "x" * 300_000)], PIECES)
    for _ in range(3):
        refused = store.append("one", pieces, _taken(spark, [(1, 5)]), _manifests(spark)).collect()
        assert [tuple(r) for r in refused] == [(2, 0, "too_long")]
    store.append("two", pieces.filter("project_id = 1"), _taken(spark, [(1, 5)]), _manifests(spark))
    store.append("one", pieces, _taken(spark, [(1, 5)]), _manifests(spark))
    assert store.log() == ["one", "two"]
    assert sorted((r["scene_id"], r["text"]) for r in store.scenes().collect()) == [("005", "a"), ("006", "b"), ("007", "a"), ("008", "b")]


def test_two_writers_neither_repeat_nor_skip_a_number(spark, tmp_path):
    """A second writer commits while the first has planned but not yet taken its place in the log."""
    store = imports.ImportStore(spark, str(tmp_path / "store"))
    pieces = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], PIECES)
    take, raced = store._take, []

    def late(number, batch_id):
        if not raced:
            raced.append(True)
            imports.ImportStore(spark, str(tmp_path / "store")).append("other", pieces.withColumn("text", F.upper("text")), _taken(spark), _manifests(spark))
        return take(number, batch_id)

    store._take = late
    store.append("mine", pieces, _taken(spark), _manifests(spark))
    assert store.log() == ["other", "mine"]
    assert sorted((r["scene_id"], r["text"]) for r in store.scenes().collect()) == [("001", "A"), ("002", "B"), ("003", "a"), ("004", "b")]


def test_a_writer_that_died_half_way_counts_for_nothing(spark, tmp_path):
    store = imports.ImportStore(spark, str(tmp_path / "store"))
    pieces = spark.createDataFrame([(1, 0, "a")], PIECES)
    store._take = lambda number, batch_id: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        store.append("one", pieces, _taken(spark), _manifests(spark))
    except RuntimeError:
        pass
    again = imports.ImportStore(spark, str(tmp_path / "store"))
    assert again.scenes().count() == 0
    again.append("one", pieces, _taken(spark), _manifests(spark))
    assert [r["scene_id"] for r in again.scenes().collect()] == ["001"]


def test_a_place_taken_and_never_signed_stops_the_next_writer(spark, tmp_path):
    import pytest

    (tmp_path / "store" / "log").mkdir(parents=True)
    (tmp_path / "store" / "log" / "000000000000").write_bytes(b"")
    store = imports.ImportStore(spark, str(tmp_path / "store"))
    store.PATIENCE_SECONDS = 1
    with pytest.raises(RuntimeError, match="never signed"):
        store.append("one", spark.createDataFrame([(1, 0, "a")], PIECES), _taken(spark), _manifests(spark))
