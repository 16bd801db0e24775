"""The pipeline from end to end on hostile, copied and empty input."""

import corpus_pipeline
import pytest

WORDS = [f"word{i}" for i in range(300)]


def _folder(spark, tmp_path, rows, labels=()):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def rows():
    near = WORDS[:100]
    return [
        (1, " ".join(near), "a"), (2, " ".join(near), "a"), (None, " ".join(near), "b"), (3, " ".join(near[:-1] + ["changed"]), "a"), (None, " ".join(["first"] + near[1:]), None),
        (4, None, "a"), (5, "", "b"), (6, " \n", None), (7, "x" * 9000, "c"), (7, "another text under the same id", "c"), (8, " ".join(WORDS * 30), None), (9, "short", "a"), (9, "short", "a"),
        (None, None, None),
    ]


def test_every_stage_takes_what_the_one_before_kept(spark, tmp_path, rows):
    sf = _folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{number}")
        stage(spark, kept[-1], sf).write.parquet(path)
        kept.append(spark.read.parquet(path))
    good, exact, near, mixed, packed = kept[1:]
    for table in (good, exact, near, mixed):
        assert table.columns == docs.columns
    # Without labels nothing is rejected.
    assert good.count() == len(rows)
    assert sorted(r.text or "" for r in exact.collect()) == sorted({t or "" for _, t, _ in rows})
    texts = [r.text for r in near.collect()]
    group = [t for t in texts if t and len(t.split()) == 100]
    assert len(group) == 1 and len(texts) == exact.count() - 2
    assert {r.text for r in mixed.collect()} <= set(texts)
    pieces = packed.collect()
    assert max(r.length for r in pieces) <= 4096
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert sum(r.piece == 0 for r in pieces) == mixed.count()


def test_empty_input(spark, tmp_path, rows):
    sf = _folder(spark, tmp_path, rows[:1])
    (tmp_path / "none").mkdir()
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
