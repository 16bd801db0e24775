"""WARC archives: the round trip, the format, and the reads that are made."""

import glob
import gzip
import hashlib
import io
import tempfile

import pyspark.sql.functions as F
import pytest

from sceneframe.llm import common, warc

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _direct(rows, least=100):
    first = {}
    for key, html in rows:
        data = (html or "").encode()
        if key is not None and len(data) >= least:
            first[data] = min(first.get(data, key), key)
    out = []
    for key, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        revisit = to is not None and key != to
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def strange(spark):
    same, other = "<p>same page</p>" * 20, "é" * 50
    rows = [
        (1, "http://a/1", same), (2, "http://a/2", same), (2, "http://a/2", same), (-3, None, same), (-3, "http://b/", same), (None, "http://c/", same),
        (4, "http://a/\r\nX: y z", ""), (5, None, None), (6, "", ""), (7, "u7", "x" * 99), (8, "u8", "x" * 99), (9, "u9", other), (10, "u10", other),
        (None, None, "n" * 200), (None, "u", "n" * 200), (None, None, None), (11, "u11", "\r\n\r\nWARC/1.1\r\n" * 30), (12, "u12", "long \U0001f600" * 200_000),
    ] + [(100 + i, f"u{i}", "hot " * 50) for i in range(300)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as digest", "1 as n", "'y' as payload", "2 as refers_to").repartition(5)


def test_round_trip_of_the_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    again = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000))
    assert _got(warc.archive_pages(pages)) == _direct(rows)
    assert _got(warc.archive_pages(again)) == _direct(rows + [(k + 1000, h) for k, h in rows])


def test_strange_pages_and_payloads(strange):
    rows = [(r.page_id, r.html) for r in strange.collect()]
    read = warc.archive_pages(strange, payloads=True)
    found = read.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str) == _direct(rows)
    for r in found:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
        else:
            assert r.payload is None
    assert warc.archive_pages(strange.limit(0)).count() == 0


def test_archives_follow_the_format_and_the_index(strange):
    folder = tempfile.mkdtemp(prefix="warc-", dir="/tmp")
    index = warc.write_archives(warc.record_plan(strange), folder, roll_bytes=2000).collect()
    archives = glob.glob(f"{folder}/archives/*.warc.gz")
    assert {r.archive for r in index} == {p[len(folder) + 1 :] for p in archives} and len(archives) > 5
    for path in archives:
        data = open(path, "rb").read()
        own = sorted((r for r in index if path.endswith(r.archive)), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) == len(data)
        stream = io.BytesIO(gzip.decompress(data))  # members one after another are one stream
        for r in own:
            assert stream.readline() == b"WARC/1.1\r\n"
            head = {}
            while (line := stream.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            block = stream.read(int(head["Content-Length"]))
            assert stream.read(4) == b"\r\n\r\n" and head["WARC-Type"] == r.record_type
            assert ("WARC-Target-URI" in head) == (r.url is not None)
            payload = block.partition(b"\r\n\r\n")[2]
            assert r.record_type == "revisit" and not payload or len(payload) == r.payload_bytes
        assert not stream.read()


def test_only_selected_records_are_read(spark, strange):
    folder = tempfile.mkdtemp(prefix="warc-", dir="/tmp")
    index = warc.write_archives(warc.record_plan(strange), folder)
    chosen = index.filter("page_id % 7 = 0")
    expected = sorted(r.page_id for r in chosen.collect())
    for gap, block in ((0, 100), (1 << 20, 1 << 20)):
        assert sorted(r.page_id for r in warc.read_archives(chosen, folder, gap_bytes=gap, block_bytes=block).collect()) == expected
    assert warc.coalesce([(50, 10), (0, 10), (10, 5), (100, 1)], gap_bytes=20) == [(0, 15, [(0, 10), (10, 5)]), (50, 60, [(50, 10)]), (100, 101, [(100, 1)])]
    with pytest.raises(ValueError):
        warc.read_record(warc.write_record(1, "u", "response", None, 3, "0" * 64, b"abc"))


def test_facts_of_hot_and_cold_groups(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('k', id) end as key")
    groups = common.settle(rows.filter("key is not null").groupBy("key").count().selectExpr("key as g", "count as n", "length(key) as fact"))
    found = common.with_group_facts(rows, groups, F.col("key"), "g", F.xxhash64("id"), ["fact"]).collect()
    assert len(found) == 5000 and all(r.fact == (len(r.key) if r.key else None) for r in found)
