"""WARC archives with an index written first; records are read back by coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe.llm.common import in_pieces, record, scratch, settle, slices, text_bytes, with_group_facts

#: Payloads from this size on are written once and revisited by their copies.
LEAST_BYTES = 100
#: An archive that has grown to this size is closed and another one begun.
ROLL_BYTES = 512 << 20
#: Reads of one archive that start within one block of this size are one task's row, and
#: records with no more than the gap between them are one read.
BLOCK_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Bytes of archives that a reading task takes on.
TASK_BYTES = 64 << 20
#: Fixed words of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no capture time; a fixed one keeps archives the same from run to run.
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, archive string, offset bigint, length bigint"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return fs.FileSystem.from_uri(f"file://{folder}")


def payload_groups(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``digest, refers_to, n``: payloads that several rows hold, with the smallest id among them."""
    html = text_bytes(F.col(html_col))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    groups = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 1 and refers_to is not null")


def record_plan(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What is written for every page: id, url, payload, its size and digest, record type and the page it refers to."""
    html = text_bytes(F.col(html_col))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    groups = settle(payload_groups(pages, least_bytes, id_col, html_col))
    digest = F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest"))
    found = with_group_facts(rows, groups, digest, "digest", F.xxhash64("page_id", "url"), ["refers_to"])
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    return found.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to"),
        "payload_bytes", "payload_digest", "payload",
    )


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _uri(url: str) -> str:
    """A url fit for a header line: blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _headers(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields), "", ""]).encode()


def write_record(page_id: int | None, url: str | None, record_type: str, refers_to: int | None, payload_bytes: int, digest: str, payload: bytes, date: str = DATE) -> bytes:
    """One record as its own gzip member. A revisit keeps the response's headers, not its payload."""
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(payload_bytes))])
    block = http if record_type == "revisit" else http + payload
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    if record_type == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(_headers("WARC/1.1", fields) + block + b"\r\n\r\n", 6, mtime=0)


def _split(data: bytes) -> tuple[str, dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}, rest


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", name)
    if not found:
        raise ValueError(f"not a page's record: {name}")
    return int(found[1]) if found[1] else None


def read_record(member: bytes) -> tuple:
    """``(page_id, target_uri, record_type, refers_to, payload_bytes, payload_digest, payload)`` of one gzip member.

    Size and digest of a response are those of the payload that was read, and must be those
    in the headers; a revisit's are those its headers give for the full payload.
    """
    first, fields, rest = _split(zlib.decompress(member, zlib.MAX_WBITS | 16))
    size = int(fields["content-length"])
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('warc-record-id')}")
    _, http, payload = _split(rest[:size])
    told, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
    kind, revisit = fields["warc-type"], fields["warc-type"] == "revisit"
    if not revisit and (len(payload), hashlib.sha256(payload).hexdigest()) != (told, digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is not what its headers say")
    return (
        _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, _page(fields["warc-refers-to"]) if revisit else None,
        told, digest, None if revisit else payload,
    )


def write_archives(plan: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the records of ``plan`` (see `record_plan`) below ``folder``; the index, written there too.

    A row of the index is one record: page, url, type, size, digest, and the archive, offset
    and length where its gzip member lies. Every attempt of a task writes archives of its
    own name, and the index, committed by the engine's own writer, names those of the
    attempts that succeeded; what a lost executor left behind is named nowhere.
    ``folder`` must be one that executors and driver share.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(f"{root}/archives", recursive=True)
        out, name, at = None, None, 0
        try:
            for whole in batches:
                for batch in in_pieces(whole, 6):
                    rows = []
                    for row in zip(*(c.to_pylist() for c in batch.columns)):
                        if out is None or at >= roll_bytes:
                            if out is not None:
                                out.close()
                            name = f"archives/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                            out, at = system.open_output_stream(f"{root}/{name}", compression=None), 0
                        member = write_record(*row)
                        out.write(member)
                        rows.append((*row[:6], name, at, len(member)))
                        at += len(member)
                    if rows:
                        yield record(fields, list(zip(*rows)))
        finally:
            if out is not None:
                out.close()

    plan.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return plan.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def coalesce(ranges: list[tuple[int, int]], gap_bytes: int = GAP_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted ``(offset, length)`` ranges as reads ``(start, stop, ranges)``; neighbours within the gap share a read."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in sorted(ranges):
        if reads and offset - reads[-1][1] <= gap_bytes:
            start, stop, held = reads[-1]
            held.append((offset, length))
            reads[-1] = start, max(stop, offset + length), held
        else:
            reads.append((offset, offset + length, [(offset, length)]))
    return reads


def read_archives(selected: DataFrame, folder: str, payloads: bool = True, block_bytes: int = BLOCK_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that ``selected`` rows of the index name, read back from the archives below ``folder``.

    Selected ranges are grouped by archive and block, sorted and coalesced, so neighbouring
    records are one read and what was not selected is passed over. A block's reads are one
    row of bounded size, whatever the selection. Without ``payloads`` that column is null.
    A record that repeats in ``selected`` is read once for each time. The number of tasks
    follows from the bytes to be read, as the rows that name them are small.
    """
    wanted = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(slices(selected.sparkSession), -(-wanted // TASK_BYTES))
    blocks = selected.groupBy("archive", F.floor(F.col("offset") / block_bytes).alias("block")).agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    fields = [("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for archive, ranges in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                with system.open_input_file(f"{root}/{archive}") as file:
                    for start, stop, held in coalesce([(r["offset"], r["length"]) for r in ranges], gap_bytes):
                        file.seek(start)
                        data, rows, size = file.read(stop - start), [], 0
                        for offset, length in held:
                            found = read_record(data[offset - start : offset - start + length])
                            rows.append(found if payloads else (*found[:6], None))
                            size += found[4] if payloads else 0
                            if size > block_bytes:
                                yield record(fields, list(zip(*rows)))
                                rows, size = [], 0
                        if rows:
                            yield record(fields, list(zip(*rows)))

    return blocks.select("archive", "block", "ranges").repartition(tasks, "archive", "block").mapInArrow(
        read, "page_id bigint, target_uri string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    )


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, selection: Column | None = None, payloads: bool = False) -> DataFrame:
    """Pages written as WARC 1.1 records, then read back from the archives: one row per page.

    The payload is the html in UTF-8. Of records with equal payloads (by SHA-256) of at least
    ``least_bytes`` bytes, the one with the smallest ``page_id`` is a response and the others
    are revisits of it; all smaller ones are responses. The rows come from the archives, by
    the byte ranges of the index; ``selection`` is a condition on the index (all records
    without it). Payloads that many pages share take part in no join by their digest.

    A null html is an empty payload, a null url leaves its header out. A row without an id
    is never referred to, but revisits a page that has one; copies that all lack an id are
    responses. Rows that repeat the smallest id of a payload are all responses (their record
    ids are equal, since record ids follow from ``page_id``). Other columns are ignored; an
    empty table gives an empty result. ``folder`` is one that driver and executors share, a
    new one below ``spark.checkpoint.dir`` where it is not given.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    index = write_archives(record_plan(pages, least_bytes), folder)
    return read_archives(index if selection is None else index.filter(selection), folder, payloads)
