"""WARC archives, index first.

Writing: each task appends its records to an archive of its own in the shared
folder, every record a gzip member, and returns an index row per record (file,
offset, length, URL, payload digest).  An archive appears under its final name
only when it is complete, and the index, written as a table, names the archives
that count; what a lost or doubled task left behind is in no index.

Reading: the selected index rows of an archive are sorted by offset and ranges
that touch or lie within ``MAX_GAP`` bytes are fetched with one read.

Of records with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes the one
with the largest id is a ``response``; the others are ``revisit`` records
without payload that name it and carry the full payload's digest and length.

Defined results: a null payload is empty; a null url is written as ``about:blank``;
smaller equal payloads are all responses; repeated rows that carry the largest
id of their payload are all responses; null ids are never revisits of others
and come back as null; an empty table gives an empty index; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayq.llm.shared import arrow_map, materialise, new_path

MIN_REVISIT_BYTES = 1000
MAX_GAP = 64 << 10
MAX_READ = 8 << 20
ARCHIVE_BYTES = 1 << 30
_DATE = "2024-01-01T00:00:00Z"
_EOL = b"\r\n"
_ESCAPED = "X-Target-URI-Escaped"
#: Revisits that may be broadcast (about 20 MB).
BROADCAST_REVISITS = 200_000
INDEX_SCHEMA = "record_id long, file string, offset long, length long, url string, digest string"
RECORD_SCHEMA = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _record_uri(record_id: int | None) -> str:
    return f"urn:record:{'none' if record_id is None else record_id}"


def build_record(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit (``refers_to`` given) keeps no payload."""
    body = b"" if refers_to is not None else payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_record_uri(record_id)}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _one_line(url) if url is not None else "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None and _one_line(url) != url:
        fields.append((_ESCAPED, "1"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_record_uri(refers_to)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    head = b"WARC/1.1" + _EOL + b"".join(f"{k}: {v}".encode() + _EOL for k, v in fields) + _EOL
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head + body + _EOL + _EOL) + packer.flush()


def _one_line(value: str) -> str:
    """Header values may not hold line ends; those are percent-encoded, with a field that says so."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


@dataclass
class Record:
    """What a record holds; payload is the block as stored."""

    fields: dict[str, str]
    payload: bytes

    @property
    def record_id(self) -> int | None:
        found = self.fields["warc-record-id"].strip("<>").rpartition(":")[2]
        return None if found == "none" else int(found)

    @property
    def url(self) -> str:
        value = self.fields["warc-target-uri"]
        return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if _ESCAPED.lower() in self.fields else value

    @property
    def refers_to(self) -> int | None:
        found = self.fields.get("warc-refers-to")
        return int(found.strip("<>").rpartition(":")[2]) if found else None


def parse_record(member: bytes) -> Record:
    """The record in one gzip member; raises ``ValueError`` where it is damaged."""
    try:
        raw = zlib.decompress(member, 31)
    except zlib.error as e:
        raise ValueError(f"not a gzip member: {e}") from e
    head, gap, rest = raw.partition(_EOL * 2)
    version, *lines = head.decode().split("\r\n")
    if not gap or not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != _EOL * 2:
        raise ValueError("a record's block does not have its stated length")
    return Record(fields, rest[:n])


def _open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _payload(column: Column) -> Column:
    return F.coalesce(column.cast("binary"), F.lit("").cast("binary"))


def revisits(rows: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(id, digest, refers_to) of the records of ``rows(id, payload, digest)`` that repeat another's payload.

    Only ids, lengths and digests are grouped; the groups' heads are joined back
    to them, so a payload that a third of all records share stays spread out.
    """
    narrow = rows.select("id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    narrow = materialise(narrow, "warc-digests")
    heads = materialise(narrow.groupBy("digest", "n").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "warc-heads")
    return narrow.join(heads, ["digest", "n"]).where(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "digest", "refers_to").distinct()


def write_warc(rows: DataFrame, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archives ``rows(id, url, payload)``; returns the index, one row per record."""
    spark = rows.sparkSession
    path = path or new_path(spark, "warc")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), _payload(F.col("payload")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = materialise(revisits(rows, min_bytes), "warc-revisits")
    # payloads are shuffled only where the list of revisits is too long to be sent to all tasks
    few = again.count() <= BROADCAST_REVISITS
    joined = rows.join(F.broadcast(again) if few else again, ["id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open_store(path)
        store.create_dir(folder, recursive=True)
        out, name, at, rows_made = None, "", 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                store.move(f"{folder}/{name}.part", f"{folder}/{name}")
                out = None

        for batch in batches:
            for i in range(batch.num_rows):
                record_id, url, payload, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}.part", compression=None)
                member = build_record(record_id, url, payload, digest, refers)
                out.write(member)
                rows_made.append((record_id, f"{path}/{name}", at, len(member), url, digest))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    close()
        close()
        # index rows go out only when the archives they name are complete
        for k in range(0, len(rows_made), 50_000):
            columns = list(zip(*rows_made[k : k + 50_000], strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["record_id", "file", "offset", "length", "url", "digest"])

    made = arrow_map(joined.select("id", "url", "payload", "digest", "refers_to"), run, INDEX_SCHEMA)
    return materialise(made, "warc-index")


def coalesced(ranges: list[tuple[int, int]], max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges as reads: (from, to, first range, one past the last)."""
    reads: list[list[int]] = []
    for k, (at, n) in enumerate(ranges):
        if reads and at - reads[-1][1] <= max_gap and at + n - reads[-1][0] <= max_read:
            reads[-1][1], reads[-1][3] = max(reads[-1][1], at + n), k + 1
        else:
            reads.append([at, at + n, k, k + 1])
    return [tuple(r) for r in reads]


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` selects: id, url, type, refers_to, full payload's length and digest, and the block.

    Index rows are dealt out by archive and range of offsets, so a task reads
    neighbouring bytes and a large archive is shared by many tasks.
    """
    spans = index.select("file", "offset", "length", F.expr(f"offset div {MAX_READ}").alias("_span"))
    dealt = spans.repartition("file", "_span").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        opened, handle = "", None
        for batch in batches:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if files[i] != opened:
                    if handle is not None:
                        handle.close()
                    store, place = _open_store(files[i])
                    opened, handle = files[i], store.open_input_file(place)
                own = list(zip(offsets[i:j], lengths[i:j], strict=True))
                for low, high, a, b in coalesced(own):
                    handle.seek(low)
                    data, rows = handle.read(high - low), []
                    for at, n in own[a:b]:
                        record = parse_record(data[at - low : at - low + n])
                        stated, refers = record.fields["warc-payload-digest"].removeprefix("sha1:"), record.refers_to
                        found = stated if refers is not None else hashlib.sha1(record.payload).hexdigest()
                        if found != stated:
                            raise ValueError(f"payload of record {record.record_id} does not have its digest")
                        size = int(record.fields["x-payload-length"]) if refers is not None else len(record.payload)
                        rows.append((record.record_id, record.url, record.fields["warc-type"], refers, size, found, record.payload if payloads else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                i = j
        if handle is not None:
            handle.close()

    return arrow_map(dealt, run, RECORD_SCHEMA)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes ``pages(page_id, url, html)``, reads all records back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    index = write_warc(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")))
    back = read_warc(index, payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: The query's rows in plain SQL.
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, 'about:blank') AS url, encode(coalesce(html, '')) AS body FROM pages
), d AS (SELECT page_id, url, octet_length(body) AS n, sha1(body) AS h FROM p),
g AS (SELECT h, n, max(page_id) AS head, count(*) AS c FROM d WHERE n >= {MIN_REVISIT_BYTES} GROUP BY h, n)
SELECT page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head IS NULL OR head = page_id THEN NULL ELSE head END AS refers_to, url
FROM d LEFT JOIN g USING (h, n)
"""
