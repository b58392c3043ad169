"""WARC archives with an index: one gzip member per record, read back by coalesced byte ranges.

``write_archives`` deals the rows over tasks; each task writes its own archive file into the shared
folder and returns an index row (file, offset, length, url, digest, ...) per record.  The index is
a written Parquet table, and only files it names are ever read, so a repeated or lost task leaves at
most an unnamed file.  ``read_records`` sorts the selected index rows by file and offset, joins
neighbouring ranges into one read and parses the records.

Of the rows with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id is
written as ``response``, the others as ``revisit`` without payload; smaller payloads are all
``response``.  Defined results: null html is the empty payload; a null url leaves out the target;
rows that share page_id and payload with the response are responses too; a null page_id refers to a
response that has one, else is a response; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpool.llm.common import written
from seqpool.session import shared_scratch

INDEX_SCHEMA = "file string, offset bigint, length bigint, url string, digest string, record_type string, page_id bigint"
RECORD_SCHEMA = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
                 "refers_to bigint")
ROLL_BYTES = 512 << 20  # a new file after so many bytes
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20  # ranges closer than this are one read, up to this size
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record; with ``refers_to`` a revisit, whose HTTP header keeps the payload's full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {WARC_DATE}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in text.decode().split("\r\n")[1:])
    return {k.lower(): v.strip() for k, _, v in pairs}


def parse_record(member: bytes) -> dict:
    """The fields and payload of one gzip member; a payload that does not fit its digest is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    own = re.fullmatch(r"<urn:page:(-?\d*)>", h["warc-record-id"])[1]
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", h.get("warc-refers-to", ""))
    if h["warc-type"] == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of page {own} does not fit its digest")
    return {"page_id": int(own) if own else None, "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
            "payload_digest": digest, "payload_bytes": int(_headers(http)["content-length"]),
            "refers_to": int(refers[1]) if refers else None, "payload": payload if refers is None else None}


def _whole(x):
    return None if x is None or x != x else int(x)


def _whole_columns(x: pd.DataFrame, rows: list, columns: dict[str, int | str]) -> pd.DataFrame:
    """``x`` with the named columns as integers with nulls, taken from ``rows``: never by way of floats."""
    return x.assign(**{name: pd.array([r[at] for r in rows], dtype="Int64") for name, at in columns.items()})


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for rows in batches:
                index = []
                for r in rows.itertuples(index=False):
                    if out is None or at >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # a name of its own for each attempt
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    page_id, refers = _whole(r.page_id), _whole(r.refers_to)
                    digest = base64.b32encode(bytes.fromhex(r.sha1)).decode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(make_record(page_id, r.url, bytes(r.payload), digest, refers)) + packer.flush()
                    out.write(member)
                    index.append((name, at, len(member), r.url, digest,
                                  "response" if refers is None else "revisit", page_id))
                    at += len(member)
                x = pd.DataFrame(index, columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])
                yield _whole_columns(x, index, {"page_id": -1})
        finally:
            if out is not None:
                out.close()

    return write


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, refers_to (null: response).  Only digests and ids are grouped."""
    x = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    x = x.withColumn("sha1", F.sha1("payload"))
    narrow = x.where(F.octet_length("payload") >= min_bytes)
    first = narrow.groupBy("sha1").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1").select("sha1", "response_id"), "warc-first")  # so that the join can split a hot digest
    y = x.join(first, "sha1", "left")
    own = F.col("page_id").eqNullSafe(F.col("response_id"))
    return y.select("page_id", "url", "payload", "sha1", F.when(~own, F.col("response_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write a record per row of ``pages`` (page_id, url, html); returns the folder and the index table."""
    folder = folder or shared_scratch(pages.sparkSession, "warc")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    x = with_references(pages, min_bytes)
    for name in ("page_id", "refers_to"):  # as strings: pandas makes a column of numbers with nulls a column of floats
        x = x.withColumn(name, F.col(name).cast("bigint").cast("string"))
    index = x.mapInPandas(_writer(folder), INDEX_SCHEMA)
    return folder, written(index, "warc-index")


def _reader(folder: str, with_payload: bool):
    columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")] + ["payload"] * with_payload

    def frame(records: list[dict]) -> pd.DataFrame:
        return _whole_columns(pd.DataFrame(records, columns=columns), records, {"page_id": "page_id", "refers_to": "refers_to"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for rows in batches:
            spans: list[tuple[str, int, int, list]] = []
            for file, offset, length in rows.itertuples(index=False):
                last = spans[-1] if spans else None
                if last and last[0] == file and 0 <= offset - last[2] <= GAP_BYTES and offset + length - last[1] <= READ_BYTES:
                    last[3].append((offset, length))
                    spans[-1] = (file, last[1], offset + length, last[3])
                else:
                    spans.append((file, offset, offset + length, [(offset, length)]))
            for file, start, end, members in spans:
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                data = source.read_at(end - start, start)
                records, held = [], 0
                for offset, length in members:
                    records.append(parse_record(data[offset - start: offset - start + length]))
                    held += len(records[-1]["payload"] or b"")
                    if held > READ_BYTES:
                        yield frame(records)
                        records, held = [], 0
                yield frame(records)

    return read


def read_records(folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name: fields, and the payload (null for revisits) if wanted."""
    wanted = index.select("file", "offset", "length")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = wanted.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    schema = RECORD_SCHEMA + ", payload binary" * with_payload
    return dealt.mapInPandas(_reader(folder, with_payload), schema)
