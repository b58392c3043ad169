"""Token ids in binary files: frequency-ranked ids, byte-aligned variable length, control bytes apart from the data.

An id is written as its rank by corpus frequency (most frequent first, equal counts by id), so that the 256
commonest take one byte.  Four ranks share a control byte that holds two bits each, the number of data bytes less
one; control bytes and data bytes of a block stand apart, so a block is decoded without a loop: tables indexed by the
control byte give the lengths and places of its four ranks.

A file is a row of stripes, a stripe whole documents of about ``STRIPE_IDS`` ids:

    stripe   u4 documents, u8 ids, u4 blocks | u1 null id flags | i8 doc_ids | u8 ids of each document | blocks
    block    u4 ranks, u4 data bytes | control bytes | data bytes        (at most BLOCK_IDS ranks)

``write_files`` tokenises every text once into a written table, counts ids (partial counts per task; at most the
vocabulary reaches the driver), sorts by doc_id over ranges of rows, and lets each task write its range as one file.
The index, a written table, has a row per stripe; only files that it names are read, so a lost or repeated task leaves
at most an unnamed file.  ``read_files`` reads any selection of stripes in parallel.

Defined results: null and empty texts are the end id alone; documents stand in ascending doc_id order, those without an id first,
repeated ids and repeated rows each as a document of its own in the order of the input's files; an empty table gives
no file and no rows; other columns are not read.  Memory of a task: a stripe, or the longest document.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqpool.llm.common import written
from seqpool.llm.packing import END_ID, encoder, tokenizer_path
from seqpool.session import shared_scratch

BLOCK_IDS = 1 << 18
STRIPE_IDS = 1 << 20
TABLE_FILE = "ranks.u4"

_HEAD, _BLOCK = struct.Struct("<IQI"), struct.Struct("<II")
INDEX_SCHEMA = "task bigint, stripe bigint, file string, offset bigint, length bigint, before bigint, n_ids bigint, n_docs bigint"

# Tables by control byte: bytes of each of its four ranks, where they start, and their sum.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_STARTS = np.cumsum(_SIZES, axis=1) - _SIZES
_TOTALS = _SIZES.sum(axis=1)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of 32-bit values; the last control byte is filled up with zero bits."""
    values = np.ascontiguousarray(ranks, dtype="<u4")
    code = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(code) // 4) * 4, dtype=np.uint8)
    padded[: len(code)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4) <= code[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    c = np.frombuffer(control, dtype=np.uint8)
    raw = np.frombuffer(data, dtype=np.uint8)
    total = _TOTALS[c]
    starts = ((np.cumsum(total) - total)[:, None] + _STARTS[c]).ravel()[:n]
    sizes = _SIZES[c].ravel()[:n]
    out = raw[starts].astype("<u4")
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        out[more] |= raw[starts[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


def encode_stripe(doc_ids: list, ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    """A stripe of whole documents; ``rank_of`` maps an id to its rank."""
    ranks = rank_of[np.concatenate(ids)]
    parts = [_HEAD.pack(len(ids), len(ranks), -(-len(ranks) // BLOCK_IDS)),
             bytes(d is None for d in doc_ids),
             np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([len(x) for x in ids], dtype="<u8").tobytes()]
    for at in range(0, len(ranks), BLOCK_IDS):
        own = ranks[at: at + BLOCK_IDS]
        control, data = encode_block(own)
        parts += [_BLOCK.pack(len(own), len(data)), control, data]
    return b"".join(parts)


def decode_stripe(raw: bytes, id_of: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids) of a stripe; ``id_of`` maps a rank to its id."""
    n_docs, n_ids, n_blocks = _HEAD.unpack_from(raw)
    at = _HEAD.size
    missing = raw[at: at + n_docs]
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at + n_docs).tolist()
    sizes = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    ids = np.empty(n_ids, dtype="<u4")
    done = 0
    for _ in range(n_blocks):
        n, size = _BLOCK.unpack_from(raw, at)
        at += _BLOCK.size
        width = -(-n // 4)
        ids[done: done + n] = id_of[decode_block(raw[at: at + width], raw[at + width: at + width + size], n)]
        at, done = at + width + size, done + n
    return [None if gone else d for gone, d in zip(missing, doc_ids, strict=True)], sizes, ids


@lru_cache(maxsize=4)
def id_type(path: str) -> str:
    """The narrowest unsigned type that holds every id of the tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
    return "<u2" if top < 1 << 16 else "<u4"


def token_table(docs: DataFrame, kind: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (as bytes of type ``kind``), task, row: every text's ids with the end id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or tokenizer_path())
        task, row = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = [np.append(encode(x or ""), end).astype(kind).tobytes() for x in part.column("text").to_pylist()]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([task] * n, pa.int64()),
                     pa.array(range(row, row + n), pa.int64())], names=["doc_id", "ids", "task", "row"])
                row += n

    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return x.mapInArrow(run, "doc_id bigint, ids binary, task bigint, row bigint")


def rank_table(tokens: DataFrame, kind: str) -> np.ndarray:
    """The ids of the corpus by descending frequency, equal counts by id: at most the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                own = np.bincount(np.frombuffer(ids.as_buffer(), dtype=kind))
                if len(own) > len(seen):
                    seen, own = own, seen
                seen[: len(own)] += own
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], dtype="<u4")


def _writer(folder: str, id_of: np.ndarray, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 0, dtype="<u4")
        rank_of[id_of] = np.arange(len(id_of), dtype="<u4")
        fs, root = pafs.FileSystem.from_uri(folder)
        task, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids"  # a name of its own for each attempt
        out, offset, before, index = None, 0, 0, []
        doc_ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal out, offset, before, size
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            raw = encode_stripe(doc_ids, held, rank_of)
            out.write(raw)
            index.append((task, len(index), name, offset, len(raw), before, size, len(held)))
            offset, before, size = offset + len(raw), before + size, 0
            doc_ids.clear()
            held.clear()

        try:
            for batch in batches:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                    doc_ids.append(doc_id)
                    held.append(np.frombuffer(ids.as_py(), dtype=kind))
                    size += len(held[-1])
                    if size >= STRIPE_IDS:
                        flush()
            if held:
                flush()
        finally:
            if out is not None:
                out.close()
        if index:
            names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
            kinds = [pa.string() if c == "file" else pa.int64() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names=names)

    return write


def write_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> tuple[str, DataFrame]:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; returns the folder and the index of stripes.

    The index has ``first``, the number of ids in all stripes before."""
    folder = folder or shared_scratch(docs.sparkSession, "token-files")
    kind = id_type(tokenizer or tokenizer_path())
    tokens = written(token_table(docs, kind, tokenizer), "token-ids")
    id_of = rank_table(tokens, kind)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{TABLE_FILE}", compression=None) as f:
        f.write(id_of.tobytes())
    order = ["doc_id", "task", "row"]
    dealt = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    index = written(dealt.mapInArrow(_writer(folder, id_of, kind), INDEX_SCHEMA), "token-index")
    whole = index.groupBy("task").agg(F.sum("n_ids").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    offsets = whole.select("task", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    return folder, index.join(offsets, "task").withColumn("first", F.col("earlier") + F.col("before")).drop("earlier", "before")


def read_rank_table(folder: str) -> np.ndarray:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{TABLE_FILE}") as f:
        return np.frombuffer(f.read(), dtype="<u4")


def read_files(spark: SparkSession, folder: str, index: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document in the stripes that ``index`` names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        id_of = read_rank_table(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{root}/{r['file']}") as f:
                    doc_ids, sizes, ids = decode_stripe(f.read_at(r["length"], r["offset"]), id_of)
                ends = np.cumsum(sizes)
                own = [ids[e - n: e].tobytes() for e, n in zip(ends, sizes, strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(r["first"] + ends - sizes, pa.int64()),
                           pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in own], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    wanted = index.select("file", "offset", "length", "first").repartitionByRange(n, "file", "offset")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return wanted.mapInArrow(run, schema)
