"""Token sequences as length-delimited binary records with an offset index.

A file holds records one behind the other: eight bytes of length, four of its masked
checksum, the payload, four of the payload's masked checksum; numbers are little-endian
and the checksum is CRC-32C, as readers of such record files expect. A payload is the
document's id (eight bytes, signed), whether it has one (two bytes), the bytes per token
(two bytes) and the token ids. Beside each file lies an index with an entry per record, so
a reader can fetch records in any order without scanning.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.buffers import ragged, slices
from casewatch.llm.tokens import ENCODED_BYTES, Encoder
from casewatch.session import shared_dir, stage

HEADER = np.dtype([("doc_id", "<i8"), ("known", "<u2"), ("width", "<u2")])
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "<u2"), ("offset", "<u8"), ("start", "<u8"), ("n_tokens", "<u8")])
FRAME = 16  # bytes around a payload
ROW = 256  # bytes that are summed together
# Fixed values of the record format: the checksum's polynomial (reflected) and what the mask adds.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
MANIFEST = "part int, path string, n_records long, n_tokens long, n_bytes long"
TOKENS = "doc_id long, start long, n_tokens long, ids binary"


@lru_cache(maxsize=None)
def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Tables that take a register over four bytes, and over a row of zeros."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    word = [one]
    for _ in range(3):
        word.append((word[-1] >> 8) ^ one[word[-1] & 255])
    word = np.array(word[::-1])
    row = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(ROW // 4):
        row = _over(row, word)
    return word, row


def _over(register: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return (
        tables[0][register & 255]
        ^ tables[1][(register >> 8) & 255]
        ^ tables[2][(register >> 16) & 255]
        ^ tables[3][register >> 24]
    )


def crc32c(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32C of several byte ranges of at least four bytes, all at once.

    Leading zeros do not change a register that starts at zero, so ranges are padded in
    front to whole rows; inverting the first four bytes stands for the usual start value.
    """
    word, row = _steps()
    rows = -(-length // ROW)
    ends = np.cumsum(rows)
    padded = np.zeros(int(rows.sum()) * ROW, np.uint8)
    first = ends * ROW - length
    padded[ragged(first, length)] = data[ragged(start, length)]
    for i in range(4):
        padded[first + i] ^= 255
    words = np.ascontiguousarray(padded.view("<u4").reshape(-1, ROW // 4).T)
    register = np.zeros(words.shape[1], np.uint32)
    for column in words:
        register = _over(register ^ column, word)
    total = np.zeros(len(length), np.uint32)
    at, left = ends - rows, rows.copy()
    live = np.flatnonzero(left > 0)
    while len(live):
        total[live] = _over(total[live], row) ^ register[at[live]]
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    return ~total


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(doc_id: np.ndarray, known: np.ndarray, ids: np.ndarray, offsets: np.ndarray, width: int) -> tuple:
    """Bytes of the records of some documents, and where each starts."""
    n = np.diff(offsets)
    length = HEADER.itemsize + n * width
    first = np.cumsum(length + FRAME) - (length + FRAME)
    out = np.zeros(int((length + FRAME).sum()), np.uint8)

    def put(at, values):
        flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(at), -1)
        out[(at[:, None] + np.arange(flat.shape[1])).ravel()] = flat.ravel()

    header = np.zeros(len(n), HEADER)
    header["doc_id"], header["known"], header["width"] = doc_id, known, width
    put(first, length.astype("<u8"))
    put(first + 12, header)
    tokens = ids.astype("<u2" if width == 2 else "<u4").view(np.uint8)
    out[ragged(first + 12 + HEADER.itemsize, n * width)] = tokens
    put(first + 8, masked(crc32c(out, first, np.full(len(n), 8))).astype("<u4"))
    put(first + 12 + length, masked(crc32c(out, first + 12, length)).astype("<u4"))
    return out, first


def unframe(data: np.ndarray, first: np.ndarray) -> tuple:
    """Headers, ids and id offsets of records; a wrong checksum or length is an error."""

    def get(at, kind):
        size = np.dtype(kind).itemsize
        return data[(at[:, None] + np.arange(size)).ravel()].view(kind)

    length = get(first, "<u8").astype(np.int64)
    if (masked(crc32c(data, first, np.full(len(first), 8))) != get(first + 8, "<u4")).any():
        raise ValueError("a record's length does not match its checksum")
    if (masked(crc32c(data, first + 12, length)) != get(first + 12 + length, "<u4")).any():
        raise ValueError("a record does not match its checksum")
    header = get(first + 12, HEADER)
    width = int(header["width"][0]) if len(header) else 4
    n = (length - HEADER.itemsize) // width
    ids = data[ragged(first + 12 + HEADER.itemsize, n * width)].view("<u2" if width == 2 else "<u4")
    return header, ids.astype(np.uint32), np.concatenate([[0], np.cumsum(n)])


def filesystem(uri: str):
    """File system and path of a folder by its address; plain paths are local."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more behind each document."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
    fs, root = filesystem(folder)
    name, own = f"{root}/part-{part:06d}", f"{root}/.{part:06d}-{uuid.uuid4().hex}"
    fs.create_dir(root, recursive=True)
    entries, at, start = [], 0, 0
    with fs.open_output_stream(f"{own}.rec") as out:
        for batch in batches:
            doc_ids = batch.column(0)
            known = np.asarray(doc_ids.is_valid())
            numbers = np.asarray(doc_ids.fill_null(0)).astype(np.int64)
            for a, b, texts in slices(batch.column(1), ENCODED_BYTES):
                ids, offsets = with_end(*encoder.encode(texts), end_id)
                data, first = frame(numbers[a:b], known[a:b], ids, offsets, encoder.width)
                entry = np.zeros(b - a, ENTRY)
                entry["doc_id"], entry["known"] = numbers[a:b], known[a:b]
                entry["offset"], entry["start"], entry["n_tokens"] = at + first, start + offsets[:-1], np.diff(offsets)
                out.write(pa.py_buffer(data))
                entries.append(entry)
                at, start = at + len(data), start + int(offsets[-1])
    if not entries:
        fs.delete_file(f"{own}.rec")
        return
    entries = np.concatenate(entries)
    with fs.open_output_stream(f"{own}.idx") as out:
        out.write(pa.py_buffer(entries.view(np.uint8)))
    # Each attempt of a task writes the same bytes under names of its own and moves them at the end.
    fs.move(f"{own}.idx", f"{name}.idx")
    fs.move(f"{own}.rec", f"{name}.rec")
    row = {"part": [part], "path": [f"{folder}/part-{part:06d}"], "n_records": [len(entries)]}
    row |= {"n_tokens": [start], "n_bytes": [at]}
    yield pa.RecordBatch.from_pydict(row, schema=_schema(MANIFEST))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def write_records(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col="doc_id", text_col="text"
) -> DataFrame:
    """Encode every text and write it as a record; returns one row per file.

    Files follow each other in ascending id (null first; of equal ids in the order of a
    hash of the text), each with its index. A null or empty text is a record with the end
    id only; an empty table writes nothing. Only the two named columns are read.
    Acts at once.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/records/{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    rows = rows.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stage(rows.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id), MANIFEST))


def _read(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = filesystem(row["path"])
            with fs.open_input_stream(f"{path}.idx") as f:
                entries = np.frombuffer(f.read(), ENTRY)
            ends = np.append(entries["offset"][1:], row["n_bytes"]).astype(np.int64)
            starts = entries["offset"].astype(np.int64)
            with fs.open_input_stream(f"{path}.rec") as f:
                at = 0
                while at < len(entries):
                    to = max(at + 1, int(np.searchsorted(ends, starts[at] + limit, side="right")))
                    data = np.frombuffer(f.read(int(ends[to - 1] - starts[at])), np.uint8)
                    header, ids, offsets = unframe(data, starts[at:to] - starts[at])
                    yield _token_rows(header, ids, offsets, row["base"] + entries["start"][at:to].astype(np.int64))
                    at = to


def _token_rows(header, ids, offsets, start) -> pa.RecordBatch:
    doc_id = pa.array(header["doc_id"].astype(np.int64), mask=header["known"] == 0)
    packed = pa.Array.from_buffers(
        pa.binary(), len(header), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
    )
    columns = [doc_id, pa.array(start), pa.array(np.diff(offsets)), packed]
    return pa.RecordBatch.from_arrays(columns, schema=_schema(TOKENS))


def read_records(manifest: DataFrame) -> DataFrame:
    """Records of the files of a manifest: id, tokens before it in all files, its tokens.

    The driver adds up one number per file; files are read by the executors.
    """
    spark = manifest.sparkSession
    files = sorted(manifest.collect(), key=lambda r: r["part"])
    rows, base = [], 0
    for file in files:
        rows.append((file["path"], file["n_bytes"], base))
        base += file["n_tokens"]
    if not rows:
        return spark.createDataFrame([], TOKENS)
    listed = spark.createDataFrame(rows, "path string, n_bytes long, base long").repartition(len(rows), "path")
    return listed.mapInArrow(_read, TOKENS)


def fetch_record(path: str, row: int) -> tuple[int | None, np.ndarray]:
    """One record of a file by its place, found through the index: what a shuffled reader does."""
    fs, name = filesystem(path)
    with fs.open_input_file(f"{name}.idx") as f:
        entry = np.frombuffer(f.read_at(ENTRY.itemsize, row * ENTRY.itemsize), ENTRY)[0]
    with fs.open_input_file(f"{name}.rec") as f:
        length = int(np.frombuffer(f.read_at(8, int(entry["offset"])), "<u8")[0])
        data = np.frombuffer(f.read_at(length + FRAME, int(entry["offset"])), np.uint8)
    header, ids, _ = unframe(data, np.array([0]))
    return (int(header["doc_id"][0]) if header["known"][0] else None), ids
