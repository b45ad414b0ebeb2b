"""Operator 2: token ids as length-delimited binary records, with a separate offset index.

A record is: length (unsigned 64-bit), masked CRC-32C of those 8 bytes (unsigned 32-bit), data, masked CRC-32C of the
data; all little-endian, the framing that TFRecord readers know.  Data is: doc_id (signed 64-bit), flags (one byte: 1,
the id is null; 2, ids have 32 bits), number of ids (unsigned 32-bit), then the ids, in 16 bits where every id of the
vocabulary fits.

Files are written by tasks under names of their own; the index, a Parquet table that Spark commits, names only the
files of tasks that ended well.  So a task that is run again leaves no trace in what readers see.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import in_order, shuffle_parts, steps, texts_of
from gridspark.llm.pieces import STEP, encoder

#: Fixed values of the framing.
CASTAGNOLI, MASK = 0x82F63B78, 0xA282EAD8
HEAD = struct.Struct("<qBI")
INDEX_SCHEMA = "doc_id long, _part int, file string, offset long, length long, n_tokens long, first_token long"
#: Bytes that are checked side by side.
BLOCK = 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC tables for four bytes at once, and for moving a register over BLOCK zero bytes."""
    t = np.zeros((4, 256), np.uint32)
    for n in range(256):
        c = n
        for _ in range(8):
            c = c >> 1 ^ (CASTAGNOLI if c & 1 else 0)
        t[0, n] = c
    for k in range(1, 4):
        t[k] = t[k - 1] >> 8 ^ t[0][t[k - 1] & 0xFF]
    far = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(BLOCK // 4):
        far = t[3][far & 0xFF] ^ t[2][far >> 8 & 0xFF] ^ t[1][far >> 16 & 0xFF] ^ t[0][far >> 24]
    return t, far


_T, _FAR = _tables()


def crc32c(datas: list[bytes]) -> np.ndarray:
    """CRC-32C of byte strings of at least 4 bytes, all at once.

    The register starts at zero over strings filled with zero bytes in front, which leave it zero; the usual start
    value is put into the first four bytes.
    """
    sizes = np.array([len(x) for x in datas], np.int64)
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    space = np.zeros(int(ends[-1]) * BLOCK if len(datas) else 0, np.uint8)
    for data, end in zip(datas, ends, strict=True):
        to = int(end) * BLOCK
        space[to - len(data):to] = np.frombuffer(data, np.uint8)
        space[to - len(data):to - len(data) + 4] ^= 0xFF
    words = np.ascontiguousarray(space.view("<u4").reshape(-1, BLOCK // 4).T)
    reg = np.zeros(words.shape[1], np.uint32)
    for row in words:
        x = reg ^ row
        reg = _T[3][x & 0xFF] ^ _T[2][x >> 8 & 0xFF] ^ _T[1][x >> 16 & 0xFF] ^ _T[0][x >> 24]
    out, first = np.zeros(len(datas), np.uint32), ends - blocks
    order = np.argsort(-blocks, kind="stable")
    many = np.sort(blocks)
    for j in range(int(blocks.max(initial=0))):  # the j-th block of every string that has one
        live = order[:len(blocks) - int(np.searchsorted(many, j, side="right"))]
        x = out[live]
        out[live] = _FAR[0][x & 0xFF] ^ _FAR[1][x >> 8 & 0xFF] ^ _FAR[2][x >> 16 & 0xFF] ^ _FAR[3][x >> 24] ^ reg[first[live] + j]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(datas: list[bytes]) -> np.ndarray:
    c = crc32c(datas).astype(np.uint64)
    return ((c >> 15 | c << 17) + MASK & 0xFFFFFFFF).astype("<u4")


def frame(datas: list[bytes]) -> list[bytes]:
    """Records of byte strings."""
    lengths = [struct.pack("<Q", len(x)) for x in datas]
    a, b = masked(lengths), masked(datas)
    return [b"".join((n, a[i].tobytes(), x, b[i].tobytes())) for i, (n, x) in enumerate(zip(lengths, datas, strict=True))]


def unframe(records: list[bytes]) -> list[bytes]:
    """The data of records; a wrong length or checksum is an error."""
    lengths, datas = [x[:8] for x in records], [x[12:-4] for x in records]
    a, b = masked(lengths), masked(datas)
    for i, x in enumerate(records):
        if struct.unpack("<Q", lengths[i])[0] != len(datas[i]) or a[i].tobytes() != x[8:12] or b[i].tobytes() != x[-4:]:
            raise ValueError("damaged record")
    return datas


def to_data(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    own = ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return HEAD.pack(doc_id or 0, (doc_id is None) + 2 * wide, len(ids) // 4) + own


def from_data(data: bytes) -> tuple[int | None, bytes]:
    doc_id, flags, n = HEAD.unpack_from(data)
    ids = np.frombuffer(data, "<u4" if flags & 2 else "<u2", n, HEAD.size).astype("<u4").tobytes()
    return None if flags & 1 else doc_id, ids


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode every text of ``docs`` (doc_id, text), add ``end_id``, write records to ``path`` in ascending doc_id order.

    ``path/data`` gets a file for each range of ids, ``path/index`` one row per record.  Null texts count as empty,
    null ids come first, rows with the same id are all written, in the order of their texts.  Other columns are ignored.
    An empty table gives an empty index.  ``path`` must be a folder that all executors share.
    """
    spark = docs.sparkSession
    dealt, _ = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", parts or shuffle_parts(spark), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, True)
        wide = own.library.get_vocab_size() > 1 << 16
        end, out, offset, tokens, name = np.array([end_id], "<u4").tobytes(), None, 0, 0, ""
        for step in steps(batches, most=STEP):
            doc_ids, part = step.column("doc_id").to_pylist(), step.column("_part")
            ids = [x + end for x in own.encode(texts_of(step))]
            records = frame([to_data(d, x, wide) for d, x in zip(doc_ids, ids, strict=True)])
            if out is None:
                files, root = _files(path)
                files.create_dir(f"{root}/data", recursive=True)
                name = f"data/part-{part[0].as_py():05d}-{uuid.uuid4().hex}.rec"
                out = files.open_output_stream(f"{root}/{name}")
            out.write(b"".join(records))
            sizes, counts = np.array([len(x) for x in records], np.int64), np.array([len(x) // 4 for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), part, pa.array([name] * len(ids)), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes),
                 pa.array(counts), pa.array(tokens + np.cumsum(counts) - counts)],
                ["doc_id", "_part", "file", "offset", "length", "n_tokens", "first_token"])
            offset, tokens = offset + int(sizes.sum()), tokens + int(counts.sum())
        if out is not None:
            out.close()  # before the task ends, and so before the index is committed

    dealt.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the records in ``path``: read file by file, or in random order for a ``seed``.

    ``ids`` are little-endian unsigned 32-bit; ``start`` is the number of ids of all records before.  Lengths, checksums
    and the index are checked against each other.
    """
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    # one row per file: written files are bounded by the number of ranges, not by rows
    whole = index.groupBy("_part").agg(F.sum("n_tokens").alias("n"))
    before = whole.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_base"))
    rows = index.join(before, "_part").withColumn("start", F.col("_base") + F.col("first_token"))
    n = shuffle_parts(spark)
    rows = rows.repartitionById(n, F.col("_part")).sortWithinPartitions("_part", "offset") if seed is None else \
        rows.withColumn("_r", F.rand(seed)).repartition(n, "_r").sortWithinPartitions("_r").drop("_r")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(path)
        name, source = None, None
        for step in steps(batches, "file"):
            at, records = step.to_pydict(), []
            for file, offset, length in zip(at["file"], at["offset"], at["length"], strict=True):
                if file != name:
                    name, source = file, files.open_input_file(f"{root}/{file}")
                source.seek(offset)
                records.append(source.read(length))
            found = [from_data(x) for x in unframe(records)]
            if [x[0] for x in found] != at["doc_id"] or [len(x[1]) // 4 for x in found] != at["n_tokens"]:
                raise ValueError("the index does not match its records")
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("start"), step.column("n_tokens"),
                                              pa.array([x[1] for x in found], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return rows.select("doc_id", "start", "n_tokens", "file", "offset", "length").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
