"""Operator 10: packing by first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import steps, texts_of
from gridspark.llm.pieces import STEP, encoder

#: Tokens of a sequence, and documents of a group on average.
CAPACITY, GROUP_DOCS = 4096, 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _row long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; the longest first, each into the leftmost bin with room.

    The tree's leaves are the bins' free room and a node is the larger of its children, so the leftmost bin with
    room is found by one walk from the root.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[item]), 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= size else 2 * node + 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1 and tree[node >> 1] != (best := max(tree[node], tree[node ^ 1])):
            node >>= 1
            tree[node] = best
    return bins, offsets


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text, each text followed by ``end_id``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, row = encoder(vocabulary, False), np.array([end_id], "<u4").tobytes(), 0
        for step in steps(batches, most=STEP):
            out = []
            for doc_id, ids in zip(step.column("doc_id").to_pylist(), own.encode(texts_of(step)), strict=True):
                ids, row = ids + end, row + 1
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start:4 * (start + capacity)]
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, row, piece))
            columns = list(zip(*out, strict=True))[:7 if keep_ids else 6]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.binary()) for c in columns[6:])],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_row", "ids"][:len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, keep_ids: bool = False) -> DataFrame:
    """Pack all texts of ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    A text longer than a sequence is cut into whole sequences and a rest; then every random group of about
    ``group_docs`` documents is packed by itself, so tasks stay alike and no order over all rows is needed.  A
    row's group comes from its id and its place in its task, so rows with the same id spread as well.  Returns
    one row per piece, with its ids if ``keep_ids``.  Null texts count as empty and keep their end id; null ids
    stay; repeated rows are packed each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.count()
    groups = max(1, -(-rows // group_docs))
    pieces = cut_pieces(docs, vocabulary, end_id, capacity, keep_ids)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(groups)))

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "_row"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[[*PACKED_NAMES, *["ids"] * keep_ids]]

    return dealt.groupBy("_group").applyInPandas(fit, PACKED + ", ids binary" * keep_ids)


PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces that kept their ids; padded, except at a power of two."""
    n = F.sum("length").cast("int")
    rows = packed.groupBy("sequence_id").agg(n.alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    whole = F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    short = F.log2("n_tokens") != F.floor(F.log2("n_tokens"))
    pad = F.unhex(F.repeat(F.hex(F.lit(pad_id.to_bytes(4, "little"))), F.when(short, capacity - F.col("n_tokens")).otherwise(0).cast("int")))
    return rows.select("sequence_id", "n_tokens", F.concat(whole, pad).alias("ids"))
