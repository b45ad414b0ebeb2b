"""Operator 7: exact top-k inner products with a bit-sliced index.

Vectors are dealt into blocks.  In a block, attribute d is stored as bit slices: one bitmap over the block's rows for
each binary digit of (component - smallest component), and the same of its complement for negative weights.  A query's
score is a sum of bitmaps, each worth a power of two: for every binary digit of a weight, the slices of its attribute.
The sum is formed by carry-save addition on whole bitmaps, without the attributes' lowest digits (quantised).  Rows are
then selected from the sum's most significant slice downward, and all rows that the missing digits could lift to the
boundary are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.scratch import settle

#: Rows of a block, queries that a task asks of it, low digits left out of the bitmaps, and the largest scaled component that is sliced.
BLOCK_ROWS, CHUNK_QUERIES, LEFT_OUT, LARGEST = 16384, 1024, 1, 1 << 26
FOUND = "query_id long, vec_id long, score long, copies long"
LONGEST = (1 << 63) - 1


class SlicedBlock:
    """The bit-sliced index of a block's integer vectors (rows x attributes), all of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, left_out: int = LEFT_OUT):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.left_out = ids[order], vectors[order], left_out
        self.exact = self.vectors.astype(np.float64)
        n, d = vectors.shape
        shifted = self.vectors - self.vectors.min(axis=0, initial=LARGEST) if n else self.vectors
        self.digits = max(0, int(shifted.max(initial=0)).bit_length() - left_out)
        self.words = -(-n // 64)
        self.all = self._bitmap(np.ones(n, bool))
        self.slices = np.zeros((2, d, self.digits, self.words), np.uint64)
        for i in range(self.digits):
            for a in range(d):
                self.slices[0, a, i] = self._bitmap((shifted[:, a] >> (i + left_out) & 1).astype(bool))
        self.slices[1] = ~self.slices[0] & self.all
        self.flat = self.slices.reshape(-1, self.words) if self.digits else np.zeros((0, self.words), np.uint64)

    def _bitmap(self, rows: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.words * 8, np.uint8)
        bits = np.packbits(rows, bitorder="little")
        packed[:len(bits)] = bits
        return packed.view(np.uint64)

    def rows_of(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def sum_slices(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of the weighted sum of quantised attributes (least significant first), by carry-save addition."""
        d = len(weights)
        base = ((weights < 0) * d + np.arange(d)) * self.digits
        size = np.abs(weights)
        columns: list[list[np.ndarray]] = []
        top = int(size.max(initial=0)).bit_length()
        for j in range(top):
            on = base[(size >> j & 1).astype(bool)]
            for i in range(self.digits):
                while len(columns) <= i + j:
                    columns.append([])
                columns[i + j].append(on + i)
        out, carried = [], np.zeros((0, self.words), np.uint64)
        p = 0
        while p < len(columns) or len(carried):
            stack = np.concatenate([self.flat[np.concatenate(columns[p])], carried]) if p < len(columns) else carried
            carries = []
            while len(stack) > 1:
                t = max(1, len(stack) // 3)
                if len(stack) == 2:
                    carries.append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
                    break
                a, b, c = stack[:t], stack[t:2 * t], stack[2 * t:3 * t]
                half = a ^ b
                carries.append(a & b | half & c)
                stack = np.concatenate([half ^ c, stack[3 * t:]]) if len(stack) > 3 * t else half ^ c
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(carries) if carries else np.zeros((0, self.words), np.uint64)
            p += 1
        return out

    def top(self, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the query's own, ties to the smaller id."""
        rows, scores = self.top_rows(query_id, weights, k)
        return self.ids[rows], scores

    def top_rows(self, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same as numbers of rows in the order of ids."""
        live = self.all
        a, b = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right")
        if a < b:
            own = np.zeros(len(self.ids), bool)
            own[a:b] = True
            live = live & ~self._bitmap(own)
        count = len(self.ids) - int(b - a)
        if count > k:
            live = self._near_top(live, self.sum_slices(weights), int(np.abs(weights).sum()), k)
        rows = self.rows_of(live)
        # products and sums stay below 2^53 for usual vectors, and are then exact in floating point
        small = np.abs(self.exact[rows]).max(initial=0) * np.abs(weights).sum(initial=0) < 1 << 53
        scores = (self.exact[rows] @ weights).astype(np.int64) if small else self.vectors[rows] @ weights
        if len(rows) > k:  # rows with the k best scores, ties included
            kept = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, scores = rows[kept], scores[kept]
        best = np.lexsort((rows, -scores))[:k]
        return rows[best], scores[best]

    def _near_top(self, live: np.ndarray, slices: list[np.ndarray], weight: int, k: int) -> np.ndarray:
        """Rows that may be among the k best: from the top slice down, then as many steps lower as digits are missing."""
        sure, even, missing, value = 0, live, k, 0
        for p in range(len(slices) - 1, -1, -1):
            ones = even & slices[p]
            n = int(np.bitwise_count(ones).sum())
            if n >= missing:
                even, value = ones, value | 1 << p
            else:
                even, missing, sure = even & ~slices[p], missing - n, sure + n
        least = max(0, value - (((1 << self.left_out) - 1) * weight >> self.left_out))
        above, even = np.zeros_like(live), live
        for p in range(len(slices) - 1, -1, -1):
            if least >> p & 1:
                even = even & slices[p]
            else:
                above |= even & slices[p]
                even = even & ~slices[p]
        return above | even


def exact_top(ids: np.ndarray, vectors: np.ndarray, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """(rows, scores) of the k best rows but the query's own for whole numbers of any size, held as floating-point numbers.

    Products in floating point with a bound of their error leave the rows that may be among the best; those are scored
    with Python's integers.
    """
    rows = np.flatnonzero(ids != query_id)
    if not len(rows):
        return rows, []
    own = vectors[rows]
    with np.errstate(over="ignore", invalid="ignore"):
        near = own @ weights
        error = (np.abs(own) @ np.abs(weights)) * (len(weights) + 4) * 2.0 ** -52
        low, high = near - error, near + error
    low, high = np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)
    if len(rows) > k:
        some = high >= np.partition(low, len(rows) - k)[len(rows) - k]
        rows, own = rows[some], own[some]
    w = [int(x) for x in weights.tolist()]
    scores = [sum(int(a) * b for a, b in zip(x, w, strict=True)) for x in own.tolist()]
    best = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
    return rows[best], [scores[i] for i in best]


class Block:
    """A block's rows of one length: the sliced ones, and the few with components beyond them."""

    def __init__(self, rows: list[tuple[int, bytes, bool, int]], n: int, left_out: int):
        small, large = ([r for r in rows if r[2] == big] for big in (False, True))
        column = lambda some, i: np.array([r[i] for r in some], np.int64)
        order = np.argsort(column(small, 0), kind="stable")
        small = [small[i] for i in order]
        self.sliced = SlicedBlock(column(small, 0), np.frombuffer(b"".join(r[1] for r in small), "<i8").reshape(len(small), n), left_out) if small else None
        self.copies = column(small, 3)
        self.ids, self.large_copies = column(large, 0), column(large, 3)
        self.large = np.frombuffer(b"".join(r[1] for r in large), "<f8").reshape(len(large), n)

    def top(self, query_id: int, data: bytes, big: bool, k: int) -> list[tuple[int, int, int]]:
        """(id, score, copies) of the k best rows and perhaps some more."""
        out = []
        weights = np.frombuffer(data, "<f8" if big else "<i8")
        if self.sliced is not None:
            if big:
                rows, scores = exact_top(self.sliced.ids, self.sliced.exact, query_id, weights, k)
            else:
                rows, scores = self.sliced.top_rows(query_id, weights, k)
                scores = scores.tolist()
            out += zip(self.sliced.ids[rows].tolist(), scores, self.copies[rows].tolist(), strict=True)
        if len(self.ids):
            rows, scores = exact_top(self.ids, self.large, query_id, weights.astype(np.float64), k)
            out += zip(self.ids[rows].tolist(), scores, self.large_copies[rows].tolist(), strict=True)
        return out


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, n, v, big): valid vectors with every component floor(scale * x), packed as 64-bit integers.

    Vectors without id, null, or with a null or non-finite component take no part.  A vector with a component beyond
    ``LARGEST`` is ``big`` and packed as floating-point numbers, which hold these whole numbers exactly.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            bad = np.append(0, np.cumsum(~np.isfinite(x)))
            ends = np.cumsum(np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
            starts = ends - np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(x * scale)
                wide = np.append(0, np.cumsum(np.abs(whole) > LARGEST))
                narrow = np.where(np.abs(whole) <= LARGEST, whole, 0).astype("<i8")
            ok = column.is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[starts])
            keep = np.flatnonzero(ok)
            big = (wide[ends] != wide[starts])[keep]
            packed = [(whole if b else narrow)[starts[i]:ends[i]].tobytes() for i, b in zip(keep.tolist(), big.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(keep)), pa.array((ends - starts)[keep], pa.int32()), pa.array(packed, pa.binary()), pa.array(big)],
                ["vec_id", "n", "v", "big"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .mapInArrow(run, "vec_id long, n int, v binary, big boolean")


def top_inner_products(vectors: DataFrame, every: int = 20, k: int = 20, block_rows: int = BLOCK_ROWS, left_out: int = LEFT_OUT,
                       chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query, the rows whose vec_id is divisible by ``every``.

    Rows are dealt evenly into blocks of about ``block_rows``, queries into chunks; a task asks one chunk of one block,
    and the k best rows of each are merged by query.  Vectors meet only those of their length.  Rows with the query's
    vec_id are its own and no candidates.  Every row is a candidate for itself: one that stands twice is found twice,
    and a query that stands twice finds each row twice.  Scores are exact; one that is no long is given as the nearest
    long.  Other columns are ignored; an empty table gives no rows.
    """
    rows = settle(integer_vectors(vectors).groupBy("vec_id", "n", "v", "big").agg(F.count("*").alias("times")), "vectors")
    asking = rows.filter(F.col("vec_id") % every == 0)
    blocks, chunks = max(1, -(-rows.count() // block_rows)), max(1, -(-asking.count() // chunk_queries))
    columns = ["vec_id", "n", "v", "big", "times"]
    part = lambda salt, many: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(many)).cast("int")
    every_of = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    own = rows.select(part(0, blocks).alias("_block"), every_of(chunks).alias("_chunk"), F.lit(0).alias("_query"), *columns)
    asked = asking.select(part(1, chunks).alias("_chunk"), every_of(blocks).alias("_block"), F.lit(1).alias("_query"), *columns)
    dealt = own.unionByName(asked).withColumn("_task", F.col("_block") * chunks + F.col("_chunk")).drop("_block", "_chunk")
    dealt = dealt.repartitionById(blocks * chunks, F.col("_task")).sortWithinPartitions("_task", "_query", "n", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, list] = {}
        made: dict[int, Block] = {}
        for batch in batches:
            at, out = batch.to_pydict(), []
            for query, vec_id, n, v, big, times in zip(*(at[c] for c in ("_query", *columns)), strict=True):
                if not query:
                    gathered.setdefault(n, []).append((vec_id, v, big, times))
                    continue
                if n in gathered:
                    made[n] = Block(gathered.pop(n), n, left_out)
                if n in made:
                    out += [(vec_id, i, max(-LONGEST - 1, min(LONGEST, s)), min(k, c * times)) for i, s, c in made[n].top(vec_id, v, big, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score", "copies"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = dealt.mapInArrow(run, FOUND).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
