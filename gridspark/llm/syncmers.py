"""Operator 1: document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash of the s-mers inside it belongs to its first or its last
s-mer.  That depends on the k-mer alone, so equal passages have equal anchors wherever they stand, and positions of
equal anchors can be matched.  A fingerprint keeps the smallest hashes of a text's anchors (all, if they are few).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import order_bounds, rank_in, shuffle_parts, steps, texts_of

#: Code points of an anchor and of its inner substrings, and hashes kept of a text.
K, SMALL, KEPT = 16, 8, 128
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M2
    x = (x ^ x >> np.uint64(27)) * _M3
    return x ^ x >> np.uint64(31)


def anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of each text's anchors; a text without any has itself as its only one, an empty text none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    at, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(points) >= K:
        h, width = (points + _M1) * _M2, 1
        while width < SMALL:
            h, width = h[:-width] * _M3 + (h[width:] ^ h[width:] >> np.uint64(29)), 2 * width
        h = _mix(h)
        span = K - SMALL + 1
        low, width = h, 1
        while width < span:
            step = min(width, span - width)
            low, width = np.minimum(low[:-step], low[step:]), width + step
        edge = (h[:len(low)] == low) | (h[span - 1:] == low)
        edge &= np.repeat(ends, sizes)[:len(low)] - np.arange(len(low)) >= K  # within one text
        at = np.flatnonzero(edge)
        hashes = _mix(h[at] * _M1 + h[at + K - SMALL])
    cut = np.searchsorted(at, np.append(0, ends)).tolist()
    out = []
    for i, (text, start) in enumerate(zip(texts, (ends - sizes).tolist(), strict=True)):
        own, found = at[cut[i]:cut[i + 1]] - start, hashes[cut[i]:cut[i + 1]]
        if text and not len(own):
            own, found = np.zeros(1, np.int64), np.array([int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")], np.uint64)
        out.append((own, found))
    return out


def smallest(hashes: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The smallest distinct hashes, ascending, as unsigned 32-bit."""
    return np.unique((hashes >> np.uint64(32)).astype(">u4"))[:kept]


def fingerprints(texts: list[str], kept: int = KEPT) -> list[np.ndarray]:
    """Each text's smallest distinct anchor hashes."""
    return [smallest(h, kept) for _, h in anchors(texts)]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of anchors that two texts have in common, twice the common over the sum of both, from their fingerprints.

    Among the ``kept`` smallest hashes of both, those in both estimate the overlap (exact if no fingerprint is full).
    Two empty texts are alike, an empty and another one are not.
    """
    x, y = set(a.tolist()), set(b.tolist())
    low = sorted(x | y)
    low = low[:kept] if max(len(x), len(y)) >= kept else low
    if not low:
        return 1.0
    both = sum(1 for v in low if v in x and v in y)
    return 2 * both / (len(low) + both)


def whole_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The same share, exact: from the distinct hashes of all anchors of both texts."""
    if not len(a) + len(b):
        return 1.0
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def document_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, positions, hashes) of every text: its anchors with their code-point positions.

    Null texts count as empty; null ids and repeated rows are kept; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            texts = texts_of(step)
            found = anchors(texts)
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([p for p, _ in found], pa.list_(pa.int64())),
                 pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))], ["doc_id", "n_chars", "positions", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_chars long, positions array<long>, hashes array<long>")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt into ascending ranges of doc_id and sorted; each range ends with the next one's first rows (``_extra``).

    After the last range come the first rows of all.  So every row's next one is in its own task.
    """
    bounds = order_bounds(docs, "doc_id", parts)
    dealt = docs.withColumn("_part", rank_in(bounds, F.col("doc_id")).cast("int"))
    heads = dealt.groupBy("_part").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none")).orderBy("_part").collect()
    if not heads:
        return dealt.withColumn("_extra", F.lit(False))
    firsts, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, r in enumerate(heads):
        firsts[r["_part"]] = None if r["none"] else r["first"]
        before[r["_part"]] = heads[i - 1]["_part"]
    at = F.col("_part") + 1
    head = F.col("doc_id").eqNullSafe(F.element_at(F.array(*(F.lit(x).cast("long") for x in firsts)), at))
    own = F.struct(F.col("_part"), F.lit(False).alias("_extra"))
    again = F.struct(F.element_at(F.array(*map(F.lit, before)), at).alias("_part"), F.lit(True).alias("_extra"))
    rows = dealt.select("doc_id", "text", F.explode(F.when(head, F.array(own, again)).otherwise(F.array(own))).alias("_to"))
    rows = rows.select("doc_id", "text", "_to._part", "_to._extra").repartitionById(len(bounds) + 1, F.col("_part"))
    return rows.sortWithinPartitions("_part", "_extra", "doc_id", "text")


def compare_documents(docs: DataFrame, parts: int | None = None, whole: bool = False) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; and its likeness to the next text's.

    The edited text has the last quarter of the code points replaced by as many of the next document, in ascending
    order of doc_id (nulls first, rows with the same id by text, after the last the first).  Null texts count as
    empty; repeated rows are kept; a single row is its own next; other columns are ignored; an empty table gives none.
    With ``whole`` likenesses come from all anchors of both texts, else from their fingerprints.
    """
    def prints_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(fingerprint, what is compared) of each text."""
        found = [(smallest(h), h) for _, h in anchors(texts)]
        return [(f, np.unique(h) if whole else f) for f, h in found]

    alike = whole_likeness if whole else likeness
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts or shuffle_parts(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, which waits for its next
        over = False
        for step in steps(batches):
            if over:  # only the first of the next range's rows is needed
                continue
            ids, texts, extra = step.column("doc_id").to_pylist(), texts_of(step), step.column("_extra").to_pylist()
            n = extra.index(True) + 1 if True in extra else len(ids)
            over = n < len(ids) or extra[n - 1]
            rows = held + list(zip(ids[:n], texts[:n], prints_of(texts[:n]), strict=True))
            held = rows[-1:]
            if len(rows) < 2:
                continue
            edited = [t[:len(t) - len(t) // 4] + after[:len(t) // 4] for (_, t, _), (_, after, _) in zip(rows, rows[1:])]
            prints = prints_of(edited)
            own = rows[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _, _ in own], pa.int64()), pa.array([len(t) for _, t, _ in own], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                 pa.array([f.tobytes().hex() for *_, (f, _) in own], pa.string()), pa.array([f.tobytes().hex() for f, _ in prints], pa.string()),
                 pa.array([alike(f, g) for (*_, (_, f)), (_, g) in zip(own, prints, strict=True)], pa.float64()),
                 pa.array([alike(a[2][1], b[2][1]) for a, b in zip(rows, rows[1:])], pa.float64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, RESULT)
