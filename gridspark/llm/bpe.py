"""Operator 6: byte-level BPE by ranks, with pre-tokens found by scans over code-point classes.

A text becomes an array of code-point classes.  A small automaton reads classes and says where a pre-token
starts; as its transition functions compose associatively, blocks of a text are run from every state at once,
the blocks' functions are composed, and then each block is read from its true state.  The slices between starts
are encoded by merging pairs, with a cache.  All of it works on arrays over many texts; no regex is involved.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import steps, texts_of

# classes of code points: letters, numbers, others, a contraction's apostrophe with one or two letters to come, a
# space or other white space before a visible character, the same elsewhere, and the gap between texts
L, N, O, A1, A2, SP, WS, S, GAP = range(9)  # noqa: E741
# states: at a start; in letters, numbers, others; in white space; after a space that joins what follows; letters of a
# contraction to come; after a piece that ends here
START, IN_L, IN_N, IN_O, IN_S, JOIN, ONE, TWO, END = range(9)
#: White space of Unicode, as ranges of code points, and the contractions.
SPACES = [(9, 13), (32, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288)]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
BLOCK = 64
#: Slices kept by a worker, and the longest slice that is kept.
CACHE_SLICES, CACHE_CHARS = 250_000, 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece starts here" by class and state."""
    to, cut = np.zeros((9, 9), np.uint8), np.ones((9, 9), bool)
    for kind, state in ((L, IN_L), (N, IN_N), (O, IN_O), (A1, IN_O), (A2, IN_O)):
        to[kind, :] = state
        cut[kind, [state, JOIN]] = False
    for kind, state in ((A1, ONE), (A2, TWO)):  # a contraction, unless the apostrophe belongs to a run of others
        to[kind, [START, IN_L, IN_N, IN_S, END]] = state
    to[L, [TWO, ONE]] = ONE, END
    cut[L, [TWO, ONE]] = False
    to[SP, :], to[WS, :], to[S, :], to[GAP, :] = JOIN, END, IN_S, START
    cut[S, IN_S] = False
    return to, cut


TO, CUT = _automaton()


def _class_table() -> np.ndarray:
    names = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    kinds = np.full(0x110000, O, np.uint8)
    kinds[names == "L"], kinds[names == "N"] = L, N
    for a, b in SPACES:
        kinds[a:b + 1] = S
    return kinds


_kinds: list[np.ndarray] = []


def classes(points: np.ndarray) -> np.ndarray:
    """Classes of code points; the gap between texts is 0xFFFFFFFF, and the last point is a gap."""
    if not _kinds:
        _kinds.append(_class_table())
    gap = points == 0xFFFFFFFF
    kind = _kinds[0][np.where(gap, 0, points)]
    kind[gap] = GAP
    after = np.append(kind[1:], GAP)
    last = (kind == S) & (after != S) & (after != GAP)
    kind[last] = np.where(points[last] == 32, SP, WS)
    at = np.flatnonzero(points == 39)
    padded = np.append(points, [0xFFFFFFFF] * 2)
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, [ord(x) for x in CONTRACTIONS if len(x) == 1])
    long = np.logical_or.reduce([(one == ord(x[0])) & (two == ord(x[1])) for x in CONTRACTIONS if len(x) == 2])
    kind[at[long]], kind[at[short]] = A2, A1
    return kind


def compose_scan(functions: np.ndarray) -> np.ndarray:
    """State before each block, from START: an exclusive scan that composes functions (row: block, column: state)."""
    n = len(functions)
    if n == 1:
        return np.array([START], np.uint8)
    odd = n % 2
    pairs = functions[:n - odd].reshape(n // 2, 2, -1)
    both = np.take_along_axis(pairs[:, 1], pairs[:, 0], axis=1)
    even = compose_scan(both)
    out = np.empty(n, np.uint8)
    out[0:n - odd:2] = even
    out[1::2] = pairs[np.arange(n // 2), 0, even]
    if odd:
        out[-1] = both[-1][even[-1]]
    return out


def starts(points: np.ndarray) -> np.ndarray:
    """Where pieces start (and every gap)."""
    kind = classes(points)
    n = -(-len(kind) // BLOCK)
    grid = np.full(n * BLOCK, GAP, np.uint8)
    grid[:len(kind)] = kind
    columns = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
    wide = TO.ravel()
    run = np.repeat(np.arange(9, dtype=np.uint8)[None, :], n, axis=0)
    for column in columns:
        run = wide[(column.astype(np.uint16) * 9)[:, None] + run]
    state, cut = compose_scan(run), np.empty(columns.shape, bool)
    for j, column in enumerate(columns):
        at = column.astype(np.uint16) * 9 + state
        cut[j], state = CUT.ravel()[at], wide[at]
    return np.flatnonzero(cut.T.ravel()[:len(kind)])


class RankEncoder:
    """Encodes and decodes by a rank file (base64 token and rank per line)."""

    def __init__(self, file: str):
        with open(file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {i: x for x, i in self.ranks.items()}
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: merge the adjacent pair of the lowest rank, the leftmost first, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is piece[i:ends[i]]
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not live[i] or ends[i] >= end or (j := ends[i]) >= n or ends[j] != end:
                continue
            live[j], ends[i] = False, end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i:ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end))
        return [ranks[piece[i:ends[i]]] for i in range(n) if live[i]]

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """Per text: ids as little-endian unsigned 32-bit bytes, and the code points at which its pieces start."""
        if not texts:
            return []
        if len(self.known) > CACHE_SLICES:
            self.known.clear()
        known, whole = self.known, "\x00".join([*texts, ""])
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4").copy()
        sizes = np.array([len(t) for t in texts], np.int64)
        gaps = np.cumsum(sizes + 1) - 1
        points[gaps] = 0xFFFFFFFF
        cut = starts(points)
        ends = np.append(cut[1:], len(points))
        keep = points[cut] != 0xFFFFFFFF
        cut, ends = cut[keep], ends[keep]
        slices = [whole[a:b] for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
        extra = {}
        for x in {x for x in slices if x not in known}:
            (known if len(x) <= CACHE_CHARS else extra)[x] = np.array(self.merge(x.encode()), "<u4").tobytes()
        ids = [extra[x] if x in extra else known[x] for x in slices] if extra else list(map(known.__getitem__, slices))
        to = np.searchsorted(cut, gaps).tolist()
        return [(b"".join(ids[a:b]), cut[a:b] - (gap - size)) for a, b, gap, size in zip([0, *to], to, gaps.tolist(), sizes.tolist())]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[str, RankEncoder] = {}


def rank_encoder(file: str) -> RankEncoder:
    if file not in _made:
        _made[file] = RankEncoder(file)
    return _made[file]


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids, offsets): ids of every text of ``docs``, and where its pieces start.

    Ids are little-endian unsigned 32-bit, offsets code points.  Null texts count as empty; null ids and repeated
    rows are kept as they are; other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_encoder(ranks)
        for step in steps(batches):
            found = own.encode(texts_of(step))
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), pa.array([len(x) // 4 for x, _ in found], pa.int64()), pa.array([x for x, _ in found], pa.binary()),
                 pa.array([y for _, y in found], pa.list_(pa.int64()))], ["doc_id", "n_tokens", "ids", "offsets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, offsets array<long>")


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_encoder(ranks)
        for step in steps(batches):
            ids = [x for x, _ in own.encode(texts_of(step))]
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
