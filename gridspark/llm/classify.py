"""What the two text classifiers share: a bounded labelled sample, hashed indicators, and scoring of all rows.

Labels are learnt from a sample of at most ``SAMPLE_ROWS`` labelled rows, the first by a hash of their ids.  A feature
is the 64-bit hash of what it stands for, and a model keeps the ``FEATURES`` most useful of those that the sample
has at least ``LEAST_ROWS`` times.  A feature that the sample doesn't have counts for nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import steps, texts_of
from gridspark.scratch import settle

SAMPLE_ROWS, FEATURES, LEAST_ROWS = 8000, 8192, 5
#: Tasks that read the sample, at most.
SAMPLE_TASKS = 8

#: Texts to (feature hashes, number of the text) with every feature once per text, texts ascending.
Features = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def once(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, text) pairs, by text and feature."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row's labels are kept from learning; a row without id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y): the sample of labelled rows that aren't held out, written to the shared folder.

    Labels other than 0 and 1 are left aside; of several labels of a document the largest counts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    own = own.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    ids = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    keys = np.array(sorted(r["doc_id"] for r in ids), np.int64)
    known = {r["doc_id"]: r["y"] for r in ids}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = np.array([-1 if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            found = np.flatnonzero(np.isin(doc_ids, keys) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            own = batch.take(pa.array(found))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([known[x] for x in doc_ids[found].tolist()], pa.int32())], ["doc_id", "text", "y"])

    return settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pick, "doc_id long, text string, y int"), "sample")


def feature_counts(sample: DataFrame, features: Features) -> DataFrame:
    """(feature, n, n1): rows of the sample with a feature, and those labelled 1; features of too few rows are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            hashes, rows = features(texts_of(step))
            cut = np.searchsorted(rows, np.arange(step.num_rows + 1))
            values = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([step.column("y"), values], ["y", "features"])

    rows = sample.select("text", "y").coalesce(SAMPLE_TASKS).mapInArrow(run, "y int, features array<long>")
    return rows.select("y", F.explode("features").alias("feature")).groupBy("feature") \
        .agg(F.count("*").alias("n"), F.sum("y").alias("n1")).filter(F.col("n") >= LEAST_ROWS)


@dataclass
class Indicators:
    """A bounded dictionary of features: ascending hashes, and what they have in texts."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.hint = np.zeros(1 << 20, bool)  # most features of a text are not in the dictionary
        self.hint[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column, row) of the features that the dictionary has."""
        near = np.flatnonzero(self.hint[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(self.hashes) or not len(near):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[near]
        return at[hit], rows[near[hit]]


def sample_indicators(sample: DataFrame, features: Features, known: Indicators, change: Callable[[str], str] | None = None):
    """Per row of the sample: label, columns it has, and columns that its changed text has (None where nothing changes).

    This is the bounded training set; it goes to the driver.
    """
    hashes = known.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Indicators(hashes)
        for step in steps(batches):
            texts = texts_of(step)
            after = [change(t) if change else t for t in texts]
            out = []
            for some in (texts, after):
                columns, rows = own.find(*features(some))
                cut = np.searchsorted(rows, np.arange(len(texts) + 1))
                out.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(columns, pa.int32())))
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("y"), *out, pa.array([a != b for a, b in zip(texts, after, strict=True)])],
                                             ["doc_id", "y", "has", "would", "changed"])

    rows = sample.coalesce(SAMPLE_TASKS).mapInArrow(run, "doc_id long, y int, has array<int>, would array<int>, changed boolean")
    found = rows.toArrow().sort_by("doc_id")
    lists = [[np.asarray(x, np.int64) for x in found.column(c).to_pylist()] for c in ("has", "would")]
    return np.array(found.column("y").to_pylist(), np.int64), lists[0], lists[1], np.array(found.column("changed").to_pylist(), bool)


def score_documents(docs: DataFrame, features: Features, score: Callable, hashes: np.ndarray, modulus: int, remainder: int, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``score`` turns (columns, rows, number of texts) into scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Indicators(hashes)
        for step in steps(batches):
            values = score(*own.find(*features(texts_of(step))), step.num_rows)
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, features: Features, score: Callable, hashes: np.ndarray, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose scores ``keep`` accepts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Indicators(hashes)
        for step in steps(batches):
            yield step.filter(pa.array(keep(score(*own.find(*features(texts_of(step))), step.num_rows))))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
