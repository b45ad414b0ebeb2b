"""Operator 11: language identification by a byte convolutional network.

A text's bytes (A-Z in lower case) are cut into windows of fixed length.  In a window, filters of several widths run over embedded bytes,
each filter keeps its largest response, and a softmax over those gives the languages' probabilities.  A text's
probabilities are those of its windows' mean log-probabilities, weighted by how much of a window is text.  The network
is trained in numpy on windows of a bounded sample of the labelled texts; every byte of every text is then scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.classify import held_out
from gridspark.llm.common import steps, texts_of
from gridspark.scratch import settle

MODULUS, REMAINDER = 4, 2
#: The bounded sample: texts per language, languages (the most frequent), and windows per text.
SAMPLE_TEXTS, LANGUAGES, SAMPLE_WINDOWS = 1000, 256, 4
#: Bytes of a window, size of a byte's embedding, and (width, number) of the filters.
LENGTH, EMBEDDED, FILTERS = 128, 8, ((2, 16), (3, 24), (4, 24))
#: Windows of a training step and passes over the sample; first rate.
BATCH, PASSES, RATE = 128, 6, 0.01
#: Windows that are scored together.
TOGETHER = 256
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Embedding (256 x e), filters (w * e x f, zero beyond a filter's width), their offsets, and the softmax layer."""

    embedding: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(classes: int, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        f = sum(n for _, n in FILTERS)
        own = Network(rng.normal(0, 0.5, (256, EMBEDDED)), rng.normal(0, 0.3, (FILTERS[-1][0] * EMBEDDED, f)), np.zeros(f),
                      rng.normal(0, 0.1, (f, classes)), np.zeros(classes))
        own = Network(*(x.astype(np.float32) for x in own.parts()))
        own.filters *= mask()
        return own

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.offsets, self.weights, self.bias]

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes of every place of every window, with the next ones up to the largest width side by side."""
        width = FILTERS[-1][0]
        x = self.embedding[windows]
        places = windows.shape[1] - width + 1
        return np.concatenate([x[:, i:i + places] for i in range(width)], axis=2)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        c = self.columns(windows)
        return np.maximum((c.reshape(-1, c.shape[2]) @ self.filters).reshape(*c.shape[:2], -1).max(axis=1) + self.offsets, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        return log_softmax(self.pooled(windows) @ self.weights + self.bias)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """(mean loss, gradient of each part)."""
        n = len(windows)
        columns = self.columns(windows)
        responses = (columns.reshape(-1, columns.shape[2]) @ self.filters).reshape(*columns.shape[:2], -1)
        best = responses.argmax(axis=1)
        raw = np.take_along_axis(responses, best[:, None], axis=1)[:, 0] + self.offsets
        top = np.maximum(raw, 0)
        logp = log_softmax(top @ self.weights + self.bias)
        gap = np.exp(logp)
        gap[np.arange(n), y] -= 1
        gap /= n
        back = (gap @ self.weights.T) * (raw > 0)
        picked = columns[np.arange(n)[:, None], best]
        to_filters = np.einsum("nf,nfk->kf", back, picked) * mask()
        to_columns = back[:, :, None] * self.filters.T[None]
        to_embedding = np.zeros_like(self.embedding)
        for i in range(FILTERS[-1][0]):
            at = windows[np.arange(n)[:, None], best + i].ravel()
            part = to_columns[:, :, i * EMBEDDED:(i + 1) * EMBEDDED].reshape(-1, EMBEDDED)
            for e in range(EMBEDDED):
                to_embedding[:, e] += np.bincount(at, part[:, e], 256)
        return -float(logp[np.arange(n), y].mean()), [to_embedding, to_filters, back.sum(axis=0), top.T @ gap, gap.sum(axis=0)]


def mask() -> np.ndarray:
    """Which inputs each filter has: those within its width."""
    width = FILTERS[-1][0]
    return np.concatenate([np.repeat((np.arange(width * EMBEDDED) < w * EMBEDDED)[:, None], n, axis=1) for w, n in FILTERS], axis=1).astype(np.float32)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def windows_of(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, share of each that is text): every place a filter can stand at lies in one window."""
    stride = LENGTH - FILTERS[-1][0] + 1
    sizes = np.array([len(x) for x in datas], np.int64)
    count = np.maximum(1, -(-sizes // stride))
    data = np.concatenate([np.frombuffer(b"".join(datas), np.uint8), np.zeros(1, np.uint8)])
    text = np.repeat(np.arange(len(datas)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * stride
    first, end = (np.cumsum(sizes) - sizes)[text], np.cumsum(sizes)[text]
    at = (first + start)[:, None] + np.arange(LENGTH)
    windows = np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    return windows, text, np.minimum(sizes[text] - start, stride) / stride


def train(windows: np.ndarray, y: np.ndarray, classes: int, passes: int = PASSES, seed: int = 0) -> Network:
    """A network fitted by Adam with a falling rate."""
    own = Network.start(classes, seed)
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(p) for p in own.parts()] for _ in range(2))
    total = passes * -(-len(y) // BATCH)
    t = 0
    for _ in range(passes):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            t += 1
            some = order[at:at + BATCH]
            _, slopes = own.gradients(windows[some], y[some])
            rate = RATE * (1 - (t - 1) / total)
            for p, g, m, v in zip(own.parts(), slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-7)
    return own


def sample_windows(docs: DataFrame, texts: int = SAMPLE_TEXTS, languages: int = LANGUAGES) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(windows, class of each, languages) of a bounded sample of the texts with a language that aren't held out.

    Texts are taken by a hash, about the same number for every language, and repeated texts count once.  Of a text there
    are up to ``SAMPLE_WINDOWS`` windows: whole ones from anywhere in it, and pieces of every shorter length.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, REMAINDER) & F.col("text").rlike(r"\p{L}"))
    counts = settle(own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages), "languages")
    names = sorted(r["lang"] for r in counts.collect())
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    near = own.join(counts, "lang").withColumn("_place", place).filter(F.col("_place") * F.col("count") < 1.5 * texts).select("lang", "_place", "text").distinct()
    near = near.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_place", "text"))).filter(F.col("_rank") <= texts)
    number = {x: i for i, x in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            langs, out, owners = step.column("lang").to_pylist(), [], []
            for lang, place, text in zip(langs, step.column("_place").to_pylist(), texts_of(step), strict=True):
                data = text.encode().lower()
                rng = np.random.default_rng(int(place * (1 << 40)))
                for i in range(SAMPLE_WINDOWS):
                    size = LENGTH if i % 2 == 0 else int(rng.integers(4, LENGTH))
                    at = int(rng.integers(0, max(1, len(data) - size + 1))) if i or len(data) <= LENGTH else 0
                    out.append(data[at:at + size].ljust(LENGTH, b"\0"))
                    owners.append(number[lang])
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int32()), pa.array(out, pa.binary())], ["y", "window"])

    found = near.mapInArrow(cut, "y int, window binary").toArrow().sort_by([("y", "ascending"), ("window", "ascending")])
    data = np.frombuffer(b"".join(found.column("window").to_pylist()), np.uint8).reshape(-1, LENGTH)
    return data, found.column("y").to_numpy().astype(np.int64), names


def predict(datas: list[bytes], network: Network) -> np.ndarray:
    """Probabilities of the languages for every text."""
    out, weight = np.zeros((len(datas), len(network.bias))), np.zeros(len(datas))
    windows, text, share = windows_of(datas)
    for at in range(0, len(windows), TOGETHER):
        some = slice(at, at + TOGETHER)
        logp = network.log_probabilities(windows[some]) * share[some, None]
        for k in range(logp.shape[1]):
            out[:, k] += np.bincount(text[some], logp[:, k], len(datas))
        weight += np.bincount(text[some], share[some], len(datas))
    return np.exp(log_softmax(out / np.maximum(weight, 1e-9)[:, None]))


def identify(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every text of ``docs`` (doc_id, text, lang).

    The network learns from rows with a language that aren't held out; the language itself, the source and the id are no
    inputs.  ``score`` is the probability of the predicted language.  Null texts, empty ones and those without a letter
    get ``und`` and score 0, as does every text if there is nothing to learn from; with one language all others get it.
    Long texts are scored whole.  Null ids (never held out) and repeated rows are kept.  Other columns are never read;
    an empty table gives no rows.
    """
    windows, y, names = sample_windows(docs, texts)
    network = train(windows, y, len(names)) if len(y) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            own = texts_of(step)
            some = [i for i, t in enumerate(own) if network is not None and _LETTER.search(t)]
            lang, score = [UNKNOWN] * len(own), np.zeros(len(own))
            if some:
                p = predict([own[i].encode().lower() for i in some], network)
                for i, k in zip(some, p.argmax(axis=1).tolist(), strict=True):
                    lang[i] = names[k]
                score[some] = p.max(axis=1)
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "lang_pred", "score")
