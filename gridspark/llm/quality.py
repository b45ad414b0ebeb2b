"""Operator 8: a quality classifier, a linear support-vector machine on indicators scaled by naive Bayes.

Indicators of n-grams: words, and runs of one to three word shapes (kinds of characters in order; a word that
repeats the one before has a shape of its own).  Each is scaled by the log ratio of its smoothed counts in the classes,
a text's vector is scaled to length one, and the hinge-loss model is fitted by dual coordinate descent.  Margins
become probabilities by a sigmoid fitted on a fifth of the sample that the machine hasn't seen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm import classify
from gridspark.llm.hashing import join_hashes, runs, span_hashes

MODULUS, REMAINDER, THRESHOLD = 5, 0, 0.3
#: Cost of a margin error, passes over the sample, and smoothing of counts.
COST, PASSES, SMOOTHING = 1.0, 20, 1.0

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.arange(256, dtype=np.uint8)  # a sign stands for itself
_KIND[ord("a"):ord("z") + 1] = ord("a")
_KIND[ord("A"):ord("Z") + 1] = ord("A")
_KIND[ord("0"):ord("9") + 1] = ord("0")
_KIND[0x80:] = 0  # parts of longer characters tell nothing
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words, and of one to three shapes in a row; every one once per text."""
    datas = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*datas, b""]), np.uint8)
    starts, ends = runs(~_SPACE[data])
    rows = np.searchsorted(np.cumsum([len(x) + 1 for x in datas]), starts, side="right")
    words = span_hashes(data, starts, ends)
    kind = _KIND[data]
    known = np.flatnonzero(kind)
    kept = kind[known]
    new = np.ones(len(kept), bool)
    new[1:] = kept[1:] != kept[:-1]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    # a run goes on across word ends only between equal kinds, so a word's first known byte always counts
    word_of = np.cumsum(first[:len(data)])[known]
    new[1:] |= word_of[1:] != word_of[:-1]
    place = np.zeros(len(data) + 1, np.int64)
    place[known[new] + 1] = 1
    place = np.cumsum(place)
    shapes = span_hashes(kept[new], place[starts], place[ends])
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    shapes[same] = _AGAIN
    hashes, owners = [words, join_hashes(shapes)], [rows, rows]
    for n in (2, 3):
        if len(shapes) >= n:
            within = rows[n - 1:] == rows[:len(rows) - n + 1]
            hashes.append(join_hashes(*(shapes[i:len(shapes) - n + 1 + i] for i in range(n)))[within])
            owners.append(rows[n - 1:][within])
    return classify.once(np.concatenate(hashes), np.concatenate(owners))


def dual_coordinate_descent(has: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, n_features: int, cost: float = COST,
                            passes: int = PASSES) -> np.ndarray:
    """Weights (the last is the intercept) of the hinge-loss machine: one dual variable at a time, each at its best in [0, cost]."""
    w, alpha = np.zeros(n_features + 1), np.zeros(len(has))
    square = np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(0)
    for _ in range(passes):
        worst = 0.0
        for i in order.permutation(len(has)):
            c, v, s = has[i], values[i], sign[i]
            slope = s * (float(w[c] @ v) + w[-1]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            move = new - alpha[i]
            if move:
                w[c] += move * s * v
                w[-1] += move * s
                alpha[i] = new
                worst = max(worst, abs(move))
        if worst < 1e-3 * cost:
            break
    return w


def unit(columns: np.ndarray, rows: np.ndarray, n: int, ratio: np.ndarray) -> np.ndarray:
    """Values of indicators: log count ratios, each text's vector scaled to length one."""
    x = ratio[columns]
    length = np.sqrt(np.bincount(rows, x * x, n))
    return x / np.maximum(length, 1e-12)[rows]


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the probability of label 1, by Newton steps on smoothed targets."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    best = np.array([1.0, 0.0])
    for _ in range(50):
        p = classify.sigmoid(x @ best)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (best - [1, 0]))
        best = best - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(best[0]), 1e-3), float(best[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = classify.SAMPLE_ROWS):
    """(feature hashes, ratios, weights, slope, offset) from the labelled rows that aren't held out."""
    sample = classify.labelled_sample(docs, labels, "quality", MODULUS, REMAINDER, rows)
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if min(n1, n - n1) < 2:  # nothing to tell apart
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(1), 1.0, float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    share1, share0 = (F.col("n1") + SMOOTHING) / (n1 + 2 * SMOOTHING), (F.col("n") - F.col("n1") + SMOOTHING) / (n - n1 + 2 * SMOOTHING)
    ratio = F.log(share1 / share0)
    weight = F.abs(ratio) * F.sqrt(F.col("n"))
    chosen = classify.feature_counts(sample, features).withColumn("ratio", ratio).orderBy(weight.desc(), "feature") \
        .limit(classify.FEATURES).select("feature", "ratio").collect()
    hashes, ratios = np.array([r["feature"] for r in chosen], np.int64).view(np.uint64), np.array([r["ratio"] for r in chosen])
    order = np.argsort(hashes)
    hashes, ratios = hashes[order], ratios[order]
    y, has, _, _ = classify.sample_indicators(sample, features, classify.Indicators(hashes))
    values = [unit(c, np.zeros(len(c), np.int64), 1, ratios) for c in has]
    test = np.zeros(len(y), bool)
    for k in (0, 1):  # a fifth of either class
        test[np.flatnonzero(y == k)[::5]] = True
    some = np.flatnonzero(~test)
    w = dual_coordinate_descent([has[i] for i in some], [values[i] for i in some], 2 * y[some] - 1, len(hashes))
    margins = np.array([float(w[has[i]] @ values[i]) + w[-1] for i in np.flatnonzero(test)])
    slope, offset = sigmoid_fit(margins, y[test])
    return hashes, ratios, w, slope, offset


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    Whole texts are scored; null texts count as empty, and empty texts get the score of the intercept.  Without two
    labels of either kind every score is the smoothed share of label 1.  Null ids and repeated rows are kept, each with
    its score; other columns are never read; an empty table gives no rows.
    """
    hashes, values = model(docs, labels)
    return classify.score_documents(docs, features, values, hashes, MODULUS, REMAINDER, THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``score`` predicts to be of quality, with all their columns.

    Without two labels of either kind there is no model, and all rows stay.  Null and empty texts are scored as empty ones;
    null ids and repeated rows are judged each by its text; columns of any other name are kept and not read; an empty
    table stays empty.
    """
    hashes, values = model(docs, labels)
    return classify.keep_documents(docs, features, values, hashes, lambda x: x >= THRESHOLD) if len(hashes) else docs


def model(docs: DataFrame, labels: DataFrame):
    """(feature hashes, function to scores); without hashes there is nothing that tells texts apart."""
    hashes, ratios, w, slope, offset = train(docs, labels)

    def values(columns: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        margin = np.bincount(rows, w[:-1][columns] * unit(columns, rows, n, ratios), n) + w[-1]
        return classify.sigmoid(slope * margin + offset)

    return hashes, values
