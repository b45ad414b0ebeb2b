"""Operator 5: a toxicity classifier with counterfactual regularisation.

Logistic regression on indicators of words and their first letters.  Every labelled text that names an identity is
also taken with its identity terms swapped, and the loss has the squared change of the score besides, so what a
group is called can't carry weight.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm import classify
from gridspark.llm.hashing import join_hashes, runs, span_hashes

#: Groups of terms that take each other's place: a default for four languages, and a parameter.
IDENTITIES = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "natives"], ["old", "young"], ["deaf", "blind", "disabled"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["noirs", "blancs", "arabes"],
    ["frauen", "männer"], ["muslime", "christen", "juden"], ["schwarze", "weiße"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["negros", "blancos"],
]
#: Lengths in bytes of the word starts that are features, beside whole words.
STARTS = (4, 5, 6)
MODULUS, REMAINDER, THRESHOLD = 4, 2, 0.3
#: Weight of the squared weights, weight of the squared score changes, and steps of the fit.
RIDGE, FAIRNESS, STEPS = 1e-5, 1.0, 800
#: Least signed root of the likelihood ratio statistic of a feature that is kept.
LEAST_Z = 4.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100), ord("'")]] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words in lower case, and of their first bytes; every one once per text."""
    datas = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join([*datas, b""]), np.uint8)
    starts, ends = runs(_LETTER[data])
    rows = np.searchsorted(np.cumsum([len(x) + 1 for x in datas]), starts, side="right")
    hashes, owners = [span_hashes(data, starts, ends)], [rows]
    for n in STARTS:
        long = ends - starts >= n
        some = span_hashes(data, starts[long], starts[long] + n)
        hashes.append(join_hashes(some, np.full(len(some), n, np.uint64)))
        owners.append(rows[long])
    return classify.once(np.concatenate(hashes), np.concatenate(owners))


def swapper(groups: list[list[str]]):
    """A function that puts the next term of its group for every identity term of a text."""
    after = {x.lower(): g[(i + 1) % len(g)] for g in groups for i, x in enumerate(g)}
    if not after:
        return lambda text: text
    terms = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(after, key=len, reverse=True))) + r")\b", re.IGNORECASE)

    def swap(m: re.Match) -> str:
        new = after[m[0].lower()]
        return new.capitalize() if m[0][:1].isupper() else new

    return lambda text: terms.sub(swap, text)


def fit(y: np.ndarray, has: list[np.ndarray], would: list[np.ndarray], changed: np.ndarray, n_features: int, fairness: float = FAIRNESS,
        ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, intercept): mean logistic loss + ridge * weights^2 + fairness * mean squared change of the swapped texts' scores."""
    n = len(y)
    rows = np.repeat(np.arange(n), [len(x) for x in has])
    cols = np.concatenate([*has, np.zeros(0, np.int64)]).astype(np.int64)
    pairs = np.flatnonzero(changed)
    d_rows = np.concatenate([*(np.full(len(has[i]) + len(would[i]), k) for k, i in enumerate(pairs)), np.zeros(0, np.int64)]).astype(np.int64)
    d_cols = np.concatenate([*(x for i in pairs for x in (has[i], would[i])), np.zeros(0, np.int64)]).astype(np.int64)
    d_sign = np.concatenate([*(s for i in pairs for s in (np.ones(len(has[i])), -np.ones(len(would[i])))), np.zeros(0)])
    w, b = np.zeros(n_features), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam with a falling rate
        gap = classify.sigmoid(np.bincount(rows, w[cols], n) + b) - y
        g = np.bincount(cols, gap[rows], n_features) / n + 2 * ridge * w
        if len(pairs):
            change = np.bincount(d_rows, d_sign * w[d_cols], len(pairs))
            g += 2 * fairness / len(pairs) * np.bincount(d_cols, d_sign * change[d_rows], n_features)
        gb = gap.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate, c1, c2 = 0.1 * (1 - t / (steps + 1)), 1 - 0.9 ** t, 1 - 0.99 ** t
        w = w - rate * m / c1 / (np.sqrt(v / c2) + 1e-8)
        b -= rate * mb / c1 / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, identities: list[list[str]] = IDENTITIES, fairness: float = FAIRNESS,
          rows: int = classify.SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes, weights, intercept) from the labelled rows that aren't held out."""
    sample = classify.labelled_sample(docs, labels, "toxic", MODULUS, REMAINDER, rows)
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n1 in (0, n):  # nothing to tell apart
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    own, base = F.col("n1") / F.col("n"), n1 / n
    part = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(0.0)
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(F.col("n1"), own, F.lit(base)) + part(F.col("n") - F.col("n1"), 1 - own, F.lit(1 - base)))))
    chosen = classify.feature_counts(sample, features).withColumn("z", z).filter(F.col("z") >= LEAST_Z) \
        .orderBy(F.desc("z"), "feature").limit(classify.FEATURES).select("feature").collect()
    hashes = np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64))
    y, has, would, changed = classify.sample_indicators(sample, features, classify.Indicators(hashes), swapper(identities))
    weights, intercept = fit(y, has, would, changed, len(hashes), fairness)
    return hashes, weights, intercept


def score(docs: DataFrame, labels: DataFrame, identities: list[list[str]] = IDENTITIES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    Whole texts are scored; null texts count as empty, and empty texts get the score of the intercept.  Without
    labels of both kinds every score is the smoothed share of label 1.  Null ids and repeated rows are kept, each with
    its score; other columns are never read; an empty table gives no rows.
    """
    hashes, values = model(docs, labels, identities)
    return classify.score_documents(docs, features, values, hashes, MODULUS, REMAINDER, THRESHOLD)


def keep_clean(docs: DataFrame, labels: DataFrame, identities: list[list[str]] = IDENTITIES) -> DataFrame:
    """The rows of ``docs`` that ``score`` does not predict to be toxic, with all their columns.

    Without labels of both kinds there is no model, and all rows stay.  Null and empty texts are scored as empty ones;
    null ids and repeated rows are judged each by its text; columns of any other name are kept and not read; an
    empty table stays empty.
    """
    hashes, values = model(docs, labels, identities)
    return classify.keep_documents(docs, features, values, hashes, lambda x: x < THRESHOLD) if len(hashes) else docs


def model(docs: DataFrame, labels: DataFrame, identities: list[list[str]]):
    """(feature hashes, function to scores); without hashes there is nothing that tells texts apart."""
    hashes, weights, intercept = train(docs, labels, identities)
    return hashes, lambda columns, rows, n: classify.sigmoid(np.bincount(rows, weights[columns], n) + intercept)
