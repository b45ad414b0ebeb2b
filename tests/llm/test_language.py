"""The network's gradients, scores against plain loops, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from gridspark.llm import language as L

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, score double, held_out string, y int"


def test_gradients():
    own = L.Network.start(3, 1)
    for name in ("embedding", "filters", "offsets", "weights", "bias"):
        setattr(own, name, getattr(own, name).astype(np.float64))
    r = np.random.default_rng(0)
    windows, y = r.integers(0, 256, (5, 24)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, slopes = own.gradients(windows, y)
    for part, slope in zip(own.parts(), slopes, strict=True):
        flat = part.reshape(-1)
        for i in r.choice(np.flatnonzero(np.abs(slope.reshape(-1)) > 1e-6), 8):
            old, loss = flat[i], []
            for d in (1e-6, -1e-6):
                flat[i] = old + d
                loss.append(own.gradients(windows, y)[0])
            flat[i] = old
            assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(slope.reshape(-1)[i], rel=1e-3, abs=1e-7)


def test_scores_are_those_of_plain_loops():
    own = L.Network.start(4, 2)
    own.offsets += 0.1
    texts = [b"", b"a", b"some words", b"x" * 127, bytes(range(32, 127)) * 4]
    got = L.predict(texts, own)
    stride = L.LENGTH - L.FILTERS[-1][0] + 1
    for data, p in zip(texts, got, strict=True):
        total, weight = np.zeros(4), 0.0
        for start in range(0, max(1, len(data)), stride):
            window = data[start:start + L.LENGTH].ljust(L.LENGTH, b"\0")
            best, f = [], 0
            for width, n in L.FILTERS:
                for _ in range(n):
                    responses = [sum(float(own.embedding[window[at + i]] @ own.filters[i * L.EMBEDDED:(i + 1) * L.EMBEDDED, f]) for i in range(width)) for at in range(stride)]
                    best.append(max(max(responses) + own.offsets[f], 0))
                    f += 1
            logits = np.array(best) @ own.weights + own.bias
            share = min(len(data) - start, stride) / stride
            total += share * (logits - np.log(np.exp(logits).sum()))
            weight += share
        mean = total / weight if weight else total
        assert p == pytest.approx(np.exp(mean) / np.exp(mean).sum(), abs=1e-4)


def test_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.n_chars) for r in docs.select("doc_id", "lang", "n_chars").collect()}
    got = L.identify(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.99
    short = [r for r in held if truth[r.doc_id][1] < 60]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in short) / len(short) > 0.9


def test_odd_rows(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in (("the cat sat on the mat " * 3, "en"), ("le chat est sur la table " * 3, "fr"))]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "123 .,!?\n\t", "en"), (103, "le chat " * 40000, None), (None, "the mat", "en"), (104, "le chat", None), (104, "le chat", None), (105, "Ж", None)]
    df = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (100, 101, 102))
    assert by[103].lang_pred == by[104].lang_pred == "fr" and by[None].lang_pred == "en" and by[None].held_out is False
    assert by[105].lang_pred in ("en", "fr") and sum(r.doc_id == 104 for r in got) == 2
    unlabelled = df.withColumn("lang", df.lang.substr(9, 1)).filter("false").unionByName(df.selectExpr("doc_id", "text", "cast(null as string) as lang", "score", "held_out", "y"))
    assert {(r.lang_pred, r.score) for r in L.identify(unlabelled).collect()} == {("und", 0.0)}
    one = L.identify(df.filter("lang = 'fr'")).collect()
    assert {(r.lang_pred, r.score) for r in one} <= {("fr", 1.0), ("und", 0.0)}
    assert L.identify(df.limit(0)).count() == 0


def test_the_sample_is_bounded_and_even(spark):
    rows = [(i, f"word{i} the", "en") for i in range(3000)] + [(i, f"mot{i} le", "fr") for i in range(3000, 3050)] + [(9, "copy of a text", "en")] * 2000
    df = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SCHEMA).repartition(4)
    windows, y, names = L.sample_windows(df, texts=100)
    assert names == ["en", "fr"] and windows.shape == (len(y), L.LENGTH)
    texts = np.bincount(y) / L.SAMPLE_WINDOWS
    assert 60 < texts[0] <= 100 and 25 < texts[1] <= 50
