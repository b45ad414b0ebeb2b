"""Components of the shingle join against comparing every pair of texts."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import jaccard
from gridspark.llm.components import components
from gridspark.llm.shingles import ordered_sets, set_keys, shingles, signature
from gridspark.llm.sigtree import Forest

SCHEMA = "doc_id long, text string, k long, n int, label long, grp string"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain_set(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 5 >= 4 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                    a, b = label[i], label[j]
                    label = [a if x == b else x for x in label]
    name = {}
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None and (name.get(x) is None or d < name[x]):
            name[x] = d
    return sorted(((d, len(s), name.get(x)) for (d, _), s, x in zip(rows, sets, label, strict=True)), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAÉ \t\n\x0b\x1c ")), max_size=5))
def test_shingles(texts):
    h, cut = ordered_sets(*shingles(texts), len(texts))
    sets = [plain_set(t) for t in texts]
    assert np.diff(cut).tolist() == [len(s) for s in sets]
    got = [frozenset(h[a:b].tolist()) for a, b in zip(cut, cut[1:])]
    keys = set_keys(h, cut).tolist()
    for i in range(len(texts)):
        for j in range(i):
            assert len(got[i] & got[j]) == len(sets[i] & sets[j])
            assert (keys[i] == keys[j]) == (sets[i] == sets[j])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 150), st.booleans())
def test_forest(seed, g, cross):
    r = np.random.default_rng(seed)
    base = [np.unique(r.integers(0, 2**63, int(n)).astype(np.uint64)) for n in r.integers(4, 90, 6)]
    sets = []
    for _ in range(g):
        b = base[r.integers(6)]
        keep = b[r.random(len(b)) > r.choice([0, 0.02, 0.1])]
        sets.append(np.unique(np.append(keep, r.integers(0, 2**63, int(r.integers(1, 6))).astype(np.uint64))))
    n = np.array([len(s) for s in sets])
    side = r.random(g) < 0.3
    forest = Forest(n, [signature(s) for s in sets], sets)
    links = forest.link(np.flatnonzero(side), np.flatnonzero(~side)) if cross else forest.link()

    def parts(pairs):
        label = list(range(g))
        for i, j in pairs:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
        return {tuple(i for i in range(g) if label[i] == x) for x in label}

    real = [(i, j) for i in range(g) for j in range(i) if (not cross or side[i] != side[j]) and (b := len(np.intersect1d(sets[i], sets[j]))) * 9 >= 4 * (n[i] + n[j])]
    assert parts(links) == parts(real)
    loose = Forest(n, [signature(s) for s in sets]).link()
    for part in parts(real):
        assert any(set(part) <= set(p) for p in parts(loose))


def corpus(seed, base=12, copies=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeFGé") for _ in range(r.randint(2, 6)))
    rows, i = [], 0
    common = " ".join(word() for _ in range(30))
    for _ in range(base):
        w = [word() for _ in range(r.choice([3, 5, 9, 40, 120, 400]))]
        for _ in range(copies):
            v = list(w)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                v[r.randrange(len(v))] = word()
            if r.random() < 0.3:
                v = v[:max(1, int(len(v) * r.uniform(0.7, 1)))]
            rows.append((i, " ".join(v) + (" " + common if r.random() < 0.2 else "")))
            i += r.randint(1, 3)
    rows += [(10**6, ""), (10**6 + 1, None), (None, rows[0][1]), (None, "only this one has no id at all"), (rows[5][0], rows[40][1]), (10**6 + 2, " \t\n"), (3, rows[3][1])]
    rows += [(2 * 10**6 + j, "A  b\tc D e f g") for j in range(4)] + [(2 * 10**6 - 1, "w " * 30000), (2 * 10**6 - 2, "w " * 31000), (5 * 10**6, "x" * 100000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [2048, 8])
def test_components_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus(chunk)
    df = spark.createDataFrame([(*x, 1, 1, 1, "g") for x in rows], SCHEMA).repartition(3)
    got = jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == plain_components(rows)


def test_driver_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == plain_components(rows)


def test_nothing(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(0, 300)] + [(500, 500 + i) for i in range(200)] + [(r.randrange(1000, 2000), r.randrange(1000, 2000)) for _ in range(600)] + [(7, 7)]
    label = {x: x for p in links for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    got = {r.k: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label
