import hashlib
import random

import numpy as np
import pytest

from gridspark.llm import queries, syncmers
from gridspark.llm.syncmers import K, KEPT, SMALL

SCHEMA = "doc_id long, text string, _part string, _extra int, first int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéß中𝔘") for _ in range(r.randint(1, 9))) for _ in range(n))


def test_anchors_depend_on_the_passage_alone():
    a, passage, b = words(1, 60), words(2, 80), words(3, 60)
    (p, h), (q, g) = syncmers.anchors([passage, a + passage + b])
    inside = {(x - len(a), y) for x, y in zip(q.tolist(), g.tolist()) if len(a) <= x <= len(a) + len(passage) - K}
    assert inside == set(zip(p.tolist(), h.tolist()))
    assert len(p) > len(passage) / 9


def test_anchors_are_closed_syncmers():
    """The rule, with the s-mer's hashes taken from texts of one s-mer each side by side."""
    text = words(5, 50)
    rank = {}
    for i in range(len(text) - SMALL + 1):
        s = text[i:i + SMALL]
        points = np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.uint64)
        h, width = (points + syncmers._M1) * syncmers._M2, 1
        while width < SMALL:
            h, width = h[:-width] * syncmers._M3 + (h[width:] ^ h[width:] >> np.uint64(29)), 2 * width
        rank[s] = int(syncmers._mix(h)[0])
    expected = []
    for i in range(len(text) - K + 1):
        inner = [rank[text[j:j + SMALL]] for j in range(i, i + K - SMALL + 1)]
        if min(inner) in (inner[0], inner[-1]):
            expected.append(i)
    assert syncmers.anchors(["x", text, "yy"])[1][0].tolist() == expected


def test_likeness():
    a, b = words(1, 300), words(2, 300)
    fa, fb, fab, empty = syncmers.fingerprints([a, b, a[:len(a) // 2] + b[:len(b) // 2], ""])
    assert syncmers.likeness(fa, fa) == 1 and syncmers.likeness(empty, empty) == 1
    assert syncmers.likeness(fa, empty) == 0 and syncmers.likeness(fa, fb) < 0.05
    assert 0.3 < syncmers.likeness(fa, fab) < 0.7
    assert len(fa) <= KEPT


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_compare_documents(spark, parts):
    rows = [(i * 3, words(i % 11, i % 40), None, 0, i) for i in range(60)]
    rows += [(None, "no id", "x", 1, 1), (None, None, "x", 1, 1), (5, "", "x", 1, 1), (5, None, "", 1, 1), (5, words(99, 400) * 20, "", 1, 1), (9, "x" * 70000, "", 1, 1)]
    rows += [(5, "", "x", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    order = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "") for r in rows))
    expected = []
    for i, (has, d, _, t) in enumerate(order):
        after, q = order[(i + 1) % len(order)][3], len(t) // 4
        e = t[:len(t) - q] + after[:q]
        fs = syncmers.fingerprints([t, e, after])
        expected.append((d if has else None, len(t), hashlib.sha256(e.encode()).hexdigest(), fs[0].tobytes().hex(), fs[1].tobytes().hex(),
                         syncmers.likeness(fs[0], fs[1]), syncmers.likeness(fs[0], fs[2])))
    assert sorted(map(repr, map(tuple, syncmers.compare_documents(df, parts).collect()))) == sorted(map(repr, expected))
    assert syncmers.document_anchors(df).count() == len(rows)


def test_query_compares_all_anchors(spark, tmp_path):
    """A passage that two long texts share, too short a part of both for a common hash among the smallest."""
    passage = words(7, 10)
    texts = [words(8, 9000) + passage, passage + words(9, 9000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kinds = [set(h.tolist()) for _, h in syncmers.anchors(texts)]
    expected = 2 * len(kinds[0] & kinds[1]) / (len(kinds[0]) + len(kinds[1]))
    got = queries.QUERIES["op1_closed_syncmers"](spark, str(tmp_path)).collect()
    assert 0 < expected < 0.01 and [r.near_next for r in got] == [expected, expected]


def test_compare_few(spark):
    assert syncmers.compare_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    one = syncmers.compare_documents(spark.createDataFrame([(1, "abcdefgh", None, None, None)], SCHEMA)).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
