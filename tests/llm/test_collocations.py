"""Phrases and scores against plain counting, for several shards, filters and odd texts."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridspark.llm import collocations as C

SCHEMA = "text string, lang string, phrase string, n long, shard int, rank string"


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            if words:
                totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    return counts, totals


def plain_collocations(rows, least, kept):
    counts, totals = plain_counts(rows)
    frequent = {p: f for p, f in counts.items() if f >= least}
    best = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        score, _, left, right = min((1000 * a * totals[lang] // (frequent[lang, words[:k]] * frequent[lang, words[k:]]), k, frequent[lang, words[:k]], frequent[lang, words[k:]])
                                    for k in range(1, len(words)))
        inside = any(o == lang and len(w) > len(words) and 100 * f >= 100 * a and any(w[i:i + len(words)] == words for i in range(len(w))) for (o, w), f in frequent.items())
        if not inside:
            best.append((lang, score, a, " ".join(words), left, right))
    out = []
    for lang in {x[0] for x in best}:
        own = sorted((x for x in best if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:kept]
        out += [(lang, i, p, a, left, right, totals[lang], score) for i, (_, score, a, p, left, right) in enumerate(own, 1)]
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "naïve", "Ärger", "x\x01y", " ", "don't", "a-b", "日本", "it's"]
    gaps = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", ";", "!?", " \t ", ":"]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice(gaps[:2] if r.random() < 0.8 else gaps) for _ in range(r.randrange(0, 40)))
        if i % 7 == 0:
            text += "in New York City of the"
        rows.append((text, r.choice(["en", "de", None, ""]), "x", 1, 2, "y"))
    rows += [(None, "en", "x", 1, 2, "y"), ("", "fr", "x", 1, 2, "y"), (" \t\n..", "fr", "x", 1, 2, "y"), ("a " * 3000, "en", "x", 1, 2, "y")] + [("same old story", "en", "x", 1, 2, "y")] * 30
    return rows


@pytest.mark.parametrize("seed,shards,slots,least,kept", [(0, 4, 1 << 16, 5, 2000), (1, 3, 1 << 12, 8, 7), (2, 1, 64, 5, 2000), (3, 5, 64, 20, 3)])
def test_collocations(spark, seed, shards, slots, least, kept):
    """A filter of 64 slots is full: then everything is counted, and the counts are still exact."""
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in C.collocations(df, least, 5, kept, shards, max(slots, C.BLOCKS)).collect())
    assert got == plain_collocations(rows, least, kept)


def test_frequent_phrases_are_counted_whole(spark):
    rows = corpus(5)
    counts, totals = plain_counts(rows)
    frequent, n = C.frequent_phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), 6, 4, 3, 1 << 10)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in frequent.collect()} == {p: f for p, f in counts.items() if f >= 6 and len(p[1]) <= 4}
    assert {r.lang: r.n for r in n.collect()} == dict(totals)


def test_lengths_start_behind_their_subphrases():
    """A phrase starts in the step after both its subphrases have reached the threshold, and ends a cycle later."""
    pieces = C.normalise(["one two three. one two"])
    phrases = C.Phrases(pieces, [7])
    filter_ = np.full(1 << 12, 255, np.uint8)

    def put(at, words, step):
        for s in C.slots_of(phrases.hashes(np.array([at]), words), len(filter_)):
            filter_[s] = np.minimum(filter_[s], step)

    put(0, 1, 0), put(1, 1, 2), put(2, 1, 1)
    found = lambda step: {(w, int(p), int(f)) for w, at, _, first in C.active(phrases, step, 3, filter_, 5) for p, f in zip(at, first, strict=True)}
    assert {x for x in found(2) if x[0] == 1} == {(1, i, 0) for i in range(5)}  # words are in their first cycle
    assert {x for x in found(3)} == {(2, 0, 3), (2, 1, 3), (2, 3, 3)}
    assert found(5) == found(3) and found(6) == set()
    put(0, 2, 3), put(1, 2, 4)
    assert (3, 0, 5) in found(5) and (3, 0, 5) in found(7) and not any(w == 3 for w, *_ in found(8))


def test_normalised_texts():
    assert C.normalise(["A  b\tC. dE,f", "", " ", "x\x0b\x0cy z", "É!"]) == [b"a b c\nde\nf\n", b"", b"", b"x\ny z\n", "É\n".encode()]


def test_tables_without_words(spark):
    for rows in ([], [(None, None, "x", 1, 2, "y"), (". ,", "en", "x", 1, 2, "y")]):
        assert C.collocations(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_scores_beyond_64_bits(spark):
    """The same expression as the operator's, with counts whose products need up to 100 bits."""
    rows = [(10 ** 10 + i, 10 ** 13 + 7 * i, 3 * 10 ** 10 + i, 7 * 10 ** 11 + 3 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    d = "cast({} as decimal(19,0))".format
    got = df.selectExpr(f"(cast(1000 as decimal(4,0)) * {d('a')} * {d('n')}) div ({d('l')} * {d('r')}) as s").collect()
    assert [r.s for r in got] == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_oracle_agrees(spark):
    rows = corpus(9, 60)
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    assert sorted(con.execute(C.oracle(5, 5, 50)).fetchall()) == plain_collocations(rows, 5, 50)
