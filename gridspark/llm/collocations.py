"""Operator 12: collocations by dynamic itemset counting over cyclic shards.

The normalised texts are written once, dealt row by row into a few shards.  Step t scans shard t modulo the number of
shards.  All words are counted from step 0 on.  A longer phrase starts to be counted in the step after both its
subphrases (without the last word, without the first) have reached the threshold, whatever their length and
however much of their own cycle is left, and it is counted until it has met every shard once.  So lengths interleave, a
count is exact after one full cycle, and every frequent phrase is found, since its subphrases reach the threshold.

What a task has to know is the step in which a phrase reached the threshold.  It sits in an array of fixed size with one
byte for each slot of a Bloom filter: the step that first set the slot.  A phrase's step is the largest of its slots'.
Once set, slots never change, so every task finds the same start for a phrase, and a false positive is one phrase more
that is counted whole, not a wrong count.  Counts are keyed by language and phrase and merged by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import steps, texts_of
from gridspark.llm.hashing import _power, mix, runs
from gridspark.scratch import scratch_path, settle

#: Shards of a cycle, least count of a candidate, most words of a phrase, and phrases kept per language.
SHARDS, LEAST, MOST_WORDS, KEPT = 3, 100, 5, 2000
#: Slots of the filter (its size in bytes), slots per phrase, and blocks in which slots go to the driver.
SLOTS, PROBES, BLOCKS = 1 << 24, 2, 32
#: Distinct phrases a task holds before it hands on its counts.
HELD = 400_000
#: Bands of scores for each doubling of the score, and parts of a band, that are ranked on their own.
BANDS, SALTS = 8, 16

_NEVER = 255
_CLASS = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LANGUAGE = np.uint64(0x94D049BB133111EB)


def normalise(texts: list[str]) -> list[bytes]:
    """Every text's words in lower case (A-Z), one space between words of a piece, a line end after each piece."""
    datas = [t.encode() + b"\n" for t in texts]
    data = _LOWER[np.frombuffer(b"".join(datas), np.uint8)]
    kind = _CLASS[data]
    starts, ends = runs(kind == 0)
    breaks = np.append(0, np.cumsum(kind == 2))
    after = np.append(starts[1:], len(data))
    data[ends] = np.where(breaks[after] > breaks[ends], 10, 32)
    keep = kind == 0
    keep[ends] = True
    cut = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum([len(x) for x in datas]))]
    out = data[keep].tobytes()
    return [out[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


class Phrases:
    """Phrases of normalised texts: hashes of runs of words, with each text's language in them."""

    def __init__(self, datas: list[bytes], languages: list[int]):
        self.data = np.frombuffer(b"".join(datas), np.uint8)
        self.starts, self.ends = runs((self.data != 32) & (self.data != 10))
        power, self.inverse = _power(len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])
        self.text = np.searchsorted(np.cumsum([len(x) for x in datas]), self.starts, side="right")
        self.seeds = mix(np.array(languages, np.uint64) * _LANGUAGE + np.uint64(1))
        self.goes_on = np.zeros(len(self.starts), bool)
        self.goes_on[:-1] = self.data[self.ends[:-1]] == 32

    def hashes(self, at: np.ndarray, words: int) -> np.ndarray:
        starts, ends = self.starts[at], self.ends[at + words - 1]
        own = (self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _LANGUAGE
        return mix(mix(own) + self.seeds[self.text[at]])

    def strings(self, at: np.ndarray, words: int) -> pa.Array:
        starts = self.starts[at]
        sizes = self.ends[at + words - 1] - starts
        offsets = np.append(0, np.cumsum(sizes))
        taken = self.data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))


def language_code(language: str) -> int:
    return zlib.crc32(language.encode()) << 32 | zlib.adler32(language.encode())


def slots_of(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    return [(hashes >> np.uint64(29 * i) & np.uint64(slots - 1)).astype(np.int64) for i in range(PROBES)]


def reached(hashes: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """The step in which each phrase reached the threshold, as the filter has it, or 255."""
    found = [filter_[s] for s in slots_of(hashes, len(filter_))]
    return np.maximum.reduce(found)


def active(phrases: Phrases, step: int, shards: int, filter_: np.ndarray, most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, places, hashes, first step) of the occurrences whose phrases are counted in this step."""
    n = len(phrases.starts)
    places, first = np.arange(n), np.zeros(n, np.int64)
    own = phrases.hashes(places, 1)
    for words in range(1, most_words + 1):
        counted = first > step - shards
        if counted.any():
            yield words, places[counted], own[counted], first[counted]
        if words == most_words or step == 0:
            return
        when = np.full(n + 1, _NEVER, np.uint8)
        when[places] = reached(own, filter_)
        some = places[when[places] != _NEVER]
        begin = np.zeros(n + 1, np.int64)
        begin[places] = first
        places = some[(when[some + 1] != _NEVER) & phrases.goes_on[np.minimum(some + words - 1, n - 1)]]
        if not len(places):
            return
        # a false positive may have an early step, but no phrase starts before its subphrases do
        first = np.maximum(np.maximum(when[places], when[places + 1]).astype(np.int64) + 1, np.maximum(begin[places], begin[places + 1]))
        own = phrases.hashes(places, words + 1)


class Held:
    """Counts of the phrases that a task has met, by hash, with one string for each."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.parts: list[tuple] = []
        self.order = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.known)

    def add(self, phrases: Phrases, languages: pa.Array, words: int, at: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        new = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
        keys, counts, one = hashes[order][new], np.diff(np.append(new, len(order))), order[new]
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            old = self.known[place] == keys
            self.counts[self.order[place[old]]] += counts[old]
            keys, counts, one = keys[~old], counts[~old], one[~old]
        if not len(keys):
            return
        self.parts.append((languages.take(pa.array(phrases.text[at[one]])), phrases.strings(at[one], words),
                           np.full(len(one), words, np.int32), first[one].astype(np.int32)))
        self.order = np.concatenate([self.order, len(self.counts) + np.arange(len(keys))])
        self.counts = np.concatenate([self.counts, counts])
        known = np.concatenate([self.known, keys])
        sorted_ = np.argsort(known, kind="stable")
        self.known, self.order = known[sorted_], self.order[sorted_]

    def batch(self) -> pa.RecordBatch:
        columns = [pa.concat_arrays([p[i] for p in self.parts]) for i in (0, 1)]
        columns += [pa.array(np.concatenate([p[i] for p in self.parts])) for i in (2, 3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(self.counts)], ["lang", "phrase", "words", "first", "n"])


def deal(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, lang, words, pieces) of every text, written to the shared folder by shard; rows take turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            pieces = normalise(texts_of(step))
            words = [x.count(b" ") + x.count(b"\n") for x in pieces]
            yield pa.RecordBatch.from_arrays([step.column("shard"), step.column("lang"), pa.array(words, pa.int64()), pa.array(pieces, pa.binary())],
                                             ["shard", "lang", "words", "pieces"])

    own = docs.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
                      F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    dealt = own.mapInArrow(run, "shard int, lang string, words long, pieces binary").filter("words > 0")
    path = scratch_path(docs.sparkSession, "shards")
    dealt.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema("lang string, words long, pieces binary, shard int").parquet(path)


def count_step(shard: DataFrame, step: int, shards: int, filter_: np.ndarray, most_words: int) -> DataFrame:
    """(lang, phrase, words, first, n): this shard's counts, by task, of the phrases that are counted in this step."""
    packed, size = zlib.compress(filter_.tobytes(), 1), len(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(zlib.decompress(packed, bufsize=size), np.uint8)
        held = Held()
        for part in steps(batches, "pieces"):
            languages = part.column("lang")
            phrases = Phrases(part.column("pieces").to_pylist(), [language_code(x) for x in languages.to_pylist()])
            for words, at, hashes, first in active(phrases, step, shards, known, most_words):
                held.add(phrases, languages, words, at, hashes, first)
            if len(held) > HELD:
                yield held.batch()
                held.clear()
        if len(held):
            yield held.batch()

    return shard.select("lang", "pieces").mapInArrow(run, "lang string, phrase string, words int, first int, n long")


def set_slots(found: DataFrame, filter_: np.ndarray, step: int) -> bool:
    """Set the slots of the phrases of ``found`` (lang, phrase) to ``step``; whether there were any.

    Slots are gathered by block, so the driver gets no more than one bit for each slot of the filter.
    """
    size = len(filter_)
    width = size // BLOCKS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "phrase"):
            phrases = Phrases([x.encode() + b"\n" for x in part.column("phrase").to_pylist()], [language_code(x) for x in part.column("lang").to_pylist()])
            ends = np.append(np.searchsorted(phrases.text, np.arange(part.num_rows)), len(phrases.text))
            hashes = np.zeros(part.num_rows, np.uint64)
            for n in np.unique(np.diff(ends)):
                rows = np.flatnonzero(np.diff(ends) == n)
                hashes[rows] = phrases.hashes(ends[rows], int(n))
            slots = np.unique(np.concatenate(slots_of(hashes, size)))
            yield pa.RecordBatch.from_arrays([pa.array(slots // width, pa.int32()), pa.array(slots % width, pa.int32())], ["block", "slot"])

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, slots = batch.column("block").to_numpy(), batch.column("slot").to_numpy()
            for b in np.unique(blocks).tolist():
                own.setdefault(b, np.zeros(width, bool))[slots[blocks == b]] = True
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1) for x in own.values()], pa.binary())],
                                             ["block", "bits"])

    rows = found.select("lang", "phrase").mapInArrow(places, "block int, slot int").distinct().repartition("block") \
        .mapInArrow(bitmaps, "block int, bits binary").collect()
    for r in rows:
        own = filter_[r["block"] * width:(r["block"] + 1) * width]
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8))[:width].astype(bool)
        own[bits & (own == _NEVER)] = step
    return bool(rows)


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases that occur ``least`` times or more, and (lang, n) of all words of a language."""
    spark = docs.sparkSession
    dealt = deal(docs, shards)
    totals = settle(dealt.groupBy("lang").agg(F.sum("words").alias("n")), "totals")
    filter_ = np.full(slots, _NEVER, np.uint8)
    path, schema = scratch_path(spark, "counts"), "lang string, phrase string, words int, first int, n long, was boolean"
    step, last, before = 0, -1, None
    while step < last + 1 + shards:
        counts = count_step(dealt.filter(F.col("shard") == step % shards), step, shards, filter_, most_words).withColumn("was", F.lit(False))
        if before is not None:  # counts of phrases that are not through with their cycle yet
            counts = counts.unionByName(before.filter(F.col("first") + shards > step).withColumn("was", F.col("n") >= least))
        merged = counts.groupBy("lang", "phrase", "words", "first").agg(F.sum("n").alias("n"), F.max("was").alias("was"))
        merged.write.parquet(f"{path}/step={step}")
        before = spark.read.schema(schema).parquet(f"{path}/step={step}")
        if set_slots(before.filter(~F.col("was") & (F.col("n") >= least) & (F.col("words") < most_words)), filter_, step):
            last = step
        step += 1
        if step == _NEVER:
            raise ValueError("too many steps: use fewer shards or shorter phrases")
    counted = spark.read.schema(schema + ", step int").parquet(path)
    whole = counted.filter((F.col("first") + shards - 1 == F.col("step")) & (F.col("n") >= least))
    return settle(whole.select("lang", "phrase", "words", F.col("n").alias("f")), "frequent"), totals


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, kept: int = KEPT, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): every language's best phrases of two to ``most_words`` words of ``docs`` (lang, text).

    a, l and r count the phrase and its two parts at its lowest-scoring cut, n all words of the language; the score is
    floor(1000 a n / (l r)), exact.  Phrases inside a longer one that occurs as often are left out.  Null texts count as
    empty, null languages as ``und``; empty texts have no words, very long ones are read whole, and each repeated row
    counts.  Equal scores are ordered by a, then by phrase.  Other columns are never read; an empty table gives no rows.
    """
    frequent, totals = frequent_phrases(docs, least, most_words, shards, slots)
    words = F.split("phrase", " ")
    part = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    candidates = frequent.filter("words > 1").withColumnRenamed("f", "a")
    count_of = lambda name: frequent.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))) \
        .select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("_l"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("_r"))
    cuts = cuts.join(count_of("l"), ["lang", "_l"]).join(count_of("r"), ["lang", "_r"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_up", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("_down", wide("l") * wide("r"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("_up div _down").alias("score"), "cut", "l", "r")).alias("_best")) \
        .select("lang", "phrase", "a", "n", "_best.l", "_best.r", "_best.score")
    # a phrase inside a longer one that is as frequent is also inside one that is a single word longer
    inside = candidates.filter("words > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    scored = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (F.col("_longer") < F.col("a"))).drop("_longer")
    return best_of(settle(scored, "scored"), kept).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best_of(scored: DataFrame, kept: int) -> DataFrame:
    """Each language's ``kept`` rows of the highest score (then a, then the first phrase), with their rank.

    A language's rows never meet in one task: its scores are cut into bands, bands behind the first ``kept`` rows are
    dropped by their counts, rows are ranked within a band, and first of all within parts of it by a hash.
    """
    band = F.floor(F.log2(F.col("score") + 1) * BANDS).cast("int")
    rows = scored.withColumns({"_band": band, "_salt": F.pmod(F.xxhash64("phrase"), F.lit(SALTS))})
    counts = rows.groupBy("lang", "_band").agg(F.count("*").alias("_in"))
    above = F.sum("_in").over(Window.partitionBy("lang").orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_above", F.coalesce(above, F.lit(0))).filter(F.col("_above") < kept).drop("_in")
    rows = rows.join(settle(counts, "bands"), ["lang", "_band"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "_band", "_salt"], ["lang", "_band"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + F.col("_above").cast("int")
        rows = rows.withColumn("rank", rank).filter(F.col("rank") <= kept)
    return rows


def oracle(least: int = LEAST, most_words: int = MOST_WORDS, kept: int = KEPT) -> str:
    """DuckDB SQL for the rows of ``collocations`` over ``documents``: all phrases counted, all contained phrases compared."""
    return f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from pieces),
totals as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
grams as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
          from w, (select unnest(range(1, {most_words + 1})) as k) s where len(ws) >= k),
f as (select lang, k, phrase, count(*) as f from grams group by lang, k, phrase having count(*) >= {least}),
cuts as (select lang, phrase, k, f as a, unnest(range(1, k)) as cut, string_split(phrase, ' ') as ws from f where k > 1),
sides as (select c.*, l.f as l, r.f as r, t.n from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:c.cut], ' ')
          join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[c.cut + 1:c.k], ' ') join totals t on t.lang = c.lang),
scored as (select *, cast(1000::hugeint * a * n // (l::hugeint * r) as bigint) as score from sides),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
spans as (select lang, f, k, string_split(phrase, ' ') as ws, unnest(range(2, k)) as size from f where k > 2),
subs as (select lang, f, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) as phrase from spans),
longer as (select lang, phrase, max(f) as g from subs group by lang, phrase)
select b.lang, cast(row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) as int) as rank, b.phrase, a, l, r, n, score
from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase where g.g is null or 100 * g.g < 100 * a
qualify rank <= {kept}"""
