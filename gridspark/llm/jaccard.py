"""Operator 9: exact Jaccard join of word-shingle sets with signature trees, as connected components.

1. Every text becomes a set of 64-bit shingle hashes.  Equal sets are one class from here on, however many rows have them.
2. Two classes that link share one of the first shingles of either, in any fixed order of shingles: the first
   n - ceil(0.8 n) + 1 of n.  The order puts frequent shingles last.  Classes that share such a shingle are a list.
3. Signature trees over the bitmaps of a list's classes find links that may hold, and these give loose components.
4. In a loose component the same trees over the sets themselves find links that do hold, and so the components.

Lists and components of any size are cut into random chunks of bounded size, a few times over.  What the chunks
connect is one component; only classes outside their group's largest one are then compared with all of the
group (``connect_groups``).  So no pair is left out, and groups of near copies cost about as much as they have rows.
Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import shuffle_parts, steps, texts_of
from gridspark.llm.components import components
from gridspark.llm.hashing import mix
from gridspark.llm.shingles import ordered_sets, set_keys, shingles, signature
from gridspark.llm.sigtree import Forest
from gridspark.scratch import settle

#: Cells in which shingles are counted, share of a task's texts that makes a cell frequent, and frequent cells used.
CELL_BITS, FREQUENT, CELLS_USED = 20, 0.005, 1 << 16
#: Classes and shingles of a chunk, about, and random cuts of a large group.
CHUNK, CHUNK_SHINGLES, CUTS = 2048, 4_000_000, 3
#: Bytes of text that become shingles at a time (arrays take about a hundred times as much).
STEP = 500_000
#: Shingles that a task gathers before it sends them on, and bits of a filter at most.
SENT, FILTER_BITS = 1 << 19, 1 << 26
MEMBERS = "doc_id long, n int, k long, sig binary, cell int, count long"
LISTS = "list long, part int, size long, weight long, members array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text: size and key of its set, and the set's bitmap where the key is new to the task; then counts of frequent cells."""
    seen: set[int] = set()
    counts, texts_read = np.zeros(1 << CELL_BITS, np.int64), 0
    for step in steps(batches, most=STEP):
        h, cut = ordered_sets(*shingles(texts_of(step)), step.num_rows)
        keys, n = set_keys(h, cut).view(np.int64), np.diff(cut)
        counts += np.bincount((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        texts_read += step.num_rows
        sigs = []
        for i, k in enumerate(keys.tolist()):
            sigs.append(signature(h[cut[i]:cut[i + 1]]).tobytes() if n[i] > 3 and k not in seen else None)
            seen.add(k)
        if len(seen) > 1 << 20:
            seen.clear()
        none = pa.nulls(step.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(n, pa.int32()), pa.array(keys), pa.array(sigs, pa.binary()), none, none.cast(pa.int64())],
                                         ["doc_id", "n", "k", "sig", "cell", "count"])
    many = np.flatnonzero(counts >= max(16, FREQUENT * texts_read))
    if len(many):
        none = pa.nulls(len(many), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), none, pa.nulls(len(many), pa.binary()), pa.array(many, pa.int32()), pa.array(counts[many])],
                                         ["doc_id", "n", "k", "sig", "cell", "count"])


def prefix_lists(docs: DataFrame, cells: np.ndarray, counts: np.ndarray, parts: int) -> DataFrame:
    """Lists of classes that share a prefix shingle and whose sizes allow a link; a list once, by the hash of its classes."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << CELL_BITS, np.int64)
        weight[cells] = counts
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            token, k, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = ((token >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((k, bucket))
            token, k, n, bucket = token[order], k[order], n[order], bucket[order]
            new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (bucket[1:] != bucket[:-1])))
            each = np.diff(np.append(new, len(k)))
            at = np.searchsorted(bucket, np.arange(parts + 1))
            runs_at = np.searchsorted(new, at)
            some = np.flatnonzero(np.diff(at))
            cut = lambda x, ends: pa.array([x[ends[b]:ends[b + 1]].tobytes() for b in some], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), cut(token, at), cut(k[new], runs_at), cut(n[new].astype(np.int32), runs_at), cut(each.astype(np.int32), runs_at)],
                ["bucket", "tokens", "ks", "ns", "each"])

        waiting = 0
        for step in steps(batches, most=STEP):
            h, cut = ordered_sets(*shingles(texts_of(step)), step.num_rows, weight)
            # keys don't depend on the order in a set
            keys, n = set_keys(h, cut), np.diff(cut)
            fresh = np.zeros(step.num_rows, bool)
            for i, k in enumerate(keys.tolist()):
                fresh[i] = n[i] > 3 and k not in seen
                seen.add(k)
            if len(seen) > 1 << 20:
                seen.clear()
            use = np.where(fresh, n - (4 * n + 4) // 5 + 1, 0)
            inside = np.arange(len(h)) - np.repeat(cut[:-1], n) < np.repeat(use, n)
            held.append((h[inside], np.repeat(keys, use), np.repeat(n, use)))
            waiting += int(use.sum())
            if waiting > SENT:
                yield flush()
                waiting = 0
        if waiting:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for _, tokens, ks, ns, each in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                e = np.frombuffer(each, np.int32)
                parts_of.append((np.frombuffer(tokens, np.uint64), np.repeat(np.frombuffer(ks, np.uint64), e), np.repeat(np.frombuffer(ns, np.int32), e)))
        if not parts_of:
            return
        token, k, n = (np.concatenate(x) for x in zip(*parts_of, strict=True))
        del parts_of
        order = np.argsort(token, kind="stable")
        token = token[order]
        shared = np.zeros(len(token), bool)  # most shingles are in one class only
        same = token[1:] == token[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        token, k, n = token[shared], k[order[shared]], n[order[shared]].astype(np.int64)
        order = np.lexsort((k, n, token))
        token, k, n = token[order], k[order], n[order]
        new = np.ones(len(k), bool)
        new[1:] = (token[1:] != token[:-1]) | (k[1:] != k[:-1])
        token, k, n = token[new], k[new], n[new]
        # a list ends where the shingle changes, or where the next larger set is too large for the one before
        head = np.ones(len(k), bool)
        head[1:] = (token[1:] != token[:-1]) | (5 * n[:-1] < 4 * n[1:])
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(k)))
        if not len(starts):
            return
        name = mix(np.add.reduceat(mix(k ^ np.uint64(0x51ED270B)), starts) + sizes.astype(np.uint64))
        weight = np.add.reduceat(n, starts)
        keep = np.flatnonzero(sizes > 1)
        keep = keep[np.unique(name[keep], return_index=True)[1]]
        out: list[tuple] = []
        for i in keep.tolist():
            members = k[starts[i]:starts[i] + sizes[i]].view(np.int64)
            for part in range(0, len(members), CHUNK):
                out.append((int(name[i].view(np.int64)), part // CHUNK, int(sizes[i]), int(weight[i]), members[part:part + CHUNK]))
            if len(out) >= 4096:
                yield _lists(out)
                out = []
        if out:
            yield _lists(out)

    sent = docs.select("text").mapInArrow(send, "bucket int, tokens binary, ks binary, ns binary, each binary")
    lists = sent.repartitionById(parts, F.col("bucket")).mapInArrow(gather, LISTS)
    return lists.groupBy("list", "part").agg(F.first("size").alias("size"), F.first("weight").alias("weight"), F.first("members").alias("members"))


def _lists(out: list[tuple]) -> pa.RecordBatch:
    name, part, size, weight, members = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(part, pa.int32()), pa.array(size, pa.int64()), pa.array(weight, pa.int64()),
                                       pa.array(members, pa.list_(pa.int64()))], ["list", "part", "size", "weight", "members"])


def _link_chunks(batches: Iterator[pa.RecordBatch], sets: bool) -> Iterator[pa.RecordBatch]:
    """Links within each chunk (grp, chunk) of sorted rows (grp, chunk, side, label, k, n, data).

    Rows of side 1, if a chunk has any, are only linked with the others.
    """
    rows: list[tuple] = []
    key = None

    def links() -> list[tuple[int, int]]:
        first: dict[tuple[int, int], tuple] = {}
        for r in rows:
            first.setdefault((r[0], r[2]), r)  # a class once
        own = list(first.values())
        if len(own) < 2:
            return []
        data = [np.frombuffer(r[4], np.uint64) for r in own]
        n, side = np.array([r[3] for r in own], np.int64), np.array([r[0] for r in own])
        labels = np.array([r[1] if r[1] is not None else i for i, r in enumerate(own)], np.int64) if side.any() else None
        forest = Forest(n, [signature(d) for d in data] if sets else data, data if sets else None, labels)
        found = forest.link(np.flatnonzero(side == 1), np.flatnonzero(side == 0)) if side.any() else forest.link()
        return [(own[i][2], own[j][2]) for i, j in found]

    for batch in batches:
        out: list[tuple[int, int]] = []
        at = batch.to_pydict()
        for g, c, *r in zip(*(at[x] for x in ("grp", "chunk", "side", "label", "k", "n", "data")), strict=True):
            if (g, c) != key:
                out += links()
                rows, key = [], (g, c)
            rows.append(tuple(r))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
    if out := links():
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])


def connect_groups(members: DataFrame, payload: DataFrame, sets: bool) -> DataFrame:
    """Links (a, b) that connect, in every group of ``members`` (grp, size, weight, k), what links in it connect.

    ``payload`` (k, n, data) has bitmaps, or sets where links are to be verified.  Groups of any size are cut into chunks.
    """
    parts = shuffle_parts(members.sparkSession)
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int")
    members = members.withColumn("chunks", chunks)
    payload = payload.dropDuplicates(["k"])
    rows = members.join(payload, "k")

    def run(df: DataFrame) -> DataFrame:
        dealt = df.select("grp", "chunk", "side", "label", "k", "n", "data").repartition(parts, "grp", "chunk").sortWithinPartitions("grp", "chunk")
        return dealt.mapInArrow(lambda batches: _link_chunks(batches, sets), "a long, b long")

    cuts = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(CUTS))))
    once = rows.withColumn("cut", F.explode(cuts)).withColumn("chunk", F.col("cut") * F.col("chunks") + F.pmod(F.xxhash64("grp", "cut", "k"), F.col("chunks")).cast("int"))
    found = settle(run(once.withColumns({"side": F.lit(0), "label": F.lit(None).cast("long")})), "links")
    large = members.filter("chunks > 1")
    if large.isEmpty():
        return found
    # what the chunks of a large group have not connected: all outside its largest part meet all of the group
    labels = components(found)
    large = settle(large.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k")), "large")
    by_label = large.groupBy("grp", "label").count()
    most = by_label.groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("in_main"))
    most = most.filter(F.col("all") > F.col("in_main")).withColumn("blocks", F.ceil((F.col("all") - F.col("in_main")) / CHUNK).cast("int"))
    most = settle(most, "rest")
    if most.isEmpty():
        return found
    large = large.join(most.select("grp", "main", "blocks"), "grp").join(payload, "k")
    block = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    chunk = F.pmod(F.xxhash64("grp", "k"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    rest = large.filter("label <> main").withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) \
        .withColumns({"chunk": F.col("_to") * F.col("blocks") + block, "side": F.lit(1)}).drop("_to")
    all_of = large.withColumn("_block", F.explode(every)).withColumns({"chunk": chunk * F.col("blocks") + F.col("_block"), "side": F.lit(0)}).drop("_block")
    return found.unionByName(settle(run(rest.unionByName(all_of)), "links"))


def _filter(keys: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of ``keys`` (k): bits by two parts of a key, at most ``FILTER_BITS`` of them whatever the number of keys."""
    bits = min(FILTER_BITS, max(1 << 13, 1 << (16 * rows).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits, bool)
        for batch in batches:
            k = batch.column("k").to_numpy(zero_copy_only=False).view(np.uint64)
            for shift in (0, 30):
                on[(k >> np.uint64(shift) & np.uint64(bits - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["b"])

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.select("k").coalesce(8).mapInArrow(mark, "b binary").toLocalIterator():
        out |= np.frombuffer(bytes(r["b"]), np.uint8)
    return out


def candidate_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, n, data): the sets of the classes in ``keys`` (k), formed again from the texts."""
    bits = _filter(keys, keys.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(bits, bitorder="little").view(bool)
        last, seen = np.uint64(len(on) - 1), set()
        for step in steps(batches, most=STEP):
            h, cut = ordered_sets(*shingles(texts_of(step)), step.num_rows)
            k, n = set_keys(h, cut), np.diff(cut)
            near = (n > 3) & on[(k & last).astype(np.int64)] & on[(k >> np.uint64(30) & last).astype(np.int64)]
            use = [i for i in np.flatnonzero(near).tolist() if int(k[i]) not in seen and not seen.add(int(k[i]))]
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(k[use].view(np.int64)), pa.array(n[use], pa.int32()), pa.array([h[cut[i]:cut[i + 1]].tobytes() for i in use], pa.binary())],
                                             ["k", "n", "data"])

    return docs.select("text").mapInArrow(run, "k long, n int, data binary")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key, component_key) of every row of ``docs`` (doc_id, text).

    Components are named by their smallest doc_id; the keys of a row's set and of its component are null for an empty set.

    Rows link if their sets of distinct 5-word shingles have 100 * intersection >= 80 * union.  Null texts count as empty;
    texts without words link with nothing and are components of their own.  Rows with null ids link as others, and name
    a component (null) only if none of its rows has an id.  Rows with the same id are told apart by their texts.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = settle(texts.mapInArrow(_scan, MEMBERS), "members")
    # only an order of shingles: any gives the same links
    frequent = scanned.filter("cell is not null").groupBy("cell").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "cell").limit(CELLS_USED).collect()
    cells, counts = np.array([r["cell"] for r in frequent], np.int64), np.array([r["c"] for r in frequent], np.int64)
    rows = scanned.filter("cell is null")
    lists = settle(prefix_lists(texts, cells, counts, shuffle_parts(spark)), "lists")
    members = lists.select(F.col("list").alias("grp"), "size", "weight", F.explode("members").alias("k"))
    bitmaps = rows.filter("sig is not null").select("k", "n", F.col("sig").alias("data"))
    loose = components(connect_groups(members, bitmaps, sets=False))
    sizes = rows.filter("sig is not null").select("k", "n").dropDuplicates(["k"])
    loose = settle(loose.join(sizes, "k").select(F.col("label").alias("grp"), "k", "n"), "loose")
    totals = loose.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    found = connect_groups(loose.select("grp", "k").join(totals, "grp"), candidate_sets(texts, loose), sets=True)
    labels = components(found)
    classes = rows.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("first"))
    whole = classes.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    names = whole.groupBy("label").agg(F.min("first").alias("component_id"))
    named = settle(whole.join(names, "label").select("k", "component_id", F.col("label").alias("component_key")), "classes")
    linked = rows.filter("n > 0").join(named, "k").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("k").alias("set_key"), "component_key")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                         *(F.lit(None).cast("long").alias(c) for c in ("set_key", "component_key")))
    out = linked.unionByName(alone)
    return out.withColumn("n_shingles", F.col("n_shingles").cast("long"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (null ids last), with all columns.

    Of rows with the same id and the same shingles one stays, whichever; texts without words all stay.  Columns of any
    other name are kept.
    """
    found = jaccard_components(docs).filter("set_key is not null")
    first = found.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_key")).alias("f"))
    kept = settle(first.select(F.col("f.doc_id").alias("_kept"), F.col("f.set_key").alias("_key")), "kept")
    own = "_set_of_row"
    while own in {c.lower() for c in docs.columns}:
        own += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, most=STEP):
            h, cut = ordered_sets(*shingles(texts_of(step)), step.num_rows)
            keys = pa.array(set_keys(h, cut).view(np.int64), mask=np.diff(cut) == 0)
            yield pa.RecordBatch.from_arrays([*step.columns, keys], [*step.schema.names, own])

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    same = (rows[own] == kept["_key"]) & rows["doc_id"].eqNullSafe(kept["_kept"])
    stay = rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", own])
    return stay.unionByName(rows.filter(F.col(own).isNull())).drop(own)
