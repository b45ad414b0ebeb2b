"""Registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import bitslices, bpe, collocations, jaccard, language, packing, quality, records, sharding, syncmers, toxicity, urls, whitening
from gridspark.llm.common import steps, table
from gridspark.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op2_framed_records")
def framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "ids"):
            crc = pa.array([records.ids_crc32(x) for x in step.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*step.columns[:3], crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return records.read_records(spark, path).mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op6_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op10_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query("op1_closed_syncmers")
def closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_documents(table(spark, sf_dir, "documents"), whole=True)


@query("op7_bit_sliced_top_k", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""")
def bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.top_inner_products(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query("op5_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_extendible_hashing", sharding.oracle())
def extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query("op4_path_templates", urls.oracle())
def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.page_labels(pages, table(spark, sf_dir, "labels")))


@query("op9_signature_trees")
def signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op12_dynamic_collocations", collocations.oracle())
def dynamic_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op11_byte_convolution")
def byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def whitening_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
