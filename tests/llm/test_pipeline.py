"""Each stage of the pipeline against its operator's brute-force version, on the rows that the one before kept."""

import corpus_pipeline
import pytest
from test_jaccard import corpus, plain_components

from gridspark.llm import jaccard, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            got = out.collect()
            assert {r.doc_id for r in got} == set(rows)
            assert all(sum(p.length for p in got if p.doc_id == d) == next(p.doc_tokens for p in got if p.doc_id == d) for d in list(rows)[:50])
            break
        assert out.columns == columns
        kept = {r.doc_id: r for r in out.collect()}
        assert all(rows[d] == r for d, r in kept.items())
        if name == "ngram_jaccard_join":
            parts = plain_components([(d, r.text) for d, r in rows.items()])
            assert set(kept) == {c for _, _, c in parts}
        else:
            scored = (toxicity if name == "toxicity" else quality).score(docs, labels)
            assert set(kept) == {r.doc_id for r in scored.collect() if r.predicted == (name == "quality")}
            assert 0 < len(rows) - len(kept) < 0.3 * len(rows)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.run(spark, SF).count() == len(got)


def test_one_of_each_component(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(*x, "a") for x in rows], "doc_id long, text string, _key string").repartition(3)
    found = jaccard.jaccard_components(df).collect()
    got = jaccard.keep_one(df).collect()
    assert df.columns == got[0].__fields__
    assert len(got) == len({r.component_key for r in found if r.n_shingles}) + sum(1 for r in found if not r.n_shingles)
    assert {r.component_id for r in found} == {r.doc_id for r in got}


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, _set_of_row long, sequence_id string, length int"


def odd_rows():
    rows = [(None, "the tree by the river"), (None, None), (1, ""), (1, None), (2, "word " * 60000), (3, "same text as others here"), (3, "same text as others here"),
            (4, "same text as others here"), (5, "!!! \n\t %%"), (6, "a <|endoftext|> b"), (7, "é" * 3000)]
    return [(i, t, "en", "src", len(t or ""), 1.0, 7, 9, "x", 3) for i, t in rows]


@pytest.fixture
def labelled(spark, tmp_path):
    """A folder with a table of labels."""
    def write(rows):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, score double").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)
    return write


def test_filters_keep_every_row_without_labels_of_both_kinds(spark, labelled):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    sf_dir = labelled([(i, 1, 1, "x", 0.5) for i in (1, 3, 4)] + [(None, 0, 0, "x", 0.5), (9, None, None, "x", 0.5), (3, 7, -1, "x", 0.5)])
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name


def test_filters_judge_odd_rows_by_their_text(spark, labelled):
    good = [(100 + i, f"a calm river runs by tree number {i} and stone", "en", "s", 9, 1.0, 1, 1, "x", 1) for i in range(0, 80, 2)]
    bad = [(100 + i, f"you filthy scum number {i} !!", "en", "s", 9, 1.0, 1, 1, "x", 1) for i in range(1, 80, 2)]
    docs = spark.createDataFrame(odd_rows() + good + bad, ODD).repartition(3)
    sf_dir = labelled([(100 + i, int(i % 2 == 0), i % 2, "x", 0.5) for i in range(80)])
    for (name, stage), module in zip(corpus_pipeline.STAGES[:2], (toxicity, quality), strict=True):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
        scored = module.score(docs, labels).collect()
        assert out.count() == sum(r.predicted == (name == "quality") for r in scored)
        kept = {r.doc_id for r in out.collect()}
        assert {r[0] for r in good} <= kept and not {r[0] for r in bad} & kept
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_near_copies_and_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    (_, near), (_, pack) = corpus_pipeline.STAGES[2:]
    kept = near(spark, docs, "")
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("same text as others here") == 1 and sum(not t or t == "!!! \n\t %%" for t in texts) >= 3 and any(t and len(t) > 100000 for t in texts)
    packed = pack(spark, docs, "").collect()
    assert sum(r.start == 0 for r in packed) == docs.count()
    assert all(r.offset + r.length <= 4096 for r in packed)
    for stage in (near, pack):
        assert stage(spark, docs.limit(0), "").count() == 0
