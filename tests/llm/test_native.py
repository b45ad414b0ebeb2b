"""Shards and URL verdicts: SQL on the driver's tables, plain Python on odd rows."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from gridspark.llm import queries, sharding, urls

DOCS = "doc_id long, text string, depth int, _h string, shard string, _key int, bytes int"
PAGES = "page_id long, url string, host string, path int, _t0 string, bad int"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


def test_shards_split_only_oversized_buckets(spark):
    rows = [(i, "é" * (i * 37 % 400), 1, "x", "x", 1, 1) for i in range(500)]
    rows += [(7, "same" * 25, 1, "x", "x", 1, 1)] * 60 + [(8, "w" * 5000, 1, "x", "x", 1, 1), (None, None, 1, "x", "x", 1, 1), (None, "", 1, "x", "x", 1, 1)]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS).repartition(3), limit=2000).collect()
    assert len(got) == len(rows)
    total, shards = defaultdict(int), defaultdict(list)
    bits = lambda k: format(int(hashlib.md5(str("" if k is None else k).encode()).hexdigest()[:15], 16), "060b")
    for k, t, *_ in rows:
        for d in range(61):
            total[bits(k)[:d]] += len((t or "").encode())
    for r in got:
        shards[r.shard].append(r)
        name = r.shard.split("/")[0]
        assert bits(r.doc_id).startswith(name) and len(name) == r.depth
        if "/" in r.shard:
            assert total[bits(r.doc_id)] > 2000
        else:
            assert r.depth == next(d for d in range(61) if total[name[:d]] <= 2000)
    for members in shards.values():
        size = sum(r.n_bytes for r in members)
        assert (size <= 2000 or len(members) == 1) and all((r.shard_bytes, r.shard_docs) == (size, len(members)) for r in members)
    assert sharding.assign_shards(spark.createDataFrame([], DOCS)).count() == 0


def test_written_shards(spark):
    from gridspark.scratch import scratch_path
    path = scratch_path(spark, "shards")
    docs = spark.createDataFrame([(i, "x" * 100, 1, "x", "y", 1, 1) for i in range(50)], DOCS).drop("shard")
    sharding.write_shards(docs, path, limit=1000)
    back = spark.read.option("basePath", path).schema("doc_id long, text string, shard string").parquet(path)
    assert back.count() == 50 and back.groupBy("shard").count().filter("count > 10").count() == 0


def test_urls(spark):
    cases = {
        None: ("", "", None), "no scheme/en/": ("", "", None), "": ("", "", None), "http://": ("", "", None),
        "http://COM": ("com", "", None), "http://com/": ("com", "/", "com/"), "x://a.Example.com/en/1?q#f": ("a.example.com", "/en/1", "example.com/en/"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"), "http://www.example.com/EN/": ("www.example.com", "/EN/", "com/"),
        "http://a.www.example.com/en/x": ("a.www.example.com", "/en/x", "www.example.com/en/"), "http://notexample.com/en/1": ("notexample.com", "/en/1", "com/"),
        "http://x.net/fr/": ("x.net", "/fr/", "net/fr/"), "http://x.net/fr": ("x.net", "/fr", None), "http://x.net?/fr/": ("x.net", "", None),
        "http://a://b/c": ("a:", "//b/c", None), "http://É.Net/es/é#://": ("É.net", "/es/é", "net/es/"), "http://h/" + "a/" * 3000: ("h", "/" + "a/" * 3000, None),
        "http://x.net\n/es/\n?": ("x.net\n", "/es/\n", None),
    }
    action = {h + p: a for a, h, p in urls.RULES}
    rows = [(i, u, "x", 1, "y", 1) for i, u in enumerate(cases)] + [(None, "http://com/1", None, None, None, None)] * 2
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, PAGES), none).collect()}
    for i, (host, path, rule) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, action[rule] if rule else "allow")
    assert urls.judge_urls(spark.createDataFrame(rows, PAGES), none).count() == len(rows)
    assert urls.judge_urls(spark.createDataFrame([], PAGES), none).count() == 0


def test_templates_are_rejected_by_purity(spark):
    """A bad branch of a good host is cut off; its siblings, few labels and other hosts stay."""
    pages, labels = [], []
    for i in range(600):
        branch = ["news", "blog", "spam"][i % 3]
        pages.append((i, f"http://h.org/{branch}/{i}.html"))
        if i % 2:
            labels.append((i, int(branch == "spam" or i % 20 == 1)))
    pages += [(1000 + i, f"http://few.org/x/{i}") for i in range(3)]
    labels += [(1000, 1)]
    judged = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"))
    for r in judged.collect():
        assert r.verdict == ("block" if "/spam/" in r.path else "allow")
    tree = urls.template_tree(urls.split_url(spark.createDataFrame(pages, "page_id long, url string")), spark.createDataFrame(labels, "page_id long, bad int"))
    found = {r.template for r in tree.filter("host = 'h.org'").collect()}
    assert found == {"/=spam/*/$/$/$", "/*/*/$/$/$"}


def test_clean_branch_of_a_bad_host_stays(spark):
    """Ten bad branches and a good one: too few bad pages to be worse than their parent, but the good one differs."""
    pages = [(i, f"http://h.org/{'fine' if i % 11 == 10 else f'b{chr(97 + i % 11)}'}/{i}.html") for i in range(440)]
    labels = [(i, int("/fine/" not in url)) for i, url in pages]
    judged = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"))
    assert {(r.verdict, "/fine/" in r.path) for r in judged.collect()} == {("allow", True), ("block", False)}


@pytest.mark.parametrize("above", ["/2024/05/12/news", "/a/b/c/d/e/f/g"])
def test_deep_branches_are_told_apart(spark, above):
    """Bad and good branches at the fifth and at the eighth segment."""
    pages = [(i, f"http://h.org{above}/{['spam', 'fine', 'good'][i % 3]}/x/{i}.html") for i in range(300)]
    pages += [(1000 + i, f"http://h.org/{'q/' * i}") for i in range(12)]
    labels = [(i, int("/spam/" in url)) for i, url in pages if i < 300]
    schemas = "page_id long, url string", "page_id long, bad int"
    judged = urls.judge_urls(spark.createDataFrame(pages, schemas[0]), spark.createDataFrame(labels, schemas[1])).collect()
    assert len(judged) == len(pages)
    for r in judged:
        assert r.verdict == ("block" if "/spam/" in r.path else "allow")


def test_native_plans(spark):
    for name in ("op3_extendible_hashing", "op4_path_templates"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
