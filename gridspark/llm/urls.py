"""Operator 4: a URL filter with a path-template tree, with DataFrame functions only.

Rules decide the URLs that they fit.  For the others, each host has a tree of path segments.  Level by level, digits
become a wildcard, rare segments join the wildcard branch, and so do branches whose share of bad labelled pages differs
from the others' by no more than chance; a worse or a better one stays a branch.  A template, the path from the root, is
rejected if its smoothed share of good labelled pages is too small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.scratch import settle

#: (verdict, host, start of the path); the longest rule that fits decides.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Levels of the SQL (there deeper segments are one wildcard), and URLs that a branch of its own needs.
LEVELS, LEAST_URLS = 4, 5
#: Labelled pages that a branch needs to differ, standard errors by which it must, weight of the overall share in the
#: smoothing, and the purity below which a template is rejected.
LEAST_LABELLED, WORSE, PRIOR, PURITY = 10, 2.58, 10.0, 0.5
END, DEEPER, ANY = "$", "**", "*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """(page_id, host, path): both empty for a null url or one without ``://``."""
    rest = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return pages.select("page_id", rest.alias("_rest")).withColumn("_host", host) \
        .select("page_id", F.translate("_host", _UPPER, _LOWER).alias("host"), path.alias("path"))


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of host and path; null where no rule fits.  ``rules`` is a short list of settings."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def with_kind(urls: DataFrame) -> DataFrame:
    """``urls`` with the kind of path, all of its segments with digits as ``{n}``."""
    return urls.withColumn("_kind", F.regexp_replace("path", "[0-9]+", "{n}"))


def with_own(children: DataFrame, key: str) -> DataFrame:
    """(host, template, ``key``, own): which ``children`` (host, template, key, n, lab, bad) stay branches of their own.

    First those go that are worse than their parent, then, until none is left, those that differ either way from what
    the wildcard branch still holds.  So a clean branch leaves a bad host, and good siblings of a bad branch stay together.
    """
    at = ["host", "template"]
    share = F.try_divide("pbad", "plab")
    gap = F.try_divide("bad", "lab") - share
    chance = WORSE * F.sqrt(F.try_divide(share * (1 - share), F.col("lab")))
    children, owned, first = settle(children.withColumn("own", F.col(key) == END), "children"), -1, True
    while True:
        pool = (children if first else children.filter("not own")).groupBy(*at).agg(F.sum("lab").alias("plab"), F.sum("bad").alias("pbad"))
        differs = (F.col("n") >= LEAST_URLS) & (F.col("lab") >= LEAST_LABELLED) & ((gap if first else F.abs(gap)) > chance)
        children = children.join(pool, at, "left").withColumn("own", F.col("own") | F.coalesce(differs, F.lit(False))).drop("plab", "pbad")
        children = settle(children, "children")
        before, owned = owned, children.filter("own").count()
        if not first and owned == before:
            return children.select(*at, key, "own")
        first = False


def template_tree(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """(host, _kind, template, n, labelled, bad, purity): every kind of path, and what its template has.

    ``urls`` (page_id, host, path), ``labelled`` (page_id, bad 0 or 1).  The tree is built from counts per kind of path,
    not from URLs, and goes down as far as paths do.  A node is closed, with wildcards for what follows, once nothing
    below can split: too few pages or labels, labels of one sort, or no further segment.  A template has LEVELS + 1
    parts at least.
    """
    at = ["host", "template"]
    labels = labelled.groupBy("page_id").agg(F.max("bad").alias("bad"))
    kinds = with_kind(urls).join(labels, "page_id", "left").groupBy("host", "_kind") \
        .agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    kinds = settle(kinds.withColumns({"_segments": F.split("_kind", "/", -1), "template": F.lit("")}), "kinds")
    kinds = kinds.withColumn("_depth", F.size("_segments") - 1)
    total, all_bad = kinds.agg(F.sum("lab"), F.sum("bad")).first()
    prior = (total - all_bad) / total if total else 1.0
    counts = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    level, done = 0, []
    while True:
        nodes = kinds.groupBy(*at).agg(*counts, F.max("_depth").alias("_depth"))
        may_split = (F.col("n") >= LEAST_URLS) & (F.col("lab") >= LEAST_LABELLED) & (F.col("bad") > 0) & (F.col("bad") < F.col("lab"))
        kinds = settle(kinds.join(nodes.select(*at, (may_split & (F.col("_depth") > level)).alias("_open")), at), "kinds")
        reached = F.greatest("_depth", F.lit(level))
        rest = F.concat(F.repeat(F.lit("/" + ANY), reached - level), F.repeat(F.lit("/" + END), F.greatest(F.col("_depth") + 1, F.lit(LEVELS + 1)) - reached))
        done.append(kinds.filter("not _open").select("host", "_kind", "n", "lab", "bad", F.concat("template", rest).alias("template")))
        kinds = kinds.filter("_open").drop("_open")
        if kinds.isEmpty():
            break
        kinds = kinds.withColumn("_part", F.coalesce(F.concat(F.lit("="), F.get("_segments", F.lit(level + 1))), F.lit(END)))
        own = with_own(kinds.groupBy(*at, "_part").agg(*counts), "_part")
        chosen = own.select(*at, "_part", F.when(F.col("own"), F.col("_part")).otherwise(F.lit(ANY)).alias("_as"))
        kinds = kinds.join(chosen, [*at, "_part"]).withColumn("template", F.concat("template", F.lit("/"), "_as")).drop("_part", "_as")
        level += 1
    kinds = reduce(DataFrame.unionByName, done)
    stats = kinds.groupBy(*at).agg(F.sum("n").alias("n"), F.sum("lab").alias("labelled"), F.sum("bad").alias("bad"))
    stats = stats.withColumn("purity", (F.col("labelled") - F.col("bad") + PRIOR * prior) / (F.col("labelled") + PRIOR))
    return kinds.select("host", "_kind", "template").join(stats, at)


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, purity: float = PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url); ``labelled`` is (page_id, bad).

    A null url and one without ``://`` have empty host and path, and form a host like others.  Without labels nothing
    is rejected.  Null page ids and repeated rows are kept; of several labels of a page a bad one counts; other columns
    are ignored; an empty table gives no rows.
    """
    urls = split_url(pages)
    rejected = template_tree(urls, labelled).filter(F.col("purity") < purity).select("host", "_kind", F.lit("block").alias("_method"))
    rule, verdict = rule_columns(rules)
    judged = with_kind(urls).join(rejected, ["host", "_kind"], "left").withColumns({"rule": rule, "_verdict": verdict})
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_verdict", "_method", F.lit("allow")).alias("verdict"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of pages made from labelled documents: the number that ends a path is the document's id.

    Bad are toxic documents and those of low quality.
    """
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    named = split_url(pages).filter(F.col("page_id").isNotNull()).select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    bad = labels.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int").alias("bad"))
    return named.join(bad, "doc_id").select("page_id", "bad")


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The verdicts on ``pages`` in SQL, with labels from ``labels``."""
    cases = {"rule": "", "verdict": ""}
    for action, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        fits = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
        cases["rule"] += f" when {fits} then '{host}{path}'"
        cases["verdict"] += f" when {fits} then '{action}'"
    raw = [f"t{i}" for i in range(LEVELS + 1)]
    kinds = ", ".join(f"coalesce('=' || regexp_replace(parts[{i + 2}], '[0-9]+', '{{n}}', 'g'), '{END}') as t{i}" for i in range(LEVELS))
    levels = ""
    for i in range(LEVELS):
        worse = f"c.lab >= {LEAST_LABELLED} and c.bad / c.lab - p.pbad / p.plab > {WORSE} * sqrt((p.pbad / p.plab) * (1 - (p.pbad / p.plab)) / c.lab)"
        levels += f"""
c{i} as (select host, template, t{i}, sum(n) as n, sum(lab) as lab, sum(bad) as bad from k{i} group by all),
p{i} as (select host, template, sum(lab) as plab, sum(bad) as pbad from k{i} group by all),
k{i + 1} as (select k.* replace (k.template || '/' || case when c.t{i} = '{END}' or (c.n >= {LEAST_URLS} and {worse}) then c.t{i} else '{ANY}' end as template)
  from k{i} k join c{i} c using (host, template, t{i}) join p{i} p using (host, template)),"""
    return f"""
with s as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from s),
u as (select page_id, translate(h, '{_UPPER}', '{_LOWER}') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from h),
r as (select *, string_split(path, '/') as parts from u),
x as (select page_id, host, path, {kinds}, case when len(parts) > {LEVELS + 1} then '{DEEPER}' else '{END}' end as t{LEVELS} from r),
d as (select page_id, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[a-z]+)?/?$', 1), '') as bigint) as doc_id from u),
l as (select page_id, max(case when coalesce(toxic, 0) = 1 or coalesce(quality, 1) = 0 then 1 else 0 end) as bad from d join labels using (doc_id) group by all),
k0 as (select host, {', '.join(raw)}, count(*) as n, count(bad) as lab, coalesce(sum(bad), 0) as bad, '' as template from x left join l using (page_id) group by all),{levels}
k as (select * replace (template || '/' || t{LEVELS} as template) from k{LEVELS}),
a as (select (sum(lab) - sum(bad)) / sum(lab) as prior from k),
g as (select host, template, sum(lab) as lab, sum(bad) as bad from k group by all),
j as (select k.host, {', '.join('k.' + t for t in raw)} from k join g using (host, template), a where (g.lab - g.bad + {PRIOR} * coalesce(prior, 1)) / (g.lab + {PRIOR}) < {PURITY})
select page_id, x.host, path, case{cases['rule'].replace('host', 'x.host')} end as rule,
  coalesce(case{cases['verdict'].replace('host', 'x.host')} end, case when j.host is not null then 'block' end, 'allow') as verdict
from x left join j on {' and '.join(f'x.{c} = j.{c}' for c in ['host', *raw])}"""
