"""URL filters: a path-template tree per host, judged by smoothed labelled purity, in DataFrame expressions throughout.

1. A url's path is the list of its segments, all of them. Segments that vary by nature, i.e. hold a digit or more than 24
   characters, become ``*`` with their extension.
2. Pages are reduced to counts by distinct (host, template): pages, labelled pages, blocked ones. Labels are the rules'
   verdicts. All that follows works on these counts, however hot a host is.
3. The tree grows from the root as deep as the paths go. A branch without labels, or one whose labelled purity is
   statistically that of its siblings together (a squared z of at most ``Z2``), is merged with them into ``*``. What all
   paths of a node share is ``*`` at once, so a round of work is spent on branchings only.
4. A merged template's purity is its blocked share among labelled pages, shrunk by ``ALPHA`` pseudo-counts towards the
   same template over all hosts, itself shrunk towards all labelled pages. Its other pages are blocked if that is above
   ``REJECT`` and the template's own labels say so too: ``SUPPORT`` of them or more, most of them blocked. A host without
   labels is never blocked by what other hosts hold.

Rows: a null url, or one without ``://``, has an empty host and path and no rule; repeated rows and null ids get their
own result rows; very long paths are whole templates; other columns, whatever their names, are never read; ties (purity of
just ``REJECT``, half of the labels) allow; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import ascii_lower, attached, load, picked
from stepweave.plans.durable import durable

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
Z2, ALPHA, REJECT, SUPPORT = 4.0, 5.0, 0.5, 3
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = []
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found.append(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def segment(s: Column) -> Column:
    """A segment's token: itself in lower case, or a wildcard where it varies by nature."""
    wild = s.rlike("[0-9]") | (F.length(s) > 24)
    return F.when(wild, F.concat(F.lit("*"), ascii_lower(F.regexp_extract(s, r"(\.[A-Za-z]+)$", 1)))).otherwise(ascii_lower(s))


def templated(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, label (the rule's verdict or null) and the template's tokens ``keys``."""
    rows = picked(pages, page_id=id_col, url=url_col).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hit = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    return hit.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("label"), F.transform(parts, segment).alias("keys"))


def _shared(a: Column, b: Column) -> Column:
    """How many leading tokens two lists share."""
    step = lambda acc, x: F.when((acc >= 0) & x["a"].eqNullSafe(x["b"]), acc + 1).when(acc >= 0, -1 - acc).otherwise(acc)
    return F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(0), step, lambda acc: F.when(acc >= 0, acc).otherwise(-1 - acc))


def _wild(n: Column) -> Column:
    return F.array_repeat(F.lit("*"), n)


def template_tree(pages: DataFrame) -> DataFrame:
    """host, keys, n, merged (its tokens), purity, reject: one row for every distinct (host, template) of ``templated`` pages."""
    counts = [F.count("*").alias("n"), F.sum(F.col("label").isNotNull().cast("double")).alias("l"), F.sum((F.coalesce("label", F.lit("")) == "block").cast("double")).alias("b")]
    fields = ["host", "keys", "n", "l", "b", "merged"]
    active = durable(pages.groupBy("host", "keys").agg(*counts).withColumn("merged", F.array().cast("array<string>")))
    tree = active.limit(0)
    at = F.size("merged")
    rest = F.slice("keys", at + 1, F.greatest(F.size("keys") - at, F.lit(0)))
    while not active.isEmpty():
        node = active.groupBy("host", "merged").agg(F.count("*").alias("leaves"), F.min(rest).alias("lo"), F.max(rest).alias("hi"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        node = node.select("host", "merged", "leaves", "pl", "pb", _shared(F.col("lo"), F.col("hi")).alias("same"))
        rows = active.join(node, ["host", "merged"])
        tree = tree.unionByName(rows.where("leaves = 1").withColumn("merged", F.concat("merged", _wild(F.size(rest)))).select(*fields))
        open_ = rows.where("leaves > 1").withColumn("key", F.coalesce(F.get("keys", at + F.col("same")), F.lit("")))
        child = open_.groupBy("host", "merged", "key").agg(F.sum("l").alias("cl"), F.sum("b").alias("cb"))
        p, c = (F.col("pb") + 0.5) / (F.col("pl") + 1.0), (F.col("cb") + 0.5) / (F.col("cl") + 1.0)
        alike = (F.col("cl") == 0.0) | ((c - p) * (c - p) * (F.col("cl") + 1.0) <= Z2 * p * (1.0 - p))
        decided = open_.join(child, ["host", "merged", "key"])
        longer = F.concat("merged", _wild(F.col("same")), F.when(F.col("key") == "", F.array().cast("array<string>")).when(alike, F.array(F.lit("*"))).otherwise(F.array("key")))
        step = durable(decided.select("host", "keys", "n", "l", "b", longer.alias("merged"), (F.col("key") != "").alias("open")))
        tree = tree.unionByName(step.where("not open").select(*fields))
        active = step.where("open").select(*fields)
    tree = durable(tree)
    own = tree.groupBy("host", "merged").agg(F.sum("l").alias("ol"), F.sum("b").alias("ob"))
    over = own.groupBy("merged").agg(F.sum("ol").alias("tl"), F.sum("ob").alias("tb"))
    total = over.agg(F.coalesce(F.sum("tl"), F.lit(0.0)).alias("l"), F.coalesce(F.sum("tb"), F.lit(0.0)).alias("b")).first()
    prior = (F.col("tb") + ALPHA * ((F.lit(total["b"]) + 0.5) / (F.lit(total["l"]) + 1.0))) / (F.col("tl") + ALPHA)
    purity = (F.col("ob") + ALPHA * prior) / (F.col("ol") + ALPHA)
    reject = (purity > REJECT) & (F.col("ol") >= SUPPORT) & (F.col("ob") * 2 > F.col("ol"))
    judged = own.join(over, "merged").select("host", "merged", purity.alias("purity"), reject.alias("reject"))
    return durable(tree.select("host", "keys", "n", "merged").join(judged, ["host", "merged"]))


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every page."""
    rows = templated(pages, rules, id_col, url_col)
    tree = template_tree(rows)
    template = F.concat(F.lit("/"), F.concat_ws("/", "merged"))
    verdict = F.coalesce("label", F.when(F.col("reject"), "block").otherwise("allow"))
    return attached(rows, tree, ["host", "keys"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), template.alias("template"), "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judged(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def _sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    seg = f"case when regexp_matches(x, '[0-9]') or length(x) > 24 then '*' || {lower.format('regexp_extract(x, $$([.][A-Za-z]+)$$ || chr(36), 1)')} else {lower.format('x')} end"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{pick(v, h, p)}'" for v, h, p in order) + " end"
    c, p = "((cb+0.5)/(cl+1.0))", "((pb+0.5)/(pl+1.0))"
    parts = [
        f"u as (select page_id, coalesce({lower.format(f'regexp_extract(url, $${URL}$$, 1)')}, '') host, coalesce(regexp_extract(url, $${URL}$$, 2), '') path from pages)",
        f"q as (select *, {case(lambda v, h, p: h + p)} rule, {case(lambda v, h, p: v)} label, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {seg}) keys from u)",
        "t0 as (select host, keys, count(label)::double l, count(*) filter (label = 'block')::double b from q group by all)",
        "t as (select *, []::varchar[] merged, 0 d from t0 union all select host, keys, l, b, case when len(keys) <= d then merged "
        f"when cl = 0 or ({c} - {p}) * ({c} - {p}) * (cl + 1.0) <= {Z2}::double * {p} * (1.0 - {p}) then list_append(merged, '*') else list_append(merged, keys[d + 1]) end, d + 1 from "
        "(select *, sum(l) over (partition by host, merged, coalesce(keys[d + 1], '')) cl, sum(b) over (partition by host, merged, coalesce(keys[d + 1], '')) cb, sum(l) over (partition by host, merged) pl, sum(b) over (partition by host, merged) pb from t)"
        " where d < (select max(len(keys)) from t0))",
        "m as (select * from t where d = (select max(len(keys)) from t0))",
        "own as (select host, merged, sum(l) ol, sum(b) ob from m group by all)",
        "ov as (select merged, sum(ol) tl, sum(ob) tb from own group by all)",
        "z as (select (coalesce(sum(tb), 0.0) + 0.5) / (coalesce(sum(tl), 0.0) + 1.0) p0 from ov)",
        f"j as (select host, merged, ol, ob, (ob + {ALPHA}::double * ((tb + {ALPHA}::double * p0) / (tl + {ALPHA}::double))) / (ol + {ALPHA}::double) purity from own join ov using (merged), z)",
    ]
    return f"with recursive {', '.join(parts)} select page_id, host, path, rule, coalesce(label, case when purity > {REJECT} and ol >= {SUPPORT} and ob * 2 > ol then 'block' else 'allow' end) verdict, '/' || array_to_string(merged, '/') template from q join m using (host, keys) join j using (host, merged)"


OP4_SQL = _sql()
