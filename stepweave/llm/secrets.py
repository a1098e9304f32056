"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions throughout.

Every text is matched once. Matches of the three base kinds are always spans; in addition, opaque tokens (20 or more
token characters, a digit and a letter among them, ten or more different characters) are candidates. Only hashes of
matched values leave the scan. They are aggregated over the corpus by distinct repositories and owners. A value of one
owner looks live in however many of its repositories it lies; one of several owners is a widely copied example if there
are more than ``MAX_OWNERS`` of them, or if together they hold it in more than ``MAX_REPOS`` repositories. Live candidates
that no base span touches are added as spans of kind ``owned``.

A value that a third of all rows hold is reduced to its distinct (repository, owner) before the count; where verdicts
join back, such values (they are few) are broadcast and all others shuffled.

Rows: null text is empty; null owners or repositories count as one unnamed owner; repeated rows and null ids get their
own result rows; very long texts are scanned whole; spans that start together keep the order of their kinds; other
columns, whatever their names, are never read, and ``redacted`` keeps them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import attached, load, picked
from stepweave.plans.durable import durable

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group that holds the value, least length of that value)
BASE = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
MAX_OWNERS, MAX_REPOS = 2, 4
#: Up to so many redacted texts with so many spans together, the marks are broadcast; beyond it texts and marks are shuffled.
MARKS = 200_000
SPAN = "array<struct<s:int,rank:int,e:int,kind:string,value:string>>"


def matches(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """All matches as structs (s, rank, e, kind, value hash), in code points. Gaps and matches alternate, so sums of their lengths are the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    triples = F.arrays_zip(F.split(text, pattern, -1).alias("g"), found.alias("m"), values.alias("v"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out"))
    start = lambda acc, x: acc["at"] + F.length(x["g"])
    span = lambda acc, x: F.struct(start(acc, x).alias("s"), F.lit(rank).alias("rank"), (start(acc, x) + F.length(x["m"])).alias("e"), F.lit(kind).alias("kind"), F.sha2(x["v"], 256).alias("value"))
    good = lambda x: (F.length(x["v"]) >= least) & (_opaque(x["v"]) if kind == "owned" else F.lit(True))
    held = lambda acc: F.coalesce(acc["out"], F.array().cast(SPAN))
    step = lambda acc, x: F.struct((start(acc, x) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.when(x["m"].isNotNull() & good(x), F.array_append(held(acc), span(acc, x))).otherwise(held(acc)).alias("out"))
    none = F.array().cast(SPAN)
    return F.when(text.rlike(pattern), F.aggregate(triples, zero, step, lambda acc: held(acc))).otherwise(none)


def _opaque(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source") -> DataFrame:
    """One durable row per document: rid, doc_id, key (a hash of the text), owner, repo, spans of every kind."""
    rows = picked(docs, doc_id=id_col, text=text_col, owner=owner_col, repo=repo_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [matches(text, kind, rank, *rest).alias(kind) for rank, (kind, *rest) in enumerate(BASE)]
    owned = matches(text, "owned", len(BASE), CANDIDATE, 0, 20).alias("owned")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("owner", "repo")]
    found = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64(text).alias("key"), *named, *kinds, owned)
    base = F.concat(*[kind for kind, *_ in BASE])
    free = F.filter("owned", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    with_base = found.withColumn("base", base).select("rid", "doc_id", "key", "owner", "repo", *counts, "base", free.alias("owned"))
    return durable(with_base)


def ownership(scan: DataFrame) -> DataFrame:
    """value, n_repos, n_owners over the whole corpus, and n, the documents that hold it."""
    held = scan.select("owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "owned"), lambda x: x["value"]))).alias("value"))
    pairs = held.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    return pairs.groupBy("value").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("n"))


def looks_live(max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> Column:
    return (F.col("n_owners") <= 1) | ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def verdicts(scan: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """rid and its spans with ``live`` true or false, in order; rows without any span are left out."""
    spans = scan.select("rid", F.explode(F.concat("base", "owned")).alias("x")).withColumn("value", F.col("x.value"))
    known = durable(ownership(scan).select("value", "n", looks_live(max_owners, max_repos).alias("live")))
    judged = attached(spans, known, ["value"])
    row = F.struct("x.s", "x.rank", "x.e", "x.kind", "live")
    return judged.groupBy("rid").agg(F.array_sort(F.collect_list(row)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])))


def secrets(docs: DataFrame, **options: str) -> DataFrame:
    """Per document: counts by base kind, all spans in order, and each one's verdict.

    Columns: rid, doc_id, key, n_assign, n_access, n_hex, spans array<struct<s,rank,e,kind,live>> (base spans always;
    ``owned`` only where live).
    """
    scan = scanned(docs, **options)
    kept = F.filter("spans", lambda x: (x["kind"] != "owned") | x["live"])
    found = verdicts(scan).select("rid", kept.alias("spans"))
    none = F.array().cast("array<struct<s:int,rank:int,e:int,kind:string,live:boolean>>")
    return scan.select("rid", "doc_id", "key", "n_assign", "n_access", "n_hex").join(found, "rid", "left").withColumn("spans", F.coalesce("spans", none))


def redacted(docs: DataFrame, mask: str = "<secret>", id_col: str = "doc_id", text_col: str = "text", **options: str) -> DataFrame:
    """The documents with live-looking secrets masked, all columns kept; widely copied examples stay.

    Rows are matched by id and text, and equal ones are redacted alike, so repeated rows stay as they are.
    """
    live = secrets(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", "key", F.filter("spans", lambda x: x["live"]).alias("spans")).where(F.size("spans") > 0)
    marks = durable(live.groupBy("doc_id", "key").agg(F.first("spans").alias("spans")).toDF("m_id", "m_key", "spans"))
    names = docs.columns
    own = docs.toDF(*[f"c{k}" for k in range(len(names))])  # own names, so that none can clash
    doc, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda acc, x: F.when(x["s"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
    step = lambda acc, x: F.struct(F.greatest(acc["at"], x["e"]).alias("at"), piece(acc, x).alias("out"))
    masked = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    size = marks.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    joined = own.join(F.broadcast(marks) if sum(size) <= MARKS else marks, doc.eqNullSafe(F.col("m_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("m_key")), "left")
    return joined.select(*[(F.when(F.col("spans").isNotNull(), masked).otherwise(text) if name == text_col else F.col(f"c{k}")).alias(name) for k, name in enumerate(names)])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the ownership verdicts' counts."""
    found = secrets(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), live.alias("n_live"), (F.size("spans").cast("long") - live).alias("n_copied"))


def _sql_kind(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    opaque = "and regexp_matches(v[i], '[0-9]') and regexp_matches(v[i], '[A-Za-z]') and len(list_distinct(regexp_extract_all(v[i], '.'))) >= 10" if kind == "owned" else ""
    quoted = pattern.replace("'", "''")
    return f"""select rid, '{kind}' kind, {rank} rank, v[i] v, s, s + length(m[i]) e from (
      select *, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::bigint s
      from (select *, unnest(range(1, len(m) + 1)) i from (select rid, string_split_regex(t, '{quoted}') g, regexp_extract_all(t, '{quoted}') m, regexp_extract_all(t, '{quoted}', {group}) v from d)))
    where length(v[i]) >= {least} {opaque}"""


_SQL_ASSIGN = ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")")
OP2_SQL = f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, coalesce(source, '') o, coalesce(source, '') r from documents),
b as ({" union all ".join(_sql_kind(k, r, _SQL_ASSIGN if k == "assign" else p, g, n) for r, (k, p, g, n) in enumerate(BASE))}),
c as (select * from ({_sql_kind("owned", 3, CANDIDATE, 0, 20)}) x where not exists (select 1 from b where b.rid = x.rid and b.s < x.e and x.s < b.e)),
a as (select * from b union all select * from c),
w as (select v, count(distinct o) owners, count(distinct r) repos from a join d using (rid) group by v),
l as (select v, owners <= 1 or (owners <= {MAX_OWNERS} and repos <= {MAX_REPOS}) live from w),
f as (select a.*, live from a join l using (v) where kind <> 'owned' or live),
p as (select rid, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (kind <> 'owned') base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) spans,
  count(*) filter (live) n_live, count(*) filter (not live) n_copied from f group by rid)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans,
  coalesce(n_live, 0) n_live, coalesce(n_copied, 0) n_copied from d left join p using (rid)"""
