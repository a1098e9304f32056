"""One query per operator over the driver's tables, with SQL where SQL can say the same.

The tables hold no test suites, so operators run on stand-ins: parts are definitions (name = matcher, type and size = handler),
events are behaviour, nations and customers make feature texts, documents are files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import keys, matchers, metrics
from stepweave.model import DEFINITIONS, Config
from stepweave.operators import candidates, forest, modes, usage, verify
from stepweave.operators.components import connected_components
from stepweave.plans.durable import durable
from stepweave.sources import code, files, gherkin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PARTS = """(select p_partkey def_id, case when p_partkey % 4 = 0 then replace(p_name, ' ', '  ') else p_name end matcher, p_name normalized,
  p_type || '/' || p_size structural, p_type || '/' || p_size || '/' || p_brand alpha, 'src/' || p_brand || '.ts' path, p_brand, p_type, p_size from part)"""


def part_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as definitions; every fourth name has two blanks, so it is equal only once normalized."""
    p = read(spark, sf_dir, "part")
    structural = F.concat_ws("/", "p_type", F.col("p_size").cast("string"))
    matcher = F.when(F.col("p_partkey") % 4 == 0, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise(F.col("p_name"))
    place = F.struct(F.concat(F.lit("src/"), "p_brand", F.lit(".ts")).alias("path"), F.col("p_partkey").cast("int").alias("line"), F.lit(1).alias("column"), F.col("p_partkey").cast("int").alias("end_line"), F.lit(9).alias("end_column"))
    found = p.select(
        F.col("p_partkey").cast("bigint").alias("def_id"), matcher.alias("matcher"), F.lit("cucumber-expression").alias("matcher_kind"), F.lit("").alias("matcher_flags"),
        keys.normalized_expression(matcher).alias("normalized_matcher"), structural.alias("h_exact"), structural.alias("h_normalized"),
        F.concat_ws("/", structural, "p_brand").alias("h_alpha"), structural.alias("h_structural"),
        F.array(F.concat(F.lit("call:"), "p_type"), F.concat(F.lit("call:"), F.col("p_size").cast("string"))).alias("events"),
        F.lit("").alias("snippet"), F.lit(True).alias("comparable"), F.lit(False).alias("trivial"), F.lit("complete").alias("effect_stream"), F.lit(None).cast("string").alias("capture_scope"),
        F.lit("cucumber").alias("framework"), F.lit("Given").alias("registration"), place.alias("location"), F.array().cast("array<struct<rule:string,reason:string>>").alias("inline_suppressions"),
    )
    return candidates.classified(found)


@query(f"select normalized as normalized_matcher, count(*) n, count(distinct matcher) variants, min(def_id) first_id from {PARTS} group by 1 having count(*) > 1")
def duplicate_matcher_groups(spark, sf_dir):
    """Equal and equivalent matchers."""
    return part_definitions(spark, sf_dir).groupBy("normalized_matcher").agg(F.count("*").alias("n"), F.count_distinct("matcher").alias("variants"), F.min("def_id").alias("first_id")).where("n > 1")


def _spanning_sql(source: str, group: str, part: str) -> str:
    return f"""h as (select g, p, head, row_number() over (partition by g order by head) rk from (select {group} g, {part} p, min(def_id) head from {source} group by 1, 2)),
  e as (select g, min(head) filter (rk = 1) h1, min(head) filter (rk = 2) h2, min(p) filter (rk = 1) p1 from h group by g having count(*) > 1)"""


@query(f"""with d as (select * from {PARTS}), {_spanning_sql('d', 'normalized', 'matcher')}
select a, b from (select lag(def_id) over (partition by normalized, matcher order by def_id) a, def_id b from d) where a is not null
union select least(x, y), greatest(x, y) from (select case when matcher = p1 then h2 else h1 end x, def_id y from d join e on normalized = g where matcher <> p1 or def_id <> h1)""")
def normalized_candidates(spark, sf_dir):
    """Chains and spanning edges of equal matchers."""
    return candidates.normalized_candidates(part_definitions(spark, sf_dir)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query(f"""with d as (select * from {PARTS}), {_spanning_sql('d', 'alpha', 'normalized')}
select distinct least(x, y) a, greatest(x, y) b from (select case when normalized = p1 then h2 else h1 end x, def_id y from d join e on alpha = g where normalized <> p1 or def_id <> h1)""")
def identical_candidates(spark, sf_dir):
    """Equal handlers behind different matchers."""
    return candidates.identical_candidates(part_definitions(spark, sf_dir)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query(f"select l.def_id a, r.def_id b from {PARTS} l join {PARTS} r on l.structural = r.structural and l.def_id < r.def_id and l.alpha <> r.alpha and l.normalized <> r.normalized")
def structural_candidates(spark, sf_dir):
    """One structure, different handlers and matchers."""
    return candidates.structural_candidates(part_definitions(spark, sf_dir))[0].select("a", "b")


#: Sizes to a multiple of ten and no type: few classes with many matchers and handlers each.
_COARSE = f"(select *, 'size ' || (p_size // 10) class, min(def_id) over (partition by p_size // 10, normalized) g from {PARTS})"
_PROPOSED = f"""(select l.class, least(l.def_id, r.def_id) a, greatest(l.def_id, r.def_id) b, row_number() over (partition by l.class order by l.g, r.g, l.def_id, r.def_id) k
  from {_COARSE} l join {_COARSE} r on l.class = r.class and l.g < r.g and l.p_brand <> r.p_brand)"""


def coarse_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = part_definitions(spark, sf_dir)
    size = F.floor(F.element_at(F.split("h_structural", "/"), -1).cast("int") / 10).cast("string")
    return d.withColumns({"h_structural": F.concat(F.lit("size "), size), "h_alpha": F.regexp_extract("location.path", "src/(.*)[.]ts", 1), "identity": F.lit("one"), "events": F.array(F.lit("call:one")), "run": F.array(F.lit("call:one"))})


@query(f"select a, b from {_PROPOSED} where k <= 1000")
def structural_limit(spark, sf_dir):
    """J3 at a limit of 1,000 pairs a class: which ones are kept, without making the others."""
    return candidates.structural_candidates(coarse_definitions(spark, sf_dir), 1000)[0].select("a", "b")


@query(f"select class h_structural, count(*)::bigint total, greatest(count(*) - 1000, 0)::bigint skipped from {_PROPOSED} group by 1")
def structural_proposals(spark, sf_dir):
    """V8: pairs that each class proposes, and those beyond a limit, counted from sizes."""
    totals = candidates.structural_groups(candidates.structural_rows(coarse_definitions(spark, sf_dir))).select("h_structural", F.col("total").cast("bigint").alias("total")).distinct()
    return totals.withColumn("skipped", F.greatest(F.col("total") - 1000, F.lit(0)).cast("bigint"))


@query(f"""with s as (select def_id, normalized m, unnest(list_distinct(list_transform(range(1, length(normalized) - 1), lambda i: substr(normalized, i, 3)))) x from {PARTS}),
n as (select x, count(*) n from s group by 1),
few as (select l.def_id a, r.def_id b from s l join s r on l.x = r.x and l.def_id < r.def_id join n on n.x = l.x where n <= {candidates.POSTING}),
many as (select least(def_id, after) a, greatest(def_id, after) b from (select def_id, lead(def_id) over (partition by x order by m, def_id) after from s join n using (x) where n > {candidates.POSTING}) where after is not null)
select a, b from (select * from few union select * from many) join {PARTS} l on l.def_id = a join {PARTS} r on r.def_id = b
where l.normalized <> r.normalized and not (l.alpha <> r.alpha and l.structural = r.structural) and (l.p_type = r.p_type or l.p_size = r.p_size)""")
def blocking_candidates(spark, sf_dir):
    """Pairs by shared trigrams, lexical neighbours where a trigram is common, whose handlers have half in common."""
    return candidates.blocking_candidates(part_definitions(spark, sf_dir)).select("a", "b")


@query(f"""with m as (select distinct normalized s from {PARTS}), g as (select s, unnest(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) shingle from m)
select shingle, count(*) n from g group by 1""")
def shingle_postings(spark, sf_dir):
    """V7: trigram postings of distinct matchers."""
    return part_definitions(spark, sf_dir).select("normalized_matcher").distinct().select(F.explode(keys.shingles(F.col("normalized_matcher"))).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))


_NAMES = "(select p_name s, min(p_partkey) id from part group by 1)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("s")).agg(F.min("p_partkey").alias("id"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names that share a word, as (ls, rs)."""
    n = names(spark, sf_dir).withColumn("w", F.explode(keys.words(F.col("s"))))
    left, right = n.select("w", F.col("s").alias("ls"), F.col("id").alias("li")), n.select("w", F.col("s").alias("rs"), F.col("id").alias("ri"))
    return left.join(right, "w").where("li < ri").select("ls", "rs").distinct()


_PAIRS = f"(select distinct l.s ls, r.s rs from {_NAMES} l join {_NAMES} r on l.id < r.id and len(list_intersect(string_split(l.s, ' '), string_split(r.s, ' '))) > 0)"
_EDIT = "(1.0::double - levenshtein(ls, rs)::double / greatest(length(ls), length(rs)))"


@query(f"select ls, rs, levenshtein(ls, rs)::int distance, floor(greatest({_EDIT}, jaro_winkler_similarity(ls, rs)) * 1000 + 0.5) / 1000 score from {_PAIRS}")
def matcher_similarity(spark, sf_dir):
    """V2 to V4, P27."""
    return name_pairs(spark, sf_dir).select("ls", "rs", F.levenshtein("ls", "rs").alias("distance"), keys.round_score(metrics.combined_score(F.col("ls"), F.col("rs"))).alias("score"))


@query(f"select ls, rs from {_PAIRS} where greatest({_EDIT}, jaro_winkler_similarity(ls, rs)) >= case when greatest(length(ls), length(rs)) <= 12 then 0.92 else 0.90 end")
def near_matchers(spark, sf_dir):
    """F7 over pairs that share a word."""
    return name_pairs(spark, sf_dir).where(metrics.near_gate(F.col("ls"), F.col("rs"), metrics.combined_score(F.col("ls"), F.col("rs"))))


@query(f"""with w as (select *, string_split(ls, ' ') l, string_split(rs, ' ') r from {_PAIRS}),
p as (select *, least(len(l), len(r)) m, (select coalesce(min(i) - 1, least(len(l), len(r))) from range(1, least(len(l), len(r)) + 1) t(i) where l[i] <> r[i]) p from w),
q as (select *, (select coalesce(min(i) - 1, m - p) from range(1, m - p + 1) t(i) where l[len(l) - i + 1] <> r[len(r) - i + 1]) s from p),
c as (select *, l[p + 1 : len(l) - s] a, r[p + 1 : len(r) - s] b from q)
select ls, rs, greatest(len(a), len(b))::int span from c where greatest({_EDIT}, jaro_winkler_similarity(ls, rs)) >= 0.6 and greatest(len(a), len(b)) <= 3
  and len(list_intersect(list_intersect(a, b), list_concat(a[2 : len(a) - 1], b[2 : len(b) - 1]))) = 0""")
def parameterizable_matchers(spark, sf_dir):
    """F8: pairs that one parameter could cover."""
    span = metrics.change_span_udf(keys.words(F.col("ls")), keys.words(F.col("rs")))
    return name_pairs(spark, sf_dir).withColumn("span", span).where((F.col("span") <= 3) & (metrics.combined_score(F.col("ls"), F.col("rs")) >= 0.6))


@query("""with w as (select p_partkey, list_filter(string_split_regex(lower(p_name || case when p_partkey % 3 = 0 then ' not enabled' else ' disabled' end), '[^a-z0-9]+'), lambda x: x <> '') ws from part)
select p_partkey, list_contains(ws, 'not') negated, list_contains(ws, 'not') or list_contains(ws, 'disabled') conflict, len(ws) n_words from w""")
def polarity_conflicts(spark, sf_dir):
    """Negations and opposites against ``<name> enabled``."""
    p = read(spark, sf_dir, "part")
    own = keys.words(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " not enabled").otherwise(" disabled")))
    other = keys.words(F.concat("p_name", F.lit(" enabled")))
    return p.select("p_partkey", F.array_contains(own, "not").alias("negated"), metrics.polarity_conflict(own, other).alias("conflict"), F.size(own).alias("n_words"))


@query("""select doc_id, substr(sha256('stepweave:fingerprint:1:single'::blob || '\\x00'::blob || encode(text)), 1, 32) single,
  substr(sha256('stepweave:fingerprint:1:parts'::blob || '\\x00'::blob || unhex(lpad(format('{:X}', strlen(source)), 16, '0')) || encode(source) || unhex(lpad(format('{:X}', strlen(text)), 16, '0')) || encode(text)), 1, 32) parts from documents""")
def stable_fingerprints(spark, sf_dir):
    """P11, P12."""
    return read(spark, sf_dir, "documents").select("doc_id", keys.fingerprint(F.col("text")).alias("single"), keys.fingerprint_parts(F.col("source"), F.col("text")).alias("parts"))


@query("select event_id, case event_type when 'error' then 'deferred-assert' when 'view' then 'method' when 'click' then 'call' else 'other' end kind from events")
def event_kinds(spark, sf_dir):
    """P6."""
    return read(spark, sf_dir, "events").select("event_id", keys.event_kind(behaviour()).alias("kind"))


def behaviour():
    return F.when(F.col("event_type") == "error", F.concat(F.lit("deferred-assert:"), "event_type")).when(F.col("event_type") == "view", F.concat(F.lit("method:"), "event_type")).when(F.col("event_type") == "click", F.concat(F.lit("call:"), "event_type")).otherwise(F.col("event_type"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of one value class, in order."""
    rows = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("lane"), "event_id", behaviour().alias("e"))
    return rows.groupBy("user_id", "lane").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "e"))), lambda x: x["e"]).alias("events"))


_EVENTS = "(select user_id, event_id % 7 lane, event_id, case event_type when 'error' then 'deferred-assert:error' when 'view' then 'method:view' when 'click' then 'call:click' else event_type end e from events)"


@query(f"""select user_id, lane, count(*) filter (not starts_with(e, 'method:')) n_run, coalesce(string_agg(e, ',' order by event_id) filter (starts_with(e, 'deferred-assert:')), '') deferred,
  coalesce(array_to_string(list_sort(list_distinct(list(e) filter (starts_with(e, 'call:') or starts_with(e, 'deferred-assert:')))), ','), '') anchors from {_EVENTS} group by 1, 2""")
def behavior_anchors(spark, sf_dir):
    """P7, P8, and the deferred part."""
    return streams(spark, sf_dir).select("user_id", "lane", F.size(keys.run_events(F.col("events"))).cast("bigint").alias("n_run"), F.array_join(keys.deferred_events(F.col("events")), ",").alias("deferred"), F.array_join(keys.anchors(F.col("events")), ",").alias("anchors"))


@query(f"""with c as (select user_id, lane, e, count(*) n from {_EVENTS} group by 1, 2, 3), s as (select user_id, lane, count(*) n from {_EVENTS} group by 1, 2),
p as (select l.user_id, l.n ln, r.n rn from s l join s r on l.user_id = r.user_id and l.lane = 0 and r.lane = 1)
select p.user_id, coalesce(sum(least(a.n, coalesce(b.n, 0))), 0)::int shared, greatest(any_value(ln), any_value(rn))::int longer from p left join c a on a.user_id = p.user_id and a.lane = 0 left join c b on b.user_id = p.user_id and b.lane = 1 and b.e = a.e group by 1""")
def event_multiset_overlap(spark, sf_dir):
    """F9's multiset intersection of two streams of a user."""
    s = streams(spark, sf_dir)
    both = s.where("lane = 0").select("user_id", F.col("events").alias("l")).join(s.where("lane = 1").select("user_id", F.col("events").alias("r")), "user_id")
    return both.select("user_id", metrics.multiset_overlap(F.col("l"), F.col("r")).alias("shared"), F.greatest(F.size("l"), F.size("r")).alias("longer"))


@query(f"""with recursive t as (select user_id, lane, list(e order by event_id) es, list(e order by event_id) filter (true) x from {_EVENTS} group by 1, 2),
p as (select a.user_id, a.es l, b.es r from t a join t b on a.user_id = b.user_id and a.lane = 0 and b.lane = 1),
d as (select user_id, l, r, 0 i, list_transform(r, lambda x: 0) cells from p union all
  select user_id, l, r, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when l[i + 1] = r[k] then (case when k > 1 then cells[k - 1] else 0 end) + 1 else cells[k] end))) from d where i < len(l))
select user_id, floor(case when l = r then 1.0 when user_id % 5 = 0 then 0.95 else cells[len(r)]::double / greatest(len(l), len(r)) end * 1000 + 0.5) / 1000 similarity from d where i = len(l)""")
def handler_ladder(spark, sf_dir):
    """V5, V6: similarity of two streams of a user."""
    s = streams(spark, sf_dir)
    both = s.where("lane = 0").select("user_id", F.col("events").alias("l")).join(s.where("lane = 1").select("user_id", F.col("events").alias("r")), "user_id")
    return both.select("user_id", keys.round_score(metrics.handler_similarity(F.lit(True), F.col("user_id") % 5 == 0, F.lit(True), F.col("l"), F.col("r"))).alias("similarity"))


@query(f"""with t as (select user_id, lane, list(e order by event_id) es from {_EVENTS} group by 1, 2), f as (select lane, user_id, es from t),
c as (select user_id, lane, e, count(*) n from {_EVENTS} group by 1, 2, 3),
m as (select l.user_id, l.es, r.es rs, coalesce((select sum(least(a.n, b.n)) from c a join c b on a.e = b.e and a.user_id = b.user_id where a.user_id = l.user_id and a.lane = 0 and b.lane = 1 and not starts_with(a.e, 'method:')), 0) shared from f l join f r on l.user_id = r.user_id and l.lane = 0 and r.lane = 1),
x as (select user_id, shared, list_filter(es, lambda e: not starts_with(e, 'method:')) l, list_filter(rs, lambda e: not starts_with(e, 'method:')) r from m)
select user_id, (user_id % 4 = 0 and l = r) or (greatest(len(l), len(r)) > 0 and len(list_filter(list_intersect(l, r), lambda e: starts_with(e, 'call:') or starts_with(e, 'deferred-assert:'))) > 0 and shared / greatest(len(l), len(r)) >= 0.5) reaches from x""")
def handler_gate(spark, sf_dir):
    """same structure and events, or a shared anchor and half of the longer stream in common."""
    s = streams(spark, sf_dir).withColumns({"run": keys.run_events(F.col("events")), "anchors": keys.anchors(F.col("events"))})
    l, r = s.where("lane = 0").select("user_id", F.col("run").alias("lr"), F.col("anchors").alias("la")), s.where("lane = 1").select("user_id", F.col("run").alias("rr"), F.col("anchors").alias("ra"))
    return l.join(r, "user_id").select("user_id", metrics.reaches_handler_gate(F.col("user_id") % 4 == 0, F.col("lr"), F.col("rr"), F.col("la"), F.col("ra")).alias("reaches"))


@query(f"select def_id node, min(def_id) over (partition by normalized) component from {PARTS} qualify count(*) over (partition by normalized) > 1")
def matcher_components(spark, sf_dir):
    """A4: components over J1's edges."""
    return connected_components(candidates.normalized_candidates(part_definitions(spark, sf_dir)), "a", "b")


def _group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a handler class, as far as their forest depends on them."""
    d = part_definitions(spark, sf_dir).select("def_id", "h_alpha", F.col("location.path").alias("path"))
    return forest.all_pairs_forest(d, ["h_alpha"])


@query(f"select p_brand rule, m a, def_id b from (select p_brand, def_id, min(def_id) over (partition by alpha) m from {PARTS}) where m < def_id")
def spanning_forests(spark, sf_dir):
    """A5: of all pairs of a handler class, what Kruskal keeps."""
    edges = _group_edges(spark, sf_dir).select(F.regexp_extract("path", "src/(.*).ts", 1).alias("rule"), "a", "b")
    return forest.spanning_forest(edges, ["rule"])


@query(f"select min(def_id) component, count(*)::int n, array_to_string(list_sort(list(def_id)), ',') members from {PARTS} group by normalized having count(*) >= 5")
def matcher_clusters(spark, sf_dir):
    """Components of five or more."""
    edges = candidates.normalized_candidates(part_definitions(spark, sf_dir)).select(F.lit("m").alias("rule"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return forest.clusters(edges, ["rule"]).select("component", F.size("members").alias("n"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


PATTERNS = (("user {int} performs click", "cucumber-expression"), ("user {int} performs {word}", "cucumber-expression"), ("user 1 performs view", "cucumber-expression"), ("^user [0-9]+ performs (click|view)$", "regular-expression"), ("user {int} walks/runs slowly", "cucumber-expression"), ("{word} 2 performs error(s)", "cucumber-expression"), ("user {unknown} sleeps", "cucumber-expression"))


def step_definitions(spark: SparkSession) -> DataFrame:
    rows = [(k, m, kind, "", m, "", "", f"h{k}", f"h{k}", [], "", True, False, "complete", None, "cucumber", "Given", ("steps.ts", k + 1, 1, k + 1, 9), []) for k, (m, kind) in enumerate(PATTERNS)]
    return matchers.with_expressions(candidates.classified(spark.createDataFrame(rows, DEFINITIONS)), {})


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    place = F.struct(F.lit("a.feature").alias("path"), F.col("event_id").cast("int").alias("line"), F.lit(1).alias("column"), F.col("event_id").cast("int").alias("end_line"), F.lit(9).alias("end_column"))
    return e.select(F.col("event_id").alias("step_seq"), F.lit("Given").alias("keyword"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" performs "), "event_type").alias("text"), place.alias("location"))


_STEP = "(select event_id, 'user ' || user_id || ' performs ' || event_type text from events)"
_RX = "(values (0, '^user -?[0-9]+ performs click$'), (1, '^user -?[0-9]+ performs [^ ]+$'), (2, '^user 1 performs view$'), (3, '^user [0-9]+ performs (click|view)$'), (4, '^user -?[0-9]+ (walks|runs) slowly$'), (5, '^[^ ]+ 2 performs error(s)?$')) r(def_id, rx)"


@query(f"select distinct text, def_id::bigint def_id from {_STEP} s, {_RX} where regexp_matches(text, rx)")
def step_matches(spark, sf_dir):
    """Which definitions accept which texts."""
    return usage.text_matches(usage.distinct_texts(event_steps(spark, sf_dir)), step_definitions(spark)).where("authoritative").select("text", "def_id").distinct()


@query(f"""with m as (select text, list_sort(list(def_id)) ids from (select distinct text, def_id from {_STEP} s, {_RX} where regexp_matches(text, rx)) group by 1)
select event_id first_seq, array_to_string(ids, ',') members, 1::bigint expansions from {_STEP} join m using (text) where len(ids) > 1""")
def ambiguous_steps(spark, sf_dir):
    """A2: steps that several definitions accept."""
    steps = event_steps(spark, sf_dir)
    found = usage.ambiguities(steps, usage.text_matches(usage.distinct_texts(steps), step_definitions(spark)).distinct())
    return found.select("first_seq", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "expansions")


@query(f"select def_id::bigint def_id from {_RX} where not exists (select 1 from {_STEP} s where regexp_matches(text, rx))")
def unused_definitions(spark, sf_dir):
    """Definitions that no step reaches; unprovable ones count as used."""
    steps, prepared = event_steps(spark, sf_dir), step_definitions(spark)
    return usage.unused(prepared, usage.used(prepared, usage.text_matches(usage.distinct_texts(steps), prepared)))


@query("select n_nationkey::bigint a, 1000::bigint b, 'nation ' || n_name || ' trades' witness from nation where n_name not like '% %' and n_regionkey <> 0")
def overlapping_matchers(spark, sf_dir):
    """Pairs that accept one witness and that no step proves ambiguous. One matcher a nation, one for any."""
    n = read(spark, sf_dir, "nation")
    own = n.select(F.col("n_nationkey").cast("bigint").alias("def_id"), F.concat(F.lit("nation "), "n_name", F.lit(" trades")).alias("m")).unionByName(spark.createDataFrame([(1000, "nation {word} trades")], "def_id bigint, m string"))
    place = F.struct(F.lit("steps.ts").alias("path"), F.col("def_id").cast("int").alias("line"), F.lit(1).alias("column"), F.col("def_id").cast("int").alias("end_line"), F.lit(9).alias("end_column"))
    blank = F.lit("")
    d = own.select("def_id", F.col("m").alias("matcher"), F.lit("cucumber-expression").alias("matcher_kind"), blank.alias("matcher_flags"), F.col("m").alias("normalized_matcher"), blank.alias("h_exact"), blank.alias("h_normalized"), F.col("m").alias("h_alpha"), F.col("m").alias("h_structural"), F.array().cast("array<string>").alias("events"), blank.alias("snippet"), F.lit(True).alias("comparable"), F.lit(False).alias("trivial"), F.lit("complete").alias("effect_stream"), F.lit(None).cast("string").alias("capture_scope"), F.lit("cucumber").alias("framework"), F.lit("Given").alias("registration"), place.alias("location"), F.array().cast("array<struct<rule:string,reason:string>>").alias("inline_suppressions"))
    prepared = durable(matchers.with_expressions(candidates.classified(d), {}))
    key = F.col("n_nationkey").cast("int")
    at = F.struct(F.lit("a.feature").alias("path"), key.alias("line"), F.lit(1).alias("column"), key.alias("end_line"), F.lit(9).alias("end_column"))
    steps = n.where("n_regionkey = 0").select(F.col("n_nationkey").cast("bigint").alias("step_seq"), F.lit("Given").alias("keyword"), F.concat(F.lit("nation "), "n_name", F.lit(" trades")).alias("text"), at.alias("location"))
    found = usage.ambiguities(steps, usage.text_matches(usage.distinct_texts(steps), prepared).distinct())
    return usage.overlaps(prepared, found)


@query("select c_custkey, n_nationkey, 'the <a' || n_name || ' of ' || c_mktsegment || ' stays <x>' as text from customer join nation on c_nationkey = n_nationkey")
def outline_expansion(spark, sf_dir):
    """Templates times example rows, stray angles and unknown names kept."""
    t = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").join(read(spark, sf_dir, "nation"), "n_nationkey")
    values = F.create_map(F.lit("b"), F.col("n_name"), F.lit("seg"), F.col("c_mktsegment"))
    return t.select("c_custkey", "n_nationkey", keys.substituted(F.lit("the <a<b> of <seg> stays <x>"), values).alias("text"))


@query("""select 'features/' || r_name || '.feature' path, keyword, case keyword when 'Given' then 'a <thing> is in ' else 'it is ' end || n_name as text, case keyword when 'Given' then 3 else 4 end::int as line
  from region join nation on r_regionkey = n_regionkey, (values ('Given'), ('Then')) k(keyword)""")
def gherkin_steps(spark, sf_dir):
    """One feature per region, its nations as example rows."""
    rows = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    table = F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda n: F.concat(F.lit("      | "), n, F.lit(" |"))), "\n")
    text = F.concat(F.lit("Feature: regions\n  Scenario Outline: one\n    Given a <thing> is in <name>\n    Then it is <name>\n    Examples:\n      | name |\n"), table, F.lit("\n"))
    sources = rows.groupBy("r_name").agg(text.alias("content")).select(F.concat(F.lit("features/"), "r_name", F.lit(".feature")).alias("path"), "content")
    steps, examples = gherkin.templates(sources)
    return gherkin.expanded(steps, examples).select("location.path", "keyword", "text", "location.line")


@query("select 'src/' || s_suppkey || '.ts' path, 'supplier ' || s_name || ' is ready' matcher, 2::int as line, 'call:prepare' events, s_suppkey % 2 = 0 as trivial from supplier")
def script_definitions(spark, sf_dir):
    """A source per supplier with one registration."""
    body = F.when(F.col("s_suppkey") % 2 == 0, "{}").otherwise("{ prepare(name) }")
    text = F.concat(F.lit("import { Given } from \"@cucumber/cucumber\"\nGiven('supplier "), "s_name", F.lit(" is ready', (name) => "), body, F.lit(");\n"))
    found, _ = code.extracted(read(spark, sf_dir, "supplier").select(F.concat(F.lit("src/"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("path"), text.alias("content")))
    return found.select("location.path", "matcher", "location.line", F.when(F.col("trivial"), "call:prepare").otherwise(F.array_join("events", ",")).alias("events"), "trivial")


@query("select doc_id, case when mean > 200 then 'minified' end excluded from (select doc_id, sum(strlen(l))::double / count(*) mean from (select doc_id, unnest(string_split(text, chr(10))) l from documents) where trim(l) <> '' group by 1)")
def generated_sources(spark, sf_dir):
    """Long lines without registrations mark generated text. Texts here are below 64 KiB or all of one shape."""
    return read(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", files.exclusion(F.encode("text", "UTF-8")).alias("excluded"))


@query("select doc_id, source || '/' || lang || '.txt' path from documents where regexp_matches(source || '/' || lang || '.txt', '^src1.*/(en|de)[.]txt$') and not starts_with(source, 'src13')")
def glob_selection(spark, sf_dir):
    """Include and exclude globs."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("", "source", F.lit("/"), "lang", F.lit(".txt")).alias("path"))
    return d.where(F.col("path").rlike(modes.glob_regex("src1*/{en,de}.txt")) & ~F.col("path").rlike(modes.glob_regex("src13*/")))


SUPPRESSIONS = [{"rule": "duplicate-matcher", "reason": "known", "path": "src/Brand#1*.ts"}, {"rule": "duplicate-matcher", "reason": "named", "matcher": "red plate"}, {"rule": "duplicate-matcher", "reason": "nothing", "path": "lib/"}]


@query(f"""select a, b, case when bool_and(regexp_matches(path, '^src/Brand#1.*[.]ts$')) then 'known' when bool_or(matcher = 'red plate') then 'named' end reason from
(select a, b, unnest([a, b]) def_id from (select lag(def_id) over (partition by normalized, matcher order by def_id) a, def_id b from {PARTS}) where a is not null) join {PARTS} using (def_id) group by 1, 2""")
def suppressed_pairs(spark, sf_dir):
    """configured suppressions of duplicate pairs."""
    d = part_definitions(spark, sf_dir)
    raw = d.withColumn("m", F.col("matcher")).select("def_id", "normalized_matcher", "m", F.col("location.path").alias("path"))
    pairs = candidates.normalized_candidates(d).select("a", "b").join(raw.select(F.col("def_id").alias("a"), F.col("m").alias("ma"), F.col("path").alias("pa")), "a").join(raw.select(F.col("def_id").alias("b"), F.col("m").alias("mb"), F.col("path").alias("pb")), "b").where("ma = mb")
    reason = modes.suppression_reason(F.lit("duplicate-matcher"), F.array("pa", "pb"), F.array("ma", "mb"), F.array().cast("array<struct<rule:string,reason:string>>"), SUPPRESSIONS)
    chain = pairs.groupBy("b").agg(F.max(F.struct("a", "ma", "mb", "pa", "pb")).alias("x")).select("b", "x.*")
    return chain.select("a", "b", reason.alias("reason"))


_FIND = "(select row_number() over (order by doc_id) - 1 seq, sha256(text) fingerprint, source from documents)"


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as findings, numbered by id, with their text's digest as fingerprint."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("fingerprint"), "source", F.lit("duplicate-matcher").alias("rule"), F.when(F.col("lang") == "en", "error").otherwise("warning").alias("severity"), F.array("doc_id").alias("members"), F.lit(None).cast("string").alias("reason"))
    return d


@query("""with b as (select sha256(text) f, count(*) n from documents where source < 'src2' group by 1),
c as (select doc_id, sha256(text) f, row_number() over (partition by sha256(text) order by doc_id) k from documents where source >= 'src2')
select doc_id seq, coalesce(k <= n, false) suppressed from c left join b using (f)""")
def baseline_suppression(spark, sf_dir):
    """Multiplicity is used up in finding order."""
    f = document_findings(spark, sf_dir)
    base = modes.baseline_counts(f.where("source < 'src2'"))
    return modes.apply_baseline(f.where("source >= 'src2'"), base, "old").select("seq", F.col("reason").isNotNull().alias("suppressed"))


@query("""with p as (select sha256(text) f, count(*) n from documents where source < 'src2' group by 1), c as (select sha256(text) f, count(*) n from documents where source >= 'src2' group by 1)
select coalesce(sum(greatest(coalesce(c.n, 0) - coalesce(p.n, 0), 0)), 0)::bigint added, coalesce(sum(greatest(coalesce(p.n, 0) - coalesce(c.n, 0), 0)), 0)::bigint removed from p full join c using (f)""")
def baseline_difference(spark, sf_dir):
    """J12."""
    f = document_findings(spark, sf_dir)
    return modes.baseline_change(modes.baseline_counts(f.where("source < 'src2'")), modes.baseline_counts(f.where("source >= 'src2'")))


@query("select doc_id from documents where source in ('src3', 'src7')")
def changed_findings(spark, sf_dir):
    """findings in changed files."""
    f = document_findings(spark, sf_dir)
    d = f.select(F.col("seq").alias("def_id"), F.struct(F.col("source").alias("path")).alias("location"))
    return modes.retain_changed(f, d, spark.createDataFrame([("src3",), ("src7",), ("src3",)], "path string")).select(F.col("seq").alias("doc_id"))


@query("select doc_id from documents where source not in (select source from documents join labels using (doc_id) where toxic = 1 and quality = 1)")
def without_uncertain_sources(spark, sf_dir):
    """nothing is said about files that are uncertain."""
    d = read(spark, sf_dir, "documents")
    bad = d.join(read(spark, sf_dir, "labels").where("toxic = 1 and quality = 1"), "doc_id").select(F.col("source").alias("path"))
    return modes.without_uncertain(d.select("doc_id", F.struct(F.col("source").alias("path")).alias("location")), bad).select("doc_id")


@query("""select 10.0::double threshold, count(*) filter (dup and lang = 'en') duplicated, count(*) total, count(*) filter (dup and lang = 'en') / count(*) * 100 percentage, count(*) filter (dup and lang = 'en') / count(*) * 100 <= 10 passed
from (select lang, count(*) over (partition by text) > 1 dup from documents)""")
def duplication_share(spark, sf_dir):
    """A7."""
    f = document_findings(spark, sf_dir)
    twice = f.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    return modes.duplication_threshold(f.join(twice, "fingerprint", "left_semi"), f.select(F.col("seq").alias("def_id")), 10.0)


@query("select count(*) filter (lang = 'en') errors, count(*) filter (lang <> 'en') warnings, 0::bigint suppressed, 'duplicate-matcher=' || count(*) by_rule from documents")
def finding_summary(spark, sf_dir):
    """A8."""
    listed = F.array_join(F.transform(F.map_entries("by_rule"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return modes.summary(document_findings(spark, sf_dir)).withColumn("by_rule", listed)


@query("select doc_id seq from documents order by case lang when 'en' then 0 else 1 end, doc_id limit 500")
def report_selection(spark, sf_dir):
    """What a bounded report shows; the limit is the feature."""
    from stepweave.operators.report import top
    from stepweave.report_queries import document_result

    r = document_result(spark, sf_dir)
    shown = top(r.findings.withColumn("reason", F.lit(None).cast("string")), r.definitions, most=500)
    return spark.createDataFrame([(f["seq"],) for f in shown], "seq bigint")


@query(f"""with d as (select * from {PARTS}), {_spanning_sql('d', 'normalized', 'matcher')},
n as (select a, b from (select lag(def_id) over (partition by normalized, matcher order by def_id) a, def_id b from d) where a is not null
 union select least(x, y), greatest(x, y) from (select case when matcher = p1 then h2 else h1 end x, def_id y from d join e on normalized = g where matcher <> p1 or def_id <> h1)),
s as (select l.def_id a, r.def_id b from d l join d r on l.structural = r.structural and l.def_id < r.def_id and l.alpha <> r.alpha and l.normalized <> r.normalized)
select owner, count(*) evaluated, 0::bigint skipped from (select 'normalized' owner, * from n union all select 'structural', * from (select * from s except select * from n)) group by 1""")
def candidate_census(spark, sf_dir):
    """Pairs by the source that owns them."""
    _, census = candidates.candidates(part_definitions(spark, sf_dir), Config(), ("normalized", "structural"))
    return census


@query(f"""with d as (select * from {PARTS}), {_spanning_sql('d', 'normalized', 'matcher')},
h2 as (select g, p, head, row_number() over (partition by g order by head) rk from (select alpha g, normalized p, min(def_id) head from d group by 1, 2)),
e2 as (select g, min(head) filter (rk = 1) h1, min(head) filter (rk = 2) h2, min(p) filter (rk = 1) p1 from h2 group by g having count(*) > 1),
n as (select a, b from (select lag(def_id) over (partition by normalized, matcher order by def_id) a, def_id b from d) where a is not null
 union select least(x, y), greatest(x, y) from (select case when matcher = p1 then h2 else h1 end x, def_id y from d join e on normalized = g where matcher <> p1 or def_id <> h1)),
i as (select distinct least(x, y) a, greatest(x, y) b from (select case when normalized = p1 then h2 else h1 end x, def_id y from d join e2 on alpha = g where normalized <> p1 or def_id <> h1)),
s as (select l.def_id a, r.def_id b from d l join d r on l.structural = r.structural and l.def_id < r.def_id and l.alpha <> r.alpha and l.normalized <> r.normalized),
u as (select a, b, string_agg(src, ',' order by src) sources, case min(k) when 0 then 'normalized' when 1 then 'identical' else 'structural' end owner from (select a, b, 'normalized' src, 0 k from n union all select a, b, 'identical', 1 from i union all select a, b, 'structural', 2 from s) group by 1, 2),
v as (select u.*, l.matcher = r.matcher exact_matcher, l.normalized = r.normalized eq_norm, l.alpha = r.alpha same_handler, l.structural = r.structural same_structure, l.normalized ls, r.normalized rs, string_split(l.normalized, ' ') l, string_split(r.normalized, ' ') r,
  ((l.p_type = r.p_type)::int + (l.p_size = r.p_size)::int) / 2.0 common, contains(sources, 'normalized') and l.normalized = r.normalized by_matcher, contains(sources, 'identical') and l.normalized <> r.normalized and l.alpha = r.alpha by_handler,
  contains(sources, 'structural') and l.normalized <> r.normalized and l.alpha <> r.alpha and l.structural = r.structural structural from u join d l on l.def_id = a join d r on r.def_id = b),
w as (select *, (contains(sources, 'identical') or contains(sources, 'structural')) and not structural and not eq_norm near,
  (select coalesce(min(i) - 1, least(len(l), len(r))) from range(1, least(len(l), len(r)) + 1) t(i) where l[i] <> r[i]) p from v),
x as (select *, case when eq_norm then 1.0 when by_handler or structural or near then greatest({_EDIT}, jaro_winkler_similarity(ls, rs)) else 0.0 end score,
  (select coalesce(min(i) - 1, least(len(l), len(r)) - p) from range(1, least(len(l), len(r)) - p + 1) t(i) where l[len(l) - i + 1] <> r[len(r) - i + 1]) sfx from w),
y as (select *, structural and score >= 0.6 and greatest(len(l), len(r)) - p - sfx <= 3 parameter, near and score >= case when greatest(length(ls), length(rs)) <= 12 then 0.92 else 0.90 end close from x),
z as (select *, case when by_matcher or by_handler or parameter or (close and not parameter) then case when same_handler and same_structure then 1.0 when same_structure then 0.95 else common end else 0.0 end handler from y)
select a, b, sources, owner, exact_matcher, eq_norm, same_handler, same_structure, floor(score * 1000 + 0.5) / 1000 score, floor(handler * 1000 + 0.5) / 1000 handler_score,
  concat_ws(',', case when by_matcher and exact_matcher then 'duplicate-matcher' end, case when by_matcher and not exact_matcher then 'normalized-matcher' end, case when by_handler then 'duplicate-handler' end,
  case when parameter then 'parameterization-candidate' end, case when close and not parameter and handler >= {Config().near_duplicate_handler_similarity} then 'near-duplicate-step' end) rules from z""")
def pair_verification(spark, sf_dir):
    """V1, K8: the decision table over all candidate pairs of parts of the exact and structural sources."""
    d = durable(part_definitions(spark, sf_dir))
    found, _ = verify.checked(d, Config(), ("normalized", "identical", "structural"))
    return found.records().select("a", "b", F.array_join("sources", ",").alias("sources"), "owner", "exact_matcher", "eq_norm", "same_handler", "same_structure", "score", "handler_score", F.array_join("rules", ",").alias("rules"))


def supplier_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    place = F.struct(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".ts")).alias("path"), F.col("s_suppkey").cast("int").alias("line"), F.lit(1).alias("column"), F.col("s_suppkey").cast("int").alias("end_line"), F.lit(9).alias("end_column"))
    matcher = F.concat(F.lit("supplier of nation "), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, " delivers").otherwise(" ships"))
    return s.select(F.col("s_suppkey").cast("bigint").alias("def_id"), matcher.alias("matcher"), F.lit("cucumber-expression").alias("matcher_kind"), F.lit("").alias("matcher_flags"), matcher.alias("normalized_matcher"), F.lit("").alias("h_exact"), F.lit("").alias("h_normalized"), F.concat(F.lit("a"), (F.col("s_suppkey") % 10).cast("string")).alias("h_alpha"), F.concat(F.lit("s"), (F.col("s_suppkey") % 5).cast("string")).alias("h_structural"), F.array(F.lit("call:ship")).alias("events"), F.lit("").alias("snippet"), F.lit(True).alias("comparable"), F.lit(False).alias("trivial"), F.lit("complete").alias("effect_stream"), F.lit(None).cast("string").alias("capture_scope"), F.lit("cucumber").alias("framework"), F.lit("Given").alias("registration"), place.alias("location"), F.array().cast("array<struct<rule:string,reason:string>>").alias("inline_suppressions"))


@query()
def full_analysis(spark, sf_dir):
    """All rules at once: suppliers as definitions, customers' nations as steps."""
    from stepweave.plans.analyze import analyze

    c = read(spark, sf_dir, "customer")
    place = F.struct(F.lit("a.feature").alias("path"), F.col("c_custkey").cast("int").alias("line"), F.lit(1).alias("column"), F.col("c_custkey").cast("int").alias("end_line"), F.lit(9).alias("end_column"))
    steps = c.select(F.col("c_custkey").cast("bigint").alias("step_seq"), F.lit("Given").alias("keyword"), F.concat(F.lit("supplier of nation "), F.col("c_nationkey").cast("string"), F.lit(" ships")).alias("text"), place.alias("location"))
    return analyze(supplier_definitions(spark, sf_dir), steps).findings


@query("select p_partkey, 'src/' || p_brand || '.ts:' || p_partkey || ':1' as place, case when length(p_name) > 9 then substr(p_name, 1, 9) || '…' else p_name end snippet, p_name cleaned from part")
def display_text(spark, sf_dir):
    """P26, P28, K12."""
    d = part_definitions(spark, sf_dir)
    return d.select(F.col("def_id").alias("p_partkey"), keys.display(F.col("location")).alias("place"), keys.bounded_snippet(F.col("normalized_matcher"), 9).alias("snippet"), keys.sanitized(F.concat(F.lit("‮"), "normalized_matcher", F.lit("​"))).alias("cleaned"))


@query(f"""select ls, rs, substr(ls, 1, p) || '|' || substr(ls, p + 1, length(ls) - p - s) || '|' || substr(rs, p + 1, length(rs) - p - s) || '|' || right(ls, s) diff from (
 select *, (select coalesce(min(i) - 1, least(length(ls) - p, length(rs) - p)) from range(1, least(length(ls) - p, length(rs) - p) + 1) t(i) where substr(ls, length(ls) - i + 1, 1) <> substr(rs, length(rs) - i + 1, 1)) s from (
 select *, (select coalesce(min(i) - 1, least(length(ls), length(rs))) from range(1, least(length(ls), length(rs)) + 1) t(i) where substr(ls, i, 1) <> substr(rs, i, 1)) p from {_PAIRS}))""")
def matcher_differences(spark, sf_dir):
    """P15."""
    d = keys.matcher_diff(F.col("ls"), F.col("rs"))
    return name_pairs(spark, sf_dir).select("ls", "rs", d.alias("d")).select("ls", "rs", F.concat_ws("|", "d.prefix", "d.left", "d.right", "d.suffix").alias("diff"))


@query("select text, min(doc_id) first_seq, count(*) n from documents group by 1")
def distinct_texts(spark, sf_dir):
    """A14."""
    return usage.distinct_texts(read(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("step_seq")))


def entry(spark: SparkSession) -> DataFrame:
    return duplicate_matcher_groups(spark, "/root/testdata/sf0.001")


from stepweave import report_queries  # noqa: E402, F401  (registers its own)
