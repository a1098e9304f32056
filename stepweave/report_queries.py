"""Queries over reports, keys and modes, with SQL; registered with those of ``stepweave.queries``."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from stepweave.functions import keys
from stepweave.model import MESSAGES, Config
from stepweave.operators import candidates, modes, report, usage, verify
from stepweave.plans.analyze import Result, sequenced
from stepweave.plans.durable import durable
from stepweave.queries import _RX, _STEP, PARTS, document_findings, event_steps, part_definitions, query, read, step_definitions
from stepweave.sources import gherkin

_MESSAGE, _ACTION = MESSAGES["duplicate-matcher"]


def document_result(spark: SparkSession, sf_dir: str) -> Result:
    """Documents as an analysis result: each is a definition in its source's file, at its id's line, and a finding."""
    found = document_findings(spark, sf_dir).drop("source").withColumns({"score": F.lit(1.0), "handler_score": F.lit(None).cast("double"), "message": F.lit(_MESSAGE), "action": F.lit(_ACTION)})
    found = found.withColumn("reason", F.when(F.col("seq") % 10 == 0, "known"))
    line = F.col("doc_id").cast("int")
    place = F.struct(F.concat("source", F.lit("/a b.ts")).alias("path"), line.alias("line"), F.lit(1).alias("column"), line.alias("end_line"), F.lit(9).alias("end_column"))
    definitions = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("def_id"), place.alias("location"), F.col("lang").alias("matcher"))
    census = spark.createDataFrame([("normalized", 1, 0)], "owner string, evaluated bigint, skipped bigint")
    return Result(definitions, found, census, found.limit(0), [])


@query(f"""select doc_id seq, '{{"type":"finding","rule":"duplicate-matcher","severity":"' || case lang when 'en' then 'error' else 'warning' end || '","members":[' || doc_id || '],"score":1.0,"fingerprint":"' || sha256(text)
  || '","message":"{_MESSAGE}","action":"{_ACTION}"' || case when doc_id % 10 = 0 then ',"reason":"known"' else '' end || ',"truncatedFields":[]}}' line from documents
union all select 4611686018427387904, '{{"type":"summary","errors":' || count(*) filter (lang = 'en' and doc_id % 10 <> 0) || ',"warnings":' || count(*) filter (lang <> 'en' and doc_id % 10 <> 0) || ',"suppressed":' || count(*) filter (doc_id % 10 = 0)
  || ',"by_rule":{{"duplicate-matcher":' || count(*) filter (doc_id % 10 <> 0) || '}}}}' from documents""")
def json_lines(spark, sf_dir):
    """A JSON line a finding, then the summary."""
    return report.jsonl_rows(document_result(spark, sf_dir))


@query("select 'duplicate-matcher' rule_id, case lang when 'en' then 'error' else 'warning' end as level, source || '/a%20b.ts' uri, doc_id::bigint start_line, sha256(text) fingerprint from documents where doc_id % 10 <> 0 order by lang <> 'en', doc_id limit 10000")
def sarif_results(spark, sf_dir):
    """The results of a SARIF log, active findings only; its bound is the feature."""
    rows = [(r["ruleId"], r["level"], (at := r["locations"][0]["physicalLocation"])["artifactLocation"]["uri"], at["region"]["startLine"], r["partialFingerprints"]["stepweave/v1"]) for r in report.sarif(document_result(spark, sf_dir))["runs"][0]["results"]]
    return spark.createDataFrame(rows, "rule_id string, level string, uri string, start_line bigint, fingerprint string")


@query(f"""with t as (select * from documents where doc_id % 10 <> 0 order by lang <> 'en', doc_id limit 10000)
select '  ' || case lang when 'en' then 'error' else 'warning' end || ' ' || source || '/a b.ts:' || doc_id || ':1 {_MESSAGE}' line from t union all select 'duplicate-matcher (' || count(*) || ')' from t having count(*) > 0""")
def text_lines(spark, sf_dir):
    """The lines of the terminal report."""
    return spark.createDataFrame([(x,) for x in report.text_report(document_result(spark, sf_dir))], "line string")


@query("""with t as (select * from documents order by case when doc_id % 10 <> 0 then case lang when 'en' then 0 else 1 end else case lang when 'en' then 2 else 3 end end, doc_id limit 10000)
select count(*)::bigint n_rows, count(*) filter (lang = 'en')::bigint errors, count(*) filter (doc_id % 10 = 0)::bigint suppressed from t""")
def html_rows(spark, sf_dir):
    """K6: what the HTML page lists."""
    page = report.html_report(document_result(spark, sf_dir))
    return spark.createDataFrame([(page.count("<tr class="), page.count("<tr class='error'"), page.count("<td>known</td>"))], "n_rows bigint, errors bigint, suppressed bigint")


@query("""with t as (select doc_id from documents order by case when doc_id % 10 <> 0 then case lang when 'en' then 0 else 1 end else case lang when 'en' then 2 else 3 end end, doc_id limit 10000)
select (select count(*) from t)::bigint listed, ((select count(*) from documents) - (select count(*) from t))::bigint truncated, (select count(*) from documents where lang = 'en' and doc_id % 10 <> 0)::bigint errors, (select sum(doc_id) from t)::bigint lines""")
def json_summary(spark, sf_dir):
    """The JSON report's counts and the places that it lists."""
    r = report.json_report(document_result(spark, sf_dir))
    return spark.createDataFrame([(len(r["findings"]), r["findingsTruncated"], r["summary"]["errors"], sum(f["primary"]["line"] for f in r["findings"]))], "listed bigint, truncated bigint, errors bigint, lines bigint")


_PART = "(unhex(lpad(format('{{:X}}', strlen({0})), 16, '0')) || encode({0}))"
_DIGEST = "substr(sha256('stepweave:fingerprint:1:single'::blob || '\\x00'::blob || encode({0})), 1, 32)"


@query(f"""select def_id, path || ':' || def_id || ':1' as at, {_DIGEST.format('normalized')} normalized_matcher, {_DIGEST.format('alpha')} h_alpha,
  substr(sha256('stepweave:fingerprint:1:parts'::blob || '\\x00'::blob || {_PART.format("'definition'")} || {_PART.format("'cucumber-expression'")} || {_PART.format('normalized')} || unhex('0000000000000000') || {_PART.format('alpha')}), 1, 32) fingerprint from {PARTS}""")
def definition_fingerprints(spark, sf_dir):
    """Digests of all that is compared."""
    return report.fingerprint_rows(part_definitions(spark, sf_dir)).select("def_id", "at", "normalized_matcher", "h_alpha", "fingerprint")


@query("""select p_partkey, case p_size % 3 when 0 then 'im' when 1 then '' else 's' end flags, case p_size % 3 when 0 then '[regex-flags:im] ' when 1 then '' else '[regex-flags:s] ' end || '^(' || p_name || ') [\\s]+$' normalized from part""")
def regular_expression_keys(spark, sf_dir):
    """Capture names, white space and order of flags don't tell expressions apart."""
    flags = F.when(F.col("p_size") % 3 == 0, "gmi").when(F.col("p_size") % 3 == 1, "").otherwise("ssg")
    source = F.concat(F.lit("^(?<who>"), F.replace("p_name", F.lit(" "), F.lit("\\s+")), F.lit(")\\ [\\s]+$"))
    return read(spark, sf_dir, "part").select("p_partkey", keys.effective_flags(flags).alias("flags"), keys.normalized_matcher(F.lit("regular-expression"), source, flags).alias("normalized"))


@query("select event_id, event_id % 4 in (0, 1) stub from events")
def stub_labels(spark, sf_dir):
    """Names that say that nothing is done yet."""
    label = F.when(F.col("event_id") % 4 == 0, "Not-Implemented!").when(F.col("event_id") % 4 == 1, "TODO:").when(F.col("event_id") % 4 == 2, F.concat(F.lit("pending "), "event_type")).otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", keys.is_stub_label(label).alias("stub"))


@query("select doc_id seq, complete from documents, (values (true), (false)) t(complete) where complete or lang <> 'en'")
def findings_by_completeness(spark, sf_dir):
    """unused definitions are claimed only where all features were read."""
    f = document_findings(spark, sf_dir).withColumn("rule", F.when(F.col("severity") == "error", "unused-definition").otherwise("duplicate-matcher"))
    return modes.without_unused(f, True).select("seq", F.lit(True).alias("complete")).unionByName(modes.without_unused(f, False).select("seq", F.lit(False).alias("complete")))


@query("select entry::bigint entry from (values (0, '^src/Brand#1.*[.]ts$', null), (1, '^lib/.*$', null), (2, null, 'no such name'), (3, '^src/.*$', 'red plate')) s(entry, rx, name) where not exists (select 1 from " + PARTS + " where (rx is null or regexp_matches(path, rx)) and (name is null or matcher = name))")
def unmatched_suppressions(spark, sf_dir):
    """F16: configured suppressions that select no definition."""
    entries = [{"path": "src/Brand#1*.ts"}, {"path": "lib/"}, {"matcher": "no such name"}, {"path": "src/", "matcher": "red plate"}]
    found = modes.unmatched_suppressions(part_definitions(spark, sf_dir), entries)
    return spark.createDataFrame([(k,) for k in found], "entry bigint")


@query("""with t as (select count(*) filter (dup and lang = 'en') / count(*) * 100 > 0 fails from (select lang, count(*) over (partition by text) > 1 dup from documents))
select 'as it is' config, fails::int::bigint code from t union all select 'high threshold', 0 union all select 'no steps', 2 union all select 'incomplete', 2 union all select 'unparseable', 2 union all select 'an error of another rule', 1""")
def exit_codes(spark, sf_dir):
    """What a run's outcome is, by configuration."""
    f = durable(document_findings(spark, sf_dir))
    twice = f.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    hit, d = durable(f.join(twice, "fingerprint", "left_semi")), f.select(F.col("seq").alias("def_id"))
    code = lambda c, rows=hit, incomplete=False, steps=1, said=0: modes.exit_code(modes.duplication_threshold(rows, d, c.threshold), rows, c, incomplete, 1, steps, said)
    high = Config(threshold=100.0)
    rows = [("as it is", code(Config())), ("high threshold", code(high)), ("no steps", code(Config(require_features=True), steps=0)), ("incomplete", code(Config(fail_on_incomplete=True), incomplete=True)), ("unparseable", code(Config(fail_on_unparseable=True), said=1)), ("an error of another rule", code(high, hit.withColumn("rule", F.lit("ambiguous-step")).withColumn("severity", F.lit("error"))))]
    return spark.createDataFrame(rows, "config string, code bigint")


@query("select row_number() over (order by source, doc_id) - 1 seq, doc_id from documents")
def finding_order(spark, sf_dir):
    """Findings numbered by place, without sorting in one task."""
    return sequenced(read(spark, sf_dir, "documents").select(F.struct("source", "doc_id").alias("seq_key"), "doc_id")).select("seq", "doc_id")


@query(f"""with m as (select text, count(*) n from (select distinct text, def_id from {_STEP} s, {_RX} where regexp_matches(text, rx)) group by 1 having count(*) > 1)
select event_id first_seq, 'Step `' || text || '` is accepted by ' || case when event_id % 2 = 0 then 'at least ' else '' end || n || ' definitions' as message from {_STEP} join m using (text)""")
def ambiguity_messages(spark, sf_dir):
    """A3: of steps, with members known in whole or in part."""
    steps = event_steps(spark, sf_dir)
    found = usage.ambiguities(steps, usage.text_matches(usage.distinct_texts(steps), step_definitions(spark)).distinct())
    return found.select("first_seq", usage.ambiguity_message(partial=F.col("first_seq") % 2 == 0).alias("message"))


@query(f"select distinct def_id::bigint def_id from {_RX} where exists (select 1 from {_STEP} s where regexp_matches(text, rx)) or regexp_matches('user 7 walks slowly', rx) union select 6")
def indirectly_used(spark, sf_dir):
    """Definitions that steps reach, or texts that code calls; nothing can be proven of the last one, so it counts."""
    steps, prepared = event_steps(spark, sf_dir), step_definitions(spark)
    indirect = spark.createDataFrame([("user 7 walks slowly",), ("nobody",)], "text string")
    return usage.used(prepared, usage.text_matches(usage.distinct_texts(steps), prepared), indirect)


@query("""with c as (select distinct 't' || s_nationkey as name, 'conf' expression from supplier), d as (select 't' || s_nationkey as name, case when s_suppkey % 7 <> 0 then 'own' || s_suppkey end expression from supplier where s_suppkey % 3 = 0),
g as (select name, count(*) n, max(expression) expression from d group by 1)
select name, expression from c where name not in (select name from g) union all select name, expression from g where n = 1 and expression is not null""")
def parameter_type_registry(spark, sf_dir):
    """Declarations over configuration; what is declared twice or without expression is unknown."""
    s = read(spark, sf_dir, "supplier")
    name = F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("name")
    declared = s.where("s_suppkey % 3 = 0").select(name, F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("own"), F.col("s_suppkey").cast("string"))).alias("expression"))
    return usage.parameter_types(declared, s.select(name, F.lit("conf").alias("expression")).distinct())


@query("select max(f) fits, count(*)::bigint n_steps from (select (select count(*) from events) <= 250000 f from events)")
def feature_budget(spark, sf_dir):
    """Steps within the budget of a run."""
    steps = event_steps(spark, sf_dir)
    return steps.agg(F.count("*").alias("n_steps")).withColumn("fits", F.lit(gherkin.within_budget(steps)))


@query(f"""select l.def_id a, r.def_id b, l.path || ':' || l.def_id || ':1' a_at, r.path || ':' || r.def_id || ':1' b_at,
  case when l.alpha = r.alpha then 'Their handlers are the same but for local names' when l.structural = r.structural then 'Their handlers have one structure and differ in values'
    when l.p_type = r.p_type or l.p_size = r.p_size then 'Their handlers share 50% of what they do' else 'Their handlers have nothing known in common' end evidence
from (select lag(def_id) over (partition by normalized, matcher order by def_id) a, def_id b from {PARTS}) join {PARTS} l on l.def_id = a join {PARTS} r on r.def_id = b""")
def located_pairs(spark, sf_dir):
    """Pairs of equal matchers with both places and what their handlers have in common."""
    d = durable(part_definitions(spark, sf_dir))
    chains = candidates.normalized_candidates(d).join(d.select(F.col("def_id").alias("a"), F.col("matcher").alias("ma")), "a").join(d.select(F.col("def_id").alias("b"), F.col("matcher").alias("mb")), "b").where("ma = mb")
    last = chains.groupBy("b").agg(F.max("a").alias("a"))
    pairs = last.select("a", "b", F.array(F.lit("normalized")).alias("sources"), F.lit("normalized").alias("owner"))
    records = verify.pair_records(verify.verified(verify.pair_relations(pairs, d), Config()))
    return verify.located_pairs(records, d).select("a", "b", "a_at", "b_at", "evidence")


@query("select doc_id, strlen(text) > 200 shorter from documents")
def long_texts(spark, sf_dir):
    """Which texts are shown in part only; the cuts themselves are tested against Python."""
    return read(spark, sf_dir, "documents").select("doc_id", (keys.sampled(F.col("text"), 200) != F.col("text")).alias("shorter"))


_TONGUES = sorted(gherkin.DIALECTS)
_STEPS = [next(k for k in gherkin.DIALECTS[d][6] if k != "*") for d in _TONGUES]


@query(f"""with t as (select *, row_number() over (order by n_nationkey) - 1 k from nation), w as (select [{', '.join(f"'{x}'" for x in _STEPS)}] words)
select 'features/' || n_name || '.feature' path, words[k % {len(_TONGUES)} + 1] keyword, 'n' || n_nationkey || ' ' || v as text from t, w, (values ('one'), ('two')) x(v)""")
def localized_steps(spark, sf_dir):
    """An outline a nation, each in the next dialect."""
    rows = read(spark, sf_dir, "nation").select("n_name", "n_nationkey", F.rank().over(Window.orderBy("n_nationkey")).alias("k"))  # a fixed table of 25
    words = [F.array(*[F.lit(next(k for k in gherkin.DIALECTS[d][which] if k != "*")) for d in _TONGUES]) for which in (0, 4, 5, 6)]
    feature, outline, examples, step = (F.element_at(w, ((F.col("k") - 1) % len(_TONGUES) + 1).cast("int")) for w in words)
    tongue = F.element_at(F.array(*map(F.lit, _TONGUES)), ((F.col("k") - 1) % len(_TONGUES) + 1).cast("int"))
    text = F.concat(F.lit("# language: "), tongue, F.lit("\n"), feature, F.lit(": f\n  "), outline, F.lit(": o\n    "), step, F.lit(" n"), F.col("n_nationkey").cast("string"), F.lit(" <v>\n    "), examples, F.lit(":\n      | v |\n      | one |\n      | two |\n"))
    steps, errors = gherkin.feature_steps(rows.select(F.concat(F.lit("features/"), "n_name", F.lit(".feature")).alias("path"), text.alias("content")))
    return steps.select("location.path", "keyword", "text")
