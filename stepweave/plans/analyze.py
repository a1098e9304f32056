"""The whole analysis: two tables in, one findings table out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions import keys, matchers
from stepweave.model import CLUSTER_RULES, MESSAGES, RULE_RANK, Config
from stepweave.operators import candidates, forest, modes, usage, verify
from stepweave.plans.durable import durable

#: Findings of one content that a task numbers at once.
COPIES = 1000
RAW = ["rule", "severity", "members", "score", "handler_score", "text", "reason"]


class IncompleteError(RuntimeError):
    """The findings are valid, but the absence of others proves nothing."""


@dataclass
class Result:
    definitions: DataFrame
    findings: DataFrame
    census: DataFrame
    pairs: DataFrame
    incomplete: list[str] = field(default_factory=list)


def single_domain(definitions: DataFrame) -> None:
    """One comparison domain per run."""
    if definitions.select("domain").distinct().limit(2).count() > 1:
        raise ValueError("definitions of several comparison domains can't be analysed together")


def numbered(definitions: DataFrame) -> DataFrame:
    """Assign def_id in location order to definitions that lack it: a range sort, then ranks within sorted partitions."""
    spark = definitions.sparkSession
    sort = durable(definitions.drop("def_id").repartitionByRange("location").sortWithinPartitions("location").withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["count"] for r in sort.groupBy("_p").count().collect()}
    base, total = [], 0
    for p in sorted(sizes):
        base.append((p, total))
        total += sizes[p]
    offsets = spark.createDataFrame(base or [(0, 0)], "_p int, _o bigint")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("location")) - 1
    return sort.withColumn("_r", rank).join(offsets, "_p").withColumn("def_id", F.col("_o") + F.col("_r")).drop("_p", "_o", "_r")


def _described(raw: DataFrame, d: DataFrame, config: Config) -> DataFrame:
    """Add what suppression and fingerprints need of each member, in member order."""
    member = F.struct("k", "path", "matcher", "inline", "fp").alias("m")
    facts = d.select("def_id", F.col("location.path").alias("path"), "matcher", F.coalesce("inline_suppressions", F.array().cast("array<struct<rule:string,reason:string>>")).alias("inline"), keys.definition_fingerprint(F.col("matcher_kind"), F.col("normalized_matcher"), F.col("matcher_flags"), F.col("h_alpha")).alias("fp"))
    exploded = raw.select("fid", F.posexplode("members").alias("k", "def_id")).join(facts, "def_id")
    gathered = exploded.groupBy("fid").agg(F.array_sort(F.collect_list(member)).alias("ms"))
    return raw.join(gathered, "fid")


def _reason(config: Config) -> Column:
    pick = lambda name: F.transform("ms", lambda m: m[name])
    return modes.suppression_reason(F.col("rule"), pick("path"), pick("matcher"), F.flatten(pick("inline")), config.suppressions)


def pair_findings(edges: DataFrame, d: DataFrame, config: Config) -> DataFrame:
    """Findings of the five pair rules: suppressed or not, reduced to spanning forests, exact ones clustered."""
    edges = edges.withColumn("fid", F.concat_ws("|", "rule", "a", "b")).withColumn("members", F.array("a", "b"))
    if config.suppressions or not d.where(F.size("inline_suppressions") > 0).isEmpty():
        known = _described(edges, d, config).withColumn("reason", _reason(config))
    else:
        known = edges.withColumn("reason", F.lit(None).cast("string"))
    known = known.withColumn("suppressed", F.col("reason").isNotNull())
    slim = durable(known.select("rule", "suppressed", "reason", "a", "b", "score", "handler_score"))
    tree = durable(forest.spanning_forest(slim, ["rule", "suppressed"]))
    exact = tree.where(modes.supports_cluster(F.col("rule")))
    grouped = exact.withColumn("why", F.coalesce("reason", F.lit("")))
    found = forest.clusters(grouped, ["rule", "suppressed", "why"])
    inside = found.select("rule", "suppressed", "why", F.explode("members").alias("a"))
    single = tree.withColumn("why", F.coalesce("reason", F.lit(""))).join(inside, ["rule", "suppressed", "why", "a"], "left_anti")
    collapsed = found.select("rule", "members", F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("handler_score"), F.when(F.col("suppressed"), F.col("why")).alias("reason"))
    pairs = single.select("rule", F.array("a", "b").alias("members"), "score", "handler_score", "reason")
    return collapsed.unionByName(pairs).withColumn("text", F.lit(None).cast("string"))


def usage_findings(steps: DataFrame, prepared: DataFrame, config: Config, indirect: DataFrame | None) -> DataFrame:
    """Findings of the three usage rules, without suppression reasons yet; those that are equal once, with how many there are.

    Steps of one text are ambiguous alike, each a finding with all members, so their members are written out last.
    """
    spark = steps.sparkSession
    matches = durable(usage.text_matches(usage.distinct_texts(steps), prepared).distinct())
    sets = durable(usage.ambiguous_sets(matches))
    once = F.lit(1).cast("bigint").alias("copies")
    empty = spark.createDataFrame([], "rule string, members array<bigint>, score double, text string, copies bigint")
    out = empty
    if config.active("ambiguous-step"):
        alike = usage.ambiguous_places(steps, sets).groupBy("key", "expansions", "text").agg(F.count("*").alias("copies"))
        groups = alike.join(usage.members_by_key(sets).hint("merge"), "key")
        out = out.unionByName(groups.select(F.lit("ambiguous-step").alias("rule"), "members", F.lit(None).cast("double").alias("score"), usage.ambiguity_message().alias("text"), "copies"))
    if config.active("overlapping-matcher"):
        pairs = usage.overlaps(prepared, sets)
        out = out.unionByName(pairs.select(F.lit("overlapping-matcher").alias("rule"), F.array("a", "b").alias("members"), F.lit(None).cast("double").alias("score"), F.col("witness").alias("text"), once))
    if config.active("unused-definition"):
        gone = usage.unused(prepared, usage.used(prepared, matches, indirect))
        out = out.unionByName(gone.select(F.lit("unused-definition").alias("rule"), F.array("def_id").alias("members"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("text"), once))
    return out


def finding_fingerprint() -> Column:
    """A cluster by its members, a pair by its two sides, others by rule, text and members."""
    fps = F.transform("ms", lambda m: m["fp"])
    clustered = F.col("rule").isin(*CLUSTER_RULES) & (F.size("members") >= forest.MIN_CLUSTER)
    pair = ~F.col("rule").isin("ambiguous-step", "overlapping-matcher", "unused-definition")
    fallback = keys.fingerprint_parts(F.lit("finding-other"), F.col("rule"), F.coalesce("text", F.lit("")), F.array_join(F.array_sort(fps), ","))
    return F.when(clustered, keys.fingerprint_list("finding-cluster", F.col("rule"), fps)).when(pair, keys.fingerprint_list("finding-pair", F.col("rule"), fps)).otherwise(fallback)


def analyze(definitions: DataFrame, steps: DataFrame, config: Config | None = None, indirect: DataFrame | None = None, strict: bool = False) -> Result:
    """Analyse definitions against steps. ``strict`` raises where the result is incomplete.

    ``indirect``: texts (column ``text``) of steps that definitions call from code.
    """
    config = config or Config()
    d = durable(candidates.classified(definitions))
    single_domain(d)
    checked, census = verify.checked(d, config)
    prepared = durable(matchers.with_expressions(d, config.parameter_types))
    found = usage_findings(steps, prepared, config, indirect).withColumn("fid", F.monotonically_increasing_id().cast("string"))
    others = _described(durable(found), d, config)
    other = others.withColumn("reason", _reason(config)).select("rule", "members", "score", F.lit(None).cast("double").alias("handler_score"), "text", "reason", "copies")
    every = durable(pair_findings(checked.edges(), d, config).withColumn("copies", F.lit(1).cast("bigint")).unionByName(other).withColumn("fid", F.monotonically_increasing_id().cast("string")))
    full = _described(every, d, config)
    severity = F.create_map(*[x for k, v in config.rules.items() for x in (F.lit(k), F.lit(v))])[F.col("rule")]
    rank = F.create_map(*[x for k, v in RULE_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("rule")]
    text = lambda k: F.create_map(*[x for r, pair in MESSAGES.items() for x in (F.lit(r), F.lit(pair[k]))])[F.col("rule")]
    message = F.when(F.col("rule") == "ambiguous-step", F.col("text")).when(F.col("rule") == "overlapping-matcher", F.concat(text(0), F.lit(": `"), keys.sampled(F.col("text")), F.lit("`"))).otherwise(text(0))
    # def_ids are in location order, so they order findings as their primary locations do
    order = F.struct(F.get("members", F.lit(0)), rank, "members", F.coalesce("text", F.lit("")))
    listed = full.select(order.alias("seq_key"), "rule", severity.alias("severity"), "members", keys.round_score(F.col("score")).alias("score"), keys.round_score(F.col("handler_score")).alias("handler_score"), finding_fingerprint().alias("fingerprint"), message.alias("message"), text(1).alias("action"), "reason", "copies")
    findings = sequenced(listed)
    skipped = census.agg(F.coalesce(F.sum("skipped"), F.lit(0))).first()[0]
    incomplete = [f"{skipped} candidate pairs were skipped at the limits"] if skipped else []
    if strict and incomplete:
        raise IncompleteError("; ".join(incomplete))
    return Result(definitions, findings, census, checked.records(), incomplete)


def sequenced(findings: DataFrame) -> DataFrame:
    """Number findings in order of primary location, rule and members, without a single-task sort.

    ``copies`` of a finding differ in their numbers alone, so they are written out only where the result is read.
    """
    spark, single = findings.sparkSession, "copies" not in findings.columns
    if single:
        findings = findings.withColumn("copies", F.lit(1).cast("bigint"))
    cut = durable(findings.repartitionByRange("seq_key").sortWithinPartitions("seq_key").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    base, total = [], 0
    for r in sorted(cut.groupBy("_p").agg(F.sum("copies").alias("n")).collect()):
        base.append((r["_p"], total))
        total += r["n"]
    offsets = spark.createDataFrame(base or [(0, 0)], "_p int, _o bigint")
    # in seq_key order, as the rows of a partition are sorted
    before = F.sum("copies").over(Window.partitionBy("_p").orderBy("_i")) - F.col("copies")
    numbers = cut.select("_p", "_i", "copies").withColumn("_r", before).join(F.broadcast(offsets), "_p").select("_i", (F.col("_o") + F.col("_r")).alias("_from"))
    rest = [c for c in findings.columns if c not in ("seq_key", "copies")]
    placed = durable(cut.join(numbers.hint("merge"), "_i").select("_from", "copies", *rest))
    if single:
        return placed.select(F.col("_from").alias("seq"), *rest)
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))).alias("_k")
    parts = placed.select(part, "*").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = F.explode(F.sequence(F.col("_k"), F.least(F.col("copies"), F.col("_k") + COPIES) - 1)).alias("_n")
    return parts.select(each, "*").select((F.col("_from") + F.col("_n")).alias("seq"), *rest)
