"""Feature steps against definitions: matches, ambiguities, overlaps, unused definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.matchers import jvm_expression
from stepweave.model import Config
from stepweave.plans.durable import durable

#: Patterns without a fixed first word are compared with all texts, this many at a time.
LOOSE_BLOCK = 5000


def distinct_texts(steps: DataFrame) -> DataFrame:
    """Text, first_seq, n."""
    return steps.groupBy("text").agg(F.min("step_seq").alias("first_seq"), F.count("*").alias("n"))


def text_matches(texts: DataFrame, prepared: DataFrame) -> DataFrame:
    """(text, def_id, authoritative) for texts accepted by a definition's expression.

    Expressions that begin with a whole fixed word meet only texts that begin with it, an equi-join; the others, e.g. those
    that begin with a parameter, meet all texts in blocks of a checked size.
    """
    own = prepared.where("expression is not null").select("def_id", jvm_expression(F.col("expression")).alias("expression"), "authoritative", F.regexp_extract("expression", r"^\^([A-Za-z0-9]+)(?=\\? |\$$)", 1).alias("head"))
    texts = texts.select("text").distinct().withColumn("head", F.regexp_extract("text", r"^([A-Za-z0-9]+)(?=[ ]|$)", 1))
    fixed = texts.where("head <> ''").join(own.where("head <> ''"), "head").where(F.expr("text rlike expression")).select("text", "def_id", "authoritative")
    loose = own.where("head = ''").drop("head")
    n = loose.count()
    found = fixed
    for k in range(-(-n // LOOSE_BLOCK)):
        block = loose if n <= LOOSE_BLOCK else loose.where(F.pmod(F.xxhash64("def_id"), F.lit(-(-n // LOOSE_BLOCK))) == k)
        found = found.unionByName(texts.join(F.broadcast(block), F.expr("text rlike expression")).select("text", "def_id", "authoritative"))  # a block is bounded
    return found


def ambiguous_sets(matches: DataFrame) -> DataFrame:
    """Texts that two or more authoritative definitions accept: text, members, and a key that equal members share."""
    groups = matches.where("authoritative").groupBy("text").agg(F.array_sort(F.collect_set("def_id")).alias("members")).where(F.size("members") > 1)
    return groups.withColumn("key", F.sha2(F.array_join(F.transform("members", lambda m: m.cast("string")), ","), 256))


def ambiguous_places(steps: DataFrame, sets: DataFrame) -> DataFrame:
    """A2 without the members: one row per (step location, key of ``sets``): expansions, first_seq, text."""
    return steps.join(sets.select("text", "key").hint("merge"), "text").groupBy("location", "key").agg(F.count("*").alias("expansions"), F.min("step_seq").alias("first_seq"), F.min_by("text", "step_seq").alias("text"))


def members_by_key(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.first("members").alias("members"))


def ambiguities(steps: DataFrame, matches: DataFrame) -> DataFrame:
    """A2: one row per (step location, set of two or more authoritative definitions): expansions, first_seq, members."""
    sets = ambiguous_sets(matches)
    return ambiguous_places(steps, sets).join(members_by_key(sets).hint("merge"), "key").drop("key")


def ambiguity_message(expansions: str = "expansions", text: str = "text", members: str = "members", partial: Column | None = None):
    """A3: of one step or of an outline's expansions; ``partial`` marks members that are known in part only."""
    many = F.when(F.col(expansions) > 1, F.concat(F.lit(" in "), F.col(expansions).cast("string"), F.lit(" expansions"))).otherwise("")
    least = F.when(partial, "at least ").otherwise("") if partial is not None else F.lit("")
    return F.concat(F.lit("Step `"), F.col(text), F.lit("` is accepted by "), least, F.size(members).cast("string"), F.lit(" definitions"), many)


def overlaps(prepared: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Pairs (a < b) that accept one's witness though no step proves them ambiguous; witness of the first that does.

    ``ambiguous``: sets of definitions (column ``members``) that some step proves ambiguous (U13). Matchers meet before their
    definitions do, as those of one matcher say nothing; and only pairs found are looked up in the sets.
    """
    own = prepared.where("witness is not null").select(F.col("def_id").alias("left_id"), F.col("witness").alias("text"), F.col("matcher_kind").alias("lk"), F.col("normalized_matcher").alias("ln"))
    hits = text_matches(own, prepared).where("authoritative")
    other = prepared.select("def_id", F.col("matcher_kind").alias("rk"), F.col("normalized_matcher").alias("rn")).hint("merge")
    hit = durable(hits.select("text", "def_id").join(other, "def_id"))
    met = own.select("text", "lk", "ln").distinct().join(hit.select("text", "rk", "rn").distinct().hint("merge"), "text").where("not (lk = rk and ln = rn)")
    pairs = own.join(met.hint("merge"), ["text", "lk", "ln"]).join(hit.hint("merge"), ["text", "rk", "rn"]).where("left_id <> def_id")
    keyed = pairs.select(F.least("left_id", "def_id").alias("a"), F.greatest("left_id", "def_id").alias("b"), "left_id", "text")
    found = durable(keyed.groupBy("a", "b").agg(F.min_by("text", "left_id").alias("witness")))
    sets = ambiguous.select("members").distinct().select(F.sha2(F.array_join(F.transform("members", lambda m: m.cast("string")), ","), 256).alias("key"), F.explode("members").alias("m"))
    proven = found.select("a", "b").join(sets.withColumnRenamed("m", "a").hint("merge"), "a").join(sets.withColumnRenamed("m", "b").hint("merge"), ["key", "b"]).select("a", "b").distinct()
    return found.join(proven.hint("merge"), ["a", "b"], "left_anti")


def used(prepared: DataFrame, matches: DataFrame, indirect: DataFrame | None = None) -> DataFrame:
    """def_ids that count as used: matched, reached indirectly, positional, or not provable either way."""
    hit = matches.select("def_id")
    unprovable = prepared.where("expression is null or not authoritative").select("def_id")
    every = hit.unionByName(unprovable)
    if indirect is not None:
        every = every.unionByName(text_matches(indirect, prepared).select("def_id"))
    return every.distinct()


def unused(prepared: DataFrame, used_ids: DataFrame) -> DataFrame:
    """J9."""
    return prepared.where("not positional").join(used_ids, "def_id", "left_anti").select("def_id")


#: So many parameter types may be in force; each becomes part of expressions, so more of them are refused, not dropped.
MAX_TYPES = 100_000


class TooManyTypes(ValueError):
    """More parameter types than expressions can be built from."""


def parameter_types(declared: DataFrame, configured: DataFrame) -> DataFrame:
    """Name, expression of the types in force, of two tables (name, expression).

    A declaration replaces configuration; one that is made twice or has no expression leaves its name unknown; one without
    a name withdraws all of them, as it may be any.
    """
    own = declared.groupBy("name").agg(F.count("*").alias("n"), F.max("expression").alias("expression"))
    sure = own.where("n = 1 and expression is not null and name is not null").select("name", "expression")
    kept = configured.select("name", "expression").join(own.select("name"), "name", "left_anti").unionByName(sure)
    withdrawn = own.agg(F.coalesce(F.bool_or(F.col("name").isNull()), F.lit(False)).alias("withdrawn"))
    return kept.crossJoin(withdrawn).where("not withdrawn").drop("withdrawn")  # one row


def merged_parameter_types(declared: DataFrame, config: Config) -> tuple[dict[str, str], bool]:
    """(types in force as a dictionary, whether all are withdrawn)."""
    spark = declared.sparkSession
    configured = spark.createDataFrame([*config.parameter_types.items()], "name string, expression string")
    rows = parameter_types(declared, configured).limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise TooManyTypes(f"more than {MAX_TYPES} parameter types")
    return {r["name"]: r["expression"] for r in rows}, not declared.where("name is null").isEmpty()
