"""What happens to findings after analysis: suppressions, baselines, changed files, threshold, exit code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.model import CLUSTER_RULES, THRESHOLD_RULES, Config

REASON = 512


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression; ``*`` and ``?`` cross separators, a final ``/`` means the subtree."""
    pattern = pattern + "**" if pattern.endswith("/") else pattern
    out, at, depth = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
            continue
        if c == "*":
            out.append(".*")
            while pattern[at + 1 : at + 2] == "*":
                at += 1
        elif c == "?":
            out.append(".")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in pattern[at + 2 :]:
            end = pattern.index("]", at + 2)
            body = pattern[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            at = end
        elif c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append(re.escape(c))
        at += 1
    return "^" + "".join(out) + "$"


def all_match(values: Column, pattern: Column) -> Column:
    return F.forall(values, lambda v: F.rlike(v, pattern))


def suppression_reason(rule: Column, paths: Column, matchers: Column, inline: Column, suppressions: list[dict]) -> Column:
    """the first configured entry that covers all members and names one, else the first inline one; null if none.

    paths, matchers: arrays in member order; inline: array of struct(rule, reason) in member order. Configured entries are
    few and become constants, so no join is needed.
    """
    found = []
    for entry in suppressions:
        fits = rule == entry["rule"]
        path = F.lit(glob_regex(entry["path"])) if entry.get("path") else None
        if path is not None:
            fits = fits & all_match(paths, path)
        if entry.get("matcher") is not None:
            fits = fits & F.array_contains(matchers, entry["matcher"])
        found.append(F.when(fits, F.lit(entry["reason"][:REASON])))
    own = F.filter(inline, lambda x: x["rule"] == rule)
    found.append(F.when(F.size(own) > 0, F.substring(F.get(own, F.lit(0))["reason"], 1, REASON)))
    return F.coalesce(*found)


def unmatched_suppressions(definitions: DataFrame, suppressions: list[dict]) -> list[int]:
    """F16: numbers of configured entries that select no definition, in one pass."""
    if not suppressions:
        return []
    tests = []
    for k, entry in enumerate(suppressions):
        fits = F.lit(True)
        if entry.get("path"):
            fits = fits & F.col("location.path").rlike(glob_regex(entry["path"]))
        if entry.get("matcher") is not None:
            fits = fits & (F.col("matcher") == entry["matcher"])
        tests.append(F.coalesce(F.max(fits), F.lit(False)).alias(f"s{k}"))
    row = definitions.agg(*tests).first()
    return [k for k in range(len(suppressions)) if not row[k]]


def active() -> Column:
    """F11."""
    return (F.col("severity") != "off") & F.col("reason").isNull()


def baseline_counts(findings: DataFrame) -> DataFrame:
    """Fingerprint, n of active findings."""
    return findings.where(active()).groupBy("fingerprint").agg(F.count("*").alias("n"))


def apply_baseline(findings: DataFrame, baseline: DataFrame, name: str) -> DataFrame:
    """As many active findings of a fingerprint as the baseline holds are suppressed, the first ones."""
    order = F.row_number().over(Window.partitionBy("fingerprint", active()).orderBy("seq"))
    known = baseline.select(F.col("fingerprint").alias("_f"), F.col("n").alias("_n"))
    ranked = findings.withColumn("_k", order).join(known, F.col("fingerprint") == F.col("_f"), "left")
    hit = active() & (F.col("_k") <= F.coalesce("_n", F.lit(0)))
    return ranked.withColumn("reason", F.when(hit, F.lit(f"in baseline {name}")).otherwise(F.col("reason"))).drop("_k", "_f", "_n")


def baseline_change(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Added and removed, by multiplicity."""
    p, c = previous.select("fingerprint", F.col("n").alias("p")), current.select("fingerprint", F.col("n").alias("c"))
    both = p.join(c, "fingerprint", "full_outer").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("c", F.lit(0)).alias("c"))
    grown = lambda a, b: F.coalesce(F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))), F.lit(0)).cast("bigint")
    return both.agg(grown("c", "p").alias("added"), grown("p", "c").alias("removed"))


def retain_changed(findings: DataFrame, definitions: DataFrame, changed: DataFrame) -> DataFrame:
    """findings with a member in one of the changed files (column ``path``)."""
    ids = definitions.select("def_id", F.col("location.path").alias("path")).join(changed.select("path").distinct(), "path", "left_semi")
    hit = findings.select("seq", F.explode("members").alias("def_id")).join(ids, "def_id", "left_semi").select("seq").distinct()
    return findings.join(hit, "seq", "left_semi")


def without_unused(findings: DataFrame, steps_complete: bool) -> DataFrame:
    """F13, fact 8: an incomplete set of features proves nothing unused."""
    return findings if steps_complete else findings.where("rule <> 'unused-definition'")


def without_uncertain(definitions: DataFrame, uncertain: DataFrame, remove: bool = True) -> DataFrame:
    """drop the definitions of uncertain files (column ``path``), or only bar their handlers from comparison."""
    paths = uncertain.select(F.col("path").alias("_u")).distinct()
    if remove:
        return definitions.join(paths, F.col("location.path") == F.col("_u"), "left_anti")
    marked = definitions.join(paths, F.col("location.path") == F.col("_u"), "left")
    return marked.withColumn("comparable", F.col("comparable") & F.col("_u").isNull()).drop("_u")


def duplication_threshold(findings: DataFrame, definitions: DataFrame, threshold: float) -> DataFrame:
    """Share of definitions that take part in an active error of a duplication rule."""
    hit = findings.where(active() & (F.col("severity") == "error") & F.col("rule").isin(*THRESHOLD_RULES)).select(F.explode("members").alias("def_id")).distinct()
    duplicated = definitions.join(hit, "def_id", "left_semi").agg(F.count("*").alias("duplicated"))
    total = definitions.agg(F.count("*").alias("total"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("duplicated") / F.col("total") * 100)
    return duplicated.crossJoin(total).select(F.lit(float(threshold)).alias("threshold"), "duplicated", "total", share.alias("percentage"), (share <= threshold).alias("passed"))  # one row each


def summary(findings: DataFrame) -> DataFrame:
    """Counts by state and the by_rule map, active findings only."""
    rules = findings.where(active()).groupBy("rule").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("by_rule"))
    counts = findings.agg(F.count_if(active() & (F.col("severity") == "error")).alias("errors"), F.count_if(active() & (F.col("severity") == "warning")).alias("warnings"), F.count_if(F.col("reason").isNotNull()).alias("suppressed"))
    return counts.crossJoin(rules)  # one row each


def exit_code(threshold: DataFrame, findings: DataFrame, config: Config, incomplete: bool, n_definitions: int, n_steps: int, diagnostics: int = 0) -> int:
    """2 if the run can't be trusted, 1 if it fails, else 0."""
    if (config.require_definitions and not n_definitions) or (config.require_features and not n_steps) or (config.fail_on_incomplete and incomplete) or (config.fail_on_unparseable and diagnostics):
        return 2
    failing = findings.where(active() & (F.col("severity") == "error") & (~F.col("rule").isin(*THRESHOLD_RULES)))
    return int(not threshold.first()["passed"] or not failing.isEmpty())


def supports_cluster(rule: Column) -> Column:
    """U2."""
    return rule.isin(*CLUSTER_RULES)
