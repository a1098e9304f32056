"""A whole run over a directory: discover, extract, analyse, apply modes, report, decide."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.model import Config
from stepweave.operators import modes, report, usage
from stepweave.plans.analyze import Result, analyze
from stepweave.sources import code, files, gherkin


@dataclass
class Outcome:
    result: Result
    exit_code: int
    n_definitions: int
    n_steps: int
    threshold: dict
    by_rule: dict
    diagnostics: list[str] = field(default_factory=list)


def changed_files(root: str, ref: str) -> list[str]:
    """Paths that differ from a commit, as git lists them."""
    said = subprocess.run(["git", "-C", root, "diff", "--relative", "-z", "--name-only", ref], capture_output=True, text=True, check=True).stdout
    return [f"{root}/{p}" for p in said.split("\0") if p]


def corpus(spark: SparkSession, root: str, config: Config) -> tuple[DataFrame, DataFrame, list[str], bool]:
    """(definitions, steps, diagnostics, complete features) of a directory."""
    found = files.discover(root, config)
    sources = files.read_files(spark, found.definitions).withColumn("excluded", files.exclusion(F.col("raw")))
    definitions, said = code.definitions(sources.where("excluded is null and content is not null"))
    texts = files.read_files(spark, found.features)
    steps, errors = gherkin.feature_steps(texts)
    if not gherkin.within_budget(steps):
        raise files.BudgetExceeded(f"more than {gherkin.MAX_STEPS} steps or {gherkin.MAX_BYTES} bytes of them below {root}")
    bad = [f"{r.path}: {r.error}" for r in errors.collect()]
    lost = [f"{r.path}: {r.excluded or 'not UTF-8'}" for r in sources.where("excluded is not null or content is null").select("path", "excluded").collect()]
    spoken = [r.message for r in said.collect()]
    return definitions, steps, [*[f"no file for {p}" for p in found.unmatched], *spoken, *lost, *bad], bool(found.features) and not bad


def check(spark: SparkSession, root: str, config: Config | None = None, baseline: DataFrame | str | None = None, changed: list[str] | None = None, reference: str | None = None, update_baseline: bool = False, strict: bool = False, indirect: DataFrame | None = None, declared: DataFrame | None = None) -> Outcome:
    """Run everything. ``baseline``: counts by fingerprint or the path of a baseline file, written if ``update_baseline``.

    ``reference`` is another tree whose findings are the baseline (U15). ``strict`` raises where the result is incomplete.
    ``indirect`` (text): steps that code calls. ``declared`` (name, expression): parameter types found in code (J13).
    """
    config = config or files.merged_config(files.config_layer(root))
    definitions, steps, said, complete = corpus(spark, root, config)
    if declared is not None:
        types, withdrawn = usage.merged_parameter_types(declared, config)
        config = replace(config, parameter_types=types)
        said = said + ["parameter types are unknown: one is declared without a name"] * withdrawn
    notes = [f"suppression {k + 1} selects no definition" for k in modes.unmatched_suppressions(definitions, config.suppressions)]
    result = analyze(definitions, steps, config, indirect, strict)
    findings = modes.without_unused(result.findings, complete)
    name = reference or (baseline if isinstance(baseline, str) else "file")
    if isinstance(baseline, str):
        if update_baseline:
            result.findings = findings
            report.write_baseline(result, baseline)
        baseline = report.read_baseline(spark, baseline, update_baseline)
    if reference is not None:
        d, s, _, ok = corpus(spark, reference, config)
        baseline = modes.baseline_counts(modes.without_unused(analyze(d, s, config).findings, ok))
    if baseline is not None:
        findings = modes.apply_baseline(findings, baseline, name)
    if changed is not None:
        findings = modes.retain_changed(findings, definitions, spark.createDataFrame([(p,) for p in changed], "path string"))
    result.findings = findings
    n_definitions, n_steps = definitions.count(), steps.count()
    threshold = modes.duplication_threshold(findings, definitions, config.threshold)
    counts = modes.summary(findings).first()
    status = modes.exit_code(threshold, findings, config, bool(result.incomplete), n_definitions, n_steps, len(said))
    return Outcome(result, status, n_definitions, n_steps, threshold.first().asDict(), counts["by_rule"] or {}, said + notes)


def check_and_report(spark: SparkSession, root: str, config: Config | None = None, **options) -> tuple[Outcome, list[str]]:
    config = config or files.merged_config(files.config_layer(root))
    outcome = check(spark, root, config, **options)
    return outcome, report.write_reports(outcome.result, config.reporters, f"{root}/{config.output}", config.threshold)
