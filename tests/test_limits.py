"""Limits, cuts and what a run over a directory reports, by hand-made cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stepweave import model
from stepweave.functions import keys
from stepweave.operators import candidates, report, usage
from stepweave.plans.check import check
from stepweave.streaming import usage as stream


def definition(i, matcher, alpha, structural="S"):
    return (i, matcher, "cucumber-expression", "", matcher, "e", matcher, alpha, structural, ["call:x"], "", True, False, None, None, "cucumber", "Given", (f"f{i}.ts", 1, 1, 1, 9), [])


def proposals(rows):
    """All structural pairs in order: by left group, right group, left, right."""
    groups = list(dict.fromkeys(r[1] for r in rows))
    by = {g: [r for r in rows if r[1] == g] for g in groups}
    return [(min(a[0], b[0]), max(a[0], b[0])) for k, g in enumerate(groups) for h in groups[k + 1 :] for a in by[g] for b in by[h] if a[7] != b[7]]


@pytest.mark.parametrize("seed", range(2))
def test_structural_pairs_at_every_limit(spark, seed):
    r = random.Random(seed)
    rows = [definition(i, f"m{r.randint(0, 4)} x", f"a{r.randint(0, 3)}") for i in range(14)]
    d = candidates.classified(spark.createDataFrame(rows, model.DEFINITIONS)).persist()
    every = proposals(rows)
    for limit in (1, len(every) // 2, len(every) - 1, len(every)):
        pairs, over = candidates.structural_candidates(d, limit)
        assert sorted((p.a, p.b) for p in pairs.collect()) == sorted(every[:limit]), limit
        assert sum(x.skipped for x in over.collect()) == max(0, len(every) - limit)
    d.unpersist()


def test_the_candidate_limit_of_one_large_class(spark):
    n = 3000
    rows = [definition(i, f"step {i} only", f"h{i}") for i in range(n)]
    d = candidates.classified(spark.createDataFrame(rows, model.DEFINITIONS))
    pairs, census = candidates.candidates(d, model.Config(max_structural_class_comparisons=1000), ("structural",))
    assert pairs.count() == 1000 and [(r.owner, r.evaluated, r.skipped) for r in census.collect()] == [("structural", 1000, n * (n - 1) // 2 - 1000)]


def test_sampled_texts_are_whole_characters_of_both_ends(spark):
    texts = ["short", "x" * 41, "é" * 30, "a" + "🙂" * 20, "日本" * 15 + "z", "ab" * 20]
    got = [r.s for r in spark.createDataFrame([*enumerate(texts)], "k int, t string").orderBy("k").select(keys.sampled(F.col("t"), 40).alias("s")).collect()]
    for text, own in zip(texts, got):
        raw = text.encode()
        if len(raw) <= 40:
            assert own == text
            continue
        head, tail = raw[:20].decode(errors="ignore"), raw[-20:].decode(errors="ignore")
        assert own.startswith(head + " … [") and own.endswith("] … " + tail) and f"[{len(raw) - len(head.encode()) - len(tail.encode())} bytes, " in own


def test_rule_overrides():
    assert model.rule_override("duplicate-handler=off") == {"duplicate-handler": "off"}
    for bad in ("duplicate-handler", "nothing=error", "duplicate-handler=loud"):
        with pytest.raises(ValueError):
            model.rule_override(bad)


def project(path):
    (path / "a.ts").write_text('import { Given } from "@cucumber/cucumber"\nGiven("one thing", () => { go() })\nGiven("one thing", () => { stop() })\nGiven("a {colour} thing", () => { paint() })\n')
    (path / "a.feature").write_text("Feature: f\n  Scenario: s\n    Given one thing\n    Given a red thing\n")
    return str(path)


def test_a_baseline_file_is_written_and_used(spark, tmp_path):
    root, baseline = project(tmp_path), str(tmp_path / "base.json")
    config = model.Config(suppressions=[{"rule": "duplicate-matcher", "path": "lib/", "reason": "no"}])
    first = check(spark, root, config)
    assert first.exit_code == 1 and "suppression 1 selects no definition" in first.diagnostics
    written = check(spark, root, config, baseline=baseline, update_baseline=True)
    assert written.exit_code == 0 and sum(json.load(open(baseline))["fingerprints"].values()) >= 1
    assert check(spark, root, config, baseline=baseline).exit_code == 0


def test_declared_parameter_types_reach_the_expressions(spark, tmp_path):
    root = project(tmp_path)
    declared = spark.createDataFrame([("colour", "red|blue")], "name string, expression string")
    used = lambda outcome: [f.members for f in outcome.result.findings.where("rule = 'unused-definition'").collect()]
    assert used(check(spark, root, declared=declared)) == []
    assert usage.merged_parameter_types(declared, model.Config(parameter_types={"colour": "x", "size": "1"})) == ({"colour": "red|blue", "size": "1"}, False)
    assert usage.merged_parameter_types(spark.createDataFrame([(None, "x")], "name string, expression string"), model.Config(parameter_types={"size": "1"})) == ({}, True)


def test_a_baseline_beyond_its_limit_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "MAX_BASELINE", 0)
    with pytest.raises(ValueError):
        check(spark, project(tmp_path), baseline=str(tmp_path / "b.json"), update_baseline=True)


def test_steps_as_a_stream(spark, tmp_path):
    from stepweave.functions.matchers import with_expressions

    rows = [definition(0, "I have {int} cakes", "a"), definition(1, "I have 1 cakes", "b")]
    prepared = with_expressions(candidates.classified(spark.createDataFrame(rows, model.DEFINITIONS)), {})
    told = [("2024-01-01 00:00:10", "I have 1 cakes"), ("2024-01-01 00:00:20", "I have 5 cakes"), ("2024-01-01 00:00:30", "nothing"), ("2024-01-01 00:01:30", "I have 2 cakes")]
    spark.createDataFrame(told, "at string, text string").selectExpr("cast(at as timestamp) at", "text").write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("at timestamp, text string").parquet(f"{tmp_path}/in")
    query = stream.windowed(stream.reached(live, prepared)).writeStream.format("memory").queryName("told").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.n_steps, r.n_undefined, r.n_ambiguous) for r in spark.table("told").orderBy("window.start").collect()]
    assert got == [(3, 1, 1), (1, 0, 0)]


def test_every_dialect_is_read():
    from stepweave.sources import gherkin

    for name, (feature, background, _, scenario, outline, examples, steps) in gherkin.DIALECTS.items():
        for word in (w for w in steps if w != "*"):
            text = f"# language: {name}\n{feature[-1]}: f\n  {background[-1]}:\n    {word} zero\n  {scenario[0]}: s\n    {word} one\n    * two\n  {outline[-1]}: o\n    {word} <x>\n    {examples[-1]}:\n      | x |\n      | 1 |\n"
            found = gherkin.parse(text)
            assert [s[1] for x in found for s in x.steps] == ["zero", "one", "two", "<x>"], (name, word)
            assert [x.examples for x in found if x.examples] == [[[["x"], ["1"]]]], (name, word)
