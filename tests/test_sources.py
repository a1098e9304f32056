"""Parsers, discovery and a whole run over a small project."""

import json

import pytest
from pyspark.sql import functions as F

from stepweave.plans.check import check, check_and_report
from stepweave.sources import code, files, gherkin


def steps(text, markdown=False):
    return [(s[0], s[1]) for scenario in gherkin.parse(text, markdown) for s in scenario.steps]


def test_gherkin_structure():
    text = '﻿# a comment\n@tag\nFeature: f\n  Free text\n  Background:\n    Given b\n  Scenario: s\n    When w\n      """\n      Given not a step\n      """\n    Then t\n      | a | b\\|c |\n  Rule: r\n    Background:\n      * star\n    Example: e\n      And x\n'
    assert steps(text) == [("Given", "b"), ("When", "w"), ("Then", "t"), ("*", "star"), ("And", "x")]
    assert gherkin.cells(r"| a\|b | c\nd | \\ |", 1) == ["a|b", "c\nd", "\\"]


@pytest.mark.parametrize("text", ["Scenario: no feature", "nothing", "Feature: a\nFeature: b", '# language: xx\nFeature: a', 'Feature: a\n  Scenario: s\n    Given x\n      """\n'])
def test_gherkin_errors(text):
    with pytest.raises(gherkin.GherkinError):
        gherkin.parse(text)


def test_gherkin_dialects_and_markdown():
    assert steps("# language: es\nCaracterística: c\n  Escenario: e\n    Dado que algo\n") == [("Dado", "que algo")]
    assert steps("# language: ja\n機能: a\n  シナリオ: b\n    前提 ログインする\n") == [("前提", "ログインする")]
    assert steps("# Feature: fox\n## Scenario: sun\n* Given a\n1. When b\n* **Then** c\n\n```\n* Given no\n```\n", True) == [("Given", "a"), ("When", "b"), ("Then", "c")]
    assert steps("", True) == [] and steps("# Just prose\n\n* a list\n", True) == []


def test_outlines(spark):
    text = "Feature: f\n  Scenario Outline: o\n    Given the <a<b> value\n    Then <c>\n    Examples:\n      | b | b |\n      | 7 | 8 |\n      | 9 | 0 |\n    Examples:\n      | c |\n  Scenario Outline: empty\n    Given <x>\n    Examples:\n      | x |\n"
    found, errors = gherkin.feature_steps(spark.createDataFrame([("a.feature", text), ("b.feature", "bad")], "path string, content string"))
    got = [(r.step_seq, r.text) for r in found.orderBy("step_seq").collect()]
    assert got == [(0, "the <a7 value"), (1, "the <a9 value"), (2, "<c>"), (3, "<c>"), (4, "<x>")]
    assert [r.path for r in errors.collect()] == ["b.feature"] and gherkin.within_budget(found)


JS = """
import { Given as given, When } from "@cucumber/cucumber";
import * as lib from '@cucumber/cucumber';
const step = When;
// stepweave-ignore duplicate-matcher -- kept for later
given('the user\\'s {int}', async (n) => { const t = load(n); await save(t); expect(t).toBe("x"); });
When(/^a \\/ b$/i, function (x) { return go(x); });
lib.Then("done", finish);
function finish() { close(); }
step(`plain`, () => {});
step(`with ${value}`, () => {});
other.Given('no', () => {});
"""


def test_javascript():
    found, said = code.javascript("a.ts", JS)
    assert [(d["matcher"], d["matcher_kind"], d["matcher_flags"], d["registration"]) for d in found] == [("the user's {int}", "cucumber-expression", "", "Given"), ("^a \\/ b$", "regular-expression", "i", "When"), ("done", "cucumber-expression", "", "Then"), ("plain", "cucumber-expression", "", "When")]
    assert found[0]["inline_suppressions"] == [{"rule": "duplicate-matcher", "reason": "kept for later"}]
    assert [e.split(":")[0] for e in found[0]["events"]] == ["call", "await", "call", "assert"]
    assert found[2]["events"] == ["call:close"] and found[3]["trivial"] and len(said) == 1


def test_handlers_compare_by_structure():
    forms = [code.javascript("a.ts", f"Given('x', ({p}) => {{ open({p}, {v}); }})")[0][0] for p, v in (("a", "'1'"), ("b", "'1'"), ("b", "'2'"))]
    assert forms[0]["h_alpha"] == forms[1]["h_alpha"] != forms[2]["h_alpha"] and len({f["h_structural"] for f in forms}) == 1
    assert forms[0]["events"] == forms[2]["events"]


def test_shadowed_names_and_decorators():
    assert code.javascript("a.ts", "const Given = f; Given('x', () => {});")[0] == []
    found, _ = code.javascript("a.ts", "import { Given } from 'playwright-bdd/decorators';\nclass P { @Given('x {int}')\n async open(n: number) { await this.page.goto(n); } }")
    assert found[0]["events"] and found[0]["framework"] == "playwright-bdd"


def test_ruby():
    found, _ = code.ruby("a.rb", "Given(/^a (\\d+)$/i) do |n|\n  open n\nend\nWhen 'b {int}' do |x|\n  pending\nend\n")
    assert [(d["matcher"], d["matcher_kind"], d["matcher_flags"], d["trivial"]) for d in found] == [("^a (\\d+)$", "regular-expression", "i", False), ("b {int}", "cucumber-expression", "", True)]


def test_adapters():
    assert code.adapter_for("x.spec.ts") is code.javascript and code.adapter_for("x.py") is None
    with pytest.raises(ValueError):
        code.register((".ts",), None)


def test_exclusion(spark):
    rows = [(b"\x1f\x8b\x08\x00",), (b"a\x00b",), (b"x" * 300,), (b"Given('a', " + b"x" * 300,), (b"short\n" * 9,)]
    got = [r[0] for r in spark.createDataFrame(rows, "raw binary").select(files.exclusion(F.col("raw"))).collect()]
    assert sorted(map(str, got)) == sorted(["compressed", "binary", "minified", "None", "None"])


def test_configuration():
    merged = files.merged_config({"rules": {"unused-definition": "off"}, "exclude": ["a"]}, {"exclude": ["b"], "rules": {"duplicate-matcher": "warning"}})
    assert merged.exclude == ["b"] and merged.severity("unused-definition") == "off" and merged.severity("duplicate-matcher") == "warning"
    for bad in ({"nope": 1}, {"rules": {"x": "error"}}, {"threshold": -1.0}):
        with pytest.raises(ValueError):
            files.merged_config(bad)


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    for name, text in {"steps.ts": "".join(f"Given('{t}', () => {{ {h}(); }});\n" for t, h in (("twice told", "one"), ("twice told", "two"), ("twice told", "three"), ("a lamp is lit", "light"), ("nobody asks", "wait"))), "a.feature": "Feature: f\n  Scenario: s\n    Given a lamp is lit\n", "node_modules/x/steps.ts": "Given('hidden', () => {});", "ignored/y.ts": "Given('hidden', () => {});", ".gitignore": "ignored/\n"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


def test_discovery(project):
    found = files.discover(str(project))
    assert [p.split("/")[-1] for p in found.definitions + found.features] == ["steps.ts", "a.feature"]
    assert files.discover(str(project), files.merged_config({"definitions": ["none/*.ts"]})).unmatched == ["none/*.ts"]
    with pytest.raises(files.BudgetExceeded):
        files.discover(str(project), max_entries=2)


def test_whole_run(spark, project):
    outcome, written = check_and_report(spark, str(project), files.merged_config({"reporters": ["json"], "threshold": 60.0, "rules": {"near-duplicate-step": "off"}}))
    assert (outcome.n_definitions, outcome.n_steps, outcome.exit_code) == (5, 1, 0)
    assert outcome.threshold["percentage"] == 60.0 and outcome.by_rule["duplicate-matcher"] == 2
    assert json.load(open(written[0]))["summary"]["errors"] == 2


def test_changed_and_reference(spark, project):
    assert check(spark, str(project), changed=[]).by_rule == {}
    assert check(spark, str(project), reference=str(project)).by_rule == {}
