"""The rules on small tables, the counts that published corpora give, and the forest against its model."""

import random

import pyarrow as pa
import pytest

from stepweave import model
from stepweave.operators import components, forest, modes, report
from stepweave.operators.components import connected_components
from stepweave.plans.analyze import analyze


def definition(i, matcher, kind="cucumber-expression", alpha=None, structural=None, events=("call:x",), framework="cucumber", scope=None, flags="", normalized=None, path=None, inline=()):
    return (i, matcher, kind, flags, normalized or matcher, "e", matcher, alpha or f"h{i}", structural or alpha or f"h{i}", list(events), "", True, False, None, scope, framework, "Given", (path or f"f{i // 10:04d}.ts", i, 1, i, 9), list(inline))


def tables(spark, rows, texts=()):
    steps = [(k, "Given", t, ("a.feature", k, 1, k, 5)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, model.DEFINITIONS), spark.createDataFrame(steps, model.STEPS)


def run(spark, rows, texts=(), **options):
    result = analyze(*tables(spark, rows, texts), model.Config(**options))
    return result, [(f.rule, f.members) for f in result.findings.orderBy("seq").collect()]


def only(*names):
    return {"rules": {r[0]: (r[1] if r[0] in names else "off") for r in model.RULES}}


def test_shared_structure_counts(spark):
    n = 30
    names = [f"step number {chr(97 + i % 26)}{chr(97 + i // 26)} zz" for i in range(n)]
    result, found = run(spark, [definition(i, names[i], structural="S") for i in range(n)])
    assert len(found) == 2 * n - 1
    assert {r.owner: r.evaluated for r in result.census.collect()} == {"structural": n * (n - 1) // 2}


def test_unrelated_counts(spark):
    words = ["zebra", "quick", "mount", "flute", "jelly", "vivid"]
    result, found = run(spark, [definition(i, w, events=(f"call:{w}",)) for i, w in enumerate(words)])
    assert [r for r, _ in found] == ["unused-definition"] * len(words) and result.pairs.count() == 0


def test_exact_groups_and_the_cluster_boundary(spark):
    _, four = run(spark, [definition(i, "same") for i in range(4)], **only("duplicate-matcher"))
    _, five = run(spark, [definition(i, "same") for i in range(5)], **only("duplicate-matcher"))
    assert four == [("duplicate-matcher", [0, 1]), ("duplicate-matcher", [1, 2]), ("duplicate-matcher", [2, 3])]
    assert five == [("duplicate-matcher", [0, 1, 2, 3, 4])]


def test_usage_rules(spark):
    rows = [definition(0, "I have {int} cake(s)"), definition(1, "I have 1 cakes"), definition(2, "never seen"), definition(3, "a {strange} one"), definition(4, "x {word}"), definition(5, "x sample")]
    _, found = run(spark, rows, ["I have 3 cakes", "I have 1 cakes"], **only("ambiguous-step", "overlapping-matcher", "unused-definition"))
    assert found == [("ambiguous-step", [0, 1]), ("unused-definition", [2]), ("overlapping-matcher", [4, 5]), ("unused-definition", [4]), ("unused-definition", [5])]


def test_negation_and_parameters(spark):
    rows = [definition(0, "the door is open", alpha="a"), definition(1, "the door is not open", alpha="a"), definition(2, "switch to dark theme", alpha="p", structural="S"), definition(3, "switch to light theme", alpha="q", structural="S")]
    _, found = run(spark, rows, **only(*"near-duplicate-step duplicate-handler parameterization-candidate".split()))
    assert found == [("duplicate-handler", [0, 1]), ("parameterization-candidate", [2, 3])]


def test_positional_definitions_never_share_a_matcher(spark):
    rows = [definition(i, "same", kind="literal", framework="jest", events=(f"call:{i}",)) for i in range(3)]
    _, found = run(spark, rows)
    assert found == []


def test_suppressions_and_baseline(spark):
    rows = [definition(i, "same", path=f"lib/{i}.ts") for i in range(3)] + [definition(9, "other"), definition(10, "other", inline=[("duplicate-matcher", "on purpose")])]
    result, _ = run(spark, rows, **only("duplicate-matcher"), suppressions=[{"rule": "duplicate-matcher", "reason": "old", "path": "lib/"}])
    assert [f.reason for f in result.findings.orderBy("seq").collect()] == ["old", "old", "on purpose"]
    again, _ = run(spark, rows, **only("duplicate-matcher"))
    counts = modes.baseline_counts(again.findings)
    assert modes.apply_baseline(again.findings, counts, "b").where("reason is null").count() == 0
    assert modes.unmatched_suppressions(again.definitions, [{"rule": "duplicate-matcher", "reason": "", "path": "nowhere/"}, {"rule": "x", "reason": "", "matcher": "other"}]) == [0]


def test_threshold_and_exit(spark):
    rows = [definition(i, "same") for i in range(3)] + [definition(i, f"w{i}x") for i in (3, 4)]
    result, _ = run(spark, rows, **only("duplicate-matcher"))
    share = modes.duplication_threshold(result.findings, result.definitions, 60.0)
    assert (share.first().duplicated, share.first().percentage, share.first().passed) == (3, 60.0, True)
    tight = modes.duplication_threshold(result.findings, result.definitions, 59.99)
    code = lambda t, **o: modes.exit_code(t, result.findings, model.Config(**o), False, 5, 0)
    assert (code(share), code(tight), code(tight, require_features=True)) == (0, 1, 2)


def test_mixed_domains_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [definition(0, "a"), definition(1, "b", framework="ruby-cucumber")])


def test_candidate_limit_is_reported(spark):
    result, _ = run(spark, [definition(i, f"step {chr(97 + i)} zz", structural="S") for i in range(8)], max_candidate_comparisons=10)
    census = result.census.first()
    assert (census.evaluated, census.skipped) == (10, 18) and result.incomplete


def test_empty_tables(spark):
    result, found = run(spark, [])
    assert found == [] and result.census.count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_forest_is_kruskals(spark, seed):
    r = random.Random(seed)
    edges = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(90)})
    frame = spark.createDataFrame([("x", a, b) for a, b in edges] + [("y", a, b) for a, b in edges[::2]], "rule string, a bigint, b bigint")
    got = forest.spanning_forest(frame, ["rule"]).collect()
    for rule, own in (("x", edges), ("y", edges[::2])):
        want = forest.union_find_forest(pa.table({"a": [a for a, _ in own], "b": [b for _, b in own]}))
        assert sorted((e.a, e.b) for e in got if e.rule == rule) == list(zip(want["a"].to_pylist(), want["b"].to_pylist()))


def test_components_of_a_long_path_and_odd_edges(spark):
    edges = [(k, k + 1) for k in range(300)] + [(900, 900), (None, 5), (700, 701), (701, 700)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 900: 900, 700: 700, 701: 700}


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    cuts, cut = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: cuts.append(1) or cut(df))
    r = random.Random(4)
    path = [r.getrandbits(63) - 2**62 for _ in range(300)]
    edges = spark.createDataFrame([*zip(path, path[1:]), (5, 5), (None, 6)] + [(r.randrange(100), r.randrange(100)) for _ in range(60)], "u bigint, v bigint")
    found = lambda: {x.node: x.component for x in connected_components(edges).collect()}
    at_once = found()
    assert len(cuts) == 2 and {at_once[x] for x in path} == {min(path)}
    monkeypatch.setattr(components, "LOCAL", 10)
    assert found() == at_once and len(cuts) > 5


def test_reports(spark, tmp_path):
    rows = [definition(i, "a <b> ‮matcher", path="dir with space/é.ts") for i in range(6)]
    result, _ = run(spark, rows, **only("duplicate-matcher"))
    paths = report.write_reports(result, ["json", "sarif", "html", "terminal", "jsonl", "json"], str(tmp_path))
    assert len(paths) == 5
    found = report.sarif(result)["runs"][0]["results"][0]
    assert found["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "dir%20with%20space/%C3%A9.ts" and len(found["relatedLocations"]) == 5
    assert "‮" not in report.html_report(result) and "a &lt;b&gt;" in report.html_report(result)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/report.jsonl").collect()]
    assert len(lines) == 2 and '"type":"summary"' in lines[-1]
    report.write_baseline(result, f"{tmp_path}/base.json")
    assert modes.apply_baseline(result.findings, report.read_baseline(spark, f"{tmp_path}/base.json"), "b").where("reason is null").count() == 0
    assert report.fingerprint_rows(result.definitions).select("fingerprint").distinct().count() == 6
