"""Nothing is cut where no limit is set, and nothing grows with the square of a table where its result does not."""

import random

import pytest

from stepweave import model
from stepweave.operators import candidates, forest, verify


def definition(i, matcher, alpha, structural="S", scope=None, path="f.ts", kind="cucumber-expression"):
    return (i, matcher, kind, "", " ".join(matcher.split()), "e", matcher, alpha, structural, ["call:x"], "", True, False, "complete", scope, "cucumber", "Given", (path, i + 1, 1, i + 1, 9), [])


def table(spark, rows):
    return candidates.classified(spark.createDataFrame(rows, model.DEFINITIONS))


@pytest.fixture(scope="module")
def large(spark):
    return table(spark, [definition(i, f"step {i % 760} only", f"h{i % 760}") for i in range(760)])


def test_all_pairs_of_a_large_class_are_made(large):
    pairs, over = candidates.structural_candidates(large)
    assert pairs.distinct().count() == 760 * 759 // 2 and over.isEmpty()


def test_the_census_of_a_large_table_skips_nothing(spark):
    d = table(spark, [definition(i, f"step {i} only", f"h{i}") for i in range(2100)])
    _, census = candidates.candidates(d, model.Config(), ("normalized", "structural"))
    assert [tuple(r) for r in census.collect()] == [("structural", 2100 * 2099 // 2, 0)]


def mixed(spark, seed, n=60):
    r = random.Random(seed)
    names = ["open door", "open  door", "open doors", "shut door", "opens the door"]
    scope = lambda: r.choice([None, None, "", "this"])
    rows = [definition(i, r.choice(names), r.choice("pqr"), r.choice("ST"), scope(), r.choice(["f.ts", "g.ts"]), r.choice(["literal", "cucumber-expression"])) for i in range(n)]
    return table(spark, rows).persist()


@pytest.mark.parametrize("seed", range(2))
def test_pairs_checked_by_kind_are_those_checked_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(candidates, "PIECE", 2)
    d = mixed(spark, seed)
    only = ("normalized", "identical", "structural")
    by_kind, census = verify.checked(d, model.Config(), only)
    single, other = verify.checked(d, model.Config(max_candidate_comparisons=10**9, max_structural_class_comparisons=10**9), only)
    assert by_kind.kinds is not None and single.kinds is None
    told = lambda x: sorted(repr(p) for p in x.records().collect())
    assert told(by_kind) == told(single)
    assert sorted(census.collect()) == sorted(other.collect())


def test_verification_of_a_large_class_drops_no_pair(large):
    found, _ = verify.checked(large, model.Config(), ("structural",))
    assert found.records().count() == 760 * 759 // 2


def test_a_forest_of_all_pairs_needs_no_pairs(spark):
    r = random.Random(3)
    rows = [(i, r.choice("uvw")) for i in range(40)]
    extra = [tuple(sorted(r.sample(range(40), 2))) for _ in range(3)]
    every = [(a, b) for a, k in rows for b, m in rows if k == m and a < b] + extra
    few = forest.all_pairs_forest(spark.createDataFrame(rows, "def_id bigint, k string"), ["k"]).select("a", "b")
    assert few.count() == 40 - 3
    told = lambda df: sorted({(x.a, x.b) for x in forest.spanning_forest(df.withColumn("rule", df.a * 0), ["rule"]).collect()})
    frame = spark.createDataFrame(every, "a bigint, b bigint")
    assert told(few.union(spark.createDataFrame(extra, "a bigint, b bigint"))) == told(frame)


def test_trees_are_kept_without_rounds(spark, monkeypatch):
    cuts, cut = [], forest.durable
    monkeypatch.setattr(forest, "durable", lambda df: cuts.append(1) or cut(df))
    edges = [("x", k, k + 1) for k in range(50)] + [("y", 0, k) for k in range(1, 20)]
    got = forest.spanning_forest(spark.createDataFrame(edges, "rule string, a bigint, b bigint"), ["rule"]).collect()
    assert sorted(tuple(e) for e in got) == sorted(edges) and len(cuts) == 3


def test_blocking_gathers_no_definitions_on_the_driver(spark, large):
    plan = candidates.blocking_candidates(large)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_equal_findings_are_one_row_until_they_are_read(spark):
    from stepweave.plans import analyze

    rows = [definition(0, "I have {int} cakes", "a"), definition(1, "I have 1 cakes", "b")]
    steps = spark.createDataFrame([(k, "Given", "I have 1 cakes", ("a.feature", k, 1, k, 9)) for k in range(2500)], model.STEPS)
    found = analyze.analyze(spark.createDataFrame(rows, model.DEFINITIONS), steps).findings
    assert sorted(f.seq for f in found.collect()) == list(range(found.count()))
    assert found.where("rule = 'ambiguous-step'").count() == 2500
    prepared = analyze.matchers.with_expressions(table(spark, rows), {})
    told = analyze.usage_findings(steps, prepared, model.Config(), None).where("rule = 'ambiguous-step'").collect()
    assert [(f.members, f.copies) for f in told] == [([0, 1], 2500)]


def test_the_first_pairs_are_not_gathered_on_the_driver(spark):
    pairs = spark.createDataFrame([(k % 7, k) for k in range(7, 60)], "a bigint, b bigint")
    every = sorted(tuple(p) for p in pairs.collect())
    for k in (1, 10, 52, 53):
        cut = candidates.first_of(pairs, k)
        assert sorted(tuple(p) for p in cut.collect()) == every[:k]
        assert "TakeOrdered" not in cut._jdf.queryExecution().executedPlan().toString()
