"""Scalar functions against plain models and tables of examples."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepweave.functions import keys, matchers, metrics
from stepweave.operators.modes import glob_regex


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").select("k", column.alias("v")).orderBy("k").select("v").collect()]


def test_normalization(spark):
    rows = [("I  have { int }  cakes",), ("ｆｕｌｌ width",), ("tab\tand {word }",), (None,)]
    assert values(spark, keys.normalized_expression(F.col("t")), rows, "t string") == ["I have {int} cakes", "full width", "tab and {word}", None]


@pytest.mark.parametrize("a,b", [(r"^a\s+b$", r"^a b$"), (r"(?<name>x)", "(x)"), (r"a\ b", "a   b")])
def test_regexes_that_are_the_same(a, b):
    assert keys.canonical_regex(a) == keys.canonical_regex(b)


def test_regexes_that_differ():
    assert len({keys.canonical_regex(x) for x in ("(?<=a)b", "(?:a)b", "[ ]", r"[\s+]", "(a)b", "a+")}) == 6


def test_flags_and_events(spark):
    assert values(spark, keys.effective_flags(F.col("f")), [("gim",), ("mi",), ("yy",), (None,)], "f string") == ["im", "im", "", ""]
    rows = [(["method:x", "call:b", "assert:#m:1:2", "call:b", "deferred-assert:#m:1:2", "if"],)]
    assert values(spark, keys.anchors(F.col("e")), rows, "e array<string>") == [["assert:#m:1", "call:b", "deferred-assert:#m:1:2"]]
    assert values(spark, keys.run_events(F.col("e")), rows, "e array<string>")[0][0] == "call:b"


def test_fingerprints(spark):
    parts = ("a", "bé")
    want = hashlib.sha256(keys.PARTS + b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()[:32]
    assert values(spark, keys.fingerprint_parts(F.col("a"), F.col("b")), [parts, ("ab", "é")], "a string, b string")[0] == want
    assert values(spark, keys.fingerprint(F.col("a")), [("x",)], "a string") == [hashlib.sha256(keys.SINGLE + b"x").hexdigest()[:32]]


def test_shingles(spark):
    assert values(spark, keys.shingles(F.col("t")), [("Ab12c",), ("ab",), ("",)], "t string") == [["ab0", "b0c"], ["ab"], []]


def test_substitution(spark):
    rows = [("the <a<b> of <c> <d", {"b": "<c>", "c": "7"}), ("<x>", {}), ("<>", {"": "e"})]
    assert values(spark, keys.substituted(F.col("t"), F.col("m")), rows, "t string, m map<string,string>") == ["the <a<c> of 7 <d", "<x>", "e"]


def test_matcher_diff(spark):
    rows = [("red plate", "red gate"), ("a", "a"), ("", "x"), ("aa", "aaa")]
    got = values(spark, keys.matcher_diff(F.col("l"), F.col("r")), rows, "l string, r string")
    assert [tuple(g) for g in got] == [("red ", "pl", "g", "ate"), ("a", "", "", ""), ("", "", "x", ""), ("aa", "", "a", "")]


def test_rounding_and_text(spark):
    assert values(spark, keys.round_score(F.col("x")), [(0.0005,), (0.9994,), (1.0,)], "x double") == [0.001, 0.999, 1.0]
    assert values(spark, keys.is_stub_label(F.col("t")), [("Not-implemented!",), ("todo",), ("todos",)], "t string") == [True, True, False]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_metrics_models(a, b):
    def lcs(x, y):
        return 0 if not x or not y else lcs(x[1:], y[1:]) + 1 if x[0] == y[0] else max(lcs(x[1:], y), lcs(x, y[1:]))

    assert metrics.lcs_length(a, b) == lcs(a, b)
    score = metrics.jaro_winkler(a, b)
    assert 0 <= score <= 1 and (score == 1) == (a == b) and abs(score - metrics.jaro_winkler(b, a)) < 0.2


def test_jaro_winkler_examples():
    for a, b, want in (("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("DWAYNE", "DUANE", 0.84), ("", "", 1.0), ("", "a", 0.0)):
        assert abs(metrics.jaro_winkler(a, b) - want) < 1e-4


@pytest.mark.parametrize("left,right,span", [("red button shown", "blue button shown", 1), ("red button shown", "blue button hidden", 1 << 30), ("in new york now", "in york city now", 2), ("a", "a", 0), ("a b c d", "a", 3)])
def test_change_span(left, right, span):
    assert metrics.change_span(left.split(), right.split()) == span


def test_polarity(spark):
    rows = [("user is not here", "user is here", True), ("not a", "no b", False), ("feature enabled", "feature disabled", True), ("valid input", "invalid input", True), ("in", "inin", False)]
    got = values(spark, metrics.polarity_conflict(keys.words(F.col("l")), keys.words(F.col("r"))), [r[:2] for r in rows], "l string, r string")
    assert got == [r[2] for r in rows]


@pytest.mark.parametrize("expression,yes,no", [
    ("I have {int} cake(s)", ["I have 3 cakes", "I have -1 cake"], ["I have x cakes", "I have 3 cakes "]),
    ("it is/was {float}", ["it is 1.5", "it was .5"], ["it be 1"]),
    ('say {string}', ['say "a b"', "say 'c'"], ["say a"]),
    (r"a \(b\) c\/d", ["a (b) c/d"], ["a b c/d"]),
    ("any {}", ["any thing at all", "any "], ["any"]),
])
def test_standard_expressions(expression, yes, no):
    found = matchers.compiled(matchers.standard_expression(expression))
    assert all(found.search(t) for t in yes) and not any(found.search(t) for t in no)


@pytest.mark.parametrize("expression", ["a ()", "a {b}", "a (b", "x {int}/y", "a\\"])
def test_nonstandard_expressions(expression):
    with pytest.raises(matchers.Unsupported):
        matchers.standard_expression(expression)


def test_fallback_and_preparation():
    assert matchers.fallback_expression("a {thing}") == ("^a .+$", False)
    assert matchers.fallback_expression("a {color}", {"color": "red|blue"}) == ("^a (?:red|blue)$", True)
    assert matchers.prepared("regular-expression", "(?=a)b", "", "cucumber", {}) == (None, False)
    assert matchers.prepared("regular-expression", "^a$", "i", "cucumber", {}) == ("(?i)^a$", True)
    assert matchers.prepared("literal", "a", "", "jest", {}) == (None, False)


@pytest.mark.parametrize("expression,text", [("I have {int} cake(s)", "I have 1 cakes"), ("a/b {word}", "a sample"), ("x {color}", "x red"), ("x {odd}", None), ("x {unknown}", None), (r"\(a\)", "(a)")])
def test_witnesses(expression, text):
    assert matchers.witness(expression, {"color": "(red|blue)", "odd": r"\d+"}) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("word {string} a/b {word} cake(s) {int} {float}".split()), min_size=1, max_size=5))
def test_a_witness_is_accepted(tokens):
    expression = " ".join(tokens)
    assert matchers.compiled(matchers.standard_expression(expression)).search(matchers.witness(expression))


@pytest.mark.parametrize("glob,yes,no", [("**/*.ts", ["a.ts", "x/y.ts"], ["a.js"]), ("src/", ["src/a/b"], ["lib/src/a"]), ("*.{feature,feature.md}", ["a.feature", "b/c.feature.md"], ["a.md"]), ("a?[bc]", ["axb"], ["axd"])])
def test_globs(glob, yes, no):
    assert all(re.match(glob_regex(glob), t) for t in yes) and not any(re.match(glob_regex(glob), t) for t in no)
