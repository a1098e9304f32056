"""Comparison keys, fingerprints and other scalar derivations, as column expressions.

Python runs only where Spark has no equivalent (NFKC, the regular-expression canonicaliser), in Arrow batches, and NFKC
only for rows that are not ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

SINGLE, PARTS = b"stepweave:fingerprint:1:single\0", b"stepweave:fingerprint:1:parts\0"


@pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text: Column) -> Column:
    """Compatibility normal form; ASCII rows never leave the JVM's representation."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_expression(text: Column) -> Column:
    """Normal form, no blanks inside braces, single blanks elsewhere."""
    return collapse(F.regexp_replace(nfkc(text), r"\{\s*([^{}]*?)\s*\}", "{$1}"))


def canonical_regex(source: str) -> str:
    """Capture names and the spelling of white space do not tell two expressions apart."""
    text = unicodedata.normalize("NFKC", source)
    out, at, in_class = [], 0, False
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            pair = text[at : at + 2]
            if not in_class and pair == "\\ ":
                out.append(" ")
            elif not in_class and pair == "\\s" and text[at + 2 : at + 3] == "+":
                out.append(" ")
                at += 1
            else:
                out.append(pair)
            at += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif text.startswith(("(?<", "(?P<"), at) and text[text.index("<", at) + 1 : text.index("<", at) + 2] not in ("=", "!", ""):
            close = text.find(">", at)
            if close > 0:
                out.append("(")
                at = close + 1
                continue
        if not in_class and c.isspace():
            if not (out and out[-1] == " "):
                out.append(" ")
        else:
            out.append(c)
        at += 1
    return "".join(out).strip()


@pandas_udf(StringType())
def _canonical(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else canonical_regex(v))


def effective_flags(flags: Column, identity: str = "imsuv") -> Column:
    """The flags that matter, sorted, each once."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(flags, F.lit("")), ""), lambda f: F.instr(F.lit(identity), f) > 0))), "")


def normalized_matcher(kind: Column, matcher: Column, flags: Column, identity: str = "imsuv", canonical_source: bool = True) -> Column:
    """The text by which matchers of a kind are compared."""
    own = effective_flags(flags, identity)
    regex = _canonical(matcher)
    prefixed = F.when(F.lit(canonical_source) & (own != ""), F.concat(F.lit("[regex-flags:"), own, F.lit("] "), regex)).otherwise(regex)
    return F.when(kind == "regular-expression", prefixed).when(kind == "cucumber-expression", normalized_expression(matcher)).otherwise(collapse(nfkc(matcher)))


def event_kind(event: Column) -> Column:
    """Method, call, assert, deferred-assert, control or other."""
    control = event.isin("if", "loop", "switch", "try", "return", "throw", "await", "yield")
    named = F.when(event.startswith("method:"), "method").when(event.startswith("call:"), "call").when(event.startswith("deferred-assert:"), "deferred-assert").when(event.startswith("assert:"), "assert")
    return named.when(control, "control").otherwise("other")


def run_events(events: Column) -> Column:
    """What the handler does, without how it is declared."""
    return F.filter(F.coalesce(events, F.array().cast("array<string>")), lambda e: ~e.startswith("method:"))


def deferred_events(events: Column) -> Column:
    return F.filter(F.coalesce(events, F.array().cast("array<string>")), lambda e: e.startswith("deferred-assert:"))


def anchors(events: Column) -> Column:
    """Calls and deferred assertions as they are, other assertions without their last part; sorted, each once."""
    kept = F.filter(F.coalesce(events, F.array().cast("array<string>")), lambda e: e.startswith("call:") | e.startswith("deferred-assert:") | e.startswith("assert:"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda e: F.when(e.startswith("assert:"), F.regexp_replace(e, r":[^:]*$", "")).otherwise(e))))


def behavior_identity(events: Column, stream: Column, scope: Column) -> Column:
    """P10: equal for handlers whose observable behaviour is the same."""
    return F.to_json(F.struct(F.coalesce(events, F.array().cast("array<string>")).alias("e"), stream.alias("s"), scope.isNull().alias("n"), F.coalesce(scope, F.lit("")).alias("c")))


def fingerprint(value: Column) -> Column:
    """128 bits of a domain-separated digest."""
    return F.substring(F.sha2(F.concat(F.lit(SINGLE), F.encode(value, "UTF-8")), 256), 1, 32)


def fingerprint_parts(*parts: Column) -> Column:
    """The same over several parts, each preceded by its length in bytes, so boundaries count."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), F.encode(p, "UTF-8")) for p in parts]
    return F.substring(F.sha2(F.concat(F.lit(PARTS), *framed), 256), 1, 32)


def fingerprint_list(name: str, rule: Column, parts: Column) -> Column:
    """P12 over a list, sorted."""
    frame = lambda p: F.concat(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0"), F.hex(F.encode(p, "UTF-8")))
    listed = F.array_join(F.transform(F.array_sort(parts), frame), "")
    return F.substring(F.sha2(F.unhex(F.concat(F.hex(F.lit(PARTS)), frame(F.lit(name)), frame(rule), listed)), 256), 1, 32)


def definition_fingerprint(kind: Column, normalized: Column, flags: Column, alpha: Column) -> Column:
    """What a definition means, wherever it stands."""
    return fingerprint_parts(F.lit("definition"), kind, normalized, F.coalesce(flags, F.lit("")), F.coalesce(alpha, F.lit("")))


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def is_stub_label(text: Column) -> Column:
    """A name that says that nothing is done yet."""
    return F.lower(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]", "")).isin("pending", "notimplemented", "todo")


def shingles(text: Column, width: int = 3) -> Column:
    """V7: distinct character trigrams in lower case, runs of digits being one ``0``; a shorter text is its own key."""
    folded = F.regexp_replace(F.lower(text), r"\p{N}+", "0")
    grams = F.transform(F.sequence(F.lit(1), F.length(folded) - (width - 1)), lambda i: F.substring(folded, i, F.lit(width)))
    return F.when(F.length(folded) >= width, F.array_distinct(grams)).when(F.length(folded) > 0, F.array(folded)).otherwise(F.array().cast("array<string>"))


def bounded_snippet(text: Column, limit: int = 400) -> Column:
    """At most ``limit`` characters of source."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def round_score(score: Column) -> Column:
    """Three decimals, halves away from zero."""
    return F.floor(score * 1000 + 0.5) / 1000


def display(location: Column) -> Column:
    """P28."""
    return F.concat_ws(":", location["path"], location["line"], location["column"])


def sanitized(text: Column) -> Column:
    """Without control, bidirectional, invisible and tag characters."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\u00AD\\u061C\\u180E\\u200B-\\u200F\\u2028-\\u202E\\u2060-\\u206F\\uFEFF\\uFFF9-\\uFFFB\\x{E0000}-\\x{E007F}]", "")


def _whole(raw: Column, at: Column, step: int) -> Column:
    """``at``, or the next position by ``step`` where no UTF-8 character is cut: position ``at`` begins one."""
    inside = lambda k: F.hex(F.substring(raw, at + k * step, F.lit(1))).rlike("^[89AB]")
    return F.when(~inside(0), at).when(~inside(1), at + step).when(~inside(2), at + 2 * step).otherwise(at + 3 * step)


def sampled(text: Column, limit: int = 8192) -> Column:
    """A text beyond ``limit`` bytes as its beginning and its end, whole characters of at most half of that each.

    Between them stand the number of bytes left out and the digest of the whole, so that equal samples mean equal texts.
    """
    raw, half = F.encode(text, "UTF-8"), limit // 2
    first = _whole(raw, F.lit(half + 1), -1)
    last = _whole(raw, F.length(raw) - half + 1, 1)
    head, tail = F.decode(F.substring(raw, F.lit(1), first - 1), "UTF-8"), F.decode(F.substring(raw, last, F.length(raw)), "UTF-8")
    mark = F.concat(F.lit(" … ["), (last - first).cast("string"), F.lit(" bytes, "), fingerprint(text), F.lit("] … "))
    return F.when(F.octet_length(text) > limit, F.concat(head, mark, tail)).otherwise(text)


def substituted(template: Column, values: Column) -> Column:
    """P25: ``<name>`` by the map's value in one pass; unknown names and stray angles stay, values are not scanned again."""
    pieces = F.regexp_extract_all(template, F.lit(r"(?s)(<[^<>]*>|<|[^<]+)"), F.lit(1))
    known = lambda p: F.element_at(values, F.substring(p, F.lit(2), F.length(p) - 2))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("<") & p.endswith(">") & (F.length(p) > 1), F.coalesce(known(p), p)).otherwise(p)), "")


def matcher_diff(left: Column, right: Column) -> Column:
    """struct(prefix, left, right, suffix) of two matchers."""
    shorter = F.least(F.length(left), F.length(right))
    same = lambda limit, at: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), limit), at)) - 1, limit)
    prefix = F.when(shorter > 0, same(shorter, lambda i: F.substring(left, i, F.lit(1)) != F.substring(right, i, F.lit(1)))).otherwise(0)
    rest = shorter - prefix
    suffix = F.when(rest > 0, same(rest, lambda i: F.substring(left, F.length(left) - i + 1, F.lit(1)) != F.substring(right, F.length(right) - i + 1, F.lit(1)))).otherwise(0)
    cut = lambda text: F.substring(text, prefix + 1, F.length(text) - prefix - suffix)
    return F.struct(F.substring(left, F.lit(1), prefix).alias("prefix"), cut(left).alias("left"), cut(right).alias("right"), F.substring(left, F.length(left) - suffix + 1, suffix).alias("suffix"))
