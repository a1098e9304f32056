"""Step definitions from JavaScript, TypeScript and Ruby sources, by tokens.

No full parser: a tokenizer that knows strings, templates, regular expressions and comments, and on its tokens the
registrations that can be told for sure. What can't be told is never guessed: the definition is marked not comparable, or
reported as a diagnostic, so that it proves nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.model import DEFINITIONS
from stepweave.plans.durable import durable

NAMES = set("And But Given Step Then When defineStep".split())
MODULES = {"@cucumber/cucumber": "cucumber", "cucumber": "cucumber", "@badeball/cypress-cucumber-preprocessor": "cypress", "cypress-cucumber-preprocessor/steps": "cypress", "playwright-bdd": "playwright-bdd", "playwright-bdd/decorators": "playwright-bdd", "jest-cucumber": "jest", "@amiceli/vitest-cucumber": "vitest"}
JS_SUFFIXES = tuple(f".{kind}" for kind in "ts tsx js jsx mts mjs cts cjs".split())
RUBY_SUFFIXES = (".rb",)
CONTROL = {"if": "if", "for": "loop", "while": "loop", "switch": "switch", "try": "try", "return": "return", "throw": "throw", "await": "await"}
KEYWORDS = set("if else for while do switch case break continue return throw try catch finally await async function const let var new typeof instanceof in of this null true false undefined class extends super import export from as yield delete void".split())
TOKEN = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`(?:\\.|[^`\\])*`)|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<punct>=>|\?\.|\.\.\.|[-+*/%=<>!&|^?:]+=|&&|\|\||\?\?|[-+*%<>=!&|^~?:;,.(){}\[\]@#/\\])""", re.S)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(source: str) -> list[Token]:
    """Tokens without white space and comments; a slash where no operand precedes it begins a regular expression."""
    out: list[Token] = []
    at = 0
    while at < len(source):
        last = out[-1] if out else None
        operand = last and (last.kind in ("string", "template", "number", "regex") or (last.kind == "name" and last.text not in KEYWORDS - {"this", "null", "true", "false", "super"}) or last.text in (")", "]", "}"))
        if source[at] == "/" and not operand and (m := REGEX.match(source, at)):
            out.append(Token("regex", m[0], at))
        elif m := TOKEN.match(source, at):
            if m.lastgroup not in ("space", "comment"):
                out.append(Token(m.lastgroup, m[0], at))
        else:
            out.append(Token("punct", source[at], at))
            at += 1
            continue
        at = m.end()
    return out


def decoded(literal: str) -> str | None:
    """The value of a string or of a template without substitutions."""
    if literal[0] == "`" and re.search(r"(?<!\\)\$\{", literal):
        return None

    if re.search(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9A-Fa-f]{2})|u(?!\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{4}))", literal):
        return None  # no string at all

    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "ux" and len(c) > 1:
            return chr(int(c[1:].strip("{}"), 16))
        return ESCAPES.get(c, c)

    return re.sub(r"\\(u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)", one, literal[1:-1], flags=re.S)


def closing(ts: list[Token], at: int) -> int:
    """The index of the bracket that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(ts)):
        if ts[k].text in ("(", "[", "{"):
            depth += 1
        elif ts[k].text in (")", "]", "}"):
            depth -= 1
            if not depth:
                return k
    return -1


def arguments(ts: list[Token], at: int, end: int) -> list[tuple[int, int]]:
    """Token ranges of the arguments between the brackets at ``at`` and ``end``."""
    out, start, k = [], at + 1, at + 1
    while k <= end:
        if ts[k].text in ("(", "[", "{") and k != end:
            k = closing(ts, k)
        elif ts[k].text == "," or k == end:
            if k > start:
                out.append((start, k))
            start = k + 1
        k += 1
    return out


def is_function(ts: list[Token]) -> bool:
    texts = [t.text for t in ts[:3]]
    return "function" in texts[:2] or (any(t.text == "=>" for t in ts) and (texts[0] in ("(", "async") or texts[1:2] == ["=>"]))


def parameters(ts: list[Token]) -> list[str]:
    if len(ts) > 1 and ts[0].kind == "name" and ts[1].text == "=>":
        return [ts[0].text]
    start = next((k for k, t in enumerate(ts) if t.text == "("), None)
    if start is None:
        return []
    return [t.text for t in ts[start : closing(ts, start)] if t.kind == "name" and t.text not in KEYWORDS]


def handler(ts: list[Token]) -> dict:
    """Comparison forms, events and eligibility of a function's tokens."""
    own = [*parameters(ts)]
    for k, t in enumerate(ts[:-1]):
        if t.text in ("const", "let", "var") and ts[k + 1].kind == "name":
            own.append(ts[k + 1].text)
    names = {n: f"${k}" for k, n in enumerate(dict.fromkeys(own))}
    plain = [t.text for t in ts if t.text != ";"]
    member = lambda k: k > 0 and ts[k - 1].text in (".", "?.")
    alpha = [names.get(t.text, t.text) if t.kind == "name" and not member(k) else t.text for k, t in enumerate(ts) if t.text != ";"]
    value = {"string", "template", "number", "regex"}
    structural = ["#" if t.kind in value else names.get(t.text, t.text) if t.kind == "name" and not member(k) else t.text for k, t in enumerate(ts) if t.text != ";"]
    body = next((k + 1 for k, t in enumerate(ts) if t.text == "=>"), next((k for k, t in enumerate(ts) if t.text == "{"), 0))
    events = []
    k = body
    while k < len(ts):
        t = ts[k]
        if t.text in CONTROL:
            events.append(CONTROL[t.text])
        elif t.kind == "name" and k + 1 < len(ts) and ts[k + 1].text == "(" and t.text not in KEYWORDS:
            head = k
            while head >= 2 and ts[head - 1].text in (".", "?.") and ts[head - 2].kind == "name":
                head -= 2
            name = ".".join(names.get(x.text, x.text) if n == 0 else x.text for n, x in enumerate(ts[head : k + 1 : 2]))
            end = closing(ts, k + 1)
            text = "".join(names.get(x.text, x.text) if x.kind == "name" else x.text for x in ts[k + 2 : end])
            if name in ("expect", "assert") and end > 0:
                chain, j = [], end + 1
                while j + 1 < len(ts) and ts[j].text == "." and ts[j + 1].kind == "name":
                    chain.append(ts[j + 1].text)
                    j += 2
                wanted = "".join(names.get(x.text, x.text) for x in ts[j + 1 : closing(ts, j)]) if j < len(ts) and ts[j].text == "(" else ""
                digest = lambda s: f"{pd.util.hash_array(pd.Series([s], dtype=object).to_numpy())[0]:016x}"
                events.append(f"assert:{'.'.join(chain[:-1])}#{chain[-1] if chain else ''}:{digest(text)}:{digest(wanted)}")
                k = j
            elif not (head >= 1 and ts[head - 1].text == ")"):
                events.append(f"call:{name}")
        k += 1
    inner = [t.text for t in ts[body:] if t.text not in ("{", "}", ";")]
    label = re.sub(r"[\W_]", "", "".join(x.strip("'\"`") for x in inner if x not in ("return", "throw", "new", "Error", "(", ")"))).lower()
    return {"h_exact": " ".join(t.text for t in ts), "h_normalized": " ".join(plain), "h_alpha": " ".join(alpha), "h_structural": " ".join(structural), "events": events, "trivial": not inner or label in ("pending", "notimplemented", "todo"), "comparable": True}


def place(source: str, at: int) -> tuple[int, int]:
    """Line and column, both from one."""
    return source.count("\n", 0, at) + 1, at - (source.rfind("\n", 0, at) + 1) + 1


def suppressions(lines: list[str], line: int, mark: str) -> list[dict]:
    """X11: comments right above a registration that name a rule and a reason."""
    out, k = [], line - 2
    while k >= 0 and (m := re.match(rf"^\s*{mark}\s*(.*)$", lines[k])):
        if own := re.match(r"stepweave-ignore\s+([a-z-]+)\s*(?:--|:)\s*(\S.*)$", m[1]):
            out.insert(0, {"rule": own[1], "reason": own[2].strip()[:512]})
        k -= 1
    return out


def bindings(ts: list[Token]) -> tuple[dict[str, tuple[str, str]], str]:
    """X1, X2, FE7: local names of registrations as (registration, framework), and the file's framework."""
    found: dict[str, tuple[str, str]] = {}
    spaces: dict[str, str] = {}
    framework = "unknown"
    for k, t in enumerate(ts):
        value = decoded(t.text) if t.kind == "string" else None
        local = value is not None and value.startswith((".", "~/", "@/")) and k > 0 and ts[k - 1].text in ("from", "(")
        if value not in MODULES and not local:
            continue
        own = MODULES.get(value, "unknown")  # registrations handed on by a module of the project
        framework = framework if own == "unknown" else own if framework in ("unknown", own) else "unknown"
        start = k
        while start > 0 and ts[start].text not in ("import", "const", "let", "var", ";"):
            start -= 1
        part = ts[start + 1 : k]
        at = 0
        while at < len(part):
            x = part[at]
            if x.kind == "name" and x.text in NAMES | {"createBdd"}:
                alias = part[at + 2].text if at + 2 < len(part) and part[at + 1].text in ("as", ":") else x.text
                found[alias] = (x.text, own)
                at += 2 if alias != x.text else 0
            elif x.text == "*" and not local and at + 2 < len(part) and part[at + 1].text == "as":
                spaces[part[at + 2].text] = own
            elif at == 0 and not local and x.kind == "name" and x.text not in ("from", "require", "type") and len(part) > 1 and part[1].text in ("=", "from"):
                spaces[x.text] = own
            at += 1
    for k, t in enumerate(ts[:-2]):  # factories: const { Given } = createBdd(..), and plain aliases: const step = Given
        if t.text in ("const", "let", "var") and ts[k + 1].text == "{":
            end = closing(ts, k + 1)
            if end > 0 and end + 2 < len(ts) and ts[end + 1].text == "=" and found.get(ts[end + 2].text, ("",))[0] == "createBdd":
                inner = ts[k + 2 : end]
                for n, x in enumerate(inner):
                    if x.text in NAMES and (n == 0 or inner[n - 1].text == ","):
                        alias = inner[n + 2].text if n + 2 < len(inner) and inner[n + 1].text == ":" else x.text
                        found[alias] = (x.text, "playwright-bdd")
        elif t.text in ("const", "let") and k + 4 < len(ts) and ts[k + 2].text == "=" and ts[k + 3].text in found and ts[k + 4].text != "(":
            found[ts[k + 1].text] = found[ts[k + 3].text]
    for name, own in spaces.items():
        for x in NAMES:
            found[f"{name}.{x}"] = (x, own)
    return {k: v for k, v in found.items() if v[0] != "createBdd"}, framework


def _imported(ts: list[Token], k: int) -> bool:
    """Inside the braces of an import or a destructuring?"""
    start = k
    while start > 0 and ts[start - 1].text in (",", "as", ":") or (start > 0 and ts[start - 1].kind == "name" and ts[start - 1].text not in KEYWORDS):
        start -= 1
    return start > 1 and ts[start - 1].text == "{" and ts[start - 2].text in ("import", "const", "let", "var", "type")


def javascript(path: str, source: str) -> tuple[list[dict], list[str]]:
    """S8, X3, FE1, FE2, FE13: definitions and diagnostics of one file."""
    ts, lines = tokens(source), source.split("\n")
    known, framework = bindings(ts)
    own_names = {ts[k + 1].text for k, t in enumerate(ts[:-1]) if t.text in ("const", "let", "var", "function", "class")} | {t.text for k, t in enumerate(ts) if t.text in NAMES and _imported(ts, k)}
    known = {n: (n, framework) for n in NAMES if n not in own_names} | known  # globals, unless the file has its own
    functions: dict[str, list[Token]] = {}
    for k, t in enumerate(ts[:-2]):
        if t.text == "function" and ts[k + 1].kind == "name":
            body = next((j for j in range(k, len(ts)) if ts[j].text == "{"), None)
            if body and (end := closing(ts, body)) > 0:
                functions[ts[k + 1].text] = [t, *ts[k + 2 : end + 1]]
        elif t.text in ("const", "let") and ts[k + 2].text == "=" and ts[k + 1].kind == "name":
            end = k + 3
            while end < len(ts) and ts[end].text != ";" and not (ts[end].text in ("const", "let", "function") and end > k + 3):
                end = (closing(ts, end) if ts[end].text in ("(", "[", "{") else end) + 1
                if end <= 0:
                    break
            if end > 0 and is_function(ts[k + 3 : end]):
                functions[ts[k + 1].text] = ts[k + 3 : end]
    out, said = [], []
    for k, t in enumerate(ts[:-1]):
        if t.kind != "name" or ts[k + 1].text != "(":
            continue
        name = t.text
        if k >= 2 and ts[k - 1].text == "." and ts[k - 2].kind == "name":
            name = f"{ts[k - 2].text}.{t.text}"
        elif k and ts[k - 1].text in (".", "function"):
            continue
        if name not in known:
            continue
        registration, own = known[name]
        end = closing(ts, k + 1)
        args = arguments(ts, k + 1, end) if end > 0 else []
        if not args:
            continue
        first = ts[args[0][0] : args[0][1]]
        line, column = place(source, ts[k - 2].at if "." in name else t.at)
        if len(first) != 1 or first[0].kind not in ("string", "template", "regex") or (value := first[0].text if first[0].kind == "regex" else decoded(first[0].text)) is None:
            said.append(f"{path}:{line}:{column}: the matcher can't be read")
            continue
        decorator = k > 0 and ts[k - 1].text == "@"
        if first[0].kind == "regex":
            cut = value.rindex("/")
            kind, matcher, flags = "regular-expression", value[1:cut], value[cut + 1 :]
        else:
            kind, matcher, flags = ("literal" if own == "jest" else "cucumber-expression"), value, ""
        if decorator:
            start = end + 1
            while start < len(ts) and ts[start].text in ("async", "static", "get", "set", "@") or (start < len(ts) and ts[start - 1].text == "@"):
                start = closing(ts, start + 1) + 1 if ts[start].text in known else start + 1
            body = next((j for j in range(start, len(ts)) if ts[j].text == "{"), None)
            code = ts[start + 1 : closing(ts, body) + 1] if body else []
        else:
            last = ts[args[-1][0] : args[-1][1]] if len(args) > 1 else []
            code = functions.get(last[0].text, last) if len(last) == 1 else last
        shape = handler(code) if code and (decorator or is_function(code)) else {"h_exact": "", "h_normalized": "", "h_alpha": "", "h_structural": "", "events": [], "trivial": False, "comparable": False}
        stop_line, stop_column = place(source, ts[end].at + 1)
        out.append({"matcher": matcher, "matcher_kind": kind, "matcher_flags": flags, "framework": own if own != "unknown" else framework, "registration": registration, "snippet": source[t.at : ts[end].at + 1][:400], "effect_stream": "complete", "capture_scope": None, "location": {"path": path, "line": line, "column": column, "end_line": stop_line, "end_column": stop_column}, "inline_suppressions": suppressions(lines, line, "//"), **shape})
    return out, said


RUBY = re.compile(r"""^(?P<indent>[ \t]*)(?P<word>Given|When|Then|And|But)[ \t]*\(?[ \t]*(?:/(?P<regex>(?:\\.|[^/\\\n])+)/(?P<flags>[imx]*)|'(?P<single>(?:\\.|[^'\\\n])*)'|"(?P<double>(?:\\.|[^"\\\n])*)")[ \t]*\)?[ \t]*(?:do|\{)[ \t]*(?:\|(?P<params>[^|]*)\|)?""", re.M)


def ruby(path: str, source: str) -> tuple[list[dict], list[str]]:
    """Definitions of one file. Handlers compare by their text only: what Ruby code does isn't inferred."""
    out, lines = [], source.split("\n")
    for m in RUBY.finditer(source):
        line, column = place(source, m.start("word"))
        opened = source[m.end() - 1 - len(m["params"] or "") - 2 :].lstrip()[:1] == "{" or "{" in m[0].rsplit("'", 1)[-1].rsplit('"', 1)[-1].rsplit("/", 1)[-1]
        rest = source[m.end() :]
        close = re.search(r"\}" if opened else rf"^{m['indent']}end\b", rest, re.M)
        body = rest[: close.start()] if close else ""
        names = [p.strip() for p in (m["params"] or "").split(",") if p.strip()]
        words = re.findall(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[A-Za-z_]\w*[?!]?|\d[\d.]*|[^\s\w]", re.sub(r"(?m)#(?!\{).*$", "", body))
        alpha = [f"${names.index(w)}" if w in names else w for w in words]
        structural = ["#" if re.match(r"[\"'\d]", w) else w for w in alpha]
        regex = m["regex"]
        text = regex if regex is not None else (m["single"] if m["single"] is not None else m["double"])
        end = m.end() + (close.end() if close else 0)
        out.append({"matcher": text, "matcher_kind": "regular-expression" if regex is not None else "cucumber-expression", "matcher_flags": m["flags"] or "", "framework": "ruby-cucumber", "registration": m["word"], "snippet": source[m.start("word") : end][:400], "effect_stream": "partial", "capture_scope": None, "h_exact": body.strip(), "h_normalized": " ".join(words), "h_alpha": " ".join(alpha), "h_structural": " ".join(structural), "events": [], "trivial": not words or words == ["pending"], "comparable": close is not None, "location": {"path": path, "line": line, "column": column, "end_line": place(source, end)[0], "end_column": place(source, end)[1]}, "inline_suppressions": suppressions(lines, line, "#")})
    return out, []


#: Suffix to adapter; ``register`` adds to it.
ADAPTERS = {**{s: javascript for s in JS_SUFFIXES}, **{s: ruby for s in RUBY_SUFFIXES}}


def register(suffixes: tuple[str, ...], adapter) -> None:
    """Add a source adapter, (path, source) -> (definitions, diagnostics). Suffixes may not be taken."""
    taken = [s for s in suffixes if s in ADAPTERS]
    if taken:
        raise ValueError(f"suffixes {taken} have an adapter")
    ADAPTERS.update({s: adapter for s in suffixes})


def adapter_for(path: str):
    """The adapter of the longest suffix that fits."""
    return next((ADAPTERS[s] for s in sorted(ADAPTERS, key=len, reverse=True) if path.endswith(s)), None)


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions without def_id and normalized_matcher, diagnostics) of ``files`` (path, content string), parsed once."""
    fields = [x for x in field_names() if x not in ("def_id", "normalized_matcher")]
    spark = files.sparkSession
    shape = spark.createDataFrame([], DEFINITIONS).select(*fields, F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("message"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                if content is not None and (adapter := adapter_for(path)):
                    found, said = adapter(path, content)
                    rows += [[*(r[f] for f in fields), path, None] for r in found] + [[*(None for _ in fields), path, m] for m in said]
            yield pd.DataFrame(rows, columns=[*fields, "path", "message"], dtype=object)

    both = durable(files.select("path", "content").mapInPandas(run, shape.schema))
    return both.where("message is null").select(*fields), both.where("message is not null").select("path", "message")


def field_names() -> list[str]:
    return ["def_id", "matcher", "matcher_kind", "matcher_flags", "normalized_matcher", "h_exact", "h_normalized", "h_alpha", "h_structural", "events", "snippet", "comparable", "trivial", "effect_stream", "capture_scope", "framework", "registration", "location", "inline_suppressions"]


def definitions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions as ``analyze`` takes them, diagnostics)."""
    from stepweave.functions.keys import normalized_matcher
    from stepweave.plans.analyze import numbered

    found, said = extracted(files)
    keyed = lambda flags, source: normalized_matcher(F.col("matcher_kind"), F.col("matcher"), F.col("matcher_flags"), flags, source)
    normal = F.when(F.col("framework").startswith("ruby"), keyed("imx", False)).otherwise(keyed("imsuv", True))
    return numbered(found.withColumn("normalized_matcher", normal)).select(*field_names()), said
