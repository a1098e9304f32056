"""Finding and reading source files: globs, ignore files, budgets, generated content, configuration.

Listing and ignore rules work on paths on the driver, bounded by the entry budget; contents are read by executors.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.model import RULE_RANK, SEVERITIES, Config
from stepweave.operators.modes import glob_regex
from stepweave.sources.code import ADAPTERS, JS_SUFFIXES, NAMES

EXCLUDED = [f"**/{name}/**" for name in "build coverage dist node_modules vendor .git".split()]
IGNORE_FILES = (".stepweaveignore", ".ignore", ".gitignore")
MAX_ENTRIES, MAX_FILES, MAX_FILE_BYTES = 1_000_000, 100_000, 512 << 20
PREFIX = 65536
CONFIG_FILES = ("stepweave.config.json", ".stepweaverc.json")


class BudgetExceeded(RuntimeError):
    """A partial set of files would be no answer."""


@dataclass
class Found:
    definitions: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    unmatched: list[str] = field(default_factory=list)


def ignore_rules(folder: Path) -> list[tuple[str, re.Pattern, bool, bool]]:
    """(folder, pattern, negated, folders only) of a folder's ignore files, weakest first."""
    out = []
    for name in reversed(IGNORE_FILES):
        file = folder / name
        if not file.is_file():
            continue
        for line in file.read_text(errors="replace").splitlines():
            text = line.rstrip()
            if not text or text.startswith("#"):
                continue
            negated, text = text.startswith("!"), text.removeprefix("!")
            only, text = text.endswith("/"), text.rstrip("/")
            anchored = "/" in text
            body = "".join("(?:.*/)?" if p == "**/" else ".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", text.lstrip("/")))
            out.append((str(folder), re.compile(f"^{'' if anchored else '(?:.*/)?'}{body}$"), negated, only))
    return out


def ignored(path: Path, is_dir: bool, rules: list) -> bool:
    """The last rule that fits decides."""
    verdict = False
    for base, pattern, negated, only in rules:
        if (is_dir or not only) and pattern.match(os.path.relpath(path, base)):
            verdict = not negated
    return verdict


def names_suffix(pattern: str, suffix: str) -> bool:
    """S3: does the glob itself ask for the suffix?"""
    return re.match(glob_regex(pattern), "x/y.unlikely") is None and re.match(glob_regex(pattern), f"x/y{suffix}") is not None


def discover(root: str, config: Config | None = None, max_entries: int = MAX_ENTRIES) -> Found:
    """Definition and feature files below ``root``, sorted; symbolic links are not followed."""
    config = config or Config()
    exclude = [re.compile(glob_regex(p)) for p in [*(EXCLUDED if config.exclude_defaults else []), *config.exclude]]
    wanted = config.definitions or ["**/*" + s for s in JS_SUFFIXES]
    features = config.features
    if features == Config().features and (named := framework_features(root)):
        features = named
    globs = {p: re.compile(glob_regex(p.removeprefix("./"))) for p in [*wanted, *features]}
    opted = [s for s in ADAPTERS if s in JS_SUFFIXES or any(names_suffix(p, s) for p in wanted)]
    out, entries, hit = Found(), 0, set()

    def walk(folder: Path, rules: list) -> None:
        nonlocal entries
        rules = rules + ignore_rules(folder)
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            entries += 1
            if entries > max_entries:
                raise BudgetExceeded(f"more than {max_entries} entries below {root}")
            path, is_dir = Path(entry.path), entry.is_dir(follow_symlinks=False)
            rel = os.path.relpath(path, root)
            if entry.is_symlink() or (entry.name.startswith(".") and not config.include_hidden) or ignored(path, is_dir, rules) or any(x.match(rel) or (is_dir and x.match(rel + "/")) for x in exclude):
                continue
            if is_dir:
                walk(path, rules)
                continue
            feature = [p for p in features if globs[p].match(rel)]
            definition = [p for p in wanted if globs[p].match(rel) and any(rel.endswith(s) for s in opted)]
            hit.update(feature, definition)
            (out.features if feature else out.definitions if definition else []).append(str(path))

    walk(Path(root), [])
    if len(out.features) + len(out.definitions) > MAX_FILES:
        raise BudgetExceeded(f"more than {MAX_FILES} files")
    out.unmatched = [p for p in [*config.definitions, *features] if p not in hit]
    return out


def read_files(spark: SparkSession, paths: list[str], most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Path, content (null unless UTF-8), raw; contents are read on executors."""
    if not paths:
        return spark.createDataFrame([], "path string, content string, raw binary")
    files = spark.read.format("binaryFile").load(paths)
    total = files.agg(F.sum("length")).first()[0] or 0
    if total > most_bytes:
        raise BudgetExceeded(f"{total} bytes of sources")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select(F.regexp_replace("path", "^file:", "").alias("path"), text.alias("content"), F.col("content").alias("raw"))


def exclusion(raw: Column, registrations: list[str] = sorted(NAMES)) -> Column:
    """Compressed, binary, minified or null, from the first 64 KiB."""
    head = F.substring(raw, 1, PREFIX)
    magic = F.hex(F.substring(raw, 1, 4))
    text = head.cast("string")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    mean = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x)) / F.greatest(F.size(lines), F.lit(1))
    registers = text.rlike(r"\b(?:" + "|".join(map(re.escape, registrations)) + r")\s*\(")
    compressed = magic.startswith("1F8B") | magic.startswith("504B0304") | magic.startswith("28B52FFD") | magic.startswith("425A68")
    return F.when(compressed, "compressed").when(F.instr(F.hex(head), "00") > 0, F.when(F.exists(F.sequence(F.lit(1), F.length(F.hex(head)) - 1, F.lit(2)), lambda k: F.substring(F.hex(head), k, F.lit(2)) == "00"), "binary").otherwise(F.when((mean > 200) & ~registers, "minified"))).when((mean > 200) & ~registers, "minified")


def merged_config(*layers: dict) -> Config:
    """Later layers win; collections are replaced, rules merge by name; unknown keys are errors."""
    known = {f.name for f in fields(Config)}
    out: dict = {}
    rules = dict(Config().rules)
    for layer in layers:
        if unknown := set(layer) - known:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        for key, value in layer.items():
            if key == "rules":
                for rule, severity in value.items():
                    if rule not in RULE_RANK or severity not in SEVERITIES:
                        raise ValueError(f"{rule}={severity} is no rule with a severity")
                    rules[rule] = severity
            else:
                out[key] = value
    config = Config(rules=rules, **out)
    if not 0 <= config.near_duplicate_handler_similarity <= 1 or not config.threshold >= 0:
        raise ValueError("similarity is from 0 to 1, the threshold not negative")
    return config


def config_layer(root: str, explicit: str | None = None) -> dict:
    """An explicit file, else the first one found in ``root``; it must lie inside."""
    names = [Path(explicit)] if explicit else [Path(root) / n for n in CONFIG_FILES]
    for path in names:
        if path.is_file():
            if not explicit and not path.resolve().is_relative_to(Path(root).resolve()):
                raise ValueError(f"{path} leads out of {root}")
            return json.loads(path.read_text())
    return {}


def framework_features(root: str) -> list[str] | None:
    """Feature globs of the first framework configured in ``root``: Playwright-BDD, Cypress, Cucumber.js."""
    base = Path(root)
    for names, key in ((("playwright.config.ts", "playwright.config.js"), "features"), (("cypress.config.ts", "cypress.config.js"), "specPattern"), (("cucumber.json", "cucumber.js", "cucumber.mjs"), "paths")):
        for name in names:
            if (base / name).is_file() and (m := re.search(rf"[\"']?{key}[\"']?\s*:\s*(\[[^\]]*\]|[\"'][^\"']+[\"'])", (base / name).read_text(errors="replace"))):
                return re.findall(r"[\"']([^\"']+)[\"']", m[1])
    return None
