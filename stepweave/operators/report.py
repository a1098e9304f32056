"""Sinks: JSON, JSON lines, SARIF, text and HTML reports, fingerprint and pair listings, baselines.

Reports are bounded (``MAX_FINDINGS``, ``MAX_BYTES``), so they are rendered from at most that many rows on the driver. Listings
of everything are written by Spark.
"""

from __future__ import annotations

import html
import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions import keys
from stepweave.model import MESSAGES, RULES
from stepweave.operators import modes
from stepweave.plans.analyze import Result

MAX_FINDINGS, MAX_BYTES, MAX_MEMBERS, MAX_TEXT = 10_000, 16 << 20, 256, 2000
BASELINE_VERSION, MAX_BASELINE = 1, 1_000_000
SARIF = "2.1.0"


def priority():
    """Active errors, other active ones, suppressed errors, the rest."""
    error = F.col("severity") == "error"
    return F.when(modes.active() & error, 0).when(modes.active(), 1).when(error, 2).otherwise(3)


def located(findings: DataFrame, definitions: DataFrame) -> DataFrame:
    """Add locations of the members, at most MAX_MEMBERS of them (K11), and n_members."""
    cut = findings.withColumn("n_members", F.size("members")).withColumn("shown", F.slice("members", 1, MAX_MEMBERS))
    places = definitions.select("def_id", "location", "matcher")
    rows = cut.select("seq", F.posexplode("shown").alias("k", "def_id")).join(places, "def_id")
    gathered = rows.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("k", "location", "matcher"))).alias("where"))
    return cut.join(gathered, "seq", "left").drop("shown")


def top(findings: DataFrame, definitions: DataFrame, only_active: bool = False, most: int = MAX_FINDINGS) -> list[dict]:
    """The findings that a report shows, in their own order; a greedy byte budget is kept on at most ``most`` rows."""
    rows = findings.where(modes.active()) if only_active else findings
    first = rows.withColumn("priority", priority()).orderBy("priority", "seq").limit(most)
    out, left = [], MAX_BYTES
    for r in sorted(located(first, definitions).collect(), key=lambda r: (r["priority"], r["seq"])):
        item = shown(r.asDict(recursive=True))
        size = len(json.dumps(item))
        if size <= left:
            left -= size
            out.append(item)
    return sorted(out, key=lambda x: x["seq"])


def shown(row: dict) -> dict:
    where = [w["location"] for w in row.get("where") or []]
    out = {"seq": row["seq"], "rule": row["rule"], "severity": row["severity"], "message": row["message"], "action": row["action"], "fingerprint": row["fingerprint"], "primary": where[0] if where else None, "related": where[1:], "matchers": [w["matcher"] for w in row.get("where") or []]}
    out |= {"matcherSimilarity": row["score"], "handlerSimilarity": row["handler_score"], "truncated": row["n_members"] > MAX_MEMBERS}
    return out | ({"suppression": {"reason": row["reason"]}} if row["reason"] is not None else {})


def json_report(result: Result, threshold: float = 0.0) -> dict:
    """K1."""
    share = modes.duplication_threshold(result.findings, result.definitions, threshold).first().asDict()
    counts = modes.summary(result.findings).first().asDict()
    listed = top(result.findings, result.definitions)
    total = result.findings.count()
    census = {r["owner"]: {"evaluated": r["evaluated"], "skipped": r["skipped"]} for r in result.census.collect()}
    return {"schemaVersion": 1, "summary": counts | {"duplication": share}, "analysis": {"candidates": census, "incomplete": result.incomplete}, "findings": listed, "findingsTruncated": total - len(listed)}


def jsonl_rows(result: Result) -> DataFrame:
    """K2: one JSON line per finding in finding order, then one summary line; long texts are cut and named."""
    text = lambda c: F.when(F.length(c) > MAX_TEXT, F.substring(c, 1, MAX_TEXT)).otherwise(F.col(c)).alias(c)
    cut = F.filter(F.array(*[F.when(F.length(c) > MAX_TEXT, F.lit(c)) for c in ("message", "action", "reason")]), lambda x: x.isNotNull()).alias("truncatedFields")
    rows = result.findings.select("seq", F.to_json(F.struct(F.lit("finding").alias("type"), "rule", "severity", F.slice("members", 1, MAX_MEMBERS).alias("members"), "score", "handler_score", "fingerprint", text("message"), text("action"), text("reason"), cut)).alias("line"))
    end = modes.summary(result.findings).select(F.lit((1 << 62)).cast("bigint").alias("seq"), F.to_json(F.struct(F.lit("summary").alias("type"), "errors", "warnings", "suppressed", "by_rule")).alias("line"))
    return rows.unionByName(end)


def write_jsonl(result: Result, path: str) -> None:
    jsonl_rows(result).repartitionByRange("seq").sortWithinPartitions("seq").select("line").write.text(path)


def artifact_uri(path: str) -> str:
    """K4: the path as a relative URI reference; only what RFC 3986 leaves unreserved stays as it is."""
    free = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~/")
    return "".join(chr(b) if b in free else f"%{b:02X}" for b in path.replace(os.sep, "/").encode())


def _region(place: dict) -> dict:
    region = dict(zip(("startLine", "startColumn", "endLine", "endColumn"), (place[k] for k in ("line", "column", "end_line", "end_column"))))
    return {"physicalLocation": dict(artifactLocation=dict(uri=artifact_uri(place["path"])), region=region)}


def sarif(result: Result) -> dict:
    """Active findings only."""
    results = []
    for f in top(result.findings, result.definitions, only_active=True):
        related = [_region(p) | {"id": k} for k, p in enumerate(f["related"])]
        results.append({"ruleId": f["rule"], "level": f["severity"], "message": {"text": sanitize(f["message"])}, "locations": [_region(f["primary"])] if f["primary"] else [], "relatedLocations": related, "partialFingerprints": {"stepweave/v1": f["fingerprint"]}})
    rules = [{"id": name, "shortDescription": {"text": MESSAGES[name][0]}, "defaultConfiguration": {"level": level}} for name, level, *_ in RULES]
    return {"version": SARIF, "$schema": f"https://json.schemastore.org/sarif-{SARIF}.json", "runs": [{"tool": {"driver": {"name": "stepweave", "rules": rules}}, "results": results}]}


def sanitize(text: str) -> str:
    """K12 on the driver's side."""
    return "".join(c for c in text if c in "\t\n" or not (ord(c) < 32 or 0x7F <= ord(c) <= 0x9F or c in "­؜᠎﻿" or 0x200B <= ord(c) <= 0x200F or 0x2028 <= ord(c) <= 0x202E or 0x2060 <= ord(c) <= 0x206F or 0xE0000 <= ord(c) <= 0xE007F))


def text_report(result: Result, color: bool = False) -> Iterator[str]:
    """K5: by rule, in rule order."""
    paint = {"error": "\033[31m", "warning": "\033[33m"} if color else {}
    listed = top(result.findings, result.definitions, only_active=True)
    for rule, *_ in RULES:
        own = [f for f in listed if f["rule"] == rule]
        if own:
            yield f"{rule} ({len(own)})"
        for f in own:
            at = f["primary"] or {"path": "?", "line": 0, "column": 0}
            yield f"  {paint.get(f['severity'], '')}{f['severity']}{chr(27) + '[0m' if color else ''} {sanitize(at['path'])}:{at['line']}:{at['column']} {sanitize(f['message'])}"
            for p in f["related"]:
                yield f"    also {sanitize(p['path'])}:{p['line']}:{p['column']}"
    for reason in result.incomplete:
        yield f"incomplete: {reason}"


def html_report(result: Result) -> str:
    """K6: one page without outside references."""
    rows = []
    for f in top(result.findings, result.definitions):
        places = "<br>".join(html.escape(f"{p['path']}:{p['line']}:{p['column']}") for p in [f["primary"], *f["related"]] if p)
        matchers = "<br>".join(html.escape(sanitize(m or "")) for m in f["matchers"])
        rows.append(f"<tr class='{f['severity']}'><td>{f['rule']}</td><td>{html.escape(sanitize(f['message']))}</td><td>{places}</td><td><code>{matchers}</code></td><td>{html.escape((f.get('suppression') or {}).get('reason', ''))}</td></tr>")
    head = "<tr><th>Rule</th><th>Finding</th><th>Where</th><th>Matchers</th><th>Suppressed</th></tr>"
    return f"<!doctype html><meta charset='utf-8'><title>Step report</title><style>body{{font:14px sans-serif}}td{{padding:4px;border-top:1px solid #ccc;vertical-align:top}}.error td:first-child{{color:#b00}}</style><h1>Step report</h1><table>{head}{''.join(rows)}</table>"


def fingerprint_rows(definitions: DataFrame) -> DataFrame:
    """K7: one row per definition with the digests of everything that is compared."""
    digest = lambda c: keys.fingerprint(F.coalesce(c, F.lit(""))).alias(c)
    meaning = keys.definition_fingerprint(F.col("matcher_kind"), F.col("normalized_matcher"), F.col("matcher_flags"), F.col("h_alpha"))
    return definitions.select("def_id", keys.display(F.col("location")).alias("at"), "matcher_kind", *[digest(c) for c in ("normalized_matcher", "h_exact", "h_normalized", "h_alpha", "h_structural")], keys.fingerprint(F.to_json("events")).alias("behavior"), meaning.alias("fingerprint"))


def replace_file(path: str, text: str) -> None:
    """A new file takes the old one's place at once; links are not followed."""
    target = Path(path)
    if any(p.is_symlink() for p in (target, *target.parents)):
        raise ValueError(f"{path} leads through a link")
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w") as f:
        f.write(text)
    os.replace(name, target)


def write_baseline(result: Result, path: str) -> None:
    """K9: counts by fingerprint, sorted; refused for an incomplete result, or beyond MAX_BASELINE of them.

    The file is one JSON object, so it is made in one place; ``modes.baseline_counts`` as a table has no such limit.
    """
    if result.incomplete:
        raise ValueError("an incomplete result is no baseline")
    rows = modes.baseline_counts(result.findings).limit(MAX_BASELINE + 1).collect()
    if len(rows) > MAX_BASELINE:
        raise ValueError(f"more than {MAX_BASELINE} fingerprints: write baseline_counts as a table")
    counts = {r["fingerprint"]: r["n"] for r in rows}
    replace_file(path, json.dumps({"schemaVersion": BASELINE_VERSION, "fingerprints": dict(sorted(counts.items()))}, indent=1))


def read_baseline(spark, path: str, update: bool = False) -> DataFrame:
    """Fingerprint, n. Other schema versions are refused; older ones may be replaced."""
    raw = json.loads(Path(path).read_text())
    version = raw.get("schemaVersion")
    if not isinstance(version, int) or version > BASELINE_VERSION or (version < BASELINE_VERSION and not update):
        raise ValueError(f"baseline schema {version} is not supported")
    return spark.createDataFrame([(k, int(v)) for k, v in raw["fingerprints"].items()], "fingerprint string, n bigint")


def write_reports(result: Result, kinds: list[str], output: str, threshold: float = 0.0) -> list[str]:
    """Write each kind once (A18) below ``output``."""
    out = []
    for kind in dict.fromkeys(kinds):
        path = f"{output}/report.{ {'sarif': 'sarif', 'jsonl': 'jsonl', 'html': 'html', 'json': 'json', 'terminal': 'txt'}[kind] }"
        if kind == "jsonl":
            write_jsonl(result, path)
        else:
            text = {"json": lambda: json.dumps(json_report(result, threshold), indent=1), "sarif": lambda: json.dumps(sarif(result), indent=1), "html": lambda: html_report(result), "terminal": lambda: "\n".join(text_report(result)) + "\n"}[kind]()
            replace_file(path, text)
        out.append(path)
    return out
