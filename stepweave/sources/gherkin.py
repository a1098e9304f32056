"""Gherkin sources: files to template steps and example rows in Arrow batches, outlines expanded by a join.

Parsing is per file; the product of steps and examples is a DataFrame join, so a large examples table is data, not a loop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.keys import substituted

#: Keywords by dialect: feature, background, rule, scenario, outline, examples, steps.
DIALECTS = {
    "en": (["Feature", "Ability", "Business Need"], ["Background"], ["Rule"], ["Scenario", "Example"], ["Scenario Outline", "Scenario Template"], ["Examples", "Scenarios"], [*"Given When Then And But *".split()]),
    "es": (["Característica", "Necesidad del negocio", "Requisito"], ["Antecedentes"], ["Regla", "Regla de negocio"], ["Escenario", "Ejemplo"], ["Esquema del escenario"], ["Ejemplos"], ["Dado", "Dada", "Dados", "Dadas", "Cuando", "Entonces", "Y", "E", "Pero", "*"]),
    "fr": (["Fonctionnalité"], ["Contexte"], ["Règle"], ["Scénario", "Exemple"], ["Plan du scénario", "Plan du Scénario"], ["Exemples"], ["Soit", "Sachant", "Étant donné", "Étant donnée", "Quand", "Lorsque", "Alors", "Donc", "Et", "Mais", "*"]),
    "de": (["Funktionalität", "Funktion"], ["Grundlage", "Hintergrund", "Voraussetzungen"], ["Regel", "Rule"], ["Szenario", "Beispiel"], ["Szenariogrundriss", "Szenarien"], ["Beispiele"], ["Angenommen", "Gegeben sei", "Gegeben seien", "Wenn", "Dann", "Und", "Aber", "*"]),
}
DIALECTS["ja"] = (["機能", "フィーチャ"], ["背景"], ["ルール"], ["シナリオ"], ["シナリオアウトライン", "シナリオテンプレート", "テンプレ", "シナリオテンプレ"], ["例", "サンプル"], ["前提", "もし", "ならば", "かつ", "且つ", "しかし", "ただし", "但し", "*"])


def _dialect(feature: str, background: str, rule: str, scenario: str, outline: str, examples: str, steps: str) -> tuple[list[str], ...]:
    """Keywords from lists parted by ``|``; ``*`` is a step in every dialect."""
    return tuple(x.split("|") for x in (feature, background, rule, scenario, outline, examples, steps + "|*"))


DIALECTS |= {
    "it": _dialect("Funzionalità|Esigenza di business|Abilità", "Contesto", "Regola", "Scenario|Esempio", "Schema dello scenario", "Esempi", "Dato|Data|Dati|Date|Quando|Allora|E|Ma"),
    "pt": _dialect("Funcionalidade|Característica|Caracteristica", "Contexto|Cenário de Fundo|Cenario de Fundo|Fundo", "Regra", "Cenário|Cenario|Exemplo", "Esquema do Cenário|Esquema do Cenario|Delineação do Cenário|Delineacao do Cenario", "Exemplos|Cenários|Cenarios", "Dado|Dada|Dados|Dadas|Quando|Então|Entao|E|Mas"),
    "nl": _dialect("Functionaliteit", "Achtergrond", "Regel|Rule", "Scenario|Voorbeeld", "Abstract Scenario", "Voorbeelden", "Gegeven|Stel|Als|Wanneer|Dan|En|Maar"),
    "pl": _dialect("Właściwość|Funkcja|Aspekt|Potrzeba biznesowa", "Założenia", "Zasada|Reguła", "Scenariusz|Przykład", "Szablon scenariusza", "Przykłady", "Zakładając, że|Zakładając|Mając|Jeżeli|Jeśli|Gdy|Kiedy|Wtedy|Oraz|I|Ale"),
    "ru": _dialect("Функция|Функциональность|Функционал|Свойство", "Предыстория|Контекст", "Правило", "Сценарий|Пример", "Структура сценария|Шаблон сценария", "Примеры", "Допустим|Дано|Пусть|Когда|Если|То|Затем|Тогда|И|К тому же|Также|Но|А|Иначе"),
    "uk": _dialect("Функціонал", "Передумова", "Правило", "Сценарій|Приклад", "Структура сценарію", "Приклади", "Припустимо, що|Припустимо|Нехай|Дано|Якщо|Коли|То|Тоді|І|А також|Та|Але"),
    "sv": _dialect("Egenskap", "Bakgrund", "Regel", "Scenario", "Abstrakt Scenario|Scenariomall", "Exempel", "Givet|När|Så|Och|Men"),
    "da": _dialect("Egenskab", "Baggrund", "Rule", "Scenarie|Eksempel", "Abstrakt Scenario", "Eksempler", "Givet|Når|Så|Og|Men"),
    "no": _dialect("Egenskap", "Bakgrunn", "Regel", "Scenario|Eksempel", "Scenariomal|Abstrakt Scenario", "Eksempler", "Gitt|Når|Så|Og|Men"),
    "fi": _dialect("Ominaisuus", "Tausta", "Rule", "Tapaus", "Tapausaihio", "Tapaukset", "Oletetaan|Kun|Niin|Ja|Mutta"),
    "cs": _dialect("Požadavek", "Pozadí|Kontext", "Pravidlo", "Scénář|Příklad", "Náčrt Scénáře|Osnova scénáře", "Příklady", "Pokud|Za předpokladu|Když|Pak|A také|A|Ale"),
    "tr": _dialect("Özellik", "Geçmiş", "Kural", "Senaryo|Örnek", "Senaryo taslağı", "Örnekler", "Diyelim ki|Eğer ki|O zaman|Ve|Fakat|Ama"),
    "hu": _dialect("Jellemző", "Háttér", "Szabály", "Forgatókönyv|Példa", "Forgatókönyv vázlat", "Példák", "Amennyiben|Adott|Majd|Ha|Amikor|Akkor|És|De"),
    "ro": _dialect("Functionalitate|Funcționalitate|Funcţionalitate", "Context", "Rule", "Scenariu|Exemplu", "Structura scenariu|Structură scenariu", "Exemple", "Date fiind|Dat|Dată|Dați|Daţi|Cand|Când|Atunci|Si|Și|Şi|Dar"),
    "id": _dialect("Fitur", "Dasar|Latar Belakang", "Aturan|Rule", "Skenario", "Skenario konsep|Garis-Besar Skenario", "Contoh|Misal", "Dengan|Diketahui|Diasumsikan|Bila|Jika|Ketika|Maka|Dan|Tapi|Tetapi"),
    "ca": _dialect("Característica|Funcionalitat", "Rerefons|Antecedents", "Rule", "Escenari|Exemple", "Esquema de l'escenari", "Exemples", "Donat|Donada|Atès|Atesa|Quan|Aleshores|Cal|I|Però"),
    "zh-CN": _dialect("功能", "背景", "规则|Rule", "场景|剧本", "场景大纲|剧本大纲", "例子", "假如|假设|假定|当|那么|而且|并且|同时|但是"),
    "zh-TW": _dialect("功能", "背景", "Rule", "場景|劇本", "場景大綱|劇本大綱", "例子", "假如|假設|假定|當|那麼|而且|並且|同時|但是"),
    "ko": _dialect("기능", "배경", "규칙|Rule", "시나리오", "시나리오 개요", "예", "조건|먼저|만일|만약|그러면|그리고|하지만|단"),
}
#: Dialects whose step keywords need no blank after them.
SPACELESS = {"ja", "zh-CN", "zh-TW", "ko"}
MAX_STEPS, MAX_BYTES = 250_000, 64 << 20


class GherkinError(ValueError):
    """The file is no feature; names the line."""


@dataclass
class Scenario:
    steps: list[tuple[str, str, int, int, int]] = field(default_factory=list)  # keyword, text, line, column, end column
    examples: list[list[list[str]]] = field(default_factory=list)  # tables: rows of cells, header first
    runs: bool = True


def cells(line: str, number: int) -> list[str]:
    """A table row's cells; ``\\|``, ``\\n`` and ``\\\\`` are escapes."""
    text = line.strip()
    out, own, at = [], [], 1
    while at < len(text):
        c = text[at]
        if c == "\\" and text[at + 1 : at + 2] in ("|", "n", "\\"):
            own.append({"n": "\n"}.get(text[at + 1], text[at + 1]))
            at += 1
        elif c == "|":
            out.append("".join(own).strip(" \t"))
            own = []
        else:
            own.append(c)
        at += 1
    if "".join(own).strip():
        raise GherkinError(f"line {number}: table row without an end")
    return out


def from_markdown(text: str) -> str:
    """Headings and list items that hold keywords become plain lines; all else blank, so positions in lines stay."""
    out, fence = [], None
    for line in text.split("\n"):
        bare = line.strip()
        if fence or bare.startswith(("```", "~~~")):
            fence = None if fence and bare.startswith(fence) else fence or bare[:3]
            out.append("")
            continue
        heading = re.match(r"^#{1,6}\s+(.*?)\s*#*$", bare)
        item = re.match(r"^(?:[*+-]|\d+[.)])\s+(?:(\*\*|__|\*|_)(\w+)\1)?(.*)$", bare)
        said = (item[2] or "") + item[3] if item else ""
        keywords = DIALECTS["en"]
        if heading and re.match("(?:" + "|".join(k for ks in keywords[:6] for k in ks) + "):", heading[1]):
            out.append(heading[1])
        elif said.startswith(tuple(k + " " for k in keywords[6] if k != "*")):
            out.append(" " * (len(line) - len(line.lstrip()) + 2) + said)
        elif bare.startswith("|") and not re.match(r"^\|(?:\s*:?-+:?\s*\|)+$", bare):
            out.append(line)
        else:
            out.append("")
    return "\n".join(out)


def parse(text: str, markdown: bool = False) -> list[Scenario]:
    """A feature's backgrounds (once each), scenarios and outlines, in order."""
    text = text.removeprefix("\ufeff")
    if markdown:
        text = from_markdown(text)
    lines = text.replace("\r\n", "\n").split("\n")
    if not text.strip():
        return []
    named = next((m[1] for line in lines[:20] if (m := re.match(r"^\s*#\s*language\s*:\s*([A-Za-z-]+)\s*$", line))), "en")
    if named not in DIALECTS:
        raise GherkinError(f"dialect {named} is unknown")
    feature, background, rule, scenario, outline, examples, steps = DIALECTS[named]
    order = sorted(((k, kind) for kind, ks in (("feature", feature), ("background", background), ("rule", rule), ("scenario", scenario), ("outline", outline), ("examples", examples)) for k in ks), key=lambda x: -len(x[0]))
    words = sorted(steps, key=len, reverse=True)
    out: list[Scenario] = []
    doc, seen, table, current = None, markdown, None, None  # a Markdown file's first heading may name the feature freely
    for number, line in enumerate(lines, 1):
        bare = line.strip()
        if doc:
            if bare.startswith(doc):
                doc = None
            continue
        if bare.startswith(('"""', "```")):
            doc, table = bare[:3], None
            continue
        if not bare or bare.startswith(("#", "@")):
            continue
        kind = next((kind for k, kind in order if bare.startswith(k + ":")), None)
        if kind == "feature":
            if seen and not markdown:
                raise GherkinError(f"line {number}: a second feature")
            seen = True
        elif kind and not seen:
            raise GherkinError(f"line {number}: {kind} outside a feature")
        elif kind == "examples":
            if current is None:
                raise GherkinError(f"line {number}: examples without a scenario")
            table = []
            current.examples.append(table)
        elif kind in ("background", "scenario", "outline"):
            current, table = Scenario(), None
            out.append(current)
        elif kind == "rule":
            current, table = None, None
        elif bare.startswith("|"):
            row = cells(line, number)
            if table is not None:
                table.append(row)
        elif current is not None and (word := next((w for w in words if bare.startswith(w if named in SPACELESS and w != "*" else w + " ")), None)):
            table = None
            value = bare[len(word) :].strip()
            column = len(line) - len(line.lstrip()) + 1
            if value:
                current.steps.append((word, value, number, column, len(line.rstrip()) + 1))
        elif not seen:
            raise GherkinError(f"line {number}: neither a feature nor a comment")
        elif current is not None and current.steps and not current.examples:
            raise GherkinError(f"line {number}: neither a step nor a keyword")
    if doc:
        raise GherkinError("a doc string without an end")
    return out


TEMPLATES = "path string, scenario int, keyword string, template string, line int, column int, end_column int, error string"


def templates(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``files`` (path, content string): template steps, and example rows (path, scenario, row, values map).

    A file that doesn't parse gives one template row with only path and error.
    """

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    for k, s in enumerate(parse(content or "", path.endswith(".md"))):
                        rows += [(path, k, *step, None) for step in s.steps]
                except GherkinError as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    for k, s in enumerate(parse(content or "", path.endswith(".md"))):
                        data = [(t[0], r) for t in s.examples if t for r in t[1:]]
                        rows += [{"path": path, "scenario": k, "row": n, "values": list(dict(reversed([*zip(head, row)])).items())} for n, (head, row) in enumerate(data)]
                except GherkinError:
                    pass  # reported by the steps' side
            yield pa.RecordBatch.from_pylist(rows, schema=example_schema)

    names = [x.split()[0] for x in TEMPLATES.split(", ")]
    schema = pa.schema([(n, pa.int32() if n in ("scenario", "line", "column", "end_column") else pa.string()) for n in names])
    example_schema = pa.schema([("path", pa.string()), ("scenario", pa.int32()), ("row", pa.int32()), ("values", pa.map_(pa.string(), pa.string()))])
    own = files.select("path", "content")
    return own.mapInArrow(steps, TEMPLATES), own.mapInArrow(examples, "path string, scenario int, row int, values map<string,string>")


def expanded(steps: DataFrame, examples: DataFrame) -> DataFrame:
    """Keyword, text, location, one row per concrete step; steps of a scenario without example rows appear once, as they are."""
    joined = steps.where("error is null").join(examples, ["path", "scenario"], "left")
    text = F.when(F.col("values").isNull(), F.col("template")).otherwise(substituted(F.col("template"), F.col("values")))
    location = F.struct("path", "line", "column", F.col("line").alias("end_line"), "end_column").alias("location")
    return joined.select("keyword", text.alias("text"), location, F.coalesce("row", F.lit(0)).alias("row"))


def feature_steps(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps with step_seq in location order, errors by path)."""
    from stepweave.plans.analyze import sequenced
    from stepweave.plans.durable import durable

    own, rows = templates(files)
    own = durable(own)  # steps and errors are read from it

    steps = expanded(own, rows)
    listed = steps.select(F.struct("location", "row").alias("seq_key"), "keyword", "text", "location")
    return sequenced(listed).withColumnRenamed("seq", "step_seq"), own.where("error is not null").select("path", "error")


def within_budget(steps: DataFrame, most: int = MAX_STEPS, most_bytes: int = MAX_BYTES) -> bool:
    """G6."""
    n, size = steps.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return n <= most and size <= most_bytes
