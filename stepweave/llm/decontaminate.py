"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over word numbers. Training words stream through it; at each word the length of the longest
match that ends there is known, and with it every window of an item that ends there. Words outside the items'
vocabulary reset the match, so only runs of known words are streamed at all.

The items go to the workers in shards of about ``SHARD_WORDS`` words, which bounds an automaton (at most two states a
word). ``SHARDS`` of them, built once per worker, share one scan of the documents; a larger benchmark takes a scan for
every ``SHARDS`` shards, and the driver holds the items of one scan at a time. Items are never split, and windows never
span items, so sharding loses nothing: findings are combined per document.

Rows: null or wordless texts have no words and no hits; null or wordless items have no windows; items with a null id
are left out; repeated items count once by id. Repeated document rows each get their row, null ids included. An empty
benchmark hits nothing. Items that all share one window are all reported where it occurs, so there are no ties to break.
Very long texts are slices of their own and scanned whole. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import ALNUM, bounded, load, picked, slices, text_bytes, words_of
from stepweave.plans.durable import durable

WINDOW = 8
SHARD_WORDS, SHARDS = 200_000, 4
#: Spans of this many words or more condemn their document; shorter hits are cut out of it.
LONG_SPAN = 13
COVERAGE = 0.5


class SuffixAutomaton:
    """Of several word sequences; no transition leads across the end of one. ``windows`` of each item are known by state."""

    def __init__(self, items: Iterable[tuple[str, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: items whose window a state stands for, by the window's length
        self.items: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            size = min(window, len(words))
            state = length = 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= size:
                    self.items.setdefault(self._holder(state, size), {}).setdefault(size, set()).add(name)
        #: by state: (shortest window's length, windows) found on its chain of suffixes
        self.chains: dict[int, list[tuple[int, set[str]]]] = {}

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the strings that reach ``q`` from ``p`` by ``w``, apart from longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w, self.next[p][w])
        return state

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """After one more word: the state and length of the longest match that ends there."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], length + 1
        return 0, 0

    def _holder(self, state: int, size: int) -> int:
        """The state of the suffix of ``size`` words."""
        while state and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def chain(self, state: int) -> list[tuple[int, set[str]]]:
        """Windows that end wherever ``state`` ends, with their lengths."""
        if state not in self.chains:
            own = [*self.items.get(state, {}).items()]
            self.chains[state] = own + (self.chain(self.link[state]) if state else [])
        return self.chains[state]

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans covered by windows (merged, end exclusive) and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = length = 0
        for at, w in enumerate(words, 1):
            state, length = self.step(state, length, w)
            if not state:
                continue
            longest = 0
            for size, names in self.chain(state):
                if size <= length:
                    found |= names
                    longest = max(longest, size)
            if longest:
                start = at - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))
        return spans, found


_BUILT: dict[str, tuple[SuffixAutomaton, pa.Array, int]] = {}
Shard = list[tuple[str, str]]


def _words(text: str) -> list[bytes]:
    """By the contract's class: bytes, as ``str.split`` would also part at white space beyond ASCII."""
    return text.encode().translate(ALNUM).split()


def _automaton(key: str, items: Shard, window: int) -> tuple[SuffixAutomaton, pa.Array, int]:
    """The automaton, its vocabulary and its shortest window; built once per worker and shard."""
    if key not in _BUILT:
        while len(_BUILT) >= SHARDS:
            _BUILT.pop(next(iter(_BUILT)))
        words = [(name, _words(text)) for name, text in items]
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in words for w in ws}))}
        automaton = SuffixAutomaton(((name, [vocabulary[w] for w in ws]) for name, ws in words), window)
        shortest = min((min(window, size) for by in automaton.items.values() for size in by), default=window)
        _BUILT[key] = automaton, pa.array([w.decode() for w in vocabulary], pa.large_string()), shortest
    return _BUILT[key]


def _scan(shards: list[Shard], window: int):
    """Batches of (doc_id, rid, text) to the contract's findings plus spans, one row per document."""
    keys = [hashlib.sha256(repr((items, window)).encode()).hexdigest() for items in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, flat = words_of(batch.column("text"), ALNUM)
            n = len(starts) - 1
            spans: list[list[int]] = [[] for _ in range(n)]
            found: list[list[str]] = [[] for _ in range(n)]
            for key, items in zip(keys, shards):
                automaton, vocabulary, shortest = _automaton(key, items, window)
                if not len(flat) or not len(vocabulary):
                    continue
                word = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy()
                known = word >= 0
                # runs of known words within a document
                edge = np.zeros(len(word) + 1, bool)
                edge[0] = edge[-1] = True
                edge[1:-1] = known[1:] != known[:-1]
                edge[starts] = True
                bounds = np.flatnonzero(edge)
                first, last = bounds[:-1], bounds[1:]
                use = known[first] & (last - first >= shortest)
                owner = np.searchsorted(starts, first[use], "right") - 1
                for d, a, b in zip(owner.tolist(), first[use].tolist(), last[use].tolist()):
                    own, names = automaton.scan(word[a:b].tolist())
                    for s, e in own:
                        spans[d] += [s + a - int(starts[d]), e + a - int(starts[d])]
                    found[d] += names
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "rid": batch.column("rid"), "n_words": pa.array(np.diff(starts)), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array([sorted(set(x)) for x in found], pa.list_(pa.string()))})

    return run


def _scans(items: DataFrame, id_col: str, text_col: str, shard_words: int) -> tuple[int, Iterator[list[Shard]]]:
    """How many scans there are, and the items of each, as bounded shards; only one scan's items are held at a time."""
    rows = picked(items, name=id_col, text=text_col).where("name is not null and text is not null").select(F.col("name").cast("string"), "text").distinct()
    sized = rows.withColumn("words", F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))
    total = sized.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    scans = -(-shards // SHARDS)

    def held() -> Iterator[list[Shard]]:
        numbered = sized.select("name", "text", F.pmod(F.xxhash64("name"), F.lit(shards)).alias("shard"))
        for k in range(scans):
            parts: dict[int, Shard] = {}
            for r in numbered.where(F.col("shard").between(k * SHARDS, (k + 1) * SHARDS - 1)).collect():
                parts.setdefault(r["shard"], []).append((r["name"], r["text"]))
            yield [sorted(parts[x]) for x in sorted(parts)]

    return scans, held()


def _found(rows: DataFrame, kind: str, items: DataFrame, window: int, item_id: str, item_text: str, shard_words: int) -> DataFrame:
    """Findings of durable or single-scan rows (doc_id, text, rid)."""
    schema = f"doc_id {kind}, rid long, n_words long, spans array<long>, items array<string>"
    scans, held = _scans(items, item_id, item_text, shard_words)
    if scans == 1:
        return rows.mapInArrow(_scan(next(held), window), schema)
    merged = None
    for shards in held:  # each scan is done before the next one's items are fetched
        part = durable(rows.mapInArrow(_scan(shards, window), schema))
        merged = part if merged is None else merged.unionByName(part.where("size(items) > 0"))
    return merged.groupBy("rid").agg(F.first("doc_id", True).alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def findings(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, rid, n_words, spans (flat list of word starts and ends), items (ids): one row per document row."""
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("rid", F.monotonically_increasing_id())
    if _scans(items, item_id, item_text, shard_words)[0] > 1:
        rows = durable(rows)  # row numbers must mean the same rows in every scan
    return _found(rows, docs.schema[id_col].dataType.simpleString(), items, window, item_id, item_text, shard_words)


def covered(spans: F.Column) -> F.Column:
    """How many words the spans cover, however they overlap."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest((F.size(spans) / 2).cast("int") - 1, F.lit(0))), lambda k: F.struct(F.get(spans, 2 * k).alias("s"), F.get(spans, 2 * k + 1).alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, p: F.struct(F.greatest(a["end"], p["e"]).alias("end"), (a["sum"] + F.greatest(p["e"] - F.greatest(a["end"], p["s"]), F.lit(0).cast("long"))).alias("sum"))
    return F.when(F.size(spans) > 0, F.aggregate(pairs, zero, step, lambda a: a["sum"])).otherwise(F.lit(0).cast("long"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, long_span: int = LONG_SPAN, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents with the benchmark taken out, with all their columns.

    A document goes if windows of two items or more occur in it, if a hit span has ``long_span`` words or more, or if
    hits cover more than ``coverage`` of its words. Shorter hits are cut out of its text; any other text is unchanged.
    """
    bounded(docs.sparkSession)
    names = docs.columns
    place = names.index(text_col)

    def judged(batch: pa.RecordBatch, rows: list[dict]) -> pa.RecordBatch:
        keep, texts = [], batch.column(place).to_pylist()
        for d, row in enumerate(rows):
            hits = {w for s, e in zip(row["spans"][::2], row["spans"][1::2]) for w in range(s, e)}
            run_length = longest = 0
            for w in sorted(hits):
                run_length = run_length + 1 if w - 1 in hits else 1
                longest = max(longest, run_length)
            if len(row["items"]) >= 2 or longest >= long_span or len(hits) > coverage * row["n_words"]:
                continue
            keep.append(d)
            if hits:
                texts[d] = cut(texts[d], hits)
        columns = [pa.array(texts, batch.schema.field(place).type) if k == place else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(k) for k in range(len(names))])).take(pa.array(keep, pa.int64()))

    scans, held = _scans(items, "item_id", "text", shard_words)
    if scans == 1:
        scan = _scan(next(held), window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                own = pa.RecordBatch.from_pydict({"doc_id": batch.column(id_col), "text": batch.column(text_col), "rid": pa.array(np.arange(batch.num_rows))})
                yield judged(batch, [row for part in scan(iter([own])) for row in part.to_pylist()])

        return docs.mapInArrow(run, docs.schema)

    numbered = durable(docs.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("rid", F.monotonically_increasing_id()))  # own names, so that none can clash
    rows = numbered.select(F.col(f"c{names.index(id_col)}").alias("doc_id"), F.col(f"c{place}").alias("text"), "rid")
    found = _found(rows, docs.schema[id_col].dataType.simpleString(), items, window, "item_id", "text", shard_words)
    told = found.where("size(items) > 0").select("rid", "n_words", "spans", "items")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{place}"):
            yield judged(batch, batch.select(["n_words", "spans", "items"]).to_pylist())

    hit = numbered.join(told, "rid").drop("rid").mapInArrow(decide, docs.toDF(*[f"c{k}" for k in range(len(names))]).schema)
    return numbered.join(told.select("rid"), "rid", "left_anti").drop("rid").unionByName(hit).toDF(*names)


def cut(text: str, words: set[int]) -> str:
    """The text without the numbered words; what stands between two removed words goes with them."""
    raw, _ = text_bytes(pa.array([text]), ALNUM)
    source, out, bounds, at, k, position = text.encode(), [], [], 0, 0, 0
    for word in raw.split():
        position = raw.index(word, position)
        bounds.append((position, position + len(word)))
        position += len(word)
    while k < len(bounds):
        if k in words:
            first = k
            while k + 1 in words:
                k += 1
            out.append(source[at : bounds[first][0]])
            at = bounds[k][1]
        k += 1
    return b"".join([*out, source[at:]]).decode()


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's windows in every document."""
    found = findings(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w"
OP7_SQL = f"""with d as (select row_number() over () rid, doc_id, {_SQL_WORDS} from documents),
b as (select item_id::varchar item, w, least({WINDOW}, len(w)) k from (select item_id, {_SQL_WORDS} from benchmark where item_id is not null) where len(w) > 0),
v as (select distinct item, k, array_to_string(w[i : i + k - 1], ' ') s from (select *, unnest(range(1, len(w) - k + 2)) i from b)),
x as (select rid, k, i, array_to_string(w[i : i + k - 1], ' ') s from (select rid, k, w, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from v) where len(w) >= k)),
hit as (select rid, x.k, i, item from x join v using (k, s)),
n as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + k)) p from hit) group by rid),
t as (select rid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct rid, item from hit) group by rid)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated from d left join n using (rid) left join t using (rid)"""
