"""Suffix dedup: bytes covered by strings of ``MIN`` bytes that also start in a document with a smaller id go.

1. *Anchors.* Every window of 50 bytes has a minimiser, its leftmost least 16-byte hash. Equal windows have equal ones, so
   windows need comparing only within an anchor. The consecutive windows of one minimiser are a *snippet* (66 bytes on
   average); every window is in exactly one.
2. *Groups.* Each task packs (anchor, hash of the snippet, owner) into arrays by shard, one entry per distinct snippet: where a
   smaller document of the same task has it, that already settles the others, so a hot passage costs a shard one entry a task. A shard sees which snippets occur in a
   smaller document as they are, by 64-bit hashes: those are removed whole, without their bytes ever moving. Only the first owner of each
   distinct snippet of an anchor with several has windows left to compare, and only if another one has the same 16 bytes
   before or after the anchor (a common window holds 34 more bytes, so 17 on one side); it is asked for the bytes. An anchor with more
   than ``VARIANTS`` distinct snippets has them sent window by window, keyed by the window, so that it is split.
3. *Suffixes.* Snippets that meet are concatenated, their suffixes sorted to depth ``MIN``, and the Burrows-Wheeler transform
   is extended backwards breadth first: a level's intervals, all at once, become the next level's by the symbol before
   them, so common prefixes come out by increasing length and the search stops at ``MIN``. Windows in one interval are
   equal; those above its least id are removed.

Copies of whole texts are settled by their digest alone.

Rows: null text is empty; texts below ``MIN`` bytes are never touched; rows with a null id take no part and stay whole;
rows of one id are not smaller than each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import load, picked, slices, text_bytes
from stepweave.plans.durable import durable, fresh_path, release

MIN, GRAM = 50, 16
ANCHORS_PER_SHARD = 1_000_000
#: Entries that a task gathers before it packs them by shard.
GATHER = 2_000_000
VARIANTS = 20_000
CHUNK = 1 << 20
#: Bytes hashed at once and read at once: small, as each byte takes some ten 8-byte cells meanwhile.
PIECE, SLICE = 1 << 18, 2 << 20
WHOLE, SHIP, SPLIT = 0, 1, 2
ANSWER = np.dtype([("anchor", "<u8"), ("snip", "<u8"), ("what", "u1")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _windowed(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def snippets(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, first byte, end, anchor, snippet hash, hashes of both sides) of the texts ``raw[at[k]:at[k+1]]``; bytes are counted in ``raw``."""
    out = []
    for a, b, piece_at, firsts in _pieces(at):
        piece = raw[a:b]
        n = len(piece) - GRAM + 1
        word = np.ndarray((len(piece) - 7,), "<u8", piece, 0, (1,))
        h = _mix(word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ word[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))
        least = _windowed((h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64), MIN - GRAM + 1)
        where = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(firsts)), np.diff(piece_at))[: len(where)]
        inside = np.arange(len(where)) + MIN <= piece_at[owner + 1]
        start = np.ones(len(where), bool)
        start[1:] = (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(start)
        stop = np.append(start[1:], len(where))
        # windows that reach over a text's end are the last ones of its run
        stop = np.minimum(stop, piece_at[owner[start] + 1] - MIN + 1)
        fine = inside[start] & (stop > start)
        start, stop = start[fine], stop[fine]
        end = stop - 1 + MIN
        anchor = _mix(h[where[start]] * np.uint64(0xD6E8FEB86659FD93))  # minimisers are small numbers; shards need even ones
        snip = anchor ^ _mix((end - start).astype(np.uint64) << np.uint64(8) | (where[start] - start).astype(np.uint64))
        for place in (start, start + GRAM, start + 2 * GRAM, end - 3 * GRAM, end - 2 * GRAM, end - GRAM):
            snip = _mix(snip * np.uint64(0x9E3779B97F4A7C15) + h[place])
        mid = where[start]
        left = np.where(mid - GRAM >= start, (h[np.maximum(mid - GRAM, 0)] >> np.uint64(48)) | np.uint64(1), np.uint64(0))
        right = np.where(mid + 2 * GRAM <= end, (h[np.minimum(mid + GRAM, n - 1)] >> np.uint64(48)) | np.uint64(1), np.uint64(0))
        out.append((np.asarray(firsts)[owner[start]], start + a, end + a, anchor, snip, (left << np.uint64(16) | right).astype(np.uint32)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint32))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pieces(at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, list[int]]]:
    """Runs of texts of at most PIECE bytes (start, end, offsets within, text numbers); longer texts overlap by MIN - 1."""
    k, n = 0, len(at) - 1
    while k < n:
        last = max(k + 1, int(np.searchsorted(at, at[k] + PIECE, "right")) - 1)
        if at[last] - at[k] <= PIECE:
            if at[last] - at[k] >= MIN:
                yield int(at[k]), int(at[last]), at[k : last + 1] - at[k], list(range(k, last))
        else:
            for a in range(int(at[k]), int(at[last]) - MIN + 1, PIECE - MIN + 1):
                b = min(a + PIECE, int(at[last]))
                yield a, b, np.array([0, b - a]), [k]
        k = last


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Ascending with the anchor, so that sorting by anchor sorts by shard."""
    return ((anchor >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _offered(shards: int):
    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, snip, sides, owner = (np.concatenate([p[k] for p in parts]) for k in range(4))
        ids, keys = (np.concatenate([p[k] for p in parts]) for k in (4, 5))
        order = np.argsort(anchor, kind="stable")
        several = np.append(False, anchor[order][1:] == anchor[order][:-1])
        several |= np.append(several[1:], False)
        some = order[several]
        some = some[np.lexsort((ids[owner[some]], snip[some], anchor[some]))]
        doc = ids[owner[some]]
        run = np.append(True, (anchor[some][1:] != anchor[some][:-1]) | (snip[some][1:] != snip[some][:-1])) if len(some) else np.zeros(0, bool)
        known = doc > doc[np.flatnonzero(run)][np.cumsum(run) - 1] if len(some) else run
        told = some[known]  # a smaller document of this task has the same snippet: that settles it
        answers = np.zeros(len(told), ANSWER)
        answers["anchor"], answers["snip"], answers["what"] = anchor[told], snip[told], WHOLE
        rest = np.ones(len(anchor), bool)
        rest[told] = False
        order = order[rest[order]]
        told_owner = owner[told]
        anchor, snip, sides, owner = anchor[order], snip[order], sides[order], owner[order]
        cuts = np.searchsorted(_shard(anchor, shards), np.arange(shards + 1))
        rows = []
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[s], cuts[s + 1]
            held, local = np.unique(owner[a:b], return_inverse=True)
            width = "<u2" if len(held) < 1 << 16 else "<u4"
            rows.append((s, anchor[a:b].tobytes(), snip[a:b].tobytes(), sides[a:b].tobytes(), local.astype(width).tobytes(), ids[held].tobytes(), keys[held].tobytes()))
        for part in np.array_split(np.argsort(told_owner, kind="stable"), max(1, len(told) // 100_000)):
            if len(part):  # any group will do, so these go to groups of their own, evenly
                held = told_owner[part]
                rows.append((shards + int(keys[held[0]]) % shards, answers[part].tobytes(), b"", b"", b"", ids[held].tobytes(), keys[held].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6))], ["shard", "anchor", "snip", "sides", "local", "ids", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, docs = [], 0, 0
        for batch in slices(batches, limit=SLICE):
            owner, _, _, anchor, snip, sides = snippets(*text_bytes(batch.column("text")))
            order = np.argsort(anchor, kind="stable")
            anchor, snip, sides, owner = anchor[order], snip[order], sides[order], owner[order]
            keep = np.ones(len(anchor), bool)
            keep[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (snip[1:] != snip[:-1])
            ids, keys = batch.column("doc_id").to_numpy().astype("<i8"), batch.column("key").to_numpy().astype("<i8")
            parts.append((anchor[keep], snip[keep], sides[keep], (owner[keep] + docs).astype(np.uint32), ids, keys))
            entries, docs = entries + int(keep.sum()), docs + batch.num_rows
            if entries > GATHER:
                yield packed(parts)
                parts, entries, docs = [], 0, 0
        if entries:
            yield packed(parts)

    return run


def _several(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where a value other than zero occurs more than once in its group."""
    pair = group.astype(np.uint64) << np.uint64(16) | value.astype(np.uint64)
    _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    return (times[back] > 1) & (value > 0)


def _answered(table: pa.Table, most: int) -> pa.Table:
    """A shard's verdicts, as packed answers by document. Groups without side hashes were told by their task already."""
    if not len(table.column("sides")[0].as_py()):
        answers, doc, key = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("anchor", ANSWER), ("ids", "<i8"), ("keys", "<i8")))
        return _by_document(answers, doc, key)
    kinds = (("anchor", "<u8"), ("snip", "<u8"), ("sides", "<u4"), ("local", ""), ("ids", "<i8"), ("keys", "<i8"))
    parts = [[np.frombuffer(x, t or ("<u2" if len(i) < 8 << 16 else "<u4")) for x, i in zip(table.column(c).to_pylist(), table.column("ids").to_pylist())] for c, t in kinds]
    anchor, snip, sides = (np.concatenate(parts[k]) for k in range(3))
    doc = np.concatenate([ids[local] for ids, local in zip(parts[4], parts[3])])
    key = np.concatenate([keys[local] for keys, local in zip(parts[5], parts[3])])
    del parts
    order = np.argsort(anchor)
    alone = anchor[order]
    lonely = np.append(True, alone[1:] != alone[:-1])
    lonely &= np.append(lonely[1:], True)
    order = order[~lonely]  # most anchors occur once
    order = order[np.lexsort((doc[order], snip[order], anchor[order]))]
    anchor, snip, sides, doc, key = anchor[order], snip[order], sides[order], doc[order], key[order]
    if not len(anchor):
        return _by_document(np.empty(0, ANSWER), doc, key)
    group = np.append(True, anchor[1:] != anchor[:-1])
    variant = group | np.append(True, snip[1:] != snip[:-1])
    g, v = np.flatnonzero(group), np.flatnonzero(variant)
    group_of, variant_of = np.cumsum(group) - 1, np.cumsum(variant) - 1
    texts = np.minimum.reduceat(key, g) != np.maximum.reduceat(key, g)  # more than one text holds the anchor
    variants = np.bincount(group_of[v], minlength=len(g))
    near = _several(group_of[v], sides[v] >> np.uint32(16)) | _several(group_of[v], sides[v] & np.uint32(0xFFFF))
    least = doc[v][variant_of]
    what = np.where(doc > least, WHOLE, np.where(variants[group_of] > most, SPLIT, SHIP)).astype(np.uint8)
    use = texts[group_of] & ((doc > least) | near[variant_of])
    answers = np.empty(use.sum(), ANSWER)
    answers["anchor"], answers["snip"], answers["what"] = anchor[use], snip[use], what[use]
    doc, key = doc[use], key[use]
    return _by_document(answers, doc, key)


def _by_document(answers: np.ndarray, doc: np.ndarray, key: np.ndarray) -> pa.Table:
    if not len(doc):
        return pa.table({"doc_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "answers": pa.array([], pa.binary())})
    order = np.lexsort((key, doc))
    answers, doc, key = answers[order], doc[order], key[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    cuts = np.append(np.flatnonzero(first), len(doc))
    return pa.table({"doc_id": doc[cuts[:-1]], "key": key[cuts[:-1]], "answers": pa.array([answers[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint, maximal runs of (start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > reach[:-1])
    cuts = np.flatnonzero(first)
    return np.stack([spans[cuts, 0], np.append(reach[cuts[1:] - 1], reach[-1])], axis=1)


SENT = "shard int, anchor binary, doc binary, key binary, start binary, size binary, bytes binary"


def _matched(shards: int):
    """For documents with their answers, one row for each that loses whole snippets and one for each shard asked for bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            raw, at = text_bytes(batch.column("text"))
            owner, start, end, anchor, snip, _ = snippets(raw, at)
            packs = [b"".join(p) for p in batch.column("answers").to_pylist()]
            answers = np.frombuffer(b"".join(packs), ANSWER)
            asker = np.repeat(np.arange(len(packs)), [len(p) // ANSWER.itemsize for p in packs])
            name = lambda d, a, s: _mix(a ^ _mix(s)) ^ _mix(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            asked = name(asker, answers["anchor"], answers["snip"])
            order = np.argsort(asked)
            pair = name(owner, anchor, snip)
            place = order[np.minimum(np.searchsorted(asked, pair, sorter=order), len(order) - 1)]
            what = np.where(asked[place] == pair, answers["what"][place], 255)
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
            rows = []
            gone = what == WHOLE
            own, spans = owner[gone], np.stack([start[gone], end[gone]], axis=1) - at[owner[gone]][:, None]
            cuts = np.searchsorted(own, np.arange(len(ids) + 1))
            for d in np.flatnonzero(np.diff(cuts)).tolist():
                rows.append((-1, b"", ids[d : d + 1].tobytes(), keys[d : d + 1].tobytes(), merged(spans[cuts[d] : cuts[d + 1]]).astype("<i8").tobytes(), b"", b""))
            ship, split = what == SHIP, np.flatnonzero(what == SPLIT)
            many = end[split] - MIN + 1 - start[split]
            window = np.repeat(start[split] - np.cumsum(many) + many, many) + np.arange(many.sum())
            first, last = [start[ship], window], [end[ship], window + MIN]
            whose = [owner[ship], np.repeat(owner[split], many)]
            group = [anchor[ship], _keys(raw, window)]  # all at once: a call for each snippet took most of a hot anchor's time
            first, last, whose, group = (np.concatenate(x) for x in (first, last, whose, group))
            order = np.argsort(group, kind="stable")
            first, last, whose, group = first[order], last[order], whose[order], group[order]
            cuts = np.searchsorted(_shard(group, shards), np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[s], cuts[s + 1])
                f, e, w = first[part], last[part], whose[part]
                text = b"".join([raw[x:y] for x, y in zip(f.tolist(), e.tolist())])
                rows.append((s, group[part].tobytes(), ids[w].tobytes(), keys[w].tobytes(), (f - at[w]).tobytes(), (e - f).tobytes(), text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6))], ["shard", "anchor", "doc", "key", "start", "size", "bytes"])

    return run


def _keys(raw: bytes, first: np.ndarray) -> np.ndarray:
    """A hash of each window of MIN bytes."""
    byte = np.frombuffer(raw, np.uint8)
    out = np.zeros(len(first), np.uint64)
    for k in range(MIN):
        out = _mix(out * np.uint64(257) + byte[first + k])
    return out


def suffix_order(text: np.ndarray, depth: int = MIN) -> np.ndarray:
    """Suffixes by their first ``depth`` bytes or more (prefix doubling from eight bytes)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).tobytes()
    key = np.ndarray((len(text),), ">u8", padded, 0, (1,)).astype(np.uint64)
    order, width = np.argsort(key), 8
    while True:
        step = np.zeros(len(order), np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(step) + 1
        if width >= depth:
            return order
        ahead = np.zeros(len(order), np.int64)
        ahead[:-width] = rank[width:]
        key = (rank * (len(order) + 1) + ahead).astype(np.uint64)
        order, width = np.argsort(key), width * 2


def equal_intervals(text: np.ndarray, depth: int = MIN) -> np.ndarray:
    """A number for each position, equal exactly for positions whose next ``depth`` bytes are equal.

    Level by level, the intervals of strings of length l on the transform become those of length l + 1: in the order that
    the last-to-first mapping gives, two neighbours share an interval iff symbol and former interval agree.
    """
    order = suffix_order(text, depth)
    symbols = text[order - 1]  # the transform; the text is taken as circular, which the separators make harmless
    back = np.argsort(symbols, kind="stable")
    new_symbol = symbols[back][1:] != symbols[back][:-1]
    interval = np.zeros(len(text), np.int32)
    for _ in range(depth):
        former = interval[back]
        interval[0] = 0
        np.cumsum((former[1:] != former[:-1]) | new_symbol, out=interval[1:])
        if interval[-1] == len(text) - 1:
            break
    out = np.empty(len(text), np.int32)
    out[order] = interval
    return out


def _compared(table: pa.Table) -> pa.Table:
    """A shard's snippets: spans of windows that a smaller document has, by document."""
    anchor, doc, key, start, size = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("anchor", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i8"), ("size", "<i8")))
    byte = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
    order = np.argsort(anchor, kind="stable")
    group = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1]))
    alone = np.minimum.reduceat(doc[order], group) == np.maximum.reduceat(doc[order], group)  # as most windows of a hot anchor are
    order = order[~np.repeat(alone, np.diff(np.append(group, len(order))))]
    begin = (np.cumsum(size) - size)[order]
    anchor, doc, key, start, size = anchor[order], doc[order], key[order], start[order], size[order]
    at = np.concatenate([[0], np.cumsum(size)])
    byte = byte[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
    edges = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)])
    edges = np.append(edges, len(anchor))
    found = []
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(at[edges], at[edges[a]] + CHUNK, "right")) - 1)
        rows = np.arange(edges[a], edges[b])
        a = b
        lead = np.cumsum(size[rows] + 1) - size[rows] - 1
        text = np.full(int((size[rows] + 1).sum()), 255, np.uint8)  # 255 is in no UTF-8
        put = np.arange(len(text))
        row_of = np.repeat(np.arange(len(rows)), size[rows] + 1)
        real = put - lead[row_of] < size[rows][row_of]
        text[real] = byte[at[rows[0]] : at[rows[-1] + 1]]
        number = equal_intervals(text)
        window = np.flatnonzero(put - lead[row_of] + MIN <= size[rows][row_of])
        ids = doc[rows][row_of[window]]
        least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, number[window], ids)
        gone = window[ids > least[number[window]]]
        r = row_of[gone]
        s = start[rows][r] + gone - lead[r]
        found.append((doc[rows][r], key[rows][r], s))
    docs, keys, starts = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [[]] * 3))
    order = np.lexsort((starts, keys, docs))
    docs, keys, starts = docs[order], keys[order], starts[order]
    first = np.append(True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])) if len(docs) else np.zeros(0, bool)
    cuts = np.append(np.flatnonzero(first), len(docs))
    packs = [merged(np.stack([starts[a:b], starts[a:b] + MIN], axis=1)).astype("<i8").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"doc_id": docs[cuts[:-1]], "key": keys[cuts[:-1]], "spans": pa.array(packs, pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in slices(batches):
        raw, at = text_bytes(batch.column("text"))
        removed, count, digest, kept = [], [], [], []
        for d, packs in enumerate(batch.column("spans").to_pylist()):
            spans = merged(np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in packs]))
            own, out, last = raw[at[d] : at[d + 1]], [], 0
            for s, e in spans.tolist():
                out.append(own[last:s])
                last = e
            out.append(own[last:])
            left = b"".join(out)
            removed.append(len(own) - len(left))
            count.append(len(spans))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": digest, "kept": pa.array(kept, pa.binary())})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8") for c in ("doc", "key")]
        yield pa.RecordBatch.from_arrays([pa.array(one[0]), pa.array(one[1]), batch.column("start")], ["doc_id", "key", "spans"])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_variants: int = VARIANTS) -> DataFrame:
    """doc_id, key, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of the documents that lose bytes to other texts.

    Whole copies of a text with a smaller id are not listed here: their digests tell.
    """
    spark = docs.sparkSession
    rows = picked(docs, doc_id=id_col, text=text_col).where("doc_id is not null and octet_length(text) >= 50").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // (17 * ANCHORS_PER_SHARD)))
    offers = rows.mapInArrow(_offered(shards), "shard int, anchor binary, snip binary, sides binary, local binary, ids binary, keys binary")
    answers = offers.groupBy("shard").applyInArrow(lambda table: _answered(table, most_variants), "doc_id long, key long, answers binary")
    least = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    packed = durable(answers.groupBy("doc_id", "key").agg(F.collect_list("answers").alias("answers")).join(least, ["doc_id", "key"], "left_semi"))
    del offers, answers
    release(spark)  # the anchors' shuffle is larger than the input
    path = fresh_path(spark, "suffix-held")
    rows.join(packed, ["doc_id", "key"]).write.option("compression", "zstd").parquet(path)
    held = spark.read.parquet(path)
    del packed
    release(spark)
    sent_path = fresh_path(spark, "suffix-sent")
    held.mapInArrow(_matched(shards), SENT).write.option("compression", "zstd").parquet(sent_path)
    sent = spark.read.parquet(sent_path)
    compared = sent.where("shard >= 0").groupBy("shard").applyInArrow(_compared, "doc_id long, key long, spans binary")
    whole = sent.where("shard < 0").mapInArrow(_whole, "doc_id long, key long, spans binary")
    spans = compared.unionByName(whole).groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans"))
    texts = held.select("doc_id", "key", "text")
    return texts.join(spans, ["doc_id", "key"]).mapInArrow(_cut, "doc_id long, key long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to documents with smaller ids."""
    docs = load(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = durable(docs.select("doc_id", F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes")))
    first = facts.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("least"))
    lost = removals(docs).drop("kept").distinct().toDF("r_id", "r_key", "n_removed", "n_spans", "kept_sha256")
    copy = F.coalesce((F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= MIN), F.lit(False))
    joined = facts.join(first, "sha", "left").withColumn("copy", copy).join(lost, (F.col("doc_id") == F.col("r_id")) & (F.col("key") == F.col("r_key")), "left")
    pick = lambda whole, name, default: F.when(F.col("copy"), whole).otherwise(F.coalesce(F.col(name), default))
    return joined.select("doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"), pick(F.sha2(F.lit(""), 256), "kept_sha256", F.col("sha")).alias("kept_sha256"))
