"""Best-fit packing with swap-based local search.

Documents are encoded once; what moves after that is one small row per piece (length and checksum, never the ids).
Pieces are split by a hash into groups of about ``GROUP_PIECES``, so a group is bounded however large or skewed the
corpus is, and each group is packed on its own: best fit over descending lengths, then local search between the
underfull bins. A group leaves at most a few bins short of full, against ten thousands of full ones.

Local search raises the sum of squared fills. The emptiest bin gives to fuller ones: it moves pieces, or exchanges one for
one, two for one or one for two, always the exchange that fills its partner by most; a bin that loses all its pieces is
gone. Partners are found by the lengths they hold, not by trial: for every length and every sum of two lengths, the
bin with the most room that holds it is known, so an exchange is found, or ruled out, at once. Every step raises an integer
bounded by bins * size^2, so the search ends by itself, and it stops early only where no further bin can be emptied: at the
least number of bins that the lengths allow, or when the other bins' room is less than the emptiest one's fill.

Rows: null text is empty, i.e. the end id alone; repeated rows and null ids are packed like any others; a document of
exactly ``size`` ids is one piece, and a very long text any number of them; pieces of one length are alike, so ties don't
matter; other columns, whatever their names, are never read; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import load, picked, slices
from stepweave.llm.tokens import Encoder, vocabulary
from stepweave.plans.durable import durable

SIZE = 2048
END_ID = 0
GROUP_PIECES = 200_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents longer than ``size`` are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        for batch in slices(batches, limit=2 << 20):
            starts, ids = encoder.encode(batch.column("text"))
            whole = np.insert(ids, starts[1:], end_id).astype("<u4")
            begins = starts + np.arange(len(starts))  # of the documents with their end ids
            n = -(-np.diff(begins) // size)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = np.repeat(begins[:-1], n) + piece * size
            last = np.minimum(first + size, np.repeat(begins[1:], n))
            raw = memoryview(whole).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((first * 4).tolist(), (last * 4).tolist())]
            doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(last - first), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(cut, PIECE)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best fit, longest first: each item goes where the least room is left over. Returns item numbers by bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # the rooms that some open bin has, ascending
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        k = bisect.bisect_left(rooms, need)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            bins[b].append(item)
        else:
            room, b = size, len(bins)
            bins.append([item])
        left = room - need
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


class Open:
    """The underfull bins that can take more: items by length, and the roomiest bin that holds each length or sum of two."""

    def __init__(self, bins: dict[int, dict[int, list[int]]], room: dict[int, int], size: int):
        self.bins, self.room, self.size = bins, room, size
        self.clock, self.stamp = 0, dict.fromkeys(bins, 0)  # what entries of an earlier state are told by
        self.heaps: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        self.most = np.full((2, size + 1), -1, np.int64)  # room by single length (0: of any bin) and by sum of two
        for b in bins:
            self._enter(b)
        for which, heaps in enumerate(self.heaps):
            self._settle(which, heaps)

    def sums(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The different lengths in a bin, and the different sums of two of its items."""
        own = np.array(sorted(self.bins[b]), np.int64)
        twice = own[[len(self.bins[b][x]) > 1 for x in own.tolist()]] * 2 if len(own) else own
        two = (own[:, None] + own[None, :])[np.triu_indices(len(own), 1)]
        return own, np.unique(np.concatenate([two, twice]))

    def _enter(self, b: int) -> None:
        one, two = self.sums(b)
        for heaps, keys in zip(self.heaps, ([0, *one.tolist()], two.tolist())):
            for key in keys:
                heapq.heappush(heaps[key], (-self.room[b], b, self.stamp[b]))

    def _settle(self, which: int, keys) -> None:
        for key in keys:
            heap = self.heaps[which][key]
            while heap and self.stamp.get(heap[0][1]) != heap[0][2]:
                heapq.heappop(heap)
            self.most[which, key] = -heap[0][0] if heap else -1

    def leave(self, b: int) -> None:
        one, two = self.sums(b)
        self.stamp.pop(b)
        self._settle(0, [0, *one.tolist()])
        self._settle(1, two.tolist())

    def best(self, b: int) -> tuple[int, int, int, int] | None:
        """(partner, which of its sums, that sum, what comes in for it) for the giver ``b``, by the largest gain."""
        one, two = self.sums(b)
        found, gain = None, 0
        for which, coming in ((0, np.union1d(one, two)), (1, one)):
            going = np.flatnonzero(self.most[which] > 0)
            if not len(going) or not len(coming):
                continue
            k = np.searchsorted(coming, going + self.most[which, going], "right") - 1
            gains = np.where(k >= 0, coming[k] - going, 0)
            top = int(gains.argmax())
            if gains[top] > gain:
                gain = int(gains[top])
                out = int(going[top])
                found = self.heaps[which][out][0][1], which, out, int(coming[k[top]])
        return found

    def _take(self, b: int, total: int, one: bool) -> list[int]:
        """Remove one item, or two, of that length together."""
        held = self.bins[b]
        pair = (total,) if one else next((x, total - x) for x in held if total - x in held and (total != 2 * x or len(held[x]) > 1))
        out = []
        for x in pair:
            out.append(held[x].pop())
            if not held[x]:
                del held[x]
        return out

    def exchange(self, giver: int, partner: int, which: int, going: int, coming: int, length: list[int]) -> None:
        self.leave(partner)
        back = self._take(partner, going, which == 0) if going else []
        came = self._take(giver, coming, coming in self.bins[giver])
        for b, items in ((giver, back), (partner, came)):
            for x in items:
                self.bins[b].setdefault(length[x], []).append(x)
        self.room[partner] -= coming - going
        self.room[giver] += coming - going
        if self.room[partner]:
            self.clock += 1
            self.stamp[partner] = self.clock
            self._enter(partner)
            one, two = self.sums(partner)
            self._settle(0, [0, *one.tolist()])
            self._settle(1, two.tolist())


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Exchange items between underfull bins until no further bin can be emptied.

    The emptiest bin drains into the others; it is dropped when empty, and set aside when no exchange is left.
    """
    length = lengths.tolist()
    used = [sum(length[x] for x in items) for items in bins]
    least = -(-sum(used) // size)
    held: dict[int, dict[int, list[int]]] = {}
    for b, items in enumerate(bins):
        if used[b] < size:
            held[b] = {}
            for x in items:
                held[b].setdefault(length[x], []).append(x)
    count, free = len(bins), {b: size - used[b] for b in held}
    if count == least:
        return bins
    open_ = Open(held, free, size)
    order = sorted((used[b], b) for b in held)
    spare = sum(free.values())
    while count > least and len(open_.stamp) > 1:
        fill, low = heapq.heappop(order)
        if low not in open_.stamp:
            continue
        if fill != size - free[low]:  # it was filled further
            heapq.heappush(order, (size - free[low], low))
            continue
        spare -= free[low]
        if spare < fill:
            break
        open_.leave(low)
        while held[low] and (change := open_.best(low)):
            partner, which, going, coming = change
            open_.exchange(low, partner, which, going, coming, length)
            spare -= coming - going
        count -= not held[low]
    return [items for b, items in enumerate(bins) if b not in held] + [[x for own in by.values() for x in own] for by in held.values() if by]


def pack(parts: DataFrame, size: int = SIZE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces. ``parts`` is made durable first: groups are formed from fixed rows."""
    parts = durable(parts)
    groups = max(1, -(-parts.count() // group_pieces))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        base = table.column("group")[0].as_py() << 32
        for b, items in enumerate(local_search(best_fit(lengths, size), lengths, size)):
            at = np.cumsum(lengths[items])
            sequence[items], offset[items] = base + b, at - lengths[items]
        return table.drop_columns("group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return parts.withColumn("group", spread).groupBy("group").applyInArrow(packed, f"{PIECE}, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 ids."""
    return pack(pieces(load(spark, sf_dir, "documents"), vocabulary()))
