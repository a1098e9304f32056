"""SimHash near-duplicates, linked by anchor-point covering.

Fingerprints that differ in at most four bits differ in at most two bits of their low half or in at most one bit of
their high half (else they differ in 3 + 2). Each half has a covering code as its anchors: the perfect [31,26] Hamming
code on 31 bits, covering radius one, times every value of the 32nd bit. A fingerprint has one *home* anchor per half,
the one within the covering radius, and is replicated to every anchor within radius plus threshold that could be the
home of a partner: 172 for the low half and 17 for the high one, whatever the data. Each anchor compares its homes with
the replicas it gets. There are 2^27 anchors a half, so random fingerprints hardly ever meet.

Equal fingerprints are compared once, so groups of copies cost one row. An anchor that is home to more than
``HOMES`` distinct fingerprints has them dealt into blocks of about that many; each replica meets each block, so no
task holds an unbounded group. A replica's matches in a block become a star around the least of them instead of all
pairs; stars keep every group connected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import LOWER, SMALL_SLICE, attached, load, picked, slices, text_bytes
from stepweave.operators.components import connected_components
from stepweave.plans.durable import durable

SHINGLE = 4
SEED = 42
THRESHOLD = 4
HOMES = 2048
#: Bytes of one text that are split into words at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def shingle_hashes(column: pa.Array, k: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, text after text, and how many each text has; fewer words are one run."""
    raw, at = text_bytes(column, LOWER)
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(at) - 1, np.int64)
    digest = xxhash.xxh64_intdigest
    for d in range(len(at) - 1):
        words: list[bytes] = []  # the last k - 1 of the piece before and those of this one
        some = False
        for piece in _word_pieces(raw, int(at[d]), int(at[d + 1])):
            words = words[-(k - 1) :] + piece if some and k > 1 else words + piece
            if len(words) < k:
                continue
            some = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            firsts = np.concatenate([[0], ends[:-k] + 1]).tolist()
            own = [digest(joined[s:e], seed) for s, e in zip(firsts, ends[k - 1 :].tolist())]
            hashes.append(np.array(own, np.uint64))
            counts[d] += len(own)
            if k == 1:
                words = []
        if words and not some:
            hashes.append(np.array([digest(b" ".join(words), seed)], np.uint64))
            counts[d] = 1
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def _word_pieces(raw: bytes, start: int, end: int) -> Iterator[list[bytes]]:
    """The words of ``raw[start:end]``, some at a time: a very long text's words take several times its size."""
    while start < end:
        stop = min(start + PIECE, end)
        while stop < end and raw[stop] not in b" \t\n\r\v\f":  # a piece ends where a word does
            after = _SPACE.search(raw, stop, end)
            stop = after.start() if after else end
        if words := raw[start:stop].split():
            yield words
        start = stop


def fingerprints(column: pa.Array, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit SimHash per text; zero for a text without words."""
    return _majority(*shingle_hashes(column, k, seed))


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of each document's hashes: eight byte-wide counters a word, 255 hashes at a time."""
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    has = np.flatnonzero(counts)
    n = counts[has]
    blocks = -(-n // 255)
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    starts = np.repeat(np.cumsum(n) - n, blocks) + within * 255
    lanes = np.uint64(0x0101010101010101)
    bits = np.zeros(len(has), np.uint64)
    for j in range(8):
        part = np.add.reduceat((hashes >> np.uint64(j)) & lanes, starts)
        tally = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
        for b in range(8):
            bits |= (tally[:, b] * 2 > n).astype(np.uint64) << np.uint64(8 * b + j)
    out[has] = bits
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, text_key: what tells the rows of one id apart."""
    return picked(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint as a signed long). Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SMALL_SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fingerprints(batch.column("text"), k, seed).view(np.int64))], ["doc_id", "text_key", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_key long, fp long")


@lru_cache(1)
def _syndromes() -> np.ndarray:
    """Syndrome of each value of each byte of a half; its last bit is free and has none."""
    columns = [*range(1, 32), 0]
    table = np.zeros((4, 256), np.uint8)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1:
                    table[byte, value] ^= columns[8 * byte + bit]
    return table


def syndrome(half: np.ndarray) -> np.ndarray:
    t = _syndromes()
    return t[0, half & 255] ^ t[1, half >> 8 & 255] ^ t[2, half >> 16 & 255] ^ t[3, half >> 24]


def homes(half: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each half."""
    s = syndrome(half).astype(np.uint32)
    flip = np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - 1).astype(np.uint32), np.uint32(0))
    return half ^ flip


@lru_cache(8)
def reach(threshold: int) -> list[np.ndarray]:
    """By syndrome: the changes that lead from a half to the homes of all halves within ``threshold`` bits of it."""
    by: list[list[int]] = [[] for _ in range(32)]
    for free in (0, 1):
        if free > threshold:
            continue
        for weight in range(threshold - free + 2):
            for bits in combinations(range(31), weight):
                s = mask = 0
                for b in bits:
                    s, mask = s ^ (b + 1), mask | 1 << b
                by[s].append(mask | free << 31)
    return [np.array(x, np.uint32) for x in by]


def _anchored(threshold: int):
    low, high = threshold // 2, threshold - threshold // 2 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fp), 2000):
                block = fp[a : a + 2000]
                for which, half, t in ((0, (block & np.uint64(0xFFFFFFFF)).astype(np.uint32), low), (1, (block >> np.uint64(32)).astype(np.uint32), high)):
                    s = syndrome(half)
                    for value in np.unique(s):
                        own = s == value
                        masks = reach(t)[value]
                        keys = (half[own][:, None] ^ masks[None, :]).ravel().astype(np.int64) | which << 32
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(block[own].view(np.int64), len(masks)))], ["anchor", "fp"])

    return run


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        low, high = (fp & np.uint64(0xFFFFFFFF)).astype(np.uint32), (fp >> np.uint64(32)).astype(np.uint32)
        keys = np.concatenate([homes(low).astype(np.int64), homes(high).astype(np.int64) | 1 << 32])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(fp.view(np.int64), 2))], ["anchor", "fp"])


def links(distinct: DataFrame, threshold: int = THRESHOLD, homes_per_block: int = HOMES) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints ``fp`` that chains of at most ``threshold`` bits connect.

    ``distinct`` has one row per fingerprint. Not all linked pairs are listed, but every one is connected.
    """
    if not 1 <= threshold <= 6:
        raise ValueError("the anchors cover thresholds from 1 to 6")
    home = distinct.mapInArrow(_homes, "anchor long, fp long")
    crowded = home.groupBy("anchor").count().where(F.col("count") > homes_per_block)
    block = F.coalesce(F.pmod(F.xxhash64("fp"), F.ceil(F.col("count") / homes_per_block)), F.lit(0))
    blocks = home.join(crowded, "anchor", "left").groupBy("anchor", block.alias("block")).agg(F.collect_list("fp").alias("homes"))
    # some hundred replicas a row: without a spread, a few tasks that read a small table would make them all
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    replica = distinct.repartition(spread, "fp").mapInArrow(_anchored(threshold), "anchor long, fp long")
    # the planner takes the replicas for as small as the fingerprints that they come from and would broadcast them by the driver
    met = replica.join(blocks.hint("merge"), "anchor").select("fp", F.filter("homes", lambda h: (h != F.col("fp")) & (F.bit_count(h.bitwiseXOR(F.col("fp"))) <= threshold)).alias("near")).where(F.size("near") > 0)
    star = met.select(F.array_min("near").alias("v"), F.explode(F.array_append("near", F.col("fp"))).alias("u"))
    return star.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp, component_id: the least doc_id reachable over links, one row per document row.

    Texts without words share fingerprint zero and are linked like any others. Rows with a null id are linked too; a
    component of such rows only has a null id. Repeated rows stay repeated. Very long texts are hashed a piece at a
    time. A tie between two texts of one id goes to the lesser key. Other columns are never read. An empty table gives no
    rows.
    """
    prints = durable(fingerprint_table(docs, id_col, text_col, k))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    groups = connected_components(links(distinct.select("fp"), threshold)).toDF("fp", "root")
    rooted = distinct.join(groups, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = durable(rooted.join(smallest, "root").select("fp", "n", "component_id"))
    return attached(prints, told, ["fp"]).select("doc_id", "text_key", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """One document of each component, the one with the least id, with all its columns; rows with a null id are kept.

    Rows are told apart by id and text: of several texts of the least id in one component the one with the least key
    stays, and of repeated rows one. ``groups`` (doc_id, text_key, component_id) replaces ``near_duplicates``.
    """
    found = (near_duplicates(docs, id_col, text_col) if groups is None else groups).where("doc_id = component_id")
    each = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    one = each.groupBy("doc_id").agg(F.min_by(F.struct("text_key", "n"), "text_key").alias("k")).select(F.col("doc_id").alias("k_id"), "k.text_key", "k.n")
    keep = durable(one)
    names = docs.columns
    own = docs.toDF(*[f"c{k}" for k in range(len(names))])  # own names, so that none can clash
    doc, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    same = (doc == F.col("k_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("text_key"))
    kept = own.join(keep.where("n = 1"), same, "left_semi")
    if not keep.where("n > 1").isEmpty():  # only repeated rows are compared whole
        kept = kept.unionByName(own.join(keep.where("n > 1"), same, "left_semi").dropDuplicates([f"c{names.index(id_col)}"]))
    return kept.unionByName(own.where(doc.isNull())).toDF(*names)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
