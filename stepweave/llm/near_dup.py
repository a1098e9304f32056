"""Near copies for the pipeline: SimHash and banded minima propose, the Jaccard similarity of five-word shingles decides.

Texts of the same words (ASCII case and white space aside) are one *key*. Proposals come from SimHash links and from
``BANDS`` bands of ``ROWS`` minwise hashes, which miss a pair of similarity 0.8 once in ten thousand. Every link is
verified on the whole shingle sets. First each member of a band is compared with the band's least; then all pairs of
a band that are still in different components are, so groups of copies never cost all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import LOWER, SMALL_SLICE, attached, slices, text_bytes
from stepweave.llm.simhash import SEED, fingerprints, keyed, links, shingle_hashes
from stepweave.operators.components import connected_components
from stepweave.plans.durable import durable

WORDS = 5
BANDS, ROWS = 24, 5


def _keys(column: pa.Array) -> pa.Array:
    raw, at = text_bytes(column, LOWER)
    return pa.array(np.array([xxhash.xxh64_intdigest(b" ".join(raw[a:b].split()), SEED) for a, b in zip(at[:-1], at[1:])], np.uint64).view(np.int64))


def bands(column: pa.Array) -> np.ndarray:
    """A row of ``BANDS`` hashes for each text, each of ``ROWS`` minwise hashes of its shingles; zero without words."""
    hashes, counts = shingle_hashes(column, WORDS)
    out = np.zeros((len(counts), BANDS), np.int64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    starts = np.cumsum(counts[has]) - counts[has]
    r = np.random.default_rng(SEED)
    for b in range(BANDS):
        key = np.full(len(has), b, np.uint64)
        for odd, add in r.integers(0, 1 << 64, (ROWS, 2), np.uint64):
            key = (key ^ np.minimum.reduceat(hashes * (odd | np.uint64(1)) + add, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[has, b] = key.view(np.int64)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SMALL_SLICE):
        text = batch.column("text")
        lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS, bands(text).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), _keys(text), pa.array(fingerprints(text).view(np.int64)), lists], ["doc_id", "text_key", "key", "fp", "bands"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SMALL_SLICE):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _keys(batch.column("text")), batch.column("text")], ["doc_id", "key", "text"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key's shingles, once a task: rows of one key and id are in one task, unless a hot one is split."""
    met: set[int] = set()
    for batch in slices(batches, limit=SMALL_SLICE):
        fresh = []
        for at, key in enumerate(batch.column("key").to_pylist()):
            if key not in met:
                met.add(key)
                fresh.append(at)
        batch = batch.take(pa.array(fresh, pa.int64()))
        if not batch.num_rows:
            continue
        hashes, counts = shingle_hashes(batch.column("text"), WORDS)
        own = [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own, pa.list_(pa.int64()))], ["key", "shingles"])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, component_id: the least doc_id reachable over pairs of similarity 0.8 or more, one row per document row.

    Rows with a null id are linked too; a component of such rows only has a null id. Texts without words are alike.
    """
    rows = keyed(docs, id_col, text_col)
    sketches = durable(rows.mapInArrow(_sketched, "doc_id long, text_key long, key long, fp long, bands array<long>"))
    distinct = durable(sketches.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.any_value("bands").alias("bands"), F.count("*").alias("n")))
    stands = distinct.groupBy("fp").agg(F.min("key").alias("stand"))
    linked = links(stands.select("fp"))
    by_print = distinct.join(stands, "fp").select("key", "stand")
    by_link = linked.join(stands.toDF("u", "a"), "u").join(stands.toDF("v", "b"), "v").select("a", "b")
    member = distinct.select("key", F.posexplode("bands").alias("b", "band")).where("band <> 0")
    shared = member.groupBy("b", "band").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    member = durable(member.join(shared, ["b", "band"]).select("b", "band", "key", "first"))
    proposed = by_print.toDF("a", "b").union(by_link).union(member.select("key", "first")).where("a <> b")
    proposed = durable(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    involved = member.select("key").union(proposed.select(F.explode(F.array("a", "b")))).distinct().join(distinct.select("key", "least"), "key").toDF("k", "least")
    texts = rows.mapInArrow(_keyed, "doc_id long, key long, text string")
    texts = texts.join(involved, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = durable(texts.select("key", "text").mapInArrow(_sets, "key long, shingles array<long>"))
    size = sets.select("key", F.size("shingles").alias("n")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        # similarities of 0.8 need sizes within 0.8 of each other: the others are dropped before their sets are joined
        fine = pairs.join(size.toDF("a", "m"), "a").join(size.toDF("b", "n"), "b").where("5 * least(m, n) >= 4 * greatest(m, n)")
        both = fine.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.col("m") + F.col("n"))).select("a", "b").distinct()

    first = durable(verified(proposed))
    root = connected_components(first, "a", "b").toDF("key", "root")
    rooted = durable(member.join(root, "key", "left").select("b", "band", "key", F.coalesce("root", "key").alias("root")))
    mixed = rooted.groupBy("b", "band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("b", "band")
    left = rooted.join(mixed, ["b", "band"])
    right = left.toDF("b", "band", "key2", "root2")
    rest = left.join(right, ["b", "band"]).where("key < key2 and root <> root2").select(F.col("key").alias("a"), F.col("key2").alias("b")).distinct()
    groups = connected_components(first.union(durable(verified(rest.join(proposed, ["a", "b"], "left_anti")))), "a", "b").toDF("key", "root")
    joined = distinct.join(groups, "key", "left").select("key", "least", "n", F.coalesce("root", "key").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    told = durable(joined.join(smallest, "root").select("key", "n", "component_id"))
    return attached(sketches.select("doc_id", "text_key", "key"), told, ["key"]).select("doc_id", "text_key", "component_id")
