"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

A text is lower-cased (A-Z), its ASCII non-letters become spaces, and its byte bigrams and trigrams are hashed into ``DIM``
counts; square-rooted counts times inverse document frequency, scaled to length one, are its vector. Each language has
up to ``CENTROIDS`` centroids from spherical k-means. A text gets the language of the centroid with the largest cosine
and is rejected when that cosine is below a share of what nearly all of the language's training texts reach at the text's
length: few n-grams reach little, so the floor is fitted for pieces cut from training texts, of each power of two of bytes, too.

The classifier is fitted on a bounded sample: about ``SAMPLE`` labelled documents a language, at most ``SAMPLE_ALL`` in
all and of the ``LANGUAGES`` most frequent labels, picked by a hash of their id among all that may be learnt from. Executors
count its n-grams, so the driver gets vectors of bounded size and no text. Prediction reads whole texts of all documents.

Rows: null text or text without a letter is ``und`` with score 0 and rejected; null languages and null ids are not learnt
from (null ids count as not held out); without any labelled document everything is ``und``. Ties go to the language that
sorts first. Repeated rows each get their row; very long texts are counted whole, a piece at a time; other columns, whatever
their names, are never read, and ``accepted`` keeps them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import SMALL_SLICE, bounded, load, picked, slices, text_bytes

DIM = 1 << 13
CENTROIDS = 3
SAMPLE, SAMPLE_ALL, LANGUAGES = 1000, 10_000, 1000
ROUNDS = 10
REJECT_SHARE, REJECT_QUANTILE = 0.4, 0.005
#: Powers of two of n-grams that have a floor of their own; longer texts share the last one.
LEVELS = 13
#: One in so many sampled texts is cut for that.
CUT_EACH = 4
UNKNOWN = "und"
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text that are counted at once: each takes some forty meanwhile.
PIECE = 1 << 18


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # centroids x LEVELS: cosine below which a centroid rejects


def _grams(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashed n-grams, whether they hold more than spaces, bytes that each reaches ahead), bigrams and trigrams."""
    b = byte.astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    yield two * np.uint32(2654435761) >> np.uint32(19), two != 0x2020, 1
    three = b[:-2] << np.uint32(16) | two[1:]
    yield three * np.uint32(2654435761) >> np.uint32(19), three != 0x202020, 2


def counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashed n-gram counts (documents x DIM), some documents at a time, in order. A space stands on both sides of a text."""
    raw, at = text_bytes(column, LETTERS)
    n = len(at) - 1
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + PIECE, "right")) - 1
        last = min(max(last, first + 1), first + 64)
        table = np.zeros((last - first) * DIM, np.int64)
        if last - first == 1 and at[last] - at[first] > PIECE:
            end = int(at[last])
            for a in range(int(at[first]), end, PIECE):
                # n-grams that start in this piece; the text's first and last one see the spaces
                part = raw[a : min(a + PIECE + 2, end)]
                byte = np.frombuffer((b" " if a == at[first] else b"") + part + (b" " if a + PIECE + 1 >= end else b""), np.uint8)
                starts = min(PIECE, end - a) + (a == at[first])
                for slot, real, reach in _grams(byte):
                    use = np.flatnonzero(real[:starts])
                    table += np.bincount(slot[use], minlength=DIM)
        else:
            spaced = b" ".join([b"", *[raw[at[k] : at[k + 1]] + b" " for k in range(first, last)]])
            byte = np.frombuffer(spaced, np.uint8)
            sizes = np.diff(at[first : last + 1]) + 2
            owner = np.repeat(np.arange(last - first, dtype=np.int32), sizes)
            for slot, real, reach in _grams(byte[: len(owner)]):
                use = np.flatnonzero(real & (owner[reach:] == owner[: len(owner) - reach]))
                table += np.bincount(owner[use].astype(np.int64) * DIM + slot[use], minlength=len(table))
        yield table.reshape(-1, DIM)
        first = last


def level(sizes: np.ndarray) -> np.ndarray:
    """Of texts with so many n-grams: the power of two, within what has a floor of its own."""
    return np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), LEVELS - 1)


def vectors(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(table, dtype=np.float32)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def near(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, cosine, whether it is below the centroid's floor) of each text."""
    parts = [(t.sum(axis=1), vectors(t, model.idf) @ model.centroids.T) for t in counts(column)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    sizes, cosines = np.concatenate([s for s, _ in parts]), np.concatenate([c for _, c in parts])
    best = cosines.argmax(axis=1)
    cosine = cosines[np.arange(len(best)), best]
    return best, cosine, cosine < model.least[best, level(sizes)]


Drawn = tuple[str, int, np.ndarray, np.ndarray]


def fit(drawn: list[Drawn]) -> Model:
    """From (language, number of the text's cut or -1 for a whole text, n-grams, their counts), a bounded sample."""
    whole: dict[str, list[Drawn]] = {}
    cuts: dict[str, list[Drawn]] = {}
    for d in drawn:
        (whole if d[1] < 0 else cuts).setdefault(d[0], []).append(d)
    seen, total = np.zeros(DIM), sum(map(len, whole.values()))
    for rows in whole.values():
        for d in rows:
            seen[d[2]] += 1
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def dense(rows: list[Drawn]) -> tuple[np.ndarray, np.ndarray]:
        table = np.zeros((len(rows), DIM), np.float32)
        for k, d in enumerate(rows):
            table[k, d[2]] = d[3]
        return vectors(table, idf), table.sum(axis=1)

    names, centres, least = [], [], []
    for language in sorted(whole):
        x, sizes = dense(whole[language])
        centre = x[np.linspace(0, len(x) - 1, min(CENTROIDS, len(x))).astype(int)]
        for _ in range(ROUNDS):
            own = (x @ centre.T).argmax(axis=1)
            sums = np.stack([x[own == k].sum(axis=0) if (own == k).any() else centre[k] for k in range(len(centre))])
            centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        reached, at = [(x @ centre.T).max(axis=1)], [level(sizes)]
        for a in range(0, len(cuts.get(language, ())), 500):
            part, part_sizes = dense(cuts[language][a : a + 500])
            reached.append((part @ centre.T).max(axis=1))
            at.append(level(part_sizes))
        cosine, levels = np.concatenate(reached), np.concatenate(at)
        floor = np.zeros(LEVELS)
        for k in range(LEVELS):  # a level without training texts takes the floor below it
            known = cosine[levels == k]
            floor[k] = np.quantile(known, REJECT_QUANTILE) * REJECT_SHARE if len(known) else floor[k - 1] if k else 0.0
        names += [language] * len(centre)
        centres.append(centre)
        least += [floor] * len(centre)
    return Model(names, np.concatenate(centres).astype(np.float32), idf, np.array(least))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of whole texts, and of pieces cut from them at each level, at places that the text's number picks."""
    for batch in slices(batches, "t", SMALL_SLICE):
        texts, orders, labels = batch.column("t"), batch.column("o").to_pylist(), batch.column("l").to_pylist()
        raw, at = text_bytes(texts)
        owner, cut, pieces = [*range(batch.num_rows)], [-1] * batch.num_rows, []
        for k, size in enumerate(np.diff(at).tolist()):
            for n in range(LEVELS if orders[k] % CUT_EACH == 0 else 0):
                reach = 1 << n  # bytes; each gives about two n-grams
                if reach >= size:
                    break
                start = int(at[k]) + (orders[k] & 0x7FFFFFFF) % (size - reach + 1)
                pieces.append(raw[start : start + reach].decode(errors="ignore"))
                owner.append(k)
                cut.append(n)
        held, times = [], []
        for column in (texts, pa.array(pieces, pa.large_string())):
            for table in counts(column):
                for own in table:
                    slots = np.flatnonzero(own)
                    held.append(slots.astype("<i2").tobytes())
                    times.append(own[slots].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([labels[k] for k in owner], pa.string()), pa.array(cut, pa.int32()), pa.array([orders[k] for k in owner], pa.int64()), pa.array(held, pa.binary()), pa.array(times, pa.binary())], ["l", "cut", "o", "held", "times"])


def sample(docs: DataFrame, learn: Column, label: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> list[Drawn]:
    """Counts of about SAMPLE texts a label among rows where ``learn`` holds, by a hash of the id."""
    rows = docs.where(learn & F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    per_label = rows.groupBy(F.col(f"`{label}`").cast("string").alias("l")).count().orderBy(F.desc("count"), "l").limit(LANGUAGES)
    sizes = {r[0]: r[1] for r in per_label.collect()}
    if not sizes:
        return []
    each = min(SAMPLE, SAMPLE_ALL // len(sizes))
    shares = docs.sparkSession.createDataFrame([(k, each / n) for k, n in sizes.items()], "l string, share double")
    chosen = picked(rows, l=label, t=text_col, i=id_col).withColumn("l", F.col("l").cast("string")).join(F.broadcast(shares), "l")  # at most LANGUAGES labels
    drawn = chosen.where(F.pmod(F.xxhash64("i"), F.lit(1 << 50)) < F.col("share") * (1 << 50)).select("l", "t", F.xxhash64("i").alias("o"))
    got = drawn.mapInArrow(_counted, "l string, cut int, o long, held binary, times binary").toArrow().sort_by([("l", "ascending"), ("o", "ascending"), ("cut", "ascending"), ("held", "ascending")])
    return [(x, cut, np.frombuffer(held, "<i2"), np.frombuffer(times, "<f4")) for x, cut, held, times in zip(*(got.column(c).to_pylist() for c in ("l", "cut", "held", "times")))]


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SMALL_SLICE):
            has = batch.column("letter").to_numpy(zero_copy_only=False)
            if model is None:
                names, score, low = [UNKNOWN] * len(has), np.zeros(len(has)), np.ones(len(has), bool)
            else:
                best, cosine, low = near(model, batch.column("text"))
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, has)]
                score = np.where(has, np.clip(cosine, 0.0, 1.0), 0.0).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": score, "rejected": ~has | low})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def trained(docs: DataFrame, folds: int = 4, fold: int = 2) -> Model | None:
    rows = sample(docs, ~held_out(F.col("doc_id"), folds, fold))
    return fit(rows) if rows else None


def accepted(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, in one pass."""
    model = model or trained(docs)
    bounded(docs.sparkSession)
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{place}", SMALL_SLICE):
            keep = batch.column(len(names)).to_numpy(zero_copy_only=False)
            if model:
                keep = keep & ~near(model, batch.column(place))[2]
            yield batch.select(list(range(len(names)))).filter(pa.array(keep))

    own = docs.toDF(*[f"c{k}" for k in range(len(names))])  # own names, so that none can clash
    letter = F.coalesce(F.col(f"c{place}").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return own.select("*", letter).mapInArrow(run, own.schema).toDF(*names)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = load(spark, sf_dir, "documents")
    found = identified(docs, trained(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
