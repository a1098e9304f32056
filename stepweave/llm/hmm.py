"""Language-model scoring with a hidden Markov model over word classes.

*Model.* A text is the sequence of its words' classes and one end symbol. Latent states emit classes; a class emits its
words by their smoothed counts in the training texts, one unseen word a class included. So the score is a probability
over all texts, and every distinct training word counts, however many there are: only the classes are bounded
(``CLASSES``, a hash of a word's first two and last three bytes), not the vocabulary.

*Training.* Word counts are pre-aggregated per task, then summed by word. States start from Baum-Welch on a bounded
sample (the ``START_DOCS`` training texts whose ids hash lowest); then rounds of Baum-Welch go over all training texts, each
task emitting expected counts that are summed across partitions by (state, class), until a round gains less than
``GAIN`` nats a token, ``ROUNDS`` at most. Long texts are trained on in segments of ``SEGMENT`` transitions, all of them;
neighbouring segments share a token, so that no transition is lost, and its emission counts once.

*Scoring.* The scaled forward recursion runs over each whole text, longest texts first in a batch with the active ones
as a shrinking prefix. The counts of words come in two ways: the ``HEAD`` most frequent words are broadcast, all other
tokens are joined with the count table by word; such a word holds at most one in ``HEAD`` of all tokens, so no key is hot.

Rows: null text is empty, i.e. the end symbol alone; null ids count as not held out but are not learnt from; repeated
rows each get their row (and train repeatedly); very long texts are scored whole; words of one count are alike, so ties don't
matter; other columns, whatever their names, are never read; without training texts all counts are zero; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import LOWER, load, picked, slices, text_bytes, words_of
from stepweave.plans.durable import durable, fresh_path

CLASSES, STATES, SEGMENT = 4096, 8, 256
ROUNDS, GAIN = 12, 0.002
START_DOCS, START_ROUNDS = 400, 12
#: Longer ones (bytes of classes, two a word) are no part of the starting sample, which is on the driver.
START_BYTES = 1 << 17
HEAD = 1 << 18
FLUSH = 400_000
END = CLASSES  # the end symbol's class


def classes_of(words: pa.Array) -> np.ndarray:
    """The class of each word."""
    raw, at = text_bytes(words)
    if len(at) == 1:
        return np.zeros(0, np.int16)
    byte = np.frombuffer(raw, np.uint8)
    first, last = at[:-1], at[1:] - 1
    value = np.zeros(len(first), np.uint64)
    for place in (first, np.minimum(first + 1, last), np.maximum(last - 2, first), np.maximum(last - 1, first), last):
        value = value * np.uint64(257) + byte[place]
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int16)


@dataclass
class States:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # (CLASSES + 1) x K


def blocks(sequences: list[np.ndarray], limit: int = 1024) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences of like length, padded: their numbers (longest first), the symbols, the lengths."""
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    at = 0
    while at < len(order):
        longest = max(1, len(sequences[order[at]]))
        take = order[at : at + max(1, min(limit, (1 << 20) // longest))]
        lengths = np.array([len(sequences[k]) for k in take])
        table = np.zeros((len(take), longest), np.int16)
        for row, k in enumerate(take):
            table[row, : lengths[row]] = sequences[k]
        yield take, table, lengths
        at += len(take)


def forward(model: States, table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each padded sequence."""
    active = np.searchsorted(-lengths, -np.arange(table.shape[1]), "left")
    total = np.zeros(len(table))
    a = model.start * model.emit[table[:, 0]]
    for t in range(table.shape[1]):
        n = active[t]
        if t:
            a = (a[:n] @ model.move) * model.emit[table[:n, t]]
        s = a.sum(axis=1)
        total[:n] += np.log(s)
        a /= s[:, None]
    return total


def expected(model: States, table: np.ndarray, lengths: np.ndarray, heads: np.ndarray) -> tuple[States, float]:
    """Baum-Welch counts and log-likelihood of padded segments; ``heads`` marks those that begin a text.

    Any other one's first symbol is the last of the segment before it: it leads into a transition, and counts there.
    """
    width, count = table.shape[1], model.start.size
    active = np.searchsorted(-lengths, -np.arange(width), "left")
    alpha, scale = np.zeros((width, len(table), count)), np.ones((width, len(table)))
    prior = np.where(heads[:, None], model.start, 1.0 / count)
    for t in range(width):
        n = active[t]
        a = (prior if t == 0 else alpha[t - 1, :n] @ model.move) * model.emit[table[:n, t]]
        scale[t, :n] = a.sum(axis=1)
        alpha[t, :n] = a / scale[t, :n, None]
    beta, move = np.ones((len(table), count)), np.zeros((count, count))
    gamma = alpha
    first = None
    for t in range(width - 1, -1, -1):
        n = active[t]
        if t + 1 < width:
            m = active[t + 1]
            ahead = beta[:m] * model.emit[table[:m, t + 1]] / scale[t + 1, :m, None]
            move += alpha[t, :m].T @ ahead
            beta[:m] = ahead @ model.move.T
        gamma[t, :n] *= beta[:n]
        first = gamma[t]
    held = np.arange(width)[:, None] < lengths[None, :]
    held[0] &= heads
    symbols, weight = table.T[held], gamma[held]
    emit = np.stack([np.bincount(symbols, weight[:, k], CLASSES + 1) for k in range(count)], axis=1)
    return States(first[heads].sum(axis=0), move * model.move, emit), float(np.log(scale[held]).sum())


def segments(sequences: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [(s[a : a + SEGMENT + 1], a == 0) for s in sequences for a in range(0, max(1, len(s) - 1), SEGMENT)]
    return [p for p, _ in parts], np.array([h for _, h in parts], bool)


def counted(model: States, sequences: list[np.ndarray]) -> tuple[States, float]:
    parts, heads = segments(sequences)
    total, likely = States(*(np.zeros_like(x) for x in (model.start, model.move, model.emit))), 0.0
    for take, table, lengths in blocks(parts):
        own, log = expected(model, table, lengths, heads[take])
        total, likely = States(total.start + own.start, total.move + own.move, total.emit + own.emit), likely + log
    return total, likely


def maximised(counts: States, share: np.ndarray) -> States:
    """Smoothed: every state keeps some of the classes' overall ``share``, so nothing has probability zero."""
    start, move = counts.start + 1.0, counts.move + 1.0
    emit = counts.emit + 50.0 * share[:, None]
    return States(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def initial(sequences: list[np.ndarray], share: np.ndarray, seed: int = 3) -> States:
    """From the bounded sample: each text starts in a state of its own choosing, then Baum-Welch."""
    noise = np.random.default_rng(seed).gamma(1.0, size=(CLASSES + 1, STATES))
    emit = share[:, None] * noise
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    model = States(np.full(STATES, 1.0 / STATES), move, emit / emit.sum(axis=0))
    for _ in range(START_ROUNDS if sequences else 0):
        model = maximised(counted(model, sequences)[0], share)
    return model


def word_counts(docs: DataFrame) -> DataFrame:
    """w, c of the words of ``text``, pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush():
            merged = pa.concat_tables(held).group_by("w").aggregate([("c", "sum")])
            return pa.table({"w": merged.column("w"), "c": merged.column("c_sum")})

        for batch in slices(batches):
            _, flat = words_of(batch.column("text"), LOWER)
            found = pc.value_counts(flat)
            held.append(pa.table({"w": found.field("values"), "c": found.field("counts")}))
            size += len(found)
            if size > 2 * FLUSH:
                held = [flush()]
                size = held[0].num_rows
                if size > FLUSH:
                    yield from held[0].to_batches(20_000)
                    held, size = [], 0
        if held:
            yield from flush().to_batches(20_000)

    return docs.mapInArrow(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = HEAD) -> pa.Table:
    """The words whose count is in the highest classes of counts that hold at most ``most`` words together.

    Sixteen classes an octave, so their table is small whatever the vocabulary; no task sends more than it has to.
    """
    octave = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(octave.alias("o")).count().collect()), reverse=True)
    least, held = None, 0
    for o, n in sizes:
        held += n
        if held > most:
            break
        least = o
    return counts.where(octave >= least if least is not None else F.lit(False)).select("w", "c").toArrow().sort_by("w")


def encoded(rows: DataFrame, head: pa.Table) -> DataFrame:
    """Per text: its classes, the head words' share of the sums, and all other words, to be joined."""
    words = head.column("w").combine_chunks().cast(pa.large_string())
    logs = np.concatenate([np.log10(head.column("c").to_numpy().astype(float) + 0.5), [0.0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, flat = words_of(batch.column("text"), LOWER)
            coded = flat.dictionary_encode()
            index = coded.indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), len(words)).to_numpy()
            kind = classes_of(coded.dictionary)[index]
            where = place[index] if len(index) else index
            known = where < len(words)
            tail = np.flatnonzero(~known)
            cut = np.searchsorted(tail, starts)
            yield pa.RecordBatch.from_pydict({
                "rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "train": batch.column("train"),
                "n_words": pa.array(np.diff(starts)),
                "head_sum": np.array([logs[where[a:b]].sum() for a, b in zip(starts[:-1], starts[1:])]),
                "head_known": np.diff(starts) - np.diff(cut),
                "classes": pa.array([kind[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                "tail": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), coded.dictionary.take(pa.array(index[tail])).cast(pa.string())),
            })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, train boolean, n_words long, head_sum double, head_known long, classes binary, tail array<string>")


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.append(np.frombuffer(x, np.int16), np.int16(END)) for x in column.to_pylist()]


def baum_welch(table: DataFrame, model: States, share: np.ndarray) -> tuple[States, float]:
    """One round over all training texts, and the log-likelihood before it; counts are summed across partitions by cell."""
    size = STATES * (CLASSES + 1 + STATES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for batch in batches:
            for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
                own, log = counted(model, _sequences(part.column("classes")))
                total += np.concatenate([own.start, own.move.ravel(), own.emit.ravel(), [log]])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "value"])

    got = table.where("train").select("classes").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(size + 1)
    total[got.column("cell").to_numpy()] = got.column("value").to_numpy()
    k = STATES
    return maximised(States(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : size].reshape(-1, k)), share), float(total[size])


def class_totals(counts: DataFrame, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, distinct words) of every class in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
        for batch in batches:
            kind = classes_of(batch.column("w"))
            tokens += np.bincount(kind, batch.column("c").to_numpy(), CLASSES)
            words += np.bincount(kind, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(tokens), pa.array(words)], ["class", "tokens", "words"])

    got = counts.mapInArrow(run, "class int, tokens double, words double").groupBy("class").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).toArrow()
    tokens, words = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    place = got.column("class").to_numpy()
    tokens[place], words[place] = got.column("t").to_numpy(), got.column("w").to_numpy()
    tokens[END], words[END] = ends, 1 if ends else 0
    return tokens, words


def scores(docs: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), one row per document row."""
    from stepweave.llm.language_id import held_out

    spark = docs.sparkSession
    rows = picked(docs, doc_id=id_col, text=text_col).select("doc_id", "text", held_out(F.col("doc_id"), folds, fold).alias("held_out")).withColumn("train", F.col("doc_id").isNotNull() & ~F.col("held_out"))
    counts = durable(word_counts(rows.where("train").select("text")))
    ends = rows.where("train").count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    tokens, words = class_totals(counts, ends)
    head = frequent(counts)

    path = fresh_path(spark, "lm-encoded")
    encoded(rows.withColumn("rid", F.monotonically_increasing_id()), head).write.option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    share = (tokens + 0.5) / (tokens.sum() + 0.5 * len(tokens))
    part = min(1.0, 4 * START_DOCS / max(1, ends))  # enough for START_DOCS, so that few rows are ranked
    order = F.xxhash64("doc_id")
    drawn = table.where("train").where(F.pmod(order, F.lit(1 << 50)) < part * (1 << 50)).select("doc_id", "classes", F.length("classes").alias("size"))
    drawn = drawn.orderBy(F.pmod(order, F.lit(1 << 50)), "doc_id", "classes").limit(START_DOCS).where(F.col("size") <= START_BYTES).toArrow()
    model = initial(_sequences(drawn.column("classes")), share)
    before = None
    for _ in range(ROUNDS if ends else 0):
        model, likely = baum_welch(table, model, share)
        if before is not None and likely - before < GAIN * total:
            break
        before = likely

    smoothed = np.log10(tokens + 0.5 * (words + 1))
    end_log, base_log = float(np.log10(ends + 0.5)), float(np.log10(total + 0.5 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 5000) for a in range(0, batch.num_rows, 5000)):
                sequences = _sequences(part.column("classes"))
                likely = np.zeros(len(sequences))
                for take, symbols, lengths in blocks(sequences, 5000):
                    likely[take] = forward(model, symbols, lengths) / np.log(10)
                within = np.array([smoothed[s].sum() for s in sequences])
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("rid", "doc_id", "held_out", "n_words", "head_sum", "head_known")} | {"path_log": likely - within})

    kind = table.schema["doc_id"].dataType.simpleString()
    walked = table.select("rid", "doc_id", "held_out", "n_words", "head_sum", "head_known", "classes").mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_words long, head_sum double, head_known long, path_log double")
    tail = table.select("rid", F.explode("tail").alias("w")).join(counts, "w", "left")
    sums = tail.groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_sum"), F.count("c").alias("tail_known"))
    joined = walked.join(sums, "rid", "left")
    count_log = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + end_log
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + int(ends > 0)
    n = F.col("n_words") + 1
    return joined.select("doc_id", "held_out", n.alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (count_log - n * base_log).alias("base_score"), (F.col("path_log") + count_log).alias("score"))


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scores(load(spark, sf_dir, "documents"))
