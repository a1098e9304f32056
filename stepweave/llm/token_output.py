"""Token-ID / binary output: length-delimited records with masked checksums and a separate offset index.

File format (one ``.rec`` and one ``.idx`` per range of document ids, little-endian throughout)::

    .rec  record*   record = length u64 | masked crc32(length bytes) u32 | payload | masked crc32(payload) u32
    .idx  entry*    entry  = offset of the record i64 | ids in it i64 | doc_id i64 | doc_id is not null u8

The payload is the document's ids, ``width`` bytes each (2 where the vocabulary fits, else 4). The mask is the usual
rotate-by-15-and-add, so that a checksum of data that embeds checksums stays useful. The index allows shuffled reads:
any record can be read by one seek.

Writing survives lost executors: a task writes under a name of its own attempt and the manifest, which is made
durable, names the files that count; files of lost attempts are never read.

Rows: null text is empty (one end id); rows come in ascending ``doc_id`` (null first), ties by text; repeated rows are
repeated records; an empty table gives an empty manifest.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import load, picked, slices
from stepweave.llm.tokens import Encoder, vocabulary
from stepweave.plans.durable import durable, fresh_path

INDEX = np.dtype([("offset", "<i8"), ("n", "<i8"), ("doc_id", "<i8"), ("valid", "u1")])
MANIFEST = "first_id long, path string, width int, records long, ids long, bytes long"
END_ID = 1


class BadRecord(ValueError):
    """A record's checksum or length disagrees with its bytes."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(read) -> bytes:
    """The next payload of ``read(n)``, checked."""
    head = read(12)
    if len(head) != 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise BadRecord("length and its checksum disagree")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) != size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise BadRecord("payload and its checksum disagree")
    return body[:size]


def filesystem(uri: str):
    """(filesystem, path) of a URI or plain path."""
    from pyarrow import fs

    uri = uri if "://" in uri else "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)  # the same store under the JVM's name for it


def write_records(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents below ``uri``; returns the durable manifest, one row per file.

    The shuffle carries the texts once, by ranges of ``doc_id``; encoding follows it, so each text is encoded once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        kind = np.dtype(f"<u{encoder.width}")
        store, root = filesystem(uri)
        name, out, index, at, first = f"part-{uuid.uuid4().hex}", None, [], 0, None
        for batch in slices(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.rec")
            starts, ids = encoder.encode(batch.column("text"))
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                payload = np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id)).astype(kind)
                index.append((at, len(payload), doc or 0, doc is not None))
                first = doc if len(index) == 1 else first
                at += out.write(framed(payload.tobytes()))
        if out is not None:
            out.close()
            entries = np.array(index, INDEX)
            with store.open_output_stream(f"{root}/{name}.idx") as side:
                side.write(entries.tobytes())
            yield pa.RecordBatch.from_pydict({"first_id": pa.array([first], pa.int64()), "path": [f"{uri}/{name}"], "width": pa.array([encoder.width], pa.int32()), "records": [len(index)], "ids": [int(entries["n"].sum())], "bytes": [at]})

    rows = picked(docs, doc_id=id_col, text=text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return durable(ordered.mapInArrow(write, MANIFEST))


def read_index(path: str) -> np.ndarray:
    store, at = filesystem(f"{path}.idx")
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), INDEX)


def read_record(path: str, width: int, entry: np.void) -> np.ndarray:
    """One record by its index entry: the shuffled read."""
    store, at = filesystem(f"{path}.rec")
    with store.open_input_file(at) as f:
        f.seek(int(entry["offset"]))
        return np.frombuffer(unframed(f.read), f"<u{width}").astype(np.uint32)


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record, checked: doc_id, start (ids in all records before it), n_tokens, ids_crc32, path, position.

    The manifest has a row per file, a number that the write's partitions bound, so its running sum is made in one
    place; the records themselves are read file by file on the executors.
    """
    files = [r for r in manifest.collect() if r["records"]]
    files.sort(key=lambda r: (r["first_id"] is not None, r["first_id"] or 0))
    bases, total = [], 0
    for k, r in enumerate(files):
        bases.append((k, r["path"], r["width"], total))
        total += r["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = read_index(row["path"])
                store, at = filesystem(f"{row['path']}.rec")
                starts = row["base"] + np.cumsum(index["n"]) - index["n"]
                crc = np.empty(len(index), np.int64)
                with store.open_input_stream(at, buffer_size=1 << 20) as f:
                    for k in range(len(index)):
                        ids = np.frombuffer(unframed(f.read), f"<u{row['width']}").astype("<u4")
                        if len(ids) != index["n"][k]:
                            raise BadRecord("index and record disagree")
                        crc[k] = zlib.crc32(ids.tobytes())
                for a in range(0, len(index), 50_000):
                    part = index[a : a + 50_000]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.ascontiguousarray(part["doc_id"]), mask=part["valid"] == 0), "start": starts[a : a + 50_000], "n_tokens": np.ascontiguousarray(part["n"]), "ids_crc32": crc[a : a + 50_000], "path": pa.array([row["path"]] * len(part)), "position": pa.array(np.arange(a, a + len(part)))})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, path string, position long"
    table = spark.createDataFrame(bases, "k int, path string, width int, base long")
    return table.repartition(max(1, len(bases)), "k").mapInArrow(read, schema)


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as records in ascending doc_id order, then read the files back."""
    manifest = write_records(load(spark, sf_dir, "documents"), fresh_path(spark, "token-records"), vocabulary())
    return read_records(spark, manifest).drop("path", "position")
