"""Exact round trips against the tokenizers library, record framing, and packing validity."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepweave.llm import packing, token_output
from stepweave.llm.tokens import Encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, start string"
ODD = [None, "", " \t\n", "Don't stop, it's THE end.", "a" * 9000, "<|endoftext|> x<|ENDOFTEXT|>", "H̱.T̈,J̌! İstanbul ΣΣ", "café... ®. x², 12,345.6", "\x00\x1c\x85  z", "word " * 4000]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbthe.,;:!?'sS 12\n\t<|>̱́é"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_encoder_equals_the_library(texts):
    starts, ids = Encoder.at(vocabulary()).encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == library_ids(text)


def test_plain_words_cost_no_python_calls():
    import cProfile
    import pstats

    r, encoder = random.Random(2), Encoder(vocabulary())
    words = list({"".join(r.choices("abcdefghijklmnoprstuvwz", k=8)) for _ in range(20_000)})
    text = " ".join(w.title() + r.choice(["", ",", "..."]) for w in words)
    profile = cProfile.Profile()
    _, ids = profile.runcall(encoder.encode, pa.array([text]))
    assert ids.tolist() == library_ids(text)
    assert pstats.Stats(profile).total_calls < len(words)


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr("stepweave.llm.tokens.CACHE_STEMS", 30)
    r, encoder = random.Random(4), Encoder(vocabulary())
    words = [w for text in ODD if text for w in text.split()] + [f"naïve{k}" for k in range(40)] + ["Größe,", "été?!", "plain", "words;"] * 5
    for _ in range(60):
        texts = [" ".join(r.choices(words, k=r.randint(0, 12))) for _ in range(3)]
        starts, ids = encoder.encode(pa.array(texts))
        assert [ids[starts[k] : starts[k + 1]].tolist() for k in range(3)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.names) <= 30 + 2 * 36


def test_records_round_trip(spark, tmp_path):
    rows = [(k if k != 3 else None, t, "x", "clash") for k, t in enumerate(ODD)] + [(1, "", "x", "")]
    manifest = token_output.write_records(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}", vocabulary())
    got = token_output.read_records(spark, manifest).orderBy("start").collect()
    want, start = [], 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library_ids(text) + [1]
        want.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    r = got[5]
    assert len(token_output.read_record(r.path, 2, token_output.read_index(r.path)[r.position])) == r.n_tokens


def test_damage_is_found(spark, tmp_path):
    manifest = token_output.write_records(spark.createDataFrame([(1, "some words", "", "")], SCHEMA), f"file://{tmp_path}", vocabulary()).collect()
    path = manifest[0].path + ".rec"
    raw = bytearray(open(path[7:], "rb").read())
    raw[14] ^= 1
    open(path[7:], "wb").write(raw)
    with pytest.raises(token_output.BadRecord):
        token_output.read_record(manifest[0].path, 2, token_output.read_index(manifest[0].path)[0])


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_output.read_records(spark, token_output.write_records(empty, f"file://{tmp_path}", vocabulary())).count() == 0
    assert packing.pack(packing.pieces(empty, vocabulary())).count() == 0


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_cuts_and_fills(spark):
    rows = [(k, t, "x", "clash") for k, t in enumerate(ODD)] + [(0, None, None, None)] * 2 + [(None, "x y", None, None)]
    got = packing.pack(packing.pieces(spark.createDataFrame(rows, SCHEMA), vocabulary(), 64), 64, 40).collect()
    check_packing(got, 64)
    own = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.piece)
    ids = library_ids(ODD[4]) + [0]
    assert [(r.start, r.length) for r in own] == [(a, len(ids[a : a + 64])) for a in range(0, len(ids), 64)]
    assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()) for a in range(0, len(ids), 64)]
    assert sum(r.length for r in got) == sum(len(library_ids(r[1])) + 1 for r in rows)


def test_cutting_costs_a_checksum_a_piece(monkeypatch):
    import cProfile
    import pstats

    made = []
    monkeypatch.setattr(packing, "picked", lambda docs, **_: docs)
    docs = type("Docs", (), {"mapInArrow": lambda self, run, schema: made.append(run)})()
    packing.pieces(docs, vocabulary(), 4)
    texts = ["a b c d e f g h i"[: k % 18] for k in range(6000)] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(6000)], pa.int64()), "text": pa.array(texts)})
    Encoder.at(vocabulary()).encode(batch.column("text"))
    profile = cProfile.Profile()
    got = [r for b in profile.runcall(lambda: list(made[0](iter([batch])))) for r in b.to_pylist()]
    want = []
    for doc, text in zip([None, *range(6000)], texts):
        ids = [*Encoder.at(vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 4)):
            part = ids[at : at + 4]
            want.append({"doc_id": doc, "piece": k, "start": at, "length": len(part), "ids_crc32": zlib.crc32(np.array(part, "<u4").tobytes())})
    assert got == want
    assert pstats.Stats(profile).total_calls < 1.5 * len(want)


@pytest.mark.parametrize("seed", range(6))
def test_local_search_never_worsens(seed):
    r = random.Random(seed)
    lengths = np.array([r.choice([r.randint(1, 100), r.randint(40, 60), 34]) for _ in range(400)])
    first = packing.best_fit(lengths, 100)
    after = packing.local_search([list(x) for x in first], lengths, 100)
    assert sorted(x for items in after for x in items) == list(range(400))
    assert all(lengths[items].sum() <= 100 for items in after)
    assert len(after) <= len(first)
    assert sum(int(lengths[i].sum()) ** 2 for i in after) >= sum(int(lengths[i].sum()) ** 2 for i in first)


def test_swaps_empty_a_bin():
    lengths = np.array([6, 3, 5, 4, 1, 1])  # in threes of ten: 6+3, 5+4, 1+1 fits in two bins
    assert len(packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 10)) == 2


def fewest(lengths, size):
    """The least number of bins, by trying all placements up to symmetry."""
    order, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(order):
            best[0] = len(rooms)
            return
        for b in range(len(rooms)):
            if rooms[b] >= order[k] and rooms[b] not in rooms[:b]:
                place(k + 1, [*rooms[:b], rooms[b] - order[k], *rooms[b + 1 :]])
        place(k + 1, [*rooms, size - order[k]])

    place(0, [])
    return best[0]


def test_packing_of_few_pieces_is_nearly_always_the_least():
    r, least, got = random.Random(1), 0, 0
    for _ in range(120):
        lengths = np.array([r.randint(1, 30) for _ in range(r.randint(1, 11))])
        bins = packing.local_search(packing.best_fit(lengths, 40), lengths, 40)
        assert sorted(x for items in bins for x in items) == list(range(len(lengths))) and all(lengths[i].sum() <= 40 for i in bins)
        least, got = least + fewest(lengths.tolist(), 40), got + len(bins)
    assert got <= 1.005 * least


@pytest.mark.parametrize("lengths", [[3] * 20_000, [0] * 5, [1025] * 3000, [*range(1, 60)] * 300, [700, 650, 690] * 2000])
def test_search_ends_soon_on_like_pieces(lengths):
    import time

    lengths = np.array(lengths)
    start = time.time()
    bins = packing.local_search(packing.best_fit(lengths, 2048), lengths, 2048)
    assert time.time() - start < 20 and sorted(x for items in bins for x in items) == list(range(len(lengths)))
