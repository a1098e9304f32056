"""The pipeline on a small folder of planted cases, stage by stage and as a whole."""

import random
import zlib

import pytest

import corpus_pipeline
from stepweave.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SECRET, SAMPLE = "Zx9QwErTy12345678AbCdEf", "Demo0Key1For2Docs3abcdef"


def prose(r, n):
    return " ".join(r.choice("the a one of and to in it was for on are with his they at be this from have".split()) + str(r.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    item = " ".join(f"question{k}" for k in range(30))
    texts = {k: prose(r, 60) for k in range(20)}
    texts |= {20: texts[3], 21: texts[4], 22: None, 23: "", 24: "123 456 --", 25: prose(r, 40) + " " + item, 26: prose(r, 200) + " " + " ".join(item.split()[:8]) + " end", 27: prose(r, 60) + f" token={SECRET}"}
    texts |= {k: prose(r, 60) + f" key {SAMPLE}" for k in (28, 29, 30)}
    texts |= {31: prose(r, 5000)}
    rows = [(k, t, "en", f"s{k}", len(t or "")) for k, t in texts.items()] + [(0, texts[0], "en", "s0", len(texts[0])), (None, prose(r, 30), None, None, None)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts


def test_stages_in_turn(spark, folder, tmp_path):
    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
    language, unique, clean, masked = seen
    assert set(texts) - set(language) == {22, 23, 24}
    assert set(language) - set(unique) == {20, 21} and None in unique
    assert set(unique) - set(clean) == {25} and "question1 " not in clean[26] and clean[26].endswith(" end")
    assert SECRET not in masked[27] and "<secret>" in masked[27] and all(SAMPLE in masked[k] for k in (28, 29, 30))
    assert {k for k in masked if masked[k] != clean[k]} == {27}


def test_whole_pipeline(spark, folder):
    from stepweave.llm.tokens import vocabulary
    from tokenizers import Tokenizer

    sf_dir, texts = folder
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == (set(texts) - {20, 21, 22, 23, 24, 25}) | {None}
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    ids = [*Tokenizer.from_file(vocabulary()).encode(texts[31], add_special_tokens=False).ids, 0]
    own = sorted((r for r in got if r.doc_id == 31), key=lambda r: r.piece)
    assert [(r.start, r.length, r.ids_crc32) for r in own] == [(a, len(ids[a : a + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + 2048]))) for a in range(0, len(ids), 2048)]


def test_an_empty_table_goes_through(spark, folder, tmp_path):
    sf_dir, _ = folder
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered_once():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_oracles(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    view = lambda d: sorted(repr([None if v is None or v != v else v for v in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert view(got) == view(want)


def test_near_copies_of_similarity_0_8_go(spark):
    r = random.Random(9)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    texts = [prose(r, n) for n in (40, 80, 150, 400) for _ in range(5)]
    for t in texts[:20]:
        for edits in (1, 2, 4, 6, 9):
            words = t.split()
            for k in r.sample(range(len(words)), edits):
                words[k] = f"changed{r.randint(0, 10**6)}"
            texts.append(" ".join(words))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {k for k in range(len(texts)) if root[k] == k} and len(kept) < len(texts) - 30
