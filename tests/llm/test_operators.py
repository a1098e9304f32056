"""The ten operators against brute force on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stepweave.llm import ann, decontaminate, hmm, language_id, near_dup, secrets, simhash, suffix_dedup, url_filter
from stepweave.operators import components as components_module

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, spans string, rid string"


def low(text):
    return (text or "").encode().translate(LOWER).decode()


def table(spark, texts, langs=None, sources=None):
    rows = [(k, t, langs[k] if langs else "en", sources[k] if sources else f"s{k % 3}", 0, "clash", None, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [f"{r.choice('bcdfgl')}{r.choice('aeiouéü')}{r.choice('nrst')}{k % 17}" for k in range(120)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 30, 120, 400]))) for _ in range(n)]
    texts += [texts[4], texts[4], texts[5] + " tail", texts[6].upper(), None, "", " \t\n", "...!", "a", "A" * 3000, "ab" * 2000]
    texts += [texts[k] + " " + texts[k + 1][:90] for k in range(8)]
    return texts


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints, ids, threshold):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(prints))]


def test_simhash_against_all_pairs(spark):
    texts = corpus()
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    want = components(prints, range(len(texts)), 4)
    assert [got[k].fp % 2**64 for k in range(len(texts))] == prints
    assert [got[k].component_id for k in range(len(texts))] == want


def test_simhash_links_take_no_rounds_while_they_are_few(spark, monkeypatch):
    cuts, cut = [], components_module.durable
    monkeypatch.setattr(components_module, "durable", lambda df: cuts.append(1) or cut(df))
    texts = corpus()[-20:]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert [got[k] for k in range(20)] == components([fingerprint(t) for t in texts], range(20), 4) and len(cuts) == 2


@pytest.mark.parametrize("threshold,block", [(4, 2048), (3, 2), (1, 2048), (6, 3)])
def test_anchors_cover_every_close_pair(spark, threshold, block):
    r = random.Random(threshold)
    base = [r.getrandbits(64) for _ in range(8)]
    prints = sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 9))) for b in base for _ in range(25)} | {0, 2**64 - 1})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), threshold, block)
    found = {r.node: r.component for r in simhash.connected_components(edges).collect()}
    assert [found.get(p, p) for p in signed] == components(prints, signed, threshold)


def test_replicas_are_never_broadcast(spark):
    edges = simhash.links(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "SortMergeJoin [anchor" in plan


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    docs = table(spark, corpus()).unionByName(table(spark, ["solo words here now please"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(table(spark, corpus()).where("doc_id < 3"))
    docs = docs.withColumn("__kept", F.lit(1)).withColumn("component_id", F.lit("clash"))
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    want = set(components([fingerprint(t) for t in corpus()], range(len(corpus())), 4))
    assert len(got) == len(set(got)) and set(got) == want | {None}
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_deduplicated_tells_rows_of_one_id_apart(spark):
    r = random.Random(6)
    a, b, c = (" ".join(f"{x}{r.randint(0, 999)}" for _ in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (7, c.upper()), (8, c + " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for found in (simhash.deduplicated(docs), simhash.deduplicated(docs, groups=near_dup.near_copies(docs))):
        got = sorted((x.doc_id, x.text.lower()) for x in found.collect())
        assert got == [(1, a), (5, b), (7, c)]


def test_decontamination_against_windows(spark):
    items = ["one two three four five six seven eight nine ten", "short item", "x y z", None, "...", "four five six seven eight nine ten eleven", "é b c d e f g h é b c d e f g h i", "東京\u3000大阪 x", "nbsp\u00a0word alone", "\u0085", "line\x1cfeed \u2003 em"]
    texts = ["zz ONE, two three-four five six seven eight nine ten eleven!", "a short item", "x y x y z", None, "", "é b c d e f g h é b c d e f g h é b c", "one two three", "short short item item " * 50, "see 東京\u3000大阪 x!", "東京 大阪 x", "Nbsp\u00a0word, alone nbsp word alone", "a \u0085 b", "line feed \u2003 em line\x1cfeed \u2003 em"]
    got = {r.doc_id: r for r in decontaminate.findings(table(spark, texts), spark.createDataFrame(list(enumerate(items)) + [(None, "x y z"), (1, "short item")], "item_id long, text string")).withColumn("n_hit", decontaminate.covered(F.col("spans"))).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    for k, t in enumerate(texts):
        w, hit, names = words(t), set(), set()
        for name, item in enumerate(items):
            v = words(item)
            size = min(8, len(v))
            for a in range(len(v) - size + 1 if v else 0):
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == v[a : a + size]:
                        hit.update(range(b, b + size))
                        names.add(str(name))
        assert (got[k].n_words, got[k].n_hit, got[k]["items"]) == (len(w), len(hit), sorted(names)), k


@pytest.mark.parametrize("shard_words,at_once", [(40, 4), (30, 1), (15, 2)])
def test_decontamination_in_shards_is_the_same(spark, monkeypatch, shard_words, at_once):
    monkeypatch.setattr(decontaminate, "SHARDS", at_once)
    rows = [(k, f"w{k} w{k + 1} w{k + 2} w{k + 3} w{k + 4} w{k + 5} w{k + 6} w{k + 7} w{k + 8}") for k in range(12)] + [(99, "a\u3000b c")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts = [" ".join(f"w{k}" for k in range(25)), "w1 w2", None, "", "x a\u3000b c y", "a b c", "zz " * 40 + rows[3][1].rsplit(" ", 1)[0]] * 3
    docs = table(spark, texts).withColumn("rid", F.lit("clash")).unionByName(table(spark, ["w1 w2"]).withColumn("doc_id", F.lit(None).cast("long")))
    view = lambda f: sorted((r.doc_id is None, r.doc_id, r.n_words, r["items"], r.n) for r in f.withColumn("n", decontaminate.covered(F.col("spans"))).collect())
    one = view(decontaminate.findings(docs, items))
    assert one == view(decontaminate.findings(docs, items, shard_words=shard_words)) and len(one) == 22
    kept = lambda w: sorted((r.doc_id is None, r.doc_id, r.text or "", r.rid) for r in decontaminate.decontaminated(docs, items, shard_words=w).collect())
    assert kept(10**6) == kept(shard_words)


def test_decontaminated_texts(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = table(spark, ["clean text stays as it is", "before " * 40 + " ".join(passage.split()[:8]) + ", after", "long " * 50 + passage, None])
    got = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert got == {0: "clean text stays as it is", 1: "before " * 40 + ", after", 3: None}
    assert decontaminate.decontaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 4


def test_secrets_base_and_ownership(spark):
    own, shared = "Zx9QwErTy12345678AbCdEf", "Sample0Key1For2Docs3abcd"
    texts = ["pass" + "word: token: abcdefghijkl Token='abcdefgh' API_KEY=x", f"é🙂 secret = {own} AKIA" + "A" * 12, None, "", f"see {shared} and {own[:5]}", f"{shared}", f"{shared} " + "f" * 40, "AKIA" + "B" * 11]
    docs = table(spark, texts, sources=["a", "b", "c", "c", "c", "d", "e", "f"])
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    rules = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    for k, t in enumerate(texts):
        want = sorted((m.start(), n, m.end(), kind) for n, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m))
        assert [(x.s, x.rank, x.e, x.kind) for x in got[k].spans if x.kind != "owned"] == want, k
        assert [got[k][f"n_{kind}"] for kind, *_ in rules] == [sum(w[3] == kind for w in want) for kind, *_ in rules]
    assert not any(x.kind == "owned" for k in (4, 5, 6) for x in got[k].spans)  # three owners: an example
    masked = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert masked[5] == shared and masked[2] is None and masked[1] == "é🙂 <secret> <secret>"
    assert secrets.secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("marks", [200_000, 0])
def test_secrets_of_repositories_and_owners(spark, monkeypatch, marks):
    monkeypatch.setattr(secrets, "MARKS", marks)
    values = [f"Aq{k}WsEdRfTgYhUj9xZcVb{k}" for k in range(4)]
    holders = [(0, "o1", f"r{k}") for k in range(9)] + [(1, f"o{k % 2}", f"r{k}") for k in range(6)] + [(2, f"o{k}", f"r{k}") for k in range(2)] + [(3, f"o{k}", "r") for k in range(3)]
    rows = [(k if k % 4 else None, f"key {values[v]} end", owner, repo, "c", "c") for k, (v, owner, repo) in enumerate(holders)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string, spans string, __key string")
    live = {r.text.split()[1] for r in docs.collect()} - {r.text.split()[1] for r in secrets.redacted(docs, owner_col="owner", repo_col="repo").collect()}
    assert live == {values[0], values[2]}  # one owner however many repositories; two owners of two repositories, not of six
    assert secrets.redacted(docs, owner_col="owner", repo_col="repo").columns == docs.columns and secrets.redacted(docs, owner_col="owner", repo_col="repo").count() == len(rows)
    assert secrets.secrets(docs.limit(0), owner_col="owner", repo_col="repo").count() == 0


def test_url_filter_rules_and_oracle(spark):
    urls = [None, "", "no scheme", "http://A.com", "http://a.COM/", "x://www.example.com/en/1?q=://b.net/es/", "https://sub.example.com/en/x#f", "http://example.com/EN/", "http://n.net/es/1/2/3/4/5", "http://n.net/fr", "http://net/fr/a.HTML", "//x", "http://notexample.com/en/a", "http://q.org/es/77", "http:///path", "a://b://c.com/x"]
    pages = spark.createDataFrame([(k % 16, u, "x", "clash") for k, u in enumerate(urls * 2)] + [(None, "http://n.net/es/q/r/s/t/u", None, None)], "page_id long, url string, html string, host string")
    got = url_filter.judged(pages).select("page_id", "host", "path", "rule", "verdict", "template").toPandas()
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(url_filter.OP4_SQL).df()
    view = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
    assert view(got) == view(want)
    by = {r.page_id: r for r in got.itertuples()}
    assert (by[3].host, by[3].path, by[3].rule) == ("a.com", "", None) and by[5].rule == "www.example.com/en/" and by[6].rule == "example.com/en/"
    assert url_filter.judged(pages.limit(0)).count() == 0


def judge_urls(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.page_id: r for r in url_filter.judged(pages).collect()}


def test_url_filter_needs_labels_to_reject(spark):
    blocked = [f"http://a.net/es/x{k}" for k in range(40)]
    got = judge_urls(spark, blocked + ["http://other.org/es/x1", "http://b.org/p/q/r", "http://c.net/de/x1", "http://c.net/es/x1"])
    assert [got[k].verdict for k in range(40, 44)] == ["allow", "allow", "allow", "block"]  # the last one by its rule


@pytest.mark.parametrize("siblings", [1, 8, 12, 200])
def test_labelled_siblings_never_split_off_a_branch_without_labels(spark, siblings):
    got = judge_urls(spark, ["http://x.net/en/home"] + [f"http://x.net/fr/p{chr(97 + k % 26)}" for k in range(siblings)])
    assert got[0].template == "/*/*"


def test_url_filter_goes_as_deep_as_the_paths(spark):
    rules = (("block", "d.net", "/a/b/c/d/bad/"), ("allow", "d.net", "/a/b/c/d/good/"))
    deep = "/".join(["s"] * 300)
    urls = [f"http://d.net/a/b/c/d/{kind}/p{c}" for kind in ("bad", "good") for c in "qrstuvwxyz" * 3] + ["http://d.net/a/b/c/d/bad", f"http://e.net/{deep}", f"http://e.net/{deep}/t"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judged(pages, rules).collect()}
    assert got[0].template == "/*/*/*/*/bad/*" and got[30].template.startswith("/*/*/*/*/good/")
    assert got[61].template == "/" + "/".join(["*"] * 300) and got[62].template == "/" + "/".join(["*"] * 301)


def test_language_id_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_id.op5_language_id(spark, sf_dir).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.95 * found.count()


def test_language_id_edges(spark):
    docs = table(spark, [None, "", "12 !", "x", "the cat sat " * 9, "el gato y la " * 9, "日本語"] + ["the dog ran in and out"] * 40 + ["el perro y la casa"] * 40, langs=["en"] * 4 + ["en", "es", None] + ["en"] * 40 + ["es"] * 40)
    got = {r.doc_id: r for r in language_id.identified(docs, language_id.trained(docs)).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and all(got[k].rejected and got[k].score == 0 for k in (0, 1, 2))
    assert (got[4].lang_pred, got[5].lang_pred) == ("en", "es") and all(0 <= r.score <= 1 for r in got.values()) and got[6].rejected
    assert {r.lang_pred for r in language_id.identified(docs, None).collect()} == {"und"}
    assert language_id.accepted(docs).columns == docs.columns


def gram_counts(text):
    raw, found = b" " + (text or "").encode().translate(language_id.LETTERS) + b" ", np.zeros(language_id.DIM, np.int64)
    for n in (2, 3):
        for k in range(len(raw) - n + 1):
            if raw[k : k + n].strip(b" "):
                found[(int.from_bytes(raw[k : k + n], "big") * 2654435761 & 0xFFFFFFFF) >> 19] += 1
    return found


@pytest.mark.parametrize("piece", [1 << 18, 256, 7])
def test_language_id_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    r = random.Random(piece)
    texts = [None, "", "a", " ", "é!", "12", "the cat  sat"] + ["".join(r.choice("abc é.") for _ in range(n)) for n in (1, 2, 3, 6, 7, 8, 255, 256, 257, 511, 513, 700)]
    want = np.stack([gram_counts(t) for t in texts])
    assert (np.concatenate(list(language_id.counts(pa.array(texts, pa.string())))) == want).all()
    docs = table(spark, texts + ["the dog ran in and out"] * 9 + ["el perro y la casa"] * 9, langs=["en"] * len(texts) + ["en"] * 9 + ["es"] * 9)
    docs = docs.withColumn("letter", F.lit("clash")).unionByName(docs.withColumn("letter", F.lit("clash")).where("doc_id > 8")).unionByName(table(spark, ["the cat"]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("letter", F.lit("x")))
    model = language_id.trained(docs)
    rows = language_id.identified(docs, model).collect()
    assert len(rows) == docs.count() and language_id.accepted(docs.withColumn("c1", F.lit(1)), model=model).columns == [*docs.columns, "c1"]
    for x in rows:
        text = "the cat" if x.doc_id is None else (texts + ["the dog ran in and out"] * 9 + ["el perro y la casa"] * 9)[x.doc_id]
        v = np.sqrt(gram_counts(text)) * model.idf
        cosine = model.centroids @ v / max(np.linalg.norm(v), 1e-12)
        has = any(c.isalpha() for c in text or "")
        assert math.isclose(x.score, cosine.max() if has else 0.0, abs_tol=1e-5)
        assert x.lang_pred == (model.languages[cosine.argmax()] if has else "und") or np.ptp(np.sort(cosine)[-2:]) < 1e-5


def test_short_clean_texts_stay_and_junk_goes(spark, sf_dir):
    import base64

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = [base64.b64encode(random.Random(k).randbytes(3000)).decode() for k in range(5)] + ["qxz wvk zzjq " * 60]
    clean = ["A.", "The", "Ja", "el", "the of and", "the and of in was that it"]
    own = table(spark, clean + junk)
    kept = {x.doc_id for x in language_id.accepted(own, model=language_id.trained(docs)).collect()}
    assert kept == set(range(len(clean)))


def test_hmm_counts_and_likelihood(spark, monkeypatch):
    fitted, real = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *a: fitted.append(real(*a)) or fitted[-1])
    texts = corpus(2, 40) + ["word " * 700 + "other"]
    docs = table(spark, texts).withColumn("classes", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id in (3, 7)")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    rows = hmm.scores(docs).collect()
    assert len(rows) == len(texts) + 3
    words = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for t in texts]
    train = [ws for k, ws in enumerate(words) for _ in range(1 + (k in (3, 7))) if zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    total, norm = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    kind = lambda w: hmm.END if w is None else int(hmm.classes_of(pa.array([w]))[0])
    tokens, distinct = Counter(), Counter()
    for w, n in c.items():
        tokens[kind(w)] += n
        distinct[kind(w)] += 1
    model = fitted[-1][0]
    for r in rows:
        ws = words[5 if r.doc_id is None else r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / norm) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
        classes = [kind(w) for w in ws]
        alpha, log = model.start * model.emit[classes[0]], 0.0
        for k in classes[1:]:
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum() @ model.move * model.emit[k]
        log += math.log10(alpha.sum()) + sum(math.log10((c[w] + 0.5) / (tokens[k] + 0.5 * (distinct[k] + 1))) for w, k in zip(ws, classes))
        assert math.isclose(r.score, log, rel_tol=1e-9)
    assert [r for r in hmm.scores(docs).collect()] and hmm.scores(table(spark, ["a"]).limit(0)).count() == 0


def test_no_transition_is_lost_between_segments(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 3)
    r = np.random.default_rng(2)
    model = hmm.States(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(hmm.CLASSES + 1), 3).T)
    seqs = [r.integers(0, 9, n).astype(np.int16) for n in (1, 2, 3, 4, 5, 9, 10, 31)]
    counts, _ = hmm.counted(model, seqs)
    assert math.isclose(counts.move.sum(), sum(len(s) - 1 for s in seqs)) and math.isclose(counts.emit.sum(), sum(map(len, seqs))) and math.isclose(counts.start.sum(), len(seqs))


def test_forward_is_the_sum_over_paths_and_training_gains():
    r = np.random.default_rng(0)
    model = hmm.States(r.dirichlet(np.ones(2)), r.dirichlet(np.ones(2), 2), r.dirichlet(np.ones(hmm.CLASSES + 1), 2).T)
    seqs = [r.integers(0, 5, n).astype(np.int16) for n in (1, 4, 7, 3)]
    for take, symbols, lengths in hmm.blocks(seqs):
        got = hmm.forward(model, symbols, lengths)
    from itertools import product

    for k, value in zip(take, got):
        p = sum(model.start[z[0]] * model.emit[seqs[k][0], z[0]] * math.prod(model.move[a, b] * model.emit[o, b] for a, b, o in zip(z, z[1:], seqs[k][1:])) for z in product(range(2), repeat=len(seqs[k])))
        assert math.isclose(value, math.log(p), rel_tol=1e-9)
    counts, likely = hmm.counted(model, seqs)
    assert math.isclose(likely, sum(hmm.forward(model, s, n).sum() for _, s, n in hmm.blocks(seqs)))
    assert math.isclose(counts.emit.sum(), sum(map(len, seqs))) and math.isclose(counts.start.sum(), len(seqs))
    share = np.full(hmm.CLASSES + 1, 1e-9)
    step = lambda m: hmm.States(*(x / x.sum(axis=a, keepdims=True) for x, a in ((lambda c: ((c.start, 0), (c.move, 1), (c.emit, 0)))(hmm.counted(m, seqs)[0]))))
    loglik = lambda m: sum(hmm.forward(m, s, n).sum() for _, s, n in hmm.blocks(seqs))
    assert loglik(step(model)) >= loglik(model) and share.sum() > 0


def test_suffix_dedup_against_all_windows(spark, tmp_path):
    texts = corpus(3, 30) + ["é" * 300, "x" * 49, "y" * 50, "y" * 50, "y" * 51]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    seen = {}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49):
            if seen.setdefault(raw[a : a + 50], k) < k:
                gone[a : a + 50] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), k


def test_suffix_dedup_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 4096)  # the long text is beyond it
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared, long = text(120), text(20_000)
    rows = [(1, shared + text(70)), (5, text(60) + shared), (5, shared + text(90)), (5, shared + text(90)), (None, shared), (None, None), (7, long), (8, text(30) + long[9000:9400]), (9, None), (9, ""), (3, shared), (3, shared)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, "clash") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = {}
    for k, t in rows:
        raw = (t or "").encode()
        for a in range(len(raw) - 49) if k is not None else ():
            held[raw[a : a + 50]] = min(held.get(raw[a : a + 50], k), k)
    want = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49) if k is not None else ():
            if held[raw[a : a + 50]] < k:
                gone[a : a + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((-1 if k is None else k, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    got = [(-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert suffix_dedup.op6_suffix_dedup(spark, f"{tmp_path}/none").count() == 0


def test_split_anchors_and_long_texts_change_nothing(spark, monkeypatch):
    texts = corpus(3, 25)
    view = lambda most: sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removals(table(spark, texts), most_variants=most).collect())
    assert view(1) == view(1000) != []
    raw = " ".join(t or "" for t in texts).encode()
    at = np.array([0, len(raw)])
    whole = suffix_dedup.snippets(raw, at)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    cut = suffix_dedup.snippets(raw, at)
    windows = lambda x: {w for s, e in zip(x[1], x[2]) for w in range(s, e - 49)}
    assert windows(cut) == windows(whole) == set(range(len(raw) - 49))


def test_a_hot_anchor_costs_few_calls_and_lone_windows_no_sorting(monkeypatch):
    r = random.Random(8)
    tail = lambda: "".join(r.choice("abcdefgh ") for _ in range(60))
    texts = [tail() + "one passage that all of them share, word for word, and more" + tail() for _ in range(200)] + [tail()]
    ids, keys = np.arange(201), np.arange(201) + 1000
    owner, _, _, anchor, snip, _ = suffix_dedup.snippets(*suffix_dedup.text_bytes(pa.array(texts)))
    answers = []
    for d in range(201):
        own = np.zeros((owner == d).sum(), suffix_dedup.ANSWER)
        own["anchor"], own["snip"], own["what"] = anchor[owner == d], snip[owner == d], suffix_dedup.SPLIT
        answers.append([own.tobytes()])
    calls, sorted_bytes, hashed, expanded = [], [], suffix_dedup._keys, suffix_dedup.equal_intervals
    monkeypatch.setattr(suffix_dedup, "_keys", lambda raw, first: calls.append(1) or hashed(raw, first))
    monkeypatch.setattr(suffix_dedup, "equal_intervals", lambda text: sorted_bytes.append(len(text)) or expanded(text))
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "key": keys, "text": texts, "answers": answers})
    sent = pa.Table.from_batches(suffix_dedup._matched(1)(iter([batch])))
    assert len(calls) == 1
    got = {x["doc_id"]: np.frombuffer(x["spans"], "<i8").reshape(-1, 2).tolist() for x in suffix_dedup._compared(sent).to_pylist()}
    seen, want = {}, {}
    for k, x in enumerate(texts):
        starts = [a for a in range(len(x) - 49) if seen.setdefault(x[a : a + 50], k) < k]
        if starts:
            want[k] = suffix_dedup.merged(np.array([[a, a + 50] for a in starts])).tolist()
    assert got == want and len(want) == 199 and sum(sorted_bytes) < 51 * 200 * 20


def test_many_variants_of_an_anchor_stay_apart():
    r = np.random.default_rng(3)
    grams = r.integers(97, 123, (500_000, 16)).astype(np.uint8)
    word = grams.view("<u8")
    h = suffix_dedup._mix(word[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ word[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    n = 400_000  # each text is one window, with the least of many hashes as its anchor
    texts = np.concatenate([np.tile(grams[h.argmin()], (n, 1)), r.integers(97, 123, (n, 34)).astype(np.uint8)], axis=1)
    owner, _, _, anchor, snip, _ = suffix_dedup.snippets(texts.tobytes(), np.arange(n + 1) * 50)
    values, times = np.unique(anchor, return_counts=True)
    same = anchor == values[times.argmax()]
    assert same.sum() > 0.99 * n and len(np.unique(snip[same])) == same.sum() and len(np.unique(owner)) == n


@pytest.mark.parametrize("seed", range(4))
def test_interval_expansion_equals_windows(seed):
    r = np.random.default_rng(seed)
    text = np.concatenate([r.integers(97, 97 + 2 + seed, 300), [255], np.tile(r.integers(97, 100, 70), 3), [255]]).astype(np.uint8)
    number = suffix_dedup.equal_intervals(text, 20)
    groups = {}
    for k in range(len(text) - 19):
        groups.setdefault(text[k : k + 20].tobytes(), set()).add(number[k])
    assert all(len(g) == 1 for g in groups.values()) and len({*map(tuple, groups.values())}) == len(groups)


def test_ann_recall_and_odd_vectors(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(12, 16))
    x = centre[r.integers(0, 12, 3000)] + 0.6 * r.normal(size=(3000, 16))
    rows = [(k, [float(v) for v in row], 0, "clash") for k, row in enumerate(x)]
    rows += [(5000, None, 0, ""), (5020, [0.0] * 16, 0, ""), (5040, [float("nan")] + [1.0] * 15, 0, ""), (5060, [1.0] * 3, 0, ""), (5080, [None] + [1.0] * 15, 0, ""), (None, [1.0] * 16, 0, ""), (5001, rows[20][1], 0, ""), (5002, rows[20][1], 0, "")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")
    got = ann.nearest_neighbours(vectors, F.col("id") % 20 == 0, 20).toPandas()
    ids = np.array([*range(3000), 5001, 5002])
    full = np.concatenate([x, x[[20, 20]]])
    hits = 0
    for q, own in got.groupby("query_id"):
        score = full @ x[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        hits += len(set(best) & set(own.vec_id))
    assert set(got.query_id) == set(range(0, 3000, 20)) and hits >= 0.9 * 20 * 150
    for _, own in got.groupby("query_id"):
        pairs = list(zip(-own.sort_values("rank").score, own.sort_values("rank").vec_id))
        assert pairs == sorted(pairs)  # copies tie exactly, the smaller id first
    assert ann.nearest_neighbours(vectors.limit(0), F.lit(True)).count() == 0
    few = ann.nearest_neighbours(vectors.where("vec_id < 4"), F.lit(True)).toPandas()
    assert few.groupby("query_id").size().tolist() == [3, 3, 3, 3]


@pytest.mark.parametrize("one_step", [2048, 100])
def test_ann_recall_with_many_lists(spark, monkeypatch, one_step):
    monkeypatch.setattr(ann, "LIST", 10)
    monkeypatch.setattr(ann, "ONE_STEP", one_step)
    x = np.random.default_rng(8).normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(vectors, F.col("id") % 30 == 0, 20).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
    assert got.query_id.nunique() == 200 and hits >= 0.9 * 20 * 200


def test_lists_grow_with_the_table_and_walks_find_them():
    r = np.random.default_rng(3)
    x = r.normal(size=(8, 24))[r.integers(0, 8, 12_000)] + 0.5 * r.normal(size=(12_000, 24))
    lists = ann.train(x, 12_000 * 50, float(np.linalg.norm(x, axis=1).max()))
    assert len(lists.points) > 2900
    near, dist = lists.nearest(lists.augmented(x[:500]), 4)
    true, _ = ann._least(ann._sq(lists.augmented(x[:500]), lists.points), 4)
    assert np.mean([len(set(a) & set(b)) / 4 for a, b in zip(near, true)]) > 0.9 and (np.diff(dist, axis=1) >= 0).all()
