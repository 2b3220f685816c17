"""The training-data operators against brute force on small tables, with
nulls, empty and long texts, ties, repeated rows, empty tables and extra or
clashing columns."""

import hashlib
import pickle
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import (components, decontam, langid, masked_lm, maxscore, minhash, packing, quality, repeats,
                           secrets, urlrules)
from assaylake.llm.queries import QUERIES, tokenizer_file

from ..conftest import SF_SMALL

RNG = np.random.default_rng(0)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(1, 7))) for _ in range(300)]
DOCS = "doc_id long, text string, lang string, score double"


def sentence(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def texts():
    base = [sentence(60) for _ in range(12)]
    out = [None, "", "  \n ", "one", "ONE two", "é ñ ß", "x" * 400, "ab " * 500, sentence(4000), *base, *base[:4]]
    for t in base[:6]:
        w = t.split()
        w[7] = "changed"
        out += [" ".join(w), " ".join(w[:40]) + " " + sentence(5)]
    return [(i, t, "en", 0.5) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*texts, (None, texts[9][1], None, None), texts[10]], DOCS).repartition(3)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_minhash_against_all_pairs(spark, docs, texts):
    for n in (2, 5):
        sets = {}
        for d, t, *_ in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
            sets[d] = set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set()
        label = {d: d for d in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        label[a] = label[b] = min(label[a], label[b])
        got = minhash.near_duplicates(docs, n, 80).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id],
                                                                  label[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.keep_one(docs, 2).columns == docs.columns


def test_blocks_find_the_links_that_stars_miss():
    a = np.unique(RNG.integers(0, 1 << 62, 200).astype(np.uint64))
    b = np.unique(np.concatenate((a[:190], RNG.integers(0, 1 << 62, 10).astype(np.uint64))))
    assert minhash.linked(a, b, 80) and not minhash.linked(a, b[:100], 80)
    assert abs((minhash.signature(a, 1024) == minhash.signature(b, 1024)).mean() - 190 / 210) < 0.06


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert components.components(edges.limit(0)).count() == 0


def brute_repeats(rows, least):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i in range(len(t) - least + 1):
            first.setdefault(t[i:i + least], d)
    out = defaultdict(list)
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - least + 1):
            if first[t[i:i + least]] < d:
                gone[i:i + least] = [True] * least
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[d].append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_against_brute_force(spark, docs, texts):
    rows = [(d, (t or "").encode()) for d, t, *_ in texts]
    want = brute_repeats(rows + [rows[10]], 50)
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert tuple(r)[1:] in want[r.doc_id]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_of_a_hot_anchor(spark, monkeypatch):
    """A passage and a short line in every document, each time between other
    bytes: no group may hold all segments of their anchors."""
    rng = np.random.default_rng(8)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    passage, line = noise(200), noise(40)
    rows = [(i, noise(60) + passage + noise(60) + line + noise(60)) for i in range(6000)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(4)
    plain, most = repeats._answer, 256 << 10

    def bounded(*args):
        run = plain(*args)

        def checked(t):
            size = defaultdict(int)
            for blob in t["blob"].to_pylist():
                if t["bucket"][0].as_py() < repeats.LEAST_BUCKETS:
                    key, length = repeats._unpack(blob, np.uint64, np.int32, np.int64, np.uint8)[:2]
                    for k, x in zip(key.tolist(), length.tolist(), strict=True):
                        size[k] += x
            assert max(size.values(), default=0) <= most, "unbounded anchor"
            return run(t)
        return checked
    monkeypatch.setattr(repeats, "_answer", bounded)
    want = brute_repeats(rows, 50)
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:] in want[r.doc_id] for r in got)


def test_maximal_repeats_of_small_texts():
    texts = [b"abcabcabx", b"zabcabq", b"", b"xbca"]
    found = {}
    for size, where in repeats.maximal_repeats(texts, 2):
        found[texts[where[0][0]][where[0][1]:where[0][1] + size]] = where
    want = {}
    grams = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 2, len(t) + 1)}
    for g in grams:
        at = [(k, i) for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(g, i)]
        left = {texts[k][i - 1] if i else (k, i) for k, i in at}
        right = {texts[k][i + len(g)] if i + len(g) < len(texts[k]) else (k, i) for k, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want[g] = at
    assert found == want


def test_maxscore_against_all_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 16)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, []), (404, rows[3][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = maxscore.top_k(maxscore.scaled_vectors(df), F.col("id") % 20 == 0, 20).collect()
    v = {i: np.floor(64 * np.array(x)) for i, x in rows[:400] + [rows[404]]}
    copies = [*v, 5]
    for q in range(0, 400, 20):
        want = sorted(((-int(v[q] @ v[c]), c) for c in copies if c != q))[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert maxscore.top_k(maxscore.scaled_vectors(df.limit(0)), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("copies", [1, 3])
def test_maxscore_keeps_all_vectors_of_an_id(spark, tmp_path, copies):
    import duckdb

    from assaylake.llm.queries import ORACLES
    rng = np.random.default_rng(6)
    rows = [(i % 60, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(150)] * copies
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["op4_maxscore_topk"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLES["op4_maxscore_topk"]).fetchall())


def test_linked_parts_equal_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        spans = [(rng.choice(secrets.KINDS), s, s + rng.randrange(1, 60)) for s in (rng.randrange(2000) for _ in range(rng.randrange(12)))]
        base = [p for p in spans if p[0] in ("assign", "access", "hex")]
        weak = [p for p in spans if p not in base]
        near = lambda a, b: a[1] - 50 <= b[2] + 50 and b[1] - 50 <= a[2] + 50
        want = [p for p in weak if any(secrets.ROLE[p[0]] != secrets.ROLE[o[0]] and near(p, o) for o in spans)]
        assert secrets.link_parts(base, weak, 50) == want


def test_failing_base_candidates_are_weak_parts():
    def kinds(text):
        return [k for k, _, _ in secrets.all_spans(text)[1]]
    assert kinds("token=abc " + "z " * 10 + "AKIASHORT") == ["short_assign", "short_access"]
    assert kinds("login=amy99 key 0123456789abcdef") == ["identifier", "short_hex"]
    assert kinds("token=abc 0123456789abcdef") == []                # two secrets do not complete each other
    assert kinds("token=abc " + "z " * 200 + "AKIASHORT") == []     # out of scope
    base, linked = secrets.all_spans("AKIA" + "A" * 16 + " token=abc " + "0f" * 12)
    assert [k for k, _, _ in base] == ["access", "hex"] and [k for k, _, _ in linked] == ["short_assign"]


def test_secret_spans(spark):
    text = ("é user: bob99 pwd=abcd at https://h.example/x " + "z " * 200 + "login=amy99 " + "z " * 300 +
            'API_KEY = "abcdef123" token=abc AKIA' + "A" * 16 + " AKIAshort " + "0f" * 12)
    df = spark.createDataFrame([(1, text), (2, None), (2, "")], "doc_id long, text string").withColumn("spans", F.lit(0))
    got = sorted(secrets.secret_spans(df).collect(), key=lambda r: (r.doc_id, r.n_hex))
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex) == (1, 1, 1) and got[1].spans == ""
    spans = [(k, text[int(s):int(e)]) for k, s, e in (x.split(":") for x in got[0].spans.split(","))]
    assert ("identifier", "user: bob99") in spans and ("short_secret", "pwd=abcd") in spans
    assert not any("amy99" in t for _, t in spans)      # a part alone is not reported
    base = [x for x in got[0].spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")]
    assert got[0].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in secrets.redact(df.where("text <> ''")).collect()}
    assert "abcdef123" not in clean[1] and "login=amy99" in clean[1]


def test_contamination_against_brute_force(spark, docs, texts):
    items = [(1, " ".join(texts[9][1].split()[5:30])), (2, "ONE,two"), (3, None), (10, texts[12][1]), (4, "a" * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(str(i))
    want = {}
    for d, t, *_ in texts:
        w, hit, found = word(t), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if i + n <= len(w) and tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    for block in (1 << 20, 200):
        got = decontam.digests(decontam.contamination(docs, bench, block_bytes=block)).collect()
        assert len(got) == len(texts) + 2
        assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert decontam.contamination(out, bench).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks_and_without_ids(spark):
    words = [[f"{c}{k}" for k in range(10)] for c in "abcd"]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "item_id long, text string")
    pairs = [(i, j) for i in range(4) for j in range(4) if i != j]
    rows = [(n, " ".join([f"x{k}" for k in range(30)] + words[i][:5] + words[j] + words[i][5:] + ["end"]))
            for n, (i, j) in enumerate(pairs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, decontam.decontaminate(docs, bench, block_bytes=b).collect())) for b in (1 << 20, 20))
    assert len(one) == len(pairs) and one == many
    assert not any("a0" in t or "b0" in t or "c0" in t or "d0" in t for _, t in many)
    nameless = spark.createDataFrame([(None, " ".join(words[0]))], "item_id long, text string")
    found = decontam.contamination(docs, nameless).where("n_hit > 0").collect()
    assert len(found) == 6 - 3 and all(r.items == [] and r.n_hit == 10 for r in found)


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file())
    odd = "It's <|endoftext|> Ǆ é  x\x1cy don't ABC123 ²½ µ"
    rows = spark.createDataFrame([*texts, (900, odd, "", 0.0)], DOCS).repartition(2)
    got = packing.packed(rows, tokenizer_file()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in [*[x[:2] for x in texts], (900, odd)]:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.packed(rows.limit(0), tokenizer_file()).count() == 0


def test_harmonic_cuts():
    for n in (1, 63, 128, 129, 1365, 2047, 4095, 4096, 9000):
        cut = packing.cut_lengths(n)
        assert sum(k for k, _ in cut) == n
        assert all(k * abs(j) <= 4096 < (k + 1) * (abs(j) + 1) + 4096 for k, j in cut)


def test_url_rules(spark):
    urls = [None, "", "x", "http://com", "http://com/", "https://A.Example.COM/en/x?q", "http://www.example.com/en/1",
            "http://m.www.example.com/en/", "http://notexample.com/en/", "http://a.net/es/", "http://net/fr/z#h", "http://a.net/"]
    df = spark.createDataFrame([(i % 11, u) for i, u in enumerate(urls)] * 2, "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.url: (r.rule, r.verdict) for r in urlrules.url_verdicts(df).collect()}
    none = (None, "allow")
    assert got == {None: none, "": none, "x": none, "http://com": none, "http://com/": ("com/", "allow"),
                   "https://A.Example.COM/en/x?q": ("example.com/en/", "block"),
                   "http://www.example.com/en/1": ("www.example.com/en/", "allow"),
                   "http://m.www.example.com/en/": ("www.example.com/en/", "allow"),
                   "http://notexample.com/en/": ("com/", "allow"), "http://a.net/es/": ("net/es/", "block"),
                   "http://net/fr/z#h": ("net/fr/", "block"), "http://a.net/": none}
    assert urlrules.url_verdicts(df).count() == 24 and urlrules.url_verdicts(df.limit(0)).count() == 0


def test_url_rules_over_many_range_partitions(spark):
    """Distinct hosts fill many range partitions, most of which start inside a rule's interval."""
    n, zone = 60_000, 200
    rules = [("block" if k % 4 else "allow", f"z{k:03d}.com", "/") for k in range(0, n // zone, 2)]
    df = spark.range(n).select(F.col("id").alias("page_id"), F.format_string(
        "http://h%05d.z%03d.com/a/b/c", F.col("id"), F.floor(F.col("id") / zone).cast("long")).alias("url"))
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = urlrules.url_verdicts(df, rules, "none").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = ["none" if k % 2 else "block" if k % 4 else "allow" for k in range(n // zone)]
    assert len(rows) == n
    assert sum(r.verdict != want[r.page_id // zone] for r in rows) == 0


def test_models_on_odd_rows(spark, docs):
    net = langid.fit(docs, F.col("lang").isNotNull())
    got = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0 and got[5].lang_pred == "en"
    assert langid.fit(docs.limit(0), F.lit(True)) is None
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 20)] + [(4, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    lm = {r.doc_id: r for r in masked_lm.score(docs, masked_lm.fit(docs, rounds=1)).collect()}
    assert lm[0].n_words == 0 and lm[0].log_prob == 0 and lm[0].mean_log_prob is None and lm[9].log_prob < 0


def test_word_counts_of_the_language_model_are_exact(spark):
    """300,000 distinct words: each has its own count, and the embeddings grow."""
    n = 300_000
    few = [(0, "common " * 500 + " ".join(f"w{k}" for k in range(300)))]
    many = spark.range(n // 100).select("id", F.expr(f"array_join(transform(sequence(0, 99), k -> 'w' || (id * 100 + k)), ' ')"
                                                     ).alias("text"))
    docs = many.unionByName(spark.createDataFrame(few, "id long, text string")).repartition(3)
    model = masked_lm.fit(docs, rounds=0)
    assert model.words.count() == n + 1
    assert model.words.groupBy("n").count().orderBy("n").collect() == [(1, n - 300), (2, 300), (500, 1)]
    small = masked_lm.fit(docs.limit(1), rounds=0).net
    assert len(masked_lm.WindowNet(small.top, np.ones(masked_lm.CLASSES), 100_000_000).params["emb"]) > len(small.params["emb"])
    rows = spark.createDataFrame([(1, "w299"), (2, "w299999"), (3, "unseen")], "doc_id long, text string")
    got = {r.doc_id: r.log_prob for r in masked_lm.score(rows, model).collect()}
    # without training the shares alone differ; the sum over the vocabulary is one at one position
    words = model.words.toArrow()
    h = words["word"].to_numpy().view(np.uint64)
    x = np.full((len(h), 4), 1 << model.net.in_bits, np.int32)
    assert abs(np.exp(model.net.log_prob(x, model.net.targets(h), words["n"].to_numpy()).astype(float)).sum() - 1) < 1e-3
    assert all(v < 0 for v in got.values())


def test_every_position_trains_the_language_model(spark):
    texts = [sentence(100) for _ in range(30)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = masked_lm.fit(docs, rounds=0).net
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    _, _, h, doc = masked_lm.tk.words(data, offs, masked_lm.tk.NON_SPACE)
    got = {k: masked_lm.fit(docs, rounds=k).net.params for k in (1, 2)}
    for k in (1, 2):
        want.train(want.inputs(h, doc), want.targets(h), 0.5 / k)
        assert all(np.allclose(got[k][name], v, atol=1e-4) for name, v in want.params.items())


def test_language_model_on_texts_hashed_once(spark):
    rows = [(k, sentence(5 + 20 * (k % 3))) for k in range(40)] + [(7, "twice a b"), (7, "twice a b"), (None, "no id"), (50, None), (51, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    once = masked_lm.hashed(docs, "doc_id")
    model = masked_lm.fit(once, rounds=1)
    assert model.words.orderBy("word").collect() == masked_lm.fit(docs, rounds=0).words.orderBy("word").collect()
    got, want = (sorted(masked_lm.score(x, model).collect(), key=str) for x in (once, docs))
    assert got == want and len(got) == len(rows)
    assert {r.n_words for r in got if r.doc_id in (50, 51)} == {0} and sum(r.doc_id == 7 for r in got) == 3
    assert masked_lm.hashed(docs.limit(0), "doc_id").rows.count() == 0


def test_training_steps_against_plain_sums():
    """Gradients summed one input at a time, for documents down to one word, in
    a net that came by pickle as in a task."""
    rng = np.random.default_rng(1)
    doc = np.repeat(np.arange(400), rng.integers(1, 7, 400))
    h = rng.integers(0, 1 << 12, len(doc)).astype(np.uint64) << np.uint64(52)
    net = pickle.loads(pickle.dumps(masked_lm.WindowNet(np.zeros(0, np.int64), np.arange(masked_lm.CLASSES), 100)))
    assert all(v.dtype is np.dtype(np.float32) for v in net.params.values())
    p = {k: v.astype(float) for k, v in net.params.items()}
    x, y = net.inputs(h, doc), rng.integers(0, masked_lm.CLASSES, len(doc))
    net.train(x, y, 0.5)
    for at in range(0, len(x), masked_lm.BATCH):
        xb, yb = x[at:at + masked_lm.BATCH], y[at:at + masked_lm.BATCH]
        e = p["emb"][xb].reshape(len(xb), -1)
        hid = np.tanh(e @ p["w1"] + p["b1"])
        z = np.exp(hid @ p["w2"] + p["b2"])
        d = z / z.sum(1, keepdims=True) - np.eye(masked_lm.CLASSES)[yb]
        dh = (d @ p["w2"].T) * (1 - hid * hid)
        step, de = 0.5 / masked_lm.BATCH, (dh @ p["w1"].T).reshape(-1, masked_lm.WIDTH)
        p["w2"] -= step * hid.T @ d
        p["b2"] -= step * d.sum(0)
        p["w1"] -= step * e.T @ dh
        p["b1"] -= step * dh.sum(0)
        np.subtract.at(p["emb"], xb.ravel(), step * 20 * de)
    assert all(np.allclose(net.params[k], v, atol=1e-5) for k, v in p.items())
    n = np.ones(len(x))
    before = net.log_prob(x, y, n)
    net.params["b2"] += 200         # too much for exp without a shift
    assert np.allclose(net.log_prob(x, y, n), before, atol=1e-3)


def test_held_out_accuracy(spark):
    d = SF_SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = QUERIES["op2_byte_cnn_language"](spark, d).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.93


def test_pipeline(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    at = docs
    for name, stage in P.STAGES[:-1]:
        new = stage(spark, at, SF_SMALL)
        assert new.columns == docs.columns, name
        assert 0 < new.count() <= at.count()
        at = new
    # brute force: nothing left to remove
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    assert decontam.contamination(at, bench).where("n_hit > 0").count() == 0
    assert secrets.secret_spans(at).where("n_assign + n_access + n_hex > 0").count() == 0
    packed = P.run(spark, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == at.count()
