"""Each operator against brute force, on ordinary texts and on awkward ones."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tomeweaver.llm import language_id, license_scan, lm_score, mixing, ngram_join, packing, quality_rules, queries, token_count, topk, toxicity
from tomeweaver.llm import textbatch as tb

SF = "/root/testdata/sf0.001"
#: Columns whose names clash with those that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, sid long, block int, key string, words string, n long, rn int"
WORDS = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(texts):
    return [(i, t, lang, src, 1, 2, 0.5, 3, 4, "k", "w", 5, 6) for i, t, lang, src in texts]


def frame(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def awkward():
    rng = random.Random(5)
    v = ["the", "river", "Café", "LICENSE", "cc", "by", "x" * 300, "ﬁn", "日本", "a.b", "|", "###", "'s", "don't", "123", "über"]
    out = [(k, " ".join(rng.choice(v) + rng.choice(["", ".", "\n", "!", "  "]) for _ in range(rng.randrange(1, 200))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for k in range(40)]
    out += [(40, None, None, None), (41, "", "en", "a"), (42, " \t\n\x0b\f\r ", "en", "a"), (None, "no id here at all", "en", "b"), (None, None, "en", "b"), (43, out[3][1], "en", "a"), (44, out[3][1], "de", "b"), (3, out[3][1], "en", "a"), (3, out[3][1], "en", "a")]
    out += [(45, "word " * 30000, "en", "a"), (46, "y" * 50000, None, "c"), (47, "<|endoftext|> a <|endoftext|>\x00▁ b\t\tc", "en", "c"), (48, "one two three four", "en", "a"), (49, "One two three four", "en", "a"), (50, "one two three four five", "en", "a"), (51, "!!! ??? %%%", "en", "a")]
    return out


@pytest.fixture(scope="module")
def texts():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3)


@pytest.fixture(scope="module")
def sf(spark):
    return queries.table(spark, SF, "documents")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_word_hashes_match_words(texts):
    col = pa.array([t for _, t, _, _ in texts])
    for i, j, data, off in tb.slices(col, 5000):
        h, first = tb.words(data, off)
        want = [re.findall(WORDS, lower(t)) for _, t, _, _ in texts[i:j]]
        assert np.diff(first).tolist() == [len(w) for w in want]
        assert h.tolist() == [tb.hash_of(x) for w in want for x in w]


def test_hashes_of_long_texts_are_those_of_short_ones(monkeypatch):
    rng = random.Random(3)
    text = " ".join("x" * rng.choice([1, 3, 40, 700]) + str(k) for k in range(300))
    data, off = tb.arrow_bytes(pa.array([text]))
    s, e, _ = tb.spans(data, off, tb.WORD)
    want = tb.hashes(data, s, e)
    count = language_id.count_matrix(data, off)
    monkeypatch.setattr(tb, "SLICE", 64)
    assert (tb.hashes(data, s, e) == want).all() and (language_id.count_matrix(data, off) == count).all()


def test_a_very_long_text(spark):
    # 60 MB in one row: words, one long word, and no more memory than some copies of it
    text = "all rights reserved " * 1_000_000 + "y" * 20_000_000 + " cc by " * 3_000_000
    one = pa.array([text])
    (i, j, data, off), = tb.slices(one)
    h, first = tb.words(data, off, tb.ALNUM)
    assert first.tolist() == [0, 9_000_001] and len(set(h.tolist())) == 6
    del h
    assert language_id.count_matrix(data, off).sum() > 50_000_000
    (x,) = ngram_join.shingle_sets(data, off)
    assert len(x) == 3 + 4 + 2 + 1 + 0


def test_license_scan(spark, docs, texts):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    far = "obtaining " + "a b " * 50 + "associated " + "c d " * 50 + "documentation " + "e f " * 50 + "files " + "g h " * 50 + "permission is hereby granted free of charge to all"
    more = [(93, far, "en", "a"), (90, "All rights reserved. Licensed under CC BY-NC 4.0. all rights RESERVED", "en", "a"), (91, "Permission is hereby granted, free of charge, to any person obtaining a copy", "en", "a"), (92, "granted free the charge permission", "en", "a")]
    got = by_id(license_scan.license_scan(docs.unionAll(frame(spark, more))).collect())
    for i, t, _, _ in texts + more:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        places = [k for k, _ in at]
        want = (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[i]]
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got[i])
    assert got[90][0].labels == "cc-by,cc-by-nc-4.0,reserved" and got[91][0].labels == "mit" and got[92][0].labels == "" and got[93][0].labels == "mit"


def shingles(t):
    w = re.findall(WORDS, lower(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = [shingles(t) for _, t, _, _ in texts]
    label = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = label[a], label[b]
                label = [y if z == x else z for z in label]
    least = {z: min((texts[k][0] for k in range(len(texts)) if label[k] == z and texts[k][0] is not None), default=None) for z in label}
    return [(texts[k][0], len(sets[k]), texts[k][0] if not sets[k] else least[label[k]]) for k in range(len(texts))]


def near_copies(seed, n=120):
    """A chain of edits, so that ends of a group do not link directly; copies; and a passage that strangers share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, out, base = [word() for _ in range(60)], [], [word() for _ in range(rng.randrange(30, 200))]
    for k in range(n):
        if k % 12 == 0:
            base = [word() for _ in range(rng.choice([4, 5, 8, 30, 90, 300]))]
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            own[rng.randrange(len(own))] = word()
        if rng.random() < 0.5:
            base = own
        if k % 7 == 0:
            own = own + passage
        out.append((1000 - k, " ".join(own), "en", "a"))
    return out


@pytest.mark.parametrize("hot, block", [(4096, 2_000_000), (4, 400)])
def test_ngram_join(spark, texts, monkeypatch, hot, block):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    all_ = texts + near_copies(1)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, all_).repartition(3)).collect()), key=str)
    assert got == sorted(brute_components(all_), key=str)


def test_one_row_of_each_component_stays(spark):
    a, b, c = ("one two three four five six seven " + w for w in ("alpha", "beta beta beta beta beta beta beta", "gamma gamma gamma"))
    other = "quite another text that nothing else here is like at all"
    bare = [(20, None), (None, ""), (21, " ")]
    rows = [(3, a), (5, a), (5, other), (7, b), (7, b), (7, b), (None, b), (None, c), (None, c), (None, a), *bare]
    got = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(frame(spark, [(k, t, "en", "a") for k, t in rows]).repartition(3)).collect()), key=str)
    assert got == sorted([(3, a), (5, other), (7, b), (None, c), *bare], key=str)


def test_places_of_linked_sets_meet():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = rng.integers(0, len(a) // 9 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 80 * (len(a) + len(b) - inter):
            assert set(ngram_join.places(a).tolist()) & set(ngram_join.places(b).tolist())
            v = ngram_join.points([ngram_join.vector(a), ngram_join.vector(b)])
            assert np.minimum(v[0], v[1]).sum() >= inter


def test_tree_search_finds_all():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 6, (400, 16)).astype(np.int32)
    n = p.sum(1)
    tree = ngram_join.RTree(p, n)
    for i in range(0, 400, 7):
        want = np.flatnonzero(9 * np.minimum(p, p[i]).sum(1) >= ngram_join.needed(n, n[i]))
        assert sorted(tree.search(p[i], int(n[i])).tolist()) == want.tolist()


def test_language_id(spark, sf, docs, texts):
    model = language_id.fit(sf, queries.remainder(3) != 1)
    truth = {r.doc_id: r.lang for r in sf.select("doc_id", "lang").collect()}
    held = [r for r in queries.op3_language_id(spark, SF).collect() if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    got = by_id(language_id.language_id(docs, model).collect())
    for i, t, _, _ in texts:
        assert any((r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t)) and 0 <= r.score <= 1 for r in got[i])
    kept = language_id.without_rejected(sf, model)
    assert kept.columns == sf.columns and kept.count() >= 0.99 * sf.count()


def test_language_id_rejects_other_languages_and_noise(spark):
    rng = random.Random(4)
    vocab = {"en": "the of and to in that was his with for had you not are this river house water under light", "de": "der die und den von ein nicht mit sich auf auch wieder Haus Wasser unter Licht zwischen"}
    prose = lambda v, n: " ".join(rng.choice(v.split()) for _ in range(n))
    letters = lambda v, n: " ".join("".join(rng.choice(v) for _ in range(rng.randrange(3, 9))) for _ in range(n))
    rows = [(k, prose(vocab[g], rng.randrange(3, 300)), g, "a") for k, g in enumerate(["en", "de"] * 150)]
    odd = [(1000, letters("qxzjkw", 2), "en", "a"), (1001, letters("0123456789abcdef", 40), "de", "a")]
    model = language_id.fit(frame(spark, rows + odd))
    # one odd text neither lowers the floor of ordinary ones nor holds a centroid
    finnish = "vaka vanha itse tuon sanoiksi virkki mieleni minun tekevi aivoni ajattelevi sanat suussani sulavat puhehet putoelevat"
    far = [prose(finnish, 300), letters("0123456789abcdef", 300), letters("bcdfghjklmnpqrstvwxz", 300), letters("abcdefghijklmnopqrstuvwxyz", 300)]
    near = [prose(vocab[g], n) for g in vocab for n in (3, 10, 50, 300)]
    got = {r.doc_id: r.rejected for r in language_id.language_id(frame(spark, [(k, t, None, "a") for k, t in enumerate(far + near)]), model).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(far) + [False] * len(near)


def test_language_id_is_the_nearest_centroid(spark, sf):
    # cosines by dictionaries of trigrams, from the model's centroids and weights
    model = language_id.fit(sf)
    rows = sf.select("doc_id", "text").limit(60).collect()
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows), model).collect()}
    for r in rows:
        b = [x if x >= 0x80 else ord(chr(x).lower()) if chr(x).isalpha() else 0x20 for x in r.text.encode()]
        tri = Counter(((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 20 for x, y, z in zip(b, b[1:], b[2:], strict=False) if (x, y, z).count(0x20) < 2)
        v = {d: math.log1p(c) * float(model.idf[d]) for d, c in tri.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        cos = [sum(x * float(c[d]) for d, x in v.items()) / norm for c in model.centroids]
        best = int(np.argmax(cos))
        assert got[r.doc_id].lang_pred == model.langs[model.owner[best]] and math.isclose(got[r.doc_id].similarity, max(cos), abs_tol=1e-4)


def test_language_id_sample_is_bounded(spark, sf, monkeypatch):
    seen = []
    kmeans = language_id.held_centroids
    monkeypatch.setattr(language_id, "held_centroids", lambda x: (seen.append(len(x)), kmeans(x))[1])
    some = sf.limit(200)
    hot = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("doc_id", F.lit(7).cast("long")).withColumn("text", F.concat("text", F.col("k").cast("string"))).drop("k")
    same = some.limit(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("k")
    model = language_id.fit(some.unionByName(hot).unionByName(same), sample=50)
    assert len(seen) == len(model.langs) and max(seen) <= 100  # 13,200 rows
    seen.clear()
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of language "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 1500).cast("string")).alias("lang"))
    monkeypatch.setattr(language_id, "SAMPLE_ALL", 300)
    monkeypatch.setattr(language_id, "MAX_LANGS", 100)
    assert len(language_id.fit(many).langs) <= 100 and sum(seen) <= 300


def test_lm_score_base_columns(spark, docs, texts):
    # a condition that is null counts as false: such rows are neither trained on nor held out
    model, counts = lm_score.fit(docs, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False)), 3)
    got = by_id(lm_score.lm_score(docs, F.col("doc_id") % 7 == 2, model, counts, 3).collect())
    words = lambda t: [*re.findall(WORDS, lower(t)), None]
    c = Counter(x for i, t, _, _ in texts if i is not None and i % 7 != 2 for x in words(t))
    n, v = sum(c.values()), len(c)
    for i, t, _, _ in texts:
        w = words(t)
        want = (len(w), sum(c[x] > 0 for x in w), n)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert any((r.n_tokens, r.n_known, r.train_tokens) == want and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 for r in got[i])
    assert sum(map(len, got.values())) == len(texts)


def test_network_is_a_distribution_and_carries_state():
    rng = np.random.default_rng(1)
    net = lm_score.new_network(np.array([9, 7, 5, 3, 1] * 20), 50)
    net.wc[:] = rng.normal(0, 0.3, net.wc.shape)
    net.ww[:] = rng.normal(0, 0.3, net.ww.shape)
    v = lm_score.SPECIAL + 100
    h = rng.normal(0, 1, (1, lm_score.HIDDEN)).astype(np.float32)
    p = np.exp(net.log_probs(np.repeat(h, v, 0), np.arange(v)))
    assert abs(p.sum() - 1) < 1e-4
    docs = [np.append(rng.integers(1, v, n), lm_score.END) for n in (0, 3, 700, 40, 1500)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = lm_score.score_documents(net, np.concatenate(docs), first)
    for d, g in zip(docs, got, strict=True):
        state, total, prev = np.zeros((1, lm_score.HIDDEN), np.float32), 0.0, lm_score.END
        for x in d:
            state = net.step(state, np.array([prev]))[0]
            total += float(net.log_probs(state, np.array([x]))[0])
            prev = x
        assert math.isclose(g, total, rel_tol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    net = lm_score.new_network(np.array([5, 4, 3]), 4, hidden=3)
    net = lm_score.Network(*(rng.normal(0, 0.4, p.shape) for p in net.params))
    net.bw[:, 3:] = -30
    prev, target, h, fresh = rng.integers(0, 4, (4, 2)), rng.integers(0, 4, (4, 2)), rng.normal(0, 1, (2, 3)), rng.random((4, 2)) < 0.2
    grads = lm_score.gradients(net, prev, target, h, fresh)[0]
    for p, g in zip(net.params, grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = lm_score.gradients(net, prev, target, h, fresh)[2]
            p[at] = old - 1e-5
            down = lm_score.gradients(net, prev, target, h, fresh)[2]
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_training_lowers_the_loss():
    rng = np.random.default_rng(6)
    docs = [np.append(np.tile([1, 2, 3, 4], 30 + int(rng.integers(0, 5))), lm_score.END) for _ in range(70)]
    net = lm_score.new_network(np.array([30, 30, 30, 30]), 1)
    losses = lm_score.train_network(net, docs, epochs=12, rate=0.02)
    assert losses[-1] < 0.6 * losses[0]


def some_words(spark):
    """A vocabulary of four words, and rows of texts that repeat them."""
    words = ["alpha", "beta", "gamma", "delta"]
    col = pa.array(words)
    data, off = tb.arrow_bytes(col)
    keys = lm_score.word_keys(data, off)[0]
    order = np.argsort(keys)
    vocabulary = lm_score.Vocabulary(keys[order], np.full(4, 30), (lm_score.SPECIAL + lm_score.BUCKETS + order).astype(np.int64))
    rows = [(k, " ".join(words * (20 + k % 5))) for k in range(300)] + [(None, None), (7, ""), (8, "zzz"), (9, "alpha " * 40000)]
    return vocabulary, spark.createDataFrame(rows + [(5, "alpha beta")] * 50, "doc_id long, text string")


def test_pieces_hold_every_token_and_do_not_depend_on_files(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 1000)
    vocabulary, rows = some_words(spark)
    a, b = (lm_score.pieces(rows.repartition(n), vocabulary, 5).toPandas() for n in (1, 4))
    assert a.n.sum() == b.n.sum() == sum(len((t or "").split()) + 1 for _, t in rows.collect()) and a.n.max() == 1000
    assert [np.frombuffer(w, "<u2").tolist() for w in a.w[a.n == 2]].count([lm_score.SPECIAL + lm_score.BUCKETS, lm_score.SPECIAL + lm_score.BUCKETS + 1]) == 0
    alone = lambda x: sorted(zip(x.trainer, x["round"], x.h, x.w, strict=True))
    # rows that agree in id and words are dealt apart, which one task counts; all others are the same pieces
    assert [r for r in alone(a) if len(r[3]) != 6] == [r for r in alone(b) if len(r[3]) != 6]
    assert a.trainer[a.n == 3].nunique() == 5
    zzz = [w for w, n in zip(a.w, a.n, strict=True) if n == 2]
    assert len(zzz) == 1 and lm_score.SPECIAL <= np.frombuffer(zzz[0], "<u2")[0] < lm_score.SPECIAL + lm_score.BUCKETS


def test_trainers_average_and_the_result_is_the_same_again(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FAN", 3)  # so that eight trainers' networks are averaged in two levels
    monkeypatch.setattr(lm_score, "TASK_LANES", 4)  # so that a small table makes many steps
    monkeypatch.setattr(lm_score, "TRAINER", 9000)
    vocabulary, rows = some_words(spark)
    rows = rows.limit(300)
    net = lm_score.new_network(np.concatenate([np.zeros(lm_score.BUCKETS), [30, 30, 30, 30]]), 1)
    before = [p.copy() for p in net.params]
    got, again = (lm_score.trained(rows.repartition(n), net, vocabulary, 27000) for n in (1, 5))
    assert all((a == b).all() for a, b in zip(net.params, before, strict=True))  # the start is left as it was
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(got.params, again.params, strict=True))
    doc = np.append(np.tile(lm_score.SPECIAL + lm_score.BUCKETS + np.arange(4), 20), lm_score.END)
    score = lambda n: float(lm_score.score_documents(n, doc, np.array([0, len(doc)]))[0])
    assert score(got) > 0.9 * score(net)
    assert lm_score.unpacked_network(lm_score.packed_network(got), net).x.shape == got.x.shape
    assert lm_score.trained(rows.limit(0), net, vocabulary, 0) is net


def test_training_uses_every_token():
    net = lm_score.new_network(np.array([30, 30]), 1)
    seen = []
    net_grads = lm_score.gradients
    docs = [np.array([1] * 1000 + [0]), np.array([2] * 7 + [0]), np.array([0])]
    try:
        lm_score.gradients = lambda n, prev, target, h, fresh: (seen.append(target.ravel()), net_grads(n, prev, target, h, fresh))[1]
        lm_score.train_network(net, docs, epochs=1, lanes=8)
    finally:
        lm_score.gradients = net_grads
    c = np.bincount(np.concatenate(seen))
    assert c[1] >= 1000 and c[2] == 7 and c[lm_score.END] == 3 and c.sum() < 1010 + 8


def test_lm_score_beats_unigrams_and_does_not_depend_on_files(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = []
    for n in (1, 5):
        d = lm_score.written(docs.repartition(n), "docs")
        model, counts = lm_score.fit(d, queries.remainder(7) != 2)
        got.append(lm_score.lm_score(d, queries.remainder(7) == 2, model, counts).toPandas().sort_values("doc_id"))
    a, b = got
    assert np.allclose(a.score, b.score, rtol=1e-4) and np.allclose(a.base_score, b.base_score)
    held = a[a.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.3
    assert (held.score > held.base_score).mean() > 0.95
    # more than the start, which is the network's unigram model of words and endings
    start = lm_score.new_network(np.exp(model.net.bw.ravel()), 1)
    start.bc[:] = lm_score.new_network(np.exp(model.net.bw.ravel()), int(model.ends)).bc
    plain = lm_score.lm_score(docs, queries.remainder(7) == 2, lm_score.Model(start, model.vocabulary, model.n, model.v, model.ends, model.rest), counts).toPandas().sort_values("doc_id")
    plain = plain[plain.held_out]
    assert held.score.sum() / held.n_tokens.sum() > plain.score.sum() / plain.n_tokens.sum() + 0.05


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    want = Counter()
    for i, text, _, _ in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)] += 1
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    ids_of = {i: [*t.encode(text or "", add_special_tokens=False).ids, 0] for i, text, _, _ in texts if i is not None}
    for i, rs in pieces.items():
        if i is None:
            continue
        ids = ids_of[i]
        assert sum(r.length for r in rs) == len(ids) * sum(1 for x in texts if x[0] == i)
        for r in rs:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(k[2] * c for k, c in want.items())
    seq = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seq.get(r.sequence_id, 0) and r.length > 0
        seq[r.sequence_id] = r.offset + r.length
    assert max(seq.values()) <= 1024


@pytest.mark.parametrize("size", [7, 128, 300, 2048])
def test_packing_into_windows_of_other_sizes(spark, docs, texts, size):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken"), size).toPandas()
    per = got.groupby("sequence_id").agg(n=("length", "sum"), last=("offset", "max"))
    assert per.n.max() <= size and got.length.min() > 0
    e = packing.encoder(path)
    assert got.length.sum() == sum(len(e.ids(t or "")) + 1 for _, t, _, _ in texts)


def test_cuts_are_optimal():
    rng = np.random.default_rng(7)
    for _ in range(60):
        size = 16
        at = np.unique(np.concatenate([np.cumsum(rng.integers(1, 9, 12))]))
        cost = rng.choice([0, 4, 9], len(at))
        pos = [0, *at.tolist()]

        def total(cuts):
            out = 0
            for a, b in zip([0, *cuts], cuts, strict=False):
                n = b - a
                out += (0 if n in (size // 2, size // 4, size // 8, size) else size - n) + packing.WINDOW_COST + int(cost[at.tolist().index(b)])
            return out

        best = {0: 0}
        for j in range(1, len(pos)):
            best[pos[j]] = min(best[p] + (0 if pos[j] - p in (8, 4, 2, 16) else size - (pos[j] - p)) + packing.WINDOW_COST + int(cost[j - 1]) for p in pos[:j] if pos[j] - p <= size)
        assert total(packing.best_cuts(at, cost, size)) == best[pos[-1]]


def test_both_tokenizer_libraries_agree(sf):
    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [r.text for r in sf.select("text").collect()] + ["a  b\n\n c \t d\u0085e", "x<|endoftext|>  y", "'s 're DON'T", "½²³ ª º", "ÿÀ" * 500]
    for t in texts:
        assert e.ids(t).tolist() == e.hf.encode(t, add_special_tokens=False).ids


def test_token_counts(spark, docs, texts, sf):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_count.Counter(path).splits
    for df in (docs, sf):
        got = by_id(token_count.token_counts(df, path, 100).collect())
        for r in df.select("doc_id", "text").collect():
            n = len(sp.encode(r.text or ""))
            assert (len((r.text or "").encode()), n, n > 100) in [(x.n_bytes, x.n_tokens, x.over_limit) for x in got[r.doc_id]]


def quality_of(t):
    t = t or ""
    w = re.findall(WORDS, t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c = Counter(tri)
    cover = {k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, docs, texts, sf):
    labels = queries.table(spark, SF, "labels")
    for df in (docs, sf):
        got = by_id(quality_rules.quality_rules(df, labels).collect())
        for r in df.select("doc_id", "text").collect():
            want = quality_of(r.text)
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert any((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want and x.base_failed == failed and not (failed and x.kept) for x in got[r.doc_id])


def plain_covering(rows, thresholds):
    """Sequential covering over rows (low, grow, values by feature), from its definition: each step weighs every condition on all rows."""
    side = lambda r, c: (r[2][c[0]] >= c[2]) == c[1]
    prec = lambda p, n: (p + 0.5) / (p + n + 1)
    rules, barred, left = [], set(), list(rows)
    failed = 0
    while len(rules) < quality_rules.MAX_RULES and failed < quality_rules.MAX_FAILED:
        rule, own = [], left
        steps = []
        while len(rule) < quality_rules.MAX_CONDITIONS:
            grow = [r for r in own if r[1]]
            p, n = sum(r[0] for r in grow), sum(not r[0] for r in grow)
            if not n:
                break
            best = None
            for f, ts in thresholds.items():
                below = lambda t, f=f: [r for r in grow if r[2][f] < t]
                for k, t in enumerate(ts):
                    b = below(t)
                    q_b, m_b = sum(r[0] for r in b), sum(not r[0] for r in b)
                    for at_least, q, m in ((True, p - q_b, n - m_b), (False, q_b, m_b)):
                        if q >= quality_rules.MIN_COVER and (rule or (f, at_least) not in barred):
                            gain = q * (math.log2(q / (q + m)) - math.log2(max(p, 1e-9) / (p + n)))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, (f, at_least, t))
            if best is None:
                break
            rule.append(best[1])
            own = [r for r in own if side(r, best[1])]
            steps.append(own)
        if not rule:
            break
        held = lambda x: (sum(r[0] for r in x if not r[1]), sum(not r[0] for r in x if not r[1]))
        while len(rule) > 1:
            (p0, n0), (p1, n1) = held(steps[-1]), held(steps[-2])
            if (p1 - n1) / max(p1 + n1, 1) < (p0 - n0) / max(p0 + n0, 1) or prec(p1, n1) < quality_rules.PRECISION:
                break
            rule.pop()
            steps.pop()
        p, n = sum(r[0] for r in steps[-1]), sum(not r[0] for r in steps[-1])
        hp, hn = held(steps[-1])
        if p < quality_rules.MIN_COVER or prec(p, n) < quality_rules.PRECISION or prec(hp, hn) < quality_rules.PRECISION:
            barred.add(rule[0][:2])
            failed += 1
            continue
        rules.append(rule)
        covered = {id(r) for r in steps[-1]}
        left, barred = [r for r in left if id(r) not in covered], set()
    return rules


def test_kept_is_what_a_plain_covering_learner_keeps(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    seen = {}
    learn = quality_rules.learn
    monkeypatch.setattr(quality_rules, "learn", lambda h, t: seen.setdefault("rules", learn(h, seen.setdefault("thresholds", t))))
    stats = quality_rules.written(quality_rules.statistics(queries.table(spark, sf, "documents")), "stats")
    labels = queries.table(spark, sf, "labels")
    rules = quality_rules.fit(stats, labels)
    f = quality_rules.features()
    rows = stats.where(~quality_rules.base_failed()).join(labels, "doc_id").where("quality is not null").select((F.col("quality") == 0).alias("low"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow"), F.struct(*(c.alias(k) for k, c in f.items())).alias("f")).collect()
    assert rules == plain_covering([(r.low, r.grow, r.f.asDict()) for r in rows], seen["thresholds"])
    kept = {r.doc_id: r for r in stats.select("doc_id", quality_rules.verdict(rules).alias("kept"), F.struct(*(c.alias(k) for k, c in f.items())).alias("f")).collect()}
    assert rules and all(r.kept == (not any(all((r.f[k] >= t) == side for k, side, t in rule) for rule in rules)) for r in kept.values())


def test_decision_list():
    cells = [quality_rules.Cell({"f": b, "g": k % 2}, k % 3 > 0, 10 if b else 0, 0 if b else 10) for k, b in enumerate([0, 1, 0, 1, 0, 1])]
    assert quality_rules.learn_list(cells, {"f": [0.5], "g": [1.0]}) == [[("f", True, 0.5)]]
    assert quality_rules.learn_list([], {"f": [0.5]}) == []
    mixed = [quality_rules.Cell({"f": b}, k % 2 > 0, 5, 5) for k, b in enumerate([0, 1, 0, 1])]
    assert quality_rules.learn_list(mixed, {"f": [0.5]}) == []


def test_quality_rules_learn_each_kind_of_spam(spark):
    # four kinds of low quality, each a quarter of the low class and each apart from all fine texts
    rng = random.Random(8)
    cells = [(k, 0, k % 4 if k % 3 == 0 else None) for k in range(2400)]
    rows, labels = [], []
    for k, _, kind in cells:
        n, chars = rng.randrange(80, 400), 0
        chars = n * 5 + rng.randrange(n)
        some = rng.randrange(n // 5, n)
        rows.append((k, n, chars, some if kind == 0 else 0, some // 8 if kind == 1 else 0, 0, some if kind == 2 else rng.randrange(n // 20 + 1), some if kind == 3 else 0))
        labels.append((k, int(kind is None)))
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long")
    rules = quality_rules.fit(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.kept for r in stats.select("doc_id", quality_rules.verdict(rules).alias("kept")).collect()}
    low, fine = [got[k] for k, _, kind in cells if kind is not None], [got[k] for k, _, kind in cells if kind is None]
    assert sum(not x for x in low) >= 0.97 * len(low) and sum(fine) >= 0.99 * len(fine)


def toxic_corpus(n=900):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8)))
    vocab = [word() for _ in range(600)]
    out = []
    for k in range(n):
        w = [rng.choice(vocab) if rng.random() < 0.8 else word() for _ in range(rng.randrange(20, 120))]
        bad = k % 6 == 0
        for _ in range(rng.randrange(2, 5) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "idiotic!!", "Moron"]))
        out.append((k, " ".join(w), bad))
    return out


def test_toxicity(spark, docs, texts):
    corpus = toxic_corpus()
    d = frame(spark, [(k, t, "en", "a") for k, t, _ in corpus])
    labels = spark.createDataFrame([(k, int(b)) for k, _, b in corpus if k % 5] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(d, model).collect()}
    held = [(b, got[k]) for k, _, b in corpus if k % 4 == 2 or not k % 5]
    assert sum(b and p for b, p in held) >= 0.9 * sum(b for b, _ in held) and sum(p and not b for b, p in held) <= 0.03 * len(held)
    out = toxicity.toxicity(docs, model).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert toxicity.without_toxic(d, model).columns == d.columns
    none = toxicity.fit(d, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}


def test_toxicity_learns_from_rare_toxic_labels(spark):
    # 40 toxic rows among 4000, all behind the calibration's first rows by hash
    corpus = [(k, t) for k, t, b in toxic_corpus(4800) if not b]
    bad = [(100000 + k, t) for k, t, b in toxic_corpus(900) if b]
    d = frame(spark, [(k, t, "en", "a") for k, t in corpus + bad])
    labels = spark.createDataFrame([(k, 0) for k, _ in corpus] + [(k, 1) for k, _ in bad[:40]], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, calibration=20)
    assert model.fitted
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(d, model).collect()}
    unseen = [got[k] for k, _ in bad[40:]]
    assert sum(unseen) >= 0.9 * len(unseen) and sum(got[k] for k, _ in corpus) <= 0.01 * len(corpus)


def brute_kneser_ney(classes, words):
    """Log ratio of each word, from the definition, with dictionaries."""

    def level(counts, x, lower):
        n = Counter(counts.values())
        d = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return (max(counts.get(x, 0) - d, 0) + d * len(counts) * lower) / sum(counts.values())

    shown = [Counter(w for _, w in {(t[k - 1] if k else None, t[k]) for t in texts for k in range(len(t))}) for texts in classes]
    shared = Counter(w for c in shown for w in c)
    lower = {w: level(shared, w, 1 / (len(shared) + 1)) for w in words}
    return [math.log(level(shown[0], w, lower[w]) / level(shown[1], w, lower[w])) for w in words]


def test_toxicity_is_kneser_ney():
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(30)]
    classes = [[[rng.choice(vocab[a : a + 22]) for _ in range(rng.randrange(0, 9))] for _ in range(12)] for a in (0, 8)]
    classes[0].append(classes[0][3])  # a copy counts once
    hashed = lambda t: np.array([tb.hash_of(w) for w in t], np.uint64)
    m = toxicity.Model(*toxicity.language_models(*([hashed(t) for t in c] for c in classes)), np.zeros(2), 0.5)
    assert np.allclose(m.p.sum(0), 1)  # over all words and one unknown
    for text in (["w1", "w20", "new", "w3", "w29", "w29"], vocab, classes[0][2], ["new"]):
        h = hashed(text)
        got, want = toxicity.ratios(h, m), brute_kneser_ney(classes, text)
        assert np.allclose(got, want)
        if len(h):
            assert math.isclose(toxicity.measure(h, np.array([0, len(h)]), m)[0], np.mean(sorted(want, reverse=True)[: toxicity.TELLING]))


def test_toxicity_measures_whole_texts():
    rng = random.Random(13)
    vocab = [f"w{k}" for k in range(40)]
    classes = [[[rng.choice(vocab[a : a + 30]) for _ in range(rng.randrange(5, 40))] for _ in range(20)] for a in (0, 10)]
    hashed = lambda t: np.array([tb.hash_of(w) for w in t], np.uint64)
    held = [hashed(t) for c in classes for t in c]
    m = toxicity.build(*([hashed(t) for t in c] for c in classes), held, [1] * 20 + [0] * 20, 0.5)
    assert m.share in toxicity.SHARES and np.allclose((m.share * m.p[:, 0] + (1 - m.share) * m.p[:, 1]).sum(), 1)
    texts = [["w1"], [], ["w1", "w2", *vocab[30:]], ["w1", "w2", *vocab[30:] * 5], vocab]
    for share in (1.0, m.share):
        m.share = share
        got = toxicity.measure(*toxicity.joined([hashed(t) for t in texts]), m)
        for t, x in zip(texts, got, strict=True):
            want = [math.log(1 - share + share * math.exp(r)) for r in brute_kneser_ney(classes, t)]
            assert math.isclose(x, sum(want) / len(t) if t else 0, rel_tol=1e-6, abs_tol=1e-12)
        assert got[2] > got[3]  # every word counts, not the most toxic ones alone


def test_toxicity_sample_is_bounded(spark):
    # one id, labelled toxic, has most of the rows: many texts, and one of them many times
    corpus = toxic_corpus(600)
    rows = [(k, t, "en", "a") for k, t, _ in corpus] + [(600 * 10**6, f"{t} {k}", "en", "a") for k, (_, t, b) in enumerate(corpus) if b for _ in range(30)]
    labels = [(k, int(b)) for k, _, b in corpus] + [(600 * 10**6, 1)]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels * 2, "doc_id long, toxic int"), sample=60, calibration=30)
    assert model.fitted and len(model.words) < 60 * 130 * 2


def on_duckdb(spark, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql).df()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda x: sorted((tuple("" if pd.isna(v) else float(v) for v in r) for r in x[cols].itertuples(index=False)), key=str)
    assert [str(x) for x in rows(a)] == [str(x) for x in rows(b)]


def test_sql_says_the_same(spark, docs, sf):
    labels = queries.table(spark, SF, "labels")
    for df in (docs.where("doc_id is null or length(text) < 40000"), sf):  # SQL is slow on the longest
        d = df.select("doc_id", "text")
        key = lambda x: x.fillna(-1).astype({c: "int64" for c in x.columns if x[c].dtype.kind in "fb"}).sort_values(sorted(x.columns)).reset_index(drop=True)[sorted(x.columns)]
        for got, sql in (
            (ngram_join.ngram_components(df), queries.NGRAM_SQL),
            (license_scan.license_scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), queries.LICENSE_SQL),
            (quality_rules.quality_rules(df, labels).select("doc_id", *quality_rules.BASE, "base_failed"), queries.QUALITY_SQL),
        ):
            a, b = key(got.toPandas()), key(on_duckdb(spark, sql, documents=d))
            assert a.astype(str).equals(b.astype(str)), a.compare(b)


def test_mixing(spark, docs, sf, monkeypatch):
    for shard in (4096, 16):
        monkeypatch.setattr(mixing, "SHARD_DOCS", shard)
        for df in (docs, sf):
            got = mixing.mix(df).drop("source").toPandas()
            same(got, on_duckdb(spark, mixing.oracle_sql(), documents=df.select("doc_id", "text", "source")))
            assert (got.taken <= 3 * got["size"]).all()
    mixed = mixing.mixed_documents(sf)
    assert mixed.columns == sf.columns
    take = mixing.mix(sf).toPandas().groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert ((take.k - take.t).abs() <= 0.05 * take.t).all()


def test_mixing_of_rows_that_share_an_id(spark):
    # a third of the rows has one id, a third has none; many of them alike
    rng = random.Random(11)
    rows = [(k if k % 3 else 7 if k % 2 else None, "w " * rng.choice([1, 1, 5, 30]), "en", rng.choice(["a", "a", "b", None])) for k in range(6000)]
    df = frame(spark, rows).repartition(5)
    same(mixing.mix(df).drop("source").toPandas(), on_duckdb(spark, mixing.oracle_sql(), documents=df.select("doc_id", "text", "source")))


def test_small_sources_stay_beside_a_hot_one(spark):
    hot = [(k, "word " * 100, "en", "hot") for k in range(1000)]
    small = [(5000 + 100 * s + k, "one two three", "en", f"small{s}") for s, n in enumerate((10, 1, 50)) for k in range(n)]
    mixed = Counter(r.source for r in mixing.mixed_documents(frame(spark, hot + small)).select("source").collect())
    assert [mixed[f"small{s}"] for s in range(3)] == [30, 3, 150]
    assert 900 <= mixed["hot"] <= 1000


def test_seats_are_highest_quotients(spark):
    rng = random.Random(3)
    for total in (0, 1, 7, 100):
        votes = [rng.choice([0, 1, 5, 5, 1000, 33]) for _ in range(15)]
        df = spark.createDataFrame([(k, v, total) for k, v in enumerate(votes)], "k int, v long, t long")
        got = {r.k: r.s for r in mixing.seats(df, [], "v", "t", "k", "s").collect()}
        want = Counter(k for _, k, _ in sorted((-v / (2 * j + 1), k, j) for k, v in enumerate(votes) if v for j in range(total))[:total])
        assert got == {k: want[k] for k in range(15)}


@pytest.mark.parametrize("shard, block, leaf", [(16384, 4096, 256), (20, 2, 8)])
def test_topk(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAF", leaf)
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 5)], 0) for k in range(150)]
    rows += [(200, None, 0), (220, [1.0, None, 0.0, 0.0, 0.0], 0), (240, [float("nan")] * 5, 0), (260, [float("inf")] * 5, 0), (280, [1.0, 2.0], 0), (281, [3.0, 4.0], 0), (300, [], 0), (None, [1.0] * 5, 0), (20, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("shard", F.lit(2))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).toPandas()
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, qv in ok:
        if q % 20 == 0 and q != 20:
            s = sorted(((-sum(a * b for a, b in zip(qv, cv, strict=True)), c) for c, cv in ok if c != q and len(cv) == len(qv)))[:20]
            want[q] = [(r, c, -x) for r, (x, c) in enumerate(s, 1)]
    found = {int(q): [(int(r.rank), int(r.vec_id), int(r.score)) for r in g.itertuples()] for q, g in got[got.query_id != 20].sort_values("rank").groupby("query_id")}
    assert found == {q: x for q, x in want.items() if x}


def test_a_query_opens_only_nodes_that_its_bound_allows(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (16, 8))
    x = np.floor(np.repeat(centres, 40, 0) + rng.normal(0, 1, (640, 8)))
    ids = np.arange(640)
    tree = topk.BallTree(x, ids, 20)
    assert len(tree.start) > 32 and (tree.child[0] >= 0).all() and sorted(tree.ids.tolist()) == ids.tolist()
    for n in range(len(tree.start)):  # every row lies in its node's ball, and children share their parent's rows
        rows = tree.x[tree.start[n] : tree.end[n]]
        assert np.sqrt(((rows - tree.centre[n]) ** 2).sum(1)).max() <= tree.radius[n] + 1e-9
        if tree.child[n, 0] >= 0:
            assert {tree.start[n], tree.end[n]} == {tree.start[tree.child[n]].min(), tree.end[tree.child[n]].max()}
    opened = []
    exact = topk.exact_products
    monkeypatch.setattr(topk, "exact_products", lambda q, y: (opened.append(len(q) * len(y)), exact(q, y))[1])
    s, i = topk.search(tree, x[::10], ids[::10], 5, np.full(64, topk.NEVER))
    for a, row in enumerate(range(0, 640, 10)):
        want = sorted((-int(p), c) for c, p in enumerate(x @ x[row]) if c != row)[:5]
        assert list(zip((-s[a]).tolist(), i[a].tolist(), strict=True)) == want
    assert sum(opened) < 0.3 * 64 * 640
    none, _ = topk.search(tree, x[:3], ids[:3], 5, np.full(3, 10**9))
    assert (none == topk.NEVER).all()


def test_exact_products_of_large_integers():
    q = np.array([[2.0**60, 3.0]])
    assert topk.exact_products(q, np.array([[1.0, 2.0]])).tolist() == [[2**60 + 6]]
    assert topk.exact_products(q, q).tolist() == [[2**63 - 1]]


def test_empty_tables(spark):
    d = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    model, counts = lm_score.fit(d, F.col("doc_id") % 7 != 2)
    bpe = public_tokenizers.path("byte_bpe_50k.json")
    for df in (
        license_scan.license_scan(d), ngram_join.ngram_components(d), language_id.language_id(d, language_id.fit(d)), lm_score.lm_score(d, F.col("doc_id") % 7 == 2, model, counts), packing.pack(d, bpe), token_count.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
        quality_rules.quality_rules(d, labels), toxicity.toxicity(d, toxicity.fit(d, labels)), mixing.mix(d), topk.top_k(vectors, F.col("vec_id") % 20 == 0), ngram_join.one_of_each(d), mixing.mixed_documents(d),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, docs, texts, tmp_path):
    d = docs
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = d
        d = corpus_pipeline.written(stage(spark, d, str(tmp_path)), name)
        if name != "packing":
            assert d.columns == before.columns
            assert not d.exceptAll(before).isEmpty() or d.count() <= before.count()
        if name == "ngram_join":
            left = [(r.doc_id, r.text, None, None) for r in d.select("doc_id", "text").collect()]
            assert all(c == i for i, n, c in brute_components(left) if n)
    assert d.columns == packing.NAMES


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == packing.NAMES and out.count() > 0
