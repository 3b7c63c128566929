"""Quality, language and class-based language models."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import brown_lm, langid_nb, quality_fm, queries, textvec

from .fixtures import DOCS, awkward, empty, words


def held(i, mod, rem):
    return zlib.crc32(str(i).encode()) % mod == rem


def test_word_hashes_follow_the_words():
    texts = ["Ab cd  ab", "", "cd\nAB é", "xyz"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    s, e, row = textvec.words(data, off, textvec.NON_SPACE)
    got = [(int(r), data[a:b].tobytes().decode()) for a, b, r in zip(s, e, row)]
    assert got == [(0, "Ab"), (0, "cd"), (0, "ab"), (2, "cd"), (2, "AB"), (2, "é"), (3, "xyz")]
    h = textvec.span_hashes(textvec.ASCII_LOWER[data], s, e)
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    dim = (1 << quality_fm.WORD_BITS) + quality_fm._N_STATS * quality_fm.BINS
    m = quality_fm.Machine(0.3, rng.normal(size=dim).astype(np.float32), rng.normal(size=(dim, 4)).astype(np.float32))
    i, x = rng.choice(dim, 12, replace=False), rng.normal(size=12).astype(np.float32)
    brute = m.bias + m.linear[i] @ x + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(12) for b in range(a))
    assert quality_fm.raw_scores(m, i, x, np.array([0, 12]))[0] == pytest.approx(brute, rel=1e-3)


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op2_quality_fm(spark, "/root/testdata/sf0.01")
    assert out.count() == docs.count()
    j = out.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in j]) > 0.95
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == bool(r.predicted) and held(r.doc_id, 3, 1) for r in j)


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (9, 1, None), (5, None, 0), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    m = quality_fm.train(awkward(spark), labels, lambda i: F.lit(False))
    rows = quality_fm.score(awkward(spark), m).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    kept = quality_fm.keep_good(awkward(spark), m)
    assert kept.columns == awkward(spark).columns and kept.count() == sum(r.predicted for r in rows)
    none = quality_fm.train(empty(spark), labels.limit(0), lambda i: F.lit(False))
    assert {r.score for r in quality_fm.score(awkward(spark), none).collect()} == {0.5}
    assert quality_fm.score(empty(spark), none).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    j = queries.op3_langid_nb(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in j]) > 0.97 and all(held(r.doc_id, 4, 2) for r in j)


def test_language_counts_match_brute_force(spark):
    rows = [(1, "Abc ab", "x"), (2, "zz-9 é", "y"), (3, "abc", "x"), (4, "...", "y"), (5, None, "x")]
    langs, prior, matrix = langid_nb.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["x", "y"] and np.allclose(np.exp(prior), [2 / 3, 1 / 3])
    # 1-, 2- and 3-grams: "abc ab" 6+5+4, "abc" 3+2+1; "zz   é" 6+5+4
    total = np.exp(matrix.astype(float))
    smallest = total.min(1)
    assert np.allclose(langid_nb.ALPHA / smallest - langid_nb.ALPHA * (1 << langid_nb.BITS), [21, 15], atol=0.5)


def test_language_predictions_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randint(1, 20), "abcéx " if i % 3 else "xyz汉b")), ["p", "q", "r"][i % 3]) for i in range(60)]
    rows += [(100, "½ ² ①", "p"), (101, "12 ++", None), (102, "x", None), (103, "", "q"), (104, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prior, matrix = model = langid_nb.train(df.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in langid_nb.predict(df, model).collect()}

    def grams(text):
        cp = [ord(c) if ord(c) > 127 or c.isalpha() else 32 for c in text.lower()]
        for n in langid_nb.ORDERS:
            for i in range(len(cp) - n + 1):
                with np.errstate(over="ignore"):
                    g = np.array([n], np.uint64)
                    for k in range(n):
                        g = g + np.uint64(cp[i + k]) * textvec.salt(10 * n + k)
                yield int(textvec.mix(g)[0] >> np.uint64(64 - langid_nb.BITS))

    counts, docs_of = collections.defaultdict(collections.Counter), collections.Counter()
    for i, text, lang in rows:
        if i % 2 == 0 and lang and any(c.isalpha() for c in text):
            counts[lang].update(grams(text))
            docs_of[lang] += 1
    assert langs == sorted(docs_of)
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logit = []
        for lang in langs:
            total = sum(counts[lang].values()) + langid_nb.ALPHA * (1 << langid_nb.BITS)
            logit.append(math.log(docs_of[lang] / sum(docs_of.values())) + sum(math.log((counts[lang][g] + langid_nb.ALPHA) / total) for g in grams(text)))
        best = max(range(len(langs)), key=lambda k: logit[k])
        assert got[i].lang_pred == langs[best]
        assert got[i].score == pytest.approx(1 / sum(math.exp(x - logit[best]) for x in logit), rel=1e-3)


def test_language_of_awkward_rows(spark):
    model = langid_nb.train(awkward(spark))
    by = {r.doc_id: r for r in langid_nb.predict(awkward(spark), model).collect()}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 4))
    assert by[5].lang_pred in ("en", "fr") and 0 < by[5].score <= 1
    assert {r.lang_pred for r in langid_nb.predict(awkward(spark), langid_nb.train(empty(spark))).collect()} == {"und"}
    assert langid_nb.predict(empty(spark), model).count() == 0


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def score_rows(spark, docs, trained):
    model, rest = brown_lm.train(trained)
    return brown_lm.score(docs, model, rest).collect(), (model, {r.h: (r.n, r.cls) for r in rest.collect()})


def test_counts_and_base_score_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "HEAD", 40)
    monkeypatch.setattr(brown_lm, "SEEDS", 20)
    rng, vocab = random.Random(2), words(random.Random(1), 120)
    docs = [(i, " ".join(rng.choice(vocab[: 20 + i]).upper() if rng.random() < 0.1 else rng.choice(vocab[: 20 + i]) for _ in range(rng.randint(0, 60))), "", "", 0) for i in range(60)]
    df = spark.createDataFrame(docs, DOCS)
    out, (model, rest) = score_rows(spark, df, df.where("doc_id % 3 <> 0"))
    c = collections.Counter(t for i, x, *_ in docs if i % 3 for t in tokens(x))
    n, v = sum(c.values()), len(c)
    assert len(model.head) <= 41 and len(model.head) + len(rest) == v
    # class of each word, then every count of the model by brute force
    head = {int(k): (int(m), int(x)) for k, m, x in zip(model.head, model.head_n, model.head_class)}

    def key(word):
        if word is None:
            return brown_lm.END_KEY
        data = np.frombuffer(word.encode(), np.uint8)
        h, shape, _ = brown_lm.token_stream(data, np.array([0, len(data)]))
        return int(brown_lm.keyed(h[:1], shape[:1])[0])

    signed = lambda k: k - (1 << 64) if k >= 1 << 63 else k
    context = lambda k: head[k][1] if k in head else brown_lm.CLASSES + 1 + (k & 3)
    trans = np.zeros((brown_lm.TOTAL, brown_lm.TOTAL))
    for i, x, *_ in docs:
        before = brown_lm.CLASSES
        for t in tokens(x) if i % 3 else []:
            k = key(t)
            if k in head:
                trans[before, head[k][1]] += 1
                assert head[k][0] == c[t]
            else:
                m, cls = rest[signed(k)]
                assert m == c[t] and 0 <= cls < brown_lm.CLASSES
                trans[before, cls] += 1 - brown_lm.DISCOUNT / m
                trans[before, brown_lm.CLASSES + 1 + (k & 3)] += brown_lm.DISCOUNT / m
            before = context(k)
    into = trans.sum(0)
    p_class = (trans + brown_lm.PRIOR * (into + 1) / (into.sum() + brown_lm.TOTAL)) / (trans.sum(1, keepdims=True) + brown_lm.PRIOR)
    assert np.allclose(model.transition, p_class) and np.allclose(model.class_n, into)
    unseen = collections.Counter(k & 3 for k in rest)

    def brute(text):
        total, before = 0.0, brown_lm.CLASSES
        for t in tokens(text):
            k = key(t)
            if k in head:
                p = p_class[before, head[k][1]] * head[k][0] / into[head[k][1]]
            elif signed(k) in rest:
                m, cls = rest[signed(k)]
                p = p_class[before, cls] * (m - brown_lm.DISCOUNT) / into[cls]
            else:
                p = p_class[before, brown_lm.CLASSES + 1 + (k & 3)] / (unseen[k & 3] + 1)
            total += math.log10(brown_lm.MIXTURE * p + (1 - brown_lm.MIXTURE) * (c[t] + 1) / (n + v + 1))
            before = context(k)
        return total
    for r in out:
        t = tokens(docs[r.doc_id][1])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
        assert r.score == pytest.approx(brute(docs[r.doc_id][1]))


def test_exchange_raises_the_exact_likelihood():
    rng = np.random.default_rng(5)
    words_, size = 60, 60 + 1 + brown_lm.SHAPES
    a, b = rng.integers(0, size, 3000), rng.integers(0, size, 3000)
    b = np.where((a > 0) & (a <= words_), (a + 30 * rng.integers(0, 2, 3000)) % size, b)
    n = rng.integers(1, 9, 3000)
    seen = []

    def value(cls):
        t = brown_lm.TOTAL
        return brown_lm.likelihood(np.bincount(cls[a] * t + cls[b], n.astype(float), t * t).reshape(t, t))

    start = np.concatenate([[brown_lm.CLASSES], np.arange(words_) % brown_lm.CLASSES, brown_lm.CLASSES + 1 + np.arange(brown_lm.SHAPES)])
    seen.append(value(start))
    final = brown_lm.exchange(a, b, n, words_, moved=lambda cls: seen.append(value(cls)))
    assert len(seen) > 20 and all(y > x for x, y in zip(seen, seen[1:])) and value(final) == seen[-1]
    for w in range(1, words_ + 1):  # no single move is better: a local optimum
        for g in range(brown_lm.CLASSES):
            other = final.copy()
            other[w] = g
            assert value(other) <= seen[-1] + 1e-6


def test_classes_beat_the_base_on_structured_text(spark):
    """Alternating word kinds: the next class is certain, so the class model must gain."""
    rng = random.Random(3)
    a, b = words(rng, 40, "abc"), words(rng, 40, "xyz")
    docs = [(i, " ".join(rng.choice(a) + " " + rng.choice(b) for _ in range(30)), "", "", 0) for i in range(80)]
    df = spark.createDataFrame(docs, DOCS)
    out, _ = score_rows(spark, df, df.where("doc_id < 60"))
    fresh = [r for r in out if r.doc_id >= 60]
    assert np.mean([(r.score - r.base_score) / r.n_tokens for r in fresh]) > 0.2


def test_language_model_of_awkward_rows(spark):
    out, _ = score_rows(spark, awkward(spark), awkward(spark).where("doc_id is not null"))
    assert len(out) == 13 and all(r.n_tokens >= 1 and math.isfinite(r.score) for r in out)
    out, _ = score_rows(spark, awkward(spark), empty(spark))
    assert {r.train_tokens for r in out} == {0} and all(r.n_known == 0 and math.isfinite(r.score) for r in out)
    assert score_rows(spark, empty(spark), awkward(spark))[0] == []
