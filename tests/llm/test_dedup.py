"""Near-duplicate documents and lines, components and signatures, against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from flowmill.llm import components, line_dedup, near_dedup

from .fixtures import DOCS, awkward, empty, words


def union(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def corpus(seed: int = 1, groups: int = 12, size: int = 6) -> list[tuple[int, str]]:
    """Groups of edited copies of one text, exact copies and unrelated texts."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = words(rng, rng.randint(20, 120))
        for k in range(size):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = "edited"
            out.append(" ".join(w))
        out.append(" ".join(base).upper())
        out.append(" ".join(base))
    return list(enumerate(out))


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def shingle_set(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_classes_match_brute_force(spark):
    docs = corpus()
    sets = {i: shingle_set(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8]
    want = union(links, sets)
    got = near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_chain_without_a_common_pivot(spark):
    """A chain of small edits whose ends are unlike each other is still one class."""
    rng = random.Random(3)
    w, docs = words(rng, 100), []
    for k in range(12):
        docs.append((k, " ".join(w)))
        w = list(w)
        w[8 * k + 2] = f"new{k}"
    got = near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_hot_group_links_without_all_pairs(spark):
    rng = random.Random(4)
    base, docs = words(rng, 60), []
    for k in range(400):
        w = list(base)
        w[rng.randrange(60)] = f"e{k}"
        docs.append((k, " ".join(w)))
    docs += [(1000 + k, " ".join(words(rng, 60))) for k in range(50)]
    out = near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.class_id for r in out if r.doc_id < 1000} == {0}
    assert all(r.class_id == r.doc_id for r in out if r.doc_id >= 1000)


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    wa, wb = rng.uniform(1, 4, 300), rng.uniform(1, 4, 300)
    a, b = (h[:300], wa), (h[100:], wb)
    m = 4000
    sig = [near_dedup.prob_minhash(x[0], np.zeros(len(x[0]), np.int64), x[1], 1, m)[0] for x in (a, b)]
    order = [np.argsort(x[0]) for x in (a, b)]
    exact = near_dedup.similarity(*((x[0][o], x[1][o]) for x, o in zip((a, b), order)))
    va, vb = dict(zip(h[:300].tolist(), wa)), dict(zip(h[100:].tolist(), wb))
    brute = sum(1 / sum(max(va.get(e, 0) / va[d], vb.get(e, 0) / vb[d]) for e in va | vb) for d in va.keys() & vb.keys())
    assert abs((sig[0] == sig[1]).mean() - brute) < 0.03
    assert exact >= brute - 1e-9 and exact == pytest.approx(max(brute, 200 / 400))


def test_classes_of_awkward_rows(spark):
    got = near_dedup.classes(awkward(spark)).collect()
    assert len(got) == 13
    by_id = {r.doc_id: r.class_id for r in got}
    assert by_id[7] == by_id[6] == 6 and by_id[0] == 0 and by_id[1] == 1 and by_id[None] is None
    assert near_dedup.classes(empty(spark)).count() == 0


def test_keep_one_keeps_columns_and_one_row_an_id(spark):
    df = awkward(spark)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 6, 8, 9] and ids.count(None) == 2


def test_hot_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Groups whose pivots link only a part: several blocks a bucket, each pair of blocks in a task."""
    docs = corpus(seed=6, groups=5, size=16)
    sets = {i: shingle_set(t) for i, t in docs}
    want = union([(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8], sets)
    monkeypatch.setattr(near_dedup.link_buckets, "__defaults__", (None, 4))
    got = near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_one_id_with_two_texts_loses_no_link(spark):
    rng = random.Random(12)
    a, b = words(rng, 80), words(rng, 80)
    docs = [(1, a), (1, b), (2, [*a, "more"]), (3, [*b, "more"]), (4, words(rng, 80))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.classes(df).collect())) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    kept = [r.text for r in near_dedup.keep_one(df).collect()]
    assert sorted(kept) == sorted(" ".join(w) for w in (a, b, docs[4][1]))


def test_recall_of_document_links(spark, sf_dir):
    """Every pair of documents with a Jaccard similarity of 0.8 or more shares a class."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    word = lambda t: [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in docs if (w := word(t))}
    alike = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8]
    found = sum(got[a] == got[b] for a, b in alike)
    assert alike and found >= 0.98 * len(alike)


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_sets(text: str) -> list:
    out = []
    for line in text.split("\n"):
        norm = " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in line.lower()).split())
        out.append({norm[i : i + 5] for i in range(max(1, len(norm) - 4))} if norm else None)
    return out


def test_lines_match_brute_force(spark):
    rng, docs, pool = random.Random(9), [], []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            if pool and rng.random() < 0.5:
                line = list(rng.choice(pool))
                for _ in range(rng.randint(0, 2)):
                    line[rng.randrange(len(line))] = "zq"
            else:
                line = words(rng, rng.randint(3, 30))
            pool.append(line)
            lines.append(" ".join(line) + rng.choice(["", ".", "  !"]))
        docs.append((d, "\n".join([*lines, ""] if rng.random() < 0.3 else lines)))
    sets = {(d, i): s for d, t in docs for i, s in enumerate(line_sets(t)) if s}
    keys = sorted(sets)
    links = [(a, b) for a, b in itertools.combinations(keys, 2) if jaccard(sets[a], sets[b]) >= 0.8]
    want = union(links, keys)
    rows = line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.line_no): ((r.class_doc_id, r.class_line_no), r.keep) for r in rows}
    assert len(got) == sum(t.count("\n") + 1 for _, t in docs)
    assert {k: got[k][0] for k in keys} == want
    assert all(got[k][1] == (want[k] == k) for k in keys)
    assert all(v == ((None, None), True) for k, v in got.items() if k not in sets)


def test_dedup_lines_rebuilds_texts(spark):
    docs = spark.createDataFrame([(1, "one two three four five\n\nsix seven eight nine"), (2, "One, two three four five!\nnew line of words here\n"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: "one two three four five\n\nsix seven eight nine", 2: "new line of words here\n", 3: None}


def edited_lines(seed: int = 4) -> list[tuple[str, str]]:
    """English-like lines of 50 to 75 characters with one character or word changed."""
    rng, out = random.Random(seed), []
    for _ in range(400):
        line = " ".join(words(rng, 30, "etaoinshrdlu"))[: rng.randint(50, 75)]
        at = rng.randrange(len(line))
        out.append((line, line[:at] + "z" + line[at + 1 :]))
    return out


def test_recall_of_short_edited_lines(spark):
    pairs = edited_lines()
    docs = [(2 * k + e, line) for k, pair in enumerate(pairs) for e, line in enumerate(pair)]
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    alike = [k for k, (a, b) in enumerate(pairs) if jaccard(line_sets(a)[0], line_sets(b)[0]) >= 0.8]
    assert len(alike) > 300 and sum(got[2 * k] == got[2 * k + 1] for k in alike) >= 0.95 * len(alike)


def test_one_line_of_repeated_rows_and_rows_without_id_is_kept(spark):
    line = "one line of words that is repeated here"
    docs = spark.createDataFrame([(1, line), (1, line), (None, line + "!"), (2, "another line altogether"), (None, "lone words"), (None, "lone words")], "doc_id long, text string")
    rows = line_dedup.line_classes(docs).collect()
    assert sorted((r.doc_id or 0, r.keep) for r in rows) == [(0, False), (0, False), (0, True), (1, False), (1, True), (2, True)]
    assert sorted(r.text for r in line_dedup.dedup_lines(docs).collect()) == ["", "", "", "another line altogether", "lone words", line]


def test_lines_of_awkward_rows(spark):
    rows = line_dedup.line_classes(awkward(spark)).collect()
    by = {(r.doc_id, r.line_no): r for r in rows}
    assert by[(0, 0)].keep and by[(0, 0)].class_doc_id is None
    assert not by[(8, 2)].keep and by[(8, 2)].class_line_no == 0
    assert not by[(7, 0)].keep and by[(7, 0)].class_doc_id == 6
    assert line_dedup.line_classes(empty(spark)).count() == 0
    assert line_dedup.dedup_lines(awkward(spark)).count() == 13
