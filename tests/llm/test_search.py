"""Hard negatives and source divergence against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from flowmill.llm import divergence, hard_negatives

from .fixtures import awkward, empty

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows: list[tuple], every: int = 100) -> list[tuple]:
    best: dict[int, tuple] = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        item = (label, [math.floor(256 * float(x)) for x in v])
        best[i] = min(best.get(i, item), item)
    dims = max((len(v) for _, v in best.values()), default=0)
    ids = sorted(best)
    x = np.array([best[i][1] + [0] * (dims - len(best[i][1])) for i in ids], np.int64).reshape(len(ids), dims)
    out = []
    for a in (k for k, i in enumerate(ids) if i % every == 0):
        order = sorted(range(len(ids)), key=lambda k: (-int(x[k] @ x[a]), ids[k]))
        score = {k: int(x[k] @ x[a]) for k in order}
        for p in [k for k in order if k != a and best[ids[k]][0] == best[ids[a]][0]][:5]:
            fits = [k for k in order if best[ids[k]][0] != best[ids[a]][0] and 80 * score[p] <= 100 * score[k] <= 100 * score[p]]
            out += [(ids[a], ids[p], r, ids[k], score[p], score[k]) for r, k in enumerate(fits[:5], 1)]
    return sorted(out)


def got(spark, rows, every=100, **index):
    rows = [(i, v and [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' as v", "1 as leaf", "2 as part", "3 as score")
    found = hard_negatives.mine(df, F.col("vec_id") % every == 0, F.col("label"), **index)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i) - 50, [float(x) for x in rng.normal(size=4).astype(np.float32)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(None, [1.0, 0, 0, 0], 1), (1001, None, 1), (1002, [1.0, None, 0, 0], 1), (1003, [float("nan"), 0, 0, 0], 1), (1004, [float("inf"), 0, 0, 0], 0), (1005, [1.0, 0, 0, 0], None)]
    rows += [(1006, [0.5], 2), (1007, [], 1), (1100, [0.0] * 4, 0), (5, [9.0, 9, 9, 9], 1), *rows[7:9]]
    rows += [(2000 + i, [0.5, 0.25, 0.0, 1.0], i % 2) for i in range(60)]  # copies
    assert got(spark, rows, 50, sample=200, leaf_rows=8, part_rows=16) == mined(rows, 50)


def test_clusters_leave_rows_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 4
    rows = [(i, [float(x) for x in (centres[i % 20] + rng.normal(size=8) * 0.1).astype(np.float32)], i % 3) for i in range(2000)]
    assert got(spark, rows, leaf_rows=50) == mined(rows)
    index = hard_negatives.Index(hard_negatives.usable(spark.createDataFrame(rows, VECTORS), F.col("label")), leaf_rows=50)
    near = index.rows.where("vec_id % 100 = 0").withColumns({"low": F.array(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x) * 95 / 100), "high": F.array(F.lit(1 << 40))})
    assert index.compared(near.selectExpr("v", "transform(low, x -> cast(x as long)) as low", "high")) < 0.3


def test_every_leaf_in_a_task_of_its_own(spark):
    """Without Spark's merging of small partitions, and with queries in several blocks."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)], i % 3) for i in range(1500)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    before, hard_negatives.QUERY_ROWS = hard_negatives.QUERY_ROWS, 7
    try:
        assert got(spark, rows, 50, leaf_rows=12, part_rows=20) == mined(rows, 50)
    finally:
        hard_negatives.QUERY_ROWS = before
        for k, v in held.items():
            spark.conf.set(k, v)


def test_tiny_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0], 1)]) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2), (3, [-1.0], 2), (100, [-1.0], 1)]
    assert got(spark, rows) == mined(rows) != []


def test_products_beyond_doubles():
    q = np.array([[2.0**25 - 1] * 64]) - np.arange(64)
    assert hard_negatives._products(q, q)[0, 0] == sum((2**25 - 1 - i) ** 2 for i in range(64))


def diverged(rows: list[tuple], min_docs: int) -> list[tuple]:
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms), count[lang].update(terms), docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def p(key, kept=kept):
            n = sum(count[key][t] for t in kept)
            return {t: 1 + 10**9 * (count[key][t] + 5) // (n + 5 * len(kept)) for t in kept}

        own, every = p((lang, source)), p(lang)
        others = [(s, p((lang, s))) for g, s in groups if g == lang and s != source]
        pairs = [(s, sum(abs(v - q[t]) for t, v in own.items())) for s, q in others]
        above = [(t, own[t] - every[t]) for t in kept if count[lang, source][t] > 0 and own[t] > every[t]]
        for part, items, top in (("pair", pairs, None), ("term", above, 50)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, r) for r, (i, v) in enumerate(items[:top], 1)]
    return sorted(out)


def test_divergence_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 1000)
    many = [(f"w{i % 7} W{'abcdefgh'[i % 8]} ünï{'xyz'[i % 3]} 𐐀é Ａ", "en", f"s{i % 9}") for i in range(80)]
    docs = awkward(spark).select("doc_id", "text", "lang", "source", F.lit(1).alias("n"), F.lit("t").alias("term"), F.lit(0).alias("total"), F.lit("b").alias("block"))
    docs = docs.unionByName(spark.createDataFrame([(*m, i) for i, m in enumerate(many)], "text string, lang string, source string, doc_id long").selectExpr("*", "1 as n", "'t' as term", "0 as total", "'b' as block"))
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    for min_docs in (1, 2, 30, 1000):
        assert sorted(tuple(r) for r in divergence.audit(docs, min_docs).collect()) == diverged(rows, min_docs)


def test_blocks_and_tiles_add_up(spark):
    docs = spark.createDataFrame([(f"a b{i % 3} c{i % 5} d{i}", "en", f"s{i % 11}") for i in range(60)], "text string, lang string, source string")
    counts = divergence.term_counts(docs)
    cells = divergence.kept_cells(counts, 1)
    sums = lambda block, tile: sorted(map(tuple, divergence.pair_sums(divergence.run_columns(cells, block), divergence.groups_of(counts, cells, tile)).collect()))
    assert sums(4, 3) == sums(2048, 64) and len(sums(4, 3)) == 55


def test_runs(spark):
    docs = spark.createDataFrame([("a a b b c d", "en", "s"), ("d e", "en", "t")], "text string, lang string, source string")
    r = {x["source"]: x for x in divergence.run_columns(divergence.kept_cells(divergence.term_counts(docs), 1)).collect()}
    assert (r["s"]["size"], r["s"]["starts"], r["s"]["counts"]) == (5, [0, 2, 4], [2, 1, 0])  # a b d c e
    assert (r["t"]["starts"], r["t"]["counts"]) == ([0, 2, 3, 4], [0, 1, 0, 1])


def test_shares_of_any_size(spark):
    n = [0, 4, 10**10, 9 * 10**17]
    want = [1 + 10**9 * (c + 5) // (10**18 + 5 * 7) for c in n]
    assert divergence.shares(np.array(n, np.int64), 10**18, 7).tolist() == want
    df = spark.createDataFrame([(c, 10**18, 7) for c in n], "n long, total long, terms long")
    assert [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).collect()] == want


def test_divergence_of_nothing(spark):
    assert divergence.audit(empty(spark)).count() == 0
