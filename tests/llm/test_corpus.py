"""Sharding, mixing, decontamination and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from flowmill.llm import decontam, mix_waterfill, queries, shard_bytes

from .fixtures import DOCS, awkward, empty, words


def test_shards_match_brute_force(spark, sf_dir):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op6_shard_bytes(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    total, run, slots = sum(len(t.encode()) + 8 for _, t in rows), 0, {}
    for i, t in rows:
        size = len(t.encode()) + 8
        shard = min(23, (2 * run + size) * 24 // (2 * total))
        slot = slots[shard] = slots.get(shard, -1) + 1
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (size, zlib.crc32(t.encode()), "bytes", shard, slot, None)
        run += size


def test_shards_don_t_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted(map(tuple, shard_bytes.shard(d).collect())) for d in (docs.coalesce(1), docs.repartition(13)))
    assert a == b


def test_shards_of_awkward_rows(spark):
    rows = shard_bytes.shard(awkward(spark), shards=3).collect()
    assert len(rows) == 13 and shard_bytes.shard(empty(spark)).count() == 0
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    same = spark.createDataFrame([(1, "t", "", "", 0)] * 90, DOCS)
    assert sorted(r["count"] for r in shard_bytes.shard(same, shards=3).groupBy("shard").count().collect()) == [30, 30, 30]


def fill(sizes: dict, weights: dict, cap: float = 3) -> dict:
    """Reshare the excess until no target is above its clamp."""
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in full]
        left, w = total - sum(full.values()), sum(weights[s] for s in free)
        target = {s: left * weights[s] / w for s in free}
        over = [s for s in free if target[s] >= cap * sizes[s]]
        if not over:
            return full | target
        full |= {s: cap * sizes[s] for s in over}
        if len(full) == len(sizes):
            return full


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_iterated_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}" if i else None: rng.choice([0, 1, 5, 50, 400, 3000]) for i in range(12)}
    order = sorted(k for k in sizes if k) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    got = {r.source: r.target for r in mix_waterfill.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = fill(sizes, weights)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_comes_near_its_targets(spark, sf_dir):
    rows = queries.op9_mix_waterfill(spark, sf_dir).collect()
    again = queries.op9_mix_waterfill(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for s in set(source.values()):
        own = [r for r in rows if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert sum(r.size for r in own) == own[0].source_size and all(r.taken <= 3 * r.size for r in own)
    assert sum({source[r.doc_id]: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))


def test_rows_without_ids_are_taken_one_by_one(spark):
    rows = [(None, " ".join(["w"] * (1 + k % 5)) + f" t{k}", None, ["a", "b"][k % 4 == 0], 0) for k in range(200)]
    got = mix_waterfill.copies(spark.createDataFrame(rows, DOCS)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.n_copies for r in own) - own[0].target) <= max(r.size for r in own)


def test_pipeline_stages_on_awkward_rows(spark, sf_dir):
    """Nulls, repeats, long texts and clashing columns through every stage."""
    docs = awkward(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns and (name == "mixing" or docs.count() <= before)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.count() == docs.count()


def test_mixing_repeats_rows(spark):
    df = awkward(spark)
    n = {(r.doc_id, r.source, r.size): r.n_copies for r in mix_waterfill.copies(df).collect()}
    out = mix_waterfill.mixed(df)
    assert out.columns == df.columns and max(n.values()) <= 3
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in mix_waterfill.copies(df).collect() for _ in range(r.n_copies))
    assert mix_waterfill.copies(empty(spark)).count() == 0 and mix_waterfill.mixed(empty(spark)).count() == 0


def test_alignment_matches_the_full_table():
    rng = random.Random(1)
    for _ in range(40):
        a, b = [rng.randrange(5) for _ in range(rng.randint(1, 12))], [rng.randrange(5) for _ in range(rng.randint(0, 15))]
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (decontam.MATCH if x == y else decontam.MISMATCH), h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
        assert decontam.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == h.max()


def leaky(rng):
    vocab = words(random.Random(7), 400)
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 50)))) for k in range(12)]
    docs, want = [], set()
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 300))]
        if d % 3 == 0:
            item, text = items[d % 12]
            copy = text.split()
            if d % 2:  # an edited copy: every seventh word replaced, one dropped, one inserted
                copy = [x if i % 7 != 3 else "changed" for i, x in enumerate(copy)]
                del copy[len(copy) // 2]
                copy.insert(5, "more")
            at = rng.randrange(len(w))
            w[at:at] = [c.upper() if d % 4 else c + "," for c in copy]
            want.add((d, item))
        docs.append((d, " ".join(w), "en", "s", 0))
    return items, docs, want


def test_leaks_are_found_and_clean_rows_left(spark):
    items, docs, want = leaky(random.Random(2))
    # one item leaks into so many documents that its grams are common
    docs += [(1000 + k, f"intro {k} " + items[5][1] + " outro", "en", "s", 0) for k in range(200)]
    want |= {(1000 + k, 5) for k in range(200)}
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 400):
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench, block_bytes=block).collect()} == want
    dirty = {d for d, _ in want}
    assert sorted(r.doc_id for r in decontam.keep_clean(df, bench, block_bytes=1000).collect()) == sorted(d for d, *_ in docs if d not in dirty)


def test_edited_copy_in_many_documents_is_found(spark):
    """One edited copy in 30 documents beside a single exact one, against the alignment of every pair."""
    rng = random.Random(8)
    vocab = words(random.Random(9), 400)
    items = [(k, " ".join(rng.choice(vocab) for _ in range(28))) for k in range(4)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        copy = items[1][1].split()
        if d < 30:
            copy = [x if i % 7 != 3 else "changed" for i, x in enumerate(copy)]
            del copy[len(copy) // 2]
            copy.insert(5, "more")
        if d < 31:
            w[7:7] = copy
        docs.append((d, " ".join(w), "en", "s", 0))
    number = {}
    code = lambda text: np.array([number.setdefault(x, len(number)) for x in text.split()], np.uint64)
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            score = decontam.align(code(item), code(text))[0] / (decontam.MATCH * len(item.split()))
            if score >= decontam.THRESHOLD:
                want[d, i] = score
    assert set(want) == {(d, 1) for d in range(31)}
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in decontam.leaks(df, bench).collect()} == want
    assert {r.doc_id for r in decontam.keep_clean(df, bench).collect()} == set(range(31, 60))


EDITS = {
    "a word after every second": lambda w, r: [y for i, x in enumerate(w) for y in ([x, "added"] if i % 2 else [x])],
    "every third dropped": lambda w, r: [x for i, x in enumerate(w) if i % 3 != 1],
    "every fifth replaced": lambda w, r: [x if i % 5 else "other" for i, x in enumerate(w)],
    "a quarter replaced at random": lambda w, r: [x if r.random() > 0.25 else "other" for x in w],
    "a fifth added at random": lambda w, r: [y for x in w for y in ([x, "added"] if r.random() < 0.2 else [x])],
    "the first half": lambda w, r: w[: len(w) // 2],
    "the middle": lambda w, r: w[len(w) // 4 : -len(w) // 4],
    "halves apart": lambda w, r: [*w[: len(w) // 2], *["gap"] * 6, *w[len(w) // 2 :]],
    "pairs kept, one added": lambda w, r: [y for i, x in enumerate(w) for y in ([x, "more"] if i % 3 == 1 else [x])],
    "neighbours swapped here and there": lambda w, r: [w[i + 1] if i % 8 == 2 and i + 1 < len(w) else w[i - 1] if i % 8 == 3 else x for i, x in enumerate(w)],
    "dropped and added": lambda w, r: [y for i, x in enumerate(w) if i % 9 != 4 for y in ([x, "added"] if i % 4 == 3 else [x])],
}


@pytest.mark.parametrize("vocabulary", [30, 400])
def test_every_alignment_of_the_score_is_found(vocabulary):
    """Eleven ways to edit, items of 1 to 50 words, against the alignment of every pair."""
    rng = random.Random(12)
    vocab = words(random.Random(13), vocabulary)
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 20, 28, 40, 40, 50)]
    docs = []
    for edit in EDITS.values():
        for item in items:
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
            at = rng.randrange(len(w) + 1)
            docs.append(" ".join([*w[:at], *edit(item.split(), rng), *w[at:]]))
    block = decontam.load_items(list(range(len(items))), items)
    got = {}
    for i, _, data, off in decontam.tv.byte_slices(decontam.pa.array(docs, decontam.pa.large_string())):
        got |= {(i + t, k): score for t, k, score, *_ in decontam.matches(data, off, block, decontam.THRESHOLD)}
    number: dict = {}
    code = lambda text: np.array([number.setdefault(x, len(number)) for x in text.split()], np.uint64)
    want = {}
    for d, text in enumerate(docs):
        for k, item in enumerate(items):
            score = decontam.align(code(item), code(text))[0] / (decontam.MATCH * len(item.split()))
            if score >= decontam.THRESHOLD:
                want[d, k] = score
    assert len(want) > 150 and got == want


def test_leaks_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "b c d e f g a")], "item_id long, text string").selectExpr("*", "'x' as g")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(awkward(spark), bench).collect()}
    assert {(6, 4), (7, 4)} <= got and {d for d, i in got if i != 3} == {6, 7}
    assert {d for d, i in got if i == 3} == {6, 7, None}  # a single word, wherever it stands
    assert decontam.keep_clean(awkward(spark), bench).columns == awkward(spark).columns
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(awkward(spark), bench.limit(0)).count() == 0
    assert decontam.keep_clean(awkward(spark), bench.limit(0)).count() == 13


def test_pipeline_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs.count()
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert 0 < len({r.doc_id for r in out}) < start
    leaked = {r.doc_id for r in queries.op10_decontaminate(spark, sf_dir).collect()}
    assert not leaked & {r.doc_id for r in out}
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_pipeline_stages_keep_columns_of_empty_tables(spark, sf_dir):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == empty(spark).columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
