"""Operator 10: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are lower-case runs of letters and digits. The seeds are chosen so that no alignment that reaches
the threshold is missed. An alignment with M matched words of an item of n scores 3 M - 2 X, X being what
is replaced, added or left out between them; if that is at least 3 t n, at least n (1.5 t - 0.5) - 1 of
its neighbouring matched words are neighbours in both texts: whole word pairs. So each item asks for that
many (`need`) of its pairs within the longest stretch that such an alignment covers, and all but its
need - 1 most frequent pairs are rare seeds, of which at least one must hit; frequent pairs are looked up
for the texts and items that a rare one has joined only. Items so short that the count is 0 (five words or
fewer) take single words as seeds, of which t n must hit. Stretches with enough hits are joined into
windows and aligned, unless so few of the item's words occur in them that no alignment can reach the
threshold. Alignments that reach THRESHOLD of the item's best possible score are matches.

The benchmark is the stated query set: it is broadcast in blocks of at most BLOCK_BYTES of text, one
narrow pass a block, so that its size has no bound; only matches are shuffled.

Defined results: items without words match nothing; null or empty texts match nothing; the best alignment
of each document and item is returned; repeated rows give one match; rows with a null doc_id give matches
with a null doc_id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

MATCH, MISMATCH, GAP = 3, -2, -2
THRESHOLD = 0.45
BLOCK_BYTES = 16 << 20
#: Hits of frequent pairs that are held at once.
HELD_HITS = 1 << 22


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, row = tv.words(data, off, tv.ALNUM)
    return tv.span_hashes(data, s, e), row


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k whole words in a row, and the number of the word each starts at."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        g = sum(h[j : j + n] * tv.salt(500 + j) for j in range(k))
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return tv.mix(g[at]), at


@dataclass
class Seeds:
    """Seed -> (item, position) lists of grams of k words, sorted by seed, with repeats."""

    k: int
    gram: np.ndarray
    item: np.ndarray
    at: np.ndarray

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of grams with hits, first and last entry of each)."""
        lo, hi = np.searchsorted(self.gram, g, "left"), np.searchsorted(self.gram, g, "right")
        some = np.flatnonzero(hi > lo)
        return some, lo[some], hi[some]


@dataclass
class Items:
    """One block of the benchmark: words of each item, its seeds, hits needed in a stretch of so many words,
    and how far an alignment may drift from the diagonal of a hit."""

    ids: list
    words: list[np.ndarray]
    rare: list[Seeds]
    frequent: Seeds
    need: np.ndarray
    stretch: np.ndarray
    drift: np.ndarray


def needed_pairs(n: int, threshold: float) -> int:
    """Word pairs that each alignment of the threshold's score shares with an item of n words."""
    return int(np.ceil(n * (1.5 * threshold - 0.5) - 1 - 1e-9))


def load_items(ids: list, texts: list[str], threshold: float = THRESHOLD) -> Items:
    """A block's items with rare seeds (pairs, and words of short items) and frequent ones."""
    arr = pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string()))
    words: list[np.ndarray] = []
    found: dict[int, list] = {1: [], 2: []}
    need = []
    for k in range(len(arr)):
        for _, _, data, off in tv.byte_slices(arr.slice(k, 1)):
            h, row = word_hashes(data, off)
            pairs = needed_pairs(len(h), threshold)
            size = 2 if pairs >= 1 else 1
            need.append(pairs if pairs >= 1 else max(1, int(np.ceil(threshold * len(h) - 1e-9))))
            g, p = grams(h, row, size)
            words.append(h)
            found[size].append((g, np.full(len(g), k), p))

    def table(size: int) -> tuple[np.ndarray, ...]:
        g, item, at = (np.concatenate([np.zeros(0, t), *c]).astype(t) for c, t in zip(zip(*found[size], strict=True) if found[size] else [[]] * 3, (np.uint64, np.int64, np.int64), strict=True))
        return g, item, at

    need_of = np.array(need, np.int64)
    g, item, at = table(2)
    _, kind, count = np.unique(g, return_inverse=True, return_counts=True)
    order = np.lexsort((at, -count[kind] if len(g) else at, item))  # each item's most frequent pairs first
    place = np.arange(len(g)) - np.searchsorted(item[order], item[order])
    rare = np.zeros(len(g), bool)
    rare[order] = place >= need_of[item[order]] - 1

    def seeds(k: int, own, g, item, at) -> Seeds:
        g, item, at = g[own], item[own], at[own]
        by = np.argsort(g, kind="stable")
        return Seeds(k, g[by], item[by], at[by])

    short = table(1)
    size = np.array([len(w) for w in words], np.int64)
    drift = np.floor(size * (1.5 - 1.5 * threshold) + 1e-9).astype(np.int64)
    return Items(ids, words, [seeds(2, rare, g, item, at), seeds(1, np.ones(len(short[0]), bool), *short)], seeds(2, ~rare, g, item, at), need_of, size + drift, drift)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the window word at which it ends."""
    best, end = 0, 0
    steps = np.arange(len(window) + 1) * -GAP
    prev = np.zeros(len(window) + 1, np.int64)
    for w in item:
        h = np.zeros(len(window) + 1, np.int64)
        np.maximum(prev[:-1] + np.where(window == w, MATCH, MISMATCH), prev[1:] + GAP, out=h[1:])
        np.maximum(h, 0, out=h)
        # gaps along the window: the best start minus its distance
        h = np.maximum.accumulate(h + steps) - steps
        k = int(h.argmax())
        if h[k] > best:
            best, end = int(h[k]), k
        prev = h
    return best, end


def windows(diagonal: np.ndarray, n_item: int, drift: int, n_doc: int) -> list[tuple[int, int]]:
    """Stretches of the text (in words) that alignments through these diagonals can cover; overlapping ones are joined."""
    out: list[tuple[int, int]] = []
    for d in np.unique(diagonal):
        a, b = max(0, int(d) - drift), min(n_doc, int(d) + n_item + drift)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _expanded(seeds: Seeds, some, lo, hi, at, row) -> tuple[np.ndarray, ...]:
    """(text, item, word of the text, word of the item) of each hit."""
    lens = hi - lo
    pick = np.repeat(lo - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
    where = np.repeat(at[some], lens)
    return row[where], seeds.item[pick], where, seeds.at[pick]


def candidates(h: np.ndarray, row: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(text, item, word of the text, word of the item) of all hits in stretches that hold as many as
    their item needs, in order of text, item and word."""
    hits = []
    for seeds in items.rare:
        if len(seeds.gram):
            g, at = grams(h, row, seeds.k)
            some, lo, hi = seeds.hits(g)
            if len(some):
                hits.append(_expanded(seeds, some, lo, hi, at, row))
    if not hits:
        return (np.zeros(0, np.int64),) * 4
    n = len(items.words)
    joined = np.unique(np.concatenate([t * n + k for t, k, _, _ in hits]))
    if len(items.frequent.gram):
        g, at = grams(h, row, 2)
        some, lo, hi = items.frequent.hits(g)
        many = np.isin(row[at[some]], joined // n)  # texts that a rare seed has joined
        some, lo, hi = some[many], lo[many], hi[many]
        step = np.cumsum(hi - lo) // HELD_HITS
        for k in np.unique(step):
            t, i, where, pos = _expanded(items.frequent, *(x[step == k] for x in (some, lo, hi)), at, row)
            own = np.isin(t * n + i, joined)
            hits.append((t[own], i[own], where[own], pos[own]))
    text, item, where, pos = (np.concatenate(c) for c in zip(*hits, strict=True))
    order = np.lexsort((where, item, text))
    text, item, where, pos = text[order], item[order], where[order], pos[order]
    last = np.arange(len(text)) + items.need[item] - 1  # the hit that completes a stretch
    end = np.minimum(last, len(text) - 1)
    full = (last < len(text)) & (text[end] == text) & (item[end] == item) & (where[end] - where <= items.stretch[item])
    inside = np.zeros(len(text) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(full), 1)
    np.add.at(inside, last[full] + 1, -1)
    live = np.cumsum(inside[:-1]) > 0
    return text[live], item[live], where[live], pos[live]


def matches(data: np.ndarray, off: np.ndarray, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text number, item number, score, first word, end word) of the best match of each text and item."""
    h, row = word_hashes(data, off)
    text, item, where, pos = candidates(h, row, items)
    if not len(text):
        return []
    begins = np.searchsorted(row, np.arange(len(off) - 1), "left")
    ends = np.searchsorted(row, np.arange(len(off) - 1), "right")
    cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
    out = []
    for own in np.split(np.arange(len(text)), cuts):
        t, k = int(text[own[0]]), int(item[own[0]])
        doc, words = h[begins[t] : ends[t]], items.words[k]
        best = (0, 0, 0)
        for a, b in windows(where[own] - begins[t] - pos[own], len(words), int(items.drift[k]), len(doc)):
            # each match takes a word of the item, so this bounds the score
            if np.isin(words, doc[a:b]).sum() / len(words) < threshold:
                continue
            s, end = align(words, doc[a:b])
            if s > best[0]:
                best = (s, max(0, a + end - len(words)), a + end)
        score = best[0] / (MATCH * len(words))
        if score >= threshold:
            out.append((t, k, score, best[1], best[2]))
    return out


def _blocks(benchmark: DataFrame, limit: int, threshold: float) -> Iterator[Items]:
    """The items in blocks of about `limit` bytes of text."""
    sized = benchmark.select("item_id", "text").where("text is not null")
    n = int((sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit + 1)
    for k in range(n):
        block = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        if block.num_rows:
            yield load_items(block.column("item_id").to_pylist(), block.column("text").to_pylist(), threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every document that holds a copy of an item."""
    schema = "doc_id long, item_id long, score double, first_word int, end_word int"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, block_bytes, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, _, data, off in tv.byte_slices(pc.utf8_lower(tv.text_array(b, "text"))):
                    got = matches(data, off, shared.value, threshold)
                    if got:
                        t, k, score, first, end = zip(*got, strict=True)
                        ids = b.column(0).take(pa.array(np.array(t) + i))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([shared.value.ids[x] for x in k], pa.int64()), pa.array(score), pa.array(first, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "item_id", "score", "first_word", "end_word"])

        found = found.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    best = F.max(F.struct("score", "first_word", "end_word"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.score", "m.first_word", "m.end_word")


def _without_matches(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        ok = np.ones(len(text), bool)
        for i, _, data, off in tv.byte_slices(pc.utf8_lower(tv.as_text(text))):
            for t, *_ in matches(data, off, shared.value, threshold):
                ok[i + t] = False
        return pa.array(ok)

    return docs.where(clean("text"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a match, with all their columns; narrow passes only."""
    out = docs
    for items in _blocks(benchmark, block_bytes, threshold):
        out = _without_matches(out, items, threshold)
    return out
