"""Operator 8: scoring by a Brown class-based bigram model.

Words (lower-cased A to Z, split at white space, an end token after each text) are counted over all
training rows by Spark, and every word gets one of CLASSES classes by exchange, in the order of
frequency: a word moves to the class under which the likelihood of the class bigrams is largest.
The SEEDS most frequent words are exchanged one at a time, with the exact change of likelihood, until
none moves; their table of at most (SEEDS + 5)^2 counts doesn't grow with the corpus. Then Spark moves
all other words: those among the HEAD most frequent by the seeds' classes on both sides, the rest of
the vocabulary, without a cap, by the class of the word before. The end token is a class of its own. A
token's probability is

    L * P(class | context) * P(word | class) + (1 - L) * (c + 1) / (N + V + 1)

where the context is the class of the word before; of words beyond the HEAD (broadcast, a fixed
number) it is their shape: beyond ASCII or not, ending in punctuation or not. Transitions are smoothed
towards the class frequencies; words beyond the HEAD give DISCOUNT of their count to unseen words of
their shape. Tokens beyond the HEAD meet the vocabulary in a shuffled join by word. Words are known by
55 bits of a hash: at n distinct ones the chance of any collision is about n^2 / 2^56.

Defined results: a null text is an empty one (its end token alone); without training rows every
count is 0 and both scores follow from that; rows with a null doc_id aren't held out but have no
crc32 and don't train; repeated rows count and are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import materialize

HEAD = 65_536
SEEDS = 2_048
CLASSES = 32
SHAPES = 4
#: Classes, the end token, shapes: as contexts, and as what follows (shapes: unseen words).
TOTAL = CLASSES + 1 + SHAPES
#: Passes over the seeds, at most; each ends where no word moves.
STEPS = 24
MIXTURE = 0.9
DISCOUNT = 0.5
PRIOR = 10.0
END = tv.mix(np.array([0x656E64], np.uint64))[0]
_STOP = np.array([c in b".,;:!?)]}\"'%&*$#" for c in range(256)])
#: Distinct items that a task counts in memory before it hands them on.
_HELD = 1 << 20


def token_stream(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, shapes and text numbers of all tokens in order, the end token after each text's words."""
    s, e, row = tv.words(data, off, tv.NON_SPACE)
    h = tv.span_hashes(tv.ASCII_LOWER[data], s, e)
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    shape = ((wide[e] > wide[s]) * 2 + _STOP[data[e - 1]]).astype(np.int8) if len(e) else np.zeros(0, np.int8)
    n = len(off) - 1
    at = np.cumsum(np.bincount(row, minlength=n))
    return np.insert(h, at, END), np.insert(shape, at, np.int8(0)), np.insert(row, at, np.arange(n))


class _Tally:
    """Sums of counts by key, held in arrays; `full` tells when to hand them on."""

    def __init__(self) -> None:
        self.keys, self.counts, self.parts, self.pending = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.pending += len(k)
        if self.pending > _HELD:
            self.merge()

    def merge(self) -> None:
        k = np.concatenate([self.keys, *(p[0] for p in self.parts)])
        n = np.concatenate([self.counts, *(p[1] for p in self.parts)])
        self.keys, where = np.unique(k, return_inverse=True)
        self.counts = np.bincount(where, n, len(self.keys)).astype(np.int64)
        self.parts, self.pending = [], 0

    @property
    def full(self) -> bool:
        return len(self.keys) > _HELD


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()

    def out() -> pa.RecordBatch:
        tally.merge()
        # the two lowest bits of a key carry the word's shape
        return pa.RecordBatch.from_arrays([pa.array(tv.signed(tally.keys)), pa.array(tally.counts)], ["h", "n"])

    for b in batches:
        for _, _, data, off in tv.byte_slices(tv.text_array(b, "text")):
            h, shape, _ = token_stream(data, off)
            tally.add(keyed(h, shape))
            if tally.full:
                yield out()
                tally = _Tally()
    yield out()


#: The bits of a key that hold a context (seven) and a shape (two).
_LOW = np.uint64(511)


def keyed(h: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """A word's key: its hash with its shape in the two lowest bits, and room for a context."""
    return (h & ~_LOW) | shape.astype(np.uint64)


END_KEY = int(END & ~_LOW)


@dataclass
class Model:
    """The broadcast part of the model; its size is fixed by HEAD and CLASSES."""

    head: np.ndarray  # sorted keys
    head_n: np.ndarray
    head_class: np.ndarray
    transition: np.ndarray  # P(class | context)
    class_n: np.ndarray  # tokens of each class, discounted
    shape_v: np.ndarray  # distinct words beyond the head, by shape
    n: int
    v: int

    def log_prob(self, before: np.ndarray, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of tokens in the head."""
        p = MIXTURE * self.transition[before, cls] * c / np.maximum(self.class_n[cls], 1) + (1 - MIXTURE) * (c + 1) / (self.n + self.v + 1)
        return np.log10(p)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(trans: np.ndarray) -> float:
    """What classes contribute to the log likelihood of their bigrams and members."""
    return float(_f(trans).sum() - _f(trans.sum(0)).sum() - _f(trans.sum(1)).sum())


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, n_words: int, steps: int = STEPS, moved=None) -> np.ndarray:
    """Classes of words 1..n_words (0 is the end token, the shapes follow) from bigram counts. One word
    moves at a time, to the class with the largest likelihood; moved(classes) sees each move."""
    size = n_words + 1 + SHAPES
    cls = np.concatenate([[CLASSES], np.arange(n_words) % CLASSES, CLASSES + 1 + np.arange(SHAPES)])
    w = n.astype(np.float64)
    pair = np.bincount(a * size + b, w, size * size).reshape(size, size)
    trans = np.bincount(cls[a] * TOTAL + cls[b], w, TOTAL * TOTAL).reshape(TOTAL, TOTAL)
    right = np.bincount(a * TOTAL + cls[b], w, size * TOTAL).reshape(size, TOTAL)
    left = np.bincount(b * TOTAL + cls[a], w, size * TOTAL).reshape(size, TOTAL)
    k, at = np.arange(CLASSES), np.arange(CLASSES)
    for _ in range(steps):
        still = True
        for x in range(1, n_words + 1):
            g, own = cls[x], pair[x, x]
            le, ri = left[x].copy(), right[x].copy()
            le[g] -= own
            ri[g] -= own
            trans[:, g] -= le
            trans[g, :] -= ri
            trans[g, g] -= own
            into, out = trans[:, :CLASSES], trans[:CLASSES, :].T
            gain = _f(into + le[:, None]) - _f(into) + _f(out + ri[:, None]) - _f(out)
            both, d = gain.sum(0) - gain[k, at], trans[k, k]
            both += _f(d + le[k] + ri[k] + own) - _f(d)
            # sums without the word's own tokens, which go to one class
            rows, cols = trans.sum(1)[:CLASSES] + le[k], trans.sum(0)[:CLASSES] + ri[k]
            both -= _f(rows + ri.sum() + own) - _f(rows) + _f(cols + le.sum() + own) - _f(cols)
            best = int(both.argmax())
            if both[best] <= both[g] + 1e-9 * max(1.0, abs(both[g])):
                best = g
            trans[:, best] += le
            trans[best, :] += ri
            trans[best, best] += own
            if best != g:
                still, cls[x] = False, best
                right[:, g] -= pair[:, x]
                right[:, best] += pair[:, x]
                left[:, g] -= pair[x]
                left[:, best] += pair[x]
                if moved is not None:
                    moved(cls)
        if still:
            break
    return cls


def word_classes(k: np.ndarray, shape: np.ndarray, keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each key (its shape's where `keys`, sorted, lacks it), and whether it is in `keys`."""
    if not len(keys):
        return CLASSES + 1 + shape.astype(np.int64), np.zeros(len(k), bool)
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    inside = keys[at] == k
    return np.where(inside, classes[at], CLASSES + 1 + shape), inside


def _tallied(text: DataFrame, keys_of) -> DataFrame:
    """(k, n): how often keys_of(hashes, shapes) gives each 64-bit key in the texts; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for b in batches:
            for _, _, data, off in tv.byte_slices(tv.text_array(b, "text")):
                tally.add(keys_of(*token_stream(data, off)[:2]))
                if tally.full:
                    tally.merge()
                    yield pa.RecordBatch.from_arrays([pa.array(tv.signed(tally.keys)), pa.array(tally.counts)], ["k", "n"])
                    tally = _Tally()
        tally.merge()
        yield pa.RecordBatch.from_arrays([pa.array(tv.signed(tally.keys)), pa.array(tally.counts)], ["k", "n"])

    return text.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _choose(counted: DataFrame, gain: np.ndarray, per_token: np.ndarray) -> DataFrame:
    """Words (k with a context in its bits, n) to (h, n, cls, ctx, weight): a row a word with the class of
    the largest likelihood (n: its tokens; `gain` by context and class, `per_token` by class), and rows
    without h: how often classes follow contexts, each word's tokens less DISCOUNT, which its shape gets."""
    shared = counted.sparkSession.sparkContext.broadcast((gain, per_token))
    schema = "h long, n long, cls int, ctx int, weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = shared.value
        follows = np.zeros((TOTAL, TOTAL))

        def words(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            word, ctx = k & ~_LOW | k & np.uint64(3), ((k & _LOW) >> np.uint64(2)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lefts = np.where(ctx < TOTAL, n, 0)
            total = np.add.reduceat(lefts, at)
            value = np.add.reduceat(n[:, None] * table[ctx], at, 0) + total[:, None] * base
            best = value.argmax(1)
            row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(k))))
            share = lefts * (DISCOUNT / np.maximum(total, 1))[row]
            ok = ctx < TOTAL
            np.add.at(follows, (ctx[ok], best[row][ok]), (lefts - share)[ok])
            np.add.at(follows, (ctx[ok], CLASSES + 1 + (word[at] & np.uint64(3)).astype(np.int64)[row][ok]), share[ok])
            m = len(at)
            return pa.RecordBatch.from_arrays([pa.array(tv.signed(word[at])), pa.array(total), pa.array(best, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.float64())], ["h", "n", "cls", "ctx", "weight"])

        rest_k, rest_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            k = np.concatenate([rest_k, b.column(0).to_numpy().view(np.uint64)])
            n = np.concatenate([rest_n, b.column(1).to_numpy()])
            # the last word may go on in the next batch
            last = int(np.searchsorted(k >> np.uint64(9), k[-1] >> np.uint64(9))) if len(k) else 0
            if last:
                yield words(k[:last], n[:last])
            rest_k, rest_n = k[last:], n[last:]
        if len(rest_k):
            yield words(rest_k, rest_n)
        i, j = np.nonzero(follows)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64()), pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(follows[i, j])], ["h", "n", "cls", "ctx", "weight"])

    # keys as unsigned numbers in order: all rows of a word (its 55 bits) in one partition
    word = F.shiftright("k", 9)
    return counted.repartition(word).sortWithinPartitions(F.col("k").bitwiseXOR(F.lit(-(1 << 63)))).mapInArrow(run, schema)


def _logs(trans: np.ndarray) -> np.ndarray:
    return np.log(trans + 1e-2)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (h, n, cls) of the words beyond its head, from the training rows `docs`."""
    spark = docs.sparkSession
    text = docs.select("text")
    share = lambda *x: spark.sparkContext.broadcast(x)
    vocab = materialize(text.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "vocabulary")
    n, v = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = F.col("h") == F.lit(int(np.uint64(END_KEY).view(np.int64)))
    words_only = vocab.where(~end)
    # the least count of which at most HEAD words have as much or more; each count has a word, so HEAD counts suffice
    counts = words_only.groupBy("n").agg(F.count("*").alias("w")).orderBy(F.desc("n")).limit(HEAD).toPandas()
    fits = counts["n"][counts["w"].cumsum() <= HEAD]
    least = int(fits.min()) if len(fits) else 1 << 62
    top = words_only.where(F.col("n") >= F.lit(least)).toPandas().sort_values(["n", "h"], ascending=[False, True])  # at most HEAD rows
    key, count = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    n_seeds = min(SEEDS, len(key))

    # seeds: exact exchange on their bigrams
    order = np.argsort(key)
    seeds = share(key[order], np.where(order < n_seeds, order + 1, 0), n_seeds)

    def seed_pairs(h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        ids = word_ids(h, shape, *seeds.value)
        before = np.concatenate([[0], ids[:-1]])  # the end token precedes each text
        return (before * (seeds.value[2] + 1 + SHAPES) + ids).astype(np.uint64)

    got = _tallied(text, seed_pairs).toArrow()  # at most (SEEDS + 5)^2 rows
    size = n_seeds + 1 + SHAPES
    k, w = got.column("k").to_numpy(), got.column("n").to_numpy()
    cls = exchange(k // size, k % size, w, n_seeds)

    # other words of the head, by the classes of the seeds beside them
    trans = np.bincount(cls[k // size] * TOTAL + cls[k % size], w, TOTAL * TOTAL).reshape(TOTAL, TOTAL)
    head_class = np.full(len(key), -1)
    head_class[:n_seeds] = cls[1 : n_seeds + 1]
    with_end = lambda keys, classes: (np.append(keys, np.uint64(END_KEY)), np.append(classes, CLASSES))

    def ordered(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = np.argsort(keys)
        return keys[o], classes[o]

    others = share(*ordered(*with_end(key[:n_seeds], head_class[:n_seeds])), np.sort(key[n_seeds:]))

    def beside(h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        kk = keyed(h, shape)
        c, _ = word_classes(kk, shape, *others.value[:2])
        _, mine = word_classes(kk, shape, others.value[2], np.zeros(len(others.value[2]), np.int64))
        at = np.flatnonzero(mine)  # never the last token, which is an end
        before = np.where(at > 0, c[at - 1], CLASSES)
        word = kk[at]
        return np.concatenate([word | before.astype(np.uint64) << np.uint64(2), word | (TOTAL + c[at + 1]).astype(np.uint64) << np.uint64(2)])

    if len(key) > n_seeds:
        gain = np.concatenate([_logs(trans)[:, :CLASSES], _logs(trans)[:CLASSES].T])
        per_token = -(_logs(trans.sum(0)) + _logs(trans.sum(1)))[:CLASSES]
        chosen = _choose(_tallied(text, beside), gain, per_token).where("h is not null").select("h", "cls").toPandas()  # at most HEAD rows
        own, ckey = chosen["cls"].to_numpy(), chosen["h"].to_numpy(np.int64).view(np.uint64)
        o = np.argsort(ckey)
        head_class[n_seeds:] = own[o][np.searchsorted(ckey[o], key[n_seeds:])]

    # class bigrams of the head, then the rest of the vocabulary by the class before
    head = share(*ordered(*with_end(key, head_class)))

    def class_pairs(h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        c, inside = word_classes(keyed(h, shape), shape, *head.value)
        before = np.concatenate([[CLASSES], c[:-1]])
        return (before * TOTAL + c)[inside].astype(np.uint64)

    got = _tallied(text, class_pairs).toArrow()  # at most TOTAL^2 rows
    trans = np.bincount(got.column("k").to_numpy(), got.column("n").to_numpy(), TOTAL * TOTAL).reshape(TOTAL, TOTAL)

    def after(h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        kk = keyed(h, shape)
        c, inside = word_classes(kk, shape, *head.value)
        before = np.concatenate([[CLASSES], c[:-1]])[~inside]
        return kk[~inside] | before.astype(np.uint64) << np.uint64(2)

    rest = materialize(_choose(_tallied(text, after), _logs(trans)[:, :CLASSES], -_logs(trans.sum(0))[:CLASSES]), "rest-of-vocabulary")
    for ctx, c, weight in rest.where("h is null").groupBy("ctx", "cls").agg(F.sum("weight")).collect():  # at most TOTAL^2 rows
        trans[ctx, c] += weight
    per_shape = dict(rest.where("h is not null").groupBy(F.expr("h & 3")).agg(F.count("*")).collect())
    into = trans.sum(0)
    smooth = (into + 1) / (into.sum() + TOTAL)
    transition = (trans + PRIOR * smooth[None, :]) / (trans.sum(1, keepdims=True) + PRIOR)
    ends = int(trans[:, CLASSES].sum())
    o = np.argsort(np.append(key, np.uint64(END_KEY)))
    keys, classes = with_end(key, head_class)
    model = Model(keys[o], np.append(count, ends)[o].astype(np.int64), classes[o].astype(np.int64), transition, into, np.array([per_shape.get(x, 0) for x in range(SHAPES)]), int(n), int(v))
    return model, rest.where("h is not null").select("h", "n", "cls")


def word_ids(h: np.ndarray, shape: np.ndarray, sorted_key: np.ndarray, sorted_id: np.ndarray, n_words: int) -> np.ndarray:
    """0 for the end token, 1..n_words for seeds, then one number a shape."""
    k = keyed(h, shape)
    out = n_words + 1 + shape.astype(np.int64)
    if len(sorted_key):
        at = np.minimum(np.searchsorted(sorted_key, k), len(sorted_key) - 1)
        out = np.where((sorted_key[at] == k) & (sorted_id[at] > 0), sorted_id[at], out)
    out[k == np.uint64(END_KEY)] = 0
    return out


_PARTS = "uid long, doc_id long, h long, before int, cls int, tokens long, known long, base double, score double"


def score(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i, j, data, off in tv.byte_slices(tv.text_array(b, "text")):
                h, shape, row = token_stream(data, off)
                k = keyed(h, shape)
                at = np.minimum(np.searchsorted(m.head, k), len(m.head) - 1)
                inside = m.head[at] == k
                c = np.where(inside, m.head_n[at], 0)
                cls = np.where(inside, m.head_class[at], CLASSES + 1 + shape)
                before = np.concatenate([[CLASSES], cls[:-1]])
                rows = j - i
                base = np.where(inside, np.log10(c + 1.0), 0.0)
                lp = np.where(inside, m.log_prob(before, cls, c), 0.0)
                out = np.flatnonzero(~inside)
                n = rows + len(out)

                def column(per_text, per_tail, kind, null_text=False):
                    mask = np.zeros(n, bool)
                    mask[:rows] = null_text
                    return pa.array(np.concatenate([per_text, per_tail]), kind, mask=mask)

                zero = np.zeros(rows, np.int64)
                ids = b.schema.get_field_index("uid"), b.schema.get_field_index("doc_id")
                pick = pa.array(np.concatenate([np.arange(i, j), i + row[out]]))
                counted = lambda x: np.bincount(row, x, rows)
                tail = np.zeros(len(out))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(x).take(pick) for x in ids),
                        column(zero, tv.signed(k[out]), pa.int64(), True),
                        column(zero, before[out], pa.int32(), True),
                        column(zero, cls[out], pa.int32(), True),
                        column(counted(None).astype(np.int64), tail.astype(np.int64), pa.int64()),
                        column(counted(inside & (c > 0)).astype(np.int64), tail.astype(np.int64), pa.int64()),
                        column(counted(base), tail, pa.float64()),
                        column(counted(lp), tail, pa.float64()),
                    ],
                    [x.split()[0] for x in _PARTS.split(", ")],
                )

    parts = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(run, _PARTS), "token-parts")
    tail = parts.where("h is not null").select("uid", "doc_id", "h", "before", F.col("cls").alias("unseen")).join(rest, "h", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    # the formula over columns: transitions and class sizes as literals of fixed size
    array = lambda values: F.array(*[F.lit(float(x)) for x in values])
    known = F.col("n").isNotNull()
    share = F.when(known, (F.col("c") - DISCOUNT) / array(np.maximum(model.class_n, 1))[F.col("cls")]).otherwise(array(1 / (model.shape_v + 1))[F.col("unseen") - (TOTAL - SHAPES)])
    p = array(MIXTURE * model.transition.ravel())[F.col("before") * TOTAL + F.coalesce("cls", "unseen")] * share + (1 - MIXTURE) * (F.col("c") + 1) / float(model.n + model.v + 1)
    tail = tail.select("uid", "doc_id", F.lit(0).cast("long").alias("tokens"), (F.col("c") > 0).cast("long").alias("known"), F.log10(F.col("c") + 1.0).alias("base"), F.log10(p).alias("score"))
    every = parts.where("h is null").select("uid", "doc_id", "tokens", "known", "base", "score").union(tail)
    whole = every.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("tokens", "known", "base", "score")])
    base = F.col("base") - F.col("tokens") * float(np.log10(model.n + model.v + 1))
    return whole.select("doc_id", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
