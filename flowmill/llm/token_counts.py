"""Operator 11: token counts from a digest cache.

A text's key is the SHA-256 of its content after `normalise`, beside the digest of everything that
could change a count: the tokenizer file, the library and its version, the settings. The cache is a
folder of Parquet batches a tokenizer version (digest, n_tokens). A run

* looks the distinct digests of its documents up in the version's batches,
* encodes one text of each digest that isn't there, and appends these counts as one batch, which
  becomes visible by a single rename once it is whole,
* joins the documents' digests to the counts.

Only the texts of misses are moved: few misses are broadcast, many meet their texts in a shuffle,
and on an empty cache nothing is looked up. Copies of a text are reduced to one inside each task
before they are shuffled, so that a text with a third of all rows sends one row a task.

Counts are those of the library for the file: `tokenizers` for .json, `sentencepiece` for .model;
without begin, end or added tokens, truncation or padding. Byte-level BPE never joins bytes of two
pre-tokens, so for such a .json file a task counts each distinct pre-token once by the library and
adds up; texts with an added token's string, or with characters beyond those listed in `PLAIN`, whose
classes may differ between versions of Unicode, are encoded whole.

Defined results: null is the empty text, of 0 bytes and 0 tokens; null and repeated ids keep their
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_root, small_side

LIMIT = 512
#: Pre-tokens whose counts a Python worker remembers (about 100 MB).
REMEMBERED = 500_000
#: Bytes of text that are encoded at once.
BATCH_BYTES = 4 << 20
#: Characters whose class (letter, number, space) all the libraries agree on; tests try each of them.
PLAIN = "\u0000-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁄€"
#: How byte-level BPE cuts a text into pre-tokens (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Pieces(dict):
    """Token counts of pre-tokens, found by the library when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n = len(self.tokenizer.encode(piece, add_special_tokens=False))
        return n


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens; one a worker and file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import regex
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    by_pieces = spec["model"].get("type", "BPE") == "BPE" and not spec["model"].get("dropout") and not spec.get("normalizer")
    by_pieces &= cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    if not by_pieces:
        return lambda texts: [whole(t) for t in texts]
    pieces, cuts, odd = _Pieces(tokenizer), regex.compile(PRE_TOKEN), re.compile(f"[^{PLAIN}]")
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def count(text: str) -> int:
        if odd.search(text) or any(a in text for a in added):
            return whole(text)
        if len(text) > BATCH_BYTES:  # without a list of all its pieces
            return sum(pieces[m.group()] for m in cuts.finditer(text))
        return sum(map(pieces.__getitem__, cuts.findall(text)))

    return lambda texts: [count(t) for t in texts]


def tokenizer_version(path: str) -> str:
    """Digest of the file, its library and version, and how it is called."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library} {importlib.metadata.version(library)} plain\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text)."""

    def run(batches):
        count = counter(path)
        for b in batches:
            digests, sizes, at = b.column(0), b.column(1).nbytes, 0
            step = max(1, b.num_rows * BATCH_BYTES // max(1, sizes))
            while at < b.num_rows:
                part = b.column(1).slice(at, step).to_pylist()
                yield pa.RecordBatch.from_arrays([digests.slice(at, step), pa.array(count(part), pa.int64())], ["digest", "n_tokens"])
                at += step

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


SCHEMA = "digest binary, n_tokens long"


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The version's rows of all whole batches, or None if there are none. A digest that two runs
    counted at the same time is there twice, with the same count."""
    fs, folder = _fs(spark, f"{cache}/{version}")
    batches = [str(s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch-")] if fs.exists(folder) else []
    return spark.read.schema(SCHEMA).parquet(*batches) if batches else None


def append(counts: DataFrame, cache: str, version: str) -> DataFrame:
    """Write counts as one batch of the cache and return it as read back; readers see all of it or nothing."""
    spark, name = counts.sparkSession, uuid.uuid4().hex
    hidden, seen = f"{cache}/{version}/_batch-{name}", f"{cache}/{version}/batch-{name}"
    counts.write.option("compression", "zstd").parquet(hidden)
    fs, source = _fs(spark, hidden)
    if not fs.rename(source, _fs(spark, seen)[1]):
        raise OSError(f"{hidden} can't be renamed")
    return spark.read.schema(SCHEMA).parquet(seen)


def compact(spark: SparkSession, cache: str, version: str) -> None:
    """Merge the version's batches into one, each digest once. Not while others read the cache."""
    fs, folder = _fs(spark, f"{cache}/{version}")
    old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch-")]
    append(cached(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), cache, version)
    for p in old:
        fs.delete(p, True)


def own_cache(spark: SparkSession) -> str:
    """The folder of `spark.flowmill.token.cache`, or a new and empty one in the shared folder."""
    return spark.conf.get("spark.flowmill.token.cache", "") or f"{scratch_root(spark)}/flowmill/tokens-{uuid.uuid4().hex}"


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document.

    tokenizer: a file that every machine has at this path. cache: a folder that all machines share.
    normalise: applied to the text before it is hashed and encoded, for tokenizers of which it doesn't
    change the counts; by default texts are taken as they are."""
    spark = docs.sparkSession
    cache, version = cache or own_cache(spark), tokenizer_version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    content = normalise(text) if normalise else text
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content.alias("text"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"))
    texts, before = keyed.select("digest", "text"), cached(spark, cache, version)
    found = None
    if before is not None:
        own = materialize(keyed.select("digest").distinct(), "token-digests")
        found = materialize(before.join(own, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-hits")
        misses = materialize(own.join(found, "digest", "left_anti"), "token-misses")
        texts = texts.join(small_side(misses), "digest", "left_semi")
    new = append(_encoded(texts.groupBy("digest").agg(F.first("text").alias("text")), tokenizer), cache, version)
    counts = new if found is None else found.unionByName(new)
    out = keyed.select("doc_id", "n_bytes", "digest").join(counts, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
