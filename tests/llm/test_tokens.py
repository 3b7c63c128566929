"""Token counts against the library, whatever the cache holds."""

from __future__ import annotations

import re

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from flowmill.llm import queries, token_counts

from .fixtures import awkward, empty

BPE, PIECES, LOWER = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


def by_library(path: str, texts: list[str]) -> list[int]:
    if path == PIECES:
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [len(t.encode(x, add_special_tokens=False)) for x in texts]


def expected(rows, path: str) -> list[tuple]:
    texts = [r["text"] or "" for r in rows]
    return sorted(((r["doc_id"], len(t.encode()), n, n > 512) for r, t, n in zip(rows, texts, by_library(path, texts), strict=True)), key=str)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_as_the_library(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "documents").collect()
    assert got(queries.op11_token_cache(spark, sf_dir)) == expected(rows, BPE)


@pytest.mark.parametrize("path", [BPE, PIECES, LOWER])
def test_awkward_rows(spark, path):
    docs = awkward(spark).unionByName(awkward(spark).limit(2).withColumn("text", F.lit("a<|endoftext|>b  <|endoftext|> <s>")))
    assert got(token_counts.token_counts(docs, path)) == expected(docs.collect(), path)


def test_plain_characters_one_by_one():
    """Every character that is counted by pre-tokens, beside letters, digits, marks and spaces."""
    chars = [chr(c) for c in range(0x2100) if re.match(f"[{token_counts.PLAIN}]", chr(c))]
    assert len(chars) > 700
    texts = [x for c in chars for x in (f"a{c}a", f"{c}{c} 1{c}1 {c}.{c} ", f"  {c}  {c}x\n{c}'s'{c}")]
    assert token_counts.counter(BPE)(texts) == by_library(BPE, texts)


def test_long_text_without_a_list_of_pieces(monkeypatch):
    texts = ["some words, and 12 more\n\n\t " * 50]
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 100)
    assert token_counts.counter(BPE)(texts) == by_library(BPE, texts)


def test_cache_is_used_and_grows(spark, tmp_path):
    cache, version = str(tmp_path / "cache"), token_counts.tokenizer_version(BPE)
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
    first = got(token_counts.token_counts(docs, BPE, cache))
    assert token_counts.cached(spark, cache, version).count() == 2
    # a stored count is believed: nothing is encoded again
    doctored = token_counts.cached(spark, cache, version).withColumn("n_tokens", F.col("n_tokens") + 100).collect()
    other = str(tmp_path / "doctored")
    token_counts.append(spark.createDataFrame(doctored, token_counts.SCHEMA), other, version)
    more = docs.unionByName(spark.createDataFrame([(4, "three"), (5, "three")], docs.schema))
    assert got(token_counts.token_counts(more, BPE, other)) == [(1, 7, first[0][2] + 100, False), (2, 7, first[1][2] + 100, False), (3, 0, 100, False), (4, 5, 1, False), (5, 5, 1, False)]
    assert token_counts.cached(spark, other, version).count() == 3
    # the same batch twice, as two runs at a time would leave it
    token_counts.append(token_counts.cached(spark, cache, version), cache, version)
    assert got(token_counts.token_counts(docs, BPE, cache)) == first
    token_counts.compact(spark, cache, version)
    assert token_counts.cached(spark, cache, version).count() == 2
    assert got(token_counts.token_counts(docs, BPE, cache)) == first
    # another tokenizer has entries of its own
    assert token_counts.cached(spark, cache, token_counts.tokenizer_version(PIECES)) is None


def test_empty_table(spark):
    df = token_counts.token_counts(empty(spark), BPE)
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and df.count() == 0
