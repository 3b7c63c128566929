"""Small document tables with awkward rows."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> list[str]:
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def awkward_rows() -> list[tuple]:
    """Nulls, empty, spaces, one word, wide characters, ties, repeats, a very long text."""
    long_text = " ".join(words(random.Random(5), 30_000))
    texts = [None, "", "   \n\t ", "x", "!!! ???", "Ünïcödé ñandú straße 汉字 かな", "a b c d e f g", "a b c d e f g", "line\n\nline\nline two", long_text]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], None if t is None or i % 2 else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "a row without an id", None, None, None), (None, None, None, None, None)]


def awkward(spark):
    """The awkward rows with extra columns whose names clash with operators' own."""
    df = spark.createDataFrame(awkward_rows(), DOCS)
    return df.selectExpr("*", "doc_id as id", "'x' as component", "1 as score", "2 as shard", "'k' as fp", "3 as _n", "4 as uid", "5 as label")


def empty(spark):
    return spark.createDataFrame([], DOCS)
