"""The stream of uploads: faults, counts and restarts."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowmill.streaming import score_uploads as SU


def upload(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(["a,b", *lines]) + "\n", encoding="latin-1")


def run(spark, path, seen=None):
    def score(df):
        if seen is not None:
            seen.append(1)
        return df.select("a", (F.col("a") + F.coalesce("b", F.lit(0.0))).alias("s"))

    stream = SU.read_uploads(spark, str(path / "in"), ["a", "b"], 1)
    q = SU.score_uploads(stream, ["a", "b"], score, str(path / "out"), str(path / "state"))
    q.awaitTermination()


def parts(spark, path):
    read = lambda n: SU.read_part(spark, str(path / "out"), n)
    return sorted(tuple(r) for r in read("scored").collect()), sorted((r["_fault"] for r in read("quarantine").collect())), sorted((r["batch"], r["n_rows"], r["n_quarantined"]) for r in read("counts").collect())


def test_faults_are_set_aside_and_a_restart_counts_once(spark, tmp_path):
    upload(tmp_path / "in", "1.csv", "1,2", "x,2", "3,", " 4 ,NaN")
    run(spark, tmp_path)
    upload(tmp_path / "in", "2.csv", "5,6", "7,8,9", "1e3,y", "z,y")
    run(spark, tmp_path)
    first = parts(spark, tmp_path)
    assert [r[0] for r in first[0]] == [1.0, 3.0, 4.0, 5.0]
    assert first[1] == ["cells", "number:a", "number:a,b", "number:b"] and [c[1:] for c in first[2]] == [(4, 1), (4, 3)]
    # the second batch was written but not committed when the run was cut off: it is written again
    last = max((f for f in Path(tmp_path / "state" / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    seen = []
    run(spark, tmp_path, seen)
    assert seen and parts(spark, tmp_path)[1:] == first[1:] and [r[0] for r in parts(spark, tmp_path)[0]] == [1.0, 3.0, 4.0, 5.0]
    run(spark, tmp_path)
    assert parts(spark, tmp_path)[1:] == first[1:]


def test_a_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("a,c\n1,2\n")
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path)


def test_nothing_uploaded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run(spark, tmp_path)
    assert SU.read_part(spark, str(tmp_path / "out"), "scored") is None
