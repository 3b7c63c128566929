"""Stored split manifests, digests of files, chronology of sub-labels, threshold ranges."""

from __future__ import annotations

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from flowmill.operators import metrics as M
from flowmill.operators import sampling as S
from flowmill.sources import bundles, manifests

KNOWN = ["mon", "wed"]


def _split(spark, heart: int = 11):
    rows = [("mon", "BENIGN", i) for i in range(200)] + [("wed", "DoS", i) for i in range(100)] + [("wed", "Heartbleed", 900 + i) for i in range(heart)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_id long, source string, label string, at long")
    return S.chronological_split(df, ["source", "label"], "at", "row_id")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("m") / "manifest")
    manifests.store_manifest(manifests.build_manifest(_split(spark), "label", "source", "chronological_v1", "flows"), path)
    return path


def _document(stored) -> dict:
    name = next(f for f in os.listdir(stored) if f.endswith(".json"))
    with open(f"{stored}/{name}", encoding="utf-8") as f:
        return json.load(f)


def test_manifest_round_trips(spark, stored):
    m = manifests.require_valid(manifests.load_manifests(spark, stored), "chronological", "flows", KNOWN)
    got = {r["label"]: (r["n_train"], r["n_test"]) for r in manifests.declared_counts(m).collect()}
    assert got == {"BENIGN": (140, 60), "DoS": (70, 30), "Heartbleed": (7, 4)}
    row = m.first()
    assert (row["sources"], row["expected_train_rows"], row["expected_test_rows"], row["order_basis"], row["final_test_locked"]) == (KNOWN, 217, 94, "csv_row_index", True)
    assert S.manifest_mismatches(S.split_manifest(_split(spark), "label"), manifests.declared_counts(m)).count() == 0


def test_manifest_tells_a_changed_split(spark, stored):
    declared = manifests.declared_counts(manifests.load_manifests(spark, stored))
    assert [r["label"] for r in S.manifest_mismatches(S.split_manifest(_split(spark, heart=10), "label"), declared).collect()] == ["Heartbleed"]


@pytest.mark.parametrize(
    ("field", "value"),
    [
        ("version", "holdout_v3"), ("dataset_id", "other"), ("order_basis", "timestamp"), ("final_test_locked", False), ("random_row_split", True), ("calibration_size", 0.1),
        ("test_size", 1.5), ("sources", ["unknown"]), ("sources", ["mon", "mon"]), ("sources", []), ("expected_train_rows", 999_999), ("expected_test_rows", None), ("expected_counts", {}),
        ("expected_counts", {"DoS": {"train": 1}}), ("test_size", "much"),
    ],
)
def test_malformed_fields_are_named(spark, stored, tmp_path, field, value):
    (tmp_path / "m.json").write_text(json.dumps(_document(stored) | {field: value}, indent=2), encoding="utf-8")
    loaded = manifests.load_manifests(spark, str(tmp_path))
    assert field in {r["field"] for r in manifests.manifest_faults(loaded, "chronological", "flows", KNOWN).collect()}
    with pytest.raises(ValueError, match=field):
        manifests.require_valid(loaded, "chronological", "flows", KNOWN)


def test_null_classes_and_empty_splits(spark):
    s = _split(spark).withColumn("label", F.when(F.col("label") != "DoS", F.col("label")))
    m = manifests.build_manifest(s, "label", "source", "v", "flows")
    assert set(m.first()["expected_counts"]) == {"", "BENIGN", "Heartbleed"}
    empty = manifests.build_manifest(s.where("false"), "label", "source", "v", "flows").withColumn("manifest", F.lit("m"))
    assert {r["field"] for r in manifests.manifest_faults(empty, "v", "flows", KNOWN).collect()} == {"sources", "expected_counts"}


def test_split_errors(spark):
    s = _split(spark)
    assert S.require_split(s, "label", 4) is s
    with pytest.raises(ValueError, match="Heartbleed"):
        S.require_split(s, "label", 5)
    with pytest.raises(ValueError, match="test side is empty"):
        S.require_split(s.where("side = 'train'"), "label")


def test_digest_of_several_chunks(spark, tmp_path):
    body = random.Random(5).randbytes(3 * bundles.DIGEST_CHUNK + 17)
    files = {"big one.bin": body, "empty.bin": b"", "small.bin": b"abc"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = {(n, len(x), hashlib.sha256(x).hexdigest()) for n, x in files.items()}
    got = bundles.file_digests(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in bundles.file_digests(spark, str(tmp_path), streamed=False).collect()} == {r for r in want if r[1]}
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()
    declared = [(n, s, h) for n, s, h in want if n != "small.bin"] + [("small.bin", 3, "0"), ("../secret", 1, "0"), ("absent.bin", 1, "0")]
    diff = bundles.manifest_diff(got, spark.createDataFrame(declared, "name string, size long, sha256 string"))
    assert {tuple(r) for r in diff.collect()} == {("small.bin", "hash"), ("../secret", "path escape"), ("absent.bin", "missing")}


def test_chronology_by_file_length(spark):
    rows = [("wed", "DoS", i) for i in range(100)] + [("wed", "Heartbleed", i) for i in range(800, 811)]
    df = spark.createDataFrame(rows, "source string, label string, at long")
    lengths = spark.createDataFrame([("wed", 1001)], "source string, n_rows long")
    pos = S.label_positions(df, "source", "label", "at", lengths)
    assert {r["label"]: (r["min_pos"], r["median_pos"], r["max_pos"]) for r in pos.collect()} == {"DoS": (0.0, 0.0495, 0.099), "Heartbleed": (0.8, 0.805, 0.81)}
    schedule = lambda *names: spark.createDataFrame([("wed", x, i) for i, x in enumerate(names)], "source string, label string, seq int")
    assert S.require_chronology(pos, schedule("DoS", "Heartbleed"), "source", "label") is pos
    with pytest.raises(ValueError, match="DoS before Heartbleed"):
        S.require_chronology(pos, schedule("Heartbleed", "DoS"), "source", "label")
    with pytest.raises(ValueError, match="absent.*Bot"):
        S.require_chronology(pos, schedule("DoS", "Bot"), "source", "label")


def test_thresholds_of_concentrated_scores(spark):
    """Confident models: all scores lie within a thousandth, and some aren't numbers."""
    rng = random.Random(3)
    rows = [(0, rng.randint(0, 1), 0.999 + rng.randint(0, 400) / 1e6) for _ in range(3000)] + [(1, k % 2, 0.5) for k in range(10)] + [(0, 0, float("nan"))] * 3
    best = {r["model"]: r for r in M.calibrate_threshold(spark.createDataFrame(rows, "model int, y_true int, score double"), 1, 0.6).collect()}
    own = [(y, s) for m, y, s in rows if m == 0]
    n_pos = sum(y for y, _ in own)

    def at(t):
        tp, fp = sum(y for y, s in own if not s < t), sum(1 - y for y, s in own if not s < t)
        p, r = tp / (tp + fp), tp / n_pos
        return (2 * p * r / (p + r) if p + r else 0.0, p, r, t), fp / (len(own) - n_pos)

    want = max(k for k, fpr in (at(t) for t in {s for _, s in own if s == s}) if fpr <= 0.6)
    assert tuple(best[0][c] for c in ("f1", "precision", "recall", "threshold")) == pytest.approx(want, abs=1e-12)
    assert 1 not in best  # its one threshold takes all negatives
